"""Toxicity by weak supervision.

Many voters look at a text: word lists by theme, word lists learnt from the
labelled rows, and patterns. A voter says toxic, clean, or nothing. A generative
label model estimates how accurate each voter is and which voters repeat one
another, and turns votes into a posterior label; a linear classifier is then
trained on the posteriors and scores every text.

Only the fit uses labels, on a sample of at most ``sample_rows`` labelled rows.
What reaches the driver is bounded by parameters: the learnt list (``learnt``
words), the vote patterns (2 ** voters), the distinct feature sets of the sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lexigraph.llm.common import materialize

# Everyday insults, profanity and threats by theme.
SEEDS = {
    "intellect": "idiot idiots moron morons stupid dumb fool fools imbecile clown clowns brainless halfwit dimwit cretin",
    "worth": "loser losers pathetic worthless scum trash garbage filth vermin useless nobody lowlife parasite",
    "disgust": "disgusting disgrace vile gross repulsive revolting sickening ugly creep pervert",
    "profanity": "fuck fucking fucked shit bullshit asshole bitch bastard crap dick piss damn",
    "threat": "kill die murder hang shoot stab beat destroy rape",
    "german": "idiot idioten dummkopf vollidiot arschloch scheisse scheiße abschaum trottel versager",
    "french": "idiote imbécile connard connasse merde salaud ordure crétin minable",
    "spanish": "estúpido estupido imbécil pendejo mierda basura cabrón idiota inútil escoria",
}
# Themes whose words also stand in harmless texts speak only next to a second hit.
FAINT = ("threat",)
LEARNT_VOTERS = 6
PATTERNS = ("addressed", "shouted", "repeated")
SILENT = "no_hit"
VOTERS = (*SEEDS, *[f"learnt_{i}" for i in range(LEARNT_VOTERS)], *PATTERNS, SILENT)
LABEL_ACCURACY = 0.95

TOXIC, CLEAN, NOTHING = 1, 2, 0
ADDRESS = re.compile(r"\b(?:you|your|you're|u|du|ihr|tu|vous|tú|usted)\s+(?:are\s+|such\s+|an?\s+|really\s+|bist\s+|es\s+|eres\s+)*$")


@dataclass(frozen=True)
class Model:
    """Everything a scorer needs; plain values only, so it ships with the task."""

    learnt: tuple[str, ...]
    words: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def scorer(self) -> Callable[[str | None], float]:
        look = finder(self.learnt)
        at = {f: w for f, w in zip(self.words, self.weights)}

        def score(text: str | None) -> float:
            total = self.bias + sum(at.get(f, 0.0) for f in features(*look(text)))
            return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, total))))

        return score


def finder(learnt: tuple[str, ...]):
    """text -> (hits of the listed words with their places, the text in lower case)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in {w for words in SEEDS.values() for w in words.split()} | set(learnt):
        machine.add_word(word, word)
    machine.make_automaton()

    def look(text: str | None) -> tuple[list[tuple[str, int]], str]:
        low = (text or "").lower()
        hits = []
        for end, word in machine.iter(low):
            start = end - len(word) + 1
            if (start == 0 or not low[start - 1].isalpha()) and (end + 1 == len(low) or not low[end + 1].isalpha()):
                hits.append((word, start))
        return hits, text or ""

    return look


def votes(hits: list[tuple[str, int]], text: str, themes: dict[str, frozenset[str]]) -> list[int]:
    found = {w for w, _ in hits}
    out = []
    for name, words in themes.items():
        said = bool(found & words)
        if name in FAINT and len(found) < 2:
            said = False
        out.append(TOXIC if said else NOTHING)
    low = text.lower()
    out.append(TOXIC if any(ADDRESS.search(low, max(0, at - 40), at) for _, at in hits) else NOTHING)
    out.append(TOXIC if any(text[at : at + len(w)].isupper() and len(w) > 2 for w, at in hits) else NOTHING)
    out.append(TOXIC if len(hits) >= 2 else NOTHING)
    out.append(NOTHING if hits else CLEAN)
    return out


def themes_of(learnt: tuple[str, ...]) -> dict[str, frozenset[str]]:
    import zlib

    out = {name: frozenset(words.split()) for name, words in SEEDS.items()}
    for i in range(LEARNT_VOTERS):
        out[f"learnt_{i}"] = frozenset(w for w in learnt if zlib.crc32(w.encode()) % LEARNT_VOTERS == i)
    return out


def features(hits: list[tuple[str, int]], text: str) -> list[str]:
    """Names of the features that are on: listed words, how many of them, and how they are said."""
    found = {w for w, _ in hits}
    out = [f"word:{w}" for w in sorted(found)]
    out += [f"at_least:{n}" for n in (1, 2, 3) if len(found) >= n]
    if any(text[at : at + len(w)].isupper() and len(w) > 2 for w, at in hits):
        out.append("shouted")
    return out


# -- label model -------------------------------------------------------------------


def label_model(patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of toxic for each pattern of votes.

    ``patterns`` is (n, voters) of NOTHING, TOXIC, CLEAN, ``labels`` the label a
    pattern came with (1, 0), ``counts`` its rows. Expectation maximisation of a
    class-conditional model that starts at the labels, which stay in it as one
    more voter of known accuracy. Voters that agree more than the class explains
    share their weight: a voter counts 1 / (1 + sum of its positive conditional
    correlations).
    """
    n, voters = patterns.shape
    one_hot = np.stack([patterns == v for v in (NOTHING, TOXIC, CLEAN)], axis=2).astype(float)
    posterior = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    evidence = np.where(labels == 1, 1.0, -1.0) * math.log(LABEL_ACCURACY / (1 - LABEL_ACCURACY))
    for _ in range(rounds):
        mass = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = (mass[1].sum() + 1) / (counts.sum() + 2)
        rates = np.einsum("cn,nvk->cvk", mass, one_hot) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        excess = np.zeros((voters, voters))
        spoken = (patterns != NOTHING).astype(float)
        for c in (0, 1):
            weight = mass[c] / max(mass[c].sum(), 1e-9)
            centred = spoken - weight @ spoken
            cov = (centred * weight[:, None]).T @ centred
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            excess += (mass[c].sum() / counts.sum()) * np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(excess, 0)
        share = 1.0 / (1.0 + excess.sum(axis=1))
        ratio = np.log(rates[1]) - np.log(rates[0])
        total = math.log(prior / (1 - prior)) + evidence + np.einsum("nvk,vk,v->n", one_hot, ratio, share)
        new = 1.0 / (1.0 + np.exp(-np.clip(total, -60, 60)))
        if np.abs(new - posterior).max() < 1e-6:
            posterior = new
            break
        posterior = new
    return posterior


def linear(rows: list[tuple[tuple[str, ...], float, float]], ridge: float = 1.0, steps: int = 40) -> tuple[list[str], np.ndarray, float]:
    """Logistic regression by Newton steps on (features, posterior, weight) rows; the bias is not shrunk."""
    names = sorted({f for feats, _, _ in rows for f in feats})
    column = {f: i + 1 for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for r, (feats, _, _) in enumerate(rows):
        for f in feats:
            x[r, column[f]] = 1
    y = np.array([r[1] for r in rows])
    w = np.array([r[2] for r in rows])
    shrink = np.full(len(names) + 1, ridge)
    shrink[0] = 1e-3
    beta = np.zeros(len(names) + 1)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -60, 60)))
        slope = x.T @ (w * (y - p)) - shrink * beta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(bend, slope)
        beta += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return names, beta[1:], float(beta[0])


# -- fit and score ------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _words_of(sample: DataFrame, learnt: int, least: int, odds: float) -> tuple[str, ...]:
    """Words that mark toxic rows: in ``least`` of them or more, with log-odds of ``odds`` or more; the best ``learnt``."""
    low = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    sizes = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    bad, good = int(sizes["t"]), int(sizes["n"]) - int(sizes["t"])
    counted = (
        sample.select("toxic", F.explode(low).alias("word"))
        .filter(F.length("word").between(3, 40))
        .groupBy("word")
        .agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("t") >= max(least, bad // 200))
    )
    score = F.log((F.col("t") + 0.5) / (bad + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (good + 1.0))
    best = counted.withColumn("score", score).filter(F.col("score") >= odds).orderBy(F.desc(F.col("score") * F.log1p("t")), "word").limit(learnt)
    return tuple(r["word"] for r in best.select("word").collect())


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, learnt: int = 200, least: int = 5, odds: float = 4.0) -> Model:
    """Fit on at most about ``sample_rows`` labelled rows that are not held out.

    Null labels and labels of missing documents count for nothing; of several
    labels or rows of an id one stays. Without usable labels the model knows the
    word lists alone.
    """
    usable = labels.select("doc_id", "toxic").filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = usable.count()
    if total > sample_rows:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(sample_rows / total * (1 << 20)))
    # the sample has a bounded number of rows of two numbers, so it is broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    sample = materialize(sample, "toxicity-sample")
    words = _words_of(sample, learnt, least, odds)

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, themes = finder(words), themes_of(words)
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                hits, raw = look(text)
                seen["".join(map(str, votes(hits, raw, themes))), toxic, "\x1f".join(features(hits, raw))] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_pydict(
            {
                "votes": pa.array([k[0] for k in keys], pa.string()),
                "toxic": pa.array([k[1] for k in keys], pa.int32()),
                "features": pa.array([k[2] for k in keys], pa.string()),
                "n": pa.array([seen[k] for k in keys], pa.int64()),
            }
        )

    observed = sample.select("text", "toxic").mapInArrow(observe, "votes string, toxic int, features string, n long")
    rows = observed.groupBy("votes", "toxic", "features").agg(F.sum("n").alias("n")).collect()
    # without labels: each word list counts as written, with weak confidence
    rows = [(r["votes"], r["toxic"], r["features"], r["n"]) for r in rows] or _by_hand()
    keys = sorted({(v, t) for v, t, _, _ in rows})
    counts = Counter()
    for v, t, _, n in rows:
        counts[v, t] += n
    posterior = label_model(
        np.array([[int(c) for c in v] for v, _ in keys]), np.array([float(counts[k]) for k in keys]), np.array([t for _, t in keys])
    )
    of = dict(zip(keys, posterior))
    names, weights, bias = linear([(tuple(f.split("\x1f")) if f else (), float(of[v, t]), float(n)) for v, t, f, n in sorted(rows)])
    return Model(words, tuple(names), tuple(float(w) for w in weights), bias)


def _by_hand() -> list[tuple[str, int, str, int]]:
    themes = themes_of(())
    look = finder(())
    rows = []
    for text, toxic, n in [("", 0, 50)] + [(w, 1, 2) for name, ws in SEEDS.items() if name not in FAINT for w in ws.split()]:
        hits, raw = look(text)
        rows.append(("".join(map(str, votes(hits, raw, themes))), toxic, "\x1f".join(features(hits, raw)), n))
    return rows


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` plus a score from 0 to 1 for its whole text; null and empty texts get the score of no evidence."""

    @F.pandas_udf("double")
    def judged(texts: pd.Series) -> pd.Series:
        judge = model.scorer()
        return pd.Series([judge(t) for t in texts], dtype="float64")

    return docs.withColumn(column, judged(F.col("text")))
