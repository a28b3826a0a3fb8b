"""Secret scans with multipart credential linking.

Three base kinds are found by pattern alone. Weak parts (a random-looking
token, a user name, an address of a service) mean nothing alone; they become
findings only where complementary parts stand together: an access identifier or
user with a secret, or a secret with an endpoint. Parts are joined by interval:
two parts are together when the gap between them is at most ``scope`` characters.

Positions come from splitting a text at the matches and adding up lengths, so
everything stays in DataFrame functions. Only texts that hold a part leave
their row; the others are never shuffled with their text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigraph.llm.common import let, materialize

MINIMUM_VALUE = 6


@dataclass(frozen=True)
class Kind:
    """A part: its pattern, the role it can play and whether it counts alone."""

    name: str
    pattern: str
    role: str
    weak: bool = True
    needs: str = ""  # a pattern that is cheap to look for and stands in every text with this part


# Base kinds first, in the order that breaks ties between spans of one start.
MARK = "[:=]"
LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
KINDS = (
    Kind("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", "secret", weak=False, needs=MARK),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "identifier", weak=False, needs="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", "secret", weak=False, needs=LONG),
    Kind("random", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{32,}(?![A-Za-z0-9+/_-])", "secret", needs=LONG),
    Kind("user", r"(?<![A-Za-z0-9_])(?:[Uu]ser(?:_?(?:name|id))?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccount)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@+-]{2,}", "identifier", needs=MARK),
    Kind("endpoint", r"(?<![A-Za-z0-9])(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9][A-Za-z0-9._:@%/?=&-]*[A-Za-z0-9/]|(?<![A-Za-z0-9_])(?:[Hh]ost(?:name)?|[Ee]ndpoint|[Ss]erver|[Rr]egion)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9][A-Za-z0-9.:-]+", "endpoint", needs=MARK),
)
BASE = tuple(k.name for k in KINDS if not k.weak)
ASSIGN_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?(.+)$"""

# What makes a weak part of a role a finding: a part of one of these roles nearby.
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def _found(text: Column, kind: Kind, number: int) -> Column:
    """array<struct<kind, start, stop, word>> of one kind, leftmost and not overlapping."""
    lengths = let(
        F.struct(F.split(text, kind.pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits")),
        lambda p: F.transform(
            p["hits"], lambda h, i: F.struct(F.length(F.get(p["gaps"], i)).cast("long").alias("gap"), F.length(h).cast("long").alias("size"), h.alias("hit"))
        ),
    )
    return F.transform(lengths, lambda x: F.struct(F.lit(number).alias("kind"), x["gap"].alias("gap"), x["size"].alias("size"), x["hit"].alias("hit")))


def _may_hold(text: Column, need: str, kinds: list[Kind]) -> Column:
    """Whether a text holds a part of kinds that need the same; most texts lack it and are done."""
    part = text.rlike("|".join(f"(?:{k.pattern})" for k in kinds))
    return text.rlike(need) & part if need else part


def parts(docs: DataFrame, key: list[str], kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(key, kind, start, stop) of every part of every text, code points, stop exclusive.

    A row per distinct part of a key; texts without a part give no row.
    """
    any_part = reduce(Column.__or__, [_may_hold(F.col("text"), need, [k for k in kinds if k.needs == need]) for need in dict.fromkeys(k.needs for k in kinds)])
    lists = [
        F.when(F.col("text").rlike(k.pattern), _found(F.col("text"), k, n)).otherwise(
            F.expr("cast(array() as array<struct<kind:int,gap:bigint,size:bigint,hit:string>>)")
        )
        for n, k in enumerate(kinds)
    ]
    rows = docs.filter(any_part).select(*key, F.explode(F.array(*lists)).alias("list")).filter(F.size("list") > 0)
    flat = rows.select(*key, F.posexplode("list").alias("at", "x")).select(*key, "at", "x.kind", "x.gap", "x.size", "x.hit").distinct()
    along = Window.partitionBy(*key, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = flat.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(along)).withColumn("start", F.col("stop") - F.col("size"))
    value = F.regexp_extract("hit", ASSIGN_VALUE, 1)
    strong = (F.col("kind") != 0) | (F.length(value) >= MINIMUM_VALUE)
    return placed.filter(strong).select(*key, "kind", "start", "stop")


def link(found: DataFrame, key: list[str], scope: int = 200, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Parts that count: the strong ones, and weak ones with a complement within ``scope`` characters.

    The interval join is a running maximum of stop per role over the parts that
    start before, and a running minimum of start over those that start after, so
    no pairs are formed however many parts a text has.
    """
    role = F.element_at(F.array(*[F.lit(k.role) for k in kinds]), F.col("kind") + 1)
    weak = F.element_at(F.array(*[F.lit(k.weak) for k in kinds]), F.col("kind") + 1)
    place = ["start", "stop", "kind"]
    before = Window.partitionBy(*key).orderBy(*place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in place]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = found.withColumn("_role", role)
    for name in sorted({k.role for k in kinds}):
        mine = F.col("_role") == name
        seen = seen.withColumn(f"_stop_{name}", F.max(F.when(mine, F.col("stop"))).over(before))
        seen = seen.withColumn(f"_start_{name}", F.min(F.when(mine, F.col("start"))).over(after))

    def near(other: str) -> Column:
        return F.coalesce(F.col(f"_stop_{other}") >= F.col("start") - scope, F.lit(False)) | F.coalesce(F.col(f"_start_{other}") <= F.col("stop") + scope, F.lit(False))

    together = F.lit(False)
    for name, others in COMPLEMENTS.items():
        together = together | ((F.col("_role") == name) & reduce(Column.__or__, map(near, others)))
    return seen.filter(~weak | together).select(*key, "kind", "start", "stop", together.alias("linked"))


def _scanned(docs: DataFrame, carried: list[str], scope: int, kinds: tuple[Kind, ...]) -> DataFrame:
    """The carried columns as one struct ``_row``, with ``spans`` beside it."""
    rows = docs.select(F.struct(*carried).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    keyed = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_hash"), "text")
    linked = link(parts(keyed, ["_doc", "_hash"], kinds), ["_doc", "_hash"], scope, kinds)
    spans = linked.groupBy("_doc", "_hash").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "stop", "linked"))).alias("spans"))
    spans = materialize(spans, "secret-spans")  # where they are few, Spark sees it and leaves the texts where they are
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,stop:bigint,linked:boolean>>)")
    found = rows.join(spans, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")), "left")
    return found.select("_row", F.coalesce("spans", none).alias("spans"))


def scan(docs: DataFrame, scope: int = 200, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` plus ``spans``: array of (start, kind, stop, linked), by start, then kind; never null.

    ``docs`` needs doc_id and text; other columns pass through, one named spans
    is replaced. Null and empty texts have no spans. Rows are matched by id and
    text, so repeated rows and ids each get their own spans.
    """
    carried = [c for c in docs.columns if c.lower() != "spans"]
    scanned = _scanned(docs, carried, scope, kinds)
    return scanned.select(*[F.col("_row")[c].alias(c) for c in carried], "spans")


def digest(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:stop of every span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = 200) -> DataFrame:
    """``docs`` with every span of its text replaced by ``mask``; overlapping spans share one.

    n_chars, where there, follows the text. Texts without spans stay as they are.
    """
    scanned = _scanned(docs, docs.columns, scope, KINDS)
    text = F.col("_row")["text"]
    start = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))

    def between(first: Column, size: Column) -> Column:
        return F.substring(text, (first + 1).cast("int"), size.cast("int"))

    def step(done: Column, span: Column) -> Column:
        gap = F.when(span["start"] >= done["at"], F.concat(between(done["at"], span["start"] - done["at"]), F.lit(mask)))
        return F.struct(
            F.concat(done["text"], F.coalesce(gap, F.lit(""))).alias("text"), F.greatest(done["at"], span["stop"]).alias("at")
        )

    cut = F.aggregate("spans", start, step, lambda done: F.concat(done["text"], between(done["at"], F.length(text))))
    hit = F.size("spans") > 0
    changed = scanned.withColumn("_new", F.when(hit, cut).otherwise(text))
    values = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        values["n_chars"] = F.when(hit, F.length("_new").cast(kind)).otherwise(F.col("_row")["n_chars"])
    return changed.select(*[values.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
