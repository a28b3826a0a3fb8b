"""Question analysis over questions asked about every order."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import NON_ASCII_LETTERS, query, sql_list, table
from lexigraph.functions import constants as C, questions as Q
from lexigraph.session import spread

# Fixed question forms; an order picks one by its key and fills in its own values.
FORMS = [
    "Who placed order {k} in {y}?",
    "Where did customer {c} order in {y}? In which country?",
    "When was order {k} placed, in which year?",
    "Which company supplied Order {k} for Customer {c}?",
    "Who was the Attorney General and director when order {k} came?",
    "How many parts and how much money did order {k} need in {y}?",
    "Why did customer {c} of the New Segment order {p}?",
    "What happened to order {k}? Which event?",
    "Tell me more about order {k} {p}",
]


def form_sql(form: str) -> str:
    text = "'" + form + "'"
    for mark, value in (("{k}", "o_orderkey"), ("{y}", "year(o_orderdate)"), ("{c}", "o_custkey"), ("{p}", "o_orderpriority")):
        text = text.replace(mark, f"' || {value} || '")
    return text


ASKED = "asked as (select o_orderkey as query_id, case o_orderkey % 9 " + " ".join(
    f"when {i} then {form_sql(f)}" for i, f in enumerate(FORMS)
) + " end as query from orders)"


def asked(spark, sf):
    """One question per order."""
    values = {"{k}": F.col("o_orderkey").cast("string"), "{y}": F.year("o_orderdate").cast("string"),
              "{c}": F.col("o_custkey").cast("string"), "{p}": F.col("o_orderpriority")}

    def filled(form):
        text = F.lit(form)
        for mark, value in values.items():
            text = F.replace(text, F.lit(mark), value)
        return text

    form = F.when(F.lit(False), "")
    for i, f in enumerate(FORMS):
        form = form.when(F.col("o_orderkey") % 9 == i, filled(f))
    orders = spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    return orders.select(F.col("o_orderkey").alias("query_id"), form.alias("query"))


def hits_sql(patterns: list[str]) -> str:
    return " + ".join(f"cast(regexp_matches(q, '{p}') as int)" for p in patterns)


KINDS = list(C.QUESTION_TYPES)
COUNTED = "counted as (select query_id, query, " + ", ".join(
    f"{hits_sql(spec['patterns'])} as n{i}" for i, spec in enumerate(C.QUESTION_TYPES.values())
) + f" from (select *, regexp_replace(lower(query), '{NON_ASCII_LETTERS}', '_', 'g') as q from {{source}}))"
LARGEST = "greatest(" + ", ".join(f"n{i}" for i in range(len(KINDS))) + ")"
TYPE_SQL = f"case when {LARGEST} = 0 then 'GENERAL' " + " ".join(f"when n{i} = {LARGEST} then '{k}'" for i, k in enumerate(KINDS)) + " end"
DESCRIPTION_SQL = "case type " + " ".join(f"when '{k}' then '{s['description']}'" for k, s in C.QUESTION_TYPES.items()) + " else 'General query' end"
WEIGHTS_SQL = "case type " + " ".join(
    f"when '{k}' then '" + ",".join(f"{t}={w}" for t, w in sorted(s["weights"].items())) + "'" for k, s in C.QUESTION_TYPES.items()
) + " else '' end"


def detect_sql(source: str) -> str:
    return f"""{COUNTED.format(source=source)},
    typed as (select query_id, {TYPE_SQL} as type, least({LARGEST} / 2.0, 1.0) as confidence from counted)"""


SHOWN = f"""select query_id, type, {DESCRIPTION_SQL} as description, cast(confidence as double) as confidence, {WEIGHTS_SQL} as weights from typed"""


def shown(df):
    info = df.select("query_id", Q.detect_question(F.col("query")).alias("i")).select("query_id", "i.*")
    weights = F.array_join(
        F.transform(F.sort_array(F.map_entries("entity_weights")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )
    return info.select("query_id", "type", "description", "confidence", weights.alias("weights"))


@query("q_detect", f"with {ASKED}, {detect_sql('asked')} {SHOWN}")
def detect(spark, sf):
    return shown(asked(spark, sf))


TALK = "talk as (select conv_id * 1000 + turn as query_id, text as query from conversations)"


@query("q_detect_conversations", f"with {TALK}, {detect_sql('talk')} {SHOWN}")
def detect_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return shown(turns)


@query(
    "q_terms",
    rf"""with {ASKED}
    select query_id, cast(nullif(regexp_extract(query, '\b(19|20)\d{{2}}\b'), '') as int) as query_year,
      array_to_string(list_filter(regexp_extract_all(lower(query), '\b[a-z]+\b'), lambda t: length(t) > 2 and t not in ({sql_list(C.QUESTION_STOPWORDS)})), ' ') as terms,
      array_to_string(regexp_extract_all(query, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b'), '|') as nouns
    from asked""",
)
def terms(spark, sf):
    t = asked(spark, sf).select("query_id", Q.query_terms(F.col("query")).alias("t"))
    return t.select(
        "query_id", "t.query_year", F.array_join("t.important_terms", " ").alias("terms"), F.array_join("t.proper_nouns", "|").alias("nouns")
    )
