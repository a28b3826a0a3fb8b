"""The star schema as an entity graph, and the episode graph of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import documents, mention_cte, query, sentence_cte, table
from lexigraph.operators import graph as G
from lexigraph.session import scratch_path, shuffles_dropped
from lexigraph.streaming.upkeep import GraphStore, keep_up

NODE = ["uuid", "name", "summary", "labels", "attributes", "created_at", "valid_at", "invalid_at"]


def _attributes(**values):
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _node(df, kind, key, label, name, summary, attributes, valid_at=None, invalid_at=None):
    missing = F.lit(None).cast("timestamp")
    return df.select(
        F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("uuid"),
        name.alias("name"),
        summary.alias("summary"),
        F.array(F.lit("Entity"), F.lit(label)).alias("labels"),
        attributes.alias("attributes"),
        (valid_at if valid_at is not None else missing).alias("created_at"),
        (valid_at if valid_at is not None else missing).alias("valid_at"),
        (invalid_at if invalid_at is not None else missing).alias("invalid_at"),
    )


def star_nodes(spark, sf):
    """Customers are persons, suppliers organisations, nations and regions places, parts products, orders events."""
    t = lambda name: table(spark, sf, name)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    frames = [
        _node(t("customer"), "customer", "c_custkey", "PER", F.col("c_name"),
              text(F.col("c_mktsegment"), " customer"), _attributes(segment=F.col("c_mktsegment"))),
        _node(t("supplier"), "supplier", "s_suppkey", "ORG", F.col("s_name"),
              text("Supplier company in nation ", F.col("s_nationkey")), _attributes(nation=F.col("s_nationkey"))),
        _node(t("nation"), "nation", "n_nationkey", "LOC", F.col("n_name"),
              text("Nation of region ", F.col("n_regionkey")), _attributes(region=F.col("n_regionkey"))),
        _node(t("region"), "region", "r_regionkey", "LOC", F.col("r_name"), text("Region ", F.col("r_name")), _attributes(kind=F.lit("region"))),
        _node(t("part"), "part", "p_partkey", "PRODUCT", F.initcap("p_name"),
              text(F.col("p_type"), " part of ", F.col("p_brand")), _attributes(size=F.col("p_size"), kind=F.col("p_type"))),
        _node(t("orders"), "order", "o_orderkey", "EVENT", text("Order ", F.col("o_orderkey")),
              text("Order with priority ", F.col("o_orderpriority"), " and status ", F.col("o_orderstatus"), " Placed On ", day),
              F.when(F.col("o_orderstatus") == "P", _attributes(date=day)).otherwise(_attributes(priority=F.col("o_orderpriority"))),
              F.col("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("interval 400 days"))),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def star_edges(spark, sf):
    t = lambda name: table(spark, sf, name)
    ref = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    edge = lambda df, src, dst, rel: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel_type"))
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return (
        edge(t("customer"), ref("customer", "c_custkey"), ref("nation", "c_nationkey"), "LOCATED_IN")
        .unionByName(edge(t("supplier"), ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), "LOCATED_IN"))
        .unionByName(edge(t("nation"), ref("nation", "n_nationkey"), ref("region", "n_regionkey"), "PART_OF"))
        .unionByName(edge(t("orders"), ref("customer", "o_custkey"), ref("order", "o_orderkey"), "PART_OF"))
        .unionByName(edge(items, ref("order", "l_orderkey"), ref("part", "l_partkey"), "CONTAINS"))
        .unionByName(edge(items, ref("order", "l_orderkey"), ref("supplier", "l_suppkey"), "SUPPLIED_BY"))
    )


NODES_SQL = """node as (
      select 'customer:' || c_custkey as uuid, c_name as name, c_mktsegment || ' customer' as summary, 'PER' as label, [c_mktsegment] as attrs, null as date_attr, cast(null as timestamp) as valid_at, cast(null as timestamp) as invalid_at from customer
      union all select 'supplier:' || s_suppkey, s_name, 'Supplier company in nation ' || s_nationkey, 'ORG', [cast(s_nationkey as varchar)], null, null, null from supplier
      union all select 'nation:' || n_nationkey, n_name, 'Nation of region ' || n_regionkey, 'LOC', [cast(n_regionkey as varchar)], null, null, null from nation
      union all select 'region:' || r_regionkey, r_name, 'Region ' || r_name, 'LOC', ['region'], null, null, null from region
      union all select 'part:' || p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' '),
        p_type || ' part of ' || p_brand, 'PRODUCT', [cast(p_size as varchar), p_type], null, null, null from part
      union all select 'order:' || o_orderkey, 'Order ' || o_orderkey,
        'Order with priority ' || o_orderpriority || ' and status ' || o_orderstatus || ' Placed On ' || strftime(o_orderdate, '%Y-%m-%d'), 'EVENT',
        case when o_orderstatus = 'P' then [strftime(o_orderdate, '%Y-%m-%d')] else [o_orderpriority] end,
        case when o_orderstatus = 'P' then strftime(o_orderdate, '%Y-%m-%d') end,
        o_orderdate, case when o_orderstatus = 'F' then o_orderdate + interval 400 day end from orders
    )"""
EDGES_SQL = """edge as (
      select 'customer:' || c_custkey as src, 'nation:' || c_nationkey as dst, 'LOCATED_IN' as rel_type from customer
      union all select 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'LOCATED_IN' from supplier
      union all select 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PART_OF' from nation
      union all select 'customer:' || o_custkey, 'order:' || o_orderkey, 'PART_OF' from orders
      union all select 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' from lineitem
      union all select 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' from lineitem
    ),
    ends as (select src as uuid, dst as other, rel_type from edge union all select dst, src, rel_type from edge where src <> dst)"""
STAR = f"{NODES_SQL}, {EDGES_SQL}"


@query("graph_degree", f"with {STAR} select uuid, count(other) as degree from node left join ends using (uuid) group by uuid")
def degree(spark, sf):
    return G.degree(star_nodes(spark, sf), star_edges(spark, sf))


@query(
    "graph_neighbours",
    f"""with {STAR}, pair as (select distinct uuid, other from ends)
    select pair.uuid, other as neighbour, name, 'Entity|' || label as labels, label as type from pair join node on node.uuid = other""",
)
def neighbours(spark, sf):
    rows = G.neighbours(star_nodes(spark, sf), star_edges(spark, sf))
    return rows.withColumn("labels", F.array_join("labels", "|"))


@query(
    "graph_rel_types",
    f"""with {STAR} select uuid, array_to_string(list(distinct rel_type order by rel_type), ',') as relationship_types from ends group by uuid""",
)
def rel_types(spark, sf):
    rows = G.relationship_types(star_edges(spark, sf))
    return rows.withColumn("relationship_types", F.array_join("relationship_types", ","))


@query(
    "graph_temporal",
    f"""with {STAR}, dated as (select distinct ends.uuid, node.valid_at as d from ends join node on node.uuid = other
      where rel_type = 'PART_OF' and starts_with(other, 'order:'))
    select uuid, strftime(valid_at, '%Y-%m-%d') as valid_at, strftime(invalid_at, '%Y-%m-%d') as invalid_at, strftime(d, '%Y-%m-%d') as episode_date
    from node left join dated using (uuid)""",
)
def temporal(spark, sf):
    nodes = star_nodes(spark, sf)
    orders = nodes.where(F.col("uuid").startswith("order:")).select("uuid", "valid_at")
    rows = G.temporal(nodes, star_edges(spark, sf), orders)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return rows.select("uuid", day("valid_at"), day("invalid_at"), day("episode_date"))


@query("graph_stats", f"with {STAR} select (select count(*) from node) as nodes, (select count(*) from edge) as relationships")
def stats(spark, sf):
    return G.stats(star_nodes(spark, sf), star_edges(spark, sf))


def document_episodes(spark, sf):
    return documents(spark, sf, "source").select(
        F.col("doc_id").alias("episode_id"), F.col("text").alias("content"),
        F.date_add(F.lit("2000-01-01").cast("date"), F.col("doc_id").cast("int")).cast("timestamp").alias("reference_time"),
    )


EPISODE_GRAPH = f"""{sentence_cte('documents', 'doc_id', 'text')}, {mention_cte('documents', 'doc_id', 'text')},
    placed as (select m.doc_id, m.text, m.type, m.start, m.stop, m.pass, s.idx, sha256(lower(m.text) || '|' || m.type) as id
      from mention m join sent s on s.doc_id = m.doc_id and m.start >= s.start and m.start < s.stop),
    following as (select *, lead(id) over (partition by doc_id, idx order by start, stop, pass) as next_id from placed),
    linked as (
      select id as src, 'episode:' || doc_id as dst, 'PART_OF' as rel_type from placed
      union select id, next_id, 'CO_MENTION' from following where next_id is not null and next_id <> id
    )"""


@query("graph_build", f"with {EPISODE_GRAPH} select * from linked")
def build(spark, sf):
    return G.build(document_episodes(spark, sf))[1]


EPISODE_NODES = f"""with {EPISODE_GRAPH}
    select id as uuid, arg_min(text, row(doc_id::varchar, idx, pass, start)) as name, 'Entity|' || min(type) as labels, strftime(to_timestamp(946684800 + min(doc_id) * 86400) at time zone 'UTC', '%Y-%m-%d') as valid_at
    from placed group by id
    union all select 'episode:' || doc_id, 'Episode ' || doc_id, 'Episodic', strftime(to_timestamp(946684800 + doc_id * 86400) at time zone 'UTC', '%Y-%m-%d') from documents"""


@query("graph_build_nodes", EPISODE_NODES)
def build_nodes(spark, sf):
    return _shown(G.build(document_episodes(spark, sf))[0])


def _shown(nodes):
    day = F.ltrim(F.date_format("valid_at", "yyyy-MM-dd"), F.lit("+"))  # years of five digits bear a sign
    return nodes.select("uuid", "name", F.array_join("labels", "|").alias("labels"), day.alias("valid_at"))


def streamed_graph(spark, sf):
    """Episodes of the documents arriving in three lots, one of them twice; the stream restarts for each and the store is merged in between."""
    arrivals, folder, state = (scratch_path(spark, name) for name in ("graph-arrivals", "graph-store", "graph-state"))
    episodes, lot = document_episodes(spark, sf), F.pmod(F.col("episode_id"), F.lit(3))
    store = GraphStore(spark, folder)
    for lots in ([0], [1, 0], [2]):
        with shuffles_dropped(spark):
            episodes.filter(lot.isin(lots)).repartition(4, "episode_id").write.mode("append").json(arrivals)
        keep_up(spark, arrivals, folder, state, multi_line=False).awaitTermination()
        if lots == [1, 0]:
            store.compact()
    return store


@query("graph_upkeep", f"with {EPISODE_GRAPH} select * from linked")
def upkeep_edges(spark, sf):
    return streamed_graph(spark, sf).read()[1]


@query("graph_upkeep_nodes", EPISODE_NODES)
def upkeep_nodes(spark, sf):
    return _shown(streamed_graph(spark, sf).read()[0])


@query("graph_write", f"with {STAR} select rel_type, count(*) as edges, count(distinct src) as sources from edge group by rel_type")
def write(spark, sf):
    """The star graph written as tables, edges laid out by type, and read back."""
    folder = scratch_path(spark, "graph")
    nodes, edges = star_nodes(spark, sf), star_edges(spark, sf)
    G.write(nodes, edges, folder)
    _, stored = G.read(spark, folder, nodes.schema)
    return stored.groupBy("rel_type").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("src").alias("sources"))


@query(
    "graph_clear",
    f"with {STAR} select (select count(*) from node) as nodes, (select count(*) from edge) as relationships, 0 as remaining",
)
def clear(spark, sf):
    folder = scratch_path(spark, "graph")
    nodes, edges = star_nodes(spark, sf), star_edges(spark, sf)
    G.write(nodes, edges, folder)
    report = G.clear(spark, folder, nodes.schema)
    return spark.createDataFrame([(report["nodes"], report["relationships"], report["remaining"])], "nodes long, relationships long, remaining int")
