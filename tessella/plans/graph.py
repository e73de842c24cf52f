"""Graph queries: events are versions of edges from a user to an event type, orders of nodes."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.plans.common import r6, table

# Which event types are known relations here.
RELATIONS = ("click", "purchase", "signup", "view")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("bigint").alias("target"), F.col("event_type").alias("relation"),
        "ts", "event_id", r6("value").alias("weight"),
    )


def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = G.edges_allowed(_edges(spark, sf_dir), RELATIONS)
    return G.upsert(good, ["source", "target", "relation"], ["ts", "event_id"])


def refused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = G.edges_allowed(_edges(spark, sf_dir), RELATIONS)
    return bad.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "event_id", F.col("event_type").alias("status"))
    return G.upsert(nodes, ["id"], ["ts", "event_id"])


def recent_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the 24 newest nodes, at most 38 (the view's size)."""
    edges = G.upsert(_edges(spark, sf_dir), ["source", "target"], ["ts", "event_id"])
    _, inside = G.induced_subgraph(node_upsert(spark, sf_dir), edges.select("source", "target", "first_seen"), 24, 38)
    return inside


def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, their lines as sources of four kinds; one order in eleven calls itself a demonstration."""
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.element_at(F.array(*map(F.lit, G.SOURCE_KINDS)), (n % 4 + 1).cast("int"))
    category = F.when(part % 5 == 0, G.DEMO).when(part % 5 == 1, G.USER).when(part % 5 == 2, G.REAL).when(part % 5 == 3, F.concat(F.lit("LEVEL"), part % 3))
    sources = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("kind"), category.alias("category"), F.when(part % 3 != 2, part % 3 == 1).alias("demo"))
    sessions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 11 == 4).alias("demo"))
    found = G.provenance(sources, sessions, "l_orderkey")
    return found.withColumns({c: F.array_join(c, ",") for c in G.SOURCE_KINDS.values()})


def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers as parts of a system."""
    balance = F.col("s_acctbal")
    state = F.when(balance < 0, "down").when(balance < 2000, "limited").otherwise("up")
    parts = table(spark, sf_dir, "supplier").select("s_nationkey", state.alias("state"), balance.cast("double").alias("latency"))
    return G.component_status(parts, "s_nationkey").withColumn("latency", r6("latency"))


def report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested report: for each order priority, sums over its orders' lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("double")).alias("q"), F.count_if(F.col("l_returnflag") == "A").alias("accepted")
    )
    joined = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), r6(F.sum("q")).alias("quantity"), F.sum(F.coalesce("accepted", F.lit(0).cast("bigint"))).alias("accepted")
    )


def last_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-value lines where the last assignment of a key wins."""
    pairs = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("name"), "value", "event_id")
    return pairs.groupBy("name").agg(F.max(F.struct("event_id", "value"))["value"].alias("value"))


def priority_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status, one column a priority class."""
    first = F.substring("o_orderpriority", 1, 1)
    counts = [F.count_if(first == str(i)).alias(f"p{i}") for i in range(1, 6)]
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*counts)


_EDGES = """WITH e AS (
  SELECT user_id AS source, CAST(props ->> '$.k' AS BIGINT) AS target, event_type AS relation, ts, event_id, round(value, 6) AS weight FROM events
)
"""
_RELATIONS = ", ".join(f"'{r}'" for r in RELATIONS)
QUERIES = {
    f.__name__: f
    for f in (
        graph_upsert, refused_edges, node_upsert, recent_subgraph, category_rollup, status_rollup, report_rollup, last_assignment, priority_kinds,
    )
}
SQL = {
    "graph_upsert": _EDGES + f"""SELECT source, target, relation, weight, first_seen FROM (SELECT *, row_number() OVER (w ORDER BY ts DESC, event_id DESC) AS k,
      first_value(event_id) OVER (w ORDER BY ts, event_id) AS first_seen FROM e WHERE relation IN ({_RELATIONS}) WINDOW w AS (PARTITION BY source, target, relation)) WHERE k = 1""",
    "refused_edges": _EDGES + f"SELECT relation, count(*) AS n FROM e WHERE relation NOT IN ({_RELATIONS}) GROUP BY relation",
    "node_upsert": """SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, arg_min(event_id, (ts, event_id)) AS first_seen FROM events GROUP BY user_id""",
    "recent_subgraph": _EDGES + """, n AS (
      SELECT source AS id, arg_min(event_id, (ts, event_id)) AS first_seen FROM e GROUP BY source ORDER BY first_seen DESC, source DESC LIMIT 24
    ) SELECT source, target, first_seen FROM (SELECT source, target, arg_min(event_id, (ts, event_id)) AS first_seen FROM e GROUP BY ALL)
      WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) ORDER BY first_seen DESC, source DESC, target DESC LIMIT 38""",
    "category_rollup": """WITH s AS (
      SELECT l_orderkey, ['raw', 'instrument', 'knowledge', 'model'][l_linenumber % 4 + 1] AS kind, l_partkey % 3 = 0 AS measured,
        CASE l_partkey % 5 WHEN 0 THEN 'DEMO/SYNTHETIC' WHEN 1 THEN 'USER_UPLOAD' WHEN 2 THEN 'REAL_INSTRUMENT' WHEN 3 THEN 'LEVEL' || l_partkey % 3 ELSE 'UNKNOWN' END AS c FROM lineitem
    ), g AS (
      SELECT o_orderkey AS l_orderkey, coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (kind = 'raw'), '') AS raw_input_categories,
        coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (kind = 'instrument'), '') AS instrument_result_categories,
        coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (kind = 'knowledge'), '') AS knowledge_data_levels,
        coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (kind = 'model'), '') AS model_execution_modes,
        o_orderkey % 11 = 4 OR coalesce(bool_or(kind IN ('instrument', 'knowledge') AND c = 'DEMO/SYNTHETIC'), false) AS contains_demo_synthetic,
        coalesce(bool_or(kind = 'raw' AND c = 'USER_UPLOAD'), false) AS contains_user_upload,
        coalesce(bool_or(kind = 'instrument' AND c = 'REAL_INSTRUMENT' AND measured), false) AS contains_real_instrument_data
      FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY o_orderkey
    ) SELECT *, CASE WHEN contains_demo_synthetic AND contains_user_upload THEN 'MIXED/DEMO-SYNTHETIC' WHEN contains_demo_synthetic THEN 'DEMO/SYNTHETIC' ELSE 'USER_OR_INSTRUMENT_DATA/UNVERIFIED' END AS overall,
      CASE WHEN contains_demo_synthetic THEN 'WORKFLOW_VALIDATION_ONLY' ELSE 'SCIENTIFIC_REVIEW_REQUIRED' END AS workflow_use FROM g""",
    "status_rollup": """SELECT s_nationkey, CASE WHEN bool_and(s_acctbal < 0) THEN 'offline' WHEN bool_or(s_acctbal < 2000) THEN 'degraded' ELSE 'online' END AS state,
      round(max(CAST(s_acctbal AS DOUBLE)), 6) AS latency FROM supplier GROUP BY s_nationkey""",
    "report_rollup": """SELECT o_orderpriority, count(*) AS n_orders, round(sum(q), 6) AS quantity, CAST(sum(coalesce(a, 0)) AS BIGINT) AS accepted FROM orders LEFT JOIN
      (SELECT l_orderkey, sum(CAST(l_quantity AS DOUBLE)) AS q, count(*) FILTER (l_returnflag = 'A') AS a FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1""",
    "last_assignment": "SELECT props ->> '$.k' AS name, arg_max(value, event_id) AS value FROM events GROUP BY 1",
    "priority_kinds": "SELECT o_orderstatus, " + ", ".join(f"count(*) FILTER (o_orderpriority LIKE '{i}%') AS p{i}" for i in range(1, 6)) + " FROM orders GROUP BY 1",
}
