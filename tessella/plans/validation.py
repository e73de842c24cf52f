"""Validation queries over the driver's tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import validation as V
from tessella.plans.common import r6, table

# Four more keys of a line.
DUPLICATE_KEYS = {
    "supplier": ("l_orderkey", "l_suppkey"), "flags": ("l_orderkey", "l_returnflag", "l_linestatus"), "amount": ("l_partkey", "l_quantity"),
    "place": ("l_suppkey", "l_linenumber", "l_quantity"),
}
COUNTABLE = ["FRONT", "BACK", "LEFT", "RIGHT", "TOP", "BASE"]


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws("-", "l_orderkey", "l_linenumber")
    part = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    more = {name: F.concat_ws("-", *columns) for name, columns in DUPLICATE_KEYS.items()}
    return V.duplicate_keys(table(spark, sf_dir, "lineitem"), {"line": line, "part": part, **more})


def orphan_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without a document, and lines without an order, counted."""
    labels = V.orphans(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents"), "doc_id")
    lines = V.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", table(spark, sf_dir, "orders"), "o_orderkey")
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in (("label", labels), ("line", lines))]
    return counts[0].union(counts[1])


def contiguous_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose number isn't that of lines before them in the order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber").cast("bigint") - 1).alias("position")).distinct()
    return V.position_gaps(lines, "l_orderkey", "position")


def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every conversation's turns joined in order: chunks give back their text."""
    return V.joined_digest(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def countable_angle_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.functions.texts import canonical_angle
    from tessella.plans.retrieval import views

    seen = views(spark, sf_dir).withColumn("angle", canonical_angle(F.col("angle")))
    return V.required_angles(seen, "object_id", "angle", COUNTABLE, 6).select("object_id", "n_views", "n_angles")


def object_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects with their lines as views; what is wrong follows from the key."""
    o = F.col("o_orderkey")
    kind = F.when(o % 4 == 1, "COUNTERFEIT").when(o % 61 == 5, None).otherwise("REFERENCE")
    content = F.concat_ws("|", o.cast("string"), "o_orderstatus")
    objects = table(spark, sf_dir, "orders").select(
        o.alias("key_id"), kind.alias("kind"), F.when((o % 4 == 1) | (o % 23 == 7), "COUNTERFEIT").otherwise("AUTHENTIC").alias("status"), F.when((o % 4 == 1) & (o % 3 != 0), "p").alias("profile"),
        F.when(o % 19 == 2, "short").when(o % 19 == 3, F.sha2(o.cast("string"), 256)).otherwise(F.sha2(content, 256)).alias("record_sha256"), content.alias("content"),
    )
    angle = F.element_at(F.array(*map(F.lit, (*COUNTABLE[:4], "DETAIL", "MARK"))), (F.col("l_partkey") % 6 + 1).cast("int"))
    found = V.object_violations(objects, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key_id"), angle.alias("angle")), "key_id", F.col("content"), list(COUNTABLE), 3)
    return found.withColumnRenamed("key_id", "o_orderkey")


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessella.plans.retrieval import views

    return views(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n_views"), F.count_distinct("object_id").alias("n_objects"))


def entry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of documents as entries; damage of each kind is planted."""
    i = F.col("doc_id")
    text = F.when(i % 37 == 1, F.concat("text", F.lit("\x07"))).when(i % 47 == 2, F.lit(None)).when(i % 53 == 3, "").otherwise(F.col("text"))
    source = F.when(i % 43 == 4, F.concat(F.lit(" "), "source")).otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents").withColumns({"text": text, "source": source})
    rules = {
        "has_text": F.length("text") > 0,
        "length_as_stated": F.length("text") == F.col("n_chars"),
        "safe_text": ~F.regexp_replace("text", r"[\n\t\r]", "").rlike(V.CONTROLS),
        "source_identifier": F.col("source").rlike(V.IDENTIFIER),
        "digest": F.sha2("text", 256).rlike(V.SHA256),
    }
    return V.violations(docs, F.col("doc_id"), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def interval_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped within a window after their order: order date up to 60 days later."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.date_add("o_orderdate", 60).alias("until"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    inside = V.within(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"), F.col("until"))
    return lines.groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def review_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as reviews: what breaks which rule."""
    orders = table(spark, sf_dir, "orders")
    uses = F.split(F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "")), " ")
    rules = V.review_rules(
        F.col("o_orderdate").cast("date"), F.lit("1997-12-31").cast("date"), uses, "high", "low", F.col("o_orderstatus") == "P"
    )
    return V.violations(orders, F.col("o_orderkey"), rules).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def run_length_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as runs of samples: quantity times line number, in ticks of a thousandth."""
    found = V.run_lengths(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", "l_linenumber", 1000.0)
    ok = V.agree(F.col("seconds"), F.lit(2.0), 0.5, 0.05)
    return found.select("l_suppkey", "samples", r6("seconds").alias("seconds"), r6("rate").alias("rate"), ok.alias("agrees"))


def latest_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max(F.struct("conv_id", "turn", F.sha2("text", 256).alias("h")))
    rows = table(spark, sf_dir, "conversations").groupBy("role").agg(newest.alias("m"))
    return rows.select("role", "m.conv_id", "m.turn", F.col("m.h").alias("digest"))


def detected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page bodies by first bytes, most of them with those of a media type put before them."""
    marks = F.array(*map(F.lit, ("89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "000000186674797069736F6D", "504B0304", "25504446", "")))
    content = F.unhex(F.concat(F.element_at(marks, (F.col("page_id") % 7 + 1).cast("int")), F.hex(F.left("html", F.lit(8)))))
    kind = F.coalesce(V.detected_type(content), F.lit("unknown"))
    return table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a model's answers: fenced, bare, amid prose, or without an object."""
    i = F.col("conv_id") + F.col("turn")
    body = F.to_json(F.struct(F.col("turn").alias("a"), F.struct(F.col("conv_id").alias("c")).alias("b")))
    answer = F.when(i % 4 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` done {"))).when(i % 4 == 1, body)
    answer = answer.when(i % 4 == 2, F.concat(F.lit("here "), body, F.lit(" it is"))).otherwise("no object")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(V.fenced_json(answer), F.lit("")).alias("json"))


QUERIES = {
    f.__name__: f
    for f in (
        duplicate_keys, orphan_refs, contiguous_positions, chunk_text, countable_angle_rule, object_rules, kind_counts, entry_rules, interval_rule, review_rule,
        run_length_table, latest_by_role, detected_types, answer_json,
    )
}
_ANGLES = ", ".join(f"'{a}'" for a in COUNTABLE)


def _views_sql() -> str:
    from tessella.plans.retrieval import HITS_SQL

    return HITS_SQL


SQL = {
    "duplicate_keys": """SELECT 'line' AS rule, concat_ws('-', l_orderkey, l_linenumber) AS value, count(*) AS n FROM lineitem GROUP BY 2 HAVING count(*) > 1
      UNION ALL SELECT 'part', concat_ws('-', l_orderkey, l_partkey, l_suppkey), count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1"""
    + "".join(f" UNION ALL SELECT '{name}', concat_ws('-', {', '.join(columns)}), count(*) FROM lineitem GROUP BY 2 HAVING count(*) > 1" for name, columns in DUPLICATE_KEYS.items()),
    "orphan_refs": """SELECT 'label' AS rule, count(*) AS n FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)
      UNION ALL SELECT 'line', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)""",
    "contiguous_positions": """SELECT l_orderkey, position, expected FROM (SELECT l_orderkey, position, row_number() OVER (PARTITION BY l_orderkey ORDER BY position) - 1
      AS expected FROM (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) - 1 AS position FROM lineitem)) WHERE position <> expected""",
    "chunk_text": "SELECT conv_id, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, text)) AS digest FROM conversations GROUP BY conv_id",
    "countable_angle_rule": _views_sql() + f"""SELECT object_id, count(*) AS n_views, count(DISTINCT angle) FILTER (angle IN ({_ANGLES})) AS n_angles FROM views GROUP BY object_id
      HAVING count(*) < 6 OR count(DISTINCT angle) FILTER (angle IN ({_ANGLES})) < 6""",
    "object_rules": """WITH v AS (
      SELECT l_orderkey, count(*) AS n, count(DISTINCT l_partkey % 6) FILTER (l_partkey % 6 < 4) AS a FROM lineitem GROUP BY 1
    ), o AS (
      SELECT o_orderkey AS k, coalesce(n, 0) AS n, coalesce(a, 0) AS a, CASE WHEN o_orderkey % 4 = 1 THEN 'COUNTERFEIT' WHEN o_orderkey % 61 = 5 THEN NULL ELSE 'REFERENCE' END AS kind
      FROM orders LEFT JOIN v ON l_orderkey = o_orderkey
    ) SELECT k AS o_orderkey, unnest(list_filter([CASE WHEN kind IS NULL THEN 'kind' END, CASE WHEN kind IS NULL OR (kind = 'REFERENCE' AND k % 23 = 7) THEN 'authenticity_status' END,
      CASE WHEN kind IS NULL OR (kind = 'COUNTERFEIT' AND k % 3 = 0) THEN 'counterfeit_profile' END, CASE WHEN n < 3 THEN 'images' END, CASE WHEN a < 3 THEN 'angles' END,
      CASE WHEN k % 19 = 2 THEN 'record_sha256' END, CASE WHEN k % 19 = 3 THEN 'record_digest' END], lambda x: x IS NOT NULL)) AS rule FROM o""",
    "kind_counts": _views_sql() + "SELECT kind, count(*) AS n_views, count(DISTINCT object_id) AS n_objects FROM views GROUP BY kind",
    "entry_rules": r"""WITH d AS (
      SELECT CASE WHEN doc_id % 37 = 1 THEN text || chr(7) WHEN doc_id % 47 = 2 THEN NULL WHEN doc_id % 53 = 3 THEN '' ELSE text END AS text, n_chars,
        CASE WHEN doc_id % 43 = 4 THEN ' ' || source ELSE source END AS source FROM documents
    ) SELECT rule, count(*) AS n FROM (
      SELECT 'has_text' AS rule FROM d WHERE NOT coalesce(length(text) > 0, false)
      UNION ALL SELECT 'length_as_stated' FROM d WHERE NOT coalesce(length(text) = n_chars, false)
      UNION ALL SELECT 'safe_text' FROM d WHERE NOT coalesce(NOT regexp_matches(regexp_replace(text, '[\n\t\r]', '', 'g'), '[\p{Cc}\p{Cf}]'), false)
      UNION ALL SELECT 'source_identifier' FROM d WHERE NOT coalesce(regexp_matches(source, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$'), false)
      UNION ALL SELECT 'digest' FROM d WHERE text IS NULL) GROUP BY rule""",
    "interval_rule": """SELECT CAST(l_shipdate AS DATE) BETWEEN CAST(o_orderdate AS DATE) AND CAST(o_orderdate AS DATE) + 60 AS inside, count(*) AS n
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "review_rule": """SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT CAST(o_orderdate AS DATE) <= DATE '1997-12-31' THEN 'reviewed_in_time' END,
      CASE WHEN NOT list_contains(u, 'high') THEN 'required_use' END, CASE WHEN list_contains(u, 'low') THEN 'no_opposite_use' END,
      CASE WHEN o_orderstatus = 'P' THEN 'undisputed' END], lambda x: x IS NOT NULL)) AS rule
      FROM (SELECT *, string_split(lower(regexp_replace(o_orderpriority, '^[0-9]-', '')), ' ') AS u FROM orders)) GROUP BY rule""",
    "run_length_table": """SELECT l_suppkey, samples, round(ticks / 1000.0, 6) AS seconds, round(samples / (ticks / 1000.0), 6) AS rate,
      abs(ticks / 1000.0 - 2.0) <= greatest(0.5, greatest(ticks / 1000.0, 2.0) * 0.05) AS agrees FROM (SELECT l_suppkey,
      CAST(sum(l_quantity) AS BIGINT) AS samples, CAST(sum(l_quantity * l_linenumber) AS BIGINT) AS ticks FROM lineitem GROUP BY l_suppkey)""",
    "latest_by_role": """SELECT role, conv_id, turn, sha256(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS k
      FROM conversations) WHERE k = 1""",
    "detected_types": """SELECT ['image/png', 'image/jpeg', 'image/webp', 'video/mp4', 'application/zip', 'application/pdf', 'unknown'][page_id % 7 + 1] AS kind, count(*) AS n
      FROM pages GROUP BY 1""",
    "answer_json": """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 4 = 3 THEN '' ELSE '{"a":' || turn || ',"b":{"c":' || conv_id || '}}' END AS json FROM conversations""",
}
