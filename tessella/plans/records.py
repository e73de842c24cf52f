"""Queries of records, rules and manifests; what is wrong with them is planted by fixed rules on ids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.texts import canonical_angle, safe_file_name, sequence_hint, utc_time
from tessella.operators import jobs as J
from tessella.operators import records as R
from tessella.operators import validation as V
from tessella.operators.ranges import running
from tessella.plans.common import r6, table
from tessella.plans.retrieval import RAW_ANGLES
from tessella.sources.shared import new_path
from tessella.sources.versions import publish_version, read_versions

VIEW_CODES = ("FRONT", "BACK", "BASE")


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


def public_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as nested records, of which only some fields are public."""
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    nested = rows.select(
        "c_custkey", F.struct(F.col("c_name").alias("holder"), F.col("c_acctbal").alias("secret")).alias("rights"),
        F.struct(F.col("n_name").alias("institution"), F.col("n_regionkey").alias("internal")).alias("source"),
    )
    cited = F.concat(F.lit("REFERENCE:"), F.left(F.sha2("rights.holder", 256), F.lit(12)), F.lit(":"), F.col("c_custkey").cast("string"))
    public = R.project(nested, {"citation_id": cited, "rights": {"holder": "rights.holder"}, "source": {"institution": "source.institution"}})
    return public.select("citation_id", F.to_json("rights").alias("rights"), F.to_json("source").alias("source"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload names made of parts' names: the last part of a path, and the number in brackets."""
    p = F.col("p_partkey")
    path = F.concat(F.lit("C:\\dir/"), "p_name", F.when(p % 3 == 0, F.concat(F.lit(" ("), p.cast("string"), F.lit(").jpg"))).when(p % 3 == 1, F.lit("//")).otherwise(F.lit("\x00x.png")))
    return table(spark, sf_dir, "part").select("p_partkey", safe_file_name(path, 20).alias("name"), sequence_hint(path).alias("hint"))


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as texts, with a zone, without one, and broken."""
    i = F.col("event_id")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(text, F.when(i % 4 == 0, "Z").when(i % 4 == 1, "+02:00").when(i % 4 == 2, "").otherwise("x"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(utc_time(text)).alias("us"))


def canonical_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each supplier's fields as canonical JSON, whatever the order they came in."""
    names = ["s_name", "s_nationkey", "s_suppkey"]
    pairs = [F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in names]
    turned = F.when(F.col("s_suppkey") % 2 == 0, F.array(*pairs)).otherwise(F.reverse(F.array(*pairs)))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2(R.canonical_json(F.map_from_entries(turned)), 256).alias("digest"))


def json_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings at any depth of conversations' turns as JSON."""
    t = table(spark, sf_dir, "conversations").withColumn("short", F.left(F.col("text"), F.lit(20)))
    body = F.to_json(F.struct(F.col("role").alias("role"), F.array(F.struct(F.col("short").alias("a"), F.col("turn").alias("n")), F.struct(F.col("role").alias("a"), F.lit(1).alias("n"))).alias("list")))
    found = t.select("conv_id", "turn", F.posexplode(R.json_strings(body)).alias("position", "value"))
    return found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"), F.max("value").alias("greatest"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An answer for each conversation about its first three turns as captures; every rule is broken by some."""
    i = F.col("conv_id")
    shown = table(spark, sf_dir, "conversations").where("turn < 3")
    code = F.element_at(F.array(*map(F.lit, VIEW_CODES)), (F.col("turn") + 1).cast("int"))
    captures = shown.select(i.alias("answer_id"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("capture_id"), code.alias("view_code"))
    named = captures.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("capture_id", "view_code"))).alias("c"))  # three captures
    a = F.col("answer_id")
    seen = F.when(a % 7 == 1, F.slice("c", 2, 3)).otherwise(F.col("c"))
    text = F.when(a % 11 == 2, "\u3000\n").when(a % 11 == 3, F.repeat(F.lit("x"), 501)).when(a % 11 == 4, F.concat(F.lit("seen"), F.repeat(F.lit(" "), 497))).when(a % 11 == 5, "All  rights\u3000reserved").otherwise("seen")
    observations = F.transform(
        seen, lambda x: F.struct(x["capture_id"].alias("capture_id"), F.when((a % 13 == 4) & (x["capture_id"] == "c0"), "TOP").otherwise(x["view_code"]).alias("view_code"), text.alias("text"))
    )
    limits = F.when(a % 17 == 5, F.array(F.lit("same"), F.lit("same"))).when(a % 17 == 6, F.array_repeat(F.lit("y"), 33)).when(a % 17 == 7, F.array(F.lit("\xa0\u2003"))).when(a % 17 == 8, F.array(F.concat(F.lit("z"), F.repeat(F.lit(" "), 800)))).otherwise(F.array(F.lit("one")))
    issues = F.when(a % 19 == 7, F.array(F.struct(F.lit("c9").alias("capture_id"), F.lit("blurred").alias("issue")))).otherwise(F.array().cast("array<struct<capture_id:string,issue:string>>"))
    risk = F.when(a % 23 == 8, "NONE").otherwise("LOW")
    body = F.struct(observations.alias("observations"), F.array(F.lit("all")).alias("cross_view_observations"), limits.alias("limitations"), issues.alias("capture_issues"), risk.alias("ood_risk"))
    extra = F.struct(*[body[n].alias(n) for n in ("observations", "cross_view_observations", "limitations", "capture_issues", "ood_risk")], F.lit(1).alias("more"))
    whole = F.when(a % 29 == 9, F.to_json(extra)).otherwise(F.to_json(body))
    fourth = F.when(a % 31 == 10, F.regexp_replace(whole, '"view_code"', '"sure":true,"view_code"')).when(a % 31 == 11, F.replace(whole, F.lit('["all"]'), F.lit("[7]"))).otherwise(whole)
    answers = named.select("answer_id", fourth.alias("body"))
    return answers, captures


def answer_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.answer_violations(*_answers(spark, sf_dir), forbidden=("all rights reserved",))


def any_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders any of whose lines' model outputs was of high risk."""
    risk = F.when(F.col("l_discount") >= 0.09, "HIGH").when(F.col("l_discount") >= 0.05, "MEDIUM").otherwise("LOW")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(risk == "HIGH").alias("any_high"))


def citation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports that cite their lines' parts; allowed are those of the first two lines, and some citations are repeated or blank."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("part"))
    cited = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("part")).alias("c"))  # an order has at most seven lines
    o = F.col("l_orderkey")
    ids = F.when(o % 5 == 1, F.concat("c", F.slice("c", 1, 1))).when(o % 5 == 2, F.concat("c", F.array(F.lit("")))).otherwise(F.col("c"))
    reports = cited.select(o.alias("report_id"), ids.alias("citation_ids"))
    return R.citation_violations(reports, lines.where("l_linenumber <= 2").select(o.alias("report_id"), F.col("part").alias("citation_id")))


def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recognition requests, with some of the ids blank or repeated."""
    o = F.col("o_orderkey")
    n = (o % 7).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.when((o % 11 == 1) & (k == 1), F.lit(" ")).when((o % 13 == 2) & (k == 2), F.lit("a1")).otherwise(F.concat(F.lit("a"), k.cast("string")))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"), (o % 12).alias("top_k"))
    return V.violations(rows, F.col("o_orderkey"), R.recognition_request_rules())


def timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as videos of which frames were sent."""
    p = F.col("p_partkey")
    stamps = F.transform(F.sequence(F.lit(0), (p % 27).cast("int")), lambda k: F.when((p % 5 == 1) & (k == 1), F.lit(0)).otherwise(k * 40))
    rows = table(spark, sf_dir, "part").select("p_partkey", ((p % 30) * 40).alias("duration_ms"), stamps.alias("timestamps"))
    return V.violations(rows, F.col("p_partkey"), R.timeline_rules())


def picture_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pictures of a reference library."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    path = F.when(k % 9 == 1, F.concat(F.lit("/etc/"), k.cast("string"))).when(k % 9 == 2, "a/../b.png").otherwise(F.concat(F.lit("a/"), k.cast("string")))
    raw = F.element_at(F.array(*[F.lit(a) for a in RAW_ANGLES]), (k % len(RAW_ANGLES) + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        k.alias("key"), path.alias("path"), F.when(k % 10 == 3, F.lit("XYZ")).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"),
        F.when(k % 7 == 4, "image/gif").otherwise("image/png").alias("mime_type"), canonical_angle(raw).alias("angle"), F.col("l_shipdate").alias("captured_at"),
        F.lit("1998-06-01").cast("date").alias("issued_at"), (k % 500).alias("width"), (k % 400).alias("height"),
    )
    return V.violations(rows, F.col("key"), R.picture_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def verified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, named twice in a manifest; some are missing there and some have other digests."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), "text")
    digest = F.when(F.col("doc_id") % 9 == 1, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    manifest = docs.select("path", digest.alias("sha256"))
    files = docs.where("doc_id % 13 <> 5").select("path", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    return R.verify_files(manifest.union(manifest), files).select("path", "problem")


def manifest_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in two manifests, some in one only, some with other digests."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("path"))
    one = c.where("c_custkey % 17 <> 3").select("path", F.sha2("path", 256).alias("sha256"))
    other = c.where("c_custkey % 19 <> 4").select("path", F.when(F.col("c_custkey") % 23 == 5, F.lit("x")).otherwise(F.sha2("path", 256)).alias("sha256"))
    return R.manifests_agree(one, other)


def metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as records of measured rates; which rules each breaks."""
    s = F.col("s_suppkey")
    rate = lambda n: (s * n % 101) / 100.0
    far = rate(7)
    entry = lambda k, v: F.create_map(F.lit(k), v)
    rows = table(spark, sf_dir, "supplier").select(
        "s_suppkey", rate(3).alias("top1"), F.when(s % 3 == 0, rate(3)).otherwise(rate(5)).alias("top5"), F.when(s % 10 == 1, far + 1).otherwise(far).alias("far"), rate(11).alias("frr"),
        F.when(s % 4 == 0, far).otherwise(1 - far).alias("open_set_rejection"),
        F.when(s % 6 == 0, F.create_map().cast("map<string,double>")).otherwise(entry("FRONT", F.when(s % 6 == 1, -0.5).otherwise(0.5))).alias("per_view"),
        entry("queries", s % 5).alias("counts"), F.when(s % 8 == 0, "DRAFT").otherwise("CALIBRATED").alias("status"),
        entry("result", F.when(s % 9 == 0, "none").otherwise(F.sha2(s.cast("string"), 256))).alias("digests"),
        F.when(s % 7 == 0, entry("score", F.lit(0.5))).otherwise(F.create_map(F.lit("score"), F.lit(0.5), F.lit("margin"), F.lit(0.1))).alias("thresholds"),
        F.array(F.lit("score"), F.lit("margin")).alias("threshold_fields"),
    )
    return V.violations(rows, F.col("s_suppkey"), R.metric_rules())


def knowledge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries of two chunks; every rule is broken by some."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), "lang")
    source_id = F.when(i % 31 == 1, F.concat(F.lit("bad id "), i.cast("string"))).when(i % 37 == 2, F.lit("twice")).otherwise(F.concat(F.lit("s"), i.cast("string")))
    entries = docs.select(
        source_id.alias("source_id"), F.when(i % 41 == 3, " ").otherwise("t").alias("title"), "text", F.when(i % 43 == 4, F.lit("0")).otherwise(F.sha2("text", 256)).alias("content_sha256"),
        F.col("lang").alias("space"), F.when(i % 47 == 5, "2024/01/01").when(i % 2 == 0, "UNKNOWN").otherwise("2024-01-01").alias("published_at"),
        F.transform(F.sequence(F.lit(1), F.when(i % 53 == 6, 3).otherwise(8)), lambda k: F.when((i % 59 == 7) & (k == 2), F.lit(float("nan"))).otherwise(k / 8.0)).alias("vector"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.substring(F.col("text"), F.lit(1), half)
    second = F.concat(F.substring(F.col("text"), half + 1, F.length("text")), F.when(i % 61 == 8, "!").otherwise(""))
    parts = F.posexplode(F.array(first, second)).alias("position", "part")
    chunks = docs.where("doc_id % 67 <> 9").select("doc_id", source_id.alias("source_id"), parts)
    chunks = chunks.select("source_id", F.when(i % 71 == 10, F.col("position") + 1).otherwise(F.col("position")).alias("position"), F.col("part").alias("text"), F.when(i % 73 == 11, "0").otherwise(F.sha2("part", 256)).alias("chunk_sha256"))
    once = chunks.where("source_id <> 'twice'")
    return R.entry_violations(entries.where("source_id <> 'twice' or text <> ''"), once, 8, ["en", "fr", "de"])


def row_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders against bindings that lack some and name other parts for some."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supplier"))
    rows = lines.select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("bigint").alias("position"), "part", "supplier")
    k = F.col("order_key") + F.col("position")
    bound = rows.where(k % 29 != 1).withColumn("part", F.when(k % 31 == 2, F.col("part") + 1).otherwise(F.col("part"))).withColumn("supplier", F.when(k % 37 == 3, None).otherwise(F.col("supplier")))
    extra = rows.where("position = 1 and order_key % 41 = 4").withColumn("position", F.lit(99).cast("bigint"))
    return R.binding_violations(rows, bound.unionByName(extra), "order_key", ["part", "supplier"])


def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the first bytes of a media type by one rule, declared by another."""
    i = F.col("doc_id")
    marks = F.array(*map(F.lit, ("89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "000000186674797069736F6D", "00")))
    content = F.unhex(F.concat(F.element_at(marks, (i % 5 + 1).cast("int")), F.hex(F.left(F.coalesce("text", F.lit("")), F.lit(4)))))
    declared = F.element_at(F.array(*map(F.lit, ("image/png", "image/jpeg", "image/webp", "video/mp4"))), (F.floor(i / 3) % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", declared.alias("declared"), V.detected_type(content).alias("detected"))
    return rows.select("doc_id", "declared", "detected", R.type_problem(F.col("declared"), F.col("detected")).alias("problem"))


def adapter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as results of an adapter: what isn't valid is replaced by the worst case."""
    result = F.struct(F.col("l_quantity").cast("double").alias("load"), F.lit(True).alias("telemetry_valid"), F.lit("OK").alias("quality"))
    valid = F.col("l_quantity").between(5, 45) & (F.col("l_returnflag") != "R")
    held = R.conservative(result, valid, {"load": 100.0, "telemetry_valid": False, "quality": "REJECTED"})
    return table(spark, sf_dir, "lineitem").select(held.alias("r")).groupBy("r.quality", "r.telemetry_valid").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("r.load")).alias("load"))


def client_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as client jobs in every state."""
    o = F.col("o_orderkey")
    state = F.element_at(F.array(*map(F.lit, ("MODEL_UNAVAILABLE", "READY", "UPLOADING", "POLLING", "FAILED", "COMPLETED"))), (o % 6 + 1).cast("int"))
    message = F.when(o % 4 == 0, "HTTP 401 refused").when(o % 4 == 1, "HTTP 500")
    action = R.recovery(state, F.when(o % 5 < 3, o), message, o % 7 != 0)
    rows = table(spark, sf_dir, "orders").select(state.alias("state"), F.coalesce(action, F.lit("NONE")).alias("action"))
    return rows.groupBy("state", "action").agg(F.count(F.lit(1)).alias("n"))


def library_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as libraries of suppliers: the first thing each lacks."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if(F.col("s_acctbal") < 0).alias("negatives"), F.max("s_acctbal").cast("double").alias("most")
    )
    rows = table(spark, sf_dir, "nation").select("n_nationkey").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    code = R.readiness(
        (F.col("objects").isNotNull(), "METADATA_INDEX_MISSING"), ((F.col("objects") >= 2) & (F.col("negatives") >= 1), "LIBRARY_POLICY_MISMATCH"),
        (F.col("most") >= 4000, "VECTOR_INDEX_MISSING"), (F.col("most") >= 8000, "CALIBRATION_REQUIRED"),
    )
    return rows.select("n_nationkey", code.alias("readiness"))


def recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five items that came last to each user for the first time, newest first, of views and clicks."""
    seen = table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item"), "ts", "event_id")
    return R.latest_distinct(seen, "user_id", "item", ["ts", "event_id"], 5)


def round_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of each user as rounds of a plan."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return R.rounds(bought, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "round")


def canonical_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested states written in any order and with blanks: digests of their canonical form, and of it with an entry more in a nested list."""
    o, day = F.col("o_orderkey").cast("string"), F.col("o_orderdate").cast("string")
    text = F.concat(
        F.lit('{ "total" : {"b":[3, {"y":null,"x":"\\u00e9 '), o, F.lit('"}, []], "a": 1.50, "9":1'), o, F.lit('00000000000000000000},\n"id":'), o,
        F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit(', "audit":{"log": [{"on":"'), F.substring(day, 1, 10), F.lit('"}]}'))).otherwise(""), F.lit(', "b":true}'),
    )
    broken = F.when(F.col("o_orderkey") % 50 == 7, F.concat(text, F.lit(","))).when(F.col("o_orderkey") % 50 == 8, F.replace(text, F.lit("true"), F.lit("NaN"))).otherwise(text)
    item = F.concat(F.lit('{"seq" : '), o, F.lit("}"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", R.canonical_text(broken).alias("c"), R.with_appended(broken, ["audit", "log"], item).alias("a"))
    return rows.select("o_orderkey", F.sha2("c", 256).alias("canonical"), F.sha2("a", 256).alias("appended"))


def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical forms of the events' JSON column, with how often each occurs."""
    return table(spark, sf_dir, "events").groupBy(R.canonical_text(F.col("props")).alias("props")).agg(F.count(F.lit(1)).alias("n"))


def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in the canonical order of the whole table: source, then id."""
    return running(table(spark, sf_dir, "documents").select("doc_id", "source"), [], ["source", "doc_id"], number="place").select("doc_id", "place")


def record_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as one set of records, counted by kind and nation."""
    one = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("double").alias("balance"))
    other = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").alias("nation"))
    return one.unionByName(other).groupBy("kind", "nation").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("balance")).alias("balance"))


def grouped_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of each kind and object, with the least and the greatest id."""
    from tessella.plans.retrieval import views

    return views(spark, sf_dir).groupBy("kind", "object_id").agg(F.count(F.lit(1)).alias("n_views"), F.min("view_id").alias("first_view"), F.max("view_id").alias("last_view"))


def jobs_with_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines nested, in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    jobs = R.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", ["line", "part"], "captures")
    return jobs.select("o_orderkey", F.size("captures").cast("bigint").alias("n"), F.array_join(F.transform("captures", lambda c: c["part"].cast("string")), ",").alias("parts"))


def uncovered_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of whom no order is of the highest priority."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return V.orphans(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", urgent, "o_custkey")


def unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated document ids of which some don't exist, with what is known of the others."""
    stated = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 7 == 1, F.col("doc_id") + 1_000_000).otherwise(F.col("doc_id")).alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = stated.join(docs, "doc_id", "left")
    return joined.select("doc_id", "source", F.when(F.col("source").isNull(), "UNKNOWN_ID").otherwise("KNOWN").alias("verdict"))


def counts_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated counts of orders against those counted: some are stated wrong."""
    counted = J.with_counts(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "n_orders")
    stated = F.when(F.col("c_custkey") % 10 == 1, F.col("n_orders") + 1).otherwise(F.col("n_orders"))
    return counted.withColumn("stated", stated).where("stated <> n_orders").select("c_custkey", "n_orders", "stated")


def added_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions in a newer form."""
    newer = R.with_defaults(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), {"r_name": F.lit("x"), "attempts": F.lit(0), "mode": F.lit("standard")})
    return newer.select("r_regionkey", "r_name", "attempts", "mode")


def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as three versions of a table: narrow keys and no priority; then a priority; then wide keys and notes, of which some are null."""
    orders, path = table(spark, sf_dir, "orders"), new_path(spark, "versions")
    k = F.col("o_orderkey")
    narrow = [k.cast("int").alias("id"), (k % 1000).cast("smallint").alias("group"), (k % 64 / 4).cast("float").alias("price")]
    publish_version(orders.where(k % 3 == 0).select(*narrow), path, 1)
    publish_version(orders.where(k % 3 == 1).select(*narrow, F.col("o_orderpriority").alias("priority")), path, 2)
    wide = [k.cast("bigint").alias("id"), (k % 1000).cast("bigint").alias("group"), (k % 64 / 4).alias("price")]
    publish_version(orders.where(k % 3 == 2).select(*wide, F.col("o_orderpriority").alias("priority"), F.when(k % 5 == 0, "noted").alias("note")), path, 3)
    columns = {"id": ("bigint", None), "group": ("bigint", None), "price": ("double", None), "priority": ("string", F.lit("NONE")), "note": ("string", F.lit("old"))}
    return read_versions(spark, path, [1, 2, 3], columns)


def action_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a log of actions: each order reserves, claims and settles in turn."""
    k = F.col("l_linenumber").cast("bigint")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind")) for i, kind in enumerate(("reserve", "claim", "claim", "settle", "settle"))])).alias("s")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), k.alias("k"), "l_quantity", "l_returnflag", "l_partkey", steps)
    log = lines.select(
        "session", (F.col("k") * 10 + F.col("s.i")).alias("seq"), "s.kind", F.col("l_partkey").cast("string").alias("run"), (F.col("l_quantity") / 10.0).cast("double").alias("load"),
        (F.col("l_returnflag") != "A").alias("valid"),
    )
    return R.replay_actions(log, 12.0).select("session", "seq", "verdict", r6("used").alias("used"), r6("reserved").alias("reserved"), "locked")


QUERIES = {
    f.__name__: f
    for f in (
        point_lookup, public_records, file_names, utc_times, canonical_fields, canonical_states, canonical_props, json_strings, answer_rules, any_high_risk, citation_rules, request_bounds,
        timeline_bounds, picture_rules, verified_files, manifest_agreement, metric_records, knowledge_entries, row_bindings, declared_types, adapter_results,
        client_recovery, library_readiness, recent_items, round_numbers, canonical_order, record_union, grouped_views, jobs_with_captures, uncovered_objects,
        unknown_ids, counts_agree, added_columns, table_versions, action_replay,
    )
}
_ANGLES = ", ".join("NULL" if a is None else f"'{a}'" for a in RAW_ANGLES)


def _rules(rows: str, key: str, rules: dict[str, str]) -> str:
    """SQL for the rows (rule, key) of conditions that break a rule."""
    cases = ", ".join(f"CASE WHEN {broken} THEN '{name}' END" for name, broken in rules.items())
    return f"SELECT {key} AS key, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule FROM ({rows})"


SQL = {
    "point_lookup": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7",
    "public_records": """SELECT 'REFERENCE:' || substr(sha256(c_name), 1, 12) || ':' || c_custkey AS citation_id, '{"holder":"' || c_name || '"}' AS rights,
      '{"institution":"' || n_name || '"}' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "file_names": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(p_name || ' (' || p_partkey || ').jpg', 1, 20) WHEN 1 THEN substr(p_name, 1, 20)
      ELSE substr(p_name || 'x.png', 1, 20) END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS hint FROM part""",
    "utc_times": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN us WHEN 1 THEN us - 7200000000 END AS us FROM (SELECT event_id, epoch_us(date_trunc('second', ts)) AS us FROM events)",
    "canonical_fields": """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":"' || s_nationkey || '","s_suppkey":"' || s_suppkey || '"}') AS digest FROM supplier""",
    "canonical_states": """WITH t AS (
      SELECT o_orderkey, o_orderkey % 50 IN (7, 8) AS broken, CASE WHEN o_orderkey % 3 = 1 THEN '{"on":"' || strftime(o_orderdate, '%Y-%m-%d') || '"}' END AS entry,
        '"b":true,"id":' || o_orderkey || ',"total":{"9":1' || o_orderkey || '00000000000000000000,"a":1.5,"b":[3,{"x":"' || chr(233) || ' ' || o_orderkey || '","y":null},[]]}}' AS rest FROM orders
    ) SELECT o_orderkey, CASE WHEN NOT broken THEN sha256('{' || CASE WHEN entry IS NULL THEN '' ELSE '"audit":{"log":[' || entry || ']},' END || rest) END AS canonical,
      CASE WHEN NOT broken THEN sha256('{"audit":{"log":[' || CASE WHEN entry IS NULL THEN '' ELSE entry || ',' END || '{"seq":' || o_orderkey || '}]},' || rest) END AS appended FROM t""",
    "canonical_props": "SELECT '{\"k\":' || (props ->> '$.k') || '}' AS props, count(*) AS n FROM events GROUP BY 1",
    "table_versions": """SELECT CAST(k % 3 + 1 AS INTEGER) AS version, k AS id, k % 1000 AS "group", k % 64 / 4.0::DOUBLE AS price, CASE WHEN k % 3 = 0 THEN 'NONE' ELSE o_orderpriority END AS priority,
      CASE WHEN k % 3 < 2 THEN 'old' WHEN k % 5 = 0 THEN 'noted' END AS note FROM (SELECT o_orderkey AS k, o_orderpriority FROM orders)""",
    "json_strings": """SELECT conv_id, turn, CASE WHEN text IS NULL THEN 2 ELSE 3 END AS n, CAST(2 * length(role) + coalesce(length(substr(text, 1, 20)), 0) AS BIGINT) AS chars,
      greatest(role, coalesce(substr(text, 1, 20), role)) AS greatest FROM conversations""",
    "answer_rules": """WITH c AS (
      SELECT conv_id AS a, 'c' || turn AS cap, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE turn < 3
    ), o AS (
      SELECT *, row_number() OVER (PARTITION BY a ORDER BY cap) AS k FROM c
    ), seen AS (
      SELECT *, NOT (a % 7 = 1 AND k = 1) AS named FROM o
    ), s AS (
      SELECT a, count(*) FILTER (named) AS observed, bool_or(NOT named) AS missed, bool_or(named AND cap = 'c0') AS has_first FROM seen GROUP BY a
    ) SELECT a AS answer_id, unnest(list_filter([CASE WHEN a % 29 = 9 THEN 'fields' END, CASE WHEN a % 23 = 8 THEN 'ood_risk' END,
      CASE WHEN a % 17 = 6 THEN 'limitations_bounded' END, CASE WHEN a % 17 IN (5, 6) THEN 'limitations_unique' END,
      CASE WHEN a % 17 = 7 THEN 'limitations_texts' END, CASE WHEN a % 31 = 11 THEN 'cross_view_observations_texts' END,
      CASE WHEN a % 31 = 10 AND observed > 0 THEN 'observation_fields' END, CASE WHEN a % 11 = 5 AND observed > 0 THEN 'guard' END,
      CASE WHEN a % 11 IN (2, 3, 4) AND observed > 0 THEN 'observation_texts' END, CASE WHEN a % 13 = 4 AND has_first THEN 'observation_not_bound' END,
      CASE WHEN a % 19 = 7 THEN 'capture_issue_not_bound' END, CASE WHEN missed THEN 'capture_not_represented' END], lambda x: x IS NOT NULL)) AS rule FROM s""",
    "any_high_risk": "SELECT l_orderkey, bool_or(l_discount >= 0.09) AS any_high FROM lineitem GROUP BY 1",
    "citation_rules": """WITH p AS (
      SELECT l_orderkey AS o, CAST(l_partkey AS VARCHAR) AS c, bool_or(l_linenumber <= 2) AS ok FROM lineitem GROUP BY 1, 2
    ), f AS (
      SELECT *, row_number() OVER (PARTITION BY o ORDER BY c) AS k FROM p
    ) SELECT o AS report_id, 'NOT_ALLOWED' AS rule, c AS citation_id FROM f WHERE NOT ok UNION ALL SELECT o, 'REPEATED', c FROM f WHERE k = 1 AND o % 5 = 1
      UNION ALL SELECT o, 'BLANK', '' FROM f WHERE k = 1 AND o % 5 = 2""",
    "request_bounds": _rules(
        "SELECT o_orderkey AS o, o_orderkey % 7 AS n, o_orderkey % 12 AS t FROM orders", "o",
        {"id_count": "n = 0 OR n > 5", "ids_not_blank": "n >= 1 AND o % 11 = 1", "ids_unique": "n >= 2 AND o % 13 = 2 AND o % 11 <> 1", "top_k": "t < 1 OR t > 10"},
    ),
    "timeline_bounds": _rules(
        "SELECT p_partkey AS p, (p_partkey % 30) * 40 AS d, p_partkey % 27 AS m, p_partkey % 5 = 1 AND p_partkey % 27 >= 1 AS r FROM part", "p",
        {"duration": "d < 1", "frame_count": "m + 1 < 3 OR m + 1 > 24", "timestamps_unique": "r", "timestamps_in_video": "(CASE WHEN r AND m = 1 THEN 0 ELSE m * 40 END) > d"},
    ),
    "picture_rules": "SELECT rule, count(*) AS n FROM (" + _rules(
        f"SELECT *, [{_ANGLES}][k % {len(RAW_ANGLES)} + 1] AS a FROM (SELECT l_orderkey * 8 + l_linenumber AS k, l_shipdate FROM lineitem)", "k",
        {"path": "k % 9 IN (1, 2)", "sha256": "k % 10 = 3", "mime_type": "k % 7 = 4", "angle": "a IS NULL OR a = 'detail'", "captured_in_time": "CAST(l_shipdate AS DATE) > DATE '1998-06-01'",
         "width": "k % 500 < 32", "height": "k % 400 < 32"},
    ) + ") GROUP BY rule",
    "verified_files": "SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 13 = 5 THEN 'MISSING' WHEN doc_id % 9 = 1 THEN 'DIFFERENT' END AS problem FROM documents",
    "manifest_agreement": """SELECT 'c/' || c_custkey AS path, CASE WHEN c_custkey % 17 = 3 THEN 'NOT_IN_CHECKSUMS' WHEN c_custkey % 19 = 4 THEN 'NOT_IN_PROVENANCE' ELSE 'DIGESTS_DISAGREE' END AS problem
      FROM customer WHERE (c_custkey % 17 = 3) <> (c_custkey % 19 = 4) OR (c_custkey % 17 <> 3 AND c_custkey % 19 <> 4 AND c_custkey % 23 = 5)""",
    "metric_records": _rules(
        """SELECT *, CASE WHEN s % 10 = 1 THEN f + 1 ELSE f END AS far, CASE WHEN s % 4 = 0 THEN f ELSE 1 - f END AS rej FROM (
          SELECT s_suppkey AS s, (s_suppkey * 3 % 101) / 100.0 AS t1, CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey * 3 % 101) / 100.0 ELSE (s_suppkey * 5 % 101) / 100.0 END AS t5, (s_suppkey * 7 % 101) / 100.0 AS f FROM supplier)""", "s",
        {"far_in_unit": "far > 1", "top5_at_least_top1": "t5 < t1", "rejection_is_complement": "abs(rej - (1 - far)) > 1e-6", "per_view_present": "s % 6 = 0", "per_view_in_unit": "s % 6 = 1",
         "counts_positive": "s % 5 = 0", "calibrated": "s % 8 = 0", "digests": "s % 9 = 0", "thresholds_complete": "s % 7 = 0"},
    ),
    "knowledge_entries": """WITH d AS (
      SELECT doc_id AS i, coalesce(text, '') AS t, lang, doc_id % 31 <> 1 AND doc_id % 37 = 2 AS twice,
        CASE WHEN doc_id % 31 = 1 THEN 'bad id ' || doc_id WHEN doc_id % 37 = 2 THEN 'twice' ELSE 's' || doc_id END AS source_id FROM documents
    ), e AS (
      SELECT * FROM d WHERE NOT twice OR t <> ''
    ) SELECT source_id, unnest(list_filter([CASE WHEN i % 31 = 1 THEN 'source_id' END, CASE WHEN i % 41 = 3 THEN 'title' END, CASE WHEN i % 43 = 4 THEN 'digest' END,
        CASE WHEN lang NOT IN ('en', 'fr', 'de') OR lang IS NULL THEN 'space' END, CASE WHEN i % 47 = 5 THEN 'published_at' END, CASE WHEN i % 53 = 6 OR i % 59 = 7 THEN 'vector' END,
        CASE WHEN twice OR i % 67 = 9 THEN 'no_chunks' END, CASE WHEN NOT twice AND i % 67 <> 9 AND i % 71 = 10 THEN 'chunk_positions' END,
        CASE WHEN NOT twice AND i % 67 <> 9 AND i % 73 = 11 THEN 'chunk_digests' END, CASE WHEN NOT twice AND i % 67 <> 9 AND i % 61 = 8 THEN 'chunk_texts' END], lambda x: x IS NOT NULL)) AS rule FROM e
      UNION ALL SELECT source_id, 'repeated' FROM e GROUP BY source_id HAVING count(*) > 1""",
    "row_bindings": """WITH r AS (
      SELECT l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS position, l_orderkey + l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY ALL
    ) SELECT order_key, position, CASE WHEN k % 29 = 1 THEN 'NOT_BOUND' WHEN k % 31 = 2 THEN 'part_DIFFERS' ELSE 'supplier_DIFFERS' END AS rule FROM r WHERE k % 29 = 1 OR k % 31 = 2 OR k % 37 = 3
      UNION ALL SELECT order_key, 99, 'NO_ROW' FROM r WHERE position = 1 AND order_key % 41 = 4""",
    "declared_types": """SELECT doc_id, declared, detected, CASE WHEN detected IS NULL THEN 'UNSUPPORTED' WHEN declared <> detected THEN 'DECLARED_DIFFERS' END AS problem FROM (
      SELECT doc_id, ['image/png', 'image/jpeg', 'image/webp', 'video/mp4'][doc_id // 3 % 4 + 1] AS declared, ['image/png', 'image/jpeg', 'image/webp', 'video/mp4', NULL][doc_id % 5 + 1] AS detected FROM documents)""",
    "adapter_results": """SELECT CASE WHEN ok THEN 'OK' ELSE 'REJECTED' END AS quality, ok AS telemetry_valid, count(*) AS n, round(sum(CASE WHEN ok THEN l_quantity ELSE 100.0 END), 6) AS load
      FROM (SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, l_quantity BETWEEN 5 AND 45 AND l_returnflag <> 'R' AS ok FROM lineitem) GROUP BY ok""",
    "client_recovery": """SELECT state, CASE WHEN NOT whole THEN 'NONE' WHEN state = 'MODEL_UNAVAILABLE' AND known THEN 'SERVER_MODEL_RETRY' WHEN state IN ('READY', 'UPLOADING') AND NOT known THEN 'UPLOAD'
      WHEN state = 'POLLING' AND known THEN 'POLL' WHEN state = 'FAILED' AND setup THEN CASE WHEN known THEN 'POLL' ELSE 'UPLOAD' END ELSE 'NONE' END AS action, count(*) AS n FROM (
      SELECT ['MODEL_UNAVAILABLE', 'READY', 'UPLOADING', 'POLLING', 'FAILED', 'COMPLETED'][o_orderkey % 6 + 1] AS state, o_orderkey % 5 < 3 AS known, o_orderkey % 4 = 0 AS setup, o_orderkey % 7 <> 0 AS whole FROM orders) GROUP BY 1, 2""",
    "library_readiness": """SELECT n_nationkey, CASE WHEN count(s_suppkey) = 0 THEN 'METADATA_INDEX_MISSING' WHEN count(s_suppkey) < 2 OR count(*) FILTER (s_acctbal < 0) < 1 THEN 'LIBRARY_POLICY_MISMATCH'
      WHEN max(s_acctbal) < 4000 THEN 'VECTOR_INDEX_MISSING' WHEN max(s_acctbal) < 8000 THEN 'CALIBRATION_REQUIRED' ELSE 'READY' END AS readiness
      FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey""",
    "recent_items": """WITH f AS (
      SELECT user_id, CAST(props ->> '$.k' AS BIGINT) AS item, min((ts, event_id)) AS came FROM events WHERE event_type IN ('view', 'click') AND props ->> '$.k' IS NOT NULL GROUP BY 1, 2
    ) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY f.came DESC, item DESC) AS position, item FROM f QUALIFY position <= 5""",
    "round_numbers": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS round FROM events WHERE event_type = 'purchase'",
    "canonical_order": "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) AS place FROM documents",
    "record_union": """SELECT kind, nation, count(*) AS n, round(sum(balance), 6) AS balance FROM (SELECT 'customer' AS kind, c_nationkey AS nation, CAST(c_acctbal AS DOUBLE) AS balance FROM customer
      UNION ALL SELECT 'supplier', s_nationkey, CAST(s_acctbal AS DOUBLE) FROM supplier) GROUP BY 1, 2""",
    "grouped_views": """SELECT CASE WHEN label >= 8 THEN 'negative' ELSE 'catalog' END AS kind, CAST(label AS BIGINT) AS object_id, count(*) AS n_views, min(vec_id) AS first_view, max(vec_id) AS last_view
      FROM embeddings GROUP BY 1, 2""",
    "jobs_with_captures": """SELECT o_orderkey, count(l_orderkey) AS n, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey), '') AS parts
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""",
    "uncovered_objects": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "unknown_ids": """SELECT CASE WHEN l.doc_id % 7 = 1 THEN l.doc_id + 1000000 ELSE l.doc_id END AS doc_id, CASE WHEN l.doc_id % 7 <> 1 THEN d.source END AS source,
      CASE WHEN l.doc_id % 7 = 1 THEN 'UNKNOWN_ID' ELSE 'KNOWN' END AS verdict FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id""",
    "counts_agree": "SELECT c_custkey, n AS n_orders, n + 1 AS stated FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer) WHERE c_custkey % 10 = 1",
    "added_columns": "SELECT r_regionkey, r_name, 0 AS attempts, 'standard' AS mode FROM region",
}
