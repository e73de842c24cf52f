"""Queries of hybrid search over ``documents``; policies follow from the id by fixed rules."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.texts import (
    count_matches,
    hash_sign,
    hash_slot,
    has_control,
    normal_text,
    tokens,
    unsafe_path,
)
from tessella.operators import models as M
from tessella.operators import search as S
from tessella.operators.ranges import running
from tessella.plans.common import r6, table
from tessella.sources.shared import materialise

QUERY = "the license of this work and the version 2.0 the"
ATTRIBUTES = {"material": ["Ceramic "], "region": "north", "note": ["license"]}
MINIMUM, LIMIT, HIGH_MINIMUM = 0.05, 50, 0.5
VERSION = "2025.1"
# Texts in several scripts, the Han extension block from U+3400 among them.
SCRIPTS = ("\u3400\u3401 \u4e2d\u6587x-1 v2.0.b ", "\u4dbf\u4dc0\u4dc1 abc", "\u9fff\u9fffa_b ", "\u65e5\u672c\u306e Caf\u00e9 \u4e2d", "")
VISUAL = [0.1, 0.9, 0.3, 0.7, 0.5, 0.2, 0.8, 0.4]
DAY = "2025-03-01"
LICENSES = ("CC-BY", "CC0", "MIT", "PROPRIETARY")
# Fixed values of these queries: phrases that a generated statement may not hold.
FORBIDDEN = ("all rights reserved", r"licensed under (the )?(cc|apache|gnu)", "idiot|moron", r"\b\d{3}-\d{2}-\d{4}\b")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (i % 700).cast("int"))
    kinds = F.array(*[F.array(*map(F.lit, k)) for k in (["*"], ["ceramic", "glass"], ["bronze"], ["ceramic"], ["jade", "wood"], ["*"])])
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("space"),
        F.when(i % 5 == 0, F.array(F.lit("staff"))).otherwise(F.array(F.lit("staff"), F.lit("public"))).alias("access_scopes"),
        F.when(i % 11 == 0, F.array(F.lit("display"))).otherwise(F.array(F.lit("display"), F.lit("research"))).alias("purposes"),
        F.element_at(F.array(*map(F.lit, LICENSES)), (i % 4 + 1).cast("int")).alias("license"),
        F.when(i % 13 != 0, start).alias("valid_from"),
        F.when(i % 17 != 0, F.date_add(start, 400)).alias("valid_until"),
        F.concat(F.lit("Entry of "), "source").alias("title"),
        F.create_map(
            F.lit("materials"), F.element_at(kinds, (i % 6 + 1).cast("int")), F.lit("regions"), F.when(i % 9 == 0, F.array(F.lit("South"))).when(i % 4 == 3, F.array(F.lit("\u3000North\xa0"), F.lit("east"))).otherwise(F.array(F.lit(" North"), F.lit("east"))),
            F.lit("tags"), F.when(i % 19 == 0, F.array(F.lit("LICENSE"))).otherwise(F.array().cast("array<string>")),
        ).alias("scope"),
        F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (i * k % 97) / 97.0).alias("features"),
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = S.policy_reason("en", "public", "research", ["CC-BY", "CC0", "MIT"], DAY, ATTRIBUTES)
    return entries(spark, sf_dir).withColumn("reason", reason)


def policy_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("reason is not null").select("doc_id", "reason")


def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("ELIGIBLE")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = _judged(spark, sf_dir).where("reason is null")
    return S.inverse_frequencies(eligible).withColumn("idf", r6("idf"))


def lexical_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = _judged(spark, sf_dir).where("reason is null")
    return S.lexical_scores(eligible, QUERY).select("doc_id", r6("lexical").alias("lexical"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero dimensions of each document's embedding."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.embed(F.col("text"))).alias("dim", "x"))
    return rows.where("x <> 0").select("doc_id", "dim", r6("x").alias("x"))


def model_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts embedded by a model that can't do every fifth length and gives vectors of other lengths; its vectors are checked."""

    def embed(texts: list[str]) -> list:
        return [None if len(t) % 5 == 0 else [1.0 if i == len(t) % 96 else 0.0 for i in range(96)] if len(t) % 3 else [2.0] + [0.0] * (95 - len(t) % 2) for t in texts]

    found = M.embed_texts(table(spark, sf_dir, "benchmark"), embed)
    problem = M.unit_problem(F.col("embedding.vector"), 96)
    return found.select("item_id", "embedding.provider", "embedding.degraded_reason", F.size("embedding.vector").alias("n"), problem.alias("problem"))


def token_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and sign of every distinct benchmark token, by SQL expressions alone."""
    t = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", hash_slot(F.col("token")).alias("slot"), hash_sign(F.col("token")).alias("sign"))


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("reason is null")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.scored_entries(_eligible(spark, sf_dir), QUERY, ATTRIBUTES, VISUAL)


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores have eight places; of the six shown, halves go up."""
    found = S.best_entries(_scored(spark, sf_dir), MINIMUM, LIMIT)
    return found.select(
        "rank", "doc_id", r6(F.col("score") + 1e-9).alias("score"), r6("text_score").alias("text_score"), "structured", "visual",
        F.array_join("matched_on", ",").alias("matched_on"),
    )


def search_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries refused by policy or, as fewer than the limit pass a high minimum, by score."""
    by_policy = _judged(spark, sf_dir).where("reason is not null").select("doc_id", "reason")
    return by_policy.union(S.below_minimum(_scored(spark, sf_dir), HIGH_MINIMUM, LIMIT))


def search_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of the results, and stated ones held against them: every third has another version, every fourth another space."""
    found = S.best_entries(_scored(spark, sf_dir), MINIMUM, LIMIT)
    allowed = materialise(S.citations(found, _eligible(spark, sf_dir), VERSION), "citations")
    stated = allowed.withColumn("version", F.when(F.col("doc_id") % 3 == 0, "2024.9").otherwise(F.col("version")))
    stated = stated.withColumn("space", F.when(F.col("doc_id") % 4 != 0, F.col("space")))
    return S.check_citations(stated, allowed).select("doc_id", "chunk_id", "version", "content_sha256", "accepted")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' whole texts, each after one of the texts in other scripts."""
    before = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("doc_id") % len(SCRIPTS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", before.alias("before"), F.coalesce("text", F.lit("")).alias("whole"))


def script_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han (U+3400 to U+9FFF) and Latin letters of each document, and the Han share."""
    han, latin = count_matches(F.col("text"), "[\u3400-\u9fff]"), count_matches(F.col("text"), "[A-Za-z]")
    return _scripts(spark, sf_dir).select("doc_id", F.concat("before", "whole").alias("text")).select("doc_id", han.alias("han"), latin.alias("latin"), r6(F.round(han / F.greatest(han + latin, F.lit(1)), 4)).alias("han_share"))


def script_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the same texts' beginnings over all documents, with slot and sign."""
    begun = F.concat("before", F.substring("whole", 1, 60))
    t = _scripts(spark, sf_dir).select(F.explode(tokens(begun)).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("n")).select("token", "n", hash_slot(F.col("token")).alias("slot"), hash_sign(F.col("token")).alias("sign"))


def guardrail_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with forbidden wording, after a literal mark has been redacted; every seventh has ideographic blanks."""
    text = F.when(F.col("doc_id") % 7 == 3, F.regexp_replace("text", " ", "\u3000")).otherwise(F.col("text"))
    clean = F.regexp_replace(normal_text(text), "(?i)mit license", "[mark]")
    hits = F.array_compact(F.array(*[F.when(clean.rlike(p), F.lit(i)) for i, p in enumerate(FORBIDDEN)]))
    rows = table(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).where("size(hits) > 0")
    return rows.select("doc_id", F.concat_ws(",", F.col("hits").cast("array<string>")).alias("hits"))


def control_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", has_control(F.col("html")).alias("bad"), F.length(F.trim("html")).alias("n"))
    return rows.groupBy("bad").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("chars"))


def path_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths against allow and deny rules, with unsafe forms marked."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?]*)?", 1)
    rel = F.regexp_replace(path, "^/", "")
    verdict = F.when(unsafe_path(rel), "UNSAFE").when(rel.rlike(r"(^|/)(admin|private)(/|$)"), "DENIED")
    verdict = verdict.when(rel.rlike(r"^(en|fr)/"), "ALLOWED").otherwise("UNLISTED")
    return table(spark, sf_dir, "pages").select("page_id", rel.alias("path"), verdict.alias("verdict"))


def private_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, and whether they are loopback, private, or under .internal or .local."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1))
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)|\.(internal|local)$")
    return table(spark, sf_dir, "pages").groupBy(host.alias("host"), private.alias("private")).agg(F.count(F.lit(1)).alias("pages"))


def citation_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five citations of each role, once per (role, source), and whether they are complete."""
    docs = table(spark, sf_dir, "documents").select("source", F.col("lang").alias("role"), F.struct("doc_id", F.col("n_chars").isNotNull().alias("sized")).alias("d"))
    once = docs.groupBy("role", "source").agg(F.min("d").alias("d")).select("role", "source", "d.*")
    top = running(materialise(once, "once"), ["role"], ["doc_id"], number="k").where("k <= 5")
    return top.select("role", F.col("k").alias("position"), "doc_id", "source", F.when(F.col("sized"), "COMPLETE").otherwise("INCOMPLETE").alias("state"))


# Of a text's normal form: first the Latin tokens, then of every Han run its characters and its pairs.
_TOKENS = """list_concat(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9\u0131\u017f]+(?:[-_.][a-z0-9\u0131\u017f]+)*'),
  flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '[\u3400-\u4dbf\u4e00-\u9fff]+'), lambda r:
    list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"""
_SLOT = "CAST(CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 96 AS INTEGER)"
_SIGN = "CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END"
_LIST = lambda items: "[" + ", ".join(f"'{i}'" for i in items) + "]"
ENTRIES_SQL = f"""
WITH entries AS (
  SELECT doc_id, text, lang AS space, doc_id % 5 <> 0 AS public, doc_id % 11 <> 0 AS research,
    {_LIST(LICENSES)}[doc_id % 4 + 1] AS license,
    CASE WHEN doc_id % 13 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) END AS valid_from,
    CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 700 AS INTEGER) + 400 END AS valid_until,
    [['*'], ['ceramic', 'glass'], ['bronze'], ['ceramic'], ['jade', 'wood'], ['*']][doc_id % 6 + 1] AS allowed,
    'Entry of ' || source AS title, CASE WHEN doc_id % 9 = 0 THEN ['south'] ELSE ['north', 'east'] END AS regions,
    CASE WHEN doc_id % 19 = 0 THEN ['license'] ELSE [] END AS tags,
    list_transform(range(1, 9), lambda k: (doc_id * k % 97) / 97.0) AS features
  FROM documents
), judged AS (
  SELECT *, CASE WHEN space <> 'en' THEN 'KNOWLEDGE_SPACE_MISMATCH' WHEN NOT public THEN 'ACCESS_SCOPE_MISMATCH' WHEN NOT research THEN 'PURPOSE_NOT_LICENSED'
    WHEN license NOT IN ('CC-BY', 'CC0', 'MIT') THEN 'LICENSE_NOT_ALLOWLISTED'
    WHEN valid_from > DATE '{DAY}' OR valid_until < DATE '{DAY}' THEN 'LICENSE_NOT_ACTIVE'
    WHEN NOT (list_contains(allowed, '*') OR list_contains(allowed, 'ceramic')) OR NOT list_contains(regions, 'north') THEN 'APPLICABILITY_SCOPE_MISMATCH' END AS reason
  FROM entries
), eligible AS (
  SELECT *, {_TOKENS.format('text')} AS toks, {_TOKENS.format("title || chr(10) || coalesce(text, '')")} AS all_toks FROM judged WHERE reason IS NULL
)
"""
_SCRIPTS = f"SELECT doc_id, {_LIST(SCRIPTS)}[doc_id % {len(SCRIPTS)} + 1] || left(coalesce(text, ''), 60) AS text FROM documents"
_WHOLE_SCRIPTS = f"SELECT doc_id, {_LIST(SCRIPTS)}[doc_id % {len(SCRIPTS)} + 1] || coalesce(text, '') AS text FROM documents"
# The blanks of Unicode, as this engine writes them.
_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_Q = S.python_tokens(QUERY)
_LEX = """
, asked AS (
  SELECT token, count(*) AS c FROM (SELECT unnest([QUERY]) AS token) GROUP BY 1
), idf AS (
  SELECT token, c, ln(((SELECT count(*) FROM eligible) + 1) / ((SELECT count(*) FROM eligible WHERE list_contains([TOKS], token)) + 1)) + 1 AS idf FROM asked
), lex AS (
  SELECT doc_id, sum(least(len(list_filter([TOKS], lambda x: x = token)), c) * idf) / sum(c * idf) AS lexical FROM eligible, idf GROUP BY doc_id
)
""".replace("[QUERY]", _LIST(_Q))
_QV = [float(x) for x in S.hashed_vector(QUERY)]
_SCORED = ENTRIES_SQL + _LEX.replace("[TOKS]", "all_toks") + f"""
, tok AS (
  SELECT doc_id, unnest(all_toks) AS token FROM eligible
), vec AS (
  SELECT doc_id, {_SLOT} AS dim, sum({_SIGN}) AS x FROM tok GROUP BY 1, 2
), emb AS (
  SELECT doc_id, greatest(0, least(1, sum(x * {_QV}[dim + 1]) / sqrt(sum(x * x)))) AS e FROM vec GROUP BY 1
), comp AS (
  SELECT l.doc_id, round(0.65 * lexical + 0.35 * coalesce(e, 0), 6) AS text_score,
    round(((CASE WHEN list_contains(known, 'ceramic') THEN 1.0 WHEN contains(t, 'ceramic') THEN 0.7 ELSE 0.0 END)
      + (CASE WHEN list_contains(known, 'north') THEN 1.0 WHEN contains(t, 'north') THEN 0.7 ELSE 0.0 END)
      + (CASE WHEN list_contains(known, 'license') THEN 1.0 WHEN contains(t, 'license') THEN 0.7 ELSE 0.0 END)) / 3, 6) AS structured,
    round(greatest(0, least(1, 1 - sqrt(list_sum(list_transform(range(1, 9), lambda k: pow({VISUAL}[k] - features[k], 2)))) / sqrt(8))), 6) AS visual
  FROM lex l JOIN (SELECT *, list_concat(allowed, list_concat(regions, tags)) AS known,
    trim(regexp_replace(lower(coalesce(text, '') || ' ' || title), '{_BLANKS}', ' ', 'g')) AS t FROM eligible) USING (doc_id) LEFT JOIN emb USING (doc_id)
), fused AS (
  SELECT *, round(0.45 * text_score + 0.25 * structured + 0.30 * visual, 8) AS score FROM comp
), results AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM fused WHERE score >= {MINIMUM} QUALIFY rank <= {LIMIT}
)
"""
QUERIES = {
    f.__name__: f
    for f in (
        policy_exclusions, policy_summary, token_idf, lexical_score, hash_embedding, model_embeddings, token_slots, script_tokens, hybrid_search, search_rejects,
        search_citations, script_mix, guardrail_hits, control_text, path_policy, private_endpoints, citation_top5,
    )
}
SQL = {
    "policy_exclusions": ENTRIES_SQL + "SELECT doc_id, reason FROM judged WHERE reason IS NOT NULL",
    "policy_summary": ENTRIES_SQL + "SELECT coalesce(reason, 'ELIGIBLE') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "token_idf": ENTRIES_SQL + """SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM eligible) + 1) / (count(*) + 1)) + 1, 6) AS idf
      FROM (SELECT doc_id, unnest(list_distinct(toks)) AS token FROM eligible) GROUP BY token""",
    "lexical_score": ENTRIES_SQL + _LEX.replace("[TOKS]", "toks") + "SELECT doc_id, round(lexical, 6) AS lexical FROM lex",
    "hash_embedding": f"""WITH t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents),
      s AS (SELECT doc_id, {_SLOT} AS dim, sum({_SIGN}) AS x FROM t GROUP BY 1, 2)
      SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS x FROM s WHERE x <> 0""",
    "model_embeddings": """SELECT item_id, CASE WHEN n % 5 = 0 THEN 'hashed' ELSE 'model' END AS provider, CASE WHEN n % 5 = 0 THEN 'NO_VECTOR' END AS degraded_reason,
      CASE WHEN n % 5 <> 0 AND n % 3 = 0 AND n % 2 = 1 THEN 95 ELSE 96 END AS n, CASE WHEN n % 5 = 0 OR n % 3 <> 0 THEN NULL WHEN n % 2 = 1 THEN 'WRONG_DIMENSION' ELSE 'NOT_UNIT_LENGTH' END AS problem
      FROM (SELECT item_id, length(text) AS n FROM benchmark)""",
    "token_slots": f"SELECT DISTINCT token, {_SLOT} AS slot, {_SIGN} AS sign FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM benchmark)",
    "script_tokens": f"""SELECT token, count(*) AS n, {_SLOT} AS slot, {_SIGN} AS sign FROM (SELECT unnest({_TOKENS.format('text')}) AS token FROM ({_SCRIPTS})) GROUP BY token""",
    "hybrid_search": _SCORED + """SELECT rank, doc_id, round(score + 1e-9, 6) AS score, text_score, structured, visual,
      concat_ws(',', CASE WHEN text_score > 0 THEN 'text' END, CASE WHEN structured > 0 THEN 'structured' END, CASE WHEN visual > 0 THEN 'visual' END) AS matched_on
      FROM results""",
    "search_rejects": _SCORED + f"""SELECT doc_id, reason FROM judged WHERE reason IS NOT NULL
      UNION ALL SELECT doc_id, 'BELOW_MINIMUM_SCORE' FROM fused WHERE score < {HIGH_MINIMUM} AND (SELECT count(*) FROM fused WHERE score >= {HIGH_MINIMUM}) < {LIMIT}""",
    "search_citations": _SCORED + f"""SELECT doc_id, doc_id || '#0' AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN '2024.9' ELSE '{VERSION}' END AS version,
      sha256(coalesce(text, '')) AS content_sha256, doc_id % 3 <> 0 AND doc_id % 4 <> 0 AS accepted FROM results JOIN eligible USING (doc_id)""",
    "script_mix": f"""SELECT doc_id, han, latin, round(han / greatest(han + latin, 1), 4) AS han_share FROM (
      SELECT doc_id, length(text) - length(regexp_replace(text, '[\u3400-\u9fff]', '', 'g')) AS han, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS latin
      FROM ({_WHOLE_SCRIPTS}))""",
    "guardrail_hits": """SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(t, 'all rights reserved') THEN '0' END,
      CASE WHEN regexp_matches(t, 'licensed under (the )?(cc|apache|gnu)') THEN '1' END, CASE WHEN regexp_matches(t, 'idiot|moron') THEN '2' END,
      CASE WHEN regexp_matches(t, '\\b\\d{3}-\\d{2}-\\d{4}\\b') THEN '3' END) AS hits
      FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(CASE WHEN doc_id % 7 = 3 THEN replace(text, ' ', chr(12288)) ELSE text END), '""" + _BLANKS + """', ' ', 'g')), 'mit license', '[mark]', 'g') AS t FROM documents)
      WHERE regexp_matches(t, 'all rights reserved|licensed under (the )?(cc|apache|gnu)|idiot|moron|\\b\\d{3}-\\d{2}-\\d{4}\\b')""",
    "control_text": """SELECT regexp_matches(html, '[\\p{Cc}\\p{Cf}]') AS bad, count(*) AS pages, CAST(sum(length(trim(html))) AS BIGINT) AS chars FROM pages GROUP BY 1""",
    "path_policy": """SELECT page_id, p AS path, CASE WHEN regexp_matches(p, '^[/\\\\]|^[A-Za-z]:|(^|[/\\\\])\\.\\.([/\\\\]|$)|[\\x00-\\x1f\\x7f]') THEN 'UNSAFE'
      WHEN regexp_matches(p, '(^|/)(admin|private)(/|$)') THEN 'DENIED' WHEN regexp_matches(p, '^(en|fr)/') THEN 'ALLOWED' ELSE 'UNLISTED' END AS verdict
      FROM (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]*(/[^?]*)?', 1), '^/', '') AS p FROM pages)""",
    "private_endpoints": """SELECT host, regexp_matches(host, '^(localhost|127\\.|10\\.|192\\.168\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.)|\\.(internal|local)$') AS private,
      count(*) AS pages FROM (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host FROM pages) GROUP BY 1, 2""",
    "citation_top5": """WITH o AS (SELECT lang AS role, source, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2)
      SELECT role, row_number() OVER (PARTITION BY role ORDER BY doc_id) AS position, o.doc_id, o.source,
        CASE WHEN n_chars IS NULL THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state
      FROM o JOIN documents USING (doc_id) QUALIFY position <= 5""",
}
