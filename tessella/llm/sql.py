"""DuckDB SQL for the queries that SQL can express."""

_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION_SQL = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS k, least(len(w), 10) AS m
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format('text')} AS w FROM documents
), sizes AS (
  SELECT DISTINCT m FROM windows
), places AS (
  SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, sizes WHERE len(w) >= m)
), hits AS (
  SELECT rid, i, places.m, item FROM places JOIN windows ON places.k = windows.k AND places.m = windows.m
), hit_words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


def _uniform(name: str) -> str:
    return f"((CAST('0x' || substr(md5(k || '|{name}'), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


def _draw(children: list[tuple[str, int, str]]) -> str:
    if len(children) == 1:
        return children[0][2]
    draws = [f"(-ln({_uniform(name)}) / {float(weight)})" for name, weight, _ in children]
    least = f"least({', '.join(draws)})"
    cases = " ".join(f"WHEN {d} = {least} THEN {outcome}" for d, (_, _, outcome) in zip(draws, children))
    return f"CASE {cases} END"


def _descend(tree: dict) -> str:
    regions = []
    for region, racks in tree.items():
        below = [(rack, len(s), _draw([(f"shard{x}", 1, str(x)) for x in s])) for rack, s in racks.items()]
        regions.append((region, sum(len(s) for s in racks.values()), _draw(below)))
    return _draw(regions)


def sharding_sql(tree: dict, grown: dict) -> str:
    """CRC-32 by the reflected polynomial 0xEDB88320, bit by bit in a table of 256."""
    return f"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8
), docs AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, coalesce(text, '') AS text FROM documents
), bytes AS (
  SELECT doc_id, k, octet_length(encode(text)) + 1 AS size, lower(hex(encode(text))) AS h FROM docs
), placed AS (
  SELECT doc_id, k, size, h, {_descend(tree)} AS shard, {_descend(grown)} AS grown_shard, {_uniform('slot')} AS u FROM bytes
)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  CAST(xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) / 2 AS BIGINT)),
      lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS BIGINT) AS text_crc32,
  'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY u, doc_id) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM placed, crc_table
"""


LANGUAGE_MODEL_SQL = """
WITH good AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), docs AS (
  SELECT row_number() OVER () AS rid, d.doc_id, lower(hex(encode(coalesce(text, '')))) AS h, good.doc_id IS NOT NULL AS target
  FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id
), bytes AS (
  SELECT rid, target, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS b
  FROM (SELECT rid, target, h, unnest(range(CAST(length(h) / 2 AS BIGINT))) AS i FROM docs)
), classes AS (
  SELECT rid, target, i, CASE
    WHEN b BETWEEN 65 AND 90 THEN b - 65 WHEN b BETWEEN 97 AND 122 THEN b - 97 WHEN b BETWEEN 48 AND 57 THEN 26
    WHEN b IN (32, 9, 10, 13) THEN 27 WHEN b IN (33, 46, 63) THEN 28 WHEN b < 128 THEN 29
    WHEN b < 192 THEN 31 ELSE 30 END AS d
  FROM bytes
), grams AS (
  SELECT rid, target, d, lag(d, 1, 27) OVER w AS c, lag(d, 2, 27) OVER w AS b, lag(d, 3, 27) OVER w AS a
  FROM classes WINDOW w AS (PARTITION BY rid ORDER BY i)
), n4 AS (
  SELECT a, b, c, d, count(*) AS bg, count(*) FILTER (target) AS tg FROM grams GROUP BY ALL
), n1 AS (
  SELECT d, (bg + 1.0) / (sum(bg) OVER () + 32) AS pb, (tg + 1.0) / (sum(tg) OVER () + 32) AS pt
  FROM (SELECT d, sum(bg) AS bg, sum(tg) AS tg FROM n4 GROUP BY d)
), n2 AS (
  SELECT c, d, (g.bg + 32 * pb) / (sum(g.bg) OVER w + 32) AS pb, (g.tg + 32 * pt) / (sum(g.tg) OVER w + 32) AS pt
  FROM (SELECT c, d, sum(bg) AS bg, sum(tg) AS tg FROM n4 GROUP BY ALL) g JOIN n1 USING (d) WINDOW w AS (PARTITION BY c)
), n3 AS (
  SELECT b, c, d, (g.bg + 32 * pb) / (sum(g.bg) OVER w + 32) AS pb, (g.tg + 32 * pt) / (sum(g.tg) OVER w + 32) AS pt
  FROM (SELECT b, c, d, sum(bg) AS bg, sum(tg) AS tg FROM n4 GROUP BY ALL) g JOIN n2 USING (c, d) WINDOW w AS (PARTITION BY b, c)
), loss AS (
  SELECT a, b, c, d, -ln((g.bg + 32 * pb) / (sum(g.bg) OVER w + 32)) AS lb, -ln((g.tg + 32 * pt) / (sum(g.tg) OVER w + 32)) AS lt
  FROM n4 g JOIN n3 USING (b, c, d) WINDOW w AS (PARTITION BY a, b, c)
), totals AS (
  SELECT rid, count(*) AS n, sum(lt) AS t, sum(lb) AS b FROM grams JOIN loss USING (a, b, c, d) GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(coalesce(t / n, 0), 6) AS target_loss,
  round(coalesce(b / n, 0), 6) AS background_loss, round(coalesce((t - b) / n, 0), 6) AS score
FROM docs LEFT JOIN totals USING (rid)
"""


WORD_MODEL_SQL = f"""
WITH good AS (
  SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), docs AS (
  SELECT row_number() OVER () AS rid, d.doc_id, {_WORDS.format('text')} AS w, good.doc_id IS NOT NULL AS target
  FROM documents d LEFT JOIN good ON d.doc_id = good.doc_id
), tokens AS (
  SELECT rid, target, unnest(list_concat([' start'], w)) AS a, unnest(list_concat(w, [' end'])) AS b FROM docs WHERE len(w) > 0
), n1 AS (
  SELECT b, count(*) AS bg, count(*) FILTER (target) AS tg FROM tokens GROUP BY b
), totals AS (
  SELECT sum(bg) AS bg, sum(tg) AS tg FROM n1
), p1 AS (
  SELECT b, n1.bg, n1.tg, (n1.bg + 32 * n1.bg / totals.bg) / (totals.bg + 32) AS pb, (n1.tg + 32 * n1.bg / totals.bg) / (totals.tg + 32) AS pt
  FROM n1, totals
), n2 AS (
  SELECT a, b, count(*) AS bg, count(*) FILTER (target) AS tg FROM tokens GROUP BY a, b
), loss AS (
  SELECT n2.a, n2.b, -ln((n2.bg + 32 * p1.pb) / (before.bg + 32)) AS lb, -ln((n2.tg + 32 * p1.pt) / (before.tg + 32)) AS lt
  FROM n2 JOIN p1 ON n2.b = p1.b JOIN n1 before ON before.b = CASE WHEN n2.a = ' start' THEN ' end' ELSE n2.a END
), sums AS (
  SELECT rid, count(*) AS n, sum(lt) AS t, sum(lb) AS b FROM tokens JOIN loss USING (a, b) GROUP BY rid
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(coalesce(t / n, 0), 6) AS target_loss,
  round(coalesce(b / n, 0), 6) AS background_loss, round(coalesce((t - b) / n, 0), 6) AS score
FROM docs LEFT JOIN sums USING (rid)
"""


def _crc32(hexed: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits, with the table ``t`` of the 256 steps."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length({hexed}) / 2 AS BIGINT)),
      lambda i: CAST('0x' || substr({hexed}, 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""


CONVERSATION_TRIE_SQL = f"""
WITH RECURSIVE steps(b, c, n) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n + 1 FROM steps WHERE n < 8
), crc_table AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM steps WHERE n = 8
), said AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, left(x, 64), sha256(length(r) || ':' || r || x)) AS turns
  FROM said GROUP BY conv_id
), drawn AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base, {_crc32("lower(hex(encode(CAST(conv_id AS VARCHAR))))")} % 4 AS h FROM own, crc_table
), rebuilt AS (
  SELECT d.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[1:d.h] END, d.turns[d.h + 1:]) AS turns
  FROM drawn d LEFT JOIN own b ON b.conv_id = d.base
), passed AS (
  SELECT conv_id, turns[1:d] AS path, d = len(turns) AS ended FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '') AS ends
  FROM passed GROUP BY path
), sized AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(path[-1].x, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM nodes LEFT JOIN (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1) c USING (path)
), below AS (
  SELECT path[1:d] AS path, sum(saved) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT path, saved, n_children, unnest(range(depth + 1)) AS d FROM sized) GROUP BY 1
)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(s.n_convs AS BIGINT) AS n_convs,
  CAST(s.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(s.ends) AS ends_sha256
FROM sized s JOIN below USING (path) LEFT JOIN nodes p ON s.depth > 0 AND p.path = s.path[1:s.depth - 1]
"""


def _nearest(books: str) -> str:
    distance = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in range(4))
    return f"SELECT p, rid, min(({distance}) * 64 + e) AS k FROM cut JOIN {books} USING (p) GROUP BY p, rid"


def _moved(books: str, nearest: str) -> str:
    means = ", ".join(f"CAST(floor(sum(x{i}) / count(*)) AS BIGINT) AS m{i}" for i in range(4))
    entry = ", ".join(f"coalesce(m{i}, c{i}) AS c{i}" for i in range(4))
    return f"SELECT p, e, {entry} FROM {books} LEFT JOIN (SELECT p, k % 64 AS e, {means} FROM {nearest} JOIN cut USING (p, rid) GROUP BY ALL) USING (p, e)"


#: For vectors of 64 components.
VECTOR_CODES_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS rid, vec_id, label, v FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x) AND abs(x) < 262144)) = 64)
), cut AS MATERIALIZED (
  SELECT rid, p, {", ".join(f"v[4 * p + {i + 1}] AS x{i}" for i in range(4))} FROM kept, range(16) r(p)
), books0 AS MATERIALIZED (
  SELECT p, rid AS e, {", ".join(f"x{i} AS c{i}" for i in range(4))} FROM cut WHERE rid < 64
), nearest0 AS MATERIALIZED ({_nearest("books0")}
), books1 AS MATERIALIZED ({_moved("books0", "nearest0")}
), nearest1 AS MATERIALIZED ({_nearest("books1")}
), books2 AS MATERIALIZED ({_moved("books1", "nearest1")}
), nearest2 AS MATERIALIZED ({_nearest("books2")}
), coded AS (
  SELECT rid, string_agg(printf('%02x', k % 64), '' ORDER BY p) AS code, CAST(sum(k // 64) AS BIGINT) AS error FROM nearest2 GROUP BY rid
), digest AS (
  SELECT sha256(string_agg(concat_ws(',', c0, c1, c2, c3), ',' ORDER BY p, e)) AS d FROM books2
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256
FROM kept JOIN coded USING (rid), digest
"""
