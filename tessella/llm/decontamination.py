"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Each benchmark item gives its windows of ``size`` consecutive words; an item of
fewer words, but not none, is one window. Patterns of one length share a table:
the shift table says how far the search may skip at a block of two words, the
suffix bucket of a block that ends a pattern holds the candidates, grouped by
their first word, and a direct comparison confirms an occurrence.
"""

import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.llm.common import bytes_udf, struct_array, words_of
from tessella.sources.shared import discard, materialise

WINDOW_WORDS = 10
#: Patterns searched in one pass; larger benchmarks take several passes.
BLOCK_PATTERNS = 200_000
RESULT = "struct<n_words:bigint,spans:array<struct<first:int,last:int>>,items:array<string>>"


def item_windows(text: bytes, size: int) -> list[bytes]:
    words = words_of(text)
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class _OneLength:
    """Shift table and suffix buckets for patterns of ``m`` words."""

    def __init__(self, patterns: dict[bytes, tuple[str, ...]], m: int):
        self.m, self.block = m, min(2, m)
        self.most = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, dict[bytes, tuple[str, ...]]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            words = pattern.split(b" ")
            for end in range(self.block, m + 1):
                key = b" ".join(words[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.most), m - end)
            self.buckets[key].setdefault(words[0], {})[pattern] = items

    def search(self, words: list[bytes]):
        """Yield (first word, last word + 1, items) of every occurrence."""
        m, most, shift, pair = self.m, self.most, self.shift, self.block == 2
        at, n = m - 1, len(words)
        while at < n:
            key = words[at - 1] + b" " + words[at] if pair else words[at]
            skip = shift.get(key, most)
            if skip:
                at += skip
                continue
            candidates = self.buckets[key].get(words[at - m + 1])
            if candidates:
                items = candidates.get(b" ".join(words[at - m + 1 : at + 1]))
                if items is not None:
                    yield at - m + 1, at + 1, items
            at += 1


class WuManber:
    def __init__(self, patterns: dict[bytes, tuple[str, ...]]):
        lengths: dict[int, dict] = defaultdict(dict)
        for pattern, items in patterns.items():
            lengths[pattern.count(b" ") + 1][pattern] = items
        self.tables = [_OneLength(of, m) for m, of in sorted(lengths.items())]

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, covered spans (merged, half open), matching items."""
        words, found, items = words_of(text), [], set()
        for table in self.tables:
            for first, last, of in table.search(words):
                found.append((first, last))
                items.update(of)
        return len(words), merge_spans(found), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


_TABLES: dict[str, WuManber] = {}


def _searcher(key: str, broadcast) -> WuManber:
    """The tables of one block of patterns, built once a Python worker; no two blocks share a ``key``."""
    if key not in _TABLES:
        if len(_TABLES) > 1:
            _TABLES.clear()
        _TABLES[key] = WuManber(broadcast.value)
    return _TABLES[key]


def _scanner(spark, patterns: dict[bytes, tuple[str, ...]]):
    key, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(patterns)

    def batch(texts: list[bytes]) -> pa.Array:
        found = [_searcher(key, shared).scan(t) for t in texts]
        span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        return struct_array(
            [
                ("n_words", pa.int64(), [n for n, _, _ in found]),
                ("spans", span, [[{"first": a, "last": b} for a, b in s] for _, s, _ in found]),
                ("items", pa.list_(pa.string()), [sorted(i) for _, _, i in found]),
            ]
        )

    return bytes_udf(batch, RESULT)


def benchmark_patterns(
    benchmark: DataFrame, size: int = WINDOW_WORDS, text_col: str = "text", id_col: str = "item_id"
) -> DataFrame:
    """Rows (pattern, item), each once; items without id or words give none."""

    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array([item_windows(t, size) for t in texts], type=pa.list_(pa.binary()))

    windows = bytes_udf(batch, "array<binary>")
    return (
        benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
        .where("item is not null")
        .select("item", F.explode(windows("text")).alias("pattern"))
        .distinct()
    )


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW_WORDS,
    text_col: str = "text",
    out_col: str = "contamination",
    block_patterns: int = BLOCK_PATTERNS,
) -> DataFrame:
    """``docs`` with a struct of n_words, merged hit spans and sorted item ids.

    The benchmark is the query set: it is searched in blocks of at most about
    ``block_patterns`` patterns, and only one block is broadcast at a time. One
    block needs no shuffle at all. A null text has no words and no hits; an
    empty benchmark hits nothing; items without id or words are left out.
    """
    stored = materialise(benchmark_patterns(benchmark, size), "patterns")
    n_blocks = max(1, -(-stored.count() // block_patterns))
    patterns = stored.withColumn("block", F.pmod(F.xxhash64("pattern", "item"), F.lit(n_blocks)))
    spark, part, result = docs.sparkSession, fresh_name(docs, "part"), docs
    before = None
    for block in range(n_blocks):
        table: dict[bytes, list[str]] = defaultdict(list)
        for row in patterns.where(F.col("block") == block).select("pattern", "item").toLocalIterator():
            table[bytes(row.pattern)].append(row.item)
        scan = _scanner(spark, {pattern: tuple(items) for pattern, items in table.items()})
        if block == 0:
            result = result.withColumn(out_col, scan(F.col(text_col)))
        else:
            a, b = F.col(out_col), F.col(part)
            result = result.withColumn(part, scan(F.col(text_col))).withColumn(
                out_col,
                F.struct(
                    a["n_words"].alias("n_words"),
                    _merged(F.concat(a["spans"], b["spans"])).alias("spans"),
                    F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
                ),
            )
            result = result.drop(part)
        if n_blocks > 1:
            result = materialise(result, "contamination")
            if before is not None:
                discard(before)
            before = result
    discard(stored)
    return result


def _merged(spans):
    """Union of sorted half-open spans, as a SQL fold."""
    empty = F.array().cast("array<struct<first:int,last:int>>")

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        return (
            F.when(F.size(acc) == 0, F.array(s))
            .when(s["first"] <= last["last"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined)))
            .otherwise(F.concat(acc, F.array(s)))
        )

    return F.aggregate(F.array_sort(spans), empty, step)


def n_hit(contamination):
    """Words inside any occurrence, from the merged spans."""
    return F.aggregate(contamination["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """The documents in which no benchmark window occurs, columns unchanged."""
    name = fresh_name(docs, "contamination")
    return find_contamination(docs, benchmark, size, out_col=name).where(F.size(F.col(name)["items"]) == 0).drop(name)
