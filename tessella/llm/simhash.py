"""SimHash near-duplicates through an inverted index of byte positions.

Fingerprints that differ in at most four of 64 bits agree in at least four of
their eight bytes, place by place. The index posts each distinct fingerprint
under every set of three (place, byte) pairs it holds: a pair that shares m
positional bytes meets in C(m, 3) lists. Pairs are tallied over the lists; four
shared bytes make four meetings, so pairs that met less often are dropped
without a look, and the rest are verified by their differing bits. Links then
give connected components.

Equal fingerprints are one node, however many documents have them. Lists of
near copies may be crowded. The fingerprints in them are posted again under
every set of four (place, byte) pairs; there each meeting is the guaranteed
minimum by itself. Longer lists of these are compared in one block, which
reports only a spanning forest. What is crowded even there goes another way,
linear in the number of fingerprints: each posts the 2,081 patterns within two
bits of it, and two fingerprints are within four bits if and only if they share
one; all that share a pattern link to the smallest of them. So no way grows with
the square of a list, and no link between different groups is lost.
"""

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.llm.common import bytes_udf
from tessella.operators.components import connected_components
from tessella.operators.skew import spread_join
from tessella.sources.shared import discard, materialise, owning

SHINGLE_WORDS = 4
SEED = 42
MOST_BITS = 4
PLACES = 8
#: Bytes that two fingerprints within ``MOST_BITS`` share, at least.
LEAST_SHARED = PLACES - MOST_BITS
#: Bytes a list stands for, and how often a pair that shares the least number meets.
LISTED = 3
LEAST_MEETINGS = comb(LEAST_SHARED, LISTED)
#: Lists up to this long are joined; the next longer are compared in one block.
SHORT_LIST = 32
BLOCK = 1024
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SLICE = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    if len(words) < SHINGLE_WORDS:
        starts, ends = [0], [len(joined)]
    else:
        ends = ends[SHINGLE_WORDS - 1 :]
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(ends), SLICE):
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE], ends[at : at + SLICE])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(ends)).tobytes(), "big")


def add_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as a signed long; no words: 0."""

    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out_col, bytes_udf(batch, "bigint")(F.col(text_col)))


def _byte(fp: Column, place: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * place).bitwiseAND(F.lit(255))


def _postings(fps: DataFrame, size: int) -> DataFrame:
    """(list, fp, n): each fingerprint under each of its sets of ``size`` positional
    bytes, with the length of the list; lists of one fingerprint are left out."""
    fp = F.col("fp")
    keys = []
    for number, places in enumerate(combinations(range(PLACES), size)):
        key = F.lit(number).cast("bigint")
        for place in places:
            key = F.shiftleft(key, 8) + _byte(fp, place)
        keys.append(key)
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a row makes dozens
    posted = spread.select("fp", F.explode(F.array(*keys)).alias("list"))
    lengths = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # The planner doesn't know how many rows a fingerprint makes, so it must not choose by size.
    return materialise(posted.join(lengths.hint("merge"), "list"), "postings")


def _meetings(posted: DataFrame) -> DataFrame:
    """(u, v) with u < v, once for each short list that holds both."""
    short = posted.where(F.col("n") <= SHORT_LIST)
    a, b = short.select("list", F.col("fp").alias("u")), short.select("list", F.col("fp").alias("v"))
    return a.join(b, "list").where("u < v").select("u", "v")


def _verified(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS).select("u", "v")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within unsigned ``fps``: a walk from each keeps
    one link for each newly reached fingerprint."""
    open_, edges = np.ones(len(fps), bool), []
    for root in range(len(fps)):
        if not open_[root]:
            continue
        open_[root] = False
        walk = [root]
        while walk:
            x = walk.pop()
            left = np.flatnonzero(open_)
            found = left[np.bitwise_count(fps[left] ^ fps[x]) <= MOST_BITS]
            open_[found] = False
            edges += [(int(fps[x]), int(fps[y])) for y in found]
            walk += found.tolist()
    return edges


def _compare(table: pa.Table) -> pa.Table:
    edges = np.array(forest(table.column("fp").to_numpy().view(np.uint64)), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"u": edges[:, 0], "v": edges[:, 1]})


def _star_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) that join all of ``fps`` within four bits, by patterns within two bits of each.

    Sharing a pattern means at most four differing bits, and any two within four
    bits share one: flip half of the bits in which they differ.
    """
    n = fps.count()
    bit = "IF({0} < 64, shiftleft(1L, {0}), 0L)"
    pairs = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    pairs = pairs.select("fp", "i", F.explode(F.sequence(F.least(F.col("i") + 1, F.lit(64)), F.lit(64))).alias("j"))
    patterns = pairs.select("fp", F.expr(f"fp ^ {bit.format('i')} ^ {bit.format('j')}").alias("pattern"))
    shared = patterns.groupBy("pattern").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(shared, "patterns")
    joined = spread_join(patterns, shared, "pattern", "n", n * sum(comb(64, k) for k in range(3)), exploded=True)
    return owning(joined.where("fp <> v").select(F.col("fp").alias("u"), "v"), shared)


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp`` at most four bits apart, written.

    Short lists give all their links; crowded ones enough of them to hold each
    group together.
    """
    posted = _postings(fps, LISTED)
    tally = _meetings(posted).groupBy("u", "v").agg(F.count(F.lit(1)).alias("met"))
    found = _verified(tally.where(F.col("met") >= LEAST_MEETINGS))
    crowd = posted.where(F.col("n") > SHORT_LIST).select("fp").distinct()
    again = _postings(crowd, LEAST_SHARED)
    found = found.union(_verified(_meetings(again)))
    middle = again.where((F.col("n") > SHORT_LIST) & (F.col("n") <= BLOCK))
    found = found.union(middle.select("list", "fp").groupBy("list").applyInArrow(_compare, "u bigint, v bigint"))
    rest = materialise(again.where(F.col("n") > BLOCK).select("fp").distinct(), "crowded")
    star = _star_links(rest)
    linked = materialise(found.union(star).distinct(), "links")
    discard(posted, again, rest, star)
    return linked


def fingerprint_groups(fps: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints in ``fps`` that are linked to another."""
    linked = links(fps)
    found = connected_components(linked)
    discard(linked)
    return owning(found.select(F.col("node").alias("fp"), "root"), found)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint, root, component_id, text_hash.

    ``component_id`` is the smallest id linked to the document, itself included;
    null ids count only where a group has no other. ``root`` names the group.
    Texts without words have fingerprint 0 and are linked like any other.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    narrow = materialise(add_fingerprint(narrow, out_col="fp").select("doc_id", "text_hash", "fp"), "fingerprints")
    fps = narrow.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("documents"))
    fps = materialise(fps, "distinct")
    linked = fingerprint_groups(fps.select("fp"))
    groups = materialise(fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    discard(fps, linked)
    total, n_fps = groups.agg(F.sum("documents"), F.count(F.lit(1))).first()
    least = groups.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    least = materialise(least, "roots")
    named = materialise(spread_join(groups.select("fp", "root", "documents"), least, "root", "n", n_fps), "named")
    discard(groups, least)
    found = spread_join(narrow, named, "fp", "documents", total or 0)
    return owning(found.select("doc_id", F.col("fp").alias("fingerprint"), "root", "component_id", "text_hash"), narrow, named)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, columns unchanged.

    Kept is the one with the smallest id; of equal ids the smallest text hash;
    of rows equal in both any one. Null ids are kept only in groups without others.
    The radius is that of ``near_duplicates``, much narrower than a similarity of
    0.8 (README): most such pairs both stay unless a chain links them.
    """
    found = near_duplicates(docs, id_col, text_col)
    rows = materialise(found, "near_duplicates")
    discard(found)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"))
    repeated = rows.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count() > 0
    name = fresh_name(docs, "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(text_col))
    kept = hashed.join(best, hashed[id_col].eqNullSafe(F.col("best_id")) & (F.col(name) == F.col("best_hash")), "left_semi")
    if repeated:
        kept = kept.dropDuplicates([id_col, name])
    return kept.drop(name)
