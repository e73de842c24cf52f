"""Near copies among whole texts: sets of five-word shingles at a Jaccard similarity of 0.8 or more.

Four differing bits of a SimHash are far fewer than texts of that similarity
have, so the pipeline's stage joins the groups of ``simhash`` with links found
here. A text is the set of its five-word shingles; equal sets are one node. Sixty
min-hashes of a set make twelve band keys, each of five, and sets with a common
key are compared: of pairs at 0.8 exactly, 0.991 have one (1 - (1 - 0.8^5)^12), of
closer pairs more. What is compared is verified on the whole sets.

Lists with the same nodes count once. A list that fits a block is compared in one
task, which reports only a spanning forest: it costs a row a set, and the driver plans
one job for all such lists. In a list too long for a block every set is compared with
the list's hubs, those that meet most others; what a hub links to leaves the list, as
do the hubs, and the rest go on with eight times the hubs until the list is short;
where a list has no more sets than hubs, all are hubs. So groups of copies, however
large, cost a few rows a copy, no list is cut off, and the driver plans few rounds. At
the end, the sets of a long list that were linked to hubs and so left it are compared
with those of its sets that are in other groups; within a group more links change
nothing. So no two sets with a common key that are near end in different groups.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessella.functions.texts import fresh_name
from tessella.llm.common import bytes_udf, struct_array
from tessella.llm.fingerprints import mix
from tessella.llm.simhash import LOWER, near_duplicates
from tessella.operators.components import connected_components
from tessella.operators.skew import spread_join
from tessella.sources.shared import discard, materialise, owning

WIDTH = 5
SEED = 42
LEAST = 0.8
BANDS = 12
ROWS = 5
#: Lists of up to so many sets, and so many shingles in all, are compared in one block; 4 million are 32 MB.
BLOCK = 2048
SHINGLES = 1 << 22
#: What is left of longer lists is compared pair by pair once it is up to this long.
FEW = 4
#: How many times as many hubs the next round has. Each round is a dozen jobs, whose plans and task binaries lie in the driver's memory.
MORE = 8
#: Tasks that one long list's last comparison is dealt to.
PARTS = 16

#: Odd multipliers and offsets of the min-hashes, and the multiplier that chains words.
FACTORS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64))
CHAIN = np.uint64(0x9E3779B97F4A7C15)


def _chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several, in order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        out = mix((out ^ part) * CHAIN)
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles of ``WIDTH`` words, A-Z lower-cased.

    Fewer words are one shingle, no words none.
    """
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w, SEED) for w in text.translate(LOWER).split()], np.uint64)
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    return np.unique(_chained([words[k : len(words) - width + 1 + k] for k in range(width)]))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """The ``BANDS`` keys of a set; none for an empty one."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    n = BANDS * ROWS
    least = np.array([(shingles * (FACTORS[i] | np.uint64(1)) ^ FACTORS[n + i]).min() for i in range(n)], np.uint64)
    return _chained([np.arange(BANDS, dtype=np.uint64), *least.reshape(BANDS, ROWS).T])


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets without repetitions."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def add_sketch(docs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``docs`` with a struct: node, which names the shingle set (0: the empty one), its size and its band keys."""

    def batch(texts: list[bytes]) -> pa.Array:
        nodes, sizes, keys = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            shingles = shingle_set(text)
            sizes[i] = len(shingles)
            nodes[i] = xxhash.xxh64_intdigest(shingles.tobytes(), SEED) | 1 if len(shingles) else 0
            keys.append(band_keys(shingles).view(np.int64))
        return struct_array([("node", pa.int64(), nodes.view(np.int64)), ("size", pa.int64(), sizes), ("keys", pa.list_(pa.int64()), keys)])

    return docs.withColumn(out_col, bytes_udf(batch, "struct<node:bigint,size:bigint,keys:array<bigint>>")(F.col(text_col)))


def _with_set(docs: DataFrame, text_col: str) -> DataFrame:
    def batch(texts: list[bytes]) -> pa.Array:
        return pa.array([shingle_set(t).tobytes() for t in texts], pa.binary())

    return docs.withColumn("shingles", bytes_udf(batch, "binary")(F.col(text_col)))


@F.arrow_udf(BooleanType())
def _near(a: pa.Array, b: pa.Array) -> pa.Array:
    sets = lambda column: [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    return pa.array([jaccard(x, y) >= LEAST for x, y in zip(sets(a), sets(b))], pa.bool_())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets are near, written.

    The pairs are written first, so that Spark knows their size: it may send few
    pairs to where the sets lie, and merges many.
    """
    pairs = materialise(pairs, "pairs")
    a, b = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    near = materialise(pairs.join(a, "u").join(b, "v").where(_near("a", "b")).select("u", "v"), "near")
    discard(pairs)
    return near


def near_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``sets``, none of them empty, as places in it: a walk from each keeps
    one link for each newly reached set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    held, open_, edges = np.zeros(int(ids.max()) + 1, np.uint8), np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not open_[root]:
            continue
        open_[root] = False
        walk = [root]
        while walk and open_.any():
            x = walk.pop()
            own = ids[starts[x] : starts[x] + sizes[x]]
            held[own] = 1
            both = np.add.reduceat(held[ids], starts, dtype=np.int64)
            held[own] = 0
            found = np.flatnonzero(open_ & (both / (sizes + sizes[x] - both) >= LEAST))
            open_[found] = False
            edges += [(x, int(y)) for y in found]
            walk += found.tolist()
    return edges


def _compare(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_numpy()
    edges = np.array(near_forest([np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]), np.int64).reshape(-1, 2)
    return pa.table({"u": nodes[edges[:, 0]], "v": nodes[edges[:, 1]]})


def list_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between nodes whose sets are near, written: two near nodes of a list are linked or in one group.

    ``lists``: (list, node, n, shingles), n the list's length and shingles those of
    its sets in all. ``sets``: (node, shingles). Lists that fit a block are dealt to
    tasks, each whole; the others go through ``jaccard_links``.
    """
    fits = (F.col("n") <= BLOCK) & (F.col("shingles") <= SHINGLES)
    blocks = lists.where(fits).select("list", "node").join(sets.hint("merge"), "node")
    out = materialise(blocks.groupBy("list").applyInArrow(_compare, "u bigint, v bigint"), "blocks")
    rest = lists.where(~fits).select("list", "node", "n")
    if not rest.isEmpty():
        first, others = out, jaccard_links(rest, sets)
        out = materialise(first.union(others), "links")
        discard(first, others)
    return out


def _counted(lists: DataFrame, label: str, *sums: Column) -> DataFrame:
    """(list, node, n) and the lists' ``sums``, for lists of two and more, written; of lists with the same nodes, as copies have in most bands, one is enough."""
    digest = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    sizes = lists.groupBy("list").agg(F.count(F.lit(1)).alias("n"), digest(1).alias("a"), digest(2).alias("b"), *sums).where("n > 1")
    once = sizes.groupBy("n", "a", "b").agg(F.min(F.struct("list", *sizes.columns[4:])).alias("one")).select("one.*", "n")
    return materialise(lists.join(once.hint("merge"), "list"), label)


def _pairs(lists: DataFrame) -> DataFrame:
    """(u, v) for each two nodes of each of these short lists."""
    nodes = lists.groupBy("list").agg(F.collect_list("node").alias("nodes"))  # at most FEW
    pairs = lambda u: F.transform(F.filter("nodes", lambda v: v > u), lambda v: F.struct(u.alias("u"), v.alias("v")))
    return nodes.select(F.inline(F.flatten(F.transform("nodes", pairs))))


def _across(lists: DataFrame, left: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets of one list that ``links`` leave in different groups, written.

    ``lists``: (list, node) of long lists; ``left``: (list, node) of the sets that
    left them, linked to a hub. Every other pair was compared. Only lists with
    several groups are looked at, and only sizes that 0.8 admits; a list is dealt
    to ``PARTS`` tasks.
    """
    parts = connected_components(links)
    members = materialise(parts, "roots")
    sized = sets.select("node", F.octet_length("shingles").alias("size"))
    rooted = lists.join(members.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).join(sized.hint("merge"), "node")
    rooted = materialise(rooted.select("list", "node", "root", "size"), "rooted")
    several = materialise(rooted.groupBy("list").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("list"), "several")
    mixed = rooted.join(several.hint("merge"), "list")
    a = mixed.join(left.hint("merge"), ["list", "node"], "left_semi").select("list", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"))
    a = a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    b = mixed.select("list", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.pmod(F.xxhash64("node"), F.lit(PARTS)).cast("int").alias("part"))
    fits = (F.col("ra") != F.col("rb")) & (F.least("sa", "sb") >= LEAST * F.greatest("sa", "sb"))
    met = a.join(b, ["list", "part"]).where(fits).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    out = _verified(met, sets)
    discard(parts, members, rooted, several)
    return out


def jaccard_links(lists: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between nodes whose sets are near, written: two near nodes of a list are linked or in one group.

    ``lists``: (list, node, n), n the list's length. ``sets``: (node, shingles).
    What is left of long lists when they are short waits for one verification of
    all short lists; rounds over long lists read the sets of their nodes only. Two
    hubs of a list meet once.
    """
    meets = lists.groupBy("node").agg(F.sum("n").alias("met"))
    whole = materialise(lists.where(F.col("n") > FEW).join(meets.hint("merge"), "node").select("list", "node", "n", "met"), "long")
    crowd = materialise(sets.join(whole.select("node").distinct(), "node", "left_semi"), "crowd")
    found, waiting, hubs = [], [lists.where(F.col("n") <= FEW).select("list", "node")], 1
    settled, left = [], []
    long, total = whole, whole.count()
    while total:
        part = F.when(F.col("n") <= hubs, F.col("node")).otherwise(F.pmod(F.xxhash64("node", F.lit(hubs)), F.lit(hubs)))
        dealt = long.groupBy("list", part.alias("part"))
        best = dealt.agg(F.max(F.struct("met", "node")).alias("best"), F.max("n").alias("n"))
        best = materialise(best.groupBy("list").agg(F.collect_list("best.node").alias("hubs"), F.max("n").alias("n")), "hubs")  # at most ``hubs``
        rows = spread_join(long.drop("n"), best, "list", "n", total).withColumn("is_hub", F.array_contains("hubs", F.col("node")))
        met = F.filter("hubs", lambda hub: ~F.col("is_hub") | (hub >= F.col("node")))
        rows = materialise(rows.select("list", "node", F.explode(met).alias("hub")), "meetings")
        near = _verified(rows.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), crowd)
        found.append(near)
        gone = rows.join(near.select(F.col("u").alias("node"), F.col("v").alias("hub")).hint("merge"), ["node", "hub"], "left_semi").select("list", "node")
        gone = materialise(gone.distinct(), "gone")
        left.append(gone)
        gone = gone.union(rows.where("node = hub").select("list", "node")).distinct()
        again = _counted(long.drop("n").join(gone.hint("merge"), ["list", "node"], "left_anti"), "left")
        discard(best, rows)
        settled.append(again)
        waiting.append(again.where(F.col("n") <= FEW).select("list", "node"))
        long = again.where(F.col("n") > FEW)
        total, hubs = long.count(), hubs * MORE
    found.append(_verified(_pairs(reduce(DataFrame.union, waiting)).distinct(), sets))  # a list waits once
    out = materialise(reduce(DataFrame.union, found).distinct(), "links")
    if left:
        across, first = _across(whole.select("list", "node"), reduce(DataFrame.union, left), out, crowd), out
        out = materialise(first.union(across), "links")
        discard(first, across)
    discard(*found, *settled, *left, whole, crowd)
    return out


def near_text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_hash, group, doc_id, n): of each distinct text its group, its smallest id and its number of rows, written.

    A group holds the texts that are linked, in any number of steps, by
    ``simhash.near_duplicates`` or by a Jaccard similarity of ``LEAST``; null and
    wordless texts are one group. Null ids give way to others.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    found = near_duplicates(docs, id_col, text_col)
    hashed = materialise(found.groupBy("text_hash").agg(F.min("root").alias("root"), F.min(order).alias("best"), F.count(F.lit(1)).alias("n")), "hashed")
    discard(found)
    narrow = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    sketched = add_sketch(narrow, "text", "sketch").select("text_hash", "sketch")
    sketched = materialise(sketched.groupBy("text_hash").agg(F.first("sketch").alias("sketch")).select("text_hash", "sketch.*"), "sketches")
    nodes = materialise(hashed.join(sketched.select("text_hash", "node"), "text_hash"), "texts")

    distinct = sketched.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    posted = materialise(distinct.select("text_hash", "node", "size", F.explode("keys").alias("list")), "posted")
    lists = _counted(posted, "lists", F.sum("size").alias("shingles"))
    # One row stands for all copies of a text: that with its smallest id, so that copies don't meet in a task.
    wanted = lists.select("text_hash", "node").distinct().join(hashed.select("text_hash", F.col("best.doc_id").alias("best_id")), "text_hash")
    wanted = materialise(wanted.withColumnRenamed("text_hash", "best_hash"), "wanted")
    chosen = docs.select(F.xxhash64(text_col).alias("text_hash"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = chosen.join(wanted, (F.col("text_hash") == F.col("best_hash")) & F.col("doc_id").eqNullSafe(F.col("best_id")))
    sets = materialise(_with_set(chosen.select("node", "text").dropDuplicates(["node"]), "text").select("node", "shingles"), "sets")
    near = list_links(lists, sets)
    discard(posted, lists, wanted, sets, sketched, hashed)

    # Texts of one SimHash group are linked to the group's smallest node.
    roots = nodes.groupBy("root").agg(F.min("node").alias("v"), F.max("node").alias("most"), F.count(F.lit(1)).alias("texts")).where("v < most")
    roots = materialise(roots.select("root", "v", "texts"), "roots")
    same = spread_join(nodes.select("root", F.col("node").alias("u")), roots, "root", "texts", nodes.count())
    parts = connected_components(near.union(same.select("u", "v").distinct()))
    members = materialise(parts.select(F.col("node"), F.col("root").alias("group")), "members")
    grouped = nodes.join(members.hint("merge"), "node", "left")
    out = materialise(grouped.select("text_hash", F.coalesce("group", "node").alias("group"), F.col("best.doc_id").alias("doc_id"), "n"), "near_groups")
    discard(near, roots, parts, members, nodes)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of ``near_text_groups``, columns unchanged.

    Kept is the one with the smallest id; of equal ids the smallest text hash;
    of rows equal in both any one. Null ids are kept only in groups without others.
    """
    groups = near_text_groups(docs, id_col, text_col)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n")).alias("best"))
    best = best.select(F.col("best.doc_id").alias("best_id"), F.col("best.text_hash").alias("best_hash"), "best.n")
    best = materialise(best, "kept")
    discard(groups)
    name = fresh_name(docs, "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(text_col))
    kept = hashed.join(best, hashed[id_col].eqNullSafe(F.col("best_id")) & (F.col(name) == F.col("best_hash")), "left_semi")
    if not best.where("n > 1").isEmpty():  # some text has several rows, perhaps of one id
        kept = kept.dropDuplicates([id_col, name])
    return owning(kept.drop(name), best)
