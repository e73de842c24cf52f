"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a row draws, for every child, an exponential variate from a hash
of its key and the child's name, divided by the child's weight; the smallest
wins. A child is thus taken in proportion to its weight, and a changed weight
moves rows only into or out of the subtree that it weighs. A weight is the
number of shards below.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import fresh_name
from tessella.sources.shared import materialise

SHARDS_PER_RACK, RACKS_PER_REGION, BASE_SHARDS = 4, 2, 16

Tree = dict[str, dict[str, list[int]]]


def layout(n_shards: int) -> Tree:
    """The tree of ``n_shards`` shards.

    Up to 16 shards fill racks of four, two racks a region. Each later shard is
    a region of its own, so that no standing subtree changes its weight: one
    more shard takes rows only into itself. That holds from 16 shards on; below,
    a new shard raises the weight of its rack and region, and rows drawn there
    may land beside it. A deep tree of many shards is passed to ``place`` as it
    is, with the one it grows to.
    """
    tree: Tree = {}
    for shard in range(n_shards):
        rack = shard // SHARDS_PER_RACK
        region = rack // RACKS_PER_REGION
        if shard >= BASE_SHARDS:
            rack = region = shard
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", []).append(shard)
    return tree


def uniform(key: Column, name: str) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of the key and a node's name."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + name))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def _draw(key: Column, children: list[tuple[str, int, Column]]) -> Column:
    """What the winning child gives; children are (name, weight, its outcome)."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct((-F.log(uniform(key, name)) / float(weight)).alias("draw"), F.lit(i).alias("child"))
        for i, (name, weight, _) in enumerate(children)
    ]
    winner = F.least(*draws)["child"]
    outcome = children[-1][2]
    for i, (_, _, of) in list(enumerate(children))[-2::-1]:
        outcome = F.when(winner == i, of).otherwise(outcome)
    return outcome


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that a string key draws by descending the tree."""
    regions = []
    for region, racks in tree.items():
        below = [
            (rack, len(shards), _draw(key, [(f"shard{s}", 1, F.lit(s)) for s in shards])) for rack, shards in racks.items()
        ]
        regions.append((region, sum(len(s) for s in racks.values()), _draw(key, below)))
    return _draw(key, regions)


def key_text(id_col: str) -> Column:
    """The sharding key as text; null ids share the key "null"."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit("null"))


def add_slots(rows: DataFrame, shard_col: str, order: list[str], out_col: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in the order given.

    Rows are dealt by range over (shard, order, arrival), so that a large shard,
    or many rows with one key, spread over many tasks, and written once so that
    the dealing is settled. Each range is numbered by itself; a count for each
    range and shard gives the offsets. Ties stand in order of arrival.
    """
    arrival, part, before = (fresh_name(rows, n) for n in ("arrival", "part", "before"))
    keys = [shard_col, *order, arrival]
    dealt = rows.withColumn(arrival, F.monotonically_increasing_id()).repartitionByRange(*keys)
    dealt = materialise(dealt.withColumn(part, F.spark_partition_id()), "slots")
    ranges = Window.partitionBy(shard_col).orderBy(part)
    offsets = dealt.groupBy(part, shard_col).agg(F.count(F.lit(1)).alias(before))
    offsets = offsets.withColumn(before, F.sum(before).over(ranges) - F.col(before))
    local = F.row_number().over(Window.partitionBy(part, shard_col).orderBy(*order, arrival)) - 1
    numbered = dealt.withColumn(out_col, local.cast("bigint")).join(offsets, [part, shard_col])
    return numbered.withColumn(out_col, F.col(out_col) + F.col(before)).drop(arrival, part, before)


def place(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", trees: tuple[Tree, Tree] | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``grown_shard`` (with one more shard), by the id alone.

    ``trees`` are those before and after growth, else the layouts of ``n_shards``
    and one more. Rows with equal ids, null ids among them, share a shard.
    """
    before, after = trees or (layout(n_shards), layout(n_shards + 1))
    key = key_text(id_col)
    return docs.withColumns({"shard": shard_of(key, before), "grown_shard": shard_of(key, after)})
