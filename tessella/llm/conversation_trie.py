"""A prefix trie of conversations, its subtree totals summed by peeling leaves.

A node is a distinct sequence of turns. It is named by two sums over its turns,
each of a hash of the turn's place, role and text; so a prefix's name is a
running sum, and a conversation of any length is dealt over many tasks
(``operators.ranges``).

Totals move from the leaves to the root. Nodes hold the number of children that
still have to report; those without any are complete, send their totals to
their parents, added up for each parent before the shuffle, and leave. Rounds go
on until the root has left. Runs of only children are one node in these rounds,
a chain, so their number follows the branchings on a path and not its turns;
within a chain the totals of its nodes are running sums.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.digests import joined_sha256
from tessella.operators.ranges import running
from tessella.operators.skew import spread_join
from tessella.sources.shared import discard, materialise, owning

#: Conversations of a block share the beginning of the block's first one, of at
#: most this many turns less one.
BLOCK = 20
SHARED_TURNS = 4
WORDS = r"[^\x20\x09-\x0D]+"


def _written(df: DataFrame, label: str, *read: DataFrame) -> DataFrame:
    """``df``, written; what only it read goes."""
    out = materialise(df, label)
    discard(*read)
    return out


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, said, words): the turns of each conversation, numbered from 1, written.

    Turns stand in order of ``turn``, null first; equal ones by role, the text's
    first 64 characters and a digest of both. Null roles and texts are empty; rows
    without conv_id are left out. Whole texts are read where they lie and don't move.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    narrow = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.substring(text, 1, 64).alias("begins"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("said"),
        F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words"),
    )
    narrow = materialise(narrow, "turns")
    order = [F.col("turn").asc_nulls_first(), "role", "begins", "said"]
    numbered = running(narrow, ["conv_id"], order, number="pos")
    return _written(numbered.select("conv_id", "pos", "said", "words"), "numbered", numbered, narrow)


def shared_beginnings(numbered: DataFrame) -> DataFrame:
    """(conv_id, d, said, words): every conversation rebuilt, from its turnless beginning at d = 0, written.

    Conversation c begins with the first h turns of conversation c - c % 20, as
    many as there are, and goes on with its own turns after its first h; h is
    the CRC-32 of the decimal c, modulo 4. A block has few conversations and each
    takes three turns at most, so no key of that join is large.
    """
    heads = numbered.where(F.col("pos") < SHARED_TURNS).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "said", "words"))).alias("head"))  # three turns
    convs = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BLOCK, "h": (F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS).cast("int")})
    head = F.coalesce("head", F.array().cast(heads.schema["head"].dataType))
    convs = convs.join(heads, "base", "left").select("conv_id", "n", "h", F.slice(head, F.lit(1), F.col("h")).alias("head"))
    convs = materialise(convs, "beginnings")
    lent = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.pos").alias("d"), "x.said", "x.words")
    sizes = materialise(convs.select("conv_id", "n", "h", F.size("head").cast("bigint").alias("lent")), "lengths")
    own = spread_join(numbered, sizes, "conv_id", "n", numbered.count()).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("d"), "said", "words")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("d"), F.lit("").alias("said"), F.lit(0).cast("bigint").alias("words"))
    return _written(roots.unionByName(lent).unionByName(own), "rebuilt", convs, sizes)


def _prefix(depth: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(",", depth.cast("string"), a.cast("string"), b.cast("string"))


def paths_of(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, d, words, id, parent): the nodes on each conversation's path, written."""
    part = lambda seed: F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "d", "said")).otherwise(F.lit(0).cast("bigint")).cast("decimal(38,0)")
    parts = rebuilt.select("conv_id", "d", "words", part(1).alias("a"), part(2).alias("b"))
    summed = running(parts, ["conv_id"], ["d"], totals={"sum_a": "a", "sum_b": "b"})
    parent = F.when(F.col("d") > 0, _prefix(F.col("d") - 1, F.col("sum_a") - F.col("a"), F.col("sum_b") - F.col("b")))
    named = summed.select("conv_id", "d", "words", _prefix(F.col("d"), F.col("sum_a"), F.col("sum_b")).alias("id"), parent.alias("parent"))
    return _written(named, "paths", summed)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """id, parent, depth, conv_id, n_convs, n_children, saved, head, parent_conv_id, parent_head of each node, written.

    ``head`` is the node that the node's chain begins with: the root, or one
    that isn't an only child.
    """
    nodes = paths.groupBy("id").agg(
        F.min("parent").alias("parent"), F.min("d").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = nodes.join(children, "id", "left").withColumns(
        {"n_children": F.coalesce("n_children", F.lit(0).cast("bigint")), "saved": (F.col("n_convs") - 1) * F.col("words")}
    )
    counted = _written(counted.drop("words"), "counted", nodes)

    # Every conversation through a node has passed its chain's first node, so a running maximum finds it.
    siblings = materialise(counted.select(F.col("id").alias("parent"), F.col("n_children").alias("siblings"), F.col("n_convs").alias("n")), "siblings")
    rows = paths.select("conv_id", "d", "id", "parent")
    known = spread_join(rows.where("parent IS NOT NULL"), siblings, "parent", "n", paths.count())
    known = known.unionByName(rows.where("parent IS NULL").withColumn("siblings", F.lit(0).cast("bigint")))
    known = known.select("conv_id", "d", "id", F.when(F.col("siblings") != 1, F.struct("d", "id")).alias("begins"))
    known = _written(known, "begins", siblings)
    begun = running(known, ["conv_id"], ["d"], peaks={"chain": "begins"})
    headed = counted.join(begun.groupBy("id").agg(F.min("chain.id").alias("head")), "id")
    headed = _written(headed, "headed", begun, known, counted)

    above = headed.where("n_children > 0").select(
        F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("head").alias("parent_head"), F.col("n_children").alias("n")
    )
    above = materialise(above, "above")
    placed = spread_join(headed.where("parent IS NOT NULL"), above, "parent", "n", headed.count())
    none = {c: F.lit(None).cast(kind) for c, kind in above.dtypes if c.startswith("parent_")}
    placed = placed.unionByName(headed.where("parent IS NULL").withColumns(none))
    return _written(placed, "trie", above, headed)


def chains_of(nodes: DataFrame) -> DataFrame:
    """(head, parent_head, waiting, saved, n_leaves, n_nodes) of each chain by itself, written."""
    chains = nodes.groupBy("head").agg(
        F.max(F.when(F.col("id") == F.col("head"), F.col("parent_head"))).alias("parent_head"),
        F.max_by("n_children", "depth").alias("waiting"),
        F.sum("saved").alias("saved"),
        F.count(F.lit(1)).alias("n_nodes"),
    )
    return materialise(chains.withColumn("n_leaves", (F.col("waiting") == 0).cast("bigint")), "chains")


def peel(chains: DataFrame) -> DataFrame:
    """(head, saved, n_leaves, n_nodes) of each chain with all that hangs below it, written.

    Each round the complete ones, which wait for nobody, report to their parents
    and leave. A parent's reports are added up in the tasks that send them.
    """
    waiting, left = chains, []
    while True:
        complete = materialise(waiting.where("waiting = 0"), "complete")
        left.append(complete)
        reports = complete.where("parent_head IS NOT NULL").groupBy(F.col("parent_head").alias("head"))
        reports = reports.agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("more_saved"), F.sum("n_leaves").alias("more_leaves"))
        rest = waiting.where("waiting > 0").join(reports, "head", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
        rest = rest.select(
            "head", "parent_head", (F.col("waiting") - zero("n")).alias("waiting"), (F.col("saved") + zero("more_saved")).alias("saved"), "n_nodes", (F.col("n_leaves") + zero("more_leaves")).alias("n_leaves")
        )
        rest = materialise(rest, "waiting")
        if waiting is not chains:
            discard(waiting)
        waiting = rest
        if waiting.isEmpty():
            break
    discard(waiting)
    done = left[0]
    for one in left[1:]:
        done = done.unionByName(one)
    out = materialise(done.select("head", "saved", "n_leaves", "n_nodes"), "peeled")
    discard(*left)
    return out


def conversation_trie(turns: DataFrame) -> DataFrame:
    """A row a node of the trie of rebuilt conversations.

    ``turns``: conv_id, turn, role, text; other columns are left aside. Returned
    are conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256; conv_id and depth name the node. Rows without
    conv_id are left out, null roles and texts are empty. An empty table has no
    conversation and gives no row, not even the root.
    """
    numbered = numbered_turns(turns)
    rebuilt = shared_beginnings(numbered)
    paths = paths_of(rebuilt)
    discard(numbered, rebuilt)
    nodes = trie_nodes(paths)
    ends = paths.groupBy("conv_id").agg(F.max(F.struct("d", "id")).alias("last"))
    ends = _written(ends.select(F.col("last.id").alias("id"), "conv_id"), "ends", paths)
    chains = chains_of(nodes)
    totals = peel(chains)

    # What hangs below a node: its chain's total less what stands above the node in the chain.
    chained = running(nodes, ["head"], ["depth"], totals={"upto": "saved"})
    settled = _written(chained, "chained", chained, nodes, chains)
    lookup = totals.select("head", F.col("saved").alias("chain_saved"), "n_leaves", "n_nodes")
    summed = spread_join(settled, lookup, "head", "n_nodes", settled.count())
    digests = joined_sha256(ends, "id", "conv_id")
    found = summed.join(digests.withColumnRenamed("sha256", "ends"), "id", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("chain_saved") - F.col("upto") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    discard(ends)
    return owning(found, settled, totals, digests)
