"""Hash-chained logs, digests of sets, and reconciliation of two tables."""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name
from tessella.operators.ranges import running
from tessella.sources.shared import materialise

GENESIS = "GENESIS"


def chain_append(rows: DataFrame, key: str, order: str, body: Column) -> DataFrame:
    """``key``, ``order``, body, prev_hash and event_hash of each entry.

    event_hash is the SHA-256 of prev_hash and body, so a chain is a fold in
    order. Rows are dealt by key and sorted; each task then streams over them
    and holds one hash, never a chain. Null keys are a chain of their own;
    null bodies count as empty.
    """
    dealt = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.coalesce(body, F.lit("")).alias("body"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "order", "body")
    kinds = dict(dealt.dtypes)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), GENESIS
        for batch in batches:
            before, after = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != at:
                    at, last = k, GENESIS
                before.append(last)
                last = hashlib.sha256(f"{last}|{text}".encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=["key", "order", "body", "prev_hash", "event_hash"])

    schema = f"key {kinds['key']}, order {kinds['order']}, body string, prev_hash string, event_hash string"
    return dealt.mapInArrow(link, schema).withColumnsRenamed({"key": key, "order": order})


def chain_verify(chain: DataFrame, key: str, order: str, recomputed: Column, states: DataFrame | None = None) -> DataFrame:
    """For each key: entries, the first failing one and why, and the last good hash.

    ``chain``: key, order, prev_hash, event_hash; ``recomputed`` is the hash that
    an entry ought to have. A wrong link is named before a wrong hash of the same
    entry; null hashes fail. ``latest_hash`` is the hash before the failing entry,
    or the last one.

    ``states``, if given, has a row a key: tail_hash, state_hash, and what the
    newest entry says of the state, expected_hash (null: nothing). The tail must
    be the last hash, and the state's hash the expected one; the last entry is
    then named as the failing one. ``bound`` says whether the state was held
    against a hash. A key with a state but no entries has the first hash as its
    last; a key without a state fails for its tail. A long chain is verified by
    ranges of it; ``chain`` is read three times.
    """
    r, f, z, n = (fresh_name(chain, c) for c in ("reason", "failure", "last", "place"))
    before = F.when(F.col(n) == 1, GENESIS).otherwise(F.col(z))
    reason = F.when(~F.col("prev_hash").eqNullSafe(before), "previous hash mismatch").when(
        ~F.col("event_hash").eqNullSafe(recomputed), "event hash mismatch"
    )
    entry = F.struct(F.col(order).alias("seq"), F.col(r).alias("reason"), F.col(z).alias("hash"))
    linked = running(chain, [key], [order], number=n, lags={z: "event_hash"})
    checked = linked.withColumns({r: reason, z: before})
    out = checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.when(F.col(r).isNotNull(), entry)).alias(f),
        F.max(F.struct(F.col(order).alias("seq"), F.col("event_hash").alias("hash"))).alias(z),
    )
    latest = F.coalesce(F.when(F.col(f).isNotNull(), F.col(f)["hash"]).otherwise(F.col(z)["hash"]), F.lit(GENESIS))
    found = out.select(
        F.col(key).alias("k"), "n_events", F.col(f)["seq"].alias("failure_seq"), F.col(f)["reason"].alias("reason"), latest.alias("latest_hash"), F.col(z)["seq"].alias("last_seq")
    )
    if states is not None:
        s = states.select(F.col(key).alias("state_key"), "tail_hash", "state_hash", "expected_hash")
        found = found.join(s, F.col("k").eqNullSafe(F.col("state_key")), "full_outer").withColumns(
            {"k": F.coalesce("k", "state_key"), "n_events": F.coalesce("n_events", F.lit(0).cast("bigint")), "latest_hash": F.coalesce("latest_hash", F.lit(GENESIS))}
        )
        later = F.when(~F.col("tail_hash").eqNullSafe(F.col("latest_hash")), "session state audit tail mismatch").when(
            F.col("expected_hash").isNotNull() & ~F.col("expected_hash").eqNullSafe(F.col("state_hash")), "session state content hash mismatch"
        )
        found = found.withColumns({"failure_seq": F.when(F.col("reason").isNull() & later.isNotNull(), F.col("last_seq")).otherwise(F.col("failure_seq")), "reason": F.coalesce("reason", later)})
        found = found.withColumn("bound", F.col("reason").isNull() & F.col("expected_hash").isNotNull())
    extra = ["bound"] if states is not None else []
    return found.select(
        F.col("k").alias(key), "n_events", "failure_seq", F.coalesce("reason", F.lit("ok")).alias("reason"), F.col("reason").isNull().alias("valid"), "latest_hash", *extra
    )


#: Hex digits are used up from the leaves of a digest tree; a leaf holds about so many rows.
LEAF_ROWS = 256


def _leaf_digests(rows: DataFrame, node: str) -> DataFrame:
    """The SHA-256 of each group's sorted ``node``s, comma-joined, as ``node``; the groups are the other columns.

    Groups are dealt to tasks, sorted and streamed over, with the state of one.
    """
    by = [c for c in rows.columns if c != node]
    dealt = rows.select(*by, node).repartition(*by).sortWithinPartitions(*by, node)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, group, state = [*by, node], None, None
        for batch in batches:
            *parts, nodes = [c.to_pylist() for c in batch.columns]
            done = []
            for each, text in zip(zip(*parts), nodes):
                if each == group:
                    state.update(b",")
                else:
                    if state:
                        done.append((*group, state.hexdigest()))
                    group, state = each, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*done), batch.schema)], names=names)
            kinds = [f.type for f in batch.schema]
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*group, state.hexdigest()), kinds)], names=names)

    return dealt.mapInArrow(digest, dealt.schema)


def set_digest(rows: DataFrame, row_hash: Column, *keys: str, levels: int | None = None) -> DataFrame:
    """(keys, n_rows, digest): a digest of each key's rows that doesn't hang on their order.

    ``row_hash`` is the SHA-256 of a row. Rows with one hash are counted first.
    The hashes of a key are the leaves of a tree by their leading hex digits, as
    many levels as bring a leaf to about ``LEAF_ROWS`` rows; a node is the
    SHA-256 of its sorted children, "hash:count" at the leaves, and the root is
    the digest. So no group is ever gathered in a row, repeated rows count as
    often as they occur, and two sets with one digest would be a collision. With
    ``levels`` the tree has at most so many above its leaves, which then have no
    bound and are streamed over.
    """
    h, n, level, node = (fresh_name(rows, c) for c in ("h", "n", "level", "node"))
    counted = rows.groupBy(*keys, row_hash.alias(h)).agg(F.count(F.lit(1)).alias(n))
    counted = materialise(counted, "hashes")
    k = [F.col(c).alias(f"{node}_{i}") for i, c in enumerate(keys)]
    depth = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.count(F.lit(1)) / float(LEAF_ROWS)))).cast("int")
    depth = depth if levels is None else F.least(depth, F.lit(levels))
    sizes = counted.groupBy(*k).agg(F.sum(n).alias("n_rows"), depth.alias(level)) if keys else counted.agg(F.sum(n).alias("n_rows"), depth.alias(level))
    sizes = materialise(sizes, "sizes")
    same = [F.col(c).eqNullSafe(F.col(f"{node}_{i}")) for i, c in enumerate(keys)]
    children = counted.join(sizes.drop("n_rows"), same) if keys else counted.crossJoin(F.broadcast(sizes.drop("n_rows")))  # one row
    children = children.select(*keys, h, level, F.concat_ws(":", h, F.col(n).cast("string")).alias(node))
    for depth in range(sizes.agg(F.max(level)).first()[0] or 0, -1, -1):
        here = children.where(F.col(level) == depth).select(*keys, F.left(F.col(h), F.lit(depth)).alias(h), node)
        if depth == levels:
            up = _leaf_digests(here, node)
        else:
            up = here.groupBy(*keys, h).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(node)), ","), 256).alias(node))  # a leaf's rows, or sixteen nodes
        up = up.select(*keys, h, F.lit(depth - 1).alias(level), F.concat_ws(":", h, node).alias(node))
        children = up.unionByName(children.where(F.col(level) < depth))
    roots = children.select(*keys, F.substring(F.col(node), 2, 64).alias("digest"))
    if not keys:
        return sizes.select(F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows")).join(roots, how="left")
    joined = sizes.drop(level).join(roots, same)
    return joined.select(*keys, "n_rows", "digest")


#: Put before what is no SHA-256 in hexadecimal digits, as 32 bytes are one.
OTHER = bytes(33)


def evidence_bundle(sessions: DataFrame, files: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """(key, n_files, digest) of each session: its own fields and, for each kind, its files' sorted hashes.

    ``sessions``: key and any fields; ``files``: key, kind, sha256. Null hashes
    and other kinds are left out; a kind without files still has its place. Files
    and sessions are dealt by key in one shuffle, hashes as 32 bytes, and sorted,
    a key's sessions after its files; each task streams over them and holds
    one digest a kind, never a key's files.
    """
    own = F.to_json(F.struct(*sorted(sessions.columns)), {"ignoreNullFields": "false"})
    code = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int")
    kept = files.where(F.col("kind").isin(*kinds) & F.col("sha256").isNotNull() & F.col(key).isNotNull())
    digest = F.col("sha256").cast("string")
    short = F.when(digest.rlike("^[0-9a-f]{64}$"), F.unhex(digest)).otherwise(F.concat(F.lit(OTHER), digest.cast("binary")))
    last = F.lit(len(kinds) + 1)
    rows = sessions.select(F.col(key).alias("k"), last.alias("part"), F.unhex(F.sha2(own, 256)).alias("h"))
    rows = kept.select(F.col(key).alias("k"), code.alias("part"), short.alias("h")).union(rows)
    dealt = rows.repartition("k").sortWithinPartitions("k", "part", "h")
    kind = dict(dealt.dtypes)["k"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, same, times, n, states = object(), 0, None, 0, 0, {}

        def close() -> None:
            """Adds the hash that has been counted to its kind's digest."""
            if times:
                text = same.hex() if len(same) == 32 else same[len(OTHER) :].decode()
                before = "," if part in states else ""
                states.setdefault(part, hashlib.sha256()).update(f"{before}{text}:{times}".encode())

        for batch in batches:
            keys, counts, digests = [], [], []
            for k, p, h in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at or p != part or h != same:
                    close()
                    times = 0
                    if k != at:
                        at, n, states = k, 0, {}
                    part, same = p, h
                if p <= len(kinds):
                    times, n = times + 1, n + 1
                    continue
                parts = [f"{name}={states[i].hexdigest() if i in states else ''}" for i, name in enumerate(kinds, 1)]
                keys.append(k)
                counts.append(n)
                digests.append(hashlib.sha256("|".join([h.hex(), *parts]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema[0].type), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=["k", "n_files", "digest"])

    return dealt.mapInArrow(fold, f"k {kind}, n_files bigint, digest string").withColumnRenamed("k", key)


def reconcile(state: DataFrame, catalog: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """Keys on which two tables disagree, with every reason.

    A key missing on one side, or a compared column that differs. Null keys
    are never equal and so are reported as missing.
    """
    in_state, in_catalog = fresh_name(state, "in_state"), fresh_name(catalog, "in_catalog")
    s, c = state.withColumn(in_state, F.lit(1)), catalog.withColumn(in_catalog, F.lit(1))
    joined = s.join(c, s[key] == c[key], "full_outer")
    both = s[in_state].isNotNull() & c[in_catalog].isNotNull()
    reasons = [
        F.when(c[in_catalog].isNull(), "MISSING_IN_CATALOG"),
        F.when(s[in_state].isNull(), "MISSING_IN_STATE"),
        *[F.when(both & ~s[x].eqNullSafe(c[x]), f"{x.upper()}_MISMATCH") for x in compared],
    ]
    found = joined.select(F.coalesce(s[key], c[key]).alias(key), F.array_compact(F.array(*reasons)).alias("reasons"))
    return found.where(F.size("reasons") > 0)


def version_gaps(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows whose version is not one more than the one before (the first: 0)."""
    found = running(rows, [key], [version], lags={"expected": version})
    return found.withColumn("expected", F.coalesce(F.col("expected"), F.lit(-1)) + 1).where(F.col("expected") != F.col(version))
