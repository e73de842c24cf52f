"""Evidence graphs as two tables, and roll-ups for reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.texts import fresh_name


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last version of each key, by ``order``, with when the key first came.

    Every other column is kept from the last version. The aggregate combines
    before the shuffle. Null keys are a key of their own.
    """
    rest = [c for c in rows.columns if c not in keys and c not in order]
    out = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("m"), F.min(F.struct(*order)).alias("f"))
    return out.select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest], F.col(f"f.{order[-1]}").alias("first_seen"))


def edges_allowed(edges: DataFrame, relations: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Edges with a known relation, and the others."""
    known = F.coalesce(F.col("relation").isin(*relations), F.lit(False))
    return edges.where(known), edges.where(~known)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, most_nodes: int, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """The last ``most_nodes`` nodes, and the last ``most_edges`` edges between them (a view's fixed limits); ties go by id, the largest first."""
    shown = nodes.orderBy(F.desc("first_seen"), F.desc("id")).limit(most_nodes)
    name = fresh_name(edges, "node")
    ids = shown.select(F.col("id").alias(name))
    inside = edges.join(ids, edges["source"] == ids[name], "left_semi")
    inside = inside.join(ids, inside["target"] == ids[name], "left_semi")
    return shown, inside.orderBy(F.desc("first_seen"), F.desc("source"), F.desc("target")).limit(most_edges)


def component_status(parts: DataFrame, *keys: str) -> DataFrame:
    """State of a system from its parts' states, and the longest latency.

    All down: offline; any down or limited: degraded; any usable: online;
    otherwise unknown.
    """
    down, limited, usable = (F.col("state") == s for s in ("down", "limited", "up"))
    rolled = parts.groupBy(*keys).agg(
        F.bool_and(F.coalesce(down, F.lit(False))).alias("all_down"), F.bool_or(F.coalesce(down | limited, F.lit(False))).alias("any_bad"),
        F.bool_or(F.coalesce(usable, F.lit(False))).alias("any_up"), F.max("latency").alias("latency"),
    )
    state = F.when(F.col("all_down"), "offline").when(F.col("any_bad"), "degraded").when(F.col("any_up"), "online").otherwise("unknown")
    return rolled.select(*keys, state.alias("state"), "latency")


# The kinds of a session's sources, and the categories that decide its labels.
SOURCE_KINDS = {"raw": "raw_input_categories", "instrument": "instrument_result_categories", "knowledge": "knowledge_data_levels", "model": "model_execution_modes"}
DEMO, USER, REAL = "DEMO/SYNTHETIC", "USER_UPLOAD", "REAL_INSTRUMENT"


def provenance(sources: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """key, the sorted categories of each kind of source, three flags, and the labels that follow from them, for every session.

    ``sources``: key, kind, category, demo. ``sessions``: key, demo. A null
    category is UNKNOWN. Demonstration data is in a session that says so, or whose
    instrument results or knowledge are; a real instrument's result is one of that
    category that says that it isn't demonstration data. Categories are a few names,
    so a session's are gathered in its row.
    """
    kind, category = F.col("kind"), F.coalesce("category", F.lit("UNKNOWN"))
    sets = [F.array_sort(F.collect_set(F.when(kind == k, category))).alias(name) for k, name in SOURCE_KINDS.items()]
    found = sources.groupBy(F.col(key).alias("of")).agg(
        *sets, F.bool_or(kind.isin("instrument", "knowledge") & (category == DEMO)).alias("shown"), F.bool_or((kind == "raw") & (category == USER)).alias("uploaded"),
        F.bool_or((kind == "instrument") & (category == REAL) & ~F.coalesce("demo", F.lit(True))).alias("measured"),
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    joined = sessions.select(key, "demo").join(found, F.col(key).eqNullSafe(F.col("of")), "left")
    demo, user = yes("demo") | yes("shown"), yes("uploaded")
    return joined.select(
        key, *[F.coalesce(n, F.array().cast("array<string>")).alias(n) for n in SOURCE_KINDS.values()],
        demo.alias("contains_demo_synthetic"), user.alias("contains_user_upload"), yes("measured").alias("contains_real_instrument_data"),
        F.when(demo & user, "MIXED/DEMO-SYNTHETIC").when(demo, DEMO).otherwise("USER_OR_INSTRUMENT_DATA/UNVERIFIED").alias("overall"),
        F.when(demo, "WORKFLOW_VALIDATION_ONLY").otherwise("SCIENTIFIC_REVIEW_REQUIRED").alias("workflow_use"),
    )
