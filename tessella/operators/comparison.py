"""Comparison of two runs before a promotion, and the citations of a ranking."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.texts import fresh_name

CITED = 5


def _present(column: Column | str) -> Column:
    """Whether a text is neither null nor blank."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))


def promotion(runs: DataFrame, pair: str, role: str, same: list[str], distinct: dict[str, list[str]], eligible: Column) -> DataFrame:
    """(pair, reasons, decision): whether an expert should review the candidate of a pair.

    ``runs`` has the roles BASELINE and CANDIDATE; others are passed over. The
    columns ``same`` must be present and equal, and of the columns of each entry
    of ``distinct`` at least one must differ; a null never differs. The
    candidate must also be ``eligible`` (null: no). A pair that lacks a run or
    has several of a role is held for that alone. Two runs meet in one
    aggregation, so a pair of many rows is reduced before the shuffle. Null
    pairs are one pair.
    """
    columns = list(dict.fromkeys([*same, *(c for group in distinct.values() for c in group)]))
    run = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.coalesce(eligible, F.lit(False)).alias("eligible"))
    is_role = {r: F.col("_role") == r for r in ("BASELINE", "CANDIDATE")}
    rows = runs.where(F.col(role).isin(*is_role)).select(F.col(pair).alias("pair"), F.col(role).alias("_role"), run.alias("_run"))
    met = rows.groupBy("pair").agg(
        *[F.count_if(at).alias(f"n_{r}") for r, at in is_role.items()], *[F.min(F.when(at, F.col("_run"))).alias(r) for r, at in is_role.items()]
    )
    side = {c: (F.col(f"BASELINE.c{i}"), F.col(f"CANDIDATE.c{i}")) for i, c in enumerate(columns)}
    one_each = (F.col("n_BASELINE") == 1) & (F.col("n_CANDIDATE") == 1)
    reasons = [F.when(F.col(f"n_{r}") == 0, f"{r}_MISSING") for r in is_role] + [F.when(F.col(f"n_{r}") > 1, f"{r}_REPEATED") for r in is_role]
    for c in same:
        b, k = side[c]
        reasons.append(F.when(one_each & ~(_present(b) & F.coalesce(b == k, F.lit(False))), f"{c}_DIFFERS"))
    for name, group in distinct.items():
        differs = F.lit(False)
        for b, k in (side[c] for c in group):
            differs = differs | F.coalesce(b != k, F.lit(False))
        reasons.append(F.when(one_each & ~differs, f"{name}_NOT_DISTINCT"))
    reasons.append(F.when(one_each & ~F.col("CANDIDATE.eligible"), "CANDIDATE_INELIGIBLE"))
    found = met.select("pair", F.array_compact(F.array(*reasons)).alias("reasons"))
    return found.withColumn("decision", F.when(F.size("reasons") == 0, "EXPERT_REVIEW_REQUIRED").otherwise("HOLD"))


def citations(hits: DataFrame, keys: list[str], role: str, order: list[Column], source: list[str], review: str, most: int = CITED) -> DataFrame:
    """``hits`` that are cited, with ``position`` (from 1) and ``source_status``.

    Of each group of ``keys`` and ``role`` the first ``most`` by ``order`` are
    looked at; those without ``artifact_id`` or ``citation_id`` go, and of equal
    (role, artifact_id, citation_id) the first stays. A source is recorded if any
    column of ``source`` and ``review`` are neither null nor blank. Spark cuts
    groups to ``most`` rows a task before it shuffles, and the second window
    reuses the first one's partitioning.
    """
    first = F.row_number().over(Window.partitionBy(*keys, role).orderBy(*order))
    looked = hits.withColumn("position", first).where(F.col("position") <= most)
    named = looked.where(_present("artifact_id") & _present("citation_id"))
    again = F.row_number().over(Window.partitionBy(*keys, role, "artifact_id", "citation_id").orderBy("position"))
    k = fresh_name(named, "again")
    cited = named.withColumn(k, again).where(F.col(k) == 1).drop(k)
    recorded = F.lit(False)
    for c in source:
        recorded = recorded | _present(c)
    status = F.when(recorded & _present(review), "SOURCE_AND_REVIEW_RECORDED").otherwise("SOURCE_METADATA_INCOMPLETE")
    return cited.withColumn("source_status", status)
