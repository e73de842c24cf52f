"""Choice of measuring actions under risk budgets, and their settlement."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the utility and its thresholds.
GAIN_WEIGHT, COST_WEIGHT, RISK_WEIGHT = 0.55, 0.20, 0.25
LEAST_UTILITY, LEAST_GAIN, STOP_BELOW, EPSILON = 0.10, 0.25, 0.50, 1e-9
PRECONDITIONS = ("material_allowed", "calibration_ready", "device_ready")


def evaluate_actions(actions: DataFrame, budgets: DataFrame, uncertainty: float, blocked: list[str]) -> DataFrame:
    """Every action with gain, risk, utility, the reasons that forbid it, and whether it qualifies.

    ``actions``: action_id, pos, region, retry_key, loads (map channel -> load),
    preconditions (map), pass_rate, expected_uncertainty, cost. ``budgets``:
    region, channel, used, reserved, cap, locked; one row a region and channel.
    A channel without a budget has cap 0. Missing preconditions count as false.
    """
    load = F.col("predicted")
    held = F.coalesce(F.col("used"), F.lit(0.0)) + F.coalesce(F.col("reserved"), F.lit(0.0))
    cap = F.coalesce(F.col("cap"), F.lit(0.0))
    loads = actions.select("action_id", "region", F.explode("loads").alias("channel", "predicted"))
    channels = (
        loads.join(budgets, ["region", "channel"], "left")
        .groupBy("action_id")
        .agg(
            F.coalesce(F.bool_or("locked"), F.lit(False)).alias("locked"),
            F.bool_or(held + load > cap + EPSILON).alias("over"),
            F.max(F.least(F.lit(1.0), load / F.greatest(F.lit(EPSILON), cap - held))).alias("risk"),
        )
    )
    gain = F.col("pass_rate") * F.greatest(F.lit(0.0), F.lit(uncertainty) - F.col("expected_uncertainty"))
    risk = F.coalesce("risk", F.lit(0.0))
    utility = GAIN_WEIGHT * gain - COST_WEIGHT * F.col("cost") - RISK_WEIGHT * risk
    missing = [F.when(~F.coalesce(F.col("preconditions")[p], F.lit(False)), f"NOT_{p.upper()}") for p in PRECONDITIONS]
    reasons = F.array_compact(
        F.array(
            F.when(F.col("retry_key").isin(blocked), "RETRY_BLOCKED"), *missing,
            F.when(F.col("locked"), "CHANNEL_LOCKED"), F.when(F.col("over"), "OVER_BUDGET"),
        )
    )
    out = actions.join(channels, "action_id", "left").select(
        "action_id", "pos", "region", gain.alias("gain"), risk.alias("risk"), utility.alias("utility"), reasons.alias("reasons")
    )
    fits = (F.size("reasons") == 0) & (F.col("utility") >= LEAST_UTILITY) & (F.col("gain") >= LEAST_GAIN)
    return out.withColumn("qualifies", fits)


def choose_action(evaluated: DataFrame, uncertainty: float, *keys: str) -> DataFrame:
    """The best qualifying action, of each key if any are named: utility, then less risk, then input order; none if certain enough."""
    if uncertainty <= STOP_BELOW:
        return evaluated.limit(0)
    rest = [c for c in evaluated.columns if c not in keys]
    best = F.max(F.struct("utility", (-F.col("risk")).alias("less_risk"), (-F.col("pos")).alias("earlier"), F.struct(*rest).alias("row")))
    return evaluated.where("qualifies").groupBy(*keys).agg(best.alias("best")).where("best is not null").select(*keys, "best.row.*")


def settlement(executions: DataFrame, budgets: DataFrame, *keys: str) -> DataFrame:
    """keys, used, reserved, locked, over_limit, n_executions of every budget, once its executions are charged.

    ``executions``: keys, execution_id, seq, predicted, actual, telemetry_valid.
    ``budgets``: keys, cap, used, reserved, locked. Each execution counts once,
    however often it is reported (the last report, by seq, holds). With valid
    telemetry the actual load is charged, if it is stated and 0 at least, else the
    predicted one; without, the predicted load is charged and the budget locked.
    What was predicted is no longer reserved. A budget that is used beyond its cap
    is locked, and one that was locked stays so. Charges come before any look at
    the result's quality. Executions without a budget aren't charged.
    """
    last = executions.groupBy(*keys, "execution_id").agg(F.max(F.struct("seq", "predicted", "actual", "telemetry_valid")).alias("m"))
    valid = F.coalesce(F.col("m.telemetry_valid"), F.lit(False))
    charge = F.when(valid, F.greatest(F.lit(0.0), F.coalesce("m.actual", "m.predicted"))).otherwise(F.col("m.predicted"))
    charged = last.groupBy(*[F.col(k).alias(f"of_{k}") for k in keys]).agg(
        F.sum(charge).alias("charge"), F.sum("m.predicted").alias("freed"), F.bool_or(~valid).alias("unknown"), F.count(F.lit(1)).alias("n")
    )
    joined = budgets.join(charged, reduce(Column.__and__, [F.col(k) == F.col(f"of_{k}") for k in keys]), "left")
    used = F.round(F.coalesce("used", F.lit(0.0)) + F.coalesce("charge", F.lit(0.0)), 6)
    over = used > F.coalesce("cap", F.lit(0.0)) + EPSILON
    return joined.select(
        *keys, used.alias("used"), F.round(F.greatest(F.lit(0.0), F.coalesce("reserved", F.lit(0.0)) - F.coalesce("freed", F.lit(0.0))), 6).alias("reserved"),
        (F.coalesce("locked", F.lit(False)) | F.coalesce("unknown", F.lit(False)) | over).alias("locked"), over.alias("over_limit"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n_executions"),
    )
