"""A registry of run metrics: id, group, and an aggregate over the table that it reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    id: str
    group: str
    table: str
    value: Column


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.sum(part) / F.nullif(F.sum(whole), F.lit(0)), F.lit(0.0))


def _registry() -> dict[str, Metric]:
    c, one = F.col, F.lit(1)
    of = lambda action: F.sum((c("action") == action).cast("long"))
    gap = c("estimate") - c("true_pos")
    found = [
        Metric("accuracy", "predictive_performance", "sample", F.coalesce(F.avg("correct"), F.lit(0.0))),
        Metric("stable_accuracy", "predictive_performance", "sample", F.avg(F.when(c("stable"), c("correct")))),
        Metric("recovery_accuracy", "predictive_performance", "sample", F.coalesce(F.avg(F.when(~c("stable"), c("correct"))), F.lit(0.0))),
        Metric("alarm_count", "alarm_episode", "alarm", F.count("*")),
        Metric("alarm_matched", "alarm_episode", "alarm", F.count("true_pos")),
        Metric("alarm_matched_share", "alarm_episode", "alarm", _share(c("true_pos").isNotNull().cast("int"), one)),
        Metric("change_point_count", "change_point", "alarm", F.count(gap)),
        Metric("change_point_mae", "change_point", "alarm", F.coalesce(F.avg(F.abs(gap)), F.lit(0.0))),
        Metric("change_point_bias", "change_point", "alarm", F.coalesce(F.avg(gap), F.lit(0.0))),
        *[Metric(f"{k}_fp_count", "false_positive", "unmatched", F.sum((c("class") == k).cast("long"))) for k in ("duplicate", "early", "late", "isolated")],
        *[Metric(f"adaptation_{a}_count", "adaptation_action", "adaptation", of(a)) for a in ("reuse", "create", "maintain", "create_rejected", "episode_suppressed")],
        *[Metric(f"adaptation_{a}_precision", "adaptation_action", "adaptation", _share(((c("action") == a) & c("matched")).cast("int"), (c("action") == a).cast("int"))) for a in ("reuse", "create")],
        *[Metric(f"provisional_{r}_count", "provisional_model", "proposal", F.sum((c("reason") == r).cast("long"))) for r in ("accepted", "insufficient_data", "full_interval", "recent_interval", "full_and_recent")],
        Metric("provisional_acceptance_rate", "provisional_model", "proposal", _share((c("reason") == "accepted").cast("int"), one)),
        Metric("provisional_margin", "provisional_model", "proposal", F.coalesce(F.avg("margin"), F.lit(0.0))),
        Metric("compute_calls", "compute", "round", F.sum("calls")),
        Metric("compute_examples", "compute", "round", F.sum("examples")),
        Metric("seconds_total", "runtime", "round", F.sum("seconds")),
        Metric("seconds_max", "runtime", "round", F.max("seconds")),
        Metric("comm_messages", "communication", "transfer", F.count("*")),
        Metric("comm_up", "communication", "transfer", F.sum((c("direction") == "up").cast("long"))),
        Metric("comm_down", "communication", "transfer", F.sum((c("direction") == "down").cast("long"))),
        Metric("comm_bytes", "communication_volume", "transfer", F.sum(4 * c("values"))),
        Metric("model_count_mean", "model_population", "round", F.avg("models")),
        Metric("model_count_max", "model_population", "round", F.max("models")),
        Metric("model_count_auc", "model_population", "round", F.sum("models")),
        Metric("pair_disagreement", "model_complementarity", "pair", _share(c("c_only") + c("t_only"), c("n"))),
        Metric("pair_oracle_gain", "model_complementarity", "pair", _share(F.least("c_only", "t_only"), c("n"))),
        Metric("pair_both_correct", "model_complementarity", "pair", _share(c("both"), c("n"))),
        Metric("gradient_pairs", "shared_gradient_conflict", "cosine", F.count("cosine")),
        Metric("gradient_conflict_rate", "shared_gradient_conflict", "cosine", _share((c("cosine") < 0).cast("int"), one)),
        Metric("gradient_cosine", "shared_gradient_conflict", "cosine", F.coalesce(F.avg("cosine"), F.lit(0.0))),
        Metric("gradient_negative_cosine", "shared_gradient_conflict", "cosine", F.coalesce(F.avg(F.when(c("cosine") < 0, c("cosine"))), F.lit(0.0))),
        Metric("routing_accuracy", "soft_routing", "routed", F.avg("mixture_correct")),
        Metric("routing_oracle_accuracy", "soft_routing", "routed", F.avg("oracle_correct")),
        Metric("routing_oracle_recovery", "soft_routing", "routed", _share(c("mixture_correct"), c("oracle_correct"))),
        Metric("routing_effective_experts", "soft_routing", "routed", F.avg("effective")),
    ]
    if len({m.id for m in found}) < len(found):
        raise ValueError("metric ids must differ")
    return {m.id: m for m in found}


#: What profiles of metrics hold, by group.
PROFILES = {
    "core": ("predictive_performance",),
    "detection": ("predictive_performance", "alarm_episode", "change_point", "false_positive"),
    "adaptation": ("adaptation_action", "provisional_model"),
    "resource": ("communication", "communication_volume", "compute", "runtime", "model_population"),
    "model_diagnostics": ("model_complementarity", "shared_gradient_conflict", "soft_routing"),
}


def registry(profile: str | None = None) -> dict[str, Metric]:
    """Metrics by id, all or those of a profile."""
    found = _registry()
    return found if profile is None else {k: m for k, m in found.items() if m.group in PROFILES[profile]}


def _side_by_side(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """A full outer join by key, where null keys meet."""
    other = right.select(*[F.col(k).alias(f"__{k}") for k in key], *[c for c in right.columns if c not in key])
    both = left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "full_outer")
    return both.withColumns({k: F.coalesce(k, f"__{k}") for k in key}).drop(*[f"__{k}" for k in key])


def compute(tables: dict[str, DataFrame], key: list[str], profile: str | None = None) -> DataFrame:
    """One row for each run (``key``) with the metrics of the tables at hand; one grouped aggregate for each table."""
    out = None
    for name, rows in tables.items():
        chosen = [m.value.alias(m.id) for m in registry(profile).values() if m.table == name]
        if chosen:
            found = rows.groupBy(*key).agg(*chosen)
            out = found if out is None else _side_by_side(out, found, key)
    if out is None:
        raise ValueError("no metric reads these tables")
    return out
