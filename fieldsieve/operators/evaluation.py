"""Evaluation gates of a review: every configured view on its own, and all of them together."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from . import identity as idt
from .feedback import feedback_errors
from .selection import is_hold

# Modes of a view, and what a policy that does not say means.
MATERIAL, SPARSE = "material", "sparse-hypothesis"
DEFAULTS = {
    "minimum_eval_precision": 0.75, "minimum_eval_coverage": 0.8, "minimum_view_eval_precision": 0.65, "minimum_view_eval_sample": 2, "maximum_eval_uncertainty": 0.25,
}


def setting(policy: dict[str, Any], name: str) -> float:
    return float(policy.get(name, DEFAULTS[name]))


def configured_views(feedback: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """The views of a policy that have a quota: a row each, so a small table."""
    common = setting(policy, "minimum_view_eval_precision")
    rows = [(v["id"], v.get("label", v["id"]), v.get("evaluation_mode", MATERIAL), int(v["quota"]), float(v.get("minimum_eval_precision", common))) for v in policy["views"] if int(v["quota"]) > 0]
    return feedback.sparkSession.createDataFrame(rows, "view string, label string, evaluation_mode string, quota long, gate double")


def judgment(c: Column) -> Column:
    return F.lower(x.strip(c))


def counts(feedback: DataFrame) -> dict[str, Column]:
    said = judgment(F.col("judgment"))
    return {
        "sampled": F.count("*"), "judged": F.count_if(said.isin(*x.JUDGMENTS)), "fit": F.count_if(said == "fit"),
        "reject": F.count_if(said == "reject"), "uncertain": F.count_if(said == "uncertain"),
    }


def view_gates(feedback: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """A row for each view that has a quota, sampled or not: counts, rates, Wilson bounds, gates and why it fails.

    In a view that is a sparse hypothesis neither precision nor the number of decisive judgments counts.
    """
    largest = F.max(F.coalesce(x.strip(F.col("view_selected_count")).try_cast("long"), F.lit(0)))  # of a sampled row that does not say, none
    by_view = feedback.groupBy(F.col("primary_view").alias("view")).agg(*[c.alias(n) for n, c in counts(feedback).items()], largest.alias("largest"))
    rows = configured_views(feedback, policy).join(by_view, "view", "left").fillna(0, ["sampled", "judged", "fit", "reject", "uncertain"])
    rows = rows.withColumn("decisive", F.col("fit") + F.col("reject")).withColumns({
        "coverage": F.coalesce(F.try_divide("judged", "sampled"), F.lit(0.0)), "uncertainty": F.coalesce(F.try_divide("uncertain", "judged"), F.lit(0.0)),
        "precision": F.try_divide("fit", "decisive"), "required_decisive": F.least(F.lit(int(setting(policy, "minimum_view_eval_sample"))), F.coalesce("largest", "quota")),
    })
    low, high = x.wilson(F.col("fit"), F.col("decisive"))
    material = F.col("evaluation_mode") == MATERIAL
    failing = x.reasons(
        (F.col("sampled") == 0, "view not sampled"), (F.col("coverage") < setting(policy, "minimum_eval_coverage"), "coverage below minimum"),
        (F.col("uncertainty") > setting(policy, "maximum_eval_uncertainty"), "uncertainty above maximum"),
        (material & (F.col("decisive") < F.col("required_decisive")), "insufficient decisive judgments"),
        (material & (F.col("precision").isNull() | (F.col("precision") < F.col("gate"))), "precision below minimum"),
    )
    rows = rows.withColumns({"wilson_low": low, "wilson_high": high, "minimum_precision": F.when(material, F.col("gate")), "failure_reasons": failing})
    return rows.drop("largest", "quota", "gate").withColumn("passed", F.size("failure_reasons") == 0)


def global_gate(feedback: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """One row: counts over all feedback, judgments without a visible reason, held rows, views that fail, and the verdict."""
    said = judgment(F.col("judgment")).isin(*x.JUDGMENTS)
    extra = [F.count_if(said & (x.strip(F.col("visible_reason")) == "")).alias("missing_reasons"), F.count_if(is_hold(feedback)).alias("safety_blocks")]
    whole = feedback.agg(*[c.alias(n) for n, c in counts(feedback).items()], *extra)
    failed = view_gates(feedback, policy).agg(F.count_if(~F.col("passed")).alias("failed_views"))
    rows = whole.crossJoin(failed).withColumns({  # rows of one each
        "coverage": F.coalesce(F.try_divide("judged", "sampled"), F.lit(0.0)), "precision": F.coalesce(F.try_divide(F.col("fit"), F.col("fit") + F.col("reject")), F.lit(0.0)),
    })
    passed = (F.col("coverage") >= setting(policy, "minimum_eval_coverage")) & (F.col("precision") >= setting(policy, "minimum_eval_precision"))
    return rows.withColumn("passed", passed & (F.col("failed_views") == 0) & (F.col("missing_reasons") == 0) & (F.col("safety_blocks") == 0))


def gates(feedback: DataFrame, policy: dict[str, Any]) -> dict[str, Any]:
    """The gates as a dictionary, rates with four digits: a row for each view and one for all."""
    short = lambda v: round(v, 4) if isinstance(v, float) else v
    whole = {k: short(v) for k, v in global_gate(feedback, policy).first().asDict().items()}
    views = {r["view"]: {k: short(v) for k, v in r.asDict().items() if k != "view"} for r in view_gates(feedback, policy).collect()}
    return whole | {"by_view": dict(sorted(views.items()))}


def bindings(feedback: DataFrame, policy: dict[str, Any], master: DataFrame) -> DataFrame:
    """One row: the ids and digests that tie an evaluation to a master, its sample, the feedback and the policy."""
    one = idt.master_digest(master).select(idt.proposal_id(F.col("digest")).alias("proposal_id"), F.col("digest").alias("master_sha256"))
    said = idt.feedback_digest(feedback).select(F.col("digest").alias("feedback_sha256"))
    drawn = feedback.agg(F.min("sample_sha256").alias("sample_sha256"))
    return one.crossJoin(said).crossJoin(drawn).withColumn("config_sha256", F.lit(idt.policy_digest(policy)))  # rows of one each


def report(feedback: DataFrame, policy: dict[str, Any], master: DataFrame, inspections: DataFrame | None = None) -> dict[str, Any]:
    """The gates of feedback that is exactly the sample of exactly this master, and what binds it; fails for any other."""
    if bad := feedback_errors(feedback, master, policy, inspections).orderBy("uuid").first():
        raise ValueError(f"evaluation feedback, row {bad.uuid!r}: {'; '.join(bad.errors)}")
    said = judgment(F.col("judgment"))
    if unknown := [r[0] for r in feedback.select(said.alias("j")).filter((F.col("j") != "") & ~F.col("j").isin(*x.JUDGMENTS)).distinct().orderBy("j").limit(5).collect()]:
        raise ValueError(f"unknown evaluation judgments: {', '.join(unknown)}")
    return bindings(feedback, policy, master).first().asDict() | gates(feedback, policy)
