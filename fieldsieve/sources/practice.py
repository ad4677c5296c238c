"""A small made-up inventory to practise on, and made-up feedback for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the practice rows hold.
CONTEXTS = (("01", "high", "people", "Alex Example;Robin Example"), ("02", "high", "apparatus", "Robin Example"), ("03", "high", "document", ""), ("04", "medium", "place", ""), ("", "unknown", "", ""))
HOLDS = {9: "possible private document", 24: "possible private contact information"}


def inventory(spark: SparkSession, rows: int = 30) -> DataFrame:
    """Rows with five kinds of content by turns, two holds, a pair of duplicates and a burst of three; all texts."""
    i, flag = F.col("i"), lambda c: F.when(c, "true").otherwise("false")
    pick = lambda k: F.element_at(F.array(*[F.lit(c[k]) for c in CONTEXTS]), ((F.col("i") - 1) % len(CONTEXTS) + 1).cast("int"))
    view, held = pick(0), i.isin(*HOLDS)
    reason = F.when(i == 9, HOLDS[9]).when(i == 24, HOLDS[24]).otherwise("")
    return spark.range(1, rows + 1).withColumnRenamed("id", "i").select(
        F.format_string("DEMO-%03d", i).alias("uuid"), F.format_string("practice-%03d.jpg", i).alias("filename"), view.alias("candidate_views"),
        F.concat(F.when(view == "", "00").otherwise(view), F.lit(":synthetic-fixture")).alias("retrieval_basis"), pick(1).alias("evidence_confidence"), pick(2).alias("visible_observation"),
        F.lit("reviewer").alias("observation_source"), F.lit("").alias("machine_visible_signals"), pick(3).alias("persons"), flag(i % 7 == 0).alias("favorite"), flag(i % 6 == 0).alias("edited"),
        F.when(held, "hold").otherwise("clear").alias("safety_status"), reason.alias("safety_reason"), F.lit("false").alias("hidden"), F.lit("false").alias("missing"),
        F.when(i.isin(11, 12), "duplicate-a").otherwise("").alias("duplicate_group"), F.when(i.isin(16, 17, 18), "burst-a").otherwise("").alias("burst_group"),
        ((i % 5) / 5).cast("string").alias("aesthetic_score"), F.concat(F.lit("event-"), (F.floor((i - 1) / 5) + 1).cast("string")).alias("event_cluster"),
        F.format_string("2026-01-%02d", i).alias("date"), F.lit("Example City").alias("place"), F.lit("").alias("local_path"),
    )


def judged(sample: DataFrame, rejected: tuple[str, ...] = ()) -> DataFrame:
    """A review sample filled in: fit, but for the rejected ids, each bound to an inspection text of its own."""
    out = F.col("uuid").isin(*rejected) if rejected else F.lit(False)
    artifact = F.concat(F.lit("Synthetic inspection artifact for "), F.col("uuid"), F.lit(" in "), F.col("round_id"), F.lit(".\n"))
    return sample.withColumns({
        "judgment": F.when(out, "reject").otherwise("fit"), "evaluation_note": F.lit("Synthetic practice judgment; inspect real pixels in production."),
        "visible_reason": F.lit("Synthetic visible reason for workflow validation only."), "reviewer_lens": F.lit("synthetic-practice"),
        "error_category": F.when(out, "retrieval-mismatch").otherwise("visible-fit"), "inspection_path": F.concat(F.lit("/previews/evaluation/"), F.col("uuid"), F.lit(".txt")),
        "inspection_sha256": F.sha2(artifact, 256), "inspection_round_id": F.col("round_id"), "inspection_sample_sha256": F.col("sample_sha256"),
    })
