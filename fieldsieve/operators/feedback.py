"""Review samples as rows to fill in, and what binds returned feedback to the exact sample and master."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from . import identity as idt
from .identity import field
from .review import sample

# Columns that reviewers fill in, and the words for how a row was drawn.
JUDGMENT_COLUMNS = ("judgment", "evaluation_note", "visible_reason", "error_category", "reviewer_actor", "reviewer_lens")
INSPECTION_COLUMNS = ("inspection_path", "inspection_sha256", "inspection_round_id", "inspection_sample_sha256")
FULL, DRAWN = "full sparse view", "score boundary and deterministic random stratum sample"
REVIEW_FIELDS = ("uuid", "primary_view", "assigned_view", "score_total", "sampling_reason", "view_selected_count", "proposal_id", "master_sha256", "config_sha256", "round_id", "sample_sha256")


def review_sample(master: DataFrame, per_view: int, seed: int, round_id: str = "round-01") -> DataFrame:
    """The sample of a master with blank judgments, how each row was drawn, and the sample's digest."""
    rows = sample(master, per_view, seed).drop("pos")
    why = F.when(F.col("view_selected_count") <= per_view, FULL).otherwise(DRAWN)
    rows = rows.withColumns({"sampling_reason": why, "view_selected_count": F.col("view_selected_count").cast("string"), "round_id": F.lit(round_id)} | {c: F.lit("") for c in (*JUDGMENT_COLUMNS, *INSPECTION_COLUMNS)})
    one = idt.sample_digest(rows).select(F.col("digest").alias("sample_sha256"))
    return rows.crossJoin(F.broadcast(one))  # one row


def feedback_errors(feedback: DataFrame, master: DataFrame, policy: dict[str, Any], inspections: DataFrame | None = None) -> DataFrame:
    """(uuid, errors) of feedback that is not exactly the sample of exactly this master.

    inspections (inspection_path, digest) are the artifacts at hand; without them their digests are
    checked for their form only. Sampled rows that the feedback lacks are errors under their id.
    """
    rounds = [r[0] for r in feedback.select(x.strip(field(feedback, "round_id"))).distinct().limit(2).collect()]
    if len(rounds) != 1 or not rounds[0]:
        raise ValueError("feedback must share one round_id")
    one = idt.master_digest(master).select(F.col("digest").alias("_digest"), idt.proposal_id(F.col("digest")).alias("_proposal"))
    own = master.select(F.col("uuid").alias("_id"), idt.assigned(master).alias("_view"), (field(master, "config_sha256") == idt.policy_digest(policy)).alias("_policy"))
    sizes = own.groupBy(F.col("_view").alias("_v")).agg(F.count("*").alias("_size"))
    drawn = review_sample(master, int(policy["evaluation_sample_per_view"]), int(policy["seed"]), rounds[0]).select(F.col("uuid").alias("_drawn"), F.col("sample_sha256").alias("_sample"), F.col("sampling_reason").alias("_why"))
    own = own.join(sizes, F.col("_view") == F.col("_v"), "left").join(drawn, F.col("_id") == F.col("_drawn"), "left")
    again = feedback.groupBy(x.strip(F.col("uuid")).alias("_u")).agg((F.count("*") > 1).alias("_again"))
    rows = feedback.join(own, F.col("uuid") == F.col("_id"), "left").join(again, x.strip(F.col("uuid")) == F.col("_u")).crossJoin(F.broadcast(one))
    told = lambda c: x.strip(field(feedback, c))
    differs = lambda c, other: F.coalesce(told(c) != other, F.lit(True))
    form = ~told("inspection_sha256").rlike("^[a-f0-9]{64}$")
    if inspections is not None:
        rows = rows.join(inspections.select(F.col("inspection_path").alias("_path"), F.col("digest").alias("_found")), told("inspection_path") == F.col("_path"), "left")
        form |= F.coalesce(F.col("_found") != told("inspection_sha256"), F.lit(True))
    known = F.col("_id").isNotNull()
    checks: list[tuple[Column, str]] = [
        (told("uuid") == "", "blank id"), (F.col("_again"), "repeated id"), (~known, "outside the exact master"), (known & F.col("_drawn").isNull(), "not in the sample"),
        (known & ~F.coalesce(F.col("_policy"), F.lit(False)), "master is bound to another policy"), (known & differs("primary_view", F.col("_view")), "view differs"), (known & differs("assigned_view", F.col("_view")), "assigned_view differs"),
        (differs("proposal_id", F.col("_proposal")), "proposal_id differs"), (differs("master_sha256", F.col("_digest")), "master_sha256 differs"), (differs("config_sha256", F.lit(idt.policy_digest(policy))), "config_sha256 differs"),
        (known & (differs("sample_sha256", F.col("_sample")) | differs("sampling_reason", F.col("_why"))), "sample identity differs"), (form, "inspection digest differs"), (differs("inspection_round_id", F.lit(rounds[0])), "inspection of another round"),
        (known & differs("inspection_sample_sha256", F.col("_sample")), "inspection of another sample"), (known & F.coalesce(told("view_selected_count").try_cast("long") != F.col("_size"), F.lit(True)), "view_selected_count differs"),
    ]
    out = rows.select("uuid", x.reasons(*checks).alias("errors")).filter(F.size("errors") > 0)
    missing = drawn.join(feedback.select(F.col("uuid").alias("_drawn")), "_drawn", "left_anti").select(F.col("_drawn").alias("uuid"), F.array(F.lit("sampled row without feedback")).alias("errors"))
    return out.unionByName(missing)


def review_records(rows: DataFrame, previews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, errors): sampled rows with their verified preview, or why one cannot be shown.

    previews: uuid, preview_path, preview_sha256, decode_status, and found_sha256, the digest of the file at hand.
    """
    index = previews.select(x.canonical_id(F.col("uuid")).alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("preview_path", "preview_sha256", "decode_status", "found_sha256")])
    twice = index.groupBy(F.col("_id").alias("_i")).agg((F.count("*") > 1).alias("_twice"))
    own = rows.groupBy(x.canonical_id(F.col("uuid")).alias("_o")).agg((F.count("*") > 1).alias("_again"))
    id_ = x.canonical_id(F.col("uuid"))
    met = rows.join(own, id_ == F.col("_o")).join(index.dropDuplicates(["_id"]), id_ == F.col("_id"), "left").join(twice, id_ == F.col("_i"), "left")
    met = met.withColumn("errors", x.reasons(
        ((id_ == "") | F.col("_again"), "ids must be unique and not blank"), (F.col("_id").isNull(), "no preview"), (F.coalesce("_twice", F.lit(False)), "preview ids repeat"),
        (F.lower(x.strip(field(rows, "safety_status"))).isin(*x.BLOCKED_STATES), "blocked safety state"), (F.col("_id").isNotNull() & (F.lower(x.strip(F.col("_decode_status"))) != "ok"), "preview does not decode"),
        (~F.coalesce(F.startswith("_preview_path", F.lit("/")), F.lit(True)), "preview path is not absolute"), (F.coalesce(F.col("_preview_sha256") != F.col("_found_sha256"), F.col("_id").isNotNull()), "preview digest differs"),
    ))
    errors = met.filter(F.size("errors") > 0).select("uuid", "errors")
    suffix = F.regexp_extract(F.lower("_preview_path"), r"(\.[a-z0-9]+)$", 1)
    image = F.concat(F.substring("_found_sha256", 1, 24), F.when(suffix == "", ".jpg").otherwise(suffix))
    fields = [field(rows, c).alias(c) for c in REVIEW_FIELDS if c != "uuid"]
    bound = [F.col("_found_sha256").alias("inspection_sha256"), field(rows, "round_id").alias("inspection_round_id"), field(rows, "sample_sha256").alias("inspection_sample_sha256")]
    return met.filter(F.size("errors") == 0).select(id_.alias("uuid"), *fields, image.alias("image"), *bound), errors
