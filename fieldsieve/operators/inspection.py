"""Merging inspection results into candidates; what is missing is held."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(candidates: DataFrame, results: DataFrame) -> DataFrame:
    """candidates with the inspection's signals and safety; rows that no inspection saw are held.

    results: uuid, safety_state, safety_flags, pixel_available, vision_labels, detected_face_count.
    """
    rows = candidates.join(results, "uuid", "left")
    seen = F.col("safety_state").isNotNull()
    held = ~seen | F.col("safety_state").isin("hold", "unavailable") | ~F.coalesce("pixel_available", F.lit(False))
    labels = F.array_join(F.slice(F.coalesce("vision_labels", F.array().cast("array<string>")), 1, 6), "; ")
    faces = F.when(F.coalesce("detected_face_count", F.lit(0)) > 0, F.concat(F.col("detected_face_count"), F.lit(" visible face(s)")))
    flags = F.array_join(F.coalesce("safety_flags", F.array().cast("array<string>")), "; ")
    return rows.select(
        candidates["*"], F.concat_ws("; ", faces, F.nullif(labels, F.lit(""))).alias("machine_visible_signals"),
        F.when(held, "hold").otherwise("clear-automated").alias("safety_status"),
        F.when(~seen, "no inspection").when(flags != "", flags).when(held, "local pixels unavailable").otherwise("").alias("safety_reason"),
    )


def pending(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Ids still to inspect: a resumed run repeats nothing that is done."""
    return wanted.join(done.select("uuid"), "uuid", "left_anti")
