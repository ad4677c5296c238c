"""Sampling for review, evaluation gates, validation, leakage audits, membership checks, publication."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable


def ranked(rows: DataFrame, part: str, *order: Column) -> DataFrame:
    """rows with ``pos`` (from 0) and ``size`` within part, however large a part is: sorted by ranges,
    numbered within tasks, shifted by the counts of the tasks before."""
    keys = [F.col(part), *order]
    sorted_ = durable(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()))
    chunk = F.shiftright("_id", 33)
    counts = sorted_.groupBy(F.col(part).alias("_p"), chunk.alias("_c")).agg(F.count("*").alias("_n"), F.min("_id").alias("_least"))
    before = Window.partitionBy("_p").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(Window.partitionBy("_p"))}).drop("_n")
    out = sorted_.withColumn("_c0", chunk).join(shifts, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_c0") == F.col("_c")))
    return out.withColumn("pos", F.col("_before") + F.col("_id") - F.col("_least")).select(*rows.columns, "pos", "size")


def sample_positions(counts: dict[str, int], per_view: int, seed: int) -> list[tuple[str, int]]:
    """Places to review in each view: weakest, middle, strongest, the rest drawn from one seeded stream."""
    draw, out = random.Random(seed), []
    for view in sorted(counts):
        n = counts[view]
        places = set(range(n)) if n <= per_view else {0, n // 2, n - 1}
        while len(places) < min(n, per_view):
            places.add(draw.randrange(n))
        out += [(view, p) for p in sorted(places)[:per_view]]
    return out


def sample(master: DataFrame, per_view: int, seed: int) -> DataFrame:
    """The review sample of master, with pos and view_selected_count."""
    placed = durable(ranked(master, "primary_view", F.col("score_total").cast("double"), F.col("uuid")))
    counts = {r.primary_view: r.n for r in placed.groupBy("primary_view").agg(F.count("*").alias("n")).collect()}  # one row per view
    wanted = master.sparkSession.createDataFrame(sample_positions(counts, per_view, seed) or [("", -1)], "primary_view string, pos long")
    return placed.join(F.broadcast(wanted), ["primary_view", "pos"]).withColumnRenamed("size", "view_selected_count")


def evaluate(reviews: DataFrame, minimum: float = 0.5, coverage: float = 0.3, uncertain: float = 0.2) -> DataFrame:
    """One row per view: counts, rates, Wilson interval, and why its gate fails."""
    judged = F.col("judgment").isin(*x.JUDGMENTS)
    out = reviews.groupBy("primary_view").agg(
        F.count("*").alias("sampled"), F.count_if(judged).alias("judged"), F.count_if(F.col("judgment") == "fit").alias("fit"),
        F.count_if(F.col("judgment") == "reject").alias("reject"), F.count_if(F.col("judgment") == "uncertain").alias("uncertain"),
    )
    decisive = F.col("fit") + F.col("reject")
    out = out.withColumn("decisive", decisive).withColumns({
        "precision": F.try_divide(F.col("fit"), F.col("decisive")), "coverage": F.try_divide(F.col("judged"), F.col("sampled")), "uncertainty": F.try_divide(F.col("uncertain"), F.col("judged")),
    })
    low, high = x.wilson(F.col("fit"), F.col("decisive"))
    failing = x.reasons(
        (F.col("decisive") == 0, "no decisive judgment"), (F.coalesce(F.col("coverage"), F.lit(0.0)) < coverage, "coverage below minimum"),
        (F.coalesce(F.col("precision"), F.lit(0.0)) < minimum, "precision below minimum"), (F.coalesce(F.col("uncertainty"), F.lit(0.0)) > uncertain, "uncertainty above maximum"),
    )
    return out.withColumns({"wilson_low": low, "wilson_high": high, "failure_reasons": failing}).withColumn("passed", F.size("failure_reasons") == 0)


def validation(master: DataFrame, holds: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(check, failures) of the invariants of a master selection."""
    spark = master.sparkSession
    want = spark.createDataFrame(sorted(quotas.items()), "primary_view string, quota long")
    got = master.groupBy("primary_view").agg(F.count("*").alias("n"))
    checks = {
        "duplicate ids": master.groupBy("uuid").count().filter("count > 1"), "held rows selected": master.join(holds.select("uuid"), "uuid", "left_semi"),
        "views off quota": want.join(got, "primary_view", "full").filter("coalesce(quota, 0) <> coalesce(n, 0)"), "unknown views": got.join(want, "primary_view", "left_anti"),
        "blank ids": master.filter(x.strip(F.col("uuid")) == ""),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures")
        out = row if out is None else out.unionByName(row)
    return out


def relation_tokens(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Distinct field:value tokens of the relation fields that are filled."""
    tokens = F.array_compact(F.array(*[F.when(x.strip(F.col(f)) != "", F.concat(F.lit(f"{f}:"), x.strip(F.col(f)))) for f in fields]))
    return rows.select(F.explode(tokens).alias("token")).distinct()


def split_audit(left: DataFrame, right: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """One row: shared ids, shared relation tokens, repeated ids on each side, and the verdict."""
    ids = [d.select(x.canonical_id(F.col("uuid")).alias("id")) for d in (left, right)]
    shared = ids[0].intersect(ids[1]).agg(F.count("*").alias("shared_ids"))
    tokens = relation_tokens(left, fields).intersect(relation_tokens(right, fields)).agg(F.count("*").alias("shared_relations"))
    extra = [d.agg((F.count("*") - F.count_distinct("id")).alias(n)) for d, n in zip(ids, ("left_surplus", "right_surplus"), strict=True)]
    out = shared.crossJoin(tokens).crossJoin(extra[0]).crossJoin(extra[1])  # rows of one each
    return out.withColumn("passed", (F.col("shared_ids") + F.col("shared_relations") + F.col("left_surplus") + F.col("right_surplus")) == 0)


def membership_diff(planned: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """keys with ``status``: missing (planned only) or unexpected (actual only)."""
    a, b = planned.select(keys).distinct(), actual.select(keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("status", F.lit("unexpected")))


PUBLIC_STATES = ("cleared",)
REQUIRED = ("public_title", "credit", "license")


def publication_errors(rows: DataFrame) -> Column:
    """Why a cleared row may not be published."""
    checks = [(x.strip(F.col(c)) == "", f"{c} missing") for c in REQUIRED]
    checks += [(x.public_text_error(F.col(c)), f"{c} unsafe") for c in REQUIRED]
    checks.append((~x.iso_date(F.col("cleared_on")), "cleared_on is no date"))
    checks.append((~F.col("primary_view").isNotNull(), "view missing"))
    return x.reasons(*checks)


def public_handoff(rows: DataFrame, salt: bytes, destination: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(public rows, errors): all or nothing - any error, or two rows of one public id, empties the output."""
    cleared = rows.filter(F.col("clearance").isin(*PUBLIC_STATES)).withColumn("errors", publication_errors(rows)).withColumn("public_id", x.public_id(salt, F.lit(destination), F.col("uuid")))
    cleared = durable(cleared)
    errors = cleared.filter(F.size("errors") > 0).select("uuid", "errors")
    twice = cleared.groupBy("public_id").agg(F.count("*").alias("n"), F.min("uuid").alias("uuid")).filter("n > 1").select("uuid", F.array(F.lit("public id repeats")).alias("errors"))
    errors = errors.unionByName(twice)
    public = cleared.select("public_id", *fields)
    return (public if errors.isEmpty() else public.limit(0)), errors
