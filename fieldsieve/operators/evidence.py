"""Whether what records claim of their evidence can be made again from it: sources, evaluations, rounds, phases, events.

Every check takes any number of named records at once and gives (name, error) rows, none for a record
that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from .identity import fold_digests, lines_digests

# The phases of a run, and the share of one event in a master from which it is to be looked at.
PHASES = (
    "brief", "retrieval", "local_inspection", "recursive_evaluation", "validation", "write_test", "write_test_verification", "production_commit", "production_rerun", "idempotence_verification",
    "independent_verification",
)
CONCENTRATED = 0.8
#: Digest of no ids.
NONE = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def told(rows: DataFrame, errors: Column) -> DataFrame:
    return rows.select("name", F.explode(errors).alias("error"))


def source_errors(profiles: DataFrame, members: DataFrame) -> DataFrame:
    """profiles (name, expected_count, identifier_sha256) against their members (name, uuid)."""
    found = lines_digests(members, ["name"], F.col("uuid"))
    rows = profiles.join(found, "name", "left")
    return told(rows, x.reasons((F.coalesce("n", F.lit(0)) != F.col("expected_count"), "count differs"), (F.coalesce("digest", F.lit(NONE)) != F.col("identifier_sha256"), "digest differs")))


def evaluation_errors(reports: DataFrame, views: DataFrame) -> DataFrame:
    """reports (name, sample_count, judged_count, precision) against their views (name, sampled, judged, fit, reject); precision has four digits."""
    sums = views.groupBy("name").agg(*[F.sum(c).alias(f"_{c}") for c in ("sampled", "judged", "fit", "reject")])
    rows = reports.join(sums, "name", "left").fillna(0, ["_sampled", "_judged", "_fit", "_reject"])
    totals = (F.col("_sampled") != F.col("sample_count")) | (F.col("_judged") != F.col("judged_count"))
    precision = F.round(F.try_divide("_fit", F.col("_fit") + F.col("_reject")), 4)
    return told(rows, x.reasons((totals, "totals do not add up"), (~precision.eqNullSafe(F.round("precision", 4)) | precision.isNull(), "precision cannot be made again")))


def round_errors(rounds: DataFrame, inspected: DataFrame, required: DataFrame) -> DataFrame:
    """Two rounds of a ledger, rounds (name, round: prior or claimed, inspection_digest) with what they inspected (name, round, uuid),
    against required (name, fresh_count, cached_count): what the claimed round saw anew and what it had from the prior one."""
    digests = rounds.join(lines_digests(inspected, ["name", "round"], F.col("uuid")), ["name", "round"], "left")
    wrong = digests.filter(F.coalesce("digest", F.lit(NONE)) != F.col("inspection_digest")).select("name", F.concat(F.col("round"), F.lit(" digest differs")).alias("error"))
    seen = inspected.groupBy("name", "uuid").agg(F.bool_or(F.col("round") == "prior").alias("prior"), F.bool_or(F.col("round") == "claimed").alias("claimed"))
    counts = seen.filter("claimed").groupBy("name").agg(F.count_if(~F.col("prior")).alias("_fresh"), F.count_if("prior").alias("_cached"))
    rows = required.join(counts, "name", "left").fillna(0, ["_fresh", "_cached"])
    return wrong.unionByName(told(rows, x.reasons((F.col("_fresh") != F.col("fresh_count"), "fresh count differs"), (F.col("_cached") != F.col("cached_count"), "cached count differs"))))


def phase_errors(phases: DataFrame, wanted: tuple[str, ...] = PHASES) -> DataFrame:
    """Phases of runs (name, phase, status, artifacts): those that are no phases, that a run lacks, or that completed without evidence."""
    errors = x.reasons((~F.col("phase").isin(*wanted), "unknown phase"), ((F.col("status") == "completed") & (F.coalesce(F.size("artifacts"), F.lit(0)) < 1), "completed without evidence"))
    own = told(phases.select("name", errors.alias("e"), "phase"), F.transform("e", lambda e: F.concat(F.col("phase"), F.lit(": "), e)))
    have = phases.groupBy("name").agg(F.collect_set("phase").alias("have"))  # a run's phases
    lacking = F.transform(F.array_except(F.array(*map(F.lit, wanted)), "have"), lambda p: F.concat(p, F.lit(": missing")))
    return own.unionByName(told(have, lacking))


def concentration_errors(events: DataFrame, most: float = CONCENTRATED) -> DataFrame:
    """Masters (name, event, n) of which one event makes up this share or more."""
    whole = events.groupBy("name").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return told(whole, x.reasons((F.col("top") >= most * F.col("all"), "one event makes up too much")))


def master_errors(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """claims (name, master_sha256) of masters against their rows (name, uuid, assigned_view)."""
    row = x.canonical_json({"uuid": F.col("uuid"), "assigned_view": F.col("assigned_view")})
    found = fold_digests(rows, ["name"], row, [F.col("assigned_view"), F.col("uuid")], "[", ",", "]")
    return told(claims.join(found, "name", "left"), x.reasons((~F.coalesce(F.col("digest") == F.col("master_sha256"), F.lit(False)), "master digest differs")))
