"""Publication: a clearance ledger closed by default, its gates, and an all-or-nothing public projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable
from .identity import field, master_digest, proposal_id, require_bound

# Fields and states of ledgers and projections.
PUBLIC_FIELDS = (
    "public_id", "primary_view", "page_slot", "publication_status", "rights_status", "consent_status", "claim_status", "alt_text", "caption", "credit", "crop", "focal_point",
    "public_destination", "publication_decision_id", "review_date",
)
DECISION_FIELDS = (
    "uuid", "proposal_id", "master_sha256", "publication_status", "rights_status", "consent_status", "claim_status", "safety_status", "caption", "alt_text", "credit", "crop",
    "focal_point", "page_slot", "public_destination", "reviewer_actor", "reviewer_lens", "review_date",
)
CLEARING = ("cleared-for-specific-use", "published")
CLEAR = {"rights_status": ("owner-verified", "licensed", "public-domain"), "consent_status": ("cleared-for-use", "not-applicable"), "claim_status": ("visible-only", "provenance-backed")}
CLOSED = {"publication_status": "not-reviewed", "rights_status": "unknown", "consent_status": "unknown", "claim_status": "caption-review", "safety_status": "human-needs-review"}
OPEN_FIELDS = ("caption", "alt_text", "credit", "crop", "focal_point", "page_slot", "public_destination", "reviewer_actor", "reviewer_lens", "review_date")
TEXT_FIELDS = ("caption", "alt_text", "credit", "crop", "focal_point", "page_slot")


def scaffold(master: DataFrame) -> DataFrame:
    """A clearance row for each row of the exact bound master, with nothing cleared; fails for any other."""
    require_bound(master, "a clearance scaffold")
    one = master_digest(master).select(proposal_id(F.col("digest")).alias("proposal_id"), F.col("digest").alias("master_sha256"))
    rows = master.select("uuid", *[field(master, c).alias(c) for c in ("filename", "primary_view")]).crossJoin(F.broadcast(one))  # one row
    return rows.select("*", *[F.lit(v).alias(k) for k, v in CLOSED.items()], *[F.lit("").alias(c) for c in OPEN_FIELDS])


def state(rows: DataFrame, name: str) -> Column:
    return F.lower(x.strip(field(rows, name)))


def decision_id(rows: DataFrame) -> Column:
    return x.decision_id(*[field(rows, c) for c in DECISION_FIELDS])


def unsafe(c: Column, name: str) -> list[tuple[Column, str]]:
    nul = F.instr(x.text(c), "\0") > 0
    return [(nul, f"{name} contains a null byte"), (~nul & x.public_text_error(c), f"{name} begins with a spreadsheet formula marker")]


def clearance_errors(rows: DataFrame, destination: str) -> Column:
    """Why a row may not be published; rows have master_view, master_digest and master_proposal of the exact master."""
    blank = lambda c: x.strip(field(rows, c)) == ""
    checks = [(x.strip(field(rows, "proposal_id")) != F.col("master_proposal"), "proposal identity"), (x.strip(field(rows, "master_sha256")) != F.col("master_digest"), "master identity")]
    labels = {"rights_status": "rights clearance", "consent_status": "scoped consent", "claim_status": "claim support"}
    checks += [(~state(rows, c).isin(*CLEAR[c]), labels[c]) for c in CLEAR]
    checks += [(state(rows, "safety_status") != "clear", "human safety review"), (x.strip(field(rows, "public_destination")) != destination, "destination binding"), (state(rows, "reviewer_lens") != "human-review", "human publication authority")]
    checks += unsafe(F.col("master_view"), "primary_view")
    checks += [(blank("reviewer_actor"), "identified reviewer"), (blank("review_date"), "review date"), (blank("caption"), "caption"), (blank("alt_text"), "alt text"), (blank("credit"), "credit")]
    for c in TEXT_FIELDS:
        checks += unsafe(field(rows, c), c)
    checks.append((~blank("review_date") & ~x.iso_date(field(rows, "review_date")), "ISO review date"))
    return x.reasons(*checks)


def against_master(master: DataFrame, clearance: DataFrame, destination: str) -> DataFrame:
    """The clearing rows of a ledger with ``errors``. Rows outside the master, blank and repeated ids are errors whatever their state."""
    one = master_digest(master).select(F.col("digest").alias("master_digest"), proposal_id(F.col("digest")).alias("master_proposal"))
    own = master.select(F.col("uuid").alias("_id"), F.lit(True).alias("_known"), field(master, "primary_view").alias("master_view"))
    repeats = clearance.groupBy(x.strip(F.col("uuid")).alias("_twice")).agg((F.count("*") > 1).alias("_again"))
    rows = clearance.crossJoin(F.broadcast(one)).join(own, F.col("uuid") == F.col("_id"), "left").join(repeats, x.strip(F.col("uuid")) == F.col("_twice"), "left")
    outside = [(x.strip(F.col("uuid")) == "", "blank id"), (F.col("_known").isNull() & (x.strip(F.col("uuid")) != ""), "outside the exact master"), (F.col("_again"), "repeated id")]
    clearing = state(clearance, "publication_status").isin(*CLEARING)
    errors = F.concat(x.reasons(*outside), F.when(clearing, clearance_errors(rows, destination)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn("errors", errors).withColumn("clearing", clearing).filter(F.col("clearing") | (F.size("errors") > 0)).drop("_id", "_known", "_twice", "_again")


def handoff(master: DataFrame, clearance: DataFrame, salt: bytes, destination: str) -> tuple[DataFrame, DataFrame]:
    """(public rows, errors): the 15 public fields of the clearing rows, or none of them if any row of the ledger has an error.

    Fails where the master is not the exact bound one.
    """
    destination = destination.strip()
    if not destination or destination.lstrip().startswith(("=", "+", "-", "@")) or "\0" in destination:
        raise ValueError("the public destination must be a safe text")
    if len(salt) < 16:
        raise ValueError("the salt must have at least 16 bytes")
    require_bound(master, "publication")
    rows = durable(against_master(master, clearance, destination))
    made = {
        "public_id": x.public_id(salt, F.lit(destination), F.col("uuid")), "primary_view": F.col("master_view"), "page_slot": field(rows, "page_slot"), "public_destination": F.lit(destination),
        "publication_decision_id": decision_id(rows),
    } | {c: state(rows, c) for c in ("publication_status", *CLEAR)} | {c: x.strip(field(rows, c)) for c in ("alt_text", "caption", "credit", "crop", "focal_point", "review_date")}
    errors = rows.filter(F.size("errors") > 0).select("uuid", "errors")
    public = rows.filter("clearing").select(*[made[c].alias(c) for c in PUBLIC_FIELDS])
    collisions = public.groupBy("public_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("public_id").alias("uuid"), F.array(F.lit("public id collision")).alias("errors"))
    errors = errors.unionByName(collisions)
    return (public if errors.isEmpty() else public.limit(0)), errors
