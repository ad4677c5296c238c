"""Whole selection from an inventory under a policy: holds, clusters, assignment, quotas, floors, binding, and the plan of albums."""

from __future__ import annotations

import heapq
import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable
from . import evaluation as ev
from . import identity as idt
from . import selection as sel
from .identity import field

# States of an assignment and the words of a reason.
ASSIGNMENT_STATES = ("assigned", "unclassified")
RELATED = "related duplicate or burst member is held"
MASTER_KEY = "master"


def with_related_holds(rows: DataFrame) -> DataFrame:
    """rows whose relatives are held become automatic holds, with the reason added to theirs."""
    found = sel.hold_closure(rows)
    reason = F.concat_ws("; ", F.nullif(x.strip(field(rows, "safety_reason")), F.lit("")), F.lit(RELATED))
    out = found.withColumns({
        "safety_status": F.when(F.col("automatic"), "automatic-hold").otherwise(field(rows, "safety_status")),
        "safety_reason": F.when(F.col("automatic"), reason).otherwise(field(rows, "safety_reason")),
    })
    return out.drop("held", "automatic")


def reason(rows: DataFrame, view: Column) -> Column:
    """Why a row was selected: the parts that it has, joined."""
    named = lambda label, c: F.when(field(rows, c) != "", F.concat(F.lit(f"{label}: "), field(rows, c)))
    confidence = F.lower(F.when(field(rows, "evidence_confidence") == "", "unknown").otherwise(field(rows, "evidence_confidence")))
    attention = x.attention_score(x.truthy(field(rows, "favorite")), x.truthy(field(rows, "edited"))) > 0
    return F.concat_ws(
        "; ", F.concat(F.lit("editorial assignment "), view), named("assignment", "assignment_reason"), named("retrieval hypotheses", "candidate_views"),
        named("visible observation", "visible_observation"), named("machine-visible signals", "machine_visible_signals"), F.concat(F.lit("evidence confidence: "), confidence),
        F.when(F.size(x.split_values(field(rows, "persons"))) > 0, "pre-existing named people"), F.when(attention, "prior favorite/edit attention"),
    )


def assignment_errors(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """(uuid, error) of explicit assignments that are missing, unknown or of no valid state."""
    view, status = x.strip(field(rows, "assigned_view")), x.strip(field(rows, "assignment_status"))
    error = F.when(view == "", "lacks assigned_view").when(~view.isin(*[v["id"] for v in policy["views"]]), "unknown assigned_view")
    error = error.when(~F.when(status == "", "assigned").otherwise(status).isin(*ASSIGNMENT_STATES), "invalid assignment_status")
    return rows.select("uuid", error.alias("error")).filter("error is not null")


def pool_of(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """The rows that may be selected, one for each duplicate group, few for each burst, with their score."""
    free = sel.scored(rows.filter(~sel.is_hold(rows)), int(policy["seed"]))
    return sel.burst_limited(sel.duplicate_representatives(free), int(policy.get("burst_limit", 2))).withColumn("score", F.col("score_total").cast("double"))


def assigned_rows(pool: DataFrame, policy: dict[str, Any]) -> tuple[DataFrame, bool]:
    """(pool with primary_view, whether it was found by the flow): explicit assignments, or else the flow's."""
    told = pool.agg(F.count_if(x.strip(field(pool, "assigned_view")) != ""), F.count("*")).first()
    if 0 < told[0] < told[1]:
        raise ValueError("inventory cannot mix assigned and unassigned eligible rows")
    if told[0]:
        if bad := assignment_errors(pool, policy).orderBy("uuid").first():
            raise ValueError(f"inventory row {bad.uuid}: {bad.error}")
        return pool.withColumn("primary_view", x.strip(F.col("assigned_view"))), False
    quotas, rest = {v["id"]: int(v["quota"]) for v in policy["views"]}, policy["unclassified_view"]
    wanted = F.filter(x.split_values(field(pool, "candidate_views")), lambda v: v.isin(*[v for v, q in quotas.items() if q > 0]))
    wanted = F.array_distinct(F.concat(F.filter(wanted, lambda v: v != rest), F.array(F.lit(rest)) if quotas[rest] > 0 else F.array().cast("array<string>")))
    given = sel.assign(pool.select("uuid", "score", wanted.alias("views")), quotas).select("uuid", F.col("assigned_view").alias("primary_view"))
    return pool.drop("primary_view", "assigned_view").join(given, "uuid").withColumn("assigned_view", F.col("primary_view")), True


def quota_take(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """The best rows of each view up to its quota; where views fall short, the best of the rest up to the target.

    Ranks are cut where rows are read (Spark limits groups before it shuffles), so a view of any size is cheap.
    """
    quotas, target = {v["id"]: int(v["quota"]) for v in policy["views"]}, int(policy["target_count"])
    quota = F.create_map(*[F.lit(y) for kv in quotas.items() for y in kv])
    best = Window.partitionBy("primary_view").orderBy(F.desc("score"), "uuid")
    ranked = rows.filter(F.col("primary_view").isin(*quotas)).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= max(quotas.values()))
    taken = durable(ranked.filter(F.col("_n") <= F.try_element_at(quota, "primary_view")).orderBy(F.desc("score"), "uuid").limit(target).drop("_n"))
    if (short := target - taken.count()) <= 0:
        return taken
    return taken.unionByName(rows.join(taken.select("uuid"), "uuid", "left_anti").orderBy(F.desc("score"), "uuid").limit(short).select(*taken.columns))


def floor_swaps(chosen: list[tuple], incoming: list[tuple], need: int, rest: str) -> list[tuple[str, str, str]]:
    """(in, out, view): each incoming (uuid, views), best first, takes the place of the weakest of chosen (uuid, view, score), in a view it may stand in."""
    weakest: dict[str, list] = {}
    for uuid, view, score in chosen:
        weakest.setdefault(view, []).append((score, uuid))
    for heap in weakest.values():
        heapq.heapify(heap)
    swaps: list[tuple[str, str, str]] = []
    for uuid, views in incoming:
        if len(swaps) == need:
            break
        heads = [(*weakest[v][0], v) for v in {*views, rest} if weakest.get(v)]
        if heads:
            _, out, view = min(heads)
            heapq.heappop(weakest[view])
            swaps.append((uuid, out, view))
    return swaps


def raised(chosen: DataFrame, pool: DataFrame, policy: dict[str, Any], named: bool, why: str) -> DataFrame:
    """chosen with as many rows swapped as the floor for rows with (or without) named people needs.

    What decides is bounded by the target: the chosen rows, and of each list of wanted views as many of
    the best incoming rows as there can be swaps. It is decided on the driver, the rows stay in Spark.
    """
    share = float(policy.get("minimum_named_people_fraction" if named else "minimum_person_free_fraction", 0))
    good = (F.size(x.split_values(field(chosen, "persons"))) > 0) == F.lit(named)
    required = math.ceil(int(policy["target_count"]) * share)
    need = required - chosen.agg(F.count_if(good)).first()[0]
    if need <= 0:
        return chosen
    out = [tuple(r) for r in chosen.filter(~good).select("uuid", "primary_view", "score").collect()]
    views = x.split_values(field(pool, "candidate_views"))
    kind = Window.partitionBy(F.concat_ws("\x1f", F.array_sort(F.array_distinct(views)))).orderBy(F.desc("score"), "uuid")
    spare = pool.join(chosen.select("uuid"), "uuid", "left_anti").filter(good).select("uuid", "score", views.alias("views")).withColumn("_n", F.row_number().over(kind)).filter(F.col("_n") <= need)
    incoming = [(r.uuid, r.views) for r in spare.orderBy(F.desc("score"), "uuid").collect()]
    swaps = floor_swaps(out, incoming, need, policy["unclassified_view"])
    if len(swaps) < need:
        raise ValueError(f"candidate field cannot satisfy the floor for {why}")
    plan = F.broadcast(chosen.sparkSession.createDataFrame(swaps, "uuid string, _out string, _view string"))
    new = pool.drop("primary_view", "assigned_view", "assignment_status", "assignment_reason", "selection_tier", "selection_reason").join(plan, "uuid")
    new = new.withColumns({
        "primary_view": F.col("_view"), "assigned_view": F.col("_view"), "assignment_status": F.when(F.col("_view") == policy["unclassified_view"], "unclassified").otherwise("assigned"),
        "assignment_reason": F.lit(f"deterministic same-view replacement for {why}"), "selection_tier": x.selection_tier(F.lower(field(pool, "evidence_confidence"))),
        "selection_reason": F.concat(F.lit("editorial assignment "), F.col("_view"), F.lit(f"; diversity floor: {why}")),
    })
    kept = chosen.join(plan.select(F.col("_out").alias("uuid")), "uuid", "left_anti")
    return durable(kept.unionByName(new.select(*[c for c in chosen.columns if c in new.columns]), allowMissingColumns=True))


def select(inventory: DataFrame, policy: dict[str, Any]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(selected, holds, summary). Selected rows are bound to each other and to the policy; summary is one row."""
    rows = durable(with_related_holds(inventory))
    holds, pool = rows.filter(sel.is_hold(rows)), durable(pool_of(rows, policy))
    eligible, flowed = assigned_rows(pool, policy)
    state = F.coalesce(F.nullif(x.strip(field(eligible, "assignment_status")), F.lit("")), F.when(F.col("primary_view") == policy["unclassified_view"], "unclassified").otherwise("assigned"))
    eligible = eligible.withColumns({"assignment_status": state, "assignment_reason": field(eligible, "assignment_reason"), "selection_tier": x.selection_tier(F.lower(field(eligible, "evidence_confidence")))})
    chosen = durable(quota_take(eligible.withColumn("selection_reason", reason(eligible, F.col("primary_view"))), policy))
    spare = pool.join(chosen.select("uuid"), "uuid", "left_anti")  # what a floor throws out does not come back
    chosen = raised(chosen, spare, policy, True, "named relationships")
    chosen = raised(chosen, spare, policy, False, "person-free material context")
    persons = F.size(x.split_values(field(chosen, "persons"))) > 0
    target, named, whole = int(policy["target_count"]), *chosen.agg(F.count_if(persons), F.count("*")).first()
    if named < math.ceil(target * float(policy.get("minimum_named_people_fraction", 0))) or whole - named < math.ceil(target * float(policy.get("minimum_person_free_fraction", 0))):
        raise ValueError("candidate field cannot satisfy both floors")
    got = {r.primary_view: r.n for r in chosen.groupBy("primary_view").agg(F.count("*").alias("n")).collect()}
    if got != {v["id"]: int(v["quota"]) for v in policy["views"] if int(v["quota"]) > 0}:
        raise ValueError("selected view counts do not match configured quotas")
    chosen = durable(idt.bound(chosen, policy).orderBy("primary_view", F.desc("score"), "uuid"))
    uncertain = field(chosen, "evidence_confidence").isin("low", "unknown", "")
    summary = chosen.agg(F.count("*").alias("selected_count"), F.count_if(persons).alias("named_people_count"), F.count_if(uncertain).alias("uncertain_count"), F.first("master_sha256").alias("master_sha256"), F.first("proposal_id").alias("proposal_id"), F.first("config_sha256").alias("config_sha256"))
    summary = summary.withColumn("view_counts", F.lit(json.dumps(dict(sorted(got.items())), separators=(",", ":"))))
    for name, table in (("inventory_count", rows), ("eligible_count", pool), ("hold_count", holds)):
        summary = summary.crossJoin(table.agg(F.count("*").alias(name)))  # rows of one each
    return chosen, holds, summary.withColumn("assignment_method", F.lit("deterministic-constrained-maximum-flow" if flowed else "explicit-assigned-view"))


def validate(master: DataFrame, holds: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """(check, failures) for each invariant of a bound master."""
    spark, digest = master.sparkSession, idt.policy_digest(policy)
    quotas = [(v["id"], int(v["quota"])) for v in policy["views"] if int(v["quota"]) > 0]
    want = spark.createDataFrame(quotas, "primary_view string, quota long")
    got = master.groupBy("primary_view").agg(F.count("*").alias("n"))
    ids = idt.identity_errors(master).withColumn("failures", F.col("failures").cast("long"))
    rows = master.agg(
        F.abs(F.count("*") - int(policy["target_count"])).alias("rows off target"), F.count_if(sel.is_hold(master)).alias("held rows selected"),
        F.count_if(field(master, "selection_reason") == "").alias("selection reason missing"), F.count_if(field(master, "assigned_view") == "").alias("assigned view missing"),
        F.count_if(field(master, "config_sha256") != digest).alias("policy digest differs"),
    )
    rows = rows.unpivot([], [F.col(f"`{c}`") for c in rows.columns], "check", "failures")
    overlap = master.select("uuid").distinct().join(holds.select("uuid").distinct(), "uuid", "left_semi").agg(F.count("*").alias("failures"))
    both = want.join(got, "primary_view", "full")
    more = {"overlap with holds": overlap, "views absent": both.filter("n is null").agg(F.count("*").alias("failures")), "views off quota": both.filter("coalesce(quota, 0) <> coalesce(n, 0)").agg(F.count("*").alias("failures"))}
    out = ids.unionByName(rows)
    for name, row in more.items():
        out = out.unionByName(row.select(F.lit(name).alias("check"), "failures"))
    return out


def albums(master: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """(key, title, n, asset_ids): the album of all rows, then one for each view; members in the master's order. Bounded by the target."""
    order = F.struct("primary_view", -F.col("score_total").cast("double"), F.col("uuid").alias("uuid"))
    labels = F.create_map(*[F.lit(y) for v in policy["views"] for y in (v["id"], v.get("label", v["id"]))])
    title = F.concat("primary_view", F.lit(" "), F.coalesce(F.try_element_at(labels, "primary_view"), F.lit("Unlabeled View")))
    both = master.select(F.lit(MASTER_KEY).alias("key"), F.lit("00 MASTER").alias("title"), order.alias("m")).unionByName(master.select(F.concat(F.lit("view-"), "primary_view").alias("key"), title.alias("title"), order.alias("m")))
    made = both.groupBy("key", "title").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list("m")), lambda m: m["uuid"]).alias("asset_ids"))
    return made.select("key", F.concat("title", F.lit(" - "), F.format_number("n", 0)).alias("title"), "n", "asset_ids")


def validation_report(master: DataFrame, holds: DataFrame, policy: dict[str, Any]) -> dict[str, Any]:
    """The checks of a master as a dictionary, with counts and the digests that it was held against."""
    failures = {r.check: r.failures for r in validate(master, holds, policy).filter("failures > 0").collect()}
    digest, views = idt.master_digest(master).first(), {r.primary_view: r.n for r in master.groupBy("primary_view").agg(F.count("*").alias("n")).collect()}
    safety = idt.safety_digest(holds).first()
    return {
        "status": "FAIL" if failures else "PASS", "failures": dict(sorted(failures.items())), "master_count": digest.n, "hold_count": safety.n, "view_counts": dict(sorted(views.items())), "master_sha256": digest.digest,
        "proposal_id": f"pfp-{digest.digest[:16]}", "config_sha256": idt.policy_digest(policy), "safety_sha256": safety.digest,
    }


VERIFICATION = ("exact album counts", "no missing asset IDs", "no unexpected asset IDs", "no members outside source corpus", "no safety-hold overlap", "source membership unchanged")  # fixed values


def catalog_plan(
    master: DataFrame, holds: DataFrame, policy: dict[str, Any], plan_id: str, source: dict[str, Any], evaluation: dict[str, Any], feedback: DataFrame, validation: dict[str, Any], inspections: DataFrame | None = None
) -> dict[str, Any]:
    """The membership-only plan of a master. Evaluation and validation are made anew from master, feedback and holds; fails where a given report, or anything it is bound to, differs."""
    if {k: source.get(k) for k in ("identifier", "expected_count", "identifier_sha256")} != {k: policy["source"][k] for k in ("identifier", "expected_count", "identifier_sha256")}:
        raise ValueError("catalog source does not match the frozen source of the policy")
    if evaluation != ev.report(feedback, policy, master, inspections):
        raise ValueError("evaluation report does not match the exact review feedback")
    if not evaluation["passed"]:
        raise ValueError("catalog plan requires a passing evaluation")
    if validation != (found := validation_report(master, holds, policy)):
        raise ValueError("validation report does not match the exact master and safety manifest")
    if found["failures"]:
        raise ValueError(f"catalog plan requires a valid master: {', '.join(found['failures'])}")
    rows = [r.asDict() for r in albums(master, policy).orderBy(F.col("key") != MASTER_KEY, "key").collect()]
    return {
        "plan_id": plan_id, "proposal_id": found["proposal_id"], "master_sha256": found["master_sha256"],
        "evaluation": {k: evaluation[k] for k in ("proposal_id", "master_sha256", "feedback_sha256", "config_sha256", "sample_sha256", "passed")},
        "validation": {k: found[k] for k in ("status", "master_sha256", "safety_sha256")}, "source": source, "safety_mode": "create-folders-albums-and-add-membership-only",
        "expected_master_count": rows[0]["n"], "write_test_count": min(10, rows[0]["n"]), "albums": rows, "required_verification": list(VERIFICATION),
    }
