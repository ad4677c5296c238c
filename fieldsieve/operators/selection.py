"""Holds, duplicate and burst clusters, scores, quotas, floors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable
from .graph import components

SEED = 17
DUPLICATE_FIELDS, BURST_FIELD = ("perceptual_cluster_id", "duplicate_group", "duplicate_group_id"), "burst_group"


def has(rows: DataFrame, name: str) -> Column:
    """A column, or blank where the manifest has none."""
    return F.col(name) if name in rows.columns else F.lit("")


def is_hold(rows: DataFrame) -> Column:
    return F.lower(x.strip(has(rows, "safety_status"))).isin(*x.HOLD_STATES) | x.truthy(has(rows, "hidden")) | x.truthy(has(rows, "missing"))


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds attention, evidence, noise and score_total (text with six digits)."""
    seen = F.coalesce(F.nullif(x.strip(has(rows, "visible_observation")), F.lit("")), x.strip(has(rows, "visible_context")))
    out = rows.withColumns({
        "attention": x.attention_score(x.truthy(has(rows, "favorite")), x.truthy(has(rows, "edited"))),
        "evidence": x.evidence_score(F.lower(x.strip(has(rows, "evidence_confidence"))), has(rows, "persons"), seen, F.lower(x.strip(has(rows, "observation_source")))),
        "noise": x.stable_noise(seed, F.col("uuid")),
    })
    return out.withColumn("score_total", x.six(F.col("attention") + F.col("evidence") + F.col("noise")))


def relation_edges(rows: DataFrame) -> DataFrame:
    """(uuid, group): duplicate keys share one name space, bursts have their own."""
    groups = [F.when(x.strip(F.col(c)) != "", F.concat(F.lit("duplicate:"), x.strip(F.col(c)))) for c in DUPLICATE_FIELDS if c in rows.columns]
    if BURST_FIELD in rows.columns:
        groups.append(F.when(x.strip(F.col(BURST_FIELD)) != "", F.concat(F.lit("burst:"), x.strip(F.col(BURST_FIELD)))))
    return rows.select("uuid", F.explode(F.array_distinct(F.array_compact(F.array(*groups)))).alias("group"))


def hold_closure(rows: DataFrame) -> DataFrame:
    """rows with ``held`` (directly or through relations, to the end) and ``automatic`` (through relations only).

    Components of the graph of rows and the groups that they share, then one look at each component.
    """
    slim = durable(rows.select("uuid", is_hold(rows).alias("hold"), *[F.col(c) for c in (*DUPLICATE_FIELDS, BURST_FIELD) if c in rows.columns]))
    edges = relation_edges(slim)
    shared = edges.groupBy("group").agg(F.count("*").alias("_n")).filter("_n > 1").select("group")
    row = F.concat(F.lit("row:"), "uuid")
    labels = components(edges.join(shared, "group").select(row.alias("a"), F.col("group").alias("b")))
    related = slim.select("uuid", "hold").join(labels, row == F.col("node"))
    caught = related.groupBy("label").agg(F.bool_or("hold").alias("caught")).filter("caught").select("label")
    seen = related.join(caught, "label").select("uuid").distinct()
    out = rows.join(seen.withColumn("_caught", F.lit(True)), "uuid", "left")
    out = out.withColumn("held", is_hold(rows) | F.coalesce("_caught", F.lit(False))).drop("_caught")
    return out.withColumn("automatic", F.col("held") & ~is_hold(rows))


def cluster_rank(rows: DataFrame) -> list[Column]:
    """What makes one row of a cluster better than another, most important first."""
    edited, favorite = x.truthy(has(rows, "edited")), x.truthy(has(rows, "favorite"))
    return [favorite & edited, favorite, edited, F.coalesce(x.text(has(rows, "aesthetic_score")).try_cast("double"), F.lit(0.0)), F.col("noise")]


def duplicate_representatives(rows: DataFrame) -> DataFrame:
    """The best row of each duplicate group; the first of a row's duplicate fields that is filled names it; rows without one pass."""
    held = [c for c in DUPLICATE_FIELDS if c in rows.columns]
    if not held:
        return rows
    rows = rows.withColumn("_group", x.first_text(*[F.col(c) for c in held]))
    best = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(cluster_rank(rows))], F.col("uuid").alias("u"))
    # partial aggregation, so a group of any size is reduced before it moves
    winners = rows.filter("_group is not null").groupBy("_group").agg(F.max_by("uuid", best).alias("_best"))
    joined = rows.join(winners, "_group", "left")
    return joined.filter(F.col("_best").isNull() | (F.col("_best") == F.col("uuid"))).drop("_group", "_best").select([c for c in rows.columns if c != "_group"])


def burst_limited(rows: DataFrame, limit: int = 2) -> DataFrame:
    """At most ``limit`` rows of each burst, best first; rows without a burst pass."""
    if BURST_FIELD not in rows.columns:
        return rows
    order = Window.partitionBy(BURST_FIELD).orderBy(*[F.desc(c) for c in cluster_rank(rows)], "uuid")
    within = rows.filter(x.strip(F.col(BURST_FIELD)) != "").withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")
    return within.unionByName(rows.filter(x.strip(F.col(BURST_FIELD)) == ""))


def top_of_views(rows: DataFrame, quota: int) -> DataFrame:
    """The ``quota`` best rows of each view with their rank."""
    order = Window.partitionBy("primary_view").orderBy(F.desc(F.col("score_total").cast("double")), "uuid")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= quota)


def select_simple(rows: DataFrame, quota: int, seed: int = SEED) -> DataFrame:
    """Holds out, one row per duplicate group, scores, and the best of each view."""
    free = scored(rows.filter(~is_hold(rows)), seed)
    return top_of_views(duplicate_representatives(free), quota)


def assign(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Gives rows (uuid, score, views: wanted views in order) to views so that as many quotas as can be are filled.

    Rows with the same wanted views are interchangeable for the flow, so it runs on counts: one number
    for each distinct list of views, however many rows there are. Which rows of a list go where is by rank.
    Fails, naming the short views, if the quotas can't all be met.
    """
    wanted = F.filter("views", lambda v: v.isin(*[v for v, q in quotas.items() if q > 0]))
    rows = rows.withColumn("_kind", F.concat_ws("\x1f", F.array_distinct(wanted))).filter("_kind <> ''")
    kinds = {r._kind: r.n for r in rows.groupBy("_kind").agg(F.count("*").alias("n")).collect()}  # bounded by the views' orders
    given = balanced_flow(kinds, quotas)
    short = {v: q - sum(given.get((k, v), 0) for k in kinds) for v, q in quotas.items()}
    if any(short.values()):
        raise ValueError(f"quotas cannot be met: {({v: n for v, n in short.items() if n})} missing")
    cuts, plan = {}, []
    for kind in kinds:
        for view in kind.split("\x1f"):
            if n := given.get((kind, view), 0):
                plan.append((kind, view, cuts.get(kind, 0), cuts.get(kind, 0) + n))
                cuts[kind] = cuts.get(kind, 0) + n
    order = Window.partitionBy("_kind").orderBy(F.desc("score"), "uuid")
    ranked = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= sum(quotas.values()))
    slots = rows.sparkSession.createDataFrame(plan or [("", "", 0, 0)], "_k string, assigned_view string, _from int, _to int")
    return ranked.join(F.broadcast(slots), (F.col("_kind") == F.col("_k")) & (F.col("_n") > F.col("_from")) & (F.col("_n") <= F.col("_to"))).drop("_kind", "_n", "_k", "_from", "_to")


def flow_cut(kinds: dict[str, int], quotas: dict[str, int], given: dict[tuple[str, str], int]) -> set[str]:
    """The least set of views whose rows are too few for their quotas, empty if all can be met: a minimum cut.

    It has the views with room left, and each view that holds a row which one of the set's views could
    take. Every row that wants a view of the set stands in the set, so no assignment fills it better.
    """
    cut = {v for v, q in quotas.items() if q > sum(n for (_, view), n in given.items() if view == v)}
    while more := {v for k in kinds if cut & set(k.split("\x1f")) for v in k.split("\x1f") if given.get((k, v), 0)} - cut:
        cut |= more
    return cut


def assignment_cut(rows: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """(view, quota, in_cut, cut_quota, cut_rows, fill): what proves how far the quotas can be met.

    rows as in ``assign``. fill is the most places that can be filled in all; it falls short of the quotas
    by cut_quota - cut_rows, what the views of the cut want less the rows that want any of them.
    """
    wanted = F.array_distinct(F.filter("views", lambda v: v.isin(*[v for v, q in quotas.items() if q > 0])))
    counted = rows.groupBy(F.concat_ws("\x1f", wanted).alias("kind")).agg(F.count("*").alias("n")).filter("kind <> ''")
    kinds = {r.kind: r.n for r in counted.collect()}  # bounded by the views' orders
    given = balanced_flow(kinds, quotas)
    cut = flow_cut(kinds, quotas, given)
    in_rows, in_quota = sum(n for k, n in kinds.items() if cut & set(k.split("\x1f"))), sum(q for v, q in quotas.items() if v in cut)
    out = [(v, q, v in cut, in_quota, in_rows, sum(given.values())) for v, q in quotas.items()]
    return rows.sparkSession.createDataFrame(out, "view string, quota long, in_cut boolean, cut_quota long, cut_rows long, fill long")


def balanced_flow(kinds: dict[str, int], quotas: dict[str, int]) -> dict[tuple[str, str], int]:
    """Most rows of each kind for each of its views: first choices first, then shifts along paths that free a place."""
    given, room = {}, dict(quotas)
    left = dict(kinds)
    for kind in sorted(kinds):
        for view in kind.split("\x1f"):
            n = min(left[kind], room.get(view, 0))
            if n:
                given[kind, view] = given.get((kind, view), 0) + n
                left[kind], room[view] = left[kind] - n, room[view] - n
    moved = True
    while moved:
        moved = False
        for kind in sorted(k for k in kinds if left[k]):
            # search: a view with room, reached by moving rows of other kinds
            came: dict[str, tuple[str, str] | None] = {v: None for v in kind.split("\x1f")}
            queue = list(came)
            goal = None
            for view in queue:
                if room.get(view, 0):
                    goal = view
                    break
                for (other, held), n in given.items():
                    if held == view and n:
                        for nxt in other.split("\x1f"):
                            if nxt not in came:
                                came[nxt] = (other, view)
                                queue.append(nxt)
            if goal is None:
                continue
            path, view = [], goal
            while came[view] is not None:
                path.append((*came[view], view))
                view = came[view][1]
            n = min([left[kind], room[goal], *(given[k, a] for k, a, _ in path)])
            for k, a, b in path:
                given[k, a] -= n
                given[k, b] = given.get((k, b), 0) + n
            given[kind, view] = given.get((kind, view), 0) + n
            left[kind], room[goal], moved = left[kind] - n, room[goal] - n, True
    return given


def raise_floor(chosen: DataFrame, spare: DataFrame, good: Column, fraction: float) -> DataFrame:
    """Swaps the best good spare rows of a view for its weakest chosen ones that are not, up to the floor.

    Both sides are (uuid, view, score). The k-th best incoming meets the k-th weakest outgoing of the
    view; the swaps that are needed go to the best incoming rows overall.
    """
    total, have = chosen.agg(F.count("*"), F.count_if(good)).first()
    need = math.ceil(total * fraction) - have
    if need <= 0:
        return chosen
    best, worst = Window.partitionBy("view").orderBy(F.desc("score"), "uuid"), Window.partitionBy("view").orderBy("score", "uuid")
    incoming = spare.filter(good).withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= need)
    outgoing = chosen.filter(~good).withColumn("_k", F.row_number().over(worst)).filter(F.col("_k") <= need).select("view", "_k", F.col("uuid").alias("_out"))
    swaps = durable(incoming.join(outgoing, ["view", "_k"]).orderBy(F.desc("score"), "uuid").limit(need))
    if swaps.count() < need:
        raise ValueError("the floor cannot be met")
    return chosen.join(swaps.select(F.col("_out").alias("uuid")), "uuid", "left_anti").select(chosen.columns).unionByName(swaps.select(chosen.columns))
