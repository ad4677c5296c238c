"""Weighted retrieval hypotheses over relation tables: term matches, scores, reasons, ranked takes, prior swaps."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable
from .terms import term_hits

#: What a match in each channel is worth.
WEIGHTS = {"asset-text": 7, "album-term": 7, "keyword": 6, "label": 4, "place-term": 4, "person": 8, "album": 10, "place": 5, "search": 4}
YEAR_BONUS = 2


#: What the reasons call the channels, where not by their own names.
REASONS = {"place-term": "place", "person": "existing-people-association", "search": "search-description"}
YEAR_REASON = "supporting-date-range"
#: Channels in which a text that holds an excluded term counts for nothing.
ALBUM_CHANNELS = ("album", "album-term")


def term_matches(terms: DataFrame, texts: DataFrame, excluded: Iterable[str] = ()) -> DataFrame:
    """(view, uuid, channel, weight, reason) for each text (uuid, channel, value) and each term (view, channel, term)
    of its channel that it holds; albums that hold an excluded term match nothing."""
    worth = F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])
    met = term_hits(terms, texts, excluded, ALBUM_CHANNELS)
    return met.select("view", "uuid", "channel", worth[F.col("channel")].alias("weight"), F.concat("channel", F.lit(":"), "term").alias("reason"))


def view_scores(matches: DataFrame) -> DataFrame:
    """(view, uuid, score, reasons): each matching relation row adds its weight; reasons are distinct."""
    return matches.groupBy("view", "uuid").agg(F.sum("weight").cast("long").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def year_bonus(scores: DataFrame, years: DataFrame, spans: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """Adds the bonus (and its reason) to matched assets whose year lies in the view's span; an open or zero end is open."""
    hit = F.lit(False)
    for view, (low, high) in spans.items():
        hit |= (F.col("view") == view) & F.coalesce(F.col("year").between(low or 0, high or 9999), F.lit(False))
    rows = scores.join(years, "uuid", "left").withColumn("_hit", hit).withColumn("score", F.col("score") + F.when(F.col("_hit"), YEAR_BONUS).otherwise(0))
    if "reasons" in scores.columns:
        rows = rows.withColumn("reasons", F.when(F.col("_hit"), F.array_sort(F.array_union("reasons", F.array(F.lit(YEAR_REASON))))).otherwise(F.col("reasons")))
    return rows.drop("year", "_hit")


def pruned(scores: DataFrame, limit: int | dict[str, int], seed: int) -> DataFrame:
    """The ``limit`` best assets of each view (one number, or one for each) by score, then noise, then id, all descending."""
    noise = x.stable_noise(seed, F.concat("view", F.lit(":"), "uuid"))
    order = Window.partitionBy("view").orderBy(F.desc("score"), F.desc(noise), F.desc("uuid"))
    limits = limit if isinstance(limit, dict) else {}
    ranked = scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(limits.values(), default=limit))
    return ranked.filter(F.col("rank") <= F.create_map(*[F.lit(y) for kv in limits.items() for y in kv])[F.col("view")]) if limits else ranked


def first_view(taken: DataFrame) -> DataFrame:
    """Each asset in the first view (then rank) that takes it."""
    order = Window.partitionBy("uuid").orderBy("view", "rank")
    return taken.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def without_albums(rows: DataFrame, title: str, terms: list[str], excluded: list[str]) -> DataFrame:
    """Rows whose title holds a term and none of the excluded ones."""
    low, hit, out = F.lower(title), F.lit(False), F.lit(False)
    for t in terms:
        hit |= F.contains(low, F.lit(t.lower()))
    for t in excluded:
        out |= F.contains(low, F.lit(t.lower()))
    return rows.filter(hit & ~out)


def prior_swap(chosen: DataFrame, spare: DataFrame, prior: DataFrame, fraction: float, target: int) -> DataFrame:
    """Brings best spare rows from outside the prior corpus in for the weakest chosen ones inside it.

    All are (uuid, score). As many are swapped as the fraction of the target asks for and both sides
    have; among spare rows of one score the greater ids come in, among chosen ones the lesser go.
    """
    chosen = durable(chosen.join(prior.select("uuid", F.lit(True).alias("_prior")), "uuid", "left").withColumn("_prior", F.coalesce("_prior", F.lit(False))))
    need = max(0, math.ceil(target * fraction) - chosen.filter(~F.col("_prior")).count())
    new = spare.join(chosen, "uuid", "left_anti").join(prior, "uuid", "left_anti").orderBy(F.desc("score"), F.desc("uuid")).limit(need)
    enter = durable(new.select("uuid", "score").withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("uuid")))))  # of ``need`` rows at most
    leave = chosen.filter("_prior").orderBy("score", "uuid").limit(need).select(F.col("uuid").alias("out"), F.row_number().over(Window.orderBy("score", "uuid")).alias("k"))
    swaps = durable(leave.join(enter, "k"))
    return chosen.join(swaps.select(F.col("out").alias("uuid")), "uuid", "left_anti").select("uuid", "score").unionByName(swaps.select("uuid", "score"))


def fallback(people: DataFrame, taken: DataFrame, needed: int) -> DataFrame:
    """The best of those not taken: over-fetch four times what is needed by order, drop the taken, then cut."""
    first = people.orderBy(F.desc("score"), "uuid").limit(4 * needed)
    return first.join(taken, "uuid", "left_anti").orderBy(F.desc("score"), "uuid").limit(needed)


def visible(assets: DataFrame) -> DataFrame:
    """Photos that are neither hidden nor in the trash."""
    return assets.filter(F.col("is_photo") & ~F.col("hidden") & ~F.col("trashed"))


def members(assets: DataFrame, albums: DataFrame, source: str | None = None) -> DataFrame:
    """Ids of a source: of an album (uuid, title), or of the whole visible library."""
    return visible(assets).select("uuid") if source is None else albums.filter(F.col("title") == source).select("uuid").distinct()


def attention(rows: DataFrame) -> Column:
    return x.attention_score(x.truthy(F.col("favorite")), x.truthy(F.col("edited")))


def view_take(scores: DataFrame, assets: DataFrame, quotas: dict[str, int], multiplier: float, seed: int) -> DataFrame:
    """(view, uuid, score, rank): of each view the best by score and attention, noise, id; each asset in the first view, in the quotas' order, that takes it."""
    order = {v: i for i, v in enumerate(quotas)}
    limits = {v: max(1, math.ceil(q * multiplier)) for v, q in quotas.items()}
    place = F.create_map(*[F.lit(y) for kv in order.items() for y in kv])
    limit = F.create_map(*[F.lit(y) for kv in limits.items() for y in kv])
    noise = x.stable_noise(seed, F.concat("view", F.lit(":"), "uuid"))
    best = Window.partitionBy("view").orderBy(F.desc(F.col("score") + F.col("attention")), F.desc(noise), F.desc("uuid"))
    rows = scores.filter(F.col("view").isin(*quotas)).join(assets.select("uuid", attention(assets).alias("attention")), "uuid")
    most = max(limits.values(), default=1)
    taken = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most).filter(F.col("rank") <= limit[F.col("view")]).withColumn("place", place[F.col("view")])
    first = Window.partitionBy("uuid").orderBy("place", "rank")
    return taken.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def availability(scores: DataFrame) -> DataFrame:
    """How many different assets each view has."""
    return scores.groupBy("view").agg(F.count_distinct("uuid").alias("available"))


def without_titles(titles: Column, excluded: list[str]) -> Column:
    """An array of titles without those that hold an excluded term; terms count once, whatever their case."""
    terms = sorted({t.lower() for t in excluded if t.strip()})
    return F.filter(titles, lambda t: ~reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(term)) for term in terms], F.lit(False)))


def check_request(request: dict[str, Any]) -> list[str]:
    """What is wrong with a retrieval request; empty if it can be used."""
    views = request.get("views") or []
    wrong, ids = [] if views else ["at least one view is needed"], [str(v.get("id", "")) for v in views]
    if "" in ids or len(set(ids)) != len(ids):
        wrong.append("view ids must be present and unique")
    if sum(int(v.get("quota", 0)) for v in views) != request.get("target"):
        wrong.append("view quotas must add up to the target")
    if float(request.get("candidate_multiplier", 1.75)) < 1:
        wrong.append("candidate_multiplier must be at least 1")
    share = float(request.get("minimum_outside_prior_fraction", 0))
    if not 0 <= share <= 1 or (share and not str(request.get("prior_corpus_album_title") or "").strip()):
        wrong.append("minimum_outside_prior_fraction must lie in [0, 1] and needs prior_corpus_album_title")
    if (most := request.get("maximum_candidates_per_view")) is not None and int(most) < max([1, *(math.ceil(int(v.get("quota", 0)) * float(request.get("candidate_multiplier", 1.75))) for v in views)]):
        wrong.append("maximum_candidates_per_view is smaller than a view's candidates")
    return wrong


#: The lists of a view and the channels that their terms are looked up in.
CHANNELS = {"terms": ("asset-text", "album-term", "keyword", "label", "place-term"), "people": ("person",), "albums": ("album",), "places": ("place",), "search_terms": ("search",)}


def request_terms(request: dict[str, Any]) -> list[tuple[str, str, str]]:
    """(view, channel, term) for each different term of a request."""
    return [(str(v["id"]), c, t) for v in request["views"] for name, channels in CHANNELS.items() for t in sorted({str(y).lower() for y in v.get(name, []) if str(y).strip()}) for c in channels]


def asset_text(assets: DataFrame) -> Column:
    """What is looked up of an asset itself: its text, or else its names, title and description."""
    if "text" in assets.columns:
        return F.col("text")
    return F.concat_ws(" ", *[x.text(F.col(c)) for c in ("filename", "original_filename", "title", "description")])


def excluded_terms(request: dict[str, Any]) -> list[str]:
    return sorted({str(t).lower() for name in ("excluded_album_terms", "derived_album_terms") for t in request.get(name, []) if str(t).strip()})


def retrieve(assets: DataFrame, relations: DataFrame, request: dict[str, Any]) -> DataFrame:
    """Candidates of a request with the views and reasons that found them, as CANDIDATE_COLUMNS.

    assets (uuid, is_photo, hidden, trashed, favorite, edited, face_count, year and what else of an
    inventory's columns there is); relations (uuid, channel, value) with channels album, person, keyword,
    label, place, search; labels are looked up by ``label`` and reported by ``label-name`` where there is
    one. Albums that hold an excluded term score nothing and are not reported. Takes of the views come
    first, then favourites, edits and faces up to the target, then rows from outside the prior corpus
    come in for the weakest inside it. All that match are ranked, and all favourites, edits and faces that are
    not taken; a request may name a maximum_candidates_per_view of its own.
    """
    if wrong := check_request(request):
        raise ValueError("; ".join(wrong))
    spark, seed, multiplier = assets.sparkSession, int(request.get("seed", 0)), float(request.get("candidate_multiplier", 1.75))
    quotas = {str(v["id"]): int(v.get("quota", 0)) for v in request["views"]}
    target = max(request["target"], math.ceil(request["target"] * multiplier))
    seen = visible(assets)
    twins = {"album": ("album", "album-term"), "place": ("place", "place-term")}  # one relation, looked up by two lists
    channel = F.when(F.col("channel") == "album", F.array(*map(F.lit, twins["album"]))).when(F.col("channel") == "place", F.array(*map(F.lit, twins["place"]))).otherwise(F.array("channel"))
    texts = relations.select("uuid", F.explode(channel).alias("channel"), "value").unionByName(seen.select("uuid", F.lit("asset-text").alias("channel"), asset_text(seen).alias("value")))
    matches = term_matches(spark.createDataFrame(request_terms(request), "view string, channel string, term string"), texts, excluded_terms(request))
    named = F.create_map(*[F.lit(y) for c in WEIGHTS for y in (c, REASONS.get(c, c))])[F.col("channel")]
    scores = view_scores(matches.withColumn("reason", named))
    spans = {str(v["id"]): (v.get("year_start"), v.get("year_end")) for v in request["views"] if v.get("year_start") is not None or v.get("year_end") is not None}
    scores = year_bonus(scores, assets.select("uuid", "year"), spans) if spans else scores
    if most := request.get("maximum_candidates_per_view"):
        scores = pruned(scores, int(most), seed).drop("rank")
    scores = durable(scores)
    if not (lost := scores.select("uuid").join(assets.select("uuid"), "uuid", "left_anti")).isEmpty():
        raise ValueError(f"relations name assets that there are not: {lost.first().uuid}")
    total = scores.groupBy("uuid").agg(F.max("score").alias("best")).join(assets.select("uuid", attention(assets).alias("attention")), "uuid").select("uuid", (F.col("best") + F.col("attention")).alias("score"))
    chosen = durable(view_take(scores, assets, quotas, multiplier, seed).orderBy("place", "rank").limit(target).select("uuid"))
    if (needed := target - chosen.count()) > 0:
        flags = x.truthy(F.col("favorite")).cast("int") + x.truthy(F.col("edited")).cast("int")
        more = seen.filter((flags > 0) | (F.col("face_count") > 0)).select("uuid", flags.alias("_flags"), "face_count")
        more = more.join(chosen, "uuid", "left_anti").orderBy(F.desc("_flags"), F.desc("face_count"), "uuid").limit(needed)
        chosen = durable(chosen.unionByName(more.select("uuid")))
    if chosen.isEmpty():
        raise ValueError("retrieval found no candidates")
    if share := float(request.get("minimum_outside_prior_fraction", 0)):
        prior = relations.filter((F.col("channel") == "album") & (F.col("value") == str(request["prior_corpus_album_title"]).strip())).select("uuid").distinct()
        mine = chosen.join(total, "uuid", "left").fillna(0, ["score"])
        chosen = durable(prior_swap(mine, total, prior, share, target).select("uuid"))
    return candidate_rows(chosen, assets, relations, scores, excluded_terms(request))


#: The columns of a candidate, in order.
CANDIDATE_COLUMNS = (
    "uuid filename candidate_views retrieval_basis evidence_confidence metadata_score visible_context persons albums labels place favorite edited safety_status safety_reason hidden missing "
    "duplicate_group burst_group aesthetic_score event_cluster date year width height face_count camera_make camera_model local_path"
).split()


def candidate_rows(chosen: DataFrame, assets: DataFrame, relations: DataFrame, scores: DataFrame, excluded: list[str]) -> DataFrame:
    """CANDIDATE_COLUMNS of chosen ids, all texts: views best first, reasons, confidence, and what assets and relations say; what is unknown is blank."""
    by_score = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("view").alias("v"), F.col("reasons").alias("r"))))
    found = scores.join(chosen, "uuid", "left_semi").groupBy("uuid").agg(by_score.alias("by"))
    basis = F.flatten(F.transform("by", lambda b: F.transform(b["r"], lambda r: F.concat(b["v"], F.lit(":"), r))))
    found = found.select("uuid", F.transform("by", lambda b: b["v"]).alias("_views"), basis.alias("_basis"), (-F.try_element_at("by", F.lit(1))["s"]).alias("_best"))
    held = relations.filter("value <> ''").join(chosen, "uuid", "left_semi").groupBy("uuid").agg(*[F.array_sort(F.collect_set(F.when(F.col("channel") == c, F.col("value")))).alias(f"_{c}") for c in ("person", "album", "label", "label-name", "place")])
    known = lambda c: F.col(f"`{c}`") if c in assets.columns else F.lit(None)
    filled = lambda c: F.coalesce(F.nullif(x.text(known(c)), F.lit("0")), F.lit(""))  # noqa: E731  zero counts as unknown
    yes = lambda c: F.coalesce(x.truthy(known(c)), F.lit(False))
    own = assets.select(
        "uuid", F.coalesce(F.nullif(x.text(known("original_filename")), F.lit("")), x.text(known("filename"))).alias("filename"), yes("favorite").cast("string").alias("favorite"), yes("edited").cast("string").alias("edited"),
        (yes("hidden") | yes("trashed")).cast("string").alias("hidden"), yes("missing").cast("string").alias("missing"), x.text(known("duplicate_group_id")).alias("duplicate_group"), x.text(known("burst_key")).alias("burst_group"),
        x.text(known("overall_aesthetic_score")).alias("aesthetic_score"), x.event_cluster(known("burst_key"), known("date_created"), F.concat_ws(" ", *[F.nullif(x.strip(known(c)), F.lit("")) for c in ("camera_make", "camera_model")])).alias("event_cluster"),
        x.text(known("date_created")).alias("date"), *[filled(c).alias(c) for c in ("year", "width", "height")], F.coalesce(known("face_count").cast("string"), F.lit("0")).alias("face_count"), *[x.text(known(c)).alias(c) for c in ("camera_make", "camera_model")],
    )
    joined = lambda c: F.coalesce(F.array_join(c, ";"), F.lit(""))
    best, blank = F.coalesce("_best", F.lit(0)), F.lit("")
    made = {
        "candidate_views": joined("_views"), "retrieval_basis": joined("_basis"), "evidence_confidence": x.confidence_band(best), "metadata_score": F.format_string("%.2f", best.cast("double")), "persons": joined("_person"),
        "albums": joined(without_titles(F.col("_album"), excluded)), "labels": joined(F.when(F.size("_label-name") > 0, F.col("_label-name")).otherwise(F.col("_label"))), "place": F.substring(joined("_place"), 1, 500), "safety_status": F.lit("clear"), "safety_reason": blank, "visible_context": blank, "local_path": blank,
    }
    return chosen.join(own, "uuid").join(found, "uuid", "left").join(held, "uuid", "left").withColumns(made).select(*CANDIDATE_COLUMNS)
