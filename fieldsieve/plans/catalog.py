"""All queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import identity as idt
from ..operators import retrieval as rt
from ..operators import review as rv
from ..operators import selection as sel
from ..sources.io import decoded_meta, parts_of
from ..sources.proxies import INVENTORY_SQL, inventory, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


HOLD_SQL = "lower(trim(safety_status)) in ('hold', 'automatic-hold', 'needs-review', 'human-needs-review', 'unavailable')"


@query(INVENTORY_SQL + f"select uuid, {HOLD_SQL} as is_hold from inv")
def q_is_hold(spark: SparkSession, d: str) -> DataFrame:
    rows = inventory(spark, d)
    return rows.select("uuid", sel.is_hold(rows).alias("is_hold"))


@query(INVENTORY_SQL + "select uuid, noise from scored")
def q_stable_noise(spark, d):
    return inventory(spark, d).select("uuid", x.stable_noise(17, F.col("uuid")).alias("noise"))


@query(INVENTORY_SQL + "select uuid, attention::int as attention, evidence::int as evidence, score_total from scored")
def q_scores(spark, d):
    return sel.scored(inventory(spark, d)).select("uuid", F.col("attention").cast("int").alias("attention"), F.col("evidence").cast("int").alias("evidence"), "score_total")


@query("select p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda v: v <> ''), '|') as parts, len(list_filter(string_split(p_name, ' '), lambda v: v <> ''))::int as n from part")
def q_split_values(spark, d):
    parts = x.split_values(F.col("p_name"), " ")
    return table(spark, d, "part").select("p_partkey", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n"))


DUP_SQL = """, dup as (
  select *, row_number() over (partition by duplicate_group order by (favorite and edited) desc, favorite desc, edited desc, aesthetic_score desc, noise desc, uuid desc) as rd from scored
), reps as (select * from dup where duplicate_group = '' or rd = 1)
"""


@query(INVENTORY_SQL + DUP_SQL + "select uuid, duplicate_group from reps")
def q_dup_representative(spark, d):
    return sel.duplicate_representatives(sel.scored(inventory(spark, d))).select("uuid", "duplicate_group")


BURST_SQL = """, bursts as (
  select *, row_number() over (partition by burst_group order by (favorite and edited) desc, favorite desc, edited desc, aesthetic_score desc, noise desc, uuid) as rb from reps
), reduced as (select * from bursts where burst_group = '' or rb <= 2)
"""


@query(INVENTORY_SQL + DUP_SQL + BURST_SQL + "select uuid, burst_group from reduced")
def q_burst_limit(spark, d):
    return sel.burst_limited(sel.duplicate_representatives(sel.scored(inventory(spark, d)))).select("uuid", "burst_group")


@query(
    INVENTORY_SQL.replace("with inv", "with recursive inv")
    + f""", edges as (
  select uuid, 'duplicate:' || duplicate_group as g from inv where duplicate_group <> '' union select uuid, 'burst:' || burst_group from inv
), closure as (
  select uuid from inv where {HOLD_SQL} union select e2.uuid from closure c join edges e1 on c.uuid = e1.uuid join edges e2 on e1.g = e2.g
)
select uuid, uuid in (select uuid from closure) as held, uuid in (select uuid from closure) and not {HOLD_SQL} as automatic from inv
"""
)
def q_hold_closure(spark, d):
    return sel.hold_closure(inventory(spark, d)).select("uuid", "held", "automatic")


@query(INVENTORY_SQL + "select uuid, primary_view, score_total, rank::int as rank from (select *, row_number() over (partition by primary_view order by score_total::double desc, uuid) as rank from scored) where rank <= 25")
def q_view_top_quota(spark, d):
    return sel.top_of_views(sel.scored(inventory(spark, d)), 25).select("uuid", "primary_view", "score_total", "rank")


SELECT_SQL = (
    INVENTORY_SQL
    + f""", free as (select * from scored where not {HOLD_SQL}), dup as (
  select *, row_number() over (partition by duplicate_group order by (favorite and edited) desc, favorite desc, edited desc, aesthetic_score desc, noise desc, uuid desc) as rd from free
), master as (
  select *, row_number() over (partition by primary_view order by score_total::double desc, uuid) as rank from dup where duplicate_group = '' or rd = 1 qualify rank <= 40
)
"""
)


@query(SELECT_SQL + "select uuid, primary_view, score_total, rank::int as rank from master")
def q_entry_select(spark, d):
    return sel.select_simple(inventory(spark, d), 40).select("uuid", "primary_view", "score_total", "rank")


@query("""select event_id, case when event_type = 'view' then 'burst-' || substr(sha256('view-' || user_id), 1, 20)
  else 'event-' || substr(sha256(strftime(ts, '%Y-%m-%d %H') || '|' || 'user' || user_id), 1, 20) end as event_cluster from events""")
def q_event_cluster(spark, d):
    burst = F.when(F.col("event_type") == "view", F.concat(F.lit("view-"), "user_id")).otherwise("")
    return table(spark, d, "events").select("event_id", x.event_cluster(burst, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit("User"), "user_id")).alias("event_cluster"))


@query("select event_type, max(n)::bigint as largest, sum(n)::bigint as total, max(n)::double / sum(n) as share from (select event_type, user_id, count(*) as n from events group by all) group by event_type")
def q_event_concentration(spark, d):
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.max("n").alias("largest"), F.sum("n").alias("total"), (F.max("n").cast("double") / F.sum("n")).alias("share"))


TERMS = [("warm", "asset-text", "red"), ("warm", "asset-text", "gold"), ("warm", "album", "supplier#00000001"), ("cool", "asset-text", "blue"), ("cool", "place-term", "an"), ("cool", "album", "supplier#00000002")]
TERMS_SQL = "with terms(view, channel, term, weight) as (values " + ", ".join(f"('{v}', '{c}', '{t}', {rt.WEIGHTS[c]})" for v, c, t in TERMS) + ")"
MATCH_SQL = (
    TERMS_SQL
    + """, texts as (
  select p_partkey::varchar as uuid, 'asset-text' as channel, p_name as value from part
  union all select distinct l_partkey::varchar, 'album', s_name from lineitem join supplier on l_suppkey = s_suppkey
  union all select distinct l_partkey::varchar, 'place-term', n_name from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
), matched as (
  select t.view, x.uuid, t.weight, t.channel || ':' || t.term as reason from texts x join terms t on x.channel = t.channel and contains(lower(x.value), t.term)
), scores as (
  select view, uuid, sum(weight)::bigint as score, list_sort(list(distinct reason)) as reasons from matched group by view, uuid
)
"""
)


def part_suppliers(spark, d):
    """Different pairs of part and supplier, dealt by part."""
    line = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return line.repartition(parts_of(line), "l_partkey").distinct()


def retrieved(spark, d):
    by = part_suppliers(spark, d).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    of = lambda rows, channel, value: rows.select("l_partkey", value).distinct().select(F.col("l_partkey").cast("string").alias("uuid"), F.lit(channel).alias("channel"), F.col(value).alias("value"))  # noqa: E731  dealt by part already
    places = of(by.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), "place-term", "n_name")
    names = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("uuid"), F.lit("asset-text").alias("channel"), F.col("p_name").alias("value"))
    matches = rt.term_matches(spark.createDataFrame(TERMS, "view string, channel string, term string"), names.unionByName(of(by, "album", "s_name")).unionByName(places))
    return rt.view_scores(matches.repartition(parts_of(table(spark, d, "lineitem")), "uuid"))


@query(MATCH_SQL + "select view, uuid, score, array_to_string(reasons, ';') as reasons from scores")
def q_retrieval_scores(spark, d):
    return retrieved(spark, d).withColumn("reasons", F.array_join("reasons", ";"))


TOPK_SQL = (
    MATCH_SQL
    + """, noisy as (select *, ('0x' || substr(sha256('47:' || view || ':' || uuid), 1, 16))::ubigint::double / 18446744073709551616.0 as noise from scores),
ranked as (select *, row_number() over (partition by view order by score desc, noise desc, uuid desc) as rank from noisy),
took as (select *, row_number() over (partition by uuid order by view, rank) as n from ranked where rank <= 60)
"""
)


@query(TOPK_SQL + "select view, uuid, score, rank::int as rank from took where n = 1")
def q_retrieval_topk(spark, d):
    return rt.first_view(rt.pruned(retrieved(spark, d), 60, 47)).select("view", "uuid", "score", "rank")


@query(MATCH_SQL + """select uuid, array_to_string(list_transform(list_sort(list({'s': -score, 'v': view})), lambda y: y.v), ';') as views, max(score)::bigint as best,
  case when max(score) >= 12 then 'high' when max(score) >= 6 then 'medium' when max(score) > 0 then 'low' else 'unknown' end as confidence from scores group by uuid""")
def q_retrieval_confidence(spark, d):
    views = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("view").alias("v")))), lambda y: y["v"]), ";")
    return retrieved(spark, d).groupBy("uuid").agg(views.alias("views"), F.max("score").alias("best"), x.confidence_band(F.max("score")).alias("confidence"))


@query("select p_partkey, p_name from part where (contains(lower(p_name), 'red') or contains(lower(p_name), 'a')) and not (contains(lower(p_name), 'blue') or contains(lower(p_name), 'gold'))")
def q_album_exclusion(spark, d):
    return rt.without_albums(table(spark, d, "part"), "p_name", ["red", "a"], ["blue", "gold"]).select("p_partkey", "p_name")


@query("select o_orderkey::varchar as uuid, v.view, (5 + case when v.view = 'early' and year(o_orderdate) between 0 and 1994 then 2 when v.view = 'late' and year(o_orderdate) between 1996 and 9999 then 2 else 0 end)::bigint as score from orders, (values ('early'), ('late')) v(view)")
def q_year_bonus(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uuid"), F.year("o_orderdate").alias("year"))
    scores = orders.select("uuid", F.explode(F.array(F.lit("early"), F.lit("late"))).alias("view"), F.lit(5).cast("long").alias("score"))
    out = rt.year_bonus(scores, orders, {"early": (None, 1994), "late": (1996, 0)})
    return out.select("uuid", "view", F.col("score").cast("long").alias("score"))


@query("""with parts as (select p_partkey::varchar as uuid, p_size::bigint as score from part), prior as (select distinct l_partkey::varchar as uuid from lineitem where l_quantity < 25),
chosen as (select * from parts order by score desc, uuid limit 100), state as (select count(*) filter (where uuid not in (select uuid from prior)) as outside from chosen),
need as (select greatest(0, ceil(100 * 0.5) - outside) as n from state),
leave_ as (select *, row_number() over (order by score, uuid) as k from chosen where uuid in (select uuid from prior)),
enter_ as (select *, row_number() over (order by score desc, uuid desc) as k from parts where uuid not in (select uuid from prior) and uuid not in (select uuid from chosen)),
swaps as (select least((select n from need), (select count(*) from leave_), (select count(*) from enter_)) as n)
select uuid, score from chosen where uuid not in (select uuid from leave_ where k <= (select n from swaps)) union all select uuid, score from enter_ where k <= (select n from swaps)""")
def q_prior_swap(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("uuid"), F.col("p_size").cast("long").alias("score"))
    prior = table(spark, d, "lineitem").filter("l_quantity < 25").select(F.col("l_partkey").cast("string").alias("uuid")).distinct()
    return rt.prior_swap(parts.orderBy(F.desc("score"), "uuid").limit(100), parts, prior, 0.5, 100)


@query("""with people as (select c_custkey::varchar as uuid, c_acctbal as score from customer), top as (select * from people order by score desc, uuid limit 200)
select uuid, score from top where uuid not in (select o_custkey::varchar from orders where o_totalprice > 200000) order by score desc, uuid limit 50""")
def q_fallback(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uuid"), F.col("c_acctbal").alias("score"))
    taken = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").cast("string").alias("uuid")).distinct()
    return rt.fallback(people, taken, 50)


@query("""with faces as (select l_orderkey, count(*)::bigint as n from lineitem group by l_orderkey)
select o_orderkey, c_name, n_name, r_name, coalesce(n, 0)::bigint as face_count, (o_orderkey & 32) <> 0 as selfie, (o_orderkey & 1) <> 0 as panorama, o_orderstatus = 'F' as edited,
  strftime(make_timestamp((o_orderkey + 978307200)::bigint * 1000000), '%Y-%m-%d %H:%M:%S') as captured, c_acctbal between -90 and 90 and c_custkey between -180 and 180 as has_location
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey left join faces on l_orderkey = o_orderkey""")
def q_asset_star(spark, d):
    faces = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(faces, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.select(
        "o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n", F.lit(0)).alias("face_count"), x.has_flag(F.col("o_orderkey"), 32).alias("selfie"), x.has_flag(F.col("o_orderkey"), 1).alias("panorama"),
        (F.col("o_orderstatus") == "F").alias("edited"), F.date_format(x.apple_time(F.col("o_orderkey")), "yyyy-MM-dd HH:mm:ss").alias("captured"), x.valid_location(F.col("c_acctbal"), F.col("c_custkey")).alias("has_location"),
    )


@query("select distinct p_partkey, s_suppkey, s_name from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey")
def q_people_links(spark, d):
    line = part_suppliers(spark, d)
    return table(spark, d, "part").join(line, F.col("p_partkey") == F.col("l_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("p_partkey", "s_suppkey", "s_name").distinct()


@query("select l_partkey, substr(string_agg(distinct s_name, ';' order by s_name), 1, 500) as suppliers, count(distinct s_name)::bigint as n from lineitem join supplier on l_suppkey = s_suppkey group by l_partkey")
def q_relation_lists(spark, d):
    names = F.array_sort(F.collect_set("s_name"))
    return table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_partkey").agg(F.substring(F.array_join(names, ";"), 1, 500).alias("suppliers"), F.size(names).cast("long").alias("n"))


@query("""select o_orderkey, '{"uuid":"' || o_orderkey || '","asset":{"status":"' || o_orderstatus || '"},"relationships":{"lines":[' ||
  coalesce(string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || '}', ',' order by l_linenumber, l_partkey), '') || ']}}' as record from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_orderstatus""")
def q_nested_export(spark, d):
    lines = F.array_sort(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))))
    joined = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = joined.groupBy("o_orderkey", "o_orderstatus").agg(lines.alias("lines"))
    record = F.struct(F.col("o_orderkey").cast("string").alias("uuid"), F.struct(F.col("o_orderstatus").alias("status")).alias("asset"), F.struct("lines").alias("relationships"))
    return rows.select("o_orderkey", F.to_json(record).alias("record"))


@query("""select d.doc_id, case when l.doc_id is null then 'hold' when l.toxic = 1 or l.quality is null then 'hold' else 'clear-automated' end as safety_status,
  case when l.doc_id is null then 'no inspection' when l.toxic = 1 then 'toxic' else '' end as safety_reason,
  case when d.doc_id % 4 = 0 then '' else (d.doc_id % 4)::varchar || ' visible face(s); ' end || d.lang || '; ' || d.source as signals from documents d left join labels l using (doc_id)""")
def q_inspection_merge(spark, d):
    from ..operators.inspection import merge

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uuid"), "lang", "source")
    found = table(spark, d, "labels").select(F.col("doc_id").alias("uuid"), F.when(F.col("toxic") == 1, "hold").otherwise("clear-automated").alias("safety_state"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("safety_flags"), F.col("quality").isNotNull().alias("pixel_available"))
    found = found.join(docs, "uuid").select("uuid", "safety_state", "safety_flags", "pixel_available", F.array("lang", "source").alias("vision_labels"), (F.col("uuid") % 4).cast("int").alias("detected_face_count"))
    faces = docs.join(found.drop("vision_labels", "detected_face_count"), "uuid", "left").withColumns({"vision_labels": F.array("lang", "source"), "detected_face_count": (F.col("uuid") % 4).cast("int")})
    return merge(docs.select("uuid"), faces.select("uuid", "safety_state", "safety_flags", "pixel_available", "vision_labels", "detected_face_count")).select(F.col("uuid").alias("doc_id"), "safety_status", "safety_reason", F.col("machine_visible_signals").alias("signals"))


FLAG_SQL = ", ".join("case when regexp_matches(lower(text), '{}') then '{}' end".format(p.replace("'", "''"), n) for n, p in x.SAFETY_PATTERNS)


@query(f"select doc_id, array_to_string(list_sort(list_filter([{FLAG_SQL}, case when doc_id % 7 = 0 and length(text) >= 24 then '{x.DOCUMENT_FLAG}' end], lambda v: v is not null)), ';') as flags from documents")
def q_safety_flags(spark, d):
    labels = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Printed Page"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "documents").select("doc_id", F.array_join(x.safety_flags(F.col("text"), labels), ";").alias("flags"))


@query(SELECT_SQL + """, placed as (select *, row_number() over (partition by primary_view order by score_total::double, uuid) - 1 as pos, count(*) over (partition by primary_view) as size from master)
select uuid, primary_view, pos::bigint as pos, size::bigint as view_selected_count from placed where pos in (0, size // 2, size - 1)""")
def q_sample_bounds(spark, d):
    return rv.sample(sel.select_simple(inventory(spark, d), 40), 3, 5).select("uuid", "primary_view", "pos", "view_selected_count")


@query()
def q_sample_random(spark, d):
    return rv.sample(sel.select_simple(inventory(spark, d), 40), 8, 5).select("uuid", "primary_view", "pos", "view_selected_count")


EVAL_SQL = (
    INVENTORY_SQL
    + """, counted as (
  select primary_view, count(*) as sampled, count(*) filter (where judgment in ('fit', 'reject', 'uncertain')) as judged, count(*) filter (where judgment = 'fit') as fit,
    count(*) filter (where judgment = 'reject') as reject, count(*) filter (where judgment = 'uncertain') as uncertain from inv group by primary_view
), rates as (
  select *, fit + reject as decisive, fit::double / nullif(fit + reject, 0) as precision, judged::double / sampled as coverage, uncertain::double / nullif(judged, 0) as uncertainty from counted
)
"""
)


@query(EVAL_SQL + "select primary_view, sampled, judged, decisive, fit, reject, round(precision, 9) as precision, round(coverage, 9) as coverage from rates")
def q_eval_by_view(spark, d):
    return rv.evaluate(inventory(spark, d)).select("primary_view", "sampled", "judged", "decisive", "fit", "reject", F.round("precision", 9).alias("precision"), F.round("coverage", 9).alias("coverage"))


@query(EVAL_SQL + """select primary_view,
  round(greatest(0, (precision + 3.8416 / (2 * decisive) - 1.96 * sqrt(precision * (1 - precision) / decisive + 3.8416 / (4 * decisive * decisive))) / (1 + 3.8416 / decisive)), 6) as wilson_low,
  round(least(1, (precision + 3.8416 / (2 * decisive) + 1.96 * sqrt(precision * (1 - precision) / decisive + 3.8416 / (4 * decisive * decisive))) / (1 + 3.8416 / decisive)), 6) as wilson_high from rates""")
def q_wilson(spark, d):
    return rv.evaluate(inventory(spark, d)).select("primary_view", F.round("wilson_low", 6).alias("wilson_low"), F.round("wilson_high", 6).alias("wilson_high"))


@query(EVAL_SQL + """select primary_view, array_to_string(list_filter([case when decisive = 0 then 'no decisive judgment' end, case when coalesce(coverage, 0) < 0.4 then 'coverage below minimum' end,
  case when coalesce(precision, 0) < 0.7 then 'precision below minimum' end, case when coalesce(uncertainty, 0) > 0.2 then 'uncertainty above maximum' end], lambda v: v is not null), ';') as failure_reasons from rates""")
def q_failure_reasons(spark, d):
    return rv.evaluate(inventory(spark, d), 0.7, 0.4).select("primary_view", F.array_join("failure_reasons", ";").alias("failure_reasons"))


QUOTAS = {"de": 40, "en": 40, "es": 40, "fr": 41}


@query(SELECT_SQL + f"""select 'duplicate ids' as "check", (select count(*) from (select uuid from master group by uuid having count(*) > 1))::bigint as failures
union all select 'held rows selected', (select count(*) from master where uuid in (select uuid from inv where {HOLD_SQL}))
union all select 'views off quota', (select count(*) from (values ('de', 40), ('en', 40), ('es', 40), ('fr', 41)) q(v, n) full join (select primary_view as v, count(*) as n from master group by 1) m using (v) where coalesce(q.n, 0) <> coalesce(m.n, 0))
union all select 'unknown views', (select count(distinct primary_view) from master where primary_view not in ('de', 'en', 'es', 'fr'))
union all select 'blank ids', (select count(*) from master where trim(uuid) = '')""")
def q_validate(spark, d):
    rows = inventory(spark, d)
    return rv.validation(sel.select_simple(rows, 40), rows.filter(sel.is_hold(rows)), QUOTAS)


@query(INVENTORY_SQL + f"select count(*)::bigint as overlap from inv where {HOLD_SQL} and judgment = 'fit'")
def q_hold_overlap(spark, d):
    rows = inventory(spark, d)
    return rows.filter("judgment = 'fit'").join(rows.filter(sel.is_hold(rows)).select("uuid"), "uuid", "left_semi").agg(F.count("*").alias("overlap"))


@query("select lang as view, count(*)::bigint as n from documents group by lang")
def q_view_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("view")).agg(F.count("*").alias("n"))


@query("select view from (values ('de'), ('en'), ('it'), ('pt')) v(view) except select lang from documents")
def q_missing_views(spark, d):
    return spark.createDataFrame([(v,) for v in ("de", "en", "it", "pt")], "view string").join(table(spark, d, "documents").select(F.col("lang").alias("view")), "view", "left_anti")


MASTER_JSON_SQL = """'{"primary_view":"' || primary_view || '","score_total":"' || score_total || '","uuid":"' || uuid || '"}'"""


@query(SELECT_SQL + f"select sha256('[' || string_agg({MASTER_JSON_SQL}, ',' order by {MASTER_JSON_SQL}) || ']') as digest, count(*)::bigint as n from master")
def q_master_digest(spark, d):
    return idt.rows_digest(sel.select_simple(inventory(spark, d), 40), {c: F.col(c) for c in ("uuid", "primary_view", "score_total")}, [])


@query("select source, sha256(string_agg(doc_id::varchar || chr(10), '' order by doc_id::varchar)) as digest, count(*)::bigint as n from documents group by source")
def q_identifier_digest(spark, d):
    return idt.lines_digests(table(spark, d, "documents"), ["source"], F.col("doc_id").cast("string"))


@query("""with rows as (select doc_id, doc_id::varchar as uuid, sha256(text) as inspection_sha256, source || '-' || (doc_id // 60) as burst_group from documents),
tokens as (select distinct doc_id % 2 as side, 'inspection_sha256:' || inspection_sha256 as token from rows union select distinct doc_id % 2, 'burst_group:' || burst_group from rows)
select 0::bigint as shared_ids, (select count(*) from (select token from tokens where side = 0 intersect select token from tokens where side = 1))::bigint as shared_relations, 0::bigint as left_surplus, 0::bigint as right_surplus,
  (select count(*) from (select token from tokens where side = 0 intersect select token from tokens where side = 1)) = 0 as passed""")
def q_split_audit(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("uuid"), F.sha2("text", 256).alias("inspection_sha256"), F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 60)).alias("burst_group"))
    return rv.split_audit(rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 = 1"), ("inspection_sha256", "burst_group"))


@query("""with planned as (select distinct user_id, event_type, 'd' || (day(ts) % 5) as slot from events where ts < timestamp '2024-01-16'), actual as (select distinct user_id, event_type, 'd' || (day(ts) % 5) as slot from events where ts >= timestamp '2024-01-08')
select user_id, event_type, slot, 'missing' as status from (select * from planned except select * from actual) union all select user_id, event_type, slot, 'unexpected' from (select * from actual except select * from planned)""")
def q_membership_verify(spark, d):
    events = table(spark, d, "events").withColumn("slot", F.concat(F.lit("d"), F.day("ts") % 5))
    return rv.membership_diff(events.filter("ts < timestamp_ntz'2024-01-16'"), events.filter("ts >= timestamp_ntz'2024-01-08'"), ["user_id", "event_type", "slot"])


@query("""with plan as (select o_orderkey as k, 1 + o_orderkey % 7 as planned from orders), receipt as (select l_orderkey as k, count(*) as counted from lineitem group by 1)
select coalesce(p.k, r.k) as k, coalesce(planned, 0)::bigint as planned, coalesce(counted, 0)::bigint as counted from plan p full join receipt r on p.k = r.k where coalesce(planned, 0) <> coalesce(counted, 0)""")
def q_plan_receipt(spark, d):
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (1 + F.col("o_orderkey") % 7).alias("planned"))
    receipt = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("counted"))
    both = plan.join(receipt, "k", "full").select("k", F.coalesce("planned", F.lit(0)).cast("long").alias("planned"), F.coalesce("counted", F.lit(0)).cast("long").alias("counted"))
    return both.filter("planned <> counted")


@query("select 0::bigint as differences, (select count(*) from (select distinct user_id, event_type from events))::bigint as members")
def q_idempotence(spark, d):
    once = table(spark, d, "events").select("user_id", "event_type").distinct()
    again = once.unionByName(table(spark, d, "events").select("user_id", "event_type")).distinct()
    return rv.membership_diff(once, again, ["user_id", "event_type"]).agg(F.count("*").alias("differences")).crossJoin(once.agg(F.count("*").alias("members")))


@query("""with weeks as (select distinct user_id, (date_diff('day', timestamp '2024-01-01', ts) // 7)::int as week from events where event_type = 'purchase')
select a.week, count(*) filter (where b.user_id is null)::bigint as fresh, count(*) filter (where b.user_id is not null)::bigint as cached from weeks a left join weeks b on a.user_id = b.user_id and b.week = a.week - 1 group by a.week""")
def q_freshness(spark, d):
    week = F.floor(F.datediff("ts", F.lit("2024-01-01")) / 7).cast("int")
    weeks = table(spark, d, "events").filter("event_type = 'purchase'").select("user_id", week.alias("week")).distinct()
    before = weeks.select("user_id", (F.col("week") + 1).alias("week"), F.lit(True).alias("seen"))
    return weeks.join(before, ["user_id", "week"], "left").groupBy("week").agg(F.count_if(F.col("seen").isNull()).alias("fresh"), F.count_if(F.col("seen").isNotNull()).alias("cached"))


def clearance(spark, d):
    return inventory(spark, d).select(
        "uuid", "primary_view", F.when(F.col("judgment") == "fit", "cleared").otherwise("pending").alias("clearance"),
        F.when(F.col("uuid").cast("long") % 9 == 0, F.concat(F.lit("=cmd "), "filename")).otherwise(F.col("filename")).alias("public_title"), F.when(F.col("uuid").cast("long") % 8 == 0, "").otherwise(F.col("source")).alias("credit"),
        F.lit("CC0").alias("license"), F.when(F.col("uuid").cast("long") % 7 == 0, "2026-1-2").otherwise("2026-01-02").alias("cleared_on"),
    )


@query(INVENTORY_SQL + """select uuid, array_to_string(list_filter([case when uuid::bigint % 8 = 0 then 'credit missing' end, case when uuid::bigint % 9 = 0 then 'public_title unsafe' end,
  case when uuid::bigint % 7 = 0 then 'cleared_on is no date' end], lambda v: v is not null), ';') as errors from inv where judgment = 'fit'""")
def q_publication_gate(spark, d):
    rows = clearance(spark, d).filter(F.col("clearance").isin(*rv.PUBLIC_STATES))
    return rows.select("uuid", F.array_join(rv.publication_errors(rows), ";").alias("errors"))


@query("select c_custkey, sha256(concat_ws(chr(31), trim(c_name), trim(c_mktsegment), c_nationkey::varchar)) as decision_id from customer")
def q_decision_id(spark, d):
    return table(spark, d, "customer").select("c_custkey", x.decision_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("decision_id"))


PAD = b"0123456789abcdef".ljust(64, b"\0")


@query("select doc_id, substr(sha256(from_hex('{}') || from_hex(sha256(from_hex('{}') || encode('site' || chr(31) || doc_id)))), 1, 24) as public_id from documents".format(bytes(b ^ 0x5C for b in PAD).hex(), bytes(b ^ 0x36 for b in PAD).hex()))
def q_public_id(spark, d):
    return table(spark, d, "documents").select("doc_id", x.public_id(b"0123456789abcdef", F.lit("site"), F.col("doc_id")).alias("public_id"))


@query("""with types as (select distinct event_type from events), held as (select distinct user_id, event_type from events)
select user_id, case when count(*) = (select count(*) from types) then 'AVAILABLE' else 'DEGRADED' end as state, count(*)::bigint as providers from held group by user_id""")
def q_capability_rollup(spark, d):
    events = table(spark, d, "events").select("user_id", "event_type").distinct()
    kinds = events.agg(F.count_distinct("event_type").alias("kinds"))
    out = events.groupBy("user_id").agg(F.count("*").alias("providers")).crossJoin(F.broadcast(kinds))
    return out.select("user_id", F.when(F.col("providers") == F.col("kinds"), "AVAILABLE").otherwise("DEGRADED").alias("state"), "providers")


@query("""select conv_id, turn, role = 'assistant' and coalesce(min((role = 'user' or role = 'system')::int) over w, 1) = 0 as out_of_order, count(*) over (partition by conv_id, md5(text)) > 1 as reused
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""")
def q_phase_order(spark, d):
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    complete = F.col("role").isin("user", "system").cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", ((F.col("role") == "assistant") & (F.coalesce(F.min(complete).over(before), F.lit(1)) == 0)).alias("out_of_order"), (F.count("*").over(Window.partitionBy("conv_id", F.md5("text"))) > 1).alias("reused"))


@query(INVENTORY_SQL + "select uuid, evidence_confidence from inv order by (evidence_confidence = 'high') desc, uuid::bigint limit 10")
def q_write_test_pick(spark, d):
    return inventory(spark, d).orderBy(F.desc(F.col("evidence_confidence") == "high"), F.col("uuid").cast("long")).limit(10).select("uuid", "evidence_confidence")


@query("select page_id, ((row_number() over (order by page_id) - 1) // 24)::bigint as sheet, ((row_number() over (order by page_id) - 1) % 24 // 6)::bigint as line, ((row_number() over (order by page_id) - 1) % 6)::bigint as place from pages")
def q_paging(spark, d):
    rows = rv.ranked(table(spark, d, "pages").select("page_id", F.lit("all").alias("part")), "part", F.col("page_id"))
    return rows.select("page_id", F.floor(F.col("pos") / 24).alias("sheet"), F.floor(F.col("pos") % 24 / 6).alias("line"), (F.col("pos") % 6).alias("place"))


@query("""select event_id, replace(props, ' ', '') as decoded, '"' || event_type || '"' as raw from events""")
def q_meta_json(spark, d):
    return table(spark, d, "events").select("event_id", decoded_meta(F.col("props")).alias("decoded"), decoded_meta(F.col("event_type")).alias("raw"))


def candidates(spark, d):
    rows = sel.scored(inventory(spark, d))
    rows = rows.filter(~sel.is_hold(rows))
    bucket = F.concat(F.lit("bucket-"), F.substring("source", 4, 9).cast("int") % 3)
    return rows.select("uuid", F.col("score_total").cast("double").alias("score"), F.array("primary_view", bucket).alias("views"), "persons")


ASSIGN = {"de": 15, "en": 30, "es": 12, "fr": 14, "bucket-0": 10, "bucket-1": 10, "bucket-2": 10}


@query()
def q_assignment(spark, d):
    return sel.assign(candidates(spark, d), ASSIGN).select("uuid", "score", "assigned_view")


@query()
def q_floors(spark, d):
    rows = candidates(spark, d)
    chosen = sel.assign(rows, ASSIGN).select("uuid", F.col("assigned_view").alias("view"), "score", "persons")
    spare = rows.join(chosen, "uuid", "left_anti").select("uuid", F.explode("views").alias("view"), "score", "persons")
    once = Window.partitionBy("uuid").orderBy("view")
    spare = spare.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return sel.raise_floor(chosen, spare, F.col("persons") != "", 0.3)
