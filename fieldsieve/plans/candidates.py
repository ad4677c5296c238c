"""Queries of whole retrievals: a request over an inventory and its relations, and very many terms at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..operators.terms import term_hits
from ..sources.io import durable, parts_of
from ..sources.proxies import table
from .catalog import query

WORDS_SQL = "select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from benchmark"


@query(f"""with words as ({WORDS_SQL}), asked as (select 'w-' || word[1:1] as view, word from words where length(word) >= 4), barred as (select word from words where length(word) >= 14),
titles as (select doc_id::varchar as uuid, lower(text) as text from documents where text is not null and not exists (select 1 from barred where contains(lower(text), word)))
select view, uuid, count(*) as terms, min(word) as first_term from titles join asked on contains(text, word) group by view, uuid""")
def q_term_automaton(spark, d):
    """Every word of the benchmark that stands inside a document, but for documents with one of its very long words."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")
    words = table(spark, d, "benchmark").select(word).distinct()
    asked = words.filter(F.length("word") >= 4).select(F.concat(F.lit("w-"), F.substring("word", 1, 1)).alias("view"), F.lit("album").alias("channel"), F.col("word").alias("term"))
    barred = [r.word for r in words.filter(F.length("word") >= 14).collect()]
    texts = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("uuid"), F.lit("album").alias("channel"), F.col("text").alias("value"))
    return term_hits(asked, texts, barred, ["album"]).groupBy("view", "uuid").agg(F.count("*").alias("terms"), F.min("term").alias("first_term"))


REQUEST = {
    "target": 90, "seed": 11, "candidate_multiplier": 1.5, "minimum_outside_prior_fraction": 0.95, "prior_corpus_album_title": "Supplier#000000002", "excluded_album_terms": ["supplier#00000001", " "], "derived_album_terms": ["SUPPLIER#000000003"],
    "views": [
        {"id": "warm", "quota": 30, "terms": ["Red", "red", "building"], "people": ["customer#00000001"], "albums": ["supplier#0000000"], "year_start": 1995, "year_end": 2009},
        {"id": "cool", "quota": 60, "terms": ["blue", "nation_1", "brand#2"], "places": ["nation_2"], "search_terms": ["urgent"], "year_end": 2000},
    ],
}


def archive(spark, d):
    """(assets, relations): parts as an inventory, with what lines and orders say of them as relations."""
    size, uuid = F.col("p_size"), F.col("p_partkey").cast("string").alias("uuid")
    assets = table(spark, d, "part").select(
        uuid, F.concat("p_name", F.lit(".jpg")).alias("filename"), F.when(size % 4 != 0, F.concat("p_name", F.lit(" original"))).alias("original_filename"), F.col("p_type").alias("title"), F.col("p_brand").alias("description"),
        (size != 50).alias("is_photo"), (size == 49).alias("hidden"), F.lit(False).alias("trashed"), (size == 13).alias("missing"), (size % 7 == 0).alias("favorite"), (size % 5 == 0).alias("edited"), (size % 3).alias("face_count"),
        F.when(size % 9 != 0, 1990 + size % 30).alias("year"), F.concat(1990 + size % 30, F.lit("-05-06T07:08:09")).alias("date_created"), F.when(size % 11 == 0, F.col("p_brand")).alias("burst_key"), F.when(size % 8 == 0, F.col("p_name")).alias("duplicate_group_id"),
        size.alias("width"), F.when(size % 2 == 0, 0).otherwise(size).alias("height"), F.col("p_retailprice").alias("overall_aesthetic_score"), F.col("p_type").alias("camera_make"), F.concat(F.lit(" "), "p_brand").alias("camera_model"),
    )
    line = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("uuid"), "l_suppkey", "l_orderkey", "l_returnflag")
    places = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    people = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    all_of = line.join(places, F.col("l_suppkey") == F.col("s_suppkey")).join(people, F.col("l_orderkey") == F.col("o_orderkey"))
    named = {"album": "s_name", "place": "n_name", "person": "c_name", "keyword": "l_returnflag", "label": "c_mktsegment", "search": "o_orderpriority"}
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(v).alias("value")) for c, v in named.items()])).alias("_r")
    dealt = all_of.select("uuid", *named.values()).repartition(parts_of(line, len(named)), "uuid")  # a line moves as one row
    return assets, dealt.select("uuid", each).select("uuid", "_r.*").distinct()


def q_terms_sql() -> str:
    rows = [(v, c, t, rt.WEIGHTS[c], rt.REASONS.get(c, c)) for v, c, t in rt.request_terms(REQUEST)]
    return "terms(view, channel, term, weight, reason) as (values " + ", ".join(f"('{v}', '{c}', '{t}', {w}, '{r}')" for v, c, t, w, r in rows) + ")"


RETRIEVE_SQL = (
    "with "
    + q_terms_sql()
    + """, assets as (
  select p_partkey::varchar as uuid, p_name || '.jpg' as filename, case when p_size % 4 <> 0 then p_name || ' original' end as original_filename, p_type as title, p_brand as description, p_size <> 50 and p_size <> 49 as visible,
    p_size % 7 = 0 as favorite, p_size % 5 = 0 as edited, p_size % 3 as faces, case when p_size % 9 <> 0 then 1990 + p_size % 30 end as year, (1990 + p_size % 30)::varchar as made, p_size, p_brand, p_type, p_name, p_retailprice,
    case when p_size % 7 = 0 and p_size % 5 = 0 then 12 when p_size % 7 = 0 then 7 when p_size % 5 = 0 then 5 else 0 end as attention
  from part
), whole as (
  select l_partkey::varchar as uuid, s_name, n_name, c_name, l_returnflag, c_mktsegment, o_orderpriority from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
), relations as (
  select distinct uuid, 'album' as channel, s_name as value from whole union select uuid, 'place', n_name from whole union select uuid, 'person', c_name from whole
  union select uuid, 'keyword', l_returnflag from whole union select uuid, 'label', c_mktsegment from whole union select uuid, 'search', o_orderpriority from whole
), texts as (
  select uuid, channel, value from relations union all select uuid, channel || '-term', value from relations where channel in ('album', 'place')
  union all select uuid, 'asset-text', filename || ' ' || coalesce(original_filename, '') || ' ' || title || ' ' || description from assets where visible
), matched as (
  select t.view, x.uuid, t.weight, t.reason from texts x join terms t on x.channel = t.channel and contains(lower(x.value), t.term)
  where not (x.channel in ('album', 'album-term') and (contains(lower(x.value), 'supplier#00000001') or contains(lower(x.value), 'supplier#000000003')))
), summed as (select view, uuid, sum(weight)::bigint as score, list(distinct reason) as reasons from matched group by view, uuid
), bonus as (select s.*, coalesce(case view when 'warm' then year between 1995 and 2009 else year between 0 and 2000 end, false) as hit from summed s join assets using (uuid)
), scores as (select view, uuid, score + case when hit then 2 else 0 end as score, list_sort(case when hit then list_append(reasons, 'supporting-date-range') else reasons end) as reasons,
    ('0x' || substr(sha256('11:' || view || ':' || uuid), 1, 16))::ubigint::double / 18446744073709551616.0 as noise from bonus
), total as (select uuid, max(score) + any_value(attention) as score from scores join assets using (uuid) group by uuid
), ranked as (select view, uuid, row_number() over (partition by view order by score + attention desc, noise desc, uuid desc) as rank from scores join assets using (uuid)
), took as (select uuid, case view when 'warm' then 0 else 1 end as place, rank from ranked where rank <= case view when 'warm' then 45 else 90 end qualify row_number() over (partition by uuid order by place, rank) = 1
), views as (select uuid from took order by place, rank limit 135
), spare as (select uuid, favorite::int + edited::int as flags, faces from assets where visible and (favorite or edited or faces > 0)
), filled as (select uuid from views union all (select uuid from spare where uuid not in (select uuid from views) order by flags desc, faces desc, uuid limit 135 - (select count(*) from views))
), prior as (select distinct uuid from relations where channel = 'album' and value = 'Supplier#000000002'
), chosen as (select f.uuid, coalesce(t.score, 0) as score, f.uuid in (select uuid from prior) as inside from filled f left join total t using (uuid)
), leaving as (select uuid, row_number() over (order by score, uuid) as k from chosen where inside
), entering as (select uuid, row_number() over (order by score desc, uuid desc) as k from total where uuid not in (select uuid from prior) and uuid not in (select uuid from chosen)
), swaps as (select least(greatest(0, ceil(135 * 0.95) - (select count(*) from chosen where not inside)), (select count(*) from leaving), (select count(*) from entering)) as n
), final as (select uuid from chosen where uuid not in (select uuid from leaving where k <= (select n from swaps)) union all select uuid from entering where k <= (select n from swaps)
), held as (
  select uuid, string_agg(value, ';' order by value) filter (where channel = 'person') as persons, string_agg(value, ';' order by value) filter (where channel = 'label') as labels, string_agg(value, ';' order by value) filter (where channel = 'place') as places,
    string_agg(value, ';' order by value) filter (where channel = 'album' and not (contains(lower(value), 'supplier#00000001') or contains(lower(value), 'supplier#000000003'))) as albums
  from relations group by uuid
), found as (
  select uuid, string_agg(view, ';' order by score desc, view) as views, string_agg(array_to_string(list_transform(reasons, lambda r: view || ':' || r), ';'), ';' order by score desc, view) as basis, max(score) as best from scores group by uuid
)
select uuid, coalesce(original_filename, filename) as filename, coalesce(views, '') as candidate_views, coalesce(basis, '') as retrieval_basis,
  case when best >= 12 then 'high' when best >= 6 then 'medium' when best > 0 then 'low' else 'unknown' end as evidence_confidence, printf('%.2f', coalesce(best, 0)::double) as metadata_score, '' as visible_context,
  coalesce(persons, '') as persons, coalesce(albums, '') as albums, coalesce(labels, '') as labels, coalesce(places, '')[1:500] as place, favorite::varchar as favorite, edited::varchar as edited, 'clear' as safety_status, '' as safety_reason,
  (p_size = 49)::varchar as hidden, (p_size = 13)::varchar as missing, case when p_size % 8 = 0 then p_name else '' end as duplicate_group, case when p_size % 11 = 0 then p_brand else '' end as burst_group, p_retailprice::varchar as aesthetic_score,
  case when p_size % 11 = 0 then 'burst-' || sha256(p_brand)[1:20] else 'event-' || sha256(made || '-05-06 07|' || lower(p_type || ' ' || p_brand))[1:20] end as event_cluster, made || '-05-06T07:08:09' as date, coalesce(year::varchar, '') as year,
  p_size::varchar as width, case when p_size % 2 = 0 then '' else p_size::varchar end as height, faces::varchar as face_count, p_type as camera_make, ' ' || p_brand as camera_model, '' as local_path
from final join assets using (uuid) left join found using (uuid) left join held using (uuid)"""
)


@query(RETRIEVE_SQL)
def q_retrieve_full(spark, d):
    assets, relations = archive(spark, d)
    return rt.retrieve(assets, durable(relations), REQUEST)  # a retrieval reads the relations four times
