"""The star-schema tables seen as a media inventory, its relations and its reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = ("de", "en", "es", "fr")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as inventory rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    twice = hashed.groupBy("sha").agg(F.count("*").alias("n")).filter("n > 1").select("sha", F.col("sha").alias("duplicate_group"))
    groups = hashed.join(twice, "sha").select("doc_id", "duplicate_group")
    confidence = F.when(F.col("quality").isNull(), "unknown").when(F.col("n_chars") >= 3000, "high").when(F.col("n_chars") >= 1000, "medium").otherwise("low")
    return docs.drop("text").join(labels, "doc_id", "left").join(groups, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("uuid"), F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")).alias("filename"), F.col("lang").alias("primary_view"), "source",
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("favorite"), (F.col("doc_id") % 6 == 0).alias("edited"),
        F.when(F.col("toxic") == 1, "hold").otherwise("clear").alias("safety_status"), confidence.alias("evidence_confidence"),
        F.when(F.col("doc_id") % 5 == 0, "Ada; Bo").otherwise("").alias("persons"), F.col("source").alias("visible_observation"),
        F.when(F.col("quality").isNotNull(), "reviewer").otherwise("unreviewed").alias("observation_source"), F.col("n_chars").cast("double").alias("aesthetic_score"),
        F.coalesce("duplicate_group", F.lit("")).alias("duplicate_group"), F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 60)).alias("burst_group"),
        F.when(F.col("quality") == 1, "fit").when(F.col("quality") == 0, "reject").otherwise("").alias("judgment"),
    )


#: The same inventory in SQL, to open an oracle query with.
INVENTORY_SQL = """
with inv as (
  select d.doc_id::varchar as uuid, 'doc-' || d.doc_id || '.txt' as filename, d.lang as primary_view, d.source,
    coalesce(l.quality = 1, false) as favorite, d.doc_id % 6 = 0 as edited,
    case when l.toxic = 1 then 'hold' else 'clear' end as safety_status,
    case when l.quality is null then 'unknown' when d.n_chars >= 3000 then 'high' when d.n_chars >= 1000 then 'medium' else 'low' end as evidence_confidence,
    case when d.doc_id % 5 = 0 then 'Ada; Bo' else '' end as persons, d.source as visible_observation,
    case when l.quality is not null then 'reviewer' else 'unreviewed' end as observation_source, d.n_chars::double as aesthetic_score,
    case when count(*) over (partition by sha256(d.text)) > 1 then sha256(d.text) else '' end as duplicate_group,
    d.source || '-' || (d.doc_id // 60) as burst_group,
    case when l.quality = 1 then 'fit' when l.quality = 0 then 'reject' else '' end as judgment
  from documents d left join labels l using (doc_id)
), noisy as (
  select *, ('0x' || substr(sha256('17:' || uuid), 1, 16))::ubigint::double / 18446744073709551616.0 as noise,
    case when favorite and edited then 12 when favorite then 7 when edited then 5 else 0 end as attention,
    case evidence_confidence when 'high' then 12 when 'medium' then 6 when 'low' then 2 else 0 end
      + case when persons <> '' then 4 else 0 end + case when visible_observation <> '' and observation_source = 'reviewer' then 3 else 0 end as evidence
  from inv
), scored as (select *, printf('%.6f', attention + evidence + noise) as score_total from noisy)
"""
