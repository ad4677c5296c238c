"""Manifests in and out: CSV of texts, JSON lines with checks, policies."""

from __future__ import annotations

import json
import os
import re
import stat
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import listed, scanned


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end every durable table that was made within it; for steps whose result is written elsewhere."""
    _scratch.append([])
    try:
        yield
    finally:
        release(*_scratch.pop())


def one_machine(spark: SparkSession) -> bool:
    """Whether all of Spark runs in this process, so that a folder of its own is shared (local-cluster has executors of its own)."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def durable(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares, and read again: computed once, no lineage, survives lost executors."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldsieve-")  # tests and single machines
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def release(*tables: DataFrame | None) -> None:
    """Delete durable tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "kept_at", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a part, where tables are dealt to tasks in parts of bounded size.
PART_ROWS = 1 << 20


def parts_of(df: DataFrame, width: int = 1) -> int:
    """So many parts that each has PART_ROWS rows of df on average, where each makes ``width`` rows; the session's number of partitions at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * width // PART_ROWS))


def read_manifest(spark: SparkSession, path: str, required: tuple[str, ...] = ("uuid", "filename")) -> DataFrame:
    """A CSV manifest as texts, blanks for missing values; fails on missing columns or no rows."""
    header = spark.read.text(path).first()
    if header is None:
        raise ValueError(f"{path}: no header")
    names = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
    names = [names[0].lstrip("\ufeff"), *names[1:]]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"{path}: missing columns {missing}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", True).csv(path)
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names])
    if rows.isEmpty():
        raise ValueError(f"{path}: no rows")
    return rows


def write_manifest(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """As CSV; with ``columns``, those in that order, blank where df has none, and no others."""
    if columns:
        df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit("")).alias(c) for c in columns])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def union_manifests(*tables: DataFrame) -> DataFrame:
    """Rows of all manifests with the union of their columns, in the order they are first seen, blank where one has none."""
    columns = list(dict.fromkeys(c for t in tables for c in t.columns))
    out = None
    for t in tables:
        rows = t.select(*[(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in t.columns else F.lit("")).alias(c) for c in columns])
        out = rows if out is None else out.unionByName(rows)
    return out


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by ``order``, then by its values; reduced before it moves."""
    values = [c for c in df.columns if c not in key]
    least = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*values).alias("_row")))
    return df.groupBy(*key).agg(least.alias("_least")).select(*key, "_least._row.*").select(df.columns)


def read_jsonl_reasons(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines as (line, record, reason): every line comes back, with why it cannot be used (not JSON, no key, repeated key)."""
    parsed = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", parsed, {"mode": "PERMISSIVE"}).alias("record")).filter(F.trim("line") != "")
    name = F.trim(F.coalesce(F.col(f"record.{key}").cast("string"), F.lit("")))
    times = rows.groupBy(name.alias("_key")).agg(F.count("*").alias("_n"))
    met = rows.join(times, name == F.col("_key"), "left")
    reason = F.when(F.col("record._corrupt_record").isNotNull(), "not valid JSON").when(name == "", f"{key} is blank").when(F.col("_n") > 1, f"{key} repeats")
    return met.select("line", F.struct(*[F.col(f"record.{f.name}").alias(f.name) for f in schema.fields]).alias("record"), reason.alias("reason"))


def read_artifact(spark: SparkSession, path: str) -> DataFrame | None:
    """A JSON, JSON lines or CSV artifact by its suffix; None where it has none of these or cannot be read."""
    try:
        if path.endswith(".csv"):
            return read_manifest(spark, path, ())
        if path.endswith((".jsonl", ".json")):
            rows = spark.read.option("multiLine", path.endswith(".json")).json(path)
            return None if "_corrupt_record" in rows.columns or rows.isEmpty() else rows
    except (AnalysisException, ValueError):
        return None
    return None


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, position, type) of all tables and views that a database (or the current one) has."""
    rows = [(t.name, f.name, i, f.dataType.simpleString()) for t in spark.catalog.listTables(database) for i, f in enumerate(spark.table(t.name if t.isTemporary else f"`{t.namespace[0]}`.`{t.name}`").schema.fields)]
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def missing_columns(df: DataFrame, wanted: dict[str, list[str]], tables: dict[str, DataFrame] | None = None) -> dict[str, list[str]]:
    """For each table name the wanted columns that it lacks (all of them, where there is no such table)."""
    have = {name: t.columns for name, t in (tables or {"": df}).items()}
    return {name: [c for c in columns if c not in have.get(name, [])] for name, columns in wanted.items()}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, digest, size) of the files under a path; a task reads its files in blocks, whatever their size."""
    return scanned(listed(spark, path)).select("path", "digest", "size")


def read_salt(path: str, least: int = 16) -> bytes:
    """A private salt: a file of its owner's alone, no link, long enough."""
    at = os.lstat(path)
    if stat.S_ISLNK(at.st_mode) or at.st_mode & 0o077:
        raise ValueError("the salt must be a file that only its owner can read, and no link")
    with open(path, "rb") as f:
        salt = f.read().strip()
    if len(salt) < least:
        raise ValueError(f"the salt must have at least {least} bytes")
    return salt


def read_unique_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines whose key occurs once; a malformed line or a repeated key fails."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.text(path).select(F.from_json("value", whole, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    if not rows.filter("_corrupt_record is not null").isEmpty():
        raise ValueError(f"{path}: malformed line")
    if not rows.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"{path}: repeated {key}")
    return rows.drop("_corrupt_record")


def decoded_meta(value) -> F.Column:
    """A value that is JSON, or its raw text as a JSON string."""
    return F.coalesce(F.to_json(F.try_parse_json(value)), F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2))


# What a policy, its views and its source must have, and the shares that it may set.
POLICY_FIELDS = ("seed", "target_count", "unclassified_view", "evaluation_sample_per_view", "source", "views")
VIEW_FIELDS, SOURCE_FIELDS = ("id", "label", "quota"), ("identifier", "expected_count", "identifier_sha256")
MODES = ("material", "sparse-hypothesis")
SHARES = ("minimum_eval_precision", "minimum_eval_coverage", "minimum_view_eval_precision", "maximum_eval_uncertainty", "minimum_named_people_fraction", "minimum_person_free_fraction")


def whole(value: Any, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def check_policy(policy: dict[str, Any]) -> list[str]:
    """What is wrong with a selection policy, as messages; empty if it can be used."""
    wrong = [f"{f} is missing" for f in POLICY_FIELDS if f not in policy]
    views = policy.get("views")
    if not isinstance(views, list) or not views:
        return [*wrong, "views must be a list that is not empty"]
    wrong += [f"view {i}: {f} is missing" for i, v in enumerate(views) for f in VIEW_FIELDS if f not in v]
    ids = [v.get("id") for v in views]
    if len(set(ids)) != len(ids) or not all(isinstance(i, str) and i for i in ids):
        wrong.append("view ids must be present and unique")
    if not all(whole(v.get("quota"), 0) for v in views):
        wrong.append("quotas must be whole numbers from 0")
    elif policy.get("target_count") != sum(v["quota"] for v in views):
        wrong.append("quotas must add up to target_count")
    wrong += [f"unknown evaluation mode {v['evaluation_mode']}" for v in views if v.get("evaluation_mode", MODES[0]) not in MODES]
    shares = {f: policy[f] for f in SHARES if f in policy} | {f"view {v.get('id')}: minimum_eval_precision": v["minimum_eval_precision"] for v in views if "minimum_eval_precision" in v}
    wrong += [f"{f} must lie in [0, 1]" for f, x in shares.items() if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1]
    positive = {"target_count": None, "evaluation_sample_per_view": None, "burst_limit": 2, "minimum_view_eval_sample": 2}
    wrong += [f"{f} must be a whole number from 1" for f, usual in positive.items() if not whole(policy.get(f, usual), 1)]
    if policy.get("unclassified_view") not in ids:
        wrong.append("unclassified_view must be a view")
    source = policy.get("source")
    if not isinstance(source, dict) or any(f not in source for f in SOURCE_FIELDS):
        wrong.append(f"source must have {', '.join(SOURCE_FIELDS)}")
    elif not str(source["identifier"]).strip() or not whole(source["expected_count"], 1) or not re.fullmatch("[a-f0-9]{64}", str(source["identifier_sha256"])):
        wrong.append("source needs an identifier, a positive expected_count and a lowercase SHA-256")
    return wrong


def read_policy(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        policy = json.load(f)
    if wrong := check_policy(policy):
        raise ValueError("; ".join(wrong))
    return policy
