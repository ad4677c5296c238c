"""A catalog's tables as one inventory, plans over it as rows, and the writers that keep to them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..sources.io import durable, release
from .identity import field, fold_digests, rows_digest
from .review import membership_diff, ranked

# Bits of a picture's kind, confidences that count as none or as sure, and what a case must say.
SELFIE, PORTRAIT, PANORAMA = 32, 64, 1
UNSURE, SURE = ("unknown", "low", "low-context", "visible-general"), ("high", "frozen-eval")
SEVERITIES, SENTENCE, EXPECTATIONS = ("critical", "high", "medium", "low"), 40, 4


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0)) != 0


def assets(base: DataFrame, attributes: DataFrame, descriptions: DataFrame, computed: DataFrame, extended: DataFrame, faces: DataFrame) -> DataFrame:
    """A row for each visible picture of a catalog with all that its side tables know.

    base has pk, uuid and the picture's own fields; attributes, computed and extended hang on it by
    asset, descriptions on attributes by description; faces (asset, hidden, trashed) are counted.
    Times are seconds since 2001.
    """
    count = faces.filter(~flag(F.col("hidden")) & ~flag(F.col("trashed"))).groupBy("asset").agg(F.count("*").alias("n"))
    a, at, de, co, ex, fc = (t.alias(n) for n, t in (("a", base), ("at", attributes), ("de", descriptions), ("co", computed), ("ex", extended), ("fc", count)))
    rows = a.join(at, F.col("at.asset") == F.col("a.pk"), "left").join(de, F.col("de.pk") == F.col("at.description"), "left")
    for name, side in (("co", co), ("ex", ex), ("fc", fc)):
        rows = rows.join(side, F.col(f"{name}.asset") == F.col("a.pk"), "left")
    rows = rows.filter((F.col("a.kind") == 0) & ~flag(F.col("a.trashed")) & ~flag(F.col("a.hidden")))
    (created, year, month), (added, *_), (modified, *_) = (x.apple_parts(F.col(f"a.{c}")) for c in ("created", "added", "modified"))
    subtype = F.coalesce(F.col("a.kind_subtype"), F.lit(0))
    own = ["uuid", "pk", "filename", "width", "height", "burst_key", "burst_pick", "overall_aesthetic_score", "curation_score", "promotion_score", "highlight_score", "media_group", "latitude", "longitude"]
    scores = ["failure_score", "composition_score", "focus_score", "subject_score", "framing_score", "timing_score"]
    made = {
        "date_created": created, "year": year, "month": month, "date_added": added, "date_modified": modified, "is_photo": F.lit(True), "is_movie": F.lit(False), "favorite": flag(F.col("a.favorite")),
        "edited": flag(F.col("a.adjustments")) | F.col("at.unmanaged_adjustment").isNotNull(), "external_edit": x.text(F.col("at.editor")) != "", "hidden": F.lit(False), "trashed": F.lit(False), "missing": F.lit(False),
        "in_cloud": x.text(F.col("a.cloud_guid")) != "", "title": F.col("at.title"), "description": F.col("de.text"), "original_filename": F.col("at.original_filename"), "original_width": F.col("at.original_width"),
        "original_height": F.col("at.original_height"), "original_size": F.col("at.original_size"), "screenshot": flag(F.col("a.screenshot")), "selfie": x.has_flag(subtype, SELFIE), "portrait": x.has_flag(subtype, PORTRAIT),
        "panorama": x.has_flag(subtype, PANORAMA), "burst": flag(F.col("a.burst_kind")), "camera_make": F.col("ex.camera_make"), "camera_model": F.col("ex.camera_model"),
        "has_location": x.valid_location(F.col("a.latitude"), F.col("a.longitude")), "face_count": F.coalesce(F.col("fc.n"), F.lit(0)),
    }
    return rows.select(*[F.col(f"a.{c}").alias(c) for c in own], *[F.col(f"co.{c}").alias(c) for c in scores], *[c.alias(n) for n, c in made.items()])


def first_seen(rows: DataFrame, key: Column, position: str) -> DataFrame:
    """(key, position): each key where it first stands; order by position for the order of first sight."""
    return rows.groupBy(key.alias("key")).agg(F.min(position).alias(position))


def inspection_members(rows: DataFrame, position: str, limit: int | None = None) -> DataFrame:
    """(asset_identifier, position): the local identifiers that an inspection is to visit, once each, in order, up to a limit."""
    out = first_seen(rows.filter(x.canonical_id(F.col("uuid")) != ""), x.local_identifier(F.col("uuid")), position).withColumnRenamed("key", "asset_identifier")
    return out.orderBy(position).limit(limit) if limit else out


def reusable(done: DataFrame, previews: DataFrame) -> DataFrame:
    """Inspections that a resumed run may keep: one for each asset, whose preview, if it had one, is still there."""
    here = previews.select(F.col("path").alias("_path")).distinct()
    rows = done.dropDuplicates(["asset_identifier"]).join(here, F.col("preview_path") == F.col("_path"), "left")
    return rows.filter(~F.coalesce("preview_exported", F.lit(False)) | F.col("_path").isNotNull()).drop("_path")


def snapshot_members(master: DataFrame, test_size: int = 10) -> DataFrame:
    """(album, position, uuid): the albums of a snapshot, for the master (uuid, position, primary_view, persons, evidence_confidence).

    All rows, each view, rows with named people, rows of unsure evidence, and the rows to try a write with:
    sure ones first, then others, in order.
    """
    confidence = F.lower(F.when(field(master, "evidence_confidence") == "", "unknown").otherwise(field(master, "evidence_confidence")))
    view = F.when(x.strip(field(master, "primary_view")) == "", "00").otherwise(x.strip(field(master, "primary_view")))
    rows = master.select(x.canonical_id(F.col("uuid")).alias("uuid"), "position", view.alias("view"), (x.strip(field(master, "persons")) != "").alias("named"), confidence.isin(*UNSURE).alias("unsure"), confidence.isin(*SURE).alias("sure"))
    test = rows.orderBy(F.desc("sure"), "position").limit(test_size).withColumn("album", F.lit("write-test"))
    names = F.array_compact(F.array(F.lit("master"), F.concat(F.lit("view-"), "view"), F.when(F.col("named"), "named-people"), F.when(F.col("unsure"), "uncertain")))
    return rows.withColumn("album", F.explode(names)).unionByName(test).select("album", "position", "uuid")


# Titles of a snapshot's albums, the folders they stand in and what they are for.
SNAPSHOT = {
    "master": ("00 MASTER", "version", "editor"), "named-people": ("90 PEOPLE / NAMED ASSOCIATIONS", "version", "editor"), "uncertain": ("91 CONTEXT UNCERTAIN — EDITOR REVIEW", "version", "editor"),
    "hold": ("{version} — AUTOMATED SAFETY HOLD", "private", "hold"), "write-test": ("{version} — WRITE TEST — VERIFIED", "audit", "audit"),
}
OTHER_VIEW = "EDITOR VIEW"


def folder_specs(profile: dict[str, Any], version_title: str | None = None) -> list[dict[str, Any]]:
    """The folders (key, title, parent_key, existing_identifier) of a snapshot, parents first; with version_title, one for it under the root."""
    if {*profile["folders"]} != {"root", "private", "audit"}:
        raise ValueError("folders must be root, private and audit")
    above = profile.get("workspace_parent")
    spec = lambda key, title, parent, known=None: {"key": key, "title": title, "parent_key": parent, "existing_identifier": known}
    own = {k: profile["folders"][k] for k in ("root", "private", "audit")}
    out = [spec("workspace_parent", above["title"], None, above["identifier"])] if above else []
    out.append(spec("root", own["root"]["title"], "workspace_parent" if above else None, own["root"].get("identifier")))
    out += [spec("version", version_title, "root")] if version_title else []
    return out + [spec(k, own[k]["title"], "root", own[k].get("identifier")) for k in ("private", "audit")]


def snapshot_errors(master: DataFrame, holds: DataFrame, target: int) -> DataFrame:
    """(check, failures): why no snapshot may be made of this master (uuid, selection_reason) and these holds (uuid)."""
    ids = x.canonical_id(F.col("uuid"))
    own, held = master.select(ids.alias("uuid")), holds.select(ids.alias("uuid")).distinct()
    rows = master.agg(F.abs(F.count("*") - target).alias("rows off target"), (F.count("*") - F.count_distinct(ids)).alias("repeated ids"), F.count_if(x.strip(field(master, "selection_reason")) == "").alias("selection reason missing"))
    out = rows.unpivot([], [F.col(f"`{c}`") for c in rows.columns], "check", "failures")
    return out.unionByName(own.distinct().join(held, "uuid", "left_semi").agg(F.lit("overlap with holds").alias("check"), F.count("*").alias("failures")))


def snapshot_albums(master: DataFrame, holds: DataFrame, labels: dict[str, str], version: str, test_size: int = 10) -> DataFrame:
    """(plan, place, title, parent_folder_key, safety_role, n, asset_identifiers) of the albums of a snapshot's two plans.

    The write test has one album, production all: the master, each view, named people, uncertain rows, holds
    (uuid, position) and the write test, as far as they have members. Members are local identifiers in the
    master's order (sure ones first in the write test), once each; place orders the albums. Albums are bounded by the target and the holds.
    """
    version_title = {k: t.format(version=version) for k, (t, _, _) in SNAPSHOT.items()}
    members = snapshot_members(master, test_size)
    sure = F.lower(field(master, "evidence_confidence")).isin(*SURE)
    sure_first = master.select(x.canonical_id(F.col("uuid")).alias("uuid"), "position", sure.alias("sure")).orderBy(F.desc("sure"), "position").limit(test_size)
    kind = master.schema["position"].dataType
    tried = sure_first.select(F.lit("write-test").alias("album"), F.row_number().over(Window.orderBy(F.desc("sure"), "position")).cast(kind).alias("position"), "uuid")  # test_size rows at most
    members = members.filter("album <> 'write-test'").unionByName(tried).unionByName(holds.select(F.lit("hold").alias("album"), F.col("position").cast(kind).alias("position"), x.canonical_id(F.col("uuid")).alias("uuid")))
    first = members.groupBy("album", "uuid").agg(F.min("position").alias("position"))
    made = first.groupBy("album").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", "uuid"))).alias("m"))
    view = F.when(F.startswith("album", F.lit("view-")), F.substring("album", 6, 1 << 20))
    told = lambda i, other: F.create_map(*[F.lit(y) for k in SNAPSHOT for y in (k, (version_title[k], *SNAPSHOT[k][1:])[i])])[F.col("album")] if other is None else F.coalesce(F.create_map(*[F.lit(y) for k in SNAPSHOT for y in (k, SNAPSHOT[k][i])])[F.col("album")], F.lit(other))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in (labels or {"": ""}).items() for y in kv]), view), F.lit(OTHER_VIEW))
    title = F.when(view.isNotNull(), F.concat(view, F.lit(" "), named)).otherwise(told(0, None))
    count = F.when(F.col("album") == "write-test", F.concat(F.lit(" "), F.col("n").cast("string"))).otherwise(F.concat(F.lit(" — "), F.format_number("n", 0)))
    place = F.when(view.isNotNull(), F.concat(F.lit("1"), view)).otherwise(F.create_map(*[F.lit(y) for kv in zip(SNAPSHOT, ("0", "2", "3", "4", "5"), strict=True) for y in kv])[F.col("album")])
    ids = F.transform("m", lambda m: F.concat(m["uuid"], F.lit("/L0/001")))
    rows = made.select(place.alias("place"), F.concat(title, count).alias("title"), told(1, "version").alias("parent_folder_key"), told(2, "editor").alias("safety_role"), "n", ids.alias("asset_identifiers"), F.col("album") == "write-test")
    rows = rows.withColumnRenamed(rows.columns[-1], "_test")
    return rows.select(F.explode(F.when(F.col("_test"), F.array(F.lit("write-test"), F.lit("production"))).otherwise(F.array(F.lit("production")))).alias("plan"), *rows.columns[:-1])


def write_members(planned: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the planned rows that the table at path lacks, and says how many; refuses where it holds others.

    A repeated call adds nothing. The table is read again at the end and must hold exactly the plan.
    """
    spark = planned.sparkSession
    planned = planned.select(keys).distinct()
    planned.limit(0).write.mode("append").parquet(path)  # so that it can be read
    diff = membership_diff(planned, spark.read.schema(planned.schema).parquet(path), keys)
    if not (other := diff.filter("status = 'unexpected'")).isEmpty():
        raise ValueError(f"{path} holds rows outside the plan: {other.first()[0]}")
    missing = diff.filter("status = 'missing'").select(keys)
    added = missing.count()
    if added:
        missing.write.mode("append").parquet(path)
    if not membership_diff(planned, spark.read.schema(planned.schema).parquet(path), keys).isEmpty():
        raise ValueError(f"{path} does not hold the plan after the write")
    return added


def hadoop(df: DataFrame, path: str) -> tuple[Any, Any]:
    """The file system and path that Spark itself would use."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), at


def write_batches(planned: DataFrame, path: str, keys: list[str], size: int = 500, take_over: bool = False, after: Callable[[int], None] | None = None) -> list[int]:
    """Writes a plan's rows in batches of ``size`` in order of keys, each read again before the next; gives the numbers of those that were written now.

    A batch counts once its line (number, rows, digest, plan) stands beside the table, so a run that
    stopped goes on after its last whole batch, and a whole one replays nothing. Refuses a table that was
    begun for another plan, one whose written batches changed, and a second writer; ``take_over``
    removes what a writer that died left to keep others out. ``after`` is called with each batch.
    """
    spark, told = planned.sparkSession, f"{path}.batches"
    fs, lock = hadoop(planned, f"{path}.lock")
    if take_over:
        fs.delete(lock, False)
    fs.mkdirs(lock.getParent())
    if not fs.createNewFile(lock):
        raise ValueError(f"{path} has another writer")
    try:
        row = x.canonical_json({k: x.text(F.col(k)) for k in keys})
        rows = planned.select(*keys).distinct().select(F.lit("all").alias("part"), row.alias("row"), *keys)
        rows = durable(ranked(rows, "part", F.col("row")).select(F.floor(F.col("pos") / size).cast("long").alias("batch"), "row", *keys))
        whole = rows_digest(rows, {"row": F.col("row")}, [F.col("row")]).first().digest
        want = {r.batch: (r.n, r.digest) for r in fold_digests(rows, ["batch"], F.col("row"), [F.col("row")], between="\n").collect()}  # a line for each batch
        done = {r.batch: r for r in spark.read.schema("batch long, n long, digest string, plan string").json(told).collect()} if fs.exists(hadoop(planned, told)[1]) else {}
        if any(r.plan != whole for r in done.values()):
            raise ValueError(f"{path} was begun for another plan")
        found = batch_digests(spark.read.parquet(path), keys) if done else {}
        if changed := [b for b in sorted(done) if found.get(b) != want.get(b)]:
            raise ValueError(f"{path}: batch {changed[0]} is not what was written")
        written = []
        for batch in sorted(set(want) - set(done)):
            at = f"{path}/batch={batch}"
            rows.filter(F.col("batch") == batch).select(*keys).coalesce(1).write.mode("overwrite").parquet(at)
            back = batch_digests(spark.read.parquet(at).withColumn("batch", F.lit(batch)), keys).get(batch)
            if back != want[batch]:
                raise ValueError(f"{path}: batch {batch} does not read as it was written")
            spark.createDataFrame([(batch, *back, whole)], "batch long, n long, digest string, plan string").coalesce(1).write.mode("append").json(told)
            written.append(batch)
            if after:
                after(batch)
        release(rows)
        return written
    finally:
        fs.delete(lock, False)


def batch_digests(rows: DataFrame, keys: list[str]) -> dict[int, tuple[int, str]]:
    row = x.canonical_json({k: x.text(F.col(k)) for k in keys})
    return {r.batch: (r.n, r.digest) for r in fold_digests(rows.select(F.col("batch").cast("long").alias("batch"), row.alias("row")), ["batch"], F.col("row"), [F.col("row")], between="\n").collect()}


def save_table(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """A table bucketed and sorted by keys, with statistics, so that joins on them need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def write_private(path: str, data: str | dict[str, Any]) -> None:
    """A text, or a dictionary as JSON, that only its owner can read."""
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        os.fchmod(f.fileno(), 0o600)
        f.write(data if isinstance(data, str) else json.dumps(data, indent=2, sort_keys=True) + "\n")


def markdown(title: str, data: dict[str, Any]) -> str:
    """A report of a dictionary: a line for each value, a section for each dictionary in it."""
    label = lambda k: str(k).replace("_", " ").title()
    lines = [f"# {title}", ""]
    for k, v in data.items():
        lines += [f"## {label(k)}", "", *[f"- `{c}`: {n}" for c, n in v.items()], ""] if isinstance(v, dict) else [f"- **{label(k)}:** {v}"]
    return "\n".join(lines) + "\n"


def case_errors(cases: DataFrame, oracles: tuple[str, ...], closing: str) -> DataFrame:
    """(id, errors) of evaluation cases (id, name, prompt, expected_output, failure_mode, severity, oracle, tags, expectations).

    closing: pattern of the words by which an expectation of a critical case says that it fails closed.
    """
    short = [(F.char_length(x.strip(F.col(c))) < SENTENCE, f"{c} must be a specific sentence") for c in ("prompt", "expected_output", "failure_mode")]
    again = {c: (F.count("*").over(Window.partitionBy(c)) > 1) for c in ("id", "name", "prompt")}
    rows = cases.withColumns({f"_{c}": w for c, w in again.items()})
    closes = F.exists(F.coalesce("expectations", F.array().cast("array<string>")), lambda e: F.regexp_like(F.lower(e), F.lit(closing)))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    errors = x.reasons(
        (F.coalesce(F.col("id") < 1, F.lit(True)), "id must be a positive number"), (F.col("_id"), "id repeats"), (~x.has_format(F.col("name"), "kebab"), "name must be a kebab-case label"), (F.col("_name"), "name repeats"),
        *short, (F.col("_prompt"), "prompt repeats"), (~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False)), "unknown severity"), (~F.coalesce(F.col("oracle").isin(*oracles), F.lit(False)), "unknown oracle"),
        (size("tags") < 1, "tags are missing"), (size("expectations") < EXPECTATIONS, f"needs {EXPECTATIONS} expectations"), ((F.col("severity") == "critical") & ~closes, "critical case does not fail closed"),
    )
    return rows.select("id", errors.alias("errors")).filter(F.size("errors") > 0)


def capability_states(required: DataFrame, available: DataFrame) -> DataFrame:
    """(capability, state, missing): whether all, some or none of a capability's providers are there.

    required: capability, provider; available: provider.
    """
    there = available.select("provider").distinct().withColumn("there", F.lit(True))
    rows = required.select("capability", "provider").distinct().join(there, "provider", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    state = F.when(F.bool_and("there"), "AVAILABLE").when(F.bool_or("there"), "DEGRADED").otherwise("UNAVAILABLE")
    missing = F.array_sort(F.collect_set(F.when(~F.col("there"), F.col("provider"))))
    return rows.groupBy("capability").agg(state.alias("state"), missing.alias("missing"))
