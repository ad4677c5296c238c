"""Receipts of catalog writes against their plans, frozen sources, and verified previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions.nested import normal_digest
from .identity import fold_digests, lines_digests


def folder_differences(planned: DataFrame, received: DataFrame) -> DataFrame:
    """(key, reason): planned (key, title, parent_key) against received (key, title, identifier, parent_identifier)."""
    ids = received.select(F.col("key").alias("_parent"), F.col("identifier").alias("_parent_id"))
    plan = planned.join(ids, F.col("parent_key") == F.col("_parent"), "left").select("key", F.col("title").alias("_title"), F.col("parent_key").alias("_wants"), "_parent_id", F.lit(True).alias("_planned"))
    both = plan.join(received.withColumn("_got", F.lit(True)), "key", "full")
    parent = F.when(F.col("_wants").isNull(), F.col("parent_identifier").isNotNull()).otherwise(~F.col("parent_identifier").eqNullSafe(F.col("_parent_id")) | F.col("_parent_id").isNull())
    reason = F.when(F.col("_got").isNull(), "missing").when(F.col("_planned").isNull(), "unexpected").when(~F.col("title").eqNullSafe(F.col("_title")), "title differs").when(parent, "parent differs")
    return both.select("key", reason.alias("reason")).filter("reason is not null")


def album_differences(planned: DataFrame, received: DataFrame, folders: DataFrame) -> DataFrame:
    """(title, reason): planned (title, parent_folder_key, asset_id), a row for each member, against received (title, count, parent_identifier)."""
    ids = folders.select(F.col("key").alias("parent_folder_key"), F.col("identifier").alias("_parent_id"))
    plan = planned.groupBy("title", "parent_folder_key").agg(F.count_distinct("asset_id").alias("_n")).join(ids, "parent_folder_key", "left").withColumn("_planned", F.lit(True))
    both = plan.join(received.withColumn("_got", F.lit(True)), "title", "full")
    reason = F.when(F.col("_got").isNull(), "missing").when(F.col("_planned").isNull(), "unexpected").when(F.col("count") != F.col("_n"), "count differs")
    return both.select("title", reason.when(~F.col("parent_identifier").eqNullSafe(F.col("_parent_id")), "parent differs").alias("reason")).filter("reason is not null")


def scalar_differences(receipt: DataFrame, plan: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, reason) of one-row tables: receipt fields that differ from the plan's."""
    one = receipt.select(F.struct(*receipt.columns).alias("r")).crossJoin(plan.select(F.struct(*plan.columns).alias("p")))  # rows of one each
    checks = F.array(*[F.when(~F.col(f"r.{mine}").cast("string").eqNullSafe(F.col(f"p.{other}").cast("string")), F.lit(mine)) for mine, other in fields.items()])
    return one.select(F.explode(F.array_compact(checks)).alias("field")).withColumn("reason", F.lit("differs from the plan"))


def normalized(received: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of these columns, for comparing two receipts whatever their order."""
    return received.select(columns).distinct()


def reconciled(requested: DataFrame, returned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records in the order asked for, errors): requested (uuid, position) and returned rows by canonical id."""
    key = x.canonical_id(F.col("uuid"))
    asked = requested.select(key.alias("_id"), "position")
    got = returned.withColumn("_id", key)
    times = got.groupBy("_id").agg(F.count("*").alias("_n"))
    both = asked.join(times, "_id", "full")
    reason = F.when(F.col("_n").isNull(), "missing").when(F.col("position").isNull(), "not asked for").when(F.col("_n") > 1, "repeated")
    return got.join(asked, "_id").orderBy("position").drop("_id"), both.select(F.col("_id").alias("uuid"), reason.alias("reason")).filter("reason is not null")


def single_root(folders: DataFrame, kind: int = 3999) -> DataFrame:
    """One row: whether there is exactly one internal root (of this kind, without title and parent)."""
    root = (F.col("kind") == kind) & (x.strip(F.col("title")) == "") & F.col("parent").isNull()
    return folders.agg((F.count_if(root) == 1).alias("single_root"))


def frozen_source(members: DataFrame, identifier: str, title: str | None = None) -> DataFrame:
    """One row: count and digest of a source's sorted ids, whatever their number."""
    kind = "visible-library-stills" if title is None else "album"
    one = lines_digests(members.select("uuid").distinct(), [], F.col("uuid"))
    return one.select(F.lit(kind).alias("kind"), F.lit(identifier).alias("identifier"), F.lit(title).alias("expected_title"), F.col("n").alias("expected_count"), F.col("digest").alias("identifier_sha256"))


def distinct_lines_digest(ids: DataFrame) -> DataFrame:
    """One row (digest, n): SHA-256 of the sorted distinct ids (uuid), joined by line feeds, and one line feed; of no ids, of one line feed."""
    return fold_digests(ids.select("uuid").distinct(), [], F.col("uuid"), [F.col("uuid")], "", "\n", "\n")


def inspection_totals(results: DataFrame) -> DataFrame:
    """One row: how many assets were inspected, cleared, held, unavailable, exported and failed."""
    state = F.col("safety_state")
    return results.agg(
        F.count("*").alias("inspected"), F.count_if(state == "clear-automated").alias("cleared"), F.count_if(state == "hold").alias("held"), F.count_if(state == "unavailable").alias("unavailable"),
        F.count_if(F.col("preview_exported")).alias("exported"), F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def verified_previews(inspections: DataFrame, files: DataFrame, allowed_tags: list[int]) -> DataFrame:
    """An index row for each inspection, with why its preview cannot be used.

    inspections: asset_identifier, preview_exported; files: name, path, digest, size, mode, width,
    height, tags, and source_bearing and error where known: ``files.scanned`` reads all of these from the
    pictures' bytes.
    """
    name = x.preview_name(F.col("local_identifier"))
    rows = inspections.select(x.strip(F.col("asset_identifier")).alias("local_identifier"), F.coalesce("preview_exported", F.lit(False)).alias("exported"))
    rows = rows.withColumn("uuid", x.canonical_id(F.col("local_identifier")))
    times = rows.groupBy(F.col("uuid").alias("_u")).agg(F.count("*").alias("_n"))
    known = lambda c, none: F.col(c) if c in files.columns else F.lit(none)
    found = files.select(F.col("name").alias("_name"), known("error", "").alias("_error"), known("source_bearing", False).alias("_bears"), *[F.col(c).alias(f"_{c}") for c in ("path", "digest", "size", "mode", "width", "height", "tags")])
    met = rows.join(times, F.col("uuid") == F.col("_u")).join(found, name == F.col("_name"), "left")
    broad = F.col("_mode").bitwiseAND(0o077) != 0
    reason = F.when(F.col("local_identifier") == "", "asset_identifier is blank").when(F.col("_n") > 1, "identifier repeats").when(~F.col("exported"), "preview not exported").when(F.col("_name").isNull(), "no file")
    reason = reason.when(broad, "permissions are broader than the owner's").when(F.coalesce("_error", F.lit("")) != "", F.concat(F.lit("no picture: "), "_error")).when((F.coalesce("_width", F.lit(0)) < 1) | (F.coalesce("_height", F.lit(0)) < 1), "no picture")
    unlisted = F.size(x.unlisted_tags(F.col("_tags"), F.array(*map(F.lit, allowed_tags)))) > 0
    reason = reason.when(F.col("_bears") | unlisted, "metadata tells the source")
    good = reason.isNull()
    kept = lambda c, none: F.when(good, F.col(c)).otherwise(F.lit(none))
    return met.select(
        "uuid", "local_identifier", F.coalesce("_path", F.lit("")).alias("preview_path"), kept("_digest", "").alias("preview_sha256"), kept("_size", 0).alias("bytes"), kept("_width", 0).alias("width"), kept("_height", 0).alias("height"),
        F.when(good, "ok").otherwise("invalid").alias("decode_status"), F.coalesce(reason, F.lit("")).alias("reason"),
    )


# What a receipt must say, and what a second execution may not share with the first.
RECEIPT_FIELDS = ("completed_at", "execution_nonce", "plan_id", "source_album_identifier", "source_identifier_sha256", "safety_mode")
FINGERPRINT_FIELDS = ("app_bundle_identifier", "app_binary_sha256", "plan_sha256")
COMPARED = ("plan_id", "source_album_identifier", "source_count", "source_identifier_sha256", "safety_mode", "folders", "albums", "execution_fingerprint")


def receipt_errors(rows: DataFrame) -> Column:
    """Why a receipt (RECEIPT_FIELDS, source_count, execution_fingerprint, folders, albums) cannot be used; empty if it can."""
    blank = x.is_blank
    lacks = lambda items, f: F.exists(items, lambda i: blank(i[f]))
    repeats = lambda items, f: F.size(F.array_distinct(F.transform(items, lambda i: i[f]))) < F.size(items)
    none = lambda c: F.coalesce(F.size(c) < 1, F.lit(True))
    checks = [(blank(F.col(c)), f"{c} is missing") for c in RECEIPT_FIELDS]
    checks += [
        (~blank(F.col("completed_at")) & F.try_to_timestamp(F.col("completed_at")).isNull(), "completed_at is no time"), (~x.has_format(F.col("execution_nonce"), "nonce"), "execution_nonce is malformed"),
        (F.coalesce(F.col("source_count") < 1, F.lit(True)), "source_count must be positive"), (~x.has_format(F.col("source_identifier_sha256"), "sha256"), "source_identifier_sha256 is no digest"),
    ]
    checks += [(blank(F.col(f"execution_fingerprint.{c}")), f"execution_fingerprint.{c} is missing") for c in FINGERPRINT_FIELDS]
    checks += [(~blank(F.col(f"execution_fingerprint.{c}")) & ~x.has_format(F.col(f"execution_fingerprint.{c}"), k), f"execution_fingerprint.{c} is malformed") for c, k in zip(FINGERPRINT_FIELDS, ("bundle", "sha256", "sha256"), strict=True)]
    for name, kind, fields, keys in (("folders", "folder", ("key", "title", "identifier"), ("key", "identifier")), ("albums", "album", ("title", "identifier"), ("title", "identifier"))):
        items = F.coalesce(F.col(name), F.array())
        checks += [(none(name), f"{name} are missing")]
        checks += [(lacks(items, f), f"{kind} lacks {f}") for f in fields]
        checks += [(F.exists(items, lambda i: ~blank(i["identifier"]) & ~x.has_format(i["identifier"], "catalog-id")), f"{kind} identifier is malformed")]
        checks += [(repeats(items, f), f"{kind} {f} repeats") for f in keys]
    checks += [(F.exists(F.coalesce(F.col("albums"), F.array()), lambda a: F.coalesce(a["count"] < 1, F.lit(True))), "album count must be positive")]
    return x.reasons(*checks)


def receipt_comparison(first: DataFrame, second: DataFrame, key: str = "plan_id") -> DataFrame:
    """(key, equal, errors) of receipts of two executions of the same plans.

    equal: both say the same, whatever the order of their lists in any level. errors: what makes them no
    two executions (the same time, nonce or file), or one of them unusable, or missing.
    """
    kept = lambda rows, side: rows.select(
        F.col(key).alias(key), F.struct(*[F.col(c) for c in ("completed_at", "execution_nonce")], (F.col("path") if "path" in rows.columns else F.lit(None).cast("string")).alias("path")).alias(f"_{side}"),
        normal_digest(rows.withColumn("_r", F.struct(*COMPARED)), "_r").alias(f"_{side}_digest"), receipt_errors(rows).alias(f"_{side}_errors"),
    )
    one = kept(first.withColumn("_r", F.struct(*COMPARED)), "first")
    both = one.join(kept(second.withColumn("_r", F.struct(*COMPARED)), "second"), key, "full")
    same = lambda c: F.coalesce(F.col(f"_first.{c}") == F.col(f"_second.{c}"), F.lit(False))
    missing = [(F.col(f"_{s}").isNull(), f"no {s} receipt") for s in ("first", "second")]
    alike = x.reasons(*missing, (same("path"), "one file"), (same("completed_at"), "one time"), (same("execution_nonce"), "one nonce"))
    of = lambda s: F.transform(F.coalesce(f"_{s}_errors", F.array().cast("array<string>")), lambda e: F.concat(F.lit(f"{s}: "), e))
    return both.select(key, F.coalesce(F.col("_first_digest") == F.col("_second_digest"), F.lit(False)).alias("equal"), F.concat(alike, of("first"), of("second")).alias("errors"))
