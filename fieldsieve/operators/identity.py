"""Digests that bind rows to each other: policies, masters, samples, feedback, safety manifests.

A digest of rows is one SHA-256 over their texts in order. It is a running hash: rows are sorted by
Spark, which spills, and one pass over the sorted stream feeds them to the hash, a batch of texts at a
time. So a group's rows pass through one task, as the definition asks, in the memory of one batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as x

# The fields that the digests cover.
FEEDBACK_FIELDS = (
    "uuid", "assigned_view", "primary_view", "proposal_id", "master_sha256", "view_selected_count", "judgment", "visible_reason", "evaluation_note", "error_category", "round_id",
    "reviewer_actor", "reviewer_lens", "sample_sha256", "inspection_path", "inspection_sha256", "inspection_round_id", "inspection_sample_sha256", "safety_status", "hidden", "missing",
)
SAFETY_FIELDS = ("uuid", "safety_status", "safety_reason", "hidden", "missing", "perceptual_cluster_id", "duplicate_group", "duplicate_group_id", "burst_group")
SAMPLE_FIELDS = ("uuid", "primary_view", "proposal_id", "master_sha256", "config_sha256", "view_selected_count", "sampling_reason", "round_id")


def policy_digest(policy: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def field(rows: DataFrame, name: str) -> Column:
    return x.text(F.col(name)) if name in rows.columns else F.lit("")


def fold_digests(rows: DataFrame, by: list[str], text: Column, order: list[Column], head: str = "", between: str = "", tail: str = "") -> DataFrame:
    """(by, digest, n): of each group the SHA-256 of its texts in order, with ``head`` before, ``between`` between and ``tail`` after them.

    Groups are dealt to tasks and sorted there, rows of one order by their texts, so that a text is held
    once; without ``by`` there is one row, of no rows too. Null texts are left out.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    made = rows.select(*[F.col(f"`{c}`") for c in by], *[c.alias(k) for k, c in zip(keys, order, strict=True)], text.alias("_text")).filter("_text is not null")
    placed = made.repartition(*by) if by else made.repartition(1)
    kinds = {f.name: f.dataType.simpleString() for f in made.schema.fields}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, n = None, None, 0

        def told() -> pa.RecordBatch:
            state.update(tail.encode())
            return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in at), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=[*by, "digest", "n"])

        for batch in batches:
            texts, own = batch.column("_text"), [batch.column(c) for c in by]
            cuts = [0, *changes(own, batch.num_rows), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                here = [(c[i].as_py(), c.type) for c in own]
                if state is None or here != at:
                    if state is not None:
                        yield told()
                    at, state, n = here, hashlib.sha256(head.encode()), 0
                piece = between.join(texts.slice(i, j - i).to_pylist())
                state.update(((between if n else "") + piece).encode())
                n += j - i
        if state is not None:
            yield told()

    out = placed.sortWithinPartitions(*by, *keys, "_text").select(*by, "_text").mapInArrow(fold, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "digest string", "n long"]))
    if by:
        return out
    none = hashlib.sha256((head + tail).encode()).hexdigest()
    return out.agg(F.coalesce(F.max("digest"), F.lit(none)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("n"))


def changes(columns: list[pa.Array], rows: int) -> list[int]:
    """Where a row differs from the one before it."""
    if not columns or rows < 2:
        return []
    differs = np.zeros(rows - 1, bool)
    for c in columns:
        codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        differs |= codes[1:] != codes[:-1]
    return (np.flatnonzero(differs) + 1).tolist()


def lines_digests(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """(by, digest, n): SHA-256 of each group's sorted ids, a line feed after each."""
    return fold_digests(rows, by, F.concat(value, F.lit("\n")), [value])


def rows_digest(rows: DataFrame, fields: dict[str, Column], order: list[Column]) -> DataFrame:
    """One row (digest, n): SHA-256 of the JSON array of rows in this order, then in that of their texts; fields that are null are left out."""
    return fold_digests(rows, [], x.canonical_json(fields), order, "[", ",", "]")


def assigned(rows: DataFrame) -> Column:
    """The view a row is assigned to, or else its primary view."""
    return F.coalesce(F.nullif(field(rows, "assigned_view"), F.lit("")), field(rows, "primary_view"))


def master_digest(master: DataFrame) -> DataFrame:
    bound = F.nullif(field(master, "config_sha256"), F.lit(""))
    return rows_digest(master, {"uuid": F.col("uuid"), "assigned_view": assigned(master), "config_sha256": bound}, [assigned(master), F.col("uuid")])


def feedback_digest(feedback: DataFrame) -> DataFrame:
    fields = {f: field(feedback, f) for f in FEEDBACK_FIELDS}
    return rows_digest(feedback, fields, [fields["uuid"], fields["primary_view"], fields["round_id"]])


def safety_digest(holds: DataFrame) -> DataFrame:
    fields = {f: field(holds, f) for f in SAFETY_FIELDS}
    return rows_digest(holds, fields, [fields["uuid"]])


def sample_digest(sample: DataFrame) -> DataFrame:
    fields = {f: field(sample, f) for f in SAMPLE_FIELDS}
    return rows_digest(sample, fields, [fields["primary_view"], fields["uuid"]])


def proposal_id(digest: Column) -> Column:
    return F.concat(F.lit("pfp-"), F.substring(digest, 1, 16))


def bound(rows: DataFrame, policy: dict[str, Any]) -> DataFrame:
    """rows with config_sha256, master_sha256 and proposal_id of exactly these rows, and defaults for the publication ledger."""
    rows = rows.withColumn("config_sha256", F.lit(policy_digest(policy)))
    one = master_digest(rows).select(F.col("digest").alias("master_sha256"), proposal_id(F.col("digest")).alias("proposal_id"))
    kept = lambda name, default: F.coalesce(F.nullif(field(rows, name), F.lit("")), F.lit(default))
    rows = rows.drop("master_sha256", "proposal_id").withColumns({"provenance_status": kept("provenance_status", "retrieval-only"), "publication_state": kept("publication_state", "publication-review-required")})
    return rows.crossJoin(F.broadcast(one))  # one row


def identity_errors(master: DataFrame) -> DataFrame:
    """(check, failures): why a master is not the exact bound one."""
    one = master_digest(master).select("digest", "n")
    ids = x.strip(F.col("uuid"))
    rows = master.crossJoin(F.broadcast(one)).agg(
        F.count_if(ids == "").alias("blank ids"), (F.count("*") - F.count_distinct(ids)).alias("repeated ids"),
        F.count_if(field(master, "master_sha256") != F.col("digest")).alias("master digest differs"), F.count_if(field(master, "proposal_id") != proposal_id(F.col("digest"))).alias("proposal id differs"),
        (F.count("*") == 0).cast("long").alias("no rows"),
    )
    return rows.unpivot([], [F.col(f"`{c}`") for c in rows.columns], "check", "failures")


def require_bound(master: DataFrame, what: str) -> None:
    """Fails unless master is exact: rows, ids of their own, and digest and proposal id of exactly these rows."""
    if bad := [r.check for r in identity_errors(master).filter("failures > 0").collect()]:
        raise ValueError(f"{what} requires the exact bound master: {', '.join(sorted(bad))}")
