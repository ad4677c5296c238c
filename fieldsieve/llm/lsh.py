"""Banded candidate search, exact verification and connected components, for any signature.

Nodes are distinct texts under a 16-byte digest, so exact copies never meet as pairs. Every pair of
nodes that share a band bucket is verified, or known to be in one class, or shown to be too far apart
by an exact bound; no bucket is collected anywhere.

Rounds of stars do most of it. In each bucket that still holds nodes of different components one node
is the head (the least by a hash of node and round); it is verified against the bucket's nodes of other
components, the verified edges contract components, and the head leaves the bucket, as all its pairs
there are settled. A round costs at most a pair for each node of a split bucket. In a large group of
variants, of which a share q is not similar to the head, about q^k stand outside after k rounds.

What is split after ROUNDS rounds is compared in full, but only rows outside their bucket's main
component against the rest, and in crowded buckets only where an exact bound allows the threshold t:
the common weight of two nodes is at least t/(1+t) of their joint size. Of a node's weight only
shingles that another of these nodes has can be common. Shingles are dealt to PARTS parts by hash; the
common weight is at most the sum of the lesser such weights by part, and one count of shingles gives
these for all nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialize, release


def bands_for(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` hashes that finds a pair at the
    threshold with at least this probability."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    return most, 1


#: Rounds of stars before what is left is compared in full.
ROUNDS = 4
#: Buckets of more nodes are crowded.
CROWD = 64
#: Parts of a node's shingles, by the first 6 bits of their hash, whose weights are compared one by one.
PARTS = 64


def links(
    nodes: DataFrame, threshold: float, load: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], weigh: Callable[[DataFrame], DataFrame], screen: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """(node, label) of the nodes that are linked to others, over nodes (node, size, keys); a label is a component's.

    ``load`` gives the texts (node, text) of nodes (node); ``verify`` keeps of pairs (a, b, text_a,
    text_b) those (a, b) similar enough; ``weigh`` gives the distinct shingles of texts (node, text) as
    rows of ``shared_rows``, weights adding up to size. ``screen``, where there is one, keeps of pairs (a, b)
    those that may be similar, by less than their texts.
    """
    bands = nodes.select(F.explode("keys").alias("key"), "node", "size")
    # what is found for each bucket is written first: so a bucket is counted before it moves, and Spark can split the join of a large one
    shared = materialize(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    rest = materialize(bands.join(shared, "key").withColumn("label", F.col("node")))
    release(shared)
    texts = materialize(load(rest.select("node").distinct()))
    labels, cores = materialize(rest.select("node", "label").limit(0)), nodes.sparkSession.sparkContext.defaultParallelism

    def similar(pairs: DataFrame) -> DataFrame:
        if not screen:
            one = pairs.join(texts.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
            return materialize(verify(one.join(texts.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")))
        # each step is written, so Spark knows its size: few pairs go to the nodes and the texts, and only texts of pairs that pass move
        asked = materialize(pairs)
        left = materialize(screen(asked))
        ids = materialize(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        some = materialize(texts.join(ids, "node"))
        one = left.join(some.withColumnsRenamed({"node": "b", "text": "text_b"}), "b")
        found = materialize(verify(one.join(some.withColumnsRenamed({"node": "a", "text": "text_a"}), "a").select("a", "b", "text_a", "text_b")))
        release(asked, left, ids, some)
        return found

    def contracted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(labels, new label of each old one) with these links (a, b between labels) added."""
        moved = components(found)
        now = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        fresh = moved.join(labels.select("node"), "node", "left_anti")  # nodes that were alone so far, and old labels under themselves
        return materialize(now.unionByName(fresh.select("node", "label"))), moved

    for turn in range(ROUNDS):
        head = F.min_by(F.struct(F.col("node").alias("head"), F.col("size").alias("head_size"), F.col("label").alias("head_label")), F.struct(F.xxhash64("node", F.lit(turn)), "node"))
        split = F.min("label") != F.max("label")
        heads = materialize(rest.groupBy("key").agg(head.alias("h"), split.alias("split")).filter("split").select("key", "h.*"))
        met = materialize(rest.join(heads, "key"))
        release(rest, heads)
        close = (F.col("size") >= threshold * F.col("head_size")) & (F.col("head_size") >= threshold * F.col("size"))
        star = met.filter((F.col("label") != F.col("head_label")) & close).select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("head_label").alias("la"), F.col("label").alias("lb")).distinct()
        found = similar(star.select("a", "b"))
        rest = met.filter("node <> head").drop("head", "head_size", "head_label")
        if found.isEmpty():
            rest = materialize(rest)
        else:
            held = found.join(star, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b"))
            old = labels
            labels, moved = contracted(held)
            rest = materialize(rest.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("key", "node", "size", "n", F.coalesce("to", "label").alias("label")))
            release(old, moved)
        release(met, found)
        if rest.isEmpty():
            break
    pairs = materialize(across(rest, nodes.select("node", "keys"), threshold, lambda wanted: weigh(texts.join(wanted, "node").coalesce(cores))))
    if not pairs.isEmpty():
        found = similar(pairs.select("a", "b"))
        if not found.isEmpty():
            old = labels
            labels, moved = contracted(found.join(pairs, ["a", "b"]).select(F.col("la").alias("a"), F.col("lb").alias("b")))
            release(old, moved)
        release(found)
    release(rest, texts, pairs)
    return labels


def across(rest: DataFrame, keys: DataFrame, threshold: float, weigh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b, la, lb) across components of the buckets that are still split, where no bound rules them out."""
    each = rest.groupBy("key", "label").agg(F.count("*").alias("k"))
    main = each.groupBy("key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), (F.count("*") > 1).alias("split")).filter("split").select("key", "main")
    main = materialize(main)
    rows = materialize(rest.join(main, "key").withColumn("level", F.floor(F.log(F.greatest("size", F.lit(1e-9))) / -math.log(threshold)).cast("int")))
    rows = within_reach(rows, threshold, weigh).join(keys, "node")
    other = rows.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "shared", "parts", "keys", "label", "main")], F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
    ratio = (F.col("size") >= threshold * F.col("size_b")) & (F.col("size_b") >= threshold * F.col("size"))
    needed = threshold / (1 + threshold) * (F.col("size") + F.col("size_b")) * (1 - 1e-9)
    lesser = F.aggregate(F.zip_with("parts", "parts_b", lambda x, y: F.least(x, y)), F.lit(0.0), lambda x, y: x + y)
    common = (F.least("shared", "shared_b") >= needed) & (F.col("parts").isNull() | F.col("parts_b").isNull() | (lesser >= needed))
    # a pair that meets in several buckets comes from the first of them: there it is still open, or a star has settled it
    once = F.array_intersect("keys", "keys_b")[0] == F.col("key")
    order = (F.col("label_b") == F.col("main_b")) | (F.col("node") < F.col("node_b"))
    met = rows.filter(F.col("label") != F.col("main")).join(other, ["key", "level"]).filter((F.col("label") != F.col("label_b")) & order & ratio & once & common)
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b"), F.col("label").alias("la"), F.col("label_b").alias("lb")).distinct()


SHARED = "node binary, shingle long, weight double, parts array<double>"


def shared_rows(nodes: pa.Array, s: np.ndarray, at: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    """What is known of the shingles (s, weights w, each node's from at on) of some nodes.

    A row (node, shingle, weight) for each that only one of these nodes has, a row (shingle) without node
    for each that more have, and for each node a row with the weight of the latter by part.
    """
    owner = np.repeat(np.arange(len(nodes)), np.diff(at))
    distinct, back, n = np.unique(s, return_inverse=True, return_counts=True)
    lone, marks = np.flatnonzero(n[back] == 1), distinct[n > 1]
    parts = np.zeros((len(nodes), PARTS))
    more = np.flatnonzero(n[back] > 1)
    np.add.at(parts, (owner[more], (s[more] >> np.uint64(64 - 6)).astype(np.int64)), w[more])
    none = pa.nulls(len(marks), pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([nodes.take(pa.array(owner[lone])), none, nodes]), pa.concat_arrays([pa.array(s[lone].view(np.int64)), pa.array(marks.view(np.int64)), pa.nulls(len(nodes), pa.int64())]),
            pa.array(np.concatenate((w[lone].astype(np.float64), np.zeros(len(marks) + len(nodes))))),
            pa.concat_arrays([pa.nulls(len(lone) + len(marks), pa.list_(pa.float64())), pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * PARTS), pa.array(parts.ravel()))]),
        ],
        names=["node", "shingle", "weight", "parts"],
    )


def within_reach(rest: DataFrame, threshold: float, weigh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rest with ``shared``, the weight that a pair can have in common, in all and (in crowded buckets)
    by part; rows that reach no pair are left out."""
    crowded = materialize(rest.filter(F.col("n") > CROWD).select("node").distinct())
    if crowded.isEmpty():
        return rest.withColumn("shared", F.col("size")).withColumn("parts", F.lit(None).cast("array<double>"))
    rows = materialize(weigh(crowded))
    told = rows.filter("shingle is not null")
    part = F.shiftrightunsigned("shingle", 64 - 6).alias("part")
    once = told.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("node").alias("node"), F.min("weight").alias("weight")).filter("_n = 1 and node is not null")
    signed = told.filter("node is not null").select("node", part, "weight").unionByName(once.select("node", part, (-F.col("weight")).alias("weight")))
    by_part = signed.groupBy("node", "part").agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("w"))
    lone = by_part.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "w"))).alias("_m"))
    both = rows.filter("parts is not null").select("node", "parts").join(lone, "node", "left")
    sums = F.transform("parts", lambda y, i: y + F.coalesce(F.try_element_at("_m", i.cast("long")), F.lit(0.0)))
    shared = materialize(both.select("node", sums.alias("_p")).withColumn("_w", F.aggregate("_p", F.lit(0.0), lambda y, z: y + z)))
    release(rows, crowded)
    full = F.col("n") > CROWD
    out = rest.join(shared, "node", "left").withColumn("shared", F.when(full, F.coalesce("_w", F.lit(0.0))).otherwise(F.col("size")))
    out = out.withColumn("parts", F.when(full, F.col("_p"))).drop("_w", "_p")
    return materialize(out.filter(F.col("shared") * (1 + 1e-9) >= threshold * F.col("size")))
