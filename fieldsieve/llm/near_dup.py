"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words (fewer in shorter texts); its weight is its count in the text times its idf,
1 + ln((1 + N) / (1 + df)). Document frequencies are counted over all documents, exactly for every
shingle of a share of 1/COMMON of the documents (or of 1/ENTRIES of all shingles) and more; rarer ones
count as having that share, so at most ENTRIES shingles are in the table whatever the corpus, and it
can be broadcast. Consistent weighted samples collide with the probability of the weighted Jaccard
similarity; bands of them give candidates, which are verified by the exact weighted Jaccard similarity
of their texts.

Defined cases: texts of the same words (case and punctuation aside) are copies; null texts and texts
without a word are in no class but their own; rows may repeat a doc_id or have none, each gets its
row back; extra columns ride along, whatever their names; an empty table gives no rows; texts of any
length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, release, small_batches, table
from .lsh import SHARED, bands_for, links, shared_rows

THRESHOLD, RECALL, HASHES = 0.8, 0.995, 24
COMMON, ENTRIES = 128, 1 << 18
CHUNK = 4096  # documents whose shingles a task counts at once
CHUNK_WORDS = 4_000_000
_SEEN_BITS = 20
_POOL_BITS = 16


class Idf:
    """Idf of the frequent shingles, and one value for all others."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, docs: int, least: float):
        order = np.argsort(shingles)
        self.shingles, self.values = shingles[order], 1 + np.log((1 + docs) / (1 + np.maximum(df[order], least)))
        self.rare = 1 + np.log((1 + docs) / (1 + least))
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[self.shingles >> np.uint64(64 - _SEEN_BITS)] = True

    def places(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of s are in the table, and where they stand in it."""
        at = np.flatnonzero(self.seen[s >> np.uint64(64 - _SEEN_BITS)])
        place = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
        same = self.shingles[place] == s[at] if len(at) else np.zeros(0, bool)
        return at[same], place[same]

    def of(self, s: np.ndarray) -> np.ndarray:
        out = np.full(len(s), self.rare)
        at, place = self.places(s)
        out[at] = self.values[place]
        return out


def text_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Each text's distinct shingles, where they begin, their counts; and the words' (hashes, bounds)."""
    h, bounds, _, _ = tk.words(texts)
    s, at, n = tk.distinct(*tk.shingles(h, bounds))
    return s, at, n, (h, bounds)


def shingle_idf(docs: DataFrame) -> Idf:
    """Counts in how many documents the frequent shingles stand.

    What has a share of all documents has at least this share in some chunk of them. So tasks name what
    has a quarter of it in a chunk of theirs, and of what is named half that often the second pass counts
    all. Small partitions are read together, as a chunk of few documents tells little.
    """
    rows = docs.select("text")
    parts, wanted = rows.rdd.getNumPartitions(), max(docs.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // CHUNK))
    rows = rows.coalesce(wanted) if wanted < parts else rows

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(held: list, docs: int) -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(held), return_counts=True)
            total = int(n.sum())
            some = n * 4 >= max(docs / COMMON, total / ENTRIES)
            shingle = pa.concat_arrays([pa.array(s[some].view(np.int64)), pa.nulls(1, pa.int64())])
            return pa.RecordBatch.from_arrays([shingle, pa.array(np.append(n[some], docs)), pa.array(np.append(np.zeros(some.sum(), np.int64), total))], names=["shingle", "n", "total"])

        held, words, docs = [], 0, 0
        for batch in batches:
            s, *_ = text_shingles(batch.column("text"))
            held, words, docs = [*held, s], words + len(s), docs + batch.num_rows
            if docs >= CHUNK or words >= CHUNK_WORDS:
                yield send(held, docs)
                held, words, docs = [], 0, 0
        if held:
            yield send(held, docs)

    named = materialize(rows.mapInArrow(suspects, "shingle long, n long, total long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    whole = named.filter("shingle is null").first()
    n, total = (whole.n, whole.total) if whole else (0, 0)
    least = max(n / COMMON, total / ENTRIES)
    some = named.filter(F.col("shingle").isNotNull() & (F.col("n") * 2 >= least)).select("shingle").toPandas()["shingle"].to_numpy(np.int64)  # 2 * ENTRIES at most
    release(named)
    table = Idf(some.view(np.uint64), np.zeros(len(some)), n, least)
    if not len(some):
        return table
    known = docs.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(known.value.shingles), np.int64)
        for batch in batches:
            found += np.bincount(known.value.places(text_shingles(batch.column("text"))[0])[1], minlength=len(found))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["at", "n"])

    df = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toPandas()  # ENTRIES at most
    known.destroy()
    return Idf(table.shingles[df["at"].to_numpy(np.int64)], df["n"].to_numpy(np.float64), n, least)


def weighted_shingles(texts: pa.Array, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Each text's distinct shingles, where they begin, their weights; and the words' (hashes, bounds)."""
    s, at, n, held = text_shingles(texts)
    return s, at, n * idf.of(s), held


@lru_cache(1)
def _pool() -> tuple[np.ndarray, ...]:
    """Random draws (r, 1/r, beta, ln c) that hash functions index by shingle, ln c by other bits than the rest."""
    u = [(tk.stream(100 + i, 1 << _POOL_BITS) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 1e-17 for i in range(5)]
    r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
    return tuple(x.astype(np.float32) for x in (r, 1 / r, u[4], np.log(c)))


def icws(s: np.ndarray, at: np.ndarray, w: np.ndarray, hashes: int) -> np.ndarray:
    """Consistent weighted samples [texts, hashes]; rows of texts without shingles stay 0."""
    out = np.zeros((len(at) - 1, hashes), np.uint64)
    n = np.diff(at)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    r_, inverse_, beta_, lnc_ = _pool()
    starts, lengths, lw = at[:-1][full], n[full], np.log(w).astype(np.float32)
    for k, odd in enumerate(tk.stream(7, hashes) | np.uint64(1)):
        x = s * odd
        i, j = (x >> np.uint64(64 - _POOL_BITS)).astype(np.int64), ((x >> np.uint64(64 - 2 * _POOL_BITS)) & np.uint64((1 << _POOL_BITS) - 1)).astype(np.int64)
        beta, r = beta_[i], r_[i]
        t = np.floor(lw * inverse_[i] + beta)
        a = lnc_[j] - r * (t - beta) - r
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, starts), lengths))
        first = hit[np.searchsorted(hit, starts)]
        out[full, k] = tk.mix(s[first] ^ tk.mix(t[first].astype(np.int64).astype(np.uint64) + np.uint64(1)))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(signature), bands), np.uint64)
    for b, seed in enumerate(tk.stream(21, bands)):
        value = np.full(len(signature), seed, np.uint64)
        for j in range(rows):
            value = tk.mix(value * np.uint64(0x9E3779B97F4A7C15) ^ signature[:, b * rows + j])
        keys[:, b] = value
    return keys.view(np.int64)


def binary16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Digests as 16-byte values."""
    raw = np.ascontiguousarray(np.stack([a, b], 1)).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(raw)]).cast(pa.binary())


def long_lists(values: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; empty where not kept."""
    offsets = np.concatenate(([0], np.cumsum(keep * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[keep.astype(bool)].ravel()))


def text_key() -> Column:
    """With doc_id, tells rows apart that share an id."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def features(docs: DataFrame, idf: Broadcast, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, node, size, keys) for each row of docs; node is null where there is no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at, w, (h, bounds) = weighted_shingles(batch.column("text"), idf.value)
            some = np.diff(at) > 0
            size = np.zeros(len(at) - 1)
            if some.any():
                size[some] = np.add.reduceat(w, at[:-1][some])
            keys = band_keys(icws(s, at, w, bands * rows), bands, rows)
            node = binary16(*tk.digest128(h, bounds))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.compute.if_else(pa.array(some), node, pa.scalar(None, pa.binary())), pa.array(size), long_lists(keys, some)],
                names=["doc_id", "text_key", "node", "size", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(work, f"doc_id {kind}, text_key long, node binary, size double, keys array<long>")


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sorted shingle sets (hashes, weights)."""
    total = float(a[1].sum() + b[1].sum())
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return common / (total - common) if total > common else 1.0


def comparer(docs: DataFrame, nodes: DataFrame, idf: Broadcast, threshold: float):
    """The functions load, verify and weigh that ``links`` asks for, over the texts of docs."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                coded = batch.column(side).dictionary_encode()
                s, at, w, _ = weighted_shingles(coded.dictionary, idf.value)
                sides.append([(s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in coded.indices.to_numpy()])
            keep = [jaccard(x, y) >= threshold for x, y in zip(*sides, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at, w, _ = weighted_shingles(batch.column("text"), idf.value)
            yield shared_rows(batch.column("node"), s, at, w)

    def load(wanted: DataFrame) -> DataFrame:
        wanted = wanted.join(nodes.select("node", "doc", "doc_key"), "node")
        row = docs.select("doc_id", "text", text_key().alias("text_key"))
        return row.join(wanted.hint("shuffle_hash"), row["doc_id"].eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("doc_key"))).select("node", "text").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(similar, "a binary, b binary")

    def weigh(texts: DataFrame) -> DataFrame:
        return texts.select("node", "text").mapInArrow(spread, SHARED)

    return load, verify, weigh


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, keep) for each row of docs.

    class_id is the least doc_id of the class, class_size the number of its rows; keep marks its first
    row (by doc_id, text_key). Identical rows (same doc_id and text) are marked alike.
    """
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall, hashes)
    idf = spark.sparkContext.broadcast(shingle_idf(docs))
    found = materialize(features(docs, idf, bands, rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key")))
    nodes = found.filter("node is not null").groupBy("node").agg(first.alias("_m"), F.count("*").alias("rows"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = materialize(nodes.select("node", F.col("_m.doc_id").alias("doc"), F.col("_m.text_key").alias("doc_key"), "rows", "size", "keys"))
    labels = links(nodes.select("node", "size", "keys"), threshold, *comparer(docs, nodes, idf, threshold))
    grouped = materialize(nodes.select("node", "doc", "doc_key", "rows").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    release(nodes, labels)
    tops = grouped.groupBy("label").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), F.col("doc"), F.col("doc_key"))).alias("top"), F.sum("rows").alias("class_size"))
    classes = grouped.join(tops, "label").select("node", F.col("top.doc").alias("class_id"), F.col("top.doc_key").alias("class_key"), "class_size")
    out = found.select("doc_id", "text_key", "node").join(classes, "node", "left")
    alone = F.col("node").isNull()
    return out.select(
        "doc_id", "text_key", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key")))).alias("keep"),
    )


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class left."""
    kept = near_classes(docs, threshold).filter("keep").groupBy(F.col("doc_id").alias("doc"), F.col("text_key").alias("key")).agg(F.count("*").alias("n"))
    kept = materialize(kept)
    row = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("text_key"))
    rows = row.join(kept.hint("shuffle_hash"), F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("key")))
    if kept.filter("n > 1").isEmpty():
        return rows.select("row.*")
    # identical rows of a class: the first of them; texts without a word are classes of their own and all stay
    wordless = ~F.coalesce(F.lower("row.text"), F.lit("")).rlike("[0-9a-z]|[^\\x00-\\x7f]")
    again = rows.filter((F.col("n") > 1) & ~wordless)
    return rows.filter((F.col("n") == 1) | wordless).select("row.*").unionByName(again.dropDuplicates(["doc", "key"]).select("row.*"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_size", "keep")


QUERIES = {"op8_near_duplicates": op8_near_dup}
ORACLES: dict[str, str] = {}
