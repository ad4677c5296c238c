"""Paragraph dedup: MinHash bands over paragraphs, exact verification, removal by components.

A paragraph is a line. Lines are banded by MinHash of their five-word shingles, colliding ones are
verified by exact Jaccard similarity, and linked or equal lines form classes.

A passage may also stand inside longer lines, or be set into other lines. So whole texts are also cut
into windows of WINDOW words, picked by what they hold: of each NEAR windows in a row the one with the
least hash. Any WINDOW + NEAR - 1 = 49 words in a row hold a picked window, and wherever these words
stand it is the same one. A window is too short to stand an edit at this similarity, so windows count
where they are the same; of an edited passage, those of each 49 unedited words in a row are found.

Of each class the first paragraph by (doc_id, start) stays and the others are marked for removal.
Only paragraphs and windows that are in a class of two or more come out. Defined cases: lines of fewer
than LEAST words, the length of a shingle, are never marked; null texts have none; texts of any length
count whole; a repeated row (same doc_id and text) has the same paragraphs at the same places, which
count as one and are not removed on each other's account; positions are code points; classes need no
document order; an empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, release, small_batches, table
from .lsh import SHARED, bands_for, links, shared_rows
from .near_dup import band_keys, binary16, long_lists, text_key

THRESHOLD, RECALL, HASHES = 0.8, 0.98, 8
LEAST = 5
WINDOW, NEAR = 20, 30
_BASE = 0x9E3779B97F4A7C15 | 1


def slide(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """The best of each ``width`` values in a row."""
    k = 1
    while 2 * k <= width:
        x = best(x[: max(0, len(x) - k)], x[k:])
        k *= 2
    return best(x[: max(0, len(x) - width + k)], x[width - k :]) if width > k else x


def members(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of all ranges end to end, and where each range begins (with the end)."""
    n = end - begin
    held = np.concatenate(([0], np.cumsum(n)))
    return np.arange(held[-1]) + np.repeat(begin - held[:-1], n), held


def picked(h: np.ndarray, bounds: np.ndarray, size: int = WINDOW, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """The first words of the picked windows, and the windows' hashes."""
    if len(h) < size + near - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    power, inverse = (np.cumprod(np.full(len(h), x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tk.mix(h) * power)))
    gram = np.maximum(tk.mix((sums[size:] - sums[:-size]) * inverse[: len(h) - size + 1]), np.uint64(1))
    low = slide(np.minimum, gram, near)
    low[owner[: len(low)] != owner[size + near - 2 :]] = 0  # windows that run over a text's end
    # of the rows that hold a window, one has it as its least exactly if the greatest of their least is it
    around = np.concatenate((np.zeros(near - 1, np.uint64), low, np.zeros(near - 1, np.uint64)))
    at = np.flatnonzero(slide(np.maximum, around, near) == gram)
    return at, gram[at]


def windows(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Text, start and end in code points, and two hashes of each text's picked windows."""
    h, bounds, starts, ends = tk.words(texts)
    at, one = picked(h, bounds)
    data, offsets = tk.utf8(pc.utf8_lower(texts))
    owner = np.searchsorted(bounds, at, side="right") - 1
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first = point[offsets[owner]]
    two, _ = tk.digest128(h[(at[:, None] + np.arange(WINDOW)).ravel()], np.arange(len(at) + 1) * WINDOW)
    return owner, point[starts[at]] - first, point[ends[at + WINDOW - 1]] - first, one, two


def lines(text: str) -> list[tuple[int, int]]:
    """(start, end) of the lines of a text."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def minhash(s: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """MinHash signatures [texts, hashes] of sorted distinct shingles."""
    out = np.zeros((len(at) - 1, hashes), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for k, odd in enumerate(tk.stream(31, hashes) | np.uint64(1)):
            x = s * odd
            out[full, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), at[:-1][full])
    return out


def paragraphs(docs: DataFrame, bands: int, rows: int, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, start, end, n_words, n_shingles, node, keys) for each line."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, texts = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text:
                    for start, end in lines(text):
                        if end - start >= 2 * least - 1:  # else it can't have so many words
                            units.append((i, start, end))
                            texts.append(text[start:end])
            if not units:
                continue
            h, bounds, _, _ = tk.words(pa.array(texts, pa.large_string()))
            n = np.diff(bounds)
            keep = np.flatnonzero(n >= least)
            if not len(keep):
                continue
            row, start, end = (np.array(x)[keep] for x in zip(*units, strict=True))
            member, held = members(bounds[keep], bounds[keep + 1])
            s, at, _ = tk.distinct(*tk.shingles(h[member], held))
            keys = band_keys(minhash(s, at, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), *[pa.array(x.astype(np.int32)) for x in (start, end, n[keep], np.diff(at))], binary16(*tk.digest128(h[member], held)), long_lists(keys, np.ones(len(keep), bool))],
                names=["doc_id", "text_key", "start", "end", "n_words", "n_shingles", "node", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(work, f"doc_id {kind}, text_key long, start int, end int, n_words int, n_shingles int, node binary, keys array<long>")


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"), F.col("start"), F.col("end"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, top) for each picked window that stands in two places or more; top is the first of these."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds, _, _ = tk.words(batch.column("text").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([pa.array(picked(h, bounds)[1].view(np.int64))], names=["one"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, one, two = windows(batch.column("text").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                names=["doc_id", "text_key", "start", "end", "one", "two"],
            )

    # the hashes first, so that only windows that stand elsewhere too are moved with their places
    seen = docs.select("text").mapInArrow(hashes, "one long").groupBy("one").agg(F.count("*").alias("n")).filter("n > 1").select("one")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(work, f"doc_id {kind}, text_key long, start int, end int, one long, two long")
    rows = materialize(rows.join(seen, "one", "left_semi"))
    tops = rows.groupBy("one", "two").agg(F.min(place()).alias("top"), (F.min(place()) != F.max(place())).alias("many")).filter("many").select("one", "two", "top")
    tops = materialize(tops)  # counted before it moves, and Spark can split the join of a very common window
    return rows.join(tops, ["one", "two"]).select("doc_id", "text_key", "start", "end", "top")


def comparer(docs: DataFrame, nodes: DataFrame, threshold: float):
    """The functions load, verify and weigh that ``links`` asks for, over the paragraphs of docs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, text = [], []
            for whole, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for x in wanted:
                    node.append(x["node"])
                    text.append(whole[x["start"] : x["end"]])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(text, pa.string())], names=["node", "text"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                coded = batch.column(side).dictionary_encode()
                h, bounds, _, _ = tk.words(coded.dictionary)
                s, at, _ = tk.distinct(*tk.shingles(h, bounds))
                sides.append([s[at[i] : at[i + 1]] for i in coded.indices.to_numpy()])
            keep = []
            for x, y in zip(*sides, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, bounds, _, _ = tk.words(batch.column("text"))
            s, at, n = tk.distinct(*tk.shingles(h, bounds))
            yield shared_rows(batch.column("node"), s, at, np.ones(len(n)))

    def load(wanted: DataFrame) -> DataFrame:
        place = F.struct("node", F.col("first.start").alias("start"), F.col("first.end").alias("end"))
        wanted = wanted.join(nodes, "node").groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.text_key").alias("_key")).agg(F.collect_list(place).alias("wanted"))
        row = docs.select("doc_id", "text", text_key().alias("text_key"))
        found = row.join(wanted.hint("shuffle_hash"), row["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("text", "wanted")
        return found.mapInArrow(cut, "node binary, text string").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(similar, "a binary, b binary")

    def weigh(texts: DataFrame) -> DataFrame:
        return texts.select("node", "text").mapInArrow(spread, SHARED)

    return load, verify, weigh


def repeated(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> DataFrame:
    """(doc_id, start, end, n_words, window, first_doc_id, first_start, removed) for each line or window in a class of two or more."""
    bands, rows = bands_for(threshold, recall, hashes)
    found = materialize(paragraphs(docs, bands, rows))
    # a node's first place; `many` where some other place has it too
    nodes = found.groupBy("node").agg(F.min(place()).alias("first"), (F.min(place()) != F.max(place())).alias("many"), F.first("n_shingles").cast("double").alias("size"), F.first("keys").alias("keys"))
    nodes = materialize(nodes)
    labels = links(nodes.select("node", "size", "keys"), threshold, *comparer(docs, nodes.select("node", "first"), threshold))
    classed = materialize(nodes.join(labels, "node", "left").filter("many or label is not null").select("node", "first", F.coalesce("label", "node").alias("label")))
    release(nodes, labels)
    tops = classed.groupBy("label").agg(F.min("first").alias("top"))
    classes = materialize(classed.join(tops, "label").select("node", "top"))
    release(classed)
    out = found.join(classes, "node").select("doc_id", "text_key", "start", "end", "n_words", F.lit(False).alias("window"), "top")
    out = out.unionByName(repeated_windows(docs).select("doc_id", "text_key", "start", "end", F.lit(WINDOW).alias("n_words"), F.lit(True).alias("window"), "top"))
    whole = [F.col(c).cast("long").alias(c) for c in ("start", "end", "n_words")]
    return out.select("doc_id", *whole, "window", F.col("top.doc_id").alias("first_doc_id"), F.col("top.start").cast("long").alias("first_start"), (place() != F.col("top")).alias("removed"))


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_paragraph_dedup": op7_paragraphs}
ORACLES: dict[str, str] = {}
