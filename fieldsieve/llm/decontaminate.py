"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks.

Every window of a document that has an item's number of words gets the SimHash of its word shingles;
a document of fewer words is one window. Fingerprints of 64 bits are cut into four blocks of 16; block b
may have ERRORS[b] wrong bits. By the pigeonhole principle a fingerprint within RADIUS = sum(ERRORS + 1) - 1
bits of an item's keeps within that in one block at least, so sorted tables of all block values that near
items give name every item within the radius, none left out, and of other items about one in fifteen.
These are compared by their whole fingerprints, and windows within the radius are verified by the exact
weighted Jaccard similarity (shingles by count). Windows at similarity 0.8 lie ten bits from the item on
average, and within the radius in 98 of 100 cases and more (tested).

A window that shares no shingle with any item has similarity 0 to all, and one whose shingles are too
seldom in any item cannot reach the threshold; so fingerprints are made where the threshold can be met.

Items are taken in groups of at most about GROUP_WORDS words and GROUP_ITEMS items; each group is a
broadcast of bounded size, and the documents are read once for each group.

Defined cases: null texts and texts without words hit nothing, items without words are never hit;
items shorter than a shingle count as one shingle of all their words; texts of any length count whole;
repeated items each report; the best window is reported for each (document, item), the first of equals;
repeated documents each report; empty tables give no rows; columns of the documents other than doc_id
and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textkit as tk
from .common import materialize, small_batches, table

THRESHOLD = 0.8
ERRORS = (4, 3, 3, 3)
RADIUS = sum(e + 1 for e in ERRORS) - 1
GROUP_WORDS, GROUP_ITEMS = 500_000, 2_000  # of the benchmark items that are broadcast at once; an item takes about 28 kB in the tables
SEEN_BITS = 22  # of the table that tells which shingles some item has


def simhash(sums: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of 64 bit sums."""
    return np.packbits(sums > 0, axis=-1, bitorder="little").view(np.uint64).ravel()


def signs(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 values of -1 or 1."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


class Blocks:
    """Fingerprints, found by any block that is near enough."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.tables = prints, []
        weight = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
        for b, errors in enumerate(ERRORS):
            own, flips = prints.view(np.uint16).reshape(-1, len(ERRORS))[:, b], np.flatnonzero(weight <= errors).astype(np.uint16)
            values = (own[:, None] ^ flips).ravel()
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], (order // len(flips)).astype(np.int32)))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of prints, of own) that are near enough in some block."""
        found = []
        for b, (values, items) in enumerate(self.tables):
            block = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, len(ERRORS))[:, b]
            low, high = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
            found.append(np.repeat(np.arange(len(prints)), n) * len(self.prints) + items[at])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs within RADIUS, and their distances."""
        mine, own = self.candidates(prints)
        distance = np.bitwise_count(prints[mine] ^ self.prints[own])
        keep = distance <= RADIUS
        return mine[keep], own[keep], distance[keep]


class Items:
    """Benchmark items of one group, by number of words."""

    def __init__(self, ids: list, texts: list):
        h, bounds, _, _ = tk.words(pa.array(texts, pa.string()))
        self.by_words: dict[int, list] = {}
        held: dict[int, list] = {}
        for i, item in enumerate(ids):
            own = h[bounds[i] : bounds[i + 1]]
            if len(own):
                s, _ = tk.shingles(own, np.array([0, len(own)]))
                self.by_words.setdefault(len(own), []).append((item, s, *np.unique(s, return_counts=True)))
                held.setdefault(min(tk.SHINGLE, len(own)), []).append(s)
        self.held = {k: np.unique(np.concatenate(x)) for k, x in held.items()}  # shingle length -> the shingles of all items
        self.seen = {k: np.zeros(1 << SEEN_BITS, bool) for k in held}  # a table that most other shingles miss
        for k, x in self.held.items():
            self.seen[k][x >> np.uint64(64 - SEEN_BITS)] = True
        self.tables = {n: Blocks(simhash(np.stack([signs(s).sum(axis=0, dtype=np.int64) for _, s, _, _ in group]))) for n, group in self.by_words.items()}

    def shared(self, s: np.ndarray, k: int) -> np.ndarray:
        """Which of the shingles some item has."""
        near = self.seen[k][s >> np.uint64(64 - SEEN_BITS)]
        at = np.flatnonzero(near)
        place = np.minimum(np.searchsorted(self.held[k], s[at]), len(self.held[k]) - 1)
        near[at] = self.held[k][place] == s[at]
        return near

    def search(self, by_length: dict[int, tuple[np.ndarray, np.ndarray]], words: int, threshold: float) -> list[tuple]:
        """(item, first word, words, distance, similarity) of the best window for each item, in one text.

        by_length: the text's shingles of each length, and which of them some item has.
        """
        best: dict = {}
        runs = {k: np.concatenate(([0], np.cumsum(near))) for k, (_, near) in by_length.items()}
        for n, group in self.by_words.items():
            k = min(tk.SHINGLE, n)
            s = by_length[k][0]
            width = min(n - k + 1, len(s))  # shingles of a window; a text shorter than the item is one window
            # similarity t needs t/(1+t) of the joint shingles in both; windows with fewer in all items together can't have it
            enough = max(1, int(np.ceil((width + n - k + 1) * threshold / (1 + threshold) - 1e-9)))
            if enough > width:
                continue
            starts = np.flatnonzero(runs[k][width:] - runs[k][:-width] >= enough)
            for at in range(0, len(starts), 4096):
                some = starts[at : at + 4096]
                for w, i, distance in zip(*self.tables[n].near(simhash(self.window_sums(s, some, width))), strict=True):
                    item, _, values, counts = group[i]
                    first = int(some[w])
                    similarity = counted_jaccard(s[first : first + width], values, counts)
                    if similarity >= threshold and (similarity > best.get((n, i), (0,))[0]):
                        best[n, i] = similarity, item, first, min(n, words), int(distance)
        return [(item, first, size, distance, similarity) for similarity, item, first, size, distance in best.values()]

    @staticmethod
    def window_sums(s: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Bit sums of the windows of width shingles from each start."""
        low, high = int(starts[0]), int(starts[-1]) + width
        if high - low > 16 * len(starts) + 4 * width:  # far apart: each run of its own
            gap = int(np.argmax(np.diff(starts))) + 1
            return np.concatenate([Items.window_sums(s, starts[:gap], width), Items.window_sums(s, starts[gap:], width)])
        total = np.zeros((high - low + 1, 64), np.int32)
        np.cumsum(signs(s[low:high]), axis=0, dtype=np.int32, out=total[1:])
        return total[starts - low + width] - total[starts - low]


def counted_jaccard(mine: np.ndarray, values: np.ndarray, counts: np.ndarray) -> float:
    own, n = np.unique(mine, return_counts=True)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    same = values[at] == own
    common = int(np.minimum(n[same], counts[at[same]]).sum())
    return common / (int(n.sum() + counts.sum()) - common)


def item_groups(items: DataFrame, words: int = GROUP_WORDS, most: int = GROUP_ITEMS) -> list[DataFrame]:
    """items in groups of a bounded number of words and of items, by a hash."""
    sized = materialize(items.select("item_id", "text").withColumn("_n", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).cast("long")))
    total, n = sized.agg(F.sum("_n"), F.count("*")).first()
    groups = max(-(-(total or 0) // words), -(-n // most), 1)
    if groups == 1:
        return [sized]
    bucket = F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * groups))  # so that chance fills none of them over the bounds
    return [sized.filter(bucket == g) for g in range(2 * groups)]


def hits(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, word_start, n_words, distance, similarity) of docs' windows like an item."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType
    batch_type, item_kind = to_arrow_type(item_type), item_type.simpleString()

    def found(group: DataFrame) -> DataFrame:
        rows = group.select("item_id", "text").collect()  # at most about GROUP_WORDS words
        made = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = made.value
            for batch in batches:
                h, bounds, _, _ = tk.words(batch.column("text"))
                made_of, some = {}, set()  # some: texts with a shingle that an item has
                for k in search.held:
                    s, at = tk.shingles(h, bounds, k)
                    near = search.shared(s, k)
                    made_of[k] = s, near, at
                    some |= set((np.searchsorted(at, np.flatnonzero(near), side="right") - 1).tolist())
                out = []
                for d in sorted(some):
                    own = {k: (s[at[d] : at[d + 1]], near[at[d] : at[d + 1]]) for k, (s, near, at) in made_of.items()}
                    out += [(d, *x) for x in search.search(own, int(bounds[d + 1] - bounds[d]), threshold)]
                if out:
                    doc, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc)), pa.array(rest[0], batch_type), *[pa.array(x, pa.int64()) for x in rest[1:4]], pa.array(rest[4], pa.float64())],
                        names=["doc_id", "item_id", "word_start", "n_words", "distance", "similarity"],
                    )

        return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, item_id {item_kind}, word_start long, n_words long, distance long, similarity double")

    return reduce(DataFrame.unionByName, map(found, item_groups(items)))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that hold an item; told apart by text, so repeated or missing ids do no harm."""
    key = F.sha2(F.coalesce("text", F.lit("")), 256)
    bad = hits(docs.select(key.alias("doc_id"), "text"), items, threshold).select(F.col("doc_id").alias("bad")).distinct()
    return docs.select(F.struct(*docs.columns).alias("row"), key.alias("key")).join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLES: dict[str, str] = {}
