"""Language identification by rank-order n-gram profiles (out-of-place distance).

``learn`` counts letter n-grams per label over all training rows (summed per Arrow batch before the
shuffle) and keeps each label's TOP most frequent ones in order. ``predict`` ranks a text's own most
frequent n-grams and sums, over them, how far each is out of place in a profile (TOP if it is not
there). Profiles are TOP codes for each label: bounded by the labels, whatever the corpus; every label
is learned. ``far`` tells texts that no profile fits: their distance is farther from the nearest profile
than nearly all training texts of like length are from their own.

Defined cases: null text or text without a letter gives ``und`` with score 0; with no profiles at all
(an empty table, or no labels) everything is ``und``; ties between labels go to the first label by code
point; whole texts count, in pieces of bounded size cut between words; repeated rows count each time;
other columns ride along, but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

TOP = 300
ORDERS = (1, 2, 3)
UND = "und"
SHARE, FLOOR = 0.01, 0.5
PIECE = 1 << 20  # code points of a text worked on at once

_LETTER: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter; built once in each process."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _LETTER


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a text's lower-case words, each word framed by blanks."""
    codes, counts = [], []
    letters, tail = letter_table(), np.zeros(0, np.uint32)
    for at in range(0, max(1, len(text)), PIECE):
        point = np.concatenate((tail, np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)))
        last = at + PIECE >= len(text)
        point = np.where(letters[point], point, 32)
        if not last:  # the last word may go on in the next piece
            stop = len(point) - int(np.argmax(point[::-1] == 32)) if (point == 32).any() else 0
            tail, point = point[stop:], point[:stop]
            if not len(point):
                continue
        point = np.concatenate(([32], point, [32])).astype(np.uint64)
        point = point[(point != 32) | np.concatenate(([True], point[1:] != point[:-1]))]
        found = [point[point != 32]]
        for n in ORDERS[1:]:
            rows = np.lib.stride_tricks.sliding_window_view(point, n) if len(point) >= n else np.zeros((0, n), np.uint64)
            code = np.zeros(len(rows), np.uint64)
            blank = np.zeros(len(rows), np.int8)
            for j in range(n):
                code = (code << np.uint64(21)) | rows[:, j]
                blank += (rows[:, j] == 32).astype(np.int8) * (1 if 0 < j < n - 1 else 0)
            found.append(code[blank == 0])
        c, k = np.unique(np.concatenate(found), return_counts=True)
        codes.append(c)
        counts.append(k)
    if len(codes) == 1:
        return codes[0], counts[0]
    code, back = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(code: np.ndarray, count: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(code) > top:  # all that could be among the first, then sorted
        least = np.partition(count, len(count) - top)[len(count) - top]
        keep = count >= least
        code, count = code[keep], count[keep]
    return code[np.lexsort((code, -count))][:top]


def learn(labelled: DataFrame, label: str = "lang", text: str = "text", top: int = TOP) -> dict[str, np.ndarray]:
    """Profile of each label from all rows of labelled that have one."""
    rows = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).filter("label is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, parts = batch.column("label"), ([], [], [])
            for name in pc.unique(labels).to_pylist():
                mine = batch.column("text").filter(pc.equal(labels, name))
                code, n = grams("\n".join(mine.to_pylist()))
                for part, value in zip(parts, (np.full(len(code), name, object), code.astype(np.int64), n), strict=True):
                    part.append(value)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts[0]), pa.string()), pa.array(np.concatenate(parts[1])), pa.array(np.concatenate(parts[2]).astype(np.int64))], names=["label", "code", "n"])

    counted = rows.mapInArrow(count, "label string, code long, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))
    return {r.label: np.array(r.codes, np.uint64) for r in top_codes(counted, top).collect()}


def top_codes(counted: DataFrame, top: int) -> DataFrame:
    """(label, codes): each label's codes in order of (count descending, code)."""
    order = Window.partitionBy("label").orderBy(F.desc("n"), "code")
    first = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return first.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "code"))), lambda x: x["code"]).alias("codes"))


class Model:
    """Profiles as one sorted code table with a rank column for each label."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.labels, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.labels])) if profiles else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.labels)), -1, np.int32)  # -1: not in the profile
        for i, x in enumerate(self.labels):
            self.ranks[np.searchsorted(self.codes, profiles[x]), i] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        mine = ranked(*grams(text), self.top) if text and self.labels else np.zeros(0, np.uint64)
        if not len(mine):
            return UND, 0.0
        at = np.searchsorted(self.codes, mine)
        at = np.where(self.codes[np.minimum(at, len(self.codes) - 1)] == mine, at, len(self.codes))
        rank = self.ranks[at]
        off = np.where(rank < 0, self.top, np.abs(rank - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(off))
        return self.labels[best], float(1 - off[best] / (self.top * len(mine)))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", top: int = TOP) -> DataFrame:
    """df with lang_pred and score in place of what it had under these names."""
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    model = Model(profiles, top)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return df.select(*keep).mapInArrow(work, schema)


def far(scored: DataFrame, label: str = "lang", share: float = SHARE, floor: float = FLOOR) -> DataFrame:
    """scored (with lang_pred and score) with ``far``: no language is found, or the text is much farther from
    its profile (its score under ``floor`` times) than all but a ``share`` of the texts that have this label
    and prediction. Where a prediction was right for no text, nothing is far but ``und``."""
    right = scored.filter(F.col(label) == F.col("lang_pred")).groupBy(F.col("lang_pred").alias("_label"))
    least = right.agg(F.percentile(F.round("score", 3), F.lit(share)).alias("_least"))  # of 1001 values at most, exact
    out = scored.join(F.broadcast(least), F.col("lang_pred") == F.col("_label"), "left")  # a row for each label
    return out.withColumn("far", (F.col("lang_pred") == UND) | (F.col("score") < F.coalesce(F.col("_least") * floor, F.lit(0.0)))).drop("_label", "_least")


def held_out(doc_id: Column) -> Column:
    """The fold kept from training; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op10_language_id": op10_langid}
ORACLES: dict[str, str] = {}
