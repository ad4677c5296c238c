"""Exact Jaccard join of documents on 4-word shingles, as a grouped prefix join, and its components.

Two sets of Jaccard similarity t or more share a shingle among the first n - ceil(t n) + 1 of each, in any
order of all shingles. The order here is rarest first: shingles are counted over all documents in a fixed
number of cells by hash (CELL_BITS), and go by their cell's count, then by hash. Cells that several shingles
share only make prefixes less rare; what is found does not depend on them.

Documents of the same set are one member; members of the same prefix and size are one group. Groups are
joined on the shingles of their prefixes: a shingle counts where two groups of allowed sizes meet on it,
and of shingles that exactly the same groups meet on, one is kept. What is left is expanded to the groups'
members, and these (with the members of each group among themselves) are verified on their whole sets.
``lsh.links`` does that: no bucket's pairs are all emitted, as members that are already in one component
need no pair, and no pair across components is left out. Before texts are fetched, pairs are screened by
an exact bound: each set has the parities of its shingles over 2 n to 4 n cells, one bit each, and two sets
differ in as many shingles at least as their parities differ in cells.

Defined cases: words are cut at ASCII white space, only A-Z are lower-cased; a text of fewer than four words
has one shingle, all its words; null texts and texts without a word have none, are linked with nothing and
are their own component; rows may repeat a doc_id or have none, each gets its row back (null ids name no
component unless all of it are null); other columns are not read; an empty table gives no rows; texts of
any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, release, small_batches, table
from .lsh import SHARED, links, shared_rows
from .near_dup import binary16, text_key

SHINGLE, PERCENT = 4, 85
#: Cells that shingles are counted in: 2^22, four megabytes as ranks.
CELL_BITS = 22
#: Members whose texts are fetched by a broadcast of their ids (some 40 bytes each); beyond, documents are shuffled.
FEW = 200_000
#: Cells that screen prefixes for tokens: 2^26, eight megabytes as bits, so 1 in 7 others passes at 10 million tokens.
SCREEN_BITS, _BITMAP = 26, 1 << 15  # bits of a value of bitmap_construct_agg
_CHUNK = 1 << 16
_HELD = 1 << 22
_U = np.uint64

_WORD = np.ones(256, np.uint8)
_WORD[[32, *range(9, 14)]] = 0


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in order of hash, and where they begin (with the end)."""
    data, offsets = tk.utf8(texts)
    data = tk.ascii_lower(data)
    starts, ends, bounds = tk.runs(data, offsets, _WORD)
    s, at, _ = tk.distinct(*tk.shingles(tk.range_hashes(data, starts, ends), bounds, SHINGLE))
    return s, at


def cell_ranks(docs: DataFrame) -> np.ndarray:
    """A rank of each cell, by the logarithm of how many of all documents' shingles fall into it.

    Tasks count in arrays and send them in pieces, which are added up where they meet; the driver gets one
    byte for each cell.
    """
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(cells, np.uint32), [], 0

        def add() -> None:
            total[:] += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)

        for batch in batches:
            s, _ = shingle_sets(batch.column("text"))
            held.append((s >> _U(64 - CELL_BITS)).astype(np.int64))
            n += len(s)
            if n >= _HELD:
                add()
                held, n = [], 0
        if held:
            add()
        for at in range(0, cells, _CHUNK):
            if (piece := total[at : at + _CHUNK]).any():
                coded = np.round(8 * np.log2(1.0 + piece)).astype(np.uint8)  # within some 5 %, in one byte
                yield pa.RecordBatch.from_arrays([pa.array([at // _CHUNK], pa.int32()), pa.array([coded.tobytes()])], names=["chunk", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                sums.setdefault(chunk, np.zeros(_CHUNK, np.float64))[:] += np.exp2(np.frombuffer(counts.as_buffer(), np.uint8) / 8.0) - 1
        for chunk, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.ceil(2 * np.log2(1 + total)).astype(np.uint8).tobytes()])], names=["chunk", "ranks"])

    rows = docs.select("text")
    parts, cores = rows.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(4 * cores) if parts > 4 * cores else rows  # fewer arrays to send
    met = rows.mapInArrow(count, "chunk int, counts binary").repartition(cells // _CHUNK, "chunk").mapInArrow(add_up, "chunk int, ranks binary")
    out = np.zeros(cells, np.uint8)
    for r in met.collect():  # CELL_BITS bounds it
        out[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.ranks, np.uint8)
    return out


def prefixes(s: np.ndarray, at: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of sets in the order of ranks, and where they begin (with the end)."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    s = s[np.lexsort((s, ranks[s >> _U(64 - CELL_BITS)], owner))]
    length = np.where(n > 0, n + percent * n // -100 + 1, 0)  # n - ceil(percent n / 100) + 1
    return s[np.arange(len(s)) - np.repeat(at[:-1], n) < np.repeat(length, n)], np.concatenate(([0], np.cumsum(length)))


def parities(s: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each set whether an odd number of its shingles falls into each of 2 n to 4 n cells, as bits."""
    n = np.diff(at)
    cells = np.where(n > 0, 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) + 1), 0)
    start = np.concatenate(([0], np.cumsum(cells)))
    place = np.repeat(start[:-1], n) + (s & np.repeat(np.maximum(cells, 1) - 1, n).astype(_U)).astype(np.int64)
    bits = np.packbits((np.bincount(place, minlength=int(start[-1])) & 1).astype(np.uint8), bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((start // 8).astype(np.int64).tobytes()), pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def may_link(a: np.ndarray, b: np.ndarray, n: int, percent: int) -> bool:
    """Whether sets of n shingles together, with these parities, can be similar enough."""
    while len(a) > len(b):  # cells twice as wide have the parity of both
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    both = (n - int(np.bitwise_count(a ^ b).sum())) // 2
    return 100 * both >= percent * (n - both)


SETS = "text_key long, n long, member binary, grp binary, parity binary, prefix array<long>"


def sets(docs: DataFrame, ranks: Broadcast, percent: int = PERCENT) -> DataFrame:
    """doc_id and SETS for each row of docs; member, grp are null and n is 0 where there is no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at = shingle_sets(batch.column("text"))
            n = np.diff(at)
            first, ends = prefixes(s, at, ranks.value, percent)
            one, two = tk.digest128(first, ends)
            some, none = pa.array(n > 0), pa.scalar(None, pa.binary())
            sized = tk.mix(n.astype(_U) + _U(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_key"), pa.array(n), pc.if_else(some, binary16(*tk.digest128(s, at)), none), pc.if_else(some, binary16(one ^ sized, two), none), parities(s, at),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(first.view(np.int64))),
                ],
                names=["doc_id", "text_key", "n", "member", "grp", "parity", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_key().alias("text_key")).mapInArrow(work, f"doc_id {kind}, {SETS}")


def token_bits(tokens: DataFrame) -> np.ndarray:
    """A bit for each cell (the first SCREEN_BITS bits) that a token falls into, least bit of a byte first."""
    cell = F.shiftrightunsigned("token", 64 - SCREEN_BITS)
    met = tokens.groupBy(F.floor(cell / _BITMAP).cast("int").alias("chunk")).agg(F.bitmap_construct_agg(cell % _BITMAP).alias("bits"))
    out = np.zeros((1 << SCREEN_BITS) // 8, np.uint8)
    for r in met.collect():  # SCREEN_BITS bounds it
        out[r.chunk * (_BITMAP // 8) : (r.chunk + 1) * (_BITMAP // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def with_tokens(groups: DataFrame, bits: Broadcast) -> DataFrame:
    """groups (grp, n, prefix) with what of a prefix falls into these cells; groups without are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix")
            s = prefix.flatten().to_numpy().view(_U)
            cell = (s >> _U(64 - SCREEN_BITS)).astype(np.int64)
            some = (bits.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
            ends = np.concatenate(([0], np.cumsum(some)))[prefix.offsets.to_numpy() - prefix.offsets[0].as_py()]
            left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(s[some].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("n"), left], names=["grp", "n", "prefix"]).filter(pa.array(np.diff(ends) > 0))

    return groups.select("grp", "n", "prefix").mapInArrow(work, "grp binary, n long, prefix array<long>")


def group_pairs(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(token, grp): groups (grp, n, prefix; repeated or not) under the tokens on which they meet another group of
    a size that allows a link; of tokens on which the same groups meet, one."""
    postings = lambda rows: rows.dropDuplicates(["grp"]).select("grp", "n", F.explode("prefix").alias("token"))
    met = postings(groups).groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("grp")).alias("x"), F.bit_xor(F.xxhash64("grp", F.lit(1))).alias("y")).filter("c > 1")
    tokens = materialize(met.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token"))
    # few shingles are tokens: prefixes are screened where they are read, before any of them moves
    bits = groups.sparkSession.sparkContext.broadcast(token_bits(tokens))
    live = materialize(postings(with_tokens(groups, bits)).join(tokens, "token"))
    release(tokens)
    # sizes under a token are few, whatever the number of groups
    near = Window.partitionBy("token").orderBy("n")
    sizes = live.groupBy("token", "n").agg(F.count("*").alias("c")).select("*", F.lag("n").over(near).alias("below"), F.lead("n").over(near).alias("above"))
    allowed = sizes.filter((F.col("c") > 1) | (100 * F.col("below") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("above"))).select("token", "n")
    out = materialize(live.join(allowed, ["token", "n"]).select("token", "grp"))
    release(live)
    return out


def verifiers(docs: DataFrame, members: DataFrame, percent: int):
    """The functions load, verify, weigh and screen that ``links`` asks for."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for side in ("text_a", "text_b"):
                coded = batch.column(side).dictionary_encode()
                s, at = shingle_sets(coded.dictionary)
                sides.append([s[at[i] : at[i + 1]] for i in coded.indices.to_numpy()])
            keep = []
            for a, b in zip(*sides, strict=True):
                place = np.searchsorted(b, a)
                place[place == len(b)] = 0
                both = int((b[place] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, at = shingle_sets(batch.column("text"))
            yield shared_rows(batch.column("node"), s, at, np.ones(len(s)))

    def load(wanted: DataFrame) -> DataFrame:
        wanted = materialize(wanted.join(members.select(F.col("member").alias("node"), "doc", "doc_key"), "node"))
        row = docs.select("doc_id", "text", text_key().alias("text_key"))
        few = wanted.limit(FEW + 1).count() <= FEW
        return row.join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), row["doc_id"].eqNullSafe(F.col("doc")) & (F.col("text_key") == F.col("doc_key"))).select("node", "text").dropDuplicates(["node"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(c)] for c in ("parity_a", "parity_b")]
            keep = [may_link(a, b, n, percent) for a, b, n in zip(*sides, batch.column("n").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def screen(pairs: DataFrame) -> DataFrame:
        side = lambda c: members.select(F.col("member").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
        met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "parity_a", "parity_b")
        return met.mapInArrow(possible, "a binary, b binary")

    return load, lambda pairs: pairs.mapInArrow(linked, "a binary, b binary"), lambda texts: texts.select("node", "text").mapInArrow(spread, SHARED), screen


def join_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) for each row of docs."""
    ranks = docs.sparkSession.sparkContext.broadcast(cell_ranks(docs))
    found = materialize(sets(docs, ranks, percent))
    worded = found.filter("member is not null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    members = materialize(worded.groupBy("member").agg(first.alias("_m"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("parity").alias("parity")).select("member", "grp", "n", "parity", F.col("_m.doc_id").alias("doc"), F.col("_m.text_key").alias("doc_key")))
    met = group_pairs(worded.select("grp", "n", "prefix"), percent)
    inside = members.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp", F.xxhash64("grp").alias("token"))
    keys = members.select("member", "grp", "n").join(met.unionByName(inside), "grp").groupBy(F.col("member").alias("node")).agg(F.first("n").cast("double").alias("size"), F.array_sort(F.collect_set("token")).alias("keys"))
    nodes = materialize(keys)
    labels = links(nodes, percent / 100 - 1e-9, *verifiers(docs, members, percent))
    grouped = materialize(members.select(F.col("member").alias("node"), "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    release(nodes, labels, met, members)
    least = grouped.groupBy("label").agg(F.min("doc").alias("component_id"))
    of = grouped.join(least, "label").select(F.col("node").alias("member"), "component_id")
    out = found.select("doc_id", "text_key", "n", "member").join(of, "member", "left")
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.when(F.col("member").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_key")


QUERIES = {"op12_ngram_join": op12_ngram_join}
ORACLES: dict[str, str] = {}
