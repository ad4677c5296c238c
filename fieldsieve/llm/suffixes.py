"""Substring dedup by a depth-limited radix sort of suffixes.

A byte is removed if it lies in a DEPTH-byte string that also starts in a document with a smaller id.
Suffixes are ordered through DEPTH bytes only; the groups that are equal after the last digit are the
repeated strings, and of each all but those of the least document are covered.

Dealing out. Equal strings have equal least hashes among the GRAM-byte strings inside them. Consecutive
suffixes mostly share that anchor, so they travel as a run. A first exchange moves anchors and places
only and finds the anchors that stand in documents of different ids; of an anchor that a task meets in
several documents it sends two places and knows the others to be shared. A second exchange moves the
bytes of runs with shared anchors to the anchor's bucket. Anchors of more than CROWD runs are known
from the first exchange, and their runs are cut and dealt by the next least hash as well, before they
are held anywhere. Hashes only deal suffixes out; nothing is removed on a hash alone.

Ordering. In a bucket, runs that are equal byte by byte are settled first (in the sending task too, so
a passage that a third of all documents hold comes once from each task buffer). The suffixes of what
is left are sorted by most-significant-digit passes, 8 bytes a digit; after each pass suffixes whose
group holds no second document drop out.

Memory. A task holds the records of its buffer, or the runs of one bucket with their bytes; what is made
of them (hashes of grams, suffixes, blobs to send) is made a share at a time.

Records travel packed, in compressed blobs of a bucket's columns. The texts are shuffled once, each
compressed (both uses read the same exchange), and positions come back as spans. A document is named by
its id, and by a hash of its text only where texts differ under one id.

Defined cases: null text is empty; texts under DEPTH bytes lose nothing; texts of any length count
whole; a null id counts as the greatest; rows with equal ids don't remove from each other, and rows may
repeat; matches never cross documents; overlaps count, and strings are judged on the input; an empty
table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, release, small_batches, table
from .near_dup import text_key

DEPTH, GRAM = 50, 16
RUN = DEPTH - GRAM + 1  # the most suffixes of a run, so that its first and last string cover it
BUFFER, MOST_DOCS = 3_000_000, 60_000  # records and documents of a task buffer
CROWD, CROWDS = 4_000, 1 << 16  # an anchor is crowded from so many runs, and at least 1/CROWDS of all runs, on
SHARE = 2 << 20  # bytes that are hashed, unpacked or sent at once
SUFFIXES = 1 << 19  # suffixes that are ordered at once, or those of one anchor
SAME = 16  # places of an anchor in documents of one id that a task buffer sends
FEW = 200_000  # ids with several texts that are broadcast; beyond, all rows carry the hash of their text
NO_ID = (1 << 63) - 1
_U = np.uint64
_ODD = tk.stream(41, 16) | _U(1)


BLOCK = 1 << 15  # positions hashed at once, so that they stay in the cache


def squeezed(raw: bytes | np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def released(raw: bytes | pa.Buffer, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def digits(least: np.ndarray) -> np.ndarray:
    """What an anchor is dealt by; 48 bits of it travel."""
    return tk.mix(least) >> _U(16) << _U(16)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, by doubling; positions near the end have none."""
    out = np.empty(max(0, len(data) - GRAM + 1), _U)
    for i in range(0, len(out), BLOCK):
        h, k = tk._BYTES[data[i : i + BLOCK + GRAM - 1]], 1
        while k < GRAM:
            h = h[: len(h) - k] * _ODD[k % 16] + h[k:]
            h ^= h >> _U(29)
            k *= 2
        out[i : i + BLOCK] = h
    return out


def least_hashes(h: np.ndarray) -> np.ndarray:
    """The least gram hash inside the DEPTH bytes from each position."""
    out = np.empty(max(0, len(h) - RUN + 1), _U)
    for i in range(0, len(out), BLOCK):
        least, k = h[i : i + BLOCK + RUN - 1], 1
        while 2 * k <= RUN:
            least = np.minimum(least[: len(least) - k], least[k:])
            k *= 2
        rest = RUN - k
        out[i : i + BLOCK] = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    return out


def shares(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Rows from where to where, as many at a time as have so much together, or one."""
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + most, side="right")))
        yield at, to
        at = to


def gathered(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these ranges end to end, and where each begins."""
    ends = np.cumsum(length)
    return data[np.repeat(begin - ends + length, length) + np.arange(length.sum())], ends - length


def string_hashes(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the DEPTH bytes from each of these positions, from overlapping gram hashes."""
    total = np.zeros(len(at), _U)
    for i, j in enumerate([*range(0, DEPTH - GRAM, GRAM), DEPTH - GRAM]):
        total += h[at + j] * _ODD[8 + i]
    return tk.mix(total)


def runs(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The runs of each text: digit (a hash of the anchor), text, position in it, and number of suffixes."""
    some = np.flatnonzero(np.diff(offsets) >= DEPTH)
    if not len(some):
        return {"digit": np.zeros(0, _U), "doc": np.zeros(0, np.int64), "pos": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
    first, last = offsets[some], offsets[some + 1] - DEPTH + 1  # the suffixes of a text
    least = least_hashes(gram_hashes(data))
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    text = np.searchsorted(first, change, side="right") - 1
    change = change[(text >= 0) & (change < last[text])]
    begin = np.union1d(change, first)
    text = np.searchsorted(first, begin, side="right") - 1
    n = np.minimum(np.append(begin[1:], last[-1]), last[text]) - begin
    pieces = -(-n // RUN)  # of runs longer than RUN
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, text, left = np.repeat(begin, pieces) + place * RUN, np.repeat(text, pieces), np.repeat(n, pieces) - place * RUN
    return {"digit": digits(least[begin]), "doc": some[text], "pos": begin - first[text], "n": np.minimum(left, RUN)}


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte by byte in planes."""
    return np.ascontiguousarray(values.astype(_U).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view(_U).ravel()


#: Columns of packed records and their bytes. The digit comes first and ascends, so only its steps are kept. m: runs that a record stands for.
WIDTHS = (("digit", 6), ("doc", 2), ("pos", 4), ("n", 1), ("m", 4))
RAW_WIDTHS = (("doc", 2), ("pos", 4), ("n", 1))


def pack(part: dict[str, np.ndarray], ids: np.ndarray, keys: np.ndarray, widths=WIDTHS, rest: bytes = b"") -> bytes:
    """A blob of records, of the documents they name (by id, so that steps of ids are small), and of other bytes."""
    used, doc = np.unique(part["doc"], return_inverse=True)
    by = np.argsort(ids[used], kind="stable")
    used, place = used[by], np.argsort(by)
    head = np.array([len(doc), len(used)], np.int64).tobytes()
    columns = part | {"doc": place[doc]}
    if "digit" in part:
        columns["digit"] = np.diff(part["digit"].astype(_U) >> _U(16), prepend=_U(0))
    named = planes(np.diff(ids[used].astype(_U), prepend=_U(0)), 8) + planes(keys[used], 8)
    whole = head + named + b"".join(planes(columns[c], w) for c, w in widths) + rest
    return np.int64(len(whole)).tobytes() + squeezed(whole)


def unpack(blob: bytes, widths=WIDTHS) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, bytes]:
    """Records, ids, keys and other bytes of a blob."""
    raw = released(pa.py_buffer(blob)[8:], int(np.frombuffer(blob, np.int64, 1)[0]))
    n, d = map(int, np.frombuffer(raw, np.int64, 2))
    ids, keys = np.cumsum(unplanes(raw, 16, d, 8)).view(np.int64), unplanes(raw, 16 + 8 * d, d, 8).view(np.int64)
    at, part = 16 + 16 * d, {}
    for c, w in widths:
        part[c] = unplanes(raw, at, n, w)
        at += n * w
    if "digit" in part:
        part["digit"] = np.cumsum(part["digit"]) << _U(16)
    return part, ids, keys, raw[at:]


def edges(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = reduce(np.logical_or, (k[1:] != k[:-1] for k in sorted_keys))
    return new


SLICES = 4  # bits of the digit by which a buffer is sorted and sent in slices; buckets have more


class Buffer:
    """Runs of one task; when full, sent as blobs of records, few for each anchor, a slice of the digits at a time."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.ids, self.keys, self.records = bits, [], [], [], 0

    def add(self, part: dict[str, np.ndarray], ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.records and sum(map(len, self.ids)) + len(ids) > MOST_DOCS:
            yield from self.send()
        doc = part["doc"] + sum(map(len, self.ids))
        self.parts.append({"digit": part["digit"], "doc": doc.astype(np.int32), "pos": part["pos"].astype(np.uint32), "n": part["n"].astype(np.uint8)})
        self.ids.append(ids)
        self.keys.append(keys)
        self.records += len(part["doc"])
        if self.records >= BUFFER:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.records:
            return
        part = {c: np.concatenate([p.pop(c) for p in self.parts]) for c, _ in WIDTHS if c != "m"}
        ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
        self.parts, self.ids, self.keys, self.records = [], [], [], 0
        top, done = (part["digit"] >> _U(64 - SLICES)).astype(np.uint8), []
        for i in range(1 << SLICES):
            some = np.flatnonzero(top == i)
            own, digit = ids[part["doc"][some]], part["digit"][some]
            order = np.lexsort((own, digit))
            some, own, digit = some[order], own[order], digit[order]
            begin = np.flatnonzero(edges(digit))
            size = np.diff(np.append(begin, len(own)))
            place = np.arange(len(own)) - np.repeat(begin, size)
            shared = np.repeat(own[begin] < own[begin + size - 1], size)
            size = np.repeat(size, size)
            left = np.where(shared, (place == 0) | (place == size - 1), place < SAME)
            done.append(some[~left])
            few = {c: part[c][some[left]] for c in part} | {"m": np.where(place == 0, size, 0)[left].astype(np.uint32)}
            bucket = (few["digit"] >> _U(64 - self.bits)).astype(np.int64)
            edge = np.flatnonzero(np.append(edges(bucket), True)) if len(bucket) else np.zeros(1, np.int64)
            blobs = [pack({c: few[c][a:b] for c, _ in WIDTHS}, ids, keys) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield sent(bucket[edge[:-1]], blob=blobs)
        yield from ride_along(part, np.concatenate(done), ids, keys, self.bits)


def ride_along(part: dict[str, np.ndarray], some: np.ndarray, ids: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Places that the sending task has decided on, dealt out evenly."""
    for at in range(0, len(some), 1 << 16):
        few = some[at : at + (1 << 16)]
        spread = int(tk.mix(np.array([at, int(ids[0]), len(some)], np.int64).view(_U)).sum() >> _U(64 - bits))
        yield sent(np.array([spread]), done=[pack({c: part[c][few] for c, _ in RAW_WIDTHS}, ids, keys, RAW_WIDTHS)])


def sent(bucket: np.ndarray, blob: list | None = None, done: list | None = None, raw: list | None = None) -> pa.RecordBatch:
    none = [None] * len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket), *[pa.array(x or none, pa.binary()) for x in (blob, done, raw)]], names=["bucket", "blob", "done", "raw"])


SENT = "bucket long, blob binary, done binary, raw binary"
SPANS = "doc long, key long, start long, n int, open int"
CLOSED, OPEN, CROWDED, TOTAL = 0, 1, 2, 3


def found(part: dict, ids: np.ndarray, keys: np.ndarray, some: np.ndarray, state: int | np.ndarray) -> pa.RecordBatch:
    doc = part["doc"][some].astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[doc]), pa.array(keys[doc]), pa.array(part["pos"][some].astype(np.int64)), pa.array(part["n"][some].astype(np.int32)), pa.array(np.broadcast_to(np.int32(state), len(some)))],
        names=["doc", "key", "start", "n", "open"],
    )


def together(held: list[tuple]) -> tuple[dict, np.ndarray, np.ndarray]:
    """The records of several blobs as one."""
    parts, ids, keys = zip(*held, strict=True)
    base = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    whole["doc"] = np.concatenate([p["doc"] + _U(b) for p, b in zip(parts, base, strict=False)])
    return whole, np.concatenate(ids), np.concatenate(keys)


def told(anchor: np.ndarray, number: np.ndarray, state: int) -> pa.RecordBatch:
    """Anchors with their numbers of runs, as spans of no document."""
    n = len(anchor)
    columns = [pa.array(np.zeros(n, np.int64)), pa.array(anchor.view(np.int64)), pa.array(number.astype(np.int64)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, state, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=["doc", "key", "start", "n", "open"])


def by_bucket(batches: Iterator[pa.RecordBatch], crowd: int, state: int) -> Iterator[pa.RecordBatch]:
    """Works off the records or runs of each bucket, which come in order; passes on, in this state, what rode along."""
    held, raws, texts, now = [], [], [], None

    def flush():
        if held:
            yield from first_pass(*together(held), crowd)
        if raws:
            data = np.frombuffer(b"".join(texts), np.uint8)
            texts.clear()
            yield from raw_pass(*together(raws), data)
        held.clear(), raws.clear()

    for batch in batches:
        for bucket, blob, done, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "blob", "done", "raw")), strict=True):
            if bucket != now:
                yield from flush()
                now = bucket
            if blob is not None:
                held.append(unpack(blob)[:3])
            if raw is not None:
                *one, text = unpack(raw, RAW_WIDTHS)
                raws.append(one)
                texts.append(text)
            if done is not None:
                part, ids, keys, _ = unpack(done, RAW_WIDTHS)
                yield found(part, ids, keys, np.arange(len(part["doc"])), state)
    yield from flush()


def first_pass(part: dict, ids: np.ndarray, keys: np.ndarray, crowd: int = CROWD) -> Iterator[pa.RecordBatch]:
    """The places of anchors that documents of different ids share; the crowded anchors with their runs; the number of all runs."""
    own = ids[part["doc"].astype(np.int64)]
    order = np.lexsort((own, part["digit"]))
    begin = np.flatnonzero(edges(part["digit"][order]))
    size = np.diff(np.append(begin, len(order)))
    shared = own[order][begin] < own[order][begin + size - 1]
    yield found(part, ids, keys, order[np.repeat(shared, size)], OPEN)
    runs_of = np.add.reduceat(part["m"][order].astype(np.int64), begin)
    full = shared & (runs_of > crowd)
    yield told(part["digit"][order][begin][full], runs_of[full], CROWDED)
    yield told(np.zeros(1, _U), runs_of.sum(keepdims=True), TOTAL)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b are equal over these lengths (from 8 to DEPTH + RUN - 1), 8 bytes at a time."""
    word = np.ndarray((max(0, len(data) - 7),), np.uint64, np.ascontiguousarray(data), 0, (1,))  # the 8 bytes from each place, not copied
    out = np.ones(len(a), bool)
    for i in range(0, DEPTH + RUN - 1, 8):
        at = np.minimum(i, length - 8)  # the last word overlaps the one before
        out &= word[a + at] == word[b + at]
    return out


def run_keys(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digit of each run, and a hash of its first and last string and number; a share of the data is hashed at a time."""
    digit, shape = np.empty(len(begin), _U), np.empty(len(begin), _U)
    by = np.argsort(begin, kind="stable")
    edge = np.searchsorted(begin[by], np.arange(0, len(data) + SHARE, SHARE))
    for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if a < b:
            some, h = by[a:b], gram_hashes(data[i * SHARE : (i + 1) * SHARE + DEPTH + RUN])
            here = begin[some] - i * SHARE
            digit[some] = anchors(h, here)
            shape[some] = string_hashes(h, here) * _ODD[1] + string_hashes(h, here + n[some] - 1) * _ODD[3] + n[some].astype(_U)
    return digit, shape


def equal_runs(data: np.ndarray, begin: np.ndarray, n: np.ndarray, anchor: np.ndarray, shape: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which runs equal, byte by byte, a run of a smaller id among these."""
    if not len(begin):
        return np.zeros(0, bool)
    order = np.lexsort((own, shape, anchor))
    new = edges(anchor[order], shape[order])
    head = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(own[order] > own[head])
    mine, first = order[later], head[later]
    out = np.zeros(len(begin), bool)
    out[mine[(n[mine] == n[first]) & same_bytes(data, begin[mine], begin[first], n[mine] + DEPTH - 1)]] = True
    return out


def radix_groups(data: np.ndarray, at: np.ndarray, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of at, ordered by group and the DEPTH bytes from there, and where equal strings begin; only those that documents of different ids share."""
    data = np.append(data, np.zeros(8, np.uint8))
    word = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))  # the 8 bytes from each place, not copied
    live = np.arange(len(at))
    new = np.zeros(0, bool)
    for depth in range(0, DEPTH, 8):
        digit = word[at[live] + depth].astype(_U)
        if DEPTH - depth < 8:
            digit = digit >> _U(8 * (8 - DEPTH + depth))
        order = np.lexsort((digit, group))
        live, group, digit = live[order], group[order], digit[order]
        new = edges(group, digit)
        begin = np.flatnonzero(new)
        ids = own[live]
        if len(begin):
            more = np.repeat(np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin), np.diff(np.append(begin, len(live))))
            group = (np.cumsum(new) - 1)[more]
            live, new = live[more], new[more]
    return live, new


def raw_pass(part: dict, ids: np.ndarray, keys: np.ndarray, data: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Orders the suffixes of runs that came with their bytes, end to end in data."""
    n = part["n"].astype(np.int64)
    begin = np.cumsum(n + DEPTH - 1) - (n + DEPTH - 1)
    own = ids[part["doc"].astype(np.int64)]
    anchor, shape = run_keys(data, begin, n)
    covered = equal_runs(data, begin, n, anchor, shape, own)
    yield found(part, ids, keys, np.flatnonzero(covered), CLOSED)
    left = np.flatnonzero(~covered)
    left = left[np.argsort(anchor[left], kind="stable")]
    start = np.flatnonzero(edges(anchor[left]))
    if not len(start):
        return
    size = np.diff(np.append(start, len(left)))
    many = np.minimum.reduceat(own[left], start) < np.maximum.reduceat(own[left], start)
    start, size, of = start[many], size[many], np.add.reduceat(n[left], start)[many]
    for a, b in shares(of, SUFFIXES):
        some = np.repeat(start[a:b] - np.cumsum(size[a:b]) + size[a:b], size[a:b]) + np.arange(size[a:b].sum())
        yield ordered(part, ids, keys, data, begin, own, left[some], np.repeat(np.arange(b - a), size[a:b]))


def ordered(part: dict, ids: np.ndarray, keys: np.ndarray, data: np.ndarray, begin: np.ndarray, own: np.ndarray, left: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """What is covered of these runs, of whole anchors (group), once their suffixes are ordered."""
    n = part["n"].astype(np.int64)
    run = np.repeat(left, n[left])
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n[left]) - n[left], n[left])
    live, new = radix_groups(data, begin[run] + inner, own[run], np.repeat(group, n[left]))
    gone = np.zeros(len(run), bool)
    if len(live):
        first = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(own[run][live], first), np.diff(np.append(first, len(live))))
        gone[live[own[run][live] > least]] = True
    opens = gone & ~np.concatenate(([False], gone[:-1] & (run[1:] == run[:-1])))[: len(gone)]
    closes = gone & ~np.concatenate((gone[1:] & (run[1:] == run[:-1]), [False]))[: len(gone)]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    return found({"doc": part["doc"][run[a]], "pos": part["pos"][run[a]].astype(np.int64) + inner[a], "n": b - a + 1}, ids, keys, np.arange(len(a)), CLOSED)


def anchors(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The digit of the strings that begin here."""
    least = np.full(len(begin), _U(0xFFFFFFFFFFFFFFFF))
    for i in range(RUN):
        np.minimum(least, h[begin + i], out=least)
    return digits(least)


def cut_crowded(h: np.ndarray, begin: np.ndarray, part: dict, digit: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """Runs of crowded anchors cut where the next least hash changes, with that in their digit; the others as they are."""
    full = np.isin(digit, crowded)
    if not full.any():
        return begin, part, digit
    n = part["n"][full]
    run = np.repeat(np.flatnonzero(full), n)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[run] + inner
    next_ = np.full(len(at), _U(0xFFFFFFFFFFFFFFFF))
    for i in range(RUN):
        x = h[at + i]
        next_ = np.minimum(next_, np.where(digits(x) == digit[run], next_, x))
    new = edges(run, next_)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(run)))
    cut = {"doc": part["doc"][run[first]], "pos": part["pos"][run[first]] + inner[first], "n": size}
    whole = {c: np.concatenate([part[c][~full], cut[c]]) for c, _ in RAW_WIDTHS}
    return np.concatenate([begin[~full], at[first]]), whole, np.concatenate([digit[~full], tk.mix(digit[run[first]] ^ tk.mix(next_[first]))])


def raw_blobs(data: np.ndarray, begin: np.ndarray, part: dict, ids: np.ndarray, keys: np.ndarray, bits: int, crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs with their bytes, packed by the bucket of their digit; those that equal a run of a smaller id here ride along as settled."""
    digit, shape = run_keys(data, begin, part["n"])
    covered = equal_runs(data, begin, part["n"], digit, shape, ids[part["doc"]])
    yield from ride_along(part, np.flatnonzero(covered), ids, keys, bits)
    begin, part, digit = cut_all(data, begin[~covered], {c: x[~covered] for c, x in part.items()}, digit[~covered], crowded)
    bucket = (digit >> _U(64 - bits)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.append(edges(bucket[by]), True)) if len(by) else np.zeros(1, np.int64)
    length = part["n"] + DEPTH - 1
    for c, d in shares(np.add.reduceat(length[by], edge[:-1]) if len(by) else edge[:-1], SHARE):
        blobs = []
        for a, b in zip(edge[c:d], edge[c + 1 : d + 1], strict=True):  # the bytes of one blob at a time
            some = by[a:b]
            blobs.append(pack({c: part[c][some] for c, _ in RAW_WIDTHS}, ids, keys, RAW_WIDTHS, gathered(data, begin[some], length[some])[0].tobytes()))
        yield sent(bucket[by][edge[c:d]], raw=blobs)


def cut_all(data: np.ndarray, begin: np.ndarray, part: dict, digit: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, dict, np.ndarray]:
    """cut_crowded, over the bytes of the crowded runs, a share at a time."""
    full = np.flatnonzero(np.isin(digit, crowded))
    if not len(full):
        return begin, part, digit
    rest = np.ones(len(digit), bool)
    rest[full] = False
    whole = [(begin[rest], {c: x[rest] for c, x in part.items()}, digit[rest])]
    length = part["n"][full] + DEPTH - 1
    for a, b in shares(length, SHARE):
        some = full[a:b]
        text, here = gathered(data, begin[some], length[a:b])
        at, cut, new = cut_crowded(gram_hashes(text), here, {c: x[some] for c, x in part.items()}, digit[some], crowded)
        of = np.searchsorted(here, at, side="right") - 1
        whole.append((begin[some][of] + at - here[of], cut, new))
    begins, parts, digits_ = zip(*whole, strict=True)
    return np.concatenate(begins), {c: np.concatenate([p[c] for p in parts]) for c, _ in RAW_WIDTHS}, np.concatenate(digits_)


RAW_BUFFER = 8 << 20  # bytes of text whose open runs are packed together


def joined_raw(waiting: list[tuple]) -> tuple[np.ndarray, np.ndarray, dict, np.ndarray, np.ndarray]:
    datas, begins, parts, ids, keys = zip(*waiting, strict=True)
    at = np.concatenate(([0], np.cumsum([len(x) for x in datas])))
    base = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    part = {c: np.concatenate([p[c] + (b if c == "doc" else 0) for p, b in zip(parts, base, strict=False)]) for c, _ in RAW_WIDTHS}
    return np.concatenate(datas), np.concatenate([x + a for x, a in zip(begins, at, strict=False)]), part, np.concatenate(ids), np.concatenate(keys)


#: Never null, so that no join adds a filter and both read one exchange.
PACKED = "doc long not null, key long not null, none boolean not null, n_bytes long not null, packed binary not null"


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's bytes, compressed."""
    for batch in batches:
        data, offsets = tk.utf8(batch.column("text"))
        packed = [squeezed(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), batch.column("none"), pa.array(np.diff(offsets)), pa.array(packed, pa.binary())], names=["doc", "key", "none", "n_bytes", "packed"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, the bytes of their texts and where each begins (with the end); few rows at a time where texts are long."""
    for batch in batches:
        size = batch.column("n_bytes").to_numpy()
        for at, to in shares(size, SHARE):
            texts = [released(x.as_buffer(), int(n)) for x, n in zip(batch.column("packed")[at:to], size[at:to], strict=True)]
            yield batch.slice(at, to - at), np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(size[at:to])))


def spans_of(found: DataFrame, name: str) -> DataFrame:
    """(doc, key, spans): a span is the start of the first string and, in the last 6 bits, their number, RUN at most."""
    return found.groupBy("doc", "key").agg(F.collect_set(F.col("start") * 64 + F.col("n")).alias(name))


def removed_spans(docs: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): docs (doc, key, none, text) as dealt out by doc and key (PACKED), and (doc, key, spans) of covered strings."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (2 * n - 1).bit_length())

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("doc").to_numpy().copy(), batch.column("key").to_numpy().copy()  # a view would hold the batch with its texts

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer = Buffer(bits)
        for batch in batches:
            (data, offsets), (ids, keys) = tk.utf8(batch.column("text")), columns(batch)
            for a, b in shares(np.diff(offsets), SHARE):
                yield from buffer.add(runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), ids[a:b], keys[a:b])
        yield from buffer.send()

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(n, (F.col("bucket") % n).cast("int")).sortWithinPartitions("bucket")  # as many buckets to each task

    first = materialize(dealt(docs.mapInArrow(send_runs, SENT)).mapInArrow(lambda b: by_bucket(b, crowd, OPEN), SPANS))
    total = first.filter(F.col("open") == TOTAL).agg(F.sum("start")).first()[0] or 0
    crowds = first.filter((F.col("open") == CROWDED) & (F.col("start") > max(crowd, total // CROWDS))).select("key").toPandas()  # CROWDS at most
    crowds = crowds["key"].to_numpy(np.int64).view(_U)

    def send_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch, data, offsets in unpacked(batches):
            opened = batch.column("open")
            each, flat = np.diff(opened.offsets.to_numpy()), opened.flatten().to_numpy()
            doc = np.repeat(np.arange(batch.num_rows), each)
            pos, count = flat >> 6, flat & 63
            waiting.append((data, offsets[doc] + pos, {"doc": doc, "pos": pos, "n": count}, *columns(batch)))  # several batches make a blob, so that blobs are worth their heads
            size += len(data)
            if size >= RAW_BUFFER or sum(len(x[3]) for x in waiting) > MOST_DOCS:
                yield from raw_blobs(*joined_raw(waiting), bits, crowds)
                waiting, size = [], 0
        if waiting:
            yield from raw_blobs(*joined_raw(waiting), bits, crowds)

    texts = docs.mapInArrow(packed_texts, PACKED).repartition(n, "doc", "key")
    opened = spans_of(first.filter(F.col("open") == OPEN), "open")
    # the same columns of texts as in the end, so that both joins read one exchange
    second = dealt(texts.join(opened.hint("shuffle_hash"), ["doc", "key"]).select(*texts.columns, "open").mapInArrow(send_open, SENT))
    second = second.mapInArrow(lambda b: by_bucket(b, crowd, CLOSED), SPANS)
    return texts, spans_of(second, "spans")


def named(rows: DataFrame, few: int = FEW) -> DataFrame:
    """rows (doc, key, ...) with key 0 where all texts of an id are the same."""
    several = materialize(rows.groupBy("doc").agg(F.min("key").alias("_a"), F.max("key").alias("_b")).filter("_a <> _b").select("doc", F.lit(True).alias("_several")))
    n = several.limit(few + 1).count()
    if n > few:
        release(several)
        return rows
    own = F.when(F.col("_several"), F.col("key")).otherwise(F.lit(0).cast("long")) if n else F.lit(0).cast("long")
    met = rows.join(F.broadcast(several), "doc", "left") if n else rows
    return met.select(*[own.alias(c) if c == "key" else c for c in rows.columns])


def dedup(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of docs (doc_id, text)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").isNull().alias("none"))
    texts, spans = removed_spans(named(rows), crowd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in unpacked(batches):
            out = []
            for i, own in enumerate(batch.column("spans")):
                body = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(body) + 1, np.int32)
                if own.is_valid:
                    span = own.values.to_numpy()
                    np.add.at(edge, span >> 6, 1)
                    np.add.at(edge, (span >> 6) + (span & 63) - 1 + DEPTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append((len(body), int(gone.sum()), spans, body[~gone].tobytes()))
            n, removed, count, kept = zip(*out, strict=True) if out else ((), (), (), ())
            ids = pa.compute.if_else(batch.column("none"), pa.scalar(None, pa.int64()), batch.column("doc"))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(spans.hint("shuffle_hash"), ["doc", "key"], "left").select(*texts.columns, "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 500, 4 << 20)
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}
