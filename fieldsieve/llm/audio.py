"""Audio media columns: WAV storage, polyphase resampling, log-mel tensors and energy segments.

``store_wav`` wraps bytes as 8-bit mono PCM in a RIFF container with plain SQL functions.
``audio_features`` reads the container back in Arrow batches and adds, for each row, an Arrow IPC
stream whose ``logmel`` column is a fixed-shape tensor [PATCH, MELS] with its time span, and the
spans of the loud segments. Rows are independent: no shuffle, and a lost executor only repeats its
own partitions.

Defined cases: null or empty bytes are stored as 64 zero samples; extra columns ride along, whatever
their names, but for n_bytes, media and the columns that ``audio_features`` adds, which are replaced;
repeated rows and equal payloads give equal features; long payloads are worked off in blocks of BLOCK
frames, so memory follows the tensor, not the transforms; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

RATE, UP, DOWN = 16000, 2, 3  # stored rate and the resampling ratio
WINDOW, HOP, MELS, PATCH = 256, 128, 16, 32
TAPS = 16  # of the resampling filter, for each phase
BLOCK = 8192  # frames worked on at once
UNIT = 64  # payloads are padded to a multiple of this
LOUD_DB, QUIET_DB = 0.6, 0.1  # thresholds over the median: a segment opens at the first and closes under the second


def _bytes_le(value: Column, size: int) -> Column:
    """Little-endian bytes of an integer column, as hex digit pairs taken from the right."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(size)]))


def store_wav(df: DataFrame, data: Column, unit: int = UNIT) -> DataFrame:
    """Add ``n_bytes`` and ``media``: the bytes, zero-padded to a positive multiple of unit, as 8-bit mono WAV."""
    data = F.coalesce(data, F.lit(b""))
    n = F.octet_length(data).cast("long")
    padded = F.greatest(F.lit(unit), (n + (unit - 1)) - F.pmod(n + (unit - 1), F.lit(unit)))
    header = F.concat(
        F.lit(b"RIFF"), _bytes_le(padded + 36, 4), F.lit(b"WAVEfmt "),
        F.lit((16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + RATE.to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")),
        F.lit(b"data"), _bytes_le(padded, 4),
    )
    zeros = F.substring(F.lit(bytes(unit)), F.lit(1), (padded - n).cast("int"))
    return df.withColumns({"n_bytes": n, "media": F.concat(header, data, zeros)})


def payload_of(wav: bytes) -> np.ndarray:
    """The samples of the container's data chunk."""
    if wav[:4] != b"RIFF" or wav[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE container")
    at = 12
    while wav[at : at + 4] != b"data":
        at += 8 + int.from_bytes(wav[at + 4 : at + 8], "little")
    return np.frombuffer(wav, np.uint8, int.from_bytes(wav[at + 4 : at + 8], "little"), at + 8)


def sinc_filter(up: int, down: int, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass with ``taps`` coefficients for each of the ``up`` phases."""
    n = taps * up
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    return (h * up / h.sum()).astype(np.float32)


def resample(samples: np.ndarray, first: int, last: int, h: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Outputs first..last-1 of the polyphase resampler over unsigned samples; silence outside them."""
    taps, out = len(h) // up, np.zeros(last - first, np.float32)
    base = first * down // up - taps
    piece = samples[max(0, base) : max(0, last * down // up + 1)].astype(np.float32) - np.float32(128)
    span = last * down // up + 1 - base
    x = np.zeros(span + 1, np.float32)
    x[max(0, -base) : max(0, -base) + len(piece)] = piece
    for r in range(up):
        at = np.arange(first + (r - first) % up, last, up)
        if not len(at):
            continue
        phase, start = (int(at[0]) * down) % up, int(at[0]) * down // up - base
        step = down  # outputs of one phase lie `down` inputs apart
        for j in range(taps):
            part = x[start - j :: step][: len(at)]
            out[at[0] - first :: up][: len(part)] += h[phase + j * up] * part
    return out


def mel_filterbank(rate: float, window: int = WINDOW, mels: int = MELS) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(window, 1 / rate)
    rise = (freq[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - freq[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(samples: np.ndarray, h: np.ndarray, bank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and the energy (dB) of each frame; half-overlapped windows, the last one zero-padded."""
    total = -(-len(samples) * UP // DOWN)
    frames = max(1, -(-total // HOP))
    taper = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    mel, energy = np.empty((frames, bank.shape[1]), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, BLOCK):
        b = min(frames, a + BLOCK)
        x = resample(samples, a * HOP, (b - 1) * HOP + WINDOW, h)
        x[max(0, total - a * HOP) :] = 0
        framed = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP] * taper
        energy[a:b] = 10 * np.log10(np.einsum("ij,ij->i", framed, framed) / WINDOW + 1e-6)
        power = np.abs(np.fft.rfft(framed)).astype(np.float32) ** 2
        mel[a:b] = np.log(power @ bank + np.float32(1e-3))
    return mel, energy


def hysteresis(energy: np.ndarray, loud: float = LOUD_DB, quiet: float = QUIET_DB) -> np.ndarray:
    """Runs [start, end) of frames over the lower threshold that reach the upper one somewhere."""
    mid = np.median(energy)
    over = np.concatenate(([0], (energy >= mid + quiet).astype(np.int8), [0]))
    edge = np.diff(over)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty((0, 2), np.int64)
    peak = np.concatenate(([0], np.cumsum(energy >= mid + loud)))
    keep = peak[ends] > peak[starts]
    return np.stack([starts[keep], ends[keep]], 1)


def tensor_stream(mel: np.ndarray) -> bytes:
    """Arrow IPC stream of fixed-shape tensors [PATCH, MELS] with time spans; the last patch is zero-padded."""
    n = -(-len(mel) // PATCH)
    full = np.zeros((n * PATCH, mel.shape[1]), np.float32)
    full[: len(mel)] = mel
    second = HOP / (RATE * UP / DOWN)
    start = np.arange(n) * PATCH * second
    batch = pa.record_batch({
        "start_s": start, "end_s": np.minimum(start + PATCH * second, len(mel) * second),
        "logmel": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, mel.shape[1])),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    return pa.ipc.open_stream(stream).read_all()


SPAN = T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))
ADDED = (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("n_frames", T.LongType()), ("segments", SPAN), ("tensors", T.BinaryType()))


def audio_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Read each stored container back and replace it by digests, time spans and the tensor stream.

    Columns of df that have the name of an added one are replaced.
    """
    keep = [c for c in df.columns if c not in (media, *(n for n, _ in ADDED))]
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(n, t) for n, t in ADDED]])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, bank, second = sinc_filter(UP, DOWN), mel_filterbank(RATE * UP / DOWN), HOP / (RATE * UP / DOWN)
        for batch in batches:
            rows: dict[str, list] = {n: [] for n, _ in ADDED}
            for wav in batch.column(media):
                raw = wav.as_py()
                samples = payload_of(raw)
                mel, energy = log_mel(samples, h, bank)
                rows["payload_bytes"].append(len(samples))
                rows["payload_sha256"].append(hashlib.sha256(samples).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(samples[-UNIT:]))
                rows["media_bytes"].append(len(raw))
                rows["media_sha256"].append(hashlib.sha256(raw).hexdigest())
                rows["n_frames"].append(len(mel))
                rows["segments"].append([{"start_s": float(a), "end_s": float(b)} for a, b in hysteresis(energy) * second])
                rows["tensors"].append(tensor_stream(mel))
            types = {"segments": pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())])), "tensors": pa.binary()}
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(rows[n], types.get(n)) for n, _ in ADDED], names=[*keep, *rows]
            )

    return df.select(*keep, media).mapInArrow(features, schema)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_text"))
    out = audio_features(store_wav(docs, F.col("_text")).drop("_text"))
    feature = F.concat_ws(":", F.col("n_frames"), F.size("segments"), F.sha2(F.col("tensors"), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op1_media_audio": op1_media}
ORACLES: dict[str, str] = {}
