"""Files of any size as rows: digests, what pictures are, and tables pinned to exact files.

Spark lists the files (without their contents) and deals their paths to tasks. A task opens each file
where it lies and reads it in blocks, so no file is ever a cell or whole in memory.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes of files that one task is given, about.
TASK_BYTES = 1 << 30

# Metadata tags by number, and those that an encoder alone writes and that tell nothing of a picture's source.
WIDTH_TAG, HEIGHT_TAG, EXIF_TAG = 256, 257, 34665
COLOR_SPACE, PIXEL_WIDTH, PIXEL_HEIGHT = 40961, 40962, 40963
PLAIN_TAGS = (COLOR_SPACE, PIXEL_WIDTH, PIXEL_HEIGHT)
SRGB = 1

Read = Callable[[int, int], bytes]


class Broken(ValueError):
    """A picture that cannot be read as far as it has to be."""


def exactly(read: Read, at: int, n: int) -> bytes:
    data = read(at, n)
    if len(data) < n:
        raise Broken("truncated")
    return data


def directory(read: Read, base: int, at: int, order: str) -> dict[int, int | None]:
    """The tags of a metadata directory, with the value of those that are one short or long number."""
    (n,) = struct.unpack(order + "H", exactly(read, base + at, 2))
    data, out = exactly(read, base + at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, 12 * i)
        value = {3: "H", 4: "I"}.get(kind) if count == 1 else None
        out[tag] = struct.unpack_from(order + value, data, 12 * i + 8)[0] if value else None
    return out


def metadata(read: Read, base: int) -> tuple[dict[int, int | None], dict[int, int | None]]:
    """(tags, nested tags) of a block of metadata that begins at base."""
    head = exactly(read, base, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
        raise Broken("metadata without a byte order")
    tags = directory(read, base, struct.unpack(order + "I", head[4:])[0], order)
    nested = directory(read, base, tags[EXIF_TAG], order) if tags.get(EXIF_TAG) else {}
    return tags, nested


def jpeg(read: Read, size: int) -> tuple[int, int, dict, dict]:
    at, width, height, tags, nested = 2, 0, 0, {}, {}
    while True:
        mark = exactly(read, at, 2)
        if mark[0] != 0xFF:
            raise Broken("no marker where one must be")
        if mark[1] == 0xFF:  # filling
            at += 1
            continue
        (length,) = struct.unpack(">H", exactly(read, at + 2, 2))
        if mark[1] == 0xE1 and read(at + 4, 6) == b"Exif\0\0":
            here, end = at + 10, at + 2 + length
            more, inner = metadata(lambda i, n: read(i, max(0, min(n, end - i))), here)  # noqa: B023  used at once
            tags, nested = tags | more, nested | inner
        elif mark[1] in range(0xC0, 0xD0) and mark[1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", exactly(read, at + 5, 4))
        elif mark[1] == 0xDA:
            break
        at += 2 + length
    if b"\xff\xd9" not in read(max(0, size - 64), 64):
        raise Broken("truncated")
    return width, height, tags, nested


def png(read: Read, size: int) -> tuple[int, int, dict, dict]:
    at, width, height, tags, nested, kind = 8, 0, 0, {}, {}, b""
    while kind != b"IEND":
        length, kind = struct.unpack(">I4s", exactly(read, at, 8))
        check = zlib.crc32(kind)
        for i in range(0, length, BLOCK):
            check = zlib.crc32(exactly(read, at + 8 + i, min(BLOCK, length - i)), check)
        if struct.unpack(">I", exactly(read, at + 8 + length, 4))[0] != check:
            raise Broken("a part does not have its checksum")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", exactly(read, at + 8, 8))
        if kind == b"eXIf":
            tags, nested = metadata(read, at + 8)
        at += 12 + length
    return width, height, tags, nested


def tiff(read: Read, size: int) -> tuple[int, int, dict, dict]:
    tags, nested = metadata(read, 0)
    return tags.get(WIDTH_TAG) or 0, tags.get(HEIGHT_TAG) or 0, tags, nested


# How files of each kind begin.
KINDS = ((b"\xff\xd8\xff", "jpeg", jpeg), (b"\x89PNG\r\n\x1a\n", "png", png), (b"II*\0", "tiff", tiff), (b"MM\0*", "tiff", tiff))


def picture(read: Read, size: int) -> dict:
    """kind, width, height, tags, source_bearing and error of a picture, read no further than needed.

    Metadata bears on the source unless it is nothing but an encoder's colour space and the size that
    the picture has. A file that is no picture, or a broken one, has an error and no size.
    """
    head = read(0, 8)
    kind, parse = next(((k, f) for start, k, f in KINDS if head.startswith(start)), (None, None))
    none = {"kind": kind, "width": 0, "height": 0, "tags": [], "source_bearing": False}
    if parse is None:
        return none | {"error": "no picture of a known kind"}
    try:
        width, height, tags, nested = parse(read, size)
    except Broken as wrong:
        return none | {"error": str(wrong)}
    plain = not tags or ({*tags} == {EXIF_TAG} and {*nested} <= {*PLAIN_TAGS} and nested.get(COLOR_SPACE) == SRGB and (nested.get(PIXEL_WIDTH), nested.get(PIXEL_HEIGHT)) == (width, height))
    error = None if width > 0 and height > 0 else "no size"
    return none | {"width": width, "height": height, "tags": sorted({*tags, *nested}), "source_bearing": not plain, "error": error}


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) of the files under a path; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    told = rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    names = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(p)),) for p in rows.inputFiles()], "path string")  # Spark's own list, which has empty files too
    return names.join(told, "path", "left").fillna(0, ["size"])


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if not remote(path):
        return pyarrow.fs.LocalFileSystem(), local_path(path)
    return pyarrow.fs.FileSystem.from_uri(path)


def remote(path: str) -> bool:
    return bool(re.match("[A-Za-z][A-Za-z0-9+.-]*:", path)) and not path.startswith("file:")


def local_path(path: str) -> str:
    return re.sub("^file:/+", "/", path)


SCANNED = "path string, name string, size long, digest string, mode int"
PICTURES = ", kind string, width int, height int, tags array<int>, source_bearing boolean, error string"


def scanned(files: DataFrame, pictures: bool = False) -> DataFrame:
    """Files (path, size) with their SHA-256 and, where they lie on the machine's own file system, their mode
    (a link's own); with ``pictures``, what ``picture`` says of them."""
    schema = SCANNED + (PICTURES if pictures else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist(), strict=True):
                system, at = opened(path)
                mode = os.lstat(at).st_mode if isinstance(system, pyarrow.fs.LocalFileSystem) else None
                digest = hashlib.sha256()
                with system.open_input_file(at) as f:
                    row = {"path": local_path(path), "name": at.rsplit("/", 1)[-1], "mode": mode}
                    if pictures:
                        row |= picture(lambda i, n: f.read_at(n, i) if i < size and n > 0 else b"", size)  # noqa: B023  used at once
                    f.seek(0)
                    length = 0
                    while block := f.read(BLOCK):
                        digest.update(block)
                        length += len(block)
                rows.append(row | {"size": length, "digest": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    wanted = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}.get(t, pa.string())) for n, t in (f.split() for f in schema.split(", "))])
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    tasks = max(1, min(total[1], max(files.sparkSession.sparkContext.defaultParallelism, -(-total[0] // TASK_BYTES))))
    return files.select("path", "size").repartition(tasks).mapInArrow(scan, schema).select(*names)


def pinned(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of exactly the files that a table has now: (path, size, digest)."""
    return scanned(listed(spark, path)).select("path", "size", "digest")


def unpinned(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(path, reason): files of a manifest that are gone or not what they were. Files that came since don't matter."""
    had = manifest.select("path", F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    there = [r.path for r in manifest.select("path").collect() if remote(r.path) or os.path.exists(r.path)]  # paths of one table's files
    now = scanned(spark.createDataFrame([(p, 0) for p in there], "path string, size long")).select("path", "size", "digest") if there else manifest.limit(0)
    both = had.join(now, "path", "left")
    reason = F.when(F.col("digest").isNull(), "gone").when(F.col("size") != F.col("_size"), "another length").when(F.col("digest") != F.col("_digest"), "another content")
    return both.select("path", reason.alias("reason")).filter("reason is not null")


def read_pinned(spark: SparkSession, manifest: DataFrame, kind: str = "parquet") -> DataFrame:
    """The table of exactly a manifest's files; fails if one of them changed."""
    if bad := unpinned(spark, manifest).orderBy("path").first():
        raise ValueError(f"{bad.path}: {bad.reason} since it was pinned")
    return spark.read.format(kind).load([r.path for r in manifest.select("path").orderBy("path").collect()])
