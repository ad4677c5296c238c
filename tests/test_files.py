"""Files as rows: block digests, pictures by their bytes, pinned tables."""

import hashlib
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fieldsieve.operators import receipts
from fieldsieve.sources import files, io


def ifd(entries, order=">", base=0):
    """A directory of (tag, type, value) at base, with nothing after it."""
    kinds = {3: "H2x", 4: "I"}
    return struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + kinds[k], v) for t, k, v in entries) + bytes(4)


def meta(nested, tags=(), order=">"):
    head = (b"MM\0*" if order == ">" else b"II*\0") + struct.pack(order + "I", 8)
    first = [*tags, (files.EXIF_TAG, 4, 8 + 2 + 12 * (len(tags) + 1) + 4)]
    return head + ifd(first, order) + ifd(nested, order)


def jpeg(width, height, exif=None, end=b"\xff\xd9"):
    part = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    app = part(0xE1, b"Exif\0\0" + exif) if exif is not None else b""
    return b"\xff\xd8" + app + part(0xC0, b"\x08" + struct.pack(">HH", height, width) + b"\x03") + part(0xDA, b"xx") + b"pixels" * 40 + end


def png(width, height, exif=None, damage=0):
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    body = part(b"IHDR", struct.pack(">II", width, height) + b"\x08\x02\0\0\0") + (part(b"eXIf", exif) if exif else b"") + part(b"IDAT", b"p" * 3_000_000) + part(b"IEND", b"")
    body = b"\x89PNG\r\n\x1a\n" + body
    return body[:damage] + b"?" + body[damage + 1 :] if damage else body


PLAIN = [(files.COLOR_SPACE, 3, 1), (files.PIXEL_WIDTH, 4, 64), (files.PIXEL_HEIGHT, 3, 48)]
PICTURES = {
    "plain.jpg": (jpeg(64, 48), ("jpeg", 64, 48, False, None)), "encoder.jpg": (jpeg(64, 48, meta(PLAIN)), ("jpeg", 64, 48, False, None)), "intel.jpg": (jpeg(64, 48, meta(PLAIN, order="<")), ("jpeg", 64, 48, False, None)),
    "camera.jpg": (jpeg(64, 48, meta(PLAIN, [(271, 3, 7)])), ("jpeg", 64, 48, True, None)), "time.jpg": (jpeg(64, 48, meta([*PLAIN, (36867, 4, 9)])), ("jpeg", 64, 48, True, None)),
    "other-size.jpg": (jpeg(65, 48, meta(PLAIN)), ("jpeg", 65, 48, True, None)), "wide-gamut.jpg": (jpeg(64, 48, meta([(files.COLOR_SPACE, 3, 2), *PLAIN[1:]])), ("jpeg", 64, 48, True, None)),
    "cut.jpg": (jpeg(64, 48)[:-60], ("jpeg", 0, 0, False, "truncated")), "cut-early.jpg": (jpeg(64, 48)[:9], ("jpeg", 0, 0, False, "truncated")), "cut-meta.jpg": (jpeg(64, 48, meta(PLAIN)[:30]), ("jpeg", 0, 0, False, "truncated")),
    "bad-meta.jpg": (jpeg(64, 48, b"XX" + meta(PLAIN)[2:]), ("jpeg", 0, 0, False, "metadata without a byte order")), "no-marker.jpg": (b"\xff\xd8\xff\xe0\0\x04zzzzzz", ("jpeg", 0, 0, False, "no marker where one must be")),
    "flat.jpg": (jpeg(0, 48), ("jpeg", 0, 48, False, "no size")), "plain.png": (png(7, 9), ("png", 7, 9, False, None)), "tagged.png": (png(64, 48, meta(PLAIN, [(272, 3, 1)])), ("png", 64, 48, True, None)),
    "damaged.png": (png(7, 9, damage=2_000_000), ("png", 0, 0, False, "a part does not have its checksum")), "cut.png": (png(7, 9)[:-5], ("png", 0, 0, False, "truncated")),
    "picture.tif": (b"II*\0" + struct.pack("<I", 8) + ifd([(256, 3, 30), (257, 4, 20)], "<"), ("tiff", 30, 20, True, None)), "text.jpg": (b"not a picture", (None, 0, 0, False, "no picture of a known kind")), "empty.jpg": (b"", (None, 0, 0, False, "no picture of a known kind")),
}


def test_pictures_are_told_by_their_bytes(spark, tmp_path):
    for name, (data, _) in PICTURES.items():
        (tmp_path / name).write_bytes(data)
        os.chmod(tmp_path / name, 0o600)
    rows = {r.name: r for r in files.scanned(files.listed(spark, str(tmp_path)), pictures=True).collect()}
    assert {n: (r.kind, r.width, r.height, r.source_bearing, r.error) for n, r in rows.items()} == {n: want for n, (_, want) in PICTURES.items()}
    assert all(r.digest == hashlib.sha256(PICTURES[n][0]).hexdigest() and r.size == len(PICTURES[n][0]) and r.mode & 0o777 == 0o600 for n, r in rows.items())
    assert rows["camera.jpg"].tags == [271, files.EXIF_TAG, *files.PLAIN_TAGS] or rows["camera.jpg"].tags == sorted([271, files.EXIF_TAG, *files.PLAIN_TAGS])


def test_previews_are_verified_from_their_bytes(spark, tmp_path):
    named = {"a": "plain.jpg", "b": "encoder.jpg", "c": "camera.jpg", "d": "cut.jpg", "e": "plain.jpg", "f": "plain.jpg"}
    for uuid, name in named.items():
        (tmp_path / f"{uuid}_L0_001.jpg").write_bytes(PICTURES[name][0])
        os.chmod(tmp_path / f"{uuid}_L0_001.jpg", 0o644 if uuid == "e" else 0o600)
    os.rename(tmp_path / "f_L0_001.jpg", tmp_path / "f_real.jpg")
    os.symlink(tmp_path / "f_real.jpg", tmp_path / "f_L0_001.jpg")
    inspections = spark.createDataFrame([(f"{u}/L0/001", True) for u in (*named, "g")], "asset_identifier string, preview_exported boolean")
    found = files.scanned(files.listed(spark, str(tmp_path)), pictures=True)
    rows = {r.uuid: r for r in receipts.verified_previews(inspections, found, [files.EXIF_TAG, *files.PLAIN_TAGS]).collect()}
    assert {u: r.reason for u, r in rows.items()} == {
        "a": "", "b": "", "c": "metadata tells the source", "d": "no picture: truncated", "e": "permissions are broader than the owner's", "f": "permissions are broader than the owner's", "g": "no file",
    }
    assert (rows["a"].width, rows["a"].height, rows["a"].preview_sha256, rows["d"].width) == (64, 48, hashlib.sha256(PICTURES["plain.jpg"][0]).hexdigest(), 0)


def test_files_larger_than_a_cell_have_digests(spark, tmp_path):
    large = tmp_path / "a b%.bin"
    with open(large, "wb") as f:
        f.truncate((2 << 30) + 12_345)
    (tmp_path / "small").write_bytes(b"abc")
    (tmp_path / "e%20f+?#").write_bytes(b"")
    whole, block = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        whole.update(block)
    whole.update(bytes(12_345))
    rows = {r.path: r for r in io.file_digests(spark, str(tmp_path)).collect()}
    assert rows[str(large)].digest == whole.hexdigest() and rows[str(large)]["size"] == (2 << 30) + 12_345
    assert rows[str(tmp_path / "small")].digest == hashlib.sha256(b"abc").hexdigest() and rows[str(tmp_path / "e%20f+?#")].digest == hashlib.sha256(b"").hexdigest()


def test_pinned_tables_are_read_as_they_were(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(100).repartition(3).write.parquet(path)
    manifest = spark.createDataFrame(files.pinned(spark, path).collect())
    assert manifest.count() == 3 and files.read_pinned(spark, manifest).count() == 100
    spark.range(100, 120).write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() == 120 and files.read_pinned(spark, manifest).agg(F.max("id")).first()[0] == 99  # what came since is not read
    one, two = [r.path for r in manifest.orderBy("path").limit(2).collect()]
    data = bytearray(open(one, "rb").read())
    data[len(data) // 2] ^= 1
    open(one, "wb").write(data)
    os.remove(two)
    assert {(r.path, r.reason) for r in files.unpinned(spark, manifest).collect()} == {(one, "another content"), (two, "gone")}
    with pytest.raises(ValueError, match="since it was pinned"):
        files.read_pinned(spark, manifest)
