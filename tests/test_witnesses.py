"""Certificates, nested normal forms, staged writes and keyed streams, against plain versions."""

import itertools
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldsieve.functions import exprs as x
from fieldsieve.functions import nested
from fieldsieve.operators import library, receipts, selection
from fieldsieve.streaming import inspections


def test_flow_reaches_its_cut():
    rng = random.Random(12)
    for _ in range(300):
        views = "abcde"[: rng.randrange(1, 6)]
        kinds = {}
        for _ in range(rng.randrange(8)):
            kinds["\x1f".join(rng.sample(views, rng.randrange(1, len(views) + 1)))] = rng.randrange(1, 9)
        quotas = {v: rng.randrange(8) for v in views}
        given = selection.balanced_flow(kinds, quotas)
        fill = sum(given.values())
        assert all(n >= 0 for n in given.values()) and all(sum(given.get((k, v), 0) for v in views) <= n for k, n in kinds.items()) and all(sum(given.get((k, v), 0) for k in kinds) <= q for v, q in quotas.items())
        cut = selection.flow_cut(kinds, quotas, given)
        short = sum(quotas[v] for v in cut) - sum(n for k, n in kinds.items() if cut & set(k.split("\x1f")))
        assert fill == sum(quotas.values()) - short  # so no assignment fills more
        worst = max((sum(quotas[v] for v in s) - sum(n for k, n in kinds.items() if set(s) & set(k.split("\x1f"))), s) for r in range(len(views) + 1) for s in itertools.combinations(views, r))
        assert short == worst[0] and bool(cut) == (worst[0] > 0)


def test_any_schema_goes_to_json(spark):
    rows = spark.sql("select named_struct('b', array(cast('x' as binary), null), 'm', map(1, timestamp '2024-01-02 03:04:05.678', 2, null), 'n', cast(null as struct<z:int>), 'i', interval 1 day, 'd', 1.50bd, 'f', true) as r, date '2024-05-06' as day, 'é\"' as t")
    got = json.loads(rows.select(nested.json_tree(rows).alias("j")).first().j)
    assert got == {"r": {"b": [{"encoding": "base64", "value": "eA=="}, None], "m": {"1": "2024-01-02T03:04:05Z", "2": None}, "n": None, "i": "INTERVAL '1' DAY", "d": 1.5, "f": True}, "day": "2024-05-06T00:00:00Z", "t": 'é"'}


def test_normal_form_forgets_order_and_nothing_else(spark):
    def digest(sql):
        rows = spark.sql(f"select {sql} as v")
        return rows.select(nested.normal_digest(rows, "v").alias("d")).first().d

    one = "named_struct('a', array(named_struct('k', 1, 'l', array(3, 1, 2)), named_struct('k', 2, 'l', array())), 'm', map('x', 1, 'y', array(2, 1)[0]))"
    two = "named_struct('m', map('y', 2, 'x', 1), 'a', array(named_struct('l', cast(array() as array<int>), 'k', 2), named_struct('l', array(2, 3, 1), 'k', 1)))"
    assert digest(one) == digest(two)
    for other in (two.replace("'k', 2", "'k', 4"), two.replace("array(2, 3, 1)", "array(2, 3)"), two.replace("'x', 1", "'x', 9"), two.replace("array(2, 3, 1)", "array(2, 3, 1, 1)")):
        assert digest(other) != digest(one)


RECEIPT = {
    "plan_id": "p", "completed_at": "2026-01-02T03:04:05Z", "execution_nonce": "a" * 32, "source_album_identifier": "s", "source_identifier_sha256": "b" * 64, "safety_mode": "create", "source_count": 3,
    "execution_fingerprint": ("org.example.app", "c" * 64, "d" * 64), "folders": [("f", "F", "FOLDER00/L0/020"), ("g", "G", "FOLDER01/L0/020")], "albums": [("A", "ALBUM000/L0/040", 2), ("B", "ALBUM001/L0/040", 1)], "path": "/one",
}
SCHEMA = """plan_id string, completed_at string, execution_nonce string, source_album_identifier string, source_identifier_sha256 string, safety_mode string, source_count long,
  execution_fingerprint struct<app_bundle_identifier:string,app_binary_sha256:string,plan_sha256:string>, folders array<struct<key:string,title:string,identifier:string>>, albums array<struct<title:string,identifier:string,count:long>>, path string"""


def test_receipts_are_checked_and_compared(spark):
    frame = lambda **more: spark.createDataFrame([tuple((RECEIPT | more).values())], SCHEMA)
    errors = lambda **more: frame(**more).select(receipts.receipt_errors(frame(**more)).alias("e")).first().e
    assert errors() == []
    for more, said in (
        ({"completed_at": "soon"}, "completed_at is no time"), ({"execution_nonce": "A" * 32}, "execution_nonce is malformed"), ({"source_count": None}, "source_count must be positive"), ({"source_identifier_sha256": "x"}, "source_identifier_sha256 is no digest"),
        ({"execution_fingerprint": ("app", "c" * 64, "d" * 64)}, "execution_fingerprint.app_bundle_identifier is malformed"), ({"execution_fingerprint": None}, "execution_fingerprint.plan_sha256 is missing"), ({"folders": []}, "folders are missing"), ({"albums": None}, "albums are missing"),
        ({"folders": [RECEIPT["folders"][0]] * 2}, "folder key repeats"), ({"albums": [("A", "ALBUM000/L0/040", 0)]}, "album count must be positive"), ({"albums": [("A", "x/L0/040", 1)]}, "album identifier is malformed"), ({"folders": [("f", None, "FOLDER00/L0/020")]}, "folder lacks title"),
    ):
        assert said in errors(**more)
    second = {"completed_at": "2026-01-03T03:04:05Z", "execution_nonce": "e" * 32, "path": "/two", "folders": RECEIPT["folders"][::-1], "albums": RECEIPT["albums"][::-1]}
    compare = lambda **more: tuple(receipts.receipt_comparison(frame(), frame(**(second | more))).select("equal", "errors").first())
    assert compare() == (True, []) and compare(source_count=4) == (False, []) and compare(albums=RECEIPT["albums"][:1]) == (False, [])
    assert compare(path="/one", completed_at=RECEIPT["completed_at"], execution_nonce="a" * 32) == (True, ["one file", "one time", "one nonce"])
    assert compare(plan_id="q")[1][0] in ("no second receipt", "no first receipt") and compare(safety_mode="") == (False, ["second: safety_mode is missing"])


def test_batches_are_written_once_and_resumed(spark, tmp_path):
    plan = spark.createDataFrame([("m", f"a{i:03d}", i) for i in range(23)] + [("m", "a001", 1)], "album string, uuid string, n int")
    path, keys = str(tmp_path / "members"), ["album", "uuid"]

    def stop(batch):
        if batch == 1:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        library.write_batches(plan, path, keys, 5, after=stop)
    assert spark.read.parquet(path).count() == 10
    spark.range(3).select(F.lit("m").alias("album"), F.lit("junk").alias("uuid")).write.parquet(f"{path}/batch=2")  # a batch that was begun and never counted
    open(f"{path}.lock", "w").close()
    with pytest.raises(ValueError, match="another writer"):
        library.write_batches(plan, path, keys, 5)
    assert library.write_batches(plan, path, keys, 5, take_over=True) == [2, 3, 4] and not os.path.exists(f"{path}.lock")
    assert sorted(r.uuid for r in spark.read.parquet(path).collect()) == [f"a{i:03d}" for i in range(23)]
    assert library.write_batches(plan, path, keys, 5) == []
    with pytest.raises(ValueError, match="another plan"):
        library.write_batches(plan.limit(22), path, keys, 5)
    shutil.rmtree(f"{path}/batch=3")
    spark.createDataFrame([("m", "other")], "album string, uuid string").write.parquet(f"{path}/batch=3")
    with pytest.raises(ValueError, match="batch 3 is not what was written"):
        library.write_batches(plan, path, keys, 5)


STREAM = T.StructType([T.StructField(c, t) for c, t in (("asset_identifier", T.StringType()), ("state", T.StringType()), ("preview_exported", T.BooleanType()), ("preview_path", T.StringType()))])


def lines(path, rows):
    path.write_text("".join(json.dumps({"asset_identifier": a, "state": s, "preview_exported": bool(p), "preview_path": p}) + "\n" for a, s, p in rows))


def test_stream_survives_restarts_repeats_and_late_rows(spark, tmp_path):
    source, sink, done = tmp_path / "in", str(tmp_path / "out"), tmp_path / "done"
    source.mkdir()
    here = [("/p/a",), ("/p/b",)]
    run = lambda: inspections.append_once(inspections.read(spark, str(source), STREAM), sink, str(done), "asset_identifier", 8, lambda: spark.createDataFrame(here, "path string")).awaitTermination(120)
    now = lambda: sorted((r.asset_identifier, r.state) for r in inspections.current(spark, sink, STREAM, "asset_identifier").collect())
    lines(source / "1.json", [("a", "x", "/p/a"), ("a", "x", "/p/a"), ("b", "x", "/p/b"), ("c", "x", None)])
    run()
    parts = {p for p in os.listdir(sink) if p.startswith("bucket=")}
    lines(source / "2.json", [("b", "late", "/p/b"), ("d", "y", None)])
    run()
    assert now() == [("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")]
    touched = {p for p in os.listdir(sink) if os.path.isdir(f"{sink}/{p}/batch=1")}
    assert len(touched) == 1 and len(parts) <= 3  # the second batch wrote where d belongs, and nowhere else
    # the last batch is run again after a failure before it was confirmed
    os.remove(done / "commits" / "1")
    for name in os.listdir(done / "commits"):
        if name.startswith(".1"):
            os.remove(done / "commits" / name)
    run()
    assert spark.read.parquet(sink).count() == 4
    here.pop(0)  # a's preview is gone: a new result counts
    lines(source / "3.json", [("a", "again", "/p/a2"), ("b", "again", "/p/b"), ("c", "again", None)])
    run()
    assert now() == [("a", "again"), ("b", "x"), ("c", "x"), ("d", "y")]


def test_snapshots_have_folders_and_are_refused(spark):
    profile = {"folders": {"root": {"title": "R", "identifier": "id-r"}, "private": {"title": "P"}, "audit": {"title": "A"}}, "workspace_parent": {"title": "W", "identifier": "id-w"}}
    assert [(f["key"], f["parent_key"]) for f in library.folder_specs(profile, "v1")] == [("workspace_parent", None), ("root", "workspace_parent"), ("version", "root"), ("private", "root"), ("audit", "root")]
    assert [f["key"] for f in library.folder_specs({"folders": profile["folders"]})] == ["root", "private", "audit"] and library.folder_specs({"folders": profile["folders"]})[0]["existing_identifier"] == "id-r"
    with pytest.raises(ValueError, match="root, private and audit"):
        library.folder_specs({"folders": {"root": {}}})
    master = spark.createDataFrame([("a/L0/001", "why"), ("b", ""), ("a", "why")], "uuid string, selection_reason string")
    got = {r.check: r.failures for r in library.snapshot_errors(master, spark.createDataFrame([("b/L0/001",), ("c",)], "uuid string"), 2).collect()}
    assert got == {"rows off target": 1, "repeated ids": 1, "selection reason missing": 1, "overlap with holds": 1}


def test_receipts_are_made_with_one_shuffle_of_numbers(spark):
    from fieldsieve.plans import witnesses

    plan = witnesses.executions(spark, "/root/testdata/sf0.001", True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # two before, of lines as texts


def test_blank_is_what_strip_leaves_nothing_of(spark):
    texts = [None, "", " ", "\n", "\t\r\n \x0b\x0c", " a", "a\n", "\u00a0", "\n\n", "\x1c", "\u2028", "\x85", "\x00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(x.is_blank(F.col("t")).alias("blank"), (x.strip(F.col("t")) == "").alias("strip")).collect()
    assert [r.blank for r in got] == [r.strip for r in got] and sum(r.blank for r in got) == 6
