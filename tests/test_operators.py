import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fieldsieve.operators import inspection, retrieval, review, selection
from fieldsieve.sources import io


def practice(spark):
    """Thirty rows: two direct holds, a duplicate pair, a burst of three."""
    i = F.col("id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), ((i - 1) % 5 + 1).cast("int"))
    return spark.range(1, 31).select(
        F.format_string("DEMO-%03d", i).alias("uuid"), pick("01", "02", "03", "04", "").alias("candidate_views"), pick("high", "high", "high", "medium", "unknown").alias("evidence_confidence"),
        pick("people", "apparatus", "document", "place", "").alias("visible_observation"), F.lit("reviewer").alias("observation_source"), pick("A;B", "C", "", "", "").alias("persons"),
        (i % 7 == 0).alias("favorite"), (i % 6 == 0).alias("edited"), F.when(i.isin(9, 24), "hold").otherwise("clear").alias("safety_status"), F.lit("false").alias("hidden"), F.lit(None).cast("string").alias("missing"),
        F.when(i.isin(11, 12), "duplicate-a").otherwise("").alias("duplicate_group"), F.when(i.isin(16, 17, 18), "burst-a").otherwise("").alias("burst_group"), ((i % 5) / 5).alias("aesthetic_score"),
    )


def test_clusters_and_holds(spark):
    rows = selection.scored(practice(spark))
    assert {r.uuid for r in rows.filter(selection.is_hold(rows)).collect()} == {"DEMO-009", "DEMO-024"}
    left = {r.uuid for r in selection.burst_limited(selection.duplicate_representatives(rows)).collect()}
    assert len(left) == 28 and len(left & {"DEMO-011", "DEMO-012"}) == 1 and len(left & {"DEMO-016", "DEMO-017", "DEMO-018"}) == 2


def test_hold_closure_reaches_the_end_and_keeps_names_apart(spark):
    rows = spark.createDataFrame(
        [("a", "hold", "g1", ""), ("b", "clear", "g1", "k1"), ("c", "clear", "", "k1"), ("d", "clear", "k1", ""), ("e", "clear", "", ""), ("f", "unavailable", "", "")],
        "uuid string, safety_status string, duplicate_group string, burst_group string",
    )
    got = {r.uuid: (r.held, r.automatic) for r in selection.hold_closure(rows).collect()}
    assert got == {"a": (True, False), "b": (True, True), "c": (True, True), "d": (False, False), "e": (False, False), "f": (True, False)}


def best_matching(rows, quotas):
    """Greatest number of places that can be filled, by augmenting paths on single rows."""
    slots = [v for v, q in quotas.items() for _ in range(q)]
    held = {}

    def place(u, views, seen):
        for s, v in enumerate(slots):
            if v in views and s not in seen:
                seen.add(s)
                if s not in held or place(held[s], rows[held[s]], seen):
                    held[s] = u
                    return True
        return False

    return sum(place(u, views, set()) for u, views in rows.items())


def test_flow_on_counts_fills_as_much_as_flow_on_rows():
    rng = random.Random(4)
    kinds = ["\x1f".join(p) for n in (1, 2, 3) for p in itertools.permutations("abc", n)]
    for _ in range(150):
        counts = {k: rng.randrange(4) for k in rng.sample(kinds, 5)}
        quotas = {v: rng.randrange(5) for v in "abc"}
        rows = {f"{k}{i}": k.split("\x1f") for k, n in counts.items() for i in range(n)}
        given = selection.balanced_flow(counts, quotas)
        assert sum(given.values()) == best_matching(rows, quotas) and all(n >= 0 for n in given.values())
        assert all(sum(n for (_, v), n in given.items() if v == view) <= q for view, q in quotas.items())
        assert all(sum(n for (k, _), n in given.items() if k == kind) <= c for kind, c in counts.items())


def test_assignment_meets_quotas_or_fails(spark):
    rows = spark.createDataFrame([(f"u{i}", float(i), ["a", "b"] if i % 2 else ["a"]) for i in range(8)], "uuid string, score double, views array<string>")
    got = selection.assign(rows, {"a": 4, "b": 3}).collect()
    assert len(got) == len({r.uuid for r in got}) == 7 and sorted(r.assigned_view for r in got) == ["a"] * 4 + ["b"] * 3
    with pytest.raises(ValueError, match="cannot be met"):
        selection.assign(rows, {"a": 4, "b": 5}).collect()


def test_floor_swaps_weakest_for_best(spark):
    schema = "uuid string, view string, score double, persons string"
    chosen = spark.createDataFrame([("a", "v", 1.0, ""), ("b", "v", 2.0, ""), ("c", "v", 3.0, "P"), ("d", "w", 1.0, "")], schema)
    spare = spark.createDataFrame([("e", "v", 0.5, "P"), ("f", "v", 0.4, "P"), ("g", "w", 9.0, "")], schema)
    got = {r.uuid for r in selection.raise_floor(chosen, spare, F.col("persons") != "", 0.5).collect()}
    assert got == {"e", "b", "c", "d"}
    with pytest.raises(ValueError):
        selection.raise_floor(chosen, spare, F.col("persons") != "", 1.0).collect()


def test_sample_positions():
    assert review.sample_positions({"v": 2}, 3, 1) == [("v", 0), ("v", 1)]
    got = review.sample_positions({"b": 100, "a": 50}, 5, 7)
    draw = random.Random(7)
    for view, n in (("a", 50), ("b", 100)):
        want = {0, n // 2, n - 1}
        while len(want) < 5:
            want.add(draw.randrange(n))
        assert [p for v, p in got if v == view] == sorted(want)
    assert review.sample_positions({"v": 9}, 2, 1) == [("v", 0), ("v", 4)]


def test_ranked_numbers_every_part_without_gaps(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("string").alias("part"))
    got = review.ranked(rows, "part", F.desc("id")).collect()
    for part in ("true", "false"):
        own = sorted((r for r in got if r.part == part), key=lambda r: -r.id)
        assert [r.pos for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}


def test_evaluation_gates(spark):
    rows = [("v", "fit")] * 3 + [("v", "reject")] + [("w", "uncertain")] + [("w", "")] * 9
    got = {r.primary_view: r for r in review.evaluate(spark.createDataFrame(rows, "primary_view string, judgment string")).collect()}
    assert got["v"].passed and got["v"].precision == 0.75
    assert got["w"].failure_reasons == ["no decisive judgment", "coverage below minimum", "precision below minimum", "uncertainty above maximum"]


def test_handoff_is_all_or_nothing(spark):
    schema = "uuid string, primary_view string, clearance string, public_title string, credit string, license string, cleared_on string"
    good = [("a", "v", "cleared", "T", "C", "L", "2026-01-02"), ("b", "v", "pending", "=x", "", "", "")]
    public, errors = review.public_handoff(spark.createDataFrame(good, schema), b"s" * 16, "site", ("public_title",))
    assert public.count() == 1 and errors.isEmpty()
    public, errors = review.public_handoff(spark.createDataFrame([*good, ("c", "v", "cleared", "=x", "C", "L", "2026-01-02")], schema), b"s" * 16, "site", ("public_title",))
    assert public.isEmpty() and errors.first().errors == ["public_title unsafe"]


def test_inspection_merge_holds_what_is_missing(spark):
    results = spark.createDataFrame([("a", "clear-automated", [], True, [f"l{i}" for i in range(8)], 2), ("b", "clear-automated", ["x"], False, [], 0)], "uuid string, safety_state string, safety_flags array<string>, pixel_available boolean, vision_labels array<string>, detected_face_count int")
    got = {r.uuid: r for r in inspection.merge(spark.createDataFrame([("a",), ("b",), ("c",)], "uuid string"), results).collect()}
    assert got["a"].machine_visible_signals == "2 visible face(s); l0; l1; l2; l3; l4; l5" and got["a"].safety_status == "clear-automated"
    assert (got["b"].safety_status, got["b"].safety_reason) == ("hold", "x") and got["c"].safety_status == "hold"


def test_retrieval_adds_each_matching_row(spark):
    terms = spark.createDataFrame([("v", "keyword", "Red"), ("v", "keyword", "red")], "view string, channel string, term string")
    texts = spark.createDataFrame([("a", "keyword", "dark red"), ("a", "keyword", "RED"), ("b", "label", "red")], "uuid string, channel string, value string")
    got = [tuple(r) for r in retrieval.view_scores(retrieval.term_matches(terms, texts)).collect()]
    assert got == [("v", "a", 12, ["keyword:red"])]


def test_manifests_round_trip_and_fail_closed(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('﻿uuid,filename,note\na,f.jpg,"x ""y"", z"\nb,g.jpg,\n', encoding="utf-8")
    rows = io.read_manifest(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("uuid").collect()] == [("a", "f.jpg", 'x "y", z'), ("b", "g.jpg", "")]
    io.write_manifest(rows, str(tmp_path / "out"))
    assert io.read_manifest(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "n.csv").write_text("uuid\na\n")
    with pytest.raises(ValueError, match="missing columns"):
        io.read_manifest(spark, str(tmp_path / "n.csv"))


def test_jsonl_rejects_repeats_and_broken_lines(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("uuid", T.StringType())])
    (tmp_path / "a.jsonl").write_text('{"uuid": "x"}\n{"uuid": "x"}\n')
    with pytest.raises(ValueError, match="repeated"):
        io.read_unique_jsonl(spark, str(tmp_path / "a.jsonl"), schema, "uuid")
    (tmp_path / "b.jsonl").write_text('{"uuid": \n')
    with pytest.raises(ValueError, match="malformed"):
        io.read_unique_jsonl(spark, str(tmp_path / "b.jsonl"), schema, "uuid")


def policy(**more):
    views = [{"id": "01", "label": "People", "quota": 2}, {"id": "02", "label": "Tools", "quota": 1, "evaluation_mode": "sparse-hypothesis"}, {"id": "00", "label": "Rest", "quota": 0}]
    source = {"identifier": "album-1", "expected_count": 30, "identifier_sha256": "0" * 64}
    return {"seed": 7, "target_count": 3, "unclassified_view": "00", "evaluation_sample_per_view": 3, "source": source, "views": views} | more


def test_policy_checks():
    assert io.check_policy(policy()) == []
    bad = [{"target_count": 4}, {"burst_limit": 0}, {"minimum_eval_precision": 2}, {"views": []}, {"unclassified_view": "09"}, {"minimum_view_eval_sample": 0}, {"source": {"identifier": " ", "expected_count": 1, "identifier_sha256": "x"}}]
    bad.append({"views": [{"id": "01", "label": "x", "quota": 3, "evaluation_mode": "standard"}], "unclassified_view": "01"})
    assert all(io.check_policy(policy(**x)) for x in bad)
    assert [f for f in io.POLICY_FIELDS if not io.check_policy({k: v for k, v in policy().items() if k != f})] == []


def test_full_retrieval_reads_its_relations_from_one_table(spark, monkeypatch):
    from fieldsieve.plans import candidates
    from fieldsieve.sources import io

    given, real = [], candidates.rt.retrieve
    monkeypatch.setattr(candidates.rt, "retrieve", lambda a, r, q: given.append(r) or real(a, r, q))
    monkeypatch.setattr(io, "PART_ROWS", 5000, raising=False)
    candidates.q_retrieve_full(spark, "/root/testdata/sf0.001")
    assert hasattr(given[0], "kept_at") and given[0].count() == given[0].distinct().count()
    assert candidates.archive(spark, "/root/testdata/sf0.001")[1].rdd.getNumPartitions() > 4


def test_part_suppliers_are_dealt_to_parts_of_bounded_size(spark, monkeypatch):
    from fieldsieve.plans import catalog

    monkeypatch.setattr(io, "PART_ROWS", 500, raising=False)
    links = catalog.q_people_links(spark, "/root/testdata/sf0.001")
    assert links.rdd.getNumPartitions() > 4 and links.count() == links.distinct().count() > 0


def test_retrieval_scores_are_dealt_to_parts_of_bounded_size(spark, monkeypatch):
    from fieldsieve.plans import catalog

    monkeypatch.setattr(io, "PART_ROWS", 500, raising=False)
    assert catalog.retrieved(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4


def test_rows_digest_sorts_a_text_once(spark, monkeypatch):
    from fieldsieve.operators import identity

    orders, real = [], identity.fold_digests
    monkeypatch.setattr(identity, "fold_digests", lambda rows, by, text, order, *more: orders.append(len(order)) or real(rows, by, text, order, *more))
    rows = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "0")], "k string, v string")
    got = identity.rows_digest(rows, {"k": F.col("k"), "v": F.col("v")}, [F.col("k")]).first()
    assert orders == [1] and got.n == 3
    assert got.digest == hashlib.sha256(b'[{"k":"a","v":"1"},{"k":"a","v":"2"},{"k":"b","v":"0"}]').hexdigest()


def test_term_hits_take_texts_in_small_batches(spark):
    from fieldsieve.operators import terms

    for name in ("Records", "Bytes"):
        spark.conf.unset(f"spark.sql.execution.arrow.max{name}PerBatch")
    texts = spark.range(3000).selectExpr("cast(id as string) as uuid", "'album' as channel", "repeat('ab ', 10) as value")
    asked = spark.createDataFrame([("v", "album", "ab")], "view string, channel string, term string")
    assert terms.term_hits(asked, texts).count() == 3000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
