"""Whole contracts on the practice inventory and small tables, against plain versions."""

import hashlib
import itertools
import json
import math
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_operators import policy

from fieldsieve.operators import evaluation, feedback, identity, library, proposal, publication, receipts, retrieval
from fieldsieve.operators.terms import term_hits
from fieldsieve.sources import io, practice


def small_batches(spark, rows=10_000):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def practice_policy(**more):
    views = [{"id": v, "label": f"View {v}", "quota": q} for v, q in (("00", 2), ("01", 4), ("02", 3), ("03", 2), ("04", 3))]
    return policy(views=views, target_count=14, **more)


@pytest.fixture(scope="module")
def chosen(spark):
    rule = practice_policy(minimum_named_people_fraction=0.5, minimum_person_free_fraction=0.3)
    return rule, *(t.cache() for t in proposal.select(practice.inventory(spark), rule))


def test_practice_rows(spark):
    rows = practice.inventory(spark).orderBy("uuid").collect()
    assert len(rows) == 30 and {f for r in rows for f in r.asDict() if not isinstance(r[f], str)} == set()
    assert [r.uuid for r in rows if r.safety_status == "hold"] == ["DEMO-009", "DEMO-024"] and rows[4].candidate_views == "" and rows[0].persons == "Alex Example;Robin Example"


def test_whole_selection_meets_quotas_and_floors(spark, chosen):
    rule, master, holds, summary = chosen
    rows, one = master.collect(), summary.first()
    assert len(rows) == 14 and {v["id"]: v["quota"] for v in rule["views"]} == {v: sum(r.primary_view == v for r in rows) for v in {r.primary_view for r in rows}}
    named = sum(bool(r.persons.strip()) for r in rows)
    assert named >= 7 and 14 - named >= 5 and one.named_people_count == named and one.assignment_method == "deterministic-constrained-maximum-flow"
    assert {r.uuid for r in holds.collect()} == {"DEMO-009", "DEMO-024"} and one.hold_count == 2 and one.inventory_count == 30
    assert rows == sorted(rows, key=lambda r: (r.primary_view, -float(r.score_total), r.uuid)) and all(r.selection_reason.startswith("editorial assignment") for r in rows)
    text = json.dumps(sorted(({"uuid": r.uuid, "assigned_view": r.primary_view, "config_sha256": identity.policy_digest(rule)} for r in rows), key=lambda r: (r["assigned_view"], r["uuid"])), sort_keys=True, separators=(",", ":"))
    assert {r.master_sha256 for r in rows} == {__import__("hashlib").sha256(text.encode()).hexdigest()}
    assert {r.check: r.failures for r in proposal.validate(master, holds, rule).filter("failures > 0").collect()} == {}
    bad = master.withColumn("master_sha256", F.lit("x")).unionByName(master.limit(1))
    wrong = {r.check for r in proposal.validate(bad, master.limit(2), rule).filter("failures > 0").collect()}
    assert {"repeated ids", "master digest differs", "rows off target", "overlap with holds", "views off quota"} <= wrong
    for other in (bad, master.limit(3), master.limit(0), master.withColumn("proposal_id", F.lit(""))):
        with pytest.raises(ValueError, match="exact bound master"):
            publication.scaffold(other)
        with pytest.raises(ValueError, match="exact bound master"):
            publication.handoff(other, publication.scaffold(master), b"s" * 16, "site")


def test_explicit_assignments_are_checked(spark):
    rows = practice.inventory(spark).withColumn("assigned_view", F.when(F.col("candidate_views") == "", "00").otherwise(F.col("candidate_views")))
    for change, message in ((F.when(F.col("uuid") == "DEMO-001", "").otherwise(F.col("assigned_view")), "cannot mix"), (F.when(F.col("uuid") == "DEMO-001", "77").otherwise(F.col("assigned_view")), "unknown assigned_view")):
        with pytest.raises(ValueError, match=message):
            proposal.select(rows.withColumn("assigned_view", change), practice_policy())
    with pytest.raises(ValueError, match="invalid assignment_status"):
        proposal.select(rows.withColumn("assignment_status", F.lit("maybe")), practice_policy())
    assert proposal.select(rows, practice_policy())[0].count() == 14


def test_floor_swaps_take_the_weakest_donors_in_order():
    rng = random.Random(3)
    for _ in range(300):
        views = ["a", "b", "c", "rest"]
        chosen = [(f"c{i}", rng.choice(views), rng.randrange(9)) for i in range(rng.randrange(8))]
        incoming = [(f"n{i}", rng.sample(views[:3], rng.randrange(3))) for i in range(rng.randrange(8))]
        need, left, want = rng.randrange(5), list(chosen), []
        for uuid, allowed in incoming:  # plain: the weakest of all that may leave
            donors = sorted((s, u, v) for u, v, s in left if v in allowed or v == "rest")
            if len(want) < need and donors:
                want.append((uuid, donors[0][1], donors[0][2]))
                left = [x for x in left if x[0] != donors[0][1]]
        assert proposal.floor_swaps(chosen, incoming, need, "rest") == want


def test_feedback_is_bound_and_gates_decide(spark, chosen):
    rule, master, _, _ = chosen
    sample = feedback.review_sample(master, 3, rule["seed"])
    filled = practice.judged(sample).cache()
    assert feedback.feedback_errors(filled, master, rule).count() == 0
    changed = filled.withColumn("config_sha256", F.lit("other")).filter(F.col("uuid") != filled.first().uuid)
    errors = {e for r in feedback.feedback_errors(changed, master, rule).collect() for e in r.errors}
    assert {"config_sha256 differs", "sampled row without feedback"} <= errors
    found = filled.select("inspection_path", F.when(F.col("uuid") == filled.first().uuid, "0").otherwise(F.col("inspection_sha256")).alias("digest"))
    assert [r.errors for r in feedback.feedback_errors(filled, master, rule, found).collect()] == [["inspection digest differs"]]
    report = evaluation.report(filled, rule, master)
    assert report["passed"] and report["coverage"] == 1.0 and set(report["by_view"]) == {"00", "01", "02", "03", "04"}
    one = master.first()
    assert (report["master_sha256"], report["proposal_id"], report["config_sha256"], report["sample_sha256"]) == (one.master_sha256, one.proposal_id, identity.policy_digest(rule), sample.first().sample_sha256) and len(report["feedback_sha256"]) == 64
    none = spark.createDataFrame([], "uuid string")
    checked = proposal.validation_report(master, none, rule)
    assert checked["status"] == "PASS" and checked["view_counts"] == {v["id"]: v["quota"] for v in rule["views"]}
    build = lambda **given: proposal.catalog_plan(**({"master": master, "holds": none, "policy": rule, "plan_id": "p1", "source": rule["source"], "evaluation": report, "feedback": filled, "validation": checked} | given))
    plan = build()
    assert plan["evaluation"]["feedback_sha256"] == report["feedback_sha256"] and plan["validation"] == {"status": "PASS", "master_sha256": one.master_sha256, "safety_sha256": checked["safety_sha256"]}
    for given, message in (
        ({"evaluation": report | {"feedback_sha256": "0" * 64}}, "does not match the exact review"), ({"validation": checked | {"safety_sha256": "x"}}, "validation report does not match"), ({"holds": master.limit(1)}, "validation report does not match"),
        ({"source": rule["source"] | {"expected_count": 0}}, "frozen source"), ({"feedback": filled.limit(5)}, "sampled row without feedback"), ({"feedback": filled.withColumn("visible_reason", F.lit("other"))}, "does not match the exact review"),
    ):
        with pytest.raises(ValueError, match=message):
            build(**given)
    with pytest.raises(ValueError, match="unknown evaluation judgments: maybe"):
        evaluation.report(filled.withColumn("judgment", F.lit("maybe")), rule, master)
    assert [a["key"] for a in plan["albums"]] == ["master", "view-00", "view-01", "view-02", "view-03", "view-04"] and plan["albums"][0]["title"] == "00 MASTER - 14" and plan["write_test_count"] == 10
    worse = practice.judged(sample, tuple(r.uuid for r in sample.filter("primary_view = '01'").collect()))
    report = evaluation.report(worse, rule, master)
    assert not report["passed"] and report["by_view"]["01"]["failure_reasons"] == ["precision below minimum"] and report["failed_views"] == 1
    sparse = rule | {"views": [v | ({"evaluation_mode": "sparse-hypothesis"} if v["id"] == "01" else {}) for v in rule["views"]]}
    assert evaluation.gates(worse, sparse)["by_view"]["01"]["passed"]
    missing = evaluation.gates(filled.filter("primary_view <> '02'"), rule)
    assert missing["by_view"]["02"]["failure_reasons"] == ["view not sampled", "coverage below minimum", "insufficient decisive judgments", "precision below minimum"]


def test_retrieval_equals_a_plain_version(spark):
    rng = random.Random(9)
    assets = [(f"a{i:03d}", rng.random() < 0.95, rng.random() < 0.05, False, rng.random() < 0.2, rng.random() < 0.2, rng.randrange(3), 1990 + rng.randrange(30), " ".join(rng.sample(["Red", "blue", "boat", "tree"], 2))) for i in range(150)]
    relations = sorted({(f"a{rng.randrange(150):03d}", c, rng.choice(["Lake view", "Old prior", "Ann", "harbour", "red boat"])) for c in ("album", "person", "place", "keyword") for _ in range(120)})
    request = {"target": 30, "seed": 5, "candidate_multiplier": 1.5, "minimum_outside_prior_fraction": 0.9, "prior_corpus_album_title": "Old prior", "excluded_album_terms": ["PRIOR"],
               "views": [{"id": "w", "quota": 12, "terms": ["red", "Lake"], "people": ["ann"]}, {"id": "k", "quota": 18, "terms": ["boat"], "places": ["harbour"], "year_start": 2000}]}
    schema = "uuid string, is_photo boolean, hidden boolean, trashed boolean, favorite boolean, edited boolean, face_count int, year int, text string"
    got = {r.uuid: r for r in retrieval.retrieve(spark.createDataFrame(assets, schema), spark.createDataFrame(relations, "uuid string, channel string, value string"), request).collect()}
    by, scores = {a[0]: a for a in assets}, {"w": {}, "k": {}}
    lookup = [(a[0], "asset-text", a[8]) for a in assets if a[1] and not a[2]]
    for u, c, v in relations:
        lookup += [(u, x, v) for x in {"album": ("album", "album-term"), "place": ("place", "place-term")}.get(c, (c,))]
    for view, channel, term in retrieval.request_terms(request):
        for u, c, v in lookup:
            if c == channel and term in v.lower() and not (c in ("album", "album-term") and "prior" in v.lower()):
                scores[view][u] = scores[view].get(u, 0) + retrieval.WEIGHTS[channel]
    for u in scores["k"]:
        scores["k"][u] += 2 if by[u][7] >= 2000 else 0
    attention = {a[0]: 12 if a[4] and a[5] else 7 if a[4] else 5 if a[5] else 0 for a in assets}
    noise = lambda v, u: int(__import__("hashlib").sha256(f"5:{v}:{u}".encode()).hexdigest()[:16], 16)
    picked = []
    for v, n in (("w", 18), ("k", 27)):
        ranked = sorted(scores[v], key=lambda u: (scores[v][u] + attention[u], noise(v, u), u), reverse=True)[:n]
        picked += [u for u in ranked if u not in picked]
    picked = picked[:45]
    more = sorted((a for a in assets if a[1] and not a[2] and (a[4] or a[5] or a[6])), key=lambda a: (-(a[4] + a[5]), -a[6], a[0]))[: 4 * (45 - len(picked))]
    picked += [a[0] for a in more if a[0] not in picked][: 45 - len(picked)]
    prior = {u for u, c, v in relations if c == "album" and v == "Old prior"}
    total = lambda u: max(scores["w"].get(u, 0), scores["k"].get(u, 0)) + attention[u]
    need = math.ceil(45 * 0.9) - sum(u not in prior for u in picked)
    inside = sorted((u for u in picked if u in prior), key=lambda u: (total(u) if u in scores["w"] or u in scores["k"] else 0, u))
    outside = sorted((u for u in {*scores["w"], *scores["k"]} if u not in prior and u not in picked), key=lambda u: (total(u), u), reverse=True)
    k = max(0, min(need, len(inside), len(outside)))
    assert set(got) == set(picked) - set(inside[:k]) | set(outside[:k]) and all("prior" not in r.albums.lower() for r in got.values())
    for u, r in got.items():
        views = sorted((v for v in ("w", "k") if u in scores[v]), key=lambda v: (-scores[v][u], v))
        assert all(b.split(":")[1] in {"asset-text", "album-term", "keyword", "place", "existing-people-association", "supporting-date-range"} for b in r.retrieval_basis.split(";") if b)
        assert ("k:supporting-date-range" in r.retrieval_basis.split(";")) == (u in scores["k"] and by[u][7] >= 2000)
        assert r.candidate_views == ";".join(views) and r.metadata_score == f"{max((scores[v][u] for v in views), default=0):.2f}"


def test_previews_are_verified(spark):
    inspections = spark.createDataFrame([("a/L0/001", True), ("b/L0/001", True), ("b", True), ("c/L0/001", False), (" ", True), ("d/L0/001", True), ("e/L0/001", True), ("f/L0/001", True)], "asset_identifier string, preview_exported boolean")
    files = [("a_L0_001.jpg", 0o600, 9, [256]), ("b_L0_001.jpg", 0o600, 9, []), ("d_L0_001.jpg", 0o644, 9, []), ("e_L0_001.jpg", 0o600, 0, []), ("f_L0_001.jpg", 0o600, 9, [256, 271])]
    rows = spark.createDataFrame([(n, "/p/" + n, "d" * 64, 10, m, w, w, t) for n, m, w, t in files], "name string, path string, digest string, size long, mode int, width int, height int, tags array<int>")
    got = {(r.local_identifier, r.decode_status): r.reason for r in receipts.verified_previews(inspections, rows, [256, 257]).collect()}
    assert got.pop(("a/L0/001", "ok")) == "" and {k[1] for k in got} == {"invalid"}
    assert got["d/L0/001", "invalid"].startswith("permissions") and got["e/L0/001", "invalid"] == "no picture" and got["f/L0/001", "invalid"] == "metadata tells the source" and got["b", "invalid"] == "identifier repeats"


def test_receipt_rows(spark):
    one, two = spark.createDataFrame([("p1", 3)], "plan_id string, source_count int"), spark.createDataFrame([("p1", 4)], "plan_id string, expected_source_count int")
    assert [r.field for r in receipts.scalar_differences(one, two, {"plan_id": "plan_id", "source_count": "expected_source_count"}).collect()] == ["source_count"]
    roots = spark.createDataFrame([(3999, "", None), (1, "x", "r")], "kind int, title string, parent string")
    assert receipts.single_root(roots).first()[0] and not receipts.single_root(roots.unionByName(roots)).first()[0]
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "title string, count int"), spark.createDataFrame([("y", 2), ("x", 1)], "title string, count int")
    assert set(receipts.normalized(a, ["title", "count"]).collect()) == set(receipts.normalized(b, ["title", "count"]).collect())
    ids, sha = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "uuid string"), lambda t: hashlib.sha256(t).hexdigest()
    assert tuple(receipts.distinct_lines_digest(ids).first()) == (sha(b"a\nb\n"), 2) and tuple(receipts.distinct_lines_digest(ids.limit(0)).first()) == (sha(b"\n"), 0)
    assert receipts.frozen_source(ids.limit(0), "x").first().identifier_sha256 == sha(b"")


def test_digests_are_folded_in_order(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, "a", "b", "é"]), rng.choice([1, 2]), f"{rng.randrange(10**6)}") for _ in range(3000)]
    small_batches(spark, 100)
    got = identity.lines_digests(spark.createDataFrame(rows, "g string, h int, id string").repartition(7), ["g", "h"], F.col("id")).collect()
    small_batches(spark)
    want = {(g, h): sorted(i for a, b, i in rows if (a, b) == (g, h)) for g, h, _ in rows}
    assert {(r.g, r.h): (r.digest, r.n) for r in got} == {k: (hashlib.sha256("".join(f"{i}\n" for i in v).encode()).hexdigest(), len(v)) for k, v in want.items()}


def test_digest_of_very_many_ids_needs_little_memory(spark):
    n = 10_000_000
    ids = spark.range(n, numPartitions=8).select(F.format_string("id-%08d", n - 1 - F.col("id")).alias("uuid"))
    plan = identity.lines_digests(ids, [], F.col("uuid"))
    assert "collect_list" not in plan._jdf.queryExecution().toString()
    whole = hashlib.sha256()
    for at in range(0, n, 100_000):
        whole.update("".join(f"id-{i:08d}\n" for i in range(at, at + 100_000)).encode())
    assert tuple(plan.first()) == (whole.hexdigest(), n)
    # what the fold holds beside the running hash is one batch
    seen = []
    rows = ids.repartition(1).sortWithinPartitions("uuid").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"]) for b in batches), "rows long, bytes long")
    seen = rows.agg(F.max("rows"), F.max("bytes"), F.sum("rows")).first()
    assert seen[0] <= 10_000 and seen[1] < 1 << 20 and seen[2] == n


def test_manifests_and_files(spark, tmp_path):
    schema = T.StructType([T.StructField("uuid", T.StringType()), T.StructField("n", T.IntegerType())])
    (tmp_path / "a.jsonl").write_text('{"uuid": "x", "n": 1}\n\n{"uuid": "x"}\nnot json\n{"n": 2}\n{"uuid": "z"}\n')
    got = [(r.record.uuid if r.record else None, r.reason) for r in io.read_jsonl_reasons(spark, str(tmp_path / "a.jsonl"), schema, "uuid").collect()]
    assert sorted(got, key=str) == sorted([("x", "uuid repeats"), ("x", "uuid repeats"), (None, "not valid JSON"), (None, "uuid is blank"), ("z", None)], key=str)
    (tmp_path / "b.csv").write_text("uuid,note\na,1\n")
    (tmp_path / "c.json").write_text('[{"uuid": "a"}, {"uuid": "b"}]')
    assert io.read_artifact(spark, str(tmp_path / "b.csv")).count() == 1 and io.read_artifact(spark, str(tmp_path / "c.json")).count() == 2
    assert io.read_artifact(spark, str(tmp_path / "none.json")) is None and io.read_artifact(spark, str(tmp_path / "x.txt")) is None
    left, right = spark.createDataFrame([("a", "1")], "uuid string, x string"), spark.createDataFrame([("b", 2)], "uuid string, y int")
    both = io.union_manifests(left, right)
    assert both.columns == ["uuid", "x", "y"] and sorted(map(tuple, both.collect())) == [("a", "1", ""), ("b", "", "2")]
    io.write_manifest(both, str(tmp_path / "out"), ["y", "uuid", "new"])
    assert io.read_manifest(spark, str(tmp_path / "out"), ("uuid",)).columns == ["y", "uuid", "new"]
    assert io.missing_columns(left, {"": ["uuid", "z"]}) == {"": ["z"]}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "f.bin").write_bytes(b"abc")
    row = io.file_digests(spark, str(tmp_path / "files")).first()
    assert row.digest == __import__("hashlib").sha256(b"abc").hexdigest() and row.path == str(tmp_path / "files" / "f.bin") and row["size"] == 3
    salt = tmp_path / "salt"
    salt.write_text("0123456789abcdef\n")
    os.chmod(salt, 0o600)
    assert io.read_salt(str(salt)) == b"0123456789abcdef"
    os.chmod(salt, 0o644)
    with pytest.raises(ValueError, match="owner"):
        io.read_salt(str(salt))


def test_requests_are_checked():
    good = {"target": 2, "views": [{"id": "a", "quota": 2}]}
    assert retrieval.check_request(good) == []
    for bad in ({"target": 3}, {"views": []}, {"candidate_multiplier": 0.5}, {"minimum_outside_prior_fraction": 0.5}, {"maximum_candidates_per_view": 1}, {"views": [{"id": "", "quota": 2}]}):
        assert retrieval.check_request(good | bad)
    assert len(list(itertools.chain(retrieval.request_terms({"views": [{"id": "a", "terms": ["X", "x", " "], "people": ["p"]}]})))) == 6


def test_members_are_written_once_and_exactly(spark, tmp_path):
    plan = spark.createDataFrame([("m", "a"), ("m", "b"), ("v", "a")], "album string, uuid string")
    path = str(tmp_path / "members")
    assert [library.write_members(p, path, ["album", "uuid"]) for p in (plan.limit(1), plan, plan)] == [1, 2, 0]
    with pytest.raises(ValueError, match="outside the plan"):
        library.write_members(plan.filter("album = 'm'"), path, ["album", "uuid"])


def test_private_files_reports_and_tables(spark, tmp_path):
    at = tmp_path / "deep" / "x.json"
    library.write_private(str(at), {"b": 1, "a": "é"})
    assert json.loads(at.read_text()) == {"b": 1, "a": "é"} and at.stat().st_mode & 0o777 == 0o600
    assert library.markdown("Run", {"row_count": 3, "by_view": {"a": 1}}) == "# Run\n\n- **Row Count:** 3\n## By View\n\n- `a`: 1\n\n"
    library.save_table(spark.range(20).withColumnRenamed("id", "uuid"), "kept_rows", ["uuid"], 2)
    joined = spark.table("kept_rows").join(spark.table("kept_rows").withColumnRenamed("uuid", "u"), F.col("uuid") == F.col("u")).hint("merge")
    assert joined.count() == 20


def test_resumed_inspections_keep_what_is_still_there(spark):
    done = spark.createDataFrame([("a", True, "/p/a"), ("a", True, "/p/a"), ("b", True, "/p/b"), ("c", False, None)], "asset_identifier string, preview_exported boolean, preview_path string")
    left = library.reusable(done, spark.createDataFrame([("/p/a",), ("/p/z",)], "path string"))
    assert sorted(r.asset_identifier for r in left.collect()) == ["a", "c"]


def test_evaluation_cases_are_checked(spark):
    long = "a sentence that is specific enough to be useful"
    good = (1, "one-case", long + " 1", long, long, "critical", "manual", ["t"], ["must refuse", "b", "c", "d"])
    bad = (0, "Two", "short", long, long, "odd", "magic", [], ["a"])
    twin = (1, "one-case", long + " 1", long, long, "critical", "manual", ["t"], ["a", "b", "c", "d"])
    schema = "id int, name string, prompt string, expected_output string, failure_mode string, severity string, oracle string, tags array<string>, expectations array<string>"
    check = lambda *rows: [r.errors for r in library.case_errors(spark.createDataFrame(list(rows), schema), ("manual",), "refuse|stop").collect()]
    assert check(good) == []
    assert check(bad) == [["id must be a positive number", "name must be a kebab-case label", "prompt must be a specific sentence", "unknown severity", "unknown oracle", "tags are missing", "needs 4 expectations"]]
    assert sorted(map(len, check(good, twin))) == [3, 4]


def test_terms_are_found_in_one_pass(spark):
    rng = random.Random(77)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 4))) for _ in range(60)] + ["A", "B", "", "  "]
    terms = {(rng.choice("vw"), rng.choice(["album", "keyword"]), w) for w in words}
    texts = [(f"u{i % 30}", rng.choice(["album", "keyword", "label"]), "".join(rng.choice("abABÉ x") for _ in range(rng.randrange(30)))) for i in range(200)] + [("n", "album", None), ("n", "keyword", ""), ("l", "album", "x" * 300_000 + "ab")]
    barred = ["xA", "bab", " "]
    got = term_hits(spark.createDataFrame(sorted(terms), "view string, channel string, term string"), spark.createDataFrame(texts, "uuid string, channel string, value string").repartition(4), barred, ["album"])
    out = lambda c, t: c == "album" and any(b in t for b in ("xa", "bab"))
    want = [(v, u, c, t) for v, c, t in {(v, c, t.lower()) for v, c, t in terms if t.strip()} for u, k, text in texts if k == c and text and t in text.lower() and not out(c, text.lower())]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300
    assert term_hits(spark.createDataFrame([], "view string, channel string, term string"), spark.createDataFrame(texts, "uuid string, channel string, value string")).isEmpty()


def test_catalogs_tell_their_columns(spark):
    spark.createDataFrame([(1, ["x"])], "b long, a array<string>").createOrReplaceTempView("some_view")
    spark.range(2).write.mode("overwrite").saveAsTable("some_table")
    rows = {(r.table, r.column): (r.position, r.type) for r in io.catalog_columns(spark).collect()}
    assert rows["some_view", "b"] == (0, "bigint") and rows["some_view", "a"] == (1, "array<string>") and rows["some_table", "id"] == (0, "bigint")
    spark.catalog.dropTempView("some_view")


def test_quotas_of_a_hot_view_are_cut_before_they_move(spark):
    rows = spark.range(1_000_000, numPartitions=8).select(F.format_string("%07d", "id").alias("uuid"), F.when(F.col("id") % 1000 == 0, "cold").otherwise("hot").alias("primary_view"), (F.col("id") * 7919 % 1_000_003).alias("score"))
    rule = {"views": [{"id": "hot", "quota": 40}, {"id": "cold", "quota": 5000}], "target_count": 3000}
    got = proposal.quota_take(rows, rule)
    views = dict(got.groupBy("primary_view").count().collect())
    assert views == {"hot": 2000, "cold": 1000}  # the top-up comes from the hot view
    best = Window.partitionBy("primary_view").orderBy(F.desc("score"), "uuid")
    plan = rows.withColumn("_n", F.row_number().over(best)).filter("_n <= 40")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial, where rows are read, and final
    top = {r.uuid for r in rows.filter("primary_view = 'hot'").orderBy(F.desc("score"), "uuid").limit(2000).collect()}
    assert {r.uuid for r in got.filter("primary_view = 'hot'").collect()} == top


RETRIEVED = "uuid string, is_photo boolean, hidden boolean, trashed boolean, favorite boolean, edited boolean, face_count int, year int, text string"


def test_retrieval_ranks_all_that_match(spark):
    liked = [(f"z{i}", True, False, False, True, True, 0, 2000, "boat") for i in range(4)]
    others = spark.range(12_050).selectExpr("concat('a', id) as uuid", "true as is_photo", "false as hidden", "false as trashed", "false as favorite", "false as edited", "0 as face_count", "2000 as year", "'red boat' as text")
    request = {"target": 4, "seed": 5, "candidate_multiplier": 1, "views": [{"id": "w", "quota": 4, "terms": ["red", "boat"]}]}
    relations = spark.createDataFrame([], "uuid string, channel string, value string")
    take = lambda **more: {r.uuid for r in retrieval.retrieve(others.unionByName(spark.createDataFrame(liked, RETRIEVED)), relations, request | more).collect()}
    assert take() == {"z0", "z1", "z2", "z3"}  # the least scores, the best with attention
    assert not take(maximum_candidates_per_view=12_000) & {"z0", "z1", "z2", "z3"}  # a limit that the request names


def test_retrieval_fills_up_from_all_that_are_not_taken(spark):
    assets = [(f"a{i}", True, False, False, True, True, 0, 2000, "boat") for i in range(8)] + [(f"b{i}", True, False, False, True, False, i, 2000, "tree") for i in range(5)]
    request = {"target": 10, "seed": 5, "candidate_multiplier": 1, "views": [{"id": "w", "quota": 10, "terms": ["boat"]}]}
    got = retrieval.retrieve(spark.createDataFrame(assets, RETRIEVED), spark.createDataFrame([], "uuid string, channel string, value string"), request)
    assert {r.uuid for r in got.collect()} == {*(f"a{i}" for i in range(8)), "b3", "b4"}
