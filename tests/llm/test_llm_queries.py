"""The registered training-data queries: oracle SQL where there is some, and the pipeline against a plain version."""

import collections
import itertools
import os
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm_operators import prose, union, variants, words_of

import __spark_entry__ as entry
import corpus_pipeline
from fieldsieve.llm import mixing, near_dup, registry

SF = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert {*registry.QUERIES, "pipeline"} <= set(entry.queries()) and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = registry.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    shape = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shape(tuple(r) for r in got.select(*columns).collect()) == shape(want.fetchall())


def corpus():
    rng = random.Random(23)
    items = [(i, prose(rng, 20)) for i in range(5)]
    texts = [t for _, t in variants(rng, 30, 50)] + [None, "", "123 !?", "?"]
    texts += [f"{prose(rng, 10)} {items[i][1]} {prose(rng, 4)}" for i in range(5)]
    texts += [f"{prose(rng, 15)} token = {i}abcdef{i} end" for i in range(5)] + [texts[0], texts[0]]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows, items


def test_pipeline_equals_plain_version(spark, tmp_path):
    rows, items = corpus()
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    pq.write_table(pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    read, stages = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, read, str(tmp_path)).write.parquet(str(tmp_path / f"out{i}"))
        read = spark.read.parquet(str(tmp_path / f"out{i}"))
        stages.append(read)
    assert all(s.columns == names for s in stages[:-1])
    left = {r[0]: r for r in rows if any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in stages[0].collect()} == set(left)
    # near duplicates of what is left
    ids = sorted(left)
    s, at, w, _ = near_dup.weighted_shingles(pa.array([left[i][1] for i in ids]), near_dup.shingle_idf(stages[0]))
    sets = [(s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(ids))]
    tops = union(len(ids), [(i, j) for i, j in itertools.combinations(range(len(ids)), 2) if near_dup.jaccard(sets[i], sets[j]) >= 0.8])
    left = {i: left[i] for i, t in zip(ids, tops, strict=True) if ids[t] == i}
    assert {r.doc_id for r in stages[1].collect()} == set(left)
    # benchmark items stand in the texts word for word
    held = {d for d, r in left.items() for _, t in items if f" {' '.join(words_of(t))} " in f" {' '.join(words_of(r[1]))} "}
    assert len(held) == 5 and {r.doc_id for r in stages[2].collect()} == set(left) - held
    clean = {d: re.sub(r"token = (\d)abcdef\1", "[SECRET]", r[1]) for d, r in left.items() if d not in held}
    assert {r.doc_id: r.text for r in stages[3].collect()} == clean
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())
    mixed, size = stages[4].collect(), lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert all(r["size"] == size(clean[r.doc_id]) and r.taken == r.copies * r["size"] and 0 < r.copies <= 3 for r in mixed)
    total = collections.Counter()
    for r in mixed:
        total[r.source] += r.taken
    goals = {r.source: r.target for r in stages[4].select("source", "target").distinct().collect()}
    assert all(abs(total[s] - g) <= 60 for s, g in goals.items()) and abs(sum(goals.values()) - sum(map(size, clean.values()))) < 1
    assert stages[4].columns == [*names, "size", "source_size", "target", "taken", "copies"]
    by_id = {r[0]: r for r in rows}
    assert all(r.text == clean[r.doc_id] and r.source == by_id[r.doc_id][3] and r.n_chars == len(r.text) and r.lang for r in mixed)
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in again.select("doc_id", "text").collect()) == sorted((r.doc_id, r.text) for r in mixed)
    assert again.select(F.count("*"), F.sum("taken"), F.sum(F.xxhash64("doc_id") % 1000003)).first() == stages[4].select(F.count("*"), F.sum("taken"), F.sum(F.xxhash64("doc_id") % 1000003)).first()


def test_stages_take_clashing_columns_and_empty_tables(spark, tmp_path):
    rows, items = corpus()
    pq.write_table(pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}), tmp_path / "benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for frame in (spark.createDataFrame(rows[:12], schema), spark.createDataFrame([], schema)):
        wide = frame.withColumns({n: F.lit("own") for n in ("score", "lang_pred", "far", "row", "secrets", "_rules", "node", "class_id", "keep", "size", "target", "taken", "_q")})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, wide, str(tmp_path))
            assert out.columns == wide.columns and {r.score for r in out.select("score").collect()} <= {"own"}
        mixed = corpus_pipeline.mixture(spark, wide, str(tmp_path))
        added = ["size", "source_size", "target", "taken", "copies"]
        assert mixed.columns == [*[c for c in wide.columns if c not in added], *added] and (mixed.count() > 0) == (frame.count() > 0)
        assert {r.score for r in mixed.select("score").collect()} <= {"own"} and mixed.filter("taken not in (size * copies)").isEmpty()


def test_the_mix_tells_equal_rows_apart(spark):
    rows = [(1, "same words here now", "a", i) for i in range(40)] + [(None, "no id at all", None, i) for i in range(30)] + [(2, None, "a", 0), (3, "b c", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(5)
    got = mixing.mixed_rows(docs).collect()
    assert len({(r.doc_id, r.n) for r in got}) == len(got) and {(r.doc_id, r.text, r.source, r.n) for r in got} <= set(rows)
    want = mixing.mix(docs).filter("taken > 0").groupBy("source").agg(F.sum("taken")).collect()
    total = collections.Counter()
    for r in got:
        total[r.source] += r.taken
    assert total == dict(map(tuple, want))


def test_texts_far_from_every_profile_go(spark, tmp_path):
    rng = random.Random(59)
    make = lambda: " ".join("".join(rng.choice("the and of with er th".split()) for _ in range(rng.randrange(1, 4))) for _ in range(30))
    rows = [(i, make(), "en") for i in range(100)] + [(200, "жщ" * 60 + " ъэ", None), (201, "qqq xxxj zzkq " * 20, None), (202, "with the", None)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert {(r.doc_id, r.lang) for r in out.collect()} == {*((i, "en") for i in range(100)), (202, "en")}


def test_documents_without_labels_stay(spark, tmp_path):
    rows = [(1, "some words", None), (2, "é", None), (3, "12 !?", None), (4, None, None), (5, "", None)]
    out = corpus_pipeline.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang"] and {r.doc_id for r in out.collect()} == {1, 2}
