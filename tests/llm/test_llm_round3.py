"""Source divergence, n-gram join and whitening on small hand-made tables, against plain versions."""

import collections
import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import prose, union, variants

from fieldsieve.llm import divergence, ngram_join, registry, whitening
from fieldsieve.llm.common import small_batches

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11 source divergence


def plain_audit(rows, least=10):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df, whole = collections.Counter(t for d in mine for t in set(d[2])), collections.Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        counts = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}

        def shares(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1000000000 * (count[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) * (p - q) // (p + q)
        p, q = {s: shares(c) for s, c in counts.items()}, shares(whole)
        for s in counts:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in counts if o != s))
            out += [(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t])[:10]
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)]
    return sorted(out)


def audit_rows():
    rng = random.Random(31)
    words = ["".join(rng.choice("abéß中") for _ in range(rng.randrange(1, 4))) for _ in range(60)]
    rows = []
    for i in range(300):
        source = rng.choice(["s1", "s2", "s3", "s3", "s3", "Ä", "", None])
        rows.append((rng.choice(["en", "en", "fr", None]), source, " ".join(rng.choice(words) for _ in range(rng.randrange(30))) + f" U{i} UP Up-up_a1b"))
    return rows + [("zz", "only", "one two"), ("zz", "other", None), ("yy", "alone", "x"), ("en", "s1", ""), ("en", "big", "word Word " * 50_000)] + rows[:20]


@pytest.mark.parametrize("cells,ranges", [(divergence.CELLS, divergence.GROUPS), (40, 2), (1, 1)])
def test_audit_equals_plain_version(spark, cells, ranges):
    rows = audit_rows()
    frame = spark.createDataFrame([(*r, "own") for r in rows], "lang string, source string, text string, term string").withColumn("block", F.lit(1)).repartition(5)
    got = divergence.audit(frame, cells=cells, ranges=ranges).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_audit(rows)


def test_audit_of_nothing_and_ties(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    rows = [("en", s, " ".join(f"{s}{x}" for x in "abcdefghijklmnopq")) for s in ("k", "l") for _ in range(12)]
    got = divergence.audit(spark.createDataFrame(rows, schema)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == plain_audit(rows) and sum(r.part == "term" for r in got) == 20


def test_shares_are_exact_for_large_counts():
    rng = random.Random(5)
    for _ in range(200):
        v, n = rng.randrange(1, 10**7), rng.randrange(10**15)
        count = rng.randrange(n + 1)
        assert divergence.share(np.array([[count]]), np.array([[n]]), v)[0, 0] == 1 + 10**9 * (count + 2) // (n + 2 * v)


# 12 n-gram join


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows):
    sets = [sets_of(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    tops = union(len(rows), near)
    out = collections.Counter()
    for (doc, _), s, top in zip(rows, sets, tops, strict=True):
        ids = [d for (d, _), t in zip(rows, tops, strict=True) if t == top and d is not None]
        out[(doc, len(s), min(ids) if ids and s else doc)] += 1
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = "".join(rng.choice("xyz") for _ in range(5))
    return " ".join(words)


def join_rows():
    rng = random.Random(41)
    texts = [t for _, t in variants(rng, 40, 60)]
    base, short = prose(rng, 400).split(), prose(rng, 30).split()
    texts += [edited(rng, base, k) for k in range(16) for _ in range(4)] + [edited(rng, short, k % 3) for k in range(20)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, rng.randrange(3, 20))} {passage} {prose(rng, rng.randrange(3, 20))}" for _ in range(60)]  # near the threshold, few linked
    texts += ["", None, " \t\n", "one", "ONE", "one two", "one two three", "one two three four", "two one", "É", "é", "a b", texts[0], texts[0].upper(), texts[5]]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(rows[0][0], rows[0][1]), (rows[0][0], "repeated id here now"), (None, texts[1]), (None, "no id at all here"), (None, None)]


def test_join_equals_plain_version(spark):
    rows = join_rows()
    small_batches(spark, 50)
    frame = spark.createDataFrame([(*r, b"own", 1) for r in rows], "doc_id long, text string, member binary, n long").repartition(6)
    got = ngram_join.join_components(frame)
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows)
    small_batches(spark)


def test_every_link_has_a_token_of_its_prefixes():
    rng = random.Random(43)
    ranks = np.array([rng.randrange(3) for _ in range(1 << 10)], np.uint8).repeat(1 << 12)
    words = prose(rng, 120).split()
    s, at = ngram_join.shingle_sets(pa.array([edited(rng, words[: rng.randrange(60, 120)], rng.randrange(4)) for _ in range(120)]))
    first, ends = ngram_join.prefixes(s, at, ranks)
    sets = [set(s[at[i] : at[i + 1]]) for i in range(120)]
    heads = [set(first[ends[i] : ends[i + 1]]) for i in range(120)]
    links = [(i, j) for i, j in itertools.combinations(range(120), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert len(links) > 50 and all(heads[i] & heads[j] for i, j in links)


def test_screen_drops_no_link():
    rng = random.Random(47)
    words, passed = prose(rng, 300).split(), 0
    s, at = ngram_join.shingle_sets(pa.array([edited(rng, words[: rng.choice([3, 40, 120, 140, 300])], rng.randrange(5)) for _ in range(150)] + ["x", "a b c d"]))
    bits = [np.frombuffer(v.as_buffer(), np.uint8) for v in ngram_join.parities(s, at)]
    sets = [set(s[at[i] : at[i + 1]]) for i in range(len(bits))]
    for i, j in itertools.combinations(range(len(bits)), 2):
        n, both = len(sets[i]) + len(sets[j]), len(sets[i] & sets[j])
        linked, may = 100 * both >= 85 * (n - both), ngram_join.may_link(bits[i], bits[j], n, 85)
        passed += may and not linked
        assert may or not linked
    assert passed < 600  # of 11,476


def test_groups_meet_on_one_token_of_many(spark):
    rows = [(b"a", 100, [1, 2, 3]), (b"b", 100, [1, 2, 3]), (b"c", 50, [3, 9]), (b"d", 300, [7]), (b"e", 100, [7])]
    got = ngram_join.group_pairs(spark.createDataFrame(rows, "grp binary, n long, prefix array<long>")).collect()
    tokens = collections.defaultdict(set)
    for r in got:
        tokens[r.token].add(bytes(r.grp))
    assert sorted(map(sorted, tokens.values())) == [[b"a", b"b"], [b"a", b"b"]]  # 1 or 2, and 3 without the small c; 7 has no two of like size


def test_join_of_nothing(spark):
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = ngram_join.join_components(spark.createDataFrame([(1, "long " * 200_000), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in one} == {(1, 1, 1), (2, 0, 2)}


# 13 whitening


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), y @ axes[:, :8] / np.sqrt(np.maximum(values[:8], 1e-300)), values[:8] / values.sum()


VECTORS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("dims", [3, 8, 100])
def test_whitening_equals_plain_version(spark, dims):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, dims)) @ rng.normal(size=(dims, dims))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(0, rows[0][1]), (None, rows[1][1])]
    bad = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan"), *rows[0][1][1:]]), (904, [float("-inf"), *rows[0][1][1:]]), (905, [1.0] * (dims + 1))]
    frame = spark.createDataFrame([(*r, 7) for r in rows + bad], VECTORS + ", n int").withColumn("x0", F.lit("own")).repartition(3)
    got = whitening.whiten(frame).toPandas()
    n, deviation, z, explained = plain_whitening([v for _, v in rows])
    k = min(8, dims)
    assert len(got) == n * k and (got["n"] == n).all() and sorted(map(int, got["deviation"])) == sorted(int(d) for d in deviation for _ in range(k))
    assert got["identity_error"].max() < 1e-6
    for c in range(k if n > dims else 8):
        mine = got[got["component"] == c + 1].dropna(subset=["vec_id"]).drop_duplicates(["vec_id"]).sort_values("vec_id")["whitened"].to_numpy()
        want = z[: len(mine), c]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-6
        assert np.allclose(got[got["component"] == c + 1]["explained"], explained[c])


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)).collect()
    assert len(same) == 4 and all(r.whitened is None and r.deviation == 0 and r.explained is None and r.identity_error is None for r in same)
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, 5.0]) for i in range(4)], VECTORS)).orderBy("vec_id", "component").collect()
    assert [r.whitened is None for r in line] == [False, True, True] * 4 and line[0].identity_error < 1e-9 and abs(line[0].explained - 1) < 1e-9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_return_their_contracts(spark):
    out = registry.QUERIES["op12_ngram_join"](spark, SF)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == plain_components(docs)
    white = registry.QUERIES["op13_whitening"](spark, SF)
    kinds = {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert kinds.items() <= dict(white.dtypes).items() and white.filter("deviation is null or deviation <> deviation_exact").isEmpty()


def test_prefixes_are_screened_before_they_move(spark):
    rng = random.Random(71)
    prefix = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(9))] for _ in range(300)]
    tokens = {v for p in prefix for v in p[:1]}
    bits = ngram_join.token_bits(spark.createDataFrame([(t,) for t in tokens], "token long"))
    rows = spark.createDataFrame([(bytes([i % 256, i // 256]), len(p), p) for i, p in enumerate(prefix)], "grp binary, n long, prefix array<long>")
    got = {r.grp: r.prefix for r in ngram_join.with_tokens(rows, spark.sparkContext.broadcast(bits)).collect()}
    assert got.keys() == {bytes([i % 256, i // 256]) for i, p in enumerate(prefix) if p}
    for i, p in enumerate(prefix):
        kept = got.get(bytes([i % 256, i // 256]), [])
        assert [v for v in kept if v in tokens] == [v for v in p if v in tokens] and set(kept) <= set(p)
    assert sum(map(len, got.values())) < len(tokens) + 5  # all of the prefixes moved before
