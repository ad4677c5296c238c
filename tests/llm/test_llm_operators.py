"""The training-data operators on small hand-made tables, against plain versions."""

import collections
import hashlib
import itertools
import json
import os
import random
import re
import tracemalloc
import zlib
from html import unescape
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldsieve.llm import audio, chat, decontaminate, html_diff, langid, lsh, mixing, near_dup, paragraphs, secrets, suffixes
from fieldsieve.llm import textkit as tk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


# hashing


def test_word_hashes_follow_words():
    rng = random.Random(1)
    texts = [None, "", " ", "A", "b a", "x" * 100_000, "é " * 40_000, *["".join(rng.choice("ab c.é\n") for _ in range(rng.randrange(50))) for _ in range(200)]]
    h, bounds, _, _ = tk.words(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        mine = h[bounds[i] : bounds[i + 1]]
        assert len(mine) == len(words_of(t))
        assert all(seen.setdefault(w, x) == x for w, x in zip(words_of(t), mine, strict=True))
    assert len(set(seen.values())) == len(seen)


# 1 audio


def test_wav_round_trip_and_features(spark):
    texts = [None, "", "a", "x" * 64, "x" * 65, "é" * 5000, "same", "same"]
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, extra string").withColumn("_t", F.col("text").cast("binary"))
    got = audio.audio_features(audio.store_wav(rows, F.col("_t")).drop("_t")).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        body = (t or "").encode()
        body += bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.extra) == (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), "mine")
        tensors = audio.read_tensors(r.tensors)
        assert tensors.schema.field("logmel").type.shape == [audio.PATCH, audio.MELS] and tensors.num_rows == -(-r.n_frames // audio.PATCH)
        assert tensors["start_s"].to_pylist() == sorted(tensors["start_s"].to_pylist())
    assert got[6].tensors == got[7].tensors


def test_resampling_matches_direct_filter_in_any_block():
    x = np.random.default_rng(0).integers(0, 256, 1000).astype(np.uint8)
    for up, down in ((1, 2), (2, 3), (3, 2)):
        h = audio.sinc_filter(up, down)
        wide = np.zeros(len(x) * up)
        wide[::up] = x.astype(float) - 128
        want = np.convolve(wide, h)[::down][: len(x) * up // down]
        whole = audio.resample(x, 0, len(want), h, up, down)
        parts = np.concatenate([audio.resample(x, a, min(a + 37, len(want)), h, up, down) for a in range(0, len(want), 37)])
        assert np.allclose(whole, want, atol=1e-2) and np.allclose(whole, parts, atol=1e-3)


def test_log_mel_energy_and_patches_equal_a_plain_version(monkeypatch):
    monkeypatch.setattr(audio, "BLOCK", 7)
    rng, h, rate = np.random.default_rng(4), audio.sinc_filter(audio.UP, audio.DOWN), audio.RATE * audio.UP / audio.DOWN
    bank = audio.mel_filterbank(rate)
    assert bank.shape == (129, audio.MELS) and (bank.max(axis=0) > 0).all() and (np.diff(bank.argmax(axis=0)) >= 0).all()
    for size in (64, 640, 6400):
        samples = rng.integers(0, 256, size).astype(np.uint8)
        wide = np.zeros(size * audio.UP)
        wide[:: audio.UP] = samples.astype(float) - 128
        total = -(-size * audio.UP // audio.DOWN)
        x = np.convolve(wide, h)[:: audio.DOWN][:total]
        frames = max(1, -(-total // audio.HOP))
        x = np.concatenate([x, np.zeros(frames * audio.HOP + audio.WINDOW - len(x))])
        k = np.arange(audio.WINDOW)
        taper, turn = 0.5 - 0.5 * np.cos(2 * np.pi * k / audio.WINDOW), np.exp(-2j * np.pi * np.outer(np.arange(audio.WINDOW // 2 + 1), k) / audio.WINDOW)
        mel, energy = audio.log_mel(samples, h, bank)
        assert mel.shape == (frames, audio.MELS)
        for i in range(frames):
            frame = x[i * audio.HOP : i * audio.HOP + audio.WINDOW] * taper
            assert energy[i] == pytest.approx(10 * np.log10((frame**2).mean() + 1e-6), abs=1e-2)
            assert np.allclose(mel[i], np.log((np.abs(turn @ frame) ** 2) @ bank + 1e-3), atol=1e-2)
        tensors = audio.read_tensors(audio.tensor_stream(mel))
        patches = np.concatenate([np.array(p.as_py()).reshape(-1, audio.MELS) for p in tensors["logmel"].combine_chunks().storage])
        assert np.array_equal(patches[:frames].astype(np.float32), mel) and not patches[frames:].any()
        second = audio.HOP / rate
        assert np.allclose(tensors["start_s"], np.arange(tensors.num_rows) * audio.PATCH * second) and tensors["end_s"][-1].as_py() == pytest.approx(frames * second)


def test_audio_of_clashing_and_empty_tables(spark):
    wide = spark.createDataFrame([(1, "abc", "own", "own", "own")], "doc_id long, text string, media string, _padded string, n_frames string")
    for frame in (wide, wide.limit(0)):
        out = audio.audio_features(audio.store_wav(frame, F.col("text").cast("binary")))
        assert {r._padded for r in out.collect()} <= {"own"} and out.count() == frame.count()


def test_hysteresis_keeps_runs_that_reach_the_upper_threshold():
    energy = np.array([0, 0, 0.2, 0.7, 0.2, 0, 0.3, 0.3, 0, 0, 0], float)
    assert audio.hysteresis(energy).tolist() == [[2, 5]]


# 2 suffixes


def brute_removed(rows):
    first = {}
    for d, t in rows:
        b, k = (t or "").encode(), d if d is not None else 1 << 63
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(k, first.get(b[i : i + 50], k))
    out = []
    for d, t in rows:
        b, k = (t or "").encode(), d if d is not None else 1 << 63
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i : i + 50] = b"\1" * 50
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", gone)), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 2])
def test_suffix_dedup_equals_brute_force(spark, crowd):
    rng = random.Random(5)
    base = prose(rng, 90)
    rows = [(None, "a" * 200), (3, "a" * 120), (1, "ab" * 80), (2, "ab" * 100), (2, "x" + "ab" * 90), (5, None), (6, ""), (7, "a" * 49), (8, base), (8, base)]
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(len(t))] = rng.choice("xyzé")
        rows.append((rng.randrange(40), "".join(t)[rng.randrange(300) :] + base[: rng.randrange(200)]))
    got = suffixes.dedup(docs(spark, rows), crowd).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_removed(rows)
    assert suffixes.dedup(docs(spark, [])).count() == 0


# 3 mixing


def test_suffixes_are_ordered_by_bytes_digit_by_digit():
    rng = random.Random(43)
    text = "".join(rng.choice("ab") for _ in range(400)) + prose(rng, 60) * 2
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(len(data) - suffixes.DEPTH + 1)
    own = np.array([rng.randrange(5) for _ in at])
    live, new = suffixes.radix_groups(data, at, own, np.zeros(len(at), np.int64))
    strings = collections.defaultdict(list)
    for i in at.tolist():
        strings[data[i : i + suffixes.DEPTH].tobytes()].append(i)
    want = [sorted(v) for k, v in sorted(strings.items()) if len({int(own[i]) for i in v}) > 1]
    assert [sorted(x.tolist()) for x in np.split(live, np.flatnonzero(new)[1:])] == want and len(want) > 100


def test_suffix_runs_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "string_hashes", lambda h, at: np.zeros(len(at), np.uint64))
    monkeypatch.setattr(suffixes, "anchors", lambda h, begin: np.zeros(len(begin), np.uint64))
    texts = [b"a" * 50, b"b" * 50, b"a" * 50]
    part = {"doc": np.arange(3).astype(np.uint64), "pos": np.zeros(3, np.uint64), "n": np.ones(3, np.uint64)}
    spans = [r for b in suffixes.raw_pass(part, np.arange(3), np.arange(3), np.frombuffer(b"".join(texts), np.uint8)) for r in b.to_pylist()]
    assert [r["doc"] for r in spans] == [2]


def test_hot_anchors_are_cut_before_they_are_held():
    rng, common = random.Random(47), "once upon a midnight dreary while i "
    texts = [prose(rng, 12) + " " + common + prose(rng, 12) for _ in range(3000)]
    data, offsets = tk.utf8(pa.array(texts))
    part = suffixes.runs(data, offsets)
    buffer = suffixes.Buffer(6)
    held = [*buffer.add(part, np.arange(3000), np.arange(3000)), *buffer.send()]
    digits, runs_of = np.unique(part["digit"], return_counts=True)
    hot = digits[runs_of > 500]
    sent = np.concatenate([suffixes.unpack(x)[0]["digit"] for b in held for x in b.column("blob").to_pylist() if x])
    assert len(hot) and all((sent == d).sum() <= 2 for d in hot)  # of a shared anchor, two places leave the task
    begin = offsets[part["doc"]] + part["pos"]
    _, cut, digit = suffixes.cut_crowded(suffixes.gram_hashes(data), begin, part, part["digit"], hot)
    assert cut["n"].sum() == part["n"].sum() and np.unique(digit[~np.isin(digit, digits)], return_counts=True)[1].max() < runs_of.max()


def test_places_and_texts_travel_small(spark):
    rng = random.Random(53)
    texts = [prose(rng, 500) for _ in range(600)]
    part = suffixes.runs(*tk.utf8(pa.array(texts)))
    buffer = suffixes.Buffer(11)  # as over some gigabytes: few records in a blob
    held = [*buffer.add(part, 10_000_000 + np.arange(600), np.zeros(600, np.int64)), *buffer.send()]
    blobs = [x for b in held for x in b.column("blob").to_pylist() if x]
    records = sum(len(suffixes.unpack(x)[0]["doc"]) for x in blobs)
    assert records > 30_000 and sum(map(len, blobs)) < 16 * records  # 34.8 bytes each before, 11.0 now
    rows = suffixes.named(docs(spark, [(i, t) for i, t in enumerate(texts)]).selectExpr("doc_id as doc", "xxhash64(text) as key", "text", "false as none"))
    packed = rows.mapInArrow(suffixes.packed_texts, suffixes.PACKED).collect()
    assert {r.key for r in packed} == {0} and sum(len(r.packed) for r in packed) < 0.75 * sum(map(len, texts))
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in sorted(packed, key=lambda r: r.doc)])
    again = [bytes(data[a:b]).decode() for _, data, at in suffixes.unpacked([batch]) for a, b in itertools.pairwise(at)]
    assert again == texts


def raw_runs(texts):
    """Texts of ids from 0 on, as the runs that a task packs: bytes, where runs begin, records, ids."""
    data, offsets = tk.utf8(pa.array(texts))
    part = suffixes.runs(data, offsets)
    return data, offsets[part["doc"]] + part["pos"], {c: part[c].astype(np.int64) for c in ("doc", "pos", "n")}, np.arange(len(texts))


def traced(rows):
    """The most bytes that were held while these were made, each let go of."""
    tracemalloc.start()
    collections.deque(rows, maxlen=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak


def test_suffix_tasks_hold_little_beside_their_records():
    n = 600_000
    buffer = suffixes.Buffer(11)
    held = list(buffer.add({"digit": suffixes.digits(np.arange(n).astype(np.uint64)), "doc": np.arange(n) // 600, "pos": np.arange(n) % 600, "n": np.full(n, 9)}, np.arange(1000), np.zeros(1000, np.int64)))
    suffixes.sent(np.arange(1), blob=[b""])  # what Arrow imports at first
    assert not held and traced(buffer.send()) < 50 * n  # 87 bytes a record before, 26 now
    rng = random.Random(59)
    texts = [prose(rng, 300) for _ in range(1000)]
    data, begin, part, ids = raw_runs(texts + ["".join(c if i % 90 else "#" for i, c in enumerate(t)) for t in texts])
    whole, _ = suffixes.gathered(data, begin, part["n"] + suffixes.DEPTH - 1)
    assert traced(suffixes.raw_pass(part, ids, ids, whole)) < 40 * part["n"].sum()  # 68 bytes a suffix before, and growing with their number


def test_suffix_shares_change_no_result(monkeypatch):
    rng = random.Random(61)
    base = prose(rng, 300)
    data, begin, part, ids = raw_runs([base[rng.randrange(400) :] + prose(rng, 5) + base[: rng.randrange(300)] for _ in range(60)])
    whole, _ = suffixes.gathered(data, begin, part["n"] + suffixes.DEPTH - 1)
    h = suffixes.gram_hashes(data)
    digit = suffixes.anchors(h, begin)
    some, counts = np.unique(digit, return_counts=True)
    crowded = some[counts > 40]

    def results():
        spans = {tuple(r.values()) for b in suffixes.raw_pass(part, ids, ids, whole) for r in b.to_pylist()}
        raws = [(k, x) for b in suffixes.raw_blobs(data, begin, part, ids, ids, 6, crowded) for k, x in zip(b.column("bucket").to_pylist(), b.column("raw").to_pylist(), strict=True) if x]
        read = [(k, suffixes.unpack(x, suffixes.RAW_WIDTHS)) for k, x in raws]
        return spans, sorted((k, int(ids[int(d)]), int(p), int(n)) for k, (records, ids, _, _) in read for d, p, n in zip(records["doc"], records["pos"], records["n"], strict=True)), sorted((k, len(text)) for k, (*_, text) in read)

    want = results()
    at, cut, new = suffixes.cut_all(data, begin, part, digit, crowded)
    _, plain, plainly = suffixes.cut_crowded(h, begin, part, digit, crowded)
    rows = lambda p, d: sorted(zip(p["doc"].tolist(), p["pos"].tolist(), p["n"].tolist(), d.tolist(), strict=True))
    assert len(crowded) and len(want[0]) > 100 and rows(cut, new) == rows(plain, plainly)
    first = dict(zip(part["doc"].tolist(), (begin - part["pos"]).tolist(), strict=True))  # where each text begins
    assert at.tolist() == [first[d] + p for d, p in zip(cut["doc"].tolist(), cut["pos"].tolist(), strict=True)]
    monkeypatch.setattr(suffixes, "SHARE", 300)
    monkeypatch.setattr(suffixes, "SUFFIXES", 50)
    assert results() == want


def test_texts_under_one_id_are_told_apart_whatever_their_number(spark):
    rows = [(i // 2, f"text {i}") for i in range(10)] + [(7, "same"), (7, "same"), (8, "one")]
    df = docs(spark, rows).selectExpr("doc_id as doc", "xxhash64(text) as key", "text")
    for few, whole in ((4, 13), (5, 10)):  # rows whose key is their text's
        got = suffixes.named(df, few).collect()
        assert len(got) == 13 and sum(r.key != 0 for r in got) == whole
        assert len({(r.doc, r.key) for r in got}) == 12


# 3 mixing


def test_mixing_targets_and_samples(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice(["a", "b", "c", None])) for i in range(600)] + [(None, None, "d"), (700, "", "d"), (701, "one two", "d"), (701, "one two", "d")]
    df = docs(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, total, fixed = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:  # the excess is shared out again until none is over
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        fixed |= over
    want = fixed | share
    assert len(got) == len(rows)
    for s, part in got.groupby(got.source.fillna("~")):
        name = None if s == "~" else s
        assert part["target"].iloc[0] == pytest.approx(want[name]) and part["source_size"].iloc[0] == sizes[name]
        assert abs(part["taken"].sum() - want[name]) <= max(60, 0.02 * want[name])
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixing.mix(df).toPandas()
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, again.values.tolist()))
    assert mixing.mix(docs(spark, [], "doc_id long, text string, source string")).count() == 0


def test_mixing_takes_some_of_equal_rows_and_more_of_long_documents(spark):
    rng = random.Random(41)
    rows = [(None, prose(rng, 20), "e") for _ in range(300)] + [(7, prose(rng, 25), "b") for _ in range(300)] + [(1000 + i, prose(rng, rng.randrange(5, 60)), "b") for i in range(700)]
    rows += [(5000 + i, prose(rng, rng.randrange(1, 80)), "c") for i in range(400)] + [(8000, "", "f"), (8001, None, "f")]
    got = mixing.mix(docs(spark, [(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size long, _q long")).toPandas()
    assert list(got.columns) == ["doc_id", "source", "size", "source_size", "target", "taken"] and len(got) == len(rows)
    for s, part in got.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= (25 if s != "f" else 0), s
    assert (got["taken"] <= 3 * got["size"]).all() and got[got.doc_id.isna()]["taken"].nunique() == 2  # one group of equal rows, split by the cut
    part = got[got.source == "c"].assign(copies=lambda x: x["taken"] / x["size"])
    short, long = part[part["size"] < 20]["copies"].mean(), part[part["size"] > 60]["copies"].mean()
    assert short + 0.1 < long  # inclusion probabilities differ by document


# 4 pages


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("cells", [1 << 28, 12])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html_diff, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(14))] for _ in range(2))
        found = sorted(html_diff.shared(a, b))
        rest = iter(b)
        assert len(found) == lcs(a, b) and all(any(x == y for y in rest) for x in (a[i] for i in found))


def test_pages_lose_template_and_keep_articles(spark):
    plain = "<html><head><title>t</title><style>p{}</style></head><body><p>Welcome to our site<p>{}<div>Call us now</div><script>var x='</p>';</script></body>"
    rows = [(i, f"https://h.example/a/{i}", plain.replace("{}", f"Story {i} of&nbsp;many &amp; more")) for i in range(400)]
    art = '<body><nav>menu</nav><header>top</header><article><h1>T</h1><p>A <b>b</b>old\n move<br>next</p><aside>see also</aside><div class="comments">rant</div><form>f</form><p>Shared</article><footer>foot</footer>'
    rows += [(1000, "https://m.example/x/1", art), (1001, "https://m.example/x/2", art), (1002, None, None), (1003, "http://one.example/", "<p>alone<p>two"), (1003, "http://one.example/", "<p>alone<p>two")]
    got = collections.defaultdict(list)
    for r in html_diff.extract(docs(spark, rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
    assert all(got[i] == [f"Story {i} of many & more"] for i in range(400))
    assert got[1000] == got[1001] == ["T A bold move next Shared"] and got[1002] == [""] and len(got[1003]) == 2
    assert html_diff.extract(docs(spark, [], "page_id long, url string, html string")).count() == 0


def test_markup_names_what_is_not_the_article():
    page = '<div class="page with-sidebar"><main><p>crumbs</p><article class="post"><header><h1>T</h1></header><p>Body</p><div class="social-history notice-board">Kept</div></article><article class="comment"><p>rant</p></article></main><div id="cookie-notice">ok?</div></div>'
    assert html_diff.main_text(html_diff.page_lines(page), [], []) == "T Body Kept"
    assert html_diff.main_text(html_diff.page_lines("<div role=main><p>One<p>Two</div><p>out"), [], []) == "One Two"
    assert html_diff.main_text(html_diff.page_lines('<p>x</p><div style="display:none">y</div><p hidden>z'), [], []) == "x"


def plain_blocks(html):
    """(text, level) of the blocks of a well-formed page, by another parser than the operator's."""
    blocks, parts = [], []

    def flush(level):
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append((text, level))

    def walk(node, level):
        mine = -1 if level < 0 or node.tag in ("nav", "footer") or node.get("class") == "ad" else 2 if node.tag == "article" else max(level, 1) if node.tag == "main" else level
        block = node.tag not in ("b", "i", "root")
        if block:
            flush(level)
        parts.append(node.text or "")
        for child in node:
            walk(child, mine)
            parts.append(child.tail or "")
        if block:
            flush(mine)

    walk(ElementTree.fromstring(f"<root>{html}</root>"), 0)
    flush(0)
    return blocks


def plain_lcs(a, b):
    """Positions of a in a longest common subsequence, by the plain table."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    found = set()
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def plain_extract(rows):
    """The same rules by the plainest means: for each page all others of its host, in order."""
    parts = [(re.match(r"[a-z]+://([^/?#]*)([^?#]*)", u or "") or re.match("()()", "")).groups() for _, u, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (parts[i], rows[i][0]))
    lines, out = [plain_blocks(rows[i][2]) for i in order], []
    for k, i in enumerate(order):
        mine, top = lines[k], max((x for _, x in lines[k]), default=0)
        found, around = [], []
        for step in (-1, 1):
            near = [j for j in range(k + step, k + step * (html_diff.REACH + 1), step) if 0 <= j < len(order) and parts[order[j]][0] == parts[i][0]]
            around += near
            for j in near:
                common = plain_lcs([x for x, _ in mine], [x for x, _ in lines[j]])
                size = sum(len(x) for x, own in mine if own >= min(1, top))
                if mine != lines[j] and sum(len(mine[c][0]) for c in common if mine[c][1] >= min(1, top)) < (0.5 if top else 0.9) * size:
                    found.append(common)
                    break
        both = {c for c in set.intersection(*found) if all(mine[c][0] in [x for x, _ in lines[j]] for j in around)} if len(found) == 2 else set()
        gone = lambda c, own: c in (both if top and own == top else set().union(*found))
        out.append((rows[i][0], " ".join(x for c, (x, own) in enumerate(mine) if own >= min(1, top) and not gone(c, own))))
    return sorted(out)


def test_open_elements_end_where_others_begin(spark):
    texts = {
        '<article><p class="ad">Buy now<p>Real text one<p>Real two</article>': "Real text one Real two", "<article><ul><li class=comment>bad<li>good one<li>good <b>two</ul></article>": "good one good two",
        '<main><p>Main story</p><article class="card"><p>Teaser</p></article><p>More</p></main>': "Main story Teaser More", '<table><tr><td class="ad">ad<td>cell<tr><td>two</table><p>x<div>y</div>': "cell two x y",
        '<dl><dt class="ad">a<dd>b<dt>c</dl><nav>menu<p>more</nav>z': "b c z", "<ul><li>one<ul><li>two</ul>still one<li>three</ul>": "one two still one three", "<nav>menu</nav>": "", "<p hidden>no<p>yes<script>var a = '<p>';</script>": "yes", "<article><p>open": "open",
    }
    rows = [(i, f"https://h{i}.example/", html) for i, html in enumerate(texts)]
    assert [r.text for r in html_diff.extract(docs(spark, rows, "page_id long, url string, html string")).orderBy("page_id").collect()] == list(texts.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pages_give_their_whole_articles(spark):
    pages, wrong = spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), 0
    for r in html_diff.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.sub("<!--.*?-->", "", re.search("<article>(.*)</article>", r.html, re.S)[1], flags=re.S)
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1|ul|li|br|div)[^>]*>", article))
        wrong += r.text != " ".join(x for x in blocks if x)
    assert wrong == 0


@pytest.mark.parametrize("article", ["article", "div"])
def test_extraction_equals_a_plain_version(spark, article):
    rng = random.Random(53)
    rows = []
    for i in range(500):
        host, stock = rng.choice(["a.example", "b.example", "c.example"]), ["Read more here", "Share this page", prose(random.Random(i % 7), 9)]
        body = [prose(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(1, 6))]
        blocks = [stock[0], *body[:2], stock[1], *body[2:], rng.choice(stock)]
        html = f"<nav>menu</nav><p>Top of {host}</p><{article}>" + "".join(f"<p>{x}</p>" for x in blocks) + f"</{article}><p>Bottom</p><div class='ad'>buy</div>"
        rows.append((i, f"https://{host}/{rng.randrange(40)}/{i}", html))
        if rng.random() < 0.2:  # mirrors
            rows += [(1000 + i, f"https://{host}/{rng.randrange(40)}/{i}", html)] + [(2000 + i * 20 + j, rows[-1][1], html) for j in range(rng.choice([0, 0, 12]))]
    frame = docs(spark, [(*r, 1) for r in rows], "page_id long, url string, html string, at int")
    got = html_diff.extract(frame)
    assert got.columns == ["page_id", "url", "at", "text"]
    texts = [(r.page_id, r.text) for r in got.collect()]
    words = lambda rows: [(i, sorted(t.split())) for i, t in sorted(rows)]  # noqa: E731  of a line that stands twice, either may be the shared one
    assert words(texts) == words(plain_extract(rows))
    deleted = sum("Share this page" not in t for _, t in texts)
    assert deleted > len(rows) / 3 and all(t for _, t in texts)  # differencing decides, and mirrors keep their text


# 5 benchmark


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([12, 20, 33]))) for i in range(30)] + [(90, None), (91, ""), (92, "two words"), (3, prose(rng, 15))]
    rows = []
    for i in range(120):
        body = prose(rng, rng.randrange(80))
        if i % 3 == 0:
            part = rng.choice(items[:30])[1].split()
            if i % 2:
                part[-1] = "changed"
            body += " " + " ".join(part).upper() + " " + prose(rng, 5)
        rows.append((i, body))
    rows += [(None, None), (500, ""), (501, "here are two words in it")]
    grams = lambda w, k: collections.Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
    want = set()
    for d, t in rows:
        w = words_of(t)
        for item, text in items:
            v = words_of(text)
            if v:
                k = min(5, len(v))
                g = grams(v, k)
                best = max((sum((grams(w[i : i + len(v)], k) & g).values()) / sum((grams(w[i : i + len(v)], k) | g).values()) for i in range(len(w) - len(v) + 1)), default=0)
                if best >= 0.8:
                    want.add((d, item, round(best, 9)))
    frames = docs(spark, rows), docs(spark, items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.hits(*frames).collect()} == want and len(want) > 30
    left = {r.doc_id for r in decontaminate.clean(*frames).collect()}
    assert left == {d for d, _ in rows} - {d for d, _, _ in want}


def test_texts_shorter_than_an_item_are_compared_whole(spark):
    words = prose(random.Random(31), 59).split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    rows = [(0, " ".join(words)), (1, " ".join(words[:-1])), (2, " ".join(words[4:-4])), (3, " ".join(words[:40])), (4, words[0])]
    got = {r.doc_id: (r.word_start, r.n_words, round(r.similarity, 9)) for r in decontaminate.hits(docs(spark, rows), items).collect()}
    assert got == {0: (0, 59, 1.0), 1: (0, 58, round(54 / 55, 9)), 2: (0, 51, round(47 / 55, 9))}


def test_blocks_guarantee_all_fingerprints_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**63, 200).astype(np.uint64) * np.uint64(2)
    blocks = decontaminate.Blocks(prints)
    near = prints.copy()
    for i in range(len(near)):
        near[i] ^= np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, decontaminate.RADIUS, replace=False).astype(np.uint64))
    mine, own, distance = blocks.near(near)
    assert {(i, i) for i in range(200)} <= set(zip(mine.tolist(), own.tolist(), strict=True))
    want = np.argwhere(np.bitwise_count(near[:, None] ^ prints) <= decontaminate.RADIUS)
    assert sorted(zip(mine.tolist(), own.tolist(), strict=True)) == sorted(map(tuple, want.tolist())) and (distance <= decontaminate.RADIUS).all()
    far = rng.integers(0, 2**63, 500).astype(np.uint64)
    assert len(blocks.candidates(far)[0]) < 0.1 * len(far) * len(prints)  # the blocks select


def test_windows_at_the_threshold_lie_within_the_radius():
    rng, found, n = np.random.default_rng(5), 0, 400
    for _ in range(n):
        size = int(rng.integers(12, 200))
        item = rng.integers(0, 2**63, size).astype(np.uint64)
        near, k = item.copy(), int(size / 9)  # as many changed as leave a similarity of 0.8
        near[rng.choice(size, k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
        blocks = decontaminate.Blocks(decontaminate.simhash(decontaminate.signs(tk.mix(item)).sum(axis=0, dtype=np.int64)[None]))
        found += len(blocks.near(decontaminate.simhash(decontaminate.signs(tk.mix(near)).sum(axis=0, dtype=np.int64)[None]))[0])
    assert found >= 0.98 * n


# 6 chat


def test_chat_round_trip_and_mask(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\e<b>[c]"), (1, 1, "assistant", "again"), (1, 2, None, None), (2, None, "assistant", ""), (None, 5, "user", "x"), (None, 6, "assistant", "y")]
    turns = chat.thread(docs(spark, rows, "conv_id long, turn long, role string, text string"))
    paths = chat.reply_paths(turns.select("id", "parent", F.lit(1.0).alias("score"))).join(turns.select("id", "role", "text"), "id")
    out = chat.format_paths(paths.select(F.col("root.conv_id").alias("path"), "step", "role", "text"))
    got = {r.path: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\e<b>[c]"), ("assistant", "again"), ("", "")]
    assert got[1].loss == "a\\e<b>[c]again" and got[2].loss == "" and got[None].n_turns == 2 and got[None].loss == "y"


def test_chat_takes_empty_tables_long_texts_and_other_columns(spark):
    none = spark.createDataFrame([], "id long, parent long, score double")
    assert chat.reply_paths(none).count() == 0
    assert chat.format_paths(spark.createDataFrame([], "path long, step long, role string, text string")).count() == 0
    long = "[x]<y>\\ é" * 60_000
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", long if i == 1 else f"turn {i}", "own", "own") for i in range(300)] + [(None, 0, "user", "no id", "own", "own"), (None, 1, "assistant", None, "own", "own")]
    turns = chat.thread(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, root string"))
    paths = chat.reply_paths(turns.select("id", "parent", F.lit(1.0).alias("score"))).join(turns.select("id", "role", "text"), "id")
    out = chat.format_paths(paths.select(F.col("root.conv_id").alias("path"), "step", "role", "text"))
    got = {r.path: r for r in out.select("path", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert set(got) == {1, None} and got[1].n_turns == 300 and [t.text for t in got[1].turns] == [r[3] for r in rows[:300]]
    assert got[1].loss == "".join(r[3] for r in rows[1:300:2]) and got[None].n_turns == 2 and got[None].loss == ""


def test_reply_trees_choose_the_best_branch(spark):
    edges = [(0, None, 1.0), (1, 0, 5.0), (2, 0, 1.0), (3, 1, 0.0), (4, 2, 9.0), (5, 4, 9.0), (10, 99, 1.0), (20, 21, 1.0), (21, 20, 1.0)] + [(100 + i, 99 + i if i else None, 1.0) for i in range(40)]
    got = collections.defaultdict(dict)
    for r in chat.reply_paths(docs(spark, edges, "id long, parent long, score double"), branches=2).collect():
        got[r.root, r["rank"]][r.step] = r.id
    assert got[0, 1] == {0: 0, 1: 2, 2: 4, 3: 5} and got[0, 2] == {0: 0, 1: 1, 2: 3} and got[10, 1] == {0: 10}
    assert got[100, 1] == {i: 100 + i for i in range(40)} and len(got) == 4


# 7, 8 near duplicates


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(300, 300)]
    raw = [(a.to_bytes(16, "big"), b.to_bytes(16, "big")) for a, b in edges]
    found = {int.from_bytes(r.node, "big"): bytes(r.label) for r in lsh.components(docs(spark, raw, "a binary, b binary")).collect()}
    assert len({found[i] for i in range(61)}) == 1 and len({found[i] for i in range(100, 180)}) == 1 and found[0] != found[100]


def union(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def variants(rng, count, words):
    out = []
    for i in range(count):
        base = prose(rng, words).split()
        out.append((len(out), " ".join(base)))
        for _ in range(rng.randrange(5)):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = prose(rng, 1)
            out.append((len(out), " ".join(t)))
    return out


@pytest.mark.parametrize(("crowd", "rounds"), [(lsh.CROWD, lsh.ROUNDS), (2, 0), (2, 1)])
def test_near_classes_equal_brute_force(spark, monkeypatch, crowd, rounds):
    monkeypatch.setattr(lsh, "CROWD", crowd)
    monkeypatch.setattr(lsh, "ROUNDS", rounds)
    rows = variants(random.Random(11), 40, 60)
    rows += [(1000, "A b, c!"), (1001, "a B c"), (1002, None), (1003, "?!"), (1003, "?!"), (None, "lone words here"), (1004, rows[0][1]), (1004, rows[0][1])]
    frame = docs(spark, rows)
    got = near_dup.near_classes(frame, recall=0.9999, hashes=60).collect()
    idf = near_dup.shingle_idf(frame)
    s, at, w, _ = near_dup.weighted_shingles(pa.array([t for _, t in rows], pa.string()), idf)
    sets = [(s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(rows))]
    tops = union(len(rows), [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if len(sets[i][0]) and len(sets[j][0]) and near_dup.jaccard(sets[i], sets[j]) >= 0.8])
    least = {}
    for (d, _), t in zip(rows, tops, strict=True):
        least[t] = min(x for x in (least.get(t), d) if x is not None) if (least.get(t) is not None or d is not None) else None
    want = collections.Counter((d, least[t]) for (d, _), t in zip(rows, tops, strict=True))
    assert collections.Counter((r.doc_id, r.class_id) for r in got) == want
    kept = near_dup.dedup(frame).collect()
    assert len({r.doc_id for r in kept}) == len(set(tops)) - 1 and len([r for r in kept if r.doc_id == 1003]) == 2  # 1003's rows are of a class each


def test_near_duplicates_are_found_at_the_shipped_parameters(spark):
    rng = random.Random(71)
    rows = variants(rng, 250, 80)
    frame = docs(spark, rows)
    idf = near_dup.shingle_idf(frame)
    s, at, w, _ = near_dup.weighted_shingles(pa.array([t for _, t in rows]), idf)
    sets = [(s[at[i] : at[i + 1]], w[at[i] : at[i + 1]]) for i in range(len(rows))]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i + 1, min(i + 6, len(rows))) if near_dup.jaccard(sets[i], sets[j]) >= 0.8]  # variants stand next to each other
    got = {r.doc_id: r for r in near_dup.near_classes(frame).collect()}
    tops = union(len(rows), pairs)
    found = sum(got[i].class_id == got[j].class_id for i, j in pairs)
    assert len(pairs) > 300 and found >= 0.98 * len(pairs)
    assert all(tops[r.class_id] == tops[d] for d, r in got.items())  # nothing else is joined
    sizes = collections.Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())


def test_shingle_idf_counts_exactly(spark, monkeypatch):
    rng = random.Random(73)
    pool = [prose(rng, 6) for _ in range(30)]
    rows = [(i, " ".join(rng.sample(pool, rng.randrange(1, 4)) + [prose(rng, 4)])) for i in range(900)]
    monkeypatch.setattr(near_dup, "COMMON", 16)
    idf = near_dup.shingle_idf(docs(spark, rows).repartition(3))
    df = collections.Counter()
    for _, t in rows:
        s, at = tk.shingles(*tk.words(pa.array([t]))[:2])
        df.update(set(s.tolist()))
    least = max(900 / 16, sum(df.values()) / near_dup.ENTRIES)
    keys = np.array(sorted(df), np.uint64)
    want = [1 + np.log(901 / (1 + max(df[int(k)], least))) for k in keys]
    assert np.allclose(idf.of(keys), want) and 0 < len(idf.shingles) == sum(n >= least for n in df.values()) < len(df)


def test_routes_by_size_give_equal_results(spark, monkeypatch):
    rng = random.Random(79)
    rows = [(i, prose(rng, rng.randrange(5, 40)), rng.choice("abc")) for i in range(200)]
    frame = docs(spark, rows, "doc_id long, text string, source string")
    items = docs(spark, [(i, " ".join(rows[i][1].split()[:12])) for i in range(30)], "item_id long, text string")
    plain = sorted(mixing.mix(frame).collect()), sorted(decontaminate.hits(frame, items).collect())
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    groups = decontaminate.item_groups(items, 60, 7)
    assert len(groups) > 4 and sum(g.count() for g in groups) == 30
    monkeypatch.setattr(decontaminate, "item_groups", lambda _: groups)
    assert (sorted(mixing.mix(frame).collect()), sorted(decontaminate.hits(frame, items).collect())) == plain and plain[1]
    assert secrets.trigram_query(r"(aab|bbc|ccd)(dde|eef)", most=2) == [frozenset({"dde"}), frozenset({"eef"})]  # of too many branches what is left asks for less
    narrow = (secrets.Rule("pair", r"(aab|bbc|ccd)(dde|eef)"),)
    texts = docs(spark, [(1, "x aabdde y"), (2, "ccdeef bbcdde"), (3, "aab dde"), (4, None)])
    want = sorted((r.doc_id, tuple(r.secrets)) for r in secrets.scan(texts, narrow).collect())
    monkeypatch.setattr(secrets, "trigram_query", lambda _: None)
    assert sorted((r.doc_id, tuple(r.secrets)) for r in secrets.scan(texts, narrow).collect()) == want and len(want[1][1]) == 2


def test_weighted_samples_collide_like_weighted_jaccard():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    weights = rng.uniform(1, 8, 300), rng.uniform(1, 8, (2, 100))
    sets = []
    for i in range(2):
        h, w = np.concatenate((shared, own[i])), np.concatenate((weights[0], weights[1][i]))
        order = np.argsort(h)
        sets.append((h[order], w[order]))
    signature = near_dup.icws(np.concatenate([x[0] for x in sets]), np.array([0, 400, 800]), np.concatenate([x[1] for x in sets]), 2000)
    assert abs((signature[0] == signature[1]).mean() - near_dup.jaccard(*sets)) < 0.04


def test_bands_reach_recall():
    for threshold, recall, most in ((0.8, 0.995, 24), (0.8, 0.98, 8), (0.5, 0.9, 64)):
        bands, rows = lsh.bands_for(threshold, recall, most)
        assert bands * rows <= most and 1 - (1 - threshold**rows) ** bands >= recall


def plain_windows(text):
    """(start, end, words) of the picked windows: of each NEAR in a row, the one of least hash."""
    words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())]
    h, bounds, _, _ = tk.words(pa.array([" ".join(w for *_, w in words)]))
    n, out = len(words) - paragraphs.WINDOW + 1, set()
    hashes = {}
    for i in range(n):
        part = h[i : i + paragraphs.WINDOW]
        total = sum(int(x) * pow(paragraphs._BASE, j + 1, 1 << 64) for j, x in enumerate(tk.mix(part))) % (1 << 64)
        hashes[i] = int(tk.mix(np.array([total * pow(paragraphs._BASE, -1, 1 << 64) % (1 << 64)], np.uint64))[0])
    for i in range(n - paragraphs.NEAR + 1):
        out.add(min(range(i, i + paragraphs.NEAR), key=lambda j: hashes[j]))
    return [(words[i][0], words[i + paragraphs.WINDOW - 1][1], tuple(w for *_, w in words[i : i + paragraphs.WINDOW])) for i in sorted(out)]


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(13)
    pool = [t for _, t in variants(rng, 25, 30)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 40)) for _ in range(4))) for i in range(60)]
    passage = prose(rng, 60)
    rows += [(200, prose(rng, 30) + ". " + passage + " " + prose(rng, 20)), (201, prose(rng, 9) + ". É " + passage + " " + prose(rng, 50)), (202, None), (203, ""), (200, rows[0][1]), (5, rows[5][1])]
    units = [(d, a, b, False, words_of(t[a:b])) for d, t in rows if t for a, b in paragraphs.lines(t)]
    units = [u for u in units if len(u[4]) >= paragraphs.LEAST]
    sets = [{tuple(u[4][i : i + 5]) for i in range(len(u[4]) - 4)} for u in units]
    links = [(i, j) for i, j in itertools.combinations(range(len(units)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    base = len(units)
    units += [(d, a, b, True, w) for d, t in rows for a, b, w in plain_windows(t)]
    links += [(i, j) for i, j in itertools.combinations(range(base, len(units)), 2) if units[i][4] == units[j][4]]
    classes = collections.defaultdict(list)
    for u, top in zip(units, union(len(units), links), strict=True):
        classes[top].append(u[:4])
    want = collections.Counter((*u, u[:3] != min(c)[:3]) for c in classes.values() if len(set(c)) > 1 for u in c)
    got = collections.Counter((r.doc_id, r.start, r.end, r.window, r.removed) for r in paragraphs.repeated(docs(spark, rows), recall=0.9999, hashes=40).collect())
    assert got == want and any(d == 201 for d, *_ in got) and any(w for *_, w, _ in got)


def test_passages_and_near_lines_are_found_at_the_shipped_parameters(spark):
    rng = random.Random(29)
    rows, want, near = [], [], 0
    for i in range(40):
        plain = prose(rng, 50) if i % 2 else ". ".join(prose(rng, 25) for _ in range(2))
        for j in range(2):
            before = prose(rng, rng.randrange(5, 60)) + " "
            rows.append((2 * i + j, before + plain + " é " + prose(rng, rng.randrange(5, 60))))
            want.append((2 * i + j, len(before), len(before) + len(plain)))
    for i in range(100):  # lines of one changed word: 56 of 66 shingles or more in common
        line = prose(rng, 65).split()
        rows += [(1000 + 2 * i, " ".join(line)), (1001 + 2 * i, " ".join([*line[:-30], "changed", *line[-29:]]))]
    rows += [(2000 + i, prose(rng, 70)) for i in range(100)]  # shares nothing
    got = collections.defaultdict(list)
    for r in paragraphs.repeated(docs(spark, rows)).collect():
        got[r.doc_id].append((r.start, r.end, r.window, r.removed))
    for d, a, b in want:
        assert any(a <= start and end <= b and removed == bool(d % 2) for start, end, _, removed in got[d])
    near = sum(any(not window and removed for *_, window, removed in got[1001 + 2 * i]) for i in range(100))
    assert near >= 95 and not any(got[2000 + i] for i in range(100))


# long texts and empty tables


def test_long_texts_and_empty_tables(spark):
    rng = random.Random(67)
    long = prose(rng, 60_000)
    rows = [(1, long), (2, long[:200_000] + " token=abcdef99 " + long[200_000:]), (3, "short words only here")]
    frame, none = docs(spark, rows), docs(spark, [])
    gone = {r.doc_id: r.n_removed for r in suffixes.dedup(frame).collect()}
    assert gone[1] == gone[3] == 0 and gone[2] == len(long.encode())
    assert {r.class_id for r in near_dup.near_classes(frame).collect()} == {1, 3} and near_dup.near_classes(none).count() == 0
    assert {r.doc_id for r in paragraphs.repeated(frame).collect()} == {1, 2} and paragraphs.repeated(none).count() == 0
    items = docs(spark, [(7, long[1000:1600])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.hits(frame, items).collect()} == {1, 2} and decontaminate.hits(none, items).count() == decontaminate.hits(frame, items.limit(0)).count() == 0
    assert [len(r.secrets) for r in secrets.scan(frame).orderBy("doc_id").collect()] == [0, 1, 0] and secrets.scan(none).count() == 0
    page = f"<article><p>{long}</p></article>"
    assert html_diff.extract(docs(spark, [(1, "http://a/b", page)], "page_id long, url string, html string")).first().text == long
    empty = docs(spark, [], "conv_id long, turn long, role string, text string")
    assert chat.thread(empty).count() == 0


# 9 secrets


def test_trigram_queries_and_spans(spark):
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert set(secrets.trigram_query(r"(abc|abcd)e?x")) == {frozenset({"abc", "bcx"}), frozenset({"abc", "bce", "cex"}), frozenset({"abc", "bcd", "cdx"}), frozenset({"abc", "bcd", "cde", "dex"})}
    texts = ["PassWord = 'abcdef' x", "secret=token: abcdefgh", "é AKIA" + "A1" * 8, "AKIASHORT", "f" * 24 + "g" + "0" * 23, None, "", "api_key:abc﷐def token==zzzzzz", "-----BEGIN RSA PRIVATE KEY-----", "passwd=AKIA" + "0" * 20 + " " + "a" * 30]
    base = {"assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24)}
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "AKIA" + "Z" * 20), (None, "token=abcdef")]
    got = collections.Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.secrets if s.kind in base)) for r in secrets.scan(docs(spark, rows)).collect())
    want = collections.Counter()
    for d, t in rows:
        found = [(m.start(), i, kind, m.end()) for i, (kind, (p, ok)) in enumerate(base.items()) for m in re.finditer(p, t or "", re.A) if ok(m)]
        want[d, tuple((kind, a, b) for a, _, kind, b in sorted(found))] += 1
    assert got == want
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, [(1, "x token=abcdef y", 7), (2, "clean", 7)], "doc_id long, text string, n_chars long")).collect()}
    assert clean[1].text == "x [SECRET] y" and clean[1].n_chars == 12 and clean[2].text == "clean" and clean[2].n_chars == 7


def test_private_keys_go_with_their_bodies(spark):
    rng = random.Random(37)
    body = ["".join(rng.choice("ABCDEFabcdef0189+/") for _ in range(64)) for _ in range(20)] + ["Zz9+Q=="]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", ""]
    keys = ["\n".join([head, *body, end]), "\r\n".join([head, *fields, *body, end]), "\\n".join([head, *body, end]), "\\n".join([head, *fields, *body, end]), " ".join([head, *body, end])]
    keys += ["\n".join([head, *["    " + x for x in body], "    " + end]), "\n".join([head, *body]), "\n".join([head, *["  " + x for x in body[:-1]]]), "\n".join([head, *fields, *body]), "\n".join([head, *body * 2000, end]), "\n".join([head, *body * 2000])]
    rows = [(i, f"é before {k} after it.") for i, k in enumerate(keys)]
    got = {r.doc_id: r.text for r in secrets.redact(docs(spark, rows)).collect()}
    assert got == {i: "é before [SECRET] after it." for i in range(len(keys))}
    assert secrets.trigram_query(secrets.MORE[0].pattern) == secrets.trigram_query("-----BEGIN [A-Z ]*PRIVATE KEY-----")


# 10 languages


def test_languages(spark):
    rng = random.Random(17)
    tongues = {"aa": "the and of with er th", "bb": "und der die ein ung sch", "cc": "que los de ción ar ñ"}
    make = lambda parts: " ".join("".join(rng.choice(parts.split()) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(i, make(tongues[x]), x) for i in range(150) for x in [rng.choice(list(tongues))]]
    profiles = langid.learn(docs(spark, rows, "doc_id long, text string, lang string"))
    fresh = [(1, make(tongues["aa"])), (2, make(tongues["cc"]) * 3), (3, None), (4, "12 !?"), (5, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, fresh), profiles).collect()}
    assert got[1][0] == "aa" and got[2][0] == "cc" and {got[i] for i in (3, 4, 5)} == {("und", 0.0)} and 0 <= got[1][1] <= 1
    assert {r.lang_pred for r in langid.predict(docs(spark, fresh), {}).collect()} == {"und"}


def test_predictions_equal_a_plain_out_of_place_distance(spark):
    rng = random.Random(61)
    rows = [(i, prose(rng, rng.randrange(1, 30)), f"l{i % 7}") for i in range(140)] + [(900, None, "l1"), (901, "x", None)]

    def ranks(texts):
        n = collections.Counter()
        for t in texts:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                n.update(w)
                for k in (2, 3):
                    framed = f" {w} "
                    n.update(framed[i : i + k] for i in range(len(framed) - k + 1) if " " not in framed[i + 1 : i + k - 1])
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
        return sorted(n, key=lambda g: (-n[g], code(g)))[: langid.TOP]

    profiles = {x: {g: i for i, g in enumerate(ranks([t for _, t, y in rows if y == x and t]))} for x in sorted({y for _, t, y in rows if y and t})}
    learned = langid.learn(docs(spark, rows, "doc_id long, text string, lang string"))
    assert sorted(learned) == sorted(profiles) and len(learned) == 7
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs(spark, rows, "doc_id long, text string, lang string"), learned).collect()}
    for d, t, _ in rows:
        mine = ranks([t]) if t else []
        off = {x: sum(abs(p[g] - i) if g in p else langid.TOP for i, g in enumerate(mine)) for x, p in profiles.items()}
        best = min(off, key=lambda x: (off[x], x))
        assert got[d] == ((best, round(1 - off[best] / (langid.TOP * len(mine)), 9)) if mine else ("und", 0.0)), (d, t)


def test_grams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    text = prose(random.Random(19), 400)
    whole = dict(zip(*map(list, langid.grams(text)), strict=True))
    monkeypatch.setattr(langid, "PIECE", 97)
    assert dict(zip(*map(list, langid.grams(text)), strict=True)) == whole
    counts = collections.Counter(ord(c) for c in text if c != " ")
    assert all(whole[k] == n for k, n in counts.items()) and json.dumps(len(whole))
