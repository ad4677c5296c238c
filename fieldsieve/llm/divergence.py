"""How far sources of a language are from each other and from the language, by their words.

Terms are counted for each (lang, source) and a language keeps those of at least LEAST documents. Kept
terms are dealt to blocks by hash. A block is one dense int64 tile, groups by terms, and all pairs of its
groups are compared by broadcasting the tile against itself, some terms at a time; the partial matrices of
the blocks are summed, and each block's best terms of a group (TOP of them, a heap) are merged to the best
of all. Terms that no group of a tile has are one column with their number. A tile has about CELLS cells: a
language of many terms has more blocks, and one of more than GROUPS sources has blocks of pairs of source
ranges, so no task holds a language. What a task needs of the groups comes to it by a cogrouped shuffle,
nothing is broadcast or collected. Text is counted for each Arrow batch before it is shuffled, so a source
that holds a third of all documents is as dear as others. All arithmetic is on integers.

Of two shares p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N the group's kept occurrences and V the
language's kept terms, the divergence at a term is floor((p - q)^2 / (p + q)).

Defined cases: null text, lang or source count as ''; texts of any length count whole; repeated rows count
each time; a group without a kept term takes part with counts of 0; where a language keeps no term all
its pairs have value 0; ties go by UTF-8 bytes; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, release, small_batches, table

LEAST, TOP, UNIT = 10, 10, 1_000_000_000
CELLS = 1 << 19
GROUPS = 256
#: Cells of the pairs-by-terms array that one step of a tile works on.
STEP = 1 << 20

_TERM = np.zeros(256, np.uint8)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def batch_terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; for each occurrence its term's place among them and its text's."""
    data, offsets = tk.utf8(texts)
    starts, ends, bounds = tk.runs(data, offsets, _TERM)
    at = np.concatenate(([0], np.cumsum(ends - starts)))  # where each term stands once all else is left out
    kept = tk.ascii_lower(data[_TERM[data] == 1])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(kept.tobytes())).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(bounds))


COUNTS = "lang string, source string, term string, n long, df long"


def group_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term in each group, and a row of null term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = batch.column("lang").dictionary_encode(), batch.column("source").dictionary_encode()
            width = len(source.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
            terms, code, owner = batch_terms(batch.column("text"))
            doc, times = np.unique(owner * max(len(terms), 1) + code, return_counts=True)  # each document's distinct terms
            both, back = np.unique(group[doc // max(len(terms), 1)] * max(len(terms), 1) + doc % max(len(terms), 1), return_inverse=True)
            n, df = np.zeros(len(both), np.int64), np.bincount(back, minlength=len(both))
            np.add.at(n, back, times)
            groups = np.concatenate((both // max(len(terms), 1), np.unique(group)))
            none = len(groups) - len(both)
            zeros = np.zeros(none, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    lang.dictionary.take(pa.array(groups // width)), source.dictionary.take(pa.array(groups % width)),
                    pa.concat_arrays([terms.take(pa.array(both % max(len(terms), 1))).cast(pa.string()), pa.nulls(none, pa.string())]),
                    pa.array(np.concatenate((n, zeros))), pa.array(np.concatenate((df.astype(np.int64), zeros))),
                ],
                names=["lang", "source", "term", "n", "df"],
            )

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count: np.ndarray, kept: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(UNIT (count + 2) / (kept + 2 terms)), three digits at a time so that 64 bits hold it all."""
    whole = kept + 2 * terms
    rest, out = count + 2, np.zeros(np.broadcast(count, kept).shape, np.int64)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Summed divergence of each row of p against each of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, STEP // max(1, len(p) * len(q)))
    for at in range(0, p.shape[1], step):
        out += divergence(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return out


PARTS = "lang string, source string, part string, item string, value long"


def tile(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """One block's rows of PARTS: partial sums of its pairs of groups and, where it has its groups' own terms, their TOP."""
    _, _, first, second = (k.as_py() for k in key)
    names, of = groups["source"].combine_chunks(), groups["range"].to_numpy()
    coded = counts["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    row = pc.index_in(counts["source"].combine_chunks(), value_set=names).to_numpy()
    dense = np.zeros((len(names), len(terms) + 1), np.int64)  # the last column: a term that no group here has
    dense[row, code] = counts["n"].to_numpy()
    kept, size = groups["kept"].to_numpy()[:, None], int(groups["terms"][0].as_py())
    others = int(groups["block_terms"][0].as_py()) - len(terms)
    out = []
    if size:
        p = share(dense, kept, size)
        a, b = np.flatnonzero(of == first), np.flatnonzero(of == second)
        sums = pair_sums(p[a, :-1], p[b, :-1]) + others * divergence(p[a, None, -1], p[None, b, -1])
    else:
        a, b = np.flatnonzero(of == first), np.flatnonzero(of == second)
        sums = np.zeros((len(a), len(b)), np.int64)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
    other = a[i] != b[j]
    i, j = i[other], j[other]
    sides = [(a[i], b[j])] if first == second else [(a[i], b[j]), (b[j], a[i])]
    for x, y in sides:
        out.append((names.take(pa.array(x)), "pair", names.take(pa.array(y)), sums[i, j]))
    if first == second and len(terms):
        in_lang = np.zeros(len(terms), np.int64)
        in_lang[code] = counts["lang_n"].to_numpy()
        q = share(in_lang, np.int64(groups["lang_kept"][0].as_py()), size)
        x, y = np.nonzero((dense[:, :-1] > 0) & (p[:, :-1] > q))
        value = divergence(p[x, y], q[y])
        name = np.empty(len(terms), np.int64)
        name[pc.sort_indices(terms.cast(pa.binary())).to_numpy()] = np.arange(len(terms))
        order = np.lexsort((name[y], -value, x))
        x, y, value = x[order], y[order], value[order]
        best = np.arange(len(x)) - np.searchsorted(x, x) < TOP
        out.append((names.take(pa.array(x[best])), "term", terms.take(pa.array(y[best])).cast(pa.string()), value[best]))
    tables = [pa.table({"lang": pa.repeat(key[0], len(v)), "source": s, "part": pa.repeat(pa.scalar(part), len(v)), "item": item, "value": pa.array(v)}) for s, part, item, v in out]
    return pa.concat_tables(tables)


def audit(docs: DataFrame, least: int = LEAST, cells: int = CELLS, ranges: int = GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) for docs with lang, source and text."""
    counts = materialize(group_terms(docs))
    told = counts.filter("term is not null")
    kept = materialize(told.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n")).filter(F.col("df") >= least).drop("df"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_kept"))
    rows = materialize(told.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"))
    in_group = rows.groupBy("lang", "source").agg(F.sum("n").alias("kept"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.filter("term is null").select("lang", "source").join(in_group, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["kept", "terms", "lang_kept"])
    groups = groups.withColumn("range", F.floor(number / ranges).cast("int"))
    of_lang = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.count("*").alias("n"), (F.max("range") + 1).alias("ranges"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("terms") * F.least("n", F.lit(2 * ranges)) / cells)).cast("int").alias("blocks")
    groups = materialize(groups.join(of_lang.select("lang", "ranges", blocks), "lang"))
    release(counts)
    plan = groups.select("lang", "blocks").distinct()
    block = lambda: F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    sized = kept.join(plan, "lang").groupBy("lang", block()).agg(F.count("*").alias("block_terms"))
    # a range of groups takes part in its pairs with every range, itself included
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("ranges") - 1), lambda r: F.struct(F.least("range", r).alias("first"), F.greatest("range", r).alias("second")))).alias("_p")
    left = rows.join(groups.select("lang", "source", "blocks", "ranges", "range"), ["lang", "source"]).select("lang", "source", "term", "n", "lang_n", block(), pairs).select("*", "_p.*").drop("_p")
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sized, ["lang", "block"], "left").fillna(0, ["block_terms"])
    right = right.select("lang", "source", "kept", "terms", "lang_kept", "range", "block", "block_terms", pairs).select("*", "_p.*").drop("_p")
    by = ["lang", "block", "first", "second"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, PARTS)
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return whole.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= TOP))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_divergence}

ORACLES = {
    "op11_source_divergence": r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), words as (select row, lang, source, unnest(terms) as term from docs
), counts as (select lang, source, term, count(*) as n from words group by all
), kept as (select lang, term, count(*) as lang_n from words group by all having count(distinct row) >= 10
), sizes as (select lang, count(*) as v, sum(lang_n) as lang_kept from kept group by lang
), groups as (
  select g.lang, g.source, coalesce(s.v, 0) as v, s.lang_kept, coalesce((select sum(c.n) from counts c join kept k using (lang, term) where c.lang = g.lang and c.source = g.source), 0) as kept
  from (select distinct lang, source from docs) g left join sizes s using (lang)
), shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 2) // (g.kept + 2 * g.v))::bigint as p,
    (1 + 1000000000::hugeint * (k.lang_n + 2) // (g.lang_kept + 2 * g.v))::bigint as q
  from groups g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from shares where n > 0 and p > q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
}
