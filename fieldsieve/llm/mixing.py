"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target number of words (its weight's share of all words, at most ``cap`` times what
it has, the excess shared out again). Every document has an expected number of copies around its
source's ratio target/size: more for documents that are long for their source, fewer for short ones,
by a measure of their size (``expected``), never over ``cap``; expected words add up to the target.
The whole part is certain copies; the fraction left is the inclusion probability p of one more copy.
Documents are ranked by the random odds over the inclusion odds, U/(1-U) / (p/(1-p)), and the extra
copies go down that ranking until the sample has its fixed size, the words that the fractions add up
to; the document on the border is taken if that comes nearer, and at last at most one document per
source is added or dropped where that closes the gap.

The cut is found without sorting a source in one task: words are summed by ranking bucket, the bucket
that holds the cut is split again, and only its documents are ranked by a window. Sums are of whole
numbers, so they do not depend on the order of rows.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents
of size 0 take 0 words; U depends on doc_id only, so reruns agree; rows equal in source, doc_id and
size rank as one group, of which the cut takes as many as fit, whichever; columns other than doc_id,
source and text are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (5, 2, 1)
CAP = 3
TILT = 0.5  # of the room that a source's ratio leaves between 0 and cap
SCALE = 1024  # the size measure is a whole number from 0 to this
SPLIT = 1024  # ranking buckets of a level; two levels before the window
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes (source, source_size) with the words wanted of each source.

    Sorted by cap/weight, the capped sources are a prefix, so the level that all others share follows
    from running sums: one row for each source passes here, never documents.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "_caps": F.coalesce(F.sum("_cap").over(before), F.lit(0)), "_ws": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
        "_total": F.sum("source_size").over(whole),
    }).withColumn("_level", (F.col("_total") - F.col("_caps")).cast("double") / F.col("_ws"))
    # the first source whose cap holds the level sets it for itself and all after it
    level = F.min_by("_level", F.struct((F.col("_level") * F.col("_w") > F.col("_cap")).cast("int"), F.col("_cap") / F.col("_w"), F.col("_ws") * -1)).over(whole)
    target = F.least(F.col("_cap").cast("double"), F.col("_w") * level)
    return rows.select("source", "source_size", target.alias("target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of SHA-256."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def measured(docs: DataFrame, means: DataFrame) -> DataFrame:
    """docs with _g, the size measure: half of SCALE for a document of its source's mean size, more for longer ones."""
    means = means.select(F.col("source").alias("_s"), F.expr("source_size div n").alias("_mean"))
    rows = docs.join(F.broadcast(means) if few(means) else means, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return rows.withColumn("_g", F.coalesce(F.expr(f"({SCALE} * `size`) div nullif(`size` + _mean, 0)"), F.lit(0))).drop("_mean")


def expected(goals: DataFrame, cap: int = CAP) -> tuple[DataFrame, Column]:
    """goals with _ratio, _tilt and _middle, and a document's expected copies by these and its _g."""
    ratio = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    goals = goals.withColumn("_ratio", ratio).withColumn("_tilt", F.lit(TILT) * F.least(F.col("_ratio"), cap - F.col("_ratio")))
    goals = goals.withColumn("_middle", F.coalesce(F.try_divide(F.col("measure").cast("double"), F.col("source_size").cast("double")), F.lit(0.0)))
    return goals, F.col("_ratio") + F.col("_tilt") * ((F.col("_g").cast("double") - F.col("_middle")) / float(SCALE))


def pareto_sample(docs: DataFrame, goals: DataFrame, seed: str = "mix", cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """Add source_size, target and taken to docs (doc_id, source, size, _g, and what is carried along).

    goals: one row for each source, source_size, target, and measure, the sum of size * _g.
    """
    goals, copies = expected(goals, cap)
    goals = materialize(goals.select(F.col("source").alias("_s"), "source_size", "target", "_ratio", "_tilt", "_middle"))
    small = few(goals)

    def joined(rows: DataFrame, by_source: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(F.broadcast(by_source) if small else by_source, F.col("source").eqNullSafe(F.col("_s")), how).drop("_s")

    u = uniform(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    rows = joined(docs, goals).withColumn("_e", copies).withColumn("_whole", F.floor("_e").cast("long"))
    rows = rows.withColumn("_p", F.when(F.col("size") > 0, F.col("_e") - F.col("_whole")).otherwise(0.0)).withColumn("_u", u)
    rows = rows.withColumn("_q", F.when(F.col("_p") > 0, odds)).withColumn("_v", F.col("_q") / (1 + F.col("_q")))
    rows = rows.withColumn("_b1", F.floor(F.col("_v") * SPLIT).cast("int")).withColumn("_b2", F.floor((F.col("_v") * SPLIT - F.col("_b1")) * SPLIT).cast("int"))
    rows = materialize(rows.drop("_ratio", "_tilt", "_middle", "_e", "_g", "_u", "_v").withColumn("_id", F.monotonically_increasing_id()))
    certain = materialize(rows.groupBy("source").agg(F.sum(F.col("_whole") * F.col("size")).alias("sure")))
    need = joined(certain, goals).select("source", (F.col("target") - F.col("sure")).alias("left"))
    open_rows = rows.filter("_p > 0")
    cut1 = cut_bucket(open_rows.groupBy("source", "_b1").agg(F.sum("size").alias("size")), need, "_b1")
    in1 = with_cut(open_rows, cut1, "_b1").filter(F.col("_b1") == F.col("_c_b1"))
    cut2 = cut_bucket(in1.groupBy("source", "_b2").agg(F.sum("size").alias("size")), cut1.select("source", "left"), "_b2")
    cuts = materialize(with_cut(cut1.select("source", F.col("_b1").alias("_c1")), cut2, "_b2").select("source", "_c1", F.col("_c_b2").alias("_c2"), "left"))
    last = with_cut(open_rows, cuts.select("source", F.struct("_c1", "_c2").alias("_c"), "left"), "_c").filter((F.col("_b1") == F.col("_c_c._c1")) & (F.col("_b2") == F.col("_c_c._c2")))
    last = last.groupBy("source", "_q", "doc_id", "size").agg(F.count("*").alias("_m"), F.max("left").alias("left"))
    down = Window.partitionBy("source").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = last.withColumn("_before", F.coalesce(F.sum(F.col("size") * F.col("_m")).over(down), F.lit(0)))
    # of the group on the border as many are taken as come nearest: the last one if at most half of it is over
    fit = F.least(F.col("_m"), F.floor((F.col("left") - F.col("_before")) / F.col("size") + 0.5))
    key = F.struct("_q", "doc_id", "size")
    border = ranked.withColumn("_k", fit).filter("_k > 0").groupBy("source").agg(F.max_by(F.struct(key.alias("key"), "_k", "_m", (F.col("_before") + F.col("_k") * F.col("size")).alias("done")), key).alias("_b"))
    state = cuts.join(border.select(F.col("source").alias("_s"), "_b"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    state = materialize(state.withColumn("gap", F.col("left") - F.coalesce("_b.done", F.lit(0))).select(F.col("source").alias("_s"), "_c1", "_c2", "_b", "gap"))
    in_cut = (F.col("_b1") == F.col("_c1")) & (F.col("_b2") == F.col("_c2"))
    earlier = (F.col("_b1") < F.col("_c1")) | ((F.col("_b1") == F.col("_c1")) & (F.col("_b2") < F.col("_c2")))
    on_border = F.coalesce((F.col("_p") > 0) & in_cut & (key == F.col("_b.key")), F.lit(False))
    inside = F.coalesce((F.col("_p") > 0) & (earlier | (in_cut & (key < F.col("_b.key")))), F.lit(False))
    rows = joined(rows, state, "left").withColumns({"_on": on_border, "_in": inside})
    # one document of a source closes the gap that is left, where it can
    may_add = (~F.col("_in") & ~F.col("_on")) | (F.col("_on") & (F.col("_b._k") < F.col("_b._m")))
    off = lambda d, may: F.when(may, F.struct(F.abs(F.col("gap") - d * F.col("size")).alias("off"), F.col("doc_id").alias("doc"), "size", F.lit(d).alias("step"), F.abs("gap").alias("now")))
    fix = rows.filter("_p > 0").groupBy("source").agg(F.least(F.min(off(1, may_add)), F.min(off(-1, F.col("_in") | F.col("_on")))).alias("_f"))
    fix = materialize(fix.filter("_f.off < _f.now").select(F.col("source").alias("_s"), F.col("_f.doc").alias("_fd"), F.col("_f.size").alias("_fs"), F.col("_f.step").alias("_step")))
    rows = joined(rows, fix, "left").withColumn("_step", F.when(F.col("doc_id").eqNullSafe(F.col("_fd")) & (F.col("size") == F.col("_fs")) & (F.col("_p") > 0), F.col("_step")))
    # rows of groups that are split are numbered: within the task that wrote them, after those of earlier tasks
    split = rows.filter(F.col("_on") | F.col("_step").isNotNull()).withColumn("_part", F.shiftright("_id", 33))
    group = ["source", "doc_id", "size"]
    counts = split.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).select(*[F.col(c).alias(f"_k_{c}") for c in group], F.col("_part").alias("_k_part"), "_first")
    same = F.col("_part") == F.col("_k_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_id")) - 1
    split = split.withColumn("_place", place).join(counts, same).withColumn("_place", F.col("_place") + F.col("_first"))
    step = F.coalesce("_step", F.lit(0))
    wanted = F.when(F.col("_on"), F.col("_place") < F.col("_b._k") + step).when(F.col("_in"), F.col("_place") >= 1).otherwise(F.col("_place") < 1)
    whole = rows.filter(~F.col("_on") & F.col("_step").isNull()).withColumn("_extra", F.col("_in"))
    out = whole.select(*rows.columns, "_extra").unionByName(split.withColumn("_extra", wanted).select(*rows.columns, "_extra"))
    taken = F.col("size") * (F.col("_whole") + F.col("_extra").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


#: Tables of a row per source are broadcast up to this many rows, else joined by shuffle.
FEW_SOURCES = 10_000


def few(sources: DataFrame) -> bool:
    return sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES


def with_cut(rows: DataFrame, cut: DataFrame, bucket: str) -> DataFrame:
    cut = cut.select(F.col("source").alias("_s"), F.col(bucket).alias(f"_c{bucket}"), "left")
    return rows.join(cut, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def cut_bucket(sums: DataFrame, wanted: DataFrame, bucket: str) -> DataFrame:
    """(source, bucket, left): the bucket in which the running sum reaches what is wanted, and what is left for it."""
    wanted = wanted.select(F.col("source").alias("_s"), F.col("left").alias("_want"))
    run = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    rows = sums.withColumn("_before", F.coalesce(F.sum("size").over(run), F.lit(0))).join(wanted, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    found = rows.filter(F.col("_before") <= F.col("_want")).groupBy("source").agg(F.max(F.struct(F.col(bucket), (F.col("_want") - F.col("_before")).alias("left"))).alias("_m"))
    return materialize(found.select("source", f"_m.{bucket}", "_m.left"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, and what is carried along) for each row of docs (doc_id, source, text)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    slim = materialize(docs.select("doc_id", "source", size, *carry))
    sizes = materialize(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    rows = measured(slim, sizes)
    measure = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("_g")).alias("measure")).withColumnRenamed("source", "_s")
    goals = targets(sizes.select("source", "source_size"), weights, cap)
    goals = goals.join(measure, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return pareto_sample(rows, goals, cap=cap, carry=carry)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with all their columns, and size, source_size, target, taken and
    copies (in place of columns of these names)."""
    rows = materialize(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("row_id")))
    told = mix(rows.select("row.doc_id", "row.source", "row.text", "row_id"), carry=("row_id",)).filter("taken > 0")
    added = {"size": F.col("size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": F.col("taken"), "copies": F.expr("taken div size")}
    out = rows.join(told.select("row_id", "size", "source_size", "target", "taken"), "row_id")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op3_mix_sources": op3_mix}
ORACLES = {
    "op3_mix_sources": r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sizes as (
  select source, sum(size)::bigint as source_size from docs group by source
), weighted as (
  select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as w, source_size * 3 as cap from sizes
), levels as (
  select *, ((sum(source_size) over () - coalesce(sum(cap) over b, 0))::double) / (sum(w) over () - coalesce(sum(w) over b, 0)) as level
  from weighted window b as (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)
), picked as (
  select level from levels order by (level * w > cap)::int, cap / w, source nulls last limit 1
), goals as (
  select source, source_size, least(cap::double, w * (select level from picked)) as target from weighted
), means as (
  select source, sum(size)::bigint // count(*) as mean from docs group by source
), measured as (
  select d.*, coalesce((1024 * d.size) // nullif(d.size + m.mean, 0), 0) as g from docs d join means m on d.source is not distinct from m.source
), measures as (
  select source, sum(size * g)::bigint as measure from measured group by source
), parts as (
  select g.*, coalesce(target / nullif(source_size, 0)::double, 0) as ratio, coalesce(measure::double / nullif(source_size, 0)::double, 0) as middle
  from goals g join measures m on g.source is not distinct from m.source
), copies as (
  select d.doc_id, d.size, p.*, ratio + (0.5::double * least(ratio, 3 - ratio)) * ((d.g::double - middle) / 1024.0::double) as e,
    (('0x' || substr(sha256('mix|' || coalesce(d.doc_id::varchar, 'null')), 1, 13))::ubigint::double + 0.5) / 4503599627370496.0 as u
  from measured d join parts p on d.source is not distinct from p.source
), fractions as (
  select *, floor(e)::bigint as whole, case when size > 0 then e - floor(e) else 0 end as p from copies
), odds as (
  select *, case when p > 0 then (u / (1 - u)) / (p / (1 - p)) end as q, target - sum(whole * size) over (partition by source) as need from fractions
), grouped as (
  select source, q, doc_id, size, need, count(*) as m from odds where p > 0 group by all
), ranked as (
  select *, coalesce(sum(size * m) over (partition by source order by q, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from grouped
), fitted as (
  select *, greatest(0, least(m, floor((need - before) / size + 0.5)))::bigint as k from ranked
), gaps as (
  select *, need - sum(k * size) over (partition by source) as gap from fitted
), fixes as (
  select source, min(f) as f from (
    select source, {'off': abs(gap - size), 'd': doc_id, 's': size, 'step': 1, 'now': abs(gap)} as f from gaps where k < m
    union all select source, {'off': abs(gap + size), 'd': doc_id, 's': size, 'step': -1, 'now': abs(gap)} from gaps where k > 0
  ) group by source
), chosen as (
  select g.source, g.doc_id, g.size, g.k + case when f.f.off < f.f.now and f.f.d is not distinct from g.doc_id and f.f.s = g.size then f.f.step else 0 end as k
  from gaps g left join fixes f on g.source is not distinct from f.source
), numbered as (
  select *, row_number() over (partition by source, doc_id, size) as i from odds
)
select n.doc_id, n.size, n.source_size, n.target, (n.size * (n.whole + coalesce(n.i <= c.k, false)::int))::bigint as taken
from numbered n left join chosen c on n.source is not distinct from c.source and n.doc_id is not distinct from c.doc_id and n.size = c.size and n.p > 0
""",
}
