"""Whitening of embeddings by covariance sums that Spark aggregates.

``fit`` turns entries into integers, takes their exact sums in one aggregation, then generates one SQL
expression for each pair of dimensions of the upper triangle, the sum of the pair's centred products,
and evaluates all of them in one aggregation (in several of PAIRS expressions each where there are more
dimensions than that). LAPACK decomposes the covariance on the driver: dimensions squared numbers,
whatever the rows. ``transform`` projects rows on the first components; ``identity_error`` measures the
covariance of what came out.

Rows reach Spark's partial aggregates where they are read: no shuffle but of one row for each task, no
Python worker.

Defined cases: rows with a null vector, or null or non-finite entries, are dropped; so are empty vectors
and those of another length than the commonest (ties: the longest), as no product of theirs exists. Rows
may repeat an id or have none, each counts and gets its rows. Fewer dimensions than components give fewer
components. A component of no variance (its eigenvalue is 0 to rounding) has null ``whitened`` and is left
out of the identity check; ``explained`` is null where nothing varies. Other columns are not read. An
empty table gives no rows. Integers beyond 64 bits fail, ``deviation`` is a decimal of 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Pair expressions of one aggregation; 90 dimensions have fewer pairs.
PAIRS = 4096


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float

    @property
    def means(self) -> list[float]:
        return [s / self.n for s in self.sums]

    def sound(self, k: int) -> bool:
        """Whether component k varies by more than rounding."""
        return self.values[k] > len(self.sums) * np.finfo(float).eps * max(self.values[0], 0.0)


def entries(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the rows whose vectors have finite entries only."""
    rows = vectors.select(F.col(f"`{row_id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    return rows.filter("v is not null and size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")


def integers(rows: DataFrame, dims: int) -> DataFrame:
    """(id, x0 .. ) of vectors of this many dimensions."""
    return rows.filter(F.size("v") == dims).select("id", *[F.expr(f"floor(v[{i}] * {SCALE}D) + {SHIFT}L").alias(f"x{i}") for i in range(dims)])


def centred(x: DataFrame, means: list[float]) -> DataFrame:
    """x with y0 .. beside it, entries less their means."""
    return x.select("*", *[F.expr(f"x{i} - {m!r}D").alias(f"y{i}") for i, m in enumerate(means)])


def total(terms: list[str]) -> str:
    """A sum as a balanced tree, so that long ones don't nest deeply."""
    while len(terms) > 1:
        terms = [f"({' + '.join(terms[i : i + 8])})" for i in range(0, len(terms), 8)]
    return terms[0]


def covariance(y: DataFrame, names: list[str], n: int) -> np.ndarray:
    """Covariance (divisor n) of centred columns, from one generated expression for each pair."""
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        found = y.agg(*[F.expr(f"sum({names[i]} * {names[j]})").alias(f"p{i}_{j}") for i, j in some]).first()
        for (i, j), v in zip(some, found, strict=True):
            out[i, j] = out[j, i] = v / n
    return out


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all rows of ``entries``; None where there is none."""
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths.d, lengths.n
    x = integers(rows, d)
    sums = [int(s) for s in x.agg(*[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)]).first()]
    cov = covariance(centred(x, [s / n for s in sums]), [f"y{i}" for i in range(d)], n)
    values, vectors = np.linalg.eigh(cov)
    return Whitening(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(cov)))


def projections(model: Whitening, components: int) -> list[Column]:
    """The whitened coordinates over columns y0 ..; null for components without variance."""
    out = []
    for k in range(min(components, len(model.sums))):
        if model.sound(k):
            weights = model.vectors[:, k] / np.sqrt(model.values[k])
            out.append(F.expr(total([f"y{i} * {float(w)!r}D" for i, w in enumerate(weights)])).alias(f"z{k}"))
        else:
            out.append(F.lit(None).cast("double").alias(f"z{k}"))
    return out


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all rows."""
    y = centred(integers(rows, len(model.sums)), model.means)
    sound = [k for k in range(min(components, len(model.sums))) if model.sound(k)]
    if not sound:
        return None
    z = y.select(*[projections(model, components)[k] for k in sound])
    means = z.agg(*[F.avg(f"z{k}").alias(f"z{k}") for k in sound]).first()
    around = z.select(*[F.expr(f"z{k} - {float(m)!r}D").alias(f"z{k}") for k, m in zip(sound, means, strict=True)])
    return float(np.abs(covariance(around, [f"z{k}" for k in sound], model.n) - np.eye(len(sound))).max())


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and component (row_id, component, n, deviation, whitened, explained, identity_error).

    deviation is the exact sum over dimensions of (n*x - S)^2, with x an entry's integer and S its dimension's sum.
    """
    rows = entries(vectors, row_id, vector)
    model = fit(rows)
    if model is None:
        kind = vectors.schema[row_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{row_id}` {kind}, {RESULT}")
    y = centred(integers(rows, len(model.sums)), model.means)
    square = "cast({0} as decimal(19,0)) * cast({0} as decimal(19,0))"
    deviation = F.expr(total([square.format(f"({model.n}L * x{i} - {s}L)") for i, s in enumerate(model.sums)])).cast("decimal(38,0)")
    z = y.select("id", deviation.alias("deviation"), *projections(model, components))
    share = lambda k: F.lit(float(model.values[k] / model.trace) if model.trace > 0 else None).cast("double")
    each = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("component"), F.col(f"z{k}").alias("whitened"), share(k).alias("explained")) for k in range(min(components, len(model.sums)))]))
    error = F.lit(identity_error(rows, model, components)).cast("double").alias("identity_error")
    return z.select("id", "deviation", each.alias("_c")).select(F.col("id").alias(row_id), "_c.component", F.lit(model.n).cast("long").alias("n"), "deviation", "_c.whitened", "_c.explained", error)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as long where 64 bits hold it, else null; deviation_exact always has it."""
    out = whiten(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
