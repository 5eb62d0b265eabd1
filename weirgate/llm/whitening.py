"""Operator 12: embeddings whitened by the principal components of all of them.

Sums and the centred scatter are added up exactly, as whole numbers: tasks
multiply centred entries in blocks so small that doubles hold every sum, and
Spark adds the tasks' sums as decimals. So neither the order of rows nor the
number of tasks changes a digit. The scatter has one entry for each pair of
dimensions; on the driver a Cholesky factorisation with pivots makes it a
triangular factor, and one-sided Jacobi rotations of that factor's columns make
them orthogonal: squares of their norms are the eigenvalues, and the columns at
length one the components. The covariance itself is never rotated.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Entries become ``floor(SCALE * c) + SHIFT``; so many components are given at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Vectors with an entry beyond this are dropped: their whole numbers would not be exact.
MOST = 2.0**40
_EXACT = 2**53


def whole_numbers(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors: the length, the places of its usable vectors and their whole numbers."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore"):
        bad = ~(np.abs(values) <= MOST)
    ends = np.cumsum(lengths)
    bads = np.concatenate(([0], np.cumsum(bad)))
    usable = (lengths > 0) & (bads[ends] == bads[ends - lengths])
    for size in np.unique(lengths[usable]).tolist():
        rows = np.flatnonzero(usable & (lengths == size))
        at = (ends[rows] - size)[:, None] + np.arange(size)
        yield size, rows, np.floor(SCALE * values[at]).astype(np.int64) + SHIFT


def scatter(y: np.ndarray) -> np.ndarray:
    """The exact ``y.T @ y`` of whole numbers, as Python's."""
    most = int(np.abs(y).max(initial=1))
    rows = _EXACT // max(1, most * most)
    total = np.zeros((y.shape[1],) * 2, object)
    if not rows:
        some = y.astype(object)
        return total + some.T @ some
    for at in range(0, len(y), rows):
        some = y[at : at + rows].astype(np.float64)
        total += (some.T @ some).astype(np.int64)
    return total


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``l`` with ``l @ l.T = v`` and as many columns as ``v`` has rank; its rows, in the order of pivots, are triangular."""
    v = v.astype(np.longdouble)
    d = len(v)
    left = np.diag(v).copy()
    l = np.zeros((d, d), np.longdouble)  # noqa: E741
    open_rows = np.ones(d, bool)
    least = d * np.finfo(np.float64).eps * left.max(initial=0)
    for k in range(d):
        at = int(np.where(open_rows, left, -1).argmax())
        if not left[at] > least:
            return l[:, :k]
        root = np.sqrt(left[at])
        column = (v[:, at] - l[:, :k] @ l[at, :k]) / root
        open_rows[at] = False
        l[:, k] = np.where(open_rows, column, 0)
        l[at, k] = root
        left = left - l[:, k] ** 2
    return l


def jacobi(l: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Eigenvalues of ``l @ l.T``, falling, and its unit eigenvectors, by rotations of pairs of columns; disjoint pairs turn together."""
    a = np.array(l, np.longdouble)
    n = a.shape[1]
    if not n:
        return np.zeros(0), np.zeros((len(a), 0))
    ring = list(range(n + n % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(i, j) for i, j in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if i < n and j < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.where(size > 0, np.abs(xy) / np.where(size > 0, size, 1), 0)
            worst = max(worst, float(off.max()))
            turn = off > np.finfo(np.longdouble).eps
            zeta = (yy - xx) / (2 * np.where(turn, xy, 1))
            t = np.where(turn, np.where(zeta < 0, -1, 1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta)), 0)
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * (x - t * y), c * (y + t * x)
        if worst < 1e-17:
            break
    e = (a * a).sum(0)
    order = np.argsort(-e, kind="stable")
    u = a[:, order] / np.sqrt(e[order])
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(n)] < 0, -1, 1)
    return e[order].astype(np.float64), u.astype(np.float64)


def _sums(rows: Iterator[tuple[int, int, int]], names: str) -> pa.RecordBatch:
    """Rows of two numbers and one that may be long, as text."""
    a, b, c = zip(*rows, strict=True) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(map(str, c), pa.string())], names=names.split())


class Whitening:
    """What ``fit`` learned: ``n``, ``size``, ``sums``, ``values`` and ``components`` as columns, ``explained``, ``identity_error``."""

    def __init__(self, n: int, size: int, sums: list[int]):
        self.n, self.size, self.sums = n, size, sums
        self.centre = np.array([(2 * s + n) // (2 * n) if n else 0 for s in sums], np.int64)
        self.rest = [s - n * int(c) for s, c in zip(sums, self.centre, strict=True)]
        self.values, self.components, self.explained, self.identity_error = np.zeros(0), np.zeros((size, 0)), np.zeros(0), 0.0

    def learn(self, total: np.ndarray, most: int) -> None:
        """Components from the scatter around ``centre``."""
        rest = np.array(self.rest, object)
        exact = self.n * total - rest[:, None] * rest[None, :]
        v = np.array([[float(Fraction(x, self.n * self.n)) for x in row] for row in exact], np.float64).reshape(self.size, self.size)
        values, vectors = jacobi(pivoted_cholesky(v))
        trace = float(Fraction(sum(exact.diagonal().tolist()), self.n * self.n))
        self.values, self.components = values[:most], vectors[:, :most]
        self.explained = self.values / trace if trace else self.values

    def whitened(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return ((x - self.centre) - mean) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """``sum((n * x - S)^2)``; null where a long can't hold it."""
        y, rest = x - self.centre, np.array(self.rest, object)
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * max(1, self.size) < 2**63:
            return ((self.n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
        return [d if d < 2**63 else None for d in ((self.n * y.astype(object) - rest) ** 2).sum(1).tolist()]


def fit(vectors: DataFrame, column: str, scratch: Scratch, components: int = COMPONENTS) -> Whitening:
    """Whitening learned from all usable vectors of a column of arrays.

    Left out are null and empty vectors, those with an entry that is null, not
    finite or beyond ``MOST``, and those of another length than the most
    frequent one (of two, the shorter). Equal rows count each. Without usable
    vectors, or where all are equal, there are no components. The driver gets
    one number for each pair of dimensions.
    """
    spark = vectors.sparkSession
    column = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for size, _, x in whole_numbers(batch.column("v")):
                n, total = sums.get(size, (0, np.zeros(size, object)))
                sums[size] = n + len(x), total + x.sum(0).astype(object)
        yield _sums(((size, k, s) for size, (n, total) in sums.items() for k, s in enumerate([n, *total.tolist()])), "size at total")

    added = column.mapInArrow(add_up, "size int, at int, total string").groupBy("size", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    added = scratch.write(added, "sums")
    best = added.where("at = 0").orderBy(F.desc("total"), "size").limit(1).collect()
    if not best:
        return Whitening(0, 0, [])
    size = best[0]["size"]
    totals = {r["at"]: int(r["total"]) for r in added.where(F.col("size") == size).collect()}
    model = Whitening(totals[0], size, [totals[k + 1] for k in range(size)])
    centre = model.centre

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object)
        for batch in batches:
            for n, _, x in whole_numbers(batch.column("v")):
                if n == size:
                    total = total + scatter(x - centre)
        yield _sums(((i, j, total[i, j]) for i in range(size) for j in range(i, size)), "i j total")

    total = np.zeros((size, size), object)
    for r in column.mapInArrow(multiply, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        total[r["i"], r["j"]] = total[r["j"], r["i"]] = int(r["total"])
    model.learn(total, components)
    most = len(model.values)
    if not most:
        return model
    sent = spark.sparkContext.broadcast(model)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((most, most)), np.zeros(most)
        for batch in batches:
            for n, _, x in whole_numbers(batch.column("v")):
                if n == size:
                    w = sent.value.whitened(x)
                    products, sums = products + w.T @ w, sums + w.sum(0)
        exact = lambda x: format(x, ".15f")
        yield _sums([*((i, j, exact(products[i, j])) for i in range(most) for j in range(i, most)), *((i, -1, exact(sums[i])) for i in range(most))], "i j total")

    found = {(r["i"], r["j"]): float(r["total"]) / model.n for r in column.mapInArrow(check, "i int, j int, total string").groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,15)")).alias("total")).collect()}
    model.identity_error = max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(most) for j in range(i, most))
    return model


def whiten(vectors: DataFrame, column: str, model: Whitening) -> DataFrame:
    """``vectors`` with ``whitened``, an array of one double a component, and ``deviation`` from the mean, without those that ``fit`` leaves out.

    Columns named ``whitened`` or ``deviation`` are replaced, others come through.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in whole_numbers(batch.column("_v")):
                if size == sent.value.size:
                    w = sent.value.whitened(x)
                    offsets = pa.array((np.arange(len(rows) + 1) * w.shape[1]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(rows)), lists, pa.array(sent.value.deviation(x), pa.int64())], names=["_row", "whitened", "deviation"])

    others = [c for c in vectors.columns if c not in ("whitened", "deviation")]
    rows = vectors.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("_row"), F.col(f"`{column}`").cast("array<double>").alias("_v"))
    out = rows.mapInArrow(run, T.StructType().add(rows.schema["_row"]).add("whitened", T.ArrayType(T.DoubleType())).add("deviation", "long"))
    return out.select("_row.*", "whitened", "deviation")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(table, "embedding", Scratch(spark, "op12"))
    rows = whiten(table, "embedding", model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, map(float, model.explained))).cast("array<double>"), F.col("_at") + 1) if len(model.values) else F.lit(None).cast("double")
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(model.identity_error)).alias("identity_error"))
