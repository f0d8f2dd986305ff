"""Embedding whitening: principal components of a distributed covariance, by mixed-precision refinement.

Tasks add up whole numbers, without rounding: entries become long x, the sums and the products of x less
its rounded mean are exact, and so is what the rounding of the mean left over. The covariance is one
division a cell. Its eigenvectors are found in float32 and corrected in extended precision by the
iteration of Ogita and Aishima (2018), which needs matrix products only. Eigenvalues that lie too close
for it to tell apart get a solve of their own, of the covariance within their span, less their mean
(Ogita and Aishima 2019). Only sums of dimension x dimension cells reach the driver, whatever the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domlake.llm import common

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
#: Entries of this size and more have no x that fits a long with room for a difference.
HUGE = 2.0 ** 55
#: Bytes of an exact sum: products of two such x, added up over more rows than any table has.
WIDE = 24
_EXACT = 1 << 53  # whole numbers below it are exact in a double


def scaled(vectors: DataFrame) -> DataFrame:
    """vectors with a column x (array of long); rows whose embedding is null or holds a null, a value that is
    not finite, or one beyond HUGE are left out."""
    whole = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < HUGE))
    return (vectors.where(F.col("embedding").isNotNull() & whole)
            .withColumn("x", F.transform("embedding", lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT).cast("long"))))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The long lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def packed(values) -> bytes:
    return b"".join(int(v).to_bytes(WIDE, "little", signed=True) for v in values)


def unpacked(data: bytes) -> np.ndarray:
    return np.array([int.from_bytes(data[i: i + WIDE], "little", signed=True) for i in range(0, len(data), WIDE)], object)


def products(z: np.ndarray) -> np.ndarray:
    """The sum over rows of each row's outer product, exact, as Python's whole numbers."""
    total = np.zeros((z.shape[1],) * 2, object)
    most = int(np.abs(z).max(initial=0))
    step = max(1, (_EXACT - 1) // max(1, most * most))
    for i in range(0, len(z), min(step, 1 << 14)):
        part = z[i: i + min(step, 1 << 14)]
        if most * most < _EXACT:
            part = part.astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        else:
            part = part.astype(object)
            total += part.T @ part
    return total


def summed(fit_list: DataFrame, size: int, middle: list[int] | None) -> tuple[int, np.ndarray]:
    """How many rows of x there are, and their exact sums (middle None), or else the exact sums of the products of
    x less middle, in rows. A task hands on its sums, one row of cells a message, and rows are added up apart."""
    def add(batches):
        n, total = 0, np.zeros((1 if middle is None else size, size), object)
        shift = None if middle is None else np.array(middle, np.int64)
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), size)
                n += len(x)
                if middle is None:
                    small = np.abs(x).max(initial=0) * len(x) < _EXACT
                    total[0] += x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
                else:
                    total += products(x - shift)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()),
                                              pa.array([packed(r) for r in total], pa.binary())], names=["at", "n", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(unpacked(s) for s in table.column("sums").to_pylist())
        return pa.table({"at": table.column("at").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "sums": pa.array([packed(total)], pa.binary())})

    rows = (fit_list.select("x").mapInArrow(add, "at int, n long, sums binary")
            .groupBy("at").applyInArrow(merge, "at int, n long, sums binary").orderBy("at").collect())
    return rows[0]["n"], np.array([unpacked(bytes(r["sums"])) for r in rows])


def eigen(cov: np.ndarray, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    cov = cov.astype(np.longdouble)
    size = float(np.abs(cov).max(initial=0)) or 1.0
    a = cov / np.longdouble(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm = float(np.sqrt((a * a).sum()))
    best = None
    for _ in range(steps):
        lost = np.eye(len(a), dtype=np.longdouble) - x.T @ x
        seen = x.T @ (a @ x)
        seen = (seen + seen.T) / 2  # rounding must not look like a lack of orthogonality
        value = np.diag(seen) / (1 - np.diag(lost))
        order = np.argsort(-value, kind="stable")
        x, value, lost, seen = x[:, order], value[order], lost[np.ix_(order, order)], seen[np.ix_(order, order)]
        off = seen - np.diag(np.diag(seen))
        wrong = float(np.sqrt((off * off).sum()) + norm * np.sqrt((lost * lost).sum()))
        if best is None or wrong < best[0]:
            best = wrong, value, x
        elif wrong <= 1e-17 * norm * len(a):  # no step makes it smaller any more
            break
        apart = value[None, :] - value[:, None]
        near = np.abs(apart) <= 1000 * wrong  # a correction of first order must be small
        fix = np.where(near, lost / 2, (seen + value[None, :] * lost) / np.where(near, 1, apart))
        np.fill_diagonal(fix, np.diag(lost) / 2)
        x = x + x @ fix
        # eigenvalues that could not be told apart: solve the matrix within their span, less their mean
        edges = np.flatnonzero(np.append(True, ~np.diag(near, 1)))
        for first, last in zip(edges, np.append(edges[1:], len(a)), strict=True):
            if last - first > 1:
                y = x[:, first:last]
                mean = value[first:last].mean()
                inner = y.T @ (a @ y) - mean * (y.T @ y)
                scale = float(np.abs(inner).max()) or 1.0
                turn = np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(np.float64))[1].astype(np.longdouble)
                turn = turn @ (3 * np.eye(len(turn), dtype=np.longdouble) - turn.T @ turn) / 2  # upright beyond double precision
                x[:, first:last] = y @ turn
    _, value, x = best
    x = x / np.sqrt((x * x).sum(axis=0))
    return value * np.longdouble(size), x


@dataclass
class Whitening:
    """n vectors of one size, their exact sums, and the components: directions (columns, over the root of the
    eigenvalue; NaN where there is no variance), shares of the variance (None without any)."""

    size: int
    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float | None]
    identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part of the mean is taken off before anything is rounded."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; None where it does not fit a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        z = x - whole
        most = (np.abs(z).max(initial=0).item() + 1) * self.n
        if most * most * self.size < 1 << 62:
            return ((z * self.n - rest) ** 2).sum(axis=1).tolist()
        wide = ((z.astype(object) * self.n - rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in wide]


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Components of the covariance of the distinct x of vectors (embedding); None without a usable vector.

    Vectors of the commonest length (the longest of those, in a tie) are the fit list, each distinct x once. A
    component whose variance is below the rounding of the largest, as when there are fewer vectors than
    dimensions, cannot be scaled to one: it is NaN. identity_error is measured on the whitened fit list."""
    x = common.staged(scaled(vectors.select("embedding")).select("x").distinct())
    sizes = x.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not sizes or not sizes[0]["size"]:
        return None
    size = sizes[0]["size"]
    listed = x.where(F.size("x") == size)
    n, total = summed(listed, size, None)
    sums = [int(s) for s in total[0]]
    middle = [(2 * s + n) // (2 * n) for s in sums]  # the rounded mean
    _, cells = summed(listed, size, middle)
    left = np.array([s - n * m for s, m in zip(sums, middle, strict=True)], object)
    exact = cells * n - np.multiply.outer(left, left)  # n * n times the covariance
    square = n * n
    cov = np.array([[np.longdouble(int(v // square)) + np.longdouble(int(v % square)) / np.longdouble(square) for v in r] for r in exact])
    value, vector = eigen(cov)
    trace = np.diag(cov).sum()
    floor = np.finfo(np.float64).eps * size * value[0]
    keep = min(components, size)
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(value[:keep] > max(floor, 0), 1 / np.sqrt(np.maximum(value[:keep], 0)), np.nan)
    explained = [float(max(v, 0) / trace) if trace > 0 else None for v in value[:keep]]
    model = Whitening(size, n, sums, (vector[:, :keep] * scale).astype(np.float64), explained)
    model.identity_error = identity_error(listed, model)
    return model


def identity_error(fit_list: DataFrame, model: Whitening) -> float | None:
    """The largest cell of the whitened fit list's covariance less the identity, over components with variance."""
    used = np.flatnonzero(~np.isnan(model.directions).any(axis=0))
    if not len(used):
        return None

    def add(batches):
        first, second = np.zeros(len(used)), np.zeros((len(used),) * 2)
        for b in batches:
            if b.num_rows:
                w = model.project(matrix(b.column("x"), model.size))[:, used]
                first += w.sum(axis=0)
                second += w.T @ w
        i, j = np.indices(second.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(i.ravel(), np.arange(len(used))), pa.int32()), pa.array(np.append(j.ravel(), np.full(len(used), -1)), pa.int32()),
             pa.array(np.append(second.ravel(), first))], names=["i", "j", "v"])

    cells = fit_list.select("x").mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean = {r["i"]: r["v"] / model.n for r in cells if r["j"] < 0}
    return max(abs(r["v"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in cells if r["j"] >= 0)


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id") -> DataFrame:
    """vectors (key, embedding): a row for each usable vector and component: key, component (from 1), n, deviation,
    whitened, explained, identity_error. Other columns are not read.

    Rows that repeat and null keys stay. A vector of another length than the fit list's has null deviation and
    whitened, a component without variance null whitened; deviation is null where it does not fit a long.
    Without a fit (no usable vector, or only empty ones) there are no rows. Very long vectors are whole."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = model.directions.shape[1]

    def judge(batches):
        for b in batches:
            column = b.column("x")
            fits = np.array([len(v) == model.size for v in column], bool) if b.num_rows else np.zeros(0, bool)
            whitened, deviation = np.full((b.num_rows, k), np.nan), [None] * b.num_rows
            if fits.any():
                x = matrix(column.filter(pa.array(fits)), model.size)
                whitened[fits] = model.project(x)
                for i, d in zip(np.flatnonzero(fits), model.deviation(x), strict=True):
                    deviation[i] = d
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            tiled = np.tile(np.arange(k), b.num_rows)
            flat = whitened.ravel()
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(at), pa.array(tiled + 1, pa.int32()), pa.array(np.full(len(flat), model.n), pa.int64()),
                 pa.array(deviation, pa.int64()).take(at), pa.array(flat, mask=np.isnan(flat)), pa.array(model.explained, pa.float64()).take(pa.array(tiled)),
                 pa.array([model.identity_error] * len(flat), pa.float64())],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return scaled(vectors.select(key, "embedding")).select(key, "x").mapInArrow(judge, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vectors, fit(vectors))
