"""Operator 12: embedding whitening by a Jacobi-Davidson iteration on centred products.

The covariance of the fit list (each distinct vector once) is never formed: what the iteration asks
for is its product with a few directions at a time, and Spark makes that in one pass, rows centred
before they are multiplied, partial products summed in two steps. The driver holds a search
space of at most MOST_DIRECTIONS vectors of the embedding's dimension. Each step takes the Ritz pairs
of that space, locks those whose residual has reached double precision, and widens it by
corrections: projected equations, solved for all open pairs in step by MINRES, one pass an inner step.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are
rows whose vector has another length than most (of equally frequent lengths the longest stays); repeated rows give
repeated results; components without variance are left out (one distinct vector has none, and so gives no rows);
entries and deviations beyond 64 bits are held at their bound and null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.llm.common import table, written

COMPONENTS, SCALE = 4, 256
#: Directions at the start and after a restart, and at most; inner steps of a correction.
START_DIRECTIONS, MOST_DIRECTIONS, SPARE, INNER_STEPS, OUTER_STEPS = 16, 48, 4, 2, 200
SEED, SLOTS = 12, 16
EPS = float(np.finfo(float).eps)


def whole_vectors(df: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): the rows that stay, x = floor(scale * c) of their entries."""
    c = F.col(vector).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    out = df.where(F.coalesce((F.size(c) > 0) & F.forall(c, finite), F.lit(False)))
    x = F.transform(c, lambda v: F.floor(v * float(scale)).cast("long"))
    out = out.select(F.col(id).alias("id"), x.alias("x"))
    lengths = out.groupBy(F.size("x").alias("n")).agg(F.count("*").alias("rows"))
    usual = lengths.agg(F.max(F.struct("rows", "n")).alias("m")).select("m.n").scalar()
    return out.where(F.size("x") == usual)


def rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Moments:
    n: int
    sums: tuple[int, ...]
    squares: int  # of all entries

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def trace(self) -> float:
        """Of the covariance; the numerator is exact."""
        return (self.n * self.squares - sum(s * s for s in self.sums)) / self.n**2


def moments(fit: DataFrame) -> Moments | None:
    """Exact sums of the fit list. Each is given to Spark's sum in two parts, so that squares of 64 bits have room."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, None, 0
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                most = max(abs(int(x.max())), abs(int(x.min())))
                x = x if len(x) * x.shape[1] * max(most, 1) ** 2 < 1 << 62 else x.astype(object)
                own = [int(s) for s in x.sum(axis=0)]
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
                n, squares = n + len(x), squares + int((x * x).sum())
        if n:
            numbers = [n, squares, *sums]
            yield pa.RecordBatch.from_pydict({"k": list(range(len(numbers))), "high": [str(v >> 60) for v in numbers], "low": [v & (1 << 60) - 1 for v in numbers]})

    parts = fit.select("x").mapInArrow(partial, "k long, high string, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("k").agg(total("high"), total("low")).orderBy("k").collect()  # a row per dimension
    if not rows:
        return None
    n, squares, *sums = ((int(r.high) << 60) + int(r.low) for r in rows)
    return Moments(n, tuple(sums), squares)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over the fit list of part(rows): a partial sum a task, SLOTS of partial sums on the way, those to the driver.

    Partial sums are added in the order of their tasks, so that a rerun over the same files gives the same bits.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(rows_of(batch.column(0)).astype(float))
        k = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"slot": pa.array([k % SLOTS], pa.int32()), "k": pa.array([k], pa.int32()), "sum": pa.array([total.tobytes()], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"slot": pdf["slot"].iloc[:1], "sum": [sum(np.frombuffer(b) for b in pdf["sum"]).tobytes()]})

    parts = fit.select("x").mapInArrow(partial, "slot int, k int, sum binary")
    rows = sorted(parts.groupBy("slot").applyInPandas(add, "slot int, sum binary").collect())
    return sum((np.frombuffer(r["sum"]) for r in rows), np.zeros(shape[0] * shape[1])).reshape(shape)


def centred_product(fit: DataFrame, mean: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Q -> V Q for the covariance V of the fit list, without V."""

    def product(q: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ q)

        return summed(fit, part, q.shape) / n

    return product


def orthonormal(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The directions of t that the bases lack, orthonormal; those that they span already are left out."""
    out = np.zeros((t.shape[0], 0))
    for k in range(t.shape[1]):
        v = t[:, k]
        size = np.linalg.norm(v)
        for _ in range(3):  # again, as the first time leaves rounding errors
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            out = np.column_stack([out, v / left])
    return out


def corrections(product: Callable[[np.ndarray], np.ndarray], locked: np.ndarray, u: np.ndarray, theta: np.ndarray, r: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t_j of (I - PP')(V - theta_j I)(I - PP') t_j = -r_j, P = [locked, u], all by MINRES in step."""
    p = np.column_stack([locked, u])
    off = lambda a: a - p @ (p.T @ a)
    v = off(-r)
    beta = np.linalg.norm(v, axis=0)
    first = np.where(beta > 0, beta, 1)
    v = v / first
    before, w_before, w = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    t, eta, beta_k = np.zeros_like(v), beta.copy(), np.zeros_like(beta)
    c = c_before = np.ones_like(beta)
    s = s_before = np.zeros_like(beta)
    for _ in range(steps):
        a = off(product(v) - v * theta)
        alpha = (v * a).sum(axis=0)
        a = a - v * alpha - before * beta_k
        beta_next = np.linalg.norm(a, axis=0)
        rho1_hat = c * alpha - c_before * s * beta_k
        rho1 = np.hypot(rho1_hat, beta_next)
        rho2, rho3 = s * alpha + c_before * c * beta_k, s_before * beta_k
        some = rho1 > 0
        c_before, s_before = c, s
        safe = np.where(some, rho1, 1)
        c, s = np.where(some, rho1_hat / safe, 1), np.where(some, beta_next / safe, 0)
        w_before, w = w, np.where(some, (v - w_before * rho3 - w * rho2) / safe, 0)
        t = t + w * (c * eta)
        eta = -s * eta
        before, beta_k = v, beta_next
        v = np.where(beta_next > 1e-300, a / np.where(beta_next > 1e-300, beta_next, 1), 0)
        if (np.abs(eta) <= 1e-3 * first).all():
            break
    return off(t)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """The wanted largest eigenvalues, falling, their unit eigenvectors as columns, and the largest residual.

    scale: a bound of the eigenvalues, the trace. A pair is locked when its residual is down to the rounding errors of the
    products. What is locked is then held against fresh random directions, as a search space may have missed an eigenvector.
    """
    rng = np.random.default_rng(SEED)
    wanted = min(wanted, dimension)
    locked, values = np.zeros((dimension, 0)), []
    space = orthonormal(rng.standard_normal((dimension, min(START_DIRECTIONS, dimension))))
    images = product(space)
    worst, low, since, checked = 0.0, np.inf, 0, False
    for _ in range(OUTER_STEPS):
        h = space.T @ images
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        space, images = space @ y, images @ y
        top = max([scale / dimension, *values, *theta[:1]])
        open_ = min(wanted - len(values), space.shape[1])
        r = images[:, :open_] - space[:, :open_] * theta[:open_]
        r = r - locked @ (locked.T @ r)
        norms = np.linalg.norm(r, axis=0)
        # the products' rounding errors end what a residual can lose: one that has stood still there is done too
        still = norms[0] <= 1e-12 * top and since >= 3 if open_ else False
        if open_ and (norms[0] <= 2 * np.sqrt(dimension) * EPS * top or still):
            locked, values = np.column_stack([locked, space[:, 0] / np.linalg.norm(space[:, 0])]), [*values, theta[0]]
            space, images, worst, low, since = space[:, 1:], images[:, 1:], max(worst, norms[0]), np.inf, 0
            if not space.shape[1] and len(values) < dimension:
                space = orthonormal(rng.standard_normal((dimension, START_DIRECTIONS)), locked)
                images = product(space)
            if len(values) < wanted:
                continue
        elif open_:
            low, since = (norms[0], 0) if norms[0] < 0.5 * low else (low, since + 1)
        if len(values) == wanted:
            if checked or space.shape[1] + len(values) >= dimension:
                if not space.shape[1] or theta_of(space, images) <= min(values) * (1 + 1e-9) + EPS * scale:
                    break
                # something larger than the smallest that is locked: that one was not wanted yet
                k = int(np.argmin(values))
                back = locked[:, k : k + 1]
                space, images = np.column_stack([space, back]), np.column_stack([images, back * values[k]])
                locked, values, checked = np.delete(locked, k, axis=1), values[:k] + values[k + 1 :], False
                continue
            more, checked = rng.standard_normal((dimension, START_DIRECTIONS)), True
        else:
            # the next pairs cost no pass of their own and part the wanted ones from the rest
            near = min(len(theta), open_ + SPARE)
            r = images[:, :near] - space[:, :near] * theta[:near]
            more = corrections(product, locked, space[:, :near], theta[:near], r - locked @ (locked.T @ r), INNER_STEPS)
        if space.shape[1] + more.shape[1] > MOST_DIRECTIONS:
            space, images = space[:, :START_DIRECTIONS], images[:, :START_DIRECTIONS]
        fresh = orthonormal(more, locked, space)
        if not fresh.shape[1]:
            fresh = orthonormal(rng.standard_normal((dimension, 2)), locked, space)
        if fresh.shape[1]:
            space, images = np.column_stack([space, fresh]), np.column_stack([images, product(fresh)])
        elif len(values) < wanted:  # the space is whole: its Ritz pairs are as good as they get
            low, since = min(low, norms[0]), since + 1
    else:
        raise ValueError("the eigenvectors were not found to double precision")
    order = np.argsort(values)[::-1]
    return np.array(values)[order], locked[:, order], worst


def theta_of(space: np.ndarray, images: np.ndarray) -> float:
    h = space.T @ images
    return float(np.linalg.eigvalsh((h + h.T) / 2)[-1])


@dataclass(frozen=True)
class Whitening:
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray  # a column per component
    residual: float
    identity_error: float


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The components of the distinct vectors x of a table; None if there is no vector."""
    fit = written(vectors.select("x").distinct(), "fit")
    m = moments(fit)
    if m is None:
        return None
    d = len(m.sums)
    values, q, residual = np.zeros(0), np.zeros((d, 0)), 0.0
    if m.trace > 0:
        values, q, residual = jacobi_davidson(centred_product(fit, m.mean, m.n), d, components, m.trace)
        some = values > d * EPS * m.trace
        values, q = values[some], q[:, some]
    k, error, mean = len(values), 0.0, m.mean
    if k:
        across = q / np.sqrt(values)

        def part(x: np.ndarray) -> np.ndarray:
            z = (x - mean) @ across
            return np.vstack([z.T @ z, z.sum(axis=0)])

        sums = summed(fit, part, (k + 1, k)) / m.n
        error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return Whitening(m, values, q, residual, error)


def whitened(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """Per row and component: id, component, n, deviation, whitened, explained, identity_error."""
    n, sums, mean = fit.moments.n, fit.moments.sums, fit.moments.mean
    across, explained, error, k = fit.vectors / np.sqrt(fit.values), fit.values / fit.moments.trace if fit.moments.trace else fit.values, fit.identity_error, len(fit.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        most = n * max(abs(int(x.max())), abs(int(x.min()))) + max(abs(s) for s in sums)
        if most * most * x.shape[1] < 1 << 62:
            return (((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1)).tolist()
        exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = rows_of(batch.column(1))
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), n, np.int64)),
                    pa.array(deviations(x), pa.int64()).take(pa.array(rows)), pa.array(((x - mean) @ across).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error)),
                ],
                names,
            )

    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = T.StructType([vectors.schema["id"], *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    return vectors.select("id", "x").mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    fit = fitted(vectors)
    if fit is None:
        return whitened(vectors, Whitening(Moments(1, (0,), 0), np.zeros(0), np.zeros((1, 0)), 0.0, 0.0)).withColumnRenamed("id", "vec_id")
    return whitened(vectors, fit).withColumnRenamed("id", "vec_id")
