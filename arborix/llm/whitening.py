"""Whitening of embeddings by spectrum slicing.

Sums and products of the integer entries are exact and added up by Spark, a row a pair of dimensions, so the covariance is the right one to
the last bit.  The driver holds the d x d covariance alone.  The inertia of LDL' of the covariance less a shift counts the eigenvalues below
the shift; bisection by such counts isolates each leading eigenvalue, Rayleigh quotient iteration takes it from there, and two more counts
certify its number."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, SHIFT = 1024, 100_000
#: Larger entries than a double can hold as an integer stand at this one.
MOST = float(1 << 52)
#: Rows whose centred entries are below this, so many at a time, have sums of products that a double holds exactly.
EXACT, ROWS = 1 << 20, 4096
EPS = np.finfo(float).eps


# -- spectrum of a symmetric matrix


def below(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a below the shift: the negative ones of D in LDL' of a - shift I, with 1 x 1 and 2 x 2 pivots
    (partial pivoting of Bunch and Kaufman), which by Sylvester's law has the inertia of the matrix."""
    w = a - shift * np.eye(len(a))
    tiny = EPS * EPS * (np.abs(w).max(initial=0.0) or 1.0)
    alpha, k, n, count = (1 + 17 ** 0.5) / 8, 0, len(w), 0

    def swap(i: int, j: int) -> None:
        if i != j:
            w[[i, j], :] = w[[j, i], :]
            w[:, [i, j]] = w[:, [j, i]]
    while k < n:
        rest = np.abs(w[k + 1:, k])
        size = 1
        if len(rest) and rest.max() > 0:
            r = k + 1 + int(rest.argmax())
            most = rest.max()
            if abs(w[k, k]) < alpha * most:
                other = np.abs(w[k:, r])
                other[r - k] = 0
                sigma = other.max()
                if abs(w[k, k]) * sigma < alpha * most * most:
                    if abs(w[r, r]) >= alpha * sigma:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
        if size == 1:
            d = w[k, k] if abs(w[k, k]) > tiny else tiny  # a shift on an eigenvalue counts it as above
            count += d < 0
            w[k + 1:, k + 1:] -= np.outer(w[k + 1:, k] / d, w[k + 1:, k])
        else:
            e = w[k:k + 2, k:k + 2]
            count += 1 if e[0, 0] * e[1, 1] - e[0, 1] * e[1, 0] < 0 else 2 * int(e[0, 0] < 0)
            c = w[k + 2:, k:k + 2]
            w[k + 2:, k + 2:] -= c @ np.linalg.solve(e, c.T)
        k += size
    return int(count)


def _solved(a: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    scale = np.abs(a).max(initial=0.0) or 1.0
    for bump in (0.0, EPS, 64 * EPS):
        try:
            x = np.linalg.solve(a - (shift + bump * scale) * np.eye(len(a)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    return b


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Eigenvalues that no shift can part are one cluster: its vectors are any orthonormal ones of its space."""
    d = len(v)
    k = min(k, d)
    scale = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if not k or scale == 0:
        return np.zeros(k), np.eye(d)[:, :k]
    a = v / scale
    known: dict[float, int] = {}

    def count(x: float) -> int:
        if x not in known:
            known[x] = below(a, x)
        return known[x]
    rng = np.random.default_rng(12)
    least = 32 * EPS
    values, vectors = np.zeros(d), np.zeros((d, 0))
    count(-1.1), count(1.1)
    while vectors.shape[1] < k:
        j = vectors.shape[1]
        place = d - 1 - j  # so many eigenvalues lie below the wanted one
        lo = max(x for x, c in known.items() if c <= place)
        hi = min(x for x, c in known.items() if c > place)
        while count(hi) - count(lo) > 1 and hi - lo > least:
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count(mid) <= place else (lo, mid)
        m = count(hi) - count(lo)
        if m > 1:
            m = d - j - count(lo)  # those of the cluster that aren't found yet
            x = rng.standard_normal((d, m))
            for _ in range(4):
                x -= vectors @ (vectors.T @ x)
                x, _ = np.linalg.qr(_solved(a, (lo + hi) / 2, x))
            x -= vectors @ (vectors.T @ x)
            x, _ = np.linalg.qr(x)
            values[j:j + m] = np.sort(np.sum(x * (a @ x), axis=0))[::-1]
            vectors = np.hstack([vectors, x])
            continue
        while True:
            shift = (lo + hi) / 2
            x = rng.standard_normal(d)
            for _ in range(2):
                x = _solved(a, shift, x)
                x /= np.linalg.norm(x)
            mu, was = float(x @ a @ x), np.inf
            for _ in range(12):  # converges cubically
                left = np.linalg.norm(a @ x - mu * x)
                if left < 4 * EPS or left >= was or not lo <= mu <= hi:
                    break
                was = left
                y = _solved(a, mu, x)
                x = y / np.linalg.norm(y)
                mu = float(x @ a @ x)
            # it is the wanted one if the counts on either side of it say so
            slack = max(4 * float(np.linalg.norm(a @ x - mu * x)), least)
            if slack < 1e-10 and count(mu - slack) <= place < count(mu + slack):
                break
            mid = (lo + hi) / 2
            if hi - lo <= least:  # the two counts that isolate it certify it
                break
            lo, hi = (mid, hi) if count(mid) <= place else (lo, mid)
        close = [i for i in range(j) if abs(values[i] - mu) < 1e-3]
        x -= vectors[:, close] @ (vectors[:, close].T @ x)
        x /= np.linalg.norm(x)
        values[j], vectors = mu, np.hstack([vectors, x[:, None]])
    return values[:k] * scale, vectors[:, :k]


# -- sums over the table


def _blocks(batch: pa.RecordBatch, dims: int) -> Iterator[np.ndarray]:
    """floor(1024 c) of a batch's vectors, ROWS at a time, as doubles."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    x = np.clip(np.floor(flat * SCALE), -MOST, MOST).reshape(-1, dims)
    for at in range(0, len(x), ROWS):
        yield x[at:at + ROWS]


def _pair_sums(dims: int, centre: list[int] | None):
    """A task's exact sums of entries (centre None: id i), or of products of centred entries (id i * dims + j, i <= j)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims if centre is None else (dims, dims), object)
        for batch in batches:
            for x in _blocks(batch, dims):
                if centre is None:
                    total = total + _whole(x, lambda y: y.sum(axis=0), np.abs(x).max(axis=1, initial=0) < 1 << 40)
                else:
                    y = x - np.array(centre, float)
                    total = total + _whole(y, lambda y: y.T @ y, np.abs(y).max(axis=1, initial=0) < EXACT)
        if centre is None:
            ids, values = range(dims), total
        else:
            i, j = np.triu_indices(dims)
            ids, values = (i * dims + j).tolist(), total[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(list(ids), pa.int64()), pa.array([Decimal(int(x)) for x in values], pa.decimal128(38, 0))], names=["id", "s"])
    return run


def _whole(x: np.ndarray, make, plain: np.ndarray) -> np.ndarray:
    """make(x) as Python integers: of plain rows in doubles, which hold it exactly, of others in integers of any size."""
    out = make(x[plain])
    out = np.vectorize(int, otypes=[object])(out)
    if not plain.all():
        out = out + make(np.vectorize(int, otypes=[object])(x[~plain]))
    return out


def _summed(rows: DataFrame, dims: int, centre: list[int] | None) -> dict[int, int]:
    parts = rows.select("v").mapInArrow(_pair_sums(dims, centre), "id bigint, s decimal(38,0)")
    return {r["id"]: int(r["s"]) for r in parts.groupBy("id").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}


def finite(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor holds null or non-finite entries, with it as doubles in v."""
    e = F.col(vector).cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn("v", e).filter(F.col("v").isNotNull() & good)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per remaining row and component: key, component (1, ...), n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries go; so do those of another length than most vectors have (ties: the longer).
    Empty vectors, and an empty table, give an empty result.  Entries beyond 2^52 stand at it.  Repeated rows, and rows of
    one or no key, are rows of their own.  A component without variance has no whitened values (null) and explains 0; deviation is
    null where it exceeds 64 bits.  Only the key and the vector are read."""
    spark = rows.sparkSession
    first = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    shape = f"{first}, deviation bigint, w array<double>"
    out = f"{first}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = finite(rows.select(key, vector), vector).select(key, "v")
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    dims = max(sizes, key=lambda d: (sizes[d], d), default=0)
    if not dims:
        return spark.createDataFrame([], out)
    n = sizes[dims]
    rows = rows.filter(F.size("v") == dims)
    sums = _summed(rows, dims, None)
    sums = [sums[i] for i in range(dims)]  # of floor(1024 c)
    centre = [round(s / n) for s in sums]
    left = [s - n * m for s, m in zip(sums, centre, strict=True)]  # what the whole centre leaves of the sums
    found = _summed(rows, dims, centre)
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * found[i * dims + j] - left[i] * left[j]) / (n * n)
    values, vectors = leading(cov, components)
    trace = float(np.trace(cov))
    flat = values <= dims * EPS * trace  # no variance but that of rounding
    make = np.where(flat, 0.0, vectors / np.sqrt(np.where(flat, 1.0, values)))
    names = [key, "deviation", "w"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.array([s / n for s in left])
        middle = np.array(centre, float)
        for batch in batches:
            for at, x in enumerate(_blocks(batch, dims)):
                y = x - middle
                w = (y - mean) @ make
                # the exact deviation n x - S = n y - left, in 64 bits where it fits
                far = (np.abs(y).max(axis=1, initial=0) + 1) * n
                fits = far < (1 << 62) ** 0.5 / dims ** 0.5
                dev = np.zeros(len(x), object)
                r = y[fits].astype(np.int64) * n - np.array(left, object).astype(np.int64) if fits.any() else np.zeros((0, dims), np.int64)
                dev[fits] = (r * r).sum(axis=1)
                if not fits.all():
                    r = np.vectorize(int, otypes=[object])(y[~fits]) * n - np.array(left, object)
                    dev[~fits] = (r * r).sum(axis=1)
                dev = [int(z) if z < 1 << 63 else None for z in dev]
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1])
                flatmask = np.tile(flat, len(x))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at * ROWS, len(x)), pa.array(dev, pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, pa.array(w.reshape(-1), mask=flatmask))], names=names)
    made = stored(rows.mapInArrow(project, shape), "whitened")
    k = len(values)
    use = [i for i in range(k) if not flat[i]]
    # covar_pop centres before it multiplies
    pairs = [(i, j) for i in use for j in use if i <= j]
    got = made.agg(F.count(F.lit(1)), *[F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs]).first()
    error = max((abs(x - (i == j)) for (i, j), x in zip(pairs, got[1:], strict=True)), default=None)
    share = F.array(*[F.lit(float(0.0 if f else e / trace)) for e, f in zip(values, flat, strict=True)])
    each = made.select(F.col(key), "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(key, (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                       share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
