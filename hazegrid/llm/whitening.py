"""Whitening of embeddings on their principal components, which come from QDWH spectral divide and conquer.

The covariance A is shifted by the mean of its eigenvalues, which lies between the least and the largest. The polar factor U of the shifted matrix has the
eigenvalues +1 above the shift and -1 below, so (I + U) / 2 projects on the space above. An orthonormal basis of that space and one of the rest turn
A into two smaller blocks, which are split in the same way until a block is one component. The polar factor is found by the QR-based, dynamically
weighted Halley iteration (QDWH), in at most about six steps. Spaces that hold none of the leading components are not split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import prepare
from hazegrid.llm.vector_codes import kept_vectors
from hazegrid.session import cut_lineage

COMPONENTS, SCALE = 4, 256
EPS = float(np.finfo(float).eps)


# ---- spectral divide and conquer


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH. Singular directions may come out between -1 and 1."""
    n = len(a)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value; too small a bound costs steps, not accuracy
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = float(np.clip(low, EPS, 1.0))
    for _ in range(20):
        d = np.cbrt(4 * (1 - low * low) / low ** 4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))[0]
        new = (wb / wc) * x + ((wa - wb / wc) / np.sqrt(wc)) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        moved, x = np.linalg.norm(new - x), new
        if moved < EPS ** (1 / 3) and 1 - low < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces with the larger and the smaller eigenvalues; None if all are equal to rounding."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    # an eigenvalue at the shift leaves no clear projector: move the shift a little, within the spectrum
    best, least = None, np.inf
    for off in (0.0, 0.03, -0.03, 0.11, -0.11, 0.19, -0.19):
        p = (np.eye(n) + polar(a - (mean + off * spread / np.sqrt(n)) * np.eye(n))) / 2
        rank = int(round(np.trace(p)))
        if not 0 < rank < n:
            continue
        basis = np.random.default_rng(0).standard_normal((n, n))
        basis[:, :rank] = p @ basis[:, :rank]
        for _ in range(2):
            basis = np.linalg.qr(basis)[0]
            basis[:, :rank] = p @ basis[:, :rank]
        basis = np.linalg.qr(basis)[0]
        up, down = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(down.T @ a @ up)
        if left < least:
            best, least = (up, down), left
        if left <= 10 * n * EPS * scale:
            break
    return best


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.linalg.norm(a))
    values, vectors = [], []
    waiting = [(np.eye(len(a)), a)] if len(a) else []
    while waiting and len(values) < most:
        basis, block = waiting.pop()
        halves = _split(block, scale) if len(block) > 1 else None
        if halves is None:
            # one component, or several with one eigenvalue, of which any basis will do
            for i in np.argsort(-np.diag(block), kind="stable").tolist():
                values.append(float(block[i, i]))
                vectors.append(basis[:, i])
            continue
        for half in reversed(halves):
            inner = half.T @ block @ half
            waiting.append((basis @ half, (inner + inner.T) / 2))
    if not values:
        return np.zeros(0), np.zeros((len(a), 0))
    v = np.stack(vectors[:most], axis=1)
    return np.array(values[:most]), v / np.linalg.norm(v, axis=0)


# ---- moments of the fit list


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    if len(flat) != batch.num_rows * width:
        raise ValueError(f"all vectors must have {width} components")
    return flat.reshape(batch.num_rows, width)


def _sums(width: int):
    """Per task the number of vectors (at -1) and the sum of each component."""
    def run(batches):
        total, n = np.zeros(width, np.int64), 0
        for batch in batches:
            total += _matrix(batch, width).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(np.r_[n, total])], names=["i", "total"])
    return run


def _products(width: int, mean: np.ndarray, onto: np.ndarray | None = None):
    """Per task the sums of products of each two components of x - mean, or of that multiplied by `onto`."""
    def run(batches):
        size = width if onto is None else onto.shape[1]
        total = np.zeros((size, size))
        for batch in batches:
            y = _matrix(batch, width) - mean
            y = y if onto is None else y @ onto
            total += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])
    return run


def _covariance(fit: DataFrame, size: int, n: int, products) -> np.ndarray:
    rows = fit.mapInArrow(products, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).toPandas()
    out = np.zeros((size, size))
    out[rows["i"], rows["j"]] = rows["total"] / n
    out[rows["j"], rows["i"]] = rows["total"] / n
    return out


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over components of (n x - S)^2, exact; None beyond a long."""
    if len(x) == 0:
        return []
    reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if reach * reach * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in (n * x.astype(object) - sums.astype(object)).tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row with a finite vector and each of the leading
    `components`.

    The components are those of the distinct whole-number vectors floor(scale * c), so that copies, however many, count once; they are
    combined in the task before the shuffle. Spark adds up sums and centred products per task; what reaches the driver is one matrix of
    width x width, which is split there. The components (width x `components` numbers) go to the tasks with the function. Runs jobs; the
    fit list goes to the shared folder.

    Rows whose vector is null or holds null or non-finite components are left out; null ids and repeated rows stay, each with its
    rows. A component without variance (rank below `components`, or one distinct vector) has whitened and explained 0 and no part in
    identity_error. Of equal eigenvalues any basis is taken, the same for all rows. Vectors of fewer than `components` components give as many. A deviation beyond a
    long is null. An empty table gives an empty result; other columns are ignored. Vectors of different lengths are a ValueError."""
    spark = df.sparkSession
    prepare(spark)
    rows = kept_vectors(df, id_col, vector_col)
    ids = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {ids}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select("vec_id", F.transform("vector", lambda c: F.floor(c * scale)).alias("x"))
    fit = cut_lineage(rows.select("x").distinct(), "fit-list")
    first = fit.select(F.size("x").alias("width")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = first["width"]
    totals = dict(fit.mapInArrow(_sums(width), "i int, total long").groupBy("i").agg(F.sum("total").alias("total")).collect())
    n, sums = totals[-1], np.array([totals[i] for i in range(width)], np.int64)
    mean = sums / n
    cov = _covariance(fit, width, n, _products(width, mean))
    values, vectors = leading_components(cov, components)
    trace = float(np.trace(cov))
    real = values > width * EPS * max(trace, 0.0)
    onto = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values / (trace or 1.0), 0.0)
    k = len(values)
    unit = _covariance(fit, k, n, _products(width, mean, onto)) - np.diag(real.astype(float))
    error = float(np.abs(unit).max(initial=0.0))

    def apply(batches):
        for batch in batches:
            x = _matrix(batch, width)
            m = batch.num_rows
            at = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n, np.int64)),
                 pa.array(_deviation(x, n, sums), pa.int64()).take(at), pa.array(((x - mean) @ onto).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)
