"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers x, so counts and sums are exact. Tasks centre their rows
(n x - S is exact too) and reduce them by QR, block by block, to one triangle; triangles
are stacked and reduced again, a bounded number at a time, until one is left. That triangle
R has the singular values of all centred rows and is as large as one vector squared,
whatever the number of rows. The driver takes it to bidiagonal form by Householder
reflections, finds its singular values by differential quotient-difference sweeps with
shifts (dqds: only products and sums of positive numbers, so small values keep their
digits), and each wanted direction by a twisted factorisation of the bidiagonal's B'B at its
value. Covariances are never formed, so no digits are lost to squaring.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasestream.plans.stage import shared_folder

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000
#: Entries from here on have no exact whole number x in a long; they count as not finite.
LARGEST = 2.0**42
#: Triangles reduced in one task, and rows in one QR.
FAN_IN = 64
ROWS = 4096
EPS = np.finfo(float).eps


# ---- rows ------------------------------------------------------------------------------


def vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a batch that have a whole vector of `dim` entries, and their x."""
    column = batch.column("embedding")
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(size == dim)
    entries = column.take(pa.array(rows)).flatten().cast(pa.float64())
    c = pc.fill_null(entries, float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), dim)
    with np.errstate(invalid="ignore"):
        good = (np.abs(c) < LARGEST).all(axis=1)
    return rows[good], np.floor(SCALE * c[good]).astype(np.int64) + OFFSET


def dimension(rows: DataFrame) -> int:
    """The length that most vectors have (the longest of those, on a tie); 0 without any."""
    sizes = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return most["d"] if most else 0


def sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and S: the vectors, and the sum of x in each dimension. Sums are decimals, so they
    are exact for any number of rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                _, x = vectors(batch.slice(low, ROWS), dim)
                if len(x):
                    # 4096 entries of 2^52 would not fit in a long: high and low halves apart.
                    high, rest = (x >> 26).sum(axis=0), (x & ((1 << 26) - 1)).sum(axis=0)
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array(range(dim), pa.int32()), "n": pa.array([len(x)] * dim, pa.int64()),
                        "high": pa.array(high, pa.int64()), "rest": pa.array(rest, pa.int64())})

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = rows.select("embedding").mapInArrow(add, "dim int, n long, high long, rest long")
    found = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), whole("high"), whole("rest")).collect())
    return (found[0]["n"], [(int(r["high"]) << 26) + int(r["rest"]) for r in found]) if found else (0, [])


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n x - S, exact: longs where they fit, else Python's integers."""
    limit = int(np.abs(x).max(initial=0)) * n + max(map(abs, total), default=0)
    kind = np.int64 if limit < 1 << 62 else object
    return x.astype(kind) * n - np.array(total, kind)


def squared(d: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where it does not fit in a long."""
    top = int(np.abs(d).max(initial=0))
    if d.dtype != object and top**2 * d.shape[1] < 1 << 62:
        return (d * d).sum(axis=1).tolist()
    out = [int(v) for v in (d.astype(object) ** 2).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in out]


# ---- QR --------------------------------------------------------------------------------


def _stacked(top: np.ndarray | None, block: np.ndarray) -> np.ndarray:
    """The triangle of two blocks of rows, one below the other."""
    return np.linalg.qr(block if top is None else np.vstack([top, block]), mode="r")


def _reduced(rows: DataFrame, blocks: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> DataFrame:
    """One triangle for each task that has rows, written to the shared folder."""
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for block in blocks(batch):
                if len(block):
                    r = _stacked(r, block)
        if r is not None:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(r)], pa.int32()), "r": pa.array([r.tobytes()], pa.binary())})

    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/whiten-{uuid.uuid4().hex}"
    rows.mapInArrow(reduce, "rows int, r binary").write.parquet(path)
    return spark.read.schema("rows int, r binary").parquet(path)


def triangle(rows: DataFrame, dim: int, n: int, total: list[int]) -> np.ndarray:
    """R of the QR decomposition of all centred rows."""
    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for low in range(0, batch.num_rows, ROWS):
            _, x = vectors(batch.slice(low, ROWS), dim)
            yield deviations(x, n, total).astype(float) / n

    def given(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for k, cell in zip(batch.column("rows").to_pylist(), batch.column("r").to_pylist()):
            yield np.frombuffer(cell).reshape(k, dim)

    parts = _reduced(rows.select("embedding"), centred)
    while (count := parts.count()) > FAN_IN:
        parts = _reduced(parts.repartition(-(-count // FAN_IN)), given)
    r = None
    for row in parts.collect():  # at most FAN_IN triangles
        r = _stacked(r, np.frombuffer(row["r"]).reshape(row["rows"], dim))
    square = np.zeros((dim, dim))
    if r is not None:
        square[: len(r)] = r
    return square


# ---- the solver ------------------------------------------------------------------------


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Householder reduction of a square matrix to an upper bidiagonal one: its diagonal, what
    stands above it, and the reflections that were applied to columns (place, unit vector)."""
    a, d, right = a.astype(float).copy(), len(a), []

    def reflection(x: np.ndarray) -> np.ndarray:
        scale = np.abs(x).max(initial=0)
        v = x / scale if scale else x.copy()
        if not v[1:].any():
            return np.zeros_like(v)
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflection(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def dqds(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One differential sweep with a shift: the new q and e, and the smallest d met (below 0
    if the shift was above the smallest value)."""
    q_new, e_new = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    least = d
    for k in range(len(e)):
        q_new[k] = d + e[k]
        ratio = q[k + 1] / q_new[k] if q_new[k] else 0.0
        e_new[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    q_new[-1] = d
    return q_new, e_new, least


def singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """All singular values of an upper bidiagonal matrix, falling."""
    scale = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if not scale:
        return np.zeros(len(diagonal))
    q, e = (diagonal / scale) ** 2, (above / scale) ** 2
    found, blocks = [], [(q, e, 0.0)]
    while blocks:
        q, e, moved = blocks.pop()
        while True:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            # Negligible couplings split the matrix.
            cut = np.flatnonzero(e <= EPS**2 * (moved + np.minimum(q[:-1], q[1:])))
            if len(cut):
                blocks += [(q[: cut[0] + 1], e[: cut[0]], moved), (q[cut[0] + 1 :], e[cut[0] + 1 :], moved)]
                break
            if not q.all():
                # A zero on the diagonal: a sweep without shift takes it to the end.
                q, e, _ = dqds(q, e, 0.0)
                if not q[-1]:
                    found.append(moved)
                    q, e = q[:-1], e[:-1]
                continue
            if q[0] < q[-1] / 4:  # graded the wrong way: turn the matrix round
                q, e = _turned(q, e)
            shift = _shift(q, e)
            while shift:
                next_q, next_e, least = dqds(q, e, shift)
                if least >= 0 and np.isfinite(next_q).all():
                    break
                shift = shift / 4 if shift > EPS * q.min() else 0.0
            else:
                next_q, next_e, _ = dqds(q, e, 0.0)
            q, e, moved = next_q, next_e, moved + shift
    return scale * np.sqrt(np.sort(np.maximum(found, 0.0))[::-1])


def _turned(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same singular values from the other end (the matrix transposed and turned)."""
    return q[::-1].copy(), e[::-1].copy()


def _shift(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the smallest value, from the last two rows and Gershgorin's discs of
    the unsquared matrix; 0 where none is known."""
    a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], np.sqrt(q[-2] * e[-1])
    low = (a + b) / 2 - np.hypot((a - b) / 2, c)
    root_q, root_e = np.sqrt(q), np.sqrt(e)
    around = np.r_[root_e, 0.0] + np.r_[0.0, root_e]
    disc = (root_q - around / 2).min()
    sure = disc**2 if disc > 0 else 0.0
    return max(sure, min(low, q[-1]) * (1 - 1e-2) if low > 0 else 0.0)


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """The right singular vector of a bidiagonal matrix at a singular value: B'B - value^2 is
    factored from the top and from the bottom, and the two are joined where they leave the
    smallest remainder."""
    d = len(diagonal)
    scale = max(np.abs(diagonal).max(), np.abs(above).max(initial=0)) or 1.0
    diagonal, above, t = diagonal / scale, above / scale, (value / scale) ** 2
    tiny = EPS**2
    # Entries of B'B: a on the diagonal, b beside it.
    a, b = diagonal**2 + np.r_[0.0, above**2], diagonal[:-1] * above
    # Top down (stationary): the differential form keeps s = plus - diagonal^2 apart.
    plus, low, s = np.empty(d), np.empty(d - 1), np.empty(d)
    s[0] = -t
    for k in range(d):
        plus[k] = diagonal[k] ** 2 + s[k]
        if k < d - 1:
            pivot = plus[k] if abs(plus[k]) > tiny else -tiny
            low[k] = b[k] / pivot
            s[k + 1] = above[k] ** 2 * s[k] / pivot - t
    # Bottom up (progressive): p = minus - above^2.
    up, p = np.empty(d - 1), np.empty(d)
    p[-1] = diagonal[-1] ** 2 - t
    for k in range(d - 2, -1, -1):
        minus = above[k] ** 2 + p[k + 1]
        pivot = minus if abs(minus) > tiny else -tiny
        up[k] = b[k] / pivot
        p[k] = p[k + 1] * diagonal[k] ** 2 / pivot - t
    gamma = np.abs(s + p + t)
    r = int(gamma.argmin())
    z = np.zeros(d)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(r + 1, d):
        z[k] = -up[k - 1] * z[k - 1]
    big = np.abs(z).max()
    if not np.isfinite(big):
        return np.zeros(d)
    z /= big
    return z / np.linalg.norm(z)


def _cluster_vectors(diagonal: np.ndarray, above: np.ndarray, value: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    """A vector for a value that lies next to others: inverse steps, kept apart from theirs."""
    a = np.diag(diagonal**2 + np.r_[0.0, above**2]) + np.diag(diagonal[:-1] * above, 1) + np.diag(diagonal[:-1] * above, -1)
    shifted = a - value**2 * (1 + 4 * EPS) * np.eye(len(a)) - EPS * np.abs(a).max() * np.eye(len(a))
    z = np.random.default_rng(seed).standard_normal(len(a))
    for _ in range(4):
        z = np.linalg.solve(shifted, z)
        for o in (*others, *others):
            z = z - o * (o @ z)
        z /= np.linalg.norm(z)
    return z


def directions(r: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest singular values of a triangle and their right vectors (columns). Values
    that are zero to working precision have no whitening and are left out."""
    diagonal, above, reflections = bidiagonal(r)
    values = singular_values(diagonal, above)
    kept = values[: components][values[:components] > len(r) * EPS * max(values[0], 1e-300)] if len(values) else values
    out: list[np.ndarray] = []
    for k, value in enumerate(kept):
        near = [out[j] for j in range(k) if kept[j] - value <= 1e-3 * kept[j]]
        z = twisted(diagonal, above, value)
        for o in (*near, *near):
            z = z - o * (o @ z)
        size = np.linalg.norm(z)
        # Vectors of close values come out close to each other: the second has to be found apart.
        out.append(z / size if size > 0.5 else _cluster_vectors(diagonal, above, value, near, k))
    v = np.array(out).T if out else np.zeros((len(r), 0))
    for at, h in reversed(reflections):
        v[at:] -= 2 * np.outer(h, h @ v[at:])
    return kept, v


# ---- whitening -------------------------------------------------------------------------


class Whitening:
    """What whitening needs of all vectors: n, S, the directions, and their values."""

    def __init__(self, n: int, total: list[int], values: np.ndarray, basis: np.ndarray, trace: float):
        self.n, self.total, self.values, self.basis, self.trace = n, total, values, basis, trace

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.values**2 / self.n

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened rows, from n x - S."""
        return (d.astype(float) / self.n) @ (self.basis / np.sqrt(self.eigenvalues))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """All vectors of `rows` whitened: at most `components` directions. Rows whose vector is
    null, not of the common length, or holds null, infinite or too large entries have no part."""
    dim = dimension(rows)
    n, total = sums(rows, dim) if dim else (0, [])
    if not n:
        return Whitening(0, [0] * dim, np.zeros(0), np.zeros((dim, 0)), 0.0)
    r = triangle(rows, dim, n, total)
    values, basis = directions(r, components)
    return Whitening(n, total, values, basis, float((r**2).sum() / n))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity. Tasks give the
    products about their own means; the means are joined after that."""
    k, dim = len(model.values), len(model.total)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                _, x = vectors(batch.slice(low, ROWS), dim)
                if len(x):
                    w = model.project(deviations(x, model.n, model.total))
                    mean = w.mean(axis=0)
                    inside, between = (w - mean).T @ (w - mean), len(w) * np.outer(mean, mean)
                    i, j = np.triu_indices(k)
                    yield pa.RecordBatch.from_pydict({
                        "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "products": pa.array((inside + between)[i, j]),
                        "left": pa.array(len(w) * mean[i]), "right": pa.array(len(w) * mean[j])})

    if not k:
        return 0.0
    parts = rows.select("embedding").mapInArrow(moments, "i int, j int, products double, left double, right double")
    n = float(model.n)
    covariance = F.sum("products") / n - (F.sum("left") / n) * (F.sum("right") / n)
    off = F.abs(covariance - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0))
    return float(parts.groupBy("i", "j").agg(off.alias("off")).agg(F.max("off")).first()[0])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each
    vector and component.

    Rows whose vector is null or empty, holds null, infinite, NaN or too large entries, or
    has not the length most vectors have, have none. Null ids and repeated rows stay.
    Directions whose variance is zero are left out, so equal vectors alone give no rows. A
    deviation that does not fit in a long is null. Other columns are not read.
    """
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding"))
    model = fit(rows, components)
    k, dim, error = len(model.values), len(model.total), identity_error(rows, model)
    explained = model.eigenvalues / model.trace if k else np.zeros(0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows if k else 0, ROWS):
                part = batch.slice(low, ROWS)
                at, x = vectors(part, dim)
                d = deviations(x, model.n, model.total)
                times = pa.array(np.repeat(np.arange(len(at)), k))
                m = len(at)
                yield pa.RecordBatch.from_arrays([
                    part.column("vec_id").take(pa.array(at)).take(times), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()), pa.array(squared(d), pa.int64()).take(times),
                    pa.array(model.project(d).ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()),
                    pa.array(np.full(m * k, error), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
