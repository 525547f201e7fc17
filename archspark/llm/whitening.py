"""Embedding whitening by a bidiagonal qd solver.

Centred rows are reduced by blockwise QR to one triangle R with R'R = n times the covariance, so the
covariance itself, whose condition is the square, is never formed. Householder reflections make R
bidiagonal; the dqds iteration finds its singular values, also small ones, to high relative accuracy;
for each leading one, the stationary and the progressive factorisation of B'B - sigma^2 meet in a twisted
factorisation, which gives the vector. Reflected back, these are the whitening directions.

How it is dealt: vectors as whole numbers are made distinct by a partially aggregated shuffle; sums are
exact; each task reduces its rows to one triangle, triangles are reduced in rounds of ``FAN`` until few are left, and
only d x d numbers reach the driver. Rows are then projected in one narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import small_batches
from archspark.session import cut_lineage

#: triangles reduced to one in a round, and left for the driver at most
FAN = 32
EPS = np.finfo(float).eps
TINY = 1e-290


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) of a square matrix: U'RV is upper bidiagonal."""
    a, d = np.array(r, float), len(r)
    v = np.eye(d)

    def reflect(x):
        """Unit u with x - 2u(u'x) along the first axis; None if it is already."""
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            return None
        u = x.copy()
        u[0] += math.copysign(norm, x[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflect(a[k:, k])
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u = reflect(a[k, k + 1:])
            if u is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of a bidiagonal matrix, descending, by the differential qd iteration with shifts."""
    q = [max(x, TINY) for x in (diagonal**2).tolist()]
    floor = EPS**4 * max(q, default=0.0)  # far below what the reduction to R can tell from zero
    work, found, left = [(q, (above**2).tolist(), 0.0)], [], 100 + 40 * len(q)
    while work:
        q, e, total = work.pop()
        n, shift = len(q), 0.0
        while True:
            if n == 1:
                found.append(total + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS**2 * max(total + q[i], floor) or e[i] <= EPS**2 * max(total + q[i + 1], floor)), None)
            if cut is not None:
                work += [(q[: cut + 1], e[:cut], total), (q[cut + 1:], e[cut + 1:], total)]
                break
            if n == 2:  # smaller root of x^2 - (q1 + e1 + q2) x + q1 q2 without cancellation
                t = (q[0] + e[0] + q[1]) / 2
                big = t + math.sqrt(max((q[0] - q[1] - e[0]) ** 2 / 4 + q[0] * e[0], 0.0))
                found += [total + q[0] * (q[1] / big), total + big]
                break
            if q[0] * 1.5 < q[-1]:  # the small values are wanted at the end
                q, e = q[::-1], e[::-1]
            left -= 1
            if left < 0:
                raise ArithmeticError("the qd iteration does not converge")
            while True:
                d = least = q[0] - shift
                nq, ne = [], []
                for i in range(n - 1):
                    if d < 0:
                        break
                    nq.append(max(d + e[i], TINY))
                    t = q[i + 1] / nq[i]
                    ne.append(e[i] * t)
                    d = d * t - shift
                    least = min(least, d)
                if least >= 0:
                    break
                # beyond the least value: the transform is dropped and tried with less, at last without a shift
                shift = shift / 4 if shift > EPS * max(q) else 0.0
            nq.append(max(d, TINY))
            q, e, total = nq, ne, total + shift
            # the least pivot bounds the least value from above; with the last one small, from near by
            x = e[n - 2] / q[n - 2]
            shift = d * (1 - math.sqrt(x)) / (1 + x) if d <= least * (1 + 1e-9) and x < 0.5 else least / 4
    return np.array(sorted(found, reverse=True))


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit eigenvector of B'B for an eigenvalue, from the twisted factorisation with the least pivot."""
    n = len(diagonal)
    if n == 1:
        return np.ones(1)
    a = np.where(np.abs(diagonal) < math.sqrt(TINY), math.sqrt(TINY), diagonal)
    pivots, lower = a * a, above / a[:-1]
    down, up = np.empty(n - 1), np.empty(n - 1)
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):  # stationary: L D L' - value = L+ D+ L+'
        plus = s[i] + pivots[i]
        plus = plus if abs(plus) > TINY else -TINY
        down[i] = pivots[i] * lower[i] / plus
        s[i + 1] = down[i] * lower[i] * s[i] - value
    p[n - 1] = pivots[n - 1] - value
    for i in range(n - 2, -1, -1):  # progressive: L D L' - value = U- D- U-'
        minus = pivots[i] * lower[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > TINY else -TINY
        t = pivots[i] / minus
        up[i] = lower[i] * t
        p[i] = p[i + 1] * t - value
    gamma = np.abs(s + p + value)
    k = int(np.nanargmin(np.where(np.isfinite(gamma), gamma, np.inf)))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def directions(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of r'r, all of them as a sum, and unit eigenvectors in columns.

    Returns (values of all, vectors of the leading ``count``). Where a superdiagonal entry is negligible
    the matrix falls into blocks, so multiple eigenvalues come from different blocks; vectors of
    values that agree to seven digits are made orthogonal, again from the block's other directions if
    two of them came out the same.
    """
    scale = float(np.abs(r).max()) or 1.0
    diagonal, above, v = bidiagonal(np.asarray(r, float) / scale)
    d, norm = len(diagonal), max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    cuts = [0, *(i + 1 for i in range(d - 1) if abs(above[i]) <= EPS * norm), d]
    found = []
    for start, stop in zip(cuts, cuts[1:]):
        found += [(x if x > 1e-250 else 0.0, start, stop) for x in dqds(diagonal[start:stop], above[start: stop - 1])]
    found.sort(key=lambda x: -x[0])
    vectors, spans = [], []
    for value, start, stop in found[:count]:
        z = np.zeros(d)
        z[start:stop] = twisted_vector(diagonal[start:stop], above[start: stop - 1], value)
        near = [w for w, (x, *where) in zip(vectors, spans) if where == [start, stop] and abs(x - value) <= 1e-7 * x]
        if near:
            b = np.diag(diagonal[start:stop]) + np.diag(above[start: stop - 1], 1)
            z = _apart(b.T @ b, z[start:stop], [w[start:stop] for w in near], value, start, d)
        vectors.append(z)
        spans.append((value, start, stop))
    w = np.column_stack(vectors) if vectors else np.zeros((d, 0))
    return np.array([x for x, *_ in found]) * scale**2, v @ w


def _apart(t: np.ndarray, z: np.ndarray, near: list, value: float, start: int, d: int) -> np.ndarray:
    """Inverse iteration within a cluster, orthogonal to the vectors it already has."""
    for k in range(4):
        for _ in range(2):
            z = z - sum((w @ z) * w for w in near)
        if np.linalg.norm(z) < 1e-3 and k < 3:
            z = np.cos(np.arange(1, len(z) + 1) * (k + 1.0))
            continue
        z = z / np.linalg.norm(z)
        z = np.linalg.solve(t - value * (1 + 4 * EPS) * np.eye(len(t)), z)
    z = z - sum((w @ z) * w for w in near)
    out = np.zeros(d)
    out[start: start + len(z)] = z / np.linalg.norm(z)
    return out


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is not empty and has only finite entries; x = floor(256 c)."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = table.select(F.col(id_col).alias("vec_id"), vector.alias("__v")).filter(F.col("__v").isNotNull() & ~bad & (F.size("__v") > 0))
    return kept.select("vec_id", F.transform("__v", lambda c: F.floor(F.lit(256.0) * c)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, d)


def _sums(d: int):
    """Exact sums, least and greatest entry of each dimension of a task's rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, [0] * d, [2**63 - 1] * d, [-(2**63)] * d
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if len(x):
                n += len(x)
                parts = ((x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist())
                total = [t + (h << 32) + m for t, h, m in zip(total, *parts)]
                low = [min(a, b) for a, b in zip(low, x.min(0).tolist())]
                high = [max(a, b) for a, b in zip(high, x.max(0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n] * d, pa.int64()), pa.array(range(d), pa.int32()),
                                              pa.array([str(t) for t in total]), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                             names=["n", "i", "s", "low", "high"])
    return run


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with the whole part taken off exactly, so large offsets cost no digits."""
    whole = np.array([s // n for s in sums], object)
    rest = np.array([(s % n) / n for s in sums])
    if all(-(2**62) < w < 2**62 for w in whole) and np.abs(x, dtype=float).max(initial=0) < 2.0**62:
        return (x - whole.astype(np.int64)).astype(float) - rest
    return (x.astype(object) - whole).astype(float) - rest


def _triangles(d: int, n: int, sums: list[int], block: int = 4096):
    """A task's centred rows -> one triangle, block by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, have = np.zeros((0, d)), [], 0
        for batch in batches:
            held.append(_centred(_matrix(batch.column("x"), d), n, sums))
            have += len(held[-1])
            if have >= block:
                r, held, have = np.linalg.qr(np.vstack([r, *held]), mode="r"), [], 0
        if have or len(r):
            yield _triangle(np.linalg.qr(np.vstack([r, *held]), mode="r"))
    return run


def _triangle(r: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["k", "r"])


def _together(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for b in batch.column("r").to_pylist():
                r = np.linalg.qr(np.vstack([r, np.frombuffer(b).reshape(-1, d)]), mode="r")
        if len(r):
            yield _triangle(r)
    return run


def reduce_rows(fit: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """The triangle R of the centred rows of ``fit`` (x), d x d, reduced in rounds of ``FAN``."""
    parts = cut_lineage(fit.select("x").mapInArrow(_triangles(d, n, sums), "k long, r binary"))
    left = parts.count()
    while left > FAN:
        left = math.ceil(left / FAN)
        parts = cut_lineage(parts.repartition(left, "k").mapInArrow(_together(d), "k long, r binary"))
        left = min(left, parts.count())
    rows = [np.frombuffer(row["r"]).reshape(-1, d) for row in parts.orderBy("k").collect()]
    r = np.linalg.qr(np.vstack([np.zeros((d, d)), *rows]), mode="r")
    return r


def whiten(table: DataFrame, components: int = 4, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` for each
    remaining row and each of the first ``components`` components (fewer if there are fewer dimensions).

    Rows whose vector is null, empty or holds null or non-finite entries go. All vectors must have the
    dimension that most rows have (ties: the greater); rows of another dimension go too. Repeated
    vectors count once in the fit, each row is returned. A component without variance (equal
    vectors, fewer vectors than components) has ``whitened`` null and is left out of ``identity_error``,
    which is null if none has any; ``explained`` is 0 then, null if nothing varies. ``deviation`` is null
    beyond a long; ``deviation_exact`` holds it as decimal digits. Entries beyond a long are cut to its
    ends by floor. Null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    spark = table.sparkSession
    small_batches(spark, 2048)
    rows = whole_vectors(table, id_col, vector_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_exact string")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return rows.limit(0).mapInArrow(lambda batches: iter(()), schema)
    d = sizes[0]["d"]
    rows = rows.filter(F.size("x") == d)
    fit = cut_lineage(rows.select("x").distinct())
    small_batches(spark, 2048)
    got = (fit.mapInArrow(_sums(d), "n long, i int, s string, low long, high long").groupBy("i")
           .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
           .orderBy("i").collect())
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    far = max(max(abs(n * r["low"] - s), abs(n * r["high"] - s)) for r, s in zip(got, sums))
    exact_long = d * far * far < 2**63 and n * max(max(abs(r["low"]), abs(r["high"])) for r in got) < 2**62
    values, vectors = directions(reduce_rows(fit, d, n, sums), min(components, d))
    values = values / n
    trace = float(values.sum())
    lead = values[: vectors.shape[1]]
    # below rounding of the reduction nothing can be told from no variance
    live = lead > (d * EPS) ** 2 * 16 * max(values[0], 0.0) if trace > 0 else np.zeros(len(lead), bool)
    onto = vectors / np.sqrt(np.where(live, lead, 1.0))
    c = len(lead)

    def projected(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, sums) @ onto

    def fit_projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(_matrix(batch.column("x"), d))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(c)], names=[f"w{k}" for k in range(c)])

    alive = [k for k in range(c) if live[k]]
    error = None
    if alive:
        pairs = [(i, j) for i in alive for j in alive if i <= j]
        got = fit.mapInArrow(fit_projections, ", ".join(f"w{k} double" for k in range(c))).agg(
            *(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            if exact_long:
                deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
            w = projected(x)
            m = len(x)
            each = lambda values: [v for v in values for _ in range(c)]
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), c)))
            whitened = pa.array(np.where(live, w, 0.0).reshape(-1), mask=np.tile(~live, m))
            share = [float(v) / trace if on else 0.0 for v, on in zip(lead, live)] if trace > 0 else [None] * c
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(list(range(1, c + 1)) * m, pa.int32()), pa.array([n] * (m * c), pa.int64()),
                pa.array(each(v if v < 2**63 else None for v in deviation), pa.int64()), whitened,
                pa.array(share * m, pa.float64()), pa.array([error] * (m * c), pa.float64()), pa.array(each(map(str, deviation)), pa.string())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(results, schema)
