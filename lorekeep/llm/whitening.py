"""Embedding whitening by spectrum slicing.

The covariance of the distinct vectors is gathered as partial sums, one small matrix a task. Its leading eigenvalues are
then found one by one: the LDLᵀ factors of the matrix less a shift have as many positive pivots as there are eigenvalues
above the shift, so counts at a few shifts close in on each of them; Rayleigh quotient iteration started there converges
cubically; and counts on both sides of the result certify which number it has.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Shared, durable

#: Components that are kept, and what a component is multiplied by before it is cut to a whole number.
COMPONENTS, SCALE = 4, 256
#: Vectors of which a task looks at so many entries at once.
ENTRIES = 1 << 20
#: An eigenvalue of at most this share of the trace counts as none; eigenvalues nearer to each other than that are taken together.
LEAST, NEAR = 1e-13, 1e-10


def ldl_pivots(a: np.ndarray) -> tuple[int, int]:
    """(positive, negative) eigenvalues of the symmetric a, by its LDLᵀ factors with pivots of one or two rows.

    A pivot of two rows is taken where the diagonal is too small beside the rest of its column, by the bound of Bunch and
    Kaufman, so a shift near an eigenvalue of a leading part does no harm.
    """
    a = a.copy()
    bound, pos, neg, k, n = (1 + 17**0.5) / 8, 0, 0, 0, len(a)

    def swap(i, j):
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        col = np.abs(a[k + 1 :, k])
        most = col.max(initial=0.0)
        two = False
        if max(abs(a[k, k]), most) == 0:
            k += 1
            continue
        if abs(a[k, k]) < bound * most:
            r = k + 1 + int(col.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            far = row.max()
            if abs(a[k, k]) * far >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * far:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            d = a[k : k + 2, k : k + 2].copy()
            below = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(d, below.T)
            pos, neg, k = pos + 1, neg + 1, k + 2  # such a pivot has one eigenvalue of each sign
        else:
            d, below = a[k, k], a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(below, below / d)
            pos, neg, k = pos + (d > 0), neg + (d < 0), k + 1
    return pos, neg


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of the symmetric v, falling, and their unit eigenvectors as columns; fewer where the rest are 0.

    Equal eigenvalues, which no shift parts, get any orthonormal vectors of their space.
    """
    dim, trace = len(v), float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((dim, 0))
    eye, top = np.eye(dim), float(np.abs(v).sum(axis=1).max()) * 1.01
    above = {0.0: dim, top: 0}

    def count(shift: float) -> int:
        if shift not in above:
            above[shift] = ldl_pivots(v - shift * eye)[0]
        return above[shift]

    random = np.random.default_rng(0)
    values, vectors = [], np.zeros((dim, 0))
    while len(values) < k:
        nth = len(values) + 1
        lo = max(s for s, c in above.items() if c >= nth)
        hi = min(s for s, c in above.items() if c < nth)
        found = None
        while found is None and hi - lo > NEAR * trace:
            if count(lo) == nth and count(hi) == nth - 1:  # alone between the shifts
                found = _rayleigh(v, (lo + hi) / 2, lo, hi, vectors, random)
                if found is not None:
                    break
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if count(mid) >= nth else (lo, mid)
        if found is None:
            found = _inverse(v, (lo + hi) / 2, vectors, random)
        value, vector = found
        if value <= LEAST * trace:
            break
        # certified: nth - 1 eigenvalues lie above it and nth above what is just below it, or those next to it are equal
        margin = max(NEAR * trace, 64 * np.finfo(float).eps * trace)
        if not (count(value + margin) <= nth - 1 and count(value - margin) >= nth):
            raise ArithmeticError(f"the counts do not certify eigenvalue {nth}")
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    return np.array(values), vectors


def _apart(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - vectors @ (vectors.T @ x)
    return x / np.linalg.norm(x)


def _solve(v: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(v - shift * np.eye(len(v)), x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        return np.linalg.solve(v - (shift + np.finfo(float).eps * np.trace(v)) * np.eye(len(v)), x)


def _rayleigh(v, shift, lo, hi, vectors, random):
    """The eigenvalue between lo and hi with its vector, or None if the iteration leaves for another one."""
    x = _apart(random.standard_normal(len(v)), vectors)
    size = np.abs(v).sum(axis=1).max()
    for step in range(12):
        x = _apart(_solve(v, shift, x), vectors)
        q = float(x @ v @ x)
        rest = np.linalg.norm(v @ x - q * x)
        if rest <= 1e-14 * size * len(v) ** 0.5:
            return (q, x) if lo < q < hi else None
        if step:  # two steps towards the middle of the interval first
            if not lo < q < hi:
                return None
            shift = q
    return None


def _inverse(v, shift, vectors, random):
    """The eigenvalue nearest to shift, of several that are equal one more vector, by inverse iteration."""
    x = _apart(random.standard_normal(len(v)), vectors)
    for _ in range(6):
        x = _apart(_solve(v, shift, x), vectors)
    return float(x @ v @ x), x


def _whole(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x, dim): the usable rows with their vector's whole numbers, floor(SCALE * c)."""
    c = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), c.alias("c")).where("c is not null")
    fine = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(fine).select("vec_id", F.transform("c", lambda e: F.floor(e * SCALE).cast("long")).alias("x"), F.size("c").alias("dim"))


def _blocks(batches):
    """Matrices of vectors of one length: (batch of these rows, whole numbers of x)."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = b.filter(pa.array(dims == dim))
            most = max(1, ENTRIES // max(1, dim))
            for at in range(0, own.num_rows, most):
                part = own.slice(at, most)
                yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _sums(batches):
    """(dim, i, s, n): of each length the vectors' number and their sums in each dimension, exact, once a task."""
    sums: dict = {}
    for _, x in _blocks(batches):
        n, s = sums.get(x.shape[1], (0, 0))
        safe = np.abs(x.astype(float)).max(initial=0) * len(x) < 2.0**62
        sums[x.shape[1]] = (n + len(x), s + (x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)))
    for dim, (n, s) in sums.items():
        m = pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), m, pa.array([n] * dim, pa.int64())], ["dim", "i", "s", "n"])


def _products(center):
    """(dim, i, row): sums of the products of what center(x, dim) gives for vectors x, a row a line of the matrix, once a task."""

    def run(batches):
        out: dict = {}
        for _, x in _blocks(batches):
            y = center(x, x.shape[1])
            if y is not None:
                out[x.shape[1]] = out.get(x.shape[1], 0) + y.T @ y
        for dim, m in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(m), pa.int32()), pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "i", "row"])

    return run


def _gathered(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of partial matrices (dim, i, row) by length: dim * dim numbers each, added up by rows in tasks."""

    def add(t: pa.Table) -> pa.Table:
        rows = [np.array(r, float) for r in t.column("row").to_pylist()]
        return pa.table({"dim": t.column("dim")[:1], "i": t.column("i")[:1], "row": pa.array([sum(rows[1:], rows[0])], pa.list_(pa.float64()))})

    found: dict = {}
    for r in parts.groupBy("dim", "i").applyInArrow(add, "dim int, i int, row array<double>").collect():
        found.setdefault(r["dim"], {})[r["i"]] = r["row"]
    return {dim: np.array([m[i] for i in sorted(m)]) for dim, m in found.items()}


def whiten(vectors: DataFrame, k: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row of vectors and each of k components.

    Rows whose vector is null or holds null or non-finite entries are left out; so repeated rows come out repeatedly, while
    the fit counts each distinct vector of whole numbers once, and a null vec_id is an id like any other. Vectors of each
    length are fitted for themselves. Components without variance are left out, so equal vectors, one vector alone, empty
    vectors and an empty table give no rows. A deviation beyond 64 bits is null. What comes to the driver is a matrix of
    dim * dim numbers.
    """
    spark = vectors.sparkSession
    rows = _whole(vectors, vec_id, embedding).where("dim > 0")
    distinct = durable(rows.select("x", "dim").distinct())
    sums: dict = {}
    for r in distinct.mapInArrow(_sums, "dim int, i int, s decimal(38,0), n long").groupBy("dim", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        sums.setdefault(r["dim"], {})[r["i"]] = (int(r["s"]), r["n"])
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if not sums:
        return spark.createDataFrame([], schema)
    total = {d: ([s[i][0] for i in range(d)], s[0][1]) for d, s in sums.items()}
    mean = {d: np.array([v / n for v in s]) for d, (s, n) in total.items()}
    shared = Shared(spark, mean)
    parts = distinct.mapInArrow(_products(lambda x, dim: x - shared.value[dim]), "dim int, i int, row array<double>")
    models = {}
    for dim, m in _gathered(parts).items():
        v = m / total[dim][1]
        e, u = leading((v + v.T) / 2, k)
        if len(e):
            models[dim] = {"sums": total[dim][0], "n": total[dim][1], "mean": mean[dim], "axes": u / np.sqrt(e), "explained": e / np.trace(v), "error": np.nan}
    if not models:
        return spark.createDataFrame([], schema)
    fitted = Shared(spark, models)

    def project(x, dim):
        m = fitted.value.get(dim)
        # a column of ones beside the whitened ones gives their sums, so that their covariance is centred too
        return None if m is None else np.column_stack([(x - m["mean"]) @ m["axes"], np.ones(len(x))])

    for dim, c in _gathered(distinct.mapInArrow(_products(project), "dim int, i int, row array<double>")).items():
        n, s = models[dim]["n"], c[-1, :-1]
        models[dim]["error"] = float(np.abs((c[:-1, :-1] - np.outer(s, s) / n) / n - np.eye(len(s))).max())
    final = Shared(spark, models)

    def run(batches):
        for part, x in _blocks(batches):
            m = final.value.get(x.shape[1])
            if m is None:
                continue
            w, many = (x - m["mean"]) @ m["axes"], len(m["explained"])
            big, n = np.array(m["sums"], object), m["n"]
            reach = float(np.abs(x.astype(float)).max(initial=0)) * n + float(max(abs(s) for s in m["sums"]))
            if reach * reach * x.shape[1] < 2.0**62:
                d = n * x - big.astype(np.int64)
                deviation = pa.array((d * d).sum(axis=1))
            else:
                exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, m["sums"])) for row in x.tolist()]
                deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            each = np.repeat(np.arange(len(x)), many)
            number = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))), pa.array(np.full(number, n)), deviation.take(pa.array(each)), pa.array(w.ravel()),
                    pa.array(np.tile(m["explained"], len(x))), pa.array(np.full(number, m["error"])),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op12(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """whiten with four components; nulls, repeated rows, ties and empty tables as there."""
    return whiten(vectors)
