"""Whitening of embeddings by their leading components, found by Chebyshev-filtered subspace iteration.

The covariance is never formed. One pass over the stored vectors computes
``XᵀXQ / n`` for centred vectors ``X`` and a block ``Q`` of a few columns: each
task adds up its own product, and the sums of the tasks meet cell by cell. A
Chebyshev polynomial of the covariance, evaluated by its three-term recurrence
with one pass per degree, damps the spectrum below the block. QR and a
Rayleigh-Ritz step on the filtered block follow, until the residual of every
wanted component is at rounding level. Only blocks of dimensions x columns are
on the driver, never vectors.

Rows with a null vector, or with a null or non-finite entry, go; so do empty
vectors, entries of 2^40 or more, and vectors that have not the most frequent
length (the longer one of two equally frequent). Repeated rows count as often as they
stand there, null and repeated ids are kept. Components without variance are
left out, so fewer than ``k`` come back for few or equal vectors. An empty table
gives an empty result. Columns other than id and vector are not read.

Sums and deviations are exact for any number of vectors: 64 bits are too few for
deviations from some million vectors on, which are then added up as decimals of
38 digits. A deviation of more digits is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interviewflow.llm.store import stored

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
# Columns of the block for each wanted component, degree of the polynomial, most filter steps.
WIDTH = 6
DEGREE = 10
STEPS = 60
# Residual against the largest eigenvalue that counts as rounding, and share of it below which a component has no variance.
CERTIFIED = 4e-13
NOTHING = 1e-12
# Vectors of one product.
ROWS = 8192
# Entries are added up in two parts, of which the lower one has so many bits.
LOW = 20
EXACT = "decimal(38,0)"


def scaled_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``id, x`` with whole numbers ``x``, for the rows that count."""
    given = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("c"))
    sound = F.forall("c", lambda c: c.isNotNull() & (F.abs(c) < float(1 << 40)))
    x = F.transform("c", lambda c: F.floor(SCALE * c) + SHIFT)
    return given.where(F.coalesce(sound & (F.size("c") > 0), F.lit(False))).select("id", x.alias("x"))


def usual_length(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max(F.struct("n", "d")).alias("most")).first()["most"]
    return most["d"] if most else 0


def summed(rows: DataFrame, kind: str, of, shape: tuple[int, ...], column: str = "x"):
    """The sum over all vectors of ``of(matrix)``, an array of ``shape``; tasks add up their own part."""
    import numpy as np
    import pyarrow as pa

    d = shape[0]
    cells = int(np.prod(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for at in range(0, len(flat), ROWS):
                part = of(flat[at : at + ROWS])
                whole = part if whole is None else whole + part
        if whole is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(whole.reshape(-1))], names=["cell", "v"])

    parts = rows.select(column).mapInArrow(run, f"cell bigint, v {kind}")
    out = np.zeros(cells, dtype=np.int64 if kind == "bigint" else np.float64)
    for row in parts.groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[row["cell"]] = row["v"]
    return out.reshape(shape)


def exact_sums(rows: DataFrame, d: int) -> list[int]:
    """The sum of each dimension."""
    import numpy as np

    def of(x):
        return np.stack([(x >> LOW).sum(axis=0), (x & ((1 << LOW) - 1)).sum(axis=0)], axis=1)

    return [(high << LOW) + low for high, low in summed(rows, "bigint", of, (d, 2)).tolist()]


def exact(number: int) -> Column:
    return F.lit(Decimal(number)).cast(EXACT)


def deviation(x: Column, sums: list[int], n: int, least: int, most: int) -> Column:
    """The sum over dimensions of ``(n x - S)^2``; entries lie between ``least`` and ``most``, which tells if 64 bits are enough."""
    if max(n * max(abs(least), abs(most)), len(sums) * (n * (most - least)) ** 2) < 1 << 63:
        total = F.array(*[F.lit(s).cast("bigint") for s in sums])
        squares = F.zip_with(x, total, lambda entry, s: (n * entry - s) * (n * entry - s))
        return F.aggregate(squares, F.lit(0).cast("bigint"), lambda a, b: a + b).cast(EXACT)

    def squared(entry: Column, total: Column) -> Column:
        apart = F.try_subtract(F.try_multiply(exact(n), entry.cast(EXACT)), total)
        return F.try_multiply(apart, apart)

    squares = F.zip_with(x, F.array(*[exact(s) for s in sums]), squared)
    return F.aggregate(squares, exact(0), lambda a, b: F.try_add(a, b).cast(EXACT))


def covariance_times(rows: DataFrame, mean, block, n: int):
    """``V block`` by one pass: centred vectors times the block, and back."""

    def of(x):
        centred = x - mean
        return centred.T @ (centred @ block)

    return summed(rows, "double", of, block.shape) / n


def rayleigh_ritz(apply, block):
    """Ritz values, falling, their vectors, the vectors' images, and the residuals."""
    import numpy as np

    q, _ = np.linalg.qr(block)
    image = apply(q)
    small = q.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)
    values, turn = values[order], turn[:, order]
    vectors, images = q @ turn, image @ turn
    return values, vectors, images, np.linalg.norm(images - vectors * values, axis=0)


def filtered(apply, vectors, images, low: float, high: float, top: float, degree: int):
    """A Chebyshev polynomial of the covariance on a block: at most 1 on ``low`` to ``high``, 1 at ``top``."""
    half, centre = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - centre)
    before, now = vectors, (images - centre * vectors) * (sigma / half)
    for _ in range(1, degree):
        nearer = 1 / (2 / first - sigma)
        before, now = now, 2 * (nearer / half) * (apply(now) - centre * now) - sigma * nearer * before
        sigma = nearer
    return now


def leading_components(apply, d: int, k: int = COMPONENTS, width: int = WIDTH, degree: int = DEGREE):
    """The ``k`` greatest eigenvalues of a symmetric positive operator, unit vectors as columns, and their residuals.

    ``apply`` multiplies a block of columns. Steps go on until all residuals are
    certified, or have not become half as large in two steps.
    """
    import numpy as np

    k = min(k, d)
    block = np.random.default_rng(0).standard_normal((d, min(d, width * k)))
    values, vectors, images, residuals = rayleigh_ritz(apply, block)
    history: list[float] = []
    for _ in range(STEPS):
        top = values[0]
        worst = residuals[:k].max()
        history.append(worst)
        if top <= 0 or worst <= CERTIFIED * top or len(block) == block.shape[1] or (len(history) > 2 and worst > history[-3] / 2):
            break
        high = min(values[-1], top * (1 - 1e-9))
        if high <= 0:
            break
        block = filtered(apply, vectors, images, 0.0, high, top, degree)
        values, vectors, images, residuals = rayleigh_ritz(apply, block)
    # Either sign is right; the entry of greatest size is made positive.
    greatest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values[:k], (vectors * np.where(greatest < 0, -1.0, 1.0))[:, :k], residuals[:k]


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per kept vector: ``id, n, deviation, whitened`` (one entry for each component), ``explained``, ``identity_error``.

    The vectors are written once as whole numbers; sums, passes and the last
    check are jobs that run at once, the result is lazy.
    """
    import numpy as np

    rows = stored(scaled_vectors(vectors, id, vector), "whitening-vectors")
    d = usual_length(rows)
    rows = rows.where(F.size("x") == d)
    n, least, most = rows.agg(F.count(F.lit(1)), F.min(F.array_min("x")), F.max(F.array_max("x"))).first() if d else (0, 0, 0)
    if not n:
        empty = rows.withColumns({"n": F.lit(0).cast("bigint"), "deviation": exact(0), "identity_error": F.lit(0.0)})
        empty = empty.withColumns({c: F.array().cast("array<double>") for c in ("whitened", "explained")})
        return empty.where("false").select(F.col("id").alias(id), "n", "deviation", "whitened", "explained", "identity_error")
    sums = exact_sums(rows, d)
    mean = np.array([s / n for s in sums])
    trace = float(summed(rows, "double", lambda x: ((x - mean) ** 2).sum(axis=0), (d,)).sum()) / n
    values, parts, _ = leading_components(lambda block: covariance_times(rows, mean, block, n), d, k)
    some = values > NOTHING * max(trace, 0.0)
    values, parts = values[some], parts[:, some]
    projected = projections(rows, mean, parts / np.sqrt(values))
    error = 0.0
    if len(values):
        size = len(values)
        moments = summed(projected.select(F.col("whitened").alias("x")), "double", second_moments, (size, size + 1))
        centre = moments[:, -1] / n
        error = float(np.abs(moments[:, :-1] / n - np.outer(centre, centre) - np.eye(size)).max())
    return projected.select(
        F.col("id").alias(id),
        F.lit(n).cast("bigint").alias("n"),
        deviation(F.col("x"), sums, n, least, most).alias("deviation"),
        "whitened",
        F.array(*[F.lit(float(v / trace)) for v in values]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def second_moments(whitened):
    import numpy as np

    return np.concatenate([whitened.T @ whitened, whitened.sum(axis=0)[:, None]], axis=1)


def projections(rows: DataFrame, mean, parts) -> DataFrame:
    """``rows`` with ``whitened``: centred vectors times the columns of ``parts``."""
    import numpy as np
    import pyarrow as pa

    d, size = parts.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            made = (x - mean) @ parts
            ends = np.arange(0, len(x) + 1, dtype=np.int32) * size
            cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["id", "x", "whitened"])

    schema = rows.withColumn("whitened", F.array().cast("array<double>")).limit(0).schema
    return rows.mapInArrow(run, schema)


def whitening_digest(vectors: DataFrame) -> DataFrame:
    """One row per kept vector and component, numbered from 1; a deviation beyond 64 bits is null here."""
    long = whiten(vectors).select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.col("explained")[F.col("at")].alias("explained"),
        "identity_error",
    )
