"""Nearest neighbours by randomly rotated one-bit codes.

The index holds, for each vector less the centroid, the signs of its coordinates after
a few random rotations (packed bits) and two correction scalars: its length and the
inner product between the unit vector and its code.  A search quantises the rotated query to
four bits, takes inner products with the codes (a block of them at a time, as one product of
signs and levels), corrects them, and bounds their error.  All vectors whose lower distance
bound reaches the best exact distances so far are reranked exactly, in double precision, where
they are: a block of the index holds its vectors, too.

A block of queries meets every block of the index in a cell of Spark's Cartesian product, which
reads both as they were written and shuffles neither.  A task keeps the k best of each query over
all the blocks that it meets, and a ranking per query joins those of the tasks.

Defined cases: null or zero vectors, vectors with null, NaN or infinite components and
vectors of another than the most common length take no part.  A query never finds a row
with its own vec_id; of repeated query ids one row searches.  Repeated rows are candidates
each.  Fewer candidates than k are all returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pairwise import Nearest
from .common import materialize, narrow

INDEX = "block string, ids array<long>, x binary, codes binary, norm binary, fit binary"
QUERY_BITS = 4
HELD_QUERIES = 1 << 17  # whose best rows a task holds at most


def usable(v: Column) -> Column:
    """Not null, all components finite, not zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def rotations(dim: int, n: int, seed: int) -> np.ndarray:
    """n random rotations as one (dim, n * dim) matrix."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def _encode(x: np.ndarray, centroid: np.ndarray, turn: np.ndarray, n: int):
    """Packed codes, lengths and <code, vector> per rotation."""
    dim = x.shape[1]
    y = x - centroid
    norm = np.sqrt((y * y).sum(1))
    z = (y / np.where(norm == 0, 1, norm)[:, None]) @ turn
    codes = np.packbits(z > 0, axis=1, bitorder="little")
    fit = np.abs(z).reshape(len(x), n, dim).sum(2) / math.sqrt(dim)
    return codes, norm, np.where(norm[:, None] == 0, 1.0, fit)


class Index:
    """blocks is a written table of vectors with their codes; the rest is the fitted model, whose size is that of one rotation set."""

    def __init__(self, blocks: DataFrame, dim: int, centroid: np.ndarray, turn: np.ndarray, n: int) -> None:
        self.blocks, self.dim, self.centroid, self.turn, self.n = blocks, dim, centroid, turn, n


def build(vectors: DataFrame, n_rotations: int = 16, block: int = 4096, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> Index | None:
    """The index over all usable vectors; None if there is none."""
    rows = narrow(vectors, vec_id=vec_id, x=embedding).where(usable(F.col("x")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("x").cast("array<double>").alias("x"))
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0].dim
    rows = rows.where(F.size("x") == dim).select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    means = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col").alias("m")).collect()  # dim rows
    centroid = np.array([r.m for r in sorted(means, key=lambda r: r.pos)])
    turn = rotations(dim, n_rotations, seed)

    def pack(batches):
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                some = batch.slice(at, block)
                x = some.column(1).flatten().to_numpy().reshape(-1, dim)
                seq += 1
                ids = pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(0))
                binary = [pa.array([a.tobytes()], pa.binary()) for a in (x, *_encode(x, centroid, turn, n_rotations))]
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}-{seq}"]), ids, *binary], ["block", "ids", "x", "codes", "norm", "fit"])

    lanes = min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sizes[0].n // 1024))
    blocks = materialize(rows.repartition(lanes, "vec_id").mapInArrow(pack, INDEX), "ann-index")
    return Index(blocks, dim, centroid, turn, n_rotations)


class Codes:
    """One block of the index: its codes as signs over what they are off by, so that a product with levels gives estimates."""

    def __init__(self, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, dim: int) -> None:
        m, n = fit.shape
        signs = np.unpackbits(codes, axis=1, count=n * dim, bitorder="little").reshape(m, n, dim).astype(np.float32)
        self.signs = ((2 * signs - 1) / (fit * n * math.sqrt(dim)).astype(np.float32)[:, :, None]).reshape(m, -1)
        self.norm, self.off = norm, 1 / fit**2
        self.error = ((1 - fit**2).clip(0) / fit**2).sum(1) / max(1, dim - 1)


def bounds(held: Codes, q: np.ndarray, centroid: np.ndarray, turn: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of each query (rows) to each vector of a block."""
    n, dim = held.off.shape[1], len(centroid)
    y = q - centroid
    q_norm = np.sqrt((y * y).sum(1))[:, None]
    z = ((y / np.where(q_norm == 0, 1, q_norm)) @ turn).reshape(len(q), n, dim)
    low = z.min(2, keepdims=True)
    gap = np.maximum((z.max(2, keepdims=True) - low) / (2**QUERY_BITS - 1), 1e-12)
    level = low + gap * np.rint((z - low) / gap)
    lost = ((z - level) ** 2).sum(2)  # what rounding took from the query, squared
    inner = (level.reshape(len(q), -1).astype(np.float32) @ held.signs.T).astype(float)
    # Standard errors of the mean of n estimates: of the codes, and of the rounded query.
    slack = width * np.sqrt(held.error + lost @ held.off.T / dim) / n + 1e-5  # single precision
    scale, base = 2 * held.norm * q_norm, held.norm**2 + q_norm**2
    return base - scale * np.minimum(1, inner + slack), base - scale * np.maximum(-1, inner - slack)


def _meet(near: Nearest, at: slice, q: np.ndarray, ids: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
    """Reranks those of a block's vectors whose lower bound reaches the k best distances of a query so far, or the k least upper bounds."""
    own = near.ids[at, None] == ids
    low, high = np.where(own, np.inf, low), np.where(own, np.inf, high)
    reach = near.d[at, -1] ** 2
    few = np.isinf(reach)
    if few.any() and len(ids) > near.k:
        reach[few] = np.partition(high[few], near.k - 1, axis=1)[:, near.k - 1]
    row, column = np.nonzero((low <= (reach * (1 + 1e-9) + 1e-12)[:, None]) & ~own)
    for i in range(0, len(row), 1 << 16):
        r, c = row[i : i + (1 << 16)], column[i : i + (1 << 16)]
        square = np.cumsum((x[c] - q[r]) ** 2, axis=1)[:, -1]  # from the first coordinate on, as SQL adds
        near.merge(r + at.start, ids[c], np.sqrt(square))


def search(index: Index | None, queries: DataFrame, k: int = 10, width: float = 5.0, query_block: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of each query's k nearest rows.

    width: standard errors by which a lower bound lies below the estimate.
    """
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = narrow(queries, query_id=vec_id, x=embedding).where(usable(F.col("x")) & F.col("query_id").isNotNull()).where(F.size("x") == index.dim)
    asked = asked.groupBy(F.col("query_id").cast("long").alias("query_id")).agg(F.min(F.col("x").cast("array<double>")).alias("q"))
    asked = materialize(asked, "ann-queries")
    parts = max(1, -(-asked.count() // query_block))
    grouped = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("query_id", "q")).alias("queries"))
    grouped = materialize(grouped, "ann-query-blocks")  # blocks of bounded size
    met = index.blocks.crossJoin(grouped.coalesce(-(-parts // 64)).hint("shuffle_replicate_nl"))
    dim, centroid, turn, n = index.dim, index.centroid, index.turn, index.n

    def run(batches):
        best, held, block = {}, 0, None
        for batch in batches:
            named = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if block != named["block"][i].as_py():
                    block = named["block"][i].as_py()
                    x, code, norm, fit = (np.frombuffer(named[c][i].as_buffer(), t) for c, t in (("x", np.float64), ("codes", np.uint8), ("norm", np.float64), ("fit", np.float64)))
                    ids, x = named["ids"][i].values.to_numpy(), x.reshape(-1, dim)
                    codes = Codes(code.reshape(len(ids), -1), norm, fit.reshape(-1, n), dim)
                part = named["part"][i].as_py()
                if part not in best:
                    q_ids, q = named["queries"][i].values.flatten()
                    if held + len(q_ids) > HELD_QUERIES:
                        yield from results(best)
                        best, held = {}, 0
                    best[part] = Nearest(q_ids.to_numpy(), k), q.flatten().to_numpy().reshape(-1, dim)
                    held += len(q_ids)
                near, q = best[part]
                for at in range(0, len(q), 128):
                    _meet(near, slice(at, at + 128), q[at : at + 128], ids, x, *bounds(codes, q[at : at + 128], centroid, turn, width))
        yield from results(best)

    def results(best):
        for near, _ in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in near.columns()], ["query_id", "vec_id", "score"])

    both = met.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
