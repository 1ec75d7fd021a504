"""All-pairs distances between two sets of vectors, block by block.

Rows are put into blocks of bounded size by a hash of their id, and each block is written once, as packed
numbers.  A task is given some left and some right blocks (a cell of Spark's Cartesian product, which reads
the written blocks again and shuffles none of them) and reduces all their pairs as they stream by: to the k
nearest rows, or to a sum over kernels.  No pair of rows is ever a row of a table; a left row leaves a task once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut_lineage

EPS = 1e-10
Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _chunked(f, rows: int = 16) -> Metric:
    """For measures that need the differences of all coordinates: a few rows at a time."""
    return lambda a, b: np.concatenate([f(a[i : i + rows, None, :], b[None]) for i in range(0, len(a), rows)])


def sqeuclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _unit(a: np.ndarray) -> np.ndarray:
    return a / np.maximum(np.sqrt((a * a).sum(1, keepdims=True)), EPS)


def _root_share(a: np.ndarray) -> np.ndarray:
    return np.sqrt(a / np.maximum(a.sum(1, keepdims=True), EPS))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the zeros and ones differ: whole numbers, exact below 2**24."""
    return (a.sum(1)[:, None] + b.sum(1) - 2 * a @ b.T).astype(float)


#: Smaller is nearer; the histogram intersection is negated.
METRICS: dict[str, Metric] = {
    "sqeuclidean": _chunked(lambda a, b: ((a - b) ** 2).sum(2)),
    "l1": _chunked(lambda a, b: np.abs(a - b).sum(2)),
    "chi2": _chunked(lambda a, b: ((a - b) ** 2 / (a + b + EPS)).sum(2)),
    "hellinger": lambda a, b: METRICS["sqeuclidean"](_root_share(a), _root_share(b)),
    "cosine": lambda a, b: 1 - _unit(a) @ _unit(b).T,
    "hamming": lambda a, b: _differing((a > 0).astype(np.float32), (b > 0).astype(np.float32)) / max(a.shape[1], 1),
    "intersection": _chunked(lambda a, b: -np.minimum(a, b).sum(2) / np.sqrt(np.maximum(a.sum(2) * b.sum(2), EPS))),
}


#: What turns vectors so that the metric is the squared distance of the turned ones: its least values are found by a matrix product and then computed exactly.
SQUARED: dict[str, Callable[[np.ndarray], np.ndarray]] = {"sqeuclidean": lambda a: a, "hellinger": _root_share}

HELD_ROWS = 1 << 16  # left rows whose results a task holds at most
CELL_BYTES = 64 << 20  # of one side in one task


def _blocks(rows: DataFrame, size: int, carry: tuple[str, ...]) -> tuple[DataFrame, int]:
    """The written blocks (b, id, x and what they carry, packed; null: -1), and how many parts a side has."""
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
    n = max(1, -(-found.n // size))  # blocks of about `size` rows
    spark = rows.sparkSession
    parts = max(8, int((4 * spark.sparkContext.defaultParallelism) ** 0.5), -(-found.n * ((found.p or 0) + 1 + len(carry)) * 8 // CELL_BYTES))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    grouped = rows.select("id", "x", *carry, block.alias("b")).repartition(min(n, 8 * parts), "b").groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "x", *carry))).alias("rows"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b, held in zip(batch["b"], batch["rows"], strict=True):
                ids, x = _unpack(held)
                more = {c: [np.array([-1 if r[c] is None else r[c] for r in held], np.int64).tobytes()] for c in carry}
                yield pd.DataFrame({"b": [b], "id": [ids.tobytes()], "x": [x.tobytes()], **more})

    return cut_lineage(grouped.mapInPandas(pack, "b int, id binary, x binary" + "".join(f", {c} binary" for c in carry)), "pair-blocks"), parts


class Block:
    """Rows of one block as arrays, in id order."""

    def __init__(self, side: str, batch: pa.RecordBatch, i: int, carry: tuple[str, ...]) -> None:
        read = lambda c, t: np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), t)
        self.number = batch.column(f"{side}_b")[i].as_py()
        self.id = read("id", np.int64)
        self.x = read("x", np.float64).reshape(len(self.id), -1)
        self.carried = {c: read(c, np.int64) for c in carry}


def block_pairs(left: DataFrame, right: DataFrame, size: int = 1024, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a left and a right block of rows (id, x and what they carry), packed; read by `pairs_of`."""
    a, na = _blocks(left, size, carry)
    b, nb = (a, na) if right is left else _blocks(right, size, carry)
    named = lambda side, df: df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])
    return named("l", a).coalesce(na).crossJoin(named("r", b).coalesce(nb).hint("shuffle_replicate_nl"))


def pairs_of(batches: Iterator[pa.RecordBatch], carry: tuple[str, ...] = ()) -> Iterator[tuple[Block, Block]]:
    """The pairs of blocks that a task is given; a block that comes again is read once."""
    left = None
    for batch in batches:
        for i in range(batch.num_rows):
            if left is None or left.number != batch.column("l_b")[i].as_py():
                left = Block("l", batch, i, carry)
            yield left, Block("r", batch, i, carry)


def _unpack(rows) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in rows], np.int64), np.array([np.asarray(r["x"], float) for r in rows])


class Nearest:
    """The k nearest of one block's rows among what it has met, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.d, self.other = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, metric: str, lx: np.ndarray, rx: np.ndarray, ri: np.ndarray, skipped: np.ndarray | None) -> None:
        """Rows ri come in id order; skipped pairs do not count."""
        with np.errstate(all="ignore"):
            if metric in SQUARED:
                lx, rx = SQUARED[metric](lx), SQUARED[metric](rx)
                na, nb = (lx * lx).sum(1), (rx * rx).sum(1)
                d = na[:, None] + nb - 2 * lx @ rx.T
                off = 1e-12 * (np.where(np.isfinite(na), na, 0) + np.where(np.isfinite(nb), nb, 0).max(initial=0))  # more than what the product is off by
            else:
                d, off = METRICS[metric](lx, rx), np.zeros(len(lx))
            d = np.where(np.isfinite(d) if skipped is None else np.isfinite(d) & ~skipped, d, np.inf)
            bound = self.d[:, -1].copy()
            open_rows = np.flatnonzero(np.isinf(bound))
            if len(open_rows) and d.shape[1] > self.k:
                bound[open_rows] = np.partition(d[open_rows], self.k - 1, axis=1)[:, self.k - 1] + off[open_rows]
            row, at = np.nonzero((d <= (bound + off)[:, None]) & (d < np.inf))
            for i in range(0, len(row), 1 << 18):  # many equal distances are taken in pieces
                r, c = row[i : i + (1 << 18)], at[i : i + (1 << 18)]
                self.merge(r, ri[c], ((lx[r] - rx[c]) ** 2).sum(1) if metric in SQUARED else d[r, c])

    def merge(self, row: np.ndarray, other: np.ndarray, d: np.ndarray) -> None:
        """Adds distances d from rows (by place) to others."""
        order = np.lexsort((other, d, row))
        row, other, d = row[order], other[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        first = (place < self.k) & np.isfinite(d)
        row, other, d, place = row[first], other[first], d[first], place[first]
        own = np.unique(row)
        new_d, new_other = np.full((len(own), self.k), np.inf), np.full((len(own), self.k), np.iinfo(np.int64).max)
        at = np.searchsorted(own, row)
        new_d[at, place], new_other[at, place] = d, other
        both_d, both_other = np.concatenate([self.d[own], new_d], 1), np.concatenate([self.other[own], new_other], 1)
        best = np.lexsort((both_other, both_d), axis=1)[:, : self.k]
        self.d[own], self.other[own] = np.take_along_axis(both_d, best, 1), np.take_along_axis(both_other, best, 1)

    def columns(self) -> list[np.ndarray]:
        """Ids, other ids and distances."""
        there = np.isfinite(self.d)
        return [np.repeat(self.ids, self.k)[there.ravel()], self.other[there], self.d[there]]


def _nearest(left: DataFrame, right: DataFrame, size: int, carry: tuple[str, ...], schema: str, meet: Callable, held_rows: int = HELD_ROWS) -> DataFrame:
    """Rows of schema: each left block's results once it has met a task's right blocks.

    meet(results so far of the left block by key, left, right) adds to them; a key is the first columns after the id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, dict[tuple, Nearest]]] = {}
        names = [c.split(" ")[0] for c in schema.split(", ")]

        def out() -> Iterator[pa.RecordBatch]:
            for _, results in held.values():
                for key, found in results.items():
                    ids, other, d = found.columns()
                    yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(np.full(len(ids), v, np.int32)) for v in key], pa.array(other), pa.array(d)], names)

        for l, r in pairs_of(batches, carry):
            if l.number not in held and sum(n for n, _ in held.values()) + len(l.id) > held_rows:
                yield from out()
                held.clear()
            meet(held.setdefault(l.number, (len(l.id), {}))[1], l, r)
        yield from out()

    return block_pairs(left, right, size, carry).mapInArrow(run, schema)


def neighbours(left: DataFrame, right: DataFrame, metric: str, k: int, exclude_self: bool = True, size: int = 1024) -> DataFrame:
    """(id, rank, other, d): the k nearest right rows of each left row, ties to the smaller id."""

    def meet(results: dict, l: Block, r: Block) -> None:
        found = results.setdefault((), Nearest(l.id, k))
        found.meet(metric, l.x, r.x, r.id, l.id[:, None] == r.id if exclude_self else None)

    found = _nearest(left, right, size, (), "id long, other long, d double", meet)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "d")


def class_neighbours(left: DataFrame, right: DataFrame, metric: str, k: int, size: int = 1024) -> DataFrame:
    """(id, y, rank, other, d): of each class the k nearest right rows of each left row, in one pass; ties to the smaller id.

    left and right: id, x, y, fold.  Rows of the same fold never meet; a left fold of null meets all.
    """

    def meet(results: dict, l: Block, r: Block) -> None:
        lf, rf, y = l.carried["fold"], r.carried["fold"], r.carried["y"]
        for c in np.unique(y[y >= 0]).tolist():
            own = y == c
            found = results.setdefault((c,), Nearest(l.id, k))
            found.meet(metric, l.x, r.x[own], r.id[own], (lf[:, None] == rf[own]) & (lf[:, None] >= 0))

    found = _nearest(left, right, size, ("y", "fold"), "id long, y int, other long, d double", meet)
    rank = F.row_number().over(Window.partitionBy("id", "y").orderBy("d", "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "y", "rank", "other", "d")


def kernel_sums(left: DataFrame, right: DataFrame, parts: list[tuple[int, int, float, float]], product: bool = False, size: int = 1024) -> DataFrame:
    """(id, total, diagonal): sums over right rows of a kernel of squared distances over column ranges.

    parts: (first, last, weight, gamma).  Additive: the weighted sum of exp(-gamma d2); product: the
    exponential of the weighted sum.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, left, sums = ["id", "total", "diagonal"], None, None
        for l, r in pairs_of(batches):
            if l is not left:
                if left is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (left.id, *sums)], names)
                left, sums = l, np.zeros((2, len(l.id)))
            d2 = [(w, g, sqeuclidean(l.x[:, a:b], r.x[:, a:b])) for a, b, w, g in parts if w]
            kernel = np.exp(-sum(w * g * d for w, g, d in d2)) if product else sum(w * np.exp(-g * d) for w, g, d in d2)
            sums += kernel.sum(1), np.where(l.id[:, None] == r.id, kernel, 0).sum(1)
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (left.id, *sums)], names)

    return block_pairs(left, right, size).mapInArrow(add, "id long, total double, diagonal double").groupBy("id").agg(F.sum("total").alias("total"), F.sum("diagonal").alias("diagonal"))


def hashed_partners(vec: DataFrame, seed: int, partners: int) -> DataFrame:
    """(id, x, other, x2): each row with the rows after it in a hash order, a pair sample that grows with the table."""
    from .folds import hashed_rank

    ranked = hashed_rank(vec.select("id", "x"), seed, "id")
    n = F.broadcast(ranked.agg(F.count("*").alias("n")))  # one row
    asked = ranked.join(n).select("id", "x", "n", F.col("k").alias("k0"), F.explode(F.sequence(F.lit(1), F.lit(partners))).alias("s")).withColumn("k", (F.col("k0") + F.col("s")) % F.col("n"))
    other = ranked.select(F.col("id").alias("other"), F.col("x").alias("x2"), "k")
    return asked.join(other, "k").where("id <> other").select("id", "x", "s", "other", "x2")
