"""Best-fit packing of token sequences in bulk-synchronous rounds.

Pieces of one length are a run of ranks, sequences with one gap a run of numbers; both are
rows of one small written table.  A round puts lengths and gaps in order by ranges of values
and sweeps each range from the largest value down: a gap waits on a stack, a length takes
from the top, which is its successor, the smallest gap that fits.  What a range cannot match
(lengths that need a larger gap, gaps that no length of the range took) meets in one more
sweep; both together match what one sweep over all values would.  Where several lengths want
a gap, the ranks decide, the longest first, and no sequence takes two lengths in a round.  The
gaps are then updated and the round repeats.  Lengths go by classes, the longest first; only
where no gap fits are new sequences opened, as many as the rest of the class needs at least.

Scale: the rows of a round are runs, at most about two for each length and gap up to the
capacity, whatever the input; the driver sees three sums a round.  The pieces stay
distributed: each finds its run by its length and its rank, which counts make without an
order over all pieces of a length.

Defined cases: a null text is an empty one: a piece of the end id alone.  Repeated rows are
packed as often as they come.  Pieces of equal length are put in order by a hash of their
doc_id, then by doc_id and piece.  A doc_id may have any type; a null one is a value like any
other.  An empty table gives no pieces.  A very long document is cut into pieces of the
capacity.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow
from .tokens import blocks, encoder, with_end

PIECES = "piece int, start long, length long, ids_crc32 long"
ROWS = "kind string, value long, first long, n long, seq long, each long, at long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents; only documents longer than the capacity are cut."""
    docs = narrow(docs, doc_id=doc_id, text=text)

    def cut(batches):
        enc = encoder(tokenizer, 300_000)
        for batch in batches:
            texts = batch.column(1)
            for a, b in blocks(texts):
                ids, cuts = with_end(*enc.encode(texts.slice(a, b - a)), end_id)
                parts = -(-np.diff(cuts) // capacity)
                doc = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(cuts)[doc] - start)
                view, at = ids.astype("<u4", copy=False).view(np.uint8), 4 * (cuts[doc] + start)
                crc = [zlib.crc32(view[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist())]
                columns = [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def sweep(rows: list[tuple], capacity: int, least: int) -> list[tuple]:
    """One sweep over rows (kind, value, first, n, seq, each, at).

    doc: n pieces of length `value` with ranks from `first`; gap: n sequences with `value` free tokens,
    numbered from `first`; run: n pieces of a length that go to the sequences from `seq`, `each` to one,
    from place `at` on; new: a gap that a run left, for the next round.  Lengths below `least` wait.
    """
    gaps = sorted((r[1:4] for r in rows if r[0] == "gap"), key=lambda r: (-r[0], -r[1]))
    docs = sorted((r[1:4] for r in rows if r[0] == "doc"), key=lambda r: (-r[0], r[1]))
    out = [r for r in rows if r[0] in ("run", "new")]
    stack: list[tuple[int, int, int]] = []
    pushed = 0
    for length, rank, left in docs:
        while pushed < len(gaps) and gaps[pushed][0] >= length >= least:
            stack.append(gaps[pushed])
            pushed += 1
        while stack and left and length >= least:
            gap, first, n = stack.pop()
            each = min(left, gap // length)
            taken = min(n, left // each)
            out.append(("run", length, rank, taken * each, first, each, capacity - gap))
            if gap > each * length:
                out.append(("new", gap - each * length, first, taken, 0, 0, 0))
            rank, left = rank + taken * each, left - taken * each
            if n > taken:
                stack.append((gap, first + taken, n - taken))
        if left:
            out.append(("doc", length, rank, left, 0, 0, 0))
    return out + [("gap", *g, 0, 0, 0) for g in [*stack, *gaps[pushed:]]]


def plan(totals: DataFrame, capacity: int, ranges: int = 16) -> DataFrame:
    """The runs of all pieces, from (length, n): length, first (rank), n, seq, each and at, written."""
    names = [f.split()[0] for f in ROWS.split(", ")]

    def round_(state: DataFrame, least: int) -> DataFrame:
        def swept(table: pa.Table) -> pa.Table:
            found = sweep(list(zip(*(table.column(n).to_pylist() for n in names))), capacity, least)
            kinds = [pa.string()] + [pa.int64()] * 6
            return pa.table([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

        near = state.groupBy(F.floor(F.col("value") * ranges / (capacity + 1))).applyInArrow(swept, ROWS)
        # What is matched passes by its own range; only the rest of all ranges meets.
        waits = F.when(F.col("kind").isin("doc", "gap"), F.lit(-1)).otherwise(F.floor(F.col("value") * ranges / (capacity + 1)))
        return materialize(near.groupBy(waits).applyInArrow(swept, ROWS), "pack-round")

    zero = F.lit(0).cast("long")
    state = totals.select(F.lit("doc").alias("kind"), F.col("length").alias("value"), zero.alias("first"), "n", zero.alias("seq"), zero.alias("each"), zero.alias("at"))
    state = materialize(state, "pack-round")
    runs, opened = [], 0
    # Few classes: finer ones cost rounds and save next to no sequence.
    for least in (capacity // 2 + 1, capacity // 4 + 1, 1):
        while True:
            waiting = state.where((F.col("kind") == "doc") & (F.col("value") >= least)).agg(F.sum("n"), F.sum(F.col("n") * F.col("value"))).first()
            if not waiting[0]:
                break
            fits = state.where("kind = 'gap'").agg(F.max("value")).first()[0] or 0
            shortest = state.where((F.col("kind") == "doc") & (F.col("value") >= least)).agg(F.min("value")).first()[0]
            if fits < shortest:  # new sequences: what the tokens need, and what the pieces need
                n = max(-(-waiting[1] // capacity), -(-waiting[0] // (capacity // least)))
                state = state.unionByName(state.sparkSession.range(1).select(F.lit("gap").alias("kind"), *[F.lit(v).cast("long").alias(c) for c, v in zip(names[1:], (capacity, opened, n, 0, 0, 0))]))
                opened += n
            found = round_(state, least)
            runs.append(found.where("kind = 'run'"))
            state = found.where("kind <> 'run'").withColumn("kind", F.when(F.col("kind") == "new", "gap").otherwise(F.col("kind")))
    if not runs:
        return state.select(F.col("value").alias("length"), *names[2:])
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    return every.select(F.col("value").alias("length"), *names[2:])


def pack(found: DataFrame, capacity: int, buckets: int = 256) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    found = materialize(found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")), "pack-pieces")
    counts = found.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    runs = plan(counts.groupBy("length").agg(F.sum("n").alias("n")), capacity).toPandas().to_numpy(np.int64)  # bounded by the capacity
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = found.withColumn("local", local).join(offsets, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local")).alias("rank"))
    held = found.sparkSession.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def place(batches):
        run = held.value
        key = (run[:, 0] << 48) + run[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            r = run[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            k = rank - r[:, 1]
            columns = [*batch.columns[:5], pa.array(r[:, 3] + k // r[:, 4]), pa.array(r[:, 5] + k % r[:, 4] * length)]  # sequence and place
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, {PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, tokenizer, capacity, end_id, doc_id, text), capacity)
