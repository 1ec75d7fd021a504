"""Sharding by balanced label propagation.

Documents with equal texts are linked.  Every linked document starts in a shard given
by the hash of its id; in each round, Spark joins count the votes of a group per
shard, and documents move to the shard in which most of their group is, as far as that
shard has room or others leave it in the same round.  At the end, ranks make the row counts exact: what exceeds a
quota and all documents without links fill the remaining room.

Scale: the state is one row per (group, bucket of document ids), so a group that holds a
third of all rows is many rows in as many tasks.  Votes are pre-aggregated.  The driver
sees the shards x shards flow matrix and shards + 1 totals, whatever the input.  Ranks
come from row_number() inside hash buckets plus bucket offsets, so no task orders a shard.

Defined cases: a null text has size 1, crc32 0 and no links; an empty text is a text like
any other.  A null doc_id is a value like any other.  Repeated rows are separate rows
with slots of their own.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, narrow, unit_hash

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, text_md5 string"


def _pick(shard: Column, values: list[int]) -> Column:
    """values[shard] as a CASE over the few shards."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def admitted(flow: dict[tuple[int, int], int], load: list[int], capacity: int, spare: int) -> list[float]:
    """Shares of the asked moves {(from, to): rows} into each shard, so that arrivals are at most what leaves it plus its room.

    From all moves downwards, so the shares are the largest.  A shard that is over the capacity by
    more than spare has to shrink; by less, it must not grow.
    """
    n = len(load)
    room = [capacity - x if x > capacity + spare else max(0, capacity - x) for x in load]
    come = [sum(flow.get((s, t), 0) for s in range(n) if s != t) for t in range(n)]
    share = [1.0] * n
    for _ in range(1000):
        leave = [sum(share[t] * flow.get((s, t), 0) for t in range(n) if t != s) for s in range(n)]
        new = [min(share[t], max(0.0, (room[t] + leave[t]) / come[t])) if come[t] else 1.0 for t in range(n)]
        done = max(a - b for a, b in zip(share, new)) < 1e-6
        share = new
        if done:
            break
    return share


def propagate(cells: DataFrame, shards: int, capacity: int, rounds: int) -> DataFrame:
    """Moves cells (grp, bucket, n, hot, shard) towards their groups' shards under the capacity."""
    closed: set[int] = set()  # shards that took next to nothing in the last round
    for round_ in range(rounds):
        votes = cells.groupBy("grp", "shard").agg(F.sum("n").alias("votes"))
        load = {r.shard: r.n for r in votes.groupBy("shard").agg(F.sum("votes").alias("n")).collect()}  # at most shards rows
        spare = max(1, capacity // 100)
        free = [s for s in range(shards) if s not in closed] or list(range(shards))
        order = F.struct("votes", F.xxhash64("grp", "shard"))
        target = votes.where(F.col("shard").isin(free)).groupBy("grp").agg(F.max_by(F.struct(F.col("shard").alias("to"), F.col("votes").alias("to_votes")), order).alias("t"))
        # A group may have no vote in an open shard yet: it then proposes one by its hash.
        fallback = F.element_at(F.array(*map(F.lit, free)), (F.pmod(F.xxhash64("grp"), F.lit(len(free))) + 1).cast("int"))
        best = votes.groupBy("grp").agg(F.max("votes").alias("best"))
        asked = (
            cells.join(votes, ["grp", "shard"]).join(best, "grp").join(target, "grp", "left")
            .withColumn("to", F.coalesce("t.to", fallback))
            .withColumn("to_votes", F.coalesce("t.to_votes", F.lit(0)))
            .withColumn("to", F.when((F.col("to_votes") > F.col("votes")) | ((F.col("to_votes") == F.col("votes")) & (F.xxhash64("grp", "to") > F.xxhash64("grp", "shard"))), F.col("to")).otherwise(F.col("shard")))
            .select("grp", "bucket", "n", "hot", "shard", "to")
        )
        asked = materialize(asked, "shard-asked")
        flow = asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # at most shards x shards rows
        flow = {(r.shard, r.to): r.n for r in flow}
        if all(a == b for a, b in flow):
            if not closed:
                return asked.select("grp", "bucket", "n", "hot", "shard")
            closed = set()
            continue
        share = admitted(flow, [load.get(s, 0) for s in range(shards)], capacity + 1, spare)
        closed = {s for s in range(shards) if share[s] < 0.1}
        # Groups move whole; a hot group moves by cells, so that it can fill a quota in part.
        u = F.when(F.col("hot"), unit_hash("grp", "bucket", F.lit(round_))).otherwise(unit_hash("grp", F.lit(round_)))
        allowed = F.element_at(F.array(*map(F.lit, share)), F.col("to") + 1)
        cells = asked.select("grp", "bucket", "n", "hot", F.when(u < allowed, F.col("to")).otherwise(F.col("shard")).alias("shard"))
    return cells


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 5, buckets: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document under the law ``rows``: shard sizes differ by one row at most.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not
    ``key``) and text_md5, the group of equal texts.
    """
    docs = narrow(docs, doc_id=doc_id, text=text)
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("crc"),
        F.md5("text").alias("grp"),
        F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int").alias("bucket"),
    )
    base = materialize(base, "shard-base")
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    capacity = total // shards

    cells = base.where("grp is not null").groupBy("grp", "bucket").agg(F.count("*").alias("n"))
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("group_n")).where("group_n > 1")
    cells = cells.join(sizes, "grp").select("grp", "bucket", "n", (F.col("group_n") > capacity // 16).alias("hot"), F.pmod("bucket", F.lit(shards)).cast("int").alias("shard"))
    cells = propagate(materialize(cells, "shard-cells"), shards, capacity, rounds)

    # Class: the shard of a linked document, or `shards` for one without links.
    placed = (
        base.join(cells.select("grp", "bucket", "shard", "hot"), ["grp", "bucket"], "left")
        .withColumn("class", F.coalesce("shard", F.lit(shards)))
        .withColumn("rank_bucket", F.when(F.col("shard").isNull() | F.col("hot"), F.pmod(F.xxhash64("doc_id", "grp"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64("grp"), F.lit(buckets))).cast("int"))
    )
    local = F.row_number().over(Window.partitionBy("class", "rank_bucket").orderBy("grp", "doc_id")) - 1
    placed = materialize(placed.select("doc_id", "size", "crc", "grp", "class", "rank_bucket", local.alias("local")), "shard-placed")

    counts = placed.groupBy("class", "rank_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("rank_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("class", "rank_bucket", F.coalesce(before, F.lit(0)).alias("before"))  # at most (shards + 1) x buckets rows
    filled = {r["class"]: r.n for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # at most shards + 1 rows
    linked = [filled.get(s, 0) for s in range(shards)]
    kept = [min(a, q) for a, q in zip(linked, quota)]
    over = [a - k for a, k in zip(linked, kept)]
    over_from = [0, *accumulate(over)]
    room_from = [0, *accumulate(q - k for q, k in zip(quota, kept))]

    rank = F.col("before") + F.col("local")
    c = F.col("class")
    stays = (c < shards) & (rank < _pick(c, [*kept, 0]))
    pool = _pick(c, over_from) + rank - _pick(c, [*kept, 0])  # a place among what the rooms are filled with
    filler = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        filler = F.when(F.col("pool") < room_from[s + 1], F.lit(s)).otherwise(filler)
    out = (
        placed.join(F.broadcast(offsets), ["class", "rank_bucket"])
        .withColumn("stays", stays).withColumn("rank", rank).withColumn("pool", pool)
        .withColumn("shard", F.when(F.col("stays"), c).otherwise(filler))
        .withColumn("slot", F.when(F.col("stays"), F.col("rank")).otherwise(_pick(F.col("shard"), kept) + F.col("pool") - _pick(F.col("shard"), room_from[:shards])))
    )
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("grp").alias("text_md5"))
