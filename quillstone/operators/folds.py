"""Stratified, repeated, nested and grouped folds from hashes: the same rows always fall into the same folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _order(seed: Column | int, key: Column) -> Column:
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat_ws(":", seed, key.cast("string")))


def hashed_rank(df: DataFrame, seed: Column | int, key: str, *by: str, name: str = "k", steps: int = 256) -> DataFrame:
    """Adds the place (from 0) of each row of a group in the order of md5(seed:key), then key.

    The first two hex digits of the hash are the steps: equal shares of any group, each
    ordered by itself, with the counts of the steps before.
    """
    from pyspark.sql import Window

    h = df.withColumn("__h", _order(seed, F.col(key))).withColumn("__s", F.substring("__h", 1, 2))
    counts = h.groupBy(*by, "__s").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "__s", before.alias("__b"))
    local = F.row_number().over(Window.partitionBy(*by, "__s").orderBy("__h", key)) - 1
    return h.withColumn("__l", local).join(offsets, [*by, "__s"]).withColumn(name, F.col("__b") + F.col("__l")).drop("__h", "__s", "__l", "__b")


def stratified(vec: DataFrame, k: int, seeds: list[int], key: str = "id", label: str = "y") -> DataFrame:
    """(repeat, seed, id, y, fold) for each seed; fold sizes of a class differ by one at most."""
    seeded = vec.select(key, label, F.posexplode(F.array(*map(F.lit, seeds))).alias("repeat", "seed"))
    ranked = hashed_rank(seeded, F.col("seed"), key, "repeat", "seed", label)
    return ranked.select("repeat", "seed", key, label, F.pmod(F.col("k"), F.lit(k)).cast("int").alias("fold"))


def group_order(shapes: list[tuple[int, int, int, int]], k: int) -> list[list[int]]:
    """For each shape (rows, rows of class 0, of class 1, groups of that shape) the order in which its groups are dealt to the folds.

    The largest groups come first.  Every fold gets the same number of groups of a shape; what is left over goes to the
    folds that have least of the classes that these groups hold.
    """
    total = [max(1, sum(s[c] * s[3] for s in shapes)) for c in (0, 1, 2)]
    load, out = [[0, 0, 0] for _ in range(k)], [[] for _ in shapes]
    for i in sorted(range(len(shapes)), key=lambda i: shapes[i][:3], reverse=True):
        shape, m = shapes[i][:3], shapes[i][3]
        order = sorted(range(k), key=lambda f: (sum(load[f][c] * shape[c] / total[c] ** 2 for c in (0, 1, 2)), f))
        for place, f in enumerate(order):
            got = m // k + (place < m % k)
            for c in (0, 1, 2):
                load[f][c] += got * shape[c]
        out[i] = order
    return out


def grouped(vec: DataFrame, k: int, group: str, label: str = "y", exact: int = 64, seed: int = 7) -> DataFrame:
    """vec with stratified folds that never cut a group: groups are dealt by their class counts.

    Groups with the same counts (a shape; those of more than `exact` rows: the same size and a sixteenth of class 1) are
    numbered by hash and dealt round the folds.  The shapes are what reaches the driver: there are fewer than the root of
    twice the rows different sizes, whatever the number of groups.  Rows with a null group are groups of their own by hash.
    """
    key = F.col(group)
    counts = vec.where(key.isNotNull()).groupBy(key.alias("__group")).agg(F.count("*").alias("__rows"), *[F.count_if(F.col(label) == c).alias(f"__n{c}") for c in (0, 1)])
    small = F.col("__rows") <= exact
    rough = lambda c: F.when(small, F.col(c)).otherwise(F.round(F.col(c) * 16 / F.col("__rows")) * F.col("__rows") / 16).cast("long")
    shaped = counts.select(F.xxhash64("__group").alias("__key"), "__group", "__rows", rough("__n0").alias("__shape0"), rough("__n1").alias("__shape1"))
    shapes = shaped.groupBy("__rows", "__shape0", "__shape1").agg(F.count("*").alias("m")).collect()  # a row per shape
    orders = group_order([(r["__rows"], r["__shape0"], r["__shape1"], r["m"]) for r in shapes], k)
    dealt = vec.sparkSession.createDataFrame([(r["__rows"], r["__shape0"], r["__shape1"], o) for r, o in zip(shapes, orders, strict=True)], "__rows long, __shape0 long, __shape1 long, __order array<int>")
    placed = hashed_rank(shaped, seed, "__key", "__rows", "__shape0", "__shape1", name="__place").join(F.broadcast(dealt), ["__rows", "__shape0", "__shape1"])
    fold = placed.select("__group", F.element_at("__order", (F.col("__place") % k + 1).cast("int")).alias("fold"))
    alone = F.pmod(F.xxhash64(F.lit(seed), *[c for c in vec.columns if c != group]), F.lit(k)).cast("int")
    return vec.join(fold, key == F.col("__group"), "left").withColumn("fold", F.coalesce("fold", alone)).drop("__group")


#: Fixed value: exp(-0.8), the chance that a row with 0.8 expected draws is not drawn.
UNDRAWN = 0.44932896411722156


def draw_steps(most: int = 8) -> list[float]:
    """The chances that a row is drawn k times or less, k = 0, 1, ...: Poisson with mean 0.8."""
    steps, p, total = [], UNDRAWN, 0.0
    for n in range(most):
        total += p
        steps.append(total)
        p *= 0.8 / (n + 1)
    return steps


def draws(seed: int, member: Column | int, key: str = "id") -> Column:
    """How often the row is drawn for the member, Poisson(0.8) by MD5 of seed, member and key: rows are drawn apart from each other, without a shuffle."""
    member = F.lit(str(member)) if isinstance(member, int) else member.cast("string")
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), member, F.col(key).cast("string"))), 1, 13)
    u = F.conv(digits, 16, 10).cast("double") / float(16**13)
    return F.size(F.filter(F.array(*map(F.lit, draw_steps())), lambda s: s <= u))


def bootstrap(vec: DataFrame, members: int, seed: int, key: str = "id") -> DataFrame:
    """(member, id, weight) of the rows that each member draws."""
    spread = vec.select(key, F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    return spread.select("member", key, draws(seed, F.col("member"), key).alias("weight")).where("weight > 0")


__all__ = ["bootstrap", "draw_steps", "draws", "grouped", "hashed_rank", "stratified"]
