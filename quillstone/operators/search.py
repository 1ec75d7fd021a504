"""Searches over settings of models: a table of trials that jobs fill side by side and that a stopped run resumes from.

A trial's rows are written under a folder named by the hash of its settings and its stage, in one go; what is
there is not computed again, by this run or a later one.  Selections and gates are queries over that table.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .parallel import side_by_side

ROWS = "settings string, repeat int, fold int, auc double"


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the values, in the order of the names."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def drawn(space: Mapping[str, Sequence], n: int, seed: int) -> list[dict]:
    """n different combinations in the order of MD5 of seed and settings: a randomised search that anybody can repeat."""
    whole = grid(space)
    return sorted(whole, key=lambda s: hashlib.md5(f"{seed}:{key_of(s)}".encode()).hexdigest())[:n]


def key_of(settings: Mapping) -> str:
    return json.dumps(settings, sort_keys=True)


class Trials:
    """The table of trials in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, stage: str, settings: Mapping) -> str:
        return f"{self.root}/stage={stage}/trial={hashlib.sha256(key_of(settings).encode()).hexdigest()[:24]}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def table(self) -> DataFrame:
        """stage, trial, settings, repeat, fold, auc of all finished trials."""
        if not self._exists(self.root):
            return self.spark.createDataFrame([], f"{ROWS}, stage string, trial string")
        return self.spark.read.schema(f"{ROWS}, stage string, trial string").option("basePath", self.root).parquet(f"{self.root}/stage=*/trial=*")

    def missing(self, stage: str, settings: list[dict]) -> list[dict]:
        return [s for s in settings if not self._exists(f"{self._folder(stage, s)}/_SUCCESS")]

    def run(self, stage: str, settings: list[dict], evaluate: Callable[[dict], DataFrame], most: int = 8) -> int:
        """Evaluates what is missing; evaluate gives (repeat, fold, auc).  Returns how many were."""
        todo = self.missing(stage, settings)

        def one(s: dict) -> None:
            rows = evaluate(s).select(F.lit(key_of(s)).alias("settings"), F.col("repeat").cast("int"), F.col("fold").cast("int"), F.col("auc").cast("double"))
            rows.coalesce(1).write.mode("overwrite").parquet(self._folder(stage, s))  # a row per fold; what a stopped run left is replaced

        side_by_side([partial(one, s) for s in todo], most)
        return len(todo)


def summary(trials: DataFrame) -> DataFrame:
    """(stage, settings, folds, mean, std) of every trial."""
    return trials.groupBy("stage", "settings").agg(F.count("*").alias("folds"), F.round(F.avg("auc"), 9).alias("mean"), F.round(F.stddev_pop("auc"), 9).alias("std"))


def best(trials: DataFrame, stage: str, k: int) -> list[dict]:
    """The k settings of the stage with the highest mean; ties to the smaller deviation, then by the settings' text."""
    rows = summary(trials).where(F.col("stage") == stage).orderBy(F.desc("mean"), "std", "settings").limit(k).collect()
    return [json.loads(r.settings) for r in rows]


def gated(trials: DataFrame, first: str, second: str, within: float) -> DataFrame:
    """The settings that both stages have: means, and whether the second is above the first or at most `within` below."""
    s = summary(trials)
    one, two = (s.where(F.col("stage") == n).select("settings", F.col("mean").alias(f"mean_{i}"), F.col("std").alias(f"std_{i}")) for i, n in ((1, first), (2, second)))
    return one.join(two, "settings").withColumn("passes", F.col("mean_2") >= F.col("mean_1") - within)


def two_stages(trials: Trials, settings: list[dict], evaluate: Callable[[dict, Sequence[int]], DataFrame], repeats: int, keep: int, within: float = 0.003) -> DataFrame:
    """Stage one: all settings on the first repeat; stage two: the best of them on all repeats.  The gate's rows, the winner marked."""
    trials.run("one", settings, lambda s: evaluate(s, [0]))
    chosen = best(trials.table().where(F.col("settings").isin([key_of(s) for s in settings])), "one", keep)
    trials.run("two", chosen, lambda s: evaluate(s, range(repeats)))
    rows = gated(trials.table().where(F.col("settings").isin([key_of(s) for s in chosen])), "one", "two", within)
    first = F.max_by("settings", F.struct("mean_2", -F.col("std_2"), F.col("settings")))
    winner = rows.where("passes").agg(first.alias("winner"))
    return rows.join(F.broadcast(winner)).withColumn("best", F.coalesce(F.col("settings") == F.col("winner"), F.lit(False))).drop("winner")  # a row per chosen setting
