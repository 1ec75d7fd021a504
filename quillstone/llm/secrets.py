"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed by its SHA-256.  The ledger is a table with
one row per (blob, rule, rule_version) that has been scanned and its spans; a run scans
the pairs that the ledger lacks, appends them, and joins the findings of all blobs back
to every path that holds them.  A new rule version re-scans only that rule.

Spans are half-open and count code points.  They come from two built-in functions that
walk the same matches: the pieces between matches (split) and the matches themselves
(regexp_extract_all); running lengths place each match.

Defined cases: a null text is scanned as an empty one; a very long one is scanned whole.  Equal
texts are scanned once.  Spans of several kinds with one start go in the rules' order.
Repeated rows return as often as they came; repeated ledger rows count once.  Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, narrow, salted_join

SPANS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose value (group, 0: the whole) is shorter than `least` are dropped."""

    name: str
    version: int
    pattern: str
    group: int
    least: int


#: The base kinds in their order.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
)
#: The same matches, found without stopping at the short ones: a run that is too short holds no longer one.
FASTER = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in order."""
    pattern = F.lit(FASTER.get(rule.name, rule.pattern) if rule in BASE_RULES else rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["piece"])
        end = start + F.char_length(pair["hit"])
        value = pair["hit"] if rule.group == 0 else F.regexp_extract(pair["hit"], rule.pattern, rule.group)
        span = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct(end.cast("long").alias("at"), F.when(F.char_length(value) >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, h: F.struct(p.alias("piece"), h.alias("hit"))), zero, step)["out"]
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPANS))


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE_RULES, path: str = "path", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scans what the ledger lacks.

    versions: one row per version of a path.  Returns (paths: path and blob of every row;
    new: the ledger rows that this run adds; known: all ledger rows, old and new).
    """
    versions = narrow(versions, path=path, text=text).select("path", F.coalesce("text", F.lit("")).alias("text"))
    versions = versions.withColumn("blob", blob_of(F.col("text")))
    blobs = versions.select("blob", "text").dropDuplicates(["blob"])
    names = [F.lit(f"{r.name}@{r.version}") for r in rules]
    if ledger is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "rule", "rule_version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size(F.array_except(F.array(*names), "seen")) > 0)
    done = [F.when(~F.array_contains("seen", n), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("rule_version"), spans(F.col("text"), r).alias("spans"))) for r, n in zip(rules, names)]
    new = todo.select("blob", *[d.alias(f"r{i}") for i, d in enumerate(done)])
    new = new.select("blob", F.explode(F.array_compact(F.array(*[F.col(f"r{i}") for i in range(len(rules))]))).alias("f")).select("blob", "f.rule", "f.rule_version", "f.spans")
    new = materialize(new, "secret-ledger")
    return versions.select("path", "blob"), new, new if ledger is None else ledger.select(new.columns).unionByName(new)


def _is(rule: Rule):
    return lambda s: s.rule == rule.name


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s.rule, s.start.cast("string"), s.end.cast("string"))), ",")


def open_ledger(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The ledger kept at this path of a shared store; None if there is none yet."""
    if path is None:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def report(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Per path row: counts by rule, the spans as kind:start:end, by start, then by the rules' order, and the base kinds' alone (base)."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.version)])
    current = ledger.where(F.col("rule_version") == F.try_element_at(version, F.col("rule"))).where(F.size("spans") > 0)
    items = current.select("blob", "rule", F.transform("spans", lambda s: F.struct(s.start.alias("start"), F.element_at(order, F.col("rule")).alias("kind"), s.end.alias("end"), F.col("rule").alias("rule"))).alias("items"))
    found = items.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_set("items"))).alias("items"))  # a ledger row that came twice counts once
    base = F.filter("items", lambda s: s.rule.isin([r.name for r in BASE_RULES]))
    per_blob = found.select("blob", *[F.size(F.filter("items", _is(r))).cast("long").alias(f"n_{r.name}") for r in rules], _joined(F.col("items")).alias("spans"), _joined(base).alias("base"))
    joined = salted_join(paths, per_blob, "blob", "path")
    return joined.select("path", "blob", *[F.coalesce(f"n_{r.name}", F.lit(0)).cast("long").alias(f"n_{r.name}") for r in rules], F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("base", F.lit("")).alias("base"))
