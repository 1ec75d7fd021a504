"""What a chain of filters costs, for every order of the filters, from one SQL CUBE.

Each row has a failure flag per filter.  The rows that survive a *set* of filters are the
same in whatever order the set is applied, so n filters need 2^n counts per part and not n!
chains: a CUBE over the flags and the part has, in the grouping set of the selected flags, the
row with all of these flags false: what survives the selection.  A step of an order is
then a pair of subsets, before and after it, and its loss is the difference of their rows.

Scale: each text is read once, in the scan's task, and leaves it as a digest and the answers of the
filters.  Labels meet documents by doc_id, copies meet by digest; both shuffles carry 32
bytes of text.  Copies are counted before they meet (a row per digest, part and label, at most), so a
text that a third of all documents share is a few rows to its task.  Before the CUBE
rows are counted by flags and part, so it expands at most 2^n rows per part.

Defined cases: a null text is the empty text, which fails the word filter and equals other empty
ones.  A null doc_id has no smaller one and is none: it never fails the copy filter.  Of equal
texts, all rows with the smallest doc_id pass it (ties, repeated rows).  A document with several label rows is good
or toxic if one of them says so; labels without a document, or without doc_id, count nowhere.  A null part is
the empty string.  Very long texts are words of one row's array.  An empty table gives no rows.  Extra
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize, narrow

BLANKS = r"[\x20\x09-\x0D]+"
#: Fixed values of the five filters: fewest words, percent of distinct words, percent of capitals, marks.
FEWEST, DISTINCT, CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D: failure conditions that a text answers by itself."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return {
        "A": F.size(words) < FEWEST,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT * F.size(words),
        "C": 100 * (F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))) > CAPITALS * F.char_length(text),
        "D": F.rlike(text, F.lit(MARKS)),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, failures: Mapping[str, Column] | None = None, copies: str = "E", part: str = "lang") -> DataFrame:
    """(part, a flag "fails X" per filter X, n, good, toxic): rows counted by what they fail.

    docs: doc_id, text and the part's column.  failures: conditions over the column `text`; by
    default text_failures.  copies: name of the filter that fails rows whose text a smaller doc_id has.
    """
    docs = narrow(docs, doc_id="doc_id", text="text", part=part).withColumns({"text": F.coalesce("text", F.lit("")), "part": F.coalesce("part", F.lit(""))})
    failures = text_failures(F.col("text")) if failures is None else failures
    names = list(failures)
    marks = narrow(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")])
    rows = docs.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[F.coalesce(c, F.lit(False)).alias(f"fails {n}") for n, c in failures.items()])
    flags = [f"fails {n}" for n in names]
    rows = rows.join(marks, "doc_id", "left").fillna(False, ["quality", "toxic"])
    own = rows.groupBy("digest", "part", "doc_id", "quality", "toxic", *flags).agg(F.count("*").alias("k"))
    # Flags follow from the text: this splits no digest.  Rows with the smallest doc_id, and how many there are:
    alike = own.groupBy("digest", "part", "quality", "toxic", *flags).agg(
        F.sum("k").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "k"))).alias("first"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("k"))), F.lit(0)).alias("nameless")
    )
    least = alike.groupBy("digest").agg(F.min("first.doc_id").alias("least"), F.collect_list(F.struct("part", "quality", "toxic", *flags, "n", "first", "nameless")).alias("of")).select("least", F.explode("of").alias("x")).select("least", "x.*")
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.k")).otherwise(0)
    both = F.array(F.struct(F.lit(False).alias("copy"), passing.alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("n") - passing).alias("n")))
    dealt = least.select("part", "quality", "toxic", *flags, F.explode(both).alias("x")).select("part", "quality", "toxic", *flags, F.col("x.copy").alias(f"fails {copies}"), F.col("x.n").alias("n")).where("n > 0")
    return dealt.groupBy("part", *flags, f"fails {copies}").agg(F.sum("n").alias("n"), *[F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))])


def survivors(counts: DataFrame, names: list[str]) -> DataFrame:
    """(part, subset, n, good, toxic): the rows of the part that fail none of the subset's filters.

    subset: a bit per filter, the first one the lowest.  A subset that nothing survives has no row.
    """
    cube = counts.cube("part", *[f"fails {n}" for n in names]).agg(F.grouping("part").alias("all parts"), *[F.grouping(f"fails {n}").alias(f"rolled {n}") for n in names], *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    alive = cube.where(F.col("all parts") == 0).where(" AND ".join(f"(`rolled {n}` = 1 OR NOT `fails {n}`)" for n in names))
    return alive.select("part", sum((F.col(f"rolled {n}").cast("int") * -1 + 1) * (1 << i) for i, n in enumerate(names)).alias("subset"), *[F.col(c).cast("long").alias(c) for c in ("n", "good", "toxic")])


def steps(parts: DataFrame, names: list[str]) -> DataFrame:
    """The rows of parts with (filter_order, step, filter, before, after): every step of every order, with the subsets around it.

    There are n! n of them, for the few filters there are.
    """
    bit = {n: F.lit(1 << i) for i, n in enumerate(names)}
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(names)))), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names))))).withColumn("filter", F.substr("filter_order", "step", F.lit(1)))
    before = sum(F.when(F.instr("filter_order", n) < F.col("step"), b).otherwise(0) for n, b in bit.items())
    after = sum(F.when(F.instr("filter_order", n) <= F.col("step"), b).otherwise(0) for n, b in bit.items())
    return rows.withColumns({"before": before, "after": after})


def audit(counts: DataFrame, names: list[str]) -> DataFrame:
    """A row per part, order of the filters and step: what is kept, and what the step's filter does there.

    counts: of flag_counts.  Columns: part, filter_order, step, filter, kept, removed, redundant
    (failing the filter, gone before), unique_fails, good_lost, toxic_lost, shapley (removed by the
    filter, summed over all orders).  Filters have names of one letter.
    """
    alive = materialize(survivors(counts, names), "survivors")  # 2^n rows per part at most, read three times
    rows = steps(alive.where("subset = 0").select("part"), names)
    for at in ("before", "after"):
        rows = rows.join(alive.select("part", F.col("subset").alias(at), *[F.col(c).alias(f"{c} {at}") for c in ("n", "good", "toxic")]), ["part", at], "left")
    rows = rows.fillna(0)
    lost = {c: F.col(f"{c} before") - F.col(f"{c} after") for c in ("n", "good", "toxic")}
    every = (1 << len(names)) - 1
    # Of each filter: what it fails by itself (its first steps), and what only it fails (its last steps).
    by_filter = rows.groupBy("part", "filter").agg(
        F.max(F.when(F.col("before") == 0, lost["n"])).alias("fails"), F.max(F.when(F.col("after") == every, lost["n"])).alias("unique_fails"), F.sum(lost["n"]).alias("shapley")
    )
    return rows.join(by_filter, ["part", "filter"]).select(
        "part", "filter_order", "step", "filter", F.col("n after").alias("kept"), lost["n"].alias("removed"), (F.col("fails") - lost["n"]).alias("redundant"), "unique_fails",
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), "shapley",
    )
