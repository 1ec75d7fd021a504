"""Line dedup with a log-template tree.

A line's tokens are parted by blanks; a token with a digit is a variable field.  The tree
has a fixed depth: the number of tokens, then the leading tokens.  Inside a leaf, a token is
constant that at its place occurs in two documents or more and in a tenth of the leaf's
lines; other tokens are variable fields too, if they are few enough.  What is left is the template.  A template that
recurs across documents is dropped from all of them but for its first occurrence (by
doc_id, then by place), so that one copy of every text stays.

A template recurs if it is in `min_docs` documents, or in two if it has `long_tokens` tokens:
equal long lines are no accident.  Lines with fewer than `min_tokens` tokens, or without two
constant words, stay.

Scale: exact repeats are grouped before tokens are taken apart, and only leaves with
different lines take them apart; tokens move as hashes, without the leading ones.  All groups
are counted with partial aggregates.  Lines meet their templates by key, but templates
with a two-thousandth of all lines, at most two thousand, are sent to the lines.  In the end
each text moves once, to the numbers of its dropped lines; that plan is the same at all sizes.

Defined cases: null texts stay null; empty ones stay empty; a very long one is an array of lines
in one row.  Rows with equal doc_id and text are one document and lose the same lines.  A null
doc_id comes first in the order.  Equal lines of one document are ties by their places: the
first stays.  An empty table gives an empty result.  Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small

BLANKS = r"[ \t\x0B\f\r]+"
FIELD = "<*>"
KEY_ROWS = 1_000_000  # keys of 8 bytes up to which they are broadcast
HOT = 2000  # a template with more than one in so many lines is hot


def tidy(line: Column) -> Column:
    """Tokens joined by single blanks; most lines are so already."""
    return F.trim(F.when(F.rlike(line, F.lit(r"  |[\t\x0B\f\r]")), F.regexp_replace(line, BLANKS, " ")).otherwise(line))


def masked(line: Column) -> Column:
    """Tokens with a digit generalised."""
    return F.when(F.rlike(line, F.lit("[0-9]")), F.regexp_replace(line, r"[^ 0-9]*+[0-9][^ ]*", FIELD)).otherwise(line)


def _key(*c: Column) -> list[Column]:
    """Two 64-bit hashes, together a 128-bit key."""
    return [F.xxhash64(*c), F.xxhash64(F.lit("second"), *c)]


def templates(docs: DataFrame, depth: int = 4, similarity: float = 0.7, min_tokens: int = 3, share: float = 0.1) -> DataFrame:
    """(doc_id, doc, pos, n, words, t1, t2) of every line that may be dropped; docs: doc_id, doc (key of the row), text.

    words: tokens that are no variable fields.  Only the lines of leaves with different lines
    move with their text; all other steps move keys.
    """
    # Before the lines become rows, so that no filter above repeats the patterns.
    lines = docs.select("doc_id", "doc", F.posexplode(F.transform(F.transform(F.split("text", "\n"), tidy), masked)).alias("pos", "m"))
    lines = lines.withColumn("n", F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1).where(F.col("n") >= min_tokens)
    a, b = _key(F.col("m"))
    leaf = F.xxhash64("n", F.substring_index("m", " ", depth))
    words = (F.col("n") - (F.length("m") - F.length(F.replace("m", F.lit(FIELD), F.lit("")))) / len(FIELD)).cast("int")
    lines = materialize(lines.select("doc_id", "doc", "pos", "n", words.alias("words"), leaf.alias("leaf"), a.alias("h1"), b.alias("h2"), "m"), "line-masked")

    mixed = lines.groupBy("leaf").agg(F.min("h1").alias("a"), F.max("h1").alias("b"), F.min("doc").alias("c"), F.max("doc").alias("d"), F.count("*").alias("leaf_lines")).where("a <> b and c <> d").select("leaf", "leaf_lines")
    forms = lines.join(small(materialize(mixed, "line-mixed"), KEY_ROWS), "leaf").groupBy("h1", "h2").agg(F.min("leaf").alias("leaf"), F.min("leaf_lines").alias("leaf_lines"), F.count("*").alias("lines"), F.min("m").alias("m"), F.min("doc").alias("d1"), F.max("doc").alias("d2"))
    forms = materialize(forms.withColumn("form", F.monotonically_increasing_id()), "line-forms")
    # The leading tokens are constant, since the leaf has several documents; the others move as hashes of their places.
    parts = forms.select("form", "leaf", "d1", "d2", "lines", "leaf_lines", F.posexplode(F.split("m", " ")).alias("at", "token")).where((F.col("at") >= depth) & (F.col("token") != FIELD))
    parts = parts.select("form", "at", F.xxhash64("leaf", "at", "token").alias("spot"), "d1", "d2", "lines", "leaf_lines")
    constant = parts.groupBy("spot").agg(F.min("d1").alias("d1"), F.max("d2").alias("d2"), F.sum("lines").alias("lines"), F.min("leaf_lines").alias("leaf_lines"))
    constant = constant.where((F.col("d1") != F.col("d2")) & (F.col("lines") >= share * F.col("leaf_lines"))).select("spot")
    places = parts.select("form", "at", "spot").join(constant, "spot", "left_semi").groupBy("form").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    rebuilt = forms.join(places, "form", "left").select("h1", "h2", F.split("m", " ").alias("tokens"), F.coalesce("ats", F.array().cast("array<int>")).alias("ats"))
    n, lead = F.size("tokens"), F.filter("tokens", lambda t, i: (i < depth) & (t != FIELD))
    plain, fields = F.size("ats") + F.size(lead), F.size(F.filter("tokens", lambda t: t == FIELD))
    wide = rebuilt.where((plain + fields >= similarity * n) & (plain + fields < n) & (plain >= 2))
    # A flag for each token: 1 if it is constant.
    before = lambda i: F.when(i == 0, F.lit(depth - 1)).otherwise(F.get("ats", i - 1))
    flags = F.array_join(F.transform("ats", lambda at, i: F.concat(F.repeat(F.lit("0"), at - before(i) - 1), F.lit("1"))), "")
    flags = F.split(F.rpad(F.concat(F.lit("1" * depth), flags), n, F.lit("0")), "")
    text = F.array_join(F.zip_with("tokens", flags, lambda t, f: F.when(f == "1", t).otherwise(FIELD)), " ")
    wide = wide.select("h1", "h2", *[k.alias(n) for k, n in zip(_key(text), ("g1", "g2"))])
    wide = small(materialize(wide, "line-wide"))
    return lines.join(wide, ["h1", "h2"], "left").select("doc_id", "doc", "pos", "n", "words", F.coalesce("g1", "h1").alias("t1"), F.coalesce("g2", "h2").alias("t2"))


def dedup_lines(docs: DataFrame, depth: int = 4, similarity: float = 0.7, min_docs: int = 3, min_tokens: int = 3, long_tokens: int = 20, doc_id: str = "doc_id", text: str = "text", share: float = 0.1, hot: int = HOT) -> DataFrame:
    """All columns of docs with the recurring lines taken from the text; adds lines_seen and lines_dropped (replaced if there)."""
    own = [c for c in docs.columns if c not in ("lines_seen", "lines_dropped")]
    doc = F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), F.lit("doc"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), doc.alias("doc"))
    slim = rows.select(F.col("row")[doc_id].alias("doc_id"), "doc", F.col("row")[text].alias("text")).where("text is not null")
    lines = materialize(templates(slim, depth, similarity, min_tokens, share), "line-templates")
    usable = lines.where("words >= 2").select("doc_id", "doc", "pos", "n", "t1", "t2")
    groups = usable.groupBy("t1", "t2", "doc").agg(F.min(F.struct("doc_id", "doc", "pos")).alias("first"), F.max("n").alias("n"), F.count("*").alias("lines"))
    groups = groups.groupBy("t1", "t2").agg(F.count("*").alias("docs"), F.min("first").alias("first"), F.max("n").alias("n"), F.sum("lines").alias("lines"))
    recurring = groups.where((F.col("docs") >= min_docs) | ((F.col("docs") >= 2) & (F.col("n") >= long_tokens))).select("t1", "t2", "lines", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    recurring = materialize(recurring, "line-recurring")
    least = lines.count() / hot
    often, seldom = recurring.where(F.col("lines") > least).withColumn("often", F.lit(True)), recurring.where(F.col("lines") <= least).drop("lines")
    marked = usable.drop("doc_id", "n").join(F.broadcast(often.drop("lines")), ["t1", "t2"], "left")  # fewer than `hot` rows
    met = marked.where("often").drop("often").unionByName(marked.where("often is null").select("t1", "t2", "doc", "pos").join(seldom, ["t1", "t2"]))
    gone = met.where((F.col("doc") != F.col("first_doc")) | (F.col("pos") != F.col("first_pos"))).groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    joined = rows.join(gone, "doc", "left")
    content = F.col("row")[text]
    split = F.split(content, "\n")
    # A flag for each line, from the sorted places of those that go: linear in the lines, however many go.  array_join skips nulls.
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get("gone", i - 1))
    flags = F.array_join(F.transform("gone", lambda at, i: F.concat(F.repeat(F.lit("1"), at - before(i) - 1), F.lit("0"))), "")
    flags = F.split(F.rpad(flags, F.size(split), F.lit("1")), "")
    kept = F.when(F.col("gone").isNull(), content).otherwise(F.array_join(F.zip_with(split, flags, lambda line, f: F.when(f == "1", line)), "\n"))
    return joined.select(*[(kept if c == text else F.col("row")[c]).alias(c) for c in own], F.coalesce(F.size(split), F.lit(0)).cast("long").alias("lines_seen"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("lines_dropped"))
