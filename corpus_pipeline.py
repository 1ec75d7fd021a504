"""The training-data pipeline: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the docs of the next one.  All but the last return the columns of docs.

Defined cases of all stages: extra columns are kept as they are, whatever their names; a very
long text is taken whole; a null doc_id is a value like any other; an empty table gives an
empty one.  What each does with null and empty texts, ties and repeated rows it says itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language
from quillstone.llm.common import collect_garbage, materialize, narrow, small, table
from quillstone.llm.decontam import contaminated_words
from quillstone.llm.lines import dedup_lines
from quillstone.llm.packing import pack_documents
from quillstone.llm.queries import language_model, tokenizer_path
from quillstone.llm.simhash import near_copies

ARROW_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have ARROW_ROWS rows at most, in this session.

    A batch of texts is held several times over, by the JVM (outside of its heap) and by the worker; results do not depend on it.
    A stage is written when its function has returned, so the setting stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter, null and empty ones among them; all others are in some language.

    A language that the model has not learned is taken for the nearest one and stays.  Ties between languages do not matter; repeated rows are judged each.
    """
    short_batches(spark)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # which never clash with what is added
    found = language.identify(narrow(docs, **{v: k for k, v in names.items()}), language_model(docs), text=names["text"])
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*[F.col(v).alias(k) for k, v in names.items()])


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines from the texts; every document stays, and so do null and empty texts.

    The first document (by doc_id) keeps a recurring line, in it the first place; rows equal in doc_id and text lose the same lines.
    """
    return dedup_lines(docs).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (by doc_id) of each group of near copies.

    Near copies: texts whose sets of five-word shingles have a cosine of 0.8 or more, counted on the whole sets; fingerprints only propose.
    Texts without words, null ones too, are a group of their own.  Rows equal in doc_id and text are one document.
    """
    short_batches(spark)
    collect_garbage(spark)
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("second"), "doc_id", "text").alias("k2"))
    found = materialize(near_copies(rows.select("k1", "k2", "row.doc_id", "row.text")), "near-first")
    kept = rows.join(small(found.where("not first").select("k1", "k2")), ["k1", "k2"], "left_anti")
    repeated = found.where("first and copies > 1").select("k1", "k2")
    if not repeated.isEmpty():  # rows that are equal in doc_id and text
        once = kept.join(repeated, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
        kept = kept.join(repeated, ["k1", "k2"], "left_anti").unionByName(once)
    return kept.select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row with a benchmark item; null and empty texts stay, repeated rows fare alike."""
    collect_garbage(spark)
    found = contaminated_words(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "blob").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.md5("text").alias("md5"))
    return rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("md5") == F.col("blob")), "left_anti").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; a null or empty text is its end id alone, repeated rows are packed each."""
    short_batches(spark)
    collect_garbage(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: A fitted model, fingerprints and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
