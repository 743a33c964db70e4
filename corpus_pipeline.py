"""A training-data pipeline over ``documents``: five stages, each on all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partwatch.llm import language, pieces
from partwatch.llm.exchange import partitions
from partwatch.llm.fm_index import find_contamination
from partwatch.llm.graph import durable, written
from partwatch.llm.queries import PIECE_MODEL, remainder, table
from partwatch.llm.repeats import without_repeats
from partwatch.llm.signature_tree import jaccard_groups

# Fewer ids than this (8 bytes each) are broadcast to take documents out; more are joined.
BROADCAST_IDS = 1_000_000


def _blocks(spark: SparkSession) -> int:
    """Twice the blocks that the operators choose themselves: workers of the other stages hold memory here, too."""
    return 4 * partitions(spark)


def _number(docs: DataFrame, column: str) -> str:
    return f"__{docs.columns.index(column)}"


def _numbered_columns(docs: DataFrame) -> DataFrame:
    """``docs`` under names that no operator adds, so that columns of such names are not lost."""
    return docs.select(*[F.col(f"`{c}`").alias(_number(docs, c)) for c in docs.columns])


def _named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(_number(docs, c)).alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the documents with a language; documents without a determined language go.

    That is: a null or empty text, one without a letter, or a posterior of less than one half.
    """
    model = language.train(docs.where(remainder("doc_id", 3) != 1))
    rows = language.identify(_numbered_columns(docs), model, text_col=_number(docs, "text"))
    return _named(rows.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= 0.5)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.75 of five-word shingles, the document with the smallest id stays.

    Of the rows with the same id and text one stays. Rows that share an id but not the text are documents of their own, each judged
    by its own text; in a group the smallest SHA-256 of the text decides between them. Rows without an id link with nothing, and
    all of them stay.
    """
    columns, key = docs.columns, "doc_id"
    often = durable(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if not often.isEmpty():
        docs, key = _numbered(docs, _small(often)), "__n"
    groups = jaccard_groups(docs.select(key, "text"), id_col=key, k=5, percent=75, n_blocks=_blocks(spark))
    gone = durable(groups.where("component_id <> id").select(F.col("id").alias(key)).distinct())
    return docs.join(_small(gone), key, "left_anti").select(columns)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _numbered(docs: DataFrame, often: DataFrame) -> DataFrame:
    """One row of each id and text, with ``__n``, numbers in the order of both; ``often`` are the ids of several rows."""
    digest = F.coalesce(F.sha2("text", 256), F.lit("")).alias("__digest")
    once = docs.join(often, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.join(often, "doc_id", "left_semi").groupBy("doc_id", digest).agg(F.min(F.struct(docs.columns)).alias("row"))
    rows = written(once.unionByName(repeated.select("row.*")), "distinct_rows")
    numbers = rows.where("doc_id IS NOT NULL").select("doc_id", digest).orderBy("doc_id", "__digest")
    numbers = durable(numbers.withColumn("__n", F.monotonically_increasing_id()))
    return written(rows.select("*", digest).join(numbers, ["doc_id", "__digest"], "left").select(*docs.columns, "__n"), "numbered_rows")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 35 words that also starts elsewhere leave the text; all documents stay."""
    text, numbered = _number(docs, "text"), _numbered_columns(docs)
    carry = [c for c in numbered.columns if c != text]
    rows = without_repeats(numbered, id_col=_number(docs, "doc_id"), text_col=text, width=35, carry=carry, n_blocks=_blocks(spark))
    out = {text: F.col("kept")}
    if "n_chars" in docs.columns:
        out[_number(docs, "n_chars")] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return _named(rows.withColumns(out), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lie in benchmark windows of 13 words go."""
    rows = find_contamination(_numbered_columns(docs), table(spark, sf_dir, "benchmark"), text_col=_number(docs, "text"), width=13)
    return _named(rows.where("NOT contaminated"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their whole texts, their number, and whether decoding gives the text back."""
    model = pieces.Pieces(PIECE_MODEL)
    rows = pieces.encode(docs, model, exact_col="exact")
    return rows.select(*docs.columns, "ids", F.size("ids").alias("n_ids"), "exact")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", remove_repeats),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]

# Language models and piece scores are beyond SQL; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. What a stage keeps is written to the shared folder, so that a lost executor repeats one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
