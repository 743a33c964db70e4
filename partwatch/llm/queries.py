"""The operators of this package over their whole tables, with the columns agreed for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, licences, pieces, quality, shards, spelling, suffixes, tandems
from .cells import near_groups
from .fm_index import find_contamination
from .licences import scan_licences
from .repeats import without_repeats
from .signature_tree import jaccard_groups
from .site_templates import extract_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=35)
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256", "n_spans")


@query
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jaccard_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)
    return rows.withColumnRenamed("id", "doc_id")


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = find_contamination(docs, table(spark, sf_dir, "benchmark"), width=13)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    n_items = F.size("items").cast("long").alias("n_items")
    return rows.select("doc_id", "n_words", "n_hit", n_items, digest.alias("items_sha256"), "contaminated")


@query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "matches", "licences")]
    return rows.select("doc_id", *joined, F.size("licences").cast("long").alias("n_licences"))


ORACLES["op9_license_scans"] = licences.oracle()


def remainder(id_col: str, n: int):
    return F.crc32(F.col(id_col).cast("string")) % n


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    weights = quality.train(quality.labelled_sample(docs, labels, max_rows=20_000))
    rows = quality.score(docs, weights)
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.where(remainder("doc_id", 3) != 1))
    rows = language.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"), threshold=0.98).withColumnRenamed("id", "vec_id")


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.Pieces(PIECE_MODEL)
    rows = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, exact_col="exact")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


@query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a misspelling planted in each run whose checksum 31 divides: one code point is left out."""
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"))
    checksum = F.crc32(F.concat_ws(":", "id", "run"))
    at = (checksum % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(checksum % 31 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return spelling.spelling_groups(spelling.vocabulary(words, min_length=7, min_count=2), ratio=10)


@query
def op12_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 by the ``key`` law: the id and the number of shards decide, and a 25th shard takes rows only into itself."""
    docs, tree = table(spark, sf_dir, "documents"), shards.even_tree(24)
    rows = docs.select(
        "doc_id", shards.text_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("key").alias("law"),
    )
    return shards.with_slots(shards.placed(rows, tree, grown_tree=shards.grown(tree))).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, with one planted in a tenth of the documents: from word a on the words repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (h % 10 == 0).alias("planted"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    docs = docs.withColumn("words", words).withColumn("n", F.size("words").cast("long")).withColumn("a", F.col("g") % F.col("n"))
    period = 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.get("words", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")),
    )
    text = F.when(F.col("planted") & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    rows = tandems.periodic_runs(docs.withColumn("p", period).select("doc_id", text.alias("text")), min_length=6, min_exponent=4)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
