"""Manifests: package.json maps and Gradle texts (SRC-01, SRC-02, U-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.versions import clean_range, npm_link

# Manifest keys and the section label of each.
NPM_SECTIONS = (
    ("dependencies", "producción"),
    ("devDependencies", "desarrollo"),
    ("peerDependencies", "peer"),
    ("optionalDependencies", "opcional"),
)
NPM_DDL = (
    "name:string,version:string,dependencies:map<string,string>,devDependencies:map<string,string>,"
    "peerDependencies:map<string,string>,optionalDependencies:map<string,string>"
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path and whole text."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def parse_npm(manifests: DataFrame) -> DataFrame:
    """``manifests(project_id, content)`` with the parsed document; a bad text gives ``ok = false``."""
    # Read as a list of one, so that text after the document makes it invalid.
    docs = F.from_json(F.concat(F.lit("["), "content", F.lit("]")), f"array<struct<{NPM_DDL}>>")
    return (
        manifests.withColumn("_docs", docs)
        .withColumn("ok", F.coalesce(F.size("_docs") == 1, F.lit(False)))
        .withColumn("doc", F.when(F.col("ok"), F.col("_docs")[0]))
        .drop("_docs")
    )


def npm_dependencies(parsed: DataFrame) -> DataFrame:
    """One row per declared dependency, in document order (``ord`` sorts within a project)."""
    rows = None
    for section_no, (key, label) in enumerate(NPM_SECTIONS):
        section = _section_entries(F.col("doc")[key], section_no, label)
        rows = section if rows is None else F.concat(rows, section)
    return parsed.where("ok").select("project_id", F.explode(rows).alias("e")).select("project_id", "e.*")


def _section_entries(declared: Column, section_no: int, label: str) -> Column:
    entry = lambda e, pos: F.struct(
        F.struct(F.lit(section_no).alias("section_no"), pos.alias("pos")).alias("ord"),
        F.lit(label).alias("section"),
        e["key"].alias("package"),
        F.coalesce(e["value"], F.lit("None")).alias("spec"),
    )
    return F.transform(F.map_entries(F.coalesce(declared, F.create_map().cast("map<string,string>"))), entry)


def with_declared_version(deps: DataFrame) -> DataFrame:
    """Installed version, pinned flag and link of each declared dependency."""
    return (
        deps.withColumn("_r", clean_range(F.col("spec")))
        .select(
            "*",
            F.col("_r.base").alias("installed"),
            F.col("_r.pinned").alias("pinned"),
            npm_link(F.col("package")).alias("npm_url"),
        )
        .drop("_r")
    )


def gradle_texts(manifests: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Gradle manifests. The whole text is read unless the caller sets a limit, which is then noted."""
    if max_chars is None:
        return manifests.withColumn("truncated", F.lit(False))
    return manifests.withColumn("truncated", F.length("content") > max_chars).withColumn(
        "content", F.left("content", F.lit(max_chars))
    )
