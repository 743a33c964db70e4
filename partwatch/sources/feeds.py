"""Landed registry and life-cycle documents (SRC-04..SRC-08). Each function takes raw bodies, one per row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.advisories import shape
from ..functions.versions import repository_url

# The parts of each document that are read.
LIFECYCLE = "cycle string, latest string, releaseDate string, support string, eol string, lts string"
REGISTRY = "versions map<string,string>, time map<string,string>, `dist-tags` map<string,string>"
NEWEST = "version string, repository string, homepage string, description string"
ADVISORY = (
    "id string, aliases array<string>, severity array<struct<type:string,score:string>>, "
    "references array<struct<type:string,url:string>>, summary string, details string, published string, "
    "modified string"
)
MAVEN_METADATA = "versioning struct<latest:string,release:string,versions:struct<version:array<string>>>"


def lifecycle_cycles(feeds: DataFrame) -> DataFrame:
    """``feeds(slug, body)`` with a JSON list of cycles; elements that are no objects are skipped.

    Bool-or-date fields stay text: true, false or the date.
    """
    elements = feeds.select("slug", F.explode(F.from_json("body", "array<string>")).alias("element"))
    return (
        elements.where(F.col("element").rlike(r"^\s*\{"))
        .select("slug", F.from_json("element", LIFECYCLE).alias("c"))
        .select(
            "slug",
            F.coalesce("c.cycle", F.lit("None")).alias("cycle"),
            F.col("c.latest").alias("latest"),
            F.coalesce("c.latest", "c.cycle").alias("lookup_version"),
            F.col("c.releaseDate").alias("release_date"),
            F.col("c.support").alias("support"),
            F.col("c.eol").alias("eol"),
            F.col("c.lts").alias("lts"),
        )
    )


def registry_versions(documents: DataFrame) -> DataFrame:
    """``documents(package, body)`` to one row per published version, with its place in the document."""
    doc = documents.select("package", F.from_json("body", REGISTRY).alias("d"))
    return doc.select(
        "package",
        F.col("d.dist-tags")["latest"].alias("latest_tag"),
        F.col("d.time").alias("_time"),
        F.posexplode(F.map_keys("d.versions")).alias("ord", "version"),
    ).select("package", "latest_tag", "ord", "version", F.try_element_at("_time", F.col("version")).alias("released"))


def newest_documents(documents: DataFrame) -> DataFrame:
    """``documents(package, http_status, body)``; a missing page is not-found, any other failure neterror."""
    d = F.from_json("body", NEWEST)
    repository = F.coalesce(F.get_json_object(F.col("d.repository"), "$.url"), F.col("d.repository"))
    found = (F.col("http_status") == 200) & F.col("body").rlike(r"^\s*\{")
    return (
        documents.withColumn("d", d)
        .select(
            "package",
            F.when(F.col("http_status") == 404, "not-found").when(found, "found").otherwise("neterror").alias("lookup"),
            F.when(found, F.col("d.version")).alias("latest"),
            F.when(found, F.col("d.homepage")).alias("homepage"),
            F.when(found, repository_url(repository)).alias("repository"),
            F.when(found, F.coalesce(F.col("d.description"), F.lit(""))).alias("description"),
        )
    )


def maven_documents(documents: DataFrame) -> DataFrame:
    """``documents(group, artifact, http_status, body)`` with Maven metadata XML."""
    m = F.from_xml(F.col("body"), MAVEN_METADATA, {"rowTag": "metadata"})
    return documents.withColumn("m", m).select(
        "group",
        "artifact",
        "http_status",
        F.col("m.versioning.latest").alias("latest"),
        F.col("m.versioning.release").alias("release"),
        F.col("m.versioning.versions.version").alias("versions"),
    )


def advisory_details(documents: DataFrame) -> DataFrame:
    """``documents(body)`` to the shaped detail of each advisory."""
    v = documents.select(F.from_json("body", ADVISORY).alias("v"))
    part = lambda name: F.col("v")[name]
    detail = shape(
        part("id"),
        part("aliases"),
        part("severity"),
        part("references"),
        part("summary"),
        part("details"),
        part("published"),
        part("modified"),
    )
    return v.select(part("id").alias("osv_id"), detail.alias("detail"))
