"""Stored audits (F-12, F-13, O-10, T-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LISTED = ("id", "filename", "sha256", "app_name", "app_version", "created_at", "summary", "verdict")


def decoded(text: Column, ddl: str, default: Column) -> Column:
    """S-48: JSON text, or the default when it is missing or broken."""
    return F.coalesce(F.from_json(text, ddl), default)


def listing(audits: DataFrame) -> DataFrame:
    """F-12 and O-10: newest first, without the large columns; a broken summary is an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return (
        audits.select(*LISTED)
        .withColumn("summary", decoded(F.col("summary"), "map<string,string>", empty))
        .orderBy(F.desc("id"))
    )


def one(audits: DataFrame, audit_id) -> DataFrame:
    """F-13: empty when there is no such audit."""
    return audits.where(F.col("id") == audit_id)


def latest_verdicts(audits: DataFrame) -> DataFrame:
    """T-04 as a batch: the latest verdict per application."""
    return audits.groupBy("app_name").agg(
        F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"), F.count("*").alias("audits")
    )


def file_stem(app_name: Column) -> Column:
    """S-47: letters and digits of any script, with a default."""
    name = F.when(F.col("app_name") != "", app_name).otherwise("proyecto")
    return F.regexp_replace(name, r"[^\p{L}\p{N}]", "_")


def stamp(now: Column) -> Column:
    """S-34: report time."""
    return F.date_format(now, "yyyy-MM-dd HH:mm")
