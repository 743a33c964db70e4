"""Stored tables and flat exports (SNK-01, SNK-02, SNK-06..SNK-10, S-33, S-46, W-13).

Plain Parquet has no MERGE. A mutation reads the table, combines it and writes a new path (``swap_in``); the caller
then points readers at it, so a path is never overwritten while it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.advisories import displayed
from ..operators.catalog import decode_flag
from ..plans.skew import lookup_join

# Inventory kinds, their category, key prefix, and which columns an existing row takes from a new one.
KINDS = {
    "maven": ("Android / Gradle (Maven)", ""),
    "npm": ("Node / npm (paquete)", ""),
    "platform": ("Android / Plataforma", "android:"),
    "plugin": ("Android / Gradle (plugins)", "gradle-plugin:"),
}
UPDATED_COLUMNS = {
    "maven": ("latest", "status", "vuln_status", "vuln_count", "vuln_ids", "vuln_details", "updated_at"),
    "npm": ("latest", "status", "vuln_status", "vuln_count", "vuln_ids", "vuln_details", "updated_at"),
    "platform": ("latest", "status", "updated_at"),
    "plugin": ("status", "updated_at"),
}


def inventory_key(kind: str, package: Column) -> Column:
    return F.concat(F.lit(KINDS[kind][1]), package)


def inventory_rows(entries: DataFrame, kind: str, now: str) -> DataFrame:
    """Audited entries as inventory cycles, one row per key: the one last in (project, place in the document), as after upserts."""
    key = F.coalesce("platform_kind", "package", F.lit("item")) if kind == "platform" else F.col("package")
    rows = entries if kind != "maven" else entries.where(F.col("package").contains(":"))
    rows = rows.where(F.coalesce(key, F.lit("")) != "")
    aged = kind in ("maven", "npm")
    status = (
        F.when(F.coalesce("gap", F.lit("")) != "", "desactualizada").otherwise("vigente")
        if aged
        else F.coalesce("platform_level", F.lit("ok"))
    )
    installed = F.coalesce(F.col("installed"), F.lit("—"))
    place = F.struct(*[c for c in ("project_id", "ord") if c in entries.columns])
    shaped = rows.select(
        inventory_key(kind, key).alias("slug"),
        installed.alias("cycle"),
        "latest",
        status.alias("status"),
        (F.col("vuln_status") if aged else F.lit(None).cast("string")).alias("vuln_status"),
        (F.col("vuln_count") if aged else F.lit(0).cast("bigint")).alias("vuln_count"),
        (F.col("vuln_ids") if aged else F.array().cast("array<string>")).alias("vuln_ids"),
        (F.coalesce(F.to_json(F.transform("vuln_details", lambda d: displayed(d))), F.lit("[]")) if aged else F.lit("[]")).alias("vuln_details"),
        F.lit(now).alias("updated_at"),
        place.alias("_place"),
    )
    return newest_row(shaped, ["slug", "cycle"], "_place").drop("_place")


def inventory_products(entries: DataFrame, kind: str, now: str) -> DataFrame:
    """Product rows behind ``inventory_rows``."""
    slug = inventory_key(kind, F.coalesce("platform_kind", "package") if kind == "platform" else F.col("package"))
    name = F.substring_index("package", ":", -1) if kind == "maven" else F.col("package")
    return entries.select(
        slug.alias("slug"), F.lit(KINDS[kind][0]).alias("category"), name.alias("display_name"), F.lit(now).alias("updated_at")
    ).distinct()


INVENTORY_KEY = ("slug", "cycle")


def bucketed(rows: DataFrame, path: str, n_buckets: int = 200, key: Sequence[str] = INVENTORY_KEY) -> DataFrame:
    """``rows`` as a bucketed table at a new ``path``: later joins on ``key`` read its buckets where they lie and never move them.

    The table has a name of its own in the session's catalogue. Choose ``n_buckets`` so that a bucket fits into a task; the new rows
    of a join are dealt to as many. The rows are dealt to the buckets before they are written, so a bucket is one file.
    """
    name = f"inventory_{uuid.uuid4().hex}"
    dealt = rows.repartition(n_buckets, *key)
    dealt.write.mode("errorifexists").option("path", path).bucketBy(n_buckets, *key).sortBy(*key).saveAsTable(name)
    return rows.sparkSession.table(name)


def upsert_cycles(old: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """SNK-07: insert new keys; on a known key change only the columns of this kind. ``new`` has one row per key.

    A full join on the key. If ``old`` is a ``bucketed`` table, only ``new`` is shuffled.
    """
    key = ["slug", "cycle"]
    right = new.select(*key, F.struct(*[c for c in new.columns if c not in key]).alias("_new"))
    left = old.select(*key, F.struct(*[c for c in old.columns if c not in key]).alias("_old"))
    joined = left.join(right, key, "full")
    changed = UPDATED_COLUMNS[kind]

    def value(name: str) -> Column:
        inserted = F.col("_new")[name] if name in new.columns else F.lit(None)
        if name in changed and name in new.columns:
            return F.when(F.col("_new").isNotNull(), inserted).otherwise(F.col("_old")[name])
        return F.when(F.col("_old").isNull(), inserted).otherwise(F.col("_old")[name])

    return joined.select(*key, *[value(c).alias(c) for c in old.columns if c not in key])


def newest_row(rows: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """W-13: the newest row per key, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), stamp).alias("_row"))
    return newest.select(*key, "_row.*")


def replace_cycles(old: DataFrame, slugs: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-08: all cycles of ``slugs`` give way to ``new``; a slug without new rows loses its cycles."""
    return old.join(slugs, "slug", "left_anti").unionByName(new)


def delete_audit(audits: DataFrame, audit_id) -> DataFrame:
    """SNK-09."""
    return audits.where(~F.col("id").eqNullSafe(F.lit(audit_id)))


def refresh_latest(cycles: DataFrame, newest: DataFrame, now: str) -> DataFrame:
    """SNK-10: newest version of known artefacts; slugs without a colon and unknown artefacts stay as they are."""
    right = newest.where(F.coalesce("latest", F.lit("")) != "").select(
        F.concat_ws(":", "group", "artifact").alias("slug"), F.col("latest").alias("_newest")
    )
    joined = lookup_join(cycles, right, ["slug"])
    return joined.withColumn("latest", F.coalesce("_newest", "latest")).withColumn(
        "updated_at", F.when(F.col("_newest").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))
    ).drop("_newest")


def content_hash(content: Column) -> Column:
    """S-33."""
    return F.sha2(content.cast("binary"), 256)


def audit_rows(manifests: DataFrame, summaries: DataFrame, overall: DataFrame, now: Column) -> DataFrame:
    """SNK-06: one history row per audited manifest."""
    summary = [c for c in summaries.columns if c != "project_id"]
    return (
        manifests.join(summaries.select("project_id", F.to_json(F.struct(*summary)).alias("summary")), "project_id")
        .join(overall.select("project_id", "verdict", "verdict_level"), "project_id")
        .select(
            "project_id",
            F.coalesce("filename", F.lit("package.json")).alias("filename"),
            content_hash(F.col("content")).alias("sha256"),
            "app_name",
            "app_version",
            now.alias("created_at"),
            "summary",
            "verdict",
            "verdict_level",
            F.col("content").alias("source"),
        )
    )


def catalog_csv(rows: DataFrame) -> DataFrame:
    """SNK-01: the eleven columns of the catalogue export."""
    support, eol, lts = (decode_flag(F.col(c)) for c in ("support", "eol", "lts"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return rows.select(
        F.col("category").alias("categoria"),
        F.col("name").alias("producto"),
        F.col("cycle").alias("ciclo"),
        text(F.col("latest")).alias("ultima_version"),
        text(F.col("release_date")).alias("release"),
        F.when(support == "true", "activo").when(support == "false", "terminado").otherwise(text(support)).alias("soporte"),
        F.when(eol == "true", "terminado").when(eol == "false", "activo").otherwise(text(eol)).alias("eol"),
        F.when(lts.isNotNull() & (lts != "false") & (lts != ""), "si").otherwise("no").alias("lts"),
        F.col("status").alias("estado"),
        text(F.col("vuln_count")).alias("cve_count"),
        F.array_join("vuln_ids", " ").alias("cve_ids"),
    )


def audit_csv(entries: DataFrame) -> DataFrame:
    """SNK-02: the eleven columns of the audit export."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return entries.select(
        "project_id",
        F.col("package").alias("paquete"),
        F.col("section").alias("seccion"),
        F.col("spec").alias("declarada"),
        text("installed").alias("instalada"),
        text("latest").alias("ultima_npm"),
        F.lit("").alias("ultima_release"),
        text("gap").alias("desfase"),
        F.coalesce(F.col("outdated").cast("string"), F.lit("null")).alias("outdated"),
        text("vuln_count").alias("cve_count"),
        F.coalesce(F.array_join("vuln_ids", " "), F.lit("")).alias("cve_ids"),
        text("note").alias("nota"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header."""
    rows.write.mode("errorifexists").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def swap_in(rows: DataFrame, new_path: str) -> DataFrame:
    """Write a mutated table to a path nobody reads yet and return it from there."""
    rows.write.mode("errorifexists").parquet(new_path)
    return rows.sparkSession.read.parquet(new_path)
