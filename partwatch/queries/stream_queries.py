"""Queries of history, reports, archives and the batch form of the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive, audit, history
from ..sinks import tables
from ..plans.skew import shared_folder
from ..streaming import streams
from .registry import placed, query, view

view(
    "v_audits",
    """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'package.json' ELSE 'f' || o_orderkey END AS filename, 'app é ' || o_custkey AS app_name, '1.' || (o_orderkey % 9) AS app_version,
  o_orderdate AS created_at, o_orderpriority AS verdict, o_orderkey % 7 = 0 AS broken, o_orderstatus AS status FROM orders""",
)


def audits(t):
    k = F.col("o_orderkey")
    summary = F.to_json(F.struct(F.col("o_orderstatus").alias("status")))
    return t.table("orders").select(
        k.alias("id"),
        F.when(k % 4 != 0, F.concat(F.lit("f"), k)).alias("filename"),
        tables.content_hash(F.concat(F.lit("content "), k)).alias("sha256"),
        F.concat(F.lit("app é "), "o_custkey").alias("app_name"),
        F.concat(F.lit("1."), k % 9).alias("app_version"),
        F.col("o_orderdate").alias("created_at"),
        F.when(k % 7 == 0, F.lit("{broken")).otherwise(summary).alias("summary"),
        F.col("o_orderpriority").alias("verdict"),
        F.concat(F.lit("content "), k).alias("source"),
    )


@query("src_10_stored_tables", "SELECT id, app_name, verdict FROM v_audits")
def src_10(t):
    return audits(t).select("id", "app_name", "verdict")


@query("f_12_history_list", "SELECT id, app_name, app_version, CASE WHEN broken THEN NULL ELSE status END AS status FROM v_audits")
def f_12(t):
    return history.listing(audits(t)).select("id", "app_name", "app_version", F.col("summary")["status"].alias("status"))


@query("o_10_newest_first", "SELECT id, verdict, row_number() OVER (ORDER BY id DESC) AS n FROM v_audits")
def o_10(t):
    return placed(history.listing(audits(t)).select("id", "verdict"), [], [F.desc("id")])


@query("f_13_one_audit", "SELECT id, app_name FROM v_audits WHERE id = 77")
def f_13(t):
    return history.one(audits(t), 77).select("id", "app_name")


@query("snk_09_delete_audit", "SELECT id, app_name FROM v_audits WHERE id <> 77")
def snk_09(t):
    return tables.delete_audit(audits(t), 77).select("id", "app_name")


@query("s_33_content_hash", "SELECT id, sha256('content ' || id) AS sha256 FROM v_audits")
def s_33(t):
    return audits(t).select("id", "sha256")


@query("s_34_report_time", "SELECT id, strftime(created_at, '%Y-%m-%d %H:%M') AS stamp FROM v_audits")
def s_34(t):
    return audits(t).select("id", history.stamp(F.col("created_at")).alias("stamp"))


@query("s_47_file_name", "SELECT id, replace(app_name, ' ', '_') AS stem FROM v_audits")
def s_47(t):
    return audits(t).select("id", history.file_stem(F.col("app_name")).alias("stem"))


@query("s_48_json_fallback", "SELECT id, CASE WHEN broken THEN 'none' ELSE status END AS status FROM v_audits")
def s_48(t):
    value = history.decoded(F.col("summary"), "struct<status:string>", F.struct(F.lit("none").alias("status")))
    return audits(t).select("id", F.coalesce(value["status"], F.lit("none")).alias("status"))


@query(
    "t_04_latest_verdict",
    "SELECT app_name, arg_max(verdict, (created_at, id)) AS verdict, count(*) AS audits FROM v_audits GROUP BY 1",
)
def t_04(t):
    return history.latest_verdicts(audits(t))


# ---- reports


@query(
    "snk_02_audit_csv",
    """
SELECT project_id, package AS paquete, section AS seccion, spec AS declarada, coalesce(installed, '') AS instalada, coalesce(latest, '') AS ultima_npm,
  '' AS ultima_release, coalesce(gap, '') AS desfase, coalesce(cast(outdated AS VARCHAR), 'null') AS outdated,
  coalesce(cast(vuln_count AS VARCHAR), '') AS cve_count, coalesce(replace(vuln_ids, ', ', ' '), '') AS cve_ids, coalesce(note, '') AS nota FROM v_entries""",
)
def snk_02(t):
    return tables.audit_csv(t.listed_entries)


@query(
    "snk_06_audit_rows",
    """
SELECT project_id, 'package.json' AS filename, CASE WHEN compliance_critico > 0 OR critico > 0 THEN 'crítico' WHEN compliance_alto > 0 OR alto > 0 THEN 'alto'
  WHEN medio > 0 THEN 'medio' WHEN bajo > 0 THEN 'bajo' ELSE 'ok' END AS verdict_level, sha256('m' || project_id) AS sha256 FROM v_overall""",
)
def snk_06(t):
    manifests = t.deps.select("project_id").distinct().select(
        "project_id",
        F.lit(None).cast("string").alias("filename"),
        F.concat(F.lit("m"), "project_id").alias("content"),
        F.lit("app").alias("app_name"),
        F.lit("1").alias("app_version"),
    )
    rows = tables.audit_rows(manifests, audit.npm_summary(t.entries), audit.risk_distribution(t.rated), F.current_timestamp())
    return rows.select("project_id", "filename", "verdict_level", "sha256")


# ---- archives

view(
    "v_archive",
    """
SELECT l_orderkey AS archive, l_linenumber AS entry, cast(l_extendedprice * 100 AS BIGINT) AS bytes,
  greatest(1, cast(l_extendedprice * 100 / (l_quantity * 10) AS BIGINT)) AS packed,
  CASE WHEN l_partkey % 50 = 0 THEN '../up' ELSE 'dir' END || '/' || l_partkey || '_' || l_suppkey AS path, l_suppkey % 40 = 0 AS is_link FROM lineitem""",
)


def entries(t):
    price = F.col("l_extendedprice") * 100
    return t.table("lineitem").select(
        F.col("l_orderkey").alias("archive"),
        F.col("l_linenumber").alias("entry"),
        F.round(price).cast("bigint").alias("bytes"),
        F.greatest(F.lit(1).cast("bigint"), F.rint(price / (F.col("l_quantity") * 10)).cast("bigint")).alias("packed"),
        F.concat(
            F.when(F.col("l_partkey") % 50 == 0, "../up").otherwise("dir"), F.lit("/"), "l_partkey", F.lit("_"), "l_suppkey"
        ).alias("path"),
        (F.col("l_suppkey") % 40 == 0).alias("is_link"),
    )


@query(
    "f_15_archive_guard",
    """
SELECT archive, sum(bytes) AS bytes, count(*) AS files, sum(bytes) > 20000000 AS too_big, count(*) > 5 AS too_many,
  bool_or(bytes / packed > 200 AND bytes > 1000000) AS bad_ratio, bool_or(is_link) AS has_link, bool_or(starts_with(path, '../')) AS escapes
FROM v_archive GROUP BY 1""",
)
def f_15(t):
    return archive.verdicts(entries(t), 20_000_000, 5)


@query(
    "w_12_first_breach",
    """
SELECT archive, entry, path, total_bytes, total_files FROM (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY entry, path) AS r FROM (
  SELECT *, sum(bytes) OVER w AS total_bytes, count(*) OVER w AS total_files FROM v_archive
  WINDOW w AS (PARTITION BY archive ORDER BY entry, path ROWS UNBOUNDED PRECEDING)) WHERE total_bytes > 20000000 OR total_files > 5) WHERE r = 1""",
)
def w_12(t):
    return archive.first_breach(entries(t), 20_000_000, 5)


# ---- streams, as batches


@query(
    "t_01_quota_breaches",
    """
SELECT date_trunc('minute', ts) AS minute, event_type, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def t_01(t):
    return streams.quota_breaches(t.table("events"), 1, ("event_type",))


view(
    "v_lookups",
    "SELECT DISTINCT event_type, ts FROM events",
)


@query(
    "t_02_fresh_lookups",
    """
SELECT event_type, ts FROM (WITH RECURSIVE later AS (
  SELECT event_type, ts, min(ts) OVER (PARTITION BY event_type ORDER BY ts
    RANGE BETWEEN INTERVAL 600 SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS then_ts FROM v_lookups),
made AS (SELECT event_type, min(ts) AS ts FROM v_lookups GROUP BY 1
  UNION ALL SELECT l.event_type, l.then_ts FROM made m JOIN later l ON l.event_type = m.event_type AND l.ts = m.ts WHERE l.then_ts IS NOT NULL)
SELECT * FROM made)""",
)
def t_02(t):
    return streams.fresh_lookups(t.table("events"), ("event_type",))


def arriving(rows, period, apply):
    """Rows that land in a folder in periods 0, 1 and 2; ``apply`` gets the stream over the folder, and a path for what it keeps, after each."""
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession, "arriving")
    for n in range(3):
        rows.where(period == n).write.mode("append").parquet(f"{folder}/in")
        apply(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)
    return folder


view(
    "v_arriving_cycles",
    """
SELECT 'p' || l_partkey AS slug, cast(l_suppkey % 3 AS VARCHAR) AS cycle, cast(l_quantity AS BIGINT) AS latest, l_returnflag AS status, l_linenumber AS vuln_count,
  strftime(l_shipdate, '%Y-%m-%d') || lpad(cast(l_orderkey AS VARCHAR), 12, '0') || l_linenumber AS updated_at,
  CASE WHEN year(l_shipdate) < 1994 THEN 0 WHEN year(l_shipdate) < 1996 THEN 1 ELSE 2 END AS period FROM lineitem""",
)


def arriving_cycles(t):
    year = F.year("l_shipdate")
    return t.table("lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("slug"), (F.col("l_suppkey") % 3).cast("string").alias("cycle"),
        F.col("l_quantity").cast("bigint").alias("latest"), F.col("l_returnflag").alias("status"), F.col("l_linenumber").cast("bigint").alias("vuln_count"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber").alias("updated_at"),
        F.when(year < 1994, 0).when(year < 1996, 1).otherwise(2).alias("period"),
    )


@query(
    "t_03_upsert",
    """
SELECT slug, cycle, arg_max(latest, updated_at) AS latest, arg_max(status, updated_at) AS status, arg_min(vuln_count, period) AS vuln_count, max(updated_at) AS updated_at
FROM (SELECT slug, cycle, period, arg_max(latest, updated_at) AS latest, arg_max(status, updated_at) AS status, arg_max(vuln_count, updated_at) AS vuln_count,
  max(updated_at) AS updated_at FROM v_arriving_cycles GROUP BY ALL) GROUP BY ALL""",
)
def t_03(t):
    """Three batches upserted by the stream; a known cycle keeps its first number of vulnerabilities."""

    def apply(stream, folder):
        streams.upsert_stream(stream.drop("period"), "platform", f"{folder}/table", f"{folder}/state").awaitTermination()

    folder = arriving(arriving_cycles(t), F.col("period"), apply)
    return streams.read_inventory(t.spark, f"{folder}/table")


def follow_audits(stream, folder):
    streams.history_stream(stream, f"{folder}/history", f"{folder}/history-state").awaitTermination()
    streams.latest_verdict_stream(stream, f"{folder}/latest", f"{folder}/latest-state").awaitTermination()


@query(
    "t_04_latest_stream",
    "SELECT app_name, arg_max(verdict, (created_at, id)) AS verdict, count(*) AS audits FROM v_audits GROUP BY 1",
)
def t_04_stream(t):
    """Audits of three periods appended to the history by one stream; another keeps the latest verdicts."""
    year = F.year("created_at")
    folder = arriving(audits(t), F.when(year < 1994, 0).when(year < 1996, 1).otherwise(2), follow_audits)
    return streams.read_verdicts(t.spark, f"{folder}/latest")
