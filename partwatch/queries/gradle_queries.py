"""Queries over Gradle manifests: one manifest per order, filled from the order."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import dims
from ..functions import platform
from ..operators import audit, gradle
from ..sinks import tables
from .catalog_queries import values
from .catalog_queries import upsert_sql, upserted
from .registry import query, view

# {k} is the order, {p} one to five, {s} a platform number.
CONTENT = """rootProject.name = "app{k}"
/* implementation("gone:gone:1.0") */
// implementation("gone2:gone2:1.0")
val okhttp = "4.{p}.0"
def room = '2.5.{p}'
val notVersion = "abc"
plugins {
  id("com.android.application") version "8.{p}.0"
  kotlin("jvm") version "1.9.{p}"
  alias(libs.plugins.hilt)
  alias(libs.plugins.known.one)
  id("com.android.application") version "8.{p}.1"
}
android { compileSdk = {s}
  minSdk 2{p}
  targetSdkVersion {s} }
dependencies {
  implementation("com.squareup.okhttp3:okhttp:$okhttp")
  implementation 'androidx.core:core-ktx:1.{p}.1'
  implementation("com.squareup.okhttp3:okhttp:9.9.9")
  api(group = "io.named", name = "lib{p}", version = "3.{p}")
  kapt("androidx.room:compiler:${room}")
  implementation("x.y:missing:$nothing")
  implementation("bom.only:artifact")
  implementation(libs.core.ktx)
  implementation(libs.by.ref)
  ksp(libs.absent.one)
                                                                                                                              
  testImplementation("junit:junit:4.{p}")
                                                                                                                              
                                                                                                                              
}
buildscript { classpath("com.tools:tool:7.{p}") }
"""
TOML = """[versions]
agp = "8.{p}.9"
refver = "6.{p}.0"
[libraries]
core-ktx = { module = "androidx.core:core-ktx", version = "1.0" }
by_ref = { group = "io.ref", name = "ref-lib", version.ref = "refver" }
short = "s.h:ort:1.0"
[plugins]
hilt = { id = "com.hilt", version.ref = "refver" }
known-one = { id = "com.known", version = "2.{p}" }
# comment
[bundles]
x = ["a"]
"""
WRAPPER = "distributionUrl=https\\\\://services.gradle.org/distributions/gradle-8.{p}-bin.zip\n"


def manifests(t):
    """Every third manifest comes without its catalogue, every second without wrapper properties."""
    k = F.col("o_orderkey")
    level = (20 + k % 20).cast("string")
    marks = {"{k}": k.cast("string"), "{p}": (1 + k % 5).cast("string"), "{s}": level}

    def fill(text):
        return F.concat(*[marks[part] if part in marks else F.lit(part) for part in re.split(r"(\{[kps]\})", text) if part])

    # Keys are spread before the texts are built from them: parsing is heavy, the keys are light.
    return t.table("orders").select("o_orderkey").repartition(t.spark.sparkContext.defaultParallelism, "o_orderkey").select(
        k.alias("project_id"),
        fill(CONTENT).alias("content"),
        F.when(k % 3 != 0, fill(TOML)).alias("toml"),
        F.when(k % 2 == 0, fill(WRAPPER)).alias("extra"),
    )


view("v_m", "SELECT o_orderkey AS k, 1 + o_orderkey % 5 AS p, 20 + o_orderkey % 20 AS s, o_orderkey % 3 <> 0 AS cat, o_orderkey % 2 = 0 AS wrap FROM orders")
view(
    "v_coordinates",
    """
SELECT k AS project_id, 'com.squareup.okhttp3:okhttp' AS package, '4.' || p || '.0' AS version, 'producción' AS section FROM v_m
UNION ALL SELECT k, 'androidx.core:core-ktx', '1.' || p || '.1', 'producción' FROM v_m
UNION ALL SELECT k, 'io.named:lib' || p, '3.' || p, 'producción' FROM v_m
UNION ALL SELECT k, 'androidx.room:compiler', '2.5.' || p, 'producción' FROM v_m
UNION ALL SELECT k, 'x.y:missing', NULL, 'producción' FROM v_m
UNION ALL SELECT k, 'bom.only:artifact', NULL, 'producción' FROM v_m
UNION ALL SELECT k, 'io.ref:ref-lib', '6.' || p || '.0', 'producción' FROM v_m WHERE cat
UNION ALL SELECT k, 'libs.absent.one', NULL, 'producción' FROM v_m WHERE cat
UNION ALL SELECT k, 'junit:junit', '4.' || p, 'test' FROM v_m
UNION ALL SELECT k, 'com.tools:tool', '7.' || p, 'build' FROM v_m""",
)
view(
    "v_plugins",
    """
SELECT k AS project_id, 'com.android.application' AS plugin_id, '8.' || p || '.1' AS version FROM v_m
UNION ALL SELECT k, 'org.jetbrains.kotlin.jvm', '1.9.' || p FROM v_m
UNION ALL SELECT k, CASE WHEN cat THEN 'com.hilt' ELSE 'libs.plugins.hilt' END, CASE WHEN cat THEN '6.' || p || '.0' END FROM v_m
UNION ALL SELECT k, CASE WHEN cat THEN 'com.known' ELSE 'libs.plugins.known.one' END, CASE WHEN cat THEN '2.' || p END FROM v_m""",
)
API = values((level, *facts) for level, facts in dims.ANDROID_API.items())
view("v_api", f"SELECT * FROM ({API}) t(api, version, codename, year, state)")
view(
    "v_sdk",
    """
SELECT k AS project_id, 'compileSdk' AS platform_kind, cast(s AS VARCHAR) AS installed, CASE WHEN s >= 36 THEN 'ok' WHEN s >= 35 THEN 'bajo' ELSE 'medio' END AS platform_level FROM v_m
UNION ALL SELECT k, 'targetSdk', cast(s AS VARCHAR), CASE WHEN s >= 36 THEN 'ok' WHEN s >= 35 THEN 'bajo' ELSE 'alto' END FROM v_m
UNION ALL SELECT k, 'minSdk', '2' || p, CASE WHEN p <= 3 THEN 'bajo' ELSE 'ok' END FROM v_m""",
)
view(
    "v_tools",
    """
SELECT k AS project_id, 'AGP' AS platform_kind, '8.' || p || '.0' AS installed, 'medio' AS platform_level FROM v_m
UNION ALL SELECT k, 'Gradle', '8.' || p, 'bajo' FROM v_m WHERE wrap""",
)


@query("src_02_gradle_text", "SELECT k AS project_id, false AS truncated FROM v_m")
def src_02(t):
    from ..sources.manifests import gradle_texts

    return gradle_texts(manifests(t)).select("project_id", "truncated")


@query(
    "src_03_version_catalogue",
    """
SELECT k AS project_id, 'agp' AS name, '8.' || p || '.9' AS value FROM v_m WHERE cat UNION ALL SELECT k, 'refver', '6.' || p || '.0' FROM v_m WHERE cat""",
)
def src_03(t):
    rows = manifests(t).select("project_id", F.explode(gradle.toml_versions(F.col("toml"))).alias("v"))
    return rows.select("project_id", "v.name", "v.value")


@query("w_05_toml_section", "SELECT k AS project_id, 3 AS libraries, 3 AS plugins FROM v_m WHERE cat")
def w_05(t):
    n = lambda name: F.size(gradle.toml_section(F.col("toml"), name)).alias(name)
    return manifests(t).where(F.col("toml").isNotNull()).select("project_id", n("libraries"), n("plugins"))


@query(
    "s_38_comment_free",
    "SELECT k AS project_id, false AS commented FROM v_m",
)
def s_38(t):
    return manifests(t).select("project_id", gradle.strip_comments(F.col("content")).contains("gone").alias("commented"))


@query("s_50_project_name", "SELECT k AS project_id, 'app' || k AS name FROM v_m")
def s_50(t):
    return manifests(t).select("project_id", gradle.project_name(F.col("content")).alias("name"))


@query(
    "s_43_version_variables",
    """
SELECT k AS project_id, 'okhttp' AS name, '4.' || p || '.0' AS value FROM v_m UNION ALL SELECT k, 'room', '2.5.' || p FROM v_m
UNION ALL SELECT k, 'agp', '8.' || p || '.9' FROM v_m WHERE cat UNION ALL SELECT k, 'refver', '6.' || p || '.0' FROM v_m WHERE cat
UNION ALL SELECT k, 'libs.versions.agp', '8.' || p || '.9' FROM v_m WHERE cat UNION ALL SELECT k, 'libs.versions.refver', '6.' || p || '.0' FROM v_m WHERE cat
UNION ALL SELECT k, 'version', '3.' || p FROM v_m""",
)
def s_43(t):
    variables = gradle.version_variables(gradle.strip_comments(F.col("content")), F.col("toml"))
    rows = manifests(t).select("project_id", F.explode(variables).alias("v"))
    return rows.select("project_id", "v.name", "v.value")


@query("s_39_coordinates", "SELECT project_id, package, version FROM v_coordinates")
def s_39(t):
    return gradle.dependencies(manifests(t)).select("project_id", "package", "version")


@query("s_40_section_guess", "SELECT project_id, package, section FROM v_coordinates")
def s_40(t):
    return gradle.dependencies(manifests(t)).select("project_id", "package", "section")


@query("w_07_first_declaration", "SELECT project_id, count(*) AS coordinates, count(version) AS versioned FROM v_coordinates GROUP BY 1")
def w_07(t):
    return (
        gradle.dependencies(manifests(t))
        .groupBy("project_id")
        .agg(F.count("*").alias("coordinates"), F.count("version").alias("versioned"))
    )


@query("u_02_branches", "SELECT package, count(*) AS projects FROM v_coordinates GROUP BY 1")
def u_02(t):
    return gradle.dependencies(manifests(t)).groupBy("package").agg(F.count("*").alias("projects"))


@query(
    "j_09_resolved_variables",
    "SELECT project_id, package, version FROM v_coordinates WHERE package IN ('com.squareup.okhttp3:okhttp', 'androidx.room:compiler', 'x.y:missing')",
)
def j_09(t):
    return (
        gradle.dependencies(manifests(t))
        .where(F.col("package").isin("com.squareup.okhttp3:okhttp", "androidx.room:compiler", "x.y:missing"))
        .select("project_id", "package", "version")
    )


@query(
    "j_10_alias_library",
    "SELECT project_id, package FROM v_coordinates WHERE package IN ('io.ref:ref-lib', 'libs.absent.one')",
)
def j_10(t):
    return (
        gradle.dependencies(manifests(t)).where(F.col("package").isin("io.ref:ref-lib", "libs.absent.one")).select("project_id", "package")
    )


@query(
    "j_11_library_version",
    """
SELECT k AS project_id, 'core.ktx' AS alias, '1.0' AS version FROM v_m WHERE cat UNION ALL SELECT k, 'by.ref', '6.' || p || '.0' FROM v_m WHERE cat
UNION ALL SELECT k, 'short', NULL FROM v_m WHERE cat""",
)
def j_11(t):
    variables = gradle.version_variables(gradle.strip_comments(F.col("content")), F.col("toml"))
    read = manifests(t).select("project_id", "toml", variables.alias("_variables"))
    rows = read.select("project_id", F.explode(gradle.library_table(F.col("toml"), F.col("_variables"))).alias("e"))
    return rows.select("project_id", "e.alias", "e.version")


@query("j_12_plugin_version", "SELECT project_id, plugin_id, version FROM v_plugins")
def j_12(t):
    return gradle.plugins(manifests(t))


@query(
    "s_42_plugin_entries",
    """
SELECT project_id, plugin_id AS package, coalesce(version, '(sin versión)') AS spec,
  CASE WHEN starts_with(plugin_id, 'libs.') THEN 'desconocido' ELSE 'ok' END AS platform_level,
  CASE WHEN version IS NULL THEN 'https://plugins.gradle.org/' ELSE 'https://plugins.gradle.org/plugin/' || plugin_id END AS npm_url FROM v_plugins""",
)
def s_42(t):
    return gradle.plugin_entries(gradle.plugins(manifests(t))).select("project_id", "package", "spec", "platform_level", "npm_url")


@query(
    "j_25_no_version_last",
    "SELECT project_id, package FROM v_coordinates WHERE package = 'bom.only:artifact'",
)
def j_25(t):
    deps = gradle.dependencies(manifests(t))
    return deps.where(F.col("version").isNull() & ~F.col("interpolated")).select("project_id", "package")


@query("s_41_platform_versions", "SELECT project_id, platform_kind, installed FROM v_sdk UNION ALL SELECT project_id, platform_kind, installed FROM v_tools")
def s_41(t):
    return gradle.platform_entries(manifests(t)).select("project_id", "platform_kind", "installed")


@query("s_16_sdk_assessment", "SELECT project_id, platform_kind, platform_level FROM v_sdk")
def s_16(t):
    rows = gradle.platform_entries(manifests(t)).where(F.col("platform_kind").isin(*gradle.SDK_KINDS))
    return rows.select("project_id", "platform_kind", "platform_level")


@query("s_17_tool_assessment", "SELECT project_id, platform_kind, platform_level FROM v_tools")
def s_17(t):
    rows = gradle.platform_entries(manifests(t)).where(F.col("platform_kind").isin("AGP", "Gradle"))
    return rows.select("project_id", "platform_kind", "platform_level")


@query(
    "j_08_api_facts",
    """
SELECT project_id, platform_kind, CASE WHEN version IS NULL THEN 'API level no reconocido.'
  ELSE concat('Android ', version, ' (', codename, ') — estado: ', state, '.') END AS eol_info
FROM v_sdk LEFT JOIN v_api ON api = cast(installed AS INT)""",
)
def j_08(t):
    rows = gradle.platform_entries(manifests(t)).where(F.col("platform_kind").isin(*gradle.SDK_KINDS))
    return rows.select("project_id", "platform_kind", "eol_info")


def newest(t):
    k = F.col("p_partkey")
    names = F.array(*[F.lit(n) for n in ("com.squareup.okhttp3:okhttp", "androidx.core:core-ktx", "androidx.room:compiler", "junit:junit")])
    rows = t.table("part").groupBy(F.get(names, (k % 4).cast("int")).alias("c")).agg(F.max("p_size").alias("m"))
    parts = F.split("c", ":")
    return rows.select(
        parts[0].alias("group"),
        parts[1].alias("artifact"),
        F.concat(F.lit("4.2."), F.col("m")).alias("latest"),
        F.lit("Maven Central").alias("latest_origin"),
        F.lit(None).cast("string").alias("lookup_error"),
    )


def maven_by_version(t):
    """One advisory per published okhttp version, so some manifests are vulnerable."""
    affected = t.advisories.select(
        F.lit("Maven").alias("ecosystem"),
        F.lit("com.squareup.okhttp3:okhttp").alias("package"),
        F.concat(F.lit("4."), 1 + F.substring_index("osv_id", "-", -1).cast("bigint") % 3, F.lit(".0")).alias("version"),
        "osv_id",
    )
    return audit.advisories_by_version(affected, t.details)


def entries(t):
    return gradle.audit_gradle(manifests(t), newest(t), maven_by_version(t))


view(
    "v_newest_artifact",
    """
SELECT (['com.squareup.okhttp3:okhttp', 'androidx.core:core-ktx', 'androidx.room:compiler', 'junit:junit'])[p_partkey % 4 + 1] AS package,
  4 AS a, 2 AS b, max(p_size) AS c FROM part GROUP BY 1""",
)
# Advisories per okhttp version; a version is malicious when one of them says so.
view(
    "v_okhttp",
    """
SELECT 'com.squareup.okhttp3:okhttp' AS package, '4.' || (1 + event_id % 3) || '.0' AS version, count(*) AS n,
  bool_or(event_id % 11 <> 0 AND contains(summary, 'malware')) AS bad
FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 3 ORDER BY osv_id) AS pos FROM v_advisories) GROUP BY 1, 2""",
)
view(
    "v_gradle_deps",
    """
SELECT d.*, n.package IS NOT NULL AS found, coalesce(o.n, 0) AS n, coalesce(o.bad, false) AS bad,
  CASE WHEN v[1] < a THEN 'major' WHEN v[1] = a AND v[2] < b THEN 'minor' WHEN v[1] = a AND v[2] = b AND v[3] < c THEN 'patch' END AS gap
FROM (SELECT *, list_transform(range(1, 4), lambda i: coalesce(try_cast(string_split(version, '.')[i] AS INT), 0)) AS v FROM v_coordinates) d
LEFT JOIN v_newest_artifact n USING (package) LEFT JOIN v_okhttp o ON o.package = d.package AND o.version = d.version""",
)


@query(
    "u_04_gradle_entries",
    """
SELECT project_id, section, count(*) AS entries FROM (SELECT project_id, section FROM v_coordinates UNION ALL SELECT project_id, 'plugin' FROM v_plugins
  UNION ALL SELECT project_id, 'plataforma' FROM v_sdk UNION ALL SELECT project_id, 'plataforma' FROM v_tools) GROUP BY 1, 2""",
)
def u_04(t):
    return entries(t).groupBy("project_id", "section").agg(F.count("*").alias("entries"))


@query(
    "f_09_sections",
    """
SELECT 'platform' AS kind, (SELECT count(*) FROM v_sdk) + (SELECT count(*) FROM v_tools) AS entries UNION ALL SELECT 'plugin', count(*) FROM v_plugins
UNION ALL SELECT 'dependency', count(*) FROM v_coordinates""",
)
def f_09(t):
    return entries(t).groupBy(gradle.section_kind(F.col("section")).alias("kind")).agg(F.count("*").alias("entries"))


@query(
    "a_02_gradle_summary",
    """
SELECT d.*, 3 + CASE WHEN wrap THEN 2 ELSE 1 END AS platform_items,
  (SELECT count(*) FROM v_sdk s WHERE s.project_id = d.project_id AND platform_level IN ('alto', 'medio')) + 1 AS platform_alerts, 4 AS plugin_items
FROM (SELECT project_id, count(*) AS total, count(gap) AS outdated, count_if(gap = 'major') AS major_behind, count_if(n > 0) AS vulnerable, 0 AS neterror,
  count_if(NOT found OR package IN ('x.y:missing', 'libs.absent.one')) AS unresolved, count_if(bad) AS compliance_flags, count_if(bad) AS compliance_critico, 0 AS compliance_alto
  FROM v_gradle_deps GROUP BY 1) d JOIN v_m ON k = d.project_id""",
)
def a_02(t):
    return audit.gradle_summary(entries(t))


@query(
    "snk_07_upsert_plugin",
    upsert_sql(
        """SELECT DISTINCT 'gradle-plugin:' || plugin_id AS slug, coalesce(version, '—') AS cycle, NULL::VARCHAR AS latest,
  CASE WHEN starts_with(plugin_id, 'libs.') THEN 'desconocido' ELSE 'ok' END AS status FROM v_plugins""",
        "plugin",
    ),
)
def snk_07_plugin(t):
    entries = audit.with_entry_fields(gradle.plugin_entries(gradle.plugins(manifests(t))))
    return upserted(tables.inventory_rows(entries, "plugin", "2024-06-01"), "plugin")


@query(
    "snk_07_upsert_platform",
    upsert_sql(
        """SELECT DISTINCT 'android:' || platform_kind AS slug, installed AS cycle, NULL::VARCHAR AS latest, platform_level AS status FROM v_sdk
  UNION SELECT DISTINCT 'android:' || platform_kind, installed, NULL, platform_level FROM v_tools""",
        "platform",
    ),
)
def snk_07_platform(t):
    entries = audit.with_entry_fields(gradle.platform_entries(manifests(t)))
    return upserted(tables.inventory_rows(entries, "platform", "2024-06-01").withColumn("latest", F.lit(None).cast("string")), "platform")


@query(
    "a_28_component_counts",
    """
SELECT project_id, 'manifest' AS of, section AS kind, 'build.gradle' AS path, count(*) AS components FROM v_coordinates GROUP BY ALL
UNION ALL SELECT project_id, 'type', section, '', count(*) FROM v_coordinates GROUP BY ALL
UNION ALL SELECT project_id, 'total', '', '', count(*) FROM v_coordinates GROUP BY ALL""",
)
def a_28(t):
    deps = gradle.dependencies(manifests(t)).select("project_id", F.col("section").alias("kind"), F.lit("build.gradle").alias("path"))
    return gradle.component_counts(deps)


view(
    "v_components",
    """
SELECT cast(project_id AS VARCHAR) AS project_id, 'gradle' AS kind, 'app/build.gradle' AS path FROM v_coordinates
UNION ALL SELECT cast(project_id AS VARCHAR), 'npm', CASE section WHEN 'peer' THEN 'lib/package.json' WHEN 'desarrollo' THEN 'tools/package.json' ELSE 'package.json' END FROM v_deps""",
)


@query(
    "a_28_all_manifests",
    """
SELECT project_id, 'manifest' AS of, kind, path, count(*) AS components FROM v_components GROUP BY ALL
UNION ALL SELECT project_id, 'type', kind, '', count(*) FROM v_components GROUP BY ALL
UNION ALL SELECT project_id, 'total', '', '', count(*) FROM v_components GROUP BY ALL""",
)
def a_28_all(t):
    """Components of npm and Gradle together, several manifests a project."""
    name = F.col("project_id").cast("string").alias("project_id")
    build = gradle.dependencies(manifests(t)).select(name, F.lit("gradle").alias("kind"), F.lit("app/build.gradle").alias("path"))
    path = F.when(F.col("section") == "peer", "lib/package.json").when(F.col("section") == "desarrollo", "tools/package.json").otherwise("package.json")
    return gradle.component_counts(build.unionByName(t.deps.select(name, F.lit("npm").alias("kind"), path.alias("path"))))

