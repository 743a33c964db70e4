"""Inputs of the registered queries, derived by Spark from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.advisories import shape
from ..operators import audit, scan
from ..operators.catalog import cycle_status, encode_flag, newest_stable_version
from ..rules import RULES, rule_texts
from ..sources.manifests import with_declared_version


# Text put around each document so that it reads as a source file. Variant by doc_id % 5.
SOURCE_LINES = {
    0: ('request.getParameter("q")', "db.rawQuery(sql, null);"),
    1: ("getIntent().getData()", "int size = 1;"),
    2: ('"fixed"', "db.rawQuery(sql, null);"),
    3: ("input()", "sql = clean(other);"),
    4: ('request.getParameter("q")', "user = readLine();"),
}
HEAD = """class Screen{id} {
// api_key = "abcdefghijklmnop"
  String user = %s;
  String sql = "SELECT * FROM t WHERE u=" + user;
  %s
  Runtime.getRuntime().exec(user);
  api_key = "tok{id}aaaaaaaaaaaaaaaa"
  see http://example{id}.org/ and http://localhost/ MD5
  uses android.permission.{perm}
  fun save{id}(x: Int) {
    password = "hunter{id}2"
    print("rut of user", sql)
    print("run", x)
  }
  oauth {impl}
"""
TAIL = """
  eval(user); token = "tail{id}bbbbbbbbbbbbbbbb"
  last = "see http://localhost/"
"""
ENGINES = ("semgrep", "detect-secrets", "bandit", "njsscan", "gitleaks", "trivy", "retire")


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def deps(self) -> DataFrame:
        """Dependencies declared by orders: one project per order."""
        q = (F.col("l_quantity").cast("int") % 5).cast("string")
        version = F.concat_ws(".", q, F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
        kind = F.col("l_linenumber") % 7
        spec = (
            F.when(kind == 1, F.concat(F.lit("^"), version))
            .when(kind == 2, F.concat(F.lit("~"), version))
            .when(kind == 3, F.concat(F.lit(">="), version))
            .when(kind == 4, version)
            .when(kind == 5, F.lit("*"))
            .when(kind == 6, F.concat(F.lit("git+https://x/"), version))
            .otherwise(F.concat(F.lit("workspace:"), version))
        )
        section = (
            F.when(F.col("l_returnflag") == "A", "producción")
            .when(F.col("l_returnflag") == "N", "desarrollo")
            .otherwise("peer")
        )
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("project_id"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
            section.alias("section"),
            F.concat(F.lit("pkg-"), "l_partkey").alias("package"),
            spec.alias("spec"),
        )

    @cached_property
    def declared(self) -> DataFrame:
        return with_declared_version(self.deps)

    @cached_property
    def registry(self) -> DataFrame:
        """Published versions per package."""
        q = (F.col("l_quantity").cast("int") % 5).cast("string")
        version = F.concat_ws(".", q, F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 10).cast("string"))
        pre = F.when(F.round(F.col("l_discount") * 100) == 10, "-beta.1").otherwise("")
        return (
            self.table("lineitem")
            .select(F.concat(F.lit("pkg-"), "l_partkey").alias("package"), F.concat(version, pre).alias("version"))
            .distinct()
        )

    @cached_property
    def newest(self) -> DataFrame:
        """Newest-version documents: one row per package."""
        key = F.col("p_partkey")
        lookup = F.when(key % 13 == 0, "not-found").when(key % 17 == 0, "neterror").otherwise("found")
        about = (
            F.when(key % 50 == 7, "valida rut chileno")
            .when(key % 70 == 9, "consulta rut y nombre")
            .otherwise(F.concat_ws(" ", "p_name", "p_type"))
        )
        docs = self.table("part").select(
            F.concat(F.lit("pkg-"), "p_partkey").alias("package"),
            lookup.alias("lookup"),
            F.concat(F.lit("https://home/"), key).alias("homepage"),
            F.concat(F.lit("git+https://x/"), key, F.lit(".git")).alias("repository"),
            about.alias("description"),
        )
        return docs.join(newest_stable_version(self.registry), "package", "left")

    @cached_property
    def advisories(self) -> DataFrame:
        """Advisories with the exact version they affect."""
        e = F.col("event_id")
        version = F.concat_ws(".", e % 5, 1 + e % 7, F.col("user_id") % 10)
        severity = (
            F.when(e % 4 == 0, F.floor(F.col("value") / 49).cast("int").cast("string"))
            .when(e % 4 == 1, "HIGH")
            .when(e % 4 == 2, "CVSS:3.1/AV:N/AC:L")
        )
        summary = F.when(e % 40 == 0, F.concat(F.lit("malware in pkg-"), e % 2000)).otherwise(
            F.concat(F.lit("issue "), e)
        )
        url = lambda i: F.struct(
            F.lit("WEB").alias("type"),
            F.when(F.lit(i) != 2, F.concat(F.lit("https://ref/"), e, F.lit(f"/{i}"))).otherwise("").alias("url"),
        )
        return (
            self.table("events")
            .where(F.col("event_type") == "error")
            .select(
                F.concat(F.lit("OSV-"), e).alias("osv_id"),
                F.lit("npm").alias("ecosystem"),
                F.concat(F.lit("pkg-"), e % 2000).alias("package"),
                version.alias("version"),
                F.when(e % 2 == 0, F.array(F.concat(F.lit("GHSA-"), e), F.concat(F.lit("CVE-2024-"), e))).alias(
                    "aliases"
                ),
                F.when(severity.isNotNull(), F.array(F.struct(F.lit("CVSS_V3").alias("type"), severity.alias("score"))))
                .alias("severities"),
                F.array(*[url(i) for i in range(1, 8)]).alias("references"),
                summary.alias("summary"),
                F.concat(F.lit("details of "), e).alias("details"),
                F.date_format("ts", "yyyy-MM-dd").alias("published"),
            )
        )

    @cached_property
    def details(self) -> DataFrame:
        """Advisory details by id. Every eleventh one has another id, so the stub is exercised."""
        c = F.col
        number = F.substring_index("osv_id", "-", -1)
        renamed = F.when(number.cast("bigint") % 11 == 0, F.concat(F.lit("GONE-"), number)).otherwise(c("osv_id"))
        return self.advisories.withColumn("osv_id", renamed).select(
            "osv_id",
            shape(
                c("osv_id"),
                c("aliases"),
                c("severities"),
                c("references"),
                c("summary"),
                c("details"),
                c("published"),
                F.lit(None).cast("string"),
            ).alias("detail"),
        )

    @cached_property
    def by_version(self) -> DataFrame:
        return audit.advisories_by_version(self.advisories, self.details)

    @cached_property
    def listed_by_version(self) -> DataFrame:
        """With the lists that reports show."""
        return audit.with_listed(self.by_version, self.advisories, self.details)

    @cached_property
    def failed_lookups(self) -> DataFrame:
        """Advisory lookups that failed: those of every thirty-first package."""
        named = self.declared.select("package", F.col("installed").alias("version")).where("installed IS NOT NULL").distinct()
        number = F.substring_index("package", "-", -1).cast("bigint")
        return named.where(number % 31 == 0).select(F.lit("npm").alias("ecosystem"), "package", "version")

    @cached_property
    def entries(self) -> DataFrame:
        return audit.audit_npm(self.declared, self.newest, self.by_version)

    @cached_property
    def listed_entries(self) -> DataFrame:
        return audit.audit_npm(self.declared, self.newest, self.listed_by_version)

    @cached_property
    def rated(self) -> DataFrame:
        return audit.with_risk(self.entries)

    @cached_property
    def listed(self) -> DataFrame:
        """Rated entries with the lists that reports show."""
        return audit.with_risk(self.listed_entries)

    # ---- catalogue

    today = "1998-06-01"

    @cached_property
    def products(self) -> DataFrame:
        """One product per part; every tenth has no display name."""
        key = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("pkg-"), key).alias("slug"),
            F.col("p_type").alias("category"),
            F.when(key % 10 == 0, "").otherwise(F.col("p_name")).alias("display_name"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int")).cast("string").alias("updated_at"),
        )

    @cached_property
    def raw_cycles(self) -> DataFrame:
        """Cycles with bool-or-date fields as text: one per part and line number."""
        day = lambda c: F.date_format(c, "yyyy-MM-dd")
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        grouped = (
            self.table("lineitem")
            .groupBy("l_partkey", "l_linenumber")
            .agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count("*").alias("n"))
        )
        eol = (
            F.when((part + line) % 4 == 0, "true")
            .when((part + line) % 4 == 1, "false")
            .when((part + line) % 4 == 2, day("first"))
        )
        support = F.when((part + 2 * line) % 3 == 0, "false").when((part + 2 * line) % 3 == 1, day("last"))
        return grouped.select(
            F.concat(F.lit("pkg-"), part).alias("slug"),
            line.cast("string").alias("cycle"),
            F.when(F.col("n") > 1, F.concat(line, F.lit(".0."), F.col("n"))).alias("latest"),
            day("first").alias("release_date"),
            support.alias("support"),
            eol.alias("eol"),
            F.when(line % 3 == 0, "true").otherwise("false").alias("lts"),
        )

    @cached_property
    def cycles(self) -> DataFrame:
        """Stored cycles: status, encoded flags and vulnerability columns."""
        part = F.substring_index("slug", "-", -1).cast("bigint")
        line = F.col("cycle").cast("int")
        status = cycle_status(F.col("eol"), F.col("support"), F.lit(self.today).cast("date"))
        kind = (part + line) % 5
        count = F.when(kind == 0, part % 4 + 1).when(kind == 1, F.lit(0))
        return self.raw_cycles.select(
            "slug",
            "cycle",
            "latest",
            "release_date",
            *[encode_flag(F.col(c)).alias(c) for c in ("support", "eol", "lts")],
            status.alias("status"),
            F.when(kind == 0, "vulnerable").when(kind == 1, "clean").when(kind == 2, "no-map").when(kind == 3, "neterror").alias("vuln_status"),
            count.alias("vuln_count"),
            F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(F.lit("CVE-"), part, F.lit("-"), i)))
            .otherwise(F.array().cast("array<string>")).alias("vuln_ids"),
        )

    def upstream_slugs(self, parts: DataFrame) -> DataFrame:
        """Slugs upstream knows: the declared ones whose position matches a part, and others."""
        names = list(dims.PRODUCT_CATEGORIES)
        position = (F.col("p_partkey") % 80).cast("int")
        known = F.get(F.array(*[F.lit(n) for n in names]), position)
        return parts.select(F.coalesce(known, F.concat(F.lit("other-"), position)).alias("slug")).distinct()

    @cached_property
    def known_slugs(self) -> DataFrame:
        """Slugs of every part."""
        return self.upstream_slugs(self.table("part"))

    @cached_property
    def live_slugs(self) -> DataFrame:
        """Slugs of an upstream that lacks every seventh."""
        return self.upstream_slugs(self.table("part").where((F.col("p_partkey") % 80).cast("int") % 7 != 3))

    # ---- source files

    @cached_property
    def files(self) -> DataFrame:
        """One source file per document, wrapped around its whole text."""
        key = F.col("doc_id")
        folder = (
            F.when(F.col("lang") == "en", "app")
            .when(F.col("lang") == "fr", "src/test")
            .when(F.col("lang") == "de", "docs")
            .otherwise("sample")
        )
        kind = key % 4
        ext = F.when(kind == 0, ".py").when(kind == 1, ".java").when(kind == 2, ".js").otherwise(".md")
        name = (
            F.when(key % 97 == 0, F.concat(key, F.lit("/LICENSE")))
            .when(key % 31 == 0, F.concat(F.lit("node_modules/x"), key, F.lit(".js")))
            .when(key % 37 == 0, F.concat(key, F.lit("/AndroidManifest.xml")))
            .when(key % 41 == 0, F.concat(key, F.lit("/build.gradle")))
            .when(key % 43 == 0, F.concat(F.lit("image"), key, F.lit(".png")))
            .otherwise(F.concat(F.lit("doc_"), key, ext))
        )
        fill = lambda text: F.replace(
            F.replace(
                F.replace(text, F.lit("{id}"), key.cast("string")),
                F.lit("{perm}"),
                F.when(key % 3 == 0, "CAMERA").when(key % 3 == 1, "INTERNET").otherwise("READ_SMS"),
            ),
            F.lit("{impl}"),
            F.repeat(F.lit("implementation "), (key % 5).cast("int")),
        )
        head = None
        for variant, lines in SOURCE_LINES.items():
            head = (F.when if head is None else head.when)(key % 5 == variant, F.lit(HEAD % lines))
        return self.table("documents").select(
            F.col("source").alias("project_id"),
            F.concat_ws("/", "source", folder, name).alias("path"),
            F.concat(fill(head), "text", fill(F.lit(TAIL))).alias("text"),
        )

    @cached_property
    def scanned(self) -> DataFrame:
        return scan.scanned_files(self.files)

    # ---- findings of several engines

    @cached_property
    def findings(self) -> DataFrame:
        """Internal findings, one per event; every eighteenth has no line."""
        e = F.col("event_id")
        folder = F.when(e % 5 == 0, "src/test/").when(e % 5 == 1, "sample/").when(e % 5 == 2, "docs/").otherwise("app/")
        names = F.array(*[F.lit(n) for n in ("LoginToken", "UserDao", "HttpClient", "MainActivity", "Misc")])
        path = F.concat(folder, F.get(names, (e % 7 % 5).cast("int")), e % 60, F.lit(".kt"))
        rule = F.get(F.array(*[F.lit(r.id) for r in RULES]), (e % 18).cast("int"))
        base = self.table("events").select(
            F.concat(F.lit("src"), F.col("user_id") % 20).alias("project_id"),
            e.alias("ord"),
            rule.alias("rule_id"),
            path.alias("path"),
            F.when(e % 18 != 17, (e % 40 + 1).cast("int")).alias("line"),
            F.when(e % 2 == 0, F.concat(F.lit('key = "abc'), F.hex(e), F.lit('QWERTYasdfgh0123"')))
            .otherwise(F.concat(F.lit("key = abc"), F.hex(e), F.lit("QWERTYasdfgh0123")))
            .alias("evidence"),
            F.lit("interno").alias("engine"),
            (e % 19 == 0).alias("reachable"),
        )
        texts = rule_texts(self.spark)
        return base.join(texts, "rule_id")

    @cached_property
    def external(self) -> DataFrame:
        """Findings of other engines: copies of the internal ones, in part shifted."""
        f = self.findings
        e = F.col("ord")
        return f.select(
            "project_id",
            "ord",
            F.concat(F.lit("EXT-"), e % 5).alias("rule_id"),
            "path",
            F.when(e % 9 != 0, F.col("line") + F.when(e % 4 == 0, 1).otherwise(0)).alias("line"),
            F.when(e % 27 == 0, F.concat(F.lit("CVE-2024-"), 1000 + e % 10)).otherwise("x").alias("evidence"),
            F.get(F.array(*[F.lit(n) for n in ENGINES]), (e % 7).cast("int")).alias("engine"),
            F.lit(False).alias("reachable"),
            "title",
            "category",
            "severity",
            "guide",
            "legal",
            F.when(e % 2 == 0, F.regexp_extract("cwe", r"CWE-\d+", 0)).otherwise("CWE-999").alias("cwe"),
            "mitigation",
        )
