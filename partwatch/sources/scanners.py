"""Reports of seven scanners to one finding shape (SRC-11, N-01..N-07, U-03, A-29).

``reports(project_id, root, body)`` holds one report per row. A report that cannot be read gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_text as st
from ..functions.common import let, lookup
from ..controls import cwe_controls

# Fixed values.
SEVERITY = {
    "ERROR": "alto",
    "WARNING": "medio",
    "INFO": "bajo",
    "HIGH": "alto",
    "MEDIUM": "medio",
    "LOW": "bajo",
    "CRITICAL": "crítico",
    "UNKNOWN": "bajo",
}
ENGINES = ("semgrep", "detect-secrets", "bandit", "njsscan", "gitleaks", "trivy", "retire")
GUIDE = "Hallazgo aportado por motor externo; ver lineamientos SEGPRES de seguridad."
LEGAL = "A verificar contra el marco aplicable (no es asesoría legal)."
ROTATE = "Remover el secreto del código y rotarlo; usar gestor de secretos."
ROTATE_IN = "Remover el secreto del código y rotarlo; usar un gestor de secretos."
SECRETS = "COMPARTIMENTAJE"
SEMGREP = (
    "results array<struct<path:string,check_id:string,start:struct<line:int>,extra:struct<severity:string,message:string,"
    "lines:string,metadata:struct<cwe:string,titulo:string,categoria:string,mitigacion:string>>>>"
)
DETECT_SECRETS = "results map<string,array<struct<type:string,line_number:int>>>"
BANDIT = (
    "results array<struct<filename:string,line_number:int,test_id:string,test_name:string,issue_severity:string,"
    "issue_text:string,code:string,issue_cwe:struct<id:int>>>"
)
NJSSCAN_SECTION = (
    "map<string,struct<metadata:struct<cwe:string,severity:string,description:string>,"
    "files:array<struct<file_path:string,match_lines:array<int>,match_string:string>>>>"
)
NJSSCAN = f"nodejs {NJSSCAN_SECTION}, templates {NJSSCAN_SECTION}"
GITLEAKS = "array<struct<File:string,StartLine:int,RuleID:string,Description:string,Match:string,Secret:string>>"
TRIVY = (
    "Results array<struct<Target:string,"
    "Vulnerabilities:array<struct<VulnerabilityID:string,PkgName:string,InstalledVersion:string,FixedVersion:string,"
    "Title:string,Severity:string,CweIDs:array<string>>>,"
    "Secrets:array<struct<RuleID:string,Title:string,Severity:string,StartLine:int,Match:string>>,"
    "Misconfigurations:array<struct<ID:string,Title:string,Severity:string,Message:string,Resolution:string,"
    "CauseMetadata:struct<StartLine:int>>>>>"
)
RETIRE_ENTRIES = (
    "array<struct<file:string,results:array<struct<component:string,version:string,vulnerabilities:array<struct<"
    "severity:string,identifiers:struct<CVE:array<string>,summary:string,issue:string>>>>>>>"
)


def local_severity(text: Column, default: str = "medio") -> Column:
    """S-35."""
    return F.coalesce(lookup(F.upper(text), SEVERITY), F.lit(default))


def _or(c: Column, default: str) -> Column:
    """Value, or the default when it is null or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise(default)


FIELDS = {
    "engine": "string", "path": "string", "line": "int", "rule": "string", "title": "string", "category": "string", "severity": "string", "evidence": "string",
    "cwe": "string", "mitigation": "string",
}
FINDINGS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FIELDS.items()) + ">>"


def _shaped(*values) -> Column:
    """One finding as a struct of ``FIELDS``."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[as_column(v).cast(t).alias(n) for v, (n, t) in zip(values, FIELDS.items(), strict=True)])


def _each(array: Column, shape) -> Column:
    """Findings of the elements of an array; none for a null one."""
    return F.coalesce(F.transform(array, shape).cast(FINDINGS), F.array().cast(FINDINGS))


def _all(array: Column, shapes) -> Column:
    """Findings of elements that have several each."""
    return F.coalesce(F.flatten(F.transform(array, shapes)).cast(FINDINGS), F.array().cast(FINDINGS))


def _semgrep(body: Column) -> Column:
    """N-01. ``cwe`` may be a text or a list; both are read as text."""

    def shape(r: Column) -> Column:
        meta, extra = r["extra"]["metadata"], r["extra"]
        raw = meta["cwe"]
        first = F.when(raw.startswith("["), F.get(F.from_json(raw, "array<string>"), F.lit(0))).otherwise(raw)
        return _shaped(
            "semgrep", r["path"], r["start"]["line"],
            F.concat(F.lit("SG-"), F.substring_index(F.coalesce(r["check_id"], F.lit("regla")), ".", -1)),
            F.coalesce(F.when(meta["titulo"] != "", meta["titulo"]), _or(extra["message"], "Hallazgo Semgrep")),
            F.coalesce(meta["categoria"], F.lit("SAST EXTERNO")), local_severity(extra["severity"]), extra["lines"], F.coalesce(st.cwe_id(first), first),
            F.coalesce(F.when(meta["mitigacion"] != "", meta["mitigacion"]), extra["message"], F.lit("Revisar y corregir según el patrón detectado.")),
        )

    return _each(F.from_json(body, SEMGREP)["results"], shape)


def _detect_secrets(body: Column) -> Column:
    """N-02."""

    def in_file(entry: Column) -> Column:
        def shape(r: Column) -> Column:
            kind = r["type"]
            return _shaped(
                "detect-secrets", entry["key"], r["line_number"], F.concat(F.lit("DS-"), F.replace(F.coalesce(kind, F.lit("secreto")), F.lit(" "), F.lit("-"))),
                F.concat(F.lit("Secreto detectado: "), F.coalesce(kind, F.lit("genérico"))), SECRETS, "alto", kind, "CWE-798", ROTATE,
            )

        return _each(entry["value"], shape)

    return _all(F.map_entries(F.from_json(body, DETECT_SECRETS)["results"]), in_file)


def _bandit(body: Column) -> Column:
    """N-03."""

    def shape(r: Column) -> Column:
        cwe = r["issue_cwe"]["id"]
        return _shaped(
            "bandit", r["filename"], r["line_number"], F.concat(F.lit("BANDIT-"), F.coalesce(r["test_id"], F.lit(""))), F.coalesce(r["test_name"], F.lit("Hallazgo Bandit")),
            "SAST EXTERNO (Python)", local_severity(r["issue_severity"]), r["code"], F.when(cwe != 0, F.concat(F.lit("CWE-"), cwe)),
            F.coalesce(r["issue_text"], F.lit("Revisar el patrón inseguro detectado por Bandit.")),
        )

    return _each(F.from_json(body, BANDIT)["results"], shape)


def _njsscan(body: Column) -> Column:
    """N-04: two sections of rule -> files; the first matched line counts."""

    def of_rule(entry: Column) -> Column:
        m = entry["value"]["metadata"]
        return _each(
            entry["value"]["files"],
            lambda f: _shaped(
                "njsscan", f["file_path"], F.get(f["match_lines"], F.lit(0)), F.concat(F.lit("NJS-"), entry["key"]),
                F.coalesce(F.when(m["description"] != "", m["description"]), entry["key"]), "SAST EXTERNO (Node/JS)", local_severity(m["severity"]), f["match_string"],
                st.cwe_id(m["cwe"]), _or(m["description"], "Revisar el patrón inseguro detectado por njsscan."),
            ),
        )

    both = let(F.from_json(body, NJSSCAN), lambda d: F.concat(_all(F.map_entries(d["nodejs"]), of_rule), _all(F.map_entries(d["templates"]), of_rule)))
    return F.coalesce(both, F.array().cast(FINDINGS))


def _gitleaks(body: Column) -> Column:
    """N-05."""

    def shape(r: Column) -> Column:
        return _shaped(
            "gitleaks", r["File"], r["StartLine"], F.concat(F.lit("GL-"), F.coalesce(r["RuleID"], F.lit("secreto"))),
            F.concat(F.lit("Secreto detectado: "), F.coalesce(r["Description"], F.lit("genérico"))), SECRETS, "alto", F.coalesce(F.when(r["Match"] != "", r["Match"]), r["Secret"]),
            "CWE-798", ROTATE_IN,
        )

    return _each(F.from_json(body, GITLEAKS), shape)


def _trivy(body: Column) -> Column:
    """N-06: dependencies (without a line), secrets and configuration."""

    def of_target(r: Column) -> Column:
        target = r["Target"]

        def dependency(v: Column) -> Column:
            text = lambda name: F.coalesce(v[name], F.lit(""))
            update = F.when(
                text("FixedVersion") != "", F.concat(F.lit("Actualizar "), text("PkgName"), F.lit(" a "), v["FixedVersion"], F.lit("."))
            ).otherwise("Actualizar la dependencia a una versión sin la vulnerabilidad.")
            return _shaped(
                "trivy", target, None, F.concat(F.lit("TRIVY-"), F.coalesce(v["VulnerabilityID"], F.lit("VULN"))),
                _or(F.coalesce(F.when(v["Title"] != "", v["Title"]), v["VulnerabilityID"]), "Dependencia vulnerable"), "DEPENDENCIA VULNERABLE (SCA)", local_severity(v["Severity"]),
                F.concat(text("PkgName"), F.lit(" "), text("InstalledVersion"), F.lit(" -> "), text("VulnerabilityID")), st.cwe_id(F.get(v["CweIDs"], F.lit(0))), update,
            )

        def secret(v: Column) -> Column:
            return _shaped(
                "trivy", target, v["StartLine"], F.concat(F.lit("TRIVY-SEC-"), F.coalesce(v["RuleID"], F.lit("secreto"))),
                F.concat(F.lit("Secreto detectado: "), F.coalesce(v["Title"], F.lit("genérico"))), SECRETS, local_severity(v["Severity"], "alto"), v["Match"], "CWE-798", ROTATE_IN,
            )

        def configuration(v: Column) -> Column:
            return _shaped(
                "trivy", target, v["CauseMetadata"]["StartLine"], F.concat(F.lit("TRIVY-CFG-"), F.coalesce(v["ID"], F.lit("config"))), _or(v["Title"], "Configuración insegura"),
                "CONFIGURACIÓN INSEGURA (IaC)", local_severity(v["Severity"]), v["Message"], None, _or(v["Resolution"], "Corregir la configuración según la recomendación de Trivy."),
            )

        return F.concat(_each(r["Vulnerabilities"], dependency), _each(r["Secrets"], secret), _each(r["Misconfigurations"], configuration))

    return _all(F.from_json(body, TRIVY)["Results"], of_target)


def _retire(body: Column) -> Column:
    """N-07: a list, or an object that holds it under ``data``."""
    entries = F.when(body.rlike(r"^\s*\["), F.from_json(body, RETIRE_ENTRIES)).otherwise(F.from_json(body, f"data {RETIRE_ENTRIES}")["data"])

    def of_component(file: Column, c: Column) -> Column:
        component, label = F.coalesce(c["component"], F.lit("lib")), F.concat(F.coalesce(c["component"], F.lit("lib")), F.lit(" "), F.coalesce(c["version"], F.lit("")))

        def shape(v: Column) -> Column:
            ids = v["identifiers"]
            cve = F.get(ids["CVE"], F.lit(0))
            return _shaped(
                "retire", file, None, F.concat(F.lit("RETIRE-"), F.coalesce(cve, ids["issue"], component)),
                F.coalesce(F.when(ids["summary"] != "", ids["summary"]), F.concat(label, F.lit(": librería JS vulnerable"))), "LIBRERÍA JS VULNERABLE (SCA)",
                local_severity(v["severity"]), F.concat(label, F.coalesce(F.concat(F.lit(" -> "), cve), F.lit(""))), None,
                F.concat(F.lit("Actualizar "), component, F.lit(" a una versión sin la vulnerabilidad reportada.")),
            )

        return _each(c["vulnerabilities"], shape)

    return _all(entries, lambda r: _all(r["results"], lambda c: of_component(r["file"], c)))


SHAPES = {
    "semgrep": _semgrep, "detect-secrets": _detect_secrets, "bandit": _bandit, "njsscan": _njsscan, "gitleaks": _gitleaks, "trivy": _trivy, "retire": _retire,
}


def _opened(reports: DataFrame, findings: Column) -> DataFrame:
    f = F.col("f")
    text = lambda name, default: F.lit(default).cast("string").alias(name)
    return reports.select("project_id", "root", F.explode(findings).alias("f")).select(
        "project_id", f["rule"].alias("rule_id"), f["title"].alias("title"), f["category"].alias("category"), f["severity"].alias("severity"),
        st.relative_path(F.coalesce(f["path"], F.lit("")), F.col("root")).alias("path"), f["line"].alias("line"),
        st.redact(F.coalesce(f["evidence"], F.lit(""))).alias("evidence"), text("guide", GUIDE), text("legal", LEGAL), f["cwe"].alias("cwe"),
        f["mitigation"].alias("mitigation"), f["engine"].alias("engine"),
    )


READERS = {name: (lambda reports, shape=shape: _opened(reports, shape(F.col("body")))) for name, shape in SHAPES.items()}
# The readers by name; each takes the reports of its engine.
semgrep, detect_secrets, bandit, njsscan, gitleaks, trivy, retire = (READERS[e] for e in ENGINES)


def all_findings(reports: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """U-03: findings of the chosen engines. ``reports`` has an ``engine`` column besides the above.

    One pass: the engine chooses the shape, so each report is parsed once, and one row per report opens into its findings.
    """
    chosen = None
    for name in engines:
        chosen = (F.when if chosen is None else chosen.when)(F.col("engine") == name, SHAPES[name](F.col("body")))
    return _opened(reports.where(F.col("engine").isin(*engines)), chosen)


def with_controls(findings: DataFrame) -> DataFrame:
    """J-17: controls a finding is traced to."""
    joined = findings.join(cwe_controls(findings.sparkSession), "cwe", "left")
    return joined.withColumn("controls", F.coalesce("controls", F.array().cast("array<string>")))


def engine_counts(findings: DataFrame, projects: DataFrame, engines: tuple[str, ...] = ENGINES) -> DataFrame:
    """A-29: findings per project and engine that ran, with zeros."""
    ran = projects.select("project_id", F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"))
    counts = findings.groupBy("project_id", "engine").agg(F.count("*").alias("findings"))
    return ran.join(counts, ["project_id", "engine"], "left").na.fill(0, ["findings"])
