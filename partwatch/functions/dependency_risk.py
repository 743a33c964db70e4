"""Risk of one dependency and the texts that explain it (S-18..S-22, S-44, S-45, O-02, O-05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let, lookup

# Fixed values.
LEVEL_RANK = {"crítico": 4, "alto": 3, "medio": 2, "bajo": 1, "ok": 0, "desconocido": 0}
PLATFORM_SCORE = {"crítico": 12.0, "alto": 8.0, "medio": 4.0, "bajo": 1.5, "ok": 0.0, "desconocido": 0.0}
SEVERITY_WEIGHT = {"crítica": 10.0, "alta": 7.0, "media": 4.0, "baja": 2.0}
UNKNOWN_SEVERITY_WEIGHT = 3.0
GAP_SCORE = {"major": 3.0, "minor": 1.5, "patch": 0.5}
LEGAL_SCORE = {"crítico": 12.0, "alto": 8.0, "medio": 4.0}
PLATFORM_LABEL = {"alto": "ALTO", "medio": "MEDIO", "bajo": "BAJO", "ok": "OK", "desconocido": "INDETERMINADO"}


def level_rank(level: Column) -> Column:
    return F.coalesce(lookup(level, LEVEL_RANK), F.lit(0))


def dependency_risk(count, severity, gap, note, legal_level, platform_kind, platform_level) -> Column:
    """STRUCT<level, score, severity>.

    The level is the highest one any signal asks for, so each signal maps to a rank and the ranks are maximised.
    """
    n = F.coalesce(count, F.lit(0))
    vulnerable = n > 0
    cve_rank = (
        F.when(~vulnerable, 0).when(severity == "crítica", 4).when(severity == "alta", 3).otherwise(2)
    )
    gap_rank = F.when(gap == "major", 2).when(gap.isin("minor", "patch"), 1).otherwise(0)
    legal_rank = F.coalesce(lookup(legal_level, {"crítico": 4, "alto": 3, "medio": 2}), F.lit(0))
    rank = F.greatest(cve_rank, gap_rank, legal_rank)
    level = let(
        rank,
        lambda r: F.when(r == 4, "crítico")
        .when(r == 3, "alto")
        .when(r == 2, "medio")
        .when(r == 1, "bajo")
        .when(note == "neterror", "desconocido")
        .otherwise("ok"),
    )
    score = (
        F.when(
            vulnerable,
            F.coalesce(lookup(severity, SEVERITY_WEIGHT), F.lit(UNKNOWN_SEVERITY_WEIGHT))
            + F.least(n, F.lit(5)) * 0.5,
        ).otherwise(0.0)
        + F.coalesce(lookup(gap, GAP_SCORE), F.lit(0.0))
        + F.coalesce(lookup(legal_level, LEGAL_SCORE), F.lit(0.0))
    )
    fixed = F.coalesce(platform_level, F.lit("ok"))
    is_platform = platform_kind.isNotNull()
    return F.struct(
        F.when(is_platform, fixed).otherwise(level).alias("level"),
        F.when(is_platform, F.coalesce(lookup(fixed, PLATFORM_SCORE), F.lit(0.0)))
        .otherwise(F.round(score, 1))
        .alias("score"),
        F.when(~is_platform, severity).alias("severity"),
    )


def severity_label(level, severity, legal_level, platform_kind) -> Column:
    """Wording of the severity degree; legal labels come before technical ones."""
    return (
        F.when(
            platform_kind.isNotNull(),
            F.format_string(
                "PLATAFORMA (%s) — %s",
                platform_kind,
                F.coalesce(lookup(level, PLATFORM_LABEL), F.upper(level)),
            ),
        )
        .when(legal_level == "crítico", "GRAVÍSIMO — riesgo legal: posible paquete malicioso (Ley 21.459)")
        .when(
            legal_level == "alto",
            "GRAVE — riesgo legal: posible tratamiento de datos de fuente ilícita (Ley 21.459 Art. 6)",
        )
        .when(
            level == "crítico",
            F.format_string("CRÍTICO — CVE de severidad %s", F.coalesce(severity, F.lit("alta"))),
        )
        .when(
            level == "alto",
            F.format_string("ALTO — vulnerabilidad %s", F.coalesce(severity, F.lit("alta"))),
        )
        .when(
            (level == "medio") & (legal_level == "medio"),
            "MEDIO — revisión de cumplimiento (tratamiento de datos personales)",
        )
        .when((level == "medio") & severity.isNotNull(), F.format_string("MEDIO — CVE %s", severity))
        .when(level == "medio", "MEDIO — versión major atrasada")
        .when(level == "bajo", "BAJO — desactualización menor")
        .when(level == "desconocido", "INDETERMINADO — sin datos de CVE (sin conexión a OSV)")
        .otherwise("OK — sin observaciones")
    )


def _or_none(c: Column) -> Column:
    return F.coalesce(c, F.lit("None"))


def known_risks(e) -> Column:
    """List of known risks of an entry; never empty. ``e`` maps a field name to its column."""
    count = F.coalesce(e("vuln_count"), F.lit(0))
    severity = e("severity")
    ids = F.array_join(e("vuln_ids"), ", ")
    summary = F.format_string(
        "%s CVE conocido(s) para la versión %s%s: %s.",
        count.cast("string"),
        _or_none(e("installed")),
        F.coalesce(F.concat(F.lit(" (severidad máx. "), severity, F.lit(")")), F.lit("")),
        F.when(ids != "", ids).otherwise("ver detalle"),
    )
    details = F.when(
        count > 0,
        F.transform(
            F.filter(e("vuln_details"), lambda d: d["summary"] != ""),
            lambda d: F.concat(_or_none(d["id"]), F.lit(": "), d["summary"]),
        ),
    )
    gap = F.when(
        e("gap") == "major",
        F.format_string(
            "Versión major atrasada: instalada %s vs. última %s — posible deuda técnica y falta de parches.",
            _or_none(e("installed")),
            _or_none(e("latest")),
        ),
    ).when(
        e("gap").isin("minor", "patch"),
        F.format_string(
            "Desactualización %s: %s → %s.", e("gap"), _or_none(e("installed")), _or_none(e("latest"))
        ),
    )
    note = F.when(
        e("note") != "neterror",
        F.format_string("Especificación no resoluble (%s): no se pudo evaluar la versión.", e("note")),
    )
    rationale = e("compliance")["rationale"]
    general = F.array_compact(
        F.concat(
            F.array(
                F.concat(F.lit("⚖ RIESGO LEGAL/CUMPLIMIENTO: "), rationale),
                F.when(count > 0, summary),
            ),
            F.coalesce(details, F.array().cast("array<string>")),
            F.array(gap, note),
        )
    )
    general = F.when(F.size(general) > 0, general).otherwise(
        F.array(F.lit("Sin riesgos conocidos detectados."))
    )
    platform = F.array(F.coalesce(F.when(e("platform_note") != "", e("platform_note")), F.lit("Sin observaciones.")))
    return F.when(e("platform_kind").isNotNull(), platform).otherwise(general)


def technical_precision(e) -> Column:
    registry = F.when(e("ecosystem") == "Maven", "Maven Central / Google Maven").otherwise("npm")
    checked = F.when(
        e("vuln_status").isin("ok", "vulnerable", "clean"),
        "; CVE consultados en OSV con coincidencia exacta de versión.",
    ).otherwise(".")
    return (
        F.when(
            e("platform_kind").isNotNull(),
            F.format_string(
                "Componente de plataforma Android. Valor declarado: %s; referencia vigente: %s.",
                _or_none(e("installed")),
                _or_none(F.coalesce(e("latest_label"), e("latest"))),
            ),
        )
        .when(
            e("note") == "neterror",
            F.format_string(
                "Evaluación parcial: no se pudo consultar OSV para esta dependencia (sin conexión). El estado de "
                "versión proviene de %s; los CVE quedan pendientes.",
                registry,
            ),
        )
        .when(
            e("note") != "",
            "Precisión limitada: la versión no se pudo resolver (catálogo/variable/alias o artefacto no encontrado), "
            "por lo que no se evalúa versión exacta ni CVE.",
        )
        .when(
            F.coalesce(e("installed"), F.lit("")) == "",
            "Precisión limitada: no se pudo determinar la versión instalada.",
        )
        .otherwise(
            F.concat(
                F.format_string(
                    "Alta: versión declarada (%s); última versión verificada en %s", e("installed"), registry
                ),
                checked,
            )
        )
    )


def mitigations(e) -> Column:
    """List of recommended measures; never empty."""
    vulnerable = F.coalesce(e("vuln_count"), F.lit(0)) > 0
    latest = _or_none(e("latest"))
    update = F.when(
        vulnerable,
        F.format_string(
            "Actualizar %s a una versión sin los CVE reportados (referencia: última %s) y re-auditar.",
            e("package"),
            latest,
        ),
    )
    review = F.when(
        vulnerable, "Revisar el detalle de cada CVE (impacto/explotabilidad) antes de aprobar el build."
    )
    gap = F.when(
        e("gap") == "major",
        F.format_string(
            "Planificar migración a la versión major %s (revisar breaking changes y guía de migración del paquete).",
            latest,
        ),
    ).when(
        e("gap").isin("minor", "patch"),
        F.format_string("Actualizar a %s (%s), de bajo riesgo de ruptura.", latest, e("gap")),
    )
    pin = F.when(
        e("pinned").eqNullSafe(False) & (e("installed") != ""),
        "Considerar fijar la versión (lockfile / versión exacta) para builds reproducibles.",
    )
    retry = F.when(
        e("note") == "neterror",
        "Reintentar la auditoría con conexión a OSV para confirmar ausencia de CVE.",
    )
    general = F.array_compact(
        F.array(
            F.concat(F.lit("⚖ "), e("compliance")["recomendacion"]), update, review, gap, pin, retry
        )
    )
    general = F.when(F.size(general) > 0, general).otherwise(
        F.array(F.lit("Mantener monitoreo; sin acción inmediata requerida."))
    )
    platform = F.array(
        F.coalesce(
            F.when(e("platform_reco") != "", e("platform_reco")),
            F.lit("Mantener al día según el ciclo de versiones de Android."),
        )
    )
    return F.when(e("platform_kind").isNotNull(), platform).otherwise(general)


def state_label(legal_level, count, gap, note, outdated) -> Column:
    """One-word state of an audited dependency."""
    return (
        F.when(legal_level == "crítico", "⚖ GRAVÍSIMO")
        .when(legal_level == "alto", "⚖ GRAVE")
        .when(count > 0, "VULNERABLE")
        .when(legal_level == "medio", "⚖ REVISAR")
        .when(gap == "major", "MAJOR")
        .when(note == "neterror", "?")
        .when(outdated, "DESACTUAL.")
        .when(~outdated, "OK")
        .otherwise("—")
    )


def gap_label(note, outdated, gap) -> Column:
    return (
        F.when(note == "neterror", "sin conexión")
        .when(note != "", note)
        .when(~outdated, "al día")
        .when(gap == "major", "major ▲")
        .when(gap.isin("minor", "patch"), gap)
        .otherwise("—")
    )


def audit_rank(count, gap, outdated) -> Column:
    """Order of an audit table: vulnerable, major, minor, patch, unknown, up to date."""
    return (
        F.when(count > 0, 0)
        .when(gap == "major", 1)
        .when(gap == "minor", 2)
        .when(gap == "patch", 3)
        .when(~outdated, 5)
        .otherwise(4)
    )


def audit_headline(s) -> Column:
    """Headline over the summary counts."""
    text = lambda c, t: F.concat(c.cast("string"), F.lit(t))
    return (
        F.when(s("compliance_critico") > 0, F.concat(F.lit("⚖ "), text(s("compliance_critico"), " riesgo legal GRAVÍSIMO")))
        .when(s("compliance_alto") > 0, F.concat(F.lit("⚖ "), text(s("compliance_alto"), " riesgo legal GRAVE")))
        .when(s("vulnerable") > 0, text(s("vulnerable"), " con CVE"))
        .when(s("major_behind") > 0, text(s("major_behind"), " con versión major atrasada"))
        .when(s("outdated") > 0, text(s("outdated"), " desactualizadas"))
        .otherwise("Sin observaciones críticas")
    )
