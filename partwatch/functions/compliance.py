"""Legal-compliance level of a package and the record behind it (S-14, S-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import lookup

# Laws, known validators, patterns, and the text of each category.
LAW = "Ley 21.459 (delitos informáticos)"
DATA_LAW = "Ley 19.628 (protección de datos personales)"
KNOWN_VALIDATORS = (
    "chilean-rutify",
    "rut.js",
    "rutjs",
    "validar-rut",
    "rut-validator",
    "rut-helpers",
    "@fdograph/rut-helpers",
    "chilean-rut",
    "rut-chile",
    "@validatecl/rut",
    "rutlib",
    "cl-rut",
    "dni-validator",
    "validator-rut",
)
LOOKUP_TERMS = (
    r"rutificad|consulta.*(rut|cedula|c[eé]dula|persona|padr[oó]n)|"
    r"(rut|cedula|dni).*(nombre|direcci[oó]n|datos\s+personales|lookup|consulta)|"
    r"scrap.*(rut|persona|sii|registro\s*civil)|padr[oó]n\s*electoral"
)
IDENTIFIER_NAME = (
    r"(^|[-_/@])(rut|dni|cedula|c[eé]dula|rfc|curp|nss|ssn|padron|padr[oó]n|rutificad)([-_/]|$)"
)
LEVEL_OF_CATEGORY = {
    "paquete_malicioso": "crítico",
    "consulta_datos_personales": "alto",
    "tratamiento_identificadores": "medio",
}
RATIONALE = {
    "paquete_malicioso": (
        "Existe un aviso de seguridad que clasifica a «%s» como paquete potencialmente malicioso (%s). El código de "
        "un paquete malicioso puede acceder, alterar o exfiltrar datos del sistema y de los usuarios sin autorización."
    ),
    "consulta_datos_personales": (
        "«%s» aparenta permitir la CONSULTA de datos personales a partir de un identificador (p. ej. obtener "
        "nombre/dirección desde un RUT). En Chile estos servicios suelen sustentarse en bases de datos personales "
        "obtenidas, filtradas o comercializadas sin fuente lícita. Si los datos provienen de un acceso ilícito o "
        "filtración, su almacenamiento o uso podría configurar receptación de datos informáticos."
    ),
    "tratamiento_identificadores": (
        "«%s» opera sobre identificadores nacionales (p. ej. RUT). Según su naturaleza habitual, implementa el "
        "ALGORITMO público de validación/formato y NO contiene ni obtiene datos reales de personas, por lo que su "
        "sola inclusión no constituye delito. El riesgo es de CUMPLIMIENTO: depende de cómo la aplicación recolecta y "
        "trata esos identificadores."
    ),
}
ARTICLES = {
    "paquete_malicioso": (
        ("Art. 1", "Ataque a la integridad de un sistema informático."),
        ("Art. 2", "Acceso ilícito a un sistema informático."),
        ("Art. 4", "Ataque a la integridad de los datos informáticos."),
        ("Art. 7", "Fraude informático (manipulación con perjuicio y ánimo de lucro)."),
        ("Art. 8", "Abuso de los dispositivos (programas creados para perpetrar los delitos)."),
    ),
    "consulta_datos_personales": (
        (
            "Art. 6",
            "Receptación de datos informáticos: almacenar, transferir o comercializar datos provenientes de los "
            "delitos de los Arts. 2°, 3° y 5°, conociendo o no pudiendo menos que conocer su origen.",
        ),
        (
            "Art. 2",
            "Acceso ilícito (si la base de datos se obtuvo accediendo sin autorización a un sistema informático).",
        ),
    ),
    "tratamiento_identificadores": (
        (
            "Art. 6",
            "Aplicable SOLO si los identificadores/datos asociados que procesa la aplicación provinieran de fuentes "
            "ilícitas (receptación). El paquete en sí —validador algorítmico— no incurre en este tipo.",
        ),
    ),
}
RECOMMENDATION = {
    "paquete_malicioso": (
        "Eliminar de inmediato la dependencia, rotar credenciales que hayan podido quedar expuestas y revisar los "
        "builds que la incluyeron. No promover a producción."
    ),
    "consulta_datos_personales": (
        "Verificar con el proveedor/área legal la FUENTE de los datos que entrega el paquete. Si no hay licencia o "
        "fuente lícita verificable, no utilizarlo. Confirmar cumplimiento de la Ley 19.628 y, de existir tratamiento "
        "de datos sensibles, evaluar autorización del titular."
    ),
    "tratamiento_identificadores": (
        "Confirmar que los RUT/datos tratados por la aplicación se obtienen del propio titular o de fuentes lícitas, y "
        "que el tratamiento cumple la Ley 19.628 (finalidad, consentimiento y seguridad de los datos). No requiere "
        "remover el paquete."
    ),
}
DISCLAIMER = (
    "Hallazgo automatizado de apoyo a la revisión de cumplimiento. No constituye asesoría legal ni una determinación "
    "de responsabilidad penal; la calificación de un delito requiere análisis jurídico del caso concreto."
)


def compliance_category(package: Column, description: Column, malicious: Column) -> Column:
    """Category of the gravest legal finding of a package, or null; ``malicious`` comes from its advisories."""
    name = F.lower(F.coalesce(package, F.lit("")))
    text = F.lower(F.coalesce(description, F.lit("")))
    pattern = "(?iu)" + LOOKUP_TERMS
    noun = text.contains("rut") | text.contains("cédula") | text.contains("cedula")
    verb = (
        text.contains("valida")
        | text.contains("format")
        | text.contains("validating")
        | text.contains("formating")
    )
    return (
        F.when(malicious, "paquete_malicioso")
        .when(name.rlike(pattern) | text.rlike(pattern), "consulta_datos_personales")
        .when(
            name.isin(*KNOWN_VALIDATORS) | name.rlike("(?iu)" + IDENTIFIER_NAME) | (noun & verb),
            "tratamiento_identificadores",
        )
    )


def compliance_level(category: Column) -> Column:
    return lookup(category, LEVEL_OF_CATEGORY)


def compliance_record(package: Column, category: Column, malware_id: Column) -> Column:
    """Full record of a finding (null when the package has none)."""
    articles = None
    for name, rows in ARTICLES.items():
        value = F.array(*[F.struct(F.lit(a).alias("art"), F.lit(t).alias("texto")) for a, t in rows])
        articles = (F.when if articles is None else articles.when)(category == name, value)
    rationale = F.when(
        category == "paquete_malicioso",
        F.format_string(
            RATIONALE["paquete_malicioso"], package, F.coalesce(malware_id, F.lit("None"))
        ),
    )
    for name in ("consulta_datos_personales", "tratamiento_identificadores"):
        rationale = rationale.when(category == name, F.format_string(RATIONALE[name], package))
    laws = F.when(category == "paquete_malicioso", F.array(F.lit(LAW))).otherwise(
        F.array(F.lit(LAW), F.lit(DATA_LAW))
    )
    return F.when(
        category.isNotNull(),
        F.struct(
            package.alias("package"),
            compliance_level(category).alias("nivel"),
            category.alias("categoria"),
            rationale.alias("rationale"),
            F.lit(LAW).alias("ley"),
            laws.alias("leyes"),
            articles.alias("articulos"),
            lookup(category, RECOMMENDATION).alias("recomendacion"),
            F.lit(DISCLAIMER).alias("disclaimer"),
        ),
    )
