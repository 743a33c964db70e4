"""Control catalogue of the conformity evaluation. Callers may pass their own controls (X-01)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Control:
    id: str
    instrument: str
    reference: str
    domain: str
    title: str
    demand: str
    violated_by: tuple[str, ...] = ()
    shown_by: tuple[str, ...] = ()
    assessable: bool = True
    documents: str | None = None
    severity: str = "alto"


# States from best to worst, and the five functions.
STATE_RANK = {"no_cumple": 3, "observado": 2, "no_evaluable": 1, "cumple": 0}
STATES = ("cumple", "no_cumple", "observado", "no_evaluable")
FUNCTIONS = ("Identificar", "Proteger", "Detectar", "Responder", "Recuperar")
# Id, title, law, date and address of each instrument.
INSTRUMENTS = (
    ("Decreto 7/2023", "Norma Técnica de Seguridad de la Información y Ciberseguridad", "Ley 21.180", "17-AGO-2023", "https://bcn.cl/3hri8"),
    ("Decreto 9/2023", "Norma Técnica de Autenticación", "Ley 21.180 · Ley 19.628", "17-AGO-2023", "https://bcn.cl/3h75f"),
    ("Decreto 10/2023", "Norma Técnica de Documentos y Expedientes Electrónicos", "Ley 21.180 · Ley 19.628", "17-AGO-2023", "https://bcn.cl/3hh4y"),
    ("Decreto 11/2023", "Norma Técnica de Calidad y Funcionamiento de las Plataformas Electrónicas", "Ley 21.180", "17-AGO-2023", "https://bcn.cl/3m2os"),
    ("DS 83/2004", "Norma Técnica sobre Seguridad y Confidencialidad del Documento Electrónico", "Ley 19.799", "12-ENE-2005", "https://bcn.cl/3l02i"),
)
# The controls.
CONTROLS = (
    Control("D9-A6-CIFRADO-FACTOR", "Decreto 9/2023", "Art. 6 inc. 2", "Proteger", "Almacenamiento cifrado de los factores de autenticación", "Los datos de identificación asociados a los factores de autenticación deben almacenarse cifrados mediante algoritmos tales como Bcrypt, PBKDF2, SHA-3 o Argon2, o superiores.", ("CRY-WEAK-HASH", "SEC-PASSWORD")),
    Control("D9-A6-TLS", "Decreto 9/2023", "Art. 6 inc. 3", "Proteger", "Transmisión cifrada en el proceso de autenticación (TLS 1.2+)", "La transmisión de datos durante la autenticación debe usar protocolos de comunicación cifrados, tales como TLSv1.2 o superiores; no se admite tráfico en texto claro ni la desactivación de la validación de certificados.", ("NET-CLEARTEXT", "NET-TRUST-ALL")),
    Control("D9-A6-OIDC-OAUTH", "Decreto 9/2023", "Art. 6 inc. 1", "Proteger", "Mecanismos oficiales basados en OpenID Connect / OAuth 2.0", "Los mecanismos oficiales de autenticación (ClaveÚnica, Clave Tributaria) deben basarse en los estándares OpenID Connect y OAuth 2.0 o superiores.", (), ("AUTH-OIDC-PRESENTE",), True, "Configuración de cliente OIDC/OAuth2 hacia el proveedor oficial; constancia de certificación de la integración (Art. 10 N°3).", "medio"),
    Control("D9-A7-FUERZA-BRUTA", "Decreto 9/2023", "Art. 7", "Proteger", "Prevención de accesos no autorizados (límite de intentos / Captcha)", "Deben implementarse pruebas tipo Captcha y limitar el número máximo de intentos fallidos de autenticación, con bloqueo y un procedimiento de desbloqueo.", (), (), False, "Política de bloqueo por intentos fallidos; configuración del proveedor de autenticación; pruebas de control de fuerza bruta.", "medio"),
    Control("D9-A13-TRAZABILIDAD", "Decreto 9/2023", "Art. 13", "Detectar", "Registro de trazabilidad de accesos (identificador + fecha/hora UTC)", "Debe mantenerse un registro de accesos que almacene, al menos, el identificador del usuario y la fecha y hora del acceso en UTC, sincronizada con el SHOA. El registro NO debe contener datos sensibles en claro.", ("LOG-SENSITIVE",), (), True, "Esquema del registro de accesos; sincronización horaria (NTP/UTC); política de retención de logs.", "medio"),
    Control("D9-A14-DATOS-PERSONALES", "Decreto 9/2023", "Art. 14", "Proteger", "Protección de datos personales de quienes se autentican", "Debe respetarse la Ley 19.628: reserva y protección de los datos personales, y garantía de los derechos de acceso, rectificación, cancelación y oposición (ARCO), usándolos solo para la finalidad prevista.", ("PII-RUT", "LOG-SENSITIVE"), (), True, "Registro de actividades de tratamiento; base de licitud y finalidad; mecanismos ARCO; cifrado del dato en reposo.", "medio"),
    Control("D7-A4-DIAGNOSTICO", "Decreto 7/2023", "Art. 4", "Identificar", "Diagnóstico inicial de ciberseguridad de la plataforma", "Cada órgano debe realizar un diagnóstico inicial del estado de ciberseguridad de sus plataformas e incorporarlo al Catálogo de Plataformas.", (), (), False, "Informe de diagnóstico inicial; inscripción en el Catálogo de Plataformas (Art. 57 del Reglamento).", "medio"),
    Control("D7-A5-POLITICA", "Decreto 7/2023", "Art. 5", "Identificar", "Política de Seguridad de la Información y Ciberseguridad", "Debe existir una Política aprobada por acto administrativo del Jefe Superior de Servicio, que vele por la seguridad de software, hardware, sistemas y datos.", (), (), False, "Resolución que aprueba la Política; evidencia de difusión y revisión periódica.", "bajo"),
    Control("D7-A8-PROTECCION-DATOS", "Decreto 7/2023", "Art. 8", "Proteger", "Seguridad de los datos (función de protección)", "La función de protección comprende la seguridad de los datos: deben implementarse medidas que protejan la confidencialidad e integridad de la información, incluido el cifrado correcto en reposo y en tránsito.", ("CRY-ECB", "CRY-WEAK-HASH", "NET-CLEARTEXT", "NET-TRUST-ALL")),
    Control("D7-A8-CONTROL-ACCESO", "Decreto 7/2023", "Art. 8", "Proteger", "Gestión de autenticación y control de acceso", "La función de protección incluye la gestión de autenticación y control de acceso a las plataformas: las credenciales y secretos no deben quedar expuestos ni embebidos en el código.", ("SEC-API-KEY", "SEC-GOOGLE-KEY", "SEC-PRIVATE-KEY", "SEC-PASSWORD", "SEC-DB-URL"), severity="crítico"),
    Control("D7-A9-CODIGO-MALICIOSO", "Decreto 7/2023", "Art. 9", "Detectar", "Protección y detección frente a código malicioso", "La función de detección exige que los servidores y plataformas cuenten con medidas adecuadas de protección contra código malicioso y un proceso de detección de eventos anómalos.", ("DEP-MALWARE",), severity="crítico"),
    Control("D7-A8-REGISTRO-EVENTOS", "Decreto 7/2023", "Art. 8", "Detectar", "Registro de eventos (logging) sin exposición de datos sensibles", "La función de protección incluye el registro de eventos; dicho registro debe evitar dejar datos personales o secretos en claro en los logs.", ("LOG-SENSITIVE", "DBG-ENABLED"), severity="medio"),
    Control("DS83-A6-ATRIBUTOS", "DS 83/2004", "Art. 6", "Proteger", "Atributos esenciales: confidencialidad e integridad del documento", "La seguridad del documento electrónico se logra garantizando confidencialidad, integridad, factibilidad de autenticación y disponibilidad; el cifrado debe ser correcto y la transmisión protegida.", ("CRY-ECB", "CRY-WEAK-HASH", "NET-CLEARTEXT", "NET-TRUST-ALL")),
    Control("DS83-A26-ANTIMALWARE-CIFRADO", "DS 83/2004", "Art. 26 letras a) y b)", "Detectar", "Antimalware y cifrado de la confidencialidad e integridad", "Los organismos deben instalar antivirus frente a software malicioso y proveer mecanismos de cifrado que protejan la confidencialidad e integridad de los documentos electrónicos.", ("DEP-MALWARE", "CRY-ECB", "CRY-WEAK-HASH")),
    Control("DS83-A28-ROBUSTEZ-CRED", "DS 83/2004", "Art. 28", "Proteger", "Gestión y robustez de identificadores (credenciales)", "La asignación de identificadores debe controlarse formalmente: no almacenarlos desprotegidos en un computador, no incluirlos en procesos de inicio de sesión automatizado (p. ej. embebidos), y exigir contraseñas robustas (≥8 caracteres, mezcla, no obvias).", ("SEC-PASSWORD", "SEC-API-KEY", "SEC-PRIVATE-KEY", "SEC-DB-URL")),
    Control("DS83-A29-CRED-TEXTO-CLARO", "DS 83/2004", "Art. 29", "Proteger", "No comunicar identificadores por canales en texto claro", "Debe evitarse el uso de mensajes no protegidos (texto en claro) para comunicar identificadores/credenciales.", ("NET-CLEARTEXT",), severity="medio"),
    Control("DS83-A31-ACCESO-NO-AUTORIZADO", "DS 83/2004", "Art. 31-32", "Proteger", "Reducción del riesgo de acceso no autorizado a sistemas y datos", "Deben promoverse buenas prácticas y controlarse el acceso a los sistemas informáticos; la concatenación de SQL o secretos embebidos facilitan el acceso no autorizado.", ("SQL-CONCAT", "SEC-API-KEY", "SEC-DB-URL", "PERM-DANGEROUS")),
    Control("DS83-A11-POLITICA", "DS 83/2004", "Art. 11-12", "Identificar", "Política de seguridad y encargado de seguridad", "Debe establecerse una política de seguridad documentada, revisada al menos cada 3 años, y designarse un encargado de seguridad.", (), (), False, "Política de seguridad vigente; resolución de designación del encargado de seguridad.", "bajo"),
    Control("D10-INTEGRIDAD-DOC", "Decreto 10/2023", "Norma Técnica de Documentos y Expedientes Electrónicos", "Proteger", "Integridad y protección de los documentos y datos del expediente", "La gestión de documentos y expedientes electrónicos debe preservar su integridad y la protección de los datos personales contenidos (Ley 19.628), evitando cifrado débil o exposición en logs.", ("CRY-WEAK-HASH", "CRY-ECB", "LOG-SENSITIVE", "PII-RUT"), (), True, "Mecanismos de firma/sellado de integridad del documento; metadatos de trazabilidad del expediente.", "medio"),
    Control("D11-LINEA-BASE", "Decreto 11/2023", "Art. 3-5", "Identificar", "Línea de base de calidad y mejora continua de la plataforma", "La plataforma debe incorporarse al catálogo con una línea de base de calidad y un Ciclo de Gestión de la Calidad; los defectos críticos/altos detectados deben gestionarse en un Plan de Mejora Continua antes de su promoción.", (), (), True, "Catálogo de plataformas; Plan de Mejora Continua; métricas de calidad del Ciclo de Gestión.", "medio"),
    Control("D11-LICENCIAMIENTO", "Decreto 11/2023", "Art. 4 (gestión de calidad) · concordante Guía SEGPRES §IX", "Identificar", "Trazabilidad y licenciamiento del software de la plataforma", "La gestión de calidad de la plataforma requiere trazabilidad de sus componentes y un marco de licenciamiento definido para el software del Estado.", ("LIC-MISSING",), severity="bajo"),
)
# Controls a scanner finding is traced to, by CWE.
CWE_CONTROLS = {
    "CWE-798": ("D7-A8-CONTROL-ACCESO", "DS83-A28-ROBUSTEZ-CRED", "DS83-A29-CRED-TEXTO-CLARO"),
    "CWE-259": ("D7-A8-CONTROL-ACCESO", "DS83-A29-CRED-TEXTO-CLARO"),
    "CWE-321": ("D7-A8-CONTROL-ACCESO",),
    "CWE-327": ("D9-A6-CIFRADO-FACTOR", "DS83-A26-ANTIMALWARE-CIFRADO"),
    "CWE-89": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-319": ("D9-A6-TLS", "D7-A8-PROTECCION-DATOS", "DS83-A6-ATRIBUTOS"),
    "CWE-295": ("D9-A6-TLS",),
    "CWE-749": ("D7-A8-PROTECCION-DATOS",),
    "CWE-532": ("D9-A13-TRAZABILIDAD", "D7-A8-REGISTRO-EVENTOS"),
    "CWE-78": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-22": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-79": ("D7-A8-PROTECCION-DATOS",),
    "CWE-94": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-95": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-502": ("DS83-A31-ACCESO-NO-AUTORIZADO",),
    "CWE-352": ("D7-A8-PROTECCION-DATOS",),
    "CWE-918": ("D9-A6-TLS", "D7-A8-PROTECCION-DATOS"),
    "CWE-1321": ("D7-A8-PROTECCION-DATOS",),
}
CONTROL_DDL = (
    "control_id string, instrument string, reference string, domain string, title string, demand string, "
    "violated_by array<string>, shown_by array<string>, assessable boolean, documents string, severity string"
)


def controls(spark: SparkSession, catalogue: tuple[Control, ...] = CONTROLS) -> DataFrame:
    rows = [
        (c.id, c.instrument, c.reference, c.domain, c.title, c.demand, list(c.violated_by), list(c.shown_by), c.assessable, c.documents, c.severity)
        for c in catalogue
    ]
    return spark.createDataFrame(rows, CONTROL_DDL)


def cwe_controls(spark: SparkSession) -> DataFrame:
    """J-17 as a dimension of fixed size."""
    return F.broadcast(spark.createDataFrame([(k, list(v)) for k, v in CWE_CONTROLS.items()], "cwe string, controls array<string>"))
