"""Rule catalogue of the source scan. Callers may extend it or pass their own rules (X-01)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A rule catalogue is read into the plan, so a table of rules is only accepted up to this size.


@dataclass(frozen=True)
class Rule:
    """One line pattern. Every match contains one of ``triggers`` (lower case), which is tested first."""

    id: str
    title: str
    category: str
    severity: str
    pattern: str | None
    triggers: tuple[str, ...]
    guide: str = ""
    legal: str = ""
    cwe: str | None = None
    mitigation: str = ""


# Severities and how grave each one is.
SEVERITY_RANK = {"crítico": 4, "alto": 3, "medio": 2, "bajo": 1, "info": 0}

# The rules, their patterns and their texts.
RULES = (
    Rule(
        "SEC-API-KEY",
        "Posible API key / token embebido en el código",
        "COMPARTIMENTAJE",
        "crítico",
        r"""(?:api[_-]?key|apikey|secret|token|client[_-]?secret|access[_-]?key)\s*[:=]\s*["'][A-Za-z0-9_\-]{16,}["']""",
        ("api", "secret", "token", "access"),
        "§14 Manejo de secretos: credenciales y llaves deben ir en variables de entorno, NUNCA en el control de "
        "versiones.",
        "Ley 21.459 Art. 2 (acceso ilícito) — un secreto filtrado facilita el acceso no autorizado a sistemas.",
        "CWE-798 (uso de credenciales embebidas)",
        "Mover el secreto a variables de entorno / gestor de secretos; rotar la credencial expuesta; excluir del "
        "repositorio (.gitignore).",
    ),
    Rule(
        "SEC-GOOGLE-KEY",
        "Google API key embebida",
        "COMPARTIMENTAJE",
        "alto",
        r"AIza[0-9A-Za-z_\-]{35}",
        ("aiza",),
        "§14 Manejo de secretos.",
        "Ley 19.628 (si la key da acceso a datos personales) · Ley 21.459 Art. 2.",
        "CWE-798",
        "Restringir la key por aplicación/SHA y paquete; moverla a configuración remota; rotarla.",
    ),
    Rule(
        "SEC-PRIVATE-KEY",
        "Llave privada / certificado en el repositorio",
        "COMPARTIMENTAJE",
        "crítico",
        r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
        ("private key-----",),
        "§14 Manejo de secretos: certificados y llaves no deben versionarse.",
        "Ley 21.459 Art. 2 y 7 (interceptación/acceso); Ley 19.628 si protege datos.",
        "CWE-321 (clave criptográfica embebida)",
        "Eliminar del repositorio e historial; rotar la llave; almacenar en KMS/HSM o variable de entorno.",
    ),
    Rule(
        "SEC-PASSWORD",
        "Contraseña en texto plano en el código",
        "COMPARTIMENTAJE",
        "alto",
        r"""(?:password|passwd|pwd|contrasena|clave)\s*[:=]\s*["'][^"'\s]{4,}["']""",
        ("password", "passwd", "pwd", "contrasena", "clave"),
        "§14 Manejo de secretos; §19 Seeding (credenciales fuera del versionado).",
        "Ley 19.628 (seguridad de datos); Ley 21.459 Art. 2.",
        "CWE-259 (contraseña embebida)",
        "Externalizar a variables de entorno; nunca hardcodear credenciales.",
    ),
    Rule(
        "SEC-DB-URL",
        "Cadena de conexión con credenciales",
        "COMPARTIMENTAJE",
        "alto",
        r"""(?:jdbc:|mongodb(?:\+srv)?://|postgres(?:ql)?://|mysql://)[^\s"']*:[^\s"'@]+@""",
        ("jdbc:", "mongodb", "postgres", "mysql:"),
        "§14 Manejo de secretos.",
        "Ley 19.628; Ley 21.459 Art. 2.",
        "CWE-798",
        "Parametrizar el connection string; credenciales por entorno.",
    ),
    Rule(
        "CRY-WEAK-HASH",
        "Hash débil para datos sensibles (MD5/SHA-1)",
        "DATOS_SENSIBLES",
        "medio",
        r"""(?:MessageDigest\.getInstance\(\s*["'](?:MD5|SHA-1)["']|\bMD5\b|hashlib\.(?:md5|sha1)\()""",
        ("md5", "sha-1", "sha1"),
        "§5 Para almacenar contraseñas usar bcrypt/PBKDF2/Argon2; evitar MD5/SHA-1/SHA-2 'a secas'.",
        "Ley 19.628 (deber de seguridad sobre datos personales).",
        "CWE-327 (algoritmo criptográfico débil)",
        "Usar bcrypt/PBKDF2/Argon2 para contraseñas; SHA-256+ con sal donde aplique.",
    ),
    Rule(
        "CRY-ECB",
        "Cifrado en modo ECB (inseguro)",
        "DATOS_SENSIBLES",
        "alto",
        r"""Cipher\.getInstance\(\s*["'][A-Z]+/ECB""",
        ("/ecb",),
        "§13 Datos en reposo: proteger con cifrado correcto.",
        "Ley 19.628.",
        "CWE-327",
        "Usar AES-GCM (modo autenticado) con IV aleatorio por mensaje.",
    ),
    Rule(
        "NET-CLEARTEXT",
        "Tráfico en texto claro (HTTP) permitido",
        "DATOS_SENSIBLES",
        "alto",
        r"""(?:cleartextTrafficPermitted\s*=\s*"true"|usesCleartextTraffic\s*=\s*"true"|"""
        r"""http://(?!localhost|127\.0\.0\.1|schemas\.android))""",
        ("cleartext", "http://"),
        "§12 Datos en tránsito: siempre TLS (idealmente 1.3).",
        "Ley 19.628 (datos en tránsito); Ley 21.459 Art. 7 (interceptación).",
        "CWE-319 (transmisión en texto claro de datos sensibles)",
        "Forzar HTTPS/TLS; android:usesCleartextTraffic=false; network-security-config restrictivo.",
    ),
    Rule(
        "NET-TRUST-ALL",
        "Validación TLS deshabilitada (acepta cualquier certificado)",
        "DATOS_SENSIBLES",
        "crítico",
        r"(?:TrustAllCerts|ALLOW_ALL_HOSTNAME_VERIFIER|checkServerTrusted\s*\([^)]*\)\s*\{\s*\}|"
        r"HostnameVerifier[^;]*return\s+true)",
        ("trustallcerts", "allow_all_hostname", "checkservertrusted", "hostnameverifier"),
        "§12 Datos en tránsito: configurar el cifrado más fuerte; validar certificados.",
        "Ley 21.459 Art. 7 (interceptación de datos); Ley 19.628.",
        "CWE-295 (validación incorrecta de certificado)",
        "No deshabilitar la validación TLS; usar certificate pinning si corresponde.",
    ),
    Rule(
        "DBG-ENABLED",
        "Modo debug habilitado",
        "NORMATIVO",
        "medio",
        r"""(?:android:debuggable\s*=\s*"true"|DEBUG\s*=\s*[Tt]rue|debug\s*:\s*true)""",
        ("debug",),
        "§21 Manejo seguro de errores: desactivar el modo debug al pasar a producción.",
        "Ley 19.628 (exposición de datos por trazas/depuración).",
        "CWE-489 (código de depuración activo)",
        "Desactivar debug en builds de producción (release).",
    ),
    Rule(
        "LOG-SENSITIVE",
        "Posible registro (log) de información sensible",
        "DATOS_SENSIBLES",
        "medio",
        r"(?:Log\.[dvwie]|console\.log|print(?:ln)?|System\.out\.print)\s*\([^)]*"
        r"(?:password|token|secret|rut|email|tarjeta|card|cvv|pin)\b",
        ("log", "print"),
        "§20 Logs: nunca registrar información sensible en los logs.",
        "Ley 19.628 (tratamiento y seguridad de datos personales).",
        "CWE-532 (inserción de información sensible en logs)",
        "Eliminar/ofuscar datos sensibles de los logs; usar niveles de log adecuados.",
    ),
    Rule(
        "PII-RUT",
        "Tratamiento de RUT (dato personal identificador)",
        "LEGAL",
        "info",
        r"\b(?:rut|run)\b",
        ("rut", "run"),
        "§11 Identificación de datos: los datos sensibles deben identificarse y protegerse.",
        "Ley 19.628 Art. 4 (consentimiento) y Art. 11 (seguridad). El RUT es dato personal.",
        "CWE-359 (exposición de información personal privada)",
        "Verificar base de licitud, finalidad informada y cifrado en reposo/tránsito del RUT.",
    ),
    Rule(
        "PERM-DANGEROUS",
        "Permiso Android sensible declarado",
        "DATOS_SENSIBLES",
        "medio",
        r"android\.permission\.(?:ACCESS_FINE_LOCATION|ACCESS_BACKGROUND_LOCATION|READ_CONTACTS|READ_SMS|RECORD_AUDIO|"
        r"CAMERA|READ_PHONE_STATE|READ_EXTERNAL_STORAGE|READ_CALL_LOG|BODY_SENSORS)",
        ("android.permission.",),
        "§11 Identificación de datos; principio de minimización.",
        "Ley 19.628 Art. 4 y 9 (finalidad y proporcionalidad del tratamiento).",
        "CWE-250 (ejecución con privilegios innecesarios)",
        "Aplicar minimización: declarar solo permisos imprescindibles para la finalidad; justificar cada uno y "
        "solicitarlos en tiempo de ejecución.",
    ),
    Rule(
        "SQL-CONCAT",
        "Posible SQL construido por concatenación (riesgo de inyección)",
        "NORMATIVO",
        "alto",
        r"""(?:rawQuery|execSQL|executeQuery|db\.query)\s*\([^)]*\+[^)]*|"""
        r"""["'](?:SELECT|INSERT|UPDATE|DELETE)\b[^"']*["']\s*\+""",
        ("query", "execsql", "select", "insert", "update", "delete"),
        "§2 Consultas seguras: usar ORM probado o prepared statements; no concatenar SQL.",
        "Ley 21.459 Art. 1 y 4 (acceso/alteración indebida vía inyección); Ley 19.628.",
        "CWE-89 (inyección SQL)",
        "Usar consultas parametrizadas / prepared statements / ORM.",
    ),
    Rule(
        "WEB-JS-BRIDGE",
        "WebView con JavaScript o bridge nativo habilitado",
        "DATOS_SENSIBLES",
        "medio",
        r"(?:setJavaScriptEnabled\s*\(\s*true\s*\)|addJavascriptInterface\s*\(|setAllowFileAccess\s*\(\s*true\s*\)|"
        r"setAllowUniversalAccessFromFileURLs\s*\(\s*true\s*\))",
        ("javascript", "setallow"),
        "§2 Consultas seguras / §13 datos: limitar la superficie de ejecución de contenido remoto.",
        "Ley 21.459 Art. 1 (afectación de integridad del sistema vía contenido remoto).",
        "CWE-749 (método peligroso expuesto) / CWE-79",
        "Deshabilitar JavaScript salvo necesidad; no exponer interfaces nativas a contenido no confiable; restringir "
        "acceso a archivos.",
    ),
    Rule(
        "DATA-BACKUP-ON",
        "Copia de seguridad de la app habilitada (allowBackup)",
        "DATOS_SENSIBLES",
        "medio",
        r"""android:allowBackup\s*=\s*"true\"""",
        ("allowbackup",),
        "§13 Datos en reposo: evitar respaldos no controlados que extraigan datos del sandbox.",
        "Ley 19.628 (seguridad del dato personal en reposo).",
        "CWE-530 (exposición de datos por respaldo)",
        "Establecer android:allowBackup=false o definir reglas de respaldo que excluyan datos sensibles.",
    ),
    Rule(
        "COMP-EXPORTED",
        "Componente Android exportado sin protección",
        "DATOS_SENSIBLES",
        "medio",
        r"""android:exported\s*=\s*"true\"""",
        ("android:exported",),
        "§2 Consultas seguras / minimización de superficie expuesta.",
        "Ley 21.459 Art. 2 (acceso ilícito a componentes expuestos).",
        "CWE-926 (exportación indebida de componentes)",
        "Exportar solo lo imprescindible; proteger con permisos de firma; validar el origen de los Intents recibidos.",
    ),
    Rule(
        "LIC-MISSING",
        "Sin archivo de licencia (LICENSE/COPYING)",
        "LEGAL",
        "bajo",
        None,
        (),
        "§IX Licencias: todo desarrollo del Estado debe estar licenciado (LICENSE/COPYING).",
        "Marco de software público del Estado (Guía SEGPRES §IX).",
        None,
        "Agregar archivo LICENSE con el texto íntegro de la licencia (p. ej. GPLv3).",
    ),
)

# Rules that look for a pattern and may exclude some of its matches, by language.
LANGUAGE_RULES = (
    (
        "secreto-embebido-generico",
        None,
        r"""(?i)(api[_-]?key|secret|token|passwd|password|client[_-]?secret)\s*[:=]\s*["'][A-Za-z0-9_\-\.\/+]{16,}["']""",
        r"(?i)(your|example|sample|placeholder|changeme|xxxx|dummy|fake|test|<.*>|\{\{)",
        "ERROR",
        "CWE-798",
    ),
    ("aws-access-key", None, r"\b(AKIA|ASIA)[0-9A-Z]{16}\b", None, "ERROR", "CWE-798"),
    (
        "hash-debil-md5-sha1",
        ("java", "kotlin"),
        r"""MessageDigest\.getInstance\(\s*"(MD5|SHA-1|SHA1)"\s*\)""",
        None,
        "WARNING",
        "CWE-327",
    ),
    ("cifrado-ecb", ("java", "kotlin"), r"""Cipher\.getInstance\(\s*"[^"]*ECB[^"]*"\s*\)""", None, "WARNING", "CWE-327"),
    (
        "trust-all-certs",
        ("java", "kotlin"),
        r"(checkServerTrusted\s*\([^)]*\)\s*\{\s*\}|TrustManager\[\]\s*\{|ALLOW_ALL_HOSTNAME_VERIFIER|"
        r"HostnameVerifier\s*\{\s*return\s+true)",
        None,
        "ERROR",
        "CWE-295",
    ),
    (
        "sql-concatenado",
        ("java", "kotlin"),
        r"""(rawQuery|execSQL|createStatement\(\)\.execute\w*|\.query)\s*\(\s*"[^"]*"\s*\+""",
        None,
        "ERROR",
        "CWE-89",
    ),
    (
        "webview-javascript",
        ("java", "kotlin"),
        r"(setJavaScriptEnabled\s*\(\s*true\s*\)|addJavascriptInterface\s*\()",
        None,
        "WARNING",
        "CWE-749",
    ),
    ("js-eval-peligroso", ("javascript", "typescript"), r"\beval\s*\(|new\s+Function\s*\(", None, "WARNING", "CWE-95"),
    ("js-innerhtml", ("javascript", "typescript"), r"\.innerHTML\s*=", None, "WARNING", "CWE-79"),
    (
        "py-subprocess-shell",
        ("python",),
        r"subprocess\.(run|call|Popen|check_output)\([^)]*shell\s*=\s*True",
        None,
        "WARNING",
        "CWE-78",
    ),
)

RULE_DDL = (
    "rule_id string, title string, category string, severity string, guide string, legal string, cwe string, "
    "mitigation string"
)


def rule_texts(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rules as a dimension. It holds one row per rule of the plan, so it may be broadcast."""
    rows = [(r.id, r.title, r.category, r.severity, r.guide, r.legal, r.cwe, r.mitigation) for r in rules]
    return F.broadcast(spark.createDataFrame(rows, RULE_DDL))


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The line rules as a table, as callers may keep their own: the texts, ``pattern`` and ``triggers``."""
    rows = [(r.id, r.title, r.category, r.severity, r.guide, r.legal, r.cwe, r.mitigation, r.pattern, list(r.triggers)) for r in rules if r.pattern]
    return spark.createDataFrame(rows, RULE_DDL + ", pattern string, triggers array<string>")
