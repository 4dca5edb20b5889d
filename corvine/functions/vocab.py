"""Word lists, patterns and thresholds that results depend on, in one place."""

# --- lexical index -----------------------------------------------------------------------------
TOKEN = "[a-zA-Z0-9áéíóúÁÉÍÓÚñÑ]+(?:-[a-zA-Z0-9áéíóúÁÉÍÓÚñÑ]+)*"
STOPWORDS = (
    "de la el en es para por que un una los las del al con se lo como su sus cual cuál qué sobre entre este esta "
    "estos estas son fue era ha han hay tiene tienen ser estar hacer año años"
).split()
K1, B = 1.5, 0.75

# --- routing -------------------------------------------------------------------------------------
IDENTIFIERS = [
    r"\bCNT-\d{4}-[A-Z]{3}-\d{3}\b",
    r"\bINC-\d{4}-\d{3}\b",
    r"\bEP\d{7}\b",
    r"\bCIF\s+[A-Z]-\d{8}\b",
    r"\b(?:ISO-\d{5}(?::\d{4})?)\b",
    r"\b(?:SOC\s+2(?:\s+Type\s+II)?)\b",
    r"\bENS\b",
    r"\bLIC-\d{4}-[A-Z0-9-]+\b",
]
RELATIONAL = [
    "relación entre", "relacion entre", "cómo se conecta", "como se conecta", "a través de", "a traves de",
    "quién depende de", "quien depende de", "cadena de mando", "organigrama completo", "impacto cruzado",
    "camino entre", "ruta entre", "dependencia jerárquica", "dependencia jerarquica", "intervinieron en",
    "participaron en la resolución", "compara los contratos", "comparar",
]
GLOBAL = [
    "en común", "en comun", "tienen en común", "tienen en comun", "de qué tratan", "de que tratan", "de qué habla",
    "de que habla", "resumen de los documentos", "resumen de los apuntes", "resumen general", "resumen del corpus",
    "visión general", "vision general", "documentos subidos", "archivos subidos", "apuntes subidos", "qué documentos",
    "que documentos", "qué archivos", "que archivos", "qué información hay", "que informacion hay", "qué contenido hay",
    "que contenido hay", "temas principales", "temática principal", "tematica principal", "comparativa de documentos",
    "similitudes entre los documentos",
]
FACTUAL = [
    "cu[aá]l es el precio", "cu[aá]nto cuesta", "cu[aá]l es el sla", "cu[aá]ntas consultas", "d[oó]nde est[aá] la sede",
    "qui[eé]n es el ceo", "cu[aá]l es el cif", "qu[eé] capital social", "qu[eé] penalizaci[oó]n", "qu[eé] valor anual",
    "cu[aá]l es la duraci[oó]n",
]
LOOKUP_STOP = "para como cual donde cuando quien sobre entre este esta estos estas cuales precio cuanto cuesta".split()
EXACT_CODE = r"\b(cnt-\d+|inc-\d+|cif\s+[a-z0-9-]+|iso-\d+|soc\s+2)\b"

# --- evidence ------------------------------------------------------------------------------------
ABSTENTION = [
    "no consta", "no se dispone", "no existe registro", "no se encuentra", "no contiene", "no aparece en la documentación",
    "no hay información", "no está especificad", "no se especifica", "no está documentad", "no figura en",
]
STRONG_RERANK, WEAK_RERANK, GRAY_RERANK = 0.5, 0.05, 0.0005
STRONG_BM25, STRONG_VECTOR, WEAK_VECTOR = 4.5, 0.6, 0.3
A, B_LEVEL, C, D = "LEVEL_A_SUFFICIENT", "LEVEL_B_PARTIAL", "LEVEL_C_RELATED_INSUFFICIENT", "LEVEL_D_NO_EVIDENCE"

# --- guards --------------------------------------------------------------------------------------
INJECTION = [
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"ignor[a-e]\s+(todas\s+las\s+)?instrucciones\s+(anteriores|previas)",
    r"you\s+are\s+now\s+in\s+dan\s+mode",
    r"bypass\s+safety\s+filter",
    r"revela\s+(el\s+)?system\s+prompt",
    r"reveal\s+your\s+system\s+prompt",
    r"drop\s+table",
    r"delete\s+from",
]
REDACTIONS = [
    (r"sk-or-v1-[a-zA-Z0-9]{40,}", "[REDACTED_API_KEY]"),
    (r"sk-[a-zA-Z0-9_-]{32,}", "[REDACTED_API_KEY]"),
    (r"lsv2_[a-zA-Z0-9_-]{30,}", "[REDACTED_LANGSMITH_KEY]"),
    (r"\b(?:\d[ -]*?){13,16}\b", "[REDACTED_CARD]"),
]
TENANT = r"^[a-zA-Z0-9][a-zA-Z0-9_.-]{0,62}$"
DEFAULT_TENANT = "default"
UNKNOWN_ORIGIN = "(origen desconocido)"
CACHE_SIMILARITY = 0.92
ROLES = ["public", "standard", "confidential", "admin"]

# --- entities ------------------------------------------------------------------------------------
TYPES = [
    ("person", "Person"), ("persona", "Person"), ("people", "Person"), ("empleado", "Person"), ("employee", "Person"),
    ("organization", "Organization"), ("organisation", "Organization"), ("organizacion", "Organization"), ("company", "Organization"),
    ("empresa", "Organization"), ("cliente", "Organization"), ("customer", "Organization"), ("vendor", "Organization"), ("proveedor", "Organization"),
    ("product", "Product"), ("producto", "Product"), ("service", "Service"), ("servicio", "Service"), ("project", "Project"), ("proyecto", "Project"),
    ("technology", "Technology"), ("tecnologia", "Technology"), ("system", "Technology"), ("sistema", "Technology"),
    ("policy", "Policy"), ("politica", "Policy"), ("regulation", "Policy"), ("normativa", "Policy"), ("law", "Policy"),
    ("contract", "Contract"), ("contrato", "Contract"), ("agreement", "Contract"), ("acuerdo", "Contract"),
    ("incident", "Incident"), ("incidente", "Incident"), ("incidencia", "Incident"),
    ("location", "Location"), ("lugar", "Location"), ("facility", "Location"), ("instalacion", "Location"),
    ("document", "Document"), ("documento", "Document"), ("report", "Document"), ("informe", "Document"),
    ("role", "Role"), ("rol", "Role"), ("cargo", "Role"), ("event", "Event"), ("evento", "Event"),
    ("certification", "Certification"), ("certificacion", "Certification"), ("standard", "Certification"), ("norma", "Certification"),
    ("plan", "Plan"), ("programa", "Program"), ("program", "Program"), ("initiative", "Program"), ("iniciativa", "Program"),
    ("framework", "Policy"), ("act", "Policy"), ("ley", "Policy"),
]
GENERIC = (
    "el la los las un una de del y o en para por con a empleado empleados cliente clientes usuario usuarios persona personas "
    "dato datos informe informes reporte reportes documento documentos sistema sistemas servicio servicios producto productos "
    "proyecto proyectos empresa empresas equipo equipos gerente director jefe responsable auditoria auditorias externa externo "
    "interna interno general generales seguridad calidad gestion proceso procesos area areas nivel niveles politica politicas "
    "norma normas objetivo objetivos riesgo riesgos instalacion instalaciones sede oficina departamento personal plantilla "
    "the and or of for with in to an employee employees customer customers user users person people data report reports document "
    "documents system systems service services product products project projects company companies team teams manager head staff "
    "direct tier level levels audit audits external internal security quality process processes policy policies risk risks "
    "objective objectives sector sectors facility facilities office department government military corporate committee comite "
    "vendor vendors proveedores departments departamentos retention retencion training capacitacion testing pruebas annual anual "
    "diversity diversidad equity equidad inclusion resources recursos human humanos management direccion board consejo meeting "
    "reunion budget presupuesto revenue ingresos compliance cumplimiento"
).split()
BLOCKED = "roi kpi kpis sla slas tco ebitda capex opex n/a na tbd etc otros others varios misc unknown desconocido ninguno none".split()
SUFFIXES = (
    "global llc inc corp corporation ltd limited gmbh sa sl slu sau s.a s.l s.a. s.l. group grupo holding holdings iberia "
    "international solutions labs technologies systems company co"
).split()
INVERSE = {
    "MANAGES": "MANAGED_BY", "LEADS": "LED_BY", "DIRECTS": "DIRECTED_BY", "AUDITS": "AUDITED_BY", "CERTIFIES": "CERTIFIED_BY",
    "FINANCES": "FINANCED_BY", "FUNDS": "FINANCED_BY", "SUPPLIES": "SUPPLIED_BY", "PROVIDES": "PROVIDED_BY", "PRODUCES": "PRODUCED_BY",
    "MANUFACTURES": "PRODUCED_BY", "OWNS": "OWNED_BY", "OPERATES": "OPERATED_BY", "EMPLOYS": "EMPLOYED_BY", "RESOLVES": "RESOLVED_BY",
    "CONTAINS": "PART_OF", "INCLUDES": "PART_OF", "USED_BY": "USES",
}
TARGETS = {
    "HAS_CERTIFICATION": ["Certification"], "CERTIFIED_BY": ["Organization", "Person"], "AUDITED_BY": ["Organization", "Person"],
    "MANAGED_BY": ["Person"], "LED_BY": ["Person"], "DIRECTED_BY": ["Person"], "FOUNDED_BY": ["Person"], "HAS_CEO": ["Person"],
    "HAS_MANAGER": ["Person"], "HAS_DIRECTOR": ["Person"], "RESOLVED_BY": ["Organization", "Person"], "FINANCED_BY": ["Organization"],
    "SUPPLIED_BY": ["Organization"], "PROVIDED_BY": ["Organization"], "PRODUCED_BY": ["Organization"], "OWNED_BY": ["Organization", "Person"],
    "OPERATED_BY": ["Organization", "Person"], "EMPLOYED_BY": ["Organization"], "WORKS_AT": ["Organization"], "WORKS_FOR": ["Organization"],
    "LOCATED_IN": ["Location"], "BASED_IN": ["Location"], "HAS_CONTRACT": ["Contract"], "HAS_INCIDENT": ["Incident"],
    "USES": ["Technology", "Product", "Service"],
}
UNIFIED = {
    ("SIGNED_WITH", "Contract"): "HAS_CONTRACT",
    ("PARTY_TO", "Contract"): "HAS_CONTRACT",
    ("AFFECTED_BY", "Incident"): "HAS_INCIDENT",
    ("REPORTED_IN", "Incident"): "HAS_INCIDENT",
}
FUZZY = 92.0

# --- drawing -------------------------------------------------------------------------------------
COLORS = {
    "Person": "#d9b382", "Organization": "#4d9e84", "Product": "#7fa8c9", "Service": "#9bb36a", "Project": "#c98d6b",
    "Technology": "#6fa5a0", "Policy": "#a58fb0", "Contract": "#c9a227", "Incident": "#c4736b", "Location": "#8fa8b8",
    "Document": "#b9bdb6", "Role": "#b59b7c", "Event": "#a89bb8", "Certification": "#7fb39b", "Program": "#9aa98c", "Plan": "#9aa98c",
}
DEFAULT_COLOR = "#8a929b"

# Patterns of source tags and the kinds they are shown as.
PASSAGE_TAG = r"^DocRRF\[[^\]]*\]:(.+)$"
PATH_TAG = r"^Neo4jPath:(.+)$"
NODE_TAG = r"^Neo4j:([^:]+):(.+)$"
PATH_STEP = r"-\[:([A-Z0-9_]+)\]->"
PASSAGE_KIND = "documento"
PATH_KIND = "relación"
NODE_KIND = "entidad"

# What a language model gets to rerank, and the score of a candidate it leaves out.
MODEL_POOL = 6
MODEL_CHARS = 350
MODEL_MISSING = 0.30

#: What a second attempt adds to a question where no model proposes other ones.
FOLLOW_UPS = ["detalles", "especificacion"]
