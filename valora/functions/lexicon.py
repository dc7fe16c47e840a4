"""Word lists, patterns and labels that results depend on.

Everything here is data that must keep these exact values; the logic that uses it lives in
the modules next to it.
"""

# Presentation badge removed before classification.
BADGE = r"\bmas\s+popular\b"

# Legal suffixes, acronyms and names with a set spelling.
LEGAL_SUFFIXES = (
    r"\bS\.?\s*A\.?\s*S\.?\b",
    r"\bS\.?\s*R\.?\s*L\.?\b",
    r"\bS\.?\s*A\.?\b",
    r"\bSRL\b",
    r"\bSAS\b",
    r"\bSA\b",
)
ACRONYMS = ("IT",)
NAME_EXCEPTIONS = (("informatica", "Informatica"), ("alvarez", "Alvarez"))

# Place aliases.
PROVINCE_ALIASES = (
    ("cordoba", "Córdoba"),
    ("córdoba", "Córdoba"),
    ("cordoba capital", "Córdoba"),
)
CITY_ALIASES = (
    ("cba", "Córdoba"),
    ("cba.", "Córdoba"),
    ("cordoba", "Córdoba"),
    ("córdoba", "Córdoba"),
    ("ciudad de cordoba", "Córdoba"),
    ("ciudad de córdoba", "Córdoba"),
)

# Service catalog (id, display name, synonyms), first hit wins.
UNKNOWN_SERVICE = "DESCONOCIDO"
SERVICE_CATALOG = (
    (
        "malware",
        "Eliminación de Malware y Virus",
        (
            "malware",
            "virus",
            "spyware",
            "desinfeccion",
            "limpieza de virus",
            "remocion de virus",
            "antivirus",
            "remocion de malware",
        ),
    ),
    (
        "formateo",
        "Formateo e instalación de SO",
        ("formateo", "instalación de so", "instalacion de so", "windows 11"),
    ),
    (
        "mantenimiento",
        "Mantenimiento preventivo",
        ("mantenimiento", "limpieza física", "limpieza fisica"),
    ),
    ("soporte_redes", "Diagnóstico y soporte de redes", ("soporte de redes", "redes", "router")),
    (
        "soporte_tecnico",
        "Soporte Técnico Informático",
        (
            "soporte",
            "mantenimiento pc",
            "reparacion de pc",
            "asistencia tecnica",
            "mesa de ayuda",
            "helpdesk",
        ),
    ),
)

# Cadence and commercial context of an offer text.
OFFER_CADENCE = (
    (
        "PER_HOUR",
        (
            r"\bx\s*1\s*(?:hs?|hora)\b",
            r"\bpor\s+hora\b",
            r"\bla\s+hora\b",
            r"\bhora\s+(?:inicial|adicional|servicio|tecnica|tecnico)\b",
            r"\bhora(?:s)?\s+de\s+(?:servicio|soporte|trabajo)\b",
        ),
    ),
    (
        "PER_MONTH",
        (r"\bpor\s+mes\b", r"\bal\s+mes\b", r"\bmensual(?:mente)?\b", r"\babono\s+mensual\b"),
    ),
    ("PER_VISIT", (r"\bpor\s+visita\b", r"\bcada\s+visita\b")),
    (
        "PER_UNIT",
        (
            r"\bpor\s+(?:equipo|unidad|pc|notebook|camara)\b",
            r"\bcada\s+\d+(?:[.,]\d+)?\s*(?:gb|tb)\b",
        ),
    ),
)
URGENCY = (
    r"\burgenc(?:ia|ias)\b",
    r"\bfuera\s+de\s+horario\b",
    r"\bfin(?:es)?\s+de\s+semana\b",
    r"\bferiado(?:s)?\b",
)
# Cadence asked for in a question (narrower than the offer table).
QUESTION_CADENCE = (
    ("PER_HOUR", (r"\bpor\s+hora\b", r"\bla\s+hora\b")),
    ("PER_MONTH", (r"\bpor\s+mes\b", r"\bal\s+mes\b", r"\bmensual(?:mente)?\b")),
    ("PER_VISIT", (r"\bpor\s+visita\b", r"\bcada\s+visita\b")),
    ("PER_UNIT", (r"\bpor\s+(?:equipo|unidad|pc|notebook)\b",)),
)
# Cadence attached to the price mention itself.
MENTION_CADENCE = (
    ("PER_HOUR", (r"\bpor hora\b", r"\bla hora\b")),
    ("PER_MONTH", (r"\bpor mes\b", r"\bal mes\b", r"\bmensual\b")),
    ("PER_VISIT", (r"\bpor visita\b",)),
    ("PER_UNIT", (r"\bpor (?:equipo|unidad|pc)\b",)),
)

# Price literals.
EXACT_LITERAL = (
    r"^\s*(?:(?:AR\$|ARS|US\$|USD|U\$S|\$)\s*)?\d+(?:[.,]\d+)*"
    r"\s*(?:(?:ARS|USD))?(?:\s*(?:/|X)\s*MES)?\s*$"
)
SHORT_LITERAL = r"^\s*\$\s*\d{1,3}(?:\s*[\-–]\s*\d{1,3}K)?\s*$"
WEB_AMOUNT = r"\d{1,3}(?:[.,]\d{3})+(?:,\d{2})?|\d+(?:,\d{2})?"
THOUSANDS = r"\d{1,3}(?:\.\d{3})+"
CONSULT = r"consultar|cotizar|presupuesto|a convenir"

# Evidence wording of a classified price literal, per reading mode.
CATALOG_PRICE_EVIDENCE = (
    ("absent", "No existe literal de precio."),
    ("exact", "Literal completo con separador de miles explícito."),
    ("from", "El número es un límite inferior; no es un precio final exacto."),
    ("range", "La fuente publica un rango; no existe un único precio exacto."),
    ("consult", "La fuente exige consulta y no publica un valor numérico."),
    ("ambiguous", "El literal no explicita por sí solo si el valor está expresado en miles."),
    ("other", "El literal no coincide con un formato de precio seguro conocido."),
)
PRODUCT_PRICE_EVIDENCE = (
    ("ausencia", "La fuente no publica un literal de precio."),
    ("desde", "El literal expresa un limite inferior, no un precio exacto."),
    ("rango", "El literal expresa mas de un valor posible."),
    ("consultar", "La fuente exige consulta y no publica un valor numerico."),
    (
        "cero",
        "El HTML publica cero literalmente; no demuestra gratuidad y "
        "el dominio no admite observaciones de precio cero.",
    ),
    ("ambiguo", "El literal no explicita si el valor esta expresado en miles."),
    ("exacto", "El literal contiene un unico valor numerico representable."),
)

# Hardware evidence in an observation text.
HARDWARE_SIGNALS = (
    r"\bryzen\s+\d",
    r"\b(?:rtx|gtx|rx)\s*\d{3,4}\b",
    r"\b(?:ddr\d|ram)\b",
    r"\b(?:ssd|nvme)\s*\d+\s*(?:gb|tb)\b",
    r"\bcpu\b",
    r"\bgpu\b",
)
OS_INSTALL = r"\b(?:instalacion|instalar)\b.*\b(?:sistema operativo|windows|so)\b"
COMPUTER = r"\b(?:pc|notebook|equipo)\b"
NO_BOOT = r"\bno\s+inicia\b|\bno\s+arranca\b"
NO_POWER = r"\bno\s+enciende\b"
DISK_CHANGE = r"\b(?:cambio|cambiar|reemplazo)\b.*\bdisco\b"
CLONING = r"\bclon(?:ado|acion|ar)\b"

# Price-context meaning.
PRICE_CONTEXT_KINDS = (
    ("TICKET_TIER", (r"\bticket\b",)),
    ("PRICE_CHANGE", (r"precio original|precio actual",)),
    ("ADDITIONAL_CHARGE", (r"\badicional\b|\bextras?\b",)),
    ("PAYMENT_DISCOUNT", (r"\boff\b|\bdescuento\b",)),
    ("PAYMENT_SPECIFIC_PRICE", (r"precio especial transferencia",)),
    ("QUANTITY_PRICE_TABLE", (r"precios? por cantidad|equipos?:",)),
    ("TURNAROUND_TIME", (r"\b\d+\s*hs\b|\bdemora\b",)),
)
PRICE_CONTEXT_CADENCE = (
    ("PER_HOUR", (r"\bpor hora\b|\bhora\b(?!s\b)",)),
    ("PER_MONTH", (r"\bpor mes\b|\bmensual\b|\bmes\b",)),
    ("PER_VISIT", (r"\bpor visita\b|\bvisita\b",)),
    ("PER_UNIT", (r"\bpor unidad\b|\bpor equipo\b|\bpor cantidad\b",)),
)
CURRENCY_MARKERS = (
    ("USD", (r"\bu\$s\b|\busd\b|\bdolares\b",)),
    ("ARS", (r"(?<!u)\$|\bars\b|\bpesos\b",)),
)

# Scope meaning.
CAPACITY_BAND = r"\bhasta\s+(\d+(?:[.,]\d+)?)\s*(gb|tb)\b"
DELIVERY_MODES = (("FREELANCE", (r"\bfreelance\b",)), ("WORKSHOP", (r"\btaller\b",)))
SCOPE_DEVICES = (
    ("NOTEBOOK", (r"\bnotebook\b|\blaptop\b",)),
    ("AIO", (r"\baio\b|all[\s-]?in[\s-]?one",)),
    ("PC", (r"\bpc\b|\bcomputadora\b",)),
)
MID_HIGH_TIER = r"\bgama media/alta\b|\bgama media alta\b"
MID_TIER = r"\bgama media\b"
SCOPE_TIERS = (
    ("BASIC", (r"\bbasica\b|\bbasico\b",)),
    ("GAMER", (r"\bgamer\b",)),
    ("STANDARD", (r"\bestandar\b",)),
    ("LEGACY", (r"\bantigua\b",)),
    ("INTEGRATED", (r"\bintegrados?\b",)),
    ("PRO", (r"\bpro\b",)),
    ("PREMIUM", (r"\bultra\b|\bpremium\b",)),
)

# Hardware meaning.
SERVICE_VERBS = (
    r"\b(?:cambio|cambiar|reemplazo|reemplazar|instalacion|instalar|"
    r"reparacion|reparar|upgrade|ampliacion)\b"
)
HARDWARE_FAMILIES = (
    (
        "CPU",
        (r"\b(?:cpu|procesador|ryzen(?:\s+[3579])?|core\s+i[3579]|i[3579]\s*\d{3,5})\b",),
    ),
    (
        "GPU",
        (
            r"\b(?:gpu|placa(?:s)? de video|rtx\s*\d{3,4}|gtx\s*\d{3,4}|"
            r"rx\s*\d{3,4}|6700xt|1660(?:\s+ti|\s+super)?)\b",
        ),
    ),
    ("MEMORY", (r"\b(?:ram|memoria ram|ddr[345])\b",)),
    (
        "STORAGE",
        (r"\b(?:ssd|nvme|hdd|m\.?2|storage|disco|disco rigido|disco duro)\b",),
    ),
    ("PSU", (r"\b(?:fuente|psu)\b",)),
    ("NOTEBOOK", (r"\b(?:notebook|laptop)\b",)),
)
HARDWARE_BRANDS = (
    "AMD",
    "INTEL",
    "NVIDIA",
    "ASROCK",
    "ASUS",
    "MSI",
    "GIGABYTE",
    "EVGA",
    "ZOTAC",
    "XFX",
    "KINGSTON",
    "CORSAIR",
    "SEAGATE",
)
HARDWARE_VARIANTS = (
    ("GAMING", (r"\bgamer\b|\bgaming\b",)),
    ("TI", (r"\bti\b",)),
    ("SUPER", (r"\bsuper\b",)),
    ("OC", (r"\boc\b",)),
    ("ULTRA", (r"\bultra\b",)),
    ("ENTRY", (r"\bentrada\b",)),
    ("MID", (r"\bmedia\b",)),
    ("HIGH", (r"\balta\b",)),
)
HARDWARE_SPECS = (
    r"\b\d+(?:[.,]\d+)?\s*gb\b",
    r"\b\d+(?:[.,]\d+)?\s*tb\b",
    r"\bddr[345]\b",
    r"\b\d+\s*w\b",
)

# Text that names no object.
NON_OBJECT_KINDS = (
    ("PRICE_LABEL", r"^precio\s*:?$", ("PRICE_LABEL",)),
    ("PRICING_LOWER_BOUND", r"^desde$", ("LOWER_BOUND",)),
    (
        "ZERO_VALUE_PLACEHOLDER",
        r"^\$?\s*0(?:[.,]0+)?$",
        ("ZERO_LITERAL", "DO_NOT_OVERRIDE_OBSERVED_PRICE"),
    ),
    ("AVAILABILITY_STATUS", r"^disponible$", ("AVAILABLE",)),
    ("GENERIC_SERVICE_HEADING", r"\bproblemas?\s+generales?\b", ("GENERIC_SERVICE_CONTEXT",)),
)
SERVICE_LANGUAGE = r"\bservice\b|\bservicio\b|\btecnico\b"
MARKETING_LANGUAGE = r"\bprecio claro\b|\blo que hacemos\b"

# Logistics meaning.
LOGISTICS_CHANNELS = (
    ("DELIVERY", (r"\benvio\b|\benviar\b|\bcorreo\b",)),
    ("MOTORBIKE_COURIER", (r"\bmoto\b|\bcadete\b",)),
    ("POSTAL_COURIER", (r"\bcorreo\b",)),
)
LOGISTICS_DESTINATIONS = (
    ("HOME", (r"\ba domicilio\b|\bdomicilio\b",)),
    ("BRANCH", (r"\bsucursal\b",)),
    ("PICKUP_POINT", (r"\bpunto hop\b|\bpunto de retiro\b|\bretiro\b",)),
)
LOGISTICS_CARRIERS = (("ANDREANI", (r"\bandreani\b",)), ("OCA", (r"\boca\b",)))
LOGISTICS_COVERAGE = (
    ("WITHIN_CIRCUNVALACION", (r"\bdentro de\b.*\bcircunvalacion\b",)),
    ("CORDOBA", (r"\bcordoba\b",)),
)

# Roles an observation may have.
ROLES = (
    "SINGLE_SERVICE",
    "COMPOSITE_SERVICE",
    "SCOPE_DEVICE",
    "PRICE_CONTEXT",
    "NON_OBJECT",
    "HARDWARE_PRODUCT",
    "LOGISTICS_CONTEXT",
    "UNMAPPED",
)

# Source registry domains.
REGISTRY_FIELDS = (
    "source",
    "provider",
    "url",
    "province",
    "city",
    "discovery_status",
    "price_visibility",
    "source_kind",
)
REGISTRY_DOMAINS = (
    ("discovery_status", ("DISCOVERED", "VERIFIED", "REJECTED", "DUPLICATE")),
    ("price_visibility", ("PRICE_VISIBLE", "NO_PRICE_VISIBLE", "UNKNOWN")),
    ("source_kind", ("PROVIDER", "AGGREGATOR", "REFERENCE")),
)
