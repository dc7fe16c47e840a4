"""The Spanish question vocabulary (services, places, intents, devices)."""

# Canonical services and the phrases that name them.
SERVICES = (
    (
        "FORMATEO_INSTALACION_SO",
        (r"\bformate", r"\binstal(?:ar|acion de) windows\b", r"\breinstalar windows\b"),
    ),
    (
        "BACKUP_DATOS",
        (
            r"\bbackup\b",
            r"\bback up\b",
            r"\brespaldo\b",
            r"\brespaldar\b",
            r"\bcopia de seguridad\b",
        ),
    ),
    (
        "RECUPERACION_DATOS",
        (r"\brecuperacion de datos\b", r"\brecuperar (?:fotos|archivos|datos)\b"),
    ),
    (
        "LIMPIEZA_MANTENIMIENTO",
        (r"\blimpieza\b", r"\bpasta termica\b", r"\brepaste", r"\bmantenimiento preventivo\b"),
    ),
    ("ELIMINACION_MALWARE", (r"\bmalware\b", r"\bvirus\b", r"\bspyware\b")),
    ("INSTALACION_DRIVERS", (r"\bdrivers?\b", r"\bcontroladores\b")),
    (
        "INSTALACION_PROGRAMAS",
        (r"\binstalar (?:programas?|office|antivirus)\b", r"\bprogramas? basicos\b"),
    ),
    (
        "SOPORTE_REMOTO",
        (
            r"\bsoporte remoto\b",
            r"\basistencia remota\b",
            r"\ba distancia\b",
            r"\bteamviewer\b",
            r"\banydesk\b",
            r"\bacceso remoto\b",
        ),
    ),
    (
        "ARMADO_PC",
        (r"\barmado de pc\b", r"\barmar una pc\b", r"\barmar pc\b", r"\bensambl"),
    ),
    (
        "UPGRADE_HARDWARE",
        (
            r"\bupgrade\b",
            r"\bmejorar la compu\b",
            r"\bcambio de hdd por ssd\b",
            r"\bampliacion de memoria\b",
        ),
    ),
    ("DIAGNOSTICO_REVISION", (r"\bdiagnostico\b", r"\brevision\b")),
    (
        "REPARACION_HARDWARE",
        (
            r"\breparar\b",
            r"\breparacion\b",
            r"\bcambio de pantalla\b",
            r"\bcambiar (?:un |el |la )?pantalla\b",
            r"\bcambio de teclado\b",
            r"\bcambiar (?:un |el |la )?teclado\b",
            r"\bcambio de fuente\b",
            r"\bcambiar (?:una |la )?fuente\b",
            r"\bbisagra\b",
            r"\bconector de carga\b",
        ),
    ),
    (
        "VISITA_TECNICA_DOMICILIO",
        (
            r"\ba domicilio\b",
            r"\btecnico a casa\b",
            r"\ben el domicilio\b",
            r"\bvisita tecnica\b",
        ),
    ),
    ("SERVICIO_IMPRESORAS", (r"\bimpresora",)),
    (
        "CCTV_INSTALACION_MANO_OBRA",
        (r"\bcamaras? (?:de seguridad|ip)\b", r"\bcctv\b", r"\bdvr\b"),
    ),
    ("WEB_LANDING", (r"\blanding page\b",)),
    ("WEB_SITIO_INSTITUCIONAL", (r"\bsitio institucional\b", r"\bweb institucional\b")),
    ("WEB_ECOMMERCE", (r"\becommerce\b", r"\btienda online\b", r"\bcarrito de compras\b")),
    ("WEB_MANTENIMIENTO", (r"\bmantenimiento (?:de )?(?:web|wordpress)\b",)),
    ("HOSTING_ADMINISTRADO", (r"\bhosting\b",)),
    ("VPS_ADMINISTRADO", (r"\bvps\b",)),
    (
        "DESARROLLO_SOFTWARE_HORA",
        (
            r"\bprogramacion\b",
            r"\bdesarrollo (?:web|de software)\b",
            r"\bdesarrollo (?:full ?stack|frontend|backend)\b",
        ),
    ),
)
HOME_VISIT = "VISITA_TECNICA_DOMICILIO"
REMOTE_SERVICES = (
    "SOPORTE_REMOTO",
    "WEB_LANDING",
    "WEB_SITIO_INSTITUCIONAL",
    "WEB_ECOMMERCE",
    "WEB_MANTENIMIENTO",
    "HOSTING_ADMINISTRADO",
    "VPS_ADMINISTRADO",
    "DESARROLLO_SOFTWARE_HORA",
)

# Places, in lookup order (expression, province, city).
CITIES = (
    ("rosario", "Santa Fe", "Rosario"),
    ("la plata", "Buenos Aires", "La Plata"),
    ("mar del plata", "Buenos Aires", "Mar del Plata"),
    ("lanus", "Buenos Aires", "Lanús"),
    ("quilmes", "Buenos Aires", "Quilmes"),
    ("moreno", "Buenos Aires", "Moreno"),
    ("posadas", "Misiones", "Posadas"),
    ("comodoro rivadavia", "Chubut", "Comodoro Rivadavia"),
    ("zona norte", "Buenos Aires", "Zona Norte"),
    ("zona oeste", "Buenos Aires", "Zona Oeste"),
    ("zona sur", "Buenos Aires", "Zona Sur"),
    ("gba", "Buenos Aires", "GBA"),
    ("gran buenos aires", "Buenos Aires", "GBA"),
)
PROVINCES = (
    ("caba", "CABA"),
    ("capital federal", "CABA"),
    ("capital", "CABA"),
    ("buenos aires", "Buenos Aires"),
    ("bs as", "Buenos Aires"),
    ("cordoba", "Córdoba"),
    ("santa fe", "Santa Fe"),
    ("mendoza", "Mendoza"),
    ("tucuman", "Tucumán"),
    ("salta", "Salta"),
    ("jujuy", "Jujuy"),
    ("chaco", "Chaco"),
    ("corrientes", "Corrientes"),
    ("entre rios", "Entre Ríos"),
    ("neuquen", "Neuquén"),
    ("rio negro", "Río Negro"),
    ("chubut", "Chubut"),
    ("santa cruz", "Santa Cruz"),
    ("tierra del fuego", "Tierra del Fuego"),
    ("la pampa", "La Pampa"),
    ("san juan", "San Juan"),
    ("san luis", "San Luis"),
    ("la rioja", "La Rioja"),
    ("catamarca", "Catamarca"),
    ("formosa", "Formosa"),
    ("misiones", "Misiones"),
    ("santiago del estero", "Santiago del Estero"),
)

# Intent phrases.
BUY = (
    r"\bme quieren cobrar\b",
    r"\bme cobran\b",
    r"\bme cobraron\b",
    r"\bme pasaron\b",
    r"\bme presupuestaron\b",
    r"\bme cotizaron\b",
    r"\bme dijeron\b",
    r"\bpagar\b",
    r"\bme ofrecieron\b",
)
ASKED_OF_ME = r"\bme piden\b"
SELL = (
    r"\bquiero cobrar\b",
    r"\bcuanto cobrar\b",
    r"\bcuanto puedo cobrar\b",
    r"\ble puedo cobrar\b",
    r"\bdeberia cobrar\b",
    r"\bcuanto pedir\b",
    r"\bquiero vender\b",
    r"\bvoy a vender\b",
    r"\bvendo\b",
)
JUDGE = (
    r"\besta bien\b",
    r"\bte parece bien\b",
    r"\bes mucho\b",
    r"\bes caro\b",
    r"\besta caro\b",
    r"\bes barato\b",
    r"\bme estan matando\b",
    r"\bme estan afanando\b",
    r"\bme quedo corto\b",
    r"\bme estoy pasando\b",
    r"\brazonable\b",
)
COMPARE = r"\bcompar"
MARKET_REFERENCE = (
    r"\bcuanto (?:(?:sale|cuesta|esta)|(?:se )?esta cobrando|estan cobrando|se cobra|cobran)\b",
    r"\bprecio de referencia\b",
    r"\bprecio de\b",
)
ECONOMIC_WORDS = (
    r"\bcuanto\b|\bprecio\b|\bcobrar\b|\bpagar\b|\$|"
    r"\b(?:lucas?|mil|k|palos?|usd|u\$s|d[oó]lares?)\b"
)
GOODS = (
    r"\b(?:rtx|gtx|rx)\s?\d{3,4}\b",
    r"\bryzen\s+[3579]\b",
    r"\bcore\s+i[3579]\b",
    r"\bi[3579]\b",
    r"\bssd\b",
    r"\bnvme\b",
    r"\bmemoria ram\b",
    r"\bnotebook\b.*\b(?:nueva|usada|precio|sale|vender|vendo)\b",
    r"\bpc armada\b",
    r"\b(?:una|la) pc\s+(?:para|con)\b",
)

# Device, parts, modality and condition.
DEVICES = (
    ("NOTEBOOK", (r"\bnotebook\b", r"\blaptop\b", r"\bnote\b")),
    ("PC", (r"\bpc\b", r"\bcompu\b", r"\bcomputadora\b")),
    ("CELULAR", (r"\bcelular\b", r"\bcelu\b")),
    ("IMPRESORA", (r"\bimpresora\b",)),
    ("GPU", (r"\bplaca de video\b", r"\bgpu\b", r"\b(?:rtx|gtx|rx)\s?\d{3,4}\b")),
    ("STORAGE", (r"\bssd\b", r"\bnvme\b", r"\bdisco\b", r"\bpendrive\b")),
)
PARTS = (
    (
        "LABOR_ONLY",
        (r"\b(?:solo|solamente) (?:de )?(?:la )?mano de obra\b", r"\bsin repuesto\b"),
    ),
    (
        "PARTS_INCLUDED",
        (
            r"\bincluye (?:el |la |los |las )?"
            r"(?:repuesto|panel|pantalla|ssd|fuente|teclado|materiales)\b",
        ),
    ),
    (
        "USER_PROVIDED",
        (r"\bya (?:tengo|compre) (?:el |la )?(?:repuesto|ssd|fuente|teclado|pantalla)\b",),
    ),
)
PART_SWAP = (
    r"\b(?:(?:cambio de )|(?:cambiar (?:un |una |el |la )?))"
    r"(?:pantalla|teclado|fuente|ssd|disco)\b"
)
MODALITY = (
    ("ONSITE", (r"\ba domicilio\b", r"\btecnico a casa\b", r"\ben (?:mi|el) domicilio\b")),
    ("WORKSHOP", (r"\ben taller\b", r"\ben el local\b", r"\blo llevo\b")),
)
CONDITION = (("USED", (r"\busad[oa]\b",)), ("NEW", (r"\bnuev[oa]\b",)))

# How amounts are written.
AMOUNT_RANGE = (
    r"\bentre\s+([\d.,]+)\s+y\s+([\d.,]+)\s*(lucas?|mil|k|palos?|usd|d[oó]lares?)\b"
)
AMOUNT_RANGE_ANY = (
    r"\bentre\s+[\d.,]+\s+y\s+[\d.,]+\s*(?:lucas?|mil|k|palos?|usd|u\$s|d[oó]lares?)\b"
)
AMOUNT_MAGNITUDE = (
    r"\b(casi|aprox(?:imadamente)?|alrededor de)?\s*([\d.,]+)\s*(lucas?|mil|k|palos?)\b"
)
AMOUNT_MILLION = r"\bun palo\b"
AMOUNT_USD = r"\b([\d.,]+)\s*(usd|u\$s|d[oó]lares?)\b"
AMOUNT_PESO = r"(?<!\w)\$\s*([\d.]+(?:,\d+)?)"
AMOUNT_NAKED = r"(?<![\w$])(\d{1,3}(?:[.,]\d{3})+(?:,\d{1,2})?|\d{2,}(?:[.,]\d+)?)\b"
AMOUNT_MAGNITUDE_BARE = r"\b[\d.,]+\s*(?:lucas?|mil|k|palos?)\b"
AMOUNT_USD_BARE = r"\b[\d.,]+\s*(?:usd|u\$s|d[oó]lares?)\b"
AMOUNT_PESO_BARE = r"(?<!\w)\$\s*[\d.]+(?:,\d+)?"
LOCAL_CURRENCY_HINT = r"\b(?:lucas?|mil|k|palos?)\b|\$"
TIME_UNIT_AFTER = r"^\s*(?:dias?|horas?|semanas?|mes(?:es)?|anos?|minutos?)\b"
MODEL_BEFORE = r"\b(?:rtx|gtx|rx)\s*$"
QUANTITY_AFTER = (
    r"^\s*(?:puestos?|camaras?|equipos?|unidades?|usuarios?|licencias?|"
    r"gb|tb|mb|mhz|ghz|hz|w|watts?|pulgadas?|inch(?:es)?)\b"
)

# Technical need behind a question without economic intent.
INSTALLING_WINDOWS = r"\b(?:instalando|instalar|instalacion de)\s+windows\b|\bwindows\s+\d+\b"
STUCK = r"\b(?:se queda|queda|quedo|se quedo|se congela|congelado|clavado|trabado|colgado)\b"
PROGRESS = r"\b\d{1,3}\s*%\b|\bpor ciento\b"
ASKS_CAUSE = (
    r"\bque puede estar pasando\b|\bque pasa\b|\bpor que\b|\bcual puede ser\b"
)
NEED_PROBLEM = "OS_INSTALLATION_FAILURE"
NEED_ROUTES = ("DIAGNOSTIC_SERVICE", "OS_INSTALLATION_SERVICE", "HARDWARE_DIAGNOSTIC")
ROUTE_SERVICES = (
    ("OS_INSTALLATION_SERVICE", "FORMATEO_INSTALACION_SO"),
    ("DIAGNOSTIC_SERVICE", "DIAGNOSTICO_REVISION"),
)
ROUTE_UNRESOLVED = (
    (
        "HARDWARE_DIAGNOSTIC",
        "Hardware diagnostic is a plausible route, but it is not equivalent to "
        "a repair, replacement, product purchase, or known comparable service v1.",
    ),
)
ROUTE_UNKNOWN = "No safe canonical economic object exists for this technical route v1."
ROUTE_NO_PROVINCE = (
    "Route maps to a known local canonical service, but market requires province."
)
ROUTE_RESOLVED = "Route maps to a known local canonical service."
READY_LOCAL = "Canonical service and local market are complete for a pricing lookup."
READY_REMOTE = (
    "Canonical service and remote national market are complete for a pricing lookup."
)
NEEDS_PROVINCE = "Local pricing evidence requires province."
NEEDS_COUNTRY = "Remote national pricing requires explicit AR market."
NO_SERVICE = "Resolved route is missing canonical service."
BAD_SCOPE = "Unsupported or incomplete market scope for pricing lookup."

# Questions asked back, by reason, and the reasons that block a decision.
QUESTIONS = (
    (
        "MULTIPLE_MONETARY_MENTIONS",
        "Detecté más de un monto en la consulta. ¿Qué importe querés evaluar y a qué unidad "
        "de cobro corresponde?",
    ),
    ("MISSING_PROVINCE", "¿En qué provincia se realiza el servicio?"),
    ("UNKNOWN_ECONOMIC_OBJECT", "¿Qué servicio o producto tecnológico querés evaluar?"),
    (
        "UNKNOWN_CURRENCY",
        "¿Ese monto está expresado en pesos argentinos o en otra moneda?",
    ),
    ("UNKNOWN_PARTS_SCOPE", "¿El precio incluye el repuesto o es sólo mano de obra?"),
)
BLOCKING = tuple(reason for reason, _ in QUESTIONS)
NEED_REASON = "TECHNICAL_NEED_CLARIFICATION_REQUIRED"
NEED_QUESTION = (
    "Necesito confirmar contexto técnico antes de convertir esto en una decisión económica."
)
NEED_PROVINCE_REASON = "MISSING_PROVINCE_FOR_LOCAL_MARKET"
NEED_PROVINCE_QUESTION = "¿En qué provincia se realizaría el servicio técnico?"
CADENCE_REASON = "PRICE_SCOPE_REQUIRED"
CADENCE_QUESTION = (
    "¿Ese precio corresponde a una hora, una visita, un abono mensual u otra unidad de cobro?"
)
