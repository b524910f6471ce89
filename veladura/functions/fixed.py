"""Patterns, word lists and constants that have to equal those of the system whose results are matched.

Patterns are written in the syntax that Java, Python and RE2 share, unless noted; flags are added by the user.
"""

# --- fixed values: detection patterns -------------------------------------------------------------------------
DNI = r"\b([0-9]{8})\b"
DNI_TRIGGER = (
    r"(?:D\.?N\.?I\.?|documento\s+(?:nacional\s+)?de\s+identidad|identificad[oa]\s+con|con\s+D\.?N\.?I\.?)"
    r"\s*(?:n[°oº]?|nro\.?|número|numero)?\s*[:\-\s]*\b([0-9]{8})\b"
)
DNI_SPACED = r"(?:D\s*\.?\s*N\s*\.?\s*I\s*\.?)\s*(?:n[°oº]?|nro\.?|número|numero)?\s*[:\-\s]*([0-9]{8})\b"
RUC = r"\b((?:10|15|17|20)[0-9]{9})\b"
EMAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})\b"
EMAIL_GUARD = r"(?<![A-Za-z0-9._%+\-])"
PHONES = (
    r"(\+51\s*[-\s]?\s*9\d{2}\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{3})\b",
    r"(\+51\s*9\d{8})\b",
    r"\b(9\d{2}\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{3})\b",
    r"\b(9\d{8})\b",
    r"(\(0?1\)\s*\d{3}\s*[-\s]?\s*\d{4})\b",
    r"\b(01\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{4})\b",
    r"\b(0\d{2}\s*[-\s]?\s*\d{6,7})\b",
    r"(\(\d{2,3}\)\s*\d{6,7})\b",
)
CASE_FILES = (
    r"\b(EXP[-_][A-Z0-9][A-Z0-9\-]{5,30})\b",
    r"(?:expediente\s+judicial|expediente|exp\.?)\s*(?:n[°oº]?\s*)?[-:\s]*((?:EXP[-_])?[A-Z0-9][A-Z0-9\-]{5,30})",
    r"\b(\d{5}-\d{4}-\d+-\d{4}-[A-Z]{2}-[A-Z]{2}-\d{2})\b",
    r"\bEXP[-_]([A-Z0-9][\dA-Z\-]{3,18})\b",
    r"\b(\d{5,6}-\d{4}(?:-\d+)?)\b",
    r"(?:expediente|exp\.?)\s*[-:\s]*(?:n[°oº]?\s*)?[-:\s]*(\d{2,8}(?:[-/]\d{2,8}){0,3})",
)
MAILBOX = r"casilla\s+(?:electr[oó]nica\s+)?(?:n[°oº]?\s*)?(\d+)"
RECORDS = (
    r"acta\s+(?:de\s+)?(?:conciliaci[oó]n|audiencia|inspecci[oó]n|constataci[oó]n)?\s*(?:n[°oº]?\s*)?(\d+[-/]?\d*)",
    r"\b(acta\s+n[°oº]?\s*\d+[-/]?\d*)\b",
)
ORDINAL = r"(?:primer[oa]?\s+|segundo[a]?\s+|tercer[oa]?\s+|cuart[oa]?\s+|quint[oa]?\s+|sext[oa]?\s+|\d{1,2}\s*[°ºo]?\s+)?"
COURT = (
    r"\b(" + ORDINAL + r"juzgado\s+(?:de\s+)?(?:paz\s+letrado|familia|civil|penal|laboral|mixto|comercial|constitucional|"
    r"especializado|unipersonal|permanente|supraprovincial|corporativo|transitorio)"
    r"(?:\s+y\s+[A-Za-záéíóúñÁÉÍÓÚÑ]+(?:\s+[A-Za-záéíóúñÁÉÍÓÚÑ]+){0,4})?(?:\s+[A-ZÁÉÍÓÚÑA-Za-záéíóúñ][A-Za-záéíóúñÁÉÍÓÚÑ]*){0,7})"
)
ACCOUNTS = (
    r"(?:cuentas?\s*(?:bancarias?|de\s+ahorros?|corrientes?)?\s*(?:registrad[ao]s?\s+)?(?:bajo\s+(?:el|la)\s+)?n[°uú]mero\s+|"
    r"cuentas?\s*(?:de\s+ahorros?|corriente)?\s*(?:n[°oº]?\s*)?|cta\.?\s*(?:n[°oº]?\s*)?)(\d{10,20})",
    r"(?:CCI|cci)\s*[:.]?\s*(\d{20})",
    r"\b(\d{3}[-\s]?\d{3}[-\s]?\d{10,14})\b",
)
MEDICAL = r"\b(HC[-_]\d{5,10}|historia\s+cl[ií]nica\s*(?:n[°oº]?|nro\.?)?\s*[:\-]?\s*\d{5,10})\b"
CLIENT = r"\b(CLI[-_]\d{4,10}|c[oó]digo\s+de\s+cliente\s*(?:n[°oº]?|nro\.?)?\s*[:\-]?\s*\d{4,10})\b"
LICENCE = r"\b(LIC[-_][A-Z0-9]{5,12}|licencia(?:\s+de\s+conducir)?\s*(?:n[°oº]?|nro\.?)?\s*[:\-]?\s*[A-Z0-9]{5,12})\b"
POLICY = r"\b(POL[-_]\d{5,12}|p[oó]liza\s*(?:n[°oº]?|nro\.?)?\s*[:\-]?\s*\d{5,12})\b"
LICENSED = (
    r"(?:C\.?A\.?L\.?|C\.?A\.?C\.?|C\.?A\.?A\.?|CMP|CIP|CAP|CPA|CPP|CNP|[Cc]olegiatura|[Cc]olegio\s+de\s+[Aa]bogados)"
    r"(?:\s+(?:N[°oº]?|n[°oº]?|n[uú]mero|numero|no\.?|es|de|:))?\s*(?:N[°oº]?\s*)?[:\-]?\s*(\d{3,6})"
)
CHAMBER = (
    r"\b(" + ORDINAL + r"sala\s+(?:de\s+)?(?:civil|penal|laboral|familia|mixta?|comercial|constitucional|suprema?|superior|"
    r"apelaciones?|audiencia|litigios|conflictos)(?:\s+[A-Za-záéíóúñÁÉÍÓÚÑ]+){0,5})"
)
TRIBUNAL = (
    r"\b(tribunal\s+(?:constitucional|supremo?|arbitral|de\s+justicia|de\s+honor|militar|administrativo|"
    r"fiscal|de\s+apelaci[oó]n|de\s+garant[ií]as?|de\s+contrataciones?)(?:\s+[A-Za-záéíóúñÁÉÍÓÚÑ]+){0,4})"
)
REGISTRY = (
    r"(?:partida\s+(?:electr[oó]nica|registral|sunarp)?|asiento\s+registral|tomo\s+registral|(?:SUNARP|sunarp)\s*[:,]?)"
    r"\s*(?:n[°oº]?\s*)?[:\s]*(\d{4,12}(?:[-/]\d{2,6})?)"
)
#: The words between may run long: written without a repeated group, so that a search goes over them once.
RULING = (
    r"(?:resoluci[oó]n|auto|decreto|acuerdo|oficio|informe)\s+(?:[a-záéíóúñ][a-záéíóúñ\s]*\s)?n[°oº][.:/ ]*(\d{2,6}(?:[-/]\d{2,6})?)"
)
PLATE = r"\b([A-Z]{3}[-\s]?\d{3})\b"
SIGNATURES = (
    r"(firma\s*:?\s*[^\n]{0,50})",
    r"(_____+)",
    r"(FIRMADO\s*(?:DIGITAL(?:MENTE)?)?)",
    r"(/s/\s*[^\n]{0,30})",
    r"(firmante\s*:?\s*[^\n]{0,50})",
    r"(suscribe\s*:?\s*[^\n]{0,50})",
)
SEALS = (r"(sello\s*:?\s*[^\n]{0,50})", r"(\[sello\])", r"(sellado\s+por\s*:?\s*[^\n]{0,50})")
PRINTS = (r"(huella\s*(?:digital|dactilar)?\s*:?\s*[^\n]{0,30})", r"(\[huella\])", r"(impresión\s+dactilar\s*:?\s*[^\n]{0,30})")
HOMES = (
    r"domicilio\s+(?:real|procesal|legal|fiscal|actual|particular)\s*[:\s]+([^;\n]{5,120})",
    r"(?:con\s+)?domicilio\s+(?:en|sito\s+en|ubicado\s+en)\s*[:\s]*([^;\n]{5,120})",
    r"(?:reside|vive|habita)\s+en\s*[:\s]*([^;\n]{5,120})",
    r"direcci[oó]n\s*[:\s]+([^;\n]{5,120})",
    r"ubicad[oa]\s+en\s*[:\s]*([^;\n]{5,120})",
)
PHONE_TRIGGER = r"(?:teléfono|telefono|celular|cel\.?|móvil|movil|whatsapp|fono|contacto)\s*[:\s]?\s*(\+?\d[\d\s\-\(\)]{7,18})"
EMAIL_TRIGGER = r"(?:correo\s+electr[oó]nico|e-?mail|correo)\s*[:\s]?\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"

# --- fixed values: names and what announces them --------------------------------------------------------------
NAME_TITLE = r"[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){0,5}"
NAME_STRICT = (
    r"(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+|[A-ZÁÉÍÓÚÑ]{2,})"
    r"(?:[ \t]+(?:de(?:[ \t]+(?:la|los|las))?[ \t]+|del[ \t]+)?(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+|[A-ZÁÉÍÓÚÑ]{2,})){0,5}"
)
CAPITALS = r"\b([A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,5})\b"
TITLES = (
    r"se[ñn]or[a]?|sr\.?|sra\.?|don|do[ñn]a|abogad[oa]|letrad[oa]|dr\.?|dra\.?|el\s+demandante|la\s+demandante"
    r"|el\s+demandado|la\s+demandada|el\s+codemandado|la\s+codemandada|el\s+recurrente|la\s+recurrente|el\s+apelante|la\s+apelante"
    r"|el\s+agraviado|la\s+agraviada|el\s+imputado|la\s+imputada|el\s+investigado|la\s+investigada|el\s+procesado|la\s+procesada"
    r"|el\s+actor|la\s+actora|el\s+solicitante|la\s+solicitante|el\s+apoderado|la\s+apoderada|representante\s+legal"
)
ATTORNEYS = r"procurador(?:es)?[ \t]+(?:p[uú]blic[oa]s?[ \t]+|judiciales?[ \t]+)?|procurador(?:es)?[ \t]+a[ \t]+cargo[ \t]+"
SIGNERS = (
    r"atentamente[,\t ]+|firma[ \t]*:[ \t]*|firman?[ \t]*:[ \t]*|suscrit[oa][ \t]+por[ \t]+"
    r"|suscrib[eo][ \t]+(?:la[ \t]+)?(?:presente[ \t]+)?(?:el[ \t]+)?|abogado[ \t]+defensor[ \t]*:[ \t]*"
    r"|abogad[oa][ \t]+patrocinante[ \t]*:[ \t]*|nombre[ \t]+del[ \t]+firmante[ \t]*:[ \t]*"
)
SENDERS = (
    r"de[ \t]*:[ \t]*|a[ \t]*:[ \t]*|para[ \t]*:[ \t]*|remitente[ \t]*:[ \t]*|destinatario[ \t]*:[ \t]*"
    r"|dirigido[ \t]+a[ \t]*:[ \t]*|emisor[ \t]*:[ \t]*"
)
MINORS = (
    r"menor[ \t]+(?:de[ \t]+nombre|llamad[oa]|de[ \t]+edad[ \t]+llamad[oa])[ \t]+"
    r"|hij[oa][ \t]+(?:de[ \t]+nombre[ \t]+|llamad[oa][ \t]+|menor[ \t]+)?|hijos?[ \t]+menores?[ \t]+(?:de[ \t]+nombre[ \t]+)?|(?:la|el)[ \t]+menor[ \t]+"
)
SURNAMES = (
    r"de[ \t]+apellidos?[ \t]+|apellidad[oa][ \t]+|cuyo[ \t]+apellido[ \t]+es[ \t]+|cuyos?[ \t]+nombres?[ \t]+(?:son[ \t]+|es[ \t]+)?"
    r"|de[ \t]+nombres?[ \t]+(?:y[ \t]+apellidos?[ \t]+)?"
)
PARTIES = (
    r"demandante[a]?\s*[:(]\s*|demandad[oa]\s*[:(]\s*|codemandad[oa]\s*[:(]\s*|solicitante[a]?\s*[:(]\s*|invitad[oa]\s*[:(]\s*"
    r"|(?:el|la)[ \t]+ciudadan[oa][ \t]+|ciudadan[oa][ \t]+"
)
DEGREES = r"(?:Dra?\.?|Abg\.?|Lic\.?|Psic\.?|Mg\.?|Ing\.?|C\.?\s*Ps\.?\s*P\.?|Trab\.?\s*Social|Bach\.?|CPC\.?)\s+"
JOBS = (
    r"abogad[oa]|procurador[a]?|defensor[a]?|especialista|asistente|juez[a]?|fiscal|notari[oa]?|médic[oa]?|psicólog[oa]?|"
    r"trabajador[a]?\s+social|asesor[a]?|coordinador[a]?|director[a]?|gerente|jefe\s+de|responsable|consultor[a]?|perito"
)
BOARDS = r"CAL|CMP|CIP|CNA|CAC|CPP|CPPP|CAQ|COP"
PERSON_TRIGGERS = (
    "demandante", "demandado", "demandada", "codemandado", "codemandada", "señor", "señora", "sr.", "sra.", "don", "doña",
    "abogado", "abogada", "letrado", "letrada", "menor", "menores", "hijo", "hija", "madre", "padre", "identificado",
    "identificada", "suscrito", "suscrita", "interpone", "interpongo", "contra", "recurrente", "testigo", "perito", "perita",
    "declarante", "cónyuge", "esposo", "esposa", "conviviente", "representante", "apoderado", "apoderada", "solicitante",
    "invitado", "invitada", "acreedor", "acreedora", "deudor", "deudora", "denunciante", "denunciado", "denunciada",
    "imputado", "imputada", "procesado", "procesada", "agraviado", "agraviada", "víctima", "victima", "actor", "actora",
    "demandado(a)", "demandante(s)", "patrocinante", "patrocinado", "patrocinada", "defendido", "defendida", "investigado",
    "investigada", "hermano", "hermana", "suscrito por", "suscrita por",
)

# --- fixed values: contexts -----------------------------------------------------------------------------------
MONEY = (
    "S/", "US$", "$", "PEN", "USD", "soles", "dólares", "dolares", "%", "porcentaje", "por ciento", "puntos", "cuotas",
    "meses", "días", "años", "horas", "minutos", "metros", "kilos", "gramos",
)
VEHICLE = (
    "placa", "vehículo", "vehiculo", "auto", "camioneta", "moto", "motocicleta", "bus", "camión", "camion", "automóvil",
    "automovil", "unidad", "circulación", "circulacion",
)
CASE_MARKS = ("EXP-", "EXP_", "EXPEDIENTE", "EXP.", "JUDICIAL", "N° DE EXPEDIENTE", "NRO DE EXPEDIENTE", "EXPEDIENTE JUDICIAL")
LEGAL_NUMBERS = (
    "artículo", "articulo", "art.", "inciso", "numeral", "literal", "ley", "decreto", "resolución", "folio", "página",
    "cuaderno", "tomo", "legajo",
)
DNI_CONTEXT = (
    "dni", "d.n.i", "documento de identidad", "doc. identidad", "identificado con", "identificada con", "n°", "nº", "numero", "número",
)
AUDIT_VEHICLE = (
    "placa", "vehiculo", "vehículo", "automovil", "automóvil", "auto", "camioneta", "moto", "motocicleta", "camion", "camión",
    "bus", "ómnibus", "omnibus",
)

# --- fixed values: audit patterns -----------------------------------------------------------------------------
TOKEN = r"\{\{[A-Z_]+_\d+\}\}"
AUDIT_EMAIL = r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"
AUDIT_PHONES = (
    r"(\+51[\s\-]?9[\d\s\-]{8,12})\b",
    r"\b(9\d{2}[\s\-]?\d{3}[\s\-]?\d{3})\b",
    r"\b(9\d{8})\b",
    r"(\(\s*0?1\s*\)[\s\-]?\d{3}[\s\-]?\d{4})",
    r"\b(0?1[\s\-]?\d{3}[\s\-]?\d{4})\b",
    r"\b(0[1-9]\d?[\s\-]?\d{6,7})\b",
)
AUDIT_LICENSED = (
    r"(?:C\.?A\.?L\.?|CAL|CMP|CIP|CAP|CPA|Colegiatura|Colegio de Abogados|N[°º]?\s*(?:de\s+)?Colegiatura)[\s:N°º]*(\d{4,6})"
)
AUDIT_RUC = r"\b((?:10|20)\d{9})\b"
AUDIT_RECORD = (
    r"(?:Acta\s+(?:de\s+)?[Cc]onciliaci[óo]n|N[°º]\s*(?:de\s+)?[Aa]cta|Registro\s+N[°º]?|N[°º]\s*(?:de\s+)?[Rr]egistro|"
    r"Constancia\s+N[°º]?|Documento\s+N[°º]?|Expediente\s+N[°º]?)[\s:N°º]*(\d{4,12}(?:[-/]\d{2,6})?)"
)
AUDIT_CASES = (
    r"\b(\d{5}-\d{4}-\d+-\d{4}-[A-Z]{2}-[A-Z]{2}-\d{2})\b",
    r"(?:expediente|exp\.?|proceso)\s*(?:n[°oº]?\s*)?[:\s]*(\d{2,6}[-/]?\d{0,4}[-/]?\d{0,4})",
)
AUDIT_RULING = r"(?:resoluci[oó]n|auto|oficio|informe)\s*(?:n[°oº]?\s*)?[:\s]*(\d{2,6}[-/]?\d{0,4})"
AUDIT_REGISTRY = r"(?:partida\s+(?:electr[oó]nica|registral)?|SUNARP|asiento|tomo|ficha|folio)\s*(?:n[°oº]?\s*)?[:\s]*(\d{4,12})"
AUDIT_MAILBOXES = (MAILBOX, r"mesa\s+de\s+partes\s*(?:n[°oº]?\s*)?[:\s]*(\d+)")
AUDIT_COURT = (
    r"(\d*[°ºo]?\s*(?:juzgado|tribunal|sala|corte\s+superior|fiscalía|fiscalia)\s+(?:de\s+)?"
    r"(?:paz\s+letrado|familia|civil|penal|laboral|mixto|comercial|constitucional|suprema)?(?:\s+(?:de|del)\s+[A-Za-záéíóúñÁÉÍÓÚÑ]+){0,3})"
)
AUDIT_PLATE = r"\b([A-Z]{1,3}[-\s]?\d{1,3}[-\s]?[A-Z0-9]{1,3})\b"
AUDIT_ADDRESSES = (
    r"(?:Calle|Av\.?|Avenida|Jr\.?|Jirón|Jiron|Psje\.?|Pasaje|Alameda|Malecón|Malecon)"
    r"\s+[A-ZÁÉÍÓÚÑa-záéíóúñ\s]+(?:N[°º]?\s*\d+|Nro\.?\s*\d+|\d+)"
    r"(?:\s*[-,]\s*(?:Dpto\.?|Dep\.?|Oficina|Of\.?|Int\.?|Piso)\s*\d+[A-Z]?)?"
    r"(?:\s*[-,]\s*(?:Mz\.?|Manzana)\s*[A-Z0-9]+)?(?:\s*[-,]\s*(?:Lt\.?|Lote)\s*\d+)?"
    r"(?:\s*[-,]\s*(?:Urb\.?|Urbanización|Urbanizacion)\s+[A-ZÁÉÍÓÚÑa-záéíóúñ\s]+)?",
    r"(?:Mz\.?|Manzana)\s*[A-Z0-9]+\s*[-,]?\s*(?:Lt\.?|Lote)\s*\d+(?:\s*[-,]\s*(?:Urb\.?|Urbanización|Urbanizacion)\s+[A-ZÁÉÍÓÚÑa-záéíóúñ\s]+)?",
)

# --- fixed values: pre-redaction ------------------------------------------------------------------------------
PRE_REDACT = (
    ("EMAIL_PRE", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"),
    ("RUC_PRE", r"\b((?:10|15|17|20)\d{9})\b"),
    ("TEL_PRE", r"(\+51[\s\-]?9[\d\s\-]{8,12}|\b9\d{8}\b|\b9\d{2}[\s\-]?\d{3}[\s\-]?\d{3}\b)"),
    ("CCI_PRE", r"\b(\d{20})\b"),
    ("PLACA_PRE", r"\b([A-Z]{3}[-\s]?\d{3})\b"),
)
PRE_REDACT_DNI = r"\b(\d{8})\b"
PRE_REDACT_DNI_AFTER = ("s/", "us$", "$", "soles", "artículo", "art.", "ley", "decreto")

# --- fixed values: institutions, boards, sections, addresses, names on their own --------------------------------
INSTITUTIONS = (
    r"JUZGADO|SALA|CORTE\s+SUPERIOR|PODER\s+JUDICIAL|FISCAL[IÍ]A|MINISTERIO\s+P[ÚU]BLICO|DEFENSOR[IÍ]A\s+DEL\s+PUEBLO|SUNARP|"
    r"REGISTROS\s+P[ÚU]BLICOS|REGISTRO\s+PERSONAL|REGISTRO\s+VEHICULAR|RENIEC|RNP|REGISTRO\s+NACIONAL|MUNICIPALIDAD|GOBIERNO\s+REGIONAL|"
    r"MINISTERIO|SUPERINTENDENCIA|SBS|OSIPTEL|OSINERGMIN|SUNAT|INDECOPI|MIGRACIONES|NOTAR[IÍ]A|NOTARIO|COLEGIO\s+DE\s+NOTARIOS|"
    r"CENTRO\s+DE\s+CONCILIACI[ÓO]N|CONCILIADOR|PNP|POLIC[IÍ]A\s+NACIONAL|COMISAR[IÍ]A"
)
FOLLOWING = r"[A-ZÁÉÍÓÚÑ0-9&“”\"().,\-]+(?:\s+[A-ZÁÉÍÓÚÑ0-9&“”\"().,\-]+){1,8}"
COURTS = (
    "juzgado", "sala", "tribunal", "corte superior", "corte suprema", "poder judicial", "fiscalía", "fiscalia", "ministerio público",
    "ministerio publico", "defensoría del pueblo", "defensoria del pueblo",
)
ASSOCIATIONS = ("CAL", "CALN", "CAC", "CAA", "ICAP", "ICAL", "ICAC", "ICAA", "CAH", "ICAI", "CAJ", "ICAT")
ASSOCIATION = r"\b([A-Z](?:\.?[A-Z]){1,5}\.?)\s*[:\-]?\s*([A-ZÁÉÍÓÚÑ&“”\"().,\-]+(?:\s+[A-ZÁÉÍÓÚÑ&“”\"().,\-]+){1,5})\b"
HEADINGS = (
    "DATOS DEL DEMANDANTE", "DATOS DE LA DEMANDANTE", "DATOS DEL DEMANDADO", "DATOS DE LA DEMANDADA", "DATOS DE LOS SOLICITANTES",
    "DATOS DE LAS SOLICITANTES", "DATOS DEL SOLICITANTE", "DATOS DE LA SOLICITANTE", "DATOS DEL INVITADO", "DATOS DE LA INVITADA",
    "DATOS PERSONALES", "DATOS GENERALES",
)
SECTION = r"[:\s]*((?s:.{50,500}?))(?=\n\n|\n[A-Z]{2,}|\nI{1,3}\.|\n\d+[.)-])"
SECTION_NAME = r"([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,3})"
SECTION_DNI = r"\b(\d{8})\b"
ADDRESS_WORDS = (
    r"\bAv(?:enida)?\.?\s+|\bJr(?:\.|\.|irón)?\s+|\bCalle\s+|\bPsje(?:\.|Pasaje)?\s+|\bMz(?:\.|anzana)?\s+|\bLt(?:\.|ote)?\s+|"
    r"\bUrb(?:\.|anizaci[oó]n)?\s+|\bAA\.?HH\.?\s+|\bP\.?J\.?\s+|\bN[°oº]?\s*\d+|\bBloque\s+|\bPiso\s+|\bInt(?:erior)?\.?\s*|\bDpto\.?\s*"
)
ADDRESS = rf"(?:{ADDRESS_WORDS})[A-Za-záéíóúñÁÉÍÓÚÑ0-9\s,.\-°º#]+(?=[\.\n,;]|$)"
ADDRESS_BREAK = r"(?<=[\.;])\s+(?=[A-ZÁÉÍÓÚÑ])"
ADDRESS_GOES_ON = (
    "departamento", "departamento.", "depto", "depto.", "interior", "int.", "oficina", "of.", "piso", "bloque", "urb.", "urbanización",
    "urbanizacion", "distrito", "provincia", "lima",
)
NAMED = (
    r"((?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+|[A-ZÁÉÍÓÚÑ]{2,})(?:\s+(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?(?:[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+|[A-ZÁÉÍÓÚÑ]{2,})){1,5})"
    r"\s*,?\s*(?i:identificad[oa]\s+con\s+(?:DNI|D\.?N\.?I\.?|documento)\s*(?:n[°oº]?\s*)?[:\s]*)(\d{8})"
)
LOOSE_NAME = (
    r"([A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ]+(?:\s+(?:de|del|la|los|las))?(?:\s+[A-ZÁÉÍÓÚÑ][A-Za-zÁÉÍÓÚÑáéíóúñ]+){1,5})"
)
IDENTIFIED = LOOSE_NAME + r"\s*,?\s*(?i:identificad[oa]\s+con\s+(?:D\.?\s*N\.?\s*I\.?|DNI|documento\s+de\s+identidad))"
ALONE = (r"^(?:REMITENTE|DESTINATARIO)\s*:?\s*\n" + LOOSE_NAME + r"\s*$", r"^Atentamente,?\s*\n" + LOOSE_NAME + r"\s*$")
CAPITAL_LINE = r"^\s*([A-ZÁÉÍÓÚÑ]{2,}(?:\s+(?:DE|DEL|LA|LOS|LAS|Y))?(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,4})\s*$"
LEGAL_CAPITALS = (
    "PETITORIO", "FUNDAMENTOS", "PRUEBAS", "ANEXOS", "HECHOS", "DEMANDA", "SUMILLA", "PRETENSION", "PRETENSIÓN", "OTROSÍ", "MINISTERIO",
    "PODER", "JUDICIAL", "TRIBUNAL", "JUZGADO", "SALA", "FISCALÍA", "FISCALIA", "SOLICITA", "INTERPONE", "EXPEDIENTE", "CASILLA",
    "ARTÍCULO", "CONSIDERANDO", "RESOLUCIÓN", "PRIMERO", "SEGUNDO", "TERCERO",
)
HARD = (
    "PENSION", "PENSIÓN", "ALIMENTOS", "REDUCCION", "REDUCCIÓN", "MONTO", "SITUACION", "SITUACIÓN", "ECONOMICA", "ECONÓMICA", "PETITORIO",
    "FUNDAMENTOS", "HECHOS", "ANEXOS", "PRUEBAS", "PRETENSION", "PRETENSIÓN",
)

# --- fixed values: emergency redaction ------------------------------------------------------------------------
HARD_REDACT = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "{{EMAIL_REDACT}}"),
    (r"\b\d{8}\b", "{{DNI_REDACT}}"),
    (r"\b(?:10|20)\d{9}\b", "{{RUC_REDACT}}"),
    (r"\+51[\s\-]?9[\d\s\-]{8,12}|9\d{8}", "{{TEL_REDACT}}"),
    (r"(?:C\.?A\.?L\.?|CAL|CMP|CIP)[\s:N°º]*\d{4,6}", "{{COLEGIATURA_REDACT}}"),
)
EMAIL_SAFETY = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# --- fixed values: the evaluator ------------------------------------------------------------------------------
EVAL_MONEY = r"(?:S/\.?|US?\$|\%|soles|dólares)"

# --- fixed values: the older detector -------------------------------------------------------------------------
OLD_MONEY = ("s/", "s/.", "us$", "$", "soles", "dólares", "dolares", "monto", "suma", "pago", "pen", "usd")
OLD_CASE = r"\b[0-9]{5}-[0-9]{4}-[0-9]-[0-9]{4}-[A-Z]{2}-[A-Z]{2}-[0-9]{2}\b"
OLD_MAILBOX = r"\bcasilla\s+(?:electr[oó]nica\s+)?(?:n[°oº]?\s*)?[0-9]+\b"
OLD_COURT = (
    r"\b(?:[0-9]+[°ºo]?\s*)?juzgado\s+(?:de\s+)?(?:paz\s+letrado|familia|civil|penal|laboral|mixto|comercial)"
    r"(?:\s+(?:de\s+)?[A-Za-záéíóúñÁÉÍÓÚÑ]+){0,4}"
)
OLD_RUC = r"\b[12][0-9]{10}\b"
OLD_DNI = r"\b[0-9]{8}\b"
OLD_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
OLD_PHONES = (r"\+51\s?9[0-9]{8}\b", r"\b9[0-9]{8}\b", r"\b0[1-9][0-9]\s?[0-9]{6,7}\b", r"\([0-9]{2,3}\)\s?[0-9]{6,7}\b")
OLD_ADDRESS_WORDS = (
    r"\bAv(?:enida)?\.?\s+|\bJr(?:\.|irón)?\s+|\bCalle\s+|\bPsje(?:\.|Pasaje)?\s+|\bMz(?:\.|anzana)?\s+|\bLt(?:\.|ote)?\s+|"
    r"\bDpto(?:\.|Departamento)?\s+|\bUrb(?:\.|anizaci[oó]n)?\s+|\bAA\.?HH\.?\s+|\bP\.?J\.?\s+|\bDistrito\s+(?:de\s+)?|\bProvincia\s+(?:de\s+)?"
)
OLD_ADDRESS = rf"(?:{OLD_ADDRESS_WORDS})[A-Za-záéíóúñÁÉÍÓÚÑ0-9\s,.\-°º#]+(?=[\.\n,;]|$)"
OLD_NAME = (
    r"(?:(?:señor|señora|sr\.|sra\.)\s+|(?:don|doña)\s+|(?:el|la)\s+(?:demandante|demandado|demandada)\s+|"
    r"(?:el|la)\s+(?:solicitante|invitado|invitada)\s+|identificad[oa]\s+con\s+(?:DNI|documento)|(?:abogad[oa]|letrad[oa])\s+|"
    r"(?:el|la)\s+(?:menor|menores?)\s+|(?:madre|padre|hijo|hija)\s+|(?:cónyuge|esposo|esposa)\s+|(?:testigo|perito)\s+)"
    r"([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,4})"
)
OLD_CAPITALS = r"\b([A-ZÁÉÍÓÚÑ]{2,}(?:\s+[A-ZÁÉÍÓÚÑ]{2,}){1,4})\b"
OLD_TITLE_CASE = r"\b([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+(?:de\s+(?:la\s+)?)?[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+){1,4})\b"
OLD_RECORD = r"\b(?:acta\s+(?:de\s+)?(?:conciliaci[oó]n|audiencia|constataci[oó]n|inspecci[oó]n)?)\s*(?:n[°oº]?\s*)?[0-9]+[-/]?[0-9]*\b"
OLD_ENTITIES = (
    r"\b(?:banco|caja|financiera|cooperativa)\s+[A-Za-záéíóúñÁÉÍÓÚÑ\s]+(?:\s+S\.?A\.?(?:\.?C\.?)?)?",
    r"\b[A-Z][A-Za-záéíóúñÁÉÍÓÚÑ\s&]+\s+(?:S\.A\.C?\.?|S\.R\.L\.?|E\.I\.R\.L\.?|S\.A\.A\.?)\b",
    r"\b(?:notaría|notaria)\s+(?:de\s+)?[A-Za-záéíóúñÁÉÍÓÚÑ\s]+\b",
)
OLD_ACCOUNTS = (
    r"\b(?:cuenta|cta\.?)\s*(?:de\s+ahorros?|corriente)?\s*(?:n[°oº]?\s*)?[0-9]{10,20}\b",
    r"\b(?:CCI|cci)\s*[:.]?\s*[0-9]{20}\b",
    r"\b[0-9]{3}[-\s]?[0-9]{3}[-\s]?[0-9]{10,14}\b",
)
OLD_PLATE = r"\b(?:placa\s+(?:de\s+rodaje\s+)?)?[A-Z]{3}[-\s]?[0-9]{3}\b"
OLD_SIGNATURES = (
    r"(?:firma(?:do)?|firmante|suscrit[oa])[:.\s]+[^\n]{0,50}", r"_{5,}", r"/s/\s*[A-Za-záéíóúñÁÉÍÓÚÑ\s]+",
    r"(?:FIRMADO\s+(?:POR|DIGITALMENTE))[^\n]*",
)
OLD_SEALS = (r"(?:sello|sellado)[:.\s]+[^\n]{0,50}", r"\[SELLO[^\]]*\]")
OLD_PRINTS = (r"(?:huella\s+(?:digital|dactilar))[:.\s]*[^\n]{0,30}", r"\[HUELLA[^\]]*\]")
OLD_HOMES = (
    r"domicilio\s+(?:real|procesal|legal|fiscal|actual)\s*[:\s]+([^;.\n]+)",
    r"(?:con\s+)?domicilio\s+(?:en|sito\s+en)\s*[:\s]*([^;.\n]+)",
    r"reside\s+en\s*[:\s]*([^;.\n]+)",
    r"ubicad[oa]\s+en\s*[:\s]*([^;.\n]+)",
    r"dirección\s*[:\s]+([^;.\n]+)",
)
OLD_MORE_ADDRESS_WORDS = (
    r"\bAv(?:enida)?\.?\s+|\bAVENIDA\s+|\bJr(?:\.|irón)?\s+|\bJIRON\s+|\bCalle\s+|\bPsje(?:\.|Pasaje)?\s+|\bPASAJE\s+|"
    r"\bMz(?:\.|anzana)?\s+|\bMANZANA\s+|\bLt(?:\.|ote)?\s+|\bLOTE\s+|\bDpto(?:\.|Departamento)?\s+|\bDEPARTAMENTO\s+|"
    r"\bUrb(?:\.|anizaci[oó]n)?\s+|\bURBANIZACION\s+|\bURBANIZACIÓN\s+|\bAA\.?HH\.?\s+|\bP\.?J\.?\s+|\bDistrito\s+(?:de\s+)?|"
    r"\bProvincia\s+(?:de\s+)?|\bN[°oº]?\s*\d+|\bNro\.?\s*\d+|\bBloque\s+|\bPiso\s+\d+|\bPISO\s+|\bInt(?:erior)?\.?\s*\d+"
)
OLD_MORE_ADDRESS = rf"(?:{OLD_MORE_ADDRESS_WORDS})[A-Za-záéíóúñÁÉÍÓÚÑ0-9\s,.\-°º#]+(?=[\.\n,;]|$)"
OLD_MORE_PHONES = (
    r"\+51\s*[-\s]?\s*9\d{2}\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{3}\b", r"\+51\s*9\d{8}\b", r"\b9\d{2}\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{3}\b",
    r"\b9\d{8}\b", r"\(01\)\s*\d{3}\s*[-\s]?\s*\d{4}\b", r"\b01\s*[-\s]?\s*\d{3}\s*[-\s]?\s*\d{4}\b", r"\(\d{2,3}\)\s*\d{6,7}\b",
)
OLD_PHONE_TOLD = r"(?:teléfono|telefono|celular|cel\.?|móvil|movil|fono)\s*[:\s]?\s*(\+?\d[\d\s\-\(\)]{7,15})"
