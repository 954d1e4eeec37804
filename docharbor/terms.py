"""The word lists, tables and weights that results depend on."""

# Links that a crawl leaves out, and path hints that make a link worth following from a site's root.
CRAWL_NOISE = ("cookie", "privacy", "legal", "terms", "career", "jobs", "investor", "press", "news", "media", "support", "documentation", "contact", "login", "auth", "register", "shop")
CRAWL_HINTS = ("products", "product", "document", "publication", "download", "file", "recueil", "arrete", "magnetic-resonance-imaging", "computed-tomography", "ultrasound", "mammography", "x-ray", "radiography", "laboratory-diagnostics", "medical-imaging")

# Focused crawl: noise for filtering and excluding, noise for ranking, focus terms, hints and weights by modality.
FOCUS_NOISE = ("cookie", "privacy", "legal", "terms", "career", "jobs", "investor", "press", "news", "media", "support", "documentation", "contact", "login", "auth", "register", "shop", "event", "blog", "sitemap", "about")
RANK_NOISE = ("cookie", "privacy", "legal", "terms", "career", "jobs", "investor", "press", "news", "media", "support", "documentation", "login", "auth", "register", "shop")
FOCUS_TERMS = ("product", "products", "system", "systems", "scanner", "scanners", "platform", "family", "solutions", "solution", "modality", "mri", "ct", "ultrasound", "mammography", "radiography", "x-ray", "xray", "pet", "molecular", "lab", "diagnostics")
GENERIC_TERMS = ("system", "scanner", "platform", "family", "device")
MODALITIES = {
    "mri": ("mri", "magnetic-resonance", "magnetic-resonance-imaging", "magnetom"),
    "ct": ("ct", "computed-tomography", "somatom", "revolution"),
    "ultrasound": ("ultrasound", "ultra-sound", "sono"),
    "mammography": ("mammography", "mammo"),
    "radiography": ("radiography", "x-ray", "xray", "digital-radiography"),
    "pet": ("pet", "molecular-imaging", "biograph"),
    "lab": ("lab", "laboratory", "diagnostics", "cobas", "atellica"),
}
RANK_WEIGHTS = {
    "mri": {"magnetom": 9, "magnetic-resonance-imaging": 8, "magnetic-resonance": 7, "mri": 3},
    "ct": {"somatom": 9, "computed-tomography": 8, "ct": 3},
    "ultrasound": {"ultrasound": 8, "sono": 6},
    "mammography": {"mammography": 8, "mammo": 6},
    "radiography": {"radiography": 8, "x-ray": 7, "xray": 7},
    "pet": {"biograph": 9, "molecular-imaging": 8, "pet": 4},
    "lab": {"cobas": 9, "atellica": 8, "diagnostics": 4, "lab": 3},
}

# Files.
DOCUMENT_EXTENSIONS = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".csv", ".txt", ".rtf", ".zip")
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".tif", ".tiff", ".bmp")
FILE_EXTENSIONS = DOCUMENT_EXTENSIONS + IMAGE_EXTENSIONS
DISCOVERY_TERMS = ("document", "publication", "download", "file", "attachment", "recueil", "arrete", "arrêté")
CONTENT_TYPES = {
    "application/pdf": ".pdf",
    "application/msword": ".doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.ms-excel": ".xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-powerpoint": ".ppt",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "text/csv": ".csv",
    "text/plain": ".txt",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/tiff": ".tiff",
    "image/bmp": ".bmp",
}
LISTING_PARAMS = {
    "productgroups": "product-groups",
    "products": "products",
    "documenttypes": "document-types",
    "languages": "document-languages",
    "countries": "countries",
    "sortingby": "sort",
    "search": "search",
    "partnumber": "part-number",
    "productcode": "product-code",
    "version": "version",
    "lotnumber": "lot-number",
}
LISTING_PAGE_SIZE = 40

# Gazettes of the regional prefectures.
PORTAL = "https://www.prefectures-regions.gouv.fr/"
PORTAL_HOSTS = ("www.prefectures-regions.gouv.fr", "prefectures-regions.gouv.fr")
REGION_EXCLUDED = ("", "contact", "informations", "le-savez-vous", "outils")
GAZETTE_TEXT = ("recueil des actes administratifs", "recueils des actes administratifs", "recueil regional des actes administratifs", "recueils regionaux des actes administratifs")
GAZETTE_PATH = (
    "recueil-des-actes-administratifs",
    "recueils-des-actes-administratifs",
    "recueil-regional-des-actes-administratifs",
    "recueils-regionaux-des-actes-administratifs",
    "recueil+des+actes+administratifs",
    "recueils+des+actes+administratifs",
    "recueil+regional+des+actes+administratifs",
)
PATH_NOISE = ("/outils/", "/glossaire", "/faq", "/contact", "/mentions-legales")
NON_HTML = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".jpg", ".jpeg", ".png", ".gif")
MONTHS = {
    "janvier": "January",
    "fevrier": "February",
    "mars": "March",
    "avril": "April",
    "mai": "May",
    "juin": "June",
    "juillet": "July",
    "aout": "August",
    "septembre": "September",
    "octobre": "October",
    "novembre": "November",
    "decembre": "December",
}
YEARS = tuple(range(2010, 2036))
PAGINATION = ("suivant", "precedent", "page suivante", "page precedente")
BLOCKED_HOSTS = ("facebook.com", "twitter.com", "x.com", "linkedin.com")
GAZETTE_DEPTH, GAZETTE_SCANS, GAZETTE_PAGES, GAZETTE_ROOTS = 3, 80, 120, 3
DAILY_EXCLUDED_REGIONS = ("corse",)

# Text quality of blocks and pages.
URL_NOISE = ("cookie", "privacy", "legal", "terms", "consent", "login", "auth", "register", "event", "shop", "support", "career", "news", "investor")
USEFUL_TERMS = (
    "mri",
    "magnetic resonance",
    "ct",
    "computed tomography",
    "ultrasound",
    "mammography",
    "x-ray",
    "radiography",
    "molecular imaging",
    "laboratory diagnostics",
    "core lab",
    "point of care",
    "pathology",
    "product",
    "system",
    "scanner",
    "platform",
    "solution",
    "specification",
    "brochure",
    "request quote",
    "contact sales",
    "workflow",
    "detector",
    "throughput",
    "tesla",
    "slice",
    "bore",
    "channel",
)
FAMILIES = ("somatom", "magnetom", "acuson", "atellica", "mammomat", "epiq", "affiniti", "ingenia", "incisive", "azurion", "lumify", "signa", "revolution", "venue", "voluson", "discovery", "definium", "cobas", "elecsys", "lightcycler", "navify")
NOISE_PATTERNS = (
    r"\bcookieconsent\b",
    r"\bprivacy policy\b",
    r"\bhttp cookie\b",
    r"\bhtml local storage\b",
    r"\bindexeddb\b",
    r"\bsession\b",
    r"\bpersistent\b",
    r"\bphpsessid\b",
    r"\barrAffinity\b",
    r"\b__cf_bm\b",
    r"\bauth0\b",
    r"\bcookiebot\b",
    r"\bwalkme\b",
    r"\bused to store\b",
    r"\bused to distribute traffic\b",
    r"\bdistinguish between humans and bots\b",
    r"\buser session state\b",
    r"\bboolean cookie\b",
    r"\bregistrationformid\b",
    r"\blocalization of buttons and labels\b",
    r"\bselect your country\b",
    r"\binternational homepage\b",
    r"\baccept all cookies\b",
    r"\bmanage preferences\b",
    r"\bsign up\b",
    r"\blog in\b",
    r"\bselect another country or region\b",
    r"\bcontent specific to your location\b",
)
SPEC_PATTERNS = (
    r"\b\d+(?:\.\d+)?\s*tesla\b",
    r"\b\d+\s*slice\b",
    r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\s*bore\b",
    r"\b\d+(?:,\d{3})?\s*(?:tests?|samples?)\s*/\s*(?:hour|hr|h)\b",
    r"\b\d+\s*channel\b",
    r"\b\d+(?:\.\d+)?\s*(?:cm|mm)\b",
)
FALLBACK_PATTERNS = (r"\bpage (?:was )?not found\b", r"\b404\b", r"\bwe moved the page\b", r"\bdeleted it\b", r"\bcheck if (?:the )?url\b", r"\balternate recommendations\b")
NAVIGATION = ("home", "search", "contact us", "products & services", "products and services", "help us to improve")
COOKIE_WORDS = ("cookie", "session", "local storage", "privacy", "auth0", "persistent")
LEGAL_URL = ("privacy", "cookie", "legal", "terms")
GERMAN_HINTS = ("nachhaltige", "gesundheitswesen", "aktuelle", "kundengeschichten", "wirtschaftlichkeit", "beschließt", "hochhaus", "universitätsklinikum", "sichere", "hygiene", "im klinikalltag", "zukunftsfähige", "hochmoderne", "setzt neue standards")

#: A rule of a markdown table.
TABLE_RULE = r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"

# Source pages.
COOKIE_MARKERS = ("cookieconsent", "http cookie", "html local storage", "indexeddb", "privacy policy", "used to store", "session state", "auth0", "cookiebot")
CONTENT_HINTS = ("mri", "magnetic resonance", "ct", "computed tomography", "ultrasound", "mammography", "radiography", "x-ray", "laboratory diagnostics", "scanner", "system", "platform", "workflow", "product", "solution")
RICH_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "td", "th", "a", "span", "div")
LINK_NOISE = ("cookie", "privacy", "legal", "terms", "auth", "login", "register", "consent", "cookiebot", "auth0", "walkme", "privacystatement")
LOCALES = ("en-us", "us", "en", "global")
BLOCK_SIGNALS = {
    "access_denied": ("access denied", "403 forbidden", "you don't have permission", "error reference #", "edgesuite.net"),
    "captcha": ("captcha", "recaptcha", "i'm not a robot", "please verify", "bot detection", "cloudflare ray id"),
    "login_wall": ("sign in to continue", "log in to view", "create an account to", "for healthcare professionals only", "hcp only"),
    "geo_redirect": ("startseite", "diagnostik gemeinsam", "sie verlassen", "befinden sich", "zum inhalt"),
    "geo_picker": ("take me to our location", "select your country", "select a country", "choose your location", "international homepage", "where are you located"),
}

# Structured pages and product records. Selectors are (kind, value) with kind tag, role, class or id; a * means "contains".
PAGE_NOISE_TAGS = ("script", "style", "noscript", "iframe", "header", "footer", "nav", "aside", "dialog")
PAGE_NOISE_ROLES = ("navigation", "banner", "contentinfo")
PAGE_NOISE_PARTS = ("cookie", "consent", "privacy")
TEXT_NOISE_TAGS = ("nav", "header", "footer", "aside", "script", "style", "noscript", "iframe", "form", "dialog")
TEXT_NOISE_CLASSES = ("nav", "navbar", "header", "footer", "sidebar", "cookie-banner", "ad", "ads", "advertisement", "popup")
TEXT_NOISE_IDS = ("cookie-notice",)
TEXT_NOISE_PARTS = ("cookie", "consent", "privacy", "newsletter", "login", "auth")
TEXT_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "figcaption")
COOKIE_TABLE = ("cookie", "privacy", "session", "local storage", "consent")
SPEC_TABLE = ("tesla", "bore", "slice", "throughput", "detector", "parameter", "spec")
PARAMETERS = {
    "field_strength": r"\b\d+(?:\.\d+)?\s*T(?:esla)?\b",
    "injected_dose": r"Injected dose:\s*([^\n]+)",
    "uptake_time": r"Uptake time:\s*([^\n]+)",
    "mr_ta": r"MR TA:\s*([^\n]+)",
    "pet_ta": r"PET TA:\s*([^\n]+)",
    "scan_range": r"Total scan range:\s*([^\n]+)",
    "sequences": r"Sequences:\s*([^\n]+)",
    "weight": r"\b\d+\s*kg\b",
}
RECORD_MODALITIES = {"mri": ("mri", "magnetic resonance"), "ct": ("ct", "computed tomography"), "pet_mr": ("pet/mr", "pet mr"), "ultrasound": ("ultrasound",), "radiography": ("radiography", "x-ray")}
RECORD_FAMILIES = ("magnetom", "somatom", "biograph", "epiq", "ingenia", "revolution", "signa", "cobas")
DATE_META = ("article:published_time", "article:modified_time", "date", "dc.date", "dcterms.date")
