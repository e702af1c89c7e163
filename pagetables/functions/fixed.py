"""Values that must be the same wherever the pages are read."""

# --- Fixed values: selectors of elements to remove, in the order they are tried ---

TECHNICAL_SELECTORS = [
    'script:not([type="application/ld+json"])',
    "style", "noscript", "iframe", "svg", "canvas",
    "video", "audio", "object", "embed", "applet",
]

JSON_LD_SELECTOR = 'script[type="application/ld+json"]'

HIDDEN_SELECTORS = [
    '[aria-hidden="true"]',
    "[hidden]",
    ".hidden", ".hide", ".invisible",
    ".sr-only", ".visually-hidden", ".screen-reader-text",
    '[style*="display: none"]', '[style*="display:none"]',
    '[style*="visibility: hidden"]', '[style*="visibility:hidden"]',
]

BOILERPLATE_SELECTORS = [
    "nav", "header", "footer", "aside",
    '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]',
    ".nav", ".navigation", ".navbar", ".header", ".footer", ".sidebar",
    ".cookie-banner", ".cookie-notice", ".cookie-consent", ".gdpr",
    ".popup", ".modal", ".overlay", ".lightbox",
    ".advertisement", ".ad", ".ads", ".advert", '[class*="ad-"]',
    ".social-share", ".share-buttons", ".social-icons",
    ".newsletter", ".subscribe", ".signup",
    ".breadcrumb", ".breadcrumbs",
    "#comments", ".comments", ".comment-section",
]

BUTTON_SELECTORS = [
    "button", '[role="button"]', 'input[type="submit"]', 'input[type="button"]',
    ".btn", ".button",
]

# --- Fixed values: required fields per entity type (types not listed require nothing) ---

REQUIRED_FIELDS = {
    "Product": ["name"],
    "Recipe": ["name"],
    "Event": ["name"],
    "LocalBusiness": ["name"],
    "Article": ["headline"],
    "BlogPosting": ["headline"],
    "FAQPage": [],
    "HowTo": ["name"],
    "WebPage": ["name"],
    "WebSite": ["name"],
    "ItemList": ["itemListElement"],
    "VideoObject": ["name"],
    "Organization": ["name"],
}

# --- Fixed values: document wording and limits ---

CLOSING_LINE = (
    "Extract the structured data from the above content. Choose the most specific "
    "schema type. Return null for any fields where data is not explicitly present."
)
CLOSING_LINE_WITH_JSON_LD = (
    CLOSING_LINE + " Use EXISTING JSON-LD as the primary source if available."
)
JSON_LD_NOTE = "(Use this as authoritative source, repair if needed)"
DOCUMENT_LINK_LIMIT = 30
PREVIEW_IMAGE_LIMIT = 10
PREVIEW_LINK_LIMIT = 20
MIN_PARAGRAPH_LENGTH = 20
CHARS_PER_TOKEN = 4

# --- Fixed values: reasons ---

URL_REQUIRED = "URL is required"
URL_INVALID = "Invalid URL format"
NOTHING_ACCEPTED = "No valid entities after validation"
BAD_EXTRACTION = "Entity without a string @type"

# --- Fixed values of the HTML standard: element classes ---

VOID_TAGS = [
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
]

# Elements whose content is text up to their own end tag.
RAW_TEXT_TAGS = [
    "script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp",
]

# Elements that always need an end tag and that end everything opened inside them.
CONTAINER_TAGS = [
    "address", "applet", "article", "aside", "audio", "blockquote", "button", "canvas",
    "caption", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "main", "marquee", "math", "menu", "nav", "noscript",
    "object", "ol", "pre", "search", "section", "select", "summary", "svg", "table",
    "template", "ul", "video",
]

# A start tag of these ends an open paragraph.
PARAGRAPH_ENDERS = [
    "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog",
    "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu",
    "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul", "xmp",
]

SECTION_TAGS = ["tbody", "thead", "tfoot"]
CELL_TAGS = ["td", "th"]

# Elements that may stand before the body starts.
HEAD_TAGS = [
    "html", "head", "title", "meta", "link", "style", "script", "base", "noscript",
    "template",
]

# Code points 128 to 159 that character references read as windows-1252.
WINDOWS_1252 = {
    128: 8364, 130: 8218, 131: 402, 132: 8222, 133: 8230, 134: 8224, 135: 8225,
    136: 710, 137: 8240, 138: 352, 139: 8249, 140: 338, 142: 381, 145: 8216,
    146: 8217, 147: 8220, 148: 8221, 149: 8226, 150: 8211, 151: 8212, 152: 732,
    153: 8482, 154: 353, 155: 8250, 156: 339, 158: 382, 159: 376,
}
