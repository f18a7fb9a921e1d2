"""Regular expressions, word lists and message texts.

Java patterns run inside ``regexp_*`` on the executors. They use possessive quantifiers and
look-around so that every search is linear in the text: no run of characters is rescanned from each
of its positions, and no quantifier recurses.
"""

from __future__ import annotations

import unicodedata

# --- Fixed values: these must be exactly so for results to match ---------------------------------

# Suffixes of URL paths that are never followed.
STATIC_SUFFIXES = (
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico",
    ".woff", ".woff2", ".ttf", ".eot", ".css",
    ".mp4", ".mp3", ".avi", ".mov", ".pdf",
    ".zip", ".tar", ".gz", ".rar",
)

# Root paths looked up among captured responses.
WELL_KNOWN_PATHS = (
    ".env",
    ".git/config",
    ".git/HEAD",
    "backup.zip",
    "backup.sql",
    "config.php.bak",
    "swagger.json",
    "swagger-ui.html",
    "api-docs",
    "api/swagger.json",
    "robots.txt",
    "sitemap.xml",
    ".well-known/security.txt",
    "server-status",
    ".DS_Store",
    "wp-config.php.bak",
    "web.config",
    "docker-compose.yml",
    "id_rsa",
)

# Content types whose body is kept as text.
TEXT_CONTENT_MARKS = ("text", "javascript", "json")

# Parameter and form-field names.
IDOR_NAMES = (
    r"id|user_?id|account_?id|order_?id|invoice_?id|doc_?id|file_?id|"
    r"uid|uuid|pid|cust(omer)?_?id|profile_?id|record_?id"
)
ADMIN_NAMES = r"admin|debug|internal|staff|superuser"
NOT_IN_PARAM_NAMES = r"[^a-zA-Z0-9_\-\[\]]"  # what cleaning takes out of a name
CSRF_NAMES = r"csrf|token|_token|authenticity"

# Form issue texts, in reporting order.
ISSUE_PASSWORD_GET = "password-like field submitted via GET (may leak into logs/history)"
ISSUE_NO_CSRF = "POST form with no obvious CSRF token field"
ISSUE_FILE = "file upload field present"

# Base patterns of the text extractors.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
COMMENT = r"<!--(.*?)-->"
URL_PARAM = r"[?&]([a-zA-Z0-9_\[\]\.]+)="
ENDPOINT_PATTERNS = {
    "full_urls": r"""https?://[^\s'"<>)]+""",
    "api_paths": r"""["'](/[a-zA-Z0-9_\-/]*(?:api|v[0-9]+|graphql|rest)[a-zA-Z0-9_\-/]*)["']""",
    "graphql_endpoints": r"""["'](/[^"']*graphql[^"']*)["']""",
    "websocket_endpoints": r"""wss?://[^\s'"<>)]+""",
    "s3_buckets": r"""[a-zA-Z0-9\-_.]+\.s3(?:[.\-][a-zA-Z0-9\-]+)?\.amazonaws\.com""",
    "firebase_urls": r"""[a-zA-Z0-9\-_]+\.firebaseio\.com""",
    "swagger_docs": r"""["']([^"']*(?:swagger|openapi)[^"']*\.json)["']""",
}
ENDPOINT_IGNORE_CASE = ("api_paths", "graphql_endpoints", "swagger_docs")

COMMENT_MIN_LENGTH = 5  # a comment is kept when it is longer than this
COMMENT_CUT = 300
CAPTURE_KEY_CUT = 150

# --- Whitespace ------------------------------------------------------------------------------------

# The white space of Python's str.strip and \s, as a character-class body. Java's \s is ASCII only.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRIP_SPACE = rf"\A[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# --- Text extractors, linear forms of the base patterns ---------------------------------------------


def _run_start(chars: str) -> str:
    """Start only where a run of ``chars`` starts, or where the previous match ended inside one.

    A search that fails from the first position of a run fails from all later ones too, so nothing is
    lost, and a long run is read once instead of once per character.
    """
    return rf"(?:\G|(?<![{chars}]))"


EMAIL_LINEAR = (
    _run_start(r"A-Za-z0-9._%+\-") + r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
)
# Where one comment has no end no later one has: take the rest of the text instead of searching it again.
COMMENT_LINEAR = r"(?s)<!--(?:(.*?)-->|.*+)"

CSRF_FIELD = f"(?iu)(?:{CSRF_NAMES})"

# category -> (java pattern, group, literals of which one must be in the text). Where the pattern ignores
# case the literals are looked for in the lower-cased text; they leave out letters with odd case pairs.
ENDPOINTS_LINEAR = {
    "full_urls": (rf"""https?://[^{SPACE}'"<>)]++""", 0, ("://",)),
    "api_paths": (
        r"""(?iu)["'](?=[a-zA-Z0-9_\-/]*+["'])"""
        r"""(/[a-zA-Z0-9_\-/]*(?:api|v[0-9]+|graphql|rest)[a-zA-Z0-9_\-/]*+)["']""",
        1,
        (),
    ),
    "graphql_endpoints": (
        r"""(?iu)["'](?=[^"']*+["'])(/[^"']*graphql[^"']*+)["']""",
        1,
        ("graphql",),
    ),
    "websocket_endpoints": (rf"""wss?://[^{SPACE}'"<>)]++""", 0, ("://",)),
    "s3_buckets": (
        _run_start(r"a-zA-Z0-9\-_.")
        + r"[a-zA-Z0-9\-_.]+\.s3(?:[.\-][a-zA-Z0-9\-]+)?\.amazonaws\.com",
        0,
        (".amazonaws.com",),
    ),
    "firebase_urls": (
        _run_start(r"a-zA-Z0-9\-_") + r"[a-zA-Z0-9\-_]++\.firebaseio\.com",
        0,
        (".firebaseio.com",),
    ),
    "swagger_docs": (
        r"""(?iu)["'](?=[^"']*+(?<=\.json)["'])([^"']*(?:swagger|openapi)[^"']*\.json)["']""",
        1,
        ("wagger", "openap"),
    ),
}

# --- Markup -----------------------------------------------------------------------------------------

# What may stand between a tag name and its closing bracket. A quote only opens a value after "=",
# and a value that is never closed makes the whole tag plain text.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
ATTRIBUTES = rf"""(?:[^>=/]++|/(?!>)|=++\s*+{_VALUE}|=(?!\s*+["'=]))*+"""
_END_OF_NAME = r"(?=[\s/>])"
_RAW_TEXT = r"style|title|textarea|xmp|iframe|noembed|noframes"
_COMMENT_MARKUP = r"!--(?:-?+>|.*?(?:--!?+>|\z))"
# A tag that never ends (no bracket, or a quote left open) takes the rest of the page, as tokenizers do.
_OTHER_MARKUP = rf"[a-zA-Z]{ATTRIBUTES}(?:/?+>|.*+)|[!?/][^>]*+>?+"
_SCRIPT_OPEN = rf"script{_END_OF_NAME}{ATTRIBUTES}>"
_SCRIPT_CLOSE = rf"(?:</script{_END_OF_NAME}[^>]*+>?+|\z)"
_RAW_ELEMENT = (
    rf"({_RAW_TEXT}){_END_OF_NAME}{ATTRIBUTES}>.*?(?:</\2{_END_OF_NAME}[^>]*+>?+|\z)"
)

# One left-to-right pass over the page each. Group 1 is the wanted piece, without its opening bracket, and
# empty for everything else; the bracket stands first in the pattern so that plain text is skipped fast.
LINK_TAGS = (
    rf"(?is)<(?:{_COMMENT_MARKUP}|{_SCRIPT_OPEN}.*?{_SCRIPT_CLOSE}"
    rf"|((?:a|link|area){_END_OF_NAME}{ATTRIBUTES}/?+>)|{_RAW_ELEMENT}|{_OTHER_MARKUP})"
)
SCRIPT_ELEMENTS = (
    rf"(?is)<(?:{_COMMENT_MARKUP}|({_SCRIPT_OPEN}.*?(?=</script{_END_OF_NAME}|\z)"
    rf"|script{_END_OF_NAME}{ATTRIBUTES}/>)|{_RAW_ELEMENT}|{_OTHER_MARKUP})"
)
SCRIPT_OPEN_TAG = rf"(?is)\Ascript{_END_OF_NAME}{ATTRIBUTES}/?+>"
TAG_NAME = r"\A([a-zA-Z]+)"

# Tags that matter for which fields a form holds: whole for form and field tags, only the name for all
# other opening and closing tags (they decide where an unclosed or mis-nested form ends).
_FIELD_TAG = rf"(?:form|input|textarea|select){_END_OF_NAME}{ATTRIBUTES}/?+"
_OTHER_NAME = rf"/?+[a-zA-Z][^\s/>]*+(?={ATTRIBUTES}>)"
FORM_PARTS = (
    rf"(?is)<(?:{_COMMENT_MARKUP}|{_SCRIPT_OPEN}.*?{_SCRIPT_CLOSE}"
    rf"|(?=({_FIELD_TAG}(?=>)|{_OTHER_NAME}))(?:{_RAW_ELEMENT}|[a-zA-Z/]{ATTRIBUTES}/?+>)"
    rf"|{_OTHER_MARKUP})"
)
HAS_FORM = r"(?i)<form[\s/>]"


def attribute(name: str) -> str:
    """Pattern whose group 1 is the text of attribute ``name``, empty for every other attribute."""
    value = r"""(?:\s*+=++\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
    return rf"(?is)({name}(?![^\s/>=]){value})|[^\s/>=]++{value}"


ATTRIBUTE_VALUE = r"""(?s)\A[^=]*+(?:=++\s*+(?:"([^"]*+)"|'([^']*+)'|(.*+)))?+\z"""
# Text cut at character references; a name without ";" does not count right before "=".
REFERENCE = r"&(?:#[0-9]++;?+|#[xX][0-9a-fA-F]++;?+|[a-zA-Z][a-zA-Z0-9]*+(?:;|(?!=)))"
REFERENCE_PIECES = rf"(?s){REFERENCE}|&|[^&]++"

DECIMAL_REFERENCE = r"\A&#([0-9]++);?\z"
HEX_REFERENCE = r"\A&#[xX]([0-9a-fA-F]++);?\z"
LEADING_ZEROS = r"\A0+(?=.)"

# --- URLs -------------------------------------------------------------------------------------------

SCHEME = r"\A([a-zA-Z][a-zA-Z0-9+.\-]*+):"
URL_PARTS = (
    r"(?s)\A(?:[a-zA-Z][a-zA-Z0-9+.\-]*+:)?(?://([^/?#]*+))?([^?#]*+)(?:\?([^#]*+))?(?:#(.*+))?"
)
PATH_PARAMS = r"(?s)\A((?:.*/)?[^/;]*+)(?:;(.*+))?\z"
LAST_SEGMENT = r"(?s)(?:(?<=/)|\A)[^/]++\z"
BRACKETED = r"\A[^\[]*+\[([^\]]*+)"
NOT_ASCII = r"[^\x00-\x7f]"
DOT_SEGMENT = r"(?:\A|/)\.\.?(?:/|\z)"
# A root-relative path with nothing to clean, cut or collapse.
PLAIN_ROOT_PATH = rf"\A/(?!/)[^?#;\x00-\x20{SPACE}]*+\z"

# Schemes that take part in relative resolution, that carry a host, and that may have ";" parameters
# (the lists of the public URL standard library).
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)
HOST_SCHEMES = RELATIVE_SCHEMES + (
    "telnet", "snews", "rsync", "nfs", "git", "git+ssh", "itms-services",
)
PARAM_SCHEMES = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
    "sip", "sips", "mms", "sftp", "tel",
)

# Characters that turn into a URL delimiter under compatibility normalisation: not allowed in a host.
HOST_LOOKALIKES = "".join(
    chr(c)
    for c in range(0x80, 0x10000)
    if not 0xD800 <= c <= 0xDFFF and set(unicodedata.normalize("NFKC", chr(c))) & set("/?#@:")
)
_H16 = "[0-9a-fA-F]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_LS32 = rf"(?:{_H16}:{_H16}|(?:{_OCTET}\.){{3}}{_OCTET})"
# RFC 3986: six groups and a tail, or up to n groups, "::" and what is left of the other side.
IPV6 = (
    r"\A(?:"
    + "|".join(
        [rf"(?:{_H16}:){{6}}{_LS32}"]
        + [
            rf"(?:(?:{_H16}:){{0,{max(5 - right - 1, 0)}}}{_H16}){{0,{min(5 - right, 1)}}}"
            rf"::(?:{_H16}:){{{right}}}{_LS32}"
            for right in range(5, -1, -1)
        ]
        + [
            rf"(?:(?:{_H16}:){{0,5}}{_H16})?::{_H16}",
            rf"(?:(?:{_H16}:){{0,6}}{_H16})?::",
        ]
    )
    + r")(?:%[^%]+)?\z"
)
IP_FUTURE = r"\Av[a-fA-F0-9]+\..+\z"
