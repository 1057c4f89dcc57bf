"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER_NAME = r"(?im)^[ \t/*#@]*Plugin Name:"

# Phrases of advisory labels in the order in which they decide.
ADVISORY_EXACT = {
    "SQL Injection": "sqli", "Cross Site Request Forgery (CSRF)": "csrf", "Cross Site Scripting (XSS)": "xss", "PHP Object Injection": "deserial", "Deserialization of untrusted data": "deserial",
    "Remote Code Execution (RCE)": "rce", "Arbitrary Code Execution": "rce", "Broken Access Control": "auth", "Broken Authentication": "auth", "Privilege Escalation": "auth", "Bypass Vulnerability": "auth",
    "Insecure Direct Object References (IDOR)": "auth", "Local File Inclusion": "lfi", "Path Traversal": "lfi", "Arbitrary File Download": "lfi", "Server Side Request Forgery (SSRF)": "ssrf", "Arbitrary File Upload": "upload",
    "Sensitive Data Exposure": "other", "CSV Injection": "other", "Arbitrary File Deletion": "other", "Multiple Vulnerabilities": "other",
}
ADVISORY_PHRASES = (
    ("sqli", ("sql",)), ("deserial", ("object injection", "deserial")), ("csrf", ("cross-site request forgery", "cross site request forgery", "csrf")),
    ("ssrf", ("server side request forgery", "server-side request forgery", "ssrf")), ("xss", ("cross-site scripting", "cross site scripting", "xss", "web page generation")),
    ("auth", ("missing authorization", "broken access", "authentication", "privilege", "bypass", "idor", "insecure direct object", "authorization")), ("upload", ("file upload", "upload")),
    ("lfi", ("local file inclusion", "path traversal", "directory traversal", "file download", "file inclusion", "lfi")), ("rce", ("remote code execution", "arbitrary code", "command injection", "code injection", "rce")),
)
# Substrings of tools' own labels in the order in which they decide.
TOOL_PHRASES = (
    ("sqli", ("sql", "tainted-sql")), ("xss", ("xss", "cross-site-scripting", "tainted-html", "echoed-request")), ("lfi", ("lfi", "rfi", "file-inclusion", "path-traversal", "tainted-filename", "include", "require")),
    ("rce", ("rce", "code-execution", "command-injection", "eval", "tainted-exec", "os-command", "system")), ("deserial", ("deserial", "unserialize", "object-injection")), ("ssrf", ("ssrf", "server-side-request")),
    ("upload", ("upload", "move-uploaded", "arbitrary-file-upload")), ("auth", ("auth", "access-control", "capability", "privilege", "nonce-missing")), ("csrf", ("csrf", "nonce", "cross-site-request")),
)


def header(c: str, field: str) -> Column:
    """Value of a header line ``field: value``, empty if there is none."""
    return F.trim(F.regexp_extract(c, rf"(?im)^[ \t/*#@]*{field}:[ \t]*([^\r\n]+)", 1))


def cascade(c: str, phrases) -> Column:
    """The first class one of whose phrases occurs in the lower-cased text, else ``other``."""
    low, out = F.lower(F.col(c)), F.lit("other")
    for name, words in reversed(phrases):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def advisory_class(c: str) -> Column:
    """Class of an advisory's label: exact names first, then phrases."""
    out = cascade(c, ADVISORY_PHRASES)
    for k, v in ADVISORY_EXACT.items():
        out = F.when(F.col(c) == k, F.lit(v)).otherwise(out)
    return out


def tool_class(c: str) -> Column:
    return cascade(c, TOOL_PHRASES)


# Names that tell the producing tool, and the form and namespaces of its rules' identifiers.
TOOL_NAMES = (r"semgrep", r"progpilot", r"wp[-_ ]?taint", r"taint[-_ ]?scan", r"wpt")
_WORD = r"\p{L}\p{N}_"
RULE_NAME = rf"^[{_WORD}-]+(\.[{_WORD}-]+){{2,}}$"
RULE_SPACE = rf"(?i)(^|[^{_WORD}])(php\.lang|php\.security|semgrep|progpilot)($|[^{_WORD}])|(^|[^{_WORD}])generic\.[{_WORD}]"


def rule_name(token: Column) -> Column:
    """Whether a whole token is a rule's identifier: three or more dotted parts, or one of the known namespaces in it."""
    return token.rlike(RULE_NAME) | token.rlike(RULE_SPACE)


def scrub(c: str, names=TOOL_NAMES) -> Column:
    """Text without names of tools; tokens between blanks that are rules' identifiers become ``[rule]``.

    What a word's letter is is spelled out, so that the borders of names are the same in every engine. The pattern
    runs twice, as neighbouring names share the character between them.
    """
    tools = f"(?i)(^|[^{_WORD}])({'|'.join(names)})($|[^{_WORD}])"
    plain = F.regexp_replace(F.regexp_replace(F.col(c), tools, "$1[tool]$3"), tools, "$1[tool]$3")
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.when(rule_name(t), F.lit("[rule]")).otherwise(t)), " ")


def neutral_sink(c: str) -> Column:
    """Sink for reviewers' eyes: a rule's identifier becomes the category its last part names, other symbols are scrubbed; null and blank ones are empty."""
    sink = F.trim(F.coalesce(F.col(c), F.lit("")))
    leaf = F.trim(F.translate(F.element_at(F.split(sink, r"\."), -1), "-_", "  "))
    named = F.when(leaf != "", F.concat(F.lit("(sink category: "), leaf, F.lit(")"))).otherwise(F.lit("(sink category: unspecified)"))
    return F.when(sink == "", F.lit("")).when(rule_name(sink), named).otherwise(scrub(c))


def canonical_hash(*fields: str) -> Column:
    """SHA-256 of the fields as JSON with sorted keys, no blanks and nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
