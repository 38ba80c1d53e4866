"""What a text must contain before a pattern can match it.

Looking for a fixed piece of text is some hundred times cheaper than running a regular expression. Most lines hold none of
the pieces that the attack patterns need, so most patterns are never run. The pieces stand beside each fixed pattern below;
a pattern that is not listed, such as a caller's own, is run as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): classes, word ends and blanks know all letters and digits, not ASCII alone. (?d): only a newline ends a line.
LOWERED = "(?dU)"
OWN = "(?iduU)"


@dataclass(frozen=True)
class Needs:
    """``pieces``: of every group, a match holds one text. ``texts``: a match is exactly one of these texts."""

    pieces: tuple[tuple[str, ...], ...] = ()
    texts: tuple[str, ...] = ()


def needs(*pieces: str | tuple[str, ...]) -> Needs:
    return Needs(tuple((p,) if isinstance(p, str) else p for p in pieces))


def only(*texts: str) -> Needs:
    return Needs(texts=texts)


QUOTES, COMPARED = ("'", '"'), ("=", "<", ">")

#: For the patterns of ``fixed_values`` in lower case: the pieces that a match needs, or the texts that it is.
ATTACK_PIECES: dict[str, Needs] = {
    # database injection
    r"(\bunion\b.*\bselect\b|\bselect\b.*\bfrom\b.*\bwhere\b)": needs("select", ("union", "where")),
    r"('|\")\s*(or|and)\s+[\d\w]+\s*[=<>]": needs(QUOTES, ("or", "and"), COMPARED),
    r"('|\")\s*(or|and)\s+['\"]?\d+['\"]?\s*[=<>]": needs(QUOTES, ("or", "and"), COMPARED),
    r"\b(drop|delete|insert|update|alter)\s+(table|database|into)\b": needs(("table", "database", "into"), ("drop", "delete", "insert", "update", "alter")),
    r"\b(drop|delete|insert|update|alter|truncate)\s+(table|database|into)\b": needs(("table", "database", "into"), ("drop", "delete", "insert", "update", "alter", "truncate")),
    r"1\s*=\s*1|'='|or\s+1\s*=\s*1": needs("=", ("1", "'")),
    r"(1\s*=\s*1|'='|'\s*or\s*'|or\s+1\s*=\s*1)": needs(("=", "or"), ("1", "'")),
    r"(\bexec\b|\bexecute\b)\s*\(": needs("exec", "("),
    r"(;|\-\-|/\*|\*/|@@|char\s*\(|nchar\s*\()": needs((";", "--", "/*", "*/", "@@", "char")),
    r"information_schema|sysobjects|syscolumns": only("information_schema", "sysobjects", "syscolumns"),
    r"'\s*or\s*'": needs("'", "or"),
    r"'\s*=\s*'": needs("'", "="),
    r"or\s+'[^']*'\s*=\s*'": needs("or", "'", "="),
    r"\d+\s*or\s+\d+\s*=\s*\d+": needs("or", "="),
    r"'\s*;\s*--": needs("--", "'", ";"),
    r"admin'\s*--": needs("admin'", "--"),
    # script injection
    r"<script[^>]*>": needs("<script", ">"),
    r"javascript\s*:": needs("javascript", ":"),
    r"on(load|error|click|mouse)\s*=": needs(("onload", "onerror", "onclick", "onmouse"), "="),
    r"on(load|error|click|mouse|focus|blur|change|submit|key)\s*=": needs(
        ("onload", "onerror", "onclick", "onmouse", "onfocus", "onblur", "onchange", "onsubmit", "onkey"), "="),
    r"<iframe[^>]*>": needs("<iframe", ">"),
    r"document\.(cookie|location|write|domain)": only("document.cookie", "document.location", "document.write", "document.domain"),
    r"<img[^>]+on\w+\s*=": needs("<img", "on", "="),
    r"eval\s*\(": needs("eval", "("),
    r"expression\s*\(": needs("expression", "("),
    # paths
    r"\.\.(/|\\|%2f|%5c)": only("../", "..\\", "..%2f", "..%5c"),
    r"\.\./": only("../"),
    r"\.\.\\": only("..\\"),
    r"%2e%2e[%/\\]": only("%2e%2e%", "%2e%2e/", "%2e%2e\\"),
    r"/etc/(passwd|shadow|hosts)": only("/etc/passwd", "/etc/shadow", "/etc/hosts"),
    r"/etc/(passwd|shadow|hosts|group|sudoers)": only("/etc/passwd", "/etc/shadow", "/etc/hosts", "/etc/group", "/etc/sudoers"),
    r"/proc/(self|version)": only("/proc/self", "/proc/version"),
    r"/proc/(self|version|cmdline|environ)": only("/proc/self", "/proc/version", "/proc/cmdline", "/proc/environ"),
    r"c:(\\|/)(windows|winnt|boot\.ini)": needs(("c:\\", "c:/"), ("windows", "winnt", "boot.ini")),
    r"/var/log/": only("/var/log/"),
    # commands
    r"[;&|`]": only(";", "&", "|", "`"),
    r"\$\([^)]+\)": needs("$(", ")"),
    r"\b(wget|curl|nc|bash|sh|cmd|powershell)\b": needs(("wget", "curl", "nc", "sh", "cmd", "powershell")),
    r"\b(wget|curl|nc|netcat|bash|sh|cmd|powershell|python|perl|ruby)\b.*[;&|]": needs((";", "&", "|")),
    r"/bin/(bash|sh|cat|ls|rm|chmod|chown)": only("/bin/bash", "/bin/sh", "/bin/cat", "/bin/ls", "/bin/rm", "/bin/chmod", "/bin/chown"),
    r">(>)?(\s*/dev/null|\s*\d+)?": only(">"),
    # scanners
    r"(nikto|nmap|sqlmap|dirbuster|gobuster|wpscan)": only("nikto", "nmap", "sqlmap", "dirbuster", "gobuster", "wpscan"),
    r"(nikto|nmap|sqlmap|dirbuster|gobuster|wpscan|acunetix|nessus|burp)": only(
        "nikto", "nmap", "sqlmap", "dirbuster", "gobuster", "wpscan", "acunetix", "nessus", "burp"),
    r"/(\.git|\.svn|\.env|\.htaccess)": only("/.git", "/.svn", "/.env", "/.htaccess"),
    r"/(\.git|\.svn|\.env|\.htaccess|\.htpasswd|\.ds_store|\.aws)": only("/.git", "/.svn", "/.env", "/.htaccess", "/.htpasswd", "/.ds_store", "/.aws"),
    r"/wp-(admin|login|includes)": only("/wp-admin", "/wp-login", "/wp-includes"),
    r"/wp-(admin|login|includes|content|config)": only("/wp-admin", "/wp-login", "/wp-includes", "/wp-content", "/wp-config"),
    r"/(phpmyadmin|phpinfo|adminer)": only("/phpmyadmin", "/phpinfo", "/adminer"),
    r"/(phpmyadmin|phpinfo|adminer|server-status|server-info)": only("/phpmyadmin", "/phpinfo", "/adminer", "/server-status", "/server-info"),
    r"/(backup|db|sql|dump|config)\.(zip|tar|gz|sql|bak|old)$": needs(("/backup.", "/db.", "/sql.", "/dump.", "/config.")),
    r"/robots\.txt|/sitemap\.xml": only("/robots.txt", "/sitemap.xml"),
    # inclusion
    r"(file|php|data|expect)://": only("file://", "php://", "data://", "expect://"),
    r"(file|php|zip|data|expect|input|phar)://": only("file://", "php://", "zip://", "data://", "expect://", "input://", "phar://"),
    r"\?.*=.*(\.php|\.txt|\.log)": needs("?", "=", (".php", ".txt", ".log")),
    r"\?.*=.*\.(php|asp|jsp|txt|log|ini|conf)": needs("?", "=", (".php", ".asp", ".jsp", ".txt", ".log", ".ini", ".conf")),
    r"include\s*\(|require\s*\(|include_once|require_once": needs(("include", "require")),
    # markup
    r"<!doctype[^>]*\[": needs("<!doctype", "["),
    r"<!entity": only("<!entity"),
    r"system\s+['\"]": needs("system", QUOTES),
    # sensitive data
    r"password[=:]": only("password=", "password:"),
    r"api[_-]?key[=:]": needs("api", ("key=", "key:")),
    r"secret[=:]": only("secret=", "secret:"),
    r"token[=:]": only("token=", "token:"),
    r"credit[_-]?card": needs("credit", "card"),
    r"\b[a-za-z0-9._%+-]+@[a-za-z0-9.-]+\.[a-z|a-z]{2,}\b": needs("@", "."),
}

#: For the sign-in messages, whose case counts.
MESSAGE_PIECES: dict[str, Needs] = {
    "failed_password": needs("Failed password for ", " from "),
    "accepted_password": needs("Accepted password for ", " from "),
    "invalid_user": needs("Invalid user ", " from "),
    "session_opened": needs("session opened for user "),
    "session_closed": needs("session closed for user "),
    "sudo": needs("COMMAND=", ":"),
    "connection_closed": needs("Connection closed by "),
    "publickey_accepted": needs("Accepted publickey for ", " from "),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _one_of(column: str, options: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(o)})" for o in options) + ")"


def _all_of(column: str, known: Needs) -> str:
    return " AND ".join(_one_of(column, group) for group in known.pieces)


def holds_pieces(column: str, known: Needs) -> Column:
    """Cheap test that is true wherever the pattern of these pieces matches."""
    return F.expr(_all_of(column, known))


def _found(column: str, pattern: str) -> str:
    known = ATTACK_PIECES.get(pattern.lower())
    if known is None:
        return f"({column} RLIKE {_quoted(OWN + pattern)})"
    if known.texts:
        return _one_of(column, known.texts)
    return f"({_all_of(column, known)} AND {column} RLIKE {_quoted(LOWERED + pattern.lower())})"


def _any_found(column: str, patterns: list[str]) -> str:
    fixed_first = sorted(patterns, key=lambda p: not ATTACK_PIECES.get(p.lower(), Needs()).texts)
    return "(" + " OR ".join(_found(column, p) for p in fixed_first) + ")"


def found_in(column: str, pattern: str) -> Column:
    """Whether a lower-cased text column holds a match of a case-blind pattern.

    The test is handed over as one SQL text: it has hundreds of parts, and to
    build each from Python would take longer than to run them on a small input.
    """
    return F.expr(_found(column, pattern))


def any_found_in(column: str, patterns: list[str]) -> Column:
    """Whether any of the patterns is found; those of fixed text are tried first."""
    return F.expr(_any_found(column, patterns))


def case_blind(text: Column) -> Column:
    """A text as the functions above want it. The long s counts as an s."""
    return F.replace(F.lower(text), F.lit("ſ"), F.lit("s"))
