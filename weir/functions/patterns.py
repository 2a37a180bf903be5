"""Patterns of the request features."""

from __future__ import annotations

# The features are defined as counts or tests of exactly these
# patterns. (?i) marks those without regard to case.
SQL_KEYWORDS = r"(?i)\b(select|union|insert|update|delete|drop|create|alter|exec(?:ute)?|where|from\b|into\b|null\b|like\b|between|exists|having|order\s+by|group\s+by|cast\b|convert\b|char\b|varchar|concat|count\b|sleep\b|benchmark|substr(?:ing)?|mid\b|ascii\b|hex\b|unhex|load_file|outfile|dumpfile|information_schema|schema\b|database\(|version\(|user\()"
SQLI_COMMENT = r"(--|#(?!\d)|/\*|\*/)"
SQLI_OPERATOR = r"(<>|!=|>=|<=|(?<![<>!])=(?!=))"
UNION = r"(?i)\bunion\b"
SELECT = r"(?i)\bselect\b"
FORM_FIELD = r"(^|&)[a-zA-Z_][a-zA-Z0-9_]*="
XSS_MARKER = r"""(?i)(<\s*script|<\s*/\s*script|<\s*img|<\s*svg|<\s*iframe|<\s*body|<\s*input|on(?:error|load|click|mouseover|mouseout|focus|input|keyup|keydown)\s*=|javascript\s*:|alert\s*\(|confirm\s*\(|prompt\s*\(|document\.cookie|window\.location|eval\s*\(|innerHTML|src\s*=\s*["']?\s*javascript)"""
HTML_TAG = r"<[a-zA-Z/]"
SCRIPT_TAG = r"(?i)<\s*script"
JS_EVENT_HANDLER = r"(?i)\bon[a-z]{2,20}\s*="
JAVASCRIPT_URL = r"(?i)javascript\s*:"
ALERT_FUNCTION = r"(?i)\b(?:alert|confirm|prompt)\s*\("
INLINE_STYLE = r"(?i)\bstyle\s*="
TRAVERSAL_SEQUENCE = r"(?i)(\.\.[\\/]|%2e%2e[%\\/]|%252e%252e|%c0%ae%c0%ae|\.\.%2f|\.\.%5c|\.\./|\.\.\\)"
DOTDOT_ENCODED = r"(?i)(%2e%2e|%252e%252e|%c0%ae)"
PATH_SEPARATOR = r"[/\\]"
ABSOLUTE_PATH = r"^[/\\]|^[a-zA-Z]:[/\\]"
SENSITIVE_FILE = r"(?i)(?:etc/passwd|etc/shadow|etc/hosts|win\.ini|boot\.ini|\.htaccess|\.htpasswd|wp-config\.php|\.git/config|\.env\b|\.bash_history|/proc/self|web\.config|php\.ini)"
SENSITIVE_EXTENSION = r"(?i)\.(conf|ini|log|bak|env|backup|old|sql|db)\b"
SUSPICIOUS_EXTENSION = r"(?i)\.(php\d?|aspx?|jspx?)\b"
SHELL_COMMAND = r"(?i)\b(cat\b|ls\b|dir\b|id\b|whoami|wget\b|curl\b|bash\b|sh\b|chmod|chown|rm\b|cp\b|mv\b|ping\b|nc\b|ncat\b|netcat|python|perl|ruby|php\b|powershell|cmd\.exe|/bin/|/etc/passwd|/etc/shadow|certutil\b|wmic\b|reg\s+(add|query|delete)|net\s+(user|localgroup)|schtasks\b|rundll32\b|mshta\b|bitsadmin\b|Invoke-\w+|-enc\b|-EncodedCommand\b)"
COMMAND_SEPARATOR = r"(&&|\|\||[|;`])"
REDIRECT_OPERATOR = r"(>>|<<|[><])"
SUBSHELL = r"(\$\(|`[^`]+`)"
OS_PATH = r"(?i)(?:/bin/|/etc/|/usr/|/var/|/proc/|/sys/)"
URL_ENCODED = r"%[0-9a-fA-F]{2}"
DOUBLE_ENCODED = r"(?i)%25[0-9a-fA-F]{2}"
HEX_ESCAPE = r"(?i)(\\x[0-9a-fA-F]{2}|0x[0-9a-fA-F]+)"
UNICODE_ESCAPE = r"(?i)(\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|%u[0-9a-fA-F]{4})"
HTML_ENTITY = r"(?i)(&[a-zA-Z]+;|&#\d+;|&#x[0-9a-fA-F]+;)"
BASE64_LIKE = r"[A-Za-z0-9+/]{20,}={0,2}"
SPECIAL_CHAR = r"""[!@#$%^&*()\[\]{};:'",./<>?|\\=+_~`]"""
NUMERIC_CHAR = r"[0-9]"
UPPERCASE_CHAR = r"[A-Z]"
WHITESPACE = r"\s"
NEWLINE = r"[\n\r]"
NEWLINE_ENCODED = r"(?i)%0[da]"
NULL_BYTE = r"\x00"
NULL_BYTE_ENCODED = r"(?i)%00"
SCANNER_AGENT = r"(?i)(?:sqlmap|nikto|dirb|dirbuster|nmap|masscan|nuclei|burpsuite|zaproxy|w3af|acunetix|nessus|openvas|metasploit|python-requests|go-http|curl/|wget/|libwww-perl|httpclient)"
FORM_TYPE = r"(?i)application/x-www-form-urlencoded"
STANDARD_HEADERS = ("host", "user-agent", "accept", "content-type", "content-length", "authorization", "cookie", "referer", "connection", "accept-encoding", "accept-language", "cache-control")
# End of the fixed values.

#: Quotes of JSON keys and values: followed by a mark, or else preceded by one. Together they count each
#: quote once, and neither looks back over white space.
JSON_QUOTES = (r'"(?=\s*[:,}\]])', r'[:,{\[]\s*"(?!\s*[:,}\]])')

#: White space as browsers' patterns know it; Java's \s has ASCII only.
SPACE_CLASS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACES = "\t\n\x0b\f\r \xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　﻿"
_WORD = "[A-Za-z0-9_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
#: Characters of the patterns that are one class: these are counted by removing them.
CHARACTERS = {
    SPECIAL_CHAR: "!@#$%^&*()[]{};:'\",./<>?|\\=+_~`", NUMERIC_CHAR: "0123456789", UPPERCASE_CHAR: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", WHITESPACE: SPACES, NEWLINE: "\n\r", NULL_BYTE: "\x00",
    PATH_SEPARATOR: "/\\", "/": "/", "&": "&", "['\"]": "'\"", ";": ";", "[()]": "()", r"\|": "|", "`": "`", r"\$": "$",
}


#: Of each pattern texts one of which every match holds: where a text has none of them, nothing is searched.
NEEDS = {
    SQLI_COMMENT: ("--", "#", "/*", "*/"), SQLI_OPERATOR: ("=", "<>"), FORM_FIELD: ("=",), HTML_TAG: ("<",), SCRIPT_TAG: ("<",), JS_EVENT_HANDLER: ("=",), JAVASCRIPT_URL: (":",), ALERT_FUNCTION: ("(",), INLINE_STYLE: ("=",),
    TRAVERSAL_SEQUENCE: ("..", "%"), DOTDOT_ENCODED: ("%",), SENSITIVE_FILE: (".", "/"), SENSITIVE_EXTENSION: (".",), SUSPICIOUS_EXTENSION: (".",), COMMAND_SEPARATOR: ("&&", "|", ";", "`"), REDIRECT_OPERATOR: ("<", ">"),
    SUBSHELL: ("$(", "`"), OS_PATH: ("/",), URL_ENCODED: ("%",), DOUBLE_ENCODED: ("%25",), HEX_ESCAPE: ("\\x", "\\X", "0x", "0X"), UNICODE_ESCAPE: ("\\u", "\\U", "%u", "%U"), HTML_ENTITY: ("&",), NEWLINE_ENCODED: ("%0",), NULL_BYTE_ENCODED: ("%00",),
    JSON_QUOTES[0]: ('"',), JSON_QUOTES[1]: ('"',),
}


def alternatives(pattern: str) -> list[str]:
    """The branches of a pattern that is one group, or of the group that it starts with; else the pattern itself."""
    out, depth, inside, start, i = [], 0, False, 0, 0
    grouped = pattern.startswith("(") and not pattern.startswith(("(?=", "(?!", "(?<"))
    if grouped:
        pattern = pattern[3:] if pattern.startswith("(?:") else pattern[1:]
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
        elif c == ")":
            if depth == 0:
                break
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:i]]


def first_characters(pattern: str) -> list[str] | None:
    """The characters, as they stand in a class, that a match of the pattern can begin with; None where that is not plain."""
    out = []
    for branch in alternatives(pattern):
        if branch.startswith("\\") and branch[1:2] in ".$\\/[(":
            out.append(branch[:2])
        elif branch and (branch[0].isalnum() or branch[0] in "</%&;`>-|!"):
            # an optional first character would let others begin
            if branch[1:2] in ("?", "*", "{") or branch[0] == "|":
                return None
            out.append("\\" + branch[0] if not branch[0].isalnum() else branch[0])
        else:
            return None
    return sorted(set(out))


def for_java(pattern: str) -> str:
    """The pattern with ASCII word edges and the wide white space, as Spark needs it.

    A word edge before letters, or after them, is one look at one character.
    Patterns of many branches first look whether any of them can begin here.
    """
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    pattern = pattern.removeprefix("(?i)")
    out, inside, i = [flags], False, 0
    body = pattern.removeprefix(r"\b")
    begin = first_characters(body)
    if body != pattern:
        plain = begin is not None and all(c.isalnum() for c in begin)
        out.append(rf"(?<!{_WORD})" if plain else _EDGE)
        i = 2
    if begin and len(alternatives(body)) > 1 and "|" not in body.replace("\\|", "")[_end_of_group(body) :]:
        out.append(f"(?=[{''.join(begin)}])")
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            # in these patterns every edge but the first follows a word's character
            out.append(f"(?!{_WORD})")
            i += 2
        elif two == r"\s":
            out.append(SPACE_CLASS if inside else f"[{SPACE_CLASS}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = pattern[i] == "[" or (inside and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "".join(out)


def _end_of_group(pattern: str) -> int:
    """Where the group that the pattern starts with ends; the whole pattern if it starts with none."""
    if not pattern.startswith("("):
        return len(pattern)
    depth, inside, i = 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth == 0:
                return i
        i += 1
    return len(pattern)
