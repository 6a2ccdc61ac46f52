"""String functions. All of them are built-in expressions, none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as str.isspace sees it, for use inside a character class.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"

# One token per match: an operator, or a run of words, escapes and quoted strings.
# The possessive quantifiers make the matcher loop instead of recursing, so a
# command of any length is matched without deepening the stack.
SHELL_TOKENS = (
    r"(?s)&&|\|\||[|;]|"
    r"(?:\\.|\\\z|'[^']*+(?:'|\z)"
    r'|"(?:\\.|[^"\\]++|\\\z)*+(?:"|\z)'
    r"|`(?:\\.|[^`\\]++|\\\z)*+(?:`|\z)"
    r"""|&(?!&)|[^\\'"`|;&]++)++"""
)

# Plain character classes: a run of any length is matched in a loop, without recursion.
CHAR_CLASSES = {
    "cjk": r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]+",
    "latin": r"[A-Za-z]+",
    "digit": r"[0-9[\p{N}&&[^\x00-\x7F\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{30FF}]]]+",
    "space": r"[\t-\r [\p{IsWhite_Space}&&[^\x00-\x7F]]]+",
}

# Tool name (lower case) -> category.
TOOL_CATEGORIES = {
    "read": "file-read",
    "readmcpresourcetool": "file-read",
    "listmcpresourcestool": "file-read",
    "write": "file-write",
    "edit": "file-write",
    "notebookedit": "file-write",
    "glob": "file-search",
    "grep": "file-search",
    "bash": "execution",
    "taskoutput": "execution",
    "task": "agent",
    "taskstop": "agent",
    "enterplanmode": "agent",
    "exitplanmode": "agent",
    "webfetch": "web",
    "websearch": "web",
    "skill": "analysis",
    "askuserquestion": "analysis",
    "todowrite": "analysis",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def rstrip(c: Column, chars: str = SPACE) -> Column:
    return F.regexp_replace(c, rf"[{chars}]+\z", "")


def non_blank(c: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    s = strip(c)
    return F.when(F.length(s) > 0, s)


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"[{SPACE}]+", " "))


def prompt_key(c: Column) -> Column:
    """Text under which two prompts count as the same."""
    return F.lower(collapse_spaces(c))


def shell_split(command: Column) -> Column:
    """Sub-commands of a shell line, split on chaining operators outside quotes."""
    tokens = F.regexp_extract_all(command, F.lit(SHELL_TOKENS), F.lit(0))
    words = F.filter(tokens, lambda t: ~t.isin("&&", "||", "|", ";"))
    return F.filter(F.transform(words, strip), lambda t: F.length(t) > 0)


def _base_command(part: Column) -> Column:
    words = F.split(part, rf"[{SPACE}]+")
    is_assignment = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}]*="
    first = F.try_element_at(F.filter(words, lambda w: ~w.rlike(is_assignment)), F.lit(1))
    base = F.regexp_extract(first, r"([^/]*)\z", 1)
    return F.when(base.rlike(r"^[a-zA-Z_.]"), base)


def shell_base_commands(command: Column) -> Column:
    """First real word of each sub-command, without path and NAME=value prefixes."""
    return F.array_compact(F.transform(shell_split(command), _base_command))


def char_count(text: Column, name: str) -> Column:
    gone = F.regexp_replace(text, CHAR_CLASSES[name], "")
    return (F.length(text) - F.length(gone)).cast("bigint")


def char_classes(text: Column) -> Column:
    """Struct of code-point counts by script family plus the total length."""
    t = F.coalesce(text, F.lit(""))
    counts = {n: char_count(t, n) for n in CHAR_CLASSES}
    total = F.length(t).cast("bigint")
    other = total
    for c in counts.values():
        other = other - c
    return F.struct(
        total.alias("total"),
        *[c.alias(n) for n, c in counts.items()],
        other.alias("other"),
    )


def tool_group(name: Column) -> Column:
    """Display group: `mcp__<server>__<method>` tools share their server's group."""
    parts = F.split(name, "__")
    server = F.try_element_at(parts, F.lit(2))
    shown = F.concat(F.element_at(F.split(server, "_"), -1), F.lit(" (MCP)"))
    return F.when(name.startswith("mcp__") & (F.size(parts) >= 3), shown).otherwise(name)


def tool_category(name: Column) -> Column:
    pairs = [F.lit(x) for kv in TOOL_CATEGORIES.items() for x in kv]
    table = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(table, F.lower(name)), F.lit("other"))


def error_summary(detail: Column, max_chars: int = 160) -> Column:
    line = F.substring(F.replace(strip(detail), F.lit("\n"), F.lit(" ")), 1, max_chars)
    return F.when(F.length(strip(detail)) == 0, F.lit("(empty error output)")).otherwise(line)


def error_snippet(detail: Column, max_chars: int = 1200) -> Column:
    return F.substring(F.coalesce(detail, F.lit("")), 1, max_chars)


def truncate_words(text: Column, limit: int) -> Column:
    """Collapse white space; cut over-long text at a word end and mark it."""
    flat = collapse_spaces(text)
    cut = rstrip(F.substring(flat, 1, limit))
    at_word = F.when(cut.contains(" "), rstrip(F.regexp_replace(cut, r" [^ ]*\z", ""))).otherwise(cut)
    marked = F.concat(rstrip(at_word, " ,;:"), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(marked)


def truncate_ellipsis(text: Column, limit: int) -> Column:
    """Collapse white space; cut at `limit` characters, the last being an ellipsis."""
    flat = collapse_spaces(text)
    cut = F.concat(rstrip(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)


def project_name(path: Column) -> Column:
    """Last segment of a path; `(unknown)` when there is none."""
    trimmed = F.regexp_replace(F.coalesce(path, F.lit("")), r"/+\z", "")
    name = F.regexp_extract(trimmed, r"([^/]*)\z", 1)
    return F.when(F.length(F.coalesce(path, F.lit(""))) == 0, F.lit("(unknown)")).otherwise(name)


def ecosystem_label(name: Column, labels: dict[str, str] | None = None) -> Column:
    """Known display label, else the name in title case."""
    shown = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    for key, label in (labels or {}).items():
        shown = F.when(name == key, F.lit(label)).otherwise(shown)
    return shown


def uuid_tail(stem: Column) -> Column:
    """UUID at the end of a file stem, else the stem."""
    pat = r"(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\z"
    found = F.regexp_extract(stem, pat, 1)
    return F.when(F.length(found) > 0, found).otherwise(stem)


def spaced_json(compact: Column) -> Column:
    """Compact JSON text with a blank after every comma and colon outside strings."""
    return F.regexp_replace(
        compact, r'\G((?:"(?:[^"\\]++|\\.)*+"|[^",:]++)*+)([,:])', r"$1$2 "
    )


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)
