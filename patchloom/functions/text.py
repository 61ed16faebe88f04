"""Column functions on texts: ids, fingerprints, normal forms, shortening. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_LENGTH = 16


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: Column | str) -> Column:
    """The lines of a text, at any line end, without the ends; an empty text has none, and a last line end makes no further line. Null stays null."""
    text = _col(text)
    ends = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
    parts = F.split(text, ends, -1)
    return F.when(text.isNull(), F.lit(None)).when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def mean_line_length(lines_: Column) -> Column:
    """The mean number of characters of an array of lines; 0 for none."""
    total = F.aggregate(lines_, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    return F.when(F.size(lines_) > 0, total / F.size(lines_)).otherwise(F.lit(0.0))


def cwe_normalized(value: Column | str) -> Column:
    """``89`` and ``cwe-89`` become ``CWE-89``; other text is trimmed; blank is null."""
    raw = F.trim(_col(value))
    number = F.regexp_extract(raw, r"(?i)^(?:CWE-)?([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("CWE-"), number)).when(raw != "", raw)


def cwe_prefix(cwe: Column | str) -> Column:
    """The start of an id: lower case without hyphens, ``unknown`` for none."""
    return F.replace(F.lower(F.coalesce(F.nullif(_col(cwe), F.lit("")), F.lit("unknown"))), F.lit("-"), F.lit(""))


def finding_id(cwe: Column | str, path: Column | str, start: Column | str, what: Column | str) -> Column:
    """Stable id of a finding from its weakness, file and first line; from its text if it has neither file nor line."""
    prefix, path, start = cwe_prefix(cwe), F.nullif(_col(path), F.lit("")), _col(start)
    place = F.concat_ws(":", prefix, path, start.cast("string"))
    source = F.when(path.isNull() & start.isNull(), F.concat_ws(":", prefix, F.coalesce(_col(what), F.lit("")))).otherwise(place)
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(source, 256), 1, HASH_LENGTH))


def is_finding_id(value: Column | str) -> Column:
    return _col(value).rlike("^[a-z]+[0-9]*-[0-9a-f]{16}$")


#: A line up to the first ``#`` outside quotes; a backslash hides the next character, and an open quote reaches to the end of the line.
#: Possessive, so a line of any length is matched in a loop, without a deep stack.
UNCOMMENTED = r"""^(?:[^"'\\#]++|\\.|\\$|"(?:[^"\\]++|\\.|\\$)*+(?:"|$)|'(?:[^'\\]++|\\.|\\$)*+(?:'|$))*+"""
#: White space of any kind.
_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{_BLANK}++", ""), rf"(?<!{_BLANK}){_BLANK}++$", "")


def code_normalized(code: Column | str, comments: bool = True) -> Column:
    """Code without triple-quoted strings, comments (unless ``comments`` is false), outer blanks and blank lines; null stays null."""
    plain = F.regexp_replace(_col(code), r'"""[\s\S]*?"""', "")
    plain = F.regexp_replace(plain, r"'''[\s\S]*?'''", "")
    kept = lines(plain)
    if comments:
        kept = F.transform(kept, lambda x: F.regexp_extract(x, f"(?s){UNCOMMENTED}", 0))
    return F.array_join(F.filter(F.transform(kept, stripped), lambda x: x != ""), "\n")


def fingerprint(code: Column | str, cwe: Column | str, comments: bool = True) -> Column:
    """Id of a piece of code that blanks, comments and doc strings don't change."""
    prefix = cwe_prefix(cwe)
    source = F.concat_ws(":", prefix, code_normalized(code, comments))
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(source, 256), 1, HASH_LENGTH))


def tokens_estimated(text: Column | str) -> Column:
    """A quarter of the characters, rounded down; null counts as empty."""
    return F.floor(F.length(F.coalesce(_col(text), F.lit(""))) / 4).cast("long")


def within_limit(tokens: Column | str, limit: Column | str, margin: float = 0.0) -> Column:
    """Whether a number of tokens stays within a limit lowered by a margin."""
    return _col(tokens) <= F.floor(_col(limit) * (1.0 - margin))


def cost(tokens: Column | str, usd_per_million: Column | str) -> Column:
    """Price of a number of tokens; an unknown price counts as none."""
    return _col(tokens) * F.coalesce(_col(usd_per_million), F.lit(0.0)) / 1_000_000


def line_range_text(start: Column | str, end: Column | str) -> Column:
    """``42``, ``42-45``, or nothing."""
    start, end = _col(start), _col(end)
    text = start.cast("string")
    return F.when(start.isNull(), F.lit("")).when(end.isNull() | (start == end), text).otherwise(F.concat(text, F.lit("-"), end.cast("string")))


def truncated(text: Column | str, most: int) -> Column:
    """At most so many characters, the last three of a cut text being dots."""
    text = _col(text)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(max(0, most - 3))), F.lit("..."))).otherwise(text)


def path_shortened(path: Column | str, most: int) -> Column:
    """A long path as ``.../parent/file``, else ``.../file``; one of at most two parts, or one that still is too long, is cut."""
    path = _col(path)
    parts = F.split(path, "/")
    last, parent = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    two, one = F.concat(F.lit(".../"), parent, F.lit("/"), last), F.concat(F.lit(".../"), last)
    return (
        F.when(F.length(path) <= most, path).when(F.size(parts) <= 2, truncated(path, most))
        .when(F.length(two) <= most, two).when(F.length(one) <= most, one).otherwise(truncated(one, most))
    )


def snake_case(name: Column | str) -> Column:
    """``HTTPServer::Main`` becomes ``http_server/main``."""
    out = F.regexp_replace(F.replace(_col(name), F.lit("::"), F.lit("/")), r"([A-Z0-9]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"([a-z0-9])([A-Z])", "$1_$2"))


def camel_case(name: Column | str) -> Column:
    """``user_account`` becomes ``UserAccount``."""
    return F.array_join(F.transform(F.split(_col(name), "_"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, 1 << 30)))), "")


def dots_to_slashes(name: Column | str) -> Column:
    return F.replace(_col(name), F.lit("."), F.lit("/"))


def unquoted(text: Column | str) -> Column:
    """Without one pair of matching quotes around it."""
    return F.regexp_replace(_col(text), r"""^(["'`])([\s\S]*)\1$""", "$2")


def utc_text(ts: Column | str) -> Column:
    """A timestamp of a session in UTC as ``YYYY-MM-DDTHH:MM:SSZ``."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
