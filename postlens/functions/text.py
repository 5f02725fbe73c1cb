"""Column expressions over text: whitespace, Han counts, units, sentences, redaction, URL and time checks.

Regexes are written so that Java (Spark) and RE2 (DuckDB) read them alike:
whitespace and digits are explicit classes, as the shorthands differ.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace (a character class body), Han characters, units of text and sentence terminators.
WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: One character of WS. All that is beyond U+3000, most of a Chinese text, is told by one comparison.
BLANK = rf"[[\x00-\x20\x85-\x{{3000}}]&&[{WS}]]"
HAN = r"[\x{4e00}-\x{9fff}]"
UNIT = r"[\x{4e00}-\x{9fff}]|[A-Za-z]+(?:'[A-Za-z]+)?|\p{Nd}+(?:\.\p{Nd}+)?"
#: Sentence terminators; an ASCII full stop is none.
TERMINATORS = "。！？!?；;"

SUFFICIENT_HAN, SUFFICIENT_CHARS = 500, 1000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body or a lambda in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(text: Column | str) -> Column:
    """Whitespace runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"{BLANK}+", " "))


def keep_lines(text: Column | str) -> Column:
    """CRLF and CR as LF, blanks within lines as one space, ends trimmed; lines stay."""
    unix = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\r\n?", "\n")
    blanks = F.regexp_replace(unix, r"[ \t\f\x0b]+", " ")
    return F.regexp_replace(blanks, f"^{BLANK}+|{BLANK}+$", "")


def fold(text: Column | str) -> Column:
    """Lower case, with sharp s as ss."""
    return F.replace(F.lower(col(text)), F.lit("ß"), F.lit("ss"))


def model_text(text: Column | str) -> Column:
    """What the n-gram model reads: squeezed and folded."""
    return fold(squeeze(text))


def han(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), f"[^{HAN[1:-1]}]+", ""))  # shorter than a list of all of them


def sufficient(normal: Column, language: Column | str) -> Column:
    """Long enough for the origin policy, by Han characters for zh, else by characters."""
    return F.when(col(language) == "zh", han(normal) >= SUFFICIENT_HAN).otherwise(F.length(normal) >= SUFFICIENT_CHARS)


def units(text: Column | str) -> Column:
    """Han characters, words and numbers of the folded text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(UNIT), F.lit(0))


def ngrams(items: Column, n: int, separator: str = "") -> Column:
    """Joined n-grams of an array that is a column or a lambda's variable; empty if it is shorter.

    Built by n - 1 element-wise joins with the shifted array: linear, unlike a slice for each place.
    """
    size = F.size(items)
    out = items
    for k in range(1, n):
        left = F.greatest(size - k, F.lit(0))
        out = F.zip_with(F.slice(out, 1, left), F.slice(items, k + 1, left), lambda a, b: F.concat(a, F.lit(separator), b) if separator else F.concat(a, b))
    return out


def opener(unit_array: Column) -> Column:
    return F.array_join(F.slice(unit_array, 1, 2), "")


def repeated_ratio(unit_array: Column, n: int = 4) -> Column:
    """Share of n-unit sequences that occur before in the text; no shuffle."""

    def of(u: Column) -> Column:
        return F.when(F.size(u) < n, F.lit(0.0)).otherwise(let(ngrams(u, n, "\u0001"), lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g)))

    return let(unit_array, of)


def sentences(normal: Column) -> Column:
    """Sentences of a text from keep_lines(), in order.

    A piece counts if a terminator ends it, or if it ends the text. Work is linear:
    lines are split, then each line after its runs of terminators.
    """

    def of(lines: Column) -> Column:
        def of_line(line: Column, i: Column) -> Column:
            parts = F.split(F.regexp_replace(line, f"^[{TERMINATORS}]+", ""), f"(?<=[{TERMINATORS}])(?=[^{TERMINATORS}])")
            ended = lambda p: F.rlike(p, F.lit(f"[{TERMINATORS}]$")) | (i == F.size(lines) - 1)
            return F.filter(parts, lambda p: (p != "") & ended(p))

        return F.filter(F.transform(F.flatten(F.transform(lines, of_line)), squeeze), lambda s: s != "")

    return let(F.split(normal, "\n", -1), of)


#: Keys whose values are secrets.
SECRET_KEYS = (
    r"(?i)(authorization\s*[:=]\s*(?:token|bearer)?\s*)[^\s,;]+",
    r"(?i)(x-api-key\s*[:=]\s*)[^\s,;]+",
    r"(?i)(api[_-]?key\s*[:=]\s*)[^\s,;]+",
)


def redact(text: Column | str, secrets: tuple[str, ...] = (), limit: int = 1000) -> Column:
    """Known secrets and the values of secret keys masked, then cut to limit characters."""
    out = col(text)
    for s in secrets:
        if s:
            out = F.replace(out, F.lit(s), F.lit("[REDACTED]"))
    for rx in SECRET_KEYS:
        out = F.regexp_replace(out, rx, "$1[REDACTED]")
    return F.left(out, F.lit(limit))


def redact_paths(text: Column | str, limit: int = 500) -> Column:
    """Local absolute paths masked in a reader's error."""
    masked = F.regexp_replace(col(text), r"(?i)file://[^\s'\"]+|[a-z]:\\[^\s'\"]+|(?<![\w/:.])/(?:[^\s/'\":]+/)*[^\s/'\":]+", "[PATH]")
    return F.left(masked, F.lit(limit))


def is_public_url(url: Column | str) -> Column:
    """Null and empty are fine; else http(s) with a host."""
    u = col(url)
    return F.coalesce((u == "") | F.rlike(u, F.lit(r"(?i)^https?://[^/?#]+")), F.lit(True))


def is_zoned_time(text: Column | str) -> Column:
    """An ISO-8601 date and time with an explicit offset or Z."""
    t = col(text)
    return F.coalesce(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$")) & F.try_to_timestamp(t).isNotNull(), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))
