"""String helpers with Python text semantics, as built-in Spark expressions."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.  Written as escapes that both
# java.util.regex and RE2 accept, so the SQL checks can reuse the class.
BLANKS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
BLANK_CHARS = "".join(
    chr(c)
    for lo, hi in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
        (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(lo, hi + 1)
)
_WORD = r"\p{L}\p{N}_"


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Rewrite a rule pattern so java.util.regex reads ``\\s \\S \\w \\b .`` as Python does.

    Explicit classes are used instead of the ``U`` flag: they cover the four
    separator controls that flag leaves out, and match faster.
    """
    out = pattern.replace(r":\s]", ":" + BLANKS + "]")
    out = out.replace(r"\s", f"[{BLANKS}]").replace(r"\S", f"[^{BLANKS}]")
    # Next to a word character of the pattern one side of \b is settled.
    out = re.sub(r"\\b(?=\w)", lambda _: f"(?<![{_WORD}])", out)
    out = re.sub(r"(?<!\\\w)(?<=\w)\\b", lambda _: f"(?![{_WORD}])", out)
    out = out.replace(r"\b", f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))")
    out = out.replace(r"\w", f"[{_WORD}]")
    return ("(?diu)" if ignore_case else "(?d)") + out


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode blanks included."""
    return F.btrim(col, F.lit(BLANK_CHARS))


def fold_case(col: Column) -> Column:
    """Lower-case text so that any case-insensitive ASCII match survives a ``contains``.

    Four letters outside ASCII match an ASCII letter case-insensitively.  The rare
    text that has one of them gets them replaced.
    """
    odd = "\u017f\u212a\u0131\u0130"
    has_odd = reduce(lambda a, b: a | b, [F.contains(col, F.lit(c)) for c in odd])
    ascii_only = F.octet_length(col) == F.length(col)
    return F.when(~ascii_only & has_odd, F.lower(F.translate(col, odd, "skii"))).otherwise(F.lower(col))


def count_substring(col: Column, needle: str) -> Column:
    """Number of non-overlapping occurrences of an ASCII substring."""
    gone = F.octet_length(col) - F.octet_length(F.replace(col, F.lit(needle), F.lit("")))
    return (gone / F.lit(len(needle))).cast("bigint")


def count_substrings(col: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [count_substring(col, n) for n in needles])


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot; leading dots do not start one."""
    return F.lower(F.regexp_extract(base_name(path), r"(?ds)^\.*[^.].*(\.[^.]*)$", 1))


def fixed_decimals(col: Column, digits: int) -> Column:
    """``%.<digits>f``, ties to even, no thousands separators."""
    return F.replace(F.format_number(col, digits), F.lit(","), F.lit(""))


def thousands(col: Column) -> Column:
    return F.format_number(col, 0)
