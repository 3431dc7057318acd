"""Masking of volatile parts of log lines by an ordered chain of regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masking rules (pattern, replacement), in order from most to least specific.
RULES = [
    (r"\b\d{4}[-/.]\d{2}[-/.]\d{2}[ T\-]\d{2}[:.]\d{2}[:.]\d{2}(?:[.,]\d+)?\b", "<TS>"),
    (r"\b\d{6}\s+\d{6}\b", "<TS>"),
    (r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", "<DATE>"),
    (r"\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TIME>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\bblk_-?\d+\b", "<BLK>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}:\d{1,5}\b", "<IP>:<PORT>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<IP>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", "<IP>"),
    (r"\bhttps?://[^\s\"'>]+", "<URL>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"(?<![A-Za-z0-9])/(?:[\w\-.]+/)+[\w\-.]*", "<PATH>"),
    (r"\b[A-Za-z]:\\(?:[\w\-. ]+\\)*[\w\-. ]*", "<PATH>"),
    (r"\b\d+\b", "<NUM>"),
]
#: What a line holds that any of RULES can match, before and after other rules: a digit, a slash, a colon or eight hexadecimal letters.
NEEDED = r"[\p{Nd}/:]|[a-fA-F]{8}"
#: White space as Unicode has it; Java's \s is narrower. UNEVEN: a run of it that is not one space.
ODD_SPACES = r"\t-\r\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNEVEN = rf" [ {ODD_SPACES}]+|[{ODD_SPACES}][ {ODD_SPACES}]*"
_HEX = "abcdefABCDEF"
#: What NEEDED finds, or white space other than U+0020, in one class: single characters are one look-up in Java, and what
#: lies beyond U+0660 is looked at closely only there. A hexadecimal letter counts with seven more behind it.
_BUSY = rf"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0/0123456789:[\u0660-\x{{10ffff}}&&[\p{{Nd}}{ODD_SPACES}]]"
BUSY = rf"[{_HEX}{_BUSY}](?:(?<![{_HEX}])|[{_HEX}]{{7}})"


def mask(line: Column, rules=None, lowercase: bool = False) -> Column:
    """The line with every rule applied in order, white space collapsed and trimmed; null stays null.

    With the standard rules most lines need no work, which one pass tells; the rules run on lines that
    hold something they can match.
    """
    even = lambda x: F.regexp_replace(x, UNEVEN, " ")
    bare = F.rtrim(line, F.lit("\r\n"))
    out = bare
    for pattern, replacement in RULES if rules is None else rules:
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    out = even(out)
    if rules is None:
        out = F.when(~(line.rlike(BUSY) | line.contains("  ")), line).when(line.rlike(NEEDED), out).otherwise(even(bare))
    out = F.trim(out)
    return F.lower(out) if lowercase else out


def _tokens(masked: Column) -> Column:
    """Whether the line can hold a mask token; null stays null."""
    return masked.contains("<")


def collapse(masked: Column) -> Column:
    """Every mask token becomes <NUM>."""
    return F.when(_tokens(masked), F.regexp_replace(masked, r"<[A-Z]+>", "<NUM>")).otherwise(masked)


def mask_count(masked: Column) -> Column:
    return F.when(~_tokens(masked), 0).otherwise(F.regexp_count(masked, F.lit(r"<[A-Z]+>"))).cast("long")
