"""Text helpers for HTML tables and for the detail strings of controls."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.stats import half_up

REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Code points of the named references of HTML 4, from Python's own table, and the apostrophe.
NAMED = {**name2codepoint, "apos": 39}


def _character(reference: Column) -> Column:
    """The character that a reference stands for, or the reference itself."""
    name = F.regexp_extract(reference, "^&(.*);$", 1)
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])[name]
    code = (F.when(name.rlike("^#[0-9]"), F.substr(name, F.lit(2)).try_cast("long"))
            .when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10).try_cast("long")).otherwise(named))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(reference)


def decode_references(text: Column) -> Column:
    """Numeric and named character references, each decoded once; ``&`` itself last, so that its output is not read again."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))))
    ands = F.array(*map(F.lit, ("&amp;", "&#38;", "&#x26;", "&#X26;")))
    others = F.aggregate(F.array_except(found, ands), text, lambda t, ref: F.replace(t, ref, _character(ref)))
    decoded = F.aggregate(ands, others, lambda t, ref: F.replace(t, ref, F.lit("&")))
    return F.when(text.contains("&"), decoded).otherwise(text)


def strip_markup(html: Column) -> Column:
    """Tags become blanks, references their characters, runs of white space one blank."""
    return F.regexp_replace(decode_references(F.regexp_replace(html, r"<[^>]+>", " ")), r"[\s\u00a0]+", " ")


def accounting_number(cell: Column) -> Column:
    """'$ 1,234' -> 1234, '(70)' and '(70' -> -70, anything else -> null."""
    body = F.trim(F.replace(F.replace(cell, F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
    digits = F.trim(F.regexp_replace(body, r"^[()]+|[()]+$", ""))
    value = F.when(digits.rlike(r"^\d+(\.\d+)?$"), digits.try_cast("double"))
    return F.when(body.startswith("("), -value).otherwise(value)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match, case-insensitive, with dot matching line ends."""
    return F.regexp_extract_all(text, F.lit(f"(?is){pattern}"), F.lit(group))


def amount(x: Column, decimals: int) -> Column:
    """Fixed decimals, no grouping."""
    return F.format_string(f"%.{decimals}f", half_up(x, decimals))


def grouped(x: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(half_up(x, 0), 0)


def signed_amount(x: Column, decimals: int) -> Column:
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("+")), amount(F.abs(x), decimals))
