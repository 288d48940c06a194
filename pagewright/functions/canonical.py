"""Ids from what a payload says: JSON in one canonical form, and slugs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, without blanks and in ASCII; null for what is no JSON.

    Characters above ASCII are written as ``\\uXXXX`` (lower-case digits, two for those above U+FFFF).  Numbers with a
    fraction or an exponent are written as Spark's variants write them, so 1.0 is 1.
    """
    four = lambda code: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def written(part: Column) -> Column:
        code, over = F.ascii(part), F.ascii(part) - 0x10000
        wide = F.concat(four(F.lit(0xD800) + F.shiftright(over, 10)), four(F.lit(0xDC00) + over.bitwiseAND(F.lit(1023))))
        return F.when((code >= 32) & (code <= 126), part).when(code > 0xFFFF, wide).otherwise(four(code))

    def lowered(plain: Column) -> Column:
        """Escapes of control characters in lower case; a backslash before them is no escape's own."""
        out = plain
        for digit in "ABCDEF":
            out = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*\\u00[01])" + digit, "$1" + digit.lower())
        return F.when(F.contains(plain, F.lit("\\u00")), out).otherwise(plain)

    def in_ascii(plain: Column) -> Column:
        parts = F.regexp_extract_all(plain, F.lit(r"(?s)[ -~]+|[^ -~]"), F.lit(0))
        return F.when(plain.rlike("^[ -~]*$"), plain).otherwise(F.array_join(F.transform(parts, written), ""))

    return _let(_let(F.to_json(F.try_parse_json(text)), lowered), in_ascii)


def _let(value: Column, then) -> Column:
    """``then(value)``, where ``value`` is worked out once, however often ``then`` mentions it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def turn_id(payload: Column) -> Column:
    """The id of a turn's JSON payload: equal payloads have equal ids, whatever the order of their keys."""
    return F.concat(F.lit("turn-"), F.substring(F.sha2(canonical_json(payload), 256), 1, 16))


def option_id(label: Column, index: Column) -> Column:
    """A slug of the label, at most 56 characters of it, and the option's place."""
    slug = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.coalesce(F.nullif(F.substring(slug, 1, 56), F.lit("")), F.lit("option")), F.lit("-"), index.cast("string"))
