"""Column functions over lines and texts: normalising, classifying, tokens and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Line patterns of manuals.
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
FORMAT_TAG = r"(?i)</?(?:u|span|div|p|font|strong|em|b|i|sub|sup)(?:\s[^>]*)?>|<br\s*/?>"
BROKEN_LINK = r"\*\*\[([^\]]+?)\*\*\]\(([^)]+?)\*\*\)"
MANY_STARS = r"\*{4,}"
DOTS = r"\.{3,}"
UNDERSCORES = r"_{3,}"
PAGE_NUMBER = r"(?i)^(?:page\s+)?(?:\d{1,4}|[ivxlcdm]{1,8})$"
COPYRIGHT = r"(?i)^(?:#{1,6}\s*)?(?:©|copyright\b|all rights reserved\b)"
NAVIGATION = r"(?i)^(?:#{1,6}\s*)?(?:related (?:information|references|tasks|topics)|parent topic)\s*:?$"
LAYOUT_RULE = r"^-{12,}$"
STRUCTURAL = r"^(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|[A-Za-z][.)]\s|\||```)"
TABLE_SEPARATOR = r"^\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?$"
CONTENTS_HEADING = r"(?i)^#{1,6}\s+(?:table of )?contents\s*$"
CONTENTS_ENTRY = r"^.{3,}?\s+\d{1,4}\s*\*{0,2}$"
HEADING_START = r"^#{1,6}\s"
HEADING = r"^\s*(#{1,6})\s+(.+?)\s*#*\s*$"
QUESTION_HEADING = r"(?i)^\s*\*\*(Q\d+\..+?)\*\*\s*$"
ORDERED_STEP = r"^\s*(?:\*\*)?(\d+)[.)](?:\*\*)?\s+(.+?)\s*$"
WARNING = r"(?i)\b(?:warning|caution|danger|notice|important)\b"
PREREQUISITE = r"(?i)^(?:before you begin|prerequisites?|preparation|prepare|requirements?|required tools?|you will need)\b"
NO_PROCEDURE = r"(?i)\b(?:licenses?|licen[cs]es?|trademarks?|copyright|terms\s*(?:and|&)\s*conditions|glossary)\b"
PIPE_ROW = r"^\s*\|[^\n]*\|\s*$"
TOKEN = r"[a-z0-9]+(?:[-_][a-z0-9]+)*"
IDENTIFIER = r"[a-z0-9]+(?:[-_][a-z0-9]+)+|[a-z]+\d+|\d+[a-z]+|\b\d{2,}\b"
PREREQUISITE_BLOCK = r"(?i)^(?:before you begin|prerequisite|preparation|prepare|requirements?|required tools?)\b"
STEP_BLOCK = r"^(?:\*\*)?\d+[.)](?:\*\*)?\s+"
TECHNICAL = r"(?i)\b(?:error code|failure code|blink(?:ing)? pattern|part number|model number)\b"
#: Headings that are kept although they repeat.
PROTECTED = ["cause", "what to do", "warning", "caution", "danger", "important", "note"]
#: Replies that only acknowledge, and phrases that make one of a reply of at most 12 words.
ACKNOWLEDGED = ["yes", "yeah", "yep", "okay", "ok", "done", "thanks", "thank you", "understood"]
ACKNOWLEDGING = ["got it", "what next", "what is next", "whats next", "i understand", "i have done it", "i checked it"]
#: Words that make a query about printing a broad failure report.
FAILURES = ["not", "cannot", "unable", "won't", "wont", "fails", "offline"]


def lines_of(text: Column) -> Column:
    """The lines of a text as an array; a final line break ends the last line and starts none."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.length(text) > 0, F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)).otherwise(F.array().cast("array<string>"))


def repaired(line: Column) -> Column:
    """Broken bold links and runs of asterisks mended."""
    return F.regexp_replace(F.regexp_replace(line, BROKEN_LINK, "**[$1]($2)**"), MANY_STARS, "**")


def repairs(line: Column) -> Column:
    """How many places ``repaired`` mends."""
    linked = F.regexp_replace(line, BROKEN_LINK, "**[$1]($2)**")
    return F.regexp_count(line, F.lit(BROKEN_LINK)) + F.regexp_count(linked, F.lit(MANY_STARS))


def normalized(line: Column) -> Column:
    """A line without format tags, leaders and extra blanks."""
    line = repaired(F.regexp_replace(line, FORMAT_TAG, ""))
    line = F.regexp_replace(F.regexp_replace(line, DOTS, " "), UNDERSCORES, " ")
    return F.trim(F.regexp_replace(F.translate(line, "\u00a0", " "), "[ \t]+", " "))


def plain(line: Column) -> Column:
    """A line without the marks around it."""
    return F.trim(F.regexp_replace(line, r"^[#*_\s]+|[#*_\s]+$", ""))


def boundary_candidate(line: Column) -> Column:
    """Whether a normalised line may be a running title or foot."""
    bare = plain(line)
    return (
        F.when(line.rlike(PAGE_NUMBER) | (F.upper(line) == "ENWW"), True)
        .when(line.rlike(TABLE_SEPARATOR) | (line.rlike(STRUCTURAL) & ~line.startswith("#")), False)
        .when(F.lower(bare).isin(PROTECTED), False)
        .when(F.length(bare) == 1, bare.rlike(r"^[\p{L}\p{N}.]$"))
        .when((bare == "") | (F.length(bare) > 140) | bare.rlike("[.!?;:]$"), False)
        .otherwise(F.size(F.split(bare, r"\s+")) <= 14)
    )


def line_reason(line: Column) -> Column:
    """Why a normalised line is removed on its own account; null if it stays. The order decides."""
    return (
        F.when(line == "", None)
        .when(line.rlike(PAGE_NUMBER), "page_number")
        .when(line.rlike(COPYRIGHT), "copyright_boilerplate")
        .when(line.rlike(NAVIGATION), "navigation_label")
        .when(line.isin(".", "®"), "standalone_artifact")
        .when(line.rlike(LAYOUT_RULE), "layout_rule")
    )


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def identifiers(text: Column) -> Column:
    """Identifiers in order, without anything but letters and digits."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(IDENTIFIER), F.lit(0)), lambda x: F.regexp_replace(x, "[^a-z0-9]", ""))


def any_of(text: Column, terms) -> Column:
    """Whether the text contains one of the terms."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def block_type(line: Column, is_heading: Column) -> Column:
    """The kind of block that a line belongs to."""
    return (
        F.when(is_heading, "heading")
        .when(line.rlike(WARNING), "warning")
        .when(line.rlike(PREREQUISITE_BLOCK), "prerequisite")
        .when(line.rlike(STEP_BLOCK), "ordered_list")
        .when(line.startswith("|") & line.endswith("|"), "table")
        .when(line.rlike(TECHNICAL), "technical_identifier")
        .otherwise("narrative")
    )


def acknowledgement(text: Column) -> Column:
    """Whether a reply only acknowledges: it is an acknowledgement, or has at most 12 words and holds an acknowledging phrase."""
    said = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return said.isin(ACKNOWLEDGED) | ((F.size(F.split(said, " ")) <= 12) & any_of(said, ACKNOWLEDGING))


def broad_failure(query: Column) -> Column:
    """Whether a query only says that printing fails."""
    q = F.lower(query)
    return F.contains(q, F.lit("print")) & any_of(q, FAILURES)
