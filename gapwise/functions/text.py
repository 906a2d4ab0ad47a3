"""Column expressions for ids, names and activity titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace (they all lie below U+3001).
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Spellings of "no name" in stored tables.
NOT_A_NAME = ("", "nan", "None")

# Title prefixes, the specific ones first, and the title length.
SHORT_TITLE_PREFIXES = (
    "Async Research: ",
    "Async Query: ",
    "Async Synopsis: ",
    "Async Draft: ",
    "Async ",
)
TITLE_PREFIXES = (*SHORT_TITLE_PREFIXES, "Conversation Record Turn")
TITLE_LENGTH = 56

# Canonical text form of a UUID.
UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

SHORT_ID_LENGTH = 8


def strip(col: Column) -> Column:
    """Trim every kind of outer whitespace, not only spaces."""
    return F.btrim(col, F.lit(WHITESPACE))


def rstrip(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def valid_name(col: Column) -> Column:
    """The stripped name, or NULL for any spelling of "no name"."""
    name = strip(col)
    return F.when(~name.isin(list(NOT_A_NAME)), name)


def short_id(col: Column) -> Column:
    return F.concat(F.substring(col, 1, SHORT_ID_LENGTH), F.lit("…"))


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def _without_prefix(title: Column, prefixes: tuple[str, ...]) -> Column:
    """``title`` without the first of ``prefixes`` that it starts with."""
    quoted = "|".join(rf"\Q{prefix}\E" for prefix in prefixes)
    return F.regexp_replace(title, f"^(?:{quoted})", "")


def clean_title_short(col: Column) -> Column:
    """Prefix removed and cut to the title length; a blank input stays an empty string."""
    return F.substring(_without_prefix(strip(col), SHORT_TITLE_PREFIXES), 1, TITLE_LENGTH)


def clean_title(col: Column) -> Column:
    """Prefix removed, re-trimmed, shortened with an ellipsis; NULL when nothing is left."""
    title = strip(_without_prefix(strip(col), TITLE_PREFIXES))
    cut = F.concat(rstrip(F.substring(title, 1, TITLE_LENGTH - 1)), F.lit("…"))
    return blank_to_null(F.when(F.length(title) > TITLE_LENGTH, cut).otherwise(title))


def display_name(title: Column, user_id: Column, unknown: str | None = None) -> Column:
    """Title if there is one, else a name made from the id; ``unknown`` replaces a blank id."""
    short = F.substring(F.coalesce(user_id, F.lit("")), 1, SHORT_ID_LENGTH)
    generic = F.concat(F.lit("User · "), short, F.lit("…"))
    if unknown is not None:
        generic = F.when(short == "", F.lit(unknown)).otherwise(generic)
    return F.coalesce(blank_to_null(title), generic)
