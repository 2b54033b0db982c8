"""Text helpers for file names, headers and raw cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain form.
ACCENTED = "ãẽõçíÃÇ"
PLAIN = "aeociAC"


def decimal_comma(value: Column) -> Column:
    """Number written with a decimal comma (``,2`` included); null if it is none."""
    return F.replace(F.trim(value), F.lit(","), F.lit(".")).try_cast("double")


def strip_accents(value: Column) -> Column:
    return F.translate(value, ACCENTED, PLAIN)


def normalise_name(value: Column) -> Column:
    """Lower case, blanks to underscores, accents stripped."""
    return strip_accents(F.replace(F.lower(value), F.lit(" "), F.lit("_")))


def normalise_column_name(name: str) -> str:
    return name.lower().replace(" ", "_").translate(str.maketrans(ACCENTED, PLAIN))


def title_case(value: Column) -> Column:
    """Capitalise the first letter of each run of letters, also after hyphens."""
    marked = F.regexp_replace(F.lower(value), r"(\P{L})(?=\p{L})", "$1\u0001")
    pieces = F.split(marked, "\u0001")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def file_name_field(file_name: Column, position: int) -> Column:
    """Zero-based field of an underscore-separated file name; null if there are too few."""
    return F.get(F.split(file_name, "_"), F.lit(position))


def flip_date(value: Column) -> Column:
    """``y-m-d`` or ``y/m/d`` text to ``d/m/y``."""
    parts = F.split(F.replace(value, F.lit("/"), F.lit("-")), "-")
    return F.array_join(F.reverse(parts), "/")


def observation_time(date_text: Column, hour_text: Column) -> Column:
    """UTC wall-clock timestamp from a date with ``-`` or ``/`` and ``HH:MM`` or ``HHMM`` with optional ``UTC``."""
    date = F.replace(F.trim(date_text), F.lit("/"), F.lit("-"))
    digits = F.replace(F.trim(F.replace(hour_text, F.lit("UTC"), F.lit(""))), F.lit(":"), F.lit(""))
    clock = F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2))
    return F.concat_ws(" ", date, F.when(F.length(digits) == 4, clock).otherwise(F.lit("invalid"))).try_cast("timestamp_ntz")


def zoneless_time(value: Column) -> Column:
    """ISO text with a ``+hh:mm`` suffix to a wall-clock timestamp."""
    return F.get(F.split(value, r"\+"), F.lit(0)).try_cast("timestamp_ntz")
