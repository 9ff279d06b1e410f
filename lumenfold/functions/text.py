"""Small text functions: names of files and headers, guesses of delimiters, coordinates written as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_filename(name: Column) -> Column:
    """Letters, digits, blanks, dots, dashes and underscores only. White space of any kind is collapsed to one blank
    first, so blanks around a sign that goes both stay; a name of white space only is NULL."""
    one = F.trim(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(one != "", F.regexp_replace(one, r"[^A-Za-z0-9 ._\-]", ""))


def without_number(name: Column) -> Column:
    """A name without the number that follows its last blank."""
    return F.regexp_replace(name, r"\s+[0-9]+$", "")


def header_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")


def unique_name(name: str, taken: set[str]) -> str:
    """``name``, or with the first number from 2 on that makes it new."""
    if name not in taken:
        return name
    n = 2
    while f"{name} {n}" in taken:
        n += 1
    return f"{name} {n}"


def delimiter_scores(lines: DataFrame, delimiters: tuple[str, ...] = (",", "\t", ";", " "), column: str = "value") -> DataFrame:
    """(delimiter, per_line): how often each delimiter occurs in a line on average."""
    counts = [F.avg(F.length(column) - F.length(F.replace(F.col(column), F.lit(d), F.lit("")))).alias(str(i)) for i, d in enumerate(delimiters)]
    pairs = F.array(*(F.struct(F.lit(d).alias("delimiter"), F.col(str(i)).alias("per_line")) for i, d in enumerate(delimiters)))
    return lines.agg(*counts).select(F.inline(pairs))


NUMBER = r"([-+0-9.]+)"


def _signed(text: Column, value: Column) -> Column:
    return F.when(F.substring(F.upper(F.trim(text)), -1, 1).isin("S", "W"), -value).otherwise(value)


def parse_dms(text: Column) -> Column:
    """Degrees, or degrees and minutes, or with seconds, and a direction, as degrees; NULL if it isn't that."""
    parts = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    at = [F.get(parts, F.lit(i)).try_cast("double") for i in range(3)]
    value = at[0] + F.coalesce(at[1] / 60, F.lit(0.0)) + F.coalesce(at[2] / 3600, F.lit(0.0))
    fits = F.size(parts).between(1, 3) & F.upper(F.trim(text)).rlike(r"^[-+0-9.].*[-+0-9.NSEW]$|^[-+0-9.]+$")
    return F.when(fits, _signed(text, value))


def parse_northing_easting(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    return F.when((F.size(parts) == 1) & F.upper(F.trim(text)).rlike(r"^[-+0-9.]+[^-+0-9.]*$"), _signed(text, F.get(parts, F.lit(0)).try_cast("double")))


def kind_from_name(name: str) -> str:
    """What a variable most likely stands for: i… a cube, s… a spectrum, else a band."""
    first = name[:1].lower()
    return {"i": "cube", "s": "spectrum"}.get(first, "band")


def saved_expressions(lines: DataFrame, column: str = "value") -> DataFrame:
    """One expression for each line that isn't blank."""
    text = F.lower(F.trim(column))
    return lines.where(text != "").select(text.alias("expression"))


def numbers_of(text: str) -> list[float]:
    return [float(x) for x in re.findall(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", text)]
