"""Text for people: periods, numbers, percentages, ages, names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fiscal periods ---------------------------------------------------------


def period_key(fiscal_year: Column, quarter: Column) -> Column:
    """Integer that orders periods; unlike the label it does not wrap at a century."""
    return (fiscal_year * 4 + quarter).cast("int")


def year_label(fiscal_year: Column) -> Column:
    """``FY23``."""
    return F.concat(F.lit("FY"), F.substring(fiscal_year.cast("string"), 3, 2))


def period_label(fiscal_year: Column, quarter: Column) -> Column:
    """``FY23Q2``."""
    return F.concat(year_label(fiscal_year), F.lit("Q"), quarter.cast("string"))


# -- numbers ----------------------------------------------------------------

# Units of shortened numbers and their letters, largest first; cleaned numbers know all but the first.
UNITS = ((1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K"))


def whole(column: Column) -> Column:
    """Half-even rounded whole number as text."""
    return F.bround(column).cast("bigint").cast("string")


def _plain(column: Column) -> Column:
    """A double to 14 digits: without exponent where twelve decimals hold them, without separators or trailing zeros."""
    value = column + F.lit(0.0)  # adding 0 turns -0 into 0
    decimals = F.regexp_replace(F.format_number(value, 12), r",|\.?0+$", "")
    exact = F.regexp_replace(F.lower(value.cast("string")), r"\.0(?=e|$)", "")
    close = F.abs(decimals.cast("double") - value) <= F.abs(value) * 1e-14
    return F.when(close, decimals).otherwise(exact)


def clean_number(column: Column, digits: int = 0, na_text: str | None = None) -> Column:
    """``2.5e3`` -> ``2K``: thousands, millions, billions; smaller and negative as they are."""

    def scaled(unit: float, suffix: str) -> Column:
        value = column / F.lit(unit)
        text = whole(value) if digits == 0 else _plain(F.bround(value, digits))
        return F.concat(text, F.lit(suffix))

    text = _plain(column)
    for unit, letter in reversed(UNITS[1:]):
        text = F.when(column >= unit, scaled(unit, letter)).otherwise(text)
    return text if na_text is None else F.coalesce(text, F.lit(na_text))


def short_number(column: Column) -> Column:
    """Whole number with a K/M/B/T suffix; the scale is picked before rounding."""
    size = F.abs(column)
    text = whole(column)
    for unit, letter in reversed(UNITS):
        text = F.when(size >= unit, F.concat(whole(column / unit), F.lit(letter))).otherwise(text)
    return text


def format_achievement(results: Column, targets: Column) -> Column:
    """``12K / 20K``; NULL when either side is NULL."""
    return F.concat(short_number(results), F.lit(" / "), short_number(targets))


def percent_label(share: Column) -> Column:
    """``0.125`` -> ``12%``."""
    return F.concat(whole(share * 100), F.lit("%"))


def comma_label(column: Column) -> Column:
    """``1234567`` -> ``1,234,567``."""
    return F.format_number(column, 0)


# -- words ------------------------------------------------------------------


def words(column: Column, start: int, end: int) -> Column:
    """Space-separated words ``start``..``end`` (from 1); NULL when there are fewer."""
    parts = F.split(column, " ")
    return F.when(
        F.size(parts) >= end, F.array_join(F.slice(parts, start, end - start + 1), " ")
    )


def indicator_words(title: Column, description: Column, color: Column) -> list[Column]:
    """The three parts of an indicator cell: name, short description, colour."""
    return [
        words(title, 1, 1).alias("name"),
        words(description, 1, 3).alias("short_description"),
        words(color, 1, 1).alias("color"),
    ]


def indicator_cell(title: Column, description: Column, color: Column) -> Column:
    """The same three parts as one HTML snippet."""
    name, text, shade = indicator_words(title, description, color)
    return F.concat(
        F.lit("<div><b style='color:"), shade, F.lit("'>"), name,
        F.lit("</b><br><span>"), text, F.lit("</span></div>"),
    )


# -- harvested codes --------------------------------------------------------

# Parts of age codes that go or change, each once, and the open-ended code.
AGE_PARTS = (("Y0", ""), ("_0", "-"))
OPEN_AGE, OPEN_AGE_LABEL = "15_999", "15+"


def _replace_first(column: Column, text: str, replacement: str) -> Column:
    return F.regexp_replace(column, f"^(.*?){text}", f"$1{replacement}")


def age_label(column: Column) -> Column:
    """``Y015_019`` -> ``15-19``, ``Y015_999`` -> ``15+``."""
    text = column
    for part, replacement in AGE_PARTS:
        text = _replace_first(text, part, replacement)
    return F.when(text == OPEN_AGE, F.lit(OPEN_AGE_LABEL)).otherwise(text)


def recode(column: Column, table: Mapping[str, str]) -> Column:
    """Replace listed values, keep the others."""
    result = column
    for old, new in table.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


# -- names ------------------------------------------------------------------


def clean_agency(column: Column, names: Mapping[str, str] | None = None) -> Column:
    """Agency without its department prefix, upper case, then an optional renaming."""
    text = F.upper(F.regexp_replace(column, "^.*/", ""))
    return recode(text, names) if names else text


def clean_indicator(indicator: Column, numerator_denominator: Column) -> Column:
    """Mark denominators: ``TX_PVLS`` with ``D`` -> ``TX_PVLS_D``."""
    return F.when(
        numerator_denominator == "D", F.concat(indicator, F.lit("_D"))
    ).otherwise(indicator)
