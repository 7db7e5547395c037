"""Row classifiers: modality groups, age bands, achievement bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``label`` applies when the text equals, or (``exact=False``) contains, ``text``."""

    label: str
    text: str
    exact: bool = False

    def test(self, column: Column) -> Column:
        return column == self.text if self.exact else column.contains(self.text)


# Modality groups, first match wins, everything else is OTHER.
MODALITY_RULES = (
    Rule("Index", "Index"),
    Rule("Other PITC", "OtherPITC"),
    Rule("PMTCT", "PMTCT"),
    Rule("VCT", "VCT", exact=True),
    Rule("Community SNS", "SNSMod"),
)
INDEX_RULES = (Rule("Index", "Index"),)
OTHER = "Other"

# Colour of each modality group in the two modality reports.
MODALITY_COLORS = {
    "Index": "#855C75",
    "VCT": "#D9AF6B",
    "Other PITC": "#AF6458",
    "PMTCT": "#736F4C",
    "Community SNS": "#526A83",
}
MODALITY_OTHER_COLOR = "#7C7C7C"
INDEX_COLORS = {"Index": "#855C75"}
INDEX_OTHER_COLOR = "#D9AF6B"

# Age bands below and above fifteen.
AGES_UNDER_15 = ("<01", "01-09", "10-14")
AGES_15_PLUS = ("15-24", "25-34", "35-49", "50+")


def first_match(column: Column, rules: Sequence[Rule], default: str = OTHER) -> Column:
    """Label of the first rule that holds; a NULL text matches none."""
    head, *tail = rules
    chain = F.when(head.test(column), F.lit(head.label))
    for rule in tail:
        chain = chain.when(rule.test(column), F.lit(rule.label))
    return chain.otherwise(F.lit(default))


def modality_type(column: Column, rules: Sequence[Rule] = MODALITY_RULES) -> Column:
    return first_match(column, rules)


def index_or_other(column: Column, rules: Sequence[Rule] = INDEX_RULES) -> Column:
    return first_match(column, rules)


def lookup(column: Column, table: dict[str, str], default: str) -> Column:
    """Constant per category, ``default`` for the rest."""
    return first_match(column, [Rule(v, k, exact=True) for k, v in table.items()], default)


def age_coarse(column: Column) -> Column:
    """Fold fine age bands into ``<15`` and ``15+``; other texts stay as they are."""
    return (
        F.when(column.isin(*AGES_UNDER_15), F.lit("<15"))
        .when(column.isin(*AGES_15_PLUS), F.lit("15+"))
        .otherwise(column)
    )


@dataclass(frozen=True)
class Bands:
    """Achievement bands: each lower bound belongs to its band, ``ceiling`` to the one below.

    The thresholds are a choice of this package and can be replaced.
    """

    low: float = 0.75
    near: float = 0.90
    ceiling: float = 1.10
    labels: tuple[str, str, str, str] = ("<75%", "75-89%", "90-110%", "+110%")


def achievement_band(achievement: Column, quarter: int, bands: Bands = Bands()) -> Column:
    """Band of an achievement against the share of the year that has passed."""
    pace = achievement / F.lit(quarter / 4.0)
    below, close, met, over = bands.labels
    return (
        F.when(pace < bands.low, F.lit(below))
        .when(pace < bands.near, F.lit(close))
        .when(pace <= bands.ceiling, F.lit(met))
        .when(pace > bands.ceiling, F.lit(over))
    )
