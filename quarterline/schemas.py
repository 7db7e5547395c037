"""Table schemas, shared column names and the snapshot metadata record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

QUARTERS = ("qtr1", "qtr2", "qtr3", "qtr4")
TOTAL_NUMERATOR = "Total Numerator"


def _struct(strings=(), ints=(), doubles=(), order=()) -> T.StructType:
    kinds = {
        **dict.fromkeys(strings, T.StringType()),
        **dict.fromkeys(ints, T.IntegerType()),
        **dict.fromkeys(doubles, T.DoubleType()),
    }
    return T.StructType([T.StructField(name, kinds[name]) for name in order])


INDICATOR_RESULTS = _struct(
    strings=(
        "indicator", "standardizeddisaggregate", "modality",
        "funding_agency", "mech_code", "mech_name",
    ),
    ints=("fiscal_year",),
    doubles=(*QUARTERS, "targets", "cumulative"),
    order=(
        "fiscal_year", "indicator", "standardizeddisaggregate", "modality",
        "funding_agency", "mech_code", "mech_name", *QUARTERS, "targets", "cumulative",
    ),
)

TARGETS = _struct(
    strings=(
        "type", "indicator", "numeratordenom", "standardizeddisaggregate",
        "ageasentered", "snuprioritization", "funding_agency",
    ),
    ints=("fiscal_year",),
    doubles=("targets",),
    order=(
        "fiscal_year", "type", "indicator", "numeratordenom", "standardizeddisaggregate",
        "ageasentered", "snuprioritization", "funding_agency", "targets",
    ),
)

#: one line of an area-estimate payload; numbers stay text until coerced
AREA_LINE = "area STRING, level STRING, mean STRING, lower STRING, upper STRING"


@dataclass(frozen=True)
class Metadata:
    """What a snapshot says about itself; passed to the reports as literals."""

    curr_fy: int
    curr_qtr: int
    source: str = ""

    @property
    def curr_pd(self) -> str:
        return f"FY{self.curr_fy % 100:02d}Q{self.curr_qtr}"

    @property
    def curr_key(self) -> int:
        return self.curr_fy * 4 + self.curr_qtr

    @property
    def caption(self) -> str:
        return f"Source: {self.source}"
