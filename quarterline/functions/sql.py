"""The scalar helpers as SQL functions: a body of built-in functions that the optimiser puts in place of the call."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarterline.functions.labels import AGE_PARTS, OPEN_AGE, OPEN_AGE_LABEL, UNITS

_WHOLE = "CAST(CAST(bround({}) AS BIGINT) AS STRING)"


def _steps(size: str, value: str, units, rest: str) -> str:
    steps = " ".join(
        f"WHEN {size} >= {unit:.0f}D THEN concat({_WHOLE.format(f'{value} / {unit:.0f}D')}, '{letter}')" for unit, letter in units)
    return f"CASE {steps} ELSE {rest} END"


def _age() -> str:
    text = "code"
    for part, replacement in AGE_PARTS:
        text = f"regexp_replace({text}, '^(.*?){part}', '$1{replacement}')"
    return f"CASE WHEN {text} = '{OPEN_AGE}' THEN '{OPEN_AGE_LABEL}' ELSE {text} END"


#: name and signature, type of the result, body; a body may call those before it
FUNCTIONS = (
    # up to twelve decimals, no trailing zeros; larger sizes as the engine spells them
    ("plain_number(x DOUBLE)", "STRING", """
        CASE WHEN abs(CAST(regexp_replace(format_number(x + 0D, 12), ',|\\\\.?0+$', '') AS DOUBLE) - x) <= abs(x) * 1e-14D
          THEN regexp_replace(format_number(x + 0D, 12), ',|\\\\.?0+$', '')
          ELSE regexp_replace(lower(CAST(x + 0D AS STRING)), '\\\\.0(?=e|$)', '') END"""),
    ("clean_number(x DOUBLE)", "STRING", _steps("x", "x", UNITS[1:], "plain_number(x)")),
    ("short_number(x DOUBLE)", "STRING", _steps("abs(x)", "x", UNITS, _WHOLE.format("x"))),
    ("format_achievement(results DOUBLE, targets DOUBLE)", "STRING",
     "concat(short_number(results), ' / ', short_number(targets))"),
    ("words(text STRING, first INT, last INT)", "STRING", """
        CASE WHEN size(split(text, ' ')) >= last
          THEN array_join(slice(split(text, ' '), first, last - first + 1), ' ') END"""),
    ("age_label(code STRING)", "STRING", _age()),
)


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the functions for this session under their names, replacing earlier ones; the names."""
    names = []
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
