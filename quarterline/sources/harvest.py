"""Area estimates: request grid, landed CSV payloads, one labelled hierarchical table.

Fetching is outside: a *responses* table holds the text each request returned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterline.functions.labels import age_label, recode
from quarterline.functions.predicates import number
from quarterline.operators.ordered import fill_down, previous_value
from quarterline.schemas import AREA_LINE
from quarterline.session import stage

# What a full harvest asks for, in its order.
INDICATORS = ("unaware_plhiv_num", "population", "aware_plhiv_prop")
AGES = ("Y015_019", "Y020_024", "Y015_999")
SEXES = ("male", "female", "both")
PERIOD = "2022-4"
AREA_LEVEL = "2"
PERIOD_LABELS = {"2022-4": "Dec 2022"}


def request_grid(
    countries: DataFrame,
    indicators: Sequence[str] = INDICATORS,
    ages: Sequence[str] = AGES,
    sexes: Sequence[str] = SEXES,
    period: str = PERIOD,
    area_level: str = AREA_LEVEL,
) -> DataFrame:
    """One row per request: each country with every indicator, age and sex.

    The lists are constants unfolded on each country row, so nothing is shuffled.
    ``batch_no`` numbers the (indicator, age, sex) combinations in request order.
    """
    batches = [
        F.struct(
            F.lit(n).alias("batch_no"), F.lit(indicator).alias("indicator"),
            F.lit(age).alias("age"), F.lit(sex).alias("sex"),
        )
        for n, (indicator, age, sex) in enumerate(
            (i, a, s) for i in indicators for a in ages for s in sexes
        )
    ]
    return countries.select("*", F.inline(F.array(*batches))).withColumns(
        {"period": F.lit(period), "area_level": F.lit(area_level)}
    )


def request_url(base_url: str) -> Column:
    """Address of a request built from the columns of the request grid."""
    # Parameter names of the service and the columns that fill them.
    parameters = (
        ("country", "iso"), ("indicator", "indicator"), ("ageGroup", "age"),
        ("period", "period"), ("sex", "sex"), ("areaLevel", "area_level"),
    )
    parts: list[Column] = []
    for name, column in parameters:
        parts += [F.lit(f"{'&' if parts else ''}{name}="), F.url_encode(F.col(column))]
    return F.concat(F.lit(base_url), *parts)


#: stand-ins for a quoted line break and for a comma between fields, and what spells them where a text has them itself
_HIDDEN, _NEXT, _ESCAPE = "\x1e", "\x1f", "\x1d"
_SPELLED = ((_ESCAPE, _ESCAPE + "0"), (_HIDDEN, _ESCAPE + "1"), (_NEXT, _ESCAPE + "2"))


def _once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are computed once per row, however many expressions read them.

    The optimiser writes a projected expression again wherever it is read, but moves none across a generator.
    """
    for name, value in values.items():
        df = df.select("*", F.explode_outer(F.array(value)).alias(name))
    return df


def _spelled(text: Column) -> Column:
    """Line breaks as one character, and no stand-in in the text itself."""
    breaks = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    safe = breaks
    for sign, spelling in _SPELLED:
        safe = F.replace(safe, F.lit(sign), F.lit(spelling))
    return F.when(text.rlike("[\x1d-\x1f]"), safe).otherwise(breaks)


def _unspelled(field: Column) -> Column:
    plain = field
    for sign, spelling in reversed(_SPELLED):
        plain = F.replace(plain, F.lit(spelling), F.lit(sign))
    return F.when(field.contains(_ESCAPE), plain).otherwise(field)


def _unquoted(field: Column) -> Column:
    """A field without its quotes; two quotes inside are one, and hidden line breaks show again."""
    whole = field.startswith('"') & field.endswith('"') & (F.length(field) > 1)
    inner = F.when(whole, F.substring(field, F.lit(2), F.length(field) - 2)).otherwise(
        F.regexp_replace(F.btrim(field), r'(?s)^"(.*)"$', "$1"))
    return F.when(field.contains('"'), F.replace(F.replace(inner, F.lit('""'), F.lit('"')), F.lit(_HIDDEN), F.lit("\n"))).otherwise(field)


def _records(text: Column) -> Column:
    """Lines of a CSV text, quoted line breaks kept inside their line, commas between fields marked; NULL where a quote stays open.

    A line break or a comma inside quotes follows an odd number of quotes. Cut at quotes, every second piece is quoted
    text, in which breaks are hidden; in the others commas are marked. Then the text is cut at the breaks that are left.
    """
    marked = F.transform(F.split(text, '"', -1), lambda piece, i: F.when(
        i % 2 == 1, F.replace(piece, F.lit("\n"), F.lit(_HIDDEN))).otherwise(F.replace(piece, F.lit(","), F.lit(_NEXT))))
    closed = (F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 0
    lines = F.when(~text.contains('"'), F.split(F.replace(text, F.lit(","), F.lit(_NEXT)), "\n", -1)).when(
        closed, F.split(F.array_join(marked, '"'), "\n", -1))
    return F.filter(lines, lambda line: line != "")


def _fields(line: Column) -> Column:
    """Fields of one line of ``_records``."""
    plain = F.split(line, _NEXT, -1)
    fields = F.transform(plain, lambda field: _unspelled(_unquoted(field)))
    return F.when(line.contains('"') | line.contains(_ESCAPE), fields).otherwise(plain)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def payload_problem(schema: str = AREA_LINE) -> Column:
    """Why ``_payload``, cut into ``_table`` under the names ``_head``, has no table; NULL if it has one."""
    lines, head = F.col("_table"), F.col("_head")
    lacking = F.array_except(F.array(*map(F.lit, _names(schema))), head)
    return (
        F.when(F.col("_payload").isNull(), F.lit("no payload"))
        .when(lines.isNull(), F.lit("a quote is not closed"))
        .when(F.size(lines) == 0, F.lit("empty payload"))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing columns: "), F.array_join(lacking, ", ")))
        .when(F.size(F.array_distinct(head)) < F.size(head), F.lit("a column twice"))
    )


def _read(responses: DataFrame, carry: Sequence[str], schema: str) -> DataFrame:
    """``carry``, ``_table`` (the fields of all records), ``_head`` (names), ``_form`` (problem, width, a place per column)."""
    read = ("_table", "_head", "_form")
    if set(read) <= set(responses.columns):
        return responses.select(*carry, *read)
    cut = _once(
        responses.select(*carry, F.explode_outer(F.array("payload")).alias("_payload")), _text=_spelled(F.col("_payload")))
    cut = _once(cut, _table=F.transform(_records(F.col("_text")), _fields)).drop("_text")
    first = F.get("_table", F.lit(0))
    cut = _once(cut, _head=F.transform(first, lambda name: F.lower(F.btrim(name))))
    places = [(F.array_position("_head", F.lit(name)).cast("int") - 1).alias(name) for name in _names(schema)]
    form = F.struct(payload_problem(schema).alias("problem"), F.size("_head").alias("width"), F.struct(*places).alias("at"))
    return _once(cut, _form=form).drop("_payload")


def read_payloads(responses: DataFrame, carry: Sequence[str], schema: str = AREA_LINE) -> DataFrame:
    """Payloads cut and read once, staged for several of ``parse_payloads``, ``rejected_lines`` and ``failed_requests``.

    These take it in place of the responses, with the same ``schema``.
    """
    return stage(_read(responses, carry, schema))


def failed_requests(responses: DataFrame, carry: Sequence[str], schema: str = AREA_LINE) -> DataFrame:
    """Requests whose payload is no table, or has lines that ``rejected_lines`` lists, with the ``problem``."""
    read = _read(responses, carry, schema)
    ragged = F.exists("_table", lambda line: F.size(line) != F.col("_form.width"))
    problem = F.coalesce(F.col("_form.problem"), F.when(ragged, F.lit("a line with another number of fields")))
    return read.select(*carry, problem.alias("problem")).filter(F.col("problem").isNotNull())


def rejected_lines(responses: DataFrame, carry: Sequence[str], schema: str = AREA_LINE) -> DataFrame:
    """Lines that ``parse_payloads`` leaves out of payloads it reads: ``line_no``, ``fields``, ``reason``."""
    read = _read(responses, carry, schema).filter(F.col("_form.problem").isNull())
    lines = read.select(*carry, "_form", F.posexplode("_table").alias("line_no", "fields"))
    given = F.size("fields")
    return lines.filter(given != F.col("_form.width")).select(
        *carry, "line_no", "fields",
        F.concat(given.cast("string"), F.lit(" fields instead of "), F.col("_form.width").cast("string")).alias("reason"))


def parse_payloads(
    responses: DataFrame, carry: Sequence[str], schema: str = AREA_LINE, on_problem: str = "skip",
    name: str | None = "area", others: str | None = None,
) -> DataFrame:
    """Lines of each CSV payload, with ``line_no`` from 1 and the request's own columns.

    Columns are found by their name in the header, in any order; those that ``schema`` does not
    name are left out, or put into a map by name under ``others``. Quoted commas, quotes and line breaks belong to
    their field. A line with another number of fields than the header is left out alone and
    listed by ``rejected_lines``, the others keep their number. A payload that is no such table (NULL, an error message,
    an open quote) has no rows here and a reason in ``failed_requests``; with ``on_problem="fail"``
    either fails the job. Numbers that do not parse become NULL. A payload is cut and read once, where it lies, without a shuffle.
    """
    extra = [others] if others else []
    return _lines(responses, carry, schema, on_problem, name, None, others=others).select(
        *carry, "line_no", *_names(schema), *extra)


def _lines(
    responses: DataFrame, carry: Sequence[str], schema: str, on_problem: str, name: str | None, top: str | None,
    run_on: Sequence[str] = (), others: str | None = None,
) -> DataFrame:
    """One row per line; with ``top``, that column holds ``name`` of the last line of level 0 so far.

    So far in the payload, or with ``run_on`` in all payloads in that order.
    """
    names = _names(schema)
    read = _read(responses, carry, schema)
    sound = F.col("_form.problem").isNull()
    if on_problem == "fail":
        sound = F.assert_true(sound, F.concat(F.lit("payload: "), F.col("_form.problem"))).isNull()
    read = read.filter(sound)

    def text(row: Column, column: str) -> Column:
        return F.get(row, F.col(f"_form.at.{column}"))

    if top is not None:
        # the level-0 lines with their places, then for each line the last of them: no shuffle
        above = F.filter(
            F.transform("_table", lambda row, i: F.when(
                (i > 0) & (F.size(row) == F.col("_form.width")) & (number(text(row, "level")) == 0),
                F.struct(i.alias("i"), text(row, name).alias("v")))),
            lambda x: x["v"].isNotNull())
        read = _once(read, _above=above)
        earlier = F.lit(None).cast("string")
        if run_on:
            # putting rows in order reads them twice, to find borders and to move them: not the parse, too
            read = read if others else read.drop("_head")
            read = stage(read.withColumn(top, F.try_element_at("_above", F.lit(-1))["v"]))
            read = previous_value(read, top, list(run_on), name="_earlier")
            earlier = F.col("_earlier")
        read = read.withColumn("_earlier", earlier)
    kept = [*carry, "_form", *(["_above", "_earlier"] if top else []), *(["_head"] if others else [])]
    lines = read.select(*kept, F.posexplode("_table").alias("line_no", "_line")).filter("line_no > 0")
    whole = F.size("_line") == F.col("_form.width")
    if on_problem == "fail":
        whole = F.assert_true(whole, F.lit("payload: a line with another number of fields")).isNull()
    columns = [(text(F.col("_line"), c) if c == name else number(text(F.col("_line"), c))).alias(c) for c in names]
    if others:
        columns.append(F.map_filter(
            F.map_from_arrays("_head", "_line"), lambda key, _: ~key.isin(*names)).alias(others))
    if top is not None:
        last = F.try_element_at(F.filter("_above", lambda x: x["i"] <= F.col("line_no")), F.lit(-1))
        columns.append(F.coalesce(last["v"], "_earlier").alias(top))
    return lines.filter(whole).select(*carry, "line_no", *columns)


def label_estimates(estimates: DataFrame, periods: Mapping[str, str] = PERIOD_LABELS) -> DataFrame:
    """Readable ages and periods."""
    return estimates.withColumns({
        "age": age_label(F.col("age")), "period": recode(F.col("period"), periods),
    })


def with_operating_unit(
    estimates: DataFrame,
    order: Sequence[str] = ("line_no",),
    group: Sequence[str] = ("request_id",),
    few: Sequence[str] = ("line_no",),
) -> DataFrame:
    """Name of the country above each area: the last level-0 area before it.

    By request, so that a request without a level-0 line gets NULL; the lines of a
    request come from one payload cell, which bounds them. With no group and an order
    over the whole table the name runs on into the next request; then ``few`` must
    name only order columns with few values (see ``fill_down``).
    """
    top = estimates.withColumn("operatingunit", F.when(F.col("level") == 0, F.col("area")))
    return fill_down(top, "operatingunit", order, group, few)


def run_on_units(
    responses: DataFrame, carry: Sequence[str], order: Sequence[str], on_problem: str = "skip"
) -> DataFrame:
    """Lines of all payloads with ``operatingunit`` running on from one payload into the next.

    ``order`` are columns of ``carry`` that number the requests; all but the last have few values. Payloads are
    parsed once, and what is ordered is a row per payload, not per line.
    """
    columns = [*carry, "line_no", *_names(AREA_LINE), "operatingunit"]
    return _lines(responses, carry, AREA_LINE, on_problem, "area", "operatingunit", order).select(*columns)


def harvest(
    responses: DataFrame,
    carry: Sequence[str] = ("request_id", "iso", "indicator", "sex", "age", "period"),
    levels: Sequence[int] | None = None,
    on_problem: str = "skip",
) -> DataFrame:
    """Responses to the finished table; ``levels`` keeps only those area levels.

    The name above each area is filled inside the payload, before its lines unfold; nothing is shuffled.
    """
    columns = [*carry, "line_no", *_names(AREA_LINE), "operatingunit"]
    estimates = label_estimates(
        _lines(responses, carry, AREA_LINE, on_problem, "area", "operatingunit").select(*columns))
    if levels is None:
        return estimates
    return estimates.filter(F.col("level").isin(*levels))
