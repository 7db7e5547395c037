"""The registered queries as SQL over the same input tables."""

from __future__ import annotations

from quarterline.workload import queries as q
from quarterline.workload import tables as t

# -- input tables ---------------------------------------------------------------


def _fiscal_year(date: str) -> str:
    return f"CAST(year({date}) + 22 + CASE WHEN month({date}) >= 10 THEN 1 ELSE 0 END AS INT)"


_QUARTER = (
    "CASE WHEN month(l_shipdate) >= 10 THEN 1 WHEN month(l_shipdate) <= 3 THEN 2 "
    "WHEN month(l_shipdate) <= 6 THEN 3 ELSE 4 END"
)

MSD = f"""
base AS (
  SELECT {_fiscal_year('l_shipdate')} AS fiscal_year, {_QUARTER} AS q,
    p_type AS indicator,
    CASE WHEN l_linestatus = 'O' THEN 'Total Numerator' ELSE 'Modality/Age/Sex/Result' END
      AS standardizeddisaggregate,
    o_orderpriority AS modality, r_name AS funding_agency,
    CAST(s_suppkey AS VARCHAR) AS mech_code, s_name AS mech_name,
    l_returnflag AS flag, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
), msd AS MATERIALIZED (
  SELECT fiscal_year, indicator, standardizeddisaggregate, modality, funding_agency,
    mech_code, mech_name,
    SUM(CASE WHEN flag = 'A' AND q = 1 THEN quantity END) AS qtr1,
    SUM(CASE WHEN flag = 'A' AND q = 2 THEN quantity END) AS qtr2,
    SUM(CASE WHEN flag = 'A' AND q = 3 THEN quantity END) AS qtr3,
    SUM(CASE WHEN flag = 'A' AND q = 4 THEN quantity END) AS qtr4,
    SUM(CASE WHEN flag = 'R' THEN quantity END) AS targets,
    SUM(CASE WHEN flag = 'A' THEN quantity END) AS cumulative
  FROM base GROUP BY ALL
), meta AS (
  SELECT CAST((k - 1) // 4 AS INT) AS fy, CAST((k - 1) % 4 + 1 AS INT) AS qtr, k,
    'FY' || substr(CAST((k - 1) // 4 AS VARCHAR), 3, 2) || 'Q' || CAST((k - 1) % 4 + 1 AS VARCHAR) AS pd
  FROM (SELECT CAST(max(fiscal_year * 4 + CASE WHEN qtr4 IS NOT NULL THEN 4 WHEN qtr3 IS NOT NULL THEN 3
      WHEN qtr2 IS NOT NULL THEN 2 ELSE 1 END) AS INT) AS k
    FROM msd WHERE COALESCE(qtr1, qtr2, qtr3, qtr4) IS NOT NULL)
)"""
_FY, _PD = "(SELECT fy FROM meta)", "(SELECT pd FROM meta)"

TST = f"""
tst AS (
  SELECT {_fiscal_year('o_orderdate')} AS fiscal_year,
    CASE WHEN r_name = 'MIDDLE EAST' THEN 'SUBNAT' WHEN l_linestatus = 'F' THEN 'ALL'
      ELSE 'PSNUxIM' END AS type,
    p_type AS indicator,
    CASE WHEN l_linenumber % 2 = 0 THEN 'D' ELSE 'N' END AS numeratordenom,
    CASE l_returnflag WHEN 'A' THEN 'Total Numerator' WHEN 'N' THEN 'KeyPop/Result' END
      AS standardizeddisaggregate,
    CASE WHEN p_size <= 5 THEN '<01' WHEN p_size <= 10 THEN '01-09' WHEN p_size <= 15 THEN '10-14'
      WHEN p_size <= 25 THEN '15-24' WHEN p_size <= 35 THEN '25-34' WHEN p_size <= 42 THEN '35-49'
      WHEN p_size <= 48 THEN '50+' ELSE 'Unknown' END AS ageasentered,
    c_mktsegment AS snuprioritization,
    CASE WHEN n_nationkey % 2 = 0 THEN 'HHS/' || r_name ELSE r_name END AS funding_agency,
    SUM(l_quantity) AS targets
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""

CROSSWALK = """
mech_names_cw AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS mech_code, s_name AS mech_name,
    CASE WHEN s_acctbal < 3000 THEN 'S' || CAST(s_suppkey AS VARCHAR) END AS mech_name_short
  FROM supplier
)"""

GRID = """
grid AS (
  SELECT c_custkey AS country_no, c_name AS country, 'C ' || CAST(c_custkey AS VARCHAR) AS iso,
    CAST(i.n * 9 + a.n * 3 + s.n AS INT) AS batch_no, i.v AS indicator, a.v AS age, s.v AS sex
  FROM customer
    CROSS JOIN (VALUES (0, 'unaware_plhiv_num'), (1, 'population'), (2, 'aware_plhiv_prop')) i(n, v)
    CROSS JOIN (VALUES (0, 'Y015_019'), (1, 'Y020_024'), (2, 'Y015_999')) a(n, v)
    CROSS JOIN (VALUES (0, 'male'), (1, 'female'), (2, 'both')) s(n, v)
)"""

# the parsed lines straight from the grid, without any text in between
ESTIMATES = GRID + """, lines AS (
  SELECT *, 0 AS j FROM grid WHERE country_no % 7 <> 0
  UNION ALL
  SELECT grid.*, j.j FROM grid JOIN (VALUES (1), (2), (3), (4)) j(j) ON j.j <= country_no % 5
), estimates AS (
  SELECT CAST(batch_no AS VARCHAR) || '-' || CAST(country_no AS VARCHAR) AS request_id,
    batch_no, country_no, iso, indicator, sex, age, '2022-4' AS period,
    CAST(CASE WHEN country_no % 7 = 0 THEN j ELSE j + 1 END AS INT) AS line_no,
    CASE WHEN j = 0 THEN country ELSE 'District ' || CAST(j AS VARCHAR) || ', ' || iso END AS area,
    CAST(CASE WHEN j = 0 THEN 0 ELSE 2 END AS DOUBLE) AS level,
    CAST(CASE WHEN j = 0 THEN country_no * 100 ELSE country_no + j END AS DOUBLE) AS mean,
    CAST(CASE WHEN j = 0 THEN country_no * 100 ELSE country_no + j END - 1 AS DOUBLE) AS lower,
    CAST(CASE WHEN j = 0 THEN NULL ELSE country_no + j + 1 END AS DOUBLE) AS upper
  FROM lines
), labelled AS (
  SELECT * REPLACE (
    CASE age WHEN 'Y015_019' THEN '15-19' WHEN 'Y020_024' THEN '20-24' ELSE '15+' END AS age,
    'Dec 2022' AS period)
  FROM estimates
)"""

_FAULTS = """faults AS (
  SELECT CAST(batch_no AS VARCHAR) || '-' || CAST(country_no AS VARCHAR) AS request_id, iso, indicator, country_no % 10 AS digit,
    CASE country_no % 10 WHEN 3 THEN 'no payload' WHEN 5 THEN 'missing columns: area, level, mean, lower, upper'
      ELSE 'a line with another number of fields' END AS problem
  FROM grid WHERE country_no % 10 IN (3, 5, 8))"""

# -- pieces ---------------------------------------------------------------------


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def _total(name: str) -> str:
    return f"COALESCE(SUM({name}), 0.0) AS {name}"


_SUMS = ", ".join(_total(n) for n in ("qtr1", "qtr2", "qtr3", "qtr4", "targets"))
_QTR_SUMS = ", ".join(_total(n) for n in ("qtr1", "qtr2", "qtr3", "qtr4"))
_ACHIEVED = f"{_total('cumulative')}, {_total('targets')}"


def _sums(*keys: str, measures: str = _SUMS, where: str = "TRUE") -> str:
    return f"sums AS (SELECT {', '.join(keys)}, {measures} FROM msd WHERE {where} GROUP BY ALL)"


def _quarters(*ids: str) -> str:
    """Table ``quarters``: one row per quarter of ``sums``."""
    running = [f"qtr{i}" for i in (1, 2, 3, 4)]
    parts = [
        f"SELECT {', '.join([*ids, ''])} 'FY' || substr(CAST(fiscal_year AS VARCHAR), 3, 2) || 'Q{i}' AS period, "
        f"fiscal_year * 4 + {i} AS period_key, qtr{i} AS results, "
        f"{' + '.join(running[:i])} AS results_cumulative, targets FROM sums"
        for i in (1, 2, 3, 4)
    ]
    return "quarters AS (" + " UNION ALL ".join(parts) + ")"


_YEARS = f"standardizeddisaggregate = 'Total Numerator' AND fiscal_year IN {_in(q.YEARS)}"
_ACHV = "results / NULLIF(targets, 0) AS achv"


def _percent(x: str) -> str:
    return f"CAST(CAST(round_even({x} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


def _comma(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


_CHART_LABELS = (
    f"{_percent('achv')} AS achv_label, {_comma('results')} AS results_label, "
    f"{_comma('targets')} AS targets_label"
)


def _whole(x: str) -> str:
    return f"CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR)"


def _plain(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _clean_number(x: str) -> str:
    return (
        f"CASE WHEN {x} >= 1e9 THEN {_whole(f'({x}) / 1e9')} || 'B' "
        f"WHEN {x} >= 1e6 THEN {_whole(f'({x}) / 1e6')} || 'M' "
        f"WHEN {x} >= 1e3 THEN {_whole(f'({x}) / 1e3')} || 'K' ELSE {_plain(x)} END"
    )


def _one_digit(x: str) -> str:
    """Thousands with one digit; the sums here stay below a million."""
    text = f"CAST(round_even(({x}) / 1e3, 1) AS VARCHAR)"
    return f"CASE WHEN {x} >= 1e3 THEN replace({text} || 'K', '.0K', 'K') ELSE {_plain(x)} END"


def _short_number(x: str) -> str:
    steps = " ".join(
        f"WHEN abs({x}) >= {unit} THEN {_whole(f'({x}) / {unit}')} || '{suffix}'"
        for unit, suffix in (("1e12", "T"), ("1e9", "B"), ("1e6", "M"), ("1e3", "K"))
    )
    return f"CASE {steps} ELSE {_whole(x)} END"


def _achievement_label(x: str, y: str) -> str:
    return f"{_short_number(x)} || ' / ' || {_short_number(y)}"


def _band(quarter: int | str) -> str:
    pace = f"achievement / (CAST({quarter} AS DOUBLE) / 4)"
    return (
        f"CASE WHEN {pace} < 0.75 THEN '<75%' WHEN {pace} < 0.9 THEN '75-89%' "
        f"WHEN {pace} <= 1.1 THEN '90-110%' WHEN {pace} > 1.1 THEN '+110%' END"
    )


def _level(column: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(q.LEVELS, 1))
    return f"CAST(CASE {column} {cases} END AS INT)"


_MOD_TYPE = (
    "CASE WHEN contains(modality, 'URGENT') THEN 'Index' WHEN contains(modality, 'HIGH') THEN "
    "'Other PITC' WHEN contains(modality, 'MEDIUM') THEN 'PMTCT' WHEN modality = '5-LOW' THEN 'VCT' "
    "ELSE 'Other' END"
)
_INDEX_TYPE = "CASE WHEN contains(modality, 'URGENT') THEN 'Index' ELSE 'Other' END"


def _periods(mod_type: str, *keys: str) -> str:
    """Table ``long``: quarterly value per modality group and keys."""
    names = "".join(f"{k}, " for k in keys)
    rows = " UNION ALL ".join(
        f"SELECT mod_type, {names}'FY' || substr(CAST(fiscal_year AS VARCHAR), 3, 2) || 'Q{i}' AS period, "
        f"fiscal_year * 4 + {i} AS period_key, qtr{i} AS value FROM wide"
        for i in (1, 2, 3, 4)
    )
    return f"""
wide AS (
  SELECT fiscal_year, {mod_type} AS mod_type, {names}{_QTR_SUMS} FROM msd
  WHERE indicator = '{t.INDICATOR}' AND standardizeddisaggregate = '{t.DISAGGREGATE}'
    AND fiscal_year <= {_FY}
  GROUP BY ALL
), long AS ({rows})"""


def _shared(*keys: str) -> str:
    by = ", ".join(["period", *keys])
    return (
        f"shared AS (SELECT *, value / NULLIF(SUM(value) OVER (PARTITION BY {by}), 0) "
        "AS contribution FROM long)"
    )


_START_END = (
    "CASE WHEN period_key = (SELECT min(period_key) FROM long) THEN contribution END AS start, "
    'CASE WHEN period_key = (SELECT max(period_key) FROM long) THEN contribution END AS "end"'
)
_RANKS = """
ranks AS (
  SELECT mod_type, median, CAST(row_number() OVER (ORDER BY median DESC, mod_type) AS INT) AS mod_order
  FROM (SELECT mod_type, median(value) AS median FROM long GROUP BY mod_type)
)"""


def _cells(*keys: str) -> str:
    """Table ``cells``: every combination of group, period and key values."""
    names = "".join(f", {k}" for k in keys)
    dims = " ".join(f"CROSS JOIN (SELECT DISTINCT {k} FROM long)" for k in keys)
    return (
        f"cells AS (SELECT mod_type, period, period_key{names} FROM (SELECT DISTINCT mod_type FROM long) "
        f"CROSS JOIN (SELECT DISTINCT period, period_key FROM long) {dims})"
    )


_MECH_GRID = (
    "grid AS (SELECT cells.*, value FROM cells "
    "LEFT JOIN long USING (mod_type, period, period_key, mech_name))"
)
_MARKS = "pd_tot * 0.25 AS pd_25, pd_tot * 0.5 AS pd_50, pd_tot * 0.75 AS pd_75"


def _modality(mod_type: str, share_keys: tuple, keys: tuple, color: str) -> str:
    names = "".join(f", {k}" for k in keys)
    using = ", ".join(["mod_type", "period", "period_key", *keys])
    return f"""WITH {MSD}, {_periods(mod_type, *keys)}, {_shared(*share_keys)}, {_RANKS}, {_cells(*keys)},
ordered AS (
  SELECT shared.*, {_START_END}, mod_order FROM shared JOIN ranks USING (mod_type)
), filled AS (
  SELECT mod_type{names}, period, period_key, value, contribution, start, "end",
    first_value(mod_order IGNORE NULLS) OVER (PARTITION BY mod_type{names} ORDER BY period_key
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mod_order,
    COALESCE(SUM(value) OVER (PARTITION BY period_key{names}), 0.0) AS pd_tot
  FROM cells LEFT JOIN ordered USING ({using})
)
SELECT *, {_MARKS}, {color} AS mod_color,
  CASE WHEN mod_type = 'Index' AND period = 'FY20Q1' THEN '{t.INDICATOR}' END AS note
FROM filled WHERE mod_order IS NOT NULL"""


_COLORS = (
    "CASE mod_type WHEN 'Index' THEN '#855C75' WHEN 'VCT' THEN '#D9AF6B' WHEN 'Other PITC' THEN "
    "'#AF6458' WHEN 'PMTCT' THEN '#736F4C' WHEN 'Community SNS' THEN '#526A83' ELSE '#7C7C7C' END"
)
_INDEX_COLORS = "CASE mod_type WHEN 'Index' THEN '#855C75' ELSE '#D9AF6B' END"

_FILTERED = (
    f"WITH {MSD} SELECT fiscal_year, indicator, standardizeddisaggregate, modality, funding_agency, "
    "mech_code, targets, cumulative FROM msd WHERE "
)
_EXCLUDED = (
    f"standardizeddisaggregate = 'Total Numerator' AND fiscal_year = {_FY} "
    "AND indicator IN ('PROMO', 'LARGE', 'SMALL') AND funding_agency <> 'EUROPE' "
    "AND mech_name <> 'Supplier#000000003' AND mech_code <> '7'"
)
_BY_MECH = (
    f"WITH {MSD}, "
    + _sums(
        "fiscal_year", "mech_code", "mech_name", "funding_agency", "indicator",
        measures=_ACHIEVED, where=_EXCLUDED,
    )
    + ", rated AS (SELECT *, cumulative / NULLIF(targets, 0) AS achievement FROM sums)"
)
_MECH_SUMS = _sums("fiscal_year", "indicator", "mech_code", measures=_ACHIEVED)


def _brief(keys: tuple, where: str = "TRUE", extra: str = "") -> str:
    """The current quarter from its year's row, and the one before from the same row or the year before's last."""
    names = ", ".join(keys)
    running = [f"n.qtr{i}" for i in (1, 2, 3, 4)]

    def of(columns) -> str:
        return "CASE qtr " + " ".join(f"WHEN {i} THEN {c}" for i, c in columns) + " END"

    results = of(enumerate(running, 1))
    so_far = of((i, " + ".join(running[:i])) for i in (1, 2, 3, 4))
    prior = of([(1, "p.qtr4"), (2, "n.qtr1"), (3, "n.qtr2"), (4, "n.qtr3")])
    return f"""WITH {MSD}, sums AS MATERIALIZED (
  SELECT fiscal_year, {names},
    CASE WHEN grouping(funding_agency) = 1 THEN 'Total' ELSE funding_agency END AS agency,
    CAST(grouping(funding_agency) AS INT) AS is_total, {_SUMS}
  FROM msd WHERE standardizeddisaggregate = 'Total Numerator'
    AND fiscal_year IN ({_FY} - 1, {_FY}) AND {where}
  GROUP BY GROUPING SETS ((fiscal_year, {names}), (fiscal_year, {names}, funding_agency))
), joined AS (
  SELECT {', '.join(f'n.{k}' for k in keys)}, n.agency, n.is_total, pd AS period, {results} AS results,
    {so_far} AS results_cumulative, n.targets, {prior} AS prior_results
  FROM meta JOIN sums n ON n.fiscal_year = fy LEFT JOIN sums p ON p.fiscal_year = fy - 1
    AND p.agency = n.agency AND p.is_total = n.is_total
    AND {' AND '.join(f'p.{k} = n.{k}' for k in keys)}
), changed AS (SELECT *, results - prior_results AS change FROM joined)
SELECT {names}, agency AS funding_agency, is_total, period, results, results_cumulative, targets,
  prior_results, results_cumulative / NULLIF(targets, 0) AS achievement, change,
  change / NULLIF(prior_results, 0) AS change_share,
  CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'same' END AS direction,
  'Source: {t.SOURCE} | ' || period AS caption{extra}
FROM changed"""


def _chart(*ids: str, where: str, select: str) -> str:
    keys = ["fiscal_year", *ids]
    return f"""WITH {MSD}, {_sums(*keys, where=f"indicator = '{t.INDICATOR}' AND {_YEARS} AND {where}")},
{_quarters(*ids)}, achieved AS (SELECT *, {_ACHV} FROM quarters)
{select}"""


def _chart_now(agency: str | None) -> str:
    ids = ("indicator", "funding_agency") if agency else ("indicator",)
    where = f"funding_agency = '{agency}'" if agency else "TRUE"
    title = f"{t.INDICATOR} ACHIEVEMENT | {agency or 'ALL AGENCIES'}: "
    return _chart(*ids, where=where, select=(
        f"SELECT *, {_CHART_LABELS}, '{title}' || {_PD} AS title, 'Source: {t.SOURCE}' AS caption "
        f"FROM achieved WHERE period = {_PD}"
    ))


_PROFILED = (
    ("fiscal_year", "int"), ("indicator", "string"), ("standardizeddisaggregate", "string"),
    ("modality", "string"), ("funding_agency", "string"), ("mech_code", "string"),
    ("mech_name", "string"), ("qtr1", "double"), ("qtr2", "double"), ("qtr3", "double"),
    ("qtr4", "double"), ("targets", "double"), ("cumulative", "double"),
)


def _pivot(names, column: str) -> str:
    return ", ".join(f"SUM(CASE WHEN {column} = '{n}' THEN targets END) AS \"{n}\"" for n in names)


_CLEAN_TST = (
    f"{TST}, clean AS (SELECT * REPLACE (CASE WHEN numeratordenom = 'D' THEN indicator || '_D' "
    "ELSE indicator END AS indicator) FROM tst)"
)
_KEPT = (
    "(standardizeddisaggregate IS NULL OR standardizeddisaggregate NOT IN "
    "('KeyPop/Result', 'KeyPop/HIVStatus'))"
)
_URL = (
    f"'{q.BASE_URL}country=' || replace(iso, ' ', '+') || '&indicator=' || indicator || "
    "'&ageGroup=' || age || '&period=2022-4&sex=' || sex || '&areaLevel=2'"
)
_LINE = "area, level, mean, lower, upper"
_REQUEST = "request_id, iso, indicator, sex, age, period, line_no"
_HARVEST = (
    f"WITH {ESTIMATES}, filled AS (SELECT {_REQUEST}, {_LINE}, last_value(CASE WHEN level = 0 THEN "
    "area END IGNORE NULLS) OVER (PARTITION BY request_id ORDER BY line_no ROWS BETWEEN UNBOUNDED "
    "PRECEDING AND CURRENT ROW) AS operatingunit FROM labelled) "
)
_CLASSIFIED = "COUNT(*) AS n_rows, COALESCE(SUM(cumulative), 0.0) AS cumulative FROM msd GROUP BY ALL"
_LONG_IDS = "indicator, standardizeddisaggregate, modality, funding_agency, mech_code"


def _long_rows() -> str:
    year = "'FY' || substr(CAST(fiscal_year AS VARCHAR), 3, 2)"
    parts = [
        f"SELECT {_LONG_IDS}, {year} || 'Q{i}' AS period, fiscal_year * 4 + {i} AS period_key, "
        f"'results' AS period_type, qtr{i} AS value FROM msd WHERE qtr{i} IS NOT NULL"
        for i in (1, 2, 3, 4)
    ] + [
        f"SELECT {_LONG_IDS}, {year} AS period, fiscal_year * 4 + 4 AS period_key, "
        f"'{name}' AS period_type, {name} AS value FROM msd WHERE {name} IS NOT NULL"
        for name in ("targets", "cumulative")
    ]
    return " UNION ALL ".join(parts)


_MECH = f"WITH {MSD}, {_periods(_MOD_TYPE, 'mech_name')}"

_MEDIANS = f"""WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code', measures=_QTR_SUMS)}, medians AS (
  SELECT mech_code, COUNT(*) AS n, quantile_disc(value, 0.5) AS median
  FROM (SELECT mech_code, unnest([qtr1, qtr2, qtr3, qtr4]) AS value FROM sums) GROUP BY mech_code) """

ORACLE: dict[str, str] = {
    "scan_latest_snapshot": (
        "SELECT l_returnflag, 'lineitem.parquet' AS snapshot, COUNT(*) AS n_rows, "
        "SUM(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag"
    ),
    "scan_msd": f"WITH {MSD} SELECT * FROM msd",
    "read_indicators": f"WITH {MSD} SELECT * FROM msd",
    "read_targets": f"WITH {TST} SELECT * FROM tst WHERE type = 'PSNUxIM'",
    "snapshot_metadata": f"""WITH {MSD}, last AS (
      SELECT max(fiscal_year * 4 + CASE WHEN qtr4 IS NOT NULL THEN 4 WHEN qtr3 IS NOT NULL THEN 3
        WHEN qtr2 IS NOT NULL THEN 2 ELSE 1 END) AS k
      FROM msd WHERE COALESCE(qtr1, qtr2, qtr3, qtr4) IS NOT NULL)
      SELECT CAST((k - 1) // 4 AS INT) AS curr_fy, CAST((k - 1) % 4 + 1 AS INT) AS curr_qtr,
        'FY' || substr(CAST((k - 1) // 4 AS VARCHAR), 3, 2) || 'Q' || CAST((k - 1) % 4 + 1 AS VARCHAR)
          AS curr_pd, CAST(k AS INT) AS curr_key, 'results' AS source, 'Source: results' AS caption
      FROM last""",
    "scan_targets_by_type": f"WITH {TST} SELECT * FROM tst WHERE type = 'ALL'",
    "map_mech_names": f"""WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code', measures=_total('targets'))}
      SELECT mech_code, fiscal_year, indicator, targets, r_name AS funding_agency,
        CASE WHEN s_acctbal >= 0 THEN n_name END AS prime_partner_name, s_name AS mech_name
      FROM sums LEFT JOIN (SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey)
        ON mech_code = CAST(s_suppkey AS VARCHAR)""",
    "request_grid_urls": (
        f"WITH {GRID} SELECT country, iso, batch_no, indicator, age, sex, {_URL} AS url FROM grid"
    ),
    "parse_csv_payloads": f"WITH {ESTIMATES} SELECT {_REQUEST}, {_LINE} FROM estimates",
    "failed_requests": f"WITH {GRID}, {_FAULTS} SELECT request_id, iso, indicator, problem FROM faults",
    "rejected_lines": f"""WITH {ESTIMATES}, {_FAULTS}
      SELECT f.request_id, f.iso, f.indicator,
        CAST((SELECT COUNT(*) FROM estimates e WHERE e.request_id = f.request_id) + 1 AS INT) AS line_no,
        'short,2,1' AS fields, '3 fields instead of 5' AS reason
      FROM faults f WHERE digit = 8""",
    "accepted_and_rejected_lines": f"""WITH {ESTIMATES}, {_FAULTS}
      SELECT indicator, 'accepted_line' AS kind, COUNT(*) AS n FROM estimates
      WHERE country_no % 10 NOT IN (3, 5) GROUP BY indicator
      UNION ALL SELECT indicator, 'rejected_line', COUNT(*) FROM faults WHERE digit = 8 GROUP BY indicator
      UNION ALL SELECT indicator, 'failed_request', COUNT(*) FROM faults GROUP BY indicator""",
    "profile_table": f"WITH {MSD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS column_type, COUNT(*) AS rows, "
        f"COUNT({c}) AS non_null, COUNT(DISTINCT {c}) AS n_distinct FROM msd"
        for c, kind in _PROFILED
    ),
    "profile_table_counts": f"WITH {MSD} " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{kind}' AS column_type, COUNT(*) AS rows, "
        f"COUNT({c}) AS non_null FROM msd"
        for c, kind in _PROFILED
    ),
    "filter_conjunctive": _FILTERED + (
        f"indicator = '{t.INDICATOR}' AND standardizeddisaggregate = '{t.DISAGGREGATE}' "
        f"AND fiscal_year <= {_FY}"
    ),
    "filter_in_list": _FILTERED + "indicator IN ('PROMO', 'LARGE')",
    "filter_not_in_list": (
        f"WITH {TST} SELECT indicator, standardizeddisaggregate, COUNT(*) AS n_rows, "
        f"{_total('targets')} FROM tst WHERE {_KEPT} GROUP BY ALL"
    ),
    "filter_exclusions": _FILTERED + "funding_agency <> 'EUROPE' AND mech_code <> '7'",
    "filter_fy_range": _FILTERED + "fiscal_year BETWEEN 2019 AND 2021",
    "classify_modality": f"WITH {MSD} SELECT modality, {_MOD_TYPE} AS mod_type, {_CLASSIFIED}",
    "classify_index_other": f"WITH {MSD} SELECT modality, {_INDEX_TYPE} AS mod_type, {_CLASSIFIED}",
    "age_coarse": f"""WITH {TST} SELECT fiscal_year, indicator,
      CASE WHEN ageasentered IN ('<01', '01-09', '10-14') THEN '<15'
        WHEN ageasentered IN ('15-24', '25-34', '35-49', '50+') THEN '15+' ELSE ageasentered END
        AS trendscoarse, {_total('targets')} FROM tst GROUP BY ALL""",
    "clean_agency": f"""WITH {TST} SELECT funding_agency,
      CASE replace(funding_agency, 'HHS/', '') WHEN 'EUROPE' THEN 'Europe office'
        ELSE replace(funding_agency, 'HHS/', '') END AS clean_name,
      {_total('targets')} FROM tst GROUP BY ALL""",
    "clean_indicator": (
        f"WITH {_CLEAN_TST} SELECT fiscal_year, numeratordenom, indicator, {_total('targets')} "
        "FROM clean GROUP BY ALL"
    ),
    "fix_mech_names": f"""WITH {MSD}, {CROSSWALK}, {_sums(
        'fiscal_year', 'indicator', 'mech_code', 'mech_name', measures=_total('cumulative'))}
      SELECT fiscal_year, indicator, sums.mech_code, cumulative,
        COALESCE(mech_name_short, sums.mech_name) AS mech_name, mech_name_short
      FROM sums LEFT JOIN mech_names_cw cw ON sums.mech_code IS NOT DISTINCT FROM cw.mech_code
        AND sums.mech_name IS NOT DISTINCT FROM cw.mech_name""",
    "compare_columns": f"""WITH {MSD}, {CROSSWALK},
      named AS (SELECT mech_code FROM mech_names_cw WHERE mech_name_short IS NOT NULL), n AS (SELECT
        (SELECT COUNT(*) FROM (SELECT mech_code FROM msd EXCEPT SELECT mech_code FROM named)) AS a,
        (SELECT COUNT(*) FROM (SELECT mech_code FROM named EXCEPT SELECT mech_code FROM msd)) AS b)
      SELECT a AS n_x_not_y, b AS n_y_not_x,
        CASE WHEN a = 0 AND b = 0 THEN 'both hold the same values'
          ELSE 'only in x: ' || CAST(a AS VARCHAR) || ', only in y: ' || CAST(b AS VARCHAR) END AS message FROM n""",
    "union_by_name": f"""WITH {TST}
      SELECT fiscal_year, indicator, snuprioritization, {_total('targets')}, NULL AS funding_agency
      FROM tst WHERE type = 'SUBNAT' GROUP BY fiscal_year, indicator, snuprioritization
      UNION ALL
      SELECT fiscal_year, indicator, NULL, {_total('targets')}, funding_agency
      FROM tst WHERE type = 'ALL' GROUP BY fiscal_year, indicator, funding_agency""",
    "union_indicators": (
        f"WITH {ESTIMATES} SELECT CAST(batch_no // 9 + 1 AS INT) AS src_no, {_REQUEST}, {_LINE} "
        "FROM estimates"
    ),
    "distinct_pairs": f"WITH {MSD} SELECT DISTINCT mech_code, mech_name FROM msd",
    "agg_across_pattern": (
        f"WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code')} SELECT * FROM sums"
    ),
    "reshape_long": f"WITH {MSD} {_long_rows()}",
    "reshape_quarters": (
        f"WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code')}, "
        f"{_quarters('indicator', 'mech_code')} SELECT * FROM quarters"
    ),
    "achievement_quarters": _chart("indicator", where="TRUE", select="SELECT * FROM achieved"),
    "achievement_grouping_sets": f"""WITH {MSD}, sums AS (
      SELECT fiscal_year, indicator,
        CASE WHEN grouping(funding_agency) = 1 THEN 'Total' ELSE funding_agency END AS agency,
        CAST(grouping(funding_agency) AS INT) AS is_total, {_SUMS}
      FROM msd WHERE {_YEARS}
      GROUP BY GROUPING SETS ((fiscal_year, indicator), (fiscal_year, indicator, funding_agency))
      ), {_quarters('indicator', 'agency', 'is_total')}
      SELECT * EXCLUDE (agency), agency AS funding_agency, {_ACHV} FROM quarters""",
    "achievement_by_mech": f"{_BY_MECH} SELECT * FROM rated",
    "achievement_bands": (
        f"WITH {MSD}, {_sums('fiscal_year', 'mech_code', measures=_ACHIEVED)}, "
        "rated AS (SELECT *, cumulative / NULLIF(targets, 0) AS achievement FROM sums) "
        f"SELECT fiscal_year, mech_code, achievement, {_band(3)} AS band FROM rated"
    ),
    "achievement_table": (
        f"{_BY_MECH} SELECT *, {_band('(SELECT qtr FROM meta)')} AS band, "
        f"{_achievement_label('cumulative', 'targets')} AS tgt_rslt_sum FROM rated"
    ),
    "period_brief": _brief(("indicator",)),
    "period_brief_one_indicator": _brief(("indicator",), f"indicator = '{t.INDICATOR}'"),
    "mech_summary": _brief(
        ("mech_code", "mech_name", "indicator"),
        extra=", mech_name || ' PERFORMANCE SUMMARY' AS title",
    ),
    "table_prioritization": f"""WITH {_CLEAN_TST}, wide AS (
      SELECT fiscal_year, indicator, standardizeddisaggregate, {_pivot(q.SEGMENTS, 'snuprioritization')}
      FROM clean WHERE type = 'ALL' AND fiscal_year = 2023 AND indicator IN {_in(q.TABLE_INDICATORS)}
        AND {_KEPT} GROUP BY ALL)
      SELECT fiscal_year, indicator, standardizeddisaggregate,
        {', '.join(f'COALESCE("{s}", 0.0) AS "{s}"' for s in q.SEGMENTS)},
        {_level('indicator')} AS sort_key FROM wide""",
    "table_agency": f"""WITH {_CLEAN_TST}, agencies AS (
      SELECT * REPLACE (replace(funding_agency, 'HHS/', '') AS funding_agency) FROM clean)
      SELECT fiscal_year, indicator, {_pivot(q.AGENCIES, 'funding_agency')}, {_level('indicator')} AS sort_key
      FROM agencies WHERE type = 'PSNUxIM' AND fiscal_year = 2023
        AND indicator IN {_in(q.TABLE_INDICATORS)} GROUP BY ALL""",
    "custom_order": (
        f"WITH {MSD}, {_sums('indicator', measures=_ACHIEVED)} "
        f"SELECT *, {_level('indicator')} AS sort_key FROM sums"
    ),
    "share_of_period": f"{_MECH}, {_shared()} SELECT * FROM shared",
    "share_of_period_keys": f"{_MECH}, {_shared('mech_name')} SELECT * FROM shared",
    "start_end_contribution": f"{_MECH}, {_shared()} SELECT *, {_START_END} FROM shared",
    "category_order": f"{_MECH}, {_RANKS} SELECT * FROM ranks",
    "complete_grid": f"{_MECH}, {_cells('mech_name')}, {_MECH_GRID} SELECT * FROM grid",
    "fill_up": f"""{_MECH}, {_cells('mech_name')}, {_MECH_GRID}
      SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (PARTITION BY mod_type, mech_name
        ORDER BY period_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM grid""",
    "period_totals": f"""{_MECH}, {_cells('mech_name')}, {_MECH_GRID}, totals AS (
      SELECT *, COALESCE(SUM(value) OVER (PARTITION BY period_key, mech_name), 0.0) AS pd_tot FROM grid)
      SELECT *, {_MARKS} FROM totals""",
    "every_nth": f"""WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code')},
      {_quarters('indicator', 'mech_code')}, numbered AS (
        SELECT *, row_number() OVER (PARTITION BY indicator, mech_code ORDER BY period_key) AS n
        FROM quarters)
      SELECT indicator, mech_code, period, period_key, 'results' AS period_type, results AS value
      FROM numbered WHERE (n - 1) % 3 = 0""",
    "every_nth_order": (
        "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) "
        "AS n FROM orders) WHERE (n - 1) % 10 = 0"
    ),
    "modality_by_mech": _modality(_MOD_TYPE, (), ("mech_name",), _COLORS),
    "modality_index": _modality(
        _INDEX_TYPE, ("funding_agency",), ("funding_agency",), _INDEX_COLORS
    ),
    "modality_index_two_keys": _modality(
        _INDEX_TYPE, ("funding_agency", "mech_name"), ("funding_agency", "mech_name"), _INDEX_COLORS
    ),
    "clean_number": f"""WITH {MSD}, {_MECH_SUMS}
      SELECT fiscal_year, indicator, mech_code,
        {_clean_number('cumulative')} AS as_is,
        {_clean_number('cumulative * 500')} AS thousands,
        {_clean_number('cumulative * 500000')} AS millions,
        {_clean_number('cumulative * -1')} AS negative,
        COALESCE({_clean_number('NULLIF(cumulative, 0)')}, 'NA') AS missing,
        {_one_digit('cumulative * 50')} AS one_digit
      FROM sums""",
    "format_achievement": f"""WITH {MSD}, {_MECH_SUMS}
      SELECT fiscal_year, indicator, mech_code,
        {_achievement_label('cumulative', 'targets')} AS plain,
        {_achievement_label('(cumulative * 500)', '(targets * -50000)')} AS scaled,
        {_achievement_label('cumulative', 'NULLIF(targets, 0)')} AS missing
      FROM sums""",
    "indicator_words": """SELECT p_partkey, p_type AS name,
        CASE WHEN p_size % 2 = 0 THEN p_name || ' ' || p_brand
          WHEN len(string_split(p_name, ' ')) >= 3 THEN p_name END AS short_description,
        p_brand AS color FROM part""",
    "label_percent_comma": (
        f"WITH {MSD}, {_sums('fiscal_year', 'indicator', 'mech_code')}, "
        f"{_quarters('indicator', 'mech_code')}, achieved AS (SELECT *, {_ACHV} FROM quarters) "
        f"SELECT indicator, mech_code, period, {_CHART_LABELS} FROM achieved"
    ),
    "chart_achievement_all": _chart_now(None),
    "chart_achievement_agency": _chart_now(q.AGENCY),
    "chart_trend": _chart(
        "indicator", "funding_agency", where=f"funding_agency = '{q.AGENCY}'",
        select=(
            f"SELECT *, {_percent('achv')} AS achv_label, {_comma('results')} AS results_label, "
            f"CASE WHEN period <> 'FY22Q4' THEN {_comma('targets')} END AS targets_label "
            "FROM achieved WHERE period IN ('FY22Q2', 'FY22Q4', 'FY23Q2')"
        ),
    ),
    "label_age_period": f"""WITH {ESTIMATES}
      SELECT e.age AS age_code, l.age, e.period AS period_code, l.period, COUNT(*) AS n_rows
      FROM estimates e JOIN labelled l USING (request_id, line_no) GROUP BY ALL""",
    "fill_operating_unit": _HARVEST + "SELECT * FROM filled",
    "fill_operating_unit_levels": _HARVEST + "SELECT * FROM filled WHERE level = 2",
    "fill_operating_unit_run_on": f"""WITH {ESTIMATES}
      SELECT batch_no, country_no, iso, indicator, sex, age, line_no, {_LINE},
        last_value(CASE WHEN level = 0 THEN area END IGNORE NULLS) OVER (
          ORDER BY batch_no, country_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          AS operatingunit
      FROM estimates""",
    "read_rejects": f"""WITH {MSD} SELECT fiscal_year, COUNT(*) AS n,
        CASE WHEN fiscal_year = 2020 AND funding_agency = 'EUROPE' THEN 'rejected' ELSE 'accepted' END AS kind
      FROM msd GROUP BY ALL""",
    "written_csv": f"WITH {MSD} SELECT * FROM msd",
    "written_by_mech": _brief(
        ("mech_code", "mech_name", "indicator"),
        extra=", mech_name || ' PERFORMANCE SUMMARY' AS title",
    ),
    "sketch_medians": _MEDIANS + "SELECT * FROM medians",
    "sketch_top_mechs": _MEDIANS + """
      SELECT *, CAST(row_number() OVER (ORDER BY median DESC, mech_code) AS INT) AS mod_order
      FROM medians QUALIFY mod_order <= 25""",
    "incremental_sums": f"WITH {MSD} SELECT fiscal_year, indicator, mech_code, {_SUMS}, {_total('cumulative')} FROM msd GROUP BY ALL",
    "complete_wide_grid": f"""WITH {MSD}, sums AS (
        SELECT fiscal_year, modality, mech_code, {_total('targets')}, {_total('cumulative')}
        FROM msd WHERE indicator = '{t.INDICATOR}' AND cumulative IS NOT NULL GROUP BY ALL)
      SELECT k.fiscal_year, k.modality, m.mech_code, COALESCE(targets, 0) AS targets, cumulative
      FROM (SELECT DISTINCT fiscal_year, modality FROM sums) k CROSS JOIN (SELECT DISTINCT mech_code FROM sums) m
        LEFT JOIN sums USING (fiscal_year, modality, mech_code)""",
    "sql_functions": f"""WITH {MSD}, {_MECH_SUMS}
      SELECT fiscal_year, indicator, mech_code, {_clean_number('cumulative * 500')} AS thousands,
        {_achievement_label('(cumulative * 500)', '(targets * -50000)')} AS scaled,
        indicator || ' of mechanism' AS first_words,
        mech_code || '-' || CAST(fiscal_year AS VARCHAR) AS age
      FROM sums""",
}
ORACLE["fix_mech_names_in_buckets"] = ORACLE["fix_mech_names"]
