"""The same results in plain SQL over the driver tables, written independently."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

def half_even(x: str, scale: int = 2) -> str:
    """Round a double to the even neighbour at ``scale`` places."""
    y = f"(({x}) * {10**scale})"
    rounded = (
        f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END)"
    )
    return f"{rounded} / {10**scale}" if scale else rounded


# --- building blocks ----------------------------------------------------------------

BLOCKS: dict[str, str] = {}

BLOCKS["legs"] = """
SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""

_FLIGHT = """
  l_shipdate AS FL_DATE,
  l_returnflag || l_linestatus AS OP_CARRIER,
  CASE WHEN l_quantity <> 13 THEN 'N' || l_suppkey END AS TAIL_NUM,
  l_partkey::VARCHAR AS OP_CARRIER_FL_NUM,
  (10000 + c_nationkey)::VARCHAR AS ORIGIN_AIRPORT_ID,
  chr(65 + c_nationkey) || 'AA' AS ORIGIN,
  'City ' || chr(65 + c_nationkey) AS ORIGIN_CITY_NAME,
  (10000 + s_nationkey)::VARCHAR AS DEST_AIRPORT_ID,
  chr(65 + s_nationkey) || 'AA' AS DESTINATION,
  'City ' || chr(65 + s_nationkey) AS DEST_CITY_NAME,
  CASE WHEN l_linenumber = 5 AND l_quantity > 45 THEN NULL
       ELSE l_quantity - 25 + 3 * abs(c_nationkey - s_nationkey) END AS DEP_DELAY,
  l_quantity / 2 + l_linenumber - 18 AS ARR_DELAY,
  CASE WHEN l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS CANCELLED,
  (200 + 100 * abs(c_nationkey - s_nationkey))::DOUBLE / 8 AS AIR_TIME,
  (200 + 100 * abs(c_nationkey - s_nationkey))::DOUBLE AS DISTANCE,
  (20 + 3 * round(l_discount * 100)) / 64 AS OCCUPANCY_RATE"""

_TICKET = """
  l_orderkey::VARCHAR AS ITIN_ID,
  year(l_shipdate) AS "YEAR",
  quarter(l_shipdate) AS "QUARTER",
  chr(65 + c_nationkey) || 'AA' AS ORIGIN,
  'US' AS ORIGIN_COUNTRY,
  'S' || chr(65 + c_nationkey) AS ORIGIN_STATE_ABR,
  'State ' || chr(65 + c_nationkey) AS ORIGIN_STATE_NM,
  CASE WHEN o_orderstatus = 'F' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ROUNDTRIP,
  l_returnflag || l_linestatus AS REPORTING_CARRIER,
  l_quantity AS PASSENGERS,
  floor(l_extendedprice / 25) / 4 AS ITIN_FARE,
  chr(65 + s_nationkey) || 'AA' AS DESTINATION"""

BLOCKS["flights"] = f"SELECT {_FLIGHT} FROM legs"
BLOCKS["tickets"] = f"SELECT {_TICKET} FROM legs"
BLOCKS["airports"] = """
SELECT CASE n_nationkey % 3 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport'
            ELSE 'small_airport' END AS "TYPE",
  'Airport ' || n_name AS "NAME", (n_nationkey * 137.5)::DOUBLE AS ELEVATION_FT,
  'City ' || chr(65 + n_nationkey) AS MUNICIPALITY,
  CASE WHEN n_nationkey <> 24 THEN chr(65 + n_nationkey) || 'AA' END AS IATA_CODE,
  '-' || (60 + 5 * n_nationkey) || '.5, ' || (20 + n_nationkey) || '.25' AS COORDINATES
FROM nation"""

BLOCKS["edge"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  ['Thirty Five', 'THIRTY  five', '12', '12.5', '-5.0', '-5', ' 12', '8.9abc', 'Two Hundred',
   '12 Five', 'thirteen', 'Thirty-Five', '', NULL][(l_linenumber + l_quantity::INT) % 14 + 1] AS RAW_NUM,
  ['Zero', 'seven', 'TEN', 'Ninety', 'hundred', 'eleven', 'Thousand'][l_linenumber] AS RAW_WORD,
  CASE l_quantity::INT % 5
    WHEN 0 THEN strftime(l_shipdate, '%-m/%-d/%y') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
    WHEN 2 THEN strftime(l_shipdate, '%m/%d/%Y') WHEN 3 THEN '13/' || l_linenumber || '/98' END AS RAW_DATE
FROM lineitem"""

BLOCKS["twice"] = """
SELECT * FROM legs UNION ALL SELECT * FROM legs WHERE l_linenumber = 3"""

BLOCKS["rawf"] = f"""
SELECT CASE WHEN l_quantity = 7 THEN 'soon' ELSE strftime(FL_DATE, '%Y-%m-%d') END AS FL_DATE,
  OP_CARRIER, TAIL_NUM, OP_CARRIER_FL_NUM, ORIGIN_AIRPORT_ID, ORIGIN, ORIGIN_CITY_NAME,
  DEST_AIRPORT_ID, DESTINATION, DEST_CITY_NAME, DEP_DELAY::VARCHAR AS DEP_DELAY,
  ARR_DELAY::VARCHAR AS ARR_DELAY, CANCELLED::VARCHAR AS CANCELLED,
  CASE WHEN l_quantity = 11 THEN 'Thirty Five' ELSE AIR_TIME::VARCHAR END AS AIR_TIME,
  CASE l_quantity WHEN 3 THEN 'Five Hundred' WHEN 4 THEN '8.9abc' ELSE DISTANCE::VARCHAR END AS DISTANCE,
  CASE WHEN l_quantity <> 5 THEN OCCUPANCY_RATE::VARCHAR END AS OCCUPANCY_RATE
FROM (SELECT l_quantity, {_FLIGHT} FROM twice)"""

BLOCKS["typedf"] = """
SELECT CASE WHEN FL_DATE <> 'soon' THEN FL_DATE END AS FL_DATE,
  OP_CARRIER, TAIL_NUM, OP_CARRIER_FL_NUM, ORIGIN_AIRPORT_ID, ORIGIN, ORIGIN_CITY_NAME,
  DEST_AIRPORT_ID, DESTINATION, DEST_CITY_NAME, DEP_DELAY::DOUBLE AS DEP_DELAY,
  ARR_DELAY::DOUBLE AS ARR_DELAY, CANCELLED::DOUBLE AS CANCELLED,
  CASE WHEN AIR_TIME = 'Thirty Five' THEN 35 ELSE AIR_TIME::DOUBLE END AS AIR_TIME,
  CASE DISTANCE WHEN 'Five Hundred' THEN 105 WHEN '8.9abc' THEN NULL
       ELSE TRY_CAST(DISTANCE AS DOUBLE) END AS DISTANCE,
  OCCUPANCY_RATE::DOUBLE AS OCCUPANCY_RATE
FROM rawf"""

BLOCKS["rawt"] = f"""
SELECT ITIN_ID, "YEAR"::VARCHAR AS "YEAR", "QUARTER"::VARCHAR AS "QUARTER", ORIGIN, ORIGIN_COUNTRY,
  ORIGIN_STATE_ABR, CASE WHEN l_quantity <> 9 THEN ORIGIN_STATE_NM END AS ORIGIN_STATE_NM,
  ROUNDTRIP::VARCHAR AS ROUNDTRIP, REPORTING_CARRIER,
  CASE WHEN l_quantity = 20 THEN 'Twenty' ELSE PASSENGERS::VARCHAR END AS PASSENGERS,
  CASE WHEN l_quantity = 21 THEN '1,200' ELSE ITIN_FARE::VARCHAR END AS ITIN_FARE, DESTINATION
FROM (SELECT l_quantity, {_TICKET} FROM twice)"""

BLOCKS["rawa"] = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport'
            ELSE 'small_airport' END AS "TYPE",
  'Airport ' || c_name AS "NAME",
  CASE c_nationkey WHEN 3 THEN 'Nine Hundred' WHEN 4 THEN 'high'
       ELSE floor(c_acctbal)::BIGINT::VARCHAR END AS ELEVATION_FT,
  NULL::VARCHAR AS CONTINENT,
  CASE WHEN c_nationkey = 5 THEN 'CA' ELSE 'US' END AS ISO_COUNTRY,
  CASE WHEN c_nationkey <> 6 THEN 'City ' || chr(65 + c_nationkey) END AS MUNICIPALITY,
  CASE WHEN c_nationkey <> 7 THEN chr(65 + c_nationkey) || 'AA' END AS IATA_CODE,
  '-' || (60 + 5 * c_nationkey) || '.5, ' || (20 + c_nationkey) || '.25' AS COORDINATES
FROM customer"""

_MEANS = ("DISTANCE", "OCCUPANCY_RATE", "DEP_DELAY", "ARR_DELAY")
_AVG = ", ".join(f"avg({c}) AS {c}" for c in _MEANS)


def _pair(a: str, b: str, sep: str) -> str:
    return f"least({a}, {b}) || '{sep}' || greatest({a}, {b})"


def _grouped(extra: str) -> dict[str, str]:
    """Route blocks, per period when ``extra`` names period columns."""
    e = f"{extra}, " if extra else ""
    on = "".join(f" AND f.{c} = t.{c}" for c in extra.split(", ") if c)
    et = "".join(f"f.{c}, " for c in extra.split(", ") if c)
    source = "flightsq" if extra else "flights"
    q = "q" if extra else ""
    return {
        f"dirs{q}": f"""
SELECT {e}OP_CARRIER, ORIGIN, DESTINATION, ORIGIN_CITY_NAME, DEST_CITY_NAME, {_AVG},
  count(TAIL_NUM) AS TOTAL_FLIGHTS FROM {source}
GROUP BY {e}OP_CARRIER, ORIGIN, DESTINATION, ORIGIN_CITY_NAME, DEST_CITY_NAME""",
        f"flown{q}": f"""
SELECT {e}{_pair('ORIGIN', 'DESTINATION', '-')} AS ROUTE_KEY, OP_CARRIER,
  {_pair('ORIGIN_CITY_NAME', 'DEST_CITY_NAME', ' -> ')} AS ROUTE_NAME_CITY,
  {_AVG}, sum(TOTAL_FLIGHTS)::BIGINT AS TOTAL_FLIGHTS
FROM dirs{q} GROUP BY ALL""",
        f"sold{q}": f"""
SELECT {e}{_pair('ORIGIN', 'DESTINATION', '-')} AS ROUTE_KEY, REPORTING_CARRIER,
  sum(PASSENGERS) AS PASSENGERS, avg(ITIN_FARE) AS ITIN_FARE FROM tickets GROUP BY ALL""",
        f"joined{q}": f"""
SELECT {et}f.ROUTE_KEY AS ROUTE, f.OP_CARRIER AS CARRIER, f.ROUTE_NAME_CITY,
  f.DISTANCE AS ONE_WAY_DISTANCE_MILES, f.OCCUPANCY_RATE AS AVG_OCCUPANCY_RATE,
  f.DEP_DELAY AS AVG_DEP_DELAY_MINUTES, f.ARR_DELAY AS AVG_ARR_DELAY_MINUTES, f.TOTAL_FLIGHTS,
  t.REPORTING_CARRIER AS CARRIER_FROM_TICKETS, t.PASSENGERS AS TOTAL_PASSENGERS,
  t.ITIN_FARE AS AVG_ROUNDTRIP_FARE_PER_PASSENGER,
  split_part(f.ROUTE_KEY, '-', 1) AS AIRPORT_CODE_A, split_part(f.ROUTE_KEY, '-', 2) AS AIRPORT_CODE_B,
  a."TYPE" AS AIRPORT_A_SIZE, a."NAME" AS AIRPORT_A_NAME, a.ELEVATION_FT AS AIRPORT_A_ELEVATION_FT,
  a.MUNICIPALITY AS AIRPORT_A_CITY, a.COORDINATES AS AIRPORT_A_COORDINATES,
  b."TYPE" AS AIRPORT_B_SIZE, b."NAME" AS AIRPORT_B_NAME, b.ELEVATION_FT AS AIRPORT_B_ELEVATION_FT,
  b.MUNICIPALITY AS AIRPORT_B_CITY, b.COORDINATES AS AIRPORT_B_COORDINATES
FROM flown{q} f JOIN sold{q} t ON f.ROUTE_KEY = t.ROUTE_KEY AND f.OP_CARRIER = t.REPORTING_CARRIER{on}
LEFT JOIN airports a ON a.IATA_CODE = split_part(f.ROUTE_KEY, '-', 1)
LEFT JOIN airports b ON b.IATA_CODE = split_part(f.ROUTE_KEY, '-', 2)""",
        f"earned{q}": f"""
SELECT *, p * AVG_ROUNDTRIP_FARE_PER_PASSENGER AS tr, p * 0.5::DOUBLE * 70 AS br,
  ONE_WAY_DISTANCE_MILES * 2 * 9.18::DOUBLE * TOTAL_FLIGHTS AS mc,
  (CASE WHEN AIRPORT_A_SIZE = 'medium_airport' THEN 5000 ELSE 10000 END
   + CASE WHEN AIRPORT_B_SIZE = 'medium_airport' THEN 5000 ELSE 10000 END)::DOUBLE * TOTAL_FLIGHTS AS af,
  (CASE WHEN AVG_DEP_DELAY_MINUTES > 15 THEN (AVG_DEP_DELAY_MINUTES - 15) * 75
        WHEN AVG_DEP_DELAY_MINUTES IS NOT NULL THEN 0 END
   + CASE WHEN AVG_ARR_DELAY_MINUTES > 15 THEN (AVG_ARR_DELAY_MINUTES - 15) * 75
          WHEN AVG_ARR_DELAY_MINUTES IS NOT NULL THEN 0 END) * TOTAL_FLIGHTS AS dc
FROM (SELECT *, AVG_OCCUPANCY_RATE * 200 * TOTAL_FLIGHTS AS p FROM joined{q})""",
        f"kpi{q}": f"""
SELECT * EXCLUDE (p, tr, br, mc, af, dc), p AS ESTIMATED_PASSENGERS,
  {half_even('tr')} AS TICKET_REVENUE, {half_even('br')} AS BAGGAGE_REVENUE,
  {half_even('tr + br')} AS TOTAL_REVENUE, ONE_WAY_DISTANCE_MILES * 2 AS ROUND_TRIP_DISTANCE_MILES,
  {half_even('mc')} AS MILEAGE_COST, {half_even('af')} AS AIRPORT_FEES, {half_even('dc')} AS DELAY_COST,
  {half_even('mc + af + dc')} AS TOTAL_COST, {half_even('(tr + br) - (mc + af + dc)')} AS PROFIT
FROM earned{q}""",
    }


BLOCKS["flightsq"] = """
SELECT *, year(FL_DATE) AS "YEAR", quarter(FL_DATE) AS "QUARTER" FROM flights"""
BLOCKS.update(_grouped(""))
BLOCKS.update(_grouped('"YEAR", "QUARTER"'))
BLOCKS["ml"] = """
SELECT * FROM kpi WHERE (AIRPORT_A_SIZE = 'medium_airport' AND AIRPORT_B_SIZE = 'large_airport')
   OR (AIRPORT_A_SIZE = 'large_airport' AND AIRPORT_B_SIZE = 'medium_airport')"""
BLOCKS["summary"] = f"""
SELECT ROUTE_NAME_CITY, {half_even('sum(PROFIT)')} AS PROFIT,
  {half_even('avg(AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES)', 6)} AS AVG_TOTAL_DELAY_MINUTES,
  {half_even('sum(ESTIMATED_PASSENGERS)', 6)} AS ESTIMATED_PASSENGERS,
  {half_even('avg(ROUND_TRIP_DISTANCE_MILES)', 6)} AS ROUND_TRIP_DISTANCE_MILES
FROM ml GROUP BY ROUTE_NAME_CITY"""
BLOCKS["delays"] = f"""
SELECT ROUTE_NAME_CITY,
  {half_even('avg(AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES)', 6)} AS AVG_TOTAL_DELAY_MINUTES,
  {half_even('sum(DELAY_COST)')} AS DELAY_COST
FROM ml GROUP BY ROUTE_NAME_CITY"""

_KPI_DOUBLES = (
    "ONE_WAY_DISTANCE_MILES", "AVG_OCCUPANCY_RATE", "AVG_DEP_DELAY_MINUTES",
    "AVG_ARR_DELAY_MINUTES", "TOTAL_PASSENGERS", "AVG_ROUNDTRIP_FARE_PER_PASSENGER",
    "AIRPORT_A_ELEVATION_FT", "AIRPORT_B_ELEVATION_FT", "ESTIMATED_PASSENGERS", "TICKET_REVENUE",
    "BAGGAGE_REVENUE", "TOTAL_REVENUE", "ROUND_TRIP_DISTANCE_MILES", "MILEAGE_COST",
    "AIRPORT_FEES", "DELAY_COST", "TOTAL_COST", "PROFIT",
)
_RATIOS = {
    "PROFIT_MARGIN_PCT": "PROFIT / nullif(TOTAL_REVENUE, 0) * 100",
    "COST_PER_PASSENGER": "TOTAL_COST / nullif(ESTIMATED_PASSENGERS, 0)",
    "REVENUE_PER_PASSENGER": "TOTAL_REVENUE / nullif(ESTIMATED_PASSENGERS, 0)",
    "PROFIT_PER_PASSENGER": "PROFIT / nullif(ESTIMATED_PASSENGERS, 0)",
    "FLIGHTS_PER_1000_MILES": "TOTAL_FLIGHTS / nullif(ROUND_TRIP_DISTANCE_MILES / 1000, 0)",
    "MILEAGE_COST_PCT": "MILEAGE_COST / nullif(TOTAL_COST, 0) * 100",
    "AIRPORT_FEES_PCT": "AIRPORT_FEES / nullif(TOTAL_COST, 0) * 100",
    "DELAY_COST_PCT": "DELAY_COST / nullif(TOTAL_COST, 0) * 100",
    "PASSENGERS_PER_FLIGHT": "ESTIMATED_PASSENGERS / nullif(TOTAL_FLIGHTS, 0)",
    "REVENUE_PER_FLIGHT": "TOTAL_REVENUE / nullif(TOTAL_FLIGHTS, 0)",
    "PROFIT_PER_FLIGHT": "PROFIT / nullif(TOTAL_FLIGHTS, 0)",
    "COST_PER_FLIGHT": "TOTAL_COST / nullif(TOTAL_FLIGHTS, 0)",
}
BLOCKS["ratios"] = (
    "SELECT *, " + ", ".join(f"{x} AS {c}" for c, x in _RATIOS.items()) + " FROM ml"
)
_TEXTS = (
    "ROUTE", "CARRIER", "ROUTE_NAME_CITY", "TOTAL_FLIGHTS", "CARRIER_FROM_TICKETS",
    "AIRPORT_CODE_A", "AIRPORT_CODE_B", "AIRPORT_A_SIZE", "AIRPORT_A_NAME", "AIRPORT_A_CITY",
    "AIRPORT_A_COORDINATES", "AIRPORT_B_SIZE", "AIRPORT_B_NAME", "AIRPORT_B_CITY",
    "AIRPORT_B_COORDINATES",
)
BLOCKS["rounded"] = (
    f"SELECT {', '.join(_TEXTS)}, "
    + ", ".join(f"{half_even(c)} AS {c}" for c in (*_KPI_DOUBLES, *_RATIOS))
    + " FROM ratios"
)
BLOCKS["ext"] = """
SELECT *, AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES AS DELAY_MINUTES_PER_FLIGHT,
  BAGGAGE_REVENUE / nullif(TOTAL_REVENUE, 0) * 100 AS BAGGAGE_REVENUE_PCT,
  AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES AS TOTAL_DELAY_MINUTES FROM rounded"""

_NEEDS = {
    "flights": ["legs"], "tickets": ["legs"], "twice": ["legs"], "rawf": ["twice"],
    "typedf": ["rawf"], "rawt": ["twice"], "flightsq": ["flights"],
    "dirs": ["flights"], "flown": ["dirs"], "sold": ["tickets"],
    "joined": ["flown", "sold", "airports"], "earned": ["joined"], "kpi": ["earned"],
    "dirsq": ["flightsq"], "flownq": ["dirsq"], "soldq": ["tickets"],
    "joinedq": ["flownq", "soldq", "airports"], "earnedq": ["joinedq"], "kpiq": ["earnedq"],
    "ml": ["kpi"], "summary": ["ml"], "delays": ["ml"],
    "ratios": ["ml"], "rounded": ["ratios"], "ext": ["rounded"],
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        if n not in seen:
            _ordered(_NEEDS.get(n, []), seen)
            seen.append(n)
    return seen


def sql(name: str, uses: str, body: str, **local: str) -> None:
    """Register ``body`` on top of the blocks it uses, plus blocks of its own."""
    parts = [f"{n} AS ({BLOCKS[n]})" for n in _ordered(uses.split(), [])]
    parts += [f"{n} AS ({text})" for n, text in local.items()]
    ORACLE[name] = (f"WITH {', '.join(parts)} " if parts else "") + body


# Number words.
_WORDS = (
    "MAP {'zero': 0, 'one': 1, 'two': 2, 'three': 3, 'four': 4, 'five': 5, 'six': 6, 'seven': 7, "
    "'eight': 8, 'nine': 9, 'ten': 10, 'twenty': 20, 'thirty': 30, 'forty': 40, 'fifty': 50, "
    "'sixty': 60, 'seventy': 70, 'eighty': 80, 'ninety': 90, 'hundred': 100, 'thousand': 1000}"
)
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _clean(x: str, whole: str = "[0-9]+") -> str:
    words = f"string_split_regex(trim({x}), '\\s+')"
    return (
        f"CASE WHEN regexp_full_match({x}, '{whole}') OR regexp_full_match({x}, '-?[0-9]+\\.[0-9]+') "
        f"THEN TRY_CAST({x} AS DOUBLE) ELSE list_sum(list_filter(list_transform({words}, "
        f"lambda w: ({_WORDS})[lower(w)]), lambda v: v IS NOT NULL))::DOUBLE END"
    )


_PARSED = (
    "CASE WHEN regexp_full_match(trim({0}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
    "THEN TRY_CAST(trim({0}) AS DOUBLE) END"
)
_ISO_ONLY = "CASE WHEN regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN {0} END"


def _error(raw: str, converted: str) -> tuple[str, str]:
    left = f"trim(regexp_replace({raw}, '[0-9.\\-]', '', 'g'))"
    kind = (
        f"CASE WHEN {converted} IS NOT NULL THEN 'No error' WHEN {raw} IS NULL THEN "
        f"'Original value was NaN' WHEN {left} <> '' THEN 'Invalid characters' ELSE 'Format error' END"
    )
    detail = (
        f"CASE WHEN {converted} IS NOT NULL OR {raw} IS NULL THEN '' WHEN {left} <> '' "
        f"THEN 'Invalid: ' || {left} ELSE 'Invalid: ' || {raw} END"
    )
    return kind, detail


# --- sources ------------------------------------------------------------------------

sql("s01_read_raw_csv", "edge", f"""
SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in _KEYS.split(', '))},
  nullif(RAW_NUM, '') AS RAW_NUM, RAW_WORD, RAW_DATE FROM edge""")
sql("s02_read_clean", "", "SELECT l_orderkey, l_quantity FROM lineitem")
sql("s02_read_clean_nan", "", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <> 7 THEN l_quantity END AS QUANTITY FROM lineitem""")
sql("s03_write_parquet", "tickets", "SELECT * FROM tickets")
sql("s03_write_csv", "rawa", "SELECT * FROM rawa")

# --- cleaning -----------------------------------------------------------------------

sql("c01_word_number", "edge", f"""
SELECT {_KEYS}, RAW_WORD, (({_WORDS})[lower(RAW_WORD)])::DOUBLE AS "VALUE" FROM edge""")
sql("c02_clean_numeric", "edge", f"""
SELECT {_KEYS}, RAW_NUM, {_clean('RAW_NUM')} AS "VALUE",
  {_clean('RAW_NUM', '-?[0-9]+')} AS SIGNED_VALUE FROM edge""")
sql("c03_clean_numeric_columns", "typedf", """
SELECT OP_CARRIER_FL_NUM, TAIL_NUM, AIR_TIME, DISTANCE, OCCUPANCY_RATE FROM typedf""")
sql("c04_standardize_date", "edge", f"""
SELECT {_KEYS}, RAW_DATE, CASE WHEN contains(RAW_DATE, '/')
  THEN strftime(try_strptime(RAW_DATE, '%m/%d/%y'), '%Y-%m-%d') ELSE RAW_DATE END AS ISO_DATE FROM edge""")
sql("c05_audit_conversions", "edge", """
SELECT *, RAW_NUM_converted IS NOT NULL AS RAW_NUM_conversion_success,
  RAW_WORD_converted IS NOT NULL AS RAW_WORD_conversion_success,
  RAW_DATE_converted IS NOT NULL AS RAW_DATE_conversion_success FROM c""",
    c=f"""SELECT *, {_PARSED.format('RAW_NUM')} AS RAW_NUM_converted,
  {_PARSED.format('RAW_WORD')} AS RAW_WORD_converted,
  {_ISO_ONLY.format('RAW_DATE')} AS RAW_DATE_converted FROM edge""")
_kind, _detail = _error("RAW_NUM", "n")
sql("c06_classify_conversion_error", "edge", f"""
SELECT {_KEYS}, RAW_NUM, {_kind} AS error_type, {_detail} AS detail
FROM (SELECT *, {_PARSED.format('RAW_NUM')} AS n FROM edge)""")
_kind, _detail = _error("raw", "ok")
sql("c07_conversion_error_report", "edge", """
SELECT column_name, error_type, detail, count(*) AS row_count,
  CASE WHEN length(detail) > 80 THEN substr(detail, 1, 77) || '...' ELSE detail END AS printed_detail
FROM failed GROUP BY column_name, error_type, detail""",
    cells=f"""
SELECT 'RAW_NUM' AS column_name, RAW_NUM AS raw, {_PARSED.format('RAW_NUM')}::VARCHAR AS ok FROM edge
UNION ALL SELECT 'RAW_WORD', RAW_WORD, {_PARSED.format('RAW_WORD')}::VARCHAR FROM edge
UNION ALL SELECT 'RAW_DATE', RAW_DATE, {_ISO_ONLY.format('RAW_DATE')} FROM edge""",
    failed=f"SELECT column_name, {_kind} AS error_type, {_detail} AS detail FROM cells WHERE ok IS NULL")
sql("c08_fill_by_type", "typedf", """
SELECT OP_CARRIER, coalesce(TAIL_NUM, 'Unknown') AS TAIL_NUM, coalesce(DEP_DELAY, 0) AS DEP_DELAY,
  coalesce(OCCUPANCY_RATE, 0) AS OCCUPANCY_RATE, coalesce(FL_DATE, '1970-01-01') AS FL_DATE FROM typedf""")
sql("c09_parse_date_parts", "typedf", """
SELECT OP_CARRIER, TAIL_NUM, FL_DATE, year(FL_DATE::DATE) AS "YEAR", month(FL_DATE::DATE) AS "MONTH"
FROM typedf""")
sql("c10_symmetric_key", "flights", f"""
SELECT ORIGIN, DESTINATION, {_pair('ORIGIN', 'DESTINATION', '-')} AS ROUTE_KEY,
  {_pair('ORIGIN_CITY_NAME', 'DEST_CITY_NAME', ' -> ')} AS ROUTE_NAME_CITY FROM flights""")
sql("c11_split_route", "tickets", f"""
SELECT ITIN_ID, {_pair('ORIGIN', 'DESTINATION', '-')} AS ROUTE_KEY,
  least(ORIGIN, DESTINATION) AS AIRPORT_A, greatest(ORIGIN, DESTINATION) AS AIRPORT_B,
  least(ORIGIN, DESTINATION) AS STRICT_A, greatest(ORIGIN, DESTINATION) AS STRICT_B FROM tickets""")
sql("c12_parse_coordinates", "rawa", """
SELECT "NAME", trim(split_part(COORDINATES, ',', 1))::DOUBLE AS LON,
  trim(split_part(COORDINATES, ',', 2))::DOUBLE AS LAT FROM rawa""")
sql("c13_to_route_schema", "joined", "SELECT * FROM joined")
sql("c14_round_money", "", f"""
SELECT {_KEYS}, {half_even('l_extendedprice * l_discount')} AS DISCOUNT,
  {half_even('l_extendedprice / 8')} AS EIGHTH FROM lineitem""")
sql("c15_project", "kpi", """
SELECT ROUTE_NAME_CITY, AIRPORT_CODE_A, AIRPORT_CODE_B, TOTAL_FLIGHTS, PROFIT FROM kpi""")

# --- quality ------------------------------------------------------------------------

_FLIGHT_COLUMNS = (
    "FL_DATE", "OP_CARRIER", "TAIL_NUM", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN",
    "ORIGIN_CITY_NAME", "DEST_AIRPORT_ID", "DESTINATION", "DEST_CITY_NAME", "DEP_DELAY",
    "ARR_DELAY", "CANCELLED", "AIR_TIME", "DISTANCE", "OCCUPANCY_RATE",
)


def _nulls(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS total_count, "
        f"count(*) FILTER ({c} IS NULL) AS null_count FROM {source}"
        for c in _FLIGHT_COLUMNS
    )


sql("q01_null_profile", "rawf", f"""
SELECT *, {half_even('null_count / total_count * 100', 6)} AS null_pct FROM n WHERE null_count > 0""",
    n=_nulls("rawf"))
sql("r28_null_order", "typedf", "SELECT column_name, null_count FROM n WHERE null_count > 0",
    n=_nulls("typedf"))
sql("q02_null_patterns", "typedf", f"""
SELECT {' || '.join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _FLIGHT_COLUMNS)} AS pattern,
  count(*) AS row_count FROM typedf GROUP BY 1""")
sql("q03_classify_columns", "flights", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' "
    f"ELSE 'numerical' END AS kind FROM flights"
    if c in ("DEP_DELAY", "ARR_DELAY", "AIR_TIME", "DISTANCE", "OCCUPANCY_RATE")
    else f"SELECT '{c}' AS column_name, '{'ordinal' if c == 'CANCELLED' else 'categorical'}' AS kind"
    for c in _FLIGHT_COLUMNS))
sql("q04_drop_all_null_columns", "rawa", "SELECT * EXCLUDE (CONTINENT) FROM rawa")
sql("q05_drop_high_null_columns", "", """
SELECT 'Airport ' || c_name AS "NAME",
  CASE WHEN c_custkey % 10 = 0 THEN 'City ' || chr(65 + c_nationkey) END AS MUNICIPALITY FROM customer""")


def _duplicates(keys: str, label: str) -> str:
    return f"""
SELECT sum(n)::BIGINT AS total_count, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_count,
  {half_even('coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n)::DOUBLE * 100', 6)} AS duplicate_pct,
  '{label}' AS columns_checked
FROM (SELECT count(*) AS n FROM rawt GROUP BY {keys})"""


sql("q06_duplicate_stats", "rawt", _duplicates(
    "ITIN_ID, \"YEAR\", \"QUARTER\", ORIGIN, ORIGIN_COUNTRY, ORIGIN_STATE_ABR, ORIGIN_STATE_NM, "
    "ROUNDTRIP, REPORTING_CARRIER, PASSENGERS, ITIN_FARE, DESTINATION", "all columns"))
sql("q06_duplicate_stats_subset", "rawt", _duplicates(
    "ITIN_ID, REPORTING_CARRIER", "ITIN_ID, REPORTING_CARRIER"))
sql("q07_drop_duplicates", "rawt", "SELECT DISTINCT * FROM rawt")
sql("q07_drop_duplicates_subset", "rawf", """
SELECT OP_CARRIER, ORIGIN, DESTINATION, TAIL_NUM, OP_CARRIER_FL_NUM, DISTANCE FROM rawf
QUALIFY row_number() OVER (PARTITION BY OP_CARRIER, ORIGIN, DESTINATION
  ORDER BY OP_CARRIER_FL_NUM, TAIL_NUM NULLS FIRST, DISTANCE) = 1""")
sql("q08_impute_median_mode", "typedf", """
SELECT OP_CARRIER, ORIGIN, coalesce(TAIL_NUM, (SELECT TAIL_NUM FROM typedf WHERE TAIL_NUM IS NOT NULL
    GROUP BY TAIL_NUM ORDER BY count(*) DESC, TAIL_NUM LIMIT 1)) AS TAIL_NUM,
  coalesce(DEP_DELAY, (SELECT quantile_cont(DEP_DELAY, 0.5) FROM typedf)) AS DEP_DELAY,
  coalesce(OCCUPANCY_RATE, (SELECT quantile_cont(OCCUPANCY_RATE, 0.5) FROM typedf)) AS OCCUPANCY_RATE,
  coalesce(DISTANCE, (SELECT quantile_cont(DISTANCE, 0.5) FROM typedf)) AS DISTANCE FROM typedf""")
sql("q08_impute_mean_constant", "typedf", """
SELECT OP_CARRIER, ORIGIN, coalesce(TAIL_NUM, 'Unknown') AS TAIL_NUM,
  coalesce(DEP_DELAY, avg(DEP_DELAY) OVER ()) AS DEP_DELAY,
  coalesce(OCCUPANCY_RATE::VARCHAR, 'Unknown') AS OCCUPANCY_RATE,
  coalesce(DISTANCE, avg(DISTANCE) OVER ()) AS DISTANCE FROM typedf""")
sql("q09_impute_predicted", "", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ROW_KEY,
  CASE WHEN l_partkey % 150 <> 149 THEN 'C' || (l_partkey % 150) END AS CODE, l_linestatus AS FLAG,
  'G' || (l_partkey % 150 % 7) AS GROUP_NAME FROM lineitem""")
sql("q09_impute_two_classes", "", """
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ROW_KEY, 'P' || l_partkey AS PART,
  CASE WHEN l_partkey % 2 = 0 THEN 'even' ELSE 'odd' END AS SIDE FROM lineitem""")
sql("q09_impute_predicted_exactly", "rawt", """
SELECT ITIN_ID, ORIGIN_STATE_ABR, 'State ' || substr(ORIGIN_STATE_ABR, 2) AS ORIGIN_STATE_NM FROM rawt""")


def _profile(c: str, number: bool) -> str:
    n = f"""count(*) FILTER ({c} = 0) AS zero_count, {half_even(f'avg({c})', 6)} AS mean,
  {half_even(f'stddev_samp({c})', 6)} AS std, min({c}) AS "min", max({c}) AS "max",
  quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75"""
    t = """0::BIGINT AS zero_count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS "min",
  NULL::DOUBLE AS "max", NULL::DOUBLE AS p25, NULL::DOUBLE AS p50, NULL::DOUBLE AS p75"""
    top = f"FROM typedf WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c}::VARCHAR LIMIT 1"
    text = f"{c} || ' 00:00:00'" if c == "FL_DATE" else f"{c}::VARCHAR"
    return f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS null_count,
  {n if number else t}, count(DISTINCT {c}) AS distinct_count,
  (SELECT {text} {top}) AS top_value, (SELECT count(*) {top}) AS top_count FROM typedf"""


_FLIGHT_NUMBERS = ("DEP_DELAY", "ARR_DELAY", "CANCELLED", "AIR_TIME", "DISTANCE", "OCCUPANCY_RATE")
_FLIGHT_TEXTS = (
    "FL_DATE", "OP_CARRIER", "TAIL_NUM", "OP_CARRIER_FL_NUM", "ORIGIN_AIRPORT_ID", "ORIGIN",
    "ORIGIN_CITY_NAME", "DEST_AIRPORT_ID", "DESTINATION", "DEST_CITY_NAME",
)
sql("q10_column_profile", "typedf", " UNION ALL ".join(
    [_profile(c, True) for c in _FLIGHT_NUMBERS] + [_profile(c, False) for c in _FLIGHT_TEXTS]))
sql("q10_correlations", "flights", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {half_even(f'corr({a}, {b})', 6)} AS corr FROM flights"
    for i, a in enumerate(_FLIGHT_NUMBERS) for b in _FLIGHT_NUMBERS[i + 1:]))

# --- filters ------------------------------------------------------------------------

_KEPT = "SELECT OP_CARRIER, ORIGIN, DESTINATION, TAIL_NUM, CANCELLED FROM typedf WHERE CANCELLED = 0"
sql("f01_filter_allowed", "typedf", _KEPT)
sql("f01_filter_allowed_strict", "typedf", _KEPT + " AND TAIL_NUM IN ('N1', 'N2', 'N3')")
sql("f01a_filter_airports", "rawa", """
SELECT * FROM rawa WHERE "TYPE" IN ('medium_airport', 'large_airport') AND ISO_COUNTRY = 'US'""")
sql("f01b_filter_flights", "flights", """
SELECT OP_CARRIER, ORIGIN, DESTINATION, DISTANCE, CANCELLED FROM flights WHERE CANCELLED = 0""")
sql("f01c_filter_tickets", "tickets", "SELECT * FROM tickets WHERE ROUNDTRIP = 1")
sql("f02_medium_large", "ml", "SELECT * FROM ml")
sql("f03_positive", "ml", """
SELECT ROUTE, CARRIER, TOTAL_COST, TOTAL_REVENUE FROM ml WHERE TOTAL_COST > 0 AND TOTAL_REVENUE > 0""")
_SPOT = "PROFIT >= 500000 AND AVG_TOTAL_DELAY_MINUTES <= 10 AND ESTIMATED_PASSENGERS >= 10000"
sql("f04_sweet_spot", "summary", f"SELECT * FROM summary WHERE {_SPOT}")
_NAMED = "('City A -> City B', 'City D -> City E', 'City G -> City K', 'City J -> City W')"
sql("f05_named_routes", "kpi", f"""
SELECT ROUTE_NAME_CITY, CARRIER, PROFIT, TOTAL_FLIGHTS FROM kpi WHERE ROUTE_NAME_CITY IN {_NAMED}""")
_SHARES = """
SELECT *, MILEAGE_COST / nullif(TOTAL_COST, 0) AS MILEAGE_COST_PCT,
  AIRPORT_FEES / nullif(TOTAL_COST, 0) AS AIRPORT_FEES_PCT,
  DELAY_COST / nullif(TOTAL_COST, 0) AS DELAY_COST_PCT FROM ml"""
_BALANCED = """
SELECT * FROM shares WHERE MILEAGE_COST_PCT <= 0.7::DOUBLE AND AIRPORT_FEES_PCT <= 0.7::DOUBLE
  AND DELAY_COST_PCT <= 0.7::DOUBLE
  AND DELAY_COST_PCT <= (SELECT quantile_cont(DELAY_COST_PCT, 0.5) FROM shares)"""
sql("f06_balanced_cost", "ml", """
SELECT ROUTE, CARRIER, PROFIT, MILEAGE_COST_PCT, AIRPORT_FEES_PCT, DELAY_COST_PCT FROM balanced""",
    shares=_SHARES, balanced=_BALANCED)

# --- joins --------------------------------------------------------------------------

_SIDES = {
    "raw": 'SELECT "NAME", IATA_CODE FROM rawa',
    "known": 'SELECT IATA_CODE AS CODE, "TYPE", ELEVATION_FT FROM airports',
    "named": "SELECT IATA_CODE AS CODE, count(*) AS NAMES FROM rawa GROUP BY IATA_CODE",
}
for _how in ("inner", "left", "right", "outer"):
    _join = "FULL OUTER" if _how == "outer" else _how.upper()
    sql(f"j01_join_on_{_how}", "rawa airports",
        f"SELECT * FROM raw {_join} JOIN known ON IATA_CODE = CODE", **_SIDES)
_HOT = {
    "lines": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 THEN NULL
  WHEN l_linenumber <= 2 THEN 1 ELSE l_orderkey END AS ORDER_KEY FROM lineitem""",
    "placed": """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS PLACED_KEY, o_orderstatus
  FROM orders""",
}
for _how, _join in (("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL OUTER")):
    sql(f"j01_join_on_{_how}_hot_keys", "",
        f"SELECT * FROM lines {_join} JOIN placed ON ORDER_KEY = PLACED_KEY", **_HOT)
sql("j02_join_on_key_hot_keys", "", """
SELECT coalesce(ORDER_KEY, PLACED_KEY) AS ORDER_KEY, l_orderkey, l_linenumber, l_partkey, o_orderstatus
FROM lines FULL OUTER JOIN placed ON ORDER_KEY = PLACED_KEY""", **_HOT)
sql("j01_join_on_null_safe", "rawa airports",
    "SELECT * FROM raw LEFT JOIN known ON IATA_CODE IS NOT DISTINCT FROM CODE", **_SIDES)
for _name, _on in (
    ("j02_join_on_key", "n.CODE = k.CODE"),
    ("j02_join_on_key_null_safe", "n.CODE IS NOT DISTINCT FROM k.CODE"),
):
    sql(_name, "rawa airports", f"""
SELECT coalesce(n.CODE, k.CODE) AS CODE, NAMES, "TYPE", ELEVATION_FT
FROM named n FULL OUTER JOIN known k ON {_on}""", **_SIDES)
sql("j03_equi_join", "", """
SELECT l_orderkey, l_quantity, o_orderkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
sql("j04_join_flights_tickets", "flown sold", """
SELECT f.*, t.REPORTING_CARRIER, t.PASSENGERS, t.ITIN_FARE FROM flown f JOIN sold t
ON f.ROUTE_KEY = t.ROUTE_KEY AND OP_CARRIER = REPORTING_CARRIER""")


def _airport(side: str) -> str:
    return ", ".join(
        f'{side.lower()}."{c}" AS AIRPORT_{side}_{c}'
        for c in ("TYPE", "NAME", "ELEVATION_FT", "MUNICIPALITY", "COORDINATES")
    )


sql("j05_add_airport", "sold airports", f"""
SELECT s.*, split_part(ROUTE_KEY, '-', 1) AS AIRPORT_A, split_part(ROUTE_KEY, '-', 2) AS AIRPORT_B,
  {_airport('B')} FROM sold s LEFT JOIN airports b ON b.IATA_CODE = split_part(ROUTE_KEY, '-', 2)""")
sql("j06_enrich_routes", "flown sold airports", f"""
SELECT f.*, t.REPORTING_CARRIER, t.PASSENGERS, t.ITIN_FARE,
  split_part(f.ROUTE_KEY, '-', 1) AS AIRPORT_A, split_part(f.ROUTE_KEY, '-', 2) AS AIRPORT_B,
  {_airport('A')}, {_airport('B')}
FROM flown f JOIN sold t ON f.ROUTE_KEY = t.ROUTE_KEY AND OP_CARRIER = REPORTING_CARRIER
LEFT JOIN airports a ON a.IATA_CODE = split_part(f.ROUTE_KEY, '-', 1)
LEFT JOIN airports b ON b.IATA_CODE = split_part(f.ROUTE_KEY, '-', 2)""")

# --- aggregations -------------------------------------------------------------------

sql("a01_flights_by_direction", "dirs", "SELECT * FROM dirs")
sql("a02_flights_by_route", "flown", "SELECT * FROM flown")
_WEIGHTED = ", ".join(
    f"sum({c} * TOTAL_FLIGHTS) / nullif(sum(TOTAL_FLIGHTS) FILTER ({c} IS NOT NULL), 0)::DOUBLE AS {c}"
    for c in _MEANS
)
sql("a02_flights_by_route_weighted", "dirs", f"""
SELECT {_pair('ORIGIN', 'DESTINATION', '-')} AS ROUTE_KEY, OP_CARRIER,
  {_pair('ORIGIN_CITY_NAME', 'DEST_CITY_NAME', ' -> ')} AS ROUTE_NAME_CITY, {_WEIGHTED},
  sum(TOTAL_FLIGHTS)::BIGINT AS TOTAL_FLIGHTS FROM dirs GROUP BY 1, 2, 3""")
sql("a03_tickets_by_route", "sold", "SELECT * FROM sold")
sql("a04_route_summary", "summary", "SELECT * FROM summary")
sql("a05_sum_by_route", "ml", f"""
SELECT ROUTE_NAME_CITY, {half_even('sum(PROFIT)')} AS PROFIT FROM ml GROUP BY 1""")
_QUIET = {
    "flights": f"""SELECT * REPLACE (CASE WHEN 'City A' NOT IN (ORIGIN_CITY_NAME, DEST_CITY_NAME)
  THEN DEP_DELAY END AS DEP_DELAY) FROM (SELECT {_FLIGHT} FROM legs)""",
    "tickets": f"""SELECT * REPLACE (CASE WHEN 'AAA' NOT IN (ORIGIN, DESTINATION) THEN PASSENGERS END
  AS PASSENGERS) FROM (SELECT {_TICKET} FROM legs)""",
    **{n: BLOCKS[n] for n in ("dirs", "flown", "sold", "joined", "earned", "kpi")},
}
sql("a03_tickets_by_route_unknown", "legs", """
SELECT ROUTE_KEY, REPORTING_CARRIER, coalesce(PASSENGERS, 0) AS PASSENGERS, ITIN_FARE FROM sold""", **_QUIET)
sql("a04_route_summary_unknown", "legs airports", f"""
SELECT ROUTE_NAME_CITY, {half_even('coalesce(sum(PROFIT), 0)')} AS PROFIT,
  {half_even('avg(AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES)', 6)} AS AVG_TOTAL_DELAY_MINUTES,
  {half_even('coalesce(sum(ESTIMATED_PASSENGERS), 0)', 6)} AS ESTIMATED_PASSENGERS,
  {half_even('avg(ROUND_TRIP_DISTANCE_MILES)', 6)} AS ROUND_TRIP_DISTANCE_MILES
FROM kpi GROUP BY ROUTE_NAME_CITY""", **_QUIET)
sql("a05_sum_by_route_unknown", "legs airports", f"""
SELECT ROUTE_NAME_CITY, {half_even('coalesce(sum(PROFIT), 0)')} AS PROFIT FROM kpi GROUP BY 1""", **_QUIET)
sql("a07_delay_metrics_unknown", "legs airports", f"""
SELECT ROUTE_NAME_CITY,
  {half_even('avg(AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES)', 6)} AS AVG_TOTAL_DELAY_MINUTES,
  {half_even('coalesce(sum(DELAY_COST), 0)')} AS DELAY_COST FROM kpi GROUP BY ROUTE_NAME_CITY""", **_QUIET)
sql("k07_delay_cost_unknown", "legs airports", """
SELECT ROUTE, CARRIER, AVG_DEP_DELAY_MINUTES, DELAY_COST, TOTAL_COST, PROFIT FROM kpi""", **_QUIET)
sql("a06_flights_per_route", "ml", """
SELECT ROUTE_NAME_CITY, AIRPORT_CODE_A, AIRPORT_CODE_B, sum(TOTAL_FLIGHTS)::BIGINT AS TOTAL_FLIGHTS
FROM ml GROUP BY 1, 2, 3""")
sql("a07_delay_metrics", "delays", "SELECT * FROM delays")

_DESCRIBED = (
    "ONE_WAY_DISTANCE_MILES", "AVG_OCCUPANCY_RATE", "AVG_DEP_DELAY_MINUTES",
    "AVG_ARR_DELAY_MINUTES", "TOTAL_FLIGHTS", "TOTAL_PASSENGERS",
    "AVG_ROUNDTRIP_FARE_PER_PASSENGER", "TICKET_REVENUE", "BAGGAGE_REVENUE", "TOTAL_REVENUE",
    "ROUND_TRIP_DISTANCE_MILES", "MILEAGE_COST", "AIRPORT_FEES", "DELAY_COST", "TOTAL_COST",
    "PROFIT", "ESTIMATED_PASSENGERS",
)
for _name, _source in (("a08_describe_all", "kpi"), ("a08_describe_medium_large", "ml")):
    sql(_name, _source, " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count({c}) AS "count", {half_even(f'avg({c})', 4)} AS mean,
  {half_even(f'stddev_samp({c})', 4)} AS std, min({c})::DOUBLE AS "min",
  quantile_cont({c}::DOUBLE, 0.25) AS p25, quantile_cont({c}::DOUBLE, 0.5) AS p50,
  quantile_cont({c}::DOUBLE, 0.75) AS p75, max({c})::DOUBLE AS "max" FROM {_source}"""
        for c in _DESCRIBED))
sql("a09_min_max", "ml", "SELECT min(TOTAL_COST) AS low, max(TOTAL_COST) AS high FROM ml")
sql("a10_profit_histogram", "ml", f"""
SELECT bin, count(*) AS row_count, count(*) FILTER (PROFIT < 0) AS loss_count,
  count(*) FILTER (PROFIT >= 0) AS profit_count,
  {half_even('any_value(lo) + bin * any_value(w)', 4)} AS bin_low,
  {half_even('any_value(lo) + (bin + 1) * any_value(w)', 4)} AS bin_high
FROM (SELECT PROFIT, lo, w, least(floor((PROFIT - lo) / w)::INT, 49) AS bin
      FROM ml, (SELECT min(PROFIT) AS lo, (max(PROFIT) - min(PROFIT)) / 50 AS w FROM ml)
      WHERE PROFIT IS NOT NULL)
GROUP BY bin""")
sql("a11_box_stats", "ml", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, any_value(q1) AS q1, any_value(q2) AS median,
  any_value(q3) AS q3,
  min({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max({c}) FILTER ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM ml, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
          quantile_cont({c}, 0.75) AS q3 FROM ml)""" for c in ("PROFIT", "DELAY_COST")))

# --- outliers -----------------------------------------------------------------------

_PRICED = f"""
SELECT {_KEYS}, l_quantity, l_extendedprice, l_extendedprice / l_quantity AS unit_price FROM lineitem"""
sql("o01_outlier_flags_zscore", "", """
SELECT priced.*, abs((l_extendedprice - m1) / s1) > 1.5 AS l_extendedprice_is_outlier,
  abs((unit_price - m2) / s2) > 1.5 AS unit_price_is_outlier
FROM priced, (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS s1,
  avg(unit_price) AS m2, stddev_pop(unit_price) AS s2 FROM priced)""", priced=_PRICED)
sql("o02_outlier_flags_iqr", "", """
SELECT priced.*, l_extendedprice < a1 - 1.5 * (a3 - a1) OR l_extendedprice > a3 + 1.5 * (a3 - a1)
    AS l_extendedprice_is_outlier,
  unit_price < b1 - 1.5 * (b3 - b1) OR unit_price > b3 + 1.5 * (b3 - b1) AS unit_price_is_outlier
FROM priced, (SELECT quantile_cont(l_extendedprice, 0.25) AS a1, quantile_cont(l_extendedprice, 0.75) AS a3,
  quantile_cont(unit_price, 0.25) AS b1, quantile_cont(unit_price, 0.75) AS b3 FROM priced)""", priced=_PRICED)


def _shape(c: str, test: str, bounds: str) -> str:
    return f"""SELECT '{c}' AS column_name,
  {half_even(f'avg(({c} - m) ** 3) / any_value(s) ** 3')} AS skewness,
  {half_even(f'avg(({c} - m) ** 4) / any_value(s) ** 4 - 3')} AS kurtosis,
  count(*) FILTER ({test}) AS outlier_count
FROM flights, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, {bounds} FROM flights)"""


_SHAPED = ("DEP_DELAY", "ARR_DELAY", "DISTANCE", "OCCUPANCY_RATE")
sql("o03_outlier_summary_iqr", "flights", " UNION ALL ".join(
    _shape(c, f"{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)",
           f"quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3") for c in _SHAPED))
sql("o03_outlier_summary_zscore", "flights", " UNION ALL ".join(
    _shape(c, f"abs(({c} - m) / s) > 2", "1 AS one") for c in _SHAPED))


def _mad(source: str, columns: tuple[str, ...], suffix: str = "") -> dict[str, str]:
    """Medians, and absolute deviations around them."""
    med = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in columns)
    mad = ", ".join(f"quantile_cont(abs({c} - med_{c}), 0.5) AS mad_{c}" for c in columns)
    return {
        f"med{suffix}": f"SELECT {med} FROM {source}",
        f"mad{suffix}": f"SELECT {', '.join(f'any_value(med_{c}) AS med_{c}' for c in columns)}, "
        f"{mad} FROM {source}, med{suffix}",
    }


def _clip(c: str, k: int) -> str:
    low, high = f"med_{c} - {k} * mad_{c}", f"med_{c} + {k} * mad_{c}"
    return f"CASE WHEN {c} < {low} THEN {low} WHEN {c} > {high} THEN {high} ELSE {c} END"


sql("o04_cap_mad", "", f"""
SELECT {_KEYS}, {_clip('l_quantity', 1)} AS l_quantity, l_extendedprice,
  {_clip('unit_price', 1)} AS unit_price FROM priced, mad""",
    priced=_PRICED, **_mad("priced", ("l_quantity", "unit_price")))
_LEGS = ("DEP_DELAY", "ARR_DELAY", "DISTANCE")
sql("o05_cap_mad_report", "flights", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) FILTER (abs({c} - ({_clip(c, 1)})) > 1e-8) AS capped_rows,
  count(*) AS row_count, any_value(med_{c}) AS median, any_value(mad_{c}) AS mad,
  any_value(med_{c} - mad_{c}) AS lower, any_value(med_{c} + mad_{c}) AS upper,
  {half_even(f'count(*) FILTER (abs({c} - ({_clip(c, 1)})) > 1e-8) / count(*) * 100', 6)} AS capped_pct,
  any_value(mad_{c} = 0) AS collapsed FROM flights, mad""" for c in _LEGS), **_mad("flights", _LEGS))

# --- rankings -----------------------------------------------------------------------

_TIES = "ROUTE, CARRIER, ROUTE_NAME_CITY, AIRPORT_CODE_A, AIRPORT_CODE_B"
_PLACE = "ROUTE_NAME_CITY, AIRPORT_CODE_A, AIRPORT_CODE_B"
_DELAY = "AVG_DEP_DELAY_MINUTES + AVG_ARR_DELAY_MINUTES"


def _ranked(columns: str, source: str, order: str, n: int, ties: str = _TIES) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {order} NULLS LAST, {ties} LIMIT {n}"


_R = {
    "r01_busiest": _ranked(f"{_PLACE}, TOTAL_FLIGHTS", "ml", "TOTAL_FLIGHTS DESC", 10),
    "r02_most_profitable": _ranked(
        f"{_PLACE}, TOTAL_FLIGHTS, TOTAL_REVENUE, TOTAL_COST, PROFIT, TICKET_REVENUE, BAGGAGE_REVENUE, "
        "MILEAGE_COST, AIRPORT_FEES, DELAY_COST", "ml", "PROFIT DESC", 10),
    "r03_recommended": _ranked(
        f"{_PLACE}, PROFIT, PROFIT / 1000000 AS PROFIT_MILLION", "ml", "PROFIT DESC", 5),
    "r04_most_demanded": _ranked(
        f"{_PLACE}, ESTIMATED_PASSENGERS", "ml", "ESTIMATED_PASSENGERS DESC", 5),
    "r05_most_punctual": _ranked(
        f"{_PLACE}, AVG_DEP_DELAY_MINUTES, AVG_ARR_DELAY_MINUTES, {_DELAY} AS AVG_TOTAL_DELAY",
        "ml", "AVG_TOTAL_DELAY", 5),
    "r06_busiest_grouped": _ranked(
        f"{_PLACE}, sum(TOTAL_FLIGHTS)::BIGINT AS TOTAL_FLIGHTS", f"ml GROUP BY {_PLACE}",
        "sum(ml.TOTAL_FLIGHTS) DESC", 5, _PLACE),
    "r07_best_revenue_to_cost": _ranked(
        f"{_PLACE}, TOTAL_REVENUE, TOTAL_COST, TOTAL_REVENUE / TOTAL_COST AS REV_TO_COST_RATIO",
        "ml WHERE TOTAL_COST > 0", "REV_TO_COST_RATIO DESC", 5),
}
for _name, _body in _R.items():
    sql(_name, "ml", _body)
_BEST_BALANCED = _ranked(
    "ROUTE_NAME_CITY, PROFIT, TOTAL_COST, MILEAGE_COST_PCT, AIRPORT_FEES_PCT, DELAY_COST_PCT",
    "balanced", "PROFIT DESC", 5)
sql("r08_best_balanced", "ml", _BEST_BALANCED, shares=_SHARES, balanced=_BALANCED)
_BREAKEVEN = f"""
SELECT ROUTE_NAME_CITY, TOTAL_FLIGHTS, PROFIT, ppf AS PROFIT_PER_FLIGHT,
  {half_even('90000000 / nullif(ppf, 0)', 0)} AS BREAKEVEN_FLIGHTS, ESTIMATED_PASSENGERS,
  {_DELAY} AS AVG_TOTAL_DELAY
FROM (SELECT *, PROFIT / nullif(TOTAL_FLIGHTS, 0) AS ppf FROM kpi) WHERE ROUTE_NAME_CITY IN {_NAMED}"""
sql("r09_breakeven", "kpi", _BREAKEVEN)
sql("r10_top_cities_passengers", "summary", """
SELECT ROUTE_NAME_CITY, ESTIMATED_PASSENGERS FROM summary
ORDER BY ESTIMATED_PASSENGERS DESC NULLS LAST, ROUTE_NAME_CITY LIMIT 10""")
sql("r10_top_cities_profit", "summary", """
SELECT ROUTE_NAME_CITY, PROFIT FROM summary ORDER BY PROFIT DESC NULLS LAST, ROUTE_NAME_CITY LIMIT 10""")
sql("r11_least_delayed_cities", "delays", """
SELECT ROUTE_NAME_CITY, AVG_TOTAL_DELAY_MINUTES FROM delays
ORDER BY AVG_TOTAL_DELAY_MINUTES NULLS LAST, ROUTE_NAME_CITY LIMIT 15""")
_ENDS = ", ".join(
    f"trim(split_part(AIRPORT_{s}_COORDINATES, ',', {i}))::DOUBLE AS {n}_{s}"
    for s in ("A", "B") for i, n in ((1, "LON"), (2, "LAT"))
)
sql("r12_top_with_coordinates", "ml", _ranked(
    f"ROUTE_NAME_CITY, ESTIMATED_PASSENGERS, {_ENDS}", "ml", "ESTIMATED_PASSENGERS DESC", 10))
for _name, _n in (("r13_final_candidates", 5), ("r13_sweet_spots", 10)):
    sql(_name, "summary", f"""
SELECT * FROM summary WHERE {_SPOT} ORDER BY PROFIT DESC, ESTIMATED_PASSENGERS DESC, ROUTE_NAME_CITY LIMIT {_n}""")


def _best(order: str) -> str:
    return f"""SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY ROUTE_NAME_CITY
  ORDER BY {order} {_TIES}) = 1"""


sql("r14_revenue_mix", "ml", _ranked(
    "ROUTE_NAME_CITY, TICKET_REVENUE, BAGGAGE_REVENUE", "best", "PROFIT DESC", 10),
    best=_best("PROFIT DESC NULLS LAST,"))
sql("r15_cost_breakdown", "ml", _ranked(
    "ROUTE_NAME_CITY, MILEAGE_COST, AIRPORT_FEES, DELAY_COST", "best", "PROFIT DESC", 10),
    best=_best("PROFIT DESC NULLS LAST,"))
sql("r16_costliest_delays", "ml", _ranked(
    "ROUTE_NAME_CITY, DELAY_COST", "best", "DELAY_COST DESC", 10),
    best=_best("DELAY_COST DESC NULLS LAST,"))
_FARE = "AVG_ROUNDTRIP_FARE_PER_PASSENGER"
sql("r17_highest_fares", "ml", _ranked(f"ROUTE_NAME_CITY, {_FARE}", "best", f"{_FARE} DESC", 10),
    best=_best(""))
sql("r18_distance_and_cost", "ml", """
SELECT ROUTE_NAME_CITY, ROUND_TRIP_DISTANCE_MILES, TOTAL_COST, ESTIMATED_PASSENGERS FROM best""",
    best=_best(""))
sql("r19_worst_mean_delay", "delays", """
SELECT * FROM delays ORDER BY AVG_TOTAL_DELAY_MINUTES DESC NULLS LAST, ROUTE_NAME_CITY LIMIT 10""")
sql("r19_worst_delay_cost", "delays", """
SELECT * FROM delays ORDER BY DELAY_COST DESC NULLS LAST, ROUTE_NAME_CITY LIMIT 10""")
for _name, _metric, _n, _also in (
    ("r20_top_margin", "PROFIT_MARGIN_PCT", 10, ""),
    ("r21_top_profit_per_flight", "PROFIT_PER_FLIGHT", 10, ""),
    ("r22_top_profit_per_passenger", "PROFIT_PER_PASSENGER", 10, ", COST_PER_PASSENGER"),
    ("r23_top_revenue_per_passenger", "REVENUE_PER_PASSENGER", 10, ", COST_PER_PASSENGER"),
    ("r24_top_baggage_share", "BAGGAGE_REVENUE_PCT", 10, ""),
    ("r25_top_frequency", "FLIGHTS_PER_1000_MILES", 10, ""),
    ("r26_top_profit_and_distance", "PROFIT", 10,
     ", ROUND_TRIP_DISTANCE_MILES, ESTIMATED_PASSENGERS, PROFIT_MARGIN_PCT"),
    ("r27_top_passengers_and_delay", "ESTIMATED_PASSENGERS", 50,
     ", TOTAL_DELAY_MINUTES, PROFIT, AVG_DEP_DELAY_MINUTES"),
):
    sql(_name, "ext", _ranked(
        f"ROUTE_NAME_CITY, CARRIER, {_metric}{_also}", "ext", f"{_metric} DESC", _n))
sql("r20_leaders", "ext", " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{metric}' AS RANKING, row_number() OVER (ORDER BY {metric} DESC NULLS LAST, "
    f'{_TIES})::INT AS "POSITION", ROUTE_NAME_CITY, CARRIER, {metric}::DOUBLE AS "VALUE" FROM ext) '
    f'WHERE "POSITION" <= {n}'
    for metric, n in (
        ("PROFIT_MARGIN_PCT", 10), ("PROFIT_PER_FLIGHT", 10), ("PROFIT_PER_PASSENGER", 10),
        ("REVENUE_PER_PASSENGER", 10), ("BAGGAGE_REVENUE_PCT", 10), ("FLIGHTS_PER_1000_MILES", 10),
        ("PROFIT", 10), ("ESTIMATED_PASSENGERS", 50),
    )))
sql("r29_occupancy_and_distance", "ml", """
SELECT ROUTE_NAME_CITY, ONE_WAY_DISTANCE_MILES, AVG_OCCUPANCY_RATE, ESTIMATED_PASSENGERS FROM ml""")
sql("r30_cost_and_revenue", "ml", """
SELECT ROUTE_NAME_CITY, TOTAL_COST, TOTAL_REVENUE, ESTIMATED_PASSENGERS,
  TOTAL_REVENUE > TOTAL_COST AS ABOVE_BREAKEVEN FROM ml WHERE TOTAL_COST > 0 AND TOTAL_REVENUE > 0""")

# --- KPIs ---------------------------------------------------------------------------

for _name, _columns in {
    "k01_estimated_passengers": "ESTIMATED_PASSENGERS",
    "k02_ticket_revenue": "TICKET_REVENUE",
    "k03_baggage_revenue": "BAGGAGE_REVENUE",
    "k04_total_revenue": "TOTAL_REVENUE",
    "k05_mileage_cost": "ROUND_TRIP_DISTANCE_MILES, MILEAGE_COST",
    "k06_airport_fees": "AIRPORT_FEES",
    "k07_delay_cost": "DELAY_COST",
    "k08_profit": "TOTAL_COST, PROFIT",
    "k14_total_delay": f"{_DELAY} AS AVG_TOTAL_DELAY",
    "k15_breakeven_flights": "PROFIT / nullif(TOTAL_FLIGHTS, 0) AS PROFIT_PER_FLIGHT, "
    + half_even("90000000 / nullif(PROFIT / nullif(TOTAL_FLIGHTS, 0), 0)", 0) + " AS BREAKEVEN_FLIGHTS",
    "k16_revenue_to_cost": "TOTAL_REVENUE / nullif(TOTAL_COST, 0) AS REV_TO_COST_RATIO, "
    "PROFIT / 1000000 AS PROFIT_MILLION",
    "w03_occupancy_rate":
    "ESTIMATED_PASSENGERS / nullif(TOTAL_FLIGHTS * 200, 0) AS OCCUPANCY_RATE",
}.items():
    sql(_name, "kpi", f"SELECT ROUTE, CARRIER, {_columns} FROM kpi")
for _name, _columns in {
    "k09_profit_margin": ("PROFIT_MARGIN_PCT",),
    "k10_per_passenger": ("COST_PER_PASSENGER", "REVENUE_PER_PASSENGER", "PROFIT_PER_PASSENGER"),
    "k11_flights_per_1000_miles": ("FLIGHTS_PER_1000_MILES",),
    "k12_cost_shares": ("MILEAGE_COST_PCT", "AIRPORT_FEES_PCT", "DELAY_COST_PCT"),
    "k13_per_flight": (
        "PASSENGERS_PER_FLIGHT", "REVENUE_PER_FLIGHT", "PROFIT_PER_FLIGHT", "COST_PER_FLIGHT"),
}.items():
    sql(_name, "kpi", "SELECT ROUTE, CARRIER, "
        + ", ".join(f"{_RATIOS[c]} AS {c}" for c in _columns) + " FROM kpi")
sql("w01_passenger_growth", "kpiq", """
SELECT n.ROUTE, n.CARRIER, n."YEAR", n."QUARTER", n.ESTIMATED_PASSENGERS,
  (n.ESTIMATED_PASSENGERS - b.ESTIMATED_PASSENGERS) / nullif(b.ESTIMATED_PASSENGERS, 0) * 100
    AS PASSENGER_GROWTH_PCT
FROM kpiq n LEFT JOIN kpiq b ON b.ROUTE = n.ROUTE AND b.CARRIER = n.CARRIER
  AND b.ROUTE_NAME_CITY = n.ROUTE_NAME_CITY
  AND (b."YEAR" = n."YEAR" AND b."QUARTER" = n."QUARTER" - 1
    OR n."QUARTER" = 1 AND b."QUARTER" = 4 AND b."YEAR" = n."YEAR" - 1)""")
sql("w02_breakeven_tracker", "kpiq", f"""
SELECT ROUTE, CARRIER, "YEAR", "QUARTER", PROFIT, {half_even('total')} AS CUMULATIVE_PROFIT,
  {half_even('total')} / 90000000 AS BREAKEVEN_PROGRESS FROM summed""",
    summed=f"""SELECT *, sum(PROFIT) OVER (PARTITION BY ROUTE, CARRIER, ROUTE_NAME_CITY
  ORDER BY "YEAR", "QUARTER" ROWS UNBOUNDED PRECEDING) AS total FROM kpiq""")

# --- pipelines ----------------------------------------------------------------------



def _filled(fills: dict[str, str], source: str, columns: tuple[str, ...]) -> str:
    return "SELECT " + ", ".join(
        f"{fills[c]} AS {c}" if c in fills else c for c in columns
    ) + f" FROM {source}"


def _capped(k: int, source: str, capped: tuple[str, ...], columns: tuple[str, ...], mad: str) -> str:
    return "SELECT " + ", ".join(
        f"{_clip(c, k)} AS {c}" if c in capped else c for c in columns
    ) + f" FROM {source}, {mad}"


_AIRPORT_COLUMNS = (
    '"TYPE"', '"NAME"', "ELEVATION_FT", "ISO_COUNTRY", "MUNICIPALITY", "IATA_CODE", "COORDINATES",
)
_CLEAN_AIRPORTS = {
    "kepta": """
SELECT DISTINCT "TYPE", "NAME", CASE WHEN ELEVATION_FT = 'Nine Hundred' THEN 109
    WHEN regexp_full_match(ELEVATION_FT, '[0-9]+') THEN ELEVATION_FT::DOUBLE END AS ELEVATION_FT,
  ISO_COUNTRY, MUNICIPALITY, IATA_CODE, COORDINATES FROM rawa
WHERE "TYPE" IN ('medium_airport', 'large_airport') AND ISO_COUNTRY = 'US'""",
    "wholea": _filled({
        "ELEVATION_FT": "coalesce(ELEVATION_FT, (SELECT avg(ELEVATION_FT) FROM kepta))",
        "MUNICIPALITY": "coalesce(MUNICIPALITY, 'Unknown')",
        "IATA_CODE": "coalesce(IATA_CODE, 'Unknown')"}, "kepta", _AIRPORT_COLUMNS),
    **_mad("wholea", ("ELEVATION_FT",), "a"),
    "cleana": _capped(1, "wholea", ("ELEVATION_FT",), _AIRPORT_COLUMNS, "mada"),
}
_CAPPED_FLIGHTS = ("DEP_DELAY", "ARR_DELAY", "AIR_TIME", "DISTANCE")
_CLEAN_FLIGHTS = {
    "keptf": "SELECT DISTINCT * FROM typedf WHERE CANCELLED = 0",
    "wholef": _filled({
        "FL_DATE": "coalesce(FL_DATE || ' 00:00:00', 'Unknown')",
        "TAIL_NUM": "coalesce(TAIL_NUM, 'Unknown')",
        "DEP_DELAY": "coalesce(DEP_DELAY, (SELECT avg(DEP_DELAY) FROM keptf))",
        "DISTANCE": "coalesce(DISTANCE, (SELECT avg(DISTANCE) FROM keptf))",
        "OCCUPANCY_RATE": "coalesce(OCCUPANCY_RATE::VARCHAR, 'Unknown')"}, "keptf", _FLIGHT_COLUMNS),
    **_mad("wholef", _CAPPED_FLIGHTS, "f"),
    "cleanf": _capped(3, "wholef", _CAPPED_FLIGHTS, _FLIGHT_COLUMNS, "madf"),
}
_TICKET_COLUMNS = (
    "ITIN_ID", '"YEAR"', '"QUARTER"', "ORIGIN", "ORIGIN_COUNTRY", "ORIGIN_STATE_ABR",
    "ORIGIN_STATE_NM", "ROUNDTRIP", "REPORTING_CARRIER", "PASSENGERS", "ITIN_FARE", "DESTINATION",
)
_CAPPED_TICKETS = ("PASSENGERS", "ITIN_FARE")
_CLEAN_TICKETS = {
    "keptt": """
SELECT DISTINCT * REPLACE (ROUNDTRIP::DOUBLE AS ROUNDTRIP,
  CASE WHEN PASSENGERS = 'Twenty' THEN 20 ELSE PASSENGERS::DOUBLE END AS PASSENGERS,
  TRY_CAST(nullif(ITIN_FARE, '1,200') AS DOUBLE) AS ITIN_FARE) FROM rawt WHERE ROUNDTRIP = '1.0'""",
    "wholet": _filled({
        "ORIGIN_STATE_NM": "coalesce(ORIGIN_STATE_NM, 'Unknown')",
        "ITIN_FARE": "coalesce(ITIN_FARE, (SELECT quantile_cont(ITIN_FARE, 0.5) FROM keptt))"},
        "keptt", _TICKET_COLUMNS),
    **_mad("wholet", _CAPPED_TICKETS, "t"),
    "cleant": _capped(3, "wholet", _CAPPED_TICKETS, _TICKET_COLUMNS, "madt"),
}
sql("p01_clean_airports", "rawa", "SELECT * FROM cleana", **_CLEAN_AIRPORTS)
sql("p02_clean_flights", "typedf", "SELECT * FROM cleanf", **_CLEAN_FLIGHTS)
sql("p03_clean_tickets", "rawt", "SELECT * FROM cleant", **_CLEAN_TICKETS)
sql("p04_route_kpis_from_raw", "typedf rawt airports", "SELECT * FROM kpi",
    **_CLEAN_FLIGHTS, **_CLEAN_TICKETS,
    flights="SELECT * REPLACE (TRY_CAST(OCCUPANCY_RATE AS DOUBLE) AS OCCUPANCY_RATE) FROM cleanf",
    tickets="SELECT * FROM cleant",
    **{n: BLOCKS[n] for n in ("dirs", "flown", "sold", "joined", "earned", "kpi")})
sql("p07_files_to_kpis", "typedf rawt", "SELECT * FROM kpi",
    rawa="""
SELECT CASE n_nationkey % 3 WHEN 0 THEN 'large_airport' WHEN 1 THEN 'medium_airport'
            ELSE 'small_airport' END AS "TYPE", 'Airport ' || n_name AS "NAME",
  CASE n_nationkey WHEN 3 THEN 'Nine Hundred' ELSE (n_nationkey * 137)::VARCHAR END AS ELEVATION_FT,
  'US' AS ISO_COUNTRY, 'City ' || chr(65 + n_nationkey) AS MUNICIPALITY,
  CASE WHEN n_nationkey <> 24 THEN chr(65 + n_nationkey) || 'AA' END AS IATA_CODE,
  '-' || (60 + 5 * n_nationkey) || '.5, ' || (20 + n_nationkey) || '.25' AS COORDINATES
FROM nation""", **_CLEAN_AIRPORTS, airports="SELECT * FROM cleana",
    **_CLEAN_FLIGHTS, **_CLEAN_TICKETS,
    flights="SELECT * REPLACE (TRY_CAST(OCCUPANCY_RATE AS DOUBLE) AS OCCUPANCY_RATE) FROM cleanf",
    tickets="SELECT * FROM cleant",
    **{n: BLOCKS[n] for n in ("dirs", "flown", "sold", "joined", "earned", "kpi")})
ORACLE["p08_incremental_flights"] = ORACLE["p02_clean_flights"]
sql("p04_route_kpis", "kpi", "SELECT * FROM kpi")
ORACLE["p09_incremental_kpis"] = ORACLE["p04_route_kpis"]
ORACLE["c07_audit_store"] = ORACLE["c07_conversion_error_report"]
ORACLE["p10_colocated_kpis"] = ORACLE["p04_route_kpis"]
sql("p05_route_kpis_extended", "ext", "SELECT * FROM ext")
_LISTS = {
    "busiest": (_R["r01_busiest"], "TOTAL_FLIGHTS"),
    "most_profitable": (_R["r02_most_profitable"], "PROFIT"),
    "recommended": (_R["r03_recommended"], "PROFIT_MILLION"),
    "most_demanded": (_R["r04_most_demanded"], "ESTIMATED_PASSENGERS"),
    "most_punctual": (_R["r05_most_punctual"], "AVG_TOTAL_DELAY"),
    "busiest_grouped": (_R["r06_busiest_grouped"], "TOTAL_FLIGHTS"),
    "best_revenue_to_cost": (_R["r07_best_revenue_to_cost"], "REV_TO_COST_RATIO"),
    "best_balanced": (_BEST_BALANCED, "PROFIT"),
    "breakeven": (_BREAKEVEN, "BREAKEVEN_FLIGHTS"),
}
sql("p06_answers", "ml", " UNION ALL ".join(
    f"SELECT '{name}' AS ANSWER, ROUTE_NAME_CITY, {metric}::DOUBLE AS \"VALUE\" FROM ({body})"
    for name, (body, metric) in _LISTS.items()), shares=_SHARES, balanced=_BALANCED)
