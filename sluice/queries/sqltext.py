"""Pieces of oracle SQL: text columns of the typed tables, shapes, sensitive classes."""

from __future__ import annotations

from sluice.functions import patterns

COLUMNS = {
    "region": "r_regionkey:n r_name:t",
    "nation": "n_nationkey:n n_name:t n_regionkey:n",
    "customer": "c_custkey:n c_name:t c_nationkey:n c_acctbal:f c_mktsegment:t",
    "supplier": "s_suppkey:n s_name:t s_nationkey:n s_acctbal:f",
    "part": "p_partkey:n p_name:t p_brand:t p_type:t p_size:n p_retailprice:f",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:t o_totalprice:f o_orderdate:ts o_orderpriority:t",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:f l_extendedprice:f l_discount:f "
    "l_tax:f l_returnflag:t l_linestatus:t l_shipdate:ts",
    "events": "event_id:n ts:ts user_id:n event_type:t value:f props:t",
    "documents": "doc_id:n text:t lang:t source:t n_chars:n",
    "labels": "doc_id:n quality:n toxic:n",
    "pages": "page_id:n url:t html:t",
    "benchmark": "item_id:n text:t",
    "conversations": "conv_id:n turn:n role:t text:t",
}
TEXT_OF = {
    "t": "{c}",
    "n": "CAST({c} AS STRING)",
    "f": "CAST(CAST({c} AS DECIMAL(38,2)) AS STRING)",
    "ts": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
}
DATE_RX = r"^\d{1,4}[-/]?\d{1,2}[-/]?\d{1,4}$"


def text_columns(table: str) -> dict[str, str]:
    pairs = [item.split(":") for item in COLUMNS[table].split()]
    return {name: TEXT_OF[kind].format(c=name) for name, kind in pairs}


def cells_sql(table: str, columns: dict[str, str] | None = None) -> str:
    columns = columns if columns is not None else text_columns(table)
    parts = [f"SELECT '{name}' AS col, {sql} AS v FROM {table}" for name, sql in columns.items()]
    return " UNION ALL ".join(parts)


def match(value: str, regex: str) -> str:
    return f"regexp_matches({value}, '{regex}')"


def blank(value: str) -> str:
    return f"COALESCE(NOT regexp_matches({value}, '\\S'), TRUE)"


def boolean(value: str) -> str:
    tokens = ", ".join(f"'{t}'" for t in patterns.BOOLEAN_TOKENS)
    return f"LOWER({value}) IN ({tokens})"


def shape(value: str) -> str:
    tests = [
        (patterns.ISO_DATETIME_RX, patterns.ISO_DATETIME), (patterns.YMD_DASH_RX, patterns.YMD_DASH),
        (patterns.YMD_SLASH_RX, patterns.YMD_SLASH), (patterns.SLASH_RX, patterns.SLASH_UNDECIDED),
        (patterns.YMD_COMPACT_RX, patterns.YMD_COMPACT), (patterns.DIGITS_RX, patterns.DIGITS),
        (patterns.DECIMAL_RX, patterns.DECIMAL),
    ]
    chain = " ".join(f"WHEN {match(value, rx)} THEN '{label}'" for rx, label in tests)
    return (
        f"CASE {chain} WHEN {boolean(value)} THEN '{patterns.BOOLEAN}' "
        f"WHEN {match(value, patterns.TEXT_RX)} THEN '{patterns.TEXT}' ELSE '{patterns.MIXED}' END"
    )


def sensitive(value: str) -> str:
    chain = " ".join(f"WHEN {match(value, rx)} THEN '{name}'" for name, rx in patterns.SENSITIVE_RX.items())
    return f"CASE {chain} END"


def mask(pattern_class: str) -> str:
    chain = " ".join(f"WHEN '{name}' THEN '{text}'" for name, text in patterns.MASKS.items())
    return f"CASE {pattern_class} {chain} ELSE '{patterns.GENERIC_MASK}' END"


def counts_sql(table: str, columns: dict[str, str] | None = None) -> str:
    """CTE chain ending in ``counts`` (col, value, cnt, blank, pattern, cls, chars)."""
    return f"""cells AS ({cells_sql(table, columns)}),
counts AS (SELECT col, v AS value, COUNT(*) AS cnt, ANY_VALUE({blank('v')}) AS blank,
  ANY_VALUE({shape('v')}) AS pattern, ANY_VALUE({sensitive('v')}) AS cls, ANY_VALUE(LENGTH(v)) AS chars
  FROM cells GROUP BY col, v)"""


SLASH = """slash AS (SELECT col, CASE
  WHEN MAX(a) > 12 AND MAX(b) <= 12 AND MIN(a) >= 1 AND MAX(a) <= 31 AND MIN(b) >= 1 THEN 'DD/MM/YYYY'
  WHEN MAX(b) > 12 AND MAX(a) <= 12 AND MIN(b) >= 1 AND MAX(b) <= 31 AND MIN(a) >= 1 THEN 'MM/DD/YYYY'
  WHEN MAX(a) <= 12 AND MAX(b) <= 12 AND MIN(a) >= 1 AND MIN(b) >= 1 THEN '??/??/YYYY' ELSE 'mixed' END AS slash_label
  FROM (SELECT col, CAST(SUBSTR(value, 1, 2) AS INT) AS a, CAST(SUBSTR(value, 4, 2) AS INT) AS b
        FROM counts WHERE NOT blank AND pattern = 'slash') GROUP BY col)"""

SHAPES = """shapes AS (SELECT c.col, CASE WHEN c.pattern = 'slash' THEN s.slash_label ELSE c.pattern END AS pattern,
  CAST(SUM(c.cnt) AS BIGINT) AS cells FROM counts c LEFT JOIN slash s ON s.col = c.col
  WHERE NOT c.blank GROUP BY 1, 2)"""

_DATES = "'YYYY-MM-DD','YYYY/MM/DD','DD/MM/YYYY','MM/DD/YYYY','??/??/YYYY','YYYYMMDD'"
VOTE = f"""filled AS (SELECT col, CAST(COALESCE(SUM(cnt) FILTER (WHERE NOT blank), 0) AS BIGINT) AS n,
  CAST(COALESCE(SUM(cnt) FILTER (WHERE blank), 0) AS BIGINT) AS empty, CAST(SUM(cnt) AS BIGINT) AS row_count,
  COUNT(*) FILTER (WHERE NOT blank) AS distinct_count,
  COALESCE(MAX(chars) FILTER (WHERE NOT blank), 0) AS max_length,
  CAST(COALESCE(SUM(cnt) FILTER (WHERE NOT blank AND cls IS NOT NULL), 0) AS BIGINT) AS sensitive_hits
  FROM counts GROUP BY col),
tally AS (SELECT f.col, f.n,
  COALESCE(SUM(cells) FILTER (WHERE pattern = 'ISO-DATETIME'), 0) AS dt,
  COALESCE(SUM(cells) FILTER (WHERE pattern IN ({_DATES})), 0) AS da,
  COALESCE(SUM(cells) FILTER (WHERE pattern = 'digits'), 0) AS di,
  COALESCE(SUM(cells) FILTER (WHERE pattern IN ('digits','decimal')), 0) AS de,
  COALESCE(SUM(cells) FILTER (WHERE pattern = 'boolean'), 0) AS bo
  FROM filled f LEFT JOIN shapes s ON s.col = f.col GROUP BY f.col, f.n),
vote AS (SELECT col, n, CASE WHEN n = 0 THEN 'empty' WHEN dt >= 0.98 * n THEN 'datetime' WHEN da >= 0.98 * n THEN 'date'
  WHEN di >= 0.98 * n THEN 'integer' WHEN de >= 0.98 * n THEN 'number' WHEN bo >= 0.98 * n THEN 'boolean' ELSE 'string' END AS inferred_type,
  CAST(CASE WHEN n = 0 THEN 0 WHEN dt >= 0.98 * n THEN dt WHEN da >= 0.98 * n THEN da WHEN di >= 0.98 * n THEN di
  WHEN de >= 0.98 * n THEN de WHEN bo >= 0.98 * n THEN bo ELSE n END AS BIGINT) AS type_match FROM tally)"""

EDGES = f"""parsed AS (SELECT c.col, c.value, c.cnt, c.pattern,
  CASE WHEN {match('c.value', patterns.DECIMAL_RX)} THEN TRY_CAST(c.value AS DOUBLE) END AS num,
  CASE WHEN {match('c.value', DATE_RX)} THEN COALESCE(try_strptime(c.value, '%Y-%m-%d'), try_strptime(c.value, '%Y/%m/%d'),
    CASE WHEN s.slash_label = 'DD/MM/YYYY' THEN try_strptime(c.value, '%d/%m/%Y') WHEN s.slash_label = 'MM/DD/YYYY' THEN try_strptime(c.value, '%m/%d/%Y') END,
    CASE WHEN c.pattern = 'YYYYMMDD' THEN try_strptime(c.value, '%Y%m%d') END) END AS d
  FROM counts c LEFT JOIN slash s ON s.col = c.col WHERE NOT c.blank),
edges AS (SELECT col,
  FIRST(value ORDER BY num, cnt DESC, value) FILTER (WHERE num IS NOT NULL) AS num_min,
  FIRST(value ORDER BY num DESC, cnt DESC, value) FILTER (WHERE num IS NOT NULL) AS num_max,
  strftime(MIN(d), '%Y-%m-%d') AS d_min, strftime(MAX(d), '%Y-%m-%d') AS d_max,
  MIN(value) FILTER (WHERE pattern = 'ISO-DATETIME') AS iso_min, MAX(value) FILTER (WHERE pattern = 'ISO-DATETIME') AS iso_max
  FROM parsed GROUP BY col)"""


def facts_sql(table: str, columns: dict[str, str] | None = None, before: str = "") -> str:
    """WITH clause from the table to shapes, vote, filled and edges."""
    head = f"{before}, " if before else ""
    return f"WITH {head}{counts_sql(table, columns)}, {SLASH}, {SHAPES}, {VOTE}, {EDGES}"


def edge(side: str) -> str:
    return (
        f"CASE WHEN v.inferred_type IN ('integer','number') THEN e.num_{side} WHEN v.inferred_type = 'date' THEN e.d_{side} "
        f"WHEN v.inferred_type = 'datetime' THEN e.iso_{side} END"
    )
