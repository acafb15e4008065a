"""A survey over the driver tables: orders as respondents, with a codebook. One SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .splits import spread

STAR = """
SELECT concat(n.cc, '_', CAST(o.o_orderkey AS STRING)) AS respondent_id, n.cc AS country, c.c_mktsegment AS SEG,
       CAST(n.n_regionkey AS STRING) AS REG,
       CASE WHEN c.c_acctbal < 0 THEN '99' WHEN c.c_acctbal < 2500 THEN '1' WHEN c.c_acctbal < 5000 THEN '2' WHEN c.c_acctbal < 7500 THEN '3' ELSE '4' END AS BAL,
       o.o_orderstatus AS STAT, substr(o.o_orderpriority, 1, 1) AS PRIO, concat(CAST(year(o.o_orderdate) AS STRING), '.0') AS YEAR,
       li.rf AS RFLAG, CASE WHEN li.nl IS NOT NULL THEN CAST(least(li.nl, 5) AS STRING) END AS NLINES,
       CAST(CAST(round(li.disc * 100) AS INT) AS STRING) AS DISC,
       CASE WHEN li.qty IS NULL THEN NULL WHEN li.qty <= 20 THEN '1' WHEN li.qty <= 40 THEN '2' ELSE '3' END AS QTY,
       CAST(n.n_nationkey * 3 + o.o_orderkey % 3 AS STRING) AS PARTY,
       CASE WHEN n.cc = 'AA' THEN CAST(1 + o.o_orderkey % 3 AS STRING) END AS brdaa,
       CASE WHEN n.cc = 'AB' THEN CAST(1 + o.o_orderkey % 4 AS STRING) END AS brdab,
       CASE WHEN n.cc = 'AC' THEN CAST(1 + o.o_orderkey % 2 AS STRING) END AS brdac1,
       CASE WHEN n.cc = 'AC' THEN CAST(1 + o.o_custkey % 2 AS STRING) END AS brdac2
FROM orders o
JOIN customer c ON c.c_custkey = o.o_custkey
JOIN (SELECT n_nationkey, n_regionkey, concat(chr(65 + CAST(floor(n_nationkey / 5) AS INT)), chr(65 + n_nationkey % 5)) AS cc FROM nation) n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT l_orderkey, max(l_returnflag) AS rf, count(*) AS nl, max(l_discount) AS disc, max(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
"""

# Section, code, question, labels by raw value.
CODEBOOK: list[tuple[str, str, str, dict[str, str]]] = [
    ("demographics", "SEG", "Which market segment are you in?", {"1": "MACHINERY", "2": "BUILDING", "3": "AUTOMOBILE", "4": "HOUSEHOLD", "5": "FURNITURE"}),
    ("demographics", "REG", "Which region do you live in?", {"0": "Africa", "1": "America", "2": "Asia", "3": "Europe", "4": "Middle East"}),
    ("demographics", "BAL", "How large is it?", {"1": "Low", "2": "Medium", "3": "High", "4": "Very high", "99": "Refused"}),
    ("orders", "STAT", "What is the state of your order?", {"F": "Final", "O": "Open", "P": "Not asked in this country"}),
    ("orders", "PRIO", "Do you agree that your order is urgent?", {"1": "Strongly agree", "2": "Agree", "3": "Neither agree nor disagree", "4": "Don't know", "5": "Disagree"}),
    ("orders", "YEAR", "In which year did you order?", {str(y): str(y) for y in range(1995, 2002)}),
    ("basket", "RFLAG", "Did you return anything?", {"A": "Yes", "N": "No", "R": "Other"}),
    ("basket", "NLINES", "How often did you add a line?", {"1": "Never", "2": "Rarely", "3": "Sometimes", "4": "Often", "5": "Always"}),
    ("basket", "DISC", "Do you support discounts?", {str(k): label for label, keys in (("Strongly oppose", (0, 1)), ("Somewhat oppose", (2, 3)), ("Neither oppose nor support", (4, 5, 6)), ("Somewhat support", (7, 8)), ("Strongly support", (9, 10))) for k in keys}),
    ("basket", "QTY", "How large is it?", {"1": "Small", "2": "Medium", "3": "Large"}),
    ("politics", "PARTY", "Which party did you choose?", {str(k): f"Choice {k}" for k in range(75)}),
    ("politics", "brdaa", "Which brand did you vote for?", {str(k): f"Brand {k}" for k in range(1, 5)}),
    ("politics", "brdab", "Which brand did you vote for?", {str(k): f"Brand {k}" for k in range(1, 5)}),
    ("politics", "brdac1", "Which brand did you vote for?", {str(k): f"Brand {k}" for k in range(1, 5)}),
    ("politics", "brdac2", "Which brand did you vote for?", {str(k): f"Brand {k}" for k in range(1, 5)}),
]
CODES = [code for _, code, _, _ in CODEBOOK]


def _quote(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def _rows() -> tuple[list[tuple], list[tuple]]:
    sections = list(dict.fromkeys(s for s, *_ in CODEBOOK))
    variables = [(s, sections.index(s), c, k, q) for k, (s, c, q, _) in enumerate(CODEBOOK)]
    values = [(c, raw, label, k) for _, c, _, labels in CODEBOOK for k, (raw, label) in enumerate(labels.items())]
    return variables, values


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per respondent, all answers as strings."""
    query = STAR
    for name in ("orders", "customer", "nation", "lineitem"):
        query = query.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("orders", "customer", "nation", "lineitem")}
    orders = tables["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return spark.sql(query, **tables | {"orders": spread(orders, "o_orderkey")})


def codebook(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(variables, values); a codebook has thousands of rows at most."""
    variables, values = _rows()
    return (
        spark.createDataFrame(variables, "section string, section_pos int, code string, var_pos int, question string"),
        spark.createDataFrame(values, "code string, raw string, label string, label_pos int"),
    )


def oracle_ctes() -> str:
    """``wide``, ``vars``, ``vals`` and ``long`` (answers in long form) as common table expressions."""
    variables, values = _rows()
    rows = lambda data: ", ".join(f"({', '.join(map(_quote, r))})" for r in data)
    long = " UNION ALL ".join(f"SELECT respondent_id, country, '{c}' AS code, {c} AS raw FROM wide" for c in CODES)
    return f"""WITH wide AS MATERIALIZED ({STAR}),
vars(section, section_pos, code, var_pos, question) AS (VALUES {rows(variables)}),
vals(code, raw, label, label_pos) AS (VALUES {rows(values)}),
long AS (SELECT * FROM ({long}) WHERE raw IS NOT NULL),
dec AS MATERIALIZED (SELECT l.*, coalesce(v1.label, v2.label, l.raw) AS label, coalesce(v1.label, v3.label, l.raw) AS blabel FROM long l
        LEFT JOIN vals v1 ON v1.code = l.code AND v1.raw = l.raw
        LEFT JOIN vals v2 ON v2.code = l.code AND v2.raw = CAST(CAST(trunc(TRY_CAST(l.raw AS DOUBLE)) AS BIGINT) AS VARCHAR)
        LEFT JOIN vals v3 ON v3.code = l.code AND regexp_full_match(l.raw, '[0-9]+') AND v3.raw = CAST(TRY_CAST(l.raw AS BIGINT) AS VARCHAR))"""
