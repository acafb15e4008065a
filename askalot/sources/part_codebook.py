"""A codebook over the driver tables: parts as questions, order lines as their answer options. One SQL text for Spark and DuckDB.

Two waves (survey w0, w1) with the faults that codebooks have: traces of the instrument, short or absent questions, a code used twice, stars, curly apostrophes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VARIABLES = """
SELECT concat('w', CAST(p_size % 2 AS STRING)) AS survey, p_type AS section,
       concat('P', CAST(p_partkey - CASE WHEN p_partkey % 97 = 96 THEN 2 ELSE 0 END AS STRING), CASE WHEN p_partkey % 5 = 0 THEN concat('_', CAST(p_size AS STRING)) ELSE '' END) AS code,
       p_partkey AS var_pos, p_brand AS brand,
       CASE p_partkey % 8 WHEN 0 THEN concat('SHOWCARD 3 How often do you buy a ', p_name, ' in [country]?') WHEN 1 THEN concat('Do you trust the makers of a ', p_name, '? GO TO Q12')
         WHEN 2 THEN p_name WHEN 3 THEN 'Q12' WHEN 4 THEN concat('Would you say that your ', p_name, ' is (ONE ANSWER ONLY) for Party A, or Party B?') WHEN 5 THEN NULL
         WHEN 6 THEN concat('Read out options] what’s the [year] of your ', p_name, '?') ELSE concat('How satisfied are you with your ', p_name, ', and what else matters?') END AS question,
       concat(p_brand, ': ', p_name) AS description,
       CASE p_partkey % 4 WHEN 0 THEN 'Media/Information sources ' WHEN 1 THEN 'politics' WHEN 2 THEN '' ELSE ' Civic Engagement' END AS category
FROM part
"""
LABELS = """
SELECT v.survey, v.code, CAST(CAST(l.l_quantity AS INT) % 11 AS STRING) AS raw, CAST(l.l_quantity AS INT) % 11 AS label_pos,
       min(CASE CAST(l.l_quantity AS INT) % 11 WHEN 0 THEN 'Not important' WHEN 1 THEN 'Strongly agree' WHEN 2 THEN 'Agree' WHEN 3 THEN 'Refusal*' WHEN 4 THEN 'Don’t know' WHEN 5 THEN '3' WHEN 6 THEN '4'
         WHEN 7 THEN '5' WHEN 8 THEN 'Not marked' WHEN 9 THEN ' No answer* ' ELSE concat('Choice ', l.l_returnflag) END) AS label
FROM lineitem l JOIN part_vars v ON v.var_pos = l.l_partkey
GROUP BY v.survey, v.code, CAST(l.l_quantity AS INT) % 11
"""


def codebook(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(variables, values) with ``survey`` in both."""
    variables = spark.sql(VARIABLES.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    values = spark.sql(LABELS.replace("FROM lineitem", "FROM {lineitem}").replace("JOIN part_vars", "JOIN {part_vars}"), lineitem=lines, part_vars=variables)
    return variables, values


def oracle_ctes() -> str:
    return f"WITH part_vars AS ({VARIABLES}), part_vals AS ({LABELS})"
