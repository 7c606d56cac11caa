"""The library's functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quantmill.functions import text as T

_KERNEL = """CASE WHEN c = '=' AND v <> 0 AND a <> 0 THEN exp(-abs(v - a)) WHEN c = '>' AND v <> 0 AND v > a THEN {above} WHEN c = '<' AND a <> 0 AND v < a THEN {below}
  WHEN c = '<<' THEN exp(-abs(v - (a + b) / 2D)) ELSE 0D END"""

#: SQL functions that Catalyst inlines: no Python at run time.
SQL_FUNCTIONS = {
    "quantity_ratio(c STRING, v DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE": _KERNEL.format(above="a / v", below="v / a"),
    "quantity_expo(c STRING, v DOUBLE, a DOUBLE, b DOUBLE) RETURNS DOUBLE": _KERNEL.format(above="exp(-abs(v - a))", below="exp(-abs(v - a))"),
    "meets_condition(c STRING, v DOUBLE, a DOUBLE, b DOUBLE) RETURNS BOOLEAN": "coalesce(CASE c WHEN '=' THEN v = a WHEN '>' THEN v > a WHEN '<' THEN v < a WHEN '<<' THEN v > least(a, b) AND v < greatest(a, b) END, false)",
    "vector_dot(x ARRAY<DOUBLE>, y ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(x, y, (p, q) -> p * q), 0D, (s, z) -> s + z)",
    "simple_tokens(s STRING) RETURNS ARRAY<STRING>": r"filter(split(lower(coalesce(s, '')), '[^\\p{L}\\p{N}]+'), t -> t <> '')",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("porter_stems", T.stem_all)
    return [s.split("(")[0] for s in SQL_FUNCTIONS] + ["porter_stems"]
