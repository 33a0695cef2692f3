"""The expressions as SQL functions of a session: ``CREATE TEMPORARY FUNCTION ... RETURN expression``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridlume.functions import scalars as S
from gridlume.functions import text as X

#: Name -> (result type, expression over one text ``x``). Expressions with lambdas have no SQL form and stay Python-only.
FUNCTIONS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "strip_accents": ("STRING", X.strip_accents),
    "fold_key": ("STRING", X.fold_key),
    "normalize_street": ("STRING", X.normalize_street),
    "department_code": ("STRING", X.department_code),
    "js_number": ("DOUBLE", S.js_number),
    "french_millis": ("BIGINT", S.french_millis),
    "duration_seconds": ("DOUBLE", lambda c: S.duration_seconds(c, 0.0)),
    "error_code": ("STRING", S.error_code),
    "error_status": ("INT", S.error_status),
    "french_time": ("STRING", S.french_time),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; they are inlined into each query's plan and optimised with it."""
    row = spark.sql("select cast(null as string) as x")
    for name, (kind, build) in FUNCTIONS.items():
        plan = row.select(build(F.col("x")))._jdf.queryExecution().analyzed()
        expression = plan.expressions().head().child()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {expression.sql()}")
    return list(FUNCTIONS)
