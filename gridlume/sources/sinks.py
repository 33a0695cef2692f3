"""What leaves the engine: JSON pages and GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    """``json``: one object a row, nulls left out; ``rows.write.text`` ends each with a newline."""
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def write_json(rows: DataFrame, path: str, *columns: str) -> None:
    json_lines(rows, *columns).write.mode("overwrite").text(path)


def metadata(**values: str) -> list[Column]:
    """Constant source columns."""
    return [F.lit(v).alias(k) for k, v in values.items()]
