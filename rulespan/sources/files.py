"""Relations from and to CSV, Parquet and Arrow."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that mean null in a CSV cell.
NULLS = ("", "null", "NULL", "na", "NA", "\\N")


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', trim: bool = True, schema: str | None = None) -> DataFrame:
    """Without a schema a column is boolean, long, double or string, the first that fits all its cells: one aggregate over the file."""
    raw = spark.read.csv(path, header=header, sep=delimiter, quote=quote, ignoreLeadingWhiteSpace=trim, ignoreTrailingWhiteSpace=trim, schema=schema, inferSchema=False)
    if schema:
        return raw
    cells = {c: F.when(~F.col(f"`{c}`").isin(*NULLS), F.col(f"`{c}`")) for c in raw.columns}
    tests = {"boolean": lambda c: F.lower(c).isin("true", "false"), "bigint": lambda c: F.try_to_number(c, F.lit("S9999999999999999999")).isNotNull() & c.rlike(r"^[-+]?\d+$"), "double": lambda c: c.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")}
    checks = [F.coalesce(F.min(f(c).cast("int")), F.lit(1)).alias(f"{i}_{kind}") for i, c in enumerate(cells.values()) for kind, f in tests.items()]
    found = raw.agg(*checks).first()
    out = []
    for i, (name, c) in enumerate(cells.items()):
        kind = next((k for k in tests if found[f"{i}_{k}"] == 1), "string")
        out.append(c.cast(kind).alias(name))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", mode: str = "overwrite") -> None:
    """Vectors are written as JSON arrays."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode(mode).csv(path, header=header, sep=delimiter, nullValue="")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    df.write.mode(mode).partitionBy(*partition_by or []).parquet(path)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    return spark.createDataFrame(table)


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows on the driver."""
    return df.toArrow()
