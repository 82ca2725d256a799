"""Tables of already collected responses, read into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ct_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(apex, body) -> names (apex, name) and the rows whose body is no JSON list."""
    parsed = df.withColumn("rows", F.from_json("body", "array<struct<name_value:string>>"))
    good = F.col("rows").isNotNull() & F.trim("body").startswith("[")
    names = parsed.where(good).select("apex", F.explode("rows").alias("r")).select("apex", F.explode(F.split("r.name_value", "\n")).alias("name"))
    return names.where("name is not null"), df.where(~F.coalesce(F.from_json("body", "array<struct<name_value:string>>").isNotNull() & F.trim("body").startswith("["), F.lit(False)))


def read_cdx_rows(df: DataFrame) -> DataFrame:
    """(host, body) -> (host, original, timestamp): arrays of arrays, the header and short rows skipped."""
    rows = df.select("host", F.posexplode(F.from_json("body", "array<array<string>>")).alias("n", "cells"))
    rows = rows.where((F.size("cells") >= 2) & F.get("cells", F.lit(0)).isNotNull() & (F.get("cells", F.lit(0)) != "original"))
    return rows.select("host", F.get("cells", F.lit(0)).alias("original"), F.get("cells", F.lit(1)).alias("timestamp"))


def read_json_documents(df: DataFrame) -> DataFrame:
    """(url, body) with doc as VARIANT; null where the body is no JSON object."""
    return df.withColumn("doc", F.when(F.trim("body").startswith("{"), F.try_parse_json("body")))
