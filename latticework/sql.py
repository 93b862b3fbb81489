"""Names that Spark SQL can call, registered in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.schema_regex import regex_from_str
from .workers import importable


def register(spark: SparkSession) -> None:
    """``schema_regex(json)``: a schema's pattern, null if it has none. Schemas are few and compiled once each."""
    importable(spark)

    @F.pandas_udf("string")
    def schema_regex(schemas: pd.Series) -> pd.Series:
        known: dict[str | None, str | None] = {None: None}
        for text in schemas.dropna().unique():
            try:
                known[text] = regex_from_str(text)
            except ValueError:
                known[text] = None
        return schemas.map(lambda s: known.get(s))

    spark.udf.register("schema_regex", schema_regex)
