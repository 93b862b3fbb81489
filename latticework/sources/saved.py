"""Saved objects: a folder with a Parquet table for each frame and a one-row table of scalars, on any file system that Spark reaches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write(path: str, scalars: dict, spark: SparkSession, **frames: DataFrame) -> None:
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(scalars),)], "scalars string").coalesce(1).write.parquet(f"{path}/scalars")


def read(path: str, kind: str, spark: SparkSession | None, *names: str) -> tuple[dict, dict[str, DataFrame]]:
    spark = spark or SparkSession.builder.getOrCreate()
    scalars = json.loads(spark.read.parquet(f"{path}/scalars").first()["scalars"])
    if scalars["kind"] != kind:
        raise ValueError(f"{path} holds a {scalars['kind']}, not a {kind}")
    return scalars, {name: spark.read.parquet(f"{path}/{name}") for name in names}
