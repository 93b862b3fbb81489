"""Python workers must find this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Names the folder that this package was imported from to Python workers that start from now on, unless they know it already.

    That serves local sessions and clusters with a shared folder; elsewhere the package is installed or shipped with ``--py-files``.
    """
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    environment = spark.sparkContext.environment
    own = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known and ROOT not in own:
        environment["PYTHONPATH"] = os.pathsep.join([*own, ROOT])
