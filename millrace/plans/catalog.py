"""All queries by name, each with its SQL where SQL can say the same."""

from __future__ import annotations

import io
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.plans import queries as own


def ship(spark: SparkSession, root: str) -> None:
    """Makes the package importable in Python workers that were not started with its path."""
    sc = spark.sparkContext
    env = (sc._jvm.System.getenv("PYTHONPATH") or "").split(os.pathsep)
    if root in env or getattr(sc, "_millrace_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "millrace")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, root))
    at = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace_src.zip")  # Spark serves it to the executors
    with open(at, "wb") as f:
        f.write(data.getvalue())
    before = list(sys.path)
    sc.addPyFile(at)
    sys.path[:] = before
    sc._millrace_shipped = True


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(own.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(own.SQL)
