"""Bring this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_TOP = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors of a session's context, once.

    Python workers import the functions they run by name, so the package must
    be found there whatever folder a session was started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_waymark_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="waymark-code-")) / "waymark_code.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(_TOP.rglob("*.py")):
            z.write(source, source.relative_to(_TOP.parent))
    sc.addPyFile(str(archive))
    sc._waymark_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query or stage, whose first argument is the session, that ships the package first."""

    @wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run
