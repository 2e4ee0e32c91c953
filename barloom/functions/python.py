"""Grouped Python functions, with this package's code where executors can import it."""

from __future__ import annotations

import io
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:  # it would take 25 MB in each Python worker of an operator on Arrow rows
    import pandas as pd


def ship(spark: SparkSession) -> None:
    """Let executors import this package: the driver serves its code to them, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_barloom_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="barloom")) / "barloom_code.zip"
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path.resolve()))
    sc._barloom_shipped = True


def by_group(df: DataFrame, key: str, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """function over all rows of each key at once; a key's rows are one series, bounded by its calendar."""
    ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(function, schema)
