"""User-written actions over objects, and their records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship

_registry: dict[str, Callable[[dict], str]] = {}


def action(name: str) -> Callable[[Callable[[dict], str]], Callable[[dict], str]]:
    """Registers a function of an object's row that returns a message."""

    def add(function: Callable[[dict], str]) -> Callable[[dict], str]:
        _registry[name] = function
        return function

    return add


def execute(objects: DataFrame, name: str) -> DataFrame:
    """uid, status and message of an action on each object; a missing action or an exception is an error."""
    function = _registry.get(name)
    if function is None:
        return objects.select("uid", F.lit("error").alias("status"), F.lit(f"no action {name}").alias("message"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows.append((row["uid"], "success", str(function(row))))
                except Exception as x:  # an action's failure is its result
                    rows.append((row["uid"], "error", str(x)))
            yield pd.DataFrame(rows, columns=["uid", "status", "message"])

    ship(objects.sparkSession)
    return objects.mapInPandas(run, "uid long, status string, message string")


def records(executed: DataFrame, name: str, at) -> DataFrame:
    """Records of what succeeded."""
    return executed.where("status = 'success'").select("uid", F.lit(name).alias("action"), at.alias("executed_dt"), "message")
