"""The registry of source connectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from mdmill.functions import rules


def connector_registry(spark: SparkSession, configured: Iterable[str] = ()) -> DataFrame:
    """(system, connector_id, name, source_object, configured, status): a row a system; files always count as configured.

    A system that is not configured stands as DEMO_ADAPTER, else as CONNECTED.
    """
    own = {*configured, "CSV"}
    rows = [(s, i, rules.CONNECTOR_NAMES[s], t, s in own, "CONNECTED" if s in own else "DEMO_ADAPTER") for s, (i, t) in rules.CONNECTORS.items()]
    return spark.createDataFrame(rows, "system string, connector_id string, name string, source_object string, configured boolean, status string")
