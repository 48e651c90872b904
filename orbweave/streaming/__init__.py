"""Streams of query points against a table of points at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from orbweave.operators.neighbours import radius_join


def radius_stream(queries: DataFrame, data: DataFrame, radius: float) -> DataFrame:
    """(qid, id, d2) of all pairs within the radius for each streamed query: the batch operator's equi-join on cells, stream with table."""
    return radius_join(data, queries, radius)
