"""A point table that is prepared once and asked many times."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame

from orbweave.operators import neighbours
from orbweave.operators.schedule import Schedule
from orbweave.plans.cuts import Cuts

_numbers = itertools.count(1)
#: Indexes by number, until they are closed.
_open: dict[int, PointIndex] = {}


class PointIndex:
    """Points written to the shared folder, so that no question reads or parses their source again.

    Cells depend on the radius and are worked out in each question from the columns, so a new radius rebuilds nothing.
    """

    def __init__(self, points: DataFrame, schedule: Schedule | None = None):
        self.number, self.schedule = next(_numbers), schedule or Schedule()
        self._cuts = Cuts(points.sparkSession)
        self.points = self._cuts.cut(neighbours._points(points))
        _open[self.number] = self

    def knn(self, queries: DataFrame, k: int, exclude_self: bool = False, method: str = "auto") -> DataFrame:
        return neighbours.knn(self.points, queries, k, self.schedule, exclude_self, method)

    def radius(self, queries: DataFrame, radius: float) -> DataFrame:
        return neighbours.radius_join(self.points, queries, radius)

    def capped(self, queries: DataFrame, radius: float, cap: int) -> DataFrame:
        return neighbours.radius_capped(self.points, queries, radius, cap)

    def replace(self, points: DataFrame) -> None:
        """Other points in place of these; results that were not read yet are lost."""
        old, self.points = self.points, self._cuts.cut(neighbours._points(points))
        self._cuts.drop(old)

    def close(self) -> None:
        _open.pop(self.number, None)
        self._cuts.drop(self.points)


def close_all() -> None:
    for index in list(_open.values()):
        index.close()
