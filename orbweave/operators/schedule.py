"""Settings of the radius search, and searches for good ones."""

from __future__ import annotations

import itertools
import json
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Schedule:
    """``heuristic``: percentile, max or fixed. ``cap`` is what ``neighbours.saturation`` counts up to; ``morton``, ``memory``, ``build`` and ``geometry`` are kept for files."""

    heuristic: str = "percentile"
    percentile: float = 0.10
    fixed_radius: float = 1.0
    multiplier: float = 3.0
    max_rounds: int = 30
    cap: int = 2_000
    morton: bool = False
    memory: str = "PayloadRegisterHeap"
    build: str = "PreferFastTrace"
    geometry: str = "Spheres"

    def __post_init__(self):
        if self.heuristic not in ("percentile", "max", "fixed") or not self.multiplier > 1:
            raise ValueError(f"no such schedule: {self}")

    def to_json(self) -> str:
        radius = {"percentile": {"SampledPercentile": self.percentile}, "max": "SampledMax", "fixed": {"Fixed": self.fixed_radius}}[self.heuristic]
        return json.dumps({"radius_increment_mult": self.multiplier, "max_hits_per_query": self.cap, "use_morton_lbv": self.morton, "radius_heuristic": radius, "memory_strategy": self.memory, "build_strategy": self.build, "geom_type": self.geometry}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Schedule:
        """Missing fields have their defaults; text that isn't a schedule gives the defaults."""
        try:
            d = json.loads(text)
            out = cls(multiplier=float(d.get("radius_increment_mult", 3.0)), cap=int(d.get("max_hits_per_query", 2_000)), morton=bool(d.get("use_morton_lbv", False)), memory=d.get("memory_strategy", "PayloadRegisterHeap"), build=d.get("build_strategy", "PreferFastTrace"), geometry=d.get("geom_type", "Spheres"))
            radius = d.get("radius_heuristic")
            if radius == "SampledMax":
                return replace(out, heuristic="max")
            if isinstance(radius, dict) and "Fixed" in radius:
                return replace(out, heuristic="fixed", fixed_radius=float(radius["Fixed"]))
            if isinstance(radius, dict) and "SampledPercentile" in radius:
                return replace(out, percentile=float(radius["SampledPercentile"]))
            return out
        except (ValueError, TypeError, AttributeError):
            return cls()

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as file:
            file.write(self.to_json())

    @classmethod
    def load(cls, path: str) -> Schedule:
        try:
            with open(path, encoding="utf-8") as file:
                return cls.from_json(file.read())
        except OSError:
            return cls()

    def write(self, spark: SparkSession, path: str) -> None:
        """Like ``save``, to a path that Spark can write."""
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Schedule:
        """Like ``load``, from a path that Spark can read; the defaults if there is nothing."""
        try:
            return cls.from_json("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
        except AnalysisException:
            return cls()


#: What a run costs; without one it is the time that it takes.
Cost = Callable[[Schedule], float]
#: Runs a schedule over a number of rows; says whether the result is good, or for what share of the queries it is right.
Trial = Callable[[Schedule, int], bool | float]
#: Share of right queries from which a result is good.
ACCURACY = 0.999


@dataclass(frozen=True)
class Timed:
    schedule: Schedule
    seconds: float
    good: bool


def timed(trial: Trial, schedule: Schedule, rows: int, cost: Cost | None = None) -> Timed:
    began = time.perf_counter()
    good = float(trial(schedule, rows)) >= ACCURACY
    return Timed(schedule, time.perf_counter() - began if cost is None else cost(schedule), good)


def hill_climb(trial: Trial, rows: int, rounds: int = 8, cost: Cost | None = None) -> Schedule:
    """From the defaults, tries both settings half as large and half as large again, takes the fastest good one, and halves the step where none is faster."""
    best, step = timed(trial, Schedule(), rows, cost), 0.5
    for _ in range(rounds):
        now = best.schedule
        near = [replace(now, percentile=min(0.99, now.percentile * f)) for f in (1 - step, 1 + step)]
        near += [replace(now, multiplier=1 + (now.multiplier - 1) * f) for f in (1 - step, 1 + step)]
        tried = [timed(trial, s, rows, cost) for s in near]
        found = [t for t in tried if t.good and (t.seconds < best.seconds or not best.good)]
        if found:
            best = min(found, key=lambda t: t.seconds)
        else:
            step /= 2
    return best.schedule


#: The candidates' percentiles, multipliers and caps; the stages' rows and survivors.
FUNNEL = ((0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.20, 0.50, 0.99), (2.0, 3.0, 4.0), (500, 2_000, 5_000, 10_000))
STAGES = ((5_000, 20), (25_000, 5), (100_000, 1))
#: Percentiles and multipliers of the grid.
GRID = ((0.02, 0.05, 0.10, 0.15, 0.20, 0.50, 0.99), (1.5, 2.0, 2.5, 3.0, 3.5))


def candidates() -> list[Schedule]:
    return [Schedule(percentile=p, multiplier=m, cap=c) for p, m, c in itertools.product(*FUNNEL)]


def funnel(trial: Trial, pool: Iterable[Schedule] | None = None, stages: tuple[tuple[int, int], ...] = STAGES, cost: Cost | None = None) -> Schedule:
    """Each stage runs what is left on more rows and keeps the fastest good ones; the defaults if none is good."""
    left = list(pool) if pool is not None else candidates()
    for rows, keep in stages:
        good = [t for t in (timed(trial, s, rows, cost) for s in left) if t.good]
        left = [t.schedule for t in sorted(good, key=lambda t: t.seconds)[:keep]]
    return left[0] if left else Schedule()


def sweep(trial: Trial, percentiles: Iterable[float], multipliers: Iterable[float], rows: int, cost: Cost | None = None) -> list[Timed]:
    """All combinations, timed."""
    return [timed(trial, Schedule(percentile=p, multiplier=m), rows, cost) for p, m in itertools.product(percentiles, multipliers)]


def grid_search(trial: Trial, rows: int, percentiles: Iterable[float] = GRID[0], multipliers: Iterable[float] = GRID[1], cost: Cost | None = None) -> Schedule:
    """The fastest good combination; the defaults if none is good."""
    good = [t for t in sweep(trial, percentiles, multipliers, rows, cost) if t.good]
    return min(good, key=lambda t: t.seconds).schedule if good else Schedule()

