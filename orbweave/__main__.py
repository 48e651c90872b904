"""Command line: ``knn data queries k [percentile] [multiplier] [--dump DIR] [--schedule FILE] [--tune]`` and ``gravity bodies theta``."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orbweave.operators import nbody, neighbours
from orbweave.operators.schedule import Schedule, hill_climb
from orbweave.session import get_session
from orbweave.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="orbweave")
    verbs = out.add_subparsers(dest="verb", required=True)
    knn = verbs.add_parser("knn", help="nearest neighbours of the points of one CSV file among those of another")
    knn.add_argument("data")
    knn.add_argument("queries")
    knn.add_argument("k", type=int)
    knn.add_argument("percentile", type=float, nargs="?")
    knn.add_argument("multiplier", type=float, nargs="?")
    knn.add_argument("--dump", help="folder for lines of neighbours")
    knn.add_argument("--schedule", help="file to read the schedule from, or with --tune to write it to")
    knn.add_argument("--tune", action="store_true")
    gravity = verbs.add_parser("gravity", help="forces among the bodies of a CSV file")
    gravity.add_argument("bodies")
    gravity.add_argument("theta", type=float)
    gravity.add_argument("--g", type=float, default=nbody.G)
    return out


def main(argv: list[str] | None = None) -> str:
    args = parser().parse_args(argv)
    spark = SparkSession.getActiveSession() or get_session()
    if args.verb == "gravity":
        began = time.perf_counter()
        row = nbody.total_force(nbody.barnes_hut(readers.bodies_csv(spark, args.bodies, "double"), args.theta, args.g)).first()
        line = f"{row['n_bodies']} bodies, total force {row['total_force']:.6g}, {time.perf_counter() - began:.3f} s"
        print(line)
        return line
    data, queries = readers.points_csv(spark, args.data).cache(), readers.points_csv(spark, args.queries).cache()
    schedule = Schedule.load(args.schedule) if args.schedule and not args.tune else Schedule()
    given = {k: v for k, v in (("percentile", args.percentile), ("multiplier", args.multiplier)) if v is not None}
    schedule = Schedule(**{**schedule.__dict__, **given})
    n = queries.count()
    if args.tune:
        want = min(args.k, data.count())

        def trial(candidate: Schedule, rows: int) -> bool:
            asked = queries.where(F.col("id") < rows)
            return neighbours.knn(data, asked, args.k, candidate, method="grid").count() == min(rows, n) * want

        schedule = hill_climb(trial, min(n, 5_000))
        if args.schedule:
            schedule.save(args.schedule)
    began = time.perf_counter()
    pairs = neighbours.knn(data, queries, args.k, schedule)
    if args.dump:
        writers.write_neighbours(pairs, args.dump, queries.select(F.col("id").alias("qid")))
    row = writers.summary(pairs, n, args.k, args.data, 0.0).first()
    line = f"{row['path']},{row['nq']},{row['k']},{1000 * (time.perf_counter() - began):.1f},{row['total_neighbours']}"
    print(line)
    return line


if __name__ == "__main__":
    main()
