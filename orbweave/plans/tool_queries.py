"""Queries over files that are written to the shared folder and read back, and of the tools around the operators.

Files keep the order of the rows: they are written in order of their id, so the ordinals of what is read are ranks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave import __main__ as cli
from orbweave.functions import vectors as V
from orbweave.functions.geometry import Ray
from orbweave.operators import nbody, neighbours, rays, sampling, schedule, validation
from orbweave.operators.index import PointIndex
from orbweave.operators.schedule import Schedule
from orbweave.plans import programs, registry
from orbweave.plans.cuts import Cuts
from orbweave.plans.registry import ALTERED, MATCHED, altered, query
from orbweave.plans.views import asked, duck, view
from orbweave.session import table
from orbweave.sources import generators, readers, writers


def _path(spark: SparkSession, name: str) -> str:
    return f"{Cuts(spark).root}/{name}"


def _lines(df: DataFrame, order: str, *columns) -> DataFrame:
    """Lines of the columns, comma-separated, in order."""
    return df.orderBy(order).select(F.concat_ws(",", *columns).alias("value"))


def _ordinal(source: str, where: str = "true", columns: str = "x, y, z") -> str:
    return f"SELECT CAST(row_number() OVER (ORDER BY id)-1 AS BIGINT) AS id, {columns} FROM {source} WHERE {where}"


_ORD = f"WITH {duck('points_ord')}"


# files


@query("csv_points", f"{_ORD} {_ordinal('points_ord')}")
def csv_points(spark, sf_dir):
    path = _path(spark, "points")
    writers.write_points(view(spark, sf_dir, "points_ord").orderBy("id"), path)
    return readers.points_csv(spark, path)


@query("csv_points_limit", f"{_ORD} SELECT * FROM ({_ordinal('points_ord')}) WHERE id < 500")
def csv_points_limit(spark, sf_dir):
    path = _path(spark, "points")
    writers.write_points(view(spark, sf_dir, "points_ord").orderBy("id"), path)
    return readers.points_csv(spark, path, limit=500)


@query("csv_points_messy", f"{_ORD} {_ordinal('points_ord', 'id % 10 NOT IN (0, 1, 2)')}")
def csv_points_messy(spark, sf_dir):
    """Fields with blanks around and further ones after; lines with words, with too few fields, and empty ones."""
    path, rest = _path(spark, "messy"), F.col("id") % 10
    value = F.when(rest == 0, F.lit("x,y,z")).when(rest == 1, F.lit("1.5,2")).when(rest == 2, F.lit("")).otherwise(F.concat_ws(" , ", "x", "y", "z", F.lit("more")))
    view(spark, sf_dir, "points_ord").orderBy("id").select(value.alias("value")).write.text(path)
    return readers.points_csv(spark, path)


@query("csv_points_header", f"{_ORD} {_ordinal('points_ord')}")
def csv_points_header(spark, sf_dir):
    path = _path(spark, "header")
    view(spark, sf_dir, "points_ord").orderBy("id").selectExpr("x AS lon", "y AS lat", "z AS height", "id AS other").write.csv(path, header=True)
    return readers.points_csv_with_header(spark, path)


@query("csv_road", f"{_ORD} {_ordinal('points_ord')}")
def csv_road(spark, sf_dir):
    path = _path(spark, "road")
    _lines(view(spark, sf_dir, "points_ord"), "id", "id", "x", "y", "z").write.text(path)
    return readers.road_csv(spark, path)


@query("csv_bodies", f"WITH {duck('bodies_cust')} {_ordinal('bodies_cust', 'id % 5 != 0', 'CAST(x AS FLOAT) AS x, CASE WHEN id % 7 = 0 THEN CAST(0 AS FLOAT) ELSE CAST(y AS FLOAT) END AS y, CAST(z AS FLOAT) AS z, CAST(mass AS FLOAT) AS mass, CAST(0 AS FLOAT) AS vx')}")
def csv_bodies(spark, sf_dir):
    """Bodies without mass, and fields that aren't numbers, among the lines."""
    path = _path(spark, "bodies")
    _lines(view(spark, sf_dir, "bodies_cust"), "id", "x", F.when(F.col("id") % 7 == 0, F.lit("far")).otherwise(F.col("y").cast("string")), "z", F.when(F.col("id") % 5 == 0, F.lit(0.0)).otherwise(F.col("mass"))).write.text(path)
    return readers.bodies_csv(spark, path).select("id", "x", "y", "z", "mass", "vx")


@query("csv_polylines", "SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY o_orderkey, i)-1 AS BIGINT) AS id, CAST(o_custkey + i AS FLOAT) AS x, CAST(i AS FLOAT) AS y, CAST(0 AS FLOAT) AS z FROM orders, (VALUES (0), (1), (2)) AS t(i) WHERE o_orderkey % 3 != 0) WHERE id < 2000")
def csv_polylines(spark, sf_dir):
    path = _path(spark, "lines")
    point = lambda i: F.concat(F.lit("["), (F.col("o_custkey") + i).cast("string"), F.lit(f", {i}]"))
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit("["), F.concat_ws(", ", *(point(i) for i in range(3))), F.lit("]")))
    table(spark, sf_dir, "orders").orderBy("o_orderkey").select(F.col("o_orderkey").alias("ID"), line.alias("POLYLINE")).write.csv(path, header=True, quoteAll=True)
    return readers.polylines_csv(spark, path, limit=2_000)


@query("binary_points", f"{_ORD} {_ordinal('points_ord')}")
def binary_points(spark, sf_dir):
    path = _path(spark, "points.bin")
    writers.write_points_binary(view(spark, sf_dir, "points_ord").orderBy("id"), path)
    return readers.points_binary(spark, path).select("id", "x", "y", "z")


@query("knn_dump_read", f"SELECT qid, rank, id FROM ({registry._knn_sql('points_ord', 5)})")
def knn_dump_read(spark, sf_dir):
    path, p = _path(spark, "neighbours"), view(spark, sf_dir, "points_ord")
    writers.write_neighbours(neighbours.knn(p, asked(p), 5), path, asked(p).select(F.col("id").alias("qid")))
    return readers.neighbour_dump(spark, path)


@query("uniform_points", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS places, true AS inside, true AS even FROM orders")
def uniform_points(spark, sf_dir):
    made = generators.uniform_points(spark, table(spark, sf_dir, "orders").count())
    n = made.agg(F.count("*").alias("n"), F.count_distinct("x", "y", "z").alias("places"), F.min((F.least("x", "y", "z") >= 0) & (F.greatest("x", "y", "z") <= 1)).alias("inside"), F.avg(F.col("x") + F.col("y") + F.col("z")).alias("mean"))
    return n.select("n", "places", "inside", F.col("mean").between(1.4, 1.6).alias("even"))


@query("uniform_bodies", "SELECT CAST(10000 AS BIGINT) AS n, true AS inside, true AS massive, true AS still")
def uniform_bodies(spark, sf_dir):
    made = generators.uniform_bodies(spark)
    inside = (F.least("x", "y", "z") >= -100) & (F.greatest("x", "y", "z") <= 100)
    return made.agg(F.count("*").alias("n"), F.min(inside).alias("inside"), F.min(F.col("mass").between(0.5, 1.5)).alias("massive"), F.min((F.col("vx") == 0) & (F.col("vy") == 0) & (F.col("vz") == 0)).alias("still"))


# schedules and the command line


def _settings(spark: SparkSession, *found: Schedule) -> DataFrame:
    return spark.createDataFrame([(i, s.heuristic, s.percentile, s.multiplier, s.cap, s.morton) for i, s in enumerate(found)], "i int, heuristic string, percentile double, multiplier double, cap int, morton boolean")


@query("schedule_file", "SELECT CAST(i AS INT) AS i, heuristic, CAST(percentile AS DOUBLE) AS percentile, CAST(multiplier AS DOUBLE) AS multiplier, CAST(cap AS INT) AS cap, morton FROM (VALUES (0, 'percentile', 0.2, 2.0, 500, true), (1, 'max', 0.1, 2.5, 2000, false), (2, 'percentile', 0.1, 3.0, 2000, false), (3, 'percentile', 0.1, 3.0, 2000, false)) AS t(i, heuristic, percentile, multiplier, cap, morton)")
def schedule_file(spark, sf_dir):
    """Two schedules written and read again, one file that is no schedule, and one that isn't there."""
    out = []
    for name, made in (("one", Schedule(percentile=0.2, multiplier=2.0, cap=500, morton=True)), ("two", Schedule(heuristic="max", multiplier=2.5))):
        made.write(spark, path := _path(spark, name))
        out.append(Schedule.read(spark, path))
    spark.createDataFrame([("{oops",)], "value string").write.text(path := _path(spark, "three"))
    return _settings(spark, *out, Schedule.read(spark, path), Schedule.read(spark, _path(spark, "four")))


def _cost(spark: SparkSession, sf_dir: str) -> schedule.Cost:
    """A made-up cost with one best place that depends on the tables; searches by time can't be told in SQL."""
    n = table(spark, sf_dir, "part").count()
    return lambda s: abs(s.percentile - (n % 700) / 1_000) + abs(s.multiplier - 2.4) + abs(s.cap - 1_500) / 10_000


_COST = "abs(percentile - (SELECT count(*) FROM part) % 700 / 1000e0) + abs(multiplier - 2.4e0) + abs(cap - 1500) / 10000e0"
_values = lambda xs: ", ".join(f"({x!r}e0)" for x in xs)


def _tuned(percentiles, multipliers, caps=(2_000,)) -> str:
    return f"WITH tried AS (SELECT p AS percentile, m AS multiplier, c AS cap FROM (VALUES {_values(percentiles)}) AS a(p), (VALUES {_values(multipliers)}) AS b(m), (VALUES {', '.join(f'({c})' for c in caps)}) AS d(c)), costs AS (SELECT *, {_COST} AS cost FROM tried)"


@query("tune_grid", f"{_tuned(*schedule.GRID)} SELECT CAST(percentile AS DOUBLE) AS percentile, CAST(multiplier AS DOUBLE) AS multiplier FROM costs WHERE percentile != 0.05 ORDER BY cost LIMIT 1")
def tune_grid(spark, sf_dir):
    """The candidates at 0.05 miss the wanted accuracy."""
    best = schedule.grid_search(lambda s, rows: 0.998 if s.percentile == 0.05 else 1.0, 100, cost=_cost(spark, sf_dir))
    return _settings(spark, best).select("percentile", "multiplier")


@query("tune_funnel", f"{_tuned(*schedule.FUNNEL)} SELECT CAST(percentile AS DOUBLE) AS percentile, CAST(multiplier AS DOUBLE) AS multiplier, CAST(cap AS INT) AS cap FROM costs ORDER BY cost LIMIT 1")
def tune_funnel(spark, sf_dir):
    return _settings(spark, schedule.funnel(lambda s, rows: True, cost=_cost(spark, sf_dir))).select("percentile", "multiplier", "cap")


@query("tune_sweep", f"{_tuned((0.1, 0.2, 0.5), (2.0, 3.0))} SELECT percentile, multiplier, round(cost, 9) AS cost FROM costs")
def tune_sweep(spark, sf_dir):
    tried = schedule.sweep(lambda s, rows: True, (0.1, 0.2, 0.5), (2.0, 3.0), 100, _cost(spark, sf_dir))
    return spark.createDataFrame([(t.schedule.percentile, t.schedule.multiplier, round(t.seconds, 9)) for t in tried], "percentile double, multiplier double, cost double")


@query("tune_climb", "SELECT true AS near_multiplier, true AS better")
def tune_climb(spark, sf_dir):
    cost = _cost(spark, sf_dir)
    best = schedule.hill_climb(lambda s, rows: True, 100, 20, cost)
    return spark.createDataFrame([(abs(best.multiplier - 2.4) < 0.1, cost(best) < cost(Schedule()))], "near_multiplier boolean, better boolean")


@query("adaptive_caps", "SELECT CAST(r AS INT) AS round, a AS active, CAST(least(CASE r WHEN 7 THEN 10000 WHEN 8 THEN 10000 ELSE 128 * 2 ** (r-1) END, greatest(128, floor(50000000 / a))) AS INT) AS cap FROM (SELECT unnest(range(1, 9)) AS r), (SELECT count(*) AS a FROM orders UNION ALL SELECT count(*) FROM part)")
def adaptive_caps(spark, sf_dir):
    counts = [table(spark, sf_dir, t).count() for t in ("orders", "part")]
    return spark.createDataFrame([(r, a, neighbours.adaptive_cap(r, a)) for r in range(1, 9) for a in counts], "round int, active long, cap int")


@query("cli_knn", "SELECT CAST(count(*) AS BIGINT) AS queries, CAST(5 AS BIGINT) AS k, CAST(5*count(*) AS BIGINT) AS neighbours FROM orders WHERE o_orderkey % 50 = 0")
def cli_knn(spark, sf_dir):
    p, data, queries = view(spark, sf_dir, "points_ord"), _path(spark, "data"), _path(spark, "queries")
    writers.write_points(p, data)
    writers.write_points(asked(p), queries)
    n, k, total = (int(x) for i, x in enumerate(cli.main(["knn", data, queries, "5", "0.1", "2.0"]).split(",")[-4:]) if i != 2)
    return spark.createDataFrame([(n, k, total)], "queries long, k long, neighbours long")


@query("cli_gravity", "SELECT CAST(count(*) AS BIGINT) AS bodies, true AS near FROM customer")
def cli_gravity(spark, sf_dir):
    path, bodies = _path(spark, "bodies"), view(spark, sf_dir, "bodies_cust")
    _lines(bodies, "id", "x", "y", "z", "mass").write.text(path)
    words = cli.main(["gravity", path, "0", "--g", "1"]).split()
    exact = nbody.total_force(nbody.exact(bodies, 1.0)).first()["total_force"]
    return spark.createDataFrame([(int(words[0]), abs(float(words[4].rstrip(",")) / exact - 1) < 1e-4)], "bodies long, near boolean")


# validation


def _found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = view(spark, sf_dir, "points_ord")
    truth = Cuts(spark).cut(neighbours.knn(p, asked(p), 5, method="blocks"))
    return altered(truth), truth


@query("validate_distances", f"WITH {ALTERED} SELECT qid, bool_and(abs(sqrt(CAST(f.d2 AS DOUBLE))-sqrt(CAST(t.d2 AS DOUBLE))) <= 1e-5+1e-5*sqrt(CAST(t.d2 AS DOUBLE))) AS ok FROM truth t JOIN found f USING (qid, rank) GROUP BY qid")
def validate_distances(spark, sf_dir):
    return validation.close_distances(*_found(spark, sf_dir))


@query("validate_count", f"WITH truth AS ({registry._knn_sql('points_ord', 5)}), n AS (SELECT count(*) AS rows, count(DISTINCT qid) AS queries FROM truth) SELECT rows = 5*queries AS whole, rows-1 = 5*queries AS one_less FROM n")
def validate_count(spark, sf_dir):
    found, truth = _found(spark, sf_dir)
    n = asked(view(spark, sf_dir, "points_ord")).count()
    return spark.createDataFrame([(validation.count_ok(found, n, 5), validation.count_ok(truth.where("qid > 50 or rank > 1"), n, 5))], "whole boolean, one_less boolean")


@query("validate_forces", f"{registry._FORCE} SELECT round(sum(sqrt((fx*fx+fy*fy)+fz*fz)), 4) AS truth, true AS near FROM f")
def validate_forces(spark, sf_dir):
    bodies = view(spark, sf_dir, "bodies_cust")
    found = validation.force_error(nbody.barnes_hut(bodies, 0.5, 1.0, 32), nbody.exact(bodies, 1.0))
    return found.select(F.round("truth", 4).alias("truth"), (F.col("error") < 0.02).alias("near"))


@query("validate_failures", f"WITH {MATCHED}, bad AS (SELECT qid FROM judged WHERE NOT ok ORDER BY qid LIMIT 3) SELECT qid, rank, f.id, f.d2, t.id AS true_id, t.d2 AS true_d2 FROM truth t JOIN found f USING (qid, rank) JOIN bad USING (qid)")
def validate_failures(spark, sf_dir):
    return validation.failures(*_found(spark, sf_dir))


# indexes, programs, samples, forces


@query("index_knn", registry._knn_sql("points_ord", 5))
def index_knn(spark, sf_dir):
    """An index over some of the points that is given all of them, asked, and closed."""
    p = view(spark, sf_dir, "points_ord")
    index = PointIndex(p.where("id % 2 = 0"))
    index.replace(p)
    found = Cuts(spark).cut(index.knn(asked(p), 5))
    index.close()
    return found


@query("query_rays", f"{_ORD} SELECT id AS ray_id, x AS ox, y AS oy, z AS oz, CAST(1 AS FLOAT) AS dx, CAST(0 AS FLOAT) AS dy, CAST(0 AS FLOAT) AS dz, CAST(0 AS FLOAT) AS tmin, CAST(2.5 AS FLOAT) AS tmax FROM points_ord")
def query_rays(spark, sf_dir):
    ray = Ray.query(V.vec("x", "y", "z"), 2.5)
    return view(spark, sf_dir, "points_ord").select(F.col("id").alias("ray_id"), *(c.alias(n) for c, n in zip((*ray.origin, *ray.direction, ray.tmin, ray.tmax), ("ox", "oy", "oz", "dx", "dy", "dz", "tmin", "tmax"))))


def _program(spark, sf_dir, steps, miss=()):
    return programs.Trace(rays.triangles(), steps, miss, "tri_id").run(view(spark, sf_dir, "rays"), view(spark, sf_dir, "triangles"))


@query("program_terminate", f"{registry._TRI}, run AS (SELECT *, coalesce(sum(CASE WHEN prim_id % 5 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY ray_id ORDER BY t, prim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hits) SELECT ray_id, prim_id FROM run WHERE before = 0")
def program_terminate(spark, sf_dir):
    return _program(spark, sf_dir, [programs.Terminate(F.col("prim_id") % 5 == 0)]).where("prim_id is not null").select("ray_id", "prim_id")


@query("program_if", f"{registry._TRI} SELECT ray_id, prim_id, CASE WHEN prim_id % 2 = 0 THEN 'even' WHEN prim_id % 3 = 0 THEN 'third' ELSE 'other' END AS kind FROM hits")
def program_if(spark, sf_dir):
    inner = programs.If(F.col("prim_id") % 3 == 0, [programs.Update("kind", F.lit("third"))], [programs.Update("kind", F.lit("other"))])
    steps = [programs.If(F.col("prim_id") % 2 == 0, [programs.Update("kind", F.lit("even"))], [inner])]
    return _program(spark, sf_dir, steps).where("prim_id is not null").select("ray_id", "prim_id", "kind")


@query("program_sql", f"{registry._TRI} SELECT ray_id, CAST(count(*) AS BIGINT) AS n, max(prim_id) AS last FROM hits GROUP BY ray_id HAVING count(*) > 2")
def program_sql(spark, sf_dir):
    steps = [programs.Sql("SELECT ray_id, count(*) AS n, max(prim_id) AS last FROM {rows} GROUP BY ray_id HAVING count(*) > 2")]
    return _program(spark, sf_dir, steps, [programs.Ignore(F.lit(True))]).select("ray_id", "n", "last")


@query("random_sample", "SELECT CAST(least(700, count(*)) AS BIGINT) AS n, CAST(least(700, count(*)) AS BIGINT) AS ids, CAST(least(700, count(*)) AS BIGINT) AS known FROM orders")
def random_sample(spark, sf_dir):
    p = view(spark, sf_dir, "points_ord")
    made = Cuts(spark).cut(sampling.random_sample(p, 700))
    known = made.join(p, p.columns, "left_semi").count()
    return made.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).withColumn("known", F.lit(known).cast("bigint"))


_PLAIN = f"WITH {duck('bodies_cust')}, pairs AS (SELECT a.id, a.mass*b.mass AS mm, b.x-a.x AS dx, b.y-a.y AS dy, b.z-a.z AS dz, ((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))+(b.z-a.z)*(b.z-a.z) AS d2 FROM bodies_cust a, bodies_cust b), sized AS (SELECT *, CASE WHEN sqrt(d2) > 1e-6 THEN mm/(d2*sqrt(d2)+1e-12) ELSE 0 END AS size FROM pairs)"


@query("nbody_plain", f"{_PLAIN} SELECT id, round(sum(size*dx), 6)+0e0 AS fx, round(sum(size*dy), 6)+0e0 AS fy, round(sum(size*dz), 6)+0e0 AS fz FROM sized GROUP BY id")
def nbody_plain(spark, sf_dir):
    return registry._rounded(nbody.exact(view(spark, sf_dir, "bodies_cust"), 1.0, "plain"))
