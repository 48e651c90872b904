import struct

import pytest

from orbweave import __main__ as cli
from orbweave.operators import neighbours, schedule
from orbweave.operators.schedule import Schedule
from orbweave.sources import generators, readers, writers


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy("id").collect()]


def test_points(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("x,y,z\n\n1,2\n1,2,x\n 1 , 2 , 3 \n4,5,6,7\n1.0f,2,3\nNaN,1,2\n1e2,-.5,+3.\ninf,1,1\n1e99,0,0\n")
    want = [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (2, 100.0, -0.5, 3.0)]
    assert rows(readers.points_csv(spark, str(path)), "id", "x", "y", "z") == want
    assert rows(readers.points_csv(spark, str(path), limit=1), "id", "x") == [(0, 1.0)]
    path.write_text("9,1,2,3\n8,4,5,6,7\n")
    assert rows(readers.road_csv(spark, str(path)), "id", "x", "y", "z") == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    path.write_text("X,Y,Z\n0.5,1,2\nbad,1,2\n")
    assert rows(readers.points_csv_with_header(spark, str(path)), "id", "x") == [(0, 0.5)]


def test_ordinals_follow_files_and_lines(spark, tmp_path):
    for name, first in (("b", 300), ("a", 0), ("c", 310)):
        (tmp_path / f"{name}.csv").write_text("".join(f"{i},0,0\n" for i in range(first, first + (300 if name == "a" else 10))))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        assert rows(readers.points_csv(spark, str(tmp_path)), "id", "x") == [(i, float(i)) for i in range(320)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bodies(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("0,0,0,0\na,1,2,3\n1,2,3\n1,2,3,-1\n")
    assert rows(readers.bodies_csv(spark, str(path)), "id", "x", "y", "z", "mass", "vx") == [(0, 0.0, 1.0, 2.0, 3.0, 0.0)]


def test_gravity_of_bodies_near_each_other(spark, tmp_path):
    """A FLOAT of a place around 100 is off by some 4e-6, which is much between bodies 1e-4 apart."""
    path = tmp_path / "b.csv"
    path.write_text("99.9931,4,7,2\n99.9932,4,7,3\n1e-40,0,0,1e-60\n1e400,-1e39,0,1\n")
    assert rows(readers.bodies_csv(spark, str(path), "double"), "id", "x", "y", "mass") == [(0, 99.9931, 4.0, 2.0), (1, 99.9932, 4.0, 3.0), (2, 1e-40, 0.0, 1e-60), (3, 0.0, -1e39, 1.0)]
    path.write_text("99.9931,4,7,2\n99.9932,4,7,3\n")
    d = 99.9932 - 99.9931
    want = 2 * 2 * 3 * d / (d * d * (d * d + 1e-6) ** 0.5)
    for theta in ("0", "0.5"):
        assert float(cli.main(["gravity", str(path), theta, "--g", "1"]).split()[4].rstrip(",")) == pytest.approx(want, rel=1e-5)


def test_polylines_and_binary(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text('ID,POLYLINE\n1,"[[1.0,2.0],[3.0,4.0]]"\n2,"[]"\n3,"oops"\n')
    assert rows(readers.polylines_csv(spark, str(path)), "id", "x", "y", "z") == [(0, 1.0, 2.0, 0.0), (1, 3.0, 4.0, 0.0)]
    (tmp_path / "k.bin").write_bytes(struct.pack("<12f", *range(12)) + b"xx")
    assert rows(readers.points_binary(spark, str(tmp_path / "k.bin")), "x", "y", "z", "id") == [(0.0, 1.0, 2.0, 0), (4.0, 5.0, 6.0, 1), (8.0, 9.0, 10.0, 2)]


def test_generators(spark):
    a = generators.uniform_points(spark, 500, -2, 3)
    assert a.count() == 500 and a.where("x < -2 or x > 3").count() == 0 and rows(a.repartition(3), "id", "x") == rows(generators.uniform_points(spark, 500, -2, 3), "id", "x")
    assert generators.uniform_bodies(spark, 100).where("mass < 0.5 or mass > 1.5").count() == 0


def test_sinks(spark, tmp_path):
    pairs = spark.createDataFrame([(0, 1, 7, 0.0), (0, 2, 3, 1.0), (2, 1, 2, 0.0)], "qid long, rank long, id long, d2 float")
    writers.write_neighbours(pairs, str(tmp_path / "d"), spark.createDataFrame([(0,), (1,), (2,)], "qid long"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["Q0:[7, 3]", "Q1:[]", "Q2:[2]"]
    assert sorted(map(tuple, readers.neighbour_dump(spark, str(tmp_path / "d")).collect())) == [(0, 1, 7), (0, 2, 3), (2, 1, 2)]
    assert tuple(writers.summary(pairs, 3, 2, "p", 1.5).first()) == ("p", 3, 2, 1.5, 3)
    writers.write_points(spark.createDataFrame([(1, 0.5, 1.0, 2.0)], "id long, x float, y float, z float"), str(tmp_path / "o"))
    assert rows(readers.points_csv(spark, str(tmp_path / "o")), "x", "y", "z", "id") == [(0.5, 1.0, 2.0, 0)]


def test_schedules(tmp_path):
    for s in (Schedule(), Schedule(heuristic="max", multiplier=2.5), Schedule(heuristic="fixed", fixed_radius=0.25), Schedule(percentile=0.5, morton=True)):
        s.save(str(tmp_path / "s.json"))
        assert Schedule.load(str(tmp_path / "s.json")) == s
    old = '{"radius_increment_mult": 2.0, "max_hits_per_query": 2000, "use_morton_lbv": true, "radius_heuristic": {"SampledPercentile": 0.2}, "memory_strategy": "PayloadRegisterHeap"}'
    assert Schedule.from_json(old) == Schedule(percentile=0.2, multiplier=2.0, morton=True)
    assert Schedule.from_json("{") == Schedule.from_json("[]") == Schedule.load("/nowhere") == Schedule()
    with pytest.raises(ValueError):
        Schedule(multiplier=1.0)


def test_searches(monkeypatch):
    # time is what the trial says it is
    clock = [0.0]
    monkeypatch.setattr(schedule.time, "perf_counter", lambda: clock[0])

    def trial(s, rows):
        clock[0] += abs(s.percentile - 0.05) + abs(s.multiplier - 2.0) + 0.01
        return s.percentile < 0.6

    best = schedule.grid_search(trial, 100)
    assert (best.percentile, best.multiplier) == (0.05, 2.0)
    assert len(schedule.candidates()) == 108
    best = schedule.funnel(trial)
    assert (best.percentile, best.multiplier) == (0.05, 2.0)
    best = schedule.hill_climb(trial, 100)
    assert best.multiplier == 2.0 and abs(best.percentile - 0.05) < 0.01
    # a share of right queries is good from the accuracy on
    assert schedule.grid_search(lambda s, n: 0.9991 if s.percentile == 0.15 else 0.998, 1).percentile == 0.15
    assert schedule.funnel(lambda s, n: False) == schedule.grid_search(lambda s, n: False, 1) == Schedule()
    assert len(schedule.sweep(trial, (0.1, 0.2), (2.0, 3.0), 10)) == 4


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "get_session", lambda: spark)
    writers.write_points(generators.uniform_points(spark, 200), str(tmp_path / "p"))
    line = cli.main(["knn", str(tmp_path / "p"), str(tmp_path / "p"), "3", "0.1", "2.0", "--dump", str(tmp_path / "out"), "--schedule", str(tmp_path / "s.json")])
    assert line.split(",")[1:3] == ["200", "3"] and line.endswith(",600")
    assert readers.neighbour_dump(spark, str(tmp_path / "out")).count() == 600
    (tmp_path / "b.csv").write_text("".join(f"{i},{i * i % 7},{i % 5},1\n" for i in range(40)))
    assert cli.main(["gravity", str(tmp_path / "b.csv"), "0.5"]).startswith("40 bodies")
    assert neighbours.knn is not None
