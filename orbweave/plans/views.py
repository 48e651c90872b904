"""Point, body, ray and triangle tables as views over the driver's tables, in Spark's SQL and in DuckDB's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.session import table

_EMB = "SELECT vec_id AS id, CAST({e1} AS FLOAT) AS x, CAST({e2} AS FLOAT) AS y, CAST({e3} AS FLOAT) AS z FROM embeddings"
_SQL = {
    "points_ord": "SELECT o_orderkey AS id, CAST(o_totalprice/1000e0 AS FLOAT) AS x, CAST(o_custkey/10e0 AS FLOAT) AS y, CAST(o_orderkey % 97 AS FLOAT) AS z FROM orders",
    "points_tie": "SELECT p_partkey AS id, CAST(p_size AS FLOAT) AS x, CAST(p_partkey % 5 AS FLOAT) AS y, CAST(0 AS FLOAT) AS z FROM part",
    "points_planar": "SELECT event_id AS id, CAST(value AS FLOAT) AS x, CAST(user_id AS FLOAT) AS y, CAST(0 AS FLOAT) AS z FROM events",
    "bodies_cust": "SELECT c_custkey AS id, CAST(c_acctbal/100e0 AS DOUBLE) AS x, CAST(c_nationkey*4 AS DOUBLE) AS y, CAST(c_custkey % 97 AS DOUBLE) AS z, CAST(1 + c_custkey % 7 AS DOUBLE) AS mass FROM customer",
    "rays": "SELECT o_orderkey AS ray_id, CAST(o_totalprice/1000e0 AS FLOAT) AS ox, CAST(o_custkey/10e0 AS FLOAT) AS oy, CAST(-1 AS FLOAT) AS oz, CAST(((o_orderkey/50e0) % 7 - 3)/2e0 AS FLOAT) AS dx, CAST(((o_orderkey/50e0) % 5 - 2)/2e0 AS FLOAT) AS dy, CAST(1 AS FLOAT) AS dz, CAST(0 AS FLOAT) AS tmin, CAST(50 AS FLOAT) AS tmax FROM orders WHERE o_orderkey % 50 = 0",
    "triangles": "SELECT s_suppkey AS tri_id, CAST(s_nationkey*10 AS FLOAT) AS ax, CAST(s_suppkey % 50 AS FLOAT) AS ay, CAST(s_suppkey % 7 AS FLOAT) AS az, CAST(s_nationkey*10+60 AS FLOAT) AS bx, CAST(s_suppkey % 50 AS FLOAT) AS by_, CAST(s_suppkey % 7 AS FLOAT) AS bz, CAST(s_nationkey*10 AS FLOAT) AS cx, CAST(s_suppkey % 50 + 60 AS FLOAT) AS cy, CAST(s_suppkey % 7 + 1 AS FLOAT) AS cz FROM supplier",
}
SPARK = _SQL | {"points_emb": _EMB.format(**{f"e{i}": f"element_at(embedding, {i})" for i in (1, 2, 3)})}
DUCK = _SQL | {"points_emb": _EMB.format(**{f"e{i}": f"embedding[{i}]" for i in (1, 2, 3)})}
TABLE = {"points_emb": "embeddings", "points_ord": "orders", "points_tie": "part", "points_planar": "events", "bodies_cust": "customer", "rays": "orders", "triangles": "supplier"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(SPARK[name].replace(f"FROM {TABLE[name]}", "FROM {source}"), source=table(spark, sf_dir, TABLE[name]))


def asked(points: DataFrame, step: int = 50) -> DataFrame:
    """The stated queries: every row whose id is divisible by the step."""
    return points.where(F.col("id") % step == 0)


def duck(*names: str) -> str:
    """The views as the beginning of a WITH clause."""
    return ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
