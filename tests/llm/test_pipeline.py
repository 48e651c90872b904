import duckdb
import pytest

import corpus_pipeline as P
from orbweave.llm import queries
from tests.llm.helpers import docs_frame, odd_rows
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_subdedup import brute as cut


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = P.language(spark, docs, sf_dir)
    rows = [(r["doc_id"], r["text"]) for r in out.orderBy("doc_id").collect()]
    assert len(rows) >= docs.count() - 1 and out.columns == docs.columns

    fps = [brute_fingerprint(t) for _, t in rows]
    groups, first = brute_components(list(set(fps))), {}
    for (i, _), f in zip(rows, fps):
        first.setdefault(groups.find(f), i)
    out.write.parquet(f"{tmp_path}/1")
    two = P.near_dedup(spark, spark.read.parquet(f"{tmp_path}/1"), sf_dir)
    two.write.parquet(f"{tmp_path}/2")
    two = spark.read.parquet(f"{tmp_path}/2")
    kept = set(first.values())
    rows = [r for r in rows if r[0] in kept]
    assert sorted(r["doc_id"] for r in two.collect()) == [i for i, _ in rows] and two.columns == docs.columns

    rows = [(i, t) for i, t in cut(rows) if t.strip()]
    three = P.substring_dedup(spark, two, sf_dir)
    three.write.parquet(f"{tmp_path}/3")
    three = spark.read.parquet(f"{tmp_path}/3")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in three.collect()) == [(i, t, len(t)) for i, t in rows] and three.columns == docs.columns

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [w[0] for w in contaminated(rows[:60], items) if not w[-1]]
    four = P.decontaminated(spark, three.where(three.doc_id.isin([i for i, _ in rows[:60]])), sf_dir)
    assert sorted(r["doc_id"] for r in four.collect()) == clean and four.columns == docs.columns

    whole = P.run(spark, sf_dir)
    left = P.decontaminated(spark, three, sf_dir)
    assert {r["doc_id"] for r in whole.collect()} == {r["doc_id"] for r in left.collect()}


def test_odd_rows_go_through(spark, sf_dir):
    docs = docs_frame(spark)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() <= len(odd_rows()), name
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    docs = docs_frame(spark, [])
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
