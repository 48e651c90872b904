import itertools

import numpy as np
from pyspark.sql import functions as F

from orbweave.llm import crf as C
from orbweave.llm.common import held_out
from tests.llm.helpers import docs_frame, odd_rows


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6, 1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    energy, change = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, pairs, log_z = C.forward_backward(energy, change, first)
    total, want_pairs = 0.0, np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights, marked, changes = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(e for e, y in zip(energy[a:b], labels) if y) + sum(change[p, q] for p, q in zip(labels, labels[1:])))
            weights += w
            marked += w * np.array(labels)
            for p, q in zip(labels, labels[1:]):
                changes[p, q] += w
        assert np.allclose(good[a:b], marked / weights)
        want_pairs += changes / weights
        total += np.log(weights)
    assert np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def enumerated_means(energy, change, first, length):
    """Length-weighted means of the marginals, over all labellings."""
    out = []
    for a, b in zip(first, first[1:]):
        every = list(itertools.product((0, 1), repeat=b - a))
        w = np.array([np.exp(sum(e for e, y in zip(energy[a:b], labels) if y) + sum(change[p, q] for p, q in zip(labels, labels[1:]))) for labels in every])
        good = (w[:, None] * np.array(every)).sum(axis=0) / w.sum()
        out.append(sum(g * (n + 1) for g, n in zip(good, length[a:b])) / sum(n + 1 for n in length[a:b]))
    return np.array(out)


def test_latent_gradient_is_that_of_the_enumerated_likelihood():
    rng = np.random.default_rng(3)
    first, labels = np.cumsum([0, 1, 4, 3, 5]), np.array([1, 0, 1, 0])
    energy, change, length = rng.normal(size=first[-1]), rng.normal(size=(2, 2)), rng.integers(0, 40, first[-1]).astype(float)

    def likelihood(e, c):
        m = enumerated_means(e, c, first, length)
        return np.log(np.where(labels == 1, m, 1 - m)).sum()

    value, by_energy, by_change = C.latent_gradient(energy, change, first, length, labels)
    assert np.isclose(value, likelihood(energy, change))
    for i in range(len(energy)):
        step = np.eye(len(energy))[i] * 1e-5
        assert np.isclose(by_energy[i], (likelihood(energy + step, change) - likelihood(energy - step, change)) / 2e-5, atol=1e-5)
    for i, j in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[i, j] = 1e-5
        assert np.isclose(by_change[i, j], (likelihood(energy, change + step) - likelihood(energy, change - step)) / 2e-5, atol=1e-5)


def test_document_scores_equal_enumeration():
    rng = np.random.default_rng(4)
    field = C.LineField(rng.normal(size=C.OWN), rng.uniform(0.5, 2, C.OWN), rng.normal(size=3 * C.OWN + 1) / 3, rng.normal(size=(2, 2)), (1.3, -0.4))
    texts = [b"One line.", b"A first line here.\n\nTHIRD 3 ###\nfourth fourth fourth", b"", b"x\ny y\nz!"]
    own, length, first = C.line_features(texts)
    means = enumerated_means(C.with_neighbours((own - field.mean) / field.scale, first) @ field.weights, field.change, first, length)
    assert np.allclose(field.score(texts), 1 / (1 + (means / (1 - means)) ** -1.3 * np.exp(0.4)))


def test_lines_come_out_otherwise_than_their_documents_and_by_their_neighbours():
    good, bad = b"A quiet and ordinary line of plain words.", b"$$$ BUY NOW 99% !!! ### CHEAP"
    # bad documents are mostly bad lines, with some good ones among them
    texts = [b"\n".join([good] * 6)] * 30 + [b"\n".join([good, *[bad] * 5])] * 30
    own, length, first = C.line_features(texts)
    field = C.train(own, length, first, np.array([1] * 30 + [0] * 30))

    def marginals(text):
        o, _, f = C.line_features([text])
        return C.forward_backward(C.with_neighbours((o - field.mean) / field.scale, f) @ field.weights, field.change, f)[0]

    alone, among = marginals(b"\n".join([good] * 3)), marginals(b"\n".join([bad, good, bad]))
    assert alone[1] > 0.5 > among[0] and abs(alone[1] - among[1]) > 0.01
    assert field.score([texts[0]])[0] > 0.7 > field.score([texts[-1]])[0]


def test_features_of_lines():
    texts = [b"Hello there World.\nhello hello hello\n\nHello there World.", b"", b"ABC 123 |\t!"]
    own, length, first = C.line_features(texts)
    assert first.tolist() == [0, 4, 5, 6] and length.tolist() == [18, 17, 0, 18, 0, 11] and own.shape == (6, C.OWN)
    again, distinct, _, capital, _, before, stopped = own[:, -7:].T
    assert again[1] == 2 / 3 and distinct[1] == 1 / 3 and capital[0] == 2 / 3
    assert before.tolist() == [0, 0, 0, 1, 0, 0] and stopped.tolist() == [1, 0, 0, 1, 0, 0]
    assert np.isclose(own[5, 2 + 2], 3 / 11) and np.isclose(own[5, 2 + 3], 3 / 11)  # upper case, digits
    both = C.with_neighbours(own, first)
    assert not both[0, C.OWN : 2 * C.OWN].any() and np.allclose(both[1, C.OWN : 2 * C.OWN], own[0]) and not both[3, 2 * C.OWN : 3 * C.OWN].any()


def test_texts_are_scored_alone():
    rng = np.random.default_rng(2)
    own, length, first = C.line_features([b"A good line here.\nAnother one."] * 20 + [b"BAD!! BAD!!\n### $$$"] * 20)
    field = C.train(own, length, first, np.array([1] * 20 + [0] * 20), 40)
    texts = [b"", b"A good line.", b"x\ny\nz", b"BAD!! WORSE!!\n$$$ ###", b"\n\n"]
    together = field.score(texts)
    assert np.allclose(together, [field.score([t])[0] for t in texts]) and together[1] > 0.7 > together[3]
    assert np.all((together >= 0) & (together <= 1)) and rng is not None


def test_held_out_quality(spark, sf_dir):
    where = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    found = C.score(docs, C.fit(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    a = C.fit(docs, labels)
    b = C.fit(docs.repartition(5), labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert np.array_equal(a.weights, b.weights) and a.curve == b.curve


def test_odd_rows(spark):
    df = docs_frame(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(16)] + [(8, 1), (9, None), (None, 1)], "doc_id long, quality int")
    field = C.fit(df, labels)
    found = C.score(df, field).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    by = {}
    for r in found:
        if r["doc_id"] in (0, 1):
            by[r["doc_id"]] = r["score"]
    assert by[0] == by[1]
    # other columns of the labels may have any name, and one id very many rows
    clash = labels.selectExpr("*", "'x' AS text", "'y' AS id", "0 AS label", "1 AS h")
    again = C.fit(df.union(spark.range(3_000).selectExpr("3L", "concat('row ', id)", *["'z'" if f.dataType.simpleString() == "string" else "0L" for f in df.schema.fields[2:]])), clash)
    assert again is not None and C.fit(df, clash).curve == field.curve
    assert C.fit(df, labels.limit(0)) is None and {r["score"] for r in C.score(df, None).collect()} == {0.5}
    assert C.score(docs_frame(spark, []), field).count() == 0
