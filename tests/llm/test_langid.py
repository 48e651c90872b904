import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import langid as L
from orbweave.llm.common import held_out
from tests.llm.helpers import docs_frame, odd_rows

SAMPLES = L.CrossParser(("de", "en"), (L.fold("der hund und die katze gehen nach hause weil es regnet " * 3), L.fold("the dog and the cat are going home because it is raining " * 3)))


def brute_phrases(text, sample):
    """Greedy longest phrases of the whole text; a byte that the sample hasn't ends a phrase and begins the next."""
    total, phrase = 1, b""
    for i in range(len(text)):
        longer = phrase + text[i : i + 1]
        if longer in sample:
            phrase = longer
        else:
            total += 1
            phrase = text[i : i + 1] if text[i : i + 1] in sample else b""
    return total


def test_phrases_are_those_of_the_whole_text():
    rng = random.Random(3)
    words = "der hund die katze gehen nach hause the dog and cat are going home because it is raining xyz ñandú ölig wegen".split()
    texts = ["the cat is going home", "der regnet und katze", "xyz 123", "raining " * 100, "ñandú ölig", "a", "ñ", "", "aaaa" * 300, "the dog and the cat are going home because it is raining " * 40]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    texts += ["".join(rng.choice("abegh notñ") for _ in range(rng.randint(200, 2_000))) for _ in range(10)]
    folded = [L.fold(t) for t in texts]
    for block, lanes in ((256, 1 << 14), (7, 5), (1, 64), (3, 1 << 14)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(L, "BLOCK", block)
            patch.setattr(L, "LANES", lanes)
            classes, tables, _ = L._tables(SAMPLES)
            found = L._Lanes(folded, np.array([len(f) for f in folded]), classes)
            for sample, table in zip(SAMPLES.samples, tables):
                assert found.phrases(table).tolist() == [brute_phrases(f, sample) if f else 0 for f in folded]
    bits = SAMPLES.parse(texts)[2]
    for f, b in zip(folded, bits):
        assert not f or abs(b - min(brute_phrases(f, s) * math.log2(len(s)) / len(f) for s in SAMPLES.samples)) < 1e-9


def test_automaton_knows_all_substrings_and_no_others():
    data = b"abcbcabbca"
    goto = L.suffix_automaton(data)

    def known(s):
        state = 0
        for c in s:
            if c not in goto[state]:
                return False
            state = goto[state][c]
        return True

    assert all(known(data[i:j]) for i in range(len(data)) for j in range(i, len(data) + 1))
    assert not known(b"aa") and not known(b"abcbcc") and not known(b"z")


def test_letters_and_scores():
    lang, score, *_ = SAMPLES.parse(["the dog", "die katze", "", "12 !?", "...", "日本", "²"])
    assert lang[:6] == ["en", "de", "und", "und", "und", "de"] and lang[6] == "und"
    assert all(0 <= s <= 1 for s in score) and score[2] == 0 and 0.4 < score[5] < 0.6
    assert L.CrossParser((), ()).parse(["text"])[0] == ["und"]


def test_held_out_rows_teach_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learned = L.fit(docs)
    changed = docs.withColumn("text", F.when(held_out(F.col("doc_id")), F.lit("zzz qqq")).otherwise(F.col("text")))
    assert learned == L.fit(changed)
    assert {r["doc_id"] for r in docs.where(held_out(F.col("doc_id"))).collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    assert learned == L.fit(docs.repartition(7))
    assert all(1 <= len(s) <= 4 * L.ROWS * (L.MOST_CHARS + 1) for s in learned.samples)


def test_only_longer_texts_than_wanted(spark):
    rows = [(i, "wort " * 1_000 + str(i), "de") for i in range(5)] + [(9, "word " * 900 + "end", "en")] + [(20 + i, f"mot numero {i}", "fr") for i in range(90)]
    parser = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), everything=True)
    assert parser.languages == ("de", "en", "fr") and parser.samples[0].startswith(b"wort wort")
    assert parser.samples[2].count(b"mot") <= L.ROWS


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = L.predict(docs, L.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id")))
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_odd_rows(spark):
    df = docs_frame(spark)
    parser = L.fit(df)
    found = {r["doc_id"]: r for r in L.predict(df, SAMPLES).collect()}
    assert L.predict(df, parser).count() == len(odd_rows())
    assert [found[i]["lang_pred"] for i in (0, 1, 2, 3, 6)] == ["und"] * 5 and found[4]["lang_pred"] != "und"
    kept = L.keep_known(df, SAMPLES)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == df.columns and 5 in ids and 8 in ids and 0 not in ids and 6 not in ids
    assert L.fit(docs_frame(spark, [])) == L.CrossParser((), ())
    assert L.predict(docs_frame(spark, []), parser).count() == 0


def test_gibberish_goes_and_short_texts_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").limit(50).collect() + [(10_001, "привет мир как дела " * 20), (10_002, "Ja."), (10_003, "日本語のテキスト " * 30)]
    kept = {r["doc_id"] for r in L.keep_known(spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string"), L.fit(docs)).collect()}
    assert kept == {r[0] for r in rows[:-3]} | {10_002}
