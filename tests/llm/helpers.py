"""Small tables with every odd case, and a union-find."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("id", T.StringType())])

PASSAGE = "The old lighthouse keeper walked down to the harbour every single morning before dawn. He counted the boats that had come home during the night and wrote their names into a large book. Nobody in the village knew why he did it or who had asked him to. After many years the book was full."
LONG = "word " * 30_000 + "end."


def odd_rows():
    """Nulls in any column, empty and very long texts, ties and repeated rows; further columns whose names clash with results."""
    texts = [None, "", "   ", "\n\n", "a", "A.", "!!! ??? 123", LONG, PASSAGE, PASSAGE, "Before it all. " + PASSAGE, "日本語のテキスト。", "héé \x00 ctrl", "a" * 5_000, "🙂🙂 emoji", "x y"]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or ""), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[8], (None, "no id at all", "en", None, None, None, None, None), (None, None, None, None, None, None, None, None)]


def docs_frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else rows, DOCS)


def frame(spark, texts, first=0):
    """Ids from ``first`` on."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, first)], "doc_id long, text string")


class Union:
    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
