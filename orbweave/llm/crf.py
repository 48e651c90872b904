"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are rates of byte classes, word shapes and repetition, of itself and
of its two neighbours; the chain adds weights for the change from one label to the next. Forward-backward gives
each line's probability to be good, and a document's quality is their mean weighted by the lines' lengths,
passed through a logistic curve fitted to the labels.

Only documents have labels; those of their lines are latent. Training first takes each line for what its document is, which is
convex, and from there maximises the likelihood of the documents' labels themselves, given by the length-weighted means
of the lines' marginals, so a line may come out otherwise than its document and the chain learns what follows what. The
gradient of a weighted sum of marginals is the derivative of the marginals in the direction of the weights (the
Hessian of the log-partition function is symmetric), so it takes two more runs of forward-backward and no more.

The field is fitted on a bounded sample: about ``TRAIN_DOCS`` labelled documents chosen by a hash of the id among those of
at most ``TRAIN_CHARS`` characters, with all their lines. Scoring reads all lines of all documents.

Nulls and empty texts are one empty line and scored as such. A document whose id is repeated among the labels
takes their least quality; null labels are ignored. Without labels of both kinds every score is 0.5. Repeated
rows give equal rows. Labels, languages, sources and ids are never inputs of a score. Other columns are
neither read nor returned; the id column may have any type.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import learnable, map_chunks, text_bytes

TRAIN_DOCS, TRAIN_CHARS = 3_000, 50_000
#: Steps with the documents' labels on every line, and with latent ones.
ROUNDS, LATENT_ROUNDS = 100, 100
THRESHOLD = 0.7
#: Classes of bytes: 0 newline, 1 white space, 2 lower case, 3 upper case, 4 digits, 5 past ASCII, then signs.
_SIGNS = [".", ",;:", "!?", "|", "#$%&*@^~", "'\"`-", "()[]{}<>", "/\\=+_"]
CLASSES = 6 + len(_SIGNS)


def _class_table() -> np.ndarray:
    table = np.full(256, 1, np.uint8)
    table[10] = 0
    table[ord("a") : ord("z") + 1] = 2
    table[ord("A") : ord("Z") + 1] = 3
    table[ord("0") : ord("9") + 1] = 4
    table[128:] = 5
    for k, signs in enumerate(_SIGNS):
        table[[ord(c) for c in signs]] = 6 + k
    return table


_CLASS = _class_table()
_MIX = np.random.default_rng(7).integers(1, 1 << 40, 256, dtype=np.int64)
#: Features of a line by itself: two sizes, a rate for each class but newlines, seven of words and repetition.
OWN = 2 + CLASSES - 1 + 7


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines x OWN) features, each line's length in bytes, and each text's first line, with the total at the end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    sizes = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    span = ends - starts + 1
    length = (span - 1).astype(np.float64)
    line = np.repeat(np.arange(n), span)
    kind = _CLASS[data]
    counts = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float64)
    space = kind <= 1
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    words = np.zeros(n)
    again, distinct, long_words, capital = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    if len(begin):
        owner = line[begin]
        words = np.bincount(owner, minlength=n).astype(np.float64)
        mixed = _MIX[data] * (~space)
        code = np.add.reduceat(mixed, begin)
        letters = np.add.reduceat((~space).astype(np.int64), begin)
        same = (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=n).astype(np.float64)
        order = np.lexsort((code, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (code[order][1:] != code[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        distinct = np.bincount(owner[order][fresh], minlength=n).astype(np.float64)
        long_words = np.bincount(owner[letters > 16], minlength=n).astype(np.float64)
        capital = np.bincount(owner[kind[begin] == 3], minlength=n).astype(np.float64)
    some, has = np.maximum(length, 1), np.maximum(words, 1)
    # a line that occurred before in its text
    text = np.repeat(np.arange(len(texts)), sizes)
    total = np.add.reduceat(_MIX[data] * (np.arange(len(data)) - np.repeat(starts, span) + 1), starts)
    order = np.lexsort((np.arange(n), total, text))
    before = np.zeros(n)
    before[order[1:]] = (total[order][1:] == total[order][:-1]) & (text[order][1:] == text[order][:-1]) & (length[order][1:] > 0)
    stopped = np.zeros(n)
    full = np.flatnonzero(length > 0)
    stopped[full] = kind[ends[full] - 1] == 6
    own = np.column_stack((np.log1p(length), np.log1p(words), counts[:, 1:] / some[:, None], again / has, distinct / has, long_words / has, capital / has, np.minimum(length / has, 40) / 10, before, stopped))
    return own, length, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and the line after (zeros at a text's ends), and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.column_stack((own, before, after, np.ones(n)))


def _walk(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling number of lines, and how many have a line at each place."""
    order = np.argsort(-sizes, kind="stable")
    return order, np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), side="left")


def forward_backward(energy: np.ndarray, change: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Each line's probability to be good; the expected numbers of the four changes; the log of the partition function.

    ``energy`` is the line's weight for good over bad, ``change[a, b]`` that of label b after label a. All texts
    are walked abreast, the longest first, so that those still running are a prefix.
    """
    sizes = np.diff(first)
    order, running = _walk(sizes)
    start = first[:-1][order]
    e, t = np.exp(np.clip(energy, -40, 40)), np.exp(np.clip(change, -15, 15))
    alpha, beta = np.empty((len(energy), 2)), np.empty((len(energy), 2))
    log_z = 0.0
    for k, m in enumerate(running):
        at = start[:m] + k
        if k:
            a = alpha[at - 1]
            bad, good = a[:, 0] * t[0, 0] + a[:, 1] * t[1, 0], a[:, 0] * t[0, 1] + a[:, 1] * t[1, 1]
        else:
            bad = good = np.ones(m)
        good = good * e[at]
        z = bad + good
        alpha[at, 0], alpha[at, 1] = bad / z, good / z
        log_z += np.log(z).sum()
    pairs = np.zeros((2, 2))
    for k in range(len(running) - 1, -1, -1):
        m, more = running[k], running[k + 1] if k + 1 < len(running) else 0
        at = start[:m] + k
        beta[at] = 0.5
        if more:
            here, after = at[:more], at[:more] + 1
            bad, good = beta[after, 0], beta[after, 1] * e[after]
            back = np.column_stack((t[0, 0] * bad + t[0, 1] * good, t[1, 0] * bad + t[1, 1] * good))
            joint = [alpha[here, 0] * t[0, 0] * bad, alpha[here, 0] * t[0, 1] * good, alpha[here, 1] * t[1, 0] * bad, alpha[here, 1] * t[1, 1] * good]
            z = sum(joint)
            pairs += np.array([(j / z).sum() for j in joint]).reshape(2, 2)
            beta[here] = back / back.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), pairs, log_z


@dataclass(frozen=True)
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    #: Slope and height of the logistic curve over the logit of a document's mean.
    curve: tuple[float, float]

    def document_means(self, own: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = forward_backward(with_neighbours((own - self.mean) / self.scale, first) @ self.weights, self.change, first)
        return _document_means(good, length + 1, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        means = np.clip(self.document_means(*line_features(texts)), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.curve[0] * np.log(means / (1 - means)) + self.curve[1])))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression with a little shrinkage, by Newton's method."""
    w, design = np.array([1.0, 0.0]), np.column_stack((x, np.ones(len(x))))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.1 * (w - [1.0, 0.0])
        w = w - np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(2), gradient)
    return float(max(w[0], 1e-3)), float(w[1])


def _document_means(good: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


def latent_gradient(energy: np.ndarray, change: np.ndarray, first: np.ndarray, length: np.ndarray, labels: np.ndarray, step: float = 1e-4) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of the documents' labels, and its derivatives by the lines' energies and the changes' weights."""
    weight = length + 1
    good, _, _ = forward_backward(energy, change, first)
    mean = np.clip(_document_means(good, weight, first), 1e-6, 1 - 1e-6)
    by_mean = np.where(labels == 1, 1 / mean, -1 / (1 - mean)) / np.add.reduceat(weight, first[:-1])
    along = np.repeat(by_mean, np.diff(first)) * weight
    size = step / max(1e-12, float(np.abs(along).max()))
    up, up_pairs, _ = forward_backward(energy + size * along, change, first)
    down, down_pairs, _ = forward_backward(energy - size * along, change, first)
    return float(np.log(np.where(labels == 1, mean, 1 - mean)).sum()), (up - down) / (2 * size), (up_pairs - down_pairs) / (2 * size)


def train(own: np.ndarray, length: np.ndarray, first: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, latent_rounds: int = LATENT_ROUNDS) -> LineField:
    """Maximum conditional likelihood with shrinkage, by Adam: of the lines' labels as their documents', then of the documents' alone."""
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-3
    x = with_neighbours((own - mean) / scale, first)
    y = np.repeat(labels.astype(np.float64), np.diff(first))
    same = np.diff(first) - 1
    seen = np.array([[same[labels == 0].sum(), 0], [0, same[labels == 1].sum()]], float)
    w, change = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(len(w) + 4)
    for step in range(1, rounds + latent_rounds + 1):
        if step <= rounds:
            good, pairs, _ = forward_backward(x @ w, change, first)
            by_energy, by_change, n = y - good, seen - pairs, len(x)
        else:
            _, by_energy, by_change = latent_gradient(x @ w, change, first, length, labels)
            n = len(labels)
        gradient = np.concatenate((x.T @ by_energy / n - 1e-4 * w, (by_change / n - 1e-4 * change).ravel()))
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, change = w + move[:-4], change + move[-4:].reshape(2, 2)
    field = LineField(mean, scale, w, change, (1.0, 0.0))
    means = np.clip(field.document_means(own, length, first), 1e-6, 1 - 1e-6)
    return LineField(mean, scale, w, change, _curve(np.log(means / (1 - means)), labels.astype(float)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS) -> LineField | None:
    """Learns from the labelled documents that aren't held out; None if they don't have both labels. Of rows of one id one text counts."""
    known = labels.where(F.col(label_col).isNotNull() & learnable(F.col(label_id)))
    known = known.groupBy(F.col(label_id).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    n = known.count()
    level = 1 << 20
    chosen = known.where(F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(level)) < (level if n <= train_docs else train_docs * level // n))
    # of about train_docs rows, whatever the input
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where(F.length("text") <= train_chars)
    rows = texts.join(F.broadcast(chosen), "id").select(F.xxhash64(F.col("id").cast("string")).alias("h"), "text", "label")
    rows = rows.groupBy("h").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, length, first = line_features(text_bytes(batch.column(1)))
        parts = list(zip(first[:-1].tolist(), first[1:].tolist()))
        features = [own[a:b].astype(np.float32).tobytes() for a, b in parts]
        lengths = [length[a:b].astype(np.float32).tobytes() for a, b in parts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(features, pa.binary()), pa.array(lengths, pa.binary()), batch.column(2)], ["h", "own", "length", "label"])

    got = sorted(map_chunks(rows, run, "h long, own binary, length binary, label int").collect(), key=lambda r: (r["h"], bytes(r["own"])))
    if len({r["label"] for r in got}) < 2:
        return None
    own = [np.frombuffer(r["own"], np.float32).reshape(-1, OWN) for r in got]
    first = np.concatenate(([0], np.cumsum([len(o) for o in own])))
    length = np.concatenate([np.frombuffer(r["length"], np.float32) for r in got]).astype(float)
    return train(np.concatenate(own).astype(float), length, first, np.array([r["label"] for r in got]))


def score(df: DataFrame, field: LineField | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, ``score`` and ``predicted`` (1 from ``threshold`` on) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(batch.column(1))
        scores = field.score(texts) if field is not None else np.full(len(texts), 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return map_chunks(df.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int", text_col)
