"""Text quality by positive-unlabelled learning: a non-negative risk over all unlabelled texts, and an estimated class prior."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import discard, map_texts, read_table, stored

#: Most trusted positives, the first by a hash of the id. Unlabelled are all documents of the training folds.
POSITIVES = 12_000
#: Buckets of character trigrams, a power of two, and units of the fixed hidden layer.
TRIGRAMS, UNITS = 64, 96
FEATURES = (
    "log_chars", "log_words", "word_length", "symbols", "upper", "digits", "pipes", "marks", "non_ascii", "short_words", "long_words",
    "distinct_words", "repeated_neighbours", "line_length", "distinct_lines", "top_word", "ends", "spaces", "upper_words",
)
_lines = re.compile(r"[^\n]+").findall
_ends = re.compile(r"[.!?…。]+(?:\s|$)").findall


def describe(text: str) -> list[float]:
    """Shares and counts of a whole text, in the order of FEATURES; an empty text has zeros."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(np.minimum(codes, 128), minlength=129)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    _, which = np.unique(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)), return_inverse=True)
    often = np.bincount(which)
    lines = _lines(text)
    m = len(words)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128]
    upper = sum(map(str.isupper, words))
    symbols = counts[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 126]].sum()
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), symbols / n, counts[65:91].sum() / max(1, letters), counts[48:58].sum() / n, counts[124] / m,
        (counts[44] + counts[46] + counts[58] + counts[59]) / m, counts[128] / n, (lengths <= 3).mean(), (lengths > 12).mean(),
        len(often) / m, float((which[1:] == which[:-1]).sum()) / m, np.log1p(m / max(1, len(lines))), len(set(lines)) / max(1, len(lines)),
        often.max() / m, len(_ends(text)) / m, counts[[9, 10, 13, 32]].sum() / n, upper / m,
    ]


def trigrams(text: str) -> np.ndarray:
    """Square roots of the shares of hashed character trigrams; texts of fewer characters have zeros."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if len(codes) < 3:
        return np.zeros(TRIGRAMS)
    with np.errstate(over="ignore"):
        mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.sqrt(np.bincount(mixed >> np.uint32(33 - TRIGRAMS.bit_length()), minlength=TRIGRAMS) / len(mixed))


def vector(text: str) -> bytes:
    """All features of a whole text as 32-bit floats."""
    return np.r_[describe(text), trigrams(text)].astype("<f4").tobytes()


def matrix(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype="<f4").reshape(len(vectors), len(FEATURES) + TRIGRAMS).astype(float)


class Net:
    """A linear function of standardised features and a fixed hidden layer; the score grows with it and is 0.3 at the cut."""

    def __init__(self, positive: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = positive.mean(axis=0), positive.std(axis=0) + 1e-3
        self.inner = rng.normal(0, len(FEATURES) ** -0.5, (len(FEATURES), UNITS)), rng.normal(0, 1, UNITS)
        self.weights, self.cut = np.zeros(1 + len(FEATURES) + TRIGRAMS + UNITS), 0.0

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([np.ones((len(z), 1)), z, np.tanh(z[:, : len(FEATURES)] @ self.inner[0] + self.inner[1])])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-4 * (self.basis(x) @ self.weights - self.cut) - np.log(0.3 / 0.7), -30, 30)))


def risk(w: np.ndarray, positive: tuple, unlabelled: tuple, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Two parts of the risk of g = w f with the squared loss (1 - y g)^2 / 4, and their gradients.

    The part of the positives, prior * E_p[loss(+)], and that of the negatives, E_u[loss(-)] - prior * E_p[loss(-)]; both
    depend on the data through the mean m and second moments s of the basis f alone, of positives and of unlabelled.
    """
    (mp, sp), (mu, su) = positive, unlabelled
    loss = lambda sign, m, s: (1 - 2 * sign * (w @ m) + w @ s @ w) / 4
    slope = lambda sign, m, s: (s @ w - sign * m) / 2
    return prior * loss(1, mp, sp), loss(-1, mu, su) - prior * loss(-1, mp, sp), prior * slope(1, mp, sp), slope(-1, mu, su) - prior * slope(-1, mp, sp)


def fit_pu(positive: tuple, unlabelled: tuple, prior: float, steps: int = 1500, rate: float = 0.01, ridge: float = 1e-3) -> np.ndarray:
    """Minimises the positives' part + max(0, the negatives' part) of the risk.

    Where the estimate of the negatives' part falls below zero, the step goes the other way for that part,
    so that the function unlearns what it fitted too closely.
    """
    w = np.zeros(len(positive[0]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        _, negative, slope_p, slope_n = risk(w, positive, unlabelled, prior)
        slope = (slope_p + slope_n if negative >= 0 else -slope_n) + ridge * w
        first += 0.1 * (slope - first)
        second += 0.001 * (slope * slope - second)
        w = w - rate * (1 - step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the shares of both above a number of cuts.

    Among what a classifier ranks highest all are positive, so the ratio of the two shares there is the prior; below,
    negatives raise it. The cut with the least upper confidence bound of the ratio is taken.
    """
    slack = np.sqrt(np.log(4 / delta) / 2 / n_u) + np.sqrt(np.log(4 / delta) / 2 / n_p)
    at = ((above_u + 1.01 * slack) / above_p).argmin()
    return float(np.clip(above_u[at] / above_p[at], 0.01, 0.99))


def moments(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return f.mean(axis=0), f.T @ f / len(f)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, mod 5, is 0. A null id is kept out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sums(vectors: DataFrame, net: Net) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number, and mean and second moments of the basis, of all vectors: added up in each partition, then in 32, then here."""
    width = len(net.weights)

    def add(batches):
        import pyarrow as pa

        total, n = np.zeros((width, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                f = net.basis(matrix(batch.slice(at, 2000).column(0).to_pylist()))
                total += f.T @ f
                n += len(f)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    def again(batches):
        import pyarrow as pa

        total, n = np.zeros((width, width)), 0
        for batch in batches:
            for part, k in zip(batch.column(0), batch.column(1).to_pylist()):
                total += np.frombuffer(part.as_py()).reshape(width, width)
                n += k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    kind = "total binary, n long"
    rows = vectors.select("x").mapInArrow(add, kind).repartition(32).mapInArrow(again, kind).collect()
    n = sum(r["n"] for r in rows)
    total = sum(np.frombuffer(r["total"]).reshape(width, width) for r in sorted(rows, key=lambda r: bytes(r["total"]))) / n
    # The first of the basis is the constant.
    return n, (total[0], total)


def _share_above(vectors: DataFrame, net: Net, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Shares of the vectors at or above each of the ascending cuts; a count for each cut comes to the driver."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            counts = np.zeros(len(cuts) + 1, dtype=np.int64)
            for at in range(0, batch.num_rows, 2000):
                g = net.basis(matrix(batch.slice(at, 2000).column(0).to_pylist())) @ weights
                counts += np.bincount(np.searchsorted(cuts, g, side="right"), minlength=len(cuts) + 1)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["place", "n"])

    counts = np.zeros(len(cuts) + 1)
    for row in vectors.select("x").mapInArrow(place, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[row["place"]] = row["n"]
    return counts[::-1].cumsum()[::-1][1:] / counts.sum()


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Net | None:
    """Fits on at most POSITIVES trusted documents and on all documents of the training folds as unlabelled ones.

    Labels other than the trusted positives are never read. The risk needs the unlabelled documents' mean and
    second moments only, so each is read whole and none comes to the driver. The prior is estimated with a least-squares classifier
    of one half of the positives against the unlabelled, on the other half. The cut, where the score is 0.3, leaves the
    prior's share of the unlabelled above it, and 199 of 200 trusted documents. None if there are no positives.
    """
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).where(~held_out("doc_id") & (F.col("y") == 1))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(~held_out("doc_id"))
    # At most POSITIVES ids, so they can be broadcast whatever the size of the corpus.
    trusted = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), F.col("doc_id")).limit(POSITIVES)
    made = map_texts(texts, {"doc_id": "doc_id"}, "text", "x binary", lambda: lambda some: ([[vector(text) for text in some]], None))
    vectors = stored(made, "vectors")
    # Of an id with several texts one is taken.
    rows = vectors.join(F.broadcast(trusted), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    if not rows:
        discard(vectors)
        return None
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))
    positive = matrix([bytes(r["x"]) for r in rows])
    net = Net(positive)
    basis = net.basis(positive)
    n, unlabelled = _sums(vectors, net)

    one, other = (basis[::2], basis[1::2]) if len(basis) > 1 else (basis, basis)
    (mean, second), width = moments(one), basis.shape[1]
    ranking = np.linalg.solve((second + unlabelled[1]) / 2 + (0.01 + width / len(basis)) * np.eye(width), (mean - unlabelled[0]) / 2)
    ranked = np.sort(other @ ranking)
    cuts = np.unique(ranked[(np.linspace(0, 0.99, 200) * len(ranked)).astype(int)])
    above_p = 1 - np.searchsorted(ranked, cuts) / len(ranked)
    net.prior = estimate_prior(above_p, _share_above(vectors, net, ranking, cuts), len(other), n)

    net.weights = fit_pu(moments(basis), unlabelled, net.prior)
    grid = np.linspace(-4, 4, 1601)
    above = _share_above(vectors, net, net.weights, grid)
    by_prior = grid[np.flatnonzero(above >= net.prior).max(initial=0)]
    net.cut = float(min(by_prior, np.quantile(basis @ net.weights, 0.005)))
    discard(vectors)
    return net


def score(docs: DataFrame, net: Net | None, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores every whole text; a null text counts as empty. Without a model every score is 0.5.

    One row for each input row, repeated rows and null ids included; no shuffle. keep names columns of docs
    to carry along; held_out, score and predicted come behind them.
    """

    def make():
        def run(texts: list[str]):
            if net is None:
                return [[0.5] * len(texts)], None
            return [net.score(matrix([vector(text) for text in texts])).tolist()], None

        return run

    first = list(keep) if id_col in keep else [id_col, *keep]
    names = {c: f"kept_{k}" for k, c in enumerate(first)}
    read = docs.select(*[F.col(c).alias(new) for c, new in names.items()], F.col(text_col).alias("text"))
    scored = map_texts(read, {new: new for new in names.values()}, "text", "score double", make)
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return scored.select(*[F.col(new).alias(c) for c, new in names.items()], held_out(names[id_col]).alias("held_out"), "score", predicted)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels))
