"""Document quality by a factorisation machine.

Features are the hashed words of a document and their shapes, statistics of its structure, and its recorded length.
Each has a weight and a short vector; the score adds the weights and, for each pair of features, the product of their
vectors. All pairs cost one pass: half of (the square of the sum of the vectors less the sum of their squares), so the
time is linear in the features of a document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.corpus import spread
from .common import encoded, fitted, fresh, held_out, map_arrow, table
from .learn import Adam, sample_rows, sigmoid, texts_and_labels

WORD_BITS, SHAPE_BITS, BINS, RANK = 14, 10, 8, 6
N_WORD, N_SHAPE = 1 << WORD_BITS, 1 << SHAPE_BITS
STATS = ("letters", "digits", "upper", "blank", "signs", "high", "words", "word_size", "distinct", "top", "again", "decorated", "line_words", "same_lines", "ended", "marks", "recorded")
N = N_WORD + N_SHAPE + len(STATS) * BINS
THRESHOLD = 0.3
REMEMBERED = 400_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_UPPER, _DIGIT, _BLANK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_UPPER[65:91] = _DIGIT[48:58] = _BLANK[9:14] = _BLANK[32] = True
_HIGH = np.arange(256) >= 128
_SHAPE = bytes(65 if 65 <= c < 91 else 97 if 97 <= c < 123 or c >= 128 else 48 if 48 <= c < 58 else c for c in range(256))


def _shape(word: bytes) -> bytes:
    """Letters and digits as one sign each run: what remains is how a word is put together."""
    out, last = bytearray(), 0
    for c in word[:40].translate(_SHAPE):
        if c != last:
            out.append(c)
        last = c
    return bytes(out[:8])


class Vocabulary:
    """Places of the words met so far: (word, shape, whether it carries signs behind)."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, 3), dtype=np.int64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = set(words).difference(known)
        if new:
            n = len(known)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for k, w in enumerate(new, n):
                shape = _shape(w)
                self.table[k] = zlib.crc32(w.lower()) % N_WORD, N_WORD + zlib.crc32(shape) % N_SHAPE, len(shape.strip(b"Aa0.,")) > 0
                known[w] = k
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))


def _stats(text: bytes, words: list[bytes], place: np.ndarray, decorated: np.ndarray, recorded: float) -> list[float]:
    h = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, k = max(1, len(text)), max(1, len(words))
    size = [h[m].sum() / n for m in (_LETTER, _DIGIT, _UPPER, _BLANK)]
    high = h[_HIGH].sum() / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = np.bincount(np.unique(place, return_inverse=True)[1]) if len(place) else np.zeros(1)
    return [
        *size,
        1 - size[0] - size[1] - size[3] - high,
        high,
        np.log1p(len(words)),
        (n - h[_BLANK].sum()) / k,
        np.count_nonzero(counts) / k,
        counts.max() / k,
        np.count_nonzero(place[1:] == place[:-1]) / k,
        decorated.sum() / k,
        np.log1p(k / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / max(1, len(lines)),
        (h[33] + h[124] + h[35] + h[36] + h[37] + h[38] + h[42]) / k,
        recorded,
    ]


class Rows:
    """A batch as sparse rows: feature, value, bounds of the documents; and the statistics before they are binned."""

    def __init__(self, texts: list[bytes], recorded: list[float | None], vocabulary: Vocabulary):
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        places = vocabulary.rows([w for s in split for w in s])
        three = vocabulary.table[places]
        doc = np.repeat(np.arange(len(texts)), n)
        keys, counts = np.unique(np.r_[doc * N + three[:, 0], doc * N + three[:, 1]], return_counts=True)
        self.row, self.feature = keys // N, keys % N
        # words of a document have the length 1 together, and so have its shapes
        kind = (self.feature >= N_WORD).astype(np.int64)
        norm = np.sqrt(np.bincount(self.row * 2 + kind, counts.astype(float) ** 2, 2 * len(texts)))
        self.value = counts / norm[self.row * 2 + kind]
        cut = np.cumsum(n)[:-1]
        parts = zip(texts, split, np.split(places, cut), np.split(three[:, 2], cut), recorded, strict=True)
        self.stats = np.array([_stats(t, s, p, d, np.log1p(len(t.decode(errors="replace")) if r is None else max(r, 0))) for t, s, p, d, r in parts]).reshape(len(texts), len(STATS))

    @classmethod
    def of(cls, texts: list[bytes], vocabulary: Vocabulary, at_once: int = 200) -> Rows:
        """Many texts, some at a time, so that the words of a few are held at once."""
        parts = [cls(texts[k : k + at_once], [None] * len(texts[k : k + at_once]), vocabulary) for k in range(0, len(texts), at_once)]
        out = cls.__new__(cls)
        out.row = np.concatenate([p.row + k * at_once for k, p in enumerate(parts)])
        out.feature, out.value, out.stats = (np.concatenate([getattr(p, a) for p in parts]) for a in ("feature", "value", "stats"))
        return out

    def with_bins(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) with one feature for the bin of each statistic."""
        n = len(self.stats)
        bins = np.stack([np.searchsorted(edges[k], self.stats[:, k], side="right") for k in range(len(STATS))], axis=1)
        feature = N_WORD + N_SHAPE + np.arange(len(STATS)) * BINS + bins
        row = np.r_[self.row, np.repeat(np.arange(n), len(STATS))]
        value = np.r_[self.value, np.full(n * len(STATS), 0.5)]
        order = np.argsort(row, kind="stable")
        return row[order], np.r_[self.feature, feature.ravel()][order], value[order]


class Machine:
    def __init__(self):
        rng = np.random.default_rng(11)
        self.bias, self.weight, self.vector = np.zeros(1), np.zeros(N), rng.normal(0, 0.05, (N, RANK))
        self.edges, self.fitted = np.zeros((len(STATS), BINS - 1)), False

    def raw(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of vectors that gradients need. Rows are sorted."""
        bounds = np.searchsorted(row, np.arange(n))
        full = np.bincount(row, minlength=n) > 0
        vx = self.vector[feature] * value[:, None]
        sums, squares, linear = np.zeros((n, RANK)), np.zeros(n), np.bincount(row, self.weight[feature] * value, n)
        if len(row):
            sums[full] = np.add.reduceat(vx, bounds[full], axis=0)
            squares[full] = np.add.reduceat((vx * vx).sum(axis=1), bounds[full])
        return self.bias[0] + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: list[bytes], recorded: list, vocabulary: Vocabulary) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):  # so many texts that their words fit, one at least
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 22):
                size += len(texts[to])
                to += 1
            rows = Rows(texts[at:to], recorded[at:to], vocabulary)
            out.append(sigmoid(self.raw(*rows.with_bins(self.edges), to - at)[0]))
            at = to
        return np.concatenate(out) if out else np.zeros(0)


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 10, batch: int = 200) -> Machine:
    """Logistic loss by Adam over small batches, in a fixed order; length is taken from the texts themselves.

    Without documents of both labels nothing is learnt and every score is 0.5.
    """
    model = Machine()
    if not 0 < y.sum() < len(y):
        model.vector[:] = 0
        return model
    rows = Rows.of(texts, Vocabulary())
    model.edges = np.quantile(rows.stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    # the ends of a statistic tell most: an edge close to each end
    model.edges[:, 0], model.edges[:, -1] = np.quantile(rows.stats, 0.03, axis=0), np.quantile(rows.stats, 0.97, axis=0)
    row, feature, value = rows.with_bins(model.edges)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    model.bias[0] = np.log(y.mean() / (1 - y.mean()))
    rng, opt = np.random.default_rng(5), Adam(0.03)
    epochs = max(epochs, -(-150 * batch // len(texts)))  # few documents: more rounds
    for e in range(epochs):
        opt.rate = 0.03 * (1 - 0.8 * e / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            size = ends[chosen + 1] - ends[chosen]
            take = np.repeat(ends[chosen] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            r, f, x = np.repeat(np.arange(len(chosen)), size), feature[take], value[take]
            z, sums = model.raw(r, f, x, len(chosen))
            g = (sigmoid(z) - y[chosen]) / len(chosen)
            gx = g[r] * x
            used, back = np.unique(f, return_inverse=True)
            gw = np.bincount(back, gx, len(used)) + 1e-5 * model.weight[used]
            parts = gx[:, None] * (sums[r] - model.vector[f] * x[:, None])
            gv = np.stack([np.bincount(back, parts[:, k], len(used)) for k in range(RANK)], axis=1) + 1e-5 * model.vector[used]
            opt.t += 1
            _sparse(opt, "weight", model.weight, used, gw)
            _sparse(opt, "vector", model.vector, used, gv)
            opt.step("bias", model.bias, np.array([g.sum()]))
    model.fitted = True
    return model


def fit_model(sample: DataFrame) -> Machine:
    """fit() on a labelled sample, in one task."""
    return fitted(sample, lambda t: fit(*texts_and_labels(t)))


def _sparse(opt: Adam, name: str, x: np.ndarray, used: np.ndarray, g: np.ndarray) -> None:
    """A step of the features in use alone."""
    m, v = opt.m.setdefault(name, np.zeros_like(x)), opt.v.setdefault(name, np.zeros_like(x))
    m[used] = 0.9 * m[used] + 0.1 * g
    v[used] = 0.99 * v[used] + 0.01 * g * g
    x[used] -= opt.rate * m[used] / (1 - 0.9**opt.t) / (np.sqrt(v[used] / (1 - 0.99**opt.t)) + 1e-8)


def score_quality(docs: DataFrame, model: Machine, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """(doc_id, score) for every row, or the columns `keep` and the score as `out`.

    The recorded length is the integer column n_chars where there is one; where it is null or absent, the text's own.
    A null, empty or blank text is scored by its structure alone. Null ids and repeated rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    kinds = dict(docs.dtypes)
    recorded: Column = F.col("n_chars").cast("double") if kinds.get("n_chars") in ("int", "bigint") else F.lit(None).cast("double")
    text, length = "text" if "text" in keep else "__text", fresh(docs, "__recorded")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])

    def run(batches):
        vocabulary = Vocabulary()
        for b in batches:
            score = shared.value.score(encoded(b, text), b.column(length).to_pylist(), vocabulary)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score)], names=[*keep, out])

    return map_arrow(docs.select(*keep, *[F.col("text").alias("__text")][: text not in keep], recorded.alias(length)), run, schema)


def op6_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score; see score_quality() and sample_rows() for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(sample_rows(docs, table(spark, sf_dir, "labels"), "quality"))
    scored = score_quality(spread(docs), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (scored.score >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op6_factorisation_quality": op6_factorisation_quality}
