"""Toxic spans by a linear-chain conditional random field.

Every word is tagged toxic or not. Labelled tokens come from labelled documents: a word type, or all words of one
beginning, are evidence if they stand in many distinct contexts of toxic documents and in next to none of the others,
and their tokens in toxic documents are the toxic ones. Features are the word, its beginnings and end, its shape, and
the words beside it. Forward-backward marginals are computed
for a whole batch as one chain that starts anew at each document: blocks of the chain are scanned side by side and then
joined. A document's score is a logistic function of its marginals.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus import spread
from .common import encoded, fitted, held_out, map_arrow, table
from .learn import Adam, sample_rows, sigmoid, texts_and_labels

WORD_BITS, SIDE_BITS = 14, 12
BLOCK = 128
#: Lengths of a word's beginnings, in bytes.
HEADS = (4, 5)
#: Distinct contexts that a word type needs to be evidence, its rate among toxic documents over that among others, and
#: types that pass by chance, on average, among all.
CONTEXTS, RATIO, BY_CHANCE = 4, 20.0, 0.1
#: Contexts of a type that are held at most, as a share of the documents.
HELD = 0.02
#: Word types that a worker remembers at most, and words of a batch scanned at once.
REMEMBERED, WORDS = 400_000, 1 << 20


def _blocks(m: np.ndarray) -> np.ndarray:
    """Prefix products of 2 x 2 matrices (4, K, S) along S, each scaled."""
    out = np.empty_like(m)
    out[:, :, 0] = m[:, :, 0]
    a, b, c, d = m[:, :, 0]
    for s in range(1, m.shape[2]):
        w, x, y, z = m[:, :, s]
        a, b, c, d = a * w + b * y, a * x + b * z, c * w + d * y, c * x + d * z
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
        out[0, :, s], out[1, :, s], out[2, :, s], out[3, :, s] = a, b, c, d
    return out


def marginals(e: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """P(toxic) of each word from emissions e, chains that begin where `first` is true, transition and start scores.

    With pairs, also P(previous = i, this = j) as (2, 2, n), meaningless at the first word of a chain.
    """
    n = len(e)
    if not n:
        return np.zeros(0)
    hot = np.exp(np.clip(e, -30, 30))
    scale = np.maximum(hot, 1.0)
    off, on = 1.0 / scale, hot / scale
    t, b = np.exp(trans - trans.max()), np.exp(start - start.max())
    m = np.empty((4, n))
    m[0], m[1] = np.where(first, b[0], t[0, 0]) * off, np.where(first, b[1], t[0, 1]) * on
    m[2], m[3] = np.where(first, b[0], t[1, 0]) * off, np.where(first, b[1], t[1, 1]) * on
    k = -(-n // BLOCK)
    pad = np.zeros((4, k * BLOCK))
    pad[:, :n] = m
    pad[0, n:] = pad[3, n:] = 1.0
    pad = pad.reshape(4, k, BLOCK)
    fore = _blocks(pad)
    # from the right: products of what follows, by the same scan over the mirrored, transposed chain
    back = _blocks(pad[[0, 2, 1, 3]][:, :, ::-1])
    left, right = np.empty((2, k)), np.empty((2, k))
    x, y = 1.0, 1.0
    for i, (p, q, r, s) in enumerate(fore[:, :, -1].T.tolist()):
        left[0, i], left[1, i] = x, y
        x, y = x * p + y * r, x * q + y * s
        x, y = x / (x + y), y / (x + y)
    x, y = 1.0, 1.0
    for i in range(k - 1, -1, -1):
        right[0, i], right[1, i] = x, y
        p, q, r, s = fore[:, i, -1].tolist()
        x, y = p * x + q * y, r * x + s * y
        x, y = x / (x + y), y / (x + y)
    alpha = np.stack([left[0, :, None] * fore[0] + left[1, :, None] * fore[2], left[0, :, None] * fore[1] + left[1, :, None] * fore[3]])
    # back[.., s] is the transposed product of the last s + 1 matrices; a word's own matrix is not in its beta
    after = back[:, :, ::-1]
    beta = np.empty((2, k, BLOCK))
    beta[0, :, -1], beta[1, :, -1] = right[0], right[1]
    beta[0, :, :-1] = after[0, :, 1:] * right[0, :, None] + after[2, :, 1:] * right[1, :, None]
    beta[1, :, :-1] = after[1, :, 1:] * right[0, :, None] + after[3, :, 1:] * right[1, :, None]
    alpha, beta = alpha.reshape(2, -1)[:, :n], beta.reshape(2, -1)[:, :n]
    both = alpha * beta
    p1 = both[1] / (both[0] + both[1])
    if not pairs:
        return p1
    prev = np.empty_like(alpha)
    prev[:, 1:], prev[:, 0] = alpha[:, :-1], 1.0
    joint = prev[:, None, :] * m.reshape(2, 2, n) * beta[None]
    return p1, joint / joint.sum(axis=(0, 1))


def _normal(word: bytes) -> bytes:
    return word.strip(b".,;:!?\"'()[]{}*#%&$|").lower() or word


def _heads(w: bytes) -> list[bytes]:
    """The beginnings that count as evidence, marked as such."""
    return [b"^" + w[:k] for k in HEADS if len(w) >= k]


def _features(word: bytes) -> tuple[int, ...]:
    """Places of a word type: itself, its beginnings, its tail, its shape; and itself as a neighbour."""
    w = _normal(word)
    n, s = 1 << WORD_BITS, 1 << SIDE_BITS
    shape = (w != word) + 2 * any(48 <= c < 58 for c in w) + 4 * word[:1].isupper() + 8 * (len(w) > 12)
    crc = zlib.crc32(w)
    heads = [n + k * s + zlib.crc32(w[:h], 1) % s for k, h in enumerate(HEADS)]
    return crc % n, *heads, n + 2 * s + zlib.crc32(w[-3:], 2) % s, n + 3 * s + shape, (crc >> 7) % s


N_STATE, N_SIDE = (1 << WORD_BITS) + 3 * (1 << SIDE_BITS) + 16, 1 << SIDE_BITS


class Tagger:
    """The model: weights of the word, of the words before and after it, transitions, starts, and the document's logistic."""

    def __init__(self):
        self.own, self.before, self.after = np.zeros(N_STATE), np.zeros(N_SIDE), np.zeros(N_SIDE)
        self.trans, self.start, self.doc = np.array([[0.0, -4.0], [0.0, -2.0]]), np.array([0.0, -4.0]), np.array([-30.0, 0.0, 0.0])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "types"}

    def emissions(self, words: list[bytes], first: np.ndarray) -> np.ndarray:
        types = self.__dict__.setdefault("types", _Types(self))
        return _chain_emissions(types.rows(words), first)

    def words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words of some texts, where each text begins, and the place of each."""
        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        words = [w for s in split for w in s]
        first = np.zeros(len(words) + 1, dtype=bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        return words, first[:-1], n

    def tag(self, texts: list[bytes]) -> list[np.ndarray]:
        """Marginals of the words of each text."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):  # so many texts that their words fit, one at least
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < 6 * WORDS):
                size += len(texts[to])
                to += 1
            words, first, n = self.words(texts[at:to])
            p = marginals(self.emissions(words, first), first, self.trans, self.start)
            out += np.split(p, np.cumsum(n)[:-1])
            at = to
        return out

    def signals(self, p: list[np.ndarray]) -> np.ndarray:
        """1, the expected number of toxic words (as a logarithm) and the highest marginal (as log odds), for each document."""
        out = np.tile([1.0, 0.0, -2.0], (len(p), 1))
        for i, x in enumerate(p):
            if len(x):
                top = min(max(float(x.max()), 1e-6), 1 - 1e-6)
                out[i, 1:] = np.log1p(x.sum()), np.clip(np.log(top / (1 - top)) / 4, -2, 2)
        return out

    def score(self, p: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.signals(p) @ self.doc)


class _Types:
    """Weights by word type, for the types met so far."""

    def __init__(self, model: Tagger):
        self.model, self.known, self.table, self.n = model, {}, np.zeros((1024, 3)), 0

    def rows(self, words: list[bytes]) -> np.ndarray:
        if self.n > REMEMBERED:
            self.known, self.n = {}, 0
        new = set(words).difference(self.known)
        if new:
            f = np.array([_features(w) for w in new], dtype=np.int64)
            m = self.model
            rows = np.column_stack([m.own[f[:, :5]].sum(axis=1), m.before[f[:, 5]], m.after[f[:, 5]]])
            while self.n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.n : self.n + len(new)] = rows
            self.known.update(zip(new, range(self.n, self.n + len(new)), strict=True))
            self.n += len(new)
        return self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]


def _chain_emissions(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own weight, that of the word before as a neighbour, and that of the word after, inside a chain."""
    e = rows[:, 0].copy()
    inner = ~first[1:]
    e[1:] += np.where(inner, rows[:-1, 1], 0)
    e[:-1] += np.where(inner, rows[1:, 2], 0)
    return e


def evidence(texts: list[bytes], y: np.ndarray) -> set[bytes]:
    """Word types, and beginnings after a ^, that mark toxic documents.

    A type that has nothing to do with toxicity stands in a toxic document as often as documents are toxic. It is evidence
    if that is refuted by the bound on the tail of a binomial (exp of -n times the divergence of the rates) for all types
    at once, so a rare mark is as good as a frequent one, however many marks there are. Documents count as often as there
    are distinct contexts, so copies of one passage are no evidence.
    """
    contexts: dict[bytes, set] = defaultdict(set)
    toxic, clean = Counter(), Counter()
    for t, label in zip(texts, y.tolist(), strict=True):
        w = [_normal(x) for x in t.split()]
        types = set(w)
        (toxic if label else clean).update(types.union(*map(_heads, types)))
        if label:
            for a, b, c in zip([b"", *w], w, [*w[1:], b""], strict=False):
                for key in (b, *_heads(b)):
                    if len(contexts[key]) < 4 * CONTEXTS + len(texts) * HELD:
                        contexts[key].add((a, c))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    rate, need = n1 / (n1 + n0), np.log(max(1, len(toxic)) / BY_CHANCE)

    def marks(w: bytes, k: int) -> bool:
        if len(contexts[w]) < CONTEXTS or k / n1 < RATIO * (clean[w] + 0.1) / n0:
            return False
        some, none = min(k, len(contexts[w])), clean[w]
        own = some / (some + none)
        return own > rate and some * np.log(own / rate) + (none * np.log((1 - own) / (1 - rate)) if none else 0.0) >= need

    return {w for w, k in toxic.items() if marks(w, k)}


def fit(texts: list[bytes], y: np.ndarray, rounds: int = 40, docs: int = 1600) -> Tagger:
    """Maximum likelihood by Adam on whole chains; then the documents' logistic by Newton's method.

    Evidence and the logistic use all texts given; the chains are fitted on the first `docs` / 2 texts of each label,
    which for a labelled sample are drawn by the hash of the id.

    Without documents of both labels the model knows nothing and every score is next to 0.
    """
    model = Tagger()
    if not 0 < y.sum() < len(y):
        return model
    marks = evidence(texts, y)
    toxic, clean = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    chosen = np.sort(np.r_[toxic[: docs // 2], clean[: docs // 2]])
    words, first, n = model.words([texts[i] for i in chosen])
    label = np.repeat(y[chosen], n)
    types = list(dict.fromkeys(words))
    place = {w: i for i, w in enumerate(types)}
    at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
    gold = np.array([not marks.isdisjoint((_normal(w), *_heads(_normal(w)))) for w in types])[at] * label
    f = np.array([_features(w) for w in types], dtype=np.int64)
    inner, prev = ~first[1:], gold[:-1]
    seen = np.array([[(inner & (prev == i) & (gold[1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    begun = np.array([(first & (gold == j)).sum() for j in (0, 1)], dtype=float)
    opt, total = Adam(0.3), max(1, len(words))
    decay = 1e-6
    for r in range(rounds):
        opt.t, opt.rate = r + 1, 0.3 * (1 - 0.8 * r / rounds)
        rows = np.column_stack([model.own[f[:, :5]].sum(axis=1), model.before[f[:, 5]], model.after[f[:, 5]]])[at]
        p, joint = marginals(_chain_emissions(rows, first), first, model.trans, model.start, pairs=True)
        g = (p - gold) / total
        by_type = np.bincount(at, g, len(types))
        own = sum(np.bincount(f[:, k], by_type, N_STATE) for k in range(5))
        ahead, behind = np.r_[np.where(inner, g[1:], 0), 0], np.r_[0, np.where(inner, g[:-1], 0)]
        before = np.bincount(f[:, 5], np.bincount(at, ahead, len(types)), N_SIDE)
        after = np.bincount(f[:, 5], np.bincount(at, behind, len(types)), N_SIDE)
        for name, x, d in (("own", model.own, own), ("before", model.before, before), ("after", model.after, after)):
            opt.step(name, x, d + decay * x)
        opt.step("trans", model.trans, (joint[:, :, 1:][:, :, inner].sum(axis=2) - seen) / total)
        opt.step("start", model.start, (np.array([(first * (1 - p)).sum(), (first * p).sum()]) - begun) / total)
    x = model.signals(model.tag(texts))
    w = np.array([np.log(y.mean() / (1 - y.mean())), 0.0, 0.0])
    ridge = np.array([0.0, 0.1, 0.1])

    def loss(w: np.ndarray) -> float:
        s = np.clip(x @ w, -35, 35)
        return float(np.sum(np.log1p(np.exp(s)) - y * s) + 0.5 * np.sum(ridge * w * w))

    for _ in range(40):
        q = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(ridge + 1e-6), x.T @ (y - q) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    model.doc = w
    model.__dict__.pop("types", None)
    return model


def fit_model(sample: DataFrame) -> Tagger:
    """fit() on a labelled sample, in one task."""
    return fitted(sample, lambda t: fit(*texts_and_labels(t)))


def spans(text: str, p: np.ndarray, least: float = 0.5) -> list[tuple[int, int, float]]:
    """Runs of words with marginals of `least` or more: (start, end, highest marginal) in code points."""
    import re

    out: list[tuple[int, int, float]] = []
    if not len(p) or p.max() < least:
        return out
    last = -2
    for i, m in enumerate(re.finditer(r"[^\x20\x09-\x0D]+", text)):
        if p[i] >= least:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out


def score_toxicity(docs: DataFrame, model: Tagger) -> DataFrame:
    """(doc_id, score, spans: array of (start, end, marginal)) for every row of (doc_id, text).

    A null, empty or blank text has no words: its score is that of a document without toxic ones. Null ids and repeated
    rows are scored each; further columns are ignored. The model is a few hundred kB, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts = encoded(b)
            p = shared.value.tag(texts)
            found = [[{"start": s, "end": e, "marginal": m} for s, e, m in spans(t.decode(), x)] if len(x) and x.max() >= 0.5 else [] for t, x in zip(texts, p, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.score(p)), pa.array(found, type=kind)], names=["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,marginal:double>>")


def op2_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score and toxic spans; see score_toxicity() and sample_rows() for odd rows."""
    docs = table(spark, sf_dir, "documents")
    model = fit_model(sample_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    scored = score_toxicity(spread(docs), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (scored.score >= 0.5).cast("int").alias("predicted"), "spans")


QUERIES = {"op2_crf_toxicity": op2_crf_toxicity}
