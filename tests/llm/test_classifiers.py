"""The tagger's marginals against plain recursions, and both classifiers on documents they have not seen."""

import zlib

import numpy as np
import pytest

from quillmill.llm import quality, toxicity
from quillmill.llm.learn import labelled_sample

SF = "/root/testdata/sf0.01"


def plain_marginals(e, first, trans, start):
    n = len(e)
    p = np.zeros(n)
    cut = np.r_[np.flatnonzero(first), n]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        m = b - a
        f, g = np.zeros((m, 2)), np.ones((m, 2))
        f[0] = np.exp(start) * np.exp([0, e[a]])
        for t in range(1, m):
            f[t] = (f[t - 1] @ np.exp(trans)) * np.exp([0, e[a + t]])
        for t in range(m - 2, -1, -1):
            g[t] = np.exp(trans) @ (np.exp([0, e[a + t + 1]]) * g[t + 1])
        p[a:b] = (f * g)[:, 1] / (f * g).sum(axis=1)
    return p


@pytest.mark.parametrize("n", [1, 2, 127, 128, 129, 700])
def test_marginals(n):
    rng = np.random.default_rng(n)
    e, first = rng.normal(size=n) * 3, rng.random(n) < 0.05
    first[0] = True
    trans, start = rng.normal(size=(2, 2)), rng.normal(size=2)
    p, joint = toxicity.marginals(e, first, trans, start, pairs=True)
    assert np.abs(p - plain_marginals(e, first, trans, start)).max() < 1e-12
    inner = ~first
    assert np.allclose(joint[:, 1][:, inner].sum(axis=0), p[inner]) and np.isfinite(toxicity.marginals(e * 1e6, first, trans * 5, start)).all()


def test_pairs_by_the_identity():
    texts = [b"a b c a", b"", b"| x | y", "é É 1 2 22".encode()]
    model, rows = quality.Machine(), quality.Rows(texts, [None, 3.0, None, 7.0], quality.Vocabulary())
    model.weight[:] = np.random.default_rng(0).normal(size=quality.N)
    row, feature, value = rows.with_bins(model.edges)
    z, _ = model.raw(row, feature, value, len(texts))
    for d in range(len(texts)):
        f, x = feature[row == d], value[row == d]
        v = model.vector[f] * x[:, None]
        pairs = sum(v[i] @ v[j] for i in range(len(f)) for j in range(i))
        assert np.isclose(z[d], model.bias[0] + model.weight[f] @ x + pairs)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op2_crf_toxicity, "toxic", 0.95), (quality.op6_factorisation_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, SF).collect()
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    limit = 0.5 if label == "toxic" else 0.3
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= limit) for r in rows)
    unseen = [(r.predicted, y[r.doc_id]) for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([a == b for a, b in unseen]) >= least
    assert sorted(map(str, query(spark, SF).collect())) == sorted(map(str, rows))


def test_labels_are_learnt_outside_the_held_out_fifth(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(100)] + [(1, "again"), (None, "x"), (200, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 0), (4, None), (None, 1), (200, 1), (50, 7)], "doc_id long, toxic int")
    texts, y = labelled_sample(docs, labels, "toxic")
    want = {i: i % 2 for i in range(100) if not held(i) and i != 3}
    assert sorted(zip(texts, y.tolist(), strict=True)) == sorted((b"again" if i == 1 else f"text {i}".encode(), v) for i, v in want.items())
    assert len(labelled_sample(docs, labels, "toxic", limit=7)[0]) == 7


def test_spans_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(60)]
    texts, y = [], []
    for k in range(300):
        t = [str(w) for w in rng.choice(words, 30)]
        if k % 3 == 0:
            for at in rng.choice(30, 3, replace=False):
                t[at] = str(rng.choice(["nasty!", "Vile", "rotten"]))
        texts.append(" ".join(t).encode())
        y.append(int(k % 3 == 0))
    model = toxicity.fit(texts, np.array(y))
    long = "w1 w2 " * 60_000 + "vile"
    rows = [(1, "w1 é vile, nasty w3", 0.0), (1, "w1 é vile, nasty w3", 0.0), (2, None, 0.0), (3, "", 0.0), (4, " \n", 0.0), (None, "w1 w2", 0.0), (5, long, 0.0)]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [s.end for s in by[1].spans] == [16] and by[1].spans[0].start in (3, 5) and by[1].score > 0.5
    assert by[2].score == by[3].score == by[4].score < 0.5 and by[None].score < 0.5 and by[2].spans == []
    assert [(s.start, s.end) for s in by[5].spans] == [(len(long) - 4, len(long))]
    machine = quality.fit(texts, 1 - np.array(y))
    scored = quality.score_quality(spark.createDataFrame([(i, t, None) for i, t, _ in rows], "doc_id long, text string, n_chars long"), machine).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 for r in scored)
    good = {r.doc_id: r.score for r in scored}
    assert good[1] < 0.5 < good[None] and good[2] == good[3]


def test_nothing_to_learn_from_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    texts, y = labelled_sample(none, labels, "toxic")
    for module, score in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        model = module.fit(texts, y)
        assert score(none, model).count() == 0
        got = score(spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_chars long"), model).collect()[0].score
        assert got < 1e-6 if module is toxicity else got == 0.5


def test_many_rare_marks_and_copies_of_a_passage():
    rng = np.random.default_rng(1)
    common = 1 / np.arange(1, 5001)
    texts, y = [], []
    for k in range(6000):
        words = [f"w{x}x" for x in rng.choice(5000, 60, p=common / common.sum())]
        if k % 6 == 0:
            for at in rng.choice(60, 2, replace=False):
                words[at] = f"q{rng.integers(100)}zzt"  # each in about 2% of the toxic documents
        texts.append(" ".join(words).encode())
        y.append(int(k % 6 == 0))
    copied = " ".join(f"copy{i}end" for i in range(50)).encode()
    texts[6:600:6] = [copied] * 99
    found = toxicity.evidence(texts[:4800], np.array(y[:4800]))
    marks = {w for w in found if not w.startswith(b"^")}
    assert sum(w.startswith(b"q") for w in marks) >= 90 and not any(w.startswith(b"copy") for w in marks) and sum(w.startswith(b"w") for w in marks) <= 1
    model = toxicity.fit(texts[:4800], np.array(y[:4800]))
    guess = model.score(model.tag(texts[4800:])) >= 0.5
    assert np.mean(guess == y[4800:]) >= 0.95
