"""The pipeline's rows against a plain version of every stage: pairs of features, all pairs of documents, a scan of each
candidate's windows, sources in one sorted list each, the tokenizer's own ids in one array."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from test_mix_shard import plain_targets
from test_secrets import BASE, entropy
from test_simhash import components
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillmill.llm import quality, secrets
from quillmill.llm.common import table
from quillmill.llm.learn import sample_rows
from quillmill.llm.mixing import SCHEDULES

SF = "/root/testdata/sf0.01"


def good(spark, rows):
    """Rows whose score by the sum over all pairs of features reaches the threshold."""
    model = quality.fit_model(sample_rows(table(spark, SF, "documents"), table(spark, SF, "labels"), "quality"))
    out = []
    for r in rows:
        one = quality.Rows([(r.text or "").encode()], [r.n_chars], quality.Vocabulary())
        _, f, x = one.with_bins(model.edges)
        v = model.vector[f] * x[:, None]
        z = model.bias[0] + model.weight[f] @ x + np.triu(v @ v.T, 1).sum()
        if 1 / (1 + np.exp(-z)) >= quality.THRESHOLD:
            out.append(r)
    return out


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {None}


def alone(rows):
    """The document of the smallest id of each group at a Jaccard of 0.8 or more, by all pairs."""
    sets, links = [shingles(r.text) for r in rows], []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                both = len(a & b)
                if both >= 0.8 * (len(a) + len(b) - both) - 1e-9:
                    links.append((rows[j].doc_id, rows[i].doc_id))
    group = components([r.doc_id for r in rows], links)
    return [r for r in rows if group[r.doc_id] == r.doc_id]


def window(s, width, bits):
    hits = [i for i in range(len(s) - width + 1) if entropy(s[i : i + width]) >= bits - 1e-9]
    return (hits[0], hits[-1] + width) if hits else None


def redacted(text):
    base = [(m.start(), m.end()) for p, ok in BASE for m in p.finditer(text) if ok(m)]
    inside = lambda a, spans: any(x <= a[0] and a[1] <= y for x, y in spans)
    added = []
    for c in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if inside(c.span(), base):
            continue
        harmless = [m.span() for m in re.finditer(secrets.HARMLESS, c[0])]
        for lo, hi in zip([0, *(e for _, e in harmless)], [*(s for s, _ in harmless), len(c[0])], strict=True):
            if hi - lo < 20:
                continue
            piece, at = c[0][lo:hi], c.start() + lo
            whole = window(piece, *secrets.CLASSES[1][2:])
            found = [whole] if whole else []
            for run in re.finditer(secrets.HEX_RUN, piece):
                h = window(run[0].lower(), *secrets.CLASSES[0][2:])
                if h and not inside(h := (run.start() + h[0], run.start() + h[1]), [whole] if whole else []):
                    found.append(h)
            added += [s for x, y in found if not inside(s := (at + x, at + y), base)]
    out, at = "", 0
    for start, end in sorted(base + added):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def due(share, knots):
    """The time at which the integral of the rates has reached its share, by halving."""
    area = lambda t: sum((min(b[0], t) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(b[0], t) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:], strict=False) if a[0] < t)
    lo, hi, want = 0.0, 1.0, share * area(1.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if area(mid) < want else (lo, mid)
    return hi


def in_order(rows):
    """[(time, doc_id, text)] of the copies that the mix takes, from (doc_id, source, text)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t))
    sources, copies = defaultdict(list), []
    for i, s, t in rows:
        key = hashlib.md5(f"7|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        sources[s].append((key, i, size(t), t))
    totals = {s: sum(x[2] for x in xs) for s, xs in sources.items()}
    goal = plain_targets(totals)
    for rank, s in enumerate(sorted(sources, key=lambda s: (s is None, s))):
        begin, total = 0, totals[s]
        for _, i, n, t in sorted(sources[s]):
            rounds = int(goal[s] // total)
            extra = begin + n / 2 < goal[s] - rounds * total
            for k in range(min(rounds + extra, 3) if n else 0):
                copies.append((due(min((begin + k * total) / goal[s], 1.0), SCHEDULES[rank % 3]), i, t))
            begin += n
    return sorted(copies)


def packed(copies):
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    place, known = 0, {}
    for _, i, t in copies:
        ids = known.setdefault(t, np.array([*encode(t, add_special_tokens=False).ids, 2], dtype="<u4"))
        lo = 0
        while lo < len(ids):
            seq, offset = divmod(place, 4096)
            n = min(len(ids) - lo, 4096 - offset)
            yield i, lo, n, zlib.crc32(ids[lo : lo + n].tobytes()), len(ids), seq, offset
            lo, place = lo + n, place + n


def test_rows_of_the_pipeline(spark):
    docs = table(spark, SF, "documents").collect()
    kept = good(spark, docs)
    single = alone(kept)
    clean = [(r.doc_id, r.source, redacted(r.text or "")) for r in single]
    copies = in_order(clean)
    assert len(docs) > len(kept) > len(single) >= len({i for _, i, _ in copies}) and len(copies) > len({i for _, i, _ in copies})
    assert any("[SECRET]" in t for *_, t in clean)
    out = cp.run(spark, SF)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    got = sorted((tuple(r) for r in out.select(names).collect()), key=lambda r: r[5:])
    assert got == list(packed(copies))
