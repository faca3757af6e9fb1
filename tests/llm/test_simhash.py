"""SimHash: the trie join against all pairs, fingerprints against the definition, and the odd rows."""

import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quillmill.llm.components import connected_components
from quillmill.llm import simhash
from quillmill.llm.simhash import near_copies, op1_simhash_trie, plan, proposed, shared, simhash_components, wide_fingerprint
from quillmill.llm.trie import trie_self_join


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    fp = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    x = np.array([fp[i] for i in ids], dtype=np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    return sorted((i, f"{fp[i]:016x}", comp[i]) for i in ids)


@pytest.mark.parametrize(("exact", "depth", "budget"), [(0, 64, 2), (0, 20, 3), (8, 32, 2), (0, 6, 0)])
def test_trie_join_finds_each_pair_once(exact, depth, budget):
    rng = np.random.default_rng(1)
    far = rng.integers(0, 2**63, 400).astype(np.uint64)
    near = far[0] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    codes = np.sort(np.r_[far, near])
    got = [p for i, j in trie_self_join(codes, exact, depth, budget) for p in zip(i.tolist(), j.tolist(), strict=True)]
    mask = np.uint64(((1 << depth) - 1) << (64 - depth))
    close = np.bitwise_count((codes[:, None] ^ codes[None, :]) & mask) <= budget
    if exact:
        close &= (codes[:, None] >> np.uint64(64 - exact)) == (codes[None, :] >> np.uint64(64 - exact))
    assert sorted(got) == list(zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))), strict=True))


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op1_simhash_trie(spark, sf).collect()) == brute(rows)


def test_nulls_empties_copies_long_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(5, None, 1), (3, "", 2), (9, " \t\n", 3), (1, "one", 4), (2, "ONE", 5), (4, "one two", 6), (7, long, 7), (7, long, 7), (8, long + " tail", 8)]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp long"))
    want = {i: plain_fingerprint(t) for i, t, _ in rows if i != 7} | {7: plain_fingerprint(long)}
    out = got.collect()
    assert len(out) == len(rows)
    assert {r.doc_id: r.fp % 2**64 for r in out} == want
    comp = {r.doc_id: r.component_id for r in out}
    assert comp[5] == comp[3] == comp[9] == 3 and comp[1] == comp[2] == 1 and comp[7] == comp[8] == 7
    nulls = simhash_components(spark.createDataFrame([(None, "x"), (None, "x"), (6, "y z")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in nulls) == [(-1, -1), (-1, -1), (6, 6)]


def test_empty_table(spark):
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_near_copies_by_similarity(spark):
    rng = np.random.default_rng(3)
    rows, group = [], defaultdict(list)
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for c in range(3):
            words = list(base)
            for at in rng.choice(300, 4 * c, replace=False):  # 4 changed words leave a similarity of about 0.87
                words[at] = f"v{rng.integers(0, 10**6)}"
            group[g].append(len(rows))
            rows.append((len(rows), " ".join(words if c < 2 else base)))
        rows.append((len(rows), " ".join(f"u{x}" for x in rng.integers(0, 5000, 300))))
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = sum(len({got[i] for i in ids}) == 1 for ids in group.values())
    assert whole >= 55
    grouped = {i for ids in group.values() for i in ids}
    assert all(got[i] == i for i, _ in rows if i not in grouped)


@pytest.mark.parametrize("block", [2048, 40])
def test_the_sets_decide(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng, rows = np.random.default_rng(8), []
    for g in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        for changed in (0, *((22,) if g % 2 else (20,))):  # at the end: sets of 196 with 174 (0.798) or 176 (0.815) in common
            rows.append((len(rows), " ".join(base[: 200 - changed] + [f"v{x}" for x in rng.integers(0, 10**6, changed)])))
    hub = [f"h{x}" for x in rng.integers(0, 10**6, 200)]
    rows += [(len(rows) + k, " ".join([*hub, f"t{k}"])) for k in range(100)]  # one cluster of many blocks
    rows += [(None, "one two"), (None, "one two"), (999, "one two")]
    got = {r.doc_id: r.component_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[2 * g + 1] == 2 * g for g in range(60)] == [g % 2 == 0 for g in range(60)]
    assert {got[i] for i in range(120, 220)} == {120} and got[999] == got[None] == 999


@pytest.mark.parametrize("rows", [10**4, 10**6, 10**8, 10**10])
def test_the_plan_meets_a_pair_at_the_similarity_at_every_size(rows):
    bits, tables = plan(rows)
    assert shared(0.8, bits, tables) >= 0.99
    assert rows / 2**bits <= 2**-6 or rows <= 2**18


def test_pairs_at_the_similarity_share_a_table():
    bits, tables = plan(10**8)
    words, met, rng = -(-bits * tables // 64), 0, np.random.default_rng(5)
    for _ in range(200):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 184)]  # 180 shingles; 20 of them change: 160 of 200 stay
        a, b = (wide_fingerprint(" ".join(t).encode(), 5, words)[None] for t in (base, [*base[:-20], *(f"v{x}" for x in rng.integers(0, 10**6, 20))]))
        apart = [int(np.bitwise_count((simhash._slice(a, t * bits, bits) ^ simhash._slice(b, t * bits, bits)) >> np.uint64(64 - bits))[0]) for t in range(tables)]
        met += min(apart) <= simhash.BUDGET and int(np.bitwise_count(a ^ b)[0, : simhash.CARRIED].sum()) <= proposed(0.8, simhash.CARRIED)
    assert met >= 197
