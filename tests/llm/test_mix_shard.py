"""Mixing and sharding: exact sizes, targets, and places."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillmill.llm.mixing import SCHEDULES, curriculum_mix, op7_curriculum, targets, training_order, with_order_key
from quillmill.llm.sharding import communication_matrix, op10_hypergeometric, shard_sizes, uniform_shards


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        rest, free = total - sum(held.values()), [s for s in sizes if s not in held]
        goal = {s: w[s] * rest / sum(w[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > epochs * sizes[s]]
        if not over:
            return held | goal
        held |= {s: epochs * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 400}, {"a": 7}, {"a": 0, "b": 3}, {f"s{i}": (i * 37) % 91 + 1 for i in range(20)}])
def test_targets_as_by_repeated_sharing(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


def test_mix_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join("w" * int(rng.integers(0, 40))), str(rng.choice(["a", "b", "c"])), 0.5) for i in range(900)]
    rows += [(1000, None, "a", 0.0), (1001, "", None, 0.0), (1002, "x y", None, 0.0), (1003, "w " * 50_000, "b", 0.0), (5, "dup dup", "c", 0.0), (5, "dup dup", "c", 0.0), (None, "no id", "c", 0.0)]
    df = with_order_key(spark.createDataFrame(rows, "doc_id long, text string, source string, target double").repartition(5))
    mixed = curriculum_mix(df, range_rows=50)
    out = mixed.collect()
    assert len(out) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    goal, taken, most = plain_targets(sizes), defaultdict(int), defaultdict(int)
    for r in out:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source] and r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions) and list(r.positions) == sorted(r.positions)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    again = curriculum_mix(df.repartition(3), range_rows=7).collect()
    key = lambda x: sorted((r.doc_id or -1, r.size, r.taken, *r.positions) for r in x)
    assert key(out) == key(again)
    order = training_order(mixed).collect()
    assert len(order) == sum(r.copies for r in out)
    parts = training_order(mixed).rdd.mapPartitions(lambda x: [[r.position for r in x]]).collect()
    flat = [p for part in parts for p in part]
    assert flat == sorted(flat)


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(400)]
    out = curriculum_mix(with_order_key(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    for k, s in enumerate(("a", "b", "c")):
        places = sorted(p for r in out if r.source == s for p in r.positions)
        knots = np.array(SCHEDULES[k])
        t = np.linspace(0, 1, 2001)
        given = np.cumsum(np.interp(t, *knots.T))
        given /= given[-1]
        assert np.abs(np.searchsorted(places, t) / len(places) - given).max() < 0.01


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert curriculum_mix(with_order_key(none)).count() == 0
    assert [r.taken for r in curriculum_mix(with_order_key(spark.createDataFrame([(1, None, "a")], "doc_id long, text string, source string"))).collect()] == [0]


def test_query_sums(spark, sf):
    rows = op7_curriculum(spark, sf).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for r in rows:
        sizes[docs[r.doc_id]] += r.size
    want = plain_targets(sizes)
    assert all(math.isclose(r.target, want[docs[r.doc_id]], abs_tol=1e-5) for r in rows) and len(rows) == len(docs)


def test_matrix_sums_and_law():
    parts, cells = np.array([5, 0, 17, 3]), np.array([10, 1, 14])
    m = np.array([communication_matrix(parts, cells, s) for s in range(4000)])
    assert (m.sum(axis=2) == parts).all() and (m.sum(axis=1) == cells).all()
    assert np.abs(m.mean(axis=0) - np.outer(parts, cells) / 25).max() < 0.1


def check_shards(rows, shards, n):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert len(rows) == n and sorted(len(slots[s]) for s in range(shards)) == sorted(shard_sizes(n, shards).tolist())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shard_query(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_hypergeometric(spark, sf).collect()
    check_shards(rows, 16, len(docs))
    assert all((r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id]), "rows", None) for r in rows)


def test_shards_of_odd_rows(spark):
    rows = [(None, "x", "a"), (2**62 + 1, None, "b"), (2**62 + 1, None, "b"), (4, "", "c"), *((i, "y", None) for i in range(100))]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(7)
    out = uniform_shards(df, shards=6, cells=20)
    got = out.collect()
    check_shards(got, 6, len(rows))
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(map(str, got)) == sorted(map(str, out.collect()))
    assert uniform_shards(df.limit(0), shards=3).count() == 0


def test_every_order_is_likely(spark):
    df = spark.range(0, 400, 1, 8).withColumnRenamed("id", "doc_id")
    place = np.array([[r.shard for r in sorted(uniform_shards(df, 4, seed).collect())] for seed in range(12)])
    assert abs(np.mean(place[:, :200] == place[:, 200:]) - 0.25) < 0.04


def test_shards_against_a_plain_version(spark, tmp_path):
    from quillmill.llm.common import located
    from quillmill.llm.sharding import _cells

    spark.range(0, 700, 1, 5).withColumnRenamed("id", "doc_id").write.parquet(f"file://{tmp_path}/d")
    df = spark.read.parquet(f"file://{tmp_path}/d")
    placed, path, row = located(df)
    files = defaultdict(list)
    for r in placed.collect():
        files[r[path]].append((r[row], r.doc_id))
    cells = _cells(700, 4, 2)
    matrix = communication_matrix(np.array([len(files[p]) for p in sorted(files)]), cells, 9)
    ranges = defaultdict(list)
    for k, p in enumerate(sorted(files)):
        rng = np.random.Generator(np.random.Philox(key=[9, (1 << 62) + k]))
        cell = rng.permutation(np.repeat(np.arange(8, dtype=np.int32), matrix[k]))
        key = rng.integers(0, 2**63 - 1, len(cell), dtype=np.int64)
        for at, i in files[p]:
            ranges[int(cell[at])].append((int(key[at]), p, at, i))
    want, first = {}, np.r_[0, np.cumsum(cells)]
    for c, members in ranges.items():
        for rank, (*_, i) in enumerate(sorted(members)):
            shard = c // 2
            want[i] = (shard, int(first[c] - first[2 * shard]) + rank)
    assert {r.doc_id: (r.shard, r.slot) for r in uniform_shards(df, 4, 9, cells=8).collect()} == want


def test_large_populations_follow_the_law():
    from quillmill.llm.sharding import _hypergeometric

    rng = np.random.default_rng(3)
    good, bad, n = 3 * 10**9, 7 * 10**9, 10**6
    got = np.array([_hypergeometric(rng, good, bad, n) for _ in range(400)])
    sd = math.sqrt(n * 0.3 * 0.7)
    assert abs(got.mean() - 0.3 * n) < 5 * sd / 20 and 0.85 < got.std() / sd < 1.15
    m = communication_matrix(np.array([10**9, 2 * 10**9]), np.array([15 * 10**8, 5 * 10**8, 10**9]), 4)
    assert m.sum(axis=1).tolist() == [10**9, 2 * 10**9] and m.sum(axis=0).tolist() == [15 * 10**8, 5 * 10**8, 10**9]
