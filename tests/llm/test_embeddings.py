"""Near-duplicate embeddings against all pairs, and neighbours against brute force."""

import numpy as np

from quillmill.llm.ann import build_graph, nearest, op5_pruned_graph
from quillmill.llm.embedding_dedup import cosine_components, op8_hyperplane_dedup, plan

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_components(rows, threshold=0.93):
    ok = [(i, lab, np.array(v, dtype=float)) for i, lab, v in rows if lab is not None and usable(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, l1, u) in enumerate(ok):
        for j, l2, w in ok[:a]:
            if l1 == l2 and len(u) == len(w) and u @ w / np.linalg.norm(u) / np.linalg.norm(w) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), i == min(seen))
    return out


def test_dedup_query_against_all_pairs(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in op8_hyperplane_dedup(spark, SF).collect()}
    assert got == brute_components(rows)


def test_dedup_of_odd_rows_and_a_large_bucket(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=16)
    rows = [(i, 1, (hot + 0.05 * rng.normal(size=16)).tolist()) for i in range(300)]
    rows += [(i, 1, hot.tolist()) for i in range(300, 340)] + [(i, 2, hot.tolist()) for i in range(340, 350)]
    rows += [(i, int(i % 3), rng.normal(size=16).tolist()) for i in range(350, 500)]
    rows += [(900, 1, None), (901, 1, [0.0] * 16), (902, 1, [NAN] * 16), (903, 1, [INF] + [1.0] * 15), (904, None, hot.tolist()), (905, 1, hot.tolist()[:8]), (906, 1, [None, *hot.tolist()[1:]]), (907, 1, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, label int, embedding array<double>, n_links int")
    want = brute_components(rows)
    for block in (512, 40):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_components(df, block=block).collect()}
        assert got == want
    none = cosine_components(df.limit(0))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.count() == 0


def test_plan_grows_with_the_input():
    assert plan(10)[0] == 8 and plan(10**9)[0] == 22
    bits, tables = plan(10**6)
    assert 1 - (1 - (1 - np.arccos(0.93) / np.pi) ** bits) ** tables >= 0.9995


def brute_nearest(rows, queries, top):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and usable(v)]
    out = {}
    for q, u in {(i, tuple(v)) for i, v in queries if i is not None and usable(v)}:
        found = sorted((-float(np.cumsum(np.array(u) * v)[-1]), i) for i, v in ok if i != q and len(v) == len(u))
        out[q] = [(i, -s) for s, i in found[:top]]
    return out


def test_neighbour_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = {}
    for r in sorted(op5_pruned_graph(spark, SF).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want


def test_recall_over_shards_and_blocks(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 24))
    rows = [(i, (centres[i % 20] * rng.uniform(0.5, 2) + 0.4 * rng.normal(size=24)).tolist()) for i in range(3000)]
    rows += [(i, rows[7][1]) for i in range(3000, 3100)]  # exact copies
    rows += [(5000, None), (5001, [0.0] * 24), (5002, [NAN] * 24), (5003, [None] * 24), (None, rows[3][1]), (5020, [1.0, 2.0]), (5040, [2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    queries = df.where("vec_id % 20 = 0 or vec_id = 7")
    want = brute_nearest(rows, [r for r in rows if r[0] is not None and (r[0] % 20 == 0 or r[0] == 7)], 10)
    got = {}
    for r in nearest(df, queries, top=10, shard_rows=500, block_rows=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want) and 5000 not in got and got[5020] == [(1, 5040, 4.0)]
    assert all([r for r, _, _ in sorted(got[q])] == list(range(1, len(want[q]) + 1)) for q in want)
    assert {v for _, v, _ in got[3000 + 20]} == {v for v, _ in want[3020]}  # the copies, the first ids of them
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])
    assert recall > 0.98


def test_neighbours_of_nothing(spark):
    df = spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert nearest(df, df).count() == 0 and nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_vectors_without_structure(spark):
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=128).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute_nearest(rows, [r for r in rows if r[0] % 20 == 0], 20)
    for exact in (False, True):
        got = {}
        for r in nearest(df, df.where("vec_id % 20 = 0"), exact=exact).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        if exact:
            assert {q: [(v, s) for _, v, s in sorted(x)] for q, x in got.items()} == want
        recall = np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
        assert recall >= 0.95


def test_every_point_is_reached():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(500, 8)) + 50 * k for k in range(4)]).astype(np.float32)
    graph, start = build_graph(x, degree=4, beam=8)
    seen, todo = {start}, [start]
    while todo:
        for j in set(graph[todo.pop()].tolist()) - seen - {-1}:
            seen.add(j)
            todo.append(j)
    assert len(seen) == len(x)


def test_large_buckets_are_cut(spark):
    rng = np.random.default_rng(6)
    hot = rng.normal(size=16)
    rows = [(i, 1, (hot + 0.06 * rng.normal(size=16)).tolist()) for i in range(200)] + [(i, 1, rng.normal(size=16).tolist()) for i in range(200, 260)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cosine_components(df, block=30, bucket_rows=25).collect()}
    assert got == brute_components(rows)
