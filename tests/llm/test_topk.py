import math
import random

import numpy as np

from wirespark.llm.topk import BallTree, integers, op3_exact_topk, top_k


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_tree_against_brute_force_with_and_without_floors():
    rng = np.random.default_rng(1)
    for spread in (3, 300, 1 << 40):
        v = rng.integers(-spread, spread, (400, 6))
        v[100:200] = v[7]  # many ties
        ids = rng.permutation(400).astype(np.int64)
        tree, rows = BallTree.of_bytes(BallTree.build(ids, v, leaf=16).to_bytes()), list(zip(ids.tolist(), v.tolist()))
        want = brute(rows, rows[:40], 5)
        kth = {q: s for q, rank, _, s in want if rank == 5}
        for floors in ([None] * 40, [kth[int(q)] for q in ids[:40]]):
            found = {}
            for q, i, s in tree.search(ids[:40], v[:40], floors, 5)[0]:
                found.setdefault(q, []).append((-s, i))
            assert sorted((q, n + 1, i, -s) for q, x in found.items() for n, (s, i) in enumerate(sorted(x))) == want


def test_branches_are_left_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-3000, 3000, (40, 4))
    v = (centres[rng.integers(0, 40, 8000)] + rng.integers(-40, 40, (8000, 4))).astype(np.int64)
    ids = np.arange(8000)
    tree = BallTree.build(ids, v)
    _, scored = tree.search(ids[::50], v[::50], [None] * 160, 5)
    assert scored.sum() < 0.25 * 160 * 8000 and scored.min() >= 5
    again, less = tree.search(ids[::50], v[::50], [10**12] * 160, 5)
    assert again == [] and less.sum() == 0
    sound = tree.centres[tree.child[0]], tree.radii[tree.child[0]]
    part = v[np.isin(ids, tree.ids[tree.begin[tree.child[0]] : tree.end[tree.child[0]]])]
    assert (np.sqrt(((part - sound[0]) ** 2).sum(1)) <= sound[1] + 1e-6).all()


def test_query_with_odd_rows(spark, tables):
    random.seed(2)
    rows = [(i, [random.uniform(-1, 1) for _ in range(8)], i) for i in range(260)]
    rows += [(300, None, 1), (350, [None] * 8, 1), (400, [float("nan")] * 8, 1), (450, [math.inf] * 8, 1), (500, [1.0, 2.0], 1), (501, [1.0, 2.0], 1), (550, [], 1), (7, rows[7][1], 1), (None, [1.0] * 8, 1)]
    tables.make("embeddings", rows, "vec_id long, embedding array<float>, score int")
    v = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    asked = [x for x in v if x[0] % 50 == 0]
    assert sorted(tuple(r) for r in op3_exact_topk(spark, tables).collect()) == brute(v, asked, 5)
    base = integers(spark.read.parquet(f"{tables}/embeddings.parquet")).cache()
    many = top_k(base, base.filter("vec_id % 50 = 0"), 5, shard_rows=40, block_rows=2)
    assert sorted(tuple(r) for r in many.collect()) == brute(v, asked, 5)
    tables.make("embeddings", [], "vec_id long, embedding array<float>")
    assert op3_exact_topk(spark, tables).count() == 0
