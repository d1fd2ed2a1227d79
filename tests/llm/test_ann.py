import numpy as np

from storelens.llm import ann


def brute(rows, k=5):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    ids = np.array(sorted(fine))
    m = np.stack([fine[i] for i in ids])
    norm = np.sqrt((m * m).sum(axis=1))
    out = {}
    for q in ids[ids % 50 == 0]:
        s = (m * fine[q]).sum(axis=1) / (norm * np.sqrt((fine[q] ** 2).sum()))
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), **options).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [v[k] for k in sorted(v)] for q, v in got.items()}, got


def test_odd_vectors_ties_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] + [0.0] * 15) for i in range(300)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [float("inf")] + [1.0] * 15), (2200, [None] + [1.0] * 15), (2250, [1.0, 2.0]), (None, [1.0] * 16), (1000, [1.0] + [0.0] * 15)]
    got, by_rank = run(spark, rows)
    want = brute(rows)
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in by_rank.values())
    for q in want:
        assert [x for x, _ in got[q]] == [x for x, _ in want[q]] and np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert [x for x, _ in got[1000]] == [1001, 1002, 1003, 1004, 1005]


def test_recall_through_the_graph_and_chunks(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got, _ = run(spark, rows, list_size=16, list_limit=10, sample=1500)
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    want = brute(rows)
    hit = sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 5 * len(want)


def test_graph_search_finds_most_nearest(spark):
    rng = np.random.default_rng(4)
    graph = ann.Graph(ann.unit(rng.normal(size=(900, 8))))
    x = ann.unit(rng.normal(size=(200, 8)))
    lists, dist = graph.search(x, 8)
    assert (lists[:, 0] == (x @ graph.centres.T).argmax(axis=1)).mean() >= 0.9 and (np.diff(dist, axis=1) >= -1e-12).all()


def test_few_and_no_vectors(spark):
    assert run(spark, [])[0] == {}
    assert run(spark, [(0, [1.0, 0.0])])[0] == {}
    assert [x for x, _ in run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])[0][0]] == [2, 1]


def test_very_small_and_very_large_vectors_take_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=16) * 10.0 ** [0, -200, 200, -300][i % 4]).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    m = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    for q in range(0, 200, 50):
        sims = m @ m[q]
        want = [j for j in np.argsort(-sims) if j != q][:5]
        assert [got[q][k][0] for k in range(1, 6)] == want and np.allclose([got[q][k][1] for k in range(1, 6)], sims[want], atol=1e-12)


def test_one_hot_list_of_queries_is_dealt_in_lots(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    rows = [(50 * i, (base + 0.01 * rng.normal(size=16)).tolist()) for i in range(600)] + [(50 * i + 1, rng.normal(size=16).tolist()) for i in range(300)]
    plain, _ = run(spark, rows)
    dealt, _ = run(spark, rows, asked_limit=40, list_limit=50)
    assert len(plain) == 600 and np.mean([plain[q] == dealt[q] for q in plain]) > 0.98


def test_mixed_lengths_on_both_sides(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=3 if i % 50 == 0 or i < 30 else 4).tolist()) for i in range(200)]
    assert run(spark, rows)[0] == {}  # all queries are of the rarer length
    rows = [(i, rng.normal(size=16 if i % 3 else 5).tolist()) for i in range(600)]
    got, _ = run(spark, rows)
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    want = brute(rows)
    assert set(got) == set(want) and all([x for x, _ in got[q]] == [x for x, _ in want[q]] for q in want)
