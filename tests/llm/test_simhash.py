import random

import numpy as np
import xxhash

from storelens.llm import simhash


def brute_print(text):
    data = (text or "").encode().lower().split()
    grams = [b" ".join(data[k : k + 3]) for k in range(len(data) - 2)] or ([b" ".join(data)] if data else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute_groups(prints, radius):
    n, root = len(prints), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_whole_table_against_brute_force(make, odd):
    rows = [r for r in odd if r[0] != 8]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(make(rows)).collect()}
    prints = [brute_print(t) for _, t in rows]
    groups = brute_groups(prints, 2)
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[k] and rows[j][0] is not None]
        assert got[i, f"{prints[k]:016x}"] == min(ids, default=None)
    assert got[1, "0" * 16] == got[2, "0" * 16] == got[3, "0" * 16] == 1


def test_long_texts_by_chunks(words, monkeypatch):
    text = " ".join(words(3000, 3))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def chained(rng, n):
    """Random fingerprints, and chains and crowds of near ones."""
    out = {rng.getrandbits(64) for _ in range(n)}
    for x in list(out)[:20]:
        for _ in range(30):
            x ^= 1 << rng.randrange(64)
            out.add(x)
    base = rng.getrandbits(64)
    out |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    return sorted(out)


def test_links_and_components_lose_nothing_at_any_node_limit(spark):
    prints = chained(random.Random(1), 200)
    want = brute_groups(prints, 2)
    df = spark.createDataFrame([(simhash.signed(x),) for x in prints], "fp long")
    for limit in (4, 1024):
        got = dict(map(tuple, simhash.components(simhash.links(df, 2, limit)).collect()))
        label = [got.get(simhash.signed(x), simhash.signed(x)) for x in prints]
        assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(prints)) for j in range(i))


def test_near_pairs_are_all_pairs():
    prints = np.array(chained(random.Random(2), 100), np.uint64)
    for radius in (0, 2, 9):
        own, i, j = simhash.near_pairs(prints, radius)
        got = {frozenset((int(own[a]), int(own[b]))) for a, b in zip(i, j)}
        assert got == {frozenset((int(a), int(b))) for k, a in enumerate(prints) for b in prints[:k] if int(a ^ b).bit_count() <= radius}
    assert list(simhash.gray_rank(np.array([0, 1, 3, 2, 6], np.uint64))) == [0, 1, 2, 3, 4]


def test_a_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001)], "a long, b long")
    assert {r.c for r in simhash.components(edges).collect()} == {0, 1000}


def test_one_of_each_group_of_similar_texts_stays(make, words, odd):
    rows = [(100 + k, " ".join(words(120, 50 * k))) for k in range(40)]
    for k in range(40):
        w = words(120, 50 * k)
        w[60] = "changed"  # one changed word keeps 0.8, ten do not
        rows.append((300 + k, " ".join(w)))
    for k in range(5):
        w = words(120, 50 * k)
        for at in range(0, 120, 12):
            w[at] = f"other{at}"
        rows.append((400 + k, " ".join(w)))
    kept = simhash.keep_one(make(rows + odd))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns[:4] == ["doc_id", "text", "source", "n_chars"] and "lang" in kept.columns
    assert {i for i in ids if i and i >= 100} == {100 + k for k in range(40)} | {400 + k for k in range(5)}
    assert sorted(i for i in ids if i is not None and i < 100) == [1, 4, 5, 6, 8, 9, 10, 11] and ids.count(None) == 1


def alike(x, y):
    x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
    return len(x & y) / len(x | y)


def with_others(base, at, tag):
    return [f"{tag}{k}" if k in at else w for k, w in enumerate(base)]


def test_links_at_the_threshold_are_found_at_any_number_of_rows(make):
    """Pairs just over 0.8 among many texts of one template: of pairs looked up by fingerprint bits some were lost, and more in larger tables."""
    rng = random.Random(4)
    for n in (200, 1000):
        rows, want = [], set()
        template = [f"t{k}" for k in range(100)]
        for k in range(n):
            own = [f"w{k}_{j}" for j in range(100)]
            a = template + own
            b = with_others(a, set(rng.sample(range(105, 195), 4)), f"o{k}_")
            rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
            want |= {2 * k} | (set() if alike(a, b) >= 0.8 else {2 * k + 1})
        assert {r.doc_id for r in simhash.keep_one(make(rows)).collect()} == want


def test_bridges_between_groups_are_found(make):
    """Two groups whose members are nearest in their own group, with one link between the groups, that no pivot makes."""
    rows, base = [], [f"w{k}" for k in range(400)]
    far = with_others(base, range(0, 45), "y")  # 0.79 or less to base, over 0.8 between the nearest of both groups
    for k in range(30):
        rows.append((k, " ".join(with_others(base, {60 + 11 * k}, "a"))))
        rows.append((100 + k, " ".join(with_others(far, {60 + 11 * k}, "b"))))
    bridge = " ".join(with_others(base, range(0, 22), "y"))
    rows.append((50, bridge))
    texts = [t.split() for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    root = simhash.forest(len(rows), *(np.array(x) for x in zip(*linked)))
    want = {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    for block, pivots in ((512, 2), (4, 0)):
        assert {r.doc_id for r in simhash.keep_one(make(rows), block=block, pivots=pivots).collect()} == want


def test_rows_with_null_or_shared_ids_are_told_apart(make, words):
    five = [" ".join(words(40, 10 * k)) for k in range(5)]
    rows = list(zip([None, None, 5, 5, 6], five))
    assert sorted(r.text for r in simhash.keep_one(make(rows)).collect()) == sorted(five)
    kept = simhash.keep_one(make([*rows, (None, five[4]), (4, five[2]), (5, five[3])]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, five[0]), (0, five[1]), (4, five[2]), (5, five[3]), (6, five[4])])
    assert kept.columns == make(rows).columns and {r["__digest"] for r in kept.collect()} == {"x"}


def test_all_links_at_the_threshold_are_found_in_random_texts(make, words):
    """Texts of all similarities, in two sizes of table, against all pairs: recall is 1."""
    for n in (60, 240):
        rng, rows = random.Random(n), []
        for k in range(n):
            w = words(80, 100 * (k % (n // 4)))
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(80)] = f"x{rng.randrange(40)}"
            rows.append((k, " ".join(w)))
        split = [t.split() for _, t in rows]
        linked = [(i, j) for i in range(n) for j in range(i) if alike(split[i], split[j]) >= 0.8]
        root = simhash.forest(n, *(np.array(x) for x in zip(*linked)))
        got = {r.doc_id: r.group for r in simhash.similar_texts(make(rows)).collect()}
        assert len(linked) > n // 4 and got == {k: int(root[k]) for k in range(n)}


def test_copies_with_few_changes_are_found_by_fingerprint(spark, make, words):
    """The pairs that the index hands on: each text with the least of its fingerprint, and linked fingerprints; the groups are the same at any radius."""
    rows = []
    for k in range(30):
        w = words(1500, 40 * k)
        rows.append((k, " ".join(w)))
        rows.append((100 + k, " ".join(with_others(w, {700}, f"z{k}_"))))
    prints = {i: simhash.majority(simhash.shingle_hashes(t, 5)) for i, t in rows}
    for i, t in rows[:3]:
        own = [xxhash.xxh64_intdigest(" ".join(g).encode()) for g in {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}]
        assert prints[i] == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in own) * 2 > len(own))
    marks = spark.createDataFrame([(i, simhash.signed(fp)) for i, fp in prints.items()], "id long, fp long")
    got = {tuple(r) for r in simhash.by_fingerprint(marks).collect()}
    near = {k for k in range(30) if (prints[k] ^ prints[100 + k]).bit_count() <= 2}
    assert near and got == {(k, 100 + k) for k in near}
    assert simhash.majority(np.zeros(0, np.uint64)) == 0
    for radius in (0, 2):
        assert {r.doc_id for r in simhash.keep_one(make(rows), radius=radius).collect()} == set(range(30))


def test_pairs_of_long_unlike_texts_are_proven_apart_and_no_pair_is_written_for_each_bucket():
    sets = [np.unique(np.array([xxhash.xxh64_intdigest(f"{k}:{j}" if j > 300 else f"{j}") for j in range(n)], np.uint64)) for k, n in enumerate((3000, 2900, 4200, 3600, 300, 310))]
    maps, n = [simhash.parity(s) for s in sets], np.array(list(map(len, sets)))
    assert [len(m) for m in maps] == [512, 512, 1024, 512, 64, 64]
    for a in range(6):
        for b in range(6):
            apart = len(np.setxor1d(sets[a], sets[b]))
            least = int(simhash.differing([maps[a]], [maps[b]])[0])
            assert least <= apart and (a == b) == (least == 0)
            short = [simhash.np.packbits(np.bincount((s % np.uint64(512)).astype(np.int64), minlength=512).astype(np.uint8) & 1) for s in (sets[a], sets[b])]
            assert (simhash.folded([maps[a]], 64).view(np.uint8)[0] == short[0]).all()  # as 512 bits would have it
            if {a, b} in ({0, 1}, {2, 3}):
                assert not simhash.may_link(n[a], n[b], least, 0.8) and simhash.may_link(n[a], n[b], np.bitwise_count(short[0] ^ short[1]).sum(), 0.8)

    def pairs(earlier):
        return [list(zip(*map(np.ndarray.tolist, simhash.cross_pairs(np.arange(6), np.arange(6), n, maps, np.zeros(6, int), list(map(frozenset, earlier)), False, 0.8))))]

    assert pairs([[]] * 6) == [[(4, 5)]] and pairs([[1], [1], [1], [1], [7], [8]]) == [[(4, 5)]]
    assert pairs([[], [], [], [], [7, 8], [8, 9]]) == [[]]  # they were in bucket 8 together


def test_shingles_of_the_same_texts_make_one_bucket_and_no_link_is_lost(make, monkeypatch):
    """Texts of 450 to 1300 words around 0.8, with maps of different lengths, against all pairs, however many earlier buckets they carry."""
    rng, rows = random.Random(9), []
    for g, size in enumerate((450, 530, 1000, 1300)):
        base = [f"g{g}w{k}" for k in range(size)]
        for k in range(10):
            text = with_others(base, set(rng.sample(range(size), size // 100 + k % 3)), f"o{g}_{k}_")
            rows.append((10 * g + k, " ".join(text[: size - rng.randrange(size // 12)])))
    split = [t.split() for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if alike(split[i], split[j]) >= 0.8]
    root = simhash.forest(len(rows), *(np.array(x) for x in zip(*linked)))
    real, seen = simhash.keep, {}

    def keep(df, name="step"):
        seen.setdefault(name, []).append((out := real(df, name)).count())
        return out

    monkeypatch.setattr(simhash, "keep", keep)
    for earlier, pivots in ((64, 2), (1, 0)):
        monkeypatch.setattr(simhash, "EARLIER", earlier)
        seen.clear()
        got = {r.doc_id: r.group for r in simhash.similar_texts(make(rows), pivots=pivots).collect()}
        assert got == {k: int(root[k]) for k in range(len(rows))} and len(set(got.values())) > 4
        assert 4 * seen["open"][0] < sum(len(simhash.prefix(simhash.shingle_hashes(t, 5), np.zeros(1 << simhash.PLACES, np.uint8), 0.8)) for _, t in rows)


def test_empty(make):
    assert simhash.near_duplicates(make([])).count() == 0
    assert simhash.keep_one(make([])).count() == 0
