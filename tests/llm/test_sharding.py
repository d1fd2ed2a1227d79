import zlib

from storelens.llm import sharding


def minimax(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, at = (lo + hi) // 2, 1, 0
        for x in sizes:
            if at + x > mid:
                n, at = n + 1, 0
            at += x
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def check(rows, got, shards):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    of, first = {}, {}
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        first.setdefault(t or "", i if i is not None else -1)
    sizes = {}
    for i, t in rows:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 16
    for r in got:
        of.setdefault(r.shard, []).append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in of.values())
    totals = {}
    for r in got:
        totals[r.shard] = totals.get(r.shard, 0) + r.size
    order = [sizes[t] for t in sorted(first, key=lambda t: (first[t], t))]
    assert max(totals.values()) == minimax(order, shards)


def test_whole_groups_and_least_capacity(make, odd):
    got = sharding.shard(make(odd), 5).collect()
    check(odd, got, 5)
    text = {i: t or "" for i, t in odd}
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert len({r.shard for r in got if r.doc_id in (6, 7)}) == 1


def test_zooming_is_exact(make, words):
    rows = [(k, " ".join(words(k * 7 % 40 + 1, k))) for k in range(400)] + [(1000 + k, "hot copy") for k in range(300)]
    df = make(rows)
    check(rows, sharding.shard(df, 7).collect(), 7)
    groups = sharding.shard(df, 7)
    assert groups.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    ends, total = [], 0
    for k in range(500):
        total += 16 + k * k % 97
        ends.append((total,))
    e = df.sparkSession.createDataFrame(ends, "end long")
    sizes = [b[0] - a for a, b in zip([0, *[x[0] for x in ends]], ends)]
    for grid in (4, 16, 1 << 15):
        cuts = sharding.minimax_cuts(e, 9, grid)
        assert cuts[-1] == total and max(b - a for a, b in zip([0, *cuts], cuts)) == minimax(sizes, 9)


def test_empty_and_fewer_groups_than_shards(make):
    assert sharding.shard(make([]), 4).count() == 0
    got = sharding.shard(make([(1, "a"), (2, "b")]), 4).collect()
    assert len({r.shard for r in got}) == 2
