import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from storelens.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_counts(rows, each=97):
    found = Counter()
    for d, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in text or "")
        for run in low.split(" "):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if run and each and h % each == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in counts}
    form = {w: min(vs, key=lambda v: (-counts[v], v.encode())) if vs else None for w, vs in near.items()}
    form = {w: f if f and counts[f] >= 2 * counts[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def near_words(rng, n, letters="abcdé"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(n)]
    for w in base[: n // 2]:
        k = rng.randrange(len(w))
        base.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]]))
    return sorted({w for w in base if len(w) >= 5})


def test_texts_against_brute_force(spark, make, odd):
    rng = random.Random(3)
    words = near_words(rng, 120)
    rows = [(k, " ".join(rng.choices(words, weights=[1 + j % 17 for j in range(len(words))], k=60)).upper() if k % 5 == 0 else ", ".join(rng.choices(words, k=60))) for k in range(60)] + odd
    assert got(spelling.group(make(rows), spoil_each=97)) == brute_variants(brute_counts(rows))
    assert got(spelling.group(make(rows))) == brute_variants(brute_counts(rows, None))


def test_crowded_chunks_lose_no_link(spark):
    rng = random.Random(4)
    words = {"x" * 12 + w for w in near_words(rng, 60)} | {w + "yy" * 8 for w in near_words(rng, 60)} | {"aaaaa", "aaaaaa", "aaaaaaa", "a" * 40, "a" * 41}
    words = {w: rng.randint(3, 40) for w in words}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    for most in (1, 10**6):
        assert got(spelling.variants(df, most=most)) == brute_variants(words)


def test_every_pair_is_given_once(spark):
    words = near_words(random.Random(8), 200, "ab")
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near(df, 50).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs}) and {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chains_of_forms_end_at_their_root(spark):
    words = {"aaaaa"[:k] + "bbbbb"[k:]: 3 * 2**k for k in range(6)}
    out = got(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in out.values()} == {"aaaaa"} and out["aaaaa"][0] is None and out["bbbbb"][0] == "abbbb"


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Alpha beta-gamma  DELTA epsilon" * 9
    assert spelling.runs(text) == Counter(m.lower() for m in spelling.RUN.findall(text))


def test_counts_are_passed_on_when_many_are_held(spark, make, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    df = make([(k, "alpha bravo charlie delta echos") for k in range(5)])
    assert {(r.word, r.n) for r in spelling.words(df).collect()} == {(w, 5) for w in "alpha bravo charlie delta echos".split()}


def test_no_words(spark, make):
    assert spelling.group(make([])).collect() == [] and spelling.group(make([(1, None), (2, "ab cd")])).collect() == []
    assert spelling.group(make([(1, None)])).select(F.col("root")).columns == ["root"]
