"""The five stages as joined, each against a plain version of it on what the stage before kept."""

import base64
import hashlib
import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from storelens.llm import pii, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
PII = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


@pytest.fixture(scope="module")
def kept(spark):
    """The documents, and what each stage but the last keeps."""
    out = [spark.read.parquet(f"{SF}/documents.parquet").persist()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def grams(words, n=5):
    return [tuple(words[k : k + n]) for k in range(len(words) - n + 1)] or ([tuple(words)] if words else [])


def test_stages_keep_the_columns_and_no_row_twice(kept):
    for before, after in zip(kept, kept[1:]):
        assert after.columns == kept[0].columns and 0 < after.count() <= before.count()
        assert after.groupBy("doc_id").count().where("count > 1").isEmpty()


def test_toxicity(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    weights, bias = toxicity.train(kept[0], labels.where(~queries.held_out(labels.doc_id)))
    want = set()
    for i, t in texts(kept[0]).items():
        z = bias + sum(weights[p] for w in {w.lower() for w in re.findall(r"\w+", t)} for p in toxicity.features(w))
        if 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))) < 0.3:
            want.add(i)
    assert set(texts(kept[1])) == want
    said = {r.doc_id: r.toxic for r in labels.collect()}
    assert sum(said.get(i) == 0 for i in want) >= 0.9 * sum(said.get(i) == 0 for i in texts(kept[0]))


def test_near_copies(kept):
    docs = sorted(texts(kept[1]).items())
    sets = [set(grams(t.encode().lower().split())) for _, t in docs]
    linked = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = simhash.forest(len(docs), *(np.array(x, int) for x in zip(*linked))) if linked else range(len(docs))
    assert set(texts(kept[2])) == {docs[k][0] for k in set(map(int, root))}


def test_benchmark(spark, kept):
    items = [re.findall(r"\w+", (r.text or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for i, t in texts(kept[2]).items():
        words = re.findall(r"\w+", t.lower())
        own = set(grams(words))
        for item in items:
            bag = Counter(grams(item))
            if not own & set(bag):
                continue
            for s in range(max(1, len(words) - len(item) + 1)):
                window = Counter(grams(words[s : s + len(item)]))
                same = sum((bag & window).values())
                if same >= 0.8 * (sum(bag.values()) + sum(window.values()) - same):
                    want.add(i)
    assert set(texts(kept[3])) == set(texts(kept[2])) - want


def test_personal_data(kept):
    before, after = texts(kept[3]), texts(kept[4])
    spans, found = {}, {}
    for i, t in before.items():
        spans[i] = [(k, m.start(), m.end()) for k, (p, ok) in enumerate(PII) for m in p.finditer(t) if ok(m[0])]
        words = [m for m in re.finditer(r"\w{3,}", t) if not any(a < m.end() and m.start() < b for _, a, b in spans[i])]
        found[i] = ({pii.entity(k, t[a:b]) for k, a, b in spans[i]}, words)
    n, c_e, c_t, c_et = len(before), Counter(), Counter(), Counter()
    for i, (es, words) in found.items():
        c_t.update({w.lower() for w in re.findall(r"\w+", before[i])})
        c_e.update(es)
        c_et.update((e, w) for e in es for w in {m[0].lower() for m in words})
    told = {w for (e, w), c in c_et.items() if c >= 3 and math.log2(n * c / (c_t[w] * c_e[e])) >= 0.9 * math.log2(n / c_e[e])}
    for i, t in before.items():
        own = spans[i] + [(4, m.start(), m.end()) for m in found[i][1] if m[0].lower() in told]
        assert after[i] == pii.masked(t, own)
    assert set(after) == set(before) and any(spans.values())
    assert {r.doc_id: r.n_chars for r in kept[4].collect()} == {i: len(t) for i, t in after.items()}


def test_tokens(spark, kept):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in texts(kept[4]).items():
        ids = np.array(reference.encode_ordinary(t), "<u4").tobytes()
        want[i] = len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), ids
    out = corpus_pipeline.STAGES[-1][1](spark, kept[4], SF)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in out.collect()} == want


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
