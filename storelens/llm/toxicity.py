"""Toxicity: a linear classifier that is penalised where a swap of identity terms changes its score.

A text is the set of its lower-case words; a word has as features itself and its first 3 to 7 characters (so
unseen forms of a known stem count), hashed into 2**BITS places. The score is the logistic function of the sum of
the weights over the text's distinct words. Weights are learned on the driver from a bounded sample of
labelled documents: at most about `per_class` of each label, weighted back to the labels' true shares. In each
labelled sentence that names a group, the name is swapped for those of other groups, and the squared change
of the sentence's sum is part of the loss: group names by themselves carry no weight, and a neutral mention
is not toxic. Scoring covers all documents, and needs the weights only (1 MB).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[.!?\n]+")
BITS = 18
REMEMBERED = 200_000
#: Names of groups that are swapped for one another, by language. A parameter of `train`.
IDENTITY = {
    "en": ("women", "men", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "gay", "lesbian", "transgender", "black", "white", "asian", "disabled", "elderly"),
    "de": ("frauen", "männer", "muslime", "christen", "juden", "hindus", "einwanderer", "flüchtlinge", "schwule", "lesben", "behinderte", "senioren"),
    "fr": ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "hindous", "immigrés", "réfugiés", "homosexuels", "lesbiennes", "handicapés", "aînés"),
    "es": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "hindúes", "inmigrantes", "refugiados", "homosexuales", "lesbianas", "discapacitados", "ancianos"),
}


def features(word: str) -> tuple[int, ...]:
    """Places of a word's features: the word, then its beginnings."""
    keys = [word + "$", *(word[:k] for k in range(3, 8) if len(word) >= k)]
    return tuple(xxhash.xxh32_intdigest(k) >> (32 - BITS) for k in keys)


def words_of(text: str | None) -> set[str]:
    return {w.lower() for w in set(WORD.findall(text or ""))}


def swaps(text: str, groups: dict[str, tuple[str, ...]], most: int = 3) -> list[tuple[list[str], list[str]]]:
    """Pairs of words that a swap takes from a sentence and puts in, for `most` other names of the same list."""
    of = {g: names for names in groups.values() for g in names}
    out = []
    for sentence in SENTENCE.split(text):
        words = words_of(sentence)
        for g in sorted(words & of.keys()):
            names = of[g]
            k = names.index(g)
            for step in range(1, most + 1):
                new = names[(k + step * 5) % len(names)]
                if new not in words:
                    out.append(([g], [new]))
    return out


class Words:
    """Distinct words as rows of feature places."""

    def __init__(self, words: list[str]):
        self.count = np.array([1 + max(0, min(len(w), 7) - 2) for w in words], np.int64)
        self.place = np.fromiter((p for w in words for p in features(w)), np.int32, int(self.count.sum()))
        self.word = np.repeat(np.arange(len(words), dtype=np.int32), self.count)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, weights[self.place], len(self.count))

    def back(self, per_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, per_word[self.word], 1 << BITS)


def learn(doc: np.ndarray, word: np.ndarray, vocabulary: list[str], labels: np.ndarray, share: np.ndarray, pairs: list[tuple[list[str], list[str]]], lasso: float | None = None, ridge: float = 1e-5, swap_weight: float = 1.0, rounds: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by proximal Adam. doc and word: a text's place and a distinct word's place in the vocabulary, side by side; share weights the texts, pairs are swaps.

    lasso: by default it falls with the root of the number of texts, as the noise of a feature's weight does, to 1e-4.
    """
    lasso = max(1e-4, 7e-3 / math.sqrt(max(1, len(labels)))) if lasso is None else lasso
    n, place = len(labels), {w: k for k, w in enumerate(dict.fromkeys([*vocabulary, *(w for a, b in pairs for w in (*a, *b))]))}
    own = Words(list(place))
    pair = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    pair_word = np.fromiter((place[w] for a, b in pairs for w in (*a, *b)), np.int64, len(pair))
    pair_sign = np.fromiter((s for a, b in pairs for s in (1.0,) * len(a) + (-1.0,) * len(b)), float, len(pair))
    often = own.back(np.bincount(word, minlength=len(place)).astype(float)) >= 5
    w, b = np.zeros(1 << BITS), float(np.log((share * labels).sum() / max(1e-9, (share * (1 - labels)).sum())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = share / share.sum()
    for r in range(1, rounds + 1):
        per_word = own.sums(w)
        z = np.bincount(doc, per_word[word], n) + b
        miss = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        grad = own.back(np.bincount(word, miss[doc], len(place)))
        if len(pairs):
            change = np.bincount(pair, pair_sign * per_word[pair_word], len(pairs))
            grad += own.back(np.bincount(pair_word, 2 * swap_weight * pair_sign * change[pair] / len(pairs), len(place)))
        grad = (grad + ridge * w) * often
        m, v, mb, vb = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad, 0.9 * mb + 0.1 * miss.sum(), 0.999 * vb + 0.001 * miss.sum() ** 2
        scale = rate / (np.sqrt(v / (1 - 0.999**r)) + 1e-4)
        w = w - scale * m / (1 - 0.9**r)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * lasso)
        b -= rate * (mb / (1 - 0.9**r)) / (np.sqrt(vb / (1 - 0.999**r)) + 1e-4)
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, groups: dict[str, tuple[str, ...]] | None = None, label_col: str = "toxic", **options) -> tuple[np.ndarray, float]:
    """Weights and bias from about `per_class` labelled documents of each label, drawn by a hash of doc_id.

    Labels other than 0 and 1 are not used, nor are null ids or texts, nor ids that are labelled both 0 and 1; an id that is
    labelled more than once counts once. Of drawn ids that stand in several documents, some of these rows are used: in all
    4 * per_class rows at most reach the driver. If one label is missing, every score is the share of the other.
    """
    groups = IDENTITY if groups is None else groups
    known = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    count = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(count) < 2:
        total = sum(count.values())
        return np.zeros(1 << BITS), 20.0 * (1 if count.get(1) else -1) if total else -1.0
    grain = 1_000_000
    share = {y: min(grain, -(-per_class * grain // n)) for y, n in count.items()}
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(grain)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).limit(4 * per_class)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            pairs = [[f"{a[0]} {n[0]}" for a, n in swaps(t.lower(), groups)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(words_of(t)) for t in texts], pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.string()))], ["y", "words", "pairs"])

    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("y", "text")  # drawn: 4 * per_class rows at most
    found = texts.mapInArrow(read, "y int, words array<string>, pairs array<string>").limit(4 * per_class).toArrow()
    y = found.column("y").to_numpy().astype(float)
    held = {c: int((y == c).sum()) for c in (0, 1)}
    if not held[0] or not held[1]:  # labels of documents that aren't here
        return np.zeros(1 << BITS), 20.0 * (1 if held[1] else -1) if len(y) else -1.0
    weights = np.where(y == 1, count[1] / held[1], count[0] / held[0])
    pairs = [([a], [b]) for p in found.column("pairs").to_pylist() for a, b in map(str.split, p)]
    lists = found.column("words").combine_chunks()
    coded = lists.flatten().dictionary_encode()  # each word is held once
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(lists).to_numpy())
    return learn(doc, coded.indices.to_numpy(), coded.dictionary.to_pylist(), y, weights, pairs, **options)


def scorer(model: tuple[np.ndarray, float]):  # noqa: ANN201
    """Score of a text, with a bounded memory of words."""
    (weights, bias), known = model, {}
    weights = weights.astype(np.float64)

    def of(text: str | None) -> float:
        words = words_of(text)
        if new := [w for w in words if w not in known]:
            places = [features(w) for w in new]
            starts = np.cumsum([0, *(len(p) for p in places[:-1])])
            known.update(zip(new, np.add.reduceat(weights[np.fromiter((x for p in places for x in p), np.int64)], starts).tolist()))
        z = bias + sum(sorted(map(known.__getitem__, words)))
        if len(known) > REMEMBERED:
            known.clear()
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, z))))

    return of


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, score (0 to 1). Null and empty texts get the score of no words. Repeated rows and null ids stay."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def select(docs: DataFrame, model: tuple[np.ndarray, float], below: float, text_col: str = "text") -> DataFrame:
    """docs that score below a threshold; all columns stay, and no row is moved. Null and empty texts score as no words. Repeated rows all stay or go; an empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(held.value)
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < below for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
