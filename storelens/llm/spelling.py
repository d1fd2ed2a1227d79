"""Spelling variants: words of a corpus one edit apart, by asymmetric chunks, and the form that each should take.

Of two words one edit apart the shorter (or, of one length, the first) contributes two disjoint chunks, its halves;
one edit leaves one of them whole. The other contributes positional grams: a chunk before the edit keeps its
place in the other word, and one behind it moves by the difference of the lengths, which is 0 or 1; so grams are joined
with chunks within a shift of one, and only those grams are written out that stand where a chunk can be. What joins is
verified as one edit.

A chunk that very many words share is not joined: within it the other half, where the edit must be, is halved
again, so that the words of such a chunk are dealt by three quarters of their letters, then seven eighths, and
so on until few enough remain together, or all letters but one. No link is lost by that.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Runs of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: What a task holds of counts, in words and in letters, before it passes them on.
HELD, HELD_LETTERS = 300_000, 8_000_000
#: Letters of a text that are looked at together.
PIECE = 1 << 20
#: Comparisons that one chunk may cost before it is taken apart.
MOST = 1_000_000


def runs(text: str) -> Counter:
    """How often each run stands in a text, in lower case (A-Z only)."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and RUN.match(text, end):  # not within a run
            end = RUN.match(text, end).end()
        found.update(RUN.findall(text, at, end))
        at = end
    out: Counter = Counter()
    for run, n in found.items():
        out[run.translate(LOWER)] += n
    return out


def spoilt(doc_id: str | None, run: str, each: int | None) -> str:
    """The run; where the CRC-32 of document and run is a multiple of `each`, without one of its letters."""
    if each:
        h = zlib.crc32(f"{doc_id or ''}:{run}".encode("utf-8", "replace"))
        if h % each == 0:
            return run[: h % len(run)] + run[h % len(run) + 1 :]
    return run


def words(docs: DataFrame, least_length: int = 5, least_times: int = 3, spoil_each: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> word, n: words of at least so many letters that stand at least so often in all texts. `spoil_each` plants misspellings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for found, n in runs(text.as_py() or "").items():
                    word = spoilt(doc_id, found, spoil_each)
                    if len(word) >= least_length:
                        if word not in held:
                            letters += len(word)
                        held[word] += n
                if len(held) > HELD or letters > HELD_LETTERS:
                    yield out()
                    held.clear()
                    letters = 0
        yield out()

    counts = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times)


def halved(rows: DataFrame) -> DataFrame:
    """Rows with `low` and `high`, the part of the chunked word where the edit is, become one for each half of that part."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
    return rows.select("word", "n", "of", F.explode(parts).alias("part")).select("word", "n", "of", "part.low", "part.high")


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with `key`: what stands before the part and behind it, in a word that is as long as the chunked one (`of`) or longer by one."""
    behind = F.col("of") - F.col("high")
    outside = (F.substring("word", F.lit(1), F.col("low")), F.substring("word", F.length("word") - behind + 1, behind))
    return rows.withColumn("key", F.xxhash64("of", "low", "high", *outside))


def near(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n -> a, a_n, b, b_n: each pair of words that differ by one letter put in, left out or replaced, once."""
    n = F.length("word")
    whole = lambda of: [of.alias("of"), F.lit(0).alias("low"), of.alias("high")]
    chunks = words.select("word", "n", *whole(n))
    grams = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("of")).select("word", "n", *whole(F.col("of")))
    found = None
    while True:
        chunks, grams = keep(keyed(halved(chunks)), "chunks"), keep(keyed(halved(grams)), "grams")
        theirs = grams.groupBy("key").agg(F.count("*").alias("y"))
        sizes = chunks.groupBy("key").agg(F.count("*").alias("x"), F.max(F.col("high") - F.col("low")).alias("width")).join(theirs, "key")
        crowded = keep(sizes.where((F.col("x") * F.col("y") > most) & (F.col("width") > 1)).select("key"), "crowded")
        again = crowded.count()
        left, right = (df.join(crowded, "key", "left_anti") if again else df for df in (chunks, grams))
        left, right = left.withColumnsRenamed({"word": "a", "n": "a_n"}).select("key", "a", "a_n"), right.withColumnsRenamed({"word": "b", "n": "b_n"}).select("key", "b", "b_n")
        in_turn = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
        pairs = left.join(right, (left.key == right.key) & in_turn & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.union(pairs)
        if not again:
            return found.distinct()
        chunks, grams = (df.join(crowded, "key", "left_semi").drop("key") for df in (chunks, grams))


def rooted(forms: DataFrame) -> DataFrame:
    """word, form -> with `root`: where the forms lead. A form is commoner than its word, so they end; each round looks twice as far ahead."""
    out = forms.withColumn("root", F.coalesce("form", "word"))
    while True:
        out = keep(out, "roots")
        ahead = out.where("root <> word").select(F.col("word").alias("w"), F.col("root").alias("r"))
        moved = out.join(ahead, F.col("root") == F.col("w"), "left")
        if moved.where("r IS NOT NULL").isEmpty():
            return out
        out = moved.withColumn("root", F.coalesce("r", "root")).drop("w", "r")


def variants(words: DataFrame, times: int = 2, most: int = MOST) -> DataFrame:
    """word, n -> word, n, form, form_n, n_near, root.

    `form` is the commonest of a word's near words (ties: the first in code-point order), if it stands at least
    `times` as often as the word; else null. `root` follows the forms to the last. No words: no rows.
    """
    words = keep(words.select("word", "n"), "words")
    pairs = keep(near(words, most), "near")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("other"), F.col("b_n").alias("m")).union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("w").agg(F.count("*").alias("near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    out = words.join(best, F.col("word") == F.col("w"), "left")
    top: Column = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best"))
    return rooted(out.select("word", "n", top["other"].alias("form"), (-top["less"]).alias("form_n"), F.coalesce("near", F.lit(0)).cast("long").alias("n_near")))


def group(docs: DataFrame, least_length: int = 5, least_times: int = 3, spoil_each: int | None = None, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> word, n, form, form_n, n_near, root of the words of all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. Null and empty texts have
    none, a null id counts as an empty one, repeated rows count each, an empty table gives no rows. Other columns are not looked at.
    """
    return variants(words(docs, least_length, least_times, spoil_each, id_col, text_col), times)
