"""Substring dedup by units: lines or paragraphs, and the same text reflowed.

Units are normalised (the sequence of their lower-case words) and named by 96 bits of digest. Digests are grouped
over all documents; the earliest occurrence by (doc_id, text, place) stays, the rest are marked. A repeated passage
seldom fills whole lines, so besides its own lines a text is reflowed, as a further normalisation: a reflowed line
is LINE words from a word that is chosen by content (the least digest of SPAN neighbouring starts), wherever the text
breaks its lines. Equal stretches are reflowed alike, so that each of LINE + SPAN - 1 words or more holds an
equal reflowed line, and marked lines of one stretch touch.

Marked lines that touch, and that touch in the same earlier text too, are a run. A run is extended word by word at
both ends against that earlier text, at most REACH words (a longer stretch holds further lines), and counts from
`least_words` words on; a whole line of its own counts from `line_words` on. What counts is removed, in code points
of the original text.

A run that stays shorter than `least_words` has an earliest text that holds only part of a passage, while another
earlier text may hold more of it. Its lines are open: of every text that has them, each stretch of `least_words` words
around such a line is named in turn, and grouped as the lines were. So a passage put together from several earlier
ones, each of which some text before has in part, is found against the text that has it whole.

A text is held against itself where it is read: lines that stood before in the same text are compared with their last
place there, extended and done with, so only lines new to their text are grouped. Texts are not moved to be compared
with others: units carry digests and places. Only the words around the ends of runs are looked up, in one join of
the documents with those requests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, keep, perhaps_in

WORD = re.compile(r"\w+")
UNITS = {
    "line": re.compile(r"[^\n]+"),
    "paragraph": re.compile(r"[^\n]+(?:\n[^\n]+)*"),
}
LINE = SPAN = 25
REACH = 50
REMEMBERED = 200_000
#: Odd numbers, one for each part of a digest.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WHOLE_LINE = np.uint64(0x165667B19E3779F9)


class Hashes(dict):
    """64-bit hash of a word in lower case; forgets all when it has grown large."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word.lower())
        return value

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64, for k from 0 to n - 1."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(max(1, n), b, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(BASES[0])
    return x ^ (x >> np.uint64(32))


class Digester:
    """Digests of the word sequences from place a to b of a text, from prefix sums of its word hashes."""

    def __init__(self) -> None:
        self.hashes, self.powers = Hashes(), [powers(b, 4096) for b in BASES]

    def read(self, words: list[str]) -> None:
        own = self.words = self.hashes.of(words)
        if len(own) > len(self.powers[0][0]):
            self.powers = [powers(b, 2 * len(own)) for b in BASES]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(own * up[: len(own)])]) for up, _ in self.powers]

    def digest(self, part: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[part][b] - self.sums[part][a]) * self.powers[part][1][a] + (b - a).astype(np.uint64))


def chosen(digests: np.ndarray, span: int) -> np.ndarray:
    """Places of the least digest of each `span` neighbours (of all, if they are fewer), the first of equal ones."""
    if len(digests) <= span:
        return np.array([digests.argmin()] if len(digests) else [], np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(digests, span).argmin(axis=1) + np.arange(len(digests) - span + 1))


def agree(p: np.ndarray, q: np.ndarray, block: int = 256) -> int:
    """The number of first elements that are equal in both."""
    n, at = min(len(p), len(q)), 0
    while at < n:
        differ = np.flatnonzero(p[at : min(n, at + block)] != q[at : min(n, at + block)])
        if len(differ):
            return at + int(differ[0])
        at += block
    return n


def seen_before(h: np.ndarray) -> np.ndarray:
    """For each element the last place before it with the same value, or -1."""
    order, out = np.argsort(h, kind="stable"), np.full(len(h), -1)
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    out[order[same + 1]] = order[same]
    return out


def own_repeats(words: np.ndarray, places: np.ndarray, before: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of words (first, last + 1, first of the earlier place) that hold the lines of n words at `places`, which stood at `before`."""
    last = None
    for off, place in sorted(zip((places - before).tolist(), places.tolist())):
        if last and off == last[0] and place <= last[2]:
            last[2] = max(last[2], place + n)
            continue
        if last:
            yield last[1], last[2], last[1] - last[0]
        low, high = place - agree(words[:place][::-1], words[: place - off][::-1]), place + agree(words[place:], words[place - off :])
        last = [off, low, high]
    if last:
        yield last[1], last[2], last[1] - last[0]


def named(text: str) -> int:
    """xxhash64 of a text, unsigned."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42)


def signed_name(text: str) -> int:
    """xxhash64 of a text, as Spark has it."""
    return (named(text) + (1 << 63)) % (1 << 64) - (1 << 63)


#: Kinds of units: reflowed lines, whole lines, and stretches that stood before in their own text (done with).
REFLOWED, WHOLE, OWN = range(3)


def units(docs: DataFrame, unit: str, least_words: int, line_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t (hash of the text), place (first word), n (words), kind, h, g (digest; of kind OWN: start and end, and start of the earlier place, in code points)."""
    of_kind = UNITS[unit]

    def of(own: Digester, text: str) -> list[tuple[np.ndarray, np.ndarray, int, np.ndarray, np.ndarray]]:
        words, edges = [], [0]
        for m in of_kind.finditer(text):
            words += WORD.findall(text, m.start(), m.end())
            edges.append(len(words))
        if not words:
            return []
        own.read(words)
        edge = np.array(edges)
        long = np.flatnonzero(np.diff(edge) >= line_words)
        starts = np.arange(max(0, len(words) - LINE + 1))
        reflowed = own.digest(0, starts, starts + LINE)
        at = chosen(reflowed, SPAN)
        out, spans = [], set()
        for kind, a, b, h in ((WHOLE, edge[long], edge[long + 1], own.digest(0, edge[long], edge[long + 1]) ^ WHOLE_LINE), (REFLOWED, at, at + LINE, reflowed[at])):
            before = seen_before(h)
            new, old = np.flatnonzero(before < 0), np.flatnonzero(before >= 0)
            if len(new):
                out.append((a[new], (b - a)[new], kind, h[new], own.digest(1, a[new], b[new]) >> np.uint64(32)))
            if kind == WHOLE:
                spans |= set(zip(a[old].tolist(), b[old].tolist(), a[before[old]].tolist()))
            elif len(old):
                spans |= {s for s in own_repeats(own.words, a[old], a[before[old]], LINE) if s[1] - s[0] >= least_words}
        if spans:
            found = list(WORD.finditer(text))
            low, high, first = np.array(sorted(spans)).T
            start, end, earlier = (np.array(x, np.uint64) for x in ([found[k].start() for k in low], [found[k - 1].end() for k in high], [found[k].start() for k in first]))
            out.append((low, high - low, OWN, start << np.uint64(32) | end, earlier))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Digester()
        for b in batches:
            rows, ts, columns = [], [], []
            for k, x in enumerate(b.column(1)):
                text = x.as_py() or ""
                for place, n, kind, h, g in of(own, text):
                    rows.append(np.full(len(place), k))
                    ts.append(np.full(len(place), named(text), np.uint64))
                    columns.append((place, n, np.full(len(place), kind), h, g))
            if rows:
                ids = b.column(0).take(pa.array(np.concatenate(rows)))
                place, n, kind, h, g = map(np.concatenate, zip(*columns))
                made = [ids, pa.array(np.concatenate(ts).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (place, n, kind)), pa.array(h.view(np.int64)), pa.array(g.astype(np.uint32).view(np.int32))]
                yield pa.RecordBatch.from_arrays(made, ["doc_id", "t", "place", "n", "kind", "h", "g"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, t long, place int, n int, kind int, h long, g int")


def around(asked: DataFrame) -> DataFrame:
    """doc_id, t, text, asks (array of at, side) -> doc_id, t, at, side, words, offs.

    Side 1: hashes of the words from place `at` on, and the ends of these and (first) of the word before. Side -1: the
    same backwards from the word before `at`, with starts. Side 0: the first start, the last end, the number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            out: list[tuple] = []
            for d, t, text, asks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                found = list(WORD.finditer(text.as_py()))
                starts, ends = np.array([m.start() for m in found], np.int32), np.array([m.end() for m in found], np.int32)
                own = hashes.of([m.group() for m in found]).astype(np.uint32).view(np.int32)
                for ask in asks.as_py():
                    at, side = ask["at"], ask["side"]
                    if side > 0:
                        words, offs = own[at : at + REACH], ends[at - 1 : at + REACH]
                    elif side < 0:
                        low = max(0, at - REACH)
                        words, offs = own[low:at][::-1], starts[low : at + 1][::-1]
                    else:
                        words, offs = own[:0], [starts[0], ends[-1], len(own)]
                    out.append((d, t, at, side, words, offs))
            columns = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], ["doc_id", "t", "at", "side", "words", "offs"])

    return asked.mapInArrow(run, "doc_id long, t long, at int, side int, words array<int>, offs array<int>")


def stretches(asked: DataFrame, least_words: int) -> DataFrame:
    """doc_id, t, text, places (first words of open lines) -> doc_id, t, low, start, end, h, g: all stretches of `least_words` words that hold an open line, with their digests and code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Digester()
        for b in batches:
            for k in range(b.num_rows):
                found = list(WORD.finditer(b.column(2)[k].as_py()))
                own.read([m.group() for m in found])
                around_ = {a for p in b.column(3)[k].as_py() for a in range(max(0, p + LINE - least_words), min(p, len(found) - least_words) + 1)}
                low = np.array(sorted(around_), np.int64)
                if len(low):
                    h, g = own.digest(0, low, low + least_words), own.digest(1, low, low + least_words) >> np.uint64(32)
                    ids = [b.column(c).take(pa.array(np.full(len(low), k))) for c in (0, 1)]
                    ends = (low, [found[a].start() for a in low], [found[a + least_words - 1].end() for a in low], g.astype(np.uint32).view(np.int32))
                    low_, start, end, g = (pa.array(x, pa.int32()) for x in ends)
                    yield pa.RecordBatch.from_arrays([*ids, low_, start, end, pa.array(h.view(np.int64)), g], ["doc_id", "t", "low", "start", "end", "h", "g"])

    return asked.mapInArrow(run, "doc_id long, t long, low int, start int, end int, h long, g int")


def removed(parts: list[dict], least_words: int) -> Iterator[tuple[int, int, int, int | None, int]]:
    """start, end, words, first_doc_id, first_start of what goes of one text, from both ends of its runs and its own repeats."""
    runs: dict[tuple, dict] = {}
    spans = []
    for e in parts:
        if e["side"]:
            runs.setdefault((e["d0"] is not None, e["d0"] or 0, e["t0"], e["off_by"], e["whole"], e["low"], e["high"]), {})[e["side"]] = e
        else:
            spans.append(((), True, [e["low"], e["high"], e["at"], e["to"], e["d0"], e["first_at"]]))
    for (*first, whole, low, high), both in sorted(runs.items()):
        left, right = both[-1], both[1]
        new = [low - left["more"], high + right["more"], left["at"], right["at"], left["d0"], left["first_at"]]
        if not whole and spans and spans[-1][0] == first and not spans[-1][1] and new[0] <= spans[-1][2][1]:
            spans[-1][2][1], spans[-1][2][3] = max(spans[-1][2][1], new[1]), max(spans[-1][2][3], new[3])
        else:
            spans.append((first, whole, new))
    last = None
    for a, b, start, end, d0, first_start in sorted((s for _, whole, s in spans if whole or s[1] - s[0] >= least_words), key=lambda s: (s[0], -s[1])):
        if last and a <= last[1]:
            last[1], last[3] = max(last[1], b), max(last[3], end)
        else:
            if last:
                yield last[2], last[3], last[1] - last[0], last[4], last[5]
            last = [a, b, start, end, d0, first_start]
    if last:
        yield last[2], last[3], last[1] - last[0], last[4], last[5]


def repeats(docs: DataFrame, unit: str = "line", least_words: int = 50, line_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, text_hash, start, end, n_words, first_doc_id, first_start: one row for each stretch that goes.

    first_*: where the stretch (or the first of several that touch) stands earlier. Stretches of `least_words` words
    or more go wherever they begin and end, whole lines (or paragraphs, with `unit`) and whole texts from `line_words`
    on. Passages are held against the earliest text that has one of their reflowed lines. `least_words` is
    LINE + SPAN - 1 or more.

    Null ids rank first. Null and empty texts have no units. Rows of one id and one text count as one document,
    so they don't mark each other; of one id with several texts each text is a document, told by text_hash (xxhash64).
    An empty table gives no rows. Other columns of docs are not looked at.
    """
    found = keep(units(docs, unit, least_words, line_words, id_col, text_col), "units")
    all_units = found.where(F.col("kind") != OWN)
    first = F.min(F.struct("doc_id", "t", "place")).alias("first")
    groups = all_units.groupBy("h", "g").agg(F.count("*").alias("times"), first).where("times > 1")
    groups = keep(groups, "repeated")  # its own exchange in the join, so that Spark can split the rows of one digest
    all_units = keep(perhaps_in(all_units, groups, ["h", "g"]), "common")  # few digests come twice
    own_repeated = keep(found.where(F.col("kind") == OWN), "own")
    discard(found)
    marked = all_units.join(groups.drop("times"), ["h", "g"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")) & (F.col("place") == F.col("first.place"))))
    marked = marked.select("doc_id", "t", "place", (F.col("place") + F.col("n")).alias("stop"), (F.col("kind") == WHOLE).alias("whole"), F.col("first.doc_id").alias("d0"), F.col("first.t").alias("t0"), (F.col("place") - F.col("first.place")).alias("off_by"))

    of = ["doc_id", "t", "d0", "t0", "off_by", "whole"]
    in_order = W.partitionBy(*of).orderBy("place")
    opens = F.when(F.lag("stop").over(in_order) >= F.col("place"), 0).otherwise(1)
    runs = marked.distinct().withColumn("opens", opens).withColumn("k", F.sum("opens").over(in_order)).groupBy(*of, "k").agg(F.min("place").alias("low"), F.max("stop").alias("high"))
    runs = keep(runs.drop("k"), "runs")
    copies = runs.where((F.col("t") == F.col("t0")) & (F.col("off_by") == 0)).groupBy("doc_id", "t").agg(F.min("d0").alias("d0"))  # whole texts that stood before
    others = runs.join(copies.select(F.col("doc_id").alias("x"), F.col("t").alias("y")), F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")), "left_anti")
    ends = others.select(*of, "low", "high", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    ends = keep(ends.withColumn("at", F.when(F.col("side") < 0, F.col("low")).otherwise(F.col("high"))), "ends")
    copies = keep(copies, "copies")

    asks = ends.select("doc_id", "t", "at", "side").union(ends.select("d0", "t0", F.col("at") - F.col("off_by"), "side")).union(copies.select("doc_id", "t", F.lit(0), F.lit(0)))
    asks = keep(asks.distinct().groupBy("doc_id", "t").agg(F.collect_list(F.struct("at", "side")).alias("asks")), "asks")  # of one text
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("x"), F.xxhash64(text).alias("y"), text.alias("text"))
    asked = perhaps_in(texts, asks.select(F.col("doc_id").alias("x"), F.col("t").alias("y")), ["x", "y"]).join(asks, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y"))).select("doc_id", "t", "text", "asks")
    seen = keep(around(asked).dropDuplicates(["doc_id", "t", "at", "side"]), "around")

    own = seen.where("side <> 0").select(F.col("doc_id").alias("x"), F.col("t").alias("y"), F.col("at").alias("z"), F.col("side").alias("s"), F.col("words").alias("mine"), F.col("offs").alias("my_offs"))
    other = seen.where("side <> 0").select(F.col("doc_id").alias("x0"), F.col("t").alias("y0"), F.col("at").alias("z0"), F.col("side").alias("s0"), F.col("words").alias("theirs"), F.col("offs").alias("their_offs"))
    both = ends.join(own, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")) & (F.col("at") == F.col("z")) & (F.col("side") == F.col("s")))
    both = both.join(other, F.col("d0").eqNullSafe(F.col("x0")) & (F.col("t0") == F.col("y0")) & (F.col("at") - F.col("off_by") == F.col("z0")) & (F.col("side") == F.col("s0")))
    both = keep(both.withColumn("more", F.when(F.col("whole"), 0).otherwise(alike(F.col("mine"), F.col("theirs")))), "extended")
    others_too = both_again(docs, all_units, groups, both, copies, of, least_words, id_col, text_col)
    at = lambda offs: F.get(F.col(offs), F.col("more"))
    both = both.select("doc_id", "t", F.struct("d0", "t0", "off_by", "whole", "low", "high", "side", "more", at("my_offs").alias("at"), F.lit(0).alias("to"), at("their_offs").alias("first_at")).alias("e"))
    again = own_repeated.join(copies.select(F.col("doc_id").alias("x"), F.col("t").alias("y")), F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")), "left_anti")
    own_span = F.struct(
        F.col("doc_id").alias("d0"), F.col("t").alias("t0"), F.lit(0).alias("off_by"), F.lit(True).alias("whole"), F.col("place").alias("low"), (F.col("place") + F.col("n")).alias("high"), F.lit(0).alias("side"), F.lit(0).alias("more"),
        F.shiftright("h", 32).cast("int").alias("at"), F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("to"), F.col("g").alias("first_at"),
    )
    both = both.union(again.select("doc_id", "t", own_span.alias("e"))).union(others_too)
    each = both.groupBy("doc_id", "t").agg(F.collect_list("e").alias("es"))  # of one text

    names = ["doc_id", "text_hash", "start", "end", "n_words", "first_doc_id", "first_start"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(d, t, *x) for d, t, es in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)) for x in removed(es.as_py(), least_words)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names)

    parts = each.mapInArrow(fold, "doc_id long, text_hash long, start int, end int, n_words int, first_doc_id long, first_start int")
    wholes = seen.where("side = 0").join(copies.select(F.col("doc_id").alias("x"), F.col("t").alias("y"), "d0"), F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")))
    wholes = wholes.where(F.col("offs")[2] >= line_words).select("doc_id", "t", F.col("offs")[0], F.col("offs")[1], F.col("offs")[2], "d0", F.col("offs")[0])
    return parts.union(wholes)


def both_again(docs: DataFrame, all_units: DataFrame, groups: DataFrame, ends: DataFrame, copies: DataFrame, of: list[str], least_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, t, e: the stretches of `least_words` words that open lines are in and that stood in an earlier text, as `removed` takes them."""
    low, high = F.col("low") - F.max(F.when(F.col("side") < 0, F.col("more"))), F.col("high") + F.max(F.when(F.col("side") > 0, F.col("more")))
    short = ends.where("NOT whole").groupBy(*of, "low", "high").agg(low.alias("a"), high.alias("b")).where(F.col("b") - F.col("a") < least_words)
    short = short.select(F.col("doc_id").alias("x"), F.col("t").alias("y"), F.col("low").alias("from"), F.col("high").alias("to")).distinct()
    lines = all_units.where(F.col("kind") == REFLOWED)
    often = groups.where("times > 2").select("h", "g")  # of two, the earlier one has been looked at
    open_ = lines.join(short, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")) & (F.col("place") >= F.col("from")) & (F.col("place") + F.col("n") <= F.col("to"))).select("h", "g").distinct()
    open_ = keep(open_.join(often, ["h", "g"], "left_semi"), "open")
    whole = copies.select(F.col("doc_id").alias("x"), F.col("t").alias("y"))  # they go as they are, and have no more than the first of them
    held = lines.join(open_, ["h", "g"], "left_semi").join(whole, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y")), "left_anti")
    held = keep(held.select("doc_id", "t", "place", "h", "g"), "held")
    several = held.groupBy("h", "g").agg(F.count("*").alias("times")).where("times > 2")
    places = held.join(several, ["h", "g"], "left_semi").groupBy("doc_id", "t").agg(F.collect_set("place").alias("places"))  # of one text
    places = keep(places, "places")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("x"), F.xxhash64(text).alias("y"), text.alias("text"))
    asked = perhaps_in(texts, places.select(F.col("doc_id").alias("x"), F.col("t").alias("y")), ["x", "y"]).join(places, F.col("doc_id").eqNullSafe(F.col("x")) & (F.col("t") == F.col("y"))).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "text", "places")
    found = keep(stretches(asked, least_words), "stretches")
    first = F.min(F.struct("doc_id", "t", "low", "start")).alias("first")
    again = keep(found.groupBy("h", "g").agg(F.count("*").alias("times"), first).where("times > 1").drop("times"), "again")
    out = found.join(again, ["h", "g"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t")) & (F.col("low") == F.col("first.low"))))
    span = F.struct(
        F.col("first.doc_id").alias("d0"), F.col("first.t").alias("t0"), F.lit(0).alias("off_by"), F.lit(True).alias("whole"), "low", (F.col("low") + least_words).alias("high"), F.lit(0).alias("side"), F.lit(0).alias("more"),
        F.col("start").alias("at"), F.col("end").alias("to"), F.col("first.start").alias("first_at"),
    )
    return out.select("doc_id", "t", span.alias("e"))


def alike(a: Column, b: Column) -> Column:
    """The number of first elements that are equal in both arrays."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")
