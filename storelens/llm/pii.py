"""Personal data: fixed patterns, and terms that reveal a protected entity by the company they keep.

Each e-mail address, network address, card or phone number is a protected entity. Over all documents, the terms
that share a document with an entity are counted with it, and every such term is counted in all documents. A term t
discloses an entity e as far as its pointwise mutual information with e nears the information of e itself:

    disclosure(t, e) = log2(N c(e,t) / (c(t) c(e))) / log2(N / c(e))        (1: whoever reads t knows e)

Counts are of documents. A term whose disclosure is at or over the threshold, on at least `support` documents, is
removed at every place of every text, or generalised if it holds a digit (digits become 0). Pairs are made only for
entities and terms that stand in `support` documents, and for one of those that stand in the same documents (a list of
contacts in several copies makes one, and so do the words that come with it). A term on more documents than any of its
pairs allows isn't counted to the end: the documents with entities, then an eighth of all, show most of these words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, keep

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The patterns' parts. An address is found from its "@"; the rest start where a run of digits does.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\w+")
#: Bits of a map of terms: a term has SPARE of them, within these powers of two.
BITS, SPARE = (20, 26), 64
FLUSH = 200_000
#: One in so many parts of the documents is counted first.
FIRST_PARTS = 8


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by kind, then start: leftmost matches that do not overlap within a kind; failing ones are dropped."""
    out, last = [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(only_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def entity(kind: int, what: str) -> int:
    """A signed 64-bit name of the entity, however it is written."""
    plain = what.lower() if kind == 0 else ".".join(p.lstrip("0") for p in what.split(".")) if kind == 1 else only_digits(what)
    return signed(xxhash.xxh64_intdigest(f"{kind}:{plain}"))


def outside(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term in lower case, start, end) of the words of three signs or more that touch no span."""
    edges, k = sorted((start, end) for _, start, end in spans), 0
    reach = 0  # the furthest end of the spans that start before the word's end
    for m in WORD.finditer(text):
        while k < len(edges) and edges[k][0] < m.end():
            reach = max(reach, edges[k][1])
            k += 1
        if m.end() - m.start() >= 3 and m.start() >= reach:
            yield m.group().lower(), m.start(), m.end()


PLACE = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPAN = pa.struct([("order", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def named(text: str) -> int:
    """xxhash64 of a text, as Spark has it."""
    return signed(xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), 42))


def find(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (of the text), spans, es (its entities), terms (the distinct terms of a text with an entity). A null text counts as empty: no spans. Repeated rows and null ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, spans, es, terms = [], [], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                hs.append(named(text))
                own = base_spans(text)
                spans.append([{"order": k, "start": s, "end": e} for k, s, e in own])
                es.append(list({entity(k, text[s:e]) for k, s, e in own}))
                terms.append(list({w for w, _, _ in outside(text, own)}) if own else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(hs, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(es, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "h", "spans", "es", "terms"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, h long, spans array<struct<order:int,start:int,end:int>>, es array<long>, terms array<string>")


def occurrences(docs: DataFrame, wanted: bytes, id_col: str, text_col: str) -> DataFrame:
    """d, g (id and hash of a text), term, start, end of all terms of all texts whose place is wanted."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = held.value, {}
        for b in batches:
            ds, hs, all_hits = [], [], []
            for d, t in zip(b.column(0), b.column(1)):
                text = t.as_py() or ""
                words = {w: w.lower() for w in set(WORD.findall(text))}
                for w in [w for w in words.values() if w not in known]:
                    known[w] = holds(bits, w)
                if any(map(known.__getitem__, words.values())):
                    hits = [{"term": w, "start": x, "end": y} for w, x, y in outside(text, base_spans(text)) if known[w]]
                    if hits:
                        ds.append(d.as_py())
                        hs.append(named(text))
                        all_hits.append(hits)
                if len(known) > FLUSH:
                    known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(hs, pa.int64()), pa.array(all_hits, pa.list_(PLACE))], ["d", "g", "hits"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "d long, g long, hits array<struct<term:string,start:int,end:int>>").select("d", "g", F.inline("hits"))


def place_of(term: str, bits: int) -> int:
    return xxhash.xxh32_intdigest(term) >> (32 - bits)


def holds(held: bytes, term: str) -> bool:
    """Whether the term's place is in the map."""
    k = place_of(term, len(held).bit_length() + 2)
    return bool(held[k >> 3] >> (7 - (k & 7)) & 1)


def places(terms: DataFrame) -> bytes:
    """A bitmap that holds every term's place; other terms in it only cost time. It grows with the terms, so that the share of others in it stays (128 KB to 8 MB)."""
    bits = min(BITS[1], max(BITS[0], (SPARE * terms.count() - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([place_of(t, bits) for t in b.column(0).to_pylist()], pa.int32())], ["place"])

    found = terms.select("term").mapInArrow(run, "place int").distinct().toArrow().column("place").to_numpy()
    held = np.zeros(1 << bits, bool)
    held[found] = True
    return np.packbits(held).tobytes()


def document_counts(docs: DataFrame, wanted: bytes, text_col: str) -> DataFrame:
    """term -> n: the number of all documents with that term, for terms whose place is wanted."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, counts = held.value, {}, Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])
            counts.clear()
            return batch

        for b in batches:
            for t in b.column(0):
                words = {w.lower() for w in set(WORD.findall(t.as_py() or ""))}
                for w in [w for w in words if w not in known]:
                    known[w] = holds(bits, w)
                counts.update(filter(known.__getitem__, words))
                if len(known) > FLUSH:
                    known.clear()
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    return docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def most(c_et: Column, c_e: Column, rows: int, threshold: float) -> Column:
    """The documents that a term can stand in and still reach the threshold; a little more, for rounding."""
    return F.lit(float(rows)) * c_et / c_e * F.pow(c_e / F.lit(float(rows)), F.lit(threshold)) * (1 + 1e-9)


def rare_enough(docs: DataFrame, classes: DataFrame, both: DataFrame, rows: int, threshold: float, text_col: str) -> DataFrame:
    """The classes' rows without the terms that stand in too many documents of a part of docs, whichever that is, to disclose anything."""
    part = document_counts(docs.where(F.spark_partition_id() % FIRST_PARTS == 0), places(classes.select("term")), text_col)
    limits = both.groupBy("class").agg(F.max(most(F.col("c_et"), F.col("c_e"), rows, threshold)).alias("limit"))
    rare = classes.join(limits, "class").join(part, "term", "left").where(F.coalesce("n", F.lit(0)) <= F.col("limit"))
    return keep(rare.select("term", "class"), "rare")


def pairs(found: DataFrame, rows: int, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(term, class) of the terms that may disclose, and (class, c_et, c_e): for each number of documents that a class shares with an entity, the least count of such an entity.

    Entities of the same documents are one, and so are terms: what counts of a pair is the same for all of them. A class
    on more documents than N (c(e) / N) ** threshold c(e,t) / c(e) can't reach the threshold with e, and isn't counted with it.
    Entities that stand in every document tell nothing. An empty table gives no rows.
    """
    where = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"where_{k}") for k in (0, 1)]  # equal for what stands in the same documents
    each = found.select("row", F.explode("es").alias("e"))
    entities = each.groupBy("e").agg(F.count("*").alias("c_e"), *where).where((F.col("c_e") >= support) & (F.col("c_e") < rows))  # of others no pair counts
    entities = entities.groupBy("c_e", "where_0", "where_1").agg(F.min("e").alias("e")).select("e", "c_e")
    entities = keep(each.join(entities, "e"), "entities")
    own = found.join(entities.select("row").distinct(), "row", "left_semi").select("row", F.explode("terms").alias("term"))
    counted = keep(own.groupBy("term").agg(F.count("*").alias("m"), *where).where(F.col("m") >= support), "terms")
    alike = ["m", "where_0", "where_1"]
    firsts = keep(counted.groupBy(*alike).agg(F.min("term").alias("class")), "firsts")
    held = own.join(firsts.select(F.col("class").alias("term"), "m"), "term")
    both = entities.join(held, "row").where(F.col("m") <= most(F.col("c_e"), F.col("c_e"), rows, threshold)).groupBy("e", "c_e", F.col("term").alias("class"), "m").agg(F.count("*").alias("c_et"))
    both = both.where((F.col("c_et") >= support) & (F.col("m") <= most(F.col("c_et"), F.col("c_e"), rows, threshold)))
    both = keep(both.groupBy("class", "c_et").agg(F.min("c_e").alias("c_e")), "pairs")
    open_ = firsts.join(both.select("class").distinct(), "class", "left_semi")
    classes = keep(counted.join(open_, alike).select("term", "class"), "classes")
    return classes, both


def detect(docs: DataFrame, threshold: float = 0.9, support: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> doc_id, h, spans (array of order, start, end; order 4 is a disclosing term), by kind, then start.

    A null text counts as empty: no spans. Repeated rows and null ids stay; each row counts as a document. An
    empty table gives no rows.
    """
    found = keep(find(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "personal")
    rows = found.agg(F.count("*")).first()[0]
    classes, both = pairs(found, rows, threshold, support)
    classes = rare_enough(docs, classes, both, rows, threshold, text_col)
    terms = document_counts(docs, places(classes.select("term")), text_col)
    told = F.log2(F.lit(float(rows)) * F.col("c_et") / (F.col("n") * F.col("c_e")))
    scored = classes.join(both, "class").join(terms, "term").withColumn("disclosure", F.try_divide(told, F.log2(F.lit(float(rows)) / F.col("c_e"))))
    revealing = keep(scored.where(F.col("disclosure") >= threshold).select("term").distinct(), "revealing")
    hits = occurrences(docs, places(revealing), id_col, text_col).join(revealing, "term", "left_semi")
    more = hits.groupBy("d", "g").agg(F.collect_set(F.struct(F.lit(len(KINDS)).alias("order"), "start", "end")).alias("more"))
    out = found.select("doc_id", "h", "spans").join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    none = F.array().cast("array<struct<order:int,start:int,end:int>>")
    return out.select("doc_id", "h", F.sort_array(F.concat("spans", F.coalesce("more", none))).alias("spans"))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Entities become a mark of their kind; disclosing terms go, or keep their form with zeros if they hold digits. Overlapping spans count as one, of the first's kind."""
    out, at = [], 0
    for k, start, end in sorted(spans, key=lambda x: (x[1], x[0])):
        if start < at:
            if end > at:
                at = end
            continue
        out.append(text[at:start])
        what = text[start:end]
        out.append(f"[{KINDS[k].upper()}]" if k < len(KINDS) else re.sub(r"\d", "0", what) if any(c.isdigit() for c in what) else "[REMOVED]")
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the spans that `detect` finds taken out of the text; other columns, and null texts, stay as they are. Repeated rows and null ids stay. An empty table stays empty."""
    names = docs.columns
    h, d, g, found_spans = fresh(docs, "h", "of_id", "of_h", "found")
    spans = detect(docs, id_col=id_col, text_col=text_col, **options).where(F.size("spans") > 0).dropDuplicates(["doc_id", "h"])
    spans = spans.select(F.col("doc_id").alias(d), F.col("h").alias(g), F.col("spans").alias(found_spans))

    @F.pandas_udf("string")
    def clean(text, found):  # noqa: ANN001, ANN202
        return text.combine(found, lambda t, s: t if t is None or s is None else masked(t, [(x["order"], x["start"], x["end"]) for x in s]))

    marked = docs.withColumn(h, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = marked.join(spans, F.col(id_col).cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(g)), "left")
    cleaned = F.when(F.col(found_spans).isNull(), F.col(text_col)).otherwise(clean(F.col(text_col), F.col(found_spans)))
    return out.select(*[cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in names])


def listed(spans: F.Column) -> F.Column:
    kinds = F.array(*map(F.lit, (*KINDS, TERM)))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.order), x.start.cast("string"), x.end.cast("string"))), ",")


def count_of(order: int) -> F.Column:
    return F.size(F.filter("spans", lambda x: x.order == order)).cast("long")


def digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x.order < len(KINDS))
    counts = [count_of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
