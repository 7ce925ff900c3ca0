"""Benchmark decontamination: an FM-index for each shard of training text finds every benchmark window and merges removal spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, ceil_div, cut, keyed_texts, renamed
from bandloom.llm.fm_index import FMIndex

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Words of a shard: a task indexes so many at once (about 30 MB).
SHARD_WORDS = 300_000
#: Bytes of benchmark text that one pass takes to the tasks; a larger benchmark takes more passes.
PASS_BYTES = 32 << 20

#: Lower-cases A-Z; bytes that are no word bytes become spaces.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case."""
    return text.translate(_WORD_BYTES).split()


class Phrases:
    """The windows of benchmark items as rows of word numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners.setdefault(tuple(ids[at : at + window]), set()).add(item)
        self.lengths = np.array([len(w) for w in owners], dtype=np.int64)
        self.rows = np.zeros((len(owners), window), dtype=np.int64)
        for i, w in enumerate(owners):
            self.rows[i, : len(w)] = w
        self.names = sorted({n for o in owners.values() for n in o if n is not None})
        place = {n: i for i, n in enumerate(self.names)}
        held = [sorted(place[n] for n in o if n is not None) for o in owners.values()]
        self.held_from = np.r_[0, np.cumsum([len(h) for h in held], dtype=np.int64)]
        self.held = np.array([i for h in held for i in h], dtype=np.int64)
        self.shortest = int(self.lengths.min(initial=window))


def find(texts: list[list[int]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, window) of every occurrence in the shard; starts count through all texts, each followed by one gap.

    Words that no item has, and runs between them too short for any window, cannot be part of an occurrence; the index holds
    the other runs.
    """
    none = (np.zeros(0, dtype=np.int64),) * 3
    line = np.fromiter((w for t in texts for w in (*t, 0)), dtype=np.int64)
    edge = np.diff(np.r_[0, (line > 0).astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin) or not len(phrases.lengths):
        return none
    size = end - begin + 1  # with the separator behind the run
    place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    index = FMIndex(line[place], len(phrases.number))
    lo, hi = index.search(phrases.rows, phrases.lengths)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return place[index.locate(rows)], phrases.lengths[window], window


def shard_hits(words: list[list[bytes]], phrases: Phrases) -> list[tuple[list[int], list[int], list[str]]]:
    """(span starts, span ends, item ids) of each text of a shard; spans are merged and count words from 0."""
    out: list[tuple[list[int], list[int], list[str]]] = [([], [], []) for _ in words]
    get = phrases.number.get
    start, length, window = find([[get(w, 0) for w in t] for t in words], phrases)
    if not len(start):
        return out
    first = np.r_[0, np.cumsum([len(t) + 1 for t in words])]
    cover = np.zeros(first[-1] + 1, dtype=np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    edge = np.diff(np.r_[0, (np.cumsum(cover) > 0).astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text = np.searchsorted(first, begin, side="right") - 1
    for t, b, e in zip(text.tolist(), (begin - first[text]).tolist(), (end - first[text]).tolist(), strict=True):
        out[t][0].append(b)
        out[t][1].append(e)
    pairs = np.unique(np.c_[np.searchsorted(first, start, side="right") - 1, window], axis=0)
    each = phrases.held_from[pairs[:, 1] + 1] - phrases.held_from[pairs[:, 1]]
    item = phrases.held[np.repeat(phrases.held_from[pairs[:, 1]] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    for t, i in np.unique(np.c_[np.repeat(pairs[:, 0], each), item], axis=0).tolist():
        out[t][2].append(phrases.names[i])
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Rows (id_col, n_words, n_hit, items, spans), one for each row of docs.

    items: ids (as strings, sorted) of the items with a window in the text. spans: merged removal spans, word positions
    [start, end) from 0; n_hit: the words in them. Nothing is shuffled: each task indexes its own texts, shard by shard, and
    searches the benchmark windows, which reach it in passes of about pass_bytes of benchmark text (items are dealt to passes by their hash).

    Null texts have no words; null ids and repeated rows are passed on. Items with null or wordless text have no window. An
    item with a null id marks spans but is not listed; rows that repeat an id count as one item. id_col may be a struct of
    whole rows. Empty tables give no rows, or no hits; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    passes = ceil_div(items.agg(F.sum(F.length("text"))).first()[0] or 0, pass_bytes)
    items = items.withColumn("pass", F.pmod(F.xxhash64("text"), F.lit(passes)))
    keyed = keyed_texts(docs, id_col, text_col)
    kinds = [T.StructField("n_words", T.LongType()), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")), T.StructField("items", T.ArrayType(T.StringType()))]
    found = keyed
    for k in range(passes):
        block = [(r["item"], bytes(r["text"])) for r in items.where(F.col("pass") == k).select("item", "text").collect()]
        sent = spark.sparkContext.broadcast(Phrases(block, window))
        carry = k + 1 < passes
        schema = T.StructType([renamed(keyed.schema["id"], "id"), *([T.StructField("text", T.BinaryType())] * carry), *kinds])
        found = found.mapInArrow(_searcher(sent, carry, pa.int32()), schema)
        if carry:
            found = cut(found, "hits")
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "items", spans.alias("spans"))


def _joined(old: tuple, new: tuple[list[int], list[int], list[str]]) -> tuple[list[int], list[int], list[str]]:
    """The union of what earlier passes and this one found in a text."""
    starts, ends = [], []
    for s, e in sorted([*zip(old[0], old[1], strict=True), *zip(new[0], new[1], strict=True)]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends, sorted({*old[2], *new[2]})


def _searcher(sent, carry: bool, int32: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value

        def shard(ids: list[pa.Array], texts: list, words: list, before: list) -> pa.RecordBatch:
            hits = shard_hits(words, phrases)
            if before:
                hits = [_joined(o, h) for o, h in zip(before, hits, strict=True)]
            columns = [pa.array([h[i] for h in hits], pa.list_(k)) for i, k in enumerate((int32, int32, pa.string()))]
            n = pa.array([len(w) for w in words], pa.int64())
            id_ = pa.concat_arrays(ids)
            kept = [pa.array(texts, pa.binary())] if carry else []
            return pa.RecordBatch.from_arrays([id_, *kept, n, *columns], ["id", *(["text"] * carry), "n_words", "starts", "ends", "items"])

        ids, texts, words, before, room = [], [], [], [], SHARD_WORDS
        for b in batches:
            earlier = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("starts", "ends", "items")), strict=True)) if b.num_columns > 2 else []
            since = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                found = words_of(text or b"")
                if words and room < len(found):
                    if i > since:
                        ids.append(b.column(0).slice(since, i - since))
                    yield shard(ids, texts, words, before)
                    ids, texts, words, before, room, since = [], [], [], [], SHARD_WORDS, i
                words.append(found)
                if carry:
                    texts.append(text)
                if earlier:
                    before.append(earlier[i])
                room -= len(found)
            if b.num_rows > since:
                ids.append(b.column(0).slice(since))
        if words:
            yield shard(ids, texts, words, before)

    return search
