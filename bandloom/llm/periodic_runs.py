"""Periodic runs of words by the dictionary of basic factors: successor occurrences of factors of 1, 2, 4, ... words propose periods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, keyed_texts, renamed

#: Bytes of texts whose words are named together; a longer text is named alone.
GROUP_BYTES = 2 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

Reorder = Callable[[object, int], np.ndarray | None]


def find_runs(words: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period), by start and period, of all maximal runs in a sequence of word numbers, of `least` words and
    `times` >= 3 periods at least.

    The factor of 2^k words at a place is named by the names of its halves; factors that stand once only are left out from then
    on, as no longer one can repeat there. A run of period q <= 2^k, with 2^k < 2q, holds 3q > 2^k + q words; so at all of its
    places but the last ones its factor of 2^k words comes again, first after q words, since a factor of q words or more that
    came again sooner would have a shorter period. Places in a row with one such distance are thus one run, whole and with its
    smallest period. Level k takes the distances above 2^(k-1), those up to twice the factor of the level before, so no run is
    found twice.
    """
    places, names, size = np.arange(len(words)), words.astype(np.int64), 1
    name = np.empty(len(words), np.int64)
    found = []
    while len(places):
        order = np.argsort(names, kind="stable")
        at, key = places[order], names[order]
        again = key[1:] == key[:-1]
        gap = at[1:] - at[:-1]
        near = again & (gap > size // 2) & (gap <= size)
        if near.any():
            first, by = at[:-1][near], gap[near]
            order = np.argsort(first)
            first, by = first[order], by[order]
            new = np.flatnonzero(np.r_[True, (np.diff(first) != 1) | (np.diff(by) != 0)])
            length = np.diff(np.r_[new, len(first)]) - 1 + size + by[new]
            fits = length >= np.maximum(least, times * by[new])
            found.append(np.stack([first[new], length, by[new]], axis=1)[fits])
        twice = np.r_[again, False] | np.r_[False, again]
        name.fill(-1)
        name[at[twice]] = np.cumsum(np.r_[True, ~again])[twice]
        places = np.flatnonzero(name[: max(0, len(words) - size)] >= 0)
        places = places[name[places + size] >= 0]
        names = name[places] * (len(words) + 1) + name[places + size]
        size *= 2
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def text_runs(ids: list[object], texts: list[bytes], least: int, times: int, reorder: Reorder | None) -> Iterator[tuple[np.ndarray, bytes]]:
    """(runs, collapsed text) of each text; the words of all texts are named at once, each text's words apart."""
    words = [t.split() for t in texts]
    if reorder is not None:
        for k, (i, w) in enumerate(zip(ids, words, strict=True)):
            if w and (order := reorder(i, len(w))) is not None:
                words[k] = [w[j] for j in order.tolist()]
    ends = np.cumsum([len(w) for w in words])
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()
    own = np.repeat(np.arange(len(words)), [len(w) for w in words]) * (len(coded.dictionary) + 1)
    runs = find_runs(coded.indices.to_numpy(zero_copy_only=False) + own, least, times)
    owner = np.searchsorted(ends, runs[:, 0], side="right")
    for k, w in enumerate(words):
        lo, hi = np.searchsorted(owner, (k, k + 1))
        mine = runs[lo:hi] - [ends[k] - len(w), 0, 0]
        if len(mine):
            change = np.zeros(len(w) + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 0] + mine[:, 1], -1)
            w = [w[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        yield mine, b" ".join(w)


def _groups(ids: list[object], texts: list[bytes]) -> Iterator[tuple[list[object], list[bytes]]]:
    at = 0
    while at < len(texts):
        end, room = at, GROUP_BYTES
        while end < len(texts) and (end == at or room >= len(texts[end])):
            room -= len(texts[end])
            end += 1
        yield ids[at:end], texts[at:end]
        at = end


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3, reorder: Reorder | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, runs, collapsed), one for each row of docs, without a shuffle.

    Words are what ASCII white space parts, numbered from 0. A run is a longest stretch of `least` words and `times` (3 or more)
    smallest periods at least whose words equal those a period on; runs lists (start, length, period) by start, then period.
    collapsed holds the words, joined by one space, that lie in no run or in the first period of every run that holds them.
    reorder(id, n) may give, for a text of n words, the number of the word that takes each place.

    Null and empty texts and those without words have no runs and an empty collapsed text; null ids and repeated rows are passed
    on as they are; an empty table gives no rows; other columns are ignored. A text is worked on whole, in memory in proportion to
    its own words and in time to those times the logarithm of the longest factor that repeats.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by successors of one level")
    bounded_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for ids, texts in _groups(b.column(0).to_pylist(), [x or b"" for x in b.column(1).to_pylist()]):
                runs, kept = zip(*text_runs(ids, texts, least, times, reorder), strict=True)
                flat = np.concatenate(runs)
                cells = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(done, len(ids)), lists, pa.array(kept, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])
                done += len(ids)

    schema = T.StructType([renamed(keyed.schema["id"], "id"), *T._parse_datatype_string(f"runs {RUNS}, collapsed string").fields])
    return keyed.mapInArrow(find, schema).select(F.col("id").alias(id_col), "runs", "collapsed")


def strongest(runs: str) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null if there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, none, lambda a, x: F.when(better(a, x), x).otherwise(a))
