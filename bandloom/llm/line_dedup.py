"""Line dedup: range-partitioned line hashes, streamed in order, give compressed keep bitmaps for documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import SPACES, bounded_batches, cut, discard, renamed, shuffle_width

_STRIP = SPACES.encode()
#: Bytes of bitmaps that are sent to where texts are read.
CARRIED = 32 << 20


def line_key(line: bytes) -> bytes:
    """The line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z in lower case."""
    return line.strip(_STRIP).lower()


def bitmap(dropped: np.ndarray) -> bytes:
    """A compressed bitmap, up to the last dropped line, with a 1 for each line that stays."""
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(text: bytes, keep: bytes | None) -> tuple[list[bytes], int]:
    """(the lines that stay, the number of lines); no bitmap keeps all."""
    lines = text.split(b"\n")
    if keep is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)]
    gone = bits.tobytes() + b"\1" * (len(lines) - len(bits))
    return [x for x, stays in zip(lines, gone, strict=True) if stays], len(lines)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the id if it is a whole number, else its hash) and part (the text's hash) name a row; equal rows share them."""
    text, whole = F.col(text_col).cast("binary"), isinstance(docs.schema[id_col].dataType, T.IntegralType)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))) if whole else F.xxhash64(F.col(id_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), doc.alias("doc"), F.xxhash64(text).alias("part"))


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """Rows (h, g, doc, part, pos, times): a 96-bit hash of every line's key of at least min_chars code points. Equal rows of a
    batch are one, with the number of them in `times`, as each counts as a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, int], int] = {}
            first: list[int] = []
            times: list[int] = []
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if (at := seen.setdefault(key, len(first))) < len(first):
                    times[at] += 1
                else:
                    first.append(i)
                    times.append(1)
            each, pos, hashes = [], [], []
            for text in b.column(0).take(pa.array(first, pa.int64())).to_pylist():
                lines = text.split(b"\n") if text else []
                keys = [line_key(x) for x in lines]
                at = [i for i, k in enumerate(keys) if k and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars)]
                each.append(len(at))
                pos += at
                hashes += [xxhash.xxh3_128_digest(keys[i]) for i in at]
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            take = pa.array(np.repeat(np.array(first, dtype=np.int64), each))
            columns = [pa.array(h[:, 0]), pa.array((h[:, 1] & 0x7FFFFFFF).astype(np.int32)), b.column(1).take(take), b.column(2).take(take), pa.array(pos, pa.int32()), pa.array(np.repeat(np.array(times, dtype=np.int32), each))]
            yield pa.RecordBatch.from_arrays(columns, _LINE)

    return rows.select("text", "doc", "part").mapInArrow(run, "h long, g int, doc long, part long, pos int, times int")


_LINE = ["h", "g", "doc", "part", "pos", "times"]


def _documents(columns: list[np.ndarray], before: tuple | None, new_key: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """(documents that each row adds to its run, (doc, part, first position) of the last row's document). Rows of a document are
    its repeats and its further positions; only those of its first position add the number of its repeats."""
    doc, part, pos, times = columns
    new = np.r_[before is None or (doc[0], part[0]) != before[:2], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]
    if new_key is not None:
        new |= new_key
    starts, group = np.flatnonzero(new), np.cumsum(new) - int(new[0])
    first = np.r_[pos[:0] if new[0] else before[2], pos[starts]]
    return np.where(pos == first[group], times, 0), (doc[-1], part[-1], first[group[-1]])


def _repeats(columns: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Which rows stand at the same place (doc, part, pos) as those."""
    return (columns[2] == rows[2]) & (columns[3] == rows[3]) & (columns[4] == rows[4])


class _Runs:
    """Streams rows sorted by (key, document, position) and decides which lines go.

    A run is the rows of one key. Runs inside the stream are decided here. The first and the last run may go on in other
    partitions: their first row (for its repeats too) is told as a note with the number of their documents here, from which the whole run is
    decided later; their other rows go if the limit is reached here, and else stay open (the rows of few documents). A run
    that has reached the limit is passed on at once, so no run is held.
    """

    def __init__(self, limit: int, keep_first: bool) -> None:
        self.limit, self.keep_first, self.is_first = limit, keep_first, True
        self.held: list[np.ndarray] | None = None
        self.hot: dict | None = None

    def _close_hot(self, at_edge: bool) -> Iterator[tuple[str, list[np.ndarray], int]]:
        hot, self.hot = self.hot, None
        if at_edge or self.is_first:
            yield "note", hot["row"], hot["docs"]
        elif not self.keep_first:
            yield "drop", hot["row"], 0
        self.is_first = False

    def feed(self, columns: list[np.ndarray], last: bool) -> Iterator[tuple[str, list[np.ndarray], int]]:
        """Yields (kind, rows, documents): 'drop' rows, 'open' rows, or a 'note'."""
        if self.held is not None:
            columns, self.held = [np.concatenate([a, b]) for a, b in zip(self.held, columns, strict=True)], None
        if self.hot is not None:
            same = (columns[0] == self.hot["key"][0]) & (columns[1] == self.hot["key"][1])
            lead = len(same) if same.all() else int(np.argmin(same))
            if lead:
                docs, last_doc = _documents([c[:lead] for c in columns[2:]], self.hot["doc"])
                self.hot["docs"] += int(docs.sum())
                self.hot["doc"] = last_doc
                lead_rows = [c[:lead] for c in columns]
                other = ~_repeats(lead_rows, self.hot["row"])
                yield "drop", [c[other] for c in lead_rows], 0
            columns = [c[lead:] for c in columns]
            if len(columns[0]) or last:
                yield from self._close_hot(last and not len(columns[0]))
        if not len(columns[0]):
            return
        h, g = columns[:2]
        new_key = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        start, run = np.flatnonzero(new_key), np.cumsum(new_key) - 1
        each, last_doc = _documents(columns[2:], None, new_key)
        docs = np.bincount(run, weights=each).astype(np.int64)
        sure = docs >= self.limit
        inner = np.ones(len(start), dtype=bool)
        inner[-1] = False
        if self.is_first:
            inner[0] = False
        go = (inner & sure)[run]
        again = _repeats(columns, [c[start][run] for c in columns])  # a run's first row and its repeats, decided together
        if self.keep_first:
            go &= ~again
        yield "drop", [c[go] for c in columns], 0
        for r in np.flatnonzero(~inner).tolist():
            at, end = start[r], start[r + 1] if r + 1 < len(start) else len(h)
            first, rest = [c[at : at + 1] for c in columns], [c[at:end][~again[at:end]] for c in columns]
            if r + 1 < len(start) or last:
                yield "note", first, int(docs[r])
                yield "drop" if sure[r] else "open", rest, 0
                self.is_first = False
            elif sure[r]:
                yield "drop", rest, 0
                self.hot = {"key": (h[at], g[at]), "row": first, "docs": int(docs[r]), "doc": last_doc}
            else:
                self.held = [c[at:end] for c in columns]


_NAMES = ["kind", "docs", *_LINE]


def _stream(limit: int, keep_first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, columns = _Runs(limit, keep_first), None

        def told(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            for kind, rows, docs in state.feed(columns, last):
                if n := len(rows[0]):
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(np.full(n, docs)), *map(pa.array, rows)], _NAMES)

        for b in batches:
            columns = [np.asarray(c) for c in b.columns]
            yield from told(columns, False)
        if columns is not None:
            yield from told([c[:0] for c in columns], True)

    return run


def keep_bitmaps(rows: DataFrame, min_docs: int, min_chars: int, keep_first: bool) -> DataFrame:
    """Rows (doc, part, keep) for the documents that lose lines; keep: see bitmap(). A table in the shared folder."""
    keys = ["h", "g", "doc", "part"]
    lines = line_hashes(rows, min_chars)
    dealt = lines.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys, "pos")
    told = cut(dealt.mapInArrow(_stream(min_docs, keep_first), "kind string, docs long, h long, g int, doc long, part long, pos int, times int"), "lines", "kind")
    notes, place = told.where("kind = 'note'"), F.struct("doc", "part", "pos")
    totals = notes.groupBy("h", "g").agg(F.sum("docs").alias("docs"), F.min(place).alias("first")).where(F.col("docs") >= min_docs).drop("docs")
    firsts = notes.join(totals, ["h", "g"]).where(place != F.col("first") if keep_first else F.lit(True))
    open_ = told.where("kind = 'open'").join(totals, ["h", "g"])
    gone = told.where("kind = 'drop'").select("doc", "part", "pos")
    for more in (firsts, open_):
        gone = gone.unionAll(more.select("doc", "part", "pos"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = [bitmap(np.array(p)) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], ["doc", "part", "keep"])

    maps = gone.groupBy("doc", "part").agg(F.collect_set("pos").alias("lines")).mapInArrow(pack, "doc long, part long, keep binary")
    maps = cut(maps, "bitmaps")
    discard(told)
    return maps


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """Rows (id_col, n_lines, n_dropped, kept), one for each row of docs.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. Lines whose key has at least
    min_chars code points and stands in at least min_docs documents go: all of them, or all but the first by (document,
    position) with keep_first. Line hashes are dealt out in ranges of (key, document), so that a very common line spreads
    over tasks; each task streams its range in order, and what it cannot decide alone is at most a few documents at each end.
    Documents come back as compressed bitmaps of the lines that stay. Bitmaps of up to CARRIED bytes together go to where the
    texts are read, and no text is shuffled; only if they are larger do texts and bitmaps meet in a shuffle.

    A document is a row: rows with equal ids and different texts, with null ids, and repeated rows each count. Null and empty
    texts are one empty line, which stays. Rows with equal id and text get equal results (with keep_first, a line that the first
    of them keeps stays in all of them). An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = _identified(docs, id_col, text_col)
    maps = keep_bitmaps(rows, min_docs, min_chars, keep_first)
    if (maps.agg(F.sum(F.octet_length("keep") + 16)).first()[0] or 0) <= CARRIED:
        maps = F.broadcast(maps)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, total, gone = [], [], []
            for text, keep in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lines, n = kept_lines(text or b"", keep)
                kept.append(b"\n".join(lines))
                total.append(n)
                gone.append(n - len(lines))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_lines", "n_dropped", "kept"])

    schema = T.StructType([renamed(docs.schema[id_col], "id"), *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_dropped")), T.StructField("kept", T.BinaryType())])
    joined = rows.join(maps, ["doc", "part"], "left")
    done = joined.select("id", "text", "keep").mapInArrow(apply, schema)
    return done.select(F.col("id").alias(id_col), "n_lines", "n_dropped", F.col("kept").cast("string").alias("kept"))
