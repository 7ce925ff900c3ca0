"""Packing of token sequences: documents are encoded once, a cutting-stock plan is made of their lengths, and ranks find their places."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm import token_counts as tc
from bandloom.llm.common import bounded_batches, carried, cut, keyed_texts, renamed
from bandloom.llm.cutting_stock import Plan, plan_sequences

#: A space between two characters that no tokenizer takes for white space.
_GAP = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=[^\\s\u180e\u200b\ufeff])")
_BLANK = frozenset(c for c in map(chr, range(0x3001)) if c.isspace()) | {"\u180e", "\u200b", "\ufeff"}
#: A piece that is a word of letters, ASCII signs at its end, and the same again in further lines: each is a token run of its own.
_LINES = re.compile(r"([A-Za-z]*)([,.;:!?]?)(?:\n([A-Za-z]+)([,.;:!?]?))*")
#: The runs that a byte-level tokenizer cuts texts into, where white space comes neither in threes nor in twos at the end, and in all.
_RUNS = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_ALL_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The bytes of visible ASCII, its usual white space, and letters up to U+027F, which all libraries put into the same classes.
_PLAIN = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_TO_SPACES = bytes.maketrans(b"\t\n\r", b"   ")
#: Pieces between gaps of which a worker remembers the ids, in two generations of this many, and the longest of them.
_MEMO, _MEMO_CHARS = 400_000, 24
#: Characters of texts that are split together, and that one call of the tokenizer takes.
GROUP_CHARS = 2 << 20
_CALL = 1 << 16
_IDS = np.dtype("<u4")


def _beside_blank(words: Iterable[str]) -> set[str]:
    """The pieces around which the spaces are no gaps."""
    return {w for w in words if not w or w[0] in _BLANK or w[-1] in _BLANK}


@cache
def lasting_chars() -> frozenset[str]:
    """The characters that are letters, numbers, spaces or neither in Unicode 3.2 and now alike, so in whatever version a library has:
    what was unassigned counted as neither. Controls and what is unassigned now are left out."""
    kind = lambda data, c: k if (k := data.category(c)[0]) in "LNZ" else ""
    old = unicodedata.ucd_3_2_0
    lasting = (c for c in map(chr, range(0x80, 0x30000)) if unicodedata.category(c)[0] != "C" and kind(unicodedata, c) == kind(old, c))
    return frozenset(chain(lasting, (chr(b) for b in _PLAIN if b < 0x80)))


def bytes_to_chars() -> dict[int, str]:
    """How byte-level vocabularies write bytes: visible Latin characters as themselves, the others by characters from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(rest)}


class IdMemo:
    """The ids of whole texts as little-endian 32-bit numbers.

    Texts of _PLAIN bytes or lasting_chars() are merged as a whole by the order of the tokenizer's own merges; nothing of them is
    remembered. In all others a byte-level tokenizer starts a token at each gap, so the pieces between gaps are encoded once each and remembered: those of
    the generation before are looked up and taken over, so frequent pieces stay and the memory is bounded. Of a new piece the
    words and the signs behind them are encoded apart, and these once each.
    """

    def __init__(self, blob: bytes) -> None:
        self.loaded = tc._Loaded("tokenizers", blob)
        self.tok = self.loaded.tok
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        starts = [t.startswith("\u0120") for t, _ in sorted(self.tok.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        self.starts = np.array(starts)
        self.merges, self.all_merges, self.added = None, None, ()
        if self.loaded.boundary == tc.BEFORE_SPACE:
            self._in_merge_order(json.loads(blob))
        self.signs = dict(zip(",.;:!?\n", self._encode(list(",.;:!?\n")), strict=True)) | {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, _IDS).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _in_merge_order(self, spec: dict) -> None:
        """Makes encoders by the merges of the tokenizer's file, of _RUNS and of _ALL_RUNS, if that gives the tokenizer's ids.

        Merging by ids is merging by that order if results are numbered in it and each of them, taken alone, merges to itself: what
        lies in a span that no merge has crossed goes through the same steps as the span alone, so it ends by the same merge.
        """
        model, base = spec["model"], len(bytes_to_chars())
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", ())]
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        vocab, own = model["vocab"], self.tok.model
        if not plain or len(vocab) < base + len(merged) or any(vocab.get(m) != base + k for k, m in enumerate(merged)):
            return
        byte_of = {c: b for b, c in bytes_to_chars().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if i < base + len(merged)}
        if len(ranks) != base + len(merged) or any(len(own.tokenize(m)) != 1 for m in merged):
            return
        import tiktoken

        # these texts never hold the special token, which the encoder needs to search for one
        self.merges, self.all_merges = (tiktoken.Encoding("merges", pat_str=p, mergeable_ranks=ranks, special_tokens={"\0": len(ranks)}) for p in (_RUNS, _ALL_RUNS))
        self.added = tuple(a["content"] for a in spec.get("added_tokens") or ())

    def _merged(self, text: str) -> bytes | None:
        """The ids of a text without an added token, of characters whose kind all libraries agree on; None for other texts."""
        if self.merges is None or any(a in text for a in self.added):
            return None
        data = text.encode()
        if not data.translate(None, _PLAIN):
            spaced = data.translate(_TO_SPACES)
            encoder = self.all_merges if b"   " in spaced or spaced.endswith(b"  ") else self.merges
        elif lasting_chars().issuperset(text):
            encoder = self.all_merges
        else:
            return None
        return encoder.encode_to_numpy(text, disallowed_special=()).astype(_IDS, copy=False).tobytes()

    def _spaced(self, words: list[str], letters: bool = False) -> list[bytes]:
        """Ids of words without a space inside, each behind a space: many in one text, whose tokens tell where a word starts."""
        out, at = [], 0
        while at < len(words):
            end, room = at, _CALL
            while end < len(words) and (end == at or room > len(words[end])):
                room -= len(words[end]) + 1
                end += 1
            text = "".join([f" {w}" for w in words[at:end]])
            data = np.array(self.merges.encode_ordinary(text), _IDS).tobytes() if letters else self._encode([text])[0]
            cuts = [*(4 * np.flatnonzero(self.starts[np.frombuffer(data, _IDS)])).tolist(), len(data)]
            out += [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            at = end
        return out

    def _learn(self, words: set[str], blank: set[str]) -> None:
        """Puts the ids of words behind a space into the young generation; blank: those of them that begin or end with white space."""
        known = {w: self.old[w] for w in words if w in self.old}
        plain, lines, other = [], [], []
        for w in words.difference(known):
            if " " in w or w in blank:
                other.append(w)
            elif w[-1:] in ",.;:!?" or "\n" in w:
                (lines if _LINES.fullmatch(w) else plain).append(w)
            else:
                plain.append(w)
        split = [[(x[:-1], x[-1]) if x[-1:] in self.signs and x else (x, "") for x in w.split("\n")] for w in lines]
        first = {s[0][0] for s in split if s[0][0]}.difference(self.young, known)
        later = list({x for s in split for x, _ in s[1:]})
        plain += first.difference(plain)
        letters = [w for w in plain if w.isalpha() and max(w) < "\u0250"] if self.merges else []
        known.update(zip(letters, self._spaced(letters, letters=True), strict=True))
        plain = [w for w in plain if w not in known]
        known.update(zip(plain, self._spaced(plain), strict=True))
        known.update(zip(other, self._encode([f" {w}" for w in other]), strict=True))
        bare, space, signs = dict(zip(later, self._encode(later), strict=True)), self._encode([" "])[0], self.signs
        for w, s in zip(lines, split, strict=True):
            head, sign = s[0]
            at = (known.get(head) or self.young[head]) if head else None
            start = self._encode([f" {sign}"])[0] if at is None and sign else space if at is None else at + signs[sign]
            known[w] = start + b"".join([signs["\n"] + bare[x] + signs[c] for x, c in s[1:]])
        self.young.update(known)

    def all_ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, of a group of texts at a time."""
        at = 0
        while at < len(texts):
            end, room = at, GROUP_CHARS
            while end < len(texts) and (end == at or room > len(texts[end])):
                room -= len(texts[end])
                end += 1
            yield from self.ids(texts[at:end])
            at = end

    def ids(self, texts: list[str]) -> list[bytes]:
        if self.loaded.boundary != tc.BEFORE_SPACE:
            return self._encode(texts)
        out = [self._merged(t) for t in texts]
        if other := [k for k, ids in enumerate(out) if ids is None]:
            for k, ids in zip(other, self._remembered([texts[k] for k in other]), strict=True):
                out[k] = ids
        return out

    def _remembered(self, texts: list[str]) -> list[bytes]:
        """The ids of texts by their pieces between gaps."""
        if len(self.young) > _MEMO:
            self.old, self.young = self.young, {}
        young = self.young
        pieces = [t.split(" ") for t in texts]
        new = set(chain.from_iterable(pieces)).difference(young)
        if blank := _beside_blank(new):
            for k, p in enumerate(pieces):
                if not blank.isdisjoint(p):
                    pieces[k] = _GAP.split(texts[k])
        heads, rest = self._encode([p[0] for p in pieces]), [p[1:] for p in pieces]
        if blank:
            new = set(chain.from_iterable(rest)).difference(young)
            blank = _beside_blank(new)
        self._learn(new, blank)
        out = [h + b"".join(map(young.__getitem__, p)) for h, p in zip(heads, rest, strict=True)]
        for w in blank.union(w for w in new if len(w) > _MEMO_CHARS):
            del young[w]
        return out


_memos: dict[str, IdMemo] = {}


def _memo_of(blob: bytes) -> IdMemo:
    """The memory of this worker process, which later tasks go on with."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _memos:
        _memos[key] = IdMemo(blob)
    return _memos[key]


def _encoded(docs: DataFrame, blob: bytes, room: int, end_id: int | None, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, id, n, full, full_crcs, tail, tail_rank, tail_crc, tail_ids): full is how many full sequences the rows before of
    the same task have filled, tail_rank how many of them have a tail of the same length."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(blob)
    keyed = keyed_texts(docs, id_col, text_col)
    width = 4 * room

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, part = _memo_of(shipped.value), TaskContext.get().partitionId()
        short = np.dtype("<u2") if max(len(memo.starts), (end_id or 0) + 1) <= 1 << 16 else _IDS
        end = b"" if end_id is None else np.array([end_id], _IDS).tobytes()
        full, ranks = 0, np.zeros(room, np.int64)
        for b in batches:
            texts = [(x or b"").decode() for x in b.column(1).to_pylist()]
            out: list[tuple] = []
            for raw in memo.all_ids(texts):
                ids = raw + end
                view, cuts = memoryview(ids), len(ids) // width
                tail = ids[cuts * width :]
                size = len(tail) // 4
                out.append((len(ids) // 4, full, [crc32(view[k * width : (k + 1) * width]) for k in range(cuts)], size, int(ranks[size]), crc32(tail), np.frombuffer(tail, _IDS).astype(short).tobytes()))
                full += cuts
                ranks[size] += 1
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(texts), pa.int32()), b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [f.name for f in schema])

    fields = T._parse_datatype_string("n long, full long, full_crcs array<long>, tail int, tail_rank long, tail_crc long, tail_ids binary").fields
    schema = T.StructType([T.StructField("part", T.IntegerType()), renamed(keyed.schema["id"], "id"), *fields])
    return keyed.mapInArrow(run, schema)


def _placed(tails: DataFrame, plan: Plan, id_type: T.DataType, ids: bool) -> DataFrame:
    """Pieces of tails (id, n, tail, rank, tail_crc or tail_ids): without ids those that stay whole, with ids those of the stream."""
    shipped = tails.sparkSession.sparkContext.broadcast(plan)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shipped.value
        for b in batches:
            n, size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "tail", "rank"))
            sequence, offset = plan.place(size, rank)
            if not ids:
                keep = np.flatnonzero(sequence >= 0)
                some = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array((n - size)[keep]), pa.array(size[keep]), some.column("tail_crc"), pa.array(n[keep]), pa.array(sequence[keep]), pa.array(offset[keep])], names)
                continue
            rows, owner = [], []
            for k in np.flatnonzero(sequence < 0).tolist():
                raw = b.column("tail_ids")[k].as_py()
                data = np.frombuffer(raw, "<u2" if len(raw) == 2 * size[k] else _IDS).astype(_IDS)
                for start, length, seq, at in plan.cuts(int(offset[k]), int(size[k])):
                    owner.append(k)
                    rows.append((int(n[k] - size[k]) + start, length, crc32(data[start : start + length].tobytes()), int(n[k]), seq, at))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names)

    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in names[1:])])
    return tails.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, room: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents, packed into sequences
    of `room` tokens, a power of two.

    A document is its text's ids by the tokenizers library and then end_id, if not None. It fills sequences of its own as long as
    it can; the rest of each is placed whole, by patterns of a cutting-stock program over the lengths of all documents, or, for
    a small share, cut to fill what the patterns leave free; see plan_sequences(). No sequence is padded: all are full, but for at
    most one for each smaller power of two, which is exactly that long.

    Texts are encoded once. The lengths, crcs and the short ids of the rests are written, 2 bytes a token; a task numbers its
    documents of each length, and the counts by task and length, summed, give their ranks in all. The driver gets one number for
    each length below `room`. Only rows without ids are ever joined by a shuffle, and ids of the few documents that are cut.

    Null and empty texts have only end_id, or no piece without one; null ids and repeated rows are packed as they are; an empty
    table gives no rows; other columns are ignored. Which documents share a sequence depends on the order of the input's rows.
    """
    if room & (room - 1) or room < 2:
        raise ValueError("room must be a power of two")
    with open(tokenizer_file, "rb") as f:
        blob = f.read()
    rows = cut(_encoded(docs, blob, room, end_id, id_col, text_col), "encoded")
    id_type = rows.schema["id"].dataType
    counts = cut(rows.where("tail > 0").groupBy("tail", "part").agg(F.count("*").alias("n")), "lengths")
    plan = plan_sequences({r["tail"]: r["n"] for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect()}, room)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cut(counts.select("tail", "part", F.col("n").alias("m"), before.alias("before")), "starts")
    rank = (F.col("before") + F.col("tail_rank")).alias("rank")
    whole = rows.where("tail > 0").select("part", "id", "n", "tail", "tail_rank", "tail_crc").join(carried(starts.drop("m"), 16), ["tail", "part"])
    whole = _placed(whole.select("id", "n", "tail", rank, "tail_crc"), plan, id_type, ids=False)
    spark = docs.sparkSession
    streamed = F.broadcast(spark.createDataFrame(list(plan.streamed.items()), "tail int, from long"))  # a row for each length
    last = starts.join(streamed, "tail").where(F.col("before") + F.col("m") > F.col("from")).select("tail", "part", "before")
    some = rows.join(F.broadcast(last.groupBy("tail").agg(F.min("part").alias("first"))), "tail").where(F.col("part") >= F.col("first"))
    some = some.select("part", "id", "n", "tail", "tail_rank", "tail_ids").join(carried(last, 16), ["tail", "part"])
    some = _placed(some.select("id", "n", "tail", rank, "tail_ids"), plan, id_type, ids=True)
    own = rows.where(F.size("full_crcs") > 0).select("id", "n", "part", "full", F.posexplode("full_crcs").alias("k", "crc"))
    number = F.shiftleft(F.col("part").cast("long") + 1, 40) + F.col("full") + F.col("k")  # above all numbers of shared sequences
    own = own.select("id", (F.col("k").cast("long") * room).alias("start"), F.lit(room).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return own.unionByName(whole).unionByName(some).withColumnRenamed("id", id_col)
