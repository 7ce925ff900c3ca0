"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import SPACES, bounded_batches, keyed_texts, renamed

#: Bytes of pieces that go into one call of the tokenizer, and beyond which a text is split.
ENCODE_BYTES = 1 << 18
#: Texts that are cut into pieces together.
GROUP_BYTES = 1 << 21
#: Bytes of the pieces whose lengths a worker remembers, and of the longest of them; the memory is emptied when it is full.
MEMO_BYTES, MEMO_PIECE = 8 << 20, 48

#: Whether all that a pattern matches are words, digits or signs without white space: alternatives of these forms only.
_WORD_FORMS = re.compile(r"(?:\[\^\\s[^\]\[]*\]\+?|\[?\\p\{[LN]\}\]?\+?|'[a-z]+|\||\(\?i:|\))*")
#: A space between two visible ASCII characters.
_SPACE = re.compile(rb"(?<=[!-~]) (?=[!-~])")

WORDS, BEFORE_SPACE, AT_SPACE, WHOLE = "words", "before a space", "at a space", "whole"


def _steps(part: dict | None) -> list[dict]:
    """The parts of a normalizer or pre-tokenizer in order."""
    if not part:
        return []
    inner = part.get("pretokenizers", part.get("normalizers"))
    return [x for p in inner for x in _steps(p)] if inner is not None else [part]


def boundary(kind: str, tok: object, spec: dict) -> str:
    """Where texts may be cut without a change of their tokens, by what the tokenizer's file says.

    WORDS: at all ASCII white space, which only separates tokens. BEFORE_SPACE: before a space between two visible characters,
    as a token takes one space before it. AT_SPACE: such a space goes, as every piece begins with one again. WHOLE: nowhere.
    """
    if kind == "sentencepiece":
        pieces = (tok.id_to_piece(i) for i in range(tok.get_piece_size()))
        marked = tok.encode("a", out_type=str)[:1] == ["\u2581a"] or tok.encode("a", out_type=str)[:1] == ["\u2581"]
        return AT_SPACE if marked and not any(p.strip("\u2581") and "\u2581" in p.lstrip("\u2581") for p in pieces) else WHOLE
    if any(a.get("lstrip") or a.get("rstrip") or set(a["content"]) & set(SPACES) for a in spec.get("added_tokens", ())) or spec["model"]["type"] != "BPE":
        return WHOLE
    normal, before = _steps(spec.get("normalizer")), _steps(spec.get("pre_tokenizer"))
    if not before:
        return WHOLE
    first = before[0]
    spaced = all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in normal)
    if spaced and (first["type"] == "WhitespaceSplit" or (first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and _WORD_FORMS.fullmatch(first["pattern"].get("Regex", "x")))):
        return WORDS if not any(x.get("add_prefix_space") for x in before) else WHOLE
    if not normal and len(before) == 1 and first["type"] == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]:
        return BEFORE_SPACE
    return WHOLE


class _Loaded:
    """One tokenizer of a worker process, where it may cut texts, and its memory of lengths."""

    def __init__(self, kind: str, blob: bytes) -> None:
        self.kind, self.memo, self.held, spec = kind, {}, 0, {}
        if kind == "tokenizers":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_str(blob.decode())
            self.tok.no_truncation()
            self.tok.no_padding()
            spec = json.loads(self.tok.to_str())
        else:
            import sentencepiece

            self.tok = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.boundary = boundary(kind, self.tok, spec)

    def lengths(self, pieces: list[bytes]) -> Iterator[int]:
        """Token counts, encoded in calls that hold about the same number of bytes each."""
        at = 0
        while at < len(pieces):
            end, room = at, ENCODE_BYTES
            while end < len(pieces) and (end == at or room >= len(pieces[end])):
                room -= len(pieces[end])
                end += 1
            texts = [p.decode("utf-8", "replace") for p in pieces[at:end]]
            if self.kind == "tokenizers":
                yield from (len(x) for x in self.tok.encode_batch_fast(texts, add_special_tokens=False))
            else:
                yield from map(len, self.tok.encode(texts, num_threads=1))
            at = end

    def of_words(self, texts: list[bytes]) -> Iterator[int]:
        """Token counts of texts whose words are encoded one by one, equal short ones once."""
        at = 0
        while at < len(texts):
            end, room = at, GROUP_BYTES
            while end < len(texts) and (end == at or room >= len(texts[end])):
                room -= len(texts[end])
                end += 1
            pieces = [t.split() for t in texts[at:end]]
            if self.held > MEMO_BYTES:
                self.memo.clear()
                self.held = 0
            new = list(set(chain.from_iterable(pieces)) - self.memo.keys())
            self.memo.update(zip(new, self.lengths(new), strict=True))
            yield from (sum(map(self.memo.__getitem__, p)) for p in pieces)
            for w in new:
                if len(w) > MEMO_PIECE:
                    del self.memo[w]
                else:
                    self.held += len(w) + 64
            at = end

    def cut(self, text: bytes) -> list[bytes]:
        """A long text in pieces of about ENCODE_BYTES."""
        if len(text) <= ENCODE_BYTES or self.boundary == WHOLE:
            return [text]
        out, start = [], 0
        while (m := _SPACE.search(text, start + ENCODE_BYTES)) is not None:
            out.append(text[start : m.start()])
            start = m.start() if self.boundary == BEFORE_SPACE else m.end()
        return [*out, text[start:]]


_loaded: dict[str, _Loaded] = {}


def count_tokens(texts: list[bytes], kind: str, blob: bytes) -> list[int]:
    """The number of tokens of every whole text."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _loaded:
        _loaded[key] = _Loaded(kind, blob)
    tok = _loaded[key]
    if tok.boundary == WORDS:
        return list(tok.of_words(texts))
    pieces = [tok.cut(t) for t in texts]
    lengths = tok.lengths([p for some in pieces for p in some])
    return [sum(next(lengths) for _ in some) for some in pieces]


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens), one for each row of docs, without a shuffle.

    tokenizer_file: a .json file of the tokenizers library or a .model file of sentencepiece. The driver reads it once and
    the tasks carry its bytes (a vocabulary file; its size does not depend on the corpus). Where texts may be cut is read off
    the tokenizer's file, see boundary(): at all white space, where equal words are then encoded once, or long ones at spaces. All
    calls of the tokenizer hold about the same bytes. A tokenizer that allows no cut gets whole texts.

    Null texts count as empty (0 bytes, 0 tokens); null ids and repeated rows are passed on as they are; an empty table gives
    no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    kind = "sentencepiece" if tokenizer_file.endswith(".model") else "tokenizers"
    with open(tokenizer_file, "rb") as f:
        blob = f.read()
    shipped = docs.sparkSession.sparkContext.broadcast(blob)
    keyed = keyed_texts(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(count_tokens(texts, kind, shipped.value), pa.int64())], ["id", "n_bytes", "n_tokens"])

    schema = T.StructType([renamed(keyed.schema["id"], "id"), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return keyed.mapInArrow(count, schema).select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
