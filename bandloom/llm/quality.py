"""Quality classifier: a weak-label model of overlapping heuristic labellers, and a hashed linear scorer trained on its posteriors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, cut, discard, keyed_texts, renamed

#: Different texts that the scorer is trained on, about: those with the smallest hashes. The weak-label model uses all rows.
FIT_ROWS = 8192
#: Labelled ids, about, from which the lexicons are learned, chosen by hash. A word must be LIFT times as frequent in the marked
#: texts as overall, and so clearly that CHANCE words are expected to be it by chance, however many words are tried.
LABELLED_ROWS, LEAST, LIFT, CHANCE = 20_000, 3, 3.0, 1.0
#: Disjoint lexicons into which the learned words fall by a hash, one for each labeller.
LEXICONS = 3
#: Weights of the scorer.
BUCKETS = 1 << 18
ROUNDS, STEP, PENALTY = 150, 0.3, 1e-4
#: Classes of the weak-label model, and what a labeller may say.
CLASSES = GOOD, NOISY, REPETITIVE, TOXIC = range(4)
ABSTAIN, KEEP, REJECT = range(3)

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """the of and to in is that it was for on are with as his they be at one have this from or had by not but what all were
    der die das und ist von zu den mit sich des auf für nicht ein eine als auch es an im
    le la les de des et est un une que qui dans du en il elle au pour pas sur ce
    el los las y que por con para se del al lo una su como más""".encode().split()
)
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#$%&*|<>{}[]=~^@\\_+"
_ENDS = b".,;:?!"
#: Words of a window in which distinct words are counted.
WINDOW = 64


def bare_words(text: bytes) -> list[bytes]:
    return text.lower().translate(None, b".,;:?!\"'()").split()


def measures(text: bytes, lexicons: tuple[frozenset[bytes], ...]) -> tuple[list[bytes], list[float]]:
    """(words, measures): symbols for each word, share of capitals, share of words equal to the one before, share of function
    words, share of distinct words in windows, share of words that end in punctuation, and the words of each lexicon. Shares of
    a few words are drawn towards what is usual."""
    words = text.split()
    n = max(len(words), 1)
    letters = len(text) - n + 1
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    capitals = len(text) - len(text.translate(None, _UPPER))
    same = sum(map(eq, words, words[1:]))
    stops = sum(map(STOP_WORDS.__contains__, words))
    windows = [words[i : i + WINDOW] for i in range(0, len(words), WINDOW)]
    distinct = sum(len(set(w)) for w in windows)
    spaced = b" ".join([*words, b""])
    ends = sum(spaced.count(bytes([c, 32])) for c in _ENDS)
    bare = bare_words(text) if any(lexicons) else []
    hits = [sum(map(lexicon.__contains__, bare)) for lexicon in lexicons]
    return words, [symbols / (n + 1), capitals / (max(letters, 0) + 20), same / n, stops / n, distinct / n, ends / (n + 8), *hits]


def _said(keep: bool, reject: bool) -> int:
    return REJECT if reject else KEEP if keep else ABSTAIN


def votes(n: int, m: list[float], lexicons: tuple[frozenset[bytes], ...]) -> tuple[int, ...]:
    """What the labellers say of a text of n words. They say nothing of a text without words, nor from an empty lexicon."""
    symbols, capitals, same, stops, distinct, ends, *hits = m
    if not n:
        return (ABSTAIN,) * LABELLERS
    return (
        _said(symbols < 0.1, symbols >= 0.45),
        _said(capitals < 0.2, capitals >= 0.5),
        _said(same < 0.05, same >= 0.3),
        _said(stops >= 0.08, n >= 20 and stops < 0.02),
        _said(distinct >= 0.6, n >= 20 and distinct < 0.4),
        _said(0.01 <= ends < 0.4, ends >= 0.6),
        *(_said(not hit, hit >= max(1, n / 400)) if lexicon else ABSTAIN for hit, lexicon in zip(hits, lexicons, strict=True)),
    )


#: The class that each labeller's rejection speaks of.
ABOUT = np.array([NOISY, NOISY, REPETITIVE, NOISY, REPETITIVE, NOISY, *[TOXIC] * LEXICONS])
LABELLERS = len(ABOUT)


@dataclass(frozen=True)
class WeakLabels:
    """prior: of each class. says: (labeller, class, vote) probabilities, from which the labellers' accuracies can be read."""

    prior: np.ndarray
    says: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(self.prior) + sum(np.log(self.says[j][:, patterns[:, j]]).T for j in range(patterns.shape[1]))
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def accuracies(self) -> np.ndarray:
        """Of each labeller: how often it is right where it does not abstain."""
        out = []
        for j, about in enumerate(ABOUT):
            right = self.prior[about] * self.says[j][about, REJECT] + sum(self.prior[c] * self.says[j][c, KEEP] for c in CLASSES if c != about)
            spoke = sum(self.prior[c] * (1 - self.says[j][c, ABSTAIN]) for c in CLASSES)
            out.append(right / max(spoke, 1e-12))
        return np.array(out)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> WeakLabels:
    """Dawid-Skene on counted vote patterns (rows of votes): estimates how each labeller votes in each class, from the
    labellers' agreement alone. It starts from a majority of each group of labellers."""
    rejects = patterns == REJECT
    most = np.array([rejects[:, ABOUT == c].sum(axis=1) for c in CLASSES])
    share = np.full((len(patterns), len(CLASSES)), 0.1 / len(CLASSES))
    share[np.arange(len(patterns)), np.where(most.max(axis=0) >= 2, most.argmax(axis=0), GOOD)] += 0.9
    model = None
    for _ in range(rounds):
        mass = share * counts[:, None]
        prior = (mass.sum(axis=0) + 1) / (mass.sum() + len(CLASSES))
        says = np.empty((patterns.shape[1], len(CLASSES), 3))
        for j in range(patterns.shape[1]):
            for v in range(3):
                says[j, :, v] = mass[patterns[:, j] == v].sum(axis=0) + 0.1
        model = WeakLabels(prior, says / says.sum(axis=2, keepdims=True))
        share = model.posterior(patterns)
    return model


def features(words: list[bytes], n: int, m: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): hashed distinct words, which together weigh at most 1, and hashed levels of the measures."""
    distinct = set(words)
    levels = [*(int(x * 8) for x in m[:6]), *(int(x) for x in m[6:]), int(sum(m[6:])), int(sum(m[6:]) / max(n, 1) * 400)]
    shape = [b"\x00%d:%d" % (i, level) for i, x in enumerate(levels) for level in range(1, min(x, 8) + 1)]  # each level reached
    buckets = np.fromiter((zlib.crc32(w) for w in (*distinct, *shape)), dtype=np.int64, count=len(distinct) + len(shape)) % BUCKETS
    values = np.ones(len(buckets))
    values[: len(distinct)] = 1 / max(n, 1)
    return buckets, values


def train(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic scorer on soft targets, by full-batch Adam. times: how much each row counts."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not len(target):
        return weights, bias
    at, value, share = np.concatenate(rows), np.concatenate(values), times / times.sum()
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    first, second = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for t in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=weights[at] * value, minlength=len(rows)) + bias
        wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * share
        slope = np.r_[np.bincount(at, weights=wrong[row] * value, minlength=BUCKETS) + PENALTY * weights, wrong.sum()]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = STEP * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def learned_lexicons(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, labelled_rows: int = LABELLED_ROWS) -> tuple[frozenset[bytes], ...]:
    """LEXICONS disjoint sets of words that mark the marked ids (column mark: 1, else 0) of a bounded sample of labelled ids."""
    by_id = labelled.where("mark is not null").groupBy("id").agg(F.max("mark").cast("long").alias("mark"))
    part = min(1.0, labelled_rows / max(by_id.count(), 1))
    chosen = by_id.where(F.pmod(F.xxhash64("id", F.lit("lexicon")), F.lit(1 << 30)) < int(part * (1 << 30)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "id")  # about labelled_rows ids

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, mark = [], []
            for m, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = {*bare_words(text or b""), b""}  # the empty word stands in every text
                found += mine
                mark += [m] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(mark, pa.int64())], ["word", "mark"])

    counts = texts.select("mark", "text").mapInArrow(words, "word binary, mark long").groupBy("word").agg(F.sum("mark").alias("hit"), F.count("*").alias("n"))
    counts = cut(counts.where((F.col("n") >= LEAST) | (F.length("word") == 0)), "words")
    whole = counts.where(F.length("word") == 0).first()
    tried = counts.count() - 1
    if whole is None or not whole["hit"]:
        return (frozenset(),) * LEXICONS
    base = F.lit(whole["hit"] / whole["n"])
    share = F.col("hit") / F.col("n")
    # the Chernoff bound of so many marked texts by chance is exp(-evidence)
    evidence = F.col("hit") * F.log(share / base) + F.when(share < 1, (F.col("n") - F.col("hit")) * F.log((1 - share) / (1 - base))).otherwise(0)
    clear = (share >= LIFT * base) & (F.col("hit") >= LEAST) & (evidence >= float(np.log(max(tried, 1) / CHANCE)))
    found = [bytes(r["word"]) for r in counts.where(clear).select("word").collect()]
    discard(counts)
    return tuple(frozenset(w for w in found if zlib.crc32(w) % LEXICONS == k) for k in range(LEXICONS))


def quality_scores(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    fit_rows: int = FIT_ROWS,
    label_id_col: str | None = None,
    labelled_rows: int = LABELLED_ROWS,
) -> DataFrame:
    """Rows (id_col, p_good, p_noisy, p_repetitive, p_toxic, score, keep), one for each row of docs.

    labelled: rows (id, mark) with mark 1 for unwanted language; from a sample of about labelled_rows of their ids, lexicons are
    learned for LEXICONS of the labellers, which say nothing without them. label_id_col: the column of docs that these ids
    match (id_col if not given).

    One pass counts the labellers' vote patterns over all texts (a bounded number of patterns reaches the driver); EM fits
    the labellers' behaviour to the counts. The scorer is trained on the posteriors of about fit_rows texts, chosen by hash, 2
    fit_rows at most; copies of a text are one of them, with their number as its weight, up to a tenth of fit_rows. It scores
    every whole text in a second pass. keep: the score is at least threshold. Nothing is shuffled but counts and the sample.

    Null, empty and wordless texts have score 0 and are not kept; null ids and repeated rows are passed on; id_col may be a
    struct of whole rows; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    learned = learned_lexicons(docs, labelled, label_id_col or id_col, text_col, labelled_rows) if labelled is not None else (frozenset(),) * LEXICONS
    lexicons = spark.sparkContext.broadcast(learned)
    keyed = keyed_texts(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, ...], int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                words, m = measures(text or b"", lexicons.value)
                if words:
                    v = votes(len(words), m, lexicons.value)
                    found[v] = found.get(v, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([bytes(p) for p in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = keyed.select("text").mapInArrow(count, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    counted = sorted((bytes(r["pattern"]), r["n"]) for r in counted)
    patterns = np.array([list(p) for p, _ in counted], dtype=np.int64).reshape(-1, LABELLERS)
    counts = np.array([n for _, n in counted], dtype=np.float64)
    model = expectation_maximisation(patterns, counts) if len(patterns) else WeakLabels(np.full(len(CLASSES), 1 / len(CLASSES)), np.full((LABELLERS, len(CLASSES), 3), 1 / 3))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for hashed, times, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, m = measures(text, lexicons.value)
                if words:
                    at, value = features(words, len(words), m)
                    rows.append((hashed, times, bytes(votes(len(words), m, lexicons.value)), at.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["hash", "times", "pattern", "at", "value"])

    part = min(1.0, fit_rows / max(counts.sum(), 1.0))
    drawn = keyed.where("text is not null").select("text", F.xxhash64("text", F.lit("fit")).alias("hash"))
    drawn = drawn.where(F.shiftrightunsigned("hash", 34) < int(part * (1 << 30)))
    drawn = drawn.groupBy("hash").agg(F.count("*").alias("times"), F.first("text").alias("text"))  # equal texts meet as one row of each task
    sample = drawn.mapInArrow(describe, "hash long, times long, pattern binary, at binary, value binary").orderBy("hash").limit(2 * fit_rows).toArrow().to_pydict()
    chosen_votes = np.array([list(p) for p in sample["pattern"]], dtype=np.int64).reshape(-1, LABELLERS)
    rows = [np.frombuffer(x, "<i4") for x in sample["at"]]
    values = [np.frombuffer(x, "<f4") for x in sample["value"]]
    times = np.minimum(np.array(sample["times"], dtype=np.float64), max(fit_rows / 10, 1))
    weights, bias = train(rows, values, model.posterior(chosen_votes)[:, GOOD], times)
    del sample, rows, values
    sent = spark.sparkContext.broadcast((model, weights, bias))

    outputs = ["p_good", "p_noisy", "p_repetitive", "p_toxic", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = sent.value
        for b in batches:
            scores, said = np.zeros(b.num_rows), np.zeros((b.num_rows, LABELLERS), dtype=np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                words, m = measures(text or b"", lexicons.value)
                if words:
                    at, value = features(words, len(words), m)
                    scores[i] = 1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -30, 30)))
                    said[i] = votes(len(words), m, lexicons.value)
            p = model.posterior(said)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(p[:, c])) for c in CLASSES), pa.array(scores)], ["id", *outputs])

    schema = T.StructType([renamed(keyed.schema["id"], "id"), *(T.StructField(n, T.DoubleType()) for n in outputs)])
    return keyed.mapInArrow(score, schema).select(F.col("id").alias(id_col), *outputs, (F.col("score") >= threshold).alias("keep"))
