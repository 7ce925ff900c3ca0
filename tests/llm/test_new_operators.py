"""Packing, importance resampling and periodic runs against brute force, on given and on odd tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from bandloom.llm import cutting_stock, packing, resampling
from bandloom.llm.common import read_table
from bandloom.llm.periodic_runs import find_runs, periodic_runs, strongest
from bandloom.llm.queries import QUERIES, repeated_tail
from tests.llm.data import empty_documents, odd_documents, same_rows

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


# --- 11 packing ---


def tokens(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    return [[*e.ids, 1] for e in tok.encode_batch(list(texts), add_special_tokens=False)]


def holds(pieces, docs, room):
    """Pieces of documents [(id, ids)]: each token once, sequences gapless and full or a smaller power of two, crcs right."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    expected = Counter((i, len(ids)) for i, ids in docs)
    assert by_doc.keys() == expected.keys()
    for key, own in by_doc.items():
        assert Counter(t for p in own for t in range(p["start"], p["start"] + p["length"])) == Counter({t: expected[key] for t in range(key[1])})
    of = defaultdict(list)
    for i, ids in docs:
        of[i, len(ids)].append(np.array(ids, "<u4"))
    for p in pieces:
        assert p["ids_crc32"] in {crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in of[p["doc_id"], p["doc_tokens"]]}
    short = []
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room and at & (at - 1) == 0
        if at < room:
            short.append(at)
    assert len(short) == len(set(short))


@pytest.mark.parametrize("room", [64, 2048])
def test_packing_holds_each_token_once(spark, odd, room):
    got = packing.pack(odd.repartition(3, "doc_id"), BYTE_BPE, room=room).collect()
    rows = odd.select("doc_id", "text").collect()
    holds(got, list(zip([r["doc_id"] for r in rows], tokens(r["text"] or "" for r in rows), strict=True)), room)


def test_packing_of_the_table(spark, sf):
    got = QUERIES["op11_sequence_packing"](spark, sf).collect()
    rows = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    holds(got, list(zip([r["doc_id"] for r in rows], tokens(r["text"] or "" for r in rows), strict=True)), 2048)
    assert len(got) < 1.6 * len(rows)  # few documents are cut beyond what their length asks for


def test_packing_without_broadcasts(spark, odd, monkeypatch):
    monkeypatch.setattr("bandloom.llm.common.CARRIED_BYTES", 0)
    rows = odd.select("doc_id", "text").collect()
    holds(packing.pack(odd, BYTE_BPE, room=256).collect(), list(zip([r["doc_id"] for r in rows], tokens(r["text"] or "" for r in rows), strict=True)), 256)


def test_packing_edges(spark, odd):
    assert packing.pack(empty_documents(spark), BYTE_BPE).collect() == []
    a, b = (packing.pack(odd_documents(spark, extra=x), BYTE_BPE) for x in (False, True))
    assert same_rows(a, b)
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:5] for r in packing.pack(only, BYTE_BPE).collect()] == [(0, 1, crc32(b"\1\0\0\0"), 1)] * 2
    assert packing.pack(only, BYTE_BPE, end_id=None).collect() == []
    with pytest.raises(ValueError):
        packing.pack(only, BYTE_BPE, room=100)


def test_ids_are_those_of_the_tokenizer(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "_MEMO", 200)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    with open(BYTE_BPE, "rb") as f:
        memo = packing.IdMemo(f.read())
    assert memo.merges is not None
    r = random.Random(2)
    odd = ["", " ", "  a  b ", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a\u00a0 b", "a \u00a0b", "\u3000 a", "é è  ê", "a\n b\t c", "it's we'll", "1 2 3 !! ?", "end ", " start", "a\u200b b", "\U0001f600 \U0001f600"]
    odd += ["no.\nNext,\nlast! a.\n b ab.\nab.\nab ,\n", "Ab.cd ab.. ab,\n\nab \u0101b \u0251b ab1 a\u0301", "x" * 90 + " " + "y" * 90 + ".\nz"]
    chars = "ab é.,'1! \n\t\u00a0\u2003<|x"
    odd += ["".join(r.choices(chars, k=r.randint(0, 40))) for _ in range(600)]
    texts = odd + [x["text"] or "" for x in read_table(spark, sf, "documents").collect()]
    for at in range(0, len(texts), 50):
        for t, ids in zip(texts[at : at + 50], memo.ids(texts[at : at + 50]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_best_pattern_is_the_dearest():
    r = random.Random(4)
    for _ in range(30):
        sizes = np.array(sorted(r.sample(range(2, 12), 4)))
        prices = np.array([r.random() for _ in sizes])
        value, pattern = cutting_stock.best_pattern(sizes, prices, 17)
        counts = [(a, b, c, d) for a in range(9) for b in range(9) for c in range(9) for d in range(9) if np.dot((a, b, c, d), sizes) <= 17]
        assert value == pytest.approx(max(np.dot(x, prices) for x in counts)) == pytest.approx(pattern @ prices) and pattern @ sizes <= 17


def test_linear_program_meets_its_bound():
    """Two of three and one of four fit a room of ten: the program finds the fewest rooms, and the demand is met exactly."""
    sizes, demand = np.array([3, 4]), np.array([200.0, 100.0])
    parts = cutting_stock.fractional_patterns(sizes, demand, 10)
    assert sum(t for t, _ in parts) == pytest.approx(100, rel=1e-3)
    assert sum(t * p for t, p in parts) == pytest.approx(demand)
    r = np.random.default_rng(5)
    for _ in range(5):
        sizes = np.arange(5, 200)
        demand = r.integers(0, 500, len(sizes)).astype(float)
        parts = cutting_stock.fractional_patterns(sizes, demand, 512)
        assert sum(t * p for t, p in parts) == pytest.approx(demand, abs=1e-6) and all(p @ sizes <= 512 for _, p in parts)
        assert sum(t for t, _ in parts) <= demand @ sizes / 512 * 1.001


def test_plan_cuts_few_documents():
    r = np.random.default_rng(6)
    counts = Counter((r.lognormal(6, 1, 50_000).astype(int) % 2047 + 1).tolist())
    plan = cutting_stock.plan_sequences(counts, 2048)
    assert sum(counts[n] - k for n, k in plan.streamed.items()) < 0.04 * 50_000
    assert plan.sequences <= sum(n * c for n, c in counts.items()) / 2048 + 12


def byte_memo():
    with open(BYTE_BPE, "rb") as f:
        return packing.IdMemo(f.read())


def test_plain_texts_are_merged_whole():
    from tokenizers import Tokenizer

    tok, memo, r = Tokenizer.from_file(BYTE_BPE), byte_memo(), random.Random(3)
    texts = ["", " ", "a  b", "a   b", "a \t\n b\n\n", "a\n\nb ", "a\r\n\r\nb\n", "\n\n\n", " 's 'll'd 'S x'ves", "12 1,2 \u00d7\u00f7 = 3", "x" * 3000 + " " + "ab" * 3000, "=" * 3000]
    texts += [f"{c}{c}a {c} 1{c} .{c}\n{c}" for c in map(chr, range(0xC0, 0x280))]
    texts += [f"a{c}a {c} 1{c}1 .{c}. {c}{c}{c} 's{c}" for c in sorted(packing.lasting_chars())]
    texts += ["\u201cab\u201d \u2014 \u4e2d\u6587 \U0001f600\U0001f600 \u00a0 \u3000\u3000a\u2003", "\u043f\u0440\u0438 \u05d0\u05d1 \u0623\u0628 \u0967\u0968 \u2167 e\u0301"]
    texts += ["".join(r.choices("abtionerhe \u00e9\u00df.,'1! \n\t\r  ", k=r.randint(0, 60))) for _ in range(4000)]
    for t, ids in zip(texts, memo.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    assert not memo.young and not memo.old  # each new word cost time and memory


def test_texts_that_are_not_plain_are_remembered(spark, sf):
    memo = byte_memo()
    assert [memo._merged(t) for t in ["a<|endoftext|>b", "a\u180eb", "a\x0bb", "a\0b", "a\x85b", "a\u200bb", "\ufeffa", "\u0378", "\u0528"]] == [None] * 9
    texts = [x["text"] or "" for x in read_table(spark, sf, "documents").collect()]
    assert memo._remembered(texts) == memo.ids(texts)
    assert memo.young


def test_ids_where_a_merge_is_never_reached():
    import json

    from tokenizers import Tokenizer

    with open(BYTE_BPE, "rb") as f:
        spec = json.loads(f.read())
    merges = [["a", "b"], ["b", "c"], ["a", "bc"]]  # abc alone becomes ab, c
    spec["model"]["vocab"] = {t: i for t, i in spec["model"]["vocab"].items() if i < 256} | {"".join(m): 256 + k for k, m in enumerate(merges)}
    spec["model"]["merges"], spec["added_tokens"] = merges, []
    blob = json.dumps(spec).encode()
    texts = ["abc bc abc, abcabc", "ab c"]
    want = [e.ids for e in Tokenizer.from_str(blob.decode()).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.IdMemo(blob).ids(texts)] == want


# --- 12 importance resampling ---


WORD = re.compile(resampling.WORD)


def features(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [crc32(x.encode()) % 10_000 for x in (*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))]


def test_resampling_against_brute_force(spark, sf, odd):
    target = spark.createDataFrame([(1, "The alpha BETA"), (2, None), (3, "omega straße straße")], "item_id long, text string")
    rows = odd.select("doc_id", "text").collect()
    hashed = [features(r["text"]) for r in rows]
    s, t = Counter(b for _, f in hashed for b in f), Counter(b for x in target.collect() for b in features(x["text"])[1])
    n, m = sum(s.values()), sum(t.values())
    expected = Counter()
    for r, (w, f) in zip(rows, hashed, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(sha256(f"7:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        expected[r["doc_id"], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))] += 1
    got = resampling.resample(odd, target).collect()
    assert Counter(tuple(r)[:4] for r in got) == expected
    long = {r["doc_id"] for r, (w, _) in zip(rows, hashed, strict=True) if len(w) >= 20}
    n_long = sum(len(w) >= 20 for w, _ in hashed)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 25 * n_long // 100 + 1)) and {r["doc_id"] for r in drawn} <= long
    order = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in drawn]
    assert order == sorted(order)
    least = min(r["score"] for r in drawn)
    assert all(r["score"] <= least for r in got if r["rank"] is None and r["doc_id"] in long and r["doc_id"] is not None and sum(x["doc_id"] == r["doc_id"] for x in got) == 1)


def test_resampling_edges(spark, odd):
    target = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert resampling.resample(empty_documents(spark), target).collect() == []
    assert same_rows(resampling.resample(odd, target), resampling.resample(odd_documents(spark, extra=True), target))
    none = resampling.resample(odd, target.limit(0)).collect()
    assert len(none) == odd.count() and any(r["rank"] == 1 for r in none)
    same = spark.createDataFrame([(5, "word " * 30)] * 40, "doc_id long, text string")
    assert sorted(r["rank"] for r in resampling.resample(same, target).collect() if r["rank"]) == list(range(1, 11))


def test_words_come_from_offsets():
    text = "a-b straße 東京 x1"
    spans = resampling._splitter().pre_tokenize_str(text)
    assert [text[a:b] for _, (a, b) in spans] == ["a", "b", "straße", "東京", "x1"]
    assert resampling.window_crcs(text, spans, 3)[2] == [crc32(x.encode()) for x in ("a b straße", "b straße 東京", "straße 東京 x1")]


# --- 13 periodic runs ---


def brute_runs(w, least, times):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    r = random.Random(1)
    found = 0
    for _ in range(400):
        w = []
        while len(w) < r.randrange(1, 90):
            p = [r.randrange(r.choice([2, 3, 9])) for _ in range(r.randrange(1, 14))]
            w += (p * r.randrange(1, 7))[: r.randrange(1, 70)]
        for least, times in ((1, 3), (24, 3), (6, 4)):
            expected = brute_runs(w, least, times)
            assert [tuple(x) for x in find_runs(np.array(w), least, times).tolist()] == expected
            found += len(expected)
    assert found > 1000


def test_collapsed_texts_and_digests(spark, odd):
    best = periodic_runs(odd, reorder=repeated_tail).select("*", strongest("runs").alias("best")).collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    for r in best:
        seen = []
        for text in texts[r["doc_id"]]:
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            h = 1 if r["doc_id"] is None else crc32(str(r["doc_id"]).encode())
            if h % 10 == 0 and w:
                a = h // 10 % len(w)
                p = 1 + (len(w) - a) // (3 + h // 10 % 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            runs = [(0, len(w), 1)] if len(w) > 5000 and len(set(w)) == 1 else brute_runs(w, 24, 3) if len(w) < 5000 else None
            if runs is None:  # the long text: one run of 30 000 equal words at its start, then lines
                runs = [tuple(x.values()) if isinstance(x, dict) else (x["start"], x["length"], x["period"]) for x in r["runs"]]
                assert runs[0] == (0, 30_000, 1) and len(runs) == 2
            gone = {i for s, n, q in runs for i in range(s + q, s + n)}
            strong = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
            seen.append((runs, " ".join(x for i, x in enumerate(w) if i not in gone), strong))
        assert ([tuple(x) for x in r["runs"]], r["collapsed"], r["best"] and tuple(r["best"])) in seen


def test_runs_edges(spark, odd):
    assert periodic_runs(empty_documents(spark)).collect() == []
    assert same_rows(periodic_runs(odd), periodic_runs(odd_documents(spark, extra=True)))
    assert same_rows(periodic_runs(odd).drop("doc_id"), periodic_runs(odd.repartition(5)).drop("doc_id"))
    with pytest.raises(ValueError):
        periodic_runs(odd, times=2)
    ties = spark.createDataFrame([(1, "a " * 30 + "b " * 30 + "c d " * 60)], "doc_id long, text string")
    r = periodic_runs(ties).select("runs", strongest("runs").alias("best")).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 30, 1), (30, 30, 1), (60, 120, 2)] and r["best"]["length"] == 120
    assert periodic_runs(ties).select(F.size("runs")).first()[0] == 3


# --- 7 wrappers at any length ---


@pytest.mark.parametrize("blocks", [20, 255, 257, 600, 2000])
def test_wrappers_judge_long_pages_as_short_ones(blocks):
    """Every second block is fixed template text; then pairs of a notice and a story as equal neighbours."""
    from bandloom.llm import html_wrappers as hw

    page = lambda i: "<body>" + "".join(f"<div class='k{'abcdefgh'[b % 8]}x{'stuvw'[b % 5]}'>{f'fixed {b}' if b % 2 else f'own {b} {i}'}</div>" for b in range(blocks)) + "</body>"
    pairs = lambda i: "<body>" + "".join(f"<p>Site notice</p><p>Story {b} {i}</p>" for b in range(blocks // 2)) + "</body>"
    for make, want in ((page, [f"own {b} 4" for b in range(0, blocks, 2)]), (pairs, [f"Story {b} 4" for b in range(blocks // 2)])):
        wrapper = hw.Node("", hw.FRESH)
        for i in range(6):
            hw.absorb(wrapper, hw.Page(make(i)).root)
        assert hw.article(hw.Page(make(4)), wrapper) == " ".join(want)
        assert hw.dumped(hw.loaded(hw.dumped(wrapper))) == hw.dumped(wrapper)


def test_all_classes_name_an_element():
    from bandloom.llm import html_wrappers as hw

    keys = {hw._key("div", f" class='{c}'", False)[0] for c in ("aa bb cc x", "aa bb cc y", "x cc bb aa", " ".join(f"long{chr(97 + k)}" for k in range(20)))}
    assert len(keys) == 3 and all(len(k) < 80 for k in keys)


def test_layouts_that_differ_stay_bounded():
    """A host whose pages share nothing: the wrapper stays within a few times the widest page."""
    from bandloom.llm import html_wrappers as hw

    wrapper, r = hw.Node("", hw.FRESH), random.Random(3)
    for i in range(120):
        hw.absorb(wrapper, hw.Page("<body>" + "".join(f"<div class='{''.join(r.choices('abcdefgh', k=5))}'>{i}</div>" for _ in range(30)) + "</body>").root)
    body = wrapper.kids[0]
    assert body.widest == 30 and hw.size(wrapper) < 3 * hw.too_long(body)


# --- near copies over a common template ---


@pytest.mark.parametrize("texts", [300, 900])
def test_texts_over_one_template_are_not_compared_pairwise(spark, monkeypatch, texts):
    """Texts of 140 common and 100 own words, and one near copy of every twentieth: the pairs grow with the texts, not their square."""
    from bandloom.llm import simhash

    monkeypatch.setattr(simhash, "FAMILY_WORK", 400)
    work = []
    whole = simhash.candidate_families

    def counted(*args):
        found = whole(*args)
        work.append(found.where("outside").groupBy("family").agg(F.count("*").alias("n"), F.max("members").alias("m")).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0)
        return found

    monkeypatch.setattr(simhash, "candidate_families", counted)
    r = random.Random(9)
    common = [f"t{i}" for i in range(140)]
    rows = []
    for i in range(texts):
        own = [f"w{r.randrange(50_000)}" for _ in range(100)]
        rows.append((10 * i, " ".join([*common, *own])))
        if i % 20 == 0:
            rows.append((10 * i + 1, " ".join([*common, *own[:-8], *[f"x{r.randrange(50_000)}" for _ in range(8)]])))
    out = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert all(out[i] == i - i % 10 for i, _ in rows)
    assert work[0] < 60 * texts
