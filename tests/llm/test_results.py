"""Operators against brute force, exact properties and held-out labels."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from bandloom.llm import exact_topk as tk
from bandloom.llm import html_wrappers as hw
from bandloom.llm import token_counts as tc
from bandloom.llm import quality, sharding
from bandloom.llm.common import read_table
from bandloom.llm.decontaminate import Phrases, decontaminate, shard_hits
from bandloom.llm.fm_index import FMIndex, Wavelet, suffix_array
from bandloom.llm.license_scan import TEMPLATES, TemplateIndex, base_places, license_scan, step_of
from bandloom.llm.line_dedup import _Runs, bitmap, kept_lines, line_dedup, line_key
from bandloom.llm.mixing import mix_sources, splitting_tree, water_fill
from bandloom.llm.quality import quality_scores
from bandloom.llm.queries import QUERIES, toxic_labels
from bandloom.llm.sharding import kd_shards
from bandloom.llm.simhash import connected_components, fingerprint, simhash_groups, trie_links
from bandloom.llm.sql import ORACLE_SQL
from tests.compare import difference, duck
from tests.llm.data import odd_documents


@pytest.fixture(scope="module")
def odd(spark):
    return odd_documents(spark).cache()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(name, spark, sf):
    assert difference(QUERIES[name](spark, sf), duck(sf), ORACLE_SQL[name]) is None


# --- 1 mixing ---


def test_targets():
    assert water_fill([100, 100, 100], [3, 1, 2], 1.5, 2.0) == pytest.approx([200, 250 / 3, 500 / 3])
    assert water_fill([10, 1000], [3, 1], 1.5, 2.0) == pytest.approx([20, 1495])
    assert water_fill([0, 5], [1, 1], 1.5, 2.0) == pytest.approx([0, 7.5]) and water_fill([], [], 1.5, 2.0) == []


def test_splitting_tree_keeps_both_margins():
    quotas = np.array([5, 0, 17, 40, 1])
    dealt = splitting_tree(quotas, 6, np.random.default_rng(1))
    assert (dealt.sum(axis=1) == quotas).all() and np.ptp(dealt.sum(axis=0)) <= 1 and (dealt >= 0).all()


@pytest.mark.parametrize("few", [True, False])
def test_mix(spark, sf, monkeypatch, few):
    """Against brute force: each row's draws are those of its block, a source's blocks go to shards by exact quotas, and all draws
    differ. few: blocks of few words, so that several passes and parts of blocks are drawn."""
    from bandloom.llm import mixing

    if few:
        monkeypatch.setattr(mixing, "BLOCK_WORDS", 2000)
    dealt = []
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, rng, tree=splitting_tree: dealt.append(tree(q, n, rng)) or dealt[-1])
    docs = read_table(spark, sf, "documents")
    rows = mix_sources(docs, shards=4).collect()
    by, sizes = defaultdict(list), {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    places = []
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and len(r["draws"]) <= 2 and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        by[r["source"]].append(r)
        places += [(d["shard"], d["place"]) for d in r["draws"]]
    for mine in by.values():
        taken, target = sum(r["size"] * len(r["draws"]) for r in mine), mine[0]["target"]
        assert mine[0]["source_size"] == sum(r["size"] for r in mine)
        assert abs(taken - target) <= max(r["size"] for r in mine) / 2 + 1
    assert len(set(places)) == len(places) and {s for s, _ in places} == {0, 1, 2, 3}
    again = {r["doc_id"]: r["draws"] for r in mix_sources(docs.repartition(7), shards=4).collect()}
    assert again == {r["doc_id"]: r["draws"] for r in rows}
    keys = {r["doc_id"]: r["key"] for r in mixing.sized(docs, F.col("doc_id"), "source", "text", "doc_id", 42).withColumnRenamed("payload", "doc_id").collect()}
    total = sum(sizes.values())
    block = max(1, min(mixing.BLOCK_WORDS, total // (4 * mixing.BLOCKS_PER_SHARD)))
    for i, source in enumerate(sorted(by, key=lambda x: (x is None, x))):
        mine, drawn = by[source], defaultdict(set)
        blocks = max(1, mine[0]["source_size"] // block)
        for r in mine:
            for d in r["draws"]:
                drawn[keys[r["doc_id"]] % blocks, d["pass"]].add(d["shard"])
        assert all(len(shards) == 1 for shards in drawn.values())
        got = Counter(s for shards in drawn.values() for s in shards)
        quota = dealt[-1][i]
        assert all(got[k] <= quota[k] for k in range(4)) and sum(quota) <= 2 * blocks
        if mine[0]["target"] == 2 * mine[0]["source_size"]:  # two whole passes: only blocks without rows are not seen
            assert sum(got.values()) == 2 * len({keys[r["doc_id"]] % blocks for r in mine})


def test_the_tree_decides_what_is_drawn(spark, sf, monkeypatch):
    from bandloom.llm import mixing

    docs = read_table(spark, sf, "documents")
    want = {r["doc_id"]: r["draws"] for r in mix_sources(docs, shards=4).collect()}
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, rng: np.c_[q // 2, np.zeros((len(q), n - 1), dtype=np.int64)])
    got = {r["doc_id"]: r["draws"] for r in mix_sources(docs, shards=4).collect()}
    assert {d["shard"] for x in got.values() for d in x} == {0} and sum(map(len, got.values())) < 0.7 * sum(map(len, want.values()))


def test_mixed_rows_lie_in_shards_and_places(spark, sf, monkeypatch):
    from bandloom.llm import mixing

    docs = read_table(spark, sf, "documents").select("doc_id", "source", "text")
    want = Counter((r["doc_id"], d["shard"], d["place"]) for r in mix_sources(docs, shards=4).collect() for d in r["draws"])
    place_of = defaultdict(list)
    for i, shard, place in want:
        place_of[i].append((shard, place))
    parts = [p for p in mixing.mixed_rows(docs, shards=4).select("doc_id").rdd.glom().collect() if p]
    assert Counter(r["doc_id"] for p in parts for r in p) == Counter(i for i, *_ in want.elements())
    for p in parts:
        now = (-1, -(2**63))
        for r in p:  # each row's place is the next one of its draws: shards in order, places in order
            now = min(x for x in place_of[r["doc_id"]] if x > now)


# --- 2 quality ---


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    known = toxic_labels(spark, sf).where("id % 2 = 0")
    rows = quality_scores(docs, known).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    keep = lambda q, t: [r["keep"] for r in rows if r["quality"] == q and r["toxic"] == t]
    assert np.mean(keep(1, 0)) >= 0.97 and np.mean(keep(0, 0)) <= 0.1 and np.mean(keep(1, 1)) <= 0.4
    plain = {r["doc_id"]: r["keep"] for r in quality_scores(docs).collect()}
    assert np.mean([plain[r["doc_id"]] for r in labels.where("quality = 1 and toxic = 0").collect()]) >= 0.97


def test_lexicons_come_from_labels_alone(spark):
    """Any words mark the marked texts; words that are rare or frequent by chance are not learned, and lexicons are disjoint."""
    r = random.Random(4)
    vocabulary = [f"word{i}" for i in range(4000)]
    rows = []
    for i in range(600):
        marked = i % 10 == 0
        words = r.choices(vocabulary, k=120) + (r.sample([f"bad{k}" for k in range(12)], 6) if marked else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), int(marked)))
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    lexicons = quality.learned_lexicons(df, df.selectExpr("doc_id as id", "mark"), "doc_id", "text")
    found = [w for lexicon in lexicons for w in lexicon]
    assert len(found) == len(set(found)) and {b"bad%d" % k for k in range(12)} <= set(found) and len(found) <= 14
    assert quality.learned_lexicons(df, df.selectExpr("doc_id as id", "0 as mark"), "doc_id", "text") == (frozenset(),) * quality.LEXICONS


def test_copies_do_not_swell_the_sample(spark, monkeypatch):
    """Half of all rows are one text: it comes to the driver once, if at all."""
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows, values, target, times: seen.append((len(rows), times)) or (np.zeros(quality.BUCKETS), 0.0))
    df = spark.range(20_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'the one text of many copies', concat('text ', id, ' of the rest')) as text")
    for fit_rows in (100, 20_000):
        quality_scores(df, fit_rows=fit_rows)
    assert seen[0][0] <= 200 and seen[1][0] <= 10_001 and max(seen[1][1]) == 2000


def test_accuracies_are_estimated_from_agreement_alone():
    """Votes of labellers with known error rates: EM finds these rates without seeing a label."""
    rng = np.random.default_rng(3)
    truth = rng.choice(4, 40_000, p=[0.7, 0.1, 0.1, 0.1])
    wrong = np.linspace(0.03, 0.2, quality.LABELLERS)
    reject = (truth[:, None] == quality.ABOUT) ^ (rng.random((len(truth), quality.LABELLERS)) < wrong)
    patterns, counts = np.unique(np.where(reject, quality.REJECT, quality.KEEP), axis=0, return_counts=True)
    model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert np.abs(model.accuracies() - (1 - wrong)).max() < 0.03 and np.abs(model.prior - [0.7, 0.1, 0.1, 0.1]).max() < 0.03


# --- 3 SimHash ---


def _components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("budget", [0, 1, 3, 5])
def test_trie_join_against_all_pairs(budget):
    rng = np.random.default_rng(budget)
    centres = rng.integers(0, 2**63, 4, dtype=np.uint64)
    values = {int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)))) for c in centres for _ in range(90)}
    v = np.array(sorted(values), dtype=np.uint64)
    u, w = trie_links(v, np.array([[0, len(v), 0, len(v)]]), 64, budget)
    d = np.bitwise_count(v[:, None] ^ v[None, :])
    pairs = np.argwhere(np.triu(d <= budget, 1))
    assert _components(len(v), zip(u, w, strict=True)) == _components(len(v), pairs) and len(u) < len(v)


def _fingerprint(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("small", [True, False])
def test_simhash_groups(spark, odd, sf, monkeypatch, small):
    if small:  # tries of more than four rows are split into pairs of subtrees, as deep as it takes, and tasks hold few rows
        monkeypatch.setattr("bandloom.llm.simhash.TRIE_ROWS", 4)
        monkeypatch.setattr("bandloom.llm.simhash.HELD_ROWS", 16)
    docs = odd.select("doc_id", "text").unionAll(read_table(spark, sf, "documents").select(F.col("doc_id") + 1000, "text"))
    rows = docs.collect()
    fps = [_fingerprint(r["text"] or "") for r in rows]
    distinct = sorted(set(fps))
    near = [(i, j) for i in range(len(distinct)) for j in range(i) if (distinct[i] ^ distinct[j]).bit_count() <= 3]
    root = dict(zip(distinct, _components(len(distinct), near), strict=True))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r["doc_id"] is not None:
            least[root[f]] = min(least.get(root[f], r["doc_id"]), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True))
    assert Counter(map(tuple, simhash_groups(docs).collect())) == want


def test_dense_tries_are_split_as_deep_as_it_takes(spark, monkeypatch):
    """Fingerprints that share all but their last bits: no fixed number of levels would part them."""
    from bandloom.llm import simhash

    monkeypatch.setattr(simhash, "TRIE_ROWS", 12)
    r = random.Random(12)
    values = sorted({r.getrandbits(9) for _ in range(150)} | {r.getrandbits(9) << 40 for _ in range(50)} | {2**64 - 1 - r.getrandbits(12) for _ in range(60)})
    links = simhash.near_links(spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long"), 2).collect()
    at = {v: i for i, v in enumerate(values)}
    pairs = [(at[x["u"] % 2**64], at[x["v"] % 2**64]) for x in links]
    assert all((values[i] ^ values[j]).bit_count() <= 2 for i, j in pairs)
    near = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert _components(len(values), pairs) == _components(len(values), near)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 977}" for i in range(200_000))
    assert fingerprint(text.encode(), 3, 42) == _fingerprint(text)


@pytest.mark.parametrize("hubs", [1000, 3])
def test_components_of_a_long_chain(spark, monkeypatch, hubs):
    monkeypatch.setattr("bandloom.llm.simhash.HUBS", hubs)
    if hubs < 1000:
        monkeypatch.setattr("bandloom.llm.simhash.HUB_LINKS", 2)
    chain = [(i + 1, i) for i in range(60)] + [(100, 90), (101, 100)]
    rows = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert rows == {**dict.fromkeys(range(1, 61), 0), 100: 90, 101: 90}


# --- 4 decontamination ---


def test_fm_index_against_scans():
    rng = np.random.default_rng(2)
    runs = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(30)] + [np.ones(50, dtype=int)] * 3
    text = np.concatenate([np.r_[x, 0] for x in runs])
    order = suffix_array(text)
    assert sorted(order) == list(range(len(text)))
    w = Wavelet(text, 4)
    places = np.arange(len(text))
    assert (w.access(places)[0] == text).all()
    assert all((w.rank(np.full(len(text) + 1, s), np.arange(len(text) + 1)) == np.r_[0, np.cumsum(text == s)]).all() for s in range(5))
    index = FMIndex(text, 4)
    for length in (1, 2, 4):
        patterns = np.unique(rng.integers(1, 5, (60, length)), axis=0)
        lo, hi = index.search(patterns, np.full(len(patterns), length))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(text) - length + 1) if (text[i : i + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


def test_hits_against_scans():
    r = random.Random(3)
    words = [b"a", b"b", b"c", b"dd", b"e"]
    for _ in range(25):
        items = [(str(i) if i else None, b" ".join(r.choices(words[:4], k=r.choice([0, 1, 2, 3, 5, 7])))) for i in range(6)]
        docs = [r.choices(words, k=r.randint(0, 60)) for _ in range(15)]
        for doc, (starts, ends, names) in zip(docs + docs[:2], shard_hits(docs + docs[:2], Phrases(items, 3)), strict=True):
            hit, who = set(), set()
            for name, text in items:
                w = text.split()
                for a in range(max(1, len(w) - 2) if w else 0):
                    x = w[a : a + 3]
                    for k in range(len(doc) - len(x) + 1):
                        if doc[k : k + len(x)] == x:
                            hit |= set(range(k, k + len(x)))
                            who.add(name)
            assert {i for s, e in zip(starts, ends, strict=True) for i in range(s, e)} == hit and names == sorted(x for x in who if x)


def test_passes_and_shards_do_not_matter(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(["the of and", "alpha", "beta gamma delta", "x1 42", "long long"])] + [(9, "to in")], "item_id long, text string")
    key = lambda df: sorted(map(repr, df.collect()))
    whole = key(decontaminate(odd, bench, window=2))
    assert key(decontaminate(odd, bench, window=2, pass_bytes=12)) == whole
    monkeypatch.setattr("bandloom.llm.decontaminate.SHARD_WORDS", 50)
    assert key(decontaminate(odd, bench, window=2)) == whole


# --- 5 licences ---


def test_template_join_is_exact():
    r = random.Random(11)
    vocabulary = sorted({w for t, _ in TEMPLATES for w in t.split()}) + ["zz", "yy"]
    for threshold in (0.5, 0.8, 1.0):
        index = TemplateIndex(TEMPLATES, {w.encode(): r.randint(0, 50) for w in vocabulary}, threshold)
        for _ in range(400):
            base = TEMPLATES[r.randrange(len(TEMPLATES))][0].split()
            words = r.sample(base, r.randint(1, len(base))) + r.choices(vocabulary, k=r.randint(0, 8))
            block = [w.encode() for w in words]
            want = {(t, len(set(text.split()) & set(words)) / len(set(text.split()))) for t, (text, _) in enumerate(TEMPLATES)}
            assert set(index.matches(block)) == {(t, s) for t, s in want if s >= threshold}


def test_base_places_overlap():
    assert base_places(b" cc by cc by x mit license ", (("cc by", "cc-by"), ("mit license", "mit"))) == (3, 0, 5, {"cc-by", "mit"})
    assert base_places(b" ", (("cc by", "cc-by"),)) == (0, None, None, set())


def test_wrapped_notices(spark):
    """Sentences and whole licence texts, wrapped at any width and commented, anywhere in a text."""
    import textwrap

    rows = []
    for i, (text, _) in enumerate(TEMPLATES):
        for width, before in ((25, 0), (70, 29), (72, 41), (78, 63), (78, 700)):
            lines = textwrap.wrap(text, width)
            rows.append((1000 * i + before, "x\n" * before + " * " + "\n * ".join(lines) + "\n" + "y\n" * 300))
    for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert TEMPLATES[r["doc_id"] // 1000][1] in r["labels"].split(",") and r["score"] == 1.0


def test_license_blocks_against_every_template(spark):
    """Brute force without filters: every window and line with every template."""
    r = random.Random(15)
    rows = []
    for i in range(60):
        words = []
        while len(words) < 700:
            text = r.choice(TEMPLATES)[0].split()
            some = [w for w in text if r.random() < r.choice([0.7, 0.85, 1.0])]
            words += some + r.choices(["aa", "bb", "cc", "the", "license"], k=r.randint(0, 300))
        rows.append((i, "".join(w + r.choice([" "] * 9 + ["\n"]) for w in words[: r.choice([20, 90, 400, 700])])))
    for out in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        text = rows[out["doc_id"]][1]
        words, labels, best = text.split(), set(filter(None, out["base_labels"].split(","))), 0.0
        for template, label in TEMPLATES:
            step = step_of(template)
            spans = [words, *([line.split() for line in text.split("\n")] if step == 32 else [])]
            for span in spans:
                for at in [0, *range(step, max(len(span) - step, 0), step)]:
                    share = len(set(span[at : at + 2 * step]) & set(template.split())) / len(set(template.split()))
                    if share >= 0.8:
                        labels.add(label)
                        best = max(best, share)
        assert out["labels"] == ",".join(sorted(labels)) and out["score"] == best


# --- 6 tokens ---


ODD_TEXTS = ["a <|endoftext|> b<|startoftext|>", "é é ́x", "\x1c\x1d a\x85b\xa0c  d", "it's  we'll\tI'M", "ΑΣ ΣΑΣ", "", "  ", "日本語 テスト１２", "w" * 5000 + " " + "x" * 9, "a  b   c \n d e", " a b ", "1 2.3 ,4 \u2003 x"]


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name,where", [("word_bpe_49k.json", tc.WORDS), ("byte_bpe_50k.json", tc.BEFORE_SPACE), ("piece_bpe_32k.model", tc.AT_SPACE)])
def test_lengths_are_the_librarys(name, where, small, spark, sf, monkeypatch):
    """All texts whole and in the library's own way; small: texts are cut at every other space, and nothing is remembered."""
    if small:
        monkeypatch.setattr(tc, "ENCODE_BYTES", 7)
        monkeypatch.setattr(tc, "MEMO_BYTES", 0)
    monkeypatch.setattr(tc, "_loaded", {})
    texts = [r["text"] or "" for r in read_table(spark, sf, "documents").limit(60 if small else 1000).collect()] + ODD_TEXTS + [" ".join(ODD_TEXTS)]
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    else:
        import sentencepiece

        whole = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    with open(path, "rb") as f:
        assert tc.count_tokens([t.encode() for t in texts], "tokenizers" if name.endswith(".json") else "sentencepiece", f.read()) == whole
    assert [t.boundary for t in tc._loaded.values()] == [where]


def test_boundaries_that_are_not_safe():
    with open(public_tokenizers.path("word_bpe_49k.json")) as f:
        import json

        spec = json.load(f)
    assert tc.boundary("tokenizers", None, spec) == tc.WORDS
    for change in ({"pre_tokenizer": None}, {"added_tokens": [{"content": "a b"}]}, {"normalizer": {"type": "Prepend", "prepend": "x"}}, {"pre_tokenizer": {"type": "Split", "pattern": {"Regex": "\\s+"}, "behavior": "Removed", "invert": True}}):
        assert tc.boundary("tokenizers", None, spec | change) == tc.WHOLE


# --- 7 pages ---


def test_article_of_generated_pages(spark, sf):
    import re

    pages = {r["page_id"]: r["html"] for r in read_table(spark, sf, "pages").collect()}
    out = QUERIES["op7_html_extraction"](spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(unescape(re.sub(r"<[^>]*>", " ", inside)).split()) and r["n_chars"] == len(r["text"])


HARD = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body><div class="site-header">no</div>
<header>no</header><aside class=x>no</aside><main><article><header><h1>Head &lt;1&gt;</h1></header><p>one <b>t</b>wo<br>three<p>four
<script>"</p>no"</script><form>no</form><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><div class="comment-list"><p>no</p></div>
<div class="newsletter-box">no</div><p title="a>b" hidden>no</p>five&nbsp;&copy;</article></main><footer>no</footer><!-- no --></body></html>"""


def wrapper_of(*pages):
    wrapper = hw.Node("", hw.FRESH)
    for p in pages:
        hw.absorb(wrapper, hw.Page(p).root)
    return wrapper


def test_article_with_traps():
    assert hw.article(hw.Page(HARD), wrapper_of(HARD)) == "Head <1> one two three four a b c d five ©"


def test_pages_without_an_article_use_the_varying_text():
    html = "<body><div class='a'><p>Same words everywhere on this site</p></div><div class='b'><p>{0} first</p><p>{0} second and more words</p></div></body>"
    pages = [html.format(i) for i in range(4)]
    assert hw.article(hw.Page(pages[2]), wrapper_of(*pages)) == "2 first 2 second and more words"


def test_alignment_tells_slots_of_one_path_apart():
    """Template text and article stand at one path, so only their places in the aligned pages tell them apart."""
    pages = [f"<body><div><p>Slogan</p></div><div><p>text {i}</p>{'<p>more</p>' * (i % 3)}</div><div><p>Imprint</p></div></body>" for i in range(7)]
    wrapper = wrapper_of(*pages)
    assert hw.expression(wrapper) == "(<body>(<div>(<p>#SAME</>)</>)(<div>(<p>#TEXT</>)+</>)(<div>(<p>#SAME</>)</>)</>)"
    assert [hw.article(hw.Page(p), wrapper) for p in pages] == [" ".join([f"text {i}", *["more"] * (i % 3)]) for i in range(7)]


def test_names_of_classes_inside_articles():
    """Words in a name do not drop text of an article; only what the wrapper shows to be template text, or sure names, do."""
    names = "ad-hoc share-capital related-work popup-book notice social-history skip-list comment".split()
    page = lambda i: "<article><p>a</p>" + "".join(f"<div class='{c}'>{c} {i}</div>" for c in names) + "<div class='share'>Share</div><ol class='comments'><li>no</ol></article>"
    wrapper = wrapper_of(*map(page, range(4)))
    assert hw.article(hw.Page(page(1)), wrapper) == "a " + " ".join(f"{c} 1" for c in names)
    assert hw.article(hw.Page(page(1)), wrapper_of(page(1))) == "a " + " ".join(f"{c} 1" for c in names) + " Share"


def test_deep_wide_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 4000 + "<p>end"
    wide = "".join(f"<{'p h2 h3 ul'.split()[i * 7919 % 11 % 4]} class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}'>{i} " for i in range(9000))
    long = "<p>" + "words " * 200_000
    rows = [(i, "http://odd.org/", x) for i, x in enumerate([deep, wide, long, deep, "<a " * 50_000, "</x>" * 50_000 + "t"])]
    out = {r["page_id"]: r["text"] for r in hw.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[0] == out[3] == "deep end" and out[1] == " ".join(map(str, range(9000))) and len(out[2]) == 1_199_999 and out[5] == "t"


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark, sf, monkeypatch):
    pages = read_table(spark, sf, "pages")
    plain = pages.withColumn("html", F.regexp_replace("html", "<(/?)article>", "<$1section>"))
    want = [sorted(map(tuple, hw.extract_articles(df).collect())) for df in (pages, plain)]
    assert sum(x != y for x, y in zip(*want, strict=True)) <= 0.1 * len(want[0])  # sections between a menu and a footer
    monkeypatch.setattr(hw, "CARRIED", 0)
    monkeypatch.setattr(hw, "FAN", 3)
    dealt = [sorted(map(tuple, hw.extract_articles(df.repartition(9)).collect())) for df in (pages, plain)]
    assert dealt[0] == want[0] and sum(x != y for x, y in zip(dealt[1], want[1], strict=True)) <= 0.02 * len(want[1])


PLAIN = "<body><div class='top'><p>Site name</p></div><div class='{2}'><h2>{0} title</h2><p>{0} {1}</p></div><div class='{2}-more'><p>{0} rest</p></div><div class='footer'>no</div></body>"


@pytest.mark.parametrize("url", ["'http://mixed.org/' || page_id", "cast(null as string)"])
def test_a_host_of_several_templates(spark, url):
    """Pages with an article, and pages of a large and a small layout without one, whose text stands in two blocks."""
    rows, want = [], {}
    for i in range(30):
        kind = ("a", "big", "big", "big", "big", "small")[i % 6]
        long = "words " * (40 if kind == "big" else 3)
        rows.append((i, f"<body><p>no</p><article><p>text {i}</p></article></body>" if kind == "a" else PLAIN.format(f"page{i}", long, kind)))
        want[i] = f"text {i}" if kind == "a" else f"page{i} title page{i} {long.strip()} page{i} rest"
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", f"{url} as url", "html")
    assert {r["page_id"]: r["text"] for r in hw.extract_articles(pages).collect()} == want


def test_copies_of_a_page_do_not_make_its_text_a_template(spark):
    html = "<body><div class='nav'>no</div><div class='b'><h2>Title</h2><p>{} text</p></div></body>"
    rows = [(i, "http://copies.org/1", html.format("one")) for i in range(4)] + [(10 + i, f"http://mirrored.org/{i}", html.format("ab"[i == 3])) for i in range(4)]
    out = {r["page_id"]: r["text"] for r in hw.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {**{i: "Title one text" for i in range(4)}, **{10 + i: f"Title {'ab'[i == 3]} text" for i in range(4)}}


def test_wrappers_align():
    a, b = "<body><h1>t</h1><p>x<p>y<ul><li>1<li>2</ul></body>", "<body><h1>t</h1><h2>s</h2><p>x</body>"
    assert hw.expression(wrapper_of(a, b)) == "(<body>(<h1>#TEXT</>)(<h2>#TEXT</>)?(<p>#TEXT</>)+(<ul>(<li>#TEXT</>)(<li>#TEXT</>)</>)?</>)"
    lists = ["<dl>" + f"<dt>{i}<dd>x" * i + "</dl>" for i in (2, 3, 1)]
    assert hw.expression(wrapper_of(*lists)) == "(<dl>((<dt>#TEXT</>)(<dd>#SAME</>))+</>)"
    wrapper = wrapper_of(a, b)
    assert hw.dumped(hw.loaded(hw.dumped(wrapper))) == hw.dumped(wrapper)
    r = random.Random(1)
    for _ in range(200):
        x, y = (r.choices("abcd", k=r.randint(0, 12)) for _ in range(2))
        told = list(hw.common(x, y))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1][j + 1] = best[i][j] + 1 if p == q else max(best[i][j + 1], best[i + 1][j])
        assert [i for i, _ in told if i is not None] == list(range(len(x))) and [j for _, j in told if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in told if i is not None and j is not None]
        assert len(both) == best[-1][-1] and all(x[i] == y[j] for i, j in both)


# --- 8 sharding ---


@pytest.mark.parametrize("shards", [1, 4, 7])
def test_shards(spark, sf, shards):
    import zlib

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, docs.unionAll(spark.range(10_000, 10_150).selectExpr("id", "'a copy of one text that many share'"))):
        rows, text = kd_shards(df, shards).collect(), {r["doc_id"]: r["text"] for r in df.collect()}
        size = Counter()
        slots = defaultdict(list)
        for r in rows:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(size) == set(range(shards))
        assert max(size.values()) - min(size.values()) <= max(r["size"] for r in rows) + sum(size.values()) / 64
        homes = defaultdict(set)
        for r in rows:
            homes[text[r["doc_id"]]].add(r["shard"])
        assert max(map(len, homes.values())) == 1
        assert sorted(map(tuple, kd_shards(df.repartition(3), shards).collect())) == sorted(map(tuple, rows))


def test_the_tree_against_a_plain_one(spark, sf):
    """Brute force: the same bins, cut node by node with lists; every shard is a box of the tree."""
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    meta = sharding.measured(docs, F.col("doc_id"))
    key = F.xxhash64("payload", "crc")
    plan = sharding.fit(meta, 8, key)
    table = plan.binned(meta, key).select("payload", "size", "bins", "tie", "home").collect()
    free = [r for r in table if r["home"] is None]
    share = sum(r["size"] for r in table) / 8
    room = [share - sum(r["size"] for r in table if r["home"] == s) for s in range(8)]
    want = {r["payload"]: r["home"] for r in table}

    def split(rows, lo, hi):
        if hi - lo == 1:
            want.update((r["payload"], lo) for r in rows)
            return
        mid = (lo + hi) // 2
        width = [max(r["bins"][d] for r in rows) - min(r["bins"][d] for r in rows) for d in range(3)]
        dim = width.index(max(width))
        at = lambda r: (r["bins"][dim], r["tie"])
        goal, before = sum(room[lo:mid]) / sum(room[lo:hi]) * sum(r["size"] for r in rows), 0
        for point in sorted({at(r) for r in rows}):
            here = sum(r["size"] for r in rows if at(r) == point)
            if before + here >= goal:
                first = (point[0], point[1] + (before + here - goal < goal - before))
                break
            before += here
        split([r for r in rows if at(r) < first], lo, mid)
        split([r for r in rows if at(r) >= first], mid, hi)

    split(free, 0, 8)
    assert {r["payload"]: r["shard"] for r in plan.assigned(meta, key).select("payload", "shard").collect()} == want


@pytest.mark.parametrize("ids", ["id", "if(id % 10 < 6, 7, id)", "null"])
def test_one_text_in_most_rows_is_split(spark, ids, monkeypatch):
    """Copies with ids of their own, and repeated rows, which also part the groups that are numbered."""
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 4)
    df = spark.range(600).selectExpr(f"cast({ids} as long) as doc_id", "if(id % 10 < 6, 'the same text again', concat('text ', id, repeat(' w', int(id % 50)))) as text")
    size, slots = Counter(), defaultdict(list)
    for r in kd_shards(df, 4).collect():
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(size.values()) <= 1.15 * min(size.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


# --- 9 top-k ---


def test_topk_blocks_and_passes(spark, sf):
    v = read_table(spark, sf, "embeddings")
    want = QUERIES["op9_exact_topk"](spark, sf).orderBy("query_id", "rank").collect()
    some = exact = tk.exact_topk(v.repartition(5), v.where("vec_id % 100 = 0"), query_block=2).orderBy("query_id", "rank").collect()
    assert some == want and exact


def test_equal_scores_stay_within_k():
    """Half of all rows equal: no step holds more than k rows of a query, and ties go to the smaller ids."""
    rng = np.random.default_rng(6)
    rows = np.where(np.arange(3000)[:, None] % 2, 7, rng.integers(-9, 9, (3000, 8)))
    ids = rng.permutation(3000)
    scores = rows[:600] @ rows.T
    assert max(np.bincount(tk._strip(scores, np.full(600, tk.LOWEST + 1), 10)[0])) == 10
    query, got, score = tk.scan(ids[:600], rows[:600], ((ids[a : a + 700], rows[a : a + 700]) for a in range(0, 3000, 700)), 10)
    for q in range(600):
        want = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if i != ids[q])[:10]
        assert list(zip(-score[query == q], got[query == q], strict=True)) == want


def test_accumulation_of_sparse_rows():
    rng = np.random.default_rng(4)
    q, x = (rng.integers(-2000, 2000, s) * (rng.random(s) < 0.3) for s in ((7, 20), (50, 20)))
    assert (tk.accumulate(q, x) == q @ x.T).all()
    assert (tk.accumulate(q.astype(object), x.astype(object)) == q @ x.T).all()


# --- 10 lines ---


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 9])
def test_streams_decide_like_one_sort(keep_first, parts):
    r = random.Random(parts)
    times = {d: r.choice([1, 1, 1, 4]) for d in range(31)}
    once = sorted({(r.randint(0, 12) if r.random() < 0.7 else 5, 0, r.randint(0, 30), 0, r.randint(0, 3)) for _ in range(600)})
    rows = [(*x, n) for x in once for n in ([2, times[x[2]] - 2] if times[x[2]] > 2 else [times[x[2]]])]  # repeats of two batches
    docs, first = defaultdict(set), {}
    for h, _, d, _, p in once:
        docs[h].add(d)
        first.setdefault(h, (d, p))
    want = {(h, d, p) for h, _, d, _, p in once if sum(times[x] for x in docs[h]) >= 10 and not (keep_first and first[h] == (d, p))}
    edges = sorted(r.sample(range(1, len(rows)), parts - 1)) if parts > 1 else []
    # a document's rows of a key share a partition
    edges = [next(i for i in range(e, len(rows) + 1) if i == len(rows) or rows[i][:3] != rows[i - 1][:3]) for e in edges]
    got, notes, open_ = [], [], []
    for lo, hi in zip([0, *edges], [*edges, len(rows)], strict=True):
        if lo == hi:
            continue
        state, a = _Runs(10, keep_first), np.array(rows[lo:hi])
        for at in range(0, hi - lo, 7):
            told = list(state.feed(list(a[at : at + 7].T), False))
            if at + 7 >= hi - lo:
                told += state.feed([c[:0] for c in a.T], True)
            for kind, columns, n in told:
                cells = list(zip(*(c.tolist() for c in columns), strict=True))
                if kind == "drop":
                    got += [(h, d, p) for h, _, d, _, p, _ in cells]
                elif kind == "note":
                    notes += [(*c, n) for c in cells]
                else:
                    open_ += cells
    total, lead = Counter(), {}
    for h, _, d, _, p, _, n in notes:
        total[h] += n
        lead[h] = min(lead.get(h, (d, p)), (d, p))
    got += [(h, d, p) for h, _, d, _, p, _ in open_ if total[h] >= 10 and not (keep_first and lead[h] == (d, p))]
    got += [(h, d, p) for h, _, d, _, p, _, _ in notes if total[h] >= 10 and not (keep_first and lead[h] == (d, p))]
    assert set(got) == want


def test_bitmaps():
    for dropped in ([0], [7], [8], [3, 17]):
        lines, n = kept_lines(b"\n".join(b"%d" % i for i in range(20)), bitmap(np.array(dropped)))
        assert n == 20 and lines == [b"%d" % i for i in range(20) if i not in dropped]
    assert kept_lines(b"", None) == ([b""], 1)


@pytest.mark.parametrize("carried", [0, 1 << 20])
@pytest.mark.parametrize("min_chars", [1, 11])
def test_line_dedup(spark, odd, min_chars, carried, monkeypatch):
    """Brute force with a document for each row: null, repeated and clashing ids."""
    from bandloom.llm import line_dedup as ld

    monkeypatch.setattr(ld, "CARRIED", carried)
    more = [(None, f"null id line\n{i}") for i in range(9)] + [(None, "null id line\n0")] + [(7000, f"one id\n{i}") for i in range(10)] + [(7001, "ten repeats")] * 10 + [(7002, "nine repeats")] * 9
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], (r["text"] or "").encode().split(b"\n")) for r in df.collect()]
    seen = Counter(k for _, lines in rows for k in {line_key(x) for x in lines})
    stays = lambda x: not (len(line_key(x).decode()) >= min_chars and seen[line_key(x)] >= 10)
    want = Counter((i, len(lines), sum(not stays(x) for x in lines), b"\n".join(x for x in lines if stays(x)).decode()) for i, lines in rows)
    assert Counter(map(tuple, line_dedup(df.repartition(3), min_docs=10, min_chars=min_chars, keep_first=False).collect())) == want


def test_first_lines_stay(spark, odd):
    out = line_dedup(odd.distinct(), min_docs=10).collect()
    twice = spark.createDataFrame([(1, "a\nb")] * 12 + [(2, "a\nc")], "doc_id long, text string")
    assert {(r["doc_id"], r["kept"]) for r in line_dedup(twice, min_docs=10).collect()} == {(1, "a\nb"), (2, "c")}
    seen = defaultdict(set)
    for r in odd.select("doc_id", "text").distinct().collect():
        for line in (r["text"] or "").encode().split(b"\n"):
            seen[line_key(line)].add((r["doc_id"], r["text"]))
    left = Counter(line_key(x) for r in out for x in r["kept"].encode().split(b"\n"))
    assert all(left[k] == 1 for k, docs in seen.items() if k and len(docs) >= 10)


def test_near_duplicates_by_similarity(spark, odd):
    from bandloom.llm.simhash import near_duplicates, shingle_set

    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [[r.choice(vocabulary) for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:30]):
        edited = list(t)
        for at in r.sample(range(300), 2 + i % 3):
            edited[at] = r.choice(vocabulary)
        rows.append((100 + i, " ".join(edited)))
    out = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    sets = {i: set(shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    alike = [i for i in range(30) if len(sets[i] & sets[100 + i]) >= 0.8 * len(sets[i] | sets[100 + i])]
    assert len(alike) >= 20 and sum(out[100 + i] == i for i in alike) >= 0.9 * len(alike)
    assert all(out[i] == i for i in range(40))
    assert near_duplicates(odd, "doc_id").count() == odd.count()


def test_near_duplicates_cut_and_extended(spark):
    from bandloom.llm.simhash import near_duplicates, shingle_set

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 240
    for i in range(n):
        text = r.choices(vocabulary, k=r.randint(80, 900))
        rows.append((i, " ".join(text)))
        copy = text[: -int(len(text) * r.choice([0.1, 0.17]))] if i % 2 else text + r.choices(vocabulary, k=int(len(text) * r.choice([0.15, 0.2])))
        rows.append((1000 + i, " ".join(copy)))
    sets = {i: set(shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    alike = [i for i in range(n) if len(sets[i] & sets[1000 + i]) >= 0.8 * len(sets[i] | sets[1000 + i])]
    out = {x["doc_id"]: x["component_id"] for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert len(alike) >= 200 and sum(out[1000 + i] == i for i in alike) >= 0.99 * len(alike)


@pytest.mark.parametrize("small", [True, False])
def test_near_duplicates_in_dense_neighbourhoods(spark, monkeypatch, small):
    """Groups whose texts are alike in chains and sub-groups, so that the smallest id of a band is not near all of it."""
    from bandloom.llm import simhash

    if small:  # families are cut into several blocks
        monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 3000)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(6):
        base = r.choices(vocabulary, k=240)
        for i in range(25):
            text = list(base)
            at = r.randrange(0, 180)
            text[at : at + r.randint(30, 60)] = r.choices(vocabulary, k=45)
            rows.append((100 * group + 4 * i, " ".join(text)))
            rows.append((100 * group + 4 * i + 1, " ".join(text[:-20])))
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for _, t in rows]
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = [rows[k][0] for k in _components(len(rows), alike)]
    out = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert 6 < len(set(want)) < len(rows) and [out[i] for i, _ in rows] == want


def test_near_duplicates_beside_texts_of_the_same_words(spark):
    """A third text of the same words in another order is near neither; it must not keep a pair apart."""
    from bandloom.llm import simhash

    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(30):
        text = r.choices(vocabulary, k=200)
        copy = [*text[:150], *r.choices(vocabulary, k=8), *text[158:]]
        other = r.sample(text, len(text))
        rows += [(10 * i + k, " ".join(x)) for k, x in enumerate((other, text, copy))]
    sets = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    assert all(len(sets[10 * i + 1] & sets[10 * i + 2]) >= 0.8 * len(sets[10 * i + 1] | sets[10 * i + 2]) for i in range(30))
    out = dict(simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect())
    assert all(out[10 * i + 2] == 10 * i + 1 and out[10 * i] == 10 * i for i in range(30))


def near_copies(texts):
    """Brute force: the smallest place that each text reaches through pairs of 0.8 similarity, or of close fingerprints."""
    from bandloom.llm.simhash import shingle_set

    sets = [shingle_set(t, 5) for t in texts]
    often = Counter(g for s in sets for g in s.tolist())
    by_first, pairs = defaultdict(list), []
    for i, s in enumerate(sets):
        mine = set(s.tolist())
        rare = sorted(mine, key=lambda g: (often[g], g))[: len(mine) - -(-8 * len(mine) // 10) + 1]
        for j in {j for g in rare for j in by_first[g]}:
            other = set(sets[j].tolist())
            if len(mine & other) >= 0.8 * len(mine | other):
                pairs.append((i, j))
        for g in rare:
            by_first[g].append(i)
    fps = np.array([fingerprint(t, 3, 42) for t in texts], dtype=np.uint64)
    for i in range(len(fps)):
        pairs += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3)]
    return _components(len(texts), pairs)


@pytest.mark.parametrize("sf_", ["sf0.01", "sf0.1"])
def test_near_duplicates_against_all_pairs(spark, sf_):
    """Every component over a whole table of documents."""
    from bandloom.llm.simhash import near_duplicates

    docs = read_table(spark, f"/root/testdata/{sf_}", "documents").where("doc_id is not null").select("doc_id", "text")
    rows = sorted((r["doc_id"], (r["text"] or "").encode()) for r in docs.collect())
    root = near_copies([t for _, t in rows])
    out = dict(near_duplicates(docs, "doc_id").collect())
    wrong = sum(out[i] != rows[root[k]][0] for k, (i, _) in enumerate(rows))
    assert wrong <= 0.001 * len(rows)  # pairs at 0.8 meet in a band with a probability of 0.9995


def test_texts_whose_hashes_agree_stay_apart(spark, sf, monkeypatch):
    from bandloom.llm import simhash

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    want = sorted(map(tuple, simhash.near_duplicates(docs, "doc_id").collect()))
    monkeypatch.setattr(simhash, "text_name", lambda text: F.pmod(F.xxhash64(text), F.lit(150)))
    assert sorted(map(tuple, simhash.near_duplicates(docs, "doc_id").collect())) == want
