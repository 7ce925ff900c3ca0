"""SimHash near-dedup: fingerprints, a binary trie self-join within a Hamming budget, and distributed components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.common import bounded_batches, carried, cut, discard, keyed_texts, renamed, shuffle_width

#: Fingerprints of a pair of subtrees that a task joins at most, bits by which larger ones go down the trie in a round, and rows
#: that a task holds at a time.
TRIE_ROWS, SPLIT_BITS, HELD_ROWS = 20_000, 4, 1 << 17
#: A node with more than so many links, and more than this part of all, is a hub.
HUB_LINKS, HUBS = 1 << 16, 1000
#: Minima of a text's hashed shingles that make a band, and the share of pairs at the stated similarity that meet in a band.
BAND_ROWS, RECALL = 5, 0.9995
#: Node pairs that a task holds at once, and leaf pairs of two nodes that are compared directly.
FRONTIER, LEAF_PAIRS = 1 << 19, 64
#: Shingles of one side of a block of texts that a task compares.
BLOCK_SHINGLES = 1 << 20
#: Pairs of a family of candidates beyond which it is cut by further bands.
FAMILY_WORK = 1 << 22


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends[: len(words) - shingle]]
    hashes = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=True)], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * set_bits > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id, fp): the fingerprint of every text as a signed long. Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x or b"", shingle, seed) for x in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return keyed.mapInArrow(run, T.StructType([renamed(keyed.schema["id"], "id"), T.StructField("fp", T.LongType())]))


class _Forest:
    """Which fingerprints of a task are known to be connected; keeps the links that connected them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            new = x != y
            a, b, x, y = a[new], b[new], x[new], y[new]
            if not len(a):
                return
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            # every label hangs onto the smallest label that a link of this round gives it; one link for each keeps a forest
            order = np.lexsort((lo, hi))
            first = order[np.r_[True, hi[order][1:] != hi[order][:-1]]]
            self.left.append(a[first])
            self.right.append(b[first])
            root = np.arange(len(self.label))
            root[hi[first]] = lo[first]
            while (root[root] != root).any():
                root = root[root]
            self.label = root[self.label]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(self.left or none), np.concatenate(self.right or none)


def trie_links(values: np.ndarray, nodes: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect what pairs within the budget connect.

    values: fingerprints (uint64), sorted within each trie, whose nodes are ranges of it. nodes: rows (lo, hi, lo', hi') of
    node pairs to start from, a node with itself included; their members may differ only in the lowest `depth` bits, or lie
    in different ranges. Pairs of nodes go down the trie together, bit by bit; each step that takes different branches costs
    one bit of the budget, and a pair that has overspent is dropped. Pairs whose members are all connected already are
    dropped too: they can add no connection.
    """
    forest = _Forest(len(values))
    ones: dict[int, np.ndarray] = {}

    def leaves(pairs: np.ndarray) -> None:
        na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
        each = na * nb
        row = np.repeat(np.arange(len(pairs)), each)
        k = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
        a, b = pairs[row, 0] + k // nb[row], pairs[row, 2] + k % nb[row]
        near = (a < b) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
        forest.add(a[near], b[near])

    stack = [(depth - 1, np.c_[part, np.zeros(len(part), dtype=np.int64)]) for part in np.array_split(nodes, max(1, -(-len(nodes) // FRONTIER)))]
    while stack:
        bit, pairs = stack.pop()
        if len(stack) and len(pairs):  # what earlier parts found may have settled these
            change = np.r_[np.flatnonzero(forest.label[1:] != forest.label[:-1]) + 1, len(values)]
            until = change[np.searchsorted(change, np.arange(len(values)), side="right")]
            same = (until[pairs[:, 0]] >= pairs[:, 1]) & (until[pairs[:, 2]] >= pairs[:, 3]) & (forest.label[pairs[:, 0]] == forest.label[pairs[:, 2]])
            pairs = pairs[~same]
        work = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (work <= LEAF_PAIRS) if bit >= 0 else np.ones(len(pairs), dtype=bool)
        few = pairs[small]
        for part in np.array_split(few, max(1, -(-int(work[small].sum()) // (FRONTIER * 4)))):
            leaves(part)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        c = ones[bit]
        alo, ahi, blo, bhi, spent = pairs.T
        amid, bmid, own = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo]), alo == blo
        children = [np.c_[alo, amid, blo, bmid, spent], np.c_[amid, ahi, bmid, bhi, spent], np.c_[alo, amid, bmid, bhi, spent + 1], np.c_[amid, ahi, blo, bmid, spent + 1][~own]]
        down = np.concatenate(children)
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        down = down[~((down[:, 0] == down[:, 2]) & (down[:, 1] - down[:, 0] == 1))]  # a leaf with itself
        stack += [(bit - 1, part) for part in np.array_split(down, max(1, -(-len(down) // FRONTIER)))]
    return forest.links()


def near_links(fps: DataFrame, budget: int = 3) -> DataFrame:
    """Links (u, v) between distinct fingerprints (fp) that connect exactly what pairs within the budget connect.

    Fingerprints within the budget agree in one of budget + 1 blocks of bits. So the join runs over budget + 1 rotated tries,
    each cut into the subtries below one block's value, and each task walks subtries against themselves. Pairs of subtrees
    with more than TRIE_ROWS members are replaced by the pairs of their subtrees SPLIT_BITS further down, round by round until
    none is too large; pairs whose paths differ in more bits than the budget are never made. Tasks stream the pairs in order,
    hold a few of them at a time and return a spanning forest of their links, so dense groups give no more links than members.
    """
    spark, n = fps.sparkSession, shuffle_width(fps.sparkSession)
    width = 64 // (budget + 1)
    depth = 64 - width
    tries = [F.struct(F.lit(r).alias("trie"), (F.shiftleft("fp", r * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - r * width)) if r else F.col("fp")).alias("fp")) for r in range(budget + 1)]
    rows = fps.select(F.explode(F.array(*tries)).alias("x")).select("x.trie", "x.fp")
    prefix = F.shiftrightunsigned("fp", depth)
    rows = rows.select("trie", F.lit(0).alias("bits"), prefix.alias("a"), prefix.alias("b"), F.lit(False).alias("right"), "fp")
    pairs, bits = None, 0
    while bits < depth:
        large = rows.groupBy("trie", "a", "b").count().where(F.col("count") > TRIE_ROWS).select("trie", "a", "b", F.lit(True).alias("large"))
        if large.isEmpty():
            break
        told = rows.join(large, ["trie", "a", "b"], "left")
        small = told.where("large is null").select(*rows.columns)
        pairs = small if pairs is None else pairs.unionAll(small)
        step = min(SPLIT_BITS, depth - bits)
        bits += step
        own = F.expr(f"shiftrightunsigned(fp, {depth - bits}) & {(1 << step) - 1}L")
        spent = F.when(F.col("a") == F.col("b"), 0).otherwise(F.expr("bit_count(a ^ b)"))
        other = F.explode(F.expr(f"filter(sequence(0L, {(1 << step) - 1}L), x -> bit_count(x ^ own) + spent <= {budget})"))
        down = told.where("large").withColumn("own", own).withColumn("spent", spent).withColumn("other", other)
        # below a node with itself a pair is made once, with the smaller path on the left
        turned = F.when(F.col("a") == F.col("b"), F.col("own") > F.col("other")).otherwise(F.col("right"))
        path = lambda c, right: F.col(c) * (1 << step) + F.when(F.col("turned") == F.lit(right), F.col("own")).otherwise(F.col("other"))
        down = down.withColumn("turned", turned)
        rows = cut(down.select("trie", F.lit(bits).alias("bits"), path("a", False).alias("a"), path("b", True).alias("b"), F.col("turned").alias("right"), "fp"), "subtrees")
    pairs = rows if pairs is None else pairs.unionAll(rows)

    def links(table: pa.Table) -> pa.RecordBatch:
        trie, bits, a, b, right, fp = (np.asarray(c.combine_chunks()) for c in table.columns)
        values = fp.view(np.uint64)
        order = np.lexsort((values, right, b, a, bits, trie))
        trie, bits, a, b, right, values = (x[order] for x in (trie, bits, a, b, right, values))
        lo = np.flatnonzero(_starts(trie, bits, a, b))
        hi = np.r_[lo[1:], len(values)]
        rights = np.r_[0, np.cumsum(right)]
        mid = hi - (rights[hi] - rights[lo])  # in a pair of subtrees the left one's members come first
        nodes = np.where((a[lo] == b[lo])[:, None], np.c_[lo, hi, lo, hi], np.c_[lo, mid, mid, hi]).astype(np.int64)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3]) & (hi - lo > 1)]
        u, v = trie_links(values, nodes, depth, budget)
        turn = (trie[u] * width).astype(np.uint64)
        back = [np.where(turn > 0, (values[x] >> turn) | (values[x] << ((np.uint64(64) - turn) & np.uint64(63))), values[x]).view(np.int64) for x in (u, v)]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(*back)), pa.array(np.minimum(*back))], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], HELD_ROWS
        for b in batches:
            held.append(b)
            room -= b.num_rows
            if room <= 0:
                table = pa.Table.from_batches(held)
                keys = [np.asarray(table.column(c).combine_chunks()) for c in range(4)]
                whole = int(np.flatnonzero(_starts(*keys))[-1])  # the last pair may go on
                if whole:
                    yield links(table.slice(0, whole))
                held, room = table.slice(whole).to_batches(), HELD_ROWS
        if held:
            yield links(pa.Table.from_batches(held))

    dealt = pairs.repartition(n, "trie", "bits", "a", "b").sortWithinPartitions("trie", "bits", "a", "b")
    return dealt.mapInArrow(join, "u long, v long").distinct()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows, sorted by these keys, begin a new one."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, root): each linked node, roots left out, with the smallest node that it reaches.

    links: rows (u, v) with u > v. Alternating large-star and small-star rounds; each round is written to the shared folder,
    so the lineage stays short, and only a count and a checksum reach the driver. Where there are enough links for hubs, nodes
    with more than HUB_LINKS and more than a HUBS-th of all links, these are told to the tasks that hold their links, so that
    no hub's links meet in one task.
    """

    def told(e: DataFrame, n_links: int) -> DataFrame:
        """e with m, the smallest of u and its neighbours."""
        least = e.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        if n_links <= HUB_LINKS:
            return e.join(least.select("u", "m"), "u")
        least = cut(least, "least")
        hubs = least.where(F.col("n") > max(HUB_LINKS, n_links // HUBS)).select("u", F.col("m").alias("hub"))  # 2 * HUBS at most
        known = e.join(F.broadcast(hubs), "u", "left")
        others = known.where("hub is null").join(least.select("u", "m"), "u").select("u", "v", "m")
        return others.unionAll(known.where("hub is not null").select("u", "v", F.col("hub").alias("m")))

    def stars(e: DataFrame, n: int) -> DataFrame:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = told(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        if n > HUB_LINKS // 2:
            large = cut(large, "large")
        small = told(large, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        return small.unionAll(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    edges = cut(links, "links")
    now = state(edges)
    while now[0]:
        next_ = cut(stars(edges, now[0]), "stars")
        discard(edges)
        edges, before, now = next_, now, state(next_)
        if before == now:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """Rows (id_col, fingerprint, component_id), one for each row of docs.

    Equal fingerprints become one node before anything is joined, so groups of copies cost one row each. component_id: the
    smallest id whose document is reachable through links of at most `budget` differing bits.

    Null and empty texts and texts without words have fingerprint zero and link like any other; rows with a null id get the
    component of the others (null if no member has an id); repeated rows are passed on; an empty table gives no rows; other
    columns are ignored.
    """
    known = cut(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = cut(known.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(near_links(nodes.select("fp"), budget))
    nodes = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("fp", "component_id")
    return known.join(nodes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; one of the whole text if it has fewer words."""
    words = text.lower().split()
    grams = {b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(g, 1) for g in grams], dtype=np.uint64))


def band_count(similarity: float) -> int:
    """Bands that let texts of this similarity agree in one of them with probability RECALL at least."""
    meet = similarity**BAND_ROWS
    return 1 if meet >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def band_keys(grams: np.ndarray, bands: int, level: int = 0) -> list[int]:
    """A key for each band of minima of a set of hashed shingles, as signed numbers; each level has minima of its own. A minimum is
    the same for two sets with a probability of their Jaccard similarity."""
    turns = np.random.default_rng([BAND_ROWS, level] if level else BAND_ROWS).integers(0, 1 << 31, (bands * BAND_ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.min([(turns * x[at : at + 4096]).min(axis=1) for at in range(0, len(x), 4096)], axis=0)
    keys = [xxhash.xxh3_64_intdigest(row.tobytes()) for row in least.reshape(bands, BAND_ROWS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def shingles_of(texts: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """Rows (text_id, grams) for the named texts among texts (text_id, text)."""
    asked = texts.join(carried(named, 8), "text_id", "left_semi").groupBy("text_id").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["text_id", "grams"])

    return cut(asked.mapInArrow(sets, "text_id long, grams binary"), "shingles")


def similar_pairs(grams: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of texts whose sets of shingles (text_id, grams) have at least this Jaccard similarity."""
    both = pairs.join(grams.select(F.col("text_id").alias("u"), F.col("grams").alias("a")), "u").join(grams.select(F.col("text_id").alias("v"), F.col("grams").alias("b")), "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long")


def block_links(ids: list[int], labels: list[int], grams: list[np.ndarray], asked: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the first `asked` texts of a block and all others that are at least this similar, one for each two
    labels that they connect. Texts of one label are connected already."""
    words, codes = np.unique(np.concatenate(grams), return_inverse=True)
    n = np.array([len(g) for g in grams])
    ends = np.cumsum(n)
    label = np.unique(np.array(labels), return_inverse=True)[1]
    mark = np.zeros(len(words), dtype=np.int32)
    for i in range(asked):
        if (label == label[i]).all():
            continue
        mine = codes[ends[i] - n[i] : ends[i]]
        mark[mine] = 1
        shared = np.add.reduceat(mark[codes], ends - n)
        mark[mine] = 0
        hits = np.flatnonzero((shared >= similarity * (n[i] + n - shared)) & (label != label[i]))
        for j in hits.tolist():
            if label[j] != label[i]:
                yield max(ids[i], ids[j]), min(ids[i], ids[j])
                label[label == label[j]] = label[i]


def open_families(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (family, text_id, label, outside, work, members) of families of candidates, (family, text_id), that hold more than one
    component; label: the component, outside: not of the family's largest one, work: pairs that a comparison of those outside
    with all makes."""
    known = members.join(roots.select(F.col("node").alias("text_id"), F.col("root").alias("label")), "text_id", "left").withColumn("label", F.coalesce("label", "text_id"))
    parts = known.groupBy("family", "label").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"), F.sum("n").alias("members"))
    sizes = sizes.where("most < members").withColumn("work", (F.col("members") - F.col("most")) * F.col("members"))
    return known.join(sizes, "family").select("family", "text_id", "label", (F.col("label") != F.col("largest")).alias("outside"), "work", "members")


def split_families(large: DataFrame, grams: DataFrame, bands: int, level: int) -> DataFrame:
    """Rows (family, text_id, members): families (family, text_id, members) cut by further bands of minima, of which a pair of the
    similarity shares one as surely as of the first; members is still the size of the family that was cut."""
    rows = large.select("family", "text_id", "members").join(grams, "text_id")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [band_keys(np.frombuffer(g, np.uint64), bands, level) for g in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64()))], ["family", "text_id", "members", "keys"])

    each = rows.select("text_id", "family", "members", "grams").mapInArrow(cut_up, "family long, text_id long, members long, keys array<long>")
    each = each.select("text_id", "members", "family", F.posexplode("keys").alias("band", "key"))
    return each.select(F.xxhash64("family", "band", "key", F.lit(level)).alias("family"), "text_id", "members")


def candidate_families(keys: DataFrame, roots: DataFrame, grams: DataFrame, bands: int) -> DataFrame:
    """open_families() of the texts that share a band (text_id, band, key), those with much work cut by further bands until they are
    small, or until cutting leaves more than half of them together: then they are near each other for the most part."""
    members = keys.select(F.xxhash64("band", "key").alias("family"), "text_id")
    done, level = None, 0
    while True:
        now = cut(open_families(members.select("family", "text_id"), roots), "families")
        large = F.col("work") > FAMILY_WORK
        if level:  # those that a cut has not made smaller stay as they are
            large = large & (F.col("members") <= F.col("before") / 2)
            now = cut(now.join(members.groupBy("family").agg(F.max("members").alias("before")), "family"), "families")
        small = now.where(~large).drop("before")
        done = small if done is None else done.unionByName(small)
        if now.where(large).isEmpty():
            return done
        level += 1
        members = cut(split_families(now.where(large), grams, bands, level), "members")


def family_links(families: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect whatever pairs of at least this similarity connect within the families of candidate_families().

    A pair in one component adds nothing, so the texts outside a family's largest component are compared with all of the family.
    Both sides are cut into blocks of about BLOCK_SHINGLES, and a task takes a pair of blocks; no pair of them is left out.
    """
    rows = cut(families.select("family", "text_id", "label", "outside").join(grams, "text_id"), "open")
    blocks = lambda size: F.ceil(F.coalesce(F.sum(size), F.lit(0)) / (8 * BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("family").agg(blocks(F.length("grams")).alias("n_all"), blocks(F.when(F.col("outside"), F.length("grams"))).alias("n_out"))
    rows = rows.join(sizes, "family").withColumn("a", F.pmod(F.xxhash64("text_id"), "n_out").cast("int")).withColumn("b", F.pmod(F.xxhash64("text_id"), "n_all").cast("int"))
    dealt = rows.where("outside").withColumn("b", F.explode(F.expr("sequence(0, n_all - 1)"))).withColumn("side", F.lit(0))
    dealt = dealt.unionByName(rows.withColumn("a", F.explode(F.expr("sequence(0, n_out - 1)"))).withColumn("side", F.lit(1)))
    dealt = dealt.select("family", "a", "b", "side", "text_id", "label", "grams")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, []

        def told() -> pa.RecordBatch:
            ids, labels = [r[1] for r in block], [r[2] for r in block]
            pairs = list(block_links(ids, labels, [np.frombuffer(r[3], np.uint64) for r in block], sum(r[0] == 0 for r in block), similarity))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for *key, side, text_id, label, sent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if block:
                        yield told()
                    now, block = key, []
                block.append((side, text_id, label, sent))
        if block:
            yield told()

    n = shuffle_width(families.sparkSession)
    return dealt.repartition(n, "family", "a", "b").sortWithinPartitions("family", "a", "b", "side", "text_id").mapInArrow(join, "u long, v long")


def text_name(text: Column) -> Column:
    """The number by which equal texts are one; different texts that happen to share it are told apart by another hash."""
    return F.xxhash64(text)


def near_duplicates(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, budget: int = 3) -> DataFrame:
    """Rows (id_col, component_id), one for each row of docs: groups of near copies.

    Texts are linked if the fingerprints of their 3-word shingles differ in at most `budget` bits, or if their sets of
    `shingle`-word shingles share a band of minima and then turn out to be at least `similarity` alike. The bands are so many
    that a pair of that similarity shares one with probability RECALL, whatever the edits were. Texts of a band are first
    checked against one of them; what that leaves apart is checked by family_links(), within a band only, so texts that share
    no more than a template are not compared with each other: a large band of them is cut by further bands. Equal texts are one node throughout;
    different texts whose 64-bit hashes agree are found by a second hash and named by it.

    Nulls, empty and repeated texts: as simhash_groups(). id_col may be a struct.
    """
    bounded_batches(docs.sparkSession)
    keyed = keyed_texts(docs, id_col, text_col)
    keyed = keyed.withColumn("text_id", text_name(F.col("text"))).withColumn("second", F.xxhash64(F.lit("second"), "text"))
    bands = band_count(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            first = np.array([fingerprint(t, 3, 42) for t in texts], dtype=np.uint64).view(np.int64).tolist()
            keys = [band_keys(shingle_set(t, shingle), bands) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(first, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "text_id", "second", "fp", "keys"])

    def texts_of(known: DataFrame) -> DataFrame:
        found = known.groupBy("text_id").agg(F.min("id").alias("least"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), (F.min("second") != F.max("second")).alias("clash"))
        return cut(found, "texts")

    schema = T.StructType([renamed(keyed.schema["id"], "id"), *(T.StructField(n, T.LongType()) for n in ("text_id", "second", "fp")), T.StructField("keys", T.ArrayType(T.LongType()))])
    known = cut(keyed.mapInArrow(run, schema), "bands")
    nodes = texts_of(known)
    if not nodes.where("clash").isEmpty():
        clashes = cut(nodes.where("clash").select("text_id", "clash"), "clashes")
        known, keyed = (df.join(carried(clashes, 9), "text_id", "left").withColumn("text_id", F.when(F.col("clash"), F.col("second")).otherwise(F.col("text_id"))).drop("clash") for df in (known, keyed))
        known = cut(known, "bands")
        nodes = texts_of(known)
    heads = cut(nodes.groupBy("fp").agg(F.min("text_id").alias("head")), "heads")
    same = nodes.join(heads, "fp").select(F.col("text_id").alias("u"), F.col("head").alias("v"))
    links = near_links(heads.select("fp"), budget)
    for side in "uv":
        links = links.join(heads.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_head")), side)
    sure = same.unionAll(links.select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))).where("u <> v")
    sure = cut(sure.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "sure")
    keys = nodes.select("text_id", F.posexplode("keys").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.min("text_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    meeting = cut(keys.join(shared.select("band", "key", "head"), ["band", "key"]), "meeting")
    stars = cut(meeting.where("text_id <> head").select(F.col("text_id").alias("u"), F.col("head").alias("v")).distinct(), "candidates")
    texts = keyed.select("text_id", F.coalesce("text", F.lit(b"")).alias("text"))
    asked = stars.join(sure, ["u", "v"], "left_anti")
    grams = shingles_of(texts, stars.select(F.explode(F.array("u", "v")).alias("text_id")).distinct(), shingle)
    roots = connected_components(sure.unionAll(similar_pairs(grams, asked, similarity)))
    roots = connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(family_links(candidate_families(meeting, roots, grams, bands), grams, similarity)).distinct())
    nodes = nodes.select("text_id", "least").join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(named, "root").select("text_id", "component_id")
    return known.select("id", "text_id").join(nodes, "text_id").select(F.col("id").alias(id_col), "component_id")
