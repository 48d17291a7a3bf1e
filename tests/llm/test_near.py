import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import decontaminate as dc
from quantloom.llm import embedding_dedup as ed
from quantloom.llm import minhash
from quantloom.llm._graph import components, hubs, split_join, top_keys
from quantloom.llm._store import Scratch


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, k):
    """doc_id -> (size, component)."""
    sets, union = {}, Union()
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t, k))
            union.find(d)
    flat = [(d, s) for d, own in sets.items() for s in own]
    for i, (a, s) in enumerate(flat):
        for b, t in flat[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                union.join(a, b)
    return union


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_match_brute_force(spark, k):
    rng = random.Random(k)
    rows, d = [], 100
    for family in range(5):
        words = [f"f{family}x{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([2, 9, 30])):
            rows.append((d, edited(words, rng.choice([0, 0, 1, 2, 5, 8]), rng)))
            d -= 1
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one"), (204, "ONE"), (205, "two"), (206, "Two  three"), (207, "two three"), (None, "two three"), (206, "Two  three"), (300, "long " * 30_000), (301, "long " * 30_001)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, node int, key int")
    got = minhash.near_duplicates(df, Scratch(spark, "near"), k, block_shingles=300).collect()
    union = brute(rows, k)
    assert len(got) == len(rows)
    sizes = {(a, len(shingles(b, k))) for a, b in rows}
    for r in got:
        assert (r.doc_id, r.n_shingles) in sizes
        assert r.component_id == (None if r.doc_id is None else union.find(r.doc_id)), r
        assert r.kept == (r.doc_id is not None and r.component_id == r.doc_id)


def test_near_pairs_in_a_loose_crowd_are_found(spark):
    """Buckets led by a third text, whose similarity with both is far below the bound."""
    rng = random.Random(12)
    rows, pairs = [], []
    for g in range(4):
        kept = lambda p: " ".join(f"g{g}x{i}" if rng.random() < p else f"u{rng.random()}" for i in range(400))  # noqa: E731, B023
        rows += [(g * 10_000 + k, kept(rng.uniform(0.75, 0.8))) for k in range(1, 1001)]
        pairs.append((g * 10_000 + 2000, g * 10_000 + 3000))
        rows += [(d, kept(0.955)) for d in pairs[-1]]
    texts = dict(rows)
    for a, b in pairs:
        s, t = shingles(texts[a], 1), shingles(texts[b], 1)
        assert 100 * len(s & t) >= 80 * len(s | t)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for members in (1024, 8):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, Scratch(spark, "crowd"), 1, block_members=members).collect()}
        assert all(got[a] == got[b] == a for a, b in pairs), [(got[a], got[b]) for a, b in pairs]


def test_no_documents(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), Scratch(spark, "none")).count() == 0


def test_stage_keeps_one_of_a_group_and_all_columns(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (3, "other words here", "c"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, __gone string")
    got = minhash.dedup_stage(spark, df, "")
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == {1, 3, 4, 5}
    other = " ".join(f"v{i}" for i in range(50))
    odd = spark.createDataFrame([(7, text), (7, text), (7, other), (None, text), (None, "a b c d e f"), (None, "a b c d e f"), (8, other + " more"), (9, "")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.text) for r in minhash.dedup_stage(spark, odd, "").collect()) == sorted([("7", text), ("7", other), ("None", "a b c d e f"), ("9", "")])
    assert minhash.dedup_stage(spark, odd.limit(0), "").count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 301), (301, 302), (302, 300), (300, 300), (301, 300)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "cc")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)} | {300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "cc")).count() == 0


def test_components_take_few_rounds_and_tasks(spark):
    rng = random.Random(5)
    edges = [(i, rng.randrange(i)) for i in range(1, 3000)]  # random trees in one: shallow, not stars
    rng.shuffle(edges)
    written = []

    class Counting(Scratch):
        def write(self, df, table):
            out = super().write(df, table)
            written.append(len(out.inputFiles()))
            return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        got = components(spark.createDataFrame(edges, "u long, v long"), Counting(spark, "few")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.node: r.component for r in got} == {i: 0 for i in range(3000)} and len(got) == 3000
    assert len(written) <= 5 and max(written) <= 2 * spark.sparkContext.defaultParallelism


def test_frequent_keys_are_dealt_out_and_joined_like_others(spark):
    left = spark.range(4000).selectExpr("id", "case when id % 3 = 0 then 7 when id % 3 = 1 then id % 50 + 100 when id % 9 = 2 then null else id end as k")
    right = spark.range(120).selectExpr("id as k", "id * 10 as w")
    total, top = left.selectExpr("count(*)").first()[0], left.agg(top_keys("k")).first()[0]
    assert max(hubs([top], total).values()) > 50
    for how in ("inner", "left"):
        order = lambda df: sorted(map(str, df.select("id", "k", "w").collect()))
        assert order(split_join(left, right, "k", how)) == order(left.join(right, "k", how))
    star = [(1, 10_000 + i) for i in range(900)] + [(10_000 + i, 20_000 + i % 300) for i in range(900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(star, "u long, v long"), Scratch(spark, "hub")).collect()}
    assert set(got.values()) == {1} and len(got) == 1201


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vectors = np.vstack([base, *(base[i] + rng.normal(0, 0.2, (12, 16)) for i in range(6)), np.repeat(base[:1], 5, axis=0)]).astype(np.float32)
    labels = rng.integers(0, 2, len(vectors))
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(vectors, labels))]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [1.0] * 15, 1), (1004, rows[0][1], None), (1005, [1.0], 1), (1006, [None] * 16, 0)]
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(linked, False)
    union = Union()
    for u, v in zip(*np.nonzero(linked)):
        union.join(int(u), int(v))
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, vector string")
    for most in (1024, 6):
        got = {r.vec_id: r for r in ed.near_vectors(df, Scratch(spark, "vec"), most_bucket=most).collect()}
        assert len(got) == len(rows) + len(odd)
        for i in range(len(rows)):
            assert got[i].n_links == linked[i].sum() and got[i].component_id == union.find(i) and got[i].kept == (union.find(i) == i)
        assert all(got[i].n_links == 0 and got[i].kept for i, *_ in odd)
    assert ed.near_vectors(df.limit(0), Scratch(spark, "vec")).count() == 0


def test_a_repeated_id_keeps_its_own_links(spark):
    a, b = np.eye(8)[0], np.eye(8)[1]
    near = lambda v: (v + 0.05 * np.eye(8)[5]).tolist()
    rows = [(1, a.tolist()), (1, b.tolist()), (2, near(a)), (3, near(b)), (4, near(b))]
    got = ed.near_vectors(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int"), Scratch(spark, "twice")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]


def test_the_measured_plan_finds_pairs_of_a_cone():
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for mean_cosine in (0.0, 0.5, 0.9):
        x = unit(mean_cosine**0.5 * np.eye(64)[:1] + (1 - mean_cosine) ** 0.5 * unit(rng.normal(size=(8000, 64))))
        width, tables, q, radius = ed.measured_plan(20_000, x[:4000], 0.98)
        u, v = ed.pairs_at(x[4000:], 0.98, seed=8)
        apart = q.codes(u) != q.codes(v)
        met = ~apart[:, : tables * width].reshape(len(u), tables, width).any(axis=2).all(axis=1)
        assert (met & (apart.sum(axis=1) <= radius)).mean() >= 0.99, (mean_cosine, width, tables)


def test_recall_at_the_bound():
    """Pairs at a cosine of 0.98 exactly, in tables planned for a hundred million vectors."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = rng.normal(size=x.shape)
    d -= (d * x).sum(axis=1, keepdims=True) * x
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    y = 0.98 * x + (1 - 0.98**2) ** 0.5 * d
    for n in (3000, 100_000_000):
        width, tables, rounds = ed.table_plan(n, 64, 0.98)
        q = ed.Quantiser(x, rounds)
        keys = [(q.codes(v)[:, : tables * width].reshape(len(v), tables, width) << np.arange(width)).sum(axis=2) for v in (x, y)]
        assert (keys[0] == keys[1]).any(axis=1).mean() > 0.98
        balance = q.codes(x).mean(axis=0)
        assert (abs(balance - 0.5) < 0.1).all()


def test_pairs_of_vectors_with_a_common_direction_are_found(spark):
    """Mean unit vectors of length 0.9: centring opens the angle of a pair."""
    rng = np.random.default_rng(16)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(0.9 * np.eye(64)[:1] + (1 - 0.9**2) ** 0.5 * unit(rng.normal(size=(600, 64))))
    d = rng.normal(size=x.shape)
    d = unit(d - (d * x).sum(axis=1, keepdims=True) * x)
    y = 0.9801 * x + (1 - 0.9801**2) ** 0.5 * d
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.vstack([x, y]))]
    got = {r.vec_id: r.n_links for r in ed.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), Scratch(spark, "common")).collect()}
    all_pairs = np.vstack([x, y]) @ np.vstack([x, y]).T >= 0.98
    assert sum(got.values()) >= 0.99 * (all_pairs.sum() - len(rows))
    assert ed.table_plan(1000, 64, 0.98, norms=np.zeros(10)) == (0, 1, 1)


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of dreams"


def test_contamination(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"n{rng.randrange(5000)}" for _ in range(n))
    near = ITEM.replace("dreams", "gold")  # one shingle of fourteen
    far = ITEM.replace("fox", "cat").replace("seven", "nine")
    docs = [(1, noise(300) + " " + ITEM + " " + noise(300)), (2, ITEM.upper().replace(" ", ",\n")), (3, noise(50) + " " + near), (4, far), (5, noise(1000)), (6, None), (7, ""), (None, ITEM), (8, "hi there"), (1, "twice " + ITEM + ". " + ITEM), (9, noise(30_000) + " " + ITEM)]
    items = [(10, ITEM), (11, "hi there"), (12, ""), (13, None), (14, noise(40))]
    ddf = spark.createDataFrame([(a, b, "s") for a, b in docs], "doc_id long, text string, __text string")
    idf = spark.createDataFrame(items, "item_id long, text string")
    for size, prefilter in ((4 << 20, True), (60, True), (4 << 20, False)):
        got = sorted(((r.doc_id, r.item_id, round(r.similarity, 3)) for r in dc.contaminated(ddf, idf, block_bytes=size, prefilter=prefilter).collect()), key=str)
        want = [(1, 10, 1.0), (1, 10, 1.0), (2, 10, 1.0), (3, 10, round(13 / 15, 3)), (8, 11, 1.0), (9, 10, 1.0), (None, 10, 1.0)]
        assert got == sorted(want, key=str)
        clean = dc.decontaminate(ddf, idf, block_bytes=size, prefilter=prefilter)
        assert clean.columns == ddf.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]
    assert dc.contaminated(ddf, idf.limit(0)).count() == 0 and dc.contaminated(ddf.limit(0), idf).count() == 0
    assert dc.decontaminate(ddf, idf.limit(0)).count() == len(docs)


def test_windows_match_brute_force():
    """Every window against every item by weighted similarity, with nothing in between."""
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 8, 20, 20, 33)]
    index = dc.ItemIndex(list(range(5)), items)
    for _ in range(30):
        words = [rng.choice(vocabulary) for _ in range(150)]
        for item in rng.sample(items, 2):
            own = item.split()
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = "odd"
            at = rng.randrange(len(words))
            words[at:at] = own
        hashes, _ = dc.normal_words(pa.array([" ".join(words)]))
        bag = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - min(5, len(w)) + 1)] if len(w) >= 5 else [tuple(w)]
        want = {}
        for j, item in enumerate(items):
            own = Counter(bag(item.split()))
            for a in range(len(words) - len(item.split()) + 1):
                other = Counter(bag(words[a : a + len(item.split())]))
                s = sum((own & other).values()) / sum((own | other).values())
                if s >= 0.8 and s > want.get(j, 0):
                    want[j] = s
        for hits in (None, index.hits(hashes)):
            got = {index.ids[j]: s for j, (s, _) in index.matches(hashes, hits, 0.8).items()}
            assert got == pytest.approx(want)


def test_all_fingerprints_within_the_radius_are_found():
    rng = np.random.default_rng(8)
    words = [" ".join(f"w{rng.integers(9000)}" for _ in range(30)) for _ in range(200)]
    index = dc.ItemIndex(list(range(200)), words)
    prints = []
    for p in index.prints[:50]:
        flips = rng.choice(64, rng.integers(0, dc.RADIUS + 1), replace=False)
        prints.append(p ^ np.uint64(sum(1 << int(f) for f in flips)))
    windows, items = index.candidates(np.array(prints, np.uint64), 30)
    got = set(zip(windows.tolist(), items.tolist()))
    want = {(i, j) for i, p in enumerate(prints) for j, q in enumerate(index.prints) if int(p ^ q).bit_count() <= dc.RADIUS}
    assert got == want and all((i, i) in got for i in range(50))
