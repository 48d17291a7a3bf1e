import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantloom.llm import gru_lm as lm
from quantloom.llm import quality
from quantloom.llm._store import Scratch


def corpus(n, seed=0):
    """Two languages with their own words; a document sticks to one."""
    rng = random.Random(seed)
    words = [[f"{c}{i}" for i in range(40)] for c in ("red", "blau")]
    return [(d, " ".join(rng.choice(words[d % 2]) for _ in range(rng.randrange(20, 120)))) for d in range(n)]


def held(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1


def test_scores_are_probabilities_of_a_better_model(spark):
    rows = [*corpus(300), (1000, None), (1001, ""), (1002, "Never-seen-word " * 3), (None, "red1"), (7, "red1 red2"), (1003, "x " * 40_000)]
    df = spark.createDataFrame([(a, b, "w", 1) for a, b in rows], "doc_id long, text string, word string, row int").repartition(3)
    got = lm.score_documents(df, Scratch(spark, "lm"), hot_words=60).collect()  # most words go through the join
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*(t or "").encode().lower().split(), "end"])
    total, distinct = sum(counts.values()), len(counts)
    base = lambda ws: sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
    want = sorted(((d, held(d), len(ws), sum(counts[w] > 0 for w in ws), total, round(base(ws), 6)) for d, t in rows for ws in [[*(t or "").encode().lower().split(), "end"]]), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) + 0.1 * sum(r.n_tokens for r in unseen)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score_documents(df.limit(0), Scratch(spark, "lm")).count() == 0


def small_model(seed=1):
    words = [lm.END, *(f"w{i}".encode() for i in range(1500))]
    counts = [50] + [1 + 1500 // (i + 1) for i in range(1500)]
    sums = {}
    for w, n in list(zip(words, counts))[lm.HEAD :]:
        v, s = sums.get(lm.tail_bucket(w), (0, 0))
        sums[lm.tail_bucket(w)] = (v + 1, s + n)
    lexicon = lm.Lexicon(words, counts, sum(counts), len(words), sums)
    weights = lm.initial_weights(lexicon, seed)
    return lexicon, lm.GruModel({k: v.astype(np.float64) if k != "x" else v for k, v in weights.items()})


def test_probabilities_add_up_to_one():
    lexicon, model = small_model()
    state = np.random.default_rng(0).normal(size=(1, lm.HIDDEN))
    head = np.exp(model.log_likelihood(np.repeat(state, lm.HEAD, 0), np.arange(lm.HEAD))).sum()
    tails = np.exp(model.log_likelihood(np.repeat(state, lm.TAIL_BUCKETS, 0), lm.HEAD + np.arange(lm.TAIL_BUCKETS)))
    inside = np.zeros(lm.TAIL_BUCKETS)
    for k in range(lm.HEAD, len(lexicon.words)):
        inside[lexicon.symbol[k] - lm.HEAD] += 10 ** lexicon.within[k]
    inside += 0.5 / 10**lexicon.tail_norm  # one word that was never seen
    assert inside == pytest.approx(np.ones(lm.TAIL_BUCKETS))
    assert head + (tails * inside).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_and_lanes_do_not_matter():
    _, model = small_model()
    rng = np.random.default_rng(3)
    docs = [np.append(rng.integers(1, lm.SYMBOLS, n), 0).astype(np.int32) for n in (0, 1, 15, 16, 17, 300, 40)]
    alone = [model.score([d])[0] for d in docs]
    assert model.score(docs, 3) == pytest.approx(alone, rel=1e-5)
    assert model.score(docs, 64) == pytest.approx(alone, rel=1e-5)


def test_every_training_token_is_learned_from():
    """More lanes than one group, and one document far longer than all others."""
    _, model = small_model()
    rng = np.random.default_rng(9)
    docs = [np.append(rng.integers(1, lm.SYMBOLS, n), 0).astype(np.int32) for n in (*[40] * 300, 5000)]
    seen, count = [], model.forward
    model.forward = lambda source, fresh, h, keep=False: (seen.append(source.size) if keep else None, count(source, fresh, h, keep))[1]
    before = model.p["X"].copy()
    model.train(docs, rate=0.01)
    assert sum(seen) >= sum(map(len, docs))
    used = np.unique(np.concatenate(docs))
    assert (model.p["X"][used] != before[used]).any(axis=1).all()


def test_gradients_are_those_of_the_loss():
    _, model = small_model()
    rng = np.random.default_rng(5)
    steps, lanes = lm.WINDOW, lm.LEAST_LANES
    source, target = rng.integers(0, lm.SYMBOLS, (2, steps, lanes))
    fresh, real = rng.random((steps, lanes)) < 0.1, np.ones((steps, lanes), bool)
    h = rng.normal(size=(lanes, lm.HIDDEN))

    def loss():
        states, _, _ = model.forward(source, fresh, h)
        return -model.log_likelihood(states.reshape(-1, lm.HIDDEN).astype(np.float64), target.reshape(-1)).mean()

    grads = model._gradients(source, target, fresh, real, h)
    rows, gx = grads["X"]
    dense = np.zeros_like(model.p["X"])
    dense[rows] = gx
    grads["X"] = dense
    for name, g in grads.items():
        k = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps = model.p[name][k], 1e-3
        model.p[name][k] = old + eps
        up = loss()
        model.p[name][k] = old - eps
        down = loss()
        model.p[name][k] = old
        assert g[k] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-5), name


def junk(d, rng):
    words = [rng.choice(["the", "of", "house", "green", "river", "stone", "walks", "over"]) for _ in range(rng.randrange(5, 60))]
    return " ".join(words).capitalize() + "." if d % 4 else " | ".join(w.upper() + "!!" for w in words)


def quality_rows(n):
    rng = random.Random(9)
    return [(d, junk(d, rng)) for d in range(n)]


def test_quality_on_held_out_rows(spark):
    rows = quality_rows(800)
    docs = spark.createDataFrame([(a, b, "en", 0.5) for a, b in [*rows, (5000, None), (5001, ""), (None, "the river"), (3, rows[3][1])]], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(d, int(d % 4 > 0), 1) for d, _ in rows] + [(1, 1, 0), (9999, 1, 0), (None, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    judge = quality.fit(docs, labels)
    got = quality.score_quality(docs, judge).collect()
    assert len(got) == 804
    unseen = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 800]
    assert len(unseen) > 100 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in unseen)
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in unseen]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = quality.keep_quality(docs.withColumnRenamed("score", "__text"), judge)
    assert kept.columns == ["doc_id", "text", "lang", "__text"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judge = quality.fit(docs, labels)
    assert [r.score for r in quality.score_quality(docs, judge).collect()] == [0.5, 0.5]
    assert quality.keep_quality(docs, judge).count() == 2
    assert quality.score_quality(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_word_vectors_put_words_of_like_contexts_together(spark):
    rng = random.Random(4)
    lines = [" ".join(x for _ in range(20) for x in (rng.choice(["king", "queen"]), "rules", rng.choice(["apple", "pear"]), "tastes")) for _ in range(200)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    vectors = quality.WordVectors(quality._contexts(docs).toArrow()).vectors
    at = lambda w: vectors[quality.word_buckets(pa.array([w]))[0][0]]
    cos = lambda a, b: at(a) @ at(b) / np.linalg.norm(at(a)) / np.linalg.norm(at(b))
    assert cos("king", "queen") > 0.9 and cos("king", "queen") > cos("king", "rules") and cos("apple", "pear") > 0.9


def test_windows_are_cut_from_lanes_and_a_long_text_stays_small():
    rng = np.random.default_rng(2)
    docs = [rng.integers(1, lm.SYMBOLS, n).astype(np.int32) for n in (*[50] * 255, 1_000_000)]
    lanes, seen, last = lm.Lanes(docs, 256), Counter(), {}
    for source, target, fresh, number in lanes.windows(4096):
        assert source.size <= 16 * lm.WINDOW * 256
        for d in np.unique(number[number >= 0]).tolist():
            own = target[number == d]
            seen[d] += len(own)
            last.setdefault(d, own[0])
    assert seen == Counter({k: len(d) for k, d in enumerate(docs)}) and all(last[k] == d[0] for k, d in enumerate(docs))
    assert sum(x.nbytes for x in (lanes.source, lanes.target, lanes.fresh, lanes.number)) < 16 << 20


def test_score_is_that_of_a_plain_loop():
    """One document at a time, one token at a time, in double precision."""
    _, model = small_model()
    rng = np.random.default_rng(4)
    docs = [np.append(rng.integers(1, lm.SYMBOLS, n), 0).astype(np.int32) for n in (3, 70)]
    p, n = {k: v.astype(np.float64) for k, v in model.p.items()}, lm.HIDDEN
    soft = lambda x: x - np.log(np.exp(x).sum())
    for doc, got in zip(docs, model.score(docs)):
        h, before, want = np.zeros(n), 0, 0.0
        for y in doc.tolist():
            x, g = p["X"][before], h @ p["U"]
            z, r = (1 / (1 + np.exp(-(g[k * n : k * n + n] + x[k * n : k * n + n]))) for k in (0, 1))
            h = z * h + (1 - z) * np.tanh(r * g[2 * n :] + x[2 * n :])
            k, j = divmod(y, lm.CLASS_WORDS)
            part = slice(k * lm.CLASS_WORDS, (k + 1) * lm.CLASS_WORDS)
            want += soft(h @ p["C"] + p["c"])[k] + soft(p["W"][part] @ h + p["w"][part])[j]
            before = y
        assert got == pytest.approx(want / np.log(10), rel=1e-5)


def test_texts_are_read_to_count_and_to_encode_only(spark):
    """Training and scoring take the encoded symbols; each task read and split its texts again before."""
    rows = corpus(60)
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    docs = docs.select("doc_id", F.udf(seen, "string")("text").alias("text"))
    got = lm.score_documents(docs, Scratch(spark, "lm")).collect()
    assert len(got) == len(rows) and read.value == 2 * len(rows)


def test_encoded_documents_are_those_looked_up(spark):
    words = [lm.END, *(f"w{i}".encode() for i in range(1500))]
    lexicon = lm.Lexicon(words, [5] * len(words), 5 * len(words), len(words), {})
    texts = {1: "W0 w1 w1200 never-seen never-seen w3", 2: None, 3: "", 4: "x " * 3000, 5: "w1499"}
    docs = spark.createDataFrame([(d + 10, d, d % 2, t) for d, t in texts.items()], "row long, doc_id long, round int, text string")
    found = lm._encode(docs, spark.sparkContext.broadcast(lexicon)).collect()
    whole, other = [r for r in found if r.word is None], [r for r in found if r.word is not None]
    assert {(r.row, r.doc_id, r.round) for r in whole} == {(d + 10, d, d % 2) for d in texts} and len(whole) == len(texts)
    for r in whole:
        numbers, _ = lexicon.look_up(texts[r.doc_id] and texts[r.doc_id].encode())
        assert np.frombuffer(r.symbols, "<i2").tolist() == lm._symbols(lexicon, numbers).tolist() and r.n_tokens == len(numbers)
        kept = numbers[numbers >= 0]
        assert (r.n_known, r.base, r.within) == pytest.approx((len(kept), lexicon.base[kept].sum(), lexicon.within[kept].sum()))
    assert {(r.row, bytes(r.word), r.n_tokens, r.tail) for r in other} == {(11, b"never-seen", 2, lm.tail_bucket(b"never-seen")), (14, b"x", 3000, lm.tail_bucket(b"x"))} and len(other) == 2


def test_sums_of_runs():
    rng = np.random.default_rng(8)
    starts = np.array([0, 1, 2, 40, 41, 290])
    for kind in (np.float32, np.float64):
        rows = rng.normal(size=(300, 3 * lm.HIDDEN)).astype(kind)
        got = lm._sums(rows, starts)
        assert got.dtype == kind and got == pytest.approx(np.array([part.sum(axis=0) for part in np.split(rows, starts[1:])]), abs=1e-4)
