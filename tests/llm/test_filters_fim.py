import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import filter_audit as fa
from quantloom.llm import fim
from quantloom.llm import outliers as ol
from quantloom.llm._store import Scratch

GAP = re.compile("[\x20\x09-\x0d]+")


def words(t):
    return [w for w in GAP.split(t or "") if w]


# --- 11: filter orders


def test_plain_changes_visit_every_order_once():
    for k in range(1, 7):
        order = list(range(k))
        seen = [tuple(order)]
        for i in fa.plain_changes(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.append(tuple(order))
        assert sorted(seen) == sorted(itertools.permutations(range(k)))


def brute_audit(docs, labels, filters="ABCDE"):
    """Every order applied document by document."""
    marks = []
    for doc_id, text, source in docs:
        t = text or ""
        ws = words(t)
        copy = doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == t for o in docs)
        fails = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        own = [r for r in labels if doc_id is not None and r[0] == doc_id]
        marks.append((source or "", {f for f in filters if fails[f]}, any(r[1] == 1 for r in own), any(r[2] == 1 for r in own)))
    out = {}
    for part in {m[0] for m in marks}:
        mine = [m for m in marks if m[0] == part]
        removed_by = Counter()
        for order in itertools.permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                removed_by[f] += len(gone)
                fails = sum(f in m[1] for m in mine)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(m[1] == {f} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(11)
    pool = ["", None, "word " * 60, "A B C", " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)) + " #", "UPPER " * 3 + " ".join(f"w{i}" for i in range(60))]
    docs = [(i if rng.random() < 0.95 else None, rng.choice(pool) if rng.random() < 0.7 else " ".join(rng.choice(["a", "b", "c1", "D", "$"]) for _ in range(rng.randrange(80))), rng.choice(["s1", "s2", None])) for i in range(120)]
    docs += docs[:7] + [(5, docs[5][1], "s2"), (500, "e" * 300_000 + " x" * 40_000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, source string, part string, mask int").repartition(5)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_rows(fa.audit(fa.count_cells(fa.text_failures(df), marked), "ABCDE"))
    assert got == brute_audit(docs, labels)
    assert fa.audit(fa.count_cells(fa.text_failures(df.limit(0)), marked), "ABCDE").count() == 0
    assert audit_rows(fa.audit(fa.count_cells(fa.text_failures(df), marked.limit(0)), "ABCDE")) == brute_audit(docs, [])


def test_audit_of_other_filter_sets(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 2, 0, 1), ("p", 3, 4, 4, 0), ("q", 7, 1, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = audit_rows(fa.audit(cells, "xyz"))
    assert len(got) == 2 * 6 * 3
    assert got["p", "xyz", 1] == [5, 6, 0, 2, 4, 1, 6 * 3 + 2 * 3] and got["p", "yxz", 1] == [7, 4, 0, 0, 4, 0, 12]
    assert got["q", "zyx", 3] == [0, 0, 1, 0, 0, 0, 2]
    assert len(audit_rows(fa.audit(cells.where("mask < 2"), "x"))) == 1
    with pytest.raises(ValueError):
        fa.audit(cells, "aa")


# --- 12: robust outliers


def base_counts(t):
    t = t or ""
    ws = words(t)
    runs = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    cover = {j for i in range(len(ws) - 4) if runs[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def prose(rng, n):
    return " ".join(rng.choice("the of river house green to walk and old stone a bright morning people far from light".split()) + rng.choice(["", "", "s", f"{rng.randrange(40)}", "ing"]) for _ in range(n))


def test_statistics_equal_a_plain_count(spark):
    rng = random.Random(1)
    texts = [None, "", "\n", "\n\n a\n a\n", "a b c d e a b c d e", "é é é é é é é é", "A a\nA a\nA a \n", "x" * 400_000, "ab cd " * 60_000]
    texts += ["".join(rng.choice(["a", "b", "A", "é", "日", "#", "$", " ", "\n", "\t", "\x0b", "word ", "a b c d e "]) for _ in range(rng.randrange(60))) for _ in range(400)]
    rows = [*enumerate(texts), (None, "a b"), (3, texts[3])]
    df = spark.createDataFrame([(a, b, None, 7) for a, b in rows], "doc_id long, text string, lang string, source int").repartition(3)
    got = ol.judge(df, Scratch(spark, "o"))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=str) == sorted(((d, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]) for d, t in rows for c in [base_counts(t)]), key=str)
    assert ol.judge(df.limit(0), Scratch(spark, "o")).count() == 0
    assert got.where("kept is null or (base_failed and kept)").count() == 0


def plain_mcd(z, keep=0.75, steps=12, few=20.0):
    """The same estimate of one part over an array in memory."""

    def model(rows, factor):
        sums = np.concatenate([rows.sum(0), [(rows[:, i] * rows[:, j]).sum() for i, j in ol.PAIRS]]).astype(float)
        return ol._from_sums(len(rows), sums, factor, few)

    def far(m):
        inverse = np.zeros((ol.D, ol.D))
        for (i, j), c in zip(ol.PAIRS, m["form"]):
            inverse[i, j] = inverse[j, i] = c if i == j else c / 2
        off = z - np.array(m["centre"])
        return np.minimum(np.floor(ol.FINE * np.log2(1 + np.maximum((off @ inverse * off).sum(1), 0))), ol.BINS)

    centre = np.sort(z, 0)[(len(z) - 1) // 2].astype(float)
    wide = 1.4826 * np.sort(np.abs(z - centre), 0)[(len(z) - 1) // 2]
    found = [ol._shape(centre, np.diag(wide**2 + (ol.FLOOR * ol.GRID) ** 2)), model(z, 1.0)]
    for _ in range(steps):
        for k, m in enumerate(found):
            at = far(m)
            cut = np.sort(at)[int(np.ceil(keep * len(z))) - 1]
            edge = ol.chi2_at(min((at <= cut).sum() / len(z), 0.9999), ol.D)
            found[k] = model(z[at <= cut], min(ol.chi2_below(edge, ol.D) / ol.chi2_below(edge, ol.D + 2), 4.0))
    at = far(min(found, key=lambda m: m["logdet"]))
    cut = max(at[at < ol.FINE * np.log2(1 + ol.chi2_at(0.975, ol.D))])
    edge = 2 ** ((cut + 1) / ol.FINE) - 1
    return model(z[at <= cut], min(ol.chi2_below(edge, ol.D) / ol.chi2_below(edge, ol.D + 2), 4.0))


def test_estimates_equal_a_plain_version_in_any_layout(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(900, ol.D)) @ rng.normal(size=(ol.D, ol.D)) * 60 + 2000
    base[:150] += rng.normal(size=ol.D) * 3000  # a cluster of outliers
    z = np.unique(np.round(base).astype(int), axis=0)
    other = np.unique(np.round(rng.normal(size=(60, ol.D)) * 200).astype(int), axis=0)
    df = spark.createDataFrame([((n,), row.tolist()) for n, rows in (("a", z), ("b", other), ("one", other[:1])) for row in rows], "part struct<by0: string>, z array<long>")
    answers = []
    for parts, sent in ((1, 2000), (7, 2000), (3, 0)):
        s = Scratch(spark, "mcd")
        models = ol.RobustModels(s.write(df.repartition(parts), "v"), s, most_sent=sent).models.collect()
        answers.append({r.part.by0: r.models[0] for r in models})
    assert answers[0] == answers[1] == answers[2]  # sums of whole numbers
    for name, rows in (("a", z), ("b", other)):
        want, got = plain_mcd(rows), answers[0][name]
        assert np.allclose(got.centre, want["centre"]) and np.allclose(got.form, want["form"])
    clean = z[np.argsort(np.abs(z - np.median(z, 0)).sum(1))[: len(z) // 2]]
    assert np.abs(np.array(answers[0]["a"].centre) - clean.mean(0)).max() < 0.2 * clean.std(0).max()


def test_outliers_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    good = [(i, prose(rng, rng.randrange(80, 900)), "en", "s") for i in range(400)]
    copies = [(1000 + i, good[0][1], "en", "s") for i in range(900)]
    symbols = [(3000 + i, " ".join(rng.choice(["<|>", "##", "$%", "a"]) for _ in range(200)), "en", "s") for i in range(10)]
    numbers = [(4000 + i, " ".join(str(rng.randrange(10**6)) for _ in range(200)), "en", "s") for i in range(10)]
    lone = [(5000, prose(rng, 100), "xx", None)]
    df = spark.createDataFrame(good + copies + symbols + numbers + lone, "doc_id long, text string, lang string, source string").repartition(4)
    got = {r.doc_id: r.kept for r in ol.judge(df, Scratch(spark, "o")).collect()}
    assert all(got[d[0]] for d in good + copies + lone)
    assert not any(got[d[0]] for d in symbols + numbers)


def test_chi_square():
    assert abs(ol.chi2_below(7.344, 8) - 0.5) < 1e-3 and abs(ol.chi2_at(0.975, 8) - 17.535) < 1e-3


# --- 13: fill-in-middle


def brute_fim(doc_id, text, form):
    t = text or ""
    h = hashlib.sha256(f"{form.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if form.unit == "code point":
        units = list(t)
    elif form.unit == "line":
        units = t.splitlines(keepends=True) if "\r" not in t else None
        units = re.findall("[^\n]*\n|[^\n]+", t)
    else:
        units = re.findall("^[\x20\x09-\x0d]+|[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", t)
    n = len(units)
    if not t or any(m in t for m in form.marks) or h3 % 100 >= form.fim_rate:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    P, S, M = form.marks
    return (doc_id, n, "spm", len(p), len(m), S + s + P + p + M + m) if h4 % 100 < form.spm_rate else (doc_id, n, "psm", len(p), len(m), P + p + S + s + M + m)


@pytest.mark.parametrize("form", [fim.Form(), fim.Form(every=1), fim.Form(every=7, unit="word", spm_rate=50), fim.Form(seed=9, every=3, unit="line", fim_rate=100), fim.Form(prefix="<fim_prefix>", suffix="<fim_suffix>", middle="<fim_middle>")])
def test_fill_in_middle_equals_slicing(spark, monkeypatch, form):
    rng = random.Random(2)
    texts = [None, "", "a", "<P>", "a <S> b", "x<M", "<", "日", "\n\n", "  a  b ", "é" * 300_000 + "日本 \n" * 100_000, "<P" * 50]
    texts += ["".join(rng.choice(["a", "é", "日", "𝔸", " ", "\n", "<", ">", "S>", "\t\t", "word"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    rows = [*enumerate(texts), (None, "some words here"), (None, None), (12, texts[12]), (12, "other")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h1 string, output int").repartition(3)
    made = fim.fim_transform(df, form)
    got = made.withColumn("back", fim.restore("output", "form", form)).collect()
    want = [brute_fim(d, t, form) for d, t in rows]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted(want, key=str)
    assert sorted(str((r.doc_id, r.back)) for r in got) == sorted(str((d, t or "")) for d, t in rows)
    assert fim.fim_transform(df.limit(0), form).count() == 0


def test_checkpoints_across_slices(monkeypatch):
    monkeypatch.setattr(fim, "SLICE", 5)
    rng = random.Random(4)
    for unit in fim.UNITS:
        for _ in range(60):
            t = "".join(rng.choice(["a", "é", "日", " ", "\n", "bc"]) for _ in range(rng.randrange(40)))
            units = {"code point": list(t), "line": re.findall("[^\n]*\n|[^\n]+", t), "word": re.findall("^[\x20\x09-\x0d]+|[^\x20\x09-\x0d]+[\x20\x09-\x0d]*", t)}[unit]
            index = fim.Checkpoints(np.frombuffer(t.encode(), np.uint8), unit, rng.randrange(1, 6))
            assert index.n == len(units) and index.chars == len(t) and len(index.units) <= 1 + -(-len(units) // 1)
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert index.cut(k) == (len(head.encode()), len(head))


def test_overlapping_marks_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "b", "c"), ("aba", "x", "y"), ("ab", "bc", "d"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.Form(prefix=marks[0], suffix=marks[1], middle=marks[2])
