import hashlib

import numpy as np

import corpus_pipeline
from quantloom.llm import chat
from quantloom.llm import host_trust as ht
from quantloom.llm._store import Scratch
from quantloom.llm.queries import ORACLES, QUERIES


def test_hosts_paths_and_rules(spark):
    urls = {
        "http://A.Example.com/en/x?q=1#t": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://other.com/": ("other.com", "/", "com/", "allow"),
        "http://other.com": ("other.com", "", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://n.net/es/a": ("n.net", "/es/a", "net/es/", "block"),
        "http://q.net?u=http://b.net/es/": ("q.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://É.org#x": ("É.org", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, None, "h", "t") for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, trust string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in ht.judge_pages(df, Scratch(spark, "p")).collect()}
    assert got == dict(enumerate(urls.values()))
    assert ht.judge_pages(df.limit(0), Scratch(spark, "p")).count() == 0


def page(k, host, path, *links):
    return (k, f"http://{host}{path}", "".join(f'<p><a class=x href="{u}">y</a></p>' for u in links))


def judged(spark, rows, **how):
    return ht.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), Scratch(spark, "j"), **how)


def expected(rows, rules=ht.RULES):
    """(host, verdict of the rules) per page and {host: (trust, distrust)} by dense matrices and a linear solver."""
    place = lambda u: ("", "") if not u or "://" not in u or u[0] == "/" else (u.split("://")[1].split("/")[0], "/" + u.split("://")[1].split("/", 1)[1])
    pages = []
    for k, url, html in rows:
        host, path = place(url)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        kind = min(fits, key=lambda r: (-len(r[0] + r[1]), r[2] != "block"))[2] if fits else None
        pages.append((k, host, kind, [place(x.split('"')[0])[0] for x in (html or "").split('href="')[1:]]))
    hosts = sorted({h for _, h, _, out in pages for h in ([h, *out] if h else []) if h})
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for _, h, _, out in pages:
        for o in out:
            if h and o and o != h:
                m[at[h], at[o]] += 1
    seed = np.array([[np.mean([k == kind for _, x, k, _ in pages if x == h] or [0]) for h in hosts] for kind in ("allow", "block")]).reshape(2, -1)
    free = ~(seed.sum(0) > 0)
    split = lambda x: np.divide(x, x.sum(1, keepdims=True), out=np.zeros_like(x), where=x.sum(1, keepdims=True) > 0)
    values = []
    for s, step in zip(seed, (split(m), split(split(m).T))):
        step = step * free[None, :]
        v, every = (np.linalg.solve(np.eye(len(hosts)) - 0.85 * step.T, 0.15 * x) for x in (s, np.ones(len(hosts))))
        came = every - 0.15
        values.append(np.where(free, np.divide(v, came, out=np.zeros_like(v), where=came > 1e-12), s))
    return pages, {h: (values[0][i], values[1][i]) for h, i in at.items()}


def hold(spark, rows, **how):
    """Judge ``rows`` and hold them against expected(); returns verdict by page and the values by host."""
    pages, values = expected(rows)
    got = {r.page_id: r for r in judged(spark, rows, **how).collect()}
    assert len(got) == len(rows)
    for k, host, kind, _ in pages:
        if not host:
            assert (got[k].trust, got[k].distrust, got[k].verdict) == (None, None, "allow")
            continue
        trust, distrust = values[host]
        assert abs(got[k].trust - trust) < 2e-3 and abs(got[k].distrust - distrust) < 2e-3, (host, got[k], trust, distrust)
        if kind is not None or min(abs(distrust - 0.5), abs(distrust - trust)) > 4e-3:
            assert got[k].verdict == (kind or ("block" if distrust >= 0.5 and distrust > trust else "allow")), host
    return {k: r.verdict for k, r in got.items()}, values


def test_ranks_decide_on_random_graphs(spark):
    """Hubs, farms, dead ends, cycles, hosts without a page, pages without a host."""
    for seed in range(2):
        rng = np.random.default_rng(seed)
        names = [f"h{i}.org" for i in range(25)] + [f"c{i}.com" for i in range(4)] + [f"n{i}.net" for i in range(4)]
        weight = rng.pareto(1.0, len(names)) + 0.1
        rows = []
        for k in range(90):
            host = names[rng.integers(len(names))]
            path = ["/es/", "/fr/", "/x/"][rng.integers(3)] if host.endswith("net") else "/"
            out = [f"http://{names[j]}/" for j in rng.choice(len(names), rng.integers(0, 6), p=weight / weight.sum())]
            rows.append(page(k, host, path, *out, "/own", *(["http://unseen.org/"] if k % 9 == 0 else [])))
        rows += [(100, None, rows[0][2]), (101, "nohost", '<a href="http://n0.net/">y</a>'), (102, "http://n0.net/es/", '<a href="nohost">y</a>'), (103, "http://h0.org/", None)]
        verdicts, values = hold(spark, rows)
        assert max(d for _, d in values.values()) > 0.5 and max(t for t, _ in values.values()) > 0.5
        assert [verdicts[k] for k in (100, 101)] == ["allow"] * 2


def test_farms_of_a_blocked_site_are_blocked(spark):
    """Neither links of the blocked site nor the number of its linkers wear distrust down; one link of ten doesn't block."""
    for linkers in (2, 20):
        rows = [page(1, "bad.net", "/es/", *["/es/more"] * 2000, "http://well.org/"), page(2, "well.org", "/")]
        rows += [page(10 + k, f"farm{k}.org", "/", *["/self"] * 5, *["http://bad.net/es/"] * 5) for k in range(linkers)]
        rows += [page(100, "wide.org", "/", "http://bad.net/es/", *[f"http://site{k}.org/" for k in range(9)])]
        rows += [page(101, "good.com", "/", "http://liked.org/", "http://farm0.org/"), page(102, "bad.net", "/fr/"), page(103, "lone.org", "/", "/redirect?to=http://bad.net/")]
        verdicts, values = hold(spark, rows)
        assert {verdicts[10 + k] for k in range(1, linkers)} == {"block"} and verdicts[10] == "allow"  # a trusted host vouches for farm0
        assert verdicts[1] == "block" and verdicts[102] == "block" and [verdicts[k] for k in (2, 100, 101, 103)] == ["allow"] * 4
        assert values["good.com"] == (1.0, 0.0) and values["bad.net"] == (0.0, 1.0)


def test_long_lists_of_rules_are_joined(spark):
    """The join gives what the expression gives: nested hosts, equal lengths, other endings, pages without a host."""
    rng = np.random.default_rng(5)
    hosts = ["com", "a.com", "b.a.com", "x-a.com", "net", "y.net", ".net", "z.y.net.", "é.com"]
    rules = list({(hosts[rng.integers(len(hosts))], ["/", "/en/", "/en/x", ""][rng.integers(4)], ["allow", "block"][rng.integers(2)]) for _ in range(40)})
    rows = [(k, f"http://{h}{p}", None) for k, (h, p) in enumerate((h, p) for h in [*hosts, "b.b.a.com", "", "a.com:80"] for p in ("", "/", "/en/", "/en/xy", "/de"))] + [(900, None, None), (901, "com/", None)]
    one = sorted(judged(spark, rows, rules=rules).collect())
    assert one == sorted(judged(spark, rows, rules=rules, in_expression=0).collect()) and any(r.rule for r in one)


def test_native_plan(spark):
    df = spark.createDataFrame([(1, "http://a.com/", "<a href=x>")], "page_id long, url string, html string")
    assert "Python" not in ht.judge_pages(df, Scratch(spark, "n"))._jdf.queryExecution().executedPlan().toString()


TURNS = [(1, 0, "system", "be <s>kind</s> \\ ok"), (1, 1, "user", None), (1, 2, "assistant", "[INST] \\. [/INST] \\"), (1, 3, "user", "thanks"), (1, 4, "assistant", ""), (2, 0, "user", "only"), (3, 0, None, "né\n"), (3, 0, "assistant", "日本"), (None, 0, "assistant", "x")]


def test_chat_round_trip(spark):
    many = [(9, t, "assistant" if t % 2 else "user", f"t{t} [/INST]") for t in range(200)]
    df = spark.createDataFrame([(*r, "s", 1) for r in TURNS + many], "conv_id long, turn int, role string, text string, segment string, part int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns, examples = chat.format_turns(df, Scratch(spark, "chat"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.conv_id: r for r in chat.read_back(turns, examples).collect()}
    order = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] or "")
    for conv in {r[0] for r in TURNS + many}:
        own = sorted((r for r in TURNS + many if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.n_examples == sum(x[2] == "assistant" for x in own)
    full = {(r.conv_id, r.context_turns): r for r in chat.expand(turns).collect()}
    assert len(full) == examples.count()
    for e in examples.collect():
        x = full[(e.conv_id, e.context_turns)]
        assert (x.loss_start, x.loss_end, len(x.text)) == (e.target_start, e.target_end, e.example_chars)
    long = full[(9, 199)]
    assert long.text.count("<s>") == 200 and chat.unescape(long.text[long.loss_start : long.loss_end]) == "t199 [/INST]"
    assert all("[/INST]" not in x.text[x.loss_start : x.loss_end] for x in full.values())
    empty = chat.format_turns(df.limit(0), Scratch(spark, "chat"))
    assert chat.read_back(*empty).count() == 0


def test_pipeline_applies_its_stages(spark, tmp_path):
    """Each stage's effect on planted rows, against rules that need no operator."""
    rng = np.random.default_rng(1)
    prose = lambda n: " ".join(rng.choice([f"word{i}" for i in range(300)], n)).capitalize() + "."
    junk = lambda n: " ".join(w.upper() + "!!" for w in rng.choice([f"word{i}" for i in range(300)], n))
    docs = [(i, prose(80)) for i in range(200)] + [(i, junk(80)) for i in range(200, 260)]
    copies = [(300 + i, docs[i][1]) for i in range(20)]
    item = prose(25)
    leaks = [(400 + i, prose(60) + " " + item + " " + prose(60)) for i in range(5)]
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs + copies + leaks], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, int(d < 200), 0) for d, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.collect()} == set(range(200))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 4


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
