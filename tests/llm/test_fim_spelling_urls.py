"""Fill-in-the-middle, spelling variants and URL filters against brute force on edge rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.llm import fim, spelling, urlfilter

LINES = re.compile(r"[^\n]*\n|[^\n]+")
LETTERS = re.compile("[A-Za-z\u00C0-\u00FF]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- fill-in-the-middle ---

def brute_fim(key, text, rate=100, suffix_first=50):
    text = text or ""
    units = LINES.findall(text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_EDGES = [None, "", "\n", "\n\n\n", "no newline", "one\n", "a\nb", "naïve\n日本\n🙂 last", "has <M> in\nit", "has <P\n>", "<\nS>x<\n",
             "".join(f"line {i} {'x' * (i * i % 701)}\n" for i in range(9_000)), "z" * 300_000 + "\n" + "y\n" * 5_000, "\r\n\r\nmac\rold"]


@pytest.mark.parametrize(("rate", "suffix_first"), [(100, 50), (40, 0), (0, 50)])
def test_fim_edges(spark, rate, suffix_first):
    rows = [(i % 11 if i else None, t, "own", 5, "other") for i, t in enumerate(FIM_EDGES * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, n int, body string").repartition(3)
    got = fim.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    assert set(got.columns) == {"doc_id", "text", "body", "n", "form", "prefix_chars", "middle_chars", "output"}
    back = got.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = Counter((k, t) + brute_fim(k, t, rate, suffix_first) for k, t, *_ in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back) == want
    assert all(r.back == (r.text or "") for r in back)


def test_fim_whole_table(small_docs, no_docs):
    got = fim.fill_in_middle(small_docs).collect()
    assert len(got) == small_docs.count()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r.doc_id, r.text)
    assert fim.fill_in_middle(no_docs).count() == 0


@pytest.mark.parametrize("error", [1, 64, 4096, 10**6])
def test_rank_index_is_exact_and_bounded(error):
    rng = np.random.default_rng(1)
    for steps in (np.ones(5_000, int), rng.integers(1, 400, 20_000), rng.pareto(1.0, 3_000).astype(int) + 1, np.array([7]),
                  np.repeat([1, 50_000, 3], 700)):
        values = np.cumsum(steps)
        index = fim.RankIndex(values, error)
        assert (index.lookup(np.arange(len(values))) == values).all()
        assert np.abs(index.residual.astype(int)).max() <= error + 1
    assert len(fim.RankIndex(np.arange(100_000) * 37, error).first) == 1         # one line, whatever its length
    assert len(fim.RankIndex(np.zeros(0, np.int64), error).first) == 0


# --- spelling variants ---

def brute_words(rows, every=97):
    counts = Counter()
    for key, text in rows:
        for run in LETTERS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows, every=97):
    words = brute_words(rows, every)
    near = defaultdict(list)
    for w in words:
        near[w] = [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_edit(v, w)]
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def got_groups(docs, **options):
    rows = spelling.spelling_groups(docs, **options).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def spelling_rows():
    long = "abcdefghij" * 7
    chain = [("colour", 40), ("colouur", 20), ("colouuur", 10), ("coluuuur", 5), ("color", 21), ("Colors", 3), ("aaaaa", 8), ("aaaaaa", 4),
             ("aaaaaaa", 3), ("ananas", 9), ("ananans", 3), ("nananas", 3), ("straße", 6), ("strasse", 5), ("straÿe", 3), ("straõe", 3), ("STRAßE", 1),
             ("Ärger", 3), ("ärger", 7), ("four", 90), ("twice", 2), (long[:63], 4), (long[:64], 9), (long[:65], 30), (long[:66], 3),
             (long[:40] + "é" + long[41:64], 4), (long[:64] + "é", 3), ("q" * 64, 5), ("q" * 65, 11), ("q" * 66, 3), ("w" * 3000, 3), ("w" * 3001, 7)]
    rows = [(i, w) for w, n in chain for i in range(n)]
    return rows + [(None, None), (1, ""), (2, "x1y2_z"), (3, "apple×pie÷ab apple×pie÷ab apple×pie÷ab"), (4, "š wordsš words words"), (4, "š wordsš words words")]


@pytest.mark.parametrize("every", [97, 3])
def test_spelling_edges(spark, every):
    rows = spelling_rows()
    docs = spark.createDataFrame([(k, t, "own", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    assert got_groups(docs, every=every) == brute_groups(rows, every)


def test_spelling_table(small_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect() if r.doc_id < 60]
    assert got_groups(small_docs.where("doc_id < 60")) == brute_groups(rows)
    assert spelling.spelling_groups(no_docs).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_groups(no_docs, ratio=1)


def test_rotations_are_few(spark):
    """Each word of L letters gives 2 L + 1 rows, whatever its group."""
    words = spark.createDataFrame([("abcde", 3), ("x" * 64, 3), ("y" * 65, 3), ("z" * 500, 3)], "word string, n long")
    assert {r.word: r.c for r in spelling.rotations(words).groupBy("word").agg(F.count("*").alias("c")).collect()} == {
        "abcde": 11, "x" * 64: 129, "y" * 65: 131, "z" * 500: 1001}


# --- URL filters ---

URLS = {None: ("", ""), "": ("", ""), "no scheme/at all": ("", ""), "http://": ("", ""), "HTTP://Www.EXAMPLE.org/Path?q#f": ("www.example.org", "/Path"),
        "http://a.org": ("a.org", ""), "http://a.org?x=/y": ("a.org", ""), "http://a.org#x://b/c": ("a.org", ""), "x://y://z/w": ("y:", "//z/w"),
        "http://ÄB.com/fr/é?": ("Äb.com", "/fr/é"), "http://u@a.co.uk:80/p": ("u@a.co.uk:80", "/p"), "http://1.2.3.4/x": ("1.2.3.4", "/x"),
        "http://a.\norg/\nx": ("a.\norg", "/\nx"), "http://example.org/es/1": ("example.org", "/es/1"), "http://notexample.org/es/1": ("notexample.org", "/es/1"),
        "http://example.org/en/12": ("example.org", "/en/12"), "http://m.example.org/en/2": ("m.example.org", "/en/2"), "http://com/de/x": ("com", "/de/x")}
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BY_RULE = {"HTTP://Www.EXAMPLE.org/Path?q#f": "org/", "http://ÄB.com/fr/é?": "com/fr/", "http://example.org/es/1": "example.org/es/",
           "http://notexample.org/es/1": "org/", "http://example.org/en/12": "example.org/en/1", "http://m.example.org/en/2": "org/", "http://com/de/x": "com/de/"}


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "own", "no") for i, u in enumerate(URLS)], "page_id long, url string, Host string, own_host string")
    none = spark.createDataFrame([], "page_id long, good int")
    got = urlfilter.judge_urls(pages, none, RULES).collect()
    assert {r.url: (r.host, r.path) for r in got} == URLS and {r.own_host for r in got} == {"no"}
    verdicts = dict((rule, v) for v, rule in RULES)
    assert {r.url: (r.rule, r.verdict) for r in got} == {u: (BY_RULE.get(u), verdicts.get(BY_RULE.get(u), "allow")) for u in URLS}
    empty = pages.where("page_id < 0")
    assert urlfilter.judge_urls(empty, none, RULES).count() == 0


def brute_reputation(pages, outcomes, risk=0.05):
    """pages: (id, host); outcomes: (id, good)."""
    hosts = defaultdict(lambda: [0, 0])
    by = defaultdict(list)
    for i, g in outcomes:
        if i is not None and g is not None:
            by[i].append(g)
    for i, h in pages:
        hosts[h][0] += len(by[i]) if i is not None else 0
        hosts[h][1] += sum(by[i]) if i is not None else 0

    def parts(h):
        name = re.sub(r"^.*@|:[0-9]*$|\.$", "", h)
        if re.search(r"^[0-9.]+$|^\[", name):
            return name, ""
        deep = 2 if ".".join(name.split(".")[-2:]) in urlfilter.SECOND_LEVEL else 1
        return ".".join(name.split(".")[-deep - 1:]), ".".join(name.split(".")[-deep:])

    def up(members, level):
        out = defaultdict(lambda: [0, 0])
        for m, (n, k) in members.items():
            out[level(m)][0] += n
            out[level(m)][1] += k
        return out

    def shrink(members, above):
        s = a = b = 0.0
        for m, (n, k) in members.items():
            if n:
                p = above(m)
                s, a, b = s + (k - n * p) ** 2, a + n * p * (1 - p), b + n * (n - 1) * p * (1 - p)
        rho = (s - a) / b if b else 1.0
        w = 1 / min(max(rho, 1e-4), 0.5) - 1
        return {m: ((k + w * above(m)) / (n + w), n + w) for m, (n, k) in members.items()}

    domains = up(hosts, parts)
    suffixes = up(domains, lambda d: d[1])
    n, k = (sum(x[i] for x in suffixes.values()) for i in (0, 1))
    top = (k + 1) / (n + 2)
    s1 = shrink(suffixes, lambda s: top)
    d1 = shrink(domains, lambda d: s1[d[1]][0])
    h1 = shrink(hosts, lambda h: d1[parts(h)][0])
    return {h: (p, min(1.0, p + min((p * (1 - p) / (w + 1) * (1 - risk) / risk) ** 0.5, (np.log(1 / risk) / (2 * (w + 1))) ** 0.5)))
            for h, (p, w) in h1.items()}


def test_reputation(spark):
    rng = np.random.default_rng(3)
    names = [f"{a}.{b}" for b in ("spam.com", "fine.com", "odd.co.uk", "x.net") for a in ("www", "m", "a", "b", "c")] + ["", "com", "10.0.0.1", "fine.com."]
    pages = [(int(i) if i % 17 else None, names[int(abs(rng.normal()) * 7) % len(names)]) for i in range(4_000)] + [(5, "www.spam.com")] * 30
    bad = {"spam.com": 0.05, "odd.co.uk": 0.5}
    outcomes = [(i, None if i % 50 == 3 else int(rng.random() < next((p for d, p in bad.items() if h.endswith(d)), 0.95)))
                for i, h in pages[:2_000] if i is not None] + [(None, 1), (10**9, 0)]
    df = spark.createDataFrame(pages, "page_id long, host string").repartition(5)
    got = {r.host: (r.good_rate, r.good_bound) for r in urlfilter.host_reputation(df, spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    want = brute_reputation(pages, outcomes)
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], rel=1e-9), h
    urls = df.select("page_id", F.concat(F.lit("http://"), "host", F.lit("/a")).alias("url"))
    judged = urlfilter.judge_urls(urls, spark.createDataFrame(outcomes, "page_id long, good int"))
    blocked = {r.host for r in judged.where("verdict = 'block'").select("host").distinct().collect()}
    assert blocked == {h for h, (_, bound) in want.items() if bound < 0.5}
    assert {"www.spam.com", "m.spam.com"} <= blocked and not any(h.endswith("fine.com") for h in blocked)
    assert urlfilter.keep_allowed(urls, spark.createDataFrame(outcomes, "page_id long, good int")).count() == judged.where("verdict = 'allow'").count()
