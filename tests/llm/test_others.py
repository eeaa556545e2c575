"""Toxicity, vectors, chats, and the pipeline: edge rows, empty tables, brute force, held-out accuracy."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitwise.llm import chat, nndescent, toxicity
from tests.llm.brute import components

# --- toxicity ---


def maximal(scores):
    """All maximal segments by their definition: the best segment, then those of what is left on both sides."""
    def best(a, b):
        found = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not found or found[0] <= 1e-9:
            return []
        total, _, i, j = found
        return best(a, i) + [(i, j - 1, total)] + best(j, b)
    return best(0, len(scores))


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(0, 25))
        scores = [float(rng.integers(1, 50)) / 7 if rng.random() < 0.4 else -1.3 for _ in range(n)]
        places = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(places, [scores[i] for i in places], 1.3)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in maximal(scores)]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in maximal(scores)])


@pytest.fixture(scope="session")
def toxic_docs(spark):
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(3000)]
    rows = []
    for i in range(900):
        text = list(rng.choice(words, int(rng.integers(20, 200))))
        bad = i % 5 == 0
        if bad:
            for k in sorted(rng.integers(0, len(text), 4)):
                text.insert(int(k), str(rng.choice(["vilescum", "rotten.", "Foulx" + str(rng.integers(1000))])))
        rows.append((i, " ".join(text), int(bad), "b"))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, body string")


def test_toxicity(spark, toxic_docs, edge_docs, no_docs):
    labels = toxic_docs.select("doc_id", "toxic").unionByName(spark.createDataFrame(
        [(None, 1), (5, None), (99999, 1), (5, 1), (5, 1)], "doc_id long, toxic int"))
    docs = toxic_docs.drop("toxic")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).join(toxic_docs.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    hits = [r.score >= 0.7 for r in got if r.toxic]
    assert sum(hits) >= 0.95 * len(hits) > 0
    assert not any(r.score >= 0.7 for r in got if not r.toxic)
    found = toxicity.passages(docs, model).collect()
    assert any("vilescum" in r.passage for r in found) and all(r.surprise > 0 for r in found)
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.count() == toxicity.score(docs, model).where("score < 0.7").count()
    # edge rows, clashing columns, nothing to learn from
    edges = toxicity.score(edge_docs, model).collect()
    assert len(edges) == edge_docs.count() and all(0 <= r.score <= 1 for r in edges)
    empty = {r.score for r in edges if not (r.text or "").strip()}
    assert len(empty) == 1
    nothing = toxicity.learn(no_docs, labels)
    assert toxicity.score(no_docs, nothing).count() == 0
    assert {r.score < 0.7 for r in toxicity.score(edge_docs, nothing).collect()} == {True}


# --- vectors ---

def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((120, 16))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(base)]
    for i in range(100):                                       # one large close group, beyond what a list holds
        rows.append((1000 + i, [float(x) for x in base[0] + 0.05 * rng.standard_normal(16)], 0))
    for i in range(30):                                        # pairs, scaled copies, equal copies
        rows.append((2000 + i, [float(2 * x) for x in base[i]], i % 3))
        rows.append((3000 + i, [float(x) for x in base[i]], i % 3))
        rows.append((4000 + i, [float(x) for x in base[i]], (i + 1) % 3))
    odd = [(9000, None, 0), (9001, [], 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0),
           (9005, [float("inf")] * 16, 0), (9006, [float(x) for x in base[1]], None), (9007, [1.0, 2.0], 0), (9008, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    sound = [(i, np.array(v), k) for i, v, k in rows + odd[7:]]
    links = [(a[0], b[0]) for n, a in enumerate(sound) for b in sound[n + 1:]
             if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= 0.98]
    degree = Counter(x for pair in links for x in pair)
    comp = components([i for i, *_ in rows + odd], links)
    got = {r.vec_id: r for r in nndescent.link_vectors(df).collect()}
    assert set(got) == set(comp)
    found = sum(r.n_links for r in got.values()) / (2 * len(links))
    assert found >= 0.99 and all(r.n_links <= degree[i] for i, r in got.items())
    if found == 1:
        assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert nndescent.link_vectors(df.where("false")).count() == 0


# --- chats ---

def test_chats(spark):
    ends = ["\\", "\\\\", "#", "<", "\\#", "</turn>\n### assistant: x</turn>", "### user: ", "a: b", "é🙂\\", "", None]
    rows = [(c, t, role, ends[(c + t) % len(ends)]) for c in range(30) for t, role in enumerate(["system", "user", "assistant", "we: ird\n<#\\", None, "assistant"])]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (5, 1, "user", ends[6]), (77, 0, "assistant", "long " * 300_000)]
    rows += [(88, t, "assistant" if t % 2 else "user", "turn \\ " * 2000 + str(t)) for t in range(600)]       # beyond one part
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat.format_chats(df.repartition(5))
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    assert set(got) == set(by)
    text = defaultdict(str)
    for r in sorted(parts.collect(), key=lambda r: r.part):
        text[r.conv_id] += r.formatted
    for conv, turns in by.items():
        turns = sorted(turns, key=lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        loss = "".join(t or "" for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(loss), len(text[conv]))
        assert r.turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert chat.read_turns(text[conv].encode()) == [((a or "").encode(), (b or "").encode()) for _, _, a, b in turns]
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


# --- pipeline ---

def test_pipeline(spark):
    import corpus_pipeline as P
    from pitwise.llm import mixing
    from tests.llm.brute import simhash_classes

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "sentencepiece"]
    clean = P.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    flagged = toxicity.score(docs, toxicity.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score >= 0.7").count()
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert len(rows) == docs.count() - flagged
    best = {}
    for i, t in rows:
        k = (t or "").translate({c: None for c in (32, 9, 10, 11, 12, 13)})
        best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i))
    kept = {i for _, i in best.values()}
    near = simhash_classes([(i, t) for i, t in rows if i in kept])
    kept = {c for _, c in near.values()}
    taken = Counter()
    for r in mixing.mix(docs.where(F.col("doc_id").isin(sorted(kept)))).collect():
        if r.copies:
            taken[r.doc_id] = r.copies
    assert Counter(r.doc_id for r in P.run(spark, sf).collect()) == taken
