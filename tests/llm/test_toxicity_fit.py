"""The fit of the toxicity model keeps its rows: shared passages, copies, repeated rows, nulls."""

import random

import pytest
from pyspark.sql import functions as F

from pitwise.llm import toxicity


def corpus(spark, passage: str, copies: int = 0):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(900)]
    texts = []
    for i in range(1200):
        body = rnd.choices(words, k=rnd.randrange(40, 120))
        if i % 5 == 0:
            body[9:9] = rnd.choices(["vile", "filth", "scum", "hateful"], k=6)
        texts.append((i, f"{passage} {' '.join(body)}", int(i % 5 == 0)))
    texts += [(2000 + i, f"{passage} same old thing told again and again by all {i % 3}", 1) for i in range(copies)]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t, _ in texts], "doc_id long, text string, weight string, y int").repartition(4)
    return docs, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")


@pytest.mark.parametrize("passage", ["", " ".join(f"p{i}" for i in range(120))])
def test_shared_passage_keeps_the_fit(spark, passage):
    docs, labels = corpus(spark, passage)
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).where(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").collect()
    bad, good = ([r["score"] >= toxicity.THRESHOLD for r in got if r["toxic"] == y] for y in (1, 0))
    assert sum(bad) >= 0.95 * len(bad) and sum(good) <= 0.02 * len(good)
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", 20_000)
    assert rows.count() == labels.where(~toxicity.held_out(F.col("doc_id"))).count()


def test_copies_weigh_as_one(spark):
    docs, labels = corpus(spark, "", copies=600)
    rows = toxicity.training_rows(docs, labels, "doc_id", "text", 20_000)
    same = rows.where("text LIKE '% same old thing%'").agg(F.sum("weight"), F.count("*")).first()
    assert same[1] > 300 and same[0] <= 20 * toxicity.UNIT
    again = docs.unionByName(docs)
    assert toxicity.training_rows(again, labels, "doc_id", "text", 20_000).count() == 2 * rows.count()
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, None), (2, ""), (3, "x")], "doc_id long, text string")
    assert toxicity.training_rows(nulls, spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int"), "doc_id", "text", 9).count() <= 2
