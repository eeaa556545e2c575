import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, body string, key string, th int, fp int"


def rows(*texts, first=0):
    """Documents with clashing extra columns; texts as given."""
    return [(first + i, t, "en", None if i % 5 == 4 else f"s{i % 3}", len(t or ""), 7, "no", "own", "k", 1, 2)
            for i, t in enumerate(texts)]


LONG = " ".join(f"w{i % 9973} x{i % 101}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
EDGES = [None, "", "   \t\n", "one", "Two words", LONG, LONG + " end", "a b c d", "A  b\nc d", "a b c d", None,
         f"{PASSAGE} tail one", f"head two {PASSAGE}", f"mid {PASSAGE} {PASSAGE} end", "naïve İ! ﬁ é 日本 🙂 x y",
         "".join(chr(c) for c in range(9, 14)) + "z", " ".join(["rep"] * 200), " ".join(["rep"] * 90)]


@pytest.fixture(scope="session")
def edge_docs(spark):
    out = rows(*EDGES)
    out += [out[7], out[7]]                                   # fully repeated rows
    out.append((None, "a b c d", None, None, None, None, None, None, None, None, None))
    out.append((None, "no id", None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(out, DOCS).repartition(4)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
