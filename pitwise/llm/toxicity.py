"""Toxicity by maximum-scoring segments.

Words and word stems get the log-odds of toxic against clean text with an
informative Dirichlet prior (the counts of both together); those that stand out
score their log-odds, every other word a small negative number.  A linear-time
scan finds all maximal segments of a text (Ruzzo and Tompa).  By the extreme
value theory of such segments, a segment of score S in a text of n words is met
by chance K n exp(-lambda S) times; a text's evidence is the sum of -ln of that
over its significant segments, and a logistic curve turns it into a score.

The model is learnt on a bounded sample of the labelled rows (``SAMPLE`` of each
class, by a hash of the key); scoring covers every word of every text.  Labels
are joined to texts only for that sample, which is written once.  All its rows are
learnt from: copies weigh as one text together, and a passage that many different
texts share takes no weight from them unless it is most of a text.

Defined cases: null and empty texts have no words and score as texts without
evidence; rows whose label is null are not learnt from, and a key that is
labelled both ways counts as toxic; without toxic (or clean) rows to learn from
every text has the same low score.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import cut, fresh, written
from pitwise.llm.words import Words, blocks, mix, split_words, word_hashes

#: Labelled rows of each class that the model is learnt from, at most.
SAMPLE = 20_000
STEMS = (4, 5, 6)                # bytes
PRIOR = 0.1                      # weight of the prior, as a share of the counts
SIGNATURES = 16                  # least hashes of runs of RUN words, by which copies in the sample are found
AGREE = 12                       # of them must be shared by copies
UNIT = 1 << 20                   # weights of rows are whole numbers of this part, so sums do not depend on their order
RUN = 5
STANDS_OUT = 3.5                 # standard errors of the log-odds
BLOCK = 2 << 20                  # text bytes worked on at once (each word has four features and their sort)
DRIFT = 0.1                      # score of other words, negated
THRESHOLD = 0.7


class Model(NamedTuple):
    features: np.ndarray         # sorted uint64
    odds: np.ndarray             # log-odds of each
    rate: float                  # lambda
    chance: float                # K
    weight: float                # of the logistic curve
    bias: float


# --- words and features ---

def letters(texts: pa.Array) -> Words:
    """Words of a text: runs of letters, digits and non-ASCII bytes, with A-Z as a-z."""
    keep = np.zeros(256, bool)
    keep[128:] = True
    for a, b in ("09", "az", "AZ"):
        keep[ord(a):ord(b) + 1] = True
    return split_words(texts, keep, lower=True)


def features(w: Words) -> np.ndarray:
    """Hashes of each word and of its stems (0 where the word is no longer than the stem), one row each."""
    length = w.ends - w.starts
    out = [word_hashes(w)]
    for k in STEMS:
        stem = mix(word_hashes(w._replace(ends=np.minimum(w.ends, w.starts + k))) + np.uint64(k))
        out.append(np.where(length > k, stem, np.uint64(0)))
    return np.stack(out)


def word_scores(model: Model, w: Words) -> np.ndarray:
    """Score of each word: that of its highest feature in the model, or minus the drift."""
    best = np.full(len(w.starts), -DRIFT)
    if len(model.features):
        for row in features(w):
            at = np.minimum(np.searchsorted(model.features, row), len(model.features) - 1)
            best = np.where(model.features[at] == row, np.maximum(best, model.odds[at]), best)
    return best


# --- segments ---

def maximal_segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a text whose words at ``places`` have positive ``scores`` and
    whose other words score ``-drift``; one pass over the places."""
    found: list[tuple[int, int, float, float, int]] = []     # first, last, sum before, sum after, the one before with a smaller sum before
    total, end = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total -= (place - end - 1) * drift
        left, total, end = total, total + score, place
        first = place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, place, left, total, j))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def _text_segments(model: Model, w: Words) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(text, its words, its segments) for each text of a block."""
    scores = word_scores(model, w)
    hits = np.flatnonzero(scores > 0)
    cuts, first = np.searchsorted(hits, w.first), w.first
    for k in range(len(first) - 1):
        mine = hits[cuts[k]:cuts[k + 1]]
        segments = maximal_segments((mine - first[k]).tolist(), scores[mine].tolist(), DRIFT) if len(mine) else []
        yield k, int(first[k + 1] - first[k]), segments


def surprise(model: Model, words: int, score: float) -> float:
    """-ln of how often a segment of this score is met by chance in a text of so many words (0 if once or more)."""
    return max(model.rate * score - np.log(max(model.chance * words, 1e-9)), 0.0)


def evidence(model: Model, words: int, segments: list[tuple[int, int, float]]) -> float:
    return float(sum(surprise(model, words, s) for _, _, s in segments))


# --- learning ---

def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, sample: int) -> DataFrame:
    """(y, weight, text): texts of at most ``sample`` labelled rows of each class that are not held out.

    A row's weight is UNIT / n, n being the rows of its class that share at least AGREE of its SIGNATURES least hashes
    with it, place by place (as near copies nearly surely do): the AGREE-th largest of its places' groups.
    """
    known = (labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
             .groupBy(key).agg(F.max("toxic").alias("y")))
    order = [F.xxhash64(key), F.col(key)]
    some = known.where("y = 1").orderBy(*order).limit(sample).unionByName(known.where("y = 0").orderBy(*order).limit(sample))
    some = cut(some.withColumnRenamed(key, "labelled"))          # at most 2 * sample narrow rows
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(
        F.broadcast(some), F.col("k") == F.col("labelled")).select("k", F.xxhash64("text").alias("h"), F.col("y").cast("int").alias("y"), "text")
    rows = written(rows, "toxicity-sample")
    kind = docs.schema[key].dataType.simpleString()
    marks = cut(rows.mapInArrow(_signatures, f"k {kind}, h long, y int, place int, mark long"))
    sizes = marks.groupBy("y", "place", "mark").agg(F.count(F.lit(1)).alias("n"))
    # rows of one key and text are one row here, as often as they are repeated
    group = marks.join(sizes, ["y", "place", "mark"]).groupBy("k", "h").agg(F.sort_array(F.collect_list("n"), False).alias("n"))
    weights = group.select(F.col("k").alias("k2"), F.col("h").alias("h2"),
                           F.element_at("n", F.ceil(F.size("n") * F.lit(AGREE / SIGNATURES)).cast("int")).alias("n"))
    told = rows.join(weights, (F.col("k") == F.col("k2")) & F.col("h").eqNullSafe(F.col("h2")), "left")
    weight = F.greatest(F.round(F.lit(float(UNIT)) / F.coalesce("n", F.lit(1))), F.lit(1)).cast("long")
    return cut(told.select("y", weight.alias("weight"), "text"))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few least hashes of each text's runs of RUN words; none for shorter texts."""
    for batch in blocks(batches, "text", BLOCK):
        w = letters(batch.column("text"))
        h = word_hashes(w)
        counts = np.diff(w.first)
        some = np.flatnonzero(counts >= RUN)
        if not len(some):
            continue
        runs = h[: len(h) - RUN + 1]
        for k in range(1, RUN):
            runs = mix(runs * np.uint64(3) + h[k:len(h) - RUN + 1 + k])
        doc = np.repeat(np.arange(batch.num_rows), counts)
        own = doc[: len(runs)] == doc[RUN - 1:]                  # runs within one text
        runs, at = runs[own], np.searchsorted(doc[: len(own)][own], some)
        for place in range(SIGNATURES):
            least = np.minimum.reduceat(mix(runs + np.uint64(place)), at)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(some)) for c in ("k", "h", "y")],
                                              pa.array(np.full(len(some), place), pa.int32()), pa.array(least.view(np.int64))],
                                             names=["k", "h", "y", "place", "mark"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weight of toxic and clean texts in which each feature occurs (once a text: words recur within a text)."""
    for batch in blocks(batches, "text", BLOCK):
        w = letters(batch.column("text"))
        doc = np.repeat(np.arange(batch.num_rows), np.diff(w.first))
        toxic, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "weight"))
        both, owner = features(w).ravel(), np.tile(doc, 1 + len(STEMS))
        order = np.lexsort((owner, both))
        both, owner = both[order], owner[order]
        new = (both != 0) & np.append(True, (both[1:] != both[:-1]) | (owner[1:] != owner[:-1]))[: len(both)]
        both, owner = both[new], owner[new]
        if len(both):
            at = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
            bad = np.add.reduceat((toxic * weight)[owner], at)
            total = np.add.reduceat(weight[owner], at)
            yield pa.RecordBatch.from_arrays([pa.array(both[at].view(np.int64)), pa.array(bad), pa.array(total - bad)],
                                             names=["feature", "toxic", "clean"])


def log_odds(counts: DataFrame, toxic_words: int, clean_words: int) -> DataFrame:
    """(feature, odds, z) from (feature, toxic, clean): log-odds with a Dirichlet prior of PRIOR times the counts of both."""
    prior, whole = (F.col("toxic") + F.col("clean")) * PRIOR, (toxic_words + clean_words) * PRIOR
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    na, nb = F.lit(toxic_words + whole), F.lit(clean_words + whole)
    odds = F.log(a / (na - a)) - F.log(b / (nb - b))
    return counts.select("feature", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))


def _rate(values: np.ndarray, share: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda * score)] = 1 for words of clean text."""
    low, high = 0.0, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if np.sum(share * np.exp(np.minimum(mid * values, 500))) > 1:
            high = mid
        else:
            low = mid
    return max(low, 1e-6)


def _logistic(x: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[float, float]:
    """weight (not negative) and bias of a logistic curve of rows that weigh ``of``, by Newton's method, slightly ridged."""
    w = np.zeros(2)
    data = np.stack((x, np.ones(len(x))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        grad = data.T @ (of * (y - p)) - 1e-3 * w
        hess = (data * (of * p * (1 - p))[:, None]).T @ data + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _clean_segments(model: Model):
    """Words and segments of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            found = [(n, len(segs)) for _, n, segs in _text_segments(model, letters(batch.column("text")))]
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            words, segments = (np.array(x, np.int64) * weight for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([words.sum()]), pa.array([segments.sum()])], names=["words", "segments"])

    return run


def _evidence(model: Model):
    """Label, weight and evidence of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            x = [float(np.log1p(evidence(model, n, segs))) for _, n, segs in _text_segments(model, letters(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("weight"), pa.array(x, pa.float64())], names=["y", "weight", "x"])

    return run


def _positive_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK):
            w = letters(batch.column("text"))
            weight = np.repeat(batch.column("weight").to_numpy(zero_copy_only=False), np.diff(w.first))
            values, place = np.unique(word_scores(model, w), return_inverse=True)
            counts = np.zeros(len(values), np.int64)
            np.add.at(counts, place, weight)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], names=["score", "n"])

    return run


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """The model of the labelled rows that are not held out. What reaches the driver are the words that stand out in the
    sample, and three numbers for each of its rows."""
    none = np.zeros(0)
    rows = training_rows(docs, labels, key, text, sample)
    counts = cut(rows.mapInArrow(_feature_counts, "feature long, toxic long, clean long")
                 .groupBy("feature").agg((F.sum("toxic") / UNIT).alias("toxic"), (F.sum("clean") / UNIT).alias("clean")))
    empty = Model(none.astype(np.uint64), none, 1.0, 1.0, 0.0, -5.0)
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not totals[0] or not totals[1]:
        return empty
    top = log_odds(counts, totals[0], totals[1]).where(F.col("z") >= STANDS_OUT).toPandas()
    values = top["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    model = empty._replace(features=values[order], odds=top["odds"].to_numpy(float)[order])
    clean = (rows.where("y = 0").mapInArrow(_positive_scores(model), "score double, n long")
             .groupBy("score").agg((F.sum("n") / UNIT).alias("n")).orderBy("score").toPandas())          # at most one row per feature
    # one more word of the highest score, for clean text may hold it though the sample does not
    scores = np.append(clean["score"].to_numpy(float), model.odds.max() if len(model.odds) else 1.0)
    share = np.append(clean["n"].to_numpy(float), 1.0)
    model = model._replace(rate=_rate(scores, share / share.sum()))
    words, segments = (rows.where("y = 0").mapInArrow(_clean_segments(model), "words long, segments long")
                       .agg(F.sum("words") / UNIT, F.sum("segments") / UNIT).first())
    model = model._replace(chance=float(min((1 + (segments or 0)) / (1 + (words or 0)), 1.0)))
    seen = rows.mapInArrow(_evidence(model), "y int, weight long, x double").toPandas().sort_values(["y", "x", "weight"])
    weight, bias = _logistic(seen["x"].to_numpy(float), seen["y"].to_numpy(float), seen["weight"].to_numpy(float) / UNIT)
    return model._replace(weight=weight, bias=bias)


# --- scoring ---

def _score(model: Model, into: str, body: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, body, BLOCK):
            w = letters(batch.column(body))
            found = [evidence(model, n, segs) for _, n, segs in _text_segments(model, w)]
            x = model.weight * np.log1p(np.array(found)) + model.bias
            kept = [c for c in batch.schema.names if c != body]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))],
                                             names=[*kept, into])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All columns and rows of ``docs`` with the toxicity score (0 to 1) of the whole text in ``into``; no shuffle.

    An input column named like ``into`` is left out.
    """
    body, = fresh(docs.columns, "body")
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    rows = docs.select(*kept, F.col(text).alias(body))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    return rows.mapInArrow(_score(model, into, body), ", ".join([*fields, f"`{into}` double"]))


def _passages(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body", BLOCK):
            w = letters(batch.column("body"))
            data = w.buf.tobytes()
            rows = []
            for k, n, segs in _text_segments(model, w):
                for a, b, s in segs:
                    if (e := surprise(model, n, s)) > 0:
                        i, j = int(w.starts[w.first[k] + a]), int(w.ends[w.first[k] + b])
                        rows.append((k, a, b, s, e, data[i:j].decode("utf-8", "replace")))
            if rows:
                at, first, last, total, e, words = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                                                  pa.array(total, pa.float64()), pa.array(e, pa.float64()), pa.array(words, pa.string())],
                                                 names=["key", "first_word", "last_word", "segment_score", "surprise", "passage"])

    return run


def passages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every significant toxic passage: key, first_word, last_word, segment_score, surprise, passage (lower case)."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(
        _passages(model), f"key {kind}, first_word long, last_word long, segment_score double, surprise double, passage string"
    ).withColumnRenamed("key", key)


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    into, = fresh(docs.columns, "score")
    return score(docs, model, text, into).where(F.col(into) < threshold).select(*docs.columns)
