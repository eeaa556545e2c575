"""Substring dedup by seed and extend on winnowed anchors.

A window is ``size`` consecutive words of one text; each window's anchor is the
rightmost smallest hash of its runs of ``GRAM`` words, so equal windows have
equal anchors wherever they are.  Consecutive windows with one anchor are the
extent to which that anchor is extended both ways (a unit).  Documents meet on
anchors:

1. An anchor that occurs once has no repeated window.  An anchor whose units are
   all the same text extends both ways everywhere: all its windows repeat.
2. Anchors that occur in different units (at the ends of a repeat) are extended
   window by window: their windows are counted by content.
3. Every text marks the words of its repeated windows; neighbouring and
   overlapping ones merge into maximal repeats.

Anchors and windows are combined before each shuffle, so a passage that a third
of all texts hold is one row per task; pairs of documents are never formed.
Lists return to texts by a row hash; a collision there is harmless, for a text
looks only for its own anchors and windows in a list.  Equality of windows is by
128 bits (anchor and window hash).

Defined cases: a null text has no words; texts of fewer than ``size`` words have
no windows; repeated rows count as separate places.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import fresh, small, written
from pitwise.llm.words import Words, blocks, mix, split_words, word_hashes

SIZE = 35
GRAM = 8
_BASE = 0xD6E8FEB86659FD93
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash (mod 2^64) of each ``n`` consecutive word hashes, by doubling."""
    out, have = None, 0
    power, width = h, 1                  # hashes of ``width`` words
    while True:
        if n & width:
            if out is None:
                out, have = power, width
            else:                        # ``width`` words, then the ``have`` words found before
                head = power[: max(len(h) - width - have + 1, 0)]
                out = head * np.uint64(pow(_BASE, have, 1 << 64)) + out[width:width + len(head)]
                have += width
        if width * 2 > n:
            return out
        half = power[: max(len(h) - 2 * width + 1, 0)]
        power = half * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:width + len(half)]
        width *= 2


def rightmost_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost smallest value among each ``w`` consecutive ones."""
    pos, cover = np.arange(len(v)), 1
    while cover < w:
        shift = min(cover, w - cover)
        n = max(len(v) - shift, 0)
        right = v[shift:] <= v[:n]
        v, pos = np.where(right, v[shift:], v[:n]), np.where(right, pos[shift:], pos[:n])
        cover += shift
    return pos


class Windows(NamedTuple):
    """All windows of a block of texts, in order."""

    words: Words
    doc: np.ndarray      # text of each window
    start: np.ndarray    # first word of each window (index in the block)
    hash: np.ndarray     # content of each window
    anchor: np.ndarray   # hash of each window's anchor
    unit: np.ndarray     # index of the first window of each unit


def windows(texts: pa.Array, size: int) -> Windows:
    words = split_words(texts)
    none = np.zeros(0, np.uint64)
    counts = np.diff(words.first)
    if not (counts >= size).any():
        empty = np.zeros(0, np.int64)
        return Windows(words, empty, empty, none, none, empty)
    h = word_hashes(words)
    gram = min(GRAM, size)
    full = run_hashes(h, size)
    grams = mix(run_hashes(h, gram))
    at = rightmost_minimum(grams, size - gram + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.flatnonzero(doc[: len(full)] == doc[size - 1:])
    at = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[start[1:]] != doc[start[:-1]])
    return Windows(words, doc[start], start, full[start], grams[at], np.flatnonzero(new))


def units(w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, anchor, and content of each unit; its first and last window cover all its words."""
    last = np.append(w.unit[1:], len(w.start))[: len(w.unit)] - 1
    count = (last - w.unit).astype(np.uint64)
    content = mix(w.hash[w.unit] * _UNIT ^ mix(w.hash[last] + count))
    return w.doc[w.unit], w.anchor[w.unit], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _unit_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body"):
            doc, anchor, content = units(windows(batch.column("body"), size))
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(doc)), _signed(anchor), _signed(content)],
                                             names=["rk", "anchor", "unit"])

    return run


def _members(lists: pa.Array, doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value (of text ``doc``) is in its text's list; ``doc`` ascends."""
    found = np.zeros(len(values), bool)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
    ends = np.cumsum(sizes)
    bounds = np.searchsorted(doc, np.arange(len(sizes) + 1))
    for k in np.flatnonzero(sizes).tolist():
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            found[a:b] = np.isin(values[a:b], flat[ends[k] - sizes[k]:ends[k]])
    return found


def _window_rows(size: int):
    """Windows with an anchor in the text's list ``mixed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body"):
            w = windows(batch.column("body"), size)
            at = np.flatnonzero(_members(batch.column("mixed"), w.doc, w.anchor))
            yield pa.RecordBatch.from_arrays([batch.column("rk").take(pa.array(w.doc[at])), _signed(w.anchor[at]),
                                              _signed(w.hash[at])], names=["rk", "anchor", "wh"])

    return run


def repeated_lists(rows: DataFrame, size: int) -> DataFrame:
    """(rk, pure, again): for texts with repeats, their anchors all of whose windows repeat, and other repeated windows.

    ``rows`` has rk (row hash) and body (text).
    """
    found = rows.mapInArrow(_unit_rows(size), "rk long, anchor long, unit long")
    shared = (found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("unit").alias("a"), F.max("unit").alias("b"))
              .where("n > 1").select("anchor", (F.col("a") == F.col("b")).alias("same")))
    # written apart, the counts leave the other side of the join free to be split at hot anchors
    shared = written(shared, "seeds")
    mine = (found.select("rk", "anchor").join(shared, "anchor").groupBy("rk")
            .agg(F.collect_set(F.when(F.col("same"), F.col("anchor"))).alias("pure"),
                 F.collect_set(F.when(~F.col("same"), F.col("anchor"))).alias("mixed")))
    mine = written(mine, "anchors")
    some = mine.where(F.size("mixed") > 0).select("rk", "mixed")
    ends = (_only(rows, some).join(some, "rk").select("rk", "body", "mixed")
            .mapInArrow(_window_rows(size), "rk long, anchor long, wh long"))
    twice = ends.groupBy("anchor", "wh").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    twice = written(twice, "windows")
    again = ends.join(twice, ["anchor", "wh"]).groupBy("rk").agg(F.collect_set("wh").alias("again"))
    out = mine.select("rk", "pure").join(again, "rk", "left").where((F.size("pure") > 0) | F.col("again").isNotNull())
    return written(out, "repeats")


def _only(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The rows whose rk is in ``lists``, filtered before any shuffle if the keys are few enough to broadcast."""
    keys = lists.select("rk")
    n = keys.count()
    marked = small(keys, n, 1 << 20)
    return rows.join(marked, "rk", "left_semi") if marked is not keys else rows


def _covered(w: Windows, batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Whether each word of the block is in a repeated window."""
    hit = _members(batch.column("pure"), w.doc, w.anchor) | _members(batch.column("again"), w.doc, w.hash)
    edge = np.zeros(len(w.words.starts) + 1, np.int64)
    np.add.at(edge, w.start[hit], 1)
    np.add.at(edge, w.start[hit] + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _removed(size: int, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body"):
            w = windows(batch.column("body"), size)
            gone = _covered(w, batch, size)
            data, ends, first = w.words.buf.tobytes(), w.words.offsets.tolist(), w.words.first.tolist()
            texts, removed = [], []
            for k in range(batch.num_rows):
                mine = gone[first[k]:first[k + 1]]
                texts.append(b" ".join(compress(data[ends[k]:ends[k + 1]].split(), (~mine).tolist())))
                removed.append(int(mine.sum()))
            out = [batch.column(c) for c in kept] + [
                pa.array(texts, pa.binary()).cast(pa.string()), pa.array(np.diff(w.words.first)), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "kept", "n_words", "n_removed"])

    return run


def _spans(size: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body"):
            w = windows(batch.column("body"), size)
            gone = _covered(w, batch, size)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(w.words.first))
            new = gone & ~np.append(False, gone[:-1] & (doc[1:] == doc[:-1]))
            at = np.flatnonzero(new)
            sizes = np.add.reduceat(gone.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(doc[at])), pa.array(at - w.words.first[doc[at]]),
                                              pa.array(sizes)], names=[key, "first_word", "n_words"])

    return run


def _with_lists(docs: DataFrame, key: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """docs with rk and body, and the lists of repeats."""
    rows = docs.withColumns({"rk": F.xxhash64(key, text), "body": F.col(text)})
    return rows, repeated_lists(rows.select("rk", "body"), size)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """All rows of ``docs`` with kept (the words left, joined by one space), n_words and n_removed.

    Input columns named rk, body, pure, again, kept, n_words or n_removed are left out.
    """
    kept = [c for c in docs.columns if c.lower() not in ("rk", "body", "pure", "again", "kept", "n_words", "n_removed")]
    rows, lists = _with_lists(docs.select(*kept), key, text, size)
    told = _joined(rows, lists)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    return told.mapInArrow(_removed(size, kept), ", ".join([*fields, "kept string, n_words long, n_removed long"]))


def _joined(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows with their lists (null: none); if the listed keys are few, only the listed rows are shuffled."""
    n = lists.count()
    keys = lists.select("rk")
    marked = small(keys, n, 1 << 20)
    if marked is keys:
        return rows.join(lists, "rk", "left")
    none = F.lit(None).cast("array<long>")
    clean = rows.join(marked, "rk", "left_anti").withColumns({"pure": none, "again": none})
    return rows.join(marked, "rk", "left_semi").join(lists, "rk").unionByName(clean)


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(key, first_word, n_words): each maximal run of words covered by repeated windows; all are of ``size`` words at least."""
    own, = fresh(["rk", "body", "pure", "again"], key)
    rows, lists = _with_lists(docs.select(F.col(key).alias(own), F.col(text).alias("text_")), own, "text_", size)
    kind = docs.schema[key].dataType.simpleString()
    listed = _only(rows, lists).join(lists, "rk").drop("text_")
    return listed.mapInArrow(_spans(size, own), f"`{own}` {kind}, first_word long, n_words long").withColumnRenamed(own, key)
