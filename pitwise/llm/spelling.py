"""Spelling variants by permuterm rotations.

Two words are near if they differ by one inserted, deleted or replaced code
point.  Each word, marked with a terminator, is rotated to begin after each of
its code points: ``x a y`` gives ``y $ x a``.  Sorted rotations that agree in
``y $ x`` are words that differ in ``a`` alone, and the word ``x y`` is the one
whose whole rotation is that prefix.  So each word gives the rotation without its
last code point, once for each code point (an edited place), and its whole
rotations (a deleted place); rows sorted by these strings form groups, and a
scan of a group finds for each of its words the number of near words and the one
of largest count.  A group holds at most one word per letter and one more (91
with the letters here), so it needs no pairs and cannot be hot.

An insertion into a run of equal letters is found at each place of the run; it is
counted at the run's first place only.

Rotations of very long words would take the square of their length, so a rotation
of more than ``LONG`` code points is replaced by two polynomial hashes modulo
2^61 - 1 (found from the hashes of the two parts); two different rotations agree
in both with a probability below 1e-24.

Defined cases: null and empty texts have no words; a null key is the empty string
in the hash; repeated rows count again; an empty table gives no words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.storage import cut
from pitwise.llm.words import blocks, text_buffer

EVERY = 97
LEAST_POINTS = 5
LEAST_COUNT = 3
LONG = 64
END = "$"
_MOD = (1 << 61) - 1
_BASES = (0x1F3D5B79A1C2E4F, 0x0B5E2A9D7C6F183)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and the byte after of each run of A-Z, a-z and the code points of lead byte 0xC3 (U+00C0 to U+00FF)."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    low = raw | 0x20
    inside[:n] = ((low >= 97) & (low <= 122)) | (raw == 0xC3)
    inside[1:n] |= raw[: max(n - 1, 0)] == 0xC3
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: max(n - 1, 0)]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begin[edges] |= inside[edges]
    finish = inside[:n] & ~inside[1:]
    finish[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of bytes starts:ends after ``state`` (the crc32 of what comes before them)."""
    crc = ~state.astype(np.uint32)
    at = np.flatnonzero(ends - starts <= LONG)
    place = starts[at]
    while len(at := at[more := place < ends[at]]):
        place = place[more]
        crc[at] = _CRC[(crc[at] ^ buf[place]) & 0xFF] ^ (crc[at] >> np.uint32(8))
        place = place + 1
    out = ~crc
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = zlib.crc32(buf[starts[i]:ends[i]].tobytes(), int(state[i]))
    return out


def _block_words(texts: pa.Array, keys: list[str], every: int, least: int) -> pa.StructArray:
    """(values, counts) of the words of the texts, after deletions, of at least ``least`` code points."""
    raw, offsets = text_buffer(texts)
    buf = np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw).astype(np.uint8)
    starts, ends = _runs(raw, offsets)
    follows = np.concatenate(([0], np.cumsum((buf & 0xC0) == 0x80)))
    points = ends - starts - (follows[ends] - follows[starts])
    keep = points >= least                                  # a deletion only shortens
    starts, ends, points = starts[keep], ends[keep], points[keep]
    owner = np.searchsorted(offsets, starts, "right") - 1
    state = np.fromiter((zlib.crc32(f"{k}:".encode()) for k in keys), np.uint32, len(keys))
    h = _crc32(buf, starts, ends, state[owner])
    hit = h % np.uint32(every) == 0
    whole = np.flatnonzero(~hit)
    sizes = (ends - starts)[whole]
    at = np.concatenate(([0], np.cumsum(sizes)))
    data = buf[np.repeat(starts[whole] - at[:-1], sizes) + np.arange(int(at[-1]))]
    words = pa.LargeStringArray.from_buffers(len(whole), pa.py_buffer(at), pa.py_buffer(data))
    changed = []
    for i in np.flatnonzero(hit & (points > least)).tolist():
        word = buf[starts[i]:ends[i]].tobytes().decode()
        gone = int(h[i]) % len(word)
        changed.append(word[:gone] + word[gone + 1:])
    return pc.value_counts(pa.chunked_array([words, pa.array(changed, pa.large_string())]))


def vocabulary(docs: DataFrame, every: int = EVERY, least_points: int = LEAST_POINTS, least_count: int = LEAST_COUNT,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): distinct lower-cased runs of at least ``least_points`` code points and ``least_count`` occurrences.

    Of each run whose crc32 (with its text's key) ``every`` divides, one code point is deleted first.  A block's words
    are counted before they leave the task, and combined again before the shuffle.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "body"):
            found = _block_words(batch.column("body"), batch.column("key").to_pylist(), every, least_points)
            step = 1 << 16
            for a in range(0, len(found), step):
                part = found.slice(a, step)
                yield pa.RecordBatch.from_arrays([part.field(0).cast(pa.string()), part.field(1)], names=["word", "n"])

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of :func:`rotations` for long words, with hashes in place of rotations."""
    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            codes = [ord(c) for c in word]
            size = len(codes)
            names = [[], []]                                # of whole rotations, and of those without an edited point
            for base in _BASES:
                heads, powers = [0], [1]
                for c in codes:
                    heads.append((heads[-1] * base + c) % _MOD)
                    powers.append(powers[-1] * base % _MOD)
                tail = [heads[size] - heads[i] * powers[size - i] for i in range(size + 1)]
                names[0].append([((tail[i] * base + ord(END)) * powers[i] + heads[i]) % _MOD for i in range(size + 1)])
                names[1].append([((tail[i + 1] * base + ord(END)) * powers[i] + heads[i]) % _MOD for i in range(size)])
            first = [True] + [a != b for a, b in zip(codes, codes[1:], strict=False)]
            for edited, (one, two), length in ((False, names[0], size + 1), (True, names[1], size)):
                if length <= LONG:
                    continue
                for a in range(0, len(one), 1 << 12):
                    keys = [f"{length}:{x}:{y}" for x, y in zip(one[a:a + (1 << 12)], two[a:a + (1 << 12)], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.string()), pa.array([word] * len(keys), pa.string()), pa.array([n] * len(keys), pa.int64()),
                         pa.array([edited] * len(keys)), pa.array(first[a:a + (1 << 12)] if edited else [False] * len(keys))],
                        names=["rotation", "word", "n", "edited", "leads"])


def rotations(words: DataFrame) -> DataFrame:
    """(rotation, word, n, edited, leads) of each word: whole rotations, and rotations without their last code point
    (``edited``; ``leads`` if that is the first of its run of equal letters)."""
    size = F.char_length("word")
    short = words.where(size <= LONG).select("word", "n", size.alias("size"))
    places = short.select("*", F.explode(F.sequence(F.lit(0), F.col("size"))).alias("i"))
    head = F.substring(F.col("word"), F.lit(1), F.col("i"))
    tail = F.substr(F.col("word"), F.col("i") + 1)
    whole = places.select(F.concat(tail, F.lit(END), head).alias("rotation"), "word", "n", F.lit(False).alias("edited"),
                          F.lit(False).alias("leads"))
    rest = F.substr(F.col("word"), F.col("i") + 2)
    this = F.substr(F.col("word"), F.col("i") + 1, F.lit(1))
    before = F.substr(F.col("word"), F.col("i"), F.lit(1))
    edited = places.where("i < size").select(F.concat(rest, F.lit(END), head).alias("rotation"), "word", "n", F.lit(True).alias("edited"),
                                             ((F.col("i") == 0) | (this != before)).alias("leads"))
    # a word of LONG code points has whole rotations of one more, which long words meet under hashes
    literal = F.char_length("rotation") <= LONG
    long = words.where(size >= LONG).mapInArrow(_long_rotations, "rotation string, word string, n long, edited boolean, leads boolean")
    return whole.where(literal).unionByName(edited.where(literal)).unionByName(long)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near_n, near_word, n_near) of each word of ``words`` (word, n) with near ones: their number, and the one of
    largest n (ties: the smallest).

    One shuffle by rotation and one sort; each row looks at the first two of its group.
    """
    group = Window.partitionBy("rotation").orderBy(F.col("n").desc(), "word")
    whole = Window.partitionBy("rotation")
    best = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rotations(words).select(
        "word", "edited", "leads", F.row_number().over(group).alias("place"), F.count(F.lit(1)).over(whole).alias("members"),
        F.first(F.struct("n", "word")).over(best).alias("top"), F.lead(F.struct("n", "word")).over(group).alias("next"),
        F.count_if("edited").over(whole).alias("n_edited"), F.count_if("leads").over(whole).alias("n_leads"),
        F.count_if(~F.col("edited")).over(whole).alias("n_whole"))
    other = F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("top"))
    # an edited row is near the other edited ones, and the whole one if it leads
    near = F.when(F.col("edited"), F.col("n_edited") - 1 + F.when(F.col("leads"), F.col("n_whole")).otherwise(F.lit(0))).otherwise(F.col("n_leads"))
    met = rows.where("members > 1").select("word", other.alias("near"), near.alias("c"))
    found = met.groupBy("word").agg(F.min(F.struct((-F.col("near.n")).alias("n"), F.col("near.word").alias("word"))).alias("near"),
                                    F.sum("c").cast("long").alias("n_near"))
    return found.select("word", (-F.col("near.n")).alias("near_n"), F.col("near.word").alias("near_word"), "n_near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: each round goes twice as far. A form's n is at least twice its word's, so
    no chain is longer than 62 and six rounds reach every last form."""
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(6):
        now = cut(now)
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = now.join(onward, "root")
        if moved.isEmpty():
            break
        now = now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return now


def spelling_groups(docs: DataFrame, ratio: int = 2, **options: object) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of :func:`vocabulary`.

    form: the near word of largest n, if that is at least ``ratio`` times the word's; root: the last of the forms that
    follow each other, or the word itself.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2: forms would not lead to an end")
    words = cut(vocabulary(docs, **options))
    near = words.join(near_words(words), "word", "left")
    has = F.col("near_n") >= ratio * F.col("n")
    told = cut(near.select("word", F.when(has, F.col("near_word")).alias("form"), "n",
                           F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
