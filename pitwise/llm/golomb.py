"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every task sends the sorted distinct fingerprints of its rows, Golomb-coded, to
the owners of their ranges (about 45 bits a fingerprint); owners return a bit
for each one that occurs more than once anywhere; only texts with such a
fingerprint are suspects, and only they are shuffled, whole, for the comparison
of bytes.  Equal texts are combined before that shuffle, so a text that a third
of all rows share is sent once per task.

Texts are equal if they are the same after deleting ``[\\x20\\x09-\\x0D]``; a
null text is empty.  Of equal texts the row with the most code points stays,
then the smallest key, a null key last; of rows that tie even in that, one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import cut, fresh, repeat_rows, small

SPACE = " \t\n\x0b\x0c\r"
#: Fingerprints a task gathers before it sends them.
SEND = 1 << 20
#: Fingerprints meant for one owner.
OWNED = 1 << 21
#: Most distinct suspect fingerprints (8 bytes each) or groups that are broadcast.
MOST = 1 << 20


# --- Golomb (Rice) code of sorted distinct integers ---

def golomb_encode(values: np.ndarray, rice: int) -> bytes:
    """Sorted distinct uint64 ``values`` as gaps: all quotients gap >> rice in unary, then all remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = np.empty((len(gaps), rice), np.uint8)
    for bit in range(rice):
        rest[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def golomb_decode(data: bytes, count: int, rice: int) -> np.ndarray:
    """The ``count`` values that golomb_encode() was given."""
    tail = (count * rice + 7) // 8
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(rice)
    rest = np.unpackbits(raw[len(raw) - tail:], count=count * rice).reshape(count, rice)
    for bit in range(rice):
        gaps |= rest[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64)


def rice_parameter(width: int, count: int) -> int:
    """Remainder bits for ``count`` values spread over 2^width."""
    return max(width - max(count, 1).bit_length(), 0)


SENT = "part long, owner int, base long, n int, rice int, payload binary, twice binary"


def _sender(width: int):
    """Rows of one task as coded fingerprint lists, one for each owner; an owner has the range of the top bits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, times = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            owners = (values >> np.uint64(width)).astype(np.int64) if width < 64 else np.zeros(len(values), np.int64)
            cuts = np.flatnonzero(np.diff(owners, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(values)], strict=True):
                base = int(owners[a]) << width
                rice = rice_parameter(width, int(b - a))
                rows.append((task << 24 | times, int(owners[a]), base - (1 << 64) if base >> 63 else base, b - a, rice,
                             golomb_encode(values[a:b] - np.uint64(base), rice), np.packbits(counts[a:b] > 1).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                names=["part", "owner", "base", "n", "rice", "payload", "twice"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= SEND:
                yield flush()
                held, times = [], times + 1
        if held:
            yield flush()

    return send


def _values(row) -> np.ndarray:
    return golomb_decode(row.payload, row.n, row.rice) + np.uint64(int(row.base) % (1 << 64))


def _own(sent: pd.DataFrame) -> pd.DataFrame:
    """One owner's lists; a bitmap for each, of the fingerprints that occur more than once."""
    lists = [_values(r) for r in sent.itertuples()]
    twice = [np.unpackbits(np.frombuffer(r.twice, np.uint8), count=r.n).astype(bool) for r in sent.itertuples()]
    values, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    many = counts > 1
    many[back[np.concatenate(twice)]] = True
    marks = np.split(many[back], np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"part": sent["part"], "owner": sent["owner"],
                         "bitmap": [np.packbits(m).tobytes() for m in marks]})


def _suspects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's own lists with the returned bitmaps; the marked fingerprints."""
    for batch in batches:
        for r in batch.itertuples():
            marked = np.unpackbits(np.frombuffer(r.bitmap, np.uint8), count=r.n).astype(bool)
            yield pd.DataFrame({"fp": _values(r)[marked].view(np.int64)})


def duplicate_fingerprints(fps: DataFrame, owned: int = OWNED) -> DataFrame:
    """The distinct values of the one long column of ``fps`` that occur more than once (column fp)."""
    rows = fps.count()
    bits = max(4, (rows // owned).bit_length())
    sent = cut(fps.mapInArrow(_sender(64 - bits), SENT))
    answers = sent.groupBy("owner").applyInPandas(_own, "part long, owner int, bitmap binary")
    return sent.join(answers, ["part", "owner"]).mapInPandas(_suspects, "fp long").distinct()


# --- dedup ---

def normalised(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def _with_digests(docs: DataFrame, text: str, names: list[str]) -> DataFrame:
    """docs with normalised text, fingerprint, code points of the original text, and SHA-256."""
    norm, fp, points, sha = names
    return docs.withColumn(norm, normalised(text)).withColumns({
        fp: F.xxhash64(norm), points: F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long"),
        sha: F.sha2(F.col(norm).cast("binary"), 256)})


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text that occurs more than once: fp, text_sha256, group_size, keep_id, keep_points.

    The SHA-256 of the compared bytes names a group from here on.
    """
    norm, fp, points = fresh([key], "norm", "fp", "points")
    rows = docs.select(F.col(key), normalised(text).alias(norm),
                       F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias(points))
    rows = rows.withColumn(fp, F.xxhash64(norm))
    suspects = cut(duplicate_fingerprints(rows.select(fp)))
    suspects = small(suspects.withColumnRenamed("fp", fp), suspects.count(), MOST)
    equal = (rows.join(suspects, fp, "left_semi").groupBy(fp, norm, points)
             .agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("n")))
    narrow = equal.select(F.col(fp).alias("fp"), F.sha2(F.col(norm).cast("binary"), 256).alias("text_sha256"),
                          F.col(points).alias("keep_points"), "keep_id", "n")
    best = F.struct((-F.col("keep_points")).alias("a"), F.col("keep_id").isNull().alias("b"), F.col("keep_id").alias("c"))
    return (narrow.groupBy("fp", "text_sha256")
            .agg(F.sum("n").alias("group_size"), F.min(best).alias("best")).where("group_size > 1")
            .select("fp", "text_sha256", "group_size", F.col("best")["c"].alias("keep_id"),
                    (-F.col("best")["a"]).alias("keep_points")))


def _grouped(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """docs with digests and the columns of their group (a struct, null for single texts); the names added."""
    names = fresh(docs.columns, "norm", "fp", "points", "sha", "group")
    norm, fp, points, sha, group = names
    groups = cut(duplicate_groups(docs, key, text))
    told = groups.select(F.col("fp").alias(fp), F.col("text_sha256").alias(sha),
                         F.struct("group_size", "keep_id", "keep_points").alias(group))
    rows = _with_digests(docs, text, names[:4]).drop(norm)
    return rows.join(small(told, groups.count(), MOST // 4), [fp, sha], "left"), names


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256."""
    rows, (_, _, points, sha, group) = _grouped(docs, key, text)
    info = F.col(group)
    wins = info.isNull() | (F.col(key).eqNullSafe(info["keep_id"]) & (F.col(points) == info["keep_points"]))
    told = rows.select(F.col(key), F.when(info.isNull(), F.col(key)).otherwise(info["keep_id"]).alias("keep_id"),
                       F.coalesce(info["group_size"], F.lit(1).cast("long")).alias("group_size"),
                       wins.alias("wins"), F.col(sha).alias("text_sha256"))
    # rows that tie in everything are counted before the shuffle; the first of them stays
    ties = told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n"))
    return repeat_rows(ties, "n", "nth").select(
        key, "keep_id", "group_size", (F.col("wins") & (F.col("nth") == 0)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; single texts are not shuffled."""
    rows, (_, fp, points, sha, group) = _grouped(docs, key, text)
    info = F.col(group)
    single = rows.where(info.isNull()).select(*docs.columns)
    wins = rows.where(F.col(key).eqNullSafe(info["keep_id"]) & (F.col(points) == info["keep_points"]))
    row, = fresh(rows.columns, "row")
    first = wins.groupBy(fp, sha).agg(F.min(F.struct(*docs.columns)).alias(row))
    return single.unionByName(first.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
