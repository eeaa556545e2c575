"""SimHash near-dedup with pigeonring filtering.

A text's fingerprint has a bit for each bit that over half of its shingles'
hashes have.  Texts are linked if their fingerprints differ in at most two
bits.  The 64 bits are a ring of five segments.  If all differences together
are at most 2, then from some segment on, every chain of 1, 2, ... 5 consecutive
segments has at most floor(length * 2 / 5) of them: 0, 0, 0+1, 1, 2.  So two
consecutive segments are equal (the keys by which candidates meet), and longer
chains prune further before the full count.

Distinct fingerprints take part once.  Buckets that hold many of them are
split, exactly: of the bits not yet known to be equal, cut in three parts, one
part must be equal too.  Large groups return a spanning forest of their links,
never all pairs, so work and output stay bounded for groups of any size.

Defined cases: a null or empty text has fingerprint 0; a null key never is a
component's name unless all its keys are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.components import connected_components
from pitwise.llm.storage import cut, fresh, small
from pitwise.llm.words import blocks, text_buffer

SHINGLE = 3
DISTANCE = 2
SEED = 42
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))     # (lowest bit, width) around the ring
#: Distinct fingerprints that are compared in one place; larger buckets are split.
BUCKET = 2048
#: Groups up to this size return all their links, larger ones a spanning forest.
PAIRED = 32
_HASHES = 1 << 15


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of the whole text's word shingles; A-Z count as a-z."""
    words = text.lower().split()        # bytes: only ASCII letters and white space count
    if not words:
        return 0
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(joined)]))
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1:]
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _HASHES):
        part = zip(starts[at:at + _HASHES].tolist(), ends[at:at + _HASHES].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in part], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (total * 2 > len(starts)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(key, th, fp) for each row of ``docs``: th is a hash of the text, fp the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()
    own, th, body = fresh([], "key", "th", "body")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, body):
            raw, offsets = text_buffer(batch.column(body))
            data, ends = raw.tobytes(), offsets.tolist()
            fps = [fingerprint(data[a:b], width) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(own), batch.column(th),
                                              pa.array(np.array(fps, np.uint64).view(np.int64))], names=[own, th, "fp"])

    rows = docs.select(F.col(key).alias(own), F.xxhash64(text).alias(th), F.col(text).alias(body))
    return rows.mapInArrow(compute, f"{own} {kind}, {th} long, fp long")


def _mask(segments: list[tuple[int, int]]) -> int:
    return sum(((1 << w) - 1) << low for low, w in segments)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _split(mask: int) -> list[int]:
    """Masks that add to ``mask`` one third each of the bits it lacks."""
    bits = [b for b in range(64) if not mask >> b & 1]
    third = -(-len(bits) // 3)
    return [mask | sum(1 << b for b in bits[at:at + third]) for at in range(0, len(bits), third)]


def candidate_keys(fps: DataFrame, most: int = BUCKET) -> DataFrame:
    """(mask, shared, fp): distinct fingerprints fp under each key by which they meet; no key has over ``most`` of them
    unless all its bits but 11 are equal."""
    level = [_mask([SEGMENTS[i], SEGMENTS[(i + 1) % 5]]) for i in range(5)]
    rows = fps.withColumn("mask", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in level])))
    done = None
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")
        if all(64 - m.bit_count() <= 11 for m in level):
            break
        big = cut(rows.groupBy("mask", "shared").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n"))
        count = big.count()
        if not count:
            break
        finer = F.create_map(*[x for m in level for x in (
            F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(k)).cast("long") for k in _split(m)]))])
        big = small(big, count)
        rest = rows.join(big, ["mask", "shared"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        rows = rows.join(big, ["mask", "shared"], "left_semi").select(F.explode(finer[F.col("mask")]).alias("mask"), "fp")
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp").distinct()
        level = list(dict.fromkeys(k for m in level for k in _split(m)))
    return rows if done is None else done.unionByName(rows)


def _chain_filter(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs' differences fit the budgets of some chain around the ring, and then in full."""
    x = a ^ b
    diffs = [np.bitwise_count(x & np.uint64(_mask([s]))).astype(np.int8) for s in SEGMENTS]
    found = np.zeros(len(x), bool)
    for i in range(5):
        ok, run = np.ones(len(x), bool), np.zeros(len(x), np.int8)
        for length in range(1, 6):
            run = run + diffs[(i + length - 1) % 5]
            ok &= run <= length * DISTANCE // 5
        found |= ok
    return found


def _forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each fingerprint of the group to the first one of its linked class (rows of blocks at a time)."""
    label = np.arange(len(fps))
    for at in range(0, len(fps), 128):
        block = fps[at:at + 128, None]
        i, j = np.nonzero(np.bitwise_count(block ^ fps[None, :]) <= DISTANCE)
        i += at
        while True:                       # merge the classes that this block's links join
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, before[i], low)
            np.minimum.at(label, before[j], low)
            label = label[label]
            if (label == before).all():
                break
    while (label[label] != label).any():
        label = label[label]
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the groups of rows sorted by (mask, shared); a group may go on in the next batch."""

    def linked(mask: np.ndarray, shared: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (shared[1:] != shared[:-1]))))
        sizes = np.diff(np.append(starts, len(fps)))
        us, vs = [], []
        for at in np.flatnonzero(sizes > PAIRED):
            u, v = _forest(fps[starts[at]:starts[at] + sizes[at]])
            us.append(u)
            vs.append(v)
        group = np.repeat(np.arange(len(starts)), sizes)
        at = np.flatnonzero(sizes[group] <= PAIRED)
        step = 1
        while len(at := at[at + step < len(fps)]) and len(at := at[group[at] == group[at + step]]):
            near = at[_chain_filter(fps[at], fps[at + step])]
            us.append(fps[near])
            vs.append(fps[near + step])
            step += 1
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    held = None
    for batch in batches:
        now = [np.array(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("mask", "shared", "fp")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        other = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        stop = int(other[-1]) + 1 if len(other) else 0
        if stop:
            yield from linked(now[0][:stop], now[1][:stop], now[2][:stop].view(np.uint64))
        held = [x[stop:] for x in now]
    if held is not None and len(held[0]):
        yield from linked(held[0], held[1], held[2].view(np.uint64))


def _classes(docs: DataFrame, key: str, text: str, width: int, most: int) -> DataFrame:
    """(key, th, fp, root, component_id) for each row; root names the component by a fingerprint."""
    rows = cut(fingerprints(docs, key, text, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    keys = candidate_keys(distinct.select("fp"), most)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = keys.repartition(parts, "mask", "shared").sortWithinPartitions("mask", "shared", "fp")
    links = met.mapInArrow(_links, "u long, v long")
    classes = connected_components(links).withColumnRenamed("node", "fp")
    named = distinct.join(classes, "fp", "left").withColumn("root", F.coalesce("component", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    most: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: key, fp, component_id (the smallest key reachable by links, itself included)."""
    found = _classes(docs, key, text, width, most)
    return found.select(F.col("key").alias(key), F.col("fp").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
                most: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the one with the smallest key.

    A null key is last; of rows that share the key, the text with the smaller hash, then the least row.
    """
    found = cut(_classes(docs, key, text, width, most).groupBy("root", "key", "th").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("th").alias("th"))
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    told = found.join(best, "root").withColumn("wins", F.col("key").eqNullSafe(F.col("best")["key"]) &
                                               F.col("th").eqNullSafe(F.col("best")["th"]))
    own, th, row = fresh(docs.columns, "key", "th", "row")
    other = cut(told.where("not wins or n > 1").select(F.col("key").alias(own), F.col("th").alias(th), "wins").distinct())
    listed = small(other, other.count())
    rows = docs.withColumn(f"{th}_", F.xxhash64(text))
    same = F.col(key).eqNullSafe(F.col(own)) & F.col(f"{th}_").eqNullSafe(F.col(th))
    kept = rows.join(listed, same, "left_anti").select(*docs.columns)
    tied = rows.join(listed.where("wins"), same, "left_semi")
    least = tied.groupBy(key, f"{th}_").agg(F.min(F.struct(*docs.columns)).alias(row))
    return kept.unionByName(least.select(*[F.col(row)[c].alias(c) for c in docs.columns]))
