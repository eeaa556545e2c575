"""Chat formatting by columnar byte assembly.

A turn is ``### role: text</turn>`` and a newline.  Inside roles and texts a
backslash goes before each backslash, ``#`` and ``<`` (in roles before ``:``
too), so no control string can occur there, and reading back is exact.

All turns of a batch are assembled at once: byte lengths of the segments
(marks, roles, texts), their cumulative offsets, and one gather into a
preallocated Arrow buffer; nothing is built turn by turn.  A conversation whose
turns go on in a further batch continues in a further part, so memory does not
grow with a conversation.

Defined cases: null roles and texts are empty; turns are ordered by turn, a null
one last, then role and text; rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.words import blocks, text_buffer

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
TRAINED = "assistant"
PARTS = "conv_id long, part int, n_turns int, formatted string, loss_begin array<long>, loss_end array<long>"
_BLOCK = 4 << 20


def escape(texts: pa.Array, marks: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a backslash before each byte in ``marks``, and their offsets."""
    raw, offsets = text_buffer(texts)
    special = np.isin(raw, np.frombuffer(marks, np.uint8))
    shift = np.concatenate(([0], np.cumsum(special)))
    out = np.full(len(raw) + int(shift[-1]), ord("\\"), np.uint8)
    out[np.arange(len(raw)) + shift[1:]] = raw
    return out, offsets + shift[offsets]


def escapes(buf: np.ndarray) -> np.ndarray:
    """Which backslashes of escaped bytes are escapes: every other one of each run, from its first."""
    slash = buf == ord("\\")
    at = np.flatnonzero(slash)
    out = np.zeros(len(buf), bool)
    if len(at):
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) != 1
        run = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        out[at] = (np.arange(len(at)) - run) % 2 == 0
    return out


def unescape(data: bytes) -> bytes:
    buf = np.frombuffer(data, np.uint8)
    return buf[~escapes(buf)].tobytes() if b"\\" in data else data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of all turns, the turns' offsets, and where each text begins and ends."""
    role, role_at = escape(roles, b"\\#<:")
    text, text_at = escape(texts, b"\\#<")
    fixed = np.frombuffer(OPEN + MIDDLE + CLOSE, np.uint8)
    pool = np.concatenate((fixed, role, text))
    n = len(roles)
    begin, size = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, (start, length) in enumerate((
            (0, len(OPEN)), (len(fixed) + role_at[:-1], np.diff(role_at)), (len(OPEN), len(MIDDLE)),
            (len(fixed) + len(role) + text_at[:-1], np.diff(text_at)), (len(OPEN) + len(MIDDLE), len(CLOSE)))):
        begin[:, k], size[:, k] = start, length
    ends = np.cumsum(size.ravel())
    starts = ends - size.ravel()
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    np.take(pool, np.repeat(begin.ravel() - starts, size.ravel()) + np.arange(len(out)), out=out)
    starts, ends = starts.reshape(n, 5), ends.reshape(n, 5)
    return out, np.append(starts[:, 0], len(out)), starts[:, 3], ends[:, 3]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in blocks(batches, "text", _BLOCK):
        n = batch.num_rows
        out, at, begin, end = assemble(batch.column("role"), batch.column("text"))
        conv = batch.column("conv_id")
        ids, none = pc.fill_null(conv, 0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        first = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1))
        bounds = np.append(first, n)
        names = conv.take(pa.array(first)).to_pylist()
        parts = [0] * len(first)
        parts[0] = part = part + 1 if names[0] == last else 0
        if len(first) > 1:
            part = 0
        last = names[-1]
        loss = pc.fill_null(pc.equal(batch.column("role"), TRAINED), False).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(first)), np.diff(bounds))
        base = at[first][owner]
        lists = pa.array(np.concatenate(([0], np.cumsum(loss)))[bounds].astype(np.int32))
        text = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at[bounds].astype(np.int64)), pa.py_buffer(out)])
        yield pa.RecordBatch.from_arrays([
            conv.take(pa.array(first)), pa.array(parts, pa.int32()), pa.array(np.diff(bounds).astype(np.int32)), text.cast(pa.string()),
            pa.ListArray.from_arrays(lists, pa.array((begin - base)[loss])),
            pa.ListArray.from_arrays(lists, pa.array((end - base)[loss]))],
            names=["conv_id", "part", "n_turns", "formatted", "loss_begin", "loss_end"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per conversation, or per part of a long one: conv_id, part (0, 1, ...), n_turns, formatted, and the byte spans
    of ``formatted`` that are trained on (loss_begin, loss_end).  Parts joined in order are the conversation's text.

    A conversation's rows stay in one partition, in order.
    """
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return (rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
            .drop("turn").mapInArrow(_format, PARTS))


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of formatted bytes."""
    buf = np.frombuffer(formatted, np.uint8)
    escaped = escapes(buf)
    free = np.ones(len(buf), bool)
    free[1:] = ~escaped[:-1]
    closes = np.flatnonzero((buf == ord("<")) & free)
    colons = np.flatnonzero((buf == ord(":")) & free)
    starts = np.append(0, closes[:-1] + len(CLOSE)) if len(closes) else closes
    middles = colons[np.searchsorted(colons, starts + len(OPEN))] if len(closes) else closes
    return [(unescape(formatted[a + len(OPEN):m]), unescape(formatted[m + len(MIDDLE):b]))
            for a, m, b in zip(starts.tolist(), middles.tolist(), closes.tolist(), strict=True)]


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    held = None

    def done() -> pa.RecordBatch:
        conv, turns, all_, chars, loss, total = held
        row = (conv, turns, all_.hexdigest(), chars, loss.hexdigest(), total)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        finished = []
        for row in batch.to_pylist():
            if row["part"] == 0:
                if held:
                    finished.append(done())
                held = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            data = row["formatted"].encode()
            turns = read_turns(data)
            held[1] += len(turns)
            held[2].update(b"".join(b"%s\n%s\n" % x for x in turns))
            for a, b in zip(row["loss_begin"], row["loss_end"], strict=True):
                text = unescape(data[a:b])
                held[3] += len(text.decode())
                held[4].update(text)
            held[5] += len(row["formatted"])
        if finished:
            yield pa.Table.from_batches(finished).combine_chunks().to_batches()[0]
    if held:
        yield done()


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation from the output of format_chats(), in its order: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    return parts.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                        "formatted_chars long")
