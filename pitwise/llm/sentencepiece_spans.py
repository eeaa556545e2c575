"""SentencePiece encoding that keeps source offsets, and decoding.

Texts are normalised here, by the longest-prefix match of the model's compiled
character map (a double-array trie), and each normalised byte remembers the
source byte it comes from.  The library then cuts the normalised text into
pieces (its own normaliser switched off), and every piece is projected back to
a byte span of the source.  All steps work on whole blocks of texts in numpy.

Defined cases: a null text is empty; an empty text has the begin and end ids
only.  Begin and end ids have empty spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import fresh, worker_cache
from pitwise.llm.words import blocks, text_buffer

SPACE_SYMBOL = "▁".encode()
#: Text bytes encoded at once (one longer text is encoded alone).
BLOCK = 1 << 19


# --- the model file: the few fields that matter here ---

def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


class Rules(NamedTuple):
    """The model's normaliser."""

    trie: np.ndarray            # uint32 units of the double array, empty without a map
    strings: bytes              # replacements, each ended by a zero byte
    dummy_prefix: bool
    squeeze: bool               # remove leading, trailing and repeated spaces
    escape: bool                # spaces become the space symbol
    suffix: bool                # the dummy space goes to the end
    kept: tuple[bytes, ...]     # user-defined symbols, never normalised


def read_rules(model: bytes) -> Rules:
    spec, kept, suffix = b"", [], False
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3) == 4:       # a user-defined piece
                kept.append(piece[1])
        elif number == 2:
            suffix = bool(dict(_fields(value)).get(24, 0))
        elif number == 3:
            spec = value
    found = dict(_fields(spec))
    blob = found.get(2, b"")
    size = int.from_bytes(blob[:4], "little") if blob else 0
    return Rules(np.frombuffer(blob[4:4 + size], "<u4"), blob[4 + size:], bool(found.get(3, 1)),
                 bool(found.get(4, 1)), bool(found.get(5, 1)), suffix, tuple(kept))


# --- normalisation with alignment ---

def longest_prefixes(rules: Rules, buf: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start in ``at``: bytes of the longest key of the trie there (0: none; not beyond ``stop``), and its value.

    All starts walk the double array together, one byte a step.
    """
    length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    if not len(rules.trie):
        return length, value

    def offset(unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    trie = rules.trie.astype(np.int64)
    live = np.arange(len(at))
    node = np.full(len(at), int(offset(trie[:1])[0]))
    pos = at.copy()
    while len(live):
        here = pos < stop[live]
        live, node, pos = live[here], node[here], pos[here]
        byte = buf[pos].astype(np.int64)
        node = node ^ byte
        inside = node < len(trie)
        live, node, pos, byte = live[inside], node[inside], pos[inside], byte[inside]
        unit = trie[node]
        good = (unit & ((1 << 31) | 0xFF)) == byte
        live, node, pos, unit = live[good], node[good], pos[good] + 1, unit[good]
        node = node ^ offset(unit)
        leaf = np.flatnonzero((unit >> 8) & 1)
        length[live[leaf]] = pos[leaf] - at[live[leaf]]
        value[live[leaf]] = trie[node[leaf]] & ((1 << 31) - 1)
    return length, value


def _chunks(rules: Rules, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Source chunks that are normalised as one: start, end, replacement start and end in ``strings`` (-1: as it is)."""
    size = int(offsets[-1])
    starts = np.flatnonzero((buf[:size] & 0xC0) != 0x80)        # characters
    ends = np.append(starts[1:], size)
    stops = offsets[np.searchsorted(offsets, starts, "right")]
    length, value = longest_prefixes(rules, buf, starts, stops)
    plain = length == 0
    if rules.kept:
        data = buf[:size].tobytes()
        for symbol in sorted(rules.kept, key=len):
            found = data.find(symbol)
            while found >= 0:
                k = np.searchsorted(starts, found)
                if found + len(symbol) <= stops[k]:
                    length[k], plain[k] = len(symbol), True
                found = data.find(symbol, found + 1)
    over = np.flatnonzero(length > ends - starts)               # a match of several characters covers the next ones
    if len(over):
        alive, free = np.ones(len(starts), bool), 0
        for k in over.tolist():
            if starts[k] >= free:
                free = starts[k] + length[k]
                alive[k + 1:np.searchsorted(starts, free)] = False
        ends = np.where(length > 0, starts + length, ends)
        starts, ends, value, plain = starts[alive], ends[alive], value[alive], plain[alive]
    low = np.where(plain, -1, value)
    high = low.copy()
    at = np.flatnonzero(~plain)
    if len(at):
        zeros = np.flatnonzero(np.frombuffer(rules.strings, np.uint8) == 0)
        high[at] = zeros[np.searchsorted(zeros, low[at])]
    return starts, ends, low, high


def normalise(rules: Rules, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, the texts' offsets in them, and each byte's source position (one more at the end).

    A byte's source position is the start of the chunk it comes from.
    """
    starts, ends, low, high = _chunks(rules, buf, offsets)
    doc = np.searchsorted(offsets, starts, "right") - 1
    sizes = np.where(low < 0, ends - starts, high - low)
    total = int(sizes.sum())
    chunk = np.repeat(np.arange(len(starts)), sizes)
    inner = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = starts[chunk]
    out = buf[np.minimum(source + inner, len(buf) - 1)]
    if len(rules.strings):
        mapped = low[chunk] >= 0
        out = np.where(mapped, np.frombuffer(rules.strings, np.uint8)[np.maximum(low[chunk], 0) + np.where(mapped, inner, 0)], out)
    owner = doc[chunk]
    if rules.squeeze:
        space = out == 32
        first = np.ones(total, bool)
        first[1:] = owner[1:] != owner[:-1]
        keep = ~(space & (first | np.append(False, space[:-1])))
        last = np.append(first[1:], True) if total else first
        # a text's last kept space goes too if only spaces follow it
        out, source, owner = out[keep], source[keep], owner[keep]
        last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
        keep = ~(last & (out == 32))
        out, source, owner = out[keep], source[keep], owner[keep]
    # the dummy space of each text that has anything left (or anything at all, if spaces are kept)
    count = np.bincount(owner, minlength=len(offsets) - 1)
    dummy = (count > 0) & rules.dummy_prefix
    symbol = np.frombuffer(SPACE_SYMBOL if rules.escape else b" ", np.uint8)
    wide = np.where(out == 32, len(symbol), 1)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    if dummy.any():
        put = (bounds[1:] if rules.suffix else bounds[:-1])[dummy]
        where = (offsets[1:] if rules.suffix else offsets[:-1])[dummy]
        out, wide = np.insert(out, put, 32), np.insert(wide, put, len(symbol))
        source = np.insert(source, put, where)
        bounds = bounds + np.concatenate(([0], np.cumsum(dummy)))
    first = np.concatenate(([0], np.cumsum(wide)))
    spread = np.empty(int(first[-1]), np.uint8)
    at = np.flatnonzero(wide == 1)
    spread[first[at]] = out[at]
    spaces = first[np.flatnonzero(out == 32)]
    for k, byte in enumerate(symbol):
        spread[spaces + k] = byte
    return spread, first[bounds], np.append(np.repeat(source, wide), offsets[-1])


# --- encoding ---

class Encoder:
    """A model's two processors (as it is, and without its normaliser) and the byte length of each piece."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            model = file.read()
        self.rules = read_rules(model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        # a later field of the same number overrides: empty map, no dummy prefix, no squeezing, no escapes
        override = b"\x12\x00\x18\x00\x20\x00\x28\x00"
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=model + b"\x1a" + bytes([len(override)]) + override)
        n = self.own.get_piece_size()
        self.lengths = np.array([1 if self.own.is_byte(i) else len(self.own.id_to_piece(i).encode()) for i in range(n)])
        self.unknown = self.own.unk_id()
        # if the space symbol only ever begins a piece, no piece spans the place before it
        symbol = SPACE_SYMBOL.decode()
        self.separable = not any(symbol in self.own.id_to_piece(i).lstrip(symbol) for i in range(n))

    @classmethod
    def at(cls, path: str) -> Encoder:
        cache = worker_cache()
        if ("spm", path) not in cache:
            cache["spm", path] = cls(path)
        return cache["spm", path]

    def _units(self, out: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the parts of normalised texts that are encoded on their own, and the text of each.

        Parts begin at a space symbol after something else, if no piece can span that place; each distinct
        part of a block is encoded once.
        """
        begin = np.zeros(len(out) + 1, bool)
        if self.separable and len(out) > 2:
            symbol = np.zeros(len(out), bool)
            symbol[:-2] = (out[:-2] == SPACE_SYMBOL[0]) & (out[1:-1] == SPACE_SYMBOL[1]) & (out[2:] == SPACE_SYMBOL[2])
            begin[:-1] = symbol
            begin[3:-1] &= ~symbol[:-3]
        begin[bounds] = True
        begin[len(out)] = False
        starts = np.flatnonzero(begin)
        return np.append(starts, len(out)).astype(np.int64), np.searchsorted(bounds, starts, "right") - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts without begin and end ids, each text's first id, and each id's source span in its text."""
        raw, offsets = text_buffer(texts)
        buf = np.append(raw, np.zeros(1, np.uint8))
        out, bounds, source = normalise(self.rules, buf, offsets)
        units, owner = self._units(out, bounds)
        packed = pa.Array.from_buffers(pa.large_binary(), len(units) - 1, [None, pa.py_buffer(units), pa.py_buffer(out)])
        packed = packed.dictionary_encode()
        lists = self.plain.encode([u.decode() for u in packed.dictionary.to_pylist()], num_threads=1)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        known = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        place = packed.indices.to_numpy(zero_copy_only=False)
        width = sizes[place]
        start = (np.cumsum(sizes) - sizes)[place]
        ids = known[np.repeat(start - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))]
        counts = np.bincount(owner, weights=width, minlength=len(offsets) - 1).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        lengths = self.lengths[ids]
        unknown = np.flatnonzero(ids == self.unknown) if self.unknown >= 0 else []
        for k in sorted({int(x) for x in np.searchsorted(first, unknown, "right") - 1}):
            pieces = self.plain.encode(out[bounds[k]:bounds[k + 1]].tobytes().decode(), out_type=str)
            lengths[first[k]:first[k + 1]] = [len(p.encode()) for p in pieces]
        doc = np.repeat(np.arange(len(counts)), counts)
        run = np.concatenate(([0], np.cumsum(lengths)))
        begin = run[:-1] - run[first[:-1]][doc] + bounds[:-1][doc]
        end = begin + lengths
        # the source span ends where the first byte after the piece comes from
        stop = np.where(end < bounds[1:][doc], source[np.minimum(end, len(source) - 1)], offsets[1:][doc])
        return ids, first, source[begin] - offsets[:-1][doc], stop - offsets[:-1][doc]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """All columns and rows of ``docs`` with ids, span_begin and span_end (arrays of int; byte offsets in the text)."""
    body, = fresh(docs.columns, "body")
    kept = [c for c in docs.columns if c.lower() not in ("ids", "span_begin", "span_end")]
    rows = docs.select(*kept, F.col(text).alias(body))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(model)
        bos, eos = encoder.own.bos_id(), encoder.own.eos_id()
        for batch in blocks(batches, body, BLOCK):
            ids, first, begin, end = encoder.encode(batch.column(body))
            lists = []
            sizes = np.diff(blocks_ends(batch.column(body)))
            for values, head, tail in ((ids, bos, eos), (begin, 0, None), (end, 0, None)):
                tails = sizes if tail is None else np.full(len(sizes), tail)
                wide = np.insert(values, np.repeat(first, 2)[1:-1], np.stack((np.full(len(sizes), head), tails), 1).ravel())
                lists.append(_lists(wide, first + 2 * np.arange(len(first))))
            columns = [batch.column(c) for c in kept] + lists
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "ids", "span_begin", "span_end"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "ids array<int>", "span_begin array<int>", "span_end array<int>"]))


def blocks_ends(texts: pa.Array) -> np.ndarray:
    return text_buffer(texts)[1]


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: ids with begin and end, as little-endian 32-bit integers."""
    own, body = "key", "body"
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        encoder = Encoder.at(model)
        bos, eos = encoder.own.bos_id(), encoder.own.eos_id()
        for batch in blocks(batches, body, BLOCK):
            ids, first, _, _ = encoder.encode(batch.column(body))
            cuts = first.tolist()
            counts, hashes, decoded = [], [], []
            lists = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                full = np.empty(b - a + 2, "<u4")
                full[0], full[1:-1], full[-1] = bos, ids[a:b], eos
                counts.append(len(full))
                hashes.append(hashlib.sha256(full.tobytes()).hexdigest())
                lists.append(full.tolist())
            for words in encoder.own.decode(lists, num_threads=1):
                decoded.append(hashlib.sha256(words.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(own), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()),
                                              pa.array(decoded, pa.string())],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias(own), F.col(text).alias(body))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
