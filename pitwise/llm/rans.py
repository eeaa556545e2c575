"""Token-ID files coded with a static range asymmetric numeral system (rANS).

One table of token frequencies, counted over all documents, is shared by all
blocks.  A block holds the ids of consecutive whole documents; its ids are dealt
to ``LANES`` interleaved coder states, which numpy advances together.  Blocks are
independent; a checkpoint (all states and the place in the stream) every
``STEPS`` steps lets a reader start inside a block, and a crc32 of the ids guards
each block.  The files are Parquet with one row a block, in ascending order of
document key (columns of BLOCKS below).

Defined cases: a null text is empty; a null key comes first; rows with equal
keys are ordered by a hash of their text.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwise.llm.storage import shared_dir, small, worker_cache, written
from pitwise.llm.words import blocks, text_buffer

SCALE = 18                       # frequencies add up to 2^SCALE
LANES = 1024
STEPS = 128
BLOCK = 1 << 18                  # ids after which a block ends (a longer document is a block of its own)
_LOW = np.uint64(1 << 31)        # states are in [2^31, 2^63)
#: Words a Python worker remembers with their ids: as many that it has met lately, and as many from before.
REMEMBERED = 300_000

BLOCKS = ("part long, block int, start long, n long, crc32 long, keys array<{kind}>, counts array<int>, "
          "stream binary, states binary, checkpoints binary, places array<int>")


# --- the coder ---

def scaled_frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that add up to 2^scale, at least 1 where ``counts`` is positive."""
    total, room = int(counts.sum()), 1 << scale
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(len(counts), np.uint64)
    if len(used) > room:
        raise ValueError("more symbols than slots; use a larger scale")
    out = np.zeros(len(counts), np.int64)
    out[used] = np.maximum(counts[used].astype(np.float64) * ((room - len(used)) / total), 0).astype(np.int64) + 1
    out[used[np.argmax(counts[used])]] += room - int(out.sum())
    return out.astype(np.uint64)


class Table:
    """Shared frequencies with their running sums and the symbol of each slot."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.scale = np.uint64(max(int(frequencies.sum()).bit_length() - 1, 0))
        self.freq = frequencies.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, steps: int = STEPS) -> tuple[bytes, bytes, bytes, list[int]]:
    """(stream, states, checkpoints, places) of a block: 32-bit words as the decoder reads them, its first states, and the
    states and stream places at every ``steps`` steps."""
    x = np.full(lanes, _LOW, np.uint64)
    limit = np.uint64(63) - table.scale
    rounds = -(-len(ids) // lanes)
    out, marks, written_, sizes = [], [], 0, []
    for t in range(rounds - 1, -1, -1):
        part = ids[t * lanes:(t + 1) * lanes]
        k = len(part)
        f, c, y = table.freq[part], table.start[part], x[:k]
        full = y >= (f << limit)
        words = y[full].astype(np.uint32)        # the low 32 bits
        y = np.where(full, y >> np.uint64(32), y)
        q = y // f
        x[:k] = (q << table.scale) + (y - q * f) + c
        out.append(words)
        written_ += len(words)
        if t % steps == 0 and t:
            marks.append(x.tobytes())
            sizes.append(written_)
    places = [written_ - s for s in reversed(sizes)]
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    return stream.astype("<u4").tobytes(), x.tobytes(), b"".join(reversed(marks)), places


def decode_block(n: int, stream: bytes, states: bytes, checkpoints: bytes, places: list[int], table: Table,
                 lanes: int = LANES, steps: int = STEPS, first: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of the block's checkpoint segments ``first`` to ``stop`` (all by default); segments are independent."""
    rounds = -(-n // lanes)
    last = rounds if stop is None else min(stop * steps, rounds)
    words = np.frombuffer(stream, "<u4").astype(np.uint64)
    if first:
        x = np.frombuffer(checkpoints, np.uint64)[(first - 1) * lanes:first * lanes].copy()
        at = places[first - 1]
    else:
        x, at = np.frombuffer(states, np.uint64).copy(), 0
    mask = np.uint64((1 << int(table.scale)) - 1)
    out = np.empty(max(min(last * lanes, n) - first * steps * lanes, 0), np.uint32)
    done = 0
    for t in range(first * steps, last):
        k = min(lanes, n - t * lanes)
        y = x[:k]
        slot = y & mask
        s = table.symbol[slot]
        y = table.freq[s] * (y >> table.scale) + slot - table.start[s]
        low = np.flatnonzero(y < _LOW)
        y[low] = (y[low] << np.uint64(32)) | words[at:at + len(low)]
        at += len(low)
        x[:k] = y
        out[done:done + k] = s
        done += k
    return out


# --- tokens of whole texts ---

#: Rules (normaliser and pre-tokenizer) under which words may be encoded apart: white space only separates, runs of letters and
#: runs of punctuation are tokens' bounds, and case does not matter.  Fixed values of the tokenizer file.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def words_apart(path: str) -> bool:
    """Whether the tokenizer file has the rules above."""
    import json

    with open(path) as file:
        rules = json.load(file)
    normal = (rules["normalizer"] or {}).get("normalizers", [])
    split = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    return ([r["type"] for r in normal] == NORMALIZERS and normal[1]["pattern"] == {"Regex": "\\s+"} and normal[1]["content"] == " "
            and split.get("type") == "Split" and split["pattern"] == {"Regex": SPLIT} and split["behavior"] == "Removed" and split["invert"]
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].startswith("<|") for t in rules["added_tokens"]))


class WordCoder:
    """A tokenizer that remembers the ids of words it has met lately."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Token ids that end a word (none where the model does not mark them).
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordCoder:
        cache = worker_cache()
        if ("tokenizer", path) not in cache:
            cache["tokenizer", path] = cls(path)
        return cache["tokenizer", path]

    def _together(self, words: list[str]) -> None:
        """Words of letters only, each of which is one unit of the pre-tokenizer: many in one call, cut after the tokens that
        end a word."""
        for at in range(0, len(words), 2000):
            some = words[at:at + 2000]
            found = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, np.uint32)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            if len(ends) != len(some) or ends[-1] != 4 * len(ids):
                self._apart(some)
                continue
            data = ids.tobytes()
            self.young.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _apart(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            some = words[at:at + 50_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.young[w] = np.array(e.ids, np.uint32).tobytes()

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each of the distinct words, as little-endian 32-bit integers."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, words))
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not new:
            return found
        before = list(map(old.get, new))
        young.update((w, ids) for w, ids in zip(new, before, strict=True) if ids is not None)
        unknown = [w for w, ids in zip(new, before, strict=True) if ids is None]
        if unknown:
            letters = pc.match_substring_regex(pa.array(unknown), f"^{LETTER}+$").to_pylist()
            self._together([w for w, one in zip(unknown, letters, strict=True) if one])
            self._apart([w for w, one in zip(unknown, letters, strict=True) if not one])
        return [young[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]


#: Letters that neither combine nor change their number when made lower case apart from other letters.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]"


def cores_and_tails(words: pa.StringArray) -> tuple[pa.Array, pa.Array]:
    """Words in two: what comes before the last run of ``.,;:!?`` if it ends with a letter, A-Z in lower case where it is
    letters only, and that run (or the whole word and nothing).  Both have the ids of the word together."""
    ends = pc.match_substring_regex(words, LETTER + "[.,;:!?]*$")
    cores = pc.if_else(ends, pc.ascii_rtrim(words, ".,;:!?"), words)
    plain = pc.match_substring_regex(cores, f"^{LETTER}+$")       # never what may become a special token
    raw, offsets = text_buffer(words)
    size = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy(zero_copy_only=False).astype(np.int64)
    to = np.concatenate(([0], np.cumsum(size)))
    data = raw[np.repeat(offsets[1:] - size - to[:-1], size) + np.arange(int(to[-1]))]
    tails = pa.StringArray.from_buffers(len(words), pa.py_buffer(to.astype(np.int32)), pa.py_buffer(data.tobytes()))
    return pc.if_else(plain, pc.ascii_lower(cores), cores), tails


def spread(ids: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids (``sizes`` long each) at ``place``, one after the other, and their widths."""
    width = sizes[place]
    start = (np.cumsum(sizes) - sizes)[place]
    ends = np.cumsum(width)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat((start - ends + width).astype(kind), width)
    at += np.arange(total, dtype=kind)
    return ids[at], width


def token_ids(texts: pa.Array, path: str, by_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (uint32, no special tokens added) and each text's first id.

    ``by_words``: see words_apart(); each distinct word is encoded once and its ids are copied.
    """
    coder = WordCoder.at(path)
    texts = pc.fill_null(texts, "")
    if not by_words:
        lists = [e.ids for e in coder.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        return np.fromiter((i for x in lists for i in x), np.uint32, int(first[-1])), first
    split = pc.ascii_split_whitespace(texts)
    packed = split.flatten().dictionary_encode()
    pairs = [half.dictionary_encode() for half in cores_and_tails(packed.dictionary)]
    coded = coder.ids([w for half in pairs for w in half.dictionary.to_numpy(zero_copy_only=False).tolist()])
    ids, sizes = np.frombuffer(b"".join(coded), np.uint32), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
    halves = np.empty((len(packed.dictionary), 2), np.int64)
    halves[:, 0] = pairs[0].indices.to_numpy(zero_copy_only=False)
    halves[:, 1] = pairs[1].indices.to_numpy(zero_copy_only=False) + len(pairs[0].dictionary)
    ids, sizes = spread(ids, sizes, halves.ravel())
    out, width = spread(ids, sizes.reshape(-1, 2).sum(1), packed.indices.to_numpy(zero_copy_only=False))
    ends = np.concatenate(([0], np.cumsum(width)))
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    return out, ends[np.concatenate(([0], np.cumsum(counts)))]


def _token_blocks(path: str, end_id: int, kind: pa.DataType, wide: str, by_words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            n = sum(counts)
            columns = [([part], pa.int64()), ([block], pa.int32()), ([start], pa.int64()), ([n], pa.int64()),
                       ([keys], pa.list_(kind)), ([counts], pa.list_(pa.int32())), ([np.concatenate(held).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns],
                                              names=["part", "block", "start", "n", "keys", "counts", "ids"])

        for batch in blocks(batches, "text", 8 << 20):
            ids, first = token_ids(batch.column("text"), path, by_words)
            ids = np.insert(ids, first[1:], end_id).astype(wide)
            first = first + np.arange(len(first))
            for k, key in enumerate(batch.column("key").to_pylist()):
                if counts and sum(counts) + first[k + 1] - first[k] > BLOCK:
                    yield flush()
                    start += sum(counts)
                    block, keys, counts, held = block + 1, [], [], []
                keys.append(key)
                counts.append(int(first[k + 1] - first[k]))
                held.append(ids[first[k]:first[k + 1]])
        if counts:
            yield flush()

    return run


def _count(wide: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column("ids"):
                total += np.bincount(np.frombuffer(data.as_buffer(), wide), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    return run


def _encode_rows(frequencies, wide: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies.value)
        names = ["part", "block", "start", "n", "keys", "counts"]
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_buffer(), wide).astype("<u4")
                stream, states, marks, places = encode_block(ids, table)
                by = dict(zip(names, [row.column(c) for c in names], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [by["part"], by["block"], by["start"], by["n"], pa.array([zlib.crc32(ids.tobytes())], pa.int64()), by["keys"],
                     by["counts"], *[pa.array([x], pa.binary()) for x in (stream, states, marks)], pa.array([places], pa.list_(pa.int32()))],
                    names=["part", "block", "start", "n", "crc32", "keys", "counts", "stream", "states", "checkpoints", "places"])

    return run


class TokenFiles:
    """Written token files: the blocks' table and the shared frequencies (one row per token id in use)."""

    def __init__(self, rows: DataFrame, frequencies: DataFrame) -> None:
        self.rows, self.frequencies = rows, frequencies

    def table(self) -> np.ndarray:
        """The frequencies; as many as the tokenizer has ids, so they go through the driver."""
        found = self.frequencies.toPandas()
        out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.uint64)
        out[found["id"]] = found["frequency"]
        return out


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encode the whole texts, each with ``end_id`` after it, and write the token files under ``path``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    wide = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    kind = docs.schema[key].dataType.simpleString()
    arrow = docs.select(key).limit(0).toArrow().schema.field(0).type
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "th").sortWithinPartitions("key", "th").drop("th")
    tokens = written(ordered.mapInArrow(
        _token_blocks(tokenizer, end_id, arrow, wide, words_apart(tokenizer)),
        f"part long, block int, start long, n long, keys array<{kind}>, counts array<int>, ids binary"), "tokens")
    counted = (tokens.select("ids").mapInArrow(_count(wide, max(vocabulary, end_id + 1)), "id long, n long")
               .groupBy("id").agg(F.sum("n").alias("n")).toPandas())          # at most one row per token id
    counts = np.zeros(max(vocabulary, end_id + 1), np.int64)
    counts[counted["id"]] = counted["n"]
    frequencies = scaled_frequencies(counts)
    shared = spark.sparkContext.broadcast(frequencies)
    tokens.mapInArrow(_encode_rows(shared, wide, arrow), BLOCKS.format(kind=kind)).write.parquet(f"{path}/blocks")
    used = np.flatnonzero(frequencies)
    spark.createDataFrame(list(zip(used.tolist(), frequencies[used].tolist(), strict=True)), "id long, frequency long"
                          ).coalesce(1).write.parquet(f"{path}/frequencies")
    return read_token_files(docs, path)


def read_token_files(df: DataFrame, path: str) -> TokenFiles:
    spark = df.sparkSession
    return TokenFiles(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/frequencies"))


def _decode_rows(frequencies, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(frequencies.value)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                n = row["n"].as_py()
                ids = decode_block(n, row["stream"].as_py(), row["states"].as_py(), row["checkpoints"].as_py(),
                                   row["places"].as_py(), table).astype("<u4")
                if zlib.crc32(ids.tobytes()) != row["crc32"].as_py():
                    raise ValueError(f"block {row['part'].as_py()}/{row['block'].as_py()} does not match its checksum")
                sizes = row["counts"].values.to_numpy()
                ends = np.cumsum(sizes)
                starts = row["base"].as_py() + row["start"].as_py() + ends - sizes
                data = ids.tobytes()
                if digest:
                    last = pa.array([zlib.crc32(data[4 * (e - s):4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([row["keys"].values, pa.array(starts), pa.array(sizes.astype(np.int64)), last],
                                                 names=["key", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def _read(files: TokenFiles, key: str, digest: bool) -> DataFrame:
    rows = files.rows
    sizes = rows.groupBy("part").agg(F.sum("n").alias("n"))      # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("base"))
    kind = rows.schema["keys"].dataType.elementType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(files.table())
    last = "ids_crc32 long" if digest else "ids array<int>"
    told = rows.join(small(bases, sizes.count()), "part")
    return told.mapInArrow(_decode_rows(shared, digest), f"key {kind}, start long, n_tokens long, {last}").withColumnRenamed("key", key)


def read_ids(files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of each document; start counts the ids of all documents before it."""
    return _read(files, key, False)


def read_digests(files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    return _read(files, key, True)


def scratch_path(df: DataFrame, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
