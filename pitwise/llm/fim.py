"""Fill-in-the-middle transformation over a learned rank index of unit boundaries.

A text is cut into units (lines, the last one perhaps without its newline), and
two unit ranks, drawn from a hash of the key, part it into prefix, middle and
suffix.  Where a rank's boundary lies is answered by an index over the boundaries
of all texts of a block:

1. segments are fitted from rank to byte offset, each as long as one line stays
   within ``ERROR`` bytes of every boundary in it (a cone of slopes that narrows);
2. the difference between each boundary and its segment's line is stored as a
   16-bit residual;
3. a cut is the line's value at its rank plus the stored residual, which is exact.

Defined cases: a null text is empty; an empty text and one that holds a sentinel
stay as they are (form ``plain``); a null key hashes like the empty string.
Repeated rows are transformed alike.  A text is worked on whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitwise.llm.storage import fresh
from pitwise.llm.words import blocks, text_buffer

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 4096
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


class RankIndex:
    """Rank -> value of an ascending integer array: error-bounded lines and exact residuals."""

    def __init__(self, values: np.ndarray, error: int = ERROR) -> None:
        first, slopes = [], []
        at, width = 0, 64
        while at < len(values):
            # the slopes that keep every value so far within the error, over a window that grows until none is left
            x = np.arange(1, min(width, len(values) - at - 1) + 1)
            rise = values[at + 1:at + 1 + len(x)] - values[at]
            low = np.maximum.accumulate((rise - error) / x)
            high = np.minimum.accumulate((rise + error) / x)
            ended = np.flatnonzero(low > high)
            if not len(ended) and at + 1 + len(x) < len(values):
                width *= 2
                continue
            last = int(ended[0]) if len(ended) else len(x)
            first.append(at)
            slopes.append((low[last - 1] + high[last - 1]) / 2 if last else 0.0)
            at += last + 1
            width = max(64, 2 * last)
        self.first = np.array(first, np.int64)
        self.base = values[self.first] if len(first) else np.zeros(0, np.int64)
        self.slope = np.array(slopes)
        self.residual = (values - self.predict(np.arange(len(values)))).astype(np.int16 if error < 32_000 else np.int64)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        own = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[own] + np.rint(self.slope[own] * (ranks - self.first[own])).astype(np.int64)

    def lookup(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def line_bounds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The byte after each line of each text, ascending; a text's last line may lack its newline."""
    return np.union1d(np.flatnonzero(raw == 10) + 1, offsets[1:][np.diff(offsets) > 0])


def _transform(texts: pa.Array, draws: list[np.ndarray], error: int) -> list[pa.Array]:
    """The added columns for the texts; ``draws``: two cut draws and whether to try the middle, and suffix first."""
    raw, offsets = text_buffer(texts)
    bounds = line_bounds(raw, offsets)
    index = RankIndex(bounds, error)
    before = np.searchsorted(bounds, offsets, "right")      # lines of all texts before each text
    n = np.diff(before)
    one, two, chosen, suffix_first = draws
    cuts = []
    for units in (np.minimum(one % (n + 1), two % (n + 1)), np.maximum(one % (n + 1), two % (n + 1))):
        inner = units > 0
        cut = offsets[:-1].copy()
        cut[inner] = index.lookup((before[:-1] + units - 1)[inner])
        cuts.append(cut)
    plain = (np.diff(offsets) == 0) | ~chosen
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    points = (raw & 0xC0) != 0x80
    data = raw.tobytes()
    out, sizes, heads, middles = [], np.zeros(len(n) + 1, np.int64), [], []
    p, s, m = (mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE))
    for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), cuts[0].tolist(), cuts[1].tolist(), offsets[1:].tolist(), strict=True)):
        if plain[i]:
            parts = [data[a:d]]
        elif suffix_first[i]:
            parts = [s, data[c:d], p, data[a:b], m, data[b:c]]
        else:
            parts = [p, data[a:b], s, data[c:d], m, data[b:c]]
        out += parts
        sizes[i + 1] = sum(map(len, parts))
        heads.append(None if plain[i] else int(np.count_nonzero(points[a:b])))
        middles.append(None if plain[i] else int(np.count_nonzero(points[b:c])))
    made = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.cumsum(sizes)), pa.py_buffer(b"".join(out)))
    form = np.where(plain, "plain", np.where(suffix_first, "spm", "psm"))
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(heads, pa.int64()),
            pa.array(middles, pa.int64()), made.cast(pa.string()) if sizes.sum() < 2**31 - 1 else made]


def fill_in_middle(docs: DataFrame, seed: str = "7", rate: int = 100, suffix_first: int = 50, key: str = "doc_id",
                   text: str = "text", error: int = ERROR) -> DataFrame:
    """All rows and columns of ``docs`` with n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Columns of these names are replaced.  ``rate`` percent of the texts are transformed, ``suffix_first`` percent of
    these with the suffix before the prefix.  The four draws are the first 32-bit groups of sha256(``seed``:key).
    """
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    body, *names = fresh(kept, "body", "h1", "h2", "h3", "h4")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(names)]
    rows = docs.select(*kept, F.col(text).alias(body), *draws)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, body):
            h1, h2, h3, h4 = (batch.column(h).to_numpy(zero_copy_only=False) for h in names)
            added = _transform(batch.column(body), [h1, h2, h3 % 100 < rate, h4 % 100 < suffix_first], error)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + added, names=[*kept, *ADDED])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    return rows.mapInArrow(run, ", ".join([*fields, "n long, form string, prefix_chars long, middle_chars long, output string"]))


def restore(output: Column, form: Column) -> Column:
    """The text that was transformed: its parts hold no sentinel, so each sentinel is found at its first place."""
    rest = F.substr(output, F.lit(4))
    first = F.when(form == "psm", F.substring_index(rest, SUFFIX, 1)).otherwise(F.substring_index(rest, PREFIX, 1))
    after = F.substr(rest, F.char_length(first) + 4)
    second = F.substring_index(after, MIDDLE, 1)
    middle = F.substr(after, F.char_length(second) + 4)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second))
            .otherwise(F.concat(second, middle, first)))
