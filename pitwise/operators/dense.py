"""Order statistics and age weights of time windows inside one shop, in numpy.

For shops below the hot-key limit (``operators/scan.py``) a shop's times and prices
fit one task, and both features that look at every row of a window are answered
without looking at them one by one:

* B5: a wavelet matrix over the numbers of the shop's prices in time order. A
  window is an index range; each level tells how many of its rows have a zero bit,
  which says where its 75th percentile lies and how many cancelled rows lie above.
  A window costs one step per bit of the largest number, whatever it holds.
* B8: the rows at most d days old, d = 2 ... w, by binary search over the times.

The sums of windows and steps are differences of running sums at the same places.
All take time in proportion to rows and sampled rows, times a logarithm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pitwise.functions import exactsum

#: Sampled rows answered at once (bounds the matrix of ages).
STEP = 8_192
#: Rows of small shops taken together, and the most microseconds their times may reach over.
TOGETHER, REACH = 32_768, 1 << 61


def blocked_rows(price: np.ndarray, cancelled: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each index range [low, high): cancelled rows above the range's 75th percentile of price; NaN is no price.

    With n prices the percentile lies between order statistics k = floor(0.75 (n - 1)) and k + 1, and a price is above it
    exactly if it is above statistic k."""
    known = ~np.isnan(price)
    place = np.concatenate(([0], np.cumsum(known)))
    low, high = place[low], place[high]
    code = np.unique(price[known], return_inverse=True)[1]
    gone = cancelled[known].astype(np.int64)
    k = np.floor(0.75 * (high - low - 1)).astype(np.int64)
    above = np.zeros(len(low), np.int64)
    some = high > low
    for bit in reversed(range(int(code.max()).bit_length() if len(code) else 0)):
        one = (code >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~one)))
        over = np.concatenate(([0], np.cumsum(one * gone)))
        left = zeros[high] - zeros[low]
        down = k < left
        above += np.where(down, over[high] - over[low], 0)
        k = np.where(down, k, k - left)
        low, high = (np.where(down, zeros[x], zeros[-1] + x - zeros[x]) for x in (low, high))
        order = np.argsort(one, kind="stable")
        code, gone = code[order], gone[order]
    return np.where(some, above, 0)


def age_weights(time: np.ndarray, at: np.ndarray, low: dict[int, np.ndarray], high: np.ndarray, day: int) -> dict[int, np.ndarray]:
    """For each window w: the sum of 1 / max(whole days before ``at``, 1) over the rows of [at - w days, at).

    Summed by parts over the rows younger than d days, so all terms are positive."""
    out, weight = {}, np.zeros(len(at))
    for d in range(2, max(low) + 1):
        younger = high - np.searchsorted(time, at - d * day, "right")
        weight = weight + younger * (1 / (d - 1) - 1 / d)
        if d in low:
            out[d] = weight + (high - low[d]) / d
    return out


def shop_features(time: np.ndarray, price: np.ndarray, cancelled: np.ndarray, picked: np.ndarray, windows: tuple[int, ...],
                  day: int) -> list[np.ndarray]:
    """``bl{w}`` and ``wt{w}`` of the rows ``picked`` of shops in time order, one after the other."""
    out: list[list[np.ndarray]] = []
    for a in range(0, len(picked), STEP):
        at = time[picked[a:a + STEP]]
        high = np.searchsorted(time, at, "left")
        low = {w: np.searchsorted(time, at - w * day, "left") for w in windows}
        counts = blocked_rows(price, cancelled, np.concatenate(list(low.values())), np.tile(high, len(windows)))
        weights = age_weights(time, at, low, high, day)
        out.append([*np.split(counts, len(windows)), *[weights[w] for w in windows]])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def sampled_features(windows: tuple[int, ...], first: int, every: int, day: int, horizon: int, dense: bool):
    """A function for ``mapInArrow`` over rows (shop_id, pos, price, canc, mode_type, cash, inv) sorted by shop, time and
    order in an instant: one row per sampled row, and the fields of these rows.

    Of each window: ``one@w`` (its rows), the totals ``{c}@w`` over its rows (``canc``, the parts of ``rev``), those over the
    steps between them (the limbs of ``d_cash`` and ``d_inv``, their number ``_n``), and, if ``dense``, ``bl{w}`` and
    ``wt{w}``. ``one``, ``cash``, ``inv`` at ``now`` and ``post`` (``horizon`` later): the rows before that time and the
    values of the last one. Totals are differences of running sums of whole numbers (``functions/exactsum.py``)."""
    sums = ["canc", *exactsum.names("rev")]
    steps = [part for x in ("cash", "inv") for part in [*exactsum.limbs(f"d_{x}"), f"d_{x}_n"]]
    whole = ["idx", "pos", "n_rows", "first_t", "last_t", "one@now", "one@post", *[f"{c}@{w}" for w in windows for c in ["one", *sums, *steps]]]
    fields = ["shop_id string", "mode_type string", *[f"`{c}` long" for c in whole], *[f"`{c}@{k}` double" for k in ("now", "post") for c in ("cash", "inv")]]
    fields += [f"bl{w} long" for w in windows] + [f"wt{w} double" for w in windows] if dense else []
    names = [f.rsplit(" ", 1)[0].strip("`") for f in fields]

    gap = max(*(w * day for w in windows), horizon) + 1

    def batch_of(group: list[tuple]) -> pa.RecordBatch:
        shops, modes, parted = zip(*group, strict=True)
        parts = [p for x in parted for p in x]
        time, price, gone = (np.concatenate([p[k] for p in parts]) for k in range(3))
        values = [pa.concat_arrays([p[k] for p in parts]) for k in (3, 4)]
        rows = np.array([sum(len(p[0]) for p in x) for x in parted])
        start = np.cumsum(rows) - rows
        owner = np.repeat(np.arange(len(rows)), rows)
        begin, end = time[start], time[start + rows - 1]
        # the shops follow each other on one axis, further apart than a window or the horizon reaches
        extent = end - begin + gap
        axis = time - begin[owner] + (np.cumsum(extent) - extent)[owner]
        place = np.arange(len(time)) - start[owner]
        picked = np.flatnonzero((place >= first) & ((place - first) % every == 0))
        of = owner[picked]
        running = np.zeros((len(time) + 1, len(sums) + len(steps)), np.int64)
        running[1:, 0] = gone
        running[1:, 1:1 + exactsum.LIMBS], running[1:, len(sums) - 1], _ = exactsum.split_array(price)
        for k, x in enumerate(values):
            # the step into a row counts if both rows have a finite value
            limbs, _, known = exactsum.split_array(x.to_numpy(zero_copy_only=False).astype(float))
            both, a = known[1:] & known[:-1] & (owner[1:] == owner[:-1]), len(sums) + k * (exactsum.LIMBS + 1)
            running[2:, a:a + exactsum.LIMBS] = np.diff(limbs, axis=0) * both[:, None]
            running[2:, a + exactsum.LIMBS] = both
        np.cumsum(running, axis=0, out=running)
        at = axis[picked]
        now, post = np.searchsorted(axis, at, "left"), np.searchsorted(axis, at + horizon, "left")
        numbers = [place[picked], time[picked], rows[of], begin[of], end[of], now - start[of], post - start[of]]
        for w in windows:
            low = np.searchsorted(axis, at - w * day, "left")
            inner = np.minimum(low + 1, now)
            numbers += [now - low, *(running[now, :len(sums)] - running[low, :len(sums)]).T, *(running[now, len(sums):] - running[inner, len(sums):]).T]
        last = [v.take(pa.array(x - 1, mask=x == start[of])) for x in (now, post) for v in values]
        found = shop_features(axis, price, gone, picked, windows, day) if dense and len(picked) else []
        if dense and not found:
            found = [np.zeros(0, np.int64) for _ in windows] + [np.zeros(0) for _ in windows]
        return pa.RecordBatch.from_arrays([*[pa.array(np.array(x, object)[of], pa.string()) for x in (shops, modes)],
                                           *[pa.array(np.ascontiguousarray(x)) for x in numbers], *last, *[pa.array(x) for x in found]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shop, mode, held, group, size, reach = None, None, [], [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("shop_id").dictionary_encode()
            code = ids.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            time, price, gone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("pos", "price", "canc"))
            columns = [time, price.astype(float), gone, batch.column("cash"), batch.column("inv")]
            for a, b in zip(cuts, cuts[1:], strict=False):
                name = ids.dictionary[int(code[a])].as_py()
                if held and name != shop:
                    group.append((shop, mode, held))
                    size += sum(len(p[0]) for p in held)
                    reach += int(held[-1][0][-1]) - int(held[0][0][0]) + gap
                    held = []
                    if size >= TOGETHER or reach >= REACH:
                        yield batch_of(group)
                        group, size, reach = [], 0, 0
                shop, mode = name, batch.column("mode_type")[a].as_py()
                held.append(tuple(c[a:b] for c in columns))
        if held:
            yield batch_of([*group, (shop, mode, held)])

    return run, ", ".join(fields)
