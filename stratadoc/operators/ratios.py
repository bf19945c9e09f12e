"""Ratcliff and Obershelp's ratio of many pairs of texts at once, equal to difflib's."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of a table of runs in one step; letters are counted in so many buckets.
CELLS, BUCKETS = 1 << 17, 64


def joined(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each starts, with the end."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, np.cumsum([*map(len, texts)], dtype=np.int64)).astype(np.int64)


def within(low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after another."""
    return np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)


def letters(codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    sizes = high - low
    own = np.repeat(np.arange(len(low)) * BUCKETS, sizes) + codes[within(low, sizes)] % BUCKETS
    return np.bincount(own, minlength=len(low) * BUCKETS).reshape(-1, BUCKETS)


def bounds(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """No more letters than these can match in each pair of spans (low and high of a, low and high of b)."""
    out = np.empty(spans.shape[1], np.int64)
    for k in range(0, spans.shape[1], 1 << 14):
        part = spans[:, k : k + (1 << 14)]
        out[k : k + (1 << 14)] = np.minimum(letters(a, part[0], part[1]), letters(b, part[2], part[3])).sum(1)
    return out


def longest(a: np.ndarray, b: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start in a, start in b and length of each pair's longest common run, the first in a and then in b of equal ones."""
    n, m = spans[1] - spans[0], spans[3] - spans[2]
    at, to, size = spans[0].copy(), spans[2].copy(), np.zeros(len(n), np.int64)
    step = np.ceil(np.log2(np.maximum(m, 1)) * 2).astype(np.int64)
    order = np.lexsort((-n, step))
    ends = np.append(np.flatnonzero(np.diff(step[order])) + 1, len(order))
    start = 0
    while start < len(order):
        end = int(ends[np.searchsorted(ends, start, side="right")])
        width = int(m[order[start:end]].max()) + 1
        rows = order[start : min(end, start + max(1, CELLS // width))]
        start += len(rows)
        tall, wide, count = n[rows], m[rows], len(rows)
        # A row for each pair, a column that matches nothing and b's letters; a's letters come step by step.
        mine = np.zeros((count, int(tall[0])), a.dtype)
        mine[np.repeat(np.arange(count), tall), within(np.zeros(count, np.int64), tall)] = a[within(spans[0][rows], tall)]
        theirs = np.full((count, width), np.iinfo(a.dtype).max, a.dtype)
        theirs[np.repeat(np.arange(count), wide), within(np.ones(count, np.int64), wide)] = b[within(spans[2][rows], wide)]
        equal, runs, following, one = np.empty_like(theirs), np.zeros(theirs.size + 1, a.dtype), np.zeros(theirs.size + 1, a.dtype), a.dtype.type(1)
        best, at_row, to_row = np.zeros(count, a.dtype), np.zeros(count, np.int64), np.zeros(count, np.int64)
        active = count - np.searchsorted(tall[::-1], np.arange(len(mine[0])), side="right")
        for i, k in enumerate(active.tolist()):
            same, new = equal[:k], following[1 : k * width + 1]
            np.bitwise_xor(theirs[:k], mine[:k, i : i + 1], out=same)
            same = same.reshape(-1)
            np.minimum(same, one, out=same)
            np.subtract(same, one, out=same)
            np.add(runs[: k * width], one, out=new)
            np.bitwise_and(new, same, out=new)
            table = new.reshape(k, width)
            found = table.max(axis=1)
            if len(more := np.flatnonzero(found > best[:k])):
                best[more], at_row[more], to_row[more] = found[more], i + 1, np.argmax(table[more], axis=1)
            runs, following = following, runs
        hit = best > 0
        own = rows[hit]
        size[own] = best[hit]
        at[own] += at_row[hit] - size[own]
        to[own] += to_row[hit] - size[own]
    return at, to, size


def popular(b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """difflib's automatic junk: letters that make up over a hundredth of a text of at least 200."""
    out = np.zeros(len(b), bool)
    for low, high in zip(ends[:-1], ends[1:]):
        if high - low >= 200:
            _, which, counts = np.unique(b[low:high], return_inverse=True, return_counts=True)
            out[low:high] = counts[which] > (high - low) // 100 + 1
    return out


def ratios(a: Sequence[str], b: Sequence[str], least: np.ndarray | float = 0.0, autojunk: bool = False) -> np.ndarray:
    """SequenceMatcher(None, x, y, autojunk).ratio() of each pair; 0 where it is below `least`.

    The spans that are left of all pairs are searched together, a level at a time; a pair whose letters left can't
    bring it to `least` is given up.
    """
    (a_codes, a_ends), (b_codes, b_ends) = joined(a), joined(b)
    least, total = np.broadcast_to(np.asarray(least, float), len(a)), np.diff(a_ends) + np.diff(b_ends)
    longer = max([0, *np.diff(a_ends).tolist(), *np.diff(b_ends).tolist()])
    kind = np.uint16 if max(longer, a_codes.max(initial=0), b_codes.max(initial=0)) < 65_000 else np.uint32
    # Letters are one up, and a's pads are 0 and b's pads a letter that no text has.
    a_codes, b_codes = a_codes.astype(kind) + kind(1), b_codes.astype(kind) + kind(1)
    common = popular(b_codes, b_ends) if autojunk else np.zeros(0, bool)
    searched = np.where(common, kind(np.iinfo(kind).max), b_codes) if common.any() else b_codes
    matched = np.zeros(len(a), np.int64)
    of, spans = np.arange(len(a)), np.stack([a_ends[:-1], a_ends[1:], b_ends[:-1], b_ends[1:]])
    reach = lambda left: np.where(total > 0, 2.0 * (matched + left) / np.maximum(total, 1), 1.0)
    while len(of):
        some = (spans[1] > spans[0]) & (spans[3] > spans[2])
        of, spans = of[some], spans[:, some]
        left = np.bincount(of, bounds(a_codes, b_codes, spans), len(a)).astype(np.int64)
        live = (reach(left) >= least)[of]
        of, spans = of[live], spans[:, live]
        at, to, size = longest(a_codes, searched, spans)
        if common.any():
            low_a, high_a, low_b, high_b = spans
            last_a, last_b = len(a_codes) - 1, len(b_codes) - 1
            while (back := (at > low_a) & (to > low_b) & (a_codes[np.maximum(at - 1, 0)] == b_codes[np.maximum(to - 1, 0)])).any():
                at, to, size = at - back, to - back, size + back
            while (on := (at + size < high_a) & (to + size < high_b) & (a_codes[np.minimum(at + size, last_a)] == b_codes[np.minimum(to + size, last_b)])).any():
                size = size + on
        hit = size > 0
        of, spans, at, to, size = of[hit], spans[:, hit], at[hit], to[hit], size[hit]
        np.add.at(matched, of, size)
        spans = np.concatenate([np.stack([spans[0], at, spans[2], to]), np.stack([at + size, spans[1], to + size, spans[3]])], axis=1)
        of = np.concatenate([of, of])
    out = reach(0)
    return np.where(out >= least, out, 0.0)
