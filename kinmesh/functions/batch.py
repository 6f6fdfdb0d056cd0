"""String kernels over whole lists of pairs in numpy, equal to those of `kernels`, which work on one pair.

Each distinct pair is computed once. Pairs are sorted by length and worked on in blocks of a bounded number of characters,
so memory doesn't depend on the length of the lists, only on that of the longest single pair.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np

from kinmesh.functions import kernels

#: Characters a block may hold on one side, padding included.
CELLS = 1 << 17
#: Entries of a block's table of character masks.
MASKS = 1 << 21
#: Longer strings are worked on one pair at a time, with Python's long numbers.
LONG = 256
#: Longest shorter and longer side of a pair whose windows are looked at one by one.
WINDOWED = (128, 256)
#: Windows that are looked at together.
WINDOWS = 1 << 13
#: What fills up rows; characters' codes are two more than theirs, and the two don't match.
_PAD_A, _PAD_B = 0, 1


class _Side(NamedTuple):
    """One side of a block's pairs: the distinct texts' codes, which of them each pair has, and its length."""

    codes: np.ndarray
    which: np.ndarray
    size: np.ndarray

    def rows(self) -> np.ndarray:
        return self.codes[self.which]

    def part(self, of: slice) -> _Side:
        return _Side(self.codes, self.which[of], self.size[of])

    def turned(self) -> _Side:
        """Texts turned round, what fills up their rows still behind."""
        place = np.count_nonzero(self.codes > _PAD_B, axis=1)[:, None] - 1 - np.arange(self.codes.shape[1])
        return self._replace(codes=np.take_along_axis(self.codes, np.where(place >= 0, place, np.arange(self.codes.shape[1])), axis=1))


Block = Callable[[_Side, _Side], np.ndarray]


def _side(texts: Sequence[str], chosen: np.ndarray, sizes: np.ndarray, pad: int) -> _Side:
    """chosen: the number of each pair's text; sizes: those of all texts."""
    distinct, which = np.unique(chosen, return_inverse=True)
    lengths = sizes[distinct]
    out = np.full((len(distinct), max(int(lengths.max()), 1)), pad, np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join([texts[i] for i in distinct.tolist()]).encode("utf-32-le"), np.uint32) + np.uint32(2)
    return _Side(out, which, sizes[chosen])


def _in_blocks(pairs: list[tuple[str, str]], f: Block) -> np.ndarray:
    """f's value for each pair."""
    number: dict[str, int] = {}
    chosen = np.array([(number.setdefault(a, len(number)), number.setdefault(b, len(number))) for a, b in pairs], np.int64).reshape(-1, 2)
    texts = list(number)
    length = np.array([len(t) for t in texts], np.int64)
    sizes = length[chosen]
    longest = sizes.max(axis=1, initial=1)
    order = np.lexsort((sizes[:, 0], longest))
    ascending, out, at = longest[order], np.empty(len(pairs)), 0
    while at < len(order):
        # Lengths ascend, so the block's last row decides its width.
        n = max(1, min(len(order) - at, CELLS // int(longest[order[at]])))
        # As many words of bits for all.
        n = min(n, int(np.searchsorted(ascending, -(-ascending[at] // 64) * 64, "right")) - at)
        while n > 1 and n * longest[order[at + n - 1]] > CELLS:
            n = max(1, int(CELLS // longest[order[at + n - 1]]))
        block = order[at : at + n]
        out[block] = f(_side(texts, chosen[block, 0], length, _PAD_A), _side(texts, chosen[block, 1], length, _PAD_B))
        at += n
    return out


def _once(left: Sequence[str], right: Sequence[str], f: Callable[[list[tuple[str, str]]], np.ndarray]) -> np.ndarray:
    """f over the distinct pairs, spread to all rows."""
    number: dict[tuple[str, str], int] = {}
    rows = np.fromiter((number.setdefault(p, len(number)) for p in zip(left, right, strict=True)), np.int64, len(left))
    return f(list(number))[rows] if number else np.zeros(0)


# --- Bits ------------------------------------------------------------------------------------------------------------


def _masks(a: _Side, b: _Side) -> tuple[np.ndarray, np.ndarray] | None:
    """Where each character stands in a, as bits of one or more words a text, all texts' end to end, and where in that table each character of b (by place, then
    pair) is found; None if the table of so many pairs would be too large."""
    (n, width), words = a.codes.shape, -(-a.codes.shape[1] // 64)
    seen = np.zeros(max(int(a.codes.max()), int(b.codes.max())) + 1, bool)
    seen[a.codes] = True
    letters = int(np.count_nonzero(seen)) + 1
    if len(a.which) > 1 and n * letters * words > MASKS:
        return None
    number = np.where(seen, np.cumsum(seen) - 1, letters - 1)
    ai = number[a.codes.T] + np.arange(n) * letters
    masks = np.zeros((words, n * letters), np.uint64)
    for i in range(width):
        masks[i // 64, ai[i]] |= np.uint64(1 << i % 64)
    return masks, number[b.codes.T].take(b.which, axis=1) + a.which * letters


def _halves(f: Block, a: _Side, b: _Side) -> np.ndarray:
    h = len(a.which) // 2
    return np.concatenate([f(*(_shrunk(x.part(of)) for x in (a, b))) for of in (slice(h), slice(h, None))])


def _shrunk(x: _Side) -> _Side:
    distinct, which = np.unique(x.which, return_inverse=True)
    return _Side(x.codes[distinct], which, x.size)


# --- Jaro-Winkler ----------------------------------------------------------------------------------------------------


def _jaro_winkler_block(left: _Side, right: _Side) -> np.ndarray:
    """Which characters of b are free, and in reach, are bits of one or more words a pair."""
    table = _masks(right, left)
    if table is None:
        return _halves(_jaro_winkler_block, left, right)
    a, la, b, lb = left.rows(), left.size, right.rows(), right.size
    masks, ai = table
    n, one = len(a), np.uint64(1)
    reach = np.maximum(0, np.maximum(la, lb) // 2 - 1)
    free, mine = np.full((len(masks), n), ~np.uint64(0)), np.zeros((a.shape[1], n), bool)
    # The places of b in reach of the first character; they move on by one with each.
    near = ~np.uint64(0) >> (63 - np.minimum(reach, 63)).astype(np.uint64)
    for i in range(a.shape[1]):
        if len(masks) == 1:
            if i:
                near = (near << one) | (reach >= i)
            fits = masks[0].take(ai[i])
            fits &= free[0]
            fits &= near
            np.not_equal(fits, 0, out=mine[i])
            free[0] ^= fits & np.negative(fits)
            continue
        for w in range(len(masks)):
            low, high = np.maximum(0, i - reach - 64 * w), np.minimum(63, i + reach - 64 * w)
            near = np.where((low < 64) & (high >= 0), (~np.uint64(0) >> (63 - np.maximum(high, 0)).astype(np.uint64)) & (~np.uint64(0) << np.minimum(low, 63).astype(np.uint64)), np.uint64(0))
            fits = masks[w].take(ai[i]) & free[w] & near
            if w:
                # The first free character in reach is in an earlier word.
                fits[mine[i]] = 0
            mine[i] |= fits != 0
            free[w] &= ~(fits & (~fits + one))
    place = np.arange(b.shape[1])
    theirs = (~free[place // 64].T >> (place % 64).astype(np.uint64)) & one != 0
    mine = np.ascontiguousarray(mine.T)
    m = mine.sum(axis=1)
    # Either side has m found characters of a pair, so the k-th of all belong together.
    unlike, end = np.concatenate([[0], np.cumsum(a[mine] != b[theirs])]), np.cumsum(m)
    crossed = (unlike[end] - unlike[end - m]) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = np.where(m > 0, (m / la + m / lb + (m - crossed) / m) / 3, 0.0)
    sim[(la == 0) & (lb == 0)] = 1.0
    head = min(4, a.shape[1], b.shape[1])
    same = np.cumprod(a[:, :head] == b[:, :head], axis=1).sum(axis=1)
    return np.where(sim > 0.7, sim + 0.1 * same * (1 - sim), sim)


def _apart(pairs: list[tuple[str, str]], limit: int, block: Block, single: Callable[[str, str], float]) -> np.ndarray:
    """Pairs of at most limit characters a side in blocks, others one at a time."""
    out = np.empty(len(pairs))
    short = [i for i, (a, b) in enumerate(pairs) if len(a) <= limit and len(b) <= limit]
    out[short] = _in_blocks([pairs[i] for i in short], block)
    for i in set(range(len(pairs))).difference(short):
        out[i] = single(*pairs[i])
    return out


def jaro_winkler(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    return _once(left, right, lambda pairs: _apart(pairs, LONG, _jaro_winkler_block, kernels.jaro_winkler))


# --- Longest common subsequence --------------------------------------------------------------------------------------


def _advance(row: np.ndarray, hits: Sequence[np.ndarray]) -> None:
    """One character more: a row of the table (kernels.common_subsequence) in one or more words a pair."""
    carry = np.uint64(0)
    for w, hit in enumerate(hits):
        hit &= row[w]
        if len(row) == 1:
            rest = row[w] - hit
            row[w] += hit
            row[w] |= rest
            continue
        rest, new = row[w] ^ hit, row[w] + hit
        over = new < row[w]
        new += carry
        carry = (over | (new < carry)).astype(np.uint64)
        row[w] = new | rest


def _shared_block(a: _Side, b: _Side) -> np.ndarray:
    """Padding matches nothing, so its bits stay set."""
    table = _masks(a, b)
    if table is None:
        return _halves(_shared_block, a, b)
    masks, bi = table
    row = np.full((len(masks), len(a.which)), ~np.uint64(0))
    for at in bi:
        _advance(row, [m.take(at) for m in masks])
    return np.bitwise_count(~row).sum(axis=0, dtype=np.int64)


def shared(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Length of the longest common subsequence."""
    return _apart(pairs, LONG, _shared_block, kernels.common_subsequence)


def _distance_block(a: _Side, b: _Side) -> np.ndarray:
    """Edit distance (Myers, A fast bit-vector algorithm, 1999): bits are where a column of the table rises or falls, in one or more words a pair."""
    table = _masks(a, b)
    if table is None:
        return _halves(_distance_block, a, b)
    masks, bi = table
    n, one, last = len(a.which), np.uint64(1), np.uint64(63)
    up, down = np.full((len(masks), n), ~np.uint64(0)), np.zeros((len(masks), n), np.uint64)
    least = int(b.size.min(initial=0))
    for j, at in enumerate(bi):
        # b's column after its last character stays as it is.
        over = j >= b.size if j >= least else None
        rise, fall = one, np.uint64(0)
        for w in range(len(masks)):
            same = masks[w].take(at)
            level = same | down[w]
            same |= fall
            level_across = (((same & up[w]) + up[w]) ^ up[w]) | same
            more, less = down[w] | ~(level_across | up[w]), up[w] & level_across
            next_rise, next_fall = more >> last, less >> last
            more, less = (more << one) | rise, (less << one) | fall
            new_up, new_down = less | ~(level | more), more & level
            if over is not None:
                new_up[over], new_down[over] = up[w][over], down[w][over]
            up[w], down[w], rise, fall = new_up, new_down, next_rise, next_fall
    out = b.size.copy()
    for w in range(len(masks)):
        bits = np.clip(a.size - 64 * w, 0, 64)
        inside = np.where(bits > 0, ~np.uint64(0) >> (64 - np.maximum(bits, 1)).astype(np.uint64), np.uint64(0))
        out += np.bitwise_count(up[w] & inside).astype(np.int64) - np.bitwise_count(down[w] & inside)
    return out


def edit_similarity(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """1 minus the edit distance over the longer length; two empty texts are alike, one empty is unlike."""

    def of(pairs: list[tuple[str, str]]) -> np.ndarray:
        longest = np.array([max(len(a), len(b)) for a, b in pairs])
        return np.where(longest > 0, 1.0 - _apart(pairs, LONG, _distance_block, kernels.distance) / np.maximum(longest, 1), 1.0)

    return _once(left, right, of)


def _ratios(pairs: list[tuple[str, str]]) -> np.ndarray:
    total = np.array([len(a) + len(b) for a, b in pairs])
    return np.where(total > 0, 2 * shared(pairs) / np.maximum(total, 1), 1.0)


def ratio(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    return _once(left, right, _ratios)


def token_sort(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    known = {t: " ".join(sorted(t.split())) for t in {*left, *right}}
    return ratio([known[t] for t in left], [known[t] for t in right])


def token_set(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Of the three ratios in kernels.token_set two follow from lengths, since one text begins the other; of the third's texts the common beginning is left out."""

    def of(pairs: list[tuple[str, str]]) -> np.ndarray:
        known = {t: (s := set(t.split()), sorted(s)) for t in {x for p in pairs for x in p}}
        whole = {t: " ".join(words) for t, (_, words) in known.items()}
        out = np.zeros(len(pairs))
        asked: list[tuple[str, str]] = []
        owner: list[int] = []
        heads: list[int] = []
        for i, (a, b) in enumerate(pairs):
            (x, in_a), (y, in_b) = known[a], known[b]
            if not x or not y:
                continue
            if x.isdisjoint(y):
                these, head = (whole[a], whole[b]), 0
            else:
                these = " ".join([t for t in in_a if t not in y]), " ".join([t for t in in_b if t not in x])
                if not (these[0] and these[1]):
                    out[i] = 1.0
                    continue
                head = len(whole[a]) - len(these[0])
            asked.append(these)
            owner.append(i)
            heads.append(head)
        if asked:
            # head: characters in common words and the blank behind each.
            head, (la, lb) = np.array(heads), np.array([(len(a), len(b)) for a, b in asked]).T
            best = 2 * (head + shared(asked)) / (2 * head + la + lb)
            for n in (la, lb):
                np.maximum(best, np.where(head > 0, 2 * (head - 1) / np.maximum(2 * head - 1 + n, 1), 0.0), out=best)
            out[owner] = best
        return out

    return _once(left, right, of)


# --- Best window -----------------------------------------------------------------------------------------------------


def _window_block(left: _Side, right: _Side) -> np.ndarray:
    """Best ratio of a, no longer than b, and a window of b as long as a, or sticking out at an end.

    Strands run through the table of a and b (Tiskin, Semi-local string comparison, 2008): one enters at each row and column, two
    that meet bounce where the characters match or if they have crossed before. Those that enter at column i or later and leave
    before column j are the characters of b[i:j] outside the common subsequence, so one pass answers every window.
    """
    a, la, b, lb = left.rows(), left.size, right.rows(), right.size
    n, m, width = len(a), a.shape[1], b.shape[1]
    back = a[:, ::-1]
    rows, cols = np.tile(np.arange(m, dtype=np.int32), (n, 1)), np.tile(np.arange(m, m + width, dtype=np.int32), (n, 1))
    for d in range(m + width - 1):
        first, last = max(0, d - m + 1), min(d + 1, width)
        across = slice(m - 1 - d + first, m - 1 - d + last)
        h, v = rows[:, across], cols[:, first:last]
        bounce = (back[:, across] == b[:, first:last]) | (h > v)
        rows[:, across], cols[:, first:last] = np.where(bounce, v, h), np.where(bounce, h, v)
    entered = cols - m
    place = np.arange(width)
    best = np.zeros(n)
    # Windows that stick out in front: b[:j], j shorter than a.
    heads = place + 1 - np.cumsum(entered >= 0, axis=1)
    short = (place + 1 < la[:, None]) & (place < lb[:, None])
    np.maximum(best, np.where(short, 2 * heads / (la[:, None] + place + 1), 0.0).max(axis=1), out=best)
    for i in range(width):
        end = np.minimum(lb, i + la)
        length = end - i
        outside = ((entered[:, i:] >= i) & (place[i:] < end[:, None])).sum(axis=1)
        np.maximum(best, np.where(length > 0, 2 * (length - outside) / np.maximum(la + length, 1), 0.0), out=best)
    return best


def _best_of_windows(a: _Side, b: _Side) -> np.ndarray:
    """The same for a and b within WINDOWED: two passes give all windows that begin or end where b does; of the others only
    those are compared that can have more in common than the best so far, since a window has no more than what it is part of."""
    # Turned round, the ends of b come first.
    there, back = _masks(a, b), _masks(a.turned(), b.turned())
    if there is None or back is None:
        return _halves(_best_of_windows, a, b)
    n, la, lb, counts = len(a.which), a.size, b.size, []
    best, length = np.zeros(n), np.arange(len(there[1]) + 1)[:, None]
    for masks, bi in (there, back):
        row, count = np.full((len(masks), n), ~np.uint64(0)), np.zeros((len(bi) + 1, n), np.uint8)
        for j, at in enumerate(bi):
            _advance(row, [m.take(at) for m in masks])
            np.bitwise_count(~row).sum(axis=0, dtype=np.uint8, out=count[j + 1])
        counts.append(count)
        np.maximum(best, np.where(length <= np.minimum(la, lb), 2.0 * count / (la + np.maximum(length, 1)), 0.0).max(axis=0), out=best)
    heads, tails = counts
    masks, bi = there[0], there[1].ravel()
    inner = np.maximum(lb - la - 1, 0)
    pair = np.repeat(np.arange(n), inner)
    start = np.arange(len(pair)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    most = 2 * np.minimum(heads[start + la[pair], pair], tails[lb[pair] - start, pair]).astype(np.int64) / (2 * la[pair])
    # The windows that can have most come first, one a pair.
    order = np.lexsort((-most, pair))
    pair, start, most = pair[order], start[order], most[order]
    first = np.diff(pair, prepend=-1) > 0
    for some in (first, ~first):
        for low in range(0, len(pair), WINDOWS):
            part = np.flatnonzero(some[low : low + WINDOWS]) + low
            part = part[most[part] > best[pair[part]]]
            if not len(part):
                continue
            whose, size = pair[part], la[pair[part]]
            row, at, least = np.full((len(masks), len(part)), ~np.uint64(0)), start[part] * n + whose, int(size.min())
            for j in range(int(size.max())):
                letter = bi.take(at)
                hits = [m.take(letter) for m in masks]
                if j >= least:
                    for hit in hits:
                        hit[j >= size] = 0
                _advance(row, hits)
                at += n
                if j + 1 >= least:
                    np.minimum(at, len(bi) - 1, out=at)
            np.maximum.at(best, whose, 2 * np.bitwise_count(~row).sum(axis=0, dtype=np.int64) / (2 * size))
    return best


def partial(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    def of(pairs: list[tuple[str, str]]) -> np.ndarray:
        out = np.zeros(len(pairs))
        asked: list[tuple[str, str]] = []
        owner: list[int] = []
        for i, (a, b) in enumerate(pairs):
            if not a or not b:
                out[i] = float(a == b)
                continue
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            if short in long:
                out[i] = 1.0
                continue
            these = [(short, long)] if len(a) != len(b) else [(a, b), (b, a)]
            asked += these
            owner += [i] * len(these)
        if asked:
            values = np.empty(len(asked))
            for block, chosen in ((_best_of_windows, True), (_window_block, False)):
                some = [i for i, (a, b) in enumerate(asked) if (len(a) <= WINDOWED[0] and len(b) <= WINDOWED[1]) == chosen]
                values[some] = _in_blocks([asked[i] for i in some], block)
            np.maximum.at(out, owner, values)
        return out

    return _once(left, right, of)


def each(f: Callable[[str, str], float]) -> Callable[[Sequence[str], Sequence[str]], np.ndarray]:
    """A kernel on one pair, once a distinct pair."""
    return lambda left, right: _once(left, right, lambda pairs: np.array([f(a, b) for a, b in pairs], float))
