"""Byte-level BPE: a vectorised pre-tokeniser, exact prefix counts by dynamic programming, and cached encoding.

The library splits a text into pieces and encodes each by itself, so whatever is known of a piece holds wherever it stands. Pieces are
found and looked up for many texts at a time with numpy, from their bytes. The class of each character is asked from the library
when it first comes up. Texts with an added token inside go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from kinmesh.llm.bytesvec import groups, text_bytes

LETTER, NUMBER, OTHER, SPACE, END, UNKNOWN = 1, 2, 3, 0, 5, 255
GROUP_BYTES = 1 << 20
#: Pieces a worker remembers; beyond that it starts anew, so that memory stays bounded. About 60 bytes each.
CACHE = 1_000_000
#: Bytes that a piece's code holds exactly; longer pieces are looked up one by one.
EXACT = 16
#: Texts with every rule of the pattern, on which a worker compares its pieces with the library's before it starts.
PROBES = ("It's we'll  two\n\n 12ab 'tis\t\t x!? ''s they've", " \u00a0\u2003x\u00e9\u4e2d 7\u00b2 \u0301a", "")


class Splitter:
    """Pieces by the pattern of byte-level vocabularies; refuses a tokenizer that splits otherwise."""

    def __init__(self, tokenizer) -> None:
        self.pre = tokenizer.pre_tokenizer
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._ask(np.arange(128))
        for probe in PROBES:
            data, offsets = text_bytes(pa.array([probe]))
            starts, ends, _ = self.split(data, offsets, 0, 1)
            raw = probe.encode()
            mine = [raw[i:j].decode("utf-8", "replace") for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            if tokenizer.normalizer is not None or mine != [probe[i:j] for _, (i, j) in (self.pre.pre_tokenize_str(probe) if probe else [])]:
                raise ValueError("this tokenizer doesn't split texts as byte-level vocabularies do")

    def _ask(self, characters: np.ndarray) -> None:
        whole = lambda text: len(self.pre.pre_tokenize_str(text)) == 1
        for cp in characters.tolist():
            ch = chr(cp)
            self.table[cp] = LETTER if whole("a" + ch) else NUMBER if whole("1" + ch) else OTHER if whole("!" + ch) else SPACE

    def classes(self, characters: np.ndarray) -> np.ndarray:
        kind = self.table[characters]
        if (unknown := kind == UNKNOWN).any():
            self._ask(np.unique(characters[unknown]))
            kind = self.table[characters]
        return kind

    def is_white(self, text: str) -> bool:
        return bool((self.classes(np.frombuffer(text.encode("utf-32-le"), np.uint32)) == SPACE).all())

    def split(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of texts low..high, in bytes from the first text's start, and where the pieces of each text begin (and the end)."""
        b = data[offsets[low] : offsets[high]]
        at, n = offsets[low : high + 1] - offsets[low], len(b)
        if not n:
            self.kind = np.empty(0, np.uint8)
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(high - low + 1, np.int64)
        kind = self.table[b]
        wide: list[tuple[np.ndarray, int]] = []
        leads = np.flatnonzero(b >= 0xC0)
        if len(leads):
            lead = b[leads]
            for size, part in ((2, lead < 0xE0), (3, (lead >= 0xE0) & (lead < 0xF0)), (4, lead >= 0xF0)):
                where = leads[part]
                if len(where):
                    cp = (b[where] & (0xFF >> (size + 1))).astype(np.int64)
                    for k in range(1, size):
                        cp = cp << 6 | (b[where + k] & 0x3F)
                    found = self.classes(cp)
                    for k in range(size):
                        kind[where + k] = found
                    wide.append((where[found == SPACE], size))
        edge = np.unique(at[:-1][at[:-1] < n])
        last = np.append(edge[1:], n) - 1
        before = np.empty(n, np.uint8)
        before[1:] = kind[:-1]
        before[edge] = END
        after = np.empty(n, np.uint8)
        after[:-1] = kind[1:]
        after[last] = END
        blank_before = np.zeros(n, bool)
        blank_before[1:] = b[:-1] == 32
        blank_before[edge] = False
        white = kind == SPACE
        # A change of class starts a piece, unless one blank stands before it and goes with it. Of a run of
        # white space that text follows, the last character stands apart.
        start = (kind != before) & ~(blank_before & ~white)
        start |= white & (before == SPACE) & (after != SPACE) & (after != END)
        for where, size in wide:
            tail = where + size - 1
            start[where] |= start[tail]
            start[tail] = False
        quote = np.flatnonzero((b == 39) & start)
        if len(quote):
            room = last[np.searchsorted(edge, quote, "right") - 1] - quote
            one, two = b[np.minimum(quote + 1, n - 1)], b[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8)) & (room >= 1)
            long = (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (room >= 2)
            for q, size in ((quote[short], 2), (quote[long], 3)):
                start[q + 1] = False
                start[(q + size)[q + size < n]] = True
        starts = np.flatnonzero(start)
        self.kind = kind
        return starts, np.append(starts[1:], n), np.searchsorted(starts, at)

    def white_at(self, places: np.ndarray) -> np.ndarray:
        """Whether the bytes at places, of the texts split last, are white space."""
        return self.kind[places] == SPACE

    def with_added(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> set[int]:
        """Numbers (from low) of the texts that hold an added token's string."""
        hard: set[int] = set()
        for content in self.added:
            raw, want = data[offsets[low] : offsets[high]].tobytes(), content.encode()
            at = raw.find(want)
            while at >= 0:
                d = int(np.searchsorted(offsets[low : high + 1] - offsets[low], at, "right")) - 1
                if at + len(want) <= offsets[low + d + 1] - offsets[low]:
                    hard.add(d)
                at = raw.find(want, at + 1)
        return hard


class Memory:
    """Numbers of pieces, from 0, by their bytes: those of up to EXACT bytes in an open-addressed table of exact codes, longer ones in a dict."""

    def __init__(self) -> None:
        self.bits = (4 * CACHE - 1).bit_length() - 1
        self.clear()

    def clear(self) -> None:
        self.n = 0
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.codes = np.zeros((CACHE, 2), np.uint64)
        self.sizes = np.zeros(CACHE, np.uint8)
        self.long: dict[bytes, int] = {}

    @staticmethod
    def coded(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([b, np.zeros(EXACT + 8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        masks = np.array([0, *(full >> np.uint64(64 - 8 * k) for k in range(1, 9))], np.uint64)
        return eight[starts] & masks[np.minimum(sizes, 8)], np.where(sizes > 8, eight[np.minimum(starts + 8, len(eight) - 1)], np.uint64(0)) & masks[np.clip(sizes - 8, 0, 8)]

    @staticmethod
    def _mixed(k1: np.ndarray, k2: np.ndarray, size: np.ndarray) -> np.ndarray:
        x = (k1 ^ (k2 * np.uint64(0xD6E8FEB86659FD93)) ^ (size.astype(np.uint64) << np.uint64(57))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def _home(self, *key: np.ndarray) -> np.ndarray:
        return (self._mixed(*key) >> np.uint64(64 - self.bits)).astype(np.int64)

    def numbers(self, k1: np.ndarray, k2: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each short piece; -1 of one not remembered."""
        at = self._home(k1, k2, size)
        found = self.slots[at]
        same = (self.codes[found, 0] == k1) & (self.codes[found, 1] == k2) & (self.sizes[found] == size)
        open_ = np.flatnonzero((found >= 0) & ~same)
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            got = self.slots[at[open_]]
            found[open_] = got
            same = (self.codes[got, 0] == k1[open_]) & (self.codes[got, 1] == k2[open_]) & (self.sizes[got] == size[open_])
            open_ = open_[(got >= 0) & ~same]
        return found

    def add(self, k1: np.ndarray, k2: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of short pieces that are distinct and not remembered."""
        number = np.arange(self.n, self.n + len(k1), dtype=np.int32)
        self.n += len(k1)
        self.codes[number, 0], self.codes[number, 1], self.sizes[number] = k1, k2, size
        at, open_ = self._home(k1, k2, size), np.arange(len(k1))
        while len(open_):
            free = self.slots[at[open_]] < 0
            self.slots[at[open_[free]]] = number[open_[free]]
            open_ = open_[self.slots[at[open_]] != number[open_]]
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return number

    def look(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, learn: Callable[[np.ndarray, list[bytes], np.ndarray], None]) -> np.ndarray:
        """Numbers of all pieces, CACHE at most; learn is told places, bytes and numbers of those that are new. Starts anew when full."""
        size = ends - starts
        long = np.flatnonzero(size > EXACT)
        k1, k2 = self.coded(b, starts, np.minimum(size, EXACT))
        narrow = np.minimum(size, EXACT + 1).astype(np.uint8)
        out = self.numbers(k1, k2, narrow)
        tall = _pieces(b, starts[long], ends[long])
        new = {p: i for p, i in zip(tall, long.tolist(), strict=True) if p not in self.long}
        missing = np.flatnonzero((out < 0) & (size <= EXACT))
        while len(missing) or new:
            # Different pieces with the same code are left for another round.
            fresh = missing[np.unique(self._mixed(k1[missing], k2[missing], narrow[missing]), return_index=True)[1]]
            if self.n + len(fresh) + len(new) > CACHE:
                self.clear()
                return self.look(b, starts, ends, learn)
            numbers = np.concatenate([self.add(k1[fresh], k2[fresh], narrow[fresh]), np.arange(self.n, self.n + len(new), dtype=np.int32)])
            self.n = int(numbers[-1]) + 1
            self.long.update(zip(new, numbers[len(fresh) :].tolist(), strict=True))
            at = np.concatenate([fresh, np.fromiter(new.values(), np.int64, len(new))])
            learn(at, _pieces(b, starts[at], ends[at]), numbers)
            out[missing] = self.numbers(k1[missing], k2[missing], narrow[missing])
            missing, new = missing[out[missing] < 0], {}
        if len(long):
            out[long] = [self.long[p] for p in tall]
        return out


class PrefixCounter:
    """Exact number of BPE tokens of every prefix of a piece.

    Of each prefix only its last token is kept: the one token t for which the encoding of the prefix before t
    ends in a token that t can follow. So the count of a prefix is that of a shorter prefix plus one.
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.rank: dict[bytes, int] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            if a + b not in self.rank:
                self.rank[a + b], self.parts[a + b] = i, (a, b)
        self.pair = {(a, b): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = set(vocab)
        self.longest = max(map(len, vocab))
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.piece, self.counts, self.last = b"", [0], [b""]

    def can_follow(self, left: bytes, right: bytes) -> bool:
        """Whether encoding left + right gives these two tokens: no merge across the seam comes before those that made them."""
        known = self.follows.get((left, right))
        if known is None:
            known = self._seam_holds(left, right)
            if len(self.follows) > CACHE:
                self.follows.clear()
            self.follows[left, right] = known
        return known

    def _seam_holds(self, left: bytes, right: bytes) -> bool:
        rank, parts, pair = self.rank, self.parts, self.pair
        none = len(rank) + 1
        bound = none
        while True:
            # Undo, latest first, the merges beside the seam; a merge of the two sides must not be due before the one undone last.
            seam = pair.get((left, right), none)
            if seam < bound:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                # On the left, merges of the same rank come first as they stand further left.
                bound, left = a, parts[left][1]
            else:
                bound, right = b + 1, parts[right][0]

    def prefixes(self, piece: bytes) -> list[int]:
        """Counts of piece[:0], piece[:1], ... ; what the last piece asked for began with is not worked out again."""
        same = len(os.path.commonprefix((self.piece, piece)))
        counts, last, tokens = self.counts[: same + 1], self.last[: same + 1], self.tokens
        for end in range(same + 1, len(piece) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = piece[begin:end]
                if token in tokens and (not begin or self.can_follow(last[begin], token)):
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.piece, self.counts, self.last = piece, counts, last
        return counts


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies, by the published rule: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def prefix_counter(path: str) -> PrefixCounter:
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    alphabet = byte_alphabet()
    raw = lambda s: bytes(alphabet[c] for c in s)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = {raw(t): i for t, i in model["vocab"].items() if all(c in alphabet for c in t)}
    return PrefixCounter(vocab, [(raw(a), raw(b)) for a, b in merges])


_made: dict[tuple[str, str], object] = {}


def once(kind: str, path: str, make: Callable[[str], object]):
    """One object a worker process."""
    if (kind, path) not in _made:
        _made[kind, path] = make(path)
    return _made[kind, path]


def text_groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES; a text beyond that is cut by nobody and stands alone."""
    return groups(offsets, GROUP_BYTES)


def slices(n: int) -> Iterator[slice]:
    """Pieces are looked up in runs of CACHE: however many distinct ones a text has, those of a run can be remembered together."""
    return (slice(a, a + CACHE) for a in range(0, n, CACHE))


def _column(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


def _pieces(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = b.tobytes() if len(starts) else b""
    return [raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]


class Counter:
    """Prefix token counts of texts, at every piece's end and inside pieces."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.splitter = Splitter(self.tokenizer)
        self.dp = prefix_counter(path)
        self.memory, self.counts = Memory(), np.zeros(CACHE, np.int32)

    def _learn(self, at: np.ndarray, pieces: list[bytes], numbers: np.ndarray) -> None:
        prefixes = self.dp.prefixes
        for piece, number in sorted(zip(pieces, numbers.tolist(), strict=True)):
            self.counts[number] = prefixes(piece)[-1]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def totals(self, texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
        return self.totals_of(*_column(texts), 0, len(texts), limit)

    def totals_of(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text low..high, and the largest number of its leading characters that take at most limit tokens."""
        b, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        starts, ends, firsts = self.splitter.split(data, offsets, low, high)
        counts = [self.counts[self.memory.look(b, starts[s], ends[s], self._learn)] for s in slices(len(starts))]
        running = np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)]) if counts else np.zeros(1, np.int64)
        total = running[firsts[1:]] - running[firsts[:-1]]
        chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        fits = chars[at[1:]] - chars[at[:-1]]
        hard = self.splitter.with_added(data, offsets, low, high)
        for d in np.flatnonzero(total > limit).tolist():
            if d not in hard:
                first, stop = int(firsts[d]), int(firsts[d + 1])
                over = first + int(np.searchsorted(running[first + 1 : stop + 1] - running[first], limit, "right"))
                # Counts inside the piece that passes the limit, from the last piece before it that isn't white space.
                near = max(first, over - 1)
                while near > first and self.splitter.is_white(b[starts[near] : ends[near]].tobytes().decode()):
                    near -= 1
                local = self.prefix_counts(b[starts[near] : ends[over]].tobytes().decode())
                most = max(i for i, n in enumerate(local) if n + running[near] - running[first] <= limit)
                fits[d] = chars[starts[near]] - chars[at[d]] + most
        for d in hard:
            counts = self.prefix_counts(b[at[d] : at[d + 1]].tobytes().decode())
            total[d], fits[d] = counts[-1], max(i for i, n in enumerate(counts) if n <= limit)
        return total, fits

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ... exactly as the library gives them. An added token's string counts as ordinary text until it is complete."""
        out, at, done = [0], 0, 0
        while True:
            ahead = [(i, -len(t), t) for t in self.splitter.added if (i := text.find(t, at)) >= 0]
            stop, _, token = min(ahead) if ahead else (len(text), 0, "")
            part = self._plain(text[at : stop + max(0, len(token) - 1)])
            out += [done + n for n in part[1:]]
            if not token:
                return out
            done += part[stop - at] + 1
            out.append(done)
            at = stop + len(token)

    def _plain(self, text: str) -> list[int]:
        """prefix_counts of a text without added tokens, by running counts and the table of each piece."""
        data, offsets = _column([text])
        starts, ends, _ = self.splitter.split(data, offsets, 0, 1)
        out, done, at, white = [0], 0, 0, None
        prefixes, is_white = self.dp.prefixes, self.splitter.is_white
        for raw in _pieces(data, starts, ends):
            piece, n = raw.decode(), 0
            for k in range(1, len(piece) + 1):
                stop = at + k
                if is_white(text[stop - 1]):
                    if white is None or white[1] != stop - 1:
                        white = (stop - 1, stop - 1)
                    white = (white[0], stop)
                    # A prefix that ends in white space has all of the run as its last piece.
                    n = out[white[0]] + prefixes(text[white[0] : stop].encode())[-1]
                else:
                    start = piece[:k].encode()
                    whole = piece[0] != "'" or k < 3
                    n = done + (prefixes(start)[-1] if whole else sum(prefixes(r)[-1] for r in self._split(start)))
                out.append(n)
            done += prefixes(raw)[-1]
            at += len(piece)
        return out

    def _split(self, raw: bytes) -> list[bytes]:
        data = np.frombuffer(raw, np.uint8)
        starts, ends, _ = self.splitter.split(data, np.array([0, len(raw)]), 0, 1)
        return _pieces(data, starts, ends)


class Encoder:
    """Token ids of texts from the library, each distinct piece encoded once for as long as it is remembered."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load(path)
        self.splitter = Splitter(self.tokenizer)
        self.memory = Memory()
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.size = np.zeros(CACHE, np.int64), np.zeros(CACHE, np.int32)
        (self.feed,) = self.encode_one("\n").tolist()

    def encode_one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[numbers], self.size[numbers] = self.used + begin, size
        self.used += len(ids)

    def _learn(self, at: np.ndarray, pieces: list[bytes], numbers: np.ndarray) -> None:
        if not numbers[0]:
            self.used = 0
        # Pieces that aren't white space are encoded as the lines of one text: a line feed before any of them is a piece of its own.
        white = self.white[at]
        ids = self.encode_one((b"\n" + b"\n".join([p for p, w in zip(pieces, white.tolist(), strict=True) if not w])).decode())
        feeds = np.flatnonzero(ids == self.feed)
        solid = numbers[~white]
        self._keep(solid, ids, feeds[: len(solid)] + 1, np.diff(np.append(feeds, len(ids)))[: len(solid)] - 1)
        for number, i in zip(numbers[white].tolist(), np.flatnonzero(white).tolist(), strict=True):
            ids = self.encode_one(pieces[i].decode())
            self._keep(np.array([number]), ids, np.zeros(1, np.int64), np.array([len(ids)]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encode_of(*_column(texts), 0, len(texts))

    def _run(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive pieces, and how many each has."""
        self.white = self.splitter.white_at(ends - 1)
        number = self.memory.look(b, starts, ends, self._learn)
        sizes = self.size[number].astype(np.int64)
        stop = np.cumsum(sizes)
        flat, begin = np.empty(int(stop[-1]), np.uint32), self.begin[number]
        one = sizes == 1
        flat[stop[one] - 1] = self.ids[begin[one]]
        more = np.flatnonzero(sizes > 1)
        if len(more):
            n = sizes[more]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(stop[more] - n, n) + step] = self.ids[np.repeat(begin[more], n) + step]
        return flat, sizes

    def encode_of(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int) -> list[np.ndarray]:
        b = data[offsets[low] : offsets[high]]
        starts, ends, firsts = self.splitter.split(data, offsets, low, high)
        parts = [self._run(b, starts[s], ends[s]) for s in slices(len(starts))]
        flat = np.concatenate([ids for ids, _ in parts]) if len(parts) > 1 else parts[0][0] if parts else np.empty(0, np.uint32)
        at = np.concatenate([[0], *(sizes for _, sizes in parts)]).cumsum()[firsts]
        out = [flat[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for d in self.splitter.with_added(data, offsets, low, high):
            out[d] = self.encode_one(data[offsets[low + d] : offsets[low + d + 1]].tobytes().decode())
        return out
