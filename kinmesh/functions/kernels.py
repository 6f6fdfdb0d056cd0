"""String similarities that Spark lacks, from the strings alone; for Arrow passes over pairs that were already narrowed down."""

from __future__ import annotations

import re
from difflib import SequenceMatcher


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    mine, theirs = [], [False] * len(b)
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not theirs[j] and free[j] == ch:
                theirs[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    crossed = sum(x != y for x, y in zip(mine, (c for c, t in zip(b, theirs, strict=True) if t), strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - crossed) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Up to four common first characters raise a Jaro similarity above 0.7. Two empty strings are alike."""
    sim = jaro(a, b)
    if sim > 0.7:
        same = 0
        for x, y in zip(a[:4], b[:4]):  # noqa: B905
            if x != y:
                break
            same += 1
        sim += 0.1 * same * (1 - sim)
    return sim


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest one: a row of the table is a number, its bits are where the length doesn't rise."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def distance(a: str, b: str) -> int:
    """Edit distance: where a column of the table rises and falls are two numbers' bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for ch in b:
        same = where.get(ch, 0)
        across = (((same & up) + up) ^ up) | same | down
        more, less = (down | ~(across | up)) << 1 | 1, (up & across) << 1
        up, down = (less | ~(across | more)) & full, more & across & full
    return len(b) + up.bit_count() - down.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * common_subsequence(a, b) / total if total else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and not (left and right):
        return 1.0
    one, two = (" ".join(p for p in (both, s) if p) for s in (left, right))
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string and a window of the longer, windows that stick out at either end included."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(*sorted((a, b), key=len))


def _windows(short: str, long: str) -> float:
    n = len(short)
    if short in long:
        return 1.0
    here, best = set(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(0, start) : start + n]
        # A best window starts or ends with a character of the short string.
        if window[-1] in here if start <= len(long) - n else window[0] in here:
            best = max(best, ratio(short, window))
    return best


def sequence_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    return SequenceMatcher(None, a, b).ratio()


_SOUNDS = {c: d for d, letters in enumerate(("bfpv", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in letters}


def soundex(word: str) -> str:
    word = "".join(c for c in word.lower() if c.isascii() and c.isalpha())
    if not word:
        return ""
    out, last = word[0].upper(), _SOUNDS.get(word[0])
    for c in word[1:]:
        code = _SOUNDS.get(c)
        if code and code != last:
            out += str(code)
        if c not in "hw":
            last = code
    return (out + "000")[:4]


def metaphone(word: str) -> str:
    """Lawrence Philips' published rules."""
    w = re.sub(r"([^c])\1+", r"\1", "".join(c for c in word.lower() if c.isascii() and c.isalpha()))
    if not w:
        return ""
    if w[:2] in ("kn", "gn", "pn", "wr", "ae"):
        w = w[1:]
    elif w[0] == "x":
        w = "s" + w[1:]
    elif w[:2] == "wh":
        w = "w" + w[2:]
    vowels, front, out, i = "aeiou", "eiy", "", 0
    at = lambda k: w[k] if 0 <= k < len(w) else ""
    while i < len(w):
        c, n = w[i], at(i + 1)
        step = 1
        if c in vowels:
            out += c if not i else ""
        elif c == "b":
            out += "" if i == len(w) - 1 and at(i - 1) == "m" else "b"
        elif c == "c":
            if n == "h":
                out, step = out + ("k" if at(i - 1) == "s" else "x"), 2
            elif w[i : i + 3] == "cia":
                out += "x"
            elif n and n in front:
                out += "" if at(i - 1) == "s" else "s"
            else:
                out += "k"
        elif c == "d":
            if n == "g" and at(i + 2) and at(i + 2) in front:
                out, step = out + "j", 2
            else:
                out += "t"
        elif c == "g":
            if n == "h":
                if i + 2 >= len(w) or at(i + 2) in vowels:
                    out, step = out + "k", 2
                else:
                    step = 2
            elif n == "n":
                step = 2
                out += "n"
            else:
                out += "j" if n and n in front else "k"
        elif c == "h":
            out += "h" if n and n in vowels and at(i - 1) not in (*vowels, "c", "s", "p", "t", "g") else ""
        elif c == "k":
            out += "" if at(i - 1) == "c" else "k"
        elif c == "p":
            if n == "h":
                out, step = out + "f", 2
            else:
                out += "p"
        elif c == "q":
            out += "k"
        elif c == "s":
            if n == "h":
                out, step = out + "x", 2
            elif w[i : i + 3] in ("sio", "sia"):
                out += "x"
            else:
                out += "s"
        elif c == "t":
            if n == "h":
                out, step = out + "0", 2
            elif w[i : i + 3] in ("tio", "tia"):
                out += "x"
            else:
                out += "" if w[i : i + 3] == "tch" else "t"
        elif c == "v":
            out += "f"
        elif c in "wy":
            out += c if n and n in vowels else ""
        elif c == "x":
            out += "ks"
        elif c == "z":
            out += "s"
        else:
            out += c
        i += step
    return out.upper()


def nysiis(word: str) -> str:
    """Robert Taft's published rules."""
    w = "".join(c for c in word.upper() if c.isascii() and c.isalpha())
    if not w:
        return ""
    for a, b in (("MAC", "MCC"), ("KN", "NN"), ("K", "C"), ("PH", "FF"), ("PF", "FF"), ("SCH", "SSS")):
        if w.startswith(a):
            w = b + w[len(a) :]
            break
    for ends, b in ((("EE", "IE"), "Y"), (("DT", "RT", "RD", "NT", "ND"), "D")):
        if w.endswith(ends):
            w = w[:-2] + b
            break
    out, i = w[0], 1
    while i < len(w):
        c, step = w[i], 1
        if w[i : i + 2] == "EV":
            new, step = "AF", 2
        elif c in "AEIOU":
            new = "A"
        elif c == "Q":
            new = "G"
        elif c == "Z":
            new = "S"
        elif c == "M":
            new = "N"
        elif w[i : i + 2] == "KN":
            new, step = "N", 2
        elif c == "K":
            new = "C"
        elif w[i : i + 3] == "SCH":
            new, step = "SSS", 3
        elif w[i : i + 2] == "PH":
            new, step = "FF", 2
        elif c == "H" and (w[i - 1] not in "AEIOU" or (i + 1 < len(w) and w[i + 1] not in "AEIOU") or i + 1 == len(w)):
            new = "A" if w[i - 1] in "AEIOU" else w[i - 1]
        elif c == "W" and w[i - 1] in "AEIOU":
            new = "A"
        else:
            new = c
        for x in new:
            if x != out[-1]:
                out += x
        i += step
    if len(out) > 1 and out.endswith("S"):
        out = out[:-1]
    if out.endswith("AY"):
        out = out[:-2] + "Y"
    if len(out) > 1 and out.endswith("A"):
        out = out[:-1]
    return out
