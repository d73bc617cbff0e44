"""How many guesses a password takes, in bits: the cheapest way to cut it into
dictionary words, dates, repeats, keyboard walks and brute-force characters.

The cost of a cut is the sum over its parts, found by one pass over the value
(dynamic programming from left to right):

* a word costs ``log2(all words / occurrences)``, a common password the bits of its
  place in the list, capitals what their pattern allows;
* a date costs its days within 200 years, with separators 2 bits more;
* a repeat is a unit of up to ``UNIT`` characters and as many whole copies as follow:
  the cost of the unit and the bits of the number of copies;
* a walk of three or more neighbouring keys, taken to its end, costs its first key,
  its length, and the place and direction of each turn;
* any other character costs the bits of the characters that the value draws from.
"""

from __future__ import annotations

import math
import re

import numpy as np

from kilnset.llm.words import span_hashes

#: Bytes of a dictionary word, characters of a repeat's unit.
SHORTEST, LONGEST = 3, 24
UNIT = 16

# Passwords that head every published list, most frequent first.
COMMON = (
    "password", "123456", "12345678", "qwerty", "abc123", "letmein", "monkey", "dragon", "iloveyou", "admin",
    "welcome", "login", "master", "hello", "freedom", "whatever", "trustno1", "sunshine", "princess", "football",
    "shadow", "superman", "michael", "secret", "changeme", "default", "test", "guest", "root", "passw0rd",
)
# The rows of a US keyboard, plain and shifted, each half a key to the right of the one above.
ROWS = (("`1234567890-=", "~!@#$%^&*()_+"), (" qwertyuiop[]\\", " QWERTYUIOP{}|"),
        (" asdfghjkl;'", ' ASDFGHJKL:"'), (" zxcvbnm,./", " ZXCVBNM<>?"))
KEYS = {c: (x, y, shifted) for y, row in enumerate(ROWS) for shifted, line in enumerate(row)
        for x, c in enumerate(line) if c != " "}
NEIGHBOURS = {(-1, 0): 1, (1, 0): 2, (0, -1): 3, (1, -1): 4, (-1, 1): 5, (0, 1): 6}
KEY_BITS = math.log2(47)
TURN_BITS = math.log2(4.6)

YEAR_BITS = math.log2(200)
DATE_BITS = math.log2(365 * 200)
DATE = re.compile(r"(?a)(\d{1,4})([-/._])(\d{1,2})\2(\d{1,4})(?!\d)")
DIGITS = re.compile(r"(?a)\d{4,8}")

ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to words: ASCII letters and all of other scripts."""
    low = data | 0x20
    return ((low >= 97) & (low <= 122)) | (data >= 128)


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of every possible word inside the value's runs of letters, and
    their hashes."""
    data = lowered(np.frombuffer(value.encode(), dtype=np.uint8))
    n = len(data)
    if n < SHORTEST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = letters(data)
    stops = np.append(np.flatnonzero(~inside), n)
    run_end = stops[np.searchsorted(stops, np.arange(n))]
    edge = np.append((data & 0xC0) != 0x80, True)  # not inside a character
    starts, ends = [], []
    at = np.flatnonzero(inside & edge[:n])
    for size in range(SHORTEST, LONGEST + 1):
        at = at[at + size <= run_end[at]]
        some = at[edge[at + size]]
        starts.append(some)
        ends.append(some + size)
    start, end = np.concatenate(starts), np.concatenate(ends)
    return start, end, span_hashes(data, start, end)


def _capital_bits(part: str) -> float:
    upper = sum(c.isupper() for c in part)
    lower = len(part) - upper
    if not upper:
        return 0.0
    if not lower or (upper == 1 and part[0].isupper()):
        return 1.0
    return math.log2(sum(math.comb(upper + lower, i) for i in range(1, min(upper, lower) + 1)))


def _pool_bits(value: str) -> float:
    if re.fullmatch(r"[0-9]*", value):
        return math.log2(10)
    if re.fullmatch(r"[0-9a-f]*|[0-9A-F]*", value):
        return 4.0
    kinds = (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10))
    pool = sum(size for low, high, size in kinds if any(low <= c <= high for c in value))
    if any(c < "\x80" and not c.isalnum() for c in value):
        pool += 33
    if any(c >= "\x80" for c in value):
        pool += 100
    return math.log2(pool)


def _dates(value: str, i: int):
    """Ends and costs of the dates that begin at ``i``."""
    found = DATE.match(value, i)
    if found:
        a, b, c = int(found[1]), int(found[3]), int(found[4])
        if _is_date(a, b, c, len(found[1]), len(found[4])):
            yield found.end(), DATE_BITS + 2
    found = DIGITS.match(value, i)
    if not found:
        return
    run = found[0]
    if run[:2] in ("19", "20"):
        yield i + 4, YEAR_BITS
    if len(run) >= 8 and any(_is_date(int(run[x:y]), int(run[y:z]), int(run[z:8]), y - x, 8 - z)
                             for x, y, z in ((0, 4, 6), (0, 2, 4))):
        yield i + 8, DATE_BITS
    if len(run) >= 6 and _is_date(int(run[:2]), int(run[2:4]), int(run[4:6]), 2, 2):
        yield i + 6, DATE_BITS


def _is_date(a: int, b: int, c: int, width_a: int, width_c: int) -> bool:
    """Whether (year, month, day) or (day, month, year) or (month, day, year)."""
    day_month = lambda x, y: (1 <= x <= 31 and 1 <= y <= 12) or (1 <= y <= 31 and 1 <= x <= 12)
    if width_a == 4:
        return 1900 <= a < 2100 and day_month(b, c) and width_c <= 2
    return width_a <= 2 and day_month(a, b) and (1900 <= c < 2100 if width_c == 4 else width_c == 2)


def _walks(value: str):
    """Per place: the end of the walk from there, its number of turns, and whether
    it has shifted keys."""
    n = len(value)
    step = [0] * n
    for i in range(n - 1):
        a, b = KEYS.get(value[i]), KEYS.get(value[i + 1])
        if a and b:
            step[i] = NEIGHBOURS.get((b[0] - a[0], b[1] - a[1]), 0)
    ends, turns = list(range(1, n + 1)), [0] * n
    shifted = [c in KEYS and bool(KEYS[c][2]) for c in value]
    for i in range(n - 2, -1, -1):
        if step[i]:
            ends[i] = ends[i + 1]
            turns[i] = turns[i + 1] + (step[i] != step[i + 1])
            shifted[i] = shifted[i] or shifted[i + 1]
    return ends, turns, shifted


def _cheapest(begin: int, stop: int, spans: list, char_bits: float) -> float:
    best = [math.inf] * (stop - begin + 1)
    best[0] = 0.0
    for i in range(begin, stop):
        here = best[i - begin]
        best[i - begin + 1] = min(best[i - begin + 1], here + char_bits)
        for end, bits in spans[i]:
            if end <= stop and here + bits < best[end - begin]:
                best[end - begin] = here + bits
    return best[-1]


def guess_bits(value: str, counts: dict[int, int], total: int) -> float:
    """Bits of the cheapest cut. ``counts`` has the occurrences of dictionary words by
    hash, ``total`` the number of all words. An empty value costs nothing."""
    n = len(value)
    if not n:
        return 0.0
    char_bits = _pool_bits(value)
    spans: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    start, end, keys = word_spans(value)
    known = [k for k, key in enumerate(keys.tolist()) if key in counts]
    if known:
        data = np.frombuffer(value.encode(), dtype=np.uint8)
        place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before a byte
        for k in known:
            a, b = int(place[start[k]]), int(place[end[k]])
            rare = max(0.0, math.log2(max(total, 1) / counts[int(keys[k])]))
            spans[a].append((b, rare + _capital_bits(value[a:b])))
    low = value.translate(ASCII_LOWER)
    for rank, word in enumerate(COMMON, 1):
        at = low.find(word)
        while at >= 0:
            part = value[at:at + len(word)]
            spans[at].append((at + len(word), math.log2(rank + 1) + _capital_bits(part)))
            at = low.find(word, at + 1)
    ends, turns, shifted = _walks(value)
    for i, c in enumerate(value):
        if c.isascii() and c.isdigit():
            spans[i].extend(_dates(value, i))
        if ends[i] - i >= 3:
            size = ends[i] - i
            turn = TURN_BITS + math.log2(size)
            spans[i].append((ends[i], KEY_BITS + math.log2(size) + turns[i] * turn + shifted[i]))
    repeats = []
    codes = np.frombuffer(value.encode("utf-32-le"), dtype=np.uint32)
    unit_bits: dict[str, float] = {}
    for size in range(1, min(UNIT, n // 2) + 1):
        differ = np.append(np.flatnonzero(codes[:-size] != codes[size:]), n - size)
        run = differ[np.searchsorted(differ, np.arange(n - size))] - np.arange(n - size)
        for i in np.flatnonzero(run >= size).tolist():
            copies = 1 + int(run[i]) // size
            unit = value[i:i + size]
            if unit not in unit_bits:
                unit_bits[unit] = _cheapest(i, i + size, spans, char_bits)
            repeats.append((i, i + size * copies, unit_bits[unit] + math.log2(copies)))
    for i, stop, bits in repeats:
        spans[i].append((stop, bits))
    return _cheapest(0, n, spans, char_bits)
