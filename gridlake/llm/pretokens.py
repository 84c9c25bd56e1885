"""Splitting text into pre-tokens as arrays, and numbering the distinct ones of a run of documents.

The split is the usual byte-level one, PATTERN: contractions, then letters, digits or other signs with at most one
space before them, then white space. It is worked out for all texts of a run at once from the classes of their code points.
"""

from __future__ import annotations

import numpy as np
import regex

from .common import distinct_spans

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASS: list[np.ndarray] = []


def code_classes() -> np.ndarray:
    """The class of every code point."""
    if not _CLASS:
        out = np.full(0x110000, OTHER, np.uint8)
        kinds = [(kind, regex.compile(want)) for kind, want in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}"))]
        for block in range(0, 0x110000, 0x800):
            if 0xD800 <= block < 0xE000:
                continue  # no characters of their own
            text = "".join(map(chr, range(block, block + 0x800)))
            for kind, want in kinds:
                found = "".join(want.findall(text))
                out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _CLASS.append(out)
    return _CLASS[0]


def split(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each pre-token of the rows' UTF-8 text, and its row. Pre-tokens follow each other without gaps."""
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, none
    code = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((flat & 0xC0) != 0x80)
    n = len(code)
    kind = code_classes()[code]
    opens = np.zeros(n + 1, bool)  # whether a row begins at this character
    opens[np.searchsorted(lead, offsets[:-1])] = True
    opens[n] = True
    start = opens[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white-space character before something else: a token's head if it is a space, else a token
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~opens[1:n])
    start[last] = True
    start[last[code[last] == 32] + 1] = False
    quote = np.flatnonzero((code == 39) & start)
    if len(quote):
        padded = np.append(code, np.zeros(3, np.uint32))
        shut = np.append(opens, np.ones(3, bool))
        one, two = padded[quote + 1], padded[quote + 2]
        in1, in2 = ~shut[quote + 1], ~shut[quote + 1] & ~shut[quote + 2]
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        long = in2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            at = quote[which]
            start[at + 1] = False
            end = at + size
            start[end[end < n]] = True
    first = lead[start]
    return first, np.searchsorted(offsets, first, side="right") - 1


def numbered(flat: np.ndarray, offsets: np.ndarray, seen: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each pre-token, and how many each row has. New ones join `seen`."""
    first, rows = split(flat, offsets)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    if not len(first):
        return first, counts
    ends = np.append(first[1:], len(flat))
    one, which = distinct_spans(flat, first, ends)
    raw, number = flat.tobytes(), seen.setdefault
    numbers = [number(raw[a:b], len(seen)) for a, b in zip(first[one].tolist(), ends[one].tolist())]
    return np.array(numbers, np.int64)[which], counts
