"""Whole batches of texts as numpy arrays: bytes, words, lines and rolling fingerprints, without a loop over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes (a longer text makes a piece of its own).
CHUNK = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = _U(0xD6E8FEB86659FD93 | 1)
_PRIME = 2**31 - 1
_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, _PRIME, (2, 256), dtype=_U)
_BASE = _rng.integers(1 << 20, _PRIME, 2).tolist()
#: Powers that a worker keeps of each base; texts beyond that have theirs computed anew.
KEPT = 1 << 22
_factors = {x: np.ones(1, np.uint32) for base in _BASE for x in (base, pow(base, -1, _PRIME))}


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most limit bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = as_bytes(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def frees(run: Callable) -> Callable:
    """run, a function of batches, whose task gives back at its end what Arrow's pool keeps; the worker lives on without."""

    @wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return own


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the n + 1 places where they begin and end. Null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _folded(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, but for at most a few more than that."""
    x = (x & _U(_PRIME)) + (x >> _U(31))
    return (x & _U(_PRIME)) + (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**31 - 1; at least n of them."""
    p = _factors[base]
    while len(p) < n:
        p = np.concatenate((p, (p * _U(pow(base, len(p), _PRIME)) % _U(_PRIME)).astype(np.uint32)))
    if len(p) <= KEPT:
        _factors[base] = p
    return p


class Prints:
    """Fingerprints of any range of the bytes, or of a sequence of 64-bit prints, from running sums of two polynomials
    modulo 2**31 - 1. (One modulo 2**64 would give some very regular texts equal prints, whatever its base.)"""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for k, base in enumerate(_BASE):
            own = _BYTE[k][data] if data.dtype == np.uint8 else data >> _U(33 * k) & _U(_PRIME)
            s = np.zeros(len(data) + 1, _U)
            own = own * _powers(base, len(data))[: len(data)]
            np.cumsum((own & _U(_PRIME)) + (own >> _U(31)), out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (end - start).astype(_U) * _U(0x2545F4914F6CDD1D)
        for s, base in zip(self.sums, _BASE):
            h = _folded(_folded(s[end] - s[start]) * _powers(pow(base, -1, _PRIME), len(s))[start])
            out = (out << _U(31)) + np.where(h >= _U(_PRIME), h - _U(_PRIME), h)
        return mix64(out)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    out = np.empty(max(len(data) - 7, 0), _U)
    for k in range(min(8, len(out))):
        n = (len(data) - k) // 8
        out[k::8] = data[k : k + 8 * n].view("<u8")
    return out


def counts(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True flags in each range."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[end] - c[start]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross texts: start, end, index of the text."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't ASCII white space."""
    return runs(~_SPACE[data], offs)


def grams(word_hash: np.ndarray, word_doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n successive words of a text, and the index of its first word."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.zeros(m, _U)
    step = _U(1)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += word_hash[k : k + m] * step
            step = _U(int(step) * int(_STEP) % 2**64)
    first = np.flatnonzero(word_doc[:m] == word_doc[n - 1 :])
    return mix64(total[first]), first


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts between newlines: start, end, index of the text. A last part without bytes isn't given."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offs[:-1], breaks + 1)))
    start = start[start < len(data)]
    doc = np.searchsorted(offs, start, "right") - 1
    following = np.concatenate((breaks, [len(data)]))[np.searchsorted(breaks, start)]
    return start, np.minimum(following, offs[doc + 1]), doc


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether an earlier one is."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, again


def in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different for each text."""
    return mix64(hashes ^ mix64(doc.astype(_U) + _U(1)))
