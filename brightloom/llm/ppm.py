"""Prediction by partial matching over bytes, in arrays.

Tokens are coded byte by byte after a space: a word's bytes and a space that ends it, or a newline for
the end of a text. The context is the last ORDER bytes. `text_grams` takes them from the running bytes of
whole texts, over word borders; `token_grams` not beyond the token's leading space, so that a token's code
length depends on the token alone.

A gram is a context with its next byte in one long: the nearest context byte highest, the next byte
lowest, zeros beyond the start. In sorted order, grams with equal high bytes are the nodes of the
context trie. Of a context's counts each of its symbols cedes one half to the escape (method D); symbols that
a longer context offered are excluded from the shorter ones; what no context offers is shared evenly.
"""

from __future__ import annotations

import numpy as np
import zstandard

ORDER = 5
#: Arrays of steps in between are made for so many symbols at once, however long the texts.
BLOCK = 1 << 18
SHIFT = np.uint64(8)
_START, _END_WORD, _END_TEXT = 0x20, 0x20, 0x0A
_BEFORE = bytes(ORDER - 1) + b" "
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def token_grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of all tokens in order, and where each token's begin (one entry more than tokens). The empty token is the end of a text."""
    coded = [b" " + t.encode("utf-8", "surrogatepass") + b" " if t else b" \n" for t in tokens]
    data = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    lengths = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(lengths)
    place = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    grams = data.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(data)
        before[k:] = data[:-k] if k < len(data) else data[:0]
        before[place < k] = 0
        grams |= before << np.uint64(8 * (ORDER + 1 - k))
    begin = np.concatenate([[0], np.cumsum(lengths - 1)])
    return grams[place > 0], begin


def text_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of whole texts in order, and where each text's begin (one entry more than texts)."""
    coded = [_BEFORE + (t or "").encode("utf-8", "surrogatepass").translate(_SPACES) + b" \n" for t in texts]
    data = np.frombuffer(b"".join(coded), np.uint8)
    ends = np.cumsum(np.array([len(c) for c in coded], np.int64))
    space = data == 0x20
    stay = np.ones(len(data), bool)
    stay[1:] = ~(space[1:] & space[:-1])
    data = data[stay].tobytes()
    ends -= np.searchsorted(np.flatnonzero(~stay), ends)
    lengths = np.diff(ends, prepend=0)
    starts = ends - lengths
    n = len(data) - ORDER
    # every run of eight bytes as one number, the first lowest: the context and the next byte are its low six
    runs = np.ndarray((n,), "<u8", data + bytes(8), strides=(1,))
    keep = np.ones(n, bool)
    for k in range(len(_BEFORE)):
        keep[starts[1:] - ORDER + k] = False
    begin = np.concatenate([[0], np.cumsum(lengths - len(_BEFORE))])
    grams, done = np.empty(begin[-1], np.uint64), 0
    for at in range(0, n, BLOCK):
        some = runs[at : at + BLOCK].copy()[keep[at : at + BLOCK]]
        symbols = some >> np.uint64(8 * ORDER) & np.uint64(0xFF)
        some <<= SHIFT
        some &= np.uint64((1 << 8 * (ORDER + 1)) - 256)
        some |= symbols
        grams[done : done + len(some)] = some
        done += len(some)
    return grams, begin


def packed(values: np.ndarray) -> bytes:
    """Small numbers of four bytes, compressed plane by plane."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(len(values), 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, len(planes) // 4).T).view("<u4").ravel()


def packed_in_order(values: np.ndarray) -> bytes:
    """Numbers of four bytes in ascending order, by their differences."""
    return packed(np.diff(values.astype(np.int64), prepend=0))


def unpacked_in_order(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data), dtype=np.uint32)


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order with the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
    return grams[first], np.add.reduceat(counts[order], first) if len(first) else counts


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order and how often each occurs. Puts the grams in order where they are."""
    grams.sort()
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
    return grams[first], np.diff(np.append(first, len(grams)))


def _node_counts(grams: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For grams cut to an order: the distinct (context, symbol) keys, which of them each gram is, and their counts."""
    keys = (grams >> np.uint64(8 * (ORDER - order + 1))) << SHIFT | grams & np.uint64(0xFF)
    found, which = np.unique(keys, return_inverse=True)
    return found, which, np.bincount(which, counts, len(found))


def log_probabilities(grams: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of each gram's probability. The grams hold all that the corpus has of their last two context bytes.

    counts: of each gram in training, zero for grams to be scored only; low: grams and counts of the whole
    corpus cut to order 1, for the orders 1 and 0.
    """
    levels = [_node_counts(grams, counts, k) for k in range(ORDER, 1, -1)]
    own = (grams >> np.uint64(8 * ORDER)) << SHIFT | grams & np.uint64(0xFF)
    near = np.union1d(low[0], own)  # what is only scored here counts zero
    total = np.zeros(len(near))
    total[np.searchsorted(near, low[0])] = low[1]
    levels.append((near, np.searchsorted(near, own), total))
    symbols, which = np.unique(near & np.uint64(0xFF), return_inverse=True)
    levels.append((symbols, np.searchsorted(symbols, grams & np.uint64(0xFF)), np.bincount(which, total, len(symbols))))
    result, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
    longer = None  # keys and counts of the order above
    for i, (keys, which, total) in enumerate(levels):
        order = ORDER - i
        contexts, of_key = np.unique(keys >> SHIFT, return_inverse=True)
        n, q = np.bincount(of_key, total, len(contexts)), np.bincount(of_key, total > 0, len(contexts))
        at = of_key[which]
        n_left, q_left = n[at], q[at].astype(float)
        if longer is not None:
            up_keys, up_which, up_total = longer
            up_contexts, up_of_key = np.unique(up_keys >> SHIFT, return_inverse=True)
            seen = up_total > 0
            shorter = _shortened(up_keys, order)
            here = np.searchsorted(keys, shorter[seen])
            n_out = np.bincount(up_of_key[seen], total[here], len(up_contexts))
            q_out = np.bincount(up_of_key, seen, len(up_contexts))
            n_left, q_left = n_left - n_out[up_of_key[up_which]], q_left - q_out[up_of_key[up_which]]
        own = total[which]
        offers = open_ & (n_left > 0)
        hit, miss = offers & (own > 0), offers & (own == 0)
        result[hit] += np.log10((own[hit] - 0.5) / n_left[hit])
        result[miss] += np.log10(0.5 * q_left[miss] / n_left[miss])
        open_ &= ~hit
        longer = (keys, which, total)
    rest = 256 - (int((levels[-1][2] > 0).sum()))
    result[open_] -= np.log10(max(rest, 1))
    return result


def _shortened(keys: np.ndarray, order: int) -> np.ndarray:
    """Keys of order + 1 without the context's far byte."""
    contexts = (keys >> SHIFT) >> SHIFT if order else np.zeros_like(keys)
    return contexts << SHIFT | keys & np.uint64(0xFF)
