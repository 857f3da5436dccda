"""Signature trees: pruned joins of token sets by bitmaps and size ranges.

A set of ``n`` tokens has a bitmap of ``width(n)`` bits, one bit a token.  A
node covers some sets: the OR of their bitmaps, the range of their sizes and
the range of their class labels.  For sets x and y under nodes A and B

* tokens shared by x and y have their bits in both nodes; a set has as many
  tokens as bits but for ``extra = |x| - popcount(x)``, so that
  ``|x and y| <= popcount(A & B) + extra``;
* between two single sets, every bit of x that y lacks is a token that y
  lacks, so that also ``|x and y| <= |x| - popcount(x & ~y)``.

A pair of nodes is dropped when this greatest possible overlap is below the
one that its smallest sizes need, when the size ranges are too far apart, or
when both hold one and the same class.  Bitmaps of different widths are compared after
folding the wider one (OR of its halves).
"""

from __future__ import annotations

import numpy as np

FAN_OUT = 8


def width(n: int) -> int:
    """Bits of the bitmap of a set of ``n`` tokens: a power of two, 8n to 16n."""
    return max(64, 8 << max(n - 1, 1).bit_length())


def bitmap(tokens: np.ndarray) -> bytes:
    """The bitmap of distinct 64-bit tokens (their high bits choose the bit)."""
    bits = width(len(tokens))
    at = (tokens >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    out = np.zeros(bits, np.uint8)
    out[at] = 1
    return np.packbits(out, bitorder="little").tobytes()


def fold(words: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap of 64-bit words, or rows of them, made ``bits`` wide.  The bit
    is chosen by leading bits, so that neighbours fold together."""
    if words.shape[-1] * 64 == bits:
        return words
    wide = np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")
    wide = wide.reshape(*wide.shape[:-1], bits, -1).max(axis=-1)
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def narrow(sig: bytes) -> bytes:
    """A bitmap a quarter as wide."""
    words = np.frombuffer(sig, np.uint64)
    return fold(words, max(64, len(words) * 16)).tobytes()


def may_match(a: bytes, na: int, b: bytes, nb: int, percent: int) -> bool:
    """Whether sets of ``na`` and ``nb`` tokens may be linked, by their bitmaps."""
    if 100 * na < percent * nb or 100 * nb < percent * na:
        return False
    bits = 8 * min(len(a), len(b))
    x, y = (fold(np.frombuffer(m, np.uint64), bits) for m in (a, b))
    most = min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))
    return most >= needed(na, nb, percent)


def needed(a, b, percent: int):
    """Least overlap of sets of sizes a and b with Jaccard of ``percent`` %."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """A packed tree over sets sorted by size and first bits; level 0 holds the
    sets themselves."""

    def __init__(self, sizes: np.ndarray, maps: list[bytes], classes: np.ndarray, bits: int) -> None:
        words = np.stack([fold(np.frombuffer(m, np.uint64), bits) for m in maps])
        self.order = np.lexsort((words[:, 0], sizes))
        words, sizes, classes = words[self.order], sizes[self.order], classes[self.order]
        extra = sizes - np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        level = (words, sizes, sizes, classes, classes, extra)
        self.levels = [level]
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FAN_OUT)
            level = (np.bitwise_or.reduceat(level[0], at), *(f.reduceat(x, at) for f, x in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.maximum), level[1:])))
            self.levels.append(level)

    def raise_to(self, height: int) -> None:
        """Repeat the root so that two trees can be walked level by level."""
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])


def _alive(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, percent: int, leaves: bool) -> np.ndarray:
    """Which node pairs (i of a, j of b) may hold a pair of linked sets."""
    (wa, la, ha, ka, ma, ea), (wb, lb, hb, kb, mb, eb) = a, b
    ok = (100 * ha[i] >= percent * lb[j]) & (100 * hb[j] >= percent * la[i])
    ok &= ~((ka[i] == ma[i]) & (kb[j] == mb[j]) & (ka[i] == kb[j]))
    at = np.flatnonzero(ok)
    step = max(1, (4 << 20) // wa.shape[1])
    for s in range(0, len(at), step):
        these = at[s:s + step]
        x, y = i[these], j[these]
        if leaves:
            most = np.minimum(la[x] - np.bitwise_count(wa[x] & ~wb[y]).sum(axis=1, dtype=np.int64), lb[y] - np.bitwise_count(wb[y] & ~wa[x]).sum(axis=1, dtype=np.int64))
        else:
            most = np.bitwise_count(wa[x] & wb[y]).sum(axis=1, dtype=np.int64) + np.minimum(ea[x], eb[y])
        ok[these] = most >= needed(la[x], lb[y], percent)
    return ok


def _grow(i: np.ndarray, j: np.ndarray, na: int, nb: int, same_a: bool, same_b: bool) -> tuple[np.ndarray, np.ndarray]:
    """Children pairs of node pairs."""
    kids = np.arange(FAN_OUT)
    if same_a and same_b:
        return i, j
    if same_a:
        i, j = np.repeat(i, FAN_OUT), (j[:, None] * FAN_OUT + kids).ravel()
    elif same_b:
        i, j = (i[:, None] * FAN_OUT + kids).ravel(), np.repeat(j, FAN_OUT)
    else:
        i, j = np.repeat((i[:, None] * FAN_OUT + kids).ravel(), FAN_OUT), np.tile((j[:, None] * FAN_OUT + kids), (1, FAN_OUT)).ravel()
    ok = (i < na) & (j < nb)
    return i[ok], j[ok]


def dual_traversal(a: Tree, b: Tree | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows of a, rows of b) that no bound excludes; ``b`` None joins
    ``a`` with itself, each pair once."""
    self_join = b is None
    b = b or a
    height = max(len(a.levels), len(b.levels))
    a.raise_to(height)
    b.raise_to(height)
    i = j = np.zeros(1, np.int64)
    for depth in range(height - 1, -1, -1):
        la, lb = a.levels[depth], b.levels[depth]
        if depth < height - 1:
            i, j = _grow(i, j, len(la[0]), len(lb[0]), la is a.levels[depth + 1], lb is b.levels[depth + 1])
        if self_join:
            ok = i < j if depth == 0 else i <= j
            i, j = i[ok], j[ok]
        ok = _alive(la, lb, i, j, percent, depth == 0)
        i, j = i[ok], j[ok]
        if not len(i):
            break
    return a.order[i], b.order[j]
