"""Self-join of a binary trie of codes under a Hamming error budget, over arrays.

A trie of sorted codes needs no pointers: a node at depth d is a run of codes with the same first d bits, and its
children meet where bit d turns from 0 to 1. The join holds a frontier of node pairs with the bits in which they
differ so far, goes down one level for all of them at once, and prunes each pair whose differing bits exceed the
budget. A large frontier is cut into pieces that are finished one by one, which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Node pairs held at one level, and leaf pairs handed out at once.
FRONTIER, PAIRS = 1 << 18, 1 << 18
#: Nodes of so few codes are compared directly.
SMALL = 3


def _cross(la: np.ndarray, na: np.ndarray, lb: np.ndarray, nb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places (i, j) of the node pairs, each pair once, in pieces."""
    size = na * nb
    huge = size > PAIRS
    for k in np.flatnonzero(huge):  # rows of one huge pair, some at a time
        step = max(1, PAIRS // int(nb[k]))
        j = np.arange(lb[k], lb[k] + nb[k])
        for s in range(0, int(na[k]), step):
            i = np.arange(la[k] + s, la[k] + min(s + step, int(na[k])))
            i, jj = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = i < jj
            yield i[keep], jj[keep]
    la, na, lb, nb, size = (x[~huge] for x in (la, na, lb, nb, size))
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = size[at:to]
        k = np.repeat(np.arange(at, to), n)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        i, j = la[k] + place // nb[k], lb[k] + place % nb[k]
        keep = i < j
        yield i[keep], j[keep]
        at = to


def trie_self_join(codes: np.ndarray, exact: int, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i < j) of sorted uint64 codes whose first `exact` bits agree and whose first `depth` bits differ in
    `budget` bits at most. Bit 0 is the highest. Every such pair comes once."""
    n = len(codes)
    if n < 2:
        return
    mask = np.uint64(((1 << depth) - 1) << (64 - depth))
    head = codes >> np.uint64(64 - exact) if exact else np.zeros(n, dtype=np.uint64)
    cut = np.flatnonzero(np.r_[True, head[1:] != head[:-1], True])
    lo, size = cut[:-1], np.diff(cut)
    lo, size = lo[size > 1], size[size > 1]
    zeros: dict[int, np.ndarray] = {}
    stack = [(exact, lo, size, lo.copy(), size.copy(), np.zeros(len(lo), dtype=np.int8))]
    while stack:
        d, la, na, lb, nb, err = stack.pop()
        if not len(la):
            continue
        if len(la) > FRONTIER:
            half = len(la) // 2
            stack += [(d, *(x[:half] for x in (la, na, lb, nb, err))), (d, *(x[half:] for x in (la, na, lb, nb, err)))]
            continue
        done = (na <= SMALL) & (nb <= SMALL) if d < depth else np.ones(len(la), dtype=bool)
        if done.any():
            for i, j in _cross(*(x[done] for x in (la, na, lb, nb))):
                near = np.bitwise_count((codes[i] ^ codes[j]) & mask) <= budget
                yield i[near], j[near]
            la, na, lb, nb, err = (x[~done] for x in (la, na, lb, nb, err))
        if not len(la):
            continue
        if d not in zeros:
            zeros[d] = np.r_[0, np.cumsum((codes >> np.uint64(63 - d)) & np.uint64(1) == 0, dtype=np.int64)]
        z = zeros[d]
        za, zb = z[la + na] - z[la], z[lb + nb] - z[lb]
        same = la == lb
        kids = []
        for xa, sa, xb, sb, more, use in (
            (la, za, lb, zb, 0, None),
            (la + za, na - za, lb + zb, nb - zb, 0, None),
            (la, za, lb + zb, nb - zb, 1, None),
            (la + za, na - za, lb, zb, 1, ~same),
        ):
            ok = (sa > 0) & (sb > 0) & (err + more <= budget)
            if use is not None:
                ok &= use
            ok &= ~((xa == xb) & (sa == 1) & (sb == 1))
            kids.append((xa[ok], sa[ok], xb[ok], sb[ok], (err[ok] + more).astype(np.int8)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*kids, strict=True))))
