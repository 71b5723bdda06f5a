"""Banded alignment of two sequences by bit vectors."""

from __future__ import annotations


def banded(a: list, b: list, most: int) -> int:
    """Edit distance of a and b (insert, delete, replace at 1 each) if it is at most ``most``, else ``most + 1``.

    Only the 2 * most + 1 diagonals around the main one are computed, a column at a time as one wide integer that
    slides along the diagonal (the bit-vector recurrences of Myers and of Hyyro).
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    if not m:
        return n
    if not most:
        return int(a != b)
    most_ = min(most, n)
    width = 2 * most_ + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    get = where.get
    up, down = full & ~((1 << most_) - 1), 0  # vertical differences +1 and -1 within the window
    score, below = most_, top >> 1
    limit = 2 * most_ + m - n
    for j in range(m):
        seen = get(b[j], 0)
        match = (seen >> (j - most_) if j > most_ else seen << (most_ - j)) & full
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        if j < n - most_:  # the window's last row is on the lowest diagonal
            score += not diagonal & top
        else:  # the last row of all, from here on
            score += bool(right & below) - bool(left & below)
            below >>= 1
        if score > limit + most_:
            return most + 1
        shifted = diagonal >> 1
        up = (left | ~(shifted | right)) & full
        down = shifted & right
    return score if score <= most_ else most + 1


def distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance if at most ``most``, else None: equal ends are cut off, then ever wider bands are tried."""
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    end -= k
    e = 0
    while e < end and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    if not a or not b:
        return d if (d := len(a) + len(b)) <= most else None
    band = min(most, 8)
    while True:
        if (d := banded(a, b, band)) <= band:
            return d
        if band >= most:
            return None
        band = min(most, band * 6)


def best_ends(pattern, text, most: int) -> tuple[int, int] | None:
    """(distance, end) of the closest stretch of ``text`` to the whole pattern, the first of equals; None beyond ``most``.

    Bit vectors over the pattern, a text unit at a time; the stretch may begin anywhere at no cost.
    """
    m = len(pattern)
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    get, full, top = where.get, (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (most + 1, 0)
    for j, x in enumerate(text):
        match = get(x, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        score += bool(right & top) - bool(left & top)
        if score < best[0]:
            best = score, j + 1
        right <<= 1
        up = (left << 1 | ~(diagonal | right)) & full
        down = diagonal & right & full
    return best if best[0] <= most else None
