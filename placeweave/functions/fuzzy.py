"""String ratios on the longest common subsequence, from 0 to 100, after their published definitions."""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate


def _places(a: str) -> dict[str, int]:
    """Where each letter stands, as bits."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _common(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where = _places(a) if where is None else where
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common length of the lengths' sum."""
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


@lru_cache(maxsize=1 << 12)
def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer, those cut off at its ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    where = _places(short)
    # Letters of the shorter text before each place of the longer.
    before = [0, *accumulate(ch in where for ch in long)]
    for start in range(1 - n, len(long)):
        first, last = max(0, start), min(start + n, len(long))
        # A window is worth comparing only where it begins or ends with a letter of the shorter text, and has more of them than the best one needs.
        if (long[last - 1] in where or long[first] in where) and 200.0 * (before[last] - before[first]) / (n + last - first) > best:
            best = max(best, 200.0 * _common(short, long[first:last], where) / (n + last - first))
            if best == 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_sets(a: str, b: str) -> tuple[str, str, str]:
    x, y = set(a.split()), set(b.split())
    return tuple(" ".join(sorted(s)) for s in (x & y, x - y, y - x))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with what only one of the texts has."""
    if not a.split() or not b.split():
        return 0.0
    both, left, right = _token_sets(a, b)
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


def partial_token_ratio(a: str, b: str) -> float:
    both, left, right = _token_sets(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right) if left and right else 0.0)


def weighted_ratio(a: str, b: str) -> float:
    """The best of plain, token and partial ratios, the latter discounted by how far the lengths differ."""
    if not a or not b:
        return 0.0
    span = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if span < 1.5:
        return max(best, 0.95 * token_sort_ratio(a, b), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if span <= 8.0 else 0.6
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * partial_token_ratio(a, b))
