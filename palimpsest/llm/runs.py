"""Runs of a sequence: its maximal repetitions, by the algorithm of Kolpakov and Kucherov.

A run is a stretch of smallest period q and at least twice that long that can't be extended on either side without breaking the period.

1. A suffix automaton, which knows where each of its states' strings ends first, cuts the sequence into factors from left to right: the
   longest strings that begin at an earlier place too (which may overlap), or one letter that is new.
2. Runs that cross or touch the border of two factors are found by Main's algorithm, from common prefixes and suffixes of what lies
   around the border: a run that ends in a factor begins less than twice the factor before and once the factor itself to the left.
3. Runs that lie strictly within a factor have been found in its earlier occurrence, and are copied from there.

Only runs of at least `least` letters are looked for; borders with fewer letters around them hold none.
"""

from __future__ import annotations

from collections.abc import Sequence


class Automaton:
    """The suffix automaton of a sequence of integers: states by number, 0 the root."""

    def __init__(self, word: Sequence[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, self.first_end = [-1], [0], [-1]
        step, last = self.next, 0
        for at, x in enumerate(word):
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            self.first_end.append(at)
            p = last
            while p >= 0 and x not in step[p]:
                step[p][x] = new
                p = link[p]
            if p < 0:
                link.append(0)
            else:
                q = step[p][x]
                if length[p] + 1 == length[q]:
                    link.append(q)
                else:  # part q: its shorter strings end at this place too
                    half = len(step)
                    link.append(half)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    self.first_end.append(self.first_end[q])
                    link.append(link[q])
                    link[q] = half
                    while p >= 0 and step[p].get(x) == q:
                        step[p][x] = half
                        p = link[p]
            last = new


def factorise(word: Sequence[int]) -> list[tuple[int, int, int]]:
    """(first, end, earlier first) of the factors of a sequence; earlier is -1 for a new letter."""
    known = Automaton(word)
    step, first_end, out, at, n = known.next, known.first_end, [], 0, len(word)
    while at < n:
        state, end = 0, at
        while end < n:
            to = step[state][word[end]]
            if first_end[to] >= end:
                break
            state, end = to, end + 1
        out.append((at, end, first_end[state] - (end - at) + 1) if end > at else (at, at + 1, -1))
        at = max(end, at + 1)
    return out


def prefixes(x: Sequence[int]) -> list[int]:
    """For each place, how many letters from there on agree with the beginning."""
    n = len(x)
    out = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(out[i - lo], hi - i) if i < hi else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        out[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    if n:
        out[0] = n
    return out


def _at_border(word: list[int], low: int, border: int, end: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Put runs that hold or touch a border, with letters from low to before end, in found: their smallest period by (first, end)."""
    t, u = word[low:border], word[border:end]
    nt, nu, n = len(t), len(u), len(word)
    back, apart = t[::-1], [-1]  # no letter is negative
    both = word[low:end]
    right = prefixes(u)  # of u with itself, further right
    left = prefixes(back + apart + both[::-1])  # of what ends before a place with what ends before the border
    ahead = prefixes(u + apart + both)  # of what begins at a place with what begins at the border
    for p in range(1, max(nt, nu) + 1):
        for first, last in (
            # the period to the right of the border, and to its left
            (border - left[nt + 1 + nu - p], border + p + (right[p] if p < nu else 0)) if p <= nu else (0, 0),
            (border - p - (left[p] if p < nt else 0), border + ahead[nu + 1 + nt - p]) if p <= nt else (0, 0),
        ):
            if last - first >= max(2 * p, least) and (first, last) not in found:
                if not (first and word[first - 1] == word[first - 1 + p]) and not (last < n and word[last] == word[last - p]):
                    found[first, last] = p


def runs(word: list[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(first, length, period) of the runs of at least `least` letters (not negative numbers), in order."""
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[tuple[int, int]]] = {}  # ends and periods of runs, by where they begin
    before = 0  # letters of the factor before
    for at, end, earlier in [*factorise(word), (len(word), len(word) + 1, -1)]:
        size, held = end - at, len(found)
        low = max(at - 2 * before - size, 0)
        if min(end, len(word)) - low >= least:
            _at_border(word, low, at, min(end, len(word)), least, found)
            for (first, last), p in list(found.items())[held:] if len(found) > held else ():
                starts.setdefault(first, []).append((last, p))
        if earlier >= 0 and size > least:
            to = at - earlier
            for first in range(earlier + 1, earlier + size - least):
                for last, p in starts.get(first, ()):
                    if last < earlier + size and (first + to, last + to) not in found:
                        found[first + to, last + to] = p
                        starts.setdefault(first + to, []).append((last + to, p))
        before = size
    return sorted((first, last - first, p) for (first, last), p in found.items())
