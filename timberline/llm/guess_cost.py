"""How many guesses a password takes: the cheapest way to cut it into words, dates, repeats, walks, runs and the rest.

A dynamic program over the places of the value: the cost up to a place is the least over all pieces that end there. Words
come from a short list of common passwords and from a dictionary, such as that of a corpus; a word's rank is its cost.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

#: Common passwords and words in them, most common first: a word's place is its cost.
COMMON = (
    "password 123456 qwerty admin welcome letmein secret monkey dragon master login abc123 iloveyou sunshine princess football "
    "shadow superman michael trustno1 hello charlie user test guest root changeme default pass example sample token key "
    "access private public server database system service account client bearer value string none null true false required "
    "optional placeholder your here insert the and for with this that from have will not are was were what when where who "
    "summer winter spring autumn monday friday january february march april may june july august september october "
    "november december love baby angel soccer baseball computer internet google office company family flower orange purple "
    "yellow green black white blue red dog cat house home work school music money happy lucky magic star sun moon fire water"
).split()
_LEET = str.maketrans("4@310$5!7", "aaeiossit")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
_BRUTE = 1.15  # log10 of the guesses for a character that nothing explains
_DIGIT = 1.0  # for a digit after a digit
_SPOKEN = 0.8  # for a letter that words often have after the one before it
_PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke".split()
)


def _neighbours() -> set[tuple[str, str]]:
    at = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (x, y) in at.items() for b, (u, v) in at.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


_NEXT = _neighbours()


#: Copies of so many characters and more are looked up by a hash of that many.
_GRAM = 8


def _repeats(value: str) -> list[list[tuple[int, int]]]:
    """For each place, (width, times): the last `width` characters come again so often from there on. Short widths are all
    tried; of longer ones, at each place, the distance to where the same eight characters come next. Linear time, but for
    values that repeat at many distances."""
    n = len(value)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]

    def run(width: int, start: int, end: int) -> None:
        """value[k] == value[k + width] for k from start to end - 1."""
        if end - start >= max(width, 2):
            for e in range(start + width, end + 1):
                if (times := (end + width - e) // width) * width >= 2:
                    out[e].append((width, times))

    for width in range(1, min(_GRAM - 1, n // 2) + 1):
        start = 0
        while start + width < n:
            end = start
            while end + width < n and value[end] == value[end + width]:
                end += 1
            run(width, start, end)
            start = end + 1
    if n >= 2 * _GRAM:
        following: dict[str, int] = {}
        upto: dict[int, int] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for k in range(n - _GRAM, -1, -1):
            gram = value[k : k + _GRAM]
            if (at := following.get(gram)) is not None and (width := at - k) >= _GRAM:
                if upto.get(width, n + 1) > k:  # not yet inside a run of this width
                    start, end = k, k + _GRAM
                    while end + width < n and value[end] == value[end + width]:
                        end += 1
                    while start and value[start - 1] == value[start - 1 + width]:
                        start -= 1
                    upto[width] = start
                    spans.setdefault(width, []).append((start, end))
            following[gram] = k
        for width, found in spans.items():
            for start, end in found:
                run(width, start, end)
    return out


class Guesser:
    """Costs of values with a dictionary: words in lower case, most common first, besides COMMON. Costs of values up to 256
    characters are remembered."""

    def __init__(self, words: tuple[str, ...] | list[str] = ()):
        self.cost: dict[str, float] = {}
        for some in (COMMON, words):
            for rank, w in enumerate(some):
                c = math.log10(rank + 2)
                if c < self.cost.get(w, math.inf):
                    self.cost[w] = c
        self.longest = max(map(len, self.cost))
        self.known: dict[str, float] = {}

    def __call__(self, value: str) -> float:
        """log10 of the guesses for the cheapest segmentation of the whole value; 0 for an empty one. The time grows with
        the length, and with the square of runs like abcd, which alphabets bound."""
        if len(value) > 256:
            return self._cheapest(value)
        if value not in self.known:
            if len(self.known) >= 4096:
                self.known.clear()
            self.known[value] = self._cheapest(value)
        return self.known[value]

    def _cheapest(self, value: str) -> float:
        n, low = len(value), value.lower()
        if len(low) != n:  # a few letters grow in lower case, and places must agree
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain, keys = low.translate(_LEET), value.translate(_SHIFTED).lower()
        if len(keys) != n:
            keys = low.translate(_SHIFTED)
        best = [0.0] + [math.inf] * n
        again = _repeats(value)
        two = three = math.inf  # keyboard walks that end here: of two keys, and of three or more

        for i in range(n + 1):
            walks = i > 1 and (keys[i - 2], keys[i - 1]) in _NEXT
            two, three = (best[i - 2] + 2.35, min(two, three) + 0.35) if walks else (math.inf, math.inf)
            here = best[i] = min(best[i], three)
            if i == n:
                break

            def reach(j: int, cost: float, base: float = here) -> None:
                if base + cost < best[j]:
                    best[j] = base + cost

            reach(i + 1, _next_character(value, low, i))
            for j in range(i + 3, min(n, i + self.longest) + 1):
                if (cost := _word_cost(self.cost, value[i:j], low[i:j], plain[i:j])) is not None:
                    reach(j, cost)
            if (m := _DATE.match(value, i)) and m.end() - i >= 4:
                reach(m.end(), 2.1 if m.end() - i == 4 else 4.6)
            for width, times in again[i]:
                reach(i + width * times, _repeat_cost(width, times))
            for step in (1, -1):
                j = i + 1
                while j < n and ord(value[j]) - ord(value[j - 1]) == step:
                    j += 1
                    if j - i >= 3:
                        reach(j, 1.2 + math.log10(j - i))
        return best[n]


def _next_character(value: str, low: str, i: int) -> float:
    pair = i > 0 and value[i - 1 : i + 1]
    if pair and pair.isdigit():
        return _DIGIT
    return _SPOKEN if pair and low[i - 1 : i + 1] in _PAIRS and (pair.islower() or pair.isupper() or pair.istitle()) else _BRUTE


def _word_cost(costs: dict[str, float], written: str, low: str, plain: str) -> float | None:
    found = [c + extra for spelled, extra in ((low, 0.0), (plain, 0.3)) if (c := costs.get(spelled)) is not None]
    if not found:
        return None
    case = 0 if written.islower() or not written.isalpha() else 0.3 if written.istitle() or written.isupper() else 1.0
    return max(0.3, min(found)) + case


def _repeat_cost(width: int, times: int) -> float:
    return 0.5 + math.log10(times + 1) + math.log10(width)


@lru_cache(1)
def _plain() -> Guesser:
    return Guesser()


def guesses_log10(value: str) -> float:
    """The cost with the common words alone."""
    return _plain()(value)
