"""Literals that every match of a pattern must contain, and one automaton over all of them.

For a table of thousands of patterns, a line should be tried only against the patterns
whose literals it holds. ``anchors`` reads a Java pattern and returns a set of ASCII
strings at least one of which occurs, case folded, in every match, or None when no such
set is known (the pattern is then tried on every line). It is conservative: a pattern
with syntax whose meaning differs between Java and the parser used here (nested or
intersected classes, escapes of letters other than the common ones, quoting, named
groups) gets None.

``Waker`` builds one Aho-Corasick automaton over the anchors of all patterns; run over a
folded line it names the patterns that the line may match, in one pass whatever their
number.
"""

import re
import re._constants as C
import re._parser as parser

import ahocorasick

# Escapes read alike by Java and by Python's parser.
SAFE_ESCAPES = set("dDsSwWbBtnrfA.\\/-^$|?*+()[]{}'\" #:=!<>,&%@~`;_")
# Characters that Java, ignoring case, matches with an ASCII letter, and that letter.
SPECIAL_CASE = str.maketrans({"K": "k", "ſ": "s", "İ": "i", "ı": "i"})


def fold(text: str) -> str:
    """A line as the automaton reads it: the four special letters made ASCII, then lower case."""
    return text.translate(SPECIAL_CASE).lower()


def _readable(pattern: str) -> bool:
    """No syntax that Java and this parser read differently."""
    in_class, k = False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            if k + 1 >= len(pattern) or pattern[k + 1] not in SAFE_ESCAPES:
                return False
            k += 2
            continue
        if in_class and (c == "[" or pattern.startswith("&&", k)):
            return False
        if c == "[" and not in_class:
            if pattern.startswith(("[]", "[^]"), k):
                return False
            in_class = True
        if c == "]" and in_class:
            in_class = False
        if c == "(" and pattern.startswith("(?<", k) and not pattern.startswith(("(?<=", "(?<!"), k):
            return False
        k += 1
    return True


# Characters by number, and Unicode classes within a class: any such character is read as
# one outside ASCII, which ends a literal and is never part of one.
NUMBERED = re.compile(r"\\(?:(?P<number>x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2})|(?P<kind>[pP]\{\w+\})|.)|.", re.S)


def _plain(pattern: str) -> str:
    out, in_class = [], False
    for m in NUMBERED.finditer(pattern):
        in_class = (in_class or m[0] == "[") and m[0] != "]"
        out.append("\u0100" if m["number"] or m["kind"] and in_class else m[0])
    return "".join(out)


def _score(need: set[str]) -> tuple[int, int]:
    return min(len(s) for s in need), -len(need)


def _needs(items) -> list[set[str]]:
    """Sets of strings; a match of the sequence contains one of each set."""
    found, run = [], []

    def flush():
        if run:
            found.append({"".join(run)})
            run.clear()

    for op, av in items:
        if op is C.LITERAL and 32 <= av < 127:
            run.append(chr(av).lower())
            continue
        flush()
        if op is C.SUBPATTERN:
            found += _needs(av[-1])
        elif op is C.ATOMIC_GROUP:
            found += _needs(av)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found += _needs(av[2]) if av[0] >= 1 else []
        elif op is C.BRANCH:
            alts = [max(_needs(a), key=_score, default=None) for a in av[1]]
            found += [] if any(a is None for a in alts) else [set().union(*alts)]
        elif op is C.IN:
            chars = [x for o, x in av if o is C.LITERAL and 32 <= x < 127]
            if len(chars) == len(av) and 0 < len(chars) <= 8:
                found.append({chr(x).lower() for x in chars})
    flush()
    return [need for need in found if need and all(need)]


def needs(pattern: str) -> list[set[str]]:
    """Sets of ASCII strings (lower case), the best first; every match holds one of each set."""
    pattern = _plain(pattern)
    if not _readable(pattern):
        return []
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return []
    return sorted(_needs(list(tree)), key=_score, reverse=True)


def anchors(pattern: str) -> set[str] | None:
    """ASCII strings (lower case) one of which every match holds, or None if unknown."""
    return next(iter(needs(pattern)), None)


class Waker:
    """Pattern numbers by anchor literal; ``woken(line)`` names the patterns to try."""

    def __init__(self, patterns: dict[int, str]):
        self.always: list[int] = []
        # Further literals of a pattern, looked for only when its anchor is there.
        self.further: dict[int, list[tuple]] = {}
        slots: dict[str, list[int]] = {}
        for number, pattern in patterns.items():
            known = needs(pattern)
            if not known:
                self.always.append(number)
                continue
            self.further[number] = list(dict.fromkeys(tuple(sorted(need)) for need in known[1:]))
            for literal in known[0]:
                slots.setdefault(literal, []).append(number)
        self.machine = ahocorasick.Automaton()
        for literal, numbers in slots.items():
            self.machine.add_word(literal, tuple(numbers))
        if slots:
            self.machine.make_automaton()
        self.anchored = bool(slots)

    def met(self, line: str) -> list[int]:
        """Numbers of the anchored patterns that the line may match."""
        hits: set[int] = set()
        if self.anchored and line:
            folded = fold(line)
            for _, numbers in self.machine.iter(folded):
                hits.update(numbers)
            hits = {n for n in hits if all(any(x in folded for x in need) for need in self.further[n])}
        return sorted(hits)

    def woken(self, line: str) -> list[int]:
        return sorted({*self.always, *self.met(line)})
