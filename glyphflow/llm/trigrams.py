"""Boolean trigram queries from regular expressions.

A query is a list of clauses, each a set of trigrams: a text (in lower case)
can match only if it holds all trigrams of some clause.  None stands for an
expression without mandatory trigrams.

Read are literals, escapes, classes, groups, alternatives and repeats; an
expression with anything else counts as one without mandatory trigrams.
"""

from __future__ import annotations

import re

#: Alternatives that are followed up; where there are more, a run of literals is cut instead.
MOST = 64
#: Characters that a class may stand for, to be followed up.
FEW = 6

#: An alternative: its finished runs of literal characters, and the run that is still open.
Alternative = tuple[tuple[str, ...], str]

_REPEAT = re.compile(r"\*|\+|\?|\{(\d+)(,?)(\d*)\}")
_ESCAPED = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|x\{([0-9A-Fa-f]+)\}|([nrt])|([^\w\s]))")
_NAMED = {"n": "\n", "r": "\r", "t": "\t"}


class _Unknown(ValueError):
    """Something that is not read."""


def _cut(found: list[Alternative]) -> list[Alternative]:
    return list(dict.fromkeys(((*done, run), "") if run else (done, "") for done, run in found))


def _fewer(found: list[Alternative], grown: list[Alternative]) -> list[Alternative]:
    grown = list(dict.fromkeys(grown))
    return grown if len(grown) <= MOST else _cut(found)


class _Reader:
    """Walks through an expression and follows what must stand in a match."""

    def __init__(self, pattern: str):
        self.p, self.at = pattern, 0

    def alternatives(self, found: list[Alternative]) -> list[Alternative]:
        grown = self.sequence(found)
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            grown = grown + self.sequence(found)
        return _fewer(found, grown)

    def sequence(self, found: list[Alternative]) -> list[Alternative]:
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            begin = self.at
            self.item([((), "")])  # to see where it ends
            end = self.at
            low, high = self.repeat()
            after = self.at

            def once(before: list[Alternative], begin=begin) -> list[Alternative]:
                self.at = begin
                return self.item(before)

            if (low, high) == (0, 1):
                found = _fewer(found, [*found, *once(found)])
            else:
                for _ in range(min(low, 3)):
                    found = once(found)
                if low != high or low > 3:
                    found = _cut(found)
            assert end <= after
            self.at = after
        return found

    def repeat(self) -> tuple[int, int | None]:
        m = _REPEAT.match(self.p, self.at)
        if not m:
            return 1, 1
        self.at = m.end()
        if self.p[self.at : self.at + 1] in ("?", "+"):  # lazy or possessive
            self.at += 1
        if m[0] in "*+?":
            return {"*": (0, None), "+": (1, None), "?": (0, 1)}[m[0]]
        return int(m[1]), int(m[1]) if not m[2] else int(m[3]) if m[3] else None

    def item(self, found: list[Alternative]) -> list[Alternative]:
        c = self.p[self.at]
        if c == "(":
            self.at += 1
            if self.p[self.at : self.at + 1] == "?":
                if self.p[self.at : self.at + 2] != "?:":
                    raise _Unknown(self.p)
                self.at += 2
            found = self.alternatives(found)
            if self.p[self.at : self.at + 1] != ")":
                raise _Unknown(self.p)
            self.at += 1
            return found
        if c in "^$*+?{":
            raise _Unknown(self.p)
        options = self.one_of() if c == "[" else self.any() if c == "." else self.characters()
        if options is None:
            return _cut(found)
        return _fewer(found, [(done, run + x) for done, run in found for x in sorted(options)])

    def any(self) -> None:
        self.at += 1

    def characters(self) -> set[str] | None:
        """The character (in lower case) at the place, or None for an escape of many."""
        if self.p[self.at] != "\\":
            self.at += 1
            return {self.p[self.at - 1].lower()}
        m = _ESCAPED.match(self.p, self.at)
        if m:
            self.at = m.end()
            return {(chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _NAMED[m[3]] if m[3] else m[4]).lower()}
        if self.p[self.at + 1 : self.at + 2] in tuple("sSdDwW"):
            self.at += 2
            return None
        raise _Unknown(self.p)

    def one_of(self) -> set[str] | None:
        """The characters (in lower case) that a class stands for, or None for many."""
        self.at += 1
        out: set[str] | None = set()
        if self.p[self.at : self.at + 1] == "^":
            out = None
            self.at += 1
        first = True
        while first or self.p[self.at : self.at + 1] != "]":
            first = False
            if self.at >= len(self.p) or self.p[self.at] == "[":
                raise _Unknown(self.p)
            low = self.characters()
            if self.p[self.at : self.at + 1] == "-" and self.p[self.at + 1 : self.at + 2] != "]":
                self.at += 1
                self.characters()
                low = None  # a range, taken as many
            out = None if out is None or low is None else out | low
        self.at += 1
        return out if out is not None and len(out) <= FEW else None


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    reader = _Reader(pattern)
    try:
        found = reader.alternatives([((), "")])
        if reader.at != len(pattern):
            return None
    except _Unknown:
        return None
    clauses = {frozenset(run[i : i + 3] for run in done for i in range(len(run) - 2)) for done, _ in _cut(found)}
    if frozenset() in clauses:
        return None
    return sorted((c for c in clauses if not any(other < c for other in clauses)), key=sorted)
