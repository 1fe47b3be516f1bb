"""Literals that every match of a pattern contains, read from the pattern.

A pattern gives a set of literals: every text it matches holds at least one of
them.  They are ASCII and in lower case, to be looked for in case-folded texts.
What is not understood gives no literal, which only makes a pattern dearer.
"""

from __future__ import annotations

import re

_REPEAT = re.compile(r"[?*+]\??|\{(\d+)(?:,\d*)?\}\??")
_GROUP = re.compile(r"\(\?(?:P?<\w+>|([a-zA-Z]*)(?:-[a-zA-Z]+)?([:)]))")
_NAMED = re.compile(r"\\(?:[pP](?:\{[^}]*\}|.)|[xuU]\{[^}]*\}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-9]+|[a-zA-Z])", re.S)
_COMMON = frozenset("etaoinsrhlducm ")


def _least(found: re.Match | None) -> int:
    """How often the repeated item occurs at least."""
    if found is None or found[0][0] == "+":
        return 1
    return int(found[1]) if found[1] else 0


class _Reader:
    def __init__(self, pattern: str):
        self.src, self.at = pattern, 0

    def repeat(self) -> re.Match | None:
        found = _REPEAT.match(self.src, self.at)
        self.at = found.end() if found else self.at
        return found

    def either(self) -> frozenset[str] | None:
        """Alternatives up to a closing bracket or the end: one literal of each."""
        out = [self.sequence()]
        while self.at < len(self.src) and self.src[self.at] == "|":
            self.at += 1
            out.append(self.sequence())
        return None if None in out else frozenset().union(*out)

    def sequence(self) -> frozenset[str] | None:
        found: list[frozenset[str]] = []
        run = ""

        def close() -> None:
            nonlocal run
            if run:
                found.append(frozenset([run]))
            run = ""

        while self.at < len(self.src) and self.src[self.at] not in "|)":
            c = self.src[self.at]
            if c == "(":
                close()
                inner = self.group()
                if inner is not None and _least(self.repeat()):
                    found.append(inner)
                continue
            if c == "[":
                close()
                self.skip_class()
                self.repeat()
                continue
            if c == "\\" and (named := _NAMED.match(self.src, self.at)):
                close()
                self.at = named.end()
                self.repeat()
                continue
            if c in ".^$":
                close()
                self.at += 1
                self.repeat()
                continue
            if c == "\\":
                self.at += 1
                c = self.src[self.at:self.at + 1]
            self.at += 1
            times = self.repeat()
            if not c.isascii() or not c or not _least(times):
                close()
                continue
            run += c.lower()
            if times:
                close()
        close()
        # the longest is the rarest guess; of alternatives the shortest counts
        return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    def group(self) -> frozenset[str] | None:
        opened = _GROUP.match(self.src, self.at)
        if opened and opened[2] == ")":         # flags for what follows
            self.at = opened.end()
            return None
        self.at = opened.end() if opened else self.at + 1
        inner = self.either()
        if self.src[self.at:self.at + 1] != ")":
            raise ValueError("unclosed group")
        self.at += 1
        if inner is None:
            self.repeat()
        return inner

    def skip_class(self) -> None:
        self.at += 1
        if self.src[self.at:self.at + 1] == "^":
            self.at += 1
        first = True
        while self.at < len(self.src):
            c = self.src[self.at]
            if c == "]" and not first:
                self.at += 1
                return
            if c == "[":
                end = self.src.find(":]", self.at) if self.src.startswith("[:", self.at) else -1
                if end >= 0:
                    self.at = end + 2
                else:
                    self.skip_class()
            else:
                self.at += 2 if c == "\\" else 1
            first = False
        raise ValueError("unclosed class")


def required(pattern: str) -> frozenset[str] | None:
    """Literals of which every match holds one, or None where none are known."""
    reader = _Reader(pattern)
    try:
        found = reader.either()
    except ValueError:
        return None
    return found if reader.at == len(pattern) else None


def rarest(literal: str, n: int) -> str:
    """The *n* letters of a literal that other texts are least likely to hold."""
    return max((literal[i:i + n] for i in range(len(literal) - n + 1)), key=lambda g: sum(c not in _COMMON for c in g))
