"""Spans found in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Sequence

Span = tuple[str, int, int]


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def digest(spans: Iterable[Span]) -> str:
    """Lowercase hex SHA-256 of the joined spans."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def by_start(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def by_kind(spans: Iterable[Span], kinds: Sequence[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (kinds.index(s[0]), s[1], s[2]))


class Cover:
    """The union of spans, to be asked whether another span touches it."""

    def __init__(self, spans: Iterable[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def touches(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end) - 1
        return k >= 0 and self.ends[k] > start


def masked(text: str, spans: Iterable[Span]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at, open_end = [], 0, -1
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < open_end:
            open_end = max(open_end, end)
            at = open_end
            continue
        out += [text[at:start], f"[{kind.upper()}]"]
        at = open_end = end
    return "".join([*out, text[at:]])
