"""Patterns in the common dialect (RE2's) for the JVM's engine."""

from __future__ import annotations

WORD = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
SPACE = r"\t\n\f\r "


def java(pattern: str) -> str:
    """ASCII word edges and white space, as in RE2, where the JVM would differ."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if two == r"\b" and not inside:
            out.append(WORD)
            i += 2
        elif two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
            i += 2
        elif c == "\\":
            out.append(two)
            i += 2
        else:
            inside = c == "[" or inside and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


def phrase(words: str) -> str:
    """Matches words as they stand, between word edges."""
    return r"(?<![0-9A-Za-z_])\Q" + words + r"\E(?![0-9A-Za-z_])"
