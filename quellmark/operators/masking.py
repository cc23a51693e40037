"""Masks over stretches of a text."""

from __future__ import annotations

#: Characters of a mask, in turn.
MASK = "@#$%&!"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order; one that begins within or right after the one before joins it."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the characters of the merged spans masked; white space stays, and takes its turn."""
    chars = list(text)
    for first, last in merged(spans):
        for k in range(first, min(last, len(chars))):
            if not chars[k].isspace():
                chars[k] = MASK[(k - first) % len(MASK)]
    return "".join(chars)
