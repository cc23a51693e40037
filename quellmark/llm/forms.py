"""Case-, punctuation- and field-order-insensitive forms of a text, shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata

WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    """Letter case removed through upper case, so that ß, SS and ss as well as ı, I, İ and i agree."""
    return text.upper().lower().replace("i̇", "i")


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and `_`, case removed; none for null."""
    return WORD.findall(fold(text)) if text else []


def _ignorable() -> str:
    """A character class of white space and punctuation but for `@`, `_` and `#`, as ranges."""
    ranges: list[list[int]] = []
    for point in range(0x20000):  # beyond it there is neither
        char = chr(point)
        if char in "@_#" or not (char.isspace() or char in "$+<=>^`|~" or unicodedata.category(char)[0] == "P"):
            continue
        if ranges and ranges[-1][1] == point - 1:
            ranges[-1][1] = point
        else:
            ranges.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if a != b else f"\\U{a:08x}" for a, b in ranges)


IGNORED = re.compile(f"[{_ignorable()}]+")
#: `name:` of one to three words of letters, as it begins a field of a list.
FIELD = re.compile(r"\s*[^\W\d_]+(?:\s+[^\W\d_]+){0,2}\s*:")


def fields(text: str) -> list[str]:
    """The `name: value` fields of a list joined by `;` or `|`; the whole text as the only item if it isn't such a list.

    A part without a name of its own belongs to the field before it.
    """
    parts = re.split(r"[;|]", text)
    if len(parts) < 2 or not FIELD.match(parts[0]):
        return [text]
    out = [parts[0]]
    for part in parts[1:]:
        if FIELD.match(part):
            out.append(part)
        else:
            out[-1] += part
    return out


def canonical(text: str) -> str:
    """One spelling for all texts that differ by white space, letter case, punctuation and order of their fields."""
    folded = fold(text)
    if ";" in folded or "|" in folded:
        return "".join(sorted(IGNORED.sub("", part) for part in fields(folded)))
    return IGNORED.sub("", folded)
