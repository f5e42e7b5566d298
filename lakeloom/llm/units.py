"""Cutting texts where byte-level BPE never looks across.

The GPT-2 pattern lets a pre-token begin with one space. A cut before a space
is therefore a pre-token boundary unless white space stands on both sides of
it (or the text ends after it), so that a text splits into *units*, each a
piece between spaces with the space before it, that are encoded independently.
Units repeat far more than texts do, which is what both BPE operators use.
"""

from __future__ import annotations

import re

#: The pattern that byte-level BPE of this family splits texts by (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A space inside a run of white space, neither its first nor its last character.
UNSAFE = re.compile(r"\s (?:\s|\Z)")


def unit_keys(text: str) -> list[str] | None:
    """Keys of the text's units, or None if it has an unsafe space and must be encoded whole.

    A key is the unit with ``\\0`` in front of the first one, which has no space
    before it, and the bare piece for the others; :func:`unit_text` undoes it.
    """
    if UNSAFE.search(text):
        return None
    keys = text.split(" ")
    keys[0] = "\0" + keys[0]
    return keys


def unit_text(key: str) -> str:
    return key[1:] if key[:1] == "\0" else " " + key


def splittable(text: str) -> bool:
    """False for texts in which a key could be mistaken for a first unit's."""
    return "\0" not in text


#: A space between two characters that are no white space: pre-tokens never lie across the place before it.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def cut_everywhere(text: str, pattern: str = PATTERN) -> bool:
    """Whether a pre-token boundary lies before every space of a text."""
    return pattern == PATTERN and UNSAFE.search(text) is None


def pieces_of(text: str, pattern: str = PATTERN) -> list[str]:
    """A text's pieces; all but the first one stand for a space and what they hold.

    Pre-tokens of the pieces are those of the text. Texts with an unsafe space
    are cut at spaces between other characters only. Cuts are known to be safe
    for :data:`PATTERN`; by another pattern a text is one piece.
    """
    if pattern != PATTERN:
        return [text]
    return text.split(" ") if cut_everywhere(text) else BETWEEN.split(text)
