"""Splitting texts at spaces where byte-level BPE with the public pattern always splits too."""

from __future__ import annotations

import re

#: A space after white space and before white space or the end may share a token with them.
_SHARED = re.compile(r"\s (?:\s|\Z)")


def space_pieces(text: str) -> list[str] | None:
    """Pieces between single spaces; all but the first stand for a space and themselves.

    The pattern gives a space to the word after it, so each piece can be encoded alone. None
    where runs of white space make that untrue, and the text has to be split by the pattern.
    """
    return None if _SHARED.search(text) else text.split(" ")
