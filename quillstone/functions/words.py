"""Word normalisation shared by operators that compare texts.

Case, accents, punctuation, markup-free whitespace and compatibility forms do
not count: a word is a run of letters or digits after folding.
"""

from __future__ import annotations

import re
import unicodedata

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile("[̀-ͯ]")


def fold(text: str) -> str:
    """Lower case without accents (NFKD, combining marks dropped)."""
    text = text.lower()
    return text if text.isascii() else _MARK.sub("", unicodedata.normalize("NFKD", text))


def words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []
