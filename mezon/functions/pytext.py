"""Text helpers for code that already runs in Python (Arrow batches)."""

from __future__ import annotations

import re
import unicodedata

# Uzbek Cyrillic letters and their Latin spelling, apostrophes left out.
UZ_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "j", "з": "z",
    "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "x", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sh",
    "ъ": "", "ы": "i", "ь": "", "э": "e", "ю": "yu", "я": "ya", "ў": "o", "қ": "q", "ғ": "g", "ҳ": "h",
}
# Characters written for the Uzbek apostrophe.
APOSTROPHES = "'‘’ʼʻ`´′‵ʹˈ＇"
# Marks without width.
INVISIBLE = "­​‌‍⁠﻿"

_DROP = re.compile(f"[{APOSTROPHES}{INVISIBLE}]")
_CYR = {ord(k): v for k, v in UZ_CYRILLIC.items()}
_YE = re.compile(r"(?:(?<![^\W\d_])|(?<=[аеёиоуўэюяъ]))е")
_HAS_CYR = re.compile("[Ѐ-ӿ]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W_]+")


def clean(text: str) -> str:
    """NFKC, lower case, without apostrophes and invisible marks."""
    if text.isascii():
        return text.replace("'", "").replace("`", "").lower()
    return _DROP.sub("", unicodedata.normalize("NFKC", _DROP.sub("", text)).lower())


def latin(text: str) -> str:
    """``clean`` text with Cyrillic letters written in Uzbek Latin."""
    text = clean(text)
    if _HAS_CYR.search(text):
        text = _YE.sub("ye", text).translate(_CYR)
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits of the Latin-script form."""
    return _WORD.findall(latin(text))


def split_sentences(text: str | None) -> list[str]:
    """Cut after ``. ! ? …`` followed by white space and at line breaks; empty pieces are dropped."""
    if not text:
        return []
    return [s for s in (p.strip() for p in _SENTENCE.split(text)) if s]
