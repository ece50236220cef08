"""Cleaning of prompts: broken encodings, HTML references, white space.

These rules need the whole table of named references and a trial decoding, which
no built-in function has; they run in Arrow batches on the texts that hold a
reference or look broken, and all other texts stay in the JVM.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: UTF-8 of two to four bytes, each byte shown as a character of Windows-1252 or, where that has none, of Latin-1.
_TAIL = "[\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
_BROKEN = f"[\xc2-\xdf]{_TAIL}|[\xe0-\xef]{_TAIL}{{2}}|[\xf0-\xf4]{_TAIL}{{3}}"
BROKEN = re.compile(f"(?:{_BROKEN})+")
#: Texts that need more than common white space collapsed: references, broken encodings, other blanks.
_ODD = "&|" + _BROKEN + r"|[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bytes(text: str) -> bytes:
    """The bytes that were shown as these characters."""
    return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in text)


def repaired(text: str) -> str:
    """The text with UTF-8 that was read as Windows-1252 read again, at most three times over.

    A run of such characters is read again only if all its bytes are UTF-8 and
    give the same characters when they are shown as before; what is not stays,
    and so does a single pair that would be a letter beyond Cyrillic, which is
    more likely meant as it stands.
    """
    def again(m: re.Match) -> str:
        try:
            new = _bytes(m[0]).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]
        rare = len(new) == 1 and 0x530 <= ord(new) < 0x800
        return new if not rare and new.encode("utf-8") == _bytes(m[0]) else m[0]

    for _ in range(3):
        new = BROKEN.sub(again, text)
        if new == text:
            break
        text = new
    return text


def cleaned(text: str) -> str:
    """Encoding repaired, references decoded twice, white space collapsed and trimmed."""
    return " ".join(html.unescape(html.unescape(repaired(text))).split())


def _cleaned(texts: pd.Series) -> pd.Series:
    return texts.map(cleaned, na_action="ignore")


def clean_prompt(c: Column) -> Column:
    """``cleaned`` of a text; null stays null."""
    odd = c.rlike(_ODD)
    return F.when(odd, F.pandas_udf(_cleaned, StringType())(F.when(odd, c))).otherwise(F.trim(F.regexp_replace(c, r"\s+", " ")))
