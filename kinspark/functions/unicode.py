"""Unicode folding that Spark has no function for: compatibility forms and transliteration, as an Arrow UDF."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters without a decomposition.
LATIN = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h"}
VIRAMA = "VIRAMA"
CONSONANTS = {"NGA": "ng", "NYA": "ny", "NNA": "nn", "TTA": "tt", "TTHA": "tth", "DDA": "dd", "DDHA": "ddh", "SSA": "ss", "SHA": "sh", "CHA": "ch", "CA": "c", "LLA": "ll", "RRA": "rr", "LLLA": "lll"}


@lru_cache(100_000)
def _letter(c: str) -> tuple[str, str]:
    """Latin spelling and kind (consonant, vowel, sign, kill, nasal, mark, other), read off the character's Unicode name."""
    if c.isascii():
        return c, "other"
    if c in LATIN:
        return LATIN[c], "other"
    plain = unicodedata.normalize("NFD", c)
    if plain[0].isascii():
        return plain[0], "other"
    name = unicodedata.name(c, "")
    if VIRAMA in name:
        return "", "kill"
    if " LETTER " in name and 0x0900 <= ord(c) <= 0x0D7F:
        own = name.rpartition(" LETTER ")[2]
        if own[0] in "AEIOU" or own.startswith("VOCALIC"):
            return own.replace("VOCALIC ", "").lower(), "vowel"
        return CONSONANTS.get(own, own[:-1].lower() if own.endswith("A") else own.lower()), "consonant"
    if "VOWEL SIGN" in name:
        return name.rpartition("SIGN ")[2].replace("VOCALIC ", "").lower(), "sign"
    if any(sign in name for sign in ("ANUSVARA", "BINDI", "BINDU", "TIPPI")):
        return "n", "nasal"
    if "NUKTA" in name:
        return "", "mark"
    if "DIGIT" in name:
        return str(unicodedata.digit(c, "")), "other"
    return ("", "other") if unicodedata.category(c).startswith("M") else (" ", "other")


def to_latin(text: str) -> str:
    """Compatibility form, then each letter in Latin ones; Indic consonants keep their vowel unless a sign or virama follows."""
    text = unicodedata.normalize("NFKC", text)
    if text.isascii():
        return text
    out: list[str] = []
    pending = False
    for c in text:
        spelled, kind = _letter(c)
        if kind == "mark":  # it belongs to the consonant before it
            continue
        if pending and kind not in ("sign", "kill") and kind != "other":
            out.append("a")
        pending = kind == "consonant"
        out.append(spelled)
    return "".join(out)


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """:func:`to_latin` in Arrow batches, computed once for each distinct value of a batch."""
    return s.map({v: to_latin(v) for v in s.dropna().unique()})
