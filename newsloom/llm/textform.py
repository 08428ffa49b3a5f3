"""One consistent form for text that looks the same.

Method: compatibility normalisation in composed form, optional full case folding, mapped white space and
removal of default-ignorable characters, computed once per distinct value of an Arrow batch. Letters of
other scripts that are drawn like Latin letters become those Latin letters.

Defined results: null stays null, an empty text stays empty, a text of nothing but ignorable characters
becomes empty. Very long texts are handled whole. Line ends of every kind become a line feed, every other
blank becomes one space; blanks are never added, merged or trimmed.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.plans.runtime import cut

# Code points with the Unicode property Default_Ignorable_Code_Point, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)

# Letters drawn like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ӏ": "l", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "ι": "i", "κ": "k", "α": "a", "ρ": "p", "υ": "u",
    # Latin and Armenian letters of other shapes' ancestry
    "ı": "i", "ɡ": "g", "ɑ": "a", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g",
}

LINE_ENDS = "\x0b\x0c\r\x85\u2028\u2029"
BLANKS = "\t\x1f\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"

_TABLE: dict[int, str | None] = {ord(a): b for a, b in LOOKALIKES.items()}
_TABLE.update({ord(c): "\n" for c in LINE_ENDS})
_TABLE.update({ord(c): " " for c in BLANKS})
_TABLE.update({c: None for lo, hi in IGNORABLE for c in range(lo, hi + 1)})
_MAPPED = re.compile(
    "[" + "".join(map(re.escape, [*LOOKALIKES, *LINE_ENDS, *BLANKS])) + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]"
)


def one_form(text: str | None, fold: bool = True) -> str | None:
    """The consistent form of one text; ``fold`` adds full case folding."""
    if text is None:
        return None
    if "\r\n" in text:
        text = text.replace("\r\n", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if _MAPPED.search(text):
            text = text.translate(_TABLE)
        text = unicodedata.normalize("NFC", text)
        if fold:
            return unicodedata.normalize("NFC", text.casefold())
        return text
    if _MAPPED.search(text):
        text = text.translate(_TABLE)
    return text.lower() if fold else text


def one_form_series(texts: pd.Series, fold: bool = True) -> pd.Series:
    """``one_form`` of a batch, computed once per distinct value."""
    codes, values = pd.factorize(texts)
    forms = [one_form(v, fold) for v in values] + [None]
    return pd.Series([forms[c] for c in codes], dtype=object)


def normalised(column: Column | str, fold: bool = True) -> Column:
    """Column of the consistent form."""

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        return one_form_series(texts, fold)

    return form(column)


def look_alike_classes(values: DataFrame) -> DataFrame:
    """field, key, look (a hash, the same for all that look alike), spellings (how many different strings look so): a row for each value.

    ``values`` has columns field, key, value; nulls are left out, repeated rows count once, one key may hold several values.
    """
    spelled = cut(
        values.where("value is not null and key is not null")
        .select("field", "key", F.md5("value").alias("spelling"), F.md5(normalised("value", fold=False)).alias("look"))
        .distinct()
    )
    sizes = spelled.groupBy("field", "look").agg(F.countDistinct("spelling").alias("spellings"))
    return spelled.join(sizes, ["field", "look"]).select("field", "key", "look", "spellings").distinct()


def look_alike_pairs(values: DataFrame) -> DataFrame:
    """Pairs of keys whose values look the same but are different strings.

    ``values`` has columns field, key, value. Result: field, key_a < key_b. Repeated rows count once, null values
    and null keys match nothing; one key may hold several values. Only hashes are shuffled, never the texts, and
    groups with a single spelling are dropped before the join.
    """
    spelled = cut(
        values.where("value is not null and key is not null")
        .select("field", "key", F.md5("value").alias("spelling"), F.md5(normalised("value", fold=False)).alias("look"))
        .distinct()
    )  # two hashes for each value: the texts are read and normalised once
    mixed = (
        spelled.groupBy("field", "look")
        .agg(F.min("spelling").alias("least"), F.max("spelling").alias("most"))
        .where("least <> most")
        .select("field", "look")
    )
    kept = spelled.join(mixed, ["field", "look"], "left_semi")
    a = kept.select("field", "look", F.col("key").alias("key_a"), F.col("spelling").alias("spelling_a"))
    b = kept.select("field", "look", F.col("key").alias("key_b"), F.col("spelling").alias("spelling_b"))
    return (
        a.join(b, ["field", "look"])
        .where("key_a < key_b and spelling_a <> spelling_b")
        .select("field", "key_a", "key_b")
        .distinct()
    )
