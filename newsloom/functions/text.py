"""Scalar text functions as column expressions; all but the two alignments stay inside whole-stage codegen.

Null in gives null out everywhere; an empty text stays empty. Texts are processed whole.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters each cleaning removes, as classes of a regular expression.
CLUSTER_NOISE = r"[0-9a-zA-Z.， ,\-。%《*》/•、&＆(—)-@（+）：？!！“”·:」_\t\\\r\n]"
SUMMARY_NOISE = r"[0-9a-zA-Z.， ,\-。%《*》/•、&＆(—)（+）：？!！“”·:]"
NOT_HAN = r"[^一-龥]"
# The literals that the older cleaning removes, in this order (the second is the characters backslash and n).
OLD_NOISE = ("。", "\\n", "」", "//", "_", "-", "\r", "\n", "\t", "@", "\\\\", "''")
# The address that stands before an item's identifier.
ITEM_ADDRESS = "http://www.wikidata.org/entity/"
# Names of escaped brackets and what they stand for.
BRACKETS = {"-lrb-": "(", "-rrb-": ")", "-lcb-": "{", "-rcb-": "}", "-lsb-": "[", "-rsb-": "]", "``": '"', "''": '"'}
# Labels of the tag numbers of sequence tagging.
TAGS = ("O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC", "B-REG", "I-REG", "B-OTH", "I-OTH")
# Topics by the part of an address that names them.
TOPICS = {"politics": "政治", "society": "社会", "life": "生活", "world": "国际", "politic": "政治", "money": "财经", "technologynews": "科技", "armament": "军事", "chinese": "两岸", "opinion": "言论"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_for_clusters(x: Column | str) -> Column:
    """Without figures, Latin letters, blanks and marks; the class has the range from ) to @."""
    return F.regexp_replace(x, CLUSTER_NOISE, "")


def clean_for_summaries(x: Column | str) -> Column:
    """As above without that range: other ASCII marks stay."""
    return F.regexp_replace(x, SUMMARY_NOISE, "")


def han_only(x: Column | str) -> Column:
    return F.regexp_replace(x, NOT_HAN, "")


def clean_old(x: Column | str) -> Column:
    """Blanks at the ends and the literals of OLD_NOISE removed one after the other."""
    out = F.regexp_replace(_c(x), r"^\s+|\s+$", "")
    for literal in OLD_NOISE:
        out = F.replace(out, F.lit(literal), F.lit(""))
    return out


def unescape_brackets(x: Column | str) -> Column:
    out = _c(x)
    for name, mark in BRACKETS.items():
        out = F.replace(out, F.lit(name), F.lit(mark))
    return out


def zfill(x: Column | str, width: int) -> Column:
    """Zeros on the left up to ``width``; longer values are kept whole (``lpad`` would cut them)."""
    s = _c(x).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def normal_time(x: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` from that, from ``yyyy/MM/dd HH:mm`` or from an ISO time; anything else gives null."""
    s = F.regexp_replace(F.regexp_replace(_c(x), r"^(\d{4})/(\d{2})/(\d{2}) ", "$1-$2-$3 "), r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2}).*$", "$1 $2")
    s = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), F.concat(s, F.lit(":00"))).otherwise(s)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), s)


def year_month(x: Column | str) -> Column:
    return F.substring(normal_time(x), 1, 7)


def event_id(date: Column | str, ordinal: Column | str) -> Column:
    """Date and the ordinal with ten places."""
    return F.concat(_c(date), zfill(ordinal, 10))


def paragraphs(x: Column | str) -> Column:
    """Parts between the two characters backslash and n."""
    return F.split(x, r"\\n")


def first_paragraph(x: Column | str, longer_than: int = 3) -> Column:
    """First paragraph that has more than ``longer_than`` characters, without blanks and U+2028; null if there is none."""
    parts = F.filter(paragraphs(x), lambda p: F.length(p) > longer_than)
    return F.replace(F.replace(F.get(parts, F.lit(0)), F.lit(" "), F.lit("")), F.lit(" "), F.lit(""))


def translate_characters(x: Column | str, pairs: Mapping[str, str]) -> Column:
    """Character by character by a table of the caller (scripts, widths)."""
    return F.translate(x, "".join(pairs), "".join(pairs.values()))


def spaces_back(x: Column | str) -> Column:
    return F.replace(_c(x), F.lit("%20"), F.lit(" "))


def after_last(x: Column | str, mark: str = ":") -> Column:
    return F.substring_index(x, mark, -1)


def wiki_name(x: Column | str, address: str = ITEM_ADDRESS) -> Column:
    """Identifier at the end of an item's address, without a number in brackets behind it."""
    return F.regexp_replace(F.replace(_c(x), F.lit(address), F.lit("")), r"\[\d+\]", "")


def without_blanks(x: Column | str) -> Column:
    return F.regexp_replace(x, r"[\s\p{Z}]+", "")


def question(a: Column | str, b: Column | str, quoted: bool = True) -> Column:
    q = F.lit('"' if quoted else "")
    return F.concat(q, _c(a), q, F.lit("?"), q, _c(b), q)


def characters(x: Column | str) -> Column:
    """Characters without blanks (also U+202F)."""
    return F.filter(F.split(x, ""), lambda c: ~c.rlike(r"^[\s\x{202F}]?$"))


def whole_words(x: Column | str) -> Column:
    """Word pieces put together again, blanks collapsed."""
    s = F.replace(F.replace(_c(x), F.lit(" ##"), F.lit("")), F.lit("##"), F.lit(""))
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def occurrences(x: Column | str, part: Column | str) -> Column:
    """Non-overlapping occurrences of a literal part; an empty part counts as none."""
    p = _c(part)
    return F.when(F.length(p) > 0, ((F.length(x) - F.length(F.replace(_c(x), p, F.lit("")))) / F.length(p)).cast("int")).otherwise(0)


def wildcard_occurrences(x: Column | str, pattern: str) -> Column:
    """Occurrences of a lexicon entry with a star, taken as a regular expression followed by word characters."""
    return F.regexp_count(x, F.lit("(?U)" + pattern + r"\w*"))


def is_ascii_word(x: Column | str) -> Column:
    return _c(x).rlike("^[A-Za-z]+$")


def tokens(x: Column | str) -> Column:
    """Lower-case runs of letters, figures and underscores."""
    return F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def words_of(x: Column | str) -> Column:
    """Words of scripts with blanks, and pairs of neighbouring characters of Han runs (one character where it stands alone)."""
    runs = F.regexp_extract_all(F.lower(_c(x)), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}_&&[^\p{IsHan}]]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"^\p{IsHan}{2,}$"), pairs(r)).otherwise(F.array(r))))


def ngrams(words: Column | str, n: int) -> Column:
    """Distinct n-grams of an array; fewer than n words give none."""
    w = _c(words)
    made = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def padded(array: Column | str, width: int, fill) -> Column:
    """Cut or filled up to ``width``."""
    a = F.slice(array, 1, width)
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(width) - F.size(a))))


def topic_of(url: Column | str, topics: Mapping[str, str] = TOPICS, part: int = 4) -> Column:
    """Topic named by a part of an address (the fifth by default); unknown ones give null."""
    table = F.create_map(*[F.lit(v) for kv in topics.items() for v in kv])
    return F.try_element_at(table, F.get(F.split(url, "/"), F.lit(part)))


def round_places(x: Column, places: int) -> Column:
    """A double rounded by its exact binary value, ties to the even neighbour (2.675 gives 2.67, 0.125 gives 0.12; exact below 2^52 / 10^places).

    The product with the power of ten is taken with its rounding error (Dekker's splitting), so that no tie is made or hidden by it.
    """
    scale, a = float(10**places), F.abs(x.cast("double"))
    high = a * 134217729.0 - (a * 134217729.0 - a)
    product = a * scale
    error = (high * scale - product) + (a - high) * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return F.signum(x) * F.when(up, whole + 1).otherwise(whole) / scale


def overlay(left: Column | str, right: Column | str) -> Column:
    """Two maps merged, the right one wins."""
    l, r = _c(left), _c(right)
    return F.map_concat(F.map_filter(l, lambda k, v: ~F.map_contains_key(r, k)), r)


def align_answer(predicted: Column | str, original: Column | str) -> Column:
    """The part of ``original`` that spells ``predicted`` when blanks are left out; the original if there is none."""

    @F.pandas_udf("string")
    def run(p: pd.Series, o: pd.Series) -> pd.Series:
        def one(pred, orig):
            if pred is None or orig is None:
                return orig
            places = [i for i, c in enumerate(orig) if not c.isspace()]
            solid, wanted = "".join(orig[i] for i in places), "".join(pred.split())
            at = solid.lower().find(wanted.lower()) if wanted else -1
            if at < 0 or len(solid.lower()) != len(solid):
                return orig
            return orig[places[at] : places[at + len(wanted) - 1] + 1]

        return pd.Series([one(a, b) for a, b in zip(p, o)], dtype=object)

    return run(_c(predicted), _c(original))


def narrow_span(words: Column | str, start: Column | str, end: Column | str, answer: Column | str) -> Column:
    """The first shortest span [start, end] inside the given one that spells the answer; the given one if none does."""

    @F.pandas_udf("struct<start:int,end:int>")
    def run(w: pd.Series, s: pd.Series, e: pd.Series, a: pd.Series) -> pd.DataFrame:
        out = []
        for words, i, j, text in zip(w, s, e, a):
            best = (i, j)
            for x in range(i, j + 1):
                for y in range(j, x - 1, -1):
                    if "".join(words[x : y + 1]) == text and y - x < best[1] - best[0]:
                        best = (x, y)
            out.append(best)
        return pd.DataFrame(out, columns=["start", "end"])

    return run(_c(words), _c(start), _c(end), _c(answer))
