"""Sentence units of texts in many languages and scripts, with their places.

Method: document-centred disambiguation. Whether a word with a full stop is an abbreviation is decided from unambiguous
occurrences: within the text itself (followed by a small letter or a figure), with corpus counts as the fallback (how often
the word with its stop closes a paragraph, which abbreviations that never end a sentence don't). Whether the capital behind
such an abbreviation is that of a proper name or begins a sentence is told by the same text: a word that stands elsewhere in
it in small letters, and never capitalised inside a sentence, is no name. Scripts have their own terminators; Thai has none
and is divided at blanks.

Rules: a paragraph mark (the two characters backslash and n, or any line break) always ends a sentence. Nothing inside a
matched pair of quotes or brackets is divided. A quotation that opens a sentence goes on through the words that report it;
one introduced by a colon or comma ends the sentence with its closing quote if it holds a terminator at its end. Runs of
dots are pauses unless a capital follows.

Defined results: null, empty and blank texts have no sentence. Positions count code points; blanks at either end are not part
of a sentence. Texts are processed whole, in one pass over their marks, at any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.textform import IGNORABLE, LOOKALIKES, _TABLE
from newsloom.plans.runtime import cut, shuffled

# Abbreviations that never end a sentence when another word follows.
TITLES = frozenset(
    "dr prof mr mrs ms st no nos nr sr sra srta dra hr fr núm num pág art vol fig approx ca bzw vs mt gen col capt lt sgt rev hon"
    " gov sen rep pres ing lic ud uds d.h z.b u.a o.ä e.g i.e cf al mio mrd tel abs डॉ श्री प्रो jan feb apr jun jul aug sep sept"
    " oct nov dec".split()
)
# Abbreviations that may stand before the end of a sentence or inside one.
EITHER = frozenset("a.m p.m inc ltd co corp jr etc usw assn bros dept".split())
# Names of months that follow a German ordinal number.
MONTHS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split())

OPENERS = {"「": "」", "『": "』", "“": "”", "‘": "’", "„": "“", "«": "»", "（": "）", "(": ")", "【": "】", "《": "》", "〈": "〉", "[": "]", "〔": "〕", "［": "］"}
BRACKETS = frozenset("（(【《〈[〔［")
CLOSERS = frozenset(OPENERS.values()) | {'"'}
STOPS = "。！？!?।॥｡؟"
#: Corpus evidence: a word is taken for an abbreviation that never ends a sentence if it was seen this often with a stop ...
SEEN = 30
#: ... and closes a paragraph in less than this share of the cases (ordinary words do so far more often).
CLOSES = 0.02
#: Abbreviations that may come to the driver; if there are more, they are joined to the texts that hold them instead.
LEARNED = 100_000

_PARAGRAPH = re.compile(r"\\n|[\n\r\x0b\x0c\x85\u2028\u2029]+")
#: Characters that hide letters, figures or marks from the rules: look-alikes, ignorable ones, letters and marks of other widths.
_DISGUISED = re.compile(
    "[\uff02\uff0e\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff62\uff63" + "".join(LOOKALIKES) + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]"
)
_THAI = re.compile("[\u0e01-\u0e5b]")
_EVENT = re.compile(r"[。！？!?।॥｡؟.…「」『』“”‘’„«»（）()【】《》〈〉\[\]〔〕［］\"]")
_EVENT_THAI = re.compile(r"[。！？!?।॥｡؟.…「」『』“”‘’„«»（）()【】《》〈〉\[\]〔〕［］\"]|[ \t\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]+")
_WORD_BEFORE = re.compile(r"[^\W\d_](?:[^\W_]|[\u0900-\u0903\u093a-\u094f]|\.)*$")
_CAPITALISED = re.compile(r"[^\W\d_]+")
_SMALL_AFTER = re.compile(r"\.\s*([^\W\d_A-Z]|[,;:])")
_QUOTE = re.compile(r"[「『“‘„«（(【《〈\[〔［」』”’»）)】》〉\]〕］\"]")
_OPENS = re.compile(r"[「『“‘„«（(【《〈\[〔［\"]")
_STOPPED = re.compile(r"(?<![\w.])([^\W\d_](?:[^\W_]|[\u0900-\u0903\u093a-\u094f]|\.(?=[^\W\d_]))*)\.(?=(\s*)(\S?))")


def _quote_pairs(text: str) -> dict[int, int]:
    """Place of the closing mark for every opening mark that has one."""
    stack: list[tuple[int, str]] = []
    pairs: dict[int, int] = {}
    for m in _QUOTE.finditer(text):
        c, at = m.group(), m.start()
        if c == '"':
            if any(x[1] == '"' for x in stack):
                while stack[-1][1] != '"':
                    stack.pop()
                pairs[stack.pop()[0]] = at
            else:
                stack.append((at, '"'))
            continue
        if stack and c in CLOSERS and (OPENERS.get(stack[-1][1]) == c or any(OPENERS.get(x[1]) == c for x in stack)):
            while OPENERS.get(stack[-1][1]) != c:
                stack.pop()
            pairs[stack.pop()[0]] = at
        elif c in OPENERS:
            stack.append((at, c))
    return pairs


def _shadow(text: str) -> tuple[str, list[int] | None]:
    """The text with look-alike letters and widths mapped one to one and ignorable characters left out, and each one's place."""
    if text.isascii() or not _DISGUISED.search(text):
        return text, None
    out, places = [], []
    for i, c in enumerate(text):
        if c < "\x80":
            out.append(c)
            places.append(i)
            continue
        to = _TABLE.get(ord(c), c)
        if to is None:
            continue
        if to == c and not c.isspace():
            k = unicodedata.normalize("NFKC", c)
            to = k if len(k) == 1 and c not in "（）！？；：" else c
        out.append(to if len(to) == 1 else c)
        places.append(i)
    return "".join(out), places


class Evidence:
    """What is known of words with a full stop: from the corpus (types that never end a sentence) and from the text at hand."""

    def __init__(self, never: frozenset[str] = frozenset()):
        self.never = never | TITLES
        self.here: set[str] = set()
        self.text = ""
        self.more: DataFrame | None = None  # word: further types, to be joined to the texts

    def read(self, text: str) -> None:
        """Unambiguous occurrences in this text: a stop before a small letter, a figure or a comma."""
        self.here, self.text = set(), text
        for m in _SMALL_AFTER.finditer(text):
            if m.group(1).islower() or m.group(1) in ",;:":
                at = m.start()
                word = _WORD_BEFORE.search(text[max(0, at - 40) : at])
                if word:
                    self.here.add(_own_part(word.group()).lower())

    def is_name(self, word: str) -> bool:
        """Whether a capitalised word is a proper name by its other occurrences: capitalised behind a small letter, or never in small letters."""
        if re.search(rf"[^\W\dA-Z_],?\s+{re.escape(word)}(?![\w])", self.text):
            return True
        return not re.search(rf"(?<![\w]){re.escape(word.lower())}(?![\w])", self.text)

    def is_inner(self, word: str, after: str) -> bool:
        """Whether the stop after ``word`` stays inside the sentence though ``after``, a capitalised word or nothing, follows."""
        low = word.lower()
        tail = low.rsplit(".", 1)[-1]
        if low in EITHER:
            return False
        if low in self.never:
            return True
        if len(tail) == 1 and tail < "\u0370":
            return True
        return low in self.here and len(low) <= 5 and (not after or self.is_name(after))


def _own_part(word: str) -> str:
    """The abbreviation at the end of a dotted run: all of it if made of single letters (e.g), else its last part (affected.Dr)."""
    parts = word.split(".")
    if len(parts) == 1 or len(parts[-1]) > 1:
        return parts[-1]
    k = len(parts)
    while k and len(parts[k - 1]) == 1:
        k -= 1
    return ".".join(parts[k:])


def _next_visible(text: str, at: int) -> int:
    n = len(text)
    while at < n and text[at].isspace():
        at += 1
    return at


def _stop_ends(text: str, at: int, evidence: Evidence) -> bool:
    """Whether the single full stop at ``at`` ends a sentence."""
    after = at + 1
    while after < len(text) and text[after] in CLOSERS:
        after += 1
    nxt = _next_visible(text, after)
    if nxt >= len(text):
        return True
    c = text[nxt]
    before = text[max(0, at - 40) : at]
    if nxt == at + 1:
        if c.isdigit() or c.islower() or c in ".,;:/-%":
            return False
    if c.islower() or c in ",;:，；：、/!?！？":
        return False
    first = nxt
    while first < len(text) and (text[first] in OPENERS or text[first] in "\"'¿¡"):
        first += 1
    if first < len(text) and text[first].islower():
        return False
    word = _WORD_BEFORE.search(before)
    if not word:
        if before[-1:].isdigit():
            m = re.match(r"[^\W\d_]+", text[nxt : nxt + 12])
            if m and m.group() in MONTHS:
                return False
            return nxt > at + 1 or not c.isdigit()
        return True
    w = _own_part(word.group())
    after = _CAPITALISED.match(text, first)
    if evidence.is_inner(w, after.group() if after else ""):
        return False
    if c.isdigit() and w.lower() in evidence.here:
        return False
    return True


def paragraph_spans(text: str, evidence: Evidence) -> list[tuple[int, int]]:
    """Sentences of one paragraph (already in its one-to-one shadow form)."""
    thai = bool(_THAI.search(text)) and len(_THAI.findall(text)) * 2 > sum(map(str.isalpha, text)) > 0
    pairs = _quote_pairs(text) if _OPENS.search(text) else {}
    spans, start, at, n = [], 0, 0, len(text)
    event = _EVENT_THAI if thai else _EVENT

    def end(place: int) -> None:
        nonlocal start
        spans.append((start, place))
        start = place

    while at < n:
        m = event.search(text, at)
        if not m:
            break
        c, p = m.group(), m.start()
        if p in pairs:
            close = pairs[p]
            at = close + 1
            first = not text[start:p].strip()
            inside = text[p + 1 : close].rstrip().rstrip("」』”’\"»）)")
            closed = bool(inside) and (inside[-1] in STOPS or inside[-1] in ".…")
            nxt = _next_visible(text, at)
            follow = text[nxt] if nxt < n else ""
            if not follow or not closed:
                continue
            if c in BRACKETS:
                if first and follow not in ",，、;；。.！!？?":
                    end(at)
                continue
            if follow in ",，、;；:：。.！!？?—–-" or follow.islower():
                continue
            lead = text[start:p].rstrip()[-1:]
            if first:
                if follow in OPENERS and follow not in BRACKETS:
                    end(at)
            elif lead in ":：,，" or (lead.isalpha() and lead.isascii() and follow.isupper() and inside[-1] == "."):
                end(at)
            continue
        if c[0].isspace():
            at = m.end()
            left, right = text[p - 1 : p], text[at : at + 1]
            if left and right and not left.isdigit() and not right.isdigit() and text[start:p].strip():
                end(p)
            continue
        at = p + 1
        if c in STOPS:
            while at < n and (text[at] in STOPS or (text[at] in CLOSERS and at not in pairs)):
                at += 1
            nxt = _next_visible(text, at)
            if nxt < n and text[nxt].islower() and c in "!?！？":
                continue
            end(at)
        elif c in ".…":
            while at < n and text[at] in ".…":
                at += 1
            if at - p > 1 or c == "…":
                nxt = _next_visible(text, at)
                if nxt < n and text[nxt].isupper() and nxt > at:
                    end(at)
            elif _stop_ends(text, p, evidence):
                while at < n and text[at] in CLOSERS and at not in pairs:
                    at += 1
                end(at)
    if start < n:
        end(n)
    return spans


def sentence_spans(text: str | None, evidence: Evidence | None = None, last: bool = False) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text; ``last``: of those of its last paragraph that isn't blank, by the evidence of all."""
    if not text:
        return []
    evidence = evidence or Evidence()
    out, at = [], 0
    shadow, places = _shadow(text)
    bounds = []
    for m in _PARAGRAPH.finditer(shadow):
        bounds.append((at, m.start()))
        at = m.end()
    bounds.append((at, len(shadow)))
    if last:
        bounds = [b for b in bounds if not shadow[b[0] : b[1]].isspace() and b[0] < b[1]][-1:]
    if any("." in shadow[a:b] for a, b in bounds):
        evidence.read(shadow)
    else:
        evidence.here, evidence.text = set(), shadow
    for at, stop in bounds:
        for a, b in paragraph_spans(shadow[at:stop], evidence) if stop > at else ():
            a, b = a + at, b + at
            if places is not None:
                a, b = places[a], (places[b - 1] + 1)
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
    return out


def stop_counts(texts: Iterator[str]) -> Counter:
    """(word, how) -> count over texts; how is end (closes a paragraph) or on."""
    found: Counter = Counter()
    for text in texts:
        if text and "." in text:
            for paragraph in _PARAGRAPH.split(text):
                for m in _STOPPED.finditer(paragraph):
                    found[_own_part(m.group(1)).lower(), "on" if m.group(3) else "end"] += 1
    return found


def corpus_evidence(texts: DataFrame) -> Evidence:
    """Counts over all texts (column text): which words with a stop never close a paragraph and which do.

    Words are counted in the workers before the shuffle. Only words seen SEEN times or more that behave like abbreviations come
    to the driver; their number is that of abbreviations in a language, not of documents. Should there be more than LEARNED, they
    stay a table that ``sentence_units`` joins to the texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = stop_counts(iter(pdf["text"]))
            if found:
                yield pd.DataFrame([(w, how, n) for (w, how), n in found.items()], columns=["word", "how", "n"])

    counted = (
        texts.where("text is not null")
        .select("text")
        .mapInPandas(run, "word string, how string, n long")
        .groupBy("word")
        .agg(F.sum(F.when(F.col("how") == "end", F.col("n")).otherwise(0)).alias("closing"), F.sum("n").alias("n"))
        .where((F.col("n") >= SEEN) & (F.length("word") <= 8) & ~F.col("word").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\d]"))
        .where(F.col("closing") < CLOSES * F.col("n"))
    )
    never = cut(counted.select("word"))
    if never.count() <= LEARNED:
        return Evidence(frozenset(r.word for r in never.collect()))  # at most LEARNED
    evidence = Evidence()
    evidence.more = never
    return evidence


def words_before_stops(text: str) -> set[str]:
    """All words whose stop may be looked up when the text is divided."""
    found = set()
    for paragraph in _PARAGRAPH.split(_shadow(text)[0]):
        at = paragraph.find(".")
        while at >= 0:
            word = _WORD_BEFORE.search(paragraph[max(0, at - 40) : at])
            if word:
                found.add(_own_part(word.group()).lower())
            at = paragraph.find(".", at + 1)
    return found


def _with_words(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with ``never``: those of the ``known`` (word) that stand before a stop in the text."""
    keyed = rows.withColumn("_text", F.xxhash64("text"))  # texts of one hash share their words, which are known ones all the same

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(t, w) for t, text in zip(pdf["_text"], pdf["text"]) for w in words_before_stops(text)], columns=["_text", "word"])

    held = keyed.select("_text", "text").mapInPandas(run, "_text long, word string").join(shuffled(known), "word")
    return keyed.join(shuffled(held.groupBy("_text").agg(F.collect_set("word").alias("never"))), "_text", "left").drop("_text")


def sentence_units(rows: DataFrame, evidence: Evidence | None = None) -> DataFrame:
    """``rows`` (field, rec_key, text, whole boolean) -> field, rec_key, start_pos, end_pos; repeated rows count once.

    ``whole`` marks titles, which are one sentence. The texts are not shuffled, unless there is a table of further evidence: repeats are dropped
    among the places found.
    """
    evidence = evidence or Evidence()
    never = evidence.never
    rows = rows.where("rec_key is not null and text is not null")
    if evidence.more is not None:
        rows = _with_words(rows, evidence.more)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Evidence(never)
        for pdf in batches:
            if "never" in pdf:
                known.never = never.union(*(x for x in pdf["never"] if x is not None))
            out = []
            for f, k, text, whole in zip(pdf["field"], pdf["rec_key"], pdf["text"], pdf["whole"]):
                spans = sentence_spans(text, known)
                if whole and len(spans) > 1:
                    spans = [(spans[0][0], spans[-1][1])]
                out += [(f, k, a, b) for a, b in spans]
            yield pd.DataFrame(out, columns=["field", "rec_key", "start_pos", "end_pos"])

    return rows.mapInPandas(run, "field string, rec_key string, start_pos int, end_pos int").distinct()
