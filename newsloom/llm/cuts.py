"""Texts whose end was lost: cut inside a sentence by a field limit or a broken transfer.

Method: a backward character n-gram model. Every sentence of the corpus (but the last of its text, whose fate is unknown) gives
one true end and a simulated cut at each of its inner places, which together weigh as much as the end. Both are counted by the
characters read backward from there, per language, place in the text (its first sentence or a later one) and state of quotes.
The final context of each text is then looked up, the longest one that was seen often enough counts, and the log-odds of end
against continuation are held against the threshold of the language and place. Thresholds are fitted on all sentences: each
end and each inner place is scored without itself, and the value that divides them with the least error is taken.

The language is the script, for Latin letters with the code the document names, its longest context winning over the one of all
Latin texts only if it is longer. A text of one sentence may be a headline: the lengths of first lines without an end mark and
of beginnings cut off inside first sentences are counted too, and their log-odds are added; so are those of such a text being
whole, from the number of these texts and the number of cuts in first sentences that the share of cut texts among the longer
ones leads to expect. A context tells a quarter of that for each character it is shorter than ORDER.

Lines that stand only at the ends of texts (credits, tags, links, results) are learned from all texts by how they begin;
a text that ends with one is complete. What stands behind the break (dots, replacement characters, torn markup) is set aside.

Defined results: null, empty, blank and symbol-only texts are complete; repeated rows get the same answer each. All counts
cover all texts, aggregated in the workers before the shuffle. Where the contexts that stand at the ends of texts are few
(BROADCAST_CONTEXTS) the workers leave out the counts of all others, which nothing looks up.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.sentences import BRACKETS, CLOSERS, STOPS, Evidence, _quote_pairs, sentence_spans
from newsloom.plans.runtime import cut, spread

ORDER = 5
#: Weight of an end, and of all inner places of a sentence together, in whole numbers.
WEIGHT = 1_000_000
#: A context counts if it was seen at least this often, as an end or as a cut.
SEEN = 4
#: A language and place has a threshold of its own from this many ends on, else 0; thresholds are multiples of STEP up to MOST.
FITTED, STEP, MOST = 200, 0.25, 6.0
#: A beginning marks lines at the ends of texts if it was seen this often there, and in at least this share of its lines.
TAIL_SEEN, TAIL_SHARE = 20, 0.9
TAIL_HEAD = 4
#: Lengths of lines are counted in steps of so many characters, up to the last step.
LENGTHS, LONGEST = 6, 60
#: Headlines that a corpus is taken to hold before any is seen, against one cut.
HEADLINES = 10
#: Contexts at the ends of texts that may be sent to every worker (8 bytes each).
BROADCAST_CONTEXTS = 4_000_000
#: Characters that a worker counts at once, and contexts it gathers before it hands on their sums.
AT_ONCE, GATHERED = 1_000_000, 1_500_000

_TORN = re.compile(
    r"(?:\s|\\|…|\.{2,}|�|\[\s*(?:…|\.{2,})\s*\]|\(\s*(?:…|\.{2,})\s*\)|（\s*(?:…+|\.{2,})\s*）|</?[A-Za-z]{0,10}[^<>]{0,20}$|&[A-Za-z#0-9]{1,8};?$)+$"
)
_DIGITS = re.compile(r"\d+")
_STATE_OPENS = re.compile(r"[「『“„«（(《\"]")
_SCRIPTS = ("la", "th", "hi", "ja", "zh")
# Ranges of code points of Thai, Devanagari, kana and Han letters, in the order of the scripts above.
_RANGES = ((0x0E01, 0x0E5B), (0x0900, 0x097F), (0x3041, 0x30FF), (0x3400, 0x9FFF))
_MARK, _NINE = ord("^"), ord("9")


def _table(test) -> np.ndarray:
    return np.fromiter(map(test, map(chr, range(0x10000))), bool, 0x10000)


_CLASS = np.zeros(0x10000, np.uint8)
for _i, (_a, _b) in enumerate(_RANGES):
    _CLASS[_a : _b + 1] = _i + 1
_DECIMAL = _table(str.isdecimal)
_BLANK = _table(str.isspace)
_OPENS = _table(set("「『“„«（(《\"").__contains__)
_ENDS = _table((set(STOPS + ".…") | CLOSERS).__contains__)


def without_torn_end(text: str) -> str:
    """The text before what stands behind a break."""
    while True:
        tail = text[-80:]
        kept = _TORN.sub("", tail)
        if len(kept) == len(tail):
            return text
        text = text[: len(text) - len(tail)] + kept


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _of(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[np.minimum(codes, 0xFFFF)]


def quote_states(unit: str) -> np.ndarray:
    """State of a unit's part before each place behind a character: 1 a quote or bracket is open, 2 it is one quotation, else 0."""
    state = np.zeros(len(unit) + 1, np.uint8)
    pairs = _quote_pairs(unit)
    closing = set(pairs.values())
    if unit[0] not in BRACKETS and pairs.get(0, -1) >= 0:
        state[pairs[0] + 1] = 2
    for m in _STATE_OPENS.finditer(unit):
        if (p := m.start()) not in closing:
            state[p + 1 : pairs.get(p, len(unit)) + 1] = 1
    return state[1:]


def _head(unit: str) -> str:
    if unit[:TAIL_HEAD].isalpha():
        return unit[:TAIL_HEAD]
    return _DIGITS.sub("9", unit[:12])[:TAIL_HEAD]


def _code_of(lang: object) -> str:
    """The language of a code such as en, EN or en-US; nothing for null."""
    return lang[:2].lower() if isinstance(lang, str) else ""


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def _label_hash(label: str) -> int:
    h = 0xCBF29CE484222325
    for b in label.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _context_keys(label: np.ndarray, state: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Hashes of the contexts of every order; ``behind`` has the last, the last but one ... character of each. 0: there is none."""
    h, keys = _mixed(label, state), np.zeros(behind.shape, np.int64)
    for k in range(behind.shape[0]):
        h = _mixed(h, behind[k])
        keys[k] = np.where(behind[k] > 0, (h ^ (h >> np.uint64(31))).view(np.int64) | 1, 0)
    return keys


class _Laid:
    """Units laid end to end: their codes with runs of figures as one 9, where each begins, its script and the states of its places."""

    def __init__(self, units: list[str]):
        codes = _codes("".join(units))
        size = np.array([len(u) for u in units])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
        kinds = _of(_CLASS, codes)
        script = np.zeros(len(units), np.uint8)
        for k in range(len(_RANGES), 0, -1):
            script[np.add.reduceat(kinds == k, start, dtype=np.int64) * 10 >= size] = k
        self.state = np.zeros(len(codes), np.uint8)
        for i in np.flatnonzero(np.add.reduceat(_of(_OPENS, codes), start, dtype=np.int64)):
            self.state[start[i] : start[i] + size[i]] = quote_states(units[i])
        decimal = _of(_DECIMAL, codes)
        kept = np.ones(len(codes), bool)
        kept[1:] = ~(decimal[1:] & decimal[:-1] & (unit[1:] == unit[:-1]))
        self.size, self.script, self.unit, self.last = size, script, unit, start + size - 1
        self.place = np.cumsum(kept, dtype=np.int32) - 1  # of every character among those kept
        self.codes = np.where(decimal, _NINE, codes)[kept]
        self.at = np.flatnonzero(kept)
        self.inside = self.place[self.at] - self.place[start][unit[self.at]]  # place of every kept character in its unit

    def backward(self) -> Iterator[np.ndarray]:
        """``behind`` of all places, character by character."""
        for k in range(ORDER):
            c = np.zeros(len(self.codes), np.uint64)
            c[k:] = self.codes[: len(c) - k]
            c[self.inside < k] = 0
            if k:
                c[self.inside == k - 1] = _MARK
            yield c

    def behind(self, at: np.ndarray) -> np.ndarray:
        """The characters that end at places among those kept, read backward, with a mark where the unit begins."""
        out = np.zeros((ORDER, len(at)), np.uint32)
        for k in range(ORDER):
            inside = self.inside[at] - k
            out[k] = np.where(inside >= 0, self.codes[np.maximum(at - k, 0)], np.where(inside == -1, _MARK, 0))
        return out


def _labels(script: np.ndarray, place: np.ndarray, codes: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, and of every unit the number of its script's label and of its language's (-1 where it has none of its own)."""
    names: dict[str, int] = {}
    number = lambda x: names.setdefault(x, len(names))
    places = ("first", "later")
    common = np.array([number(f"{_SCRIPTS[s]}|{places[p]}") for s, p in zip(script, place)], np.int64)
    own = np.array([number(f"la-{c}|{places[p]}") if s == 0 and c else -1 for s, p, c in zip(script, place, codes)], np.int64)
    return list(names), common, own


def final_contexts(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """key, label, line, heads, keys, levels of the last unit of every text that has a sentence.

    ``line``: the length step of a text of one sentence that has no end mark and nothing torn behind it, null for others. ``levels``: the order of every context key, doubled, one
    more where it is one of the document's own language.
    """
    kind = documents.schema[key].dataType.simpleString()
    code = F.col(lang) if lang else F.lit(None).cast("string")
    rows = spread(documents.where(f"{text} is not null").select(key, F.col(text).alias("text"), code.alias("lang")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = Evidence()
        for pdf in batches:
            ids, units, codes, places, torn = [], [], [], [], []
            for k, t, c in zip(pdf.iloc[:, 0], pdf["text"], pdf["lang"]):
                if not t or not any(map(str.isalpha, t)):
                    continue
                size, t = len(t.rstrip()), without_torn_end(t)
                spans = sentence_spans(t, evidence, last=True)
                if spans:
                    a, b = spans[-1]
                    ids.append(k)
                    units.append(t[a:b])
                    codes.append(_code_of(c))
                    places.append(int(bool(t[:a].strip("\\n \t\r\n"))))
                    torn.append(len(t) < size)
            if not ids:
                continue
            laid = _Laid(units)
            names, common, own = _labels(laid.script, places, codes)
            hashes = np.array([_label_hash(x) for x in names], np.uint64)
            at = laid.place[laid.last]
            state, behind = laid.state[laid.last], laid.behind(at)
            base = _context_keys(hashes[common], state, behind)
            mine = np.where(own >= 0, _context_keys(hashes[own], state, behind), 0)
            step, open_end = np.minimum(laid.size // LENGTHS, LONGEST), ~_of(_ENDS, laid.codes[at])
            yield pd.DataFrame(
                {
                    key: ids,
                    "label": [names[o if o >= 0 else c] for o, c in zip(own, common)],
                    "line": [int(n) if o and not p and not x else None for n, o, p, x in zip(step, open_end, places, torn)],
                    "heads": [[h[: k + 1] for k in range(len(h))] for h in map(_head, units)],
                    "keys": [[x for x in (*base[:, i], *mine[:, i]) if x] for i in range(len(ids))],
                    "levels": [[2 * k + 2 for k in range(ORDER) if base[k, i]] + [2 * k + 3 for k in range(ORDER) if mine[k, i]] for i in range(len(ids))],
                }
            ).astype({"line": "Int32"})

    return rows.mapInPandas(run, f"{key} {kind}, label string, line int, heads array<string>, keys array<long>, levels array<int>")


class _Sums:
    """Sums by hash of whole contexts, merged now and then, with a label, state and characters of each."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, key, label, state, behind, ends, cuts, weight) -> None:
        self.parts.append((key, label, state, behind, ends, cuts, weight))
        self.held += len(key)
        if len(self.parts) > 1 and self.held > 2 * GATHERED:
            self.merge()

    def merge(self) -> None:
        key = np.concatenate([p[0] for p in self.parts])
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        pick = order[first]
        out = [key[first], np.concatenate([p[1] for p in self.parts])[pick], np.concatenate([p[2] for p in self.parts])[pick]]
        out.append(np.concatenate([p[3] for p in self.parts], axis=1)[:, pick])
        out += [np.add.reduceat(np.concatenate([p[i] for p in self.parts])[order], first) for i in (4, 5, 6)]
        self.parts, self.held = [tuple(out)], len(first)


def _counted(texts: list[str], codes: list[str], evidence: Evidence, sums: _Sums, heads: Counter, lines: Counter, numbers: dict[str, int]) -> None:
    """Adds what the sentences of some texts tell."""
    units, places, own_codes = [], [], []
    for text, code in zip(texts, codes):
        found = [text[a:b] for a, b in sentence_spans(text, evidence)]
        if len(found) < 2:
            continue
        last = len(found) - 1
        heads.update([(_head(u), i == last) for i, u in enumerate(found)])
        units += found[:-1]
        places += [0, *[1] * (last - 1)]
        own_codes += [code] * last
    if not units:
        return
    laid = _Laid(units)
    names, common, own = _labels(laid.script, places, own_codes)
    hashes = np.array([_label_hash(x) for x in names], np.uint64)
    number = np.array([numbers.setdefault(x, len(numbers)) for x in names], np.int64)
    solid = np.maximum.accumulate(np.where(_of(_BLANK, laid.codes), 0, np.arange(len(laid.codes))))  # units begin with one
    target = solid[laid.place]
    inner = np.ones(len(target), bool)
    inner[laid.last] = False
    cuts = np.bincount(target[inner], minlength=len(laid.codes))
    ends = np.zeros(len(laid.codes), np.int64)
    ends[laid.place[laid.last]] = 1
    used = np.flatnonzero(cuts + ends)
    unit, state = laid.unit[laid.at], laid.state[laid.at]
    of = np.where(own >= 0, own, common)
    whole = _mixed(hashes[of][unit], state)
    for c in laid.backward():
        whole = _mixed(whole, c)
    order = used[np.argsort(whole[used])]
    whole = whole[order]
    first = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]]))
    pick, n = order[first], cuts[order]
    weight = n * (WEIGHT // np.maximum(laid.size - 1, 1))[unit[order]]
    sums.add(whole[first], number[of[unit[pick]]], state[pick], laid.behind(pick), *[np.add.reduceat(x, first) for x in (ends[order], n, weight)])
    firsts = np.flatnonzero(np.array(places) == 0)
    open_end = ~_of(_ENDS, laid.codes[laid.place[laid.last]])
    for i in firsts:
        step, ended = min(int(laid.size[i]) // LENGTHS, LONGEST), int(not open_end[i])
        for label in {int(common[i]), int(own[i])} - {-1}:
            lines[names[label], step, ended] += 1


def _pooled(number: np.ndarray, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The common label of Latin texts for what was counted by language, and where that stands."""
    to = np.full(len(numbers) + 2, -1, np.int64)
    for name, i in list(numbers.items()):
        if name.startswith("la-"):
            to[i] = numbers.setdefault("la|" + name.split("|")[1], len(numbers))
    some = np.flatnonzero(to[number] >= 0)
    return to[number[some]], some


def end_counts(texts: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """what, label, key, level, head, yes, no, seen over all texts (columns text, lang).

    what c: contexts, by their hash and order, with the weights of ends and of cuts; h: beginnings of lines, at the ends of texts
    and elsewhere; l: lengths of first lines (key), without an end mark and with one. ``contexts`` (column key): those that are looked up, each with its
    shorter ones.
    """
    sent = None
    if contexts is not None and contexts.count() <= BROADCAST_CONTEXTS:
        sent = texts.sparkSession.sparkContext.broadcast(np.sort(contexts.toPandas()["key"].to_numpy(np.int64)))  # at most BROADCAST_CONTEXTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence, sums, heads, lines, numbers = Evidence(), _Sums(), Counter(), Counter(), {}

        def out() -> Iterator[pd.DataFrame]:
            if sums.parts:
                sums.merge()
                _, number, state, behind, ends, cuts, weight = sums.parts[0]
                for number, some in ((number, slice(None)), _pooled(number, numbers)):
                    names = sorted(numbers, key=numbers.get)
                    keys = _context_keys(np.array([_label_hash(x) for x in names], np.uint64)[number], state[some], behind[:, some])
                    pick = np.arange(keys.shape[1])
                    for k in range(ORDER):
                        pick = pick[keys[k][pick] != 0]
                        if sent is not None and len(pick):  # what is looked up by a longer context is by its shorter ones, too
                            known, mine = sent.value, keys[k][pick]
                            pick = pick[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine] if len(known) else pick[:0]
                        if not len(pick):
                            break
                        order = pick[np.argsort(keys[k][pick])]
                        key = keys[k][order]
                        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                        e, c, w = (np.add.reduceat(x[some][order], first) for x in (ends, cuts, weight))
                        label = np.array(names, object)[number[order[first]]]
                        yield pd.DataFrame({"what": "c", "label": label, "key": key[first], "level": k + 1, "head": None, "yes": e * WEIGHT, "no": w, "seen": e + c})
            rows = [("h", None, 0, 0, head[: k + 1], int(end) * n, int(not end) * n, n) for (head, end), n in heads.items() for k in range(len(head))]
            rows += [("l", label, step, 0, None, n * (not ended), n * ended, n) for (label, step, ended), n in lines.items()]
            yield pd.DataFrame(rows, columns=["what", "label", "key", "level", "head", "yes", "no", "seen"])
            sums.parts, sums.held = [], 0
            heads.clear()
            lines.clear()

        for pdf in batches:
            some, codes, size = [], [], 0
            for text, lang in zip(pdf["text"], pdf["lang"]):
                if text:
                    some.append(without_torn_end(text))
                    codes.append(_code_of(lang))
                    size += len(text)
                if size > AT_ONCE:
                    _counted(some, codes, evidence, sums, heads, lines, numbers)
                    some, codes, size = [], [], 0
                    if sums.held > 3 * GATHERED // 2:
                        sums.merge()
                        if sums.held > GATHERED:
                            yield from out()
            _counted(some, codes, evidence, sums, heads, lines, numbers)
        yield from out()

    return cut(
        texts.select("text", "lang")
        .mapInPandas(run, "what string, label string, key long, level int, head string, yes long, no long, seen long")
        .groupBy("what", "label", "key", "level", "head")
        .agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("seen").alias("seen"))
        .where((F.col("what") != "c") | (F.col("seen") >= SEEN))
    )


def fitted_thresholds(counts: DataFrame) -> dict[str, float]:
    """label -> the value of log-odds that divides ends and inner places of a language and place with the least error.

    Every occurrence of a whole context is scored by the others of it. Of equal errors the threshold next to 0 is taken. Sums by
    label and step come to the driver: MOST / STEP * 2 + 1 for each language code of two letters and place.
    """
    ends, cuts = F.col("yes") / WEIGHT, F.col("no") / WEIGHT
    inner, top = F.col("seen") - ends, int(MOST / STEP)
    whole = counts.where((F.col("what") == "c") & (F.col("level") == ORDER) & (F.col("seen") > SEEN))
    step = lambda odds: F.greatest(F.least(F.floor(F.log(odds) / STEP), F.lit(top)), F.lit(-top)).cast("int")
    as_end = F.struct(step((ends - 0.5) / (cuts + 0.5)).alias("step"), ends.alias("e"), F.lit(0.0).alias("c"))
    as_cut = F.struct(step((ends + 0.5) / (cuts * (inner - 1) / inner + 0.5)).alias("step"), F.lit(0.0).alias("e"), cuts.alias("c"))
    both = whole.select("label", F.explode(F.array(F.when(ends > 0, as_end), F.when(inner > 0, as_cut))).alias("x")).where("x is not null")
    sums: dict[str, np.ndarray] = {}
    for r in both.groupBy("label", "x.step").agg(F.sum("x.e").alias("e"), F.sum("x.c").alias("c")).collect():
        sums.setdefault(r.label, np.zeros((2, 2 * top + 1)))[:, r.step + top] += (r.e, r.c)
    found = {}
    for label, (e, c) in sums.items():
        if e.sum() >= FITTED:
            error = np.round(np.cumsum(e) - e + np.cumsum(c[::-1])[::-1], 3)
            found[label] = STEP * min(range(-top, top + 1), key=lambda t: (error[t + top], abs(t), t))
    return found


def line_odds(counts: DataFrame) -> dict[str, np.ndarray]:
    """label -> by length step, how much likelier a headline is at least that long than a beginning of a first sentence is.

    LONGEST + 1 sums for each language code of two letters come to the driver.
    """
    sums: dict[str, np.ndarray] = {}
    for r in counts.where("what = 'l'").select("label", "key", "yes", "no").collect():
        sums.setdefault(r.label, np.zeros((2, LONGEST + 1)))[:, r.key] += (r.yes, r.yes + r.no)
    found = {}
    for label, (yes, n) in sums.items():
        longer = lambda x: np.cumsum(x[::-1])[::-1]
        inner = longer(n / (np.arange(LONGEST + 1) + 1))  # a line's inner places are spread evenly over the lengths below its own
        share = lambda x: (longer(x) + 0.5) / (x.sum() + 0.5)
        found[label] = np.minimum.accumulate(np.log(share(yes) / share(inner)))
    return found


def cut_scores(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """key, line, tail_line, order, log_odds (positive: a true end), threshold, and what the log-odds are made of."""
    finals = cut(final_contexts(documents, key, text, lang))
    code = F.col(lang) if lang else F.lit(None).cast("string")
    wanted = cut(finals.select(F.explode("keys").alias("key")).distinct())
    counts = end_counts(spread(documents.select(F.col(text).alias("text"), code.alias("lang"))), wanted)
    contexts = counts.where("what = 'c'").join(wanted, "key", "left_semi")
    heads = counts.where("what = 'h'").groupBy("head").agg(F.sum("yes").alias("at_end"), F.sum("seen").alias("n"))
    tails = heads.where((F.col("at_end") >= TAIL_SEEN) & (F.col("at_end") >= TAIL_SHARE * F.col("n"))).select("head")
    ending = finals.select(key, F.explode("heads").alias("head")).join(tails, "head", "left_semi").select(key).distinct()
    known = (
        finals.select(key, F.explode(F.arrays_zip("keys", "levels")).alias("x"))
        .select(key, F.col("x.keys").alias("key_of"), F.col("x.levels").alias("rank"))
        .join(contexts.select(F.col("key").alias("key_of"), "yes", "no"), "key_of")
        .groupBy(key)
        .agg(F.max(F.struct("rank", "yes", "no")).alias("c"))
    )
    odds = F.log((F.col("c.yes") / WEIGHT + 0.5) / (F.col("c.no") / WEIGHT + 0.5))
    odds = F.coalesce(odds, F.when(F.col("label").endswith("first"), MOST).otherwise(-math.inf))  # no sentence ends like this: strange in a text of many
    thresholds, lengths = fitted_thresholds(contexts), line_odds(counts)
    threshold = F.create_map(*[F.lit(x) for pair in sorted(thresholds.items()) for x in pair])[F.col("label")] if thresholds else F.lit(None)
    length = F.create_map(*[F.lit(x) for k, v in sorted(lengths.items()) for x in (k, v.tolist())])[F.col("label")][F.col("line")] if lengths else F.lit(None)
    scored = cut(
        finals.select(key, "label", "line")
        .join(known, key, "left")
        .join(ending.withColumn("tail_line", F.lit(True)), key, "left")
        .select(
            key, "line", F.coalesce("tail_line", F.lit(False)).alias("tail_line"), F.coalesce(F.floor(F.col("c.rank") / 2), F.lit(0)).alias("order"),
            odds.alias("context"), F.coalesce(length, F.lit(0.0)).alias("length"), F.coalesce(threshold, F.lit(0.0)).alias("threshold"),
        )
    )
    is_cut = ~F.col("tail_line") & (F.col("context") < F.col("threshold"))
    seen = scored.agg(F.count("*").alias("n"), F.count("line").alias("lines"), F.count(F.when(F.col("line").isNull() & is_cut, 1)).alias("found"))
    units = counts.where("what = 'h' and length(head) = 1").agg(F.sum("yes").alias("texts"), F.sum("seen").alias("units"))
    expected = F.col("n") * F.col("found") / F.greatest(F.col("n") - F.col("lines"), F.lit(1)) * F.coalesce(F.col("texts") / F.col("units"), F.lit(1.0))
    prior = seen.crossJoin(units).select(F.log((F.greatest(F.lit(0), F.col("lines") - expected) + HEADLINES) / (F.least(expected, F.col("lines")) + 1)).alias("prior"))  # one row each
    told = F.when(F.col("order") > 0, F.col("context") * F.pow(F.lit(0.25), ORDER - F.col("order"))).otherwise(0.0)
    line = told + F.col("length") + F.col("prior")
    return scored.crossJoin(F.broadcast(prior)).select(
        key, "line", "tail_line", "order", F.when(F.col("line").isNull(), F.col("context")).otherwise(line).alias("log_odds"), "threshold", "context", "length", "prior"
    )


def cut_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None) -> DataFrame:
    """``key`` of every text that was cut inside a sentence."""
    return cut_scores(documents, key, text, lang).where("not tail_line and log_odds < threshold").select(key).distinct()


def cuts_by_source(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str | None = None) -> DataFrame:
    """source (null kept as a group), n, n_cut, share of cut texts."""
    found = cut_documents(documents, key, text, lang).withColumn("is_cut", F.lit(1))
    return (
        documents.select(key, source)
        .join(found, key, "left")
        .groupBy(source)
        .agg(F.count("*").alias("n"), F.count("is_cut").alias("n_cut"))
        .withColumn("share", F.round(F.col("n_cut") / F.col("n"), 4))
    )
