"""Linking the many spellings of a typed name to its entity.

Method: noisy-channel attribution. The canonical forms are the entities' names, ranked by how often each entity is linked
(the prior). A typed form is explained by a channel: script, spacing and case; titles; shortened or rewritten endings; dropped,
moved or bracketed heads; nicknames, initials, acronyms; romanisation; homophones; single typing errors. What each channel
does (which syllable a character is romanised to, which nickname stands for a name, which endings shorten to what) is learned
from the forms already linked and from the alias table, by counting, and so is how likely each channel is: the linked forms
that it explains, against those typed as the name is. Each form is attached to the entity of
maximum posterior; entities named in the same article weigh more, and forms without a clearly best entity stay unlinked.

Typed forms are resolved once per distinct form, by an equi-join on channel keys: both sides write keys, nothing is compared
with everything. Foldings of characters are sent to the workers; so are the other learned rewritings up to LEARNED, and beyond
that each name and form gets those that can matter to it by a join, with the same result.

Defined results: null and empty forms, and forms the alias table knows to be unlinkable, get no row; repeated rows count once;
empty tables give no rows. Null names of entities are skipped; columns other than those named are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.textform import one_form
from newsloom.plans.runtime import cut, shuffled, spread

#: Natural logarithms of how likely a channel is, relative to typing the name as it is: what counting starts from, as if STRENGTH
#: linked forms had shown it. Of several channels that explain a form the likeliest by these is counted.
STRENGTH = 50
CHANNEL = {
    "exact": 0.0, "seen": -0.2, "title": -1.0, "bag": -0.8, "tail": -1.0, "head": -1.5, "roman": -1.2, "nick": -1.2, "middle": -1.0,
    "sound": -2.0, "typo": -2.5, "initial": -2.2, "given": -2.5, "last": -2.8, "acronym": -2.5, "short": -1.8,
}
#: Channels that leave no doubt where only one entity is left.
PLAIN = ("exact", "seen", "title", "bag", "tail", "roman", "nick", "middle")
#: Learned rewritings that may come to the driver; if there are more, they are joined to names and forms instead.
LEARNED = 200_000
#: Characters of a title, at most.
TITLE = 5
#: Added where the entity is named otherwise in the same article.
SAME_ARTICLE = 4.0
#: A form is linked if its best entity has at least this share of the posterior of all its candidates.
SURE = 0.6
#: Learned rewritings must have been seen with so many different entities.
LEAST = 2

_HAN = re.compile("[㐀-鿿]")
_DROPPED = re.compile(r"[\s·・,，.、'’\"“”‘「」『』《》-]+")
_LATIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LITTLE = frozenset("the of and".split())


def _han_only(text: str) -> bool:
    return bool(_HAN.search(text))


class Model:
    """What was learned: character folding, romanisation, titles, nicknames, endings and abbreviations."""

    def __init__(self, counts: Iterable[tuple[str, str, str, int]], fold: dict[str, str] | None = None):
        by: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        for what, a, b, n in counts:
            by[what][a][b] += n
        self.fold = {a: max(c, key=lambda x: (c[x], x)) for a, c in by["fold"].items()} if fold is None else fold
        self.given = self._readings(by["given"])
        self.family = self._readings(by["family"])
        self.titles = sorted(by["title"], key=lambda t: (-len(t), t))
        self.nick = {a: set(c) for a, c in by["nick"].items()}
        self.full: dict[str, set[str]] = defaultdict(set)
        for a, nicks in self.nick.items():
            for b in nicks:
                self.full[b].add(a)
        for b, c in by["full"].items():
            self.full[b].update(c)
        self.tails = {a: set(c) for a, c in by["tail"].items()}
        self.words = {a: max(c, key=lambda x: (c[x], x)) for a, c in by["word"].items()}
        self.types = sorted(by["type"], key=len, reverse=True)

    @staticmethod
    def _readings(table: dict[str, Counter]) -> dict[str, list[str]]:
        return {a: [b for b, n in sorted(c.items(), key=lambda x: (-x[1], x[0])) if n >= 0.2 * sum(c.values())] for a, c in table.items()}

    def plain(self, text: str) -> str:
        """One form, variants of a character folded, blanks and small marks left out, lower case."""
        text = one_form(text, False)
        text = "".join(self.fold.get(c, c) for c in text)
        return _DROPPED.sub("", text).casefold()

    def type_of(self, plain: str) -> str:
        """The kind of body or place at the end of a plain name, as far as one is known."""
        return next((t for t in self.types if plain.endswith(t) and len(plain) - len(t) >= 2), "")

    def without_title(self, plain: str) -> str | None:
        for t in self.titles:
            if len(plain) - len(t) >= 2:
                if plain.startswith(t):
                    return plain[len(t) :]
                if plain.endswith(t):
                    return plain[: -len(t)]
        return None


def _words(text: str) -> list[str]:
    return [w.lower() for w in _LATIN_WORD.findall(one_form(text, False))]


def _initials_of_words(words: list[str]) -> str:
    return "".join(w[0] for w in words if w not in _LITTLE)


def _deletions(text: str) -> set[str]:
    return {text} | {text[:i] + text[i + 1 :] for i in range(len(text))}


def one_error(a: str, b: str) -> bool:
    """Whether two strings differ by one inserted, lost, changed or swapped character."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _solid_forms(model: Model, words: list[str]) -> list[str]:
    """The words without blanks, and the same with each full name that a nickname in front may stand for."""
    plain = [w for w in words if w not in _LITTLE]
    full = sorted(model.full.get(plain[0], ())) if plain else []
    return ["".join(plain), *["".join([f, *plain[1:]]) for f in full]]


def _sound_keys(model: Model, name: str, wild: bool) -> list[str]:
    """Keys of a three- or two-character personal name with the reading of one given character in place of it."""
    keys = []
    for i in range(1, len(name)):
        for r in model.given.get(name[i], ()):
            keys.append(f"sound|{name[:i]}{r}{name[i + 1:]}|{i}")
    return keys


def name_keys(model: Model, etype: str, name: str) -> list[tuple[str, str]]:
    """(key, channel) of everything the channels can make of an entity's name."""
    p = model.plain(name)
    if not p:
        return []
    keys = [(f"p|{p}", "exact")]
    if _han_only(p):
        if etype == "PER":
            if 3 <= len(p) <= 4:
                keys.append((f"p|{p[1:]}", "given"))
            keys += [(k, "sound") for k in _sound_keys(model, p, False)]
            # names of four characters or fewer are romanised by syllables, with every reading; of longer ones each character's first
            givens = [""]
            for c in p[1:]:
                readings = model.given.get(c, ())
                givens = [g + r for g in givens for r in (readings if len(p) <= 4 else readings[:1])]
            firsts = [model.given.get(c, ()) for c in p[1:]]
            for f in model.family.get(p[0], ()):
                keys += [(f"r|{f}|{g}", "roman") for g in givens if g]
                if all(firsts):
                    for a in {r[0] for r in firsts[0]}:
                        for b in {r[0] for r in firsts[1]} if len(firsts) > 1 else {""}:
                            keys.append((f"i|{f}|{a}{b}", "initial"))
        else:
            kind = model.type_of(p)
            core = p[: len(p) - len(kind)]
            tails = {kind} | model.tails.get(kind, set())
            for t in tails:
                base = "exact" if t == kind else "tail"
                if t != kind:
                    keys.append((f"p|{core}{t}", base))
                if len(core) == 4:
                    head, rest = core[:2], core[2:]
                    keys += [(f"p|{rest}{t}", "head"), (f"p|{rest}{head}{t}", "head"), (f"p|{rest}{t}({head})", "head")]
                keys.append((f"p|大{core}{t}", "head"))
        return keys
    words = _words(name)
    solid = "".join(words)
    if etype == "PER":
        if len(words) >= 2:
            first, last = words[0], words[-1]
            keys.append((f"b|{' '.join(sorted(words))}", "bag"))
            for n in model.nick.get(first, ()):
                keys.append((f"b|{' '.join(sorted([n, *words[1:]]))}", "nick"))
            keys += [(f"i|{last}|{first[0]}", "initial"), (f"l|{last}", "last")]
            keys += [(f"d|{x}", "typo") for x in _deletions(solid)]
    else:
        content = [w for w in words if w not in _LITTLE]
        keys.append((f"b|{' '.join(sorted(content))}", "bag"))
        if len(content) >= 3:
            keys.append((f"a|{_initials_of_words(words)}", "acronym"))
        if len(content) >= 3:
            keys.append((f"s|{content[0]} {content[1]} {content[-1]}", "short"))
        keys += [(f"d|{x}", "typo") for x in _deletions("".join(content))]
    return keys


def form_keys(model: Model, form: str) -> list[tuple[str, str]]:
    """(key, channel) under which a typed form looks for its entity."""
    p = model.plain(form)
    if not p:
        return []
    keys = [(f"p|{p}", "exact")]
    if _han_only(p):
        rest = model.without_title(p)
        if rest:
            keys.append((f"p|{rest}", "title"))
        for q in {p, rest} - {None}:
            if 2 <= len(q) <= 4:
                keys += [(k, "exact" if q == p else "title") for k in _sound_keys(model, q, True)]
        return keys
    words = _words(form)
    if not words:
        return keys
    raw = one_form(form, False)
    if len(words) >= 2:
        long = [w for w in words if len(w) > 1]
        single = [w for w in words if len(w) == 1]
        keys.append((f"b|{' '.join(sorted(w for w in words if w not in _LITTLE))}", "exact"))
        if single and len(long) >= 2:
            keys.append((f"b|{' '.join(sorted(long))}", "middle"))
        if single and len(long) == 1:
            keys.append((f"i|{long[0]}|{''.join(single)}", "exact"))
        keys += [(f"r|{words[0]}|{''.join(words[1:])}", "exact"), (f"r|{words[-1]}|{''.join(words[:-1])}", "exact")]
        content = [model.words.get(w, w) for w in words if w not in _LITTLE]
        if content != [w for w in words if w not in _LITTLE]:
            keys.append((f"b|{' '.join(sorted(content))}", "title"))
        if len(content) >= 3:
            keys.append((f"s|{content[0]} {content[1]} {content[-1]}", "exact"))
        if len(words) == 2 and words[0] in ("dr", "prof", "mr", "mrs", "ms"):
            keys.append((f"l|{words[1]}", "exact"))
        for i, solid in enumerate(_solid_forms(model, words)):
            if len(solid) >= 8:
                keys += [(f"d|{x}", "nick" if i else "exact") for x in _deletions(solid)]
    elif raw.isupper() and 3 <= len(raw) <= 6:
        keys.append((f"a|{raw.lower()}", "exact"))
    return keys


def _lessons(model: Model, form: str, etype: str, name: str) -> Iterator[tuple[str, str, str]]:
    """What one linked form teaches: (what, from, to)."""
    p, q = model.plain(form), model.plain(name)
    if not p or not q or p == q:
        return
    if _han_only(q):
        if _han_only(p):
            if etype == "PER":
                if len(q) >= 3 and q in p and len(p) - len(q) <= TITLE:
                    extra = p.replace(q, "", 1)
                    if p.startswith(q) or p.endswith(q):
                        yield "title", extra, ""
            else:
                kind = model.type_of(q)
                core = q[: len(q) - len(kind)]
                if kind and p.startswith(core) and p[len(core) :] != kind and len(p) <= len(q) + 3:
                    yield "tail", kind, p[len(core) :]
        elif etype == "PER":
            words = _words(form)
            if len(words) == len(q) and all(len(w) > 1 for w in words):
                hyphen = "-" in form
                first_is_family = "," in form or (hyphen and form.rindex("-") > form.rstrip().rfind(" "))
                order = words if first_is_family else [words[-1], *words[:-1]]
                if hyphen or "," in form:
                    yield "family", q[0], order[0]
                    for c, r in zip(q[1:], order[1:]):
                        yield "given", c, r
        return
    a, b = _words(form), _words(name)
    if etype == "PER":
        if len(a) == len(b) == 2 and a[1] == b[1] and a[0] != b[0] and len(a[0]) > 1 and not one_error(a[0], b[0]):
            yield "nick", b[0], a[0]
    else:
        a, b = [w for w in a if w not in _LITTLE], [w for w in b if w not in _LITTLE]
        if len(a) >= 2 and a[:2] == b[:2] and a[-1] != b[-1] and "." in form and b[-1].startswith(a[-1][0]):
            yield "word", a[-1], b[-1]


def _type_lessons(name: str) -> Iterator[tuple[str, str, str]]:
    for core in (2, 4):
        if len(name) > core:
            yield "type", name[core:], ""


def _asked(model: Model, text: str, named: bool) -> set[tuple[str, str]]:
    """(what, from) of all learned rewritings that the keys and lessons of a text, an entity's name or a form, can depend on."""
    asked = {(what, w) for w in _words(text) for what in ("nick", "full", "word")}
    p = model.plain(text)
    if _han_only(p):
        asked |= {(what, c) for c in p for what in ("given", "family")}
        asked |= {("title", t) for k in range(1, min(TITLE, len(p) - 2) + 1) for t in (p[:k], p[-k:])}
        if named:
            asked |= {(what, p[k:]) for k in range(2, len(p)) for what in ("type", "tail")}
    return asked


def _known(sent, pdf: pd.DataFrame) -> Model:
    """The broadcast model, with the rewritings that a batch brings along where they are not in it."""
    if "learned" not in pdf:
        return sent.value
    rows = {(x["what"], x["a"], x["b"], x["n"]) for own in pdf["learned"] if own is not None for x in own}
    return Model(rows, sent.value.fold)


class Lore:
    """All that was learned: foldings (a row for each character) and rewritings (what, a, b, n), in a broadcast model or as a table."""

    def __init__(self, folds: list[tuple[str, str, str, int]], learned: DataFrame):
        learned = cut(learned)
        few = learned.count() <= LEARNED
        rows = [tuple(r) for r in learned.collect()] if few else []  # at most LEARNED
        self.sent = learned.sparkSession.sparkContext.broadcast(Model([*folds, *rows]))
        full = learned.where("what = 'nick'").select(F.lit("full").alias("what"), F.col("b").alias("a"), F.col("a").alias("b"), "n")
        self.more = None if few else learned.unionByName(full)

    def attach(self, rows: DataFrame, text: str, named: bool) -> DataFrame:
        """``rows``, with the rewritings that the column ``text`` can depend on as ``learned`` if they are not in the broadcast model."""
        if self.more is None:
            return rows
        sent = self.sent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame([(t, *x) for t in pdf["t"] for x in _asked(sent.value, t, named)], columns=["t", "what", "a"])

        asked = rows.select(F.col(text).alias("t")).distinct().mapInPandas(run, "t string, what string, a string")
        found = asked.join(shuffled(self.more), ["what", "a"]).groupBy("t").agg(F.collect_list(F.struct("what", "a", "b", "n")).alias("learned"))
        return rows.join(shuffled(found.withColumnRenamed("t", text)), text, "left")


def learn(entities: DataFrame, linked: DataFrame) -> Lore:
    """What entities (eid, etype, name, name_cht) and linked forms (form, eid) teach.

    Counted in the workers, then by key; rewritings seen with fewer than LEAST different entities are left out.
    """

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: Counter = Counter()
            for s, t in zip(pdf["name"], pdf["name_cht"]):
                s, t = one_form(s, False), one_form(t, False)
                if len(s) == len(t):
                    found.update((b, a) for a, b in zip(s, t) if _HAN.match(b))
            yield pd.DataFrame([("fold", a, b, n) for (a, b), n in found.items()], columns=["what", "a", "b", "n"])

    schema = "what string, a string, b string, n long"
    both = entities.where("name is not null and name_cht is not null").select("name", "name_cht")
    folded = both.mapInPandas(folds, schema).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    most = folded.groupBy("what", "a").agg(F.max(F.struct("n", "b")).alias("x")).select("what", "a", "x.b", "x.n")
    pairs = [tuple(r) for r in most.collect()]  # a row for each Han character
    model = Model(pairs)

    def types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [x for n in pdf["name"] if _han_only(n) for x in _type_lessons(model.plain(n))]
            yield pd.DataFrame([(w, a, b, 1) for w, a, b in rows], columns=["what", "a", "b", "n"])

    bodies = entities.where("name is not null and etype <> 'PER'").select("name")
    kinds = cut(bodies.mapInPandas(types, schema).groupBy("what", "a", "b").agg(F.sum("n").alias("n")).where("n >= 8"))  # each held by many entities
    lore = Lore(pairs, kinds)
    sent = lore.sent

    def lessons(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = _known(sent, pdf)
            rows = [(*x, e) for f, e, t, n in zip(pdf["form"], pdf["eid"], pdf["etype"], pdf["name"]) for x in _lessons(known, f, t, n)]
            yield pd.DataFrame(rows, columns=["what", "a", "b", "eid"])

    shown = linked.join(entities.where("name is not null").select("eid", "etype", "name"), "eid").select("form", "eid", "etype", "name")
    taught = (
        lore.attach(shown, "name", True)
        .mapInPandas(lessons, "what string, a string, b string, eid string")
        .groupBy("what", "a", "b")
        .agg(F.countDistinct("eid").alias("n"))
        .where(F.col("n") >= LEAST)
    )
    return Lore(pairs, kinds.unionByName(taught))


def _keyed(rows: DataFrame, lore: Lore, make: Callable, columns: list[str], carry: str) -> DataFrame:
    """``carry``, key, channel: the keys that ``make`` gives, each with its likeliest channel; the last of ``columns`` is the text."""
    sent = lore.sent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = _known(sent, pdf)
            out = []
            for values in pdf[columns].itertuples(index=False):
                best: dict[str, str] = {}
                for key, channel in make(known, *values[1:]):
                    if key not in best or CHANNEL[channel] > CHANNEL[best[key]]:
                        best[key] = channel
                out += [(values[0], k, c) for k, c in best.items()]
            yield pd.DataFrame(out, columns=[carry, "key", "channel"])

    return lore.attach(rows.select(*columns), columns[-1], make is name_keys).mapInPandas(run, f"{carry} string, key string, channel string")


def _costs(values: dict[str, float], channel: str):
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col(channel)]


def candidates(forms: DataFrame, entities: DataFrame, linked: DataFrame, lore: Lore) -> DataFrame:
    """form, eid, typed, made: the entities each form (one row per form) may name, with the channels of form and name that are likeliest."""
    sent = lore.sent
    names = entities.select("eid", "etype", F.explode(F.array("name", "name_cht")).alias("name")).where("name is not null").distinct()
    ours = _keyed(names, lore, name_keys, ["eid", "etype", "name"], "eid").withColumnRenamed("channel", "made")
    theirs = _keyed(spread(forms.withColumn("text", F.col("form"))), lore, form_keys, ["form", "text"], "form").withColumnRenamed("channel", "typed")

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        known = sent.value
        return texts.map(lambda t: known.plain(t))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solid = lambda t: "".join(w for w in _words(t) if w not in _LITTLE)
        for pdf in batches:
            known = _known(sent, pdf)
            kept = [any(one_error(x, solid(b)) for x in _solid_forms(known, _words(a))) for a, b in zip(pdf["form"], pdf["name"])]
            yield pdf.loc[kept, ["form", "eid", "typed", "made"]]

    met = theirs.join(ours, "key").select("form", "eid", "typed", "made", F.col("key").startswith("d|").alias("edited"))
    clean = met.where("not edited").select("form", "eid", "typed", "made")
    edited = met.where("edited").select("form", "eid", "typed", "made").distinct().join(names.select("eid", "name").distinct(), "eid")
    typo = lore.attach(edited.select("form", "eid", "typed", "made", "name"), "form", False).mapInPandas(near, "form string, eid string, typed string, made string")
    seen = (
        forms.select("form", plain("form").alias("p"))
        .where("p <> ''")
        .join(linked.select(plain("form").alias("p"), "eid").distinct(), "p")
        .select("form", "eid", F.lit("seen").alias("typed"), F.lit("exact").alias("made"))
    )
    cost = _costs(CHANNEL, "typed") + _costs(CHANNEL, "made")
    ranked = clean.unionByName(typo).unionByName(seen).withColumn("x", F.struct(cost.alias("cost"), "typed", "made", (F.col("typed") == "seen").alias("seen")))
    best = ranked.groupBy("form", "eid").agg(F.max("x").alias("x"), F.max(F.when(F.col("typed") != "seen", F.col("x"))).alias("own"))
    return best.select("form", "eid", "x.typed", "x.made", F.col("own.typed").alias("own_typed"), F.col("own.made").alias("own_made"))


def learned_costs(found: DataFrame, linked: DataFrame) -> dict[str, float]:
    """Logarithms of how likely each channel is, from the linked forms (form, eid, once each) among ``found``; at most a row for each pair of channels comes to the driver."""
    counted = found.where("own_typed is not null").join(linked, ["form", "eid"]).groupBy("own_typed", "own_made").agg(F.count("*").alias("n")).collect()
    n: Counter = Counter()
    for r in counted:
        for channel in {r.own_typed, r.own_made} - {"exact"} or {"exact"}:
            n[channel] += r.n
    whole = n["exact"] + STRENGTH
    learned = {c: min(0.0, math.log((n[c] + STRENGTH * math.exp(v)) / whole)) for c, v in CHANNEL.items()}
    return learned | {"exact": 0.0, "seen": CHANNEL["seen"]}


def link_variants(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """aid, sidx, eidx, wikiID for every mention without a wikiID whose form names an entity with a Q identifier."""
    known = entities.where("eid like 'Q%'").select("eid", "etype", "name", "name_cht")
    rows = mentions.select("aid", "sidx", "eidx", "form", "wikiID").where("form is not null and form <> ''").distinct()
    named = aliases.where("form is not null and eid like 'Q%'").select("form", "eid")
    linked_rows = rows.where("wikiID is not null").select("aid", "form", F.col("wikiID").alias("eid"))
    linked = cut(linked_rows.select("form", "eid").unionByName(named).distinct())
    lore = learn(known, linked)
    unlinkable = aliases.groupBy("form").agg(F.max(F.coalesce("eid", F.lit(""))).alias("most")).where("most = ''").select("form")
    open_rows = rows.where("wikiID is null").join(F.broadcast(unlinkable) if _is_small(unlinkable) else unlinkable, "form", "left_anti")
    taught = linked_rows.select("form", "eid").distinct()
    forms = open_rows.select("form").unionByName(taught.select("form")).distinct()
    found = cut(candidates(forms, known, linked, lore))
    costs = learned_costs(found, taught)
    prior = linked_rows.groupBy("eid").agg(F.count("*").alias("n"))
    cost = _costs(costs, "typed") + _costs(costs, "made")
    score = cost + F.log(F.coalesce("n", F.lit(0)) + 2.0) * 0.5
    plain = F.col("typed").isin(*PLAIN) & F.col("made").isin(*PLAIN) & ((F.col("typed") == "exact") | (F.col("made") == "exact") | (F.col("typed") == "seen"))
    alone = Window.partitionBy("form")
    scored = found.join(open_rows.select("form").distinct(), "form", "left_semi").join(prior, "eid", "left").select("form", "eid", F.exp(score).alias("w"), plain.alias("plain"))
    scored = cut(scored.withColumns({"many": F.count("*").over(alone), "whole": F.sum("w").over(alone)}))
    certain = scored.where("many = 1 and plain").select("form", "eid")
    present = linked_rows.select("aid", "eid").unionByName(open_rows.join(certain, "form").select("aid", "eid")).distinct()
    # a form is decided once where its article names none of its candidates otherwise, else once for the article
    general = scored.where(F.col("w") >= SURE * F.col("whole")).select("form", F.col("eid").alias("usual"))
    several = scored.where("many > 1").select("form", "eid", "w", "whole")
    there = open_rows.select("aid", "form").distinct().join(several, "form").join(present, ["aid", "eid"])
    more = F.col("w") * (math.exp(SAME_ARTICLE) - 1)
    local = there.groupBy("aid", "form").agg((F.first("whole") + F.sum(more)).alias("all"), F.max(F.struct((F.col("w") + more).alias("w"), "eid")).alias("top"))
    local = local.select("aid", "form", F.when(F.col("top.w") >= SURE * F.col("all"), F.col("top.eid")).alias("here"), F.lit(True).alias("decided"))
    chosen = open_rows.join(general, "form", "left").join(local, ["aid", "form"], "left")
    eid = F.when(F.col("decided"), F.col("here")).otherwise(F.col("usual"))
    return chosen.select("aid", "sidx", "eidx", eid.alias("eid")).where("eid is not null").groupBy("aid", "sidx", "eidx").agg(F.min("eid").alias("wikiID"))


#: Forms known to be unlinkable that may be sent to every executor.
BROADCAST_FORMS = 100_000


def _is_small(forms: DataFrame) -> bool:
    return forms.limit(BROADCAST_FORMS + 1).count() <= BROADCAST_FORMS
