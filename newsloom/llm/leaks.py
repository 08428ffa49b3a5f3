"""Evaluation passages that stand in corpus documents.

Method: winnowing. Both sides are brought to letters and digits only, in one form and case folded. Of every window of
``w`` consecutive k-gram hashes the least is kept, so any shared span of at least k + w - 1 characters shares a kept
hash. Kept hashes of corpus and items are joined and every hit is extended to the whole common run.

Items in Chinese or Japanese need a run of ``WIDE`` characters, all others one of ``NARROW``; each class has its own
k and w with k + w - 1 equal to that run, so no long enough run is missed.

Defined results: null, empty and symbol-only texts match nothing; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.textform import one_form
from newsloom.plans.runtime import cut, spread

WIDE, NARROW = 40, 90
#: Kept hashes of the items that may be sent to every worker (8 bytes each); more are joined by a shuffle instead.
BROADCAST_HASHES = 500_000

_NOT_WORD = re.compile(r"[\W_]+")
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿]")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """Letters and digits of a text in one form, case folded."""
    return _NOT_WORD.sub("", one_form(text)) if text else ""


def is_wide(text: str) -> bool:
    """Whether a letters-only text is Chinese or Japanese: a third or more of it in those scripts."""
    return len(_CJK.findall(text)) * 3 >= len(text) > 0


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams by doubling: h(2m)[i] = h(m)[i] * B^m + h(m)[i + m]."""
    with np.errstate(over="ignore"):
        power, m, have = _BASE, 1, None
        block = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        done = 0
        while True:
            if k & m:
                have = block if have is None else have[: len(codes) - done - m + 1] * power + block[done : len(codes) - m + 1]
                done += m
            m *= 2
            if m > k:
                break
            half = m // 2
            block = block[: len(block) - half] * power + block[half:]
            power = power * power
        have = (have ^ (have >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return have ^ (have >> np.uint64(29))


def _sliding(values: np.ndarray, w: int, keep) -> np.ndarray:
    """``keep`` (np.minimum or np.maximum) over every window of w values."""
    out, size = values, 1
    while size < w:
        step = min(size, w - size)
        out = keep(out[: len(out) - step], out[step:])
        size += step
    return out


def winnow(codes: np.ndarray, owner: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams of many texts laid end to end; ``owner`` tells the text of each code.

    Windows never reach over two texts. A text with fewer than k + w - 1 characters keeps nothing: it can't hold a run.
    """
    if len(codes) < k + w - 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _grams(codes, k)
    least = _sliding(h, w, np.minimum)
    whole = owner[: len(least)] == owner[k + w - 2 : k + w - 2 + len(least)]
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    most = _sliding(padded, w, np.maximum)
    at = np.nonzero(most == h)[0]
    return at, h[at]


def _classes() -> tuple[tuple[str, int, int], ...]:
    return (("wide", WIDE // 2, WIDE - WIDE // 2 + 1), ("narrow", NARROW // 2, NARROW - NARROW // 2 + 1))


def _laid(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _fingerprints(texts: list[str], kind: str, k: int, w: int, items: bool, wide_only: bool = False) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Owner number, position and hash of every kept gram. With ``wide_only`` corpus texts without a wide letter skip the wide class."""
    if items:
        chosen = [i for i, t in enumerate(texts) if is_wide(t) == (kind == "wide")]
    else:
        least = k + w - 1
        chosen = [i for i, t in enumerate(texts) if len(t) >= least and (kind != "wide" or not wide_only or _CJK.search(t))]
    codes, owner = _laid([texts[i] for i in chosen])
    at, h = winnow(codes, owner, k, w)
    starts = np.concatenate([[0], np.cumsum([len(texts[i]) for i in chosen])]).astype(np.int64)
    who = owner[at] if len(at) else np.empty(0, np.int64)
    return [chosen[j] for j in who], at - starts[who] if len(at) else at, h


def longest_run(a: str, b: str, a_at: list[int], b_at: list[int], k: int) -> int:
    """The longest common run that any of the hits extends to; hits on a diagonal that was already covered are skipped."""
    best, covered = 0, {}
    for i, j in sorted(zip(a_at, b_at)):
        if i < 0 or j < 0 or a[i : i + k] != b[j : j + k] or covered.get(i - j, -1) >= i:
            continue
        left = 0
        while i - left > 0 and j - left > 0 and a[i - left - 1] == b[j - left - 1]:
            left += 1
        right = k
        while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
            right += 1
        covered[i - j] = i + right - 1
        best = max(best, left + right)
    return best


def item_prints(items: DataFrame) -> DataFrame:
    """item_id, letters, kind, k, hash, at: kept grams of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [letters(t) for t in pdf["text"]]
            ids = pdf["item_id"].to_numpy()
            for kind, k, w in _classes():
                who, at, h = _fingerprints(texts, kind, k, w, True)
                yield pd.DataFrame({"item_id": ids[who], "kind": kind, "hash": h.view(np.int64), "item_at": at})

    return items.where("text is not null").select("item_id", "text").mapInPandas(run, "item_id long, kind string, hash long, item_at long")


def _letters_column():
    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return pd.Series([letters(t) for t in texts], dtype=object)

    return convert


def _wide_only(texts: list[str]) -> bool:
    """Whether every long enough run of a wide item has a wide letter, so that documents without one can't share it."""
    return not any(is_wide(t) and len(part) >= WIDE for t in texts for part in _CJK.split(t))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, run: the longest common run of every document and item that share one long enough.

    Where the items' kept hashes are few (BROADCAST_HASHES; their letters then are, too, as every window of a text keeps one) they
    go to the workers with the letters, and the corpus is read once: a document's hits are looked up and extended where it is
    read, and only pairs come out. More are joined by hash; then the letters of documents with a hit are read a second time.
    """
    spark = documents.sparkSession
    prints = cut(item_prints(items))
    n = prints.count()
    size = {kind: k for kind, k, _ in _classes()}
    rows = spread(documents.where("text is not null").select("doc_id", "text"))
    result = "doc_id long, item_id long, kind string, run int"
    if n == 0:
        return spark.createDataFrame([], "doc_id long, item_id long, run int")
    if n <= BROADCAST_HASHES:
        held = prints.toPandas()  # at most BROADCAST_HASHES
        known = prints.select("item_id").distinct()
        texts = [(r.item_id, letters(r.text)) for r in items.where("text is not null").join(known, "item_id", "left_semi").select("item_id", "text").distinct().collect()]
        by_item: dict[int, list[str]] = {}
        for item, text in texts:
            by_item.setdefault(item, []).append(text)
        tables = {}
        for kind, part in held.groupby("kind"):
            part = part.sort_values("hash", kind="stable")
            tables[kind] = (part["hash"].to_numpy(), part["item_id"].to_numpy(), part["item_at"].to_numpy())
        sent = spark.sparkContext.broadcast((tables, by_item, _wide_only([t for _, t in texts])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tables, by_item, wide_only = sent.value
            for pdf in batches:
                texts, ids, out = [letters(t) for t in pdf["text"]], pdf["doc_id"].to_numpy(), []
                for kind, k, w in _classes():
                    if kind not in tables:
                        continue
                    hashes, item_ids, item_at = tables[kind]
                    who, at, h = _fingerprints(texts, kind, k, w, False, wide_only)
                    h = h.view(np.int64)
                    low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                    hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
                    for i in np.nonzero(high > low)[0]:
                        for j in range(low[i], high[i]):
                            hits.setdefault((who[i], int(item_ids[j])), []).append((int(at[i]), int(item_at[j])))
                    for (i, item), places in hits.items():
                        best = max(longest_run(texts[i], b, [x for x, _ in places], [y for _, y in places], k) for b in by_item[item])
                        out.append((ids[i], item, kind, best))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "kind", "run"])

        found = rows.mapInPandas(run, result)
    else:

        def fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                texts, ids = [letters(t) for t in pdf["text"]], pdf["doc_id"].to_numpy()
                for kind, k, w in _classes():
                    who, at, h = _fingerprints(texts, kind, k, w, False, False)
                    if len(h):
                        yield pd.DataFrame({"doc_id": ids[who], "kind": kind, "hash": h.view(np.int64), "doc_at": at})

        hits = cut(
            rows.mapInPandas(fingerprints, "doc_id long, kind string, hash long, doc_at long")
            .join(prints, ["kind", "hash"])
            .groupBy("doc_id", "item_id", "kind", (F.col("doc_at") - F.col("item_at")).alias("diagonal"))
            .agg(F.array_sort(F.collect_set("doc_at")).alias("at"))
        )  # a diagonal has no more hits than the item has windows
        convert = _letters_column()
        docs = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("text").alias("doc_text")).where("doc_text is not null").distinct()
        both = (
            hits.join(docs, "doc_id")
            .join(items.select("item_id", F.col("text").alias("item_text")).where("item_text is not null").distinct(), "item_id")
            .select("doc_id", "item_id", "kind", "diagonal", "at", convert("doc_text").alias("a"), convert("item_text").alias("b"))
        )

        def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                runs = [longest_run(r.a, r.b, list(r.at), [i - r.diagonal for i in r.at], size[r.kind]) for r in pdf.itertuples()]
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "item_id": pdf["item_id"], "kind": pdf["kind"], "run": runs})

        found = both.mapInPandas(extend, result)
    return found.where(F.col("run") >= F.when(F.col("kind") == "wide", WIDE).otherwise(NARROW)).groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))
