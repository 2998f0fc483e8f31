"""Evaluation texts leaking into training text: pigeonhole edit matching.

A document gives an item away if it holds a window of at least ``min_words``
consecutive item words with at most ``rate`` of them changed, added or left
out. A window of W words with budget e = floor(rate * W) is split into e + 1
pieces, one of which must occur unchanged; the shortest such piece over all
windows gives the length of the word grams that are looked up. Only windows
around exact piece hits are verified, with Myers' bit-parallel distance over
words (one bit per item word).

Words are runs of letters and digits in lower case, so case, punctuation,
spacing and line marks do not matter. Items of fewer than ``min_words`` words
give no case.

Scale: one pass over the corpus without a shuffle. Item sets are cut into
batches of at most ``BATCH_WORDS`` words and each batch is broadcast, so what
is broadcast is bounded; the number of passes grows with the item set only.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, once

WORD = re.compile(r"[^\W_]+")
BATCH_WORDS = 1_000_000
#: answers and bit masks a task keeps for texts that come again
KEPT = 10_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def piece_length(min_words: int, rate: float) -> int:
    """Shortest intact run that any window within its budget must hold."""
    best = min_words
    for w in range(min_words, 20 * min_words):
        e = int(w * rate + 1e-9)
        best = min(best, -(-(w - e) // (e + 1)))
    return max(1, best)


def masks(pattern: list[int]) -> dict[int, int]:
    eq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        eq[c] |= 1 << i
    return dict(eq)


def within(eq: dict[int, int], m: int, text: list[int], budget: int) -> bool:
    """Whether some part of ``text`` is within ``budget`` edits of the pattern
    (Myers' recurrence, free start and end in the text)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    if score <= budget:
        return True
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = (mv | ~(xh | pv)) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= budget:
            return True
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return False


class ItemIndex:
    """Word grams of a batch of items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, rate: float) -> None:
        self.min_words, self.rate, self.g = min_words, rate, piece_length(min_words, rate)
        self.vocab: dict[str, int] = {}
        self.items: dict[int, list[int]] = {}
        self.grams: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        self.eq: dict[tuple[int, int, int], dict[int, int]] = {}
        for item, text in items:
            w = [self.vocab.setdefault(x, len(self.vocab)) for x in words_of(text)]
            if len(w) < min_words:
                continue
            self.items[item] = w
            for i in range(len(w) - self.g + 1):
                self.grams[tuple(w[i : i + self.g])].append((item, i))

    def found(self, text: str | None) -> list[int]:
        get = self.vocab.get
        doc = [get(w, -1) for w in words_of(text)]
        g, hits = self.g, defaultdict(list)
        run = 0
        for p, c in enumerate(doc):
            run = run + 1 if c >= 0 else 0
            if run >= g:
                at = p - g + 1
                for item, i in self.grams.get(tuple(doc[at : p + 1]), ()):
                    hits[item].append((at, i))
        return [item for item, h in hits.items() if self._verify(item, h, doc)]

    def _verify(self, item: int, hits: list[tuple[int, int]], doc: list[int]) -> bool:
        w, low = self.items[item], self.min_words
        # exact runs along diagonals
        diag: dict[int, list[int]] = defaultdict(list)
        for p, i in hits:
            diag[p - i].append(i)
        runs = []
        for d, at in diag.items():
            at.sort()
            s = e = at[0]
            for i in at[1:]:
                if i > e + 1:
                    runs.append((e - s + self.g, s, d))
                    s = i
                e = i
            runs.append((e - s + self.g, s, d))
        runs.sort(reverse=True)
        if runs[0][0] >= low - int(low * self.rate + 1e-9):
            return True
        for size in range(low, len(w) + 1, max(1, round(1 / self.rate)) if self.rate else len(w)):
            budget = int(size * self.rate + 1e-9)
            seen = set()
            for n, s, d in runs:
                for i in range(max(0, s + self.g - size), min(len(w) - size, s + n - self.g) + 1):
                    if (i, d) in seen:
                        continue
                    seen.add((i, d))
                    part = doc[max(0, i + d - budget) : i + d + size + budget]
                    eq = self.eq.get((item, i, size))
                    if eq is None:
                        if len(self.eq) >= KEPT:
                            self.eq.clear()
                        eq = self.eq[(item, i, size)] = masks(w[i : i + size])
                    # at least size - budget of the words must be there at all
                    if sum(1 for c in part if c in eq) >= size - budget and within(eq, size, part, budget):
                        return True
        return False


def leaked_items(docs: DataFrame, items: DataFrame, min_words: int = 20, rate: float = 0.1, batch_words: int = BATCH_WORDS) -> DataFrame:
    """(doc_id, item_id): every document (doc_id, text) that gives away an item
    (item_id, text), each case once.

    Null ids and null texts give no case; repeated rows count once; empty
    tables give no rows; whole texts are read, however long; other columns are
    ignored.
    """
    spark = docs.sparkSession
    it = items.select("item_id", "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates(["item_id"])
    total = it.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // batch_words))
    texts = once(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), "doc_id")
    if n > 1:
        texts = cut(texts)  # read and deduplicated once for all batches
    out = []
    for b in range(n):
        batch = [(r.item_id, r.text) for r in it.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).toLocalIterator()]
        index = spark.sparkContext.broadcast((batch, min_words, rate))

        def match(frames: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            own = ItemIndex(*index.value)
            known: dict[bytes, list[int]] = {}
            for f in frames:
                d, i = [], []
                for doc, text in zip(f["doc_id"], f["text"]):
                    mark = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                    got = known.get(mark)
                    if got is None:
                        got = own.found(text)
                        if len(known) >= KEPT:
                            known.clear()
                        known[mark] = got
                    d += [doc] * len(got)
                    i += got
                yield pd.DataFrame({"doc_id": pd.Series(d, dtype="int64"), "item_id": pd.Series(i, dtype="int64")})

        out.append(texts.mapInPandas(match, "doc_id bigint, item_id bigint"))
    return reduce(DataFrame.unionByName, out)
