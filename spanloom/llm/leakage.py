"""Documents that contain passages of held-out test items.

A pair (document, item) is a case if the text has ``run`` consecutive words of the item, or if some stretch of at most
``stretch`` times the item's length has at least ``share`` of the item's words in the item's order.

Words are read in bulk.  The words that are rare in the whole corpus choose, by an inverted index, the items that a
document is held against at all: of any ``lost + k`` words of an item a case has at least k, ``lost`` being the words that
it may lack.  For those items come fingerprints: SimHashes of windows that have the size of the item and start every
``stride`` words, each word +-1 in every bit times its weight, the inverse document frequency over the whole corpus.
Windows within ``radius`` of the item are candidates.  No radius gives every altered passage, as a few rare words can
outweigh the rest; so an item is also a candidate where ``share`` of its words, in any order, lie within ``stretch`` times
its length: every such passage meets that.  Runs are found by SimHashes of ``run`` words at radius 0 in multi-index tables.
Candidates are verified: first by the weighted share of the item's words in a stretch, one word a shingle, which every
case must reach, then by the definition itself.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, split_words, spread, words


@dataclass(frozen=True)
class LeakRule:
    run: int = 12
    share: float = 0.75
    stretch: float = 1.5
    bits: int = 256
    radius: int = 96
    stride: int = 4
    size_step: int = 8

    def needed(self, m: int) -> int:
        return int(np.ceil(self.share * m))

    def longest(self, m: int) -> int:
        return int(self.stretch * m)


DEFAULT = LeakRule()
#: Windows whose fingerprints are in memory at a time.
WINDOWS = 4096


class HammingBlocks:
    """Fingerprints of a bounded query set, cut into 16-bit blocks, with one table of block values each.

    Two fingerprints within radius r < number of blocks agree in some block, so the tables give all of them (multi-index
    hashing).  A larger radius leaves no block that must agree, and its per-block neighbourhoods cover most values, so
    then the whole query set is compared block by 64-bit block: complete for every radius.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = np.ascontiguousarray(prints)  # (n, bits / 64) uint64
        self.blocks = self.prints.view(np.uint16)
        self.order = np.argsort(self.blocks, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.blocks, self.order, axis=0)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, print row) of all pairs within the radius."""
        none = np.zeros(0, np.int64)
        if not len(queries) or not len(self.prints):
            return none, none
        if radius >= self.blocks.shape[1]:
            d = np.zeros((len(queries), len(self.prints)), np.uint16)
            for k in range(self.prints.shape[1]):
                d += np.bitwise_count(queries[:, k, None] ^ self.prints[None, :, k])
            return np.nonzero(d <= radius)
        qb, found = np.ascontiguousarray(queries).view(np.uint16), []
        for b in range(radius + 1):  # any radius + 1 blocks: one of them agrees
            lo = np.searchsorted(self.sorted[:, b], qb[:, b], "left")
            n = np.searchsorted(self.sorted[:, b], qb[:, b], "right") - lo
            q = np.repeat(np.arange(len(qb)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            p = self.order[at, b]
            near = np.bitwise_count(queries[q] ^ self.prints[p]).sum(axis=1) <= radius
            found.append(np.stack([q[near], p[near]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]


def verify(text: list[int], item: list[int], rule: LeakRule = DEFAULT) -> bool:
    """The definition, exactly.  Words are numbers; -1 stands for any word that no item has."""
    n, m = len(text), len(item)
    if not n or not m:
        return False
    if m >= rule.run:
        grams = {tuple(item[i : i + rule.run]) for i in range(m - rule.run + 1)}
        if any(tuple(text[i : i + rule.run]) in grams for i in range(n - rule.run + 1)):
            return True
    need, longest = rule.needed(m), rule.longest(m)
    own = Counter(item)
    hit = np.fromiter((w in own for w in text), np.int64, n)
    upto = np.concatenate([[0], np.cumsum(hit)])
    masks = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << m) - 1
    for i in np.flatnonzero(hit):
        j = min(n, i + longest)
        if upto[j] - upto[i] < need:
            continue
        part = text[i:j]
        seen = Counter(part)
        if sum(min(c, seen[w]) for w, c in own.items()) < need:
            continue
        v = full  # bit-parallel longest common subsequence; zeros of v count its length
        for w in part:
            u = v & masks.get(w, 0)
            v = ((v + u) | (v - u)) & full
        if m - v.bit_count() >= need:
            return True
    return False


def _expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), start[1], ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


@dataclass
class ItemSet:
    """Items of one block: their words as numbers, word weights, the index of their rare words, fingerprints."""

    ids: list
    texts: list[list[str]]
    frequency: dict[str, int]
    documents: int
    rule: LeakRule
    number: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(sorted({w for t in self.texts for w in t}))}
        self.items = [[self.number[w] for w in t] for t in self.texts]
        self.weight = np.array([max(1, round(8 * np.log((self.documents + 1) / (self.frequency.get(w, 0) + 1)))) for w in self.number] + [0], np.int64)
        self.signs = np.stack([self._signs(w) for w in self.number]) if self.number else np.zeros((0, self.rule.bits), np.int8)
        self.signs = np.concatenate([self.signs, np.zeros((1, self.rule.bits), np.int8)])  # index -1 is any other word
        step = self.rule.size_step
        self.size = np.array([max(step, round(len(item) / step) * step) for item in self.items], np.int64)
        self.prints = np.concatenate([np.zeros((0, self.rule.bits // 64), np.uint64), *[self._print(np.array(item, np.int64)[None]) for item in self.items]])
        self.need = np.array([self.rule.needed(len(item)) if item else np.iinfo(np.int64).max for item in self.items], np.int64)
        # every case has the weight of the lightest ``need`` words at least
        self.least = np.array([np.sort(self.weight[item])[: self.rule.needed(len(item))].sum() if item else 0 for item in self.items], np.int64)
        self._index_rare_words()
        self._index_runs()

    def _index_rare_words(self) -> None:
        """Word -> items that have it among the ``lost + asked`` rarest positions, and how often there."""
        self.asked, own = np.zeros(len(self.items), np.int64), []
        for k, item in enumerate(self.items):
            if item:
                m, need = len(item), self.rule.needed(len(item))
                self.asked[k] = max(1, need // 3)
                rare = sorted(item, key=lambda w: (-self.weight[w], w))[: m - need + int(self.asked[k])]
                own += [(w, k, n) for w, n in Counter(rare).items()]
        held = np.array(sorted(own), np.int64).reshape(-1, 3)
        self.bounds, self.holder, self.times = np.searchsorted(held[:, 0], np.arange(len(self.number) + 1)), held[:, 1], held[:, 2]

    def _index_runs(self) -> None:
        r, v = self.rule.run, len(self.number) + 1
        runs = [(k, item[i : i + r]) for k, item in enumerate(self.items) for i in range(len(item) - r + 1)]
        self.run_owner = np.array([k for k, _ in runs], np.int64)
        self.runs = HammingBlocks(self._print(np.array([x for _, x in runs], np.int64).reshape(-1, r)))
        self.neighbours = np.unique(np.array([a * v + b for item in self.items for a, b in zip(item, item[1:])], np.int64))

    def _signs(self, word: str) -> np.ndarray:
        """+-1 per bit from a keyed hash of the word."""
        raw = hashlib.shake_128(word.encode()).digest(self.rule.bits // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8)).astype(np.int8) * 2 - 1

    def _print(self, windows: np.ndarray) -> np.ndarray:
        """SimHash of each row of word numbers."""
        out = [np.zeros((0, self.rule.bits // 64), np.uint64)]
        for i in range(0, len(windows), 512):
            w = windows[i : i + 512]
            sums = np.einsum("ij,ijb->ib", self.weight[w].astype(np.float32), self.signs[w].astype(np.float32))
            out.append(np.packbits(sums > 0, axis=1).view(np.uint64))
        return np.concatenate(out)

    # ---- which items a text is held against -------------------------------------------------------------------
    def chosen(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs that share enough rare words, over all texts at once; ``row`` is the text of each word."""
        none, known, v = np.zeros(0, np.int64), word >= 0, len(self.number) + 1
        if not known.any() or not len(self.holder):
            return none, none
        pair, c = np.unique(row[known] * v + word[known], return_counts=True)
        w, r = pair % v, pair // v
        n = self.bounds[w + 1] - self.bounds[w]
        at = _expand(self.bounds[w], n)
        key = np.repeat(r, n) * len(self.items) + self.holder[at]
        order = np.argsort(key, kind="stable")
        key, shared = key[order], np.minimum(self.times[at], np.repeat(c, n))[order]
        if not len(key):
            return none, none
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total, key = np.add.reduceat(shared, first), key[first]
        key = key[total >= self.asked[key % len(self.items)]]
        return key // len(self.items), key % len(self.items)

    def runs_in(self, word: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs where ``run`` consecutive words of the text have the fingerprint of a run of the item."""
        none, r, v = np.zeros(0, np.int64), self.rule.run, len(self.number) + 1
        if len(word) < r or not len(self.run_owner):
            return none, none
        a, b = word[:-1], word[1:]
        pair = np.where((a >= 0) & (b >= 0) & (row[:-1] == row[1:]), a * v + b, -1)
        at = np.minimum(np.searchsorted(self.neighbours, pair), max(0, len(self.neighbours) - 1))
        linked = self.neighbours[at] == pair if len(self.neighbours) else np.zeros(len(pair), bool)
        upto = np.concatenate([[0], np.cumsum(linked)])
        start = np.flatnonzero(upto[r - 1 :] - upto[: len(upto) - r + 1] == r - 1)
        if not len(start):
            return none, none
        at, hit = self.runs.within(self._print(word[start[:, None] + np.arange(r)]), 0)
        return row[start[at]], self.run_owner[hit]

    def near(self, text: np.ndarray, items: np.ndarray) -> set[int]:
        """Those of the items whose fingerprint some window of their size in the text comes near enough to."""
        out, n, known = set(), len(text), np.concatenate([[0], np.cumsum(text >= 0)])
        for size in np.unique(self.size[items]):
            own = items[self.size[items] == size]
            last = max(0, n - size)
            start = np.unique(np.concatenate([np.arange(0, last + 1, self.rule.stride), [last]]))
            start = start[known[np.minimum(start + size, n)] - known[start] >= self.need[own].min() // 2]
            index = HammingBlocks(self.prints[own])
            padded = np.concatenate([text, np.full(size, -1, np.int64)])
            for i in range(0, len(start), WINDOWS):
                windows = padded[start[i : i + WINDOWS, None] + np.arange(size)]
                out.update(own[index.within(self._print(windows), self.rule.radius)[1]].tolist())
        return out

    def sharing(self, text: np.ndarray, items: np.ndarray) -> set[int]:
        """Those of the items of whose words enough lie close enough together in the text, in any order."""
        out = set()
        for k in items.tolist():
            if self._most(text, k, np.ones(len(self.weight), np.int64)) >= self.need[k]:
                out.add(k)
        return out

    def _most(self, text: np.ndarray, k: int, value: np.ndarray) -> int:
        """Most that the item's words in a stretch of the allowed length are worth, repeats counted."""
        has = np.zeros(len(self.number) + 1, np.int64)  # the last one, index -1, is that of all other words
        has[self.items[k]] = value[self.items[k]]
        upto = np.concatenate([[0], np.cumsum(has[text])])
        longest = min(self.rule.longest(len(self.items[k])), len(text))
        return int((upto[longest:] - upto[: len(upto) - longest]).max())

    def similar(self, text: np.ndarray, k: int) -> bool:
        """Whether some stretch can have the weight that every case has."""
        return self._most(text, k, self.weight) >= self.least[k]

    def candidates(self, text: np.ndarray) -> set[int]:
        """Items that the text may hold by the share of their words or by a run."""
        text, zeros = np.asarray(text, np.int64), np.zeros(len(text), np.int64)
        items = self.chosen(text, zeros)[1]
        return self.near(text, items) | self.sharing(text, items) | set(self.runs_in(text, zeros)[1].tolist())

    def cases(self, word: np.ndarray, row: np.ndarray, rows: int) -> Iterator[tuple[int, int]]:
        """(row, item) of every case among texts given as their words one after the other, with the row of each word."""
        at = np.searchsorted(row, np.arange(rows + 1))
        runs = set(zip(*(x.tolist() for x in self.runs_in(word, row))))
        chosen: dict[int, list[int]] = {}
        for r, k in zip(*(x.tolist() for x in self.chosen(word, row))):
            chosen.setdefault(r, []).append(k)
        for r in sorted({r for r, _ in runs} | set(chosen)):
            text, items = word[at[r] : at[r + 1]], np.array(chosen.get(r, []), np.int64)
            near = self.near(text, items)
            near |= self.sharing(text, np.array([k for k in items.tolist() if k not in near], np.int64))
            found = {k for k in near if self.similar(text, k)} | {k for q, k in runs if q == r}
            for k in sorted(found):
                if verify(text.tolist(), self.items[k], self.rule):
                    yield r, k


def word_numbers(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Every word of a column of texts as its number, -1 for one outside the vocabulary, and its row."""
    flat, row = split_words(column)
    return pc.fill_null(pc.index_in(flat, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64), row


def item_frequency(docs: DataFrame, items: list[list[str]], text: str) -> tuple[int, dict[str, int]]:
    """Number of documents and, for every word of the items, in how many documents it occurs: counts over the whole
    corpus, made per task and added up.  The result has as many rows as the items have words."""
    vocabulary = sorted({w for t in items for w in t})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, v = pa.array(vocabulary, pa.string()), len(vocabulary)
        total, seen = 0, np.zeros(v, np.int64)
        for b in batches:
            total += b.num_rows
            for part in slices(b.column(0)):
                word, row = word_numbers(part, known)
                pair = np.unique((row * v + word)[word >= 0])
                seen += np.bincount(pair % v, minlength=v) if len(pair) else 0
        at = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.concatenate([[-1], at])), pa.array(np.concatenate([[total], seen[at]]))], ["w", "n"])

    rows = docs.select(text).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    got = {r["w"]: r["n"] for r in rows}
    return got.pop(-1, 0), {vocabulary[w]: n for w, n in got.items()}


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", rule: LeakRule = DEFAULT, block: int = 65_536) -> DataFrame:
    """(doc_id, item_id) of every case, each once.

    The items are a stated query set, of any number: they go to the tasks in blocks of about ``block``, cut by the hash of
    their id, so that neither driver nor task holds more than one; each block takes two readings of the corpus.  Documents
    are never shuffled for it.  Null and empty texts and items without words match nothing.
    """
    docs = spread(docs.select(doc_id, text), doc_id)
    schema = T.StructType([docs.schema[doc_id], items.schema[item_id]])
    id_type, out = pa.int64() if isinstance(items.schema[item_id].dataType, T.LongType) else None, None
    blocks = max(1, -(-items.count() // block))
    for i in range(blocks):
        part = items.select(item_id, item_text).where(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == i).collect()
        part = sorted(((r[0], words(r[1])) for r in part), key=lambda p: str(p[0]))
        total, frequency = item_frequency(docs, [w for _, w in part], text)
        shared = docs.sparkSession.sparkContext.broadcast(([k for k, _ in part], [t for _, t in part], frequency))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, total=total) -> Iterator[pa.RecordBatch]:
            s = None
            for b in batches:
                if s is None:
                    s = ItemSet(*shared.value, total, rule)
                    known = pa.array(list(s.number), pa.string())
                at, ids, done = [], [], 0
                for column in slices(b.column(1)):
                    for r, k in s.cases(*word_numbers(column, known), len(column)):
                        at.append(done + r)
                        ids.append(s.ids[k])
                    done += len(column)
                yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, id_type)], [doc_id, item_id])

        one = docs.mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return out
