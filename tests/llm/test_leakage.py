import random
from pathlib import Path

import numpy as np
import pytest

from spanloom.llm import leakage as L
from spanloom.llm.common import words


def lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[-1]))
        prev = cur
    return prev[-1]


def brute(text, item):
    """The definition by plain dynamic programming over every stretch."""
    m, longest = len(item), int(1.5 * len(item))
    if not m:
        return False
    grams = {tuple(item[i : i + 12]) for i in range(m - 11)}
    if any(tuple(text[i : i + 12]) in grams for i in range(len(text) - 11)):
        return True
    if len(set(text) & set(item)) * 3 < len(set(item)):
        return False
    return any(lcs(item, text[i : i + longest]) >= 0.75 * m for i in range(max(1, len(text) - longest + 1)))


VOCAB = [a + b for a in "ba ko du ri se lo mi ta".split() for b in "nal tor wex qui sul pom der".split()]


def make(rng, n, k=None):
    return [rng.choice(VOCAB) + (str(rng.randint(0, k)) if k else "") for _ in range(n)]


def altered(rng, item, keep, fill, stretch=1.5):
    """Exactly ``keep`` of the item's words in order, with other words strewn in up to the allowed stretch."""
    m = len(item)
    at = sorted(rng.sample(range(m), int(np.ceil(keep * m))))
    out = [item[i] for i in at]
    for _ in range(int(stretch * m) - len(out)):
        out.insert(rng.randint(1, len(out) - 1), rng.choice(fill))
    return out


def test_words():
    assert words("Don’t STOP_it, 3.5€ Größe x") == ["don", "t", "stop", "it", "3", "5", "größe", "x"]
    assert words(None) == words("") == []


def test_verify_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        item = make(rng, rng.randint(1, 40))
        kind = rng.randint(0, 3)
        text = make(rng, rng.randint(0, 30))
        if kind == 1:
            k = rng.randint(0, max(0, len(item) - 12))
            text += item[k : k + rng.randint(10, 13)]
        elif kind == 2:
            text += altered(rng, item, rng.choice([0.7, 0.75, 0.8]), VOCAB) if len(item) > 3 else item
        text += make(rng, rng.randint(0, 30))
        number = {w: i for i, w in enumerate(sorted(set(item)))}
        got = L.verify([number.get(w, -1) for w in text], [number[w] for w in item])
        assert got == brute(text, item), (text, item)


@pytest.mark.parametrize("radius", [0, 3, 15, 96])
def test_hamming_blocks_are_complete(radius):
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (50, 4), dtype=np.uint64)
    queries = prints[rng.integers(0, 50, 80)].copy()
    for q in queries:
        for b in rng.integers(0, 256, rng.integers(0, 20)):
            q[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    d = np.array([[sum(int(x ^ y).bit_count() for x, y in zip(q, p)) for p in prints] for q in queries])
    got = set(zip(*(a.tolist() for a in L.HammingBlocks(prints).within(queries, radius))))
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d <= radius))}


def test_candidates_hold_the_hardest_cases():
    """Recall of the fingerprints alone on cases at the very edge of the definition: 75 % kept, 1.5 times as long."""
    rng = random.Random(5)
    fill = [f"other{i}" for i in range(500)]
    items = [make(rng, rng.randint(32, 72), 300) for _ in range(60)]
    s = L.ItemSet(list(range(60)), items, {}, 1000, L.DEFAULT)
    hit = total = 0
    for k, item in enumerate(items):
        for _ in range(5):
            text = rng.choices(fill, k=rng.randint(0, 90)) + altered(rng, item, 0.75, fill) + rng.choices(fill, k=rng.randint(0, 90))
            total += 1
            hit += k in s.candidates(np.array([s.number.get(w, -1) for w in text]))
    assert hit / total >= 0.97, hit / total


def test_find_leaks(spark):
    rng = random.Random(8)
    items = [(i, " ".join(make(rng, rng.randint(32, 60), 200))) for i in range(20)] + [(50, ""), (51, None), (52, "short item")]
    docs = []
    for d in range(150):
        text = make(rng, rng.randint(0, 120), 200)
        if d % 3 == 0:
            w = words(items[rng.randrange(20)][1])
            cut = w[5:17] if d % 2 else altered(rng, w, rng.choice([0.6, 0.8, 0.95]), VOCAB, 1.3)
            at = rng.randint(0, len(text))
            text[at:at] = cut
        docs.append((d, ", ".join(text).upper()))
    docs += [(900, None), (901, ""), (902, "x " * 20_000), (903, docs[0][1]), (904, "A short ITEM!")]
    want = {(d, i) for d, t in docs for i, x in items if brute(words(t), words(x))}
    assert len(want) > 30 and (904, 52) in want
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnsRenamed({"doc_id": "item_id"})
    it = spark.createDataFrame(items, "item_id long, item_text string")
    rows = L.find_leaks(df.withColumnsRenamed({"item_id": "doc_id"}), it).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    blocks = L.find_leaks(df.withColumnsRenamed({"item_id": "doc_id"}), it, block=7)
    assert {tuple(r) for r in blocks.collect()} == want
    assert L.find_leaks(df.limit(0).withColumnsRenamed({"item_id": "doc_id"}), it).count() == 0
    assert L.find_leaks(df.withColumnsRenamed({"item_id": "doc_id"}), it.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables here")
def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet")
    texts = [(r.item_id, words(r.item_text)) for r in items.collect()]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        w = words(r.text)
        have = set(w)
        want |= {(r.doc_id, i) for i, x in texts if len(have & set(x)) >= 12 and brute(w, x)}
    assert {tuple(r) for r in L.find_leaks(docs, items).collect()} == want
