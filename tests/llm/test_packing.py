import random

import numpy as np
import pytest

from spanloom.llm import packing as P
from spanloom.llm.common import words


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(40)] for t in ("apple", "brick", "cloud", "drill")]
    rows = [(i, " ".join(rng.choices(rng.choice(topics), k=rng.choice([1, 5, 30, 120])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "apple1 " * 900), (1003, "x" * 5000), (1004, rows[0][1]), (1005, rows[0][1]), (1006, "!!!")]
    return spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)


def sizes(texts):
    enc = P.tokenizer()
    return {k: len(enc.encode_ordinary(t)) if t else 0 for k, t in texts.items()}


@pytest.mark.parametrize(("capacity", "shard"), [(512, 4096), (100, 50), (64, 7)])
def test_every_document_once(corpus, capacity, shard):
    df, texts = corpus
    n = sizes(texts)
    out = P.pack(df, capacity=capacity, shard=shard).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.piece, r.token_start, r.n_tokens))
    assert set(by) == set(texts)
    for k, pieces in by.items():
        pieces.sort()
        assert sum(p[2] for p in pieces) == n[k]
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert [p[1] for p in pieces] == [i * capacity for i in range(len(pieces))]
        assert len(pieces) == max(1, -(-n[k] // capacity))  # cut only if longer than a container
    load = {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
    assert max(load.values()) <= capacity
    least = -(-sum(n.values()) // capacity)
    if shard >= 4096:
        assert len(load) <= least + 2


def test_neighbours_share_containers(corpus):
    """Containers are purer in topic than random packing would be."""
    df, texts = corpus
    same = total = 0
    groups = {}
    for r in P.pack(df, capacity=256).collect():
        if texts[r.doc_id] and r.doc_id < 1000:
            groups.setdefault(r.container_id, []).append(texts[r.doc_id][:5])
    for g in groups.values():
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                same, total = same + (a == b), total + 1
    assert same / total > 0.5  # 0.25 by chance


def test_document_frequencies_cover_all(corpus):
    df, texts = corpus
    freq = {r.t: r.n for r in P.term_frequencies(P.tokenized(df, "doc_id", "text", P.TOKENIZER)).collect()}
    assert freq[P.term_keys(["apple1"])[0]] == sum("apple1" in words(x) for x in texts.values())
    assert P.term_keys(["x" * 5000])[0] not in freq  # in one document only


def shard(sizes, bags, idf):
    """Bags of (terms, weights) as a shard; each weight times the idf of its term."""
    ends = np.concatenate([[0], np.cumsum([len(t) for t, _ in bags])])
    term = np.concatenate([t for t, _ in bags])
    return P.Shard(np.array(sizes), ends, term, np.concatenate([w for _, w in bags]) * idf[term])


def test_bm25_order():
    bags = [(np.array([1, 2]), np.array([1, 1])), (np.array([1]), np.array([1])), (np.array([1, 2]), np.array([2, 2])), (np.array([9]), np.array([1]))]
    idf = np.ones(10)
    idf[2] = 5.0
    s = shard([5, 5, 5, 5], bags, idf)
    s.take(0)
    assert s.neighbours(0).tolist() == [2, 1]  # shares the rare term; shares one; shares none
    assert s.fill(11, 0) == ([2, 1], 2) and s.fill(5, None) == ([3], 0)


def test_first_neighbours_are_those_of_the_whole_ranking():
    rng = np.random.default_rng(7)
    share = 1 / np.arange(1, 200)
    bags = [(np.flatnonzero(rng.random(199) < share), None) for _ in range(300)]
    bags = [(t, rng.integers(1, 5, len(t))) for t, _ in bags]
    s = shard(rng.integers(0, 50, 300), bags, np.log(1 / share + 1))
    for i in rng.permutation(300)[:100]:
        s.take(int(i))
        for k in (1, 5, 64):
            free = np.flatnonzero(~s.used)
            assert P.Query(s, i).best(free, k).tolist() == P.Query(s, i).best(free, 300)[:k].tolist() == s.neighbours(i)[:k].tolist()


def test_same_containers_however_the_job_is_cut(corpus, spark):
    df, _ = corpus
    key = lambda x: sorted(map(tuple, x.collect()))
    want = key(P.pack(df, capacity=200, shard=40))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert key(P.pack(df.repartition(3), capacity=200, shard=40)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert key(P.pack(df, capacity=200, shard=40, most_terms=3)) == want  # frequencies joined, not broadcast


def test_repeatable_and_empty(corpus, spark):
    df, _ = corpus
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(P.pack(df, capacity=200)) == key(P.pack(df, capacity=200))
    assert P.pack(df.limit(0)).count() == 0
    u = P.utilisation(P.pack(df, capacity=200), 200).first()
    assert u.overfull == 0 and u.used_share > 0.9
