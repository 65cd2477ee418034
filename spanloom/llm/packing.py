"""Documents packed into containers of a fixed number of tokens, related documents together.

Retrieval packing in shards: every shard has a BM25 inverted index of its documents.  The longest unused document
starts a container; the index names its unused neighbours, which fill the container in order of their score as far as
they fit; what is still free goes to the largest unused documents that fit.  No document is split unless it is longer
than a container: then it is cut into full containers and one rest, which is packed like a document.

Terms are words under 64-bit keys; their document frequencies are counted over the whole corpus.  A document's topic is
the rarest of its terms that occurs in at least 1 of ``COMMON`` documents.  Topics one after the other are cut into
shards, large topics by the hash of the document, so shards follow from the documents alone and not from how the job is
cut into tasks.  The last container of each shard is opened again and packed with those of other shards.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import lookup_join
from ..session import cut_lineage
from .common import slices, split_words, spread

CAPACITY = 2048
#: Documents of a shard, shards whose last containers are packed together, and 1 / the share of documents a topic has at least.
SHARD, GROUP, COMMON = 4096, 256, 1000
#: Terms up to which the document frequencies are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 2_000_000
K1, B = 1.2, 0.75
#: Neighbours that are ranked at a time, until none is left that fits.
FIRST = 32
TOKENIZER = os.environ.get("SPANLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def tokenizer(path: str = TOKENIZER):
    """A byte-level BPE from a public vocabulary file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def term_keys(ws: list[str]) -> np.ndarray:
    """64-bit keys of words."""
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in ws], np.uint64).view(np.int64)


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each text with their counts, one text after the other, and how many terms each text has."""
    flat, row = split_words(texts)
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = term_keys(coded.dictionary.to_pylist())
    pair, count = np.unique(row * max(1, len(keys)) + code, return_counts=True)
    return keys[pair % max(1, len(keys))] if len(pair) else np.zeros(0, np.int64), count.astype(np.int32), np.bincount(pair // max(1, len(keys)), minlength=len(texts))


def tokenized(docs: DataFrame, doc_id: str, text: str, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_words, terms, counts): null and empty texts have 0 tokens."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("n_tokens", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer(path)
        for b in batches:
            done = 0
            for part in slices(b.column(1)):
                n = [len(enc.encode_ordinary(t)) if t else 0 for t in part.to_pylist()]
                terms, counts, size = bags(part)
                at = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                total = np.concatenate([[0], np.cumsum(counts)])[at.to_numpy()]
                yield pa.record_batch([b.column(0).slice(done, len(part)), pa.array(n, pa.int64()), pa.array(np.diff(total)), pa.ListArray.from_arrays(at, pa.array(terms)), pa.ListArray.from_arrays(at, pa.array(counts))], schema.names)
                done += len(part)

    return spread(docs.select(doc_id, text), doc_id).mapInArrow(run, schema)


def term_frequencies(tok: DataFrame, flush: int = 4_000_000) -> DataFrame:
    """(t, n): in how many documents each term occurs, over all documents; terms of one document, which lead to no other,
    are left out.  Each task adds up its own before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(t), pa.array(n.astype(np.int64))], ["t", "n"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= flush:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return tok.select("terms").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n >= 2")


def weighed(tok: DataFrame, doc_id: str, frequencies: DataFrame, total: int, mean: float, most: int = BROADCAST_TERMS) -> DataFrame:
    """(doc_id, n_tokens, topic, terms, weights): BM25 weights of the terms that two documents or more have.

    The frequencies are broadcast if a limited count proves them to be at most ``most``, else joined by shuffle, every
    term spread over several parts; the result is the same.
    """
    least = total / COMMON
    if frequencies.limit(most + 1).count() > most:
        each = tok.select(doc_id, "n_words", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(doc_id, "n_words", F.col("x.terms").alias("t0"), F.col("x.counts").alias("tf"))
        each = lookup_join(each, frequencies, ["t0"], ["t"], "inner", doc_id)
        idf = F.log(1 + (total - F.col("n") + 0.5) / (F.col("n") + 0.5))
        w = (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(mean)))).cast("float")
        rows = F.array_sort(F.collect_list(F.struct(F.col("t0").alias("t"), w.alias("w"))))
        topic = F.min(F.when(F.col("n") >= least, F.struct("n", "t0")))["t0"]
        got = each.groupBy(F.col(doc_id).alias("_d")).agg(rows.alias("r"), topic.alias("topic"))
        out = tok.select(doc_id, "n_tokens").join(got, F.col(doc_id) == F.col("_d"), "left")
        return out.select(doc_id, "n_tokens", F.coalesce("topic", F.lit(-1).cast("long")).alias("topic"), F.coalesce(F.transform("r", lambda r: r["t"]), F.array().cast("array<long>")).alias("terms"), F.coalesce(F.transform("r", lambda r: r["w"]), F.array().cast("array<float>")).alias("weights"))
    table = frequencies.toArrow().combine_chunks().sort_by("t")
    shared = tok.sparkSession.sparkContext.broadcast((table.column("t").to_numpy(), table.column("n").to_numpy()))
    schema = T.StructType([tok.schema[doc_id], tok.schema["n_tokens"], T.StructField("topic", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for b in batches:
            size = np.diff(b.column(3).offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), size)
            term, tf = b.column(3).flatten().to_numpy(), b.column(4).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
            keep = known[at] == term if len(known) else np.zeros(len(term), bool)
            row, term, tf, n = row[keep], term[keep], tf[keep], often[at[keep]] if len(known) else np.zeros(0)
            length = b.column(2).to_numpy()[row]
            w = np.log(1 + (total - n + 0.5) / (n + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
            order = np.lexsort((term, row))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.num_rows))]), pa.int32())
            topic = np.full(b.num_rows, -1, np.int64)
            rare = np.lexsort((term, n, row))
            rare = rare[n[rare] >= least]
            first = rare[np.concatenate([[True], row[rare][1:] != row[rare][:-1]])] if len(rare) else rare
            topic[row[first]] = term[first]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(topic), pa.ListArray.from_arrays(ends, pa.array(term[order])), pa.ListArray.from_arrays(ends, pa.array(w[order].astype(np.float32)))], schema.names)

    return tok.select(doc_id, "n_tokens", "n_words", "terms", "counts").mapInArrow(run, schema)


class Shard:
    """BM25 inverted index of a block of documents, with the sizes of those not yet used.

    ``ends`` are the bounds of each document's part of ``term`` and ``weight``.
    """

    def __init__(self, sizes: np.ndarray, ends: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.sizes, self.ends, self.weight, n = sizes, ends, weight.astype(np.float64), len(sizes)
        self.terms, self.term = np.unique(term, return_inverse=True)
        order = np.argsort(self.term, kind="stable")
        self.doc_at, self.weight_at = np.repeat(np.arange(n), np.diff(ends))[order], self.weight[order]
        self.start = np.searchsorted(self.term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight_at, self.start[:-1]) if len(self.terms) else np.zeros(0)
        self.used = np.zeros(n, bool)
        self.queue = np.lexsort((np.arange(n), -sizes))  # longest first
        self.free = sorted((int(s), -i) for i, s in enumerate(sizes))  # by size; of equals the first document

    def take(self, i: int) -> None:
        self.used[i] = True
        k = bisect_right(self.free, (int(self.sizes[i]), -i)) - 1
        self.free.pop(k)

    @staticmethod
    def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = end - start
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)

    def neighbours(self, i: int) -> np.ndarray:
        """Unused documents that share a term with document i, by descending BM25 score, ties by number."""
        return Query(self, i).best(np.flatnonzero(~self.used), len(self.sizes))

    def fill(self, room: int, seed: int | None) -> tuple[list[int], int]:
        """Unused documents for the room left beside the seed: its neighbours as far as they fit, then best fits; and how
        many of them are neighbours.

        As the room only shrinks, the neighbours that fit are ranked ``FIRST`` at a time, which gives the same as going
        down the whole ranking.
        """
        out, query = [], None
        while seed is not None and room > 0 and self.free and self.free[0][0] <= room:
            query = query or Query(self, seed)
            near = query.best(np.flatnonzero(~self.used & (self.sizes <= room)), FIRST).tolist()
            for j in near:
                if self.sizes[j] <= room:
                    out.append(j)
                    room -= int(self.sizes[j])
                    self.take(j)
            if len(near) < FIRST:
                break
        near = len(out)
        while self.free:
            k = bisect_right(self.free, (room, 1)) - 1
            if k < 0 or room == 0 and self.free[k][0] > 0:
                break
            j = -self.free[k][1]
            out.append(j)
            room -= int(self.sizes[j])
            self.take(j)
        return out, near

    def containers(self, capacity: int) -> Iterator[tuple[int, list[int], int]]:
        """(seed, other documents, how many of these are neighbours of the seed) until all are used."""
        for i in self.queue.tolist():
            if not self.used[i]:
                self.take(i)
                yield i, *self.fill(capacity - int(self.sizes[i]), i)


class Query:
    """BM25 scores of a shard's documents for the terms of one of them.

    The rarest terms are scored for all documents at once.  What all other terms can add at most leaves few documents that
    may be among the best, and only those are scored in full, unless to score all is less work.
    """

    def __init__(self, shard: Shard, i: int):
        self.shard, n = shard, len(shard.sizes)
        terms = shard.term[shard.ends[i] : shard.ends[i + 1]]
        length = shard.start[terms + 1] - shard.start[terms]
        order = np.lexsort((terms, length))
        upto = np.cumsum(length[order])
        head = int(np.searchsorted(upto, 2 * n, "right"))
        self.score, self.rest = self._scores(terms[order[:head]]), terms[order[head:]]
        self.work, self.above = int(length[order[head:]].sum()), shard.most[self.rest].sum()

    def _scores(self, terms: np.ndarray) -> np.ndarray:
        s = self.shard
        at = s._spans(s.start[terms], s.start[terms + 1])
        return np.bincount(s.doc_at[at], weights=s.weight_at[at], minlength=len(s.sizes))

    def best(self, among: np.ndarray, most: int) -> np.ndarray:
        """The documents of highest positive score, at most ``most``."""
        s, score = self.shard, self.score[among]
        if len(self.rest):
            if len(among) > most:
                may = score >= np.partition(score, len(among) - most)[len(among) - most] - self.above
                among, score = among[may], score[may]
            size = s.ends[among + 1] - s.ends[among]
            if size.sum() > self.work:
                self.score, self.rest = self.score + self._scores(self.rest), self.rest[:0]
                score = self.score[among]
            else:
                other = np.zeros(len(s.terms), bool)
                other[self.rest] = True
                at = s._spans(s.ends[among], s.ends[among + 1])
                more = np.where(other[s.term[at]], s.weight[at], 0.0)
                score = score + np.bincount(np.repeat(np.arange(len(among)), size), weights=more, minlength=len(among))
        among, score = among[score > 0], score[score > 0]
        if len(among) > 4 * most:
            may = score >= np.partition(score, len(among) - most)[len(among) - most]
            among, score = among[may], score[may]
        return among[np.lexsort((among, -score))][:most]


def best_fit(sizes: np.ndarray, capacity: int) -> list[int]:
    """The container of each document, named by its first one: longest first, into the fullest that has room."""
    shard, out = Shard(sizes, np.zeros(len(sizes) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0)), [0] * len(sizes)
    for i, rest, _ in shard.containers(capacity):
        for j in (i, *rest):
            out[j] = i
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer_path: str = TOKENIZER, shard: int = SHARD, most_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(container_id, doc_id, piece, token_start, n_tokens, placed_by): every document in one container.

    A document of more than ``capacity`` tokens gives pieces 0, 1, ... of exactly ``capacity`` tokens, each a container
    of its own, and a last piece that is packed with others.  Empty and null texts are packed with 0 tokens.  Copies
    are documents like others.  container_id is that of the piece that starts the container, "doc:piece"; it does not
    depend on how the job is cut into tasks.  placed_by: 'cut' (a full piece), 'seed', 'neighbour' (by retrieval) or 'fit'.
    Needs a unique, non-null doc_id.
    """
    tok = cut_lineage(tokenized(docs, doc_id, text, tokenizer_path))  # read four times, tokenized once
    total, n_words = tok.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    rows = weighed(tok, doc_id, cut_lineage(term_frequencies(tok)), total, max(n_words, 1) / max(total, 1), most_terms)
    # a topic has at least 1 of COMMON documents, so there are at most COMMON times as many as a document has terms
    topics = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("topic")) - F.col("n")).withColumnRenamed("topic", "_topic")
    part = F.pmod(F.xxhash64(doc_id), F.greatest(F.ceil(F.col("n") / shard), F.lit(1)))
    number = F.floor(F.col("upto") / shard) + F.when(F.col("n") > shard, part).otherwise(0)
    rows = lookup_join(rows, topics, ["topic"], ["_topic"], "inner", doc_id).select(number.cast("long").alias("shard"), doc_id, "n_tokens", "terms", "weights")
    placed = T.StructType([T.StructField("container_id", T.StringType()), docs.schema[doc_id], T.StructField("piece", T.LongType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("placed_by", T.StringType())])
    schema = T.StructType([*placed.fields, T.StructField("open", T.LongType())])

    def one(number: int, block: pa.Table) -> pa.RecordBatch:
        ids, n = block.column(1), block.column(2).to_numpy()
        cut = np.where(n > capacity, n // capacity, 0)
        size = n - cut * capacity
        at = np.flatnonzero((size > 0) | (cut == 0))
        term, weight = block.column(3).combine_chunks(), block.column(4).combine_chunks()
        took = term.take(pa.array(at))
        ends = np.concatenate([[0], np.cumsum(took.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
        index = Shard(size[at], ends, took.flatten().to_numpy(), weight.take(pa.array(at)).flatten().to_numpy())
        rep = np.repeat(np.arange(len(n)), cut)
        doc, piece = [rep], [np.arange(len(rep)) - np.repeat(np.cumsum(cut) - cut, cut)]
        head, how, last = [rep], ["cut"] * len(rep), None
        for i, rest, near in index.containers(capacity):
            doc.append(at[[i, *rest]])
            head.append(np.full(len(rest) + 1, at[i]))
            how += ["seed"] + ["neighbour"] * near + ["fit"] * (len(rest) - near)
            last = at[i]
        doc, head = np.concatenate(doc), np.concatenate(head)
        piece = np.concatenate([*piece, cut[doc[len(rep) :]]])
        first = np.where(np.arange(len(doc)) < len(rep), piece, cut[head])
        whole = np.arange(len(doc)) < len(rep)
        names = ids.to_pylist()
        keys = [f"{names[h]}:{p}" for h, p in zip(head.tolist(), first.tolist())]
        tail = pa.array(np.where(~whole & (head == (-1 if last is None else last)), number // GROUP, -1))
        return pa.record_batch([pa.array(keys, pa.string()), ids.take(pa.array(doc)).combine_chunks(), pa.array(piece.astype(np.int64)), pa.array((piece * capacity).astype(np.int64)), pa.array(np.where(whole, capacity, size[doc])), pa.array(how, pa.string()), tail], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close() -> pa.RecordBatch:
            return one(held[0].column(0)[0].as_py(), pa.concat_tables(held))

        for b in batches:
            t = pa.Table.from_batches([b])
            number = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for a, z in zip(cuts, cuts[1:]):
                if z > a:
                    if held and held[0].column(0)[0].as_py() != number[a]:
                        yield close()
                        held.clear()
                    held.append(t.slice(a, z - a))
        if held:
            yield close()

    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (16 * shard)))
    packed = cut_lineage(rows.repartition(tasks, "shard").sortWithinPartitions("shard", doc_id).mapInArrow(run, schema))

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        """The last containers of a group of shards, packed anew."""
        pdf = pdf.sort_values(["n_tokens", doc_id], ascending=[False, True], kind="stable").reset_index(drop=True)
        head = best_fit(pdf["n_tokens"].to_numpy(np.int64), capacity)
        names = pdf[doc_id].astype(str) + ":" + pdf["piece"].astype(str)
        pdf["placed_by"] = ["seed" if h == i else "fit" for i, h in enumerate(head)]
        return pdf.assign(container_id=names.to_numpy()[head])[placed.names]

    reopened = packed.where("open >= 0").groupBy("open").applyInPandas(again, placed)
    return packed.where("open < 0").drop("open").unionAll(reopened)


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of the capacity that is used, and of the tokens those placed by retrieval."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.max(F.when(F.col("n_tokens") > capacity, 1).otherwise(0)).alias("over"), F.sum(F.when(F.col("placed_by") == "neighbour", F.col("n_tokens")).otherwise(0)).alias("near"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("n") > capacity, 1).otherwise(F.col("over"))).alias("overfull"), (F.sum("n") / (F.count(F.lit(1)) * capacity)).alias("used_share"), (F.sum("near") / F.sum("n")).alias("neighbour_share"))

