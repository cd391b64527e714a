"""Ranked lexical search over posting lists in geometric blocks.

Documents become vectors over the terms of the queries, saved once. Every task
joins its vectors to shards of bounded size and indexes each: a posting list per
term, clustered by document similarity (places in a random projection, around
members of the list) into blocks, and per block the coordinatewise maximum of its
vectors. A query opens its lists from the term that can add most. The sum of a
block's summary over the query's terms is an exact bound of the scores in it, and
the block is skipped only if that is below the score of the last document found so
far; so is the rest of the lists, if what their terms can add is below it. The
documents of the other blocks are scored in full. Nothing is approximate.

A summary holds the terms that share a query with its list, as no other is asked
for. Queries go to the tasks in blocks of bounded size, one pass for each; the best
of all shards are ranked by Spark. Terms are compared by 64-bit hashes.

Defined cases: null and empty texts have no terms, are not counted and not found,
as queries find nothing. Each row of the queries is ranked by itself, and repeated
rows of documents are found each. Documents without an id come last among equals.
An empty table on either side gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch
from tidegraph.llm.words import term_hashes
from tidegraph.llm.workers import ship_package

BEST = 10
BLOCK_BYTES = 1 << 18  # of query text in a task at once, or one longer query
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 1 << 22
BLOCK, MOST_BLOCKS = 64, 256  # documents to a block, as planned; blocks to a list
CELLS = 1 << 22  # of one list's summaries
SUMMARY_BYTES = 128 << 20  # kept at once; forgotten beyond that and made anew
DIMENSIONS = 16
_STEP = 1 << 20  # postings handled in one vector step


# ---- queries --------------------------------------------------------------


@dataclass
class Queries:
    """Some queries, and their terms by number."""

    first: int  # number of the first of them
    ids: list[str | None]
    vocabulary: np.ndarray  # sorted hashes
    terms: list[np.ndarray]  # distinct term numbers of each

    @classmethod
    def of(cls, first: int, rows: list[tuple]) -> Queries:
        hashes = [np.unique(h) for h in term_hashes([text for _, text in rows])]
        vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        return cls(first, [i for i, _ in rows], vocabulary,
                   [np.searchsorted(vocabulary, h) for h in hashes])

    def beside(self) -> list[np.ndarray]:
        """The terms that share a query with each term."""
        sets: list[set] = [set() for _ in self.vocabulary]
        for terms in self.terms:
            for t in terms:
                sets[t].update(terms.tolist())
        return [np.array(sorted(s), np.int64) for s in sets]


def blocks_of(queries: DataFrame, block_bytes: int | None = None) -> Iterator[Queries]:
    """The queries, as many at a time as a block holds."""
    block_bytes = block_bytes or BLOCK_BYTES
    rows, size, first = [], 0, 0
    for query, text in queries.select("item_id", F.col("text").cast("string")).toLocalIterator():
        n = len((text or "").encode("utf-8", "replace"))
        if rows and size + n > block_bytes:
            yield Queries.of(first, rows)
            first += len(rows)
            rows, size = [], 0
        rows.append((query, text))
        size += n
    if rows:
        yield Queries.of(first, rows)


# ---- vectors --------------------------------------------------------------

VECTOR = "doc_id long, n long, terms binary, tf binary"


def _vector_rows(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray):
    """The documents with a term: their length, and the query terms in them."""
    for batch in batches:
        rows = []
        ids = batch.column(0).to_pylist()
        for doc_id, hashes in zip(ids, term_hashes(batch.column(1).to_pylist())):
            if not len(hashes):
                continue
            at = np.searchsorted(vocabulary, hashes)
            at[at == len(vocabulary)] = 0
            known = at[vocabulary[at] == hashes] if len(vocabulary) else at[:0]
            terms, tf = np.unique(known, return_counts=True)
            rows.append((doc_id, len(hashes), terms.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names="doc_id n terms tf".split())


def _frequency_rows(batches: Iterator[pa.RecordBatch], size: int):
    """How many of a task's documents hold each term."""
    n = np.zeros(size, np.int64)
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4")
        n += np.bincount(terms, minlength=size)
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held])], names=["term", "n"])


# ---- a shard --------------------------------------------------------------


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    before = np.cumsum(n) - n
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(starts - before, n)


@dataclass
class Blocks:
    """A posting list in blocks: block ``i`` is ``docs[starts[i]:starts[i + 1]]`` and
    ``most[i]`` its summary, over the terms ``over``."""

    docs: np.ndarray
    starts: np.ndarray
    over: np.ndarray
    most: np.ndarray


class Shard:
    """An index of some documents: vectors, posting lists, and the blocks of the
    lists that were opened."""

    def __init__(self, ids: list, cuts: np.ndarray, terms: np.ndarray, adds: np.ndarray,
                 beside: list[np.ndarray]):
        """``adds[cuts[d]:cuts[d + 1]]`` is what document ``d`` scores for each of its
        ``terms``; no document is without terms."""
        size, n = len(beside), np.diff(cuts)
        self.null = np.array([i is None for i in ids], bool)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.cuts, self.terms, self.adds, self.beside = cuts, terms, adds, beside
        doc = np.repeat(np.arange(len(n)), n)
        order = np.argsort(terms, kind="stable")
        self.postings = doc[order]
        self.lists = np.searchsorted(terms[order], np.arange(size + 1))
        self.top = np.zeros(size, np.int64)  # the most a term adds to a document here
        np.maximum.at(self.top, terms, adds)
        self.places = self._project(size)
        self.opened: dict[int, Blocks] = {}
        self.kept = 0
        self._asked = np.zeros(size, bool)
        self._column = np.full(size, -1, np.int64)

    def _project(self, size: int) -> np.ndarray:
        axes = np.random.default_rng(12).standard_normal((size, DIMENSIONS)).astype(np.float32)
        places = np.zeros((len(self.cuts) - 1, DIMENSIONS), np.float32)
        for a, b in self._stretches(np.arange(len(places))):
            low, high = self.cuts[a], self.cuts[b]
            weighed = axes[self.terms[low:high]] * self.adds[low:high, None].astype(np.float32)
            places[a:b] = np.add.reduceat(weighed, self.cuts[a:b] - low, axis=0)
        return places / np.maximum(np.linalg.norm(places, axis=1, keepdims=True), 1e-9)

    def _stretches(self, docs: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of ``docs`` with a bounded number of postings, or one document."""
        upto = np.cumsum(self.cuts[docs + 1] - self.cuts[docs])
        a = 0
        while a < len(docs):
            done = upto[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(upto, done + _STEP, side="right")))
            yield a, b
            a = b

    def open(self, term: int) -> Blocks:
        """The blocks of a posting list, made when it is first asked for."""
        if term in self.opened:
            return self.opened[term]
        docs, over = self.postings[self.lists[term] : self.lists[term + 1]], self.beside[term]
        n = min(-(-len(docs) // BLOCK), MOST_BLOCKS, max(1, CELLS // len(over)))
        block = np.zeros(len(docs), np.int64)
        if n > 1:  # each document goes to the most similar of n members
            heads = self.places[docs[np.arange(n) * len(docs) // n]].T
            for a in range(0, len(docs), 1 << 14):
                block[a : a + (1 << 14)] = (self.places[docs[a : a + (1 << 14)]] @ heads).argmax(axis=1)
            order = np.argsort(block, kind="stable")
            docs, block = docs[order], block[order]
        new = np.append(True, block[1:] != block[:-1])
        starts, block = np.append(np.flatnonzero(new), len(docs)), np.cumsum(new) - 1
        most = np.zeros((len(starts) - 1, len(over)), np.int64)
        self._column[over] = np.arange(len(over))
        for a, b in self._stretches(docs):
            lengths = self.cuts[docs[a:b] + 1] - self.cuts[docs[a:b]]
            at = _ranges(self.cuts[docs[a:b]], lengths)
            column = self._column[self.terms[at]]
            cell = np.repeat(block[a:b], lengths) * len(over) + column
            np.maximum.at(most.reshape(-1), cell[column >= 0], self.adds[at[column >= 0]])
        self._column[over] = -1
        if self.kept > SUMMARY_BYTES:
            self.opened.clear()
            self.kept = 0
        self.kept += most.nbytes
        self.opened[term] = Blocks(docs, starts, over, most)
        return self.opened[term]

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The full scores of documents."""
        self._asked[terms] = True
        parts = [np.zeros(0, np.int64)]
        for a, b in self._stretches(docs):
            lengths = self.cuts[docs[a:b] + 1] - self.cuts[docs[a:b]]
            at = _ranges(self.cuts[docs[a:b]], lengths)
            adds = np.where(self._asked[self.terms[at]], self.adds[at], 0)
            parts.append(np.add.reduceat(adds, np.cumsum(lengths) - lengths))
        self._asked[terms] = False
        return np.concatenate(parts)

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents of a query, by place in the shard, and scores."""
        terms = terms[self.top[terms] > 0]
        terms = terms[np.argsort(-self.top[terms], kind="stable")]
        rest = np.cumsum(self.top[terms][::-1])[::-1]
        seen = np.zeros(len(self.ids), bool)
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        for term, most in zip(terms.tolist(), rest.tolist()):
            if most < least:  # what was not seen has only these terms
                break
            blocks = self.open(term)
            bounds = blocks.most[:, np.searchsorted(blocks.over, terms)].sum(axis=1)
            order = np.argsort(-bounds, kind="stable")
            at, step = 0, 1
            while at < len(order):
                some = order[at : at + step]
                some = some[bounds[some] >= least]
                if not len(some):
                    break
                at, step = at + step, step * 2
                new = blocks.docs[_ranges(blocks.starts[some], blocks.starts[some + 1] - blocks.starts[some])]
                new = new[~seen[new]]
                seen[new] = True
                docs = np.append(docs, new)
                scores = np.append(scores, self.scores(new, terms))
                best = np.lexsort((self.ids[docs], self.null[docs], -scores))[:k]
                docs, scores = docs[best], scores[best]
                if len(docs) == k:
                    least = int(scores[-1])
        return docs[scores > 0], scores[scores > 0]


# ---- on Spark -------------------------------------------------------------

FOUND = "query long, item_id long, doc_id long, score long"


@dataclass
class Corpus:
    """What scores depend on beside the document."""

    n_docs: int
    n_terms: int
    weights: np.ndarray

    def adds(self, terms: np.ndarray, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What each term adds, for documents of ``n`` terms in all."""
        length = 10 + (90 * n * self.n_docs) // self.n_terms
        return self.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * length))


def _shards(batches, corpus: Corpus, beside: list[np.ndarray]) -> Iterator[Shard]:
    held: list[tuple] = []
    postings = 0

    def shard() -> Shard:
        lengths = np.array([len(t) // 4 for _, _, t, _ in held], np.int64)
        terms = np.frombuffer(b"".join(t for _, _, t, _ in held), "<u4").astype(np.int64)
        tf = np.frombuffer(b"".join(c for *_, c in held), "<u4").astype(np.int64)
        n = np.repeat(np.array([n for _, n, _, _ in held], np.int64), lengths)
        cuts = np.append(0, np.cumsum(lengths))
        return Shard([i for i, *_ in held], cuts, terms, corpus.adds(terms, tf, n), beside)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if not row[2]:
                continue
            if held and (len(held) >= SHARD_DOCS or postings + len(row[2]) // 4 > SHARD_POSTINGS):
                yield shard()
                held, postings = [], 0
            held.append(row)
            postings += len(row[2]) // 4
    if held:
        yield shard()


def _found_rows(batches, queries: Queries, corpus: Corpus, k: int):
    beside = queries.beside()
    for shard in _shards(batches, corpus, beside):
        columns: list[list] = [[], [], [], []]
        for i, (query, terms) in enumerate(zip(queries.ids, queries.terms)):
            docs, scores = shard.search(terms, k)
            columns[0] += [queries.first + i] * len(docs)
            columns[1] += [query] * len(docs)
            columns[2] += [None if shard.null[d] else int(shard.ids[d]) for d in docs]
            columns[3] += scores.tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])


def ranked(docs: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best of ``docs(doc_id, text)`` for each
    row of ``queries(item_id, text)``, equal scores by ascending id."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    found = spark.createDataFrame([], FOUND)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    asked = queries.select(F.col("item_id").cast("long"), "text")
    for some in blocks_of(asked):
        vocabulary = spark.sparkContext.broadcast(some.vocabulary)
        vectors = scratch.save(source.mapInArrow(
            lambda rows, v=vocabulary: _vector_rows(rows, v.value), VECTOR))
        size = len(some.vocabulary)
        held = vectors.select("terms").mapInArrow(
            lambda rows, size=size: _frequency_rows(rows, size), "term long, n long")
        frequency = np.zeros(size, np.int64)
        for row in held.groupBy("term").agg(F.sum("n").alias("n")).collect():  # a block's terms
            frequency[row["term"]] = row["n"]
        total = vectors.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        weights = [math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(n) + 1))) for n in frequency]
        corpus = Corpus(total["docs"], total["terms"] or 1, np.array(weights, np.int64))
        sent = spark.sparkContext.broadcast((some, corpus))
        found = found.union(vectors.mapInArrow(
            lambda rows, sent=sent: _found_rows(rows, *sent.value, k), FOUND))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("item_id", "rank", "doc_id", "score"))
