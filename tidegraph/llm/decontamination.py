"""Benchmark passages in training documents, by suffix arrays.

Every task turns its documents into shards of a bounded number of words and builds
a suffix array of each: word numbers in order, suffixes sorted by prefix doubling.
Words that no benchmark item holds end every match, so they share one number, and
suffixes that begin with one are left out. All test suffixes are searched at once
by binary search: those that begin a window give the range of its occurrences, and
their neighbours in the array give the longest verbatim match.

A window is ``width`` successive words of an item; an item of fewer is one window.
Benchmarks go to the tasks in blocks of bounded size, one pass over the documents
for each, and what the passes find in a document is united by its id and digest.

Words are compared by 64-bit hashes. Documents longer than a shard are cut with an
overlap, so no window is lost at a cut.

Defined cases: a null text has no words, an item without words no windows; a row
of the benchmark without an id marks words, but is not listed. Repeated rows of
documents are judged one by one, repeated ids of the benchmark count once. Empty
tables, on either side, mark nothing. Other columns are not looked at; the filter
returns all of them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.words import term_hashes
from tidegraph.llm.workers import ship_package

WIDTH = 10
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 8 << 20  # of benchmark text in a task at once, or one longer item

# ---- suffix arrays --------------------------------------------------------


@dataclass
class SuffixArray:
    """Word numbers (0 ends a match) and the places of suffixes in their order,
    which compares the first ``depth`` words or up to the first 0."""

    words: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, most: int, depth: int) -> SuffixArray:
        """``words`` of 0 to ``most``, ended by a 0."""
        places = np.flatnonzero(words)
        if not len(places):
            return cls(words, places)
        padded = np.concatenate([words, np.zeros(64, words.dtype)])
        bits = max(1, int(most).bit_length())
        known = max(1, min(63 // bits, depth, 16))  # words that fit one key
        key, open_ = np.zeros(len(places), np.int64), np.ones(len(places), bool)
        for k in range(known):
            word = padded[places + k]
            open_ &= word > 0
            key = key << bits | np.where(open_, word, 0)
        order = np.argsort(key, kind="stable")
        places, key = places[order], key[order]
        open_ = open_[order]
        rank = np.zeros(len(words) + 1, np.int64)  # first slot of equals, from 1; 0 ends
        new = np.append(True, key[1:] != key[:-1])
        slot = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        rank[places] = slot + 1
        # slots of equals that are not yet told apart and don't end together
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone & open_)
        while known < depth and len(slots):
            some = places[slots]
            group, after = rank[some], rank[np.minimum(some + known, len(words))]
            order = np.lexsort((after, group))
            some, group, after = some[order], group[order], after[order]
            places[slots] = some
            new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
            rank[some] = slots[first] + 1
            alone = new & np.append(new[1:], True)
            slots = slots[~alone & (after > 0)]
            known *= 2
        return cls(words, places)

    def _compare(self, slots, test, at, n) -> np.ndarray:
        """Order of the suffixes in ``slots`` against ``n`` words of ``test`` from
        ``at`` on: negative, 0 where they begin with them, positive."""
        result = np.zeros(len(slots), np.int64)
        left = np.arange(len(slots))
        k = 0
        while len(left):
            left = left[n[left] > k]
            place = np.minimum(self.places[slots[left]] + k, len(self.words) - 1)
            result[left] = self.words[place] - test[at[left] + k]
            left = left[result[left] == 0]
            k += 1
        return result

    def search(self, test, at, n, upper: bool = False) -> np.ndarray:
        """The first slot not before (or, ``upper``, after) ``n`` words of ``test``
        from ``at`` on, for arrays of places and lengths."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(self.places), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            order = self._compare(middle, test, at[open_], n[open_])
            right = order < 0 if not upper else order <= 0
            low[open_[right]] = middle[right] + 1
            high[open_[~right]] = middle[~right]

    def common(self, slots, test, at, n) -> np.ndarray:
        """How many words the suffixes in ``slots`` share with ``test`` from ``at``
        on, ``n`` at most; 0 for slots outside."""
        result = np.zeros(len(slots), np.int64)
        left = np.flatnonzero((slots >= 0) & (slots < len(self.places)))
        k = 0
        while len(left):
            left = left[n[left] > k]
            place = np.minimum(self.places[slots[left]] + k, len(self.words) - 1)
            left = left[self.words[place] == test[at[left] + k]]
            k += 1
            result[left] = k
        return result


# ---- the benchmark --------------------------------------------------------


@dataclass
class Tests:
    """Test suffixes of some items, and the distinct windows among them."""

    vocabulary: np.ndarray  # sorted hashes; a word's number is its place from 1
    words: np.ndarray  # numbers of all items in turn
    at: np.ndarray  # every test suffix: its place,
    n: np.ndarray  # the words to the end of its item,
    item: np.ndarray  # and its item
    names: list[str | None]
    window_at: np.ndarray  # distinct windows: a place,
    window_n: np.ndarray  # a length,
    window_items: list[np.ndarray] = field(default_factory=list)  # and the items with it

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], width: int) -> Tests:
        hashes = list(term_hashes([text for _, text in rows]))
        lengths = np.array([len(h) for h in hashes], np.int64)
        vocabulary, words = np.unique(
            np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
        words = words.astype(np.int64) + 1
        starts = np.cumsum(lengths) - lengths
        item = np.repeat(np.arange(len(rows)), lengths)
        at = np.arange(len(words))
        n = np.repeat(starts + lengths, lengths) - at
        begins = (n >= width) | (at == np.repeat(starts, lengths))
        which: dict[bytes, int] = {}
        places, sizes, items = [], [], []
        for i in np.flatnonzero(begins):
            size = min(int(n[i]), width)
            seat = which.setdefault(words[i : i + size].tobytes(), len(places))
            if seat == len(places):
                places.append(int(i))
                sizes.append(size)
                items.append(set())
            items[seat].add(int(item[i]))
        return cls(vocabulary, words, at, n, item, [name for name, _ in rows],
                   np.array(places, np.int64), np.array(sizes, np.int64),
                   [np.array(sorted(s), np.int64) for s in items])

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of words, 0 for those of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, 0).astype(np.int32)


def blocks_of(benchmark: DataFrame, width: int = WIDTH, block_bytes: int | None = None) -> Iterator[Tests]:
    """The items, as many at a time as a block holds."""
    block_bytes = block_bytes or BLOCK_BYTES
    rows, size = [], 0
    named = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for name, text in named.toLocalIterator():
        n = len((text or "").encode("utf-8", "replace"))
        if rows and size + n > block_bytes:
            yield Tests.of(rows, width)
            rows, size = [], 0
        rows.append((name, text))
        size += n
    yield Tests.of(rows, width)


# ---- documents ------------------------------------------------------------


def _shards(texts: list[str | None], tests: Tests, overlap: int) -> Iterator[list[tuple]]:
    """Lists of ``(row, first word, word numbers)`` for shards of bounded size;
    a long document is dealt to several, in pieces that overlap."""
    shard, size = [], 0
    for row, hashes in enumerate(term_hashes(texts)):
        step = SHARD_WORDS
        for first in range(0, max(len(hashes), 1), step):
            piece = tests.numbers(hashes[first : first + step + overlap])
            if shard and size + len(piece) > SHARD_WORDS:
                yield shard
                shard, size = [], 0
            shard.append((row, first, piece, len(hashes)))
            size += len(piece) + 1
    if shard:
        yield shard


def _joined(shard: list[tuple], tests: Tests, depth: int) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of a shard, and where its documents start."""
    end = np.zeros(1, np.int32)
    words = np.concatenate([part for _, _, piece, _ in shard for part in (piece, end)])
    starts = np.cumsum([0] + [len(piece) + 1 for _, _, piece, _ in shard])[:-1]
    return SuffixArray.of(words, len(tests.vocabulary), depth), starts


def _hits(shard: list[tuple], tests: Tests, width: int):
    """``(row, marked words, first, items)`` of the documents with a window."""
    suffixes, starts = _joined(shard, tests, width)
    low = suffixes.search(tests.words, tests.window_at, tests.window_n)
    high = suffixes.search(tests.words, tests.window_at, tests.window_n, upper=True)
    n = high - low
    if not n.sum():
        return
    window = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(n) - n
    place = suffixes.places[np.arange(len(window)) - np.repeat(before - low, n)]
    change = np.zeros(len(suffixes.words) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + tests.window_n[window], -1)
    marked = np.cumsum(change) > 0
    doc = np.searchsorted(starts, place, side="right") - 1
    pairs = np.unique(doc * len(n) + window)
    docs, windows = pairs // len(n), pairs % len(n)
    cuts = np.append(np.flatnonzero(np.append(True, docs[1:] != docs[:-1])), len(docs))
    for a, b in zip(cuts, cuts[1:]):
        row, first, piece, _ = shard[docs[a]]
        start = starts[docs[a]]
        items = np.unique(np.concatenate([tests.window_items[w] for w in windows[a:b]]))
        yield row, first, marked[start : start + len(piece)], items


def _spans(marked: list[tuple[int, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the marked words of a document, from its pieces."""
    starts: list[int] = []
    ends: list[int] = []
    for first, mark in marked:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]]))) + first
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if ends and a <= ends[-1]:
                ends[-1] = max(ends[-1], b)
            else:
                starts.append(a)
                ends.append(b)
    return starts, ends


FOUND = "doc_id long, digest string, n_words long, starts array<long>, ends array<long>, items array<string>"


def _found_rows(batches: Iterator[pa.RecordBatch], tests: Tests, width: int):
    for batch in batches:
        texts = batch.column(2).to_pylist()
        n_words = np.zeros(len(texts), np.int64)
        marked, named = defaultdict(list), defaultdict(set)
        for shard in _shards(texts, tests, width - 1):
            for row, _, _, n in shard:
                n_words[row] = n
            for row, first, mark, items in _hits(shard, tests, width):
                marked[row].append((first, mark))
                named[row].update(tests.names[i] for i in items if tests.names[i] is not None)
        spans = [_spans(marked[i]) if i in marked else ([], []) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(n_words),
            pa.array([s for s, _ in spans], pa.list_(pa.int64())),
            pa.array([e for _, e in spans], pa.list_(pa.int64())),
            pa.array([sorted(named.get(i, ())) for i in range(len(texts))], pa.list_(pa.string())),
        ], names="doc_id digest n_words starts ends items".split())


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("digest"), "text")


def _united(rows: DataFrame, passes: int) -> DataFrame:
    """The rows of several passes, one per document and not per pass."""
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    grouped = rows.groupBy("doc_id", "digest").agg(
        F.count("*").alias("copies"), F.first("n_words").alias("n_words"),
        F.array_sort(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr("""
      aggregate(spans, cast(array() as array<struct<starts: bigint, ends: bigint>>), (acc, x) ->
        case when size(acc) > 0 and x.starts <= element_at(acc, -1).ends
          then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).starts as starts,
                 greatest(element_at(acc, -1).ends, x.ends) as ends)))
          else concat(acc, array(x)) end)""")
    one_each = F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"copies div {passes}")))
    return grouped.withColumn("spans", merged).withColumn("copy", one_each).select(
        "doc_id", "digest", "n_words", F.col("spans.starts").alias("starts"),
        F.col("spans.ends").alias("ends"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, digest, n_words, starts, ends, items`` per document: the spans of
    words in windows of the benchmark, and the ids of the items, sorted as text."""
    spark = docs.sparkSession
    ship_package(spark)
    source, passes = _digested(docs), []
    for tests in blocks_of(benchmark, width):
        sent = spark.sparkContext.broadcast(tests)  # a block at most
        passes.append(source.mapInArrow(
            lambda rows, sent=sent: _found_rows(rows, sent.value, width), FOUND))
    if len(passes) == 1:
        return passes[0]
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.union(more)
    return _united(rows, len(passes))


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    n_hit = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    return contamination(docs, benchmark, width).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without a window of the benchmark, with all their columns."""
    bad = contamination(docs, benchmark, width).where(F.size("starts") > 0).select(
        F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest"))
    digest = F.md5(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (digest == F.col("_bad_digest"))
    return docs.join(bad, same, "left_anti")


LONGEST = "item_id string, item_word long, n_words long, doc_id long, doc_word long"


def _longest_rows(batches: Iterator[pa.RecordBatch], tests: Tests, least: int):
    depth = int(tests.n.max()) if len(tests.n) else 1
    starts_of = tests.at - (np.arange(len(tests.at)) - np.searchsorted(tests.item, tests.item))
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for shard in _shards(texts, tests, depth - 1):
            suffixes, starts = _joined(shard, tests, depth)
            slot = suffixes.search(tests.words, tests.at, tests.n)
            before = suffixes.common(slot - 1, tests.words, tests.at, tests.n)
            after = suffixes.common(slot, tests.words, tests.at, tests.n)
            n = np.maximum(before, after)
            chosen = np.where(after >= before, slot, slot - 1)
            found = np.flatnonzero(n >= least)
            # the longest of each item; the first of equals
            found = found[np.lexsort((tests.at[found], -n[found], tests.item[found]))]
            found = found[np.append(True, np.diff(tests.item[found]) > 0)[: len(found)]]
            place = suffixes.places[chosen[found]]
            doc = np.searchsorted(starts, place, side="right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array([tests.names[i] for i in tests.item[found]], pa.string()),
                pa.array((tests.at - starts_of)[found], pa.int64()), pa.array(n[found], pa.int64()),
                pa.array([ids[shard[d][0]] for d in doc], pa.int64()),
                pa.array([int(p - starts[d] + shard[d][1]) for p, d in zip(place, doc)], pa.int64()),
            ], names=[f.split()[0] for f in LONGEST.split(", ")])


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """``item_id, item_word, n_words, doc_id, doc_word``: the longest run of words
    that each item shares with a document, and where; none below ``least`` words."""
    spark = docs.sparkSession
    ship_package(spark)
    source = docs.select(F.col("doc_id").cast("long"), "text")
    found = spark.createDataFrame([], LONGEST)
    for tests in blocks_of(benchmark, 1):
        sent = spark.sparkContext.broadcast(tests)
        found = found.union(source.mapInArrow(
            lambda rows, sent=sent: _longest_rows(rows, sent.value, least), LONGEST))
    # a row per shard and item; the first places among equals
    order = F.struct(F.col("n_words"), -F.col("item_word"), -F.col("doc_id"), -F.col("doc_word"))
    best = F.max_by(F.struct("item_word", "n_words", "doc_id", "doc_word"), order)
    return found.groupBy("item_id").agg(best.alias("best")).select("item_id", "best.*")
