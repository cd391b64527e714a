"""Alignment of two tokenizers' tokens over the same bytes.

A is a byte-level vocabulary, B a piece model that puts a space before the text;
both encode space and text without special tokens, so that their tokens cover the
same bytes. Per batch of documents, ``pandas.merge_asof``, keyed by word, gives
each token start the other side's covering token; the union of both directions
holds every pair of tokens with overlapping bytes. Places where tokens of both
sides end cut a document into groups.

Neither tokenizer joins anything across a single blank between two characters
that are no white space, so each distinct word is encoded once per worker, many
new words in one call; texts with other white space around blanks are encoded
whole, as one word. Tokens, links and groups of a word are the same wherever it
occurs: a batch aligns each distinct word once, saves its links once, and its
documents as word numbers. Counts of id pairs are summed per batch before they are
shuffled, and go back to the batches that asked for them.

Defined cases: a text that is null or empty, or whose bytes do not come back from
both sides, has no tokens: zeros, and an empty string in place of the hash. A text
that spells a special token is plain text. Repeated rows count as often as they
occur, null ids stay null, an empty table gives no rows, other columns are not
looked at. A batch holds a bounded number of characters, or one longer text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.packing import _byte_ranks, default_tokenizer
from tidegraph.llm.scratch import Scratch
from tidegraph.llm.workers import ship_package

BATCH_CHARS = 1 << 21
CACHED_WORDS = 400_000  # per worker; a bound on memory, not on the words handled
JOINED_CHARS = 1 << 12  # of new words encoded by one call, or one longer word
BLOCK_TOKENS = 1 << 16  # aligned at once, or one longer word
BLANK = "▁"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- tokens ---------------------------------------------------------------


class _Side:
    """The ids of all known words, one after the other."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.width = np.array([len(s) for s in spelled], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids, self.starts = array("i"), array("q", [0])

    def spell(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def cuts(self, ids: list[int], ends: np.ndarray) -> np.ndarray | None:
        """How many of the ids end by each of some bytes, unless one reaches over."""
        reached = np.cumsum(self.width[ids])
        n = np.searchsorted(reached, ends, "right")
        return n if n.all() and (reached[n - 1] == ends).all() else None

    def add(self, ids: list[int], cuts: Iterable[int]) -> None:
        before = len(self.ids)
        self.ids.extend(ids)
        self.starts.extend(before + n for n in cuts)

    def cut_back(self, words: int) -> None:
        del self.starts[words + 1 :]
        del self.ids[self.starts[-1] :]

    def gather(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a sequence of words, and how many each word has."""
        n = self.counts(words)
        at = _ranges(np.frombuffer(self.starts, np.int64)[words], n)
        return np.frombuffer(self.ids, np.int32)[at], n

    def counts(self, words: np.ndarray) -> np.ndarray:
        starts = np.frombuffer(self.starts, np.int64)
        return starts[words + 1] - starts[words]


def _ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...``, ``n[0]`` numbers, and so on."""
    before = np.cumsum(n) - n
    return np.arange(int(n.sum()), dtype=np.int64) + np.repeat(starts - before, n)


def _blocks(n: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of words whose numbers add up to some ``most``, more with a large one."""
    block = np.cumsum(n) // most
    cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(n) else np.zeros(1, int)
    return map(slice, cuts[:-1].tolist(), cuts[1:].tolist())


class Words(dict):
    """Numbers of words; what is not known is encoded by both sides."""

    # a blank next to white space or an end
    _UNEVEN = re.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z")
    _BYTE = re.compile(r"<0x([0-9A-F]{2})>")

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        super().__init__()
        with open(a_path, encoding="utf-8") as file:
            described = json.load(file)
        special = {t["content"] for t in described.get("added_tokens", [])}
        vocabulary = {t: i for t, i in described["model"]["vocab"].items() if t not in special}
        ranks = _byte_ranks(vocabulary)
        self._a = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={},
        ).encode_ordinary
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            spelled[i] = token
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self._b = lambda text: pieces.encode(text, num_threads=1)
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.sides = _Side(spelled), _Side([self._piece_bytes(n) for n in names])
        # a piece with a blank inside could reach over words
        self._joins = any(BLANK in n.lstrip(BLANK) for n in names)
        self.whole = bytearray()  # by word: whether the bytes come back
        self.new: list[str] = []

    def _piece_bytes(self, name: str) -> bytes:
        byte = self._BYTE.fullmatch(name)
        return bytes([int(byte[1], 16)]) if byte else name.replace(BLANK, " ").encode()

    def add(self, text: str) -> int:
        whole, given = True, (" " + text).encode()
        for side, ids in zip(self.sides, (self._a(" " + text), self._b(text))):
            side.add(ids, [len(ids)])
            whole &= side.spell(ids) == given
        self.whole.append(whole)
        return len(self.whole) - 1

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)  # encoded when learnt
        self.new.append(word)
        return number

    def learn(self) -> None:
        """Encode the new words, which follow the others."""
        new, at, self.new = self.new, 0, []
        # white space at an end would meet the blanks between words
        uneven = [i for i, w in enumerate(new) if w[:1].isspace() or w[-1:].isspace()]
        for end in (*uneven, len(new)):
            even = new[at:end]
            for some in _blocks(np.array([len(w) + 1 for w in even]), JOINED_CHARS):
                self._learn_joined(even[some])
            for word in new[end : end + 1]:
                self.add(word)
            at = end + 1

    def _learn_joined(self, words: list[str]) -> None:
        """Encode words as one text; in halves, if its bytes don't come back."""
        if len(words) > 1:
            text = " ".join(words)
            given = (" " + text).encode()
            ends = np.flatnonzero(np.frombuffer(given + b" ", np.uint8) == ord(" "))[1:]
            both = [self._a(" " + text), self._b(text)]
            cuts = [s.cuts(ids, ends) if s.spell(ids) == given else None for s, ids in zip(self.sides, both)]
            if any(c is None for c in cuts):
                self._learn_joined(words[: len(words) // 2])
                self._learn_joined(words[len(words) // 2 :])
                return
            for side, ids, n in zip(self.sides, both, cuts):
                side.add(ids, n.tolist())
            self.whole.extend(b"\1" * len(words))
        else:
            self.add(words[0])

    def start(self) -> None:
        """Forget the texts encoded whole, which follow the words, and the words
        too if they are too many, or a batch ended before they were encoded;
        between batches only."""
        if len(self) > min(CACHED_WORDS, len(self.whole)):
            self.clear()
        self.new.clear()
        self.cut_back(len(self))

    def cut_back(self, words: int) -> None:
        del self.whole[words:]
        for side in self.sides:
            side.cut_back(words)

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts in turn, and how many each text has. They
        hold until the next call."""
        self.start()
        found: list[np.ndarray | None] = []
        for text in texts:
            if not text or self._joins or self._UNEVEN.search(text):
                found.append(None)
                continue
            words = text.split(" ")
            some = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
            found.append(some)
        self.learn()
        whole = np.frombuffer(bytes(self.whole), bool)
        for i, some in enumerate(found):
            if some is None or not whole[some].all():
                number = self.add(texts[i]) if texts[i] else -1
                kept = number >= 0 and self.whole[number]
                found[i] = np.array([number] if kept else [], np.int64)
        n = np.array([len(f) for f in found], np.int64)
        return np.concatenate([np.zeros(0, np.int64), *found]), n


@functools.cache
def _words(a_path: str, b_path: str) -> Words:
    return Words(a_path, b_path)


# ---- a batch --------------------------------------------------------------


@dataclass
class Aligned:
    """The tokens of some documents on both sides, their overlaps and common ends.

    ``a_doc, a_id, a_start`` (and ``b_...``) are by token, starts counted over the
    bytes of all; ``link_a, link_b`` number the tokens of each overlapping pair;
    ``a_last`` and ``b_last`` mark tokens that end a group.
    """

    n_docs: int
    a_doc: np.ndarray
    a_id: np.ndarray
    a_start: np.ndarray
    a_last: np.ndarray
    b_doc: np.ndarray
    b_id: np.ndarray
    b_start: np.ndarray
    b_last: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    total: int

    def per_doc(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=self.n_docs)


def align(texts: list[str | None], known: Words) -> Aligned:
    """Align the tokens of some texts."""
    return _aligned(*known.numbers(texts), known)


def _aligned(words: np.ndarray, n_words: np.ndarray, known: Words) -> Aligned:
    """Align the tokens of documents that are sequences of words."""
    doc_of_word = np.repeat(np.arange(len(n_words)), n_words)
    sides = []
    for side in known.sides:
        ids, n = side.gather(words)
        ends = np.cumsum(side.width[ids])
        word = np.repeat(np.arange(len(words)), n)
        sides.append((doc_of_word[word], ids, ends - side.width[ids], ends))
    (a_doc, a_id, a_start, a_end), (b_doc, b_id, b_start, b_end) = sides
    left = pd.DataFrame({"at": a_start, "doc": a_doc, "a": np.arange(len(a_id))})
    right = pd.DataFrame({"at": b_start, "doc": b_doc, "b": np.arange(len(b_id))})
    over_a = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy(np.int64)
    over_b = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy(np.int64)
    # pairs that start together came from both directions
    other = np.flatnonzero(a_start[over_b] != b_start)
    link_a = np.concatenate([np.arange(len(a_id)), over_b[other]])
    link_b = np.concatenate([over_a, other])
    total = int(a_end[-1]) if len(a_end) else 0
    ends = np.zeros(total + 1, np.uint8)
    ends[a_end] = 1
    ends[b_end] |= 2
    return Aligned(len(n_words), a_doc, a_id, a_start, ends[a_end] == 3, b_doc, b_id, b_start,
                   ends[b_end] == 3, link_a, link_b, total)


def spelled_groups(al: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each document, empty without tokens."""
    a_before = np.cumsum(al.a_last) - al.a_last  # group of each token
    b_before = np.cumsum(al.b_last) - al.b_last
    n_groups = int(al.a_last.sum())
    a_n, b_n = np.bincount(a_before, minlength=n_groups), np.bincount(b_before, minlength=n_groups)
    a_upto, b_upto = np.cumsum(a_n), np.cumsum(b_n)
    place_a = np.arange(len(al.a_id)) + (b_upto - b_n)[a_before]
    place_b = np.arange(len(al.b_id)) + a_upto[b_before]
    n = len(al.a_id) + len(al.b_id)
    ids, close = np.empty(n, np.int64), np.full(n, ord(","), np.uint8)
    ids[place_a], ids[place_b] = al.a_id, al.b_id
    close[place_a[al.a_last]], close[place_b[al.b_last]] = ord("|"), ord(";")
    digits = np.ones(n, np.int64)
    for power in range(1, 10):
        digits += ids >= 10**power
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[ends - 1] = close
    left = ids
    for k in range(int(digits.max()) if n else 0):
        has = digits > k if k else slice(None)
        out[(ends - 2 - k)[has]] = 48 + (left % 10)[has]
        left = left // 10
    tokens = al.per_doc(al.a_doc) + al.per_doc(al.b_doc)
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(tokens)])]
    data = out.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:])]


# ---- documents ------------------------------------------------------------


def _some(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, a bounded number of characters at a time."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            if texts and size + len(text or "") > BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "") + 16
        del batch  # the next one takes its place
        if texts:
            yield ids, texts


GROUPS = "doc_id long, group int, start long, length long, a_ids array<int>, b_ids array<int>"


def _group_rows(batches, paths):
    known = _words(*paths)
    for ids, texts in _some(batches):
        al = align(texts, known)
        lasts_a, lasts_b = np.flatnonzero(al.a_last), np.flatnonzero(al.b_last)
        doc = al.a_doc[lasts_a]
        first_a, first_b = np.append(0, lasts_a + 1), np.append(0, lasts_b + 1)
        start = al.a_start[first_a[:-1]] if len(lasts_a) else np.zeros(0, np.int64)
        ends = np.append(start[1:], al.total)[: len(start)]
        opens = np.searchsorted(doc, np.arange(len(ids)))  # first group of each document
        base = start[opens[doc]]
        yield pa.RecordBatch.from_arrays([
            pa.array([ids[d] for d in doc], pa.int64()),
            pa.array(np.arange(len(doc)) - opens[doc], pa.int32()),
            pa.array(start - base, pa.int64()), pa.array(ends - start, pa.int64()),
            pa.ListArray.from_arrays(pa.array(first_a, pa.int32()), pa.array(al.a_id, pa.int32())),
            pa.ListArray.from_arrays(pa.array(first_b, pa.int32()), pa.array(al.b_id, pa.int32())),
        ], names="doc_id group start length a_ids b_ids".split())


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, group, start, length, a_ids, b_ids`` per group of tokens; start and
    length in bytes of space and text."""
    ship_package(docs.sparkSession)
    paths = a_path or default_tokenizer(), b_path or default_pieces()
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _group_rows(batches, paths), GROUPS)


_BATCH = pa.schema([
    ("batch", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())),
    ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())),
    ("groups_sha256", pa.list_(pa.string())), ("n_words", pa.list_(pa.int64())),
    ("words", pa.binary()), ("links_of", pa.list_(pa.int64())), ("links", pa.binary()),
    ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())),
])
BATCH = (
    "batch long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, groups_sha256 array<string>, n_words array<long>, words binary, "
    "links_of array<long>, links binary, pairs array<long>, n array<long>"
)


def _batch_rows(batches, paths):
    """A row per batch: its documents, the links of its distinct words, and how
    often it links each pair of ids."""
    known, part = _words(*paths), TaskContext.get().partitionId() << 32
    for number, (ids, texts) in enumerate(_some(batches)):
        words, n_words = known.numbers(texts)
        # tokens, links and groups lie inside words: each distinct one is aligned once
        distinct, word = np.unique(words, return_inverse=True)
        times = np.bincount(word, minlength=len(distinct))
        by_word, spelled, parts = np.zeros((4, len(distinct)), np.int64), [], [np.zeros((2, 0), np.int64)]
        for at in _blocks(known.sides[0].counts(distinct), BLOCK_TOKENS):
            al = _aligned(distinct[at], np.ones(at.stop - at.start, np.int64), known)
            of = al.a_doc[al.link_a]
            order = np.argsort(of, kind="stable")
            codes = al.a_id[al.link_a].astype(np.int64) << 32 | al.b_id[al.link_b]
            parts.append(np.stack([codes, of + at.start])[:, order])
            spelled += spelled_groups(al)
            for i, some in enumerate((al.a_doc, al.b_doc, al.a_doc[al.a_last], of)):
                by_word[i, at] = al.per_doc(some)
        codes, of = np.concatenate(parts, axis=1)
        pairs, pair = np.unique(codes, return_inverse=True)
        n = np.zeros(len(pairs), np.int64)
        np.add.at(n, pair, times[of])
        del parts, codes, of
        columns = [
            part + number, ids, *(_summed(v[word], n_words) for v in by_word),
            _hashes(spelled, word, n_words), n_words, zlib.compress(word.astype("<u4").tobytes(), 1),
            by_word[3], zlib.compress(pair.astype("<u4").tobytes(), 1), pairs, n,
        ]
        del spelled, pair, word
        yield pa.RecordBatch.from_arrays(
            [_one(c, f.type) for c, f in zip(columns, _BATCH)], schema=_BATCH)


def _summed(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sums of the first ``n[0]`` values, of the next ``n[1]``, and so on."""
    upto, ends = np.append(0, np.cumsum(values)), np.append(0, np.cumsum(n))
    return upto[ends[1:]] - upto[ends[:-1]]


def _hashes(spelled: list[bytes], word: np.ndarray, n_words: np.ndarray) -> list[str]:
    """The hash of each document's groups, those of its words in turn."""
    out, ends = [], np.cumsum(n_words)
    for start, end in zip((ends - n_words).tolist(), ends.tolist()):
        groups = b";".join(map(spelled.__getitem__, word[start:end].tolist()))
        out.append(hashlib.sha256(groups).hexdigest() if groups else "")
    return out


def _one(value, kind: pa.DataType) -> pa.Array:
    """A column of one row."""
    if not pa.types.is_list(kind):
        return pa.array([value], kind)
    return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.array(value, kind.value_type))


REPORT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string"
)


def _report_rows(batches):
    """The rows of each batch's documents, from what its pairs count corpus-wide."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            count = np.zeros(row["n_pairs"].as_py(), np.int64)
            best = np.zeros(len(count), np.int64)
            if row["counted"].is_valid:
                place, total, is_best = row["counted"].values.flatten()
                count[place] = total
                best[place] = is_best.to_numpy(zero_copy_only=False)
            links = np.frombuffer(zlib.decompress(row["links"].as_py()), "<u4")
            words = np.frombuffer(zlib.decompress(row["words"].as_py()), "<u4")
            links_of, n_words = (row[k].values.to_numpy() for k in ("links_of", "n_words"))
            sums = [
                pa.array(_summed(_summed(v[links], links_of)[words], n_words), pa.int64())
                for v in (best, count)
            ]
            given = [row[k].values for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays(
                [*given, *sums, row["groups_sha256"].values], names=[f.split()[0] for f in REPORT.split(", ")])


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per
    document. An id pair's count is the number of links that hold it in all
    documents; ``n_best`` are links whose count is the highest of their B id."""
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    paths = a_path or default_tokenizer(), b_path or default_pieces()
    batches = scratch.save(
        docs.select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(lambda rows: _batch_rows(rows, paths), BATCH))
    zipped = F.posexplode(F.arrays_zip("pairs", "n")).alias("place", "of")
    asked = batches.select("batch", zipped).select(
        "batch", "place", F.col("of.pairs").alias("pair"), F.col("of.n").alias("n"))
    total = scratch.save(asked.groupBy("pair").agg(F.sum("n").alias("total")))
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = total.groupBy(b_id.alias("b")).agg(F.max("total").alias("most"))
    judged = total.withColumn("b", b_id).join(most, "b").select(
        "pair", "total", (F.col("total") == F.col("most")).alias("best"))
    # a batch asks for a pair once: no pair has more rows than there are batches
    counted = (
        asked.select("batch", "place", "pair").join(judged, "pair")
        .groupBy("batch").agg(F.collect_list(F.struct("place", "total", "best")).alias("counted")))
    return (
        batches.withColumn("n_pairs", F.size("pairs")).drop("pairs", "n")
        .join(counted, "batch", "left").mapInArrow(_report_rows, REPORT))
