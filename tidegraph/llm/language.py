"""Language identification by a linear-chain conditional random field.

Every word has a hidden language. Its features are affixes, character trigrams
with word boundaries, and whether it stands in the lexicon of a language; the
languages of neighbouring words are tied by learned transitions. Forward-backward
gives each word's probabilities, also where a text switches languages, and a
document's language is the one with the largest mean probability.

The model is fitted on the driver from a bounded sample of labelled documents
(``PER_LANGUAGE`` texts, ``SAMPLE_CHARS`` of each); half of the training
sequences are spliced from texts of different languages, so that transitions are
learned from switches too. It labels whole texts, in vector steps over the words
of many documents at a time; texts over 2 MB in parts of that size.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so
is every text if there is nothing to learn from. Null labels are not learned
from. Equal texts count once in the sample. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.workers import ship_package

PER_LANGUAGE = 120
SAMPLE_CHARS = 800
LEXICON = 4_000  # most telling words
ROWS = 1 << 16  # of each hashed feature table
SLICE = 1 << 21
UNKNOWN = "und"
STEPS, LEARNING_RATE, PENALTY = 30, 0.5, 2e-4


# ---- words and features ---------------------------------------------------

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Words:
    """The words of a stretch of lower-cased bytes."""

    codes: np.ndarray  # bytes with all but letters set to 0, one 0 at each end
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, data: bytes) -> Words:
        codes = np.zeros(len(data) + 2, np.uint32)
        raw = np.frombuffer(data, np.uint8)
        letter = _LETTER[raw]
        codes[1:-1] = np.where(letter, raw, 0)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])))) + 1
        return cls(codes, edges[::2], edges[1::2])

    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the trigram table, and each word's first one: from the
        boundary before a word to the one behind it."""
        c = self.codes
        rows = (c[:-2] * np.uint32(40503) + c[1:-1] * np.uint32(9176401) + c[2:] * np.uint32(2654435761))
        rows = ((rows ^ (rows >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16)
        inside = np.ones(len(rows), bool)
        # positions that start at a boundary and don't lead into a word
        inside[np.flatnonzero((c[1:-1] == 0))] = False
        kept = np.flatnonzero(inside)
        return rows[kept], np.searchsorted(kept, self.starts - 1)

    def affixes(self) -> list[np.ndarray]:
        """Rows of the affix table: prefixes and suffixes of two and three bytes
        (shorter words: with the boundary)."""
        c = np.concatenate((self.codes, np.zeros(2, np.uint32)))
        s, e = self.starts, self.ends
        found = []
        for kind, (a, b, d) in enumerate((
            (c[s], c[s + 1], np.uint32(0)), (c[s], c[s + 1], np.where(e - s > 1, c[s + 2], 0)),
            (c[e - 1], c[e - 2], np.uint32(0)), (c[e - 1], c[e - 2], np.where(e - s > 1, c[e - 3], 0)),
        )):
            h = (a * np.uint32(2654435761) + b * np.uint32(40503) + d * np.uint32(9176401)
                 + np.uint32(kind * 7919))
            found.append(((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(16))
        return found

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        up = np.full(len(self.codes), 0x100000001B3, np.uint64)
        up[0] = 1
        up = np.multiply.accumulate(up)
        down = np.full(len(self.codes), pow(0x100000001B3, -1, 1 << 64), np.uint64)
        down[0] = 1
        down = np.multiply.accumulate(down)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(self.codes.astype(np.uint64) * up)))
        return (sums[self.ends] - sums[self.starts]) * down[self.starts]


# ---- the chain ------------------------------------------------------------


def marginals(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray,
              count_pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word probabilities for chains laid end to end; ``first`` marks their starts.
    With ``count_pairs`` also the expected number of each transition.

    Exact forward-backward in about two square roots of the number of words vector
    steps: the chain is cut in blocks of equal length; each block's transfer matrix
    carries messages from block to block, then all blocks run side by side. A
    chain's start forgets what came before, so chains need no bounds of their own.
    """
    n, k = scores.shape
    length = max(1, int(np.sqrt(n)))
    blocks = -(-n // length)
    e = np.ones((blocks * length, k))
    e[:n] = np.exp(scores - scores.max(axis=1, keepdims=True))
    f = np.ones(blocks * length, bool)  # what is behind the last word says nothing
    f[:n] = first
    e, f = e.reshape(blocks, length, k), f.reshape(blocks, length)
    follow = np.exp(trans)
    begin = np.tile(np.exp(start), (k, 1))

    def step(i: int) -> np.ndarray:
        return np.where(f[:, i, None, None], begin, follow) * e[:, i, None, :]

    product = np.tile(np.eye(k), (blocks, 1, 1))
    for i in range(length):
        product = product @ step(i)
        product /= product.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    message = np.full(k, 1.0 / k)
    for b in range(blocks):
        ahead[b] = message
        message = message @ product[b]
        message /= message.sum()
    message = np.full(k, 1.0 / k)
    for b in range(blocks - 1, -1, -1):
        behind[b] = message
        message = product[b] @ message
        message /= message.sum()
    alpha = np.empty((length + 1, blocks, k))  # forward messages, entry i + 1 at step i
    alpha[0] = ahead
    for i in range(length):
        ahead = (ahead[:, None, :] @ step(i))[:, 0]
        ahead /= ahead.sum(axis=1, keepdims=True)
        alpha[i + 1] = ahead
    pairs = np.zeros((k, k))
    inner = ~f
    inner.reshape(-1)[n:] = False
    for i in range(length - 1, -1, -1):
        now = step(i)
        if count_pairs:
            joint = alpha[i][:, :, None] * now * behind[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            pairs += joint[inner[:, i]].sum(axis=0)
        alpha[i + 1] *= behind
        alpha[i + 1] /= alpha[i + 1].sum(axis=1, keepdims=True)
        behind = (now @ behind[:, :, None])[:, :, 0]
        behind /= behind.sum(axis=1, keepdims=True)
    return alpha[1:].transpose(1, 0, 2).reshape(-1, k)[:n], pairs


# ---- the model ------------------------------------------------------------


@dataclass
class Model:
    languages: list[str]
    trigram: np.ndarray
    affix: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # their weights
    trans: np.ndarray
    start: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        rows, firsts = words.trigrams()
        total = np.add.reduceat(self.trigram.take(rows, axis=0), firsts, axis=0)
        for rows in words.affixes():
            total += self.affix.take(rows, axis=0)
        if len(self.lexicon):
            hashes = words.hashes()
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            known = self.lexicon[at] == hashes
            total[known] += self.lexical[at[known]]
        return total.astype(float)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Each text's mean word probabilities (zeros without a word), summed over
        all its words and divided by their number."""
        total = np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, bytes]] = []
        size = 0
        for i, data in enumerate(texts):
            for part in _parts(data):
                if size + len(part) > SLICE and group:
                    self._add(group, total)
                    group, size = [], 0
                group.append((i, part))
                size += len(part) + 1
        if group:
            self._add(group, total)
        return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-300)

    def _add(self, group: list[tuple[int, bytes]], total: np.ndarray) -> None:
        words = Words.of(b" ".join(d for _, d in group))
        if not len(words.starts):
            return
        # words start one later than their bytes
        ends = np.cumsum([len(d) + 1 for _, d in group])
        owner = np.searchsorted(ends, words.starts - 1, side="right")
        first = np.concatenate(([True], owner[1:] != owner[:-1]))
        found, _ = marginals(self.scores(words), first, self.trans, self.start)
        ids = np.array([i for i, _ in group])[owner]
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(ids, found[:, k], len(total))


def _parts(data: bytes) -> Iterator[bytes]:
    at = 0
    while len(data) - at > SLICE:
        cut = data.rfind(b" ", at, at + SLICE)
        cut = cut if cut > at else at + SLICE
        yield data[at:cut]
        at = cut
    yield data[at:] if at else data


def fit(samples: list[tuple[str, str]], seed: int = 7) -> Model | None:
    """A model from ``(language, text)`` rows."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    k, rng = len(languages), np.random.default_rng(seed)
    texts = [(languages.index(lang), Words.of(t.lower().encode("utf-8", "replace"))) for lang, t in samples]
    texts = [(y, w) for y, w in texts if len(w.starts)]
    if not texts:
        return None
    # words of all texts in one numbering
    tri, tri_first, aff, hashes, label, at = [], [], [[] for _ in range(4)], [], [], 0
    for y, w in texts:
        rows, firsts = w.trigrams()
        tri.append(rows), tri_first.append(firsts + at)
        at += len(rows)
        for a, r in zip(aff, w.affixes()):
            a.append(r)
        hashes.append(w.hashes())
        label.append(np.full(len(w.starts), y))
    tri, tri_first = np.concatenate(tri), np.concatenate(tri_first)
    aff, hashes, label = [np.concatenate(a) for a in aff], np.concatenate(hashes), np.concatenate(label)
    bounds = np.cumsum([0] + [len(w.starts) for _, w in texts])
    # lexicon: frequent words that one language has most of
    words, inverse = np.unique(hashes, return_inverse=True)
    counts = np.stack([np.bincount(inverse[label == y], minlength=len(words)) for y in range(k)], 1)
    telling = counts.max(axis=1) * (counts.sum(axis=1) >= 5) * (
        counts.max(axis=1) > 0.6 * counts.sum(axis=1))
    chosen = np.sort(np.argsort(-telling, kind="stable")[:LEXICON])
    chosen = chosen[telling[chosen] > 0]
    lex_row = np.full(len(words), -1)
    lex_row[chosen] = np.arange(len(chosen))
    lex = lex_row[inverse]
    # sequences: the texts themselves, then pieces of them spliced together
    order, first = [np.arange(len(label))], [np.isin(np.arange(len(label)), bounds[:-1])]
    for _ in range(len(texts)):
        pieces = []
        for _ in range(int(rng.integers(2, 5))):
            i = int(rng.integers(len(texts)))
            a, b = bounds[i], bounds[i + 1]
            n = int(min(b - a, rng.integers(5, 40)))
            s = int(rng.integers(a, b - n + 1))
            pieces.append(np.arange(s, s + n))
        piece = np.concatenate(pieces)
        order.append(piece)
        first.append(np.arange(len(piece)) == 0)
    order, first = np.concatenate(order), np.concatenate(first)
    gold = label[order]
    times = np.bincount(order, minlength=len(label)).astype(float)
    inner = np.flatnonzero(~first)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[inner - 1], gold[inner]), 1)
    gold_start = np.bincount(gold[first], minlength=k)

    model = Model(languages, np.zeros((ROWS, k), np.float32), np.zeros((ROWS, k), np.float32),
                  words[chosen], np.zeros((len(chosen), k), np.float32),
                  np.zeros((k, k)), np.zeros(k))
    gold_word = np.zeros((len(label), k))
    gold_word[np.arange(len(label)), label] = times
    tri_word = np.repeat(np.arange(len(label)), np.diff(np.append(tri_first, len(tri))))
    squares: dict[str, np.ndarray] = {}
    n = len(order)

    def descend(name: str, gradient: np.ndarray) -> None:
        value = getattr(model, name)
        gradient = gradient / n - PENALTY * value * (1 if name in ("trans", "start") else 0.1)
        past = squares.setdefault(name, np.full(value.shape, 1e-8))
        past += gradient**2
        setattr(model, name, (value + LEARNING_RATE * gradient / np.sqrt(past)).astype(value.dtype))

    def scatter(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(rows, values[:, j], size) for j in range(k)], 1)

    for _ in range(STEPS):
        s = np.add.reduceat(model.trigram[tri], tri_first, axis=0)
        for rows in aff:
            s += model.affix[rows]
        s[lex >= 0] += model.lexical[lex[lex >= 0]]
        found, pairs = marginals(s[order].astype(float), first, model.trans, model.start, True)
        expected = np.stack([np.bincount(order, found[:, j], len(label)) for j in range(k)], 1)
        error = gold_word - expected
        descend("trigram", scatter(tri, error[tri_word], ROWS))
        descend("affix", sum(scatter(rows, error, ROWS) for rows in aff))
        if len(chosen):
            descend("lexical", scatter(lex[lex >= 0], error[lex >= 0], len(chosen)))
        descend("trans", gold_pairs - pairs)
        descend("start", gold_start - found[first].sum(axis=0))
    return model


# ---- on Spark -------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` texts of each language, those with the smallest
    hashes. A first cut by the counts of distinct texts keeps the rows to be ranked few."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64("text")  # equal texts count once
    texts = known.select("lang", h.alias("h")).distinct()
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, 4.0 * per_language / n)])
    place = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    once = (
        known.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), h.alias("h"))
        .where(place < F.element_at(share, F.col("lang")))
        .groupBy("lang", "h").agg(F.min("text").alias("text"))
    )
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = once.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in rows)


def _predict(batches: Iterator[pa.RecordBatch], model: Model | None, out: tuple[str, str]):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        langs, scores = [], []
        for at in range(0, batch.num_rows, 1024):
            some = texts.slice(at, 1024).to_pylist()
            lower = [(t or "").lower() for t in some]
            if model is None:
                langs += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                continue
            shares = model.shares([t.encode("utf-8", "replace") for t in lower])
            best = shares.argmax(axis=1)
            for text, i, share in zip(lower, best, shares):
                if share[i] > 0 and _has_letter(text):
                    langs.append(model.languages[i])
                    scores.append(float(min(1.0, share[i])))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
            names=[*batch.schema.names, *out])


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def with_language(docs: DataFrame, out: tuple[str, str] = ("lang_pred", "score"),
                  train: DataFrame | None = None) -> DataFrame:
    """``docs`` with the predicted language of ``text`` and its score. ``train``
    (``docs`` by default) has ``doc_id, text, lang`` to learn from."""
    ship_package(docs.sparkSession)
    return _labelled(docs, fit(sample(docs if train is None else train)), out)


def _labelled(docs: DataFrame, model: Model | None, out: tuple[str, str]) -> DataFrame:
    schema = T.StructType(docs.schema.fields + [
        T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])
    return docs.mapInArrow(lambda batches: _predict(batches, model, out), schema)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``."""
    found = with_language(docs.select("doc_id", "text"), train=docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_a_language(docs: DataFrame) -> DataFrame:
    """The documents in some language or languages: those not ``und``. Without
    anything to learn from, all of them."""
    ship_package(docs.sparkSession)
    model = fit(sample(docs.select("doc_id", "text", "lang")))
    if model is None:
        return docs
    # the row travels whole, so that no column of its own meets these
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = _labelled(rows, model, ("lang_pred", "score"))
    return found.where(F.col("lang_pred") != UNKNOWN).select("row.*")
