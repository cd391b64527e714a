"""Best-fit packing by a configuration linear program.

Documents are token sequences; those longer than a sequence are cut into whole
sequences, the first piece taking the remainder. How to combine the shorter
pieces depends only on how many there are of each length, at most 1,023 numbers,
so the driver solves the packing on that histogram:

* the linear program over configurations (multisets of lengths that fit one
  sequence) is solved by multiplicative weights: lengths have prices, a knapsack
  dynamic program finds the dearest configuration, and the prices of the lengths
  it covers fall;
* the weights of the configurations are rounded down to whole numbers of
  sequences, and the rest is packed by further knapsacks on what is left.

Spark then numbers the pieces within each length (by task, then offsets between
tasks) and looks up the sequence and the place of each number.

Defined cases: a null text is empty and gives one piece, the end token; an empty
table gives no rows; repeated rows are packed as often as they occur; other
columns are not looked at. A document with a null id is packed like any other.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegraph.llm.scratch import Scratch
from tidegraph.llm.workers import ship_package

CAPACITY = 1024
END_ID = 2
CACHED_WORDS = 200_000  # per worker; a bound on memory, not on the words handled


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- tokens ---------------------------------------------------------------


def _byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """A byte-level vocabulary with its characters turned back into bytes: those
    that print stand for themselves, the others for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    return {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items()}


class WordCache:
    """Token ids of whole texts, by way of their words.

    The byte-level tokenizer never joins a word with the blank after it, if
    neither side of the blank is white space. Texts are therefore cut at such
    blanks, and each distinct word is encoded once. ``tiktoken`` does that with the
    vocabulary of the ``tokenizers`` file, several times faster and with the same
    ids; texts that may hold a special token go to ``tokenizers``.
    """

    _BLANKS = re.compile(r"\s[ ]|[ ]\s|\A[ ]|[ ]\Z")  # a blank next to white space or an end

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        special = {t.content for t in self._tokenizer.get_added_tokens_decoder().values()}
        self._special = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)")
        words = {t: i for t, i in model["vocab"].items() if t not in special}
        self._encode = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_byte_ranks(words),
            special_tokens={},
        ).encode_ordinary
        self._ids: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        if self._special.search(text):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self._encode(text)
        return np.asarray(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, encode = self._ids, self._encode
        for text in texts:
            if self._BLANKS.search(text) or self._special.search(text):
                yield self._one(text)
                continue
            if len(known) > CACHED_WORDS:
                known.clear()
            head, *rest = text.split(" ")
            words = [head, *[" " + w for w in rest]]
            for word in words:
                if word not in known:
                    known[word] = array("I", encode(word)).tobytes()
            yield b"".join(map(known.__getitem__, words))


@functools.cache
def _cache(path: str) -> WordCache:
    return WordCache(path)


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of a document."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity
    starts = [0] * bool(first) + list(range(first, n_ids, capacity))
    ends = [*starts[1:], n_ids]
    return [(a, b - a) for a, b in zip(starts, ends)]


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
)


def _cut_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int):
    encoder, part = _cache(path), TaskContext.get().partitionId()
    end, ranks = np.array([end_id], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        columns: list[list] = [[] for _ in range(7)]
        for at in range(0, len(ids), 256):
            some = [t or "" for t in texts.slice(at, 256).to_pylist()]
            for doc_id, tokens in zip(ids[at : at + 256], encoder.encode(some)):
                tokens += end
                for piece, (start, length) in enumerate(cut(len(tokens) // 4, capacity)):
                    crc = zlib.crc32(tokens[4 * start : 4 * (start + length)])
                    for column, value in zip(
                        columns, (doc_id, piece, start, length, crc, part, int(ranks[length]))
                    ):
                        column.append(value)
                    ranks[length] += 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        names = "doc_id piece start length ids_crc32 part rank".split()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
        )


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
           end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents, numbered within task and length."""
    path = tokenizer or default_tokenizer()
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        lambda batches: _cut_batches(batches, path, capacity, end_id), PIECES
    )


# ---- the packing of a histogram -------------------------------------------


def _dearest(prices: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The configuration of the highest total price, as counts by length.

    ``prices`` and ``left`` (how many pieces there are) are indexed by length. An
    unbounded knapsack, one vector step per unit of room, usually asks for no
    more pieces than are left; where it does, a bounded one takes its place.
    """
    capacity = len(prices) - 1
    offered = np.where((left > 0) & (prices > 0), prices, -np.inf)
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        totals = offered[1 : room + 1] + best[room - 1 :: -1][:room]
        i = int(totals.argmax())
        if totals[i] > best[room - 1]:
            best[room], choice[room] = totals[i], i + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(capacity + 1, np.int64), capacity
    while room > 0:
        if choice[room]:
            counts[choice[room]] += 1
            room -= int(choice[room])
        else:
            room -= 1
    return counts if (counts <= left).all() else _dearest_bounded(offered, left)


def _dearest_bounded(offered: np.ndarray, left: np.ndarray) -> np.ndarray:
    """As above with each length used as often as it is left; copies are offered
    in powers of two, so each length takes a few vector steps."""
    capacity = len(offered) - 1
    best, steps = np.zeros(capacity + 1), []
    for length in np.flatnonzero(np.isfinite(offered)):
        most, take = min(int(left[length]), capacity // int(length)), 1
        while most > 0:
            take = min(take, most)
            weight = int(length) * take
            trial = best[:-weight] + offered[length] * take
            better = trial > best[weight:]
            best[weight:][better] = trial[better]
            steps.append((length, take, weight, better))
            most -= take
            take *= 2
    counts, room = np.zeros(capacity + 1, np.int64), capacity
    for length, take, weight, better in reversed(steps):
        if room >= weight and better[room - weight]:
            counts[length] += take
            room -= weight
    return counts


ROUNDS, RATE = 300, 0.5


def fractional(demand: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
    """Configurations and weights that cover (most of) the demand by length.

    Multiplicative weights for the covering program: a length's price starts at
    its share of a sequence and falls by a factor with every part of its demand
    that is covered; each round adds the dearest configuration. Its weight is the
    bound on the sequences over ``rounds``, or what a length in it has left.
    Lengths with less left than a small part of such a step are not offered: they
    would make the steps tiny, and the rounding packs them.
    """
    capacity = len(demand) - 1
    sizes = np.arange(capacity + 1)
    bound = float((sizes * demand).sum()) / capacity
    step, left = bound / rounds, demand.astype(float)
    chosen: dict[bytes, float] = {}
    for _ in range(2 * rounds):
        offered = np.where(left >= max(1.0, step / 8), left, 0)
        covered = 1 - left / np.maximum(demand, 1)
        counts = _dearest(sizes / capacity * np.exp(-rate * covered), np.floor(offered))
        used = counts > 0
        if not used.any():
            break
        weight = min(step, float((left[used] / counts[used]).min()))
        key = counts.tobytes()
        chosen[key] = chosen.get(key, 0.0) + weight
        left = left - counts * weight
    return [(np.frombuffer(key, np.int64), weight) for key, weight in chosen.items()]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """``(length -> copies, number of such sequences)``, covering the histogram exactly.

    Weights of the fractional solution are rounded down. What is left is packed
    by the configuration that leaves least room (long pieces first among equals),
    as often as what is left allows, until nothing is.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan: list[tuple[dict[int, int], int]] = []

    def use(counts: np.ndarray, most: float) -> None:
        nonlocal left
        used = np.flatnonzero(counts)
        times = min(int(most), int((left[used] // counts[used]).min()))
        if times > 0:
            left = left - counts * times
            plan.append(({int(n): int(counts[n]) for n in used}, times))

    whole = np.zeros(capacity + 1, np.int64)
    whole[capacity] = 1
    use(whole, left[capacity])
    for counts, weight in fractional(left):
        use(counts, weight)
    sizes = np.arange(capacity + 1) / capacity
    taste = sizes + 1e-4 * sizes**2
    while left.any():
        use(_dearest(taste, left), left.max())
    return plan


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing uses fewer sequences than the tokens fill."""
    return -(-sum(n * c for n, c in histogram.items()) // capacity)


def seats(plan, start: int = 0):
    """Rows ``(length, first, n, sequence, per_sequence, offset)``: the pieces of
    a length numbered from ``first`` on, ``n`` of them, go ``per_sequence`` to a
    sequence from ``sequence`` on, beginning at ``offset``."""
    rows, seen, at = [], {}, start
    for counts, times in plan:
        offset = 0
        for length, each in sorted(counts.items(), reverse=True):
            first = seen.get(length, 0)
            rows.append((length, first, each * times, at, each, offset))
            seen[length] = first + each * times
            offset += each * length
        at += times
    return rows


# ---- on Spark -------------------------------------------------------------


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    cut_up = scratch.save(pieces(docs, tokenizer, capacity, end_id))
    by_task = scratch.save(cut_up.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {
        r["length"]: r["n"]  # at most one row per length
        for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    }
    table = spark.createDataFrame(
        seats(solve(histogram, capacity)) or [],
        "length long, first long, n long, sequence long, per_sequence long, offset long",
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = by_task.select(
        "length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = scratch.save(starts)  # a row per length and task
    numbered = cut_up.join(starts, ["length", "part"])
    number = F.col("before") + F.col("rank")
    # the seats are bounded by the capacity: a few per length and configuration
    seated = numbered.withColumn("number", number).join(
        F.broadcast(table.withColumnRenamed("length", "l").withColumnRenamed("offset", "place")),
        (F.col("length") == F.col("l")) & (F.col("number") >= F.col("first"))
        & (F.col("number") < F.col("first") + F.col("n")),
    )
    turn = F.col("number") - F.col("first")
    return seated.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(number - first) div per_sequence")).alias("sequence_id"),
        (F.col("place") + F.pmod(turn, F.col("per_sequence")) * F.col("length")).alias("offset"),
    )
