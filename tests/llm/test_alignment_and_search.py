"""Token alignment, ranked search and decontamination against plain definitions."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import alignment, decontamination, lexical

TEXTS = [
    " ", "a  b", " a", "b ", "x▁y", "x ▁y", "<|endoftext|> in</s>", "\x00 é\n\n z", "tab\tx\r\n y",
    "😀 ok 中文字 test", "é ﬁ don't we'll", " wide blank ", "a" * 5000,
]


@pytest.fixture(scope="module")
def rows():
    base = cases.documents()
    return base + [(1000 + i, t, "en", "a", None) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return cases.with_extras(spark.createDataFrame(rows, cases.DOCS).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DOCS)


def with_clashes(df):
    names = "words digest n_words starts items term tf n rank query batch pairs place".split()
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names) if c not in df.columns])


# --- alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    # the byte-level alphabet: what prints stands for itself, the rest from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain}
    byte_of |= {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}

    def of_piece(name):
        byte = re.fullmatch(r"<0x(..)>", name)
        return bytes([int(byte[1], 16)]) if byte else name.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        encoded = a.encode(" " + text, add_special_tokens=False)
        sides = (
            [(i, bytes(byte_of[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)],
            [(i, of_piece(b.id_to_piece(i))) for i in b.encode(text)],
        )
        whole = (" " + text).encode()
        return sides if all(b"".join(t for _, t in s) == whole for s in sides) else ([], [])

    return tokens


def placed(side):
    at, out = 0, []
    for i, token in side:
        out.append((i, at, at + len(token)))
        at += len(token)
    return out


def plain_links(a, b):
    first = 0
    for i, x, y in a:
        while b[first][2] <= x:
            first += 1
        k = first
        while k < len(b) and b[k][1] < y:
            yield i, b[k][0]
            k += 1


def plain_groups(a, b):
    cuts = sorted({y for *_, y in a} & {y for *_, y in b})
    side = lambda s, x, y: [i for i, p, q in s if x <= p and q <= y]
    return [(x, y - x, side(a, x, y), side(b, x, y)) for x, y in zip([0, *cuts], cuts)]


def test_alignment_is_that_of_all_tokens(docs, rows, plain_tokens, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 4000)
    # long texts are cut down here: the plain definition is quadratic
    short = [r for r in rows if len(r[1] or "") < 6000]
    ids = {r[0] for r in short}
    aligned = [tuple(map(placed, plain_tokens(r[1]))) for r in short]
    links = [list(plain_links(a, b)) for a, b in aligned]
    counts = Counter(x for some in links for x in some)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    expected = Counter()
    for (doc_id, *_), (a, b), some in zip(short, aligned, links):
        groups = plain_groups(a, b)
        spelled = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for *_, x, y in groups)
        expected[(doc_id, len(a), len(b), len(groups), len(some),
                  sum(counts[x] == most[x[1]] for x in some), sum(counts[x] for x in some),
                  hashlib.sha256(spelled.encode()).hexdigest() if spelled else "")] += 1
    some = with_clashes(docs).where(F.coalesce(F.length("text"), F.lit(0)) < 6000)
    got = Counter(tuple(r) for r in alignment.alignment(some).collect())
    assert got == expected and None in ids


def test_groups_cover_the_text(docs, rows, plain_tokens):
    some = docs.where(F.length("text") < 6000)
    expected = Counter()
    for doc_id, text, *_ in rows:
        if text is not None and len(text) < 6000:
            for i, (x, n, a, b) in enumerate(plain_groups(*map(placed, plain_tokens(text)))):
                expected[(doc_id, i, x, n, tuple(a), tuple(b))] += 1
    got = Counter(
        (r[0], r[1], r[2], r[3], tuple(r[4]), tuple(r[5])) for r in alignment.token_groups(some).collect())
    assert got == expected


def test_long_texts_are_aligned_whole(spark):
    text = cases.LONG * 3
    row = alignment.alignment(spark.createDataFrame([(1, text), (2, cases.LONG)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in row.collect()}
    # the words at the two seams are joined, everything else is three times there
    assert abs(got[1]["n_a"] - 3 * got[2]["n_a"]) < 8 and got[1]["n_groups"] > 2.9 * got[2]["n_groups"]


def test_nothing_to_align(empty):
    assert alignment.alignment(empty).count() == 0
    assert alignment.token_groups(empty).count() == 0


def test_forgotten_words_are_encoded_again(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 3)
    known = alignment.Words(alignment.default_tokenizer(), alignment.default_pieces())
    texts = ["one two three four", "five  six", "one six", None, "two"]
    first = alignment.spelled_groups(alignment.align(texts, known))
    assert alignment.spelled_groups(alignment.align(texts, known)) == first
    assert [alignment.spelled_groups(alignment.align([t], known))[0] for t in texts] == first


@pytest.fixture
def in_task(monkeypatch):
    """Rows of batches in this process, as a task gives them."""
    monkeypatch.setattr(alignment.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    paths = alignment.default_tokenizer(), alignment.default_pieces()

    def rows(ids, texts):
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        return list(alignment._batch_rows(iter([batch]), paths))

    return rows


def test_memory_of_a_batch_goes_with_its_distinct_words(in_task):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("over", "tion", "qu", "Ze", "ing") for b in range(100)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(600)]
    in_task([1], ["the tokenizers, which are not counted"])
    tracemalloc.start()
    row, = in_task(range(600), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(row["n_words"][0].as_py()) == 300_000 and len(row["links_of"][0]) == 500
    assert peak < 100e6  # twice that and more, when every occurrence of a word is aligned


def test_a_batch_is_the_same_in_blocks(in_task, monkeypatch):
    texts = [None, "", *TEXTS, "one two three one", cases.LONG[:3000], "one two  three", "three two"]
    ids = [None, *range(1, len(texts))]
    whole, = in_task(ids, texts)
    for tokens in (1, 7, 300):
        monkeypatch.setattr(alignment, "BLOCK_TOKENS", tokens)
        blocks, = in_task(ids, texts)
        assert blocks.equals(whole)


def test_memory_of_uneven_texts_is_that_of_a_block(in_task):
    rng = random.Random(3)
    texts = ["  ".join(rng.choices(("over", "tion", "que", "Zebra"), k=500)) for _ in range(500)]
    in_task([1], ["the tokenizers, which are not counted"])
    tracemalloc.start()
    row, = in_task(range(500), texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert row["n_words"][0].as_py() == [1] * 500
    assert peak < 120e6


def test_long_words_are_not_encoded_together(monkeypatch):
    known = alignment.Words(alignment.default_tokenizer(), alignment.default_pieces())
    calls, encode = [], known._b
    monkeypatch.setattr(known, "_b", lambda text: calls.append(len(text)) or encode(text))
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=3000)) for _ in range(40)]
    alignment.align([" ".join(words[:20]), " ".join(words[20:]), " ".join(f"w{i}" for i in range(2000))], known)
    assert max(calls) < 3 * 3000 and len(calls) < 100


def test_words_of_a_batch_that_failed_are_not_kept(monkeypatch):
    known = alignment.Words(alignment.default_tokenizer(), alignment.default_pieces())
    first = alignment.spelled_groups(alignment.align(["one two", "three  four"], known))
    with monkeypatch.context() as patch:
        patch.setattr(known, "_b", lambda text: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            alignment.align(["five six one"], known)
    texts = ["six five", "one two", "three  four"]
    assert alignment.spelled_groups(alignment.align(texts, known))[1:] == first


def test_words_encoded_together_are_those_encoded_alone(monkeypatch):
    paths = alignment.default_tokenizer(), alignment.default_pieces()
    words = ["one", "don't", "\nhead", "tail\t", "x▁y", "\x00", "中文字", "é\n\nz", "ﬁ", "\x1cq", "\u3000", "one"]
    words += [f"{a}{b}" for a in ("tion", "Ze", "😀", "２") for b in range(40)]
    together, alone = alignment.Words(*paths), alignment.Words(*paths)
    monkeypatch.setattr(alignment, "JOINED_CHARS", 400)
    for word in words:
        assert together[word] == together[word]
        if word not in alone:
            alone[word] = alone.add(word)
    together.learn()

    def tokens(known, word):
        n = known[word]
        return [side.ids[side.starts[n] : side.starts[n + 1]].tolist() for side in known.sides], known.whole[n]

    assert together.keys() == alone.keys() and len(together.whole) == len(together)
    assert [tokens(together, w) for w in alone] == [tokens(alone, w) for w in alone]
    assert not together.whole[together["x▁y"]] and together.whole[together["\nhead"]]


# --- ranked search -----------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(CAPITALS))


def plain_ranking(rows, queries, k=10):
    vectors = [(doc_id, Counter(terms(text))) for doc_id, text, *_ in rows]
    vectors = [(d, c, sum(c.values())) for d, c in vectors if c]
    n_docs, n_terms = len(vectors), sum(n for *_, n in vectors)
    df = Counter(t for _, c, _ in vectors for t in c)
    out = Counter()
    for item, text in queries:
        found = []
        for doc_id, c, n in vectors:
            m = 10 + (90 * n * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, null, doc_id) in enumerate(sorted(found)[:k], 1):
            out[(item, rank, None if null else doc_id, -score)] += 1
    return out


def corpus(seed=4, n=700):
    """Topics with shared words, long and short documents, copies."""
    rng = random.Random(seed)
    topics = [[f"t{t}w{i}" for i in range(30)] for t in range(12)]
    common = ["The", "of", "and", "à", "42"]
    texts = []
    for _ in range(n):
        topic = rng.choice(topics)
        words = rng.choices(topic, k=rng.randint(1, 60)) + rng.choices(common, k=rng.randint(0, 30))
        rng.shuffle(words)
        texts.append(rng.choice([" ", "-", " / "]).join(words))
    texts += texts[:150] + [None, "", "...", cases.LONG]
    docs = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[4])]
    queries = [(i, " ".join(rng.choices(rng.choice(topics), k=rng.randint(1, 9)) + rng.choices(common, k=4)))
               for i in range(60)]
    queries += [(60, None), (61, " ... "), (62, "nowhere"), (None, texts[3]), (3, texts[9]), (63, "the THE The")]
    return docs, queries


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 4, "SHARD_DOCS": 200, "BLOCK_BYTES": 300, "_STEP": 50},
                                   {"BLOCK": 2, "CELLS": 64, "SUMMARY_BYTES": 1000}])
def test_the_best_are_those_of_all_scores(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    rows, queries = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(queries, "item_id long, text string")
    got = Counter(tuple(r) for r in lexical.ranked(with_clashes(docs), with_clashes(items)).collect())
    assert got == plain_ranking(rows, queries)


def test_blocks_are_skipped_and_bounds_hold():
    rows, queries = corpus(n=2000)
    some = lexical.Queries.of(0, queries)
    vectors = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    number = dict(zip(some.vocabulary.tolist(), range(len(some.vocabulary))))
    words = sorted({t for _, c in vectors for t in c})
    hashes = dict(zip(words, next(lexical.term_hashes([" ".join(words)])).tolist()))
    parts = [[(number[hashes[t]], n) for t, n in c.items() if hashes[t] in number] for _, c in vectors]
    kept = [(d, p) for (d, _), p in zip(vectors, parts) if p]
    cuts = np.append(0, np.cumsum([len(p) for _, p in kept]))
    flat = np.array([x for _, p in kept for x in p], np.int64)
    held = np.bincount(flat[:, 0], minlength=len(number))
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * n + 1))) for n in held])
    corpus_wide = lexical.Corpus(len(rows), 30 * len(rows), weights)
    adds = corpus_wide.adds(flat[:, 0], flat[:, 1], np.repeat(30, len(flat)))
    shard = lexical.Shard([d for d, _ in kept], cuts, flat[:, 0], adds, some.beside())
    scored = []
    plain, shard.scores = shard.scores, lambda docs, t: scored.append(len(docs)) or plain(docs, t)
    for asked in some.terms:
        shard.search(asked, 10)
        for term in asked[shard.top[asked] > 0]:
            blocks = shard.open(int(term))
            bounds = blocks.most[:, np.searchsorted(blocks.over, asked[np.isin(asked, blocks.over)])].sum(axis=1)
            for i, bound in enumerate(bounds):
                inside = blocks.docs[blocks.starts[i] : blocks.starts[i + 1]]
                assert plain(inside, asked).max() <= bound
    listed = sum(len(np.unique(np.concatenate(
        [shard.postings[shard.lists[t] : shard.lists[t + 1]] for t in asked] or [[]]))) for asked in some.terms)
    assert sum(scored) < 0.7 * listed


def test_nothing_to_search(spark, docs, empty):
    items = spark.createDataFrame([(1, "one words")], "item_id long, text string")
    assert lexical.ranked(empty, items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0


# --- decontamination ---------------------------------------------------------


def plain_contamination(rows, items, width=10):
    windows = {}
    for item, text in items:
        ws = terms(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[i : i + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = Counter()
    for doc_id, text, *_ in rows:
        ws = terms(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (items_of := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= items_of
        names = sorted(str(f) for f in found if f is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out[(doc_id, len(ws), len(hit), len(names), digest, bool(hit))] += 1
    return out


def passages(seed=8):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice("abcdefg") for _ in range(n))
    items = [(i, text(rng.randint(10, 40))) for i in range(12)]
    items += [(i, text(n)) for i, n in zip(range(12, 16), (4, 7, 9, 9))]
    items += [(16, None), (17, " ,.; "), (3, items[5][1]), (18, items[5][1]), (None, text(15)), (100, "Uni Que")]
    rows = []
    for i in range(80):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            ws = item.split()
            a = rng.randint(0, len(ws))
            parts += [" ".join(ws[a : a + rng.randint(5, 30)]).upper(), text(rng.randint(0, 5))]
        rows.append((i, ", ".join(parts)))
    # one text of one word over and over, copies, and rows without words
    rows += [(200, "a " * 3000), (201, rows[1][1]), (1, rows[1][1]), (1, rows[2][1]), (None, rows[3][1]),
             (202, None), (203, ""), (204, "?!"), (205, "uni-que " * 2000)]
    return rows, items


@pytest.mark.parametrize("sizes", [{}, {"SHARD_WORDS": 64}, {"BLOCK_BYTES": 60}])
def test_marked_words_are_those_of_all_windows(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(decontamination, name, value)
    rows, items = passages()
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    bench = with_clashes(spark.createDataFrame(items, "item_id long, text string"))
    got = decontamination.contamination_report(docs, bench)
    assert Counter(tuple(r) for r in got.collect()) == plain_contamination(rows, items)
    clean = decontamination.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    expected = Counter(r for r in rows for key, n in plain_contamination([r], items).items() if not key[5])
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == expected


def test_longest_matches_are_those_of_all_places(spark):
    rows, items = passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["item_id"]: r for r in decontamination.longest_matches(docs, bench).collect()}
    expected = {}
    words = {}
    for doc_id, text in rows:
        words.setdefault(doc_id, []).append(terms(text))
    for item, text in items:
        ws, best = terms(text), 0
        for some in words.values():
            for other in some:
                last = [0] * (len(other) + 1)  # longest common run, by dynamic programming
                for w in ws:
                    last = [0] + [last[j] + 1 if w == x else 0 for j, x in enumerate(other)]
                    best = max(best, max(last))
        if best:
            key = None if item is None else str(item)
            expected[key] = max(best, expected.get(key, 0))
    assert {k: r["n_words"] for k, r in got.items()} == expected
    for item, text in items:
        r = got.get(None if item is None else str(item))
        if r is not None and Counter(i for i, _ in items)[item] == 1:
            run = terms(text)[r["item_word"] : r["item_word"] + r["n_words"]]
            assert any(o[r["doc_word"] : r["doc_word"] + r["n_words"]] == run for o in words[r["doc_id"]])


def test_suffixes_are_sorted():
    rng = np.random.default_rng(3)
    for most, depth in ((2, 40), (5, 10), (70000, 10), (1, 100)):
        words = np.append(rng.integers(0, most + 1, 3000) * (rng.random(3000) < 0.95), 0).astype(np.int32)
        made = decontamination.SuffixArray.of(words, most, depth)

        def suffix(p):
            out = words[p : p + depth].tolist()
            return out[: out.index(0)] if 0 in out else out

        keys = [suffix(p) for p in made.places]
        assert keys == sorted(keys) and sorted(made.places.tolist()) == np.flatnonzero(words).tolist()


def test_no_items_and_no_documents(spark, empty):
    rows, items = passages()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert decontamination.contamination_report(empty, bench).count() == 0
    report = decontamination.contamination_report(docs, bench.limit(0)).collect()
    assert len(report) == len(rows) and not any(r["contaminated"] for r in report)
    assert decontamination.decontaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.longest_matches(docs, bench.limit(0)).count() == 0
