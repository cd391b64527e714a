"""Operators on documents against plain definitions, awkward rows included."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import language, mixing, near_dedup, packing, pii, quality
from tidegraph.llm.scratch import Scratch


@pytest.fixture(scope="module")
def docs(spark):
    return cases.with_extras(spark.createDataFrame(cases.documents(), cases.DOCS).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.DOCS)


# --- near-duplicates ---------------------------------------------------------


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_are_those_of_all_pairs(spark, docs, width):
    rows = [(r[0], cases.shingles(r[1], width)) for r in cases.documents()]

    def linked(a, b):
        return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)

    ids = [r for r in rows if r[0] is not None]
    expected = Counter(
        (key, len(s), c, key == c) for (key, s), c in zip(ids, cases.linked_components(ids, linked)))
    expected[(None, len(rows[-3][1]), None, False)] += 1
    got = near_dedup.near_duplicates(docs, width).collect()
    assert Counter(tuple(r) for r in got) == expected


def test_a_large_group_is_linked_whole(spark, monkeypatch):
    # every copy is close to the first text, few to each other
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 70):
        ws = list(base)
        for k in rng.sample(range(300), 14):
            ws[k] = f"new{i}x{k}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, cases.shingles(t, 2)) for i, t in rows]
    expected = cases.linked_components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(70)] == expected
    assert Counter(expected)[0] > 60


def test_no_task_holds_a_group_of_unlinked_classes(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    most, in_tasks = [], near_dedup._in_tasks

    def counted(rows, *args):
        most.append(max([r["count"] for r in rows.groupBy("task").count().collect()], default=0))
        return in_tasks(rows, *args)

    monkeypatch.setattr(near_dedup, "_in_tasks", counted)
    rng = random.Random(6)
    texts = [cases.sentence(rng) for _ in range(180)]
    texts += [t + " more" for t in texts[:20]]
    rows = [(b"%03d" % i, b"g", len(texts), t) for i, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "node binary, group binary, n_group long, text string")
    links = near_dedup.confirmed_links(members, 2, 80, Scratch(spark))
    got = {tuple(sorted((int(a), int(b)))) for a, b in links.collect()}
    assert got == {(i, 180 + i) for i in range(20)}
    assert max(most) < 80  # two blocks, unevenly filled, or one and the pivots


def test_one_of_each_group_stays(spark, docs, empty):
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = cases.documents()
    named = list({(r[0], r[1]) for r in rows if r[0] is not None})
    sets = [(r, cases.shingles(r[1], 2)) for r in named]
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got[None, rows[-3][1]] == 1 and set(got.values()) == {1}
    # of the texts of a group, by all pairs, one stays: of the smallest id
    ids = list(range(len(named)))
    parts = cases.linked_components(
        list(zip(ids, (s for _, s in sets))), lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    for part in set(parts):
        members = [named[i] for i in ids if parts[i] == part]
        stay = [m for m in members if m in got]
        assert len(stay) == 1 and stay[0][0] == min(m[0] for m in members)
    assert near_dedup.one_of_each(empty).count() == 0


def test_ids_with_several_texts_and_map_columns(spark):
    a, b = "alpha beta gamma delta " * 5, "some other words that are not alike at all " * 4
    rows = [(2, a, {"x": 1}), (5, a, {"y": 2}), (5, b, {"z": 3}), (5, b, {"w": 3}), (7, None, None), (7, "", {"q": 1})]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string, int>")
    got = [(r["doc_id"], r["text"], r["tags"]) for r in near_dedup.one_of_each(df).collect()]
    assert Counter((i, t) for i, t, _ in got) in (
        Counter([(2, a), (5, b), (7, None)]), Counter([(2, a), (5, b), (7, "")]))
    assert {str(m) for i, _, m in got if i == 5} == {"{'w': 3}"}


# --- quality -----------------------------------------------------------------


def test_measures_and_base_rules(docs, empty):
    expected = Counter()
    for doc_id, text, *_ in cases.documents():
        ws, t = cases.words(text), text or ""
        windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        covered = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if cases.words(x)]
        failed = len(ws) < 10 or 100 * len(covered) > 20 * len(ws)
        expected[(doc_id, len(ws), sum(len(w.decode()) for w in ws), sum(c in "#*$%&|<>" for c in t),
                  len(lines) - len(set(lines)), len(covered), failed)] += 1
    rows = quality.quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in rows) == expected
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.quality_rules(empty).count() == 0


def test_repeated_windows_are_counted_once(spark):
    text = "a b c d e f a b c d e x y a b c d e f"
    row = quality.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == 17  # twice six words, and five


def planted_votes(habits, share=0.8, n=30_000, seed=5):
    rng = random.Random(seed)
    drawn = Counter()
    for _ in range(n):
        side = 0 if rng.random() < share else 1
        drawn[tuple(rng.choices(quality.VOTES, h[side])[0] for h in habits.values())] += 1
    return sorted(drawn.items())


HABITS = {  # of votes good, bad and none, among good and among bad documents
    "two_sided": ((0.8, 0.05, 0.15), (0.1, 0.6, 0.3)),
    "defect": ((0.0, 0.03, 0.97), (0.0, 0.5, 0.5)),
    "rare_defect": ((0.0, 0.005, 0.995), (0.0, 0.2, 0.8)),
    "praise": ((0.6, 0.0, 0.4), (0.2, 0.0, 0.8)),
    "weak": ((0.5, 0.3, 0.2), (0.35, 0.45, 0.2)),
    "loud": ((0.7, 0.25, 0.05), (0.2, 0.75, 0.05)),
}


@pytest.mark.parametrize("share", [0.6, 0.8, 0.9])
def test_planted_habits_are_estimated(share):
    got_share, got = quality.estimate(planted_votes(HABITS, share), list(HABITS))
    assert got_share == pytest.approx(share, abs=0.05)
    for name, sides in HABITS.items():
        for mine, true in zip(got[name], sides):
            assert mine == pytest.approx(true, abs=0.05), name


def test_a_rule_made_noise_weighs_nothing():
    noise = HABITS | {"loud": ((0.4, 0.55, 0.05),) * 2}
    _, before = quality._log_odds(*quality.estimate(planted_votes(HABITS), list(HABITS)))
    _, after = quality._log_odds(*quality.estimate(planted_votes(noise), list(HABITS)))
    assert before["loud"][quality.BAD] < -0.9 and before["loud"][quality.GOOD] > 0.9
    assert all(abs(after["loud"][v]) < 0.15 for v in (quality.GOOD, quality.BAD))
    assert after["two_sided"][quality.BAD] < -2


def test_verdicts_follow_the_data(spark):
    # the same votes, in tables where the rules agree or don't
    share, habits = quality.estimate(planted_votes(HABITS), list(HABITS))
    turned = HABITS | {"two_sided": ((0.3, 0.3, 0.4),) * 2}
    other = quality.estimate(planted_votes(turned), list(HABITS))
    votes = [dict(zip(HABITS, (quality.BAD, 0, 0, quality.GOOD, 0, 0)))]
    df = spark.createDataFrame(votes)
    p, q = (df.select(quality.posterior(*m)).first()[0] for m in ((share, habits), other))
    plain = math.log(share / (1 - share)) + sum(
        math.log(habits[n][0][quality.VOTES.index(v)] / habits[n][1][quality.VOTES.index(v)])
        for n, v in votes[0].items())
    assert p == pytest.approx(1 / (1 + math.exp(-plain))) and q > 0.9 > p + 0.1


def test_a_clean_table_is_kept(spark):
    rng = random.Random(9)
    rows = [(i, ". ".join(cases.sentence(rng, 12).capitalize() for _ in range(4)) + ".") for i in range(40)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["kept"] for r in got)


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(10)
    prose = [". ".join(cases.sentence(rng, 12).capitalize() for _ in range(rng.randint(2, 9))) + "."
             for _ in range(200)]
    junk = [" | ".join(cases.sentence(rng, 1).upper() + "!!" for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(prose + junk)), "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.quality_rules(df).collect() if r["kept"]}
    assert kept == set(range(200))


# --- language ----------------------------------------------------------------


def test_chain_probabilities_are_those_of_forward_and_backward():
    rng = np.random.default_rng(0)
    n, k = 37, 3
    scores, trans, start = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    first = np.zeros(n, bool)
    cuts = [0, 1, 9, 10, 30, n]
    first[cuts[:-1]] = True
    got, pairs = language.marginals(scores, first, trans, start, True)
    for a, b in zip(cuts, cuts[1:]):
        alpha = [np.exp(start + scores[a])]
        for i in range(a + 1, b):
            alpha.append(alpha[-1] @ np.exp(trans) * np.exp(scores[i]))
        beta = [np.ones(k)]
        for i in range(b - 1, a, -1):
            beta.insert(0, np.exp(trans) @ (np.exp(scores[i]) * beta[0]))
        both = np.array(alpha) * np.array(beta)
        assert got[a:b] == pytest.approx(both / both.sum(axis=1, keepdims=True))
    assert pairs.sum() == pytest.approx((~first).sum())


EN = "the and of with that from this which have their would there about".split()
DE = "der die und nicht eine sich auch werden über müssen können schön dass".split()


def test_languages_of_unseen_and_awkward_texts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(EN if i % 2 else DE, k=30)), "en" if i % 2 else "de") for i in range(120)]
    odd = [(500, None, "en"), (501, "", "de"), (502, "12 34 — !!", "en"), (None, "und die der", None),
           (503, " ".join(["the und"] * 40_000), None)]
    df = cases.with_extras(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: r for r in language.languages(df).collect()}
    assert len(got) == 125
    for i, _, lang in rows:
        assert got[i]["lang_pred"] == lang and got[i]["score"] > 0.9
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert got[None]["lang_pred"] == "de" and not got[None]["held_out"]
    assert 0.3 < got[503]["score"] < 0.7  # half of its words each
    kept = language.in_a_language(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows}


def test_texts_in_several_languages_stay(spark):
    rng = random.Random(3)
    vocabulary = {"en": EN, "de": DE, "xx": "zob zug zaz zek zil zom zur zyx".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=30)), lang) for i, lang in enumerate(list(vocabulary) * 40)]
    mixed = " ".join(" ".join(rng.choices(v, k=20)) for v in vocabulary.values())
    df = spark.createDataFrame(rows + [(900, mixed, None), (901, "12 !", "en")], "doc_id long, text string, lang string")
    assert next(r["score"] for r in language.languages(df).collect() if r["doc_id"] == 900) < 0.5
    ids = {r["doc_id"] for r in language.in_a_language(df).collect()}
    assert 900 in ids and 901 not in ids
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert language.in_a_language(unlabelled).count() == df.count()


def test_copies_and_shared_openings_leave_the_sample_full(spark):
    rows = [(f"text {i % 5} of few", "en") for i in range(4000)]
    rows += [("the same opening of all " * 10 + str(i), "de") for i in range(1000)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = Counter(lang for lang, _ in language.sample(df))
    assert found == {"en": 5, "de": language.PER_LANGUAGE}


def test_nothing_to_learn_from(docs, empty):
    assert language.languages(empty).count() == 0
    assert {r["lang_pred"] for r in language.languages(docs.withColumn("lang", docs["source"].substr(9, 1).cast("string")).where("lang is null or lang = ''").selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


# --- personal data -----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            spans.append((m.start(), m.end(), kind))
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(4)
    texts = ["", "a@b", "a@b.c@d.e", "x@@y.z", "..@a-b.c-", "1.2.3.4.5.6.7.8", "999.1.1.1 01.02.03.004", "+1 (2) ",
             "4111 1111-1111 1111", "+12 345 678 90é", "a.b+c@x.y.z."]
    for _ in range(3000):
        texts.append("".join(rng.choice("a1@.+-( )2_4é\n9%") for _ in range(rng.randint(1, 60))))
    texts += ["4" * 5000, "a" * 100_000, "1." * 20_000, "+1 " + " " * 50_000, "@" * 50_000]
    for t in texts[:-5]:
        assert pii.base_spans(t) == plain_spans(t), t
    for t in texts[-5:]:
        pii.base_spans(t)


def test_gradients_of_the_tagger():
    rng = np.random.default_rng(3)
    tagger = pii.Tagger.new(rng)
    codes, tags = pii.training_set(["call +1 (555) 123-4567 or a.b@c.org now"] * 3)
    codes, tags = codes[:3].T, tags[:3].T

    def likelihood():
        scores, trans = tagger.scores(codes)[0].astype(float), tagger.transitions()
        best = np.where(pii._START, scores[0], -1e9)
        gold = np.take_along_axis(scores[0], tags[0][:, None], 1)[:, 0]
        for i in range(1, len(scores)):
            x = best[:, :, None] + trans
            m = x.max(axis=1)
            best = np.log(np.exp(x - m[:, None]).sum(axis=1)) + m + scores[i]
            gold = gold + np.take_along_axis(scores[i], tags[i][:, None], 1)[:, 0] + trans[tags[i - 1], tags[i]]
        m = best.max(axis=1)
        return (gold - np.log(np.exp(best - m[:, None]).sum(axis=1)) - m).sum() / tags.size

    grads = tagger.gradient(codes, tags)
    for name, key, at in (("top", "w", (3, 2)), ("ahead", "w", (2, 5)), ("back", "w", (20, 40)),
                          ("embed", "e", (101, 3)), ("top", "t", (0, 1))):
        value = tagger.params[name][key]
        old = value[at]
        value[at] = old + 1e-2
        up = likelihood()
        value[at] = old - 1e-2
        down = likelihood()
        value[at] = old
        assert (up - down) / 2e-2 == pytest.approx(grads[name][key][at], rel=0.02, abs=1e-5)


@pytest.mark.parametrize("span,kind", [
    ("jane.doe at example.com", "email"), ("jane (At) example (Dot) com", "email"), ("jane At example Dot com", "email"),
    ("christopher.montgomery-smith (at) research-institute (dot) example (dot) org", "email"),
    ("christopher.montgomery-smith-" * 4 + "jones @ example.org", "email"), ("555-123-4567", "phone"),
    ("(555) 123-4567", "phone"), ("jane at very-long-name-of-an-institute . example . org", "email"),
])
def test_regions_hold_spans_whole(span, kind):
    text = "words that stand in front of the span " + span + " and words that stand behind it"
    assert any(a <= 38 and 38 + len(span) <= b for a, b in pii.regions(text))
    assert pii.plausible(span, kind)


def test_regions_leave_other_words_out():
    assert pii.regions("we met at noon at the house and looked at it. Then all went home") == []
    assert not pii.plausible("1234567890", "phone")
    long = "a" * 200_000 + " 1 " + "1" * 200_000 + "a" * 200_000
    assert pii.regions(long) == [(0, len(long))]


def viterbi(scores, trans):
    best, back = np.where(pii._START, scores[0], pii._NEVER), []
    for score in scores[1:]:
        total = best[:, None] + trans
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + score
    tags = [int(best.argmax())]
    for step in reversed(back):
        tags.append(int(step[tags[-1]]))
    return tags[::-1]


@pytest.mark.parametrize("n,at_once", [(5, 2), (72, 1), (400, 1), (1500, 3), (1500, 50), (4000, 2)])
def test_stretches_decode_like_the_whole(n, at_once):
    rng = np.random.default_rng(n + at_once)
    trans = np.where(pii._ALLOWED, rng.normal(0, 1, (pii.N_TAGS,) * 2), pii._NEVER)
    # long calm runs of a tag, so that spans cross the stretches
    true = rng.normal(0, 1, (n, pii.N_TAGS)) + np.repeat(rng.normal(0, 2, (n // 60 + 1, pii.N_TAGS)), 60, 0)[:n]
    starts = pii._windows(0, n)
    windows = [np.pad(true[s : s + pii.WINDOW], ((0, max(0, s + pii.WINDOW - n)), (0, 0))) for s in starts]
    decoder, got = pii.Decoder(trans), []
    for i in range(0, len(starts), at_once):
        last = i + at_once >= len(starts)
        done = n if last else starts[i + at_once]
        got += decoder.feed(starts[i : i + at_once], windows[i : i + at_once], done, last)
    tags, expected = viterbi(true, trans) + [0], []
    for i, t in enumerate(tags):
        if t % 2 == 1:
            end = i + 1
            while tags[end] == t + 1:
                end += 1
            expected.append((i, end, (t - 1) // 2))
    assert [g[:3] for g in got] == expected
    for start, end, _, sure in got:
        a, b = max(0, start - pii.CONTEXT), min(n, end + pii.CONTEXT)
        p = pii.crf_marginals(true[a:b, None], trans)[0][:, 0]
        assert sure == pytest.approx(np.mean([p[j - a, tags[j]] for j in range(start, end)]))


def test_a_long_region_takes_bounded_memory():
    rng = np.random.default_rng(1)
    tagger, peaks = pii.Tagger.new(rng), []
    for n in (60_000, 240_000):
        text = "".join(map(str, rng.integers(0, 10, n)))
        tracemalloc.start()
        pii.Reader(tagger).spans([text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 120e6


def test_respelled_data_is_found_whole():
    rng = random.Random(7)
    prose = [cases.sentence(rng, 60) + "." for _ in range(300)]
    tagger = pii.train([p[:30] + f" on {rng.randint(1, 99)} " + p[30:60] for p in prose[:100]])
    reader, draw = pii.Reader(tagger), np.random.default_rng(77)
    texts, wanted = [], []
    for i in range(400):
        kind = pii.KINDS[i % 4]
        span = pii._made_up(draw, kind)
        while any(k == kind for *_, k in pii.base_spans(span)):  # what the patterns miss
            span = pii._made_up(draw, kind)
        text = prose[100 + i % 200]
        cut = text.find(" ", 100) + 1
        texts.append(text[:cut] + span + " " + text[cut:])
        wanted.append((cut, cut + len(span), kind))
    found = [pii.all_spans(pii.base_spans(t), s) for t, s in zip(texts, reader.spans(texts))]
    for kind in pii.KINDS:
        here = [(w, f) for w, f in zip(wanted, found) if w[2] == kind]
        assert sum(w in f for w, f in here) >= 0.9 * len(here), kind
    reported = sum(map(len, found))
    assert sum(w in f for w, f in zip(wanted, found)) >= 0.9 * reported
    assert sum(map(len, reader.spans(prose))) <= 3


def test_made_up_spans_are_whole_in_training():
    codes, tags = pii.training_set(["only words without any numbers stand in here " * 3] * 40)
    starts = sum(int(((t > 0) & (t % 2 == 1)).any()) for t in tags)
    assert starts > 0.7 * 3 * pii.SNIPPETS  # three in four have one


def test_personal_data_in_tables(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(pii, "EPOCHS", 1)
    rows = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame([
        (1, "mail a.b@c.org, call +1 (555) 123-4567 from 10.0.0.1"), (2, None), (3, "")],
        "doc_id long, text string")).collect()}
    assert (rows[1]["n_email"], rows[1]["n_ip"], rows[1]["n_card"], rows[1]["n_phone"]) == (1, 1, 0, 1)
    base = "email:5:14,phone:21:38,ip:44:52"
    assert rows[1]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(rows[1]["spans"].split(","))
    assert rows[2]["spans"] == "" == rows[3]["spans"]
    assert pii.personal_data(docs).count() == len(cases.documents())
    masked = pii.without_personal_data(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert pii.personal_data(empty).count() == 0


# --- mixing ------------------------------------------------------------------


def test_targets_are_those_of_resharing(spark):
    for totals in ([100, 10, 1000], [0, 0, 5], [0], [7, 7, 7, 7, 1], [1, 1, 1000, 3, 500, 0]):
        names = [f"s{i}" for i in range(len(totals))]
        df = spark.createDataFrame(list(zip(names, totals)), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        weights = [(5, 2, 1)[i % 3] for i in range(len(totals))]
        target, open_, left = [0.0] * len(totals), set(range(len(totals))), float(sum(totals))
        while open_ and left > 1e-9:
            w = sum(weights[i] for i in open_)
            for i in open_:
                target[i] += left * weights[i] / w
            left = 0.0
            for i in list(open_):
                if target[i] >= 3 * totals[i]:
                    left += target[i] - 3 * totals[i]
                    target[i] = 3.0 * totals[i]
                    open_.discard(i)
        assert [got[n] for n in names] == pytest.approx(target)


def test_sources_come_to_their_targets(docs, empty):
    rows = mixing.mix(docs).collect()
    assert sorted(rows, key=str) == sorted(mixing.mix(docs).collect(), key=str)
    assert len(rows) == len(cases.documents())
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"], r["source_size"]] += r["taken"]
    for (goal, _), words in taken.items():
        assert abs(words - goal) <= 3
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


# --- packing -----------------------------------------------------------------


def packed_well(pieces, capacity):
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_places(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = Counter()
    for doc_id, text, *_ in cases.documents():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for piece, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            assert length == 1024 or piece == 0
            crc = zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            expected[doc_id, piece, start, length, crc] += 1
    rows = packing.pack(docs).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    n = packed_well(rows, 1024)
    assert n <= 1.1 * -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(empty).count() == 0


def test_ids_of_odd_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", " ", "a  b", " x", "x ", "a \n b", "a<|endoftext|>b", "don't we'll 'S", "é\u00a0 b", "x\x1c y",
             "😀 😀\u200d b", "12 345 6", "\r\n a", "a\u2028 b c", "日本 語"]
    got = list(packing.WordCache(packing.default_tokenizer()).encode(texts))
    for text, found in zip(texts, got):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert found == np.array(ids, "<u4").tobytes(), text


@pytest.mark.parametrize("seed", range(3))
def test_packings_cover_their_histogram(seed):
    rng = random.Random(seed)
    histogram = dict(Counter(rng.choice([rng.randint(1, 64), rng.randint(1, 20)]) for _ in range(400)))
    plan = packing.solve(histogram, 64)
    back = Counter()
    for counts, times in plan:
        assert sum(k * v for k, v in counts.items()) <= 64
        for k, v in counts.items():
            back[k] += v * times
    assert back == Counter(histogram)
    assert sum(t for _, t in plan) <= 1.05 * packing.lower_bound(histogram, 64) + 2
    assert packing.solve({}, 64) == []
