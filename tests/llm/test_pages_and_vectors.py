"""Operators on pages and vectors against plain definitions."""

import io
import itertools
import random
import time
import zlib
from collections import Counter

import cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import html, urls, vectors, warc
from tidegraph.llm.components import components
from tidegraph.llm.scratch import Scratch

PAGES = "page_id long, url string, html string"


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60) if i % 13] + [(200, i) for i in range(201, 230)] + [(5, 5)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    parent = {n: n for n in nodes}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in nodes}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


# --- vectors -----------------------------------------------------------------


@pytest.mark.parametrize("cell,block", [(1024, 2048), (32, 20)])
def test_links_are_those_of_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(60)]
    x += [v + rng.normal(size=16) * rng.choice([0, 0.1, 0.3]) for v in x[:20] for _ in range(4)]
    x += [x[0] * 3, np.zeros(16), np.full(16, np.nan), np.full(16, np.inf)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [1.0, None]), (903, [1.0, 2.0]), (904, [2.0, 4.0]), (905, rows[3][1]),
             (None, rows[4][1])]
    df = cases.with_extras(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    unit = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    linked = lambda a, b: len(a) == len(b) and float(a @ b) >= 0.9
    n = {i: sum(linked(u, w) for j, w in unit.items() if j != i) for i, u in unit.items()}
    parts = dict(zip(unit, cases.linked_components(list(unit.items()), linked)))
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[i]["n_links"] for i in n)
    assert all(got[i]["n_links"] <= n[i] for i in n) and found >= 0.98 * sum(n.values())
    if found == sum(n.values()):
        assert {i: got[i]["component_id"] for i in parts} == parts
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 81 + 60, 142))
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0


# --- WARC --------------------------------------------------------------------


def pages_for_archives():
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", cases.sentence(rng, rng.randint(0, 200))) for i in range(40)]
    rows += [(i, None, rows[i % 5][2]) for i in range(40, 60)]
    rows += [(60, "u", None), (61, "u\r\nWARC-Type: x", ""), (62, "é", "é\x00\r\n\r\n" * 5), (None, "n", "odd"),
             (7, rows[7][1], rows[7][2]), (63, "long", cases.LONG * 3)]
    return rows


def test_scans_of_other_splits_agree(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"http://h/{i}", cases.sentence(rng, 30)) for i in range(250)]
    rows += [(1000 + i, f"http://h/{i}", rows[i % 50][2]) for i in range(40)]
    rows += [rows[7]] * 10 + [(8, None, rows[7][2])] * 5 + [(9, "http://h/9", rows[9][2])] * 5
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, PAGES).repartition(6).write.parquet(path)
    save, turn = Scratch.save, []

    def other_splits(self, df):
        # as when executors come and go between two scans of the input
        turn.append(1)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(4000 * (1 + len(turn) % 3)))
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", other_splits)
    try:
        manifest = warc.write_archives(spark.read.parquet(path), f"file://{tmp_path}/archives")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    kinds = Counter(r["record_type"] for r in warc.read_archives(manifest).collect())
    assert kinds == {"response": 250, "revisit": 60}


@pytest.mark.parametrize("split", [200, 1 << 20])
def test_archives_give_back_what_was_written(spark, tmp_path, split):
    rows = pages_for_archives()
    df = cases.with_extras(spark.createDataFrame(rows, PAGES).repartition(3))
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives")
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest, split).collect()
    least = {}
    for i, _, t in rows:
        p = (t or "").encode()
        least[p] = min(least.get(p, 10**9), 10**9 if i is None else i)
    expected = Counter()
    seen = set()
    for i, _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (t or "").encode()
        first = p not in seen
        seen.add(p)
        expected[i, len(p), warc.digest_of(p), "response" if first else "revisit",
                 None if first else (None if least[p] == 10**9 else least[p])] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in got) == expected
    by_digest = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert {warc.digest_of(p): p for p in least} == by_digest
    assert warc.round_trip(df.limit(0)).count() == 0


def test_false_magic_is_no_record():
    inner = warc.member(warc.record(9, "x", b"inner", 5, warc.digest_of(b"inner"), "response", None), 0)
    payload = inner + b"\x1f\x8b\x08" * 50 + bytes(range(256)) * 9
    first = warc.member(warc.record(1, "a", payload, len(payload), "d", "response", None), 0)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # bytes as they are, another writer's member
    data = warc.record(2, "b", payload, len(payload), "d", "response", None)
    second = stored.compress(data) + stored.flush()
    whole = first + second
    for size in (1, 37, 1000, len(whole)):
        found = [fields["X-Page-ID"] for at in range(0, len(first), size)
                 for _, fields, _ in warc.records_in(io.BytesIO(whole), at, min(at + size, len(first)))]
        assert found == ["1"]
    assert [f["X-Page-ID"] for _, f, _ in warc.records_in(io.BytesIO(whole), 0, len(whole))] == ["1", "2"]
    with pytest.raises(ValueError):
        list(warc.records_in(io.BytesIO(first[:-9]), 0, len(first)))


# --- main text ---------------------------------------------------------------


@pytest.mark.parametrize("page,blocks,marked", [
    ("", [], False),
    ("plain &amp; simple", ["plain & simple"], False),
    ("<article><h1>T</h1><p>a<br>b <b>c\n d<p>e</article><p>out", ["T", "a b c d", "e"], True),
    ("<nav>n</nav><main><p>x<div class='ad box'>no</div>y</main>", ["x", "y"], True),
    ("<div id=comments><p>no</div><p>yes</p><form>no</form><!-- no --><script>'<p>no'</script>z", ["yes", "z"], False),
    ("<article><header><h1>T</h1></header><p>x</p><footer>no</footer><section class=\"comments\">no</section></article>",
     ["T", "x"], True),
    ("a < b <a href='x>y'>c</a> &lt;p&gt;", ["a < b c <p>"], False),
    ("<p title=\"never closed>one<p>two", ["one", "two"], False),
])
def test_blocks_of_pages(page, blocks, marked):
    assert html.blocks_of(page) == (blocks, marked)


def test_boilerplate_of_hosts(spark, monkeypatch):
    monkeypatch.setattr(html, "STRETCH", 7)
    rows = []
    for h in ("a.org", "b.org"):
        for i in range(6):
            rows.append((i, f"http://{h}/{i}", f"<body><div>Site menu of {h} with links</div>"
                         f"<p>Article number {h} {i} has its very own text.</p><p>Own {h} {i} words here.</p>"
                         f"<div>All rights reserved by {h} since ever</div></body>"))
    rows += [(9, "http://a.org/copy", rows[0][2]), (10, None, None), (11, "http://c.org", rows[0][2])]
    df = cases.with_extras(spark.createDataFrame(rows, PAGES).repartition(4))
    got = {(r["page_id"], r["url"]): r["text"] for r in html.main_text(df).collect()}
    for h in ("a.org", "b.org"):
        for i in range(6):
            assert got[i, f"http://{h}/{i}"] == (
                f"Article number {h} {i} has its very own text.\n\nOwn {h} {i} words here.")
    assert got[9, "http://a.org/copy"] == got[0, "http://a.org/0"] and got[10, None] == ""
    assert got[11, "http://c.org"].count("\n\n") == 3  # alone on its host
    assert html.main_text(df.limit(0)).count() == 0


def test_pages_of_a_repeated_run_are_dealt_to_all_tasks(spark):
    # one host, one footer
    rows = [("h", b"footer", b"%d" % (i % 400), i, 0) for i in range(800)]
    rows += [("h", b"own %d" % i, b"%d" % i, i, 1) for i in range(400)]
    rows += [("h", b"copy", b"1", i, 2) for i in range(9)] + [("g", b"two", b"%d" % (i % 2), i, 2) for i in range(9)]
    found = html.repeated(spark.createDataFrame(rows, html.SUFFIXES).repartition(4))
    assert [tuple(r) for r in found.collect()] == [("h", b"footer")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(host" in line]
    assert any("page" in line.split("),")[0] for line in dealt)
    assert "partial_count" in plan and "Window" not in plan


def test_neighbours_of_sorted_suffixes_are_compared(spark):
    blocks = ["a b c d e f g h i j", "b c d e f g h i x"]
    starts = [s.tobytes() for s in html.suffixes(blocks)]
    assert len(starts) == 12 and len(set(starts)) == 11
    token = {w: s[:8] for w, s in zip("abcdefghij", starts)}
    assert starts[1] == b"".join(token[w] for w in "bcdefghi") == starts[10]
    near = b"".join(token[w] for w in "bcdj") + starts[0][:32]
    assert list(html.common_prefixes(["h", "h", "h", "g"], [starts[1], starts[10], near, near])) == [8, 3, 0]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_runs_go_on_over_batches_and_tasks(spark, size):
    rng = random.Random(size)
    rows = sorted({(rng.choice("gh"), b"%03d" % min(rng.randrange(90), rng.randrange(90)), b"%d" % rng.randrange(40))
                   for _ in range(300)})
    rows = sorted(rows + [("h", b"hub", b"%d" % i) for i in range(50)])
    kinds = pa.schema([("host", pa.string()), ("start", pa.binary()), ("page", pa.binary())])
    cuts = [0, *sorted(rng.sample(range(len(rows)), 7)), len(rows)]
    found = Counter()
    for a, b in zip(cuts, cuts[1:]):  # a task
        batches = [
            pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows[i : min(b, i + size)]), kinds)],
                                       schema=kinds) for i in range(a, b, size)]
        for part in html._runs(iter(batches)):
            for run in part.to_pylist():
                assert len(run["pages"]) <= html.LEAST_PAGES
                found[run["host"], run["start"]] += len(run["pages"])
    want = Counter((h, s) for h, s, _ in rows)
    assert {k for k, n in found.items() if n >= html.LEAST_PAGES} == {
        k for k, n in want.items() if n >= html.LEAST_PAGES}
    table = spark.createDataFrame([(*r, 0, 0) for r in rows], html.SUFFIXES)
    kept = html.repeated(table)
    assert "rangepartitioning(host" in kept._jdf.queryExecution().executedPlan().toString()
    assert {(r["host"], bytes(r["start"])) for r in kept.collect()} == {
        k for k, n in want.items() if n >= html.LEAST_PAGES}


def longest_repeats(pages, least_pages, least):
    """Tokens covered by strings of ``least`` tokens or more on several pages: for each
    place the longest string from there that other pages have, by trying."""
    streams = [[t for b in blocks for t in b.split()] for blocks in pages]
    texts = {i: " " + " ".join(s) + " " for i, s in enumerate(streams)}
    different = {i: t for i, t in texts.items() if t not in list(texts.values())[:i]}
    covered = []
    for s in streams:
        mine = [False] * len(s)
        for a in range(len(s)):
            n = least
            while a + n <= len(s) and sum(
                    " " + " ".join(s[a : a + n]) + " " in t for t in different.values()) >= least_pages:
                n += 1
            for k in range(a, a + n - 1 if n > least else a):
                mine[k] = True
        covered.append(mine)
    return covered


def test_covered_tokens_are_those_of_longest_repeated_strings(spark):
    rng = random.Random(6)
    shared = [cases.sentence(rng, rng.randint(3, 25)) for _ in range(8)]
    pages = []
    for i in range(40):
        blocks = []
        for _ in range(rng.randint(0, 6)):  # shared strings, whole, cut, and inside blocks
            words = rng.choice(shared).split()
            a = rng.randint(0, len(words) // 3)
            part = " ".join(words[a : a + rng.randint(1, 25)])
            blocks.append(rng.choice(["", cases.sentence(rng, 4) + " "]) + part + rng.choice(["", " " + cases.sentence(rng, 2)]))
        pages.append((f"h{i % 3}", [b for b in blocks if b]))
    pages += [pages[0]] * 4  # copies of a page are one page
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{b}</p>" for b in bs)) for i, (h, bs) in enumerate(pages)]
    expected = {}
    for h in ("h0", "h1", "h2"):
        here = [i for i, (host, _) in enumerate(pages) if host == h]
        for i, mine in zip(here, longest_repeats([pages[i][1] for i in here], html.LEAST_PAGES, html.RUN)):
            out, at = [], 0
            for block in pages[i][1]:
                words = block.split()
                flags = mine[at : at + len(words)]
                at += len(words)
                if not all(flags):  # what is short is repeated only with its neighbours
                    for k, stretch in [(k, list(g)) for k, g in itertools.groupby(range(len(flags)), flags.__getitem__)]:
                        if k and len(stretch) < html.RUN:
                            flags[stretch[0] : stretch[-1] + 1] = [False] * len(stretch)
                runs, run = [], []
                for w, f in [*zip(words, flags), ("", True)]:
                    if f:
                        runs.append(run)
                        run = []
                    else:
                        run.append(w)
                if any(flags):
                    runs = [r for r in runs if len(r) >= html.LEAST_TOKENS]
                text = " ".join(w for r in runs for w in r)
                if text:
                    out.append(text)
            expected[i] = "\n\n".join(out)
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got == expected
    assert any(len(t) < len("\n\n".join(pages[i][1])) for i, t in got.items())


@pytest.mark.parametrize("page,blocks", [
    ('<div class="content no-sidebar"><p>One whole page of text.</p><p>And more.</p></div>',
     ["One whole page of text.", "And more."]),
    ('<article class="post comments-open"><p>Text.</p></article>', ["Text."]),
    ('<article><header class="entry-header"><h1>The title</h1></header><p>Text.</p></article>',
     ["The title", "Text."]),
    ('<article><p>Text.</p><div class="related-work"><h2>Related work</h2><p>A section.</p></div></article>',
     ["Text.", "Related work", "A section."]),
    ("<article><p>With <math><mi>x</mi><mo>=</mo><mn>2</mn></math> inside.</p></article>", ["With x=2 inside."]),
    ('<div class="modal-page sidebar"><article><p>Inside.</p></article></div>', ["Inside."]),
    ('<p>Text.</p><div class="comments"><p>' + "A long comment. " * 60 + "</p></div>", ["Text."]),
    ('<p>Text.</p><div class="cookie-banner">We use cookies</div>', ["Text."]),
    ('<p>Text.</p><div class="related-posts"><a href="x">One post</a> <a href="y">Other</a></div>', ["Text."]),
    ('<div role="main"><p>Text.</p></div><div>Other</div>', ["Text."]),
    ("<p>a<b>b<p>c</b>d</p>", ["ab", "cd"]),
])
def test_structure_leaves_the_article_whole(page, blocks):
    assert html.blocks_of(page)[0] == blocks


@pytest.mark.parametrize("page", [
    "<b>" * 200_000 + "</i>" * 200_000, "<b>" * 100_000 + "<p>x" * 100_000, "<div>" * 200_000 + "</div>" * 200_000,
    "<i><b>" * 100_000 + "</i></b>" * 100_000, '<div class="promo-x">' * 50_000 + "y",
])
def test_deep_markup_takes_time_by_its_length(page):
    start = time.perf_counter()
    html.blocks_of(page)
    assert time.perf_counter() - start < 8  # about one on a free core; the square would take minutes


# --- URLs --------------------------------------------------------------------


def test_urls_and_rules(spark):
    rows = [
        (1, "http://Example.ORG/es/1", "example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://x.example.org/en/12?q=1", "x.example.org", "/en/12", "example.org/en/1", "block"),
        (3, "https://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        (4, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (5, "https://a.com/de", "a.com", "/de", None, "allow"),
        (6, None, "", "", None, "allow"), (7, "no scheme.org/es/", "", "", None, "allow"),
        (8, "x://a.net?y#/de/", "a.net", "", None, "allow"), (9, "x://org", "org", "", None, "allow"),
        (9, "x://org", "org", "", None, "allow"),
    ]
    df = cases.with_extras(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"))
    got = urls.judged(df, least_support=1.0).drop("confidence").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *r[2:]) for r in rows)
    assert urls.judged(df.limit(0)).count() == 0


def test_mined_rules_are_those_of_counting(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        host = rng.choice(["a.com", "b.com", "c.org", "pills.net", "d.net"])
        rows.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'en', 'es'])}/{rng.choice(['x', 'y'])}/{i % 7}"))
    rows += [(400 + i, "http://d.net/de/x/1?" + "&".join(f"k{j}=1" for j in range(60))) for i in range(20)]
    # labelled together always, not labelled with one of these tokens only
    rows += [(500 + i, f"http://example.org/es/only/{i}") for i in range(30)]
    rows += [(600, "http://example.net/8"), (601, "http://e.net/es/5"), (602, "http://e.net/only/5"),
             (603, "http://e.net/fr/only/y")]
    monkeypatch.setattr(urls, "PIECE", 7)
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judged(df, least_support=0.05).collect()}
    parts = df.select("page_id", urls.tokens(F.col("url"), urls.host(F.col("url")), urls.path(F.col("url"))).alias("t"))
    tokens = {r["page_id"]: frozenset(r["t"]) for r in parts.collect()}
    known = {i: got[i]["verdict"] for i in got if got[i]["rule"] is not None}
    n = len(known)
    for i, r in got.items():
        if r["rule"] is not None:
            continue
        # blocked if some set of its tokens is frequent and nearly always blocked
        best, mine = 0.0, sorted(tokens[i] & {t for k in known for t in tokens[k]})
        for mask in range(1, 1 << len(mine)):
            some = {t for b, t in enumerate(mine) if mask >> b & 1}
            have = [known[k] for k in known if some <= tokens[k]]
            blocked = have.count("block")
            if blocked >= 0.05 * n:
                best = max(best, blocked / len(have))
        assert r["verdict"] == ("block" if best >= urls.LEAST_CONFIDENCE else "allow"), (i, best)


def test_items_of_many_rows(spark):
    # a token on 20 million rows, and one that is always beside it
    rows = spark.range(20_000_000).select(
        "id", F.lit(1).cast("long").alias("n"),
        F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("c"), F.col("id") % 2)).alias("tokens"))
    got = {(r["item"], r["token"]) for r in urls._item_tokens(rows, 1000.0).collect()}
    assert got == {("a", "a"), ("a", "b"), ("c0", "c0"), ("c1", "c1")}


def test_a_repeated_url_is_weighed(spark):
    labelled = spark.createDataFrame(
        [(1, 25, ["x", "y"], "block"), (2, 3, ["x"], "block"), (3, 30, ["z"], "allow")],
        "id long, n long, tokens array<string>, verdict string")
    index = urls._item_tokens(labelled, 1.0)
    got = Counter(tuple(r["items"]) for r in urls._baskets(labelled, index).collect())
    assert got == {("x", "y", "verdict=block"): 25, ("x", "verdict=block"): 3, ("z", "verdict=allow"): 30}
