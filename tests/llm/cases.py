"""Awkward documents, and plain definitions to compare with."""

import random
import re

LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def sentence(rng, n=40):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(seed=1, copies=6):
    """Rows (doc_id, text, lang, source, n_chars): nulls, empty and long texts,
    repeated rows, near copies, an id with two texts."""
    rng = random.Random(seed)
    texts = [None, "", " \n\t ", "one", "one", "two words", LONG, LONG + " end"]
    for _ in range(12):
        base = sentence(rng, rng.randint(5, 80))
        texts.append(base)
        for _ in range(rng.randint(0, copies)):
            ws = base.split()
            for _ in range(rng.randint(0, max(1, len(ws) // 8))):
                ws[rng.randrange(len(ws))] = rng.choice(["x", "y", "Zed"])
            texts.append(" ".join(ws))
    rows = [(i * 3 % 101, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None, "c"]), None)
            for i, t in enumerate(texts)]
    rows.append((None, "text without an id " * 4, "en", "a", 1))
    rows.append(rows[10])
    rows.append((rows[10][0], "another text under the same id as before", "fr", None, 2))
    return rows


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns of the operators' own, to clash with
EXTRA = ("node", "group", "component", "label", "size", "target", "taken", "t", "w", "h", "n_words",
         "score", "lang_pred", "piece", "length", "_row", "_copies", "host", "token")


def with_extras(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA) if c not in df.columns])


def shingles(text, width):
    ws = [w.lower() for w in words(text)]
    if not ws:
        return frozenset()
    width = min(width, len(ws))
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def linked_components(items, linked):
    """Smallest id reachable for (id, value) rows, by index."""
    parent = list(range(len(items)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i][1], items[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            r = find(i)
            least[r] = min(least.get(r, key), key)
    return [least.get(find(i)) if items[i][0] is not None else None for i in range(len(items))]
