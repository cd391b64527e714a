"""Near-duplicate documents by an LSH forest.

1. Every document becomes the set of its two-word shingles; documents with equal
   sets form one class, and a class has one MinHash signature.
2. A forest of trees: each tree sorts all classes by its own sequence of
   signature values. Neighbours in a sorted order that share a long enough prefix
   are candidates. How long is long enough depends on the region: where a prefix
   is shared by few classes, these are candidates of each other; where it is
   shared by many, only the next in order and those that share a longer one.
3. Candidates whose whole signatures agree well enough form groups. Within a
   group links are confirmed on full sets. Groups of any size are handled:
   small ones in one task each; large ones in blocks, first inside the blocks,
   then against the best-linked members of the group, then what is still apart
   from the group's largest component, dealt to blocks of its own, each of them
   against every block of the rest and every other one of its kind. Links between
   documents that are already connected are not looked for.

No step emits the pairs of a group, and no task holds more than two blocks, or a
block and ``PIVOTS`` guests.

Defined cases: a document without words (or text) has an empty set and is linked
with nothing; one with a single word has that word as its only shingle; rows
with equal ids are linked only through their sets; a row without an id takes no
part, its component is null and it is not kept. An empty table gives no rows.
Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.llm.components import components
from tidegraph.llm.runs import runs
from tidegraph.llm.scratch import Scratch
from tidegraph.llm.words import mix, word_hashes
from tidegraph.llm.workers import ship_package

TREES, BRANCH, DEPTH = 24, 4, 8  # values per tree: own ones, and with borrowed ones
N_VALUES = TREES * BRANCH
WINDOW = 4  # neighbours looked at in a sorted order, where few share a prefix
BLOCK = 256  # classes compared with each other in one task
PIVOTS = 32
# four standard deviations of the estimate below a similarity of 0.8
LEAST_AGREEMENT = 0.8 - 4 * (0.8 * 0.2 / N_VALUES) ** 0.5

_RNG = np.random.default_rng(20240601)
_FACTORS = _RNG.integers(1, 1 << 63, N_VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, N_VALUES, dtype=np.uint64)


# ---- sets and signatures --------------------------------------------------


def shingle_set(words: np.ndarray, width: int = 2) -> np.ndarray:
    """The sorted distinct shingle hashes of a sequence of word hashes."""
    if len(words) == 0:
        return words
    if len(words) < width:
        width = len(words)
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash values of a non-empty set, as unsigned 32-bit numbers."""
    best = np.full(N_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None]
        np.minimum(best, ((part ^ _MASKS) * _FACTORS).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype("<u4")


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    return np.array(
        [shingles.sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)],
        ">u8",
    ).tobytes()


SIGNED = "doc_id long, digest binary, n_shingles long, node binary, signature binary, sketch binary"


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, signatures, sketches = [], [], [], []
        for at in range(0, batch.num_rows, 512):
            for words in word_hashes(batch.column(2).slice(at, 512).to_pylist()):
                shingles = shingle_set(words, width)
                sizes.append(len(shingles))
                if len(shingles):
                    values = signature(shingles)
                    nodes.append(set_key(shingles))
                    signatures.append(values.tobytes())
                    sketches.append(values.astype(np.uint8).tobytes())
                else:
                    nodes.append(None), signatures.append(None), sketches.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()),
             pa.array(signatures, pa.binary()), pa.array(sketches, pa.binary())],
            names=[f.split()[0] for f in SIGNED.split(", ")],
        )


# ---- the forest -----------------------------------------------------------


def forest_rows(classes: DataFrame) -> DataFrame:
    """``tree, key, node``: a class once per tree, with the values it is sorted by."""
    own = F.expr(f"substring(signature, tree * {4 * BRANCH} + 1, {4 * BRANCH})")
    more = F.expr(
        f"substring(signature, pmod(tree + 7, {TREES}) * {4 * BRANCH} + 1, {4 * (DEPTH - BRANCH)})"
    )
    return classes.select(
        "node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    ).select("tree", F.concat(own, more).alias("key"), "node")


def neighbours(trees: list[int], keys: list[bytes], nodes: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Candidate pairs among rows of one or more trees in sorted order."""
    n = len(nodes)
    if n < 2:
        return set()
    values = np.frombuffer(b"".join(keys), "<u4").reshape(n, DEPTH)
    same = (values[1:] == values[:-1]) & (np.diff(np.asarray(trees)) == 0)[:, None]
    shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # with the row before
    pairs: set[tuple[bytes, bytes]] = set()

    def link(first: int, last: int, reach: int) -> None:
        for step in range(1, reach + 1):
            for i in range(first, last - step):
                a, b = nodes[i], nodes[i + step]
                pairs.add((a, b) if a < b else (b, a))

    def region(first: int, last: int, depth: int) -> None:
        """Rows first..last-1 share ``depth`` values."""
        if last - first <= WINDOW + 1:
            link(first, last, WINDOW)
            return
        # many: the next in order connect them, confirming compares them all
        link(first, last, 1)
        if depth == DEPTH:
            return
        inner = np.flatnonzero(shared[first : last - 1] < depth + 1) + first + 1
        edges = [first, *inner.tolist(), last]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                region(a, b, depth + 1)

    edges = [0, *(np.flatnonzero(shared < BRANCH) + 1).tolist(), n]
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            region(a, b, BRANCH)
    return pairs


PAIRS = "a binary, b binary, edge int, tree int, key binary, node binary"
STRETCH = 20_000


def _pair_batch(pairs, edges=()) -> pa.RecordBatch:
    pairs, edges = sorted(pairs), list(edges)
    none = [None] * len(edges)
    some = [None] * len(pairs)
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs] + none, pa.binary()),
         pa.array([p[1] for p in pairs] + none, pa.binary()),
         pa.array(some + [e[0] for e in edges], pa.int32()),
         pa.array(some + [e[1] for e in edges], pa.int32()),
         pa.array(some + [e[2] for e in edges], pa.binary()),
         pa.array(some + [e[3] for e in edges], pa.binary())],
        names=[f.split()[0] for f in PAIRS.split(", ")],
    )


def _sorted_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among the rows of a sorted partition, in stretches that overlap by a
    window; and the rows at its two ends, which the next step sets beside those
    of the neighbouring partitions."""
    part = TaskContext.get().partitionId()
    rows: list[tuple[int, bytes, bytes]] = []
    head: list[tuple[int, bytes, bytes]] = []
    for batch in batches:
        new = list(zip(*(c.to_pylist() for c in batch.columns)))
        head += new[: max(0, WINDOW - len(head))]
        rows += new
        if len(rows) >= STRETCH:
            yield _pair_batch(neighbours(*map(list, zip(*rows))))
            rows = rows[-WINDOW:]
    if rows:
        tail = [(part, *r) for r in rows[-WINDOW:]]
        yield _pair_batch(neighbours(*map(list, zip(*rows))), [(part - 1, *r) for r in head] + tail)


def _edge_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, run in runs(batches, 0):
        run.sort(key=lambda r: r[1:])
        yield _pair_batch(neighbours(*map(list, zip(*[r[1:] for r in run]))))


def candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, b``: pairs of classes that some tree puts side by side and whose whole
    signatures agree well enough for a similarity of 0.8."""
    found = scratch.save(
        forest_rows(classes).repartitionByRange("tree", "key")
        .sortWithinPartitions("tree", "key", "node")
        .mapInArrow(_sorted_neighbours, PAIRS)
    )
    at_edges = (
        found.where("edge is not null").select("edge", "tree", "key", "node")
        .repartition("edge").sortWithinPartitions("edge").mapInArrow(_edge_neighbours, PAIRS)
    )
    pairs = found.where("a is not null").select("a", "b").union(at_edges.select("a", "b")).distinct()
    sketches = classes.select("node", "sketch")
    a = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    b = sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_agreeing, "a binary, b binary")


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = dict(zip(batch.schema.names, batch.columns))
        sides = [
            np.frombuffer(b"".join(columns[c].to_pylist()), np.uint8).reshape(-1, N_VALUES)
            for c in ("sketch_a", "sketch_b")
        ]
        keep = pa.array((sides[0] == sides[1]).mean(axis=1) >= LEAST_AGREEMENT)
        yield pa.RecordBatch.from_arrays(
            [columns["a"].filter(keep), columns["b"].filter(keep)], names=["a", "b"]
        )


# ---- confirming links -----------------------------------------------------


class _Sets:
    """The full sets of some classes, compared with each other."""

    def __init__(self, texts: list[str], width: int, percent: int):
        self.sets = [shingle_set(w, width) for w in word_hashes(texts)]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.sketches = np.stack([signature(s).astype(np.uint8) for s in self.sets])
        self.percent = percent

    def linked(self, i: int, others: np.ndarray) -> Iterator[int]:
        """Those of ``others`` linked with ``i``, the most alike first."""
        small = np.minimum(self.sizes[i], self.sizes[others])
        large = np.maximum(self.sizes[i], self.sizes[others])
        others = others[100 * small >= self.percent * large]
        alike = (self.sketches[others] == self.sketches[i]).mean(axis=1)
        order = np.argsort(-alike, kind="stable")
        for j in others[order[alike[order] >= LEAST_AGREEMENT]]:
            both = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
            if 100 * both >= self.percent * (self.sizes[i] + self.sizes[j] - both):
                yield int(j)


CONFIRMED = "a binary, b binary, degree long"


def _confirm(batches: Iterator[pa.RecordBatch], width: int, percent: int):
    """Links inside each run of (task, guest, node, label, text) rows.

    Guests are compared with members, and members with each other only where
    there is no guest; a node can be both. Only links between different labels are
    looked for, and one between two parts is enough; ``degree`` counts those
    confirmed for a node.
    """
    for _, rows in runs(batches, 0):
        known, visiting, at_home = {}, set(), set()
        for _, guest, node, label, text in rows:
            known[node] = (node in visiting or guest, node, label, text)
            (visiting if guest else at_home).add(node)
        rows = list(known.values())
        sets = _Sets([r[3] for r in rows], width, percent)
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        guests = [i for i, r in enumerate(rows) if r[0]]
        members = [i for i, r in enumerate(rows) if r[1] in at_home]
        links, degree = [], {}
        for i in guests or range(len(rows)):
            others = members if guests else members[i + 1 :]
            # of the same part already: no need to look
            own = find(rows[i][2])
            others = np.array([j for j in others if j != i and find(rows[j][2]) != own], np.int64)
            for j in sets.linked(i, others) if len(others) else ():
                degree[i] = degree.get(i, 0) + 1
                degree[j] = degree.get(j, 0) + 1
                x, y = find(rows[i][2]), find(rows[j][2])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((rows[i][1], rows[j][1]))
        out = [(a, b, None) for a, b in links]
        out += [(rows[i][1], None, d) for i, d in degree.items()]
        if out:
            a, b, d = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(d, pa.int64())],
                names=["a", "b", "degree"],
            )


def _in_tasks(rows: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    return scratch.save(
        rows.select("task", "guest", "node", "label", "text")
        .repartition("task").sortWithinPartitions("task", "node")
        .mapInArrow(lambda batches: _confirm(batches, width, percent), CONFIRMED)
    )


def _links(found: DataFrame) -> DataFrame:
    return found.where("b is not null").select("a", "b")


def _labelled(members: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``members`` with the component of the links so far as ``label``."""
    parts = components(links, scratch)
    return members.drop("label").join(parts, "node", "left").withColumn(
        "label", F.coalesce("component", "node")).drop("component")


def _task(*key):
    return F.xxhash64(*key)


def confirmed_links(members: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: enough confirmed links to connect what is linked within the groups
    of ``members(node, group, n_group, text)``."""
    members = members.withColumn("label", F.col("node")).withColumn("guest", F.lit(False))
    small = members.where(F.col("n_group") <= BLOCK).withColumn("task", _task("group"))
    links = _links(_in_tasks(small, width, percent, scratch))

    n_blocks = F.ceil(F.col("n_group") / F.lit(BLOCK))
    large = members.where(F.col("n_group") > BLOCK).withColumn(
        "block", F.pmod(F.xxhash64("node"), n_blocks)).withColumn("n_blocks", n_blocks)
    large = scratch.save(large)
    if large.isEmpty():
        return links

    def each(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    inside = _in_tasks(large.withColumn("task", _task("group", "block")), width, percent, scratch)
    degrees = inside.where("degree is not null").groupBy(F.col("a").alias("node")).agg(
        F.sum("degree").alias("degree"))
    # the best-linked members of a group; the window sees those with a link
    best = large.select("node", "group").join(degrees, "node").withColumn(
        "place", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("degree"), "node"))
    ).where(F.col("place") <= PIVOTS).select("node")
    found = _links(inside)
    rows = scratch.save(_labelled(large, found, scratch))
    pivots = rows.join(best, "node", "left_semi").withColumn("guest", F.lit(True)).withColumn(
        "block", each("n_blocks"))
    found = found.union(_links(_in_tasks(
        rows.unionByName(pivots).withColumn("task", _task("group", "block")), width, percent, scratch)))
    rows = scratch.save(_labelled(large, found, scratch))
    sizes = rows.groupBy("group", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("group").agg(F.max(F.struct("n", "label")).alias("main"))
    n_apart = F.col("n_group") - F.col("main.n")
    dealt = scratch.save(
        rows.join(main, "group").withColumn("apart", F.col("label") != F.col("main.label"))
        .withColumn("n_visits", F.ceil(n_apart / F.lit(BLOCK))).where(n_apart > 0).drop("main")
        .withColumn("visit", F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_visits")))
    )
    apart, rest = dealt.where("apart"), dealt.where("not apart")
    # one task for each block of the apart and each block of the rest
    beside = apart.withColumn("guest", F.lit(True)).withColumn("block", each("n_blocks")).unionByName(
        rest.withColumn("visit", each("n_visits"))).withColumn("task", _task("group", "visit", "block"))
    # and one for each two blocks of the apart; within one block, all are members
    other = apart.withColumn("other", each("n_visits"))
    among = other.withColumn("guest", F.col("visit") < F.col("other")).withColumn(
        "task", _task("group", F.least("visit", "other"), F.greatest("visit", "other"), F.lit("apart")))
    return links.union(found).union(_links(_in_tasks(beside, width, percent, scratch))).union(
        _links(_in_tasks(among, width, percent, scratch)))


# ---- the operator ---------------------------------------------------------


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def classified(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, digest, n_shingles, component, component_id`` per row of ``docs``: the
    digest of its text, and the group of its shingle set with the smallest id there;
    without shingles or an id there is no group."""
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _digest(F.col("text")).alias("digest"), "text")
    signed = scratch.save(texts.mapInArrow(lambda b: _sign(b, width), SIGNED))
    classes = scratch.save(
        signed.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"),
            F.first("sketch").alias("sketch"))
    )
    pairs = candidates(classes, scratch)
    groups = components(pairs, scratch).withColumnRenamed("component", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n_group"))
    wanted = (
        groups.join(sizes, "group").join(classes.select("node", "first_id"), "node")
        .select("node", "group", "n_group", F.col("first_id").alias("doc_id"))
    )
    # an id can stand for several texts: the node says which one is meant
    members = scratch.save(
        texts.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
        .mapInArrow(lambda b: _with_node(b, width), "node binary, text string")
        .dropDuplicates(["node"]).join(wanted.drop("doc_id"), "node")
    )
    links = confirmed_links(members, width, percent, scratch)
    parts = components(links, scratch)
    ids = (
        classes.select("node", "first_id").join(parts, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    # hidden, so that the join shuffles both sides for itself and can split a hot group
    least = ids.groupBy("component").agg(F.min("first_id").alias("component_id")).withColumn(
        "component", F.concat("component", F.lit(b"")))
    by_node = ids.join(least, "component").select("node", "component", "component_id")
    found = signed.select("doc_id", "digest", "n_shingles", "node").join(by_node, "node", "left")
    named = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return found.select("doc_id", "digest", "n_shingles", named("component"), named("component_id"))


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``."""
    component = F.coalesce("component_id", "doc_id")
    return classified(docs, width, percent).select(
        "doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _with_node(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        nodes = []
        for at in range(0, batch.num_rows, 512):
            for words in word_hashes(texts.slice(at, 512).to_pylist()):
                shingles = shingle_set(words, width)
                nodes.append(set_key(shingles) if len(shingles) else None)
        keep = pa.array([n is not None for n in nodes], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()).filter(keep), texts.filter(keep)],
            names=["node", "text"])


def one_of_each(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group.

    A document is an id with its text: rows that repeat both are one, and one id can
    stand for several. Of a group, that of the smallest id stays, and of several with
    this id that of the smallest digest; of rows that repeat one, the first as JSON.
    Documents without a word are groups of their own, and rows without an id stay.
    """
    named = classified(docs, width, percent).where("doc_id is not null").groupBy(
        "doc_id", "digest").agg(F.count("*").alias("rows"), F.first("component").alias("component"))
    named = Scratch(docs.sparkSession).save(named)
    first = named.where("component is not null").groupBy("component").agg(
        F.min(F.struct("doc_id", "digest", "rows")).alias("first")).select("first.*")
    kept = first.unionByName(named.where("component is null").select("doc_id", "digest", "rows"))
    # the row travels whole, so that no column of its own meets these
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                       _digest(F.col("text")).alias("digest"))
    found = rows.join(kept, ["doc_id", "digest"])
    several = found.where("rows > 1").groupBy("doc_id", "digest").agg(
        F.min_by("row", F.to_json("row")).alias("row"))
    once = found.where("rows = 1").select("row").unionByName(several.select("row"))
    return once.unionByName(rows.where("doc_id is null").select("row")).select("row.*")
