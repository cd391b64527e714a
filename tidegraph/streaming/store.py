"""A graph that grows with a stream: stored marks of every micro-batch.

Keyed streaming state cannot hold this graph, because removing a vertex
touches edges kept under other keys. Instead each micro-batch leaves the marks
of its own commands (see ``operators.marks``) as tables in buckets:

* ``edge``: edge marks in buckets of the source, spread over ``PARTS`` parts, so
  that no hub fills a bucket;
* ``mirror``: the same in buckets of the target;
* ``vertex``: vertex marks in buckets of the id.

Marks merge by ``max``, so late, repeated and reordered input gives the same
graph, and a micro-batch that is run again replaces its own tables. All tables
share their buckets, so that merging them, and looking up in them what a
micro-batch touches, moves rows of the micro-batch and none of the state.

Stored edge marks carry the removals of their endpoints. When a micro-batch is
stored, its additions meet the removals known of their endpoints, and the living
edges that its vertex removals take along are found in both kinds of buckets and
get a removal of their own. An edge is then alive by its own marks, whatever the
order in which commands arrive, and the totals change by the keys that a
micro-batch brings to life or ends: they are kept and never counted anew.

A manifest names the tables that count. It is written whole under the next
number and read by one listing; what it does not name, such as the tables of a
micro-batch that failed, is not seen. A graph is saved by noting the tables it is made
of, and made the current one again by going on from these: neither copies a row.
::

    root/versions/N       the manifests
    root/tables/...       the tables
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import ADD_EDGE, ADD_NODE, BATCH, DEFAULT_VERTEX_ATTR, EDGE_KEY, Graph, order_key, outlives
from tidegraph.operators.expiry import expired
from tidegraph.operators.marks import (
    alive_vertices,
    edge_marks,
    merge_marks,
    removals_from_marks,
    vertex_marks,
    with_endpoint_removals,
)
from tidegraph.operators.series import count_changes, running_totals

EDGE_MARKS = "src bigint, attr string, dst bigint, last_add bigint, last_rmv bigint, last_add_ts {ts}"
VERTEX_MARKS = "id bigint, last_add bigint, last_rmv bigint"
PARTS = 8  # of a vertex's edges
KEEP_VERSIONS = 8
# The bucket columns of each kind of table.
BUCKETED_BY = {"edge": ("src", "part"), "mirror": ("dst", "part"), "vertex": ("id",)}


@dataclass
class Level:
    """The tables of one micro-batch, or of all up to one."""

    tables: dict[str, str]  # kind -> folder
    schemas: dict[str, str]
    n_edges: int = 0  # change of the totals, or the totals of a base
    n_vertices: int = 0


@dataclass
class Manifest:
    version: int = 0
    buckets: int = 0
    deltas: dict[int, Level] = field(default_factory=dict)
    bases: dict[int, Level] = field(default_factory=dict)
    start: list[Level] = field(default_factory=list)  # the saved graph that was gone on from
    saved: dict[int, list[Level]] = field(default_factory=dict)  # by epoch millis
    number: int = -1  # the last micro-batch of whole steps,
    before: str | None = None  # and the manifest before it
    pruned: int = -1  # the last micro-batch whose delta may have been deleted
    settled: int | None = None  # no command below this key is taken any more

    def base(self, upto: int | None = None) -> int | None:
        return max((n for n in self.bases if upto is None or n <= upto), default=None)

    def levels(self, upto: int | None = None) -> list[Level]:
        """What holds the marks of all micro-batches, or of those up to one."""
        base = self.base(upto)
        chosen = [
            level for n, level in sorted(self.deltas.items())
            if (base is None or n > base) and (upto is None or n <= upto)
        ]
        return (self.start if base is None else [self.bases[base]]) + chosen

    def folders(self) -> set[str]:
        every = [*self.deltas.values(), *self.bases.values(), *self.start]
        every += [level for levels in self.saved.values() for level in levels]
        if self.before is not None:
            return {f for level in every for f in level.tables.values()} | Manifest.from_json(self.before).folders()
        return {folder for level in every for folder in level.tables.values()}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        read = json.loads(text)
        for name in ("deltas", "bases"):
            read[name] = {int(n): Level(**level) for n, level in read[name].items()}
        read["start"] = [Level(**level) for level in read["start"]]
        read["saved"] = {int(n): [Level(**level) for level in some] for n, some in read["saved"].items()}
        return cls(**read)


def _part(kind: str) -> Column:
    """Spreads the edges of a vertex by what else tells them apart."""
    other = ("attr", "dst") if kind == "edge" else ("src", "attr")
    return F.pmod(F.xxhash64(*other), F.lit(PARTS)).cast("int")


class GraphStore:
    """Marks of a streamed graph under one folder, written by one query at a time.

    ``buckets`` is chosen when the store is first written; by default it is the
    session's number of shuffle partitions.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        mode: str = BATCH,
        ts_type: str = "timestamp_ntz",
        buckets: int | None = None,
    ):
        self.spark = spark
        self.root = root.rstrip("/")
        self.mode = mode
        self.ts_type = ts_type
        self._buckets = buckets
        self._tables: dict[str, DataFrame] = {}  # by folder: what is written never changes
        edge = EDGE_MARKS.format(ts=ts_type)
        self._schemas = {"edge": edge, "mirror": edge, "vertex": VERTEX_MARKS}

    # --- the manifest --------------------------------------------------------

    def _fs(self, path: str):
        """The file system of a path, and the path for it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def manifest(self) -> Manifest:
        """The newest manifest."""
        versions = [int(n) for n in self._names("versions") if n.isdigit()]
        if not versions:
            buckets = self._buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return Manifest(buckets=buckets)
        fs, path = self._fs(f"{self.root}/versions/{max(versions)}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.from_json(text)

    def _commit(self, manifest: Manifest) -> None:
        """Write the next manifest under its number, whole or not at all."""
        manifest.version += 1
        fs, draft = self._fs(f"{self.root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        _, path = self._fs(f"{self.root}/versions/{manifest.version}")
        if not fs.rename(draft, path):
            raise RuntimeError(f"{self.root} has two writers: version {manifest.version} is there already")
        _, old = self._fs(f"{self.root}/versions/{manifest.version - KEEP_VERSIONS}")
        fs.delete(old, False)

    # --- tables --------------------------------------------------------------

    @staticmethod
    def _table_name(folder: str) -> str:
        return "graph_marks_" + folder.rsplit("/", 1)[-1].replace("-", "_")

    def _save(self, kind: str, marks: DataFrame, buckets: int, level: Level) -> DataFrame:
        """Store marks in buckets, one file each, under a name of their own."""
        keys = BUCKETED_BY[kind]
        folder = f"{self.root}/tables/{kind}-{uuid.uuid4().hex}"
        (
            marks.repartition(buckets, *keys)
            .write.bucketBy(buckets, *keys).sortBy(*keys)
            .format("parquet").option("path", folder).saveAsTable(self._table_name(folder))
        )
        level.tables[kind], level.schemas[kind] = folder, marks.schema.toDDL()
        return self._read(kind, level, buckets)

    def _read(self, kind: str, level: Level, buckets: int) -> DataFrame:
        folder = level.tables[kind]
        if folder not in self._tables:
            self._tables[folder] = self._open(kind, level, buckets)
        return self._tables[folder]

    def _open(self, kind: str, level: Level, buckets: int) -> DataFrame:
        name = self._table_name(level.tables[kind])
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            self.spark.sql(
                f"create table {name} ({level.schemas[kind]}) using parquet "
                f"clustered by ({', '.join(BUCKETED_BY[kind])}) into {buckets} buckets "
                f"location '{level.tables[kind]}'"
            )
        return self.spark.table(name)

    def _merged(self, manifest: Manifest, kind: str, levels: list[Level]) -> DataFrame:
        """The marks of some levels, each key once; buckets are merged where they lie.

        Every mark passes the filter. It is there to have the union made of rows:
        a columnar union, as of Spark 4.1, lines up the buckets of its inputs one after
        the other and still passes for partitioned by them.
        """
        if not levels:
            empty = self.spark.createDataFrame([], self._schemas[kind])
            return empty if kind == "vertex" else empty.withColumn("part", F.lit(0))
        marked = F.col("last_add").isNotNull() | F.col("last_rmv").isNotNull()
        return merge_marks(*[self._read(kind, level, manifest.buckets).filter(marked) for level in levels])

    # --- writing -------------------------------------------------------------

    def append(self, commands: DataFrame, delta: int) -> None:
        """Store the marks of one micro-batch; storing it again replaces it.

        Commands below the key up to which the store has been settled come too
        late and are left out.
        """
        manifest = self.manifest()
        self._stage(manifest, commands, delta)
        self._commit(manifest)

    def _stage(self, manifest: Manifest, commands: DataFrame, delta: int) -> None:
        """Store the marks of some commands and name them in a manifest."""
        manifest.deltas.pop(delta, None)
        if manifest.settled is not None:
            commands = commands.filter(F.col(order_key(self.mode)) >= manifest.settled)
        if "ts" not in commands.columns:
            commands = commands.withColumn("ts", F.lit(None))
        commands = commands.withColumn("ts", F.col("ts").cast(self.ts_type))
        state, level = manifest.levels(), Level({}, {})
        vertices = self._save("vertex", vertex_marks(commands, self.mode), manifest.buckets, level)
        known = self._merged(manifest, "vertex", state)
        edges = self._carrying(edge_marks(commands, self.mode), known, vertices)
        taken = self._taken_along(manifest, state, removals_from_marks(vertices))
        marks = merge_marks(edges, taken).withColumn("part", _part("edge"))
        edges = self._save("edge", marks, manifest.buckets, level)
        self._save("mirror", edges.withColumn("part", _part("mirror")), manifest.buckets, level)
        changed = self._change(edges, self._merged(manifest, "edge", state), ["part", *EDGE_KEY]).unionByName(
            self._change(vertices, known, ["id"]))
        by_kind = {r["id"]: r["n"] for r in changed.collect()}  # a row each
        level.n_edges, level.n_vertices = by_kind["part"] or 0, by_kind["id"] or 0
        manifest.deltas[delta] = level

    def append_steps(self, steps: list[DataFrame | int], number: int) -> list[int | None]:
        """Store a micro-batch of several steps, whole or not at all: commands, and
        moments (epoch millis) at which to go on from the saved graph nearest to them.

        The moments of the graphs chosen, None where nothing has been saved. Storing
        the micro-batch again first takes back what it did. Deltas are numbered through.
        """
        manifest = self.manifest()
        if manifest.number == number and manifest.before is not None:
            version, manifest = manifest.version, Manifest.from_json(manifest.before)
            manifest.version = version
        manifest.before = None
        before, chosen = manifest.to_json(), []
        for step in steps:
            if isinstance(step, DataFrame):
                following = max([*manifest.deltas, *manifest.bases, manifest.pruned], default=-1) + 1
                self._stage(manifest, step, following)
            else:
                chosen.append(self._go_on_from(manifest, step))
        manifest.number, manifest.before = number, before
        self._commit(manifest)
        return chosen

    def save(self, at_millis: int) -> None:
        """Note the graph as it is now under a moment; a moment noted again replaces
        only itself."""
        manifest = self.manifest()
        manifest.saved[at_millis] = manifest.levels()
        self._commit(manifest)

    def _go_on_from(self, manifest: Manifest, at_millis: int) -> int | None:
        """Make the saved graph nearest to a moment, the earlier of two, the current one."""
        nearest = min(manifest.saved, key=lambda at: (abs(at - at_millis), at), default=None)
        if nearest is not None:
            manifest.pruned = max([*manifest.deltas, *manifest.bases, manifest.pruned])
            manifest.start, manifest.bases, manifest.deltas = manifest.saved[nearest], {}, {}
        return nearest

    def graph_saved(self, at_millis: int) -> Graph | None:
        """The saved graph nearest to a moment; None if nothing is saved."""
        manifest = self.manifest()
        if self._go_on_from(manifest, at_millis) is None:
            return None
        return self._graph(self._merged(manifest, "edge", manifest.start),
                           self._merged(manifest, "vertex", manifest.start))

    def _carrying(self, edges: DataFrame, known: DataFrame, vertices: DataFrame) -> DataFrame:
        """A micro-batch's edge marks with all removals known of their endpoints."""
        removals = removals_from_marks(merge_marks(known, vertices))
        checked = with_endpoint_removals(edges, removals)
        return checked.select(*[
            F.greatest("last_rmv", "src_rmv", "dst_rmv").alias(c) if c == "last_rmv" else F.col(c)
            for c in edges.columns
        ])

    def _taken_along(self, manifest: Manifest, state: list[Level], removals: DataFrame) -> DataFrame:
        """Removal marks for the living edges at removed vertices. The removals go to
        all parts of their vertex, so the edges stay where they are."""
        found = []
        for kind, end in (("edge", "src"), ("mirror", "dst")):
            marks = self._merged(manifest, kind, state)
            alive = marks.filter(self._alive(F.col("last_add"), F.col("last_rmv")))
            there = removals.select(
                F.col("id").alias(end), "removed_at",
                F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
            hit = alive.join(there, [end, "part"]).filter(
                ~outlives(F.col("last_add"), F.col("removed_at"), self.mode))
            found.append(hit.select(*EDGE_KEY, F.col("removed_at").alias("last_rmv")))
        both = found[0].unionByName(found[1])
        columns = self.spark.createDataFrame([], self._schemas["edge"]).schema
        return both.select(*[
            F.col(c.name) if c.name in both.columns
            else F.lit(None).cast(marks.schema[c.name].dataType).alias(c.name) for c in columns])

    def _alive(self, added: Column, removed: Column) -> Column:
        return F.coalesce(outlives(added, removed, self.mode), F.lit(False))

    def _change(self, new: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
        """By how much the keys of a micro-batch change the number alive, in one row."""
        old = known.select(*key, F.col("last_add").alias("old_add"), F.col("last_rmv").alias("old_rmv"))
        both = new.join(old, key, "left")
        before = self._alive(F.col("old_add"), F.col("old_rmv"))
        after = self._alive(F.greatest("last_add", "old_add"), F.greatest("last_rmv", "old_rmv"))
        return both.agg(F.sum(after.cast("long") - before.cast("long")).alias("n")).select(
            F.lit(key[0]).alias("id"), "n")

    def totals(self, upto: int | None = None) -> tuple[int, int]:
        """How many edges and vertices there are, from what is kept."""
        levels = self.manifest().levels(upto)
        return sum(x.n_edges for x in levels), sum(x.n_vertices for x in levels)

    def counts_within(self, commands: DataFrame, delta: int, batches: DataFrame) -> DataFrame:
        """``batch_id, n_edges, n_vertices`` after each of the ``batches`` (``batch_id``, all
        later than what was stored before) of a micro-batch whose commands have just
        been appended.

        The keys that the micro-batch touched are those of its tables. Those of them
        that lived before it take part as if added then, and what follows is counted on
        from the totals kept: no more of the state is looked at.
        """
        if self.mode != BATCH:
            raise ValueError("counts within a micro-batch are those of the batch mode")
        manifest = self.manifest()
        state, level = manifest.levels(delta - 1), manifest.deltas[delta]
        lived = []
        for kind, key in (("edge", ["part", *EDGE_KEY]), ("vertex", ["id"])):
            touched = self._read(kind, level, manifest.buckets).select(*key)
            known = self._merged(manifest, kind, state).join(touched, key, "left_semi")
            lived.append(known.filter(self._alive(F.col("last_add"), F.col("last_rmv"))))
        none = F.lit(None)
        columns = ["batch_id", "op", *EDGE_KEY]
        rows = commands.select(*columns).unionByName(
            lived[0].select(F.col("last_add").alias("batch_id"), F.lit(ADD_EDGE).alias("op"), *EDGE_KEY)
        ).unionByName(lived[1].select(
            F.col("last_add").alias("batch_id"), F.lit(ADD_NODE).alias("op"), F.col("id").alias("src"),
            none.cast("string").alias("attr"), none.cast("bigint").alias("dst")))
        sums = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_edges", "n_vertices")]
        changes = batches.join(count_changes(rows), "batch_id", "left").groupBy("batch_id").agg(*sums)
        before = [sum(getattr(x, n) for x in state) for n in ("n_edges", "n_vertices")]
        return running_totals(changes, "batch_id", ["n_edges", "n_vertices"]).select(
            "batch_id", *[(F.col(n) + F.lit(b).cast("long")).alias(n) for n, b in zip(("n_edges", "n_vertices"), before)])

    def compact(
        self,
        upto: int,
        settled: int | None = None,
        as_of: Column | None = None,
        ttl_seconds: int | None = None,
    ) -> None:
        """Merge all marks up to a micro-batch into a new base.

        The new base counts only once the manifest names it, so readers and a
        failing compaction do no harm. With ``as_of``, a moment the stream's watermark
        has passed, edges not added for ``ttl_seconds`` before it are left out.
        ``settled`` is an order key below which no command will come any more: then
        edges that are gone for good, and removals no stored edge can be older
        than, need not be kept, and later commands below it are refused.
        """
        manifest = self.manifest()
        if upto in manifest.bases:
            return
        if settled is not None:
            settled = max(settled, manifest.settled or settled)
        else:
            settled = manifest.settled
        state, level = manifest.levels(upto), Level({}, {})
        edges = self._merged(manifest, "edge", state)
        vertices = self._merged(manifest, "vertex", state)
        if as_of is not None:
            # its removal may still meet a late addition
            aged = F.coalesce(expired(F.col("last_add_ts"), ttl_seconds, as_of), F.lit(False))
            edges = edges.select(*[
                F.when(~aged, F.col(c)).alias(c) if c.startswith("last_add") else F.col(c)
                for c in edges.columns
            ]).filter("last_add is not null or last_rmv is not null")
        if settled is not None:
            for_good = F.coalesce(F.greatest("last_add", "last_rmv") < settled, F.lit(False))
            gone = for_good & ~self._alive(F.col("last_add"), F.col("last_rmv"))
            edges, vertices = edges.filter(~gone), vertices.filter(~gone)
        edges = self._save("edge", edges, manifest.buckets, level)
        self._save("mirror", edges.withColumn("part", _part("mirror")), manifest.buckets, level)
        self._save("vertex", vertices, manifest.buckets, level)
        if as_of is None:
            level.n_edges, level.n_vertices = (
                sum(getattr(x, n) for x in state) for n in ("n_edges", "n_vertices"))
        else:
            alive = self._alive(F.col("last_add"), F.col("last_rmv"))
            level.n_edges = edges.filter(alive).count()
            level.n_vertices = sum(x.n_vertices for x in state)
        manifest.bases[upto] = level
        manifest.settled = settled
        self._commit(manifest)

    def prune(self, keep_bases: int | None = None) -> list[int]:
        """Delete the deltas that the newest base already holds, all but the newest
        ``keep_bases`` bases, and tables that were never named.

        Views up to an earlier micro-batch are then limited to stored bases. What
        is deleted leaves the manifest first.
        """
        manifest = self.manifest()
        newest = manifest.base()
        if newest is None:
            return []
        done = sorted(n for n in manifest.deltas if n <= newest)
        old = sorted(manifest.bases)[:-keep_bases] if keep_bases is not None else []
        for n in done:
            del manifest.deltas[n]
        for n in old:
            del manifest.bases[n]
        manifest.pruned = max(manifest.pruned, newest)
        self._commit(manifest)
        kept = {folder.rsplit("/", 1)[-1] for folder in manifest.folders()}
        for name in self._names("tables"):
            if name not in kept:
                self._tables.pop(f"{self.root}/tables/{name}", None)
                self.spark.sql(f"drop table if exists {self._table_name(name)}")
                fs, path = self._fs(f"{self.root}/tables/{name}")
                fs.delete(path, True)
        return done

    # --- reading -------------------------------------------------------------

    def deltas(self) -> list[int]:
        """Micro-batches stored on their own."""
        return sorted(self.manifest().deltas)

    def marks(self, kind: str, upto: int | None = None) -> DataFrame:
        """Merged marks, of all micro-batches or those up to a given one.

        Raises if marks up to ``upto`` have been pruned and no base stands for them.
        """
        manifest = self.manifest()
        if upto is not None and upto < manifest.pruned and manifest.base(upto) != upto:
            raise ValueError(
                f"the marks up to micro-batch {upto} have been pruned; bases: {sorted(manifest.bases)}")
        # order keys are longs, or wider where lines order a batch
        return self._merged(manifest, kind, manifest.levels(upto)).drop("part")

    def graph(
        self,
        upto: int | None = None,
        as_of: Column | None = None,
        ttl_seconds: int | None = None,
    ) -> Graph:
        """The graph of all micro-batches, or of those up to a given one; with
        ``as_of``, less the edges not added for ``ttl_seconds`` before it."""
        edges = self.marks("edge", upto)
        if as_of is not None:
            edges = edges.filter(~expired(F.col("last_add_ts"), ttl_seconds, as_of))
        return self._graph(edges, self.marks("vertex", upto))

    def _graph(self, edges: DataFrame, vertices: DataFrame) -> Graph:
        edges = edges.filter(self._alive(F.col("last_add"), F.col("last_rmv")))
        vertices = alive_vertices(vertices, self.mode).select(
            "id", F.lit(DEFAULT_VERTEX_ATTR).cast("long").alias("attr"))
        return Graph(vertices, edges.select("src", "dst", "attr"))
