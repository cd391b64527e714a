"""Queries on graphs: building, changing, counting and comparing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import ADD_EDGE, ADD_NODE, RMV_EDGE, RMV_NODE, Graph, empty_graph
from tidegraph.operators import compare, marks, series
from tidegraph.operators import graph as ops
from tidegraph.operators.temporal import graph_as_of_time
from tidegraph.plans.catalog import ORACLES, query
from tidegraph.plans.sql import AS_OF, COMMANDS, before, ctes, graph, kept_edges, kept_vertices
from tidegraph.plans.time_queries import scratch_folder
from tidegraph.sources import digests
from tidegraph.sources.tables import event_commands

_AT = f"TIMESTAMP_NTZ '{AS_OF}'"
_ADDED = "added as (select src, dst, attr from commands where op = 'addEdge')"
_LISTED = "listed as (select src as id, cast(7 as bigint) as attr from commands where op = 'addNode')"
_GONE = "gone as (select distinct src as id from commands where op = 'rmvNode')"
_CUT = "cut as (select distinct src, dst, attr from commands where op = 'rmvEdge')"


def _built(spark: SparkSession, sf_dir: str, mode: str) -> Graph:
    return marks.build_graph(event_commands(spark, sf_dir), mode)


# --- building ----------------------------------------------------------------


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def graph_edges_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "ordered").edges


@query(ctes(COMMANDS, graph("ordered")) + "select id, attr from vertices")
def graph_vertices_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "ordered").vertices


@query(ctes(COMMANDS, graph("batch")) + "select src, dst, attr from edges")
def graph_edges_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "batch").edges


@query(ctes(COMMANDS, graph("batch")) + "select src, dst, attr from edges")
def graph_edges_pruned_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = event_commands(spark, sf_dir)
    return marks.build_graph(commands, "batch", prune_early=True).edges


@query(ctes(COMMANDS, graph("batch")) + "select id, attr from vertices")
def graph_vertices_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, "batch").vertices


@query(
    ctes(COMMANDS)
    + """select src, attr, dst,
  coalesce(max(case when op = 'addEdge' then seq end), -1) as last_add,
  coalesce(max(case when op = 'rmvEdge' then seq end), -1) as last_rmv,
  max(case when op = 'addEdge' then ts end) as last_add_ts
from commands where op in ('addEdge', 'rmvEdge') group by src, attr, dst"""
)
def edge_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.explicit_never(marks.edge_marks(event_commands(spark, sf_dir), "ordered"))


_VERTEX_MARKS = """select id, coalesce(max(added), -1) as last_add, coalesce(max(removed), -1) as last_rmv
from (select src as id, case when op <> 'rmvNode' then batch_id end as added,
        case when op = 'rmvNode' then batch_id end as removed from commands where op <> 'rmvEdge'
      union all select dst, batch_id, null from commands where op = 'addEdge') group by id"""


@query(ctes(COMMANDS) + _VERTEX_MARKS)
def vertex_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.explicit_never(marks.vertex_marks(event_commands(spark, sf_dir), "batch"))


@query(ctes(COMMANDS) + _VERTEX_MARKS)
def merged_vertex_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = event_commands(spark, sf_dir)
    early = F.col("ts") <= F.expr(_AT)
    parts = [marks.vertex_marks(commands.filter(c), "batch") for c in (early, ~early)]
    return marks.explicit_never(marks.merge_marks(*parts))


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def graph_of_repeated_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = event_commands(spark, sf_dir)
    late_first = commands.filter(F.col("ts") > F.expr(_AT)).unionByName(commands)
    return marks.build_graph(late_first, "ordered").edges


# --- changing ----------------------------------------------------------------


@query(
    ctes(COMMANDS, _ADDED, _CUT)
    + """select a.* from added a where not exists (select 1 from cut c
  where c.src = a.src and c.dst = a.dst and c.attr = a.attr)"""
)
def remove_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return ops.remove_edges(ops.edges_of(c, ADD_EDGE), ops.edges_of(c, RMV_EDGE))


@query(ctes(COMMANDS, _GONE) + "select src as id from commands where op = 'addNode' and src not in (select id from gone)")
def remove_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return ops.remove_vertices(ops.nodes_of(c, ADD_NODE), ops.nodes_of(c, RMV_NODE))


@query(
    ctes(COMMANDS, _ADDED, _GONE)
    + "select * from added where src not in (select id from gone) and dst not in (select id from gone)"
)
def remove_incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return ops.remove_incident_edges(ops.edges_of(c, ADD_EDGE), ops.nodes_of(c, RMV_NODE))


@query(
    ctes(COMMANDS)
    + "select src as id from commands where op = 'addNode' union all select src from commands where op = 'rmvNode'"
)
def add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return ops.add_rows(ops.nodes_of(c, ADD_NODE), ops.nodes_of(c, RMV_NODE))


_AFTER = f"after as (select * from commands where ts > timestamp '{AS_OF}')"
_APPLIED = """applied_edges as (
  select src, dst, attr from edges e
  where not exists (select 1 from after r where r.op = 'rmvEdge' and r.src = e.src and r.dst = e.dst and r.attr = e.attr)
    and src not in (select src from after where op = 'rmvNode')
    and dst not in (select src from after where op = 'rmvNode')
  union select src, dst, attr from after where op = 'addEdge'),
applied_vertices as (
  select id, attr from vertices where id not in (select src from after where op = 'rmvNode')
  union select src, cast(1 as bigint) from after where op in ('addNode', 'addEdge')
  union select dst, cast(1 as bigint) from after where op = 'addEdge')"""


def _one_batch_later(spark: SparkSession, sf_dir: str) -> Graph:
    c = event_commands(spark, sf_dir)
    early = graph_as_of_time(c, F.expr(_AT))
    return ops.apply_batch(early, c.filter(F.col("ts") > F.expr(_AT)))


@query(
    ctes(COMMANDS, before(), graph("ordered", "before"), _AFTER, _APPLIED)
    + "select src, dst, attr from applied_edges"
)
def apply_batch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_batch_later(spark, sf_dir).edges


@query(
    ctes(COMMANDS, before(), graph("ordered", "before"), _AFTER, _APPLIED)
    + "select id, attr from applied_vertices"
)
def apply_batch_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one_batch_later(spark, sf_dir).vertices


@query(ctes(COMMANDS, _ADDED) + "select distinct src, dst, attr from added")
def batch_on_empty_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.apply_batch(empty_graph(spark), event_commands(spark, sf_dir)).edges


@query(ctes(COMMANDS, before(), graph("ordered", "before"), _AFTER, _APPLIED) + "select src, dst, attr from applied_edges")
def go_on_from_start_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    start = ops.as_start_commands(graph_as_of_time(c, F.expr(_AT)))
    later = c.filter(F.col("ts") > F.expr(_AT)).withColumn("batch_id", F.lit(1).cast("long"))
    return marks.build_graph(start.unionByName(later.select(*start.columns)), "batch").edges


@query(
    ctes(COMMANDS, _ADDED, _LISTED)
    + """select id, cast(coalesce(min(attr), 0) as bigint) as attr from (
  select id, attr from listed union all select src, null from added union all select dst, null from added) group by id"""
)
def make_graph_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    listed = ops.nodes_of(c, ADD_NODE).withColumn("attr", F.lit(7))
    return ops.make_graph(listed, ops.edges_of(c, ADD_EDGE), default_attr=0).vertices


@query(
    ctes(COMMANDS, _ADDED)
    + "select id, cast(1 as bigint) as attr from (select src as id from added union select dst from added)"
)
def graph_from_edges_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.graph_from_edges(ops.edges_of(event_commands(spark, sf_dir), ADD_EDGE)).vertices


_MIXED = """mixed as (
  select id, cast(coalesce(min(attr), 0) as bigint) as attr from (
    select id, attr from listed union all select src, null from added union all select dst, null from added)
  group by id)"""
_TRIPLETS = """triplets as (
  select a.src, s.attr as src_attr, a.dst, d.attr as dst_attr, a.attr
  from added a join mixed s on s.id = a.src join mixed d on d.id = a.dst)"""


def _mixed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    c = event_commands(spark, sf_dir)
    listed = ops.nodes_of(c, ADD_NODE).withColumn("attr", F.lit(7))
    return ops.make_graph(listed, ops.edges_of(c, ADD_EDGE), default_attr=0)


@query(ctes(COMMANDS, _ADDED, _LISTED, _MIXED, _TRIPLETS) + "select * from triplets")
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.triplets(_mixed_graph(spark, sf_dir))


@query(
    ctes(COMMANDS, _ADDED, _LISTED, _MIXED, _TRIPLETS)
    + """select src, dst, attr from triplets
where (attr <> 'click' or src_attr > dst_attr) and src >= 10 and dst >= 10"""
)
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (F.col("attr") != "click") | (F.col("src_attr") > F.col("dst_attr"))
    return ops.subgraph(_mixed_graph(spark, sf_dir), wanted, F.col("id") >= 10).edges


@query(
    ctes(COMMANDS, graph("batch"))
    + "select src, dst, string_agg(attr, ' ' order by attr) as attr from edges group by src, dst"
)
def merge_parallel_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_parallel_edges(_built(spark, sf_dir, "batch").edges)


_CANONICAL = """select cast(count(*) as bigint) as n_edges,
  cast(count(distinct case when src < dst then src || '_' || dst else dst || '_' || src end) as bigint) as n_pairs,
  cast(0 as bigint) as pairs_apart, true as in_range from edges"""


@query(ctes(COMMANDS, graph("batch")) + _CANONICAL)
def canonical_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = 12
    placed = ops.canonical_cut(_built(spark, sf_dir, "batch").edges, parts)
    pairs = placed.groupBy(F.least("src", "dst"), F.greatest("src", "dst")).agg(
        F.count("*").alias("n"),
        F.min("part_id").alias("low"),
        F.max("part_id").alias("high"),
    )
    return pairs.agg(
        F.sum("n").alias("n_edges"),
        F.count("*").alias("n_pairs"),
        F.count_if(F.col("low") != F.col("high")).alias("pairs_apart"),
        F.bool_and((F.col("low") >= 0) & (F.col("high") < parts)).alias("in_range"),
    )


@query(
    ctes(COMMANDS, graph("batch"))
    + """select cast(count(*) as bigint) as n_vertices, true as bounded from (
  select src as id from edges union select dst from edges)"""
)
def grid_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, side = 12, 4
    placed = ops.lay_out(ops.grid_cut(_built(spark, sf_dir, "batch").edges, parts), parts)
    spread = (
        placed.select(F.explode(F.array("src", "dst")).alias("id"), "part_id")
        .groupBy("id")
        .agg(F.count_distinct("part_id").alias("n"))
    )
    return spread.agg(
        F.count("*").alias("n_vertices"), F.bool_and(F.col("n") <= 2 * side).alias("bounded")
    )


# --- counting ----------------------------------------------------------------


@query(
    ctes(COMMANDS, graph("ordered"))
    + """select cast((select count(*) from edges) as bigint) as n_edges,
  cast((select count(*) from vertices) as bigint) as n_vertices"""
)
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.counts(_built(spark, sf_dir, "ordered"))


@query(
    ctes(COMMANDS, kept_edges("batch"))
    + "select src, attr, dst, cast(count(*) as bigint) as copies from kept_edges group by src, attr, dst"
)
def edge_copies_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.edge_copies(event_commands(spark, sf_dir), "batch")


@query(
    ctes(COMMANDS, kept_edges("ordered"))
    + "select src, attr, dst, cast(count(*) as bigint) as copies from kept_edges group by src, attr, dst"
)
def edge_copies_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.edge_copies(event_commands(spark, sf_dir), "ordered")


@query(
    ctes(COMMANDS, kept_vertices("batch"))
    + "select id, cast(count(*) as bigint) as copies from kept_vertices group by id"
)
def vertex_copies_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.vertex_copies(event_commands(spark, sf_dir), "batch")


@query(
    ctes(COMMANDS, kept_vertices("ordered"))
    + "select id, cast(count(*) as bigint) as copies from kept_vertices group by id"
)
def vertex_copies_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.vertex_copies(event_commands(spark, sf_dir), "ordered")


_HISTORY = """edge_ends as (
  select a.src, a.attr, a.dst, a.batch_id as started, min(r.batch_id) as ended
  from (select * from commands where op = 'addEdge') a
  left join (select * from commands where op in ('rmvEdge', 'rmvNode')) r
    on r.batch_id > a.batch_id and (
      (r.op = 'rmvEdge' and r.src = a.src and r.attr = a.attr and r.dst = a.dst)
      or (r.op = 'rmvNode' and (r.src = a.src or r.src = a.dst)))
  group by a.seq, a.src, a.attr, a.dst, a.batch_id),
vertex_adds as (
  select seq, src as id, batch_id from commands where op in ('addNode', 'addEdge')
  union all select -1 - seq, dst, batch_id from commands where op = 'addEdge'),
vertex_ends as (
  select a.id, a.batch_id as started, min(r.batch_id) as ended
  from vertex_adds a left join (select * from commands where op = 'rmvNode') r
    on r.src = a.id and r.batch_id > a.batch_id
  group by a.seq, a.id, a.batch_id),
batches as (select distinct batch_id from commands)"""


@query(
    ctes(COMMANDS, _HISTORY)
    + """select b.batch_id,
  cast((select count(distinct (src, attr, dst)) from edge_ends e
        where e.started <= b.batch_id and coalesce(e.ended > b.batch_id, true)) as bigint) as n_edges,
  cast((select count(distinct id) from vertex_ends v
        where v.started <= b.batch_id and coalesce(v.ended > b.batch_id, true)) as bigint) as n_vertices
from batches b"""
)
def count_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.count_series(event_commands(spark, sf_dir))


@query(
    ctes(COMMANDS, _HISTORY)
    + """select b.batch_id,
  cast((select count(*) from edge_ends e
        where e.started <= b.batch_id and coalesce(e.ended > b.batch_id, true)) as bigint) as n_edges,
  cast((select count(*) from vertex_ends v
        where v.started <= b.batch_id and coalesce(v.ended > b.batch_id, true)) as bigint) as n_vertices
from batches b"""
)
def count_series_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.count_series(event_commands(spark, sf_dir), copies=True)


@query(
    ctes(COMMANDS, _HISTORY)
    + """select src, attr, dst, min(started) as start, coalesce(ended, -1) as "end"
from edge_ends group by src, attr, dst, ended"""
)
def edge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.edge_intervals(event_commands(spark, sf_dir))
    return rows.withColumn("end", F.coalesce("end", F.lit(-1)))


@query(
    ctes(COMMANDS, _HISTORY)
    + """select id, min(started) as start, coalesce(ended, -1) as "end"
from vertex_ends group by id, ended"""
)
def vertex_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.vertex_intervals(event_commands(spark, sf_dir))
    return rows.withColumn("end", F.coalesce("end", F.lit(-1)))


# --- set operations and comparison -------------------------------------------

_DIFFERENCE = """select a.* from added a where not exists (
  select 1 from cut c where c.src = a.src and c.dst = a.dst and c.attr = a.attr)"""


@query(ctes(COMMANDS, _ADDED, _CUT) + _DIFFERENCE)
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return compare.bag_difference(ops.edges_of(c, ADD_EDGE), ops.edges_of(c, RMV_EDGE))


@query(
    ctes(COMMANDS)
    + "select src, dst, attr from commands where op = 'addEdge' union all select src, dst, attr from commands where op = 'rmvEdge'"
)
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return compare.union_all(ops.edges_of(c, ADD_EDGE), ops.edges_of(c, RMV_EDGE))


@query(
    ctes(COMMANDS)
    + "select src, dst, attr from commands where op = 'addEdge' intersect select src, dst, attr from commands where op = 'rmvEdge'"
)
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    return compare.intersection(ops.edges_of(c, ADD_EDGE), ops.edges_of(c, RMV_EDGE))


@query(ctes(COMMANDS, _ADDED) + "select distinct * from added")
def distinct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.edges_of(event_commands(spark, sf_dir), ADD_EDGE).distinct()


@query(ctes(COMMANDS, _ADDED, _GONE) + "select * from added where src in (select id from gone)")
def matching_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    gone = ops.nodes_of(c, RMV_NODE).select(F.col("id").alias("src"))
    return compare.matching_keys(ops.edges_of(c, ADD_EDGE), gone, "src")


@query(
    ctes(COMMANDS)
    + "select cast(batch_id as varchar) as name, cast(count(*) as bigint) as n from commands group by batch_id order by batch_id"
)
def batches_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_commands(spark, sf_dir)
    named = c.groupBy(F.col("batch_id").cast("string").alias("name")).agg(F.count("*").alias("n"))
    return compare.sort_by_batch(named, "name")


def _old_and_new(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    c = event_commands(spark, sf_dir)
    return graph_as_of_time(c, F.expr(_AT)), marks.build_graph(c, "ordered")


_TWO = ctes(
    COMMANDS, before(), graph("ordered", "before", "old_"), graph("ordered", "commands", "new_")
)
_ONLY = """
  cast((select count(*) from (select * from {0} except select * from {1})) as bigint)"""
_BOTH = """
  cast((select count(*) from (select * from {0} intersect select * from {1})) as bigint)"""
_SIZE = "cast((select count(*) from {0}) as bigint)"


@query(
    _TWO
    + "select vertex_only_left + vertex_only_right + edge_only_left + edge_only_right = 0 as equal, * from (select"
    + _ONLY.format("old_vertices", "new_vertices")
    + " as vertex_only_left,"
    + _ONLY.format("new_vertices", "old_vertices")
    + " as vertex_only_right,"
    + _ONLY.format("old_edges", "new_edges")
    + " as edge_only_left,"
    + _ONLY.format("new_edges", "old_edges")
    + " as edge_only_right)"
)
def graphs_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.graphs_equal(*_old_and_new(spark, sf_dir))


@query(
    "select true as equal, cast(0 as bigint) as vertex_only_left, cast(0 as bigint) as vertex_only_right, "
    "cast(0 as bigint) as edge_only_left, cast(0 as bigint) as edge_only_right"
)
def reduced_graph_equals_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidegraph.operators.reduction import net_effect

    c = event_commands(spark, sf_dir)
    return compare.graphs_equal(
        marks.build_graph(net_effect(c), "batch"), marks.build_graph(c, "ordered")
    )


_COUNTED = (
    "select {0} as {1}, * from (select"
    + f" {_SIZE.format('old_vertices')} as vertices_left,"
    + _BOTH.format("old_vertices", "new_vertices")
    + " as vertices_common,{2}"
    + f" {_SIZE.format('old_edges')} as edges_left,"
    + _BOTH.format("old_edges", "new_edges")
    + " as edges_common{3})"
)


@query(
    _TWO
    + _COUNTED.format(
        "vertices_left = vertices_common and vertices_left = vertices_right "
        "and edges_left = edges_common and edges_left = edges_right",
        "equal",
        f" {_SIZE.format('new_vertices')} as vertices_right,",
        f", {_SIZE.format('new_edges')} as edges_right",
    )
)
def graphs_equal_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.graphs_equal_by_counts(*_old_and_new(spark, sf_dir))


@query(
    _TWO
    + _COUNTED.format(
        "vertices_left = vertices_common and edges_left = edges_common", "contained", "", ""
    )
)
def graph_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.graph_contained(*_old_and_new(spark, sf_dir))


@query(
    _TWO
    + """select 'added' as change, * from (select * from new_vertices except select * from old_vertices)
union all select 'removed', * from (select * from old_vertices except select * from new_vertices)"""
)
def vertex_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.vertex_diff(*_old_and_new(spark, sf_dir))


@query(
    _TWO
    + """select 'added' as change, * from (select * from new_edges except select * from old_edges)
union all select 'removed', * from (select * from old_edges except select * from new_edges)"""
)
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.edge_diff(*_old_and_new(spark, sf_dir))


# --- saved graphs with digests -----------------------------------------------


def _digested(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_folder(spark, "digested")
    for at, graph_then in enumerate(_old_and_new(spark, sf_dir)):
        digests.write_digested(graph_then, root, at)
    return root


@query(
    _TWO
    + """select not exists (select * from new_edges except select * from old_edges)
  and not exists (select * from old_edges except select * from new_edges)
  and not exists (select * from new_vertices except select * from old_vertices)
  and not exists (select * from old_vertices except select * from new_vertices) as equal"""
)
def stored_graphs_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.stored_graphs_equal(spark, _digested(spark, sf_dir), 0, 1).select("equal")


@query(ORACLES["edge_diff"])
def stored_edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.stored_diff(spark, _digested(spark, sf_dir), 0, 1)
