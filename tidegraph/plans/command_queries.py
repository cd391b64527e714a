"""Queries on command lines and on reducing commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.model import RMV_EDGE, RMV_NODE
from tidegraph.operators import generate, marks, reduction
from tidegraph.operators.graph import endpoints, edges_of
from tidegraph.plans.catalog import query
from tidegraph.plans.sql import AS_OF, COMMANDS, ctes, graph, net_effect
from tidegraph.sources import commands as lines_in
from tidegraph.sources.tables import event_commands, table

_COMMAND_COLS = ["op", "src", "attr", "dst"]
_SHARDS = 4


def _event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as text lines: good ones, padded, short, misspelt and unknown."""
    kind = F.col("event_type")
    page = F.regexp_extract("props", r"(\d+)", 1)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(kind == "click", F.concat_ws(" ", F.lit("addEdge"), "user_id", kind, page))
        .when(
            kind == "view",
            F.concat(F.lit("  rmvEdge "), F.col("user_id"), F.lit(" click "), page, F.lit(" \n")),
        )
        .when(kind == "purchase", F.concat_ws(" ", F.lit("addEdge"), "user_id", kind))
        .when(kind == "signup", F.concat_ws(" ", F.lit("addNode"), "props"))
        .when(F.col("event_id") % 10 == 0, F.concat(F.lit("rmvNode "), F.col("user_id")))
        .when(F.col("event_id") % 10 == 1, F.lit(" "))
        .otherwise(F.concat_ws(" ", kind, "user_id"))
        .alias("value"),
    )


_LINES = r"""lines as (
  select event_id as seq,
    case when event_type = 'click'
         then 'addEdge ' || user_id || ' click ' || regexp_extract(props, '(\d+)', 1)
         when event_type = 'view'
         then '  rmvEdge ' || user_id || ' click ' || regexp_extract(props, '(\d+)', 1) || ' ' || chr(10)
         when event_type = 'purchase' then 'addEdge ' || user_id || ' purchase'
         when event_type = 'signup' then 'addNode ' || props
         when event_id % 10 = 0 then 'rmvNode ' || user_id
         when event_id % 10 = 1 then ' '
         else event_type || ' ' || user_id end as value
  from events),
trimmed as (select seq, value, trim(value, ' ' || chr(10)) as line from lines),
tokens as (select seq, value, line, string_split(line, ' ') as t from trimmed where line <> ''),
parsed as (
  select seq, t[1] as op, try_cast(t[2] as bigint) as src,
    case when t[1] in ('addEdge', 'rmvEdge') then t[3] end as attr,
    case when t[1] in ('addEdge', 'rmvEdge') then try_cast(t[4] as bigint) end as dst,
    case when t[1] not in ('addEdge', 'rmvEdge', 'addNode', 'rmvNode') then 'unknown command'
         when len(t) < case when t[1] in ('addEdge', 'rmvEdge') then 4 else 2 end then 'too short'
         when try_cast(t[2] as bigint) is null
           or (t[1] in ('addEdge', 'rmvEdge') and try_cast(t[4] as bigint) is null)
         then 'bad number' end as error
  from tokens)"""


@query(ctes(_LINES) + "select seq, op, src, attr, dst from parsed where error is null")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_in.parse_commands(_event_lines(spark, sf_dir), mode="drop").select("seq", *_COMMAND_COLS)


@query(
    ctes(_LINES)
    + "select error, op, cast(count(*) as bigint) as n from parsed where error is not null group by error, op"
)
def quarantined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_in.parse_commands(_event_lines(spark, sf_dir), mode="quarantine")
    return (
        rows.filter(F.col("_error").isNotNull())
        .groupBy(F.col("_error").alias("error"), "op")
        .agg(F.count("*").alias("n"))
    )


@query(ctes(_LINES) + "select seq, line as value from trimmed where line <> ''")
def normalise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_in.normalise_lines(_event_lines(spark, sf_dir))


@query(
    ctes(COMMANDS)
    + """select seq, op || ' ' || src || case when op in ('addEdge', 'rmvEdge')
    then ' ' || attr || ' ' || dst else '' end as value from commands"""
)
def format_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_in.format_commands(event_commands(spark, sf_dir)).select("seq", "value")


@query(
    ctes(COMMANDS)
    + "select seq, op, src, attr, dst from commands where op in ('rmvEdge', 'rmvNode')"
)
def removal_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_in.only(event_commands(spark, sf_dir), RMV_EDGE, RMV_NODE).select(
        "seq", *_COMMAND_COLS
    )


def _framed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands with frame lines among them, five thousand events per file."""
    seq = F.col("seq")
    pieces = F.array(
        F.when(
            seq % 40 == 0,
            F.concat_ws(" ", F.lit("FILE_INFO"), seq % 7, F.expr("seq div 40 % 5")),
        ),
        F.col("value"),
        F.when(seq % 40 == 31, F.lit("END_OF_FILE")),
        F.when(seq % 120 == 31, F.lit("END_OF_FILE")),
    )
    rows = lines_in.format_commands(event_commands(spark, sf_dir))
    return (
        rows.select("seq", F.expr("seq div 5000").alias("file"), F.posexplode(pieces).alias("i", "value"))
        .filter(F.col("value").isNotNull())
        .select("file", (F.col("seq") * 4 + F.col("i")).alias("line_no"), "value")
    )


@query(
    ctes(
        COMMANDS,
        """texts as (
  select seq, seq // 5000 as file, op || ' ' || src || case when op in ('addEdge', 'rmvEdge')
    then ' ' || attr || ' ' || dst else '' end as value from commands),
lines as (
  select file, seq * 4 as line_no, 'FILE_INFO ' || seq % 7 || ' ' || seq // 40 % 5 as value
  from texts where seq % 40 = 0
  union all select file, seq * 4 + 1, value from texts
  union all select file, seq * 4 + 2, 'END_OF_FILE' from texts where seq % 40 = 31
  union all select file, seq * 4 + 3, 'END_OF_FILE' from texts where seq % 120 = 31),
numbered as (
  select *, coalesce(sum((value = 'END_OF_FILE')::int) over (
      partition by file order by line_no rows between unbounded preceding and 1 preceding), 0) as frame,
    sum((value = 'END_OF_FILE')::int) over (partition by file) as frames
  from lines),
framed as (select * from numbered where frame < frames),
headers as (
  select file, frame, arg_max(value, line_no) as header from framed
  where value like 'FILE_INFO %' group by file, frame),
frames as (
  select f.file, f.frame,
    coalesce(max(cast(string_split(h.header, ' ')[2] as bigint)), 0) as frame_id,
    coalesce(max(cast(string_split(h.header, ' ')[3] as bigint)), 0) as frame_batch
  from framed f left join headers h on f.file = h.file and f.frame = h.frame
  where f.value like 'add%' or f.value like 'rmv%' group by f.file, f.frame),
ranked as (
  select *, row_number() over (order by frame_batch, frame_id, file, frame) as batch_id from frames)""",
    )
    + """select f.line_no as seq, r.batch_id, r.frame_batch, r.frame_id, f.file,
  cast(f.frame as bigint) as frame, f.value as line
from framed f join ranked r on f.file = r.file and f.frame = r.frame
where f.value like 'add%' or f.value like 'rmv%'"""
)
def framed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines_in.read_frames_as_batches(_framed_lines(spark, sf_dir), section_lines=4096)
    return lines_in.format_commands(rows).select(
        "seq", "batch_id", "frame_batch", "frame_id", "file", "frame", F.col("value").alias("line")
    )


# --- reduction ---------------------------------------------------------------


@query(ctes(COMMANDS, net_effect("commands", ["batch_id"])) + "select * from reduced")
def net_effect_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.net_effect(event_commands(spark, sf_dir)).select("batch_id", *_COMMAND_COLS)


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def graph_of_reduced_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = reduction.net_effect(event_commands(spark, sf_dir))
    return marks.build_graph(reduced, "batch").edges


@query(ctes(COMMANDS) + "select distinct batch_id, op, src, attr, dst from commands")
def dedup_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_commands(spark, sf_dir).select("batch_id", *_COMMAND_COLS)
    return reduction.dedup_commands(rows)


_ROUTED = f"""routed as (
  select *, cast(src % {_SHARDS} as int) as shard from commands where op <> 'rmvNode'
  union all
  select c.*, cast(s.range as int) as shard from commands c, range({_SHARDS}) s where op = 'rmvNode')"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.route_to_shards(event_commands(spark, sf_dir), _SHARDS)


def _reduced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.net_effect(_routed(spark, sf_dir), ("batch_id", "shard"))


@query(ctes(COMMANDS, _ROUTED) + "select seq, shard, op, src from routed")
def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("seq", "shard", "op", "src")


@query(
    ctes(COMMANDS, _ROUTED, net_effect("routed", ["batch_id", "shard"]))
    + "select distinct batch_id, op, src, attr, dst from reduced"
)
def combined_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.combine_shards(_reduced_shards(spark, sf_dir)).select(
        "batch_id", *_COMMAND_COLS
    )


@query(ctes(COMMANDS, graph("ordered")) + "select src, dst, attr from edges")
def graph_of_combined_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = reduction.combine_shards(_reduced_shards(spark, sf_dir))
    return marks.build_graph(combined, "batch").edges


@query(
    ctes(COMMANDS, _ROUTED, net_effect("routed", ["batch_id", "shard"]))
    + "select batch_id, shard, cast(count(*) as bigint) as n from reduced group by batch_id, shard"
)
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.shard_counts(_reduced_shards(spark, sf_dir))


@query(
    ctes(
        COMMANDS,
        _ROUTED,
        f"""announced as (
  select batch_id, count(*) as announced, count(distinct shard) as shards_seen
  from routed group by batch_id),
received as (
  select batch_id, count(*) as received from routed where ts <= timestamp '{AS_OF}' group by batch_id)""",
    )
    + f"""select a.batch_id, cast(announced as bigint) as announced, cast(shards_seen as bigint) as shards_seen,
  cast(coalesce(received, 0) as bigint) as received,
  shards_seen = {_SHARDS} and announced = coalesce(received, 0) as complete
from announced a left join received r on a.batch_id = r.batch_id"""
)
def batch_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir)
    received = routed.filter(F.col("ts") <= F.expr(f"TIMESTAMP_NTZ '{AS_OF}'"))
    return reduction.batch_completeness(reduction.shard_counts(routed), received, _SHARDS)


@query(
    ctes(COMMANDS)
    + """select src as id from commands where op = 'addEdge'
union all select dst from commands where op = 'addEdge'"""
)
def implicit_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return endpoints(edges_of(event_commands(spark, sf_dir), "addEdge"))


@query(
    ctes(COMMANDS)
    + "select batch_id, op, cast(count(*) as bigint) as n from commands group by batch_id, op"
)
def command_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.command_counts(event_commands(spark, sf_dir))


@query(
    ctes(
        COMMANDS,
        net_effect("commands", ["batch_id"]),
        """before as (select batch_id, count(*) as n from commands group by batch_id),
after as (select batch_id, count(*) as n from reduced group by batch_id)""",
    )
    + """select b.batch_id, cast(b.n as bigint) as n_raw, cast(a.n as bigint) as n_reduced,
  a.n / b.n as ratio from before b join after a on a.batch_id = b.batch_id"""
)
def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = event_commands(spark, sf_dir)
    return reduction.reduction_ratio(commands, reduction.net_effect(commands))


# --- generators --------------------------------------------------------------


def _mix(name: str, profile: generate.Profile):
    shares = ", ".join(
        f"('{op}', {share:.2f}::double, true)"
        for op, share in (
            ("addEdge", profile.add_edge),
            ("addNode", profile.add_node),
            ("rmvEdge", profile.rmv_edge),
            ("rmvNode", profile.rmv_node),
        )
    )

    def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
        drawn = generate.random_commands(table(spark, sf_dir, "events"), "event_id", profile)
        return generate.mix_report(drawn, profile, tolerance=0.02)

    mix.__name__ = name
    return query(f"select * from (values {shares}) v(op, expected, within)")(mix)


generated_churn_mix = _mix("generated_churn_mix", generate.CHURN)
generated_growth_mix = _mix("generated_growth_mix", generate.GROWTH)
generated_tiny_mix = _mix("generated_tiny_mix", generate.TINY)


@query(
    f"""select event_id // 1000 as batch_id, cast(count(*) as bigint) as n, true as in_range
from events group by event_id // 1000"""
)
def generated_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = generate.random_commands(
        table(spark, sf_dir, "events"), "event_id", generate.CHURN, batch_size=1000
    )
    fits = F.col("src").between(0, generate.CHURN.ids - 1) & F.coalesce(
        F.col("dst").between(0, generate.CHURN.ids - 1), F.lit(True)
    )
    return drawn.groupBy("batch_id").agg(
        F.count("*").alias("n"), F.bool_and(fits).alias("in_range")
    )
