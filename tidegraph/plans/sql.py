"""Building blocks of the checking SQL.

The SQL states what a result *is* (an edge exists if it was added and nothing
removed it afterwards), not the marks by which Spark computes it.
"""

from __future__ import annotations

# A moment in the middle of the events, and the time to live used on them.
AS_OF = "2024-01-16 00:00:00"
TTL_SECONDS = 3 * 86_400

COMMANDS = r"""commands as (
  select event_id as seq, event_id // 1000 as batch_id, ts,
    case when event_type in ('click', 'view', 'purchase') then 'addEdge'
         when event_type = 'signup' then 'addNode'
         when event_id % 10 = 0 then 'rmvNode' else 'rmvEdge' end as op,
    user_id as src,
    case when event_type in ('click', 'view', 'purchase') then event_type
         when event_type = 'error' and event_id % 10 <> 0
         then case event_id % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end
    end as attr,
    case when event_type in ('click', 'view', 'purchase')
           or (event_type = 'error' and event_id % 10 <> 0)
         then cast(regexp_extract(props, '(\d+)', 1) as bigint) end as dst
  from events)"""


def ctes(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def _later(mode: str, added: str, removed: str) -> str:
    return f"{removed}.seq > {added}.seq" if mode == "ordered" else f"{removed}.batch_id > {added}.batch_id"


def kept_edges(mode: str, source: str = "commands", name: str = "kept_edges") -> str:
    """Edge additions that no later removal undoes, copies kept."""
    later = _later(mode, "a", "r")
    return f"""{name} as (
  select a.* from {source} a where a.op = 'addEdge'
    and not exists (select 1 from {source} r where r.op = 'rmvEdge' and r.src = a.src
                    and r.attr = a.attr and r.dst = a.dst and {later})
    and not exists (select 1 from {source} r where r.op = 'rmvNode' and r.src = a.src and {later})
    and not exists (select 1 from {source} r where r.op = 'rmvNode' and r.src = a.dst and {later}))"""


def kept_vertices(mode: str, source: str = "commands", name: str = "kept_vertices") -> str:
    """Vertex additions that no later removal undoes, copies kept."""
    later = _later(mode, "a", "r")
    return f"""{name}_added as (
  select seq, batch_id, src as id from {source} where op in ('addNode', 'addEdge')
  union all
  select seq, batch_id, dst as id from {source} where op = 'addEdge'),
{name} as (
  select a.* from {name}_added a
  where not exists (select 1 from {source} r where r.op = 'rmvNode' and r.src = a.id and {later}))"""


def graph(mode: str, source: str = "commands", prefix: str = "") -> str:
    """``{prefix}edges(src, dst, attr)`` and ``{prefix}vertices(id, attr)``."""
    return ",\n".join(
        [
            kept_edges(mode, source, prefix + "kept_edges"),
            kept_vertices(mode, source, prefix + "kept_vertices"),
            f"{prefix}edges as (select distinct src, dst, attr from {prefix}kept_edges)",
            f"{prefix}vertices as (select distinct id, cast(1 as bigint) as attr from {prefix}kept_vertices)",
        ]
    )


def before(name: str = "before", source: str = "commands") -> str:
    """The commands up to the chosen moment."""
    return f"{name} as (select * from {source} where ts <= timestamp '{AS_OF}')"


def net_effect(source: str, keys: list[str], name: str = "reduced") -> str:
    """The commands of each batch that still matter at its end."""
    same = " and ".join(f"r.{k} = a.{k}" for k in keys)
    cols = ", ".join(keys)
    a_cols = ", ".join("a." + k for k in keys)
    gone = (
        f"not exists (select 1 from {source} r where r.op = 'rmvNode' and {same} "
        "and r.src = a.{end} and r.seq > a.seq)"
    )
    src_stays, dst_stays = gone.format(end="src"), gone.format(end="dst")
    opposite = (
        f"not exists (select 1 from {source} r where r.op = '{{op}}' and {same} "
        "and r.src = a.src and r.attr = a.attr and r.dst = a.dst and r.seq > a.seq)"
    )
    join = " and ".join(f"l.{k} = a.{k}" for k in keys)
    dead = (
        f"not exists (select 1 from {name}_live l where {join} "
        "and l.src = a.src and l.attr = a.attr and l.dst = a.dst)"
    )
    return f"""{name}_live as (
  select distinct {a_cols}, a.src, a.attr, a.dst from {source} a
  where a.op = 'addEdge' and {opposite.format(op='rmvEdge')} and {src_stays} and {dst_stays}),
{name} as (
  select {cols}, 'addEdge' as op, src, attr, dst from {name}_live
  union
  select {a_cols}, 'rmvEdge', a.src, a.attr, a.dst from {source} a
  where a.op = 'rmvEdge' and {opposite.format(op='addEdge')} and {src_stays} and {dst_stays}
  union
  select {cols}, 'rmvNode', src, null, null from {source} where op = 'rmvNode'
  union
  select {a_cols}, 'addNode', a.src, null, null from {source} a where a.op = 'addNode' and {src_stays}
  union
  select {a_cols}, 'addNode', a.src, null, null from {source} a
  where a.op = 'addEdge' and {dead} and {src_stays}
  union
  select {a_cols}, 'addNode', a.dst, null, null from {source} a
  where a.op = 'addEdge' and {dead} and {dst_stays})"""
