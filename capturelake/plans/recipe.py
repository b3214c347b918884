"""Recipes: steps that highlight, show, hide and name parts of a graph or sessions, with a record of what each step did."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake.operators.algorithms import _cut
from capturelake.plans.predicates import Condition, match

VERBS = ("highlight", "select", "show_only", "hide", "tag", "color", "cluster", "save_as_set")


@dataclass
class Step:
    verb: str
    target: str = "nodes"
    conditions: list[Condition] = field(default_factory=list)
    logic: str = "AND"
    scope: str = "visible"
    group: str = ""
    from_group: tuple[str, str] | None = None
    enabled: bool = True


@dataclass
class Record:
    """What a step did. ``matches``: ids that meet its conditions; ``effective``: those that were visible then, or all sessions; ``removed_nodes`` and
    ``removed_edges``: ids that it hid. ``nodes`` and ``edges``: ids to highlight, for sessions their addresses and pairs. All are frames of one column id;
    ``searched`` is the frame that was looked through."""

    step: int
    verb: str
    target: str
    searched: DataFrame
    matches: DataFrame
    effective: DataFrame
    removed_nodes: DataFrame
    removed_edges: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    group: str = ""


@dataclass
class Pending:
    """A step of global scope, to be applied to views made later."""

    step: int
    verb: str
    target: str
    matches: DataFrame


@dataclass
class Outcome:
    nodes: DataFrame
    edges: DataFrame
    groups: dict[tuple[str, str], tuple[str, DataFrame]]
    sets: dict[str, DataFrame]
    warnings: list[str]
    highlighted: list[DataFrame]
    records: list[Record] = field(default_factory=list)
    pending: list[Pending] = field(default_factory=list)


def run(nodes: DataFrame, edges: DataFrame, steps: list[Step], sets: dict[str, DataFrame] | None = None, sessions: DataFrame | None = None) -> Outcome:
    """Applies the steps in order. Nodes have id, edges id, src, dst; both results have a boolean visible.

    Steps on ``sessions(id, src_ip, dst_ip, ...)`` change no visibility: without conditions they match all, highlights are their addresses
    and pairs, and groups have their ids. ``records`` and ``pending`` tell what each step did and which apply to later views.
    """
    # every step looks through both, so the graph is made once
    n, e = _cut(nodes.withColumn("visible", F.lit(True))), _cut(edges.withColumn("visible", F.lit(True)))
    out = Outcome(n, e, {}, dict(sets or {}), [], [])
    for number, step in enumerate(steps):
        if not step.enabled:
            continue
        if step.verb not in VERBS:
            out.warnings.append(f"step {number}: unknown verb {step.verb!r}")
            continue
        target, scoped = step.target, None
        if step.from_group:
            known = out.groups.get(step.from_group)
            if known is None:
                out.warnings.append(f"step {number}: no group {step.from_group}")
                continue
            target, scoped = known
        if target == "sessions":
            if sessions is None:
                out.warnings.append(f"step {number}: no sessions")
                continue
            _on_sessions(out, number, step, sessions, scoped)
            continue
        before_nodes, before_edges = out.nodes, out.edges
        items = (out.nodes if target == "nodes" else out.edges)
        found = match(items, step.conditions, step.logic, out.sets, empty=scoped is not None)
        if scoped is not None:
            found = found.join(scoped.select(F.col("member").alias("id")), "id", "left_semi")
        ids = _cut(found.select(F.col("id").alias("_id"), F.col("visible").alias("_seen")).distinct())
        seen = ids.where("_seen").select("_id")
        if step.verb in ("highlight", "select"):
            out.highlighted.append(seen)
        elif step.verb == "save_as_set":
            out.sets[step.group] = ids.select(F.col("_id").alias("member"))
        elif step.verb in ("tag", "color", "cluster"):
            out.groups[step.verb, step.group] = (target, seen.select(F.col("_id").alias("member")))
        elif step.verb == "show_only":
            _show_only(out, target, ids.select("_id") if step.scope == "global" else seen, step.scope == "global")
        else:
            _hide(out, target, seen)
        matches, effective = ids.select(F.col("_id").alias("id")), seen.select(F.col("_id").alias("id"))
        gone = [_shown(b).join(_shown(a), "id", "left_anti") for b, a in ((before_nodes, out.nodes), (before_edges, out.edges))]
        out.records.append(Record(number, step.verb, target, items, matches, effective, *gone, group=step.group))
        if step.scope == "global" and step.verb in ("hide", "show_only"):
            out.pending.append(Pending(number, step.verb, target, matches))
    return out


def _shown(items: DataFrame) -> DataFrame:
    return items.where("visible").select("id")


def _on_sessions(out: Outcome, number: int, step: Step, sessions: DataFrame, scoped: DataFrame | None) -> None:
    """Matches, highlights and groups of a step on sessions; a group's members limit the match."""
    found = match(sessions, step.conditions, step.logic, out.sets, empty=True)
    if scoped is not None:
        found = found.join(scoped.select(F.col("member").alias("id")), "id", "left_semi")
    found = _cut(found.select("id", "src_ip", "dst_ip"))
    ids = found.select("id").distinct()
    nodes = found.select(F.explode(F.array("src_ip", "dst_ip")).alias("id")).where("id <> ''").distinct()
    pairs = found.where("src_ip <> '' and dst_ip <> ''").select(F.concat_ws("|", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")).alias("id")).distinct()
    if step.verb == "highlight":
        out.highlighted += [nodes.withColumnRenamed("id", "_id"), pairs.withColumnRenamed("id", "_id")]
    elif step.verb in ("tag", "color", "cluster", "save_as_set") and step.group:
        kind = "set" if step.verb == "save_as_set" else step.verb
        out.groups[kind, step.group] = ("sessions", ids.withColumnRenamed("id", "member"))
    nothing = ids.limit(0)
    out.records.append(Record(number, step.verb, "sessions", sessions, ids, ids, nothing, nothing, nodes, pairs, step.group))


def _mark(items: DataFrame, ids: DataFrame, keep: bool, everything: bool = False) -> DataFrame:
    """visible: and in (keep) or not in ``ids``; ``everything`` forgets what was hidden before."""
    hit = ids.withColumn("_hit", F.lit(True))
    joined = items.join(hit, F.col("id") == F.col("_id"), "left")
    inside = F.coalesce("_hit", F.lit(False))
    inside = inside if keep else ~inside
    now = inside if everything else F.col("visible") & inside
    return joined.withColumn("visible", now).drop("_id", "_hit")


def _ends_visible(out: Outcome, before: DataFrame) -> DataFrame:
    shown = out.nodes.where("visible").select("id")
    inside = before.join(shown.withColumnRenamed("id", "src"), "src", "left_semi").join(shown.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("id").alias("_id"))
    return _mark(before, inside, keep=True)


def _show_only(out: Outcome, target: str, ids: DataFrame, everything: bool) -> None:
    if target == "nodes":
        out.nodes = _cut(_mark(out.nodes, ids, True, everything))
        edges = out.edges.withColumn("visible", F.lit(True)) if everything else out.edges
        out.edges = _cut(_ends_visible(out, edges))
    else:
        out.edges = _cut(_mark(out.edges, ids, True, everything))
        if everything:
            out.nodes = out.nodes.withColumn("visible", F.lit(True))


def _hide(out: Outcome, target: str, ids: DataFrame) -> None:
    if target == "nodes":
        out.nodes = _cut(_mark(out.nodes, ids, False))
        out.edges = _cut(_ends_visible(out, out.edges))
        return
    # ends of hidden edges that no visible edge holds are hidden too; nodes that never had one stay
    touched = out.edges.join(ids.withColumnRenamed("_id", "id"), "id", "left_semi").select(F.explode(F.array("src", "dst")).alias("_id")).distinct()
    out.edges = _cut(_mark(out.edges, ids, False))
    held = out.edges.where("visible").select(F.explode(F.array("src", "dst")).alias("_id")).distinct()
    out.nodes = _cut(_mark(out.nodes, touched.join(held, "_id", "left_anti"), False))
