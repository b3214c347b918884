"""Graph algorithms over edge tables (a, b): components, cores, hubs, paths, clusters, centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.scratch import cut as _cut

MAX_PATHS, CUTOFF = 20, 10
#: Rows (source, node) of a block of centrality; they are written for each level's checkpoint.
STATES = 1_000_000


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst", size: str = "total_bytes") -> DataFrame:
    """(a, b, weight): a pair's bytes, where an edge without bytes counts 1."""
    w = F.when(F.coalesce(F.col(size), F.lit(0)) > 0, F.col(size)).otherwise(1)
    return edges.groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.sum(w).alias("weight"))


def directed(edges: DataFrame, src: str = "src", dst: str = "dst", size: str = "total_bytes") -> DataFrame:
    w = F.when(F.coalesce(F.col(size), F.lit(0)) > 0, F.col(size)).otherwise(1)
    return edges.groupBy(F.col(src).alias("a"), F.col(dst).alias("b")).agg(F.sum(w).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component. Large-star and small-star steps until stars are left."""
    loops = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = _cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        now = _cut(large.join(low, "u").select(pair).select("e.*").where("u <> v").distinct())
        if now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")))
    return found.union(loops.join(found, "node", "left_anti")).distinct()


def labelled(groups: DataFrame, least: int = 2) -> DataFrame:
    """(node, cluster): clusters of at least ``least`` nodes numbered from 0 by size, then least member."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where(F.col("n") >= least)
    number = (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).alias("cluster")
    return groups.join(sizes.select("component", number), "component").select("node", "cluster")


def component_summary(edges: DataFrame, most: int = 100) -> DataFrame:
    """(component, nodes, edges, packets, top) of the largest components; top: the five busiest nodes. ``edges(a, b, packets)``."""
    part = components(edges)
    by_node = edges.select(F.explode(F.array("a", "b")).alias("node"), "packets").groupBy("node").agg(F.sum("packets").alias("p"))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("p"), "node"))
    top = part.join(by_node, "node").withColumn("r", rank)
    nodes = top.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.struct("r", "node")))).alias("top"))
    sums = edges.join(part.withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("packets").alias("packets"))
    return nodes.join(sums, "component").select("component", "nodes", "edges", "packets", F.array_join(F.col("top.node"), ",").alias("top")).orderBy(F.desc("nodes"), "component").limit(most)


def core(edges: DataFrame, k: int = 3) -> DataFrame:
    """Edges (both ways) of the k-core: nodes of fewer than k neighbours are peeled until none is left."""
    now = _cut(both_ways(edges))
    while True:
        weak = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k).select("a")
        if weak.isEmpty():
            return now
        now = _cut(now.join(weak, "a", "left_anti").join(weak.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b"))


def core_clusters(edges: DataFrame, k: int = 3) -> DataFrame:
    return labelled(components(core(edges, k)))


def hubs(edges: DataFrame, least_spokes: int = 4) -> DataFrame:
    """(node, cluster): hubs with at least so many leaves (nodes of one neighbour), numbered by the hub's degree."""
    pairs = both_ways(edges)
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("hub"))
    leaves = degree.where("degree = 1").select(F.col("a").alias("node"), "hub")
    counts = leaves.groupBy("hub").agg(F.count(F.lit(1)).alias("spokes")).where(F.col("spokes") >= least_spokes)
    ranked = counts.join(degree.select(F.col("a").alias("hub"), "degree"), "hub")
    ranked = ranked.select("hub", (F.row_number().over(Window.orderBy(F.desc("degree"), "hub")) - 1).alias("cluster"))
    return leaves.join(ranked, "hub").select("node", "cluster").union(ranked.select(F.col("hub").alias("node"), "cluster"))


def equivalent(edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, cluster): nodes with one and the same set of neighbours."""
    sets = both_ways(edges).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("around"))
    return labelled(sets.select(F.col("a").alias("node"), F.sha2(F.to_json("around"), 256).alias("component")), least)


def communities(edges: DataFrame, rounds: int = 10, least: int = 2) -> DataFrame:
    """(node, cluster): weighted label propagation; a node takes the label of most weight around it (ties: the least).

    A deterministic stand-in for modularity search: nodes of two alternating halves move in turn, which ends
    the swaps that moving all at once can run into. Stops when no label changes.
    """
    w = edges.where("a <> b").select("a", "b", "weight")
    w = _cut(w.union(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    now = _cut(w.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    still = False
    for turn in range(rounds * 2):
        votes = w.join(now.withColumnRenamed("node", "b"), "b").groupBy("a", "label").agg(F.sum("weight").alias("x"))
        best = votes.groupBy("a").agg(F.max("x").alias("x")).join(votes, ["a", "x"]).groupBy("a").agg(F.min("label").alias("best"))
        mine = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        moved = now.join(best, F.col("node") == F.col("a"), "left")
        moved = _cut(moved.select("node", F.when(mine, F.coalesce("best", "label")).otherwise(F.col("label")).alias("now"), "label").toDF("node", "label", "was"))
        now, quiet = moved.select("node", "label"), moved.where("label <> was").isEmpty()
        if quiet and still:
            break
        still = quiet
    return labelled(now.withColumnRenamed("label", "component"), least)


def _local_moves(pairs: DataFrame, strength: DataFrame, total: float, resolution: float, rounds: int) -> tuple[DataFrame, float]:
    """((node, k, group), modularity) after moves of single nodes: a node joins the neighbouring group of most gain.

    Nodes of two halves, by a hash that changes with the turn, move in turn, and a node alone joins another that is alone only if that
    has the lesser number; so neighbours rarely swap. The best of all turns is kept, and turns end when no node has moved in two. A turn is two jobs: one
    writes each node's move with its links into the group it was in, one sums these for the modularity before the turn.

    ``pairs(a, b, weight)`` both ways without loops, ``strength(node, k, loop)``.
    """
    now = scratch.table(strength.select("node", "k", F.col("node").alias("group")))
    loops = strength.agg(F.sum("loop")).first()[0] or 0
    best, best_q, quiet = now, None, 0
    for turn in range(rounds):
        if quiet >= 2:
            break
        of_group = now.groupBy("group").agg(F.sum("k").alias("sum"), F.count(F.lit(1)).alias("n"))
        links = pairs.join(now.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node"), "group").agg(F.sum("weight").alias("w"))
        own = now.join(of_group, "group").select("node", "k", F.col("group").alias("from"), F.col("sum").alias("own_sum"), F.col("n").alias("own_n"))
        mine = F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2
        home = F.col("group") == F.col("from")
        can = mine & ~home & ((F.col("own_n") > 1) | (F.col("n") > 1) | (F.col("group") < F.col("from")))
        # the gain of a move, but for the node's links into its own group, which are the same for all its moves
        score = F.col("w") - resolution * F.col("k") * (F.col("sum") - F.col("own_sum") + F.col("k")) / (2 * total)
        to = F.max(F.when(can, F.struct(score.alias("score"), (-F.col("group")).alias("g")))).alias("m")
        choice = links.join(own, "node").join(of_group, "group").groupBy("node").agg(to, F.coalesce(F.sum(F.when(home, F.col("w"))), F.lit(0)).alias("own_w"))
        moved = F.coalesce(F.col("m.score") - F.col("own_w") > 1e-9 * total, F.lit(False))
        after = now.join(choice, "node", "left").select("node", "k", F.col("group").alias("from"), F.when(moved, -F.col("m.g")).otherwise(F.col("group")).alias("group"), moved.alias("moved"), "own_w")
        after = scratch.table(after)
        # the state before the turn: weight inside groups, and their strengths
        groups = after.groupBy("from").agg(F.sum("own_w").alias("w"), F.sum("k").alias("s"), F.max("moved").alias("moved"))
        inside, spread, any_moved = groups.agg(F.sum("w"), F.sum(F.pow(F.col("s") / (2 * total), F.lit(2.0))), F.max("moved")).first()
        if turn:
            q = ((inside or 0) + 2 * loops) / (2 * total) - resolution * spread
            if best_q is None or q > best_q + 1e-12:
                best, best_q = now, q
        quiet = 0 if any_moved else quiet + 1
        now = after.select("node", "k", "group")
    return best, best_q


def modular(edges: DataFrame, resolution: float = 1.0, least: int = 2, rounds: int = 24) -> DataFrame:
    """(node, cluster): groups of high modularity of ``edges(a, b, weight)``, by local moves and contraction, level upon level.

    At each level single nodes move while modularity rises (:func:`_local_moves`); then each group becomes one node, and the next level begins,
    until a level gains nothing. ``resolution`` over 1 gives more and smaller groups. Clusters have at least ``least`` nodes and are numbered by
    size. Nothing is drawn at random: the same edges give the same clusters, whatever their order or partitions.
    """
    # read twice, and what it comes from may be long
    pairs = scratch.table(edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").cast("double").alias("weight")))
    names = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    # numbers by name, so that ties go the same way in every run; a number needs no row of another partition beside the counts
    names = scratch.table(numbered(names, "name"))
    level = scratch.table(pairs.join(names.toDF("a", "u"), "a").join(names.toDF("b", "v"), "b").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "weight"))
    total = level.agg(F.sum("weight")).first()[0]
    member = names.select("name", F.col("number").alias("at"))
    if not total:
        return labelled(member.select(F.col("name").alias("node"), F.col("name").alias("component")), least)
    reached = None
    while True:
        around = level.where("a <> b")
        both = scratch.table(around.union(around.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
        loop = level.where("a = b").select(F.col("a").alias("node"), F.col("weight").alias("loop"))
        sums = both.select(F.col("a").alias("node"), "weight").union(loop.select("node", F.col("loop") * 2)).groupBy("node").agg(F.sum("weight").alias("k"))
        strength = scratch.table(sums.join(loop, "node", "left").select("node", "k", F.coalesce("loop", F.lit(0.0)).alias("loop")))
        found, q = _local_moves(both, strength, total, resolution, rounds)
        if q is None or (reached is not None and q <= reached + 1e-9):
            break
        reached = q
        group = found.select("node", "group")
        member = scratch.table(member.join(group, member["at"] == group["node"]).select("name", F.col("group").alias("at")))
        ends = level.join(group.toDF("a", "u"), "a").join(group.toDF("b", "v"), "b")
        smaller = scratch.table(ends.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("weight").alias("weight")))
        if group.select("group").distinct().count() == group.count():
            break
        level = smaller
    return labelled(member.select(F.col("name").alias("node"), F.col("at").cast("string").alias("component")), least)


def numbered(rows: DataFrame, by: str, name: str = "number") -> DataFrame:
    """``rows`` with their places from 0 in the order of a column: a sort by ranges, counts of the ranges, and places inside each."""
    ordered = _cut(rows.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1
    return ordered.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def modularity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row (modularity) of clusters(node, cluster) on edges(a, b, weight)."""
    total = edges.agg(F.sum("weight").cast("double").alias("m"))
    named = clusters.select(F.col("node"), F.col("cluster").cast("string").alias("c"))
    ends = edges.join(named.toDF("a", "ca"), "a", "left").join(named.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", F.concat(F.lit("n"), "a")).alias("ca"), F.coalesce("cb", F.concat(F.lit("n"), "b")).alias("cb"), "weight")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("l"))
    degree = ends.select(F.explode(F.array("ca", "cb")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("d"))
    terms = degree.join(inside, "c", "left").crossJoin(F.broadcast(total))
    return terms.agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2.0))).alias("modularity"))


def paths(edges: DataFrame, source: str, target: str, cutoff: int = CUTOFF, most: int = MAX_PATHS, two_way: bool = True) -> DataFrame:
    """(path, hops): simple paths by length, then names; each round joins the open paths to the edges at their ends.

    It stops at the cutoff, or when ``most`` paths are found, since later ones are longer.
    """
    step = (both_ways(edges) if two_way else edges.select("a", "b").where("a <> b").distinct()).select(F.col("a").alias("at"), F.col("b").alias("to"))
    step = _cut(step)
    spark = edges.sparkSession
    open_ = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("at"))
    done = open_.where(F.lit(False)).select("path")
    for _ in range(min(cutoff, CUTOFF)):
        grown = _cut(open_.join(step, "at").where(~F.array_contains("path", F.col("to"))).select(F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at")))
        done = done.union(grown.where(F.col("at") == target).select("path"))
        open_ = grown.where(F.col("at") != target)
        if done.limit(most).count() >= most or open_.isEmpty():
            break
    return done.select(F.array_join("path", ">").alias("path"), (F.size("path") - 1).alias("hops")).orderBy("hops", "path").limit(most)


def centrality(edges: DataFrame, states: int = STATES) -> DataFrame:
    """(node, degree, betweenness): shortest-path betweenness, undirected and without weights, by single sources.

    Nodes with the same neighbours (:func:`_twins`) have the same share and are one class; the search goes over classes and counts a class as
    often as it has members. The sources go in blocks of about ``states`` rows (source, class). In a block the breadth-first levels are joins with
    the edges that count shortest paths, and the shares go back from the last level to the first as sums by source and class.
    """
    pairs = _cut(both_ways(edges))
    nodes = _twins(pairs)
    size = _cut(nodes.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("size")))
    ids = nodes.select("a", "id")
    step = pairs.join(ids.toDF("a", "at"), "a").join(ids.toDF("b", "to"), "b").groupBy("at", "to").agg(F.count(F.lit(1)).alias("_n"))
    step = _cut(step.join(size.toDF("at", "at_size"), "at").join(size.toDF("to", "to_size"), "to"))
    n = size.count()
    blocks = max(1, -(-n * n // states))
    sums = None
    for block in range(blocks):
        mine = size.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        part = _shares(step, mine.select(F.col("id").alias("source"), "size"))
        if part is not None:
            sums = _cut((part if sums is None else sums.union(part)).groupBy("id").agg(F.sum("x").alias("x")))
    found = nodes.withColumn("x", F.lit(0.0)) if sums is None else nodes.join(sums, "id", "left")
    return found.select(F.col("a").alias("node"), "degree", F.round(F.coalesce("x", F.lit(0.0)), 6).alias("betweenness"))


def _twins(pairs: DataFrame) -> DataFrame:
    """(a, degree, id): nodes with the same neighbours have the same id. ``pairs(a, b)`` both ways, each once.

    Nodes are grouped by their degree and two hashes of the neighbours, so no list of neighbours is built. Then it is checked that between two classes
    there are all edges or none; where that does not hold, a hash was wrong, and each node is a class of its own.
    """
    marks = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("degree"), F.bit_xor(F.xxhash64("b")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "b")).alias("m2"))
    marks = _cut(marks)
    classes = _cut(marks.select("degree", "m1", "m2").distinct().withColumn("id", F.monotonically_increasing_id()))
    nodes = _cut(marks.join(classes, ["degree", "m1", "m2"]).select("a", "degree", "id"))
    size = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ids = nodes.select("a", "id")
    between = pairs.join(ids.toDF("a", "u"), "a").join(ids.toDF("b", "v"), "b").groupBy("u", "v").agg(F.count(F.lit(1)).alias("edges"))
    partly = between.join(size.toDF("u", "nu"), "u").join(size.toDF("v", "nv"), "v").where("edges <> nu * nv")
    return nodes if partly.isEmpty() else _cut(marks.select("a", "degree", F.monotonically_increasing_id().alias("id")))


def _shares(step: DataFrame, sources: DataFrame) -> DataFrame | None:
    """(id, x): what each node of a class takes of the shortest paths from all nodes of ``sources(source, size)``; None where no source has a node at distance 2.

    A search starts at one node of a class; the others of its class, if any, are two steps off and a class of their own in it (``rest``), of one node less. A
    neighbour of a level lies in that level or in one beside it, so a new level is told from the last two alone.
    """
    links = step.select("at", "to", "at_size", "to_size")
    own = sources.select("source", F.col("size").alias("_size"))
    levels = [_cut(sources.select("source", F.col("source").alias("at"), F.lit(False).alias("rest"), F.lit(1.0).alias("ways"), F.lit(1.0).alias("n"), F.col("size").alias("_times")))]
    key = ["source", "at", "rest"]
    while True:
        reached = levels[-1].join(links, "at").groupBy("source", F.col("to").alias("at"), F.col("to_size").alias("n")).agg(F.sum(F.col("ways") * F.col("n")).alias("ways"))
        reached = reached.withColumn("rest", F.col("at") == F.col("source")).withColumn("n", F.when(F.col("rest"), F.col("n") - 1).otherwise(F.col("n"))).where("n > 0")
        for level in levels[-2:]:
            reached = reached.join(level.select(key), key, "left_anti")
        level = _cut(reached.join(own, "source").select("source", "at", "rest", "ways", "n", F.col("_size").alias("_times")))
        if level.isEmpty():
            break
        levels.append(level)
    shares, below = None, None
    for level in reversed(levels[1:]):
        if below is None:
            loaded = level.withColumn("x", F.lit(0.0))
        else:
            given = below.select("source", "at", (F.col("n") * (1 + F.col("x")) / F.col("ways")).alias("y")).join(links, "at").groupBy("source", F.col("to").alias("at")).agg(F.sum("y").alias("y"))
            loaded = _cut(level.join(given, ["source", "at"], "left").select(*key, "ways", "n", "_times", F.coalesce(F.col("ways") * F.col("y"), F.lit(0.0)).alias("x")))
            # a node takes its share from each node of the source's class, but not from itself
            times = F.when(F.col("rest"), F.col("_times") - 1).otherwise(F.col("_times"))
            part = loaded.groupBy(F.col("at").alias("id")).agg(F.sum(F.col("x") * times).alias("x"))
            shares = part if shares is None else shares.union(part)
        below = loaded
    return shares


def central_nodes(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, score): mean of degree, betweenness and bytes, each by its largest value. ``sizes(node, bytes)``."""
    rows = centrality(edges).join(sizes, "node", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    most = rows.agg(*[F.greatest(F.max(c).cast("double"), F.lit(1e-12)).alias(f"_{c}") for c in ("degree", "betweenness", "bytes")])
    mean = sum((F.col(c) / F.col(f"_{c}") for c in ("degree", "betweenness", "bytes")), F.lit(0.0)) / 3
    return rows.crossJoin(F.broadcast(most)).select("node", F.round(mean, 4).alias("score"))


def merge_hosts(packets: DataFrame, infrastructure: list[str] | None = None, most: int = 8) -> DataFrame:
    """(ip, host): addresses of one sending MAC are one host, named by its busiest IPv4 address (else any).

    Left out: link-local and loopback addresses, multicast MACs, MACs with the given vendor prefixes, and MACs of more than
    ``most`` addresses (routers).
    """
    ip, mac = F.col("src_ip"), F.upper("src_mac")
    odd = ip.startswith("169.254.") | ip.startswith("127.") | F.lower("src_ip").startswith("fe80") | ip.isin("", "::1", "0.0.0.0") | F.substring(mac, 2, 1).isin(list("13579BDF"))
    for prefix in infrastructure or []:
        odd |= mac.startswith(prefix.upper())
    rows = packets.where(~odd & (F.col("src_mac") != "")).groupBy(ip.alias("ip"), mac.alias("mac")).agg(F.count(F.lit(1)).alias("n"))
    few = rows.groupBy("mac").agg(F.count(F.lit(1)).alias("m")).where(F.col("m").between(2, most)).select("mac")
    linked = rows.join(few, "mac")
    part = components(linked.select(F.concat(F.lit("ip "), "ip").alias("a"), F.concat(F.lit("mac "), "mac").alias("b")))
    named = part.where("node like 'ip %'").select(F.expr("substring(node, 4)").alias("ip"), "component").join(rows.groupBy("ip").agg(F.sum("n").alias("n")), "ip")
    hosts = named.groupBy("component").agg(F.max_by("ip", F.struct(~F.col("ip").contains(":"), "n", F.col("ip"))).alias("host"))
    return named.join(hosts, "component").select("ip", "host")
