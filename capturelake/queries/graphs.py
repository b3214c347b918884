"""Queries over graphs: algorithms, conditions and recipes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capturelake import scratch
from capturelake.operators import algorithms as alg
from capturelake.operators import graph
from capturelake.plans.predicates import Condition, match
from capturelake.plans.recipe import Step, run
from capturelake.queries import sessions as session_queries
from capturelake.queries.registry import Registry
from capturelake.sources.capture_view import packets

R = Registry()
# All packets, with the far ends named after the near end's port: five groups that never talk to each other.
FAR = "concat(dst_ip, '-', CAST(src_port % 5 AS {s}))"
PAIRS = f"parted AS (SELECT * REPLACE ({FAR.format(s='VARCHAR')} AS dst_ip) FROM packets), e AS (SELECT least(src_ip, dst_ip) a, greatest(src_ip, dst_ip) b, CAST(sum(orig_len) AS BIGINT) weight, count(*) packets FROM parted GROUP BY 1, 2), "
BOTH = "t AS (SELECT a, b FROM e UNION SELECT b, a FROM e) "


def parted(s, d):
    return packets(s, d).withColumn("dst_ip", F.expr(FAR.format(s="STRING")))


def parted_pairs(s, d):
    return parted(s, d).groupBy(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b")).agg(F.sum("orig_len").alias("weight"), F.count(F.lit(1)).alias("packets"))


def talk(s, d):
    """(a, b, weight, packets) of every pair of addresses, over all packets."""
    return packets(s, d).groupBy(F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b")).agg(F.sum("orig_len").alias("weight"), F.count(F.lit(1)).alias("packets"))


def numbered(df):
    return df.withColumn("cluster", F.col("cluster").cast("long"))


def view(s, d):
    rows = graph.with_ids(packets(s, d))
    return graph.view_nodes(rows, carry=True), graph.view_edges(rows)


R.add("g01_weighted_pairs", lambda s, d: alg.undirected(view(s, d)[1]), "SELECT least(src_ip, dst_ip) a, greatest(src_ip, dst_ip) b, CAST(sum(orig_len) AS BIGINT) weight FROM packets WHERE src_ip <> dst_ip GROUP BY 1, 2")
R.add("g02_directed_pairs", lambda s, d: alg.directed(view(s, d)[1]), "SELECT src_ip a, dst_ip b, CAST(sum(orig_len) AS BIGINT) weight FROM packets WHERE src_ip <> dst_ip GROUP BY 1, 2")
COMPONENTS = "WITH RECURSIVE " + PAIRS + BOTH[:-1] + ", r AS (SELECT a AS node, a AS root FROM t UNION SELECT t.b, r.root FROM r JOIN t ON t.a = r.node), c AS (SELECT node, min(root) component FROM r GROUP BY node) "


def recursive(select: str) -> str:
    from capturelake.sources.capture_view import PACKETS_SQL

    return COMPONENTS.replace("WITH RECURSIVE ", f"WITH RECURSIVE packets AS ({PACKETS_SQL}), ") + select


R.add("g03_components", lambda s, d: alg.components(parted_pairs(s, d)), recursive("SELECT * FROM c"), packets=False)
R.add("g09_labelled_components", lambda s, d: alg.labelled(alg.components(parted_pairs(s, d))).withColumn("cluster", F.col("cluster").cast("long")),
      recursive("SELECT node, CAST(rank - 1 AS BIGINT) AS cluster FROM c JOIN (SELECT component, row_number() OVER (ORDER BY count(*) DESC, min(node)) AS rank FROM c GROUP BY component HAVING count(*) >= 2) USING (component)"), packets=False)
R.add("a45_component_summary", lambda s, d: alg.component_summary(parted_pairs(s, d)).drop("top"),
      recursive("SELECT component, nodes, edges, packets FROM (SELECT component, count(*) nodes FROM c GROUP BY 1) JOIN (SELECT component, count(*) edges, CAST(sum(packets) AS BIGINT) packets FROM e JOIN c ON c.node = e.a GROUP BY 1) USING (component) ORDER BY nodes DESC, component LIMIT 100"), packets=False)
R.add("g06_core", lambda s, d: alg.core_clusters(talk(s, d), 2))
# the near end with its service and length: most are leaves of one far end, some of several
LEAF = "concat(src_ip, '#', CAST(dst_port AS {s}), '#', CAST(orig_len AS {s}))"
R.add("g07_hubs", lambda s, d: numbered(alg.hubs(packets(s, d).select(F.expr(LEAF.format(s="STRING")).alias("a"), F.col("dst_ip").alias("b")), 2)),
      f"WITH e AS (SELECT DISTINCT {LEAF.format(s='VARCHAR')} a, dst_ip b FROM packets), " + BOTH + ", d AS (SELECT a, count(*) n, min(b) hub FROM t GROUP BY a), l AS (SELECT a AS node, hub FROM d WHERE n = 1), h AS (SELECT hub, CAST(row_number() OVER (ORDER BY max(d.n) DESC, hub) - 1 AS BIGINT) AS cluster FROM l JOIN (SELECT a, n FROM d) d ON d.a = hub GROUP BY hub HAVING count(*) >= 2) SELECT node, cluster FROM l JOIN h USING (hub) UNION ALL SELECT hub, cluster FROM h")
R.add("g08_equivalent", lambda s, d: alg.equivalent(parted_pairs(s, d), 2).withColumn("cluster", F.col("cluster").cast("long")),
      "WITH " + PAIRS + BOTH + ", k AS (SELECT a AS node, array_to_string(list_sort(list(b)), ',') k FROM t GROUP BY a), g AS (SELECT k, CAST(row_number() OVER (ORDER BY count(*) DESC, min(node)) - 1 AS BIGINT) AS cluster FROM k GROUP BY k HAVING count(*) >= 2) SELECT node, cluster FROM k JOIN g USING (k)")
R.add("g04_paths", lambda s, d: alg.paths(talk(s, d), "10.0.0.4", "192.168.1.1", cutoff=3, most=20))
R.add("g05_communities", lambda s, d: alg.modular(talk(s, d)))
R.add("g10_centrality", lambda s, d: alg.centrality(talk(s, d)))
R.add("n11_central_nodes", lambda s, d: alg.central_nodes(talk(s, d), talk(s, d).select(F.explode(F.array("a", "b")).alias("node"), "weight").groupBy("node").agg(F.sum("weight").alias("bytes"))))

# the same on the graph of all addresses as they are: without SQL, tested against brute force
R.add("g03_components_all", lambda s, d: alg.components(talk(s, d)))
R.add("g09_labelled_components_all", lambda s, d: numbered(alg.labelled(alg.components(talk(s, d)))))
R.add("a45_component_summary_all", lambda s, d: alg.component_summary(talk(s, d)).drop("top"))
R.add("g07_hubs_all", lambda s, d: numbered(alg.hubs(talk(s, d), 2)))
R.add("g08_equivalent_all", lambda s, d: numbered(alg.equivalent(talk(s, d), 2)))


def collapsed(s, d):
    nodes, edges = view(s, d)
    clusters = nodes.where("is_private and total_bytes > 50000").select(F.col("id").alias("node"), (F.length("id") % 3).alias("cluster"))
    return graph.collapse(nodes, edges, clusters)[1]


R.add("a44_collapse", collapsed,
      """WITH p AS (SELECT * FROM packets WHERE src_ip <> dst_ip), n AS (SELECT id, sum(orig_len) t FROM (SELECT src_ip id, orig_len FROM p UNION ALL SELECT dst_ip, orig_len FROM p) GROUP BY id),
      k AS (SELECT id, CASE WHEN t > 50000 THEN concat('cluster:', length(id) % 3) ELSE id END c FROM n), m AS (SELECT a.c s, b.c d, protocol, orig_len FROM p JOIN k a ON a.id = src_ip JOIN k b ON b.id = dst_ip)
      SELECT least(s, d) a, greatest(s, d) b, protocol, CAST(sum(orig_len) AS BIGINT) total_bytes, count(*) packet_count FROM m WHERE s <> d GROUP BY 1, 2, 3""")  # fmt: skip

NODES = "WITH n AS (SELECT id, CAST(sum(orig_len) AS BIGINT) total_bytes, count(*) packet_count, list_distinct(list(protocol)) protocols FROM (SELECT src_ip id, protocol, orig_len FROM packets WHERE src_ip <> dst_ip UNION ALL SELECT dst_ip, protocol, orig_len FROM packets WHERE src_ip <> dst_ip) GROUP BY id) SELECT id FROM n WHERE "
EDGES = "WITH e AS (SELECT concat_ws('|', src_ip, dst_ip, protocol) id, src_ip src, dst_ip dst, protocol, CAST(sum(orig_len) AS BIGINT) total_bytes, count(*) packet_count FROM packets WHERE src_ip <> dst_ip GROUP BY 1, 2, 3, 4) SELECT id FROM e WHERE "
C = Condition


def condition(name, target, conditions, where, logic="AND"):
    part = 0 if target == "nodes" else 1
    R.add(name, lambda s, d: match(view(s, d)[part], conditions, logic).select("id"), (NODES if part == 0 else EDGES) + where)


condition("p01_numeric", "nodes", [C("total_bytes", ">", 300000)], "total_bytes > 300000")
condition("p01_text_not_equal", "edges", [C("protocol", "!=", "DNS")], "false")
condition("p01_missing_is_zero", "edges", [C("nothing", "<=", 0), C("packet_count", ">=", 4)], "packet_count >= 4")
condition("p02_count", "nodes", [C("protocols", "count_gt", 4)], "len(protocols) > 4")
condition("p03_contains_all", "nodes", [C("protocols", "contains_all", ["DNS", "SSH"])], "list_contains(protocols, 'DNS') AND list_contains(protocols, 'SSH')")
condition("p03_scalar_contains", "edges", [C("protocol", "contains", "SS")], "protocol = 'SS'")
condition("p04_contains_any", "nodes", [C("protocols", "contains_any", ["SMB", "none"])], "list_contains(protocols, 'SMB')")
condition("p05_empty", "nodes", [C("protocols", "not_empty"), C("nothing", "is_empty")], "len(protocols) > 0")
condition("p06_prefix", "edges", [C("src", "starts_with", "10.0.0.1"), C("protocol", "equals", "https")], "starts_with(src, '10.0.0.1') AND protocol = 'HTTPS'")
condition("p06_array_suffix", "nodes", [C("protocols", "ends_with", "mb")], "list_contains(protocols, 'SMB')")
condition("p07_matches", "edges", [C("id", "matches", r"\|203\..*\|s[sm]")], "regexp_matches(id, '(?i)\\|203\\..*\\|s[sm]')")
condition("p07_bad_pattern", "edges", [C("id", "matches", "(", negate=True), C("protocol", "equals", "dns")], "protocol = 'DNS'")
condition("p08_like", "edges", [C("dst", "like", "203.0.113._"), C("protocol", "like", "%h")], "false")
condition("p08_like_case", "edges", [C("protocol", "like", "h%s", case_insensitive=True)], "protocol = 'HTTPS'")
condition("p09_truth", "nodes", [C("protocols", "is_true"), C("nothing", "is_false")], "true")
condition("p12_negate", "edges", [C("total_bytes", ">", 500, negate=True), C("missing", ">", 5, negate=True)], "NOT total_bytes > 500")
condition("p13_or", "edges", [C("protocol", "equals", "DNS"), C("packet_count", ">", 3)], "protocol = 'DNS' OR packet_count > 3", "OR")
condition("p14_unknown", "edges", [C("protocol", "sounds_like", "DNS")], "false")


def in_set(s, d):
    members = packets(s, d).where("protocol = 'DNS'").select(F.col("src_ip").alias("member")).distinct()
    return match(view(s, d)[0], [C("", "in_set", "@dns"), C("total_bytes", ">", 38000)], sets={"dns": members}).select("id")


R.add("p10_in_set", in_set, NODES + "id IN (SELECT src_ip FROM packets WHERE protocol = 'DNS') AND total_bytes > 38000")


def sql_view(s, d):
    """SQL goes to Catalyst as it is, over the graph's frames."""
    nodes, edges = view(s, d)
    return s.sql("SELECT src AS id, count(*) AS n FROM {edges} WHERE src IN (SELECT id FROM {nodes} WHERE array_contains(protocols, 'DNS')) AND NOT protocol LIKE 'H%' GROUP BY src", nodes=nodes, edges=edges)


R.add("q03_sql_over_graph", sql_view, NODES.split(" SELECT id FROM n")[0] + ", e AS (SELECT DISTINCT src_ip, dst_ip, protocol FROM packets WHERE src_ip <> dst_ip) SELECT src_ip AS id, count(*) AS n FROM e WHERE src_ip IN (SELECT id FROM n WHERE list_contains(protocols, 'DNS')) AND NOT protocol LIKE 'H%' GROUP BY 1")


def recipe(s, d):
    nodes, edges = view(s, d)
    steps = [Step("show_only", "edges", [C("protocol", "equals", "ssh")]), Step("hide", "nodes", [C("total_bytes", "<", 38000)])]
    return run(nodes, edges, steps)


RECIPE = f"WITH n AS (SELECT id, sum(orig_len) t FROM (SELECT src_ip id, orig_len FROM packets WHERE src_ip <> dst_ip UNION ALL SELECT dst_ip, orig_len FROM packets WHERE src_ip <> dst_ip) GROUP BY id), e AS (SELECT DISTINCT concat_ws('|', src_ip, dst_ip, protocol) id, src_ip, dst_ip, protocol FROM packets WHERE src_ip <> dst_ip) "
R.add("r03_recipe_edges", lambda s, d: recipe(s, d).edges.where("visible").select("id"), RECIPE + "SELECT id FROM e WHERE protocol = 'SSH' AND src_ip IN (SELECT id FROM n WHERE t >= 38000) AND dst_ip IN (SELECT id FROM n WHERE t >= 38000)")
R.add("r05_recipe_nodes", lambda s, d: recipe(s, d).nodes.select("id", "visible"), RECIPE + "SELECT id, t >= 38000 AS visible FROM n")


def slim(s, d):
    """The view with the columns that the steps read, so that what a recipe writes has no others."""
    nodes, edges = view(s, d)
    return nodes.select("id", "total_bytes"), edges.select("id", "src", "dst", "protocol")


def orphans(s, d):
    nodes, edges = slim(s, d)
    return run(nodes, edges, [Step("show_only", "edges", [C("protocol", "equals", "dns")]), Step("hide", "edges", [C("dst", "starts_with", "203.")])]).nodes.select("id", "visible")


R.add("r05_orphans", orphans, RECIPE + ", h AS (SELECT * FROM e WHERE protocol = 'DNS'), k AS (SELECT src_ip, dst_ip FROM h WHERE NOT starts_with(dst_ip, '203.')), g AS (SELECT src_ip, dst_ip FROM h WHERE starts_with(dst_ip, '203.')) SELECT id, NOT (id IN (SELECT src_ip FROM g UNION SELECT dst_ip FROM g) AND NOT id IN (SELECT src_ip FROM k UNION SELECT dst_ip FROM k)) AS visible FROM n")


def grouped(s, d):
    nodes, edges = view(s, d)
    steps = [Step("save_as_set", "nodes", [C("protocols", "contains", "SMB")], group="smb"), Step("hide", "nodes", [C("total_bytes", ">", 200000)]),
             Step("tag", "nodes", [C("", "in_set", "smb")], group="t"), Step("show_only", from_group=("tag", "t"))]
    return run(nodes, edges, steps).nodes.where("visible").select("id")


R.add("r08_groups_and_sets", grouped, RECIPE + "SELECT id FROM n WHERE t <= 200000 AND id IN (SELECT src_ip FROM packets WHERE protocol = 'SMB' UNION SELECT dst_ip FROM packets WHERE protocol = 'SMB')")


def session_steps(s, d):
    """What two steps on sessions highlight: the addresses and pairs of long TCP sessions, then of tagged ones that are not web."""
    nodes, edges = view(s, d)
    steps = [
        Step("highlight", "sessions", [C("packet_count", ">=", 3), C("transport", "equals", "tcp")]), Step("tag", "sessions", [C("total_bytes", ">", 2000)], group="big"),
        Step("highlight", conditions=[C("protocol", "equals", "https", negate=True)], from_group=("tag", "big")),
    ]
    done = run(nodes, edges, steps, sessions=session_queries.built(s, d))
    parts = [f.select(F.lit(r.step).alias("step"), F.lit(k).alias("kind"), "id") for r in done.records if r.verb == "highlight" for k, f in (("node", r.nodes), ("edge", r.edges), ("session", r.matches))]
    return functools.reduce(DataFrame.unionByName, parts)


SESSION_STEPS = session_queries.SESSIONS + """, m AS (SELECT 0 AS step, id, src_ip, dst_ip FROM sessions WHERE packet_count >= 3 AND transport = 'TCP'
 UNION ALL SELECT 2, id, src_ip, dst_ip FROM sessions WHERE total_bytes > 2000 AND protocol <> 'HTTPS')
SELECT step, 'session' AS kind, id FROM m UNION SELECT step, 'node', src_ip FROM m UNION SELECT step, 'node', dst_ip FROM m UNION SELECT step, 'edge', least(src_ip, dst_ip) || '|' || greatest(src_ip, dst_ip) FROM m"""
R.add("r09_session_steps", session_steps, SESSION_STEPS)


def provenance(s, d):
    """What each step of a recipe removed, by id."""
    nodes, edges = slim(s, d)
    steps = [Step("show_only", "edges", [C("protocol", "equals", "ssh")]), Step("hide", "nodes", [C("total_bytes", "<", 38000)]), Step("hide", "edges", [C("dst", "starts_with", "203.")])]
    parts = []
    for r in run(nodes, edges, steps).records:
        for what, found in (("match", r.matches), ("effect", r.effective), ("node", r.removed_nodes), ("edge", r.removed_edges)):
            parts.append(found.select(F.lit(r.step).alias("step"), F.lit(what).alias("what"), "id"))
    return functools.reduce(DataFrame.unionByName, parts)


PROVENANCE = RECIPE + """, low AS (SELECT id FROM n WHERE t < 38000), ssh AS (SELECT * FROM e WHERE protocol = 'SSH'),
 held AS (SELECT * FROM ssh WHERE src_ip NOT IN (SELECT id FROM low) AND dst_ip NOT IN (SELECT id FROM low)), far AS (SELECT * FROM held WHERE starts_with(dst_ip, '203.')),
 near AS (SELECT * FROM held WHERE NOT starts_with(dst_ip, '203.')), lost AS (SELECT src_ip AS id FROM far UNION SELECT dst_ip FROM far)
SELECT 0 AS step, 'match' AS what, id FROM ssh UNION ALL SELECT 0, 'effect', id FROM ssh UNION ALL SELECT 0, 'edge', id FROM e WHERE protocol <> 'SSH'
UNION ALL SELECT 1, 'match', id FROM low UNION ALL SELECT 1, 'effect', id FROM low UNION ALL SELECT 1, 'node', id FROM low UNION ALL SELECT 1, 'edge', id FROM ssh WHERE id NOT IN (SELECT id FROM held)
UNION ALL SELECT 2, 'match', id FROM e WHERE starts_with(dst_ip, '203.') UNION ALL SELECT 2, 'effect', id FROM far UNION ALL SELECT 2, 'edge', id FROM far
UNION ALL SELECT 2, 'node', id FROM lost WHERE id NOT IN (SELECT src_ip FROM near UNION SELECT dst_ip FROM near) AND id NOT IN (SELECT id FROM low)"""
R.add("r10_provenance", provenance, PROVENANCE)


def modular_invariants(s, d):
    """What holds of any good clustering: every node that talks has a cluster, weights inside and between clusters are all weights, and
    modularity is over that of one cluster, which is 0."""
    pairs = scratch.table(talk(s, d))
    found = alg.modular(pairs, least=1)
    ends = pairs.join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b")
    good = alg.modularity(pairs, found).select((F.col("modularity") > 0).alias("positive"))
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(ends.agg(F.sum("weight").alias("weight"))).crossJoin(good)


R.add("g05_modular_invariants", modular_invariants,
      "SELECT (SELECT count(*) FROM (SELECT src_ip FROM packets WHERE src_ip <> dst_ip UNION SELECT dst_ip FROM packets WHERE src_ip <> dst_ip)) AS nodes, CAST(sum(orig_len) AS BIGINT) AS weight, true AS positive FROM packets WHERE src_ip <> dst_ip")
