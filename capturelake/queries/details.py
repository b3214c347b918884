"""Queries over protocol fields, lookups and search; application fields are derived from the capture view."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import detect, fields, graph
from capturelake.operators import algorithms as alg
from capturelake.operators import sessions as ses
from capturelake.queries.registry import Registry, text
from capturelake.queries.graphs import parted, recursive
from capturelake.queries.sessions import SESSIONS, SYS, built, named
from capturelake.sources.capture_view import packets

R = Registry()
# one text for both engines
EXTRA = {
    "http_host": "CASE WHEN protocol = 'HTTP' THEN concat('h', CAST(seq_no % 7 AS {s}), '.example') ELSE '' END",
    "http_user_agent": "CASE WHEN protocol <> 'HTTP' THEN '' WHEN seq_no % 11 = 0 THEN 'Curl/8.0' WHEN seq_no % 13 = 0 THEN 'sqlmap' ELSE 'browser' END",
    "dns_query": "CASE WHEN protocol = 'DNS' THEN concat('N', CAST(seq_no % 30 AS {s}), '.example') ELSE '' END",
    "ja3": "CASE WHEN protocol = 'HTTPS' THEN concat('j', CAST(seq_no % 40 AS {s})) ELSE '' END",
    "tls_selected_version": "CASE WHEN protocol <> 'HTTPS' THEN '' WHEN seq_no % 17 = 0 THEN 'TLS 1.0' ELSE 'TLS 1.3' END",
    "arp_src_mac": "concat('m', CAST(seq_no % 3 AS {s}))",
}
DUCK = ", ".join(f"{v.format(s='VARCHAR')} AS {k}" for k, v in EXTRA.items())
LIST = "coalesce(array_to_string(list_sort(list_distinct(list({0}) FILTER ({0} <> ''))), ','), '')"


def rich(s, d):
    return named(s, d).selectExpr("*", *[f"{v.format(s='STRING')} AS {k}" for k, v in EXTRA.items()])


FIELDS = SESSIONS + f", x AS (SELECT *, {DUCK} FROM i) "


def field_query(name, protocol, columns):
    R.add(name, lambda s, d: fields.accumulate(rich(s, d), [protocol]).select("session_id", *[text(f) for f, _ in columns]),
          FIELDS + f"SELECT session_id, {', '.join(f'{LIST.format(c)} AS {f}' for f, c in columns)} FROM x GROUP BY session_id")


field_query("a29_tls_fields", "tls", [("tls_versions", "tls_selected_version"), ("ja3_hashes", "ja3")])
field_query("a30_http_fields", "http", [("http_hosts", "http_host"), ("http_fwd_user_agents", "http_user_agent")])
field_query("a31_dns_fields", "dns", [("dns_queries", "dns_query")])
field_query("a32_arp_fields", "arp", [("arp_macs", "arp_src_mac")])
R.add("a04_edge_details", lambda s, d: fields.edge_details(graph.with_ids(rich(s, d)), ["http_host", "dns_query"]).select("src", "dst", "protocol", text("http_host"), text("dns_query")),
      FIELDS + f"SELECT src_ip src, dst_ip dst, protocol, {LIST.format('http_host')} http_host, {LIST.format('dns_query')} dns_query FROM x WHERE src_ip <> dst_ip GROUP BY 1, 2, 3")


def session_fields(s, d):
    rows = rich(s, d)
    found = fields.accumulate(rows, ["tls", "http"]).withColumnsRenamed({"session_id": "id", "http_fwd_user_agents": "user_agents"})
    return ses.sessions(rows).join(found, "id")


def known(s):
    return s.sql("SELECT concat('j', id) AS hash, concat('family', id) AS name FROM range(3, 9)")


HASHES = ", f AS (SELECT session_id, list_sort(list_distinct(list(ja3) FILTER (ja3 <> ''))) ja3, list_sort(list_distinct(list(tls_selected_version) FILTER (tls_selected_version <> ''))) v, list_sort(list_distinct(list(http_user_agent) FILTER (http_user_agent <> ''))) u FROM x GROUP BY 1), s AS (SELECT * FROM sessions JOIN f ON session_id = id) "
R.add("n05_malicious_ja3", lambda s, d: detect.malicious_ja3(session_fields(s, d), known(s)),
      FIELDS + HASHES + ", h AS (SELECT id, start_time, list_filter(ja3, lambda y: y IN ('j3', 'j4', 'j5', 'j6', 'j7', 'j8'))[1] h FROM s) SELECT 'critical' severity, 'malicious_ja3' kind, id subject, concat('family', substr(h, 2), ' ', h) evidence, start_time first_seen FROM h WHERE h IS NOT NULL")
R.add("n06_deprecated_tls", lambda s, d: detect.weak_tls(session_fields(s, d)), FIELDS + HASHES + "SELECT 'medium' severity, 'deprecated_tls' kind, id subject, 'TLS 1.0' evidence, start_time first_seen FROM s WHERE list_contains(v, 'TLS 1.0')")
R.add("n07_user_agents", lambda s, d: detect.user_agents(session_fields(s, d)),
      FIELDS + HASHES + ", v AS (SELECT src_ip, dst_ip, start_time, id, lower(unnest(u)) ua FROM s), r AS (SELECT *, CASE WHEN contains(ua, 'curl/') THEN 'curl/' WHEN contains(ua, 'sqlmap') THEN 'sqlmap' END rule FROM v) SELECT 'medium' severity, 'suspicious_ua' kind, concat(src_ip, ' -> ', dst_ip) subject, first(rule ORDER BY start_time, id, ua) evidence, min(start_time) first_seen FROM r WHERE rule IS NOT NULL GROUP BY src_ip, dst_ip")
R.add("n08_empty_user_agents", lambda s, d: detect.empty_user_agents(session_fields(s, d).withColumn("user_agents", F.when(F.col("total_bytes") % 2 == 0, F.col("user_agents")))),
      FIELDS + HASHES + "SELECT 'low' severity, 'empty_ua' kind, src_ip subject, CAST(count(*) AS VARCHAR) evidence, min(start_time) first_seen FROM s WHERE protocol = 'HTTP' AND (total_bytes % 2 <> 0 OR len(u) = 0) GROUP BY src_ip")
R.add("n03_arp_spoofing", lambda s, d: detect.arp_spoofing(rich(s, d).withColumn("arp_src_ip", F.col("src_ip"))),
      FIELDS + ", m AS (SELECT src_ip, arp_src_mac, min(timestamp) t FROM x GROUP BY 1, 2) SELECT 'high' severity, 'arp_spoofing' kind, src_ip subject, string_agg(arp_src_mac, ',' ORDER BY t, arp_src_mac) evidence, min(t) first_seen FROM m GROUP BY src_ip HAVING count(*) >= 2")
R.add("n04_arp_flood", lambda s, d: detect.arp_flood(rich(s, d).withColumns({"arp_src_ip": F.col("src_ip"), "arp_dst_ip": F.col("src_ip"), "arp_opcode": (F.col("seq_no") % 3).cast("int")})),
      FIELDS + "SELECT 'medium' severity, 'gratuitous_arp' kind, arp_src_mac subject, CAST(count(*) AS VARCHAR) evidence, min(timestamp) first_seen FROM x WHERE seq_no % 3 = 2 GROUP BY 3 HAVING count(*) >= 15")
R.add("n12_dns_names", lambda s, d: detect.dns_names(rich(s, d).withColumns({"dns_qr": F.lit(1), "dns_answers": F.array("dst_ip", F.lit("not.an.address"))})).select("ip", text("names")),
      FIELDS + "SELECT dst_ip ip, array_to_string(list_sort(list_distinct(list(lower(dns_query)))), ',') AS names FROM x WHERE dns_query <> '' GROUP BY 1")
R.add("n13_top_domains", lambda s, d: detect.top_domains(rich(s, d)), FIELDS + "SELECT lower(dns_query) \"domain\", count(*) n FROM x WHERE dns_query <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20")
R.add("j08_enrich", lambda s, d: fields.enrich(graph.view_nodes(graph.with_ids(packets(s, d))), detect.fingerprints(packets(s, d)).select(F.col("ip").alias("key"), F.col("system").alias("value")), "system").select("id", "system"),
      SYS + "SELECT id, system FROM (SELECT src_ip id FROM packets UNION SELECT dst_ip FROM packets) LEFT JOIN g ON g.ip = id")
R.add("f17_components", lambda s, d: fields.of_components(parted(s, d), alg.components(parted(s, d).select(F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"))), ["10.0.0.1"]).select("seq_no"),
      recursive("SELECT seq_no FROM parted WHERE src_ip IN (SELECT node FROM c WHERE component = '10.0.0.1') OR dst_ip IN (SELECT node FROM c WHERE component = '10.0.0.1')"), packets=False)
R.add("f10_resolved", lambda s, d: fields.resolve(packets(s, d), s.sql("SELECT '10.0.0.1' AS ip, '10.0.0.2' AS host UNION ALL SELECT '10.0.0.3', 'fd00::3'"), include_ipv6=False).groupBy("src").agg(F.count(F.lit(1)).alias("n")),
      "SELECT CASE src_ip WHEN '10.0.0.1' THEN '10.0.0.2' ELSE src_ip END src, count(*) n FROM packets WHERE src_ip <> '10.0.0.3' GROUP BY 1")
R.add("f24_search", lambda s, d: fields.search(*_view(s, d), built(s, d), "10.0.0.15"),
      SESSIONS + """, e AS (SELECT DISTINCT concat_ws('|', src_ip, dst_ip, protocol) id, src_ip, dst_ip FROM packets WHERE src_ip <> dst_ip), m AS (SELECT * FROM e WHERE contains(id, '10.0.0.15'))
      SELECT 'session' kind, id FROM sessions WHERE contains(src_ip, '10.0.0.15') OR contains(dst_ip, '10.0.0.15') UNION ALL SELECT 'edge', id FROM m UNION ALL
      SELECT 'node', id FROM (SELECT src_ip id FROM m UNION SELECT dst_ip FROM m UNION SELECT src_ip FROM packets WHERE contains(src_ip, '10.0.0.15'))""")  # fmt: skip


def _view(s, d):
    rows = graph.with_ids(packets(s, d))
    return graph.view_nodes(rows), graph.view_edges(rows)
