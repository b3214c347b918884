"""Queries over endpoint events derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from capturelake.operators import forensic as fx
from capturelake.queries.registry import Registry

R = Registry()
IMAGES = "element_at(array('C:\\\\Windows\\\\System32\\\\cmd.exe', 'C:\\\\Users\\\\a\\\\tool.exe', 'C:\\\\Program Files\\\\x\\\\app.exe', 'C:\\\\temp\\\\run.ps1'), cast(user_id % 4 + 1 as int))"


def raw(s, d, timed="true"):
    """Raw records: the user is the process, the kind of event its record type; those without ``timed`` have no time."""
    return s.read.parquet(f"{d}/events.parquet").selectExpr(
        "cast(case event_type when 'view' then 3 when 'click' then 1 when 'purchase' then 11 when 'signup' then 13 else 22 end as int) as eid", "concat('host', user_id % 3) as computer", f"case when {timed} then cast(ts as timestamp) end as time_created",
        f"""map('ProcessGuid', '', 'Image', {IMAGES}, 'ProcessId', cast(user_id as string), 'ParentImage', 'C:\\\\Windows\\\\explorer.exe', 'ParentProcessId', cast(user_id % 7 as string),
            'Initiated', 'true', 'DestinationIp', concat('203.0.113.', event_id % 5), 'DestinationPort', '443', 'TargetFilename', concat('C:\\\\Temp\\\\F', event_id % 9, '.TXT'), 'TargetObject', concat('HKLM\\\\Software\\\\Microsoft\\\\K', event_id % 4)) as event_data""",
    )


EVENTS = """WITH v AS (SELECT *, ['C:\\Windows\\System32\\cmd.exe', 'C:\\Users\\a\\tool.exe', 'C:\\Program Files\\x\\app.exe', 'C:\\temp\\run.ps1'][user_id % 4 + 1] image, concat('host', user_id % 3) computer FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup')),
 x AS (SELECT ts, event_type, concat('fx:proc:', computer, ':', image, ':', user_id) me, concat('fx:proc:', computer, ':C:\\Windows\\explorer.exe:', user_id % 7) parent, event_id FROM v),
 e AS (SELECT ts, event_type, CASE WHEN event_type = 'click' THEN parent ELSE me END src_id,
   CASE event_type WHEN 'click' THEN me WHEN 'view' THEN concat('fx:net:203.0.113.', event_id % 5, ':443') WHEN 'purchase' THEN concat('fx:file:c:\\temp\\f', event_id % 9, '.txt') ELSE concat('fx:reg:hklm\\software\\microsoft\\k', event_id % 4) END dst_id,
   CASE event_type WHEN 'click' THEN 'spawned' WHEN 'view' THEN 'connected' WHEN 'purchase' THEN 'wrote' ELSE 'set_value' END type FROM x),
 g AS (SELECT src_id, dst_id, CASE WHEN min(type) = max(type) THEN min(type) ELSE 'mixed' END type, count(*) AS count, min(ts) ts_first, max(ts) ts_last FROM e GROUP BY 1, 2) """
NTZ = lambda *c: [F.col(x).cast("timestamp_ntz").alias(x) for x in c]


def add(name, query, select):
    R.add(name, lambda s, d: query(fx.dissect(raw(s, d))), EVENTS + select, packets=False)


add("a42_forensic_edges", lambda e: fx.edges(e).select("src_id", "dst_id", "type", "count", *NTZ("ts_first", "ts_last")), "SELECT * FROM g")
add("a43_forensic_nodes", lambda e: fx.nodes(e).select("id", "event_count", "connection_count", "child_count"),
    ", n AS (SELECT id, count(*) event_count FROM (SELECT src_id id FROM e UNION ALL SELECT dst_id FROM e) GROUP BY id) SELECT n.id, event_count, count(*) FILTER (g.type = 'connected') connection_count, count(*) FILTER (g.type = 'spawned') child_count FROM n LEFT JOIN g ON g.src_id = n.id GROUP BY n.id, event_count")
add("f22_forensic_window", lambda e: fx.in_window(fx.edges(e).withColumn("ts_first", F.col("ts_first").cast("timestamp_ntz")).withColumn("ts_last", F.col("ts_last").cast("timestamp_ntz")), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), F.lit("2024-01-12 00:00:00").cast("timestamp_ntz")).select("src_id", "dst_id"),
    "SELECT src_id, dst_id FROM g WHERE ts_last >= TIMESTAMP '2024-01-10' AND ts_first <= TIMESTAMP '2024-01-12'")
add("n30_process_gantt", lambda e: fx.process_gantt(e).select("id", *NTZ("start", "end")),
    ", s AS (SELECT dst_id id, min(ts) AS start FROM e WHERE type = 'spawned' GROUP BY 1), l AS (SELECT id, max(ts) AS last FROM (SELECT src_id id, ts FROM e UNION ALL SELECT dst_id, ts FROM e) GROUP BY id) SELECT s.id, start, greatest(last, start + INTERVAL 1 SECOND) AS \"end\" FROM s JOIN l ON s.id = l.id")
add("n31_registry_timeline", lambda e: fx.action_timeline(e, "registry_set").select("src_id", "dst_id", "seconds"),
    "SELECT src_id, dst_id, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM e WHERE type = 'set_value')) / 1000000, 3) AS seconds FROM e WHERE type = 'set_value'")
add("n34_classifiers", lambda e: fx.nodes(e).where("type = 'process'").select("id", fx.binary_type(F.col("image")).alias("kind"), fx.lolbin(F.col("image")).alias("lolbin")),
    "SELECT DISTINCT id, CASE WHEN contains(id, '.ps1') THEN 'PowerShell script' WHEN contains(id, 'System32') THEN 'System process' WHEN contains(id, 'Windows') THEN 'Windows component' WHEN contains(id, 'Program Files') THEN 'Installed app' ELSE 'User directory' END kind, CASE WHEN contains(id, 'cmd.exe') THEN 'Shell' END lolbin FROM (SELECT src_id id FROM e UNION ALL SELECT dst_id FROM e) WHERE starts_with(id, 'fx:proc')")
add("x17_registry_category", lambda e: fx.nodes(e).where("type = 'registry'").select("id", fx.registry_category(F.col("key")).alias("category")), "SELECT DISTINCT dst_id AS id, 'Microsoft software' AS category FROM e WHERE type = 'set_value'")
# events whose number divides by 40 have lost their time
UNTIMED = EVENTS.replace("SELECT ts, event_type, concat(", "SELECT CASE WHEN event_id % 40 <> 0 THEN ts END AS ts, event_type, concat(")
ACTION = "CASE type WHEN 'spawned' THEN 'process_create' WHEN 'connected' THEN 'network_connect' WHEN 'wrote' THEN 'file_create' ELSE 'registry_set' END"


def untimed(s, d):
    return fx.dissect(raw(s, d, "event_id % 40 <> 0"))


R.add("n29_animation", lambda s, d: fx.animation(untimed(s, d)).select("number", "src_id", "dst_id", "action_type", F.round("time", 6).alias("time")),
    UNTIMED + f", o AS (SELECT src_id, dst_id, {ACTION} AS action_type, coalesce(epoch_us(ts) / 1000000, 0) AS told FROM e), q AS (SELECT *, row_number() OVER (ORDER BY told, src_id, dst_id, action_type) - 1 AS number FROM o) "
    "SELECT number, src_id, dst_id, action_type, round(CASE WHEN told = 0 THEN number * 0.001 ELSE told END, 6) AS time FROM q", packets=False)  # fmt: skip
HOSTS = [f"fx:net:203.0.113.{n}:443" for n in (0, 1)]
R.add("n29_spotlight_nodes", lambda s, d: fx.animation_nodes(untimed(s, d), HOSTS).select("id", "type", "is_spotlight"),
    UNTIMED + f", c AS (SELECT * FROM e WHERE dst_id IN ({', '.join(map(repr, HOSTS))})) SELECT DISTINCT id, CASE WHEN starts_with(id, 'fx:net') THEN 'endpoint' ELSE 'process' END AS type, id IN ({', '.join(map(repr, HOSTS))}) AS is_spotlight FROM (SELECT src_id AS id FROM c UNION ALL SELECT dst_id FROM c)", packets=False)
