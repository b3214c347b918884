"""Endpoint events: dissecting raw records, the typed graph, classifiers and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capturelake.operators import numbering

EDGE_TYPES = {"process_create": "spawned", "network_connect": "connected", "file_create": "wrote", "registry_set": "set_value"}
ENTITY = "struct<type:string,guid:string,image:string,pid:string,user:string,path:string,key:string,ip:string,port:int,hostname:string>"
# Hive prefixes, registry categories (first prefix wins), script extensions and path fragments (first wins), living-off-the-land binaries.
HIVES = ("hkey_local_machine\\", "hkey_current_user\\", "hkey_users\\", "hkey_classes_root\\", "hkey_current_config\\", "hklm\\", "hkcu\\", "hku\\", "hkcr\\")
REGISTRY = (
    ("software\\microsoft\\windows\\currentversion\\run", "Autostart"),
    ("software\\wow6432node\\microsoft\\windows\\currentversion\\run", "Autostart"),
    ("software\\microsoft\\windows nt\\currentversion\\winlogon", "Winlogon hook"),
    ("system\\currentcontrolset\\control\\session manager\\bootexecute", "Boot execute"),
    ("software\\microsoft\\windows nt\\currentversion\\schedule", "Scheduled task"),
    ("system\\currentcontrolset\\services", "Service"),
    ("software\\microsoft\\windows nt\\currentversion\\image file execution options", "IFEO"),
    ("software\\microsoft\\windows nt\\currentversion\\windows\\appinit_dlls", "AppInit DLL"),
    ("software\\classes\\clsid", "COM object"),
    ("software\\classes", "File association"),
    ("software\\policies", "Group policy"),
    ("software\\microsoft\\windows\\currentversion\\policies", "Local policy"),
    ("system\\currentcontrolset\\control\\network", "Network config"),
    ("system\\currentcontrolset\\services\\tcpip", "TCP/IP config"),
    ("software\\microsoft", "Microsoft software"),
    ("software", "Software settings"),
    ("system", "System config"),
)
EXTENSIONS = ((".ps1", "PowerShell script"), (".psm1", "PowerShell module"), (".psd1", "PowerShell data"), (".vbs", "VBScript"), (".js", "JScript"), (".wsf", "Windows Script"), (".hta", "HTML Application"), (".bat", "Batch script"), (".cmd", "Batch script"), (".dll", "DLL"))
FRAGMENTS = (
    ("\\windows\\system32\\", "System process"), ("\\windows\\syswow64\\", "System process"), ("\\windows\\sysnative\\", "System process"), ("\\windows\\", "Windows component"),
    ("\\windowsapps\\", "Store app"), ("\\program files (x86)\\", "Installed app"), ("\\program files\\", "Installed app"), ("\\appdata\\roaming\\", "User AppData"),
    ("\\appdata\\local\\", "User AppData"), ("\\users\\", "User directory"), ("\\temp\\", "Temp directory"), ("\\tmp\\", "Temp directory"),
)
LOLBINS = {
    "Scripting host": "powershell.exe powershell_ise.exe wscript.exe cscript.exe mshta.exe",
    "Code loader": "rundll32.exe regsvr32.exe regasm.exe regsvcs.exe installutil.exe msiexec.exe odbcconf.exe",
    "Download tool": "certutil.exe bitsadmin.exe expand.exe esentutl.exe",
    "Recon / admin": "wmic.exe whoami.exe systeminfo.exe ipconfig.exe net.exe net1.exe nltest.exe dsquery.exe quser.exe tasklist.exe netstat.exe",
    "Persistence": "schtasks.exe at.exe sc.exe reg.exe",
    "Shell": "cmd.exe",
    "Execution proxy": "forfiles.exe pcalua.exe syncappvpublishingserver.exe appsyncpublishingserver.exe",
    "Credential access": "ntdsutil.exe procdump.exe mimikatz.exe",
}


def entity(kind: str, **fields: Column) -> Column:
    names = ("type", "guid", "image", "pid", "user", "path", "key", "ip", "port", "hostname")
    none = F.lit(None)
    return F.struct(*[(F.lit(kind) if n == "type" else fields.get(n, none).cast("int" if n == "port" else "string")).alias(n) for n in names])


def dissect(raw: DataFrame) -> DataFrame:
    """Events (action_type, ts, src, dst, computer, eid) of records (eid, computer, time_created, event_data): process start, connection, file and registry writes.

    A connection's far side is the destination if this host opened it, else the source.
    """
    g = lambda k: F.col("event_data")[k]
    actor = entity("process", guid=g("ProcessGuid"), image=g("Image"), pid=g("ProcessId"), user=g("User"))
    parent = entity("process", guid=g("ParentProcessGuid"), image=g("ParentImage"), pid=g("ParentProcessId"), user=g("ParentUser"))
    out = F.lower(F.coalesce(g("Initiated"), F.lit("true"))) == "true"
    far = lambda name: F.when(out, g(f"Destination{name}")).otherwise(g(f"Source{name}"))
    endpoint = entity("endpoint", ip=far("Ip"), port=far("Port").try_cast("int"), hostname=far("Hostname"))
    eid = F.col("eid")
    action = F.when(eid == 1, "process_create").when(eid == 3, "network_connect").when(eid == 11, "file_create").when(eid == 13, "registry_set")
    target = F.when(eid == 1, actor).when(eid == 3, endpoint).when(eid == 11, entity("file", path=g("TargetFilename"))).when(eid == 13, entity("registry", key=g("TargetObject")))
    rows = raw.where(eid.isin(1, 3, 11, 13))
    return rows.select(action.alias("action_type"), F.col("time_created").alias("ts"), F.when(eid == 1, parent).otherwise(actor).alias("src"), target.alias("dst"), "computer", "eid")


def processes(table: DataFrame, computer: str = "") -> DataFrame:
    """Events parent -> child of a process list (Pid, PPid, Name, Exe, CreateTime, Username); parents are looked up in it."""
    parents = table.select(F.col("Pid").alias("_p"), F.coalesce("Exe", "Name").alias("_image")).groupBy("_p").agg(F.min("_image").alias("_image"))
    rows = table.join(parents, F.col("PPid") == F.col("_p"), "left")
    src = entity("process", image=F.coalesce("_image", F.lit("")), pid=F.col("PPid"))
    dst = entity("process", image=F.coalesce("Exe", "Name"), pid=F.col("Pid"), user=F.col("Username"))
    return rows.select(F.lit("process_create").alias("action_type"), F.col("CreateTime").try_cast("timestamp").alias("ts"), src.alias("src"), dst.alias("dst"), F.lit(computer).alias("computer"), F.lit(1).alias("eid"))


def connections(table: DataFrame, names: DataFrame, computer: str = "") -> DataFrame:
    """Events of a socket table (Pid, Status, RemoteIP, RemotePort, Timestamp) with names from ``names(Pid, Exe)``: no listeners, loopback or port 0."""
    known = names.groupBy(F.col("Pid").alias("_p")).agg(F.min("Exe").alias("_image"))
    rows = table.where("RemotePort > 0 and not RemoteIP like '127.%' and RemoteIP not in ('', '0.0.0.0', '::', '::1') and upper(Status) not in ('LISTEN', 'LISTENING', 'NONE')").join(known, F.col("Pid") == F.col("_p"), "left")
    return rows.select(F.lit("network_connect").alias("action_type"), F.col("Timestamp").try_cast("timestamp").alias("ts"), entity("process", image=F.coalesce("_image", F.lit("")), pid=F.col("Pid")).alias("src"), entity("endpoint", ip=F.col("RemoteIP"), port=F.col("RemotePort")).alias("dst"), F.lit(computer).alias("computer"), F.lit(3).alias("eid"))


def entity_id(e: Column, computer: Column) -> Column:
    """fx:proc, fx:file, fx:reg or fx:net id; null where the entity has nothing to be named by."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    image, pid = F.coalesce(e["image"], F.lit("")), F.coalesce(e["pid"], F.lit(""))
    host = F.when(some(computer), computer).otherwise("unknown")
    process = F.when(some(e["guid"]), F.concat(F.lit("fx:proc:"), e["guid"])).when((image != "") | (pid != ""), F.concat_ws(":", F.lit("fx:proc"), host, image, pid))
    name = F.when(some(e["ip"]), e["ip"]).when(some(e["hostname"]), e["hostname"])
    endpoint = F.when(name.isNotNull(), F.concat_ws(":", F.lit("fx:net"), name, e["port"].cast("string")))
    return (
        F.when(e["type"] == "process", process).when((e["type"] == "file") & some(e["path"]), F.concat(F.lit("fx:file:"), F.lower(e["path"])))
        .when((e["type"] == "registry") & some(e["key"]), F.concat(F.lit("fx:reg:"), F.lower(e["key"]))).when(e["type"] == "endpoint", endpoint)
    )


def with_ids(events: DataFrame) -> DataFrame:
    """Adds src_id and dst_id; events without both go."""
    # through a one-element array: the entity is built once a row, not once for each of its fields
    named = lambda side: F.get(F.transform(F.array(side), lambda e: entity_id(e, F.col("computer"))), F.lit(0))
    return events.withColumns({"src_id": named("src"), "dst_id": named("dst")}).where("src_id is not null and dst_id is not null")


def edges(events: DataFrame) -> DataFrame:
    """One edge a pair: type of its actions or 'mixed', count, first and last time, events in time order."""
    table = F.create_map(*[F.lit(x) for kv in EDGE_TYPES.items() for x in kv])
    kind = F.coalesce(F.element_at(table, F.col("action_type")), F.lit("unknown"))
    return with_ids(events).groupBy("src_id", "dst_id").agg(
        F.when(F.min(kind) == F.max(kind), F.min(kind)).otherwise("mixed").alias("type"), F.count(F.lit(1)).alias("count"), F.min("ts").alias("ts_first"), F.max("ts").alias("ts_last"),
        F.array_sort(F.collect_list(F.struct("ts", "action_type"))).alias("events"),
    )


def nodes(events: DataFrame) -> DataFrame:
    """One node an entity: fields filled from its earliest event that has them, event count, connections and children."""
    rows = with_ids(events)
    half = F.explode(F.array(F.struct(F.col("src_id").alias("id"), F.col("src").alias("e")), F.struct(F.col("dst_id").alias("id"), F.col("dst").alias("e"))))
    first = lambda c: F.min_by(F.col(f"h.e.{c}"), F.when(F.coalesce(F.col(f"h.e.{c}").cast("string"), F.lit("")) != "", F.struct("ts", F.col(f"h.e.{c}")))).alias(c)
    out = rows.select(half.alias("h"), "ts").groupBy("h.id").agg(F.min("h.e.type").alias("type"), *[first(c) for c in ("image", "pid", "user", "path", "key", "ip", "port", "hostname")], F.count(F.lit(1)).alias("event_count"))
    counts = edges(events).groupBy(F.col("src_id").alias("_s")).agg(F.count_if(F.col("type") == "connected").alias("connection_count"), F.count_if(F.col("type") == "spawned").alias("child_count"))
    out = out.join(counts, F.col("id") == F.col("_s"), "left").drop("_s").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("connection_count", "child_count")})
    label = F.when(F.col("type") == "process", basename(F.col("image"))).when(F.col("type") == "file", basename(F.col("path"))).when(F.col("type") == "registry", basename(F.col("key"))).otherwise(F.coalesce("hostname", "ip"))
    return out.withColumn("label", F.when(F.coalesce(label, F.lit("")) != "", label).otherwise(F.col("id")))


def basename(path: Column) -> Column:
    """The last part, split at both kinds of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -1)


def in_window(found: DataFrame, start=None, end=None) -> DataFrame:
    """Edges that overlap the window; edges without a time stay."""
    out = F.col("ts_first").isNull() | F.col("ts_last").isNull()
    inside = F.lit(True)
    if start is not None:
        inside &= F.col("ts_last") >= F.lit(start)
    if end is not None:
        inside &= F.col("ts_first") <= F.lit(end)
    return found.where(out | inside)


def _first(text: Column, rules, test) -> Column:
    out = F.lit(None).cast("string")
    for fragment, label in reversed(rules):
        out = F.when(test(text, fragment), label).otherwise(out)
    return out


def registry_category(key: Column) -> Column:
    low = F.replace(F.lower(key), F.lit("/"), F.lit("\\"))
    bare = low
    for hive in HIVES:
        bare = F.when(low.startswith(hive), F.substring(low, len(hive) + 1, 1 << 20)).otherwise(bare)
    return _first(bare, REGISTRY, lambda t, f: t.startswith(f))


def binary_type(image: Column) -> Column:
    low = F.lower(image)
    by_path = _first(low, FRAGMENTS, lambda t, f: t.contains(f))
    return F.coalesce(_first(low, EXTENSIONS, lambda t, f: t.endswith(f)), by_path)


def lolbin(image: Column) -> Column:
    """Category of a living-off-the-land binary, by its name."""
    pairs = [x for c, names in LOLBINS.items() for n in names.split() for x in (F.lit(n), F.lit(c))]
    return F.element_at(F.create_map(*pairs), F.lower(basename(image)))


def process_gantt(events: DataFrame) -> DataFrame:
    """Bars of processes: from the first start to the last event, at least a second."""
    rows = with_ids(events)
    seen = rows.select(F.explode(F.array("src_id", "dst_id")).alias("id"), "ts").groupBy("id").agg(F.max("ts").alias("last"))
    starts = rows.where("action_type = 'process_create'").groupBy(F.col("dst_id").alias("id")).agg(F.min("ts").alias("start"))
    return starts.join(seen, "id").select("id", "start", F.greatest("last", F.col("start") + F.expr("interval 1 second")).alias("end"))


def action_timeline(events: DataFrame, action: str) -> DataFrame:
    """One action's events with seconds from the first of them."""
    rows = with_ids(events).where(F.col("action_type") == action)
    first = F.broadcast(rows.agg(F.min("ts").alias("t0")))
    return rows.crossJoin(first).select("src_id", "dst_id", "ts", F.round((F.unix_micros("ts") - F.unix_micros("t0")) / 1e6, 3).alias("seconds"))


def animation(events: DataFrame, spotlight: list[str] | None = None) -> DataFrame:
    """(number, src_id, dst_id, action_type, time) of all events, or of those with an end in ``spotlight``, in one order: events without a time first,
    then by time, pair and action.

    ``number`` counts from 0 over all events; one without a time (or at 0) gets number x 0.001 seconds, so frames differ. Numbers come
    from ranges and their sizes, not from a window in one task.
    """
    rows = with_ids(events)
    if spotlight is not None:
        rows = rows.where(F.col("src_id").isin(spotlight) | F.col("dst_id").isin(spotlight))
    time = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.lit(0.0))
    numbered = numbering.dense(rows.select("src_id", "dst_id", "action_type", time.alias("time")), "time", "src_id", "dst_id", "action_type")
    return numbered.withColumn("time", F.when(F.col("time") == 0, F.col("number") * 0.001).otherwise(F.col("time")))


def animation_nodes(events: DataFrame, spotlight: list[str] | None = None) -> DataFrame:
    """(id, label, type, is_spotlight) of the ends of the animation's events."""
    chosen = F.col("id").isin(spotlight) if spotlight else F.lit(False)
    found = nodes(events).select("id", "label", "type", chosen.alias("is_spotlight"))
    if spotlight is None:
        return found
    rows = with_ids(events).where(F.col("src_id").isin(spotlight) | F.col("dst_id").isin(spotlight))
    ends = rows.select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct()
    return found.join(ends, "id", "left_semi")
