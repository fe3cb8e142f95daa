"""Lines of the four log formats as rows of the base tables, and what had to be rejected.

Each parser takes lines of its kind and gives (rows, rejects): rows carry
file_date, file_path and line_no, by which the first of repeated rows wins;
rejects are (file_path, reason), one row for each rejected line or file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import column_name
from ..schema import REJECT_COLUMNS, REJECT_DATE, REJECT_HEADER, REJECT_NUMBER, SAR_ACTIVITIES

ORDER = ("file_date", "file_path", "line_no")
Parsed = tuple[DataFrame, DataFrame]

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SLASHES = r"^\s*(\d{4})/(\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"
_QUEUE_TIME = r"^\s*(\d{4})[-/](\d{2})[-/](\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?::\d+)?\s*$"
_SAR_TIME = r"^\s*(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})(?:\s+\S+)?\s*$"


def at(fields: Column, i: int | Column) -> Column:
    """The i-th field without blanks around it, null beyond the end."""
    return F.trim(F.get(fields, i if isinstance(i, Column) else F.lit(i)))


def _null(token: Column) -> Column:
    return token.isNull() | token.isin("", "-")


def is_number(token: Column) -> Column:
    """Numbers, and what stands for none: nothing or a dash. nan and inf are none of them."""
    return _null(token) | token.rlike(_NUMBER)


def number(token: Column) -> Column:
    return F.when(~_null(token) & token.rlike(_NUMBER), token.cast("double"))


def whole(token: Column) -> Column:
    """A number without its decimals."""
    return F.expr("bigint(0)") + number(token).cast("bigint")


def time(token: Column, pattern: str) -> Column:
    part = [F.nullif(F.regexp_extract(token, pattern, i), F.lit("")).cast("int") for i in range(1, 7)]
    return F.call_function("try_make_timestamp", *part[:5], part[5].cast("decimal(8,6)")).cast("timestamp_ntz")


def _split(rows: DataFrame, bad: DataFrame) -> Parsed:
    """Rows without a reason, and the reasons of the others and of whole files."""
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("file_path", "reason").unionByName(bad)


def _undecoded(lines: DataFrame) -> DataFrame:
    return lines.where("line_no < 0").select("file_path", F.lit(REJECT_HEADER).alias("reason"))


def _blank(fields: Column) -> Column:
    return (F.size(fields) == 0) | ((F.size(fields) == 1) & (at(fields, 0) == ""))


def db_connection(lines: DataFrame) -> Parsed:
    f = F.col("fields")
    rows = lines.where((F.col("line_no") > 0) & ~_blank(f))
    reason = (
        F.when(F.size(f) != 5, REJECT_COLUMNS)
        .when(time(F.get(f, F.lit(0)), _SLASHES).isNull(), REJECT_DATE)
        .when(~is_number(at(f, 2)) | ~is_number(at(f, 4)), REJECT_NUMBER)
    )
    rows = rows.select(
        *ORDER, time(F.get(f, F.lit(0)), _SLASHES).alias("ts"), at(f, 1).alias("host"), whole(at(f, 2)).cast("int").alias("port"),
        at(f, 3).alias("datasource"), whole(at(f, 4)).alias("active_connections"), reason.alias("reason"),
    )
    return _split(rows, _undecoded(lines))


#: Columns after time and uptime, by the number of values with time as one.
_GCUTIL = ("s0u", "s1u", "eu", "ou", "mu", "ccsu", "ygc", "ygct", "fgc", "fgct", "gct")
_GC = ("s0c", "s1c", "s0u", "s1u", "ec", "eu", "oc", "ou", "mc", "mu", "ccsc", "ccsu", "ygc", "ygct", "fgc", "fgct", "gct")
_LAYOUTS = {12: ("gcutil", _GCUTIL), 18: ("gc", _GC), 17: ("gc", tuple(c for c in _GC if c != "ccsu"))}


def jvm_gc(lines: DataFrame) -> Parsed:
    """The number of values in a file's first row of data tells its layout."""
    read = lines.where("line_no >= 0").withColumn("n", F.size("fields") - 2)
    first = read.groupBy("file_path").agg(
        F.min("line_no").alias("header"), F.min_by("n", F.when((F.col("line_no") > 0) & (F.col("n") >= 1), F.col("line_no"))).alias("layout"),
        F.min_by(F.transform("fields", lambda x: F.upper(x)), "line_no").alias("names"),
    )
    known = F.coalesce(F.col("layout").isin(*_LAYOUTS), F.lit(False))
    bad = first.where(~known).select("file_path", F.lit(REJECT_HEADER).alias("reason"))
    rows = read.join(first.where(known).select("file_path", "layout"), "file_path").where("line_no > 0")
    f = F.col("fields")
    ts = time(F.concat_ws(" ", at(f, 0), at(f, 1)), _SLASHES)
    values = F.slice(f, 3, F.col("layout"))
    reason = (
        F.when((F.size(f) < 3) | (F.col("n") != F.col("layout")), REJECT_COLUMNS)
        .when(ts.isNull(), REJECT_DATE)
        .when(~F.forall(values, is_number), REJECT_NUMBER)
    )

    def column(name: str) -> Column:
        out = F.lit(None).cast("double")
        for n, (_, names) in _LAYOUTS.items():
            if name in names:
                out = F.when(F.col("layout") == n, number(at(f, 3 + names.index(name)))).otherwise(out)
        return (out.cast("bigint") if name in ("ygc", "fgc") else out).alias(name)

    fmt = F.when(F.col("layout") == 12, "gcutil").otherwise("gc")
    rows = rows.select(*ORDER, ts.alias("ts"), "container", "host", number(at(f, 2)).alias("jvm_uptime_sec"), fmt.alias("gc_format"), *(column(c) for c in _GC), reason.alias("reason"))
    return _split(rows, bad.unionByName(_undecoded(lines)))


_QUEUE_FIELDS = ("NJOBS", "PEND", "RUN", "SUSP")


def lsf_queue(lines: DataFrame) -> Parsed:
    """The header tells each queue's columns; a row with one bad number is rejected as a whole."""
    pattern = rf"^(.+)_({'|'.join(_QUEUE_FIELDS)})$"
    header = lines.where("line_no = 0").select("file_path", F.size("fields").alias("width"), F.posexplode("fields").alias("i", "name"))
    name = F.trim("name")
    named = header.where((F.col("i") > 0) & (F.lower(name) != "time") & name.rlike(pattern)).select(
        "file_path", "width", "i", F.regexp_extract(name, pattern, 1).alias("queue"), F.regexp_extract(name, pattern, 2).alias("field")
    )
    queues = named.groupBy("file_path", "width", "queue").agg(*(F.max(F.when(F.col("field") == x, F.col("i"))).alias(x.lower()) for x in _QUEUE_FIELDS))
    layout = queues.groupBy("file_path", "width").agg(F.sort_array(F.collect_list(F.struct("queue", *(x.lower() for x in _QUEUE_FIELDS)))).alias("queues"))
    bad = lines.where("line_no = 0").join(layout, "file_path", "left_anti").select("file_path", F.lit(REJECT_HEADER).alias("reason"))
    f = F.col("fields")
    rows = lines.where((F.col("line_no") > 0) & ~_blank(f)).join(layout, "file_path")
    ts = time(F.get(f, F.lit(0)), _QUEUE_TIME)
    fine = F.forall("queues", lambda q: F.forall(F.array(*(q[x.lower()] for x in _QUEUE_FIELDS)), lambda i: i.isNull() | is_number(at(f, i))))
    reason = F.when(F.size(f) != F.col("width"), REJECT_COLUMNS).when(ts.isNull(), REJECT_DATE).when(~fine, REJECT_NUMBER)
    judged = rows.select(*ORDER, ts.alias("ts"), "host", "fields", "queues", reason.alias("reason"))
    good, rejects = _split(judged, bad.unionByName(_undecoded(lines)))
    each = good.select(*ORDER, "ts", "host", "fields", F.explode("queues").alias("q"))
    values = [whole(at(f, F.col(f"q.{x.lower()}"))).alias(x.lower()) for x in _QUEUE_FIELDS]
    return each.select(*ORDER, "ts", "host", F.col("q.queue").alias("queue"), *values), rejects


#: The column that tells an activity's header, and the device column that must or must not come first.
_FEATURES = {
    "cpu": ("pct_user", "CPU"), "memory": ("kbmemfree", None), "swap_space": ("kbswpfree", None), "io": ("rtps", None), "load": ("runq_sz", None),
    "swapping": ("pswpin_s", None), "disk": ("pct_util", "DEV"), "network": ("rxpck_s", "IFACE"), "nfs": ("retrans_s", None), "nfsd": ("scall_s", None),
}
_DEVICES = ("CPU", "DEV", "IFACE")


def sar(lines: DataFrame, activities: list[str] | None = None) -> Parsed:
    """Blocks with headers of their own; the last header above a row tells its columns.

    A row's metrics before a bad number stay. Blocks of unknown or unwanted
    activities are left out without a word.
    """
    read = lines.where("line_no >= 0")
    heads = read.withColumn("is_head", F.col("line").startswith("#"))
    w = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = heads.withColumn("head", F.last_value(F.when(F.col("is_head"), F.col("fields")), True).over(w)).where(~F.col("is_head") & F.col("head").isNotNull())
    body = F.transform(F.slice("head", 4, F.greatest(F.size("head") - 3, F.lit(0))), lambda x: column_name(F.trim(x)))
    rows = rows.withColumn("names", body).withColumn("lead", at(F.col("head"), 3))
    activity = F.lit(None).cast("string")
    for name, (feature, device) in reversed(_FEATURES.items()):
        led = F.col("lead") == device if device else ~F.col("lead").isin(*_DEVICES)
        activity = F.when(F.array_contains("names", feature) & led, name).otherwise(activity)
    rows = rows.withColumn("activity", activity).where(F.col("activity").isin(*(SAR_ACTIVITIES if activities is None else activities)))
    wanted = F.create_map(*(x for a, names in SAR_ACTIVITIES.items() for x in (F.lit(a), F.array(*map(F.lit, names)))))[F.col("activity")]
    f = F.col("fields")
    tokens = F.transform(wanted, lambda n: F.struct(n.alias("metric"), (F.array_position("names", n) + 2).cast("int").alias("i")))
    tokens = F.filter(tokens, lambda x: (x["i"] > 2) & (x["i"] < F.size(f)))
    tokens = F.transform(tokens, lambda x: F.struct(x["metric"].alias("metric"), at(f, x["i"]).alias("token")))
    ts = time(F.get(f, F.lit(2)), _SAR_TIME)
    with_device = F.col("activity").isin(*(a for a, (_, d) in _FEATURES.items() if d))
    rows = rows.select(
        *ORDER, ts.alias("ts"), F.coalesce("host", F.lit("")).alias("host"), "activity",
        F.when(with_device, F.coalesce(F.nullif(at(f, 3), F.lit("")), F.lit("-"))).otherwise("-").alias("device"), tokens.alias("tokens"), F.size(f).alias("n"),
    )
    first_bad = F.array_position(F.transform("tokens", lambda x: is_number(x["token"])), False)
    rows = rows.withColumn("bad", first_bad)
    dated = (F.col("n") > 3) & F.col("ts").isNotNull()
    reason = F.when(F.col("n") <= 3, REJECT_COLUMNS).when(F.col("ts").isNull(), REJECT_DATE).when(F.col("bad") > 0, REJECT_NUMBER)
    rejects = rows.select("file_path", reason.alias("reason")).where("reason is not null")
    headless = lines.groupBy("file_path").agg(F.max(F.col("line").startswith("#")).alias("h"), F.min("line_no").alias("l")).where("not h and l >= 0").select("file_path", F.lit(REJECT_HEADER).alias("reason"))
    kept = F.when(F.col("bad") > 0, F.slice("tokens", F.lit(1), (F.col("bad") - 1).cast("int"))).otherwise(F.col("tokens"))
    each = rows.where(dated).select(*ORDER, "ts", "host", "activity", "device", F.explode(kept).alias("x"))
    out = each.select(*ORDER, "ts", "host", "activity", "device", F.col("x.metric").alias("metric"), number(F.col("x.token")).alias("value"))
    return out, rejects.unionByName(headless).unionByName(_undecoded(lines))


def sar_warnings(lines: DataFrame, zone: str) -> DataFrame:
    """Rows (file_path, message): headers of unknown activities, and zones of times that differ from the settings."""
    read = lines.where("line_no >= 0")
    is_head = F.col("line").startswith("#")
    names = F.transform(F.slice("fields", 4, F.greatest(F.size("fields") - 3, F.lit(0))), lambda x: column_name(F.trim(x)))
    known = F.lit(False)
    for feature, device in _FEATURES.values():
        lead = at(F.col("fields"), 3)
        known = known | (F.array_contains(names, feature) & ((lead == device) if device else ~lead.isin(*_DEVICES)))
    strange = read.where(is_head & ~F.coalesce(known, F.lit(False))).select("file_path", F.concat(F.lit("unknown sar header "), F.substring("line", 1, 120)).alias("message")).distinct()
    said = F.regexp_extract(F.get("fields", F.lit(2)), r"^\s*\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\s+(\S+)\s*$", 1)
    other = read.where(~is_head & (said != "") & (said != zone)).select("file_path", F.concat(F.lit("times are marked "), said, F.lit(f", the settings say {zone}")).alias("message")).distinct()
    return strange.unionByName(other)
