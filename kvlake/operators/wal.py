"""Log framing as DataFrame operators: fragments, checksums, reassembly, recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.scalar import from_le, u32_le

# Fixed values of the log format.
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
HEADER = 7
MAX_DATA = 32_768


def record_type(index: Column, n: Column) -> Column:
    """Type of fragment ``index`` of ``n``."""
    return F.when(n == 1, FULL).when(index == 0, FIRST).when(index == n - 1, LAST).otherwise(MIDDLE).cast("byte")


def fragment(payloads: DataFrame, data: str = "data", entry: str = "entry", limit: int = MAX_DATA) -> DataFrame:
    """Records of each payload: (entry, frag, rtype, len, data).  Empty payloads give none."""
    n = F.ceil(F.length(data) / F.lit(limit)).cast("int")
    rows = payloads.where(F.length(data) > 0).withColumn("_n", n)
    rows = rows.select(entry, data, "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("frag"))
    piece = F.substring(F.col(data), F.col("frag") * limit + 1, F.lit(limit))
    return rows.select(entry, "frag", record_type(F.col("frag"), F.col("_n")).alias("rtype"), F.length(piece).alias("len"), piece.alias("data"))


def checksum(rtype: Column, data: Column) -> Column:
    """CRC-32 over the type byte and the data."""
    byte = F.unhex(F.lpad(F.hex(rtype.cast("long")), 2, "0"))
    return F.crc32(F.concat(byte, data))


def frame(records: DataFrame) -> DataFrame:
    """Records with checksum and encoded header: crc u32, length u16, type u8."""
    crc = checksum(F.col("rtype"), F.col("data"))
    length = F.substring(u32_le(F.col("len")), 1, 2)
    byte = F.unhex(F.lpad(F.hex(F.col("rtype").cast("long")), 2, "0"))
    return records.withColumn("crc", crc).withColumn("header", F.concat(u32_le(F.col("crc")), length, byte))


def reassemble(records: DataFrame, entry: str = "entry") -> DataFrame:
    """Payloads back from records of known entries.

    A payload's fragments are gathered in order; as binary has no ordered
    concatenation they travel as hex.
    """
    parts = F.array_sort(F.collect_list(F.struct("frag", F.hex("data").alias("h"))))
    whole = F.unhex(F.array_join(F.transform(parts, lambda p: p["h"]), ""))
    return records.groupBy(entry).agg(whole.alias("data"), F.count("*").alias("n_records"))


def entries_of(records: DataFrame, log: str = "log") -> DataFrame:
    """Number the entries of raw records by position: a Full or First record starts one."""
    w = Window.partitionBy(log).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.sum(F.col("rtype").isin(FULL, FIRST).cast("long")).over(w)
    frag = F.row_number().over(Window.partitionBy(log, "entry").orderBy("pos")) - 1
    return records.withColumn("entry", starts).withColumn("frag", frag)


def first_bad(records: DataFrame, log: str = "log") -> DataFrame:
    """Position of each log's first corrupt record: a wrong checksum or an illegal order."""
    w = Window.partitionBy(log).orderBy("pos")
    before = F.lag("rtype").over(w)
    open_ = before.isin(FIRST, MIDDLE)
    follows = F.when(F.col("rtype").isin(FULL, FIRST), ~F.coalesce(open_, F.lit(False))).when(F.col("rtype").isin(MIDDLE, LAST), F.coalesce(open_, F.lit(False))).otherwise(F.lit(False))
    good = follows & (F.col("crc") == checksum(F.col("rtype"), F.col("data")))
    return records.withColumn("_ok", good).where("not _ok").groupBy(log).agg(F.min("pos").alias("bad_pos"))


def recover_prefix(records: DataFrame, log: str = "log") -> DataFrame:
    """Records before each log's first corrupt one, complete entries only."""
    bad = first_bad(records, log)
    good = records.join(bad, log, "left").where("bad_pos is null or pos < bad_pos").drop("bad_pos")
    numbered = entries_of(good, log)
    whole = F.max(F.col("rtype").isin(FULL, LAST).cast("int")).over(Window.partitionBy(log, "entry"))
    return numbered.withColumn("_whole", whole).where("_whole = 1").drop("_whole")


def offsets(records: DataFrame, log: str = "log") -> DataFrame:
    """Byte offset of each record in its log."""
    w = Window.partitionBy(log).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.col("len") + HEADER).over(w), F.lit(0)).cast("long"))


def payload(op: Column, key: Column, value: Column) -> Column:
    """Log payload of one operation."""
    colon = F.lit(b":")
    head = F.concat(u32_le(F.length(key)), colon, key)
    return F.when(op == 1, F.concat(F.lit(b"put:"), head, colon, value)).otherwise(F.concat(F.lit(b"del:"), head))


def parse_payload(data: Column) -> Column:
    """(op, key, value) of a log payload; null if it is malformed."""
    n = from_le(F.substring(data, 5, 4), 4)
    kind = F.substring(data, 1, 4)
    key = F.substring(data, F.lit(10), n.cast("int"))
    value = F.substring(data, (n + 11).cast("int"), F.length(data))
    sized = (F.length(data) >= 9) & (F.substring(data, 9, 1) == F.lit(b":"))
    put = sized & (kind == F.lit(b"put:")) & (F.length(data) >= n + 10) & (F.substring(data, (n + 10).cast("int"), F.lit(1)) == F.lit(b":"))
    gone = sized & (kind == F.lit(b"del:")) & (F.length(data) == n + 9)
    none = F.lit(None).cast("binary")
    return F.when(put, F.struct(F.lit(1).cast("byte").alias("op"), key.alias("key"), value.alias("value"))).when(gone, F.struct(F.lit(0).cast("byte").alias("op"), key.alias("key"), none.alias("value")))


def log_name(number: Column) -> Column:
    return F.format_string("%06d.log", number)


def log_number(name: Column) -> Column:
    """Number of a log file name, null for other names."""
    return F.regexp_extract(name, r"^(\d+)\.log$", 1).try_cast("long")
