"""Sharding by a k-d tree over document metadata.

A node holding ``k`` shards' worth of bytes is split, along the metadata
dimension in which its rows spread widest, at the value below which
``k // 2`` of the ``k`` shares lie: a weighted median found by histograms that
narrow down until the cut is exact enough.  All nodes of a level share one
aggregate per round, of at most nodes x bins rows.  Splitting stops when a node
holds the bytes of one shard.

Rows that tie in a dimension are cut by a hash of their content, so shards stay
near equal however few values a dimension has.  Each level's cuts are a small
table, a row per node, that is joined to the rows; the level is then stored.

Slots are dealt by (shard, hash bucket) with prefix sums over bucket counts, so
numbering a shard is not one task's work.

Defined results: a null text has no bytes (size 1); null metadata is a value of
its own, below all others.  Repeated rows are separate rows with own slots.  A
very long text counts by its bytes only.  An empty table gives no rows.  Other
columns of ``docs`` are not returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.common import store

BINS = 1024
TOLERANCE = 0.0005
ROWS_PER_BUCKET = 20_000
MAX_SENT = 100_000  # rows of about 40 bytes


def ordered_code(value: Column, kind: str) -> Column:
    """A non-negative long in the order of the values: numbers by value, texts
    by their first seven bytes; null is 0."""
    if kind in ("string", "binary"):
        head = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0")
        code = F.conv(head, 16, 10).cast("long")
    else:
        # doubles below 2**53 keep integers exact
        code = F.floor(F.least(F.greatest(value.cast("double"), F.lit(-(2.0**52))), F.lit(2.0**52))).cast("long") + F.lit(2**53)
    return F.coalesce(code, F.lit(0))


@dataclass
class Node:
    shards: int
    first: int
    dim: int | None = None
    low: int = 0  # range of the cut value still in question
    width: int = 1
    tie: int | None = None  # the dimension's value being cut by hash
    done: bool = False
    weight: int = 0
    below: int = 0
    kids: list[Node] = field(default_factory=list)


def _splits(meta: DataFrame, nodes: dict[int, Node], dims: list[str], spans: list[int], bins: int, tolerance: float) -> None:
    """Find each node's cut; ``meta`` has the node number of each row."""
    spark = meta.sparkSession
    ranges = meta.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    for r in ranges.collect():  # a row per node
        node = nodes.get(r["node"])
        if node is None:
            continue
        node.weight = r["w"]
        wide = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / s for d, s in zip(dims, spans)]
        node.dim = max(range(len(dims)), key=lambda i: wide[i])
        node.low, node.width = r[f"lo_{dims[node.dim]}"], r[f"hi_{dims[node.dim]}"] - r[f"lo_{dims[node.dim]}"] + 1
    for n in nodes.values():
        n.done = n.dim is None
    while open_ := {k: n for k, n in nodes.items() if not n.done}:
        steps = {k: -(-n.width // bins) for k, n in open_.items()}
        targets = {k: n.weight * (n.shards // 2) / n.shards for k, n in open_.items()}
        asked = spark.createDataFrame(
            [(k, n.dim, n.tie, n.low, n.width, steps[k], float(targets[k] - n.below)) for k, n in open_.items()], "node int, dim int, tie long, low long, width long, step long, need double"
        )
        rows = meta.join(_few(asked, len(open_)), "node")
        value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
        value = F.when(F.col("tie").isNull(), value).when(value == F.col("tie"), F.col("hash"))
        bin_ = F.floor((value - F.col("low")) / F.col("step")).cast("int")
        sums = rows.withColumn("v", value).where("v >= low and v < low + width").withColumn("bin", bin_).groupBy("node", "bin").agg(F.sum("size").alias("w"), F.first("need").alias("need"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # at most ``bins`` rows a node
        one = F.struct("bin", "w", (F.col("upto") - F.col("w")).alias("under"))
        crossed = sums.withColumn("upto", upto).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), one)), F.max(one)).alias("c"))
        found = {r["node"]: r["c"] for r in crossed.collect()}  # a row per node
        for k, node in open_.items():
            at, target = found.get(k), targets[k]
            if at is None:
                node.done = True
                continue
            under = node.below + at["under"]
            low, w = node.low + at["bin"] * steps[k], at["w"]
            exact = min(target - under, under + w - target) <= tolerance * target
            if exact or (steps[k] == 1 and node.tie is not None):
                node.low = low if target - under <= under + w - target else low + steps[k]
                node.done = True
            elif steps[k] == 1:
                node.below, node.tie, node.low, node.width = under, low, 0, 1 << 62
            else:
                node.below, node.low, node.width = under, low, steps[k]


def _few(rows: DataFrame, n: int) -> DataFrame:
    """Sent to all tasks while they are at most ``MAX_SENT`` rows; else joined by Spark's choice."""
    return F.broadcast(rows) if n <= MAX_SENT else rows


def _descend(rows: DataFrame, live: dict[int, Node], dims: list[str]) -> DataFrame:
    """``rows`` with the node of the next level, by each node's cut."""
    spark = rows.sparkSession
    cuts = [(k, n.dim, n.tie, n.low, n.kids[1].first - n.first) for k, n in live.items() if n.dim is not None]
    if not cuts:
        return rows
    cut = spark.createDataFrame(cuts, "node int, dim int, tie long, low long, shift int")
    joined = rows.join(_few(cut, len(cuts)), "node", "left")
    value = F.coalesce(*[F.when(F.col("dim") == i, F.col(d)) for i, d in enumerate(dims)])
    right = F.when(F.col("tie").isNull(), value >= F.col("low")).otherwise((value > F.col("tie")) | ((value == F.col("tie")) & (F.col("hash") >= F.col("low"))))
    return store(joined.withColumn("node", (F.col("node") + F.when(right, F.col("shift")).otherwise(0)).cast("int")).select(*rows.columns))


def shard(
    docs: DataFrame, metadata: list[str], n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, tolerance: float = TOLERANCE
) -> DataFrame:
    """A row per document: id, size, text_crc32, shard and slot.

    Give ``n_shards``, or ``target_bytes`` a shard.  ``metadata`` names columns of
    ``docs``; the size is always a dimension too.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = dict(docs.dtypes)
    dims = [f"d{i}" for i in range(len(metadata) + 1)]
    meta = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        *[ordered_code(F.col(f"`{c}`"), kinds[c]).alias(dims[i]) for i, c in enumerate(metadata)],
    )
    meta = meta.withColumn(dims[-1], F.floor(F.log2(F.col("size").cast("double")) * 64).cast("long"))
    # the last bits tell repeated rows apart; they are fixed once stored
    spread = F.shiftrightunsigned(F.xxhash64("id", "crc", "size"), 2)
    last = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 20) - 1))
    meta = store(meta.withColumn("hash", spread.bitwiseAND(F.lit(~((1 << 20) - 1))).bitwiseOR(last)).withColumn("node", F.lit(0)))
    whole = meta.agg(F.count("*").alias("n"), F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    if n_shards is None:
        n_shards = max(1, round((whole["w"] or 0) / target_bytes))
    spans = [max(1, whole[d] or 0) for d in dims]
    root = Node(n_shards, 0)
    level = {0: root}
    out = meta
    while live := {k: n for k, n in level.items() if n.shards > 1}:
        _splits(out, live, dims, spans, bins, tolerance)
        after = {k: n for k, n in level.items() if k not in live}
        for n in live.values():
            n.kids = [Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)]
            after |= {kid.first: kid for kid in n.kids}
        out = _descend(out, live, dims)
        level = after
    buckets = max(1, (whole["n"] or 0) // (ROWS_PER_BUCKET * n_shards))
    out = out.withColumn("bucket", F.pmod(F.xxhash64("hash"), F.lit(buckets)))
    counts = out.groupBy("node", "bucket").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("node").alias("sn"), F.col("bucket").alias("sb"), F.coalesce(ahead, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("id", "hash"))
    out = out.withColumn("rank", rank).join(starts, (F.col("node") == F.col("sn")) & (F.col("bucket") == F.col("sb")))
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("node").alias("shard"), (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))
