"""Uniform shuffle into shards of exact size, planned by a communication matrix; built-in functions only.

Rows belong to source partitions by a seeded draw of their content.  The number of rows that each
partition sends to each shard follows the multivariate hypergeometric law of a uniform
shuffle; the matrix is drawn by halving: the rows of a node of a binary tree over the
partitions are divided between its two children, one conditional hypergeometric draw per
shard, so every level is one small DataFrame step and no draw waits for another partition.
Rows are permuted inside their partition, the matrix says which stretch goes to which
shard, and rows are permuted again inside the shard (``ranks.gapless``).

All draws come from hashes of a seed, so a task that is run again deals the same rows.
Law ``rows``: shard sizes differ by one row at most.  Defined results: a null text has size
1 (its end byte) and the CRC-32 of an empty text; equal rows are numbered first and dealt like different ones; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions.settle import settle
from plumbline.llm.ranks import bits_for, copies, gapless, leading

#: Half width of the range that a draw considers, in standard deviations (beyond it: less than 1e-18).
DEVIATIONS = 9


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the hash of its parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Number of good ones among ``draws`` of ``total``, by inversion around the mean."""
    t, g, d = (c.cast("double") for c in (total, good, draws))
    mean = F.when(total > 0, d * g / t).otherwise(0.0)
    variance = F.when(total > 1, mean * (1 - g / t) * (t - d) / (t - 1)).otherwise(0.0)
    reach = F.ceil(F.sqrt(variance) * DEVIATIONS).cast("long") + 3
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean).cast("long") - reach)
    high = F.least(good, draws, F.floor(mean).cast("long") + reach)

    def following(k: Column) -> Column:
        """Weight of k + 1 over weight of k."""
        return (g - k) * (d - k) / ((k + 1.0) * (t - g - d + k + 1.0))

    def inverted(values: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(values, start, lambda s, k: F.struct((s["w"] * following(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])

        def find(mass: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.element_at(values, 1).alias("k"))
            step = lambda s, k: F.struct(
                (s["w"] * following(k)).alias("w"),
                (s["sum"] + s["w"]).alias("sum"),
                F.when(s["sum"] <= u * mass, k).otherwise(s["k"]).alias("k"),
            )
            return F.aggregate(values, begin, step, lambda s: s["k"])

        return let(whole, find)

    return let(F.sequence(low, high), inverted)


def first_child(node: Column, sizes: Column, rows: Column, seed: int) -> Column:
    """How many rows of each shard come from the first child, which has ``rows`` rows, of a node that sends ``sizes``."""
    sum_of = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(sum_of(sizes).alias("total"), rows.alias("draws"), F.array().cast("array<long>").alias("out"))

    def step(state: Column, shard: Column) -> Column:
        good = F.element_at(sizes, (shard + 1).cast("int"))
        draw = hypergeometric(state["total"], good, state["draws"], uniform(F.lit(seed), node, shard))
        return let(
            draw,
            lambda k: F.struct(
                (state["total"] - good).alias("total"), (state["draws"] - k).alias("draws"), F.concat(state["out"], F.array(k)).alias("out")
            ),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start, step, lambda s: s["out"])


def communication_matrix(leaves: DataFrame, bits: int, sizes: list[int], seed: int) -> DataFrame:
    """(part, sends): rows that each of 2**bits partitions sends to each shard; ``leaves``: (part, n)."""
    spark = leaves.sparkSession
    nodes = spark.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(s).cast("long") for s in sizes]).alias("sends"))
    for level in range(1, bits + 1):
        firsts = (
            leaves.select(F.shiftright("part", bits - level).alias("child"), "n")
            .where(F.col("child") % 2 == 0)
            .groupBy(F.shiftright("child", 1).alias("node"))
            .agg(F.sum("n").alias("rows"))
        )
        split = nodes.join(firsts, "node", "left").withColumn(
            "first", first_child(F.col("node") + (1 << level), F.col("sends"), F.coalesce("rows", F.lit(0).cast("long")), seed)
        )
        rest = F.zip_with("sends", "first", lambda a, b: a - b)
        nodes = split.select(
            F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("first").alias("sends")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("sends")))).alias("x")
        ).select("x.node", "x.sends")
        if level % 6 == 0:
            nodes = settle(nodes)  # keeps plans short
    return nodes.select(F.col("node").alias("part"), "sends")


def shuffle(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 16, seed: int = 17, part_rows: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of ``docs``; slots count from 0 in each shard."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = copies(rows, ["doc_id", "size", "text_crc32"])
    key = ["doc_id", "size", "text_crc32", "copy"]
    rows = settle(rows.withColumn("draw", F.xxhash64(F.lit(seed), *key)))
    total = rows.count()
    bits = bits_for(total, part_rows)
    parted = rows.withColumn("part", leading(F.col("draw"), bits))
    leaves = settle(parted.groupBy("part").agg(F.count("*").alias("n")))
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(leaves, bits, sizes, seed)
    edges = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.aggregate(F.slice("sends", 1, s), F.lit(0).cast("long"), lambda a, b: a + b))
    inside = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), *key), *key)
    placed = parted.withColumn("place", F.row_number().over(inside).cast("long")).join(matrix.select("part", edges.alias("edges")), "part")
    sent = placed.select(
        *key,
        F.size(F.filter("edges", lambda e: e < F.col("place"))).alias("shard"),
        F.xxhash64(F.lit(seed + 2), *key).alias("again"),
    )
    return gapless(settle(sent), "shard", "again", key, "slot", total).drop("again", "copy")
