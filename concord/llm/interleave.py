"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row r of n of a source has
the fractional rank (2 r - 1) / 2 n. All rows are sorted by it and cut into runs whose counts
differ by one at most, so every shard, and every prefix of a shard, holds the sources in the
proportions of the whole.

No window runs over a source or over the table. Ranks are counted in buckets of hashes and
positions in buckets of fractional ranks, both about equal in size whatever the sources, and
each bucket's first number comes from counts. Identical rows are one row with a count until
they have their numbers, so a row that is repeated any number of times does not gather in a
task. Everything is DataFrame functions.

A null source is a source of its own. Null and empty texts have size 1; null ids are rows
like others. Identical rows get numbers behind each other, and it does not matter which of
them gets which. Very long texts are only measured. An empty table gives no rows. Columns
beyond those named, whatever their names, are dropped unless they are in ``keep``. The law
that holds is the one of rows: counts of shards differ by one at most, and sizes are as even
as chance makes them. Rows of equal texts are not held together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.sources.paths import materialize

#: Copies of a row are expanded in two steps, so that no array is longer than this.
RUN = 1 << 16
#: What the columns made here are called meanwhile; those of ``keep`` are k0, k1, ...
_HASH, _COPIES, _BUCKET, _KEY = "_hash", "_copies", "_bucket", "_key"


def text_size(text: Column) -> Column:
    """UTF-8 bytes and one more for the end of the text."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_crc(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "utf-8"))


def _buckets(rows: int, bucket_rows: int) -> int:
    """A power of two, so that a bucket has about ``bucket_rows``."""
    return min(1 << 20, max(16, 1 << max(0, -(-rows // bucket_rows) - 1).bit_length()))


def assign(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), bucket_rows: int = 4096) -> DataFrame:
    """(id, source, size, text_crc32, position, shard, slot, and ``keep``) of every row:
    ``position`` counts all rows from 0 in the order of the interleaving, ``slot`` those of a
    shard. ``bucket_rows``: about how many rows a window sorts."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    base = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").alias("source"),
        text_size(F.col(f"`{text_col}`")).alias("size"),
        text_crc(F.col(f"`{text_col}`")).alias("text_crc32"),
        *(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)),
    )
    own = base.columns
    base = base.withColumn(_HASH, F.xxhash64(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "text_crc32"))
    # one row for each that differs, and how often it is there: repeated rows add up before the shuffle
    distinct = materialize(base.groupBy(*own, _HASH).agg(F.count(F.lit(1)).alias(_COPIES)), "interleave-rows")
    distinct = distinct.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))  # the source, never null
    totals = distinct.groupBy(_KEY).agg(F.sum(_COPIES).alias("n"))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    buckets = _buckets(rows, bucket_rows)
    ranked = _ranked(distinct, totals, own, buckets)
    return _placed(ranked, totals, own, rows, buckets, shards).select("id", "source", "size", "text_crc32", "position", "shard", "slot", *(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)))


def _ranked(distinct: DataFrame, totals: DataFrame, own: list[str], buckets: int) -> DataFrame:
    """Every row, copies too, with ``rank`` from 1 among those of its source and their number ``n``."""
    dealt = distinct.withColumn(_BUCKET, F.shiftrightunsigned(F.col(_HASH), 64 - (buckets.bit_length() - 1)))
    before = F.sum("held").over(Window.partitionBy(_KEY).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(_KEY, _BUCKET).agg(F.sum(_COPIES).alias("held")).select(_KEY, _BUCKET, F.coalesce(before, F.lit(0)).alias("start")).join(totals, _KEY)
    order = Window.partitionBy(_KEY, _BUCKET).orderBy(_HASH, *own)
    inside = F.sum(_COPIES).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(_COPIES)
    numbered = dealt.withColumn("_inside", inside).join(counts, [_KEY, _BUCKET])
    first = numbered.select(*own, "n", _COPIES, (F.col("start") + F.col("_inside") + 1).alias("_first"))
    runs = first.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(_COPIES) - 1) / RUN))).alias("_run"))
    last = F.least(F.lit(RUN).cast("bigint"), F.col(_COPIES) - F.col("_run") * RUN) - 1
    return runs.select(*own, "n", "_first", "_run", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_copy")).select(*own, "n", (F.col("_first") + F.col("_run") * RUN + F.col("_copy")).alias("rank"))


def _placed(ranked: DataFrame, totals: DataFrame, own: list[str], rows: int, buckets: int, shards: int) -> DataFrame:
    """Positions in the order of fractional ranks, and the shards that they are cut into."""
    # of n rows those with (2 r - 1) / 2 n below b / buckets are the first ((2 n b - 1) div buckets + 1) div 2
    starts = totals.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("_at"))
    starts = starts.groupBy("_at").agg(F.sum(F.expr(f"IF(_at = 0, 0L, ((2 * n * _at - 1) div {buckets} + 1) div 2)")).alias("start"))
    dealt = ranked.withColumn(_BUCKET, F.expr(f"((2 * rank - 1) * {buckets}L) div (2 * n)")).withColumn("_fraction", (2 * F.col("rank") - 1) / (2 * F.col("n")))
    inside = F.row_number().over(Window.partitionBy(_BUCKET).orderBy("_fraction", F.asc_nulls_first("source"), "rank"))
    placed = dealt.withColumn("_inside", inside).join(starts, F.col(_BUCKET) == F.col("_at")).withColumn("position", F.col("start") + F.col("_inside") - 1)
    total = max(1, rows)
    placed = placed.withColumn("shard", F.expr(f"(position * {shards}L) div {total}L").cast("int"))
    return placed.withColumn("slot", F.expr(f"position - (shard * {total}L + {shards - 1}L) div {shards}L"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", files: int = 1) -> None:
    """Write all columns of ``docs`` to ``path``/_shard=k in the order of the column ``_slot``,
    each shard over about ``files`` files."""
    names = tuple(docs.columns)
    placed = assign(docs.toDF(*(f"c{n}" for n in range(len(names)))), shards, seed, *(f"c{names.index(c)}" for c in (id_col, text_col, source_col)), keep=tuple(f"c{n}" for n in range(len(names))))
    rows = placed.select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), *(F.col(f"c{n}").alias(c) for n, c in enumerate(names)))
    rows.repartitionByRange(max(1, shards * files), "_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)
