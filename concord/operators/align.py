"""Individuals of several tables: unions, intersections, alignment with zero fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.model import Block
from concord.sources.paths import materialize


def _ids(table: Block | DataFrame) -> DataFrame:
    if isinstance(table, Block):
        return table.frame.select(F.col(table.id_col).cast("string").alias("id"))
    return table.select(F.col("id").cast("string").alias("id"))


def numbered(frame: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """``frame`` with places in the order of columns, from 0. Rows are dealt by ranges and
    numbered within them; each range begins where the counts of those before it end, so no
    task sees all rows. Rows that tie in ``order`` get places in any order."""
    ranged = materialize(frame.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())  # a row for each range
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    begun = frame.sparkSession.createDataFrame(starts, "_range int, _start bigint")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_inside", inside).join(F.broadcast(begun), "_range").select(*frame.columns, (F.col("_start") + F.col("_inside")).alias(name))


def id_union(tables: list, order: str | None = None, order_col: str | None = None) -> DataFrame:
    """All individuals of any table, once. With ``order`` they have a ``position`` from 0:
    ``sorted`` in binary order of ids; ``first`` as they first appear, table after table and
    in each by ``order_col``; ``auto`` as they first appear if all tables have as many rows,
    else sorted."""
    if order is None:
        return reduce(DataFrame.unionByName, map(_ids, tables)).distinct()
    if order not in ("sorted", "first", "auto"):
        raise ValueError("order is sorted, first or auto")
    if order == "auto":
        rows = reduce(DataFrame.unionByName, [_ids(t).agg(F.count("*").alias("n")) for t in tables]).distinct().count()
        order = "first" if rows == 1 else "sorted"
    if order == "sorted":
        return numbered(id_union(tables), "id")
    if not order_col:
        raise ValueError("the order of first appearance needs order_col")
    frames = [t.frame if isinstance(t, Block) else t for t in tables]
    ids = [F.col(t.id_col if isinstance(t, Block) else "id").cast("string").alias("id") for t in tables]
    stacked = reduce(DataFrame.unionByName, [f.select(i, F.struct(F.lit(n).alias("t"), F.col(order_col).alias("at")).alias("place")) for n, (f, i) in enumerate(zip(frames, ids))])
    return numbered(stacked.groupBy("id").agg(F.min("place").alias("place")), "place", "id").select("id", "position")


def id_intersect(a, b) -> DataFrame:
    return _ids(a).intersect(_ids(b))


def id_absent(universe, table) -> DataFrame:
    """Individuals of ``universe`` that ``table`` has not."""
    return _ids(universe).distinct().join(_ids(table), "id", "left_anti")


def presence(tables: dict[str, Block]) -> DataFrame:
    """(id, <table> int ..., ksum int): in which tables an individual is, and in how many.
    One shuffle: the ids of all tables are stacked and grouped."""
    stacked = reduce(DataFrame.unionByName, [_ids(t).withColumn("t", F.lit(n)) for n, t in enumerate(tables.values())])
    flags = [F.max((F.col("t") == n).cast("int")).alias(name) for n, name in enumerate(tables)]
    out = stacked.groupBy("id").agg(*flags)
    return out.withColumn("ksum", reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in tables]))


def align_one(table: Block, universe: DataFrame) -> DataFrame:
    """(id, <variables>, present): every individual of the universe, zeros where absent."""
    own = table.frame.select(F.col(table.id_col).cast("string").alias("id"), *(F.col(f"`{v}`").cast("double").alias(v) for v in table.variables), F.lit(1).alias("present"))
    joined = universe.select(F.col("id").cast("string").alias("id")).join(own, "id", "left")
    return joined.select("id", *(F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(v) for v in table.variables), F.coalesce("present", F.lit(0)).alias("present"))


def aligned(tables: dict[str, Block], packed: bool, keep_missing: bool = False) -> DataFrame:
    """All tables by individual: id, n0, n1, ... (rows of the table, 0 if absent), ksum, and
    the values with zeros where absent: one array ``x`` over all tables' variables.
    ``keep_missing``: a missing value of a row that is there stays null.

    The tables are stacked and grouped once, instead of being joined one after the other, so
    there is one shuffle however many tables there are; tables that are parts of one frame are
    made from one scan of it. With few variables in all each is a column of its own while
    grouping, which keeps the aggregation in generated code."""
    blocks = list(tables.values())
    widths = [len(b.variables) for b in blocks]
    starts = [sum(widths[:n]) for n in range(len(blocks))]
    sources: dict[tuple, list] = {}
    for n, b in enumerate(blocks):
        part = b.read()
        sources.setdefault((id(part.source), str(part.id)), []).append((n, part))
    stacked = []
    for parts in sources.values():
        cells, inside = [], []
        for n, part in parts:
            there = F.lit(True) if part.where is None else F.coalesce(part.where, F.lit(False))
            inside.append(there)
            cells.append(there.cast("int").alias(f"f{n}"))
            values = {f"x{n}": part.x} if packed else {f"c{starts[n] + k}": part.x[k] for k in range(widths[n])}
            cells += [(v if part.where is None else F.when(there, v)).alias(name) for name, v in values.items()]
        rows = parts[0][1].source
        if all(part.where is not None for _, part in parts):
            rows = rows.where(reduce(lambda a, b: a | b, inside))
        stacked.append(rows.select(parts[0][1].id.cast("string").alias("id"), *cells))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    counts = [F.coalesce(F.sum(f"f{n}"), F.lit(0)).alias(f"n{n}") for n in range(len(blocks))]
    if packed:
        out = rows.groupBy("id").agg(*counts, *(F.first(f"x{n}", ignorenulls=True).alias(f"x{n}") for n in range(len(blocks))))
        x = F.concat(*(F.coalesce(f"x{n}", F.array_repeat(F.lit(0.0), w)) for n, w in enumerate(widths)))
    else:
        out = rows.groupBy("id").agg(*counts, *(F.max(f"c{j}").alias(f"c{j}") for j in range(sum(widths))))
        of = [n for n, w in enumerate(widths) for _ in range(w)]
        x = F.array(*(F.when(F.col(f"n{of[j]}") == 0, 0.0).otherwise(F.col(f"c{j}")) if keep_missing else F.coalesce(f"c{j}", F.lit(0.0)) for j in range(sum(widths))))
    ksum = reduce(lambda a, b: a + b, [F.least(F.col(f"n{n}"), F.lit(1)) for n in range(len(blocks))])
    return out.select("id", *(F.col(f"n{n}").cast("int") for n in range(len(blocks))), ksum.cast("int").alias("ksum"), x.alias("x"))


def paired_cors(a: Block, b: Block) -> DataFrame:
    """(variable_a, variable_b, r): correlations of all variables of two tables over the
    individuals that both have, paired by id whatever the order of rows; null where one is constant."""
    left, right = a.doubles(), b.doubles()
    both = left.join(right.select("id", *(F.col(f"v{j}").alias(f"w{j}") for j in range(len(b.variables)))), "id")
    cells = []
    for i, va in enumerate(a.variables):
        for j, vb in enumerate(b.variables):
            x, y = F.col(f"v{i}"), F.col(f"w{j}")
            r = F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
            cells.append(F.struct(F.lit(va).alias("variable_a"), F.lit(vb).alias("variable_b"), r.alias("r")))
    return both.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("e")).select("e.*")
