"""Before a fit: casts, imputation, filters by coordinate, transposition."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.columns import clean_id, to_number, zero_to_null
from concord.model import Assay, AssaySet, Block, TableList
from concord.operators import neighbours
from concord.operators.moments import placed, scattered
from concord.sources.paths import materialize


def null_check(frame: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, n_missing, fraction) of each column; NaN counts as missing."""
    missing = [F.count_if(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))).alias(c) for c in columns]
    one = frame.agg(F.count(F.lit(1)).alias("_n"), *missing)
    each = F.array(*(F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("n_missing"), F.try_divide(F.col(f"`{c}`").cast("double"), F.col("_n")).alias("fraction")) for c in columns))
    return one.select(F.explode(each).alias("e")).select("e.*")


def to_numbers(tables: TableList, index: str | int) -> TableList:
    """One table's text values as numbers; null where a text is no number."""
    if not isinstance(tables, TableList):
        raise ValueError("a TableList is needed")
    names = list(tables.tables)
    if isinstance(index, int):
        if not 1 <= index <= len(names):
            raise ValueError(f"there is no table {index}")
        index = names[index - 1]
    if index not in tables.tables:
        raise ValueError(f"there is no table {index}")
    b = tables.tables[index]
    frame = b.frame.select(F.col(b.id_col), *(to_number(F.col(f"`{v}`")).alias(v) for v in b.variables)) if b.layout == "wide" else b.frame
    return TableList(tables.tables | {index: replace(b, frame=frame)})


def zeros_to_nulls(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: zero_to_null(F.col(f"`{c}`")) for c in columns})


def clean_ids(table: Block, length: int = 12) -> Block:
    rest = [F.col(f"`{v}`") for v in table.variables] if table.layout == "wide" else [F.col("x")]
    return replace(table, frame=table.frame.select(clean_id(F.col(table.id_col).cast("string"), length).alias("id"), *rest), id_col="id")


def head_variables(table: Block, k: int) -> Block:
    """The first k variables."""
    if table.layout == "packed":
        return replace(table, frame=table.frame.select(table.id_col, F.slice("x", 1, k).alias("x")), variables=table.variables[:k])
    return replace(table, frame=table.frame.select(table.id_col, *(F.col(f"`{v}`") for v in table.variables[:k])), variables=table.variables[:k])


def drop_sparse_samples(values: DataFrame, colmax: float = 0.8) -> DataFrame:
    """(feature, sample, value) of the samples whose share of missing values is below ``colmax``."""
    kept = values.groupBy("sample").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing")).where(F.col("missing") < colmax)
    return values.join(kept, "sample", "left_semi")


# ---------------------------------------------------------------- coordinates


def ranges(spark, text: list[str] | str) -> DataFrame:
    """(chrom, start, end) of texts such as ``11:64550986-64578766``; ends belong to them."""
    rows = []
    for t in [text] if isinstance(text, str) else text:
        chrom, _, span = t.replace(",", "").partition(":")
        start, _, end = span.partition("-")
        try:
            rows.append((chrom, int(start), int(end or start)))
        except ValueError:
            raise ValueError(f"{t!r} is no range") from None
    return spark.createDataFrame(rows, "chrom string, start bigint, end bigint")


def _query(wanted: DataFrame) -> DataFrame:
    if not {"chrom", "start", "end"} <= set(wanted.columns):
        raise ValueError("ranges have columns chrom, start and end")
    return wanted.select(F.col("chrom").alias("q_chrom"), F.col("start").alias("q_start"), F.col("end").alias("q_end")).distinct()


#: Up to this many ranges go to every task; more are joined by bins of coordinates.
FEW_RANGES = 10_000


def point_filter(features: DataFrame, wanted: DataFrame, col_name: str = "coord", match_chrom: bool = True) -> DataFrame:
    """Features whose coordinate lies in a range, ends included. The chromosome must match
    where features have one and ``match_chrom`` holds: an equality that the join can use.
    Without it few ranges are sent along, and many meet the features in bins of coordinates."""
    if col_name not in features.columns:
        raise ValueError(f"features have no column {col_name}")
    q, at = _query(wanted), F.col(col_name).try_cast("double")
    on = (at >= F.col("q_start")) & (at <= F.col("q_end"))
    if match_chrom and "chrom" in features.columns:
        return features.join(q, (F.col("chrom") == F.col("q_chrom")) & on, "left_semi")
    spans = q.select("q_start", "q_end").distinct()
    if spans.limit(FEW_RANGES + 1).count() <= FEW_RANGES:
        return features.join(F.broadcast(spans), on, "left_semi")
    width = spans.agg(F.max(F.col("q_end") - F.col("q_start"))).first()[0] + 1  # a range meets two bins at most
    bins = spans.select("q_start", "q_end", F.explode(F.sequence(F.floor(F.col("q_start") / width), F.floor(F.col("q_end") / width))).alias("q_bin"))
    return features.join(bins, (F.floor(at / width) == F.col("q_bin")) & on, "left_semi")


def within_filter(features: DataFrame, wanted: DataFrame) -> DataFrame:
    """Features whose interval lies within a range of their chromosome."""
    if not {"chrom", "start", "end"} <= set(features.columns):
        raise ValueError("features have no columns chrom, start and end")
    q = _query(wanted)
    return features.join(q, (F.col("chrom") == F.col("q_chrom")) & (F.col("start") >= F.col("q_start")) & (F.col("end") <= F.col("q_end")), "left_semi")


def select_features(assay: Assay, features: DataFrame) -> Assay:
    """The values of chosen features."""
    names = features.select("feature").distinct()
    return Assay(assay.values.join(names, "feature", "left_semi"), None if assay.annotation is None else assay.annotation.join(names, "feature", "left_semi"))


def region(assays: AssaySet, wanted: DataFrame, point_assays: list[str] = (), col_name: str = "Genomic_Coordinate", match_chrom: bool = True) -> AssaySet:
    """Each assay's features in the ranges: by a point column for ``point_assays``, by
    intervals within a range for the others."""
    if not isinstance(assays, AssaySet):
        raise ValueError("an AssaySet is needed")
    if unknown := set(point_assays) - set(assays.assays):
        raise ValueError(f"there is no assay {', '.join(sorted(unknown))}")
    out = {}
    for name, a in assays.assays.items():
        if a.annotation is None:
            raise ValueError(f"assay {name} has no annotation")
        found = point_filter(a.annotation, wanted, col_name, match_chrom) if name in point_assays else within_filter(a.annotation, wanted)
        out[name] = select_features(a, found)
    return AssaySet(out, assays.samples)


# ---------------------------------------------------------------- transposition


def transpose(values: DataFrame, features: list[str]) -> DataFrame:
    """(id, <features>): samples in rows, from (feature, sample, value). The features are
    named, so that the pivot needs no pass to find them."""
    return values.groupBy(F.col("sample").alias("id")).pivot("feature", features).agg(F.first("value", ignorenulls=True))


def transpose_packed(values: DataFrame, features: list[str]) -> DataFrame:
    """(id, x): samples in rows, one array in the order of ``features``; null where absent."""
    cells = placed(values.where(F.col("value").isNotNull()).select(F.col("feature").cast("string").alias("feature"), F.col("sample").alias("id"), "value"), "feature", features)
    return scattered(cells, "id", len(features), None)


def tables_of(assays: AssaySet, wide: int = 100) -> TableList:
    """Each assay with samples in rows: the wide layout for few features, packed for many."""
    if not isinstance(assays, AssaySet):
        raise ValueError("an AssaySet is needed")
    out = {}
    for name, a in assays.assays.items():
        features = [r[0] for r in a.values.select("feature").distinct().orderBy("feature").collect()]  # names only
        out[name] = Block.wide(transpose(a.values, features), variables=features) if len(features) <= wide else Block(transpose_packed(a.values, features), tuple(features), "id", "packed")
    return TableList(out)


# ---------------------------------------------------------------- imputation


def knn_impute(values: DataFrame, k: int = 10, rowmax: float = 0.5, colmax: float = 0.8, max_block_bytes: int = 8 << 20, block_rows: int = 1024) -> DataFrame:
    """(feature, sample, value) with missing values filled. Neighbours of a feature are the
    nearest features by the mean squared difference over the samples both have; a missing
    value is the mean of the k nearest that have it, ties by name. A feature with more than
    ``rowmax`` missing gets the mean of each sample, and so does a value without neighbour.
    A sample with more than ``colmax`` missing is an error.

    Neighbours are searched in blocks of like features (:mod:`neighbours`), exactly. Only the
    samples' names and means reach the driver."""
    return knn_search(values, k, rowmax, colmax, max_block_bytes, block_rows)[0]


def knn_search(values: DataFrame, k: int = 10, rowmax: float = 0.5, colmax: float = 0.8, max_block_bytes: int = 8 << 20, block_rows: int = 1024) -> tuple[DataFrame, neighbours.Neighbours]:
    """What :func:`knn_impute` returns, and the search behind it: neighbours and the pairs of
    blocks that met."""
    samples = [(r["sample"], r["missing"], r["mean"]) for r in values.groupBy("sample").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing"), F.avg("value").alias("mean")).orderBy("sample").collect()]
    names = [s for s, _, _ in samples]
    if sparse := [s for s, missing, _ in samples if missing > colmax]:
        raise ValueError(f"samples {', '.join(map(str, sparse))} miss more than {colmax} of their values")
    cells = placed(values.select(F.col("feature").cast("string").alias("id"), F.col("sample").cast("string").alias("sample"), "value"), "sample", [str(n) for n in names])
    rows = materialize(scattered(cells, "id", len(names), None), "knn-features")
    count = rows.count()
    if count < 2:
        raise ValueError("imputation needs two features")
    near = neighbours.search(rows, len(names), k, rowmax, count, block_rows, max_block_bytes)
    means = near.of_classes.groupBy(F.col("id").alias("class"), "pos").agg(F.avg("value").alias("mean"))
    fills = means.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("pos", "mean"))).alias("fills"))  # a row has a value a sample at most
    columns = values.sparkSession.createDataFrame([(n, s, None if m is None else float(m)) for n, (s, _, m) in enumerate(samples)], f"pos int, sample {dict(values.dtypes)['sample']}, average double")
    whole = near.members.join(fills, "class", "left").select("id", "fills", F.posexplode("x").alias("pos", "value"))
    whole = whole.join(F.broadcast(columns) if len(names) <= 50_000 else columns, "pos")
    return whole.select(F.col("id").alias("feature"), "sample", F.coalesce("value", F.col("fills")[F.col("pos")], "average").alias("value")), near


def impute(assays: AssaySet, method: str = "knn", remove_col: bool = False, impute_zero: bool = False, rowmax: float = 0.5, colmax: float = 0.8, k: int = 10) -> AssaySet:
    """Zeros to nulls if asked, sparse samples dropped if asked, then nearest neighbours."""
    if not isinstance(assays, AssaySet):
        raise ValueError("an AssaySet is needed")
    if method == "hmisc":
        raise NotImplementedError("method hmisc is not available")
    if method != "knn":
        raise ValueError("method must be knn")

    def one(values: DataFrame) -> DataFrame:
        values = values.select(F.col("feature").cast("string"), F.col("sample").cast("string"), F.col("value").cast("double"))
        if impute_zero:
            values = values.withColumn("value", zero_to_null(F.col("value")))
        if remove_col:
            values = drop_sparse_samples(values, colmax)
        return knn_impute(values, k, rowmax, colmax)

    return AssaySet({n: Assay(one(a.values), a.annotation) for n, a in assays.assays.items()}, assays.samples)


def grid(first: list[float], second: list[float]) -> list[tuple[float, float]]:
    """All pairs, the first factor varying fastest."""
    return [(a, b) for b in second for a in first]


def grid_frame(spark, first: list[float], second: list[float]) -> DataFrame:
    """(place, lambda1, lambda2): the same pairs as a table."""
    a = spark.range(1).select(F.posexplode(F.array(*(F.lit(float(v)) for v in first))).alias("a", "lambda1"))
    b = spark.range(1).select(F.posexplode(F.array(*(F.lit(float(v)) for v in second))).alias("b", "lambda2"))
    return a.crossJoin(F.broadcast(b)).select((F.col("b") * len(first) + F.col("a")).cast("int").alias("place"), "lambda1", "lambda2")


def stack_rows(pieces: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, pieces)
