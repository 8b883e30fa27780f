"""Assays and fits as Parquet folders."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from concord.model import Assay, AssaySet, Block, FitResult
from concord.plans.fit import fit_incomplete
from concord.sources.paths import exists

#: What stands beside the values: behind an assay's name, and for all.
ANNOTATION, SAMPLES = ".annotation", "all.samples"


def write_assays(assays: AssaySet, path: str) -> list[str]:
    """Of each assay a folder of (feature, sample, value), in ranges of features and sorted
    within, so that row groups know the features they hold; beside it what is known of the
    features, and once the attributes of samples. Returns the assays' names."""
    if not isinstance(assays, AssaySet):
        raise ValueError("an AssaySet is needed")
    for name, a in assays.assays.items():
        a.values.repartitionByRange("feature").sortWithinPartitions("feature", "sample").write.mode("overwrite").parquet(f"{path}/{name}")
        if a.annotation is not None:
            a.annotation.write.mode("overwrite").parquet(f"{path}/{name}{ANNOTATION}")
    if assays.samples is not None:
        assays.samples.write.mode("overwrite").parquet(f"{path}/{SAMPLES}")
    return list(assays.assays)


def read_assays(spark: SparkSession, path: str, names: list[str], features: tuple[str, str] | None = None) -> AssaySet:
    """What :func:`write_assays` wrote. ``features``: the first and last name to read; row
    groups that hold none between them are not read."""

    def one(name: str) -> Assay:
        values = spark.read.parquet(f"{path}/{name}")
        known = spark.read.parquet(f"{path}/{name}{ANNOTATION}") if exists(spark, f"{path}/{name}{ANNOTATION}") else None
        if features:
            inside = F.col("feature").between(*features)
            values, known = values.where(inside), known if known is None else known.where(inside)
        return Assay(values, known)

    samples = spark.read.parquet(f"{path}/{SAMPLES}") if exists(spark, f"{path}/{SAMPLES}") else None
    return AssaySet({n: one(n) for n in names}, samples)


def write_tables(tables: dict[str, Block], path: str) -> list[str]:
    for name, b in tables.items():
        b.frame.write.mode("overwrite").parquet(f"{path}/{name}")
    return list(tables)


def read_tables(spark: SparkSession, path: str, names: list[str], id_col: str = "id") -> dict[str, Block]:
    """Blocks of the wide layout."""
    return {n: Block.wide(spark.read.parquet(f"{path}/{n}"), id_col) for n in names}


def fit_from_path(spark: SparkSession, path: str, names: list[str], id_col: str = "id", **options) -> FitResult:
    """Fit the tables below ``path`` and write the result to its folder ``out``."""
    result = fit_incomplete(read_tables(spark, path, names, id_col), **options)
    result.save(f"{path}/out")
    return result


def read_fit(spark: SparkSession, path: str, names: list[str]) -> dict:
    """The frames that :meth:`FitResult.save` wrote."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
