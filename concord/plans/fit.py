"""Fits: shared components of several tables that describe overlapping individuals.

One scan of the sources and one shuffle by id stack, group and cache the aligned rows. Over
those: one aggregate for counts, means, deviations and nulls; one for all cross products;
and, only if correlations of incomplete tables are asked for, one for the sums they need.
Components and scores are lazy projections.
Nothing of the size of individuals x individuals is formed and only matrices of the size of
variables x variables reach the driver, from a tree of partial sums.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from concord.functions.columns import component
from concord.functions.stats import correlation_p, p_value
from concord.model import WIDE, Block, FitResult, table_set
from concord.operators.align import aligned
from concord.operators.moments import SQL_LIMIT, aligned_stats, all_column_stats, column_sums, gram, grams, placed, stack
from concord.plans.large import Rows, row_blocks, solve_large, unpacked
from concord.plans.solve import match_method, penalties, solve
from concord.sources.paths import discard, materialize

#: Up to this many variables a projection is a sum of columns; beyond, numpy in Arrow batches.
PROJECT_LIMIT = 24
#: The largest matrix that the driver decomposes; a fit of more variables is iterative.
DRIVER_LIMIT = 4096


def scaled(table: Block, stats: dict, center: bool = True) -> Block:
    """z-scores by the table's own rows; ``center=False`` divides by the deviation only."""
    mean, sd = (stats["mean"] if center else np.zeros(len(table.variables))), stats["sd"]
    if table.layout == "wide" and len(table.variables) <= WIDE:
        columns = [((F.col(f"`{v}`").cast("double") - F.lit(float(mu))) / F.lit(float(s))).alias(v) for v, mu, s in zip(table.variables, mean, sd)]
        return Block(table.frame.select(F.col(table.id_col).cast("string").alias("id"), *columns), table.variables)
    width = len(table.variables)

    def run(batches):
        for batch in batches:
            x = (stack(batch, "x", width) - mean) / sd
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "x"])

    return Block(table.arrays().mapInArrow(run, "id string, x array<double>"), table.variables, "id", "packed")


def checked(tables: dict[str, Block], stats: dict[str, dict], scale: bool) -> None:
    for name, s in stats.items():
        if s["bad"].any():
            where = ", ".join(v for v, b in zip(tables[name].variables, s["bad"]) if b)
            raise ValueError(f"table {name} has missing values in {where}: impute them, or use complete cases")
        if s["n"] < 2:
            raise ValueError(f"table {name} has {s['n']} rows")
        if scale and (constant := [v for v, d in zip(tables[name].variables, s["sd"]) if not d > 1e-15]):
            raise ValueError(f"table {name}: {', '.join(constant)} is constant")


def first_rows(table: Block, order_col: str) -> Block:
    """One row of each id, the first by ``order_col``."""
    rank = F.row_number().over(Window.partitionBy(table.id_col).orderBy(order_col))
    keep = [table.id_col, *(table.variables if table.layout == "wide" else ("x",))]
    return replace(table, frame=table.frame.withColumn("_rank", rank).where("_rank = 1").select(*keep))


def project(rows: DataFrame, matrix: np.ndarray, names: list[str], keep: list[str], over: str | None = None) -> DataFrame:
    """``keep`` columns and x times ``matrix``, divided by the column ``over`` if given."""
    if matrix.shape[0] <= PROJECT_LIMIT:
        out = []
        for k, name in enumerate(names):
            total = reduce(lambda a, b: a + b, [F.col("x")[j] * F.lit(float(v)) for j, v in enumerate(matrix[:, k])])
            out.append((total / F.col(over) if over else total).alias(name))
        return rows.select(*keep, *out)
    width, divisor = matrix.shape[0], over or "_one"
    frame = rows.select(*keep, "x", *([over] if over and over not in keep else [] if over else [F.lit(1).alias("_one")]))
    schema = ", ".join([f"{c} {dict(frame.dtypes)[c]}" for c in keep] + [f"{n} double" for n in names])

    def run(batches):
        for batch in batches:
            y = stack(batch, "x", width) @ matrix / batch.column(divisor).to_numpy()[:, None].astype(float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(y[:, k])) for k in range(len(names)))], names=[*keep, *names])

    return frame.mapInArrow(run, schema)


def fit(
    tables,
    nfac: int = 2,
    scale: bool = True,
    p_values: bool = True,
    scores: bool = False,
    method: str = "solve",
    lam=None,
    missing: str = "allow",
    center: bool = True,
    p_value_n: str = "all",
    on_duplicate: str = "raise",
    order_col: str | None = None,
    solver: str = "auto",
    constant: str = "raise",
) -> FitResult:
    """Components shared by all tables.

    ``missing="allow"``: individuals may be absent from tables; ``"forbid"``: complete cases,
    unit components. ``p_value_n="available"`` counts a table's own individuals in place of
    all. ``on_duplicate="first"`` keeps the first row of an id by ``order_col``, scaled with
    the statistics of all rows. ``method="ginv"``: least-norm fits where variables depend on
    each other, by generalised inverses. ``constant="drop"`` leaves out variables that do not vary.
    ``solver``: ``dense`` solves variables x variables on the driver, ``iterative`` keeps them
    in tiles and iterates; ``auto`` is dense up to ``DRIVER_LIMIT`` variables. Errors are raised
    before or while the moments are taken.
    """
    method = match_method(method)
    if missing not in ("allow", "forbid") or on_duplicate not in ("raise", "first") or p_value_n not in ("all", "available"):
        raise ValueError("missing is allow or forbid, on_duplicate is raise or first, p_value_n is all or available")
    if solver not in ("auto", "dense", "iterative") or constant not in ("raise", "drop"):
        raise ValueError("solver is auto, dense or iterative, constant is raise or drop")
    if on_duplicate == "first" and not order_col:
        raise ValueError("on_duplicate='first' needs order_col")
    blocks = table_set(tables)
    names = list(blocks)
    if on_duplicate == "first":
        blocks = {k: replace(b, variables=tuple(v for v in b.variables if v != order_col)) for k, b in blocks.items()}
    values = penalties(method, lam, len(names))
    widths = [len(b.variables) for b in blocks.values()]
    if not all(widths):
        raise ValueError("a table has no variables")
    if nfac < 1:
        raise ValueError("nfac must be positive")
    total, count = sum(widths), len(names)
    of = np.repeat(np.arange(count), widths)
    if method == "ginv" and (solver == "iterative" or total > DRIVER_LIMIT):
        raise ValueError(f"generalised inverses are for up to {DRIVER_LIMIT} variables and the dense solver")
    large = solver == "iterative" or (solver == "auto" and total > DRIVER_LIMIT)
    packed = large or total > SQL_LIMIT or any(b.layout == "packed" for b in blocks.values())
    ready = {k: first_rows(b, order_col) for k, b in blocks.items()} if on_duplicate == "first" else blocks
    raw = aligned(ready, packed, keep_missing=True)
    raw = row_blocks(raw, count, total) if large else raw.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m, most, present, stats = aligned_stats(raw, widths, sql=total <= SQL_LIMIT and not large, read=unpacked(count, total) if large else None)
        if on_duplicate == "first":  # scaled with the statistics of all rows
            stats = list(all_column_stats(blocks).values())
        if max(most) > 1:
            raise ValueError(f"table {names[int(np.argmax(most))]} has several rows of one id")
        keep = np.concatenate([s["sd"] > 1e-15 if constant == "drop" else np.ones(w, bool) for s, w in zip(stats, widths)])
        rows = raw
        if not keep.all():
            blocks, stats, widths, of, total = _varying(blocks, stats, keep)
            if not all(widths):
                raise ValueError("a table has no variables that vary")
            rows = raw if large else _chosen(raw, keep)
        checked(blocks, dict(zip(names, stats)), scale)
        if missing == "forbid" and len(set(present)) > 1:
            raise ValueError("the tables differ in their rows: complete cases are required; see missing='allow'")
        if missing == "forbid" and min(present) < m:
            raise ValueError("the tables describe different individuals: complete cases are required; see missing='allow'")
        means, sds = (np.concatenate([s[k] for s in stats]) for k in ("mean", "sd"))
        shift = means if center and scale else np.zeros(total)
        complete = min(present) == m
        starts = np.concatenate([[0], np.cumsum(widths)])
        comps = [component(k + 1) for k in range(nfac)]
        flags = [f"n{k}" for k in range(count)]
        if large:
            passes = Rows(raw, widths, shift, sds if scale else np.ones(total), keep)
            sums, squares = passes.summed(lambda there, z: np.stack([z.sum(axis=0), (z * z).sum(axis=0)]), (2, total))
            result, products = solve_large(passes, sums, squares, names, values, nfac, m, missing == "forbid", scores)
            y = passes.project(result.loadings, comps)
            own = None
        else:
            rows = _z(rows, of, shift, sds) if scale else rows
            own, *more = grams(rows, total, weights=(None,) if complete else (None, "1D / ksum"))
            cross = own / count if complete else more[0]
            if scale and center and on_duplicate != "first":
                sums = np.zeros(total)
            elif on_duplicate == "first":
                sums = column_sums(rows, total)
            else:
                sums = means * np.repeat(present, widths) / (sds if scale else 1)
            result = solve(own, cross, sums, widths, names, values, nfac, m, unit=missing == "forbid", ginv=method == "ginv")
            products, squares = cross @ result.loadings, np.diag(own)
            y = project(rows, result.loadings, comps, ["id", *flags], "ksum")
    except BaseException:
        discard(raw) if large else raw.unpersist()
        raise

    def details() -> dict:
        if complete and own is not None:  # every table has every individual: sums of components follow from those of variables
            totals = np.stack([sums @ result.loadings / count, np.einsum("ij,ik,kj->j", result.loadings, own, result.loadings) / count**2], axis=-1)[None].repeat(count, axis=0)
        else:
            cells = [f(F.when(F.col(flag) > 0, F.col(c) if not square else F.col(c) * F.col(c))) for flag in flags for c in comps for f, square in ((F.sum, False), (F.sum, True))]
            totals = np.array(y.agg(*cells).first(), dtype=float).reshape(count, nfac, 2)
        r = np.full((total, nfac), np.nan)
        for k, (a, b) in enumerate(zip(starts, starts[1:])):
            n = present[k]
            cov = products[a:b] - np.outer(sums[a:b], totals[k, :, 0]) / n
            vx = squares[a:b] - sums[a:b] ** 2 / n
            vy = totals[k, :, 1] - totals[k, :, 0] ** 2 / n
            with np.errstate(divide="ignore", invalid="ignore"):
                r[a:b] = np.clip(cov / np.sqrt(np.outer(vx, vy)), -1, 1)
        return report(raw.sparkSession, blocks, names, starts, r, m, present, comps, p_values, p_value_n)

    inner = raw.sparkSession.createDataFrame([(c + 1, float(v)) for c, v in enumerate(result.values)], "comp int, eigenvalue double")
    scored = (_scores(passes if large else rows, names, starts, result.weights, comps)) if scores else None
    return FitResult(y.select("id", *comps), scored, inner, tuple(map(float, result.values)), tuple(names), m, details, raw)


def _z(rows: DataFrame, of: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> DataFrame:
    """Aligned rows with ``x`` as z-scores, still 0 where an individual is absent."""
    width, flags = len(of), [c for c in rows.columns if c != "x"]
    if width <= SQL_LIMIT:
        x = F.array(*(F.when(F.col(f"n{of[j]}") == 0, 0.0).otherwise((F.col("x")[j] - F.lit(float(mean[j]))) / F.lit(float(sd[j]))) for j in range(width)))
        return rows.select(*flags, x.alias("x"))

    def run(batches):
        for batch in batches:
            there = np.stack([batch.column(f"n{k}").to_numpy() for k in range(int(of[-1]) + 1)], axis=1)[:, of] > 0
            x = np.where(there, (stack(batch, "x", width) - mean) / sd, 0.0)
            arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, x.ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in flags), arrays], names=[*flags, "x"])

    kinds = dict(rows.dtypes)
    return rows.select(*flags, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in flags) + ", x array<double>")


def _varying(blocks: dict[str, Block], stats: list[dict], keep: np.ndarray):
    """Blocks by name only and statistics of the variables to keep; their widths, tables and number."""
    at, left, kept_stats = 0, {}, []
    for (name, b), s in zip(blocks.items(), stats):
        mine = keep[at : at + len(b.variables)]
        at += len(b.variables)
        left[name] = replace(b, variables=tuple(v for v, k in zip(b.variables, mine) if k))
        kept_stats.append(s | {k: s[k][mine] for k in ("mean", "sd", "bad")})
    widths = [len(b.variables) for b in left.values()]
    return left, kept_stats, widths, np.repeat(np.arange(len(widths)), widths), sum(widths)


def _chosen(rows: DataFrame, keep: np.ndarray) -> DataFrame:
    """Aligned rows with some of their values."""
    flags, chosen, width = [c for c in rows.columns if c != "x"], np.flatnonzero(keep), len(keep)
    if len(chosen) <= SQL_LIMIT:
        return rows.select(*flags, F.array(*(F.col("x")[int(j)] for j in chosen)).alias("x"))

    def run(batches):
        for batch in batches:
            x = stack(batch, "x", width)[:, chosen]
            arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(chosen), np.ascontiguousarray(x).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in flags), arrays], names=[*flags, "x"])

    kinds = dict(rows.dtypes)
    return rows.select(*flags, "x").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in flags) + ", x array<double>")


def _scores(rows: DataFrame | Rows, names: list[str], starts, weights: list[np.ndarray], comps: list[str]) -> DataFrame:
    """(table, id, comp1..): rows of the table times its weights, zero for absent ids. One
    scan makes all tables' scores."""
    width = int(starts[-1])
    wide = np.zeros((width, len(names) * len(comps)))
    for k, (a, b) in enumerate(zip(starts, starts[1:])):
        wide[a:b, k * len(comps) : (k + 1) * len(comps)] = weights[k]
    cells = [f"s{k}_{c}" for k in range(len(names)) for c in comps]
    flat = rows.project(wide, cells, over_ksum=False) if isinstance(rows, Rows) else project(rows, wide, cells, ["id"])
    each = F.array(*(F.struct(F.lit(name).alias("table"), "id", *(F.col(f"s{k}_{c}").alias(c) for c in comps)) for k, name in enumerate(names)))
    return flat.select(F.explode(each).alias("e")).select("e.*")


def report(spark, blocks, names, starts, r, m, present, comps, p_values, p_value_n) -> dict:
    """Frames of correlations and what follows from them, as small as the variables."""
    nfac = len(comps)
    rows, tested = [], []
    for k, name in enumerate(names):
        n = m if p_value_n == "all" else present[k]
        p = correlation_p(r[starts[k] : starts[k + 1]], n) if p_values else None
        for pos, variable in enumerate(blocks[name].variables):
            for c in range(nfac):
                v = r[starts[k] + pos, c]
                rows.append((name, pos, variable, c + 1, None if np.isnan(v) else float(v)))
                if p_values:
                    tested.append((name, pos, variable, c + 1, None if np.isnan(p[pos, c]) else float(p[pos, c])))
    ave = np.array([np.mean(r[a:b] ** 2, axis=0) for a, b in zip(starts, starts[1:])])
    widths = np.diff(starts)
    outer = widths @ ave / widths.sum()
    key = "table string, var_pos int, variable string, comp int"
    return {
        "cors": spark.createDataFrame(rows, f"{key}, r double"),
        "p_values": spark.createDataFrame(tested, f"{key}, p double") if p_values else None,
        "ave_x": spark.createDataFrame([(n, c + 1, float(ave[k, c])) for k, n in enumerate(names) for c in range(nfac)], "table string, comp int, ave double"),
        "ave_outer": spark.createDataFrame([(c + 1, float(outer[c])) for c in range(nfac)], "comp int, ave double"),
    }


def fit_complete(tables, nfac: int = 2, scale: bool = True, p_values: bool = True, scores: bool = False, method: str = "solve", lam=None) -> FitResult:
    """Complete cases: every individual is in every table."""
    return fit(tables, nfac, scale, p_values, scores, method, lam, missing="forbid")


def fit_incomplete(tables, nfac: int = 2, scale: bool = True, p_values: bool = True, scores: bool = False, method: str = "solve", lam=None, **more) -> FitResult:
    """Individuals may be absent from tables."""
    return fit(tables, nfac, scale, p_values, scores, method, lam, **more)


def fit_packed(tables, *args, outfile: str | None = None, **more) -> FitResult:
    """As :func:`fit_incomplete` for many variables: blocks are packed into arrays before they are
    aligned. ``outfile``: a folder to which the result is written."""
    packed = {k: b.packed_layout() for k, b in table_set(tables).items()}
    out = fit_incomplete(packed, *args, **more)
    if outfile:
        out.save(outfile)
    return out


def feature_rows(assay: DataFrame, samples: list[str], name: str, fill: float | None = None) -> DataFrame:
    """(feature, x) of an assay in long form, z-scores over the samples in one array: one
    shuffle by feature, written for the passes that follow. Samples that a feature lacks count
    as ``fill``. ``ValueError`` for a feature that is null, constant, has several values for a
    sample, or lacks one without ``fill``."""
    cells = placed(assay, "sample", samples)
    grouped = cells.groupBy("feature").agg(F.collect_list(F.struct("pos", "value")).alias("cells"))
    rows = grouped.select(F.col("feature").cast("string").alias("feature"), F.transform("cells", lambda c: c["pos"]).alias("pos"), F.transform("cells", lambda c: c["value"]).alias("x"))
    width = len(samples)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("pos").value_lengths().to_numpy(zero_copy_only=False)
            place = np.repeat(np.arange(batch.num_rows) * width, lengths) + batch.column("pos").flatten().to_numpy(zero_copy_only=False)
            x, seen = np.full(batch.num_rows * width, np.nan if fill is None else fill), np.zeros(batch.num_rows * width, bool)
            x[place], seen[place] = batch.column("x").flatten().to_numpy(zero_copy_only=False), True  # null: NaN
            x, several = x.reshape(-1, width), seen.reshape(-1, width).sum(axis=1) != lengths
            with np.errstate(invalid="ignore", divide="ignore"):
                sd = x.std(axis=1, ddof=1) if width > 1 else np.zeros(len(x))
                bad = ~(sd > 1e-15 * np.maximum(1, np.abs(x).max(axis=1))) | several | batch.column("feature").is_null().to_numpy(zero_copy_only=False)
                z = (x - x.mean(axis=1, keepdims=True)) / sd[:, None]
            if bad.any():
                raise ValueError(f"assay {name}: feature {batch.column('feature')[int(bad.argmax())]} is constant, or lacks samples or has several values for one")
            arrays = pa.ListArray.from_arrays(np.arange(len(z) + 1, dtype=np.int32) * width, z.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("feature"), arrays], names=["feature", "x"])

    return materialize(rows.mapInArrow(run, "feature string, x array<double>"), "dual-features")


def fit_dual(assays: dict[str, DataFrame], lam, nfac: int = 2, p_values: bool = True, scores: bool = False, fill: float | None = None) -> FitResult:
    """Penalized fit of assays with many more features than samples, in long form (feature,
    sample, value): only kernels, samples x samples, are formed. Features are z-scored over
    the samples that the assay has; a sample absent from an assay is an absent individual.
    At most 4096 samples; each must have a value for every feature of its assay, or counts as
    ``fill`` there. ``scores`` come with ``weights``: (table, variable, comp, weight), as many
    as there are features.

    An assay is computed once and written; its samples are found in what was written, and one
    shuffle makes a row of each feature. A pass adds up kernels, and another makes correlations
    and weights of each row."""
    names = list(assays)
    values = penalties("penalized", lam, len(names))
    spark = next(iter(assays.values())).sparkSession
    cells = [materialize(a.select("feature", F.col("sample").cast("string").alias("sample"), F.col("value").cast("double").alias("value")), "dual-cells") for a in assays.values()]
    found = reduce(DataFrame.unionByName, [c.select(F.lit(k).alias("k"), "sample") for k, c in enumerate(cells)]).distinct().limit(len(names) * (DRIVER_LIMIT + 1)).collect()
    per = [sorted(r["sample"] for r in found if r["k"] == k) for k in range(len(names))]
    if over := [n for n, own in zip(names, per) if len(own) > DRIVER_LIMIT]:
        raise ValueError(f"assay {over[0]} has more than {DRIVER_LIMIT} samples")
    samples = sorted(set().union(*per))
    m, at = len(samples), {s: n for n, s in enumerate(samples)}
    total, ksum = np.zeros((m, m)), np.zeros(m)
    rows, kernels = [], []
    for name, long, own, lam_i in zip(names, cells, per, values):
        rows.append(feature_rows(long, own, name, fill))
        discard(long)
        k, where = gram(rows[-1], len(own)), [at[s] for s in own]
        kernels.append(k)
        total[np.ix_(where, where)] += k @ np.linalg.inv(k + lam_i * np.eye(len(where)))
        ksum[where] += 1
    half = 1 / np.sqrt(ksum)
    eigen, vectors = np.linalg.eigh(half[:, None] * (total + total.T) / 2 * half[None, :])
    eigen, vectors = eigen[::-1][:nfac], vectors[:, ::-1][:, :nfac]
    if len(eigen) < nfac or eigen[-1] <= 1e-10 * eigen[0]:
        raise ValueError(f"there are fewer than {nfac} components")
    y = np.sqrt(len(names)) * half[:, None] * vectors
    comps = [component(c + 1) for c in range(nfac)]
    # what a feature is multiplied with: the components for its correlations, these for its weights
    inside = [y[[at[s] for s in own]] for own in per]
    alphas = [np.linalg.solve(k + v * np.eye(len(k)), own) for k, v, own in zip(kernels, values, inside)]
    spread = [np.sqrt(np.maximum(((k @ a) ** 2).sum(axis=0) - (k @ a).sum(axis=0) ** 2 / m, 0) / (m - 1)) for k, a in zip(kernels, alphas)]
    alphas = [a / np.where(s > 0, s, 1.0) for a, s in zip(alphas, spread)]
    parts = []
    for k, (name, frame) in enumerate(zip(names, rows)):
        centred = inside[k] - inside[k].mean(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            unit = centred / np.linalg.norm(centred, axis=0) / np.sqrt(len(per[k]) - 1)

        def run(batches, unit=unit, own=inside[k], alpha=alphas[k], width=len(per[k])):
            for batch in batches:
                x = stack(batch, "x", width)
                cells = np.concatenate([np.clip(x @ unit, -1, 1), x @ own, x @ alpha], axis=1)
                arrays = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1], np.ascontiguousarray(cells).ravel())
                yield pa.RecordBatch.from_arrays([batch.column("feature"), arrays], names=["feature", "cells"])

        each = F.array(*(F.struct(F.lit(c + 1).alias("comp"), *(F.nanvl(F.col("cells")[c + n * nfac], F.lit(None).cast("double")).alias(v) for n, v in enumerate(("r", "product", "weight")))) for c in range(nfac)))
        parts.append(frame.mapInArrow(run, "feature string, cells array<double>").select(F.lit(k).alias("k"), F.lit(name).alias("table"), F.col("feature").alias("variable"), F.explode(each).alias("e")).select("k", "table", "variable", "e.*"))
    held = reduce(DataFrame.unionByName, parts).persist(StorageLevel.MEMORY_AND_DISK)
    top = held.groupBy("comp").agg(F.max(F.abs("product")).alias("top"))
    first = held.join(F.broadcast(top), "comp").where(F.abs("product") >= (1 - 1e-8) * F.col("top")).groupBy("comp").agg(F.min_by("product", F.struct("k", "variable")).alias("product"))
    sign = {r["comp"]: -1.0 if r["product"] < 0 else 1.0 for r in first.collect()}  # a row for each component
    turn = np.array([sign[c + 1] for c in range(nfac)])
    columns = ", ".join(f"{c} double" for c in comps)
    y = y * turn
    frame = spark.createDataFrame([(s, *map(float, y[n])) for n, s in enumerate(samples)], f"id string, {columns}")
    flip = F.element_at(F.array(*(F.lit(float(v)) for v in turn)), F.col("comp"))
    placed_ = held.select("table", "variable").distinct().withColumn("var_pos", (F.row_number().over(Window.partitionBy("table").orderBy("variable")) - 1).cast("int"))
    cors = held.join(placed_, ["table", "variable"]).select("table", "var_pos", "variable", "comp", (F.col("r") * flip).alias("r"))
    ave_x = held.groupBy("table", "comp").agg(F.avg(F.col("r") * F.col("r")).alias("ave"))
    ave_outer = held.groupBy("comp").agg(F.avg(F.col("r") * F.col("r")).alias("ave"))
    tested = cors.select("table", "var_pos", "variable", "comp", p_value(F.col("r"), m).alias("p")) if p_values else None
    inner = spark.createDataFrame([(c + 1, float(v)) for c, v in enumerate(eigen)], "comp int, eigenvalue double")
    scored = weights = None
    if scores:
        made = []
        for name, own, k, alpha in zip(names, per, kernels, alphas):
            mine = np.zeros((m, nfac))
            mine[[at[s] for s in own]] = k @ alpha * turn
            made += [(name, s, *map(float, mine[n])) for n, s in enumerate(samples)]
        scored = spark.createDataFrame(made, f"table string, id string, {columns}")
        weights = held.select("table", "variable", "comp", (F.col("weight") * flip).alias("weight"))
    frames = {"cors": cors, "p_values": tested, "ave_x": ave_x, "ave_outer": ave_outer}
    return FitResult(frame, scored, inner, tuple(map(float, eigen)), tuple(names), m, lambda: frames, held, weights, tuple(rows))
