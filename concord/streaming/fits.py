"""Fits of a stream whose rows bring the tables of one individual apart.

How much a row weighs depends on how many tables its individual is in, so a table that arrives
late revises what the individual counted for before. State holds the individuals' values, some
thousandth of them under one key, as a call for each individual would cost more than what it
does; each change gives two rows, one that takes the old contribution away and one that adds the
new one. Contributions are moments, so micro-batches add up, and a fit needs nothing else:
means, deviations, cross products and sums of components all follow from them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions.columns import component
from concord.model import Block, FitResult, table_set
from concord.operators.align import aligned
from concord.operators.moments import SQL_LIMIT, grams
from concord.plans.fit import DRIVER_LIMIT, _z, checked, project, report
from concord.plans.solve import match_method, penalties, solve
from concord.sources.paths import delete_path, exists, names_in

_STATE = "ids binary, held binary, versions binary"
#: Keys of state. Individuals of a key are revised at once, in numpy.
BUCKETS = 4096
_ROWS = "sign double, ksum double, x array<double>"
_NEVER = np.iinfo(np.int64).min


@dataclass
class GrowingFit:
    """The fit of ``tables`` (variables by name) over a stream; totals are kept below ``path``.

    The stream has ``table``, ``id``, ``x`` (the values in the order of the table's variables)
    and ``at`` (a whole number that orders the rows of one individual and table: the row with the
    greatest holds, of those that tie the one with the greatest values, whatever the order of
    arrival; null is before all others). More columns are left out. A row of another table,
    without an id, or with values that are missing or too few ends the stream with an error,
    as it does a fit of tables. ``about``: for each table numbers near its means, taken off while moments are
    summed; worthwhile where means are much larger than deviations. State grows with the individuals
    and the driver holds matrices of all tables' variables, of which there may be 4096."""

    tables: dict[str, list[str]]
    path: str
    about: dict[str, list[float]] = field(default_factory=dict)

    def __post_init__(self):
        self.widths = [len(v) for v in self.tables.values()]
        if not self.widths or not all(self.widths):
            raise ValueError("every table needs variables")
        if sum(self.widths) > DRIVER_LIMIT:
            raise ValueError(f"more than {DRIVER_LIMIT} variables")
        self.starts = np.concatenate([[0], np.cumsum(self.widths)])
        self.offset = np.concatenate([np.asarray(self.about.get(k, np.zeros(w)), float) for k, w in zip(self.tables, self.widths)])
        if len(self.offset) != sum(self.widths):
            raise ValueError("about needs a number for each variable")

    @property
    def size(self) -> int:
        """Values of a contribution: 1, which tables there are, all variables."""
        return 1 + len(self.widths) + sum(self.widths)

    def revisions(self, stream: DataFrame) -> DataFrame:
        """(sign, ksum, x): what changes, from state by id."""
        names, widths, starts, offset, count = list(self.tables), self.widths, self.starts, self.offset, len(self.tables)
        number = F.coalesce(*(F.when(F.col("table") == n, F.lit(k)) for k, n in enumerate(names)))
        wanted = F.element_at(F.array(*map(F.lit, widths)), number + 1)
        x = F.col("x").cast("array<double>")
        whole = F.coalesce((F.size(x) == wanted) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.lit(False))
        problem = F.when(number.isNull(), F.concat(F.lit("there is no table "), F.coalesce(F.col("table").cast("string"), F.lit("null")))).when(F.col("id").isNull(), F.lit("a row without an id")).when(~whole, F.concat(F.lit("table "), F.col("table"), F.lit(" has missing values: impute them")))
        rows = stream.select(F.when(problem.isNotNull(), F.raise_error(problem).cast("string")).otherwise(F.col("id").cast("string")).alias("id"), number.alias("t"), x.alias("x"), F.coalesce(F.col("at").cast("bigint"), F.lit(_NEVER)).alias("at"))

        def contributions(sign, held, there):
            flat = np.where(np.repeat(there, widths, axis=1), held - offset, 0.0)
            x = np.concatenate([np.ones((len(held), 1)), there, flat], axis=1)
            return pd.DataFrame({"sign": np.full(len(x), sign), "ksum": there.sum(axis=1).astype(float), "x": list(x)})

        def revise(key, frames, state):
            ids, held, versions, there = [], np.zeros((0, starts[-1])), np.zeros((0, count), np.int64), np.zeros((0, count), bool)
            if state.exists:
                known, kept, told = state.get
                ids = json.loads(known)
                held, told = np.frombuffer(kept).reshape(len(ids), -1), np.frombuffer(told, np.int64).reshape(2, len(ids), count)
                versions, there = told[0], told[1] > 0
            old, place = (held, there), {i: n for n, i in enumerate(ids)}
            held, versions, there, changed = held.copy(), versions.copy(), there.copy(), set()
            for frame in frames:
                at_ = np.array([place.setdefault(i, len(place)) for i in frame["id"]], np.int64)
                if more := len(place) - len(held):
                    held, versions, there = np.concatenate([held, np.zeros((more, starts[-1]))]), np.concatenate([versions, np.full((more, count), _NEVER)]), np.concatenate([there, np.zeros((more, count), bool)])
                tables, at = frame["t"].to_numpy(), frame["at"].to_numpy()
                for t in np.unique(tables).tolist():
                    own = np.flatnonzero(tables == t)
                    values = np.stack(frame["x"].iloc[own].to_list())
                    order = np.lexsort((*values.T[::-1], at[own], at_[own]))  # the greatest row of each individual is its last
                    order = order[np.append(np.diff(at_[own][order]) != 0, True)]
                    who, values, when, mine = at_[own][order], values[order], at[own][order], slice(starts[t], starts[t + 1])
                    now = held[who, mine]
                    apart = (values != now).argmax(axis=1)[:, None]
                    greater = (np.take_along_axis(values, apart, 1) > np.take_along_axis(now, apart, 1))[:, 0]
                    new = ~there[who, t] | (when > versions[who, t]) | ((when == versions[who, t]) & greater)
                    who = who[new]
                    held[who, mine], versions[who, t], there[who, t] = values[new], when[new], True
                    changed.update(who.tolist())
            if changed:
                state.update((json.dumps(list(place)).encode(), held.tobytes(), np.stack([versions, there.astype(np.int64)]).tobytes()))
                rows = np.array(sorted(changed))
                before = rows[rows < len(old[0])]
                yield pd.concat([contributions(-1.0, *(a[before] for a in old)), contributions(1.0, held[rows], there[rows])])

        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)))
        return bucketed.groupBy("bucket").applyInPandasWithState(revise, _ROWS, _STATE, "append", "NoTimeout")

    def add(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: the totals up to this batch, under its number. A batch that
        runs again starts from the same totals before it and writes the same place."""
        spark = batch.sparkSession
        known = [n for n in self._numbers(spark) if n < number]
        weights = ("sign", "sign / ksum", *(f"sign * x[{1 + k}] / (ksum * ksum)" for k in range(len(self.widths))))
        total = np.stack(grams(batch, self.size, weights=weights))
        if known:
            total = total + self._read(spark, known[-1])
        rows = [(k, i, row.tolist()) for k, matrix in enumerate(total) for i, row in enumerate(matrix)]
        spark.createDataFrame(rows, "k int, i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        for old in known[:-1]:  # the last one is what this batch starts from when it runs again
            delete_path(spark, f"{self.path}/batch={old}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        writer = self.revisions(stream).writeStream.outputMode("append").foreachBatch(self.add).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _numbers(self, spark: SparkSession) -> list[int]:
        found = [n for n in names_in(spark, self.path) if n.startswith("batch=")]
        return sorted(int(n.removeprefix("batch=")) for n in found if exists(spark, f"{self.path}/{n}/_SUCCESS"))

    def _read(self, spark: SparkSession, number: int) -> np.ndarray:
        out = np.zeros((2 + len(self.widths), self.size, self.size))
        for r in spark.read.schema("k int, i int, v array<double>").parquet(f"{self.path}/batch={number}").toLocalIterator():
            out[r["k"], r["i"]] = r["v"]
        return out

    def total(self, spark: SparkSession) -> np.ndarray:
        """Moments so far: unweighted, over the number of tables, and for each table those of
        its individuals over the square of that number."""
        known = self._numbers(spark)
        return self._read(spark, known[-1]) if known else np.zeros((2 + len(self.widths), self.size, self.size))

    def fit(self, spark: SparkSession, nfac: int = 2, method: str = "solve", lam=None, p_values: bool = True, p_value_n: str = "all", tables=None) -> FitResult:
        """The fit of all rows so far, equal to that of the tables they make up. ``y`` are the
        components of ``tables`` (any of the same names and variables), ``None`` without."""
        names, widths, starts, count = list(self.tables), self.widths, self.starts, len(self.tables)
        method = match_method(method)
        values = penalties(method, lam, count)
        moments = self.total(spark)
        plain, shared = moments[:2]
        of, flags, first = np.repeat(np.arange(count), widths), np.arange(1, 1 + count), 1 + count
        m, present = round(plain[0, 0]), [round(v) for v in np.diag(plain)[flags]]
        each = np.maximum(np.array(present)[of], 1)
        mean = plain[0, first:] / each
        square = np.maximum(np.diag(plain)[first:] - each * mean**2, 0)
        square[square <= 1e-14 * np.diag(plain)[first:]] = 0.0  # only rounding
        sd = np.sqrt(square / np.maximum(each - 1, 1))
        blocks = {k: Block(None, tuple(v)) for k, v in self.tables.items()}
        stats = {k: {"n": n, "mean": mean[a:b], "sd": sd[a:b], "bad": np.zeros(b - a, int)} for k, n, a, b in zip(names, present, starts, starts[1:])}
        checked(blocks, stats, True)
        # z-scores are linear in contributions
        turn = np.zeros((self.size, len(of)))
        turn[first + np.arange(len(of)), np.arange(len(of))] = 1 / sd
        turn[flags[of], np.arange(len(of))] = -mean / sd
        own, cross = turn.T @ plain @ turn, turn.T @ shared @ turn
        result = solve(own, cross, np.zeros(len(of)), widths, names, values, nfac, m, ginv=method == "ginv")
        products, squares, spread = cross @ result.loadings, np.diag(own), turn @ result.loadings
        comps = [component(k + 1) for k in range(nfac)]

        def details() -> dict:
            r = np.full((len(of), nfac), np.nan)
            for k, (a, b) in enumerate(zip(starts, starts[1:])):
                totals = shared[flags[k]] @ spread
                vy = np.einsum("ij,ik,kj->j", spread, moments[2 + k], spread) - totals**2 / present[k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    r[a:b] = np.clip(products[a:b] / np.sqrt(np.outer(squares[a:b], vy)), -1, 1)
            return report(spark, blocks, names, starts, r, m, present, comps, p_values, p_value_n)

        inner = spark.createDataFrame([(c + 1, float(v)) for c, v in enumerate(result.values)], "comp int, eigenvalue double")
        y = None
        if tables is not None:
            given = table_set(tables)
            if list(given) != names or [len(b.variables) for b in given.values()] != widths:
                raise ValueError("the tables differ from those of the stream")
            rows = aligned(given, len(of) > SQL_LIMIT or any(b.layout == "packed" for b in given.values()))
            y = project(_z(rows, of, mean + self.offset, sd), result.loadings, comps, ["id"], "ksum")
        return FitResult(y, None, inner, tuple(map(float, result.values)), tuple(names), m, details)
