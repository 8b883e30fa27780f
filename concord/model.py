"""What goes in and comes out: blocks, table sets, multi-assay sets and fit results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.sources.paths import discard

#: Blocks with more variables than this keep them in one array column.
WIDE = 100


@dataclass(frozen=True)
class Part:
    """Where a block comes from: rows ``where`` of ``source`` (all if null), with ``x`` of each as its
    values. It stands for the block as long as that has this very ``frame`` and ``variables``."""

    source: DataFrame
    id: Column
    where: Column | None
    x: Column
    frame: DataFrame
    variables: tuple[str, ...]


@dataclass(frozen=True)
class Block:
    """One table: individuals in rows. ``layout`` is ``wide`` (a double column for each
    variable) or ``packed`` (an array column ``x`` in the order of ``variables``). Blocks made
    by :meth:`part` from one frame are read in one scan where they are aligned."""

    frame: DataFrame
    variables: tuple[str, ...]
    id_col: str = "id"
    layout: str = "wide"
    origin: Part | None = field(default=None, compare=False, repr=False)

    @staticmethod
    def wide(frame: DataFrame, id_col: str = "id", variables: list[str] | None = None) -> Block:
        return Block(frame, tuple(variables or [c for c in frame.columns if c != id_col]), id_col)

    @staticmethod
    def packed(frame: DataFrame, variables: list[str], id_col: str = "id", x_col: str = "x") -> Block:
        return Block(frame.select(F.col(id_col).alias("id"), F.col(x_col).cast("array<double>").alias("x")), tuple(variables), "id", "packed")

    @staticmethod
    def part(source: DataFrame, variables: list[str], id_col: str = "id", where: Column | None = None, x: Column | None = None) -> Block:
        """The rows ``where`` of a frame that other blocks share: a column for each variable,
        or the array ``x`` of them."""
        names, rows = tuple(variables), source if where is None else source.where(where)
        key = F.col(f"`{id_col}`").alias("id")
        if x is None:
            x = F.array(*(F.col(f"`{v}`").cast("double") for v in names))
            frame, layout = rows.select(key, *(F.col(f"`{v}`") for v in names)), "wide"
        else:
            x = x.cast("array<double>")
            frame, layout = rows.select(key, x.alias("x")), "packed"
        return Block(frame, names, "id", layout, Part(source, F.col(f"`{id_col}`"), where, x, frame, names))

    def read(self) -> Part:
        """What to read for this block alone, or with others of the same source."""
        if self.origin and self.origin.frame is self.frame and self.origin.variables == self.variables:
            return self.origin
        x = F.col("x").cast("array<double>") if self.layout == "packed" else F.array(*(F.col(f"`{v}`").cast("double") for v in self.variables))
        return Part(self.frame, F.col(self.id_col), None, x, self.frame, self.variables)

    def packed_layout(self) -> Block:
        """The same table in the packed layout."""
        frame, part = self.arrays(), self.read()
        return Block(frame, self.variables, "id", "packed", replace(part, frame=frame))

    def doubles(self) -> DataFrame:
        """(id string, v0, v1, ...), whatever the layout."""
        key = F.col(self.id_col).cast("string").alias("id")
        if self.layout == "wide":
            return self.frame.select(key, *(F.col(f"`{v}`").cast("double").alias(f"v{n}") for n, v in enumerate(self.variables)))
        return self.frame.select(key, *(F.col("x")[n].alias(f"v{n}") for n in range(len(self.variables))))

    def arrays(self) -> DataFrame:
        """(id string, x array<double>), whatever the layout."""
        key = F.col(self.id_col).cast("string").alias("id")
        if self.layout == "packed":
            return self.frame.select(key, "x")
        return self.frame.select(key, F.array(*(F.col(f"`{v}`").cast("double") for v in self.variables)).alias("x"))


def table_set(tables: dict[str, Block] | dict[str, DataFrame] | list) -> dict[str, Block]:
    """Named blocks in order; an unnamed list gets the names df1, df2, ..."""
    if not isinstance(tables, (dict, list, tuple)):
        raise ValueError("tables must be a list or a dict of tables")
    if not isinstance(tables, dict):
        tables = {f"df{n}": t for n, t in enumerate(tables, 1)}
    if not tables:
        raise ValueError("there is no table")
    return {name: t if isinstance(t, Block) else Block.wide(t) for name, t in tables.items()}


@dataclass(frozen=True)
class Assay:
    """Features x samples in long form (feature, sample, value), and what is known of the
    features: (feature, chrom, start, end), or (feature, <coordinate column>)."""

    values: DataFrame
    annotation: DataFrame | None = None


@dataclass(frozen=True)
class AssaySet:
    assays: dict[str, Assay]
    samples: DataFrame | None = None  # (sample, attributes...)

    def __repr__(self) -> str:
        return f"AssaySet: {len(self.assays)} assays\n" + "\n".join(f"  {n}" for n in self.assays)


@dataclass(frozen=True)
class TableList:
    """Blocks made from assays; prints its names."""

    tables: dict[str, Block] = field(default_factory=dict)

    def __repr__(self) -> str:
        return f"TableList: {len(self.tables)} tables\n" + "\n".join(f"  {n}" for n in self.tables)


@dataclass(eq=False)
class FitResult:
    """Frames of a fit. ``y``: id, comp1..; ``cors`` and ``p_values``: table, var_pos,
    variable, comp, r or p; ``scores``: table, id, comp1..; ``ave_x``: table, comp, ave;
    ``ave_outer``: comp, ave; ``ave_inner``: comp, eigenvalue. Correlations and what follows
    from them are made by ``details`` when first asked for. ``weights`` (of dual fits): table,
    variable, comp, weight."""

    y: DataFrame
    scores: DataFrame | None
    ave_inner: DataFrame
    eigenvalues: tuple[float, ...]
    tables: tuple[str, ...]
    n_ids: int
    details: Callable[[], dict]
    cached: DataFrame | None = None
    weights: DataFrame | None = None
    written: tuple[DataFrame, ...] = ()

    @cached_property
    def _details(self) -> dict:
        return self.details()

    @property
    def cors(self) -> DataFrame:
        return self._details["cors"]

    @property
    def p_values(self) -> DataFrame | None:
        return self._details["p_values"]

    @property
    def ave_x(self) -> DataFrame:
        return self._details["ave_x"]

    @property
    def ave_outer(self) -> DataFrame:
        return self._details["ave_outer"]

    NAMES = ("y", "cors", "p_values", "scores", "ave_x", "ave_outer", "ave_inner")

    def save(self, path: str) -> list[str]:
        """Write each frame to a Parquet folder below ``path``; returns their names."""
        names = [n for n in self.NAMES if getattr(self, n) is not None]
        for n in names:
            getattr(self, n).write.mode("overwrite").parquet(f"{path}/{n}")
        return names

    def release(self) -> None:
        """Give up the cached alignment, or the written one."""
        if self.cached is not None:
            self.cached.unpersist()
            discard(self.cached, *self.written)

    def in_order(self) -> DataFrame:
        """``y`` with ``position``: places of the ids in binary order, from 0."""
        from concord.operators.align import numbered

        return numbered(self.y, "id")
