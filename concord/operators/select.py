"""From a fit: top and significant variables, and what plots show."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.model import FitResult

#: Colours of groups; those beyond go on with evenly spaced hues.
COLORS = ("red", "blue", "darkgreen", "orange", "violet")


def _fit(x) -> FitResult:
    if not isinstance(x, FitResult):
        raise ValueError("a fit result is needed")
    return x


def top_by_correlation(cors: DataFrame, axis: int = 1, end: str = "pos", top_n: int = 5) -> DataFrame:
    """(table, rank, variable, r): the first ``top_n`` variables of each table by r on the
    axis, descending for ``pos``; ties by position; no more than the smallest table has."""
    if end not in ("pos", "neg"):
        raise ValueError("end is pos or neg")
    own = cors.where(F.col("comp") == axis)
    order = F.desc("r") if end == "pos" else F.asc("r")
    rank = F.row_number().over(Window.partitionBy("table").orderBy(order, "var_pos"))
    least = own.groupBy("table").count().agg(F.min("count").alias("least"))
    return own.withColumn("rank", rank).join(F.broadcast(least), F.col("rank") <= F.least(F.lit(top_n), F.col("least"))).select("table", "rank", "variable", "r")


def top_by_p(cors: DataFrame, p_values: DataFrame, axis: int = 1, end: str = "pos", pval_cut: float = 0.05) -> DataFrame:
    """(table, var_pos, variable, r, p): p at most the cut and r of the end's sign."""
    if end not in ("pos", "neg"):
        raise ValueError("end is pos or neg")
    sign = F.col("r") > 0 if end == "pos" else F.col("r") < 0
    return cors.join(p_values, ["table", "var_pos", "variable", "comp"]).where((F.col("comp") == axis) & (F.col("p") <= pval_cut) & sign).select("table", "var_pos", "variable", "r", "p").orderBy("table", "var_pos")


def top_vars(x: FitResult, axis: int = 1, end: str = "pos", top_n: int = 5, pval_cut: float | None = None) -> DataFrame:
    _fit(x)
    if pval_cut is None:
        return top_by_correlation(x.cors, axis, end, top_n)
    if x.p_values is None:
        raise ValueError("the fit has no p-values")
    return top_by_p(x.cors, x.p_values, axis, end, pval_cut)


def significant(p_values: DataFrame, pval_cut: float = 0.05, tables: list[str] | None = None) -> DataFrame:
    """(variable, table, var_pos, p): variables of which any component's p is below the cut."""
    own = p_values if tables is None else p_values.where(F.col("table").isin(tables))
    return own.groupBy("table", "var_pos", "variable").agg(F.min("p").alias("p")).where(F.col("p") < pval_cut).select("variable", "table", "var_pos", "p")


def get_signif(x: FitResult, df: str | int | list | None = None, pval_cut: float = 0.05) -> DataFrame:
    """Significant variables of all tables, or of those named or numbered (from 1), in the
    order of tables and variables."""
    _fit(x)
    if x.p_values is None:
        raise ValueError("the fit has no p-values")
    wanted = list(x.tables)
    if df is not None:
        wanted = []
        for d in df if isinstance(df, (list, tuple)) else [df]:
            if isinstance(d, int) and 1 <= d <= len(x.tables):
                wanted.append(x.tables[d - 1])
            elif d in x.tables:
                wanted.append(d)
            else:
                raise ValueError(f"there is no table {d}")
    place = F.array_position(F.array(*(F.lit(t) for t in x.tables)), F.col("table"))
    return significant(x.p_values, pval_cut, wanted).orderBy(place, "var_pos").select("variable", "table")


def palette(n: int) -> list[str]:
    more = [f"hsl({round(360 * k / max(1, n - len(COLORS)))},70%,40%)" for k in range(max(0, n - len(COLORS)))]
    return [*COLORS, *more][:n]


def plot_individuals(x: FitResult, groups: DataFrame | None = None, axes: tuple[int, int] = (1, 2), colors: list[str] | None = None) -> DataFrame:
    """(id, x, y, group, color). ``groups``: (id, group); levels are sorted. Individuals pair
    with their group by id."""
    _fit(x)
    if len(axes) != 2 or not all(f"comp{a}" in x.y.columns for a in axes):
        raise ValueError("two axes of the fit are needed")
    own = x.y.select("id", F.col(f"comp{axes[0]}").alias("x"), F.col(f"comp{axes[1]}").alias("y"))
    if groups is None:
        return own.select("*", F.lit(None).cast("string").alias("group"), F.lit((colors or COLORS)[0]).alias("color"))
    levels = [r[0] for r in groups.select(F.col("group").cast("string")).where("group is not null").distinct().orderBy("group").collect()]  # levels of a factor
    colors = colors or palette(len(levels))
    if len(colors) < len(levels):
        raise ValueError(f"{len(levels)} groups need as many colors")
    shades = F.create_map(*[F.lit(v) for pair in zip(levels, colors) for v in pair]) if levels else F.create_map(F.lit(""), F.lit(""))
    named = groups.select(F.col("id").cast("string").alias("id"), F.col("group").cast("string").alias("group"))
    return own.join(named, "id", "left").select("id", "x", "y", "group", F.try_element_at(shades, F.col("group")).alias("color"))


def plot_variables(
    x: FitResult,
    var: list[str] | None = None,
    axes: tuple[int, int] = (1, 2),
    tables: list[str] | None = None,
    var_col: str | list[str] | dict[str, str] = "red",
    bg_var_col: str = "gray",
    min_r: float = 0.0,
    nlab: int | None = None,
    var_lab: bool = True,
) -> DataFrame:
    """(table, variable, x, y, highlighted, color, labelled, label, at_zero): correlations on
    two axes. ``var_col``: one colour, one for each of ``var``, or one for each table by name.
    ``labelled`` from ``min_r`` on either axis on, and of those only the ``nlab`` of each table
    furthest from the origin if given; ``label`` is the variable's name, with ``rep`` behind
    it where an earlier table has one of that name. Variables that no table has are warned of."""
    _fit(x)
    if len(axes) != 2:
        raise ValueError("two axes are needed")
    var = list(var or [])
    if isinstance(var_col, list) and len(var_col) != len(var):
        raise ValueError(f"{len(var)} variables need as many colors, not {len(var_col)}")
    if isinstance(var_col, dict) and (lacking := [t for t in (tables or x.tables) if t not in var_col]):
        raise ValueError(f"there is no color for {', '.join(lacking)}")
    own = x.cors if tables is None else x.cors.where(F.col("table").isin(tables))
    if var:
        known = {r[0] for r in own.where(F.col("variable").isin(var)).select("variable").distinct().collect()}
        if unknown := [v for v in var if v not in known]:
            warnings.warn(f"no table has {', '.join(unknown)}", stacklevel=2)
    pick = [F.max(F.when(F.col("comp") == a, F.col("r"))).alias(n) for a, n in zip(axes, "xy")]
    marked = F.col("variable").isin(var)
    shade = F.lit(var_col) if isinstance(var_col, str) else None
    if shade is None and not var_col:
        shade = F.lit(bg_var_col)
    elif shade is None:
        by, pairs = ("variable", zip(var, var_col)) if isinstance(var_col, list) else ("table", var_col.items())
        shade = F.try_element_at(F.create_map(*(F.lit(v) for pair in pairs for v in pair)), F.col(by))
    order = F.array_position(F.array(*(F.lit(t) for t in x.tables)), F.col("table"))
    points = own.groupBy("table", "var_pos", "variable").agg(*pick).withColumn("far", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    points = points.withColumn("rank", F.row_number().over(Window.partitionBy("table").orderBy(F.desc("far"), "var_pos")))
    points = points.withColumn("again", F.row_number().over(Window.partitionBy("variable").orderBy(order, "var_pos")) > 1)
    labelled = F.greatest(F.abs("x"), F.abs("y")) >= min_r
    labelled = labelled if nlab is None else labelled & (F.col("rank") <= nlab)
    name = F.when(F.col("again"), F.concat("variable", F.lit("rep"))).otherwise(F.col("variable"))
    zero = (F.col("x") == 0) & (F.col("y") == 0)
    return points.select("table", "variable", "x", "y", marked.alias("highlighted"), F.when(marked, shade).otherwise(bg_var_col).alias("color"), labelled.alias("labelled"), F.when(labelled & F.lit(var_lab), name).alias("label"), zero.alias("at_zero"))


def unit_circle(spark, points: int = 100) -> DataFrame:
    """(step, x, y) around the circle that bounds correlations."""
    angle = F.col("step") * (2 * F.pi() / (points - 1))
    return spark.range(points).select(F.col("id").alias("step")).select("step", F.cos(angle).alias("x"), F.sin(angle).alias("y"))


def plot_bins(points: DataFrame, bins: int = 100) -> DataFrame:
    """(color, bin_x, bin_y, n, x, y, reach): all points of a plot, counted in ``bins`` x ``bins``
    cells of a square around the origin that holds them, with the middle of each cell's
    points. Its size follows the cells and colours, not the points."""
    known = points.select("x", "y", "color").where("x is not null and y is not null")
    reach = known.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("reach")).select(F.greatest(F.coalesce("reach", F.lit(0.0)), F.lit(1e-12)).alias("reach"))
    cell = lambda c: F.least(F.floor((F.col(c) / F.col("reach") + 1) / 2 * bins), F.lit(bins - 1)).cast("int")
    placed = known.crossJoin(F.broadcast(reach)).select("color", "x", "y", "reach", cell("x").alias("bin_x"), cell("y").alias("bin_y"))  # one row
    return placed.groupBy("color", "bin_x", "bin_y", "reach").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")).select("color", "bin_x", "bin_y", "n", "x", "y", "reach")


def svg(points: DataFrame, size: int = 400, bins: int | None = None) -> str:
    """A drawing of all points of a plot's data, as SVG text: a dot for each cell of
    :func:`plot_bins`, of which there are as many as pixels if not said otherwise, the larger
    the more points it has, with their number as its title."""
    bins = bins or size
    rows = plot_bins(points, bins).orderBy("color", "bin_x", "bin_y").collect()  # cells x colours
    reach = rows[0]["reach"] if rows else 1.0
    place = lambda v: round(size / 2 * (1 + v / reach * 0.95), 2)
    wide = lambda n: round(min(3 + n.bit_length() - 1, 3 + size / bins), 2)
    dots = "".join(f'<circle cx="{place(r.x)}" cy="{place(-r.y)}" r="{wide(r.n)}" fill="{r.color}"><title>{r.n}</title></circle>' for r in rows)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{size}" height="{size}"><path d="M0 {size / 2}H{size}M{size / 2} 0V{size}" stroke="silver"/>{dots}</svg>'
