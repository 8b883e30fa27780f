"""Registered queries over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.functions import columns as C
from concord.functions.stats import correlation_p, p_value
from concord.model import Assay, AssaySet, Block, TableList
from concord.operators import align, moments, prep, select
from concord.plans import fit as fits
from concord.plans import tune
from concord.sources import store
from concord.sources.paths import shared_path
from concord.streaming.fits import GrowingFit

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
DIMS = 64  # embedding dimensions
CUT = 0.3
LOW_PRICE = 60_000  # mean prices below it count as missing in impute_assay


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c, 6) + 0.0


# ---------------------------------------------------------------- blocks


def status_block(spark, sf, status: str) -> Block:
    """Customers with orders of one status: mean price."""
    own = table(spark, sf, "orders").where(F.col("o_orderstatus") == status)
    return Block.wide(own.groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("price")))


def status_blocks(spark, sf, statuses: str = "FO") -> dict[str, Block]:
    """As :func:`status_block` for several statuses, from one pass over the orders."""
    status = F.col("o_orderstatus")
    means = [F.avg(F.when(status == s, F.col("o_totalprice"))).alias(f"price_{s}") for s in statuses]
    own = table(spark, sf, "orders").where(status.isin(*statuses)).groupBy(F.col("o_custkey").alias("id")).agg(*means, *(F.count_if(status == s).alias(f"n_{s}") for s in statuses))
    of = {s: Block.part(own, ["price"], where=F.col(f"n_{s}") > 0, x=F.array(f"price_{s}")) for s in statuses}
    return {s.lower(): replace(b, frame=(f := b.frame.select("id", F.col("x")[0].alias("price"))), layout="wide", origin=replace(b.origin, frame=f)) for s, b in of.items()}


def order_blocks(spark, sf, two: bool = True) -> dict[str, Block]:
    """Orders that have lines: (price, year) and (quantity, discount)."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.year("o_orderdate").cast("double").alias("year"))
    both = orders.join(lines, "id")
    return {"orders": Block.part(both, ["price", "year"][: 1 + two]), "lines": Block.part(both, ["quantity", "discount"][: 1 + two])}


def embedding_blocks(spark, sf, blocks: int = 4, width: int = 16) -> dict[str, Block]:
    own = table(spark, sf, "embeddings")
    return {f"b{n}": Block.part(own, [f"e{n * width + k}" for k in range(width)], "vec_id", x=F.slice("embedding", n * width + 1, width)) for n in range(blocks)}


def month_blocks(spark, sf) -> dict[str, Block]:
    """A table for each order priority: customers with such orders, what they spent by month of the year."""
    month = F.month("o_orderdate")
    totals = F.array(*(F.sum(F.when(month == k, F.col("o_totalprice")).otherwise(0.0)) for k in range(1, 13)))
    own = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderpriority").agg(totals.alias("x"))
    return {f"p{p[0]}": Block.part(own, [f"m{k}" for k in range(1, 13)], where=F.col("o_orderpriority") == p, x=F.col("x")) for p in PRIORITIES}


#: Word buckets of each role's table in ``many_variables_eig``.
BUCKETS = 2112


def role_blocks(spark, sf) -> dict[str, Block]:
    """What users and what assistants say: counts of hashed words by conversation, in which a
    role may be missing."""
    said = table(spark, sf, "conversations").select("conv_id", "role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")
    cells = said.groupBy(F.col("conv_id").alias("id"), "role", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("pos")).agg(F.count("*").alias("value"))
    return {role: Block.packed(moments.scattered(cells.where(F.col("role") == role).drop("role"), "id", BUCKETS, 0.0), [f"w{k}" for k in range(BUCKETS)]) for role in ("user", "assistant")}


def price_matrix(spark, sf) -> DataFrame:
    """(feature = customer, sample = priority, value = mean price), null where there is none."""
    own = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("value"))
    customers = own.select("o_custkey").distinct()
    cells = customers.select("o_custkey", F.explode(F.array(*map(F.lit, PRIORITIES))).alias("o_orderpriority"))
    return cells.join(own, ["o_custkey", "o_orderpriority"], "left").select(F.col("o_custkey").cast("string").alias("feature"), F.col("o_orderpriority").alias("sample"), "value")


def priority_totals(rows: DataFrame) -> DataFrame:
    """(feature, sample, value = total) of rows of that form; what has no row is left to the fit to fill."""
    return rows.groupBy("feature", "sample").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def loadings(spark, sf) -> DataFrame:
    """Correlations of all embedding dimensions, in tables a and b, with the sums of each table's."""
    half = DIMS // 2
    total = lambda start: F.aggregate(F.slice("x", start, half), F.lit(0.0), lambda s, v: s + v)
    own = table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("x")).select("x", total(1).alias("c0"), total(half + 1).alias("c1"))
    each = own.select("c0", "c1", F.posexplode("x").alias("v", "e")).groupBy("v").agg(F.corr("e", "c0").alias("r0"), F.corr("e", "c1").alias("r1"))
    comps = F.array(*(F.struct(F.lit(c + 1).alias("comp"), F.col(f"r{c}").alias("r")) for c in (0, 1)))
    return each.select(F.when(F.col("v") < half, "a").otherwise("b").alias("table"), (F.col("v") % half).alias("var_pos"), F.concat(F.lit("e"), "v").alias("variable"), F.explode(comps).alias("c")).select("table", "var_pos", "variable", "c.comp", "c.r")


def loading_p(spark, sf) -> DataFrame:
    n = table(spark, sf, "embeddings").count()
    return loadings(spark, sf).select("table", "var_pos", "variable", "comp", p_value(F.col("r"), n).alias("p"))


def part_features(spark, sf) -> DataFrame:
    start = F.col("p_partkey") * 10
    return table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("feature"), F.col("p_brand").alias("chrom"), start.alias("coord"), start.alias("start"), (start + F.col("p_size")).alias("end"))


def wanted_ranges(spark) -> DataFrame:
    return spark.createDataFrame([("Brand#11", 100, 9000), ("Brand#22", 50, 12000), ("Brand#33", 5000, 5600), ("Brand#44", 1, 100000)], "chrom string, start bigint, end bigint")


# ---------------------------------------------------------------- queries


def zscore_block(spark, sf):
    b = Block.wide(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return fits.scaled(b, moments.column_stats(b)).frame.select("id", r6(F.col("p_size")).alias("z_size"), r6(F.col("p_retailprice")).alias("z_price"))


def scale_only_block(spark, sf):
    b = Block.wide(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    return fits.scaled(b, moments.column_stats(b), center=False).frame.select("id", r6(F.col("p_size")).alias("s_size"), r6(F.col("p_retailprice")).alias("s_price"))


def null_check(spark, sf):
    wide = prep.transpose(price_matrix(spark, sf).select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value"), PRIORITIES)
    return prep.null_check(wide, PRIORITIES).select("variable", "n_missing", r6(F.col("fraction")).alias("fraction"))


def id_union(spark, sf):
    return align.id_union(list(status_blocks(spark, sf).values()))


def id_intersect(spark, sf):
    return align.id_intersect(*status_blocks(spark, sf).values())


def id_absent(spark, sf):
    return align.id_absent(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), status_block(spark, sf, "P"))


def align_zero_fill(spark, sf):
    blocks = status_blocks(spark, sf)
    return align.align_one(blocks["f"], align.id_union(list(blocks.values()))).select("id", r6(F.col("price")).alias("price"), "present")


def presence_ksum(spark, sf):
    return align.presence(status_blocks(spark, sf, "FOP"))


def _aligned_status(spark, sf):
    blocks = status_blocks(spark, sf)
    return align.aligned({k: fits.scaled(b, moments.column_stats(b)) for k, b in blocks.items()}, packed=False)


def _matrix(spark, m: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, j, float(round(m[i, j], 6)) + 0.0) for i in range(len(m)) for j in range(len(m))], "i int, j int, v double")


def gram(spark, sf):
    return _matrix(spark, moments.gram(_aligned_status(spark, sf), 2))


def weighted_cross_gram(spark, sf):
    return _matrix(spark, moments.gram(_aligned_status(spark, sf), 2, weight="1D / ksum"))


def _eig(result) -> DataFrame:
    return result.ave_inner.select("comp", r6(F.col("eigenvalue")).alias("eigenvalue"))


def complete_eig_1var(spark, sf):
    return _eig(fits.fit_complete(order_blocks(spark, sf, two=False), nfac=2))


def complete_components_1var(spark, sf):
    y = fits.fit_complete(order_blocks(spark, sf, two=False), nfac=1).y
    return y.select("id", r6(F.col("comp1")).alias("comp1"))


def complete_eig_2var(spark, sf):
    return _eig(fits.fit_complete(order_blocks(spark, sf), nfac=2))


def complete_eig_packed(spark, sf):
    return _eig(fits.fit_packed(order_blocks(spark, sf), nfac=2))


def incomplete_eig_1var(spark, sf):
    return _eig(fits.fit_incomplete(status_blocks(spark, sf), nfac=2))


def incomplete_components_1var(spark, sf):
    return fits.fit_incomplete(status_blocks(spark, sf), nfac=2).y.select("id", r6(F.col("comp1")).alias("comp1"), r6(F.col("comp2")).alias("comp2"))


def penalized_eig_1var(spark, sf):
    return _eig(fits.fit_incomplete(status_blocks(spark, sf), nfac=2, method="pen", lam=[75.0, 100.0]))


def incomplete_eig_wide(spark, sf):
    return _eig(fits.fit_incomplete(month_blocks(spark, sf), nfac=4))


def complete_eig_wide(spark, sf):
    return _eig(fits.fit_complete(embedding_blocks(spark, sf), nfac=4))


def many_variables_eig(spark, sf):
    """A fit of 4,224 variables, which no process holds a matrix of; buckets without a word are left out."""
    return _eig(fits.fit_incomplete(role_blocks(spark, sf), nfac=2, method="penalized", lam=[20_000.0, 20_000.0], constant="drop", solver="iterative"))


def dual_fit(spark, sf):
    """Order priorities as samples, whose number does not grow; all customers and all parts as features."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("feature"), F.col("o_orderpriority").alias("sample"), F.col("o_totalprice").alias("value"))
    lines = table(spark, sf, "lineitem").join(orders.select("o_orderkey", "sample"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.select(F.col("l_partkey").alias("feature"), "sample", F.col("l_extendedprice").alias("value"))
    assays = {"customers": priority_totals(orders.drop("o_orderkey")), "parts": priority_totals(lines)}
    result = fits.fit_dual(assays, lam=[5.0, 7.0], nfac=3, fill=0.0)
    result.release()  # eigenvalues are held apart from what was written
    return _eig(result)


def scores_1var(spark, sf):
    s = fits.fit_incomplete(status_blocks(spark, sf), nfac=1, scores=True).scores
    return s.select("table", "id", r6(F.col("comp1")).alias("comp1"))


def cors(spark, sf):
    return fits.fit_incomplete(status_blocks(spark, sf), nfac=2).cors.select("table", "comp", r6(F.col("r")).alias("r"))


def t_stat(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    return result.cors.select("table", "comp", F.round(C.t_statistic(F.col("r"), result.n_ids), 4).alias("t"))


def ave(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    own = result.ave_x.select("table", "comp", r6(F.col("ave")).alias("ave"))
    return own.unionByName(result.ave_outer.select(F.lit("outer").alias("table"), "comp", r6(F.col("ave")).alias("ave")))


def embedding_fit(spark, sf):
    """Two components shared by four blocks that hold all embedding dimensions."""
    return fits.fit_complete(embedding_blocks(spark, sf), nfac=2)


def p_values(spark, sf):
    return embedding_fit(spark, sf).p_values


def fit_top_vars_pos(spark, sf):
    return select.top_vars(embedding_fit(spark, sf), 1, "pos", 3).select("table", "rank", "variable", r6(F.col("r")).alias("r"))


def fit_top_vars_neg(spark, sf):
    return select.top_vars(embedding_fit(spark, sf), 2, "neg", 9).select("table", "rank", "variable", r6(F.col("r")).alias("r"))


def fit_top_vars_pcut(spark, sf):
    return select.top_vars(embedding_fit(spark, sf), 1, "neg", pval_cut=CUT).select("table", "var_pos", "variable", r6(F.col("r")).alias("r"))


def fit_significant_vars(spark, sf):
    return select.significant(embedding_fit(spark, sf).p_values, CUT).select("variable", "table", "var_pos")


def top_vars_pos(spark, sf):
    return select.top_by_correlation(loadings(spark, sf), 1, "pos", 3).select("table", "rank", "variable", r6(F.col("r")).alias("r"))


def top_vars_neg(spark, sf):
    return select.top_by_correlation(loadings(spark, sf), 2, "neg", 9).select("table", "rank", "variable", r6(F.col("r")).alias("r"))


def top_vars_pcut(spark, sf):
    return select.top_by_p(loadings(spark, sf), loading_p(spark, sf), 1, "neg", CUT).select("table", "var_pos", "variable", r6(F.col("r")).alias("r"))


def significant_vars(spark, sf):
    return select.significant(loading_p(spark, sf), CUT).select("variable", "table", "var_pos")


def chr_to_num(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, "NA").otherwise(F.get_json_object("props", "$.k"))
    b = Block.wide(table(spark, sf, "events").select("event_id", text.alias("k")), "event_id")
    return prep.to_numbers(TableList({"props": b}), "props").tables["props"].frame


def zero_to_null(spark, sf):
    own = prep.zeros_to_nulls(table(spark, sf, "lineitem"), ["l_tax"])
    return own.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_tax").alias("n_known"), r6(F.avg("l_tax")).alias("mean_tax"))


def drop_sparse_samples(spark, sf):
    own = price_matrix(spark, sf).select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")
    return prep.drop_sparse_samples(own, 0.4).select("feature", "sample", r6(F.col("value")).alias("value"))


def transpose_assay(spark, sf):
    own = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("sample")).agg(r6(F.avg("value")).alias("value"))
    features = [r[0] for r in own.select("feature").distinct().orderBy("feature").collect()]
    out = prep.transpose(own, features)
    return out.select("id", *(F.col(f"`{f}`").alias(f"f{n}") for n, f in enumerate(features)))


def clean_ids(spark, sf):
    b = Block.wide(table(spark, sf, "customer").select("c_name", "c_acctbal"), "c_name")
    return prep.clean_ids(b, 12).frame


def range_point(spark, sf):
    return prep.point_filter(part_features(spark, sf), wanted_ranges(spark), "coord").select("feature")


def range_point_any_chrom(spark, sf):
    return prep.point_filter(part_features(spark, sf), wanted_ranges(spark).where("chrom = 'Brand#33'"), "coord", match_chrom=False).select("feature")


def range_within(spark, sf):
    return prep.within_filter(part_features(spark, sf), wanted_ranges(spark)).select("feature")


def range_semi(spark, sf):
    values = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").alias("value"))
    chosen = prep.region(AssaySet({"lines": Assay(values, part_features(spark, sf))}), wanted_ranges(spark)).assays["lines"].values
    return chosen.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def knn_impute(spark, sf):
    return prep.knn_impute(price_matrix(spark, sf), k=10).select("feature", "sample", F.round(F.col("value") + 3.14e-7, 4).alias("value"))  # off the ties of cents


def month_prices(spark, sf) -> DataFrame:
    """(feature = part, sample = month, value = mean price of its lines), null where there is none."""
    own = table(spark, sf, "lineitem").groupBy("l_partkey", F.month("l_shipdate").alias("month")).agg(F.avg("l_extendedprice").alias("value"))
    cells = own.select("l_partkey").distinct().select("l_partkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return cells.join(own, ["l_partkey", "month"], "left").select(F.col("l_partkey").cast("string").alias("feature"), F.col("month").cast("string").alias("sample"), "value")


def knn_impute_parts(spark, sf):
    return prep.knn_impute(month_prices(spark, sf), k=10, block_rows=256).select("feature", "sample", F.round(F.col("value") + 3.14e-7, 4).alias("value"))


def knn_blocks(spark, sf):
    """Of each block of customers: those that asked, the blocks in all, and how often one was searched in a block."""
    _, near = prep.knn_search(price_matrix(spark, sf), k=10, block_rows=256)
    own = F.sum(F.when(F.col("home") == F.col("block"), F.col("queries")))
    return near.asked.groupBy("home").agg(own.alias("asking"), F.lit(near.blocks).cast("bigint").alias("blocks"), F.count("*").alias("blocks_asked"), F.sum("queries").alias("searches"))


def grid(spark, sf):
    """All pairs of a discount and a tax of the lines."""
    values = lambda c: [r[0] for r in table(spark, sf, "lineitem").select(c).distinct().orderBy(c).collect()]  # noqa: E731  hundredths
    return prep.grid_frame(spark, values("l_discount"), values("l_tax"))


def stream_fit_cors(spark, sf):
    """Orders as a stream: each customer's last price among finished and among open orders, fitted as two tables."""
    orders = spark.readStream.schema(table(spark, sf, "orders").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/orders.parque[t]")  # a pattern, because a stream's path may not be one file
    rows = orders.where("o_orderstatus in ('F', 'O')").select(F.lower("o_orderstatus").alias("table"), F.col("o_custkey").alias("id"), F.array("o_totalprice").alias("x"), F.col("o_orderkey").alias("at"))
    grown = GrowingFit({"f": ["price"], "o": ["price"]}, shared_path(spark, "growing"))
    grown.start(rows, shared_path(spark, "growing-checkpoint")).awaitTermination()
    return grown.fit(spark).cors.select("table", "comp", r6(F.col("r")).alias("r"))


def loo_cv_embeddings(spark, sf):
    """Leave-one-out over penalties of two tables of 32 dimensions each, all rows."""
    own = embedding_blocks(spark, sf, 2, 32)
    _, out = tune.leave_one_out_grid(own["b0"], own["b1"], [0.5, 50.0], [0.5, 50.0], nfac=2)
    return out.select("lambda1", "lambda2", r6(F.col("mean_ave")).alias("mean_ave"))


def loo_cv_1var(spark, sf):
    own = table(spark, sf, "embeddings")
    block = lambda k: Block.wide(own.select(F.col("vec_id").alias("id"), F.col("embedding")[k].cast("double").alias("v")))
    _, out = tune.leave_one_out_grid(block(0), block(1), [1.0, 200.0], [1.0, 50.0, 400.0], nfac=1)
    return out.select("lambda1", "lambda2", r6(F.col("mean_ave")).alias("mean_ave"))


def _ridge_rows(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("x"), F.sum(F.col("l_extendedprice") / 1000).alias("y"))


def ridge_solve(spark, sf):
    return spark.createDataFrame([(v, round(tune.ridge_solve(_ridge_rows(spark, sf), ["x"], "y", v)["x"], 6)) for v in (0.5, 1000.0)], "lambda double, coef double")


def ridge_looe(spark, sf):
    _, out = tune.ridge_looe(_ridge_rows(spark, sf), ["x"], "y", [0.5, 1000.0, 100000.0])
    return out.select("lambda", F.round(F.col("looe") / 1e6, 6).alias("looe"))


def impute_assay(spark, sf):
    """Low prices stand for none: zeros to nulls, sparse samples dropped, nearest neighbours."""
    values = price_matrix(spark, sf).withColumn("value", F.when(F.col("value") < LOW_PRICE, 0.0).otherwise(F.col("value")))
    found = prep.impute(AssaySet({"prices": Assay(values)}), remove_col=True, impute_zero=True, k=10).assays["prices"].values
    return found.select("feature", "sample", F.round(F.col("value") + 3.14e-7, 4).alias("value"))


def region_point(spark, sf):
    values = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").alias("value"))
    chosen = prep.region(AssaySet({"lines": Assay(values, part_features(spark, sf))}), wanted_ranges(spark), ["lines"], "coord").assays["lines"].values
    return chosen.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def complete_scores_1var(spark, sf):
    s = fits.fit_complete(order_blocks(spark, sf, two=False), nfac=1, scores=True).scores
    return s.select("table", "id", r6(F.col("comp1")).alias("comp1"))


def incomplete_eig_3tables(spark, sf):
    return _eig(fits.fit_incomplete(status_blocks(spark, sf, "FOP"), nfac=3))


def p_of_loadings(spark, sf):
    return loading_p(spark, sf).select("table", "var_pos", "variable", "comp", r6(F.col("p")).alias("p"))


def best_penalty(spark, sf):
    own = table(spark, sf, "embeddings")
    block = lambda k: Block.wide(own.select(F.col("vec_id").alias("id"), F.col("embedding")[k].cast("double").alias("v")))
    best, _ = tune.leave_one_out_grid(block(0), block(1), [1.0, 200.0], [1.0, 50.0, 400.0], nfac=1)
    return spark.createDataFrame([best], "lambda1 double, lambda2 double")


def best_ridge(spark, sf):
    best, _ = tune.ridge_looe(_ridge_rows(spark, sf), ["x"], "y", [0.5, 1000.0, 100000.0])
    return spark.createDataFrame([(best,)], "lambda double")


def ridge_inverse(spark, sf):
    g = moments.gram(_ridge_rows(spark, sf).select(F.array("x", "y").alias("x")), 2)
    return _matrix(spark, 1e9 * tune.ridge_inverse(g, 1000.0))


def ridge_inverse_looe(spark, sf):
    best, inverse, _ = tune.ridge_looe_inverse(_ridge_rows(spark, sf), ["x"], "y", [0.5, 1000.0, 100000.0])
    return spark.createDataFrame([(best, round(1e9 * float(inverse[0, 0]), 6))], "lambda double, inverse double")


def first_variables(spark, sf):
    own = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double"), "p_retailprice").alias("x"))
    return prep.head_variables(Block(own, ("size", "price"), "key", "packed"), 1).doubles().select("id", F.col("v0").alias("size"))


def stack_rows(spark, sf):
    return prep.stack_rows([b.frame.select(F.lit(n).alias("table"), F.col("id").cast("string").alias("id"), r6(F.col("price")).alias("price")) for n, b in status_blocks(spark, sf).items()])


def paired_cors(spark, sf):
    found = align.paired_cors(*status_blocks(spark, sf).values())
    return found.select("variable_a", "variable_b", r6(F.col("r")).alias("r"))


def store_assays(spark, sf):
    path = shared_path(spark, "assays")
    names = store.write_assays(AssaySet({"prices": Assay(price_matrix(spark, sf))}), path)
    return store.read_assays(spark, path, names).assays["prices"].values.select("feature", "sample", r6(F.col("value")).alias("value"))


def fit_from_path(spark, sf):
    path = shared_path(spark, "tables")
    store.fit_from_path(spark, path, store.write_tables(status_blocks(spark, sf), path), nfac=2)
    return store.read_fit(spark, f"{path}/out", ["cors"])["cors"].select("table", "comp", r6(F.col("r")).alias("r"))


def diagonal_scaling(spark, sf):
    own = table(spark, sf, "part").select("p_partkey", (1 / F.sqrt(F.col("p_size").cast("double"))).alias("w"), "p_retailprice")
    out = moments.diagonal_scaled(own, ["p_retailprice"], "w", [2.0])
    return out.select("p_partkey", r6(F.col("p_retailprice")).alias("scaled"))


def transpose_packed(spark, sf):
    own = table(spark, sf, "events").groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("sample")).agg(r6(F.avg("value")).alias("value"))
    features = [r[0] for r in own.select("feature").distinct().orderBy("feature").collect()]
    return prep.transpose_packed(own, features).select("id", *(F.col("x")[n].alias(f"f{n}") for n in range(len(features))))


def kernel(spark, sf):
    own = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("feature"), F.col("event_type").alias("sample")).agg((F.avg("value") / 1000).alias("value"))
    samples = [r[0] for r in own.select("sample").distinct().orderBy("sample").collect()]
    return _matrix(spark, moments.kernel(own, samples))


def plot_vars_marked(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    return select.plot_variables(result, ["price"], var_col={"f": "blue", "o": "orange"}, nlab=1).select("table", "color", "labelled", "label", "at_zero")


def plot_inds(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    groups = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("group"))
    return select.plot_individuals(result, groups).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "group", "color")


def plot_vars(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    return select.plot_variables(result, ["price"], tables=["f", "o"]).select("table", "variable", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "highlighted", "color")


def label_of_largest(spark, sf):
    wide = prep.transpose(price_matrix(spark, sf).select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), F.coalesce("value", F.lit(0.0)).alias("value")), PRIORITIES)
    named = wide.select("id", *(F.col(f"`{p}`").alias(f"p{n}") for n, p in enumerate(PRIORITIES)))
    return named.select("id", C.label_of_largest([f"p{n}" for n in range(5)]).alias("label"))


def unit_circle(spark, sf):
    """The circle that holds the correlations of a fit, as wide as the largest of them."""
    most = fits.fit_incomplete(status_blocks(spark, sf), nfac=2).cors.agg(F.max(F.abs("r"))).first()[0]
    return select.unit_circle(spark).select("step", r6(F.col("x") * most).alias("x"), r6(F.col("y") * most).alias("y"))


def id_union_sorted(spark, sf):
    return align.id_union(list(status_blocks(spark, sf).values()), order="sorted")


def id_union_first(spark, sf):
    """Customers as they first appear: those with orders of status F by their first order, then the others."""
    own = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus").agg(F.min("o_orderkey").alias("at"))
    return align.id_union([own.where(F.col("o_orderstatus") == s) for s in ("F", "O")], order="first", order_col="at")


def ginv_eig(spark, sf):
    """A table with a variable that is three times another."""
    blocks = status_blocks(spark, sf)
    return _eig(fits.fit_incomplete(blocks | {"f": Block.wide(blocks["f"].frame.withColumn("more", 3 * F.col("price") + 1))}, nfac=2, method="ginv"))


def _nation_assays(spark, sf) -> dict[str, DataFrame]:
    """One feature each, nations as samples: mean balances of customers and of suppliers."""
    mean = lambda name, c: table(spark, sf, name).groupBy(F.col(f"{c}_nationkey").cast("string").alias("sample")).agg(F.avg(f"{c}_acctbal").alias("value")).select(F.lit("balance").alias("feature"), "sample", "value")
    return {"customers": mean("customer", "c"), "suppliers": mean("supplier", "s")}


def dual_scores(spark, sf):
    return fits.fit_dual(_nation_assays(spark, sf), lam=[5.0, 7.0], nfac=1, scores=True).scores.select("table", "id", r6(F.col("comp1")).alias("comp1"))


def kernel_looe(spark, sf):
    values = _nation_assays(spark, sf)["customers"].withColumn("value", F.col("value") / 1000)
    y = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("sample")).agg((F.count("*") / 10).alias("value"))
    _, found, _, _ = tune.kernel_looe(values, y, [0.5, 50.0, 1000.0])
    return found.select("lambda", r6(F.col("looe")).alias("looe"))


def stored_region(spark, sf):
    """Features in ranges, chosen from stored assays by their stored annotation."""
    path = shared_path(spark, "assays")
    values = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("feature"), F.col("l_suppkey").cast("string").alias("sample"), F.col("l_quantity").alias("value"))
    names = store.write_assays(AssaySet({"lines": Assay(values, part_features(spark, sf))}), path)
    chosen = prep.region(store.read_assays(spark, path, names), wanted_ranges(spark)).assays["lines"].values
    return chosen.groupBy("feature").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def plot_density(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    found = select.plot_bins(select.plot_individuals(result), 20)
    return found.select("color", "bin_x", "bin_y", "n", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def save_load(spark, sf):
    result = fits.fit_incomplete(status_blocks(spark, sf), nfac=2)
    path = shared_path(spark, "fit")
    frames = store.read_fit(spark, path, result.save(path))
    return frames["cors"].select("table", "comp", r6(F.col("r")).alias("r"))


def flagship(spark, sf):
    """Components shared by four embedding blocks, and how they relate to the first block."""
    result = fits.fit_complete(embedding_blocks(spark, sf), nfac=2)
    return result.cors


QUERIES = {f.__name__: f for f in (zscore_block, scale_only_block, null_check, id_union, id_intersect, id_absent, align_zero_fill, presence_ksum, gram, weighted_cross_gram, complete_eig_1var, complete_components_1var, complete_eig_2var, complete_eig_packed, incomplete_eig_1var, incomplete_components_1var, penalized_eig_1var, incomplete_eig_wide, complete_eig_wide, many_variables_eig, dual_fit, scores_1var, cors, t_stat, ave, p_values, fit_top_vars_pos, fit_top_vars_neg, fit_top_vars_pcut, fit_significant_vars, top_vars_pos, top_vars_neg, top_vars_pcut, significant_vars, chr_to_num, zero_to_null, drop_sparse_samples, transpose_assay, clean_ids, range_point, range_point_any_chrom, range_within, range_semi, knn_impute, knn_impute_parts, knn_blocks, grid, loo_cv_1var, loo_cv_embeddings, stream_fit_cors, ridge_solve, ridge_looe, plot_inds, plot_vars, label_of_largest, unit_circle, save_load, impute_assay, region_point, complete_scores_1var, incomplete_eig_3tables, p_of_loadings, best_penalty, best_ridge, ridge_inverse, ridge_inverse_looe, first_variables, stack_rows, paired_cors, store_assays, fit_from_path, diagonal_scaling, transpose_packed, kernel, plot_vars_marked, id_union_sorted, id_union_first, ginv_eig, dual_scores, kernel_looe, stored_region, plot_density)}


# ---------------------------------------------------------------- SQL


def R(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _status(name: str, status: str) -> str:
    return f"{name} AS (SELECT CAST(o_custkey AS VARCHAR) AS id, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1)"


STATUS = f"{_status('f', 'F')}, {_status('o', 'O')}, {_status('p', 'P')}"


def _pair(source: str, lam: tuple[float, float] = (0, 0)) -> str:
    """CTEs from ``pa(id, x)`` and ``pb(id, x)``: z-scores, alignment, moments, the 2 x 2
    eigenproblem in closed form, components."""
    return f"""WITH {source},
za AS (SELECT id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM pa),
zb AS (SELECT id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM pb),
al AS (SELECT coalesce(za.id, zb.id) AS id, coalesce(za.z, 0) AS a, coalesce(zb.z, 0) AS b, za.id IS NOT NULL AS ina, zb.id IS NOT NULL AS inb,
  CAST(za.id IS NOT NULL AS INTEGER) + CAST(zb.id IS NOT NULL AS INTEGER) AS k FROM za FULL JOIN zb ON za.id = zb.id),
mo AS (SELECT sum(a * a) AS s1, sum(b * b) AS s2, sum(a * a / k) AS c11, sum(a * b / k) AS c12, sum(b * b / k) AS c22, count(*) AS m,
  sum(a * a) + {lam[0]} AS d1, sum(b * b) + {lam[1]} AS d2 FROM al),
gg AS (SELECT *, c11 / d1 AS p, c12 / sqrt(d1 * d2) AS q, c22 / d2 AS s FROM mo),
ev AS (SELECT *, 1 AS comp, (p + s) / 2 + sqrt(((p - s) / 2) * ((p - s) / 2) + q * q) AS v FROM gg
  UNION ALL SELECT *, 2 AS comp, (p + s) / 2 - sqrt(((p - s) / 2) * ((p - s) / 2) + q * q) AS v FROM gg),
ld AS (SELECT *, sqrt(2) * q / sqrt(q * q + (v - p) * (v - p)) / sqrt(d1) / sqrt(v) AS l1, sqrt(2) * (v - p) / sqrt(q * q + (v - p) * (v - p)) / sqrt(d2) / sqrt(v) AS l2 FROM ev),
pr AS (SELECT *, c11 * l1 + c12 * l2 AS w1, c12 * l1 + c22 * l2 AS w2 FROM ld),
sg AS (SELECT *, CASE WHEN abs(w1) >= (1 - 1e-8) * greatest(abs(w1), abs(w2)) THEN sign(w1) ELSE sign(w2) END AS e FROM pr),
yy AS (SELECT id, a, b, ina, inb, k, comp, e * (a * l1 + b * l2) / k AS y FROM al, sg),
rr AS (SELECT 'f' AS "table", comp, corr(a, y) AS r FROM yy WHERE ina GROUP BY comp UNION ALL SELECT 'o', comp, corr(b, y) FROM yy WHERE inb GROUP BY comp)
"""


def _last_price(name: str, status: str) -> str:
    return f"{name} AS (SELECT CAST(o_custkey AS VARCHAR) AS id, arg_max(o_totalprice, o_orderkey) AS x FROM orders WHERE o_orderstatus = '{status}' GROUP BY 1)"


PAIR = _pair(f"{_status('pa', 'F')}, {_status('pb', 'O')}")
_LINES = "li AS (SELECT l_orderkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount FROM lineitem GROUP BY 1), od AS (SELECT o_orderkey, o_totalprice AS price, CAST(year(o_orderdate) AS DOUBLE) AS yr, quantity, discount FROM orders JOIN li ON o_orderkey = l_orderkey)"
ORDERS = _pair(f"{_LINES}, pa AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, price AS x FROM od), pb AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, quantity AS x FROM od)")
# canonical correlations of two pairs: eigenvalues of A^-1 B C^-1 B' for 2 x 2 blocks of correlations
CANON = f"""WITH {_LINES},
c AS (SELECT corr(price, yr) AS a, corr(quantity, discount) AS d, corr(price, quantity) AS b11, corr(price, discount) AS b12, corr(yr, quantity) AS b21, corr(yr, discount) AS b22 FROM od),
x AS (SELECT *, (b11 - a * b21) / (1 - a * a) AS m11, (b12 - a * b22) / (1 - a * a) AS m12, (b21 - a * b11) / (1 - a * a) AS m21, (b22 - a * b12) / (1 - a * a) AS m22,
  (b11 - d * b12) / (1 - d * d) AS n11, (b12 - d * b11) / (1 - d * d) AS n21, (b21 - d * b22) / (1 - d * d) AS n12, (b22 - d * b21) / (1 - d * d) AS n22 FROM c),
t AS (SELECT m11 * n11 + m12 * n21 + m21 * n12 + m22 * n22 AS tr, (m11 * m22 - m12 * m21) * (n11 * n22 - n12 * n21) AS de FROM x),
e AS (SELECT 1 AS comp, 1 + sqrt(tr / 2 + sqrt(tr * tr / 4 - de)) AS v FROM t UNION ALL SELECT 2, 1 + sqrt(tr / 2 - sqrt(tr * tr / 4 - de)) FROM t)
"""
MATRIX = """WITH own AS (SELECT o_custkey, o_orderpriority, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
cells AS (SELECT o_custkey, p.o_orderpriority FROM (SELECT DISTINCT o_custkey FROM orders) c, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) p(o_orderpriority)),
pm AS (SELECT CAST(cells.o_custkey AS VARCHAR) AS customer, cells.o_orderpriority AS priority, value FROM cells LEFT JOIN own ON cells.o_custkey = own.o_custkey AND cells.o_orderpriority = own.o_orderpriority)
"""
FEATURES = """WITH ft AS (SELECT CAST(p_partkey AS VARCHAR) AS feature, p_brand AS chrom, p_partkey * 10 AS st, p_partkey * 10 + p_size AS en FROM part),
q(chrom, st, en) AS (VALUES ('Brand#11', 100, 9000), ('Brand#22', 50, 12000), ('Brand#33', 5000, 5600), ('Brand#44', 1, 100000))
"""
LOADINGS = f"""WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c AS (SELECT x, list_sum(x[1:{DIMS // 2}]) AS c0, list_sum(x[{DIMS // 2 + 1}:{DIMS}]) AS c1 FROM e),
u AS (SELECT CAST(unnest(range({DIMS})) AS INTEGER) AS v, unnest(x) AS x, c0, c1 FROM c),
g AS (SELECT v, corr(x, c0) AS r0, corr(x, c1) AS r1, count(*) AS n FROM u GROUP BY v),
ld AS (SELECT CASE WHEN v < {DIMS // 2} THEN 'a' ELSE 'b' END AS "table", v % {DIMS // 2} AS var_pos, 'e' || v AS variable, comp, CASE comp WHEN 1 THEN r0 ELSE r1 END AS r, n FROM g, (VALUES (1), (2)) k(comp))"""


def critical_r(n: int, cut: float) -> float:
    """The correlation whose two-sided p over n individuals is ``cut``."""
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if correlation_p(np.array([mid]), n)[0] > cut else (low, mid)
    return high


MONTHS = """WITH po AS (SELECT CAST(l_partkey AS VARCHAR) AS customer, CAST(month(l_shipdate) AS VARCHAR) AS priority, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
mp AS (SELECT c.customer, p.priority, po.value FROM (SELECT DISTINCT customer FROM po) c CROSS JOIN (SELECT CAST(n AS VARCHAR) AS priority FROM range(1, 13) r(n)) p LEFT JOIN po ON po.customer = c.customer AND po.priority = p.priority)"""


def _knn(pm: str) -> str:
    """CTEs and the query of nearest-neighbour imputation over ``pm`` (customer, priority, value)."""
    return f"""gaps AS (SELECT customer FROM {pm} GROUP BY 1 HAVING avg(CAST(value IS NULL AS INTEGER)) BETWEEN 0.01 AND 0.5),
d AS (SELECT x.customer AS a, y.customer AS b, avg((x.value - y.value) * (x.value - y.value)) AS dist FROM {pm} x JOIN {pm} y ON x.priority = y.priority AND x.customer <> y.customer WHERE x.customer IN (SELECT customer FROM gaps) AND x.value IS NOT NULL AND y.value IS NOT NULL GROUP BY 1, 2),
n AS (SELECT g.customer, g.priority, y.value, row_number() OVER (PARTITION BY g.customer, g.priority ORDER BY dist, b) AS rk FROM {pm} g JOIN d ON d.a = g.customer JOIN {pm} y ON y.customer = d.b AND y.priority = g.priority WHERE g.value IS NULL AND y.value IS NOT NULL),
f AS (SELECT customer, priority, avg(value) AS filled FROM n WHERE rk <= 10 GROUP BY 1, 2),
m AS (SELECT priority, avg(value) AS mean FROM {pm} GROUP BY 1)
SELECT {pm}.customer AS feature, {pm}.priority AS sample, round(coalesce({pm}.value, filled, mean) + 3.14e-7, 4) AS value FROM {pm} JOIN m ON m.priority = {pm}.priority LEFT JOIN f ON f.customer = {pm}.customer AND f.priority = {pm}.priority"""


_LIMIT = "CASE n " + " ".join(f"WHEN {n} THEN {critical_r(n, CUT)!r}" for n in (500, 2000)) + " END"

LOO = f"""WITH e AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
t AS (SELECT count(*) - 1 AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM e),
r AS (SELECT n, (sxy - e.x * e.y - (sx - e.x) * (sy - e.y) / n) / sqrt((sxx - e.x * e.x - (sx - e.x) * (sx - e.x) / n) * (syy - e.y * e.y - (sy - e.y) * (sy - e.y) / n)) AS r FROM e, t),
g AS (SELECT r.r, CAST(a AS DOUBLE) AS l1, CAST(b AS DOUBLE) AS l2, n - 1 + a AS d1, n - 1 + b AS d2, (n - 1) / (n - 1 + a) AS p, r.r * (n - 1) / sqrt((n - 1 + a) * (n - 1 + b)) AS q, (n - 1) / (n - 1 + b) AS s FROM r, (VALUES (1.0::DOUBLE), (200.0::DOUBLE)) x(a), (VALUES (1.0::DOUBLE), (50.0::DOUBLE), (400.0::DOUBLE)) y(b)),
v AS (SELECT *, (p + s) / 2 + sqrt(((p - s) / 2) * ((p - s) / 2) + q * q) AS v FROM g),
w AS (SELECT *, q / sqrt(d1) AS a, (v - p) / sqrt(d2) AS b FROM v)
SELECT l1 AS lambda1, l2 AS lambda2, {R('avg(((a + b * r) * (a + b * r) + (b + a * r) * (b + a * r)) / (a * a + b * b + 2 * a * b * r) / 2)')} AS mean_ave FROM w GROUP BY 1, 2"""
LOOE = "WITH o AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice / 1000) AS y FROM lineitem GROUP BY l_orderkey), t AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy FROM o) SELECT CAST(lam AS DOUBLE) AS lambda, round(sum(power((y - x * sxy / (sxx + lam)) / (1 - x * x / (sxx + lam)), 2)) / 1e6, 6) AS looe FROM o, t, (VALUES (0.5::DOUBLE), (1000.0::DOUBLE), (100000.0::DOUBLE)) l(lam) GROUP BY lam"

BEST_RIDGE = "WITH o AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice / 1000) AS y FROM lineitem GROUP BY l_orderkey), t AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy FROM o) SELECT CAST(lam AS DOUBLE) AS lambda, any_value(sxx) AS sxx FROM o, t, (VALUES (0.5::DOUBLE), (1000.0::DOUBLE), (100000.0::DOUBLE)) l(lam) GROUP BY lam ORDER BY sum(power((y - x * sxy / (sxx + lam)) / (1 - x * x / (sxx + lam)), 2)), lam LIMIT 1"
_TRANSPOSED = "WITH t AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM (SELECT DISTINCT event_type FROM events)), v AS (SELECT user_id, k, round(avg(value), 6) + 0.0 AS v FROM events JOIN t ON events.event_type = t.event_type GROUP BY 1, 2) SELECT user_id AS id, " + ", ".join(f"max(CASE k WHEN {n} THEN v END) AS f{n}" for n in range(5)) + " FROM v GROUP BY 1"

SQL = {
    "zscore_block": f"SELECT CAST(p_partkey AS VARCHAR) AS id, {R('(p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER ()')} AS z_size, {R('(p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER ()')} AS z_price FROM part",
    "scale_only_block": f"SELECT CAST(p_partkey AS VARCHAR) AS id, {R('p_size / stddev_samp(p_size) OVER ()')} AS s_size, {R('p_retailprice / stddev_samp(p_retailprice) OVER ()')} AS s_price FROM part",
    "null_check": f"{MATRIX} SELECT priority AS variable, count(*) FILTER (value IS NULL) AS n_missing, {R('avg(CAST(value IS NULL AS INTEGER))')} AS fraction FROM pm GROUP BY 1",
    "id_union": f"WITH {STATUS} SELECT id FROM f UNION SELECT id FROM o",
    "id_intersect": f"WITH {STATUS} SELECT id FROM f INTERSECT SELECT id FROM o",
    "id_absent": f"WITH {STATUS} SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer EXCEPT SELECT id FROM p",
    "align_zero_fill": f"WITH {STATUS}, u AS (SELECT id FROM f UNION SELECT id FROM o) SELECT u.id, {R('coalesce(f.x, 0)')} AS price, CAST(f.id IS NOT NULL AS INTEGER) AS present FROM u LEFT JOIN f ON u.id = f.id",
    "presence_ksum": f"WITH {STATUS}, u AS (SELECT id FROM f UNION SELECT id FROM o UNION SELECT id FROM p) SELECT u.id, CAST(f.id IS NOT NULL AS INTEGER) AS f, CAST(o.id IS NOT NULL AS INTEGER) AS o, CAST(p.id IS NOT NULL AS INTEGER) AS p, CAST(f.id IS NOT NULL AS INTEGER) + CAST(o.id IS NOT NULL AS INTEGER) + CAST(p.id IS NOT NULL AS INTEGER) AS ksum FROM u LEFT JOIN f ON u.id = f.id LEFT JOIN o ON u.id = o.id LEFT JOIN p ON u.id = p.id",
    "gram": f"{PAIR} SELECT i, j, {R('sum(CASE i WHEN 0 THEN a ELSE b END * CASE j WHEN 0 THEN a ELSE b END)')} AS v FROM al, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j) GROUP BY i, j",
    "weighted_cross_gram": f"{PAIR} SELECT i, j, {R('sum(CASE i WHEN 0 THEN a ELSE b END * CASE j WHEN 0 THEN a ELSE b END / k)')} AS v FROM al, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j) GROUP BY i, j",
    "complete_eig_1var": f"{ORDERS} SELECT comp, {R('2 * v')} AS eigenvalue FROM ev",
    "complete_components_1var": f"{ORDERS} SELECT id, {R('y')} AS comp1 FROM yy WHERE comp = 1",
    "complete_eig_2var": f"{CANON} SELECT comp, {R('v')} AS eigenvalue FROM e",
    "complete_eig_packed": f"{CANON} SELECT comp, {R('v / 2')} AS eigenvalue FROM e",
    "stream_fit_cors": f"{_pair(_last_price('pa', 'F') + ', ' + _last_price('pb', 'O'))} SELECT \"table\", comp, {R('r')} AS r FROM rr",
    "incomplete_eig_1var": f"{PAIR} SELECT comp, {R('v')} AS eigenvalue FROM ev",
    "incomplete_components_1var": f"{PAIR} SELECT id, {R('max(CASE comp WHEN 1 THEN y END)')} AS comp1, {R('max(CASE comp WHEN 2 THEN y END)')} AS comp2 FROM yy GROUP BY id",
    "penalized_eig_1var": f"{_pair(_status('pa', 'F') + ', ' + _status('pb', 'O'), (75, 100))} SELECT comp, {R('v')} AS eigenvalue FROM ev",
    "scores_1var": f"{PAIR}, sc AS (SELECT 'f' AS \"table\", id, sign(e * w1) * a / stddev_samp(a) OVER () AS s FROM al, sg WHERE comp = 1 UNION ALL SELECT 'o', id, sign(e * w2) * b / stddev_samp(b) OVER () FROM al, sg WHERE comp = 1) SELECT \"table\", id, {R('s')} AS comp1 FROM sc",
    "cors": f"{PAIR} SELECT \"table\", comp, {R('r')} AS r FROM rr",
    "t_stat": f"{PAIR} SELECT \"table\", comp, round(r * sqrt(m - 2) / sqrt(1 - r * r), 4) AS t FROM rr, mo",
    "ave": f"{PAIR} SELECT \"table\", comp, {R('r * r')} AS ave FROM rr UNION ALL SELECT 'outer', comp, {R('avg(r * r)')} FROM rr GROUP BY comp",
    "top_vars_pos": f"{LOADINGS} SELECT \"table\", CAST(rk AS INTEGER) AS rank, variable, {R('r')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY r DESC, var_pos) AS rk FROM ld WHERE comp = 1) WHERE rk <= 3",
    "top_vars_neg": f"{LOADINGS} SELECT \"table\", CAST(rk AS INTEGER) AS rank, variable, {R('r')} AS r FROM (SELECT *, row_number() OVER (PARTITION BY \"table\" ORDER BY r, var_pos) AS rk FROM ld WHERE comp = 2) WHERE rk <= least(9, {DIMS // 2})",
    "top_vars_pcut": f"{LOADINGS} SELECT \"table\", var_pos, variable, {R('r')} AS r FROM ld WHERE comp = 1 AND r < 0 AND abs(r) >= {_LIMIT}",
    "significant_vars": f"{LOADINGS} SELECT variable, \"table\", var_pos FROM ld WHERE abs(r) > {_LIMIT} GROUP BY ALL",
    "chr_to_num": "SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'NA' ELSE json_extract_string(props, '$.k') END AS DOUBLE) AS k FROM events",
    "zero_to_null": f"SELECT l_returnflag, count(*) AS n, count(nullif(l_tax, 0)) AS n_known, {R('avg(nullif(l_tax, 0))')} AS mean_tax FROM lineitem GROUP BY 1",
    "drop_sparse_samples": f"{MATRIX} SELECT priority AS feature, customer AS sample, {R('value')} AS value FROM pm WHERE customer IN (SELECT customer FROM pm GROUP BY 1 HAVING avg(CAST(value IS NULL AS INTEGER)) < 0.4)",
    "transpose_assay": _TRANSPOSED,
    "transpose_packed": _TRANSPOSED,
    "clean_ids": "SELECT substr(c_name, 1, 12) AS id, c_acctbal FROM customer",
    "range_point": f"{FEATURES} SELECT feature FROM ft WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = ft.chrom AND ft.st BETWEEN q.st AND q.en)",
    "range_point_any_chrom": f"{FEATURES} SELECT feature FROM ft WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = 'Brand#33' AND ft.st BETWEEN q.st AND q.en)",
    "range_within": f"{FEATURES} SELECT feature FROM ft WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = ft.chrom AND ft.st >= q.st AND ft.en <= q.en)",
    "range_semi": f"{FEATURES} SELECT feature, count(*) AS n, sum(l_quantity) AS total FROM ft JOIN lineitem ON feature = CAST(l_partkey AS VARCHAR) WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = ft.chrom AND ft.st >= q.st AND ft.en <= q.en) GROUP BY 1",
    "knn_impute": f"{MATRIX}, {_knn('pm')}",
    "knn_impute_parts": f"{MONTHS}, {_knn('mp')}",
    "impute_assay": f"{MATRIX}, px AS (SELECT customer, priority, CASE WHEN value < {LOW_PRICE} THEN NULL ELSE value END AS value FROM pm), py AS (SELECT * FROM px WHERE priority IN (SELECT priority FROM px GROUP BY 1 HAVING avg(CAST(value IS NULL AS INTEGER)) < 0.8)), {_knn('py')}",
    "region_point": f"{FEATURES} SELECT feature, count(*) AS n, sum(l_quantity) AS total FROM ft JOIN lineitem ON feature = CAST(l_partkey AS VARCHAR) WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = ft.chrom AND ft.st BETWEEN q.st AND q.en) GROUP BY 1",
    "complete_scores_1var": f"{ORDERS}, sc AS (SELECT 'orders' AS \"table\", id, sign(e * w1) * a / stddev_samp(a) OVER () AS s FROM al, sg WHERE comp = 1 UNION ALL SELECT 'lines', id, sign(e * w2) * b / stddev_samp(b) OVER () FROM al, sg WHERE comp = 1) SELECT \"table\", id, {R('s')} AS comp1 FROM sc",
    # eigenvalues of a symmetric 3 x 3 matrix by the trigonometric solution of the cubic
    "incomplete_eig_3tables": f"""WITH {STATUS},
z AS (SELECT 1 AS t, id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () AS z FROM f UNION ALL SELECT 2, id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () FROM o UNION ALL SELECT 3, id, (x - avg(x) OVER ()) / stddev_samp(x) OVER () FROM p),
al AS (SELECT id, count(*) AS k, coalesce(max(CASE t WHEN 1 THEN z END), 0) AS a, coalesce(max(CASE t WHEN 2 THEN z END), 0) AS b, coalesce(max(CASE t WHEN 3 THEN z END), 0) AS c FROM z GROUP BY id),
g AS (SELECT sum(a*a/k)/sum(a*a) AS g11, sum(b*b/k)/sum(b*b) AS g22, sum(c*c/k)/sum(c*c) AS g33, sum(a*b/k)/sqrt(sum(a*a)*sum(b*b)) AS g12, sum(a*c/k)/sqrt(sum(a*a)*sum(c*c)) AS g13, sum(b*c/k)/sqrt(sum(b*b)*sum(c*c)) AS g23 FROM al),
q AS (SELECT *, (g11+g22+g33)/3 AS q FROM g),
w AS (SELECT *, sqrt(((g11-q)*(g11-q)+(g22-q)*(g22-q)+(g33-q)*(g33-q)+2*(g12*g12+g13*g13+g23*g23))/6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1, least(1, ((g11-q)*((g22-q)*(g33-q)-g23*g23)-g12*(g12*(g33-q)-g23*g13)+g13*(g12*g23-(g22-q)*g13))/(2*p*p*p))))/3 AS phi FROM w)
SELECT comp, round(q+2*p*cos(phi+2*pi()*turn/3), 6) + 0.0 AS eigenvalue FROM r, (VALUES (1, 0), (2, 2), (3, 1)) v(comp, turn)""",
    # the tail of t over an even number of degrees of freedom is a finite series in 1 - r * r
    "p_of_loadings": f"{LOADINGS} SELECT \"table\", var_pos, variable, comp, {R('1 - abs(r) * list_sum(list_transform(range((n - 2) // 2), lambda j: exp(lgamma(2.0 * j + 1) - 2 * lgamma(j + 1.0) - j * ln(4) + j * ln(1 - r * r))))')} AS p FROM ld",
    "best_penalty": f"SELECT lambda1, lambda2 FROM ({LOO}) ORDER BY mean_ave DESC, lambda2, lambda1 LIMIT 1",
    "best_ridge": f"SELECT \"lambda\" FROM ({BEST_RIDGE})",
    "ridge_inverse": f"WITH o AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice / 1000) AS y FROM lineitem GROUP BY l_orderkey), s AS (SELECT sum(x * x) + 1000 AS a, sum(x * y) AS b, sum(y * y) + 1000 AS d FROM o) SELECT i, j, {R('1e9 * CASE WHEN i <> j THEN -b WHEN i = 0 THEN d ELSE a END / (a * d - b * b)')} AS v FROM s, (VALUES (0), (1)) u(i), (VALUES (0), (1)) w(j)",
    "ridge_inverse_looe": f"SELECT \"lambda\", {R('1e9 / (sxx + "lambda")')} AS inverse FROM ({BEST_RIDGE})",
    "first_variables": "SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_size AS DOUBLE) AS size FROM part",
    "stack_rows": f"WITH {STATUS} SELECT 'f' AS \"table\", id, {R('x')} AS price FROM f UNION ALL SELECT 'o', id, {R('x')} FROM o",
    "paired_cors": f"WITH {STATUS} SELECT 'price' AS variable_a, 'price' AS variable_b, {R('corr(f.x, o.x)')} AS r FROM f JOIN o ON f.id = o.id",
    "store_assays": f"{MATRIX} SELECT customer AS feature, priority AS sample, {R('value')} AS value FROM pm",
    "fit_from_path": f"{PAIR} SELECT \"table\", comp, {R('r')} AS r FROM rr",
    "diagonal_scaling": f"SELECT p_partkey, {R('2 * p_retailprice / sqrt(p_size)')} AS scaled FROM part",
    "kernel": f"WITH e AS (SELECT user_id, dense_rank() OVER (ORDER BY event_type) - 1 AS k, avg(value) / 1000 AS v FROM events GROUP BY user_id, event_type) SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, {R('sum(a.v * b.v)')} AS v FROM e a JOIN e b ON a.user_id = b.user_id GROUP BY 1, 2",
    "plot_vars_marked": "SELECT * FROM (VALUES ('f', 'blue', TRUE, 'price', FALSE), ('o', 'orange', TRUE, 'pricerep', FALSE)) t(\"table\", color, labelled, label, at_zero)",
    "grid": "WITH d AS (SELECT DISTINCT l_discount AS a FROM lineitem), t AS (SELECT DISTINCT l_tax AS b FROM lineitem) SELECT CAST(row_number() OVER (ORDER BY b, a) - 1 AS INTEGER) AS place, a AS lambda1, b AS lambda2 FROM d, t",
    "loo_cv_1var": LOO,
    "ridge_solve": "WITH o AS (SELECT sum(l_quantity) AS x, sum(l_extendedprice / 1000) AS y FROM lineitem GROUP BY l_orderkey) SELECT CAST(lam AS DOUBLE) AS lambda, round(sum(x * y) / (sum(x * x) + lam), 6) AS coef FROM o, (VALUES (0.5::DOUBLE), (1000.0::DOUBLE)) l(lam) GROUP BY lam",
    "ridge_looe": LOOE,
    "plot_inds": f"{PAIR}, lv AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS lk FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT id, {R('max(CASE comp WHEN 1 THEN y END)')} AS x, {R('max(CASE comp WHEN 2 THEN y END)')} AS y, max(c.c_mktsegment) AS \"group\", max(['red', 'blue', 'darkgreen', 'orange', 'violet'][lk]) AS color FROM yy JOIN customer c ON id = CAST(c_custkey AS VARCHAR) JOIN lv ON lv.c_mktsegment = c.c_mktsegment GROUP BY id",
    "plot_vars": f"{PAIR} SELECT \"table\", 'price' AS variable, {R('max(CASE comp WHEN 1 THEN r END)')} AS x, {R('max(CASE comp WHEN 2 THEN r END)')} AS y, TRUE AS highlighted, 'red' AS color FROM rr GROUP BY 1",
    "label_of_largest": f"{MATRIX} SELECT customer AS id, first('p' || k ORDER BY value DESC, k) AS label FROM (SELECT customer, coalesce(value, 0) AS value, CAST(substr(priority, 1, 1) AS INTEGER) - 1 AS k FROM pm) GROUP BY 1",
    "unit_circle": f"{PAIR}, mr AS (SELECT max(abs(r)) AS most FROM rr) SELECT step, {R('most * cos(step * 2 * pi() / 99)')} AS x, {R('most * sin(step * 2 * pi() / 99)')} AS y FROM range(100) t(step), mr",
    "id_union_sorted": f"WITH {STATUS} SELECT id, row_number() OVER (ORDER BY id) - 1 AS position FROM (SELECT id FROM f UNION SELECT id FROM o)",
    "id_union_first": "WITH p AS (SELECT CAST(o_custkey AS VARCHAR) AS id, CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END AS t, min(o_orderkey) AS place FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2), q AS (SELECT id, min(t) AS t, arg_min(place, t) AS place FROM p GROUP BY 1) SELECT id, row_number() OVER (ORDER BY t, place, id) - 1 AS position FROM q",
    "ginv_eig": f"{PAIR} SELECT comp, {R('v')} AS eigenvalue FROM ev",
    "dual_scores": f"{_pair('pa AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, avg(c_acctbal) AS x FROM customer GROUP BY 1), pb AS (SELECT CAST(s_nationkey AS VARCHAR) AS id, avg(s_acctbal) AS x FROM supplier GROUP BY 1)', (5, 7))}, sc AS (SELECT 'customers' AS \"table\", id, sign(e * w1) * a / stddev_samp(a) OVER () AS s FROM al, sg WHERE comp = 1 UNION ALL SELECT 'suppliers', id, sign(e * w2) * b / stddev_samp(b) OVER () FROM al, sg WHERE comp = 1) SELECT \"table\", id, {R('s')} AS comp1 FROM sc",
    "kernel_looe": f"WITH o AS (SELECT avg(c_acctbal) / 1000 AS x, count(*) / 10.0 AS y FROM customer GROUP BY c_nationkey), t AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy FROM o) SELECT CAST(lam AS DOUBLE) AS lambda, {R('sum(power((y - x * sxy / (sxx + lam)) / (1 - x * x / (sxx + lam)), 2))')} AS looe FROM o, t, (VALUES (0.5::DOUBLE), (50.0::DOUBLE), (1000.0::DOUBLE)) l(lam) GROUP BY lam",
    "stored_region": f"{FEATURES} SELECT feature, count(*) AS n, sum(l_quantity) AS total FROM ft JOIN lineitem ON feature = CAST(l_partkey AS VARCHAR) WHERE EXISTS (SELECT 1 FROM q WHERE q.chrom = ft.chrom AND ft.st >= q.st AND ft.en <= q.en) GROUP BY 1",
    "plot_density": f"{PAIR}, pt AS (SELECT id, max(CASE comp WHEN 1 THEN y END) AS x, max(CASE comp WHEN 2 THEN y END) AS y FROM yy GROUP BY id), re AS (SELECT max(greatest(abs(x), abs(y))) AS reach FROM pt) SELECT 'red' AS color, CAST(least(floor((x / reach + 1) / 2 * 20), 19) AS INTEGER) AS bin_x, CAST(least(floor((y / reach + 1) / 2 * 20), 19) AS INTEGER) AS bin_y, count(*) AS n, {R('avg(x)')} AS x, {R('avg(y)')} AS y FROM pt, re GROUP BY ALL",
    "save_load": f"{PAIR} SELECT \"table\", comp, {R('r')} AS r FROM rr",
}
