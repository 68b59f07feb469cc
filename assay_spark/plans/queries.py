"""Named queries over the driver tables, one per operator family of the
survey's inventory.  Each takes (spark, sf_dir) and returns a DataFrame whose
column names match the DuckDB twin in ``plans.oracle``.

Doubles are rounded to 6 decimals at the very end so that results summed in
a different order by the two engines compare equal.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay_spark import constants as C
from assay_spark.operators import features as FE
from assay_spark.operators import kernels as K
from assay_spark.operators import report as RP
from assay_spark.operators import sampling as SA
from assay_spark.plans.catalog import table, vectors
from assay_spark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIGITS = 6


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double / float column (array columns are left as they are)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ====================================================================== step 0
def knn_eval(spark: SparkSession, sf_dir: str, k: int = 5, test_pct: int = 20, seed: int = 42) -> DataFrame:
    """Stratified exact split -> standardise (fit on train) -> k-NN
    regression -> MSE / MAE / R² on the test rows."""
    v = vectors(spark, sf_dir)
    s = SA.stratified_split(v, "row_id", "stratum", test_pct=test_pct, seed=seed)
    z = FE.standardize(s, "x", fit_on=F.col("split") == "train")
    # test and train both read the standardised table: compute it once
    z = materialize(z)
    test = z.filter(F.col("split") == "test")
    train = z.filter(F.col("split") == "train")
    pred = K.knn_regression(test, train, k=k, id_col="row_id")
    return rounded(RP.regression_metrics(pred))


@query("flagship_knn_eval")
def flagship_knn_eval(spark, sf_dir):
    return knn_eval(spark, sf_dir)


# ====================================================================== step 1: profile, filters
from assay_spark.operators import profile as PR  # noqa: E402
from assay_spark.operators import select as SE  # noqa: E402

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("profile_describe")
def profile_describe(spark, sf_dir):
    return rounded(PR.profile(table(spark, sf_dir, "lineitem"), LINE_NUM))


def labelled_docs(spark, sf_dir) -> DataFrame:
    """Documents with their labels attached (J1); unlabelled ones get nulls."""
    from assay_spark.operators.joins import attach_target

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return attach_target(d, table(spark, sf_dir, "labels"), ["doc_id"])


@query("null_report")
def null_report(spark, sf_dir):
    return PR.null_report(labelled_docs(spark, sf_dir))


@query("attach_target")
def attach_target_q(spark, sf_dir):
    return labelled_docs(spark, sf_dir).select("doc_id", "lang", "quality", "toxic")


@query("skew_kurt_adj")
def skew_kurt_adj(spark, sf_dir):
    return rounded(PR.moments(table(spark, sf_dir, "events"), "value", by=["event_type"]))


@query("quantile_topcode")
def quantile_topcode(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return rounded(SE.topcode(ev, "value", 0.9995, 0.0, by=["event_type"], out="value_capped"))


@query("quantiles")
def quantiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    q = PR.exact_quantiles(ev, "value", [0.0, 0.1, 0.25, 0.5, 0.9, 0.9995, 1.0], by=["event_type"])
    return rounded(q)


@query("zscore_flag")
def zscore_flag(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    flagged = SE.zscore_flag(ev, "value", 3.5, by=["event_type"])
    return rounded(SE.outlier_report(flagged, by=["event_type"]))


@query("cap_filter")
def cap_filter(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return SE.cap_filter(ev, "value", 100.0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("histogram_bins")
def histogram_bins(spark, sf_dir):
    return rounded(PR.histogram(table(spark, sf_dir, "events"), "value", 25, by=["event_type"]))


@query("box_stats")
def box_stats(spark, sf_dir):
    return rounded(PR.box_stats(table(spark, sf_dir, "events"), "value", by=["event_type"]))


@query("corr_matrix")
def corr_matrix(spark, sf_dir):
    return rounded(PR.corr_matrix(table(spark, sf_dir, "lineitem"), LINE_NUM))


@query("corr_matrix_vec")
def corr_matrix_vec(spark, sf_dir):
    return rounded(PR.corr_matrix_vec(vectors(spark, sf_dir), "x"))


SEGMENT_LABELS = {"AUTOMOBILE": "Auto", "BUILDING": "Building", "FURNITURE": "Furniture", "MACHINERY": "Machinery"}


@query("label_map")
def label_map(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return SE.map_labels(c, "c_mktsegment", SEGMENT_LABELS, out="label")


@query("align_columns")
def align_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rounded(SE.align_columns(li, ["l_orderkey", "l_linenumber", "l_quantity", "l_missing", "l_tax"], fill=0.0))


def shots_like(spark, sf_dir) -> DataFrame:
    """Stand-in shot series: a string size label with one non-numeric level."""
    p = table(spark, sf_dir, "part")
    lab = F.when(F.col("p_size") >= 50, F.lit("Infinite")).otherwise(F.col("p_size").cast("string"))
    return p.select(lab.alias("numsamp"), (F.col("p_retailprice") / 1000.0).alias("mse"))


@query("log_axis")
def log_axis(spark, sf_dir):
    s = shots_like(spark, sf_dir).groupBy("numsamp").agg(F.avg("mse").alias("mean"))
    return rounded(SE.log_axis(s, "numsamp", out="x"))


@query("any_nan")
def any_nan(spark, sf_dir):
    return SE.any_nan(vectors(spark, sf_dir), "x", by=["stratum"])


@query("shape_report")
def shape_report(spark, sf_dir):
    return PR.shape_report(vectors(spark, sf_dir), by=["stratum"], vec="x")


@query("numeric_only")
def numeric_only(spark, sf_dir):
    return rounded(SE.numeric_only(table(spark, sf_dir, "customer")))


@query("drop_all_null_rows")
def drop_all_null_rows(spark, sf_dir):
    d = labelled_docs(spark, sf_dir).select("doc_id", "quality", "toxic")
    return SE.drop_all_null_rows(d, subset=["quality", "toxic"])


# ====================================================================== step 2: sampling
@query("sample_n")
def sample_n(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return SA.sample_n(o, "o_orderkey", 1800, seed=42)


@query("split_exact")
def split_exact(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return SA.split_exact(o, "o_orderkey", 20, seed=42)


@query("stratified_split")
def stratified_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return SA.stratified_split(o, "o_orderkey", "o_orderpriority", 20, seed=42)


@query("stratified_sample")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SA.stratified_sample(d, "doc_id", "lang", 100, seed=42)


@query("stratified_sample_replace")
def stratified_sample_replace(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return SA.stratified_sample(d, "doc_id", "lang", 100, seed=42, replace=True)


GRID_SIZES, GRID_REPEATS = C.SUBSAMPLE_SIZES, C.SUBSAMPLE_REPEATS


@query("subsamples_grid")
def subsamples_grid(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", "stratum")
    return SA.subsamples(v, "row_id", "stratum", GRID_SIZES, GRID_REPEATS, seed=42, replace=False)


@query("exclude_drawn")
def exclude_drawn(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    drawn = SA.sample_n(o, "o_orderkey", 1800, seed=42)
    return SA.exclude_drawn(o, drawn, "o_orderkey")


@query("overlap_report")
def overlap_report(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", "stratum")
    cells = SA.subsamples(v, "row_id", "stratum", C.SUBSAMPLE_SIZES, C.SUBSAMPLE_REPEATS, seed=42, replace=True)
    return SA.overlap(cells, "row_id", ["rec", "sub"])


@query("dedupe_first")
def dedupe_first(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return rounded(SA.dedupe_first(ev, ["user_id", "event_type"], "event_id"))


# ====================================================================== step 3: features
from assay_spark.functions import arrays as AR  # noqa: E402
from assay_spark.operators import reshape as RS  # noqa: E402
from assay_spark.plans.catalog import ranked_vectors  # noqa: E402


#: Dimensions kept by the ranking (the workflow's number of selected features).
RANKED_DIMS = 18


def _long(df: DataFrame, keys, vec: str) -> DataFrame:
    return df.select(*keys, AR.entries(vec, "i", "value"))


def split_vectors(spark, sf_dir) -> DataFrame:
    return SA.stratified_split(vectors(spark, sf_dir), "row_id", "stratum", 20, seed=42)


@query("standardize")
def standardize(spark, sf_dir):
    z = FE.standardize(vectors(spark, sf_dir), "x")
    return rounded(_long(z, ["row_id"], "x"))


@query("standardize_cols")
def standardize_cols(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", *LINE_NUM)
    z = FE.standardize_cols(li, LINE_NUM, by=["l_returnflag"])
    return rounded(z.select("l_orderkey", "l_linenumber", "l_returnflag", *[c + "_z" for c in LINE_NUM]))


@query("impute_mean")
def impute_mean(spark, sf_dir):
    d = labelled_docs(spark, sf_dir).select("doc_id", "lang", F.col("quality").cast("double").alias("quality"))
    return rounded(FE.impute_mean(d, ["quality"], by=["lang"]))


@query("scale_to_bound")
def scale_to_bound(spark, sf_dir):
    s = FE.scale_to(split_vectors(spark, sf_dir), "x", 6.0, fit_on=F.col("split") == "train")
    return rounded(_long(s, ["row_id", "split"], "x"))


@query("max_abs")
def max_abs(spark, sf_dir):
    return rounded(FE.max_abs(vectors(spark, sf_dir), "x", by=["stratum"]))


@query("correlators_pairs")
def correlators_pairs(spark, sf_dir):
    c = FE.correlators(ranked_vectors(spark, sf_dir, RANKED_DIMS), "x", order=2, out="corr")
    return rounded(_long(c, ["row_id"], "corr"))


@query("pairs_long")
def pairs_long(spark, sf_dir):
    return rounded(FE.pairs_long(ranked_vectors(spark, sf_dir, RANKED_DIMS), "row_id", "x"))


@query("expand_modes")
def expand_modes(spark, sf_dir):
    v = ranked_vectors(spark, sf_dir, RANKED_DIMS)
    parts = [_long(FE.expand(v, "x", m, components=3), ["row_id"], "readout").withColumn("mode", F.lit(m))
             for m in FE.READOUT_MODES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


RESPONSE_SITES = 18
RESPONSE_STEPS = FE.response_steps(0.0, C.QUANTUM_T_END, C.QUANTUM_STEP)


@query("response_features")
def response_features(spark, sf_dir):
    """Full 1710-long response embedding of 18 inputs (10 steps x 171),
    summarised per (row, step), with a sum weighted by position, so the
    comparison reads every value in its place."""
    e = FE.response_features(ranked_vectors(spark, sf_dir, RESPONSE_SITES), "x", order=2)
    per = RESPONSE_SITES + RESPONSE_SITES * (RESPONSE_SITES - 1) // 2
    lng = _long(e, ["row_id"], "embedding").withColumn("step", (F.col("i") / per).cast("int") + 1)
    return rounded(lng.groupBy("row_id", "step").agg(
        F.count("value").alias("n"), F.sum("value").alias("sum"), F.sum(F.col("value") ** 2).alias("sumsq"),
        F.sum(F.col("value") * (F.col("i") % per + 1)).alias("wsum"), F.min("value").alias("min"), F.max("value").alias("max")))


@query("shot_noise")
def shot_noise(spark, sf_dir):
    v = ranked_vectors(spark, sf_dir, RANKED_DIMS)
    n = FE.add_shot_noise(v, "row_id", "x", C.SHOT_COUNTS_DRAWN, loops=C.SHOT_LOOPS, seed=42)
    return rounded(_long(n, ["row_id", "shots", "loop"], "noisy"))


@query("transpose")
def transpose(spark, sf_dir):
    """Coordinate form of the transposed feature x sample matrix."""
    t = RS.to_entries(vectors(spark, sf_dir), "row_id", "x", "row", "value")
    return rounded(t.select(F.col("row").alias("row_id"), F.col("row_id").alias("col_id"), "value"))


@query("pca")
def pca(spark, sf_dir):
    s = split_vectors(spark, sf_dir)
    p = FE.pca(s, "x", 4, fit_on=F.col("split") == "train")
    return rounded(p.select("row_id", "split", *[F.col("pca")[i].alias(f"pc{i + 1}") for i in range(4)]))


@query("pca_variance")
def pca_variance(spark, sf_dir):
    return rounded(FE.pca_variance(vectors(spark, sf_dir), "x", 8))


def _tanh(x):
    import numpy as np
    return np.tanh(x)


@query("embed_map")
def embed_map(spark, sf_dir):
    e = FE.embed(vectors(spark, sf_dir).select("row_id", "x"), "x", _tanh, 64)
    return rounded(e.select("row_id", AR.vsum("embedding").alias("sum"), F.size("embedding").alias("n")))


# ====================================================================== step 4: distances and clusters
RBF_LENGTH = 2.0


@query("rbf_kernel")
def rbf_kernel(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", "x")
    centres = SA.sample_n(v, "row_id", 16, seed=7).select(F.col("row_id").alias("centre_id"), "x")
    return rounded(K.rbf_kernel(v, centres, RBF_LENGTH, "row_id", "x"))


def _plain_split(spark, sf_dir):
    return SA.split_exact(vectors(spark, sf_dir), "row_id", 20, seed=42)


@query("knn_regression")
def knn_regression(spark, sf_dir):
    s = _plain_split(spark, sf_dir)
    p = K.knn_regression(s.filter("split = 'test'"), s.filter("split = 'train'"), k=5)
    return rounded(p)


@query("knn_join")
def knn_join(spark, sf_dir):
    s = _plain_split(spark, sf_dir)
    return rounded(K.knn_join(s.filter("split = 'test'"), s.filter("split = 'train'"), k=5, y=None))


@query("knn_join_pruned")
def knn_join_pruned(spark, sf_dir):
    """For every partly shipped order the five finished or open ones nearest
    by price and date: thousands of train rows, most of them out of reach."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_orderstatus",
        F.array(F.col("o_totalprice") / 1000.0,
                F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")) / 10.0).alias("x"))
    nn = K.knn_join(o.filter("o_orderstatus = 'P'"), o.filter("o_orderstatus <> 'P'"), k=5, y=None,
                    pivots=K.MAX_PIVOTS)
    return rounded(nn)


def class_centroids(spark, sf_dir) -> DataFrame:
    st = FE.vector_stats(vectors(spark, sf_dir), "x", by=["stratum"])
    return st.select(F.col("stratum").alias("cluster"), F.col("_mu").alias("centroid"))


@query("assign_centroids")
def assign_centroids(spark, sf_dir):
    a = K.assign(vectors(spark, sf_dir).select("row_id", "x"), class_centroids(spark, sf_dir), "x")
    return rounded(a.select("row_id", "cluster", "dist2"))


@query("kmeans")
def kmeans(spark, sf_dir):
    from assay_spark.operators.cluster import cluster
    return cluster(vectors(spark, sf_dir), "x", k=5, seed=42).select("row_id", "cluster")


@query("elbow")
def elbow(spark, sf_dir):
    from assay_spark.operators.cluster import elbow as _elbow
    return rounded(_elbow(vectors(spark, sf_dir), "x", range(1, 10), seed=42))


# ====================================================================== step 5: scores
def part_predictions(spark, sf_dir) -> DataFrame:
    """Stand-in predictions: each part's price predicted by the mean price of
    its size class (predictions table schema: keys, y, y_hat)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.col("p_retailprice").alias("y"))
    m = p.groupBy("p_size").agg(F.avg("y").alias("y_hat"))
    return p.join(m, "p_size")


@query("regression_metrics")
def regression_metrics(spark, sf_dir):
    return rounded(RP.regression_metrics(part_predictions(spark, sf_dir), by=["p_brand"], extended=True))


@query("fit_line")
def fit_line(spark, sf_dir):
    return rounded(RP.fit_line(part_predictions(spark, sf_dir), by=["p_brand"]))


@query("rollup_scores")
def rollup_scores(spark, sf_dir):
    return rounded(RP.rollup(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal"))


def lineitem_scores(spark, sf_dir) -> DataFrame:
    """Stand-in long score table (metric, model, score)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("model"),
                     F.col("l_discount").alias("score"))


@query("rollup_metric_model")
def rollup_metric_model(spark, sf_dir):
    return rounded(RP.rollup(lineitem_scores(spark, sf_dir), ["metric", "model"], "score"))


@query("summary_join")
def summary_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    means = c.groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("value"))
    stds = c.groupBy("c_mktsegment").agg(F.stddev_samp("c_acctbal").alias("value"))
    return rounded(RP.summary_join(means, stds, ["c_mktsegment"]))


def mean_std_keys(spark, sf_dir) -> DataFrame:
    """Stand-in summary rows keyed '{n}mse' / '{n}std' per model."""
    r = RP.rollup(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_acctbal")
    k = F.col("c_nationkey").cast("string")
    return (r.select(F.concat(k, F.lit("mse")).alias("key"), F.col("c_mktsegment").alias("model"),
                     F.col("mean").alias("value"))
            .unionByName(r.select(F.concat(k, F.lit("std")).alias("key"), F.col("c_mktsegment").alias("model"),
                                  F.col("std").alias("value"))))


@query("pair_mean_std")
def pair_mean_std(spark, sf_dir):
    return rounded(RP.pair_mean_std(mean_std_keys(spark, sf_dir)))


BAR_ORDER = ["FURNITURE", "AUTOMOBILE", "MACHINERY", "BUILDING"]


@query("bar_table")
def bar_table(spark, sf_dir):
    pairs = RP.pair_mean_std(mean_std_keys(spark, sf_dir))
    factors = spark.createDataFrame([("MACHINERY", 2.0)], "model string, factor double")
    return rounded(RP.bar_table(pairs, SEGMENT_LABELS, BAR_ORDER, factors))


def part_results(spark, sf_dir) -> DataFrame:
    """Stand-in RESULTS table: cell = size class, algorithm = brand,
    mse = mean price (thousands)."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_size").alias("cell"), F.col("p_brand").alias("algorithm")).agg(
        (F.avg("p_retailprice") / 1000.0).alias("mse"))


@query("leaderboard")
def leaderboard(spark, sf_dir):
    return rounded(RP.leaderboard(part_results(spark, sf_dir), 10, "mse", ["algorithm", "cell"]))


@query("leaderboard_per_cell")
def leaderboard_per_cell(spark, sf_dir):
    return rounded(RP.leaderboard(part_results(spark, sf_dir), 3, "mse", ["algorithm"], by=["cell"]))


@query("best_model")
def best_model(spark, sf_dir):
    return rounded(RP.best_model(part_results(spark, sf_dir), ["cell"]))


@query("shot_curve")
def shot_curve(spark, sf_dir):
    return rounded(RP.shot_curve(shots_like(spark, sf_dir), "numsamp", "mse"))


@query("scores_long")
def scores_long(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nested = p.select("p_partkey", F.create_map(
        F.lit("mse"), F.create_map(F.col("p_brand"), F.array(F.col("p_retailprice"), F.col("p_size").cast("double"))),
        F.lit("mae"), F.create_map(F.col("p_type"), F.array(F.col("p_retailprice") / 2.0))).alias("scores"))
    return rounded(RS.scores_long(nested, "scores", keep=["p_partkey"]))


@query("union_results")
def union_results(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.groupBy(F.col("p_brand").alias("algorithm")).agg(F.avg("p_retailprice").alias("mse")) \
        .withColumn("source", F.lit("brand"))
    b = p.groupBy(F.col("p_type").alias("algorithm")).agg(F.avg("p_retailprice").alias("mse"),
                                                          F.max("p_size").alias("numsamp"))
    return rounded(a.unionByName(b, allowMissingColumns=True))


@query("results_frame")
def results_frame(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.array(F.lit("size"), F.lit("price")).alias("Algorithm"),
        F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("MSE"))
    return rounded(RS.results_frame(p, ["Algorithm", "MSE"], keep=["p_partkey"]))


@query("to_long")
def to_long(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("nation"),
                                                 F.col("c_acctbal").alias("acctbal"))
    return rounded(RS.to_long(c, ["c_custkey"], ["nation", "acctbal"]))


@query("to_wide")
def to_wide(spark, sf_dir):
    lng = lineitem_scores(spark, sf_dir).groupBy("metric", "model").agg(F.avg("score").alias("score"))
    return rounded(RS.to_wide(lng, ["metric"], "model", "score", ["F", "O"]))


@query("distinct_labels")
def distinct_labels(spark, sf_dir):
    return RP.distinct_labels(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


# ====================================================================== step 6: models
from assay_spark.operators import importance as IM  # noqa: E402
from assay_spark.operators import models as MO  # noqa: E402


@query("ols_single")
def ols_single(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.array(F.col("p_size").cast("double")).alias("x"),
                                            F.col("p_retailprice").alias("y"))
    co = MO.fit_grouped(p, ["p_brand"], "x", "y")
    return rounded(co.select("p_brand", "intercept", F.col("coef")[0].alias("slope"), "n"))


@query("fit_grouped")
def fit_grouped(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.array("l_quantity", "l_discount", "l_tax").alias("x"), F.col("l_extendedprice").alias("y"))
    co = MO.fit_grouped(li, ["l_returnflag"], "x", "y")
    return rounded(co.select("l_returnflag", "intercept", AR.entries("coef", "j", "coef")))


def _model_report(spark, sf_dir, name, **kw):
    s = split_vectors(spark, sf_dir)
    rep = MO.fit_report(s.filter("split = 'train'"), s.filter("split = 'test'"), name, seed=42, **kw)
    return rounded(rep)


@query("forest")
def forest(spark, sf_dir):
    return _model_report(spark, sf_dir, "forest")


@query("gbt")
def gbt(spark, sf_dir):
    return _model_report(spark, sf_dir, "gbt")


@query("bagging")
def bagging(spark, sf_dir):
    return _model_report(spark, sf_dir, "bagging")


@query("tree")
def tree(spark, sf_dir):
    return _model_report(spark, sf_dir, "tree")


@query("ols_ml")
def ols_ml(spark, sf_dir):
    return _model_report(spark, sf_dir, "ols")


@query("rbf_ridge")
def rbf_ridge(spark, sf_dir):
    return rounded(MO.evaluate(split_vectors(spark, sf_dir), [], ["rbf_ridge"], rff_length=RBF_LENGTH))


@query("rank_linear")
def rank_linear(spark, sf_dir):
    s = split_vectors(spark, sf_dir).filter("split = 'train'")
    return rounded(IM.rank_features(s, "linear", 10))


@query("rank_tree")
def rank_tree(spark, sf_dir):
    s = split_vectors(spark, sf_dir).filter("split = 'train'")
    return rounded(IM.rank_features(s, "tree", 10, numTrees=C.FOREST_TREES))


@query("rank_permutation")
def rank_permutation(spark, sf_dir):
    s = split_vectors(spark, sf_dir).filter("split = 'train'")
    return rounded(IM.rank_features(s, "permutation", 10, dim=64, model="ols"))


@query("rank_permutation_pair")
def rank_permutation_pair(spark, sf_dir):
    """Permutation importance of a linear model of two regressors over all parts."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("y"),
        F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double")).alias("x"))
    imp = IM.rank_features(p, "permutation", 2, dim=2, model="ols")
    return imp.withColumn("importance", F.round("importance", 3))


def grid_cells(spark, sf_dir) -> DataFrame:
    """Every (rec, sub) subsample with its stratified split, features
    standardised per cell on that cell's train rows."""
    v = vectors(spark, sf_dir)
    cells = SA.subsamples(v.select("row_id", "stratum"), "row_id", "stratum", GRID_SIZES, GRID_REPEATS, seed=42,
                          replace=False)
    cells = cells.join(v.select("row_id", "x", "y"), "row_id")
    return FE.standardize(cells, "x", by=["rec", "sub"], fit_on=F.col("split") == "train")


@query("evaluate_grid")
def evaluate_grid(spark, sf_dir):
    res = MO.evaluate(grid_cells(spark, sf_dir), ["rec", "sub"], ["ols", "ridge", "knn", "mean"])
    return rounded(res)


@query("rollup_grid")
def rollup_grid(spark, sf_dir):
    res = MO.evaluate(grid_cells(spark, sf_dir), ["rec", "sub"], ["ridge", "knn", "mean"])
    return rounded(RP.rollup(res, ["rec", "algorithm"], "mse"))


# ====================================================================== inventory completions
@query("drop_null_columns")
def drop_null_columns(spark, sf_dir):
    return SE.drop_null_columns(labelled_docs(spark, sf_dir))


@query("where_all")
def where_all(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return rounded(SE.where_all(p, p_type="LARGE", p_size=10))


@query("tag")
def tag(spark, sf_dir):
    return rounded(SE.tag(part_results(spark, sf_dir), act=4, rec=100, source="raw"))


@query("ordered_categories")
def ordered_categories(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return SE.ordered_categories(c, "c_mktsegment", BAR_ORDER, pos="pos")


@query("cast_float")
def cast_float(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    c = SE.cast_cols(li, ["l_extendedprice"], "float")
    return rounded(SE.cast_cols(c, ["l_extendedprice"], "double"))


@query("attach_label")
def attach_label(spark, sf_dir):
    from assay_spark.operators.cluster import cluster
    from assay_spark.operators.joins import attach_label as _attach_label

    v = vectors(spark, sf_dir)
    labels = cluster(v, "x", k=5, seed=42).select("row_id", "cluster")
    return _attach_label(v.select("row_id", "stratum"), labels, ["row_id"])


@query("zip_arrays")
def zip_arrays(spark, sf_dir):
    from assay_spark.operators.joins import zip_arrays as _zip

    v = vectors(spark, sf_dir).select("row_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    z = _zip(v, "a", "b", out="pairs")
    return rounded(z.select("row_id", AR.entries("pairs", "pos", "p")).select(
        "row_id", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b")))


@query("join_predictions")
def join_predictions(spark, sf_dir):
    pr = part_predictions(spark, sf_dir)
    truth = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("y"))
    return rounded(RP.join_predictions(pr.select("p_partkey", "y_hat"), truth, ["p_partkey"]))


@query("mean_abs")
def mean_abs(spark, sf_dir):
    z = FE.standardize_cols(table(spark, sf_dir, "lineitem"), LINE_NUM)
    lng = RS.to_long(z, [], [c + "_z" for c in LINE_NUM])
    return rounded(PR.mean_abs(lng, "col_name", "value"))


@query("top_features")
def top_features(spark, sf_dir):
    from assay_spark.operators.importance import top_features as _top

    p = table(spark, sf_dir, "part")
    imp = p.groupBy("p_type", F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(_top(imp, 3, by=["p_type"]))


@query("head_rows")
def head_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return SA.head_rows(o, "o_orderkey", 100)


@query("except_rows")
def except_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    drawn = SA.sample_n(o, "o_orderkey", 1800, seed=42).drop("draw_rank")
    return o.exceptAll(drawn)


@query("concat_vectors")
def concat_vectors(spark, sf_dir):
    v = vectors(spark, sf_dir).select("row_id", F.slice("x", 1, 32).alias("a"), F.slice("x", 33, 32).alias("b"))
    return rounded(_long(RS.concat_vectors(v, ["a", "b"], out="x"), ["row_id"], "x"))


@query("one_body")
def one_body(spark, sf_dir):
    """One-body readout: singles only, 18 x 10 = 180 values per row, summarised
    with a sum weighted by position."""
    e = FE.response_features(ranked_vectors(spark, sf_dir, RESPONSE_SITES), "x", order=1)
    lng = _long(e, ["row_id"], "embedding").withColumn("step", (F.col("i") / RESPONSE_SITES).cast("int") + 1)
    return rounded(lng.groupBy("row_id", "step").agg(
        F.count("value").alias("n"), F.sum("value").alias("sum"), F.sum(F.col("value") * (F.col("i") % RESPONSE_SITES + 1)).alias("wsum"),
        F.min("value").alias("min"), F.max("value").alias("max")))


@query("evaluate_timed")
def evaluate_timed(spark, sf_dir):
    res = MO.evaluate_timed(split_vectors(spark, sf_dir), [], ["ols", "knn", "mean"])
    return rounded(res)


SWEEP_SHOTS = (0, *C.SHOT_COUNTS)
SWEEP_ROWS = 4096  # table rows that one task makes cells of


def _sweep(spark, sf_dir, shots, algorithms, method) -> DataFrame:
    v = FE.scale_to(split_vectors(spark, sf_dir), "x", 1.0, fit_on=F.col("split") == "train")
    # a row makes cells x draws of work: the rows are spread by count, not by their bytes
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors(spark, sf_dir).count() // SWEEP_ROWS))
    v = v.repartition(parts)
    noisy = FE.add_shot_noise(v, "row_id", "x", shots, loops=C.SHOT_LOOPS, seed=42, out="xn", method=method)
    cells = noisy.select("shots", "loop", "row_id", "split", F.col("xn").alias("x"), "y")
    res = MO.evaluate(cells, ["shots", "loop"], algorithms, packed=True)
    return rounded(RP.shot_curve(res.withColumnRenamed("shots", "numsamp"), "numsamp", "mse", by=["algorithm"]))


@query("shot_sweep")
def shot_sweep(spark, sf_dir):
    """Shot-noise experiment end to end: expectations in [-1, 1] (vectors
    scaled to bound 1), finite-shot estimates for every (shots, loop) cell
    (the workflow's ten shot counts, binomial draws), one split and grouped
    ridge / kNN / mean evaluation per cell, then MSE mean and spread per
    shot count on a log axis."""
    return _sweep(spark, sf_dir, SWEEP_SHOTS, ["ridge", "knn", "mean"], "binomial")


@query("shot_sweep_exact")
def shot_sweep_exact(spark, sf_dir):
    """The shot sweep on the md5-draw path (up to 50 shots) with the
    SQL-checkable models (kNN, train mean)."""
    return _sweep(spark, sf_dir, C.SHOT_COUNTS_DRAWN, ["knn", "mean"], "counted")


COMPARE_SITES = 8


def _compare(spark, sf_dir, algorithms) -> DataFrame:
    v = ranked_vectors(spark, sf_dir, COMPARE_SITES)
    cells = SA.subsamples(v.select("row_id", "stratum"), "row_id", "stratum", GRID_SIZES, GRID_REPEATS, seed=42,
                          replace=False)
    cells = cells.join(v.select("row_id", "x", "y"), "row_id")
    cells = FE.scale_to(cells, "x", C.SCALE_BOUND, by=["rec", "sub"], fit_on=F.col("split") == "train")
    cells = materialize(cells)  # three sources read it
    sources = {
        "raw": cells,
        "embedding": FE.response_features(cells, "x", order=2, out="x"),
        "one_body": FE.response_features(cells, "x", order=1, out="x"),
    }
    res = None
    for name, c in sources.items():
        r = MO.evaluate(c, ["rec", "sub"], algorithms, source=name)
        res = r if res is None else res.unionByName(r)
    return rounded(RP.rollup(res, ["rec", "source", "algorithm"], "mse"))


@query("compare_sources")
def compare_sources(spark, sf_dir):
    """The reference's headline comparison on every subsample cell, over the
    eight highest-ranked features max-abs scaled to +/-6 on each cell's train rows: raw
    features vs the full response embedding (singles + pairs per step) vs
    the one-body embedding, each scored by grouped ridge / kNN / mean, rolled
    up to MSE mean and spread per (size, source, algorithm)."""
    return _compare(spark, sf_dir, ["ridge", "knn", "mean"])


@query("compare_sources_knn")
def compare_sources_knn(spark, sf_dir):
    """The same comparison with the SQL-checkable models (kNN, train mean)."""
    return _compare(spark, sf_dir, ["knn", "mean"])


@query("evaluate_forest_grid")
def evaluate_forest_grid(spark, sf_dir):
    """Forest of every subsample cell (all cells in one job) next to the
    grouped models, as the reference's evaluation scripts run it."""
    res = MO.evaluate(grid_cells(spark, sf_dir), ["rec", "sub"], ["forest", "ridge"])
    return rounded(res)


@query("evaluate_grid_knn")
def evaluate_grid_knn(spark, sf_dir):
    """The grid path with the SQL-checkable models: every (rec, sub) cell
    drawn and split, standardised on its train rows, scored by kNN and by the
    train mean, metrics per cell."""
    return rounded(MO.evaluate(grid_cells(spark, sf_dir), ["rec", "sub"], ["knn", "mean"]))


@query("subsamples_disjoint")
def subsamples_disjoint(spark, sf_dir):
    """Disjoint repeated draws (no row in two subsamples of one size)."""
    v = vectors(spark, sf_dir).select("row_id", "stratum")
    return SA.subsamples(v, "row_id", "stratum", GRID_SIZES, GRID_REPEATS, seed=42, disjoint=True)


@query("rank_linear_single")
def rank_linear_single(spark, sf_dir):
    """Exact linear attribution with one regressor per brand: grouped least
    squares, mean |beta (x - mean x)| per feature, top feature per brand."""
    p = table(spark, sf_dir, "part").select("p_brand", F.array(F.col("p_size").cast("double")).alias("x"),
                                            F.col("p_retailprice").alias("y"))
    co = MO.fit_grouped(p, ["p_brand"], "x", "y")
    imp = IM.linear_attribution(p, co, ["p_brand"], "x")
    return rounded(IM.top_features(imp, 1, by=["p_brand"]))


# ====================================================================== sources and sinks
from assay_spark.sources import files as SRC  # noqa: E402


def _folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    import uuid

    from assay_spark.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/sources/{name}-{uuid.uuid4().hex}"


def _part_cells(spark, sf_dir) -> DataFrame:
    """The part table as a family of split files: keys from its columns."""
    p = table(spark, sf_dir, "part")
    keys = {"split": F.when(F.col("p_size") <= 40, "train").otherwise("test"), "rec": F.lit(200), "sub": F.col("p_size") % 4,
            "act": F.length("p_type") % 3, "version": F.lit(1)}
    return p.select("p_partkey", "p_size", "p_retailprice", *[v.cast("string" if k == "split" else "int").alias(k) for k, v in keys.items()])


_PART_SCHEMA = "p_partkey long, p_size int, p_retailprice double"


@query("read_wide")
def read_wide(spark, sf_dir):
    """lineitem's numeric columns written as headered CSV and scanned with a declared schema."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUM)
    path = _folder(spark, "wide")
    li.write.option("header", True).csv(path)
    return rounded(SRC.read_wide(spark, path, li.schema))


def _cell_files(spark, sf_dir) -> str:
    path, d = _folder(spark, "cells"), _part_cells(spark, sf_dir)
    name = SRC.cell_name("X", *[F.col(c) for c in ("split", "rec", "sub", "act", "version")])
    SRC.write_cell_files(d.select("p_partkey", "p_size", "p_retailprice", name.alias("cell")), path)
    return path + "/*"


@query("read_cells")
def read_cells(spark, sf_dir):
    """A family of cell files written in one job and read in one scan, keys from the names."""
    return rounded(SRC.read_cells(spark, _cell_files(spark, sf_dir), _PART_SCHEMA))


@query("read_cells_columns")
def read_cells_columns(spark, sf_dir):
    """S3: the same scan of one column."""
    return SRC.read_cells(spark, _cell_files(spark, sf_dir), _PART_SCHEMA, columns=["p_partkey"])


@query("write_cells")
def write_cells(spark, sf_dir):
    """Keyed tables partitioned by their cell keys, and one cell family read back by pruning."""
    path = _folder(spark, "keyed")
    SRC.write_cells(_part_cells(spark, sf_dir), path, keys=("act", "rec", "sub", "version"))
    back = spark.read.parquet(path).where("act = 1")
    return rounded(back.select("p_partkey", "p_size", "p_retailprice", "split", *[F.col(c).cast("int").alias(c) for c in ("rec", "sub", "act", "version")]))


@query("write_vectors")
def write_vectors(spark, sf_dir):
    """Vectors written and read back, as entries."""
    path = _folder(spark, "vectors")
    SRC.write_vectors(vectors(spark, sf_dir).select("row_id", "x", "stratum"), path, keys=("stratum",))
    return rounded(_long(spark.read.parquet(path), ["row_id"], "x"))


@query("matrix_roundtrip")
def matrix_roundtrip(spark, sf_dir):
    """Readout-major matrix text written (transposed) and read back, as entries by sample position."""
    path = _folder(spark, "matrix")
    SRC.write_matrix(vectors(spark, sf_dir), path, "row_id", "x")
    return rounded(_long(SRC.read_matrix(spark, path), ["sample"], "x"))


@query("matrix_nulls")
def matrix_nulls(spark, sf_dir):
    """A matrix with nulls (entries below 0), written in tiles of 128 samples and read back."""
    path = _folder(spark, "matrix-nulls")
    v = vectors(spark, sf_dir).withColumn("x", F.transform("x", lambda e: F.when(e >= 0, e)))
    SRC.write_matrix(v, path, "row_id", "x", tile=128)
    return rounded(_long(SRC.read_matrix(spark, path), ["sample"], "x"))


#: Scores of the S7 example: metric -> model (a region's name) -> list.
SCORES = {"mse": {"AFRICA": [0.5, 0.25], "ASIA": [1.5], "EUROPE": []}, "r2": {"ASIA": [0.75, 0.125], "EUROPE": [0.0625]}}


@query("from_scores")
def from_scores(spark, sf_dir):
    """A nested literal table as rows, joined to the customers' region."""
    s = RS.scores_long(SRC.from_scores(spark, SCORES, "literal"), "scores", ["source"])
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey").join(n, "n_nationkey")
    return rounded(c.select("c_custkey", F.col("r_name").alias("model")).join(s, "model").select("c_custkey", "model", "metric", "run", "score"))
