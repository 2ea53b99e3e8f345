"""Quantile-forecast baselines: climatology, trailing errors, forests, calibration, selection.

Exact percentiles here are taken per zone (and hour) over rows of daily grain, so a group is bounded by the calendar.
Forest leaves have no such bound and use mergeable counts per error bin instead.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.constants import QUANTILES
from gridspark.functions.stats import covered, quantile_loss, sorted_quantiles
from gridspark.operators.blocks import time_blocks
from gridspark.operators.reshape import stack_all
from gridspark.operators.selection import exact_quantiles
from gridspark.plans.features import KEY, day_number
from gridspark.session import cut_lineage

Q = list(QUANTILES)
TAUS = list(QUANTILES.values())
TREES, DEPTH = 300, 6
BINS_PER_E = 25
FIT_MEMORY_MB, FITS_AT_ONCE = 1024, 3


def _spread(quantiles: Column, names: list[str] = Q) -> list[Column]:
    return [F.get(quantiles, F.lit(i)).alias(n) for i, n in enumerate(names)]


def climatology(train: DataFrame, keys: list[str] | None = None, value: str = "error") -> DataFrame:
    keys = keys or ["zone", "hour_ending"]
    out = train.groupBy(*keys).agg(F.percentile(value, F.lit(TAUS)).alias("_q"))
    return out.select(*keys, *_spread(F.col("_q")))


def trailing_quantiles(df: DataFrame, window_days: int = 90, min_obs: int = 20, lag_days: int = 2,
                       keep: list[str] | None = None) -> DataFrame:
    """Quantiles of the last `window_days` of errors, as of the latest observed day at least `lag_days` back.
    Columns in `keep` are carried along."""
    w = Window.partitionBy("zone", "hour_ending").orderBy(day_number())
    window = w.rangeBetween(-(window_days - 1), 0)
    stat = F.when(F.count("error").over(window) >= min_obs, F.percentile("error", F.lit(TAUS)).over(window))
    extra = keep or []
    rows = df.select(*KEY, *dict.fromkeys(["error", *extra]), stat.alias("_stat"))
    known = F.last(F.struct("_stat")).over(w.rangeBetween(Window.unboundedPreceding, -lag_days))
    return rows.select(*KEY, *extra, known["_stat"].alias("_q")).select(*KEY, *extra, *_spread(F.col("_q")))


def medians(df: DataFrame, columns: list[str]) -> Column:
    """A struct of the columns' exact medians, found when the query runs; see `exact_quantiles` for groups beyond a task's memory."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e"))
    found = exact_quantiles(long.select("e.name", "e.v"), "v", [0.5], ["name"])
    wide = found.agg(*[F.max(F.when(F.col("name") == c, F.get("quantiles", F.lit(0)))).alias(c) for c in columns])
    return wide.select(F.struct(*columns)).scalar()


def scale_heuristic(train: DataFrame, target: DataFrame, scale_columns: list[str], floor: float = 0.2) -> DataFrame:
    """Zone quantiles of the error in units of a day-specific scale, times the target day's scale.

    The overall medians are selected by rank over value ranges, so no task holds all different values."""
    centre = medians(train, scale_columns)

    def scaled(df: DataFrame) -> DataFrame:
        rows = df.withColumns({"_centre": centre, "_own": medians(df, scale_columns)})
        parts = [F.coalesce(F.col(c), F.col("_own")[c]) / F.col("_centre")[c] for c in scale_columns]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return rows.withColumn("_scale", F.greatest(total / len(parts), F.lit(floor)))

    z = scaled(train).groupBy("zone").agg(F.percentile(F.col("error") / F.col("_scale"), F.lit(TAUS)).alias("_q"))
    out = scaled(target).join(z, "zone", "left")
    return out.select(*KEY, *[(F.get("_q", F.lit(i)) * F.col("_scale")).alias(n) for i, n in enumerate(Q)])


# ---------------------------------------------------------------- calibration and combination
def nonconformity(p10: str = "p10", p90: str = "p90", y: str = "error") -> Column:
    return F.greatest(F.col(p10) - F.col(y), F.col(y) - F.col(p90))


def conformal_adjustment(pred: DataFrame, truth: DataFrame, level: float = 0.8) -> DataFrame:
    """Per-zone widening (negative narrows) that makes p10-a .. p90+a cover `level` of the truth."""
    rows = pred.join(truth.select(*KEY, "error"), KEY)
    return rows.groupBy("zone").agg(F.percentile(nonconformity(), F.lit(level)).alias("adjust"))


def apply_adjustment(pred: DataFrame, adjust: DataFrame) -> DataFrame:
    a = F.coalesce(F.col("adjust"), F.lit(0.0))
    moved = pred.join(adjust, "zone", "left").withColumns({"p10": F.col("p10") - a, "p90": F.col("p90") + a})
    return moved.withColumns(sorted_quantiles(*Q)).drop("adjust")


def calibrate_out_of_fold(pred: DataFrame, truth: DataFrame, n_blocks: int, level: float = 0.8) -> DataFrame:
    """Each block is widened by what the other blocks' errors call for; all blocks come from one pass."""
    rows = pred.join(truth.select(*KEY, "error"), KEY)
    per_zone = rows.groupBy("zone").agg(*[
        F.percentile(F.when(F.col("block") != b, nonconformity()), F.lit(level)).alias(f"_a{b}") for b in range(n_blocks)])
    table = per_zone.select("zone", F.array(*[F.col(f"_a{b}") for b in range(n_blocks)]).alias("_adj"))
    out = pred.join(table, "zone", "left")
    a = F.coalesce(F.get("_adj", F.col("block")), F.lit(0.0))
    return out.withColumns({"p10": F.col("p10") - a, "p90": F.col("p90") + a}).withColumns(sorted_quantiles(*Q)).drop("_adj")


def average_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two quantile sets, sorted again."""
    both = a.select(*KEY, *Q).join(b.select(*KEY, *[F.col(q).alias(f"_{q}") for q in Q]), KEY)
    return both.withColumns({q: (F.col(q) + F.col(f"_{q}")) / 2 for q in Q}).withColumns(sorted_quantiles(*Q)).select(*KEY, *Q)


def zone_scale(train: DataFrame) -> DataFrame:
    return train.groupBy("zone").agg(F.avg(F.abs("error")).alias("zone_scale"))


def normalized_target(df: DataFrame, scale: DataFrame) -> DataFrame:
    return df.join(scale, "zone").withColumn("error", F.try_divide(F.col("error"), F.col("zone_scale")))


def scaled_back(pred: DataFrame, scale: DataFrame) -> DataFrame:
    """Quantiles of a normalised target in the zone's own units."""
    return pred.join(scale, "zone").withColumns({q: F.col(q) * F.col("zone_scale") for q in Q}).select(*KEY, *Q)


def normalized_forecast(train: DataFrame, target: DataFrame, fit: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Quantiles fitted on errors in units of the zone's mean absolute training error, so that zones share what is learnt,
    scaled back to each zone of `target`. `fit(train, target)` returns KEY and the quantiles; by default climatology by hour."""
    scale = zone_scale(train)

    def hourly(rows: DataFrame, days: DataFrame) -> DataFrame:
        return days.select(*KEY).join(climatology(rows, ["hour_ending"]), "hour_ending")

    return scaled_back((fit or hourly)(normalized_target(train, scale), target), scale)


def select_baseline(df: DataFrame, candidates: list[str], is_validation: Column, fill: str) -> DataFrame:
    """Quantiles of the candidate with the lowest validation loss (earlier wins ties), holes filled from `fill`.

    Loss is taken on the rows where every candidate has a value."""
    have = None
    for c in candidates:
        for q in Q:
            ok = F.col(f"{c}_{q}").isNotNull()
            have = ok if have is None else have & ok
    losses = df.filter(is_validation & F.col("error").isNotNull() & have).select(
        F.array_min(F.array(*[F.struct(F.avg(quantile_loss("error", f"{c}_")).alias("loss"), F.lit(i).alias("i"))
                              for i, c in enumerate(candidates)]))["i"]).scalar()
    pick = df.withColumn("_best", losses)

    def chosen(q: str) -> Column:
        out = F.lit(None).cast("double")
        for i, c in enumerate(candidates):
            out = F.when(F.col("_best") == i, F.col(f"{c}_{q}")).otherwise(out)
        return F.coalesce(out, F.col(f"{fill}_{q}"))

    names = F.array(*[F.lit(c) for c in candidates])
    return pick.withColumns({q: chosen(q) for q in Q} | {"baseline_name": F.get(names, F.col("_best"))}).drop("_best")


# ---------------------------------------------------------------- forests
def _features(df: DataFrame, features: list[str], zones: list[str]) -> DataFrame:
    cols = {f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(-9999.0)) for i, c in enumerate(features)}
    cols |= {f"_z{i}": (F.col("zone") == z).cast("double") for i, z in enumerate(zones)}
    return VectorAssembler(inputCols=list(cols), outputCol="_vec").transform(df.withColumns(cols)).drop(*cols)


def _forest(train: DataFrame, label: str, trees: int, depth: int, min_leaf: int, seed: int, weight: str | None) -> Model:
    rf = RandomForestRegressor(featuresCol="_vec", labelCol=label, leafCol="_leaves", numTrees=trees, maxDepth=depth,
                               minInstancesPerNode=min_leaf, seed=seed, subsamplingRate=0.8, maxMemoryInMB=FIT_MEMORY_MB)
    return (rf.setWeightCol(weight) if weight else rf).fit(train)


def side_by_side(jobs: list) -> list:
    """Results of the calls in their order; the fits of several folds or experiments share the cluster instead of queueing."""
    with ThreadPoolExecutor(max_workers=FITS_AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def leaf_quantiles(model: Model, train: DataFrame, taus: list[float] = TAUS) -> Column:
    """One value, found when the query runs: by tree, by leaf, the quantiles of the training errors there.

    Errors are counted per tree, leaf and bin of about four per cent, which combines before the shuffle however many rows
    there are; a quantile is the mean of the bin that holds its rank. The value has trees x 2^depth entries."""
    at = model.transform(train).select("error", F.posexplode(vector_to_array("_leaves")).alias("tree", "leaf"))
    bins = at.groupBy("tree", F.col("leaf").cast("int").alias("leaf"), F.floor(F.asinh("error") * BINS_PER_E).alias("bin")).agg(
        F.count("error").alias("n"), F.sum("error").alias("s")).filter("n > 0")
    leaves = bins.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "s"))).alias("h"), F.sum("n").alias("total"))

    def at_rank(tau: float) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("v"))
        return F.aggregate("h", start, lambda a, x: F.struct(
            (a["n"] + x["n"]).alias("n"),
            F.when(a["v"].isNull() & (a["n"] + x["n"] > tau * (F.col("total") - 1)), x["s"] / x["n"]).otherwise(a["v"]).alias("v")))["v"]

    by_tree = leaves.select("tree", "leaf", F.array(*[at_rank(t) for t in taus]).alias("q")).groupBy("tree").agg(
        F.collect_list(F.struct("leaf", "q")).alias("e"))
    dense = F.transform(F.sequence(F.lit(0), F.array_max("e.leaf")), lambda i: F.get(F.filter("e", lambda x: x["leaf"] == i), F.lit(0))["q"])
    return by_tree.select("tree", dense.alias("q")).agg(F.sort_array(F.collect_list(F.struct("tree", "q")))["q"].alias("t")).scalar()


def quantile_forest(train: DataFrame, test: DataFrame, features: list[str], zones: list[str], trees: int = TREES,
                    depth: int = DEPTH, min_leaf: int = 20, seed: int = 0, weight: str | None = None) -> DataFrame:
    """Quantile regression by forest: errors of the training rows in each leaf give the leaf's quantiles, a row's
    prediction is their mean over the trees, looked up in the row: test rows are neither repeated nor shuffled."""
    xtr, xte = _features(train, features, zones), _features(test, features, zones)
    model = _forest(xtr, "error", trees, depth, min_leaf, seed, weight)
    rows = model.transform(xte).select(*KEY, vector_to_array("_leaves").alias("_l")).withColumn("_t", leaf_quantiles(model, xtr))
    found = F.filter(F.zip_with("_l", "_t", lambda leaf, tree: F.get(tree, leaf.cast("int"))), lambda q: q.isNotNull())
    sums = F.aggregate(found, F.array_repeat(F.lit(0.0), len(Q)), lambda acc, q: F.zip_with(acc, q, lambda x, y: x + y))
    rows = rows.select(*KEY, F.size(found).alias("_n"), sums.alias("_s"))
    return rows.select(*KEY, *[F.try_divide(F.get("_s", F.lit(i)), F.col("_n")).alias(q) for i, q in enumerate(Q)]).withColumns(sorted_quantiles(*Q))


def blocked_predictions(train: DataFrame, test: DataFrame, fit, n_blocks: int = 5, embargo_days: int = 7):
    """Out-of-fold predictions over contiguous day blocks with an embargo around the held block, and a fit on all
    training days for the test days. `fit(train, test)` returns quantiles; only n_blocks day ranges reach the driver.
    All fits read one checkpointed frame and run side by side."""
    marked = cut_lineage(train.join(time_blocks(train, "operating_date", n_blocks), "operating_date"))
    test = cut_lineage(test)
    spans = {r["block"]: (r["lo"], r["hi"]) for r in marked.groupBy("block").agg(
        F.min("operating_date").alias("lo"), F.max("operating_date").alias("hi")).collect()}

    def fold(b: int, lo, hi) -> DataFrame:
        d = F.col("operating_date")
        outside = (d < F.date_sub(F.lit(lo), embargo_days)) | (d > F.date_add(F.lit(hi), embargo_days))
        return fit(marked.filter(outside), marked.filter(F.col("block") == b)).withColumn("block", F.lit(b))

    *parts, whole = side_by_side([*(lambda b=b, lo=lo, hi=hi: fold(b, lo, hi) for b, (lo, hi) in sorted(spans.items())),
                                  lambda: fit(marked.drop("block"), test)])
    return stack_all(parts), whole


def two_stage(train: DataFrame, test: DataFrame, features: list[str], zones: list[str], trees: int = TREES, depth: int = DEPTH,
              n_blocks: int = 3) -> DataFrame:
    """Median by forest, error size by a second forest on out-of-fold residuals, tails as multiples of the size."""
    def median(tr: DataFrame, te: DataFrame) -> DataFrame:
        return quantile_forest(tr, te, features, zones, trees, depth).select(*KEY, F.col("p50").alias("_med"))

    train, test = cut_lineage(train), cut_lineage(test)
    oof, med = blocked_predictions(train, test, median, n_blocks, embargo_days=0)
    resid = cut_lineage(train.join(oof.drop("block"), KEY).withColumn("_resid", F.col("error") - F.col("_med")).withColumn("_abs", F.abs("_resid")))
    sized = _features(resid, features, zones)
    model = _forest(sized, "_abs", trees, depth, 20, 0, None)
    size = F.greatest(F.col("prediction"), F.lit(1.0))
    z = (model.transform(sized).select((F.col("_resid") / size).alias("_z"))
         .select(F.percentile_approx("_z", F.lit([0.1, 0.9]), F.lit(10000))).scalar())
    rows = model.transform(_features(test.join(med, KEY), features, zones)).withColumn("_zq", z)
    return rows.select(*KEY, (F.col("_med") + F.get("_zq", F.lit(0)) * size).alias("p10"), F.col("_med").alias("p50"),
                       (F.col("_med") + F.get("_zq", F.lit(1)) * size).alias("p90")).withColumns(sorted_quantiles(*Q))


def recency_weights(df: DataFrame, half_life_days: float) -> DataFrame:
    latest = df.select(F.max("operating_date")).scalar()
    return df.withColumn("_latest", latest).withColumn(
        "weight", F.pow(F.lit(0.5), F.datediff("_latest", "operating_date") / half_life_days)).drop("_latest")


def loss_and_coverage(pred: DataFrame, truth: DataFrame) -> DataFrame:
    rows = pred.select(*KEY, *Q).join(truth.select(*KEY, "error"), KEY)
    return rows.agg(F.count("*").alias("n"), F.avg(quantile_loss("error")).alias("loss"),
                    F.avg(covered("error")).alias("coverage"), F.avg(F.col("p90") - F.col("p10")).alias("width"))


def ablation_grid(periods: dict[str, tuple[DataFrame, DataFrame]], experiments: dict[str, dict], features: list[str],
                  zones: list[str], trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Loss and coverage per experiment and period, with the change against the first experiment.

    An experiment may set extra features, a recency half life, or several seeds whose quantiles are averaged."""
    frames = {p: (cut_lineage(tr), cut_lineage(te)) for p, (tr, te) in periods.items()}  # every experiment reads the same two frames

    def scored(period: str, order: int, name: str, e: dict) -> DataFrame:
        tr, te = frames[period]
        fit_on = recency_weights(tr, e["half_life"]) if e.get("half_life") else tr
        runs = [quantile_forest(fit_on, te, features + e.get("extra", []), zones, trees, depth, seed=s,
                                weight="weight" if e.get("half_life") else None) for s in e.get("seeds", [0])]
        mean = runs[0] if len(runs) == 1 else stack_all(runs).groupBy(*KEY).agg(*[F.avg(q).alias(q) for q in Q])
        return loss_and_coverage(mean, te).withColumns({"experiment": F.lit(name), "period": F.lit(period), "_order": F.lit(order)})

    table = stack_all(side_by_side([lambda p=p, i=i, n=n, e=e: scored(p, i, n, e) for p in periods for i, (n, e) in enumerate(experiments.items())]))
    first = F.first("loss").over(Window.partitionBy("period").orderBy("_order"))
    return table.withColumn("vs_first_pct", 100 * (F.col("loss") / first - 1)).drop("_order")
