"""Statistical tests from distributed aggregates.

Spark reduces the data to sufficient statistics (counts, moments, rank sums);
what is left is arithmetic on one row per group, and the tail probability of
that row.  Tests over rows take ``by`` columns and return one row per group;
tests over counts return one row per row of counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite
from statistics import NormalDist

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardline.functions import tails
from wardline.sources.storage import materialize

# Smallest samples, and the notes each test carries.
MIN_TABLE_TOTAL = 10
MIN_GROUP = 2
MIN_PAIRS = 3
LOW_EXPECTED = "Some expected cells are below 5; consider Fisher exact."
WELCH_NOTE = "Welch test assumes independent observations and approximately normal group means."
RANK_NOTE = "Tests distributional shift, not strictly medians."
ANOVA_NOTE = "Assumes independent, approximately normal, homoscedastic residuals."
EXACT_RANK_LIMIT = 8


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def proportion_ci(df: DataFrame, successes: str = "numerator", n: str = "denominator", confidence: float = 0.95) -> DataFrame:
    """Wilson interval of each row's proportion; null where n is not positive or the count is outside [0, n]."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    total, hits = _double(n), _double(successes)
    valid = (total > 0) & hits.between(0, total)
    p = F.try_divide(hits, total)
    scale = 1 + F.try_divide(F.lit(z * z), total)
    center = (p + F.try_divide(F.lit(z * z), 2 * total)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), total) + F.try_divide(F.lit(z * z), 4 * total * total)) / scale
    return df.select(
        "*", F.when(valid, p).alias("estimate"), F.when(valid, center - half).alias("ci_low"),
        F.when(valid, center + half).alias("ci_high"))


def contingency_cells(df: DataFrame, row: str, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed counts per (by, row, column); incomplete pairs are left out."""
    return df.dropna(subset=[row, column]).groupBy(*by, F.col(row).alias("row"), F.col(column).alias("column")).agg(
        F.count("*").alias("observed"))


def chi_square(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Independence test of contingency cells (row, column, observed).

    Uses N * (sum O^2 / (R C) - 1), which needs only the non-zero cells; with one
    degree of freedom the continuity correction applies.  Cells are category
    counts, so the windows over them stay small.
    """
    cells = cells.filter(F.col("observed") > 0)
    margins = cells.select(
        *by, "row", "column", _double("observed").alias("o"),
        F.sum(_double("observed")).over(W.partitionBy(*by, "row")).alias("r"),
        F.sum(_double("observed")).over(W.partitionBy(*by, "column")).alias("c"))
    table = margins.groupBy(*by).agg(
        F.sum("o").alias("_n"), F.count_distinct("row").alias("_rows"), F.count_distinct("column").alias("_columns"),
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("_ratio"),
        F.min("r").alias("_r1"), F.min("c").alias("_c1"))
    n, small_row, small_column = F.col("_n"), F.col("_r1"), F.col("_c1")
    dof = (F.col("_rows") - 1) * (F.col("_columns") - 1)
    plain = n * (F.col("_ratio") - 1)
    # In a 2 x 2 table all cells miss their expectation by the same amount d, and
    # the statistic is d^2 * n^3 / (R1 R2 C1 C2).
    product = small_row * (n - small_row) * small_column * (n - small_column)
    d = F.sqrt(F.greatest(plain, F.lit(0.0)) * product / F.pow(n, 3))
    corrected = F.pow(d - F.least(d, F.lit(0.5)), 2) * F.try_divide(F.pow(n, 3), product)
    enough = n >= MIN_TABLE_TOTAL
    statistic = F.when(enough, F.when(dof == 0, 0.0).when(dof == 1, corrected).otherwise(plain))
    shorter = F.greatest(F.least("_rows", "_columns") - 1, F.lit(1))
    out = table.select(
        *by, statistic.alias("statistic"), dof.cast("bigint").alias("degrees_of_freedom"), n.cast("bigint").alias("n"),
        F.sqrt(statistic / (n * shorter)).alias("effect_size"),
        F.when(~enough, f"A table with total n >= {MIN_TABLE_TOTAL} is required.")
        .when(small_row * small_column / n < 5, LOW_EXPECTED).alias("warning"))
    return out.withColumn("p_value", tails.chi_square_p(F.col("statistic"), F.col("degrees_of_freedom").cast("double")))


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, keep: Sequence[str] = ()) -> DataFrame:
    """Two-sided exact test of each row's 2 x 2 counts [[a, b], [c, d]]."""
    odds = F.when(_double(b) * _double(c) > 0, _double(a) * _double(d) / (_double(b) * _double(c))).when(
        _double(a) * _double(d) > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    total = F.col(a) + F.col(b) + F.col(c) + F.col(d)
    return df.select(
        *keep, odds.alias("odds_ratio"), total.cast("bigint").alias("n"),
        tails.fisher_p(_double(a), _double(b), _double(c), _double(d)).alias("p_value"))


def fisher_exact_cells(df: DataFrame, row: Column, column: Column, by: Sequence[str] = ()) -> DataFrame:
    """Exact test of two boolean columns: four conditional counts, then the tail."""
    counted = df.groupBy(*by).agg(
        F.count_if(row & column).alias("a"), F.count_if(row & ~column).alias("b"),
        F.count_if(~row & column).alias("c"), F.count_if(~row & ~column).alias("d"))
    return fisher_exact(counted, "a", "b", "c", "d", by)


def _moments(condition: Column, value: Column, tag: str) -> list[Column]:
    picked = F.when(condition, value)
    return [F.count(picked).alias(f"_n{tag}"), F.avg(picked).alias(f"_m{tag}"), F.var_samp(picked).alias(f"_v{tag}")]


def welch_t(df: DataFrame, value: str, in_first: Column, by: Sequence[str] = ()) -> DataFrame:
    """Unequal-variance t test of ``value`` between rows where ``in_first`` is true and false; Cohen's d by pooled sd."""
    x = _double(value)
    m = df.groupBy(*by).agg(*_moments(in_first, x, "a"), *_moments(~in_first, x, "b"))
    na, nb, va, vb = _double("_na"), _double("_nb"), F.col("_va"), F.col("_vb")
    enough = (na >= MIN_GROUP) & (nb >= MIN_GROUP)
    ea, eb = F.try_divide(va, na), F.try_divide(vb, nb)
    t = F.try_divide(F.col("_ma") - F.col("_mb"), F.sqrt(ea + eb))
    dof = F.try_divide(F.pow(ea + eb, 2), F.try_divide(ea * ea, na - 1) + F.try_divide(eb * eb, nb - 1))
    pooled = F.sqrt(F.try_divide((na - 1) * va + (nb - 1) * vb, na + nb - 2))
    effect = F.when(pooled > 0, (F.col("_ma") - F.col("_mb")) / pooled).otherwise(0.0)
    out = m.select(
        *by, F.when(enough, t).alias("statistic"), F.when(enough, dof).alias("degrees_of_freedom"),
        F.when(enough, effect).alias("effect_size"), (F.col("_na") + F.col("_nb")).alias("n"),
        F.lit(WELCH_NOTE).alias("note"))
    return out.withColumn("p_value", tails.student_p(F.col("statistic"), F.col("degrees_of_freedom")))


def one_way_anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """F test of equal group means, from count, mean and variance per group; null if a group has under two values."""
    per_group = df.groupBy(*by, group).agg(
        F.count(_double(value)).alias("_n"), F.avg(_double(value)).alias("_m"),
        F.coalesce(F.var_samp(_double(value)), F.lit(0.0)).alias("_v"))
    # Deviations are taken from a mean that is known first, so nothing large cancels.
    grand = per_group.groupBy(*by).agg(F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("_grand"))
    joined = per_group.join(grand, list(by)) if by else per_group.withColumn("_grand", grand.scalar())
    overall = joined.groupBy(*by).agg(
        F.count("*").alias("_k"), F.sum("_n").alias("_total"), F.min("_n").alias("_least"),
        F.sum((F.col("_n") - 1) * F.col("_v")).alias("_within"),
        F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_grand"), 2)).alias("_between"))
    between = F.col("_between")
    d1, d2 = _double("_k") - 1, _double("_total") - _double("_k")
    statistic = F.try_divide(F.try_divide(between, d1), F.try_divide(F.col("_within"), d2))
    out = overall.select(
        *by, F.when((F.col("_k") >= 2) & (F.col("_least") >= MIN_GROUP), statistic).alias("statistic"), d1.alias("df_between"), d2.alias("df_within"),
        F.col("_total").alias("n"), F.lit(ANOVA_NOTE).alias("note"))
    return out.withColumn("p_value", tails.f_p(F.col("statistic"), F.col("df_between"), F.col("df_within")))


def _correlation_p(out: DataFrame, tool: str, by: Sequence[str]) -> DataFrame:
    r, n = F.col("statistic"), _double("n")
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt((n - 2) / (1 - r * r)))
    return out.select(
        *by, F.lit(tool).alias("tool"), "statistic", "n", tails.student_p(t, n - 2).alias("p_value"))


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Linear correlation over complete pairs."""
    pairs = df.select(*by, _double(x).alias("_x"), _double(y).alias("_y")).dropna(subset=["_x", "_y"])
    # Not F.corr, which raises on a constant column in ANSI mode; here the result is null.
    r = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    out = pairs.groupBy(*by).agg(r.alias("_r"), F.count("*").alias("n")).withColumn(
        "statistic", F.when(F.col("n") >= MIN_PAIRS, F.col("_r")))
    return _correlation_p(out, "pearson_correlation", by)


def rank_positions(
    counts: DataFrame, value: str, weight: str, by: Sequence[str] = (), buckets: int = 1024,
) -> DataFrame:
    """Add ``mean_rank`` (inside each ``by`` group) to a table of distinct values and their row counts.

    Ranks need a running total over all values.  The values are cut at
    approximate quantiles (at most ``buckets`` numbers reach the driver), summed
    inside each bucket, and shifted by the total of the buckets before.  The
    table is written first, as it is read for the quantiles and for the ranks.
    """
    counts = materialize(counts, "ranks")
    edges = counts.approxQuantile(value, [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets))
    inner = sorted({e for e in edges if isfinite(e)}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    placed = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep").transform(counts)
    running = W.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_before", F.coalesce(F.sum(weight).over(running), F.lit(0)))
    totals = placed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_size"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*by, "_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    # Without groups there is one row per bucket; with groups Spark decides by size.
    return inside.join(starts if by else F.broadcast(starts), [*by, "_bucket"]).select(
        *counts.columns,
        (_double("_start") + _double("_before") + (_double(weight) + 1) / 2).alias("mean_rank"))


def mann_whitney(df: DataFrame, value: str, in_first: Column, by: Sequence[str] = (), method: str = "auto") -> DataFrame:
    """Rank-sum test of two samples.

    By ``auto`` exact for tie-free samples of which one holds at most 8 values,
    whatever the other holds; otherwise normal with tie and continuity
    correction, which ``normal`` asks for at all times.  The result's
    ``method`` says which it was.
    """
    if method not in ("auto", "normal"):
        raise ValueError(f"unknown method: {method}")
    sample = df.select(*by, _double(value).alias("_value"), in_first.alias("_first")).dropna(subset=["_value", "_first"])
    counts = sample.groupBy(*by, "_value").agg(
        F.count_if("_first").alias("_a"), F.count_if(~F.col("_first")).alias("_b")
    ).withColumn("_w", F.col("_a") + F.col("_b"))
    ranked = rank_positions(counts, "_value", "_w", by)
    w = _double("_w")
    s = ranked.groupBy(*by).agg(
        F.sum(_double("_a") * F.col("mean_rank")).alias("_rank_sum"), F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"),
        F.sum(w * w * w - w).alias("_ties"))
    na, nb = _double("_na"), _double("_nb")
    n = na + nb
    u = F.col("_rank_sum") - na * (na + 1) / 2
    sigma = F.sqrt(na * nb / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, na * nb - u) - na * nb / 2 - 0.5, sigma)
    exact = (F.least(na, nb) <= EXACT_RANK_LIMIT) & (F.col("_ties") == 0) & F.lit(method == "auto")
    enough = (na >= MIN_GROUP) & (nb >= MIN_GROUP)
    out = s.select(
        *by, F.when(enough, u).alias("statistic"), (F.col("_na") + F.col("_nb")).alias("n"),
        F.when(exact, "exact").otherwise("normal").alias("method"), F.lit(RANK_NOTE).alias("note"),
        na.alias("_first_n"), nb.alias("_second_n"), F.when(enough, F.greatest(z, F.lit(0.0))).alias("_z"))
    is_exact = F.col("method") == "exact"
    return out.withColumn(
        "p_value",
        F.when(is_exact, tails.mann_whitney_exact_p(
            F.when(is_exact, F.col("statistic")), F.col("_first_n"), F.col("_second_n"))
        ).otherwise(F.least(tails.normal_p(F.col("_z")), F.lit(1.0))),
    ).drop("_first_n", "_second_n", "_z")


def ranked_rows(rows: DataFrame, value: str, weight: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` (each standing for ``weight`` equal ones) with the mean rank of ``value`` inside each ``by`` group.

    Rows are written by ranges of (group, value, all else), so a value that very
    many rows share is cut as well; in each file a running sum gives places, and
    files start after the weights of the files before.  A value lies in one file,
    or at the ends of several: only those, two to a file at most, are put
    together and sent to every task.  No row is moved by its value alone.
    """
    names = rows.columns
    rest = [c for c in names if c not in (*by, value)]
    stored = materialize(
        rows.repartitionByRange(*by, value, *rest).sortWithinPartitions(*by, value), "ranked")
    placed = stored.select(*names, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    totals = placed.groupBy("_file").agg(F.sum(weight).alias("_total"))
    earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)  # a line for each file
    offsets = F.broadcast(totals.select("_file", "_total", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")))
    running = W.partitionBy("_file").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_before", F.coalesce(F.sum(weight).over(running), F.lit(0)))
    stretch = W.partitionBy("_file", *by, value)
    measured = inside.withColumns({
        "_first": F.min("_before").over(stretch), "_size": F.sum(weight).over(stretch),
        **({"_group": F.min("_before").over(W.partitionBy("_file", *by)), "_held": F.sum(weight).over(W.partitionBy("_file", *by))}
           if by else {})}).join(offsets, "_file")

    def at_ends(keys: Sequence[str], first: str, size: str, name: str) -> DataFrame:
        """Where keys that touch an end of a file begin, and their size, over all files."""
        touching = (F.col(first) == 0) | (F.col(first) + F.col(size) == F.col("_total"))
        edge = measured.where(touching).groupBy("_file", *keys).agg(
            F.min(F.col("_offset") + F.col(first)).alias("_at"), F.max(size).alias("_n"))
        return F.broadcast(edge.groupBy(*keys).agg(F.min("_at").alias(f"{name}_at"), F.sum("_n").alias(f"{name}_n")).select(
            *[F.col(k).alias(f"{name}_{k}") for k in keys], f"{name}_at", f"{name}_n"))

    def joined(df: DataFrame, ends: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        return df.join(ends, [F.col(k).eqNullSafe(F.col(f"{name}_{k}")) for k in keys], "left")

    keys = [*by, value]
    found = joined(measured, at_ends(keys, "_first", "_size", "_tie"), keys, "_tie")
    start = F.coalesce("_tie_at", F.col("_offset") + F.col("_first"))
    if by:
        found = joined(found, at_ends(by, "_group", "_held", "_of"), by, "_of")
        start = start - F.coalesce("_of_at", F.col("_offset") + F.col("_group"))
    return found.select(*names, (start.cast("double") + (F.coalesce("_tie_n", "_size").cast("double") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank correlation over complete pairs.

    Equal pairs are combined first; the pairs themselves are ranked by each
    side; ranks are centred before they are multiplied.
    """
    pairs = (
        df.select(*by, _double(x).alias("_x"), _double(y).alias("_y")).dropna(subset=["_x", "_y"])
        .groupBy(*by, "_x", "_y").agg(F.count("*").alias("_w")))
    joined = materialize(ranked_rows(ranked_rows(pairs, "_x", "_w", "_rx", by), "_y", "_w", "_ry", by), "pairs")
    sizes = joined.groupBy(*by).agg(F.sum("_w").cast("double").alias("_total"))
    # The mean rank of a group of n is (n + 1) / 2 whatever the ties.
    joined = joined.join(sizes, list(by)) if by else joined.withColumn("_total", sizes.scalar())
    middle = (F.col("_total") + 1) / 2
    centred = joined.select(
        *by, _double("_w").alias("_w"), (F.col("_rx") - middle).alias("_dx"), (F.col("_ry") - middle).alias("_dy"))
    sums = centred.groupBy(*by).agg(
        F.sum("_w").cast("bigint").alias("n"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dy")).alias("_xy"),
        F.sum(F.col("_w") * F.col("_dx") * F.col("_dx")).alias("_xx"),
        F.sum(F.col("_w") * F.col("_dy") * F.col("_dy")).alias("_yy"))
    out = sums.withColumn(
        "statistic", F.when(F.col("n") >= MIN_PAIRS, F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy")))))
    return _correlation_p(out, "spearman_correlation", by)


def proportions_chi_square(groups: DataFrame, label: str, numerator: str = "numerator", denominator: str = "denominator") -> DataFrame:
    """Chi-square over the (numerator, rest) counts of a result with one row per group.

    Runs on the result before small cells are hidden.
    """
    cells = groups.select(F.col(label).alias("row"), F.inline(F.array(
        F.struct(F.lit("yes").alias("column"), F.col(numerator).cast("bigint").alias("observed")),
        F.struct(F.lit("no").alias("column"), (F.col(denominator) - F.col(numerator)).cast("bigint").alias("observed")))))
    return chi_square(cells)


# Fixed names: the tests a caller may ask for.
TESTS = {
    "proportion_confidence_interval": proportion_ci,
    "chi_square": chi_square,
    "fisher_exact": fisher_exact,
    "independent_t_test": welch_t,
    "mann_whitney_u": mann_whitney,
    "one_way_anova": one_way_anova,
    "pearson_correlation": pearson,
    "spearman_correlation": spearman,
}


def run_test(name: str, *args, **kwargs) -> DataFrame:
    if name not in TESTS:
        raise ValueError(f"Unapproved statistical tool: {name}")
    return TESTS[name](*args, **kwargs)
