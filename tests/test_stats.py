"""Statistics against values worked out by hand or by brute force in plain Python."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import tails
from wardline.operators import stats


def close(value, expected, tolerance=1e-9):
    assert value == pytest.approx(expected, rel=tolerance, abs=1e-12)


def test_tail_values():
    close(tails.chi_square_upper(5.991464547107979, 2), 0.05)
    close(tails.chi_square_upper(3.841458820694124, 1), 0.05)
    close(tails.chi_square_upper(40.0, 2), math.exp(-20))
    close(tails.student_two_sided(1.0, 1), 0.5)
    close(tails.student_two_sided(2.2281388519649385, 10), 0.05)
    close(tails.f_upper(2.2281388519649385 ** 2, 1, 10), 0.05)
    close(tails.student_two_sided(1.959963984540054, 1e9), 0.05, 1e-6)


def cells(spark, table):
    rows = [(str(i), str(j), n) for i, line in enumerate(table) for j, n in enumerate(line)]
    return spark.createDataFrame(rows, "row STRING, column STRING, observed BIGINT")


def test_chi_square_with_correction(spark):
    row = stats.chi_square(cells(spark, [[10, 20], [20, 10]])).first()
    close(row.statistic, 5.4)
    close(row.p_value, math.erfc(math.sqrt(5.4 / 2)))
    close(row.effect_size, math.sqrt(5.4 / 60))
    assert (row.degrees_of_freedom, row.n, row.warning) == (1, 60, None)


def test_chi_square_larger_table_and_empty_cell(spark):
    table = [[12, 0, 9], [4, 7, 8]]
    total = 40
    expected = sum(
        (o - sum(line) * sum(r[j] for r in table) / total) ** 2 / (sum(line) * sum(r[j] for r in table) / total)
        for line in table for j, o in enumerate(line))
    row = stats.chi_square(cells(spark, table)).first()
    close(row.statistic, expected)
    close(row.p_value, math.exp(-expected / 2))
    assert row.degrees_of_freedom == 2 and row.warning == stats.LOW_EXPECTED


def test_chi_square_needs_ten(spark):
    row = stats.chi_square(cells(spark, [[1, 2], [3, 1]])).first()
    assert row.statistic is None and row.p_value is None and "10" in row.warning


def test_fisher(spark):
    frame = spark.createDataFrame([(1, 9, 8, 2), (8, 2, 1, 5), (0, 5, 5, 0)], "a INT, b INT, c INT, d INT")
    rows = stats.fisher_exact(frame, "a", "b", "c", "d", ["a"]).orderBy("a").collect()
    close(rows[1].odds_ratio, 2 / 72)
    close(rows[1].p_value, 2 * (450 + 10) / 167960)
    close(rows[2].odds_ratio, 20.0)
    close(rows[2].p_value, 280 / 8008)
    close(rows[0].odds_ratio, 0.0)
    close(rows[0].p_value, 2 / 252)


def test_fisher_large_counts_agree_with_full_sum():
    a, b, c, d = 120, 380, 170, 330
    weights = {k: math.comb(290, k) * math.comb(710, 500 - k) for k in range(0, 291)}
    expected = sum(w for w in weights.values() if w <= weights[a]) / sum(weights.values())
    close(tails.fisher_two_sided(a, b, c, d), expected, 1e-8)


def test_wilson(spark):
    frame = spark.createDataFrame([(20, 100), (5, 0), (7, 3)], "numerator BIGINT, denominator BIGINT")
    rows = stats.proportion_ci(frame).collect()
    close(rows[0].ci_low, 0.13336690, 1e-6)
    close(rows[0].ci_high, 0.28882920, 1e-6)
    assert rows[1].estimate is None and rows[2].ci_low is None


def test_welch(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    frame = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b] + [(None, True)], "v DOUBLE, g BOOLEAN")
    row = stats.welch_t(frame, "v", F.col("g")).first()
    va, vb = 5 / 3, 10.0
    close(row.statistic, (2.5 - 6) / math.sqrt(va / 4 + vb / 5))
    close(row.degrees_of_freedom, (va / 4 + vb / 5) ** 2 / ((va / 4) ** 2 / 3 + (vb / 5) ** 2 / 4))
    close(row.effect_size, (2.5 - 6) / math.sqrt((3 * va + 4 * vb) / 7))
    assert row.n == 9 and 0 < row.p_value < 1


def test_mann_whitney_exact(spark):
    frame = spark.createDataFrame([(float(v), v < 4) for v in range(1, 7)], "v DOUBLE, g BOOLEAN")
    row = stats.mann_whitney(frame, "v", F.col("g")).first()
    assert (row.statistic, row.method) == (0.0, "exact")
    close(row.p_value, 0.1)


def test_mann_whitney_exact_counts_every_arrangement():
    n1, n2 = 4, 6
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in itertools.combinations(range(1, n1 + n2 + 1), n1)]
    for u in (3, 8, 12, 20):
        top = max(u, n1 * n2 - u)
        close(tails.mann_whitney_exact(u, n1, n2), min(1.0, 2 * sum(x >= top for x in us) / len(us)))


def ranks(values):
    ordered = sorted(values)
    return [sum(i + 1 for i, w in enumerate(ordered) if w == v) / ordered.count(v) for v in values]


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    # A third of the rows share one value.
    return [(5 if n % 3 == 0 else rng.randint(0, 60), rng.randint(0, 30), bool(rng.getrandbits(1))) for n in range(400)]


def test_mann_whitney_with_ties(spark, sample):
    row = stats.mann_whitney(spark.createDataFrame(sample, "v INT, w INT, g BOOLEAN").repartition(5), "v", F.col("g")).first()
    rk = ranks([v for v, _, _ in sample])
    n1 = sum(g for _, _, g in sample)
    n2 = len(sample) - n1
    u = sum(r for r, (_, _, g) in zip(rk, sample) if g) - n1 * (n1 + 1) / 2
    counts = [[v for v, _, _ in sample].count(x) for x in {v for v, _, _ in sample}]
    n = n1 + n2
    sigma = math.sqrt(n1 * n2 / 12 * (n + 1 - sum(t ** 3 - t for t in counts) / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sigma
    close(row.statistic, u)
    close(row.p_value, math.erfc(z / math.sqrt(2)))
    assert row.method == "normal"


def correlation(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(
        sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_correlations(spark, sample):
    frame = spark.createDataFrame(sample, "v INT, w INT, g BOOLEAN").repartition(7)
    x, y = [float(v) for v, _, _ in sample], [float(w) for _, w, _ in sample]
    close(stats.pearson(frame, "v", "w").first().statistic, correlation(x, y))
    rho = stats.spearman(frame, "v", "w").first()
    close(rho.statistic, correlation(ranks(x), ranks(y)))
    assert rho.n == 400


def test_groups_give_what_each_group_gives_alone(spark, sample):
    frame = spark.createDataFrame([(n % 3, v, w, g) for n, (v, w, g) in enumerate(sample)], "k INT, v INT, w INT, g BOOLEAN")
    tests = (
        lambda df, by: stats.mann_whitney(df, "v", F.col("g"), by), lambda df, by: stats.spearman(df, "v", "w", by),
        lambda df, by: stats.pearson(df, "w", "v", by), lambda df, by: stats.welch_t(df, "w", F.col("g"), by),
        lambda df, by: stats.one_way_anova(df, "w", "g", by),
        lambda df, by: stats.chi_square(stats.contingency_cells(df.withColumn("c", F.col("w") % 4), "g", "c", by), by))
    for test in tests:
        together = {r.k: r for r in test(frame, ["k"]).collect()}
        assert set(together) == {0, 1, 2}
        for key in (1, 2):
            alone = test(frame.filter(F.col("k") == key), []).first()
            for column in ("statistic", "p_value"):
                close(together[key][column], alone[column], 1e-8)


def test_perfect_correlation_and_few_pairs(spark):
    frame = spark.createDataFrame([(float(n), float(2 * n)) for n in range(5)], "x DOUBLE, y DOUBLE")
    row = stats.pearson(frame, "x", "y").first()
    close(row.statistic, 1.0)
    assert row.p_value == pytest.approx(0.0, abs=1e-6)
    assert stats.pearson(frame.limit(2), "x", "y").first().statistic is None


def test_anova(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 6.0], "c": [9.0, 10.0, 12.0, 13.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    row = stats.one_way_anova(spark.createDataFrame(rows, "g STRING, v DOUBLE"), "v", "g").first()
    grand = sum(v for _, v in rows) / len(rows)
    between = sum(len(vs) * (sum(vs) / len(vs) - grand) ** 2 for vs in groups.values()) / 2
    within = sum((v - sum(vs) / len(vs)) ** 2 for vs in groups.values() for v in vs) / 7
    close(row.statistic, between / within)
    close(row.p_value, tails.f_upper(between / within, 2, 7))


def test_unknown_test_is_refused():
    with pytest.raises(ValueError):
        stats.run_test("anything_else")
