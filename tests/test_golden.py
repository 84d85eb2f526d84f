"""Published rows and pinned semantics, as literals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arborstat.functions import labels, numeric, scores
from arborstat.operators import longitudinal as L, profiling as P, rules, scoring, statistics as S, voxels as V


def test_kernels(spark):
    names = {
        "B41f": False, "B50f": False, "C": False, "F": False, "FC01": False, "L": False, "YC": False, "BONEPLUS": True, "B50s": False,
        "B60f": True, "B70f": True, "B80f": True, "B80s": True, "FC18": True, "FC51": True, "FC53": True, "LUNG": True, "lung": True, "": False,
    }
    sharp, score = labels.kernel_sharpness("k")
    got = spark.createDataFrame([(n,) for n in names], "k string").select("k", sharp.alias("s"), score.alias("v")).collect()
    assert {r["k"]: r["s"] for r in got} == names
    values = {r["k"]: r["v"] for r in got}
    assert (values["B41f"], values["FC01"], values["LUNG"], values["lung"], values["YC"], values[""]) == (41, 1, 90, 80, 50, 0)


QC = [  # volume_ml, branch_count, max_generation, pc_ratio, tapering_ratio, failed
    (17.91, 33, 6, 0.0, 0.802, 1), (14.72, 19, 5, 0.0, 0.795, 1), (103.12, 1130, 40, 0.473, 0.97, 1), (63.39, 1484, 90, 2.243, 0.995, 1),
    (105.85, 1084, 45, 0.364, 0.964, 1), (40.56, 248, 41, 0.753, 1.008, 2), (140.44, 2215, 117, 10.089, 1.002, 3), (19.19, 287, 14, 0.026, 0.902, 0),
]


def test_quality_checks(spark):
    df = spark.createDataFrame(
        [(i, *map(float, r[:5]), 1.2, r[5]) for i, r in enumerate(QC)],
        "case int, airway_volume_ml double, branch_count double, max_generation double, pc_ratio double, tapering_ratio double, tortuosity double, want int",
    )
    m = {c: c for c in labels.PLAUSIBLE_RANGES}
    out = {r["case"]: r for r in rules.qc_batch(df, "case", m, F.lit(True)).collect()}
    long = {r["case"]: r for r in rules.rollup_checks(rules.long_checks(df, "case", m), "case").collect()}
    for i, r in enumerate(QC):
        assert (out[i]["tech_checks"], out[i]["tech_failed"], out[i]["status"]) == (6, r[5], "UNRELIABLE" if r[5] else "RELIABLE")
        assert (long[i]["n_failed"], long[i]["reliable"]) == (r[5], r[5] == 0)


def test_missing_metrics_are_not_checked_but_volume_is(spark):
    df = spark.createDataFrame([(1, None, None)], "case int, airway_volume_ml double, pc_ratio double")
    r = rules.qc_batch(df, "case", {"airway_volume_ml": "airway_volume_ml", "pc_ratio": "pc_ratio"}, F.lit(True), ("airway_volume_ml",)).first()
    assert (r["tech_checks"], r["tech_failed"], r["status"]) == (1, 1, "UNRELIABLE")


def test_single_visits(spark):
    rows = [(1, 6, 70.19), (2, 15, 82.05), (3, 6, 76.67), (4, 17, 79.26), (5, 0, 71.82)]
    v = spark.createDataFrame([(e, i, w, x) for i, (e, w, x) in enumerate(rows)], "entity int, row_id int, week int, value double")
    r = {x["entity"]: (x["week0_method"], x["week0_quality"], x["week52_method"]) for x in L.interpolated_targets(v).collect()}
    assert r == {
        1: ("nearest", "medium", "failed"), 2: ("failed", "failed", "failed"), 3: ("nearest", "medium", "failed"),
        4: ("failed", "failed", "failed"), 5: ("exact", "high", "failed"),
    }


def test_flat_weeks_use_the_mean(spark):
    v = spark.createDataFrame([(1, 0, 100, 60.0), (1, 1, 100, 70.0)], "entity int, row_id int, week int, value double")
    r = L.value_at_target(v, 52, 15, 10).first()
    assert (r["value"], r["method"], r["quality"], r["distance"], r["n_points"]) == (65.0, "regression_simple", "low", 48, 2)


def test_degenerate_groups_give_null(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 4.0), (2, 1.0, 1.0)], "g int, x double, y double")
    got = df.groupBy("g").agg(numeric.pearson("y", "x").alias("r"), numeric.slope("y", "x").alias("s"), numeric.intercept("y", "x").alias("i")).collect()
    assert all(r["r"] is None and r["s"] is None and r["i"] is None for r in got)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "x double")
    assert df.agg(F.avg(numeric.clean("x"))).first()[0] == 1.5


def test_entropy_score_keeps_its_jump(spark):
    raw, _ = scores.band_score("x", scores.PARENCHYMAL_ENTROPY)
    got = [r[0] for r in spark.createDataFrame([(3.9,), (4.0,), (4.999,), (5.0,), (7.5,)], "x double").select(raw).collect()]
    assert got == pytest.approx([0.0, 2.0, 0.002, 2.0, 10.0])


def test_density_score_falls_inside_bands(spark):
    raw, _ = scores.band_score("x", scores.PARENCHYMAL_DENSITY)
    got = [r[0] for r in spark.createDataFrame([(-850.0,), (-751.0,), (-600.0,), (-500.0,), (None,)], "x double").select(raw).collect()]
    assert got == pytest.approx([3.0, 1.02, 9.0, 7.0, 5.0])


EMPTY = "case int, pc_ratio double, tortuosity double, symmetry double, peripheral_density double, peripheral_diameter double, peripheral_branch_volume double, peripheral_pct double, entropy double, lung_density double, volume_mm3 double, generation_coverage double"


def test_case_without_metrics(spark):
    df = spark.createDataFrame([(1, *[None] * 11)], EMPTY)
    a, b = scoring.assess(df, "case").first(), scoring.assess(df, "case", "rescorer").first()
    assert (a["overall_score"], a["combined_score"], a["overall_confidence"]) == (50.0, None, 0.0)
    assert (b["overall_score"], b["overall_stage"]) == (None, "Unknown")


def test_tag_at_half_is_partial(spark):
    rows = [(p, "everyone", "x") for p in range(14)] + [(p, "half", str(p)) for p in range(7)] + [(p, "few", "y") for p in range(6)]
    got = {r["tag"]: (r["presence"], r["is_constant"], r["constant_value"]) for r in P.tag_profile(spark.createDataFrame(rows, "patient_id int, tag string, value string")).collect()}
    assert got == {"everyone": ("common", True, "x"), "half": ("partial", False, None), "few": ("rare", True, "y")}


def test_histogram_edges_follow_numpy(spark):
    values = list(range(-1100, 160, 7)) + [-1024, -743, -462, -181, 99, 100, 101]
    df = spark.createDataFrame([(1, v) for v in values], "scan_id int, hu int")
    got = np.zeros(100, int)
    for r in V.histogram(df).collect():
        got[r["bin"]] = r["n"]
    assert got.tolist() == np.histogram(values, bins=100, range=(-1024, 100))[0].tolist()


def test_gap_at_the_end_counts(spark):
    areas = [0, 2, 2, 0, 1, 0, 0]
    rows = [(1, z, 0, x, 0, 1 if x < a else 0) for z, a in enumerate(areas) for x in range(3)]
    assert V.profile_gaps(spark.createDataFrame(rows, "scan_id int, z int, y int, x int, hu int, label int")).first()["n_gaps"] == 2


def test_p_values(spark):
    def integral(r, n):
        u = np.linspace(0, 1, 400_001)
        d = (1 - u * u) ** ((n - 4) / 2)
        return d[u >= abs(r)].sum() / d.sum()

    cases = [(0.5, 10), (-0.3, 40), (0.05, 1500), (0.9, 8)]
    got = S.correlation_p(pd.Series([c[0] for c in cases]), pd.Series([c[1] for c in cases]))
    assert got.tolist() == pytest.approx([integral(*c) for c in cases], abs=2e-5)
    assert math.isnan(S.correlation_p(pd.Series([0.1]), pd.Series([2]))[0])


@pytest.mark.parametrize("skip", [None])
def test_leave_one_out_equals_refits(spark, skip):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 15, 40)
    y = 0.02 * x**2 - 3 * x + rng.normal(0, 5, 40)
    pairs = S.long_pairs(spark.createDataFrame(pd.DataFrame({"id": range(40), "f": x, "t": y})), "id", ["f"], ["t"])
    got = {(r["model"], r["id"]): r["predicted"] for r in S.leave_one_out(pairs).collect()}
    closed = {r["id"]: r["predicted"] for r in S.leave_one_out_linear(pairs).collect()}
    for model, degree in S.MODELS.items():
        for i in range(40):
            keep = np.arange(40) != i
            z = (x - x[keep].mean()) / x[keep].std()
            want = np.polyval(np.polyfit(z[keep], y[keep], degree), z[i])
            assert got[(model, i)] == pytest.approx(want, rel=1e-7)
            if degree == 1:
                assert closed[i] == pytest.approx(want, rel=1e-9)


def test_leave_one_out_needs_ten_and_distinct_values(spark):
    few = pd.DataFrame({"id": range(9), "f": np.arange(9.0), "t": np.arange(9.0)})
    two = pd.DataFrame({"id": range(20), "f": [0.0, 1.0] * 10, "t": np.arange(20.0)})
    assert S.leave_one_out(S.long_pairs(spark.createDataFrame(few), "id", ["f"], ["t"])).count() == 0
    models = {r["model"] for r in S.leave_one_out(S.long_pairs(spark.createDataFrame(two), "id", ["f"], ["t"])).collect()}
    assert models == {"linear"}


def test_clipping_keeps_missing(spark):
    df = spark.createDataFrame([(None,), (-2000.0,), (5.0,), (9999.0,)], "x double")
    assert [r[0] for r in df.select(labels.window_level("x", 0.0, 200.0)).collect()] == [None, -100.0, 5.0, 100.0]


def test_ranks_of_values_that_change_when_computed_again(spark):
    """A mean over rows that arrive in another order may differ in its last bit; no row may get lost."""
    import random

    from pyspark.sql import functions as F
    from arborstat.operators import statistics

    again = F.udf(lambda i: i + random.random() / 2, "double").asNondeterministic()
    df = spark.range(200).select(F.lit(1).alias("k"), again("id").alias("x"), F.col("id").cast("double").alias("y"))
    rows = statistics.with_average_ranks(df, ["k"], {"x": "rx", "y": "ry"}).collect()
    assert len(rows) == 200 and all(r["rx"] == r["ry"] for r in rows)


def test_p_value_sql_of_many_rows():
    """Compared without rounding: 20,000 steps up to 1 were too wide for 899,940 rows."""
    import duckdb
    import pandas as pd
    from arborstat.catalog.statistics import p_near_sql
    from arborstat.operators.statistics import correlation_p

    for r, n in ((0.0006192810809921857, 899_940), (0.0006, 50_000_000), (0.3, 20)):
        got = duckdb.sql(f"select {p_near_sql('r', 'n')} as p from (select {r!r}::double as r, {n}::bigint as n)").fetchall()[0][0]
        assert got == pytest.approx(correlation_p(pd.Series([r]), pd.Series([n]))[0], abs=5e-9)


def test_equal_volumes_are_no_decrease(spark):
    """Sums of the same branches in another order differ in the last bit only."""
    from arborstat.operators import scoring

    v = [0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1, 0.5]
    assert v[0] > v[1]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)] + [(2, 0, 5.0 * v[0]), (2, 1, v[1]), (2, 2, 0.0)], "scan_id int, generation int, volume_mm3 double")
    got = {r["scan_id"]: (r["decreasing_ratio"], r["abrupt_drops"]) for r in scoring.volume_distribution(df).collect()}
    assert got == {1: (0.5, 0), 2: (1.0, 1)}


def test_a_score_on_a_limit_has_its_findings(spark):
    """The weighted mean is 35 exactly, in doubles 34.99999999999999: findings of the stage from 35 on."""
    from arborstat.operators import scoring

    cols = "pc_ratio tortuosity symmetry peripheral_density peripheral_diameter peripheral_branch_volume peripheral_pct entropy lung_density volume_mm3 generation_coverage".split()
    df = spark.createDataFrame([(1, 0.18, 3.0999999999999996, 0.68, 0.05, 1.8, 48.0, 25.0, 5.3, -852.0, 26000.0, 14 / 60.0)], "case_id int, " + ", ".join(f"{c} double" for c in cols))
    row = scoring.findings(scoring.assess(df, "case_id"), ["peripheral_density", "pc_ratio", "tortuosity", "symmetry", "generation_coverage"]).first()
    assert row["overall_score"] == pytest.approx(35) and sorted(row["findings"]) == ["generation_coverage", "pc_ratio", "peripheral_density", "symmetry", "tortuosity"]


def test_typed_csv_brings_every_value_back(spark):
    from arborstat import catalog

    rows = catalog.callables()["a01_typed_csv"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 150 * 10 and all(r["value"] is not None for r in rows) and sum(r["with_gaps"] is None for r in rows) == len(rows) // 50
