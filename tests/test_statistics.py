"""Chi-square with its correction, tail probabilities, Holm and distances."""
import math

import pytest

from newsgauge.operators import contingency as CT
from newsgauge.operators import framing as FR


def counts(spark, table, name="d"):
    rows = [("e", name, "u", c, g, n) for c, row in table.items() for g, n in row.items()]
    return spark.createDataFrame(rows, "event string, dimension string, unit string, category string, media_group string, n bigint")


def test_yates_only_for_two_by_two(spark):
    r = CT.with_p(CT.chi_square(counts(spark, {"x": {"a": 12, "b": 5}, "y": {"a": 8, "b": 15}}))).first()
    e = [20 * 17 / 40, 20 * 17 / 40, 20 * 23 / 40, 20 * 23 / 40]
    want = sum((abs(o - x) - .5) ** 2 / x for o, x in zip((12, 5, 8, 15), e))
    assert (r.dof, r.n) == (1, 40) and r.chi2 == pytest.approx(want) and r.p == pytest.approx(math.erfc(math.sqrt(want / 2)))
    assert r.v == pytest.approx(math.sqrt(want / 40)) and r.min_expected == pytest.approx(8.5)


def test_empty_rows_and_cells(spark):
    r = CT.chi_square(counts(spark, {"x": {"a": 10, "b": 0, "c": 0}, "y": {"a": 0, "b": 6, "c": 0}, "z": {"a": 4, "b": 5, "c": 0}})).first()
    assert r.dof == 2 and r.n == 25                                   # column c is gone, empty cells still count
    e = {"x": (10 * 14 / 25, 10 * 11 / 25), "y": (6 * 14 / 25, 6 * 11 / 25), "z": (9 * 14 / 25, 9 * 11 / 25)}
    o = {"x": (10, 0), "y": (0, 6), "z": (4, 5)}
    assert r.chi2 == pytest.approx(sum((o[k][i] - e[k][i]) ** 2 / e[k][i] for k in e for i in (0, 1)))
    assert CT.chi_square(counts(spark, {"x": {"a": 3, "b": 4}})).count() == 0


def test_tail_values(spark):
    known = [(3.841458820694124, 1, .05), (5.991464547107979, 2, .05), (7.814727903251179, 3, .05), (11.070497693516351, 5, .05), (18.307038053275146, 10, .05), (0.0, 4, 1.0)]
    df = spark.createDataFrame([(x, k) for x, k, _ in known], "chi2 double, dof int")
    got = [r.p for r in df.withColumn("p", CT.upper_tail("chi2", "dof")).collect()]
    assert got == pytest.approx([p for _, _, p in known], rel=1e-9)


def test_holm_steps(spark):
    df = spark.createDataFrame([("e", "a", .01), ("e", "b", .04), ("e", "c", .03), ("e", "d", .5)], "event string, dimension string, p double")
    assert {r.dimension: round(r.p_holm, 10) for r in CT.holm(df).collect()} == {"a": .04, "c": .09, "b": .09, "d": .5}


def test_distance_and_flips(spark):
    df = spark.createDataFrame([("e", "a", "x", 5), ("e", "b", "y", 5), ("e", "c", "x", 9)], "event string, media_group string, narrative_id string, n bigint")
    d = {(r.group_a, r.group_b): r.js_distance for r in FR.group_distances(df, "narrative_id").collect()}
    assert d["a", "b"] == pytest.approx(1, abs=1e-5) and d["a", "c"] == pytest.approx(0, abs=1e-5)
    cont = spark.createDataFrame([("e", "g1", "x", "hero", 4), ("e", "g2", "x", "villain", 3), ("e", "g3", "x", "ally", 2), ("e", "g1", "y", "hero", 4), ("e", "g2", "y", "hero", 4)],
                                 "event string, media_group string, entity string, role string, n bigint")
    r = FR.role_flips(cont).collect()
    assert [(x.entity, x.n_groups, x.opposed_contradiction) for x in r] == [("x", 2, True)]


def test_silhouettes_match_pairs(spark):
    """The closed form against all pairs, a cluster of one among them."""
    import numpy as np
    from newsgauge.operators import clusters as CL
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    labels = {3: rng.integers(0, 2, 60), 4: rng.integers(0, 4, 60)}
    labels[3][7] = 2
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(i, v.tolist(), int(labels[3][i]), int(labels[4][i])) for i, v in enumerate(x)], "id long, vector array<double>, k3 int, k4 int").withColumn("features", array_to_vector("vector"))
    centres = {k: np.stack([x[labels[k] == c].mean(axis=0) for c in range(k)]) for k in labels}
    got = {r.k: r for r in CL.silhouettes(df, centres).collect()}
    far = 1 - x @ x.T
    for k, own in labels.items():
        s = []
        for i in range(60):
            mean = [far[i, (own == c) & (np.arange(60) != i)].mean() if ((own == c) & (np.arange(60) != i)).any() else None for c in range(k)]
            a, b = mean[own[i]], min(m for c, m in enumerate(mean) if c != own[i])
            s.append(0.0 if a is None else (b - a) / max(a, b))
        unit = centres[k] / np.linalg.norm(centres[k], axis=1, keepdims=True)
        assert abs(got[k].silhouette - np.mean(s)) < 1e-9 and got[k].n == 60 and got[k].nearest == ((x @ unit.T).argmax(axis=1) == own).sum()


def test_binomial_quantiles_match_counted_ones():
    from newsgauge.operators.framing import binomial_quantile
    from math import comb
    for n, p in ((1, 0.5), (30, 0.1), (200, 0.37), (50, 1.0)):
        total, quantiles = 0.0, {}
        for k in range(n + 1):
            total += comb(n, k) * p ** k * (1 - p) ** (n - k)
            for q in (0.025, 0.975):
                if total >= q and q not in quantiles:
                    quantiles[q] = k
        assert [binomial_quantile(n, p, q) for q in (0.025, 0.975)] == [quantiles[0.025], quantiles[0.975]]
    assert abs(binomial_quantile(10 ** 8, 0.3, 0.5) - 3 * 10 ** 7) < 2000
