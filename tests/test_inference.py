"""Tests of differences against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from rankweave.functions import normal_cdf
from rankweave.operators import inference


def phi(z):
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def test_normal_cdf(spark):
    zs = [-8.0, -3.0, -1.96, -0.5, 0.0, 0.1, 1.0, 2.5, 9.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_cdf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - phi(r.z)) < 2e-7 for r in got)


def test_holm_by_hand(spark):
    rows = [("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("a", 4, None), ("b", 1, 0.5), ("b", 2, 0.5), ("c", 1, 0.9)]
    out = inference.holm(spark.createDataFrame(rows, "f string, t int, p double"), ["f"], ["t"])
    got = {(r.f, r.t): round(r.p_holm, 6) for r in out.collect()}
    assert got == {("a", 1): 0.03, ("a", 3): 0.06, ("a", 2): 0.06, ("b", 1): 1.0, ("b", 2): 1.0, ("c", 1): 0.9}


def test_equivalence_verdicts(spark):
    rows = [(0.0, 0.1), (0.5, 0.1), (5.0, 0.1), (0.5, 5.0), (0.0, 0.0), (2.0, 0.0)]
    out = inference.equivalence(spark.createDataFrame(rows, "diff double, se double"), 1.0)
    got = {(r["diff"], r.se): r.verdict for r in out.collect()}
    assert got == {(0.0, 0.1): "equivalent", (0.5, 0.1): "small", (5.0, 0.1): "different", (0.5, 5.0): "undecided", (0.0, 0.0): "equivalent", (2.0, 0.0): "different"}


def test_simulated_power_near_formula(spark):
    effects = {"null": (0.0, 1.0), "half": (0.5, 1.0), "gate": (0.6, 1.0)}
    out = {r.test: r for r in inference.simulated_power(spark, effects, 40, 1500, gate="gate", tasks=4).collect()}
    for name, (mean, sd) in effects.items():
        shift = mean / sd * math.sqrt(40)
        assert out[name].alone == pytest.approx(1 - phi(1.96 - shift) + phi(-1.96 - shift), abs=0.04)
        assert out[name].gated <= out[name].holm <= out[name].alone
    assert all(r.gated is None for r in inference.simulated_power(spark, {"half": (0.5, 1.0)}, 30, 50, tasks=2).collect())


def test_contrasts_of_odd_rows(spark):
    runs = spark.createDataFrame([("b", 1, 1.0), ("b", 1, 3.0), ("v", 1, 5.0), ("v", 1, None), ("w", 1, 2.0), ("w", 1, 4.0), ("w", 2, 1.0)], "variant string, dataset int, throughput double")
    assert [(r.variant, r.dataset, r["diff"]) for r in inference.contrasts(runs, "b").collect()] == [("w", 1, 1.0)]
    assert inference.contrasts(runs.limit(0), "b").count() == 0


def test_gate_status(spark):
    rows = [("a", "FAIL", 0, 0), ("b", "WARN", 5, 1), ("c", "FAIL", 5, 2), ("d", "FAIL", 5, 0), ("e", "FAIL", None, None)]
    got = {r.check_id: r.status for r in inference.gate_status(spark.createDataFrame(rows, "check_id string, severity string, seen long, faults long")).collect()}
    assert got == {"a": "UNKNOWN", "b": "WARN", "c": "FAIL", "d": "PASS", "e": "UNKNOWN"}
