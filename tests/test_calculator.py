"""Expressions, registries, equipment and evidence rules."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.functions import calculator
from quarry.operators import metadata
from quarry.registry import Registry, apply_cleaners, cleaners


def test_evaluate():
    value, steps = calculator.evaluate("(P * R) / (S * E - 0.6 * P)", {"P": 10, "R": 500, "S": 120, "E": 0.85})
    assert value == pytest.approx(5000 / 96) and len(steps) == 5 and steps[0] == "P * R = 5000"
    assert calculator.evaluate("sqrt(144) + -2 ** 2 + max(1, 3) // 2 + pi % 2")[0] == pytest.approx(12 - 4 + 1 + math.pi % 2)
    for bad in ("__import__('os')", "a.b", "1 if 2 else 3", "1 +", "True", "unknown", "[1]"):
        with pytest.raises(ValueError):
            calculator.evaluate(bad)
    with pytest.raises(ValueError, match="zero"):
        calculator.evaluate("1 / 0")


def test_column_equals_evaluate(spark):
    rows = [(1.5, 2.0), (-7.0, 3.0), (4.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    for text in ("x + y * 2 - 1", "x // y", "x % y", "x / y", "abs(x) ** 2 + min(x, y)"):
        got = [r[0] for r in df.select(calculator.column(text)).collect()]
        for (x, y), g in zip(rows, got, strict=True):
            try:
                assert g == pytest.approx(calculator.evaluate(text, {"x": x, "y": y})[0])
            except ValueError:
                assert g is None


def test_registry(spark):
    r = Registry("thing")

    @r.register("A")
    def f():
        return 1

    assert r.get("a") is f and "A" in r and list(r) == ["a"]
    with pytest.raises(ValueError):
        r.register("a", 2)
    assert r.register("a", 2, override=True) == 2
    with pytest.raises(KeyError):
        r.get("b")
    cleaners.register("twice", lambda d: d.withColumn("x", F.col("x") * 2), override=True)
    assert apply_cleaners(spark.createDataFrame([(3,)], "x int"), "twice", "twice").first().x == 12


def test_relations(spark):
    rows = [(["P-1"], ["P-2"], 0.9, 0.9, "x", True), (["P-1"], ["P-1"], 0.3, 0.1, "x", True), (["P-1"], ["P-1"], 0.1, 0.1, "x", True), (["P-1"], ["P-1"], 0.1, 0.1, "it must", True), (["P-1"], [], 0.3, 0.1, "x", True), ([], [], 0.2, 0.1, "x", True), ([], [], 0.9, 0.9, "x", False), ([], ["P-1"], 0.1, 0.66, "must", True)]
    df = spark.createDataFrame(rows, "r array<string>, f array<string>, o double, s double, t string, h boolean")
    got = [r[0] for r in df.select(metadata.relation(*map(F.col, "rfosth"))).collect()]
    assert got == ["UNRELATED", "DIRECT", "RELATED", "GENERIC_REQUIREMENT", "RELATED", "RELATED", "UNRELATED", "GENERIC_REQUIREMENT"]
