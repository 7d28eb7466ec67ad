"""Rules of a caller's own share a scan, whatever one of them does."""

from dataclasses import dataclass

import pytest
from py4j.protocol import Py4JError
from pyspark.sql import functions as F

from ledgerlake.operators import quality


@dataclass(frozen=True)
class Most:
    """Passes if the largest value of an expression is at most a bound."""

    expression: str
    bound: float = 10.0
    kind: str = "most"

    @property
    def name(self):
        return f"most_{self.expression}"

    def aggregates(self):
        return [F.max(F.expr(self.expression))]

    def verdict(self, got):
        return F.when(got[0] <= self.bound, "passed").otherwise("failed"), got[0], F.lit(self.bound)


@pytest.fixture
def scans(monkeypatch):
    seen, fused = [], quality._fused

    def counted(df, rules, keys):
        out = fused(df, rules, keys)
        collect = out.collect
        out.collect = lambda: seen.append(len(rules)) or collect()
        return out

    monkeypatch.setattr(quality, "_fused", counted)
    return seen


def test_ten_rules_are_one_scan(spark, scans):
    got = quality.evaluate(spark.range(8), [Most(f"id + {i}") for i in range(10)], "r").collect()
    assert scans == [10] and [r.status for r in got] == ["passed"] * 4 + ["failed"] * 6
    assert [r.measured_value for r in got] == [7.0 + i for i in range(10)]


def test_a_rule_that_fails_on_data_is_one_error_row(spark, scans):
    rules = [Most(f"id + {i}") for i in range(9)] + [Most("1 / (id - 3)"), Most("nowhere"), quality.NullCheck("id")]
    got = {r.rule_name: r for r in quality.evaluate(spark.range(8), rules, "r").collect()}
    assert len(got) == 12 and {n for n, r in got.items() if r.status == "error"} == {"most_1 / (id - 3)", "most_nowhere"}
    assert all(got[f"most_id + {i}"].measured_value == 7.0 + i for i in range(9)) and "DIVIDE_BY_ZERO" in got["most_1 / (id - 3)"].error
    assert scans[0] == 10 and len(scans) < 10


def test_a_lost_connection_is_no_error_of_a_rule(spark, monkeypatch):
    def lost(self):
        raise Py4JError("connection lost")

    monkeypatch.setattr(Most, "aggregates", lost)
    with pytest.raises(Py4JError):
        quality.evaluate(spark.range(3), [Most("id")], "r")


def test_no_rules_and_empty_tables(spark):
    assert quality.evaluate(spark.range(3), [], "r").count() == 0
    assert [r.status for r in quality.evaluate(spark.range(0), [Most("id"), quality.NullCheck("id")], "r").collect()] == ["passed", "failed"]
