"""Rules, results and the gate.

A rule is a function of tables that returns violating rows. Results are (check_name, passed, record_count, severity).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import union_all

Tables = dict[str, DataFrame]
CRITICAL = "CRITICAL"


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    violations: Callable[[Tables], DataFrame]
    needs: tuple[str, ...]
    severity: str = CRITICAL
    #: The number of rows with which the rule passes: none by default; (1, 1) for exactly one, (1, None) for some.
    allowed: tuple[int, int | None] = (0, 0)

    def result(self, tables: Tables) -> DataFrame:
        low, high = self.allowed
        n = F.col("record_count")
        passed = (n >= low) if high is None else n.between(low, high)
        return self.violations(tables).agg(F.count(F.lit(1)).alias("record_count")).select(F.lit(self.name).alias("check_name"), passed.alias("passed"), "record_count", F.lit(self.severity).alias("severity"))


class RuleFailure(RuntimeError):
    pass


def run_rules(rules: list[Rule], tables: Tables) -> DataFrame:
    """Results of the rules whose tables are there, in one plan."""
    return union_all([r.result(tables) for r in rules if set(r.needs) <= tables.keys()])


def summary(results: DataFrame) -> DataFrame:
    failed = ~F.col("passed")
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(failed).alias("failed"), F.count_if(failed & (F.col("severity") == CRITICAL)).alias("failed_critical"))


def gate(results: DataFrame) -> None:
    """Raises when a critical rule failed; write reports before."""
    names = [r.check_name for r in results.where(~F.col("passed") & (F.col("severity") == CRITICAL)).select("check_name").collect()]
    if names:
        raise RuleFailure("failed checks: " + "; ".join(names))
