"""Reporting lines of any depth: levels, subtrees and spans of control, with cycles and missing managers named."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bucketed import remove


def reporting_lines(employees: DataFrame, folder: str) -> DataFrame:
    """employee_id, level, top, status, cycle_id, direct_reports, all_reports of every row; ids are unique and not null.

    status: root (no manager), reports (to a root in the end), missing (the manager is no employee), below missing, cycle (on
    one, oneself as manager included), below cycle. level: steps to the top, the root or the employee whose manager is
    missing; null on and below cycles, as top is. cycle_id: the smallest id of the cycle. all_reports: the employees below,
    null on cycles.

    Pointers double: after k rounds a row knows its manager 2^k levels up, so a chain of n takes log n rounds, each of three
    joins on an id and a sum by pointer; many rows with one pointer are summed before they are sent. Employees below at a
    distance under 2^(k + 1) are those under 2^k and, for each one exactly 2^k below, that one's. Rows that still have a
    pointer when a round finishes none are on or below cycles; once the set of their pointers stays as large, it is the
    cycles' members. Rounds are written to `folder`, and only the last two are kept there until the end. All joins sort and
    merge, as every side grows with the employees and none should pass through the driver; rows without a pointer, whose null
    would bring them all to one task, are not joined by it.
    """
    spark = employees.sparkSession
    people = employees.select("employee_id", "manager_id")
    known = people.select(F.col("employee_id").alias("m"))
    reports = people.where("manager_id IS NOT NULL").groupBy(F.col("manager_id").alias("m2")).agg(F.count(F.lit(1)).alias("direct_reports"))
    above = people.where("manager_id IS NOT NULL").select(F.col("employee_id").alias("e"), "manager_id").join(known.hint("merge"), F.col("manager_id") == F.col("m")).select("e", "m")
    rows = people.join(above.hint("merge"), people["employee_id"] == above["e"], "left").join(reports.hint("merge"), people["employee_id"] == reports["m2"], "left")
    up = F.col("m")
    end = F.when(F.col("manager_id").isNull(), "root").when(up.isNull(), "missing")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rows = rows.select(
        "employee_id", up.alias("up"), F.when(up.isNull(), zero).otherwise(one).alias("steps"), F.when(up.isNull(), F.col("employee_id")).alias("top"), end.alias("end"),
        F.least("employee_id", F.coalesce(up, F.col("employee_id"))).alias("low"), one.alias("size"), F.coalesce("direct_reports", zero).alias("direct_reports"), (~up.isNull()).alias("moved"),
    )
    schema, paths, seen, k = rows.schema, [], None, 0
    while True:
        paths.append(f"{folder}/lines-{k}")
        rows.write.parquet(paths[-1])
        rows, k = spark.read.schema(schema).parquet(paths[-1]), k + 1
        if len(paths) > 2:
            remove(spark, paths.pop(0))
        open_ = rows.where("up IS NOT NULL")
        now = open_.agg(F.count(F.lit(1)), F.count_distinct("up"), F.count_if("moved")).first()
        if not now[0] or (seen and now[:2] == seen and not now[2]):
            break
        seen = now[:2]
        o = rows.select(*[F.col(c).alias(f"o_{c}") for c in ("employee_id", "up", "steps", "top", "end", "low")])
        more = open_.groupBy(F.col("up").alias("below")).agg(F.sum("size").alias("more"))
        above = open_.select(F.col("employee_id").alias("e"), F.col("up").alias("at")).join(o.hint("merge"), F.col("at") == F.col("o_employee_id")).drop("at", "o_employee_id")
        both = rows.join(above.hint("merge"), rows["employee_id"] == above["e"], "left").join(more.hint("merge"), rows["employee_id"] == more["below"], "left")
        low = F.least("low", F.coalesce("o_low", "low"))
        # Sizes grow along exact pointers only: below a cycle they are exact, on one they are not used.
        rows = both.select(
            "employee_id", F.col("o_up").alias("up"), (F.col("steps") + F.coalesce("o_steps", zero)).alias("steps"), F.coalesce("top", "o_top").alias("top"), F.coalesce("end", "o_end").alias("end"),
            low.alias("low"), (F.col("size") + F.coalesce("more", zero)).alias("size"), "direct_reports", (low != F.col("low")).alias("moved"),
        )
    members = open_.select(F.col("up").alias("c")).distinct()
    low_of = rows.select(F.col("employee_id").alias("c2"), F.col("low").alias("cycle_low"))
    lows = open_.select(F.col("employee_id").alias("e"), F.col("up").alias("at")).join(low_of.hint("merge"), F.col("at") == F.col("c2")).select("e", "cycle_low")
    found = rows.join(members.hint("merge"), rows["employee_id"] == members["c"], "left").join(lows.hint("merge"), rows["employee_id"] == lows["e"], "left")
    on, loop = F.col("c").isNotNull(), F.col("up").isNotNull()
    self_ = F.col("steps") == 0
    status = F.when(on, "cycle").when(loop, "below cycle").when(self_, F.col("end")).when(F.col("end") == "root", "reports").otherwise("below missing")
    return found.select(
        "employee_id", F.when(~loop, F.col("steps")).cast("int").alias("level"), F.when(~loop, F.col("top")).alias("top"), status.alias("status"), F.when(loop, F.col("cycle_low")).alias("cycle_id"),
        "direct_reports", F.when(~on, F.col("size") - 1).alias("all_reports"),
    )
