"""Databases, histories with late changes and star facts on the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import hierarchy, history, star
from ..sources import jdbc
from ..sources import lake as sources
from . import views
from .job_bindings import key_sql, scratch

c = F.col


def database(spark, sf_dir, *names: str) -> jdbc.JdbcSource:
    """An embedded database with some of the given tables."""
    source = jdbc.in_memory(spark, f"given_{uuid.uuid4().hex}")
    for name in names:
        jdbc.load_table(spark.read.parquet(f"{sf_dir}/{name}.parquet"), source, name)
    return source


def s1_jdbc_scan(spark, sf_dir) -> DataFrame:
    """All orders, in parts by the distribution of the customer's key."""
    rows = database(spark, sf_dir, "orders").read("orders", "o_custkey", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def s1_jdbc_pushdown(spark, sf_dir) -> DataFrame:
    """Filter and aggregate in the database."""
    rows = database(spark, sf_dir, "orders").table("orders")
    return rows.where("o_totalprice > 1000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))


def s2_jdbc_tables(spark, sf_dir) -> DataFrame:
    """Tables of the database with their rows, and what is said of one that is missing."""
    source = database(spark, sf_dir, "nation", "region", "customer")
    found = [(r.table_name, sources.count_rows(source, r.table_name), None) for r in source.tables().collect()]
    try:
        sources.require_table(source, "orders")
    except LookupError as e:
        found.append(("orders", None, str(e)))
    return spark.createDataFrame(found, "table_name string, row_count long, error string")


def s9_jdbc_count(spark, sf_dir) -> DataFrame:
    source = database(spark, sf_dir, "orders", "customer")
    return spark.createDataFrame([(n, sources.count_rows(source, n, ("orders", "customer"))) for n in ("orders", "customer")], "table_name string, row_count long")


DIRECT = {
    "S1_jdbc_scan": (s1_jdbc_scan, "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "S1_jdbc_pushdown": (s1_jdbc_pushdown, "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_totalprice > 1000 GROUP BY 1"),
    "S2_jdbc_tables": (s2_jdbc_tables, "SELECT 'nation' AS table_name, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM nation UNION ALL SELECT 'region', count(*), NULL FROM region UNION ALL SELECT 'customer', count(*), NULL FROM customer UNION ALL SELECT 'orders', NULL, 'the source has no table orders'"),
    "S9_jdbc_count": (s9_jdbc_count, "SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer"),
}


#: Histories: view, own key, time, attributes.
HISTORIES = {
    "department": ("transfers", "transfer_id", "transfer_date", ("new_department_id",)),
    "location": ("transfers", "transfer_id", "transfer_date", ("new_location_id",)),
    "manager": ("transfers", "transfer_id", "transfer_date", ("new_manager_id",)),
    "role": ("promotions", "promotion_id", "promotion_date", ("new_role_id", "new_salary")),
}


def late(t, name: str) -> DataFrame:
    """Three quarters of the changes make the versions; the others come late, in two batches, the later ones first."""
    view, own, at, tracked = HISTORIES[name]
    rows, part = t[view], F.pmod(F.xxhash64(own), F.lit(8))
    versions = history.versions_of(rows.where(part > 1), "employee_id", at, tracked)
    for k in (1, 0):
        versions = history.merge_changes(versions, rows.where(part == k), "employee_id", at, tracked)
    return versions.drop("restated")


def late_sql(name: str) -> str:
    view, _, at, tracked = HISTORIES[name]
    order = ", ".join(f"{x} DESC NULLS LAST" for x in tracked)
    state = ", ".join(tracked)
    return f"""WITH r AS (SELECT * FROM (SELECT employee_id, {at} AS d, ({state}) AS s, row_number() OVER (PARTITION BY employee_id, {at} ORDER BY {order}) AS k FROM (SELECT *, {at} FROM {view})) WHERE k = 1),
 l AS (SELECT employee_id, d, s, lag(s) OVER w AS p, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY employee_id ORDER BY d)),
 v AS (SELECT employee_id, s, d AS effective_from, lead(d) OVER w AS effective_to, row_number() OVER w AS version FROM l WHERE k = 1 OR s IS DISTINCT FROM p WINDOW w AS (PARTITION BY employee_id ORDER BY d))
 SELECT employee_id, {", ".join(f"s[{i + 1}] AS {x}" for i, x in enumerate(tracked))}, effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INT) AS version FROM v"""


def late_sql_of(name: str) -> str:
    """One attribute has no tuple in SQL."""
    text, tracked = late_sql(name), HISTORIES[name][3]
    if len(tracked) == 1:
        text = text.replace(f"({tracked[0]}) AS s", f"{tracked[0]} AS s").replace("s[1] AS", "s AS")
    return text.replace(f"(SELECT *, {HISTORIES[name][2]} FROM {HISTORIES[name][0]})", HISTORIES[name][0])


PEOPLE = ("employees", "transfers", "promotions")
#: The last transfer and promotion of a day; then what held at a time, by as-of joins that know nothing of versions.
HELD = """WITH tr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id, transfer_date ORDER BY new_department_id DESC NULLS LAST, new_location_id DESC NULLS LAST, new_manager_id DESC NULLS LAST) AS k FROM transfers) WHERE k = 1),
 pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY employee_id, promotion_date ORDER BY new_role_id DESC NULLS LAST, new_salary DESC NULLS LAST) AS k FROM promotions) WHERE k = 1)"""


def held(fact: str, columns: str) -> str:
    """SQL: columns of fact (employee_id, held_on) and what held then."""
    return f"""SELECT {columns}, e.employee_id IS NOT NULL OR tr.employee_id IS NOT NULL OR pr.employee_id IS NOT NULL AS known,
  CASE WHEN tr.employee_id IS NULL THEN e.department_id ELSE tr.new_department_id END AS department_id, CASE WHEN tr.employee_id IS NULL THEN e.location_id ELSE tr.new_location_id END AS location_id,
  CASE WHEN tr.employee_id IS NULL THEN e.manager_id ELSE tr.new_manager_id END AS manager_id, CASE WHEN pr.employee_id IS NULL THEN e.role_id ELSE pr.new_role_id END AS role_id,
  CASE WHEN pr.employee_id IS NULL THEN e.annual_salary ELSE pr.new_salary END AS annual_salary
 FROM {fact} AS f ASOF LEFT JOIN tr ON f.employee_id = tr.employee_id AND f.held_on >= tr.transfer_date ASOF LEFT JOIN pr ON f.employee_id = pr.employee_id AND f.held_on >= pr.promotion_date LEFT JOIN employees AS e ON f.employee_id = e.employee_id AND f.held_on IS NOT NULL"""


TIMELINE = HELD + f""", x AS (SELECT employee_id, DATE '0001-01-01' AS held_on FROM employees UNION SELECT employee_id, transfer_date FROM transfers UNION SELECT employee_id, promotion_date FROM promotions),
 h AS ({held('x', 'f.employee_id, f.held_on')}),
 l AS (SELECT *, lag((department_id, location_id, manager_id, role_id, annual_salary)) OVER w AS p, row_number() OVER w AS k FROM h WINDOW w AS (PARTITION BY employee_id ORDER BY held_on)),
 v AS (SELECT *, lead(held_on) OVER w AS effective_to, row_number() OVER w AS version FROM l WHERE k = 1 OR (department_id, location_id, manager_id, role_id, annual_salary) IS DISTINCT FROM p WINDOW w AS (PARTITION BY employee_id ORDER BY held_on))"""


def timeline(t) -> DataFrame:
    return star.employee_timeline(t)


def employee_history(t) -> DataFrame:
    return star.employee_versions(t, star.employee_timeline(t))


def star_fact(t, name: str) -> DataFrame:
    return star.star_fact(name, t, star.employee_timeline(t))


def star_sql(name: str) -> str:
    table, own, who, at, measures = star.FACTS[name]
    extra = {x for fact, columns in star.OWN_KEYS.values() if fact == name for x in columns}
    key = lambda *k: f"CASE WHEN coalesce({', '.join(f'CAST({x} AS VARCHAR)' for x in k)}) IS NOT NULL THEN {key_sql(*k)} END"
    keys = {"employee": ("employee_id",), "department": ("department_id",), "location": ("location_id",), "job_role": ("role_id",), "manager": ("manager_id",)}
    found = [f"{key(*k)} AS {n}_key" for n, k in keys.items()]
    found += [(key(*k) if fact == name else "CAST(NULL AS BIGINT)") + f" AS {n}_key" for n, (fact, k) in star.OWN_KEYS.items()]
    columns = ", ".join(["f.fact_id", "f.employee_id", "f.held_on", *[f"f.{x}" for x in sorted(extra)], *[f"f.m_{m}" for m in measures]])
    measured = "".join(f", {e} AS m_{m}" for m, e in measures.items())
    more = "".join(f", {x}" for x in sorted(extra))
    return TIMELINE + f""", facts AS (SELECT {own} AS fact_id, {who} AS employee_id, CAST({at} AS DATE) AS held_on{more}{measured} FROM {table}), g AS ({held('facts', columns)})
 SELECT fact_id, {", ".join(found)}, CASE WHEN g.effective_from IS NOT NULL THEN {key_sql('employee_id', 'effective_from')} END AS employee_version_key, CAST(strftime(held_on, '%Y%m%d') AS INT) AS date_key, annual_salary AS salary_then{"".join(f", m_{m} AS {m}" for m in measures)}
 FROM (SELECT g.*, v.held_on AS effective_from FROM g ASOF LEFT JOIN v ON g.employee_id = v.employee_id AND g.held_on >= v.held_on) AS g"""


#: Customers in chains of 100: the first has no manager, one that does not exist, or one 40 further down, which is a cycle.
CHAINS = "SELECT CAST(c_custkey AS INT) AS employee_id, CAST(CASE WHEN c_custkey % 100 > 0 THEN c_custkey - 1 WHEN c_custkey % 300 = 100 THEN -1 - c_custkey WHEN c_custkey % 300 = 200 THEN c_custkey + 40 END AS INT) AS manager_id FROM customer"


def lines(rows: DataFrame) -> DataFrame:
    return hierarchy.reporting_lines(rows, scratch(rows.sparkSession))


#: By all pairs of an employee and someone above.
LINES = """WITH RECURSIVE p AS ({rows}),
r AS (SELECT employee_id, manager_id AS above FROM p WHERE manager_id IN (SELECT employee_id FROM p) UNION SELECT r.employee_id, p.manager_id FROM r JOIN p ON p.employee_id = r.above WHERE p.manager_id IN (SELECT employee_id FROM p)),
loops AS (SELECT employee_id AS member FROM r WHERE employee_id = above),
loop AS (SELECT l.member, min(r.above) AS cycle_id FROM loops AS l JOIN r ON r.employee_id = l.member GROUP BY 1),
above AS (SELECT r.employee_id, count(*) AS level, min(r.above) FILTER (WHERE p.manager_id IS NULL OR p.manager_id NOT IN (SELECT employee_id FROM p)) AS top, min(loop.cycle_id) AS cycle_id FROM r JOIN p ON p.employee_id = r.above LEFT JOIN loop ON loop.member = r.above GROUP BY 1),
below AS (SELECT above, count(*) AS n FROM r GROUP BY 1), direct AS (SELECT manager_id, count(*) AS n FROM p WHERE manager_id IS NOT NULL GROUP BY 1)
SELECT p.employee_id, CAST(CASE WHEN a.cycle_id IS NULL THEN coalesce(a.level, 0) END AS INT) AS level, CASE WHEN a.cycle_id IS NULL THEN coalesce(a.top, p.employee_id) END AS top,
 CASE WHEN loop.member IS NOT NULL THEN 'cycle' WHEN a.cycle_id IS NOT NULL THEN 'below cycle' WHEN p.manager_id IS NULL THEN 'root' WHEN a.employee_id IS NULL THEN 'missing' WHEN t.manager_id IS NULL THEN 'reports' ELSE 'below missing' END AS status,
 a.cycle_id, coalesce(direct.n, 0) AS direct_reports, CASE WHEN loop.member IS NULL THEN coalesce(below.n, 0) END AS all_reports
FROM p LEFT JOIN above AS a USING (employee_id) LEFT JOIN loop ON loop.member = p.employee_id LEFT JOIN p AS t ON t.employee_id = a.top LEFT JOIN below ON below.above = p.employee_id LEFT JOIN direct ON direct.manager_id = p.employee_id"""


BOUND = {f"P04_late_{n}": ((view,), lambda t, n=n: late(t, n), late_sql_of(n)) for n, (view, *_) in HISTORIES.items()}
BOUND |= {
    "W23_reporting_lines": (("employees",), lambda t: lines(t["employees"]), LINES.format(rows="SELECT employee_id, manager_id FROM employees")),
    "W23_chains_and_cycles": (("customer",), lambda t: lines(t["customer"].sparkSession.sql(CHAINS)), LINES.format(rows=CHAINS)),
    "P04_timeline": (PEOPLE, timeline, TIMELINE + " SELECT employee_id, department_id, location_id, manager_id, role_id, annual_salary, held_on AS effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INT) AS version FROM v"),
    "P05_dim_employee_history": ((*PEOPLE, "departments", "job_roles"), employee_history, TIMELINE + f" SELECT {key_sql('v.employee_id', 'held_on')} AS employee_version_key, v.employee_id, employee_number, hire_date, v.department_id, department_name, business_unit, v.location_id, v.manager_id, v.role_id, role_name, grade, v.annual_salary, held_on AS effective_from, effective_to, effective_to IS NULL AS is_current, CAST(version AS INT) AS version FROM v LEFT JOIN employees AS e ON v.employee_id = e.employee_id LEFT JOIN departments AS d ON v.department_id = d.department_id LEFT JOIN job_roles AS r ON v.role_id = r.role_id"),
}
BOUND |= {f"P06_star_{n}": (tuple(dict.fromkeys((*PEOPLE, star.FACTS[n][0]))), lambda t, n=n: star_fact(t, n), star_sql(n)) for n in star.FACTS}


def bindings() -> tuple[dict, dict]:
    q = {k: fn for k, (fn, _) in DIRECT.items()}
    o = {k: text for k, (_, text) in DIRECT.items() if text}
    for key, (needs, fn, text) in BOUND.items():
        q[key] = lambda spark, sf_dir, f=fn, n=needs: f(views.tables(spark, sf_dir, *n))
        if text:
            o[key] = views.sql(text, *[n for n in needs if n in views.VIEWS])
    return q, o
