"""Which source columns each column of a frame is made of, read from its analysed plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Columns = frozenset[tuple[str, str]]
NONE: Columns = frozenset()


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def source_name(node) -> str:
    """The last part of a relation's path without its suffix, a catalog's name of it, or the node's name."""
    kind = node.nodeName()
    if kind.startswith("LogicalRelation") or kind.startswith("Relation"):
        return node.relation().location().rootPaths().head().getName().removesuffix(".parquet")
    return node.name() if kind.startswith("RelationV2") else kind


class Lineage:
    """Walks a plan from its leaves; attributes are told apart by their expression ids, so renaming and equal names do no harm.

    `made`: expression id to the source columns that its values are made of. `decided`: the source columns that decide which
    rows there are: of filters, join conditions and grouping.
    """

    def __init__(self, df: DataFrame):
        self.made: dict[int, Columns] = {}
        self.decided: set[tuple[str, str]] = set()
        self.shared: dict[int, list[Columns]] = {}
        plan = df._jdf.queryExecution().analyzed()
        self.walk(plan)
        self.columns = [(a.name(), self.made[self.id(a)]) for a in items(plan.output())]

    @staticmethod
    def id(x) -> int:
        return x.exprId().id()

    def of(self, expression) -> Columns:
        return NONE.union(*[self.made.get(self.id(r), NONE) for r in items(expression.references().toSeq())])

    def walk(self, node) -> None:
        kind = node.nodeName()
        if kind == "WithCTE":
            for d in items(node.cteDefs()):
                self.walk(d.child())
                self.shared[d.id()] = [self.made[self.id(a)] for a in items(d.child().output())]
            self.walk(node.plan())
            return
        children = items(node.children())
        for child in children:
            self.walk(child)
        out = items(node.output())
        if kind == "CTERelationRef":
            self.made.update(zip(map(self.id, out), self.shared[node.cteId()]))
        elif kind == "Union":
            parts = [[self.made[self.id(a)] for a in items(child.output())] for child in children]
            self.made.update((self.id(a), NONE.union(*[p[i] for p in parts])) for i, a in enumerate(out))
        elif kind == "Expand":
            rows = [items(p) for p in items(node.projections())]
            self.made.update({self.id(a): NONE.union(*[self.of(p[i]) for p in rows]) for i, a in enumerate(out)})
        elif not children:
            self.made.update((self.id(a), frozenset({(source_name(node), a.name())})) for a in out)
        else:
            named = {self.id(e): self.of(e) for e in items(node.expressions()) if hasattr(e, "exprId") and e.nodeName() == "Alias"}
            for a in out:
                if self.id(a) in named:
                    self.made[self.id(a)] = named[self.id(a)]
                elif self.id(a) not in self.made:  # of a generator or a function of whole rows: all that it reads
                    read = self.of(node.generator()) if kind == "Generate" else NONE.union(*[self.made[self.id(x)] for child in children for x in items(child.output())])
                    self.made[self.id(a)] = read
        if kind == "Filter":
            self.decided |= self.of(node.condition())
        elif kind == "Join" and node.condition().isDefined():
            self.decided |= self.of(node.condition().get())
        elif kind == "Aggregate":
            for e in items(node.groupingExpressions()):
                self.decided |= self.of(e)


def column_lineage(df: DataFrame) -> DataFrame:
    """output, source, source_column, role: `value` for what a column is made of, `rows` (output null) for what decides the rows."""
    found = Lineage(df)
    rows = [(name, s, c, "value") for name, made in found.columns for s, c in sorted(made)] + [(None, s, c, "rows") for s, c in sorted(found.decided)]
    return df.sparkSession.createDataFrame(rows, "output string, source string, source_column string, role string")


def checked_lineage(df: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """column_lineage with rows and filled: the source's number of rows and of values in the column; one scan of each source."""
    edges = column_lineage(df)
    parts = None
    for name, rows in sources.items():
        used = [r.source_column for r in edges.where(F.col("source") == name).select("source_column").distinct().collect()]  # columns of a table
        if used:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`n_{c}`").alias("filled")) for c in used])).alias("p")
            one = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in used]).select(F.lit(name).alias("s"), "rows", pairs).select("s", "rows", "p.c", "p.filled")
            parts = one if parts is None else parts.unionByName(one)
    return edges.join(parts, (F.col("source") == F.col("s")) & (F.col("source_column") == F.col("c")), "left").drop("s", "c")
