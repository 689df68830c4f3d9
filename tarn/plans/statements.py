"""Statements, by the plans that Spark's own parser makes of them.

The parser says where in the text every table's name and every expression stands.  Names of the lake's tables are replaced by views
of one snapshot, at these places only: names that a WITH clause defines, texts and comments stay as they are.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotFoundError
from ..identifiers import TableName
from ..operators.delete import delete_rows, kept, mark
from ..types import Column, PartitionColumn, from_spark_type
from .scan import FILE, POSITION, ROW, to_df

if TYPE_CHECKING:
    from ..lake import Lake, LakeTable


def items(seq: Any) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def kind(x: Any) -> str:
    return x.getClass().getSimpleName()


def option(x: Any) -> Any:
    return x.get() if x.isDefined() else None


def place(x: Any) -> tuple[int, int]:
    """Where an expression's text begins and ends. The parser notes predicates from their operator on, so parts count too."""
    spots = [(o.startIndex().get(), o.stopIndex().get() + 1) for o in [x.origin()] if o.startIndex().isDefined()]
    spots += [place(c) for c in items(x.children())]
    return min(a for a, _ in spots), max(b for _, b in spots)


def relations(plan: Any, hidden: frozenset[str] = frozenset(), aliased: bool = False) -> Iterator[tuple[int, int, tuple[str, ...], bool]]:
    """(begin, end, name, has an alias) of each table that is read, but for names that a WITH clause hides."""
    k = kind(plan)
    if k == "UnresolvedWith":
        for x in items(plan.cteRelations()):
            yield from relations(x._2(), hidden)
            hidden |= {x._1().lower()}
        yield from relations(plan.child(), hidden)
        return
    if k == "UnresolvedRelation":
        name = tuple(items(plan.multipartIdentifier()))
        if len(name) > 1 or name[0].lower() not in hidden:
            o = plan.origin()
            yield o.startIndex().get(), o.stopIndex().get() + 1, name, aliased
        return
    for c in items(plan.children()):
        yield from relations(c, hidden, k == "SubqueryAlias")
    for e in items(plan.expressions()):
        yield from inside(e, hidden)


def inside(e: Any, hidden: frozenset[str]) -> Iterator[tuple]:
    if kind(e) in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        yield from relations(e.plan(), hidden)
    for c in items(e.children()):
        yield from inside(c, hidden)


class Statement:
    """A parsed text whose tables are bound to views of the lake's newest or pinned snapshot."""

    def __init__(self, lake: Lake, text: str):
        self.lake, self.text = lake, text
        self.plan = lake.spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        self.views: dict[tuple, str] = {}
        self.swaps: list[tuple[int, int, str]] = []
        tables = {tuple(p.lower() for p in (n.schema, n.name)): n for n in lake.list_tables()}
        for a, b, name, aliased in relations(self.plan):
            full = tables.get(tuple(p.lower() for p in (name if len(name) > 1 else ("main", *name))))
            if full is not None:
                view = self.views.setdefault(tuple(full), f"__lake_{uuid.uuid4().hex[:12]}")
                bare = aliased or re.search(r"(?i)\btable\s*$", text[:a])  # TABLE t takes no alias
                self.swaps.append((a, b, view if bare else f"{view} AS `{name[-1]}`"))

    @contextmanager
    def bound(self) -> Iterator[None]:
        """The views exist for as long as Spark needs to resolve names."""
        for name, view in self.views.items():
            self.lake.get_table(name).to_df().createOrReplaceTempView(view)
        try:
            yield
        finally:
            for view in self.views.values():
                self.lake.spark.catalog.dropTempView(view)

    def piece(self, begin: int = 0, end: int | None = None) -> str:
        """A part of the text, with tables replaced."""
        end, out, at = len(self.text) if end is None else end, [], begin
        for a, b, new in sorted(self.swaps):
            if begin <= a and b <= end:
                out += [self.text[at:a], new]
                at = b
        return "".join([*out, self.text[at:end]])

    def expression(self, x: Any) -> str:
        return self.piece(*place(x))

    def query(self) -> DataFrame:
        with self.bound():
            return self.lake.spark.sql(self.piece())

    def part(self, plan: Any) -> DataFrame:
        """A query inside the statement: all text from where it begins."""
        with self.bound():
            return self.lake.spark.sql(self.piece(plan.origin().startIndex().get()))

    def target(self, x: Any) -> tuple[LakeTable, str]:
        """The table that a statement changes, and the name by which its expressions call it."""
        alias = None
        if kind(x) == "SubqueryAlias":
            alias, x = x.identifier().name(), x.child()
        name = named(x)
        return self.lake.get_table(name), alias or name.name

    def run(self) -> None:
        f = STATEMENTS.get(kind(self.plan))
        if f is None:
            self.query().collect()
            return
        self.lake.require_write()
        f(self, self.plan)


def named(x: Any) -> TableName:
    parts = items(x.nameParts() if kind(x) == "UnresolvedIdentifier" else x.multipartIdentifier())
    if len(parts) > 2:
        raise NotFoundError(f"{'.'.join(parts)} is no name of a table here")
    return TableName(*(parts if len(parts) == 2 else ("main", *parts)))


def spark_of(jtype: Any) -> T.DataType:
    return T._parse_datatype_json_value(json.loads(jtype.json()))


def fitting(df: DataFrame, table: LakeTable) -> DataFrame:
    """Columns cast to the table's types; those that are missing are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.spark()])


# -- rows -----------------------------------------------------------------------------------


def insert(s: Statement, p: Any) -> None:
    table, _ = s.target(p.table())
    df = s.part(p.query())
    if not p.byName():
        df = df.toDF(*(items(p.userSpecifiedCols()) or table.schema.names()))
    unknown = set(df.columns) - set(table.schema.names())
    if unknown:
        raise NotFoundError(f"the table has no columns {sorted(unknown)}")
    if p.overwrite():
        result = table.scan(stats_of=set())
        with s.lake.transaction() as tx:
            t = tx.table(table.name)
            t.append(fitting(df, table), inline=False)
            delete_rows(t, result, "true")
        return
    table.append(fitting(df, table))


def delete(s: Statement, p: Any) -> None:
    table, alias = s.target(p.table())
    where = "true" if kind(p.condition()) == "Literal" and p.condition().sql() == "true" else s.expression(p.condition())
    with s.bound(), s.lake.transaction() as tx:
        delete_rows(tx.table(table.name), table.scan_for(where, tx.catalog), where, alias)


def values_of(s: Statement, assignments: Any, table: LakeTable) -> dict[str, str]:
    """The text of each column's new value."""
    out = {}
    for a in items(assignments):
        c = items(a.key().nameParts())[-1]
        if c not in table.schema.names():
            raise NotFoundError(f"column {c} does not exist")
        out[c] = s.expression(a.value())
    return out


def update(s: Statement, p: Any) -> None:
    """The rows that are hit are written once; from there they are deleted, and inserted anew, in one commit."""
    table, alias = s.target(p.table())
    where, condition = None, option(p.condition())
    if condition is not None:
        where = s.expression(condition)
    new = values_of(s, p.assignments(), table)
    with s.bound(), s.lake.transaction() as tx:
        t, result = tx.table(table.name), table.scan_for(where, tx.catalog)
        with kept(t, to_df(s.lake, result, where, hidden=True, alias=alias)) as (rows, n):
            old = rows.alias(alias)
            t.append(old.select(*[F.expr(new.get(f.name, f"`{f.name}`")).cast(f.dataType).alias(f.name) for f in table.schema.spark()]), inline=False)
            mark(t, result, rows, n)


ACTION, TARGET = "__action", "__target_"


def merge(s: Statement, p: Any) -> None:
    """MERGE INTO: each row of the target takes the first action whose condition holds, and so does each source row without one.

    The join is written once; deletes and new rows come from there.  A target row that two source rows would change is an error.
    """
    table, alias = s.target(p.targetTable())
    if p.notMatchedBySourceActions().size():
        raise ValueError("MERGE has no actions for rows that the source lacks here")
    source = p.sourceTable()
    name = source.identifier().name() if kind(source) == "SubqueryAlias" else items(source.multipartIdentifier())[-1]
    inner = source.child() if kind(source) == "SubqueryAlias" else source
    matched, fresh, on = items(p.matchedActions()), items(p.notMatchedActions()), s.expression(p.mergeCondition())
    fields = table.schema.spark().fields
    with s.bound(), s.lake.transaction() as tx:
        t, result = tx.table(table.name), table.scan(tx.catalog, set())
        text = s.piece(*place_of(inner))
        given = s.lake.spark.sql(f"SELECT * FROM {text}" if kind(inner) == "UnresolvedRelation" else text).withColumn("__given", F.lit(True)).alias(name)
        target = to_df(s.lake, result, hidden=True).withColumn("__there", F.lit(True)).alias(alias)
        both = given.join(target, F.expr(on), "left")
        is_old, action = F.col("`__there`").isNotNull(), F.lit(None).cast("int")
        for k, x in reversed(list(enumerate([*matched, *fresh]))):
            holds = is_old if k < len(matched) else ~is_old
            condition = option(x.condition())
            action = F.when(holds & F.expr(s.expression(condition)) if condition is not None else holds, k).otherwise(action)
        columns = []
        for k, x in enumerate([*matched, *fresh]):
            if kind(x) in ("UpdateAction", "InsertAction"):
                new = values_of(s, x.assignments(), table)
                keep = kind(x) == "UpdateAction"
                columns += [(k, f, F.expr(new[f.name]) if f.name in new else F.col(f"`{alias}`.`{f.name}`") if keep else F.lit(None)) for f in fields]
            elif kind(x) in ("UpdateStarAction", "InsertStarAction"):
                columns += [(k, f, F.col(f"`{name}`.`{f.name}`")) for f in fields]
        out = []
        for f in fields:
            value = F.lit(None).cast(f.dataType)
            for k, g, v in columns:
                if g.name == f.name:
                    value = F.when(action == k, v.cast(f.dataType)).otherwise(value)
            out.append(value.alias(f"{TARGET}{f.name}"))
        with kept(t, both.select(action.alias(ACTION), ROW, FILE, POSITION, *out).where(F.col(ACTION).isNotNull())) as (rows, _):
            gone = rows.where(F.col(ACTION) < len(matched)).select(ROW, FILE, POSITION)
            if not gone.groupBy(ROW, FILE, POSITION).count().where("count > 1").isEmpty():
                raise ValueError("MERGE: several rows of the source match one row of the target")
            stay = [k for k, x in enumerate([*matched, *fresh]) if kind(x) != "DeleteAction"]
            new = rows.where(F.col(ACTION).isin(stay)).select(*[F.col(f"`{TARGET}{f.name}`").alias(f.name) for f in fields])
            t.append(new, inline=False)
            mark(t, result, gone, gone.count())


def place_of(plan: Any) -> tuple[int, int]:
    o = plan.origin()
    return o.startIndex().get(), o.stopIndex().get() + 1


# -- definitions ----------------------------------------------------------------------------


def column_of(c: Any) -> Column:
    """A column as CREATE TABLE and ADD COLUMN name it. A default is kept as an expression of Spark."""
    name = c.name() if kind(c) == "ColumnDefinition" else c.colName()
    default = option(c.defaultValue() if kind(c) == "ColumnDefinition" else getattr(c, "default")())
    comment = option(c.comment())
    return Column(name, from_spark_type(spark_of(c.dataType())), bool(c.nullable()), {"comment": comment} if comment else {}, default_value=None if default is None else ("spark", default.originalSQL()))


def partition_of(x: Any) -> PartitionColumn:
    m = re.fullmatch(r"(?:(years|months|days|hours|identity)\((.+)\)|bucket\((\d+), (.+)\)|([^()]+))", x.describe())
    if not m:
        raise ValueError(f"unknown partition transform {x.describe()}")
    bare = lambda n: n.strip("`")
    if m[1]:
        return PartitionColumn(bare(m[2]), m[1].removesuffix("s") if m[1] != "identity" else m[1])
    return PartitionColumn(bare(m[4]), f"bucket({m[3]})") if m[3] else PartitionColumn(bare(m[5]))


def create(s: Statement, p: Any) -> None:
    keys = [partition_of(x) for x in items(p.partitioning())]
    s.lake.create_table(named(p.name()), [column_of(c) for c in items(p.columns())], partition_by=keys or None, if_exists="skip" if p.ignoreIfExists() else "fail")


def create_as(s: Statement, p: Any) -> None:
    name = named(p.name())
    if p.ignoreIfExists() and s.lake.has_table(name):
        return
    df, keys = s.part(p.query()), [partition_of(x) for x in items(p.partitioning())]
    with s.lake.transaction() as tx:
        tx.create_table(name, df.schema, partition_by=keys or None).append(df)


def drop(s: Statement, p: Any) -> None:
    if not (p.ifExists() and not s.lake.has_table(named(p.child()))):
        s.lake.get_table(named(p.child())).delete()


def alter(s: Statement, p: Any) -> None:
    """ALTER COLUMN: type, nullability, default, comment."""
    table, _ = s.target(p.table())
    with s.lake.transaction() as tx:
        t = tx.table(table.name)
        for x in items(p.specs()):
            path = tuple(items(x.column().name()))
            if option(x.newDataType()) is not None:
                t.update_column_dtype(path, from_spark_type(spark_of(x.newDataType().get())))
            if option(x.newNullability()) is not None:
                t.update_column_nullability(path, bool(x.newNullability().get()))
            if option(x.newDefaultExpression()) is not None:
                t.update_column_default(path, ("spark", x.newDefaultExpression().get().originalSQL()))
            if x.dropDefault():
                t.update_column_default(path, None)
            if option(x.newComment()) is not None:
                t.add_column_tag(path, "comment", x.newComment().get())


def add_columns(s: Statement, p: Any) -> None:
    table, _ = s.target(p.table())
    with s.lake.transaction() as tx:
        for c in items(p.columnsToAdd()):
            path = option(c.path())
            tx.table(table.name).add_column(column_of(c), parent=tuple(items(path.name())) if path is not None else None)


def drop_columns(s: Statement, p: Any) -> None:
    table, _ = s.target(p.table())
    with s.lake.transaction() as tx:
        for c in items(p.columnsToDrop()):
            tx.table(table.name).remove_column(tuple(items(c.name())))


#: By the class of Spark's plan.
STATEMENTS = {
    "InsertIntoStatement": insert, "DeleteFromTable": delete, "UpdateTable": update, "MergeIntoTable": merge,
    "CreateTable": create, "CreateTableAsSelect": create_as, "DropTable": drop, "AlterColumns": alter, "AddColumns": add_columns, "DropColumns": drop_columns,
    "RenameTable": lambda s, p: s.lake.get_table(named(p.child())).rename(items(p.newName())[-1]),
    "RenameColumn": lambda s, p: s.target(p.table())[0].rename_column(tuple(items(p.column().name())), p.newName()),
    "CreateNamespace": lambda s, p: s.lake.create_schema(items(p.name().multipartIdentifier())[-1], if_exists="skip" if p.ifNotExists() else "fail"),
    "DropNamespace": lambda s, p: None if p.ifExists() and items(p.namespace().multipartIdentifier())[-1] not in s.lake.list_schemas() else s.lake.delete_schema(items(p.namespace().multipartIdentifier())[-1], cascade=bool(p.cascade())),
}
