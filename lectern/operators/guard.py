"""What a statement of the console may hold: an allow-list over the nodes of the plan that Spark's parser makes.

The words of a statement decide nothing. Its parsed plan is walked, with every query inside it, and each plan node,
each expression and each function has to be on a list. What is on none is refused, known to be harmful or not.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class Refused(ValueError):
    """What the guard says of a statement that it does not let through."""


#: Plan nodes of a query that reads nothing but named tables and runs nothing but expressions.
QUERY_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin", "SubqueryAlias",
    "UnresolvedSubqueryColumnAliases", "UnresolvedWith", "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedHaving", "OneRowRelation", "WithWindowDefinition", "Generate", "Pivot", "Unpivot",
    "LocalRelation",
}
#: Plan nodes of a write, which stand at the top of a plan, or under its WITH.
WRITE_NODES = {"InsertIntoStatement", "UpdateTable", "DeleteFromTable"}
#: Expressions that the parser makes before names are looked up. Resolved ones are those of `EXPRESSIONS`, a package.
UNRESOLVED = {
    "UnresolvedAttribute", "UnresolvedStar", "UnresolvedAlias", "UnresolvedExtractValue", "UnresolvedWindowExpression", "UnresolvedNamedLambdaVariable", "UnresolvedOrdinal", "MultiAlias", "UnresolvedFunction",
    "UnresolvedGenerator", "UnresolvedStarExceptOrReplace", "UnresolvedStarExcept",
}
EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
#: Groups of built-in functions, as Spark's own register names them. Those that call code, read files, or tell of the session are in others.
FUNCTION_GROUPS = {
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "csv_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs",
    "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "url_funcs", "variant_funcs", "window_funcs",
}

#: The option by which the parser says that a relation is written to.
PRIVILEGES = "__required_write_privileges__"


def _items(seq) -> Iterator:
    """The elements of a Scala sequence."""
    for k in range(seq.length()):
        yield seq.apply(k)


def _kind(node) -> tuple[str, str]:
    """(package, name) of a node's class."""
    package, _, name = node.getClass().getName().rpartition(".")
    return package, name.rstrip("$")


class _Walk:
    def __init__(self, spark: SparkSession, allowed: set[str]):
        self.registry = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.allowed = {a.lower() for a in allowed}
        self.read: set[str] = set()

    def relation(self, node, scope: frozenset[str]) -> str:
        parts = [p.lower() for p in _items(node.multipartIdentifier())]
        name = parts[-1]
        if len(parts) == 1 and name in scope:
            return name
        if parts in (["information_schema", "columns"], ["information_schema", "tables"]):
            return name
        if len(parts) == 2 and parts[0] == "public":
            parts = parts[1:]
        given = [k for k in node.options().keySet().toArray() if k != PRIVILEGES]
        if len(parts) > 1 or name not in self.allowed or given or node.isStreaming():
            raise Refused(f"table not allowed: {'.'.join(parts)}")
        self.read.add(name)
        return name

    def function(self, parts: list[str]) -> None:
        info = self.registry.lookupFunction(self.identifier(parts[-1])) if len(parts) == 1 else None
        if info is None or info.isEmpty() or info.get().getGroup() not in FUNCTION_GROUPS:
            raise Refused(f"function not allowed: {'.'.join(parts)}")

    def expression(self, node, scope: frozenset[str]) -> None:
        package, name = _kind(node)
        if name == "UnresolvedFunction":
            self.function(list(_items(node.nameParts())))
        elif name == "UnresolvedGenerator":
            self.function([node.name().funcName()] if node.name().database().isEmpty() else ["", node.name().funcName()])
        elif name not in UNRESOLVED and not package.startswith(EXPRESSIONS):
            raise Refused(f"expression not allowed: {name}")
        if package.startswith(EXPRESSIONS) and name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            self.plan(node.plan(), scope)
        for child in _items(node.children()):
            self.expression(child, scope)

    def plan(self, node, scope: frozenset[str]) -> None:
        """A query, every node of it; `scope` has the names that a WITH around it gives."""
        _, name = _kind(node)
        if name not in QUERY_NODES:
            raise Refused(f"not allowed: {name}")
        if name == "UnresolvedRelation":
            self.relation(node, scope)
            return
        if name == "UnresolvedWith":
            scope = self.named(node, scope)
        for e in _items(node.expressions()):
            self.expression(e, scope)
        if name == "Generate":
            self.expression(node.generator(), scope)
        for child in _items(node.children()):
            self.plan(child, scope)

    def named(self, node, scope: frozenset[str]) -> frozenset[str]:
        """The scope inside a WITH; each of its queries sees those before it, and itself if it may recur."""
        for relation in _items(node.cteRelations()):
            alias, name = relation._2(), relation._1().lower()
            self.plan(alias, scope | {name} if node.allowRecursion() else scope)
            scope |= {name}
        return scope

    def statement(self, node, scope: frozenset[str] = frozenset()) -> tuple[str, str | None]:
        """(read, insert, update or delete, the table that is written to)."""
        _, name = _kind(node)
        if name == "UnresolvedWith":
            return self.statement(node.child(), self.named(node, scope))
        if name not in WRITE_NODES:
            self.plan(node, scope)
            return "read", None
        target = node.table()
        while _kind(target)[1] == "SubqueryAlias":
            target = target.child()
        if _kind(target)[1] != "UnresolvedRelation":
            raise Refused(f"no table to write to: {_kind(target)[1]}")
        into = self.relation(target, frozenset())
        if into not in self.allowed:
            raise Refused(f"not to be written: {into}")
        if name == "InsertIntoStatement":
            if node.overwrite() or not node.partitionSpec().isEmpty():
                raise Refused("an insert adds rows, and no more")
            self.plan(node.query(), scope)
            return "insert", into
        if name == "UpdateTable":
            for assignment in _items(node.assignments()):
                self.expression(assignment.key(), scope)
                self.expression(assignment.value(), scope)
            if node.condition().isEmpty():
                raise Refused("update needs WHERE")
            self.expression(node.condition().get(), scope)
            return "update", into
        self.expression(node.condition(), scope)
        return "delete", into


def inspect(spark: SparkSession, statement: str, allowed: set[str]) -> tuple[str, str | None, set[str], object]:
    """(read, insert, update or delete; the table written to; the tables named; the parsed plan), or `Refused`."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except Exception as e:  # whatever the parser raises
        raise Refused(f"not understood: {str(e).splitlines()[0]}") from None
    walk = _Walk(spark, allowed)
    kind, into = walk.statement(plan)
    return kind, into, walk.read, plan
