"""Checks of analyzed plans: what a read-only query or a row condition may consist of."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Plan nodes of queries. Everything else, such as commands, scripts and sources, is refused.
ALLOWED = {
    "Project", "Filter", "Aggregate", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct",
    "Deduplicate", "Union", "Intersect", "Except", "Window", "SubqueryAlias", "WithCTE", "CTERelationDef",
    "CTERelationRef", "Expand", "Generate", "Pivot", "Unpivot", "LocalRelation", "OneRowRelation", "Range", "Sample",
    "ResolvedHint", "UnresolvedHint", "Repartition", "RepartitionByExpression", "WithWindowDefinition", "Subquery", "UnionLoop", "UnionLoopRef",
}
# Expressions that run code outside the engine.
OUTSIDE = {"CallMethodViaReflection", "TryReflect", "PythonUDF", "ScalaUDF", "StaticInvoke", "Invoke", "ApplyFunctionExpression"}


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _class(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _check_expression(expression, view: str) -> None:
    if _class(expression) in OUTSIDE:
        raise ValueError(f"{expression.prettyName()} is not available here.")
    for child in _items(expression.children()):
        _check_expression(child, view)


def check_plan(plan, view: str, allowed: set[str] = ALLOWED) -> None:
    """Raise ValueError unless the plan reads nothing but the temporary view and runs only query operators."""
    name = _class(plan)
    if name == "View":
        if plan.isTempView() and plan.desc().identifier().table().lower() == view:
            return  # what lies below belongs to the caller
        raise ValueError(f"Only the table '{view}' can be read.")
    if name not in allowed:
        raise ValueError(f"{plan.nodeName()} has no place in a read-only query over '{view}'.")
    for expression in _items(plan.expressions()):
        _check_expression(expression, view)
    for child in [*_items(plan.children()), *_items(plan.subqueries())]:
        check_plan(child, view, allowed)


def check_condition(df: DataFrame) -> None:
    """Raise ValueError if the filter on top of a table's plan holds a query or runs outside code."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.subqueries().size():
        raise ValueError("A condition cannot hold a query.")
    for expression in _items(plan.expressions()):
        _check_expression(expression, "")
