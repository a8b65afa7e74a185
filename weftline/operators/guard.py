"""Ad-hoc reading: SQL over registered views that may only read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The nodes that the parser makes of a query. Anything else is refused: writes, commands, scripts, what a later version adds.
QUERY_NODES = frozenset(
    """Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit Offset Tail Distinct Union Intersect Except Window Generate Sample Expand Pivot Unpivot Transpose
    OneRowRelation UnresolvedRelation UnresolvedInlineTable LocalRelation UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedHint
    UnresolvedWith WithWindowDefinition SubqueryAlias View AliasedRelation GroupingSets UnresolvedPivot UnresolvedUnpivot UnresolvedOrderBy Range PipeOperator UnresolvedTableArgPlanId""".split()
)
#: Functions that run code of any kind.
REFUSED_FUNCTIONS = frozenset(("reflect", "java_method", "try_reflect"))


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def refusal(spark: SparkSession, sql: str) -> str | None:
    """Why a statement is not a plain query; None if it is one.

    The parsed plan decides, not words in the text, so a string that says DROP is fine.
    All plans are walked: children, common table expressions and subqueries in expressions.
    """
    plans, expressions = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)], []
    while plans or expressions:
        if plans:
            p = plans.pop()
            kind = p.getClass().getSimpleName().rstrip("$")
            if kind not in QUERY_NODES:
                return kind
            plans += [x for x in (*_seq(p.children()), *_seq(p.innerChildren())) if "plans.logical" in x.getClass().getName() or "analysis" in x.getClass().getName()]
            expressions += _seq(p.expressions())
            continue
        e = expressions.pop()
        kind = e.getClass().getSimpleName()
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "InSubquery", "UnresolvedTableArg", "FunctionTableSubqueryArgumentExpression"):
            plans += [e.plan()] if kind != "InSubquery" else []
            expressions += [e.query()] if kind == "InSubquery" else []
        if kind == "UnresolvedFunction":
            name = _seq(e.nameParts())[-1].lower()
            if name in REFUSED_FUNCTIONS:
                return f"function {name}"
        expressions += _seq(e.children())
    return None


def read_only_sql(spark: SparkSession, sql: str) -> DataFrame:
    """The query's rows; PermissionError for anything that is not a plain query."""
    why = refusal(spark, sql)
    if why:
        raise PermissionError(f"only queries are allowed here, not {why}")
    return spark.sql(sql)
