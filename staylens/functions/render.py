"""Text lines built from columns with printf-style templates.

A template is a format string plus arguments ``(kind, column)``; kind is
``s`` (text), ``d`` (integer) or ``fN`` (number with N decimals, rounded half
up).  The same template renders to a Spark ``format_string`` column and,
for the SQL oracle, to a DuckDB ``printf`` expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.functions.columns import fixed


@dataclass(frozen=True)
class Line:
    fmt: str
    args: tuple = ()


def L(fmt: str, *args) -> Line:  # noqa: N802
    return Line(fmt, tuple(args))


def _spark_arg(kind: str, col: str) -> Column:
    c = F.col(col)
    if kind == "s":
        return F.coalesce(c.cast("string"), F.lit("None"))
    if kind == "d":
        return F.coalesce(c.cast("long").cast("string"), F.lit("None"))
    return F.coalesce(fixed(c, int(kind[1:])), F.lit("None"))


def _sql_arg(kind: str, col: str) -> str:
    if kind == "s":
        return f"COALESCE(CAST({col} AS VARCHAR), 'None')"
    if kind == "d":
        return f"COALESCE(CAST(CAST({col} AS BIGINT) AS VARCHAR), 'None')"
    d = int(kind[1:])
    scale = float(10 ** d)
    return (f"COALESCE(printf('%.{d}f', floor(CAST({col} AS DOUBLE) * {scale} + 0.5) / {scale}),"
            f" 'None')")


def _fmt_s(fmt: str) -> str:
    # every argument is pre-formatted text
    return fmt.replace("%d", "%s")


def spark_line(line: Line) -> Column:
    if not line.args:
        return F.lit(line.fmt)
    return F.format_string(_fmt_s(line.fmt), *[_spark_arg(k, c) for k, c in line.args])


def sql_line(line: Line) -> str:
    fmt = _fmt_s(line.fmt).replace("'", "''")
    if not line.args:
        return f"'{fmt}'"
    return f"printf('{fmt}', {', '.join(_sql_arg(k, c) for k, c in line.args)})"


def spark_text(lines) -> Column:
    return F.concat(*[spark_line(x) for x in lines])


def sql_text(lines) -> str:
    return "(" + " || ".join(sql_line(x) for x in lines) + ")"
