"""Queries over source trees that are planted for every part: operators on text, run at the size of the tables.

A case has template rows, with ``{k}`` in their strings, and the rows that the operator
must give for them. Both are stamped with the key of each row of ``part``: the operator
runs over all stamped rows at once, and the SQL stamps the expected ones. The templates
are a few rows, so they are broadcast to the keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .domain import Domain
from .queries import ORACLE, QUERIES, _with_checkpoints

Rows = Sequence[tuple]

#: Stamped rows of one task while there are few tasks, and of any task.
ROWS_A_TASK, MOST_ROWS = 20_000, 160_000
#: Characters of the stamped templates of one task: long texts take as long in fewer rows.
TEXT_A_TASK, MOST_TEXT = 4 << 20, 32 << 20
#: Tasks a core from which on tasks grow instead of their number: each has a cost of its own in every exchange.
TASKS_A_CORE = 4

#: Cases of ``once`` and the rows that they must give, for the tests.
CASES: dict[str, Callable[..., DataFrame]] = {}
CASE_SQL: dict[str, str] = {}


def _stamp(value: Column, kind: T.DataType) -> Column:
    """A template's value with the key in all strings that it holds."""
    if isinstance(kind, T.StringType):
        return F.replace(value, F.lit("{k}"), F.col("__k"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: _stamp(v, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, _: _stamp(k, kind.keyType)), lambda _, v: _stamp(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_stamp(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def _tasks(rows: int, text: int, enough: int) -> int:
    """Tasks for so many stamped rows and characters: small ones up to ``enough``, then as many as their greatest size asks for."""
    small = max(1, math.ceil(rows / ROWS_A_TASK), math.ceil(text / TEXT_A_TASK))
    return min(small, max(enough, math.ceil(rows / MOST_ROWS), math.ceil(text / MOST_TEXT)))


def stamped(d: Domain, schema: str, rows: Rows) -> DataFrame:
    """The template rows for every part.

    The keys are few bytes, what they are stamped on is not: so they are dealt out, ROWS_A_TASK stamped rows or TEXT_A_TASK of text to a task, or, beyond
    TASKS_A_CORE, up to MOST_ROWS or MOST_TEXT, and the rows are a product of keys and templates. An explode would leave Spark's estimate at the size of the keys, and
    tables of any size would be broadcast by it; the size of a product is not told beforehand, so that joins go by measured sizes.
    """
    kind = T.StructType.fromDDL(schema)
    templates = d.spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], kind).coalesce(1)
    keys = d.table("part").select(F.col("p_partkey").cast("string").alias("__k"))
    n = keys.count()
    dealt = keys.repartition(_tasks(n * len(rows), n * len(repr(rows)), TASKS_A_CORE * d.spark.sparkContext.defaultParallelism))
    row = F.struct(*[_stamp(F.col(f.name), f.dataType).alias(f.name) for f in kind])
    # by an explode of one row each value is stamped once, however often it is read above
    return dealt.crossJoin(F.broadcast(templates)).select(F.explode(F.array(row)).alias("r")).select("r.*")


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    if isinstance(value, int):
        return f"{value}::BIGINT"
    text = value.replace("'", "''")
    return f"replace('{text}', '{{k}}', p_partkey::VARCHAR)" if "{k}" in value else f"'{text}'"


def expected_sql(columns: Sequence[str], rows: Rows) -> str:
    each = [", ".join(f"{_sql_literal(v)} AS {c}" for c, v in zip(columns, r, strict=True)) for r in rows]
    return " UNION ALL ".join(f"SELECT {e} FROM part" for e in each)


def planted(name: str, tables: dict[str, tuple[str, Rows]], run: Callable[..., DataFrame], columns: str, want: Rows) -> None:
    """Registers a query: ``run`` of the stamped tables, by name, gives the stamped ``want`` rows under ``columns``."""
    names = columns.split()

    def query(spark, sf_dir: str) -> DataFrame:
        d = Domain(spark, sf_dir)
        return run(**{t: stamped(d, schema, rows) for t, (schema, rows) in tables.items()}).select(*names)

    query.__name__ = name
    QUERIES[name] = _with_checkpoints(query)
    ORACLE[name] = expected_sql(names, want)


def once(name: str, tables: dict[str, tuple[str, Rows]], run: Callable[..., DataFrame], columns: str, want: Rows) -> None:
    """As ``planted``, for operators whose result is over the whole input (a total, a top list): the rows stand once, unstamped.

    Such a case reads no table, so it is a test and no query.
    """
    names = columns.split()

    def query(spark, sf_dir: str) -> DataFrame:
        made = {t: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema) for t, (schema, rows) in tables.items()}
        return run(**made).select(*names)

    query.__name__ = name
    CASES[name] = _with_checkpoints(query)
    each = [", ".join(f"{_sql_literal(v)} AS {c}" for c, v in zip(names, r, strict=True)) for r in want]
    CASE_SQL[name] = " UNION ALL ".join(f"SELECT {e}" for e in each)
