"""Outside tools as table functions: a query in, what each tool says out.

A tool is any function from a query to a text.  ``register`` makes a set of tools a table function for SQL, to be
called on a table of queries:

    SELECT * FROM ask(TABLE(SELECT item_id, text FROM benchmark), 'text', 2)

The function is polymorphic: its rows are the columns of the given table with ``tool``, ``ok`` and ``answer``.  It names the
column that it partitions by, so all rows of one query text meet in one task and a tool is asked once for each.  At most ``MAX_CALLS``
tools (or fewer, by the third argument) are asked; an answer is cut to ``MAX_BYTES`` of UTF-8 at a character; a tool that
fails gives ``ok`` false and the reason, and an empty answer counts as none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

MAX_CALLS, MAX_BYTES = 4, 5000
FAILED = "调用失败："


def cut_utf8(text: str, most: int = MAX_BYTES) -> str:
    """The longest beginning of whole characters that fits."""
    return text.encode("utf-8", "replace")[:most].decode("utf-8", "ignore")


def call(tool: Callable[[str], str | None], query: str) -> tuple[bool, str]:
    try:
        answer = cut_utf8(tool(query) or "")
        return bool(answer), answer
    except Exception as e:  # whatever a tool raises is its answer
        return False, cut_utf8(f"{FAILED}{e}")


def table_function(tools: dict[str, Callable[[str], str | None]]):
    """The table function of some tools, in their order."""

    class Ask:
        @staticmethod
        def analyze(queries: AnalyzeArgument, column: AnalyzeArgument, calls: AnalyzeArgument) -> AnalyzeResult:
            if not queries.isTable:
                raise ValueError("the first argument is a table: ask(TABLE(...), 'column', calls)")
            if not (column.isConstantExpression and calls.isConstantExpression) or column.value not in queries.dataType.names:
                raise ValueError("the second argument names a column of the table, the third is a number of tools")
            schema = T.StructType([*queries.dataType.fields, T.StructField("tool", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("answer", T.StringType())])
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(f"`{column.value}`")])

        def __init__(self):
            self.query, self.answers = None, None

        def eval(self, row, column, calls):
            query = row[column]
            if query is None:
                return
            if self.answers is None or query != self.query:
                asked = list(tools.items())[: max(0, min(calls, MAX_CALLS))]
                self.query, self.answers = query, [(name, *call(tool, query)) for name, tool in asked]
            for answer in self.answers:
                yield (*row, *answer)

    return F.udtf(Ask)


def register(spark: SparkSession, name: str, tools: dict[str, Callable[[str], str | None]]) -> None:
    """Make the tools a table function of that name in SQL."""
    spark.udtf.register(name, table_function(tools))
