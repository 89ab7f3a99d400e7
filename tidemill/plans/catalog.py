"""How a plan module registers its queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings loss loss_lines loss_file_records tasks task_events jobs executions "
          "request_log consolidation_log hosts doc_labels subjects context_windows").split()


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name, with its SQL twin if there is one."""

        def register(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return register

    def relational(self, name: str, sql: str, spark_sql: str | None = None) -> None:
        """A purely relational query: one statement that Catalyst plans, and the twin for the other engine."""
        text = spark_sql or sql

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return statement(spark, sf_dir, text)

        run.__name__ = name
        self.queries[name] = run
        self.sql[name] = sql


def statement(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run a statement over the tables it names; frames are passed in, so no view is left behind in the session."""
    used = [n for n in _NAMES if re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    for n in [*used, *frames]:
        text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s+){n}\b(?!\s*\.)", rf"\g<1>{{{n}}}", text)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in used}, **frames)
