"""A table function for SQL: the words of a query."""

from __future__ import annotations

from pyspark.sql import SparkSession


class QueryTerms:
    """Rows (`term`, `kind`, `required`) of a query's leaves: word, phrase part or prefix; not those under NOT."""

    def eval(self, query: str):
        from docquarry.operators.parser import parse

        root = parse(query).root
        for leaf in root.leaves() if root else []:
            for w in leaf.words:
                yield w, leaf.kind, len(leaf.words) > 1


def register(spark: SparkSession, name: str = "query_terms") -> None:
    """Make `SELECT * FROM query_terms('...')` known to a session; join its rows with postings."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(QueryTerms, returnType="term string, kind string, required boolean"))
