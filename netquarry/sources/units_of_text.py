"""Formats read unit by unit: a pure parser turns one file, cell or module into records, an Arrow-batched UDF runs it over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_with(parser: Callable[[str], dict], schema: str, text: str | Column = "text") -> Column:
    """struct(<schema>, error): the records of one text; a structural failure is told in error, and its records are null."""
    first = schema.strip()

    @F.udf(f"struct<{first},error:string>", useArrow=True)
    def run(t):
        try:
            return parser(t or "") | {"error": None}
        except ValueError as e:
            return {"error": str(e)}

    return run(text)


def scan(files: DataFrame, parser: Callable[[str], dict], schema: str) -> DataFrame:
    """files (src_id, text) -> src_id and the columns of schema and error, one row a file."""
    return files.select("src_id", parse_with(parser, schema).alias("p")).select("src_id", "p.*")


def table(parsed: DataFrame, column: str) -> DataFrame:
    """src_id, ord and the fields of one array of records."""
    return parsed.select("src_id", F.posexplode(column).alias("ord", "r")).select("src_id", "ord", "r.*")


def check(parsed: DataFrame) -> None:
    """Raises if files failed, telling how many did, and the first one's error."""
    bad = parsed.filter("error is not null").agg(F.count("*").alias("n"), F.min(F.struct("src_id", "error")).alias("first")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} of the files failed; source {bad['first']['src_id']}: {bad['first']['error']}")
