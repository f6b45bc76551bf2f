"""Delimited files read as text only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.records import headers_of, names_in, quoted_records

BAD_RECORD = "_bad_record"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{_quoted(f.name)} string" for f in schema)


def header_names(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line of a file, trimmed and unquoted."""
    headers = headers_of(spark, path)
    if not headers:
        raise ValueError(f"no header line in {path}")
    return names_in(next(iter(headers.values())))


def _by_header(spark: SparkSession, paths: str | list[str]) -> dict[tuple[tuple[str, ...], bool], list[str]]:
    """Files by their header, and by whether it ends with \\r\\n. Names and first lines of the files reach the
    driver, nothing else is read."""
    headers = headers_of(spark, paths)
    if not headers:
        raise ValueError(f"no files in {paths}")
    grouped: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for file, header in headers.items():
        names = tuple(names_in(header))
        if not names:
            raise ValueError(f"no header line in {file}")
        grouped.setdefault((names, header.endswith("\r")), []).append(file)
    return grouped


_CSV = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": BAD_RECORD,
    "quote": '"',
    "escape": '"',
    # an unquoted empty field is NULL, a quoted one is an empty text
    "nullValue": "\x00",
}


def _lines(spark: SparkSession, paths: str | list[str], quoted_newlines: bool) -> DataFrame:
    """All files with their columns by name, in the order of the first file; all must have the same names."""
    headers = _by_header(spark, paths)
    order = list(next(iter(headers))[0])
    parts = []
    for (names, returns), files in headers.items():
        if sorted(names) != sorted(order):
            raise ValueError(f"columns of {files[0]} are {sorted(names)}, those of other files {sorted(order)}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_RECORD]])
        if quoted_newlines:
            # parsed behind inline, once per record: a filter on the result would repeat a parse in a projection
            parsed = F.from_csv("record", _ddl(schema), _CSV)
            lines = quoted_records(spark, files, returns).select("record", F.inline_outer(F.array(parsed)))
            lines = lines.withColumn(BAD_RECORD, F.when(F.col("record").isNull(), "").otherwise(F.col(BAD_RECORD)))
        else:
            # all columns are parsed, or rows with too many or too few fields would go unnoticed
            reader = spark.read.schema(schema).options(**_CSV).option("header", True).option("enforceSchema", True)
            lines = reader.option("columnPruning", False).csv(files)
        parts.append(lines.select(*[_quoted(n) for n in order], BAD_RECORD))
    return reduce(DataFrame.unionByName, parts)


def _count_bad(lines: DataFrame) -> int:
    return lines.agg(F.count_if(F.col(BAD_RECORD).isNotNull()), F.count(_quoted(lines.columns[0]))).first()[0]


def count_bad_records(spark: SparkSession, path: str | list[str], quoted_newlines: bool = True) -> int:
    """Rows whose number of fields differs from the header's."""
    return _count_bad(_lines(spark, path, quoted_newlines))


def read_all_string(
    spark: SparkSession, path: str | list[str], max_bad: int = 100, quoted_newlines: bool = True
) -> DataFrame:
    """All columns as text, headers skipped, malformed rows left out; more than ``max_bad`` is an error.

    Files may have their columns in different orders: each is read by its own header. The files are parsed
    here to count malformed rows and again where the result is used; ``read_and_observe`` parses once.

    Files are split whatever their size. Where fields may hold line breaks, a pass over the splits first finds
    where records begin (``records``); files without such fields need none with ``quoted_newlines=False``.
    """
    lines = _lines(spark, path, quoted_newlines)
    require_few(_count_bad(lines), max_bad)
    return lines.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD)


def read_and_observe(spark: SparkSession, path: str | list[str], quoted_newlines: bool = True) -> tuple[DataFrame, Observation]:
    """As ``read_all_string``, but the files are parsed once only.

    Malformed rows are counted while the result is first written; ``observation.get["bad"]`` then
    holds their number, for ``require_few``.
    """
    counted = Observation()
    lines = _lines(spark, path, quoted_newlines).observe(counted, F.count_if(F.col(BAD_RECORD).isNotNull()).alias("bad"))
    return lines.filter(F.col(BAD_RECORD).isNull()).drop(BAD_RECORD), counted


def require_few(bad: int, max_bad: int) -> None:
    if bad > max_bad:
        raise ValueError(f"{bad} malformed rows, at most {max_bad} allowed")
