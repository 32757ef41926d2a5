"""Delimited tables of unknown types: a strings-only read, then types by one aggregation over all columns."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.scratch import path as scratch_path

# The delimiters looked for, and the tokens that stand for a missing value.
DELIMITERS = ",\t;|"
MISSING = ("", "NA", "N/A", "NaN", "nan", "NULL", "null", "None", "n/a", "#N/A", "<NA>")

_LONG = r"^[+-]?[0-9]{1,19}$"
_DOUBLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_MORE = "_more"


def sniff(sample: str, default: str) -> str:
    """Delimiter of a table's first 4,096 characters, the default where none shows."""
    try:
        return csv.Sniffer().sniff(sample[:4096], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return default


def _as(kind: str, v: Column) -> Column:
    """The value of a cell as a kind, null where it is none."""
    if kind == "long":
        return F.when(v.rlike(_LONG), v.try_cast("long"))
    if kind == "double":
        return F.when(v.rlike(_DOUBLE), v.try_cast("double"))
    if kind == "boolean":
        return F.when(v.isin("True", "TRUE", "true"), True).when(v.isin("False", "FALSE", "false"), False)
    if kind == "date":
        return F.when(v.rlike(_DATE), v.try_cast("date"))
    return v


#: From the narrowest: a column has the first kind that all its cells have.
KINDS = ("long", "double", "boolean", "date", "string")


def typed(cells: DataFrame, missing: tuple[str, ...] = MISSING) -> DataFrame:
    """A table of strings with missing tokens null and each column of the narrowest kind that fits all its cells.

    Which kinds fit is one aggregation over the whole table; a column without a cell stays text.
    """
    names = cells.columns
    of = {c: F.when(~F.trim(F.col(f"`{c}`")).isin(*missing), F.trim(F.col(f"`{c}`"))) for c in names}
    fits = [F.count_if(of[c].isNotNull() & _as(k, of[c]).isNull()).alias(f"{i}_{k}") for i, c in enumerate(names) for k in KINDS[:-1]]
    got = cells.agg(*fits, *[F.count(of[c]).alias(f"{i}_n") for i, c in enumerate(names)]).first()  # one row
    kinds = [next(k for k in KINDS if k == "string" or not got[f"{i}_{k}"]) if got[f"{i}_n"] else "string" for i in range(len(names))]
    text = {c: F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")) for c in names}
    return cells.select(*[(text[c] if k == "string" else _as(k, of[c])).alias(c) for c, k in zip(names, kinds, strict=True)])


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, default: str = ",", missing: tuple[str, ...] = MISSING) -> DataFrame:
    """The table of a delimited file with a header, line ends within quotes allowed; delimiter None: sniffed.

    A row with more fields than the header is an error when it is read, a shorter one ends in nulls, an empty line is no
    row. A repeated or empty name gets its place in the header. A file without a header is an error.
    """
    head = spark.read.text(path, wholetext=False).limit(20).collect()  # the sniffer's sample
    if delimiter is None:
        delimiter = sniff("\n".join(r.value for r in head), default)
    reader = spark.read.option("sep", delimiter).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    first = reader.csv(path).limit(1).collect()
    if not first or all(v is None for v in first[0]):
        raise ValueError("no columns")
    names: list[str] = []
    for i, v in enumerate(first[0]):
        names.append(f"{v or 'column'}_{i}" if not v or v in names else v)
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*names, _MORE])
    rows = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    ragged = F.when(F.col(_MORE).isNotNull(), F.raise_error(F.lit(f"a row has more than {len(names)} fields")).cast("string"))
    rows = rows.select(F.coalesce(ragged, F.col(f"`{names[0].replace('`', '``')}`")).alias(names[0]), *[F.col(f"`{c.replace('`', '``')}`") for c in names[1:]])
    return typed(rows.dropna("all"), missing)


def of_text(spark: SparkSession, raw: str, default: str = ",") -> DataFrame:
    """The table of a text at hand, such as an uploaded file: laid down in the shared folder and read by Spark."""
    if not raw.strip():
        raise ValueError("no columns")
    at = scratch_path(spark, "upload")
    spark.createDataFrame([(raw,)], "value string").coalesce(1).write.text(at)
    return read_table(spark, at, sniff(raw, default))
