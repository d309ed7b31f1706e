"""Delimited and JSON-envelope readers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Column with the text of a row that doesn't fit its schema, and column with the file it is from.
RESCUED, SOURCE = "_rescued", "_source"


def load_delimited(
    spark: SparkSession, path: str, schema: T.StructType, index_column: bool = False,
    multi_line: bool = False, rescued: bool = False, header: bool = True,
) -> DataFrame:
    """Quoted CSV with a ``header`` line, doubled quotes inside quotes and, optionally, a leading
    unnamed index column that is dropped.

    ``multi_line`` allows line breaks inside quotes; such a file cannot be split over tasks.
    With ``rescued`` a row with a value that isn't of its column's type, or with too few or too many
    fields, has its whole text in ``_rescued``, which is null in all other rows, and every row has
    its file in ``_source``. All columns are parsed then, whatever a query asks for, because a row
    is judged by all of them.
    """
    fields = list(schema.fields)
    if index_column:
        fields = [T.StructField("_index", T.StringType()), *fields]
    if rescued:
        fields.append(T.StructField(RESCUED, T.StringType()))
    reader = spark.read.schema(T.StructType(fields))
    if rescued:
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=RESCUED, columnPruning="false")
    rows = (
        reader
        .option("header", header).option("quote", '"').option("escape", '"')
        .option("enforceSchema", True).option("multiLine", multi_line)
        .csv(path)
    )
    if rescued:
        # values are only looked at where a query asks for them: this condition, never met, asks for all
        named = [F.col(f"`{name}`") for name in schema.names]
        text = F.coalesce(F.col(RESCUED), F.when(reduce(or_, [c != c for c in named]), F.lit("")))
        rows = rows.select(*[f.name for f in fields[:-1]], text.alias(RESCUED), F.col("_metadata.file_path").alias(SOURCE))
    return rows.drop("_index") if index_column else rows


def load_json_envelope(
    spark: SparkSession, path: str, row_schema: T.StructType, array_field: str = "value",
    multi_line: bool = True,
) -> DataFrame:
    """One row per element of the array inside a JSON envelope.

    A pretty-printed export is one document per file (``multi_line``); files are read in
    parallel. Exports with one envelope per line split within files too: ``multi_line=False``.
    """
    envelope = T.StructType([T.StructField(array_field, T.ArrayType(row_schema))])
    documents = spark.read.schema(envelope).option("multiLine", multi_line).json(path)
    return documents.select(F.explode(array_field).alias("_row")).select("_row.*")


def load_pretty_envelope(
    spark: SparkSession, path: str, row_schema: T.StructType, array_field: str = "value", indent: str | None = None
) -> DataFrame:
    """One row per element of the array inside a JSON envelope that is printed over many lines, each
    element from a line with ``indent`` and ``{`` to a line with ``indent`` and ``}``.

    Line breaks inside JSON texts are escaped, so a line break, the indent and ``}`` end an element
    wherever they stand. With that as separator of records one file is read by many tasks, each from
    its own byte range. ``indent`` is that of the first such line unless it is given. What stands
    between two elements is checked: another layout (elements on one line, empty ones, a second
    array) is an error, never a lost row; ``load_json_envelope`` reads those. No files give no row.
    """
    if indent is None:
        first = spark.read.text(path).where(F.col("value").rlike(r"^\s+\{\s*$")).limit(1).collect()
        indent = first[0][0].split("{")[0] if first else "    "
    begin, end = f"\n{indent}{{", f"\n{indent}}}"
    parts = F.split(F.col("value"), rf"\r?\Q{begin}\E(?=\s)", 2)
    records = spark.read.option("lineSep", end).text(path).select(
        F.trim(F.translate(parts[0], "\r\n\t", "   ")).alias("_head"), F.get(parts, F.lit(1)).alias("_body")
    )
    opening = rf'^\{{(?s:.*)"\Q{array_field}\E"\s*:\s*\[$'
    between = (F.col("_head") == ",") | F.col("_head").rlike(opening)
    after = F.col("_head").startswith("]") | (F.col("_head") == "") | F.col("_head").rlike(r"\[\s*\]")
    wrong = F.raise_error(F.concat(F.lit("not an envelope of this layout, near: "), F.substring("_head", 1, 200)))
    element = F.when(F.col("_body").isNotNull() & between, F.concat(F.lit("{"), F.col("_body"), F.lit("}"))).when(
        F.col("_body").isNull() & after, F.lit(None).cast("string")
    ).otherwise(wrong.cast("string"))
    texts = records.select(element.alias("_text")).where(F.col("_text").isNotNull())
    return texts.select(F.from_json("_text", row_schema).alias("_row")).select("_row.*")
