"""Text-to-value cleaning of ERP exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalize_null_tokens(df: DataFrame, token: str = "None") -> DataFrame:
    """The text ``token`` becomes NULL in every string column."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.nullif(F.col(f"`{c}`"), F.lit(token)).alias(c) if c in texts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listed columns to double; text that is no decimal number becomes NULL."""
    return df.withColumns({c: decimal_number(F.col(c)) for c in columns})


# Characters of a decimal number and the blanks around it.
_DECIMAL = "0123456789+-.eE \t\n\x0b\f\r"


def decimal_number(text: Column, target: T.DataType | str = "double") -> Column:
    """A column's number. Text that is no decimal number becomes NULL: a cast alone would take type
    suffixes, hexadecimal forms, ``nan`` and ``inf`` for numbers. Infinite results are NULL too.

    Whatever a cast reads that has only characters of a decimal number is one; that takes a fifth of
    the time of a regular expression.
    """
    value = text.try_cast("double")
    others = F.translate(text.cast("string"), _DECIMAL, "")
    value = F.when((F.abs(value) < float("inf")) & (others == ""), value)
    return value if target == "double" else value.try_cast(target)


def normalize_dmy_date(column: Column | str) -> Column:
    """``d/m/yy``, ``d/m/yyy`` and ``d/m/yyyy`` to ``dd/mm/yyyy``; other text is kept.

    The text is split once: the parts are bound by the lambda of a one-element array.
    """
    text = F.col(column) if isinstance(column, str) else column

    def two(part: Column) -> Column:
        return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)

    def four(part: Column) -> Column:
        return F.when(F.length(part) == 2, F.concat(F.lit("20"), part)).when(
            F.length(part) == 3, F.concat(F.lit("2"), part)
        ).otherwise(part)

    def rebuilt(parts: Column) -> Column:
        whole = F.concat(two(parts[0]), F.lit("/"), two(parts[1]), F.lit("/"), four(parts[2]))
        return F.when(F.size(parts) == 3, whole).otherwise(F.array_join(parts, "/"))

    return F.transform(F.array(F.split(text, "/")), rebuilt)[0]


def parse_date_or_null(column: Column | str, pattern: str = "d/M/yyyy") -> Column:
    """Date of a text in ``pattern``, NULL where it does not fit."""
    text = F.col(column) if isinstance(column, str) else column
    return F.try_to_date(text, pattern)


def reformat_date(
    column: Column | str, pattern: str = "d/M/yyyy", target: str = "dd-MM-yyyy"
) -> Column:
    """Text of the parsed date in another pattern; unparsable becomes NULL."""
    return F.date_format(parse_date_or_null(column, pattern), target)


# A whole number: optional blanks around it, a plus sign or the minus sign of a zero (both
# dropped) or a minus sign (kept), leading zeros, digits, a zero fraction.
_WHOLE_NUMBER = r"^\s*(?:\+|-(?=0+(?:\.0+)?\s*$)|(-))?0*([0-9]+)(?:\.0+)?\s*$"


def normalize_item_code(column: Column, data_type: T.DataType | None = None) -> Column:
    """Canonical item code text.

    NULL gives ``'nan'``. Text holding a whole number gives its shortest integer text, of any
    length. Numbers lose their fraction. Other text is unchanged.
    """
    if isinstance(data_type, T.FractionalType):
        # from 2 ** 53 on a double has no fraction, and its floor would end at the largest long
        whole = F.when(F.abs(column) >= 2.0**53, column.cast("decimal(38,0)")).when(
            column >= 0, F.floor(column).cast("decimal(38,0)")
        ).otherwise(F.ceil(column).cast("decimal(38,0)"))
        text = F.when(F.abs(column) < 1e38, whole.cast("string")).otherwise(column.cast("string"))
        return F.when(column.isNull() | F.isnan(column.cast("double")), F.lit("nan")).otherwise(text)
    integer = F.regexp_replace(column.cast("string"), F.lit(_WHOLE_NUMBER), F.lit("$1$2"))
    return F.coalesce(integer, F.lit("nan"))


def clean_amount(column: Column | str) -> Column:
    """Number inside money or percent text."""
    return decimal_number(F.translate(column, ",₪%", ""))
