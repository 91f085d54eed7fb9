"""Column expressions that clean raw cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(cell: Column) -> Column:
    """Number of a cell with spaces, apostrophes and either decimal sign; null if there is none.

    With both signs the last one is the decimal sign; a sign that repeats groups digits; a single comma is a decimal sign.
    """

    def plain(bare: Column) -> Column:
        no_comma, no_dot = F.replace(bare, F.lit(","), F.lit("")), F.replace(bare, F.lit("."), F.lit(""))
        dot, comma = F.length(bare) - F.length(no_dot), F.length(bare) - F.length(no_comma)
        dot_is_last = F.instr(F.reverse(bare), ".") < F.instr(F.reverse(bare), ",")
        return (
            F.when((dot > 0) & (comma > 0), F.when(dot_is_last, no_comma).otherwise(F.replace(no_dot, F.lit(","), F.lit("."))))
            .when(comma == 1, F.replace(bare, F.lit(","), F.lit(".")))
            .when(comma > 1, no_comma)
            .when(dot > 1, no_dot)
            .otherwise(bare)
        )

    def number(text: Column) -> Column:
        return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))

    # each step names its result as an array item, so that it is computed once
    steps = F.transform(F.array(F.regexp_replace(F.trim(cell), r"[\s'’ ]", "")), plain)
    return F.transform(steps, number)[0]


def clean_time(cell: Column, unit: str) -> Column:
    """Epoch milliseconds of an ISO text (UTC where it names no zone), of seconds or of milliseconds; null if it is none."""
    if unit == "iso":
        text = F.replace(F.trim(cell), F.lit("T"), F.lit(" "))
        stamp = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"), text.try_cast("timestamp"))
        return F.unix_millis(stamp).cast("double")
    value = clean_number(cell)
    return value * 1000 if unit == "s" else value


def shape(cell: Column) -> Column:
    """Letters as A, digits as 9, blanks as one space: runs of each are one character."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(cell, r"\p{L}+", "A"), r"\p{N}+", "9"), r"\s+", " ")


def compatible(text: Column) -> Column:
    """The text in Unicode's compatibility form (NFKC), in Arrow batches."""

    def nfkc(texts):
        import unicodedata

        import pyarrow as pa

        return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(nfkc, "string")(text)


def normalize(text: Column) -> Column:
    """Lower case, compatibility form, straight quotes, single spaces."""
    quotes = F.regexp_replace(F.regexp_replace(compatible(F.lower(text)), "[‘’‚′]", "'"), "[“”„″]", '"')
    return F.trim(F.regexp_replace(quotes, r"\s+", " "))
