"""Places of regular expressions as Columns: no Python touches the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,hit:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


#: Spans that are gathered before they are put to the rest, so that many of them aren't copied for each one more.
_BLOCK = 128


def regex_spans(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, hit>>: leftmost matches that don't overlap, in code points, end exclusive.

    What lies before each match and the matches themselves add up to the places. A pattern must not match nothing.
    """
    # There is one gap more than there are hits: the last pair has none. Both are worked out once.
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    start = F.struct(F.array().cast(f"array<{SPANS}>").alias("done"), no_spans().alias("own"), F.lit(0).alias("at"))

    def add(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["hit"])
        span, full = F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))), F.size(a["own"]) >= _BLOCK
        longer = F.struct(F.when(full, F.concat(a["done"], F.array(a["own"]))).otherwise(a["done"]).alias("done"), F.when(full, span).otherwise(F.concat(a["own"], span)).alias("own"), end.alias("at"))
        return F.when(x["hit"].isNull(), a).otherwise(longer)

    return F.aggregate(pairs, start, add, lambda a: F.concat(F.flatten(a["done"]), a["own"]))
