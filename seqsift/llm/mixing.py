"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Workspace, as_rows, part

SEED = "mix-1"
ALPHA = 0.5


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5, the same on every machine and run."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", total: float | None = None, alpha: float = ALPHA, seed: str = SEED) -> DataFrame:
    """Replicates documents so that sources come in target proportions, in a random global order.

    A source with weight w (a share of all weights) and n documents gets the mean repetition rate w * total / n;
    each of its documents comes k times, k from the Poisson distribution with that mean, inverted at a number hashed
    from ``seed`` and the id. ``targets`` maps sources to weights, those not named get none; without it weights are
    n ** alpha (1: as they are, 0: all alike). ``total`` is the expected number of rows, else as many as there are
    documents. Columns of ``docs`` stay, whatever they are called; copy_no (from 1) and shuffle_key (the order) are
    added, and replace columns of these names.

    A null source is a source of its own, named "" in ``targets``, and is not the source "". Rows with a null id or
    repeated ids draw alike for one id, and their copies of one number stand side by side in no fixed order. An empty table, or weights that are all 0, give an empty result.
    Counts per source are summed before they are shuffled; the rates are written to the shared folder, and Spark
    broadcasts them only if that table is small, so texts are shuffled once. Otherwise a hot source is a skewed join,
    which AQE splits.
    """
    docs = docs.drop("copy_no", "shuffle_key")
    rows = as_rows(docs)
    source = part(source_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))
    counts = rows.groupBy(key.alias("__mix"), source.alias("__source")).agg(F.count("*").cast("double").alias("__n"))
    if targets is None:
        weight = F.pow("__n", F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            if w < 0:
                raise ValueError("a weight is not negative")
            weight = F.when(F.coalesce(F.col("__source"), F.lit("")) == name, float(w)).otherwise(weight)
    weighed = counts.withColumn("__w", weight)
    sums = weighed.agg(F.sum("__w").alias("__all"), (F.lit(float(total)) if total is not None else F.sum("__n")).alias("__total"))
    rate = F.try_divide(F.col("__w") * F.col("__total"), F.col("__all") * F.col("__n"))
    # P(k) = P(k - 1) * rate / k, in logarithms as exp(-rate) may be too small; far enough that the rest is below 2**-53.
    last = F.ceil(F.col("__rate") + 12 * F.sqrt("__rate") + 30).cast("int")
    terms = F.aggregate(F.sequence(F.lit(1), last), F.array(-F.col("__rate")), lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + F.log(F.col("__rate")) - F.log(k.cast("double")))))
    cdf = F.aggregate(F.transform(terms, F.exp), F.array().cast("array<double>"), lambda a, p: F.concat(a, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), a), -1), F.lit(0.0)) + p)))
    # One row of sums: a broadcast of fixed size.
    rates = weighed.crossJoin(F.broadcast(sums)).withColumn("__rate", rate).where("__rate > 0").select("__mix", cdf.alias("__cdf"))
    rates = Workspace(docs.sparkSession, "mix").table(rates)  # written, so that Spark knows its size before it plans the join
    id_text = F.coalesce(part(id_col).cast("string"), F.lit(""))
    drawn = rows.withColumn("__mix", key).join(rates, "__mix").select("row", "__cdf", _uniform(F.lit(seed), id_text).alias("__u"))
    k = F.size(F.filter("__cdf", lambda c: c < F.col("__u")))
    copies = drawn.select("row", k.alias("__k")).where("__k > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__k"))).alias("copy_no"))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), id_text, F.col("copy_no").cast("string")))
    # Keys are spread evenly, so equal ranges of their first 32 bits are equal parts: nothing is sampled, texts are read once.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long") * n / float(1 << 32)).cast("int")
    ordered = copies.withColumn("shuffle_key", order).repartitionById(n, place).sortWithinPartitions("shuffle_key")
    return ordered.select("row.*", "copy_no", "shuffle_key")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighted by the square root of their size; nulls, ties and repeats as in :func:`mix_sources`."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
WITH RECURSIVE n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, 0.5) * (SELECT sum(n) FROM n) / ((SELECT sum(pow(n, 0.5)) FROM n) * n) AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, -rate AS lp, exp(-rate) AS cdf FROM r
      UNION ALL SELECT source, rate, k + 1, lp + ln(rate) - ln(k + 1), cdf + exp(lp + ln(rate) - ln(k + 1)) FROM c WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (SELECT *, (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM documents),
k AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf < u.u) AS k FROM u),
x AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, k + 1))::INT AS copy_no FROM k)
SELECT *, md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no) AS shuffle_key FROM x
"""
