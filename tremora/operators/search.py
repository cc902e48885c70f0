"""Search of words in texts by weighted frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_terms(rows: DataFrame, keys: list[str], text: str, terms: list[str]) -> DataFrame:
    """(*keys, score) of the rows that hold any of the terms: the sum of (1 + ln tf) ln(1 + n / df).

    Only words that are asked for leave the scan, counted within the row, so no index of all words is shuffled.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))

    def times(term: str):
        return F.size(F.filter("__words", lambda w: w == F.lit(term)))

    counts = F.array(*(F.struct(F.lit(t).alias("term"), times(t).alias("tf")) for t in terms))
    found = rows.select(*keys, words.alias("__words")).select(*keys, F.inline(counts)).where("tf > 0")
    known = found.groupBy("term").agg(F.count("*").alias("df"))
    total = rows.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    weights = F.broadcast(
        known.withColumn("one", F.lit(1))
            .join(total, "one")
            .select("term", F.ln(1 + F.col("n") / F.col("df")).alias("weight"))
    )  # a row for each term asked for
    return found.join(weights, "term").groupBy(*keys).agg(F.sum((1 + F.ln("tf")) * F.col("weight")).alias("score"))
