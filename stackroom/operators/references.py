"""Bibliographies: text cut at its own markers where they count upwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def bibliography_entries(paragraphs: DataFrame) -> DataFrame:
    """(id, n, text): one row per entry of (id, text); a text with fewer than two rising markers is one entry."""
    pieces = F.split("text", r"(?=\[\d{1,3}\])")
    p = paragraphs.withColumn("pieces", F.filter(pieces, lambda x: x != ""))

    def add(done, x):
        # `done` holds finished entries and the last number accepted
        number = F.coalesce(F.try_to_number(F.regexp_extract(x, r"^\[(\d{1,3})\]", 1), F.lit("999")).cast("int"), F.lit(0))
        opens = (number > done.last) & ((F.size(done.e) > 0) | x.rlike(r"^\[\d"))
        last = F.concat(F.slice(done.e, F.lit(1), F.greatest(F.size(done.e) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.get(done.e, F.size(done.e) - 1), F.lit("")), x)))
        return F.struct(F.when(opens, F.concat(done.e, F.array(x))).otherwise(last).alias("e"), F.when(opens, number).otherwise(done.last).alias("last"))

    zero = F.struct(F.array().cast("array<string>").alias("e"), F.lit(0).alias("last"))
    e = p.select("id", "text", F.aggregate("pieces", zero, add).alias("r"))
    one = (F.size("r.e") < 2) | ~F.trim("text").rlike(r"^\[\d")
    return e.select("id", F.posexplode(F.when(one, F.array("text")).otherwise(F.transform("r.e", lambda x: F.trim(x)))).alias("n", "text"))
