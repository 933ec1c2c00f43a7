"""How well identifiers and names survive from one release to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_stability(usages: DataFrame, before: int = 1, after: int = 2) -> DataFrame:
    """One row: distinct identifiers and names on both sides, how many are shared, overlaps in percent, and a verdict."""

    def overlap(column: str, p: str) -> DataFrame:
        keys = usages.where(F.col(column).isNotNull() & F.col("release").isin(before, after)).groupBy(column).agg(F.max((F.col("release") == before).cast("int")).alias("b"), F.max((F.col("release") == after).cast("int")).alias("a"))
        return keys.agg(*(F.coalesce(F.sum(e), F.lit(0)).cast("long").alias(f"{p}_{n}") for n, e in (("before", F.col("b")), ("after", F.col("a")), ("shared", F.col("a") * F.col("b")))))

    one = overlap("source_taxon_id", "ids").crossJoin(overlap("canonical_key", "names"))
    share = lambda p: F.when(F.least(f"{p}_before", f"{p}_after") > 0, F.col(f"{p}_shared") / F.least(f"{p}_before", f"{p}_after") * 100)
    one = one.withColumns({"id_overlap": share("ids"), "name_overlap": F.coalesce(share("names"), F.lit(0.0))})
    gap = F.col("name_overlap") - F.col("id_overlap")
    return one.withColumn("gap", gap).withColumn("verdict", F.when(gap.isNull(), "none").when(gap < 5, "persistent").otherwise("unstable")).withColumn("strong", F.coalesce(gap >= 20, F.lit(False)))
