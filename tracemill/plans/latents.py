from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import latents
from tracemill.plans.registry import query

LMH = ("low", "mid", "high")


@query(
    "latent_bins",
    """
    WITH s AS (SELECT quantile_cont(l_extendedprice, 0.33) p33, quantile_cont(l_extendedprice, 0.66) p66,
                      quantile_cont(l_quantity, 0.33) q33, quantile_cont(l_quantity, 0.66) q66 FROM lineitem),
    b AS (SELECT CASE WHEN l_extendedprice <= p33 THEN 'low' WHEN l_extendedprice <= p66 THEN 'mid' ELSE 'high' END AS price_bin,
                 CASE WHEN l_quantity <= q33 THEN 'low' WHEN l_quantity <= q66 THEN 'mid' ELSE 'high' END AS quantity_bin
          FROM lineitem, s)
    SELECT price_bin, quantity_bin, count(*) AS n FROM b GROUP BY ALL
    """,
)
def latent_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    stats = latents.fit_row(items, ["l_extendedprice", "l_quantity"])
    binned = latents.apply(items, stats, {"l_extendedprice": LMH, "l_quantity": LMH})
    return binned.groupBy(F.col("l_extendedprice_bin").alias("price_bin"), F.col("l_quantity_bin").alias("quantity_bin")).agg(F.count("*").alias("n"))
