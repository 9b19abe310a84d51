"""External quality of a clustering (cluster, label) and information of word-document matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(assigned: DataFrame) -> DataFrame:
    """(cluster, label, n)"""
    return assigned.groupBy("cluster", "label").agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> DataFrame:
    """The confusion table with cluster size, class size and total (one row, broadcast)."""
    return (
        table.withColumn("in_cluster", F.sum("n").over(Window.partitionBy("cluster")))
        .withColumn("in_class", F.sum("n").over(Window.partitionBy("label")))
        .join(F.broadcast(table.agg(F.sum("n").alias("total"))))
    )


def purity_entropy(table: DataFrame, n_classes: int) -> DataFrame:
    """(cluster, size, purity, entropy), the entropy by logarithm to the number of classes."""
    p = F.col("n") / F.col("size")
    own = table.withColumn("size", F.sum("n").over(Window.partitionBy("cluster")))
    return own.groupBy("cluster", "size").agg(F.max(p).alias("purity"), (-F.sum(p * F.log(p)) / F.log(F.lit(float(n_classes)))).alias("entropy"))


def averages(per_cluster: DataFrame, n_clusters: int) -> DataFrame:
    """(purity, entropy) summed and divided by the number of all clusters."""
    return per_cluster.agg((F.sum("purity") / n_clusters).alias("purity"), (F.sum("entropy") / n_clusters).alias("entropy"))


def normalised_mutual_information(table: DataFrame) -> DataFrame:
    """(mi, nmi): mutual information in nats over the mean of both entropies."""
    m = _marginals(table)
    p, pc, pl = F.col("n") / F.col("total"), F.col("in_cluster") / F.col("total"), F.col("in_class") / F.col("total")
    mi = F.sum(p * F.log(p / (pc * pl)))
    # Each cell carries its share of the marginals' entropies.
    both = F.sum(-p * F.log(pc)) + F.sum(-p * F.log(pl))
    return m.agg(mi.alias("mi"), F.try_divide(mi, both / 2).alias("nmi"))


def f_measure(table: DataFrame) -> DataFrame:
    """(f_measure): the best cluster's F for each class, weighted by class size."""
    m = _marginals(table)
    precision, recall = F.col("n") / F.col("in_cluster"), F.col("n") / F.col("in_class")
    best = m.groupBy("label", "in_class", "total").agg(F.max(2 * precision * recall / (precision + recall)).alias("f"))
    return best.agg((F.sum(F.col("f") * F.col("in_class")) / F.max("total")).alias("f_measure"))


def micro_precision_recall(table: DataFrame) -> DataFrame:
    """(label, precision, recall) where each cluster has its majority's label, the lowest of equal ones; and the micro averages as label null."""
    order = Window.partitionBy("cluster").orderBy(F.col("n").desc(), "label")
    named = table.withColumn("k", F.row_number().over(order)).where("k = 1").select("cluster", F.col("label").alias("named"))
    cells = table.join(named, "cluster").select("label", "named", "n")
    right = cells.where("label = named").groupBy("label").agg(F.sum("n").alias("r"))
    claimed = cells.groupBy(F.col("named").alias("label")).agg(F.sum("n").alias("c"))
    present = cells.groupBy("label").agg(F.sum("n").alias("p"))
    per = present.join(claimed, "label", "left").join(right, "label", "left").select("label", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("c", F.lit(0)).alias("c"), "p")
    rows = per.select("label", F.coalesce(F.try_divide("r", "c"), F.lit(0.0)).alias("precision"), (F.col("r") / F.col("p")).alias("recall"))
    micro = per.agg((F.sum("r") / F.sum("c")).alias("precision"), (F.sum("r") / F.sum("p")).alias("recall"))
    return rows.unionByName(micro.select(F.lit(None).cast(per.schema["label"].dataType).alias("label"), "precision", "recall"))


def mutual_information(cells: DataFrame, priors: DataFrame) -> DataFrame:
    """(bits) of cells (doc_id, word, val) weighted by priors (doc_id, prior): sum of p v log2(v / weighted word mean)."""
    weighted = cells.where("val > 0 AND word IS NOT NULL").join(priors, "doc_id").withColumn("pv", F.col("prior") * F.col("val"))
    # A word's cells share its mean, so they enter by their sums and are not joined with it.
    words = weighted.groupBy("word").agg(F.sum("pv").alias("row"), F.sum(F.col("pv") * F.log2("val")).alias("own"))
    return words.agg(F.sum(F.col("own") - F.when(F.col("row") > 0, F.col("row") * F.log2("row")).otherwise(0.0)).alias("bits"))
