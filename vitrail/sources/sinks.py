"""Sinks: append-only logs, separated detail files, tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated, with a header."""
    df.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def overwrite_table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def detail_rows(entities: DataFrame, variants: DataFrame, width: int = 60) -> DataFrame:
    """A row per entity of each (document, variant), for review by hand.

    entities: document_id, variante, label, texte, debut, fin, score; variants:
    document_id, variante, text, which gives the words around it."""
    both = entities.join(variants.select("document_id", "variante", "text"), ["document_id", "variante"])
    lo = F.greatest(F.col("debut") - width, F.lit(0))
    around = F.trim(F.regexp_replace(F.substr("text", lo + 1, F.col("fin") + width - lo), r"(?U)\s+", " "))
    letter = r"(?U)[\p{L}\p{N}]"
    left = F.when(F.col("debut") > 0, F.substr("text", F.col("debut"), F.lit(1))).otherwise("")
    right = F.substr("text", F.col("fin") + 1, F.lit(1))
    return both.select(
        F.col("document_id").alias("document"), "variante", "label", "texte", "debut", "fin", (F.col("fin") - F.col("debut")).alias("longueur"),
        F.round("score", 4).alias("score"), (~left.rlike(letter) & ~right.rlike(letter)).alias("bords_mots"), around.alias("contexte"),
        F.lit("").alias("vrai_positif"), F.lit("").alias("commentaire"),
    )


def summary_rows(details: DataFrame) -> DataFrame:
    """Per (document, variant, label): entities, their mean score, and those cut inside a word."""
    return details.groupBy("document", "variante", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score_moyen"), F.count_if(~F.col("bords_mots")).alias("coupes")
    )
