"""Anonymous statistics: counts, masked top lists, means; evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions.fuzzy import word_error_rate_col
from vitrail.functions.text import normalize
from vitrail.schemas import SECTIONS

MIN_COUNT = 5


def count_by(df: DataFrame, key: str, out: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out))


def by_month(df: DataFrame, when: str) -> DataFrame:
    """Counts by month of an ISO string; what does not parse keeps its first seven characters."""
    month = F.coalesce(F.date_format(F.try_to_timestamp(F.col(when)), "yyyy-MM"), F.left(when, F.lit(7)))
    return df.where(F.col(when) != "").groupBy(month.alias("mois")).agg(F.count(F.lit(1)).alias("n")).orderBy("mois")


def masked(n: Column, least: int = MIN_COUNT) -> Column:
    return F.when(n >= least, n)


def top_masked(df: DataFrame, keys: list[str], limit: int = 10, least: int = MIN_COUNT) -> DataFrame:
    """The most frequent keys (ties by key), ranked before small counts become
    null; the rank is not returned, as it would tell them apart."""
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *keys).limit(limit)
    return top.select(*keys, masked(F.col("_n"), least).alias("n"), (F.col("_n") < least).alias("masque"))


def mean_confidence(df: DataFrame, key: str = "section", value: str = "confiance") -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.round(F.avg(value), 3), F.lit(0.0)).alias("completude"))


def character_error_rate(hypothesis: Column, reference: Column) -> Column:
    h, r = normalize(hypothesis), normalize(reference)
    return F.levenshtein(h, r) / F.greatest(F.length(r), F.lit(1))


def word_error_rate(hypothesis: Column, reference: Column) -> Column:
    return word_error_rate_col(normalize(hypothesis), normalize(reference))


def benchmark_means(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Means of the runs without error, by key."""
    ok = rows.where(F.col("error").isNull()) if "error" in rows.columns else rows
    return ok.groupBy(*keys).agg(*(F.round(F.avg(m), 4).alias(m) for m in metrics), F.count(F.lit(1)).alias("runs"))


def best_by(means: DataFrame, key: str, metric: str) -> DataFrame:
    return means.agg(F.min_by(key, F.struct(metric, key)).alias(key), F.min(metric).alias(metric))


def score_buckets(df: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.agg(F.count_if(s < 0.5).alias("low"), F.count_if((s >= 0.5) & (s < 0.7)).alias("middle"), F.count_if(s >= 0.7).alias("high"))


def evaluation_summary(entities: DataFrame) -> DataFrame:
    """By label: entities, fragments under four characters, mean length and score, buckets."""
    n, s = F.length("texte"), F.col("score")
    return entities.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(n < 4).alias("fragments"), F.round(F.avg(n), 3).alias("mean_length"),
        F.round(F.avg(s), 3).alias("mean_score"), F.count_if(s < 0.5).alias("low"), F.count_if((s >= 0.5) & (s < 0.7)).alias("middle"),
        F.count_if(s >= 0.7).alias("high"),
    )


def verdict_summary(verdicts: DataFrame, col: str = "verdict") -> DataFrame:
    g = verdicts.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = verdicts.agg(F.count(F.lit(1)).alias("_t"))
    return g.join(F.broadcast(total), F.lit(True)).select(col, "n", F.round(F.col("n") / F.col("_t"), 4).alias("share"))  # one row


def weighted_mean(pairs: Column) -> Column:
    """Fold of array<struct<score,weight>> to the weighted mean."""
    init = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    return F.aggregate(
        pairs, init, lambda a, p: F.struct((a["s"] + p["score"] * p["weight"]).alias("s"), (a["w"] + p["weight"]).alias("w")),
        lambda a: F.when(a["w"] > 0, a["s"] / a["w"]),
    )


def codes_by_system(vsm: DataFrame, limit: int = 10, least: int = MIN_COUNT) -> DataFrame:
    """(systeme, code, libelle, n, masque): the most frequent codes of each system
    in the summaries' sections, ranked before small counts become null."""
    items = F.flatten(F.array(*(F.transform(s, lambda x: x["code_normalise"]) for s in SECTIONS)))
    coded = vsm.select(F.explode(items).alias("c")).where("c.code <> ''")
    counts = coded.groupBy("c.systeme", "c.code", F.coalesce("c.libelle_officiel", F.lit("")).alias("libelle")).agg(F.count(F.lit(1)).alias("_n"))
    # a system's codes are a fixed list
    rank = F.row_number().over(Window.partitionBy("systeme").orderBy(F.desc("_n"), "code", "libelle"))
    return counts.withColumn("_r", rank).where(F.col("_r") <= limit).select("systeme", "code", "libelle", masked(F.col("_n"), least).alias("n"), (F.col("_n") < least).alias("masque"))


def benchmark_report(rows: DataFrame) -> DataFrame:
    """(engine, preprocessing, cer, wer, time_sec, runs, gain): means of the runs
    without error, and by how much of its error each beats the same engine's other setting.

    rows: engine, preprocessing, cer, wer, time_sec and perhaps error."""
    means = benchmark_means(rows, ["engine", "preprocessing"], ["cer", "wer", "time_sec"])
    other = means.select(F.col("engine").alias("_e"), (~F.col("preprocessing")).alias("_p"), F.col("cer").alias("_cer"))
    both = means.join(other, (F.col("engine") == F.col("_e")) & (F.col("preprocessing") == F.col("_p")), "left")
    return both.select(*means.columns, F.when(F.col("_cer") > 0, F.round(1 - F.col("cer") / F.col("_cer"), 4)).alias("gain"))
