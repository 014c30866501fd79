"""Lexical correction of OCR words against an embedded lexicon.

Distinct words meet the lexicon by their folded form: most by an equi-join, the
rest by their closest entry, the only Arrow function here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.functions import terminology as T
from vitrail.functions.fuzzy import closest_col, ratio
from vitrail.functions.text import apply_case, fold_ligatures, in_words

WORD = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]{3,}"
PROTECTED = r"(?i)^[\d.,/:%-]+$|^\d|mg$|^ml$|^ui$|^g$|^mmhg$"
CUTOFF, SHORTEST = 88, 5


def corrections(df: DataFrame, col: str) -> DataFrame:
    """(word, corrected) of the distinct lower-case words that change."""
    spark, entries = df.sparkSession, T.words(T.LEXICON)
    lexicon = spark.createDataFrame([*enumerate(entries)], "n int, entry string").withColumn("key", fold_ligatures(F.col("entry")))
    # spellings that fold alike: the first one counts
    lexicon = lexicon.groupBy("key").agg(F.min_by("entry", "n").alias("entry"), F.min("n").alias("n"))

    words = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(WORD), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()
    words = words.withColumn("form", fold_ligatures(F.col("word")))
    words = words.where((F.length("word") >= SHORTEST) & ~F.col("word").rlike(PROTECTED) & ~in_words(F.col("form"), T.LEXICON_EXEMPT))
    exact = words.join(F.broadcast(lexicon), F.col("form") == F.col("key"), "left")
    known = exact.where("entry is not null").select("word", F.col("entry").alias("corrected"))
    keys = [r.key for r in lexicon.orderBy("n").collect()]  # of fixed size
    unknown = exact.where("entry is null").select("word", closest_col(F.col("form"), keys, ratio, CUTOFF).alias("hit")).where("hit.at is not null")
    by_key = F.get(F.array(*map(F.lit, keys)), F.col("hit.at"))
    close = unknown.select("word", by_key.alias("form")).join(F.broadcast(lexicon), F.col("form") == F.col("key")).select("word", F.col("entry").alias("corrected"))
    return known.unionByName(close).where("word <> corrected")


def correct(df: DataFrame, col: str, key: str) -> DataFrame:
    """`df` with col corrected; `key` names its rows.

    Distinct words are scored once; only texts with a word to change are taken
    apart, and put together from their words and what lies between."""
    fixed = corrections(df, col).select(F.col("word").alias("_w"), "corrected")
    words = F.regexp_extract_all(F.col(col), F.lit(WORD), F.lit(0))
    parts = df.select(key, F.posexplode(words).alias("n", "w"))
    changed = parts.join(fixed, F.lower("w") == F.col("_w")).groupBy(key).agg(
        F.map_from_entries(F.array_distinct(F.collect_list(F.struct("w", apply_case(F.col("w"), F.col("corrected")).alias("c"))))).alias("_m")
    )
    pieces = F.transform(
        F.arrays_zip(F.split(col, WORD, -1).alias("b"), F.concat(words, F.array(F.lit(""))).alias("w")),
        lambda p: F.concat(p["b"], F.coalesce(F.element_at(F.col("_m"), p["w"]), p["w"])),
    )
    out = df.join(changed.withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left")
    return out.withColumn("correction_ocr", F.col("_m").isNotNull()).withColumn(col, F.when(F.col("_m").isNull(), F.col(col)).otherwise(F.array_join(pieces, ""))).drop("_m", "_key")
