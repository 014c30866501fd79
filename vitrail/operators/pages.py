"""Pages of a document: map of offsets, rejected pages, repeated headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions.text import normalize
from vitrail.operators.sections import HEADINGS

SEPARATOR = 2  # characters between pages in the joined text
MAX_TREATMENTS = 10
HEADER_ZONE, HEADER_REACH, HEADER_SHIFT, HEADER_PAGES = 200, 1200, 50, 3
#: Page vocabulary.
ANTIBIOGRAM = (
    r"(?iuU)antibiogramme|\bc\.?m\.?i\.?\b|sensibilit[ée]\s+aux|souche|\bS\s*/\s*I\s*/\s*R\b|r[ée]sistant|interm[ée]diaire|sensible\b"
)
REFERENCE = r"(?iuU)valeurs?\s+de\s+r[ée]f[ée]rence|not[ie]ce|fiche\s+technique|pour\s+information|rappel\s+[ée]pid[ée]miologique"
TITLE = r"(?iumU)^\s*(?:" + "|".join(HEADINGS.values()) + r")\s*:?"


def page_map(pages: DataFrame, id_col: str = "document_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    """debut and fin of every page in the text joined with blank lines.  Pages
    that failed (null text) are not in the joined text and take no room."""
    n = F.length(text_col)
    w = Window.partitionBy(id_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(n + SEPARATOR).over(w) - SEPARATOR
    return pages.where(F.col(text_col).isNotNull()).withColumn("fin", end).withColumn("debut", F.col("fin") - n)


def joined_text(pages: DataFrame, id_col: str = "document_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    ok = pages.where(F.col(text_col).isNotNull()).groupBy(id_col).agg(parts.alias("parts"))
    return ok.select(id_col, F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))


def map_is_valid(expected: Column, length: Column) -> Column:
    """Whether a text of another origin still fits the map: within 40
    characters or 2 %."""
    return F.abs(expected - length) <= F.greatest(F.lit(40), F.floor(length * 0.02))


def page_of(entities: DataFrame, pages: DataFrame, offset: str = "offset_debut", id_col: str = "document_id") -> DataFrame:
    """Adds the page that holds the offset (half-open), null if none does."""
    p = pages.select(F.col(id_col).alias("_id"), F.col("debut").alias("_a"), F.col("fin").alias("_b"), F.col("page").alias("page"))
    on = (F.col(id_col) == F.col("_id")) & (F.col(offset) >= F.col("_a")) & (F.col(offset) < F.col("_b"))
    return entities.drop("page").join(p, on, "left").drop("_id", "_a", "_b")


def rejected_pages(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(document_id, page, motif, entites_supprimees): antibiograms, reference
    sheets and pages with more than ten treatments.  `entities` has a page."""
    n = entities.groupBy(F.col("document_id").alias("_d"), F.col("page").alias("_p")).agg(
        F.count(F.lit(1)).alias("entites_supprimees"), F.count_if(F.col("label") == "treatment").alias("_t")
    )
    t = F.coalesce(F.col("text"), F.lit(""))
    motif = (
        F.when(t.rlike(ANTIBIOGRAM), "antibiogramme").when(t.rlike(REFERENCE), "reference")
        .when(F.col("_t") > MAX_TREATMENTS, F.concat(F.lit("densite ("), F.col("_t"), F.lit(" traitements sur la page)")))
    )
    joined = pages.join(n, (F.col("document_id") == F.col("_d")) & (F.col("page") == F.col("_p")), "left").na.fill(0, ["entites_supprimees", "_t"])
    return joined.withColumn("motif", motif).where("motif is not null").select("document_id", "page", "motif", "entites_supprimees")


def off_rejected_pages(entities: DataFrame, rejected: DataFrame) -> DataFrame:
    return entities.join(rejected.select("document_id", "page"), ["document_id", "page"], "left_anti")


def header_zone(text: Column) -> Column:
    """Up to the first heading within reach, at most 200 characters."""
    t = F.coalesce(text, F.lit(""))
    at = F.length(F.element_at(F.split(t, TITLE, 2), 1))
    return F.when(t.rlike(TITLE) & (at <= HEADER_REACH), F.left(t, F.least(at, F.lit(HEADER_ZONE)))).otherwise(F.left(t, F.lit(HEADER_ZONE)))


def repeated_headers(forms: DataFrame, pages: DataFrame, id_col: str = "document_id", value_col: str = "valeur") -> DataFrame:
    """(document_id, forme, pages): normalised values found in the header of more
    than three pages, always within 50 characters of the first position."""
    zones = pages.select(F.col(id_col).alias("_d"), F.col("page").alias("_p"), normalize(header_zone(F.col("text"))).alias("zone"))
    f = forms.select(id_col, normalize(F.col(value_col)).alias("forme")).where("forme <> ''").distinct()
    hits = f.join(zones, (F.col(id_col) == F.col("_d")) & F.col("zone").contains(F.col("forme")))
    hits = hits.withColumn("pos", F.expr("instr(zone, forme)"))
    g = hits.groupBy(id_col, "forme").agg(F.count(F.lit(1)).alias("pages"), F.min_by("pos", "_p").alias("a"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    stable = (F.col("pages") > HEADER_PAGES) & (F.col("hi") - F.col("a") <= HEADER_SHIFT) & (F.col("a") - F.col("lo") <= HEADER_SHIFT)
    return g.where(stable).select(id_col, "forme", "pages")


def without_headers(fields: DataFrame, repeated: DataFrame, value_col: str = "valeur") -> DataFrame:
    r = repeated.select(F.col("document_id").alias("_d"), F.col("forme").alias("_f"))
    return fields.join(r, (F.col("document_id") == F.col("_d")) & (normalize(F.col(value_col)) == F.col("_f")), "left_anti")


def page_report(pages: DataFrame, id_col: str = "document_id") -> DataFrame:
    """(total, ok, anomalies) of each document."""
    bad = F.col("error").isNotNull()
    return pages.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~bad).alias("ok"),
        F.array_sort(F.collect_list(F.when(bad, F.struct("page", "error")))).alias("anomalies"),
    )


def line_rebuild(words: DataFrame, keys: tuple[str, ...] = ("document_id", "page")) -> DataFrame:
    """Words in reading order as lines (block, par, line), and their mean confidence."""
    lines = words.groupBy(*keys, "block", "par", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "text"))), lambda w: w["text"]), " ").alias("t"),
        F.sum("conf").alias("c"), F.count("conf").alias("n"),
    )
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n")
    return lines.groupBy(*keys).agg(body.alias("text"), F.coalesce(F.round(F.sum("c") / F.sum("n"), 3), F.lit(0.0)).alias("confidence"))


def merge_intervals(df: DataFrame, key: str) -> DataFrame:
    """(key, debut, fin): union of strictly overlapping intervals by key: islands over the running end."""
    w = Window.partitionBy(key).orderBy("debut", "fin")
    before = F.max("fin").over(w.rowsBetween(Window.unboundedPreceding, -1))
    n = F.sum(F.coalesce(F.col("debut") >= F.col("_e"), F.lit(True)).cast("int")).over(w)
    return df.withColumn("_e", before).withColumn("_n", n).groupBy(key, "_n").agg(F.min("debut").alias("debut"), F.max("fin").alias("fin")).drop("_n")


def without_overlaps(rows: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """`rows` (key, debut, fin) that no span of the same key overlaps.  The spans are
    merged first, and each row meets the last one that begins before its end, by one
    sort, so a key with many of both costs no more than its rows."""
    merged = merge_intervals(spans.select(key, "debut", "fin"), key).select(key, F.col("debut").alias("_at"), F.col("fin").alias("_until"))
    marks = rows.withColumn("_at", F.col("fin")).withColumn("_until", F.lit(None).cast(merged.schema["_until"].dataType))
    both = marks.unionByName(merged, allowMissingColumns=True)
    # a span that begins where a row ends does not overlap it: rows come first there
    w = Window.partitionBy(key).orderBy("_at", F.col("_until").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = both.withColumn("_last", F.max("_until").over(w)).where("_until is null")
    return told.where(F.col("_last").isNull() | (F.col("_last") <= F.col("debut"))).select(*rows.columns)
