"""Segments for language-model providers, their relevance, and anchoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrail.functions.fuzzy import extract_one, partial_ratio_col, token_set_ratio
from vitrail.functions.text import flatten, repaired_json
from vitrail.operators.audit import breaker_open
from vitrail.operators.spans import let

MAX_CHARS, OVERLAP = 800, 150
HOLDS, CLOSE_LINE = 60, 85  # fixed values: similarity of a passage to its value, of a line to a value
#: Relevance cues.
CLINICAL = (
    r"(?iuU)\b(antécédent|antecedent|allergi|traitement|ordonnance|diagnostic|pathologi|maladie|opération|operation|chirurgi|vaccin|tabac|"
    r"alcool|mg\b|ml\b|comprimé|gélule|gelule|posologie|prescri|ulcère|ulcere|hernie|scanner|biopsie|conclusion|surveillance)"
)
ADMINISTRATIVE = (
    r"(?iuU)(cedex|tél|tel |fax|dossier n|page \d|cher confrère|cher confrere|amicalement|en te remerciant|croyez|ci-joint|rdv|hospitalier général)"
)


def _pack(pieces: Column, glue: str, limit: int) -> Column:
    """Consecutive pieces joined while they fit: the fold only finds where each
    run begins, from the pieces' lengths."""
    n = len(glue)

    def step(s: Column, p: Column) -> Column:
        grown = s["size"] + n + F.length(p)
        new = (s["size"] < 0) | (grown > limit)
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(new, F.length(p)).otherwise(grown).alias("size"),
            F.when(new, F.concat(s["starts"], F.array(s["i"]))).otherwise(s["starts"]).alias("starts"),
        )

    init = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("size"), F.array().cast("array<int>").alias("starts"))

    def joined(p: Column) -> Column:
        run = lambda starts: F.transform(starts, lambda a, k: F.array_join(F.slice(p, a + 1, F.coalesce(F.get(starts, k + 1), F.size(p)) - a), glue))
        return let(F.aggregate(p, init, step, lambda s: s["starts"]), run)

    return let(pieces, joined)


def segments(text: Column, max_chars: int = MAX_CHARS, overlap: int = 0) -> Column:
    """array<string>: paragraphs packed up to the limit, long ones cut between
    words; with an overlap, each begins with the end of the one before."""
    t = F.coalesce(text, F.lit(""))
    paras = F.filter(F.transform(F.split(t, r"\n\s*\n"), lambda p: F.btrim(p, F.lit("\n"))), lambda p: p != "")
    words = lambda p: F.filter(F.split(p, r"(?U)\s+"), lambda w: w != "")
    fine = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(_pack(words(p), " ", max_chars))))

    def overlapped(base: Column) -> Column:
        def with_tail(s: Column, i: Column) -> Column:
            tail = F.right(F.get(base, i - 1), F.lit(overlap))
            tail = F.when(tail.contains(" "), F.regexp_replace(tail, r"(?s)^[^ ]* ", "")).otherwise(tail)
            return F.when(i == 0, s).otherwise(F.trim(F.concat(tail, F.lit("\n\n"), s)))

        return F.when(F.size(base) == 0, F.array(t)).otherwise(F.transform(base, with_tail) if overlap else base)

    whole = F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= max_chars, F.array(t))
    return whole.otherwise(let(_pack(fine, "\n\n", max_chars), overlapped))


def is_relevant(segment: Column) -> Column:
    """Long enough and clinical; an administrative segment needs two cues."""
    cues = F.size(F.regexp_extract_all(segment, F.lit(CLINICAL), F.lit(0)))
    return (F.length(F.trim(segment)) >= 40) & (cues >= 1) & (~segment.rlike(ADMINISTRATIVE) | (cues >= 2))


def _place(text: Column, what: Column) -> Column:
    """Offset of a string, as written or else in any case; null if it is not there."""
    what = F.nullif(what, F.lit(""))
    return F.coalesce(F.nullif(F.call_function("locate", what, text), F.lit(0)), F.nullif(F.call_function("locate", F.lower(what), F.lower(text)), F.lit(0))) - 1


def _closest_line(value: Column, lines: Column) -> Column:
    """struct<at,score> of the first best line; both are flattened, null where nothing is asked."""

    def batch(v: pd.Series, ls: pd.Series) -> pd.DataFrame:
        hits = [extract_one(x, list(y), token_set_ratio, CLOSE_LINE) if x and y is not None else None for x, y in zip(v, ls)]
        return pd.DataFrame({"at": pd.array([h and h[0] for h in hits], "Int32"), "score": [h[1] if h else None for h in hits]})

    batch.__annotations__ = {"v": pd.Series, "ls": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, "at int, score double")(value, lines)


def anchored(items: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ancre: struct<offset,longueur,niveau,passage>, and the confidence it gives.

    Level 2: the passage is in the text and holds the value; 1: only the value is, or
    a line close to it; 0: neither, or a passage that does not hold the value.
    Places are found in the plan; only near matches of what is left are scored."""
    text, passage, value = (F.coalesce(F.col(c), F.lit("")) for c in (text_col, "passage", "valeur"))
    told = items.withColumn("_p", _place(text, passage)).withColumn("_v", F.when(F.col("_p").isNull(), _place(text, value)))
    flat, region = flatten(value), flatten(F.substr(text, F.col("_p") + 1, F.length(passage)))
    whole = F.contains(region, flat)
    asked = F.col("_p").isNotNull() & ~whole
    held = whole | (partial_ratio_col(F.when(asked, flat), F.when(asked, region)) >= HOLDS)
    lines = F.split(text, "\n")
    left = F.col("_p").isNull() & F.col("_v").isNull()
    told = told.withColumn("_held", held).withColumn("_line", F.when(left, _closest_line(F.when(left, flat), F.when(left, F.transform(lines, flatten)))))
    at = F.col("_line.at")
    before = F.slice(lines, F.lit(1), at)
    start = F.length(F.array_join(before, "\n")) + F.when(at > 0, 1).otherwise(0)
    line = F.get(lines, at)

    def found(offset: Column, said: Column, level: int) -> Column:
        return F.struct(offset.cast("int").alias("offset"), F.length(said).alias("longueur"), F.lit(level).alias("niveau"), F.when(F.lit(level > 0), said).otherwise("").alias("passage"))

    place = (
        F.when(F.col("_p").isNotNull() & F.col("_held"), found(F.col("_p"), passage, 2))
        .when(F.col("_p").isNotNull(), found(F.col("_p"), passage, 0))
        .when(F.col("_v").isNotNull(), found(F.col("_v"), value, 1))
        .when(at.isNotNull(), found(start, line, 1))
        .otherwise(found(F.lit(-1), F.lit(""), 0))
    )
    level = F.col("ancre.niveau")
    out = told.withColumn("ancre", place).drop("_p", "_v", "_held", "_line")
    return out.withColumn("confiance", F.when(level == 2, 0.9).when(level == 1, 0.8).otherwise(0.6))


def llm_entities(docs: DataFrame, provider, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, limit: int = 15) -> DataFrame:
    """Entities of relevant segments from a provider (made once per worker; maps a
    segment to (section, valeur, passage) tuples, or raises).

    Rows with failed=true are for the rule extractor; after `limit` failures
    of a document the rest is not asked.  A document's segments stay in one task."""

    def run(batches):

        ask = provider()
        for b in batches:
            rows = []
            for d, segs in zip(b["document_id"], b["segments"]):
                failures = 0
                for i, s in enumerate(segs):
                    if failures >= limit:
                        rows.append((d, i, s, None, None, None, True))
                        continue
                    try:
                        rows += [(d, i, s, *e, False) for e in ask(s)]
                    except Exception:  # noqa: BLE001 - any failure of a model is a failed segment
                        failures += 1
                        rows.append((d, i, s, None, None, None, True))
            yield pd.DataFrame(rows, columns=["document_id", "seg", "text", "section", "valeur", "passage", "failed"])

    segs = docs.select("document_id", F.filter(segments(F.col("text"), max_chars, overlap), is_relevant).alias("segments"))
    return segs.mapInPandas(run, "document_id string, seg int, text string, section string, valeur string, passage string, failed boolean")


#: The sections' names in a model's answer, and its schema.
ANSWER_SECTIONS = {
    "patho": "pathologies_actives", "antec": "antecedents", "allerg": "allergies", "traitement": "traitements_long_cours",
    "risque": "facteurs_risque", "vaccin": "vaccinations", "vigilance": "points_vigilance",
}
ANSWER = "items array<struct<r:string,v:string,p:string>>"


def llm_answers(docs: DataFrame, provider, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, limit: int = 15) -> DataFrame:
    """(document_id, seg, text, items, failed) of each relevant segment: a model's
    answer as text, parsed or repaired in the plan.

    provider() is made once per worker and maps a segment to JSON text, or raises (a
    timeout too).  An answer that can't be read is a failure; after `limit` failures of a
    document its other segments count as failed."""

    def run(batches):
        ask = provider()
        for b in batches:
            rows = []
            for d, segs in zip(b["document_id"], b["segments"]):
                failures = 0
                for i, s in enumerate(segs):
                    answer = None
                    if failures < limit:
                        try:
                            answer = ask(s)
                        except Exception:  # noqa: BLE001 - any failure of a model is a failed segment
                            failures += 1
                    rows.append((d, i, s, answer))
            yield pd.DataFrame(rows, columns=["document_id", "seg", "text", "answer"])

    segs = docs.select("document_id", F.filter(segments(F.col("text"), max_chars, overlap), is_relevant).alias("segments"))
    told = segs.mapInPandas(run, "document_id string, seg int, text string, answer string")
    told = told.withColumn("items", repaired_json(F.col("answer"), ANSWER)["items"]).withColumn("failed", F.col("items").isNull())
    cut = breaker_open(told, limit=limit)
    return cut.select("document_id", "seg", "text", F.when(~F.col("open"), F.col("items")).alias("items"), (F.col("failed") | F.col("open")).alias("failed"))


def llm_items(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """The answers' items in a known section with value and passage, anchored in the
    document: what `validate` takes, and `confiance`."""
    names = F.create_map(*(F.lit(x) for kv in ANSWER_SECTIONS.items() for x in kv))
    it = answers.select("document_id", "seg", F.posexplode("items").alias("n", "i"))
    it = it.select("document_id", "seg", "n", F.try_element_at(names, F.col("i.r")).alias("section"), F.col("i.v").alias("valeur"), F.col("i.p").alias("passage"))
    it = it.where("section is not null and valeur <> '' and passage <> ''")
    told = anchored(it.join(docs.select("document_id", "text"), "document_id"))
    # what no source shows has none to show; a short overlap may give an item twice
    told = told.withColumn("offset_debut", F.greatest(F.col("ancre.offset"), F.lit(0))).withColumn("niveau", F.col("ancre.niveau"))
    first = Window.partitionBy("document_id", "section", F.lower(F.trim("valeur"))).orderBy("seg", "n")
    return told.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ancre", "seg", "n")
