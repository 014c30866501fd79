"""File sources: scans, page texts, code tables; all by Spark's readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrail.functions.text import document_key

MAX_BYTES = 50 * 1024 * 1024
IMAGES, SCANS = "*.{png,jpg,jpeg,tif,tiff}", "*.{pdf,png,jpg,jpeg,tif,tiff}"


def scans(spark: SparkSession, path: str, pattern: str = SCANS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(document_id, path, length, sha256, content) of files within the limit.
    The limit is a predicate on the file listing: larger files are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= max_bytes).select(
        document_key(F.col("content")).alias("document_id"), "path", "length", F.sha2("content", 256).alias("sha256"), "content"
    )


def oversized(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") > max_bytes).select("path", "length")


def _windows_1252() -> tuple[str, str]:
    """The code points 0x80 to 0x9F that Windows-1252 has characters for, by rule."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else Windows-1252 (as Latin-1 with its
    extra characters, since decode() knows few character sets)."""
    latin = F.translate(F.decode(content, "ISO-8859-1"), *_windows_1252())
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(latin)


def texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(document_key(F.col("content")).alias("document_id"), "path", decoded(F.col("content")).alias("text"))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, page, text) from files named <document>_p<N>.txt."""
    name = F.regexp_extract("path", r"([^/]+)_p(\d+)\.txt$", 1)
    t = texts(spark, path, "*_p*.txt")
    return t.select(name.alias("document_id"), F.regexp_extract("path", r"_p(\d+)\.txt$", 1).cast("int").alias("page"), "text").where("document_id <> ''")


def code_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")


def ocr_pages(files: DataFrame, provider: Callable[[], Callable[[bytes, str], Iterator[tuple[str, float]]]], max_pages: int | None = None) -> DataFrame:
    """A row per page from a provider (made once per worker): it yields (text,
    confidence) per page; a page that fails becomes a row with an error."""

    def run(batches):
        import pandas as pd

        read = provider()
        for b in batches:
            for d, p, c in zip(b["document_id"], b["path"], b["content"]):
                rows, n = [], 0
                try:
                    for n, (text, confidence) in enumerate(read(bytes(c), p), 1):
                        rows.append((d, n, text, confidence, None))
                        if max_pages and n >= max_pages:
                            break
                except Exception as e:  # noqa: BLE001 - the row carries the failure
                    rows.append((d, n + 1, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["document_id", "page", "text", "confidence", "error"])

    from vitrail.schemas import PAGE

    return files.select("document_id", "path", "content").mapInPandas(run, PAGE)


CASES = [
    ("cas_a", "Patient : Jean MARTEL né le 03/02/1951\nANTÉCÉDENTS : Infarctus du myocarde en 2009. Asthme\nALLERGIES : Pénicilline\nTRAITEMENTS EN COURS :\nMetformine 1000 mg matin et soir\nRamipril 5 mg\nCONCLUSION : état stable"),
    ("cas_b", "Dr Sophie LENOIR RPPS : 10012345678\nMOTIF : Lombalgie basse\nFACTEURS DE RISQUE : tabagisme actif\nVACCINATIONS : Vaccin grippal 2021"),
    ("cas_c", "Compte rendu.\nDans ses antécédents on note : hypertension; diabète de type 2.\nTraitement par apixaban.\nAllergique à l'iode.\nRappel vaccin 2019\nCONCLUSION :\nContrôle dans six mois."),
    ("cas_d", "Madame Awa DIALLO, née le 21/09/1968\nTél : 06 11 22 33 44 - awa.diallo@courriel.example\nMOTIF : Dyspnée d'effort\nANTÉCÉDENTS : BPCO. Tabac 20 paquets-année\nTRAITEMENTS : Salbutamol 100 µg"),
    ("cas_e", "Patient : Paul RIVIERE\nDossier n° GER-2023-0417\nPATHOLOGIES ACTIVES : Insuffisance cardiaque; Fibrillation auriculaire\nPOINTS DE VIGILANCE : risque de chute\nALLERGIES : aucune allergie connue"),
    ("cas_f", "LABORATOIRE\nPatient : Nina COSTA née le 30/11/1980\nDemande n° LAB-2022-0931\nHémoglobine 10,2 g/100mL\nFerritine 8 ng/mL\nCONCLUSION : anémie par carence en fer"),
    ("cas_g", "Concernant : LEROUX Marie\n12 rue des Tilleuls\n69003 Lyon\nDIAGNOSTIC : Ulcère bulbaire linéaire\nBiopsie : absence de lésion suspecte\nTRAITEMENT DE SORTIE : Pantoprazole 20 mg 1/j"),
]


def synthetic_cases(spark: SparkSession) -> DataFrame:
    """Seven made-up reports with every kind of section and identifier."""
    return spark.createDataFrame(CASES, "document_id string, text string")


VARIANTS = ("clean", "skewed", "blurred", "noisy")


def synthetic_dataset(spark: SparkSession, copies: int = 1) -> DataFrame:
    """(document_id, variante, page, reference, text): each case as a recogniser might
    give it from a clean, a skewed, a blurred and a noisy scan.

    Scans are outside this library, so their damage is done to the text: broken
    lines, letters taken for their likes, and lost characters, by a hash of the place, so the same every
    time.  `copies` numbers the cases anew, for data of any size."""
    cases = synthetic_cases(spark).crossJoin(spark.range(copies).withColumnRenamed("id", "copy"))  # seven rows a copy
    rows = cases.select(
        F.when(F.lit(copies > 1), F.concat_ws("_", "document_id", "copy")).otherwise(F.col("document_id")).alias("document_id"),
        F.explode(F.array(*map(F.lit, VARIANTS))).alias("variante"), F.lit(1).alias("page"), F.col("text").alias("reference"),
    )
    letters = F.split("reference", "")
    lot = lambda i: F.pmod(F.xxhash64("document_id", "variante", i), F.lit(100))
    like = lambda c: F.translate(c, "éèêlIO0m", "eee110On")
    damaged = F.transform(
        letters,
        lambda c, i: F.when((F.col("variante") == "skewed") & (c == " ") & (lot(i) < 20), "\n")
        .when((F.col("variante") == "blurred") & (lot(i) < 50), like(c))
        .when((F.col("variante") == "noisy") & (c != "\n") & (lot(i) < 4), "")
        .otherwise(c),
    )
    return rows.withColumn("text", F.array_join(damaged, ""))


def page_batches(pages: DataFrame, size: int = 20) -> DataFrame:
    """Adds `lot`: pages of a document in batches of `size`, in order, so that a
    batch can be read, and fail, apart from the others."""
    return pages.withColumn("lot", F.floor((F.col("page") - 1) / size).cast("int"))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, without folders."""
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), r"^\.+", ""), F.lit("")), F.lit("document"))
