"""Engines, renderers, vault, jobs and the synthetic dataset."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vitrail.operators import assemble, audit, chain, entities, pii, segments, stats, store
from vitrail.sources import files, sinks

LONG = "Antécédent de HTA traitée depuis longtemps par ramipril 5 mg, sans autre maladie connue."


def test_llm_engine_falls_back_by_segment(spark):
    text = LONG + "\n\n" + "ALLERGIES : Pénicilline. Le traitement reste le même depuis des années entières." + "\n\n" + "TRAITEMENTS : Metformine 1000 mg, une surveillance de la glycémie est prévue."

    def provider():
        def ask(s):
            if "Pénicilline" in s:
                raise TimeoutError
            if "Metformine" in s:
                return "pas du JSON"
            items = [{"r": "antec", "v": "HTA", "p": "Antécédent de HTA"}, {"r": "inconnu", "v": "x", "p": "x"}, {"r": "patho", "v": "malaria", "p": "HTA"}]
            return json.dumps({"items": items})[:-1]  # cut short

        return ask

    d = spark.createDataFrame([("d", text), ("e", "rien")], "document_id string, text string")
    answers = segments.llm_answers(d, provider, max_chars=100, overlap=0)
    assert sorted((r.seg, r.failed) for r in answers.collect()) == [(0, False), (1, True), (2, True)]
    fields, rejects, report = chain.llm_fields(d, answers)
    got = {(r.document_id, r.section, r.valeur): r.origine for r in fields.collect()}
    assert got["d", "antecedents", "HTA"] == "llm" and got["d", "allergies", "Pénicilline"] == "regles"
    assert any(k[2].startswith("Metformine") and v == "regles" for k, v in got.items())
    assert {r.document_id: (r.statut, r.echecs) for r in report.collect()} == {"d": ("llm_partiel", 2), "e": ("repli_regles", None)}
    for r in fields.where("origine = 'llm'").collect():
        assert text[r.offset_debut :].startswith(r.passage)


def test_breaker_stops_asking(spark):
    def provider():
        def ask(s):
            raise RuntimeError

        return ask

    d = spark.createDataFrame([("d", "\n\n".join(f"{LONG} {i}" for i in range(20)))], "document_id string, text string")
    got = segments.llm_answers(d, provider, max_chars=120, overlap=0, limit=3).collect()
    assert len(got) == 20 and all(r.failed for r in got)


def test_windows_cover_every_token_and_cut_mentions_are_stitched(spark):
    assert entities.windows(0) == [(0, 0)] and entities.windows(510) == [(0, 510)]
    assert entities.windows(1000) == [(0, 510), (446, 956), (892, 1000)]

    def provider():
        import re

        tokenize = lambda t: [m.span() for m in re.finditer(r"\w+", t)]
        label = lambda t, part: [("problem" if t[a:e].startswith("mal") else None, 0.9, False) for a, e in part]
        return tokenize, label

    text = "mot " * 6 + "mal malade malin " + "mot " * 30 + "mal"
    d = spark.createDataFrame([("d", text)], "document_id string, text string")
    got = sorted((r.debut, r.texte) for r in entities.windowed_entities(d, provider, size=10, stride=3).collect())
    assert got == [(24, "mal malade malin"), (len(text) - 3, "mal")]


def test_complement_labels(spark):
    rows = [("d", "Disease", "asthme", 0, 6, 0.9), ("d", "PER", "DUPONT", 8, 14, 0.9), ("d", "AnatomicalStructure", "foie", 15, 19, 0.9), ("d", "Autre", "x", 0, 1, 0.9), ("d", "CW", "iode", 20, 24, 0.6)]
    e = spark.createDataFrame(rows, "document_id string, label string, texte string, debut int, fin int, score double")
    assert {(r.section, r.valeur) for r in entities.complement_fields(e).collect()} == {("pathologies_actives", "asthme"), ("traitements_long_cours", "iode")}
    d = spark.createDataFrame([("d", "asthme; DUPONT voit")], "document_id string, text string")
    got = pii.with_pii(d, persons=pii.person_spans(e)).first().pii
    assert [(s.pii_type, s.value, s.method) for s in got] == [("NOM_PERSONNE", "DUPONT", "ner")]


@pytest.fixture(scope="module")
def vsm(spark):
    code = F.struct(F.lit("CIM-10").alias("systeme"), F.lit("I10").alias("code"), F.lit("Hypertension <essentielle>").alias("libelle_officiel"))
    f = spark.createDataFrame([("d", "antecedents", 1, "HTA & co", 0.6), ("d", "allergies", 1, "iode", 0.8)], "document_id string, section string, ord int, valeur string, confiance double")
    f = f.withColumn("code_normalise", F.when(F.col("ord") == 1, code))
    docs = spark.createDataFrame([("d", "[PATIENT_001] né le [DATE_NAISSANCE_001] Sexe : F RPPS : [RPPS_001]"), ("e", "")], "document_id string, text string")
    return assemble.assemble(f, docs).join(assemble.identity(docs), "document_id").withColumn("date_generation", F.lit("2024-01-02"))


def test_rendered_summaries_have_nine_headings_and_a_signature(spark, vsm):
    md = {r.document_id: r.markdown for r in assemble.markdown(vsm).collect()}
    assert [x[:5] for x in md["d"].split("\n") if x.startswith("## ")] == [f"## {i}." for i in range(1, 10)]
    assert "- **Identité :** [PATIENT_001] · ✓ 100%" in md["d"] and "- **Sexe :** F · ✓ 90%" in md["d"] and "- **RPPS :** [RPPS_001]" in md["d"]
    assert "*Généré le 2024-01-02 — statut : a_valider*" in md["d"] and "Signature du médecin" in md["d"]
    assert "_Non renseignée (mode strict ou document non identifié)._" in md["e"] and "_Non renseigné._" in md["e"]
    page = {r.document_id: r.html for r in assemble.html(vsm).collect()}
    assert page["d"].count("<h2>") == 9 and "HTA &amp; co" in page["d"] and "&lt;essentielle&gt;" in page["d"] and "<li class='check'" in page["d"]
    signed = assemble.sign(vsm, "Dr <X>", "2024-02-03")
    row = signed.where("document_id = 'd'").first()
    assert row.statut == "signe" and len(row.empreinte_vsm) == 64
    assert f"**Signé par** Dr <X> le 2024-02-03 — empreinte `{row.empreinte_vsm[:16]}…`" in assemble.markdown(signed).where("document_id = 'd'").first().markdown
    assert "Dr &lt;X&gt;" in assemble.html(signed).first().html


def test_codes_by_system(spark, vsm):
    got = [tuple(r) for r in stats.codes_by_system(vsm, least=2).collect()]
    assert got == [("CIM-10", "I10", "Hypertension <essentielle>", 2, False)]


def test_vault(spark, tmp_path):
    path = f"{tmp_path}/vault"
    v = store.Vault(spark, path, "secret")
    maps = lambda *rows: spark.createDataFrame(list(rows), "dossier_id string, pii_map map<string,string>")
    v.store(maps(("a", {"[A_001]": "x"}), ("b", {"[A_001]": "y"})))
    v.store(maps(("a", {"[A_002]": "é"})))
    again = store.Vault(spark, path, "secret")
    assert again.load("a") == {"[A_001]": "x", "[A_002]": "é"} and [r.dossier_id for r in again.dossiers().collect()] == ["a", "b"]
    assert not any(b"[A_001]" in p.read_bytes() for p in (tmp_path / "vault").rglob("*.parquet"))
    with pytest.raises(Exception, match="(?i)tag|decrypt|aes"):
        store.Vault(spark, path, "other").load("a")
    assert again.forget("a") and not again.forget("a")
    with pytest.raises(KeyError):
        again.load("a")
    assert len(list((tmp_path / "vault").glob("version=*"))) == 1
    with pytest.raises(ValueError):
        store.derive_key("", b"salt")


def test_point_lookup_decrypts_or_fails(spark):
    key = F.lit(b"k" * 32)
    t = spark.createDataFrame([("a", "x")], "id string, t string")
    t = t.withColumn("c", store.encrypt(F.col("t"), key, "docs", F.col("id")))
    assert store.load(t, "id", "a", "c", "docs", key) == "x"
    with pytest.raises(KeyError):
        store.load(t, "id", "b", "c", "docs", key)


def test_one_job_a_document(spark, tmp_path):
    rows = [("d", "j1", 0, "processing"), ("d", "j2", 1, "processing"), ("d", "j2", 2, "done"), ("d", "j1", 3, "done"), ("d", "j3", 4, "processing"), ("e", "k", 0, "error")]
    e = spark.createDataFrame([(a, b, f"2024-01-01 0{c}:00:00", s) for a, b, c, s in rows], "document_id string, job_id string, t string, status string")
    e = e.select("document_id", "job_id", F.to_timestamp("t").alias("ts"), "status")
    want = {("j1", 0): True, ("j2", 1): False, ("j2", 2): False, ("j1", 3): True, ("j3", 4): True, ("k", 0): False}
    verdicts = audit.job_verdicts(e)
    assert {(r.job_id, r.ts.hour): r.accepte for r in verdicts.collect()} == want
    listed = lambda t: {r.job_id for r in audit.listed_jobs(verdicts, F.to_timestamp(F.lit(t))).collect()}
    assert listed("2024-01-01 03:59:00") == {"j1", "j3"} and listed("2024-01-01 04:30:00") == {"j3"}

    from vitrail.streaming import front

    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = front.job_stream(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.job_id, r.ts.hour): r.accepte for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_synthetic_dataset_and_detail_rows(spark):
    d = files.synthetic_dataset(spark)
    rows = {(r.document_id, r.variante): r for r in d.collect()}
    assert len(rows) == 28 and all((r.text == r.reference) == (k[1] == "clean") for k, r in rows.items())
    assert files.synthetic_dataset(spark, 3).count() == 84
    e = spark.createDataFrame([("cas_b", "clean", "problem", "Lombalgie", 44, 53, 0.91234)], "document_id string, variante string, label string, texte string, debut int, fin int, score double")
    r = sinks.detail_rows(e, d).first()
    assert (r.longueur, r.score, r.bords_mots, r.vrai_positif) == (9, 0.9123, True, "") and "MOTIF : Lombalgie basse" in r.contexte
    assert tuple(sinks.summary_rows(sinks.detail_rows(e, d)).first())[3:] == (1, 0.9123, 0)
    runs = [("t", True, 0.1, 0.2, 1.0, None), ("t", False, 0.2, 0.3, 1.0, None), ("t", False, 9.0, 9.0, 1.0, "x")]
    b = spark.createDataFrame(runs, "engine string, preprocessing boolean, cer double, wer double, time_sec double, error string")
    assert {r.preprocessing: r.gain for r in stats.benchmark_report(b).collect()} == {True: 0.5, False: -1.0}
    names = spark.createDataFrame([("../a b/é c?.pdf",), ("..",), ("x.pdf",)], "n string").select(files.safe_name(F.col("n")).alias("n"))
    assert [r.n for r in names.collect()] == ["_c_.pdf", "document", "x.pdf"]
    pages = spark.createDataFrame([("d", i) for i in range(1, 46)], "document_id string, page int")
    assert [r["count"] for r in files.page_batches(pages).groupBy("lot").count().orderBy("lot").collect()] == [20, 20, 5]


@pytest.mark.parametrize("name,want", [(None, "ner"), ("drbert", "ner"), ("llm", "llm"), ("regles", "rules"), ("rules", "rules"), ("REGLES", "rules"), ("nimporte", "ner")])
def test_engine_names(name, want):
    assert chain.engine_of(name) == want
