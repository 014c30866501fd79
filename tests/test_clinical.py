"""Sections, codes, context, entities, validation, pages, dedup, assembly."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vitrail.operators import assemble, audit, codes, context, dedup, entities, lexical, pages, sections, segments, stats, store, validate
from vitrail.sources.files import code_table, decoded, ocr_pages, oversized, page_texts, scans, synthetic_cases

DOC = "document_id string, text string"


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], DOC)


def test_sections_and_closing_lines(spark):
    d = docs(spark, "ANTÉCÉDENTS : HTA ancienne\nAllergies: Pénicilline\nTRAITEMENTS EN COURS\nRamipril 5 mg\nVACCINATIONS : Vaccin grippal\nCONCLUSION : stable", "rien", None)
    z = sections.section_zones(d).orderBy("debut").collect()
    assert [r.section for r in z] == ["antecedents", "allergies", "traitements_long_cours", "vaccinations"]
    assert "stable" not in z[-1].texte
    items = {r.valeur: r for r in sections.scored_items(sections.section_zones(d)).collect()}
    assert items["Ramipril 5 mg"].confiance == pytest.approx(0.88) and items["HTA ancienne"].confiance == pytest.approx(0.8)
    text = d.first().text
    assert all(text[r.offset_debut : r.offset_fin] == v for v, r in items.items())


def test_fallback_fills_missing_sections_only(spark):
    text = "Compte rendu anatomopathologique.\nDans ses antécédents on note : gastrite; ulcère.\nTraitement par oméprazole.\nAllergique à l'iode.\nTabagisme actif\nRappel tétanos 2015\nCONCLUSION :\nGastrite chronique modérée."
    got = sections.extract_rules(docs(spark, text, "Aucune allergie connue. Pas d'allergie médicamenteuse.")).collect()
    by = {}
    for r in got:
        by.setdefault((r.document_id, r.section), []).append(r.valeur)
        assert text[r.offset_debut : r.offset_fin] == r.valeur or r.document_id == "d1"
    assert {s for d, s in by if d == "d0"} >= {"antecedents", "allergies", "traitements_long_cours", "facteurs_risque", "vaccinations", "points_vigilance"}
    assert ("d1", "allergies") not in by


EXPECTED = [
    ("insuffisance cardiaque", "I50"), ("insuffisance cardiaque droite", "I50"), ("insuffisance rénale chronique", "N18"), ("fibrillation auriculaire", "I48"),
    ("AVC ischémique", "I63"), ("diabète de type 2", "E11"), ("infarctus du myocarde", "I21"), ("BPCO", "J44"), ("pacemaker", "Z95.0"), ("allergie", "T78.4"),
    ("insuffisance rénale", None), ("zygarthrose", None), ("AVC", None), ("diabète", None), ("tumeur", None), ("anémie", None), ("cirrhose", None), ("lombalgie", None),
]
DRUGS = [
    ("SPIRAMYCINE", None), ("LODOZ 5 mg", None), ("TRAMADOL 50 mg", None), ("Kardegic 75mg", "B01AC06"), ("Aspirine 75 mg", "B01AC06"), ("Pantoprazole 20mg : 1/j", "A02BC02"),
    ("Amlodipine 10mg : 1/j", "C08CA01"), ("PARACETAMOL 500 mg 2 gélules", "N02BE01"), ("Metformine 1000 mg matin et soir", "A10BA02"), ("Zorglubine 3 mg", None),
]


def test_codes_of_terms(spark):
    for rows, system in ((EXPECTED, "CIM-10"), (DRUGS, "ATC")):
        df = spark.createDataFrame([(t,) for t, _ in rows] * 2, "t string")
        got = {r.term: r.code for r in codes.code_terms(df, "t", system).collect()}
        assert got == dict(rows)


def test_codes_on_fields(spark):
    rows = [("d", "traitements_long_cours", "Metformine 1000 mg matin et soir"), ("d", "antecedents", "fibrillation auriculaire"), ("d", "allergies", "BPCO")]
    got = {r.valeur: r for r in codes.attach_codes(spark.createDataFrame(rows, "document_id string, section string, valeur string")).collect()}
    assert got["Metformine 1000 mg matin et soir"].dosage.startswith("1000 mg") and got["fibrillation auriculaire"].code_normalise.a_verifier
    assert got["BPCO"].code_normalise is None


QUALIFIED = [
    ("Pas de fièvre. Douleur thoracique", "Douleur", "aucun"), ("IL n'est pas exclu qu'il se soit agi d'un abcès", "abcès", "nuance"),
    ("sans anomalie décelée, et qui lui prescrit du CLAMOXYL", "CLAMOXYL", "aucun"), ("Absence de signe de malignité", "malignité", "niee"),
    ("pas de signe d'IVG ni de phlébite", "phlébite", "niee"), ("antécédents familiaux de mort subite", "mort subite", "familial"),
    ("pas d’éléments pour expliquer cette symptomatologie", "symptomatologie", "aucun"), ("suspicion de phlébite", "phlébite", "hypothetique"),
]


@pytest.mark.parametrize("text,entity,want", QUALIFIED)
def test_context(spark, text, entity, want):
    q = context.qualify(F.lit(text), F.lit(text.index(entity)))
    assert spark.range(1).select(context.verdict(q)).first()[0] == want


def test_left_context_stops_at_sentences(spark):
    assert spark.range(1).select(context.left_context(F.lit("Pas de fièvre. Douleur"), F.lit(15))).first()[0] in ("", " ")
    assert spark.range(1).select(context.left_context(F.lit("abc"), F.lit(0))).first()[0] == ""


def test_bio_decoding_and_stitching(spark):
    text = "Œsophagite chronique traitée par oméprazole."
    t = [("d", 0, 10, "problem", 0.8, True), ("d", 11, 20, "problem", 0.9, False), ("d", 21, 28, None, 0.9, False), ("d", 33, 43, "treatment", 0.95, True)]
    e = entities.decode_bio(spark.createDataFrame(t, "document_id string, start int, end int, type string, score double, is_b boolean"))
    assert [(r.label, text[r.debut : r.fin], round(r.score, 3)) for r in e.orderBy("debut").collect()] == [("problem", "Œsophagite chronique", 0.85), ("treatment", "oméprazole", 0.95)]
    parts = [("d", "problem", 0, 10, 0.8), ("d", "problem", 8, 20, 0.9), ("d", "problem", 11, 15, 0.5), ("d", "treatment", 33, 43, 0.95), ("d", "problem", 40, 43, 0.7)]
    s = entities.stitch(spark.createDataFrame(parts, "document_id string, label string, debut int, fin int, score double"), docs(spark, text).withColumn("document_id", F.lit("d")))
    assert [(r.label, r.debut, r.fin) for r in s.orderBy("debut", "label").collect()] == [("problem", 0, 20), ("treatment", 33, 43), ("problem", 40, 43)]


def test_entity_filters(spark):
    text = "fraude [PATIENT_001] HTA bilan"
    rows = [("problem", 0, 3, 0.9), ("problem", 21, 24, 0.5), ("problem", 21, 24, 0.9), ("test", 25, 30, 0.9), ("problem", 8, 15, 0.9)]
    df = spark.createDataFrame(rows, "label string, debut int, fin int, score double").withColumn("text", F.lit(text))
    got = [r[0] for r in df.select(entities.entity_reject(F.col("text"))).collect()]
    assert got == ["extracteur_bord_mot", "extracteur_score", None, "extracteur_label_test", "extracteur_anonymisation"]


def test_routing_uses_the_current_title_only(spark):
    d = docs(spark, "ALLERGIES : pénicilline\nTRAITEMENTS EN COURS : ramipril").withColumn("document_id", F.lit("d"))
    e = spark.createDataFrame([("d", "treatment", "pénicilline", 12, 23, 0.9), ("d", "treatment", "ramipril", 47, 55, 0.9)], "document_id string, label string, texte string, debut int, fin int, score double")
    assert {r.texte: r.section for r in entities.routed(e, d).collect()} == {"pénicilline": "allergies", "ramipril": "traitements_long_cours"}


def test_posology_and_joined_values(spark):
    got = spark.createDataFrame([("OGAST 1 gél/j en permanence.", 5), ("HTA sévère", 3)], "t string, f int").select(entities.extended_end(F.col("t"), F.col("f"))).collect()
    assert [r[0] for r in got] == [27, 3]
    parts = spark.createDataFrame([("HTA Gastrite chronique", 100)], "v string, a int").select(entities.split_joined(F.col("v"), F.col("a"))).first()[0]
    assert [tuple(p) for p in parts] == [("HTA", 100, 103), ("Gastrite chronique", 104, 122)]


RULES = [
    ("Gastrite chronique", "pathologies_actives", None), ("absente", "pathologies_actives", "validateur_ancrage"), ("ab", "antecedents", "validateur_longueur"),
    ("[PATIENT_001] vu", "antecedents", "validateur_pseudo"), ("Laboratoire central", "antecedents", "validateur_blocklist"), ("ALLERGIES", "allergies", "validateur_entete_seule"),
    ("12-34 ab", "points_vigilance", "validateur_fragments"), ("de résistance", "antecedents", "validateur_fragment_tronque"), ("Résection de la", "antecedents", "validateur_fragment_tronque"),
    ("foie est augmenté", "antecedents", "validateur_phrase"), ("anti-TRIM21 positif", "pathologies_actives", "validateur_dosage_anticorps"), ("douloureux", "pathologies_actives", "validateur_non_medical"),
    ("antibiotique", "traitements_long_cours", "validateur_classe_seule"), ("MAALOX et RANIPLEX", "traitements_long_cours", "validateur_traitement_compose"),
    ("IPZ", "traitements_long_cours", "validateur_mot_court"), ("calcium 2,35 mmol", "points_vigilance", "validateur_bio"), ("Ramipril 5 mg", "traitements_long_cours", None),
]


def test_validator_rules(spark):
    source = " ; ".join(v for v, _, _ in RULES if v != "absente")
    rows = [("d", v, v, s, 0) for v, s, _ in RULES]
    c = spark.createDataFrame(rows, "document_id string, valeur string, passage string, section string, offset_debut int").withColumn("text", F.lit(source))
    kept, rejects = validate.validate(c)
    assert {r.valeur: r.regle for r in rejects.collect()} == {v: r for v, _, r in RULES if r}
    assert {r.valeur for r in kept.collect()} == {v for v, _, r in RULES if not r}
    assert kept.count() + rejects.count() == len(RULES)


def test_negated_entities_are_rejected_and_reroutes_kept(spark):
    text = "Absence de signe de malignité. antécédents familiaux de mort subite. suspicion de phlébite. cure de 7 jours de clamoxyl"
    rows = [("d", v, p, s, text.index(v)) for v, p, s in (("malignité", "malignité", "pathologies_actives"), ("mort subite", "mort subite", "antecedents"), ("phlébite", "phlébite", "pathologies_actives"), ("clamoxyl", "cure de 7 jours de clamoxyl", "traitements_long_cours"))]
    c = spark.createDataFrame(rows, "document_id string, valeur string, passage string, section string, offset_debut int").withColumn("text", F.lit(text))
    kept, rejects = validate.validate(c)
    assert [r.regle for r in rejects.collect()] == ["N1_entite_niee"]
    got = {r.valeur: (r.section, bool(r.mention_contexte)) for r in kept.collect()}
    assert got == {"mort subite": ("facteurs_risque", True), "phlébite": ("points_vigilance", True), "clamoxyl": ("points_vigilance", False)}


def test_no_loss_guard(spark):
    o = spark.createDataFrame([(1, "d", "HTA", "HTA", "antecedents", 0, "HTA"), (2, "d", "toux", "toux", "antecedents", 0, "toux")], "origin_id int, document_id string, valeur string, passage string, section string, offset_debut int, text string")
    kept, _ = validate.no_loss_guard(o, o.where("origin_id = 1"))
    assert [r.origin_id for r in kept.collect()] == [2]


def test_pages(spark):
    p = spark.createDataFrame([("d", 1, "abc"), ("d", 2, None), ("d", 3, "Antibiogramme : S/I/R"), ("d", 4, "fin")], "document_id string, page int, text string")
    m = pages.page_map(p)
    assert [(r.page, r.debut, r.fin) for r in m.orderBy("page").collect()] == [(1, 0, 3), (3, 5, 26), (4, 28, 31)]
    assert pages.joined_text(p).first().text[5:26] == "Antibiogramme : S/I/R"
    e = spark.createDataFrame([("d", "treatment", 1), ("d", "problem", 6), ("d", "problem", 7), ("d", "problem", 29), ("d", "x", 99)], "document_id string, label string, debut int")
    located = pages.page_of(e, m, "debut")
    assert {r.debut: r.page for r in located.collect()} == {1: 1, 6: 3, 7: 3, 29: 4, 99: None}
    rejected = pages.rejected_pages(m, located)
    assert [(r.page, r.motif, r.entites_supprimees) for r in rejected.collect()] == [(3, "antibiogramme", 2)]
    assert pages.off_rejected_pages(located, rejected).count() == 3


def test_letterhead_on_four_pages_only(spark):
    head = lambda n: [(f"d{n}", i, f"Cabinet du Sommeil\nPage\n{'x' * 300}") for i in range(n)]
    p = spark.createDataFrame(head(3) + head(4), "document_id string, page int, text string")
    f = spark.createDataFrame([(f"d{n}", v) for n in (3, 4) for v in ("Sommeil", "absent")], "document_id string, valeur string")
    r = pages.repeated_headers(f, p)
    assert [(x.document_id, x.forme, x.pages) for x in r.collect()] == [("d4", "sommeil", 4)]
    assert pages.without_headers(f, r).count() == 3


def fields(spark, values, **over):
    rows = [("d", "pathologies_actives", i, v, 0.9, over.get("pages", range(1, 99))[i], v, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "document_id string, section string, ord int, valeur string, confiance double, page int, passage string, code string")


def test_dedup_chain_and_sides(spark):
    got = dedup.deduplicate(fields(spark, ["Ulcère bulbaire linéaire", "ulcère libéaire", "ulcère linéaire", "Ulcère bulbaire", "ulcère bulbmre"], pages=[8, 22, 30, 40, 55])).collect()
    assert len(got) == 1 and got[0].occurrences == 5 and got[0].pages == [8, 22, 30, 40, 55] and len(got[0].passages) == 5
    got = dedup.deduplicate(fields(spark, ["hernie inguinale droite", "hernie inguinale gauche", "hernie inguinale"])).collect()
    assert len(got) == 2 and all(r.lateralite_divergente for r in got)
    assert len(dedup.deduplicate(fields(spark, ["kyste hépatique", "kyste urétral", "fuites urinaires", "incontinence"])).collect()) == 4
    got = dedup.deduplicate(fields(spark, ["HTA", "hta", "Hta"])).collect()
    assert got[0].occurrences == 3 and got[0].valeur == "HTA"


def test_dedup_is_independent_of_partitions(spark):
    f = fields(spark, ["Ulcère bulbaire linéaire", "ulcère libéaire", "ulcère linéaire", "hernie droite", "hernie gauche", "hernie"])
    rows = lambda d: sorted(map(str, dedup.deduplicate(d).collect()))
    assert rows(f.repartition(1)) == rows(f.orderBy(F.rand(3)).repartition(8))


def test_assembly_rendering_and_edits(spark):
    f = spark.createDataFrame([("d", "antecedents", 1, "Asthme", 0.6), ("d", "antecedents", 2, "HTA", 0.9), ("d", "allergies", 1, "iode", 0.8)], "document_id string, section string, ord int, valeur string, confiance double")
    v = assemble.assemble(f, docs(spark, "x", "y").select(F.when(F.col("document_id") == "d0", "d").otherwise("vide").alias("document_id")))
    r = {x.document_id: x for x in v.collect()}
    assert [i.a_valider for i in r["d"].antecedents] == [True, False] and r["d"].completude_antecedents == 0.75 and r["vide"].allergies == []
    assert assemble.violations(v).count() == 0
    assert assemble.violations(v.withColumn("statut", F.lit("faux"))).count() == 2
    md = {x.document_id: x.markdown for x in assemble.markdown(v).collect()}
    assert "## 4. Antécédents médicaux et chirurgicaux  `complétude 75%`\n- Asthme · ⚠ À valider (60%)\n- HTA · ✓ 90%" in md["d"] and md["vide"].count("_Aucune information") == 7
    e = assemble.edit(v, "antecedents", 1, "Asthme allergique").where("document_id = 'd'").first().antecedents[0]
    assert (e.valeur, e.confiance, e.a_valider) == ("Asthme allergique", 1.0, False)
    assert [i.valeur for i in assemble.delete_item(v, "antecedents", 1).where("document_id = 'd'").first().antecedents] == ["HTA"]
    prints = [assemble.fingerprint(x).where("document_id = 'd'").first().empreinte for x in (v, v, assemble.delete_item(v, "allergies", 1))]
    assert prints[0] == prints[1] != prints[2] and assemble.search(v, "VIDE").count() == 1


def test_greedy_assignment(spark):
    ddl = "document_id string, section string, ord int, valeur string"
    f = spark.createDataFrame([("d", "s", 1, "ulcere bulbaire"), ("d", "s", 2, "ulcere bulbaire"), ("d", "s", 3, "rien")], ddl)
    c = spark.createDataFrame([("d", "s", 1, "Ulcere lineaire"), ("d", "s", 2, "ulcere bulbaire")], ddl)
    assert [(r.ord, r.candidate) for r in assemble.assign_candidates(f, c).orderBy("ord").collect()][0] == (1, 2)


def test_statistics_mask_small_counts(spark):
    df = spark.createDataFrame([("E11", "x")] * 6 + [("J45", "y")], "code string, libelle string")
    got = {r.code: (r.n, r.masque) for r in stats.top_masked(df, ["code", "libelle"]).collect()}
    assert got == {"E11": (6, False), "J45": (None, True)} and "_n" not in stats.top_masked(df, ["code"]).columns
    d = spark.createDataFrame([("2024-05-01T10:00:00",), ("2024-05-09T00:00:00",), ("2023-13",), ("",)], "d string")
    assert [tuple(r) for r in stats.by_month(d, "d").collect()] == [("2023-13", 1), ("2024-05", 2)]
    assert spark.range(1).select(stats.character_error_rate(F.lit("Éte"), F.lit("ete!"))).first()[0] == 0.25
    assert spark.createDataFrame([("a b d", "a b c d")], "h string, r string").select(stats.word_error_rate(F.col("h"), F.col("r"))).first()[0] == 0.25


def test_audit_chain_notices_changes(spark):
    e = spark.createDataFrame([("l", 1, "t1", "u", "a", "{}"), ("l", 2, "t2", "u", "b", "{}"), ("m", 1, "t1", "u", "a", "{}")], "log string, id long, ts string, actor string, event string, payload string")
    c = audit.chain(e)
    ok = lambda d: {r.log: r.valid for r in audit.verify(d).collect()}
    assert ok(c) == {"l": True, "m": True}
    forged = F.when((F.col("log") == "l") & (F.col("id") == 1), "x").otherwise(F.col("payload"))
    assert ok(c.withColumn("payload", forged)) == {"l": False, "m": True}
    assert ok(c.where("NOT (log = 'l' AND id = 1)")) == {"l": False, "m": True}
    last = audit.heads(c)
    cut = c.where("NOT (log = 'l' AND id = 2)")
    assert ok(cut)["l"] and {r.log: r.valid for r in audit.verify(cut, last=last).collect()} == {"l": False, "m": True}


def test_a_long_log_is_one_stream(spark):
    e = spark.range(300_000).selectExpr("'l' AS log", "id", "cast(id AS string) AS ts", "'u' AS actor", "'e' AS event", "'{}' AS payload")
    assert audit.verify(audit.chain(e)).first().valid


def test_lockout_breaker_and_sessions(spark):
    rows = [("u", f"2024-01-01 00:0{i}:00", i == 2) for i in range(9)]
    a = spark.createDataFrame(rows, "user_id string, t string, ok boolean").withColumn("ts", F.to_timestamp("t"))
    got = audit.failure_runs(a).collect()
    assert [str(r.locked_at)[11:16] for r in got] == ["00:07"]
    at = [f"00:0{i}" for i in range(5)] + ["00:10", "01:00", "01:05", "02:00", "03:00"]
    rows = [("v", f"2024-01-01 {t}:00", t in ("00:10", "01:05")) for t in at]  # successes during a lock are turned away
    later = spark.createDataFrame(rows, "user_id string, t string, ok boolean").withColumn("ts", F.to_timestamp("t"))
    assert [str(r.locked_at)[11:16] for r in audit.failure_runs(later).orderBy("locked_at").collect()] == ["00:04", "01:00", "02:00", "03:00"]
    s = audit.sessions(a.where("ok or t like '%00:08%'"), minutes=5).orderBy("start").collect()
    assert [r.n for r in s] == [1, 1]
    seg = spark.createDataFrame([("d", i, True) for i in range(17)], "document_id string, seg int, failed boolean")
    assert [r.open for r in audit.breaker_open(seg).orderBy("seg").collect()] == [False] * 15 + [True, True]


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, v int, t string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "id string, v int, t string")
    assert {r.id: r.t for r in store.upsert(old, new, ["id"], "v").collect()} == {"a": "z", "b": "y", "c": "w"}
    key = F.lit(b"k" * 32)
    c = old.withColumn("e", store.encrypt(F.col("t"), key, "t", F.col("id")))
    assert c.select(store.decrypt(F.col("e"), key, "t", F.col("id")).alias("p")).first().p == "x"
    with pytest.raises(Exception, match="(?i)tag|decrypt|aes"):
        c.select(store.decrypt(F.col("e"), key, "t", F.lit("other"))).collect()
    v = spark.createDataFrame([("d", {"[A_001]": "x", "[A_002]": "y"})], "dossier_id string, pii_map map<string,string>")
    n = spark.createDataFrame([("d", {"[A_002]": "z"}), ("e", {"[A_001]": "q"})], "dossier_id string, pii_map map<string,string>")
    assert {r.dossier_id: r.pii_map for r in store.vault_merge(v, n).collect()} == {"d": {"[A_001]": "x", "[A_002]": "z"}, "e": {"[A_001]": "q"}}
    kept, counts = store.forget({"t": old.withColumnRenamed("id", "dossier_id")}, spark.createDataFrame([("a",)], "dossier_id string"))
    assert kept["t"].count() == 1 and [tuple(r) for r in counts.collect()] == [("t", 1)]


def test_segments(spark):
    text = "un " * 100 + "\n\n" + "deux " * 50 + "\n \n" + "trois " * 200
    got = spark.range(1).select(segments.segments(F.lit(text), 400)).first()[0]
    assert max(map(len, got)) <= 400 and " ".join(" ".join(got).split()) == " ".join(text.split())
    over = spark.range(1).select(segments.segments(F.lit(text), 400, 50)).first()[0]
    assert len(over) == len(got) and all(b.strip().endswith(a.strip()) for a, b in zip(got, over)) and len(over[1]) > len(got[1])
    assert spark.range(1).select(segments.segments(F.lit("court"))).first()[0] == ["court"]
    rel = lambda s: spark.range(1).select(segments.is_relevant(F.lit(s))).first()[0]
    assert rel("Traitement par ramipril 5 mg au long cours, surveillance") and not rel("court") and not rel("cher confrère, je vous remercie de votre envoi du mois dernier")


def test_anchors(spark):
    text = "Ligne une\nUlcère bulbaire linéaire, connu\nfin"
    asked = [
        ("Ulcère bulbaire linéaire", "ulcère bulbaire"), ("absent", "bulbaire"), ("Ligne une", "ulcère"), ("", "Ulcere bulbaire lineaire (connu)"),
        ("", "zzz qqq"), (None, None), ("ulcère BULBAIRE", "ulcere bulbair"), ("", "Ligne une"),
    ]
    rows = spark.createDataFrame([(i, text, *a) for i, a in enumerate(asked)], "i int, text string, passage string, valeur string")
    got = {r.i: tuple(r.ancre) for r in segments.anchored(rows).collect()}
    assert got[0] == (10, 24, 2, "Ulcère bulbaire linéaire") and got[1] == (17, 8, 1, "bulbaire") and got[2] == (0, 9, 0, "")
    assert got[3] == (10, 31, 1, "Ulcère bulbaire linéaire, connu") and got[4] == got[5] == (-1, 0, 0, "")
    assert got[6][:3] == (10, 15, 2) and got[7] == (0, 9, 1, "Ligne une")


def test_llm_provider_failures_fall_back(spark):
    def provider():
        def ask(s):
            if "ulcère" in s:
                raise TimeoutError
            return [("antecedents", "HTA", "HTA")]

        return ask

    d = docs(spark, "Antécédent de HTA traitée depuis longtemps par ramipril", "Biopsie : ulcère gastrique à surveiller de près, conclusion")
    got = {r.document_id: r.failed for r in segments.llm_entities(d, provider).collect()}
    assert got == {"d0": False, "d1": True}


def test_lexical_correction(spark):
    rows = [(1, "Oesophagite et ulcere bulbaire"), (2, "GASTRIQEU"), (3, "Ramipril 500mg matin"), (4, None)]
    got = {r.id: (r.v, r.correction_ocr) for r in lexical.correct(spark.createDataFrame(rows, "id int, v string"), "v", "id").collect()}
    assert got == {1: ("Œsophagite et ulcère bulbaire", True), 2: ("GASTRIQUE", True), 3: ("Ramipril 500mg matin", False), 4: (None, False)}


def test_files(spark, tmp_path):
    (tmp_path / "a_p2.txt").write_bytes("été".encode("cp1252"))
    (tmp_path / "a_p1.txt").write_text("page é", encoding="utf-8")
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    (tmp_path / "t.tsv").write_text("code\tlibelle\nA\tb c\n", encoding="utf-8")
    path = str(tmp_path)
    assert [(r.page, r.text) for r in page_texts(spark, path).orderBy("page").collect()] == [(1, "page é"), (2, "été")]
    assert scans(spark, path, max_bytes=50).count() == 0 and oversized(spark, path, 50).count() == 1
    assert code_table(spark, f"{path}/t.tsv").first() == Row(code="A", libelle="b c")
    assert spark.createDataFrame([(b"\xe9",)], "c binary").select(decoded(F.col("c"))).first()[0] == "é"

    def provider():
        def read(content, path):
            yield "page", 0.9
            raise ValueError("illisible")

        return read

    rows = ocr_pages(scans(spark, path), provider).collect()
    assert [(r.page, r.text, r.error) for r in rows] == [(1, "page", None), (2, None, "ValueError: illisible")]
    assert synthetic_cases(spark).count() == 7


def test_streams(spark, tmp_path):
    from vitrail.streaming import front

    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    docs(spark, "mail a.b@c.fr", "rien").write.parquet(src)
    front.anonymized_stream(front.document_stream(spark, src), out, ck).awaitTermination()
    assert {r.text for r in spark.read.parquet(out).collect()} == {"mail [REDACTED:EMAIL]", "rien"}
    ev = spark.createDataFrame([("l", i, f"t{i}", "u", "e", "{}") for i in range(5)], "log string, id long, ts string, actor string, event string, payload string")
    for i in range(3):  # a file, and so an epoch, each
        ev.withColumn("id", F.col("id") + 5 * i).coalesce(1).write.mode("append").parquet(f"{src}2")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}2")
    front.audited(stream, f"{out}2", f"{ck}2").awaitTermination()
    entries = spark.read.parquet(f"{out}2/entries")
    assert front.audit_is_valid(spark, f"{out}2") and entries.count() == 15 and entries.where("prev_hash = 'GENESIS'").count() == 1
    for epoch in (1, 2):  # in the middle, and the last
        moved = tmp_path / f"gone{epoch}"
        (tmp_path / "out2" / "entries" / f"epoch={epoch}").rename(moved)
        assert not front.audit_is_valid(spark, f"{out}2")
        moved.rename(tmp_path / "out2" / "entries" / f"epoch={epoch}")
    assert front.audit_is_valid(spark, f"{out}2")


def test_pages_to_summary(spark):
    from vitrail.operators import chain

    body = [
        "Cabinet du Sommeil\nMOTIF : Gastrite chronique\nTRAITEMENTS EN COURS : OGAST 1 gél/j en permanence.",
        "Cabinet du Sommeil\nAntibiogramme : amoxicilline résistant",
        "Cabinet du Sommeil\nGastrite chronique connue\nFacteurs de risque : Tabagisme actif",
        "Cabinet du Sommeil\nAbsence de lésion polypoïde",
    ]
    p = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(body)], "document_id string, page int, text string")
    terms = {"Gastrite chronique": "problem", "OGAST": "treatment", "amoxicilline": "treatment", "Tabagisme actif": "problem", "lésion polypoïde": "problem", "Sommeil": "problem"}

    def provider():
        import re

        return lambda t: [(lab, m.start(), m.end(), 0.9) for w, lab in terms.items() for m in re.finditer(w, t)]

    out = chain.summarize(p, chain.Options(engine="drbert"), provider)
    got = {(r.section, r.valeur): r for r in out["fields"].collect()}
    assert set(got) == {("pathologies_actives", "Gastrite chronique"), ("traitements_long_cours", "OGAST 1 gél/j en permanence"), ("facteurs_risque", "Tabagisme actif")}
    assert got["pathologies_actives", "Gastrite chronique"].pages == [1, 3]
    rules = {r.valeur: r.regle for r in out["rejects"].collect()}
    assert rules["amoxicilline"] == "P1_page_non_prescriptive" and rules["lésion polypoïde"] == "N1_entite_niee"
    assert [r.page for r in out["rejected_pages"].collect()] == [2] and assemble.violations(out["vsm"]).count() == 0
    chain.release(out)
    assert out["held"] and not any(d.is_cached for d in out["held"])
    plain = chain.summarize(p)
    assert plain["vsm"].count() == 1 and "# Volet" in assemble.markdown(plain["vsm"]).first().markdown
    with pytest.raises(ValueError):
        chain.summarize(p, chain.Options(engine="ner"))
