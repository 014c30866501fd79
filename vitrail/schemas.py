"""Schemas of the tables that operators exchange.  Offsets are code points."""

from __future__ import annotations

PAGE = "document_id string, page int, text string, confidence double, error string"
OCR_WORD = "document_id string, page int, block int, par int, line int, word int, text string, conf double"
SPAN = "pii_type string, start int, end int, value string, confidence double, method string, context string, seq int"
NER_TOKEN = "document_id string, start int, end int, type string, score double, is_b boolean"
NER_ENTITY = "document_id string, label string, texte string, debut int, fin int, score double"
FIELD = (
    "document_id string, section string, valeur string, confiance double, passage string, offset_debut int, "
    "offset_fin int, moteur_nlp string, origine string, mention_contexte string, page int"
)
CODE = "struct<systeme:string,code:string,libelle_officiel:string,confiance_normalisation:double,a_verifier:boolean>"
AUDIT = "log string, id long, ts string, actor string, event string, payload string, prev_hash string, entry_hash string"

#: Sections in the order of the summary, and the states it can have.
SECTIONS = (
    "pathologies_actives", "antecedents", "allergies", "traitements_long_cours", "facteurs_risque", "vaccinations",
    "points_vigilance",
)
STATES = ("brouillon", "a_valider", "valide", "signe")
