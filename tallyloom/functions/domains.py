"""Closed vocabularies and lookup tables, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Field domains, admission tags, tri-state fields, negation cues, section names and their other names.
TRISTATE = ("yes", "no", "not_documented")
ENUMS = {
    "functional_status": ("independent", "assisted", "dependent", "not_documented"),
    "mental_status": ("intact", "mild_impairment", "confused_delirious", "not_documented"),
    "discharge_condition_category": ("stable", "improved", "unchanged", "deteriorated", "expired", "not_documented"),
}
TAGS = (
    "cardiac_hf", "cardiac_acs", "cardiac_arrhythmia", "cardiac_htn_emergency", "cardiac_valve_disease", "cardiac_other",
    "respiratory_infection", "respiratory_copd_asthma_exacerbation", "respiratory_pe_dvt", "respiratory_failure_other",
    "gi_bleed", "gi_obstruction_ileus", "gi_pancreatitis", "gi_ibd_colitis", "hepatic_failure_cirrhosis", "gi_other",
    "renal_aki", "renal_ckd_esrd_crisis", "gu_infection", "gu_other",
    "sepsis_bacteremia", "infection_skin_soft_tissue", "infection_cns", "infection_other",
    "neuro_stroke_tia", "neuro_seizure", "neuro_altered_mental_status", "neuro_other",
    "metabolic_dka_hhs", "metabolic_electrolyte_crisis", "endocrine_other",
    "heme_anemia_bleed", "heme_onc_complication", "oncology_elective_treatment",
    "trauma_fracture", "trauma_other", "msk_non_trauma",
    "psych_mood_anxiety", "psych_psychosis_crisis", "substance_intoxication_withdrawal", "substance_overdose",
    "symptom_workup_chest_pain", "symptom_workup_syncope", "symptom_workup_other",
    "elective_procedure_non_oncology", "obstetric", "other",
)
TRISTATE_FIELDS = (
    "shock_present", "infection_as_trigger", "aki_present", "lives_alone", "social_support_absent", "financial_hardship",
    "substance_use_active", "fall_risk_documented", "cognitive_impairment", "goals_of_care_flag", "palliative_care_consult",
    "dnr_dni_documented", "home_health_ordered", "cardiac_rehab_referred", "discharge_delayed_reason",
    "hospital_acquired_complication", "unresolved_diagnosis_at_discharge",
)
NEGATION_CUES = ("no ", "not ", "denies", "denied", "without", "neg for ", "negative for ")
NEGATION_WINDOW = 30
SECTION_ALIASES = {
    "Brief Hospital Course": ("Brief Hospital Course", "Hospital Course", "Active Issues"),
    "History of Present Illness": ("History of Present Illness", "HPI", "Presenting Illness"),
    "Past Medical History": ("Past Medical History", "PMH"),
    "Social History": ("Social History", "Social Hx"),
    "Discharge Medications": ("Discharge Medications", "Discharge Meds"),
    "Discharge Disposition": ("Discharge Disposition", "Disposition"),
    "Discharge Condition": ("Discharge Condition",),
    "Discharge Diagnosis": ("Discharge Diagnosis", "Discharge Diagnoses", "Final Diagnosis"),
    "Discharge Instructions": ("Discharge Instructions",),
    "Physical Exam": ("Physical Exam", "Physical Examination", "Admission Exam", "Discharge Exam"),
    "Chief Complaint": ("Chief Complaint", "CC"),
    "Pertinent Results": ("Pertinent Results", "Labs", "Results"),
    "Medications on Admission": ("Medications on Admission", "Admission Meds"),
}
UNMAPPED = "ZZ. Unmapped"
# Code chapters as (version, first, last, chapter); version 10 by letter and two digits, version 9 by three
# digits or a leading V or E.
CHAPTERS = (
    (10, "A00", "B99", "I. Infectious"), (10, "C00", "D48", "II. Neoplasms"), (10, "D50", "D89", "III. Blood/immune"),
    (10, "E00", "E99", "IV. Endocrine/metabolic"), (10, "F00", "F99", "V. Mental"), (10, "G00", "G99", "VI. Nervous"),
    (10, "H00", "H59", "VII. Eye"), (10, "H60", "H95", "VIII. Ear"), (10, "I00", "I99", "IX. Circulatory"),
    (10, "J00", "J99", "X. Respiratory"), (10, "K00", "K99", "XI. Digestive"), (10, "L00", "L99", "XII. Skin"),
    (10, "M00", "M99", "XIII. Musculoskeletal"), (10, "N00", "N99", "XIV. Genitourinary"), (10, "O00", "O99", "XV. Pregnancy"),
    (10, "P00", "P99", "XVI. Perinatal"), (10, "Q00", "Q99", "XVII. Congenital"), (10, "R00", "R99", "XVIII. Symptoms/signs"),
    (10, "S00", "T99", "XIX. Injury/poisoning"), (10, "V00", "Y99", "XX. External causes"), (10, "Z00", "Z99", "XXI. Factors influencing health"),
    (9, "001", "139", "I. Infectious"), (9, "140", "239", "II. Neoplasms"), (9, "240", "279", "IV. Endocrine/metabolic"),
    (9, "280", "289", "III. Blood/immune"), (9, "290", "319", "V. Mental"), (9, "320", "389", "VI./VII./VIII. Nervous/Eye/Ear"),
    (9, "390", "459", "IX. Circulatory"), (9, "460", "519", "X. Respiratory"), (9, "520", "579", "XI. Digestive"),
    (9, "580", "629", "XIV. Genitourinary"), (9, "630", "679", "XV. Pregnancy"), (9, "680", "709", "XII. Skin"),
    (9, "710", "739", "XIII. Musculoskeletal"), (9, "740", "759", "XVII. Congenital"), (9, "760", "779", "XVI. Perinatal"),
    (9, "780", "799", "XVIII. Symptoms/signs"), (9, "800", "999", "XIX. Injury/poisoning"),
    (9, "E", "E", "XX. External causes"), (9, "V", "V", "XXI. Factors influencing health"),
)
#: Prices of a million tokens, read and written.
PRICE_IN, PRICE_OUT = 0.20, 1.25


def tag_table(spark: SparkSession) -> DataFrame:
    """The tags and their order."""
    return spark.createDataFrame(list(enumerate(TAGS)), "tag_index int, tag string")
