"""Code lists, word lists and patterns the results depend on.

Everything in this module is a fixed value (public terminology codes, word lists,
regular expressions).  No logic lives here.
"""

# --- resource types ---------------------------------------------------------
RESOURCE_TYPES = (
    "Condition",
    "Observation",
    "MedicationRequest",
    "Procedure",
    "AllergyIntolerance",
    "FamilyMemberHistory",
)
PATIENT_LEVEL_TYPES = ("Condition", "MedicationRequest", "AllergyIntolerance", "FamilyMemberHistory")
ENCOUNTER_LEVEL_TYPES = ("Observation", "Procedure")
PATIENT_LINKED_TYPES = (
    "Condition",
    "MedicationRequest",
    "AllergyIntolerance",
    "Observation",
    "FamilyMemberHistory",
    "Procedure",
    "Encounter",
    "Practitioner",
    "Organization",
    "DocumentReference",
    "Provenance",
)
DISCONTINUED_STATUSES = ("stopped", "cancelled", "completed", "entered-in-error")

# --- code systems: key -> URI ----------------------------------------------
SYSTEM_URIS = {
    "snomed": "http://snomed.info/sct",
    "loinc": "http://loinc.org",
    "rxnorm": "http://www.nlm.nih.gov/research/umls/rxnorm",
    "icd10": "http://hl7.org/fhir/sid/icd-10-cm",
    "icd10pcs": "http://www.cms.gov/Medicare/Coding/ICD10",
    "hcpcs": "http://www.cms.gov/Medicare/Coding/HCPCSReleaseCodeSets",
    "cpt": "http://www.ama-assn.org/go/cpt",
    "icdo3": "http://terminology.hl7.org/CodeSystem/icd-o-3",
    "ncit": "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl",
    "hgnc": "http://www.genenames.org",
    "hgvs": "http://varnomen.hgvs.org",
    "sequenceontology": "http://www.sequenceontology.org/",
    "ucum": "http://unitsofmeasure.org",
}
RETRIEVABLE_SYSTEMS = ("snomed", "loinc", "rxnorm", "icd10", "icd10pcs", "hcpcs")
UMLS_SOURCES = {"snomed": "SNOMEDCT_US", "icd10pcs": "ICD10PCS", "hcpcs": "HCPCS"}
LOINC = SYSTEM_URIS["loinc"]
SNOMED = SYSTEM_URIS["snomed"]
ICD10CM = SYSTEM_URIS["icd10"]
UCUM = SYSTEM_URIS["ucum"]

DEFAULT_SYSTEMS = {
    "Condition": ("snomed", "icd10"),
    "MedicationRequest": ("rxnorm",),
    "Procedure": ("snomed", "icd10pcs", "hcpcs"),
    "AllergyIntolerance": ("snomed",),
    "FamilyMemberHistory": ("snomed",),
}

NKDA_CODE = "409137002"
TOBACCO_LOINC = "72166-2"
BP_LOINC = "85354-9"
OCCUPATION_LOINC = "11341-5"
SEXUAL_ORIENTATION_LOINC = "76690-7"

# --- severity words stripped from the head of a name --------------------------
NAME_PREFIXES = ("essential", "chronic", "acute", "mild", "moderate", "severe", "minor")
DISPLAY_PREFIXES = NAME_PREFIXES + ("primary",)

# --- drug display clean-up, applied in this order on lower-case text ----------
INGREDIENT_STEPS = (
    (r"^product containing(?:\s+precisely)?\s+", ""),
    (r"\s*/\d+\s+each\s+.*$", ""),
    (r"\s*\([^)]*\)\s*", " "),
    (
        r"\s+\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?\s*"
        r"(?:milligrams?|micrograms?|grams?|milliliters?|mg|mcg|g|ml)\b",
        " ",
    ),
    (
        r"\b(?:anhydrous|monohydrate|dihydrate|trihydrate|sodium|potassium|calcium|"
        r"hydrochloride|hcl|sulfate|sulphate|maleate|tartrate|succinate|fumarate|"
        r"hemifumarate|mesylate|besylate|acetate|citrate|"
        r"oral tablet|oral capsule|oral solution|injectable solution|"
        r"conventional release|extended release|delayed release)\b",
        " ",
    ),
    (r"\s+\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?\s*(?:mg|mcg|g|ml|units?|%)\b.*", ""),
    (r"\s+and\s+", " / "),
    (r"\s*/\s*", " / "),
    (r"\s+", " "),
)
DOSE_UNIT_TAIL = r"(?i)\s*(?:milligrams?|micrograms?|grams?|milliliters?|mg|mcg|g|ml|units?|%)\s*$"
DOSE_IN_TEXT = r"(?i)(\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?)\s*(?:mg|mcg|g|ml)\b"

# --- tobacco status -----------------------------------------------------------
TOBACCO_CURRENT = (
    "current every day smoker",
    "current some day smoker",
    "ongoing",
    "active",
    "smoker",
    "current smoker",
    "light tobacco smoker",
    "heavy tobacco smoker",
)
TOBACCO_CURRENT_PARTS = ("current", "ongoing", "active", "every day")
TOBACCO_FORMER = ("former smoker", "quit", "former", "tobacco-free", "ex-smoker", "quit smoking")
TOBACCO_FORMER_PARTS = ("former", "quit", "tobacco-free", "ex-")
TOBACCO_NEVER = ("never smoker", "never", "non-smoker")
TOBACCO_NEVER_PARTS = ("never",)
TOBACCO_SNOMED = (
    ("current", "449868002", "Current every day smoker"),
    ("ongoing", "449868002", "Current every day smoker"),
    ("active", "449868002", "Current every day smoker"),
    ("former", "8517006", "Former smoker"),
    ("quit", "8517006", "Former smoker"),
    ("never", "266919005", "Never smoker"),
    ("non-smoker", "266919005", "Never smoker"),
)

# --- fixed LOINC terms: term, code, display (order matters) ---------------------
SMOKING_TERMS = ("tobacco", "smoking")
SMOKING_CODING = (TOBACCO_LOINC, "Tobacco smoking status")
US_CORE_FIXED = (
    ("blood pressure", "85354-9", "Blood pressure panel with all children optional"),
    ("bp", "85354-9", "Blood pressure panel with all children optional"),
    ("systolic", "8480-6", "Systolic blood pressure"),
    ("diastolic", "8462-4", "Diastolic blood pressure"),
    ("body weight", "29463-7", "Body weight"),
    ("body height", "8302-2", "Body height"),
    ("body temperature", "8310-5", "Body temperature"),
    ("heart rate", "8867-4", "Heart rate"),
    ("respiratory rate", "9279-1", "Respiratory rate"),
    ("bmi", "39156-5", "Body mass index"),
    ("pulse oximetry", "59408-5", "Oxygen saturation by pulse oximetry"),
    ("oxygen saturation", "2708-6", "Oxygen saturation in arterial blood"),
    ("spo2", "2708-6", "Oxygen saturation in arterial blood"),
    ("head circumference", "9843-4", "Head circumference"),
    ("occupation", "11341-5", "History of Occupation"),
    ("sexual orientation", "76690-7", "Sexual orientation"),
)

# --- family roles: relationship, code, display ------------------------------------
ROLE_SYSTEM = "http://terminology.hl7.org/CodeSystem/v3-RoleCode"
FAMILY_ROLES = (
    ("father", "FTH", "father"),
    ("mother", "MTH", "mother"),
    ("brother", "BRO", "brother"),
    ("sister", "SIS", "sister"),
    ("son", "SON", "natural son"),
    ("daughter", "DAU", "natural daughter"),
    ("maternal grandmother", "MGRMTH", "maternal grandmother"),
    ("maternal grandfather", "MGRFTH", "maternal grandfather"),
    ("paternal grandmother", "PGRMTH", "paternal grandmother"),
    ("paternal grandfather", "PGRFTH", "paternal grandfather"),
    ("grandmother", "GRMTH", "grandmother"),
    ("grandfather", "GRFTH", "grandfather"),
    ("uncle", "UNCLE", "uncle"),
    ("aunt", "AUNT", "aunt"),
    ("cousin", "COUSN", "cousin"),
    ("spouse", "SPS", "spouse"),
    ("husband", "HUSB", "husband"),
    ("wife", "WIFE", "wife"),
)

# --- oncology observation concepts (order matters) ----------------------------------
NCIT = SYSTEM_URIS["ncit"]
ONCOLOGY_CONCEPTS = (
    # terms, system, code, display, profile slug, value kind
    (("ecog",), LOINC, "89247-1", "ECOG performance status", "ecog-performance-status", "integer"),
    (("karnofsky",), LOINC, "89243-0", "Karnofsky Performance Status score", "karnofsky-performance-status", "integer"),
    (("cancer disease status", "disease status"), LOINC, "97509-4", "Cancer disease status", "cancer-disease-status", "codeable"),
    (
        ("histologic grade", "histological grade", "tumor grade", "tumour grade", "nuclear grade"),
        NCIT, "C18000", "Grade", "histologic-grade", "codeable",
    ),
    (
        ("histologic behavior", "histologic type", "histology and behavior"),
        LOINC, "31206-6", "Histology and behavior ICD-O-3", "histologic-behavior-and-type", "codeable",
    ),
    (
        ("tnm stage", "ajcc stage", "stage group", "overall stage", "cancer stage", "tumor stage",
         "pathologic stage", "clinical stage", "stage"),
        LOINC, "21908-9", "Stage group.clinical Cancer", "tnm-stage-group", "codeable",
    ),
    (
        ("tumor size", "tumor greatest dimension", "greatest dimension", "tumor dimension",
         "tumor maximum dimension", "size of tumor", "mass size", "size of mass"),
        LOINC, "21889-1", "Size.maximum dimension Tumor", "tumor-size", "quantity",
    ),
)
TNM_TOKEN = r"(?i)^\s*([cpyr]*)([tnm])(is|x|\d[a-d]?)\s*$"
TNM_CODES = (
    # letter, pathologic?, code, display, profile slug
    ("T", False, "21905-5", "Primary tumor.clinical [Class] Cancer", "tnm-primary-tumor-category"),
    ("T", True, "21899-0", "Primary tumor.pathology [Class] Cancer", "tnm-primary-tumor-category"),
    ("N", False, "21906-3", "Regional lymph nodes.clinical [Class] Cancer", "tnm-regional-nodes-category"),
    ("N", True, "21900-6", "Regional lymph nodes.pathology [Class] Cancer", "tnm-regional-nodes-category"),
    ("M", False, "21907-1", "Distant metastases.clinical [Class] Cancer", "tnm-distant-metastases-category"),
    ("M", True, "21901-4", "Distant metastases.pathology [Class] Cancer", "tnm-distant-metastases-category"),
)
# marker family, squeezed long forms, short pattern, code, display
MARKER_FAMILIES = (
    ("HER2", ("her2neu", "her2", "epidermalgrowthfactorreceptor2"), r"(?i)\bher2\b",
     "18474-7", "HER2 Ag [Presence] in Tissue by Immune stain"),
    ("ER", ("estrogenreceptor",), r"(?i)\ber\b",
     "16112-5", "Estrogen receptor [Interpretation] in Tissue"),
    ("PR", ("progesteronereceptor",), r"(?i)\bpr\b",
     "16113-3", "Progesterone receptor [Interpretation] in Tissue"),
    ("KI67", ("ki67", "mib1"), r"(?i)\bki[\s-]?67\b",
     "29593-1", "Cells.Ki-67 nuclear Ag/cells in Tissue by Immune stain"),
)
MARKER_SHORT_ORDER = ("HER2", "KI67", "ER", "PR")
MARKER_LONG_FORMS = (
    "estrogenreceptor", "progesteronereceptor", "her2", "her2neu", "epidermalgrowthfactorreceptor",
    "prostatespecificantigen", "carcinoembryonicantigen", "alphafetoprotein", "humanchorionicgonadotropin",
    "choriogonadotropin", "hcg", "ca153", "ca2729", "ca125", "ca199", "ki67", "tumormarker",
)
MARKER_SHORT_FORMS = r"(?i)\b(?:er|pr|her2|psa|cea|afp|hcg|ki[\s-]?67)\b"
MARKER_SEPARATORS = r"[\s\-/,]+"
NEGATIVE_WORDS = ("negative", "non-reactive", "nonreactive", "not detected", "not amplified")
POSITIVE_WORDS = ("positive", "reactive", "detected", "overexpress", "amplified")
ROLE_TUMOR_MARKER = "tumor-marker"

# --- cancer conditions -----------------------------------------------------------------
CANCER_TERMS = (
    "cancer", "carcinoma", "melanoma", "lymphoma", "leukemia", "leukaemia", "sarcoma", "myeloma",
    "blastoma", "glioma", "mesothelioma", "malignant", "malignancy", "seminoma", "germinoma",
)
SECONDARY_TERMS = ("secondary", "metastatic", "metastasis", "metastases", "metastat")
SITE_STOPWORDS = (
    "left", "right", "bilateral", "region", "structure", "area", "site", "the", "of", "lobe", "upper",
    "lower", "outer", "inner", "quadrant", "proximal", "distal", "anterior", "posterior",
)

# --- dates, numbers ------------------------------------------------------------------------
PARTIAL_DATE = r"^\d{4}(-\d{2}(-\d{2})?)?$"
NUMBER_WITH_COMPARATOR = r"^([<>≤≥]?)\s*([\d.]+)$"
COMPARATORS = {"<": "<", ">": ">", "≤": "<=", "≥": ">="}
UCUM_CODES = {
    "%": "%", "mg": "mg", "mg/dL": "mg/dL", "g/dL": "g/dL", "mEq/L": "meq/L", "mmol/L": "mmol/L",
    "ng/mL": "ng/mL", "mmHg": "mm[Hg]", "kg": "kg", "cm": "cm", "mm": "mm", "bpm": "/min",
    "breaths/min": "/min", "kg/m2": "kg/m2",
}

# --- search back-off -----------------------------------------------------------------------
LEADING_STOPWORDS = ("of", "the", "a", "an", "with", "for", "in", "and")

# Clean-ups of a search term, one variant each: pattern, replacement.
VARIANT_STEPS = (
    (r"(?i)\b(?:left|right|bilateral)\b", " "),
    (r"\s*\([^)]*\)\s*$", ""),
    (r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|units?)\b", " "),
    (r"(?i)^\s*(?:severe|moderate|mild|acute|chronic)\s+", ""),
    (r"(?i),?\s*\b(?:nos|unspecified)\s*$", ""),
)
ABBREVIATIONS = (
    ("htn", "hypertension"), ("dm2", "type 2 diabetes mellitus"), ("cad", "coronary artery disease"),
    ("chf", "congestive heart failure"), ("copd", "chronic obstructive pulmonary disease"), ("ckd", "chronic kidney disease"),
    ("afib", "atrial fibrillation"), ("gerd", "gastroesophageal reflux disease"), ("mi", "myocardial infarction"),
    ("dvt", "deep vein thrombosis"), ("pe", "pulmonary embolism"), ("tia", "transient ischemic attack"),
    ("uti", "urinary tract infection"), ("osa", "obstructive sleep apnea"), ("ra", "rheumatoid arthritis"),
)
SEMANTIC_TAGS = r"\((?:disorder|finding|procedure|product|substance|situation|qualifier value)\)"

# --- verification maps -----------------------------------------------------------------------
CONDITION_VERIFICATION = {"definite": "confirmed", "probable": "provisional", "uncertain": "unconfirmed"}
ALLERGY_VERIFICATION = {"definite": "confirmed", "probable": "unconfirmed", "uncertain": "unconfirmed"}
ALLERGY_VERIFICATION_CODES = ("unconfirmed", "confirmed", "refuted", "entered-in-error")

# --- guardrail -------------------------------------------------------------------------------
MAX_NOTE_BYTES = 256 * 1024
MIN_PRINTABLE_RATIO = 0.85

# --- model prices, USD per million tokens: model, input, cached, output ---------------------
MODEL_RATES = (
    ("gemini-3.5-flash", "1.50", "0.15", "9.00"),
    ("gemini-3.1-flash-lite", "0.25", "0.025", "1.50"),
)
REGIONAL_UPLIFT = "1.10"

# --- profiles -----------------------------------------------------------------------------------
US_CORE = "http://hl7.org/fhir/us/core/StructureDefinition/"
US_CORE_NAMESPACE = "http://hl7.org/fhir/us/core/"
RESOURCE_PROFILES = {
    "Condition-problem": US_CORE + "us-core-condition-problems-health-concerns",
    "Condition-encounter": US_CORE + "us-core-condition-encounter-diagnosis",
    "MedicationRequest": US_CORE + "us-core-medicationrequest",
    "Procedure": US_CORE + "us-core-procedure",
    "AllergyIntolerance": US_CORE + "us-core-allergyintolerance",
    "Provenance": US_CORE + "us-core-provenance",
    "DocumentReference": US_CORE + "us-core-documentreference",
}
OBSERVATION_PROFILES = {
    "vital-signs": US_CORE + "us-core-vital-signs",
    "laboratory": US_CORE + "us-core-observation-lab",
    "survey": US_CORE + "us-core-observation-screening-assessment",
    "exam": US_CORE + "us-core-simple-observation",
    "imaging": US_CORE + "us-core-observation-clinical-result",
    "bp": US_CORE + "us-core-blood-pressure",
    "smokingstatus": US_CORE + "us-core-smokingstatus",
    "occupation": US_CORE + "us-core-observation-occupation",
    "sexual-orientation": US_CORE + "us-core-observation-sexual-orientation",
    "social-history": US_CORE + "us-core-simple-observation",
    "heart-rate": US_CORE + "us-core-heart-rate",
    "respiratory-rate": US_CORE + "us-core-respiratory-rate",
    "body-temperature": US_CORE + "us-core-body-temperature",
    "body-weight": US_CORE + "us-core-body-weight",
    "body-height": US_CORE + "us-core-body-height",
    "bmi": US_CORE + "us-core-bmi",
    "pulse-oximetry": US_CORE + "us-core-pulse-oximetry",
    "head-circumference": US_CORE + "us-core-head-circumference",
}
VITAL_PROFILE_BY_LOINC = {
    "8867-4": "heart-rate",
    "9279-1": "respiratory-rate",
    "8310-5": "body-temperature",
    "29463-7": "body-weight",
    "8302-2": "body-height",
    "39156-5": "bmi",
    "59408-5": "pulse-oximetry",
    "9843-4": "head-circumference",
}

# --- sentence splitter ------------------------------------------------------------------------------
SENTENCE_ABBREVIATIONS = (
    "Dr", "Mr", "Mrs", "Ms", "Prof", "Rev", "MD", "PhD", "DO", "DDS", "RN", "NP", "PA", "MA", "MS", "BSN",
    "MPH", "No", "Pt", "St", "Ave", "Blvd", "Dept", "Fig", "Inc", "Ltd", "Corp", "vs", "etc", "ie", "eg",
    "et al", "qd", "q.d", "qhs", "q.h.s", "bid", "b.i.d", "tid", "t.i.d", "qid", "q.i.d", "prn", "p.r.n",
    "qam", "qpm", "qod", "q.o.d",
)
SENTENCE_BOUNDARY = (
    r"\.\s+(?=[A-Z])|\.\n|(?<!:)\n(?=[A-Z][a-z])|(?<!:)\n(?=[A-Z]{2,}(?:\s|$))|\n(?=\|)"
)
LIST_MARKERS = (r"(\d+)\.", r"([a-z])[.)]", r"([A-Z])[.)]", r"(i{1,3}|iv|v|vi{0,3}|ix|x)\.")
ROMAN_NUMERALS = (
    "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x",
    "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx",
)
LIST_MARKER_REACH = 200

# --- review queue order -----------------------------------------------------------------------------
TIER_ORDER = ("ATTENTION", "REVIEW", "CONFIDENT")
CLASSIFICATIONS = ("NEW", "DUPLICATE", "UPDATING", "CONFLICTING")
