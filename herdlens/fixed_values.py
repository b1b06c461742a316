"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced for results to match: keyword rule tables (in their rule order,
which breaks ties), label texts, UI domains, report labels and the default
missing-value tokens of a pandas CSV read. They are stated here once, as
plain text in natural order, and every operator takes them as parameters so
callers can pass their own tables instead.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- keep in this order; order is semantics (first match / ties).
# ---------------------------------------------------------------------------

# Symptom keyword -> quick label (first matching keyword wins).
SYMPTOM_LABEL_RULES: list[tuple[str, str]] = [
    ("fever", "Bacterial Infection"),
    ("cough", "Respiratory Infection"),
    ("diarrhea", "Gastroenteritis"),
    ("vomit", "Food Poisoning"),
    ("wound", "Skin Infection"),
    ("cold", "Viral Fever"),
    ("rashes", "Allergic Reaction"),
    ("eye infection", "Conjunctivitis"),
    ("weakness", "Anemia"),
    ("loss of appetite", "Digestive Disorder"),
]

# Variant of the quick-label table without the eye-infection rule.
SYMPTOM_LABEL_RULES_NO_EYE: list[tuple[str, str]] = [
    r for r in SYMPTOM_LABEL_RULES if r[0] != "eye infection"
]

# Disease -> keyword list, 26 diseases. Disease texts are output verbatim,
# including descriptions and trailing spaces.
DISEASE_KEYWORDS: list[tuple[str, list[str]]] = [
    ("viral infection ", ["fever", "weakness", "cough", "runny nose"]),
    ("worm infection : appear in parasitic infestations like tapeworm and hookworm",
     ["diarrhea", "weight loss", "worms", "bloating"]),
    ("avian influenza : viral respiratory diseases seen in poultry.",
     ["nasal discharge", "respiratory distress", "swelling", "cyanosis"]),
    ("rabies similaritiesn : with neurological disorders causing behavioral changes",
     ["aggression", "foaming", "paralysis", "biting"]),
    ("anthrax : hemorrhagic septicemia in severe cases",
     ["sudden death", "bloody discharge", "swelling"]),
    ("mastitis : sociated with bacterial udder infections in dairy animals",
     ["swollen udder", "udder pain", "milk change"]),
    ("fmd : vesicular stomatitis due to mouth and foot lesions",
     ["blisters", "mouth lesions", "foot lesions", "drooling"]),
    ("ppr : signs with rinderpest-like viral diseases in small ruminants",
     ["mouth ulcers", "diarrhea", "pneumonia", "ocular discharge"]),
    ("parvovirus : less in water content", ["vomiting", "bloody diarrhea", "dehydration", "lethargy"]),
    ("distemper : ", ["fever", "nasal discharge", "seizures", "neurological signs"]),
    ("leptospirosis", ["jaundice", "vomiting", "kidney failure", "muscle pain"]),
    ("brucellosis", ["abortion", "infertility", "swollen joints", "weakness"]),
    ("kennel cough", ["dry cough", "gagging", "sneezing", "nasal discharge"]),
    ("hemorrhagic septicemia", ["high fever", "swelling of throat", "difficulty breathing"]),
    ("black quarter", ["swollen limb", "lameness", "fever", "crepitus"]),
    ("rsv infection", ["coughing", "rapid breathing", "nasal discharge"]),
    ("canine influenza", ["cough", "fever", "nasal discharge", "lethargy"]),
    ("tick fever", ["pale gums", "high fever", "tick infestation", "weakness"]),
    ("babesiosis", ["dark urine", "anemia", "fever", "lethargy"]),
    ("theileriosis", ["swollen lymph nodes", "fever", "weakness", "labored breathing"]),
    ("scrapie", ["itching", "behavior changes", "tremors", "loss of coordination"]),
    ("enterotoxemia", ["sudden death", "diarrhea", "abdominal pain"]),
    ("colibacillosis", ["diarrhea", "dehydration", "poor growth"]),
    ("newcastle disease", ["twisted neck", "respiratory distress", "green diarrhea"]),
    ("canine hepatitis", ["fever", "abdominal pain", "vomiting", "jaundice"]),
    ("feline panleukopenia", ["vomiting", "bloody diarrhea", "severe dehydration"]),
]

# Reduced 6-disease table (scored "keyword in either symptom", +1 once).
DISEASE_KEYWORDS_SIX: list[tuple[str, list[str]]] = [
    ("viral infection", ["fever", "weakness", "cough", "runny nose"]),
    ("worm infection", ["diarrhea", "weight loss", "worms", "bloating"]),
    ("parvovirus", ["vomiting", "bloody diarrhea", "dehydration", "lethargy"]),
    ("distemper", ["fever", "nasal discharge", "seizures", "neurological signs"]),
    ("rabies", ["aggression", "foaming", "paralysis", "biting"]),
    ("anthrax", ["sudden death", "bloody discharge", "swelling"]),
]

# Older 8-disease table.
DISEASE_KEYWORDS_EIGHT: list[tuple[str, list[str]]] = [
    ("viral infection", ["fever", "weakness", "cough", "runny nose"]),
    ("worm infection", ["diarrhea", "weight loss", "worms", "bloating"]),
    ("avian influenza", ["nasal discharge", "respiratory distress", "swelling", "cyanosis"]),
    ("rabies", ["aggression", "foaming", "paralysis", "biting"]),
    ("anthrax", ["sudden death", "bloody discharge", "swelling"]),
    ("mastitis", ["swollen udder", "udder pain", "milk change"]),
    ("fmd", ["blisters", "mouth lesions", "foot lesions", "drooling"]),
    ("ppr", ["mouth ulcers", "diarrhea", "pneumonia", "ocular discharge"]),
]

# Fallback texts when no keyword scores (one per table variant).
NO_MATCH_LABEL = "More test recommended"
NO_MATCH_LABEL_SIX = "More tests recommended"
NO_MATCH_LABEL_EIGHT = "Unknown Disease"

# Outcome labelling.
FATAL_DISEASES: list[str] = ["Rabies", "Anthrax", "PPR (Peste des petits ruminants)"]
OUTCOME_FATAL = "Will Not Live"
OUTCOME_LIVE = "Will Live"

# Combined diagnosis markers.
RULE_MARK = " 🔴"
MODEL_MARK = " 🟢"
PARSE_ERROR_LABEL = "Healthy 🟢"

# Vaccine catalogue shown for every animal: (group, vaccine), in display order.
VACCINE_CATALOGUE: list[tuple[str, str]] = [
    ("Large Animals", "FMD"),
    ("Large Animals", "HS"),
    ("Large Animals", "BQ"),
    ("Large Animals", "Anthrax"),
    ("Large Animals", "Tetanus (Horses)"),
    ("Small Animals", "Rabies"),
    ("Small Animals", "Parvo"),
    ("Small Animals", "Distemper"),
    ("Small Animals", "Leptospirosis"),
    ("Small Animals", "Feline Panleukopenia"),
]

# Our own species -> catalogue group mapping (the catalogue-by-species feature
# is promised without code, so this mapping is a choice, not a reproduced value).
SPECIES_SIZE_GROUP: list[tuple[str, str]] = [
    ("Cat", "Small Animals"),
    ("Buffalo", "Large Animals"),
    ("Goat", "Large Animals"),
    ("Sheep", "Large Animals"),
    ("Dog", "Small Animals"),
    ("Hen", "Small Animals"),
    ("Cow", "Large Animals"),
]

# UI form domains.
SPECIES_CHOICES = ["Cat", "Buffalo", "Goat", "Sheep", "Dog", "Hen", "Cow"]
SEX_CHOICES = ["Male", "Female"]
HEALTH_STATUS_CHOICES = [
    "Sick", "Cold", "Tired", "Cough", "Under Treatment", "Diarrhea", "Fever", "Dizzy",
    "Vaccinated", "Running Nose", "Healthy",
]
SYMPTOM_1_CHOICES = [
    "None", "Aggression", "Abortion", "Sudden death", "Blisters on mouth", "Swollen udder",
    "Fever", "Cough", "Sneezing", "Vomiting",
]
SYMPTOM_2_CHOICES = [
    "None", "Salivation", "Joint swelling", "Bloody discharge", "Drooling",
    "Reduced milk yield", "Mouth lesions", "Nasal discharge", "Ulcers in mouth", "Diarrhea",
]

# Health verdict messages.
VERDICT_HEALTHY = "🟢 The animal appears healthy."
VERDICT_ATTENTION = "🔴 The animal may need medical attention."

# Header names of the record file -> column names.
RECORD_HEADERS: dict[str, str] = {
    "Animal ID": "animal_id",
    "Name": "name",
    "Species": "species",
    "Breed": "breed",
    "Sex": "sex",
    "Age (years)": "age_years",
    "Age": "age",
    "BP": "bp",
    "Heart Rate (bpm)": "heart_rate",
    "Heart Rate": "heart_rate_bpm",
    "Oxygen Saturation (%)": "oxygen_saturation_pct",
    "Oxygen Saturation": "oxygen_saturation",
    "Health Status": "health_status",
    "Symptom 1": "symptom_1",
    "Symptom 2": "symptom_2",
    "Disease": "disease",
    "Detected Disease": "detected_disease",
    "Doctor Suggestion": "doctor_suggestion",
    "Vaccination 1": "vaccination_1",
    "Vaccination 2": "vaccination_2",
    "Special Care": "special_care",
}

# Columns that hold the same field, in the order they are looked at.
AGE_NAMES = ["age_years", "age"]
HEART_RATE_NAMES = ["heart_rate", "heart_rate_bpm"]
OXYGEN_NAMES = ["oxygen_saturation_pct", "oxygen_saturation"]

# Feature columns of the models.
NUMERIC_FEATURES = ["heart_rate", "bp_systolic", "bp_diastolic"]
CATEGORICAL_FEATURES = ["species", "breed", "sex", "health_status", "symptom_1", "symptom_2"]

# Scan text without an id.
NO_ID_STATUS = "QR scanned but no ID found."

# Report: 13 ordered line labels.
REPORT_LABELS: list[str] = [
    "Name", "Breed", "Age (years)", "BP", "Heart Rate (bpm)", "Oxygen Saturation (%)",
    "Symptoms", "Detected Disease", "Model Accuracy", "Vaccination 1", "Vaccination 2",
    "Doctor Suggestion", "Special Care",
]

# Missing-value text of a display slot whose column does not exist.
ABSENT_SLOT = "—"

# Default missing-value tokens of pandas.read_csv (besides the empty field).
PANDAS_NA_TOKENS: list[str] = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Characters removed by Python's str.strip() with no argument.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Number grammars accepted by float() / int() (without nan/inf/underscore forms).
FLOAT_PATTERN = r"^ *[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)? *$"
INT_PATTERN = r"^ *[+-]?[0-9]+ *$"

# Test split: 20 % test rows.
TEST_FRACTION_BUCKETS = 5

# Free-text rules used for the long-text case (language-ish markers).
TEXT_RULES: list[tuple[str, list[str]]] = [
    ("english", ["there", "ation", "was"]),
    ("french", ["que", "ation"]),
    ("german", ["sch", "ung"]),
]
TEXT_NO_MATCH_LABEL = NO_MATCH_LABEL
