"""Fixed values.

Everything here is a constant that results depend on. Values that have to equal
the behaviour being rebuilt (language list and codes, prompt text, tag and
placeholder texts, token pattern, decode caps) are written out plainly, in
their natural order. The glossary beyond its two documented rows and the demo
weight table are this project's own example artifacts.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES — languages (display name, model code), in interface order.
# The script and resource columns are this project's additions.
# ---------------------------------------------------------------------------
LOW_RESOURCE_LANGS = [
    ("Pashto", "ps_AF", "Arabic"),
    ("Xhosa", "xh_ZA", "Latin"),
    ("Nepali", "ne_NP", "Devanagari"),
    ("Sinhala", "si_LK", "Sinhala"),
    ("Burmese", "my_MM", "Myanmar"),
    ("Mongolian", "mn_MN", "Cyrillic"),
]
HIGH_RESOURCE = ("English", "en_XX", "Latin")
HIGH_RESOURCE_LANG = "en_XX"

# documents.lang (ISO 639-1) -> multilingual-model code, for the test tables.
DOC_LANG_CODES = [
    ("en", "en_XX"),
    ("es", "es_XX"),
    ("fr", "fr_XX"),
    ("de", "de_DE"),
]

# Codes the offline translator takes as source or target.
MODEL_CODES = [HIGH_RESOURCE_LANG, *(code for _, code, _ in LOW_RESOURCE_LANGS), *(code for _, code in DOC_LANG_CODES[1:])]

# ---------------------------------------------------------------------------
# FIXED VALUES — text processing
# ---------------------------------------------------------------------------
# Tokens: runs of two or more Unicode letters, digits or underscore, after
# lower-casing (the classic TF-IDF default). Same pattern in Spark and DuckDB.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_CHARS = r"\p{L}\p{N}_"

# Python str.strip() whitespace: \t \n \v \f \r, U+001C..U+001F, space, U+0085,
# U+00A0, U+1680, U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
BLANK_PATTERN = "^" + PY_WHITESPACE_CLASS + "*$"
WS_TOKEN_PATTERN = "[^" + PY_WHITESPACE_CLASS[1:-1] + "]+"


def python_regex(pattern: str) -> str:
    """Java/RE2 ``\\x{HH}`` escapes rewritten as Python ``\\uHHHH``."""
    import re
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: "\\u%04x" % int(m.group(1), 16), pattern)

# Preview lengths used in the error listing.
PREVIEW_CHARS = 120

# ---------------------------------------------------------------------------
# FIXED VALUES — rewriting prompt (system message, then the user's text)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a medical communication assistant. Rewrite the user's English sentence "
    "so that any layperson with no medical background can understand it. Replace "
    "technical medical terms with simple everyday descriptions (e.g. 'edema' -> "
    "'swelling caused by fluid', 'hypertension' -> 'high blood pressure'). "
    "Preserve the exact meaning and ALL negations (never drop a 'no', 'not', or "
    "'without'). Keep numbers, doses and units unchanged. Do not add information, "
    "warnings or explanations. Output ONLY the rewritten sentence, nothing else."
)

# Decode caps of the two model backends (new tokens / total length).
SIMPLIFY_MAX_NEW_TOKENS = 128
TRANSLATE_MAX_LENGTH = 200

# ---------------------------------------------------------------------------
# FIXED VALUES — transcript texts
# ---------------------------------------------------------------------------
TAG_MEDICAL = "médico"
TAG_NOT_MEDICAL = "no médico"
PLACEHOLDER_DOCTOR_FAILED = "⚠️ (error de traducción)"   # patient panel, doctor turn failed
PLACEHOLDER_PATIENT_FAILED = "⚠️ (translation error)"    # doctor panel, patient turn failed

# ---------------------------------------------------------------------------
# FIXED VALUES — output audits
# ---------------------------------------------------------------------------
NEGATION_WORDS = ["no", "not", "without"]
# What ends the clause that a negation stands in.
CLAUSE_ENDS = [".", ",", ";", ":", "!", "?", "and", "but", "or", "because", "if", "when", "while", "unless"]
# English words that carry no content of their own.
FUNCTION_WORDS = [
    "a", "an", "the", "this", "that", "these", "those", "it", "its", "he", "she", "they", "we", "you", "i", "his",
    "her", "their", "our", "your", "my", "him", "them", "us", "me", "who", "which", "what", "of", "in", "on", "at",
    "to", "for", "from", "by", "with", "as", "into", "than", "then", "so", "and", "or", "but", "if", "when", "while",
    "because", "unless", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "has", "have",
    "had", "will", "would", "can", "could", "shall", "should", "may", "might", "must", "there", "here", "very", "also",
]
# A number (with decimals) and the letters or % glued to it or after blanks: 500mg, 2.5 ml, 10%.
NUMBER_PATTERN = r"[0-9]+(?:[.,][0-9]+)*[ \t\x{A0}]*[\p{L}%]*"
# Words that count as the number's unit when blanks stand between them.
UNITS = ["%", "mg", "mcg", "µg", "μg", "ug", "g", "kg", "ml", "cl", "dl", "l", "mmol", "mol", "meq", "iu", "ui", "unit", "units",
         "mm", "cm", "m", "mmhg", "bpm", "tablet", "tablets", "capsule", "capsules", "drop", "drops",
         "puff", "puffs", "dose", "doses", "second", "seconds", "minute", "minutes", "hour", "hours",
         "day", "days", "week", "weeks", "month", "months", "year", "years"]

# Letters of a script as written in the two regex dialects (RE2: of a single letter).
SCRIPT_JAVA = {
    "Arabic": r"[\p{IsArabic}&&\p{L}]", "Latin": r"[\p{IsLatin}&&\p{L}]",
    "Devanagari": r"[\p{IsDevanagari}&&\p{L}]", "Sinhala": r"[\p{IsSinhala}&&\p{L}]",
    "Myanmar": r"[\p{IsMyanmar}&&\p{L}]", "Cyrillic": r"[\p{IsCyrillic}&&\p{L}]",
}
SCRIPT_RE2 = {
    "Arabic": r"\p{Arabic}", "Latin": r"\p{Latin}",
    "Devanagari": r"\p{Devanagari}", "Sinhala": r"\p{Sinhala}",
    "Myanmar": r"\p{Myanmar}", "Cyrillic": r"\p{Cyrillic}",
}

# ---------------------------------------------------------------------------
# Offline rewrite glossary (technical term -> plain words). The first two rows
# are the documented examples; the rest is this project's example list.
# ---------------------------------------------------------------------------
GLOSSARY = [
    ("edema", "swelling caused by fluid"),
    ("hypertension", "high blood pressure"),
    ("hypotension", "low blood pressure"),
    ("acute myocardial infarction", "sudden heart attack"),
    ("myocardial infarction", "heart attack"),
    ("dyspnea", "difficulty breathing"),
    ("tachycardia", "fast heartbeat"),
    ("bradycardia", "slow heartbeat"),
    ("pyrexia", "fever"),
    ("analgesic", "painkiller"),
    ("antipyretic", "fever medicine"),
    ("hyperglycemia", "high blood sugar"),
    ("hypoglycemia", "low blood sugar"),
    ("cephalalgia", "headache"),
    ("emesis", "vomiting"),
    ("pruritus", "itching"),
    ("syncope", "fainting"),
    ("renal", "kidney"),
    ("hepatic", "liver"),
    ("cardiac arrest", "stopped heart"),
    ("cerebrovascular accident", "stroke"),
    ("otitis media", "middle ear infection"),
    ("pharyngitis", "sore throat"),
    ("rhinorrhea", "runny nose"),
    ("contusion", "bruise"),
    ("laceration", "cut"),
    ("fracture", "broken bone"),
    ("benign", "not harmful"),
    ("malignant", "cancerous"),
    ("oral administration", "taking by mouth"),
    ("subcutaneous", "under the skin"),
    ("intravenous", "into a vein"),
    ("prophylaxis", "prevention"),
    ("edematous", "swollen"),
    ("anemia", "low red blood cells"),
    ("dermatitis", "skin inflammation"),
    ("gastroenteritis", "stomach flu"),
    ("hematoma", "pool of clotted blood"),
    ("nausea", "feeling sick"),
    ("paracetamol", "paracetamol (a painkiller)"),
]

# ---------------------------------------------------------------------------
# Offline phrase table for translation, one row a meaning: English, the six
# interface languages in their order, then Spanish, French, German. Empty where
# there is no entry. This project's example list; ``phrase_rows`` reads each
# row as English <-> interface language and European language -> English.
# ---------------------------------------------------------------------------
PHRASE_CODES = ["en_XX", "ps_AF", "xh_ZA", "ne_NP", "si_LK", "my_MM", "mn_MN", "es_XX", "fr_XX", "de_DE"]
PHRASES = [
    ("and", "او", "kunye", "र", "සහ", "နှင့်", "ба", "y", "et", "und"),
    ("this", "دا", "le", "यो", "මෙම", "ဒီ", "энэ", "este", "cette", "dieser"),
    ("no", "نه", "hayi", "होइन", "නැහැ", "မဟုတ်ဘူး", "үгүй", "no", "non", "nein"),
    ("yes", "هو", "ewe", "हो", "ඔව්", "ဟုတ်ကဲ့", "тийм", "sí", "oui", "ja"),
    ("today", "نن", "namhlanje", "आज", "අද", "ဒီနေ့", "өнөөдөр", "hoy", "aujourd'hui", "heute"),
    ("water", "اوبه", "amanzi", "पानी", "වතුර", "ရေ", "ус", "agua", "eau", "wasser"),
    ("pain", "درد", "intlungu", "दुखाइ", "වේදනාව", "နာကျင်မှု", "өвдөлт", "dolor", "douleur", "schmerz"),
    ("fever", "تبه", "ifiva", "ज्वरो", "උණ", "ဖျားနာခြင်း", "халууралт", "fiebre", "fièvre", "fieber"),
    ("doctor", "ډاکټر", "ugqirha", "डाक्टर", "වෛද්‍යවරයා", "ဆရာဝန်", "эмч", "médico", "médecin", "arzt"),
    ("medicine", "درمل", "iyeza", "औषधि", "බෙහෙත්", "ဆေး", "эм", "medicina", "médicament", "medizin"),
    ("blood pressure", "د وینې فشار", "uxinzelelo lwegazi", "रक्तचाप", "රුධිර පීඩනය", "သွေးဖိအား", "цусны даралт",
     "presión arterial", "tension artérielle", "blutdruck"),
    ("the", "", "", "", "", "", "", "el", "le", "der"),
    ("of", "", "", "", "", "", "", "de", "de", "von"),
    ("of the", "", "", "", "", "", "", "de la", "de la", "von der"),
    ("with", "", "", "", "", "", "", "con", "avec", "mit"),
    ("in", "", "", "", "", "", "", "en", "dans", "in"),
]


def phrase_rows() -> list[tuple[str, str, str, str]]:
    """``(src, tgt, phrase, translation)`` of the phrase table."""
    interface = {code for _, code, _ in LOW_RESOURCE_LANGS}
    out = []
    for row in PHRASES:
        for code, word in zip(PHRASE_CODES[1:], row[1:]):
            if word and code in interface:
                out.append((HIGH_RESOURCE_LANG, code, row[0], word))
            if word:
                out.append((code, HIGH_RESOURCE_LANG, word, row[0]))
    return out


# ---------------------------------------------------------------------------
# Demo weight table for the classifier (term, idf, coef) and its intercept.
# A fixed example model, not a trained one: it classifies the demo sentences
# and gives the oracle-checked queries a model both engines can apply. The
# function-word rows at the end (English positive; French, Spanish, German
# negative) make it separate the English positive corpus from the
# multilingual chat of the test tables, so both classes occur there.
# ---------------------------------------------------------------------------
DEMO_INTERCEPT = -0.25
DEMO_WEIGHTS = [
    ("doctor", 2.1, 1.2), ("pain", 2.4, 1.4), ("chest", 3.0, 0.8),
    ("chest pain", 3.6, 0.9), ("breathing", 3.1, 1.0),
    ("difficulty breathing", 3.9, 0.8), ("diagnosed", 3.2, 1.5),
    ("hypertension", 3.8, 1.6), ("stage", 2.9, 0.4), ("administer", 3.7, 1.3),
    ("paracetamol", 4.1, 1.6), ("500mg", 4.5, 0.8), ("mg", 3.3, 0.8),
    ("daily", 2.6, 0.5), ("twice", 2.8, 0.4), ("patient", 2.5, 1.2),
    ("medication", 2.9, 1.3), ("symptoms", 2.7, 1.2), ("fever", 3.0, 1.2),
    ("dose", 3.2, 1.1), ("treatment", 2.6, 1.1), ("infection", 3.0, 1.2),
    ("blood", 2.7, 0.9), ("pressure", 2.6, 0.6), ("blood pressure", 3.4, 0.9),
    ("heart", 2.8, 0.8), ("surgery", 3.1, 1.2), ("prescribed", 3.3, 1.2),
    ("acute", 3.4, 1.0), ("myocardial", 4.4, 1.4), ("infarction", 4.4, 1.4),
    ("dyspnea", 4.6, 1.4), ("edema", 4.3, 1.4), ("hospital", 2.9, 1.1),
    ("headache", 3.2, 1.2), ("cough", 3.3, 1.1), ("tablet", 3.4, 1.0),
    ("weekend", 3.0, -1.4), ("movie", 3.3, -1.4), ("enjoyed", 3.1, -1.0),
    ("last night", 3.5, -0.6), ("night", 2.4, -0.3), ("doing", 2.2, -0.7),
    ("what", 1.6, -0.4), ("really", 2.0, -0.5), ("weather", 3.2, -1.2),
    ("walk", 2.9, -0.9), ("nice", 2.5, -0.8), ("today", 2.1, -0.4),
    ("party", 3.2, -1.2), ("music", 3.0, -1.1), ("dinner", 3.1, -1.0),
    ("friends", 2.8, -0.9), ("holiday", 3.3, -1.1), ("shopping", 3.4, -1.1),
    ("the", 1.1, 0.3), ("and", 1.2, 0.3), ("of", 1.2, 0.3), ("with", 1.5, 0.3),
    ("was", 1.6, 0.3), ("that", 1.5, 0.2), ("is", 1.4, 0.2),
    ("le", 1.8, -0.6), ("la", 1.8, -0.6), ("les", 1.9, -0.6), ("des", 1.9, -0.6),
    ("el", 1.8, -0.6), ("los", 1.9, -0.6), ("que", 1.8, -0.6),
    ("der", 1.8, -0.6), ("die", 1.8, -0.6), ("und", 1.8, -0.6), ("das", 1.9, -0.6),
]
