"""Word lists, patterns, formats and limits that results depend on.

Everything in this module is data. Lexicons are defaults; every operator that uses
one takes it as a parameter.
"""

# --- fixed values: chunking -------------------------------------------------
SENTENCE_ABBREVIATIONS = [
    "e.g.", "i.e.", "dr.", "mr.", "mrs.", "ms.", "vs.", "fig.", "tab.",
    "no.", "vol.", "p.", "pp.", "approx.", "dept.", "prof.", "al.", "etc.",
]
TOKENS_PER_WORD = 1.3
CHUNK_TARGET = 400
CHUNK_OVERLAP = 60
CHUNK_MIN = 100
SECTION_HEADING = r"^(?:[0-9]{1,2}(?:\.[0-9]{1,2})*\s+[A-Z][A-Za-z0-9\s,-]{3,80}|[A-Z\s]{4,60})$"
FIRST_SECTION = "Introduction"

# --- fixed values: personal data detectors, in detection order ---------------
# (category, pattern, capture group that holds the value)
PII_DETECTORS = [
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b", 0),
    ("PHONE", r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b|(?:\+91[-.\s]?)?[6-9]\d{4}[-.\s]?\d{5}\b", 0),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0),
    ("AADHAAR", r"\b\d{4}\s\d{4}\s\d{4}\b", 0),
    ("MRN", r"(?i)\b(?:MRN|mrn|Medical Record Number|Med Rec #)[\s:#]*([A-Za-z0-9-]{6,16})\b", 1),
    ("DOB", r"(?i)\b(?:DOB|Date of Birth|Birthdate)[\s:#]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\b", 1),
    ("ADDRESS", r"(?i)\b\d{1,5}\s+[A-Za-z0-9\s.,-]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Terrace|Heights|Flat|Apartment|Apt)[\w\s,.-]*\b", 0),
    ("PATIENT", r"\b(?:PATIENT(?:\s+NAME)?|Pt|Patient|ATTENDING(?:\s+PHYSICIAN)?|Dr\.|Doctor|Physician|Mr\.|Mrs\.|Ms\.)[\s:#]+([A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+)+)", 1),
]
LEAK_CATEGORIES = ["EMAIL", "PHONE", "SSN", "AADHAAR"]
NOT_A_NAME = [
    "Cardiology", "Oncology", "Neurology", "Emergency", "Pediatrics",
    "Radiology", "Pathology", "Surgery", "Dermatology", "Gastroenterology",
    "Apixaban", "Rivaroxaban", "Lisinopril", "Atorvastatin", "Doxorubicin",
    "Tamoxifen", "Prednisolone", "Azithromycin", "Salbutamol", "Ipratropium",
    "Stage", "Cycle", "Follow", "Hospital", "Discharge", "History",
    "Physical", "Assessment", "Examination", "Plan", "Recommendation",
]

# --- fixed values: retrieval -------------------------------------------------
EMBED_DIM = 384
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
RRF_K = 60
MISSING_RANK = 999
DEPTH = 20
FINAL_K = 5
CONFIDENCE_THRESHOLD = 0.50
RERANK_STOP_WORDS = [
    "what", "is", "the", "a", "an", "and", "or", "of", "in", "for", "to",
    "with", "on", "at", "from", "by", "are", "was", "were", "be", "this",
    "that", "how", "which", "who", "whom", "can", "should", "would", "could",
]

# --- fixed values: query log -------------------------------------------------
MIN_QUERY_LENGTH = 2
MAX_QUERY_LENGTH = 2000
TOO_SHORT_MESSAGE = "Query is too short or empty."
TOO_LONG_MESSAGE = f"Query exceeds maximum allowed length of {MAX_QUERY_LENGTH} characters."
# threat class -> patterns, in reporting order
THREATS = {
    "instruction_override": [
        r"(?i)\b(ignore|disregard|forget|override|bypass)\b.{0,40}\b(previous|prior|above|system|all)\b.{0,30}\b(instructions|rules|prompts|guidelines|constraints)\b",
        r"(?i)\bsystem\s*(override|reset|shutdown|directive|prompt|mode)\b",
        r"(?i)\b(new\s+system\s+instruction|developer\s+mode|disregard\s+all\s+rules)\b",
        r"(?i)\bstop\s+being\s+(a\s+medical|an\s+ai|a\s+clinical)\b",
    ],
    "jailbreak": [
        r"(?i)\b(dan\s+mode|do\s+anything\s+now|jailbreak|uncensored|unrestricted\s+mode)\b",
        r"(?i)\b(roleplay|pretend|act\s+as)\b.{0,40}\b(unrestricted|evil|unfiltered|without\s+ethics|no\s+rules|without\s+guidelines|unconstrained)\b",
        r"(?i)\bwithout\s+any\s+(safety|ethical|medical|clinical)\s+(guardrails|filters|rules|constraints)\b",
    ],
    "prompt_leak": [
        r"(?i)\b(reveal|display|output|show|print|repeat)\b.{0,30}\b(system\s+prompt|initial\s+instructions|base\s+prompt|hidden\s+prompt|developer\s+instructions)\b",
        r"(?i)\bwhat\s+(are|is)\s+your\s+(exact\s+)?(initial\s+instructions|system\s+prompt|system\s+rules)\b",
        r"(?i)\bprint\s+everything\s+above\s+this\s+line\b",
    ],
    "delimiter_injection": [
        r"(<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)",
        r"(?i)(###\s*(system|instruction|human|assistant)|```\s*system)",
    ],
}
ACRONYMS = {
    "AF": "Atrial Fibrillation",
    "AFIB": "Atrial Fibrillation",
    "DOAC": "Direct Oral Anticoagulant",
    "DOACS": "Direct Oral Anticoagulants",
    "NOAC": "Novel Oral Anticoagulant",
    "NOACS": "Novel Oral Anticoagulants",
    "OAC": "Oral Anticoagulation",
    "VKA": "Vitamin K Antagonist",
    "MI": "Myocardial Infarction",
    "HTN": "Hypertension",
    "DVT": "Deep Vein Thrombosis",
    "PE": "Pulmonary Embolism",
    "CKD": "Chronic Kidney Disease",
    "ESRD": "End-Stage Renal Disease",
    "HF": "Heart Failure",
    "CHF": "Congestive Heart Failure",
    "HFEPEF": "Heart Failure with Preserved Ejection Fraction",
    "HFREF": "Heart Failure with Reduced Ejection Fraction",
    "LVEF": "Left Ventricular Ejection Fraction",
    "T2DM": "Type 2 Diabetes Mellitus",
    "STEMI": "ST-Elevation Myocardial Infarction",
    "NSTEMI": "Non-ST-Elevation Myocardial Infarction",
    "CAD": "Coronary Artery Disease",
    "INR": "International Normalized Ratio",
    "CRCL": "Creatinine Clearance",
    "EGFR": "Estimated Glomerular Filtration Rate",
    "ACEI": "ACE Inhibitor",
    "ARB": "Angiotensin Receptor Blocker",
    "BB": "Beta Blocker",
    "CCB": "Calcium Channel Blocker",
    "TIA": "Transient Ischemic Attack",
    "COPD": "Chronic Obstructive Pulmonary Disease",
}
# intent class -> substrings, in rule order
INTENT_RULES = [
    ("dosing", ["dose", "dosage", "mg", "frequency", "how much", "titrat", "daily", "b.i.d"]),
    ("contraindication", ["contraindicat", "avoid", "caution", "black box", "adverse", "risk", "harm", "interaction"]),
    ("treatment", ["treatment", "first-line", "therapy", "manage", "recommend", "drug", "prescrib", "anticoagula"]),
    ("diagnosis", ["diagnos", "criteria", "symptom", "score", "cha2ds2", "has-bled", "test", "presentation"]),
    ("monitoring", ["monitor", "inr", "follow-up", "lab", "level", "check", "renal", "crcl"]),
]
# The third list element of the fourth pattern is the assistant name; "assistant" stands for any.
GREETING_PATTERNS = [
    r"(?i)^(hi|hello|hey|heya|howdy|sup|greetings)[\s,!.]*$",
    r"(?i)^(good\s+(morning|afternoon|evening|day))[\s,!.]*$",
    r"(?i)^(what'?s\s+up|whats\s+up|wassup)[\s,!?.]*$",
    r"(?i)^(hi|hello|hey|greetings|good\s+(morning|afternoon|evening))\s+({assistant}|assistant|doc|doctor|team|there|bot|ai)[\s,!.]*$",
    r"(?i)^(how\s+are\s+you|how's\s+it\s+going|how\s+do\s+you\s+do)[\s,!?.]*$",
    r"(?i)^(who\s+are\s+you|what\s+are\s+you|what\s+can\s+you\s+do|what\s+is\s+your\s+name|help|help\s+me)[\s,!?.]*$",
]
OFF_TOPIC_PATTERNS = [
    r"(?i)\b(world\s+cup|football|soccer|cricket|nba|nfl|super\s*bowl|fifa|olympics|champions\s+league|premier\s+league)\b",
    r"(?i)\b(who\s+won|score\s+of|match\s+result|ballon\s+d'or|mvp|stanley\s+cup|grand\s+slam)\b",
    r"(?i)\b(president|prime\s+minister|election|parliament|congress|democrat|republican|senator)\b",
    r"(?i)\b(capital\s+of|highest\s+mountain|longest\s+river|tallest\s+building|population\s+of)\b",
    r"(?i)\b(tell\s+me\s+a\s+joke|write\s+a\s+poem|sing\s+a\s+song|write\s+a\s+story|riddle)\b",
    r"(?i)\b(recipe\s+for|how\s+to\s+cook|how\s+to\s+bake|bake\s+a\s+cake|cocktail\s+recipe)\b",
    r"(?i)\b(weather\s+in|weather\s+today|forecast|movie\s+review|box\s+office|celebrity\s+gossip)\b",
    r"(?i)\b(bitcoin|crypto|stock\s+market|ethereum|nasdaq|dow\s+jones)\b",
    r"(?i)\b(what\s+is\s+the\s+meaning\s+of\s+life|who\s+is\s+elvis|who\s+is\s+taylor\s+swift)\b",
    r"(?i)^(what\s+is\s+2\s*\+\s*2|calculate\s+\d+[\+\-\*\/]\d+)[\s,!?.]*$",
]
NOTE_TRIGGERS = [
    "patient", "clinical note", "discharge note", "mrn", "this patient",
    "rajesh", "progress note", "in the note", "patient's note", "patient note",
]
SALUTATIONS = ["hi", "hello", "hey", "sup", "morning", "evening", "who"]
DOMAIN_KEYWORDS = [
    "dose", "dosage", "dosing", "contraindicat", "indication", "recommend",
    "treatment", "first-line", "second-line", "therapy", "anticoagula",
    "atrial fibrillation", "afib", "hypertension", "copd", "pneumonia",
    "diabetes", "heart failure", "crcl", "egfr", "inr", "curb-65",
    "cha2ds2", "has-bled", "fev1", "hba1c", "hypoglycemia", "hyperglycemia",
    "stroke", "bleeding", "creatinine", "renal", "hepatic", "kidney",
    "cardiology", "pulmonary", "endocrine", "asthma", "myocardial",
    "guideline", "guidelines", "protocol", "side effect", "adverse",
    "pharmacotherapy", "drug", "medication", "pill", "tablet", "infusion",
    "intravenous", "subcutaneous", "oral", "antibiotic", "beta blocker",
    "ace inhibitor", "arb", "sglt2", "glp-1", "doac", "statin", "aspirin",
    "regimen", "chemotherapy", "radiation", "cancer", "tumor", "oncology",
    "fractionation", "surgery", "pediatric", "pathology", "syndrome",
    "disease", "disorder", "infection", "vaccine", "clinical trial",
]
ROUTE_REASONS = {
    "guard": "Flagged by PromptGuard safety guardrails",
    "note_query": "Query explicitly references patient clinical note or note_id context",
    "greeting": "Matched conversational greeting pattern without medical queries",
    "off_topic": "Matched non-medical general knowledge or trivia pattern",
    "medical": "Query contains recognized clinical conditions, pharmacological entities, or guideline terms",
    "salutation": "Short conversational salutation heuristic",
    "unknown": "Unrecognized query without clinical terminology routed to off-topic",
}

# --- fixed values: answers and claims ----------------------------------------
ENTITIES = [
    "Rivaroxaban", "Apixaban", "Dabigatran", "Edoxaban", "Warfarin",
    "Amiodarone", "Metoprolol", "Diltiazem", "Digoxin", "Verapamil",
    "Bisoprolol", "Carvedilol", "Atorvastatin", "Rosuvastatin", "Aspirin",
    "Clopidogrel", "Ticagrelor", "Heparin", "Enoxaparin", "Fondaparinux",
    "Lisinopril", "Ramipril", "Losartan", "Valsartan", "Sacubitril", "Amlodipine",
    "Furosemide", "Spironolactone", "Eplerenone", "Empagliflozin", "Dapagliflozin",
    "Semaglutide", "Metformin", "Insulin", "Levothyroxine", "Omeprazole", "Pantoprazole",
    "Tiotropium", "Formoterol", "Prednisone", "Amoxicillin", "Azithromycin", "Doxycycline",
    "Cisplatin", "Paclitaxel", "Pembrolizumab", "Trastuzumab", "Doxorubicin",
]
ENTITY_SUFFIX_PATTERN = r"[A-Z][a-z]{3,15}(?:ol|statin|pril|sartan|mab|nib|xaban|parin|zole|pine|olol|oxin|done|cin)"
DOSE_PATTERN = r"(?i)(\d+(?:\.\d+)?)\s*(mg|mcg|g|units|iu|ml)\b"
FREQUENCY_PATTERN = r"(?i)\b(once daily|twice daily|thrice daily|daily|q\.?d\.?|b\.?i\.?d\.?|t\.?i\.?d\.?|q12h|q24h|weekly|as needed|prn)\b"
ROUTE_PATTERN = r"(?i)\b(oral|orally|po|p\.o\.|iv|i\.v\.|intravenous|subcutaneous|sc|s\.c\.)\b"
ANSWER_STOP_WORDS = ["what", "is", "the", "for", "with", "and", "are", "was", "in", "of", "to", "how", "does", "normal", "function"]
ANSWER_KEYWORDS = ["dose", "daily", "treatment", "target", "recommend", "criterion", "patient", "therapy", "mg", "oral", "fev1", "ratio"]
ANSWER_VERBS = ["is", "recommended", "taken", "dose reduction", "indicated"]
ANSWER_MIN_CHARS = 14
NOT_FOUND_ANSWER = (
    "I'm not sure — this information is not found in the provided documents. "
    "Please consider rephrasing your clinical question with specific drug names, clinical conditions, "
    "or guideline topics, or consult authoritative medical reference literature."
)
REPAIR_BANNER = (
    "\n\n> [!WARNING]\n"
    "> **CLINICAL AUDIT WARNING**: One or more pharmaceutical claims could not be verified "
    "against the cited reference guideline. Please consult the verification panel below."
)
DEFAULT_SOURCE_TITLE = "Clinical Guideline"
HIGHLIGHT_CHARS = 300

# --- fixed values: evaluation ------------------------------------------------
ENTAILMENT_STOP_WORDS = [
    "is", "are", "was", "were", "the", "a", "an", "and", "or", "in",
    "on", "at", "to", "for", "with", "by", "of", "be", "been", "administered",
]
ENTAILMENT_RATIO = 0.65

# --- fixed values: study -----------------------------------------------------
PASS_MARK = 70.0
QUIZ_SECONDS = 180
CARD_SECONDS = 20
REVIEW_SECONDS = 15
START_EASE = 2.5
MIN_EASE = 1.3
LAST_DATE_US = 253_402_300_799_999_999  # end of the year 9999: later review dates cannot be held

# --- fixed values: request limits, (limit, seconds) by scope -----------------
RATE_LIMITS = {
    "ask": (30, 60),
    "notes": (20, 60),
    "quiz": (40, 60),
    "user": (120, 60),
    "anon": (60, 60),
}
PAGE_SIZE = 20
