"""Word lists, aliases and bounds of the conversation operators."""

from __future__ import annotations

HINGLISH_MARKERS = (
    "mera", "meri", "mere", "main", "mai", "hoon", "hun", "hai", "hain", "nahi", "nahin", "kya", "kaise",
    "kitna", "kitni", "kitne", "aur", "lekin", "agar", "toh", "se", "ka", "ki", "ke", "ko", "mein", "par",
    "woh", "yeh", "hum", "tum", "aap", "unka", "unki", "sala", "saal", "rupaye", "paisa", "kisan", "gaon",
    "shahar", "zamin", "zameen", "ghar", "parivar", "sarkar", "sarkari", "yojana", "naam", "rehta", "rehti",
    "rehte", "hu", "ho", "bata", "tha", "thi", "the", "hua", "hui", "raha", "rahi", "rahte", "batao",
    "bataye", "chahiye", "milta", "milti", "karta", "karti", "karte", "khata", "khati", "bhi", "sirf",
    "bahut", "thoda", "zyada", "kam", "wala", "wali", "wale", "kamate", "kamata", "kamati", "rehna", "hau",
    "mujhe", "tumhe", "aapko", "hame", "hamara", "hamare", "hamari", "inhe", "unhe", "yahan", "wahan",
    "abhi", "pehle", "baad",
)

CONFIRM_EXACT = ("y", "yes", "ok", "हाँ", "सही")
GREETINGS = (
    "hi", "hello", "hey", "sup", "yo", "hola", "namaste", "namaskar", "नमस्ते", "नमस्कार", "हेलो", "हाय",
    "सुप्रभात", "good morning", "good afternoon", "good evening",
)
SKIPS = (
    "skip", "don't know", "not sure", "i don't know", "no idea", "pass",
    "पता नहीं", "छोड़ दें", "नहीं पता", "छोड़ो",
)
EXITS_WORD = ("bye", "done", "quit", "exit", "thanks", "बस", "धन्यवाद", "अलविदा")
EXITS_PHRASE = ("thank you", "that's all", "no more", "ठीक है बस")
CORRECTION_INTENT = (
    "actually", "wait", "no i meant", "sorry", "correction", "my mistake", "let me fix", "i was wrong",
    "दरअसल", "रुकिए", "माफ़ कीजिए", "मेरा मतलब", "सही बात", "गलती हो गई",
)
MATCH_TRIGGERS = (
    "check my eligibility", "check eligibility", "check schemes", "am i eligible", "am i qualified",
    "find schemes", "find me schemes", "which schemes", "what schemes", "see if i qualify", "see results",
    "run eligibility", "see if im eligible", "show me schemes", "tell me my eligibility", "recheck",
    "check again", "re-check", "re run", "run again",
    "पात्रता जाँचें", "पात्रता देखें", "योजनाएँ देखें", "मेरी पात्रता जाँचें", "पात्रता चेक",
)
MATCH_EXACT = ("check", "eligible", "eligibility")
WHAT_IFS = (
    "what if", "what would happen", "if i", "suppose i", "what happens if", "what about if",
    "अगर", "क्या हो अगर", "मान लो", "अगर मैं",
)
QUESTIONS = (
    "what is", "what are", "what's", "whats", "what about the", "how does", "how do i apply",
    "how can i apply", "how to apply", "how to get", "how do i get", "tell me about", "explain", "describe",
    "information about", "info about", "details about",
    "क्या है", "क्या हैं", "कैसे", "बताइए", "बताएं", "समझाइए",
)

CORRECTIONS_EN = (
    "actually", "wait", "no", "sorry", "i meant", "correction", "my mistake", "let me fix", "i was wrong",
    "not right", "change", "update", "changed", "updated", "now i", "now i'm", "now i am", "these days",
    "recently", "anymore", "not anymore", "used to", "since then", "nowadays", "switched", "moved to",
    "transitioned", "became", "left", "quit", "retired", "got a new", "started",
)
CORRECTIONS_HI = (
    "दरअसल", "रुकिए", "नहीं", "माफ़ कीजिए", "मेरा मतलब", "सही बात", "गलती हो गई", "बदलिए", "सुधार",
)

# Trigger text, field, value; earlier rows win within a field.
INFERENCES = (
    ("widow", "applicant.gender", "female"),
    ("widow", "applicant.marital_status", "widowed"),
    ("widower", "applicant.gender", "male"),
    ("widower", "applicant.marital_status", "widowed"),
    ("housewife", "applicant.gender", "female"),
    ("housewife", "applicant.marital_status", "married"),
    ("विधवा", "applicant.gender", "female"),
    ("विधवा", "applicant.marital_status", "widowed"),
    ("विधुर", "applicant.gender", "male"),
    ("विधुर", "applicant.marital_status", "widowed"),
    ("farmer", "employment.type", "agriculture"),
    ("kisaan", "employment.type", "agriculture"),
    ("किसान", "employment.type", "agriculture"),
    ("kisan", "employment.type", "agriculture"),
    ("i am a woman", "applicant.gender", "female"),
    ("i am a man", "applicant.gender", "male"),
    ("i'm a woman", "applicant.gender", "female"),
    ("i'm a man", "applicant.gender", "male"),
    ("मैं महिला हूँ", "applicant.gender", "female"),
    ("मैं पुरुष हूँ", "applicant.gender", "male"),
)

STATE_ALIASES = {
    "andhra pradesh": "AP", "arunachal pradesh": "AR", "assam": "AS", "bihar": "BR", "chhattisgarh": "CG",
    "goa": "GA", "gujarat": "GJ", "haryana": "HR", "himachal pradesh": "HP", "jharkhand": "JH",
    "karnataka": "KA", "kerala": "KL", "madhya pradesh": "MP", "maharashtra": "MH", "manipur": "MN",
    "meghalaya": "ML", "mizoram": "MZ", "nagaland": "NL", "odisha": "OD", "punjab": "PB",
    "rajasthan": "RJ", "sikkim": "SK", "tamil nadu": "TN", "telangana": "TS", "tripura": "TR",
    "uttar pradesh": "UP", "uttarakhand": "UK", "west bengal": "WB",
    "delhi": "DL", "jammu and kashmir": "JK", "jammu kashmir": "JK", "ladakh": "LA", "chandigarh": "CH",
    "puducherry": "PY", "pondicherry": "PY", "andaman and nicobar": "AN", "andaman nicobar": "AN",
    "dadra and nagar haveli": "DD", "daman and diu": "DD", "lakshadweep": "LD",
    "उत्तर प्रदेश": "UP", "मध्य प्रदेश": "MP", "बिहार": "BR", "राजस्थान": "RJ", "महाराष्ट्र": "MH",
    "गुजरात": "GJ", "कर्नाटक": "KA", "तमिलनाडु": "TN", "पश्चिम बंगाल": "WB", "आंध्र प्रदेश": "AP",
    "तेलंगाना": "TS", "केरल": "KL", "ओडिशा": "OD", "असम": "AS", "पंजाब": "PB", "हरियाणा": "HR",
    "छत्तीसगढ़": "CG", "झारखंड": "JH", "उत्तराखंड": "UK", "हिमाचल प्रदेश": "HP", "त्रिपुरा": "TR",
    "मेघालय": "ML", "मणिपुर": "MN", "नागालैंड": "NL", "मिज़ोरम": "MZ", "अरुणाचल प्रदेश": "AR",
    "सिक्किम": "SK", "गोवा": "GA", "दिल्ली": "DL", "जम्मू-कश्मीर": "JK", "जम्मू कश्मीर": "JK",
    "लद्दाख": "LA", "चंडीगढ़": "CH", "पुदुचेरी": "PY", "यूपी": "UP", "एमपी": "MP",
}
# Two-letter codes are accepted as they are; OR is not among the aliases' codes.
STATE_CODES_KNOWN = tuple(dict.fromkeys(STATE_ALIASES.values()))
CASTE_ALIASES = {
    "dalit": "SC", "scheduled caste": "SC", "sc": "SC", "adivasi": "ST", "tribal": "ST",
    "scheduled tribe": "ST", "st": "ST", "backward class": "OBC", "other backward class": "OBC",
    "obc": "OBC", "general": "GENERAL", "unreserved": "GENERAL", "gen": "GENERAL", "ews": "EWS",
    "economically weaker": "EWS", "अनुसूचित जाति": "SC", "दलित": "SC", "अनुसूचित जनजाति": "ST",
    "आदिवासी": "ST", "अन्य पिछड़ा वर्ग": "OBC", "ओबीसी": "OBC", "सामान्य": "GENERAL",
}

MONEY_UNITS = ((r"(lakh|lac|लाख)", 100000), (r"(crore|करोड़)", 10000000), (r"(thousand|hazar|हज़ार|हजार)", 1000))
LAND_UNITS = ((r"(bigha|बीघा)", 0.62), (r"(hectare|हेक्टेयर)", 2.47))

NUMBER_WORDS = {
    "ek": 1, "do": 2, "teen": 3, "chaar": 4, "char": 4, "paanch": 5, "panch": 5, "chhah": 6, "chheh": 6,
    "saat": 7, "sat": 7, "aath": 8, "ath": 8, "nau": 9, "naw": 9, "das": 10, "gyarah": 11, "barah": 12,
    "baara": 12, "bara": 12, "terah": 13, "chaudah": 14, "pandrah": 15, "solah": 16, "satrah": 17,
    "atharah": 18, "unnees": 19, "bees": 20, "ikees": 21, "battees": 32, "chalees": 40, "pachaas": 50,
    "saath": 60, "sattar": 70, "assi": 80, "nabbe": 90,
}
NUMBER_UNITS = r"(saal|sal|years?|mahine|members?|hazar|hazaar|lakh|lac)\b"

QUESTION_ORDER = (
    "applicant.age", "location.state", "household.income_annual", "applicant.caste_category",
    "applicant.gender", "applicant.land_ownership_status", "documents.aadhaar", "documents.bank_account",
    "employment.type", "household.size", "applicant.marital_status", "household.bpl_status",
    "household.land_acres", "applicant.disability_status", "household.ration_card_type",
)

BOUNDS = {
    "applicant.age": (0, 120),
    "applicant.disability_percentage": (0, 100),
    "household.income_annual": (0, 100000000),
    "household.income_monthly": (0, 10000000),
    "household.size": (1, 30),
    "household.land_acres": (0, 10000),
}
BIRTH_YEAR_FLOOR = 1900
ALLOWED = {
    "applicant.caste_category": ("sc", "st", "obc", "general", "ews"),
    "applicant.gender": ("male", "female", "transgender", "other", "prefer not to say"),
    "applicant.marital_status": ("single", "married", "widowed", "divorced", "separated"),
    "employment.type": (
        "agriculture", "daily_wage", "salaried", "self_employed", "unemployed", "student", "retired",
        "homemaker", "other",
    ),
    "location.state": tuple(c.lower() for c in STATE_CODES_KNOWN),
}
NUMERIC_FIELDS = (
    "applicant.age", "applicant.birth_year", "household.income_annual", "household.income_monthly",
    "household.size", "household.land_acres", "applicant.disability_percentage",
)
CRITICAL_FIELDS = (
    "applicant.age", "applicant.gender", "applicant.caste_category", "applicant.marital_status",
    "applicant.land_ownership_status", "applicant.disability_status", "location.state",
    "household.income_annual", "household.income_monthly", "household.bpl_status", "employment.type",
)
VIABLE_FIELDS = ("applicant.age", "location.state", "household.income_annual", "applicant.caste_category")
MAX_TURNS = 10

STOP_WORDS = (
    "what", "is", "are", "how", "does", "the", "a", "an", "tell", "me", "about", "can", "i", "apply", "for",
    "do", "explain", "describe", "information", "details", "scheme", "which", "to", "get", "please", "where",
)
STATUS_RANK = {"ELIGIBLE": 3, "NEAR_MISS": 2, "INSUFFICIENT_DATA": 1, "INELIGIBLE": 0}
SUGGESTIONS = (
    ("documents.bank_account", "Open a bank account", 3),
    ("documents.mgnrega_job_card", "Get an MGNREGA job card", 2),
    ("documents.caste_certificate", "Get a caste certificate", 2),
    ("documents.income_certificate", "Get an income certificate", 2),
)
