"""Regular expressions and word lists of the text operators.

They are applied to lower-cased text unless noted, in the order given.
"""

from __future__ import annotations

DISQUALIFYING = (
    r"\bmust not\b",
    r"\bcannot\b",
    r"\bnot eligible if\b",
    r"\bexcluded if\b",
    r"\bno existing\b",
    r"\bnot covered\b",
    r"\bshould not\b",
    r"\bdisqualified if\b",
    r"\balready\s*(?:have|has|own|hold)",
)
PREREQUISITE = (
    r"\b(?:required|compulsory|mandatory|must have|is mandatory)\b",
    r"\b(?:bank account|aadhaar|ration card|certificate)\s*(?:required|compulsory|mandatory)",
    r"\bmust.*(?:register|enroll|open|obtain)\b",
)
STANDARD_CONDITION = r"\b(?:applicant|beneficiary)\s+(?:must\s+)?have\b"

FIELD_PATTERNS = (
    (r"\b(age|years?\s+old|aged\s|born\s|age\s+group|\d+\s*-\s*\d+\s*years?)\b", "applicant.age"),
    (r"\b(female|women|woman|girl|male|man|men|boy|transgender|gender)\b", "applicant.gender"),
    (
        r"\b(widow|widower|widowed|married|unmarried|divorced|separated|single\s+woman|spouse|deserted)\b",
        "applicant.marital_status",
    ),
    (
        r"\b(disab|handicap|differently.?abled|pwd|locomotor|blind|deaf|mute|physical.?challenge)\b",
        "applicant.disability_status",
    ),
    (
        r"\b(sc|st|obc|general\s+category|backward\s+class|scheduled\s+caste|scheduled\s+tribe|minority|ews|economically\s+weaker)\b",
        "applicant.caste_category",
    ),
    (
        r"\b(education|qualification|class\s+\d|grade\s+\d|school|graduate|literate|illiterate|diploma|degree|10th|12th|matric|ssc|hsc|inter|passed)\b",
        "applicant.education_level",
    ),
    (r"\b(income\s+tax|income-tax|itr|tax\s+payer|taxpayer)\b", "employment.is_income_tax_payer"),
    (
        r"\b(income|earning|salary|wage|annual\s+income|monthly\s+income|per\s+annum|per\s+month|₹|inr|lakh|crore|rupee|rs\.?)\b",
        "household.income_annual",
    ),
    (r"\b(bpl|below\s+poverty\s+line|apl|above\s+poverty)\b", "household.bpl_status"),
    (
        r"\b(farmer|agricult|worker|employee|self.?employ|profession|labor|labour|artisan|fisherm|weaver|craftsmen|business|trade|vendor|driver|mason|cobbler|scavenger|unorganis|informal|gig)\b",
        "employment.occupation",
    ),
    (r"\b(aadhaar|uid\b|biometric\s+id)\b", "documents.aadhaar"),
    (r"\b(bank\s+account|jan\s+dhan|savings\s+account|pmjdy)\b", "documents.bank_account"),
    (r"\b(ration\s+card|pds|public\s+distribution|food\s+security)\b", "documents.ration_card"),
    (
        r"\b(land|acre|hectare|cultivab|farm\s+land|landowner|agricultural\s+land)\b",
        "assets.cultivable_land",
    ),
    (
        r"\b(resident|domicile|residing|native\s+of|citizen\s+of|permanent\s+resident|staying\s+in|belonging\s+to\s+(?:the\s+)?state)\b",
        "location.state",
    ),
    (r"\b(state\s+of|district\s+of|union\s+territory\s+of|taluk|block\s+of)\b", "location.state"),
    (
        r"\b(family\s+size|household\s+member|family\s+member|number\s+of\s+member)\b",
        "household.family_size",
    ),
)
OTHER_FIELD = "eligibility.other"

LTE_MONEY = r"\b(?:not\s+exceed|should\s+not\s+exceed|must\s+not\s+exceed|below|up\s+to|upto|maximum|at\s+most|not\s+more\s+than)"
GTE_MONEY = r"\b(?:at\s+least|minimum|above|not\s+less\s+than)\b"
BETWEEN_PATTERNS = (
    r"\bbetween\s*(\d+)\s*and\s*(\d+)\b",
    r"(\d+)\s*(?:to|[-–])\s*(\d+)\s*(?:years?|yrs?|age)",
    r"\bfrom\s*(\d+)\s*to\s*(\d+)\b",
)
NUMBER_PATTERNS = (
    ("GTE", r"\b(?:at\s+least|minimum|not\s+less\s+than)\s*(\d+)"),
    ("GTE", r"(\d+)\s*(?:years?|yrs?)?\s*(?:or\s+)?(?:above|older|and\s+above|\+)"),
    ("LTE", r"\b(?:at\s+most|up\s+to|upto|maximum|not\s+(?:more|exceed)|no\s+more\s+than|not\s+exceeding)\s*(\d+)"),
    ("LTE", r"(\d+)\s*(?:years?|yrs?)?\s*(?:or\s+)?(?:below|younger|and\s+below|and\s+under)"),
    ("GT", r"\b(?:more\s+than|greater\s+than|above)\s*(\d+)"),
    ("LT", r"\b(?:less\s+than|below|under)\s*(\d+)"),
)
IN_PATTERNS = (
    r"\b(?:sc|st|obc|ews)\b.*(?:\/|or|and).*\b(?:sc|st|obc|ews|general)\b",
    r"\b(?:one\s+of|belonging\s+to|either|category|categories)\b",
    r"\b(male|female)\b.*\b(female|male|transgender)\b",
)

LAKH_MARKED = r"(?:₹|rs\.?\s*)(\d+(?:[.,]\d+)*)\s*lakh"
LAKH = r"(\d+(?:\.\d+)?)\s*lakh"
CRORE = r"(\d+(?:\.\d+)?)\s*crore"
RUPEES = r"(?:₹|rs\.?\s*)(\d[\d,]*)"
NUMBER = r"\d+(?:,\d+)*(?:\.\d+)?"
MONEY_WORDS = r"₹|inr|lakh|crore|rupee"

CASTE_VALUES = ("SC", "ST", "OBC", "EWS", "General", "GEN", "BC", "MBC", "NT", "SBC", "VJ")
GENDER_VALUES = (
    (r"\bfemale|women|woman\b", "female"),
    (r"\bmale|men|man\b", "male"),
    (r"\btransgender\b", "transgender"),
)
OCCUPATIONS = r"(?:farmer|worker|artisan|weaver|fisherm\w*|driver|mason|carpenter|cobbler|potter|blacksmith)"
EDUCATION_VALUES = ("10th", "12th", "graduate", "post-graduate", "diploma", "illiterate", "literate")
MARITAL_VALUES = ("widow", "divorced", "separated", "unmarried", "married", "deserted")

# Parser detector: code, name, severity, pattern, further pattern, negated pattern.
PARSER_CHECKS = (
    (1, "Vague Threshold", "MEDIUM", r"\b(poor|needy|economically weak|backward|weaker)\b", None, r"₹|\d+"),
    (4, "Discretionary Clauses", "HIGH", r"\b(may be|discretion|subject to|at the discretion|subject to availability)\b", None, None),
    (5, "Temporal Ambiguity", "MEDIUM", r"\b(before|after|since|for at least|for last)\b", r"\d+\s*(year|month|day|date)", None),
    (10, "State Variation", "HIGH", r"\b(varies by state|as per state|state specific|state-level)\b", None, None),
    (14, "Self-Certification Risk", "MEDIUM", r"\b(self.?certif|self.?declar|self.?attest|self.?report)\b", None, None),
    (17, "Exclusion List Incomplete", "LOW", r"\bsuch as\b", None, None),
    (20, "Double Negation", "MEDIUM", r"\b(not ineligible|no bar on|not excluded|not disqualified)\b", None, None),
    (23, "Multiple Scheme Interaction", "HIGH", r"\b(other scheme|already enrolled|existing beneficiary|concurrent|another scheme)\b", None, None),
    (28, "Age Boundary Edge Case", "LOW", r"\b(at least|above|below|between)\s*\d+\s*(year|age)", None, None),
)

# Taxonomy detector, case-insensitive on the raw text, in checking order. The word
# boundary binds only to the first and last alternatives.
TAXONOMY_CHECKS = (
    (9, r"\bcircular|prerequisite.*prerequisite|depends on.*depends on\b"),
    (6, r"\bnot eligible.*member|must not.*be.*member|not a member|enrolled in.*not eligible\b"),
    (19, r"\bhindu|hindi\b.*\bsays|english\b.*\bhindi|tamil.*version|language.*version|version.*says\b"),
    (10, r"\bbelow (?:the )?poverty line\b(?!.*[\d₹])"),
    (21, r"\bwid(?:ow|ower)|remarri|upon death|after (?:spouse|husband|wife) dies?\b"),
    (7, r"\bration card|inter.?state portability|within the state of registration|state[\s-]bound|applicable.*only.*within\b"),
    (4, r"\bat the discretion of|subject to.*approval|as determined by|may be selected\b"),
    (2, r"\bcannot prove|lease.*land|land.*lease|cannot.*document|documentation.*gap|cultivation|ownership.*document|proof of.*ownership\b"),
    (1, r"\bresident|weaker section|rural poor|needy|deserving|suitable|appropriate\b"),
    (23, r"\bresident of the state|permanent resident|domicile\b(?!.*\d)"),
    (27, r"\bas on date of|age as on|completed.*years|attained.*age\b"),
    (30, r"\baadhaar\b.*\bnot mandatory|without aadhaar\b"),
    (20, r"\bbank account|direct benefit transfer|dbt\b|aadhaar.linked bank|subject to.*availability|if.*infrastructure|depending on.*facility\b"),
    (3, r"\bcontradicts|simultaneously requires|mutually exclusive criteria|conflicting requirement\b"),
    (5, r"\bwithin \d+ (?:days?|months?|years?) of|before the due date|time.?limit|application window|validity period\b"),
    (8, r"\bincome between|income from.*to|threshold overlap|falling under.*category|borderline income\b"),
    (11, r"\bboundary.*caste|caste.*boundary|other backward class|OBC boundary|category overlap|SC.ST.OBC.*ambiguous\b"),
    (12, r"\bdocument.*varies|varies by state|documents required.*different|certificate.*accepted.*only|list of acceptable documents\b"),
    (13, r"\bbenefit.*overlap|double.*benefit|simultaneous.*claim|already.*receiving.*benefit|same benefit.*another scheme\b"),
    (14, r"\bgram panchayat|block level|district boundary|administrative.*conflict|jurisdiction.*overlap|panchayat.*limit\b"),
    (15, r"\bimplementation pending|not yet operational|rollout incomplete|pilot.*phase|infrastructure not yet|yet to be notified\b"),
    (16, r"\bhousehold.*definition|family.*composition|son.*government job|member.*income.*excluded|family income.*includes\b"),
    (17, r"\bmay appeal|right to appeal|appeal.*within|appellate authority|no appeal mechanism|grievance.*appeal\b"),
    (18, r"\bgrievance redressal|complaint.*mechanism|toll.?free|helpline|ombudsman|nodal officer.*grievance\b"),
    (22, r"\bjoint family|nuclear family|household.*split|separate household|living separately|married daughter.*household\b"),
    (24, r"\bfamily income|combined income|per capita income|individual income|income.*computation|income.*calculation method\b"),
    (25, r"\bcaste certificate.*state|OBC certificate.*central|SC certificate.*different|caste.*jurisdiction|backward class.*list\b"),
    (26, r"\bwomen only|only female|male applicants excluded|gender.*eligibility|unmarried woman|married woman\b"),
    (28, r"\bland record|patta|khata|khatauni|jamabandi|land.*registry|revenue record\b"),
    (29, r"\bdisability certificate|PwD|percentage.*disability|benchmark disability|disability.*threshold|differently abled\b"),
)
