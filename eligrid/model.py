"""Vocabularies, thresholds and dimension tables shared by every operator."""

from __future__ import annotations

# ---- fixed values: must equal the published rule vocabulary ----------------

OPERATORS = (
    "EQ", "NEQ", "LT", "LTE", "GT", "GTE", "BETWEEN", "IN", "NOT_IN",
    "NOT_MEMBER", "IS_NULL", "IS_NOT_NULL", "CONTAINS", "MATCHES",
)
NUMERIC_OPERATORS = ("LT", "LTE", "GT", "GTE", "BETWEEN")
BATCH_OPERATORS = (
    "EQ", "NEQ", "LT", "LTE", "GT", "GTE", "BETWEEN", "IN", "NOT_IN",
    "IS_NULL", "IS_NOT_NULL",
)
OPERATOR_ALIASES = {"EXISTS": "IS_NOT_NULL", "NOT_EXISTS": "IS_NULL", "NOT_EQ": "NEQ"}

PHASES = {
    "disqualifying": "A",
    "prerequisite": "B",
    "eligibility": "C",
    "admin_discretion": "D",
    "administrative_discretion": "D",
    "discretion": "D",
}
PHASE_NAMES = {"A": "A_DISQUALIFYING", "B": "B_PREREQUISITE", "C": "C_ELIGIBILITY", "D": "D_DISCRETION"}

# Scores are kept in hundredths so that sums are exact.
AUDIT_CENTS = {"VERIFIED": 100, "OVERRIDDEN": 80, "NEEDS_REVIEW": 70, "PENDING": 50, "DISPUTED": 0}
AUDIT_CENTS_DEFAULT = 50
PASS_CENTS = 100
UNVERIFIED_PASS_CENTS = 70
HIGH_PENALTY_CENTS = 15
MEDIUM_PENALTY_CENTS = 5
CRITICAL_CAP = 0.30
PROFILE_COMPLETE_THRESHOLD = 0.60
NEAR_MISS_MAX_FAILED = 2
ACTION_THRESHOLD = 0.80

LABEL_BANDS = ((0.80, "HIGH"), (0.60, "MEDIUM"), (0.40, "LOW"), (0.20, "VERY_LOW"))
UI_LABEL_BANDS = ((0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW"))

STATUS_BUCKETS = {
    "ELIGIBLE": "eligible",
    "ELIGIBLE_WITH_CAVEATS": "eligible",
    "NEAR_MISS": "near_miss",
    "INELIGIBLE": "ineligible",
    "DISQUALIFIED": "ineligible",
    "REQUIRES_PREREQUISITE": "requires_prerequisite",
    "PARTIAL": "partial",
    "INSUFFICIENT_DATA": "insufficient_data",
}

STATE_CODES = (
    "AN", "AP", "AR", "AS", "BR", "CG", "CH", "DD", "DL", "GA", "GJ",
    "HP", "HR", "JH", "JK", "KA", "KL", "LA", "LD", "MH", "ML", "MN",
    "MP", "MZ", "NL", "OD", "OR", "PB", "PY", "RJ", "SK", "TN", "TR",
    "TS", "UK", "UP", "WB",
)
GENDERS = ("male", "female", "transgender", "other")
CASTE_CATEGORIES = ("SC", "ST", "OBC", "GENERAL", "EWS")
CASTE_ALIASES = {
    "DALIT": "SC", "SCHEDULED CASTE": "SC", "SCHEDULED-CASTE": "SC",
    "ADIVASI": "ST", "TRIBAL": "ST", "SCHEDULED TRIBE": "ST", "SCHEDULED-TRIBE": "ST",
    "OTHER BACKWARD CLASS": "OBC", "OTHER BACKWARD CASTE": "OBC",
    "BACKWARD CLASS": "OBC", "BACKWARD CASTE": "OBC", "BC": "OBC",
    "GENERAL": "GENERAL", "UNRESERVED": "GENERAL", "UR": "GENERAL",
    "OPEN": "GENERAL", "GEN": "GENERAL",
    "ECONOMICALLY WEAKER SECTION": "EWS", "ECONOMICALLY WEAKER SECTIONS": "EWS",
}

# Profile fields: dot path and Python kind; position is the slot in `cells`.
PROFILE_FIELDS = (
    ("applicant.age", "int"),
    ("applicant.gender", "str"),
    ("applicant.caste_category", "str"),
    ("applicant.marital_status", "str"),
    ("applicant.disability_status", "bool"),
    ("applicant.disability_percentage", "int"),
    ("applicant.land_ownership_status", "bool"),
    ("location.state", "str"),
    ("household.income_annual", "int"),
    ("household.income_monthly", "int"),
    ("household.size", "int"),
    ("household.bpl_status", "bool"),
    ("household.ration_card_type", "str"),
    ("household.residence_type", "str"),
    ("household.land_acres", "float"),
    ("employment.type", "str"),
    ("employment.is_epfo_member", "bool"),
    ("employment.is_esic_member", "bool"),
    ("employment.is_nps_subscriber", "bool"),
    ("employment.is_income_tax_payer", "bool"),
    ("documents.aadhaar", "bool"),
    ("documents.bank_account", "bool"),
    ("documents.bank_account_type", "str"),
    ("documents.mgnrega_job_card", "bool"),
    ("documents.caste_certificate", "bool"),
    ("documents.income_certificate", "bool"),
    ("schemes.active_enrollments", "list"),
    ("health.pregnancy_status", "bool"),
    ("health.child_count", "int"),
)
FIELD_SLOT = {path: i for i, (path, _) in enumerate(PROFILE_FIELDS)}

CONDITION_TYPE_BY_SEGMENT = {
    "age": "age_range",
    "income_annual": "income_ceiling",
    "income_monthly": "income_ceiling",
    "caste_category": "caste_category",
    "land_ownership_status": "land_ownership",
    "land_acres": "land_holding",
    "gender": "gender",
    "disability_status": "disability",
    "epfo": "scheme_enrollment",
    "nps": "scheme_enrollment",
    "esic": "scheme_enrollment",
    "bpl_status": "poverty_status",
    "ration_card_type": "ration_card",
}

DOCUMENT_FIELDS = {
    "documents.bank_account": "bank account (Jan Dhan Yojana or any nationalised bank)",
    "documents.aadhaar": "Aadhaar card",
    "documents.mgnrega_job_card": "MGNREGA job card",
    "documents.caste_certificate": "caste certificate from competent authority",
    "documents.income_certificate": "income certificate from tehsildar/SDM",
}
STANDARD_DOCUMENTS = (
    ("documents.aadhaar", "Aadhaar Card"),
    ("documents.bank_account", "Bank Account (Jan Dhan or nationalised bank)"),
)

AMBIGUITY_TAXONOMY = {
    1: "Semantic Vagueness",
    2: "Undefined Term",
    3: "Conflicting Criteria",
    4: "Discretionary Clause",
    5: "Temporal Ambiguity",
    6: "Mutual Exclusion Conflict",
    7: "Portability Gap",
    8: "Eligibility Threshold Overlap",
    9: "Prerequisite Chaining / Circular Dependency",
    10: "Financial Threshold Flux",
    11: "Categorical Boundary Ambiguity",
    12: "Documentation Requirement Ambiguity",
    13: "Benefit Duplication Risk",
    14: "Administrative Boundary Conflict",
    15: "Implementation Gap",
    16: "Targeting Inconsistency",
    17: "Appeal Mechanism Vagueness",
    18: "Grievance Redressal Specificity",
    19: "Linguistic Translation Delta",
    20: "Infrastructure Precondition",
    21: "Life-Event Transition Ambiguity",
    22: "Household Definition Inconsistency",
    23: "Residency Requirement Vagueness",
    24: "Income Computation Method Ambiguity",
    25: "Caste Certificate Jurisdiction Conflict",
    26: "Gender Eligibility Gap",
    27: "Age Calculation Method Ambiguity",
    28: "Land Record Jurisdiction Conflict",
    29: "Disability Certification Ambiguity",
    30: "Aadhaar Linkage Requirement Gap",
}
CRITICAL_TYPES = (3, 9, 20)
HIGH_TYPES = (1, 6, 7, 10, 14, 16, 19, 23, 25, 28, 29)
MEDIUM_TYPES = (4, 5, 8, 11, 12, 13, 15, 17, 21, 24, 26, 27, 30)
UPGRADE_WORDS = ("income", "land", "age", "caste")

# ---- end of fixed values ---------------------------------------------------


def column_of(path: str) -> str:
    """Wide-table column name of a dot path."""
    return path.replace(".", "_")


# ---- fixed values: field namespace with display labels ----------------------
FIELD_NAMESPACE = {
    "applicant.age": "Applicant Age (years)",
    "applicant.gender": "Applicant Gender",
    "applicant.caste_category": "Applicant Caste Category",
    "applicant.disability_status": "Applicant Disability Status",
    "applicant.disability_percentage": "Applicant Disability Percentage (%)",
    "applicant.marital_status": "Applicant Marital Status",
    "applicant.widowed": "Applicant is Widowed",
    "applicant.nationality": "Applicant Nationality",
    "applicant.domicile_state": "Applicant Domicile State",
    "applicant.education_level": "Applicant Education Level",
    "applicant.employment_type": "Applicant Employment Type",
    "applicant.occupation": "Applicant Occupation",
    "applicant.aadhaar_linked": "Applicant Aadhaar Linked to Bank",
    "applicant.aadhaar_number": "Applicant Aadhaar Number",
    "applicant.bank_account": "Applicant Has Bank Account",
    "applicant.pan_number": "Applicant PAN Number",
    "applicant.date_of_birth": "Applicant Date of Birth",
    "applicant.is_minor": "Applicant is Minor",
    "applicant.guardian_name": "Applicant Guardian Name",
    "applicant.land_ownership_status": "Applicant Owns Agricultural Land",
    "applicant.farmer_type": "Applicant Farmer Type (small/marginal/large)",
    "household.land_acres": "Household Land Owned (acres)",
    "household.land_type": "Household Land Type (irrigated/rainfed)",
    "household.land_records_state": "Land Records State",
    "household.income_annual": "Household Annual Income (INR)",
    "household.income_monthly": "Household Monthly Income (INR)",
    "household.bpl_status": "Household is Below Poverty Line",
    "household.ration_card_type": "Ration Card Category",
    "household.ration_card_number": "Ration Card Number",
    "household.size": "Household Size (number of members)",
    "household.dependent_count": "Number of Dependents",
    "household.residence_type": "Household Residence Type (rural/urban/semi-urban)",
    "household.domicile_years": "Years of Domicile in State",
    "enrollment.epfo": "Enrolled in EPFO",
    "enrollment.nps": "Enrolled in NPS",
    "enrollment.esic": "Enrolled in ESIC",
    "enrollment.pmjdy": "Enrolled in PM Jan Dhan Yojana",
    "enrollment.ayushman": "Enrolled in Ayushman Bharat",
    "enrollment.pmkisan": "Enrolled in PM-KISAN",
    "enrollment.mudra": "Availed MUDRA loan",
    "scheme.prerequisite_scheme_id": "Prerequisite Scheme",
    "scheme.last_applied_date": "Last Scheme Application Date",
    "scheme.benefit_received": "Scheme Benefit Already Received",
    "scheme.application_state": "State of Application",
    "tax.income_tax_payer": "Applicant Pays Income Tax",
    "tax.gst_registered": "Business is GST Registered",
    "tax.turnover_annual": "Annual Business Turnover (INR)",
    "location.state": "State",
    "location.district": "District",
    "location.village": "Village",
    "location.pin_code": "PIN Code",
    "location.tribal_area": "Located in Scheduled Tribal Area",
    "location.flood_prone": "Located in Flood-Prone Area",
    "health.disability_certificate": "Has Disability Certificate (UDID)",
    "health.chronic_illness": "Has Chronic Illness",
    "health.pregnancy_status": "Applicant is Pregnant",
    "health.child_count": "Number of Children",
    "employment.sector": "Employment Sector (organised/unorganised)",
    "employment.daily_wage": "Daily Wage (INR)",
    "employment.contract_type": "Employment Contract Type",
}
