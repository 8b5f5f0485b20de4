"""Rules and reference tables as data."""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    name: str
    type: str
    pattern: str
    confidence: float


# The patterns of the core rule set, in their order.
CORE = [
    Rule("PAN", "PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.8),
    Rule("AADHAAR", "AADHAAR", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", 0.8),
    Rule("EMAIL", "EMAIL", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0.8),
    Rule("PHONE", "PHONE", r"(?:\+91[-\s]?)?(?:\(?\d{3}\)?[-\s]?)?\d{3}[-\s]?\d{4}|(?:\+91[-\s]?)?[6-9]\d{9}\b", 0.8),
    Rule("CREDIT_CARD", "CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0.8),
    Rule("IFSC", "IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.8),
    Rule("PASSPORT", "PASSPORT", r"\b[A-Z][0-9]{7}\b", 0.8),
    Rule("DRIVING_LICENSE", "DRIVING_LICENSE", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{4}\s?[0-9]{7}\b", 0.8),
    Rule("DATE_OF_BIRTH", "DATE_OF_BIRTH", r"\b(?:0[1-9]|[12][0-9]|3[01])[-/](?:0[1-9]|1[0-2])[-/](?:19|20)\d{2}\b", 0.8),
    Rule("IP_ADDRESS", "IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b", 0.8),
    Rule("BANK_ACCOUNT", "BANK_ACCOUNT", r"\b\d{9,18}\b", 0.8),
    Rule("PERSON_NAME", "PERSON_NAME", r"\b(?:[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+){1,3})\b", 0.8),
]

# The patterns of the rule set with modes; they ignore case.
MODES = [
    Rule("aadhaar", "AADHAAR", r"\b[2-9]\d{3}\s?\d{4}\s?\d{4}\b", 0.9),
    Rule("pan", "PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", 0.95),
    Rule("phone_in", "PHONE", r"\b(?:\+91[\-\s]?)?[6-9]\d{9}\b", 0.85),
    Rule("email", "EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", 0.95),
    Rule("credit_card", "CREDIT_CARD", r"\b(?:\d{4}[\s\-]?){3}\d{4}\b", 0.8),
    Rule("ifsc", "IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", 0.9),
    Rule("passport", "PASSPORT", r"\b[A-Z]\d{7}\b", 0.7),
    Rule("voter_id", "VOTER_ID", r"\b[A-Z]{3}\d{7}\b", 0.75),
    Rule("dob", "DOB", r"\b\d{1,2}[\\/\-\.]\d{1,2}[\\/\-\.]\d{2,4}\b", 0.6),
    Rule("ip", "IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", 0.7),
    Rule("ssn", "SSN", r"\b\d{3}[\-\s]?\d{2}[\-\s]?\d{4}\b", 0.75),
    Rule("gst", "GST", r"\b\d{2}[A-Z]{5}\d{4}[A-Z]\d[Z][A-Z0-9]\b", 0.95),
]
MODE_LEAST = {"strict": 0.3, "balanced": 0.6, "triage": 0.85}

# The watcher's patterns.
WATCHER = [
    Rule("email", "EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.8),
    Rule("phone_10", "PHONE", r"\b\d{10}\b", 0.8),
    Rule("phone_334", "PHONE", r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", 0.8),
    Rule("phone_plus", "PHONE", r"\+\d{1,3}[-.\s]?\d{10}\b", 0.8),
    Rule("aadhaar", "AADHAAR", r"\b\d{4}\s?\d{4}\s?\d{4}\b", 0.8),
    Rule("pan", "PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", 0.8),
    Rule("card", "CREDIT_CARD", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{3,4}\b", 0.8),
    Rule("ssn", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", 0.8),
]

# What a spaCy label counts as.
NLP_TYPES = {"PERSON": "PERSON_NAME", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "MONEY": "FINANCIAL_AMOUNT", "NORP": "NATIONALITY_GROUP"}

# Names by dictionary and form, in place of a language model; the rule's name is the label it stands for.
NAMED = [
    Rule("PERSON", "PERSON", r"\b(?:Dr|Mr|Mrs|Prof)\. [A-Z][a-z]+(?: [A-Z][a-z]+)?\b", 0.85),
    Rule("ORG", "ORG", r"\b(?:[A-Z][a-z]+ ){1,3}(?:Hospital|Bank|Industries|Services|University|Limited)\b", 0.85),
    Rule("GPE", "GPE", r"\b(?:Chennai|Mumbai|Delhi|Bangalore|Hyderabad|Kolkata|Pune|Ahmedabad|Jaipur|Lucknow)\b", 0.85),
]

# Weights in hundredths.
RISK_WEIGHT = {"AADHAAR": 100, "PAN": 95, "PASSPORT": 95, "EMAIL": 90, "PHONE": 85, "CREDIT_CARD": 95, "PERSON_NAME": 70, "DATE_OF_BIRTH": 60, "LOCATION": 50, "ORGANIZATION": 30, "IP_ADDRESS": 70, "DRIVING_LICENSE": 90, "BANK_ACCOUNT": 95, "IFSC": 20}
# Types that identify a person alone, and those that only one person has.
DIRECT_TYPES = ["AADHAAR", "PAN", "PASSPORT", "CREDIT_CARD", "DRIVING_LICENSE"]
UNIQUE_TYPES = ["AADHAAR", "PAN", "PASSPORT"]
# Types that are dangerous together, risk in hundredths.
DANGER = [
    ("DOB + Location", ["DATE_OF_BIRTH", "LOCATION"], 70),
    ("Name + Location", ["PERSON_NAME", "LOCATION"], 60),
    ("Name + DOB", ["PERSON_NAME", "DATE_OF_BIRTH"], 65),
    ("Name + DOB + Location", ["PERSON_NAME", "DATE_OF_BIRTH", "LOCATION"], 90),
    ("Name + Organization", ["PERSON_NAME", "ORGANIZATION"], 50),
    ("Phone + Name", ["PHONE", "PERSON_NAME"], 80),
    ("Email + Name", ["EMAIL", "PERSON_NAME"], 80),
]
# Words that tell a document's context, and what each adds in hundredths.
RISK_TERMS = [
    (20, ["patient", "diagnosis", "treatment", "hospital", "doctor", "prescription"]),
    (15, ["salary", "income", "bank", "account", "tax", "payment"]),
    (10, ["employee", "hr", "performance", "appraisal", "salary"]),
]
# Least scores of the levels.
LEVELS = [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW")]

# Sensitivity and category of each type; others are MEDIUM, Personal Information.
SENSITIVITY = {"AADHAAR": "HIGH", "PAN": "HIGH", "EMAIL": "MEDIUM", "PHONE": "MEDIUM", "PERSON_NAME": "MEDIUM-HIGH", "DATE_OF_BIRTH": "MEDIUM", "LOCATION": "LOW-MEDIUM", "ORGANIZATION": "LOW", "CREDIT_CARD": "CRITICAL", "BANK_ACCOUNT": "HIGH", "PASSPORT": "HIGH", "DRIVING_LICENSE": "HIGH", "IP_ADDRESS": "MEDIUM"}
CATEGORY = {
    "AADHAAR": "Biometric and Demographic Information",
    "PAN": "Financial Identifier",
    "EMAIL": "Personal Contact Information",
    "PHONE": "Personal Contact Information",
    "PERSON_NAME": "Personal Identifier",
    "DATE_OF_BIRTH": "Quasi-Identifier",
    "LOCATION": "Geographic Identifier",
    "ORGANIZATION": "Affiliation Information",
    "CREDIT_CARD": "Financial Payment Information",
    "BANK_ACCOUNT": "Financial Account Information",
    "PASSPORT": "Government ID",
    "DRIVING_LICENSE": "Government ID",
    "IP_ADDRESS": "Technical Identifier",
}
# Sensitivities in order, contexts that raise them by steps and the terms that tell them, and the risk of each.
SENSITIVITY_SCALE = ["LOW", "LOW-MEDIUM", "MEDIUM", "MEDIUM-HIGH", "HIGH", "CRITICAL"]
CONTEXT_TERMS = {
    "medical": (2, ["patient", "diagnosis", "treatment", "hospital", "doctor", "prescription", "medical", "health"]),
    "financial": (1, ["salary", "income", "bank", "account", "tax", "payment", "loan", "credit"]),
    "employment": (1, ["employee", "hr", "performance", "appraisal", "employment", "job"]),
    "legal": (1, ["court", "case", "attorney", "lawyer", "judgment", "legal"]),
}
SENSITIVITY_RISK = {"CRITICAL": ("EXTREME", 95), "HIGH": ("HIGH", 80), "MEDIUM-HIGH": ("ELEVATED", 65), "MEDIUM": ("MODERATE", 50), "LOW-MEDIUM": ("LOW", 30), "LOW": ("MINIMAL", 15)}

# What linkage takes as identifying.
STRONG_TYPES = ["AADHAAR", "PAN", "PASSPORT", "EMAIL", "PHONE", "DRIVING_LICENSE"]
WEAK_TYPES = ["PERSON_NAME", "DATE_OF_BIRTH", "BANK_ACCOUNT"]
TITLES = ["mr.", "mrs.", "ms.", "dr.", "prof.", "shri", "smt."]

# Names and places that an attacker would guess.
TITLE_NAMES = {
    "Dr.": ["Sharma", "Gupta", "Kumar", "Singh", "Reddy"],
    "Mr.": ["Patel", "Shah", "Mehta", "Joshi", "Desai"],
    "Mrs.": ["Devi", "Kumari", "Rani", "Kaur", "Nair"],
    "Prof.": ["Iyer", "Rao", "Chatterjee", "Banerjee", "Sen"],
}
CITIES = ["Chennai", "Mumbai", "Delhi", "Bangalore", "Hyderabad", "Kolkata", "Pune", "Ahmedabad", "Jaipur", "Lucknow"]
# Mail domains that tell nothing, and patterns of metadata.
OPEN_DOMAINS = ["gmail.com", "yahoo.com", "outlook.com"]
METADATA_PATTERNS = [r"author:\s*\w+", r"created:\s*\d{4}", r"modified:\s*\d{4}", r"subject:\s*\w+"]
# Points lost by severity, and types that call for redaction at once.
PENALTY = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3}
SSN_DIRECT = ["AADHAAR", "PAN", "PASSPORT", "SSN", "CREDIT_CARD", "BANK_ACCOUNT"]

# Sentences of reports.
TIP_DATES = "TIP: Generalize dates (e.g., '1990-05-15' → '1990' or 'Age: 30-35')"
TIP_PLACES = "TIP: Generalize locations (e.g., 'Chennai, Tamil Nadu' → 'South India')"
EXPLAIN_DIRECT = " unique identifier(s) that can directly identify individuals. Even after redaction, verify that no copies remain in metadata."
EXPLAIN_UNIQUE = "The combination of quasi-identifiers in this document is unique enough to identify a specific individual with high probability."
EXPLAIN_FEW = " people sharing these combined attributes. This poses significant re-identification risk."
EXPLAIN_OTHER = "Based on quasi-identifier analysis. Recommend redaction of highlighted entities before sharing."
SUMMARY = [
    ("): Document redaction is robust against common attacks. ", " minor findings."),
    ("): Redaction is reasonable but has ", " vulnerability(s) that should be addressed."),
    ("): Significant vulnerabilities detected. ", " issues require attention before sharing."),
    ("): Document has critical vulnerabilities. Not recommended for external sharing. Fix ", " issue(s)."),
]
KIND_ADVICE = {
    "CONTEXT_PREDICTION": "Expand redaction zones to include surrounding context",
    "CROSS_REFERENCE": "Consider synthetic data replacement instead of black-box redaction",
    "METADATA_EXPOSURE": "Run metadata scrubbing on final document",
}
NOTE_CRITICAL = " critical sensitivity item(s). Mandatory redaction required under applicable regulations. Recommend irreversible scrubbing and secure disposal of originals."
NOTE_HIGH = " high sensitivity item(s). Redaction strongly recommended for compliance with DPDP Act and related regulations."
NOTE_OTHER = "Standard privacy considerations apply. Redaction recommended for external sharing."
LINK_CRITICAL = ["CRITICAL: Do not share these documents together - they can identify specific individual(s)", "Remove or replace unique identifiers before sharing both documents"]
LINK_TYPES = ("Entity types causing linkage: ", ". Consider additional redaction of these types.")
LINK_MEDIUM = "Consider generalizing quasi-identifiers (dates, locations) to reduce linkage"
LINK_ANY = "For external sharing, consider: (1) Sharing documents separately, (2) Using synthetic replacement, or (3) Adding noise to quasi-identifiers"

# Roles and what each may do; an admin may do everything.
PERMISSIONS = ["view_documents", "upload_documents", "redact_documents", "view_vault", "manage_vault", "decrypt_files", "view_audit", "manage_users", "approve_requests", "export_data", "view_analytics", "manage_settings", "create_incidents", "manage_incidents", "reveal_redacted"]
ROLES = {
    "viewer": ["view_documents", "view_audit"],
    "analyst": ["view_documents", "upload_documents", "redact_documents", "view_vault", "view_audit", "view_analytics", "create_incidents"],
    "auditor": ["view_documents", "view_vault", "view_audit", "view_analytics", "export_data"],
    "admin": PERMISSIONS,
}
# Playbooks and the names of their steps.
PLAYBOOKS = {
    "pii_leak_response": ("CRITICAL", ["Identify", "Contain", "Assess", "Notify", "Remediate", "Document", "Review"]),
    "dsar_compliance": ("HIGH", ["Verify Identity", "Search", "Compile", "Review", "Execute", "Respond", "Log"]),
    "unauthorized_access": ("CRITICAL", ["Detect", "Revoke", "Investigate", "Contain", "Report"]),
}
# Report templates and their sections.
TEMPLATES = {
    "gdpr_article30": ["Controller Details", "Purposes of Processing", "Categories of Data Subjects", "Categories of Personal Data", "Recipients", "Transfers to Third Countries", "Retention Periods", "Technical & Organizational Measures"],
    "dpdp_compliance": ["Data Fiduciary Details", "Purpose Limitation", "Data Minimisation", "Storage Limitation", "Data Principal Rights", "Consent Management", "Significant Data Fiduciary Obligations", "Cross-Border Transfer"],
    "ccpa_inventory": ["Business Information", "Categories of PI Collected", "Sources of PI", "Business Purposes", "Third-Party Sharing", "Consumer Rights Procedures"],
    "hipaa_phi_audit": ["Covered Entity Info", "PHI Categories Found", "Access Controls", "Encryption Status", "Minimum Necessary Standard", "Breach Notification"],
}
