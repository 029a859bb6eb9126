"""Fixed values.

Everything here must keep exactly these values for results to agree with the published ones:
word lists, patterns, thresholds, rates and record layouts. They are data, not logic.
"""

# Abbreviation rewrites, applied in this order to lower-cased text.
ABBREVIATIONS = (
    (r"\bpls\b", "please"),
    (r"\bpwd\b", "password"),
    (r"\bcant\b", "cannot"),
    (r"\bcan not\b", "cannot"),
    (r"\bdept\b", "department"),
    (r"\buni\b", "university"),
    (r"\bcomp\b", "computer"),
    (r"\binfo\b", "information"),
    (r"\bthanx\b", "thanks"),
    (r"\bwifi\b", "wifi"),
    (r"\bwi-fi\b", "wifi"),
    (r"\bwi fi\b", "wifi"),
    (r"\be-?learning\b", "elearning"),
    (r"\blms\b", "elearning"),
    (r"\bu\b", "you"),
    (r"\burgntly\b", "urgently"),
    (r"\bplatfom\b", "platform"),
    (r"\bsis\b", "student information system"),
    (r"\bmis\b", "student information system"),
)

# Artefacts blanked before the abbreviations, in this order.
ARTEFACTS = (
    r"https?://\S+|www\.\S+",
    r"\S+@\S+\.\S+",
    r"\bmu-\d+\b",
    r"\d+",
)

# Screening patterns, matched against the whole field without regard to case.
TEST_TICKET = r"^\s*(test(ing)?( ticket)?( please ignore)?|xxx|ignore this)\s*$"
JUNK_DESCRIPTION = r"^\s*(as above|see subject|-|\.|n/?a)?\s*$"
SHORT_SUBJECT = 12
MIN_TOKENS = 3

# Names of the screening steps, in order.
SCREENING_STEPS = (
    "Raw records extracted",
    "Test / placeholder tickets removed",
    "Exact duplicate submissions removed",
    "Records with no usable free text removed",
    "Records with missing category label removed",
    "Records with no assigned resolver removed",
)

# Urgency words of the text-shape block; stand-ins for an unreadable time.
URGENT = r"urgent|asap|immediately"
DEFAULT_HOUR = 12
DEFAULT_WEEKDAY = 2

# Reference format, field lengths of a decision record and of a ticket.
REF_FORMAT = "MU-%04d"
DECISION_LIMITS = {"subject": 300, "description": 1000, "text_before": 600, "text_after": 600}
TICKET_LIMITS = {"subject": 300, "description": 2000, "resolution": 2000, "detail": 500}
EXAMPLE_TEXT = 160

# Ticket states.
OPEN, REFERRED, RESOLVED, DUPLICATE = "open", "referred", "resolved", "duplicate"

# Label provenance and the default training policy.
CORRECTED, ENRICHED, CONFIRMED = "corrected", "enriched", "confirmed"
TRAIN_POLICY = (CORRECTED, ENRICHED)

# Similarity bands (floor, label, observed transfer rate).
APPLICABILITY = (
    (0.80, "very likely to apply", 0.988),
    (0.70, "likely to apply", 0.960),
    (0.60, "may apply", 0.865),
    (0.50, "uncertain", 0.641),
    (0.00, "unlikely to apply", 0.000),
)

# Decision thresholds.
SAME_FIX = 0.80
STRONG_MATCH = 0.50
RESOLVE_ABOVE = 0.70
DUPLICATE_HYBRID = 0.85
DUPLICATE_LEXICAL = 0.80
AGREEMENT_BELOW = 0.8
ABSTAIN_BELOW = 0.30
FIRST_LINE = "Help Desk (Tier 1)"
ABSTAIN_GRID = (0.00, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50)

# Retrieval settings.
GROUP_FROM = 15
SHOW_FIXES = 4
SHOW_MATCHES = 5
RETRIEVE = 10
BLEND_GRID = (0.0, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0)
RANK_KS = (1, 3, 5, 10)
FIX_KS = (5, 10, 15)

# Sampling and tuning settings.
SEED = 42
TEST_SHARE = 0.20
FOLDS = 5
FRACTIONS = (0.05, 0.10, 0.20, 0.35, 0.50, 0.70, 0.85, 1.00)
REPEATS = 3
KNN_GRID = (5, 10, 15, 25)
ALPHAS = (0.1, 0.3, 1.0)
BOOTSTRAPS = 2000

# Lexical representation.
MIN_DF, MAX_DF, MAX_TERMS = 2, 0.85, 30000
LSA_DIMS = 300
# Steps of the ablation by name and blocks; the last is for routing alone.
ABLATION_STEPS = (
    ("Semantic text only", ("text",)),
    ("+ department metadata", ("text", "dept")),
    ("+ temporal context", ("text", "dept", "time")),
    ("+ text-shape context", ("text", "dept", "time", "shape")),
    ("+ predicted-category context", ("text", "dept", "time", "shape", "cat")),
)

# Task names and the pooled rules of the ensemble.
CLASSIFICATION, ROUTING, RECOMMENDATION = (
    "Ticket classification", "Resolver routing", "Resolution recommendation")
