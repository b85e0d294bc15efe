"""Fixed values.

Word lists, lookup tables, thresholds and patterns that are part of the data contract: results are
only right when they are exactly these values.  Nothing in this module is logic.
"""

# --- Fixed values: feeds and headlines -------------------------------------------------------
HEADLINE_STOPWORDS = [
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "its", "of", "on", "or",
    "the", "to", "with", "after", "amid", "over", "s",
]
SEARCH_STOPWORDS = [
    "the", "a", "an", "and", "of", "to", "for", "in", "on", "at", "by", "with", "from", "as", "its",
    "is", "are", "be", "after", "over", "into", "amid", "new", "says", "said", "this", "that",
    "than", "more", "up", "down", "could", "may", "will", "has", "have",
]
SEARCH_WORD_PATTERN = r"[a-z][a-z'.-]+"
SAME_STORY_JACCARD = 0.5
BACKFILL_OVERLAP = 0.6
SEARCH_OVERLAP = 0.8
SEARCH_BLOCKED_HOSTS = [
    "bloomberg.com", "wsj.com", "ft.com", "investing.com", "reuters.com", "barrons.com",
    "connectmoney.com", "scanx.trade",
]
AGGREGATOR_HOST = "news.google.com"
PRIMARY_ORIGINS = ["issuer_filing", "regulator"]
UNKNOWN_PUBLISHER = "Unknown source"
LOOKBACK_DAYS = 3
FUTURE_SLACK_HOURS = 1
REJECTED_MEMORY_DAYS = 14
RETENTION_DAYS = 90
TEXT_CAP = 2500
CARD_REGIONS = ["US", "Europe", "APAC", "Global"]
CARD_REVIEW_STATUSES = ["reviewed", "unreviewed"]
CARD_ORIGINS = ["analyst_labeled", "auto_fetch"]
HKT_ZONE = "Asia/Hong_Kong"

# --- Fixed values: page extraction -----------------------------------------------------------
PAGE_SKIP_TAGS = [
    "script", "style", "noscript", "svg", "nav", "header", "footer", "form", "aside", "template",
]
PAGE_TEXT_TAGS = ["p", "li", "h1", "h2"]
PAGE_PARAGRAPH_MIN = 30
PAGE_EXCERPT_MAX = 2500
PAGE_EXCERPT_MIN = 200
PAGE_COVER_SCAN = 8000
PAGE_COVER_END = r"Section 13\(a\) of the Exchange Act\.\s*\S?"
PAGE_PUBLISHED_META = [
    "article:published_time", "dcterms.date.created", "datePublished", "pubdate", "publish-date",
    "date",
]
PAGE_JSON_PUBLISHED = r'"datePublished"\s*:\s*"([^"]{8,40})"'

# --- Fixed values: identity of URLs and headlines --------------------------------------------
EVENT_URL_DROPPED = ["fbclid", "gclid"]
EVENT_URL_DROPPED_PREFIX = "utm_"
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid",
    "fbclid", "mc_cid", "mc_eid", "igshid", "_hsenc", "_hsmi", "vero_id", "ref_src",
]
UUID5_URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"
TYPOGRAPHY = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
ANCHOR_TOKEN = (
    r"(?i)\d|\b(?:first|second|third|fourth) quarter\b|\bq[1-4]\b|\b(?:january|february|march|april|"
    r"may|june|july|august|september|october|november|december)\b"
)
NOVELTY_WINDOW_SECONDS = 7 * 86400
IDENTITY_VERSION = "identity-v1"
IDENTITY_NUMBER = r"(?i)[$€£]?\d+(?:[.,]\d+)*(?:%|\s*(?:billion|million|bn|bps))?"

# --- Fixed values: priority ------------------------------------------------------------------
PRIORITY_VERSION = "priority-v1"
PRIORITY_ORDER = ["urgent", "important", "useful", "needs_review"]
SEVERITY_ORDER = ["critical", "substantial", "bounded", "unknown"]
TIME_ORDER = ["48h", "7d", "monitor"]
LINKAGE_ORDER = ["direct", "sector", "indirect", "unknown"]
STRENGTH_ORDER = ["primary", "reported", "unknown"]
URGENT_RISK = (
    r"(?i)\b(payment default|defaulted|suspend(?:s|ed)? withdrawals|withdrawal suspension|"
    r"redemption (?:gate|suspension)|bankruptcy|material impairment)\b"
)
REASON_ABSENCE_EN = (
    r"(?i)\b(?:no|not|without)\b.{0,120}\b(?:disclos\w*|provid\w*|nam\w*|mention\w*|"
    r"detail\w*|figure\w*|term\w*|giv\w*)\b"
)
REASON_ABSENCE_ZH = r"(?:未|没有|无).{0,80}(?:披露|提供|提及|说明|点名|给出|公布|涉及)"
SEVERITY_ZH = {"critical": "严重", "substantial": "重大", "bounded": "有限"}
LINKAGE_ZH = {"direct": "直接", "sector": "行业", "indirect": "间接"}
REASON_TEMPLATE_EN = "Assessed severity: %s; linkage: %s."
REASON_TEMPLATE_ZH = "已评估严重程度：%s；关联程度：%s。"
UNASSESSED_EN = "Evidence has not been assessed."
UNASSESSED_ZH = "证据尚未充分核实，需人工复核。"
UNSUPPORTED_EVIDENCE = "Missing or insufficient source evidence"
QUOTE_MIN = 8
SUMMARY_ABSENCE_EN = (
    r"(?i)\b(no (?:further|other|additional|more|specific)\b.{0,60}\b(?:details?|figures?|information|data|terms)\b"
    r"|no (?:specific )?(?:managers?|funds?|figures)\b.{0,40}\b(?:named|disclosed|provided|given)\b"
    r"|(?:was|were) not (?:provided|disclosed|given)"
    r"|(?:did|does|do) not (?:provide|disclose|give|name) (?:any )?(?:further|more|additional|other)?"
    r"|provides? no (?:further|additional|other) detail|consisted only of the headline|beyond the headline)"
)
SUMMARY_ABSENCE_ZH = r"(未|没有)(?:进一步)?予?(提供|披露|给出|说明|点名|提及)|仅(有|包含)标题"
SENTENCE_SPLIT_EN = r"""(?<=[.!?])\s+|(?<=[.!?]["'”’)])\s+"""
SENTENCE_SPLIT_ZH = r"(?<=[。！？])|(?<=[。！？][”’）])"
CJK_PATTERN = r"[一-鿿]"

# --- Fixed values: evidence capture ----------------------------------------------------------
GATE_MARKERS = (
    r"(?i)already have an account|subscribe to (?:continue|read)|sign in to (?:continue|read)|"
    r"to continue reading|members only|this article is for subscribers|already a subscriber|"
    r"subscribe now for unlimited"
)
CAPTURE_ARTICLE_CHARS = 400
CAPTURE_EXCERPT_CHARS = 150
BOILERPLATE_REPEATS = 3

# --- Fixed values: evidence and decision contract --------------------------------------------
SOURCE_KINDS = [
    "filing", "regulatory_record", "issuer_release", "ratings_analysis", "independent_reporting",
    "discovery_only", "other",
]
ACCESS_STATUS = ["accessible", "partial", "unavailable"]
EVIDENCE_SCOPES = ["full_text", "primary_excerpt", "metadata_only"]
DATE_PRECISIONS = ["datetime", "date", "month", "unknown"]
GATE_NAMES = ["evidence", "identity", "relevance", "materiality", "transmission", "novelty"]
GATE_OUTCOMES = ["pass", "fail", "review_required", "not_evaluated"]
RECOMMENDATIONS = [
    "priority_shortlist", "shortlist", "reserve_manual_only", "suppress", "review_required",
]
SELECTED_RECOMMENDATIONS = ["priority_shortlist", "shortlist"]
REASON_CODES = [
    "no_relevance", "routine_activity", "insufficient_evidence", "ambiguous_identity",
    "conflicting_evidence", "duplicate", "no_new_fact", "below_materiality", "weak_transmission",
    "below_band", "capacity", "shortlisted", "critical_review", "override_approved",
    "draft_invalid",
]
PUBLICATION_STATUS = ["not_selected", "pending_review", "approved", "published", "corrected"]
ANALYST_ONLY_PUBLICATION = ["approved", "published", "corrected"]
ASSET_CLASSES = ["venture_capital", "real_estate", "private_equity", "private_credit"]
RELEVANCE_LEVELS = ["A", "B", "C"]
COMPONENTS = [
    "portfolio_fit", "materiality", "investment_transmission", "actionability",
    "source_credibility", "novelty",
]
ARTICLE_FIELDS = [
    "article_id", "title", "original_url", "canonical_url", "publisher", "originating_publisher",
    "discovery_method", "source_kind", "published_at", "published_date_precision", "event_date",
    "first_seen_at", "retrieved_at", "access_status", "evidence_scope", "evidence_hash",
    "evidence_local_ref", "claims", "supersedes_article_id",
]
ARTICLE_NULLABLE = [
    "originating_publisher", "published_at", "event_date", "evidence_hash", "evidence_local_ref",
    "supersedes_article_id",
]
INFERENCE_ALLOWLIST = [
    "article_id", "title", "original_url", "canonical_url", "publisher", "originating_publisher",
    "source_kind", "published_at", "published_date_precision", "event_date", "access_status",
    "evidence_scope", "body",
]
EVALUATOR_ONLY = [
    "decision", "analyst_id", "relevance_label", "materiality_tier", "event_group_id",
    "gold_event_group_id", "must_not_miss", "rationale", "evidence_access", "reviewed_on", "cohort",
    "challenge_category", "categories", "selection_reason", "split", "partition_reason", "gold",
    "labels",
]
CREDENTIAL_KEY = r"(?i)api[_-]?key|secret|token|password|authorization"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_MONTH = r"^\d{4}-\d{2}$"
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)$"
TIER_SOURCE_KINDS = {
    "manager_newsroom": "issuer_release", "regulator_filing": "filing",
    "independent_publication": "independent_reporting",
}
GAP_REASONS = [
    "index_unreachable", "index_empty", "no_index_published", "pagination_truncated",
    "article_inaccessible", "article_links_unavailable", "index_dates_unavailable",
    "roster_pending",
]

# --- Fixed values: scoring -------------------------------------------------------------------
ANCHORS = {
    "portfolio_fit": [0, 10, 20, 25, 30],
    "materiality": [0, 5, 15, 20, 25],
    "investment_transmission": [0, 5, 10, 15, 20],
    "actionability": [0, 3, 6, 8, 10],
    "source_credibility": [0, 4, 7, 10],
    "novelty": [0, 2, 5],
}
MIN_SOURCE_CREDIBILITY = 7
MIN_MATERIALITY = 15
MIN_TRANSMISSION_A_B = 10
MIN_TRANSMISSION_C = 15
MIN_NOVELTY = 2
BANDS = [
    (80, 100, "priority_shortlist"), (70, 79, "shortlist"), (60, 69, "reserve_manual_only"),
    (0, 59, "suppress"),
]
GATE_REASONS = {
    "evidence": "insufficient_evidence", "identity": "ambiguous_identity",
    "relevance": "no_relevance", "materiality": "below_materiality",
    "transmission": "weak_transmission", "novelty": "no_new_fact",
}
CRITICAL_REVIEW_TYPES = [
    "credit_stress", "regulatory", "financial_results", "liquidity_secondaries", "leadership",
]
EDITION_TARGET_MIN = 6
EDITION_TARGET_MAX = 10
EUROPE_TARGET = 0.2
TIE_BREAK_POINTS = 5
MIN_POSITIVE_EVENTS = 20

# --- Fixed values: rule baseline -------------------------------------------------------------
CONDITIONAL_ENTITY_RULES = ["ER06", "ER07", "ER08"]
CREDIT_CONTEXT = [
    "credit", "lending", "loan", "fund", "asset management", "investment", "portfolio", "borrower",
    "bdc", "private debt",
]
TICKER_CONTEXT = ["nyse", "nasdaq", "ticker", "shares", "stock", "listed"]
EVENT_PHRASES = [
    ("credit_stress", "non_accrual", [
        "non-accrual", "nonaccrual", "default", "missed payment", "covenant breach",
        "restructuring", "impairment", "writedown", "write-down", "bankruptcy", "chapter 11"]),
    ("regulatory", "enforcement", [
        "sec charges", "enforcement action", "investigation", "subpoena", "consent order",
        "settlement with"]),
    ("ratings", "rating_action", [
        "downgrade", "upgraded", "outlook negative", "placed on watch", "affirmed rating",
        "assigned a rating"]),
    ("financial_results", "quarterly", [
        "quarterly results", "fourth quarter", "third quarter", "net asset value",
        "net investment income", "earnings"]),
    ("structured_finance", "clo", [
        "clo", "collateralized loan obligation", "securitization", "rated notes", "abs"]),
    ("liquidity_secondaries", "continuation", [
        "continuation fund", "secondary market", "gp-led", "tender offer"]),
    ("gp_stakes", "minority_stake", ["gp stake", "gp stakes", "minority stake in the manager"]),
    ("capital_formation", "final_close", [
        "final close", "closes", "closed", "closing of", "raised", "fundraising", "capital raise",
        "commitments"]),
    ("financing", "credit_facility", [
        "credit facility", "term loan", "refinancing", "unitranche", "financing package",
        "revolver"]),
    ("corporate_transaction", "acquisition", ["acquire", "acquisition of", "merger", "to buy"]),
    ("leadership", "appointment", [
        "appointed", "named managing director", "joins as", "steps down", "resigned"]),
    ("strategy_platform", "expansion", ["launches", "expands", "new platform", "partnership"]),
    ("macro_policy", "policy", [
        "federal reserve", "rate cut", "rate hike", "regulation proposed"]),
    ("market_conditions", "conditions", [
        "spreads widened", "market conditions", "issuance volume"]),
]
ROUTINE_PHRASES = [
    "award", "recognized as", "best places to work", "sponsorship", "webinar", "conference",
    "white paper", "ranking",
]
CRITICAL_TYPES = ["credit_stress", "regulatory"]
MACRO_TYPES = ["macro_policy", "market_conditions"]
AMOUNT_TYPES = ["financial_results", "structured_finance", "capital_formation"]
USD_AMOUNT = r"(?i)(?:us)?\$\s?([\d,.]+)\s?(billion|million|bn|mn|m|b)\b"
USD_AMOUNT_BILLION = ["billion", "bn", "b"]
LARGE_AMOUNT_MILLIONS = 1000
UPDATE_WORDING = r"(?i)\bupdate[ds]?\b|\brevised\b|\bcorrection\b"
UPDATE_STEMS = ["update", "revised", "correction"]  # one of them is in the folded form of every match
CREDIBILITY_BY_KIND = {
    "filing": 10, "regulatory_record": 10, "issuer_release": 7, "independent_reporting": 7,
    "ratings_analysis": 7, "discovery_only": 4, "other": 4,
}
CREDIBILITY_DEFAULT = 4

# --- Fixed values: amounts and drafts --------------------------------------------------------
CLAIM_AMOUNT = (
    r"(?i)(USD|EUR|GBP|\$|€|£)\s?(\d[\d,]*\.?\d*)\s*"
    r"(trillion|billion|bn|million|mn|thousand|\bm\b|\bk\b)?"
)
CLAIM_CURRENCY = {"$": "USD", "USD": "USD", "EUR": "EUR", "€": "EUR", "GBP": "GBP", "£": "GBP"}
CLAIM_UNIT = {
    "trillion": "trillion", "billion": "billion", "bn": "billion", "million": "million",
    "mn": "million", "thousand": "thousand", "m": "million", "k": "thousand",
}
FACT_NUMBER = (
    r"(?i)(\d[\d,]*\.?\d*)\s*(%|percent|万亿|亿|万|千|trillion|tn|billion|bn|b|million|mn|m|thousand|k)?"
)
FACT_SCALES = {
    "trillion": 1e12, "tn": 1e12, "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6,
    "m": 1e6, "thousand": 1e3, "k": 1e3, "万亿": 1e12, "亿": 1e8, "万": 1e4, "千": 1e3,
}
FACT_PERCENT = ["%", "percent"]
DRAFT_CURRENCIES = {
    "$": "USD", "usd": "USD", "美元": "USD", "€": "EUR", "eur": "EUR", "欧元": "EUR", "£": "GBP",
    "gbp": "GBP", "英镑": "GBP",
}
ENGLISH_HEDGES = [
    "may", "could", "expected", "alleged", "allegedly", "proposed", "reportedly", "unconfirmed",
    "not ", "no ", "denied", "if ",
]
CHINESE_HEDGES = ["可能", "预计", "据称", "拟", "未", "没有", "据报道", "未经证实", "否认", "若"]
HOLDING_CLAIMS = ["our position", "we hold", "holding in", "our stake"]
DRAFT_TEXT_FIELDS = [
    "headline_en", "summary_en", "interpretation_en", "headline_zh", "summary_zh",
    "interpretation_zh",
]

# --- Fixed values: labels and review queue ---------------------------------------------------
LABEL_FIELDS = [
    "article_id", "analyst_id", "decision", "relevance_level", "materiality_tier",
    "event_group_id", "entity_roles", "must_not_miss", "rationale", "evidence_access",
    "reviewed_on",
]
LABEL_ENUMS = {
    "decision": ["publish", "reserve", "reject", "review"],
    "relevance_level": ["A", "B", "C", "outside", "uncertain"],
    "materiality_tier": ["high", "medium", "low", "uncertain"],
    "must_not_miss": ["yes", "no"],
    "evidence_access": ["full", "partial", "inaccessible"],
}
LABEL_DATE_FORMATS = {"iso": "yyyy-M-d", "mdy": "M/d/yyyy", "dmy": "d/M/yyyy"}
QUEUE_BUCKETS = {
    "priority_shortlist": "shortlisted", "shortlist": "shortlisted",
    "reserve_manual_only": "reserve", "review_required": "review", "suppress": "suppressed",
}
QUEUE_BUCKET_ORDER = ["shortlisted", "reserve", "review", "suppressed"]

# --- Fixed values: structured classification output ------------------------------------------
CLASSIFICATION_REQUIRED = ["relevance_level", "primary_event_type", "event_identity", "components"]
ECONOMIC_ROLES = [
    "borrower", "lender", "sponsor", "manager", "fund", "insurer", "adviser_arranger", "other",
]
INVOLVEMENT_LEVELS = ["direct_involvement", "incidental_mention", "unresolved"]
READTHROUGH_BASES = ["comparable_exposure", "sector_aggregate", "market_terms"]
READTHROUGH_FIELDS = [
    "sector_id", "observed_change", "basis", "affected_population", "comparability_explanation",
    "evidence_refs",
]
CONSEQUENCE_CATEGORIES = [
    "financing", "risk", "return", "valuation", "liquidity", "deployment", "fundraising", "exit",
]
MIN_AFFECTED_EXPOSURE = 10
MIN_PROPAGATION_BASIS = 20
MIN_READTHROUGH_EXPLANATION = 15
