"""Fixed values of the domain rules.

Everything here must equal the rule book for results to be right; it is data,
kept in one place and in its natural order.
"""

# URL rules.
ALLOWED_SCHEMES = ["http", "https"]
DENIED_EXTENSIONS = [
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z", ".exe", ".bin",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".tiff",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".webm",
    ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".css", ".js", ".json", ".xml", ".rss",
]
DENIED_PATHS = [
    "/login", "/signin", "/sign-in", "/signup", "/sign-up", "/register",
    "/auth", "/oauth", "/password", "/account", "/dashboard", "/admin",
    "/cart", "/checkout", "/basket", "/order", "/pay", "/billing",
    "/terms", "/privacy", "/cookie", "/legal", "/disclaimer",
    "/feed", "/wp-admin", "/wp-login", "/wp-content", "/cdn-cgi",
    "/tag/", "/category/", "/author/",
]
PATH_PRIORITY = {
    "about": 90, "about-us": 90, "company": 90, "who-we-are": 90,
    "mission": 85, "services": 85, "solutions": 85, "what-we-do": 85,
    "products": 80, "features": 80, "platform": 80, "technology": 80,
    "pricing": 75, "plans": 75,
    "contact": 70, "contact-us": 70, "get-in-touch": 70,
    "careers": 65, "jobs": 65, "team": 65,
}
ROOT_PRIORITY = 100
OTHER_PRIORITY = 10
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source", "mc_cid", "mc_eid",
]

# Local names and the IPv4 blocks that are not public (first, last).
LOCAL_HOSTS = ["localhost", "localhost.localdomain", "broadcasthost"]
LOCAL_SUFFIXES = [".local", ".localhost", ".internal", ".localdomain"]
NON_PUBLIC_IPV4 = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
]

# Contact patterns.
EMAIL_PATTERN = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
EMAIL_BAD_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js"]
EMAIL_BAD_HOSTS = ["example.com", "domain.com", "yoursite.com", "yourdomain.com", "email.com"]
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"
DATE_PATTERN = r"^(19|20)\d{2}[-/.](0[1-9]|1[0-2])[-/.](0[1-9]|[12]\d|3[01])$"
STREET_PATTERN = (
    r"(?i)\b\d{1,5}\s+[A-Za-z0-9\s.,#]{3,50}\s+"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Suite|Ste|Floor|Fl)\b"
    r"(?:[A-Za-z0-9\s.,#]{0,30}\b[A-Z]{2}\b\s+\d{5}(?:-\d{4})?)?"
)

# Social platforms in order of precedence.
SOCIAL_PATTERNS = {
    "linkedin": r"(?i)linkedin\.com/(?:company|in|school)/",
    "twitter": r"(?i)twitter\.com/|x\.com/",
    "facebook": r"(?i)facebook\.com/",
    "instagram": r"(?i)instagram\.com/",
    "youtube": r"(?i)youtube\.com/(?:channel|c|user|@)",
    "github": r"(?i)github\.com/",
}
SKIPPED_HREFS = ["#", "javascript:", "mailto:", "tel:", "data:"]

# Structured-data types that are kept.
BUSINESS_TYPES = [
    "organization", "localbusiness", "corporation", "person",
    "product", "service", "website", "company", "store",
]

# Page parts that carry no business copy.
DROPPED_TAGS = [
    "script", "style", "noscript", "iframe", "svg", "canvas",
    "nav", "header", "footer", "aside", "form", "button", "dialog",
]
DROPPED_MARKERS = [
    "cookie", "consent", "gdpr", "banner", "popup", "modal", "overlay",
    "advertisement", "ad-container", "promo", "newsletter", "subscribe",
]
DROPPED_ROLES = ["banner", "dialog", "alertdialog", "navigation"]

# Evidence rules.
QUOTE_PUNCTUATION = r"""[*_#`"'()\[\]:,.-]"""
HEADCOUNT_WORDS = ["employee", "employees", "headcount", "staff", "team of", "workforce", "people"]
SUBSCRIPTION_WORDS = ["saas", "subscription", "software as a service"]
SANDBOX_MARKERS = [
    "quotes to scrape", "quotes.toscrape", "demo sandbox",
    "educational demo", "sandbox for scraping", "for scraping",
]
SANDBOX_MODEL = "Unknown / Non-Commercial"
SANDBOX_VALUE = "None / Unknown - Non-commercial educational demonstration sandbox."

# Profile defaults, of a campaign that leaves a list empty and of a job without any profile.
CAMPAIGN_DEFAULTS = {
    "target_industries": ["SaaS", "Software", "Tech"],
    "target_company_size": ["11-50", "51-200", "201-500", "500+"],
    "target_geographies": ["Global", "North America", "Europe", "India"],
    "model_signal": "B2B focus",
    "technology_signal": "Proprietary software or digital service",
    "negative_signals": ["Pure consumer B2C marketplace", "Personal blog", "Gambling or adult content"],
    "min_icp_threshold": 60,
}
PROFILE_DEFAULTS = {
    "target_industries": ["SaaS", "Enterprise Software", "Logistics Tech", "Supply Chain", "Fintech", "E-Commerce Tech"],
    "target_company_size": ["11-50", "51-200", "201-500", "500+"],
    "target_geographies": ["Global", "North America", "United States", "Europe", "India"],
    "required_signals": ["B2B focus", "Proprietary software or digital service offering"],
    "negative_signals": ["Pure consumer B2C marketplace", "Personal hobby blog", "Gambling or adult content"],
    "min_icp_threshold": 50,
}

# Job life cycle and event status.
JOB_MOVES = [
    ("QUEUED", "RUNNING"), ("QUEUED", "CANCELLED"),
    ("RUNNING", "COMPLETED"), ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED"),
]
ACTIVE_STATES = ["QUEUED", "RUNNING"]
FINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED"]
LEAD_STATES = ["NEW", "REVIEW", "QUALIFIED", "CONTACTED", "REJECTED"]
EVENT_STATUS = {
    "job_created": "QUEUED",
    "job_completed": "COMPLETED",
    "job_failed": "FAILED",
    "job_cancelled": "CANCELLED",
}

# Error texts.
PERMANENT_ERRORS = [
    "invalid url", "ssrf protection", "unsupported scheme", "validationerror", "malformed json",
    "blocked_by_robots", "not found", "bad request", "unauthorized", "forbidden",
]
TRANSIENT_ERRORS = [
    "timeout", "timed out", "connection", "connecterror", "network", "readerror",
    "500", "502", "503", "504", "429", "rate limit", "server error", "temporarily unavailable",
]

# Thresholds, prices and limits.
QUALIFIED_SCORE = 50
STRONG_SCORE = 80
MODERATE_SCORE = 60
PRICE_IN = 0.00000015
PRICE_OUT = 0.00000060
JOB_COST = {"QUALIFY": 0.0008, "CRAWL_AND_QUALIFY": 0.001}
MAX_ACTIVE_JOBS = 5
MAX_MONTHLY_CRAWLS = 100
USAGE_DAYS = 30
PROMPT_CHARS = 16000
PROMPT_MIN_TAIL = 300
CRAWL_MAX_PAGES = 6
CRAWL_MAX_DEPTH = 2
EXPORT_LIMIT = 1000
SEARCH_WEIGHTS = (0.60, 0.25, 0.15)
EXPORT_COLUMNS = [
    "company_name", "domain", "industry", "geography", "icp_score",
    "confidence_score", "status", "company_summary", "value_proposition",
]
LIST_COLUMNS = [
    "lead_id", "crawl_target_id", "company_name", "domain", "industry", "company_summary",
    "value_proposition", "icp_score", "confidence_score", "geography", "estimated_company_size",
    "status", "created_at",
]
SORT_COLUMNS = ["created_at", "icp_score", "confidence_score", "company_name"]
USAGE_COUNTERS = [
    "crawls", "pages_crawled", "leads_created", "ai_qualifications",
    "embeddings_generated", "jobs_completed", "jobs_failed",
]
