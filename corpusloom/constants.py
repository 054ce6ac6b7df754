"""Limits, lookup tables, patterns and texts that results depend on."""

# Search.
DEFAULT_SEARCH_K = 8
MIN_SEARCH_K = 1
MAX_SEARCH_K = 100
DEFAULT_K_OVERLAP = 2
STATS_SAMPLE_LIMIT = 1000

# Chunking.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
MAX_CHUNKS_PER_DOCUMENT = 1000
TEXT_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CODE_SEPARATORS = ("\nclass ", "\ndef ", "\n\tdef ", "\n\n", "\n", " ", "")
FENCE = "```"
FENCE_PATTERN = r"```[\s\S]*?```"
API_SECTION_PATTERN = r"### .+?(?=\n###|\n##|\Z)"

# Validation.
MIN_QUERY_LENGTH = 1
MAX_QUERY_LENGTH = 1000
MIN_TEMPERATURE = 0.0
MAX_TEMPERATURE = 1.0
MIN_MAX_TOKENS = 100
MAX_MAX_TOKENS = 4000
MAX_FILE_BYTES = 50 * 1024 * 1024
UNSAFE_FILENAME_CHARS = '<>:"/\\|?*'

# Caches.
MIN_RESPONSE_LENGTH = 10
MIN_EMBED_TEXT_LENGTH = 5
RESPONSE_CACHE_SIZE = 1000
EMBEDDING_CACHE_SIZE = 10000

# Embedding and prompts.
EMBEDDING_DIM = 384
SHORT_QUERY_WORDS = 3
SHORT_QUERY_SUFFIX = " documentation reference"
CONTEXT_HITS = 3
CODE_CONTEXT_HITS = 5
WEB_RESULTS_PER_QUESTION = 3

# Requests per client and minute, by kind of request.
RATE_LIMITS = {"search": 60, "upload": 10, "query": 30, "generation": 20}

# Upper bounds of the latency buckets, in seconds.
LATENCY_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)

# Mean text length below which a batch size applies; the last one is for longer texts.
BATCH_TIERS = ((500, 200), (2000, 100), (5000, 50))
BATCH_TIER_LONG = 25
BATCH_TIER_EMPTY = 100

# Technology key to display name.
TECHNOLOGIES = {
    "python": "Python 3.13",
    "fastapi": "FastAPI",
    "django": "Django 5.0",
    "react_nextjs": "React & Next.js",
    "nodejs": "Node.js",
    "postgresql": "PostgreSQL",
    "mongodb": "MongoDB",
    "typescript": "TypeScript",
    "langchain": "LangChain",
}
DEFAULT_TECHNOLOGY = "General"

# Words that route a question to a topic; the first topic that matches wins.
TOPIC_WORDS = {
    "python": ("python", "programming", "code", "function", "tutorial"),
    "web": ("fastapi", "django", "flask", "web", "api"),
}
TOPIC_SCORES = {"python": 0.6, "web": 0.6, "general": 0.5}

# Score of a web result by provider and kind.
WEB_SCORES = {
    ("local_firecrawl", "page"): 0.95,
    ("firecrawl", "page"): 0.9,
    ("duckduckgo_web", "snippet"): 0.8,
    ("duckduckgo", "abstract"): 0.8,
    ("duckduckgo", "topic"): 0.7,
}
# Title used when a web result has none.
WEB_TITLES = {
    ("local_firecrawl", "page"): "Local Firecrawl Result",
    ("firecrawl", "page"): "Web Result",
    ("duckduckgo_web", "snippet"): "Search Result",
    ("duckduckgo", "abstract"): "DuckDuckGo Result",
}
# Providers in the order in which they are tried.
WEB_PROVIDERS = ("local_firecrawl", "firecrawl", "duckduckgo_web", "duckduckgo", "fallback")
# Characters kept of a web result by kind.
WEB_CUTS = {"page": 2000, "abstract": 1000, "topic": 800}
MIN_SNIPPET_LENGTH = 20

# Suffix to format of the extraction handlers.
FORMATS = {
    ".txt": "text",
    ".md": "text",
    ".markdown": "text",
    ".rtf": "rtf",
    ".csv": "csv",
    ".docx": "docx",
    ".xlsx": "excel",
    ".pptx": "powerpoint",
    ".odt": "odt",
}
CSV_PREVIEW_ROWS = 10
SHEET_PREVIEW_ROWS = 5
