"""Settings of the evidence engine (fixed values: limits, prices, patterns)."""

CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP, CHUNK_MIN_MERGE = 900, 1200, 130, 120
EMBEDDING_MODEL, EMBEDDING_DIMS, EMBEDDING_USD_PER_MILLION = "text-embedding-3-large", 1024, 0.13
PREFETCH_DENSE, PREFETCH_SPARSE, RRF_K, FUSED_TOP_K, DOC_QUOTA, CONTEXT_TOP_K = 40, 40, 10, 20, 4, 8
WEIGHT_ORIGINAL, WEIGHT_REWRITE = 0.6, 0.4
OFFTOPIC_THRESHOLD = 0.28
MAX_FIGURES = 4
GROUNDED_FROM = 60.0
FIGURE_MIN_PX, FIGURE_MAX_ASPECT, FIGURE_MIN_BYTES = 150, 8.0, 5120
MARKER = r"\[\s*([CFT]\d{1,3}(?:\s*,\s*[CFT]\d{1,3})*)\s*\]"
MAX_PAGES, MIN_CHARS_PER_PAGE = 80, 200
RATE_MESSAGES, RATE_WINDOW_S, DAILY_CAP_USD = 20, 600, 5.0
HISTORY_MESSAGES, HISTORY_TOKENS = 12, 2000
STUCK_MINUTES = 45
QUOTE_CHARS, QUOTE_LEAST = 360, 180
TITLE_CHARS = 120
FLAT_COST_USD = 0.01
CAPTION_USD_PER_MILLION = (0.15, 0.60)
#: model -> USD per 1,000 tokens in and out.
PRICES = {"deepseek-chat": (0.00027, 0.00110), "gpt-4o-mini": (0.00015, 0.00060)}
TRANSITIONS = (
    ("uploaded", "queued"), ("queued", "processing"), ("processing", "text_ready"), ("processing", "rejected"),
    ("processing", "failed"), ("processing", "queued"), ("text_ready", "full_ready"), ("failed", "queued"),
)
REJECTING = ("PDF_PARSE_FAILED", "PDF_ENCRYPTED", "PDF_CORRUPT", "PDF_NO_TEXT_LAYER", "DOC_TOO_LARGE", "CONTENT_BLOCKED")
FAILING = ("EMBEDDING_FAILED", "VECTOR_STORE_FAILED", "STORAGE_FAILED")
BM25_K1, BM25_B = 1.2, 0.75
TERM = r"[\p{L}\p{N}]+"
WHITE = r"[ \t\r\n]+"
ABSTAIN = "I could not find support for this in the selected papers, so I will not guess at an answer."
EVAL_GATES = (("recall", 0.90), ("id_validity", 1.00), ("quote", 1.00), ("abstain", 0.90))
EVAL_K = 8
