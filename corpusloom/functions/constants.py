"""Fixed values.

Everything here must equal the values the application's results depend on:
word lists, weights, limits and literal formats.
"""

from __future__ import annotations

# --- white space as Python's str.strip and \s see it --------------------------
WS_CODES = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WS_CHARS = "".join(chr(code) for code in WS_CODES)
#: The same set as the body of a Java character class, for use inside negated classes.
WS_FLAT = "".join(f"\\u{code:04x}" for code in WS_CODES)
#: The same set again, arranged so that a Latin character costs one table lookup and
#: one range test (three times faster on long texts than the flat form).
WS_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)

# --- chunking -----------------------------------------------------------------
CHUNK_SIZE = 1500
CHUNK_OVERLAP = 400
SENTENCE_SLACK = 200
SPACE_SLACK = 100

# --- retrieval ----------------------------------------------------------------
QUERY_STOPWORDS = (
    "a an and are as at be but by do for from get got has have he her him his how "
    "if in into is it its just me my no nor not now of on or our out own she so "
    "some than that the their them then there these they this those through to too "
    "very was we were what when where which who will with would you your"
).split()
MAX_QUERY_TOKENS = 12
PHRASE_MAX_CHARS = 60
TERMS_BASE = 6
TERMS_SCRIPTURE = 10
EXACT_PHRASE_POINTS = 100
TOKEN_POINTS = 20
TOKEN_RATIO_MIN = 0.6
MISSING_DISTANCE = 1e9
RESULT_CAP = 14
PASSAGE_CAP = 10
CONTEXT_CAP = 8
CONTEXT_FETCH = 50
HISTORY_CAP = 20
SOURCES_CAP = 20
FORCED_K = 8
BOOKS = ["an1", "an2"]

# --- topic search -------------------------------------------------------------
WEIGHT_CHAIN = 3
WEIGHT_COMMENTARY = 1
WEIGHT_SUTTA = 1
BONUS_CATEGORY_EQ = 130.0
BONUS_CATEGORY_PHRASE = 70.0
BONUS_QUERY_IN_CHAIN = 85.0
BONUS_ITEM_EQ = 110.0
BONUS_ITEM_PHRASE = 50.0
BONUS_ITEM_CONTAINED = 37.5
BONUS_TEXT_LONG = 95.0
BONUS_TEXT_MEDIUM = 72.0
BONUS_LEAD_IN = 320.0
LEAD_IN_CHARS = 260
BONUS_COMMENTARY = 38.0
NO_CHAIN_FACTOR = 0.82
CHAIN_SCALE = 1000.0
MAX_COLUMNS_DEFAULT = 3
MAX_CONTEXT_CHARS = 12000
MIN_REPLY_CHARS = 42
SUGGESTIONS_MARKER = "SUGGESTIONS_JSON:"
MAX_SUGGESTIONS = 5
MAX_SUGGESTION_CHARS = 320

# --- small-talk classifier ----------------------------------------------------
GREETING_MAX_CHARS = 140
SUBSTANTIVE = (
    r"\b(?:what|why|when|where|who|whom|which|"
    r"how\s+(?:do|does|did|can|could|should|would|is|are|was|were|many|much|long|far|often|come|work)|"
    r"explain|meaning|define|sutta|suttas|dhamma|buddha|noble|eightfold|path|meditation|jhana|karma|rebirth|nibbana|nirvana|"
    r"teach|teaching|compare|difference|according|chapter|verse|quote|paraphrase|discourse|canon|an\d+\s*\.|c?an\s*\d)\b"
)
GREETING_PHRASES = [
    "hi", "hello", "hey", "yo", "sup", "howdy", "greetings", "hi there", "hey there", "hello there",
    "good morning", "good afternoon", "good evening", "good day", "thanks", "thank you", "thankyou",
    "thx", "ty", "ok", "okay", "ok thanks", "okay thanks", "thanks a lot", "thank you so much", "tysm",
    "bye", "goodbye", "see you", "cya", "later", "whats up", "what's up", "wassup", "how are you",
    "how are u", "how r u", "nice to meet you", "morning", "evening", "afternoon",
]
GREETING_TOKENS = [
    "hi", "hey", "hello", "yo", "sup", "there", "you", "thanks", "thank", "thx", "ty", "ok", "okay",
    "yes", "no", "hm", "hmm", "cool", "nice", "great", "good", "well", "morning", "afternoon",
    "evening", "day", "bye", "welcome", "back", "again", "a", "the", "to", "so", "very", "just",
    "im", "i", "am", "are", "is", "it", "me", "my", "we",
]

# --- query expansion: (words that trigger it, phrase added) -------------------
NO_ANSWER = "(no answer)"
NEW_CHAT_TITLE = "New chat"
DEFAULT_CHAT_TITLE = "Chat"

# --- spoken and written identifiers -------------------------------------------
SPOKEN_NUMBERS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty",
]
SPOKEN_TENS = {
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90,
}
LEAD_CHARS = 560
LEAD_CHARS_SIMPLE = 800
SUPPORT_CHARS = 2000
HEADER_WINDOW = 90
HEADER = "### REFERENCE:"
MARKERS = {
    r"4\.4\.36": "AN 4.36 (Doṇa Sutta)",
    r"4\.4\.37": "AN 4.37 (Aparihāna Sutta)",
    r"4\.5\.41": "AN 4.41 (Samādhi-bhāvanā Sutta)",
    r"4\.5\.49": "AN 4.49 (Vipallāsa Sutta)",
}

# --- alignment ----------------------------------------------------------------
MAP_OK_MIN = 0.20
MAP_SUSPECT_MIN = 0.10
CHAIN_BOOKS = [3, 4, 5, 6]
REVIEW_BOOK = 7
TRANSCRIPT_OPENING_CHARS = 650
CANON_OPENING_CHARS = 700

# --- semantic mapping ---------------------------------------------------------
SPLIT_MARKERS = [
    "that's the end of the sutta",
    "that is the end of the sutta",
    "the next sutta is",
    "now we come to another sutta",
    "another very interesting sutta",
    "the sutta continues",
]
MIN_ROW_CHARS = 300
MAX_UNITS_PER_ROW = 3
MIN_UNIT_BEFORE = 150
MIN_UNIT_AFTER = 60
MIN_UNIT_CHARS = 50
TOP_K_DEFAULT = 8
MIN_CANDIDATES = 5
SIMILARITY_CHARS = 320
TITLE_CHARS = 120
OPENING_CHARS = 300
KEYWORDS_MAX = 12
MAX_UNIT_PROMPT_CHARS = 2000
FALLBACK_SCORE_MIN = 0.22
FALLBACK_GAP_MIN = 0.03
SMALL_GAP_MAX = 0.02
SAMPLE_IDS = 12
MATCH_TYPES = ["exact", "probable", "mixed", "unknown"]
KEYWORD_STOPWORDS = (
    "the a an and or to of in on at for with from as it this that these those are is was were be been "
    "being i we you he she they them his her their my our us me your very then when what where which who "
    "why how also just only so thus listen apply mind buddha dhamma mendicants monks sutta"
).split()

# --- portable vector table ----------------------------------------------------
BUNDLE_FORMAT = "vector_bundle_v2"
SHARD_FORMAT = "vector_shard_v1"
MANIFEST_FORMAT = "vector_manifest_v1"

#: Longest latency a turn may report.
LATENCY_MAX_MS = 3_600_000
