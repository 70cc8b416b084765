"""Fixed values.

Everything below is a constant that results depend on (word lists, lookup
tables, thresholds and patterns), stated plainly so it can be checked by eye.
"""

# --- text -------------------------------------------------------------------

# The characters Python's str.split() treats as whitespace.
WHITESPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Characters that may stay at the edge of a token: word characters plus the
# Arabic and Devanagari blocks.
EDGE_KEEP = r"\p{L}\p{N}_\x{0600}-\x{06FF}\x{0900}-\x{097F}"

STRONG_MARKS = [".", "?", "!", "۔", "।", "॥", "。", "？", "！"]
MEDIUM_MARKS = [",", ";", ":", "،", "؛", "、", "，", "；", "："]

ABBREVIATIONS = [
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt",
    "inc", "ltd", "llc", "co", "corp", "plc",
    "eg", "ie", "etc", "vs", "approx", "dept", "est",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
    "mon", "tue", "wed", "thu", "fri", "sat", "sun",
    "am", "pm", "no", "vol", "fig", "pp",
]

CONJUNCTIONS = [
    "and", "but", "or", "so", "yet", "for", "nor",
    "because", "although", "though", "while", "whereas", "since",
    "if", "unless", "until", "when", "whenever", "where", "wherever",
    "that", "which", "who", "whom", "whose", "after", "before",
    "however", "therefore", "moreover", "furthermore", "meanwhile",
]

STOCK_PHRASES = [
    "thank you.", "thank you", "thanks for watching!", "thanks for watching",
    "thank you for watching.", "thank you for watching",
    "thanks for watching and see you next time.",
    "please subscribe to my channel.", "subtitles by the amara.org community",
    "you", "bye.", "bye", "okay.", ".", "...",
]

# --- languages and backends ---------------------------------------------------

# code, native name, English name, right-to-left
LANGUAGE_LABELS = [
    ("ar", "العربية", "Arabic", True),
    ("de", "Deutsch", "German", False),
    ("en", "English", "English", False),
    ("es", "Español", "Spanish", False),
    ("fa", "فارسی", "Persian", True),
    ("fr", "Français", "French", False),
    ("he", "עברית", "Hebrew", True),
    ("hi", "हिन्दी", "Hindi", False),
    ("it", "Italiano", "Italian", False),
    ("ja", "日本語", "Japanese", False),
    ("ko", "한국어", "Korean", False),
    ("ml", "മലയാളം", "Malayalam", False),
    ("nl", "Nederlands", "Dutch", False),
    ("pt", "Português", "Portuguese", False),
    ("ru", "Русский", "Russian", False),
    ("ta", "தமிழ்", "Tamil", False),
    ("te", "తెలుగు", "Telugu", False),
    ("tr", "Türkçe", "Turkish", False),
    ("ur", "اردو", "Urdu", True),
    ("zh", "中文", "Chinese", False),
]

# language, FLORES-200 code
FLORES_CODES = [
    ("ar", "arb_Arab"), ("bn", "ben_Beng"), ("de", "deu_Latn"), ("en", "eng_Latn"),
    ("es", "spa_Latn"), ("fa", "pes_Arab"), ("fr", "fra_Latn"), ("he", "heb_Hebr"),
    ("hi", "hin_Deva"), ("id", "ind_Latn"), ("it", "ita_Latn"), ("ja", "jpn_Jpan"),
    ("kn", "kan_Knda"), ("ko", "kor_Hang"), ("ml", "mal_Mlym"), ("mr", "mar_Deva"),
    ("nl", "nld_Latn"), ("pt", "por_Latn"), ("ru", "rus_Cyrl"), ("ta", "tam_Taml"),
    ("te", "tel_Telu"), ("tr", "tur_Latn"), ("ur", "urd_Arab"), ("vi", "vie_Latn"),
    ("zh", "zho_Hans"),
]

# Languages whose translation goes to the large multilingual model.
DEFAULT_ROUTES = [
    ("hi", "nllb-200"), ("te", "nllb-200"), ("ta", "nllb-200"), ("ml", "nllb-200"),
    ("kn", "nllb-200"), ("bn", "nllb-200"), ("mr", "nllb-200"), ("ur", "nllb-200"),
]
DEFAULT_BACKEND = "opus-mt"

# Translation models at hand, by name: source-target, or source-family.
PAIR_MODELS = ["en-fr", "en-de", "en-es", "en-zh", "en-ar", "en-hi", "en-dra"]

# target language, the family its model may belong to, the token that picks it there
FAMILY_TARGETS = [
    ("te", "dra", ">>tel<<"), ("ta", "dra", ">>tam<<"), ("ml", "dra", ">>mal<<"), ("kn", "dra", ">>kan<<"),
]

# language, synthesis voice
VOICES = [
    ("fr", "fr_FR-siwis-medium"), ("de", "de_DE-thorsten-medium"),
    ("es", "es_ES-davefx-medium"), ("ar", "ar_JO-kareem-medium"),
    ("te", "te_IN-maya-medium"), ("hi", "hi_IN-pratham-medium"),
]

CLONED_VOICE_LANGUAGES = [
    "ar", "cs", "da", "de", "en", "es", "fi", "fr", "he", "hi", "it",
    "ja", "ko", "nl", "no", "pl", "pt", "ru", "sv", "tr", "vi",
]

# kind, backend name, devices on which its timings may be quoted
BACKEND_CREDIBILITY = [
    ("stt", "faster-whisper", []),
    ("stt", "fastconformer", ["cuda"]),
    ("stt", "qwen3-asr", ["cuda"]),
    ("mt", "opus-mt", ["cpu", "cuda"]),
    ("mt", "nllb-200", ["cuda"]),
    ("mt", "routing", ["cuda"]),
    ("tts", "piper", ["cpu", "cuda"]),
    ("tts", "kokoro", ["cuda"]),
    ("tts", "chatterbox", ["cuda"]),
]

# script expected for a language, as a Unicode script name
# The script (or scripts) a language is written in.
TARGET_SCRIPTS = [
    ("ar", "Arabic"), ("de", "Latin"), ("en", "Latin"), ("es", "Latin"), ("fa", "Arabic"),
    ("fr", "Latin"), ("he", "Hebrew"), ("hi", "Devanagari"), ("it", "Latin"),
    ("ja", "Han+Hiragana+Katakana"), ("ko", "Han+Hangul"), ("ml", "Malayalam"), ("nl", "Latin"),
    ("pt", "Latin"), ("ru", "Cyrillic"), ("ta", "Tamil"), ("te", "Telugu"), ("tr", "Latin"),
    ("ur", "Arabic"), ("zh", "Han"),
]

# --- flow control and sessions -------------------------------------------------

# language (None is the default), comfortable_s, speedup_at_s, skip_at_s, max_speed
DEFAULT_POLICY = (0.5, 1.5, 6.0, 1.3)
MEASURED_POLICIES = [("ar", 0.4, 1.0, 6.0, 1.3)]

MAX_LAG_S, RECOVER_TO_S, WARN_LAG_S = 3.0, 1.0, 1.5
MAX_DURATION_S, MAX_LANGUAGES, MAX_IDLE_S, WARN_AT_FRACTION = 14400.0, 8, 900.0, 0.9
WATCHDOG_TICK_S = 5.0
SLO_SECONDS = 2.0
SAMPLE_CAP = 20_000
TENANT_TTL_S = 300.0

STAGES = ["committed", "translated", "tts_first_audio", "published"]
SESSION_STATUSES = ["starting", "live", "ended", "failed"]
LIVE_STATUSES = ["starting", "live"]
TRACK_PREFIX = "lang-"
SOURCE_TRACK = "source-audio"

SCHEMA_NAME_PATTERN = "^[a-z][a-z0-9_]{0,62}$"
RESERVED_SCHEMA_NAMES = ["public", "information_schema", "pg_catalog", "pg_toast"]

# --- audio ------------------------------------------------------------------------

MODEL_SAMPLE_RATE = 16_000
QUIET_FRAME_RMS = 0.005
SPEECH_WINDOW_RMS = 0.006
SPEECH_PEAK = 500
UTTERANCE_QUIET_S, UTTERANCE_MAX_S = 0.7, 8.0
