"""They must equal the published ones for results to agree."""

# Outcome columns of a segment table.
OUTCOMES = ["ope", "agr", "ext", "con", "neu", "valence", "arousal", "ang", "anx", "dep"]

# Encoder catalogue: speech model, embedding width, text model. The first row is
# the default for an unknown speech model.
ENCODERS = [
    ("openai/whisper-tiny", 384, "sentence-transformers/all-MiniLM-L12-v2"),
    ("openai/whisper-small", 768, "sentence-transformers/all-mpnet-base-v2"),
    ("openai/whisper-medium", 1024, "sentence-transformers/all-roberta-large-v1"),
]

# Provider prefixes taken off a model id before it names an output folder.
PROVIDER_PREFIXES = ["sentence-transformers/", "facebook/", "hf-audio/"]

# Encoder family by substring, tested in this order; anything else is "speech".
FAMILY_MARKERS = [
    ("sentence-transformers/", "text"),
    ("wav2vec2-bert", "wav2vec2-bert"),
    ("wav2vec2", "wav2vec2"),
    ("hubert", "hubert"),
]
DEFAULT_FAMILY = "speech"

# Corpus by file-name prefix, and the type of its group id.
CORPUS_ID_TYPES = {"hitop": "string", "wtc": "int"}

# Media suffixes a manifest keeps.
MEDIA_SUFFIXES = [".wav", ".mp3", ".m4a"]

# Target sample rate of a series, in Hz.
SAMPLE_RATE = 16000

# Longest token list kept by the encoder's tokenizer.
MAX_TOKENS = 512

# Sizes of the named string columns of a typed table.
VARCHAR_SIZES = {"user_id": 24, "message_id": 24, "filename": 100}

# Feature column name pattern.
FEATURE_FORMAT = "f%04d"

# Strings that pandas.read_csv reads as missing by default.
PANDAS_NA = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
