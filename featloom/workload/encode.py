"""Batch encoding, quarantine and encoder lookups."""

import numpy as np
from pyspark.sql import functions as F

from featloom import fixed
from featloom.functions import text
from featloom.operators import encode
from featloom.workload.registry import cells, query

# Model names a run table may hold, one of them unknown to the catalogue.
NAMES = [m for m, _, _ in fixed.ENCODERS] + [t for _, _, t in fixed.ENCODERS] + [
    "facebook/wav2vec2-base-960h",
    "hf-audio/wav2vec2-bert-CV16-en",
    "facebook/hubert-large-ls960-ft",
    "own-speech-model",
]
NAME_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
MODELS = f"""SELECT message_id, {NAME_LIST}[cast(user_id % {len(NAMES)} + 1 AS integer)] AS model_id
             FROM {{segments}}"""


def _models(v):
    names = F.array(*map(F.lit, NAMES))
    at = (F.col("user_id") % len(NAMES) + 1).cast("int")
    return v.segments.select("message_id", F.element_at(names, at).alias("model_id"))


@query(
    "JON-7",
    f"""SELECT message_id, model_id,
               CASE model_id WHEN 'openai/whisper-small' THEN 768
                    WHEN 'openai/whisper-medium' THEN 1024 ELSE 384 END AS emb_dims,
               CASE model_id WHEN 'openai/whisper-small' THEN 'sentence-transformers/all-mpnet-base-v2'
                    WHEN 'openai/whisper-medium' THEN 'sentence-transformers/all-roberta-large-v1'
                    ELSE 'sentence-transformers/all-MiniLM-L12-v2' END AS text_model
        FROM ({MODELS})""",
)
def encoder_lookup(v):
    found = encode.resolve_encoder(_models(v))
    return found.select("message_id", "model_id", "emb_dims", "text_model")


@query(
    "STR-3",
    f"""SELECT message_id,
               CASE WHEN model_id LIKE '%sentence-transformers/%' THEN 'text'
                    WHEN model_id LIKE '%wav2vec2-bert%' THEN 'wav2vec2-bert'
                    WHEN model_id LIKE '%wav2vec2%' THEN 'wav2vec2'
                    WHEN model_id LIKE '%hubert%' THEN 'hubert' ELSE 'speech' END AS family
        FROM ({MODELS})""",
)
def encoder_families(v):
    return _models(v).select("message_id", text.encoder_family(F.col("model_id")).alias("family"))


@query(
    "STR-2",
    f"""SELECT message_id,
               regexp_replace(model_id, '(sentence-transformers|facebook|hf-audio)/', '') AS folder
        FROM ({MODELS})""",
)
def model_folders(v):
    return _models(v).select("message_id", text.strip_prefix(F.col("model_id")).alias("folder"))


def _text_model():
    """A stand-in for a user's encoder: letters, words and a constant."""

    def model(batch):
        sizes = [[len(t), t.count(" ") + 1, 100.0] for t in batch["message"]]
        return np.array(sizes, dtype="float64")

    return model


def _picky_model():
    """The same, refusing messages above 300 characters."""
    inner = _text_model()

    def model(batch):
        if any(len(t) > 300 for t in batch["message"]):
            raise ValueError("message too long")
        return inner(batch)

    return model


FEATURES = """SELECT message_id, message,
                     [cast(length(message) AS double),
                      length(message) - length(replace(message, ' ', '')) + 1.0, 100.0] AS x
              FROM {messages}"""


@query(
    "UDF-1 VEC-1",
    f"""SELECT message_id, i - 1 AS pos,
               round(cast(cast(x[i] / sqrt(list_dot_product(x, x)) AS float) AS double), 4) + 0.0
               AS value
        FROM ({FEATURES}), range(1, 4) AS d(i)""",
)
def encoded_messages(v):
    rows = encode.encode_rows(
        v.messages, _text_model, 3, ["message_id"], ["message"], batch_size=32, normalize=True
    )
    return cells(rows, ["message_id"], "embedding", 4)


@query(
    "UDF-2",
    f"""SELECT message_id, i - 1 AS pos, round(x[i], 4) + 0.0 AS value
        FROM ({FEATURES}), range(1, 4) AS d(i) WHERE length(message) <= 300""",
)
def encoded_good_rows(v):
    rows = encode.encode_rows(v.messages, _picky_model, 3, ["message_id"], ["message"], 32)
    return cells(encode.split_encoded(rows)[0], ["message_id"], "embedding", 4)


@query(
    "UDF-2",
    """SELECT message_id, 'ValueError: message too long' AS error FROM {messages}
       WHERE length(message) > 300""",
)
def quarantined_rows(v):
    rows = encode.encode_rows(v.messages, _picky_model, 3, ["message_id"], ["message"], 32)
    return encode.split_encoded(rows)[1]


ROLES = """SELECT message_id, [cast(length(role) AS double), 1.0, 100.0] AS x FROM {messages}"""


@query(
    "UDF-1 SET-3",
    f"""SELECT message_id, i - 1 AS pos, round(x[i], 4) + 0.0 AS value
        FROM ({ROLES}), range(1, 4) AS d(i)""",
)
def encoded_distinct_inputs(v):
    """Few different inputs, each that of very many rows."""
    inputs = v.messages.select("message_id", F.col("role").alias("message"))
    rows = encode.encode_distinct(inputs, _text_model, 3, ["message_id"], ["message"])
    return cells(rows, ["message_id"], "embedding", 4)
