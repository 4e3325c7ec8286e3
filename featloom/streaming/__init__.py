"""Operators that also accept a streaming DataFrame.

The reference workload is batch only: it has no event time, watermark or
stateful operator, so there is nothing to build here beyond what follows.
Row-local operators contain no action, aggregate or sort, and run unchanged
between ``readStream`` and ``writeStream``.
"""

ROW_LOCAL = [
    "functions.vectors", "functions.text",
    "operators.reshape.drop_incomplete", "operators.reshape.with_group_norm",
    "operators.reshape.prediction_rows", "operators.reshape.to_long",
    "operators.reshape.vec_to_long", "operators.reshape.cols_to_vec",
    "operators.reshape.outcome_vector", "operators.encode.encode_rows",
    "operators.encode.resolve_encoder", "operators.groupfeats.cohort",
    "sources.media.with_corpus", "sources.media.with_media_path",
]
