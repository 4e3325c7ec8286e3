"""Multi-channel series."""

from featloom.operators import series
from featloom.workload.registry import query, r6

MONO = "SELECT series_id, idx, avg(value) AS value FROM {series} GROUP BY series_id, idx"


@query(
    "VEC-11",
    f"SELECT series_id, idx, round(value, 6) + 0.0 AS value FROM ({MONO})",
)
def downmixed(v):
    return series.downmix(v.series).withColumn("value", r6("value"))


def _resampled(orig: int, new: int) -> str:
    """Every output against every input sample its kernel may reach."""
    cutoff = 0.99 * min(1.0, new / orig)
    return f"""
        WITH mono AS ({MONO}),
        outs AS (SELECT series_id, j FROM
                    (SELECT series_id, cast(ceil((max(idx) + 1) * {new} / {orig}.0) AS bigint) AS m
                     FROM mono GROUP BY series_id), range(100000) AS r(j) WHERE j < m),
        taps AS (SELECT o.series_id, o.j, m.value,
                        {cutoff!r}::double * (o.j * {orig / new!r}::double - m.idx) AS u
                 FROM outs o LEFT JOIN mono m ON m.series_id = o.series_id
                  AND abs({cutoff!r}::double * (o.j * {orig / new!r}::double - m.idx)) <= 6)
        SELECT series_id, j AS idx,
               round(coalesce(sum(value * {cutoff!r}::double
                     * CASE WHEN abs(u) < 1e-12 THEN 1 ELSE sin(pi() * u) / (pi() * u) END
                     * pow(cos(pi() * u / 12), 2)), 0), 6) + 0.0 AS value
        FROM taps GROUP BY series_id, j"""


@query("VEC-12 VEC-11", _resampled(24, 8))
def resampled_down(v):
    mono = series.downmix(v.series)
    return series.resample(mono, 24, 8, block=32).withColumn("value", r6("value"))


@query("VEC-12", _resampled(8, 24))
def resampled_up(v):
    mono = series.downmix(v.series)
    return series.resample(mono, 8, 24).withColumn("value", r6("value"))


# Band edge and reach, in samples, of a kernel from 44,100 to 16,000 samples a second.
EDGE, REACH = 0.99 * 16000 / 44100, 17


@query(
    "VEC-12 VEC-11",
    f"""WITH mono AS (SELECT series_id, idx, avg(value) AS value FROM {{long_series}} GROUP BY series_id, idx),
        outs AS (SELECT series_id, unnest(range(cast(ceil((max(idx) + 1) * 160 / 441.0) AS bigint))) AS j
                 FROM mono GROUP BY series_id),
        taps AS (SELECT series_id, j, j * 441 // 160 + t AS idx, {EDGE!r}::double * ((j * 441 % 160) / 160.0::double - t) AS u
                 FROM outs, range(-{REACH}, {REACH + 1}) AS r(t))
        SELECT series_id, j AS idx,
               round(coalesce(sum(CASE WHEN abs(u) <= 6 THEN value * {EDGE!r}::double
                     * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * u) / (pi() * u) END
                     * pow(cos(pi() * u / 12), 2) END), 0), 6) + 0.0 AS value
        FROM taps LEFT JOIN mono USING (series_id, idx) GROUP BY series_id, j""",
)
def resampled_long(v):
    """Series that grow with the table, in blocks."""
    mono = series.downmix(v.long_series)
    return series.resample(mono, 44100, 16000, block=1 << 12).withColumn("value", r6("value"))
