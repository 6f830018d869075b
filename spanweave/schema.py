"""Record types of the engine, as DDL. Offsets are half-open and count code points."""

from __future__ import annotations

SPAN = "STRUCT<start: INT, end: INT, label: STRING>"
DOCUMENT = f"id STRING, source STRING, text STRING, spans ARRAY<{SPAN}>"
ML_DOCUMENT = f"id STRING, source STRING, lang STRING, kind STRING, partial STRING, text STRING, spans ARRAY<{SPAN}>"
EVAL_DOCUMENT = (
    f"id STRING, source STRING, lang STRING, kind STRING, partial STRING, text STRING, spans ARRAY<{SPAN[:-1]}, script: STRING>>, "
    f"negs ARRAY<{SPAN}>, slice STRING, format STRING, segment_langs ARRAY<STRUCT<start: INT, end: INT, lang: STRING>>"
)
PREDICTION = "id STRING, lang STRING, start INT, end INT, label STRING, score DOUBLE"
ADDRESS = "country STRING, source STRING, split STRING, lines ARRAY<STRING>"
MENTION = "lang STRING, label STRING, source STRING, doc STRING, entity STRING, context STRING, p_e DOUBLE, p_c DOUBLE"
LATENCY = "model STRING, chars INT, tokens INT, windows INT, median_s DOUBLE, min_s DOUBLE, max_s DOUBLE"
PACKED = "seq_id BIGINT, ids ARRAY<INT>, domains MAP<STRING, INT>"
