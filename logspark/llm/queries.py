"""The operators' queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from logspark.llm.centroids import op12_centroids
from logspark.llm.decontaminate import op1_decontaminate
from logspark.llm.langid import op2_langid
from logspark.llm.licenses import op5_licenses
from logspark.llm.lm import op4_lm
from logspark.llm.media import op9_media
from logspark.llm.mixing import op10_mixing
from logspark.llm.neardup import op8_neardup
from logspark.llm.repair import op11_repair
from logspark.llm.sql import SQL  # noqa: F401
from logspark.llm.substring import op6_substring
from logspark.llm.tokens import op7_token_counts
from logspark.llm.toxicity import op3_toxicity
from logspark.llm.warc import op13_warc

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_langid, op3_toxicity, op4_lm, op5_licenses, op6_substring, op7_token_counts, op8_neardup, op9_media, op10_mixing, op11_repair, op12_centroids, op13_warc)}

