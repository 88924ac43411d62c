"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from ragmill.llm.decontam import op3_decontam
from ragmill.llm.embedding import EMBEDDING_SQL, LINKS_SQL, embedding_links, op8_embedding
from ragmill.llm.langid import LANGID_SQL, op10_langid
from ragmill.llm.linededup import LINEDEDUP_SQL, op9_linededup
from ragmill.llm.pieces import op4_sentencepiece
from ragmill.llm.prefixtrie import PREFIXTRIE_SQL, op12_prefixtrie
from ragmill.llm.sharding import SHARDING_SQL, op5_hilbert
from ragmill.llm.simhash import op2_simhash
from ragmill.llm.spelling import SPELLING_SQL, op11_spelling
from ragmill.llm.substring import SUBSTRING_SQL, op1_substring
from ragmill.llm.toxicity import op6_toxicity
from ragmill.llm.urlfilter import URLFILTER_SQL, op13_urlfilter
from ragmill.llm.warc import WARC_SQL, op7_warc

QUERIES = {
    "op1_substring": op1_substring,
    "op3_decontam": op3_decontam,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_hilbert": op5_hilbert,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_embedding": op8_embedding,
    "embedding_links": embedding_links,
    "op9_linededup": op9_linededup,
    "op10_langid": op10_langid,
    "op2_simhash": op2_simhash,
    "op11_spelling": op11_spelling,
    "op12_prefixtrie": op12_prefixtrie,
    "op13_urlfilter": op13_urlfilter,
}

ORACLE_SQL: dict[str, str] = {
    "op10_langid": LANGID_SQL,
    "op1_substring": SUBSTRING_SQL,
    "op9_linededup": LINEDEDUP_SQL,
    "op5_hilbert": SHARDING_SQL,
    "op7_warc": WARC_SQL,
    "op8_embedding": EMBEDDING_SQL,
    "embedding_links": LINKS_SQL,
    "op11_spelling": SPELLING_SQL,
    "op12_prefixtrie": PREFIXTRIE_SQL,
    "op13_urlfilter": URLFILTER_SQL,
}
