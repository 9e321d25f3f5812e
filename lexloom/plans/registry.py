"""All registered queries of the library, without those of the llm subpackage."""

from lexloom.plans import q_corpus, q_dictionary, q_replies, q_text

MODULES = (q_text, q_corpus, q_replies, q_dictionary)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
