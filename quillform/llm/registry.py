"""All queries of this subpackage and their SQL."""

from . import q_chat, q_crosstoken, q_decontaminate, q_extract, q_katz, q_packing, q_privacy, q_quality, q_repair, q_secrets, q_simhash, q_substrings, q_warc

_ALL = (q_chat, q_substrings, q_warc, q_packing, q_katz, q_secrets, q_simhash, q_quality, q_privacy, q_decontaminate, q_extract, q_repair, q_crosstoken)
QUERIES = {k: v for m in _ALL for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _ALL for k, v in m.ORACLES.items()}
