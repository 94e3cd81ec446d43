"""The queries of this subpackage, by the names that __spark_entry__.py registers, and their SQL."""

from siltstone.llm import chat, decontaminate, language, markov, minhash, pieces, sampling, secrets, toxicity, warc

QUERIES = {
    "op2_fingerprints": sampling.query,
    "op8_markov": markov.query,
    "op4_language": language.query,
    "op3_decontaminate": decontaminate.query,
    "op9_toxicity": toxicity.query,
    "op7_near_duplicates": minhash.query,
    "op1_pieces": pieces.query,
    "op5_warc": warc.query,
    "op6_chat": chat.query,
    "op10_secrets": secrets.query,
    "fingerprint_facts": sampling.facts_query,
    "base_scores": markov.base_query,
}
ORACLES: dict[str, str] = {"op3_decontaminate": decontaminate.ORACLE, "fingerprint_facts": sampling.FACTS_ORACLE, "base_scores": markov.BASE_ORACLE, "op5_warc": warc.ORACLE, "op6_chat": chat.ORACLE, "op7_near_duplicates": minhash.ORACLE, "op10_secrets": secrets.ORACLE}
