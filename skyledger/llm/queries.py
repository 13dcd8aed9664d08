"""The subpackage's registered queries and their oracle SQL."""

from __future__ import annotations

from skyledger.llm import conversations, fingerprints, licenses, resampling, secrets, sharding, substrings, warc
from skyledger.llm.conversations import op13_conversation_repair
from skyledger.llm.decontamination import op7_template_decontamination
from skyledger.llm.extraction import op11_nearest_url_extraction
from skyledger.llm.fingerprints import op5_invertible_fingerprints
from skyledger.llm.licenses import op9_license_digest_scan
from skyledger.llm.minhash import op2_minhash_near_duplicates
from skyledger.llm.mixing import op3_sainte_lague_mixing
from skyledger.llm.resampling import op12_importance_resampling
from skyledger.llm.secrets import op8_trigram_secret_scan
from skyledger.llm.sharding import op1_histogram_sharding
from skyledger.llm.substrings import op10_substring_dedup
from skyledger.llm.toxicity import op4_noisy_or_toxicity
from skyledger.llm.warc import op6_chunked_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_sharding,
        op2_minhash_near_duplicates,
        op3_sainte_lague_mixing,
        op4_noisy_or_toxicity,
        op5_invertible_fingerprints,
        op6_chunked_warc,
        op7_template_decontamination,
        op8_trigram_secret_scan,
        op9_license_digest_scan,
        op10_substring_dedup,
        op11_nearest_url_extraction,
        op12_importance_resampling,
        op13_conversation_repair,
    )
}

ORACLES: dict[str, str] = {
    "op1_histogram_sharding": sharding.oracle(),
    "op5_invertible_fingerprints": fingerprints.oracle(),
    "op6_chunked_warc": warc.oracle(),
    "op8_trigram_secret_scan": secrets.oracle(),
    "op9_license_digest_scan": licenses.oracle(),
    "op10_substring_dedup": substrings.oracle(),
    "op12_importance_resampling": resampling.oracle(),
    "op13_conversation_repair": conversations.oracle(),
}
