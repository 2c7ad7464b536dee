"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import embeddings, fingerprints, htmltext, jaccard, langid, mixing, substrings, tokens, toxicity
from tidemark.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda s, d: toxicity.op1_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op2_substrings": lambda s, d: substrings.op2_substrings(table(s, d, "documents")),
        "op3_jaccard": lambda s, d: jaccard.op3_jaccard(table(s, d, "documents")),
        "op4_language_id": lambda s, d: langid.op4_language_id(table(s, d, "documents")),
        "pages_language": lambda s, d: langid.pages_language(table(s, d, "pages"), table(s, d, "documents")),
        "op5_token_counts": lambda s, d: tokens.token_counts(table(s, d, "documents")),
        "op6_bpe": lambda s, d: tokens.encode_decode(table(s, d, "documents")),
        "op7_fingerprints": lambda s, d: fingerprints.op7_fingerprints(table(s, d, "documents")),
        "op8_mixing": lambda s, d: mixing.op8_mixing(table(s, d, "documents")),
        "op9_html_text": lambda s, d: htmltext.op9_html_text(table(s, d, "pages")),
        "op10_embeddings": lambda s, d: embeddings.op10_embeddings(table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_fingerprints": fingerprints.OP7_SQL, "op8_mixing": mixing.OP8_SQL}
