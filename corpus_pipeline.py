"""The corpus pipeline: quality rules, language ID, near-duplicates, secret scans, packing."""

from __future__ import annotations

from orrery.llm import language, near_duplicates, packing, quality, secrets
from orrery.llm.common import materialise, table


def quality_rules(spark, docs, sf_dir):
    """Keep the documents that pass the quality rules; `labels` of the input folder names the trusted ones."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark, docs, sf_dir):
    """Keep the documents in a language that the input's own labelled documents teach."""
    return language.keep_languages(docs)


def near_duplicate_groups(spark, docs, sf_dir):
    """Keep the document with the smallest doc_id of each near-duplicate group."""
    return near_duplicates.keep_one_of_each_group(docs)


def secret_scans(spark, docs, sf_dir):
    """Replace secrets in the texts; all documents stay, also those with a null or repeated doc_id and null texts."""
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    """Length bucket, batch and slot of every document, by ids; null and repeated doc_ids are packed row by row."""
    return packing.pack(packing.token_lengths(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_groups),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: SQL cannot express the n-gram ratio, the language models or the fingerprints.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`, each on a written copy of what the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
