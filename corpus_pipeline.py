"""A corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
`run` writes each stage's rows to the shared folder and reads them back for the next.
A document is the row: each is judged by its own text, whatever its doc_id, and of equal
rows one stays. Null and empty texts have no shingles, so near-dedup keeps them.
"""

import public_tokenizers
from pyspark.sql import functions as F

from rollspan.llm import near_dups, packing, pseudonyms, quality, templates
from rollspan.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # classifier, signatures and tokenizers have no SQL form


def quality_classifier(spark, docs, sf_dir):
    """Keep documents that the discriminant predicts to be of quality 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    measured = quality.document_statistics(docs)
    model = quality.fit(measured, labels, ~quality.held_out())
    return quality.keep(docs.select(*COLUMNS), model, 0.3)


def near_duplicates(spark, docs, sf_dir):
    """Keep one row of each group of near-duplicates (five-word shingles), smallest doc_id first."""
    return near_dups.without_duplicates(docs.select(*COLUMNS), width=5, percent=80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drop documents that hold a benchmark item or a re-parameterised copy of one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return templates.without_leaks(docs, benchmark).select(*COLUMNS)


def personal_data(spark, docs, sf_dir):
    """Replace personal numbers, dates, addresses and secrets by pseudonyms."""
    replaced = pseudonyms.pseudonymise(docs.select(*COLUMNS), pseudonyms.session_key(spark))
    changed = F.size("pii_kinds") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return replaced.withColumn("n_chars", n_chars).select(*COLUMNS)


def concatenate_and_cut(spark, docs, sf_dir):
    """Pack all documents into sequences of 2048 ids."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, end_id=1, length=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("packing", concatenate_and_cut),
]


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
