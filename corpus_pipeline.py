"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  Documents with a null or repeated id
are judged row by row; in the second stage those without an id come last, so
they stay only if no near-duplicate of theirs has an id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.byte_bpe import encode
from quillstat.llm.common import remove, shared_folder, table
from quillstat.llm.decontaminate import remove_documents
from quillstat.llm.jaccard_join import keep_one
from quillstat.llm.pii import replace
from quillstat.llm.quality_rules import keep_good
from quillstat.llm.queries import PII_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and lie near their language and source."""
    return keep_good(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates; documents without words stay."""
    return keep_one(docs, shingle=5, percent=75)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold passages of the benchmark."""
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced, and ``n_chars`` of the new text."""
    new = replace(docs, PII_KEY)
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of what they decode to."""
    import public_tokenizers

    rows = docs.select("doc_id", "lang", "source", "text")
    ids = encode(rows, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("PII", pii),
    ("byte-level BPE", byte_bpe),
]

#: SQL has no covariance determinant to minimise, no surrogates and no BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages before it wrote is deleted, whether they succeed or not."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    written = []
    try:
        for k, (_, stage) in enumerate(STAGES):
            written.append(f"{folder}/{k}")
            stage(spark, docs, sf_dir).write.parquet(written[-1])
            docs = spark.read.parquet(written[-1])
            for path in written[:-1]:
                remove(spark, path)
            written = written[-1:]
    except BaseException:
        remove(spark, folder)
        raise
    return docs
