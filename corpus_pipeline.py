"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from reconloom.llm.common import read, spread, table
from reconloom.llm.exact_dedup import drop_exact_duplicates
from reconloom.llm.mixing import mixed_documents
from reconloom.llm.ngram_join import drop_near_duplicates
from reconloom.llm.pieces import MODEL_PATH, encode_documents, load
from reconloom.llm.toxicity import drop_toxic, fit, training_rows


def remove_toxic(spark, docs, sf_dir):
    """Documents that the factorization machine rejects go. It learns from the labelled rows of this stage's documents."""
    return drop_toxic(spread(docs), fit(training_rows(docs, read(spark, sf_dir, "labels"))))


def remove_copies(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def remove_near_copies(spark, docs, sf_dir):
    """Of each class of linked documents the one with the least doc_id stays."""
    return drop_near_duplicates(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix by target weights takes them, to the nearest whole number."""
    return mixed_documents(docs)


def encode_pieces(spark, docs, sf_dir):
    """Token ids of each whole text: doc_id, ids, n_tokens, roundtrip."""
    return encode_documents(spread(docs), load(MODEL_PATH))


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("n-gram Jaccard join", remove_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: The classifier and the encoder can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to documents, each result written and reread."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
