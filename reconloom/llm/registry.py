"""The queries of this subpackage and their SQL, as the driver calls them."""

from __future__ import annotations

from reconloom.llm import centroids, chat, fill_middle, pii, token_counts
from reconloom.llm import quality as site_quality
from reconloom.llm.common import read, spread
from reconloom.llm.cover_tree import top_k
from reconloom.llm.exact_dedup import exact_duplicates
from reconloom.llm.mixing import mix
from reconloom.llm.ngram_join import jaccard_join
from reconloom.llm.oracles import DEDUP_SQL, FIM_SQL, MIX_SQL, TOP_K_SQL, cluster_sql
from reconloom.llm.pieces import MODEL_PATH, encode_documents, load
from reconloom.llm.sharding import shard
from reconloom.llm.toxicity import fit, toxicity, training_rows


def op1_pii(spark, sf_dir):
    return pii.digest(pii.personal_data(spread(read(spark, sf_dir, "documents")), pii.train()))


def op2_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity(spread(docs), fit(training_rows(docs, read(spark, sf_dir, "labels"))))


def op3_exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op4_top_k(spark, sf_dir):
    return top_k(read(spark, sf_dir, "embeddings"))


def op5_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_sentencepiece(spark, sf_dir, model_path=MODEL_PATH):
    return encode_documents(spread(read(spark, sf_dir, "documents")), load(model_path))


def op7_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return site_quality.quality(docs, site_quality.train(docs, read(spark, sf_dir, "labels")))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join(read(spark, sf_dir, "documents"))


def op10_chat_format(spark, sf_dir):
    """Roles are recovered without a look at the table's; column given has those, for comparison."""
    return chat.format_conversations(read(spark, sf_dir, "conversations"), trust=False)


def op11_centroids(spark, sf_dir):
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_token_counts(spark, sf_dir, path=token_counts.VOCABULARY):
    """Column cut is the length of the longest prefix within the limit, read off the prefix counts."""
    return token_counts.token_counts(spread(read(spark, sf_dir, "documents")), token_counts.load(path))


def op13_fill_in_middle(spark, sf_dir):
    return fill_middle.digest(fill_middle.fill_in_middle(spread(read(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii, op2_toxicity, op3_exact_dedup, op4_top_k, op5_mixing, op6_sentencepiece, op7_sharding, op8_quality, op9_jaccard_join, op10_chat_format,
        op11_centroids, op12_token_counts, op13_fill_in_middle,
    )
}
ORACLES = {"op4_top_k": TOP_K_SQL, "op3_exact_dedup": DEDUP_SQL, "op5_mixing": MIX_SQL, "op11_centroids": cluster_sql(), "op13_fill_in_middle": FIM_SQL}
