"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from codequarry.llm import cover_codes, decontaminate, embedding_dup, html_text, licenses, near_dup, packing, quality, secrets, sharding, sql, token_files, toxicity, whitening
from codequarry.llm.common import table

QUERIES = {}
SQL = {
    "op3_near_dup": sql.NEAR_DUP,
    "op5_embedding_dup": sql.EMBEDDING_DUP,
    "op6_secrets": sql.secrets_sql(secrets.KINDS, secrets.N_BASE, secrets.PLACEHOLDERS),
    "op8_licenses": sql.licenses_sql(licenses.rules(), licenses.PHRASES),
    "op9_decontaminate": sql.DECONTAMINATE,
    "op13_vector_codes": sql.vector_codes_sql(cover_codes.PARTS, cover_codes.ENTRIES, cover_codes.ROUNDS, cover_codes.SCALE),
}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_html_text(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_near_dup(spark, sf_dir):
    return near_dup.near_dup_digest(table(spark, sf_dir, "documents"))


@query
def op4_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_embedding_dup(spark, sf_dir):
    return embedding_dup.embedding_dup_digest(table(spark, sf_dir, "embeddings"))


@query
def op6_secrets(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


@query
def op7_shard(spark, sf_dir):
    return sharding.shard_digest(table(spark, sf_dir, "documents"))


@query
def op8_licenses(spark, sf_dir):
    return licenses.license_digest(table(spark, sf_dir, "documents"))


@query
def op9_decontaminate(spark, sf_dir):
    return decontaminate.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_quality(spark, sf_dir):
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_whiten(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_vector_codes(spark, sf_dir):
    return cover_codes.code_digest(table(spark, sf_dir, "embeddings"))
