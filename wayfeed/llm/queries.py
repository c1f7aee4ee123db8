"""The registered queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import balanced_packing, decontaminate, embeddings, fill_in_middle, kd_shards, language, lattice, packing, quality, ranked_search, simhash, suffixes, token_counts
from .common import id_remainder, table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model_path())


def op2_lattice_score(spark, sf_dir):
    return lattice.lattice_scores(table(spark, sf_dir, "documents"), model_path())


def op3_best_fit_packing(spark, sf_dir):
    return packing.best_fit(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    detector = language.train(docs.filter(~held_out))
    return language.detect(docs, detector).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_embedding_near_dedup(spark, sf_dir):
    return embeddings.embedding_groups(table(spark, sf_dir, "embeddings"))


def op6_kd_shards(spark, sf_dir):
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


def op7_simhash_bk_tree(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_bm25_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark, sf_dir):
    cut = suffixes.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    weights = quality.train(quality.training_rows(docs, table(spark, sf_dir, "labels")))
    scored = quality.score(docs.select("doc_id", "text"), weights)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark, sf_dir):
    done = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


def coder_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op13_balanced_packing(spark, sf_dir):
    pieces = balanced_packing.balanced_sequences(table(spark, sf_dir, "documents"), *coder_paths())
    columns = ["doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    return pieces.select(*columns, "sequence_tokens", "sequence_cost")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_lattice_score, op3_best_fit_packing, op4_language_id, op5_embedding_near_dedup, op6_kd_shards,
        op7_simhash_bk_tree, op8_bm25_decontamination, op9_suffix_dedup, op10_quality, op11_ranked_search, op12_fill_in_middle,
        op13_balanced_packing,
    )
}

ORACLES = {
    "op5_embedding_near_dedup": """
        WITH RECURSIVE fine AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND list_count(embedding) = len(embedding) AND len([x FOR x IN embedding IF NOT isfinite(x)]) = 0
              AND len([x FOR x IN embedding IF x <> 0]) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
        ), components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
        counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN components c ON c.a = e.vec_id LEFT JOIN counts n ON n.a = e.vec_id
    """,
    "op11_ranked_search": r"""
        WITH doc_terms AS (
            SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), sized AS (SELECT row, doc_id, terms, len(terms)::BIGINT AS n FROM doc_terms WHERE len(terms) > 0),
        stats AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sized),
        item_terms AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), counted AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM sized) GROUP BY row, term),
        postings AS (SELECT c.* FROM counted c WHERE term IN (SELECT term FROM item_terms)),
        weights AS (
            SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, stats GROUP BY term, big_n
        ), impacts AS (
            SELECT p.row, p.term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))) AS part
            FROM postings p JOIN sized s USING (row) JOIN weights USING (term), stats
        ), scores AS (SELECT item_id, row, sum(part)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY item_id, row),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
            FROM scores JOIN sized USING (row) WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 50
    """,
    "op12_fill_in_middle": r"""
        WITH hashed AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS sha FROM documents
        ), drawn AS (
            SELECT *, len(lines) AS n, ('0x' || substr(sha, 1, 8))::BIGINT % (len(lines) + 1) AS one,
                ('0x' || substr(sha, 9, 8))::BIGINT % (len(lines) + 1) AS two, ('0x' || substr(sha, 25, 8))::BIGINT % 100 < 50 AS spm,
                t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM hashed
        ), cut AS (
            SELECT *, array_to_string(lines[1:least(one, two)], '') AS prefix, array_to_string(lines[least(one, two) + 1:greatest(one, two)], '') AS middle,
                array_to_string(lines[greatest(one, two) + 1:n], '') AS suffix FROM drawn
        )
        SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
            CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
            sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM cut
    """,
}
