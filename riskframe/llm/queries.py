"""The text operators as registered queries, with SQL twins where SQL can say the same."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    best_fit,
    centroid_clusters,
    cross_entropy,
    embedding_dedup,
    fill_in_middle,
    hyperminhash,
    level_packing,
    personal_data,
    quality_rules,
    source_mix,
    warc_segments,
    weighted_fingerprints,
    wordpiece_counts,
)
from riskframe.llm.tables import n_words, table, written

#: Place of the tokenizer file; the texts' token ids come from it.
TOKENIZER = "word_bpe_49k.json"
#: Vocabulary of the word pieces.
PIECES = "piece_bpe_32k.model"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query(
    "op10_source_mix",
    r"""
    WITH sized AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
        FROM documents
    ), keyed AS (
        SELECT *, md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, 'null'), size::VARCHAR)) AS key FROM sized
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS turn
        FROM keyed GROUP BY source
    ), weighed AS (
        SELECT *, 3 * source_size AS cap, ((turn - 1) % 3 + 1)::DOUBLE AS weight FROM sources
    ), levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
               / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
        FROM weighed
        WINDOW before AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), targets AS (
        SELECT source, source_size, least(cap::DOUBLE, weight * max(share) OVER ()) AS target FROM levels
    ), budgets AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
               CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT % source_size ELSE 0 END AS rest
        FROM targets
    ), placed AS (
        SELECT k.*, b.source_size, b.target, b.epochs, b.rest,
               (sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE UNBOUNDED PRECEDING)
                - sum(size) OVER (PARTITION BY k.source, key))::BIGINT AS before,
               count(*) OVER (PARTITION BY k.source, key) AS n
        FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, size, source_size, target,
           (epochs * size + least(size, greatest(0, rest - before) // n))::BIGINT AS taken
    FROM placed
    """,
)
def op10_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size")))
    return source_mix.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


KEEP_FROM = 0.3


@query("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality_rules.score_documents(docs, model)
    return scored.select(
        "doc_id",
        quality_rules.held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= KEEP_FROM, 1).otherwise(0).alias("predicted"),
    )


@query("op3_hyperminhash")
def op3_hyperminhash(spark, sf_dir):
    found = hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    found = personal_data.detect(table(spark, sf_dir, "documents"))
    counts = [F.col("n")[i].alias(f"n_{kind}") for i, kind in enumerate(personal_data.BASE_KINDS)]
    base = F.sha2(F.col("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, personal_data.as_text().alias("spans"))


def packed_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's rows: one per piece of the whole texts, with its place in a sequence."""
    with open(tokenizer_path, encoding="utf-8") as file:
        pieces = written(best_fit.tokenized(docs, file.read()))
    digest = F.crc32("ids").alias("ids_crc32")
    rows = pieces.select("doc_id", "piece", "start", "length", digest)
    return best_fit.pack(rows, ["doc_id", "piece", "ids_crc32"])


@query("op8_best_fit")
def op8_best_fit(spark, sf_dir):
    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op9_weighted_fingerprints")
def op9_weighted_fingerprints(spark, sf_dir):
    return weighted_fingerprints.fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query(
    "op2_embedding_dedup",
    """
    WITH RECURSIVE usable AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
    ), reached AS (
        SELECT vec_id AS node, vec_id AS seen FROM embeddings
        UNION
        SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.seen
    ), smallest AS (
        SELECT node, min(seen) AS component_id FROM reached GROUP BY node
    )
    SELECT s.node AS vec_id, (SELECT count(*) FROM links WHERE a = s.node)::BIGINT AS n_links, component_id,
           s.node = component_id AS kept
    FROM smallest s
    """,
)
def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op4_cross_entropy")
def op4_cross_entropy(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    return cross_entropy.score(table(spark, sf_dir, "documents"), good)


@query("op6_wordpiece_counts")
def op6_wordpiece_counts(spark, sf_dir):
    pieces = wordpiece_counts.word_pieces(public_tokenizers.path(PIECES))
    automaton = wordpiece_counts.PieceAutomaton(*pieces, byte_pieces=True)
    return wordpiece_counts.count_pieces(table(spark, sf_dir, "documents"), automaton)


@query(
    "op7_warc_segments",
    """
    WITH sized AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
    ), digested AS (
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               max(page_id) OVER (PARTITION BY sha1(html)) AS leader
        FROM sized
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id < leader THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id < leader THEN leader END AS refers_to
    FROM digested
    """,
)
def op7_warc_segments(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    records = warc_segments.round_trip(pages)
    # what the archives say about each page; the payloads end here
    read = written(
        records.select(
            F.col("page").cast(pages.schema["page_id"].dataType).alias("page_id"),
            F.col("refers_to").cast(pages.schema["page_id"].dataType).alias("refers_to"),
            F.col("kind").alias("record_type"),
            F.octet_length("payload").cast("long").alias("own_bytes"),
            F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"),
        )
    )
    full = read.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("own_bytes").alias("full_bytes")
    )
    out = read.join(full.distinct(), ["refers_to", "payload_digest"], "left")
    size = F.coalesce("own_bytes", "full_bytes").alias("payload_bytes")
    return out.select("page_id", size, "payload_digest", "record_type", "refers_to")


@query(
    "op11_fill_in_middle",
    r"""
    WITH texts AS (
        SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS draw
        FROM documents
    ), units AS (
        SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
               ('0x' || substr(draw, 1, 8))::BIGINT AS h1, ('0x' || substr(draw, 9, 8))::BIGINT AS h2,
               ('0x' || substr(draw, 17, 8))::BIGINT AS h3, ('0x' || substr(draw, 25, 8))::BIGINT AS h4
        FROM texts
    ), cuts AS (
        SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
               greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
               CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                         OR h3 % 100 >= 50 THEN 'plain'
                    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM units
    ), parts AS (
        SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
               array_to_string(u[b + 1:], '') AS s
        FROM cuts
    )
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM parts
    """,
)
def op11_fill_in_middle(spark, sf_dir):
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), seed=42, with_output=False)


def _lloyd_sql(k: int, rounds: int, seed: int) -> str:
    """Lloyd's rounds over whole vectors, one after the other."""
    steps = [
        f"""WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')), x) - 1 AS j, x AS c
        FROM v QUALIFY j < {k}
    )"""
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (
        SELECT r, min((d, j)) AS best FROM (
            SELECT r, j, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d
            FROM v, c{t}
        ) GROUP BY r
    )"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (
        SELECT j, coalesce(n.c, c{t}.c) AS c FROM c{t} LEFT JOIN (
            SELECT j, list(m ORDER BY i) AS c FROM (
                SELECT best[2] AS j, i, floor(sum(x[i]) / count(*)) AS m
                FROM a{t} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL
            ) GROUP BY j
        ) n USING (j)
    )"""
            )
    return (
        ", ".join(steps)
        + f""", found AS (SELECT vec_id, best[2] AS j, best[1]::BIGINT AS distance FROM a{rounds} JOIN v USING (r))
    SELECT vec_id, j::INTEGER AS cluster, distance,
           sum(distance) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
           sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM found JOIN c{rounds} USING (j)"""
    )


@query("op12_centroid_clusters", _lloyd_sql(k=40, rounds=5, seed=2))
def op12_centroid_clusters(spark, sf_dir):
    return centroid_clusters.clusters(table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2)


@query("op13_level_packing")
def op13_level_packing(spark, sf_dir):
    with open(public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return level_packing.pack(table(spark, sf_dir, "documents"), file.read(), end_id=2)
