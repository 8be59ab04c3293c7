"""The registered queries of the text operators and their SQL twins."""

from functools import wraps

QUERIES = {}
SQL = {}


def query(fn=None, sql=None):
    def register(f):
        @wraps(f)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # Text rows are long: small Arrow batches bound a Python worker's memory.
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return run

    return register(fn) if fn else register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark, sf_dir):
    from accesslens.llm.toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_quality(spark, sf_dir):
    from accesslens.llm.quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_sharding(spark, sf_dir):
    """Every document with its shard of 16 under the law ``rows``: shard counts differ by one at most."""
    from pyspark.sql import functions as F

    from accesslens.llm.sharding import shuffle_to_shards

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shuffle_to_shards(rows, 16, seed=10).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op7_packing(spark, sf_dir):
    import public_tokenizers

    from accesslens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_fingerprints(spark, sf_dir):
    from accesslens.llm.fingerprints import fingerprints_with_edits

    return fingerprints_with_edits(table(spark, sf_dir, "documents"))


@query
def op9_personal_data(spark, sf_dir):
    """Counts and digest of the base spans, and all spans with those that the corpus statistics add."""
    from pyspark.sql import functions as F

    from accesslens.llm.pii import KINDS, detect

    found = detect(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op2_line_dedup(spark, sf_dir):
    from accesslens.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed_lines")


@query
def op5_near_vectors(spark, sf_dir):
    from accesslens.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_ngram_join(spark, sf_dir):
    from accesslens.llm.ngram_join import ngram_join

    return ngram_join(table(spark, sf_dir, "documents"))


@query
def op3_piece_dropout(spark, sf_dir):
    """Every document encoded with merge-dropout and decoded again: number and crc32 of its ids, and if nothing was lost."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from accesslens.llm.piece_dropout import decode_column, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = encode(table(spark, sf_dir, "documents"), path, seed=3)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"),
                      F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
                      F.coalesce(decode_column(F.col("ids"), path), F.lit("")).eqNullSafe(F.coalesce("text", F.lit("")))
                      .alias("lossless"))


@query
def op13_main_text(spark, sf_dir):
    from accesslens.llm.main_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


@query(sql="""
    WITH kept AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
    ranked AS (
        SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER)
                   AS rank
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
             AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
""")
def op12_hard_negatives(spark, sf_dir):
    from accesslens.llm.hard_negatives import mine_embeddings

    return mine_embeddings(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(k=16, rounds=3, dim=64, scale=64, seed=1):
    """Integer Lloyd rounds as chained common table expressions."""
    near = ("SELECT p.n, p.vec_id, p.v, c.cluster, "
            "CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance "
            "FROM points p, c{r} c QUALIFY row_number() OVER (PARTITION BY p.n ORDER BY distance, c.cluster) = 1")
    steps = [f"""points AS MATERIALIZED (
        SELECT row_number() OVER () AS n, vec_id,
               list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS MATERIALIZED (
        SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS INTEGER) AS cluster, v FROM points
        QUALIFY cluster < {k})"""]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        steps.append(f"""c{r + 1} AS MATERIALIZED (
        SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
            SELECT cluster, list(m ORDER BY i) AS v FROM (
                SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
                FROM (SELECT cluster, unnest(v) AS x, unnest(range({dim})) AS i FROM a{r}) GROUP BY cluster, i)
            GROUP BY cluster) m USING (cluster))""")
    steps.append(f"final AS MATERIALIZED ({near.format(r=rounds)})")
    return f"""WITH {", ".join(steps)}
        SELECT f.vec_id, f.cluster, f.distance,
               CAST(sum(f.distance) OVER (PARTITION BY f.cluster) AS BIGINT) AS cluster_inertia,
               CAST(sum(f.distance) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM final f JOIN c{rounds} c USING (cluster)"""


@query(sql=_lloyd_sql())
def op11_centroids(spark, sf_dir):
    from accesslens.llm.centroids import cluster_vectors

    return cluster_vectors(table(spark, sf_dir, "embeddings"))
