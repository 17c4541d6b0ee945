"""The registered queries of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.llm import (
    collocations, fingerprints, jaccard, language, merkle, mixing, neighbours, packing, pii, quality, sharding, token_counts, toxicity,
)
from demandgrid.llm.common import held_out

#: At and above this score a document is called toxic; a fixed value of the report.
TOXIC = 0.3
#: At and above this score a document is called good; a fixed value of the report.
GOOD = 0.7


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return out.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents")).drop("tid")


OP8_SQL = """
WITH RECURSIVE
words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '') AS w
    FROM documents),
runs AS (
    SELECT doc_id, unnest(list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END)) AS run
    FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
    FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id <> b.doc_id GROUP BY ALL),
linked AS (
    SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
    WHERE c >= 0.8 * (s.n + t.n - c)),
reached(x, y) AS (SELECT x, y FROM linked UNION SELECT r.x, l.y FROM reached r JOIN linked l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
counts AS (SELECT x, count(*) AS links FROM linked GROUP BY x)
SELECT doc_id, coalesce(least(doc_id, y), doc_id) AS class_id, coalesce(links, 0) AS links,
    doc_id = coalesce(least(doc_id, y), doc_id) AS is_first
FROM documents LEFT JOIN least ON doc_id = least.x LEFT JOIN counts ON doc_id = counts.x
"""


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replace_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.size("kinds").alias("n_entities"), F.concat_ws(",", "kinds").alias("kinds"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    called = F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", called)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    called = F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", called)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH RECURSIVE
pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\f\r]')) AS piece
    FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
runs AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM words, range(1, 6) lengths(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 100),
split AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
covered AS (
    SELECT DISTINCT s.lang, s.phrase FROM split s JOIN split o
        ON s.lang = o.lang AND s.k >= 2 AND o.k > s.k AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ')
    WHERE o.f >= s.f),
cuts AS (
    SELECT s.lang, s.phrase, s.f AS a, c.k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * s.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM split s JOIN range(1, 5) c(k) ON c.k < s.k
    JOIN f l ON l.lang = s.lang AND l.phrase = array_to_string(s.w[1:c.k], ' ')
    JOIN f r ON r.lang = s.lang AND r.phrase = array_to_string(s.w[c.k + 1:], ' ')
    JOIN totals t ON t.lang = s.lang
    WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = s.lang AND v.phrase = s.phrase)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked WHERE rank <= 2000
"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verified(table(spark, sf_dir, "documents"), text)


OP13_SQL = """
WITH RECURSIVE
fields AS (
    SELECT *, concat(
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
        coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head
    FROM documents),
told AS (
    SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        CASE WHEN xor(list_reduce(flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1),
                lambda i: list_concat([ascii((doc_id::VARCHAR)[i])::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END, 4294967295::BIGINT), 4294967295::BIGINT) % 2 = 0
        THEN replace(text, chr(10), '') ELSE text END AS after
    FROM fields),
leaves AS (
    SELECT doc_id, source, leaf, sha256(head || coalesce(strlen(after) || ':' || after, '-')) AS altered,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM told),
tree AS (
    SELECT source, 0 AS level, pos, n, leaf AS d FROM leaves
    UNION ALL
    SELECT source, level + 1, pos // 3, max(n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, level, pos // 3),
subroots AS (
    SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
    SELECT 0 AS level, pos, n, d FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, max(n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, pos // 3),
runs AS (
    SELECT false AS upper, source, level, pos // 3 AS run, list(d ORDER BY pos) AS ds FROM tree WHERE n > 1 GROUP BY ALL
    UNION ALL
    SELECT true, NULL, level, pos // 3, list(d ORDER BY pos) FROM crown WHERE n > 1 GROUP BY ALL),
climbed AS (
    SELECT doc_id, source, leaf, pos AS place, false AS upper, 0 AS level, pos, altered AS own, '' AS proof FROM leaves
    UNION ALL
    SELECT doc_id, source, leaf, place, CASE WHEN ds IS NULL THEN true ELSE upper END, CASE WHEN ds IS NULL THEN 0 ELSE level + 1 END,
        CASE WHEN ds IS NULL THEN above ELSE pos // 3 END,
        CASE WHEN ds IS NULL THEN own ELSE sha256(array_to_string(ds[1:pos % 3], '') || own || array_to_string(ds[pos % 3 + 2:], '')) END,
        CASE WHEN ds IS NULL THEN proof ELSE proof || array_to_string(ds[1:pos % 3], '') || array_to_string(ds[pos % 3 + 2:], '') END
    FROM (
        SELECT c.*, r.ds, s.pos AS above FROM climbed c
        LEFT JOIN runs r ON r.upper = c.upper AND r.level = c.level AND r.run = c.pos // 3 AND (c.upper OR r.source IS NOT DISTINCT FROM c.source)
        JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source)
    WHERE ds IS NOT NULL OR NOT upper),
ends AS (SELECT * FROM climbed WHERE upper QUALIFY row_number() OVER (PARTITION BY source, place ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = root.d AS verified
FROM ends e JOIN subroots s ON s.source IS NOT DISTINCT FROM e.source, (SELECT d FROM crown WHERE n = 1) root
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_mixing, op3_token_counts, op4_language_id, op5_sharding, op6_fingerprints,
        op7_neighbours, op8_jaccard_join, op9_pii, op10_toxicity, op11_quality, op12_collocations, op13_merkle, pipeline,
    )
}

SQL: dict[str, str] = {"op8_jaccard_join": OP8_SQL, "op12_collocations": OP12_SQL, "op13_merkle": OP13_SQL}
