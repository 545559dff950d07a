"""The registered queries of the llm operators: production parameters, whole tables, digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm.common import table
from eventloom.session import ship_library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 16


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(name: str, sql: str | None = None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_library(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


OP6_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6(spark, sf_dir):
    from eventloom.llm.exact import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_sharding")
def op7(spark, sf_dir):
    from eventloom.llm.shards import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)


@query("op10_byte_bpe")
def op10(spark, sf_dir):
    from eventloom.llm.bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), *vocabulary())


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    from eventloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Domains of the labels (toxic; poor; sound) and the share of the tokens that each shall have.
DOMAINS = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END"
TARGETS = [0.02, 0.02, 0.96]


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(DOMAINS).alias("cls")).dropna()


@query("op9_mixing")
def op9(spark, sf_dir):
    from pyspark.sql import functions as F

    from eventloom.llm.mixing import mixing_rates

    rated = mixing_rates(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), TARGETS)
    return rated.select("doc_id", "tokens", F.col("p")[0].alias("p_toxic"), F.col("p")[1].alias("p_poor"), F.col("p")[2].alias("p_sound"), "rate", "copies")


@query("op2_pii")
def op2(spark, sf_dir):
    from eventloom.llm.pii import find_pii, span_digests

    return span_digests(find_pii(table(spark, sf_dir, "documents")))


OP8_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
link AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98),
reach AS (SELECT vec_id AS u, vec_id AS v FROM e UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u),
c AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u),
d AS (SELECT u AS vec_id, count(*) AS n_links FROM link GROUP BY u)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN d USING (vec_id)
"""


@query("op8_embedding_near_dedup", OP8_SQL)
def op8(spark, sf_dir):
    from eventloom.llm.vectors import embedding_links

    return embedding_links(table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \t-\r]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n_shingles FROM s),
e AS (SELECT doc_id, md5_number_lower(unnest(s)) AS h FROM s),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM c JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n_shingles + b.n_shingles - c)),
sym AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u),
m AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def op4(spark, sf_dir):
    from eventloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_ppm")
def op5(spark, sf_dir):
    from eventloom.llm.ppm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@query("op3_suffix_dedup")
def op3(spark, sf_dir):
    from eventloom.llm.suffix import remove_repeats, removal_digests

    return removal_digests(remove_repeats(table(spark, sf_dir, "documents")))


@query("op13_quality_rules")
def op13(spark, sf_dir):
    from eventloom.llm.rules import COUNTS, judge

    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "rule")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
u AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM i),
q AS (SELECT item_id, term, count(*) AS times FROM u GROUP BY item_id, term),
e AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
o AS (SELECT doc_id, n, term, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM o, g GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN o USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""


@query("op11_max_sketch_search", OP11_SQL)
def op11(spark, sf_dir):
    from eventloom.llm.search import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    import public_tokenizers

    from eventloom.llm.align import align_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align_tokenizers(table(spark, sf_dir, "documents"), *paths, digest=True).withColumnRenamed("groups", "groups_sha256")
