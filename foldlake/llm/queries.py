"""Queries that apply the corpus operators to the provided tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosspoly, fingerprints, html_text, langid, licenses, mixing, negatives, packing, quality, ranked, simhash, token_counts, topk
from .encoding import vocabulary_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op6_simhash_dedup")
def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_topk_threshold", """
    WITH x AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
               FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""")
def op10_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op4_rule_quality")
def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_license_rules")
def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


@query("op8_chunk_fingerprints")
def op8_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edited(table(spark, sf_dir, "documents"))


@query("op9_html_blocks")
def op9_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op11_strassen_negatives", """
    WITH x AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    scored AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
               FROM x a JOIN x c ON a <> c AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
                  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    met AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
                   row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
            FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5""")
def op11_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return negatives.mine(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", label=label)


_TERMS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> '')"""


@query("op12_rmq_search", rf"""
    WITH docs AS (SELECT doc_id, row_number() OVER () AS doc, {_TERMS} AS terms FROM documents),
    sizes AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0),
    asked AS (SELECT item_id, item, unnest(list_distinct(terms)) AS term FROM (SELECT item_id, row_number() OVER () AS item, {_TERMS} AS terms FROM benchmark)),
    held AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM held, sizes GROUP BY term, n_docs),
    impacts AS (SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(terms)::BIGINT * n_docs) // total))) AS impact
                FROM held JOIN weights USING (term) JOIN docs USING (doc), sizes),
    scored AS (SELECT item, item_id, doc, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op12_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_cross_polytope")
def op13_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


#: Domains are runs of sources; the weights of domains, languages and sources are whole numbers.
_DOMAIN = "'d' || cast(try_cast(substring(source, 4) AS int) % 4 AS string)"
_WEIGHTS = {
    "domain": "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END",
    "lang": "CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END",
    "source": "1 + length(source) % 3",
}


def source_tree() -> mixing.Tree:
    levels = {"domain": F.expr(_DOMAIN), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.Tree(levels, {name: F.expr(weight) for name, weight in _WEIGHTS.items()})


def _level_sql(path: list[str], parent: str) -> str:
    """CTEs that share the quotas of ``parent`` among the nodes of ``path``."""
    name, above = path[-1], ", ".join(path[:-1])
    by = f"PARTITION BY {above} " if above else ""
    join = f"JOIN {parent} USING ({above})" if above else f"CROSS JOIN {parent}"
    group = f"PARTITION BY {above}, filled" if above else "PARTITION BY filled"
    nodes = ", ".join(path)
    return f"""
    asked_{name} AS (SELECT {nodes}, CASE WHEN sum(supply) > 0 THEN max(w_{name}) ELSE 0 END::HUGEINT AS weight, sum(supply)::HUGEINT AS supply FROM leaves GROUP BY ALL),
    marked_{name} AS (SELECT *, supply = 0 OR supply * sum(weight) OVER rest <= (quota - coalesce(sum(supply) OVER before, 0)) * weight AS filled
        FROM (SELECT * FROM asked_{name} {join})
        WINDOW before AS ({by}ORDER BY supply::DOUBLE / greatest(weight, 1), {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
               rest AS ({by}ORDER BY supply::DOUBLE / greatest(weight, 1), {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    shared_{name} AS (SELECT *, CASE WHEN filled THEN supply ELSE ((quota - taken) * weight)::HUGEINT // open::HUGEINT END::HUGEINT AS share FROM (
        SELECT *, sum(CASE WHEN filled THEN supply ELSE 0 END) OVER ({by}) AS taken, sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({by}) AS open FROM marked_{name})),
    given_{name} AS (SELECT {nodes}, (share + CASE WHEN NOT filled AND turn <= remain THEN 1 ELSE 0 END)::HUGEINT AS quota FROM (
        SELECT *, quota - sum(share) OVER ({by}) AS remain, row_number() OVER ({group} ORDER BY {name}) AS turn FROM shared_{name}))"""


_MIX_SQL = rf"""
    WITH rows AS (SELECT doc_id, coalesce('d' || (TRY_CAST(substring(source, 4) AS INT) % 4)::VARCHAR, '(none)') AS domain, coalesce(lang, '(none)') AS lang,
        coalesce(source, '(none)') AS source, len(regexp_extract_all(coalesce(text, ''), '[^ 	

]+'))::BIGINT AS n_tokens FROM documents),
    leaves AS (SELECT *, ({_WEIGHTS["domain"]})::BIGINT AS w_domain, ({_WEIGHTS["lang"]})::BIGINT AS w_lang, ({_WEIGHTS["source"]})::BIGINT AS w_source, tokens * 3 AS supply
        FROM (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)),
    root AS (SELECT least(sum(supply), sum(tokens))::HUGEINT AS quota FROM leaves),
    {_level_sql(["domain"], "root")}, {_level_sql(["domain", "lang"], "given_domain")}, {_level_sql(["domain", "lang", "source"], "given_lang")},
    plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN (quota // tokens)::INT ELSE 0 END AS epochs,
        CASE WHEN tokens > 0 THEN (quota % tokens)::BIGINT ELSE 0 END AS rest FROM leaves JOIN given_source USING (domain, lang, source)),
    placed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '42', epochs::VARCHAR)), doc_id, n_tokens
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM rows JOIN plan USING (domain, lang, source))
    SELECT doc_id, domain, lang, source, epoch::INT AS epoch, n_tokens, n_tokens AS take_tokens FROM (SELECT *, unnest(range(epochs)) AS epoch FROM placed)
    UNION ALL SELECT doc_id, domain, lang, source, epochs AS epoch, n_tokens, least(n_tokens, rest - start)::BIGINT FROM placed WHERE rest > 0 AND start < rest"""


@query("op1_hierarchical_mix", _MIX_SQL)
def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by weight, a document up to three times."""
    return mixing.mix(table(spark, sf_dir, "documents"), source_tree(), F.col("total"), max_epochs=3)
