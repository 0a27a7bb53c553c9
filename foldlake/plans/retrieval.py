"""Queries on tokens, embeddings and similarity search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..constants import AMINO_ACIDS, RESIDUE_TOKENS
from ..functions.scalars import r6
from ..functions.vectors import l2_normalize
from ..operators import embed as E
from ..operators import retrieve as R
from ..operators import tokens as K
from ..session import stored
from . import proxies as P
from .registry import query


def _vocab_sql(layout: str) -> str:
    return "vocab(token, id) AS (VALUES " + ", ".join(f"('{t}', {k})" for t, k in K.token_ids(layout).items()) + ")"


_LETTERS = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"


def _raw_letters(spark, d):
    """All letters of the whole text, J included, which no vocabulary has."""
    return P.texts(spark, d, "documents", "doc_id").select(
        "doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


@query("vocab", f"""WITH {_vocab_sql('base')}, letters AS (SELECT unnest(string_split({_LETTERS}, '')) AS token FROM documents)
SELECT id, token, count(letters.token) AS uses FROM vocab LEFT JOIN letters USING (token) GROUP BY ALL""")
def vocab(spark, d):
    """How often each vocabulary token occurs in the texts."""
    used = _raw_letters(spark, d).select(F.explode(F.split("seq", "")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    return K.vocab(spark, "base").join(used, "token", "left").select("id", "token", F.coalesce("uses", F.lit(0)).alias("uses"))


_IDS_SQL = "CASE c " + " ".join(f"WHEN '{t}' THEN '{K.token_ids('roberta')[t]}'" for t in RESIDUE_TOKENS) + " END"


@query("tokenize", f"""WITH texts AS (SELECT doc_id, {_LETTERS} AS seq FROM documents)
SELECT doc_id, NOT contains(seq, 'J') AS known, CASE WHEN NOT contains(seq, 'J') THEN (length(seq) + 2)::INT END AS n_tokens,
    CASE WHEN NOT contains(seq, 'J') THEN md5('0,' || CASE WHEN seq = '' THEN '' ELSE array_to_string(
        list_transform(string_split(seq, ''), lambda c: {_IDS_SQL}), ',') || ',' END || '2') END AS digest FROM texts""")
def tokenize(spark, d):
    coded = K.encode(_raw_letters(spark, d))
    return coded.select("doc_id", F.col("tokens").isNotNull().alias("known"),
                        F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"),
                        F.md5(F.array_join("tokens", ",")).alias("digest"))


@query("token_batches", f"""WITH RECURSIVE {P.SEQUENCES_SQL}, sized AS (SELECT chain_key AS key, (length(seq) + 2)::INT AS size FROM sequences),
placed AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY md5(key), key) - 1 AS place FROM sized),
lengths AS (SELECT size, count(*) AS n, row_number() OVER (ORDER BY size) AS step FROM sized GROUP BY size),
packed AS (SELECT 0::BIGINT AS step, 0::BIGINT AS size, 0::BIGINT AS fit, 0::BIGINT AS here, -1::BIGINT AS open, 0::BIGINT AS used, -1::BIGINT AS last
    UNION ALL SELECT step, size, fit, here, open, CASE WHEN n > here THEN (n - here - 1) % fit + 1 ELSE used + n END,
        open + (greatest(0, n - here) + fit - 1) // fit FROM (
        SELECT l.step, l.size, greatest(1, 8192 // l.size) AS fit, l.n, p.last AS open, p.used,
            CASE WHEN p.used = 0 THEN 0 ELSE least(l.n, greatest(0, greatest(1, 8192 // l.size) - p.used)) END AS here
        FROM packed p JOIN lengths l ON l.step = p.step + 1))
SELECT key, s.size, (open + CASE WHEN place < here THEN 0 ELSE (place - here) // fit + 1 END)::BIGINT AS batch_no
FROM placed s JOIN packed p ON p.size = s.size""")
def token_batches(spark, d):
    return K.token_batches(P.sequences(spark, d), budget=8192, extra=2)


@query("chunk_sequences", f"""WITH {P.SEQUENCES_SQL}, cut AS (SELECT chain_key, seq,
    unnest(range(0, (length(seq) + 1021) // 1022)) AS chunk_no FROM sequences)
SELECT chain_key, chunk_no::INT AS chunk_no, length(substr(seq, chunk_no * 1022 + 1, 1022))::INT AS size,
    md5(substr(seq, chunk_no * 1022 + 1, 1022)) AS digest FROM cut""")
def chunk_sequences(spark, d):
    return K.chunk(P.sequences(spark, d)).select("chain_key", "chunk_no", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


def _token_vecs(spark, d):
    """A four-dimensional vector per letter of every conversation turn."""
    turns = P.texts(spark, d, "conversations", "conv_id", "turn").select(
        F.concat_ws("_", "conv_id", "turn").alias("chain_key"), P.clean(F.col("text")).alias("seq"))
    letters = turns.select("chain_key", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("pos", "c"))
    code = F.log(F.ascii("c").cast("double"))
    vec = F.array(*[F.when(F.col("pos") % 4 == k, code).otherwise(code / (k + 2)) for k in range(4)])
    return letters.select("chain_key", "pos", F.expr("pos div 100").alias("chunk_no"), vec.alias("vec"))


_VECS_SQL = f"""letters AS (SELECT conv_id || '_' || turn AS chain_key, {P.clean_sql('text')} AS seq FROM conversations),
spelled AS (SELECT chain_key, unnest(range(0, length(seq))) AS pos, seq FROM letters),
token_vecs AS (SELECT chain_key, pos, pos // 100 AS chunk_no, {', '.join(
    f"CASE WHEN pos % 4 = {k} THEN ln(ascii(seq[pos + 1])::DOUBLE) ELSE ln(ascii(seq[pos + 1])::DOUBLE) / {k + 2} END AS v{k}" for k in range(4))}
    FROM spelled)"""


def _dims(df):
    return df.select("chain_key", *[r6(F.col("emb")[k]).alias(f"v{k}") for k in range(4)])


_ROUNDED = ", ".join(f"round(avg(v{k}), 6) + 0.0 AS v{k}" for k in range(4))


@query("mean_pool", f"WITH {_VECS_SQL} SELECT chain_key, {_ROUNDED} FROM token_vecs GROUP BY chain_key")
def mean_pool(spark, d):
    return _dims(E.mean_pool(_token_vecs(spark, d)))


@query("chunk_pool", f"""WITH {_VECS_SQL}, chunks AS (SELECT chain_key, chunk_no, {', '.join(f'avg(v{k}) AS v{k}' for k in range(4))}
    FROM token_vecs GROUP BY ALL) SELECT chain_key, {_ROUNDED} FROM chunks GROUP BY chain_key""")
def chunk_pool(spark, d):
    return _dims(E.chunk_pool(_token_vecs(spark, d)))


def _composition_model():
    """Stand-in for a user's model: letter counts scaled to unit length."""
    def predict(counts: np.ndarray) -> np.ndarray:
        return counts / (np.linalg.norm(counts, axis=1, keepdims=True) + 1e-8)

    return predict


_COUNTS = [f"(length(seq) - length(replace(seq, '{a}', '')))" for a in AMINO_ACIDS]


@query("embed_stub", f"""WITH {P.SEQUENCES_SQL}, counts AS (SELECT chain_key, {', '.join(f'{c} AS n{k}' for k, c in enumerate(_COUNTS))} FROM sequences)
SELECT chain_key, {', '.join(f"round(n{k} / (sqrt({' + '.join(f'n{m} * n{m}' for m in range(20))}) + 1e-8), 6) + 0.0 AS v{k}" for k in range(20))}
FROM counts""")
def embed_stub(spark, d):
    counts = P.sequences(spark, d).select("chain_key", F.array(*[F.expr(c).cast("double") for c in _COUNTS]).alias("counts"))
    out = E.embed(counts, _composition_model, "counts", len(AMINO_ACIDS))
    return out.select("chain_key", *[r6(F.col("emb")[k]).alias(f"v{k}") for k in range(20)])


def _token_model():
    """Stand-in for a user's model: a vector for each token, from its id and its place."""
    def predict(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
        place = np.arange(tokens.shape[1])
        return np.stack([(tokens * (d + 3) + place * (d % 2)) % 7 / 7 for d in range(4)], axis=2)

    return predict


_TOKEN_DIMS = [f"avg((id * {d + 3} + k * {d % 2}) % 7 / 7.0::DOUBLE) AS v{d}" for d in range(4)]


@query("embed_tokens", f"""WITH {P.SEQUENCES_SQL}, cut AS (SELECT chain_key, seq, unnest(range(0, (length(seq) + 1021) // 1022)) AS chunk_no FROM sequences),
parts AS (SELECT chain_key, chunk_no, substr(seq, chunk_no * 1022 + 1, 1022) AS part FROM cut),
spelled AS (SELECT chain_key, chunk_no, unnest(range(1, length(part) + 1)) AS k, unnest(string_split(part, '')) AS c FROM parts),
coded AS (SELECT chain_key, chunk_no, k, ({_IDS_SQL})::INT AS id FROM spelled),
chunks AS (SELECT chain_key, {', '.join(_TOKEN_DIMS)} FROM coded GROUP BY chain_key, chunk_no),
means AS (SELECT chain_key, {', '.join(f'avg(v{d}) AS v{d}' for d in range(4))} FROM chunks GROUP BY chain_key)
SELECT chain_key, {', '.join(f'round(v{d} / (sqrt(v0 * v0 + v1 * v1 + v2 * v2 + v3 * v3) + 1e-8), 6) + 0.0 AS v{d}' for d in range(4))} FROM means""")
def embed_tokens(spark, d):
    """Sequences of any length through a model on token batches padded to the longest of a batch."""
    return _dims(E.embed_sequences(P.sequences(spark, d), _token_model))


@query("l2_normalize", f"""WITH {P.INDEX_SQL}, n AS (SELECT chain_key, emb, sqrt(list_inner_product(emb, emb)) + 1e-8 AS norm FROM index_vectors)
SELECT chain_key, {', '.join(f'round(emb[{k + 1}] / norm, 6) + 0.0 AS v{k}' for k in range(64))} FROM n""")
def normalized(spark, d):
    unit = P.index_vectors(spark, d).select("chain_key", l2_normalize(F.col("emb")).alias("u"))
    return unit.select("chain_key", *[r6(F.col("u")[k]).alias(f"v{k}") for k in range(64)])


@query("index_exclude", f"""WITH {P.GROUPS_SQL}, {P.TEST_IDS_SQL}
SELECT chain_key, L FROM groups WHERE L > 0 AND pdb_id NOT IN (SELECT pdb_id FROM test_ids)""")
def index_exclude(spark, d):
    return E.build_index(P.groups(spark, d), P.test_ids(spark, d)).select("chain_key", "L")


_SIMS_SQL = f"""{P.INDEX_SQL}, unit AS (SELECT chain_key, pdb_id, sqrt(list_inner_product(emb, emb)) + 1e-8 AS norm, emb FROM index_vectors),
sims AS (SELECT q.chain_key AS query_key, t.chain_key AS tpl_key, q.pdb_id = t.pdb_id AS same_group,
    round(list_inner_product(q.emb, t.emb) / (q.norm * t.norm), 9) AS sim FROM unit q, unit t)"""
_TOP_SQL = """top AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY sim DESC, tpl_key)::INT AS rank FROM sims
    WHERE {0} QUALIFY rank <= 4)"""


@query("topk_similar", f"""WITH {_SIMS_SQL}, {_TOP_SQL.format('NOT same_group')}
SELECT query_key, tpl_key, rank, round(sim, 6) + 0.0 AS sim FROM top""")
def topk_similar(spark, d):
    vectors = P.index_vectors(spark, d)
    return R.topk_similar(vectors, vectors).select("query_key", "tpl_key", "rank", r6(F.col("sim")).alias("sim"))


@query("topk_blocked", f"""WITH {_SIMS_SQL}, {_TOP_SQL.format('true')}
SELECT query_key, tpl_key, rank, same_group FROM top""")
def topk_blocked(spark, d):
    """Without the filter: which of the best hits it would have blocked."""
    vectors = P.index_vectors(spark, d)
    return R.topk_similar(vectors, vectors, exclude_same_group=False).select("query_key", "tpl_key", "rank", "same_group")


_OTHER_SQL = _SIMS_SQL.replace("FROM unit q, unit t)", "FROM asked q, unit t)").replace("sims AS (", """asked AS (SELECT 'q' || chain_key AS chain_key, pdb_id, norm,
    list_concat(emb[33:64], emb[1:32]) AS emb FROM unit), sims AS (""", 1)


@query("topk_other", f"""WITH {_OTHER_SQL}, {_TOP_SQL.format('NOT same_group')}
SELECT query_key, tpl_key, rank, round(sim, 6) + 0.0 AS sim FROM top""")
def topk_other(spark, d):
    """Queries that are not in the index: its vectors with their halves exchanged."""
    vectors = P.index_vectors(spark, d)
    asked = vectors.select(F.concat(F.lit("q"), "chain_key").alias("chain_key"), "pdb_id",
                           F.concat(F.slice("emb", 33, 32), F.slice("emb", 1, 32)).alias("emb"))
    return R.topk_similar(asked, vectors).select("query_key", "tpl_key", "rank", r6(F.col("sim")).alias("sim"))


@query("hit_weights", f"""WITH {_SIMS_SQL}, {_TOP_SQL.format('NOT same_group')},
e AS (SELECT *, exp(sim - max(sim) OVER (PARTITION BY query_key)) AS e FROM top)
SELECT query_key, tpl_key, round(e / (sum(e) OVER (PARTITION BY query_key) + 1e-8), 6) + 0.0 AS weight FROM e""")
def hit_weights(spark, d):
    vectors = P.index_vectors(spark, d)
    return R.hit_weights(R.topk_similar(vectors, vectors)).select("query_key", "tpl_key", r6(F.col("weight")).alias("weight"))


_CHUNK_COUNTS = [f"(length(chunk) - length(replace(chunk, '{a}', '')))" for a in AMINO_ACIDS]
_BUILD_SQL = f"""{P.SEQUENCES_SQL}, {P.GROUPS_SQL}, {P.TEST_IDS_SQL},
cut AS (SELECT chain_key, substr(seq, unnest(range(0, (length(seq) + 1021) // 1022)) * 1022 + 1, 1022) AS chunk FROM sequences),
counts AS (SELECT chain_key, {', '.join(f'{c} AS n{k}' for k, c in enumerate(_CHUNK_COUNTS))} FROM cut),
norms AS (SELECT *, sqrt({' + '.join(f'n{k} * n{k}' for k in range(20))}) + 1e-8 AS norm FROM counts),
means AS (SELECT chain_key, {', '.join(f'avg(n{k} / norm) AS m{k}' for k in range(20))} FROM norms GROUP BY chain_key),
units AS (SELECT chain_key, sqrt({' + '.join(f'm{k} * m{k}' for k in range(20))}) + 1e-8 AS size, {', '.join(f'm{k}' for k in range(20))} FROM means),
vectors AS (SELECT chain_key, pdb_id, pdb_id IN (SELECT pdb_id FROM test_ids) AS held_out, [{', '.join(f'm{k} / size' for k in range(20))}] AS emb
    FROM units JOIN groups USING (chain_key)),
normed AS (SELECT *, sqrt(list_inner_product(emb, emb)) + 1e-8 AS norm FROM vectors),
built AS (SELECT q.chain_key AS query_key, t.chain_key AS tpl_key, round(list_inner_product(q.emb, t.emb) / (q.norm * t.norm), 9) AS sim
    FROM normed q JOIN normed t ON q.held_out AND NOT t.held_out),
best AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY sim DESC, tpl_key)::INT AS rank FROM built QUALIFY rank <= 4)"""


def _letter_counts(chunks):
    """chain_key, counts: how often each residue letter occurs in a chunk, counted in one pass over its bytes."""
    letters = np.frombuffer(AMINO_ACIDS.encode(), dtype=np.uint8)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            counts = np.array([np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)[letters] for text in texts], dtype=np.float64)
            ends = pa.array(np.arange(len(texts) + 1) * len(letters), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(counts.ravel()))], names=["chain_key", "counts"])

    return chunks.select("chain_key", "chunk").mapInArrow(run, "chain_key string, counts array<double>")


@query("index_build", f"WITH {_BUILD_SQL} SELECT query_key, tpl_key, rank, round(sim, 6) + 0.0 AS sim FROM best")
def index_build(spark, d):
    """From texts to an index without held-out groups, asked with the held-out chains.

    Sequences are cut, each chunk goes through the model, chunks are averaged and scaled, held-out groups are left out,
    the index is written and read back, and every held-out chain is looked up in it.
    """
    chunks = K.chunk(P.sequences(spark, d))
    vectors = E.chain_vectors(E.embed(_letter_counts(chunks), _composition_model, "counts", len(AMINO_ACIDS)))
    held_out = P.test_ids(spark, d)
    embedded = stored(vectors.join(P.groups(spark, d), "chain_key"))
    index = stored(E.build_index(embedded, held_out))
    asked = embedded.join(held_out, "pdb_id", "left_semi")
    return R.topk_similar(asked, index).select("query_key", "tpl_key", "rank", r6(F.col("sim")).alias("sim"))
