"""The registered queries again as SQL over the given tables, to check results against."""

from __future__ import annotations

from rankloom.functions.text import BETWEEN_DIGITS, BETWEEN_LETTERS, STRIP_CHARS
from rankloom.plans import testbed
from rankloom.plans.registry import BROKEN_STEP, DEEP_K, DIGITS, K, KS, SAMPLE, SEED

_DIM = testbed.DENSE.dim
_DEPTH = testbed.RUN_DEPTH
# Deeper than any list.
_WHOLE = 2_000_000_000
_METRICS = ("recall", "precision", "mrr", "ndcg")
_STRIP = " || ".join(f"chr({ord(char)})" for char in STRIP_CHARS)


# Words by consuming the letters around a mark, as DuckDB's patterns cannot look around.
_LETTERS = rf"(?:[{BETWEEN_LETTERS}]\p{{L}}\p{{M}}*)*".replace("'", "''")
_DIGITS = rf"(?:[{BETWEEN_DIGITS}]\p{{N}})*".replace("'", "''")
_WORD = rf"_*(?:\p{{L}}\p{{M}}*{_LETTERS}|\p{{N}}{_DIGITS})(?:[\p{{L}}\p{{M}}]\p{{M}}*{_LETTERS}|\p{{N}}{_DIGITS}|_)*"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{_WORD}')"


def _bm25(name: str, boosts: dict[str, float], k: int, asked: str = "queries") -> str:
    """CTEs for one BM25 run called ``name``."""
    boost = "CASE field " + " ".join(f"WHEN '{field}' THEN {value}" for field, value in boosts.items()) + " END"
    fields = ", ".join(f"'{field}'" for field in boosts)
    return f"""
{name}_fields AS (
  SELECT q.qid, p.doc_id, p.field,
         sum(({boost}) * q.qtf * i.idf * (p.tf / (p.tf + 1.2 * (0.25 + 0.75 * l.dl / s.avgdl)))) AS score
  FROM query_terms q JOIN postings p USING (term) JOIN idf i USING (field, term)
       JOIN doc_len l USING (doc_id, field) JOIN field_stats s USING (field)
  WHERE field IN ({fields}) AND q.qid IN (SELECT qid FROM {asked})
  GROUP BY q.qid, p.doc_id, p.field),
{name}_scores AS (SELECT qid, doc_id, max(score) AS score FROM {name}_fields GROUP BY qid, doc_id),
{name} AS ({_top_k(f"{name}_scores", k)})"""


def _top_k(scores: str, k: int) -> str:
    return f"""SELECT qid, doc_id, score, CAST(place AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST(score AS FLOAT) DESC, doc_id) AS place
  FROM {scores}) WHERE place <= {k}"""


def _vectors(name: str, key: str, frequency: str, count: str, owners: str) -> str:
    """CTEs for hashed unit vectors: long entries ``{name}_entries`` and arrays ``{name}``."""
    bucket = f"CAST(CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {_DIM} AS INTEGER)"
    return f"""
{name}_sums AS (
  SELECT {key}, {bucket} AS bucket, sum((1 + ln({count})) * idf) AS value
  FROM {frequency} JOIN content_idf USING (term) GROUP BY ALL),
{name}_entries AS (
  SELECT {key}, bucket, CAST(value / sqrt(sum(value * value) OVER (PARTITION BY {key})) AS FLOAT) AS value
  FROM {name}_sums),
{name}_maps AS (
  SELECT {key}, map_from_entries(list((bucket, CAST(value AS DOUBLE)))) AS entries
  FROM {name}_entries GROUP BY {key}),
{name} AS (
  SELECT o.{key}, list_transform(range({_DIM}), lambda i: coalesce(m.entries[CAST(i AS INTEGER)], 0.0)) AS embedding
  FROM {owners} o LEFT JOIN {name}_maps m USING ({key}))"""


def _fused(name: str, k: int, bm25_weight: float = 1.0, dense_weight: float = 1.0, sides: tuple[str, str] = ("bm25_run", "dense_run")) -> str:
    bm25, dense = sides
    return f"""
{name}_parts AS (
  SELECT qid, doc_id, 'bm25' AS method, rank, CAST({bm25_weight} AS DOUBLE) / (60 + rank) AS contribution FROM {bm25}
  UNION ALL
  SELECT qid, doc_id, 'dense', rank, CAST({dense_weight} AS DOUBLE) / (60 + rank) FROM {dense}),
{name}_sums AS (
  SELECT qid, doc_id, sum(contribution) AS score,
         min(rank) FILTER (WHERE method = 'bm25') AS bm25_rank,
         min(rank) FILTER (WHERE method = 'dense') AS dense_rank
  FROM {name}_parts GROUP BY qid, doc_id),
{name} AS (
  SELECT qid, doc_id, score, CAST(place AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC,
                                 bm25_rank ASC NULLS LAST, dense_rank ASC NULLS LAST) AS place
    FROM {name}_sums) WHERE place <= {k})"""


_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "corpus": (
        (),
        """
corpus AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS text
  FROM documents)""",
    ),
    "queries": ((), "\nqueries AS (SELECT item_id AS qid, text FROM benchmark)"),
    "qrels": (
        ("queries",),
        f"""
doc_words AS (SELECT doc_id, ' ' || array_to_string({_words('text')}, ' ') || ' ' AS padded FROM documents),
passage_words AS (SELECT qid, {_words('text')} AS w FROM queries),
qrels AS (
  SELECT qid, doc_id FROM doc_words, passage_words
  WHERE len(w) > 0 AND contains(padded, ' ' || array_to_string(w, ' ') || ' '))""",
    ),
    "eligible": (("qrels",), "\neligible AS (SELECT * FROM queries WHERE qid IN (SELECT qid FROM qrels))"),
    "postings": (
        ("corpus",),
        f"""
field_words AS (
  SELECT doc_id, 'title' AS field, {_words('title')} AS w FROM corpus
  UNION ALL SELECT doc_id, 'text', {_words('text')} FROM corpus),
doc_len AS (SELECT doc_id, field, CAST(len(w) AS INTEGER) AS dl FROM field_words WHERE len(w) > 0),
postings AS (
  SELECT doc_id, field, term, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT doc_id, field, unnest(w) AS term FROM field_words) GROUP BY ALL)""",
    ),
    "idf": (
        ("postings",),
        """
field_stats AS (
  SELECT field, count(*) AS n_docs, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl FROM doc_len GROUP BY field),
term_stats AS (SELECT field, term, count(*) AS df FROM postings GROUP BY field, term),
idf AS (
  SELECT field, term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf
  FROM term_stats JOIN field_stats USING (field))""",
    ),
    "query_terms": (
        ("queries",),
        f"""
query_terms AS (
  SELECT qid, term, CAST(count(*) AS INTEGER) AS qtf
  FROM (SELECT qid, unnest({_words('text')}) AS term FROM queries) GROUP BY ALL)""",
    ),
    "content_idf": (
        ("postings",),
        """
content AS (SELECT doc_id, term, CAST(sum(tf) AS INTEGER) AS tf FROM postings GROUP BY ALL),
content_idf AS (
  SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
  FROM (SELECT term, count(*) AS df, (SELECT count(DISTINCT doc_id) FROM doc_len) AS n FROM content GROUP BY term))""",
    ),
    "doc_vectors": (("content_idf",), _vectors("doc_vectors", "doc_id", "content", "tf", "corpus")),
    "query_vectors": (
        ("content_idf", "query_terms"),
        _vectors("query_vectors", "qid", "query_terms", "qtf", "queries"),
    ),
    "dense_scores": (
        ("doc_vectors", "query_vectors"),
        """
dense_scores AS (
  SELECT qid, doc_id, list_dot_product(q.embedding, d.embedding) AS score
  FROM query_vectors q, doc_vectors d)""",
    ),
    "dense_run": (("dense_scores",), f"\ndense_run AS ({_top_k('dense_scores', _DEPTH)})"),
    "bm25_run": (("idf", "query_terms"), _bm25("bm25_run", {"title": 2.0, "text": 1.0}, _DEPTH)),
    "fused": (("bm25_run", "dense_run"), _fused("fused", K)),
    "method_runs": (
        ("fused", "eligible"),
        f"""
method_runs AS (
  SELECT 'bm25' AS method, qid, doc_id, rank FROM bm25_run WHERE rank <= {K}
  UNION ALL SELECT 'dense', qid, doc_id, rank FROM dense_run WHERE rank <= {K}
  UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM fused)""",
    ),
    "metrics": (
        ("method_runs",),
        f"""
cutoffs AS (SELECT unnest([{', '.join(map(str, KS))}]) AS k),
methods AS (SELECT unnest(['bm25', 'dense', 'hybrid']) AS method),
n_rel AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
places AS (
  SELECT r.method, r.qid, r.rank, j.doc_id IS NOT NULL AS hit
  FROM method_runs r LEFT JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id),
by_query AS (
  SELECT m.method, e.qid, c.k, n.n_rel,
         count(*) FILTER (WHERE p.hit AND p.rank <= c.k) AS hits,
         count(p.rank) FILTER (WHERE p.rank <= c.k) AS places,
         min(p.rank) FILTER (WHERE p.hit AND p.rank <= c.k) AS first_hit,
         coalesce(sum(1.0 / log2(p.rank + 1)) FILTER (WHERE p.hit AND p.rank <= c.k), 0.0) AS dcg,
         list_sum([1.0 / log2(i + 1) FOR i IN range(1, least(n.n_rel, c.k) + 1)]) AS idcg
  FROM methods m CROSS JOIN (SELECT qid FROM eligible) e CROSS JOIN cutoffs c JOIN n_rel n ON n.qid = e.qid
       LEFT JOIN places p ON p.method = m.method AND p.qid = e.qid
  GROUP BY m.method, e.qid, c.k, n.n_rel),
query_metrics AS (
  SELECT method, qid, k, hits / n_rel AS recall,
         CASE WHEN places > 0 THEN hits / places ELSE 0.0 END AS precision,
         coalesce(1.0 / first_hit, 0.0) AS mrr, dcg, idcg, dcg / idcg AS ndcg
  FROM by_query),
long_metrics AS (
  SELECT method, metric, k, avg(value) AS value FROM (
    SELECT method, k, unnest(['recall', 'precision', 'mrr', 'ndcg']) AS metric,
           unnest([recall, precision, mrr, ndcg]) AS value FROM query_metrics)
  GROUP BY method, metric, k)""",
    ),
    "latency": (
        (),
        """
latency AS (SELECT event_type AS method, avg(value) * 1000.0 AS avg_latency_ms FROM events GROUP BY 1)""",
    ),
    "report": (
        ("metrics",),
        "\nreport AS (\n  SELECT method, "
        + ", ".join(
            f"round(max(value) FILTER (WHERE metric = '{metric}' AND k = {k}), {DIGITS}) AS \"{metric}@{k}\""
            for k in KS
            for metric in _METRICS
        )
        + ", 0.0::DOUBLE AS avg_latency_ms\n  FROM long_metrics GROUP BY method)",
    ),
    "summary": (
        ("report",),
        "\nsummary AS (\n  "
        + "\n  UNION ALL ".join(
            f"SELECT method, '{metric}@{k}' AS metric, \"{metric}@{k}\" AS value FROM report"
            for k in KS
            for metric in ("recall", "mrr")
        )
        + """),
winners AS (
  SELECT metric, method, value FROM (
    SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, method) AS place FROM summary)
  WHERE place = 1)""",
    ),
}


def _with(needs: tuple[str, ...], select: str, *extra: str) -> str:
    """A query with the CTEs it needs, each once and after those it builds on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for before in _CTES[name][0]:
                add(before)
            order.append(name)

    for name in needs:
        add(name)
    parts = [_CTES[name][1] for name in order] + list(extra)
    return f"WITH {','.join(parts)}\n{select}" if parts else select


_RANKED = f"qid, doc_id, round(score, {DIGITS}) AS score, rank"
_SUMMARY = ", ".join(f'"{metric}@{k}"' for k in KS for metric in ("recall", "mrr"))


def _by_query(metric: str) -> str:
    return _with(
        ("metrics",),
        f"SELECT qid, k, round({metric}, {DIGITS}) AS value FROM query_metrics WHERE method = 'bm25'",
    )


def _cosine() -> str:
    return f"""
units AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / norm AS FLOAT))::DOUBLE[] AS e
  FROM (SELECT vec_id, embedding, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm
        FROM embeddings)),
pairs AS (
  SELECT q.vec_id AS qid, d.vec_id AS doc_id, list_dot_product(q.e, d.e) AS score FROM units q, units d),
run AS ({_top_k("pairs", K)})"""


def _inner() -> str:
    return f"""
pairs AS (
  SELECT q.vec_id AS qid, d.vec_id AS doc_id,
         list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings d),
run AS ({_top_k("pairs", K)})"""


def _long_vectors(key: str, vectors: str) -> str:
    return f"""SELECT {key}, CAST(pos AS INTEGER) AS pos, round(CAST(value AS DOUBLE), {DIGITS}) AS value FROM (
  SELECT {key}, unnest(range(len(embedding))) AS pos, unnest(embedding) AS value FROM {vectors})"""


def _encoder_hook() -> str:
    counts = ", ".join(
        f"CAST(len(content) - len(replace(content, '{c}', '')) AS DOUBLE)" for c in "abcdefghijklmnopqrstuvwxyz0123456789"
    )
    return f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(value AS FLOAT) AS DOUBLE), {DIGITS}) AS value FROM (
  SELECT doc_id, unnest(range(36)) AS pos,
         unnest([x / (CASE WHEN norm = 0 THEN 1 ELSE norm END) FOR x IN counts]) AS value FROM (
    SELECT doc_id, counts, sqrt(list_dot_product(counts, counts)) AS norm FROM (
      SELECT doc_id, [{counts}] AS counts FROM (
        SELECT doc_id, CASE WHEN title <> '' THEN trim(title || chr(10) || text, {_STRIP}) ELSE text END AS content
        FROM corpus))))"""


def _rerank() -> str:
    pair = [f"list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+'))" for text in ("q.text", "d.content")]
    return f"""SELECT {_RANKED} FROM (
  SELECT qid, doc_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY CAST(score AS FLOAT) DESC, before) AS INTEGER) AS rank
  FROM (
    SELECT r.qid, r.doc_id, r.rank AS before,
           CASE WHEN len({pair[0]}) = 0 THEN 0.0 ELSE len(list_intersect({pair[0]}, {pair[1]})) / len({pair[0]}) END AS score
    FROM bm25_run r JOIN queries q USING (qid) JOIN (
      SELECT doc_id, CASE WHEN title <> '' THEN trim(title || chr(10) || text, {_STRIP}) ELSE text END AS content FROM corpus
    ) d USING (doc_id)))
WHERE rank <= {K}"""


SQL: dict[str, str] = {
    "corpus_jsonl": _with(("corpus",), "SELECT CAST(doc_id AS VARCHAR) AS doc_id, title, text FROM corpus"),
    "corpus_rejects": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id,
       CASE WHEN doc_id % {BROKEN_STEP} = 0 THEN 'malformed' ELSE 'read' END AS reason,
       CAST(count(*) FILTER (doc_id % {BROKEN_STEP} <> 0) OVER () AS INTEGER) AS n_good,
       CAST(count(*) FILTER (doc_id % {BROKEN_STEP} = 0) OVER () AS INTEGER) AS n_rejected
FROM documents""",
    "queries_jsonl": "SELECT CAST(item_id AS VARCHAR) AS qid, text FROM benchmark",
    "qrels_tsv": "SELECT DISTINCT 'quality' AS qid, CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE quality >= 1",
    "qrels_binary": "SELECT DISTINCT 'quality' AS qid, doc_id FROM labels WHERE quality >= 1",
    "qrels_from_passages": _with(("qrels",), "SELECT qid, doc_id FROM qrels"),
    "text_index_roundtrip": _with(
        ("postings",), "SELECT doc_id, field, term, tf, dl FROM postings JOIN doc_len USING (doc_id, field)"
    ),
    "text_index_upsert": _with(("idf",), "SELECT field, term, df FROM term_stats"),
    "text_index_segments": _with(
        ("idf",),
        f"""SELECT doc_id, field, term, tf, dl, df, round(idf, {DIGITS}) AS idf
FROM postings JOIN doc_len USING (doc_id, field) JOIN idf USING (field, term)""",
    ),
    "vector_index_roundtrip": _long_vectors("doc_id", "(SELECT vec_id AS doc_id, embedding FROM embeddings)"),
    "doc_text_compose": _with(
        ("corpus",),
        f"SELECT doc_id, CASE WHEN title <> '' THEN trim(title || chr(10) || text, {_STRIP}) ELSE text END AS content FROM corpus",
    ),
    "eligible_queries": _with(("eligible",), "SELECT qid, text FROM eligible"),
    "sample_queries": _with(
        ("queries",), f"SELECT qid, text FROM queries ORDER BY md5('{SEED}:' || qid), qid LIMIT {SAMPLE}"
    ),
    "sample_by_ordinal": _with(
        ("queries",),
        f"""SELECT qid, text
FROM (SELECT *, row_number() OVER (ORDER BY qid, text) - 1 AS ordinal, count(*) OVER () AS n FROM queries)
WHERE n <= {SAMPLE} OR ordinal IN (
  SELECT ordinal FROM (
    SELECT CAST('0x' || substr(md5('{SEED}:' || j), 1, 8) AS BIGINT) % (SELECT count(*) FROM queries) AS ordinal, min(j) AS j
    FROM range(100000) AS tries(j) GROUP BY 1)
  ORDER BY j LIMIT {SAMPLE})""",
    ),
    "tokenize_terms": _with(
        ("postings",),
        """SELECT doc_id, field, CAST(pos AS INTEGER) AS pos, term FROM (
  SELECT doc_id, field, unnest(range(len(w))) AS pos, unnest(w) AS term FROM field_words)""",
    ),
    "term_frequency": _with(
        ("postings",), "SELECT doc_id, field, term, tf, dl FROM postings JOIN doc_len USING (doc_id, field)"
    ),
    "doc_lengths": _with(("postings",), "SELECT doc_id, field, dl FROM doc_len"),
    "field_stats": _with(("idf",), f"SELECT field, n_docs, round(avgdl, {DIGITS}) AS avgdl FROM field_stats"),
    "term_idf": _with(("idf",), f"SELECT field, term, df, round(idf, {DIGITS}) AS idf FROM idf"),
    "content_idf": _with(("content_idf",), f"SELECT term, df, round(idf, {DIGITS}) AS idf FROM content_idf"),
    "query_terms": _with(("query_terms",), "SELECT qid, term, qtf FROM query_terms"),
    "bm25_single_field": _with(
        ("idf", "query_terms"), f"SELECT {_RANKED} FROM run", _bm25("run", {"text": 1.0}, K)
    ),
    "bm25_multi_field": _with(("bm25_run",), f"SELECT {_RANKED} FROM bm25_run"),
    "bm25_topk": _with(("bm25_run",), f"SELECT {_RANKED} FROM bm25_run WHERE rank <= {K}"),
    "bm25_field_boost": _with(
        ("idf", "query_terms"),
        f"""SELECT CAST(1 AS DOUBLE) AS title_boost, {_RANKED} FROM plain
UNION ALL SELECT CAST(2 AS DOUBLE), {_RANKED} FROM boosted""",
        _bm25("plain", {"title": 1.0, "text": 1.0}, K),
        _bm25("boosted", {"title": 2.0, "text": 1.0}, K),
    ),
    "bm25_segments": _with(("bm25_run",), f"SELECT {_RANKED} FROM bm25_run WHERE rank <= {K}"),
    "query_cost": _with(
        ("postings", "query_terms"),
        """SELECT qid, count(*) AS postings, count(DISTINCT doc_id) AS documents
FROM query_terms JOIN postings USING (term) GROUP BY qid""",
    ),
    "hash_embed_docs": _with(
        ("doc_vectors",),
        _long_vectors("doc_id", "doc_vectors"),
    ),
    "l2_normalize": _with((), _long_vectors("vec_id", "(SELECT vec_id, e AS embedding FROM units)"), _cosine()),
    "dense_ip_topk": _with((), f"SELECT {_RANKED} FROM run", _inner()),
    "dense_cells_topk": _with((), f"SELECT {_RANKED} FROM run", _inner()),
    "dense_cosine_topk": _with((), f"SELECT {_RANKED} FROM run", _cosine()),
    "dense_text_topk": _with(("dense_run",), f"SELECT {_RANKED} FROM dense_run WHERE rank <= {K}"),
    "encoder_hook": _with(("corpus",), _encoder_hook()),
    "encoder_batches": _with(("corpus",), _encoder_hook()),
    "rerank_topk": _with(("bm25_run",), _rerank()),
    "dense_beyond_corpus": _with(
        ("dense_scores",),
        "SELECT qid, count(*) AS places, count(*) AS last FROM dense_scores GROUP BY qid",
    ),
    "vector_dim_check": """SELECT CAST(len(embedding) AS INTEGER) AS dim, count(*) AS n_vectors,
       len(embedding) = (SELECT min(len(embedding)) FROM embeddings)
       AND len(embedding) = (SELECT max(len(embedding)) FROM embeddings) AS fits
FROM embeddings GROUP BY len(embedding)""",
    "vector_mismatches": """
WITH sides AS (
  SELECT 'index' AS side, vec_id, CASE WHEN label = 3 THEN len(embedding) - 1 ELSE len(embedding) END AS dim FROM embeddings
  UNION ALL
  SELECT 'query', vec_id, CASE WHEN label % 2 = 1 THEN len(embedding) // 2 ELSE len(embedding) END FROM embeddings),
usual AS (SELECT dim FROM sides WHERE side = 'index' GROUP BY dim ORDER BY count(*) DESC, dim LIMIT 1)
SELECT side, CAST(vec_id AS VARCHAR) AS id, CAST(s.dim AS INTEGER) AS dim, CAST(usual.dim AS INTEGER) AS expected
FROM sides s, usual WHERE s.dim <> usual.dim""",
    "rrf_contribution": _with(
        ("fused",), "SELECT qid, doc_id, method, rank, round(contribution, 9) AS contribution FROM fused_parts"
    ),
    "rrf_fuse": _with(
        ("fused",), "SELECT qid, doc_id, round(score, 9) AS score, bm25_rank, dense_rank FROM fused_sums"
    ),
    "rrf_weighted": _with(
        ("bm25_run", "dense_run"),
        f"""SELECT CAST(10 AS DOUBLE) AS bm25_weight, {_RANKED} FROM lexical
UNION ALL SELECT CAST(0.1 AS DOUBLE), {_RANKED} FROM semantic""",
        _fused("lexical", K, 10.0, 0.1),
        _fused("semantic", K, 0.1, 10.0),
    ),
    "rrf_topk": _with(("fused",), f"SELECT {_RANKED} FROM fused"),
    "rrf_deep": _with(
        ("idf", "query_terms", "dense_scores"),
        f"SELECT {_RANKED} FROM deep",
        _bm25("deep_bm25", {"title": 2.0, "text": 1.0}, 2 * DEEP_K),
        f"\ndeep_dense AS ({_top_k('dense_scores', 2 * DEEP_K)})",
        _fused("deep", DEEP_K, sides=("deep_bm25", "deep_dense")),
    ),
    "rrf_exact": _with(
        ("idf", "query_terms", "dense_scores"),
        f"SELECT {_RANKED} FROM whole",
        _bm25("whole_bm25", {"title": 2.0, "text": 1.0}, _WHOLE),
        f"\nwhole_dense AS ({_top_k('dense_scores', _WHOLE)})",
        _fused("whole", K, sides=("whole_bm25", "whole_dense")),
    ),
    "metrics_none_relevant": f"""SELECT 'self' AS method, metric, k, round(value, {DIGITS}) AS value FROM (
  SELECT avg(CAST(quality >= 1 AS DOUBLE)) AS value
  FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id)),
  (SELECT unnest(['recall', 'precision', 'mrr', 'ndcg']) AS metric),
  (SELECT unnest([{', '.join(map(str, KS))}]) AS k)""",
    "metrics_no_overlap": f"""SELECT 'bm25' AS method, metric, k, CAST(0 AS DOUBLE) AS value
FROM (SELECT unnest(['recall', 'precision', 'mrr', 'ndcg']) AS metric), (SELECT unnest([{', '.join(map(str, KS))}]) AS k)""",
    "split_addressing": "SELECT DISTINCT 'dev' AS qid, CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE toxic >= 1",
    **{f"{name}_at_k": _by_query(name) for name in ("recall", "precision", "mrr", "dcg", "idcg", "ndcg")},
    "eval_run": _with(
        ("metrics",),
        f"SELECT method, metric, k, round(value, {DIGITS}) AS value FROM long_metrics WHERE method = 'bm25'",
    ),
    "eval_all_methods": _with(
        ("metrics",), f"SELECT method, metric, k, round(value, {DIGITS}) AS value FROM long_metrics"
    ),
    "metrics_wide": _with(("report",), "SELECT * EXCLUDE (avg_latency_ms) FROM report"),
    "avg_latency": _with(
        ("latency",), f"SELECT method, round(avg_latency_ms, {DIGITS}) AS avg_latency_ms FROM latency"
    ),
    "method_report": _with(("report",), "SELECT * FROM report"),
    "method_report_json": _with(("report",), "SELECT * FROM report"),
    "report_csv": _with(("report",), "SELECT * FROM report"),
    "report_markdown": _with(
        ("report",),
        "SELECT method, concat_ws(' ', "
        + ", ".join(f"printf('%.4f', \"{metric}@{k}\")" for k in KS for metric in ("recall", "mrr"))
        + ", printf('%.4f', avg_latency_ms)) AS cells FROM report",
    ),
    "report_one_method": _with(("report",), "SELECT * FROM report WHERE method = 'bm25'"),
    "summary_columns": _with(("report",), f"SELECT method, {_SUMMARY}, avg_latency_ms FROM report"),
    "best_method": _with(("summary",), "SELECT metric, method, value FROM winners"),
    "method_wins": _with(
        ("summary",),
        """SELECT r.method, count(w.metric) AS wins
FROM report r LEFT JOIN winners w ON w.method = r.method GROUP BY r.method""",
    ),
    "fastest_method": _with(
        ("latency",),
        f"SELECT method, round(avg_latency_ms, {DIGITS}) AS avg_latency_ms FROM latency ORDER BY 2, 1 LIMIT 1",
    ),
    "chart_table": _with(
        ("report",),
        """SELECT 'recall@10' AS panel, method, "recall@10" AS value FROM report
UNION ALL SELECT 'avg_latency_ms', method, avg_latency_ms FROM report""",
    ),
}
