"""Fragments of the SQL that the queries are compared with (DuckDB's dialect)."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"regexp_replace(lower(strip_accents({x})), '[^\\x00-\\x7F]', '', 'g')"


def tokens(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '[a-z0-9]{{2,}}')"


def index_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents({x})), '[\\p{{L}}\\p{{N}}]+')"


def compact(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def values(rows: list[tuple], columns: str) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns}))"


def bm25(queries: str, rows: str, weights: dict[str, float], limit: int, mode: str = "fallback", where: str = "true") -> str:
    """CTEs ending in bm25_found (query_id, id, bm25, n_matched, lexical_rank). queries: (query_id, query); rows: (id, fields)."""
    fields = " UNION ALL ".join(f"SELECT id, unnest({index_tokens(f'coalesce(CAST({f} AS VARCHAR), chr(32))')}) AS term, CAST({w} AS DOUBLE) AS w FROM bm25_rows" for f, w in weights.items())
    keep = {"and": "n_matched = n_tokens", "or": "true", "fallback": "n_matched = n_tokens OR (NOT bool_or(n_matched = n_tokens) OVER (PARTITION BY query_id) AND n_tokens > 1)"}[mode]
    return f"""
bm25_rows AS ({rows}),
bm25_asked AS (SELECT query_id, len(list_distinct(t)) AS n_tokens, unnest(list_distinct(t)) AS token FROM (SELECT query_id, {tokens('query')} AS t FROM ({queries}) q)),
bm25_terms AS ({fields}),
bm25_posts AS (SELECT id, term, sum(w) AS wtf, count(*) AS n FROM bm25_terms GROUP BY id, term),
bm25_dl AS (SELECT r.id, CAST(coalesce(sum(p.n), 0) AS DOUBLE) AS dl FROM bm25_rows r LEFT JOIN bm25_posts p USING (id) GROUP BY r.id),
bm25_all AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl FROM bm25_dl),
bm25_hits AS (SELECT token, id, sum(wtf) AS tf FROM (SELECT DISTINCT token FROM bm25_asked) a JOIN bm25_posts p ON starts_with(p.term, a.token) GROUP BY token, id),
bm25_idf AS (SELECT token, CASE WHEN ln((n_rows - n + 0.5) / (n + 0.5)) > 0 THEN ln((n_rows - n + 0.5) / (n + 0.5)) ELSE 1e-6 END AS idf
             FROM (SELECT token, count(*) AS n FROM bm25_hits GROUP BY token), bm25_all),
bm25_sums AS (SELECT query_id, n_tokens, id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25, count(*) AS n_matched
              FROM bm25_asked JOIN bm25_hits USING (token) JOIN bm25_idf USING (token) JOIN bm25_dl USING (id), bm25_all WHERE {where} GROUP BY ALL),
bm25_kept AS (SELECT * FROM (SELECT *, {keep} AS keep FROM bm25_sums) WHERE keep),
bm25_found AS (SELECT query_id, id, bm25, n_matched, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) AS lexical_rank
               FROM bm25_kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), id) <= {limit})"""


def knn(queries: str, vectors: str, limit: int) -> str:
    """CTEs ending in knn_found (query_id, id, distance, vector_rank). queries: (query_id, q); vectors: (id, x), arrays of double."""
    return f"""
knn_q AS (SELECT *, CAST(CAST(list_inner_product(q, q) AS FLOAT) AS DOUBLE) AS qn FROM ({queries})),
knn_x AS (SELECT *, CAST(CAST(list_inner_product(x, x) AS FLOAT) AS DOUBLE) AS xn FROM ({vectors})),
knn_d AS (SELECT query_id, id, qn + xn - 2 * list_inner_product(q, x) AS distance FROM knn_q, knn_x),
knn_found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), id) AS vector_rank FROM knn_d
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), id) <= {limit})"""


def fuse_batches(name: str, rows: str, limit: int) -> str:
    """CTE name (query_id, identity, rrf, best_rank, variant_hits, rank) of rows (query_id, batch, rank, identity)."""
    order = "PARTITION BY query_id ORDER BY round(rrf, 12) DESC, best_rank, identity"
    return f"""
{name} AS (SELECT *, row_number() OVER ({order}) AS rank
  FROM (SELECT query_id, identity, sum(1.0 / (60 + rank)) AS rrf, min(rank) AS best_rank, count(DISTINCT batch) AS variant_hits FROM ({rows}) GROUP BY query_id, identity)
  QUALIFY row_number() OVER ({order}) <= {limit})"""
