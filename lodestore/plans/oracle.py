"""The core's queries as SQL for DuckDB. Written from the definitions, not generated from the Spark plans."""

from __future__ import annotations

from ..operators import prompt

CHUNKS = """live AS (SELECT * FROM chunk WHERE chunk_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""
DOCUMENTS = """docs AS (SELECT * FROM document WHERE doc_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at DESC NULLS LAST) = 1)"""
SEARCHES = """searches AS (SELECT query_id, search_no, min(text) AS text, min(target) AS target FROM search_request WHERE text IS NOT NULL GROUP BY ALL)"""
HITS = """hits AS (SELECT query_id, search_no, is_dense, chunk_id, max(is_rewrite) AS is_rewrite, min(rank) AS rank,
    max(coalesce(dense, 0)) AS dense, max(coalesce(sparse, 0)) AS sparse, max(score) AS score
    FROM hit WHERE rank IS NOT NULL AND score IS NOT NULL AND is_dense IS NOT NULL GROUP BY ALL)"""
RERANKED = """reranked AS (SELECT query_id, chunk_id, min(rank) AS rank, max(score) AS score FROM hit
    WHERE is_dense IS NULL AND rank IS NOT NULL AND score IS NOT NULL GROUP BY ALL)"""
TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{Nd}}]+'), lambda x: x <> '')"
INDEX_TEXT = "CASE WHEN coalesce(context, '') <> '' THEN context || chr(10) || chr(10) || coalesce(content, '') ELSE content END"
POSTINGS = f"""words AS (SELECT chunk_id, coalesce({TERMS.format(INDEX_TEXT)}, []) AS w FROM live),
    p AS (SELECT term, chunk_id, count(*)::INT AS tf, any_value(dl)::INT AS dl
          FROM (SELECT chunk_id, len(w) AS dl, unnest(w) AS term FROM words) GROUP BY ALL),
    c AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE AS total FROM words)"""


def _meta(key: str, field: str = "s") -> str:
    return f"meta['{key}'].{field}"


def _uuid5(blob: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || {blob})"
    return f"""(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
        || substr('89ab89ab89ab89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
        FROM (SELECT {h} AS h))"""


def _normal(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def _bm25(where: str = "TRUE", k: int = 10) -> str:
    return f"""q AS (SELECT query_id, search_no, term, count(*) AS qtf FROM
        (SELECT query_id, search_no, unnest({TERMS.format("text")}) AS term FROM searches WHERE target IN ('all', 'sparse')) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    sparse AS (SELECT query_id, search_no, chunk_id,
        sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS sparse
        FROM q JOIN p USING (term) JOIN df USING (term), c GROUP BY ALL),
    ranked AS (SELECT query_id, search_no, chunk_id, sparse, row_number() OVER (PARTITION BY query_id, search_no ORDER BY round(sparse, 9) DESC, chunk_id) AS rank
        FROM sparse JOIN live USING (chunk_id) WHERE {where} QUALIFY rank <= {k})"""


def _cosine(where: str = "TRUE", k: int = 10, floor: str = "TRUE") -> str:
    return f"""near AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine, b.label
        FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where}),
    top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, vec_id) AS rank FROM near WHERE {floor} QUALIFY rank <= {k})"""


def _fused(score: str) -> str:
    return f"""WITH {HITS}, f AS (SELECT query_id, chunk_id, {score} AS score,
        coalesce(max(dense) FILTER (dense <> 0), 0) AS dense, coalesce(max(sparse) FILTER (sparse <> 0), 0) AS sparse FROM hits GROUP BY ALL)
    SELECT query_id, chunk_id, round(score, 6) AS score, round(dense, 6) AS dense, round(sparse, 6) AS sparse,
        row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10"""


def _hash_vector(tokens: str) -> str:
    """Unit bag-of-words vector of 32 buckets."""
    held = f"list_transform({tokens}, lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT % 32)"
    counts = f"list_transform(range(32), lambda b: len(list_filter({held}, lambda h: h = b))::DOUBLE)"
    return f"""(SELECT list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END) FROM
        (SELECT v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT {counts} AS v)))"""


def statements(source: str) -> dict[str, str]:
    top_hits = lambda n: f"top AS (SELECT r.query_id, r.rank, r.score, l.chunk_id, l.doc_id, l.idx, coalesce(l.content, '') AS content FROM reranked r JOIN live l USING (chunk_id) WHERE r.rank <= {n})"
    tokens = "CASE WHEN strlen({0}) = 0 THEN 0 ELSE greatest(1, strlen({0}) // 4) END"
    out = {
        "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL",
        "token_estimates": f"SELECT doc_id, {tokens.format('text')} AS tokens FROM documents WHERE text IS NOT NULL",
        "truncated_texts": """WITH c AS (SELECT doc_id, text, list_filter(range(0, 101), lambda n: strlen(left(text, n::INT)) <= 100) AS fit FROM documents WHERE text IS NOT NULL)
            SELECT doc_id, left(text, list_max(fit)::INT) AS head FROM c""",
        "doc_uuid5": f"SELECT doc_id, {_uuid5('''encode(source) || unhex('00') || encode(text)''')} AS id FROM documents WHERE text IS NOT NULL AND source IS NOT NULL",
        "chunk_uuid5": f"WITH {CHUNKS} SELECT chunk_id, {_uuid5('''encode(doc_id || '#' || idx)''')} AS id FROM live",
        "postings_tf": f"WITH {CHUNKS}, {POSTINGS} SELECT * FROM p",
        "term_df": f"WITH {CHUNKS}, {POSTINGS} SELECT term, count(*) AS df FROM p GROUP BY term",
        "corpus_stats": f"WITH {CHUNKS}, {POSTINGS} SELECT n::BIGINT AS n, total::BIGINT AS total, round(total / n, 6) AS avgdl FROM c",
        "hash_embed": f"SELECT doc_id, list_transform({_hash_vector(TERMS.format('text'))}, lambda x: round(x, 6)) AS embedding FROM documents WHERE text IS NOT NULL",
        "bm25_topk": f"WITH {CHUNKS}, {SEARCHES}, {POSTINGS}, {_bm25()} SELECT query_id, search_no, chunk_id, round(sparse, 6) AS score, rank FROM ranked",
        "bm25_filtered": f"WITH {CHUNKS}, {SEARCHES}, {POSTINGS}, {_bm25(_meta('lang') + " = 'en' AND " + _meta('lang', 't') + " = 'str'")} SELECT query_id, search_no, chunk_id, round(sparse, 6) AS score, rank FROM ranked",
        "bm25_terms_matched": f"""WITH {CHUNKS}, {SEARCHES}, {POSTINGS}, q AS (SELECT DISTINCT query_id, search_no, term FROM (SELECT query_id, search_no, unnest({TERMS.format('text')}) AS term FROM searches))
            SELECT query_id, search_no, count(k.term) AS matched FROM q LEFT JOIN (SELECT DISTINCT term FROM p) k USING (term) GROUP BY ALL""",
        "cosine_topk": f"WITH {_cosine()} SELECT query, vec_id, round(cosine, 6) AS cosine, rank FROM top",
        "cosine_topk_filtered": f"WITH {_cosine('b.label >= 5')} SELECT query, vec_id, round(cosine, 6) AS cosine, rank FROM top",
        "cosine_floor": f"WITH {_cosine(floor='cosine >= 0.2')} SELECT query, vec_id, round(cosine, 6) AS cosine, rank FROM top",
        "hybrid_retrieve": f"""WITH {CHUNKS}, {SEARCHES}, {POSTINGS}, {_bm25(k=50)},
            v AS (SELECT chunk_id, {_hash_vector('w')} AS v FROM words),
            a AS (SELECT query_id, search_no, {_hash_vector(TERMS.format('text'))} AS v FROM searches WHERE target IN ('all', 'dense')),
            cos AS (SELECT query_id, search_no, chunk_id, CASE WHEN list_sum(a.v) = 0 OR list_sum(v.v) = 0 THEN 0 ELSE list_cosine_similarity(a.v, v.v) END AS cosine FROM a, v),
            dense AS (SELECT query_id, search_no, chunk_id, cosine, row_number() OVER (PARTITION BY query_id, search_no ORDER BY round(cosine, 9) DESC, chunk_id) AS rank FROM cos QUALIFY rank <= 50),
            lists AS (SELECT query_id, search_no, TRUE AS is_dense, rank, chunk_id, cosine AS score FROM dense UNION ALL SELECT query_id, search_no, FALSE, rank, chunk_id, sparse FROM ranked),
            n AS (SELECT query_id, count(DISTINCT (search_no, is_dense)) AS lists FROM lists GROUP BY ALL),
            f AS (SELECT query_id, chunk_id, CASE WHEN any_value(n.lists) = 1 THEN max(score) ELSE sum(CASE WHEN search_no > 0 THEN 0.5 ELSE 1 END / (60.0 + rank)) END AS score,
                         any_value(n.lists) AS k, min(rank) AS own FROM lists JOIN n USING (query_id) GROUP BY ALL)
            SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k = 1 THEN own END, round(score, 9) DESC, chunk_id) AS rank FROM f QUALIFY rank <= 5""",
        "rrf_fusion": _fused("sum(1 / (60.0 + rank))"),
        "weighted_rrf": _fused("sum(CASE WHEN coalesce(is_rewrite, FALSE) THEN 0.5 ELSE 1 END / (60.0 + rank))"),
        "convex_blend": _fused("""0.6 * coalesce(max(CASE WHEN coalesce(is_rewrite, FALSE) THEN 0.5 ELSE 1 END / (1 + exp(-score))) FILTER (is_dense), 0)
            + 0.4 * coalesce(max(CASE WHEN coalesce(is_rewrite, FALSE) THEN 0.5 ELSE 1 END / (1 + exp(-score))) FILTER (NOT is_dense), 0)"""),
        "fusion_bypass": f"WITH {HITS} SELECT query_id, chunk_id, round(score, 6) AS score, round(dense, 6) AS dense, round(sparse, 6) AS sparse, rank::BIGINT AS rank FROM hits WHERE is_dense AND search_no = 0 AND rank <= 5",
        "minmax_norm": f"""WITH {HITS} SELECT query_id, search_no, is_dense, chunk_id,
            round(CASE WHEN hi = lo THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS score
            FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM hits WINDOW w AS (PARTITION BY query_id, search_no, is_dense))""",
        "sigmoid_norm": f"WITH {HITS} SELECT query_id, search_no, is_dense, chunk_id, round(1 / (1 + exp(-score / 2)), 6) AS score FROM hits",
        "dense_floor": f"""WITH {HITS} SELECT query_id, search_no, chunk_id, row_number() OVER (PARTITION BY query_id, search_no ORDER BY round(score, 9) DESC, chunk_id) AS rank
            FROM hits WHERE is_dense AND score >= 0.4""",
        "mmr_top3": f"""WITH {_cosine()}, cand AS (SELECT query, top.vec_id, cosine, rank, e.embedding::DOUBLE[] AS v FROM top JOIN embeddings e USING (vec_id)),
            one AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * cosine, 12) DESC, rank) = 1),
            rest AS (SELECT c.*, list_cosine_similarity(c.v, o.v) AS s1 FROM cand c JOIN one o USING (query) WHERE c.vec_id <> o.vec_id),
            two AS (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * cosine - 0.3 * s1, 12) DESC, rank) = 1),
            last AS (SELECT r.*, greatest(s1, list_cosine_similarity(r.v, t.v)) AS s2 FROM (SELECT query, vec_id, cosine, rank, v, s1 FROM rest) r JOIN (SELECT query, vec_id AS x, v FROM two) t USING (query) WHERE r.vec_id <> x),
            three AS (SELECT * FROM last QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(0.7 * cosine - 0.3 * s2, 12) DESC, rank) = 1)
            SELECT query, vec_id, 1::BIGINT AS rank FROM one UNION ALL SELECT query, vec_id, 2 FROM two UNION ALL SELECT query, vec_id, 3 FROM three""",
        "overlap_rerank": f"""WITH {CHUNKS}, {SEARCHES}, {RERANKED},
            r AS (SELECT r.query_id, r.chunk_id, lower(coalesce(l.content, '')) AS body, list_filter(string_split({_normal('s.text')}, ' '), lambda w: w <> '') AS w
                  FROM reranked r JOIN live l USING (chunk_id) JOIN searches s ON s.query_id = r.query_id AND s.search_no = 0),
            o AS (SELECT query_id, chunk_id, len(list_filter(w, lambda x: contains(body, x)))::DOUBLE AS score FROM r)
            SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o QUALIFY rank <= 5""",
        "neighbor_windows": f"""WITH {CHUNKS}, {RERANKED}, {top_hits(5)}
            SELECT t.query_id, t.rank::BIGINT AS rank, t.chunk_id, count(*) AS parts, string_agg(coalesce(l.content, ''), chr(10) ORDER BY l.idx, l.chunk_id, l.content) AS content
            FROM top t JOIN live l ON l.doc_id = t.doc_id AND l.idx BETWEEN t.idx - 1 AND t.idx + 1 GROUP BY t.query_id, t.rank, t.chunk_id""",
        "neighbors_expand": f"""WITH RECURSIVE {CHUNKS}, {RERANKED}, {top_hits(5)},
            o AS (SELECT t.query_id, t.chunk_id, row_number() OVER (PARTITION BY t.query_id ORDER BY t.rank, t.chunk_id) AS i, a.near, a.content FROM top t,
                  LATERAL (SELECT list(l.chunk_id) AS near, string_agg(coalesce(l.content, ''), chr(10) ORDER BY l.idx, l.chunk_id) AS content FROM live l
                           WHERE l.doc_id = t.doc_id AND l.idx BETWEEN t.idx - 1 AND t.idx + 1) a),
            walk AS (SELECT query_id, chunk_id, i, content, TRUE AS kept, near AS seen FROM o WHERE i = 1
                     UNION ALL SELECT o.query_id, o.chunk_id, o.i, o.content, NOT list_contains(w.seen, o.chunk_id),
                               CASE WHEN list_contains(w.seen, o.chunk_id) THEN w.seen ELSE list_concat(w.seen, o.near) END
                     FROM walk w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rank, chunk_id, content FROM walk WHERE kept""",
        "prompts": f"""WITH RECURSIVE {CHUNKS}, {SEARCHES}, {RERANKED}, {top_hits(10)},
            q AS (SELECT query_id, strlen(text) AS n, greatest(0, 1024 - {len(prompt.OVERHEAD) // 4} - CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, strlen(text) // 4) END) AS budget
                  FROM searches WHERE search_no = 0 AND query_id IN (SELECT query_id FROM reranked)),
            o AS (SELECT query_id, chunk_id, strlen(chunk_id || content) + 13 AS size, greatest(1, (strlen(chunk_id || content) + 13) // 4) AS cost,
                         row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM top),
            walk AS (SELECT query_id, i, size, cost <= budget AS taken, CASE WHEN cost <= budget THEN cost ELSE 0 END AS used, budget FROM o JOIN q USING (query_id) WHERE i = 1
                     UNION ALL SELECT o.query_id, o.i, o.size, used + cost <= budget, CASE WHEN used + cost <= budget THEN used + cost ELSE used END, budget
                     FROM walk w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1),
            k AS (SELECT query_id, size + strlen((row_number() OVER (PARTITION BY query_id ORDER BY i))::VARCHAR) - 1 AS size FROM walk WHERE taken)
            SELECT q.query_id, (any_value(q.n) + coalesce(sum(k.size), 0) + {len(prompt.CONTEXT_HEADER + prompt.QUESTION_HEADER + prompt.CLOSING) + 2})::BIGINT AS bytes, count(k.size) AS sources
            FROM q LEFT JOIN k USING (query_id) GROUP BY q.query_id""",
        "cache_evict": f"WITH {SEARCHES} SELECT query_id, search_no, target AS scope FROM searches WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target ORDER BY query_id DESC, search_no DESC) <= 20",
        "context_budget": f"""WITH RECURSIVE {CHUNKS}, {RERANKED}, {top_hits(10)},
            o AS (SELECT query_id, chunk_id, greatest(1, strlen('[0] (ID: ' || chunk_id || ')' || chr(10) || content || chr(10) || chr(10)) // 4) AS cost,
                         row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS i FROM top),
            walk AS (SELECT query_id, chunk_id, i, cost <= 500 AS taken, CASE WHEN cost <= 500 THEN cost ELSE 0 END AS used FROM o WHERE i = 1
                     UNION ALL SELECT o.query_id, o.chunk_id, o.i, used + cost <= 500, CASE WHEN used + cost <= 500 THEN used + cost ELSE used END
                     FROM walk w JOIN o ON o.query_id = w.query_id AND o.i = w.i + 1),
            k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM walk WHERE taken)
            SELECT query_id, chunk_id, (CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END + 1)::BIGINT AS place FROM k""",
        "lost_in_middle": f"""WITH {RERANKED}, k AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM reranked)
            SELECT query_id, chunk_id, (CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END + 1)::BIGINT AS place FROM k""",
        "history_budget": f"""WITH {SEARCHES}, t AS (SELECT *, target || ': ' || text || chr(10) AS line FROM searches),
            u AS (SELECT *, 14 + sum(greatest(1, strlen(line) // 4)) OVER (PARTITION BY query_id ORDER BY search_no DESC) AS used FROM t),
            h AS (SELECT query_id, 'Conversation so far (for reference only; do not cite it):' || chr(10) || string_agg(line, '' ORDER BY search_no) || chr(10) AS history FROM u WHERE used <= 35 GROUP BY query_id)
            SELECT query_id, coalesce(history, '') AS history FROM (SELECT DISTINCT query_id FROM searches) LEFT JOIN h USING (query_id)""",
        "prompt_tokens": f"""WITH {CHUNKS}, {SEARCHES}, {RERANKED}, {top_hits(5)}
            SELECT s.query_id, (greatest(1, strlen(s.text) // 4) + sum(greatest(1, strlen(content) // 4)))::BIGINT AS tokens
            FROM top JOIN searches s ON s.query_id = top.query_id AND s.search_no = 0 GROUP BY s.query_id, s.text""",
        "token_window_chunks": rf"""WITH t AS (SELECT doc_id::VARCHAR AS doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
            n AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 64 THEN 1 ELSE ceil((len(w) - 64) / 48)::INT + 1 END AS n FROM t),
            i AS (SELECT doc_id, w, unnest(range(n)) AS idx FROM n)
            SELECT doc_id, idx, array_to_string(w[idx * 48 + 1 : idx * 48 + 64], ' ') AS content, {_uuid5("encode(doc_id || '#' || idx)")} AS chunk_id FROM i""",
        "breadcrumbs": rf"""WITH {DOCUMENTS}, m AS (SELECT doc_id, coalesce({_meta('title')}, '') AS title, coalesce({_meta('section')}, '') AS section,
                regexp_replace(regexp_replace(coalesce({_meta('source')}, ''), '^.*[/\\]', ''), '\.[^.]*$', '') AS base FROM docs WHERE meta IS NOT NULL),
            t AS (SELECT doc_id, section, CASE WHEN title <> '' THEN title ELSE base END AS title FROM m)
            SELECT doc_id, CASE WHEN title = '' THEN section WHEN section = '' THEN title ELSE title || ' > ' || section END AS context FROM t""",
        "upsert_chunks": f"WITH {CHUNKS} SELECT chunk_id, doc_id, idx::BIGINT AS idx, content FROM live",
        "stream_ingest": f"WITH {CHUNKS} SELECT chunk_id, doc_id, idx::BIGINT AS idx FROM live",
        "delete_source": f"WITH {CHUNKS} SELECT chunk_id FROM live WHERE coalesce({_meta('source')}, '') <> '{source}'",
        "replace_source": f"WITH {CHUNKS} SELECT chunk_id, idx::BIGINT AS idx FROM live WHERE coalesce({_meta('source')}, '') <> '{source}' OR idx = 0",
        "delete_ids": f"WITH {CHUNKS} SELECT chunk_id FROM live WHERE chunk_id NOT IN (SELECT chunk_id FROM hit WHERE chunk_id IS NOT NULL)",
        "search_dedup": f"""WITH {SEARCHES}, s AS (SELECT *, {_normal('text')} AS k FROM searches WHERE target IS NOT NULL),
            w AS (SELECT *, lag(target) OVER g AS prev, coalesce(max((target = 'all')::INT) OVER (g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had
                  FROM s WHERE k <> '' WINDOW g AS (PARTITION BY query_id, k ORDER BY search_no))
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY search_no) - 1 AS n, trim(text) AS text, target
            FROM w WHERE had = 0 AND (prev IS NULL OR prev <> target)""",
        "cache_exact": f"""WITH {SEARCHES} SELECT {_uuid5("encode(target) || unhex('00') || encode(" + _normal('text') + ")")} AS key, count(*) AS asked FROM searches WHERE target IS NOT NULL GROUP BY ALL""",
        "cache_semantic": f"""WITH near AS (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
                FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
            SELECT query, vec_id, round(cosine, 6) AS cosine FROM near WHERE cosine >= 0.15 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(cosine, 9) DESC, vec_id) = 1""",
        "evidence_pool": f"""WITH {HITS}, f AS (SELECT query_id, chunk_id, min((search_no + 1, rank)) AS a FROM hits WHERE is_dense GROUP BY ALL)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY a, chunk_id) AS place, chunk_id FROM f""",
        "crag_route": f"""WITH {SEARCHES}, {RERANKED},
            s AS (SELECT query_id, max(text) FILTER (search_no = 0) AS question, max(text) FILTER (search_no = 1) AS missing, count(*) AS hops FROM searches GROUP BY ALL),
            b AS (SELECT query_id, max(score) AS best, count(*) AS evidence FROM reranked GROUP BY ALL),
            x AS (SELECT *, coalesce(best, -1) > 0 AS enough, coalesce(evidence, 0) AS e, coalesce({_normal('missing')} = {_normal('question')}, FALSE) AS repeated FROM s LEFT JOIN b USING (query_id))
            SELECT query_id, CASE WHEN enough AND e > 0 THEN 'generate' WHEN hops < 3 AND coalesce(missing, '') <> '' AND NOT repeated THEN 'refine' ELSE 'abstain' END AS route FROM x""",
    }
    cases = f"""{CHUNKS}, {SEARCHES}, {HITS}, {RERANKED}, src AS (SELECT chunk_id, {_meta('source')} AS source FROM live),
        wants AS (SELECT DISTINCT r.query_id AS case_id, coalesce(s.target, 'none') AS category, src.source AS want FROM reranked r JOIN src USING (chunk_id)
                  JOIN searches s ON s.query_id = r.query_id AND s.search_no = 0 WHERE r.rank <= 3 AND src.source IS NOT NULL),
        firsts AS (SELECT case_id, category, want, min(h.rank) AS first FROM wants LEFT JOIN
                   (SELECT query_id, rank, source FROM hits JOIN src USING (chunk_id) WHERE is_dense AND search_no = 0 AND rank <= 10) h
                   ON h.query_id = case_id AND h.source = want GROUP BY ALL),
        scored AS (SELECT case_id, category, (count(first) > 0)::INT::DOUBLE AS hit, count(first) / count(*) AS recall, coalesce(1 / min(first), 0) AS rr,
                   coalesce(list_sum(list_transform(list_distinct(list(first) FILTER (first IS NOT NULL)), lambda r: 1 / log2(r + 1))), 0)
                   / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda r: 1 / log2(r + 1))) AS ndcg FROM firsts GROUP BY ALL)"""
    out["eval_cases"] = f"WITH {cases} SELECT case_id, category, hit, round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM scored"
    out["eval_metrics"] = f"""WITH {cases} SELECT CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) AS cases, round(avg(hit), 6) AS hit_rate,
        round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scored GROUP BY GROUPING SETS ((category), ())"""
    lang, kind = f"{_meta('lang')}", f"{_meta('lang', 't')} = 'str'"
    has = "list_contains(map_keys(meta), '{}')"
    number = f"{_meta('version', 't')} IN ('int', 'float') AND {_meta('version', 'd')}"
    tests = {
        "filter_eq": f"{kind} AND {lang} = 'en'",
        "filter_ne": f"{has.format('lang')} AND NOT ({kind} AND {lang} = 'en')",
        "filter_in": f"{kind} AND {lang} IN ('de', 'fr')",
        "filter_nin": f"{has.format('lang')} AND NOT ({kind} AND {lang} IN ('de', 'fr'))",
        "filter_any_of": f"{kind} AND {lang} IN ('es', 'ru') AND {has.format('title')} AND {_meta('title')} <> ''",
        "filter_gt": f"{number} > 2",
        "filter_gte": f"{number} >= 2",
        "filter_lt": f"{number} < 3",
        "filter_lte": f"{number} <= 3",
    }
    out |= {name: f"WITH {DOCUMENTS} SELECT doc_id FROM docs WHERE {test}" for name, test in tests.items()}
    return out
