"""SQL for DuckDB that gives the rows of the queries of the same name."""

from __future__ import annotations

# Unicode white space, line ends and hidden characters, as classes of the SQL engine's regular expressions.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HIDDEN = r"\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}"
TYPES = "('gene_or_protein', 'chemical', 'organism', 'method_or_tool', 'process_or_phenotype', 'other')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


INDEX = f"""
allidx AS (SELECT chunk_id, split_part(chunk_id, ':', 1) AS doc_id, min(text) AS text FROM chunks
           WHERE chunk_id IS NOT NULL AND regexp_matches(text, '[^{WS}]') GROUP BY chunk_id),
excluded AS (SELECT DISTINCT pmcid AS doc_id FROM twins)"""
RUN = INDEX + ", idx AS (SELECT * FROM allidx WHERE doc_id NOT IN (SELECT doc_id FROM excluded))"
FULL = INDEX + ", idx AS (SELECT * FROM allidx)"


def bm25(queries: str, k: int) -> str:
    """CTEs up to `hits` (query_id, chunk_id, score, rank) over idx for the queries (query_id, text) of a CTE."""
    return f"""
tk AS (SELECT chunk_id, {toks('text')} AS ts FROM idx),
st AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM tk),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM tk) GROUP BY 1),
rawidf AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM dfs, st),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM rawidf) ELSE idf END AS idf FROM rawidf),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({toks('text')}) AS term FROM {queries}) GROUP BY 1, 2),
tf AS (SELECT chunk_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT chunk_id, len(ts) AS len, unnest(ts) AS term FROM tk) GROUP BY 1, 2),
sc AS (SELECT query_id, chunk_id, round(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a))), 6) AS score
       FROM qt JOIN idf USING (term) JOIN tf USING (term), st GROUP BY 1, 2),
hits AS (SELECT * FROM (SELECT q.query_id, i.chunk_id, coalesce(score, 0.0e0) AS score,
           row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(score, 0.0e0) DESC, i.chunk_id) AS rank
         FROM (SELECT DISTINCT query_id FROM {queries}) q CROSS JOIN idx i LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = i.chunk_id) WHERE rank <= {k})"""


CASES = """
vecs AS (SELECT chunk_id, min(vector) AS vector FROM index_vectors WHERE len(vector) = 64 AND chunk_id IS NOT NULL GROUP BY 1),
cases AS (SELECT t.pmcid AS query_id, t.text, v.vector FROM (SELECT pmcid, min(title) AS text FROM twins GROUP BY 1) t
          LEFT JOIN (SELECT split_part(chunk_id, ':', 1) AS pmcid, arg_min(vector, chunk_id) AS vector FROM vecs GROUP BY 1) v USING (pmcid))"""
DENSE = """
cv AS (SELECT query_id, CAST(vector AS DOUBLE[]) AS q, sqrt(list_inner_product(CAST(vector AS DOUBLE[]), CAST(vector AS DOUBLE[]))) AS norm FROM cases WHERE vector IS NOT NULL),
dense AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
          FROM (SELECT query_id, chunk_id, round(CASE WHEN norm > 0 THEN list_inner_product(q, CAST(v.vector AS DOUBLE[])) / norm ELSE 0 END, 6) AS score
                FROM cv, vecs v WHERE chunk_id IN (SELECT chunk_id FROM idx))) WHERE rank <= {k})"""
RANKED = """
firsts AS (SELECT query_id, split_part(chunk_id, ':', 1) AS doc_id, min(rank) AS first FROM hits GROUP BY 1, 2),
alldocs AS (SELECT query_id, doc_id, first, row_number() OVER (PARTITION BY query_id ORDER BY first) AS doc_rank FROM firsts)"""
METRICS = """
h AS (SELECT r.query_id, r.doc_id, d.doc_rank FROM relevant r LEFT JOIN (SELECT * FROM {docs} WHERE doc_rank <= 30) d USING (query_id, doc_id)),
c AS (SELECT query_id, count(*) AS n, count(*) FILTER (doc_rank <= 10) AS found, count(*) FILTER (doc_rank <= 30) AS found_3k, sum(CASE WHEN doc_rank <= 10 THEN 1 / log2(doc_rank + 1e0) ELSE 0 END) AS dcg FROM h GROUP BY 1),
metrics AS (SELECT query_id, coalesce(n, 0) AS relevant, coalesce(found, 0) AS found, coalesce(found_3k, 0) AS found_3k, coalesce(round(found / n, 6), 0) AS recall, coalesce(round(least(n, 10) / n, 6), 0) AS ceiling,
  coalesce(round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1e0))), 6), 0) AS ndcg FROM (SELECT DISTINCT query_id FROM cases) LEFT JOIN c USING (query_id))"""
ITEMS = "items AS (SELECT item_id AS query_id, min(text) AS text FROM eval_items WHERE text IS NOT NULL GROUP BY 1)"


def mentions(where: str = "") -> str:
    return f"""
best AS (SELECT chunk_id, entities, relations FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id
         ORDER BY coalesce(truncated, false), coalesce(len(entities), 0) DESC, recorded_at DESC) AS nr FROM chunk_extractions WHERE chunk_id IS NOT NULL {where}) WHERE nr = 1),
ments AS (SELECT chunk_id, lower(name) AS node, name, type FROM (SELECT chunk_id, {squeeze('e.name')} AS name, e.type AS type FROM (SELECT chunk_id, unnest(entities) AS e FROM best))
          WHERE name <> '' AND type IN {TYPES}),
cn AS (SELECT DISTINCT chunk_id, node FROM ments),
rels AS (SELECT r.chunk_id, least(s, t) AS src, greatest(s, t) AS dst FROM (SELECT chunk_id, lower({squeeze('r.source')}) AS s, lower({squeeze('r.target')}) AS t FROM (SELECT chunk_id, unnest(relations) AS r FROM best)) r
         JOIN cn a ON a.chunk_id = r.chunk_id AND a.node = s JOIN cn b ON b.chunk_id = r.chunk_id AND b.node = t WHERE s <> t),
edge AS (SELECT src, dst, 0.25e0 * sum(c) + sum(r) AS weight, CAST(sum(c) AS BIGINT) AS n_chunks, CAST(sum(r) AS BIGINT) AS n_relations FROM (
           SELECT a.node AS src, b.node AS dst, 1 AS c, 0 AS r FROM cn a JOIN cn b ON a.chunk_id = b.chunk_id AND a.node < b.node
           UNION ALL SELECT src, dst, 0, 1 FROM rels) GROUP BY 1, 2)"""


WITHOUT = "AND split_part(chunk_id, ':', 1) NOT IN (SELECT pmcid FROM twins)"
NODES = """
nn AS (SELECT node, count(*) AS n_mentions, count(DISTINCT chunk_id) AS n_chunks FROM ments GROUP BY 1),
nm AS (SELECT node, name FROM (SELECT node, name, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, name) AS nr FROM ments GROUP BY 1, 2) WHERE nr = 1),
nt AS (SELECT node, type FROM (SELECT node, type, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, type) AS nr FROM ments GROUP BY 1, 2) WHERE nr = 1)"""
PREDICATES = f"""
prels AS (SELECT least(s, t) AS src, greatest(s, t) AS dst, predicate FROM (SELECT r.chunk_id, r.predicate, lower({squeeze('r.source')}) AS s, lower({squeeze('r.target')}) AS t FROM (SELECT chunk_id, unnest(relations) AS r FROM best) r) r
          JOIN cn a ON a.chunk_id = r.chunk_id AND a.node = s JOIN cn b ON b.chunk_id = r.chunk_id AND b.node = t WHERE s <> t),
preds AS (SELECT src, dst, predicate FROM (SELECT src, dst, predicate, row_number() OVER (PARTITION BY src, dst ORDER BY count(*) DESC, predicate NULLS FIRST) AS nr FROM prels GROUP BY 1, 2, 3) WHERE nr = 1)"""
TOPS = f"""
deg AS (SELECT node, sum(weight) AS degree FROM (SELECT src AS node, weight FROM edge UNION ALL SELECT dst, weight FROM edge) GROUP BY 1),
asg AS (SELECT node, CAST(list_position(['gene_or_protein', 'chemical', 'organism', 'method_or_tool', 'process_or_phenotype', 'other'], type) - 1 AS INT) AS community_id FROM nt),
cs AS (SELECT community_id, count(*) AS size FROM asg GROUP BY 1 HAVING count(*) >= 3),
tops AS (SELECT * FROM (SELECT community_id, size, row_number() OVER (PARTITION BY community_id ORDER BY coalesce(degree, 0.0e0) DESC, node) AS rank, node, coalesce(degree, 0.0e0) AS degree
         FROM asg LEFT JOIN deg USING (node) JOIN cs USING (community_id)) WHERE rank <= 30)"""
STOP = "a an the this that these those it its we our they their which who what of in on at by for from to into with without within between during after before under over through via and or but nor than as if when while because how not no is are was were be been has have had can may does do".split()
CANDIDATES = rf"""
terms AS (SELECT query_id, t AS term FROM (SELECT query_id, trim(unnest(string_split(regexp_replace(lower({squeeze('text')}), '[^\p{{L}}\p{{N}} -]|\b(?:{'|'.join(STOP)})\b', '|', 'g'), '|'))) AS t FROM cases) WHERE length(t) >= 3 AND regexp_matches(t, '\p{{L}}')
          UNION SELECT query_id, t FROM (SELECT query_id, unnest(string_split(lower({squeeze('text')}), ' ')) AS t FROM cases) WHERE length(t) >= 4)"""
LOCAL = """
held AS (SELECT * FROM cn WHERE chunk_id IN (SELECT chunk_id FROM idx)),
live AS (SELECT DISTINCT node FROM held),
seeds AS (SELECT DISTINCT query_id, node FROM live JOIN terms ON node = term OR (length(term) >= 4 AND contains(node, term))),
ends AS (SELECT src AS node, dst AS other, weight FROM edge UNION ALL SELECT dst, src, weight FROM edge),
most AS (SELECT node, max(weight) AS m FROM ends GROUP BY 1),
weighed AS (SELECT query_id, node, max(w) AS w FROM (SELECT query_id, node, 1.0e0 AS w FROM seeds UNION ALL
            SELECT query_id, other, 0.5e0 * weight / m FROM seeds JOIN ends USING (node) JOIN most USING (node) WHERE other IN (SELECT node FROM live)) GROUP BY 1, 2),
votes AS (SELECT query_id, chunk_id, round(sum(w), 6) AS score FROM weighed JOIN held USING (node) GROUP BY 1, 2)"""
PLUS = f"""
reports AS (SELECT community_id, string_agg(node, ' ' ORDER BY rank) AS text FROM tops GROUP BY 1),
rk AS (SELECT community_id, {toks('text')} AS ts FROM reports),
rs AS (SELECT count(*) AS n, avg(len(ts)) AS a FROM rk),
rdf AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM rk) GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({toks('text')}) AS term FROM cases) GROUP BY 1, 2),
known AS (SELECT query_id, term, times, ln((n + 1e0) / df) AS idf FROM qt JOIN rdf USING (term), rs),
rtf AS (SELECT community_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT community_id, len(ts) AS len, unnest(ts) AS term FROM rk) GROUP BY 1, 2),
rsc AS (SELECT k.query_id, r.community_id, round(sum(times * idf * (1 + coalesce(tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / a)), 0))), 6) AS score
        FROM known k CROSS JOIN reports r LEFT JOIN rtf ON rtf.community_id = r.community_id AND rtf.term = k.term, rs GROUP BY 1, 2),
best8 AS (SELECT query_id, community_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id) AS nr FROM rsc) WHERE nr <= 8 AND score > 0),
votes AS (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM best8 JOIN asg USING (community_id) JOIN cn USING (node) WHERE chunk_id IN (SELECT chunk_id FROM idx) GROUP BY 1, 2)"""
TOP10 = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM votes) WHERE rank <= 10"
LICENSE = f"regexp_replace(regexp_replace(upper({squeeze('license_code')}), '^CC[- ]', 'CC '), ' \\d(\\.\\d)?$', '')"
LATEST = f"""
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY version DESC,
    coalesce(try_strptime(fetched_at, '%Y-%m-%d'), try_strptime(fetched_at, '%d/%m/%Y'), try_strptime(substr(fetched_at, 1, 10), '%Y-%m-%d')) DESC NULLS LAST, coalesce(md5, '') DESC, coalesce(license_code, '') DESC) AS nr
  FROM corpus_docs WHERE pmcid IS NOT NULL) WHERE nr = 1)"""
RELEVANT = """
au AS (SELECT DISTINCT pmcid, unnest(authors) AS author FROM latest),
near AS (SELECT DISTINCT t.pmcid AS query_id, b.pmcid AS doc_id FROM (SELECT DISTINCT pmcid FROM twins) t JOIN au a ON a.pmcid = t.pmcid JOIN au b ON a.author = b.author AND b.pmcid <> t.pmcid),
relevant AS (SELECT * FROM near WHERE doc_id IN (SELECT doc_id FROM idx))"""
FETCHED = "coalesce(try_strptime(fetched_at, '%Y-%m-%d'), try_strptime(fetched_at, '%d/%m/%Y'), try_strptime(substr(fetched_at, 1, 10), '%Y-%m-%d'))"
FIRST = f"""
firsts AS (SELECT pmcid, md5 FROM (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY version NULLS FIRST, {FETCHED} NULLS FIRST, coalesce(md5, '')) AS nr FROM corpus_docs WHERE pmcid IS NOT NULL) WHERE nr = 1),
chunked AS (SELECT DISTINCT doc_id AS pmcid FROM chunks WHERE doc_id IS NOT NULL)"""
SYNC = f"""
outcomes AS (SELECT f.pmcid, CASE WHEN c.pmcid IS NOT NULL AND l.md5 = f.md5 THEN 'cached' WHEN l.pmcid IS NULL THEN 'missing_upstream'
    WHEN coalesce({LICENSE}, '') NOT IN ('CC0', 'CC BY') THEN 'license_refused' WHEN l.md5 IS NOT DISTINCT FROM f.md5 THEN 'fetched' ELSE 'md5_mismatch' END AS outcome
  FROM firsts f LEFT JOIN latest l USING (pmcid) LEFT JOIN chunked c USING (pmcid))"""
FINDINGS = "finds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY received_at DESC) AS nr FROM review_findings WHERE finding_id IS NOT NULL) WHERE nr = 1)"
GROUND = f"""
ev AS (SELECT finding_id, quote, unnest(list_distinct(evidence_chunk_ids)) AS chunk_id FROM finds),
gr AS (SELECT f.finding_id, f.reviewer, count(ev.chunk_id) AS named, count(idx.text) AS known,
         CAST(coalesce(sum(CASE WHEN {squeeze('ev.quote')} <> '' AND contains({squeeze('idx.text')}, {squeeze('ev.quote')}) THEN 1 END), 0) AS BIGINT) AS grounded
       FROM finds f LEFT JOIN ev USING (finding_id) LEFT JOIN idx ON idx.chunk_id = ev.chunk_id GROUP BY 1, 2)"""
BOUND = "CAST(floor((length(coalesce(text, '')) + length(coalesce(quote, ''))) / 1.5e0) AS BIGINT) + 256 + 512 + 1"
CALLS = f"""
calls AS (SELECT run_id, finding_id, created_at, {BOUND} AS p, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^{WS}]+')) END AS a,
          CASE WHEN {BOUND} <= 4096 THEN 4096 WHEN {BOUND} <= 8192 THEN 8192 WHEN {BOUND} <= 16384 THEN 16384 WHEN {BOUND} <= 32768 THEN 32768 END AS c, split_part(model, ':', 1) AS s FROM finds)"""
LINES = r"""
raw AS (SELECT chunk_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (
  SELECT DISTINCT chunk_id, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls FROM (SELECT chunk_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM chunks WHERE text IS NOT NULL)))"""
RULES = [
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"disregard\s+(all\s+)?(previous|prior|above)",
    r"you\s+are\s+now\s+",
    r"system\s*prompt",
    r"\bas\s+an?\s+ai\b.{0,40}\b(accept|approve|rate|score)",
    r"(accept|approve)\s+this\s+(paper|manuscript|submission)",
]
SCREEN = f"""{LINES},
seen AS (SELECT *, regexp_replace(line, '[{HIDDEN}]', '', 'g') AS visible FROM raw),
clean AS (SELECT *, replace(regexp_replace(replace(visible, chr(9), chr(57344)), '[\\x00-\\x1f\\x7f-\\x9f\\p{{Cf}}]', '', 'g'), chr(57344), chr(9)) AS clean FROM seen),
ruled AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(clean, '(?i){r}') THEN '{r}'" for r in RULES)} END AS rule FROM clean)"""

ORACLES: dict[str, str] = {
    "sanitize_findings": f"""WITH {SCREEN}
SELECT DISTINCT chunk_id, line_no, kind, detail FROM (
  SELECT chunk_id, line_no, 'invisible_chars' AS kind, 'zero-width/bidi removed' AS detail FROM ruled WHERE regexp_matches(line, '[{HIDDEN}]')
  UNION ALL SELECT chunk_id, line_no, 'control_chars', 'control characters removed' FROM ruled WHERE visible <> clean
  UNION ALL SELECT chunk_id, line_no, 'instruction_line', rule FROM ruled WHERE rule IS NOT NULL)""",
    "sanitize_text": f"""WITH {SCREEN}
SELECT chunk_id, substr(sha256(string_agg(CASE WHEN rule IS NULL THEN clean ELSE '[screened: instruction-shaped line quoted as data] ' || clean END, chr(10) ORDER BY line_no)), 1, 32) AS clean_hash
FROM ruled GROUP BY 1 UNION ALL
SELECT DISTINCT chunk_id, substr(sha256(''), 1, 32) FROM chunks WHERE text = ''""",
    "chunk_words": f"WITH {FULL} SELECT chunk_id, len(regexp_extract_all(text, '[^{WS}]+')) AS n_words, len({toks('text')}) AS n_tokens, len(list_distinct({toks('text')})) AS n_terms FROM idx",
    "chunk_ids": """SELECT DISTINCT chunk_id, fresh_id, chunk_id = fresh_id AS same FROM (
  SELECT chunk_id, concat_ws(':', doc_id, "index", substr(sha256(text), 1, 8)) AS fresh_id FROM chunks WHERE text IS NOT NULL)""",
    "term_statistics": f"WITH {FULL} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest({toks('text')}) AS term FROM idx) GROUP BY 1",
    "prompt_windows": f"""WITH {FULL}, b AS (SELECT chunk_id, CAST(floor((21 + length(text)) / 1.5e0) AS BIGINT) + 256 + 1024 + 1 AS tokens_bound FROM idx)
SELECT chunk_id, tokens_bound, CAST(CASE WHEN tokens_bound <= 4096 THEN 4096 WHEN tokens_bound <= 8192 THEN 8192 WHEN tokens_bound <= 16384 THEN 16384 WHEN tokens_bound <= 32768 THEN 32768 END AS BIGINT) AS "window" FROM b""",
    "bm25_batch": f"WITH {FULL}, {ITEMS}, {bm25('items', 10)} SELECT query_id, chunk_id, score, rank FROM hits",
    "vector_batch": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q, sqrt(list_inner_product(e, e)) AS n FROM v WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT query_id, vec_id, round(list_inner_product(q, e) / n, 6) AS score FROM q, v)) WHERE rank <= 10""",
    "rrf_hybrid": f"""WITH {RUN}, {CASES}, {bm25('cases', 20)}, {DENSE.format(k=20)},
votes AS (SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY 1, 2) {TOP10}""",
    "doc_ranking": f"WITH {RUN}, {CASES}, {bm25('cases', 2000)}, {RANKED} SELECT query_id, doc_id, doc_rank FROM alldocs WHERE doc_rank <= 30",
    "depth_reached": f"""WITH {RUN}, {CASES}, {bm25('cases', 2000)}, {RANKED},
need AS (SELECT query_id, count(*) AS documents, max(CASE WHEN doc_rank = 30 THEN first END) AS need FROM alldocs GROUP BY 1)
SELECT query_id, least(documents, 30) AS documents, CAST(CASE WHEN need IS NULL THEN 2000 WHEN need <= 120 THEN 120 WHEN need <= 240 THEN 240 WHEN need <= 480 THEN 480 WHEN need <= 960 THEN 960 WHEN need <= 1920 THEN 1920 ELSE 2000 END AS BIGINT) AS chunk_depth FROM need""",
    "case_metrics": f"WITH {RUN}, {CASES}, {bm25('cases', 2000)}, {RANKED}, {LATEST}, {RELEVANT}, {METRICS.format(docs='alldocs')} SELECT * FROM metrics",
    "ladder_of_indexes": f"""WITH {RUN}, {CASES}, {bm25('cases', 2000)}, {DENSE.format(k=2000)}, {LATEST}, {RELEVANT},
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT query_id, chunk_id, round(sum(1e0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM hits UNION ALL SELECT query_id, chunk_id, rank FROM dense) GROUP BY 1, 2)),
every AS (SELECT 'bm25' AS ranker, query_id, chunk_id, rank FROM hits UNION ALL SELECT 'vector', query_id, chunk_id, rank FROM dense UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM fused WHERE rank <= 2000),
ranked AS (SELECT ranker, query_id, doc_id, row_number() OVER (PARTITION BY ranker, query_id ORDER BY first) AS doc_rank FROM (SELECT ranker, query_id, split_part(chunk_id, ':', 1) AS doc_id, min(rank) AS first FROM every GROUP BY 1, 2, 3)),
m AS ({' UNION ALL '.join(f"SELECT '{r}' AS ranker, * FROM (WITH one AS (SELECT * FROM ranked WHERE ranker = '{r}'), {METRICS.format(docs='one')} SELECT * FROM metrics)" for r in ('bm25', 'vector', 'rrf'))})
SELECT ranker, count(*) AS cases, CAST(sum(relevant) AS BIGINT) AS relevant, CAST(sum(found) AS BIGINT) AS found, CAST(sum(found_3k) AS BIGINT) AS found_3k, round(CASE WHEN sum(relevant) >= 20 THEN avg(recall) END, 6) AS recall, round(CASE WHEN sum(relevant) >= 20 THEN avg(ceiling) END, 6) AS ceiling,
  round(CASE WHEN sum(relevant) >= 20 THEN avg(ndcg) END, 6) AS ndcg, round(CASE WHEN sum(relevant) >= 20 THEN coalesce(avg(CASE WHEN ceiling > 0 THEN recall / ceiling END), 0) END, 6) AS share_of_ceiling FROM m GROUP BY 1""",
    "exclusion_audit": f"WITH {FULL} SELECT doc_id, count(*) AS dropped_chunks FROM idx WHERE doc_id IN (SELECT doc_id FROM excluded) GROUP BY 1",
    "graph_nodes": f"WITH {mentions()}, {NODES} SELECT node, n_mentions, n_chunks, name AS display_name, type AS node_type FROM nn JOIN nm USING (node) JOIN nt USING (node)",
    "graph_edges": f"WITH {mentions()} SELECT src, dst, weight, n_chunks, n_relations FROM edge",
    "graph_exclusion_delta": f"WITH f AS (WITH {mentions()} SELECT * FROM edge), k AS (WITH {mentions(WITHOUT)} SELECT * FROM edge) SELECT f.src, f.dst, f.weight AS full_weight, coalesce(k.weight, 0.0e0) AS run_weight FROM f LEFT JOIN k USING (src, dst) WHERE f.weight <> coalesce(k.weight, 0)",
    "lost_nodes": f"WITH {mentions()} SELECT node FROM cn GROUP BY 1 HAVING count(*) FILTER (split_part(chunk_id, ':', 1) NOT IN (SELECT pmcid FROM twins)) = 0",
    "node_spellings": f"""WITH {mentions()} SELECT node, 'variants' AS kind, name AS value, count(*) AS n FROM ments GROUP BY 1, 3 UNION ALL SELECT node, 'types', type, count(*) FROM ments GROUP BY 1, 3""",
    "edge_predicates": f"WITH {mentions()}, {PREDICATES} SELECT src, dst, predicate FROM preds",
    "build_stats": f"""WITH {mentions()} SELECT 'chunks' AS measure, count(*) AS value FROM best UNION ALL SELECT 'nodes', count(DISTINCT node) FROM ments UNION ALL SELECT 'edges', count(*) FROM edge
UNION ALL SELECT 'truncated_chunks', count(*) FROM (SELECT chunk_id FROM chunk_extractions WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(truncated, false)))""",
    "relation_lines": f"""WITH {mentions()}, {NODES}, {TOPS}, {PREDICATES}
SELECT a.community_id, p.src || ' -[' || coalesce(predicate, '') || ']- ' || p.dst AS line FROM preds p JOIN tops a ON a.node = p.src JOIN tops b ON b.node = p.dst AND a.community_id = b.community_id""",
    "top_members": f"WITH {mentions()}, {NODES}, {TOPS} SELECT community_id, size, rank, node, degree FROM tops",
    "graph_local_search": f"WITH {RUN}, {CASES}, {mentions(WITHOUT)}, {CANDIDATES}, {LOCAL} {TOP10}",
    "graph_global_search": f"WITH {RUN}, {CASES}, {mentions(WITHOUT)}, {NODES}, {TOPS}, {PLUS} {TOP10}",
    "ranked_reports": f"WITH {RUN}, {CASES}, {mentions(WITHOUT)}, {NODES}, {TOPS}, {PLUS} SELECT query_id, CAST(community_id AS BIGINT) AS community_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community_id) AS rank FROM best8",
    "largest_groups": f"WITH {mentions()}, {NODES}, {TOPS} SELECT community_id, count(*) AS size FROM asg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
    "cut_prompts": f"""WITH {FINDINGS} SELECT finding_id, 6 * (coalesce(len(regexp_extract_all(text, '[^{WS}]+')), 0) + coalesce(len(regexp_extract_all(quote, '[^{WS}]+')), 0)) < length(coalesce(text, '')) + length(coalesce(quote, '')) AS cut FROM finds""",
    "latest_documents": f"WITH {LATEST} SELECT pmcid, version, {LICENSE} AS license, {squeeze('title')} AS title, coalesce(len(authors), 0) AS n_authors FROM latest",
    "license_gate": f"SELECT pmcid, reason IS NULL AS accepted, reason FROM (SELECT pmcid, CASE WHEN l IS NULL THEN 'no licence' WHEN l NOT IN ('CC0', 'CC BY') THEN 'licence ' || l END AS reason FROM (SELECT DISTINCT pmcid, license_code, {LICENSE} AS l FROM corpus_docs))",
    "corpus_status": f"""WITH {LATEST}, {FIRST}
SELECT coalesce(m.pmcid, s.pmcid) AS doc_id, CASE WHEN s.pmcid IS NULL THEN 'missing' WHEN m.pmcid IS NULL THEN 'orphan' WHEN m.md5 IS NULL OR s.md5 IS NULL THEN 'unknown' WHEN m.md5 = s.md5 THEN 'ok' ELSE 'changed' END AS outcome
FROM latest m FULL JOIN (SELECT c.pmcid, f.md5 FROM chunked c LEFT JOIN firsts f USING (pmcid)) s ON m.pmcid = s.pmcid""",
    "sync_outcomes": f"WITH {LATEST}, {FIRST}, {SYNC} SELECT pmcid, outcome FROM outcomes",
    "outcome_counts": f"WITH {LATEST}, {FIRST}, {SYNC} SELECT outcome, count(*) AS documents FROM outcomes GROUP BY 1",
    "candidate_list": f"""WITH {FULL}, {LATEST}, {RELEVANT},
c AS (SELECT pmcid, min(class) AS class FROM (SELECT pmcid, 0 AS class FROM twins UNION ALL SELECT doc_id, 1 FROM near UNION ALL SELECT pmcid, 2 FROM latest WHERE {LICENSE} IN ('CC0', 'CC BY')) GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY class = 0 ORDER BY class, pmcid) AS nr FROM c)
SELECT pmcid, CAST(class AS BIGINT) AS class, class = 0 AS forced FROM n WHERE class = 0 OR nr <= 1000 - (SELECT count(*) FROM c WHERE class = 0)""",
    "upserted_documents": f"WITH {LATEST}, {FIRST} SELECT f.pmcid, CASE WHEN l.version > 1 THEN l.md5 ELSE f.md5 END AS md5 FROM firsts f JOIN latest l USING (pmcid)",
    "excluded_by_preprint": "SELECT preprint_doi, pmcid AS doc_id FROM twins",
    "query_cases": f"""WITH {FULL}, {LATEST}, au AS (SELECT DISTINCT pmcid, unnest(authors) AS author FROM latest), st AS (SELECT DISTINCT doc_id FROM idx),
own AS (SELECT preprint_doi, string_agg(DISTINCT pmcid, ',' ORDER BY pmcid) AS excluded FROM twins WHERE pmcid IN (SELECT doc_id FROM st) GROUP BY 1),
nr AS (SELECT DISTINCT t.preprint_doi, b.pmcid AS doc_id FROM twins t JOIN au a ON a.pmcid = t.pmcid JOIN au b ON a.author = b.author AND b.pmcid <> t.pmcid WHERE b.pmcid IN (SELECT doc_id FROM st) AND (t.preprint_doi, b.pmcid) NOT IN (SELECT (preprint_doi, pmcid) FROM twins)),
rl AS (SELECT preprint_doi, string_agg(doc_id, ',' ORDER BY doc_id) AS relevant FROM nr GROUP BY 1)
SELECT preprint_doi, t.title AS query, coalesce(relevant, '') AS relevant, excluded FROM (SELECT preprint_doi, arg_min(title, pmcid) AS title FROM twins GROUP BY 1) t JOIN own USING (preprint_doi) LEFT JOIN rl USING (preprint_doi)""",
    "attribution": f"""WITH {LATEST} SELECT pmcid, (CASE WHEN coalesce(array_to_string(authors[:3], ', '), '') = '' THEN 'Anonymous' ELSE array_to_string(authors[:3], ', ') END)
  || (CASE WHEN len(authors) > 3 THEN ' et al.' ELSE '' END) || '. ' || coalesce({squeeze('title')}, '') || '. ' || coalesce({LICENSE}, 'no licence') || '. ' || coalesce(source_url, '') AS line FROM latest""",
    "related_by_author": f"WITH {FULL}, {LATEST}, {RELEVANT} SELECT query_id, doc_id FROM near",
    "span_grounding": f"WITH {FULL}, {FINDINGS}, {GROUND} SELECT finding_id, named, known, grounded FROM gr",
    "finding_hygiene": f"""WITH {FULL}, {FINDINGS},
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, reviewer ORDER BY created_at, finding_id) AS place FROM finds WHERE regexp_matches(text, '[^{WS}]')),
e AS (SELECT finding_id, count(*) AS n FROM (SELECT DISTINCT finding_id, unnest(evidence_chunk_ids) AS chunk_id FROM k) JOIN idx USING (chunk_id) GROUP BY 1)
SELECT finding_id, coalesce(n, 0) AS n_evidence, coalesce(len(list_distinct(evidence_chunk_ids)), 0) - coalesce(n, 0) AS dropped_ids FROM k LEFT JOIN e USING (finding_id) WHERE place <= 8""",
    "score_conflicts": f"""WITH {FINDINGS}, s AS (SELECT run_id, dimension, reviewer, CASE lower(trim(severity)) WHEN 'minor' THEN 4 WHEN 'major' THEN 2 WHEN 'critical' THEN 1 END AS score FROM finds)
SELECT run_id, dimension, count(DISTINCT reviewer) + max(CASE WHEN reviewer IS NULL THEN 1 ELSE 0 END) AS reviewers, CAST(min(score) AS BIGINT) AS lowest, CAST(max(score) AS BIGINT) AS highest FROM s WHERE score IS NOT NULL
GROUP BY 1, 2 HAVING count(DISTINCT reviewer) + max(CASE WHEN reviewer IS NULL THEN 1 ELSE 0 END) >= 2 AND max(score) - min(score) >= 2""",
    "ledger_stats": f"""WITH {FINDINGS}, {CALLS} SELECT run_id, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(a) AS BIGINT) AS answer_tokens, max(p) AS largest_prompt, CAST(min(c) AS BIGINT) AS smallest_context,
  min(c - p) AS smallest_headroom, coalesce(string_agg(DISTINCT s, ',' ORDER BY s), '') AS sources FROM calls GROUP BY 1""",
    "budget_cut": f"""WITH {FINDINGS}, {CALLS}, w AS (SELECT run_id, finding_id, CAST(coalesce(sum(p) OVER (PARTITION BY run_id ORDER BY created_at, finding_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before,
  row_number() OVER (PARTITION BY run_id ORDER BY created_at, finding_id) AS nr FROM calls) SELECT run_id, finding_id, spent_before, nr FROM w WHERE spent_before < 4000 AND nr <= 12""",
    "grounded_rates": f"""WITH {FULL}, {FINDINGS}, {GROUND} SELECT reviewer AS source, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(CASE WHEN grounded > 0 THEN 1e0 ELSE 0 END) END, 6) AS rate, grouping(reviewer) = 1 AS overall
FROM gr WHERE named > 0 GROUP BY GROUPING SETS ((reviewer), ())""",
    "run_records": f"""WITH {FULL}, {FINDINGS}, {GROUND}, {CALLS},
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, reviewer ORDER BY created_at, finding_id) AS place FROM finds WHERE regexp_matches(text, '[^{WS}]')) WHERE place <= 8),
e AS (SELECT finding_id, count(*) AS n FROM (SELECT DISTINCT finding_id, unnest(evidence_chunk_ids) AS chunk_id FROM k) JOIN idx USING (chunk_id) GROUP BY 1),
h AS (SELECT run_id, count(*) AS findings, CAST(sum(coalesce(len(list_distinct(evidence_chunk_ids)), 0) - coalesce(n, 0)) AS BIGINT) AS dropped_ids FROM k LEFT JOIN e USING (finding_id) GROUP BY 1),
g AS (SELECT run_id, count(*) FILTER (grounded > 0) AS grounded FROM gr JOIN finds USING (finding_id) GROUP BY 1),
s AS (SELECT run_id, dimension, reviewer, CASE lower(trim(severity)) WHEN 'minor' THEN 4 WHEN 'major' THEN 2 WHEN 'critical' THEN 1 END AS score FROM finds),
t AS (SELECT run_id, count(*) AS conflicts FROM (SELECT run_id, dimension FROM s WHERE score IS NOT NULL GROUP BY 1, 2
      HAVING count(DISTINCT reviewer) + max(CASE WHEN reviewer IS NULL THEN 1 ELSE 0 END) >= 2 AND max(score) - min(score) >= 2) GROUP BY 1),
c AS (SELECT run_id, count(*) AS calls, CAST(sum(p) AS BIGINT) AS prompt_tokens, max(p) AS largest_prompt FROM calls GROUP BY 1)
SELECT run_id, coalesce(findings, 0) AS findings, coalesce(dropped_ids, 0) AS dropped_ids, coalesce(grounded, 0) AS grounded, coalesce(conflicts, 0) AS conflicts, calls, prompt_tokens, largest_prompt
FROM c LEFT JOIN h USING (run_id) LEFT JOIN g USING (run_id) LEFT JOIN t USING (run_id)""",
    "token_collisions": f"""WITH {FULL}, t AS (SELECT DISTINCT token FROM (SELECT trim(title) AS token FROM twins UNION ALL SELECT unnest(string_split(trim(title), ' ')) FROM twins) WHERE token <> '')
SELECT token, count(DISTINCT doc_id) AS documents FROM t LEFT JOIN idx ON contains(lower(text), lower(token)) GROUP BY 1""",
    "verdicts": f"""WITH {FULL}, {FINDINGS},
cl AS (SELECT finding_id AS claim_id, quote, evidence_chunk_ids AS ids FROM finds WHERE evidence_chunk_ids IS NOT NULL),
rk AS (SELECT claim_id, quote, i.chunk_id, list_position(ids, i.chunk_id) AS rank, coalesce({squeeze('quote')} <> '' AND contains({squeeze('i.text')}, {squeeze('quote')}), false) AS holds FROM (SELECT *, unnest(list_distinct(ids)) AS chunk_id FROM cl) e JOIN idx i USING (chunk_id)),
en AS (SELECT claim_id, arg_min(chunk_id, rank) AS c0, arg_min(holds, rank) AS h0, arg_max(chunk_id, rank) AS c1, arg_max(holds, rank) AS h1, min(rank) AS r0, max(rank) AS r1 FROM rk GROUP BY 1)
SELECT claim_id, CASE WHEN h0 AND h1 THEN 'SUPPORTS' ELSE 'NOT_ENOUGH_INFO' END AS verdict, CASE WHEN h0 AND h1 THEN CASE WHEN c0 = c1 THEN c0 ELSE c0 || ',' || c1 END ELSE '' END AS cited, len(ids) > 0 AS swapped, len(ids) = 0 OR coalesce(h0, false) = coalesce(h1, false) AS swap_consistent FROM cl LEFT JOIN en USING (claim_id)""",
    "pooled_findings": f"WITH {FINDINGS} SELECT dimension AS source, reviewer AS arm, text, count(DISTINCT run_id) AS samples FROM finds WHERE text IS NOT NULL GROUP BY 1, 2, 3",
    "citation_dois": rf"""WITH c AS (SELECT pmcid, lower(rtrim(regexp_extract(citation, '(?i)(?:\bdoi\s*[:=]\s*|https?://(?:dx\.)?doi\.org/)(\S+)', 1), '.,;:)]}}’"''')) AS cited,
  lower(regexp_replace({squeeze('doi')}, '(?i)^(https?://(dx\.)?doi\.org/|doi\s*[:=]?\s*)', '')) AS own FROM corpus_docs)
SELECT DISTINCT pmcid, nullif(cited, '') AS cited, o AS own, nullif(cited, '') = o AS same FROM (SELECT *, CASE WHEN regexp_matches(own, '^10\.\d{{4,9}}/\S+$') THEN own END AS o FROM c)""",
    "reference_checks": rf"""WITH r AS (SELECT DISTINCT author, pmcid, version, coalesce(doi, '') AS doi, coalesce({squeeze('title')}, '') AS title FROM (SELECT *, unnest(list_distinct(authors)) AS author FROM corpus_docs WHERE pmcid IS NOT NULL)),
n AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY pmcid, version NULLS FIRST, doi, title) AS nr FROM r),
l AS (SELECT author, nr + 2 AS line_no, regexp_extract_all(title || ' doi: ' || doi, '(?i)(?:https?://(?:dx\.)?doi\.org/|\bdoi\s*[:=]\s*)([^{WS}]+)', 1) AS ds FROM n),
d AS (SELECT author, line_no, generate_subscripts(ds, 1) AS pl, lower(rtrim(unnest(ds), '.,;:)]}}’"''')) AS doi FROM l),
k AS (SELECT *, regexp_matches(doi, '^10\.[0-9]{{4,9}}/[^{WS}]+$') AS good FROM d),
w AS (SELECT *, row_number() OVER (PARTITION BY author, doi ORDER BY line_no, pl) AS nr, first_value(line_no) OVER (PARTITION BY author, doi ORDER BY line_no, pl) AS f FROM k WHERE good)
SELECT author, line_no, 'reference_integrity' AS "check", 'minor' AS severity, doi || ': no valid DOI' AS detail FROM k WHERE NOT good
UNION ALL SELECT author, line_no, 'reference_integrity', 'minor', doi || ': listed before, in line ' || f FROM w WHERE nr > 1
UNION ALL SELECT author, 1, 'reference_integrity', 'major', 'cites number ' || (count(*) + 1) || ' of a list of ' || count(*) FROM n GROUP BY 1""",
    "event_windows": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
