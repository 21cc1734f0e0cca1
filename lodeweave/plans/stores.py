"""Queries that write the given tables in the formats of sources.files, read them back, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, providers
from ..session import stage_path
from ..sources import corpus, files
from .catalog import _findings, _graph, _index, table
from .oracles import FINDINGS, FULL, LATEST, NODES, WS, mentions, squeeze

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def manifest_documents(spark, folder):
    """Every row of the corpus table through a manifest."""
    path = stage_path(spark, "manifest")
    files.write_manifest(table(spark, folder, "corpus_docs"), path, "given")
    docs = files.read_manifest_lines(spark, path)
    return docs.select("corpus", "pmcid", "version", "md5", "license_code", "title", F.array_join("authors", "|").alias("authors"), "doi", "fetched_at", "forced_include")


def _stored_vectors(spark, folder):
    path = stage_path(spark, "store")
    files.save_vectors(table(spark, folder, "index_vectors"), path, "given")
    return files.load_vectors(spark, path)


@query
def stored_vectors(spark, folder):
    """Every vector through a store whose digest is checked."""
    return _stored_vectors(spark, folder).select("chunk_id", F.size("vector").cast("long").alias("dims"), F.get("vector", F.lit(0)).alias("first"), F.try_element_at("vector", F.lit(-1)).alias("last"))


@query
def store_gaps(spark, folder):
    """Ids that only the chunks have, or only the store."""
    return files.fresh(table(spark, folder, "chunks"), _stored_vectors(spark, folder))


@query
def stored_graph(spark, folder):
    """The nodes of the stored graph with the number and weight of their edges."""
    m, _, edge = _graph(spark, folder)
    path = stage_path(spark, "graph")
    files.save_graph(graph.nodes(m), edge, path)
    nodes, edges = files.load_graph(spark, path)
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weight"))
    return nodes.join(ends, "node", "left").select("node", "node_type", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("weight", F.lit(0.0)).alias("weight"))


@query
def recorded_answers(spark, folder):
    """The prompt of every chunk, its key, and whether a complete extraction of a chunk with the same text is on record."""
    asked = providers.prompts(_index(spark, folder).select("chunk_id", F.lit("Extract the entities.").alias("system"), F.col("text").alias("user")), "given", 1024)
    whole = table(spark, folder, "chunk_extractions").filter(~F.coalesce("truncated", F.lit(False))).select("chunk_id").distinct()
    answered, missing = files.cached(asked, asked.join(whole, "chunk_id", "left_semi").select("key"))
    rows = answered.withColumn("recorded", F.lit(True)).unionByName(missing.withColumn("recorded", F.lit(False)))
    return rows.select("chunk_id", "key", F.col("tokens_bound").cast("long"), "recorded")


@query
def manuscript_parts(spark, folder):
    """Every text of a corpus document as a manuscript under a header, and the parts it is read into."""
    docs = corpus.latest_documents(table(spark, folder, "corpus_docs")).select("pmcid", F.coalesce("title", F.lit("")).alias("title"))
    rows = table(spark, folder, "documents").filter("text is not null").select("doc_id", "pmcid", "text").join(docs, "pmcid")
    header = F.create_map(F.lit("Title"), F.col("title"), F.lit("PMCID"), F.col("pmcid"))
    parts = files.parse_manuscripts(rows.select("doc_id", files.render_manuscript(header, F.col("text")).alias("text")), ("Title", "PMCID"))
    return parts.select("doc_id", F.col("header")["Title"].alias("title"), F.col("header")["PMCID"].alias("pmcid"), F.md5("body").alias("body_md5"))


#: What no XML document may hold.
NOT_XML = "\x00-\x08\x0b\x0c\x0e-\x1f￾￿"


def _xml(text):
    out = F.regexp_replace(text, f"[{NOT_XML}]", "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


@query
def article_bodies(spark, folder):
    """Every text of documents as the body of an article, with a figure behind each paragraph, and the text that is read from it."""
    blocks = F.transform(F.split(_xml(F.col("text")), "\n\n+"), lambda p: F.concat(F.lit("<p>"), p, F.lit("<xref>*</xref></p><fig><caption><p>left out</p></caption></fig>")))
    body = F.concat(F.lit("<article><body><sec><title>Text</title>"), F.array_join(blocks, ""), F.lit("</sec></body></article>"))
    articles = table(spark, folder, "documents").filter("text is not null").select("doc_id", body.alias("xml"))
    return files.parse_articles(articles).select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("text_md5"))


@query
def article_fronts(spark, folder):
    """Title and authors of every row of the corpus table as the front of an article, and what is read from it."""
    person = F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit('<contrib contrib-type="author"><name><surname>'), _xml(a), F.lit("</surname></name></contrib>")))
    front = F.concat(F.lit("<article><front><article-title>"), _xml(F.coalesce("title", F.lit(""))), F.lit("</article-title>"), F.array_join(person, ""), F.lit("</front></article>"))
    articles = table(spark, folder, "corpus_docs").select("pmcid", front.alias("xml"))
    return files.parse_articles(articles, "pmcid").select("pmcid", "title", F.array_join("authors", "|").alias("authors"))


@query
def answer_objects(spark, folder):
    """The severity in the answer of every finding: a JSON object where it has one, else prose, which is no object."""
    answer = F.when(F.col("severity").isNotNull(), F.to_json(F.struct("finding_id", "severity", "text", "quote"))).otherwise(F.concat(F.lit("I think: "), F.coalesce("text", F.lit(""))))
    rows = _findings(spark, folder).select("finding_id", tx.parse_object(answer).alias("o"))
    return rows.select("finding_id", F.col("o").isNotNull().alias("object"), F.try_variant_get("o", "$.severity", "string").alias("severity"))


@query
def word_prefixes(spark, folder):
    """The first sixty words of every chunk."""
    return _index(spark, folder).select("chunk_id", F.md5(tx.first_words(F.col("text"), 60, " ...")).alias("prefix_md5"))


PLAIN = "regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]', '', 'g')"
PROMPT = "'given' || chr(31) || 'Extract the entities.' || chr(31) || text || chr(31) || '1024'"
ORACLES = {
    "manifest_documents": "SELECT 'given' AS corpus, pmcid, version, md5, license_code, title, array_to_string(authors, '|') AS authors, doi, fetched_at, forced_include FROM corpus_docs",
    "stored_vectors": "SELECT chunk_id, CAST(len(vector) AS BIGINT) AS dims, vector[1] AS first, vector[-1] AS last FROM index_vectors",
    "store_gaps": """SELECT coalesce(c.chunk_id, v.chunk_id) AS chunk_id, CASE WHEN v.s IS NULL THEN 'store' ELSE 'chunks' END AS missing FROM (SELECT DISTINCT chunk_id, 1 AS c FROM chunks) c
        FULL JOIN (SELECT DISTINCT chunk_id, 1 AS s FROM index_vectors) v ON c.chunk_id = v.chunk_id WHERE c.c IS NULL OR v.s IS NULL""",
    "stored_graph": f"""WITH {mentions()}, {NODES}, e AS (SELECT node, count(*) AS degree, sum(weight) AS weight FROM (SELECT src AS node, weight FROM edge UNION ALL SELECT dst, weight FROM edge) GROUP BY 1)
        SELECT node, type AS node_type, coalesce(degree, 0) AS degree, coalesce(weight, 0e0) AS weight FROM nt LEFT JOIN e USING (node)""",
    "recorded_answers": f"""WITH {FULL}, asked AS (SELECT chunk_id, substr(sha256({PROMPT}), 1, 24) AS key, CAST(floor((21 + length(text)) / 1.5e0) AS BIGINT) + 256 + 1024 + 1 AS tokens_bound FROM idx),
        known AS (SELECT DISTINCT key FROM asked WHERE chunk_id IN (SELECT chunk_id FROM chunk_extractions WHERE NOT coalesce(truncated, false)))
        SELECT chunk_id, key, tokens_bound, key IN (SELECT key FROM known) AS recorded FROM asked""",
    "manuscript_parts": f"WITH {LATEST} SELECT doc_id, coalesce({squeeze('l.title')}, '') AS title, pmcid, md5(text) AS body_md5 FROM documents JOIN latest l USING (pmcid) WHERE text IS NOT NULL",
    "article_bodies": f"""WITH b AS (SELECT doc_id, 'Text' || array_to_string(list_transform(string_split_regex({PLAIN}, '\\n\\n+'), lambda p: chr(10) || chr(10) || {squeeze("p || '*'")}), '') AS body
        FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(body) AS chars, md5(body) AS text_md5 FROM b""",
    "article_fronts": f"""SELECT pmcid, {squeeze("coalesce(title, '')")} AS title,
        array_to_string(list_filter(list_transform(coalesce(authors, []), lambda a: regexp_replace(a, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda a: a <> ''), '|') AS authors FROM corpus_docs""",
    "answer_objects": f"WITH {FINDINGS} SELECT finding_id, severity IS NOT NULL AS object, severity FROM finds",
    "word_prefixes": f"""WITH {FULL}, w AS (SELECT chunk_id, text, regexp_extract_all(text, '[^{WS}]+') AS ws FROM idx)
        SELECT chunk_id, md5(CASE WHEN len(ws) <= 60 THEN text ELSE array_to_string(ws[1:60], ' ') || ' ...' END) AS prefix_md5 FROM w""",
}
