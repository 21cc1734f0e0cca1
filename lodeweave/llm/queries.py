"""The queries of the training-data operators, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    from .similar import similar_vectors

    return similar_vectors(table(spark, folder, "index_vectors"), k=10, min_similarity=None)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from .similar import neighbour_pairs

    pairs = neighbour_pairs(p1_neighbours(spark, folder).filter("similarity >= 0.85"))
    return pairs.selectExpr("a AS chunk_id_a", "b AS chunk_id_b")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from .split import cut_paragraphs, split_oversized

    return cut_paragraphs(*split_oversized(table(spark, folder, "chunks"), limit=900, overlap=60), 900)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    from .split import split_oversized

    return split_oversized(table(spark, folder, "chunks"), limit=900, overlap=60)[0]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from .leak import leaked_passages

    found = leaked_passages(table(spark, folder, "chunks"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "text", window=12)
    return found.selectExpr("doc AS pmcid", "item AS item_id")


def _together(spark: SparkSession, folder: str, least: int) -> DataFrame:
    from pyspark.sql import functions as F

    from .together import together

    return together(table(spark, folder, "chunk_extractions"), "chunk_id", F.col("entities.name"), least=least)


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _together(spark, folder, 1).selectExpr("a", "b", "n_ab", "n_a", "n_b", "n", "round(lift, 6) AS lift", "round(llr, 4) AS llr")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Counts times N are compared as whole numbers, in decimals that can't overflow."""
    often = _together(spark, folder, 8).filter("CAST(n_ab AS DECIMAL(38,0)) * n >= CAST(10 AS DECIMAL(38,0)) * CAST(n_a AS DECIMAL(18,0)) * CAST(n_b AS DECIMAL(18,0))")
    return often.selectExpr("a AS entity_a", "b AS entity_b")


def _shared(spark: SparkSession, folder: str):
    from .spans import shared_stretches

    return shared_stretches(table(spark, folder, "review_findings"), "finding_id", ["text", "quote"], least=60)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import record_pairs

    return record_pairs(_shared(spark, folder)).selectExpr("a AS finding_a", "b AS finding_b")


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import span_classes

    return span_classes(_shared(spark, folder))[0]


def p5_members(spark: SparkSession, folder: str) -> DataFrame:
    """The fields of each class of equal strings in p5_spans; a class of several findings is a shared stretch, too."""
    from .spans import span_classes

    return span_classes(_shared(spark, folder))[1]


def p5_portions(spark: SparkSession, folder: str) -> DataFrame:
    from .spans import portions, short_fields

    return portions(_shared(spark, folder)).unionByName(short_fields(table(spark, folder, "review_findings"), "finding_id", ["text", "quote"], 60))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .encode import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from .mix import mix_sources

    _, report = mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))
    return report.filter("short").select("source")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    from .mix import mix_sources

    _, report = mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))
    return report


def p8_subjects(spark: SparkSession, folder: str) -> DataFrame:
    from .subjects import subject_areas

    return subject_areas(*(table(spark, folder, t) for t in ("documents", "subject_areas", "subject_labels")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    return p8_subjects(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.sum(F.col("words") * F.col("share")).alias("subject_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_pieces, p3_found, p4_found, p4_pairs, p5_found, p5_spans, p5_members, p5_portions, p6_ids, p7_found, p7_report, p8_found, p8_composition)}

# Unicode white space as a class of the SQL engine's regular expressions.
WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

ORACLES: dict[str, str] = {
    "p1_found": """WITH v AS (SELECT chunk_id, min(CAST(vector AS DOUBLE[])) AS v FROM index_vectors WHERE chunk_id IS NOT NULL AND len(vector) = 64 AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.v, b.v), 12) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
t AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS nr FROM s WHERE s >= 0.85) WHERE nr <= 10)
SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM t""",
    "p2_found": f"""WITH p AS (SELECT chunk_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS para_no FROM (
  SELECT DISTINCT chunk_id, list_filter(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n[{WS}]*\n'), lambda x: regexp_matches(x, '[^{WS}]')) AS ps FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL))
SELECT chunk_id, CAST(para_no AS INT) AS para_no FROM p WHERE len(regexp_extract_all(p, '[^{WS}]+')) > 900""",
    "p4_found": f"""WITH e AS (SELECT chunk_id, lower(trim(regexp_replace(x.name, '[{WS}]+', ' ', 'g'))) AS n FROM (SELECT chunk_id, unnest(entities) AS x FROM chunk_extractions)),
r AS (SELECT DISTINCT chunk_id, n FROM e WHERE n <> ''), c AS (SELECT n, count(*) AS k FROM r GROUP BY 1), t AS (SELECT count(DISTINCT chunk_id) AS total FROM r),
p AS (SELECT a.n AS entity_a, b.n AS entity_b, count(*) AS k FROM r a JOIN r b ON a.chunk_id = b.chunk_id AND a.n < b.n GROUP BY 1, 2 HAVING count(*) >= 8)
SELECT entity_a, entity_b FROM p JOIN c a ON a.n = entity_a JOIN c b ON b.n = entity_b, t WHERE p.k * total >= 10 * a.k * b.k""",
    "p4_pairs": f"""WITH e AS (SELECT chunk_id, lower(trim(regexp_replace(x.name, '[{WS}]+', ' ', 'g'))) AS n FROM (SELECT chunk_id, unnest(entities) AS x FROM chunk_extractions WHERE chunk_id IS NOT NULL)),
r AS (SELECT DISTINCT chunk_id, n FROM e WHERE n <> ''), c AS (SELECT n, count(*) AS k FROM r GROUP BY 1), t AS (SELECT count(DISTINCT chunk_id) AS n FROM r),
p AS (SELECT a.n AS a, b.n AS b, count(*) AS k FROM r a JOIN r b ON a.chunk_id = b.chunk_id AND a.n < b.n GROUP BY 1, 2),
x AS (SELECT a, b, p.k AS n_ab, ca.k AS n_a, cb.k AS n_b, t.n AS n, p.k * 1e0 AS o11, (ca.k - p.k) * 1e0 AS o12, (cb.k - p.k) * 1e0 AS o21, (t.n - ca.k - cb.k + p.k) * 1e0 AS o22 FROM p JOIN c ca ON ca.n = a JOIN c cb ON cb.n = b, t)
SELECT a, b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * 1e0 * n_b), 6) AS lift, round(2 * (o11 * ln(o11 * n / (n_a * 1e0 * n_b)) + CASE WHEN o12 > 0 THEN o12 * ln(o12 * n / (n_a * 1e0 * (n - n_b))) ELSE 0 END
  + CASE WHEN o21 > 0 THEN o21 * ln(o21 * n / ((n - n_a) * 1e0 * n_b)) ELSE 0 END + CASE WHEN o22 > 0 THEN o22 * ln(o22 * n / ((n - n_a) * 1e0 * (n - n_b))) ELSE 0 END), 4) AS llr FROM x""",
    "p5_portions": """WITH f AS (SELECT DISTINCT * FROM (SELECT finding_id AS id, 'text' AS field, text AS s FROM review_findings UNION ALL SELECT finding_id, 'quote', quote FROM review_findings) WHERE id IS NOT NULL AND s IS NOT NULL),
q AS (SELECT id, field, i, substr(s, i + 1, 60) AS g FROM (SELECT id, field, s, unnest(range(0, length(s) - 59)) AS i FROM f WHERE length(s) >= 60)),
y AS (SELECT id, field, i FROM q WHERE g IN (SELECT g FROM q GROUP BY 1 HAVING count(DISTINCT id) > 1)),
c AS (SELECT id, field, sum(least(60, coalesce(after - i, 60))) AS shared FROM (SELECT *, lead(i) OVER (PARTITION BY id, field ORDER BY i) AS after FROM y) GROUP BY 1, 2)
SELECT id, field, CAST(length(s) AS INT) AS length, CAST(coalesce(shared, 0) AS INT) AS shared FROM f LEFT JOIN c USING (id, field)""",
    "p5_found": """WITH f AS (SELECT DISTINCT finding_id AS id, s FROM (SELECT finding_id, text AS s FROM review_findings UNION ALL SELECT finding_id, quote FROM review_findings) WHERE length(s) >= 60 AND finding_id IS NOT NULL),
q AS (SELECT DISTINCT id, substr(s, i + 1, 60) AS g FROM (SELECT id, s, unnest(range(0, length(s) - 59)) AS i FROM f)),
y AS (SELECT * FROM q WHERE g IN (SELECT g FROM q GROUP BY 1 HAVING count(*) > 1))
SELECT DISTINCT a.id AS finding_a, b.id AS finding_b FROM y a JOIN y b USING (g) WHERE a.id < b.id""",
}
