"""The weighted entity graph: hygiene, mentions, nodes, edges, exclusion before aggregation, degrees, expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_of, node_key, squeeze

# The types an entity may have.
ENTITY_TYPES = ("gene_or_protein", "chemical", "organism", "method_or_tool", "process_or_phenotype", "other")
CO_MENTION, RELATION = 0.25, 1.0


def best_extractions(records: DataFrame) -> DataFrame:
    """One row per chunk_id: the complete before the truncated, then most entities, then the latest."""
    rank = F.struct((~F.coalesce("truncated", F.lit(False))).alias("whole"), F.coalesce(F.size("entities"), F.lit(0)).alias("n"), "recorded_at")
    row = F.struct("entities", "relations", F.coalesce("truncated", F.lit(False)).alias("truncated"))
    return records.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max_by(row, rank).alias("r")).select("chunk_id", "r.*")


def hygiene(extractions: DataFrame) -> DataFrame:
    """Entities with a name and a known type, names squeezed; relations between entities of the same chunk, no self relations."""
    named = F.filter("entities", lambda e: (F.coalesce(squeeze(e["name"]), F.lit("")) != "") & e["type"].isin(*ENTITY_TYPES))
    clean = extractions.withColumn("entities", F.coalesce(F.transform(named, lambda e: F.struct(squeeze(e["name"]).alias("name"), e["type"].alias("type"))), F.array().cast("array<struct<name:string,type:string>>")))
    keys = F.transform("entities", lambda e: F.lower(e["name"]))

    def sound(r: Column) -> Column:
        return F.array_contains(keys, node_key(r["source"])) & F.array_contains(keys, node_key(r["target"]))

    return clean.withColumn("relations", F.coalesce(F.filter("relations", sound), F.array().cast(extractions.schema["relations"].dataType)))


def without_documents(rows: DataFrame, excluded: DataFrame, doc: Column | None = None) -> DataFrame:
    """Rows of documents that aren't excluded; excluded has one column, doc_id. Done before anything is aggregated."""
    key = doc if doc is not None else doc_of(F.col("chunk_id"))
    return rows.withColumn("_doc", key).join(excluded.select(F.col("doc_id").alias("_doc")).distinct(), "_doc", "left_anti").drop("_doc")


def mentions(extractions: DataFrame) -> DataFrame:
    """(chunk_id, node, name, type), one row per named entity of a clean extraction, repeats included."""
    return extractions.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", F.lower("e.name").alias("node"), "e.name", "e.type")


def relations(extractions: DataFrame) -> DataFrame:
    """(chunk_id, src, dst, predicate) with src < dst; self relations dropped."""
    flat = extractions.select("chunk_id", F.explode("relations").alias("r")).select("chunk_id", node_key(F.col("r.source")).alias("a"), node_key(F.col("r.target")).alias("b"), "r.predicate")
    return flat.filter("a <> b").select("chunk_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "predicate")


def nodes(mentioned: DataFrame) -> DataFrame:
    """(node, n_mentions, n_chunks, display_name, node_type): names and types by count, then by name.

    Spellings and types are counted first, so no list of a hot node's mentions is ever held together.
    """
    def mode(column: str) -> DataFrame:
        counts = mentioned.groupBy("node", column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("node").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column), F.sum("n").alias("n"))

    chunks = mentioned.select("node", "chunk_id").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = mode("name").withColumnsRenamed({"name": "display_name", "n": "n_mentions"}).join(mode("type").select("node", F.col("type").alias("node_type")), "node").join(chunks, "node")
    return out.select("node", "n_mentions", "n_chunks", "display_name", "node_type")


def node_variants(mentioned: DataFrame) -> DataFrame:
    """(node, variants map<string,long>, types map<string,long>)."""
    def counter(column: str, alias: str) -> DataFrame:
        counts = mentioned.groupBy("node", column).agg(F.count(F.lit(1)).alias("n"))
        return counts.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(alias))

    return counter("name", "variants").join(counter("type", "types"), "node")


def edges(mentioned: DataFrame, related: DataFrame) -> DataFrame:
    """(src, dst, weight, n_chunks, n_relations), src < dst: a quarter per chunk naming both, one per relation."""
    inside = mentioned.groupBy("chunk_id").agg(F.array_sort(F.collect_set("node")).alias("ns"))
    later = F.transform("ns", lambda a, i: F.transform(F.slice("ns", i + 2, F.size("ns")), lambda b: F.struct(a.alias("src"), b.alias("dst"))))
    pairs = inside.select(F.explode(F.flatten(later)).alias("p")).select("p.*", F.lit(1).alias("c"), F.lit(0).alias("r"))
    both = pairs.unionByName(related.select("src", "dst", F.lit(0).alias("c"), F.lit(1).alias("r")))
    sums = both.groupBy("src", "dst").agg(F.sum("c").alias("n_chunks"), F.sum("r").alias("n_relations"))
    return sums.select("src", "dst", (F.col("n_chunks") * CO_MENTION + F.col("n_relations") * RELATION).alias("weight"), "n_chunks", "n_relations")


def edge_predicates(related: DataFrame) -> DataFrame:
    """(src, dst, predicate): the most frequent predicate, then the first by name."""
    counts = related.groupBy("src", "dst", "predicate").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("src", "dst").agg(F.min_by("predicate", F.struct(-F.col("n"), F.col("predicate"))).alias("predicate"))


def both_ways(edge: DataFrame) -> DataFrame:
    """(node, other, weight): every edge from either end."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))
    return edge.select(ends.alias("e"), "weight").select("e.*", "weight")


def degrees(edge: DataFrame) -> DataFrame:
    return both_ways(edge).groupBy("node").agg(F.sum("weight").alias("degree"))


def top_members(assignment: DataFrame, edge: DataFrame, *, top: int = 30, least: int = 3) -> DataFrame:
    """(community_id, size, rank, node, degree): the heaviest members of communities of at least `least` nodes."""
    size = assignment.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    member = assignment.join(degrees(edge), "node", "left").fillna(0.0, ["degree"]).join(size, "community_id")
    rank = F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc("degree"), "node"))
    return member.withColumn("rank", rank).filter(F.col("rank") <= top).select("community_id", "size", "rank", "node", "degree")


def relation_lines(tops: DataFrame, edge: DataFrame, related: DataFrame) -> DataFrame:
    """(community_id, lines): "a -[predicate]- b" for related pairs whose ends are both among a community's top members."""
    t = tops.select("community_id", "node")
    e = edge.filter("n_relations > 0").join(edge_predicates(related), ["src", "dst"])
    inside = e.join(t.withColumnRenamed("node", "src"), "src").join(t.withColumnRenamed("node", "dst"), ["dst", "community_id"])
    return inside.groupBy("community_id").agg(F.array_sort(F.collect_list(F.format_string("%s -[%s]- %s", "src", F.coalesce("predicate", F.lit("")), "dst"))).alias("lines"))


def live_nodes(mentioned: DataFrame, excluded: DataFrame) -> DataFrame:
    """(node) with evidence in some document that isn't excluded."""
    return without_documents(mentioned.select("chunk_id", "node").distinct(), excluded).select("node").distinct()


def graph_stats(mentioned: DataFrame, edge: DataFrame) -> DataFrame:
    """One row: the numbers of nodes and edges."""
    return mentioned.agg(F.count_distinct("node").alias("nodes")).crossJoin(edge.agg(F.count(F.lit(1)).alias("edges")))


def build_stats(extractions: DataFrame, mentioned: DataFrame, edge: DataFrame, assignments: dict[float, DataFrame] | None = None) -> DataFrame:
    """(measure, resolution, value) of a build: chunks, truncated chunks, nodes, edges, and communities at each resolution."""
    def rows(df: DataFrame, resolution: float | None = None) -> DataFrame:
        return df.unpivot([], df.columns, "measure", "value").select("measure", F.lit(resolution).cast("double").alias("resolution"), F.col("value").cast("long").alias("value"))

    out = rows(extractions.agg(F.count(F.lit(1)).alias("chunks"), F.count_if("truncated").alias("truncated_chunks"))).unionByName(rows(graph_stats(mentioned, edge)))
    for r, a in (assignments or {}).items():
        out = out.unionByName(rows(a.agg(F.count_distinct("community_id").alias("communities")), r))
    return out


def largest_communities(assignment: DataFrame, most: int = 3) -> DataFrame:
    """(community_id, size) of the largest communities, ties by the smaller id."""
    return assignment.groupBy("community_id").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community_id").limit(most)
