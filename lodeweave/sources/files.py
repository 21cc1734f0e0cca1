"""Files in and out: manifests, whole-text corpora, manuscripts with a header, article XML, stores of vectors, caches, graphs."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

# Subtrees of an article's body that hold no running text.
STRIPPED = {
    "disp-formula", "disp-formula-group", "fig", "fig-group", "graphic", "inline-supplementary-material", "media", "ref-list",
    "supplementary-material", "table-wrap", "table-wrap-foot", "table-wrap-group",
}
HEADER_END = "---"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the JSON manifests under path, one object each, with the manifest's name as `corpus`."""
    raw = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    return raw.select(F.col("name").alias("corpus"), F.explode("docs").alias("d")).select("corpus", "d.*")


def write_manifest(docs: DataFrame, path: str, name: str) -> None:
    """JSON lines, one document each, in order of pmcid over the files; name is the manifest's. Any number of documents is written by as many tasks."""
    kept = docs.select(F.lit(name).alias("corpus"), *[f.split()[0] for f in schemas.CORPUS_DOC.split(", ")])
    kept.orderBy("pmcid").write.mode("overwrite").json(path)


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """The documents that write_manifest wrote, with the manifest's name as `corpus`."""
    return spark.read.schema("corpus string, " + schemas.CORPUS_DOC).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the text files under path; the file name without ending is the id."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_name"))
    return raw.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("doc_id"), F.col("value").alias("text"))


def read_complete(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """The texts of a manifest's documents; raises when one has no file."""
    texts = read_texts(spark, path)
    gone = manifest.select(F.col("pmcid").alias("doc_id")).join(texts.select("doc_id"), "doc_id", "left_anti").limit(5).collect()
    if gone:
        raise FileNotFoundError("documents of the manifest without a text: " + ", ".join(r[0] for r in gone))
    return texts.join(manifest.select(F.col("pmcid").alias("doc_id")), "doc_id", "left_semi")


def parse_manuscripts(texts: DataFrame, required: tuple[str, ...] = ("Title", "DOI")) -> DataFrame:
    """(doc_id, header map<string,string>, body) of texts that begin with `# Key: value` lines, closed by a line of dashes.

    The body is kept to the byte. A text without the closing line or a required key raises when it is read.
    """
    cut = F.split("text", rf"(?m)^{HEADER_END}\n", 2)
    rows = F.filter(F.split(F.get(cut, F.lit(0)), "\n"), lambda x: x.startswith("# "))
    pairs = F.transform(rows, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^# ([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^# [^:]+:(.*)$", 1)).alias("v")))
    header = F.map_from_entries(pairs)
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys("header"))
    checked = F.when(F.size(cut) < 2, F.raise_error(F.concat(F.lit("no header in "), F.col("doc_id")))).otherwise(header)
    out = texts.select("doc_id", checked.alias("header"), F.get(cut, F.lit(1)).alias("body"))
    return out.withColumn("header", F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("header lacks "), F.array_join(missing, ", "), F.lit(" in "), F.col("doc_id")))).otherwise(F.col("header")))


def render_manuscript(header: Column, body: Column) -> Column:
    """The text of a header (map, keys in order) and a body; parse_manuscripts reads it back."""
    rows = F.transform(F.array_sort(F.map_entries(header)), lambda e: F.concat(F.lit("# "), e["key"], F.lit(": "), e["value"]))
    return F.concat(F.array_join(rows, "\n"), F.lit(f"\n{HEADER_END}\n"), body)


def _name(node: ET.Element) -> str:
    """The tag without its name space; empty for comments and instructions."""
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _plain(node: ET.Element) -> str:
    """All text under a node but for stripped subtrees, white space squeezed."""
    def inside(x: ET.Element):
        yield x.text or ""
        for child in x:
            if _name(child) not in STRIPPED | {""}:
                yield from inside(child)
            yield child.tail or ""

    return " ".join("".join(inside(node)).split())


def _blocks(node: ET.Element) -> list[str]:
    """Paragraphs in order: sections and lists are opened, every other block is one."""
    out = []
    for child in node:
        name = _name(child)
        if name == "sec":
            out += _blocks(child)
        elif name == "list":
            out += [_plain(x) for x in child if _name(x) == "list-item"]
        elif name not in STRIPPED | {""}:
            out.append(_plain(child))
    return [x for x in out if x]


def article_text(xml: str | None) -> tuple[str | None, list[str], str | None]:
    """(title, authors, body with blank lines between blocks) of a JATS article; nulls where it can't be parsed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return None, [], None
    title = root.find(".//article-title")
    names = []
    for c in root.findall(".//contrib[@contrib-type='author']"):
        name = " ".join(x.strip() for x in (c.findtext(".//surname"), c.findtext(".//given-names")) if x and x.strip())
        if name:
            names.append(name)
    body = root.find(".//body")
    return (_plain(title) if title is not None else None), names, "\n\n".join(_blocks(body)) if body is not None else None


def parse_articles(articles: DataFrame, id_col: str = "doc_id", xml_col: str = "xml") -> DataFrame:
    """(id, title, authors, text) of article XML."""
    @F.arrow_udf("struct<title:string,authors:array<string>,text:string>")
    def parsed(xml: pa.Array) -> pa.Array:
        got = [article_text(x) for x in xml.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())), pa.array([g[2] for g in got], pa.string())], ["title", "authors", "text"])

    return articles.select(id_col, parsed(xml_col).alias("a")).select(id_col, "a.*")


def vector_digest(vectors: DataFrame) -> DataFrame:
    """One row (n, digest) that changes with any id or number: a sum of row hashes, in no order."""
    row = F.xxhash64("chunk_id", F.col("vector").cast("array<float>"))
    return vectors.agg(F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"))


def save_vectors(vectors: DataFrame, path: str, provider: str) -> None:
    """Vectors as float arrays, and beside them a manifest with their number, digest and provider."""
    vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    stored = vectors.sparkSession.read.parquet(f"{path}/vectors")
    vector_digest(stored).withColumn("provider", F.lit(provider)).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The stored vectors; raises when they don't have the manifest's digest."""
    stored = spark.read.parquet(f"{path}/vectors")
    want = spark.read.schema("n long, digest string, provider string").json(f"{path}/manifest").first()
    have = vector_digest(stored).first()
    if want is None or (have.n, have.digest) != (want.n, want.digest):
        raise ValueError(f"vectors in {path} differ from their manifest")
    return stored


def fresh(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """(chunk_id, missing) of ids that only one side has; none means the store fits the chunks."""
    a, b = chunks.select("chunk_id").distinct().withColumn("c", F.lit(1)), stored.select("chunk_id").distinct().withColumn("s", F.lit(1))
    return a.join(b, "chunk_id", "full").filter("c IS NULL OR s IS NULL").select("chunk_id", F.when(F.col("s").isNull(), "store").otherwise("chunks").alias("missing"))


def content_key(*parts: Column, digits: int = 24) -> Column:
    """Key of a cached answer: the first hex digits of the hash of what it was asked with."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, digits)


def cached(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(answered, missing) of requests with a key column."""
    once = cache.dropDuplicates([key])
    return asked.join(once, key), asked.join(once.select(key), key, "left_anti")


def replay(asked: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The recorded answers; a request without one raises when it is read."""
    got = asked.join(cache.dropDuplicates([key]).withColumn("_hit", F.lit(True)), key, "left")
    return got.withColumn(key, F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("nothing recorded for "), F.col(key)))).otherwise(F.col(key))).drop("_hit")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def read_corpus(spark: SparkSession, name: str, corpora: dict[str, tuple[str, str]]) -> DataFrame:
    """The texts of a named corpus, every document of its manifest; corpora: name to (manifest path, texts path). An unknown name raises."""
    if name not in corpora:
        raise ValueError(f"unknown corpus {name!r}, known: {', '.join(sorted(corpora))}")
    manifest, texts = corpora[name]
    return read_complete(spark, read_manifest(spark, manifest), texts)


def write_collisions(collisions: DataFrame, path: str) -> None:
    """Token collisions as JSON lines, in order of token over the files."""
    collisions.orderBy("token").write.mode("overwrite").json(path)
