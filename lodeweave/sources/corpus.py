"""The corpus table: licences, latest versions, candidates, twins, status against what is stored, attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeeze

ALLOWED = ("CC0", "CC BY")


def license_key(code: Column) -> Column:
    """Spellings of a licence under one key: upper case, no version, blanks for hyphens after CC."""
    plain = F.upper(squeeze(code))
    return F.regexp_replace(F.regexp_replace(plain, r"^CC[- ]", "CC "), r" \d(\.\d)?$", "")


def clean_doi(doi: Column) -> Column:
    """A DOI without resolver, prefix or blanks, lower case; null where it has no DOI form."""
    bare = F.lower(F.regexp_replace(squeeze(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi\s*[:=]?\s*)", ""))
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def fetch_date(text: Column) -> Column:
    """The date of a fetch in either form, whatever follows it."""
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "dd/MM/yyyy"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def latest_documents(docs: DataFrame) -> DataFrame:
    """One row per pmcid: the greatest version, then the latest date, whichever of the two forms it has."""
    date = fetch_date(F.col("fetched_at"))
    row = F.struct("pmcid", "corpus", "version", "md5", "license_code", squeeze(F.col("title")).alias("title"), "authors", clean_doi(F.col("doi")).alias("doi"), "citation", "source_url", "forced_include")
    order = F.struct("version", date.alias("date"), F.coalesce("md5", F.lit("")).alias("md5"), F.coalesce("license_code", F.lit("")).alias("l"))
    return docs.filter("pmcid IS NOT NULL").groupBy("pmcid").agg(F.max_by(row, order).alias("r")).select("r.*")


def refusal(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Why a document may not enter, null where it may: its licence, a retraction, no open access. The last two are
    judged where docs has the columns is_retracted and is_open_access; null counts as not retracted and as not open."""
    key = license_key(F.col("license_code"))
    why = F.when(key.isNull(), "no licence").when(~key.isin(*allowed), F.concat(F.lit("licence "), key))
    if "is_retracted" in docs.columns:
        why = why.when(F.coalesce("is_retracted", F.lit(False)), "retracted")
    if "is_open_access" in docs.columns:
        why = why.when(~F.coalesce("is_open_access", F.lit(False)), "no open access")
    return why


def gate(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """(pmcid, accepted, reason) by licence, retraction and open access; forced documents are told apart but not let through."""
    why = refusal(docs, allowed)
    return docs.select("pmcid", why.isNull().alias("accepted"), why.alias("reason"))


# What a document's sync can end in.
OUTCOMES = ("fetched", "cached", "md5_mismatch", "license_refused", "retracted_refused", "missing_upstream")


def sync(manifest: DataFrame, local: DataFrame, upstream: DataFrame) -> DataFrame:
    """(pmcid, outcome) of every document of a manifest (pmcid, md5): cached where the local copy (pmcid, md5) is the one pinned, else by
    what upstream (pmcid, md5, license_code, is_retracted, ...) has: nothing, a document that may not enter, another
    digest than pinned, or the document, which is then to be fetched."""
    why = refusal(upstream)
    known = upstream.select("pmcid", F.col("md5").alias("theirs"), why.alias("why"), F.lit(True).alias("there"))
    rows = manifest.select("pmcid", "md5").join(local.select("pmcid", F.col("md5").alias("ours")), "pmcid", "left").join(known, "pmcid", "left")
    outcome = F.when(F.col("ours") == F.col("md5"), "cached").when(F.col("there").isNull(), "missing_upstream").when(F.col("why") == "retracted", "retracted_refused").when(F.col("why").isNotNull(), "license_refused").when(F.col("theirs").eqNullSafe(F.col("md5")), "fetched").otherwise("md5_mismatch")
    return rows.select("pmcid", outcome.alias("outcome"))


def citation_candidates(seeds: DataFrame, links: DataFrame, topical: DataFrame) -> DataFrame:
    """(pmcid, class, forced): seeds (class 0, forced), then those one citation away either way from a seed (1; links are (citing, cited)),
    then topical finds (2); a document that is found several ways keeps the first."""
    seed = seeds.select("pmcid")
    hop = lambda near, far: links.join(seed.withColumnRenamed("pmcid", near), near, "left_semi").select(F.col(far).alias("pmcid"))
    every = seed.withColumn("class", F.lit(0)).unionByName(hop("citing", "cited").unionByName(hop("cited", "citing")).withColumn("class", F.lit(1))).unionByName(topical.select("pmcid", F.lit(2).alias("class")))
    return every.filter("pmcid is not null").groupBy("pmcid").agg(F.min("class").alias("class")).withColumn("forced", F.col("class") == 0)


def within_target(candidates: DataFrame, target: int) -> DataFrame:
    """(pmcid, class, forced) that a target lets in: all forced ones, and the others by class and pmcid until the target is full. The
    limit is the feature: only what it lets through is sorted."""
    room = max(0, target - candidates.filter("forced").count())
    return candidates.filter("forced").unionByName(candidates.filter("not forced").orderBy("class", "pmcid").limit(room))


def status(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, outcome) of a manifest (doc_id, md5) against what is stored (doc_id, md5): ok, changed, unknown
    (no digest on either side), missing, or orphan."""
    both = manifest.select("doc_id", F.col("md5").alias("want"), F.lit(True).alias("m")).join(stored.select("doc_id", F.col("md5").alias("have"), F.lit(True).alias("s")), "doc_id", "full")
    outcome = F.when(F.col("s").isNull(), "missing").when(F.col("m").isNull(), "orphan").when(F.col("want").isNull() | F.col("have").isNull(), "unknown").when(F.col("want") == F.col("have"), "ok").otherwise("changed")
    return both.select("doc_id", outcome.alias("outcome"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with rows put in place of those with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def excluded_documents(twins: DataFrame, preprints: DataFrame) -> DataFrame:
    """(preprint_doi, doc_id) that a run on these preprints must not see; a preprint without a twin raises when read."""
    got = preprints.select("preprint_doi").distinct().join(twins.select("preprint_doi", F.col("pmcid").alias("doc_id")), "preprint_doi", "left")
    return got.withColumn("doc_id", F.when(F.col("doc_id").isNull(), F.raise_error(F.concat(F.lit("no twin of "), F.col("preprint_doi")))).otherwise(F.col("doc_id")))


def attribution(docs: DataFrame) -> DataFrame:
    """(pmcid, line): the credit line of each document."""
    names = F.coalesce(F.array_join(F.slice("authors", 1, 3), ", "), F.lit(""))
    more = F.when(F.size("authors") > 3, F.lit(" et al.")).otherwise("")
    return docs.select("pmcid", F.concat(F.when(names == "", "Anonymous").otherwise(names), more, F.lit(". "), F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce(license_key(F.col("license_code")), F.lit("no licence")), F.lit(". "), F.coalesce("source_url", F.lit(""))).alias("line"))


def shared_authors(docs: DataFrame, of: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents that share an author with a query's document; of: (query_id, pmcid).

    Authors of the few query documents are joined to the corpus, so no author's documents meet each other.
    """
    each = docs.select("pmcid", F.explode(F.array_distinct("authors")).alias("author"))
    wanted = of.join(each, "pmcid").select("query_id", F.col("pmcid").alias("own"), "author")
    return each.join(wanted, "author").filter("pmcid <> own").select("query_id", F.col("pmcid").alias("doc_id")).distinct()
