"""Schemas of the tables, as DDL."""

CORPUS_DOC = "pmcid string, version int, md5 string, license_code string, title string, authors array<string>, doi string, citation string, source_url string, fetched_at string, forced_include boolean"
MANIFEST = f"name string, docs array<struct<{', '.join(f.replace(' ', ': ', 1) for f in CORPUS_DOC.split(', '))}>>"
TWIN = "preprint_doi string, preprint_version int, published_doi string, pmcid string, title string"
CHUNK = "chunk_id string, doc_id string, index int, text string"
EXTRACTION = "chunk_id string, entities array<struct<name:string,type:string>>, relations array<struct<source:string,predicate:string,target:string>>, truncated boolean"
REPORT = "community_id int, resolution double, size int, member_names array<string>, title string, summary string, truncated boolean"
EDGE = "src string, dst string, weight double, n_chunks bigint, n_relations bigint"
FINDING = "dimension string, severity string, text string, quote string, evidence_chunk_ids array<string>"
