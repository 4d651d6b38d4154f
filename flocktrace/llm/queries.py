"""The registered queries of this package, each with production parameters over its whole table."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cotrain, jaccard, mixing, oph, repeats, rollups, rules, token_store, url_alias
from .common import dropped, new_dir, staged, table


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    path = tokenizer_file("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents", ["doc_id", "text"]), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


#: Host, path and action of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    known = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_alias.judge(table(spark, sf_dir, "pages", ["page_id", "url", "html"]), known)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of strings of 100 bytes that start earlier too."""
    spanned = repeats.spans(table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return repeats.without(spanned).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches over all documents.

    load: every document, by words and by bytes; toxic: documents that labels call toxic go; recount: words of French
    documents are counted anew, with hyphens between words; toxic is then committed once more and changes nothing.
    """
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"])
    n_words = lambda blank: F.size(F.filter(F.split(F.coalesce("text", F.lit("")), blank), lambda w: w != ""))
    words = n_words(r"[\x20\x09-\x0D]+")
    toxic = table(spark, sf_dir, "labels", ["doc_id", "toxic"]).where("toxic = 1").select("doc_id").distinct()
    # each text is read once and stays where it is: joins see counts only
    counts = staged(docs.select("doc_id", "source", "lang", words.alias("words"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"), F.when(F.col("lang") == "fr", n_words(r"[\x20\x09-\x0D\-]+")).alias("parts")), "counts")
    root = new_dir(spark, "rollups")
    none = F.lit(None).cast("long")
    by = {"words-1": F.col("words"), "bytes-1": F.col("bytes")}
    rollups.commit(root, "load", rollups.counted(counts, by).withColumns({"before": none, "after": F.col("tokens")}))
    gone = rollups.counted(counts.join(toxic, "doc_id", "left_semi"), by).withColumns({"before": F.col("tokens"), "after": none})
    rollups.commit(root, "toxic", gone)
    left = counts.where("lang = 'fr'").join(toxic, "doc_id", "left_anti")
    recounted = left.select("source", "lang", F.lit("words-1").alias("version"), F.col("words").alias("before"), F.col("parts").alias("after"))
    rollups.commit(root, "recount", recounted)
    rollups.commit(root, "toxic", gone)
    dropped(counts)
    return rollups.totals(spark, root)


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's ids in a store that was written and read back."""
    path = token_store.new_store(spark)
    token_store.write(table(spark, sf_dir, "documents", ["doc_id", "text"]), path, tokenizer_file("word_bpe_49k.json"), end_id=1)
    return token_store.read_checks(spark, path)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document at 85 % of 4-word shingles."""
    return jaccard.join(table(spark, sf_dir, "documents", ["doc_id", "text"]), shingle=4, percent=85)


def op8_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated quality of every document by its text, its metadata and both."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return cotrain.score(docs, cotrain.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and to the next document's."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    led = oph.with_next(oph.with_fingerprint(docs), {"text": "next_text", "fingerprint": "next_fingerprint"}, size=F.octet_length("text"), tie=F.xxhash64("text"))
    changed = led.withColumn("edited", oph.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    both = oph.with_fingerprint(changed, "edited", "edited_fingerprint")
    return both.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        oph.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        oph.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether the base rules and the learned list keep it."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = rules.judged(docs, rules.fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))
    return found.select("doc_id", *(F.col("stats")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_url_alias": op1_url_alias,
    "op2_mix": op2_mix,
    "op3_repeats": op3_repeats,
    "op4_token_rollups": op4_token_rollups,
    "op5_token_store": op5_token_store,
    "op6_bpe": op6_bpe,
    "op7_jaccard": op7_jaccard,
    "op8_cotrain": op8_cotrain,
    "op9_fingerprints": op9_fingerprints,
    "op10_rules": op10_rules,
}

_ROLLUPS_SQL = r"""
WITH gone AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM gone WHERE doc_id IS NOT NULL)),
c AS (
  SELECT source, lang, 'bytes-1' AS version, strlen(text) AS tokens FROM d
  UNION ALL
  SELECT source, lang, 'words-1', CASE WHEN lang = 'fr' THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D\-]+')) ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END FROM d
)
SELECT source, lang, version, count(*)::BIGINT AS documents, sum(tokens)::BIGINT AS tokens FROM c GROUP BY ALL
"""

_HREF, _REFRESH = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""".replace("'", "''"), r"""(?is)\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)""".replace("'", "''")
_LINK, _META = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""".replace("'", "''"), r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""".replace("'", "''")

_URL_SQL = rf"""
WITH RECURSIVE r(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), stated AS (
  SELECT url, unnest([regexp_extract(regexp_extract(coalesce(html, ''), '{_LINK}'), '{_HREF}', 1), regexp_extract(regexp_extract(coalesce(html, ''), '{_META}'), '{_REFRESH}', 1)]) AS target FROM pages
), bare AS (
  SELECT regexp_extract(url, '^[^:/?#]*') AS scheme, substr(url, instr(url, '://') + 3) AS rest, regexp_extract(target, '^[^#]*') AS t FROM stated WHERE target <> '' AND instr(url, '://') > 0
), parts AS (
  SELECT scheme, regexp_extract(rest, '^[^/?#]*') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, scheme || '://' || rest AS url, t, regexp_extract(t, '^[^?]*') AS tpath, coalesce(regexp_extract(t, '(\?.*)?$', 1), '') AS tquery FROM bare
), joined AS (
  SELECT *, string_split(CASE WHEN t LIKE '/%' THEN tpath WHEN coalesce(regexp_extract(path, '^(.*/)?', 1), '') = '' THEN '/' || tpath ELSE regexp_extract(path, '^(.*/)?', 1) || tpath END, '/') AS s FROM parts
), folded AS (
  SELECT *, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN x[1] = '..' THEN a[1:greatest(1, len(a) - 1)] WHEN x[1] = '.' THEN a ELSE a || x END) || CASE WHEN s[len(s)] IN ('.', '..') THEN [''] ELSE [] END AS k FROM joined
), ends AS (
  SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN t WHEN t LIKE '//%' THEN scheme || ':' || t WHEN tpath = '' THEN scheme || '://' || host || path || tquery
    ELSE scheme || '://' || host || CASE WHEN len(k) = 1 THEN '/' ELSE array_to_string(k, '/') END || tquery END AS target FROM folded
), said AS (
  SELECT 'page' AS kind, page_id, url, CAST(NULL AS VARCHAR) AS other FROM pages UNION ALL SELECT 'edge', NULL, url, target FROM ends
), split AS (
  SELECT kind, page_id, other, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, CASE WHEN instr(other, '://') > 0 THEN substr(other, instr(other, '://') + 3) ELSE '' END AS rest2 FROM said
), placed AS (
  SELECT kind, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, coalesce(regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1), '') AS query,
    translate(regexp_extract(rest2, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host2, regexp_extract(rest2, '^[^/?#]*([^?#]*)', 1) AS path2, coalesce(regexp_extract(rest2, '^[^?#]*(\?[^#]*)?', 1), '') AS query2 FROM split
), nodes AS (
  SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS node, CASE WHEN host2 <> '' THEN host2 || CASE WHEN path2 = '' THEN '/' ELSE path2 END || query2 END AS node2 FROM placed
), e AS (
  SELECT node AS a, node2 AS b FROM nodes WHERE kind = 'edge' AND node IS NOT NULL AND node2 IS NOT NULL AND node <> node2
), reach(a, b) AS (
  SELECT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) UNION SELECT reach.a, n.b FROM reach JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) n ON n.a = reach.b
), pg AS (
  SELECT row_number() OVER () AS id, page_id, host, path, node FROM nodes WHERE kind = 'page'
), beyond AS (
  SELECT DISTINCT a AS node, split_part(a, '/', 1) AS host, regexp_extract(a, '^[^/]*([^?]*)', 1) AS path FROM reach WHERE a NOT IN (SELECT node FROM pg WHERE node IS NOT NULL)
), subject AS (
  SELECT id, page_id, host, path, node FROM pg UNION ALL SELECT NULL, NULL, host, path, node FROM beyond
), fit AS (
  SELECT *, row_number() OVER (PARTITION BY id, node, host, path ORDER BY length(rule_host || rule_path) DESC NULLS LAST, action) AS k
  FROM subject LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), best AS (
  SELECT *, rule_host || rule_path AS rule FROM fit WHERE k = 1
), blocked AS (
  SELECT a FROM reach JOIN best ON best.node = reach.b GROUP BY a HAVING bool_or(action = 'block') AND NOT coalesce(bool_or(action = 'allow'), false)
)
SELECT page_id, host, path, rule, CASE WHEN action IS NOT NULL THEN action WHEN node IN (SELECT a FROM blocked) THEN 'block' ELSE 'allow' END AS verdict FROM best WHERE id IS NOT NULL
"""

ORACLE_SQL: dict[str, str] = {
    "op1_url_alias": _URL_SQL,
    "op4_token_rollups": _ROLLUPS_SQL,
}
