"""Queries over the driver's tables, one per operator, each with DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression_quality, decontamination, html_text, line_dedup, ngram_join, periodic_runs, sharding, substring_dedup, toxicity, warc
from .common import new_folder, table
from .exact_dedup import DigestIndex
from .lexical_search import LexicalIndex

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _query(sql: str | None = None):
    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


@_query(r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), o AS (
  SELECT d.doc_id, d.s, d.n, p.item_id
  FROM (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM p))) d
  JOIN p ON p.n = d.n AND p.phrase = d.phrase
), h AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM o) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w.w), false) AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document searched for the windows of every test item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words(F.col("hits"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontamination.is_contaminated(F.col("n_words"), n_hit).alias("contaminated"),
    )


@_query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_digests(docs, ranks, public_tokenizers.PATTERN).drop("ids")


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query(r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a new digest index: which row of its text stays."""
    index = DigestIndex(spark, new_folder(spark, "digest-index"))
    found = index.add(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query()
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that other places hold first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.remove_repeated(docs, cut=line_dedup.FINE)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("deduplicated", 256).alias("kept_sha256"))


@_query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of equal row counts, equal texts together."""
    found = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    none = F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", none)


@_query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


@_query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)
                        FOR i IN range(0, 32)], '') AS payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER w THEN NULL ELSE max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY html)
""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    path = new_folder(spark, "archives")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    found = warc.read_archives(spark, path).filter("problem IS NULL")
    number = lambda name: F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )


@_query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, s, array_to_string(w[s : s + 12], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
f AS (SELECT phrase, min(doc_id) AS owner FROM s GROUP BY phrase),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM s JOIN f USING (phrase) WHERE owner < doc_id),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
r AS (
  SELECT k.doc_id, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY k.k) FILTER (WHERE c.k IS NULL) AS kept
  FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.k = k.k GROUP BY k.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word passages that earlier documents hold."""
    found = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Shingle sets and links of the documents `d` (doc_id, w), for the SQL of the join and of the pipeline.
LINKS_SQL = r"""
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(w[s : s + 2], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM d WHERE len(w) > 0))
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
least_of AS (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a)
"""


@_query(r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),""" + LINKS_SQL + """
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, least), d.doc_id) AS component_id,
       coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) USING (doc_id)
""")
def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-equal documents of every document."""
    found = ngram_join.link_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


@_query()
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of three fourths of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    own = compression_quality.held_out(F.col("doc_id"))
    scored = compression_quality.score(docs, compression_quality.train(docs, table(spark, sf_dir, "labels").filter(~own)))
    return scored.select("doc_id", own.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, and its words without their repeats."""
    found = periodic_runs.find_runs(periodic_runs.with_planted_runs(table(spark, sf_dir, "documents")))
    found = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    lines = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@_query(r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), d AS (SELECT doc_id, count(*)::BIGINT AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL) JOIN w USING (term) JOIN p USING (term) JOIN d USING (doc_id), g GROUP BY item_id, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for every test item."""
    index = LexicalIndex(spark, new_folder(spark, "lexical-index"))
    index.add(table(spark, sf_dir, "documents"))
    return index.search(table(spark, sf_dir, "benchmark"))
