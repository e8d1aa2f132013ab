"""One query per operator of this package, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bpe, convtrie, decontam, langid, mtree, nbsvm, quality_rules, shards, simhash, toxicity, warc, wavelet, whiten
from .labelled import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, decoded again; digests of both."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, ranks).drop("text", "offsets")
    return bpe.decode(coded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records (equal payloads as revisits of the
    largest page_id) and read back from the archives."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    back = warc.read_archives(spark, warc.write_archives(warc.mark_revisits(pages)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


# sha1 in DuckDB is hexadecimal; five hex digits are four base32 letters.
ORACLE["op6_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha1(body)) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5))::BIGINT >> (5 * (3 - i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN top END AS refers_to,
  NULL::VARCHAR AS problem
FROM q
"""


@_query
def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words found in every document by the suffix automaton."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_spans(docs, read_table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op7_decontam"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
  (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
m AS (SELECT rid, i, g.n, item FROM g JOIN win ON g.g = win.g AND g.n = win.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM m) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


@_query
def op8_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in wavelet shards, read back from the files;
    the ids are those of the tokenizers library without added special tokens."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    files = wavelet.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, added_tokens=True)
    return wavelet.read_shards(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 3-word shingles, 2 bits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal row counts by a uniform shuffle (law
    ``rows``; equal texts are independent rows)."""
    text = F.coalesce("text", F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shards.shuffle_into_shards(rows, 40, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, log-likelihood ratio and verdict for every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.apply_rules(docs, read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "llr")


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document from its maximum-scoring segments."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


@_query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by string-kernel ridge regression."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, ~held_out("doc_id", 3, 1))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by naive Bayes support vectors."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = nbsvm.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    return nbsvm.classify(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, one row per node."""
    return convtrie.prefix_trie(read_table(spark, sf_dir, "conversations"))


# crc32 of the decimal ids from its byte table; a node is known by its smallest member and its depth
ORACLE["op11_trie"] = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tb),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rk FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda a, b: xor(a >> 8, tb[(xor(a, b) & 255) + 1]))) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), tab),
f AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS head FROM c LEFT JOIN c AS b ON b.conv_id = c.base),
rb AS (SELECT f.conv_id, t.rk AS pos, r, x FROM f JOIN t ON t.conv_id = f.base WHERE t.rk <= f.h
  UNION ALL SELECT f.conv_id, t.rk - f.h + f.head, r, x FROM f JOIN t ON t.conv_id = f.conv_id WHERE t.rk > f.h),
s AS (SELECT conv_id, coalesce(list({'r': r, 'x': x} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS q
  FROM f LEFT JOIN rb USING (conv_id) GROUP BY conv_id),
m AS (SELECT conv_id, d, q[1:d] AS p, coalesce(strlen(q[d].x), 0) AS b, d = len(q) AS last
  FROM (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM s)),
node AS (SELECT p, d, min(conv_id) AS id, count(*) AS n, any_value(b) AS b,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM m GROUP BY p, d),
loc AS (SELECT m.conv_id, d, node.id FROM m JOIN node USING (p, d)),
up AS (SELECT node.*, loc.id AS pid FROM node LEFT JOIN loc ON loc.conv_id = node.id AND loc.d = node.d - 1),
kid AS (SELECT pid AS id, d - 1 AS d, count(*) AS k FROM up WHERE d > 0 GROUP BY ALL),
sub AS (SELECT loc.id, loc.d, sum((u.n - 1) * u.b) AS saved, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves
  FROM up AS u LEFT JOIN kid ON kid.id = u.id AND kid.d = u.d JOIN loc ON loc.conv_id = u.id AND loc.d <= u.d GROUP BY ALL)
SELECT up.id AS conv_id, up.d::BIGINT AS depth, pid AS parent_conv_id, n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM up JOIN sub ON sub.id = up.id AND sub.d = up.d LEFT JOIN kid ON kid.id = up.id AND kid.d = up.d
"""


@_query
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector with all others."""
    return mtree.top_k(read_table(spark, sf_dir, "embeddings"))


ORACLE["op12_topk"] = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c::DOUBLE))) = 0),
p AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON v.rid <> q.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every vector."""
    return whiten.whiten(read_table(spark, sf_dir, "embeddings"))
