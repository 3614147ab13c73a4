"""The operators of this folder as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import decontaminate, exact_dedup, jaccard, lines, mixing, packing, quality, repeats, spelling, tokens, topk, warc, whitening
from panelweave.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, table: str, sql: str | None = None):
    def register(build: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(*[tune(spark).read.parquet(f"{folder}/{name}.parquet") for name in table.split()])

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build
    return register


_LOWERED = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op2_exact_dedup", "documents", f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWERED} AS body FROM documents) WINDOW same AS (PARTITION BY body)""")
def _(docs):
    return exact_dedup.classify(docs).drop("place")


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank,
             3 * source_size AS most FROM s),
v AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM w),
l AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(most) OVER (ORDER BY most / weight, rank
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS DOUBLE)
             / CAST(sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM v),
t AS (SELECT source, source_size, least(CAST(most AS DOUBLE), (SELECT max(level) FROM l WHERE level * weight <= most) * weight) AS target
      FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
c AS (SELECT d.doc_id, d.size, b.*, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place
                 RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto,
             CAST(sum(d.size) OVER (PARTITION BY d.source, d.place) AS BIGINT) AS here
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN whole < 3 AND (upto <= budget OR (upto - here <= budget AND upto - budget <= budget - (upto - here)))
                            THEN 1 ELSE 0 END) AS taken
FROM c"""


@query("op7_mixing", "documents", _MIX_SQL)
def _(docs):
    return mixing.mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op9_token_counts", "documents")
def _(docs):
    return tokens.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_packing", "documents")
def _(docs):
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op8_quality", "documents labels")
def _(docs, labels):
    return quality.score(docs, labels)


@query("op6_warc", "pages", """
SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to
FROM (SELECT page_id, body, first, octet_length(encode(body)) >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS revisit
      FROM (SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages))""")
def _(pages):
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_topk", "embeddings", """
WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id,
             CAST(list_sum([z[1] * z[2] for z in list_zip(q.v, p.v)]) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id AND len(q.v) = len(p.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def _(embeddings):
    return topk.top_k(embeddings)


@query("op10_suffix_dedup", "documents", rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, row, len(w) AS n, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS h
      FROM (SELECT *, unnest(range(greatest(len(w) - 49, 0))) AS i FROM d)),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM g) WHERE c > 1),
b AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 50 THEN 0 ELSE 1 END AS opens FROM r),
s AS (SELECT *, sum(opens) OVER (PARTITION BY row ORDER BY i) AS span FROM b)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_words, CAST(min(i) AS BIGINT) AS begin_word, CAST(max(i) + 50 AS BIGINT) AS end_word
FROM s GROUP BY doc_id, row, span""")
def _(docs):
    return repeats.find(docs).select("doc_id", "n_words", F.explode("repeated").alias("s")).select(
        "doc_id", "n_words", F.col("s.begin").alias("begin_word"), F.col("s.end").alias("end_word"))


@query("op5_line_dedup", "documents", """
WITH l AS (SELECT row, doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS line
           FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE len(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY row, doc_id""")
def _(docs):
    return lines.drop_frequent(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_ngram_jaccard", "documents", rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT row, md5(array_to_string(w[i + 1:i + 5], ' ')) AS g FROM (SELECT row, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS x, b.row AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row < b.row GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.row = x JOIN n ny ON ny.row = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(row, root) AS (SELECT row, row FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.row)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM r JOIN d ON d.row = r.row JOIN d o ON o.row = r.root LEFT JOIN n ON n.row = r.row GROUP BY d.row, d.doc_id""")
def _(docs):
    return jaccard.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


_NORMAL_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query("op12_decontamination", "documents benchmark", rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWERED}, '{_NORMAL_WORDS}') AS w FROM benchmark),
t AS (SELECT DISTINCT item, md5(array_to_string(w[k + 1:k + 10], ' ')) AS h, least(len(w), 10) AS n
      FROM (SELECT item, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWERED}, '{_NORMAL_WORDS}') AS w FROM documents),
g AS (SELECT row, n, k, md5(array_to_string(w[k + 1:k + n], ' ')) AS h
      FROM (SELECT row, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, (SELECT DISTINCT n FROM t))),
m AS (SELECT g.row, g.k, g.n, t.item FROM g JOIN t ON g.h = t.h),
c AS (SELECT row, count(DISTINCT k) AS n_hit FROM (SELECT row, k + unnest(range(n)) AS k FROM m) GROUP BY row),
l AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT row, item FROM m WHERE item IS NOT NULL) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.row = d.row LEFT JOIN l ON l.row = d.row""")
def _(docs, benchmark):
    found = decontaminate.find(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op13_spelling_variants", "documents")
def _(docs):
    return spelling.group(docs)


@query("op11_whitening", "embeddings")
def _(embeddings):
    return whitening.whiten(embeddings).withColumn("deviation", F.col("deviation").cast("long"))
