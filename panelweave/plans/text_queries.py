"""Queries on documents, papers, tokens and chats."""

from __future__ import annotations

from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import functions as F

from panelweave.functions import names as nm
from panelweave.functions import text as tx
from panelweave.operators import corpus as cp
from panelweave.operators import languages as lg
from panelweave.operators import ranks as rk
from panelweave.operators import subwords as sw
from panelweave.operators.scale import spread
from panelweave.plans.registry import query, sql_hash, sql_unit, text_tasks


def _docs(t, *more):
    return spread(t.documents.select("doc_id", "text", *more), "doc_id", text_tasks(t.spark))


# outer newlines off, lone newlines off unless a non-ASCII character follows
_CLEAN = "trim(regexp_replace({p}, '\\n([\\x00-\\x7F]|$)', '\\1', 'g'), ' ')"


def _paragraph_sql(min_words: int, separator: str) -> str:
    return f"""paras AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS paragraph_no, unnest(ps) AS text FROM (
      SELECT doc_id, list_filter(list_transform(string_split_regex(trim(text, chr(10)), '{separator}'), lambda p: {_CLEAN.format(p='p')}),
        lambda p: len(string_split(p, ' ')) >= {min_words}) AS ps FROM documents))"""


@query("split_paragraphs", f"WITH {_paragraph_sql(10, chr(92) + 'n{2,}')} SELECT doc_id, CAST(paragraph_no AS INTEGER) AS paragraph_no, text FROM paras")
def _(t):
    return cp.split_paragraphs(_docs(t), "text", 10)


_W, _S = 196, 107
CHUNKS = f"""{_paragraph_sql(1, chr(92) + 'n{2,}')}, w AS (SELECT doc_id, paragraph_no, string_split(text, ' ') AS ws FROM paras),
  n AS (SELECT *, CAST(greatest(ceil((len(ws) - {_W}) / {_S}.0), 0) AS BIGINT) AS extra FROM w),
  c AS (SELECT doc_id, paragraph_no, ws, unnest(range(extra + 1)) AS chunk_no FROM n)"""


@query("chunk_overlap", f"""WITH {CHUNKS} SELECT doc_id, CAST(paragraph_no AS INTEGER) AS paragraph_no, CAST(chunk_no AS INTEGER) AS chunk_no,
  trim(array_to_string(ws[chunk_no * {_S} + 1 : chunk_no * {_S} + {_W}], ' '), ' ') AS text FROM c""")
def _(t):
    paragraphs = cp.split_paragraphs(_docs(t), "text", 1)
    return cp.chunk_overlap(paragraphs, "text", 196, 0.45)


# ---- languages --------------------------------------------------------------

PROFILE_SHARE, PROFILE_SEED = 0.1, 7  # profiles are learned from a tenth of the documents, chosen by hash


def profiles(t):
    return lg.learn_profiles(_docs(t, "lang"), "text", "lang", ["doc_id"], PROFILE_SHARE, PROFILE_SEED)


def _runs_sql(columns: str, table: str) -> str:
    padded = "('  ' || word || '  ')"
    first, second = lg.FACTORS
    return (f"SELECT {columns}, unnest(list_transform(range(1, CAST(length(word) AS BIGINT) + 3), lambda i: (unicode({padded}[i]) * {first} "
            f"+ unicode({padded}[i + 1]) * {second} + unicode({padded}[i + 2])) % {lg.BUCKETS})) AS bucket FROM {table}")


_DISTINCT_WORDS = f"unnest(list_distinct(regexp_extract_all(lower(text), '{lg.WORD}')))"


def language_sql(texts: str, keys: str) -> str:
    """CTEs that end with ``spoken`` (keys, language): the detected language of each text of a table."""
    least = repr(0.5 / lg.BUCKETS)
    return f"""taught AS (SELECT language, word, count(*) AS n FROM (SELECT lang AS language, {_DISTINCT_WORDS} AS word FROM documents
    WHERE lang IS NOT NULL AND {sql_unit(sql_hash(PROFILE_SEED, 'doc_id'))} / 4294967296.0 < {PROFILE_SHARE}) GROUP BY 1, 2),
  counted AS (SELECT language, bucket, CAST(sum(n) AS DOUBLE) AS n FROM ({_runs_sql('language, n', 'taught')}) GROUP BY 1, 2),
  weights AS (SELECT language, bucket, CAST(floor({lg.UNIT} * ln((n / sum(n) OVER (PARTITION BY language) + {least}) / {least}) + 0.5) AS BIGINT) AS w FROM counted),
  said AS (SELECT {keys}, {_DISTINCT_WORDS} AS word FROM {texts}),
  heard AS (SELECT word, language, sum(w) AS s FROM ({_runs_sql('word', '(SELECT DISTINCT word FROM said)')}) r JOIN weights w ON w.bucket = r.bucket GROUP BY 1, 2),
  scored AS (SELECT {keys}, language, sum(s) AS s FROM said JOIN heard ON heard.word = said.word GROUP BY ALL),
  spoken AS (SELECT {keys}, language FROM (SELECT *, row_number() OVER best AS r, lead(s) OVER best AS next FROM scored
    WINDOW best AS (PARTITION BY {keys} ORDER BY s DESC, language)) WHERE r = 1 AND s - coalesce(next, 0) >= {3 * lg.UNIT})"""


@query("language_filter", f"WITH {language_sql('documents', 'doc_id')} SELECT doc_id, language FROM spoken WHERE language IN ('en', 'de')")
def _(t):
    return lg.language_filter(_docs(t), "text", ["en", "de"], profiles(t)).select("doc_id", "language")


@query("strip_direction_marks", "SELECT doc_id, md5(regexp_replace(replace(text, ' the ', ' ' || chr(8235) || 'the' || chr(8236) || chr(10)), "
       "'[' || chr(8234) || chr(8235) || chr(8236) || ']\\n?', '', 'g')) AS digest FROM documents")
def _(t):
    marked = F.replace(F.col("text"), F.lit(" the "), F.lit(" \u202bthe\u202c\n"))
    return t.documents.select("doc_id", F.md5(tx.strip_direction_marks(marked)).alias("digest"))


@query("truncate_tokens", "SELECT doc_id, array_to_string(string_split(text, ' ')[1:64], ' ') AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.truncate_tokens(F.col("text"), 64).alias("text"))


@query("extract_after_marker", """SELECT page_id, trim(list_extract(string_split(html, '<p>'), -1), ' ' || chr(10)) AS html FROM pages WHERE contains(html, '<p>')""")
def _(t):
    return cp.extract_after_marker(t.pages.select("page_id", "html"), "html", "<p>")


_PAPERS = "papers AS (SELECT CAST(substr(source, 4) AS INTEGER) AS term, doc_id AS pos, lang AS author, text AS title FROM documents)"


@query("dedup_title_author", f"WITH {_PAPERS} SELECT term, pos, author, title FROM (SELECT *, row_number() OVER (PARTITION BY title, author ORDER BY term, pos DESC) AS r FROM papers) WHERE r = 1")
def _(t):
    papers = t.documents.select(F.expr("CAST(substr(source, 4) AS INT)").alias("term"), F.col("doc_id").alias("pos"),
                                F.col("lang").alias("author"), F.col("text").alias("title"))
    return cp.dedup_papers(papers, "term", "pos")


@query("citation_filter", """SELECT p_partkey, coalesce(n, 0) AS citations FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1)
  ON l_partkey = p_partkey WHERE coalesce(n, 0) >= 30""")
def _(t):
    cited = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    counted = t.part.select("p_partkey").join(cited, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("citations"))
    return cp.citation_filter(counted, "citations", 30)


@query("signature_filter", "SELECT page_id, md5(html) AS digest FROM pages WHERE html LIKE '<!DOCTYPE html><html lang=\"en\"%'")
def _(t):
    docs = t.pages.select("page_id", F.md5("html").alias("digest"), F.col("html").cast("binary").alias("content"))
    return cp.signature_filter(docs, "content", b'<!DOCTYPE html><html lang="en"').drop("content")


@query("authors_join", """SELECT l_orderkey, string_agg(s_name, ', ' ORDER BY l_linenumber, s_name) AS authors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def _(t):
    named = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    lists = named.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("pos"), F.col("s_name").alias("name")))).alias("a"))
    return lists.select("l_orderkey", nm.join_names(F.col("a")).alias("authors"))


# ---- tokens -----------------------------------------------------------------

_TOKENS = """tok AS (SELECT doc_id, generate_subscripts(ts, 1) AS pos, unnest(ts) AS token FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ts FROM documents)),
  vocab AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, encode(token)) - 1 + {first} AS token_id FROM tok GROUP BY 1),
  ids AS (SELECT d.doc_id, coalesce(list(token_id ORDER BY pos) FILTER (token_id IS NOT NULL), []) AS ids FROM documents d
    LEFT JOIN tok ON tok.doc_id = d.doc_id LEFT JOIN vocab ON vocab.token = tok.token GROUP BY 1)"""


@query("encode_words", f"WITH {_TOKENS.format(first=0)} SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ' ')) AS digest FROM ids")
def _(t):
    docs = _docs(t)
    return cp.encode(docs, "doc_id", "text", cp.vocabulary(docs, "doc_id", "text")).select("doc_id", F.size("ids").alias("n"), digest("ids"))


# ---- sub-words --------------------------------------------------------------

_TOKENIZERS = find_spec("public_tokenizers")
VOCABULARY = str(Path(_TOKENIZERS.origin).with_name("byte_bpe_50k.tiktoken")) if _TOKENIZERS else "byte_bpe_50k.tiktoken"
BEGIN, END, PAD = 50_256, 50_257, 50_258  # free ids behind this vocabulary


def merges(t):
    return sw.read_merges(t.spark, VOCABULARY)


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


def digest(ids, name="digest"):
    return F.md5(joined(ids)).alias(name)


# white space in front of a word: all but the last character stand alone, as by the lookahead that this SQL lacks
_MARKED = r"regexp_replace(text, '(\s)(\s\S)', '\1' || chr(1) || '\2', 'g')"
_PIECES = sw.PIECES.replace(r"|\s+(?!\S)", "").replace(r"[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}\x01]").replace("'", "''")


def subword_sql(texts: str, keys: str) -> str:
    """CTEs of a recursive WITH that end with ``enc`` (keys, text, ids, begins, ends) for the keys of a table with texts."""
    return f"""voc AS (SELECT hex(from_base64(tok)) AS tok, rank FROM read_csv('{VOCABULARY}', header = false, delim = ' ', quote = '', escape = '',
    columns = {{'tok': 'VARCHAR', 'rank': 'BIGINT'}})),
  cut AS (SELECT {keys}, generate_subscripts(ps, 1) AS pos, unnest(ps) AS piece FROM (SELECT {keys}, regexp_extract_all({_MARKED}, '{_PIECES}') AS ps FROM {texts})),
  mrg(piece, parts) AS (SELECT piece, regexp_extract_all(hex(encode(piece)), '..') FROM (SELECT DISTINCT piece FROM cut)
    UNION ALL SELECT piece, list_concat(list_concat(parts[1:i - 1], [parts[i] || parts[i + 1]]), parts[i + 2:]) FROM (
      SELECT piece, parts, arg_min(i, rank * 1000000 + i) AS i FROM (SELECT piece, parts, unnest(range(1, len(parts))) AS i FROM mrg) x
      JOIN voc ON voc.tok = parts[i] || parts[i + 1] GROUP BY piece, parts)),
  tok AS (SELECT piece, generate_subscripts(parts, 1) AS j, unnest(parts) AS tok FROM (SELECT piece, arg_min(parts, len(parts)) AS parts FROM mrg GROUP BY piece)),
  led AS (SELECT piece, j, rank, CAST(substr(tok.tok, 1, 2) BETWEEN '80' AND 'BF' AS INTEGER) AS inside,
    len(list_filter(regexp_extract_all(tok.tok, '..'), lambda x: x NOT BETWEEN '80' AND 'BF')) AS leads FROM tok JOIN voc ON voc.tok = tok.tok),
  plc AS (SELECT piece, list(rank ORDER BY j) AS ids, list(upto - leads - inside ORDER BY j) AS begins, list(upto ORDER BY j) AS ends
    FROM (SELECT *, CAST(sum(leads) OVER (PARTITION BY piece ORDER BY j) AS BIGINT) AS upto FROM led) GROUP BY piece),
  enc AS (SELECT {keys}, flatten(list(ids ORDER BY pos)) AS ids, flatten(list(list_transform(begins, lambda x: x + base) ORDER BY pos)) AS begins,
    flatten(list(list_transform(ends, lambda x: x + base) ORDER BY pos)) AS ends FROM (SELECT cut.*, CAST(sum(length(cut.piece)) OVER (PARTITION BY {keys} ORDER BY pos) AS BIGINT)
      - length(cut.piece) AS base, ids, begins, ends FROM cut JOIN plc ON plc.piece = cut.piece) GROUP BY {keys})"""


def span_sql(labelled: str) -> str:
    """1-based first and last labelled token of an answer at characters s to e (0-based, s < 0 when absent)."""
    return f"""CASE WHEN s < 0 THEN 0 ELSE coalesce(list_position(list_transform(range(1, len({labelled}) + 1), lambda i: begins[i] <= s AND s < ends[i]), true), 0) END AS first,
    CASE WHEN s < 0 THEN 0 ELSE coalesce(list_position(list_transform(range(1, len({labelled}) + 1), lambda i: begins[i] < e AND e <= ends[i]), true), 0) END AS last"""


_DOC_IDS = f"{subword_sql('documents', 'doc_id')}, ids AS (SELECT d.doc_id, coalesce(enc.ids, []) AS ids FROM documents d LEFT JOIN enc ON enc.doc_id = d.doc_id)"


@query("encode_tokens", f"WITH RECURSIVE {_DOC_IDS} SELECT doc_id, CAST(len(ids) AS INTEGER) AS n, md5(array_to_string(ids, ' ')) AS digest FROM ids")
def _(t):
    return sw.with_tokens(_docs(t), "text", merges(t)).select("doc_id", F.size("ids").alias("n"), digest("ids"))


@query("pad_truncate_mask", f"""WITH RECURSIVE {_DOC_IDS} SELECT doc_id, array_to_string(list_resize(ids, 256, {PAD}), ' ') AS input_ids,
  CAST(least(len(ids), 256) AS INTEGER) AS used FROM ids""")
def _(t):
    padded = cp.pad_truncate_mask(sw.with_tokens(_docs(t), "text", merges(t), 256), "ids", 256, PAD)
    return padded.select("doc_id", joined("input_ids").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("used"))


@query("labels_until_eos", f"""WITH RECURSIVE {_DOC_IDS}, f AS (SELECT doc_id, list_concat(list_concat([{BEGIN}], ids), [{END}, {PAD}, {PAD}]) AS f FROM ids)
  SELECT doc_id, md5(array_to_string(list_transform(f, lambda x, i: CASE WHEN i <= len(f) - 2 THEN x ELSE -100 END), ' ')) AS labels FROM f""")
def _(t):
    def fixed(*ids):
        return F.array(*[F.lit(x).cast("bigint") for x in ids])

    framed = sw.with_tokens(_docs(t), "text", merges(t)).withColumn("f", F.concat(fixed(BEGIN), "ids", fixed(END, PAD, PAD)))
    return framed.select("doc_id", digest(tx.labels_until_eos(F.col("f"), BEGIN, END), "labels"))


_TURN_TEXT = "'Q: ' || a.role || ' says' || chr(10) || ' A: ' || a.text || ' end of turn'"


@query("labels_answer_span", f"""WITH RECURSIVE x AS (SELECT conv_id, turn, {_TURN_TEXT} AS text, a.text AS output FROM conversations a),
  {subword_sql('x', 'conv_id, turn')}, p AS (SELECT enc.*, instr(text, output) - 1 AS s, instr(text, output) - 1 + length(output) AS e FROM enc JOIN x USING (conv_id, turn)),
  f AS (SELECT *, {span_sql('ids')} FROM p)
  SELECT conv_id, turn, md5(array_to_string(list_transform(ids, lambda v, i: CASE WHEN first > 0 AND i >= first AND (last = 0 OR i <= last + 1) THEN v ELSE -100 END), ' ')) AS labels FROM f""")
def _(t):
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("output"), F.concat(
        F.lit("Q: "), "role", F.lit(" says\n A: "), "text", F.lit(" end of turn")).alias("text"))
    tokens = sw.with_tokens(spread(rows, "conv_id", text_tasks(t.spark)), "text", merges(t), spans="spans")
    labels = sw.labels_answer_span(F.col("ids"), F.col("spans"), F.col("text"), F.col("output"))
    return tokens.select("conv_id", "turn", digest(labels, "labels"))


# ---- chats ------------------------------------------------------------------

LAYOUTS = {"user": ("[system] {system} [ask] {user} [reply] {response}", "[ask] {user} [reply] {response}"),
           "assistant": ("<s>{system}</s> {user} => {response}", "{user} => {response}"),
           "system": ("{system}: {user}", "{user}")}


FAMILIES = {"user": ("asker", "user"), "assistant": ("helper", "assistant"), "system": ("system",)}


@query("format_instruction", """SELECT conv_id, turn, trim(CASE role WHEN 'user' THEN CASE WHEN turn = 0 THEN '[system] start ' ELSE '' END || '[ask] ' || text || ' [reply] ok'
  WHEN 'assistant' THEN CASE WHEN turn = 0 THEN '<s>start</s> ' ELSE '' END || text || ' => ok'
  ELSE CASE WHEN turn = 0 THEN 'start: ' ELSE '' END || text END, ' ') AS text FROM conversations""")
def _(t):
    family = nm.layout_family(F.concat("role", F.lit("-7B")), FAMILIES)
    rows = t.conversations.select("conv_id", "turn", family.alias("family"), F.col("text").alias("ask"), F.lit("ok").alias("reply"),
                                  F.when(F.col("turn") == 0, "start").alias("system"))
    return cp.format_chat(rows, LAYOUTS, "family", "ask", "system", "reply").select("conv_id", "turn", "text")


@query("flatten_conversation", """SELECT conv_id, string_agg('<' || role || '> ' || text, chr(10) ORDER BY turn) AS chat,
  any_value(valid) AS valid FROM conversations JOIN (SELECT conv_id AS c, CASE WHEN count(CASE WHEN role = 'user' THEN 1 END)
    - count(CASE WHEN role = 'assistant' THEN 1 END) IN (0, 1) THEN 1 ELSE 0 END AS valid FROM conversations GROUP BY 1) ON c = conv_id GROUP BY 1""")
def _(t):
    return cp.flatten_chat(t.conversations, "conv_id", "turn", "role", "text")


@query("page_stitch", """WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN lower(text) ELSE rtrim(text, '.') END || chr(10) || chr(10) || chr(12) AS body FROM conversations),
  c AS (SELECT *, max(CASE WHEN contains(body, 'Mit') THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM p),
  k AS (SELECT * FROM c WHERE cut IS NULL OR turn < cut),
  n AS (SELECT k.*, substr(x.body, 1, 1) AS nxt, substr(k.body, 1, length(k.body) - 3) AS core FROM k LEFT JOIN k x ON x.conv_id = k.conv_id AND x.turn = k.turn + 1)
  SELECT conv_id, string_agg(CASE WHEN nxt IS NOT NULL AND lower(nxt) = nxt AND upper(nxt) <> nxt AND substr(core, -1) NOT IN ('.', '!', '?') THEN core || ' ' ELSE body END, ''
    ORDER BY turn) AS body FROM n GROUP BY 1""")
def _(t):
    tail = "\n\n\f"
    body = F.concat(F.when(F.col("turn") % 2 == 1, F.lower("text")).otherwise(F.rtrim(F.col("text"), F.lit("."))), F.lit(tail))
    return rk.stitched_text(t.conversations.select("conv_id", "turn", body.alias("body")), "conv_id", "turn", "body", "Mit")


@query("split_random", f"""SELECT doc_id, CASE WHEN {sql_unit(sql_hash(10, 'doc_id'))} / 4294967296.0 < 0.8 THEN 'train' ELSE 'test' END AS split FROM documents""")
def _(t):
    return cp.split_docs(t.documents.select("doc_id"), "doc_id", 0.8, 10)
