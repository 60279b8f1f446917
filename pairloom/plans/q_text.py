"""Checked queries: text cleaning, tokens, vocabularies, BPE, padding, masks (X1-X11, X17, X19,
J6, F4, P12-P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching as BT
from ..operators import pooling as PL
from ..operators import tokens as TK
from ..session import cut_lineage, load, scratch_path
from ..sources import readers as RD
from . import fixtures as fx
from .registry import register

N_MERGES = 72  # merges of four levels are among them
N_READ = 60  # a published file may hold more lines than the tokenizer reads
MAX_LEN = 75  # fixed value: max tokens in the reference scripts
SEED = 42

_WS_SQL = r"[\t\n\x0B\f\r \x1C-\x1F\x85\p{Z}]+"
_PAT_SQL = T.PRETOKEN_PATTERN.replace("'", "''")


def _clean_sql(col: str) -> str:
    return f"lower(trim(regexp_replace({col}, '{_WS_SQL}', ' ', 'g')))"


def tokens_sql(col: str) -> str:
    return f"regexp_extract_all({_clean_sql(col)}, '{_PAT_SQL}')"


SQL_TOK = f"""tok AS (
  SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, regexp_extract_all({_clean_sql('text')}, '{_PAT_SQL}') AS t FROM documents))"""

SQL_VOCAB = SQL_TOK + """,
vocab AS (SELECT token, count(*) AS count, (row_number() OVER (ORDER BY count(*) DESC, token) + 2)::BIGINT AS id
          FROM tok GROUP BY token)"""

# Every document has a row, one without tokens an empty list.
SQL_FTOKENS = SQL_VOCAB + """,
f_tokens AS (SELECT doc_id, coalesce(i.ids, []::BIGINT[]) AS ids FROM documents LEFT JOIN
             (SELECT doc_id, list(id ORDER BY pos) AS ids FROM tok JOIN vocab USING (token) GROUP BY doc_id) i USING (doc_id))"""

_B = "('0x' || substr(hex(encode(token)), 2 * i - 1, 2))::INTEGER"
_CP = (f"CASE WHEN ({_B} BETWEEN 33 AND 126) OR ({_B} BETWEEN 161 AND 172) OR ({_B} BETWEEN 174 AND 255) "
       f"THEN {_B} WHEN {_B} <= 32 THEN {_B} + 256 WHEN {_B} <= 160 THEN {_B} - 127 + 289 ELSE 323 END")
_SYM = f"array_to_string(list_transform(generate_series(1, octet_length(encode(token))), lambda i: chr({_CP})), '')"

SQL_PAIRS = SQL_TOK + f""",
words AS (SELECT token, count(*) AS count, {_SYM} AS sym FROM tok GROUP BY token),
ch AS (SELECT token, count, string_split(sym, '') AS c FROM words),
pr AS (SELECT DISTINCT token, count, c[i] AS l, c[i + 1] || CASE WHEN i + 1 = len(c) THEN '</w>' ELSE '' END AS r
       FROM (SELECT token, count, c, unnest(generate_series(1, len(c) - 1)) AS i FROM ch WHERE len(c) > 1)),
pairs AS (SELECT l, r, sum(count)::BIGINT AS count FROM pr GROUP BY l, r)"""


def _tokens(spark, d):
    return TK.tokenize(load(spark, d, "documents"), "doc_id", "text")


def f_vocabulary(spark, d):
    return cut_lineage(TK.vocabulary(_tokens(spark, d), fx.N_SPECIAL), "vocabulary")


def f_tokens(spark, d, vocab=None):
    rows = TK.tokenize(load(spark, d, "documents"), "doc_id", "text")
    return TK.lookup_ids(rows, vocab or f_vocabulary(spark, d), "doc_id")


def f_merges(spark, d):
    return TK.learn_merges(_tokens(spark, d), N_MERGES)


@register("whitespace_clean", f"SELECT doc_id, trim(regexp_replace(text, '{_WS_SQL}', ' ', 'g')) AS cleaned FROM documents")
def q_whitespace_clean(spark, d):
    return load(spark, d, "documents").select("doc_id", T.whitespace_clean("text").alias("cleaned"))


@register("pretokenize", f"SELECT doc_id, regexp_extract_all({_clean_sql('text')}, '{_PAT_SQL}') AS tokens FROM documents")
def q_pretokenize(spark, d):
    return load(spark, d, "documents").select("doc_id", T.pretokenize(T.clean_for_tokens("text")).alias("tokens"))


def _unescape_sql(x: str) -> str:
    """The entities that the given pages hold; ``&amp;`` last, so that one pass does not undo two levels."""
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


@register("basic_clean", rf"""
SELECT page_id, regexp_replace({_unescape_sql(_unescape_sql("html"))}, '^[\t\n\x0B\f\r \x1C-\x1F\x85\p{{Z}}]+|[\t\n\x0B\f\r \x1C-\x1F\x85\p{{Z}}]+$', '', 'g') AS cleaned
FROM pages""")
def q_basic_clean(spark, d):
    return load(spark, d, "pages").select("page_id", T.basic_clean(F.col("html")).alias("cleaned"))


@register("byte_symbols", f"{'WITH ' + SQL_TOK} SELECT DISTINCT token, {_SYM} AS sym FROM tok")
def q_byte_symbols(spark, d):
    return TK.token_counts(_tokens(spark, d)).select("token", T.byte_symbols("token").alias("sym"))


@register("adjacent_pairs", f"WITH {SQL_PAIRS} SELECT l AS \"left\", r AS \"right\", count FROM pairs")
def q_adjacent_pairs(spark, d):
    return TK.pair_counts(_tokens(spark, d))


# Learning as a recursive query: each step takes the most frequent pair of the words as they stand and merges it
# in the words that hold it. A row with an empty word keeps each merge.
SQL_LEARN = f"""{SQL_PAIRS},
learn(key, k, count, w, l, r) USING KEY (key) AS (
  SELECT token, 0, count, list_transform(string_split(sym, ''), lambda x, i: CASE WHEN i = length(sym) THEN x || '</w>' ELSE x END), '', '' FROM words
  UNION ALL SELECT '', 0, 0, []::VARCHAR[], '', ''
  UNION ALL SELECT * FROM (
    WITH now AS (SELECT max(k) AS k FROM learn),
    held AS (SELECT DISTINCT key, count, w[i] AS l, w[i + 1] AS r FROM (SELECT key, count, w, unnest(generate_series(1, len(w) - 1)) AS i FROM recurring.learn WHERE len(w) > 1)),
    best AS (SELECT l, r FROM held GROUP BY l, r ORDER BY sum(count) DESC, l, r LIMIT 1)
    SELECT key, now.k + 1, count,
           list_reduce(w, lambda acc, x: CASE WHEN len(acc) > 0 AND acc[len(acc)] = best.l AND x = best.r
                                              THEN list_append(acc[1:len(acc) - 1], best.l || best.r) ELSE list_append(acc, x) END, []::VARCHAR[]), '', ''
    FROM recurring.learn, best, now WHERE list_contains(w, best.l) AND list_contains(w, best.r) AND now.k < {N_MERGES}
    UNION ALL SELECT ' ' || now.k, now.k + 1, 0, []::VARCHAR[], best.l, best.r FROM best, now WHERE now.k < {N_MERGES})),
m AS (SELECT (k - 1)::BIGINT AS rank, l, r FROM learn WHERE l <> '')"""

SQL_MERGES = f"WITH RECURSIVE {SQL_LEARN} SELECT rank, l AS \"left\", r AS \"right\" FROM m"


@register("learn_merges", SQL_MERGES)
def q_learn_merges(spark, d):
    return f_merges(spark, d)


_IDX = ("CASE WHEN cp BETWEEN 33 AND 126 THEN cp - 33 WHEN cp BETWEEN 161 AND 172 THEN cp - 161 + 94 "
        "WHEN cp BETWEEN 174 AND 255 THEN cp - 174 + 106 ELSE cp - 256 + 188 END")

# BPE as a recursive query: each round finds the best-ranked neighbouring pair
# of every unfinished word and merges its occurrences left to right.
SQL_BPE = f"""WITH RECURSIVE {SQL_LEARN},
keys AS (SELECT list(l || chr(1) || r ORDER BY rank) AS k, list(l ORDER BY rank) AS ls,
                list(r ORDER BY rank) AS rs FROM m),
init AS (SELECT token, list_transform(string_split(sym, ''), lambda x, i: CASE WHEN i = len(string_split(sym, '')) THEN x || '</w>' ELSE x END) AS w
         FROM words),
bpe(token, w, done) AS (
  SELECT token, w, len(w) <= 1 FROM init
  UNION ALL
  SELECT token,
         CASE WHEN best IS NULL THEN w ELSE
           list_reduce(w, lambda acc, x: CASE WHEN len(acc) > 0 AND acc[len(acc)] = bl AND x = br
                                              THEN list_append(acc[1:len(acc) - 1], bl || br)
                                              ELSE list_append(acc, x) END, []::VARCHAR[]) END,
         best IS NULL
  FROM (SELECT token, w, best, keys.ls[best] AS bl, keys.rs[best] AS br
        FROM (SELECT b.token, b.w,
                     list_min(list_transform(generate_series(1, len(b.w) - 1),
                                             lambda i: list_position(keys.k, b.w[i] || chr(1) || b.w[i + 1]))) AS best
              FROM bpe b, keys WHERE NOT b.done) x, keys)
),
done AS (SELECT token, w AS pieces FROM bpe WHERE done),
ids AS (SELECT l || r AS piece, max(rank) + 512 AS id FROM m GROUP BY l || r),
ex AS (SELECT token, i, pieces[i] AS piece FROM (SELECT token, pieces, unnest(generate_series(1, len(pieces))) AS i FROM done)),
pid AS (SELECT ex.token, ex.i, ex.piece,
               coalesce(ids.id, CASE WHEN ex.piece LIKE '%</w>' THEN 256 ELSE 0 END
                        + (SELECT {_IDX} FROM (SELECT unicode(ex.piece) AS cp))) AS id
        FROM ex LEFT JOIN ids USING (piece)),
bpe_tok AS (SELECT token, list(piece ORDER BY i) AS pieces, list(id::BIGINT ORDER BY i) AS piece_ids
            FROM pid GROUP BY token)"""


@register("bpe_encode", SQL_BPE + " SELECT token, pieces, piece_ids FROM bpe_tok")
def q_bpe_encode(spark, d):
    return TK.bpe_encode(_tokens(spark, d), f_merges(spark, d)).select("token", "pieces", "piece_ids")


# The given documents hold no entity and no double-encoded sequence (tests/test_oracle.py checks
# it), so X1 only strips and the oracles start from the pre-tokens.
SQL_ENCODED = SQL_BPE + """,
encoded AS (SELECT doc_id, coalesce(e.ids, []::BIGINT[]) AS ids FROM documents LEFT JOIN
            (SELECT doc_id, flatten(list(piece_ids ORDER BY pos)) AS ids FROM tok JOIN bpe_tok USING (token) GROUP BY doc_id) e
            USING (doc_id))"""


@register("encode", SQL_ENCODED + " SELECT doc_id, ids FROM encoded")
def q_encode(spark, d):
    return TK.encode(load(spark, d, "documents"), "doc_id", "text", f_merges(spark, d))


@register("decode", f"""WITH {SQL_TOK}
SELECT doc_id, coalesce(t.text, '') AS text FROM documents LEFT JOIN
  (SELECT doc_id, string_agg(token || ' ', '' ORDER BY pos) AS text FROM tok GROUP BY doc_id) t USING (doc_id)""".replace(
    "SELECT doc_id, coalesce", "SELECT documents.doc_id, coalesce"))
def q_decode(spark, d):
    merges = TK.merge_list(f_merges(spark, d))
    enc = TK.encode(load(spark, d, "documents"), "doc_id", "text", merges)
    return enc.select("doc_id", TK.decode_column(merges)(F.col("ids")).alias("text"))


@register("read_merges", SQL_MERGES + f" WHERE rank < {N_READ}")
def q_read_merges(spark, d):
    """The learned merges written as a published file would be (header, one pair a line, gzip) and read back."""
    path = scratch_path(spark, "merges")
    merges = f_merges(spark, d)
    lines = merges.select("rank", F.concat_ws(" ", "left", "right").alias("value"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("rank"), F.lit("version and vocabulary name").alias("value"))
    header.unionByName(lines).coalesce(1).sortWithinPartitions("rank").select("value").write.option("compression", "gzip").text(path)
    return RD.read_merges(spark, f"{path}/part-*.txt.gz", most=N_READ)


SOT, EOT = TK.special_ids(512 + N_MERGES)


def _fixed_sql(source: str, sot, eot) -> str:
    n = T.CONTEXT_LENGTH
    return f"""f AS (SELECT doc_id, list_concat([{sot}::BIGINT], ids, [{eot}::BIGINT]) AS f FROM {source})
SELECT doc_id, CASE WHEN len(f) > {n} THEN list_concat(f[1:{n - 1}], [{eot}::BIGINT])
                    ELSE list_concat(f, list_resize([]::BIGINT[], {n} - len(f), 0)) END AS ids
FROM f"""


@register("tokenize_text", SQL_ENCODED + ", " + _fixed_sql("encoded", SOT, EOT))
def q_tokenize_text(spark, d):
    """X9 on its own tokenizer: text, X1, BPE ids, the vocabulary's start and end, padding."""
    enc = TK.encode(load(spark, d, "documents"), "doc_id", "text", f_merges(spark, d))
    return enc.select("doc_id", T.tokenize_fixed("ids", truncate=True, sot=SOT, eot=EOT).alias("ids"))


@register("vocabulary", f"WITH {SQL_VOCAB} SELECT token, count, id FROM vocab")
def q_vocabulary(spark, d):
    return TK.vocabulary(_tokens(spark, d), fx.N_SPECIAL)


@register("lookup_ids", f"WITH {SQL_FTOKENS} SELECT doc_id, ids FROM f_tokens")
def q_lookup_ids(spark, d):
    return f_tokens(spark, d)


@register("lookup_pieces", f"""WITH {SQL_TOK}
SELECT documents.doc_id, coalesce(t.pieces, []::VARCHAR[]) AS pieces FROM documents LEFT JOIN
  (SELECT doc_id, list(token ORDER BY pos) AS pieces FROM tok GROUP BY doc_id) t USING (doc_id)""")
def q_lookup_pieces(spark, d):
    vocab = f_vocabulary(spark, d)
    return TK.lookup_pieces(f_tokens(spark, d, vocab), vocab, "doc_id")


@register("lookup_ids_blocks", f"WITH {SQL_FTOKENS} SELECT doc_id, ids FROM f_tokens")
def q_lookup_ids_blocks(spark, d):
    """The way of a vocabulary too large to ship."""
    rows = TK.tokenize(load(spark, d, "documents"), "doc_id", "text")
    return TK.lookup_ids(rows, f_vocabulary(spark, d), "doc_id", max_entries=0)


@register("lookup_pieces_blocks", f"""WITH {SQL_TOK}
SELECT documents.doc_id, coalesce(t.pieces, []::VARCHAR[]) AS pieces FROM documents LEFT JOIN
  (SELECT doc_id, list(token ORDER BY pos) AS pieces FROM tok GROUP BY doc_id) t USING (doc_id)""")
def q_lookup_pieces_blocks(spark, d):
    vocab = f_vocabulary(spark, d)
    return TK.lookup_pieces(f_tokens(spark, d, vocab), vocab, "doc_id", max_entries=0)


@register("tokenize_fixed", f"""WITH {SQL_FTOKENS}, n AS (SELECT count(*) + {fx.N_SPECIAL} AS n FROM vocab),
{_fixed_sql("f_tokens, n", "n", "n + 1").replace("SELECT doc_id, list_concat([n", "SELECT doc_id, n, list_concat([n").replace("[n + 1::BIGINT]", "[(n + 1)::BIGINT]")}""")
def q_tokenize_fixed(spark, d):
    vocab = f_vocabulary(spark, d)
    sot, eot = TK.special_ids(vocab.count(), fx.N_SPECIAL)
    return f_tokens(spark, d, vocab).select("doc_id", T.tokenize_fixed("ids", truncate=True, sot=sot, eot=eot).alias("ids"))


_SQL_BATCH8 = f"""b AS (SELECT doc_id, ids[1:{MAX_LEN}] AS ids, ((row_number() OVER (ORDER BY doc_id) - 1) // 8)::BIGINT AS batch_id
      FROM f_tokens)"""


# Whole rows: cutting to MAX_LEN is the feature of X10 alone.
_SQL_WHOLE8 = _SQL_BATCH8.replace(f"ids[1:{MAX_LEN}] AS ids", "ids")


def _x10(spark, d, padding, multiple=None, max_len=MAX_LEN):
    rows = f_tokens(spark, d)
    if max_len is not None:  # what X10 cuts off need not be sorted into batches
        rows = rows.withColumn("ids", T.truncate_ids("ids", max_len))
    b = BT.batch_ids(rows, 8, ["doc_id"])
    return TK.tokenize_pad(b, "ids", max_len, padding, pad_id=fx.PAD_ID, batch_col="batch_id", multiple=multiple)


@register("tokenize_pad_longest", f"""WITH {SQL_FTOKENS}, {_SQL_BATCH8}
SELECT doc_id, batch_id,
       list_concat(ids, list_resize([]::BIGINT[], max(len(ids)) OVER (PARTITION BY batch_id) - len(ids), 1)) AS ids
FROM b""")
def q_tokenize_pad_longest(spark, d):
    return _x10(spark, d, "longest").select("doc_id", "batch_id", "ids")


@register("tokenize_pad_max_length", f"""WITH {SQL_FTOKENS}, {_SQL_BATCH8}
SELECT doc_id, list_concat(ids, list_resize([]::BIGINT[], 80 - len(ids), 1)) AS ids FROM b""")
def q_tokenize_pad_max_length(spark, d):
    return _x10(spark, d, "max_length", multiple=8).select("doc_id", "ids")


@register("attention_mask", f"""WITH {SQL_FTOKENS}, {_SQL_WHOLE8},
p AS (SELECT doc_id, list_concat(ids, list_resize([]::BIGINT[], max(len(ids)) OVER (PARTITION BY batch_id) - len(ids), 1)) AS ids
      FROM b)
SELECT doc_id, list_transform(ids, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END) AS mask FROM p""")
def q_attention_mask(spark, d):
    return _x10(spark, d, "longest", max_len=None).select("doc_id", T.attention_mask("ids", fx.PAD_ID).alias("mask"))


def _draw_sql(k: str) -> str:
    return (f"('0x' || substr(md5(doc_id::VARCHAR || ':' || (i - 1)::VARCHAR || ':{SEED}:{k}'), 1, 8))::BIGINT")


_CHOSEN = f"(x >= {fx.N_SPECIAL} AND {_draw_sql('c')} / 4294967296.0 < 0.15)"


@register("mlm_mask", f"""WITH {SQL_FTOKENS},
t AS (SELECT doc_id, ids[1:{MAX_LEN}] AS ids, (SELECT count(*) FROM vocab) AS n FROM f_tokens)
SELECT doc_id,
  list_transform(ids, lambda x, i: CASE WHEN {_CHOSEN} THEN
      CASE WHEN {_draw_sql('m')} / 4294967296.0 < 0.8 THEN n + {fx.N_SPECIAL}
           WHEN {_draw_sql('m')} / 4294967296.0 < 0.9 THEN {_draw_sql('r')} % n + {fx.N_SPECIAL}
           ELSE x END
    ELSE x END) AS mlm_input_ids,
  list_transform(ids, lambda x, i: CASE WHEN {_CHOSEN} THEN x ELSE -100 END) AS mlm_labels
FROM t""")
def q_mlm_mask(spark, d):
    vocab = f_vocabulary(spark, d)
    size = vocab.count()  # the mask is the first id after the vocabulary, replacements are any of its ids
    t = f_tokens(spark, d, vocab).select("doc_id", T.truncate_ids("ids", MAX_LEN).alias("ids"))
    new_ids, labels = T.mlm_mask("ids", "doc_id", SEED, size + fx.N_SPECIAL, size, fx.N_SPECIAL)
    return t.select("doc_id", new_ids.alias("mlm_input_ids"), labels.alias("mlm_labels"))


@register("collate", f"""WITH {SQL_FTOKENS}, {_SQL_WHOLE8},
p AS (SELECT batch_id, doc_id,
             list_concat(ids, list_resize([]::BIGINT[], max(len(ids)) OVER (PARTITION BY batch_id) - len(ids), 1)) AS ids
      FROM b)
SELECT batch_id, list(doc_id ORDER BY doc_id) AS doc_id, list(ids ORDER BY doc_id) AS ids,
       list(list_transform(ids, lambda x: CASE WHEN x <> 1 THEN 1 ELSE 0 END) ORDER BY doc_id) AS mask
FROM p GROUP BY batch_id""")
def q_collate(spark, d):
    b = _x10(spark, d, "none", max_len=None)
    out = BT.collate(b, "batch_id", "doc_id", ["ids"], pad={"ids": fx.PAD_ID})
    return out.select("batch_id", "doc_id", "ids",
                      F.transform("ids", lambda a: T.attention_mask(a, fx.PAD_ID)).alias("mask"))


@register("position_ids_array", f"""WITH {SQL_FTOKENS}, {_SQL_WHOLE8},
p AS (SELECT doc_id, list_concat(ids, list_resize([]::BIGINT[], max(len(ids)) OVER (PARTITION BY batch_id) - len(ids), 1)) AS ids
      FROM b)
SELECT documents.doc_id, coalesce(q.position_ids, []::BIGINT[]) AS position_ids FROM documents LEFT JOIN
  (SELECT doc_id, list(position_id ORDER BY i) AS position_ids
   FROM (SELECT doc_id, i, (CASE WHEN x <> 1 THEN 1 + sum((x <> 1)::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) ELSE 1 END)::BIGINT AS position_id
         FROM (SELECT doc_id, generate_subscripts(ids, 1) AS i, unnest(ids) AS x FROM p)) GROUP BY doc_id) q USING (doc_id)""")
def q_position_ids_array(spark, d):
    return _x10(spark, d, "longest", max_len=None).select("doc_id", PL.position_ids_array("ids", fx.PAD_ID).alias("position_ids"))


@register("camel_to_snake", r"""
SELECT name, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS snake
FROM (SELECT DISTINCT upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'Pooler' AS name FROM events)
""")
def q_camel_to_snake(spark, d):
    e = load(spark, d, "events").select("event_type").distinct()
    name = F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)"), F.lit("Pooler"))
    return e.select(name.alias("name")).select("name", T.camel_to_snake("name").alias("snake"))


@register("prompt", "SELECT n_nationkey, 'a photo of a ' || lower(n_name) || '.' AS prompt FROM nation")
def q_prompt(spark, d):
    return load(spark, d, "nation").select("n_nationkey", T.prompt(F.lower("n_name")).alias("prompt"))


@register("file_stem", r"""
SELECT page_id, name, regexp_extract(name, '\.([^./]*)$', 1) AS ext, regexp_replace(name, '\.[^./]*$', '') AS stem,
       left(name, greatest(length(name) - 5, 0)) AS cut5
FROM (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages)
""")
def q_file_stem(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", T.file_name("url").alias("name"), T.file_ext("url").alias("ext"),
                    T.file_stem("url").alias("stem"), T.cut_chars(T.file_name("url"), 5).alias("cut5"))


@register("dataset_fingerprint", f"""
SELECT DISTINCT source, lang, concat_ws('_', 'teacher', '{MAX_LEN}', source, lang, 'all') AS key FROM documents
""")
def q_dataset_fingerprint(spark, d):
    docs = load(spark, d, "documents").select("source", "lang").distinct()
    return docs.select("source", "lang", T.fingerprint("teacher", MAX_LEN, F.col("source"), F.col("lang"),
                                                       "all").alias("key"))
