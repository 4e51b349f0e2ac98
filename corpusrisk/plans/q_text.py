"""Query catalogue, job D: cleaning, tokenising, counting, vocabularies, vectors (on ``documents``,
``labels`` and ``pages``).  Every query reads the whole tables; each has its DuckDB spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.functions import text as tx
from corpusrisk.functions import vectors as vx
from corpusrisk.operators import corpus, vocab
from corpusrisk.operators.arrays import term_counts, token_ids
from corpusrisk.operators.prefix import dense_index
from corpusrisk.plans.tables import SQL_LABELLED_DOCS, labelled_docs, load, load_text
from corpusrisk.session import pin

MIN_OCC, MIN_DOCS = 5, 3  # vocabulary thresholds used by the catalogue
LM_VOCAB_SIZE = 10000  # top VOCAB_SIZE - 2 tokens (0 = padding, n + 1 = unknown)
SEQ_LEN = 256  # classifier sequence length (keep the last tokens, pad in front)


def sq(p: str) -> str:
    """Quote a pattern for a SQL string literal."""
    return p.replace("'", "''")


def sql_norm(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '{sq(tx.NUM_PREFIX)}') THEN '{tx.NUM_TOKEN}' WHEN {t} = '{tx.STRING_PLACEHOLDER}' THEN '{tx.STR_TOKEN}' ELSE {t} END"


def sql_strip(x: str) -> str:
    once = f"regexp_replace({x}, '{sq(tx.R_COMMENTS)}', '\\1 ', 'g')"
    return f"regexp_replace({once}, '{sq(tx.R_LITERAL_SPACE)}', '\\1', 'g')"


def sql_replace_strings(x: str) -> str:
    return f"regexp_replace({x}, '{sq(tx.R_STRING)}', ' {tx.STRING_PLACEHOLDER} ', 'g')"


def sql_denoise_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({sql_replace_strings(sql_strip(x))}, '{sq(tx.OPS_TOKEN)}', 0), lambda t: {sql_norm('t')})"


def sql_naive_tokens(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{sq(tx.NAIVE_TOKEN)}', 0), lambda t: {sql_norm('t')})"


# ----------------------------------------------------------------------------------------------
# scalar text functions


def q_fn_tokenise(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    t = tx.tokenise_raw("text")
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


SQL_FN_TOKENISE = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(text, '{sq(tx.NAIVE_TOKEN)}', 0) AS t FROM documents)
"""


def q_fn_normalise(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    t = tx.tokenise("text")
    return d.select(
        "doc_id",
        F.size(F.filter(t, lambda x: x == tx.NUM_TOKEN)).alias("n_num"),
        F.md5(F.array_join(t, " ")).alias("tokens_md5"),
    )


SQL_FN_NORMALISE = f"""
SELECT doc_id, len(list_filter(t, lambda x: x = '{tx.NUM_TOKEN}')) AS n_num, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, {sql_naive_tokens('text')} AS t FROM documents)
"""


def q_fn_tokenise_ops(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    t = tx.tokenise_ops("html")
    return p.select("page_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


SQL_FN_TOKENISE_OPS = f"""
SELECT page_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT page_id, regexp_extract_all(html, '{sq(tx.OPS_TOKEN)}', 0) AS t FROM pages)
"""


def q_fn_strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    s = tx.strip_comments("html")
    return p.select("page_id", F.length(s).alias("n_chars"), F.md5(s).alias("text_md5"))


SQL_FN_STRIP_COMMENTS = f"""
SELECT page_id, length(s) AS n_chars, md5(s) AS text_md5 FROM (SELECT page_id, {sql_strip('html')} AS s FROM pages)
"""


def q_fn_replace_strings(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    s = tx.replace_strings("html")
    return p.select("page_id", F.length(s).alias("n_chars"), F.md5(s).alias("text_md5"))


SQL_FN_REPLACE_STRINGS = f"""
SELECT page_id, length(s) AS n_chars, md5(s) AS text_md5 FROM (SELECT page_id, {sql_replace_strings('html')} AS s FROM pages)
"""


def q_fn_denoise(spark: SparkSession, sf: str) -> DataFrame:
    p = load_text(spark, sf, "pages", ["page_id", "html"])
    t = tx.denoise_tokens("html")
    return p.select("page_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("code_md5"))


SQL_FN_DENOISE = f"""
SELECT page_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS code_md5 FROM (SELECT page_id, {sql_denoise_tokens('html')} AS t FROM pages)
"""


def q_snk_corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    line = tx.corpus_line("text")
    return d.select("doc_id", F.length(line).alias("n_chars"), F.md5(line).alias("line_md5"))


SQL_SNK_CORPUS = f"""
SELECT doc_id, length(l) AS n_chars, md5(l) AS line_md5
FROM (SELECT doc_id, array_to_string({sql_denoise_tokens('text')}, ' ') || ' {tx.EOF_TOKEN}' AS l FROM documents)
"""


def q_fn_count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    t = tx.count_tokens("text")
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


SQL_FN_COUNT_TOKENS = f"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5
FROM (SELECT doc_id, regexp_extract_all(lower(text), '{sq(tx.COUNT_TOKEN)}', 0) AS t FROM documents)
"""


def q_fn_find_all(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    files, funcs = tx.find_desc_files("text"), tx.find_desc_functions("text")
    return d.select("doc_id", F.size(files).alias("n_files"), F.array_join(files, ",").alias("files"), F.size(funcs).alias("n_functions"), F.array_join(funcs, ",").alias("functions"))


# ----------------------------------------------------------------------------------------------
# counts and vocabularies over the labelled training documents


def train_tokens(spark: SparkSession, sf: str, vocab_scope: str = "train") -> DataFrame:
    """Tokens the vocabulary is fitted on: the training part (default) or, with
    ``vocab_scope='all'``, training and validation rows as the reference's search script does."""
    docs = labelled_docs(spark, sf)
    if vocab_scope == "train":
        docs = docs.filter(F.col("part") == "train")
    return vocab.explode_tokens(docs, "doc_id", tx.tokenise("text"), keep=["label"])


SQL_TRAIN_TOKENS = f"""
train_tokens AS (
  SELECT doc_id, label, p - 1 AS pos, {sql_norm('t')} AS token
  FROM ({SQL_LABELLED_DOCS}) d, unnest(regexp_extract_all(d.text, '{sq(tx.NAIVE_TOKEN)}', 0)) WITH ORDINALITY AS u(t, p)
  WHERE d.part = 'train')
"""


def q_vocab_class_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: tokens of the labelled training documents occurring >= 5 times in >= 3
    documents, with their occurrences per class."""
    agg = train_tokens(spark, sf).groupBy("token").agg(
        vocab.occurrences(), vocab.documents(), F.count_if(F.col("label") == "VULNERABLE").cast("long").alias("vulnerable_occurrences")
    )
    return vocab.vocab_threshold(agg, MIN_OCC, MIN_DOCS)


SQL_VOCAB_CLASS_COUNTS = f"""
WITH {SQL_TRAIN_TOKENS},
per_doc AS (SELECT doc_id, label, token, count(*) AS c FROM train_tokens GROUP BY doc_id, label, token)
SELECT token, sum(c)::BIGINT AS occurrences, count(*)::BIGINT AS documents,
       sum(CASE WHEN label = 'VULNERABLE' THEN c ELSE 0 END)::BIGINT AS vulnerable_occurrences
FROM per_doc GROUP BY token HAVING sum(c) >= {MIN_OCC} AND count(*) >= {MIN_DOCS}
"""


def q_agg_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.token_counts(train_tokens(spark, sf))


SQL_AGG_TOKEN_COUNTS = f"""
WITH {SQL_TRAIN_TOKENS},
per_doc AS (SELECT doc_id, token, count(*) AS c FROM train_tokens GROUP BY doc_id, token)
SELECT token, sum(c)::BIGINT AS occurrences, count(*)::BIGINT AS documents FROM per_doc GROUP BY token
"""


def q_agg_vocab_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.vocab_threshold(q_agg_token_counts(spark, sf), MIN_OCC, MIN_DOCS)


SQL_AGG_VOCAB_THRESHOLD = f"SELECT * FROM ({SQL_AGG_TOKEN_COUNTS}) WHERE occurrences >= {MIN_OCC} AND documents >= {MIN_DOCS}"


def first_seen(spark: SparkSession, sf: str) -> DataFrame:
    toks = train_tokens(spark, sf).withColumn("doc_ord", F.col("doc_id"))
    return vocab.first_seen_vocab(toks, doc_ord="doc_ord", min_occurrences=MIN_OCC, min_documents=MIN_DOCS)


def q_win_first_seen_id(spark: SparkSession, sf: str) -> DataFrame:
    return first_seen(spark, sf).select("token", "id")


SQL_FIRST_SEEN = f"""
{SQL_TRAIN_TOKENS},
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY min(doc_id * 1000000000 + pos)) - 1)::INTEGER AS id
  FROM (SELECT doc_id, token, count(*) AS c, min(pos) AS pos FROM train_tokens GROUP BY doc_id, token)
  GROUP BY token HAVING sum(c) >= {MIN_OCC} AND count(*) >= {MIN_DOCS})
"""
SQL_WIN_FIRST_SEEN_ID = f"WITH {SQL_FIRST_SEEN} SELECT token, id FROM vocab"


def all_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Every labelled document as ids of the first-seen training vocabulary (unknown = n); the
    vocabulary is fitted on the training part.  Documents are tokenised into arrays, which the
    lookup maps in place; only the vocabulary's counts are shuffled."""
    docs = pin(labelled_docs(spark, sf).select("doc_id", "part", tx.tokenise("text").alias("tokens")))
    train = vocab.explode_tokens(docs.filter(F.col("part") == "train"), "doc_id", "tokens").withColumn("doc_ord", F.col("doc_id"))
    v = pin(vocab.first_seen_vocab(train, doc_ord="doc_ord", min_occurrences=MIN_OCC, min_documents=MIN_DOCS).select("token", "id"))
    n = v.count()
    return token_ids(docs.select("doc_id", "tokens"), "tokens", v, n, out="vector"), n


def labelled_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The vectors of documents that have a token."""
    vec, n = all_vectors(spark, sf)
    return vec.filter(F.size("vector") > 0), n


def q_ft_vocab_vectorise(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_vocab_vectorise`` / ``jn_vocab``: every labelled document (train and valid) as ids of
    the training vocabulary, unknown = n."""
    vec, n = all_vectors(spark, sf)
    return vec.select(
        "doc_id",
        F.size("vector").alias("n_tokens"),
        F.size(F.filter("vector", lambda x: x == F.lit(n))).alias("n_unk"),
        F.md5(F.array_join("vector", ",")).alias("vector_md5"),
    )


SQL_FT_VOCAB_VECTORISE = f"""
WITH {SQL_FIRST_SEEN},
n AS (SELECT count(*)::INTEGER AS n FROM vocab),
toks AS (
  SELECT d.doc_id, p, {sql_norm('t')} AS token
  FROM ({SQL_LABELLED_DOCS}) d, unnest(regexp_extract_all(d.text, '{sq(tx.NAIVE_TOKEN)}', 0)) WITH ORDINALITY AS u(t, p)),
ids AS (SELECT toks.doc_id, toks.p, coalesce(vocab.id, n.n) AS id, vocab.id IS NULL AS unk FROM toks CROSS JOIN n LEFT JOIN vocab ON toks.token = vocab.token),
vec AS (SELECT doc_id, list(id ORDER BY p) AS v, count(*) FILTER (WHERE unk) AS n_unk FROM ids GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(v), 0) AS n_tokens, coalesce(n_unk, 0)::INTEGER AS n_unk,
       md5(coalesce(array_to_string(v, ','), '')) AS vector_md5
FROM ({SQL_LABELLED_DOCS}) d LEFT JOIN vec ON d.doc_id = vec.doc_id
"""


def q_fn_pad(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_pad``: keep the last SEQ_LEN ids, pad with 0 in front (sequence-classifier input)."""
    vec, _ = labelled_vectors(spark, sf)
    padded = vx.pad_front(F.col("vector"), SEQ_LEN)
    return vec.select("doc_id", F.size(padded).alias("n"), F.md5(F.array_join(padded, ",")).alias("padded_md5"))


SQL_FN_PAD = f"""
WITH {SQL_FIRST_SEEN},
n AS (SELECT count(*)::INTEGER AS n FROM vocab),
toks AS (
  SELECT d.doc_id, p, {sql_norm('t')} AS token
  FROM ({SQL_LABELLED_DOCS}) d, unnest(regexp_extract_all(d.text, '{sq(tx.NAIVE_TOKEN)}', 0)) WITH ORDINALITY AS u(t, p)),
ids AS (SELECT toks.doc_id, toks.p, coalesce(vocab.id, n.n) AS id FROM toks CROSS JOIN n LEFT JOIN vocab ON toks.token = vocab.token),
vec AS (SELECT doc_id, list(id ORDER BY p) AS v FROM ids GROUP BY doc_id),
pad AS (SELECT doc_id, CASE WHEN len(v) >= {SEQ_LEN} THEN list_slice(v, len(v) - {SEQ_LEN} + 1, len(v))
                            ELSE list_concat(list_resize([]::INTEGER[], {SEQ_LEN} - len(v), 0), v) END AS v FROM vec)
SELECT doc_id, len(v) AS n, md5(array_to_string(v, ',')) AS padded_md5 FROM pad
"""


def alpha(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = labelled_docs(spark, sf)
    toks = vocab.explode_tokens(docs, "doc_id", tx.count_tokens("text"), keep=["part", "label"])
    v = vocab.alpha_vocab(toks.filter(F.col("part") == "train"))
    return toks, v


SQL_ALPHA = f"""
ctoks AS (
  SELECT d.doc_id, d.part, d.label, t AS token
  FROM ({SQL_LABELLED_DOCS}) d, unnest(regexp_extract_all(lower(d.text), '{sq(tx.COUNT_TOKEN)}', 0)) AS u(t)),
avocab AS (SELECT token, (row_number() OVER (ORDER BY token) - 1)::INTEGER AS id FROM (SELECT DISTINCT token FROM ctoks WHERE part = 'train'))
"""


def q_win_alpha_id(spark: SparkSession, sf: str) -> DataFrame:
    return alpha(spark, sf)[1]


SQL_WIN_ALPHA_ID = f"WITH {SQL_ALPHA} SELECT token, id FROM avocab"


def q_fn_attr_name(spark: SparkSession, sf: str) -> DataFrame:
    return alpha(spark, sf)[1].select("id", tx.attr_name("token", "id").alias("attribute"))


SQL_FN_ATTR_NAME = f"WITH {SQL_ALPHA} SELECT id, 'feat_' || regexp_replace(token, '{sq(tx.NON_WORD)}', '_', 'g') || '_' || id AS attribute FROM avocab"


def bag_of_words(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, idx, cnt)`` of every labelled document over the alphabetical training vocabulary, and
    the vocabulary.  Counting is inside the row; no (document, token) pair is exchanged."""
    docs = pin(labelled_docs(spark, sf).select("doc_id", "part", tx.count_tokens("text").alias("tokens")))
    words = docs.filter(F.col("part") == "train").select(F.explode("tokens").alias("token"))
    v = pin(vocab.alpha_vocab(words))
    return term_counts(token_ids(docs.select("doc_id", "tokens"), "tokens", v, -1), "ids", "doc_id"), v


def q_ft_bow(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_bow`` / ``agg_doc_terms``: bag-of-words counts of every labelled document over the
    alphabetical training vocabulary."""
    return bag_of_words(spark, sf)[0]


SQL_FT_BOW = f"""
WITH {SQL_ALPHA}
SELECT c.doc_id, a.id AS idx, count(*)::BIGINT AS cnt FROM ctoks c JOIN avocab a ON c.token = a.token GROUP BY c.doc_id, a.id
"""


def q_snk_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """``snk_sparse``: one sparse row string per document, ``{idx cnt,...,n label}``."""
    counts, v = bag_of_words(spark, sf)
    n = v.count()
    docs = labelled_docs(spark, sf).select("doc_id", "label")
    return corpus.sparse_rows(counts, docs, n, doc="doc_id")


SQL_SNK_SPARSE = f"""
WITH {SQL_ALPHA},
cnt AS (SELECT c.doc_id, a.id AS idx, count(*) AS cnt FROM ctoks c JOIN avocab a ON c.token = a.token GROUP BY c.doc_id, a.id),
feat AS (SELECT doc_id, string_agg(idx || ' ' || cnt || ',', '' ORDER BY idx) AS f FROM cnt GROUP BY doc_id)
SELECT d.doc_id, '{{' || coalesce(f, '') || (SELECT count(*) FROM avocab) || ' ' || CASE WHEN d.label = 'VULNERABLE' THEN 1 ELSE 0 END || '}}' AS row_text
FROM ({SQL_LABELLED_DOCS}) d LEFT JOIN feat ON d.doc_id = feat.doc_id
"""


# ----------------------------------------------------------------------------------------------
# language-model corpus over all documents (corpus order = doc_id)


def lm_corpus(spark: SparkSession, sf: str) -> DataFrame:
    d = load_text(spark, sf, "documents", ["doc_id", "text"])
    # rank the keys only (range sampling reads its input in full), then attach the cleaned lines
    order = dense_index(d.select("doc_id"), ["doc_id"], out="doc_ord")
    return pin(d.select("doc_id", tx.corpus_line("text").alias("line")).join(order, "doc_id"))


SQL_LM_CORPUS = f"""
lines AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS doc_ord,
                 array_to_string({sql_denoise_tokens('text')}, ' ') || ' {tx.EOF_TOKEN}' AS line FROM documents),
vtoks AS (SELECT doc_ord, p - 1 AS pos, t AS token FROM lines, unnest(string_split(line, ' ')) WITH ORDINALITY AS u(t, p)),
lmvocab AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, min(doc_ord * 1000000000 + pos))::INTEGER AS id, count(*)::BIGINT AS occurrences
            FROM vtoks GROUP BY token ORDER BY count(*) DESC, min(doc_ord * 1000000000 + pos) LIMIT {LM_VOCAB_SIZE - 2})
"""


def q_agg_topk_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.lm_vocabulary(lm_corpus(spark, sf), LM_VOCAB_SIZE)


SQL_AGG_TOPK_VOCAB = f"WITH {SQL_LM_CORPUS} SELECT token, id, occurrences FROM lmvocab"


def q_flt_line_mod(spark: SparkSession, sf: str) -> DataFrame:
    ids = load(spark, sf, "documents").select("doc_id")
    return dense_index(ids, ["doc_id"], out="doc_ord").select("doc_id", "doc_ord", corpus.stream_of("doc_ord").alias("stream"))


SQL_FLT_LINE_MOD = f"WITH {SQL_LM_CORPUS} SELECT doc_id, doc_ord, CASE WHEN doc_ord % 100 < 5 THEN 'valid' ELSE 'train' END AS stream FROM lines"


SQL_LM_IDS = f"""
{SQL_LM_CORPUS},
n AS (SELECT count(*)::INTEGER + 1 AS unk FROM lmvocab),
ltoks AS (SELECT l.doc_ord, p - 1 AS pos, t AS token FROM lines l, unnest(regexp_extract_all(l.line, '[^{sq(tx.SPACE)}]+', 0)) WITH ORDINALITY AS u(t, p)),
lids AS (SELECT lt.doc_ord, lt.pos, coalesce(v.id, n.unk) AS id FROM ltoks lt CROSS JOIN n LEFT JOIN lmvocab v ON lt.token = v.token),
nexts AS (SELECT doc_ord, pos, id, coalesce(lead(id) OVER (PARTITION BY doc_ord ORDER BY pos), 0) AS next_id FROM lids)
"""


def q_win_next_token(spark: SparkSession, sf: str) -> DataFrame:
    """``win_next_token``: per document, each token id with the next id (0 after the last)."""
    c = lm_corpus(spark, sf)
    return corpus.next_token_ids(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE)).select("doc_ord", "pos", "id", "next_id")


SQL_WIN_NEXT_TOKEN = f"WITH {SQL_LM_IDS} SELECT doc_ord, pos, id, next_id FROM nexts"


def q_win_stream_pack(spark: SparkSession, sf: str) -> DataFrame:
    """``win_stream_pack``: the train and validation token streams cut into rows of 128."""
    c = lm_corpus(spark, sf)
    rows = corpus.pack_corpus(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE), corpus.ROW_LENGTH)
    return rows.select(
        "stream", "row", F.size(F.filter("x", lambda v: v != 0)).alias("n_nonzero"), F.md5(F.array_join("x", ",")).alias("x_md5"), F.md5(F.array_join("y", ",")).alias("y_md5")
    )


SQL_WIN_STREAM_PACK = f"""
WITH {SQL_LM_IDS},
sized AS (SELECT doc_ord, CASE WHEN doc_ord % 100 < 5 THEN 'valid' ELSE 'train' END AS stream, count(*) AS n FROM lids GROUP BY doc_ord),
offs AS (SELECT doc_ord, stream, sum(n) OVER (PARTITION BY stream ORDER BY doc_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM sized),
g AS (SELECT o.stream, coalesce(o.off, 0) + x.pos AS gp, x.id, x.next_id FROM nexts x JOIN offs o ON x.doc_ord = o.doc_ord),
r AS (SELECT stream, gp // {128} AS row, list(id ORDER BY gp) AS x, list(next_id ORDER BY gp) AS y FROM g GROUP BY stream, gp // {128}),
p AS (SELECT stream, row, list_resize(x, {128}, 0) AS x, list_resize(y, {128}, 0) AS y FROM r)
SELECT stream, row::BIGINT AS row, len(list_filter(x, lambda v: v <> 0)) AS n_nonzero, md5(array_to_string(x, ',')) AS x_md5, md5(array_to_string(y, ',')) AS y_md5 FROM p
"""


def q_win_full_batches(spark: SparkSession, sf: str) -> DataFrame:
    """``win_full_batches``: per stream the rows, the full batches of 128 rows and rows used."""
    c = lm_corpus(spark, sf)
    return corpus.batch_summary(corpus.pack_corpus(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE), corpus.ROW_LENGTH), corpus.BATCH_SIZE)


SQL_WIN_FULL_BATCHES = f"""
WITH {SQL_LM_IDS},
sized AS (SELECT CASE WHEN doc_ord % 100 < 5 THEN 'valid' ELSE 'train' END AS stream, count(*) AS n FROM lids GROUP BY doc_ord),
tot AS (SELECT stream, sum(n) AS n FROM sized GROUP BY stream)
SELECT stream, ((n + 127) // 128)::BIGINT AS n_rows, (((n + 127) // 128) // 128)::BIGINT AS n_batches,
       ((((n + 127) // 128) // 128) * 128)::BIGINT AS rows_used FROM tot
"""


def q_flt_dev_group(spark: SparkSession, sf: str) -> DataFrame:
    """``flt_dev_group``: each document's seeded group of 100 and its train / validation part."""
    from corpusrisk.plans.tables import dev_group

    d = load(spark, sf, "documents")
    g = dev_group()
    return d.select("doc_id", g.alias("grp"), F.when(g < 80, "train").otherwise("valid").alias("part"))


SQL_FLT_DEV_GROUP = """SELECT doc_id, grp, CASE WHEN grp < 80 THEN 'train' ELSE 'valid' END AS part
FROM (SELECT doc_id, ('0x' || substr(md5(concat_ws('|', '1', CAST(doc_id AS VARCHAR))), 1, 8))::BIGINT % 100 AS grp FROM documents)"""


QUERIES = {
    "flt_dev_group": (q_flt_dev_group, SQL_FLT_DEV_GROUP),
    "vocab_class_counts": (q_vocab_class_counts, SQL_VOCAB_CLASS_COUNTS),
    "fn_tokenise": (q_fn_tokenise, SQL_FN_TOKENISE),
    "fn_normalise": (q_fn_normalise, SQL_FN_NORMALISE),
    "fn_tokenise_ops": (q_fn_tokenise_ops, SQL_FN_TOKENISE_OPS),
    "fn_strip_comments": (q_fn_strip_comments, SQL_FN_STRIP_COMMENTS),
    "fn_replace_strings": (q_fn_replace_strings, SQL_FN_REPLACE_STRINGS),
    "fn_denoise": (q_fn_denoise, SQL_FN_DENOISE),
    "snk_corpus": (q_snk_corpus, SQL_SNK_CORPUS),
    "fn_count_tokens": (q_fn_count_tokens, SQL_FN_COUNT_TOKENS),
    "fn_find_all": (q_fn_find_all, None),  # Python's Unicode \b needs look-behind: RE2 has none
    "agg_token_counts": (q_agg_token_counts, SQL_AGG_TOKEN_COUNTS),
    "agg_vocab_threshold": (q_agg_vocab_threshold, SQL_AGG_VOCAB_THRESHOLD),
    "win_first_seen_id": (q_win_first_seen_id, SQL_WIN_FIRST_SEEN_ID),
    "ft_vocab_vectorise": (q_ft_vocab_vectorise, SQL_FT_VOCAB_VECTORISE),
    "fn_pad": (q_fn_pad, SQL_FN_PAD),
    "win_alpha_id": (q_win_alpha_id, SQL_WIN_ALPHA_ID),
    "fn_attr_name": (q_fn_attr_name, SQL_FN_ATTR_NAME),
    "ft_bow": (q_ft_bow, SQL_FT_BOW),
    "snk_sparse": (q_snk_sparse, SQL_SNK_SPARSE),
    "agg_topk_vocab": (q_agg_topk_vocab, SQL_AGG_TOPK_VOCAB),
    "flt_line_mod": (q_flt_line_mod, SQL_FLT_LINE_MOD),
    "win_next_token": (q_win_next_token, SQL_WIN_NEXT_TOKEN),
    "win_stream_pack": (q_win_stream_pack, SQL_WIN_STREAM_PACK),
    "win_full_batches": (q_win_full_batches, SQL_WIN_FULL_BATCHES),
}
