"""Query catalogue: MDL discretisation and useless-column removal (``lineitem``), the
discretise -> forest baseline, and the n-gram language model over the document corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrisk.operators import corpus, discretise as ds, models as md, neural, ngram
from corpusrisk.operators.sparse import sparse_vectors
from corpusrisk.plans.q_text import LM_VOCAB_SIZE, SQL_ALPHA, SQL_LM_IDS, bag_of_words, lm_corpus
from corpusrisk.plans.tables import SQL_LABELLED_DOCS, dev_group, labelled_docs, load
from corpusrisk.session import broadcast_if_small, ensure_checkpoint_dir, keep, pin
from corpusrisk.sinks import writers as wr
from corpusrisk.sources import readers as rd

SEQUENCE_EPOCHS = 50

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CLASS = "l_returnflag"


def q_ft_mdl_discretise(spark: SparkSession, sf: str) -> DataFrame:
    """First-level cut per feature with its MDL decision."""
    li = load(spark, sf, "lineitem")
    hist, classes = ds.histogram(li, FEATURES, CLASS)
    b = ds.best_cuts(hist.withColumn("seg", F.lit("")), len(classes))
    return b.select("feature", "cut", "accepted")


_L = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, {CLASS} AS cls FROM lineitem" for f in FEATURES)


def _lf(x: str) -> str:
    return f"(lgamma(({x}) + 1) / ln(2))"


def _part(n: str, cs: list[str]) -> str:
    k = " + ".join(f"CASE WHEN {c} > 0 THEN 1 ELSE 0 END" for c in cs)
    binom = f"({_lf(f'{n} + ({k}) - 1')} - {_lf(f'({k}) - 1')} - {_lf(n)})"
    multi = f"({_lf(n)} - " + " - ".join(_lf(c) for c in cs) + ")"
    return f"({binom} + {multi})"


def _xl(c: str) -> str:
    return f"(CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END)"


SQL_FT_MDL_DISCRETISE = f"""
WITH long AS ({_L}),
cl AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS ci FROM (SELECT DISTINCT cls FROM long)),
h AS (SELECT feature, value, count(*) FILTER (WHERE ci = 0) AS c0, count(*) FILTER (WHERE ci = 1) AS c1, count(*) FILTER (WHERE ci = 2) AS c2
      FROM long JOIN cl USING (cls) GROUP BY feature, value),
cum AS (SELECT *, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c2) OVER w AS l2,
               sum(c0) OVER (PARTITION BY feature) AS n0, sum(c1) OVER (PARTITION BY feature) AS n1, sum(c2) OVER (PARTITION BY feature) AS n2,
               count(*) OVER (PARTITION BY feature) AS nv, lead(value) OVER (PARTITION BY feature ORDER BY value) AS nxt
        FROM h WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
c2 AS (SELECT *, n0 - l0 AS r0, n1 - l1 AS r1, n2 - l2 AS r2, l0 + l1 + l2 AS nl, n0 + n1 + n2 AS n FROM cum WHERE nxt IS NOT NULL),
c3 AS (SELECT *, n - nl AS nr FROM c2),
e AS (SELECT *, round((({_xl('nl')} - {_xl('l0')} - {_xl('l1')} - {_xl('l2')}) + ({_xl('nr')} - {_xl('r0')} - {_xl('r1')} - {_xl('r2')})) / n, {ds.TIE_DIGITS}) AS entropy FROM c3),
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY feature ORDER BY entropy, value) = 1)
SELECT feature, (value + nxt) / 2 AS cut,
       {_part('n', ['n0', 'n1', 'n2'])} - {ds.TIE} > log2(nv - 1) + {_part('nl', ['l0', 'l1', 'l2'])} + {_part('nr', ['r0', 'r1', 'r2'])} AS accepted
FROM best
"""


DAYS, SIZE_CLASS = "ship_days", "size_class"
CUT_FEATURES = ["l_quantity", "l_extendedprice", "l_tax"]
BLURRED = "blurred_quantity"  # quantity with noise: several cuts on several levels


def shipped(spark: SparkSession, sf: str) -> DataFrame:
    size = F.when(F.col("l_quantity") < 17, "few").when(F.col("l_quantity") < 34, "some").otherwise("many")
    return load(spark, sf, "lineitem").withColumn(DAYS, F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01")).cast("double")).withColumn(
        BLURRED, F.col("l_quantity").cast("double") + F.lit(100.0) * F.col("l_discount").cast("double")
    ).withColumn(SIZE_CLASS, size)


def q_ft_mdl_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_mdl_discretise`` to its last level: every accepted cut of quantity, price, tax,
    shipping day and blurred quantity for the order's size class, segments split until none is accepted."""
    return ds.fit_cuts(shipped(spark, sf), [*CUT_FEATURES, DAYS, BLURRED], SIZE_CLASS)


_CUT_VALUES = {**{f: f for f in CUT_FEATURES}, DAYS: "date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE))", BLURRED: "l_quantity::DOUBLE + 100.0 * l_discount::DOUBLE"}
_CUT_CLASS = "CASE WHEN l_quantity < 17 THEN 'few' WHEN l_quantity < 34 THEN 'some' ELSE 'many' END"
_CUT_LONG = " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({v} AS DOUBLE) AS value, {_CUT_CLASS} AS cls FROM lineitem" for f, v in _CUT_VALUES.items())
# segments (lo, hi] of each feature; an accepted best cut replaces a segment by its two halves
SQL_FT_MDL_CUTS = f"""
WITH RECURSIVE long AS ({_CUT_LONG}),
cl AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS ci FROM (SELECT DISTINCT cls FROM long)),
h AS (SELECT feature, value, count(*) FILTER (WHERE ci = 0) AS c0, count(*) FILTER (WHERE ci = 1) AS c1, count(*) FILTER (WHERE ci = 2) AS c2
      FROM long JOIN cl USING (cls) GROUP BY feature, value),
seg AS (
  SELECT DISTINCT feature, -1e300 AS lo, 1e300 AS hi, CAST(NULL AS DOUBLE) AS cut FROM h
  UNION ALL
  SELECT feature, CASE WHEN side = 0 THEN lo ELSE value END, CASE WHEN side = 0 THEN value ELSE hi END, CASE WHEN side = 0 THEN (value + nxt) / 2 END
  FROM (
    SELECT * FROM (
      SELECT *, round((({_xl('nl')} - {_xl('l0')} - {_xl('l1')} - {_xl('l2')}) + ({_xl('nr')} - {_xl('r0')} - {_xl('r1')} - {_xl('r2')})) / n, {ds.TIE_DIGITS}) AS entropy FROM (
        SELECT *, n0 - l0 AS r0, n1 - l1 AS r1, n2 - l2 AS r2, l0 + l1 + l2 AS nl, n0 + n1 + n2 AS n, n0 + n1 + n2 - l0 - l1 - l2 AS nr FROM (
          SELECT h.feature, lo, hi, value, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c2) OVER w AS l2,
                 sum(c0) OVER s AS n0, sum(c1) OVER s AS n1, sum(c2) OVER s AS n2, count(*) OVER s AS nv, lead(value) OVER (PARTITION BY h.feature, lo, hi ORDER BY value) AS nxt
          FROM h JOIN seg ON h.feature = seg.feature AND value > lo AND value <= hi
          WINDOW w AS (PARTITION BY h.feature, lo, hi ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s AS (PARTITION BY h.feature, lo, hi))
        WHERE nxt IS NOT NULL))
    QUALIFY row_number() OVER (PARTITION BY feature, lo, hi ORDER BY entropy, value) = 1), (VALUES (0), (1)) AS sides(side)
  WHERE {_part('n', ['n0', 'n1', 'n2'])} - {ds.TIE} > log2(nv - 1) + {_part('nl', ['l0', 'l1', 'l2'])} + {_part('nr', ['r0', 'r1', 'r2'])})
SELECT feature, cut FROM seg WHERE cut IS NOT NULL
"""


def q_ft_drop_useless(spark: SparkSession, sf: str) -> DataFrame:
    """Which numeric ``lineitem`` columns carry no variation."""
    li = load(spark, sf, "lineitem")
    cols = FEATURES + ["l_linenumber"]
    return ds.useless_table(li, cols)


SQL_FT_DROP_USELESS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) = max({c}) AS useless FROM lineitem" for c in FEATURES + ["l_linenumber"])


def q_ml_drf(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_drf``: MDL discretisation -> drop useless -> weighted random forest -> test metrics."""
    li = load(spark, sf, "lineitem").withColumn("y", (F.col(CLASS) == "R").cast("int")).withColumn("file", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    li = li.withColumn("_g", dev_group("l_orderkey"))
    train, test = li.filter(F.col("_g") < 80), li.filter(F.col("_g") >= 80)
    cuts = ds.fit_cuts(train, FEATURES, CLASS)
    tr, te = ds.apply_cuts(train, cuts, "b_"), ds.apply_cuts(test, cuts, "b_")
    bcols = [c for c in tr.columns if c.startswith("b_")]
    keep = [c for c in bcols if c not in set(ds.useless_columns(tr, bcols))]
    # no accepted cut: every feature is useless and the forest can only learn the class prior
    vec = F.array(*[F.col(c).cast("double") for c in keep]) if keep else F.array(F.lit(0.0))
    m, _ = md.train_and_evaluate(md.model_frame(tr.withColumn("_v", vec), "_v", "y"), md.model_frame(te.withColumn("_v", vec), "_v", "y"), {"type": "RandomForest", "n_estimators": 100, "criterion": "gini"})
    return m.withColumn("n_binary_features", F.lit(len(keep)))


def word_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labelled documents ``(doc_id, label, part)`` and their word counts over the training
    vocabulary ``(doc_id, idx, cnt, label, part)``."""
    counts, _ = bag_of_words(spark, sf)
    docs = pin(labelled_docs(spark, sf).select("doc_id", "label", "part"))
    return docs, pin(counts.join(docs, "doc_id"))


def word_cuts(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Accepted cuts of every word, fitted on the training part."""
    train = docs.filter("part = 'train'")
    hist, classes = ds.histogram_from_sparse(counts.filter("part = 'train'").select("doc_id", "idx", "cnt"), train, doc="doc_id")
    return pin(ds.fit_cuts_from_histogram(hist, len(classes)))


def q_ft_mdl_word_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_mdl_discretise`` of sparse word counts, implicit zeros included: every accepted cut."""
    return word_cuts(*word_counts(spark, sf)).select(F.col("feature").cast("long").alias("idx"), "cut")


def q_ft_mdl_word_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The binary entries of every labelled document (train and valid): word and cut it exceeds."""
    docs, counts = word_counts(spark, sf)
    index = ds.cut_index(word_cuts(docs, counts))
    entries = ds.binary_entries(counts, index, doc="doc_id")
    named = index.select("feature", F.posexplode("cuts").alias("_i", "cut"), "base").select(F.col("feature").cast("long").alias("idx"), "cut", (F.col("base") + F.col("_i")).alias("col"))
    return entries.join(named, "col").select("doc_id", "idx", "cut")


_W = [_xl(c) for c in ("nl", "l0", "l1", "nr", "r0", "r1")]
# segments (lo, hi] of each word's counts, as in SQL_FT_MDL_CUTS
SQL_WORD_CUTS = f"""
{SQL_ALPHA},
cnt AS (SELECT c.doc_id, c.part, c.label, a.id AS idx, count(*)::DOUBLE AS cnt FROM ctoks c JOIN avocab a ON c.token = a.token GROUP BY ALL),
tot AS (SELECT count(*) FILTER (label <> 'VULNERABLE') AS t0, count(*) FILTER (label = 'VULNERABLE') AS t1 FROM ({SQL_LABELLED_DOCS}) WHERE part = 'train'),
nz AS (SELECT idx, cnt AS value, count(*) FILTER (label <> 'VULNERABLE') AS c0, count(*) FILTER (label = 'VULNERABLE') AS c1 FROM cnt WHERE part = 'train' GROUP BY ALL),
zero AS (SELECT idx, 0.0 AS value, any_value(t0) - sum(c0) AS c0, any_value(t1) - sum(c1) AS c1 FROM nz, tot GROUP BY idx),
h AS (SELECT * FROM nz UNION ALL SELECT * FROM zero WHERE c0 + c1 > 0),
seg AS (
  SELECT DISTINCT idx, -1e300 AS lo, 1e300 AS hi, CAST(NULL AS DOUBLE) AS cut FROM h
  UNION ALL
  SELECT idx, CASE WHEN side = 0 THEN lo ELSE value END, CASE WHEN side = 0 THEN value ELSE hi END, CASE WHEN side = 0 THEN (value + nxt) / 2 END
  FROM (
    SELECT * FROM (
      SELECT *, round((({_W[0]} - {_W[1]} - {_W[2]}) + ({_W[3]} - {_W[4]} - {_W[5]})) / n, {ds.TIE_DIGITS}) AS entropy FROM (
        SELECT *, n0 - l0 AS r0, n1 - l1 AS r1, l0 + l1 AS nl, n0 + n1 AS n, n0 + n1 - l0 - l1 AS nr FROM (
          SELECT h.idx, lo, hi, value, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER s AS n0, sum(c1) OVER s AS n1,
                 count(*) OVER s AS nv, lead(value) OVER (PARTITION BY h.idx, lo, hi ORDER BY value) AS nxt
          FROM h JOIN seg ON h.idx = seg.idx AND value > lo AND value <= hi
          WINDOW w AS (PARTITION BY h.idx, lo, hi ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), s AS (PARTITION BY h.idx, lo, hi))
        WHERE nxt IS NOT NULL))
    QUALIFY row_number() OVER (PARTITION BY idx, lo, hi ORDER BY entropy, value) = 1), (VALUES (0), (1)) AS sides(side)
  WHERE {_part('n', ['n0', 'n1'])} - {ds.TIE} > log2(nv - 1) + {_part('nl', ['l0', 'l1'])} + {_part('nr', ['r0', 'r1'])}),
cuts AS (SELECT idx, cut FROM seg WHERE cut IS NOT NULL)
"""
SQL_FT_MDL_WORD_CUTS = f"WITH RECURSIVE {SQL_WORD_CUTS} SELECT idx::BIGINT AS idx, cut FROM cuts"
SQL_FT_MDL_WORD_ENTRIES = f"WITH RECURSIVE {SQL_WORD_CUTS} SELECT doc_id, cnt.idx::BIGINT AS idx, cut FROM cnt JOIN cuts ON cnt.idx = cuts.idx AND cnt.cnt > cuts.cut"


def q_ml_drf_words(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_drf`` on word counts: MDL cuts per word -> sparse binary vectors -> columns without variation
    dropped -> a forest of 100 trees -> metrics on the validation part."""
    docs, counts = word_counts(spark, sf)
    entries = pin(ds.binary_entries(counts, ds.cut_index(word_cuts(docs, counts)), doc="doc_id").join(docs, "doc_id"))
    train = docs.filter("part = 'train'")
    kept = pin(ds.varying_columns(entries.filter("part = 'train'"), train.count()))
    width = kept.count()
    rows = sparse_vectors(entries.join(broadcast_if_small(kept), "col"), docs, width, doc="doc_id", out=md.FEATURES)
    y = (F.col("label") == "VULNERABLE").cast("double")
    frame = pin(rows.select(F.col("doc_id").alias("file"), md.FEATURES, y.alias(md.LABEL), F.lit(1.0).alias(md.WEIGHT), "part"))
    of = lambda part: frame.filter(F.col("part") == part).drop("part")
    m, _ = md.train_and_evaluate(of("train"), of("valid"), {"type": "RandomForest", "n_estimators": md.FOREST_TREES, "criterion": "gini"})
    return m.withColumn("n_binary_features", F.lit(width))


def lm_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = lm_corpus(spark, sf)
    return corpus.next_token_ids(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE))


def q_ml_ngram_lm(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_ngram_lm``: cross-entropy (bits per token) of every validation document."""
    ids = lm_ids(spark, sf)
    model = ngram.fit(ids, LM_VOCAB_SIZE)
    return ngram.document_cross_entropy(model, ids)


SQL_NGRAM = f"""{SQL_LM_IDS},
lids2 AS (SELECT n.doc_ord, n.pos, n.id, n.next_id, CASE WHEN n.doc_ord % 100 < 5 THEN 'valid' ELSE 'train' END AS stream FROM nexts n),
bi AS (SELECT id AS v, next_id AS w, count(*) AS c_vw FROM lids2 WHERE stream = 'train' GROUP BY 1, 2),
ctx AS (SELECT v, sum(c_vw) AS c_v FROM bi GROUP BY v),
uni AS (SELECT next_id AS w, count(*) AS c_w FROM lids2 WHERE stream = 'train' GROUP BY 1),
ntr AS (SELECT count(*) AS n FROM lids2 WHERE stream = 'train'),
sc AS (SELECT p.doc_ord, p.pos,
              log2(CASE WHEN ctx.c_v IS NULL THEN (coalesce(uni.c_w, 0) + 1) / (ntr.n + {LM_VOCAB_SIZE + 2})::DOUBLE
                        ELSE {ngram.LAMBDA} * coalesce(bi.c_vw, 0) / ctx.c_v + {1 - ngram.LAMBDA!r} * (coalesce(uni.c_w, 0) + 1) / (ntr.n + {LM_VOCAB_SIZE + 2})::DOUBLE END) AS logp
       FROM lids2 p CROSS JOIN ntr LEFT JOIN bi ON p.id = bi.v AND p.next_id = bi.w LEFT JOIN ctx ON p.id = ctx.v LEFT JOIN uni ON p.next_id = uni.w
       WHERE p.stream = 'valid')
"""
SQL_ML_NGRAM_LM = f"WITH {SQL_NGRAM} SELECT doc_ord, count(*) AS n_tokens, -avg(logp) AS cross_entropy FROM sc GROUP BY doc_ord"


def q_ml_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_ngram_lm``: Kneser-Ney of order 5 on the training lines; tokens and cross-entropy (bits per
    token) of every validation document."""
    c = lm_corpus(spark, sf)
    ids = corpus.line_ids(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE)).withColumn("ids", F.col("ids").cast("array<int>"))
    # id arrays are kept, not the rows of n-grams cut from them
    lines = keep(ids.withColumn("stream", corpus.stream_of("doc_ord")))
    rows = lambda stream: ngram.ngram_rows(lines.filter(F.col("stream") == stream))
    model = ngram.fit_kneser_ney(rows("train"), LM_VOCAB_SIZE)
    return ngram.kneser_ney_cross_entropy(model, rows("valid"))


def _kneser_ney_sql(order: int = ngram.ORDER, d: float = ngram.DISCOUNT) -> str:
    lag = lambda k: "id" if k == 1 else f"coalesce(lag(id, {k - 1}) OVER (PARTITION BY doc_ord ORDER BY pos), {ngram.START})"
    ctx = lambda k: [f"p{i}" for i in range(1, k)]
    out = [
        f"{SQL_LM_IDS}",
        f"g AS (SELECT doc_ord, pos, {', '.join(f'{lag(k)} AS p{k}' for k in range(1, order))}, next_id AS w, doc_ord % 100 < 5 AS valid FROM nexts)",
        f"c{order} AS (SELECT {', '.join([*ctx(order), 'w'])}, count(*) AS c FROM g WHERE NOT valid GROUP BY ALL)",
    ]
    out += [f"c{k} AS (SELECT {', '.join([*ctx(k), 'w'])}, count(*) AS c FROM c{k + 1} GROUP BY ALL)" for k in range(order - 1, 0, -1)]
    out += [f"t{k} AS (SELECT {', '.join(ctx(k))}, sum(c) AS total, count(*) AS types FROM c{k} GROUP BY ALL)" for k in range(2, order + 1)]
    out.append(f"s1 AS (SELECT g.*, (greatest(coalesce(c, 0) - {d}, 0) + {d} * (SELECT count(*) FROM c1) / {LM_VOCAB_SIZE}) / (SELECT sum(c) FROM c1) AS p FROM g LEFT JOIN c1 ON g.w = c1.w WHERE valid)")
    for k in range(2, order + 1):
        on = lambda t, cols: " AND ".join(f"s.{x} = {t}.{x}" for x in cols)
        out.append(
            f"s{k} AS (SELECT s.* EXCLUDE (p), CASE WHEN total IS NULL THEN p ELSE (greatest(coalesce(c, 0) - {d}, 0) + {d} * types * p) / total END AS p "
            f"FROM s{k - 1} s LEFT JOIN t{k} t ON {on('t', ctx(k))} LEFT JOIN c{k} c ON {on('c', [*ctx(k), 'w'])})"
        )
    return f"WITH {', '.join(out)} SELECT doc_ord, count(*) AS n_tokens, -avg(log2(p)) AS cross_entropy FROM s{order} GROUP BY doc_ord"


SQL_ML_KNESER_NEY = _kneser_ney_sql()


def q_ml_ngram_top_next(spark: SparkSession, sf: str) -> DataFrame:
    """Most frequent next token per context in the training stream."""
    return ngram.top_next(ngram.fit(lm_ids(spark, sf), LM_VOCAB_SIZE))


SQL_ML_NGRAM_TOP_NEXT = f"WITH {SQL_NGRAM} SELECT v, arg_min(w, (-c_vw, w)) AS top_next, max(c_vw) AS count FROM bi GROUP BY v"


QUERIES = {
    "ft_mdl_discretise": (q_ft_mdl_discretise, SQL_FT_MDL_DISCRETISE),
    "ft_mdl_cuts": (q_ft_mdl_cuts, SQL_FT_MDL_CUTS),
    "ft_drop_useless": (q_ft_drop_useless, SQL_FT_DROP_USELESS),
    "ft_mdl_word_cuts": (q_ft_mdl_word_cuts, SQL_FT_MDL_WORD_CUTS),
    "ft_mdl_word_entries": (q_ft_mdl_word_entries, SQL_FT_MDL_WORD_ENTRIES),
    "ml_drf": (q_ml_drf, None),
    "ml_drf_words": (q_ml_drf_words, None),
    "ml_ngram_lm": (q_ml_ngram_lm, SQL_ML_NGRAM_LM),
    "ml_kneser_ney": (q_ml_kneser_ney, SQL_ML_KNESER_NEY),
    "ml_ngram_top_next": (q_ml_ngram_top_next, SQL_ML_NGRAM_TOP_NEXT),
}


# ---------------------------------------------------------------------------------------------- batching and sequence models

from corpusrisk.functions import text as tx  # noqa: E402
from corpusrisk.functions import vectors as vx  # noqa: E402
from corpusrisk.operators import batching, sequence_model as sqm, vocab  # noqa: E402
from corpusrisk.plans.q_text import SQL_FIRST_SEEN, labelled_vectors, sql_norm, sq  # noqa: E402
from corpusrisk.plans.tables import SQL_LABELLED_DOCS  # noqa: E402
from corpusrisk.plans.tables import labelled_docs  # noqa: E402

BATCH, STEPS = 32, 50


def classifier_vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    vec, n = labelled_vectors(spark, sf)
    docs = labelled_docs(spark, sf)
    lab = docs.select("doc_id", "part", F.when(F.col("label") == "VULNERABLE", 1).otherwise(0).alias("y"))
    return vec.join(lab, "doc_id"), n


def q_fn_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_chunk`` + ``fn_pad_right``: labelled documents in batches of 32, right-padded with the
    pad code to the batch's longest length (rounded up to 50) and cut into chunks of 50."""
    vec, n = classifier_vectors(spark, sf)
    vec = vec.select(F.col("doc_id").alias("file"), "y", F.col("vector").cast("array<int>").alias("vector"))
    b = batching.make_batches(vec, BATCH, STEPS, pad=n + 1, label="y", vector="vector")
    return b.select("batch", "slot", "file", "y", F.size("chunks").alias("n_chunks"), F.md5(F.array_join(F.flatten("chunks"), ",")).alias("chunks_md5"))


def q_fn_doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``fn_doc_chunks``: every corpus document as max(ceil(n/128), 1) rows of 128 ids, zero
    padding in front."""
    c = lm_corpus(spark, sf)
    lines = corpus.line_ids(c, corpus.lm_vocabulary(c, LM_VOCAB_SIZE))
    vec = vocab.regroup_arrays(lines.select("doc_ord", F.col("ids").cast("array<int>").alias("ids")), doc="doc_ord", out="v")
    rows = vx.front_padded_rows("v", corpus.ROW_LENGTH)
    return vec.select("doc_ord", F.size(rows).alias("n_rows"), F.md5(F.array_join(F.flatten(rows), ",")).alias("rows_md5"))


SQL_FN_DOC_CHUNKS = f"""WITH {SQL_LM_IDS},
vec AS (SELECT doc_ord, list(id ORDER BY pos) AS v FROM lids GROUP BY doc_ord),
r AS (SELECT doc_ord, v, greatest(CAST(ceil(len(v) / 128.0) AS BIGINT), 1) AS n_rows FROM vec)
SELECT doc_ord, n_rows::INTEGER AS n_rows, md5(array_to_string(list_concat(list_resize([]::INTEGER[], n_rows * 128 - len(v), 0), v), ',')) AS rows_md5 FROM r"""


NGRAM_MIN_DOCS = 3


def q_ml_sequence_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted n-gram presence classifier over the token-id vectors."""
    vec, _ = classifier_vectors(spark, sf)
    vec = pin(vec.withColumnRenamed("doc_id", "file"))
    m, _ = sqm.fit_sequence_classifier(vec.filter(F.col("part") == "train"), vec.filter(F.col("part") == "valid"), "vector", NGRAM_MIN_DOCS, pos_class_weight=2.0)
    return m


def trained_sequence(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    vec, n = classifier_vectors(spark, sf)
    vec = pin(vec.withColumnRenamed("doc_id", "file"))
    spec = neural.SequenceSpec(vocab_size=n + 1, class_weight={0: 1.0, 1: 2.0}, max_epochs=SEQUENCE_EPOCHS)
    return neural.train_and_evaluate(vec.filter(F.col("part") == "train"), vec.filter(F.col("part") == "valid"), spec, tokens="vector")


def q_ml_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_sequence``: convolutional classifier over the token-id vectors, trained with early stopping."""
    return trained_sequence(spark, sf)[0]


def q_ml_history(spark: SparkSession, sf: str) -> DataFrame:
    """``ml_history``: losses per epoch of that training, written with its run and read back."""
    m, ex, history = trained_sequence(spark, sf)
    one = lambda df: df.select(F.lit("s1").alias("split"), F.lit("r1").alias("run"), "*")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    wr.write_runs(one(m), one(ex), path, one(history))
    return rd.read_saved_history(spark, path)


def q_ft_token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_token_vectors``: the vector of every token of the labelled documents."""
    docs = labelled_docs(spark, sf).select(tx.tokenise("text").alias("tokens"))
    v = sqm.token_vectors(docs, "tokens")
    return v.select("word", *[F.col("vector")[d].alias(f"v{d}") for d in range(sqm.VECTOR_SIZE)])


SINGULAR_SIZE = 16


def q_ft_singular_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``ft_token_vectors`` by truncated singular value decomposition of the labelled documents' table: the
    vector of every token, the singular values and the share of the table they leave out."""
    docs = labelled_docs(spark, sf).select(tx.tokenise("text").alias("tokens"))
    v, found = sqm.singular_token_vectors(docs, "tokens", SINGULAR_SIZE)
    return v.withColumn("singular_values", F.array(*[F.lit(float(x)) for x in found.values])).withColumn("residual", F.lit(found.residual))


def q_ft_document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Token vectors pooled (mean, sd) per labelled document."""
    docs = labelled_docs(spark, sf).select("doc_id", tx.tokenise("text").alias("tokens"))
    dv = sqm.document_vectors(docs, "doc_id", "tokens", sqm.token_vectors(docs, "tokens"), sqm.VECTOR_SIZE)
    return dv.select("doc_id", F.size("mean_vector").alias("width"), F.size("sd_vector").alias("sd_width"))


_HALF = [f"('0x' || substr(md5('{sqm.VECTOR_SEED}|' || context), {1 + 8 * h}, 8))::BIGINT" for h in (0, 1)]
SQL_FT_TOKEN_VECTORS = f"""
WITH toks AS (SELECT d.doc_id, p, {sql_norm('t')} AS token
              FROM ({SQL_LABELLED_DOCS}) d, unnest(regexp_extract_all(d.text, '{sq(tx.NAIVE_TOKEN)}', 0)) WITH ORDINALITY AS u(t, p)),
way AS (SELECT a.token AS word, b.token AS context FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.p = a.p + 1
        UNION ALL SELECT a.token, b.token FROM toks a JOIN toks b ON a.doc_id = b.doc_id AND b.p = a.p + 2),
pairs AS (SELECT word, context, count(*) AS c FROM (SELECT word, context FROM way UNION ALL SELECT context, word FROM way) GROUP BY ALL),
words AS (SELECT word, sum(c) AS n FROM pairs GROUP BY word),
tot AS (SELECT sum(c)::DOUBLE AS total FROM pairs),
w AS (SELECT p.word, p.context, round(greatest(log2(p.c::DOUBLE * total / (a.n::DOUBLE * b.n::DOUBLE)), 0) * {sqm.VECTOR_UNIT})::BIGINT AS u
      FROM pairs p JOIN words a ON p.word = a.word JOIN words b ON p.context = b.word, tot),
h AS (SELECT word, u, {_HALF[0]} AS h0, {_HALF[1]} AS h1 FROM w WHERE u > 0)
SELECT word, {', '.join(f"sum(CASE WHEN (h{d // 32} >> {d % 32}) & 1 = 1 THEN u ELSE -u END)::BIGINT::DOUBLE / {float(sqm.VECTOR_UNIT)} AS v{d}" for d in range(sqm.VECTOR_SIZE))}
FROM h GROUP BY word
"""


SQL_FN_CHUNK = f"""
WITH {SQL_FIRST_SEEN},
nv AS (SELECT count(*)::INTEGER AS n FROM vocab),
ld AS ({SQL_LABELLED_DOCS}),
toks AS (SELECT d.doc_id, p, {sql_norm('t')} AS token FROM ld d, unnest(regexp_extract_all(d.text, '{sq(tx.NAIVE_TOKEN)}', 0)) WITH ORDINALITY AS u(t, p)),
ids AS (SELECT toks.doc_id, toks.p, coalesce(vocab.id, nv.n) AS id FROM toks CROSS JOIN nv LEFT JOIN vocab ON toks.token = vocab.token),
vec AS (SELECT doc_id, list(id ORDER BY p) AS v FROM ids GROUP BY doc_id),
d AS (SELECT vec.doc_id AS file, v, CASE WHEN ld.label = 'VULNERABLE' THEN 1 ELSE 0 END AS y FROM vec JOIN ld USING (doc_id)),
cnt AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 0) AS neg FROM d),
negs AS (SELECT file, row_number() OVER (ORDER BY md5(concat_ws('|', '1', CAST(file AS VARCHAR))), file) - 1 AS r FROM d WHERE y = 0),
kept AS (SELECT * FROM d WHERE y = 1 UNION ALL SELECT d.* FROM d JOIN negs USING (file) CROSS JOIN cnt WHERE negs.r < cnt.neg - cnt.n % {BATCH}),
b AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws('|', '1', CAST(file AS VARCHAR))), file) - 1) AS q FROM kept),
bl AS (SELECT q // {BATCH} AS batch, CAST(ceil(max(len(v)) / {STEPS}.0) * {STEPS} AS INTEGER) AS L FROM b GROUP BY q // {BATCH})
SELECT b.q // {BATCH} AS batch, CAST(b.q % {BATCH} AS INTEGER) AS slot, b.file, b.y, CAST(bl.L / {STEPS} AS INTEGER) AS n_chunks,
       md5(array_to_string(list_concat(b.v, list_resize([]::INTEGER[], bl.L - len(b.v), (SELECT n + 1 FROM nv))), ',')) AS chunks_md5
FROM b JOIN bl ON b.q // {BATCH} = bl.batch
"""


QUERIES.update(
    {
        "fn_chunk": (q_fn_chunk, SQL_FN_CHUNK),
        "fn_doc_chunks": (q_fn_doc_chunks, SQL_FN_DOC_CHUNKS),
        "ml_sequence": (q_ml_sequence, None),
        "ml_sequence_ngrams": (q_ml_sequence_ngrams, None),
        "ml_history": (q_ml_history, None),
        "ft_token_vectors": (q_ft_token_vectors, SQL_FT_TOKEN_VECTORS),
        "ft_singular_vectors": (q_ft_singular_vectors, None),
        "ft_document_vectors": (q_ft_document_vectors, None),
    }
)
