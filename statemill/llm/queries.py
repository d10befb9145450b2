"""One query per operator, with production parameters, over whole tables; DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: A parameter of the tokenizer queries: where the public vocabulary files are.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectordedup import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(spark, docs, table(spark, sf_dir, "labels").withColumn("grade", quality.grades()))
    return quality.score(docs, model).drop("text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import secrets

    model = secrets.train(secrets.default_samples(spark))
    out = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    found, own = F.col("found"), secrets.KINDS[:3]
    base = secrets.of_kind(found, *own)
    counts = [F.size(secrets.of_kind(found, k)).cast("long").alias(f"n_{k}") for k in own]
    return out.select("doc_id", *counts, F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(found).alias("spans"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenization

    with open(PIECE_MODEL, "rb") as f:
        model = f.read()
    return tokenization.token_digest(table(spark, sf_dir, "documents"), model)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out, predict, train

    docs = table(spark, sf_dir, "documents")
    model = train(spark, docs.where(~held_out()).select("text", "lang"))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    model = urlfilter.train(spark, spark.createDataFrame(urlfilter.labelled_urls(), "url string, label int"))
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), model).drop("url")


def op3_license_scan(spark: SparkSession, sf_dir: str, windows: bool = False) -> DataFrame:
    from pyspark.sql import functions as F

    from .licenses import scan

    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), windows=windows)
    best = F.coalesce(F.array_max(F.transform("licenses", lambda x: x["dice"])), F.lit(0.0))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"), F.round(best, 6).alias("best_dice"))


def op3_sql() -> str:
    """The same comparison of every unit with every template, without any pruning."""
    from .licenses import TEMPLATES, bigrams_of, words_of

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, bigrams_of(words_of(text))))}])" for name, text in TEMPLATES)
    return rf"""
WITH templates(license, grams) AS (VALUES {rows}),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
units AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS u FROM low
  UNION ALL SELECT doc_id, unnest(regexp_split_to_array(t, '\n[\t\r ]*\n')) FROM low
  UNION ALL SELECT doc_id, t FROM low
), words AS (
  SELECT doc_id, regexp_extract_all(u, '[a-z0-9]+(?:\.[a-z0-9]+)*') AS w FROM (SELECT DISTINCT doc_id, u FROM units)
), grams AS (
  SELECT doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
), scored AS (
  SELECT doc_id, license, max(2.0 * len(list_intersect(g, grams)) / (len(g) + len(grams))) AS dice FROM grams g, templates GROUP BY doc_id, license
), found AS (
  SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, max(dice) AS best FROM scored WHERE dice >= 0.8 GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, round(CAST(coalesce(best, 0) AS DOUBLE), 6) AS best_dice FROM documents d LEFT JOIN found USING (doc_id)
"""


def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with windows inside longer units; op3_license_scan keeps to the units that its SQL compares."""
    return op3_license_scan(spark, sf_dir, windows=True)


def op3_windows_sql() -> str:
    """Units as in op3_sql; windows between any two bigrams of a template that its size bounds allow, without anchors or ranks."""
    from .licenses import TEMPLATES, prepare

    head, tail = op3_sql().split(", found AS (", 1)
    bounds = ", ".join(f"({k}, {t.least}, {t.most}, '{t.name}', [{', '.join(repr(g) for g in t.bigrams)}])" for k, t in enumerate(prepare(TEMPLATES, 0.8)))
    return f"""{head}, bounds(k, least, most, license, tg) AS (VALUES {bounds}),
whole AS (
  SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p
  FROM (SELECT doc_id, regexp_extract_all(t, '[a-z0-9]+(?:\\.[a-z0-9]+)*') AS w FROM low)
), placed AS (SELECT doc_id, unnest(p) AS g, generate_subscripts(p, 1) AS pos FROM whole),
marks AS (SELECT doc_id, k, pos FROM placed JOIN (SELECT k, unnest(tg) AS g FROM bounds) USING (g)),
windows AS (
  SELECT a.doc_id, b.license, b.tg, list_distinct(p[a.pos : z.pos]) AS g
  FROM marks a JOIN marks z ON a.doc_id = z.doc_id AND a.k = z.k AND z.pos >= a.pos JOIN bounds b ON b.k = a.k AND z.pos - a.pos + 1 BETWEEN b.least AND b.most JOIN whole w ON w.doc_id = a.doc_id
), every AS (
  SELECT doc_id, license, dice FROM scored
  UNION ALL SELECT doc_id, license, 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) FROM windows
), best_of AS (SELECT doc_id, license, max(dice) AS dice FROM every GROUP BY doc_id, license), found AS ({tail.replace("FROM scored", "FROM best_of")}"""


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import jaccard_components

    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .linededup import dedup_lines

    out = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.line, u.pos, lower_key AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents) u,
       LATERAL (SELECT translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key)
), held AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.line, l.pos, h.key IS NOT NULL AND h.last <> l.doc_id AS gone FROM lines l LEFT JOIN held h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import contamination, find_matches

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(find_matches(spark, docs, table(spark, sf_dir, "benchmark")))
    return out.select("doc_id", F.col("n_words").cast("long"), "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i : i + least(13, len(w)) - 1], ' '))) AS win
  FROM items WHERE len(w) > 0
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), lengths AS (SELECT DISTINCT n FROM windows),
starts AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p0 FROM docs, lengths WHERE len(w) >= n
), hits AS (
  SELECT s.doc_id, s.p0, s.n, x.item_id FROM (SELECT doc_id, p0, n, array_to_string(w[p0 : p0 + n - 1], ' ') AS win FROM starts) s JOIN windows x ON x.n = s.n AND x.win = s.win
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p0, p0 + n)) AS p FROM (SELECT DISTINCT doc_id, p0, n FROM hits)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM words
), flat AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS s FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, r.component_id
FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op3_license_windows": op3_license_windows,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_quality": op8_quality,
    "op9_secret_scan": op9_secret_scan,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL: dict[str, str] = {"op3_license_scan": op3_sql(), "op3_license_windows": op3_windows_sql(), "op4_ngram_join": OP4_SQL, "op5_line_dedup": OP5_SQL, "op6_decontaminate": OP6_SQL}
