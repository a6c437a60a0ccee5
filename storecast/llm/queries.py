"""The dealt operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's topic is the cluster label of the embedding with its id."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sample

    return mixed_sample(table(spark, sf_dir, "documents"), topics_of(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op3_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def lengths(docs: DataFrame) -> DataFrame:
    """What packing needs of documents: their words, and as cluster the hash of the normalised text."""
    from .exact_dedup import normalised
    from .mixing import WORDS

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", "source", F.xxhash64(normalised(F.col("text"))).alias("cluster"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_tokens"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed(lengths(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeats_removed

    out = repeats_removed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import common_lines_dropped

    out = common_lines_dropped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_sample

    out = importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, and beyond them a list of the hosts whose names have one of the bad parts."""
    from .url_filter import hosts_with, judged

    pages = table(spark, sf_dir, "pages")
    return judged(pages, listed=hosts_with(pages)).select("page_id", "host", "path", "rule", "verdict")


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .infill import infilled, restored

    out = infilled(table(spark, sf_dir, "documents")).withColumn("restored", restored(F.col("output"), F.col("form")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_license_scan, op3_ctw, op4_exact_dedup, op5_packing, op6_suffix_dedup, op7_simhash, op8_toxicity, op9_line_dedup, op10_top_k,
        op11_importance, op12_url_filter, op13_infill,
    )
}

#: Whitespace and lower case of A-Z alone, as DuckDB expressions.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"



def _raking_sql() -> str:
    """The raking of op1_mixing with its rounds written out, as Spark runs them too."""
    from .mixing import DIMS, ITERATIONS, SEED, SHARE, TARGETS

    sql = """WITH topics AS (SELECT vec_id, min(CAST(label AS VARCHAR)) AS topic FROM embeddings GROUP BY 1),
rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(topic, '') AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents LEFT JOIN topics ON doc_id = vec_id),
cells AS (SELECT source, lang, topic, sum(n_tokens) AS n FROM rows GROUP BY ALL)"""
    for d in DIMS:
        want = TARGETS[d]
        share = f"CASE level {' '.join(f"WHEN '{k}' THEN {v}" for k, v in want.items())} ELSE 0 END" if isinstance(want, dict) else f"pow(size, {want})"
        sql += f""",
s_{d} AS (SELECT level, size, CAST(CASE WHEN size > 0 THEN {share} ELSE 0 END AS DOUBLE) AS share FROM (SELECT {d} AS level, CAST(sum(n) AS DOUBLE) AS size FROM cells GROUP BY 1))"""
    sql += f""",
total AS (SELECT CAST((SELECT sum(n) FROM cells) AS DOUBLE) AS every, least({SHARE} * (SELECT sum(n) FROM cells), {', '.join(f"(SELECT sum(size) FROM s_{d} WHERE share > 0)" for d in DIMS)}) AS wanted)"""
    for d in DIMS:
        sql += f""",
o_{d} AS (SELECT size, share, row_number() OVER (ORDER BY share / size DESC, level) AS place,
  (wanted - coalesce(sum(size) OVER (ORDER BY share / size DESC, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(share) OVER (ORDER BY share / size DESC, level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale FROM s_{d}, total WHERE share > 0),
t_{d} AS (SELECT level, CASE WHEN share > 0 THEN least(size, (SELECT arg_min(scale, place) FROM o_{d} WHERE scale * share <= size * (1 + 1e-12)) * share) / wanted ELSE 0 END AS t FROM s_{d}, total)"""
    sql += """,
w0 AS MATERIALIZED (SELECT cells.*, n / wanted AS cap, n / every AS w, """ + ", ".join(f"t_{d}.t AS t_{d}" for d in DIMS) + " FROM cells CROSS JOIN total " + " ".join(f"JOIN t_{d} ON cells.{d} = t_{d}.level" for d in DIMS) + ")"
    k = 0
    for _ in range(ITERATIONS):
        for d in DIMS:
            sql += f""",
w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (total, filled, free) REPLACE (CASE WHEN total <= 0 THEN 0 WHEN total >= t_{d} THEN w * t_{d} / total
  WHEN w >= cap * (1 - 1e-9) OR free <= 0 THEN w ELSE least(cap, w * (t_{d} - filled) / free) END AS w)
  FROM (SELECT *, sum(w) OVER p AS total, sum(CASE WHEN w >= cap * (1 - 1e-9) THEN w ELSE 0 END) OVER p AS filled, sum(CASE WHEN w >= cap * (1 - 1e-9) THEN 0 ELSE w END) OVER p AS free FROM w{k} WINDOW p AS (PARTITION BY {d})))"""
            k += 1
    return sql + f""",
p AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN round(least(1.0, w / cap), 6) ELSE 0 END AS probability FROM w{k})
SELECT doc_id, source, lang, topic, n_tokens, probability,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 8) AS BIGINT) / 4294967296.0 < probability AS kept
FROM rows JOIN p USING (source, lang, topic)"""


def _importance_sql() -> str:
    """CRC-32 is written out: DuckDB has none. 3988292384 is its polynomial."""
    from .importance import BUCKETS, LEAST_WORDS, PERCENT, SEED, WORDS

    words = f"unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}'))"
    return f"""
WITH crc AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
spelt AS (SELECT w, hex(w) AS x FROM (SELECT w FROM d UNION SELECT w FROM b)),
coded AS (SELECT w, xor(list_reduce(list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM spelt, crc),
own AS (SELECT bucket, count(*) AS s FROM d JOIN coded USING (w) GROUP BY 1), wanted AS (SELECT bucket, count(*) AS t FROM b JOIN coded USING (w) GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM d) + {BUCKETS}) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM b) + {BUCKETS})))) AS BIGINT) AS gain
  FROM own LEFT JOIN wanted USING (bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN coded USING (w) JOIN gains USING (bucket) GROUP BY 1),
scores AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM documents LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM scores
LEFT JOIN (SELECT * FROM drawn WHERE rank <= {PERCENT} * (SELECT count(*) FROM drawn) // 100) USING (doc_id)"""


def _url_sql() -> str:
    from .url_filter import BAD_PARTS, RULES

    rules = ", ".join(f"{{'n': {len(h + p)}, 'h': '{h}', 'p': '{p}', 'v': '{v}'}}" for v, h, p in RULES)
    part = lambda k: rf"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', {k})"
    return f"""
WITH u AS (SELECT page_id, {LOWER.format(part(1))} AS host, {part(2)} AS path FROM pages),
r AS (SELECT *, list_aggregate(list_filter([{rules}], lambda r: (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)), 'max') AS best FROM u)
SELECT page_id, host, path, best.h || best.p AS rule,
  CASE WHEN best IS NOT NULL THEN best.v WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {list(BAD_PARTS)}) THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def _infill_sql() -> str:
    from .infill import RATE, SEED, SPM

    number = lambda k: f"CAST('0x' || substr(digits, {8 * k - 7}, 8) AS BIGINT)"
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS units, sha256('{SEED}:' || doc_id) AS digits FROM documents),
c AS (SELECT *, len(units) AS n, least({number(1)} % (len(units) + 1), {number(2)} % (len(units) + 1)) AS a, greatest({number(1)} % (len(units) + 1), {number(2)} % (len(units) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {number(3)} % 100 >= {RATE} THEN 'plain' WHEN {number(4)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM t),
s AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM s"""


ORACLE_SQL = {
    "op1_mixing": _raking_sql(),
    "op11_importance": _importance_sql(),
    "op12_url_filter": _url_sql(),
    "op13_infill": _infill_sql(),
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS y FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.y) + 1), lambda i: q.y[i] * c.y[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.y) = len(c.y)
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""",
    "op9_line_dedup": f"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line, {LOWER.format(TRIM.format('lines[pos]'))} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), hot AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hot.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hot.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN hot ON l.key = hot.key GROUP BY doc_id""",
}
