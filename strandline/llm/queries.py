"""The queries of the text operators, each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from strandline.llm.common import materialise, word_count
from strandline.llm import arc, collocations, edit_embedding, gif, licenses, line_dedup, mixing, packing, quality, resampling, simhash, sstable, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sorted_string_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(_documents(spark, sf_dir), vocabulary_path())


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(_documents(spark, sf_dir))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.page_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embedding.embed_and_link(_documents(spark, sf_dir))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written sequences: their texts, and what each holds with offsets."""
    return packing.sequences(_documents(spark, sf_dir))


def op8_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _documents(spark, sf_dir).select("doc_id", "source", word_count("text").alias("words"))
    mixed = mixing.pareto_mix(materialise(sized, "mix-sizes"), size="words")  # the texts are read once
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "kept_lines", "text")


def op11_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_vertical_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sorted_string_tables, op2_gif_media, op3_arc_to_warc, op4_edit_embedding, op5_simhash_anchors, op6_license_scan, op7_best_fit_packing, op8_factorization_machine, op9_pareto_mix, op10_line_minhash, op11_attention_quality, op12_word_tries, op13_vertical_lists)}


#: Water filling of shares ``w`` of ``total`` up to ``cap`` as SQL: the rows of ``table`` with their ``share``, per ``by``.
_FILL = """{name}_1 AS (SELECT *, CASE WHEN w > 0 THEN cap / w ELSE 'inf'::DOUBLE END AS edge FROM {table}),
{name}_2 AS (SELECT *, total - coalesce(sum(cap) OVER o, 0) AS rest, sum(w) OVER (PARTITION BY {by}) - coalesce(sum(w) OVER o, 0) AS ws FROM {name}_1
  WINDOW o AS (PARTITION BY {by} ORDER BY edge, w DESC, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_3 AS (SELECT *, CASE WHEN ws > 0 THEN rest / ws ELSE 0 END AS level FROM {name}_2),
{name} AS (SELECT *, CASE WHEN edge <= level THEN cap ELSE least(cap, greatest(0.0, w * max(CASE WHEN edge > level THEN level END) OVER (PARTITION BY {by}))) END AS share FROM {name}_3)"""

_MIX = f"""WITH b AS (SELECT *, length(bin(size + 1)) - 1 AS cls FROM (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  (('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents)),
src AS (SELECT source, s, 2.0 * s AS cap, sum(s) OVER () * 1.5::DOUBLE AS total, [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 0 AS one
  FROM (SELECT source, sum(size)::DOUBLE AS s FROM b GROUP BY 1)),
{_FILL.format(name="t", table="src", by="one")},
cl AS (SELECT c.source, cls, cs, t.s AS source_size, t.share AS total, 2.0 * cs AS cap, (cls + 1) * cs AS w FROM (SELECT source, cls, sum(size)::DOUBLE AS cs FROM b GROUP BY 1, 2) c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
{_FILL.format(name="f", table="cl", by="source")},
e AS (SELECT *, least(CASE WHEN cs > 0 THEN round(share / cs, 9) ELSE 0 END, 2.0) AS e FROM f),
g AS (SELECT source, cls, source_size, total AS target, floor(e)::BIGINT AS sure, e - floor(e) AS p, total - sum(floor(e) * cs) OVER (PARTITION BY source) AS wanted FROM e),
r AS (SELECT b.doc_id, b.source, size, source_size, target, sure, wanted, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source AND b.cls = g.cls),
x AS (SELECT *, odds IS NOT NULL AND wanted > 0 AND sum(CASE WHEN odds IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size / 2 <= wanted AS extra FROM r)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (sure + extra::BIGINT) * size AS taken, source, sure + extra::BIGINT AS copies FROM x"""


#: CRC-32 of distinct words bit by bit, then bucket sums and gains.
_TRIES = """WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
f AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word FROM f),
tw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark),
d AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM w UNION SELECT word FROM tw)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INT + 1, 2))::BIGINT)), lambda c, x: xor(crcs[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM d, tab),
s AS (SELECT bucket, count(*) AS s FROM w JOIN b USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM tw JOIN b USING (word) GROUP BY 1),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain
  FROM range(10000) x(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
v AS (SELECT r, sum(gain)::BIGINT AS weight FROM w JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS score FROM f LEFT JOIN v USING (r)),
y AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS k, 10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= drawn THEN k END AS rank FROM y"""

#: Runs of words by windows over pieces, in place of lists of positions.
_PHRASES = """WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS ps FROM documents),
q AS (SELECT d, lang, unnest(ps) AS piece, unnest(range(len(ps))) AS i FROM p),
t AS (SELECT d, i, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM q),
w AS (SELECT d, i, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS place FROM t),
x AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY d, i ORDER BY place)),
f AS (SELECT lang, [w1] AS ws, count(*) AS f FROM x GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], count(*) FROM x WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM x WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM x WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY 1),
c AS (SELECT lang, ws, f AS a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) > 1),
s AS (SELECT c.lang, c.ws, a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score FROM c JOIN f l ON l.lang = c.lang AND l.ws = c.ws[:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:]),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
e AS (SELECT lang, ws, f, unnest(range(2, len(ws))) AS z FROM f WHERE len(ws) > 2),
h AS (SELECT lang, ws, f, z, unnest(range(1, len(ws) - z + 2)) AS b FROM e),
i AS (SELECT lang, ws[b:b + z - 1] AS ws, max(f) AS more FROM h GROUP BY 1, 2),
g AS (SELECT m.lang, array_to_string(m.ws, ' ') AS phrase, a, l, r, score FROM m LEFT JOIN i ON i.lang = m.lang AND i.ws = m.ws WHERE more IS NULL OR 100 * more < 80 * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM g)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op9_pareto_mix": _MIX, "op12_word_tries": _TRIES, "op13_vertical_lists": _PHRASES}
