"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pseudonym import PlateHasher
from ..session import shared_dir
from . import alignment, chat, codes, decontaminate, language, licenses, minhash, mixing, pii, simhash, tokens, toxicity, urls
from .common import crc32_rest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Key of the surrogates in test tables; a real one comes from a secrets manager.
TEST_KEY = "key of the surrogates in test tables"
#: Explicit rules of the url query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def query(name: str, sql: str | None = None):
    def wrap(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return wrap


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = crc32_rest(F.col("doc_id"), 3)
    model = language.learn(docs.where(rest != 1))
    return language.classify(docs, model, doc_id=F.col("doc_id"), held_out=rest == 1)


@query("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry the id of the document made of them; a page is bad if that is of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    labelled = labels.where("doc_id is not null").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad")).where("bad is not null")
    return urls.judge(table(spark, sf_dir, "pages"), labelled, URL_RULES)


@query("op3_chat_formatting", sql="""
WITH t AS (
  SELECT DISTINCT conv_id IS NULL AS none, coalesce(conv_id, 0) AS id, coalesce(turn, -9223372036854775808) AS turn,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (
  SELECT a.none, a.id, a.turn, string_agg(b.turn || chr(1) || b.role || chr(2) || b.text || chr(3), '' ORDER BY b.turn, b.role, b.text) AS so_far
  FROM (SELECT DISTINCT none, id, turn FROM t) a JOIN t b ON a.none = b.none AND a.id = b.id AND b.turn <= a.turn GROUP BY ALL),
w AS (
  SELECT none, id, count(*) AS n_turns, max(turn) AS last,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS shown
  FROM t GROUP BY ALL),
c AS (SELECT w.*, so_far FROM w JOIN p ON w.none = p.none AND w.id = p.id AND w.last = p.turn),
g AS (SELECT *, count(*) OVER (PARTITION BY so_far) AS n_copies, row_number() OVER (PARTITION BY so_far ORDER BY none, id) AS place FROM c)
SELECT CASE WHEN NOT none THEN id END AS conv_id, n_turns, n_copies, shown AS text FROM g
WHERE place = 1 AND so_far NOT IN (SELECT p.so_far FROM p JOIN w ON w.none = p.none AND w.id = p.id WHERE p.turn < w.last)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.replaced(table(spark, sf_dir, "documents"), PlateHasher(TEST_KEY))
    return out.select("row.doc_id", "text", "n_entities")


_WORDS5 = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op5_benchmark_decontamination", sql=f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS5}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_WORDS5} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
found AS (
  SELECT doc_id, i, k, item_id
  FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)) x
  JOIN wins USING (k, win)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
           FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_document_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints_and_groups(table(spark, sf_dir, "documents"))


@query("op7_simhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files in the shared folder, and the counts found in these files."""
    path = f"{shared_dir(spark)}/tokens"
    tokens.write_files(table(spark, sf_dir, "documents"), path)
    return tokens.counts(spark, path)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = toxicity.learn(docs, labels.where(crc32_rest(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, net, doc_id=F.col("doc_id"), lang=F.col("lang"), held_out=crc32_rest(F.col("doc_id"), 5) == 0)
    return toxicity.flagged(scored, net).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


@query("op10_mixing", sql=f"""
WITH d AS (
  SELECT doc_id, source IS NULL AS s_none, coalesce(source, '') AS s_name,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
s AS (SELECT s_none, s_name, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY ALL),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY s_none, s_name) - 1) % 3 + 1 AS INT)] AS weight,
  source_size * 2.0::DOUBLE AS cap, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS pool FROM s),
f AS (SELECT *,
  (pool - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    >= cap * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
  FROM r WINDOW o AS (ORDER BY cap / weight, s_none, s_name)),
g AS (SELECT *, CASE WHEN is_full THEN cap ELSE (pool - coalesce(sum(cap) FILTER (is_full) OVER (), 0)) * weight
  / sum(weight) FILTER (NOT is_full) OVER () END AS target FROM f),
p AS (SELECT d.*, source_size, target,
  coalesce(sum(size) OVER (PARTITION BY s_none, s_name ORDER BY digest, doc_id NULLS LAST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN g USING (s_none, s_name))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * ((CASE WHEN start + size / 2.0 <= target THEN 1 ELSE 0 END)
    + (CASE WHEN start + source_size + size / 2.0 <= target THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM p
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, range-sorted by the position of its first copy."""
    placed = mixing.assign(table(spark, sf_dir, "documents"))
    return (placed.repartitionByRange(F.element_at(F.concat("positions", F.array(F.lit(2.0))), 1))
            .sortWithinPartitions(F.element_at(F.concat("positions", F.array(F.lit(2.0))), 1), "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken"))


def _values(rows: list[tuple], *names: str) -> str:
    shown = lambda v: str(v) if isinstance(v, int) else "'" + v + "'" if isinstance(v, str) else "[" + ", ".join(map(shown, v)) + "]"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows) + f") v({', '.join(names)}))"


_TEMPLATES_SQL = _values([(k, t.label, t.words) for k, t in enumerate(licenses.TEMPLATES)], "tid", "label", "tw")
_PHRASES_SQL = _values([(k, place, words) for k, t in enumerate(licenses.TEMPLATES) for place, words in t.phrases], "tid", "place", "pw")
_BASE_SQL = _values([(phrase.split(), label) for phrase, label in licenses.BASE], "pw", "label")


@query("op11_license_scan", sql=f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS5}, []) AS w FROM documents),
t AS (SELECT * FROM {_TEMPLATES_SQL}),
tp AS (SELECT tid, unnest(range(0, len(tw))) AS place, unnest(tw) AS word FROM t),
o AS MATERIALIZED (SELECT row, pos, word FROM (SELECT row, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d) x WHERE word IN (SELECT word FROM tp)),
df AS (SELECT word, count(DISTINCT row) AS many FROM o GROUP BY word),
rare AS (SELECT tid, word FROM (SELECT tid, word, row_number() OVER (PARTITION BY tid ORDER BY coalesce(many, 0), word) AS r
  FROM (SELECT DISTINCT tid, word FROM tp) x LEFT JOIN df USING (word)) y WHERE r <= {licenses.FILED}),
filed AS (SELECT tid, word, place, CAST(ceil(count(*) OVER (PARTITION BY tid) * {round(licenses.AGREEING * 100)} / 100.0) AS BIGINT) AS needed FROM tp JOIN rare USING (tid, word)),
agreed AS (SELECT row, tid, pos - place AS start FROM o JOIN filed USING (word) GROUP BY row, tid, pos - place HAVING count(*) >= max(needed)),
sure AS (SELECT a.* FROM agreed a JOIN d USING (row) WHERE NOT EXISTS (SELECT 1 FROM {_PHRASES_SQL} p
  WHERE p.tid = a.tid AND (a.start + p.place < 0 OR w[a.start + p.place + 1:a.start + p.place + len(pw)] <> pw))),
met AS (SELECT row, label, max(share) AS share FROM (
  SELECT s.row, s.tid, s.start, count(*) FILTER (o.word = tp.word) * 1.0::DOUBLE / count(*) AS share
  FROM sure s JOIN tp USING (tid) LEFT JOIN o ON o.row = s.row AND o.pos = s.start + tp.place GROUP BY ALL) x JOIN t USING (tid) GROUP BY row, label),
b AS (SELECT row, label, i FROM (SELECT row, w, pw, label, unnest(range(0, len(w))) AS i FROM d, {_BASE_SQL} p WHERE list_contains(w, pw[1])) x
  WHERE w[i + 1:i + len(pw)] = pw),
bl AS (SELECT row, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY row),
al AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS share FROM (
  SELECT row, label, {licenses.BASE_SCORE}::DOUBLE AS share FROM b UNION ALL SELECT row, label, share FROM met) x GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(share, 0.0::DOUBLE) AS score
FROM d LEFT JOIN bl USING (row) LEFT JOIN al USING (row)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, doc_id=F.col("doc_id"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align(docs, doc_id=F.col("doc_id"))


def _codes_sql() -> str:
    """Five assignments and four replacements, each a common table of the one before. ``p`` has every part, ``b0`` the first codebooks."""
    steps = [f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {codes.SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT row, vec_id, label, unnest(range(0, {codes.PARTS})) AS position, v, len(v) // {codes.PARTS} AS width FROM v),
p AS MATERIALIZED (SELECT row, vec_id, label, position, x, list_inner_product(x::DOUBLE[], x::DOUBLE[]) AS xx
  FROM (SELECT *, v[position * width + 1:(position + 1) * width] AS x FROM c) y),
b0 AS MATERIALIZED (SELECT position, entry, x AS e FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry FROM p) y WHERE entry < {codes.ENTRIES})"""]
    for k in range(codes.ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT row, position, arg_min(entry, d * 1024 + entry) AS entry, min(d) AS d FROM (
  SELECT row, p.position, entry, xx - 2 * list_inner_product(x::DOUBLE[], e) + ee AS d FROM p
  JOIN (SELECT position, entry, e::DOUBLE[] AS e, list_inner_product(e::DOUBLE[], e::DOUBLE[]) AS ee FROM b{k}) b USING (position)) y GROUP BY row, position)""")
        if k < codes.ROUNDS:
            steps.append(f"""m{k} AS (SELECT position, entry, i, CAST(floor(sum(z) / count(*)) AS BIGINT) AS z FROM (
  SELECT position, entry, unnest(range(0, len(x))) AS i, unnest(x)::DOUBLE AS z FROM a{k} JOIN p USING (row, position)) y GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT position, entry, coalesce(n.e, o.e) AS e FROM b{k} o LEFT JOIN (SELECT position, entry, list(z ORDER BY i) AS e FROM m{k} GROUP BY ALL) n USING (position, entry))""")
    return ",\n".join(steps) + f""",
books AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{codes.ROUNDS}),
coded AS (SELECT row, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY position) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY row)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (row), books"""


@query("op13_vector_codes", sql=_codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return codes.compress(rows, F.col("embedding"), F.col("vec_id"), F.col("label"))
