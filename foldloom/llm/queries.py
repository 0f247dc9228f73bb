"""The text operators as queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldloom.llm import (
    decontaminate,
    html_tree,
    line_dedup,
    minhash_dedup,
    pii,
    quality,
    shard_cuts,
    token_alignment,
    token_count,
    toxicity,
    turn_repair,
    vector_dedup,
    word_table_bpe,
)
from foldloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_tree.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


#: The queries' demonstration key; a real run passes its own secret.
DEMO_KEY = "demonstration key of the queries"


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "text", "n_removed")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", F.col("matched").cast("long"), F.col("window").cast("long"))


@query
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    kinds = F.sort_array(F.array_distinct(F.col("found.kind")))
    return out.select("row.doc_id", "text", F.size("found").cast("long").alias("n_found"), F.array_join(kinds, ",").alias("kinds"))


@query
def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), absent=F.col("absent"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_cuts.byte_shards(table(spark, sf_dir, "documents"), shards=8)


ORACLES["op7_minhash_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id AS start, doc_id AS goal FROM documents UNION SELECT r.start, b.y FROM reached r JOIN both_ways b ON b.x = r.goal),
roots AS (SELECT start, min(goal) AS root FROM reached GROUP BY start)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept
FROM documents d JOIN roots ON start = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""

ORACLES["op8_decontaminate"] = r"""
WITH tokens AS (
  SELECT 'd' AS side, doc_id AS id, lower(coalesce(text, '')) AS t FROM documents UNION ALL
  SELECT 'b', item_id, lower(coalesce(text, '')) FROM benchmark),
cut AS (
  SELECT side, id, list_filter(list_transform(string_split_regex(t, '[\x20\x09-\x0D]'), lambda x: trim(x, '.,;:!?"''()[]{}*#%&$|-')), lambda x: x <> '') AS w
  FROM tokens),
placed AS (SELECT side, id, len(w) AS n, unnest(w) AS token, unnest(range(len(w))) AS pos FROM cut),
met AS (
  SELECT d.id AS doc_id, b.id AS item_id, d.pos - b.pos AS shift, b.pos AS j, least(b.n, 15) AS width
  FROM placed b JOIN placed d ON d.token = b.token AND d.side = 'd' WHERE b.side = 'b' AND (b.n >= 3 OR b.n = d.n)),
counted AS (
  SELECT doc_id, item_id, width, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND 14 FOLLOWING) AS matched
  FROM met)
SELECT doc_id, item_id, max(matched) AS matched, max(width) AS "window" FROM counted
WHERE 100 * matched >= 80 * width GROUP BY doc_id, item_id"""

ORACLES["op9_vector_dedup"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reached AS (SELECT vec_id AS start, vec_id AS goal FROM embeddings UNION SELECT r.start, l.y FROM reached r JOIN links l ON l.x = r.goal),
roots AS (SELECT start, min(goal) AS root FROM reached GROUP BY start),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN roots ON start = vec_id LEFT JOIN counts ON x = vec_id"""

# CRC-32 of a byte string given in hexadecimal (DuckDB has no such function)
CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS x)"""


def crc_sql(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)),
  lambda c, b: xor(x[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"""


# ends: running sizes of the ordered groups; search: binary search, one greedy shard a step; needed: sweep from the end
ORACLES["op13_minimax_shards"] = f"""
WITH RECURSIVE {CRC_TABLE},
rows_ AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS g FROM documents),
ends AS (SELECT g, sum(size) OVER (ORDER BY g) AS e, size AS s FROM (SELECT g, sum(size) AS size FROM rows_ GROUP BY g)),
total AS (SELECT max(e) AS t, max(s) AS m FROM ends),
search AS (
  SELECT greatest(m, (t + 7) // 8)::BIGINT AS lo, t::BIGINT AS hi, 0::BIGINT AS pos, 0 AS used, t::BIGINT AS t FROM total WHERE t IS NOT NULL
  UNION ALL
  SELECT CASE WHEN used = 8 AND pos < t THEN (lo + hi) // 2 + 1 ELSE lo END, CASE WHEN pos = t THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN pos = t OR used = 8 THEN 0 ELSE (SELECT coalesce(max(e), 0)::BIGINT FROM ends WHERE e <= pos + (lo + hi) // 2) END,
    CASE WHEN pos = t OR used = 8 THEN 0 ELSE used + 1 END, t
  FROM search WHERE lo < hi),
capacity AS (SELECT lo AS c, t FROM search WHERE lo = hi LIMIT 1),
needed AS (
  SELECT 8 AS j, t AS p, c FROM capacity
  UNION ALL SELECT j - 1, (SELECT min(e)::BIGINT FROM (SELECT e FROM ends UNION ALL SELECT 0) WHERE e >= greatest(p - c, 0)), c FROM needed WHERE j > 1),
cuts AS (
  SELECT 0 AS j, 0::BIGINT AS p, t FROM capacity
  UNION ALL
  SELECT k.j + 1, greatest(
    (SELECT coalesce(max(e), 0)::BIGINT FROM ends WHERE e <= k.p + (k.t - k.p + 7 - k.j) // (8 - k.j)),
    (SELECT min(e)::BIGINT FROM ends WHERE e > k.p), (SELECT n.p FROM needed n WHERE n.j = k.j + 1)), k.t
  FROM cuts k WHERE k.j < 7 AND k.p < k.t),
placed AS (SELECT r.*, (SELECT count(*) FROM cuts WHERE j > 0 AND p < x.e)::INT AS shard FROM rows_ r JOIN ends x ON x.g = r.g)
SELECT doc_id, size, {crc_sql('t')} AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM placed, crc_table"""


# from the last row backwards, for each state of the grammar: cost, edits and lines of the cheapest way on
_GO_ON = "[{c: 0, a: '', t: ''}, {c: 10, a: 'II', t: 'user:\nassistant:\n'}, {c: 5, a: 'I', t: 'assistant:\n'}, {c: 0, a: '', t: ''}]"


def _way(cost: str, letter: str, line: str, rest: str) -> str:
    return f"{{c: {cost} + {rest}.c, a: '{letter}' || {rest}.a, t: {line} || {rest}.t}}"


def _row_ways(q: int) -> str:
    """Cheapest edit of a row in state q (1 nothing yet, 2 after s, 3 after u, 4 after a)."""
    free, line = (4, "'assistant:' || txt || chr(10)") if q == 3 else (3, "'user:' || txt || chr(10)")
    kept = "CASE " + {1: "WHEN kind = 's' THEN 2 ", 2: "", 3: "", 4: ""}[q] + f"WHEN kind = '{'a' if q == 3 else 'u'}' THEN {free} END"
    keep = f"CASE WHEN NOT forced AND ({kept}) IS NOT NULL THEN {_way('late', 'K', 'ln', f'v[{kept}]')} END"
    rerole = f"CASE WHEN NOT forced THEN {_way('1 + late', 'R', line, f'v[{free}]')} END"
    return f"list_min([{_way('2', 'D', chr(39) * 2, f'v[{q}]')}, {keep}, {rerole}])"


def _inserted(costs: str) -> str:
    return "[" + ", ".join("list_min([w[{q}], {way}])".format(q=q, way=_way(
        "5", "I", "'assistant:' || chr(10)" if q == 3 else "'user:' || chr(10)", f"{costs}[{4 if q == 3 else 3}]")) for q in range(1, 5)) + "]"


ORACLES["op11_turn_repair"] = f"""
WITH RECURSIVE {CRC_TABLE},
fates AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0,
    {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations, crc_table),
alive AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE r0 END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS txt
  FROM fates JOIN (VALUES (0), (1)) c(copy) ON copy = 0 OR fate = 3 WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER rows_ AS i, left(role, 1) AS initial,
    lag(left(role, 1)) OVER rows_ AS prev, trim(txt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS words
  FROM alive WINDOW rows_ AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32), left(txt, 64), md5(role || chr(0) || txt))),
judged AS (
  SELECT *, CASE WHEN words = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, txt) THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
rows_ AS (
  SELECT conv_id, i, txt, role || ':' || txt || chr(10) AS ln, initial AS kind, fault IN ('blank', 'duplicate') AS forced,
    CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS late FROM judged),
sums AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prev || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
ways AS (
  SELECT conv_id, n AS i, {_GO_ON} AS v FROM sums
  UNION ALL
  SELECT conv_id, i - 1, {_inserted('x')} FROM (SELECT *, {_inserted('w')} AS x FROM (
    SELECT p.conv_id, p.i, [{', '.join(_row_ways(q) for q in range(1, 5))}] AS w
    FROM ways p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE p.i > 0)))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit,
  sha256(coalesce(left(v[1].t, length(v[1].t) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ways w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 0"""
