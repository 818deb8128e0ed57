"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function=None, *, sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function
    return register(function) if function else register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP10_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
five AS (
  SELECT row_id, i, array_to_string(ws[i:i + 4], ' ') AS window_text
  FROM (SELECT row_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM split WHERE len(ws) >= 5)),
again AS (
  SELECT row_id, i FROM (SELECT *, count(*) OVER (PARTITION BY row_id, window_text) AS n FROM five) WHERE n > 1),
repeated AS (
  SELECT row_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(0, 5)) AS k) GROUP BY row_id),
measured AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeated USING (row_id)),
based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured)
SELECT *, NOT (base_failed OR 100 * n_symbols > 20 * n_words OR word_chars < 2 * n_words
               OR word_chars > 25 * n_words) AS kept
FROM based
"""


@query(sql=OP10_SQL)
def op10_quality_rules(spark, sf_dir):
    """The ledger of all documents, with the verdicts of the base and the production policy."""
    from nightwarden.llm import quality_rules as rules

    return rules.ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"), rules.passes(rules.PRODUCTION).alias("kept"))


@query
def op3_line_dedup(spark, sf_dir):
    """Every document with its lines of earlier or near occurrences taken out."""
    from nightwarden.llm import near_lines

    return near_lines.deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op9_simhash_near_dedup(spark, sf_dir):
    """Fingerprint and component of every document."""
    from nightwarden.llm import simhash

    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def vocabulary() -> str:
    """The file of the vocabulary that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op2_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its sequence of at most 2048 tokens."""
    from nightwarden.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS draw
  FROM documents),
total AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
room AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS room, 1.5::DOUBLE * (SELECT sum(size)::BIGINT FROM sized) AS goal FROM total),
level AS (
  SELECT *, (goal - coalesce(sum(cap) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(weight) OVER (ORDER BY room, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM room),
common AS (
  SELECT *, first_value(CASE WHEN room > level THEN level END IGNORE NULLS) OVER (
    ORDER BY room, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS common FROM level),
target AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN cap::DOUBLE ELSE common * weight END AS target FROM common),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM target),
rest AS (
  SELECT *, target - copies * source_size AS rest,
         CASE WHEN source_size > 0 THEN (target - copies * source_size) / source_size ELSE 0 END AS fraction FROM parts),
drawn AS (
  SELECT doc_id, size, source_size, target, copies, rest, fraction, rest.source,
         CASE WHEN size < 50 THEN 0.5::DOUBLE WHEN size < 500 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (('0x' || substr(md5('1:' || draw), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM sized JOIN rest ON sized.source IS NOT DISTINCT FROM rest.source),
placed AS (
  SELECT *, (u / (1 - u)) * (1 - fraction) AS odds FROM drawn),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (odds + fraction * weight), doc_id)::BIGINT AS upto FROM placed)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN fraction > 0 AND (2 * upto - size)::DOUBLE <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""


@query(sql=OP1_SQL)
def op1_mix_sources(spark, sf_dir):
    """What the mix of all sources takes of every document."""
    from nightwarden.llm import mixing

    return mixing.mix(mixing.sizes(table(spark, sf_dir, "documents")))


@query
def op5_wavelet_shards(spark, sf_dir):
    """Every document's stretch of the token files, read back from them."""
    from nightwarden.llm import wavelet
    from nightwarden.session import checkpoint_dir

    files = wavelet.write(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return wavelet.read(files, checkpoint_dir(spark))


@query
def op4_hash_prefix_forest(spark, sf_dir):
    """The 20 nearest found for every twentieth vector."""
    from nightwarden.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op6_personal_data(spark, sf_dir):
    """Personal data in every document."""
    from nightwarden.llm import pii

    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op7_secret_scan(spark, sf_dir):
    """Secrets in every document."""
    from nightwarden.llm import secrets

    return secrets.secrets(table(spark, sf_dir, "documents"), vocabulary=vocabulary())


@query
def op8_weak_label_quality(spark, sf_dir):
    """Posterior of the votes, score and verdict for every document."""
    from nightwarden.llm import weak_labels

    return weak_labels.classified(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH judged AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
         list_filter(string_split_regex(coalesce(d.text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM judged GROUP BY t),
known AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
         100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d, coalesce(judged.doc_id > first_id, false) AS e
  FROM judged JOIN firsts USING (t) LEFT JOIN known ON known.doc_id = judged.doc_id),
cells AS (
  SELECT part, (a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT) AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT p.f || q.f || r.f || s.f || u.f AS filter_order
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.f, q.f, r.f, s.f, u.f])) = 5),
steps AS (
  SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS bit, filter_order[step] AS f,
         list_sum(list_transform(range(1, step), lambda i: (1 << (ascii(filter_order[i]) - 65))))::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (WHERE (mask & (bit | coalesce(earlier, 0))) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & coalesce(earlier, 0)) = 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE (mask & bit) <> 0 AND (mask & coalesce(earlier, 0)) <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE (mask & bit) <> 0 AND (mask & coalesce(earlier, 0)) = 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE (mask & bit) <> 0 AND (mask & coalesce(earlier, 0)) = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


@query(sql=OP11_SQL)
def op11_filter_audit(spark, sf_dir):
    """What five filters remove from every source, in all 120 orders."""
    from nightwarden.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc_table AS (
  SELECT list(v ORDER BY n) AS crcs
  FROM (SELECT n, list_reduce(list_prepend(n, [1, 1, 1, 1, 1, 1, 1, 1]::BIGINT[]),
                              lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) AS v
        FROM (SELECT unnest(range(256)) AS n))),
shared AS (
  SELECT conv_id, own, xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
           lambda c, x: xor(c // 256, crcs[1 + xor(c % 256, x)]))) % 9 AS h
  FROM turns, crc_table),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(d.own, [])[1:s.h], s.own[s.h + 1:]) AS seq
  FROM shared s LEFT JOIN turns d ON d.conv_id = s.conv_id - s.conv_id % 5),
steps AS (SELECT conv_id, seq[1:d] AS node, d, len(seq) AS n FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(strlen(node[d].text), 0) AS saved
  FROM steps GROUP BY node, d),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
held AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (node)),
above AS (
  SELECT node[1:k] AS node, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM held) GROUP BY 1)
SELECT h.conv_id, h.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, h.n_convs, h.n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, h.ends_sha256
FROM held h JOIN above USING (node) LEFT JOIN nodes p ON h.depth > 0 AND p.node = h.node[1:h.depth - 1]
"""


@query(sql=OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    from nightwarden.llm import prefix_trie

    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


@query
def op13_page_text(spark, sf_dir):
    """Main text of every page."""
    from nightwarden.llm import page_text

    return page_text.main_text(table(spark, sf_dir, "pages"))
