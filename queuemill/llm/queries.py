"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm import (byte_bpe, chat_format, decontamination, hard_negatives, ngram_join, page_wrappers, pii, sharding, spotsigs, substring_dedup, toxicity,
                           turn_repair, url_rules)
from queuemill.runtime import table

QUERIES: dict = {}
CHECKS: dict[str, str] = {}

SHARDS = 24
#: (host, path, verdict): the fixed rules of the URL query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: A deployment passes its own secret.
PSEUDONYM_KEY = "example key"
TOKENS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_spotsigs")
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op3_page_text")
def op3_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_wrappers.extract(table(spark, sf_dir, "pages"))


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


@query("op5_url_rules", sql=f"""
WITH rules(rhost, rpath, rverdict) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
parts AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
urls AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts)
SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule,
       coalesce(arg_max(rverdict, length(rhost) + length(rpath)), 'allow') AS verdict
FROM urls LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
GROUP BY page_id, host, path""")
def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest_kept(substring_dedup.deduplicate(table(spark, sf_dir, "documents"), 20))


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_groups(table(spark, sf_dir, "documents"), 4, 85)


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"))


@query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


def _crc32(text: str) -> tuple[str, str]:
    """DuckDB has no CRC: an expression over an ASCII text byte by byte, and the table of 256 remainders it reads."""
    remainders = ("list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], "
                  "lambda s, z: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END)))")
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), "
            f"lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])))", f"remainders AS (SELECT {remainders} AS t)")


_CRC, _REMAINDERS = _crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _edit(state: str, cost: str, edit: str, line: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'e': {state}.e || '{edit}', 't': {state}.t || {line}}}"


#: States of a prefix as in the operator: nothing, a system row, a user row, an assistant row is the last that stays.
_WITH_INSERTS = {"a0": "s0", "a1": "s1", "a2": _least("s2", *(_edit(s, "3", "I", "chr(10) || 'user:'") for s in ("s0", "s1", "s3"))),
                 "a3": _least("s3", _edit("s2", "3", "I", "chr(10) || 'assistant:'"))}
_LINE = "chr(10) || role || ':' || text"


def _taken(state: str, role: str) -> str:
    kept = _edit(state, "x", "K", _LINE)
    return f"CASE WHEN x > 9 THEN {{'c': 1000000000, 'e': '', 't': ''}} WHEN i = '{role[0]}' THEN {kept} ELSE {_edit(state, '3 + x', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"


@query("op11_turn_repair", sql=f"""
WITH RECURSIVE {_REMAINDERS},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS how FROM conversations, remainders),
hurt AS (
    SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
           CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM raw WHERE how <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i FROM hurt),
judged AS (
    SELECT *, CASE WHEN regexp_full_match(text, '[\x20\x09-\x0D]*') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd'
                   WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
           lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
costed AS (SELECT *, CASE fault WHEN '' THEN 0 WHEN 't' THEN 3 ELSE 10 END AS x FROM judged),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
           count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM judged GROUP BY conv_id),
walk AS (
    SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'e': '', 't': ''}} AS s0, {{'c': 1000000000::BIGINT, 'e': '', 't': ''}} AS s1,
           {{'c': 1000000000::BIGINT, 'e': '', 't': ''}} AS s2, {{'c': 1000000000::BIGINT, 'e': '', 't': ''}} AS s3 FROM counted
    UNION ALL
    SELECT conv_id, n, {_edit('a0', '4', 'D')}, {_least(_edit('a1', '4', 'D'), "CASE WHEN i = 's' AND x < 9 THEN " + _edit('a0', 'x', 'K', _LINE) + " ELSE {'c': 1000000000, 'e': '', 't': ''} END")},
           {_least(_edit('a2', '4', 'D'), *(_taken(s, 'user') for s in ('a0', 'a1', 'a3')))}, {_least(_edit('a3', '4', 'D'), _taken('a2', 'assistant'))}
    FROM (SELECT w.conv_id, j.n, j.i, j.x, j.role, j.text, {', '.join(f'{sql} AS {name}' for name, sql in _WITH_INSERTS.items())}
          FROM walk w JOIN costed j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.n = w.n + 1)),
solved AS (
    SELECT c.*, {_least('s0', 's3', _edit('s2', '3', 'I', "chr(10) || 'assistant:'"), _edit('s1', '6', 'II', "chr(10) || 'user:' || chr(10) || 'assistant:'"))} AS best
    FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.n = c.n),
named AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM named o LEFT JOIN solved s ON o.conv_id IS NOT DISTINCT FROM s.conv_id""")
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")))


#: A conversation that is nothing but the template's own marks.
HOSTILE = "\\### Assistant: </turn> ok"
_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')"


@query("op12_chat_format", sql=f"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || replace({_ESCAPED.format('role')}, ': ', ':\\ ') || ': ' || {_ESCAPED.format('text')} || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM every GROUP BY conv_id""")
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.event_log(conversations.unionByName(hostile)))


@query("op13_hard_negatives", sql="""
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS own, list_dot_product(a.v, r.v)::BIGINT AS score
    FROM vectors a JOIN vectors r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.own AND s.score * 100 BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(hard_negatives.whole_vectors(table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)
