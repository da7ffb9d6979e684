"""Query of the conversation repair, with its SQL twin: a recursion over rows instead of ranked paths."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm import conversation_repair
from pagegauge.llm.queries import query, table

#: White space stripped before a row's last character is looked at.
_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _insert(state: str, role: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 3, 'a': {state}.a || 'I', 'r': list_append({state}.r, '{role}:')}} END"


def _least(*states: str) -> str:
    """The cheapest, then least audit; nulls are no way."""
    return f"list_min(list_filter([{', '.join(states)}], lambda z: z IS NOT NULL))"


def _stay(state: str, edit: str, role: str, cost: int, when: str) -> str:
    return (
        f"CASE WHEN {state} IS NOT NULL AND fault NOT IN ('blank', 'duplicate') AND {when} THEN "
        f"{{'c': {state}.c + {cost} + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'a': {state}.a || '{edit}', "
        f"'r': list_append({state}.r, {role} || ':' || text)}} END"
    )


def _keep(state: str, initial: str) -> str:
    return _stay(state, "K", "role", 0, f"left(role, 1) = '{initial}'")


def _rerole(state: str, role: str) -> str:
    return _stay(state, "R", f"'{role}'", 3, "true")


def _delete(state: str) -> str:
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + 4, 'a': {state}.a || 'D', 'r': {state}.r}} END"


SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(4294967295, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ord(substr(k, i::INT, 1))::BIGINT)),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 20 AS d
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(copy)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN rtrim(text, {_WHITE}) = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN right(rtrim(text, {_WHITE}), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM numbered
), ids AS (SELECT DISTINCT conv_id FROM conversations),
closed AS (
  -- Least way to each state before row i + 1: s0 nothing, s1 system, s2 user, s3 assistant last.
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, r VARCHAR[]) AS s1,
         {{'c': 3, 'a': 'I', 'r': ['user:']}} AS s2, {{'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']}} AS s3
  FROM ids
  UNION ALL
  SELECT conv_id, i, s0, s1, y2, {_least("x3", _insert("y2", "assistant"))}
  FROM (SELECT *, {_least("x2", _insert("s0", "user"), _insert("s1", "user"), _insert("x3", "user"))} AS y2
        FROM (SELECT j.conv_id, i + 1 AS i, {_delete("s0")} AS s0, {_least(_delete("s1"), _keep("s0", "s"))} AS s1,
                     {_least(_delete("s2"), *[f(s, x) for s in ("s0", "s1", "s3") for f, x in ((_keep, "u"), (_rerole, "user"))])} AS x2,
                     {_least(_delete("s3"), _keep("s2", "a"), _rerole("s2", "assistant"))} AS x3
              FROM closed JOIN judged j ON j.conv_id IS NOT DISTINCT FROM closed.conv_id AND j.n = closed.i + 1))
), ended AS (
  SELECT conv_id, {_least("s0", "s3")} AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM closed) WHERE back = 1
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, s.c::BIGINT AS cost, s.a AS audit,
       sha256(array_to_string(s.r, chr(10))) AS repaired_sha256
FROM ended LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ended.conv_id
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with one fault in five of them by their key; ``weight``: how often a row stands."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    own = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("d"),
    )
    return own.select(
        "conv_id",
        "turn",
        F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).alias("weight"),
    )


@query("op12_conversation_repair", SQL)
def conversation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest repair and its least audit for every conversation after the damage."""
    rows = damaged(table(spark, folder, "conversations"))
    return conversation_repair.digests(conversation_repair.repaired(rows, weight_col="weight"))
