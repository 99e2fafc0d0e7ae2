"""Multi-party perspective rotation: each dialogue is rendered once for every participant.

Main path: DataFrame functions only.

In a participant's view that speaker is the assistant and all others are users with their names; a mask lists
the character ranges that the assistant wrote. Turns are cut into parts of ``part_turns`` consecutive turns, numbered
by a distributed running count, so that a conversation of any length is rendered by many tasks; ordinary
conversations are one part.

Markers are ``<|...|>``. A ``<|`` in a text, and a ``<|`` or ``|>`` in a role, gets a space in its middle, so no text or name
can begin a turn or end one. ``speaker`` is the role as it was.

Edge cases: a null role is the participant "unknown"; a null text is empty; turns with equal numbers stand in the
order of role and text hash, null numbers first; repeated rows are turns of their own; roles in ``silent`` (system) are
rendered in every view and have no view; a conversation of silent turns alone has no view; the null conversation is
a conversation; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_keys, shuffle_partitions

PART_TURNS = 64
#: Tasks over which the parts of a hot conversation are dealt.
SALTS = 64


def numbered(turns: DataFrame, key: str, order: list) -> DataFrame:
    """``turns`` with ``__rank``, its place from 0 within ``key`` by ``order``.

    A range sort splits also one key's rows; a part's offset is the sum of the counts before it. The row-level
    window holds one key's rows of one range partition; the offset window a row for each of them.
    """
    ranged = turns.repartitionByRange(shuffle_partitions(turns) * 4, key, *order)
    ranged = cut(ranged.withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy(key, "__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(F.struct(key, "__pid").alias("__kp"), "__before")
    ranked = ranged.withColumn("__kp", F.struct(key, "__pid"))
    ranked = ranked.withColumn("__in", F.row_number().over(Window.partitionBy("__kp").orderBy(*order)) - 1)
    return ranked.join(counts, "__kp").withColumn("__rank", F.col("__before") + F.col("__in")).drop("__kp", "__pid", "__in", "__before")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", silent: tuple = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """A row for each conversation, speaker and part: ``conv_col``, speaker, part, n_turns, text, mask
    (array of [start, end) character ranges of the speaker's own words in text)."""
    base = turns.select(
        F.struct(F.col(conv_col).isNull().alias("n"), F.col(conv_col).alias("v")).alias("__c"),
        F.col(turn_col).alias("__turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"),
    ).withColumn("__tie", F.md5("body"))
    # A struct of (is null, value) never compares to null as a whole; the plain value would.
    base = base.withColumn("__c", F.to_json("__c"))
    ranked = numbered(base, "__c", ["__turn", "role", "__tie"])
    ranked = ranked.withColumn("part", F.floor(F.col("__rank") / part_turns).cast("long"))
    parts = ranked.groupBy("__c", "part").agg(F.sort_array(F.collect_list(F.struct("__rank", "role", "body"))).alias("__turns"))
    parts = cut(parts)
    speakers = base.filter(~F.col("role").isin(*silent)).groupBy("__c", F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("__k")).drop("__k")
    # Parts of a hot conversation are dealt to SALTS tasks, to each of which its speakers go.
    hot = hot_keys(parts, "__c")
    is_hot = F.col("__c").isin(hot) if hot else F.lit(False)
    parts = parts.withColumn("__salt", F.when(is_hot, F.pmod("part", F.lit(SALTS))).otherwise(0).cast("long"))
    speakers = speakers.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))))
    views = parts.join(speakers, ["__c", "__salt"])
    name = lambda role: F.replace(F.replace(role, F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))
    said = lambda body: F.replace(body, F.lit("<|"), F.lit("< |"))
    head = lambda t: F.when(t.role == F.col("speaker"), F.lit("<|assistant|>\n")).when(t.role.isin(*silent), F.concat(F.lit("<|"), name(t.role), F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name(t.role), F.lit("|>\n")))
    pieces = F.transform("__turns", lambda t: F.struct(head(t).alias("head"), F.concat(said(t.body), F.lit("<|end|>\n")).alias("body"), (t.role == F.col("speaker")).alias("own")))
    views = views.withColumn("__pieces", pieces)
    lengths = F.transform("__pieces", lambda p: F.char_length(p.head) + F.char_length(p.body))
    views = views.withColumn("__len", lengths)
    starts = F.transform("__pieces", lambda p, i: F.struct(p.own.alias("own"), F.aggregate(F.slice("__len", F.lit(1), i), F.lit(0), lambda s, x: s + x).alias("at"), F.char_length(p.head).alias("h"), F.char_length(p.body).alias("b")))
    mask = F.transform(F.filter(starts, lambda s: s.own), lambda s: F.struct((s["at"] + s.h).alias("start"), (s["at"] + s.h + s.b).alias("end")))
    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p.head, p.body)), "")
    kind = turns.schema[conv_col].dataType.simpleString()
    conv = F.get_json_object("__c", "$.v").cast(kind)
    return views.select(conv.alias(conv_col), "speaker", "part", F.size("__turns").alias("n_turns"), text.alias("text"), mask.alias("mask"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body FROM conversations
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(body)) - 1 AS k FROM t
), s AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT r.conv_id, s.speaker, r.k // 64 AS part, r.k, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || replace(replace(role, '<|', '< |'), '|>', '| >') || '|>' END || chr(10) AS head,
         replace(body, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0 FROM p
)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::INT AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(CASE WHEN own THEN (at0 + length(head))::VARCHAR || '-' || (at0 + length(head) + length(body))::VARCHAR END, ',' ORDER BY k), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""
