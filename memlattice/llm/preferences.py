"""Chat formatting for preference training: one prompt from the common turns, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: The template of a turn: role, content.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
#: An opening turn that more than one in so many conversations share is dealt to several tasks; there are fewer such openings.
SHARE = 200


def conversations_of(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text>>) from rows (conv_id, turn, role, text), by turn, then role, then text.

    Repeated rows count once; null turns come first; null roles and texts are empty; a null conv_id has no conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(turn)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"], x["text"])).alias("turns"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(MIDDLE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(_head(x), x["text"], F.lit(TAIL))), "")


def loss_mask(turns: Column) -> Column:
    """Spans (code points, end exclusive) of render(turns) to learn: what the assistant says, with its end mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(_head(x))
        end = start + F.length(x["text"]) + len(TAIL)
        one = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(x["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (chosen, rejected: arrays of turns, and other columns) with prompt, completions and their masks.

    The longest common turn prefix is rendered once as prompt; what follows in each conversation is its completion,
    whose mask has what the assistant says.  Null conversations have no turns.  Equal conversations have empty
    completions.  Other columns stay, unless they have one of the new names.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    new = {"chosen": F.coalesce("chosen", none), "rejected": F.coalesce("rejected", none)}
    rows = pairs.withColumns(new)
    rows = rows.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda k: F.slice(k, F.col("n_common") + 1, F.greatest(F.lit(0), F.size(k) - F.col("n_common")))
    rows = rows.withColumns({"prompt": render(F.slice("chosen", F.lit(1), F.col("n_common"))), "chosen": rest("chosen"), "rejected": rest("rejected")})
    return rows.withColumns({"chosen_text": render(F.col("chosen")), "rejected_text": render(F.col("rejected")), "chosen_mask": loss_mask(F.col("chosen")), "rejected_mask": loss_mask(F.col("rejected"))})


def derive_pairs(turns: DataFrame) -> DataFrame:
    """(kind, chosen_id, rejected_id, chosen, rejected) from conversations without preference labels.

    stale: a conversation up to its last reply, against the same with the assistant's reply before in its place.
    sibling: of the conversations that open with the same turn, the one with most assistant text (ties: the least
    conv_id) against each other one; as many pairs as the others, never all pairs.  Conversations of a frequent opening
    are dealt by their ids to as many tasks as its share of all asks for, and the best one goes to each of these.

    No conversations give no pairs; a very long text is a text; other columns of turns are not read.
    """
    convs = conversations_of(turns).filter(F.size("turns") > 0)
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED_ROLE)
    convs = convs.withColumn("replies", at)
    last, before = F.element_at("replies", -1), F.element_at("replies", -2)
    replied = convs.filter(F.size("replies") >= 2)
    head = F.slice("turns", F.lit(1), last - 1)
    stale = replied.select(F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.slice("turns", F.lit(1), last).alias("chosen"), F.concat(head, F.array(F.element_at("turns", before))).alias("rejected"))
    said = F.aggregate(F.filter("turns", lambda x: x["role"] == TRAINED_ROLE), F.lit(0), lambda a, x: a + F.length(x["text"]))
    opened = convs.select("conv_id", "turns", F.sha2(render(F.slice("turns", 1, 1)), 256).alias("opening"), said.alias("said"))
    narrow = opened.groupBy("opening").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("said", (-F.col("conv_id")).alias("least"))).alias("best"))
    narrow = Scratch(turns.sparkSession, "preferences").save(narrow, "openings")
    total = narrow.agg(F.sum("n").alias("total"))
    parts = F.ceil(F.col("n") * SHARE / F.col("total")).cast("long").alias("parts")
    hot = narrow.join(F.broadcast(total), F.lit(True)).filter(F.col("n") * SHARE > F.col("total")).select(F.col("opening").alias("h_opening"), parts)

    def dealt(rows: DataFrame, part: Column) -> DataFrame:
        known = rows.join(F.broadcast(hot), F.col("opening") == F.col("h_opening"), "left")
        return known.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))).withColumn("part", part).drop("h_opening", "parts")

    heads = narrow.filter("n > 1").select("opening", (-F.col("best.least")).alias("chosen_id"))
    best = opened.select(F.col("conv_id").alias("b_id"), F.col("turns").alias("chosen")).join(heads, F.col("b_id") == F.col("chosen_id")).select("opening", "chosen_id", "chosen")
    every = dealt(best, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    sibling = dealt(opened, F.pmod(F.xxhash64("conv_id"), F.col("parts"))).join(every, ["opening", "part"]).filter("conv_id <> chosen_id").select(F.lit("sibling").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
    return stale.union(sibling)


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_pairs(derive_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
    trained = lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    sha = lambda k: F.sha2(k, 256).alias(f"{k}_sha256")
    return out.select("kind", "chosen_id", "rejected_id", "n_common", sha("prompt"), sha("chosen_text"), sha("rejected_text"), trained("chosen_mask").alias("chosen_trained"), trained("rejected_mask").alias("rejected_trained"))


OP4_SQL = r"""
WITH convs AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), replies AS (
  SELECT *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') AS spots,
         '<|' || turns[1].role || '|>' || chr(10) || turns[1].text AS opening,
         coalesce(list_sum(list_transform(list_filter(turns, lambda x: x.role = 'assistant'), lambda x: length(x.text))), 0) AS said FROM convs
), best AS (
  SELECT opening, arg_min(conv_id, (-said, conv_id)) AS chosen_id FROM replies GROUP BY opening HAVING count(*) > 1
), pairs AS (
  SELECT 'stale' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, list_slice(turns, 1, list_extract(spots, -1)) AS chosen, list_append(list_slice(turns, 1, list_extract(spots, -1) - 1), list_extract(turns, list_extract(spots, -2))) AS rejected FROM replies WHERE len(spots) >= 2
  UNION ALL
  SELECT 'sibling', b.chosen_id, r.conv_id, c.turns, r.turns FROM replies r JOIN best b ON r.opening = b.opening JOIN replies c ON c.conv_id = b.chosen_id WHERE r.conv_id <> b.chosen_id
), cut AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[i] <> rejected[i])) - 1, least(len(chosen), len(rejected))) AS n FROM pairs
), parts AS (
  SELECT kind, chosen_id, rejected_id, n::INTEGER AS n_common, list_slice(chosen, 1, n) AS p, list_slice(chosen, n + 1, len(chosen)) AS c, list_slice(rejected, n + 1, len(rejected)) AS r FROM cut
)
SELECT kind, chosen_id, rejected_id, n_common,
  sha256(array_to_string(list_transform(p, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')) AS prompt_sha256,
  sha256(array_to_string(list_transform(c, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')) AS chosen_text_sha256,
  sha256(array_to_string(list_transform(r, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '')) AS rejected_text_sha256,
  coalesce(list_sum(list_transform(list_filter(c, lambda x: x.role = 'assistant'), lambda x: length(x.text) + 8)), 0)::BIGINT AS chosen_trained,
  coalesce(list_sum(list_transform(list_filter(r, lambda x: x.role = 'assistant'), lambda x: length(x.text) + 8)), 0)::BIGINT AS rejected_trained
FROM parts
"""
