"""Preference formatting of chat turns with Spark's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of a rendered turn; their characters are masked but for the end of a trained turn.
BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def preference_segments(
    chosen: DataFrame, rejected: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = TRAINED_ROLE
) -> DataFrame:
    """Returns (key, part, turn, role, rendered, train, mask_start, mask_end), a row for each rendered turn.

    chosen and rejected hold one row a turn. The longest common prefix of a pair ends before the first turn in which the
    two differ; its turns come once, with part "prompt". The turns from there on come with part "chosen"
    or "rejected". train is true for the turns of trained_role outside the prompt; of those, characters mask_start to mask_end
    (exclusive) of rendered count for the loss: the text and the end mark. Elsewhere both are 0, so all is masked.

    Texts joined by (turn, role) within a part make up prompt and completions; rows stay apart, so no
    conversation is gathered in one task, however many turns it has. Null roles and texts count as empty. Rows
    without key or turn can't be placed and are left out. Repeated rows of one side count once; several
    texts of one turn are compared as a set. A key that only one side has gets an empty prompt.
    Columns besides the four aren't read. Main path: DataFrame functions only.
    """

    def side(df: DataFrame, bit: int) -> DataFrame:
        clean = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role, "_role"), (text, "_text"))]
        return df.select(F.col(key).alias("_key"), F.col(turn).alias("_turn"), *clean, F.lit(bit).alias("_side")).where("_key is not null and _turn is not null")

    turns = side(chosen, 1).unionByName(side(rejected, 2)).groupBy("_key", "_turn", "_role", "_text").agg(F.bit_or("_side").alias("_sides"))
    split = turns.where("_sides <> 3").groupBy("_key").agg(F.min("_turn").alias("_split"))
    placed = turns.join(split, "_key", "left")
    common = "_split is null or _turn < _split"
    parts = F.expr(f"if({common}, array('prompt'), filter(array(if(_sides & 1 = 1, 'chosen', null), if(_sides & 2 = 2, 'rejected', null)), x -> x is not null))")
    rows = placed.select("_key", "_turn", "_role", "_text", F.explode(parts).alias("part"))
    head = F.concat(F.lit(BEGIN), F.col("_role"), F.lit("\n"))
    body = F.concat(F.col("_text"), F.lit(END))
    train = (F.col("part") != "prompt") & (F.col("_role") == trained_role)
    return rows.select(
        F.col("_key").alias(key),
        "part",
        F.col("_turn").alias("turn"),
        F.col("_role").alias("role"),
        F.concat(head, body, F.lit("\n")).alias("rendered"),
        train.alias("train"),
        F.when(train, F.length(head)).otherwise(0).alias("mask_start"),
        F.when(train, F.length(head) + F.length(body)).otherwise(0).alias("mask_end"),
    )


def cut_off(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The four columns of conversations, the last assistant turn of each cut off at half its characters: a worse answer to prefer against.

    A conversation without an assistant turn, or whose last one has no text, stays as it is, so it makes no pair with itself.
    """
    conversations = conversations.select(key, turn, role, text)
    last = conversations.where(F.col(role) == TRAINED_ROLE).groupBy(F.col(key).alias("_k")).agg(F.max(turn).alias("_last"))
    joined = conversations.join(last, F.col(key) == F.col("_k"), "left")
    half = F.expr(f"substring(`{text}`, 1, cast(floor(length(`{text}`) / 2) as int))")
    worse = (F.col(turn) == F.col("_last")) & (F.col(role) == TRAINED_ROLE)
    return joined.withColumn(text, F.when(worse, half).otherwise(F.col(text))).drop("_k", "_last")


def preference_report(conversations: DataFrame) -> DataFrame:
    """Each conversation as the chosen one, against itself with a last answer that is cut off."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    return preference_segments(turns, cut_off(turns))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM t WHERE role = '{TRAINED_ROLE}' GROUP BY conv_id),
r AS (SELECT DISTINCT conv_id, turn, role, CASE WHEN turn = last AND role = '{TRAINED_ROLE}' THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM t LEFT JOIN l USING (conv_id)),
u AS (SELECT conv_id, turn, role, text, bit_or(side) AS sides FROM (SELECT *, 1 AS side FROM t UNION ALL SELECT *, 2 FROM r) GROUP BY ALL),
d AS (SELECT conv_id, min(turn) AS split FROM u WHERE sides <> 3 GROUP BY conv_id),
p AS (SELECT u.*, split IS NULL OR turn < split AS common FROM u LEFT JOIN d USING (conv_id)),
s AS (SELECT conv_id, 'prompt' AS part, turn, role, text FROM p WHERE common
  UNION ALL SELECT conv_id, 'chosen', turn, role, text FROM p WHERE NOT common AND sides & 1 = 1
  UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM p WHERE NOT common AND sides & 2 = 2)
SELECT conv_id, part, turn, role, '{BEGIN}' || role || chr(10) || text || '{END}' || chr(10) AS rendered, part <> 'prompt' AND role = '{TRAINED_ROLE}' AS train,
  CASE WHEN part <> 'prompt' AND role = '{TRAINED_ROLE}' THEN {len(BEGIN) + 1} + length(role) ELSE 0 END AS mask_start,
  CASE WHEN part <> 'prompt' AND role = '{TRAINED_ROLE}' THEN {len(BEGIN) + 1 + len(END)} + length(role) + length(text) ELSE 0 END AS mask_end FROM s
"""
