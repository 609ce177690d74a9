"""Preference formatting of conversations.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (equal
role and text) is rendered once, as the prompt; the turns after it are rendered as the
two completions. A turn is rendered as

    <|role|>\\n text <|end|>\\n

without the spaces, and each completion comes with its loss mask: the spans, in code points,
of the assistant turns' text and end mark. Everything else is masked out.

Tables that name no pairs still hold preferences of a kind: a conversation's own reply is a better
one than a reply from elsewhere. replies() makes such pairs: chosen is the conversation, rejected its turns
before the last assistant turn and the last assistant turn of another conversation.

Turns are ordered by number, then role and text; repeated rows of a turn are turns of their own, so a conversation that is there twice
has each turn twice, one after the other, in its prompt and completions. Null roles count as `user`, null texts as
empty. A pair of equal conversations has two empty completions. A conversation without a
partner has a null one, an empty completion and no common prefix. A turn without conversation id
belongs to none. Extra columns are ignored. A conversation, however long, is gathered into one row,
since it is rendered as one; nothing else is grouped. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order, as an array of role and text."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays of turns."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first_other = F.array_position(same, F.lit(False))
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def completion(turns: Column) -> tuple[Column, Column]:
    """The rendered turns, and "start:end" of what the loss is taken on."""
    text = F.array_join(F.transform(turns, rendered), "")
    place = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("spans"))

    def step(held: Column, turn: Column) -> Column:
        end = held["at"] + F.length(rendered(turn))
        begin = held["at"] + F.length(turn["role"]) + 5
        span = F.when(turn["role"] == "assistant", F.concat(F.when(held["spans"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), (end - 1).cast("string"))).otherwise("")
        return F.struct(end.alias("at"), F.concat(held["spans"], span).alias("spans"))

    return text, F.aggregate(turns, place, step)["spans"]


NONE = "array<struct<role:string,text:string>>"


def paired(both: DataFrame) -> DataFrame:
    """both (pair_id, chosen_id, rejected_id, and the turns of each as chosen and rejected) with prompt, completions and masks."""
    both = both.withColumns({x: F.coalesce(x, F.array().cast(NONE)) for x in ("chosen", "rejected")})
    both = both.withColumn("n", F.least(common_turns(F.col("chosen"), F.col("rejected")), F.size("chosen"), F.size("rejected")))
    rest = {x: completion(F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))) for x in ("chosen", "rejected")}
    prompt = F.array_join(F.transform(F.slice("chosen", F.lit(1), F.col("n")), rendered), "")
    return both.select("pair_id", "chosen_id", "rejected_id", F.col("n").alias("n_prompt_turns"), prompt.alias("prompt"),
        rest["chosen"][0].alias("chosen"), rest["chosen"][1].alias("chosen_mask"), rest["rejected"][0].alias("rejected"), rest["rejected"][1].alias("rejected_mask"))


def preferences(turns: DataFrame, pairs: DataFrame, **columns: str) -> DataFrame:
    """pairs (pair_id, chosen_id, rejected_id) with prompt, both completions and their masks."""
    whole = conversations(turns, **columns)
    return paired(pairs.join(whole.toDF("c", "chosen"), F.col("chosen_id") == F.col("c"), "left").join(whole.toDF("r", "rejected"), F.col("rejected_id") == F.col("r"), "left"))


def replies(turns: DataFrame, **columns: str) -> DataFrame:
    """The same of pairs made from the conversations: a row for each that has an assistant turn, by integer ids.

    pair_id and chosen_id are its id. rejected_id is that of the conversation whose last assistant
    turn is the rejected reply: 2k + 1 for 2k and 2k for 2k + 1. Where there is no such turn the rejected
    conversation ends before the reply.
    """
    whole = conversations(turns, **columns)
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), "assistant").cast("int") + 1  # one past the end if there is none
    own = whole.withColumn("at", last).where(F.col("at") <= F.size("turns"))
    other = own.select(F.col("conv_id").alias("o"), F.element_at("turns", F.col("at")).alias("reply"))
    both = own.join(other, F.col("conv_id").cast("long").bitwiseXOR(F.lit(1)) == F.col("o"), "left")
    before = F.slice("turns", F.lit(1), F.col("at") - 1)
    rejected = F.concat(before, F.when(F.col("reply").isNotNull(), F.array("reply")).otherwise(F.array().cast(NONE)))
    return paired(both.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), F.col("o").alias("rejected_id"), F.col("turns").alias("chosen"), rejected.alias("rejected")))


def neighbours(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected), for tables that don't name any."""
    ids = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("id"))
    half = F.floor(F.col("id") / 2).cast("long")
    return ids.groupBy(half.alias("pair_id")).agg(
        F.max(F.when(F.pmod("id", F.lit(2)) == 0, F.col("id"))).alias("chosen_id"), F.max(F.when(F.pmod("id", F.lit(2)) == 1, F.col("id"))).alias("rejected_id"))


#: replies() of the table conversations in DuckDB, with digests for texts.
SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, 'user'), coalesce(text, '')) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(no) AS final, arg_max(text, no) AS reply FROM t WHERE role = 'assistant' GROUP BY conv_id),
x AS (
  SELECT t.conv_id AS pair_id, 0 AS side, no, role, text FROM t JOIN l ON l.conv_id = t.conv_id
  UNION ALL SELECT t.conv_id, 1, no, role, text FROM t JOIN l ON l.conv_id = t.conv_id WHERE no < final
  UNION ALL SELECT l.conv_id, 1, l.final, 'assistant', o.reply FROM l JOIN l o ON o.conv_id = xor(l.conv_id, 1)),
m AS (
  SELECT x.*, coalesce(o.role = x.role AND o.text = x.text, FALSE) AS same FROM x LEFT JOIN x o ON o.pair_id = x.pair_id AND o.side = 1 - x.side AND o.no = x.no),
c AS (
  SELECT *, bool_and(same) OVER (PARTITION BY pair_id, side ORDER BY no ROWS UNBOUNDED PRECEDING) AS common,
    '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM m),
s AS (
  SELECT *, sum(CASE WHEN common THEN 0 ELSE length(shown) END) OVER (PARTITION BY pair_id, side ORDER BY no ROWS UNBOUNDED PRECEDING) AS upto FROM c),
g AS (
  SELECT pair_id, side, count(*) FILTER (WHERE common) AS n, string_agg(shown, '' ORDER BY no) FILTER (WHERE common) AS prompt,
    string_agg(shown, '' ORDER BY no) FILTER (WHERE NOT common) AS rest,
    string_agg((upto - length(shown) + length(role) + 5)::BIGINT || ':' || (upto - 1)::BIGINT, ',' ORDER BY no) FILTER (WHERE NOT common AND role = 'assistant') AS mask
  FROM s GROUP BY pair_id, side)
SELECT l.conv_id AS pair_id, l.conv_id AS chosen_id, o.conv_id AS rejected_id, coalesce(a.n, 0)::INT AS n_prompt_turns, sha256(coalesce(a.prompt, '')) AS prompt_sha256,
  sha256(coalesce(a.rest, '')) AS chosen_sha256, coalesce(a.mask, '') AS chosen_mask, sha256(coalesce(b.rest, '')) AS rejected_sha256, coalesce(b.mask, '') AS rejected_mask
FROM l LEFT JOIN l o ON o.conv_id = xor(l.conv_id, 1) LEFT JOIN g a ON a.pair_id = l.conv_id AND a.side = 0 LEFT JOIN g b ON b.pair_id = l.conv_id AND b.side = 1
"""
