"""Chat formatting with Spark expressions only: no Python, pandas or RDD code runs on the executors.

``format_conversations`` collects the turns of a conversation as structs, sorts them, merges adjacent turns of
one role into a block by array functions, and joins the blocks to one string:

    <|turn|>role\\ntext<|next|>text<|end|><|turn|>...

``read_back`` parses such a string into the turns it was made of. Inside roles and texts a backslash is
doubled, and the first character of each control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>``, ``<</SYS>>``) becomes ``\\l`` (for <) or ``\\b`` (for [); a newline in a role becomes ``\\n``. So no
control string of this or those templates stands in a text, and the way back is exact.

Defined cases: null role and null text count as empty; turns are ordered by turn (null first), then role, then
text, so repeated rows are turns of their own and ties give the same result each time; a null conv_id is a
conversation of its own; other columns are ignored; an empty table gives no rows. One conversation is one
string and must fit in one value (2 GB), as the digest of a whole conversation asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, NEXT, END = "<|turn|>", "<|next|>", "<|end|>"
_LESS = r"<(?=\||/?s>|</?SYS>>)"
_BRACKET = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    c = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    c = F.regexp_replace(c, _LESS, r"\\l")
    return F.regexp_replace(c, _BRACKET, r"\\b")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    def plain(x: Column) -> Column:
        for mark, char in (("\\l", "<"), ("\\b", "["), ("\\n", "\n")):
            x = F.replace(x, F.lit(mark), F.lit(char))
        return x

    # Escapes are two characters long and begin at a backslash, so a scan from the left for doubled ones is a full parse.
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def format_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id_col, formatted string, loss_spans array<struct<start, length>>) of each conversation.

    loss_spans: code-point spans of the formatted string that hold assistant texts (start from 0); the loss mask.
    """
    t = (
        turns.groupBy(F.col(id_col).alias("id"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
        .withColumn("e", F.transform("t", lambda x: F.struct(escape_role(x["role"]).alias("role"), escape(x["text"]).alias("text"), (x["role"] == "assistant").alias("loss"))))
        .withColumn("first", F.expr("filter(sequence(0, size(e) - 1), i -> i = 0 or e[i].role <> e[greatest(i - 1, 0)].role)"))
        .withColumn("block", F.expr("transform(first, (s, k) -> slice(e, s + 1, coalesce(get(first, k + 1), size(e)) - s))"))
    )
    block = lambda b: F.concat(F.lit(TURN), b[0]["role"], F.lit("\n"), F.array_join(F.transform(b, lambda x: x["text"]), NEXT), F.lit(END))
    # Each turn's text begins after its block's head or after <|next|>; END closes a block before the next head.
    spans = F.expr(
        f"""aggregate(sequence(0, size(e) - 1), named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>)),
            (acc, i) -> named_struct(
                'at', acc.at + length(e[i].text) + if(i > 0 and e[greatest(i - 1, 0)].role = e[i].role, {len(NEXT)}, {len(TURN)} + length(e[i].role) + 1 + if(i > 0, {len(END)}, 0)),
                'spans', if(e[i].loss, array_append(acc.spans, named_struct(
                    'start', acc.at + if(i > 0 and e[greatest(i - 1, 0)].role = e[i].role, {len(NEXT)}, {len(TURN)} + length(e[i].role) + 1 + if(i > 0, {len(END)}, 0)),
                    'length', cast(length(e[i].text) as bigint))), acc.spans)),
            acc -> acc.spans)"""
    )
    return t.select(F.col("id").alias(id_col), F.array_join(F.transform("block", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted string, in order."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns_of(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        role = unescape(F.substr(head, F.lit(len(TURN) + 1)))
        return F.transform(F.split(F.substr(b, F.length(head) + 2), r"<\|next\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The digest columns of the query, all read back from the formatted strings and their loss spans."""
    joined = lambda turns: F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    under = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (
        formatted.withColumn("turns", read_back(F.col("formatted")))
        .withColumn("under", under)
        .select(
            id_col,
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(joined(F.col("turns")), 256).alias("turns_sha256"),
            F.length("under").cast("long").alias("loss_chars"),
            F.sha2(F.col("under"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )
