"""Chat formatting in Spark expressions: turns are collected, sorted, merged by role and concatenated.

Template: ``<s>`` opens a conversation; a run of turns of one role is a block ``[ROLE:name]`` text
``[/ROLE]``, turns inside it are parted by ``<turn>``, and blocks of the loss role end with ``</s>``. No
other control string is written. In texts and role names backslash, ``[`` and ``<`` are escaped as two
backslashes, ``\\(`` and ``\\{``, in role names ``]`` as ``\\)`` too, so that no text holds a control string and
each can be read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, BLOCK, NAMED, CLOSE, BREAK, END = "<s>", "[ROLE:", "]", "[/ROLE]", "<turn>", "</s>"
LOSS_ROLE = "assistant"
NULL_ROLE = "null"


def escape(column):
    out = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("["), F.lit("\\(")), F.lit("<"), F.lit("\\{"))


def escape_role(column):
    return F.replace(escape(column), F.lit("]"), F.lit("\\)"))


def unescape(column):
    """Escaped text back: pairs of backslashes, taken from the left, part it; within the parts only escapes are left."""
    parts = F.split(column, r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(F.replace(x, F.lit("\\("), F.lit("[")), F.lit("\\{"), F.lit("<")), F.lit("\\)"), F.lit("]"))), "\\")


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss) of turns (conv_id, turn, role, text).

    loss: byte ranges (at, size) of ``formatted`` in UTF-8 that the loss mask covers, one for each turn of
    the loss role, without its markup. Turns are sorted by (turn, role, text), null first; null text is empty,
    a null role is the role ``null``, and rows of null conv_id form one conversation. An empty table gives
    an empty result. A conversation is a row of the result, so its turns meet in one task, which is what
    bounds its size.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit(NULL_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    # merged: a block for each run of turns of one role, with the array of its texts
    n = F.size("xs")
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("xs", i - 1)["role"] != F.get("xs", i)["role"]))
    found = sorted_turns.select("conv_id", "xs", begins.alias("begins"))

    def block(at, k):
        own = F.slice("xs", at + 1, F.coalesce(F.get("begins", k + 1), n) - at)
        return F.struct(F.get("xs", at)["role"].alias("role"), F.transform(own, lambda x: escape(x["text"])).alias("texts"))

    blocks = found.select("conv_id", F.transform("begins", block).alias("blocks"))

    def written(b):
        end = F.when(b["role"] == loss_role, F.lit(CLOSE + END)).otherwise(F.lit(CLOSE))
        return F.concat(F.lit(BLOCK), escape_role(b["role"]), F.lit(NAMED), F.array_join(b["texts"], BREAK), end)

    def sizes(b):
        lost, last = b["role"] == loss_role, F.size(b["texts"]) - 1
        opened = F.octet_length(escape_role(b["role"])) + len(BLOCK + NAMED)
        closed = F.when(lost, F.lit(len(CLOSE + END))).otherwise(F.lit(len(CLOSE)))
        return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, opened).otherwise(F.lit(len(BREAK))).alias("b"), F.octet_length(t).alias("t"), F.when(i == last, closed).otherwise(F.lit(0)).alias("a"), lost.alias("loss")))

    return blocks.select("conv_id", F.concat(F.lit(OPEN), F.array_join(F.transform("blocks", written), "")).alias("formatted"), F.flatten(F.transform("blocks", sizes)).alias("ss"))


def with_loss(formatted: DataFrame) -> DataFrame:
    """Adds the loss ranges, from sizes per turn: ends are running sums, over rows of turns."""
    from pyspark.sql import Window

    by = Window.partitionBy("conv_key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    key = F.struct(F.col("conv_id"))
    rows = formatted.select(key.alias("conv_key"), F.posexplode("ss").alias("i", "s"))
    rows = rows.withColumn("upto", F.sum(F.col("s.b") + F.col("s.t") + F.col("s.a")).over(by) + len(OPEN))
    spans = rows.groupBy("conv_key").agg(F.sort_array(F.collect_list(F.when(F.col("s.loss"), F.struct((F.col("upto") - F.col("s.a") - F.col("s.t")).alias("at"), F.col("s.t").cast("long").alias("size"))))).alias("loss"))
    out = formatted.withColumn("conv_key", key).join(spans, "conv_key")
    return out.select("conv_id", "formatted", "loss")


def read_turns(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """(conv_id, turns): arrays of (role, text), unescaped, from the formatted string alone.

    The string is parted at control strings, which escaped text can't hold.
    """
    body = F.substring(text, F.lit(len(OPEN) + 1), F.char_length(text))
    blocks = F.split(body, r"\[ROLE:")
    blocks = F.transform(F.filter(blocks, lambda b, i: i > 0), lambda b: F.regexp_replace(b, r"\[/ROLE\](</s>)?$", ""))

    def turns_of(block):
        cut = F.instr(block, F.lit("]"))
        role = unescape(F.substring(block, F.lit(1), cut - 1))
        texts = F.split(F.substring(block, cut + 1, F.char_length(block)), "<turn>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return formatted.select("*", F.flatten(F.transform(blocks, turns_of)).alias("turns"))


def read_loss(column="formatted", loss="loss"):
    """All text under the loss mask, in order, unescaped."""
    raw = F.encode(F.col(column), "utf-8")
    return F.array_join(F.transform(loss, lambda s: unescape(F.decode(F.substring(raw, (s["at"] + 1).cast("int"), s["size"].cast("int")), "utf-8"))), "")


def op7_chat_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all conversations and the conversation -1 of control strings, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(said).alias("text"))
    out = read_turns(with_loss(format_conversations(turns.unionByName(own))))
    lost = read_loss()
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), lost.alias("under"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars")


#: Roles in the data are plain names, so the formatted length follows from texts and role changes.
OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, 'null') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), m as (
  select *, replace(replace(replace(text, '\', '\\'), '[', '\('), '<', '\{') as esc,
         coalesce(lag(role) over w <> role, true) as first, coalesce(lead(role) over w <> role, true) as last
  from t window w as (partition by conv_id order by turn, role, text)
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       (3 + sum(length(esc) + case when first then 7 + length(role) else 6 end + case when last then 7 + case when role = 'assistant' then 4 else 0 end else 0 end))::bigint as formatted_chars
from m group by conv_id
"""
