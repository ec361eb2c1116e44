"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of one role
become one block, and blocks are concatenated:

    <|im_start|>role<|im_sep|>text<|im_turn|>text of the same role<|im_end|>\\n

``<|im_turn|>`` keeps merged turns apart, so the turns can be read back. Control strings of this
and other usual templates are broken up inside texts and roles by an escape character after
their first one, and the escape character itself is doubled; both are undone on reading.
The loss mask is a list of (start, length) spans in characters over the formatted text: the
texts of assistant turns, without any marker.

A conversation is one output value, so its turns meet in one row; that row is its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>\n"
ESCAPE = "␛"
#: Elements of an array whose running sums are built at a time.
CHUNK = 256
ASSISTANT = "assistant"
# Control strings of usual templates.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>",
           "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BROKEN = "([<\\[])(?=" + "|".join(f"\\Q{c[1:]}\\E" for c in CONTROL) + ")"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), _BROKEN, f"$1{ESCAPE}")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def _joined(array: Column, separator: str = "") -> Column:
    return F.array_join(array, separator)


def _running(numbers: Column) -> Column:
    """Sums before each element; every step copies those before it."""
    return F.aggregate(numbers, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<long>").alias("before")),
                       lambda s, n: F.struct((s["sum"] + n).alias("sum"),
                                             F.concat(s["before"], F.array(s["sum"])).alias("before")),
                       lambda s: s["before"])


def _sums(lengths: Column) -> Column:
    """Sums before each element, within chunks of ``CHUNK`` and over the chunks, so that long conversations copy little."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                         lambda k: F.slice(lengths, k * CHUNK + 1, CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, n: s + n))
    return F.flatten(F.transform(F.arrays_zip(chunks.alias("own"), _running(totals).alias("offset")),
                                 lambda z: F.transform(_running(z["own"]), lambda n: n + z["offset"])))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    Null texts and roles are empty. Rows with the same turn are all kept, in the order of role
    and text; null turns come first. Every row without a conversation is one of its own. An
    empty table gives an empty result; other columns are not read.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                         F.coalesce("text", F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    sorted_turns = clean.withColumn("alone", alone).groupBy("conv_id", "alone").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    first = F.filter(F.sequence(F.lit(0), F.size(t) - 1),
                     lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
    starts = sorted_turns.withColumn("first", first)
    blocks = starts.select("conv_id", F.transform(
        "first", lambda s, k: F.struct(
            F.get(F.col("t"), s)["role"].alias("role"),
            F.transform(F.slice(F.col("t"), s + 1, F.coalesce(F.get(F.col("first"), k + 1), F.size("t")) - s),
                        lambda x: escaped(x["text"])).alias("texts"))).alias("blocks"))
    # Pieces alternate between markers and texts, so that the places of the texts are sums of lengths.
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: F.transform(
        b["texts"], lambda x, i: F.struct(
            F.when(i == 0, F.concat(F.lit(START), escaped(b["role"]), F.lit(SEP))).otherwise(F.lit(TURN)).alias("before"),
            x.alias("text"),
            F.when(i == F.size(b["texts"]) - 1, F.lit(END)).otherwise(F.lit("")).alias("after"),
            (b["role"] == ASSISTANT).alias("loss"))))).alias("pieces"))
    lengths = pieces.withColumn("at", _sums(F.transform("pieces", lambda p: (
        F.length(p["before"]) + F.length(p["text"]) + F.length(p["after"])).cast("long"))))
    spans = F.transform(F.arrays_zip("pieces", "at"), lambda z: F.struct(
        (z["at"] + F.length(z["pieces"]["before"])).alias("start"),
        F.length(z["pieces"]["text"]).cast("long").alias("length"), z["pieces"]["loss"].alias("loss")))
    return lengths.select(
        "conv_id", _joined(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"]))).alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]),
                    lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped."""
    parts = F.split(formatted, f"\\Q{START}\\E", -1)
    blocks = F.slice(parts, 2, F.size(parts))

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, SEP, 1)
        body = F.substr(block, F.length(head) + len(SEP) + 1, F.length(block) - F.length(head) - len(SEP) - len(END))
        return F.transform(F.split(body, f"\\Q{TURN}\\E", -1),
                           lambda x: F.struct(unescaped(head).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return _joined(F.transform(spans, lambda s: unescaped(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def digests(chats: DataFrame) -> DataFrame:
    """What the output says when it is read back: turns, text under the loss mask, lengths."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    listed = _joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
