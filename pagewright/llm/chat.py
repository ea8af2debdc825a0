"""Chat formatting of typed content parts, in DataFrame operations only.

A message has a list of parts: text, image, audio or document. A visitor flattens them in order: text is escaped, any
other part becomes a placeholder, an attachment reference (place, kind, address) and a count of the tokens to which the
placeholder expands. Turns are then put between control strings.

Control strings inside texts and roles are broken by ESCAPE after their first character; where a text already has
escapes there, one more is added. Removing one escape from each such place gives the text back, so no text can be
mistaken for a mark and every conversation reads back exactly.

Null texts and roles are empty, null or empty lists of parts give an empty text, parts of unknown kind count as
documents. Turns are ordered by turn (null first), then role and text; repeated rows are turns of their own. A null
conversation id is a conversation. One conversation is one row of the result, so it has to fit into memory; any number
of conversations may be equal.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The control strings, and what breaks them inside texts.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (START, SEPARATOR, END, *PLACEHOLDERS.values(), "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"

_FIRST = {f: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == f) for f in ("<", "[")}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def _each(text: Column, some: str, to: str) -> Column:
    for first, rest in _FIRST.items():
        text = F.regexp_replace(text, f"({re.escape(first)})({ESCAPE}{some})({rest})", to)
    return text


def escape(text: Column) -> Column:
    return _each(text, "*", f"$1$2{ESCAPE}$3")


def unescape(text: Column) -> Column:
    for first, rest in _FIRST.items():
        text = F.regexp_replace(text, f"({re.escape(first)}{ESCAPE}*){ESCAPE}({rest})", "$1$2")
    return text


def expanded_tokens(part: Column, patch: int = 28, per_second: float = 12.5, per_page: int = 256) -> Column:
    """Tokens of an attachment: patches of an image, frames of a sound, pages of a document. At least one."""
    patches = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    n = F.when(part["kind"] == "image", patches).when(part["kind"] == "audio", F.ceil(part["seconds"] * per_second)).otherwise(part["pages"] * per_page)
    return F.greatest(F.lit(1), F.coalesce(n, F.lit(1))).cast("long")


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def _placeholder(kind: Column) -> Column:
    return F.when(kind == "image", PLACEHOLDERS["image"]).when(kind == "audio", PLACEHOLDERS["audio"]).otherwise(PLACEHOLDERS["document"])


def chat_format(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages (conv_id, turn, role, parts) to (conv_id, formatted, loss_spans, attachments).

    loss_spans: (start, length) in characters of formatted, the contents of the turns that are learned, in order.
    attachments: (start, kind, ref, n_tokens) with start the character of the placeholder.
    """
    is_text = lambda p: F.coalesce(p["kind"], F.lit("text")) == "text"
    pieces = F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.struct(is_text(p).alias("is_text"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("n_tokens"), F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p["kind"])).alias("shown")))
    shown = messages.select("conv_id", "turn", escape(F.coalesce("role", F.lit(""))).alias("role"), F.coalesce(F.col("role").isin(*loss_roles), F.lit(False)).alias("learn"), pieces.alias("pieces"))
    body = shown.withColumn("content", F.array_join(F.transform("pieces", lambda p: p["shown"]), ""))
    # placeholders of a turn: how many characters stand before each; turns have few parts, so summing anew for each is cheap
    before = lambda i: F.aggregate(F.slice("pieces", F.lit(1), i), F.lit(0).cast("long"), lambda n, p: n + F.length(p["shown"]))
    inner = F.filter(F.transform("pieces", lambda p, i: F.struct(before(i).alias("start"), p.alias("p"))), lambda x: ~x["p"]["is_text"])
    body = body.withColumn("head", F.concat(F.lit(START), "role", F.lit(SEPARATOR))).withColumn("whole", F.concat("head", "content", F.lit(END + "\n"))).withColumn("inner", inner)
    turns = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content").rowsBetween(Window.unboundedPreceding, -1)
    at = body.withColumn("at", F.coalesce(F.sum(F.length("whole")).over(turns), F.lit(0))).withColumn("inside", F.col("at") + F.length("head"))
    row = F.struct("at", "whole", F.when(F.col("learn"), F.struct(F.col("inside").alias("start"), F.length("content").cast("long").alias("length"))).alias("span"), F.transform("inner", lambda x: F.struct((F.col("inside") + x["start"]).alias("start"), x["p"]["kind"].alias("kind"), x["p"]["ref"].alias("ref"), x["p"]["n_tokens"].alias("n_tokens"))).alias("attachments"))
    return at.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows")).select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["whole"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"),
    )


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation; placeholders stay in the text."""
    whole = F.slice(F.split(formatted, re.escape(END) + "\n"), 1, F.greatest(F.lit(0), F.size(F.split(formatted, re.escape(END) + "\n")) - 1))

    def turn(x: Column) -> Column:
        halves = F.split(F.substring(x, len(START) + 1, 2**31 - 1), re.escape(SEPARATOR), 2)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(whole, turn)


def learned(formatted: Column, spans: Column) -> Column:
    """Array of the texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
