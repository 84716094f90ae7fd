"""Chat formatting with typed content parts, in built-in functions only.

Every turn holds an array of parts.  A visitor turns each part into one piece of text: text is escaped,
an image, audio clip or document becomes a placeholder, and its reference and expanded token count are
recorded with the place of the placeholder.  A conversation is the text

    <|turn|>ROLE<|says|>BODY<|over|>  for every turn, in order.

Control strings inside roles and texts are escaped with U+241B and one letter, which ``unescape`` undoes
exactly; so no text can open or close a turn.

Defined results: null text or parts are empty; a null role is the empty role; turns of one number are
ordered by role, then body; repeated rows are repeated turns; rows of a null conversation form one
conversation; an unknown kind of part gets the placeholder ``<|file|>`` and no tokens; without rows there
are no conversations; columns other than the named ones are ignored.  A conversation is one value, so its
turns meet in one task, as rows, not as copies of the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPE = "␛"
#: What may not stand in a text; each is written as ESCAPE and its letter.
CONTROL = {"a": "<|", "b": "|>", "c": "</s>", "d": "<s>", "e": "[/INST]", "f": "[INST]", "g": "<</SYS>>", "h": "<<SYS>>"}
TURN, SAYS, OVER = "<|turn|>", "<|says|>", "<|over|>"
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,millis:bigint,pages:int>"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[1]), F.lit(ESCAPE + kv[0])), CONTROL.items(), c)


def unescape(c: Column) -> Column:
    c = reduce(lambda x, kv: F.replace(x, F.lit(ESCAPE + kv[0]), F.lit(kv[1])), CONTROL.items(), c)
    return F.replace(c, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


class PartVisitor:
    """One method for each kind of part: the piece of text it leaves and the tokens it expands to.

    image: one token for each patch of ``patch`` pixels square; audio: one for each ``millis_per_token``
    begun; document: ``tokens_per_page`` for each page.  Missing sizes count as 0.
    """

    def __init__(self, patch: int = 28, millis_per_token: int = 40, tokens_per_page: int = 512):
        self.patch, self.millis, self.page = patch, millis_per_token, tokens_per_page

    def text(self, p: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(p["text"], F.lit(""))), F.lit(0)

    def image(self, p: Column) -> tuple[Column, Column]:
        return F.lit("<|image|>"), F.ceil(p["width"] / self.patch) * F.ceil(p["height"] / self.patch)

    def audio(self, p: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), F.ceil(p["millis"] / self.millis)

    def document(self, p: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), p["pages"] * self.page

    def visit(self, p: Column) -> Column:
        """struct<piece, kind, ref, tokens>; kind is null for text."""
        piece, tokens = F.lit("<|file|>"), F.lit(0).cast("long")
        for kind in ("document", "audio", "image", "text"):
            a, n = getattr(self, kind)(p)
            is_kind = p["kind"] == kind
            piece, tokens = F.when(is_kind, a).otherwise(piece), F.when(is_kind, F.coalesce(n.cast("long"), F.lit(0))).otherwise(tokens)
        kind = F.when(p["kind"] != "text", p["kind"]).otherwise(F.when(p["kind"].isNull(), F.lit("file")))
        return F.struct(piece.alias("piece"), kind.alias("kind"), p["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """The parts of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("millis", "long"), ("pages", "int"))]))


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", visitor: PartVisitor | None = None, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each conversation: conv_id, formatted, turns, attachments, expanded_tokens.

    turns: array<struct<n, role, at, start, end, loss>>: where the turn's markup begins and where its body
    starts and ends in ``formatted``, in code points; ``loss`` marks bodies under the loss mask.
    attachments: array<struct<n, part, kind, ref, tokens, at>>, in order; ``at`` is the placeholder's place.
    """
    visitor = visitor or PartVisitor()
    seen = turns.select(
        turns[conv_col].alias("conv_id"),
        turns[turn_col].alias("_turn"),
        F.coalesce(turns[role_col], F.lit("")).alias("role"),
        F.transform(F.coalesce(turns[parts_col], F.array().cast(f"array<{PART}>")), visitor.visit).alias("pieces"),
    )
    built = seen.withColumn("body", F.array_join(F.transform("pieces", lambda p: p["piece"]), "")).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    built = built.withColumn("whole", F.concat("head", "body", F.lit(OVER)))
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "body")
    placed = built.withColumn("n", F.row_number().over(order)).withColumn("at", F.sum(F.length("whole")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("whole"))
    placed = placed.withColumn("start", F.col("at") + F.length("head")).withColumn("end", F.col("at") + F.length("whole") - len(OVER))
    # the place of a placeholder: lengths of the pieces before it
    found = F.expr(
        "filter(transform(pieces, (p, i) -> struct(n as n, i as part, p.kind as kind, p.ref as ref, p.tokens as tokens, "
        "if(p.kind is null, 0L, start + aggregate(slice(pieces, 1, i), 0L, (s, q) -> s + length(q.piece))) as at)), x -> x.kind is not null)"
    )
    rows = placed.select("conv_id", F.struct("n", "role", "at", "start", "end", F.col("role").isin(*loss_roles).alias("loss"), "whole", found.alias("found")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["whole"]), "").alias("formatted"),
        F.transform("t", lambda t: F.struct(*[t[c].alias(c) for c in ("n", "role", "at", "start", "end", "loss")])).alias("turns"),
        F.flatten(F.transform("t", lambda t: t["found"])).alias("attachments"),
        F.aggregate(F.flatten(F.transform("t", lambda t: t["found"])), F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, body>> read back from the text alone; roles are unescaped, bodies are as they stand."""
    parts = F.split(formatted, "\\Q" + OVER + "\\E")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(F.substr(t, F.lit(len(TURN) + 1)), SAYS, 1)).alias("role"), F.substr(t, F.length(F.substring_index(t, SAYS, 1)) + len(SAYS) + 1).alias("body")))


def masked_text(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, unescaped, in order; every slice is cut from its own turn's text."""
    parts = F.split(formatted, "\\Q" + OVER + "\\E")
    own = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), turns, lambda p, t: F.when(t["loss"], unescape(F.substr(p, (t["start"] - t["at"] + 1).cast("int"), (t["end"] - t["start"]).cast("int")))).otherwise(""))
    return F.array_join(own, "")


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the formatted text."""
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse_chat(F.col("formatted")).alias("read"), masked_text(F.col("formatted"), F.col("turns")).alias("masked"))
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")
