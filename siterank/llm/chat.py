"""Chat formatting with typed content parts.

A message is an array of parts (type, text, ref, amount, width, height). A visitor with one method for each type
flattens them, in their order, into one string: text is escaped, every attachment becomes a placeholder, whose
reference and number of expanded tokens are recorded beside the string. Output is one row per message, in the order
of its conversation, so a conversation of any length is never one row.

Escaping: in texts every `<`, any number of backslashes, `|` gets one backslash more, so no text holds `<|`, and
taking one backslash away gives the text back. In roles `\\` and line ends are escaped as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,amount:double,width:int,height:int>"
ATTACHMENT = "struct<part:int,type:string,ref:string,tokens:long>"
PATCH = 14  # an image is cut into patches of this many pixels a side
AUDIO_TOKENS = 25  # a second
PAGE_TOKENS = 800  # a document page
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|im_end\|>).)*)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def text_part(text: Column) -> Column:
    """The parts of a message that is plain text; NULL is empty."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("double").alias("amount"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
    ))


class Visitor:
    """Columns for one part: the text that stands for it and its number of expanded tokens (NULL for text, whose
    tokens depend on the tokenizer). A subclass changes single types or adds `visit_<type>`."""

    types = ("text", "image", "audio", "document")

    def visit_text(self, part: Column) -> tuple[Column, Column]:
        return escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("long")

    def visit_image(self, part: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(part[c], F.lit(1)), F.lit(1)) / PATCH)
        return F.lit("<|image|>"), side("width") * side("height")

    def visit_audio(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|audio|>"), self._amount(part, AUDIO_TOKENS)

    def visit_document(self, part: Column) -> tuple[Column, Column]:
        return F.lit("<|document|>"), self._amount(part, PAGE_TOKENS)

    def visit_other(self, part: Column) -> tuple[Column, Column]:
        """A type without a method keeps its place."""
        return F.lit("<|unknown|>"), F.lit(0).cast("long")

    @staticmethod
    def _amount(part: Column, each: int) -> Column:
        return F.greatest(F.ceil(F.coalesce(part["amount"], F.lit(0.0)) * each), F.lit(1)).cast("long")

    def visit(self, part: Column) -> Column:
        """(text, tokens, attached) of a part of any type."""
        text, tokens = self.visit_other(part)
        for kind in self.types:
            a, b = getattr(self, f"visit_{kind}")(part)
            text = F.when(part["type"] == kind, a).otherwise(text)
            tokens = F.when(part["type"] == kind, b).otherwise(tokens)
        return F.struct(text.alias("text"), tokens.cast("long").alias("tokens"), part["type"].alias("type"), part["ref"].alias("ref"))


def format_messages(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
    learn: tuple[str, ...] = ("assistant",), visitor: Visitor | None = None,
) -> DataFrame:
    """One row per message: conv and turn columns, role, formatted (its piece of the conversation's string),
    loss_start and loss_length (code points within the piece; 0 long where the role is not learned), attachments
    (part, type, ref, tokens) in order and their expanded_tokens.

    Pieces of a conversation in the order of turn, then role, then formatted text, make its string. NULL parts and empty
    arrays are an empty message, a NULL role is empty, NULL conversations and turns come first.
    """
    v = visitor or Visitor()
    none = F.lit(None).cast(f"array<{PART}>")
    flat = F.transform(F.coalesce(F.col(parts), none, F.array().cast(f"array<{PART}>")), v.visit)
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"))
    rows = messages.select(
        F.col(conv).alias(conv), F.col(turn).alias(turn), F.coalesce(F.col(role), F.lit("")).alias("role"),
        head.alias("head"), flat.alias("flat"),
    )
    body = F.array_join(F.transform("flat", lambda p: p["text"]), "")
    numbered = F.transform("flat", lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    learned = F.col("role").isin(*learn)
    return rows.withColumn("body", body).select(
        conv, turn, "role", F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.char_length("head").alias("loss_start"),
        F.when(learned, F.char_length("body")).otherwise(0).alias("loss_length"),
        F.filter(numbered, lambda a: ~a["type"].eqNullSafe(F.lit("text"))).cast(f"array<{ATTACHMENT}>").alias("attachments"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(p["tokens"], F.lit(0))).alias("expanded_tokens"),
    )


DIGEST = "{conv} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row per conversation, from nothing but the formatted pieces and their loss ranges: n_turns, turns_sha256
    (role, line end, text, line end of every turn), loss_chars, loss_sha256 (all learned text) and formatted_chars.

    A SHA-256 runs over the turns one after the other, so a conversation is read by one task; the rows come sorted
    from disk and only the running digests are held, however long it is.
    """
    kind = formatted.schema[conv].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, done = None, None, []
        for pdf in batches:
            for c, piece, start, length in zip(pdf["conv"], pdf["formatted"], pdf["loss_start"], pdf["loss_length"]):
                c = None if pd.isna(c) else c
                if state is None or c != now:
                    if state is not None:
                        done.append(_end(now, state))
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = TURN.fullmatch(piece)
                if found is None:
                    raise ValueError(f"conversation {c}: not a turn of the template")
                state[0] += 1
                state[1].update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
                learned = unescape(piece[start : start + length])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(piece)
            if len(done) > 5000:
                yield _digests(done, conv)
                done = []
        if state is not None:
            done.append(_end(now, state))
        if done:
            yield _digests(done, conv)

    ordered = formatted.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), "role", "formatted", "loss_start", "loss_length")
    return (
        ordered.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "formatted")
        .select("conv", "formatted", "loss_start", "loss_length")
        .mapInPandas(read, DIGEST.format(conv=conv, kind=kind))
    )


def _end(conv, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(done: list[tuple], conv: str) -> pd.DataFrame:
    out = pd.DataFrame(done, columns=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({conv: "object"})
