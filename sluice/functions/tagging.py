"""Taggers that find blocks of comments and of copyright or licence lines in a text, and what to cut of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What begins a comment line, and what a copyright or licence line says.
COMMENT = r"^[ \t]*(?:#|//|/\*|\*/|\* |--|%)"
LICENCE = r"(?i)copyright|\(c\) ?[0-9]{4}|all rights reserved|spdx-license-identifier|licen[sc]ed under|permission is hereby granted|redistribution and use|without warranty"
BLOCK = "array<struct<s:int,e:int,score:double,kind:string>>"


def tagged_blocks(text: Column) -> Column:
    """(s, e, score, kind) of the maximal runs of lines that are comments or speak of rights, in order.

    s and e are characters, e behind the last line but before its newline. A block with a line on rights is `copyright`,
    and its score is the share of such lines in it; others are `comment`, and score the share of the text's lines that
    they are. A null text has null.
    """
    lines = F.split(text, "\n")
    n_lines = F.size(lines)
    none = F.lit(-1)

    def state(at: Column, s: Column, n: Column, hits: Column, done: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), s.cast("int").alias("s"), n.cast("int").alias("n"), hits.cast("int").alias("hits"), done.alias("done"))

    def closed(a: Column, behind: Column) -> Column:
        """The blocks with the open one, whose last line ended one character before `behind`."""
        share = F.when(a["hits"] > 0, a["hits"] / a["n"]).otherwise(a["n"] / n_lines)
        block = F.struct(a["s"].alias("s"), (behind - 1).cast("int").alias("e"), share.cast("double").alias("score"), F.when(a["hits"] > 0, "copyright").otherwise("comment").alias("kind"))
        return F.when(a["s"] >= 0, F.concat(a["done"], F.array(block))).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        rights = line.rlike(LICENCE)
        behind = a["at"] + F.length(line) + 1
        more = state(behind, F.when(a["s"] >= 0, a["s"]).otherwise(a["at"]), a["n"] + 1, a["hits"] + rights.cast("int"), a["done"])
        return F.when(rights | line.rlike(COMMENT), more).otherwise(state(behind, none, F.lit(0), F.lit(0), closed(a, a["at"])))

    start = state(F.lit(0), none, F.lit(0), F.lit(0), F.array().cast(BLOCK))
    return F.aggregate(lines, start, step, lambda a: closed(a, a["at"]))
