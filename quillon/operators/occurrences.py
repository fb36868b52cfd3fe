"""Marked terms of papers with the whole path to each: question, option, item and place in the text.

A paper is cut by opening marks: questions into options, options into items. A part runs from its mark to
the next one of its level; what stands before the first mark of a level is part 0, without a label.
Terms are found in the innermost parts, with a gloss where one follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Marks:
    """Patterns of the opening marks of questions, options and items (group 1 is the label), and of terms (token, gloss)."""

    # Numbered questions, lettered options, separators of items, and emphasised terms with a gloss in brackets or after a colon.
    question: str = r"(?m)^[ \t]*(\d{1,3})[.．、](?!\d)"
    option: str = r"(?m)^[ \t]*([A-F])[.．、]"
    item: str = r"[；;]|(?m:^[ \t]*[①②③④⑤⑥⑦⑧⑨⑩])"
    term: str = r"(?:\*\*(?P<a>[^*\n]{1,20})\*\*|<u>(?P<b>[^<\n]{1,20})</u>|<em>(?P<c>[^<\n]{1,20})</em>)(?:[（(](?P<gloss>[^）)\n]{1,40})[）)]|[：:](?P<said>[^；;。\n]{1,40}))?"


def _parts(text: str, start: int, end: int, mark: re.Pattern) -> Iterator[tuple[int, str, int, int]]:
    """Number, label, start and end of the parts of a stretch; a mark belongs to the part that it opens."""
    opened = [(start + m.start(), m.group(1) if mark.groups else "") for m in mark.finditer(text[start:end])]
    if not opened or opened[0][0] > start:
        yield 0, "", start, opened[0][0] if opened else end
    for n, (at, label) in enumerate(opened):
        yield n + 1, label or "", at, opened[n + 1][0] if n + 1 < len(opened) else end


def paths(text: str | None, marks: Marks) -> Iterator[tuple]:
    """question_no, question, option_no, option, item_no, term_no (in its item, from 1), term, gloss, start and stop of every term."""
    question, option, item, term = (re.compile(p) for p in (marks.question, marks.option, marks.item, marks.term))
    text = text or ""
    for qn, q, q0, q1 in _parts(text, 0, len(text), question):
        for on, o, o0, o1 in _parts(text, q0, q1, option):
            for i, _, i0, i1 in _parts(text, o0, o1, item):
                for n, m in enumerate(term.finditer(text[i0:i1])):
                    found = m.groupdict()
                    gloss = found.get("gloss") or found.get("said")
                    name = next((g for k, g in sorted(found.items()) if k not in ("gloss", "said") and g is not None), m.group())
                    yield qn, q, on, o, i, n + 1, name.strip(), gloss.strip() if gloss else None, i0 + m.start(), i0 + m.end()


PATH = "question_no int, question string, option_no int, option string, item_no int, term_no int, term string, gloss string, start int, stop int"


def occurrences(papers: DataFrame, marks: Marks | None = None) -> DataFrame:
    """The columns of papers but text (with id), and for each marked term of the text its path; papers without one give no row.

    A table function that is joined laterally: each text goes to Python once, and rows come back as they are found.
    """
    marks = marks or Marks()

    class Paths:
        def eval(self, text: str):
            yield from paths(text, marks)

    found = F.udtf(Paths, returnType=PATH)
    return papers.lateralJoin(found(F.col("text").outer())).drop("text")


def translations(found: DataFrame) -> DataFrame:
    """id, term, pair_index and gloss: the glossed terms of a paper in order, each pair once."""
    pairs = found.filter("gloss is not null").groupBy("id", "term", "gloss").agg(F.min("start").alias("start"))
    order = F.array_sort(F.collect_list(F.struct("start", "term", "gloss")))
    each = pairs.groupBy("id").agg(order.alias("pairs")).select("id", F.posexplode("pairs").alias("pair_index", "p"))
    return each.select("id", "p.term", F.col("pair_index"), "p.gloss")
