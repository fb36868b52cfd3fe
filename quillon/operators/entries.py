"""Texts of dictionary entries that run over pages: anchor, end, pages and cleaned excerpt of each."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layout:
    """How entries look. Patterns are of whole lines; {head} in a pattern or marker stands for the headword."""

    # Lines that open an entry, lines of pronunciation, and words near an entry's start.
    head_line: str = r"^{head}(?:[（(][^）)\n]{0,12}[）)])?(?:\s*[A-Za-z][A-Za-z0-9;,' -]{0,24})?$"
    any_head_line: str = r"^[\x{4e00}-\x{9fff}]{1,6}(?:[（(][^）)\n]{0,12}[）)])?(?:\s*[A-Za-z][A-Za-z0-9;,' -]{0,24})?$"
    glued: str = r"^{head}[\x{4e00}-\x{9fff}]"
    spoken: str = r"^[A-Za-zāáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü;,' -]{1,24}$"
    spoken_end: str = r"\s+[A-Za-z][A-Za-z0-9;,' -]{0,24}$"
    number: str = r"^\d{1,4}$"
    origin: tuple[str, ...] = ("(说文", "（说文", "<说文", "{说文")
    next_marks: tuple[str, ...] = ("(说文", "（说文", "<说文", "{说文", "虚词")
    phrases: tuple[str, ...] = ("虚词 {head}", "{head} 与本义无关", "{head} 是假借字", "{head} 可作")
    headers: tuple[str, ...] = field(default=("代词", "副词", "介词", "连词", "助词", "语气词", "叹词", "动词"))
    # Characters of a heading line, of the windows after it, of the least entry, and of excerpts.
    longest_line: int = 40
    window: int = 360
    next_window: int = 320
    least_entry: int = 600
    excerpt: int = 4000
    excerpt_a_page: int = 2600
    most_excerpt: int = 24000
    least_score: int = 4


def _quoted(text: Column) -> Column:
    """A text as a literal in a pattern."""
    return F.regexp_replace(text, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")


def _filled(template: str, head: Column, literal: bool = False) -> Column:
    parts = template.split("{head}")
    out = F.lit(parts[0])
    for part in parts[1:]:
        out = F.concat(out, _quoted(head) if literal else head, F.lit(part))
    return out


def _any(text: Column, needles: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, n) for n in needles], F.lit(False))


def stitch(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """entry, book, head, text and ends (page and end offset of each) of entries on neighbouring pages.

    targets: entry, book, head, first, last (pages). pages: book, page, text. An entry has a few pages.
    """
    sides = pages.select(F.col("book").alias("page_book"), "page", F.coalesce("text", F.lit("")).alias("page_text"))
    met = targets.join(sides, (F.col("book") == F.col("page_book")) & F.col("page").between(F.col("first"), F.col("last")))
    parts = met.groupBy("entry", "book", "head").agg(F.array_sort(F.collect_list(F.struct("page", "page_text"))).alias("parts"))
    sizes = F.transform("parts", lambda p: F.length(p["page_text"]) + 1)
    ends = F.transform("parts", lambda p, i: F.struct(p["page"].alias("page"), (F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b) - 1).alias("end")))
    return parts.select("entry", "book", "head", F.array_join(F.transform("parts", lambda p: p["page_text"]), "\n").alias("text"), ends.alias("ends"))


def _lines(texts: DataFrame) -> DataFrame:
    """entry, head, offset, line (trimmed) and the next line that is not empty."""
    order = Window.partitionBy("entry").orderBy("pos")
    raw = texts.select("entry", "head", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    strip = F.regexp_replace("raw", r"^\s+|\s+$", "")
    start = F.coalesce(F.sum(F.length("raw") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.first(F.when(strip != "", strip), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return raw.select("entry", "head", start.cast("int").alias("offset"), strip.alias("line"), F.coalesce(after, F.lit("")).alias("after"))


def anchors(texts: DataFrame, lines: DataFrame, layout: Layout) -> DataFrame:
    """entry and anchor: where each entry begins.

    The best-scored heading line counts, the first of several; if none is good enough, the line of the
    headword before the first phrase that goes with it.
    """
    head, line, after = F.col("head"), F.col("line"), F.col("after")
    whole = F.regexp_like(line, _filled(layout.head_line, head, literal=True))
    glued = F.regexp_like(line, _filled(layout.glued, head, literal=True))
    base = F.when(whole, 9).when(line == head, 4).when(line.startswith(head) & (F.length(line) <= 10) & ~glued, 2)
    near = lines.filter((line != "") & (F.length(line) <= layout.longest_line) & F.contains(line, head)).withColumn("score", base).filter("score is not null")
    window = F.substring(F.col("text"), F.col("offset") + 1, F.lit(layout.window))
    near = near.join(texts.select("entry", "text"), "entry").withColumn("window", window).drop("text")
    when = lambda c, n: F.when(c, n).otherwise(0)
    score = (
        F.col("score") + when(line != head, -1) + when(after.rlike(layout.spoken), 3) + when(after.rlike(layout.number), -4)
        + when(_any(F.col("window"), [F.lit(x) for x in layout.origin]), 3) + when(_any(F.col("window"), [_filled(x, head) for x in layout.phrases]), 3)
        + when(_any(F.col("window"), [F.lit(x) for x in layout.headers]), 2) + when((after != head) & after.rlike(layout.any_head_line), -2)
    )
    best = near.groupBy("entry").agg(F.max_by("offset", F.struct(score.alias("score"), -F.col("offset"))).alias("anchor"), F.max(score).alias("score"))
    best = best.filter(F.col("score") >= layout.least_score).select("entry", "anchor")
    found = F.array_compact(F.array(*[F.when(F.contains("text", m), F.struct(F.instr(F.col("text"), m).alias("at"), F.length(m).alias("n"))) for m in (_filled(x, head) for x in layout.phrases)]))
    rest = texts.join(best, "entry", "left_anti").withColumn("mark", F.get(found, F.lit(0))).filter("mark is not null")
    since = F.greatest(F.lit(0), F.col("mark.at") - 1 - 240)
    piece = F.substring(F.col("text"), since + 1, F.col("mark.at") - 1 + F.col("mark.n") + 8 - since)
    alone = F.concat(F.lit("\n"), head, F.lit("\n"))
    back = F.instr(F.reverse("piece"), F.reverse(alone))
    rest = rest.withColumn("since", since).withColumn("piece", piece)
    by_phrase = F.when(back > 0, F.col("since") + F.length("piece") - back - F.length(alone) + 2).otherwise(F.greatest(F.lit(0), F.col("mark.at") - 1 - 40))
    return best.unionByName(rest.select("entry", by_phrase.cast("int").alias("anchor")))


def following(texts: DataFrame, lines: DataFrame, found: DataFrame, layout: Layout) -> DataFrame:
    """entry and stop: where the next entry begins, for entries that one follows."""
    line = F.col("line")
    far = lines.join(found, "entry").filter(F.col("offset") > F.col("anchor") + layout.least_entry)
    heads = far.filter((line != "") & (F.length(line) <= layout.longest_line) & line.rlike(layout.any_head_line) & ~F.regexp_replace(line, r"\s+", "").startswith(F.col("head")))
    heads = heads.filter(F.col("after").rlike(layout.spoken) | line.rlike(layout.spoken_end))
    window = F.substring(F.col("text"), F.col("offset") + 1, F.lit(layout.next_window))
    marked = heads.join(texts.select("entry", "text"), "entry").filter(_any(window, [F.lit(x) for x in layout.next_marks]))
    return marked.groupBy("entry").agg(F.min("offset").alias("stop"))


def cleaned(text: Column, layout: Layout) -> Column:
    """An excerpt without page numbers, lines of marks only and stray Latin letters; blank lines single."""
    lines = F.transform(F.split(F.replace(text, F.lit("\f"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    noise = lambda x: x.rlike(layout.number) | x.rlike(r"^[\p{P}\p{S}]+$") | (x.rlike(r"^[A-Za-z.·…\-]{1,12}$") & ~x.rlike(layout.spoken))
    joined = F.array_join(F.filter(lines, lambda x: ~noise(x)), "\n")
    return F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def extract(targets: DataFrame, pages: DataFrame, layout: Layout | None = None) -> DataFrame:
    """entry, head, anchor, stop, first_page, last_page and excerpt of each entry that is found.

    stop is the end of the text where no next entry is seen. Offsets count characters of the stitched pages.
    """
    layout = layout or Layout()
    texts = stitch(targets, pages)
    lines = _lines(texts)
    found = anchors(texts, lines, layout)
    stops = following(texts, lines, found, layout)
    rows = texts.join(found, "entry").join(stops, "entry", "left").withColumn("stop", F.coalesce("stop", F.length("text")))
    page = lambda at: F.coalesce(F.get(F.filter("ends", lambda e: at <= e["end"]), F.lit(0))["page"], F.try_element_at("ends", F.lit(-1))["page"])
    most = F.least(F.lit(layout.most_excerpt), F.greatest(F.lit(layout.excerpt), layout.excerpt_a_page * F.size("ends")))
    body = F.substring(F.col("text"), F.col("anchor") + 1, F.col("stop") - F.col("anchor"))
    return rows.select(
        "entry", "head", "anchor", "stop", page(F.col("anchor")).alias("first_page"), page(F.greatest(F.col("anchor"), F.col("stop") - 1)).alias("last_page"),
        F.substring(cleaned(body, layout), F.lit(1), most).alias("excerpt"),
    )
