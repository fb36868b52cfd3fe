"""Column expressions on text: cleaning, counting, snippets, tokens and windows."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of any script; the same class is understood by Java and RE2.
WORD = r"\p{L}+"
#: English words with inner hyphens or apostrophes.
ENGLISH_WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)*"


def clean(text: Column) -> Column:
    """Letters, digits, underscores, CJK and white space only, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)[^\w一-鿿\s]", ""))


def compact(text: Column) -> Column:
    """The cleaned text without white space."""
    return F.regexp_replace(clean(text), r"(?U)\s+", "")


def ascii_fold(text: Column) -> Column:
    """Lower case for A-Z only, as case-insensitive LIKE compares."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def has_term(text: Column, term: Column | str) -> Column:
    """Substring predicate with ASCII case folding; % and _ have no special meaning."""
    term = F.lit(term) if isinstance(term, str) else term
    return ascii_fold(text).contains(ascii_fold(term))


def occurrences(text: Column, term: Column | str) -> Column:
    """Non-overlapping occurrences of a non-empty substring."""
    term = F.lit(term) if isinstance(term, str) else term
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.floor(gone / F.length(term)).cast("long")


def window_snippet(text: Column, term: str, before: int = 30, width: int = 160) -> Column:
    """A window around the first occurrence, every occurrence in it marked."""
    start = F.greatest(F.lit(1), F.instr(text, term) - before)
    return F.replace(F.substring(text, start, F.lit(width)), F.lit(term), F.lit(f"<mark>{term}</mark>"))


def context_snippet(text: Column, term: Column, window: int = 180) -> Column:
    """White space collapsed, half a window on either side of the term, ellipses where text was cut."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    half = max(window // 2, 50)
    at = F.position(term, flat)
    start = F.greatest(F.lit(1), at - half)
    stop = F.least(F.length(flat), at + F.length(term) + half)
    body = F.substring(flat, start, stop - start + 1)
    cut = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(stop < F.length(flat), "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(flat, 1, window))


def highlight_longest(snippet: Column, terms: list[str]) -> Column:
    """Mark the first occurrence of the longest term that is present."""
    marked = snippet
    for term in sorted((t for t in terms if t), key=lambda t: (len(t), t)):
        at = F.instr(snippet, term)
        once = F.overlay(snippet, F.lit(f"<mark>{term}</mark>"), at, F.lit(len(term)))
        marked = F.when(at > 0, once).otherwise(marked)
    return marked


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once: inside a lambda an expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def phrases(tokens: Column, longest: int = 6, joiner: str = "") -> Column:
    """Distinct concatenations of 1 to longest neighbouring tokens."""

    def of(ws: Column) -> Column:
        def at(i: Column) -> Column:
            sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(ws) - i))
            return F.transform(sizes, lambda n: F.array_join(F.slice(ws, i + 1, n), joiner))

        starts = F.sequence(F.lit(0), F.size(ws) - 1)
        some = F.array_distinct(F.flatten(F.transform(starts, at)))
        return F.when(F.size(ws) > 0, some).otherwise(F.array().cast("array<string>"))

    return bound(tokens, of)


def sentences(text: Column) -> Column:
    """Sentences cut after closing punctuation, trimmed, empty ones dropped."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.split(flat, r"(?<=[。！？!?；;.])\s*")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def evidence_windows(pieces: Column, widest: int = 2, joiner: str = " ") -> Column:
    """Distinct windows of one to widest neighbouring pieces."""
    return phrases(pieces, widest, joiner)


def strip_markup(html: Column) -> Column:
    """Text of a page: line breaks for <br> and </p>, no tags, the usual entities, blanks collapsed."""
    out = F.regexp_replace(html, r"(?i)<br\s*/?>|</p>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(out, r" ?\n[ \n]*", "\n"))


def page_quality(text: Column) -> Column:
    """6 for a CJK character, 2 for another letter, 1 for a digit and any character, -20 for noise."""
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    digits = F.regexp_count(text, F.lit(r"\p{Nd}"))
    noise = F.regexp_count(text, F.lit(r"[\x{fffd}\x{25a1}]"))
    return (6 * cjk + 2 * (letters - cjk) + digits + F.length(text) - 20 * noise).cast("long")


def normalise_title(title: Column) -> Column:
    """Full-width brackets and separators unified, uuid suffix and repeated blanks dropped."""
    out = F.translate(title, "（）【】：，　", "()[]:, ")
    out = F.regexp_replace(out, r"(?i)[_-]?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "")
    out = F.regexp_replace(out, r"[_\-·|/]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix + the first 16 hex digits of the MD5 of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 16))


def is_cjk_term(term: Column) -> Column:
    """Two to six CJK characters."""
    return term.rlike(r"^[\x{4e00}-\x{9fff}]{2,6}$")


def single_hanzi(text: Column) -> Column:
    """Whether the text has exactly one CJK character."""
    return F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")) == 1


def bounded_latin(text: Column, term: str) -> Column:
    """Whether a Latin term stands alone, not inside another word."""
    return text.rlike(rf"(?i)(?<![0-9A-Za-z])\Q{term}\E(?![0-9A-Za-z])")


def is_synthetic(query: Column, markers: tuple[str, ...] = ("healthcheck", "loadtest", "smoketest"), pattern: str = r"^test\d*$") -> Column:
    """Queries made by probes: a marker inside the normalised query, or a pattern."""
    norm = F.regexp_replace(F.lower(query), r"[\s_/\-]+", "")
    out = norm.rlike(pattern)
    for m in markers:
        out = out | norm.contains(m)
    return out


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sigmoid(value: Column) -> Column:
    """Logistic curve of a value clipped to twelve either way."""
    return 1 / (1 + F.exp(-clamp(value, -12.0, 12.0)))


def count_in(text: Column, needles: list[str]) -> Column:
    """How many of some literals occur in the text."""
    return sum((text.contains(n).cast("int") for n in needles), F.lit(0))


def nfkc(text: Column) -> Column:
    """Compatibility normal form; Spark has no expression for it, so Arrow batches go through Python."""
    return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x)), "string")(text)


def unaccented(text: Column) -> Column:
    """Lower case without diacritics: decomposed, combining marks dropped."""

    def fold(x: str | None) -> str | None:
        return x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).lower()

    return F.pandas_udf(lambda s: s.map(fold), "string")(text)


def contains_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def english_lines(text: Column) -> Column:
    """The lines of running English of a text in one line: no images, file names, formulas, page lists, glosses or headings."""
    out = text
    for p in (
        r"!\[[^\]]*\]\([^)]*\)", r"(?i)\bimages/[A-Za-z0-9._/-]+\b", r"(?i)\b[A-Za-z0-9_-]+\.(?:jpg|jpeg|png|webp|gif)\b",
        r"\$[^$\n]{0,160}\$", r"\\[A-Za-z]+",
    ):
        out = F.regexp_replace(out, p, " ")
    lines = F.transform(F.split(out, r"[\r\n]+"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))

    def good(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(ENGLISH_WORD))
        upper = F.regexp_count(line, F.lit(r"\b[A-Z][A-Z'-]*[A-Z]\b"))
        gloss = contains_cjk(line) & (line.rlike(r"/[^/\n]{1,40}/") | line.rlike(r"(?i)\b(?:adj|adv|prep|pron|conj|noun|verb|phrase|phr|vt|vi)\b"))
        heads = F.regexp_count(line, F.lit(r"\b(?:UNIT|Unit|LESSON|Lesson)\b"))
        pages = F.regexp_count(line, F.lit(r"(?i)\bpp?\.\s*\d"))
        return (n > 0) & (pages < 2) & ~gloss & ~((n >= 6) & (upper / n >= 0.6) & ~line.rlike("[.!?]")) & (heads < 2)

    return F.array_join(F.filter(lines, good), " ")


def english_tokens(text: Column, stopwords: list[str], acronyms: list[str] = ()) -> Column:
    """Valid English words of cleaned lines in order: 3 to 32 letters, lower case, no stop words; acronyms in upper case."""
    found = F.regexp_extract_all(english_lines(text), F.lit(ENGLISH_WORD), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(w, r"(?i)'s$", ""))
    if acronyms:
        shown = F.transform(bare, lambda w: F.when(F.upper(w).isin(*acronyms), F.upper(w)).otherwise(F.lower(w)))
        return F.filter(shown, lambda w: w.isin(*acronyms) | F.length(w).between(3, 32) & ~F.lower(w).isin(stopwords))
    return F.filter(F.transform(bare, F.lower), lambda w: F.length(w).between(3, 32) & ~w.isin(stopwords))


def english_forms(text: Column, stopwords: list[str], acronyms: list[str] = ()) -> Column:
    """Valid English words of cleaned lines in order, each as a struct of token and surface; the rules of english_tokens()."""
    found = F.regexp_extract_all(english_lines(text), F.lit(ENGLISH_WORD), F.lit(0))
    known = list(acronyms)

    def form(w: Column) -> Column:
        bare = F.regexp_replace(w, r"(?i)'s$", "")
        token = F.when(F.upper(bare).isin(known), F.upper(bare)).otherwise(F.lower(bare)) if known else F.lower(bare)
        return F.struct(token.alias("token"), bare.alias("surface"))

    valid = lambda t: F.length(t).between(3, 32) & ~F.lower(t).isin(stopwords)
    return F.filter(F.transform(found, form), lambda f: (f["token"].isin(known) | valid(f["token"])) if known else valid(f["token"]))


def reference_page(text: Column) -> Column:
    """title and page of references such as '《title》第12页' or 'title p. 12'; nulls where there is none."""
    title = F.coalesce(F.nullif(F.regexp_extract(text, "《([^》]+)》", 1), F.lit("")), F.nullif(F.trim(F.regexp_extract(text, r"^(.*?)\s*(?:第|[Pp]{1,2}\.?)\s*\d+", 1)), F.lit("")))
    page = F.nullif(F.regexp_extract(text, r"(?:第|\b[Pp]{1,2}\.?)\s*(\d+)", 1), F.lit("")).cast("int")
    return F.struct(title.alias("title"), page.alias("page"))


def labelled(title: Column, edition: Column) -> Column:
    """A title with its edition in brackets, unless it names it already."""
    named = F.coalesce(title.contains(edition), F.lit(True)) | (edition == "")
    return F.when(named, title).otherwise(F.concat(title, F.lit("（"), edition, F.lit("）")))


def canonical_pattern(text: Column) -> Column:
    """Wordings alike but for digits and blanks have one form: digits become 0, blanks one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "0"), r"\s+", " "))


def gloss(text: Column) -> Column:
    """The explanation after a colon, without options that follow it and closing punctuation."""
    after = F.regexp_extract(text, r"^[^:：]{1,40}[:：]\s*(.+)$", 1)
    return F.regexp_replace(F.regexp_replace(after, r"\s+[A-D][.．]\s.*$", ""), r"[。；;.\s]+$", "")
