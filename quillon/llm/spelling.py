"""Spelling variants: words one edit apart, found by walking a distributed trie level by level.

Words are entered twice, as they are and reversed, into one radix trie that is kept as a table of
edges (node, first character, label, child). Nodes are prefixes at which words part or end, named by
their hash, so chains without a branch are one edge however long they are.

The frontier is a table of states (word, position, node, edits). Level by level it meets the edges of
that level: a state without an edit meets all edges of its node and either follows its own word or
makes the one edit (another, an additional or a missing character) where the word leaves the label;
a state with an edit meets the one edge that goes on with its next character, and must follow it
exactly. States that are at the end of their word and of a path are neighbours. The edit lies in one
half of a word: the walk forwards makes edits only in the second half and the walk backwards only in
the first, so no state is made where the trie is broad. Edges carry the lengths of the words below
and the characters that may follow, and states that can end nowhere are not made.

Everything is a DataFrame expression. States with an edit are dealt out by node and next character.
States without are dealt out by node and a salt, and edges meet them once for each salt, so a prefix
that many words share is split. Each level is written to the shared scratch folder and read back.

Forms are chosen by one grouped aggregation, roots by following forms twice as far in each round.

Edge cases: null and empty texts have no words. A null doc_id counts as an empty string in the rule
for planted edits. Rows repeated with one doc_id count each for itself. Words without a near word
have n_near 0, no form, and are their own root. Among near words with equal n the smallest in
code-point order is the form. An empty table gives an empty result; other columns are never looked
at. Texts are read whole; the time for one word grows with the square of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialize

#: Maximal runs of letters.
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
#: Code points that a word must have.
LEAST_LENGTH = 6
#: Occurrences that a word must have.
LEAST_COUNT = 5
#: How many times as frequent as the word its form must be.
FORM_RATIO = 5
#: Parts into which the states of one node without an edit are dealt.
SALTS = 8


def corpus_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, edit_every: int = 199) -> DataFrame:
    """word and n of the frequent words of all texts, with one character deleted by rule in some documents.

    With edit_every = 0 words are counted as they are.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))
    word = "run"
    if edit_every:
        runs = runs.withColumn("h", F.expr("crc32(concat(id, ':', run))"))
        cut = "cast(pmod(h, length(run)) as int)"
        word = f"case when h % {int(edit_every)} = 0 then concat(substr(run, 1, {cut}), substr(run, {cut} + 2)) else run end"
    words = runs.select(F.expr(word).alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _bit(number: str) -> str:
    return f"shiftleft(1L, cast({number} % 64 as int))"


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of the entries of the trie, and its edges.

    Paths: side, key (the word in reading order of the side), level, pos, node, child, k (length of the
    label). Edges: level, node, first, label, child, term (the key that ends at the child, if any), lens
    (bits of the lengths of the words below) and follow (bits of the characters after the child).
    """
    sides = words.select(F.explode(F.expr("array(named_struct('side', 0, 'key', word), named_struct('side', 1, 'key', reverse(word)))")).alias("e"))
    entries = sides.select("e.side", "e.key")
    prefixes = entries.select("side", "key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("i")).selectExpr(
        "side", "key", "i", "xxhash64(side, substr(key, 1, i)) node", "substr(key, i + 1, 1) next", "length(key) n"
    )
    about = prefixes.groupBy("node").agg(
        F.min("next").alias("lo"), F.max("next").alias("hi"), F.expr(f"bit_or({_bit('n')})").alias("lens"),
        F.expr(f"bit_or(if(next = '', 0L, {_bit('ascii(next)')}))").alias("follow"),
    )
    # Nodes: prefixes at which words part, and whole words.
    branching = about.filter("lo <> hi").select("node", "lens", "follow")
    met = prefixes.hint("shuffle_hash").join(branching.hint("shuffle_hash"), "node", "left").filter("lens is not null or i = n")
    stops = met.selectExpr("side", "key", f"struct(i, node, coalesce(lens, {_bit('n')}) lens, coalesce(follow, 0L) follow) stop")
    whole = stops.groupBy("side", "key").agg(F.array_sort(F.collect_list("stop")).alias("stops"))
    hops = "transform(stops, (s, j) -> struct(if(j = 0, 0, stops[j - 1].i) pos, if(j = 0, xxhash64(side), stops[j - 1].node) node, s stop))"
    steps = whole.selectExpr("side", "key", f"posexplode({hops}) as (level, hop)").selectExpr(
        "side", "key", "level", "hop.pos", "hop.node", "hop.stop.node child", "hop.stop.i - hop.pos k", "hop.stop.lens", "hop.stop.follow"
    )
    steps = materialize(steps, "trie-paths")
    edges = steps.groupBy("child").agg(
        F.first("level").alias("level"), F.first("node").alias("node"), F.first(F.expr("substr(key, pos + 1, k)")).alias("label"),
        F.max(F.expr("if(pos + k = length(key), key, null)")).alias("term"), F.first("lens").alias("lens"), F.first("follow").alias("follow"),
    )
    edges = edges.select("level", "node", F.expr("substr(label, 1, 1)").alias("first"), "label", "child", "term", "lens", "follow")
    return steps.select("side", "key", "level", "pos", "node", "child", "k"), materialize(edges, "trie-edges")


def _settled(made: DataFrame) -> DataFrame:
    """States that can still end, or end here: the rest of the word and the words below must agree."""
    return made.filter(
        f"lens & {_bit('want')} <> 0 and if(pos >= length(key), pos = length(key) and term is not null and length(term) = want,"
        f" follow & {_bit('ascii(substr(key, pos + 1, 1))')} <> 0)"
    )


STATE = ["side", "key", "want", "pos", "child as node", "term"]


def first_edits(paths: DataFrame, edges: DataFrame, level: int, salts: int = SALTS) -> DataFrame:
    """States after the edges of a level on which a word makes its one edit, and pairs that end there."""
    # The edit may not come before the half of the word that its side is responsible for.
    half = "if(side = 0, length(key) div 2, length(key) - length(key) div 2)"
    mine = paths.filter(f"level = {level} and pos + k >= {half}").selectExpr(
        "side", "key", "pos", "node", "child own", f"{half} half", f"pmod(xxhash64(key, pos), {int(salts)}) salt"
    )
    theirs = edges.filter(F.col("level") == level).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = mine.join(theirs.hint("shuffle_hash"), ["node", "salt"]).filter("own <> child")
    met = met.selectExpr("*", "substr(key, pos + 1) rest", "length(label) w", "half - pos open").filter(
        "open <= 0 or (w >= open and left(rest, open) = left(label, open))"
    )
    # (length of the other word, position after the label) of each edit that fits; a longer label needs one
    # edit between it and as many, one fewer or one more characters of the word.
    length = "length(key)"
    ways = (
        f"array(if(levenshtein(left(rest, w), label, 1) = 1 and length(rest) >= w, struct({length} want, pos + w pos), null),"
        f" if(levenshtein(left(rest, w - 1), label, 1) = 1 and length(rest) >= w - 1, struct({length} + 1 want, pos + w - 1 pos), null),"
        f" if(levenshtein(left(rest, w + 1), label, 1) = 1 and length(rest) >= w + 1, struct({length} - 1 want, pos + w + 1 pos), null))"
    )
    made = met.selectExpr("side", "key", "child", "term", "lens", "follow", f"explode(array_compact({ways})) way")
    return _settled(made.selectExpr("side", "key", "child", "term", "lens", "follow", "way.want", "way.pos")).selectExpr(*STATE)


def last_characters(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of a word and the same without its last character, both ways: the longer one's path has a node where the other ends."""
    ends = edges.filter("term is not null").select(F.col("child"), F.col("term").alias("other"))
    last = paths.filter("pos + k = length(key) - 1")
    met = last.join(ends.hint("shuffle_hash"), "child")
    return met.select("side", F.explode(F.expr("array(struct(key, other), struct(other key, key other))")).alias("p")).select("side", "p.key", "p.other")


def follow_edges(states: DataFrame, edges: DataFrame, level: int) -> DataFrame:
    """States with an edit after the edges of a level, each along the only edge that may fit."""
    ahead = states.filter("pos < length(key)").selectExpr("side", "key", "want", "pos", "node", "substr(key, pos + 1, 1) first")
    theirs = edges.filter(F.col("level") == level).drop("level")
    met = ahead.join(theirs.hint("shuffle_hash"), ["node", "first"]).filter("substr(key, pos + 1, length(label)) = label")
    return _settled(met.selectExpr("side", "key", "child", "term", "lens", "follow", "want", "pos + length(label) pos")).selectExpr(*STATE)


def near_words(words: DataFrame, salts: int = SALTS) -> DataFrame:
    """word and near: all ordered pairs of different words that one edit turns into each other."""
    paths, edges = trie(words.select("word"))
    depth = edges.agg(F.max("level")).first()[0]
    pairs = last_characters(paths, edges)
    states = None
    for level in range(-1 if depth is None else depth + 1):
        made = first_edits(paths, edges, level, salts)
        if states is not None:
            made = made.unionByName(follow_edges(states, edges, level))
        states = materialize(made, "frontier")
        ended = states.filter("pos = length(key) and term is not null").select("side", "key", F.col("term").alias("other"))
        pairs = pairs.unionByName(ended)
    read = "if(side = 0, {0}, reverse({0}))"
    found = pairs.select(F.expr(read.format("key")).alias("word"), F.expr(read.format("other")).alias("near"))
    # Both sides may find a pair whose edit lies in a run of equal characters.
    return found.filter("levenshtein(word, near, 1) = 1").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words with a form: the last word that forms lead to."""
    ahead = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ahead = materialize(ahead.join(then, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if ahead.filter("moved").isEmpty():
            return ahead.select("word", "root")
        ahead = ahead.select("word", "root")


def variant_groups(words: DataFrame, form_ratio: int = FORM_RATIO, salts: int = SALTS) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words with their counts n."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = near_words(words, salts)
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    chosen = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.expr(f"if(-best.less >= {int(form_ratio)} * n, best.near, null)").alias("form"),
        F.expr(f"if(-best.less >= {int(form_ratio)} * n, -best.less, null)").alias("form_n"),
    )
    chosen = materialize(chosen, "forms")
    ends = roots(chosen.filter("form is not null"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
