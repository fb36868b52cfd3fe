"""Exact deduplication by deterministic block naming (DataFrame functions only).

A text is normalised (white space deleted) and cut into blocks of fixed size. Sorting the blocks
gives each distinct block an integer name; then adjacent names are paired, the distinct pairs are
sorted and named again, and so on until every document is left with one name. Two documents have
the same number of blocks and the same last name exactly when their normalised texts are equal: no
step trusts a hash.

The sort is dealt out by a 64-bit hash of what is named: a name is (hash bucket, rank in the sorted
bucket), so rows that share a hash but not their content get different ranks. Names depend on the
content alone, so a task that runs again gives the same names. A block that makes up 1/HOT_SHARE of
all rows, or HOT_ROWS rows, is not sent to one bucket: its distinct contents are named once and
looked up by a join, which is a broadcast one only if its counted size allows it.

Edge cases: a null text counts as empty, and all empty texts are equal. A null doc_id is kept as it
is and sorts before other ids when ties are broken. Of rows repeated with the same doc_id and text
one is kept: the first by original text, then by its other columns. An empty table gives an empty
result. Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import materialize, unused

#: Characters in a block of the first level.
BLOCK_CHARS = 4096
#: A name with at least this share (one in so many) of the rows, or with so many rows, is hot.
HOT_SHARE, HOT_ROWS = 256, 20_000
#: Largest tables of hot names, and of their contents, that are broadcast; beyond them joins are shuffled.
HOT_NAMES_BROADCAST, HOT_CONTENTS_BROADCAST = 200_000, 1024

_KEY = ["doc_key", "sha"]


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its join key, lengths and digest of the normalised text, and that text."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_key"),
        F.length("text").alias("n_chars"),
        normalised(F.col("text")).alias("norm"),
    ).withColumn("sha", F.unhex(F.sha2("norm", 256)))


def _blocks(norm: Column, size: int) -> Column:
    """The text cut into blocks; an empty text has one empty block."""
    return F.when(F.length(norm) == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    )


def _named(rows: DataFrame, content: list[str], hashes: DataFrame, total: int) -> DataFrame:
    """Give every row the integer name (h, rank) of its content.

    rows has the columns of content and h, their hash; hashes is any table with the same h values,
    row for row, that is cheaper to read.
    """
    least = min(max(64, total // HOT_SHARE), HOT_ROWS)
    hot = materialize(hashes.groupBy("h").count().filter(F.col("count") >= least).select("h"), "hot")
    within = Window.partitionBy("h").orderBy(*content)
    rest = [c for c in rows.columns if c not in content]
    if hot.isEmpty():
        return rows.withColumn("rank", F.dense_rank().over(within)).select(*rest, "rank")
    flags = hot.withColumn("is_hot", F.lit(True))
    marked = rows.join(F.broadcast(flags) if hot.count() <= HOT_NAMES_BROADCAST else flags.hint("merge"), "h", "left")
    cold = marked.filter("is_hot is null").withColumn("rank", F.dense_rank().over(within))
    names = materialize(
        marked.filter("is_hot").select("h", *content).distinct().withColumn("rank", F.dense_rank().over(within)),
        "hot-names",
    )
    side = F.broadcast(names) if names.count() <= HOT_CONTENTS_BROADCAST else names.hint("merge")
    looked_up = marked.filter("is_hot").join(side, ["h", *content])
    return cold.select(*rest, "rank").unionByName(looked_up.select(*rest, "rank"))


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Heads (a row for each document: key, lengths, number of blocks) and the last name of each key."""
    keyed = _keyed(docs)
    blocks = _blocks(F.col("norm"), block_chars)
    heads = materialize(
        keyed.select(
            "doc_id", *_KEY, "n_chars", F.transform(blocks, lambda b: F.xxhash64(b)).alias("hs")
        ).withColumn("n_blocks", F.size("hs")),
        "heads",
    )
    total, widest = heads.agg(F.sum("n_blocks"), F.max("n_blocks")).first()
    rows = (
        keyed.select(*_KEY, blocks.alias("blocks"))
        .select(*_KEY, F.size("blocks").alias("n_blocks"), F.posexplode("blocks").alias("idx", "block"))
        .withColumn("h", F.xxhash64("block"))
        .withColumn("left_over", F.col("n_blocks"))
    )
    hashes = heads.select(F.explode("hs").alias("h"))
    level = materialize(_named(rows, ["block"], hashes, total or 0), "names")
    done = []
    width = widest or 1
    while width > 1:
        done.append(level.filter("left_over = 1"))
        even = F.col("idx") % 2 == 0
        pairs = (
            level.filter("left_over > 1")
            .groupBy(*_KEY, "n_blocks", "left_over", F.floor(F.col("idx") / 2).cast("int").alias("pair"))
            .agg(
                F.max(F.when(even, F.col("h"))).alias("h1"),
                F.max(F.when(even, F.col("rank"))).alias("r1"),
                F.coalesce(F.max(F.when(~even, F.col("h"))), F.lit(0)).alias("h2"),
                F.coalesce(F.max(F.when(~even, F.col("rank"))), F.lit(-1)).alias("r2"),
            )
            .withColumn("h", F.xxhash64("h1", "r1", "h2", "r2"))
            .withColumn("left_over", F.ceil(F.col("left_over") / 2).cast("int"))
            .withColumnRenamed("pair", "idx")
        )
        pairs = materialize(pairs, "pairs")
        level = materialize(_named(pairs, ["h1", "r1", "h2", "r2"], pairs, pairs.count()), "names")
        width = -(-width // 2)
    names = level
    for d in done:
        names = names.unionByName(d)
    return heads.drop("hs"), names.select(*_KEY, F.col("h").alias("name"), "rank").distinct()


def exact_groups(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document: doc_id, keep_id, group_size, kept, text_sha256 and the row's key.

    Of equal texts the row with the most code points in its original text stays, then the smallest
    doc_id.
    """
    heads, names = name_documents(docs, block_chars)
    ident = ["n_blocks", "name", "rank"]
    # Rows that agree in id, text and length are counted and unfolded again at the end.
    rows = materialize(
        heads.groupBy("doc_id", *_KEY, "n_chars", "n_blocks").count().join(names, _KEY), "rows"
    )
    groups = materialize(
        rows.groupBy(*ident).agg(
            F.sum("count").alias("group_size"),
            F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").alias("id"))).alias("best"),
        ),
        "groups",
    )
    best = F.col("doc_id").eqNullSafe(F.col("best.id")) & (-F.col("n_chars") == F.col("best.size"))
    joined = rows.join(groups, ident).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))))
    return joined.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (best & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "doc_key",
        "sha",
        "n_chars",
        F.col("count").alias("copies"),
    )


def keep_one(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without exact copies, with all their columns."""
    mine = {
        unused(docs, "own_key"): F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))),
        unused(docs, "own_sha"): F.unhex(F.sha2(normalised(F.col("text")), 256)),
        unused(docs, "own_chars"): F.length(F.coalesce(F.col("text"), F.lit(""))),
    }
    theirs = [unused(docs, f"kept_{c}") for c in ("key", "sha", "chars")]
    kept = exact_groups(docs, block_chars).filter("kept").select(
        *[F.col(c).alias(n) for c, n in zip(("doc_key", "sha", "n_chars"), theirs, strict=True)], "copies"
    )
    kept = materialize(kept, "kept")
    on = [F.col(a) == F.col(b) for a, b in zip(mine, theirs, strict=True)]
    found = docs.withColumns(mine).join(kept, on, "left_semi")
    if not kept.filter("copies > 1").isEmpty():
        place = unused(docs, "place")
        others = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind and c != "text"]
        first = Window.partitionBy(*mine).orderBy("text", *others)
        found = found.withColumn(place, F.row_number().over(first)).filter(F.col(place) == 1)
    return found.select(*docs.columns)
