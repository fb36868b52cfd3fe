"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic) by tokens. Iterative proportional fitting
scales the cells in turn until the token shares by source, by language and by topic match their
targets at once. A cell's weight is its fitted share over its own; a document is sampled with the
probability rate x weight of its cell, so that the sample has the given share of all tokens and its
expected token shares are the targets. No probability may pass one: a cell is never fitted above
the tokens that it has, and its margins are made up by other cells (where a target asks for more
than there is, the nearest mixture is found). Whether a document is drawn depends on a hash of its doc_id
and a seed alone.

Where no topic column is given, topics come from the words that occur together. A document's profile
is the random projection of its long words (more than five characters) on PROFILE axes, of unit
length and less the mean profile of its language, so that topics do not just repeat languages. Its
topic is the octant of the profile in the three leading principal axes of all profiles. Sums over the
corpus are of integers, so topics do not depend on the order of addition.

Targets default to the corpus shares raised to a power below one and normalised, which lifts small
groups. Targets for groups that the corpus lacks are left out and the rest is normalised.

Edge cases: null sources, languages and topics are a group of their own (''); null and empty texts
have no tokens and take the weight of their cell, one if the whole cell has none. Repeated rows
count as often as they occur and are drawn together. A null doc_id is drawn like an id of its own.
An empty table gives an empty result. A profile on the border of octants counts as the upper one;
texts without a long word have the topic ''. Other columns pass through untouched, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize, unused

#: Axes of a profile, units in its length, and leading axes that topics are octants of.
PROFILE, UNIT, AXES = 32, 1000, 3
#: Powers of the default targets.
SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER = 0.7, 0.7, 0.5
#: Share of all tokens that a sample is to have.
SAMPLE_RATE = 0.5
#: Raking ends when no margin is off by more than this share, or after so many sweeps.
TOLERANCE, SWEEPS = 1e-10, 500
#: Cells up to which raking runs on the driver (a table of groups, not of documents) and weights are
#: broadcast; with more, both are joins and windows.
DRIVER_CELLS = 50_000

MARGINS = ("source", "lang", "topic")


def _codes(text: str) -> tuple[int, list[int]]:
    """Number of words of a text, and hashes of those of more than five characters in lower case."""
    words, low = text.split(), text.lower().encode("utf-8", "surrogatepass").split()
    if len(low) != len(words):  # white space beyond ASCII
        low = [w.lower().encode("utf-8", "surrogatepass") for w in words]
    digest = xxhash.xxh32_intdigest
    return len(words), [digest(x) for w, x in zip(words, low, strict=True) if len(w) > 5]


def _profiles(texts: pd.Series) -> Iterator[tuple[int, np.ndarray | None]]:
    """Number of tokens and profile (integers) of each text; no profile without a long word."""
    for text in texts:
        n, codes = _codes(text or "")
        if not codes:
            yield n, None
            continue
        bits = np.unpackbits(np.array(codes, "<u4").view(np.uint8).reshape(-1, 4), axis=1)
        v = 2.0 * bits.sum(0, dtype=np.int64) - len(codes)
        norm = float(np.linalg.norm(v))
        yield n, np.rint(v * (UNIT / norm)).astype(np.int64) if norm else np.zeros(PROFILE, np.int64)


def _counts(texts: pd.Series) -> pd.DataFrame:
    found = list(_profiles(texts))
    return pd.DataFrame({"tokens": [n for n, _ in found], "profile": [p for _, p in found]})


class Topics:
    """Mean profile of each language and the principal axes."""

    def __init__(self, means: dict[str, np.ndarray], axes: np.ndarray):
        self.means, self.axes = means, axes

    def of(self, profile, lang: str) -> str:
        if profile is None:
            return ""
        at = (np.asarray(profile) - self.means.get(lang, 0.0)) @ self.axes
        return str(int(((at >= 0) << np.arange(len(at))).sum()))


def fit_topics(profiles: DataFrame) -> Topics:
    """Topics from all rows (lang, profile) that have a profile."""
    at = np.triu_indices(PROFILE)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, part in b.groupby("lang"):
                x = np.stack(part["profile"].to_numpy()).astype(np.int64)
                own = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[at]])
                found[lang] = found.get(lang, 0) + own
        for lang, own in found.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(len(own), dtype=np.int32), "n": own})

    parts = profiles.filter("profile is not null").mapInPandas(sums, "lang string, place int, n long")
    # A row for each language and pair of axes, whatever the size of the corpus.
    table = parts.groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    means, spread = {}, np.zeros((PROFILE, PROFILE))
    for lang, own in sorted(table.groupby("lang")):
        own = own.sort_values("place")["n"].to_numpy()
        n, total, products = int(own[0]), own[1 : PROFILE + 1], np.zeros((PROFILE, PROFILE))
        products[at] = own[PROFILE + 1 :]
        means[lang] = total / n
        spread += products - np.triu(np.outer(total, total) / n)
    axes = np.linalg.eigh(spread + np.triu(spread, 1).T)[1][:, ::-1][:, :AXES]
    return Topics(means, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(AXES)]))


def _grouped(docs: DataFrame, topic: str | None, topics: Topics | None = None) -> DataFrame:
    """row (the columns of docs), source, lang and tokens of each document; its topic, or its profile if none is known yet."""
    bounded_batches(docs.sparkSession)
    group = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lang = group("lang")
    if topics:
        # One function for both facts: a second one would need a Python process of its own in every task.
        def facts(texts, langs):
            found = [(n, topics.of(p, g)) for (n, p), g in zip(_profiles(texts), langs, strict=True)]
            return pd.DataFrame(found, columns=["tokens", "topic"])

        counts = F.pandas_udf(facts, "struct<tokens:long,topic:string>")("text", lang)
    else:
        counts = F.pandas_udf(_counts, "struct<tokens:long,profile:array<long>>")("text")
    rows = docs.select(F.struct(*docs.columns).alias("row"), group("source").alias("source"), lang.alias("lang"), counts.alias("counts"))
    rows = rows.select("row", "source", "lang", "counts.*")
    return rows.withColumn("topic", F.coalesce(F.col(f"row.{topic}").cast("string"), F.lit(""))) if topic else rows


def _with_topics(rows: DataFrame, topics: Topics) -> DataFrame:
    of = F.pandas_udf(lambda p, g: pd.Series([topics.of(x, y) for x, y in zip(p, g, strict=True)], dtype=object), "string")
    return rows.withColumn("topic", of("profile", "lang"))


def rake(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]], rate: float = SAMPLE_RATE) -> np.ndarray:
    """Fitted token shares of cells (columns of MARGINS and tokens), none above its share over rate."""
    own_share = cells["tokens"].to_numpy(float)
    own_share = own_share / own_share.sum() if own_share.sum() else own_share
    fitted, most = own_share, own_share / rate
    sides = []
    for m in MARGINS:
        codes, names = pd.factorize(cells[m])
        goal = np.array([targets[m].get(x, 0.0) for x in names], float)
        goal = np.where(np.bincount(codes, fitted, len(names)) > 0, goal, 0.0)
        sides.append((codes, goal / goal.sum() if goal.sum() else goal, len(names)))
    for _ in range(SWEEPS):
        off = 0.0
        for codes, goal, n in sides:
            own = np.bincount(codes, fitted, n)
            scale = np.divide(goal, own, out=np.zeros(n), where=own > 0)
            off = max(off, float(np.abs(goal - own).max(initial=0.0)))
            fitted = np.minimum(fitted * scale[codes], most)
        if off < TOLERANCE:
            break
    return fitted


def _rake_distributed(
    cells: DataFrame, targets: Mapping[str, DataFrame], rate: float = SAMPLE_RATE, sweeps: int | None = None
) -> DataFrame:
    """The same by joins, for more cells than a driver should hold; each sweep is one written table.

    It ends by the rule of rake(), after at most so many sweeps (SWEEPS unless given).
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    now = cells.withColumn("fitted", F.col("tokens") / total)
    for m in MARGINS:
        present = cells.groupBy(m).agg(F.sum("tokens").alias("n")).filter("n > 0")
        goals = targets[m].join(present, m)
        mass = goals.agg(F.sum("goal")).first()[0] or 1.0
        now = now.join(goals.select(m, (F.col("goal") / mass).alias(f"goal_{m}")), m, "left")
    for _ in range(SWEEPS if sweeps is None else sweeps):
        now = now.drop(*[f"own_{m}" for m in MARGINS])
        for m in MARGINS:
            own = now.groupBy(m).agg(F.sum("fitted").alias(f"own_{m}"))
            scaled = F.col("fitted") * F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) / F.col(f"own_{m}")
            capped = F.least(scaled, F.col("tokens") / (total * rate))
            now = now.join(own, m).withColumn("fitted", F.when(F.col(f"own_{m}") > 0, capped).otherwise(0.0))
        now = materialize(now, "raking")
        errors = [F.abs(F.coalesce(F.col(f"goal_{m}"), F.lit(0.0)) - F.col(f"own_{m}")) for m in MARGINS]
        off = now.agg(F.max(F.greatest(*errors))).first()[0]
        if off is None or off < TOLERANCE:
            break
    return now.drop(*[f"{x}_{m}" for x in ("goal", "own") for m in MARGINS])


def _default_targets(cells: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for m, power in zip(MARGINS, (SOURCE_POWER, LANGUAGE_POWER, TOPIC_POWER), strict=True):
        shares = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("goal"))
        total = shares.agg(F.sum("goal")).first()[0] or 1.0
        out[m] = shares.withColumn("goal", F.col("goal") / total)
    return out


def cell_weights(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    topic: str | None = None,
    rate: float = SAMPLE_RATE,
) -> tuple[DataFrame, Topics | None]:
    """A row for each cell, and the topics: source, lang, topic, docs, tokens, fitted, weight and probability."""
    facts = materialize(_grouped(docs, topic).drop("row"), "mixing-counts")
    topics = None
    if topic is None:
        topics = fit_topics(facts.select("lang", "profile"))
        facts = _with_topics(facts, topics)
    cells = facts.groupBy(*MARGINS).agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    spark = docs.sparkSession
    if cells.count() <= DRIVER_CELLS:
        local = cells.orderBy(*MARGINS).toPandas()
        if targets is None:
            goals = {m: {r[m]: r["goal"] for r in t.collect()} for m, t in _default_targets(cells).items()}
        else:
            goals = {m: dict(targets[m]) for m in MARGINS}
        local["fitted"] = rake(local, goals, rate)
        schema = "source string, lang string, topic string, docs long, tokens long, fitted double"
        fitted = spark.createDataFrame(local, schema) if len(local) else spark.createDataFrame([], schema)
    else:
        goals = _default_targets(cells) if targets is None else {
            m: spark.createDataFrame(list(targets[m].items()), f"{m} string, goal double") for m in MARGINS
        }
        fitted = _rake_distributed(cells, goals, rate)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    weighed = fitted.withColumn(
        "weight", F.when(F.col("tokens") > 0, F.col("fitted") * float(total) / F.col("tokens")).otherwise(1.0)
    )
    weighed = materialize(weighed, "cell-weights")
    return weighed.withColumn("probability", F.least(F.col("weight") * rate, F.lit(1.0))), topics


def margin_errors(cells: DataFrame, targets: Mapping[str, Mapping[str, float]]) -> dict[str, float]:
    """By how much the fitted shares miss the targets, at most, on each margin."""
    out = {}
    for m in MARGINS:
        goals = cells.sparkSession.createDataFrame(list(targets[m].items()), f"{m} string, goal double")
        got = cells.groupBy(m).agg(F.sum("fitted").alias("own"))
        miss = F.abs(F.coalesce("own", F.lit(0.0)) - F.coalesce("goal", F.lit(0.0)))
        out[m] = got.join(goals, m, "full").agg(F.max(miss)).first()[0] or 0.0
    return out


def weigh(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    topic: str | None = None,
    rate: float = SAMPLE_RATE,
    seed: int = 1,
) -> DataFrame:
    """The documents with a last column mix: topic, tokens, weight, probability and sampled.

    The column has another name (mix_ and so on) where docs has one of this name.
    """
    cells, topics = cell_weights(docs, targets, topic, rate)
    side = cells.select(*MARGINS, "weight", "probability")
    side = F.broadcast(side) if cells.count() <= DRIVER_CELLS else side
    unit = F.shiftrightunsigned(F.xxhash64(F.col("row.doc_id"), F.lit(seed)), 11) / F.lit(float(1 << 53))
    mix = F.struct("topic", "tokens", "weight", "probability", (unit < F.col("probability")).alias("sampled"))
    return _grouped(docs, topic, topics).join(side, list(MARGINS)).select("row.*", mix.alias(unused(docs, "mix")))


def sample(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    rate: float = SAMPLE_RATE,
    seed: int = 1,
) -> DataFrame:
    """The drawn documents, with all their columns."""
    drawn = weigh(docs, targets, rate=rate, seed=seed)
    return drawn.filter(F.col(f"{drawn.columns[-1]}.sampled")).select(*docs.columns)
