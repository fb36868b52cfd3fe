"""Language identification by fusing evidence in the manner of Bayes.

The posterior of a language is proportional to the product of

* the likelihood of the text under the language's byte trigrams, tempered to EFFECTIVE_GRAMS
  independent grams since neighbouring trigrams depend on each other,
* the probability that the language's texts are declared as this one is (a ``lang`` attribute in
  markup, a language column), and
* a prior of the host, smoothed towards its address suffix, which is smoothed towards the corpus.

Declaration tables and priors are counted from the text likelihoods of all rows by one grouped
aggregation; a language is taken to declare itself DECLARED_SELF times before anything is counted. An
unknown class ("und"), whose text spreads over UNKNOWN_GRAMS trigrams alike, competes with the
languages: what no language explains is rejected, as are texts without a letter and rows whose
language has a posterior below LEAST_POSTERIOR.

The trigram tables are fitted on about TRAIN_ROWS labelled rows of a language, picked by a hash of
their key; everything else covers all rows. Where the rows to identify are the labelled ones, they are
dealt into two folds and the text of a row is read with tables of the other fold, so its own label
is evidence as a declaration only. A table of few grams counts less: its evidence is drawn towards that
of the unknown class. Codes are taken without region or script (``en-GB`` is ``en``).

Codes with fewer than LEAST_ROWS labelled rows, and those beyond the MOST_TABLES most frequent ones,
have no table. A row that declares such a code may still be told to be in it: the code is one more
class of that row only, whose text is read as that of an unknown language, with a prior and a
declaration of its own. So rows carry MOST_TABLES + 2 values at most, however many codes there are.

Edge cases: null and empty texts give no text evidence and are rejected as "und". A null declaration
is no evidence; null hosts and suffixes are a group of their own. Very long texts are read whole.
Repeated rows count as often as they occur. Ties go to the language that sorts first, then to the
declared code without a table. With no table at all a row is in the language that it declares or
"und". Other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import bounded_batches, materialize, unused

#: Labelled rows of one language that trigram tables are fitted on, about.
TRAIN_ROWS = 2000
#: Trigram classes.
GRAMS = 1 << 15
#: Weight of a text in grams that count as independent.
EFFECTIVE_GRAMS = 40
#: Pseudo counts: of the corpus prior in a suffix, of the suffix prior in a host, of a declaration.
SUFFIX_PRIOR, HOST_PRIOR, DECLARED_PRIOR = 20.0, 20.0, 1.0
#: Pseudo count of a language's declarations as itself.
DECLARED_SELF = 20.0
#: Prior of the unknown class, and trigram classes over which its texts spread.
UNKNOWN_PRIOR, UNKNOWN_GRAMS = 0.001, 10_000
#: Least posterior of a language that is accepted.
LEAST_POSTERIOR = 0.5
#: Labelled rows that a language needs for a table, and tables at most (128 kB for each fold).
LEAST_ROWS, MOST_TABLES = 10, 400
#: Grams from which a table counts more than half.
RELIABLE_GRAMS = 2000
#: Hosts, declarations and numbers in their tables up to which they are broadcast; with more the joins are shuffled.
BROADCAST_HOSTS, BROADCAST_VALUES = 50_000, 2_000_000
#: Folds of labelled rows that are identified themselves.
FOLDS = 2

UNKNOWN, OWN = "und", "declared code without a table"


def grams(text: str | None) -> np.ndarray:
    """Trigram classes of the lower-cased UTF-8 bytes of a text."""
    a = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
    return ((a[:-2] << 10) ^ (a[1:-1] << 5) ^ a[2:]) & (GRAMS - 1) if len(a) > 2 else np.zeros(0, np.uint16)


class Model:
    """Log probabilities of trigrams by language; OWN (a declared code without a table) and UNKNOWN follow the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, OWN, UNKNOWN]
        size = counts.sum(1, keepdims=True)
        self.log_p = np.ascontiguousarray(np.log((counts + 0.5) / (size + 0.5 * GRAMS)).T.astype(np.float32))
        self.weight = (size / (size + RELIABLE_GRAMS))[:, 0]

    def evidence(self, text: str | None, own: bool = False) -> np.ndarray:
        """Tempered log likelihood of each class; zeros where there is nothing to read. OWN is out of the question unless own."""
        g = grams(text)
        total = np.zeros(len(self.weight))
        for at in range(0, len(g), 1 << 18):
            total += self.log_p[g[at : at + (1 << 18)]].sum(0, dtype=np.float64)
        unknown = -np.log(UNKNOWN_GRAMS)
        read = self.weight * (total / max(len(g), 1)) + (1 - self.weight) * unknown
        return np.append(read, [unknown, unknown]) * min(len(g), EFFECTIVE_GRAMS) + np.append(np.zeros(len(read)), [0.0 if own else -np.inf, 0.0])


def code(lang: Column) -> Column:
    """A language code without region and script, in lower case; null if nothing is left."""
    return F.nullif(F.lower(F.trim(F.regexp_extract(lang.cast("string"), r"^([^-_]*)", 1))), F.lit(""))


def _fold(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(13)), F.lit(FOLDS)).cast("int")


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS, crossed: bool = False, least_rows: int = LEAST_ROWS, most_tables: int = MOST_TABLES) -> list[Model]:
    """Models from rows (key, text, lang), without those that have no language.

    One model, or if crossed one for each fold of keys, fitted on the rows of the others.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select("key", "text", code(F.col("lang")).alias("lang")).filter("lang is not null")
    sizes = rows.groupBy("lang").count().filter(F.col("count") >= least_rows).orderBy(F.desc("count"), "lang").limit(most_tables)
    found = {r["lang"]: r["count"] for r in sizes.collect()}  # most_tables at most
    languages = sorted(found)
    folds = FOLDS if crossed else 1
    if not languages:
        return [Model([], np.zeros((0, GRAMS)))] * folds
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, train_rows / found[lang]))])
    unit = F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 11) / F.lit(float(1 << 53))
    picked = rows.filter(unit < share[F.col("lang")])
    picked = picked.select("lang", _fold(F.col("key")).alias("fold") if crossed else F.lit(0).alias("fold"), "text")

    def count(batches):
        found = {}
        for b in batches:
            for lang, fold, text in zip(b["lang"], b["fold"], b["text"], strict=True):
                n = np.bincount(grams(text), minlength=GRAMS)
                found[lang, fold] = found.get((lang, fold), 0) + n
        for (lang, fold), n in found.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "fold": fold, "gram": at.astype(np.int32), "n": n[at].astype(np.int64)})

    counted = picked.mapInPandas(count, "lang string, fold int, gram int, n long")
    # At most GRAMS rows for each language and fold, whatever the size of the corpus.
    table = counted.groupBy("lang", "fold", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((folds, len(languages), GRAMS))
    at = {x: i for i, x in enumerate(languages)}
    counts[table["fold"].to_numpy(), table["lang"].map(at).to_numpy(int), table["gram"].to_numpy()] = table["n"].to_numpy()
    return [Model(languages, counts.sum(0) - (counts[i] if crossed else 0)) for i in range(folds)]


def _text_evidence(models: list[Model], text: Column, fold: Column, own: Column, soft: bool = False) -> Column:
    """Tempered log likelihoods of the classes, or if soft the probabilities that follow from them."""

    def one(text: str | None, i: int, own: bool) -> np.ndarray:
        ll = models[i].evidence(text, own)
        return _soft(ll) if soft else ll

    score = F.pandas_udf(lambda s, f, o: pd.Series([one(*x) for x in zip(s, f, o, strict=True)], dtype=object), "array<double>")
    return score(text, fold, own)


def _soft(ll: np.ndarray) -> np.ndarray:
    """Probabilities from log values."""
    e = np.exp(ll - ll.max())
    return e / e.sum()


def _arrays(of: Callable[..., np.ndarray], *columns: Column) -> Column:
    """A column of arrays that a function of each row's arrays gives."""
    return F.pandas_udf(lambda *c: pd.Series([of(*map(np.asarray, x)) for x in zip(*c, strict=True)], dtype=object), "array<double>")(*columns)


def _priors(cells: DataFrame, model: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log priors by host, log probabilities of declarations (arrays over classes), and log priors of OWN by host and declaration."""
    names = [f"c{i}" for i in range(len(model.languages))]
    own, add = names[-2], [F.sum(c).alias(c) for c in names]
    total = np.array([x or 0.0 for x in cells.agg(*add).first()])
    mass = total[:-1].sum() or 1.0
    base = np.append((total[:-1] / mass + 1e-6) * (1 - UNKNOWN_PRIOR), UNKNOWN_PRIOR)

    def smoothed(host: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        of_suffix = (suffix + SUFFIX_PRIOR * base) / (suffix[:-1].sum() + SUFFIX_PRIOR)
        of_host = (host + HOST_PRIOR * of_suffix) / (host[:-1].sum() + HOST_PRIOR)
        return np.log(np.append(of_host[:-1], UNKNOWN_PRIOR))

    known = lambda c: F.aggregate(F.slice(c, 1, len(names) - 1), F.lit(0.0), lambda a, b: a + b)
    suffix = cells.groupBy("suffix").agg(*add).select("suffix", F.array(*names).alias("of_suffix"))
    host = cells.groupBy("suffix", "host").agg(*add).select("suffix", "host", F.array(*names).alias("of_host"))
    both = host.join(suffix, "suffix")
    hosts = both.select(
        "suffix", "host", _arrays(smoothed, F.col("of_host"), F.col("of_suffix")).alias("log_prior"),
        known(F.col("of_host")).alias("host_mass"), known(F.col("of_suffix")).alias("suffix_mass"),
    )
    # A code without a table has the same smoothing, from its own rows.
    rare = cells.filter(F.col(own) > 0).select("declared", "suffix", "host", F.col(own).alias("mine"))
    over = lambda *by: F.sum("mine").over(Window.partitionBy(*by))
    rare = rare.withColumn("base", (over("declared") / mass + 1e-6) * (1 - UNKNOWN_PRIOR)).withColumn("here", over("declared", "suffix"))
    rare = rare.join(hosts.select("suffix", "host", "host_mass", "suffix_mass"), ["suffix", "host"])
    of_suffix = (F.col("here") + SUFFIX_PRIOR * F.col("base")) / (F.col("suffix_mass") + SUFFIX_PRIOR)
    rare = rare.select("declared", "suffix", "host", F.log((F.col("mine") + HOST_PRIOR * of_suffix) / (F.col("host_mass") + HOST_PRIOR)).alias("own_prior"))
    declared = cells.filter("declared is not null").groupBy("declared").agg(*add)
    sums = declared.agg(F.count(F.lit(1)), *add).first()
    kinds, seen = float(sums[0] or 1), np.array([x or 0.0 for x in sums[1:]])

    def told(counts: np.ndarray, itself: str) -> np.ndarray:
        pseudo, all_of = np.full(len(counts), DECLARED_PRIOR), seen.copy()
        pseudo[model.languages.index(itself) if itself in model.languages else -2] += DECLARED_SELF
        all_of[-2] = counts[-2]
        return np.append(np.log((counts + pseudo) / (all_of + DECLARED_PRIOR * kinds + DECLARED_SELF))[:-1], -np.log(kinds))

    logs = F.pandas_udf(lambda c, d: pd.Series([told(np.asarray(x), y) for x, y in zip(c, d, strict=True)], dtype=object), "array<double>")
    return hosts.select("suffix", "host", "log_prior"), declared.select("declared", logs(F.array(*names), F.col("declared")).alias("log_declared")), rare


def identify(
    rows: DataFrame, models: list[Model], text: str, declared: Column, host: Column, suffix: Column, key: Column | None = None
) -> DataFrame:
    """The rows with a last column identified: language, posterior, text_language and accepted.

    The column has another name (identified_ and so on) where rows has one of this name. Rows are read
    with the model of the fold of their key if there are several.
    """
    names = models[0].languages
    langs, zero = F.array(*[F.lit(x) for x in names]), F.array(*[F.lit(0.0)] * len(names))
    bounded_batches(rows.sparkSession)
    facts = [declared.alias("declared"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(suffix, F.lit("")).alias("suffix")]
    fold = _fold(key) if len(models) > 1 else F.lit(0)
    own = F.coalesce(~declared.isin(names[:-2]), F.lit(False)) if len(names) > 2 else declared.isNotNull()
    seen = rows.select(*facts, _text_evidence(models, F.col(text), fold, own, soft=True).alias("p"))
    cells = materialize(
        seen.groupBy("declared", "host", "suffix").agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(len(names))]), "evidence"
    )
    hosts, told, rare = (materialize(x, name) for x, name in zip(_priors(cells, models[0]), ("host-priors", "declarations", "rare-codes"), strict=True))
    counts = [x.count() for x in (hosts, told, rare)]
    side = F.broadcast if max(counts) <= BROADCAST_HOSTS and sum(counts[:2]) * len(names) <= BROADCAST_VALUES else (lambda x: x.hint("merge"))
    letters = F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}").alias("letters")
    fused = (
        rows.select(F.struct(*rows.columns).alias("row"), letters, *facts, _text_evidence(models, F.col(text), fold, own).alias("ll"))
        .join(side(hosts), ["suffix", "host"], "left")
        .join(side(told), "declared", "left")
        .join(side(rare), ["declared", "suffix", "host"], "left")
    )
    add = lambda a, b: a + b
    prior = F.transform(F.coalesce("log_prior", zero), lambda x, i: F.when(i == len(names) - 2, F.coalesce("own_prior", x)).otherwise(x))
    post = F.zip_with(F.zip_with("ll", prior, add), F.coalesce("log_declared", zero), add)
    # The greatest value is bound once and the row's probability follows from it.
    peak = lambda c, m: F.struct(
        langs[F.array_position(c, m).cast("int") - 1].alias("language"),
        (1.0 / F.aggregate(c, F.lit(0.0), lambda s, x: s + F.exp(x - m))).alias("posterior"),
    )
    top = lambda c: F.transform(F.array(F.array_max(c)), lambda m: peak(c, m))[0]
    fused = fused.withColumn("post", post).select("row", "letters", "declared", top(F.col("post")).alias("fused"), top(F.col("ll")).alias("read"))
    named = lambda c, other: F.when(~F.col("letters"), UNKNOWN).when(c == OWN, other).otherwise(c)
    language = named(F.col("fused.language"), F.col("declared"))
    found = F.struct(
        language.alias("language"),
        F.when(F.col("letters"), F.col("fused.posterior")).otherwise(0.0).alias("posterior"),
        named(F.col("read.language"), F.lit(UNKNOWN)).alias("text_language"),
        ((language != UNKNOWN) & (F.col("fused.posterior") >= LEAST_POSTERIOR)).alias("accepted"),
    )
    return fused.select("row.*", found.alias(unused(rows, "identified")))


def identify_documents(docs: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Documents with their language; the lang column is the declaration, source is the host.

    A source may be an address: its last label is the suffix.
    """
    models = fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"), crossed=True, least_rows=least_rows)
    source = F.col("source")
    return identify(docs, models, "text", code(F.col("lang")), source, _suffix(source), F.col("doc_id"))


def _suffix(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(F.substring_index(host, ":", 1), ".", -1))


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, host and suffix of raw pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    body = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1))
    return pages.select(
        "page_id",
        F.regexp_replace(F.regexp_replace(body, r"<[^>]*>", " "), r"&[#\w]+;", " ").alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"),
        host.alias("host"),
        _suffix(host).alias("suffix"),
    )


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Pages with their language; trigrams come from labelled rows (key, text, lang)."""
    facts = page_evidence(pages)
    out = identify(facts, fit(labelled), "text", F.col("declared"), F.col("host"), F.col("suffix"))
    return out.select("page_id", "host", "suffix", "declared", "identified.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known, with all their columns."""
    out = identify_documents(docs)
    return out.filter(F.col(f"{out.columns[-1]}.accepted")).select(*docs.columns)
