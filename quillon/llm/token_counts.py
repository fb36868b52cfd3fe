"""Token counts by rank-synchronous merging of ragged arrays.

A text is cut into pre-tokens (spaces and what follows them, up to the next space), and each batch of
rows numbers its distinct ones. The new ones of a batch are held as one ragged array of symbols:

1. A sequence is cut wherever two characters stand side by side in no piece of the vocabulary, since
   no merge can ever span such a place.
2. In each round every sequence merges its pair of lowest rank, all sequences at once. Where the
   pair occurs more than once, all its occurrences (the left one of two that overlap) are merged
   together, unless a pair that arises would have come before the next occurrence; such a sequence
   merges its leftmost one only, as one merge after the other would do.
3. When no sequence has a pair left, the surviving symbols are counted: a piece is one token, a
   character that is no piece is as many tokens as it has bytes.

Sequences of more than LONG_SEQUENCE symbols (very long runs without a place to cut) take the same
merges from a heap of pairs, in n log n steps.

Rows are counted where they are read; nothing is shuffled. A Python worker keeps the counts of at
most KEPT_WORDS pre-tokens and starts anew beyond.

Edge cases: a null or empty text has no tokens and no bytes. Texts of any length are counted whole.
Repeated rows, null ids and an empty table are nothing special, and other columns are never looked
at. Control strings such as <s> inside a text are ordinary text, as the library reads them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 4096
#: Pre-tokens whose counts a worker keeps.
KEPT_WORDS = 400_000
#: Symbols above which a sequence is merged from a heap.
LONG_SEQUENCE = 512
#: Characters above which a text is cut piece by piece instead of into a list.
LONG_TEXT = 4_000_000
#: The mark that stands for a space in pieces.
SPACE = "▁"
#: Rank of pairs that no piece joins.
NEVER = np.int32(2**31 - 1)


class Merges(NamedTuple):
    """What merging needs of a model: symbols are the characters of all pieces, then the longer pieces."""

    characters: np.ndarray  # code points in ascending order; a symbol's number is its place
    pairs: np.ndarray  # left symbol * number of symbols + right symbol, in ascending order
    ranks: np.ndarray  # rank of the piece that a pair makes
    made: np.ndarray  # symbol that a pair makes
    tokens: np.ndarray  # tokens of a symbol that survives
    neighbours: np.ndarray  # pairs of characters that stand side by side in a piece, coded as pairs
    dummy_prefix: bool
    byte_fallback: bool
    pattern: re.Pattern


def model_path() -> str:
    """The default model: byte-pair pieces of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """Read a BPE model. Models with features that this operator has no rule for are refused."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, kinds = model.normalizer_spec, model.SentencePiece
    if model.trainer_spec.model_type != model.trainer_spec.BPE:
        raise ValueError("not a byte-pair model")
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
        raise ValueError("models that rewrite characters or spaces are not supported")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces are not supported")
    scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    characters = sorted({c for piece in scores for c in piece})
    longer = [p for p in scores if len(p) > 1]
    number = {s: i for i, s in enumerate([*characters, *longer])}
    order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
    joined = {}
    for piece in longer:
        for cut in range(1, len(piece)):
            left, right = number.get(piece[:cut]), number.get(piece[cut:])
            if left is not None and right is not None:
                joined[left * len(number) + right] = (order[scores[piece]], number[piece])
    pairs = sorted(joined)
    fallback = model.trainer_spec.byte_fallback
    lost = [len(c.encode("utf-8", "surrogatepass")) if fallback else 1 for c in characters]
    tokens = [1 if c in scores else n for c, n in zip(characters, lost, strict=True)] + [1] * len(longer)
    beside = {number[p[i]] * len(number) + number[p[i + 1]] for p in longer for i in range(len(p) - 1)}
    # Spaces open a pre-token, and line ends stand alone, if no piece says otherwise.
    apart = not any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in scores)
    return Merges(
        np.array([ord(c) for c in characters], np.uint32),
        np.array(pairs, np.int64),
        np.array([joined[p][0] for p in pairs], np.int32),
        np.array([joined[p][1] for p in pairs], np.int32),
        np.array(tokens, np.int64),
        np.array(sorted(beside), np.int64),
        rules.add_dummy_prefix,
        fallback,
        re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+" if apart else r"(?s:.+)"),
    )


def _places(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted value in an ascending table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
    return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))


def _pair_ranks(m: Merges, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and symbol of each pair; NEVER where they belong to different sequences or make no piece."""
    at, known = _places(m.pairs, np.where(joined & (left >= 0) & (right >= 0), left.astype(np.int64) * len(m.tokens) + right, -1))
    if not len(m.pairs):
        return np.full(len(left), NEVER), np.zeros(len(left), np.int32)
    return np.where(known, m.ranks[at], NEVER), m.made[at]


def _heap_merge(m: Merges, symbols: list[int]) -> list[int]:
    """The symbols that survive in one sequence, merged pair by pair: lowest rank first, then leftmost."""
    n, size = len(symbols), len(m.tokens)
    table = dict(zip(m.pairs.tolist(), zip(m.ranks.tolist(), m.made.tolist(), strict=True), strict=True))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := table.get(symbols[i] * size + symbols[j])):
            heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

    for i in range(n - 1):
        offer(i)
    gone = set()
    while heap:
        _, i, left, right, made = heapq.heappop(heap)
        j = after[i] if i not in gone else n
        if j >= n or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], after[i] = made, after[j]
        gone.add(j)
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [s for i, s in enumerate(symbols) if i not in gone]


def _starts(sequence: np.ndarray) -> np.ndarray:
    """Where each sequence of a ragged array begins."""
    return np.flatnonzero(np.append(True, sequence[1:] != sequence[:-1]))


def _rounds(m: Merges, symbol: np.ndarray, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their sequences that survive when every sequence has merged its pairs in order of rank."""
    done_symbols, done_sequences = [], []
    rank = made = None
    while len(symbol):
        if rank is None:
            joined = np.append(sequence[1:] == sequence[:-1], False)
            rank, made = _pair_ranks(m, symbol, np.append(symbol[1:], -1), joined)
        starts = _starts(sequence)
        sizes = np.diff(np.append(starts, len(symbol)))
        least = np.minimum.reduceat(rank, starts)
        over = np.repeat(least == NEVER, sizes)
        if over.any():
            done_symbols.append(symbol[over])
            done_sequences.append(sequence[over])
            symbol, sequence, rank, made = symbol[~over], sequence[~over], rank[~over], made[~over]
            sizes, least = sizes[least != NEVER], least[least != NEVER]
            if not len(symbol):
                break
        own = np.repeat(least, sizes)
        hit = rank == own
        # Of hits that follow each other, every second one overlaps the merged one before it.
        at = np.arange(len(hit))
        opens = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, -1))
        hit &= (at - opens) % 2 == 0
        state = _merged(m, symbol, sequence, rank, made, hit)
        sizes = np.diff(np.append(_starts(state[1]), len(state[1])))
        early = state[4] & (state[2] <= np.repeat(least, sizes))
        if early.any():
            careful = np.isin(sequence, np.unique(state[1][early]))
            first = np.flatnonzero(hit & careful)
            first = first[np.append(True, sequence[first][1:] != sequence[first][:-1])]
            hit &= ~careful
            hit[first] = True
            state = _merged(m, symbol, sequence, rank, made, hit)
        symbol, sequence, rank, made, _ = state
    return (
        np.concatenate(done_symbols) if done_symbols else symbol,
        np.concatenate(done_sequences) if done_sequences else sequence,
    )


def _merged(m: Merges, symbol, sequence, rank, made, hit) -> tuple:
    """The arrays after all hits are merged, with a mark on pairs that have changed."""
    keep = ~np.append(False, hit[:-1])
    new = np.where(hit, made, symbol)[keep]
    fresh = hit[keep]
    sequence, rank, made = sequence[keep], rank[keep].copy(), made[keep].copy()
    changed = fresh | np.append(fresh[1:], False)
    at = np.flatnonzero(changed)
    after = np.minimum(at + 1, len(new) - 1)
    joined = (after > at) & (sequence[at] == sequence[after])
    rank[at], made[at] = _pair_ranks(m, new[at], new[after], joined)
    return new, sequence, rank, made, changed


def count_pretokens(words: list[str], path: str) -> np.ndarray:
    """Tokens of each pre-token (with SPACE for spaces), merged together."""
    m = merges(path)
    if not words:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    at, known = _places(m.characters, points)
    symbol = np.where(known, at, -1).astype(np.int32)
    beside = symbol[:-1].astype(np.int64) * len(m.tokens) + symbol[1:]
    _, near = _places(m.neighbours, np.where((symbol[:-1] >= 0) & (symbol[1:] >= 0), beside, -1))
    sequence = np.append(0, np.cumsum(~near | (word[1:] != word[:-1])))
    owner = word[np.append(True, sequence[1:] != sequence[:-1])]
    # Characters that no piece has survive as they are.
    counts = np.zeros(len(words), np.int64)
    lost = points[symbol < 0]
    width = 1 + (lost >= 0x80).astype(np.int64) + (lost >= 0x800) + (lost >= 0x10000)
    np.add.at(counts, word[symbol < 0], width if m.byte_fallback else 1)
    symbol, sequence = symbol[symbol >= 0], sequence[symbol >= 0]
    long = np.flatnonzero(np.bincount(sequence, minlength=1) > LONG_SEQUENCE)
    for one in long.tolist():
        lo, hi = np.searchsorted(sequence, [one, one + 1])
        left = _heap_merge(m, symbol[lo:hi].tolist())
        counts[owner[one]] += int(m.tokens[left].sum())
    if len(long):
        short = ~np.isin(sequence, long)
        symbol, sequence = symbol[short], sequence[short]
    symbol, sequence = _rounds(m, symbol, sequence)
    np.add.at(counts, owner[sequence], m.tokens[symbol])
    return counts


class _Numbers(dict):
    """Numbers of pre-tokens, given in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _text_counts(batches: Iterator[pd.Series], path: str, kept: int) -> Iterator[pd.Series]:
    m = merges(path)
    numbers, counts = _Numbers(), np.zeros(0, np.int64)
    for batch in batches:
        made = []
        for text in batch:
            text = (text or "").replace(" ", SPACE)
            text = SPACE + text if text and m.dummy_prefix else text
            words = m.pattern.findall(text) if len(text) <= LONG_TEXT else map(re.Match.group, m.pattern.finditer(text))
            made.append(np.fromiter(map(numbers.__getitem__, words), np.uint32))
        if len(numbers) > len(counts):
            counts = np.append(counts, count_pretokens(list(numbers)[len(counts) :], path))
        yield pd.Series([int(counts[x].sum()) for x in made], dtype="int64")
        if len(numbers) > kept:
            numbers, counts = _Numbers(), np.zeros(0, np.int64)


def n_tokens(text: Column | str, path: str | None = None, kept: int = KEPT_WORDS) -> Column:
    """Number of tokens of a text column, a long; null and empty texts have none."""
    path = path or model_path()

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _text_counts(batches, path, kept)

    return count(text)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than limit tokens), a row for each row of docs."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), n_tokens("text", path).alias("n_tokens")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
