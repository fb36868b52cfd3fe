"""Byte-level BPE encoding and decoding through a global shuffle of distinct words.

Encoding:

1. Texts are cut into pre-tokens. Documents are taken in batches of about BATCH_CHARS; a batch numbers
   its distinct words in order of first use, and a document becomes the numbers of its words by
   position. A batch names a word once however often its texts use it, so the most frequent word of
   a corpus has no more rows than there are batches.
2. The words of all batches (batch, number, word) are shuffled by word and sorted, so that equal ones
   are neighbours, and each distinct word is encoded once.
3. The ids go back to the batches, where they meet the documents and are put together by position.

Words and documents are two passes over the same rows, which must come in the same order both times,
as rows read from files do. A batch's key holds a digest of its words in order: rows that came in
another order would not meet their words, and the query fails instead of mixing them up.

Decoding meets the table of token bytes, which is as large as the vocabulary and no larger and goes
to every task as a constant: each id of a document is looked up in its place, and the bytes are
strung together in order.

Edge cases: a null or empty text has no ids and decodes to no bytes. Very long texts and words are
encoded whole; a text longer than BATCH_CHARS is a batch of its own. Repeated rows are encoded each
for itself; ids and other columns of the input may be null or repeat. An empty table gives an empty
result. Special tokens are ordinary text. Unknown ids fail when decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import bounded_batches, given_back

#: Characters of the documents that number their words together.
BATCH_CHARS = 32_000_000
#: Words of a batch that are handed on at once.
WORD_ROWS = 50_000
#: Characters above which a text is cut piece by piece instead of into a list.
LONG_TEXT = 4_000_000
#: Bytes of answers, of the ids of documents, and of packed documents, after which rows are handed on.
FLUSH_BYTES, IDS_BYTES, PACKED_BYTES = 16_000_000, 4_000_000, 4_000_000


def vocabulary_path() -> str:
    """The default vocabulary: ranks of a byte-level BPE, one base64 token and its rank a line."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a whole word to its ids."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(path), special_tokens={}).encode_ordinary


@lru_cache(maxsize=1)
def _patterns():
    """The tokenizer's pattern, and an equivalent one of the faster re module with a test for texts that it can read.

    These are texts of printable ASCII and Latin letters.
    """
    import regex
    from public_tokenizers import PATTERN

    letters = "A-Za-zÀ-ÖØ-öø-ÿ"
    own = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[0-9]+| ?[^\s{letters}0-9]+|\s+(?!\S)|\s+"
    known = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    full = regex.compile(PATTERN)
    return full, re.compile(own) if PATTERN == known else full, re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")


def pretokens(text: str) -> Iterator[str] | list[str]:
    """The pre-tokens of a text in order."""
    full, plain, odd = _patterns()
    pattern = full if odd.search(text) else plain
    return pattern.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in pattern.finditer(text))


class _Numbers(dict):
    """Numbers of words, given in order of first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers compressed plane by plane of their bytes: the upper ones hardly vary."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _parts(numbers: _Numbers) -> Iterator[list[bytes]]:
    """The words in order of their numbers, at most WORD_ROWS at once."""
    words = iter(numbers)
    while part := [w.encode("utf-8", "surrogatepass") for w in islice(words, WORD_ROWS)]:
        yield part


def _batched(batches: Iterator[pd.DataFrame], batch_chars: int, number: Callable) -> Iterator[tuple]:
    """(key, numbers of words, doc_ids, what number() made of each text) of each batch of documents."""
    task, numbers, ids, made, held = TaskContext.get().partitionId(), _Numbers(), [], [], 0

    def closed() -> tuple:
        digest = hashlib.blake2b(digest_size=8, key=task.to_bytes(8))
        for part in _parts(numbers):
            digest.update(b"\0".join(part) + b"\0")
        return int.from_bytes(digest.digest(), signed=True), numbers, ids, made

    for b in batches:
        for key, text in zip(b["doc_id"], b["text"], strict=True):
            if ids and held + len(text) > batch_chars:
                yield closed()
                numbers.clear()
                ids, made, held = [], [], 0
            ids.append(None if pd.isna(key) else int(key))
            made.append(number(map(numbers.__getitem__, pretokens(text))))
            held += len(text)
    if ids:
        yield closed()


def cut_words(rows: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """batch, number and word of the distinct words of each batch of rows (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, numbers, _, _ in _batched(batches, batch_chars, lambda numbers: deque(numbers, maxlen=0)):
            at = 0
            for part in _parts(numbers):
                yield pd.DataFrame({"batch": key, "number": np.arange(at, at + len(part), dtype=np.int32), "word": part})
                at += len(part)

    return rows.mapInPandas(given_back(run), "batch long, number int, word binary")


def cut_documents(rows: DataFrame, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """batch, doc_id and packed (the numbers of its words by position) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, _, ids, made in _batched(batches, batch_chars, lambda numbers: _packed(np.fromiter(numbers, np.uint32))):
            part = np.cumsum([len(x) for x in made]) // PACKED_BYTES
            for at in np.split(np.arange(len(made)), np.flatnonzero(np.diff(part)) + 1):
                own = slice(at[0], at[-1] + 1)
                yield pd.DataFrame({"batch": key, "doc_id": pd.array(ids[own], "Int64"), "packed": made[own]})

    return rows.mapInPandas(given_back(run), "batch long, doc_id long, packed binary")


def encode_words(words: DataFrame, vocabulary: str) -> DataFrame:
    """batch and packed answers: numbers of its words, how many ids each has, and the ids.

    Rows are dealt out and sorted by word, so equal words are neighbours and each is encoded once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = _encoder(vocabulary)
        found: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        last, ids, held = None, b"", 0

        def packs() -> pd.DataFrame:
            out = []
            for numbers, each in found.values():
                sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
                facts = np.concatenate([[len(each)], numbers, sizes, np.frombuffer(b"".join(each), "<u4")])
                out.append(_packed(facts))
            return pd.DataFrame({"batch": list(found), "answers": out})

        for b in batches:
            for batch, number, word in zip(b["batch"].tolist(), b["number"].tolist(), b["word"], strict=True):
                if word != last:
                    last, ids = word, np.array(one(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                numbers, each = found[batch]
                numbers.append(number)
                each.append(ids)
                held += 64 + len(ids)
            if held > FLUSH_BYTES:
                yield packs()
                found.clear()
                held = 0
        if found:
            yield packs()

    return words.repartition("word").sortWithinPartitions("word").mapInPandas(given_back(run), "batch long, answers binary")


def encode(docs: DataFrame, vocabulary: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """doc_id, ids (in order of position) and ids_sha256, a row for each row of docs.

    ids_sha256 is the digest of the ids as little-endian unsigned 32-bit integers.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    answers = encode_words(cut_words(rows, batch_chars), vocabulary or vocabulary_path())

    def table(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids, their place and all ids of the words of a batch, by number."""
        facts = [_unpacked(x) for x in packs]
        counts = [int(f[0]) for f in facts] or [0]
        number = np.concatenate([f[1 : 1 + n] for f, n in zip(facts, counts, strict=False)] or [np.zeros(0, "<u4")])
        size = np.concatenate([f[1 + n : 1 + 2 * n] for f, n in zip(facts, counts, strict=False)] or [np.zeros(0, "<u4")]).astype(np.int64)
        flat = np.concatenate([f[1 + 2 * n :] for f, n in zip(facts, counts, strict=False)] or [np.zeros(0, "<u4")])
        sizes, starts = np.zeros(sum(counts), np.int64), np.zeros(sum(counts), np.int64)
        sizes[number], starts[number] = size, np.cumsum(size) - size
        return sizes, starts, flat

    def assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, packs, known = None, [], None
        for b in batches:
            keys, out, digests, held = [], [], [], 0

            def frame() -> pd.DataFrame:
                return pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "ids": out, "ids_sha256": digests})  # noqa: B023

            for batch, key, packed, answer in zip(b["batch"].tolist(), b["doc_id"], b["packed"], b["answers"], strict=True):
                if batch != at:
                    at, packs, known = batch, [], None
                if packed is None:  # the words of a batch come before its documents
                    packs.append(answer)
                    continue
                if known is None:
                    known, packs = table(packs), []
                sizes, starts, flat = known
                sequence = _unpacked(packed)
                if len(sequence) and int(sequence.max()) >= len(sizes):
                    raise ValueError("rows came in another order the second time: write them to a table first")
                n = sizes[sequence]
                ends = np.cumsum(n)
                ids = flat[np.arange(n.sum()) + np.repeat(starts[sequence] - (ends - n), n)]
                keys.append(None if pd.isna(key) else int(key))
                out.append(ids.astype(np.int32))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                held += ids.nbytes
                if held > IDS_BYTES:
                    yield frame()
                    keys, out, digests, held = [], [], [], 0
            if keys:
                yield frame()

    met = cut_documents(rows, batch_chars).unionByName(answers, allowMissingColumns=True)
    placed = met.repartition("batch").sortWithinPartitions("batch", F.col("packed").isNotNull())
    return placed.mapInPandas(given_back(assemble), "doc_id long, ids array<int>, ids_sha256 string")


def token_table(vocabulary: str) -> Column:
    """The bytes of every token in hex, as a constant array by id; an id without a token has no hex in its place."""
    ranks = _ranks(vocabulary)
    pieces = ["-"] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    return F.split(F.lit(" ".join(pieces)), " ")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """The rows of encoded (with a column ids) with a column decoded, the bytes of their ids."""
    table = token_table(vocabulary or vocabulary_path())
    pieces = F.transform(F.coalesce(F.col("ids"), F.array().cast("array<int>")), lambda i: F.get(table, i))
    found = F.unhex(F.array_join(pieces, "", "-"))
    unknown = F.raise_error(F.lit("ids that the vocabulary does not have")).cast("binary")
    return encoded.withColumn("decoded", F.coalesce(found, unknown))


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of encoding and decoding every row."""
    return decode(encode(docs, vocabulary), vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )
