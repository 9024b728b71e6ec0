"""Byte-level BPE by replaying the merges over the distinct pre-tokens of many documents.

Texts are split by the vocabulary's pattern. The distinct pre-tokens of a run of
documents stand side by side as byte symbols, linked to their neighbours, with an
inverted index from a pair (named by the rank of what it merges to) to the positions
where it stands. Ranks are taken from a heap, lowest first; all positions of a rank
merge at once, leftmost first where they overlap, and only the pairs beside a merge
are looked up and indexed anew. A pre-token that is a token itself is that token.

Ranks alone decide what merges, so a merge may make a pair of a lower rank than its
own, which goes first. In a word with such a pair the replay stops, and the word is
finished by itself in the same order (``_finish``).

A worker keeps the ids of pre-tokens it has met, ``KEPT_CHARS`` characters of them
at most; beyond that it starts anew, which changes no id. Documents are gathered in
runs of about ``RUN_CHARS`` characters; a longer text is a run of its own, whole.

Nulls: a null text has no tokens and decodes to nothing, like an empty one; ids of
documents pass through, null or not. Repeated rows give equal rows; an empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_CHARS, KEPT_CHARS = 1 << 22, 1 << 22
NONE = np.iinfo(np.int32).max


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: a token's id is its rank."""

    pattern: str
    tokens: dict[bytes, int]
    keys: np.ndarray  # left rank << 32 | right rank, ascending, of pairs that spell a token
    merged: np.ndarray  # the rank of that token

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs merge to; ``NONE`` where they don't."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(self.keys.searchsorted(key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)


def load_ranks(path: str | None = None, pattern: str | None = None) -> Ranks:
    """Reads a rank file (base64 token and rank a line) on the driver; its size is that of the vocabulary.

    Without arguments the public 50k vocabulary and its pattern are taken.
    """
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    lines = Path(path).read_bytes().splitlines()
    return ranks_of({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}, pattern)


def ranks_of(tokens: dict[bytes, int], pattern: str) -> Ranks:
    """The vocabulary of given tokens; every single byte is one of them."""
    found = [(-1, NONE)]
    for token, rank in tokens.items():
        for i in range(1, len(token)):
            if (left := tokens.get(token[:i])) is not None and (right := tokens.get(token[i:])) is not None:
                found.append((left << 32 | right, rank))
    keys, merged = zip(*sorted(found))
    return Ranks(pattern, tokens, np.array(keys, np.int64), np.array(merged, np.int32))


def _finish(symbols: list[int], ranks: Ranks) -> list[int]:
    """The merges that are left in one word: always the lowest rank, then the leftmost."""
    n = len(symbols)
    after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
    pair = ranks.find(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)).tolist() + [NONE]
    heap = [(r, i) for i, r in enumerate(pair) if r != NONE]
    heapq.heapify(heap)
    known = dict(zip(ranks.keys.tolist(), ranks.merged.tolist())) if n > 1_000 else None

    def rank(left: int, right: int) -> int:
        if known is not None:
            return known.get(left << 32 | right, NONE)
        return int(ranks.find(np.array([left]), np.array([right]))[0])

    while heap:
        r, i = heapq.heappop(heap)
        if pair[i] != r:
            continue
        j = after[i]
        symbols[i], symbols[j], pair[j] = r, -1, NONE
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0:
                pair[a] = rank(symbols[a], symbols[b]) if b < n else NONE
                if pair[a] != NONE:
                    heapq.heappush(heap, (pair[a], a))
    return [s for s in symbols if s >= 0]


def replay(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit integers, by replaying the merges over all words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    single = np.array([ranks.tokens.get(bytes([b]), -1) for b in range(256)], np.int64)
    # a position behind the last stands for what is outside a word and merges with nothing
    sym = np.append(single[np.frombuffer(b"".join(words), np.uint8)], -1)
    word = np.append(np.repeat(np.arange(len(words)), lengths), -1)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = lengths.cumsum()
    after[ends - 1], before[(ends - lengths)] = n, n
    after[n] = n
    pair = np.append(ranks.find(sym[:n], sym[after[:n]]), np.int32(NONE))
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(positions: np.ndarray) -> None:
        """Enters positions in the index under the rank of their pair."""
        at = pair[positions]
        positions, at = positions[at != NONE], at[at != NONE]
        if len(at) == 0:
            return
        order = at.argsort(kind="stable")
        positions, at = positions[order], at[order]
        cuts = np.flatnonzero(at[1:] != at[:-1]) + 1
        for rank, part in zip(at[np.append(0, cuts)].tolist(), np.split(positions, cuts)):
            if rank not in index:
                index[rank] = []
                heapq.heappush(heap, rank)
            index[rank].append(part)

    note(np.arange(n))
    left_over = np.zeros(len(words) + 1, bool)  # words that are finished by themselves
    while heap:
        r = heapq.heappop(heap)
        pos = np.concatenate(index.pop(r))
        pos = np.unique(pos[(pair[pos] == r) & ~left_over[word[pos]]])
        if len(pos) == 0:
            continue
        # where pairs overlap, every second one of a run merges
        chained = np.append(False, after[pos[:-1]] == pos[1:])
        place = np.arange(len(pos))
        run = np.maximum.accumulate(np.where(chained, 0, place))
        pos = pos[(place - run) % 2 == 0]
        second = after[pos]
        beyond = after[second]
        # one merge after another makes these pairs; a lower rank than r among them would go first
        prior = before[pos]
        merged_prior = np.append(False, second[:-1] == prior[1:])
        left = np.where(merged_prior, r, sym[prior])
        right = sym[beyond]
        made = np.minimum(ranks.find(left, np.full(len(pos), r)), ranks.find(np.full(len(pos), r), right))
        if (low := made < r).any():
            left_over[word[pos[low]]] = True
            stay = ~left_over[word[pos]]
            pos, second, beyond = pos[stay], second[stay], beyond[stay]
            if len(pos) == 0:
                continue
        sym[pos], sym[second], pair[second] = r, -1, NONE
        after[pos] = beyond
        inner = beyond < n
        before[beyond[inner]] = pos[inner]
        prior = before[pos]
        touched = np.unique(np.concatenate((pos, prior[prior < n])))
        pair[touched] = ranks.find(sym[touched], sym[after[touched]])
        note(touched)
    stands = np.flatnonzero(sym[:n] >= 0)
    bounds = np.searchsorted(stands, np.append(0, ends)).tolist()
    ids = sym[stands].astype("<u4")
    out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
    for i in np.flatnonzero(left_over[:-1]).tolist():
        symbols = np.frombuffer(out[i], "<u4").tolist()
        out[i] = np.array(_finish(symbols, ranks), "<u4").tobytes()
    return out


class Encoder:
    """Ids of texts, with those of known pre-tokens kept."""

    def __init__(self, ranks: Ranks):
        self.ranks, self.split = ranks, regex.compile(ranks.pattern).findall
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def encode_all(self, texts: list[str]) -> list[bytes]:
        cut = [self.split(t) for t in texts]
        new = list(set().union(*cut).difference(self.known))
        if self.chars > KEPT_CHARS:
            self.known, self.chars, new = {}, 0, list(set().union(*cut))
        self.chars += sum(map(len, new))
        spelled = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = [self.ranks.tokens.get(w) for w in spelled]
        parts = [i for i, rank in enumerate(whole) if rank is None]
        self.known.update((new[i], rank.to_bytes(4, "little")) for i, rank in enumerate(whole) if rank is not None)
        self.known.update(zip([new[i] for i in parts], replay([spelled[i] for i in parts], self.ranks)))
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]


def _encode(batches: Iterator[pa.RecordBatch], ranks, run_chars: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(ranks.value)
    for batch in batches:
        texts = batch.column(1)
        start = chars = 0
        for i, text in enumerate(texts):
            chars += len(text.as_py() or "")
            if chars >= run_chars or i + 1 == len(texts):
                ids = encoder.encode_all([t or "" for t in texts.slice(start, i + 1 - start).to_pylist()])
                n = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(ids)), n, pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])
                start, chars = i + 1, 0


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (packed little-endian unsigned 32-bit integers; ``unpacked`` makes an array)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(path, pattern))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(partial(_encode, ranks=ranks, run_chars=RUN_CHARS), "doc_id string, n_tokens long, ids binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def decode_documents(encoded: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that the packed ids spell (null ids: none)."""
    spelled = {rank: token for token, rank in load_ranks(path, pattern="").tokens.items()}
    shared = encoded.sparkSession.sparkContext.broadcast(spelled)

    @F.arrow_udf("binary")
    def spell(ids: pa.Array) -> pa.Array:
        known = shared.value.__getitem__
        return pa.array([b"".join(map(known, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in ids], pa.binary())

    return encoded.withColumn("decoded", spell(F.col(ids_col)))


def unpacked(ids: bytes | None) -> list[int]:
    """Packed ids as a list."""
    return np.frombuffer(ids or b"", "<u4").tolist()
