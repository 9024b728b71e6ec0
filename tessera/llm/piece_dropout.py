"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A text is cut into segments (a run of spaces and the word behind it) that no
piece of the vocabulary crosses. Inside a segment, candidate merges wait in an
agenda, best score first and then leftmost. A candidate that comes up is skipped
if its keyed hash is under ``dropout``: the key holds the seed, the document's
id, the segment's place in the document, its characters and the candidate's place
and length. So each occurrence of a word is split on its own, and a rerun gives
the same result. Characters without a piece become byte pieces, and so does a
U+2581 of the text itself: decoding restores every text exactly.
With dropout 0 this is plain merge encoding.

The agendas of many short segments are processed side by side (``encode_short``:
one row of an array for each, one candidate of each row per step, the same order
and the same hashes as ``encode_segment``, which takes the long ones). For short
segments a table of bounded size per worker holds the ids and the candidates that
come up when none or a few given ones are skipped; each occurrence's own hashes say
which entry fits it, and it is encoded by itself if none is kept. Both change speed,
never results. Nulls: a null text has null ids and tokens 0; an
empty text has no tokens. A null id is encoded under its own key. Repeated rows
give equal rows. Very long texts and words are encoded whole. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MODEL_PATH, SPACE, MergeTable, Pieces, load_pieces, merge_table

#: Keys of the skipping hash; none is shared on purpose.
VARIANTS = 1 << 64
DROPOUT = 0.1
SEGMENT = re.compile(r" *[^ \n\r\t]+| +|[\n\r\t]")
#: Entries kept per worker, the longest segment that is kept, and the most skipped candidates of an entry.
KEPT, KEPT_CHARS, KEPT_SKIPS = 400_000, 64, 3
#: Texts are encoded together until they hold this many characters, and this many short segments at once.
BATCH_CHARS, BATCH_SEGMENTS = 500_000, 20_000
MASK = (1 << 64) - 1
#: Odd multipliers that mix a candidate's place and length into its hash.
MIX_PLACE, MIX_LENGTH, MIX_ALL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9


def hash_of(segment: str) -> int:
    return xxhash.xxh64_intdigest(segment.encode("utf-8", "surrogatepass"))


def occurrence_keys(document: int, n: int) -> np.ndarray:
    """A mixed key for each of the first ``n`` places of a document, from the document's hash."""
    x = np.uint64(document) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(MIX_PLACE)
    x = (x ^ x >> np.uint64(30)) * np.uint64(MIX_ALL)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(MIX_ALL)
    return h ^ h >> np.uint64(29)


def encode_segment(segment: str, pieces: Pieces, dropout: float = 0.0, key: int = 0) -> list[int]:
    """Ids of one segment; ``key`` seeds the skipped merges."""
    symbols = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in segment]  # a literal U+2581 never merges
    n, ids, scores = len(symbols), pieces.ids, pieces.scores
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda: list[tuple[float, int, str]] = []
    for i in range(n - 1):
        if (score := scores.get(symbols[i] + symbols[i + 1])) is not None:
            agenda.append((-score, i, symbols[i] + symbols[i + 1]))
    heapq.heapify(agenda)
    bound = int(dropout * (1 << 64))
    own = hash_of(segment) ^ key if bound else 0
    while agenda:
        _, i, merged = heapq.heappop(agenda)
        j = after[i]
        if j >= n or not symbols[i] or symbols[i] + symbols[j] != merged:
            continue
        if bound:
            h = (own ^ (i * MIX_PLACE + len(merged) * MIX_LENGTH)) & MASK
            h = (h ^ h >> 31) * MIX_ALL & MASK
            if (h ^ h >> 29) < bound:
                continue
        symbols[i], symbols[j] = merged, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (score := scores.get(merged + symbols[k])) is not None:
                heapq.heappush(agenda, (-score, i, merged + symbols[k]))
        if (h := before[i]) >= 0 and (score := scores.get(symbols[h] + merged)) is not None:
            heapq.heappush(agenda, (-score, h, symbols[h] + merged))
    out: list[int] = []
    for s in symbols:
        if s and (one := ids.get(s)) is not None:
            out.append(one)
        elif s:
            out += [pieces.byte_ids[b] for b in s.removeprefix("\0").encode("utf-8", "surrogatepass")] if len(s) > 1 or s != "\0" else [pieces.byte_ids[0]]
    return out


def decode(ids, pieces: Pieces) -> str:
    return b"".join([pieces.spelled[i] for i in ids]).decode("utf-8", "surrogatepass")


def encode_short(segments: list[str], keys: list[int], pieces: Pieces, table: MergeTable, dropout: float = 0.0, skips: np.ndarray | None = None, seen: list | None = None) -> list[bytes]:
    """``encode_segment`` (as int32 bytes) of segments of about one length, each with its key.

    With ``skips`` (a row of candidates for each segment) just these are skipped; ``seen`` gets (rows, candidates) that were taken.
    """
    n, width = len(segments), max(map(len, segments)) + 1  # the last column merges with nothing, as does padding
    chars = "".join([s.ljust(width, SPACE) for s in segments]).encode("utf-32-le", "surrogatepass")
    symbols = table.symbol_of[np.frombuffer(chars, np.uint32)]
    place = np.arange(width, dtype=np.int32)
    before, after = np.tile(place - 1, n), np.tile(place + 1, n)
    # the agenda: at each symbol, the cost of the merge with its right neighbour and what it makes
    cost, made = np.full(n * width, np.inf, np.float32), np.zeros(n * width, np.int32)
    cost[:-1], made[:-1] = table.find(symbols[:-1], symbols[1:])
    bound = int(dropout * (1 << 64))
    own = np.array([hash_of(s) ^ k for s, k in zip(segments, keys)] if bound else [], np.uint64)
    rows, agenda = np.arange(n), cost.reshape(n, width)
    while True:
        costs = agenda[rows]
        best = costs.argmin(1)  # the leftmost of equals
        left = costs[np.arange(len(rows)), best] < np.inf
        rows, best = rows[left], best[left]
        if not len(rows):
            break
        row, start = rows, rows * width
        i = start + best
        j = start + after[i]
        k = after[j]
        if bound or skips is not None:
            candidate = best.astype(np.uint64) * np.uint64(MIX_PLACE) + (k - best).astype(np.uint64) * np.uint64(MIX_LENGTH)
            taken = mixed(own[row] ^ candidate) >= np.uint64(min(bound, MASK)) if bound else (skips[row] != candidate[:, None]).all(1)
            cost[i[~taken]] = np.inf
            start, best, i, j, k = start[taken], best[taken], i[taken], j[taken], k[taken]
            if seen is not None:
                seen.append((row[taken], candidate[taken]))
        symbol, previous, following = made[i], start + before[i], start + k  # before a row stands the last column of another
        symbols[i], symbols[j], cost[j] = symbol, -1, np.inf
        after[i], before[following] = k, best
        cost[i], made[i] = table.find(symbol, symbols[following])
        cost[previous], made[previous] = table.find(symbols[previous], symbol)
    real = (symbols.reshape(n, width) >= 0) & (place < np.array([len(s) for s in segments])[:, None])
    spelled = ~(real & (symbols.reshape(n, width) >= len(pieces.spelled))).any(1)
    ids, ends = symbols[real.ravel()].tobytes(), (real.sum(1).cumsum() * 4).tolist()
    # characters without a piece become bytes
    return [
        ids[a:b] if whole else _spelled_out(s, symbols[at : at + len(s)], pieces)
        for s, at, a, b, whole in zip(segments, range(0, n * width, width), [0, *ends], ends, spelled.tolist())
    ]


def _spelled_out(segment: str, symbols: np.ndarray, pieces: Pieces) -> bytes:
    """Ids of a segment whose symbols aren't all pieces."""
    out: list[int] = []
    for c, symbol in zip(segment, symbols.tolist()):
        if 0 <= symbol < len(pieces.spelled):
            out.append(symbol)
        elif symbol >= 0:
            out += [pieces.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")]
    return array("i", out).tobytes()


class Growing:
    """An array that grows at its end, by doubling."""

    def __init__(self, kind, *shape: int):
        self.room, self.n = np.empty((1024, *shape), kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, values) -> None:
        values = np.asarray(values, self.room.dtype)
        if self.n + len(values) > len(self.room):
            self.room = np.concatenate((self.all, np.empty((max(len(values), self.n) + 1024, *self.room.shape[1:]), self.room.dtype)))
        self.room[self.n : self.n + len(values)] = values
        self.n += len(values)


class Encoder:
    """Encodes texts; keeps what short segments give if none or a few candidates are skipped."""

    def __init__(self, pieces: Pieces, dropout: float = DROPOUT, seed: int = 0, table: MergeTable | None = None):
        self.pieces, self.dropout, self.table, self.seed = pieces, dropout, table or merge_table(pieces), seed
        #: Entries by segment; then, per entry, what it holds: its segment's hash, the candidates that are skipped, where its ids and
        #: the candidates that are taken begin. Per taken candidate: the entry of its segment if that is skipped too, or -1.
        self.kept: dict[str, int] = {}
        self.segments: list[str] = []
        self.hashes, self.skips = Growing(np.uint64), Growing(np.uint64, KEPT_SKIPS)
        self.id_starts, self.ids = Growing(np.int64), Growing(np.int32)
        self.starts, self.candidates, self.children = Growing(np.int64), Growing(np.uint64), Growing(np.int64)
        self.id_starts.add([0])
        self.starts.add([0])

    def _learn(self, segments: list[str], skips: np.ndarray) -> None:
        """Adds entries: the ids of each segment without the candidates that are skipped (0: none), and those that are taken."""
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        out: list[bytes] = [b""] * len(segments)
        rows, candidates = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for part in self._like(order, segments):
            seen: list[tuple[np.ndarray, np.ndarray]] = []
            for i, ids in zip(part, encode_short([segments[i] for i in part], [0] * len(part), self.pieces, self.table, skips=skips[part], seen=seen)):
                out[i] = ids
            at = np.array(part)
            rows += [at[r] for r, _ in seen]
            candidates += [c for _, c in seen]
        row = np.concatenate(rows)
        self.starts.add(self.starts.all[-1] + np.bincount(row, minlength=len(segments)).cumsum())
        self.candidates.add(np.concatenate(candidates)[row.argsort(kind="stable")])
        self.children.add(np.full(len(row), -1))
        self.hashes.add([hash_of(s) for s in segments])
        self.skips.add(skips)
        self.segments += segments
        self.id_starts.add(self.id_starts.all[-1] + np.cumsum([len(ids) // 4 for ids in out]))
        self.ids.add(np.frombuffer(b"".join(out), np.int32))

    @staticmethod
    def _like(order: list[int], segments: list[str]) -> Iterator[list[int]]:
        """Slices of ``order`` (by length) whose segments are of about one length."""
        at = 0
        while at < len(order):
            most, end = len(segments[order[at]]) + 3, at
            while end < len(order) and end - at < BATCH_SEGMENTS and len(segments[order[end]]) <= most:
                end += 1
            yield order[at:end]
            at = end

    def _first_skipped(self, entry: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(occurrence, place among all candidates): the first of its entry's candidates that each occurrence skips, if any."""
        starts = self.starts.all
        n = starts[entry + 1] - starts[entry]
        of = np.repeat(np.arange(len(entry)), n)
        place = np.arange(len(of)) + np.repeat(starts[entry] - n.cumsum() + n, n)
        hit = np.flatnonzero(mixed((self.hashes.all[entry] ^ keys)[of] ^ self.candidates.all[place]) < np.uint64(min(int(self.dropout * (1 << 64)), MASK)))
        at, first = np.unique(of[hit], return_index=True)
        return at, place[hit[first]]

    def _skipping(self, place: np.ndarray, depth: int) -> np.ndarray:
        """The entries in which the candidates at ``place`` are skipped too; -1 for those that aren't kept."""
        if len(new := np.unique(place[self.children.all[place] < 0])[: max(0, KEPT - len(self.segments))]):
            parents = self.starts.all.searchsorted(new, "right") - 1
            skips = self.skips.all[parents]
            skips[:, depth] = self.candidates.all[new]
            self.children.all[new] = np.arange(len(self.segments), len(self.segments) + len(new))
            self._learn([self.segments[e] for e in parents.tolist()], skips)
        return self.children.all[place]

    def encode_all(self, texts: list[str], documents: list[str]) -> list[np.ndarray]:
        cut = [SEGMENT.findall(text) for text in texts]
        flat = [s for segments in cut for s in segments]
        keys = np.concatenate([np.empty(0, np.uint64), *[occurrence_keys(xxhash.xxh64_intdigest(f"{self.seed}:{d}"), len(x)) for d, x in zip(documents, cut)]])
        if new := [s for s in dict.fromkeys(flat) if s not in self.kept and len(s) <= KEPT_CHARS][: max(0, KEPT - len(self.segments))]:
            self.kept.update(zip(new, range(len(self.segments), len(self.segments) + len(new))))
            self._learn(new, np.zeros((len(new), KEPT_SKIPS), np.uint64))
        entry = np.fromiter(map(self.kept.get, flat, repeat(-1)), np.int64, len(flat))
        left, rest = np.flatnonzero(entry >= 0), np.flatnonzero(entry < 0).tolist()
        for depth in range(KEPT_SKIPS + 1 if self.dropout else 0):
            at, place = self._first_skipped(entry[left], keys[left])
            left = left[at]
            if depth == KEPT_SKIPS:
                rest += left.tolist()
                break
            after = self._skipping(place, depth)
            rest += left[after < 0].tolist()
            left = left[after >= 0]
            entry[left] = after[after >= 0]
        alone = {i: array("i", encode_segment(flat[i], self.pieces, self.dropout, int(keys[i]))).tobytes() for i in rest if len(flat[i]) > KEPT_CHARS}
        for part in self._like(sorted([i for i in rest if i not in alone], key=lambda i: len(flat[i])), flat):
            alone.update(zip(part, encode_short([flat[i] for i in part], keys[part].tolist(), self.pieces, self.table, self.dropout)))
        # the ids of those that were encoded by themselves stand behind the kept ones
        starts = self.id_starts.all
        begin, n = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        by_entry = np.ones(len(flat), bool)
        by_entry[list(alone)] = False
        begin[by_entry], n[by_entry] = starts[entry[by_entry]], starts[entry[by_entry] + 1] - starts[entry[by_entry]]
        sizes = np.array([len(ids) // 4 for ids in alone.values()], np.int64)
        begin[list(alone)], n[list(alone)] = starts[-1] + sizes.cumsum() - sizes, sizes
        source = np.concatenate((self.ids.all, np.frombuffer(b"".join(alone.values()), np.int32))) if alone else self.ids.all
        ends = n.cumsum()
        found = source[np.arange(n.sum()) + np.repeat(begin - ends + n, n)]
        bounds = np.concatenate(([0], ends))[np.cumsum([0, *map(len, cut)])].tolist()
        return [found[a:b] for a, b in zip(bounds, bounds[1:])]

    def __call__(self, text: str, document: str = "") -> np.ndarray:
        return self.encode_all([text], [document])[0]


def _batches(texts: list[str | None]) -> Iterator[slice]:
    """Slices of whole texts, each of ``BATCH_CHARS`` characters or little more than that and one text."""
    start = held = 0
    for i, text in enumerate(texts):
        held += 1 + len(text or "")
        if held >= BATCH_CHARS:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _encode(batches: Iterator[pd.DataFrame], pieces, dropout: float, seed: int) -> Iterator[pd.DataFrame]:
    encoder = Encoder(pieces.value[0], dropout, seed, pieces.value[1])
    spelled = encoder.pieces.spelled
    for pdf in batches:
        for part in map(pdf.__getitem__, _batches(pdf["text"].tolist())):
            texts, documents = part["text"].tolist(), part["doc_id"].tolist()
            found = iter(encoder.encode_all([t for t in texts if t is not None], [str(d) for d, t in zip(documents, texts) if t is not None]))
            ids = [None if t is None else next(found) for t in texts]
            back = [None if x is None else b"".join([spelled[i] for i in x.tolist()]) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_tokens": [0 if x is None else len(x) for x in ids], "ids": ids, "lossless": back})


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = 0) -> DataFrame:
    """Per row: doc_id, n_tokens, ids, lossless (the ids decode to exactly the text)."""
    loaded = load_pieces(model_path)
    pieces = docs.sparkSession.sparkContext.broadcast((loaded, merge_table(loaded)))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(partial(_encode, pieces=pieces, dropout=dropout, seed=seed), "doc_id string, n_tokens long, ids array<int>, lossless boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def decode_documents(encoded: DataFrame, *, ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """``encoded`` with a column ``decoded`` (null ids: null)."""
    pieces = encoded.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    @F.pandas_udf("string")
    def texts(ids: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode(x, pieces.value) for x in ids], dtype=object)

    return encoded.withColumn("decoded", texts(F.col(ids_col)))
