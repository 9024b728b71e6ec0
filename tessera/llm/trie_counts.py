"""Token counts under a unigram model, by dynamic programming on a shared trie.

A text is cut into pre-tokens (an optional space and a run without white space,
or one white-space character). Distinct pre-tokens enter a trie. A node stands
for a prefix and holds the best score of any segmentation of that prefix, and its
number of tokens, computed once from the nodes on its path: of these, only where
a piece begins that ends here, which an automaton over the pieces lists. A pre-token's count
is read at its terminal. A document's count is the sum over its pre-tokens.

Best: highest sum of piece scores, then fewest tokens. Scores are log-probabilities
of the pieces (``unigram``): the vocabulary file holds a merge model, whose scores are
only ranks, so a piece of rank r gets a probability in proportion to 1 / (r + 1)
(Zipf's law); they sum to 1. A character without a
piece costs ``min score - 10`` and counts its UTF-8 bytes (byte fallback).

New pre-tokens of a run of texts are sorted and enter tries of ``ROWS`` words,
whose nodes are scored depth by depth as arrays; a few go into a trie one by one.
A worker keeps the counts of at most ``MAX_WORDS`` pre-tokens besides those of a
run, and starts anew beyond that, as its one trie does at ``MAX_NODES`` nodes.
Pre-tokens over ``TRIE_CHARS`` characters are scored by the same recurrence
without a trie. None of this changes a count. Nulls: a null text counts 0 pre-tokens and
0 tokens, like an empty one; ids pass through, null or not. Repeated rows give
equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MODEL_PATH, SPACE, Pieces, load_pieces

PRE_TOKEN = re.compile(r" ?\S+|\s")
MAX_NODES, TRIE_CHARS = 400_000, 64
#: Counts that a worker keeps, words whose trie is built at once, characters of text whose words are gathered.
MAX_WORDS, ROWS, SLICE_CHARS = 400_000, 1 << 15, 1 << 22
#: So few new words enter a trie one by one.
FEW_WORDS = 256


def unigram(pieces: Pieces) -> Pieces:
    """``pieces`` with log-probabilities for scores: Zipf's law over the order of their scores, ties by id."""
    ranked = sorted(pieces.scores, key=lambda p: (-pieces.scores[p], pieces.ids[p]))
    whole = math.log(sum(1 / (r + 1) for r in range(len(ranked))))
    return replace(pieces, scores={p: -math.log(r + 1) - whole for r, p in enumerate(ranked)})


@dataclass(frozen=True)
class Endings:
    """Which pieces end at a character: a state stands for the longest end of what was read that begins a piece."""

    step: dict[int, int]  # state << 21 | code point -> state
    shorter: list[int]  # state -> that of the next shorter end
    pieces: list[tuple[tuple[int, float], ...]]  # state -> (characters, score) of the pieces that end here
    single: frozenset[int]  # code points that are pieces
    unknown: float


def endings(scores: dict[str, float]) -> Endings:
    """Grows with the vocabulary, not with the corpus."""
    begins = sorted({piece[:n] for piece in scores for n in range(1, len(piece) + 1)}, key=len)
    state, step, shorter, found = {"": 0}, {}, [0], [()]
    for begin in begins:
        state[begin] = step[state[begin[:-1]] << 21 | ord(begin[-1])] = len(shorter)
        shorter.append(next(state[begin[n:]] for n in range(1, len(begin) + 1) if begin[n:] in state))
        found.append((((len(begin), scores[begin]),) if begin in scores else ()) + found[shorter[-1]])
    return Endings(step, shorter, found, frozenset(ord(p) for p in scores if len(p) == 1), min(scores.values()) - 10.0)


class UnigramTrie:
    """Counts of pre-tokens under pieces whose scores are log-probabilities, or under their ``endings``."""

    def __init__(self, pieces: Pieces | Endings):
        self.ends = pieces if isinstance(pieces, Endings) else endings(pieces.scores)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.score, self.tokens, self.state = [0.0], [0], [0]
        self.terminal: dict[str, int] = {}

    def step(self, c: int, state: int, path: Sequence[int], score: list[float], tokens: list[int]) -> int:
        """Appends the best score and tokens of a prefix that ends in ``c`` to those of its prefixes,
        which ``path`` finds, shortest first; its state, from theirs."""
        ends = self.ends
        step, shorter = ends.step, ends.shorter
        while (to := step.get(state << 21 | c)) is None and state:
            state = shorter[state]
        state, best, count = to or 0, None, 0
        for n, s in ends.pieces[state]:
            at = path[-n]
            total, k = score[at] + s, tokens[at] + 1
            if best is None or total > best or total == best and k < count:
                best, count = total, k
        if c not in ends.single:
            total, k = score[path[-1]] + ends.unknown, tokens[path[-1]] + len(chr(c).encode("utf-8", "surrogatepass"))
            if best is None or total > best or total == best and k < count:
                best, count = total, k
        score.append(best)
        tokens.append(count)
        return state

    def insert(self, word: str) -> int:
        """Adds a pre-token (spaces written as U+2581); its number of tokens."""
        path, child, node = [0], self.child, 0
        for c in map(ord, word):
            key = node << 21 | c
            if (to := child.get(key)) is None:
                child[key] = to = len(self.score)
                self.state.append(self.step(c, self.state[node], path, self.score, self.tokens))
            path.append(node := to)
        return self.tokens[node]

    def count(self, pre_token: str) -> int:
        found = self.terminal.get(pre_token)
        if found is not None:
            return found
        word = pre_token.replace(" ", SPACE)
        if len(word) > TRIE_CHARS:
            score, tokens, state = [0.0], [0], 0
            for i, c in enumerate(map(ord, word)):
                state = self.step(c, state, range(i + 1), score, tokens)
            return tokens[-1]
        if len(self.score) > MAX_NODES:
            self.clear()
        self.terminal[pre_token] = found = self.insert(word)
        return found


class WordCounts:
    """Counts of many pre-tokens at a time: a trie's nodes of one depth are scored together, as arrays."""

    def __init__(self, ends: Endings):
        self.trie = UnigramTrie(ends)
        self.known: dict[str, int] = {}
        keys = sorted(ends.step)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.to = np.array([*map(ends.step.__getitem__, keys), 0], np.int64)
        self.shorter = np.array(ends.shorter, np.int64)
        self.n_pieces = np.array([len(p) for p in ends.pieces], np.int64)
        self.first = np.cumsum(self.n_pieces) - self.n_pieces
        self.chars = np.array([n for p in ends.pieces for n, _ in p], np.int64)
        self.costs = np.array([s for p in ends.pieces for _, s in p], np.float64)
        self.single = np.zeros(0x110000, bool)
        self.single[list(ends.single)] = True
        self.unknown = ends.unknown

    def learn(self, words: list[str]) -> None:
        """Adds the counts of words that are not known."""
        arrays = len(words) >= FEW_WORDS
        short = sorted(w for w in words if len(w) <= TRIE_CHARS) if arrays else []
        for at in range(0, len(short), ROWS):
            rows = short[at : at + ROWS]
            self.known.update(zip(rows, self.sorted_counts(rows).tolist()))
        for w in words:
            if not arrays or len(w) > TRIE_CHARS:
                self.known[w] = self.trie.count(w)

    def move(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The states after one more character."""
        out, todo = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(todo):
            key = state << 21 | c[todo]
            at = self.keys.searchsorted(key)
            found = self.keys[at] == key
            out[todo[found]] = self.to[at[found]]
            on = ~found & (state > 0)
            todo, state = todo[on], self.shorter[state[on]]
        return out

    def sorted_counts(self, words: list[str]) -> np.ndarray:
        """The numbers of tokens of sorted words. A node stands at the first word of those with its prefix."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        deepest = int(size.max())
        code = np.full((len(words), deepest), -1, np.int64)
        code[np.arange(deepest) < size[:, None]] = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
        differs = code[1:] != code[:-1]
        shared = np.append(0, np.where(differs.any(axis=1), differs.argmax(axis=1), deepest))  # characters, with the word before
        code = np.ascontiguousarray(code.T)
        n_nodes = 1 + int((size - np.minimum(shared, size)).sum())
        score, tokens, state = np.zeros(n_nodes), np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        node = np.zeros((deepest + 1, len(words)), np.int32)  # of a word's prefix of so many characters
        end = 1
        for depth in range(1, deepest + 1):
            begins = (shared < depth) & (size >= depth)
            node[depth] = np.cumsum(begins) + (end - 1)
            at = np.flatnonzero(begins)
            c, before = code[depth - 1][at], node[depth - 1][at]
            to = self.move(state[before], c)
            best, count = np.full(len(at), -np.inf), np.zeros(len(at), np.int64)

            def take(of, total, k):
                better = (total > best[of]) | (total == best[of]) & (k < count[of])
                best[of[better]], count[of[better]] = total[better], k[better]

            n_pieces, j = self.n_pieces[to], 0
            while len(of := np.flatnonzero(n_pieces > j)):
                piece = self.first[to[of]] + j
                begin = node[depth - self.chars[piece], at[of]]
                take(of, score[begin] + self.costs[piece], tokens[begin] + 1)
                j += 1
            of = np.flatnonzero(~self.single[c])
            utf8 = 1 + (c[of] > 0x7F) + (c[of] > 0x7FF) + (c[of] > 0xFFFF)
            take(of, score[before[of]] + self.unknown, tokens[before[of]] + utf8)
            score[end : end + len(at)], tokens[end : end + len(at)], state[end : end + len(at)] = best, count, to
            end += len(at)
        return tokens[node[size, np.arange(len(words))]]

    def documents(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Pre-tokens and tokens of each text."""
        words = [PRE_TOKEN.findall(t or "") for t in texts]
        met = set().union(*words)
        new = [w for w in met if w not in self.known]
        if len(self.known) + len(new) > MAX_WORDS:
            self.known.clear()
            new = list(met)
        self.learn(new)
        known = self.known.__getitem__
        return [len(w) for w in words], [sum(map(known, w)) for w in words]


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``SLICE_CHARS`` characters, one text at least."""
    run, chars = [], 0
    for t in texts:
        run.append(t)
        chars += len(t or "")
        if chars >= SLICE_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


def _count(batches: Iterator[pd.DataFrame], ends) -> Iterator[pd.DataFrame]:
    counts = WordCounts(ends.value)
    for pdf in batches:
        n_pre, n_tokens = [], []
        for texts in _slices(pdf["text"].tolist()):
            pre, tokens = counts.documents(texts)
            n_pre += pre
            n_tokens += tokens
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_pretokens": n_pre, "n_tokens": n_tokens})


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens."""
    ends = docs.sparkSession.sparkContext.broadcast(endings(unigram(load_pieces(model_path)).scores))
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInPandas(partial(_count, ends=ends), "doc_id string, n_pretokens long, n_tokens long")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))
