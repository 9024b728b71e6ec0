"""Vocabulary of a SentencePiece model as plain values that ship with a task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Where the public model file is looked for when no path is given.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: SentencePiece writes a space as U+2581.
SPACE = "▁"


@dataclass(frozen=True)
class Pieces:
    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: tuple[int, ...]
    spelled: tuple[bytes, ...]
    longest: int


def load_pieces(model_path: str = MODEL_PATH) -> Pieces:
    """Reads the vocabulary on the driver; its size is that of the model, whatever the corpus."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ids, scores, byte_ids, spelled = {}, {}, [0] * 256, []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            spelled.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            ids[piece], scores[piece] = i, model.get_score(i)
            spelled.append(piece.replace(SPACE, " ").encode())
    return Pieces(ids, scores, tuple(byte_ids), tuple(spelled), max(map(len, ids)))


@dataclass(frozen=True)
class MergeTable:
    """The merges of a vocabulary as sorted arrays. A symbol is a piece's id, or a number behind
    them for a character that stands only inside pieces; the last number merges with nothing."""

    symbol_of: np.ndarray  # code point -> symbol
    keys: np.ndarray  # left symbol * n_symbols + right symbol, ascending, closed by a sentinel
    merged: np.ndarray
    cost: np.ndarray  # the negative score; infinite for the sentinel
    n_symbols: int

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cost, merged symbol) of pairs; the cost is infinite where no piece spells the pair."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = self.keys.searchsorted(key)
        return np.where(self.keys[at] == key, self.cost[at], np.float32(np.inf)), self.merged[at]


def merge_table(pieces: Pieces) -> MergeTable:
    """Every way to make a piece of two symbols; grows with the model, not with the corpus."""
    symbols, first_char = dict(pieces.ids), len(pieces.spelled)
    for c in sorted(set("".join(pieces.ids)) - set(symbols)):
        symbols[c], first_char = first_char, first_char + 1
    n, found = first_char + 1, []
    for piece, merged in pieces.ids.items():
        for at in range(1, len(piece)):
            if (left := symbols.get(piece[:at])) is not None and (right := symbols.get(piece[at:])) is not None:
                found.append((left * n + right, merged, -pieces.scores[piece]))
    found = [*sorted(found), (np.iinfo(np.int64).max, n - 1, np.inf)]
    symbol_of = np.full(0x110000, n - 1, np.int32)
    for c, symbol in symbols.items():
        if len(c) == 1 and c != " ":
            symbol_of[ord(" " if c == SPACE else c)] = symbol  # a literal U+2581 never merges
    keys, merged, cost = zip(*found)
    return MergeTable(symbol_of, np.array(keys, np.int64), np.array(merged, np.int32), np.array(cost, np.float32), n)
