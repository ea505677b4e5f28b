"""Pieces of a public vocabulary file and a trie over them that is walked from many positions at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def pieces(path: str = PIECES) -> list[tuple[str, float]]:
    """(piece, score) by id. Control, unknown and byte pieces are in their places too."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.vocab_size())]


@dataclass
class Trie:
    """next[node * alphabet + code] is the node after a code, 0 if there is none; ids[node] is the piece that ends there or -1.

    Codes from alphabet on take no part but as pieces of their own: single[code] is the piece or -1.
    """

    alphabet: int
    next: np.ndarray
    ids: np.ndarray
    single: np.ndarray

    @classmethod
    def of(cls, coded: list[list[int]], alphabet: int, codes: int) -> Trie:
        table, ids, single = [np.zeros(alphabet, np.int32)], [-1], np.full(codes, -1, np.int32)
        for i, piece in enumerate(coded):
            if len(piece) == 1:
                single[piece[0]] = i
                if piece[0] >= alphabet:
                    continue
            node = 0
            for c in piece:
                to = table[node][c]
                if not to:
                    to = len(table)
                    table[node][c] = to
                    table.append(np.zeros(alphabet, np.int32))
                    ids.append(-1)
                node = to
            ids[node] = i
        return cls(alphabet, np.concatenate(table), np.array(ids, np.int32), single)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every occurrence of a piece; left is how many codes remain in the word at each place."""
        alone = np.flatnonzero((codes >= self.alphabet) & (self.single[codes] >= 0))
        out = [(alone, np.ones(len(alone), np.int64), self.single[codes[alone]])]
        at = np.flatnonzero(codes < self.alphabet)
        node, depth = np.zeros(len(at), np.int64), 0
        while len(at):
            node = self.next[node * self.alphabet + codes[at + depth]].astype(np.int64)
            depth += 1
            ok = node > 0
            at, node = at[ok], node[ok]
            piece = self.ids[node]
            hit = piece >= 0
            out.append((at[hit], np.full(int(hit.sum()), depth), piece[hit]))
            ok = left[at] > depth
            at, node = at[ok], node[ok]
            ok = codes[at + depth] < self.alphabet
            at, node = at[ok], node[ok]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
