"""A multi-pattern automaton that reads many texts at a time."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: Texts are read in pieces of so many bytes side by side, with the longest pattern's length beyond.
PIECE = 256
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ALNUM = np.array([chr(b).isalnum() if b < 128 else False for b in range(256)])


def spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts, and one past the last; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Automaton:
    """Aho-Corasick over bytes: a trie whose every state knows where each class of bytes leads, failures included.

    ``patterns``: texts, not empty; several may be equal. A-Z in texts and patterns count as a-z. The table has
    a row a state and a column a different byte of the patterns, and one column for all others.
    """

    def __init__(self, patterns: list[str]):
        folded = [_FOLD[np.frombuffer(p.encode(), np.uint8)].tobytes() for p in patterns]
        if not all(folded):
            raise ValueError("an empty pattern")
        used = sorted({b for p in folded for b in p})
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)
        self.kind[65:91] = self.kind[97:123]
        self.size = np.array([len(p) for p in folded], np.int64)
        self.longest = max(map(len, folded), default=1)
        trie: list[dict[int, int]] = [{}]
        ends = []
        for p in folded:
            s = 0
            for b in p:
                t = trie[s].get(b)
                if t is None:
                    t = trie[s][b] = len(trie)
                    trie.append({})
                s = t
            ends.append(s)
        n = len(trie)
        self.go = np.zeros((n, len(used) + 1), np.int32)
        fail = np.zeros(n, np.int64)
        level = np.zeros(1, np.int64)
        levels = []
        while len(level):
            edges = np.array([(s, self.kind[b], t) for s in level.tolist() for b, t in trie[s].items()], np.int64).reshape(-1, 3)
            s, k, t = edges.T
            self.go[level] = self.go[fail[level]]  # the row of a shorter state, which is complete
            fail[t] = np.where(s == 0, 0, self.go[s, k])
            self.go[s, k] = t
            level = t
            levels.append(t)
        by = np.argsort(ends, kind="stable") if ends else np.zeros(0, np.int64)
        self.pattern = by.astype(np.int64)
        self.first = np.searchsorted(np.asarray(ends, np.int64)[by], np.arange(n + 1))
        own = np.diff(self.first) > 0
        # the longest other state that is a pattern and an end of this one; 0 for none
        self.link = np.zeros(n, np.int64)
        for t in levels:
            self.link[t] = np.where(own[fail[t]], fail[t], self.link[fail[t]])
        self.tells = own | (self.link > 0)

    def scan(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern, place) of the first place of each pattern in each text, in one pass over the bytes.

        All pieces go on by a byte at a time, the longest first, so that those still going on are a prefix.
        """
        none = np.zeros(0, np.int64)
        pieces = -(-np.diff(at) // PIECE)
        text = np.repeat(np.arange(len(pieces)), pieces)
        if not len(text):
            return none, none, none
        start = np.repeat(at[:-1] - PIECE * (np.cumsum(pieces) - pieces), pieces) + PIECE * np.arange(len(text))
        end = np.minimum(start + PIECE + self.longest - 1, at[1:][text])
        order = np.argsort(start - end, kind="stable")
        text, start, size = text[order], start[order], (end - start)[order]
        left = np.searchsorted(-size, -np.arange(int(size[0])), "left")
        kinds = self.kind[data]
        state = np.zeros(len(text), np.int32)
        hits = []
        for j, m in enumerate(left.tolist()):
            state[:m] = now = self.go[state[:m], kinds[start[:m] + j]]
            k = np.flatnonzero(self.tells[now])
            if len(k):
                hits.append((k, now[k].astype(np.int64), np.full(len(k), j)))
        if not hits:
            return none, none, none
        piece, state, j = (np.concatenate(x) for x in zip(*hits))
        found = []
        while len(state):
            n = self.first[state + 1] - self.first[state]
            which = np.repeat(np.arange(len(state)), n)
            pattern = self.pattern[np.repeat(self.first[state] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            begin = j[which] - self.size[pattern] + 1
            k = begin < PIECE  # what starts beyond is the next piece's
            found.append((text[piece[which[k]]], pattern[k], (start[piece[which]] + begin)[k]))
            on = np.flatnonzero(self.link[state] > 0)
            piece, j, state = piece[on], j[on], self.link[state[on]]
        text, pattern, place = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((place, pattern, text))
        text, pattern, place = text[order], pattern[order], place[order]
        new = np.append(True, (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1]))
        return text[new], pattern[new], place[new] - at[text[new]]

    def alone(self, data: np.ndarray, at: np.ndarray, text: np.ndarray, pattern: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether neither a letter nor a digit of any script touches each place."""
        low, high = at[text] + place, at[text] + place + self.size[pattern]
        out = np.ones(len(text), bool)
        for edge, inside, step in ((low - 1, low > at[text], -1), (high, high < at[text + 1], 1)):
            k = np.flatnonzero(inside)
            byte = data[edge[k]]
            out[k[_ALNUM[byte]]] = False
            for i in k[byte >= 128].tolist():
                e = int(edge[i])
                around = data[max(e - 3, at[text[i]]) : e + 1] if step < 0 else data[e : min(e + 4, at[text[i] + 1])]
                seen = around.tobytes().decode(errors="ignore")
                char = (seen[-1:] if step < 0 else seen[:1]) or " "
                out[i] &= unicodedata.category(char)[0] not in "LN"
        return out
