"""A Levenshtein automaton intersected with a lexicon trie, as one table of transitions."""

from __future__ import annotations

import numpy as np

#: Added to the byte that is still to come of two that are swapped.
SWAP = 256
#: What an accepting state has seen.
NONE, WORD, STEM, NEAR = 0, 1, 2, 3


class Automaton:
    """Accepts words of the lexicon, words that begin with a stem, and words and whole stems with one edit.

    A state is a set of (trie node, edits left); it is built by subset construction, so a byte
    costs one look-up however many terms there are. One edit is a byte changed, left out, put
    in, or two neighbours swapped (in between, the second of them is awaited: SWAP + its byte);
    terms under ``near_from`` bytes must match exactly.
    """

    def __init__(self, words: list[bytes], stems: list[bytes], near_from: int = 5):
        kids: list[dict[int, int]] = [{}]
        word_end, stem_end, near_ok = [False], [False], [False]
        for term, ends in [*((w, word_end) for w in words), *((s, stem_end) for s in stems)]:
            at, path = 0, [0]
            for b in term:
                if b not in kids[at]:
                    kids[at][b] = len(kids)
                    kids.append({})
                    word_end.append(False), stem_end.append(False), near_ok.append(False)
                at = kids[at][b]
                path.append(at)
            ends[at] = True
            if len(term) >= near_from:
                for p in path:
                    near_ok[p] = True
        used = sorted({b for k in kids for b in k})
        self.classes = np.zeros(256, np.int64)
        for c, b in enumerate(used):
            self.classes[b] = c + 1
        width = len(used) + 1

        def closed(items):
            """Leave out bytes of the term."""
            out, todo = set(), list(items)
            while todo:
                x = todo.pop()
                if x not in out:
                    out.add(x)
                    node, left = x
                    if left == 1 and node:  # the first byte is never left out: too many words would fit
                        todo += [(k, 0) for k in kids[node].values() if near_ok[k]]
            # an exact path beats a wrong one at the same node
            return frozenset(x for x in out if x[1] or (x[0], 1) not in out)

        start = closed({(0, 1)})
        index, rows, self.accept, todo = {frozenset(): 0, start: 1}, [[0] * width, None], [NONE, NONE], [start]
        done = {}  # absorbing states, by what they accept
        while todo:
            state = todo.pop()
            row = []
            for c in range(width):
                nxt = set()
                byte = used[c - 1] if c else -1
                for node, left in state:
                    if left >= SWAP:
                        if byte == left - SWAP:
                            nxt.add((node, 0))
                        continue
                    kid = kids[node].get(byte)
                    if kid is not None:
                        nxt.add((kid, left))
                    if left:
                        if near_ok[node]:
                            nxt.add((node, 0))  # a byte put in
                        nxt |= {(k, 0) for k in kids[node].values() if near_ok[k]}  # a byte changed
                        for x, k in kids[node].items() if node else ():
                            if x != byte and near_ok[kids[k].get(byte, 0)] and byte in kids[k]:
                                nxt.add((kids[k][byte], SWAP + x))  # the first of two swapped
                nxt = closed(nxt)
                stem = STEM if any(stem_end[n] and left == 1 for n, left in nxt) else NEAR if any(stem_end[n] and near_ok[n] for n, left in nxt if left < SWAP) else NONE
                if stem == STEM and (STEM not in done):
                    done[STEM] = len(rows)
                    rows.append([len(rows)] * width)
                    self.accept.append(STEM)
                if stem == STEM:
                    row.append(done[STEM])
                    continue
                if nxt not in index:
                    index[nxt] = len(rows)
                    rows.append(None)
                    exact = any(word_end[n] and left == 1 for n, left in nxt)
                    self.accept.append(WORD if exact else NEAR if stem or any(word_end[n] and near_ok[n] for n, left in nxt if left < SWAP) else NONE)
                    todo.append(nxt)
                row.append(index[nxt])
            rows[index[state]] = row
        self.table = np.array(rows, np.int32)
        self.accept = np.array(self.accept, np.int8)
        self.final = done.get(STEM, -1)

    def match(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What each word buf[start:end] is: NONE, WORD, STEM or NEAR."""
        out = np.zeros(len(starts), np.int8)
        live, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        codes = self.classes
        while len(live):
            state = self.table[state, codes[buf[at]]]
            at = at + 1
            over = (at == ends[live]) | (state == 0) | (state == self.final)
            out[live[over]] = self.accept[state[over]]
            on = ~over
            live, state, at = live[on], state[on], at[on]
        return out
