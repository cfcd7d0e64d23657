"""Suffix automaton over a token sequence."""

from __future__ import annotations


class SuffixAutomaton:
    """Recognises every contiguous run of the tokens it was built from."""

    def __init__(self, tokens):
        self.go: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        last = 0
        for t in tokens:
            cur = self._new(self.len[last] + 1, {}, 0)
            p = last
            while p >= 0 and t not in self.go[p]:
                self.go[p][t] = cur
                p = self.link[p]
            if p >= 0:
                q = self.go[p][t]
                if self.len[q] == self.len[p] + 1:
                    self.link[cur] = q
                else:
                    c = self._new(self.len[p] + 1, dict(self.go[q]), self.link[q])
                    while p >= 0 and self.go[p].get(t) == q:
                        self.go[p][t] = c
                        p = self.link[p]
                    self.link[q] = self.link[cur] = c
            last = cur

    def _new(self, length, go, link):
        self.len.append(length)
        self.go.append(go)
        self.link.append(link)
        return len(self.len) - 1

    def match_lengths(self, tokens) -> list[int]:
        """For each position, the length of the longest run that ends there and occurs in the built sequence."""
        state, n, out = 0, 0, []
        for t in tokens:
            while state and t not in self.go[state]:
                state = self.link[state]
                n = self.len[state]
            if t in self.go[state]:
                state = self.go[state][t]
                n += 1
            else:
                n = 0
            out.append(n)
        return out

    def coverage(self, tokens, least: int) -> int:
        """How many of ``tokens`` lie in runs of ``least`` or more that occur in the built sequence."""
        covered, done = 0, 0
        for i, n in enumerate(self.match_lengths(tokens), 1):
            if n >= least:
                covered += i - max(done, i - n)
                done = i
        return covered
