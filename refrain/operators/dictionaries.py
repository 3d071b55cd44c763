"""Bounded prefix dictionaries: a trie of at most k nodes that keeps frequent prefixes, and one that keeps recent ones.

Both walk a string letter by letter. ``extend`` follows an edge, or else tries to add one, after which the walk is over.
Node 0 is the root. The same input always gives the same dictionary, so a decoder can replay it.
"""

from __future__ import annotations

import heapq

ROOT = 0


class FrequentPrefixes:
    """Misra-Gries counting of prefixes. ``nodes`` includes the root; a counter saturates at max_freq - 1.

    Only leaves are evicted, so the dictionary stays closed under prefixes. Counters hold an offset, ``threshold``,
    that all nodes share; raising it lowers every counter at once. ``counter - threshold`` never exceeds the number of
    true occurrences.

    Nodes are numbered from 1 in the order of their first use, and take memory from then on; ``name`` gives the number
    under which a node is published (the highest is handed out first), ``number`` the way back. As long as unused nodes
    are left nothing is evicted, and it is enough to know when each was counted last. The buckets of leaves by counter,
    the latest last, are made when the first leaf must go.
    """

    def __init__(self, nodes: int, max_freq: int):
        if nodes < 2:
            raise ValueError("a dictionary has two nodes at least")
        if max_freq < 5:
            raise ValueError("max_freq must be 5 or more")
        self.nodes, self.cap, self.threshold, self.renormalised, self.clock = nodes, max_freq - 1, 0, 0, 0
        self.edges: dict[int, int] = {}  # parent << 8 | letter -> child
        self.parent, self.label, self.children, self.freq, self.last = [-1], [0], [0], [0], [0]
        self.buckets: dict[int, dict[int, None]] | None = None

    def name(self, node: int) -> int:
        return self.nodes - node if node else ROOT

    number = name  # the same the other way round

    def adopt(self, walks: list[int], letters: list[int]) -> None:
        """The state after LZ78 phrases whose i-th walk ended at ``walks[i]`` and then added node i + 1; edges are there already."""
        self.parent += walks
        self.label += letters
        n = len(self.parent)
        self.children, self.freq, self.last = [0] * n, [0] * n, [0] * n
        parent, freq, last, cap = self.parent, self.freq, self.last, self.cap
        for new, node in enumerate(walks, 1):
            self.children[node] += 1
            path = []
            while node:
                path.append(node)
                node = parent[node]
            for node in (*reversed(path), new):
                if freq[node] < cap:
                    freq[node] += 1
                    last[node] = self.clock
                    self.clock += 1

    def extend(self, node: int, letter: int) -> int:
        """The child that continues the walk, or -1 if it ends here (the longer prefix may have been added)."""
        child = self.edges.get(node << 8 | letter)
        if child is not None:
            self._count(child)
            return child
        if self.buckets is None:
            if len(self.parent) < self.nodes:
                self._new(node, letter)
                return -1
            self._fill()
        garbage = self.buckets.get(self.threshold)
        if garbage:
            self._recycle(next(reversed(garbage)), node, letter)
        else:
            self.threshold += 1
            if self.threshold >= self.cap // 2:
                self._renormalise()
        return -1

    def _new(self, node: int, letter: int) -> None:
        self.edges[node << 8 | letter] = len(self.parent)
        self.parent.append(node)
        self.label.append(letter)
        self.children.append(0)
        self.children[node] += 1
        self.freq.append(1)
        self.last.append(self.clock)
        self.clock += 1

    def _fill(self) -> None:
        self.buckets = {}
        for node in sorted((v for v in range(1, self.nodes) if not self.children[v]), key=self.last.__getitem__):
            self.buckets.setdefault(self.freq[node], {})[node] = None

    def _count(self, node: int) -> None:
        f = max(self.freq[node], self.threshold)
        if f == self.cap:
            return
        if self.buckets is None:
            self.last[node] = self.clock
            self.clock += 1
        elif not self.children[node]:
            self._unlink(node)
            self.buckets.setdefault(f + 1, {})[node] = None
        self.freq[node] = f + 1

    def _unlink(self, node: int) -> None:
        at = max(self.freq[node], self.threshold)
        bucket = self.buckets[at]
        del bucket[node]
        if not bucket:
            del self.buckets[at]

    def _recycle(self, node: int, parent: int, letter: int) -> None:
        old = self.parent[node]
        if old >= 0:
            del self.edges[old << 8 | self.label[node]]
            self.children[old] -= 1
            if old != ROOT and not self.children[old]:
                self.buckets.setdefault(max(self.freq[old], self.threshold), {})[old] = None
        if parent != ROOT and not self.children[parent]:
            self._unlink(parent)
        self.parent[node], self.label[node] = parent, letter
        self.edges[parent << 8 | letter] = node
        self.children[parent] += 1
        self._count(node)

    def _renormalise(self) -> None:
        t = self.threshold
        self.freq = [max(f, t) - t for f in self.freq]
        self.buckets = {f - t: b for f, b in self.buckets.items()}
        self.threshold = 0
        self.renormalised += 1

    def find(self, data: bytes, at: int, end: int) -> tuple[int, int]:
        """(node, depth) of the longest known prefix of data[at:end]; nothing is counted."""
        node, start, edges = ROOT, at, self.edges
        while at < end:
            child = edges.get(node << 8 | data[at])
            if child is None:
                break
            node = child
            at += 1
        return node, at - start

    def enter(self, data: bytes, at: int, end: int) -> None:
        """Count the prefixes of data[at:end] until the walk ends."""
        node = ROOT
        if self.buckets is None:
            child_of, freq, last, cap, clock = self.edges.get, self.freq, self.last, self.cap, self.clock
            while at < end:
                child = child_of(node << 8 | data[at])
                if child is None:
                    break
                f = freq[child]
                if f < cap:
                    freq[child] = f + 1
                    last[child] = clock
                    clock += 1
                node = child
                at += 1
            self.clock = clock
            if at == end:
                return
            if len(freq) < self.nodes:
                self._new(node, data[at])
                return
        while at < end and node >= 0:
            node = self.extend(node, data[at])
            at += 1

    def spell(self, node: int) -> bytes:
        out = bytearray()
        while node > ROOT:
            out.append(self.label[node])
            node = self.parent[node]
        return bytes(reversed(out))

    def rows(self) -> list[tuple[int, int, int, int, bytes]]:
        """(name, parent's name, letter, counter, spelled) of the nodes in use, by name."""
        return [(self.name(v), self.name(self.parent[v]), self.label[v], self.freq[v], self.spell(v)) for v in range(len(self.parent) - 1, 0, -1)]


class RecentPrefixes:
    """A trie that evicts the leaf inserted longest ago; being used again does not make a leaf younger.

    A parent whose last child is evicted is a leaf again, of its own age. If the only leaf is the node to be extended,
    nothing is evicted and nothing added.
    """

    def __init__(self, nodes: int):
        if nodes < 2:
            raise ValueError("a dictionary has two nodes at least")
        self.nodes, self.clock = nodes, 0
        self.edges: dict[int, int] = {}
        self.parent, self.label, self.children, self.time = [-1], [0], [0], [0]
        self.leaves: list[tuple[int, int]] = []  # (time, node); entries of nodes that have children or were reused are stale

    def name(self, node: int) -> int:
        return node

    number = name

    def adopt(self, walks: list[int], letters: list[int]) -> None:
        """The state after LZ78 phrases whose i-th walk ended at ``walks[i]`` and then added node i + 1; edges are there already."""
        self.parent += walks
        self.label += letters
        self.children = [0] * len(self.parent)
        for node in walks:
            self.children[node] += 1
        self.clock = len(walks)
        self.time = [0, *range(self.clock)]
        self.leaves = [(v - 1, v) for v in range(1, len(self.parent)) if not self.children[v]]

    def _victim(self, cursor: int) -> int:
        kept, found = None, -1
        while self.leaves:
            time, node = self.leaves[0]
            if self.children[node] or self.time[node] != time:
                heapq.heappop(self.leaves)
            elif node == cursor:
                kept = heapq.heappop(self.leaves)
            else:
                found = heapq.heappop(self.leaves)[1]
                break
        if kept:
            heapq.heappush(self.leaves, kept)
        return found

    def extend(self, node: int, letter: int) -> int:
        child = self.edges.get(node << 8 | letter)
        if child is not None:
            return child
        if len(self.parent) < self.nodes:
            new = len(self.parent)
            for column in (self.parent, self.label, self.children, self.time):
                column.append(0)
        else:
            new = self._victim(node)
            if new < 0:
                return -1
            old = self.parent[new]
            del self.edges[old << 8 | self.label[new]]
            self.children[old] -= 1
            if old != ROOT and not self.children[old]:
                heapq.heappush(self.leaves, (self.time[old], old))
        self.parent[new], self.label[new], self.time[new] = node, letter, self.clock
        self.edges[node << 8 | letter] = new
        self.children[node] += 1
        heapq.heappush(self.leaves, (self.clock, new))
        self.clock += 1
        return -1

    spell = FrequentPrefixes.spell
    find = FrequentPrefixes.find
