"""Minimum-cost flow on a small graph with whole numbers: successive cheapest paths, a blocking flow for each length."""

from __future__ import annotations

import heapq


class Network:
    """Arcs with capacities and costs of at least zero; ``push`` finds a cheapest flow among the greatest."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, tail: int, head: int, room: int, cost: int = 0) -> int:
        """Adds an arc and, next to it, its reverse; returns its number."""
        for at, to, r, c in ((tail, head, room, cost), (head, tail, 0, -cost)):
            self.arcs[at].append(len(self.head))
            self.head.append(to), self.room.append(r), self.cost.append(c)
        return len(self.head) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc + 1]

    def _lengths(self, source: int, potential: list[int]) -> list[int | None]:
        length: list[int | None] = [None] * len(self.arcs)
        queue, length[source] = [(0, source)], 0
        while queue:
            far, node = heapq.heappop(queue)
            if far > length[node]:
                continue
            for a in self.arcs[node]:
                to = self.head[a]
                if self.room[a] and (length[to] is None or far + self.cost[a] + potential[node] - potential[to] < length[to]):
                    length[to] = far + self.cost[a] + potential[node] - potential[to]
                    heapq.heappush(queue, (length[to], to))
        return length

    def _levels(self, source: int, sink: int, potential: list[int]) -> list[int] | None:
        level = [-1] * len(self.arcs)
        level[source], queue = 0, [source]
        for node in queue:
            for a in self.arcs[node]:
                to = self.head[a]
                if self.room[a] and level[to] < 0 and self.cost[a] + potential[node] == potential[to]:
                    level[to] = level[node] + 1
                    queue.append(to)
        return level if level[sink] >= 0 else None

    def push(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost): as much as fits, at the least cost."""
        potential, total, cost = [0] * len(self.arcs), 0, 0
        while (length := self._lengths(source, potential))[sink] is not None:
            most = max(x for x in length if x is not None)
            potential = [p + (most if x is None else x) for p, x in zip(potential, length, strict=True)]
            while level := self._levels(source, sink, potential):
                turn, path = [0] * len(self.arcs), []
                while True:
                    node = self.head[path[-1]] if path else source
                    if node == sink:
                        least = min(self.room[a] for a in path)
                        for a in path:
                            self.room[a] -= least
                            self.room[a ^ 1] += least
                            cost += least * self.cost[a]
                        total += least
                        path = path[: next(k for k, a in enumerate(path) if not self.room[a])]
                        continue
                    for k in range(turn[node], len(self.arcs[node])):
                        a = self.arcs[node][k]
                        if self.room[a] and level[self.head[a]] == level[node] + 1 and self.cost[a] + potential[node] == potential[self.head[a]]:
                            turn[node] = k
                            path.append(a)
                            break
                    else:
                        level[node] = -1
                        if not path:
                            break
                        path.pop()
        return total, cost
