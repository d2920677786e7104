"""Sets as array columns, and the bounded queues that searches use."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

intersection, difference, union, contains, remove = F.array_intersect, F.array_except, F.array_union, F.array_contains, F.array_remove


def add(items: Column, item: Column) -> Column:
    return F.array_distinct(F.array_append(items, item))


def equal(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def cardinality(items: Column) -> Column:
    return F.size(F.array_distinct(items))


def render(items: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))


def pick(items: Column, seed: str = "pick") -> Column:
    """An element chosen by a hash of the set, null for the empty one."""
    n = F.pmod(F.xxhash64(F.array_sort(items), F.lit(seed)), F.greatest(F.size(items), F.lit(1)))
    return F.get(F.array_sort(items), n.cast("int"))


class PriorityQueue:
    """Values by priority, smallest first, or largest first; equal priorities leave in the order they came."""

    def __init__(self, largest: bool = False):
        self.sign, self.heap, self.ticket = -1 if largest else 1, [], count()

    def __len__(self) -> int:
        return len(self.heap)

    def push(self, priority: float, value) -> None:
        heapq.heappush(self.heap, (self.sign * priority, next(self.ticket), value))

    def peek(self):
        return self.heap[0][2]

    def pop(self):
        return heapq.heappop(self.heap)[2]

    def pop_with_priority(self) -> tuple[float, object]:
        p, _, value = heapq.heappop(self.heap)
        return self.sign * p, value

    def reversed(self) -> PriorityQueue:
        out = PriorityQueue(self.sign > 0)
        for p, _, value in sorted(self.heap):
            out.push(self.sign * p, value)
        return out

    def drain(self) -> Iterator:
        while self.heap:
            yield self.pop()

    def values(self) -> list:
        return [x[2] for x in sorted(self.heap)]


class Stack:
    def __init__(self):
        self.items: list = []

    def __len__(self) -> int:
        return len(self.items)

    def push(self, value) -> None:
        self.items.append(value)

    def pop(self):
        return self.items.pop()
