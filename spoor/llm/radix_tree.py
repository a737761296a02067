"""Adaptive radix trees: byte-wise tries with path compression and node layouts that grow."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Sorted:
    """Up to 4, then up to 16 children: their bytes in order, and beside them the children."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int = 4):
        self.bytes, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node) -> Sorted | Indexed:
        """Add a child, or replace the one there; returns the layout, a larger one when it was full."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.bytes) == self.room:
            grown = _filled(Sorted(16) if self.room == 4 else Indexed(), self)
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)


class Indexed:
    """Up to 48 children: 256 places that say which child a byte has."""

    __slots__ = ("places", "nodes")
    NONE, ROOM = 255, 48

    def __init__(self):
        self.places, self.nodes = bytearray([self.NONE]) * 256, []

    def get(self, byte: int) -> Node | None:
        at = self.places[byte]
        return None if at == self.NONE else self.nodes[at]

    def put(self, byte: int, node: Node) -> Indexed | Direct:
        at = self.places[byte]
        if at != self.NONE:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.ROOM:
            return _filled(Direct(), self).put(byte, node)
        self.places[byte] = len(self.nodes)
        self.nodes.append(node)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.nodes[at]) for byte, at in enumerate(self.places) if at != self.NONE)


class Direct:
    """A place for the child of each of the 256 bytes."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Direct:
        self.nodes[byte] = node
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


def _filled(layout, old):
    for byte, node in old.items():
        layout = layout.put(byte, node)
    return layout


class Node:
    """``prefix`` are the bytes behind the one that leads here; ``value`` that of the key ending here.

    ``sample`` is the value of some key that passes through.
    """

    __slots__ = ("prefix", "children", "value", "sample")

    def __init__(self, prefix: bytes, value=None, sample=None):
        self.prefix, self.children, self.value = prefix, Sorted(), value
        self.sample = value if sample is None else sample


class RadixTree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        """Add a key, which may be a prefix of others or they of it; values are not None."""
        if self.root is None:
            self.root = Node(key, value)
            return
        node, depth = self.root, 0
        while True:
            shared = _shared(node.prefix, key, depth)
            if shared < len(node.prefix):
                _split(node, shared)
            depth += shared
            if depth == len(key):
                node.value = value
                return
            child = node.children.get(key[depth])
            if child is None:
                node.children = node.children.put(key[depth], Node(key[depth + 1 :], value))
                return
            node, depth = child, depth + 1


def _shared(prefix: bytes, key: bytes, depth: int) -> int:
    if key.startswith(prefix, depth):
        return len(prefix)
    n = 0
    for a, b in zip(prefix, key[depth : depth + len(prefix)]):
        if a != b:
            break
        n += 1
    return n


def _split(node: Node, at: int) -> None:
    """Cut the node's prefix in two: the rest goes to a new child with all that hung below."""
    below = Node(node.prefix[at + 1 :], node.value, node.sample)
    below.children = node.children
    node.children = Sorted().put(node.prefix[at], below)
    node.prefix, node.value = node.prefix[:at], None
