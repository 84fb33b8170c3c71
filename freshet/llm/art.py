"""An adaptive radix tree over byte keys, built inside a task."""

from __future__ import annotations

from collections.abc import Iterator

# Children that a node of each layout holds before it grows to the next.
SIZES = (4, 16, 48, 256)
_NONE = 255  # no place in the index of a node of 48; its places are below 48


class Node:
    """A compressed path, the children behind it, and the key that ends there.

    Up to 16 children stand in two short parallel arrays in byte order, up to
    48 in an array of places that 256 bytes index, more in an array of 256.
    """

    __slots__ = ("bytes", "children", "key", "path", "some")

    def __init__(self, path: bytes, some: int):
        self.path, self.some = path, some  # `some`: the number of a key below
        self.key: int | None = None
        self.bytes: bytearray | None = bytearray()
        self.children: list[Node | None] = []

    def layout(self) -> int:
        if self.bytes is None:
            return 256
        if len(self.bytes) == 256:
            return 48
        return 4 if len(self.children) <= 4 else 16

    def child(self, byte: int) -> Node | None:
        if self.bytes is None:
            return self.children[byte]
        if len(self.bytes) == 256:
            at = self.bytes[byte]
            return None if at == _NONE else self.children[at]
        at = self.bytes.find(byte)
        return None if at < 0 else self.children[at]

    def put(self, byte: int, node: Node) -> None:
        """Add or replace the child of a byte; a full node grows."""
        if self.bytes is None:
            self.children[byte] = node
        elif len(self.bytes) == 256:
            at = self.bytes[byte]
            if at != _NONE:
                self.children[at] = node
            elif len(self.children) < SIZES[2]:
                self.bytes[byte] = len(self.children)
                self.children.append(node)
            else:
                wide: list[Node | None] = [None] * 256
                for b, at in enumerate(self.bytes):
                    if at != _NONE:
                        wide[b] = self.children[at]
                wide[byte] = node
                self.bytes, self.children = None, wide
        else:
            at = self.bytes.find(byte)
            if at >= 0:
                self.children[at] = node
            elif len(self.children) < SIZES[1]:
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.children.insert(at, node)
            else:
                index = bytearray([_NONE]) * 256
                for at, b in enumerate(self.bytes):
                    index[b] = at
                index[byte] = len(self.children)
                self.bytes = index
                self.children.append(node)

    def items(self) -> Iterator[tuple[int, Node]]:
        """Children in byte order."""
        if self.bytes is None:
            yield from ((b, c) for b, c in enumerate(self.children) if c is not None)
        elif len(self.bytes) == 256:
            yield from ((b, self.children[at]) for b, at in enumerate(self.bytes) if at != _NONE)
        else:
            yield from zip(self.bytes, self.children, strict=True)


def _common(a: bytes, b: bytes) -> int:
    """Length of the common start of two byte strings, by halving."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Tree:
    """Distinct keys, numbered by the caller."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, number: int) -> None:
        if self.root is None:
            self.root = Node(key, number)
            self.root.key = number
            return
        parent, byte, node, at = None, 0, self.root, 0
        while True:
            same = _common(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                # The path splits: a new node takes its start.
                upper = Node(node.path[:same], node.some)
                upper.put(node.path[same], node)
                node.path = node.path[same + 1 :]
                if parent is None:
                    self.root = upper
                else:
                    parent.put(byte, upper)
                node = upper
            at += same
            if at == len(key):
                node.key = number
                return
            parent, byte, after = node, key[at], node.child(key[at])
            if after is None:
                leaf = Node(key[at + 1 :], number)
                leaf.key = number
                node.put(byte, leaf)
                return
            node, at = after, at + 1

    def aligned(self, width: int) -> Iterator[tuple[int, int, int, int | None]]:
        """(depth, parent, some, key) of the byte depths that are multiples of ``width``, parents first.

        ``depth`` counts in units of ``width``, ``parent`` is the place of the
        parent in this sequence (-1: none), ``some`` a key below, ``key`` the
        one that ends there. Depths inside a compressed path count as well.
        """
        if self.root is None:
            return
        made = 0
        open_ = [(self.root, 0, -1, True)]  # node, byte depth where its path starts, parent's place, whether depth 0 is due
        while open_:
            node, start, up, first = open_.pop()
            end = start + len(node.path)
            # The edge's own byte lies before the path.
            depths = range(0 if first else ((start - 1) // width + 1), end // width + 1)
            for d in depths:
                yield d, up, node.some, node.key if d * width == end else None
                up = made
                made += 1
            open_.extend((c, end + 1, up, False) for _, c in node.items())
