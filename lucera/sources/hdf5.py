"""HDF5 files as trees of dicts, arrays and strings: a small reader and writer of bytes.

Written from the public format specification. The writer makes superblock 0 files with symbol
table groups and contiguous datasets. The reader also takes newer superblocks and object headers
with compact links, chunked datasets with deflate, shuffle and checksum filters, and strings of
fixed or variable length. Not read: groups with links in a fractal heap, newer chunk indexes,
compound and reference types.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
UNDEFINED = 0xFFFFFFFFFFFFFFFF
#: Half the entries of a symbol node and of a group's tree.
LEAF_K, TREE_K = 8, 64


def _pad(b: bytes, n: int = 8) -> bytes:
    return b + bytes(-len(b) % n)


# writer -----------------------------------------------------------------------


class _Writer:
    def __init__(self):
        self.out = bytearray(96)

    def put(self, data: bytes) -> int:
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    @staticmethod
    def header(messages: list[tuple[int, bytes]]) -> bytes:
        body = b"".join(struct.pack("<HHB3x", kind, len(_pad(m)), 0) + _pad(m) for kind, m in messages)
        return struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body

    def dataset(self, value) -> int:
        if isinstance(value, str):
            raw = value.encode() + b"\0"
            kind, shape, data = struct.pack("<B3xI", 0x13, len(raw)), (), raw
        elif isinstance(value, list | tuple) and all(isinstance(v, str) for v in value):
            raw = [v.encode() for v in value]
            width = max((len(r) for r in raw), default=0) + 1
            kind, shape, data = struct.pack("<B3xI", 0x13, width), (len(raw),), b"".join(r.ljust(width, b"\0") for r in raw)
        else:
            a = np.asarray(value)
            if a.dtype.kind == "f":
                a = a.astype("<f8")
                kind = struct.pack("<BBBBI", 0x11, 0x20, 0x3F, 0, 8) + struct.pack("<HHBBBBI", 0, 64, 52, 11, 0, 52, 1023)
            elif a.dtype.kind in "iub":
                a = a.astype("<i4" if a.dtype.itemsize <= 4 else "<i8")
                kind = struct.pack("<BBBBI", 0x10, 8, 0, 0, a.dtype.itemsize) + struct.pack("<HH", 0, 8 * a.dtype.itemsize)
            else:
                raise TypeError(f"no HDF5 type for {a.dtype}")
            shape, data = a.shape, a.tobytes()
        at = self.put(data) if data else UNDEFINED
        space = struct.pack("<BBB5x", 1, len(shape), 0) + b"".join(struct.pack("<Q", n) for n in shape)
        layout = struct.pack("<BBQQ", 3, 1, at, len(data))
        return self.put(self.header([(1, space), (3, kind), (5, bytes([2, 2, 0, 0])), (8, layout)]))

    def group(self, tree: dict) -> tuple[int, int, int]:
        """Addresses of the group's header, tree and heap."""
        names = sorted(tree, key=str.encode)
        heap, places = bytearray(8), {}
        for n in names:
            places[n] = len(heap)
            heap += _pad(n.encode() + b"\0")
        entries = []
        for n in names:
            if isinstance(tree[n], dict):
                head, btree, local = self.group(tree[n])
                entries.append(struct.pack("<QQIIQQ", places[n], head, 1, 0, btree, local))
            else:
                entries.append(struct.pack("<QQIIQQ", places[n], self.dataset(tree[n]), 0, 0, 0, 0))
        cuts = [entries[i : i + 2 * LEAF_K] for i in range(0, len(entries), 2 * LEAF_K)]
        if len(cuts) > 2 * TREE_K:
            raise ValueError(f"a group of {len(entries)} members is too large")
        nodes = [self.put((b"SNOD" + struct.pack("<BxH", 1, len(c)) + b"".join(c)).ljust(8 + 80 * LEAF_K, b"\0")) for c in cuts]
        body = struct.pack("<Q", 0)
        for i, node in enumerate(nodes):
            body += struct.pack("<QQ", node, places[names[min(len(names), (i + 1) * 2 * LEAF_K) - 1]])
        node = b"TREE" + struct.pack("<BBHQQ", 0, 0, len(nodes), UNDEFINED, UNDEFINED) + body
        btree = self.put(node.ljust(24 + 2 * TREE_K * 16 + 8, b"\0"))
        segment = self.put(bytes(heap))
        local = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(heap), 1, segment))
        return self.put(self.header([(0x11, struct.pack("<QQ", btree, local))])), btree, local


def dumps(tree: dict) -> bytes:
    """The file of a tree: dicts are groups, arrays, numbers, strings and lists of strings are datasets."""
    w = _Writer()
    head, btree, local = w.group(tree)
    w.out += bytes(-len(w.out) % 8)
    top = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", LEAF_K, TREE_K, 0)
    top += struct.pack("<QQQQ", 0, UNDEFINED, len(w.out), UNDEFINED) + struct.pack("<QQIIQQ", 0, head, 1, 0, btree, local)
    w.out[:96] = top
    return bytes(w.out)


# reader -----------------------------------------------------------------------


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        if data[8] < 2:
            self.offset, self.length = data[13], data[14]
            at = 24 + (4 if data[8] == 1 else 0)
            self.base = self.number(at, self.offset)
            root = at + 4 * self.offset + self.offset
        else:
            self.offset, self.length = data[9], data[10]
            self.base, root = self.number(12, self.offset), 12 + 3 * self.offset
        self.root = self.number(root, self.offset)

    def number(self, at: int, size: int) -> int:
        return int.from_bytes(self.data[at : at + size], "little")

    def address(self, at: int) -> int | None:
        v = self.number(at, self.offset)
        return None if v == (1 << (8 * self.offset)) - 1 else v + getattr(self, "base", 0)

    def messages(self, at: int):
        """(kind, first byte, size) of an object's header messages."""
        if self.data[at : at + 4] == b"OHDR":
            flags, p = self.data[at + 5], at + 6
            p += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            size = self.number(p, width)
            blocks, head = [(p + width, size)], 6 if flags & 4 else 4
            while blocks:
                p, size = blocks.pop(0)
                end = p + size
                while p + head <= end:
                    kind, n = self.data[p], self.number(p + 1, 2)
                    if kind == 0x10:
                        blocks.append((self.address(p + head) + 4, self.number(p + head + self.offset, self.length) - 8))
                    elif kind:
                        yield kind, p + head, n
                    p += head + n
            return
        blocks, left = [(at + 16, self.number(at + 8, 4))], self.number(at + 2, 2)
        while blocks and left:
            p, size = blocks.pop(0)
            end = p + size
            while p + 8 <= end and left:
                kind, n = self.number(p, 2), self.number(p + 2, 2)
                left -= 1
                if kind == 0x10:
                    blocks.append((self.address(p + 8), self.number(p + 8 + self.offset, self.length)))
                elif kind:
                    yield kind, p + 8, n
                p += 8 + n

    def members(self, at: int) -> dict[str, int] | None:
        """Names and header addresses of a group's members; None for a dataset."""
        out, group = {}, False
        for kind, p, _ in self.messages(at):
            if kind == 0x11:
                group = True
                heap = self.address(p + self.offset)
                names = self.address(heap + 8 + 2 * self.length)
                out |= {self.text(names + a): b for a, b in self.tree(self.address(p))}
            elif kind == 2:
                group = True
                flags = self.data[p + 1]
                if self.address(p + 2 + (8 if flags & 1 else 0)) is not None:
                    raise ValueError("links in a fractal heap are not read")
            elif kind == 6:
                group = True
                flags, q = self.data[p + 1], p + 2
                hard = True
                if flags & 8:
                    hard, q = self.data[q] == 0, q + 1
                q += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
                width = 1 << (flags & 3)
                n = self.number(q, width)
                name = self.data[q + width : q + width + n].decode()
                if hard:
                    out[name] = self.address(q + width + n)
        return out if group else None

    def tree(self, at: int):
        """(offset of the name, header address) of the entries below a group's tree node."""
        level, n, p = self.data[at + 5], self.number(at + 6, 2), at + 8 + 2 * self.offset
        for i in range(n):
            child = self.address(p + self.length + i * (self.offset + self.length))
            if level:
                yield from self.tree(child)
            else:
                for k in range(self.number(child + 6, 2)):
                    e = child + 8 + k * (2 * self.offset + 24)
                    yield self.number(e, self.offset), self.address(e + self.offset)

    def text(self, at: int) -> str:
        return self.data[at : self.data.index(b"\0", at)].decode()

    def dtype(self, p: int):
        """numpy type, or ('vlen',) of strings of variable length."""
        kind, size = self.data[p] & 15, self.number(p + 4, 4)
        order = ">" if self.data[p + 1] & 1 else "<"
        if kind == 0:
            return np.dtype(f"{order}{'i' if self.data[p + 1] & 8 else 'u'}{size}")
        if kind == 1:
            return np.dtype(f"{order}f{size}")
        if kind == 3:
            return np.dtype(f"S{size}")
        if kind == 9 and self.data[p + 1] & 15 == 1:
            return ("vlen",)
        raise ValueError(f"datatype class {kind} is not read")

    def value(self, at: int):
        shape, dtype, layout, filters = (), None, None, []
        for kind, p, _ in self.messages(at):
            if kind == 1:
                v, rank = self.data[p], self.data[p + 1]
                first = p + (8 if v == 1 else 4)
                shape = tuple(self.number(first + i * self.length, self.length) for i in range(rank))
                if v == 2 and self.data[p + 3] == 2:
                    shape = (0,)
            elif kind == 3:
                dtype = self.dtype(p)
            elif kind == 8:
                layout = p
            elif kind == 11:
                filters = self.filters(p)
        item = 16 if isinstance(dtype, tuple) else dtype.itemsize
        count = int(np.prod(shape, dtype=np.int64))
        raw = self.raw(layout, shape, item, count, filters)
        if isinstance(dtype, tuple):
            out = [self.heap(raw[i * item : (i + 1) * item]) for i in range(count)]
        else:
            a = np.frombuffer(raw, dtype, count).reshape(shape)
            if dtype.kind != "S":
                return a[()] if shape else a.item()
            out = [x.split(b"\0")[0].decode(errors="replace") for x in a.reshape(-1).tolist()]
        return out if shape else (out[0] if out else "")

    def heap(self, ref: bytes) -> str:
        """A string of the global heap."""
        n, at, index = int.from_bytes(ref[:4], "little"), int.from_bytes(ref[4 : 4 + self.offset], "little"), int.from_bytes(ref[4 + self.offset : 8 + self.offset], "little")
        if not n or not at:
            return ""
        p = at + self.base + 8 + self.length
        while self.number(p, 2) != index:
            p += 8 + self.length + (self.number(p + 8, self.length) + 7) // 8 * 8
        return self.data[p + 8 + self.length : p + 8 + self.length + n].split(b"\0")[0].decode(errors="replace")

    def filters(self, p: int) -> list[tuple[int, list[int]]]:
        version, n = self.data[p], self.data[p + 1]
        q, out = p + (8 if version == 1 else 2), []
        for _ in range(n):
            kind = self.number(q, 2)
            named = version == 1 or kind >= 256
            length = self.number(q + 2, 2) if named else 0
            q += 4 if named else 2
            count = self.number(q + 2, 2)
            q += 4 + (length + 7) // 8 * 8 if version == 1 else 4 + length
            out.append((kind, [self.number(q + 4 * i, 4) for i in range(count)]))
            q += 4 * count + (4 if version == 1 and count % 2 else 0)
        return out

    def raw(self, p: int, shape, item: int, count: int, filters) -> bytes:
        version, kind = self.data[p], self.data[p + 1]
        if version not in (3, 4):
            raise ValueError(f"layout version {version} is not read")
        if kind == 0:
            return self.data[p + 4 : p + 4 + self.number(p + 2, 2)]
        if kind == 1:
            at = self.address(p + 2)
            return bytes(count * item) if at is None else self.data[at : at + count * item]
        if version == 4:
            raise ValueError("newer chunk indexes are not read")
        rank = self.data[p + 2] - 1
        at = self.address(p + 3)
        chunk = tuple(self.number(p + 3 + self.offset + 4 * i, 4) for i in range(rank))
        out = np.zeros(shape, np.dtype((np.void, item)))
        if at is not None:
            for size, mask, start, where in self.chunks(at, rank):
                block = self.data[where : where + size]
                for i, (f, values) in reversed(list(enumerate(filters))):
                    if mask >> i & 1:
                        continue
                    if f == 1:
                        block = zlib.decompress(block)
                    elif f == 2:
                        n = values[0] if values else item
                        block = np.frombuffer(block, np.uint8).reshape(n, -1).T.tobytes()
                    elif f == 3:
                        block = block[:-4]
                    else:
                        raise ValueError(f"filter {f} is not read")
                piece = np.frombuffer(block, out.dtype, int(np.prod(chunk))).reshape(chunk)
                inside = tuple(slice(0, max(0, min(c, n - s))) for c, n, s in zip(chunk, shape, start, strict=True))
                out[tuple(slice(s, s + i.stop) for s, i in zip(start, inside, strict=True))] = piece[inside]
        return out.tobytes()

    def chunks(self, at: int, rank: int):
        """(bytes, filter mask, first cell, address) of a chunked dataset's chunks."""
        level, n, p = self.data[at + 5], self.number(at + 6, 2), at + 8 + 2 * self.offset
        key = 8 + 8 * (rank + 1)
        for i in range(n):
            k = p + i * (key + self.offset)
            child = self.address(k + key)
            if level:
                yield from self.chunks(child, rank)
            else:
                yield self.number(k, 4), self.number(k + 4, 4), tuple(self.number(k + 8 + 8 * d, 8) for d in range(rank)), child

    def load(self, at: int):
        members = self.members(at)
        return self.value(at) if members is None else {n: self.load(a) for n, a in members.items()}


def loads(data: bytes, path: str = "") -> dict:
    """The tree of a file, or of the group or dataset at a path."""
    r = _Reader(data)
    at = r.root + r.base
    for name in filter(None, path.split("/")):
        at = (r.members(at) or {})[name]
    return r.load(at)
