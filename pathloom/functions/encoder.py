"""Writes the binary format of directory entries, for made dumps and tests; a mirror of the decoder."""

from __future__ import annotations

import struct

from ..schema import ON_DISK_MAGIC, S_IFDIR, S_IFLNK, S_IFREG


def num(form, *v):
    return struct.pack("<" + form, *v)


def text(b):
    b = b.encode() if isinstance(b, str) else b
    return num("I", len(b)) + b


def block(version, compat, body):
    return num("BBI", version, compat, len(body)) + body


def inode(ino, mode, uid=0, gid=0, size=0, mtime=0, ctime=0, rctime=0, rfiles=0, rsubdirs=0, clients=0, old_layout=False, **_):
    layout = num("I", 4 << 20) + bytes(24) if old_layout else block(2, 2, num("IIIQ", 4 << 20, 1, 4 << 20, (1 << 64) - 1) + text(""))
    out = num("QIIIIIIi", ino, 0, ctime, 0, mode, uid, gid, 1) + b"\0" + bytes(8) + layout + num("Q", size) + num("IQQI", 1, 0, 0, 0)
    out += num("II", mtime, 0) + num("III", 1, 0, 0) + num("I", clients) + b"".join(num("Q", 4000 + i) + block(
        2,
        2,
        num("QQQ", 0, 1, 1),
    ) for i in range(clients))
    out += block(3, 2, num("QIIQQQ", 1, 0, 0, 3, 4, 0)) + block(3, 2, num("QqqqQQII", 2, 0, rfiles, rsubdirs, 0, 0, rctime, 0))
    return block(19, 6, out + b"fields that come later")


def store(symlink="", tree=None, **i):
    out = inode(**i)
    if i["mode"] & 0o170000 == S_IFLNK:
        out += text(symlink)
    tree = tree or {}
    return out + num("I", len(tree)) + b"".join(num("Ii", f, b) for f, b in tree.items()) + num("I", 0)


def primary(alternate="", **i):
    return num("Q", 2) + b"i" + block(2, 1, text(alternate) + block(6, 4, store(**i)))


def remote(ino, dtype=8):
    return num("Q", 2) + b"l" + block(2, 1, num("QB", ino, dtype) + text(""))


def root(tree):
    return text(ON_DISK_MAGIC) + block(6, 4, store(ino=1, mode=S_IFDIR | 0o755, tree=tree))


def folder(ino, **more):
    return primary(ino=ino, mode=S_IFDIR | 0o755, **more)


def plain(ino, **more):
    return primary(ino=ino, mode=S_IFREG | 0o644, **more)


def link(ino, target):
    return primary(ino=ino, mode=S_IFLNK | 0o777, symlink=target)
