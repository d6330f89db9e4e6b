"""Made trees of directories, and a walk over them that is written the plain way."""

import random
from collections import deque
from dataclasses import dataclass, field

import pytest

from pathloom.functions import codec, encoder


@dataclass
class Record:
    """What a directory's object holds under a key; kind ``?`` can't be decoded."""

    name: str
    kind: str
    ino: int
    uid: int = 0
    inside: int = 0
    tree: dict = field(default_factory=dict)
    snap: str = "head"

    @property
    def key(self):
        return f"{self.name}_{self.snap}"

    def value(self):
        if self.kind == "?":
            return b"\x01\x02"
        if self.kind == "h":
            return encoder.remote(self.ino)
        mode = {"d": 0o040700, "f": 0o100600, "l": 0o120777, "o": 0o020600}[self.kind]
        folder = self.kind == "d"
        return encoder.primary(
            ino=self.ino,
            mode=mode,
            uid=self.uid,
            symlink="x" if self.kind == "l" else "",
            tree=self.tree,
            rfiles=self.inside,
            rsubdirs=int(folder),
        )


class Made:
    """Objects by name, each with its records, and the fragments of the root."""

    def __init__(self, seed, folders=40):
        rng = random.Random(seed)
        self.objects, self.roots = {}, codec.leaves({0: 2})
        self.trees = {1: {0: 2}}
        known, free = [1], 10
        for _ in range(folders):
            parent, ino = rng.choice(known[-6:]), free
            free += 1
            tree = rng.choice([{}, {}, {0: 1}, {0: 1, 0x01800000: 2}])
            state = rng.choice(["full", "full", "full", "empty", "absent", "stale"])
            self.put(rng, parent, Record(f"dir {ino}", "d", ino, rng.randrange(9), 3 if state in ("full", "stale") else 0, tree))
            self.trees[ino] = tree
            if state in ("absent", "stale"):
                continue
            for f in codec.leaves(tree):
                self.objects.setdefault(f"{ino:x}.{f:08x}", [])
            if state == "full":
                known.append(ino)
                for k in range(rng.randrange(1, 12)):
                    free += 1
                    self.put(
                        rng,
                        ino,
                        Record(
                            f"{rng.choice('abc')}{k}_{ino}",
                            rng.choice("fffflho?"),
                            free,
                            rng.randrange(9),
                            snap=rng.choice(["head"] * 8 + ["2b"]),
                        ),
                    )
        # seen a second time, from another place, and a way back up
        self.put(rng, known[-1], Record("again", "d", known[2], 1, 3, self.trees[known[2]]))
        self.put(rng, known[-1], Record("up", "d", known[1], 1, 3, self.trees[known[1]]))

    def put(self, rng, parent, record):
        frag = rng.choice(codec.leaves(self.trees[parent]))
        self.objects.setdefault(f"{parent:x}.{frag:08x}", []).append(record)

    def rows(self):
        """An empty object has a row without key."""
        return [(o, r.key, r.value()) for o, records in self.objects.items() for r in records] + [(o, None, None) for o, records in self.objects.items() if not records]

    def pages(self):
        return {o: {r.key: r.value() for r in records} for o, records in self.objects.items()}

    def walked(self, start=1, page=1024, levels=10**9):
        """(entries, counters) by a queue of objects."""
        waiting = deque((start, f"{start:x}.{f:08x}", True, 0) for f in (self.roots if start == 1 else [0]))
        seen, entries = {w[1]: w for w in waiting}, []
        names = "objects pages entries dirs fragmented enoent missed_dirs decode_errors snap_skipped expected".split()
        n = dict.fromkeys(names, 0)
        # whether an object should hold something is said by all places that lead to it on the level before
        while waiting:
            level, found = list(waiting), {}
            waiting.clear()
            if level[0][3] >= levels:
                break
            for parent, oid, nonempty, depth in level:
                if oid not in self.objects:
                    n["missed_dirs" if nonempty else "enoent"] += 1
                    continue
                records = {r.key: r for r in self.objects[oid]}.values()
                n["objects"] += 1
                n["pages"] += max(1, -(-len(records) // page))
                for r in records:
                    if r.kind == "?" or r.snap != "head":
                        n["decode_errors" if r.kind == "?" else "snap_skipped"] += 1
                        continue
                    entries.append((parent, r.name, r.ino, r.kind, 0 if r.kind == "h" else r.uid))
                    n["entries"] += 1
                    if parent == start:
                        n["expected"] += r.inside + 1 if r.kind == "d" else 1
                    if r.kind == "d":
                        n["dirs"] += 1
                        n["fragmented"] += len(codec.leaves(r.tree)) > 1
                        for f in codec.leaves(r.tree):
                            child = f"{r.ino:x}.{f:08x}"
                            if child not in seen:
                                found[child] = (r.ino, child, found.get(child, (0, 0, False))[2] or r.inside + 1 > 1, depth + 1)
            for child, item in found.items():
                seen[child] = item
                waiting.append(item)
        return sorted(entries), n


@pytest.fixture(scope="session")
def made():
    return [Made(seed) for seed in (3, 8)]
