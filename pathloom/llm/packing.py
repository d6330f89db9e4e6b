"""Best-fit packing of token pieces into sequences, improved by a swap-based local search."""

from __future__ import annotations

import json
import os
import re
import string
import uuid
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
#: Pieces that one task packs at a time; leftovers of several blocks meet again in a next round.
BLOCK = 16384
#: Pieces of its emptiest sequences that a block hands to the next round.
HANDED = 2048
#: Characters of texts, and at most so many words, whose unknown words are learned together.
TOGETHER = 1_000_000
RUN = 200_000
#: Parts of words, and other words, whose ids a worker remembers.
REMEMBERED = 700_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, "WordEncoder"] = {}
_SPACE = re.compile(r"\s")
#: The splitter whose cuts are known here: letters that follow one another stay together, and so does other ASCII punctuation after them.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: An added token that matches this can't stand in letters with closing punctuation.
_APART = re.compile(r"[!-/:-@[-`{-~].*[A-Za-z0-9]", re.S)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _bare(path: str):
    """The tokenizer's own model behind nothing but a split at spaces, or None where what stands before the model isn't known here."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    alone = all(spec.get(k) is None for k in ("truncation", "padding", "post_processor"))
    alone &= all(_APART.search(t["content"]) for t in spec["added_tokens"])
    if not alone or len(before) != 2 or before[0] != split or before[1] | level != before[1]:
        return None
    spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
    return Tokenizer.from_str(json.dumps(spec))


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in byte-level pieces; a space is left as it is."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(shown, shown)) | {b: 256 + k for k, b in enumerate(hidden)} | {32: 32}


class Memory:
    """Values of keys as ``learn`` gives them for a list, remembered for ``most`` keys, or those of one call if they are more. The half that was asked for last stays."""

    def __init__(self, most: int, learn):
        self.half, self.learn = most // 2, learn
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, keys: list[str]) -> list[bytes]:
        """``keys`` are distinct."""
        values = list(map(self.recent.get, keys))
        missing = [k for k, v in zip(keys, values) if v is None]
        if missing:
            found = {k: self.older[k] for k in missing if k in self.older}
            new = [k for k in missing if k not in found]
            found.update(zip(new, self.learn(new) if new else [], strict=True))
            if len(self.recent) + len(found) > self.half:
                self.older, self.recent = self.recent, {}
            self.recent.update(found)
            values = [found[k] if v is None else v for k, v in zip(keys, values)]
        return values


class WordEncoder:
    """Ids of a text by a tokenizer that drops white space, found word by word.

    The tokenizer's normaliser and splitter treat each run between ASCII white space on its own, so the ids
    of a text are those of its words in order, as little-endian bytes; they are put together in Arrow. A word of letters with
    closing punctuation is looked up by its two parts, ASCII ones lowered, others after the tokenizer's own
    normaliser, many at a time. The splitter is asked once for each other letter whether it is one. Unknown parts go to the
    tokenizer's model as one text with many others, past normaliser and splitter, which would leave
    them as they are; of a tokenizer with another splitter, the whole of it encodes that text. That the pieces' bytes end where the
    words do is checked for every part. All other words are encoded by the tokenizer one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = _bare(path)
        self.shown = _byte_letters()
        self.closing = string.punctuation if self.bare else ",.!"
        self.letters: dict[str, bool] = {}  # whether the splitter takes them for such
        self.remembered = remembered
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.sizes = np.zeros(len(self.ends), np.int64)  # a piece has a character for each byte
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
            self.sizes[i] = len(piece.removesuffix("</w>"))
        normaliser = self.tokenizer.normalizer
        #: whether all that the normaliser does to ASCII characters, none of them white space, is to lower them
        self.lowers = normaliser is not None and all(normaliser.normalize_str(chr(c)) == chr(c).lower() for c in range(33, 127))

    def forget(self, run: str = "") -> None:
        self.run = run
        self.parts = Memory(self.remembered, self._together)
        self.words = Memory(self.remembered, self._learn)

    @classmethod
    def of(cls, path: str, run: str) -> "WordEncoder":
        """This worker's encoder. The tasks of one run share what it remembers; the next run starts anew."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        if _ENCODERS[path].run != run:
            _ENCODERS[path].forget(run)
        return _ENCODERS[path]

    def _each(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of normalised words that the splitter should leave whole, encoded as one text. If a word's bytes aren't those of its pieces, all go one by one."""
        text = " ".join(words)
        if self.bare:
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self.shown)
        elif not text.isascii() and self.tokenizer.normalizer.normalize_str(text) != text:
            return self._each(words)
        ids = np.array((self.bare or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        sizes = np.array([len(w.encode()) for w in words])
        if len(cuts) != len(words) or cuts[-1] != len(ids) or (np.add.reduceat(self.sizes[ids], np.r_[0, cuts[:-1]]) != sizes).any():
            return self._each(words)
        data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _normalised(self, words: list[str]) -> list[str] | None:
        """The words by the tokenizer's own normaliser, or None if they can't be told apart afterwards."""
        if self.tokenizer.normalizer is None:
            return words
        out = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        return out if len(out) == len(words) else None

    def _one_run(self, cores: list[str]) -> set[str]:
        """Those that the splitter takes for one run of letters. Another splitter than the known one shows it by where pieces end."""
        some = {c for c in cores if c.isalpha()}
        if not self.bare:
            return some
        every, cut = set("".join(some)), self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in every.difference(self.letters):
            self.letters[c] = len(cut(f"a{c}a")) == 1
        strange = {c for c in every if not self.letters[c]}
        return {c for c in some if strange.isdisjoint(c)} if strange else some

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words other than ASCII letters with closing punctuation."""
        known: dict[str, bytes] = {}
        # a word with white space of its own, such as a no-break space, or a special token is none of the simple ones
        rare = [w for w in words if not (self.lowers and w.isascii()) and "<|" not in w and not _SPACE.search(w)]
        normal = self._normalised(rare) if rare else None
        if normal:
            cores = [n.rstrip(self.closing) for n in normal]
            tails = [n[len(c) :] for n, c in zip(normal, cores)]
            right = self._one_run(cores)
            keys = list(right.union(t for t in tails if t))
            part = dict(zip(keys, self.parts(keys), strict=True)) | {"": b""}
            known = {w: part[c] + part[t] for w, c, t in zip(rare, cores, tails) if c in right}
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._each(rest) if rest else [], strict=True))
        return [known[w] for w in words]

    def _ids(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words."""
        forms = pc.ascii_lower(words)
        cores = pc.utf8_rtrim(forms, self.closing)
        simple = pc.and_(pc.string_is_ascii(words), pc.ascii_is_alpha(cores)).to_numpy(zero_copy_only=False) & self.lowers
        cores, forms = cores.filter(pa.array(simple)), forms.filter(pa.array(simple))
        others = words.filter(pa.array(~simple)).to_numpy(zero_copy_only=False).tolist()
        # what stands before a tail are ASCII letters only
        keys = pa.concat_arrays([cores, pc.ascii_ltrim(forms, string.ascii_lowercase), pa.array([""], cores.type)]).dictionary_encode()
        names = keys.dictionary.to_numpy(zero_copy_only=False).tolist()
        none = names.index("")
        names.pop(none)
        found = self.parts(names)
        found.insert(none, b"")
        both = pa.array(found, pa.large_binary()).take(keys.indices)
        joined = pc.binary_join_element_wise(both.slice(0, len(cores)), both.slice(len(cores), len(cores)), pa.scalar(b"", both.type))
        place = np.empty(len(words), np.int64)
        place[simple], place[~simple] = np.arange(len(cores)), len(cores) + np.arange(len(others))
        return pa.concat_arrays([joined, pa.array(self.words(others), both.type)]).take(pa.array(place))

    def _block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, its words going through in runs."""
        spaced = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ") for t in texts]
        lists = pc.split_pattern(pa.array(spaced, pa.large_string()), " ")
        words, data, ends, size = lists.values, [], [np.zeros(1, np.int64)], 0
        for k in range(0, len(words), RUN):
            run = words.slice(k, RUN).dictionary_encode()
            ids = self._ids(run.dictionary).take(run.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            data.append(memoryview(ids.buffers()[2] or b"")[at[0] : at[-1]])
            ends.append(at[1:] - at[0] + size)
            size = ends[-1][-1]
        whole, cuts = b"".join(data), np.concatenate(ends)[lists.offsets.to_numpy()].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. The unknown words of some texts are learned together; a long text goes through in runs."""
        out, some, size = [], [], 0
        for text in [*texts, None]:
            if some and (text is None or size + len(text) > TOGETHER):
                out += self._block(some)
                some, size = [], 0
            if text is not None:
                some.append(text)
                size += len(text)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: every document's ids and a closing 0, cut only where longer than ``capacity``. A null text counts as empty."""
    common.ship(df.sparkSession)
    path, own = tokenizer or default_tokenizer(), uuid.uuid4().hex

    def run(batches):
        encoder = WordEncoder.of(path, own)
        for batch in batches:
            for some in common.slices(batch):
                rows = []
                texts = [t or "" for t in some.column(1).to_pylist()]
                last = dict.fromkeys(texts)
                last.update(zip(last, encoder.encode_all(list(last))))
                for doc, text in zip(some.column(0).to_pylist(), texts, strict=True):
                    ids = last[text] + b"\0\0\0\0"
                    for k, at in enumerate(range(0, len(ids), capacity * 4)):
                        piece = ids[at : at + capacity * 4]
                        rows.append((doc, k, at // 4, len(piece) // 4, common.unsigned_crc(piece)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield common.frame({n: (v, k) for n, v, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of decreasing sizes; bins as lists of positions."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: a bin with gap g is there
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = open_gaps >> s
        if fits:
            gap = s + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            b, gap = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        if gap > s:
            by_gap[gap - s].append(b)
            open_gaps |= 1 << (gap - s)
    return bins


def _units(sizes: list[int], documents: list[int]) -> tuple[dict[int, tuple], dict[int, tuple]]:
    """What one document of a bin, and what two of them come to: sum -> the documents. Equal sizes stand for each other."""
    held: dict[int, list[int]] = {}
    for i in documents:
        held.setdefault(sizes[i], []).append(i)
    order = sorted(held)
    one = {s: (held[s][0],) for s in order if s}
    two = {2 * s: tuple(held[s][:2]) for s in order if len(held[s]) > 1}
    for k, x in enumerate(order):
        for y in order[k + 1 :]:
            two.setdefault(x + y, (held[x][0], held[y][0]))
    return one, two


def local_search(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Moves one or two documents, exchanges one for one, two for one or one for two between underfull bins.

    Each step gives documents of the emptiest bin to another bin for less in return, and must increase the
    sum of squared fills, so it can't run in a circle. A bin whose documents are all gone is removed. A bin
    that no step improves is passed over until the others have had their turn. The search ends when the number of bins
    meets its lower bound, or when no step improves any bin.

    All documents are tried: what a bin can give back is indexed by the sum of it and the bin's room, which is
    the largest gift that the bin can take for it. A gift of s tokens fits where the sum is s or more and
    the bin gives back less than s; the room that stays is the difference.
    """
    least = lower_bound(sizes, capacity)
    fills = [sum(sizes[i] for i in b) for b in bins]
    opened = [k for k, f in enumerate(fills) if f < capacity]
    if len(bins) <= least or len(opened) < 2:
        return bins
    # for nothing or one document given back, and for two: sum -> sorted (given back, bin) as one number, and the least given back
    known: dict[int, tuple[dict, dict]] = {}
    found: tuple[list[list[int]], ...] = tuple([[] for _ in range(capacity + 1)] for _ in range(2))
    lowest = np.full((2, capacity + 1), capacity + 1, np.int64)
    count = len(bins)

    def entries(b: int):
        one, two = known[b]
        room = capacity - fills[b]
        for kind, backs in ((0, (0, *one)), (1, two)) if room else ():
            for back in backs:
                yield kind, room + back, back * count + b

    def enter(b: int) -> None:
        for kind, at, entry in entries(b):
            insort(found[kind][at], entry)
            lowest[kind, at] = found[kind][at][0] // count

    def leave(b: int) -> None:
        for kind, at, entry in entries(b):
            some = found[kind][at]
            del some[bisect_left(some, entry)]
            lowest[kind, at] = some[0] // count if some else capacity + 1

    def best_step(a: int):
        """(gift, kind, sum) that leaves the least room, of equal ones the largest gift; None where no step is left."""
        one, two = known[a]
        left, best = capacity - fills[a], None
        for s, kinds, gift in sorted(
            [(s, (0, 1), g) for s, g in one.items()] + [(s, (0,), g) for s, g in two.items()],
            key=lambda g: -g[0],
        ):
            for kind in kinds:
                fits = lowest[kind, s : s + left] < s
                if fits.any():
                    left = int(fits.argmax())
                    best = (gift, kind, s + left)
            if left == 0:
                break
        return best

    for b in opened:
        known[b] = _units(sizes, bins[b])
        enter(b)
    waiting = [(fills[b], b) for b in opened]
    heapify(waiting)
    alive, improved = count, False
    while alive > least:
        if not waiting:
            if not improved:
                break
            improved = False
            waiting = [(fills[b], b) for b in opened if bins[b] and fills[b] < capacity]
            heapify(waiting)
            continue
        fill, a = heappop(waiting)
        if fills[a] != fill or not bins[a]:
            continue
        leave(a)
        step = best_step(a)
        if step is None:
            enter(a)
            continue
        gift, kind, at = step
        back, b = divmod(found[kind][at][0], count)
        leave(b)
        returned = known[b][kind][back] if back or kind else ()
        bins[b] = [i for i in bins[b] if i not in returned] + list(gift)
        bins[a] = [i for i in bins[a] if i not in gift] + list(returned)
        moved = sum(sizes[i] for i in gift) - back
        fills[a], fills[b] = fills[a] - moved, fills[b] + moved
        improved = True
        for x in (a, b):
            known[x] = _units(sizes, bins[x])
            if bins[x] and fills[x] < capacity:
                enter(x)
                heappush(waiting, (fills[x], x))
        alive -= not bins[a]
    return [b for b in bins if b]


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins for one block: full pieces alone, the others by best fit and local search."""
    full = [[i] for i, s in enumerate(sizes) if s >= capacity]
    rest = [i for i, s in enumerate(sizes) if s < capacity]
    small = [sizes[i] for i in rest]
    bins = local_search(small, best_fit(small, capacity), capacity)
    return full + [[rest[i] for i in b] for b in bins]


def _packer(capacity: int, handed: int, level: int, last: bool):
    """The function that packs one block, and marks the pieces that go on to the next round."""

    def one(key, table):
        sizes = table.column("length").to_pylist()
        bins = pack_block(sizes, capacity)
        fills = [sum(sizes[i] for i in b) for b in bins]
        again, some = set(), 0
        for k in [] if last else sorted(range(len(bins)), key=lambda k: fills[k]):
            if fills[k] == capacity or some + len(bins[k]) > handed:
                break
            again.add(k)
            some += len(bins[k])
        sequence, offset, marked = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i], marked[i] = (level << 56) + (key[0].as_py() << 24) + k, at, k in again
                at += sizes[i]
        out = table.drop_columns(["__block"])
        for name, values in (("sequence_id", sequence), ("offset", offset), ("__again", marked)):
            out = out.append_column(name, pa.array(values))
        return out

    return one


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, handed: int = HANDED) -> DataFrame:
    """Gives every row of ``pieces`` (with ``length`` up to ``capacity``) a sequence_id and an offset.

    Rows are dealt into blocks by their place in the staged table, so that copies and repeated rows spread;
    a task packs a block. The emptiest sequences of each block are opened again and meet those of other
    blocks in a next round, until one block is left: the number of rounds grows with the logarithm of the
    input. An empty table gives an empty result.
    """
    taken = ("sequence_id", "offset")
    left = common.stage(pieces.select(*[c for c in pieces.columns if c.lower() not in taken]), "pieces")
    columns, out, level = left.columns, None, 0
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema.fields] + [
        "sequence_id long",
        "offset long",
        "__again boolean",
    ])
    while True:
        rows = left.count()
        blocks = max(1, -(-rows // block))
        last = blocks == 1

        dealt = left.withColumn("__block", F.pmod(F.xxhash64(common.row_key()), F.lit(blocks)))
        packed = dealt.groupBy("__block").applyInArrow(_packer(capacity, handed, level, last), schema)
        if not last:
            packed = common.stage(packed, f"packed{level}")
        done = packed.filter("not __again").select(*columns, *taken)
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = packed.filter("__again").select(*columns)
        level += 1


def lower_bound(lengths: list[int], capacity: int = CAPACITY) -> int:
    """No packing needs fewer sequences: all tokens by capacity, or the pieces that can't share."""
    big = sorted(x for x in lengths if 2 * x > capacity)
    return max(-(-sum(lengths) // capacity), len(big) - bisect_left(big, capacity // 2 + 1))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cuts and packs documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut(docs, tokenizer=tokenizer, capacity=capacity), capacity)
