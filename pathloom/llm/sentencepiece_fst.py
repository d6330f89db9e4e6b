"""SentencePiece encoding and decoding by a weighted finite-state transducer."""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

SPACE = "▁"
#: Runs whose ids a worker remembers, in two generations, and their longest length.
REMEMBERED = 1_500_000
LONGEST_REMEMBERED = 64
#: Runs that are looked up before it is seen how many are remembered.
AT_ONCE = 100_000
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
FALLBACK = -1
INFINITE = float("inf")
#: Characters of a beginning whose distances are remembered.
HEAD = 5
_LOADED: dict[str, "Transducer"] = {}


class Memory(dict):
    """Values of texts, found once; those of the generation before are taken over when they are asked for."""

    def __init__(self, find, before: dict):
        super().__init__()
        self.find, self.before = find, before

    def __missing__(self, text: str) -> bytes:
        found = self.before.get(text)
        if found is None:
            found = self.find(text)
        if len(text) <= LONGEST_REMEMBERED:
            self[text] = found
        return found

    def aged(self) -> "Memory":
        """This memory, or an empty one after it where it is full."""
        if len(self) < REMEMBERED // 2:
            return self
        self.before = {}
        return Memory(self.find, self)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Normaliser:
    """The first transducer: rewrites text by rules, the longest that starts at a place, and copies the rest.

    Its states are the nodes of a trie of the rules' left sides: an arc reads a character, and the arc that ends a rule writes its
    right side. From the start state every other character has an arc that copies it. ``before`` is written on an
    arc that reads nothing, ahead of any text that isn't empty.
    """

    def __init__(self, rules: dict[str, str], before: str = ""):
        self.before = before
        self.arcs: list[dict[str, int]] = [{}]
        self.writes: dict[int, str] = {}
        for left, right in rules.items():
            state = 0
            for c in left:
                if c not in self.arcs[state]:
                    self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                state = self.arcs[state][c]
            self.writes[state] = right
        #: where each rule reads a character that none writes, the machine has one state, and the order of rules makes no difference
        self.simple = rules if all(len(x) == 1 and x not in y for x in rules for y in rules.values()) else None

    def compose(self, text: str) -> str:
        """The only path of the composition with a text, as what it writes."""
        if not text:
            return ""
        if self.simple is not None:
            for left, right in self.simple.items():
                text = text.replace(left, right)
            return self.before + text
        out, i = [self.before], 0
        while i < len(text):
            state, j, end, write = 0, i, i + 1, text[i]
            while j < len(text) and (state := self.arcs[state].get(text[j])) is not None:
                j += 1
                if state in self.writes:
                    end, write = j, self.writes[state]
            out.append(write)
            i = end
        return "".join(out)


class Lexicon:
    """The second transducer: pieces and byte fallback, with weights.

    States are the nodes of a trie of the pieces, read from their ends: an arc reads a character and leads to the node under it. From
    a node that a whole piece leads to, an arc that reads nothing writes the piece's id and leads back to the
    start with the piece's weight. A node is (arcs, (id, weight) or None). A character that is no piece has an
    arc from the start to itself that writes its byte ids, heavier than any piece.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: dict[int, int]):
        self.byte_ids = byte_ids
        self.heavy = 1.0 + max((w for _, w in pieces.values()), default=0.0)
        self.alone = {p for p in pieces if len(p) == 1}
        tree: dict = {}
        for piece, end in pieces.items():
            state = tree
            for c in reversed(piece):
                state = state.setdefault(c, {})
            state[""] = end
        self.start = self._node(tree)[0]

    def _node(self, tree: dict) -> tuple[dict, tuple | None]:
        return {c: self._node(t) for c, t in tree.items() if c}, tree.get("")


class Neighbours:
    """The third machine: an acceptor of id sequences whose state is the last id.

    An arc a to b has weight 0 (one, in the tropical semiring) if a BPE merge of both texts gives just the two pieces, and
    infinity (zero) if not. Arcs are found as they are asked for, and remembered.
    """

    def __init__(self, names: list[str], rank: dict[str, int]):
        self.names, self.rank = names, rank
        self.arcs: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE's own merges of a string of at most two pieces' length, which decide what may stand side by side."""
        rank, none = self.rank.get, len(self.rank)
        parts = list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
        return parts

    def find(self, code: int) -> bool:
        if len(self.arcs) > REMEMBERED:
            self.arcs.clear()
        a, b = divmod(code, len(self.names))
        one, two = self.names[a], self.names[b]
        ok = self.arcs[code] = self.merge(one + two) == [one, two]
        return ok


class Transducer:
    """A BPE model with byte fallback, compiled to weighted machines: Normaliser, Lexicon and Neighbours.

    A text is a linear acceptor; its composition with the machines is built as far as the search goes. A state of it is a place in
    the normalised text and the last piece. In the tropical semiring weights add along a path and the least
    sum wins; a piece weighs its merge rank. The acceptor of neighbours says in weights what BPE's merges say in order: a
    piece sequence is BPE's encoding exactly if each two neighbours in it, taken alone, would be encoded as
    these two, as BPE's first merge over a border would show in the pieces beside it. So the shortest path is
    BPE's encoding. Decoding goes through the inverse machines: ids to bytes, and marks to spaces.
    """

    def __init__(self, path: str, rules: dict[str, str] | None = None):
        """``rules`` are rewriting rules of the normaliser beside the model's own, from text to text."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        if spec.trainer_spec.model_type != 2 or spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models are compiled whose normaliser has no binary map and keeps white space")
        self.prefix = spec.normalizer_spec.add_dummy_prefix
        self.normaliser = Normaliser({" ": SPACE} | (rules or {}), SPACE if self.prefix else "")
        ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == NORMAL}
        rank = {p: k for k, p in enumerate(sorted(ids, key=lambda p: (-spec.pieces[ids[p]].score, ids[p])))}
        self.names = [p.piece for p in spec.pieces]
        self.neighbours = Neighbours(self.names, rank)
        byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == BYTE}
        # a piece that BPE doesn't give for its own text is on no path
        own = {p: (ids[p], float(k)) for p, k in rank.items() if self.neighbours.merge(p) == [p]}
        self.lexicon = Lexicon(own, byte_ids)
        self.heads: dict[str, tuple] = {}
        inner = any(SPACE in p.lstrip(SPACE) for p in rank)
        #: pieces have space marks only in front, so no piece crosses the border before a run of marks
        self.runs = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: the inverse of the lexicon and of the space rule: what each id stands for
        self.raw = [self._raw(p) for p in spec.pieces]
        self.known = Memory(self._ids, {})

    @classmethod
    def of(cls, path: str) -> "Transducer":
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    @staticmethod
    def _raw(p) -> bytes:
        if p.type == BYTE:
            return bytes([int(p.piece[1:-1], 16)])
        return p.piece.replace(SPACE, " ").encode() if p.type in (NORMAL, USER) else b""

    def _distances(self, text: str, total: list, last: list, before: list) -> None:
        """Goes on with the shortest distances to the places of a text: their sums, last ids, and the places before those.

        All arcs lead to later places, so the places' order is topological: a place's least sum is the least over
        the arcs that enter it. A place is reached in one state only, as its last piece is that of BPE's encoding of the
        text up to there; so a number for each place holds the state.
        """
        size, start, alone, heavy = len(self.names), self.lexicon.start, self.lexicon.alone, self.lexicon.heavy
        arcs, find = self.neighbours.arcs, self.neighbours.find
        for j in range(len(total), len(text) + 1):
            least, piece, place, state = INFINITE, FALLBACK, 0, start
            for i in range(j - 1, -1, -1):
                node = state.get(text[i])
                if node is None:
                    break
                state, end = node
                if end is None or total[i] + end[1] >= least:
                    continue
                if last[i] >= 0:
                    code = last[i] * size + end[0]
                    ok = arcs.get(code)
                    if not (find(code) if ok is None else ok):
                        continue
                least, piece, place = total[i] + end[1], end[0], i
            if text[j - 1] not in alone and total[j - 1] + heavy < least:
                least, piece, place = total[j - 1] + heavy, FALLBACK, j - 1
            total.append(least)
            last.append(piece)
            before.append(place)

    def shortest(self, text: str) -> tuple[list[int], float]:
        """Ids and weight of the least path of the composition with a normalised text. Distances over common beginnings of texts are found once."""
        head = self.heads.get(text[:HEAD])
        if head is None:
            head = ([0.0], [FALLBACK], [0])
            self._distances(text[:HEAD], *head)
            if len(self.heads) > REMEMBERED // 4:
                self.heads.clear()
            self.heads[text[:HEAD]] = head
        if len(text) > HEAD:
            head = tuple(x.copy() for x in head)
            self._distances(text, *head)
        total, last, before = head
        ids, j = [], len(text)
        while j:
            if last[j] >= 0:
                ids.append(last[j])
            else:
                some = text[before[j] : j].encode("utf-8", "surrogatepass")
                ids += [self.lexicon.byte_ids[b] for b in reversed(some)]
            j = before[j]
        ids.reverse()
        return ids, total[-1]

    def _ids(self, text: str) -> bytes:
        ids = array("I", self.shortest(text)[0])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        whole = self.normaliser.compose(text or "")
        runs = self.runs.findall(whole) if self.runs else [whole] if whole else []
        out = []
        for k in range(0, len(runs), AT_ONCE):
            out.append(b"".join(map(self.known.__getitem__, runs[k : k + AT_ONCE])))
            self.known = self.known.aged()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes of byte pieces go together, unknown and control ids stand for nothing, the mark in front goes."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


FIELDS = [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("restored", T.BooleanType())]


def with_ids(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """Adds ``ids``, a binary column of little-endian 32-bit ids of the whole text.

    A null text has null ids, an empty one no ids. Equal rows get equal ids. A column ``ids`` is replaced; an empty table stays empty.
    """
    path = model or default_model()

    def task():
        fst = Transducer.of(path)
        return lambda texts: [[None if t is None else fst.encode(t) for t in texts]]

    return common.extend(docs, [("ids", T.BinaryType())], [text_col], task)


def with_text(docs: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of a binary column of ids; null for null."""
    path = model or default_model()

    def task():
        fst = Transducer.of(path)
        return lambda rows: [[None if x is None else fst.decode(x) for x in rows]]

    return common.extend(docs, [("decoded", T.StringType())], [ids_col], task)


def with_digest(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """Adds n_ids, ids_crc32 and restored (decoding gives the text back; a text's own space marks come back as spaces).

    A null text counts as empty: no ids. Columns that clash are replaced; an empty table gives an empty result.
    """
    path = model or default_model()

    def task():
        fst = Transducer.of(path)

        def call(texts):
            known: dict = {}
            for t in texts:
                if t not in known:
                    ids = fst.encode(t)
                    known[t] = (len(ids) // 4, common.unsigned_crc(ids), fst.decode(ids) == (t or "").replace(SPACE, " "))
            return [list(x) for x in zip(*[known[t] for t in texts], strict=True)]

        return call

    return common.extend(docs, FIELDS, [text_col], task)
