"""Patterns with RE2 meaning: parsed once on the driver, then said in Java's dialect and as pushable filters."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class PatternError(ValueError):
    """The pattern isn't RE2 syntax."""


@dataclass
class Node:
    """kind: lit, begin, end, atom, cat, alt, group, repeat. text: the literal, or Java's spelling of an atom."""

    kind: str
    text: str = ""
    fold: bool = False
    subs: list["Node"] = field(default_factory=list)
    least: int = 0
    most: int | None = None


WORD = "[0-9A-Za-z_]"
PERL = {"d": "0-9", "w": "0-9A-Za-z_", "s": r"\t\n\f\r\x20"}
POSIX = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t\x20",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": r"\x20-~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r\x20",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
CONTROLS = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}


def _char(c: int) -> str:
    return chr(c) if c < 128 and chr(c).isalnum() else f"\\x{{{c:X}}}"


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.flags = {"i": False, "m": False, "s": False, "U": False}

    def fail(self, why: str):
        raise PatternError(f"{why} at {self.i} in {self.p!r}")

    def more(self) -> bool:
        return self.i < len(self.p)

    def take(self, n: int = 1) -> str:
        if self.i + n > len(self.p):
            self.fail("unexpected end")
        self.i += n
        return self.p[self.i - n : self.i]

    def starts(self, s: str) -> bool:
        return self.p.startswith(s, self.i)

    def whole(self) -> Node:
        node = self.alternatives()
        if self.more():
            self.fail("unexpected )")
        return node

    def alternatives(self) -> Node:
        outer, branches = dict(self.flags), [self.sequence()]
        while self.starts("|"):
            self.take()
            branches.append(self.sequence())
        self.flags = outer
        return branches[0] if len(branches) == 1 else Node("alt", subs=branches)

    def sequence(self) -> Node:
        parts: list[Node] = []
        while self.more() and self.p[self.i] not in "|)":
            atom = self.atom()
            if atom is None:
                continue
            atom = self.repeated(atom)
            last = parts[-1] if parts else None
            if atom.kind == "lit" and last is not None and last.kind == "lit" and last.fold == atom.fold:
                last.text += atom.text
            else:
                parts.append(atom)
        return parts[0] if len(parts) == 1 else Node("cat", subs=parts)

    def repeated(self, atom: Node) -> Node:
        c = self.p[self.i] if self.more() else ""
        bounds = None
        if c and c in "*+?":
            self.take()
            bounds = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
        elif c == "{":
            bounds = self.counted()
        if bounds is None:
            return atom
        if self.starts("?"):
            self.take()  # lazy or greedy makes no difference to whether there is a match
        if self.more() and self.p[self.i] in "*+?":
            self.fail("nested repetition")
        at = self.i
        if self.starts("{") and self.counted() is not None:
            self.i = at
            self.fail("nested repetition")
        return Node("repeat", subs=[atom], least=bounds[0], most=bounds[1])

    def counted(self):
        end = self.p.find("}", self.i)
        low, comma, high = self.p[self.i + 1 : end].partition(",") if end > 0 else ("", "", "")
        if not (low.isascii() and low.isdigit()) or (high and not (high.isascii() and high.isdigit())):
            return None
        least = int(low)
        most = None if comma and not high else int(high or low)
        if least > 1000 or (most or 0) > 1000 or (most is not None and most < least):
            self.fail("bad repeat count")
        self.i = end + 1
        return least, most

    def literal(self, c: int) -> Node:
        return Node("lit", chr(c), fold=self.flags["i"])

    def atom(self) -> Node | None:
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.char_class()
        if c == ".":
            return Node("atom", r"(?s:.)" if self.flags["s"] else r"[^\n]")
        if c == "^":
            return Node("begin", r"(?:\A|(?<=\n))" if self.flags["m"] else r"\A")
        if c == "$":
            return Node("end", r"(?=\n|\z)" if self.flags["m"] else r"\z")
        if c in "*+?":
            self.fail("nothing to repeat")
        if c == "\\":
            return self.escape()
        return self.literal(ord(c))

    def group(self) -> Node | None:
        outer = dict(self.flags)
        if self.starts("?"):
            self.take()
            if self.starts("P<") or (self.starts("<") and not self.starts("<=") and not self.starts("<!")):
                self.take(2 if self.starts("P") else 1)
                name = ""
                while not self.starts(">"):
                    name += self.take()
                self.take()
                if not name or not all(x == "_" or x.isalnum() for x in name):
                    self.fail("bad group name")
            else:
                sign, seen = True, False
                while (c := self.take()) not in ":)":
                    if c == "-" and sign:
                        sign, seen = False, False
                    elif c in self.flags:
                        self.flags[c], seen = sign, True
                    else:
                        self.fail("unknown group")
                if not sign and not seen:
                    self.fail("missing flag")
                if c == ")":
                    return None  # flags hold to the end of the group around
        node = self.alternatives()
        if not self.starts(")"):
            self.fail("missing )")
        self.take()
        self.flags = outer
        return Node("group", subs=[node])

    def code(self, c: str) -> int | None:
        """The character of an escape, or None if it is no character."""
        if c in CONTROLS:
            return CONTROLS[c]
        if c == "x":
            if self.starts("{"):
                end = self.p.find("}", self.i)
                digits = self.p[self.i + 1 : end] if end > 0 else ""
                self.i = end + 1
            else:
                digits = self.take(2)
            try:
                value = int(digits, 16)
            except ValueError:
                self.fail("bad hex escape")
            if value > 0x10FFFF:
                self.fail("bad hex escape")
            return value
        if c in "01234567":
            if c != "0" and not (self.more() and self.p[self.i] in "01234567"):
                self.fail("backreference")
            digits = c
            while len(digits) < 3 and self.more() and self.p[self.i] in "01234567":
                digits += self.take()
            return int(digits, 8)
        if ord(c) < 128 and not c.isalnum():
            return ord(c)
        return None

    def unicode_class(self, negated: bool) -> str:
        name = self.take()
        if name == "{":
            name = ""
            while not self.starts("}"):
                name += self.take()
            self.take()
        if name.startswith("^"):
            name, negated = name[1:], not negated
        if name == "Any":
            return r"\x{0}-\x{10FFFF}" if not negated else self.fail("empty class")
        if not name or not name.replace("_", "").isalpha():
            self.fail("bad class name")
        return ("\\P{" if negated else "\\p{") + (name if len(name) <= 2 else "Is" + name) + "}"

    def set(self, c: str) -> str | None:
        """The inside of a class for an escape that names a set of characters."""
        if c in "dws":
            return PERL[c]
        if c in "DWS":
            return f"[^{PERL[c.lower()]}]"
        if c in "pP":
            return self.unicode_class(c == "P")
        return None

    def folded(self, text: str) -> str:
        return f"(?iu:{text})" if self.flags["i"] else text

    def escape(self) -> Node:
        c = self.take()
        if c == "A":
            return Node("begin", r"\A")
        if c == "z":
            return Node("atom", r"\z")
        if c in "bB":
            edge = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
            return Node("atom", edge if c == "b" else f"(?!{edge})")
        if c == "Q":
            end = self.p.find("\\E", self.i)
            text = self.p[self.i : end] if end >= 0 else self.p[self.i :]
            self.i = end + 2 if end >= 0 else len(self.p)
            return Node("lit", text, fold=self.flags["i"]) if text else Node("cat")
        if (inside := self.set(c)) is not None:
            return Node("atom", self.folded(f"[{inside}]"))
        if (value := self.code(c)) is not None:
            return self.literal(value)
        self.fail(f"unknown escape \\{c}")

    def char_class(self) -> Node:
        negated = self.starts("^")
        if negated:
            self.take()
        items, singles, first = [], [], True
        while first or not self.starts("]"):
            first = False
            if self.starts("[:") and (end := self.p.find(":]", self.i)) > 0:
                name = self.p[self.i + 2 : end]
                inside = POSIX.get(name.removeprefix("^"))
                if inside is None:
                    self.fail("unknown class")
                items.append(f"[^{inside}]" if name.startswith("^") else inside)
                self.i = end + 2
                continue
            low = self.member(items)
            if low is None:
                continue
            high = low
            if self.starts("-") and not self.starts("-]"):
                self.take()
                high = self.member(None)
                if high is None or high < low:
                    self.fail("bad range")
            if low == high:
                singles.append(low)
            items.append(_char(low) if low == high else f"{_char(low)}-{_char(high)}")
        self.take()
        if len(items) == 1 and len(singles) == 1 and not negated:
            return self.literal(singles[0])
        inside = self.folded(f"[{''.join(items)}]")
        return Node("atom", f"(?!{inside})(?s:.)" if negated else inside)

    def member(self, items: list | None) -> int | None:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if (inside := self.set(c)) is not None:
            if items is None:
                self.fail("bad range")
            items.append(inside)
            return None
        if (value := self.code(c)) is None:
            self.fail(f"unknown escape \\{c}")
        return value


def parse(pattern: str) -> Node:
    return _Parser(pattern).whole()


def _java(n: Node) -> str:
    if n.kind == "lit":
        text = "".join(_char(ord(c)) for c in n.text)
        return f"(?iu:{text})" if n.fold else text
    if n.kind in ("begin", "end", "atom"):
        return n.text
    if n.kind == "cat":
        return "".join(_java(s) for s in n.subs)
    if n.kind == "alt":
        return "(?:" + "|".join(_java(s) for s in n.subs) + ")"
    if n.kind == "group":
        return f"(?:{_java(n.subs[0])})"
    bounds = f"{{{n.least},{'' if n.most is None else n.most}}}"
    return f"(?:{_java(n.subs[0])}){bounds}"


def to_java(pattern: str) -> str:
    """A Java pattern that finds a match in just the texts in which RE2 finds one of ``pattern``."""
    return _java(parse(pattern))


def name_prefix(pattern: str) -> str:
    """The literal that stands behind a leading ``^``, which every match in a name then starts with; else ""."""
    try:
        node = parse(pattern)
    except PatternError:
        return ""
    if node.kind != "cat" or len(node.subs) < 2 or node.subs[0].kind != "begin":
        return ""
    second = node.subs[1]
    return second.text if second.kind == "lit" and not second.fold else ""


def required_literals(pattern: str, least_bytes: int = 2) -> list[str]:
    """Literals of at least two bytes that every match holds. Alternatives and folded literals give none."""
    try:
        node = parse(pattern)
    except PatternError:
        return []

    def walk(n: Node) -> list[str]:
        if n.kind == "lit":
            return [n.text] if not n.fold and len(n.text.encode()) >= least_bytes else []
        if n.kind in ("cat", "group") or (n.kind == "repeat" and n.least >= 1):
            return [x for s in n.subs for x in walk(s)]
        return []

    return walk(node)


def upper_bound(prefix: bytes) -> bytes | None:
    """The smallest bytes above all that start with ``prefix``; None if there are none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def matches(name: Column, pattern: str) -> Column:
    """Pushable filters that every match passes, and then the pattern itself."""
    filters = []
    if prefix := name_prefix(pattern):
        filters.append(name.startswith(prefix))
    filters += [name.contains(x) for x in dict.fromkeys(required_literals(pattern)) if x != prefix]
    plain = parse(pattern)
    exact = plain.kind == "cat" and [s.kind for s in plain.subs] == [
        "begin",
        "lit",
        "end",
    ] and plain.subs[2].text == r"\z" and plain.subs[0].text == r"\A" and not plain.subs[1].fold
    filters.append(name == prefix if exact else name.rlike(to_java(pattern)))
    return reduce(lambda a, b: a & b, filters)


def explain(pattern: str) -> str:
    """How a search with the pattern reads the index."""
    if prefix := name_prefix(pattern):
        return f"name range, prefix {prefix!r}"
    if literals := required_literals(pattern):
        return "full name scan, names must hold " + ", ".join(map(repr, literals))
    return "full name scan"
