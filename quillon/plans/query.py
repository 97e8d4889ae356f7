"""The query language: text to a postfix list of items, and back.

Terms beside each other are joined by AND; &, | and ! (or -), the words and, or, not,
brackets, "phrases" and NEAR(a b, k) combine them; term*, term~k and /regex/ are
patterns. OR binds least, then AND, then NOT. A query without any token is empty and
matches nothing.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

VAL, NOT, AND, OR, PHRASE = "val", "not", "and", "or", "phrase"
PLAIN, PREFIX, FUZZY, REGEX = 0, 1, 2, 4
_SIGN = {AND: " & ", OR: " | ", PHRASE: " <-> "}
_OPERATOR = {AND: 1, OR: 2, NOT: 3, PHRASE: 4}
_PUNCTUATION = {"&": AND, "|": OR, "!": NOT, "-": NOT, "(": "(", ")": ")", ",": ",", '"': '"'}
_KEYWORDS = {"and": AND, "or": OR, "not": NOT, "near": "near"}
_WORD = re.compile("[A-Za-z0-9\x80-\U0010ffff]+")
_EDITS = re.compile("~([0-9]*)")


class QuerySyntaxError(ValueError):
    def __init__(self, text: str):
        super().__init__(f'syntax error in ftsquery: "{text}"')


def fold(text: str) -> str:
    """Lower case by single characters, as the analyzer's."""
    if text.isascii():
        return text.lower()
    return text.replace("İ", "i").replace("Σ", "σ").lower()  # the two whose lower case is longer, or hangs on what is around them


@dataclass(frozen=True)
class Item:
    """A value (a term or a pattern) or an operator. distance: edits of a fuzzy term, gap of a phrase."""

    kind: str
    term: str = ""
    flags: int = PLAIN
    distance: int = 0


@dataclass(frozen=True)
class Node:
    """The same as a tree."""

    item: Item
    parts: tuple[Node, ...] = ()


class _Parser:
    def __init__(self, text: str):
        self.text, self.items, self.tokens, self.seen = text, [], self.lex(text), []

    def lex(self, text: str) -> Iterator[tuple[str, Item | None]]:
        at = 0
        while at < len(text):
            word = _WORD.match(text, at)
            if not word:
                c, at = text[at], at + 1
                if c in _PUNCTUATION:
                    yield _PUNCTUATION[c], None
                elif c == "/":
                    end = text.find("/", at)
                    if end < 0:  # without its end it counts as the end of the query
                        return
                    yield VAL, Item(VAL, text[at:end], REGEX)
                    at = end + 1
                continue
            at, term = word.end(), fold(word[0])
            if term in _KEYWORDS:
                yield _KEYWORDS[term], None
            elif text[at : at + 1] == "*":
                at += 1
                yield VAL, Item(VAL, term, PREFIX)
            elif edits := _EDITS.match(text, at):
                at = edits.end()
                yield VAL, Item(VAL, term, FUZZY, max(int(edits[1]), 1) if edits[1] else 2)
            else:
                yield VAL, Item(VAL, term)

    def peek(self) -> str:
        if not self.seen:
            self.seen = [next(self.tokens, ("end", None))]
        return self.seen[0][0]

    def take(self) -> tuple[str, Item | None]:
        self.peek()
        return self.seen.pop()

    def need(self, ok: bool) -> None:
        if not ok:
            raise QuerySyntaxError(self.text)

    def parse(self) -> list[Item]:
        if self.peek() != "end":
            self.either()
            self.need(self.peek() == "end")
        return self.items

    def either(self) -> None:
        self.both()
        while self.peek() == OR:
            self.take()
            self.both()
            self.items.append(Item(OR))

    def both(self) -> None:
        self.unary()
        while (kind := self.peek()) in (AND, VAL, NOT, "(", '"', "near"):
            if kind == AND:
                self.take()
            self.unary()
            self.items.append(Item(AND))

    def unary(self) -> None:
        nots = 0
        while self.peek() == NOT:
            self.take()
            nots += 1
        self.primary()
        self.items += [Item(NOT)] * nots

    def member(self, item: Item) -> Item:
        return Item(VAL, item.term, item.flags & PREFIX)

    def primary(self) -> None:
        kind, item = self.take()
        if kind == "(":
            self.either()
            self.need(self.take()[0] == ")")
        elif kind == '"':
            many = 0
            while (got := self.take())[0] == VAL:
                self.items.append(self.member(got[1]))
                if many:
                    self.items.append(Item(PHRASE, distance=1))
                many += 1
            self.need(got[0] == '"' and many > 0)
        elif kind == "near":
            self.near()
        else:
            self.need(kind == VAL)
            self.items.append(item)

    def near(self) -> None:
        self.need(self.take()[0] == "(")
        many, gap = 0, 10
        while self.peek() not in (",", ")", "end"):
            kind, item = self.take()
            self.need(kind == VAL)
            self.items.append(self.member(item))
            many += 1
        end = self.take()[0]
        if end == ",":
            kind, item = self.take()
            self.need(kind == VAL and bool(re.fullmatch("[0-9]*", item.term)))
            gap, end = int(item.term or 0), self.take()[0]
        self.need(end == ")" and many > 1 and gap > 0)
        self.items += [Item(PHRASE, distance=gap)] * (many - 1)


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]

    @classmethod
    def parse(cls, text: str, normalize: Callable[[str], str | None] | None = None) -> Query:
        """normalize: what an analyzer makes of a plain term (None: it drops it, and the term stays as it is)."""
        items = _Parser(text).parse()
        if normalize:
            items = [replace(i, term=normalize(i.term) or i.term) if i.kind == VAL and not i.flags else i for i in items]
        return cls(tuple(items))

    def values(self) -> list[Item]:
        """Each value as often as it occurs, negated ones too."""
        return [i for i in self.items if i.kind == VAL]

    def literals(self) -> dict[str, int]:
        """Terms and how often they occur, patterns by their text: what scores count."""
        out: dict[str, int] = {}
        for i in self.values():
            out[i.term] = out.get(i.term, 0) + 1
        return out

    def tree(self) -> Node | None:
        stack: list[Node] = []
        for i in self.items:
            n = 0 if i.kind == VAL else 1 if i.kind == NOT else 2
            parts = tuple(stack[len(stack) - n :])
            del stack[len(stack) - n :]
            stack.append(Node(i, parts))
        return stack[0] if stack else None

    def fold(self, value: Callable, no: Callable, both: Callable, either: Callable, phrase: Callable):
        """The value of the query on a stack of whatever the functions make; None for the empty one."""
        stack: list = []
        for i in self.items:
            if i.kind == VAL:
                stack.append(value(i))
            elif i.kind == NOT:
                stack.append(no(stack.pop()))
            else:
                right, left = stack.pop(), stack.pop()
                stack.append(phrase(left, right, i.distance) if i.kind == PHRASE else both(left, right) if i.kind == AND else either(left, right))
        return stack[0] if stack else None

    def holds(self, present: Callable[[Item], bool]) -> bool:
        """Its truth where presence alone is known (phrases as AND)."""
        return bool(self.fold(present, lambda x: not x, lambda x, y: x and y, lambda x, y: x or y, lambda x, y, _: x and y))

    def __str__(self) -> str:
        def value(i: Item) -> str:
            if i.flags & REGEX:
                return f"/{i.term}/"
            return "'" + re.sub(r"(['\\])", r"\\\1", i.term) + "'" + ("*" if i.flags & PREFIX else f"~{i.distance}" if i.flags & FUZZY else "")

        join = lambda sign: lambda x, y, *_: f"({x}{sign}{y})"
        return self.fold(value, lambda x: "!" + x, join(_SIGN[AND]), join(_SIGN[OR]), join(_SIGN[PHRASE])) or ""

    def to_bytes(self) -> bytes:
        out = [struct.pack(">HI", 1, len(self.items))]
        for i in self.items:
            out.append(struct.pack(">BBHI", 1 if i.kind == VAL else 2, _OPERATOR.get(i.kind, 0), i.flags, i.distance))
            if i.kind == VAL:
                out.append(struct.pack(">I", len(i.term.encode())) + i.term.encode())
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Query:
        """The query of to_bytes(); ValueError for anything else."""
        kinds = {v: k for k, v in _OPERATOR.items()}
        try:
            version, many = struct.unpack_from(">HI", data)
            if version != 1 or many > len(data) // 8:
                raise ValueError("invalid ftsquery: version or number of items")
            at, items, depth = 6, [], 0
            for _ in range(many):
                kind, op, flags, distance = struct.unpack_from(">BBHI", data, at)
                at += 8
                if kind == 1:
                    (size,) = struct.unpack_from(">I", data, at)
                    term = data[at + 4 : at + 4 + size]
                    if len(term) != size:
                        raise ValueError("invalid ftsquery: it ends within a term")
                    items.append(Item(VAL, term.decode(), flags, distance))
                    at += 4 + size
                    depth += 1
                else:
                    items.append(Item(kinds[op], "", flags, distance))
                    depth -= kinds[op] != NOT
                    if depth < 1:
                        raise ValueError("invalid ftsquery: an operator lacks an operand")
        except (struct.error, KeyError, UnicodeDecodeError) as e:
            raise ValueError(f"invalid ftsquery: {e}") from e
        if at != len(data) or depth != (many > 0):
            raise ValueError("invalid ftsquery: operands are left over")
        return cls(tuple(items))

    @classmethod
    def from_tsquery(cls, text: str) -> Query:
        """From the text of a tsquery ('a' & !'b' <2> 'c':*A); <N> becomes a phrase step, prefixes and weights go."""
        lexed = re.findall(r"\s*(?:'((?:[^'\\]|''|\\.)*)'((?::[*A-Da-d]+)?)|([&|!()])|(<->|<\d+>)|([^\s&|!()<:']+)((?::[*A-Da-d]+)?))", text)
        tokens = [("val", re.sub(r"''|\\(.)", lambda m: m[1] or "'", q)) if not (op or gap or bare) else ("val", bare) if bare else (op or "gap", gap) for q, _, op, gap, bare, _ in lexed]
        items: list[Item] = []
        at = 0

        def peek() -> str:
            return tokens[at][0] if at < len(tokens) else "end"

        def climb(level: int) -> None:
            nonlocal at
            if level == 3:
                if peek() == "!":
                    at += 1
                    climb(3)
                    items.append(Item(NOT))
                elif peek() == "(":
                    at += 1
                    climb(0)
                    if peek() != ")":
                        raise QuerySyntaxError(text)
                    at += 1
                elif peek() == "val":
                    items.append(Item(VAL, tokens[at][1]))
                    at += 1
                else:
                    raise QuerySyntaxError(text)
                return
            climb(level + 1)
            while peek() == ("|", "&", "gap")[level]:
                gap = tokens[at][1]
                at += 1
                climb(level + 1)
                items.append(Item((OR, AND, PHRASE)[level], distance=(1 if gap == "<->" else int(gap[1:-1])) if level == 2 else 0))

        if tokens:
            climb(0)
            if at < len(tokens):
                raise QuerySyntaxError(text)
        return cls(tuple(items))


def as_query(query: str | Query) -> Query:
    return Query.parse(query) if isinstance(query, str) else query
