"""A compiler for chat templates: a small sandboxed language to Python closures.

Source text holds ``{{ expression }}``, ``{% statement %}`` and ``{# comment #}``;
a dash inside a bracket (``{%-``, ``-%}``) trims the white space beside it.
Statements are ``for x in e``, ``if``/``elif``/``else``, ``set x = e`` and
``generation`` (what it renders is what a model is trained on).  Expressions have
strings, whole numbers, true, false, none, names, ``e.key``, ``e[e]``, ``+``
(numbers or text), ``~`` (text), ``%``, comparisons, ``in``, ``is defined``,
``and``/``or``/``not``, a conditional and ``e | filter(arguments)``.

The steps are those of a compiler: the source is cut into tokens, parsed into a
tree of tuples, constants are folded (constant expressions, branches that cannot
be taken, neighbouring text), and every node becomes one closure.

Sandbox: a template reaches only the values it is given - keys of mappings,
places of lists, the filters of ``FILTERS`` - never attributes, calls or
imports.  Loops run over given lists only, so every rendering ends; a rendering
that writes more than its limit of characters stops with an error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

_TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign>==|!=|<=|>=|[<>+~%.,|()\[\]=]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "is", "if", "else", "defined"}
MOST_DEPTH = 60


class TemplateError(ValueError):
    """A template that cannot be parsed, or a rendering that must not go on."""


class _Missing:
    """The value of a name or key that is not there: empty text, false."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""


MISSING = _Missing()


def text_of(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None or value is MISSING:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    raise TemplateError(f"{type(value).__name__} is no text")


def _size(value: Any) -> int:
    if isinstance(value, (str, list, tuple, Mapping)):
        return len(value)
    raise TemplateError("length of something without one")


#: Filters every template may use; ``escape`` is added for its control strings.
FILTERS: dict[str, Callable] = {
    "trim": lambda v: text_of(v).strip(), "upper": lambda v: text_of(v).upper(), "lower": lambda v: text_of(v).lower(), "string": text_of,
    "length": _size, "replace": lambda v, a, b: text_of(v).replace(text_of(a), text_of(b)), "default": lambda v, d: d if v is MISSING or v is None else v,
}


class Escaper:
    """Breaks control strings inside a text so that they can be put together
    again: a backslash is doubled, and one goes behind the first character of
    every control string.  Read back, a backslash gives way to what follows it."""

    def __init__(self, controls: Iterable[str]):
        self.controls = sorted(set(controls))
        if any(len(c) < 2 or "\\" in c for c in self.controls):
            raise TemplateError("a control string has two characters or more and no backslash")
        found = "|".join(map(re.escape, self.controls))
        self._starts = re.compile(f"(?=(?:{found}))(.)", re.DOTALL) if found else None

    def escape(self, text: Any) -> str:
        text = text_of(text).replace("\\", "\\\\")
        return self._starts.sub(r"\1\\", text) if self._starts else text

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class _Parser:
    """Statements and expressions of a template as a tree of tuples."""

    def __init__(self, source: str):
        self.parts = self._cut(source)
        self.at = self.depth = 0
        self.words: list[tuple[str, str]] = []

    @staticmethod
    def _cut(source: str) -> list[tuple[str, str]]:
        parts, trim = [], False
        pieces = _TAGS.split(source)
        for i, piece in enumerate(pieces):
            if i % 2 == 0:
                piece = piece.lstrip() if trim else piece
                if i + 1 < len(pieces) and pieces[i + 1][2:3] == "-":
                    piece = piece.rstrip()
                if re.search(r"\{[{%#]", piece):
                    raise TemplateError(f"a tag that never ends: {piece[:40]!r}")
                parts.append(("text", piece))
            else:
                trim = piece[-3:-2] == "-" and piece[1] != "#"
                if piece[1] != "#":
                    parts.append(("show" if piece[1] == "{" else "do", piece[2:-2].removeprefix("-").removesuffix("-").strip()))
        return parts

    def parse(self) -> tuple:
        tree = self._body(())
        if self.at < len(self.parts):
            raise TemplateError(f"{self.parts[self.at][1]!r} without a beginning")
        return tree

    def _body(self, ends: tuple[str, ...]) -> tuple:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        out = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            word = text.split(None, 1)[0] if text.strip() else ""
            if kind == "do" and word in ends:
                break
            self.at += 1
            if kind == "text":
                out.append(("text", text))
            elif kind == "show":
                out.append(("show", self._whole(text)))
            else:
                out.append(self._statement(word, text[len(word) :]))
        else:
            if ends:
                raise TemplateError(f"{ends[-1]} is missing")
        self.depth -= 1
        return ("block", tuple(out))

    def _end(self) -> tuple[str, str]:
        text = self.parts[self.at][1]
        self.at += 1
        word = text.split(None, 1)[0]
        return word, text[len(word) :]

    def _statement(self, word: str, rest: str) -> tuple:
        if word == "generation" and not rest.strip():
            body = self._body(("endgeneration",))
            self._end()
            return ("generation", body)
        if word == "set" and (found := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.*)", rest, re.DOTALL)):
            return ("set", self._name(found[1]), self._whole(found[2]))
        if word == "for" and (found := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.DOTALL)):
            over, body = self._whole(found[2]), self._body(("endfor",))
            self._end()
            return ("for", self._name(found[1]), over, body)
        if word == "if":
            branches, test, other = [], self._whole(rest), ("block", ())
            while True:
                body = self._body(("elif", "else", "endif"))
                if test is not None:
                    branches.append((test, body))
                else:
                    other = body
                word, rest = self._end()
                if word == "endif":
                    return ("if", tuple(branches), other)
                if test is None:
                    raise TemplateError(f"{word} after else")
                test = self._whole(rest) if word == "elif" else None
        raise TemplateError(f"no statement: {word}{rest}")

    @staticmethod
    def _name(name: str) -> str:
        if name in _RESERVED or name in _WORDS or name == "loop":
            raise TemplateError(f"{name} is no name for a value")
        return name

    # expressions
    def _whole(self, text: str) -> tuple:
        self.words, at, text = [], 0, text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise TemplateError(f"not understood: {text[at:]!r}")
            self.words.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.words.reverse()
        tree = self._choice()
        if self.words:
            raise TemplateError(f"not understood: {self.words[-1][1]!r} in {text!r}")
        return tree

    def _next(self, *expected: str) -> bool:
        if self.words and self.words[-1][0] in ("sign", "name") and self.words[-1][1] in expected:
            self.words.pop()
            return True
        return False

    def _must(self, sign: str) -> None:
        if not self._next(sign):
            raise TemplateError(f"{sign!r} is missing")

    def _choice(self) -> tuple:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise TemplateError("nested too deeply")
        tree = self._or()
        if self._next("if"):
            test = self._or()
            tree = ("choose", test, tree, self._choice() if self._next("else") else ("value", MISSING))
        self.depth -= 1
        return tree

    def _or(self) -> tuple:
        tree = self._and()
        while self._next("or"):
            tree = ("or", tree, self._and())
        return tree

    def _and(self) -> tuple:
        tree = self._not()
        while self._next("and"):
            tree = ("and", tree, self._not())
        return tree

    def _not(self) -> tuple:
        turned = False
        while self._next("not"):
            turned = not turned
        tree = self._compared()
        return ("not", tree) if turned else tree

    def _compared(self) -> tuple:
        left = self._sum()
        for sign in ("==", "!=", "<=", ">=", "<", ">", "in"):
            if self._next(sign):
                return (sign, left, self._sum())
        if self._next("not"):
            self._must("in")
            return ("not", ("in", left, self._sum()))
        if self._next("is"):
            turned = self._next("not")
            self._must("defined")
            return ("not", ("defined", left)) if turned else ("defined", left)
        return left

    def _sum(self) -> tuple:
        tree = self._filtered()
        while self.words and self.words[-1] in (("sign", "+"), ("sign", "~"), ("sign", "%")):
            sign = self.words.pop()[1]
            tree = (sign, tree, self._filtered())
        return tree

    def _filtered(self) -> tuple:
        tree = self._place()
        while self._next("|"):
            kind, name = self.words.pop() if self.words else ("", "")
            if kind != "name":
                raise TemplateError("a filter has a name")
            arguments = []
            if self._next("("):
                while not self._next(")"):
                    arguments.append(self._choice())
                    if not self._next(","):
                        self._must(")")
                        break
            tree = ("filter", name, tree, *arguments)
        return tree

    def _place(self) -> tuple:
        tree = self._atom()
        while True:
            if self._next("."):
                kind, name = self.words.pop() if self.words else ("", "")
                if kind != "name":
                    raise TemplateError("a key is a name")
                tree = ("key", tree, ("value", name))
            elif self._next("["):
                tree = ("key", tree, self._choice())
                self._must("]")
            else:
                return tree

    def _atom(self) -> tuple:
        if not self.words:
            raise TemplateError("an expression ends too early")
        kind, word = self.words.pop()
        if kind == "text":
            return ("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.DOTALL))
        if kind == "number":
            return ("value", int(word))
        if kind == "name" and word in _WORDS:
            return ("value", _WORDS[word])
        if kind == "name" and word not in _RESERVED:
            return ("name", word)
        if word == "(":
            tree = self._choice()
            self._must(")")
            return tree
        raise TemplateError(f"not understood: {word!r}")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, int) and isinstance(b, int) and not isinstance(a, bool) and not isinstance(b, bool):
        return a + b
    return text_of(a) + text_of(b)


def _rest(a: Any, b: Any) -> int:
    if not (isinstance(a, int) and isinstance(b, int)) or b == 0:
        raise TemplateError("% takes whole numbers and no zero")
    return a % b


def _order(test: Callable) -> Callable:
    def compare(a: Any, b: Any) -> bool:
        if isinstance(a, str) is not isinstance(b, str) or not isinstance(a, (int, str)) or not isinstance(b, (int, str)):
            raise TemplateError("only numbers or texts are ordered")
        return test(a, b)

    return compare


def _inside(a: Any, b: Any) -> bool:
    if isinstance(b, str):
        return text_of(a) in b
    if isinstance(b, (list, tuple, Mapping)):
        return a in b
    raise TemplateError("in takes a text, a list or a mapping")


def _key(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key, MISSING)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else MISSING
    if value is MISSING or isinstance(value, (list, tuple, str)):
        return MISSING
    raise TemplateError(f"{type(value).__name__} has no keys")


_TWO: dict[str, Callable[[Any, Any], Any]] = {
    "+": _plus, "~": lambda a, b: text_of(a) + text_of(b), "%": _rest, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": _order(lambda a, b: a < b), ">": _order(lambda a, b: a > b), "<=": _order(lambda a, b: a <= b), ">=": _order(lambda a, b: a >= b),
    "in": _inside, "key": _key,
}


def _shown(tree: tuple) -> list[tuple]:
    """Statements that show an expression: the parts of a joined text on their own."""
    if tree[0] == "~":
        return _shown(tree[1]) + _shown(tree[2])
    return [("text", text_of(tree[1])) if tree[0] == "value" else ("show", tree)]


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The tree with constant parts computed: expressions, branches, joined text."""
    kind = tree[0]
    if kind == "block":
        out: list[tuple] = []
        for part in tree[1]:
            part = fold(part, filters)
            for one in part[1] if part[0] == "block" else _shown(part[1]) if part[0] == "show" else [part]:
                if one[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + one[1])
                elif one != ("text", ""):
                    out.append(one)
        return ("block", tuple(out))
    if kind in ("text", "value", "name"):
        return tree
    if kind == "if":
        branches, other = [], fold(tree[2], filters)
        for test, body in tree[1]:
            test = fold(test, filters)
            if test[0] == "value" and not test[1]:
                continue
            if test[0] == "value":
                other = fold(body, filters)
                break
            branches.append((test, fold(body, filters)))
        return ("if", tuple(branches), other) if branches else other
    if kind in ("for", "set"):
        return (*tree[:2], *(fold(t, filters) for t in tree[2:]))
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"no filter {tree[1]!r}")
        parts = [fold(t, filters) for t in tree[2:]]
        if all(p[0] == "value" for p in parts):
            return ("value", filters[tree[1]](*(p[1] for p in parts)))
        return ("filter", tree[1], *parts)
    parts = [fold(t, filters) for t in tree[1:]]
    if kind in ("show", "generation"):
        return (kind, *parts)
    first = parts[0]
    if kind in ("and", "or") and first[0] == "value":
        return parts[1] if bool(first[1]) == (kind == "and") else first
    if kind == "choose" and first[0] == "value":
        return parts[1] if first[1] else parts[2]
    if all(p[0] == "value" for p in parts):
        if kind in _TWO:
            return ("value", _TWO[kind](parts[0][1], parts[1][1]))
        if kind == "not":
            return ("value", not first[1])
        if kind == "defined":
            return ("value", first[1] is not MISSING)
    return (kind, *parts)


class _Run:
    """What one rendering has written, and where generations lie."""

    __slots__ = ("values", "out", "size", "most", "starts", "ends", "inside")

    def __init__(self, values: dict[str, Any], most: int):
        self.values, self.most = values, most
        self.out: list[str] = []
        self.size = 0
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.inside = False

    def write(self, text: str) -> None:
        self.size += len(text)
        if self.size > self.most:
            raise TemplateError(f"more than {self.most} characters")
        self.out.append(text)

    def take(self) -> tuple[str, list[int], list[int]]:
        """What was written since the last call, spans counted from the start."""
        done = "".join(self.out), self.starts, self.ends
        self.out, self.starts, self.ends = [], [], []
        return done


def _value(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure for an expression."""
    kind = tree[0]
    if kind == "value":
        return lambda values, constant=tree[1]: constant
    if kind == "name":
        return lambda values, name=tree[1]: values.get(name, MISSING)
    if kind == "filter":
        call, inner = filters[tree[1]], [_value(t, filters) for t in tree[2:]]
        if len(inner) == 1:
            return lambda values, one=inner[0]: call(one(values))
        return lambda values: call(*(f(values) for f in inner))
    parts = [_value(t, filters) for t in tree[1:]]
    if kind == "and":
        return lambda values: parts[0](values) and parts[1](values)
    if kind == "or":
        return lambda values: parts[0](values) or parts[1](values)
    if kind == "not":
        return lambda values: not parts[0](values)
    if kind == "defined":
        return lambda values: parts[0](values) is not MISSING
    if kind == "choose":
        return lambda values: parts[1](values) if parts[0](values) else parts[2](values)
    call = _TWO[kind]
    return lambda values, a=parts[0], b=parts[1]: call(a(values), b(values))


def with_last(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    """Items with whether they are the last; one is read ahead."""
    items = iter(items)
    for ahead in items:
        break
    else:
        return
    for item in items:
        yield ahead, False
        ahead = item
    yield ahead, True


Step = Callable[[_Run], Iterator[None]]


def _steps(tree: tuple, filters: Mapping[str, Callable], loops: int = 0) -> Step:
    """A closure for a statement; it stops after each turn of an outermost loop,
    so that what was written can be taken before the next turn is read."""
    kind = tree[0]
    if kind == "text":

        def text(run: _Run, constant=tree[1]) -> Iterator[None]:
            run.write(constant)
            return iter(())

        return text
    if kind == "show":
        shown = _value(tree[1], filters)

        def show(run: _Run) -> Iterator[None]:
            run.write(text_of(shown(run.values)))
            return iter(())

        return show
    if kind == "set":
        result = _value(tree[2], filters)

        def put(run: _Run, name=tree[1]) -> Iterator[None]:
            run.values[name] = result(run.values)
            return iter(())

        return put
    if kind == "generation":
        inner = _steps(tree[1], filters, loops + 1)

        def generation(run: _Run) -> Iterator[None]:
            if run.inside:
                raise TemplateError("a generation inside another one")
            run.inside = True
            start = run.size
            for _ in inner(run):
                pass
            run.starts.append(start)
            run.ends.append(run.size)
            run.inside = False
            return iter(())

        return generation
    if kind == "block":
        steps = [_steps(t, filters, loops) for t in tree[1]]

        def block(run: _Run) -> Iterator[None]:
            for step in steps:
                yield from step(run)

        return block
    if kind == "if":
        branches = [(_value(t, filters), _steps(b, filters, loops)) for t, b in tree[1]]
        other = _steps(tree[2], filters, loops)

        def choose(run: _Run) -> Iterator[None]:
            for test, body in branches:
                if test(run.values):
                    return body(run)
            return other(run)

        return choose
    assert kind == "for"
    over, turn = _value(tree[2], filters), _steps(tree[3], filters, loops + 1)

    def loop(run: _Run, name=tree[1]) -> Iterator[None]:
        items = over(run.values)
        if isinstance(items, (str, Mapping)) or not isinstance(items, Iterable):
            raise TemplateError("a loop runs over a list")
        kept = {n: run.values[n] for n in (name, "loop") if n in run.values}
        for i, (item, last) in enumerate(with_last(items)):
            run.values[name] = item
            run.values["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": last}
            for _ in turn(run):
                pass
            if loops == 0:
                yield
        for n in (name, "loop"):
            run.values.pop(n, None)
        run.values.update(kept)

    return loop


class Template:
    """A compiled template; ``filters`` come beside ``FILTERS``."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None, most_characters: int = 1 << 40):
        self.filters = {**FILTERS, **(filters or {})}
        self.tree = fold(_Parser(source).parse(), self.filters)
        self.most = most_characters
        self._run = _steps(self.tree, self.filters)

    def pieces(self, **values: Any) -> Iterator[tuple[str, list[int], list[int]]]:
        """What is rendered, piece by piece: after each turn of an outermost loop
        and at the end.  Spans of generations count from the start of it all.
        A list may be an iterator: items are read as their turn comes."""
        run = _Run(dict(values), self.most)
        for _ in self._run(run):
            yield run.take()
        yield run.take()

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the spans of its generations, in code points."""
        text, spans = [], []
        for part, starts, ends in self.pieces(**values):
            text.append(part)
            spans += zip(starts, ends)
        return "".join(text), spans
