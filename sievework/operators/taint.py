"""Rules for JavaScript and TypeScript: sinks, and whether what reaches them is safe, tainted or unknown in their function.

A file is cut into tokens, and a stack says of each the function it is in, and the values it belongs to, with the brackets in between. Values count that are assigned or that sinks take; what is assigned to a
plain name and what is a sink follow from the tokens around. A file is judged where it lies, and only its findings leave the helper. Lines recur within files and between them, so what a piece of text does from a state is kept
(Reader): the cost is that of the different lines, and one look for each other one. A value
is safe if all its operands are: literals, calls of sanitisers, names that are safe in that function. It is tainted if it holds a source
or a tainted name, not looking into the callee of a call, an index, an object, a ternary or another function. Both are least fixpoints over the assignments of a function, in time that grows with the names in
its values; safe names first, so that a name with a safe value takes no taint from other names, but from sources alone.
A template literal is the sum of its parts. Facts never leave a function: in another one the name is unknown.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship, spread

# Sources (member, call, bare call), sanitisers, receivers whose exec is no shell.
MEMBER_SOURCES = (
    "req.body", "req.query", "req.params", "req.headers", "req.cookies", "request.body", "request.query", "request.params", "request.headers", "document.cookie", "location.hash", "location.search", "location.pathname",
    "window.name", "event.data", "e.data", "msg.data", "process.env",
)
CALL_SOURCES = ("searchParams.get", "params.get", "localStorage.getItem", "sessionStorage.getItem", "cookies.get", "cookie.get", "headers.get", "url.searchParams", "getQueryParam", "getUserInput", "readInput")
SANITIZERS = ("sanitize", "sanitizeHtml", "sanitizeHTML", "clean", "encode", "escape", "escapeHtml", "escapeHTML", "stringify")
NO_SHELL = ("query", "cursor", "stmt", "statement", "db", "collection", "model", "promise", "cmd")
# Rules, by the name that is called.
CALLED = {"eval": "SAST/EvalUsage", "document.write": "SAST/DocumentWrite", "document.writeln": "SAST/DocumentWriteln"}
CALLED_WITH_TEXT = {"setTimeout": "SAST/SetTimeoutString", "setInterval": "SAST/SetIntervalString"}
METHODS = {"exec": "SAST/ChildProcessExec", "execSync": "SAST/ChildProcessExecSync", "spawn": "SAST/ChildProcessSpawn", "execFile": "SAST/ChildProcessExecFile"}
PROPERTIES = {"innerHTML": "SAST/InnerHTMLAssignment", "outerHTML": "SAST/OuterHTMLAssignment"}
MARKUP = "dangerouslySetInnerHTML"
#: Rules that fall away where the value is safe, and the names of those that tell taint.
JUDGED = frozenset((*PROPERTIES.values(), *CALLED.values(), "SAST/DangerouslySetInnerHTML"))
LABELLED = {rule: f"{rule} [tainted]" for rule in (*sorted(JUDGED), *METHODS.values())}

KEYWORDS = frozenset("const let var return if else for while do switch case default new await typeof instanceof in of function class extends throw try catch finally delete void yield with import export async static break continue".split())
LITERALS = ("true", "false", "null", "undefined")
TOKEN = re.compile(
    r"(?P<skip>[^\S\n]+|//[^\n]*|/\*.*?\*/)|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<num>\d[\w.]*)"
    r"|(?P<name>[A-Za-z_$][\w$]*(?:\s*\??\.\s*[A-Za-z_$#][\w$]*)*)|(?P<member>\??\.\s*[A-Za-z_$#][\w$]*(?:\s*\??\.\s*[A-Za-z_$#][\w$]*)*)"
    r"|(?P<op>=>|\.\.\.|[=!]==?|[<>]=|\*\*|&&|\|\||\?\?|\+\+|--|[-+*/%&|^]=|.)",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
SPACED = re.compile(r"\s+|\?(?=\.)")
TEMPLATE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*", re.S)
CLOSING = {")": "(", "]": "[", "}": "{"}

STARTS = ("!", "~", "typeof", "void", "delete", "?", "=>", "new", "function", "class")
NO_OPERATORS = frozenset(("(", ")", "[", "]", "{", "}", "?", ":", "=>", "...", "!", "~", "=", ",", ";"))
OWNER, NO_SHELL_END = re.compile(r"([\w$]+)\.[\w$]+\Z", re.A), re.compile(r"(?:re|regex|regexp|pattern)\Z", re.I)
FIRST, TWO = re.compile(r"[\w$]+", re.A), re.compile(r"[\w$]+\.[\w$]+", re.A)
AROUND = (-4, -3, -2, -1, 0, 1, 2)
VALUES = (
    "path string, at int, value int, line int, scope int, kinds array<string>, around array<string>, name string, "
    "unsafe boolean, needs array<string>, uses array<string>, source boolean, direct boolean"
)
_HELD = ("name", "unsafe", "needs", "uses", "source", "direct")
#: Files whose rows leave a helper together.
BATCH = 2000


class _Frame:
    """An open bracket: its type (P group, C call, A array, I index, B block or object, F function, E arrow's expression, T template), function, and the values open in it."""

    __slots__ = ("kind", "scope", "outer", "held")

    def __init__(self, kind: str, scope: int, held: list[tuple[int, str]]):
        self.kind, self.scope, self.outer, self.held = kind, scope, held, list(held)

    def inner(self, kind: str, at: int) -> _Frame:
        if kind in "FE":
            return _Frame(kind, at, [])
        return _Frame(kind, self.scope, [] if kind == "B" else [(v, t + ("P" if kind == "T" else kind)) for v, t in self.held])

    def part(self) -> None:
        """A separator: values that began in this bracket end."""
        self.held = list(self.outer)


class _Lexer:
    """Cuts a text, or the next piece of one, into tokens; what it knows at a piece's end is where the next one goes on."""

    __slots__ = ("frames", "line", "before", "signature", "broken", "closed", "cut")

    def __init__(self):
        self.frames, self.line, self.before = [_Frame("F", -1, [])], 1, ("op", "")
        self.signature, self.broken, self.closed, self.cut = False, False, "", False

    def read(self, text: str) -> Iterator[tuple[int, int, str, str, int, list[tuple[int, str]]]]:
        """at (from 0 in each piece), line, kind, token, function and values of the tokens."""
        frames, line, at, i = self.frames, self.line, 0, 0
        before, signature, broken, closed = self.before, self.signature, self.broken, self.closed
        size = len(text)
        while i < size:
            c = text[i]
            if c == " ":
                i += 1
                continue
            if c == "\n":
                i, line, broken = i + 1, line + 1, True
                continue
            if c == "`" or (c == "}" and frames[-1].kind == "T"):
                kind, token, end = "op", c, i + 1
            else:
                m = TOKEN.match(text, i)
                kind, token, end = m.lastgroup, m[0], m.end()
                if token == "/" and (r := REGEX.match(text, i)) and not (before[0] in ("name", "num", "str", "member") or before[1] in (")", "]", "}", "<")):
                    kind, token, end = "regex", r[0], r.end()
            began, i = line, end
            if kind != "op":
                line += token.count("\n")
            if kind == "skip":
                continue
            if kind in ("name", "member"):
                if not token.isidentifier():
                    token = SPACED.sub("", token)
                if token in KEYWORDS:
                    kind = "word"
            operand = before[0] in ("name", "num", "str", "regex", "member") or before[1] in (")", "]", "}")
            if (broken and operand and kind in ("name", "num", "str", "word") and frames[-1].kind in "BFE") or token in (",", ";"):
                while frames[-1].kind == "E":
                    frames.pop()
                frames[-1].part()
            broken = False
            if token in CLOSING:
                while len(frames) > 1 and frames[-1].kind == "E":
                    frames.pop()
            elif before[1] == "=>" and token != "{":
                frames.append(frames[-1].inner("E", at))
            top = frames[-1]
            if token == "`":  # a group: text, and for each part a plus and a group
                yield at, began, "op", "(", top.scope, top.held
                frames.append(top.inner("P", at))
                yield at + 1, began, "str", "`", top.scope, frames[-1].held
                at, i, line = at + 2, *_text(text, i, line)
                before = ("str", "`")
            elif token == "}" and top.kind == "T":
                frames.pop()
                yield at, began, "op", ")", frames[-1].scope, frames[-1].held
                at, i, line = at + 1, *_text(text, i, line)
                before = ("op", ")")
            else:
                if token in CLOSING and len(frames) > 1:
                    closed = frames.pop().kind
                    top = frames[-1]
                yield at, began, kind, token, top.scope, top.held
                call = kind == "op" and token == "(" and (operand or before == ("word", "function"))
                if token == "(":
                    frames.append(top.inner("C" if call else "P", at))
                elif token == "[":
                    frames.append(top.inner("I" if operand else "A", at))
                elif token == "{":
                    frames.append(top.inner("F" if signature or before[1] == "=>" else "B", at))
                signature = (token == ")" and closed == "C") or (signature and (kind == "name" or token in ":<>[]|"))
                if call or (token == ":" and before[1] == "__html") or token == "=":
                    frames[-1].held.append((at, ""))
                at, before = at + 1, (kind, token)
                continue
            # Behind a template's text: the next part, or its end.
            self.cut = self.cut or i >= size
            if i < size and text.startswith("${", i):
                group = frames[-1]
                yield at, line, "op", "+", group.scope, group.held
                yield at + 1, line, "op", "(", group.scope, group.held
                frames.append(group.inner("T", at))
                at, i, before = at + 2, i + 2, ("op", "(")
            else:
                i += 1
                if len(frames) > 1:
                    frames.pop()
                yield at, line, "op", ")", frames[-1].scope, frames[-1].held
                at, before, closed = at + 1, ("op", ")"), "P"
        self.line, self.before, self.signature, self.broken, self.closed = line, before, signature, broken, closed


def lex(text: str) -> Iterator[tuple[int, int, str, str, int, list[tuple[int, str]]]]:
    """at, line, kind, token, function and values of a file's tokens."""
    return _Lexer().read(text)


def _text(text: str, i: int, line: int) -> tuple[int, int]:
    """Where a template's text ends, and the line there."""
    end = TEMPLATE.match(text, i).end()
    return end, line + text.count("\n", i, end)


class _Value:
    """What is known of a value as its tokens pass."""

    __slots__ = ("any", "odd", "operands", "wild", "source", "direct", "needs", "uses")

    def __init__(self):
        self.any = self.odd = self.wild = self.source = self.direct = False
        self.operands, self.needs, self.uses = 0, set(), set()

    def add(self, more: _Value) -> None:
        """What its tokens in a further piece of the text say."""
        self.any |= more.any
        self.odd |= more.odd
        self.wild |= more.wild
        self.source |= more.source
        self.direct |= more.direct
        self.operands += more.operands
        self.needs |= more.needs
        self.uses |= more.uses

    def copy(self) -> _Value:
        new = _Value()
        new.add(self)
        return new

    def row(self) -> tuple:
        """unsafe (whatever its names are), needs (names that must be safe), uses (names that taint), source (it holds one), direct (it is one)."""
        if not self.any:
            return NOTHING
        unsafe = self.odd or self.wild or not self.operands
        return unsafe, tuple(sorted(self.needs)), () if self.wild else tuple(sorted(self.uses)), self.source and not self.wild, self.direct and self.operands == 1 and not self.wild


NOTHING = (None, None, None, None, None)


def _sink(kind: str, token: str) -> bool:
    """Whether a call of this name may be a sink."""
    return kind in ("name", "member") and (token in CALLED or token in CALLED_WITH_TEXT or token == "Function" or token.rpartition(".")[2] in METHODS)


def _rule(kinds: tuple, around: tuple) -> str | None:
    """The rule of the sink that a value reaches, by the tokens around the one that opens it."""
    token, kind, called, assigned = around[3], kinds[1], around[4] == "(", around[4] == "="
    if kind not in ("name", "member"):
        return None
    last, dotted = token.rpartition(".")[2], "." in token
    if called and kind == "name" and token in CALLED:
        return CALLED[token]
    if called and token in CALLED_WITH_TEXT and (kinds[2] == "str" or around[6] == "`"):
        return CALLED_WITH_TEXT[token]
    if called and token == "Function" and around[2] == "new":
        return "SAST/FunctionConstructor"
    if called and dotted and last in METHODS:
        owner = m[1] if (m := OWNER.match(token)) else ""
        harmless = last == "exec" and (owner in NO_SHELL or NO_SHELL_END.search(owner) or (kind == "member" and (kinds[0] == "regex" or around[2] == ")")))
        return None if harmless else METHODS[last]
    if assigned and dotted and last in PROPERTIES:
        return PROPERTIES[last]
    return "SAST/DangerouslySetInnerHTML" if assigned and token == MARKUP else None


class _Item:
    """A value's kinds, around, name (the plain one that it is assigned to), what is known of it, the rule of the sink that it reaches, and the number of its assignment. Equal ones are one object."""

    __slots__ = ("kinds", "around", "name", "known", "rule", "statement")

    def __init__(self, *of):
        self.kinds, self.around, self.name, self.known, self.rule, self.statement = of


class _State:
    """All that the reading of a text depends on between two of its pieces, functions and open values by number; next: the pieces met here, and what they do (False: it takes the next one to know), last: those with which a text ends."""

    __slots__ = ("frames", "lexed", "tail", "back", "next", "last")

    def __init__(self, frames, lexed, tail, back):
        self.frames, self.lexed, self.tail, self.back, self.next, self.last = frames, lexed, tail, back, {}, {}


class _Step(NamedTuple):
    """What a piece does: rows of the values that begin and end in it (at, value, line, function, item), among them assignments (function, number) and sinks (line, function, item),
    those that go on (at, line, function, kinds, around, value), what it adds to values that were open, and where it leads to (state, its functions and open values, None where both stay).
    Numbers below 0 are those of the state before, others count from the piece's start."""

    tokens: int
    lines: int
    rows: list
    said: list
    sinks: list
    begun: list
    added: list
    state: _State | None
    scopes: list | None
    values: list


PIECE = re.compile(r"(?:[^;{}]++|[;{}](?!\n))*+[;{}]\n|.+", re.S)
#: A piece ends behind a line only if what follows can't change how it reads; otherwise it takes in the next one, so many times, then the rest.
JOINED = 8
#: Steps and their letters kept at most, and letters of one that is kept; functions whose facts are kept.
STEPS, LETTERS, LONGEST, FUNCTIONS = 20000, 4000000, 2000, 20000
#: A step that is made costs three times what reading the piece with its text does. With so many more of them than pay (one for two that were met before), texts are read whole for a while.
PATIENCE = 500


class Reader:
    """Reads files a piece at a time. Lines recur, so the step that a piece makes from a state is kept: read again from there it takes one look, whatever its tokens are."""

    def __init__(self):
        self.made = self.missed = 0
        self._clear()

    def _clear(self) -> None:
        self.states, self.items, self.statements, self.listed, self.facts, self.steps, self.letters = {}, {}, {}, [], {}, 0, 0
        self.trails = {"": (True, True)}
        self.start = self._state([("F", -1, (), 0)], (("op", ""), False, False, ""), (), None)

    def _state(self, frames: list, lexed: tuple, tail: tuple, back: int | None) -> _State:
        key = (tuple(frames), lexed, tail, back)
        if key not in self.states:
            self.states[key] = _State(*key)
        return self.states[key]

    def _item(self, kinds: tuple, around: tuple, own: bool, known: tuple) -> _Item:
        before, kind = around[3], kinds[1]
        typed = around[2] == ":" and around[0] in ("const", "let", "var")
        name = None if around[4] != "=" or not own else around[1] if typed else before if kind == "name" and "." not in before else None
        rule = _rule(kinds, around) if own != (before == MARKUP) else None
        statement = None if name is None or known[0] is None else self.statements.setdefault((name, *known), len(self.listed))
        if statement == len(self.listed):
            self.listed.append((name, *known))
        key = (kinds, around, name, known, rule, statement)
        if key not in self.items:
            self.items[key] = _Item(*key)
        return self.items[key]

    def _walk(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """A file's steps (step, tokens and lines before it, functions), and rows of the values that went on beyond theirs."""
        if self.steps > STEPS or self.letters > LETTERS or len(self.items) > STEPS:
            self._clear()
        state, at, line, scopes, values, steps, ended = self.start, 0, 1, [-1], [], [], []
        pieces = PIECE.findall(text)
        n, last, made = 0, len(pieces), self.made
        if self.missed > PATIENCE:
            self.missed -= 1 + last // 4
            return [(self._step(state, text, True), at, line, scopes)], ended
        while n < last:
            piece = pieces[n]
            n += 1
            step = state.next.get(piece) or self._known(state, piece, n == last)
            joined = n
            while not step:
                joined = joined + 1 if joined < n + JOINED else last
                step = self._known(state, "".join(pieces[n - 1 : joined]), joined == last)
            n = joined
            steps.append((step, at, line, scopes))
            if step.scopes is not None:
                for v, more in step.added:
                    values[~v][-1].add(more)
                begun = {a: (at + a, line + b, at + f if f >= 0 else scopes[~f], kinds, around, value.copy()) for a, b, f, kinds, around, value in step.begun}
                ended += begun.values()
                values = [values[~v] if v < 0 else begun[v] for v in step.values]
                scopes = [at + f if f >= 0 else scopes[~f] for f in step.scopes]
            at += step.tokens
            line += step.lines
            state = step.state
        self.missed = max(self.missed + 3 * (self.made - made) - last, -PATIENCE)
        return steps, [(a, a, b, f, self._item(kinds, around, True, value.row())) for a, b, f, kinds, around, value in ended]

    def read(self, text: str) -> list[tuple]:
        """Rows (at, value, line, function, item) of a file's values that are assigned or may reach a sink, by the token that opens them.
        A value of markup has a second row, at the sign of its attribute."""
        steps, rows = self._walk(text)
        for step, at, line, scopes in steps:
            rows += [(at + a, None if v is None else at + v, line + b, at + f if f >= 0 else scopes[~f], item) for a, v, b, f, item in step.rows]
        return rows

    def judge(self, text: str) -> tuple[list[tuple], dict[int, tuple[frozenset, frozenset]]]:
        """line, function and item of a file's sinks, and by function the names that are safe and those that are tainted."""
        steps, ended = self._walk(text)
        held: dict[int, set] = {}
        sinks = []
        for _, _, line, scope, item in ended:
            if item.statement is not None:
                held.setdefault(scope, set()).add(item.statement)
            if item.rule is not None:
                sinks.append((line, scope, item))
        for step, at, line, scopes in steps:
            for f, number in step.said:
                scope = at + f if f >= 0 else scopes[~f]
                if scope in held:
                    held[scope].add(number)
                else:
                    held[scope] = {number}
            for b, f, item in step.sinks:
                sinks.append((line + b, at + f if f >= 0 else scopes[~f], item))
        if len(self.facts) > FUNCTIONS:
            self.facts.clear()
        out = {}
        for scope, numbers in held.items():
            key = frozenset(numbers)
            found = self.facts.get(key)
            if found is None:
                found = self.facts[key] = tuple(map(frozenset, fixpoints([self.listed[k] for k in numbers])))
            out[scope] = found
        return sinks, out

    def _known(self, state: _State, piece: str, end: bool) -> _Step | None:
        """The step of a piece as it was made before, or made now."""
        step = None
        for ends, kept in ((False, state.next), (True, state.last))[: 1 + end]:
            step = kept.get(piece)
            if step is None:
                step = self._step(state, piece, ends) or False
                self.made += 1
                if len(piece) <= LONGEST:
                    kept[piece] = step
                    self.steps, self.letters = self.steps + 1, self.letters + len(piece)
            if step:
                break
        return step

    def _step(self, state: _State, piece: str, end: bool) -> _Step | None:
        """The step that a piece makes, or None if what follows it may change how it reads; end: nothing follows."""
        opening = piece.rfind("/*")
        if not end and opening >= 0 and piece.rfind("*/") < opening + 2:
            return None
        lexer = _Lexer()
        lexer.frames = []
        for kind, scope, held, outer in state.frames:
            frame = _Frame(kind, scope, list(held[:outer]))
            frame.held += held[outer:]
            lexer.frames.append(frame)
        lexer.before, lexer.signature, lexer.broken, lexer.closed = state.lexed
        lexer.line = 0
        found = [(line, kind, token, scope, tuple(held)) for _, line, kind, token, scope, held in lexer.read(piece)]
        last = len(found) - 1
        if not end and (lexer.cut or last < 0 or found[last][1] != "op" or found[last][2] not in (";", "{", "}")):
            return None
        kept, opened = self._values(state, found)
        open_ = set() if end else {v for f in lexer.frames for v, _ in f.held if v in kept}
        back = [(None, None)] * (4 - len(state.tail)) + list(state.tail)
        kind_of = lambda i: found[i][1] if 0 <= i <= last else back[i][0] if i < 0 else None
        token_of = lambda i: found[i][2] if 0 <= i <= last else back[i][1] if i < 0 else None
        rows, begun = [], []
        for i in opened:
            markup = token_of(i - 1) == MARKUP
            if not end and (i + (4 if markup else 2) > last or (markup and (i in open_ or i + 4 in open_))):
                return None
            line = found[i - 1][0] if i else found[i][0] if state.back is None else -state.back
            scope, kinds, around = found[i][3], tuple(kind_of(i + n) for n in (-2, -1, 1)), tuple(token_of(i + n) for n in AROUND)
            if i in open_:
                begun.append((i, line, scope, kinds, around, kept[i]))
                continue
            rows.append((i, i, line, scope, self._item(kinds, around, True, kept[i].row())))
            if markup:
                inner = kept.get(i + 4) if token_of(i + 3) == "__html" else None
                rows.append((i, i + 4 if inner else None, line, scope, self._item(kinds, around, False, inner.row() if inner else NOTHING)))
        added = [(v, value) for v, value in kept.items() if v < 0 and value.any]
        said = list(dict.fromkeys((f, item.statement) for *_, f, item in rows if item.statement is not None))
        sinks = [(line, f, item) for _, _, line, f, item in rows if item.rule is not None]
        if end:
            return _Step(last + 1, lexer.line, rows, said, sinks, begun, added, None, [], [])
        # Values that open at the sign of markup are known by its row alone, which is whole here; others that are open are begun or were.
        going = {v for v in open_ if v < 0} | {b[0] for b in begun}
        scopes, values, frames = [], [], []
        for f in lexer.frames:
            if f.scope not in scopes:
                scopes.append(f.scope)
            held, outer = [], len(f.outer)
            for k, (v, trail) in enumerate(f.held):
                if v not in going:
                    outer -= k < len(f.outer)
                    continue
                if v not in values:
                    values.append(v)
                held.append((~values.index(v), trail))
            frames.append((f.kind, ~scopes.index(f.scope), tuple(held), outer))
        tail = tuple([*back, *((kind, token) for _, kind, token, _, _ in found[-4:])][-4:])
        after = self._state(frames, (lexer.before, lexer.signature, lexer.broken, lexer.closed), tail, lexer.line - found[last][0])
        stays = not begun and not added and all(x == ~i for of in (scopes, values) for i, x in enumerate(of)) and len(scopes) == len({f[1] for f in state.frames}) and len(values) == len({v for f in state.frames for v, _ in f[2]})
        return _Step(last + 1, lexer.line, rows, said, sinks, begun, added, after, None if stays else scopes, values)

    def _values(self, state: _State, found: list[tuple]) -> tuple[dict[int, _Value], list[int]]:
        """What a piece's tokens (found) say of its values and of those open before, and the tokens that open those that are assigned or may reach a sink."""
        kept: dict[int, _Value] = {v: _Value() for _, _, held, _ in state.frames for v, _ in held}
        opened, trails, last = [], self.trails, len(found) - 1
        kind_before, before = state.tail[-1] if state.tail else ("", "")
        for i, (_, kind, token, _, held) in enumerate(found):
            mine = [(kept[v], t) for v, t in held if v in kept] if held else held
            if mine:
                after = found[i + 1][2] if i < last else ""
                name, call, index = kind == "name", after == "(", after == "["
                bare = name and not call and not index
                literal = kind in ("str", "num", "regex") or (name and token in LITERALS)
                plain = bare and not literal and "." not in token
                operator = kind == "op" and token not in NO_OPERATORS
                # An operator without a value before it is a prefix, and its result neither safe nor tainted.
                prefix = operator and not (kind_before in ("name", "num", "str", "member", "regex") or before in (")", "]"))
                fine = (
                    plain or (literal and kind != "regex") or (operator and not prefix) or (kind == "op" and token in ("(", ")")) or (kind == "word" and token == "await")
                    or (call and kind in ("name", "member") and token.rpartition(".")[2] in SANITIZERS)
                )
                called = name and call and token in CALL_SOURCES
                source = called or (bare and (m := TWO.match(token)) is not None and m[0] in MEMBER_SOURCES)
                for value, trail in mine:
                    if trail not in trails:
                        trails[trail] = (not trail.strip("P"), not trail.strip("PCA"))
                    top, open_ = trails[trail]
                    value.any = True
                    if top:
                        value.odd |= not fine
                        value.wild |= prefix or token in STARTS
                        value.direct |= called or (bare and token in MEMBER_SOURCES)
                        value.operands += kind in ("name", "member", "str", "num", "regex") or token in ("[", "{")
                        if plain:
                            value.needs.add(token)
                    if open_:
                        value.source |= source
                        if bare and not literal:
                            value.uses.add(FIRST.match(token)[0])
            if kind == "op" and (token == "=" or (token == "(" and _sink(kind_before, before))):
                opened.append(i)
                kept[i] = _Value()
            elif token == ":" and before == "__html":
                kept[i] = _Value()
            kind_before, before = kind, token
        return kept, opened


def taken(text: str) -> Iterator[tuple]:
    """The rows of VALUES, but for the path."""
    for at, value, line, scope, item in READER.read(text):
        yield at, value, line, scope, item.kinds, item.around, item.name, *item.known


READER = Reader()


def _read(files: DataFrame, take: str, schema: str) -> DataFrame:
    """What a function of this module takes from each of the files (path, text): columns, the first of them the file's place in its batch."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.operators import taint

        for b in batches:
            for k in range(0, b.num_rows, taint.BATCH):
                part = b.slice(k, taint.BATCH)
                of, *columns = getattr(taint, take)(part.column(1).to_pylist())
                if len(of):
                    names = [c.split()[0] for c in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *columns], names=names)

    return spread(files.select("path", "text")).mapInArrow(run, schema)


def _places(keys: list) -> tuple[list[int], pa.Array]:
    """Where each of the different keys is met first, and the place of each among these."""
    places: dict = {}
    index = [places.setdefault(k, len(places)) for k in keys]
    first = dict(zip(reversed(index), range(len(keys) - 1, -1, -1), strict=True))
    return [first[i] for i in range(len(places))], pa.array(index, pa.int32())


def _columns(rows: list[tuple], kinds: tuple) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]


_STRINGS, _INT = pa.list_(pa.string()), pa.int32()


def _take_values(texts: list[str | None]) -> list:
    rows = [(n, *r) for n, text in enumerate(texts) for r in READER.read(text or "")]
    first, index = _places([id(r[-1]) for r in rows])
    known = _columns([(x.kinds, x.around, x.name, *x.known) for x in (rows[i][-1] for i in first)], (_STRINGS, _STRINGS, pa.string(), pa.bool_(), _STRINGS, _STRINGS, pa.bool_(), pa.bool_()))
    return [*_columns([r[:-1] for r in rows], (_INT,) * 5), *(c.take(index) for c in known)]


def _take_names(texts: list[str | None]) -> list:
    rows = []
    for n, text in enumerate(texts):
        for scope, (safe, tainted) in READER.judge(text or "")[1].items():
            rows += [(n, scope, name, name in safe, name in tainted) for name in safe | tainted]
    return _columns(rows, (_INT, _INT, pa.string(), pa.bool_(), pa.bool_()))


def _take_findings(texts: list[str | None]) -> list:
    """Sinks that aren't provably safe, tainted ones marked."""
    of, lines, rules, nothing = [], [], [], (frozenset(), frozenset())
    for n, text in enumerate(texts):
        sinks, facts = READER.judge(text or "")
        for line, scope, item in sinks:
            unsafe, needs, uses, source, _ = item.known
            safe, tainted = facts.get(scope, nothing)
            rule = item.rule
            if rule in JUDGED and unsafe is False and safe.issuperset(needs):
                continue
            if rule in LABELLED and (source or (uses and not tainted.isdisjoint(uses))):
                rule = LABELLED[rule]
            of.append(n)
            lines.append(line)
            rules.append(rule)
    return [pa.array(of, _INT), pa.array(lines, _INT), pa.array(rules, pa.string())]


def tokens(files: DataFrame) -> DataFrame:
    """VALUES of files (path, text)."""
    return _read(files, "_take_values", VALUES)


def names(files: DataFrame) -> DataFrame:
    """path, scope, name, safe and tainted of all names assigned in files (path, text) that are either."""
    return _read(files, "_take_names", "path string, scope int, name string, safe boolean, tainted boolean")


def _seen(found: DataFrame) -> DataFrame:
    """Values with the tokens around them: token-1 is the one before the opening one, kind-1 its kind."""
    return found.select(
        *(c for c in found.columns if c not in ("kinds", "around")),
        *(F.col("around")[i].alias(f"token{n:+d}") for i, n in enumerate(AROUND)), *(F.col("kinds")[i].alias(f"kind{n:+d}") for i, n in enumerate((-2, -1, 1))),
    )


def assignments(seen: DataFrame) -> DataFrame:
    """path, scope, name and value of assignments to plain names."""
    return seen.select("path", "scope", "name", "value").where("name is not null")


def values(seen: DataFrame) -> DataFrame:
    """path, value, and of each value that has tokens: unsafe, needs, uses, source and direct."""
    return seen.where("value = at and unsafe is not null").select("path", "value", "unsafe", "needs", "uses", "source", "direct")


def fixpoints(statements: list[tuple]) -> tuple[list[str], list[str]]:
    """The safe and the tainted names of a function's assignments (name, unsafe, needs, uses, source, direct): a safe value's names are all safe; direct sources taint, and what values
    that hold a source or a tainted name pass on to names that aren't safe."""
    safe = {name for name, unsafe, needs, *_ in statements if unsafe is False and not needs}
    if safe:
        _grow(safe, [(name, needs) for name, unsafe, needs, *_ in statements if unsafe is False and needs and name not in safe], len)
    tainted = {name for name, _, _, _, source, direct in statements if direct or (source and name not in safe)}
    if tainted:
        _grow(tainted, [(name, uses) for name, _, _, uses, *_ in statements if uses and name not in safe and name not in tainted], lambda uses: 1)
    return sorted(safe), sorted(tainted)


def _grow(names: set[str], given: list[tuple], wanted: Callable[[list], int]) -> None:
    """Adds names that are given by so many of their sources (name, sources) being among the names, until none is left."""
    waiting: dict[str, list[int]] = {}
    open_ = [wanted(of) for _, of in given]
    for i, (_, of) in enumerate(given):
        for n in of:
            if n in waiting:
                waiting[n].append(i)
            else:
                waiting[n] = [i]
    fresh = [n for n in waiting if n in names]
    while fresh:
        for i in waiting.get(fresh.pop(), ()):
            open_[i] -= 1
            name = given[i][0]
            if open_[i] == 0 and name not in names:
                names.add(name)
                fresh.append(name)


def _judged_functions(functions: DataFrame) -> DataFrame:
    """Functions (held: their assignments) with the names that are safe and those that are tainted in place of held."""
    ship(functions.sparkSession)
    kept = [c for c in functions.columns if c != "held"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.operators.taint import _HELD, fixpoints

        for b in batches:
            held = b.column("held")
            of, flat = held.offsets.to_pylist(), held.values
            statements = list(zip(*(flat.field(k).to_pylist() for k in _HELD), strict=True))
            both = [fixpoints(statements[i:j]) for i, j in zip(of, of[1:], strict=False)]
            lists = [pa.array([x[k] for x in both], pa.list_(pa.string())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *lists], names=[*kept, "safe", "tainted"])

    types = ", ".join(f"{c} {t}" for c, t in functions.dtypes if c != "held")
    return functions.mapInArrow(run, f"{types}, safe array<string>, tainted array<string>")


def facts(assigned: DataFrame) -> DataFrame:
    """path, scope, name, safe and tainted of all assigned names that are either; assigned: path, scope, name and its value's columns."""
    functions = _judged_functions(assigned.groupBy("path", "scope").agg(F.collect_list(F.struct(*_HELD)).alias("held")))
    rows = functions.select("path", "scope", "safe", "tainted", F.explode(F.array_union("safe", "tainted")).alias("name"))
    return rows.select("path", "scope", "name", F.array_contains("safe", F.col("name")).alias("safe"), F.array_contains("tainted", F.col("name")).alias("tainted"))


def scan(files: DataFrame) -> DataFrame:
    """path, line and rule of the findings in JavaScript and TypeScript files (path, text)."""
    return _read(files, "_take_findings", "path string, line int, rule string").distinct()
