"""JavaScript text to facts: a tokenizer and one procedural pass a file, in ``mapInPandas``.

What it proves: globals that no binding of the file shadows; names bound by imports
and ``require`` calls with constant specifiers; namespaces and their members; ``const``
aliases of these; what a rooted call returned; instances of imported classes; constant
strings, concatenations, whole numbers, arrays, objects and templates as arguments;
``call`` and ``apply`` with the target's arguments. A name that is assigned again, or
bound more than once in a file, proves nothing. Type annotations are not stripped;
what can't be read becomes a diagnostic, never a guess. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.facts import COLUMNS, SCHEMA
from ..storage import cut

TOKEN = re.compile(
    r"""(?P<space>[\s﻿]+|//[^\n]*|/\*.*?\*/)|(?P<name>[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<number>0[xXbBoO][0-9a-fA-F_]+n?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?n?)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)|(?P<punct>\?\.(?![0-9])|=>|\.\.\.|[=!]==?|[<>]=|\*\*=?|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^]=|<<=?|>>>?=?|[{}()\[\];,.<>+\-*/%&|^!~?:=@\#])""",
    re.S,
)
REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
KEYWORDS = frozenset("await break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return static super switch this throw try typeof var void while with yield async of true false null undefined".split())
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
MAX_TOKENS, MAX_DEPTH, MAX_CONSTANT = 1 << 20, 512, 16 * 1024


class Unreadable(ValueError):
    """Text that this front end doesn't understand."""


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


@dataclass
class Known:
    """What an expression is known to be; every field may be unknown."""

    string: str | None = None
    number: int | None = None
    items: list | None = None
    object: dict | None = None
    chain: str | None = None
    rooted: bool = False
    name: str | None = None
    module: str | None = None
    export: str | None = None
    namespace: bool = False
    producer: str | None = None
    instance: tuple[str, str] | None = None
    slot: int | None = None


@dataclass
class Binding:
    kind: str
    value: Known = field(default_factory=Known)
    times: int = 0


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        t = m[1]
        if t[0] in "ux":
            return chr(int(t.strip("ux{}"), 16)) if len(t) > 1 else t
        return ESCAPES.get(t, t)

    return re.sub(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", one, body, flags=re.S)


def brackets(tokens: list[Token]) -> tuple[list[int], list[int]]:
    """For each token the bracket it lies in (-1: none), and for each opening one where it closes."""
    around, closing, open_ = [-1] * len(tokens), [len(tokens)] * len(tokens), []
    for k, token in enumerate(tokens):
        if token.kind == "punct" and token.text in ")]}" and open_:
            closing[open_.pop()] = k
        around[k] = open_[-1] if open_ else -1
        if token.kind == "punct" and token.text in "([{":
            open_.append(k)
    return around, closing


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    i = 0
    while i < len(text):
        if text[i] == "/" and not text.startswith(("//", "/*"), i):
            before = out[-1] if out else None
            value = before and (before.kind in ("number", "string", "template") or before.kind == "name" and before.text not in KEYWORDS - {"this", "super"} or before.text in (")", "]", "}"))
            if not value and (m := REGEX.match(text, i)):
                out.append(Token("regex", m[0], i, m.end()))
                i = m.end()
                continue
        m = TOKEN.match(text, i)
        if not m:
            raise Unreadable(f"unexpected character at {i}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], i, m.end()))
        if len(out) > MAX_TOKENS:
            raise Unreadable("too many tokens")
        i = m.end()
    return out


def interpolated(template: str) -> list[tuple[int, int]]:
    """Places of the expressions in a template's text."""
    out, i = [], 0
    while (i := template.find("${", i)) >= 0:
        if (i - len(template[:i].rstrip("\\"))) % 2:  # escaped
            i += 2
            continue
        depth, k = 1, i + 2
        while depth and k < len(template):
            if template[k] in "'\"" and (m := re.compile(r"(['\"])(?:(?!\1)[^\\\n]|\\.)*\1").match(template, k)):
                k = m.end()
                continue
            depth += (template[k] == "{") - (template[k] == "}")
            k += 1
        out.append((i + 2, k - 1))
        i = k
    return out


class Reader:
    """Facts of one file, in source order."""

    def __init__(self, path: str, text: str):
        self.path, self.text, self.tokens = path, text, tokenize(text)
        self.i, self.depth, self.slots, self.facts, self.bindings = 0, 0, 0, [], {}
        data, self.bytes = 0, [0]
        for c in text:
            data += len(c.encode("utf-8", "surrogatepass"))
            self.bytes.append(data)
        self._declare()

    # bindings -------------------------------------------------------------------------------------
    def _declare(self) -> None:
        """Names bound anywhere in the file; one that is bound or assigned twice proves nothing."""
        t = self.tokens
        self.around, self.closing = brackets(t)
        for k, token in enumerate(t):
            nxt = t[k + 1].text if k + 1 < len(t) else ""
            before = t[k - 1].text if k else ""
            if token.kind != "name" or token.text in KEYWORDS or before in (".", "?."):
                continue
            declared = before in ("let", "var", "const", "function", "class")
            parameter = nxt == "=>" or before in ("(", ",", "...") and self._is_parameter(k)
            if declared or parameter:
                b = self.bindings.setdefault(token.text, Binding("local"))
                b.times += 1
            elif nxt in ("=", "+=", "-=", "++", "--", "||=", "&&=", "??="):
                self.bindings.setdefault(token.text, Binding("assigned")).times += 1

    def _is_parameter(self, k: int) -> bool:
        t, k = self.tokens, self.around[k]
        if k < 1 or t[k].text != "(":
            return False
        before = t[k - 1]
        if before.text == "function" or (k > 1 and t[k - 2].text == "function") or before.text == "catch":
            return True
        j = self.closing[k]
        return j + 1 < len(t) and t[j + 1].text == "=>"

    def _bind(self, name: str, value: Known) -> None:
        b = self.bindings.setdefault(name, Binding("local"))
        if b.times <= 1:
            b.value = value

    def _lookup(self, name: str) -> Known:
        b = self.bindings.get(name)
        if b is None:
            return Known(chain=name, rooted=True, name=name)
        v = b.value if b.times <= 1 else Known()
        return Known(**{**v.__dict__, "name": name, "chain": v.chain or name})

    # tokens ---------------------------------------------------------------------------------------
    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k].text if self.i + k < len(self.tokens) else ""

    def take(self) -> Token:
        if self.i >= len(self.tokens):
            raise Unreadable("unexpected end")
        self.i += 1
        return self.tokens[self.i - 1]

    def expect(self, text: str) -> None:
        if self.take().text != text:
            raise Unreadable(f"expected {text}")

    def fact(self, kind: str, start: int, end: int, **more) -> None:
        row = {"path": self.path, "kind": kind, "start": self.bytes[start], "end": self.bytes[end], "function_id": 0, "definite": True, **more}
        self.facts.append((start, len(self.facts), row))

    # statements -----------------------------------------------------------------------------------
    def run(self) -> list[dict]:
        while self.i < len(self.tokens):
            self.statement()
        rows = [row for *_, row in sorted(self.facts, key=lambda f: f[:2])]
        for k, row in enumerate(rows):
            row["fact_id"] = k
        return rows

    def statement(self) -> None:
        t = self.peek()
        if t == "import" and self.peek(1) not in ("(", "."):
            self.import_()
        elif t in ("const", "let", "var"):
            self.take()
            self.declarators(t)
        elif t == "class":
            self.class_()
        elif t in (";", "{", "}", ")", "]", ",", ":", "=>", "else", "do", "try", "finally", "return", "throw", "case", "default", "export", "break", "continue", "async", "static", "yield", "debugger"):
            self.take()
        elif t in ("if", "while", "for", "switch", "with", "catch"):
            self.take()
            if self.peek() == "await":
                self.take()
            if self.peek() == "(":
                self.take()
                if self.peek() in ("const", "let", "var"):
                    self.take()
        elif t == "function":
            self.function()
        else:
            before = self.i
            self.expression()
            if self.i == before:
                self.take()

    def import_(self) -> None:
        start = self.take().start
        names: list[tuple[str, str]] = []
        while self.peek() not in ("", ";") and self.tokens[self.i].kind != "string":
            t = self.take().text
            if t == "*":
                self.expect("as")
                names.append((self.take().text, "*"))
            elif t == "{":
                while self.peek() != "}":
                    export = self.take()
                    local = export.text
                    if self.peek() == "as":
                        self.take()
                        local = self.take().text
                    names.append((local, export.text.strip("'\"")))
                    if self.peek() == ",":
                        self.take()
                self.take()
            elif t not in (",", "from", "type"):
                names.append((t, "default"))
        module = self.take()
        if module.kind != "string":
            raise Unreadable("import without a specifier")
        m = unescape(module.text[1:-1])
        self.fact("import", start, module.end, module=m)
        for local, export in names:
            self.bindings.setdefault(local, Binding("import")).times += 1
            self._bind(local, Known(module=m, namespace=True) if export == "*" else Known(module=m, export=export))

    def declarators(self, kind: str) -> None:
        while True:
            t = self.take()
            if t.text in ("{", "["):
                self.pattern(t.text)
            elif self.peek() == "=":
                self.take()
                value = self.expression(comma=False)
                self._bind(t.text, value)
            if self.peek() != ",":
                return
            self.take()

    def pattern(self, opening: str) -> None:
        names: list[tuple[str, str]] = []
        depth = 1
        while depth:
            t = self.take()
            depth += t.text in ("{", "[")
            depth -= t.text in ("}", "]")
            if depth == 1 and opening == "{" and t.kind == "name" and self.peek() in (",", "}", ":"):
                local = self.peek(1) if self.peek() == ":" else t.text
                names.append((local, t.text))
                if self.peek() == ":":
                    self.i += 2
        for local, _ in names:
            self.bindings.setdefault(local, Binding("local")).times += 1
        if self.peek() == "=":
            self.take()
            value = self.expression(comma=False)
            for local, export in names:
                if value.module and value.namespace:
                    self._bind(local, Known(module=value.module, export=export))
                elif value.rooted and value.chain:
                    self._bind(local, Known(chain=f"{value.chain}.{export}", rooted=True))

    def class_(self) -> None:
        start = self.take().start
        if self.tokens[self.i].kind == "name" and self.peek() not in ("extends",):
            t = self.take()
            self.fact("class_reference", start, t.end, name=t.text, role="declaration")
        if self.peek() == "extends":
            self.take()
            at = self.tokens[self.i].start
            base = self.postfix(*self.primary())
            self.reference(base, at, self.tokens[self.i - 1].end, "superclass")
        while self.peek() not in ("{", ""):  # type parameters and interfaces
            self.take()
        if self.peek() == "{":
            self.class_body()

    def class_body(self) -> None:
        """Members are declarations, not calls; methods' bodies and fields' values are read for their facts."""
        self.expect("{")
        while self.peek() != "}":
            t = self.take()
            if t.text == "static" and self.peek() == "{":
                self.body()
            elif t.text == "[":
                self.expression()
                self.expect("]")
            elif t.text == "(":
                self.i -= 1
                self.function_rest()
            elif t.text == "=":
                self.expression(comma=False)
            elif t.text == ":":  # a type, up to the value or the end
                while self.peek() not in ("=", ";", "}", ""):
                    self.take()
        self.take()

    def reference(self, v: Known, start: int, end: int, role: str) -> None:
        self.fact("class_reference", start, end, **{"name": v.export or v.name or v.chain, "role": role, **self.proof(v)})

    def function(self) -> None:
        self.take()
        while self.peek() not in ("(", ""):
            self.take()
        depth = 0
        while self.i < len(self.tokens):
            t = self.take().text
            depth += t == "("
            depth -= t == ")"
            if not depth:
                return

    # expressions ----------------------------------------------------------------------------------
    def proof(self, v: Known) -> dict:
        if v.module and v.export:
            return {"proof": "module", "module": v.module, "name": v.export}
        if v.rooted and v.chain and "." not in v.chain:
            return {"proof": "global", "name": v.chain}
        return {}

    def expression(self, comma: bool = True) -> Known:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Unreadable("too deep")
        left = self.unary()
        while True:
            t = self.peek()
            if t == "=" or t in ("+=", "-=", "*=", "/=", "||=", "&&=", "??="):
                self.take()
                right = self.expression(comma=False)
                left = right if t == "=" else Known()
            elif t == "+":
                self.take()
                left = add(left, self.unary())
            elif t == "instanceof":
                self.take()
                at = self.tokens[self.i].start if self.i < len(self.tokens) else 0
                right = self.unary()
                self.reference(right, at, self.tokens[self.i - 1].end, "instanceof")
                left = Known()
            elif t == "?":
                self.take()
                self.expression(comma=False)
                if self.peek() == ":":
                    self.take()
                    self.expression(comma=False)
                left = Known()
            elif t in ("-", "*", "/", "%", "**", "&", "|", "^", "&&", "||", "??", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "<<", ">>", ">>>", "in", "of", "as", "satisfies"):
                self.take()
                self.unary()
                left = Known()
            elif t == "," and comma:
                self.take()
                left = self.unary()
            else:
                self.depth -= 1
                return left

    def unary(self) -> Known:
        t = self.peek()
        if t in ("!", "-", "+", "~", "typeof", "void", "delete", "await", "++", "--", "yield", "..."):
            self.take()
            self.unary()
            return Known()
        if t == "new" and self.peek(1) != ".":
            return self.new()
        return self.postfix(*self.primary())

    def new(self) -> Known:
        start = self.take().start
        v, _ = self.primary()
        while self.peek() in (".", "?."):
            self.take()
            v = member(v, self.take().text)
        args: list[Known] = self.arguments() if self.peek() == "(" else []
        made = Known(slot=self.slot())
        if v.module and v.export:
            made.instance = (v.module, v.export)
        name = {"name": v.export or v.name or (v.chain or "").rpartition(".")[2]} | self.proof(v)
        self.fact("construct", start, self.tokens[self.i - 1].end, args=[argument(a) for a in args], result=made.slot, rooted_chain=v.chain if v.rooted else None, **name)
        return self.postfix(made, start)

    def slot(self) -> int:
        self.slots += 1
        return self.slots

    def primary(self) -> tuple[Known, int]:
        token = self.take()
        t = token.text
        if token.kind == "string":
            value = unescape(t[1:-1])
            self.fact("string_reference", token.start, token.end, text=value)
            return Known(string=value), token.start
        if token.kind == "number":
            return Known(number=int(t) if t.isdigit() else None), token.start
        if token.kind == "template":
            value = unescape(t[1:-1]) if "${" not in t else None
            if value is not None and len(value.encode("utf-8", "surrogatepass")) <= MAX_CONSTANT:
                self.fact("string_reference", token.start, token.end, text=value)
                return Known(string=value), token.start
            self.inner(token)
            return Known(), token.start
        if t == "(":
            if self.peek() == ")":
                self.take()
                return Known(), token.start
            v = self.expression()
            if self.peek() == ")":
                self.take()
            return v, token.start
        if t == "[":
            items = self.sequence("]")
            return Known(items=items), token.start
        if t == "{":
            return Known(object=self.object()), token.start
        if t in ("function", "class"):
            self.i -= 1
            (self.function if t == "function" else self.class_)()
            return Known(), token.start
        if t == "this":
            return Known(chain="this", name="this"), token.start
        if t == "import":
            return Known(name="import", chain="import"), token.start
        if token.kind == "name" and t not in KEYWORDS:
            return self._lookup(t), token.start
        return Known(), token.start

    def inner(self, token: Token) -> None:
        """Reads the expressions inside a template for their facts."""
        outer, at = self.tokens, self.i
        for a, b in interpolated(token.text):
            first = token.start + a
            self.tokens, self.i = [Token(t.kind, t.text, t.start + first, t.end + first) for t in tokenize(token.text[a:b])], 0
            while self.i < len(self.tokens):
                before = self.i
                self.expression()
                self.i += self.i == before
        self.tokens, self.i = outer, at

    def object(self) -> dict | None:
        out: dict = {}
        known = True
        while self.peek() != "}":
            token = self.take()
            if token.text == "...":
                v = self.expression(comma=False)
                known = known and v.object is not None
                out.update(v.object or {})
            elif token.text == "[":
                v = self.expression(comma=False)
                self.expect("]")
                key = v.string if v.string is not None else str(v.number) if v.number is not None else None
                known = known and key is not None
                if self.peek() == ":":
                    self.take()
                    out[key] = self.expression(comma=False)
            else:
                key = unescape(token.text[1:-1]) if token.kind == "string" else token.text
                if self.peek() == ":":
                    self.take()
                    out.pop(key, None)
                    out[key] = self.expression(comma=False)
                elif token.text in ("get", "set", "async", "*") and self.peek() not in (",", "}", "("):
                    continue  # the name comes next
                elif self.peek() == "(":
                    self.function_rest()
                    out[key] = Known()
                elif token.kind == "name" and self.peek() in (",", "}"):
                    out[key] = self._lookup(key)
                elif token.kind != "name":
                    raise Unreadable("bad object")
            if self.peek() == ",":
                self.take()
        self.take()
        return out if known and len(out) <= 256 else None

    def function_rest(self) -> None:
        """Parameters and body of a method; the body's statements are read for their facts."""
        depth = 0
        while self.i < len(self.tokens):
            t = self.take().text
            depth += t == "("
            depth -= t == ")"
            if not depth:
                break
        if self.peek() == ":":  # a result's type
            while self.peek() not in ("{", ";", "}", ""):
                self.take()
        if self.peek() == "{":
            self.body()

    def body(self) -> None:
        self.expect("{")
        depth = 1
        while depth:
            t = self.peek()
            if t in ("{", "}"):
                depth += 1 if t == "{" else -1
                self.take()
            elif not t:
                raise Unreadable("unexpected end")
            else:
                self.statement()

    def sequence(self, closing: str) -> list[Known]:
        out: list[Known] = []
        while self.peek() != closing:
            if self.peek() == ",":
                self.take()
                continue
            if not self.peek():
                raise Unreadable("unexpected end")
            before = self.i
            out.append(self.expression(comma=False))
            if self.peek() == "=>":
                self.take()
                out[-1] = Known()
                if self.peek() == "{":
                    self.body()
                else:
                    self.expression(comma=False)
            elif self.peek() == "{":
                self.body()
            if self.i == before:
                self.take()
        self.take()
        return out

    def arguments(self) -> list[Known]:
        self.expect("(")
        return self.sequence(")")

    def postfix(self, v: Known, start: int) -> Known:
        owner: Known | None = None
        name = v.name
        is_member = False
        while True:
            t = self.peek()
            if t in (".", "?."):
                self.take()
                if self.peek() in ("(", "["):
                    continue
                name = self.take().text
                owner, v, is_member = v, member(v, name), True
                if self.peek() not in ("(", ".", "?.", "["):
                    self.access(owner, v, name, start)
            elif t == "[":
                self.take()
                key = self.expression()
                self.expect("]")
                if key.string is not None:
                    owner, v, name, is_member = v, member(v, key.string), key.string, True
                else:
                    owner, v, is_member = None, Known(), False
            elif t == "(":
                args = self.arguments()
                v = self.call(owner, v, name, is_member, args, start)
                owner, is_member, name = None, False, None
            elif t in ("++", "--"):
                self.take()
                v = Known()
            elif t == "=>":
                self.take()
                if self.peek() == "{":
                    self.body()
                else:
                    self.expression(comma=False)
                return Known()
            else:
                return v

    def member_proof(self, owner: Known, v: Known, name: str) -> dict:
        more: dict = {"member": name, "syntactic_path": v.chain, "rooted_chain": v.chain if v.rooted else None, "receiver": owner.slot, "producer": owner.producer}
        if owner.module and owner.namespace:
            more |= {"proof": "namespace", "module": owner.module}
        if owner.instance:
            more |= {"class_module": owner.instance[0], "class_export": owner.instance[1]}
        return more

    def access(self, owner: Known, v: Known, name: str, start: int) -> None:
        kind = "property_write" if self.peek() == "=" or self.peek() in ("+=", "-=", "||=", "&&=", "??=") else "member_read"
        self.fact(kind, start, self.tokens[self.i - 1].end, **self.member_proof(owner, v, name))

    def call(self, owner: Known | None, v: Known, name: str | None, is_member: bool, args: list[Known], start: int) -> Known:
        end = self.tokens[self.i - 1].end
        made = Known(slot=self.slot())
        if is_member and name in ("call", "apply") and owner is not None and (owner.name or owner.chain):
            args = args[1:] if name == "call" else (args[1].items or [] if len(args) > 1 else [])
            return self.call(None, owner, (owner.chain or owner.name or "").rpartition(".")[2], False, args, start)
        if not is_member and name in ("require", "import") and args and args[0].string is not None and v.chain == name:
            self.fact("import", start, end, module=args[0].string)
            return Known(module=args[0].string, namespace=True)
        passed = [argument(a) for a in args]
        if is_member and owner is not None and not (v.module and v.export):
            self.fact("member_call", start, end, args=passed, result=made.slot, **self.member_proof(owner, v, name or ""))
            made.producer = v.chain if v.rooted else None
            return made
        kind = "member_call" if is_member and owner is not None else "call"
        if kind == "member_call":
            self.fact(kind, start, end, args=passed, result=made.slot, **self.member_proof(owner, v, name or ""))
        else:
            self.fact(kind, start, end, args=passed, result=made.slot, rooted_chain=v.chain if v.rooted else None, **({"name": v.export or name or v.name} | self.proof(v)))
        made.producer = v.chain if v.rooted else None
        return made


def member(v: Known, name: str) -> Known:
    out = Known(chain=f"{v.chain}.{name}" if v.chain else None, rooted=v.rooted, name=name)
    if v.module and v.namespace:
        out.module, out.export = v.module, name
    if v.object and isinstance(v.object.get(name), Known):
        return v.object[name]
    return out


def add(a: Known, b: Known) -> Known:
    if a.number is not None and b.number is not None:
        return Known(number=a.number + b.number)
    texts = [x.string if x.string is not None else str(x.number) if x.number is not None else None for x in (a, b)]
    if None in texts or len("".join(texts)) > MAX_CONSTANT:
        return Known()
    return Known(string="".join(texts))


def argument(v: Known) -> dict:
    text = v.string
    shown = None
    if v.object is not None:
        shown = {k: (x.string if x.string is not None else str(x.number) if x.number is not None else None) for k, x in v.object.items()}
    return {"static_string": text, "object": shown, "rooted_chain": v.chain if v.rooted else None, "known": text is not None or shown is not None or v.number is not None}


def read(path: str, text: str) -> tuple[list[dict], str | None]:
    """Facts, and why the file could not be read, if it could not."""
    try:
        return Reader(path, text).run(), None
    except Exception as error:  # noqa: BLE001  no text may end a job of millions of files
        return [], f"{type(error).__name__}: {error}"


def _rows(sources: DataFrame) -> DataFrame:
    """Facts of (path, text) rows and, for a file that can't be read, one row with the ``problem`` only."""
    names = [*COLUMNS, "problem"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                found, problem = read(path, text or "")
                rows += found if problem is None else [{"path": path, "problem": problem}]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("fact_id", "start", "end", "function_id", "receiver", "result"):
                frame[c] = frame[c].astype("Int64")
            yield frame.astype({c: object for c in names if frame[c].dtype == float}).where(frame.notna(), None)

    return sources.select("path", "text").mapInPandas(run, f"{SCHEMA}, problem string")


def facts_of(sources: DataFrame) -> DataFrame:
    """Facts of (path, text) rows; unreadable files have none, see ``diagnostics_of``."""
    return _rows(sources).filter("problem IS NULL").drop("problem")


def diagnostics_of(sources: DataFrame) -> DataFrame:
    """(path, code, message) of the files that can't be read."""
    return _rows(sources).filter("problem IS NOT NULL").select("path", F.lit("unreadable").alias("code"), F.col("problem").alias("message"))


def facts_and_diagnostics(sources: DataFrame, name: str = "facts") -> tuple[DataFrame, DataFrame]:
    """Both, of one pass over the sources, which is written to the shared folder."""
    rows = cut(_rows(sources), name)
    problems = rows.filter("problem IS NOT NULL").select("path", F.lit("unreadable").alias("code"), F.col("problem").alias("message"))
    return rows.filter("problem IS NULL").drop("problem"), problems
