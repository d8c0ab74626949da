"""Chat templates in Jinja, compiled to one column expression over messages.

The subset that chat templates are written in is taken: texts, ``{{ }}``, ``if`` chains, ``for``
over messages, ``set`` (of names, and of attributes of a ``namespace``), comparisons, tests,
slices, string methods and the common filters. A loop is a ``transform`` over the messages,
or, where its body changes a namespace, a fold that carries the namespace along. What can be
decided without data (tools that are not given, the end of a prompt that is asked for or not) is
decided while compiling, so such branches cost nothing. Anything else is an error that names
the construct.

Values have a kind: ``str``, ``int``, ``bool``, ``messages``, ``message``, ``none`` or ``space``; a name
may be defined in some rows only, which ``is defined`` tells.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.text import bound, strip

TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|[-+*~%<>=|.,:()\[\]]))")
BLOCK = re.compile(r"\{%(?P<cut>[-+]?)(?P<stmt>.*?)(?P<after>[-+]?)%\}|\{\{(?P<ecut>[-+]?)(?P<expr>.*?)(?P<eafter>[-+]?)\}\}|\{#.*?#\}", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass
class Value:
    kind: str
    column: Column | None = None
    #: A value that is known while compiling.
    known: object = None
    defined: Column | bool = True
    fields: dict = field(default_factory=dict)


NONE, UNDEFINED = Value("none"), Value("none", defined=False)


def text_of(v: Value) -> Column:
    if v.kind == "str":
        return v.column
    if v.kind == "int":
        return v.column.cast("string")
    if v.kind == "bool":
        return F.when(v.column, F.lit("True")).otherwise(F.lit("False"))
    if v.kind == "none":
        return F.lit("")
    raise ValueError(f"A template can't print {v.kind}.")


def literal(x: object) -> Value:
    kind = {bool: "bool", int: "int", str: "str"}[type(x)]
    return Value(kind, F.lit(x), x)


def truth(v: Value) -> Column | bool:
    """Whether a value counts as true: a Python bool if that is known."""
    if v.kind == "none" or v.defined is False:
        return False
    if v.known is not None:
        return bool(v.known)
    if v.kind in ("message", "space"):
        return True
    base = {"str": lambda c: F.length(c) > 0, "int": lambda c: c != 0, "bool": lambda c: c, "messages": lambda c: F.size(c) > 0}[v.kind](v.column)
    base = F.coalesce(base, F.lit(False))
    return base if v.defined is True else v.defined & base


def both(a: Column | bool, b: Column | bool) -> Column | bool:
    if isinstance(a, bool):
        return b if a else False
    return (a if b else False) if isinstance(b, bool) else a & b


def either(a: Column | bool, b: Column | bool) -> Column | bool:
    return negated(both(negated(a), negated(b)))


def negated(a: Column | bool) -> Column | bool:
    return (not a) if isinstance(a, bool) else ~a


def as_bool(a: Column | bool) -> Value:
    return literal(a) if isinstance(a, bool) else Value("bool", a)


def lexed(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        found = TOKEN.match(source, at)
        if not found:
            raise ValueError(f"A template expression can't be read: {source[at:at + 20]!r}.")
        out.append((found.lastgroup, found[found.lastgroup]))
        at = found.end()
    return out


class Reader:
    """Evaluates one expression's tokens, by precedence, in a scope."""

    def __init__(self, tokens: list[tuple[str, str]], scope: dict[str, Value]):
        self.tokens, self.at, self.scope = tokens, 0, scope

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> bool:
        found = self.peek(*wanted)
        self.at += found
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"A template expression lacks {wanted!r}.")

    def whole(self) -> Value:
        value = self.choice()
        if self.at < len(self.tokens):
            raise ValueError(f"A template expression has more than is understood: {self.tokens[self.at][1]!r}.")
        return value

    def choice(self) -> Value:
        value = self.disjunction()
        if not self.take("if"):
            return value
        condition = truth(self.disjunction())
        other = self.choice() if self.take("else") else UNDEFINED
        return merged([(condition, value)], other)

    def disjunction(self) -> Value:
        value = self.conjunction()
        while self.take("or"):
            value = as_bool(either(truth(value), truth(self.conjunction())))
        return value

    def conjunction(self) -> Value:
        value = self.negation()
        while self.take("and"):
            value = as_bool(both(truth(value), truth(self.negation())))
        return value

    def negation(self) -> Value:
        return as_bool(negated(truth(self.negation()))) if self.take("not") else self.comparison()

    def comparison(self) -> Value:
        left = self.sum()
        while True:
            if self.take("is"):
                inverse = self.take("not")
                found = self.test(left, self.tokens[self.at][1])
                self.at += 1
                left = as_bool(negated(found) if inverse else found)
            elif self.peek("==", "!=", "<", ">", "<=", ">="):
                sign = self.tokens[self.at][1]
                self.at += 1
                left = compared(left, sign, self.sum())
            elif self.peek("in", "not"):
                inverse = self.take("not")
                self.need("in")
                found = contained(left, self.sum())
                left = as_bool(negated(found) if inverse else found)
            else:
                return left

    def test(self, value: Value, name: str) -> Column | bool:
        if name == "defined":
            return value.defined
        if name in ("none", "None", "null"):
            return value.kind == "none" and value.defined is not False
        kinds = {"string": ("str",), "mapping": ("message", "space"), "iterable": ("str", "messages"), "number": ("int",), "sequence": ("messages",)}
        if name in kinds:
            return value.kind in kinds[name]
        if name in ("true", "false"):
            return value.column == (name == "true") if value.kind == "bool" else False
        raise ValueError(f"A template test isn't known: {name}.")

    def sum(self) -> Value:
        value = self.product()
        while self.peek("+", "-", "~"):
            sign = self.tokens[self.at][1]
            self.at += 1
            other = self.product()
            if sign == "~" or (sign == "+" and "str" in (value.kind, other.kind)):
                known = value.known + other.known if isinstance(value.known, str) and isinstance(other.known, str) else None
                value = Value("str", F.concat(text_of(value), text_of(other)), known)
            elif value.kind == other.kind == "int":
                value = Value("int", value.column + other.column if sign == "+" else value.column - other.column)
            else:
                raise ValueError(f"A template can't do {value.kind} {sign} {other.kind}.")
        return value

    def product(self) -> Value:
        value = self.unary()
        while self.peek("*", "//", "%"):
            sign = self.tokens[self.at][1]
            self.at += 1
            other = self.unary()
            if not value.kind == other.kind == "int":
                raise ValueError(f"A template can't do {value.kind} {sign} {other.kind}.")
            made = {"*": lambda a, b: a * b, "//": lambda a, b: F.floor(a / b).cast("int"), "%": lambda a, b: F.pmod(a, b)}[sign]
            value = Value("int", made(value.column, other.column))
        return value

    def unary(self) -> Value:
        if self.take("-"):
            value = self.unary()
            return Value("int", -value.column, None if value.known is None else -value.known)
        value = self.primary()
        while True:
            if self.take("."):
                name = self.tokens[self.at][1]
                self.at += 1
                value = self.method(value, name) if self.take("(") else attribute(value, name)
            elif self.take("["):
                value = self.item(value)
            elif self.take("|"):
                name = self.tokens[self.at][1]
                self.at += 1
                value = filtered(value, name, self.arguments() if self.take("(") else [])
            else:
                return value

    def primary(self) -> Value:
        if self.at >= len(self.tokens):
            raise ValueError("A template expression ends too early.")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return literal(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return literal(int(text))
        if text == "(":
            value = self.choice()
            self.need(")")
            return value
        if text in ("true", "True", "false", "False"):
            return literal(text.lower() == "true")
        if text in ("none", "None"):
            return NONE
        if kind == "name":
            if text == "raise_exception" and self.take("("):
                said = self.arguments()
                return Value("str", F.raise_error(text_of(said[0])).cast("string"))
            if text == "namespace" and self.take("("):
                return Value("space", fields=self.named())
            return self.scope.get(text, UNDEFINED)
        raise ValueError(f"A template expression can't begin with {text!r}.")

    def arguments(self) -> list[Value]:
        out = []
        while not self.take(")"):
            out.append(self.choice())
            self.take(",")
        return out

    def named(self) -> dict[str, Value]:
        out = {}
        while not self.take(")"):
            name = self.tokens[self.at][1]
            self.at += 1
            self.need("=")
            out[name] = self.choice()
            self.take(",")
        return out

    def item(self, value: Value) -> Value:
        start = None if self.peek(":") else self.choice()
        if self.take(":"):
            stop = None if self.peek("]") else self.choice()
            self.need("]")
            return sliced(value, start, stop)
        self.need("]")
        if value.kind in ("message", "space") and isinstance(start.known, str):
            return attribute(value, start.known)
        if value.kind == "messages" and start.kind == "int":
            at = F.when(start.column >= 0, start.column + 1).otherwise(start.column)
            return Value("message", F.try_element_at(value.column, at))
        if value.kind == "parts" and start.kind == "int":
            at = F.when(start.column >= 0, start.column + 1).otherwise(start.column)
            return Value("str", F.try_element_at(value.column, at))
        raise ValueError(f"A template can't take an item of {value.kind}.")

    def method(self, value: Value, name: str) -> Value:
        given = self.arguments()
        if name == "get" and value.kind in ("message", "space"):
            found = attribute(value, given[0].known)
            return found if found.defined is not False or len(given) < 2 else given[1]
        if value.kind != "str":
            raise ValueError(f"A template can't call {name} of {value.kind}.")
        text = value.column
        if name in ("strip", "lstrip", "rstrip"):
            marks = r"\s" if not given else "[" + re.sub(r"([\\\]\[^-])", r"\\\1", given[0].known) + "]"
            ends = {"strip": f"(?U)^{marks}+|{marks}+$", "lstrip": f"(?U)^{marks}+", "rstrip": f"(?U){marks}+$"}
            return Value("str", F.regexp_replace(text, ends[name], ""))
        if name in ("startswith", "endswith"):
            return Value("bool", text.startswith(given[0].column) if name == "startswith" else text.endswith(given[0].column))
        if name in ("upper", "lower"):
            return Value("str", getattr(F, name)(text))
        if name == "replace":
            return Value("str", F.replace(text, given[0].column, given[1].column))
        if name == "split" and given and isinstance(given[0].known, str):
            return Value("parts", F.split(text, f"\\Q{given[0].known}\\E", -1))
        raise ValueError(f"A template method isn't known: {name}.")


def attribute(value: Value, name: str) -> Value:
    if value.kind == "message":
        if name in ("role", "content"):
            return Value("str", F.coalesce(value.column[name], F.lit("")))
        return UNDEFINED
    if value.kind == "space":
        return value.fields.get(name, UNDEFINED)
    if value.kind == "none":
        return UNDEFINED
    raise ValueError(f"A template can't take {name} of {value.kind}.")


def sliced(value: Value, start: Value | None, stop: Value | None) -> Value:
    if value.kind not in ("messages", "str"):
        raise ValueError(f"A template can't slice {value.kind}.")
    size = F.size(value.column) if value.kind == "messages" else F.length(value.column)
    place = lambda v: F.when(v.column < 0, F.greatest(size + v.column, F.lit(0))).otherwise(F.least(v.column, size))
    first = F.lit(0) if start is None else place(start)
    last = size if stop is None else place(stop)
    count = F.greatest(last - first, F.lit(0))
    return replace(value, known=None, column=F.slice(value.column, first + 1, count) if value.kind == "messages" else F.substring(value.column, first + 1, count))


def compared(left: Value, sign: str, right: Value) -> Value:
    if left.kind != right.kind or left.kind in ("none", "message", "messages", "space"):
        same = left.kind == right.kind == "none"
        if sign not in ("==", "!="):
            raise ValueError(f"A template can't compare {left.kind} and {right.kind}.")
        return literal(same if sign == "==" else not same)
    made = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}[sign]
    if left.known is not None and right.known is not None:
        return literal(made(left.known, right.known))
    found = Value("bool", made(left.column, right.column))
    return found if left.defined is True and right.defined is True else as_bool(both(both(left.defined, right.defined), found.column))


def contained(left: Value, right: Value) -> Column | bool:
    if right.kind == "str" and left.kind == "str":
        return F.contains(right.column, left.column)
    if right.kind == "message" and isinstance(left.known, str):
        return left.known in ("role", "content")
    if right.kind in ("none", "space"):
        return isinstance(left.known, str) and left.known in right.fields
    raise ValueError(f"A template can't look for {left.kind} in {right.kind}.")


def filtered(value: Value, name: str, given: list[Value]) -> Value:
    if name == "default":
        return merged([(value.defined, value)], given[0]) if value.kind != "none" else given[0]
    if name in ("length", "count"):
        return Value("int", F.size(value.column) if value.kind == "messages" else F.length(value.column))
    if name == "string":
        return Value("str", text_of(value))
    if value.kind == "str":
        if name == "trim":
            return Value("str", strip(value.column))
        if name in ("upper", "lower"):
            return Value("str", getattr(F, name)(value.column))
        if name in ("safe", "e"):
            return value
    raise ValueError(f"A template filter isn't known: {name} of {value.kind}.")


def merged(cases: list[tuple[Column | bool, Value]], other: Value) -> Value:
    """The value of the first case that holds."""
    open_ = []
    for condition, value in cases:
        if condition is True:
            other = value
            break
        if condition is not False:
            open_.append((condition, value))
    if not open_:
        return other
    values = [v for _, v in open_] + [other]
    kinds = {v.kind for v in values if v.kind != "none"}
    if len(kinds) > 1:
        raise ValueError(f"A template name is {' or '.join(sorted(kinds))}.")
    if not kinds:
        return other
    kind = kinds.pop()
    if kind == "space":
        return replace(other, fields={n: merged([(c, v.fields.get(n, UNDEFINED)) for c, v in open_], other.fields.get(n, UNDEFINED)) for n in {n for v in values for n in v.fields}})
    column = defined = None
    for condition, value in open_:
        has = F.lit(value.defined) if isinstance(value.defined, bool) else value.defined
        has = has if value.kind != "none" else F.lit(False)
        held = value.column if value.kind != "none" else F.lit(None)
        column = F.when(condition, held) if column is None else column.when(condition, held)
        defined = F.when(condition, has) if defined is None else defined.when(condition, has)
    last = other.defined if other.kind != "none" else False
    column = column if other.kind == "none" else column.otherwise(other.column)
    every = all(v.kind != "none" and v.defined is True for v in values)
    return Value(kind, column, defined=True if every else defined.otherwise(F.lit(last) if isinstance(last, bool) else last))


# Blocks.
@dataclass
class Block:
    kind: str
    text: str = ""
    parts: list = field(default_factory=list)


def blocks_of(source: str) -> list[Block]:
    """The template as a tree; a line break behind a statement and space in front of one on its
    line don't count, nor does any space on the side of a minus."""
    flat: list[Block] = []
    at, cut_next, after_statement = 0, False, False

    def add(text: str, cut_end: bool, statement: bool) -> None:
        nonlocal cut_next, after_statement
        if cut_next:
            text = text.lstrip()
        elif after_statement and text.startswith("\n"):
            text = text[1:]
        if cut_end:
            text = text.rstrip()
        elif statement:
            text = re.sub(r"(^|\n)[ \t]+\Z", r"\1", text) if "\n" in text or not flat else text
        if text:
            flat.append(Block("text", text))

    for found in BLOCK.finditer(source):
        statement = found["stmt"] is not None
        comment = not statement and found["expr"] is None
        add(source[at : found.start()], (found["cut"] or found["ecut"]) == "-", statement or comment)
        if statement:
            flat.append(Block("stmt", found["stmt"].strip()))
        elif not comment:
            flat.append(Block("expr", found["expr"].strip()))
        cut_next, after_statement = (found["after"] or found["eafter"]) == "-", statement or comment
        at = found.end()
    add(source[at:], False, False)
    out, rest = tree(flat, 0, ())
    if rest < len(flat):
        raise ValueError(f"A template statement has no beginning: {flat[rest].text}.")
    return out


def tree(flat: list[Block], at: int, ends: tuple[str, ...]) -> tuple[list[Block], int]:
    out = []
    while at < len(flat):
        block = flat[at]
        word = block.text.split(None, 1)[0] if block.kind == "stmt" and block.text else ""
        if word in ends:
            return out, at
        at += 1
        if block.kind != "stmt":
            out.append(block)
        elif word == "if":
            cases = [(block.text[2:], None)]
            while True:
                body, at = tree(flat, at, ("elif", "else", "endif"))
                cases[-1] = (cases[-1][0], body)
                if at >= len(flat):
                    raise ValueError("A template's if has no end.")
                said = flat[at].text
                at += 1
                if said.startswith("endif"):
                    break
                cases.append((said[4:] if said.startswith("elif") else "", None))
            out.append(Block("if", parts=cases))
        elif word == "for":
            body, at = tree(flat, at, ("endfor",))
            if at >= len(flat):
                raise ValueError("A template's for has no end.")
            out.append(Block("for", block.text[3:], body))
            at += 1
        elif word == "set":
            out.append(Block("set", block.text[3:]))
        elif word not in ("generation", "endgeneration"):
            raise ValueError(f"A template statement isn't known: {word}.")
    if ends:
        return out, at
    return out, at


def value_of(source: str, scope: dict[str, Value]) -> Value:
    return Reader(lexed(source), scope).whole()


def changed_spaces(body: list[Block], scope: dict[str, Value]) -> set[tuple[str, str]]:
    """(namespace, attribute) that the statements of a body set."""
    out = set()
    for block in body:
        if block.kind == "set":
            target = block.text.split("=", 1)[0].strip()
            if "." in target:
                out.add(tuple(target.split(".", 1)))
        elif block.kind == "if":
            for _, inner in block.parts:
                out |= changed_spaces(inner, scope)
        elif block.kind == "for":
            out |= changed_spaces(block.parts, scope)
    return out


def run(body: list[Block], scope: dict[str, Value]) -> Column:
    """The text of a body; ``scope`` takes what it sets."""
    out = [F.lit("")]
    for block in body:
        if block.kind == "text":
            out.append(F.lit(block.text))
        elif block.kind == "expr":
            out.append(text_of(value_of(block.text, scope)))
        elif block.kind == "set":
            target, source = (x.strip() for x in block.text.split("=", 1))
            value = value_of(source, scope)
            if "." in target:
                space, name = target.split(".", 1)
                if scope.get(space, NONE).kind != "space":
                    raise ValueError(f"A template sets an attribute of {space}, which is no namespace.")
                scope[space] = replace(scope[space], fields=scope[space].fields | {name: value})
            else:
                scope[target] = value
        elif block.kind == "if":
            out.append(run_if(block, scope))
        else:
            out.append(run_for(block, scope))
    return F.concat(*out) if len(out) > 1 else out[0]


def run_if(block: Block, scope: dict[str, Value]) -> Column:
    cases = []
    for source, body in block.parts:
        condition = truth(value_of(source, scope)) if source.strip() else True
        if condition is False:
            continue
        inner = dict(scope)
        cases.append((condition, run(body, inner), inner))
        if condition is True:
            break
    fallback = (F.lit(""), dict(scope))
    if cases and cases[-1][0] is True:
        fallback = (cases[-1][1], cases[-1][2])
        cases = cases[:-1]
    names = {n for _, _, inner in cases for n in inner} | set(fallback[1])
    for name in names:
        old = fallback[1].get(name, UNDEFINED)
        values = [(c, inner.get(name, UNDEFINED)) for c, _, inner in cases]
        if any(v is not old for _, v in values) or old is not scope.get(name):
            scope[name] = merged(values, old)
    text = None
    for condition, made, _ in cases:
        text = F.when(condition, made) if text is None else text.when(condition, made)
    return fallback[0] if text is None else text.otherwise(fallback[0])


def run_for(block: Block, scope: dict[str, Value]) -> Column:
    found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*?)(?:\s+if\s+(.*))?\s*", block.text, re.S)
    if not found:
        raise ValueError(f"A template loop isn't understood: {block.text}.")
    name, source, condition = found.groups()
    over = value_of(source, scope)
    if over.kind == "none":
        return F.lit("")
    if over.kind != "messages":
        raise ValueError(f"A template can't loop over {over.kind}.")
    items = over.column
    if condition:
        def holds(m: Column) -> Column:
            found = truth(value_of(condition, scope | {name: Value("message", m)}))
            return F.lit(found) if isinstance(found, bool) else found

        items = F.filter(items, holds)
    changed = sorted(changed_spaces(block.parts, scope))

    def inner(m: Column, i: Column, size: Column, spaces: dict[str, Value]) -> dict[str, Value]:
        loop = Value("space", fields={"index0": Value("int", i), "index": Value("int", i + 1), "first": Value("bool", i == 0), "last": Value("bool", i == size - 1), "length": Value("int", size), "revindex": Value("int", size - i), "revindex0": Value("int", size - i - 1)})
        return scope | spaces | {name: Value("message", m), "loop": loop}

    if not changed:
        return bound(items, lambda all_: F.array_join(F.transform(all_, lambda m, i: run(block.parts, inner(m, i, F.size(all_), {}))), ""))
    first = {f"{s}_{a}": scope[s].fields[a] for s, a in changed if s in scope and a in scope[s].fields}
    if len(first) < len(changed):
        raise ValueError("A template's loop sets a namespace attribute that has no first value.")

    def carried(state: Column) -> dict[str, Value]:
        out: dict[str, Value] = {}
        for s, a in changed:
            held = out.get(s, scope[s])
            out[s] = replace(held, fields=held.fields | {a: Value(scope[s].fields[a].kind, state[f"{s}_{a}"])})
        return out

    def step(size: Column) -> Callable[[Column, Column], Column]:
        def one(state: Column, x: Column) -> Column:
            local = inner(x["m"], x["i"], size, carried(state))
            text = run(block.parts, local)
            kept = [local[s].fields[a].column.alias(f"{s}_{a}") for s, a in changed]
            return F.struct(F.concat(state["text"], text).alias("text"), *kept)

        return one

    numbered = F.transform(items, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    start = F.struct(F.lit("").alias("text"), *(v.column.alias(n) for n, v in first.items()))
    folded = bound(numbered, lambda all_: F.aggregate(all_, start, step(F.size(all_))))
    for s, a in changed:
        scope[s] = replace(scope[s], fields=scope[s].fields | {a: Value(scope[s].fields[a].kind, folded[f"{s}_{a}"])})
    return folded["text"]


def compile_template(source: str, bos: str | None = None, eos: str | None = None, add_generation_prompt: bool = False, **more: str | bool | int) -> Callable[[Column], Column]:
    """From a template to what makes a column of texts of a column of messages (role, content)."""
    body = blocks_of(source)

    def rendered(messages: Column) -> Column:
        scope = {k: literal(v) for k, v in more.items()} | {"messages": Value("messages", messages), "add_generation_prompt": literal(add_generation_prompt)}
        scope |= {k: literal(v) for k, v in (("bos_token", bos), ("eos_token", eos)) if v is not None}
        return run(body, scope)

    return rendered
