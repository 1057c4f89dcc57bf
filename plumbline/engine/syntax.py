"""Syntax trees of PHP as nested tuples; damaged statements are skipped and counted.

Expressions: (kind, line, parts...). The parser climbs operators by binding power and keeps only what dataflow
needs: names, literals, accesses, calls, assignments, branches.
"""

from __future__ import annotations

import re

NAME = r"\\?[A-Za-z_\x80-\xff][\w\x80-\xff]*(?:\\[A-Za-z_\x80-\xff][\w\x80-\xff]*)*"
TOKEN = re.compile(
    r"(?P<ws>\s+|(?:\#(?!\[)|//)[^\n?]*(?:\?(?!>)[^\n?]*)*|/\*.*?(?:\*/|\Z))|(?P<close>\?>\n?)|(?P<var>\$[A-Za-z_]\w*)|(?P<cast>\(\s*(?:int|integer|bool|boolean|float|double|string|array|object|unset|binary)\s*\))"
    r"|(?P<here><<<[ \t]*(?P<q>['\"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\r?\n.*?\n?[ \t]*(?P=tag)\b)|(?P<name>" + NAME + r")|(?P<sq>'(?:[^'\\]++|\\.)*+')|(?P<dq>\"(?:[^\"\\]++|\\.)*+\")|(?P<bt>`[^`]*`)"
    r"|(?P<num>\d[\w.]*)|(?P<op><=>|\*\*=|\.\.\.|<<=|>>=|\?\?=|===|!==|\?->|=>|->|::|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|==|!=|<>|<=|>=|&&|\|\||\?\?|<<|>>|\*\*|.)",
    re.S,
)
OPEN = re.compile(r"<\?(?:php\b|=)|<\?(?!xml)", re.I)
POWER = {"or": 1, "xor": 2, "and": 3, "=": 5, "?": 7, "??": 8, "||": 9, "&&": 10, "|": 11, "^": 12, "&": 13, "==": 14, "!=": 14, "===": 14, "!==": 14, "<>": 14, "<=>": 14, "<": 15, ">": 15, "<=": 15, ">=": 15, ".": 16, "<<": 17, ">>": 17, "+": 18, "-": 18, "*": 19, "/": 19, "%": 19, "instanceof": 21, "**": 22}
ASSIGNS = frozenset("= += -= *= /= .= %= &= |= ^= **= <<= >>= ??=".split())
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
INSIDE = re.compile(r"\{?\$(\w+)(?:\[['\"]?([\w-]+)['\"]?\]|->(\w+))?")


class Damaged(Exception):
    """A statement that cannot be read."""


def lex(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of each token; text outside of tags becomes ``html`` tokens."""
    out: list[tuple[str, str, int]] = []
    pos, line, n = 0, 1, len(text)
    while pos < n:
        m = OPEN.search(text, pos)
        end = m.start() if m else n
        if end > pos:
            out.append(("html", text[pos:end], line))
            line += text.count("\n", pos, end)
        if not m:
            break
        if m[0] == "<?=":
            out.append(("name", "echo", line))
        pos = m.end()
        while pos < n:
            t = TOKEN.match(text, pos)
            kind, value = t.lastgroup, t[0]
            if kind in ("q", "tag"):
                kind = "here"
            pos = t.end()
            if kind == "close":
                out.append(("op", ";", line))
                line += value.count("\n")
                break
            if kind == "name" and value.lower() == "__halt_compiler":
                return out  # data follows
            if kind != "ws":
                out.append((kind, value, line))
            line += value.count("\n")
    return out


# Words before a parameter that are no class.
MODIFIERS = frozenset("public private protected readonly var & ...".split())
BUILT_IN = frozenset("array string int integer float double bool boolean callable iterable object mixed self static parent null false true void never".split())


class Parser:
    def __init__(self, text: str):
        self.toks = [*lex(text), ("end", "", text.count("\n") + 1)]
        self.i, self.errors, self.depth = 0, 0, 0

    # tokens
    @property
    def kind(self) -> str:
        self.i = min(self.i, len(self.toks) - 1)
        return self.toks[self.i][0]

    @property
    def value(self) -> str:
        return self.toks[self.i][1]

    @property
    def low(self) -> str:
        return self.value.lower() if self.kind == "name" else self.value

    @property
    def line(self) -> int:
        return self.toks[self.i][2]

    def next(self) -> str:
        v = self.value
        self.i += 1
        return v

    def at(self, *values: str) -> bool:
        return self.kind in ("op", "name") and self.low in values

    def eat(self, value: str) -> bool:
        if self.at(value):
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.eat(value):
            raise Damaged(f"{value} expected, {self.value!r} found on line {self.line}")

    # statements
    def file(self) -> list:
        out = []
        while self.kind != "end":
            out += self.safe()
        return out

    def safe(self) -> list:
        start = self.i
        try:
            s = self.statement()
            return [s] if s else []
        except (Damaged, IndexError, RecursionError):
            self.errors += 1
            self.i = max(self.i, start)
            while self.kind != "end" and not self.at(";", "}"):
                self.i += 1
            if self.kind != "end":
                self.i += 1
            return []

    def block(self) -> list:
        if self.eat("{"):
            out = []
            while not self.at("}"):
                if self.kind == "end":
                    raise Damaged("}")
                out += self.safe()
            self.i += 1
            return out
        return self.safe()

    def until(self, *ends: str) -> list:
        out = []
        while not self.at(*ends):
            if self.kind == "end":
                raise Damaged(ends[0])
            out += self.safe()
        return out

    def body(self, end: str) -> list:
        if self.eat(":"):
            out = self.until(end)
            self.i += 1
            self.eat(";")
            return out
        return self.block()

    def condition(self) -> tuple:
        self.need("(")
        e = self.expr()
        self.need(")")
        return e

    def statement(self):
        line, w = self.line, self.low
        if self.kind == "html":
            self.i += 1
            return None
        if self.eat(";"):
            return None
        if self.at("{"):
            return ("block", line, self.block())
        if self.kind == "name":
            handler = getattr(self, f"do_{w}", None)
            if handler and not (self.toks[self.i + 1][1] in ("::", "(") and w in ("static", "function", "fn", "match", "enum")):
                if w != "function" or self.toks[self.i + 1][0] == "name" or self.toks[self.i + 1][1] == "&" and self.toks[self.i + 2][0] == "name":
                    self.i += 1
                    return handler(line)
        if self.eat("#"):
            pass
        e = self.expr()
        if not self.eat(";") and self.kind not in ("end", "html"):
            raise Damaged("; expected")
        return ("expr", line, e)

    def do_if(self, line):
        c = self.condition()
        if self.eat(":"):
            then = self.until("elseif", "else", "endif")
            other = []
            if self.eat("elseif"):
                other = [self.do_if(self.line)]
                return ("if", line, c, then, other)
            if self.eat("else"):
                if self.at("if"):
                    self.i += 1
                    other = [self.do_if(self.line)]
                    return ("if", line, c, then, other)
                self.eat(":")
                other = self.until("endif")
            self.eat("endif")
            self.eat(";")
            return ("if", line, c, then, other)
        then = self.block()
        other = []
        if self.eat("elseif"):
            other = [self.do_if(self.line)]
        elif self.eat("else"):
            other = [self.do_if(self.line)] if self.eat("if") else self.block()
        return ("if", line, c, then, other)

    def do_while(self, line):
        return ("loop", line, [self.condition()], self.body("endwhile"), [], False)

    def do_do(self, line):
        b = self.block()
        self.need("while")
        c = self.condition()
        self.eat(";")
        return ("loop", line, [], b, [c], True)

    def do_for(self, line):
        self.need("(")
        parts = []
        for end in (";", ";", ")"):
            some = []
            while not self.at(end):
                some.append(self.expr())
                self.eat(",")
            self.need(end)
            parts.append(some)
        return ("loop", line, parts[0] + parts[1], self.body("endfor"), parts[2], False)

    def do_foreach(self, line):
        self.need("(")
        e = self.expr()
        self.need("as")
        self.eat("&")
        first, second = self.expr(), None
        if self.eat("=>"):
            self.eat("&")
            second = self.expr()
        self.need(")")
        return ("each", line, e, first if second else None, second or first, self.body("endforeach"))

    def do_switch(self, line):
        c = self.condition()
        alt = not self.eat("{")
        if alt:
            self.need(":")
        cases = []
        while not self.at("}", "endswitch"):
            if self.eat("case"):
                self.expr()
            elif not self.eat("default"):
                raise Damaged("case")
            if not self.eat(":"):
                self.need(";")
            cases.append(self.until("case", "default", "}", "endswitch"))
        self.i += 1
        if alt:
            self.eat(";")
        return ("switch", line, c, cases)

    def do_try(self, line):
        b, catches, last = self.block(), [], []
        while self.eat("catch"):
            self.need("(")
            while not self.eat(")"):
                if self.kind == "end":
                    raise Damaged(")")
                self.i += 1
            catches.append(self.block())
        if self.eat("finally"):
            last = self.block()
        return ("try", line, b, catches, last)

    def listed(self, kind, line):
        out = []
        while not self.at(";") and self.kind not in ("end", "html"):
            out.append(self.expr())
            self.eat(",")
        self.eat(";")
        return (kind, line, out)

    def do_echo(self, line):
        return self.listed("echo", line)

    def do_return(self, line):
        return self.listed("return", line)

    def do_break(self, line):
        return self.listed("break", line)

    def do_continue(self, line):
        return self.listed("break", line)

    def do_global(self, line):
        return self.listed("global", line)

    def do_unset(self, line):
        return self.listed("unset", line)

    def do_static(self, line):
        return self.listed("exprs", line)

    def do_throw(self, line):
        return self.listed("return", line)

    def do_const(self, line):
        return self.listed("exprs", line)

    def skip(self, line):
        while not self.at(";", "{") and self.kind != "end":
            self.i += 1
        if self.at("{"):
            return ("block", line, self.block())
        self.i += 1
        return None

    def do_namespace(self, line):
        if self.kind == "name":
            name = self.next()
            if self.at("{"):
                return ("namespace", line, name, self.block())
            self.eat(";")
            return ("namespace", line, name, None)
        return self.skip(line)

    def do_use(self, line):
        while not self.eat(";") and self.kind != "end":
            self.i += 1

    def do_declare(self, line):
        self.condition_skip()
        return None if self.eat(";") else ("block", line, self.block())

    def condition_skip(self) -> None:
        self.need("(")
        depth = 1
        while depth and self.kind != "end":
            depth += self.at("(") - self.at(")")
            self.i += 1

    def params(self) -> list:
        """Names of the parameters; ``types`` keeps the class of those with one plain class as their type."""
        self.need("(")
        out, types, before = [], {}, []
        while not self.eat(")"):
            if self.kind == "var":
                name = self.next()[1:]
                words = [w for w in before if w.lower() not in MODIFIERS]
                if len(words) == 1 and re.match(r"[A-Za-z_\\]", words[0]) and words[0].lower() not in BUILT_IN:
                    types[name] = words[0]
                out.append(name)
                before = []
                if self.eat("="):
                    self.expr()
            elif self.kind == "end":
                raise Damaged(")")
            elif self.eat(","):
                before = []
            else:
                before.append(self.next())
        self.types = types
        return out

    def returns(self) -> None:
        if self.eat(":"):
            while not self.at("{", ";", "=>") and self.kind != "end":
                self.i += 1

    def do_function(self, line):
        self.eat("&")
        name = self.next()
        p = self.params()
        types = self.types
        self.returns()
        return ("function", line, name, p, self.block(), self.toks[self.i - 1][2], types)

    def do_abstract(self, line):
        return self.statement()

    do_final = do_readonly = do_abstract

    def do_class(self, line):
        return self.klass(self.next(), line)

    do_interface = do_trait = do_enum = do_class

    def klass(self, name, line):
        parent = None
        while not self.at("{"):
            if self.eat("extends"):
                parent = self.next()
            elif self.kind == "end":
                raise Damaged("{")
            else:
                self.i += 1
        self.i += 1
        methods, inits = [], []
        while not self.eat("}"):
            if self.kind == "end":
                raise Damaged("}")
            if self.eat("function"):
                at = self.line
                self.eat("&")
                m = self.next()
                p = self.params()
                types = self.types
                self.returns()
                methods.append(("function", at, m, p, [] if self.eat(";") else self.block(), self.toks[self.i - 1][2], types))
            elif self.kind == "var":
                inits.append(("expr", self.line, self.expr()))
            elif self.eat("{"):
                depth = 1
                while depth and self.kind != "end":
                    depth += self.at("{") - self.at("}")
                    self.i += 1
            else:
                self.i += 1
        return ("class", line, name, parent, methods)

    # expressions
    def expr(self, power: int = 0) -> tuple:
        self.depth += 1
        if self.depth > 150:
            self.depth = 0
            raise Damaged("too deep")
        left = self.unary()
        while True:
            op, line = self.low if self.kind in ("op", "name") else "", self.line
            if op in ASSIGNS and left[0] in ("var", "idx", "prop", "sprop", "array"):
                self.i += 1
                self.eat("&")
                left = ("assign", line, left, op, self.expr(4))
                continue
            p = POWER.get(op, 0)
            if op == "=" or not p or p <= power:
                break
            self.i += 1
            if op == "?":
                a = None if self.at(":") else self.expr()
                self.need(":")
                left = ("choose", line, left, a, self.expr(7))
            else:
                left = ("binary", line, op, left, self.expr(p - (op in ("??", "**"))))
        self.depth -= 1
        return left

    def unary(self) -> tuple:
        line, k, w = self.line, self.kind, self.low
        if k == "cast":
            return ("cast", line, self.next().strip("() \t\n"), self.unary())
        if k == "op" and w in ("!", "-", "+", "~", "@", "&", "++", "--", "..."):
            self.i += 1
            e = self.unary()
            return e if w in "@&..." else ("unary", line, w, e)
        if k == "name" and w in ("include", "include_once", "require", "require_once"):
            self.i += 1
            return ("include", line, w, self.expr(4))
        if k == "name" and w in ("print", "clone", "yield", "throw"):
            self.i += 1
            if w == "yield" and self.at(";", ")"):
                return ("literal", line, "")
            self.eat("from")
            return ("print", line, self.expr(4)) if w == "print" else self.expr(4)
        if k == "name" and w == "new":
            self.i += 1
            if self.eat("class"):
                args = self.args() if self.at("(") else []
                self.klass("", line)
                return ("new", line, "", args)
            cls = self.next() if self.kind == "name" else self.primary() and ""
            return self.suffix(("new", line, cls, self.args() if self.at("(") else []))
        return self.suffix(self.primary())

    def primary(self) -> tuple:
        line, k, v, w = self.line, self.kind, self.value, self.low
        self.i += 1
        if k == "var":
            return ("var", line, v[1:])
        if k in ("sq", "num"):
            return ("literal", line, v[1:-1] if k == "sq" else v)
        if k in ("dq", "here", "bt"):
            parts = []
            if "'" not in v[3:5] or k != "here":
                for m in INSIDE.finditer(v):
                    base = ("var", line, m[1])
                    parts.append(("idx", line, base, ("literal", line, m[2])) if m[2] else ("prop", line, base, m[3]) if m[3] else base)
            e = ("text", line, parts, v)
            return ("call", line, "shell_exec", [e]) if k == "bt" else e if parts else ("literal", line, v[1:-1])
        if v == "(":
            e = self.expr()
            self.need(")")
            return e
        if v == "[":
            return self.items(line, "]")
        if v == "$":
            if self.eat("{"):
                named = self.expr()
                self.need("}")
            else:
                named = self.unary()
            return ("named", line, named)
        if k == "name":
            if w in ("array", "list") and self.at("("):
                self.i += 1
                return self.items(line, ")")
            if w in ("exit", "die"):
                return ("exit", line, self.args() if self.at("(") else [])
            if w in ("isset", "empty"):
                return ("test", line, self.args())
            if w == "static" and self.at("function", "fn"):
                w = self.low
                self.i += 1
            if w == "function":
                self.eat("&")
                p, uses = self.params(), []
                if self.eat("use"):
                    uses = self.params()
                self.returns()
                return ("closure", line, p, uses, self.block())
            if w == "fn":
                self.eat("&")
                p = self.params()
                self.returns()
                self.need("=>")
                return ("closure", line, p, [], [("return", line, [self.expr(4)])])
            if w == "match" and self.at("("):
                self.condition()
                self.need("{")
                arms = []
                while not self.eat("}"):
                    while not self.eat("=>"):
                        if self.kind == "end":
                            raise Damaged("}")
                        if not self.eat(",") and not self.eat("default"):
                            self.expr()
                    arms.append(self.expr())
                    self.eat(",")
                return ("any", line, arms)
            return ("name", line, v)
        raise Damaged(f"no expression at {v!r}")

    def items(self, line, end):
        out = []
        while not self.eat(end):
            if self.eat(","):
                continue
            if self.kind == "end":
                raise Damaged(end)
            e, key = self.expr(), None
            if self.eat("=>"):
                key, e = e, self.expr()
            out.append((key, e))
        return ("array", line, out)

    def args(self) -> list:
        self.need("(")
        out = []
        while not self.eat(")"):
            if self.eat(","):
                continue
            if self.kind == "end":
                raise Damaged(")")
            if self.at("...") and self.toks[self.i + 1][1] == ")":
                self.i += 1
                continue
            if self.kind == "name" and self.toks[self.i + 1][1] == ":" and self.toks[self.i + 2][1] != ":":
                self.i += 2
            out.append(self.expr())
        return out

    def suffix(self, e: tuple) -> tuple:
        while True:
            line = self.line
            if self.at("["):
                self.i += 1
                key = None if self.at("]") else self.expr()
                self.need("]")
                e = ("idx", line, e, key)
            elif self.at("(") and e[0] in ("name", "var", "closure", "idx", "prop"):
                a = self.args()
                e = ("call", e[1], e[2], a) if e[0] == "name" else ("method", line, e[2], e[3], a) if e[0] == "prop" else ("dynamic", line, e, a)
            elif self.at("->", "?->"):
                self.i += 1
                if self.eat("{"):
                    self.expr()
                    self.need("}")
                    name = ""
                else:
                    name = self.next().lstrip("$")
                e = ("method", line, e, name, self.args()) if self.at("(") else ("prop", line, e, name)
            elif self.at("::"):
                self.i += 1
                name = self.next()
                cls = e[2] if e[0] == "name" else ""
                e = ("static", line, cls, name.lstrip("$"), self.args()) if self.at("(") else ("sprop", line, cls, name[1:]) if name[:1] == "$" else ("name", line, f"{cls}::{name}")
            elif self.at("++", "--"):
                self.i += 1
            else:
                return e
