"""Recognition of JavaScript (a classic script, up to the syntax of ES2022) by token shapes; see ``shapes``."""

from __future__ import annotations

import re

from plumbline.llm.shapes import Codes, Invalid, Reducer, flags_of, fold_ternaries, group_class

# The language's reserved words, and the contextual ones with a place in the grammar below.
WORDS = (
    "if else for while do switch case default break continue return throw try catch finally var let const function class extends "
    "new delete typeof void in of instanceof this super null true false yield await async get set static with debugger import export enum"
).split()
K = {w: chr(0x100 + i) for i, w in enumerate(WORDS)}
SOFT = "of async get set static let yield await"

_WORD = r"(?:[A-Za-z_$\x80-￿]|\\u[0-9A-Fa-f]{4})(?:[\w$\x80-￿]|\\u[0-9A-Fa-f]{4})*"
_REGEX = r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*+\])++/[A-Za-z]*"
_INNER = r"(?:[^`\\$]++|\\.|\$(?!\{)|\$\{[^{}`]*\})*+"
_TEMPLATE = r"`(?:[^`\\$]++|\\.|\$(?!\{)|\$\{(?:[^{}`'\"]++|'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|\{[^{}`]*+\}|`" + _INNER + r"`)*+\})*+`"
_OPS = r">>>=|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|\.\.\.|=>|==|!=|<=|>=|&&|\|\||\?\?|\*\*|<<|>>|\+=|-=|\*=|%=|&=|\|=|\^="
_TOKENS = (
    r"\s+|//[^\r\n  ]*|/\*.*?\*/|(?:\?\.(?!\d)|\.)\s*\#?" + _WORD
    + r"|(?:return|typeof|case|in|of|delete|void|throw|new|else|do|instanceof|yield)(?![\w$])[ \t]*" + _REGEX
    + r"|(?:" + _OPS + r"|[=(,:;!&|?{\[+\-*%~^<>])\s*" + _REGEX + r"|\#?" + _WORD
    + r"|'(?:[^'\\\r\n]++|\\(?:\r\n|.))*+'|\"(?:[^\"\\\r\n]++|\\(?:\r\n|.))*+\"|" + _TEMPLATE
    + r"|0[xX][0-9a-fA-F_]+n?|0[bBoO][0-7_]+n?|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?n?(?![\w$])"
    r"|\+\+|--|/=|\?\.(?=[(\[`])|" + _OPS + r"|."
)
TOKENS = re.compile(_TOKENS, re.S)
FIRST_REGEX = re.compile(r"\s*" + _REGEX)
_PLAIN_OPS = re.compile(_OPS + r"|[=(,:;!&|?{\[+\-*%~^<>]")


def _classify(tok: str) -> str:
    c = tok[0]
    if c.isspace() or c == "﻿":
        return "\n" if any(x in tok for x in "\n\r  ") else ""
    if c == "/" and tok[1:2] == "/" and len(tok) > 1:
        return ""
    if c == "/" and tok[1:2] == "*" and len(tok) > 3:
        return "\n" if "\n" in tok else ""
    if c == "`":
        return "t" if len(tok) > 1 else "Z"
    if c in "'\"":
        return "s" if len(tok) > 1 else "Z"
    if tok in ("?.",):
        return "Q"
    if (c == "." or tok[:2] == "?.") and not tok[1:2].isdigit():
        return "m" if len(tok) > 1 else "Z"
    if c.isdigit() or c == "." and tok[1:2].isdigit():
        return "n"
    if c.isalpha() or c in "_$#\\" or ord(c) > 127:
        if tok in K:
            return K[tok]
        word = re.match(r"[a-z]+", tok)
        if "/" in tok and word and word[0] in K:
            return K[word[0]] + "s"
        return "i" if len(tok) > 1 or c not in "#\\" else "Z"
    m = _PLAIN_OPS.match(tok)
    if m and m.end() < len(tok):
        gap = tok[m.end() :]
        return _FIXED[m[0]] + ("\n" if "\n" in gap[: len(gap) - len(gap.lstrip())] else "") + "s"
    return "Z"


_FIXED = {x: x for x in "()[]{};,?:=*"} | {"+": "-", "-": "-", "!": "!", "~": "!", "++": "p", "--": "p", "=>": ">", "...": "r", "/=": "a"}
_FIXED |= {x: "a" for x in "+= -= *= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split()}
_FIXED |= {x: "o" for x in "=== !== == != <= >= < > && || ?? << >> >>> ** / % & | ^".split()}
CODES = Codes(_classify, _FIXED)

EXPR, ARGS, PARAMS, FOR, EACH, TARGET = (1 << i for i in range(6))
ELEMENTS = 1
BLOCK, OBJECT, MEMBERS, CASES, RETURN = (1 << i for i in range(5))
P = {f: group_class("(", f) for f in (EXPR, ARGS, PARAMS, FOR, EACH, TARGET)}
Q = {f: group_class("[", f) for f in (ELEMENTS,)}
B = {f: group_class("{", f) for f in (BLOCK, OBJECT, MEMBERS, CASES, RETURN)}

_k = lambda words: "[" + "".join(K[w] for w in words.split()) + "]"
N = "\\n?"
ID = f"[i{''.join(K[w] for w in SOFT.split())}]"
KEY = f"(?:[isn{''.join(K.values())}]|{Q[ELEMENTS]})"
PREFIX = f"(?:(?:[-!p]|{_k('new delete typeof void await yield')}\\*?(?=[^;,)\\n=>.?:o])){N})*+"
PRIMARY = f"(?:[insxywt]|{_k('this super null true false of async get set static let')}|{K['new']}m|{K['import']}(?={P[ARGS]})|{K['yield']}|{K['await']}|{P[EXPR]}|{Q[ELEMENTS]}|{B[OBJECT]})"
SUFFIX = f"(?:{N}[mt]|{N}Q?{P[ARGS]}|{N}Q?{Q[ELEMENTS]}|p)*+"
INFIX = f"(?:[-o*=a]|{_k('in instanceof')})"
OPERAND = f"{PREFIX}{PRIMARY}{SUFFIX}"
E = f"(?:{OPERAND}(?:{N}{INFIX}{N}{OPERAND})*+)"
COMMA = f"(?:{E}(?:{N},{N}{E})*+)"
BIND = f"(?:{ID}|{Q[ELEMENTS]}|{B[OBJECT]})"
ITEM = f"(?:r?{N}{E})"
PARAM = f"(?:r?{BIND}(?:{N}={N}{E})?+)"
VARS = f"{N}{BIND}(?:{N}={N}{E})?+(?:{N},{N}{BIND}(?:{N}={N}{E})?+)*+"
DECL = f"{_k('var let const')}{VARS}"
FUNC = f"{P[PARAMS]}{N}{B[BLOCK]}"
PROP = f"(?:(?:{_k('get set async')}{N}|\\*{N})*+{KEY}{N}{FUNC}|{KEY}{N}:{N}{E}|{ID}(?:{N}={N}{E})?+|r{E})"
MEMBER = f"(?:(?:{K['static']}{N})?(?:{_k('get set async')}{N}|\\*{N})*{KEY}{N}{FUNC}[;\\n]*|(?:{K['static']}{N})?{KEY}(?:{N}={N}{E})?(?:[;\\n]+|$)|{K['static']}{N}{B[BLOCK]}|[;\\n])"
READINGS = {
    "(": [(EXPR, COMMA), (ARGS, f"(?:{ITEM}(?:{N},{N}{ITEM})*+{N},?{N})?"), (PARAMS, f"(?:{PARAM}(?:{N},{N}{PARAM})*+{N},?{N})?"),
          (FOR, f"(?:{DECL}|{COMMA})?{N};{N}{COMMA}?{N};{N}{COMMA}?"), (EACH, f"(?:{_k('var let const')}{N}{BIND}|{OPERAND}){N}{_k('of in')}{N}{COMMA}"), (TARGET, BIND)],
    "[": [(ELEMENTS, f"{N}(?:{ITEM}?{N},{N})*+{ITEM}?")],
    "{": [(OBJECT, f"(?:{PROP}(?:{N},{N}{PROP})*+{N},?)?"), (MEMBERS, f"(?:{MEMBER})*")],
}
READINGS = {k: [(f, re.compile(f"{N}(?:{x}){N}")) for f, x in v] for k, v in READINGS.items()}

FUNCTION = re.compile(f"(?:{K['async']})?{K['function']}{N}\\*?{N}({ID}?){N}{FUNC}")
CLASS = re.compile(f"{K['class']}{N}(i?){N}(?:{K['extends']}{N}{PREFIX}{PRIMARY}{SUFFIX}{N})?{B[MEMBERS]}")
ARROW_BLOCK = re.compile(f"(?:{K['async']})?(?:{P[PARAMS]}|{ID})>{N}{B[BLOCK]}(?![m.])")
ARROW = re.compile(f"(?:{K['async']})?(?:{P[PARAMS]}|{ID})>{N}")
BAD_LEFT = re.compile(f"(?:^|[;,\\n(])[nsxyw]{N}[=a]")
LINES = re.compile("\n+")
LABEL = re.compile(f"{ID}{N}:")
CASE = re.compile(f"{N}(?:{K['case']}{N}{COMMA}|{K['default']}){N}:{N}")
TAIL = re.compile(f"{N};|\\n|(?=\\0)|(?<=[\\n])")
SIMPLE = re.compile(f"(?:{DECL}|{K['throw']}{COMMA}|{_k('break continue')}i?|{K['debugger']}|(?![w{chr(0xE800)}-{chr(0xE83F)}]){COMMA})")
RETURNS = re.compile(f"{K['return']}(?:{COMMA})?")


def _group(t: str, i: int, kind: str, flag: int) -> int:
    if t[i : i + 1] == "\n":
        i += 1
    if i < len(t) and flags_of(t[i], kind) & flag:
        return i + 1
    raise Invalid("a group is missing")


def _skip(t: str, i: int) -> int:
    return i + 1 if t[i : i + 1] == "\n" else i


class _Script:
    """Statements of one list; ``returns`` tells whether a return stands among them outside any function."""

    def __init__(self, text: str):
        self.t, self.returns = text + "\0", False

    def block(self, i: int) -> int:
        i = _skip(self.t, i)
        j = _group(self.t, i, "{", BLOCK)
        self.returns |= bool(flags_of(self.t[i], "{") & RETURN)
        return j

    def tail(self, i: int) -> int:
        m = TAIL.match(self.t, i)
        if not m:
            raise Invalid("a statement doesn't end")
        return m.end()

    def statement(self, i: int) -> int:
        t = self.t
        i = _skip(t, i)
        c = t[i]
        if c == ";":
            return i + 1
        if c == "\0":
            raise Invalid("a statement is missing")
        if 0xE800 <= ord(c) < 0xE840 and flags_of(c, "{") & BLOCK:
            return self.block(i)
        if c == "y":
            return i + 1
        if c == K["if"]:
            i = self.statement(_group(t, i + 1, "(", EXPR))
            j = _skip(t, i)
            return self.statement(j + 1) if t[j] == K["else"] else i
        if c == K["for"]:
            i += t[i + 1] == K["await"]
            return self.statement(_group(t, i + 1, "(", FOR | EACH))
        if c in (K["while"], K["with"]):
            return self.statement(_group(t, i + 1, "(", EXPR))
        if c == K["do"]:
            i = _skip(t, self.statement(i + 1))
            if t[i] != K["while"]:
                raise Invalid("do")
            i = _group(t, i + 1, "(", EXPR)
            return i + 1 if t[i] == ";" else i
        if c == K["switch"]:
            i = _skip(t, _group(t, i + 1, "(", EXPR))
            self.returns |= bool(flags_of(t[i], "{") & RETURN)
            return _group(t, i, "{", CASES)
        if c == K["try"]:
            i = self.block(i + 1)
            j = _skip(t, i)
            if t[j] == K["catch"]:
                k = _skip(t, j + 1)
                if flags_of(t[k], "("):
                    k = _group(t, k, "(", TARGET)
                i = self.block(k)
                j = _skip(t, i)
                if t[j] == K["finally"]:
                    i = self.block(j + 1)
                return i
            if t[j] == K["finally"]:
                return self.block(j + 1)
            raise Invalid("try")
        if c == K["return"]:
            self.returns = True
            return self.tail(RETURNS.match(t, i).end())
        if m := LABEL.match(t, i):
            return self.statement(m.end())
        if m := SIMPLE.match(t, i):
            return self.tail(m.end())
        raise Invalid("no statement")

    def all(self) -> None:
        i = 0
        while True:
            while self.t[i] in "\n;":
                i += 1
            if self.t[i] == "\0":
                return
            i = self.statement(i)

    def cases(self) -> None:
        i = _skip(self.t, 0)
        while self.t[i] != "\0":
            m = CASE.match(self.t, i)
            if not m:
                raise Invalid("case")
            i = m.end()
            while True:
                while self.t[i] in "\n;":
                    i += 1
                if self.t[i] == "\0" or self.t[i] in (K["case"], K["default"]):
                    break
                i = self.statement(i)


def _normal(t: str) -> str:
    t = LINES.sub("\n", t)
    if K["function"] in t:
        t = FUNCTION.sub(lambda m: "y" if m[1] else "w", t)
    if K["class"] in t:
        t = CLASS.sub(lambda m: "y" if m[1] else "w", t)
    while ">" in t:
        t, n = ARROW_BLOCK.subn("x", t)
        t, k = ARROW.subn("!", t)
        if not n + k:
            break
    t = fold_ternaries(t)
    if BAD_LEFT.search(t):
        raise Invalid("assignment to a value")
    return t


def _read(kind: str, inner: str) -> int:
    t = _normal(inner)
    flags = 0
    for flag, rule in READINGS[kind]:
        if rule.fullmatch(t):
            flags |= flag
    if kind == "{":
        for flag, name in ((BLOCK, "all"), (CASES, "cases")):
            script = _Script(t)
            try:
                getattr(script, name)()
                flags |= flag | RETURN * script.returns
            except Invalid:
                pass
        if flags == RETURN:
            flags = 0
    return flags


REDUCER = Reducer(_read)


def codes(text: str) -> str:
    if text[:1] == "﻿":
        text = text[1:]
    if text[:2] == "#!":
        text = text[text.find("\n") :] if "\n" in text else ""
    text = ";" + text if FIRST_REGEX.match(text) else text
    out = "".join(map(CODES.__getitem__, TOKENS.findall(text)))
    if "Z" in out:
        raise Invalid("a character that starts no token")
    return out


def check(text: str) -> None:
    """Raise ``Invalid`` unless the text is a classic script."""
    script = _Script(_normal(REDUCER.reduce(codes(text))))
    script.all()
    if script.returns:
        raise Invalid("return outside a function")
