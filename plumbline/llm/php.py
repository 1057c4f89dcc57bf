"""Recognition of PHP source (up to the syntax of 8.3) by token shapes; see ``shapes``."""

from __future__ import annotations

import re

from plumbline.llm.shapes import TERNARY_TYPED, Codes, Invalid, Reducer, flags_of, fold_ternaries, group_class

# The language's reserved words that have a place of their own in the grammar below.
WORDS = (
    "if elseif else endif while endwhile for endfor foreach endforeach as do switch endswitch case default break continue "
    "return echo print function fn use class interface trait enum extends implements abstract final private protected public "
    "readonly static var const global unset isset empty list array new clone instanceof insteadof throw try catch finally "
    "namespace goto declare enddeclare match yield exit die include include_once require require_once and or xor"
).split()
K = {w: chr(0x100 + i) for i, w in enumerate(WORDS)}
NAMED = chr(0x1F0)  # "function" with a name

_WORD = r"[A-Za-z_\x80-￿\U00010000-\U0010ffff][\w\x80-￿\U00010000-\U0010ffff]*"
_COMMENT = r"(?:\#(?!\[)|//)[^\n\r?]*(?:\?(?!>)[^\n\r?]*)*|/\*.*?\*/"
_TOKENS = (
    r"\s+|" + _COMMENT + r"|\$" + _WORD + r"|'(?:[^'\\]++|\\.)*+'|\?>\n?.*?(?:<\?(?:php\b|=|(?!xml))|\Z)"
    r"|(?:\?->|->)\s*" + _WORD + r"|::\s*" + _WORD + r"|(?:function|FUNCTION)\s+&?\s*" + _WORD
    + r"|\(\s*(?:int|integer|bool|boolean|float|double|real|string|array|object|unset|binary)\s*\)"
    r"|[yY]ield\s+from\b|\\(?=\{)|\\?" + _WORD + r"(?:\\" + _WORD + r")*"
    r'|"(?:[^"\\{]++|\\.|\{\$[^{}]*\}|\{)*+"|`(?:[^`\\]++|\\.)*+`'
    r"|0[xX][0-9a-fA-F_]+|0[bBoO][0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.(?!\.))?(?:[eE][+-]?\d+)?"
    r"|<=>|\*\*=|\.\.\.|<<=|>>=|\?\?=|===|!==|\?->|=>|->|::|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|==|!=|<>|<=|>=|&&|\|\||\?\?|<<|>>|\*\*|\?(?=\s*:)\s*:|\#\["
    r"|."
)
_HEREDOC = r"<<<[ \t]*(?P<q>['\"]?)(?P<l>" + _WORD + r")(?P=q)\r?\n(?:.*?\n)??[ \t]*(?P=l)(?![\w\x80-￿])"
PLAIN = re.compile(_TOKENS, re.S)
WITH_HEREDOC = re.compile("(" + _HEREDOC + "|" + _TOKENS + ")", re.S)
OPEN = re.compile(r"<\?(?:php(?![\w])|=|(?!xml|php))", re.I)
HALT = re.compile(r"__halt_compiler", re.I)


def _classify(tok: str) -> str:
    c = tok[0]
    if c == "$":
        return "v" if len(tok) > 1 else "$"
    if c.isspace():
        return ""
    if c in "#/" and tok[:2] not in ("#[", "/=") and len(tok) > 1:
        return ""
    if c in "'\"`":
        return "s" if len(tok) > 1 else "Z"
    if tok.startswith("<<<"):
        return "s"
    if tok.startswith("?>"):
        return ";h" + (K["echo"] if tok.endswith("<?=") else "")
    if c.isdigit() or c == "." and tok[1:2].isdigit():
        return "n"
    if c == "(" and len(tok) > 1:
        return "c"
    if tok[:2] == "->" or tok[:3] == "?->":
        return "m" if len(tok.lstrip("?->")) else "d"
    if tok[:2] == "::":
        return "M" if len(tok) > 2 else "D"
    if c.isalpha() or c == "_" or c == "\\" or ord(c) > 127:
        if c == "\\" and len(tok) == 1:
            return ""
        low = tok.lower()
        if low[:5] == "yield" and low[5:].strip() == "from":
            return K["yield"]
        if low in K:
            return K[low]
        if low[:8] == "function" and low[8:9].isspace():
            return NAMED
        return "i"
    if c == "?" and tok[-1] == ":":
        return "o"
    return "Z"


_FIXED = {x: x for x in "()[]{};,?&|:="} | {"+": "-", "-": "-", "!": "!", "~": "!", "@": "!", "++": "p", "--": "p", "=>": ">", "...": "r", "#[": "#["}
_FIXED |= {x: "a" for x in "+= -= *= /= .= %= &= |= ^= **= <<= >>= ??=".split()}
_FIXED |= {x: "o" for x in "=== !== == != <> <= >= && || ?? << >> ** <=> * / % ^ < > .".split()}
CODES = Codes(_classify, _FIXED)

# What a group can be read as.
EXPR, ARGS, PARAMS, FOR, CATCH, USES, ARRAY, EACH, DECL = (1 << i for i in range(9))
INDEX, ELEMENTS, ATTRS = 1, 2, 4
BLOCK, MEMBERS, ARMS, NAME, CASES, ADAPT = (1 << i for i in range(6))
P = {f: group_class("(", f) for f in (EXPR, ARGS, PARAMS, FOR, CATCH, USES, ARRAY, EACH, DECL)}
Q = {f: group_class("[", f) for f in (INDEX, ELEMENTS, ATTRS)}
B = {f: group_class("{", f) for f in (BLOCK, MEMBERS, ARMS, NAME, CASES, ADAPT)}

_k = lambda words: "[" + "".join(K[w] for w in words.split()) + "]"
NAME_ = f"[i{K['enum']}{K['readonly']}{K['match']}]"
TYPE = f"(?:\\??+[i{K['array']}{K['static']}](?:[|&](?=[i{K['array']}{K['static']}])[i{K['array']}{K['static']}])*+)"
ATTR = f"(?:\\#{Q[ATTRS]})*+"
RETURNS = f"(?::{TYPE})?+"
PREFIX = f"(?:[-!cp&]|{_k('new clone print throw include include_once require require_once')}|{K['yield']}(?=[^;,)>o|])|\\$(?=[v$]))*+"
PRIMARY = (
    f"(?:[vinsx]|{P[EXPR]}|{Q[ELEMENTS]}|{K['static']}(?=[MD{chr(0xE000)}-{chr(0xE1FF)}])|{K['new']}|{K['yield']}"
    f"|{K['isset']}{P[ARGS]}|{K['empty']}{P[EXPR]}|{_k('exit die')}{P[ARGS]}?+|{K['list']}{P[ARRAY]}|{K['array']}{P[ARRAY]}|{K['enum']}|{K['match']}|{K['readonly']}"
    f"|\\${B[NAME]}|{K['static']})"
)
SUFFIX = f"(?:[mMp]|{P[ARGS]}|{Q[INDEX]}|d(?:v|{B[NAME]}|\\$v)|D(?:\\$*+v|{B[NAME]}|{K['class']})|{B[NAME]}(?<=[v\\ue400-\\ue40f].))*+".replace("\\ue400", chr(0xE400)).replace("\\ue40f", chr(0xE40F))
INFIX = f"(?:[-o&|=a]|{_k('instanceof and or xor')})"
OPERAND = f"{PREFIX}{PRIMARY}{SUFFIX}"
E = f"(?:{OPERAND}(?:{INFIX}{OPERAND})*+)"
LIST = f"(?:{E}(?:,{E})*+)"
ARG = f"(?:r{E}|(?:{NAME_}|{_k('array list default class for if use as function')}):{E}|{E})"
PARAM = f"(?:{ATTR}{_k('public protected private readonly')}*+{TYPE}?+&?+r?+v(?:={E})?+)"
ELEMENT = f"(?:{E}>&?+{E}|r{E}|&?+{E})"
PAREN = {
    EXPR: E, ARGS: f"(?:{ARG}(?:,{ARG})*+,?|r)?", PARAMS: f"(?:{PARAM}(?:,{PARAM})*+,?)?", FOR: f"{LIST}?+;{LIST}?+;{LIST}?+",
    CATCH: f"i(?:\\|i)*+v?", USES: "(?:&?v(?:,&?v)*,?)?", ARRAY: f"(?:{ELEMENT}?(?:,{ELEMENT}?)*+)?",
    EACH: f"{E}{K['as']}(?:{E}>)?&?{E}", DECL: f"{NAME_}={E}(?:,{NAME_}={E})*",
}
SQUARE = {INDEX: f"{E}?", ELEMENTS: f"(?:{ELEMENT}?(?:,{ELEMENT}?)*+)?", ATTRS: f"i{P[ARGS]}?(?:,i{P[ARGS]}?)*,?"}
MODS = f"{_k('public protected private static abstract final readonly var')}"
VARS = f"v(?:={E})?+(?:,v(?:={E})?+)*+"
MEMBER = (
    f"{ATTR}(?:{MODS}*+{NAMED}{P[PARAMS]}{RETURNS}(?:{B[BLOCK]}|;)|{MODS}++{TYPE}?+{VARS};|{MODS}*+{K['const']}(?:{TYPE}(?=[^=]))?+(?:{NAME_}|{K['default']})={E}(?:,{NAME_}={E})*+;"
    f"|{K['use']}i(?:,i)*+(?:;|{B[ADAPT]})|{K['case']}{NAME_}(?:={E})?;|;)"
)
ARM = f"(?:(?:{E}(?:,{E})*+,?|{K['default']},?)>{E})"
BRACE = {MEMBERS: f"(?:{MEMBER})*+", ARMS: f"(?:{ARM}(?:,{ARM})*+,?)?", NAME: E, ADAPT: f"(?:[iM]+(?:{K['insteadof']}i(?:,i)*|{K['as']}{_k('public protected private')}?i?);)*|{_k('function const')}?i(?:{K['as']}i)?(?:,{_k('function const')}?i(?:{K['as']}i)?)*,?"}
READINGS = {"(": [(f, re.compile(x)) for f, x in PAREN.items()], "[": [(f, re.compile(x)) for f, x in SQUARE.items()], "{": [(f, re.compile(x)) for f, x in BRACE.items()]}

CLOSURE = re.compile(f"{K['static']}?{K['function']}&?{P[PARAMS]}(?:{K['use']}{P[USES]})?{RETURNS}{B[BLOCK]}|{K['match']}{P[EXPR]}{B[ARMS]}")
ARROW = re.compile(f"{K['static']}?{K['fn']}&?{P[PARAMS]}{RETURNS}>")
ANONYMOUS = re.compile(f"(?<={K['new']})\\#*{_k('readonly final')}*{K['class']}{P[ARGS]}?(?:{K['extends']}i)?(?:{K['implements']}i(?:,i)*)?{B[MEMBERS]}")
YIELD_PAIR = re.compile(f"{K['yield']}{OPERAND}>")
BAD_LEFT = re.compile("[nsx]=")

SIMPLE = re.compile(
    f"(?:{E}|{K['return']}{E}?+|{K['echo']}{LIST}|{K['global']}(?:\\$*v)(?:,\\$*v)*+|{K['static']}{VARS}|{K['unset']}{P[ARGS]}|{_k('break continue')}n?+"
    f"|{K['const']}{NAME_}={E}(?:,{NAME_}={E})*+|{K['use']}(?:{_k('function const')}|{NAMED})?+[i,{K['as']}]*+{B[ADAPT]}?+|{K['namespace']}i|{K['goto']}i|{K['declare']}{P[DECL]}|{K['use']}i?[i,{K['as']}]*\\ue800?)?+;"
)
FUNCTION = re.compile(f"{ATTR}{NAMED}{P[PARAMS]}{RETURNS}{B[BLOCK]}")
TYPE_DECL = re.compile(
    f"{ATTR}(?:{_k('abstract final readonly')}*+{K['class']}{NAME_}(?:{K['extends']}i)?(?:{K['implements']}i(?:,i)*+)?|{K['interface']}{NAME_}(?:{K['extends']}i(?:,i)*+)?"
    f"|{K['trait']}{NAME_}|{K['enum']}{NAME_}(?::i)?(?:{K['implements']}i(?:,i)*+)?){B[MEMBERS]}"
)
CASE = re.compile(f"(?:{K['case']}{E}|{K['default']})[:;]")
LABEL = re.compile("i:(?!:)")
_EXPR_GROUP, _BLOCK_GROUP = re.compile(P[EXPR]), re.compile(B[BLOCK])
_COND = {K["if"]: EXPR, K["elseif"]: EXPR, K["while"]: EXPR, K["for"]: FOR, K["foreach"]: EACH}
_ENDS = {K["while"]: K["endwhile"], K["for"]: K["endfor"], K["foreach"]: K["endforeach"]}


def _group(t: str, i: int, kind: str, flag: int) -> int:
    if i < len(t) and flags_of(t[i], kind) & flag:
        return i + 1
    raise Invalid("a group is missing")


def _statement(t: str, i: int) -> int:
    """Index behind the statement that starts at ``i``."""
    c = t[i]
    if c == ";" or c == "h":
        return i + 1
    if 0xE800 <= ord(c) < 0xE840 and flags_of(c, "{") & BLOCK:
        return i + 1
    if c in _COND:
        i = _group(t, i + 1, "(", _COND[c])
        alt = t[i : i + 1] == ":"
        if c == K["if"]:
            if alt:
                i = _until(t, i + 1, K["elseif"] + K["else"] + K["endif"])
                while t[i] == K["elseif"]:
                    i = _group(t, i + 1, "(", EXPR)
                    if t[i : i + 1] != ":":
                        raise Invalid("elseif")
                    i = _until(t, i + 1, K["elseif"] + K["else"] + K["endif"])
                if t[i] == K["else"]:
                    if t[i + 1 : i + 2] != ":":
                        raise Invalid("else")
                    i = _until(t, i + 2, K["endif"])
                return _semicolon(t, i + 1)
            i = _statement_at(t, i)
            while t[i : i + 1] == K["elseif"]:
                i = _statement_at(t, _group(t, i + 1, "(", EXPR))
            if t[i : i + 1] == K["else"] and t[i + 1 : i + 2] != ":":
                i = _statement_at(t, i + 1)
            return i
        if c == K["elseif"]:
            raise Invalid("elseif")
        if alt:
            return _semicolon(t, _until(t, i + 1, _ENDS[c]) + 1)
        return _statement_at(t, i)
    if c == K["do"]:
        i = _statement_at(t, i + 1)
        if t[i : i + 1] != K["while"]:
            raise Invalid("do")
        return _semicolon(t, _group(t, i + 1, "(", EXPR))
    if c == K["switch"]:
        i = _group(t, i + 1, "(", EXPR)
        if t[i : i + 1] == ":":
            i += 1
            while t[i : i + 1] in (";", "h"):
                i += 1
            return _semicolon(t, _cases(t, i, K["endswitch"]) + 1)
        return _group(t, i, "{", CASES)
    if c == K["try"]:
        i = _group(t, i + 1, "{", BLOCK)
        n = 0
        while t[i : i + 1] == K["catch"]:
            i = _group(t, _group(t, i + 1, "(", CATCH), "{", BLOCK)
            n += 1
        if t[i : i + 1] == K["finally"]:
            return _group(t, i + 1, "{", BLOCK)
        if not n:
            raise Invalid("try")
        return i
    if c == K["namespace"] and (j := i + 1 + (t[i + 1 : i + 2] == "i")) < len(t) and flags_of(t[j], "{") & BLOCK:
        return j + 1
    if c == K["declare"]:
        j = _group(t, i + 1, "(", DECL)
        if t[j : j + 1] == ":":
            return _semicolon(t, _until(t, j + 1, K["enddeclare"]) + 1)
        return _statement_at(t, j)
    for rule in (SIMPLE, FUNCTION, TYPE_DECL, LABEL):
        if m := rule.match(t, i):
            return m.end()
    raise Invalid("no statement")


def _statement_at(t: str, i: int) -> int:
    if i >= len(t):
        raise Invalid("a statement is missing")
    return _statement(t, i)


def _semicolon(t: str, i: int) -> int:
    if t[i : i + 1] != ";":
        raise Invalid("; is missing")
    return i + 1


def _until(t: str, i: int, stops: str) -> int:
    while i < len(t):
        if t[i] in stops:
            return i
        i = _statement(t, i)
    raise Invalid("an end is missing")


def _cases(t: str, i: int, stop: str = "") -> int:
    stops = K["case"] + K["default"] + stop
    while i < len(t):
        if stop and t[i] == stop:
            return i
        m = CASE.match(t, i)
        if not m:
            raise Invalid("case")
        i = m.end()
        while i < len(t) and t[i] not in stops:
            i = _statement(t, i)
    if stop:
        raise Invalid("an end is missing")
    return i


def _normal(t: str) -> str:
    """Closures and the like become operands, conditional operators infix ones."""
    if K["function"] in t or K["match"] in t:
        t = CLOSURE.sub("x", t)
    if K["fn"] in t:
        t = ARROW.sub("!", t)
    if K["class"] in t and K["new"] in t:
        t = ANONYMOUS.sub("i", t)
    t = fold_ternaries(t, TERNARY_TYPED)
    if K["yield"] in t:
        t = YIELD_PAIR.sub(K["yield"], t)
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
        for flag, run in ((BLOCK, lambda: _until(t + "\0", 0, "\0")), (CASES, lambda: _cases(t, 1 if t[:1] == ";" else 0))):
            try:
                run()
                flags |= flag
            except Invalid:
                pass
    return flags


REDUCER = Reducer(_read)


def codes(text: str) -> str:
    """One character for each token of the text behind its first opening tag."""
    m = OPEN.search(text)
    if not m:
        raise Invalid("no opening tag")
    start = m.end()
    first = "h" if m.start() else ""
    if m[0] == "<?=":
        first += K["echo"]
    if "<<<" in text:
        toks = [x[0] for x in WITH_HEREDOC.findall(text, start)]
    else:
        toks = PLAIN.findall(text, start)
    if HALT.search(text):
        rest: list[str] = []
        for tok in toks:
            rest.append(tok)
            if tok.lower() == "__halt_compiler":
                tail = [x for x in toks[len(rest) : len(rest) + 12] if CODES[x]][:3]
                if tail[:2] != ["(", ")"] or not tail[2:] or CODES[tail[2]][0] != ";":
                    raise Invalid("__halt_compiler")
                rest += ["(", ")", ";"]
                break
        toks = rest
    out = first + "".join(map(CODES.__getitem__, toks))
    if "Z" in out:
        raise Invalid("a character that starts no token")
    return out


def check(text: str) -> None:
    """Raise ``Invalid`` unless the text is a PHP file with an opening tag."""
    _until(_normal(REDUCER.reduce(codes(text))) + "\0", 0, "\0")
