"""Taint through statements and functions.

A value is a map from where it comes from to the classes of sinks it is dangerous for: sources keep all classes
until a sanitizer takes some away, so one evaluation answers for all classes. Parameters of the function under
analysis are origins too; what they reach becomes the function's summary, and calls replace parameters by their
arguments. Joining values is union of origins and of dangers, hence monotone, and summaries only grow.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from dataclasses import dataclass, field

from plumbline.engine import vocabulary as V
from plumbline.engine.syntax import Parser
from plumbline.functions import code

CLEAN: dict = {}


def join(*values: dict) -> dict:
    out: dict = {}
    for v in values:
        for k, m in v.items():
            out[k] = out.get(k, 0) | m
    return out


def masked(value: dict, mask: int) -> dict:
    return {k: m & mask for k, m in value.items() if m & mask}


@dataclass
class Summary:
    """What a function does with its parameters and what it returns."""

    returns: dict = field(default_factory=dict)
    sinks: dict = field(default_factory=dict)  # (param, class, sink, file, line, function) -> danger bit
    props: dict = field(default_factory=dict)  # property key -> value
    callees: dict = field(default_factory=dict)  # callee -> (nonce on all sites, capability on all sites)

    def key(self) -> tuple:
        fix = lambda d: tuple(sorted((str(k), str(sorted(v.items(), key=str)) if isinstance(v, dict) else str(v)) for k, v in d.items()))
        return fix(self.returns), fix(self.sinks), fix(self.props)


@dataclass
class Unit:
    """A function, a method or a file's top level."""

    key: str
    name: str
    file: str
    cls: str
    params: list
    body: list
    line: int
    last: int
    space: str = ""
    types: dict = field(default_factory=dict)


def parts(tree):
    """All nodes of a tree, outer ones first."""
    todo = [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            if x and isinstance(x[0], str):
                yield x
            todo += reversed(x)
        elif isinstance(x, list):
            todo += reversed(x)


class Plugin:
    """All files of a release, analysed to a fixpoint; ``findings`` and ``status`` tell the outcome."""

    def __init__(self, files: list[tuple[str, str]], cap: int = 32, missing_guards: bool = True, handler_entry: bool = False, presence: bool = False, graded: bool = False):
        """``handler_entry``: a finding's entry point is its function's, not its file's. Missing guards are told where no guard
        holds before a change; with ``presence`` where a function has no guard at all, whatever its callers do, with the deficit
        (0 where it is guarded otherwise) beside it. Their confidence is 0.5, with ``graded`` it grows with the deficit."""
        self.cap, self.missing_guards, self.handler_entry, self.presence, self.graded = cap, missing_guards, handler_entry, presence, graded
        self.defined: Counter[str] = Counter()
        self.units: dict[str, Unit] = {}
        self.tops: list[Unit] = []
        self.parents: dict[str, str] = {}
        self.errors = 0
        self.texts = dict(files)
        for path, text in sorted(files):
            if "<?" not in text:
                continue
            p = Parser(text)
            tree = p.file()
            self.errors += p.errors
            top: list = []
            self.collect(tree, path, "", top)
            space = next((x[2] for x in tree if x[0] == "namespace" and x[3] is None), "")
            self.tops.append(Unit(f"{path}#top", "", path, "", [], top, 1, text.count("\n") + 1, space))
        self.summaries = {k: Summary() for k in self.units}
        self.props: dict = {}
        self.findings: list[dict] = []
        self.facts: dict[str, dict] = {}
        self.contexts = self.callbacks()
        self.run()

    def collect(self, tree: list, path: str, space: str, top: list) -> None:
        for s in tree:
            if s[0] == "namespace":
                if s[3] is None:
                    space = s[2]
                else:
                    self.collect(s[3], path, s[2], top)
            elif s[0] == "function":
                full = f"{space}\\{s[2]}" if space else s[2]
                self.define(Unit(f"f:{full.lower()}", s[2], path, "", s[3], s[4], s[1], s[5], space, s[6]), top, space)
            elif s[0] == "class":
                if s[3]:
                    self.parents[s[2].lower()] = s[3].lstrip("\\").rsplit("\\", 1)[-1].lower()
                for m in s[4]:
                    self.define(Unit(f"m:{s[2].lower()}::{m[2].lower()}", m[2], path, s[2].lower(), m[3], m[4], m[1], m[5], space, m[6]), top, space)
            elif s[0] in ("if", "block") and any(x[0] in ("function", "class") for part in s[2:] if isinstance(part, list) for x in part):
                top.append(s)
                for part in s[2:]:
                    if isinstance(part, list):
                        self.collect([x for x in part if x[0] in ("function", "class")], path, space, top)
            else:
                top.append(s)

    def define(self, unit: Unit, top: list, space: str) -> None:
        self.defined[unit.key] += 1
        self.units.setdefault(unit.key, unit)  # the first definition in file order counts, whatever order files come in
        self.collect([s for s in unit.body if s[0] in ("function", "class")], unit.file, space, [])

    def function(self, full: str, space: str) -> str | None:
        """Definition that a call of a function reaches: in the namespace of the call first, then the global one; imports are not followed."""
        low, inside = full.lower(), space.lower() + "\\" if space else ""
        if low.startswith("\\"):
            names = [low[1:]]
        elif low.startswith("namespace\\"):
            names = [inside + low[10:]]
        else:
            names = [inside + low] if "\\" in low and inside else [inside + low, low]
        return next((f"f:{n}" for n in names if f"f:{n}" in self.units), None)

    def callback(self, e, cls: str) -> str | None:
        """Definition that a callback names; null where its object is only known at run time."""
        short = lambda name: name.lstrip("\\").rsplit("\\", 1)[-1].lower()
        if e[0] == "literal":
            owner, _, name = str(e[2]).rpartition("::")
            return self.method(short(owner), name.lower()) if owner else self.function("\\" + name.lstrip("\\"), "")
        if e[0] != "array" or len(e[2]) != 2:
            return None
        of, name = e[2][0][1], e[2][1][1]
        if name[0] != "literal":
            return None
        if of[0] == "var" and of[2] == "this" or of[0] == "name" and of[2].lower() in ("self::class", "static::class", "__class__"):
            owner = cls
        elif of[0] == "name" and of[2].lower().endswith("::class"):
            owner = short(of[2][:-7])
        elif of[0] in ("new", "static"):
            owner = short(of[2])
        elif of[0] == "literal":
            owner = short(str(of[2]))
        else:
            return None
        return self.method(owner, str(name[2]).lower()) if owner else None

    def callbacks(self) -> dict[str, set[str]]:
        """What the framework calls definitions for, where a registration names exactly one: shortcode, rest, block, embed, field."""
        out: dict[str, set[str]] = {}
        for unit in [*self.units.values(), *self.tops]:
            for e in parts(unit.body):
                if e[0] != "call" or "\\" in e[2].lstrip("\\") or self.function(e[2], unit.space):
                    continue
                name, args, e2 = e[2].lstrip("\\").lower(), e[3], None
                of = lambda a, key: next((v for k, v in a[2] if k and k[0] == "literal" and k[2] == key), None) if a[0] == "array" else None
                if name == "add_shortcode" and len(args) > 1:
                    kind, e2 = "shortcode", args[1]
                elif name == "register_rest_route" and len(args) > 2:
                    kind, e2 = "rest", of(args[2], "callback")
                elif name == "wp_embed_register_handler" and len(args) > 2:
                    kind, e2 = "embed", args[2]
                elif name in ("register_block_type", "register_block_type_from_metadata") and len(args) > 1:
                    kind, e2 = "block", of(args[1], "render_callback")
                key = self.callback(e2, unit.cls) if e2 else None
                if key and self.defined[key] == 1:
                    out.setdefault(key, set()).add(kind)
        for key, unit in self.units.items():
            if unit.name.lower() == "render_field" and unit.cls:
                seen, at = set(), self.parents.get(unit.cls, "")
                while at and at not in seen and at != "acf_field":
                    seen.add(at)
                    at = self.parents.get(at, "")
                if at == "acf_field":
                    out.setdefault(key, set()).add("field")
        return out

    def readers(self) -> dict[str, set[str]]:
        """Units that mention a property, by its name."""
        out: dict[str, set[str]] = {}
        for key, unit in self.units.items():
            for e in parts(unit.body):
                if e[0] in ("prop", "sprop"):
                    out.setdefault(str(e[3]), set()).add(key)
        return out

    def method(self, cls: str, name: str) -> str | None:
        """Nearest definition of a method up the hierarchy; cycles end."""
        seen = set()
        while cls and cls not in seen:
            seen.add(cls)
            if f"m:{cls}::{name}" in self.units:
                return f"m:{cls}::{name}"
            cls = self.parents.get(cls, "")
        return None

    def virtual(self, cls: str, name: str) -> list[str]:
        """Definitions a call on ``$this`` of a class may reach: the nearest above, and all of descendants."""
        below, todo = {cls}, [cls]
        while todo:
            c = todo.pop()
            for child, parent in self.parents.items():
                if parent == c and child not in below:
                    below.add(child)
                    todo.append(child)
        return sorted({k for c in below if (k := self.method(c, name))})

    def run(self) -> None:
        callers: dict[str, set] = {}
        readers = self.readers()
        queue, waiting = deque(self.units), set(self.units)
        changes, rounds, capped = dict.fromkeys(self.units, 0), 0, []
        limit = max(64, self.cap * max(1, len(self.units)))
        while queue and rounds < limit:
            rounds += 1
            k = queue.popleft()
            waiting.discard(k)
            before = self.summaries[k].key()
            walk = Walk(self, self.units[k], emit=False)
            walk.run()
            for c in walk.called:
                callers.setdefault(c, set()).add(k)
            self.summaries[k] = walk.summary
            grown: set[str] = set()
            for p, v in walk.written.items():
                new = join(self.props.get(p, CLEAN), v)
                if new != self.props.get(p, CLEAN):
                    grown.add(p.split("->", 1)[1])
                self.props[p] = new
            if walk.summary.key() != before or grown:
                changes[k] += 1
                if changes[k] > self.cap:
                    capped.append(k)
                    continue
                more = callers.get(k, set()).union(*[readers.get(p, set()) for p in grown])
                for u in sorted(more - waiting):
                    queue.append(u)
                    waiting.add(u)
        for unit in [*self.units.values(), *self.tops]:
            walk = Walk(self, unit, emit=True)
            walk.run()
            self.findings += walk.found
            self.facts[unit.key] = {"walk": walk, "unit": unit}
        self.status = {"converged": not queue and not capped, "updates": sum(changes.values()), "rounds": rounds, "capped": len(capped), "errors": self.errors}
        self.entries()
        if self.missing_guards:
            self.guards()
        self.finish()

    def entries(self) -> None:
        """Entry point of each registered handler, spread along calls for six steps, and the strongest of each file.

        Handlers are read from the whole call of a hook. ``permitted`` are those that only users with a capability
        reach: REST callbacks with a permission callback that isn't always true, and pages of the admin menu.
        """
        handler: dict[str, tuple[int, str]] = {}
        self.file_entry: dict[str, tuple[int, str]] = {}
        self.permitted: set[str] = set()
        for path, text in self.texts.items():
            for pattern, ep, rank in V.HOOKS:
                for m in re.finditer(pattern, text):
                    self.file_entry[path] = min(self.file_entry.get(path, (9, "unknown")), (rank, ep))
                    arguments = self.arguments(text, m.start())
                    if ep == "rest_api":
                        routes = [(code.callback_name(callback), permission) for callback, permission in code.endpoints(arguments)]
                        self.permitted |= {name.lower() for name, permission in routes if name and permission and not re.search(V.PUBLIC, permission)}
                        names = [name for name, _ in routes]
                    else:
                        names = [code.callback_name(x) for x in code.split_arguments(arguments)[1:2]]
                    for name in filter(None, names):
                        handler[name.lower()] = min(handler.get(name.lower(), (9, "unknown")), (rank, ep))
            for m in re.finditer(V.MENUS, text):
                at = 5 if m[1] == "add_submenu_page" else 4
                self.permitted |= {name.lower() for x in code.split_arguments(self.arguments(text, m.start()))[at : at + 1] if (name := code.callback_name(x))}
        self.handlers = dict(handler)
        best, edge = dict(handler), {}
        for f in self.facts.values():
            edge.setdefault(f["unit"].name.lower(), set()).update(f["walk"].names)
        front = set(handler)
        for _ in range(6):  # each round goes one call further, from the names whose entry point got better
            better: dict[str, tuple[int, str]] = {}
            for a in front:
                for b in edge.get(a, ()):
                    if best[a] < min(best.get(b, (9, "unknown")), better.get(b, (9, "unknown"))):
                        better[b] = best[a]
            best.update(better)
            front = set(better)
        self.entry_of = best

    @staticmethod
    def arguments(text: str, start: int) -> str:
        """The arguments of the call at ``start`` without comments, empty if it isn't closed."""
        opening = text.index("(", start)
        return code.uncommented(text[opening + 1 : max(code.balanced(text, opening) - 1, opening + 1)])

    def guards(self) -> None:
        """Missing nonce and capability checks before changes of state, with how far the lack is certain."""
        sites: dict[str, list] = {}
        for f in self.facts.values():
            for name, held in f["walk"].sites:
                sites.setdefault(name, []).append(held)
        for f in self.facts.values():
            unit, walk = f["unit"], f["walk"]
            if not walk.changes or not walk.reads or not unit.name:
                continue
            name = unit.name.lower()
            calls = sites.get(name, [])
            ep = self.entry_of.get(name, (9, "unknown"))[1]
            for kind, cls in (("nonce", "csrf"), ("capability", "auth")):
                bare = [(line, sink) for line, sink, held in walk.changes if kind not in held]
                if kind == "nonce" and not walk.superglobal:
                    continue
                if self.presence:
                    if kind not in walk.guarded:
                        certain = not bare or calls and name not in self.handlers and all(kind in held for held in calls) or kind == "capability" and (ep == "admin" or name in self.permitted)
                        line, sink, _ = walk.changes[-1]
                        self.findings.append(finding(unit.file, line, cls, f"{sink} without a {kind} check", "request", sink, [f"{sink} @ {unit.file}:{line}"], False, 0.5, unit.name, unit.file, line, 0.0 if certain else 0.85 if ep == "unknown" else 1.0))
                    continue
                if not bare:
                    continue
                if calls and name not in self.handlers and all(kind in held for held in calls):
                    continue
                if kind == "capability" and (ep == "admin" or name in self.permitted):
                    continue
                deficit = 0.85 if ep == "unknown" else 1.0
                line, sink = bare[0]
                self.findings.append(finding(unit.file, line, cls, f"{sink} without a {kind} check", "request", sink, [f"{sink} @ {unit.file}:{line}"], False, round(0.30 + 0.30 * deficit, 3) if self.graded else 0.5, unit.name, unit.file, line, deficit))

    def entry(self, f: dict) -> str:
        """Entry point of a finding: its file's strongest, or that of the innermost function around it, of equally narrow ones the last."""
        if not self.handler_entry:
            return self.file_entry.get(f["file"], (9, "unknown"))[1]
        around = [u for u in self.units.values() if u.file == f["file"] and u.line <= f["line"] <= u.last]
        inner = min(reversed(around), key=lambda u: u.last - u.line, default=None)
        return self.entry_of.get(inner.name.lower(), (9, "unknown"))[1] if inner else "unknown"

    def finish(self) -> None:
        """Best finding of each place, at most one unserialize risk for each file, entry points, and the ranking."""
        best: dict[tuple, dict] = {}
        for f in self.findings:
            k = (f["file"], f["line"], f["vuln_class"], f["sink"], f["sink_file"], f["sink_line"])
            if k not in best or f["confidence"] > best[k]["confidence"]:
                best[k] = {**f, "seq": best[k]["seq"] if k in best else len(best)}
        risk, out = set(), []
        for f in sorted(best.values(), key=lambda x: x["seq"]):
            if f["confidence"] == V.CONFIDENCE["risk"]:
                if f["file"] in risk:
                    continue
                risk.add(f["file"])
            f["entry_point"] = self.entry(f)
            out.append(f)
        self.findings = out


def finding(file, line, cls, message, source, sink, trace, across, confidence, function, sink_file, sink_line, deficit=-1.0) -> dict:
    return {"file": file, "line": line, "vuln_class": cls, "message": message, "source": source, "sink": sink, "trace": trace, "interprocedural": across, "confidence": confidence, "function": function or None, "sink_file": sink_file, "sink_line": sink_line, "guard_deficit": deficit}


class State:
    """Values by key, and the guards that hold on every path to here."""

    __slots__ = ("held", "live", "values")

    def __init__(self, values=None, held=frozenset(), live=True):
        self.values, self.held, self.live = dict(values or {}), held, live

    def copy(self) -> State:
        return State(self.values, self.held, self.live)

    @staticmethod
    def merge(states: list[State]) -> State:
        alive = [s for s in states if s.live]
        if not alive:
            return State(states[0].values, states[0].held, False)
        out = State(held=frozenset.intersection(*[s.held for s in alive]))
        for s in alive:
            for k, v in s.values.items():
                out.values[k] = join(out.values.get(k, CLEAN), v)
        for k in list(out.values):
            if any(k not in s.values for s in alive) and k.split("->")[0].split("[")[0] in V.SUPERGLOBALS:
                del out.values[k]
        return out


class Walk:
    """One pass over one unit."""

    def __init__(self, plugin: Plugin, unit: Unit, emit: bool):
        self.p, self.u, self.emit = plugin, unit, emit
        self.summary, self.written, self.called, self.names = Summary(), {}, set(), set()
        self.found: list[dict] = []
        self.changes: list[tuple] = []
        self.sites: list[tuple] = []
        self.reads = self.superglobal = False
        self.guarded: set[str] = set()
        self.typed: dict[str, list] = {}
        self.built: dict[str, tuple] = {}
        self.kinds = plugin.contexts.get(unit.key, set()) if emit else set()
        self.seeded = set(unit.params[:1]) if self.kinds & {"block", "rest", "shortcode"} else set()

    def run(self) -> None:
        values = {name: {("param", i): V.ALL} for i, name in enumerate(self.u.params)}
        given = lambda what: {("source", what): V.ALL}
        for name in self.seeded:
            values[name] = given(f"{'/'.join(sorted(self.kinds))} callback input ${name}")
        if "embed" in self.kinds and len(self.u.params) > 2:
            values[self.u.params[2]] = given(f"embed callback URL ${self.u.params[2]}")
        if "field" in self.kinds and self.u.params:
            for key in ("value", "default_value"):
                values[f"{self.u.params[0]}[{key}]"] = given(f"stored field value ${self.u.params[0]}[{key}]")
        self.block(self.u.body, State(values))

    def rendered(self, e: tuple, v: dict, line: int) -> None:
        """What a callback returns is printed: a tainted variable counts where its markup was put together, other expressions where they are returned."""
        if not self.kinds & {"block", "shortcode"}:
            return
        concrete = {k: m for k, m in v.items() if k[0] != "param"}
        if e[0] == "var" and e[2] not in self.seeded:
            if e[2] in self.built and concrete:
                at, value = self.built[e[2]]
                self.sink("xss", "render callback composition", at, value, V.CONFIDENCE["composition"])
            return
        self.sink("xss", "render callback return", line, concrete, V.CONFIDENCE["call"])

    # statements
    def block(self, body: list, s: State) -> State:
        for st in body:
            if not s.live:
                break
            s = self.statement(st, s)
        return s

    def statement(self, st: tuple, s: State) -> State:
        k, line = st[0], st[1]
        if k == "expr":
            self.value(st[2], s)
            if st[2][0] == "exit" or st[2][0] == "call" and st[2][2].lower() in V.EXITS:
                s.live = False
        elif k in ("exprs", "unset", "global"):
            for e in st[2]:
                if k == "unset" and (key := self.place(e)):
                    s.values.pop(key, None)
                elif k == "exprs":
                    self.value(e, s)
        elif k == "echo":
            for e in st[2]:
                self.sink("xss", "echo", line, self.value(e, s), V.CONFIDENCE["output"])
        elif k == "return":
            for e in st[2]:
                v = self.value(e, s)
                self.rendered(e, v, line)
                self.summary.returns = join(self.summary.returns, v)
            s.live = False
        elif k == "break":
            pass
        elif k == "block":
            return self.block(st[2], s)
        elif k == "if":
            self.value(st[2], s)
            guards = self.guards_in(st[2])
            negative = st[2][0] == "unary" and st[2][2] == "!" or st[2][0] == "binary" and any(x[0] == "unary" and x[2] == "!" for x in st[2][3:5])
            a, b = s.copy(), s.copy()
            if guards and not negative:
                a.held |= guards
            a = self.block(st[3], a)
            b = self.block(st[4], b)
            if guards and not a.live:
                b.held |= guards
            return State.merge([a, b])
        elif k == "each":
            v = self.value(st[2], s)
            body = s.copy()
            for target in (st[3], st[4]):
                if target:
                    self.store(target, v, body)
            return self.zero(s, self.block(st[5], body))
        elif k == "loop":
            for e in st[2]:
                self.value(e, s)
            once = self.block(st[3], s.copy())
            for e in st[4]:
                self.value(e, once)
            return once if st[5] else self.zero(s, once)
        elif k == "switch":
            self.value(st[2], s)
            ends = [s.copy()]
            for case in st[3]:
                ends.append(self.block(case, s.copy()))
            return State.merge(ends)
        elif k == "try":
            a = self.block(st[2], s.copy())
            ends = [a] + [self.block(c, State.merge([s, a]) if a.live else s.copy()) for c in st[3]]
            return self.block(st[4], State.merge(ends))
        return s

    @staticmethod
    def zero(before: State, after: State) -> State:
        out = State.merge([before, after])
        out.live = before.live
        return out

    def guards_in(self, e) -> frozenset:
        out = set()
        todo = [e]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                if x and x[0] == "call":
                    out |= {"nonce"} if x[2].lower() in V.NONCE else {"capability"} if x[2].lower() in V.CAPABILITY else set()
                todo += x
            elif isinstance(x, list):
                todo += x
        return frozenset(out)

    # places
    def place(self, e: tuple) -> str | None:
        if e[0] == "var":
            return e[2] or None
        if e[0] == "idx":
            base = self.place(e[2])
            return f"{base}[{e[3][2]}]" if base and e[3] and e[3][0] == "literal" else base and f"{base}[]"
        if e[0] == "prop":
            base = self.place(e[2])
            return base and f"{base}->{e[3]}"
        if e[0] == "sprop":
            return f"self->{e[3]}"
        return None

    def store(self, target: tuple, v: dict, s: State, add: bool = False) -> None:
        if target[0] == "array":
            for _, x in target[2]:
                self.store(x, v, s)
            return
        key = self.place(target)
        if not key:
            return
        if target[0] == "idx":
            base = target[2]
            while base[0] == "idx":
                base = base[2]
            if root := self.place(base):
                s.values[root] = join(s.values.get(root, CLEAN), v)
                if not root.split("->")[0] in V.SUPERGLOBALS and target[3] and target[3][0] == "literal":
                    s.values[key] = join(s.values.get(key, CLEAN), v) if add else v
            key = root
        elif add:
            s.values[key] = join(s.values.get(key, CLEAN), v)
        else:
            for old in [k for k in s.values if k.startswith(f"{key}[")]:
                del s.values[old]
            s.values[key] = v
        if key and (key.startswith("this->") or key.startswith("self->")):
            p = f"{self.u.cls}->{key.split('->', 1)[1].split('[')[0]}"
            concrete = {k: m for k, m in v.items() if k[0] != "param"}
            symbolic = {k: m for k, m in v.items() if k[0] == "param"}
            if concrete:
                self.written[p] = join(self.written.get(p, CLEAN), concrete)
            if symbolic:
                self.summary.props[p] = join(self.summary.props.get(p, CLEAN), symbolic)

    # values
    def value(self, e, s: State) -> dict:
        if not isinstance(e, tuple):
            return CLEAN
        k = e[0]
        if k in ("literal", "name"):
            return CLEAN
        if k == "var":
            if e[2] in V.SUPERGLOBALS:
                self.reads = self.superglobal = True
                return {("source", f"${e[2]}"): V.ALL}
            return s.values.get(e[2], CLEAN)
        if k == "named":  # whoever chooses the name chooses the value
            return {("source", "variable variable"): V.ALL} if self.value(e[2], s) or e[2][0] == "var" and e[2][2] in V.SUPERGLOBALS else CLEAN
        if k == "idx":
            if e[3]:
                self.value(e[3], s)
            base = e[2]
            if e[3] and e[3][0] == "literal":
                root = base
                while root[0] == "idx":
                    root = root[2]
                v = self.value(root, s)
                labels = {x[1].lstrip("$") for x in v if x[0] == "source"}
                if labels and all(e[3][2] in V.SAFE_MEMBERS.get(x, ()) for x in labels):
                    return CLEAN
            key = self.place(e)
            return s.values[key] if key in s.values else self.value(base, s)
        if k in ("prop", "sprop"):
            key = self.place(e)
            if key in s.values:
                return s.values[key]
            if key and key.split("->")[0] in ("this", "self"):
                name, cls, out, seen = key.split("->", 1)[1].split("[")[0], self.u.cls, CLEAN, set()
                while cls and cls not in seen:
                    seen.add(cls)
                    out = join(out, self.p.props.get(f"{cls}->{name}", CLEAN))
                    cls = self.p.parents.get(cls, "")
                return out
            return self.value(e[2], s) if k == "prop" else CLEAN
        if k == "text":
            return join(*[self.value(x, s) for x in e[2]])
        if k == "assign":
            v = self.value(e[4], s)
            if e[2][0] == "var":
                self.assigned(e, v)
            self.store(e[2], v, s, add=e[3] != "=")
            return v
        if k == "binary":
            a, b = self.value(e[3], s), self.value(e[4], s)
            return join(a, b) if e[2] in (".", "??", "+", "|") else CLEAN if e[2] in ("==", "!=", "===", "!==", "<", ">", "<=", ">=", "&&", "||", "and", "or", "xor", "instanceof", "<=>", "<>") else join(a, b)
        if k == "unary":
            v = self.value(e[3], s)
            return CLEAN if e[2] == "!" else v
        if k == "cast":
            v = self.value(e[3], s)
            return CLEAN if e[2].lower() in ("int", "integer", "float", "double", "bool", "boolean") else v
        if k == "choose":
            c = self.value(e[2], s)
            return join(self.value(e[3], s) if e[3] else c, self.value(e[4], s))
        if k == "array":
            return join(*[join(self.value(a, s), self.value(b, s)) for a, b in e[2]])
        if k == "any":
            return join(*[self.value(x, s) for x in e[2]])
        if k == "test":
            for x in e[2]:
                self.value(x, s)
            return CLEAN
        if k == "exit":
            for x in e[2]:
                self.sink("xss", "exit", e[1], self.value(x, s), V.CONFIDENCE["output"])
            return CLEAN
        if k == "print":
            self.sink("xss", "print", e[1], self.value(e[2], s), V.CONFIDENCE["output"])
            return CLEAN
        if k == "include":
            self.sink("lfi", e[2], e[1], self.value(e[3], s), V.CONFIDENCE["include"])
            return CLEAN
        if k == "closure":
            inner = s.copy()
            for name in e[2]:
                inner.values.pop(name, None)
            held = self.summary.returns
            self.block(e[4], inner)
            self.summary.returns = held
            return CLEAN
        if k == "call":
            return self.call(e, s)
        if k == "new":
            args = [self.value(a, s) for a in e[3]]
            key = self.p.method(e[2].lstrip("\\").rsplit("\\", 1)[-1].lower(), "__construct")
            return self.apply([key], args, e[1], s) if key else join(*args)
        if k == "method":
            return self.method(e, s)
        if k == "static":
            args = [self.value(a, s) for a in e[4]]
            cls = e[2].lstrip("\\").rsplit("\\", 1)[-1].lower()
            name = e[3].lower()
            self.note(name, s)
            if cls == "parent":
                key = self.p.method(self.p.parents.get(self.u.cls, ""), name)
                return self.apply([key], args, e[1], s) if key else join(*args)
            cls = self.u.cls if cls in ("self", "static") else cls
            keys = self.p.virtual(cls, name) if e[2].lower() == "static" else [x for x in [self.p.method(cls, name)] if x]
            return self.apply(keys, args, e[1], s) if keys else join(*args)
        if k == "dynamic":
            f = self.value(e[2], s)
            args = [self.value(a, s) for a in e[3]]
            self.sink("rce", "dynamic call", e[1], f, V.CONFIDENCE["call"])
            return join(*args)
        return join(*[self.value(x, s) for x in e[2:] if isinstance(x, tuple)])

    def assigned(self, e: tuple, v: dict) -> None:
        """Keeps the classes a variable was made of, and where markup with tainted parts was put together in it."""
        name, right = e[2][2], e[4]
        self.typed.setdefault(name, []).append(right[2].lstrip("\\").rsplit("\\", 1)[-1].lower() if right[0] == "new" and e[3] == "=" else None)
        if e[3] == ".=" or right[0] == "text" or right[0] == "binary" and right[2] == ".":
            concrete = {k: m for k, m in v.items() if k[0] != "param" and m & V.BIT["xss"]}
            if concrete:
                self.built.setdefault(name, (e[1], concrete))

    def classes_of(self, name: str) -> tuple[list[str], bool]:
        """Classes a variable's object may have, and whether classes derived from them, too; none where any assignment is of another kind."""
        if name in self.typed:
            found = self.typed[name]
            return ([] if None in found else list(dict.fromkeys(found))), False
        declared = self.u.types.get(name)
        return ([declared.lstrip("\\").rsplit("\\", 1)[-1].lower()] if declared else []), True

    def note(self, name: str, s: State) -> None:
        self.names.add(name)
        self.sites.append((name, s.held))

    def call(self, e: tuple, s: State) -> dict:
        line, full, exprs = e[1], e[2], e[3]
        name = full.lstrip("\\").rsplit("\\", 1)[-1].lower()
        args = [self.value(a, s) for a in exprs]
        own = self.p.function(full, self.u.space)
        self.note(name, s)
        if own:
            return self.apply([own], args, line, s)
        if "\\" in full.lstrip("\\"):
            return join(*args)
        if name in V.BARE_NONCE:
            s.held |= {"nonce"}
        if name in V.NONCE or name in V.CAPABILITY:
            self.guarded.add("nonce" if name in V.NONCE else "capability")
        if name in V.STATE_CHANGES:
            self.changes.append((line, name, s.held))
        if name in V.SINK_OF:
            self.call_sink(name, args, exprs, line)
        if name in V.PREDICATES or name in V.NONCE or name in V.CAPABILITY:
            return CLEAN
        if name == "apply_filters":
            return args[1] if len(args) > 1 else CLEAN
        if name in V.DECODERS:
            raw = join(*[self.raw(a, s) for a in exprs])
            return join(join(*args), {k: V.DECODERS[name] for k in raw})
        if name in V.REQUEST_SOURCES:
            self.reads = True
            if name.startswith("filter_input") and len(exprs) >= 3 and exprs[2][0] == "name" and exprs[2][2] in V.VALIDATORS:
                return CLEAN
            return {("source", f"{name}()"): V.ALL}
        if name == "getenv" and exprs and exprs[0][0] == "literal":
            return {("source", "getenv()"): V.ALL} if exprs[0][2].startswith("HTTP_") or exprs[0][2] in V.REQUEST_KEYS else CLEAN
        if name == "file_get_contents" and exprs and exprs[0][0] == "literal" and exprs[0][2] == "php://input":
            return {("source", "php://input"): V.ALL}
        if name in V.PERSISTENT_SOURCES:
            return join(*args, {("persistent", f"{name}()"): sum(V.BIT[c] for c in V.PERSISTENT_CLASSES)})
        safe = sum(V.BIT[c] for c, names in V.CLASS_SANITIZERS.items() if name in names)
        if name in V.SANITIZERS:
            return CLEAN
        return masked(join(*args), V.ALL & ~safe) if safe else join(*args)

    def raw(self, e: tuple, s: State) -> dict:
        """The value of an expression with sanitizers taken away."""
        if isinstance(e, tuple) and e[0] == "call":
            return join(*[self.raw(a, s) for a in e[3]])
        return self.value(e, s)

    def call_sink(self, name: str, args: list, exprs: list, line: int) -> None:
        cls = V.SINK_OF[name]
        i = V.SINK_ARGUMENT.get(name)
        if name == "preg_replace" and not (exprs and exprs[0][0] == "literal" and re.search(r"/[a-z]*e[a-z]*$", exprs[0][2])) and exprs and exprs[0][0] == "literal":
            return
        v = join(*(args if i is None else args[i : i + 1]))
        self.sink(cls, name, line, v, V.CONFIDENCE["call"])
        if cls == "deserial" and name == "unserialize" and not any(m & V.BIT["deserial"] for m in v.values()) and len(exprs) < 2 and exprs and exprs[0][0] != "literal" and self.emit:
            self.found.append(finding(self.u.file, line, cls, "unserialize of a value that may be untrusted", "unserialize(untrusted)", name, [f"{name} @ {self.u.file}:{line}"], False, V.CONFIDENCE["risk"], self.u.name, self.u.file, line))

    def method(self, e: tuple, s: State) -> dict:
        line, obj, name, exprs = e[1], e[2], e[3].lower(), e[4]
        args = [self.value(a, s) for a in exprs]
        base = self.value(obj, s)
        receiver = (self.place(obj) or "").lower()
        self.note(name, s)
        if name == "prepare" and "wpdb" in receiver:
            return CLEAN
        if name in V.REQUEST_METHODS and not receiver.startswith("this"):
            self.reads = True
            return {("source", f"{name}()"): V.ALL}
        if "wpdb" in receiver and (name in V.STATE_METHODS or name == "query" and any(w in str(exprs).upper() for w in V.WRITE_WORDS)):
            self.changes.append((line, f"$wpdb->{name}", s.held))
        if name in V.SQL_METHODS and (name in V.SQL_ONLY or any(h in f"${receiver}" for h in V.SQL_HINTS)):
            self.sink("sqli", f"$wpdb->{name}" if "wpdb" in receiver else f"->{name}", line, join(*args[:1]), V.CONFIDENCE["call"])
        if receiver == "this":
            keys = self.p.virtual(self.u.cls, name)
            return self.apply(keys, args, line, s) if keys else join(*args)
        if obj[0] == "new":
            key = self.p.method(obj[2].lstrip("\\").rsplit("\\", 1)[-1].lower(), name)
            if key:
                return self.apply([key], args, line, s)
        if obj[0] == "var":
            classes, derived = self.classes_of(obj[2])
            keys = sorted({k for x in classes for k in (self.p.virtual(x, name) if derived else [self.p.method(x, name)]) if k})
            if keys:
                return self.apply(keys, args, line, s)
        return join(base, *args)

    def apply(self, keys: list, args: list, line: int, s: State) -> dict:
        """Effects of calling any of the definitions with these arguments."""
        out: dict = {}
        for key in keys:
            self.called.add(key)
            summary = self.p.summaries.get(key)
            if not summary:
                continue
            place = lambda v: join(*[masked(args[k[1]], m) if k[1] < len(args) else CLEAN for k, m in v.items() if k[0] == "param"], {k: m for k, m in v.items() if k[0] != "param"})
            for (param, cls, sink, file, sink_line, function), _ in summary.sinks.items():
                if param < len(args):
                    self.sink(cls, sink, line, args[param], V.CONFIDENCE["across"], (file, sink_line, function))
            for prop, v in summary.props.items():
                given = place(v)
                fixed = {k: m for k, m in given.items() if k[0] != "param"}
                if fixed:
                    self.written[prop] = join(self.written.get(prop, CLEAN), fixed)
                if len(fixed) < len(given):
                    self.summary.props[prop] = join(self.summary.props.get(prop, CLEAN), {k: m for k, m in given.items() if k[0] == "param"})
            out = join(out, place(summary.returns))
        return out

    def sink(self, cls: str, sink: str, line: int, v: dict, confidence: float, at: tuple | None = None) -> None:
        file, sink_line, function = at or (self.u.file, line, self.u.name)
        for (kind, label), m in sorted(v.items(), key=str):
            if not m & V.BIT[cls]:
                continue
            if kind == "param":
                self.summary.sinks[label, cls, sink, file, sink_line, function] = V.BIT[cls]
        hit = next(((k, label) for (k, label), m in sorted(v.items(), key=str, reverse=True) if k != "param" and m & V.BIT[cls]), None)
        if hit and self.emit:
            kind, label = hit
            conf = confidence if at or cls == "xss" or kind == "source" or sink.startswith(("include", "require")) else V.CONFIDENCE["persistent"]
            trace = [f"{label} @ {self.u.file}:{line}", f"{sink} @ {file}:{sink_line}"]
            self.found.append(finding(self.u.file, line, cls, f"{label} reaches {sink}", label, sink, trace if at else trace[:1], bool(at), conf, self.u.name, file, sink_line))
