"""Plain analyses of one body: control flow, orders, dominators, forward and backward dataflow.

A body is a list of instructions ``Insn``; a state holds before an instruction.
An exceptional edge carries the state before its instruction, others the state
after it. All results are in instruction order and depend on nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any, NamedTuple

#: Steps of a search for constants after which it gives up.
BUDGET = 4096
#: The kinds of a register, each with the kinds it may stand for.
KINDS = {
    "zero": {"boolean", "byte", "char", "short", "int", "float", "null"}, "boolean": {"boolean"}, "byte": {"byte"}, "char": {"char"}, "short": {"short"}, "int": {"int"}, "float": {"float"},
    "small": {"boolean", "byte", "char", "short", "int", "float"}, "integral": {"byte", "char", "short", "int"}, "number": {"int", "float"}, "null": {"null"}, "reference": {"null", "reference"}, "long": {"long"}, "double": {"double"}, "wide": {"long", "double"},
}


class Insn(NamedTuple):
    op: str
    dst: int | None = None
    args: tuple[int, ...] = ()
    targets: tuple[int, ...] = ()
    falls: bool = True
    handlers: tuple[int, ...] = ()
    lit: Any = None


def successors(body: list[Insn]) -> list[list[tuple[int, bool]]]:
    """(successor, exceptional) of each instruction, without repeats."""
    out = []
    for i, x in enumerate(body):
        flow = ([i + 1] if x.falls and i + 1 < len(body) else []) + [t for t in x.targets if 0 <= t < len(body)]
        out.append([(t, False) for t in dict.fromkeys(flow)] + [(t, True) for t in dict.fromkeys(x.handlers) if 0 <= t < len(body)])
    return out


def reachable(body: list[Insn], start: int = 0, stop: frozenset[int] = frozenset()) -> set[int]:
    """Instructions that paths from ``start`` meet without entering ``stop``."""
    after, seen, todo = successors(body), set(), [start]
    while todo:
        i = todo.pop()
        if i < len(body) and i not in seen and i not in stop:
            seen.add(i)
            todo += [t for t, _ in after[i]]
    return seen


def blocks(body: list[Insn]) -> list[tuple[int, int]]:
    """(first, end) of the basic blocks."""
    after = successors(body)
    heads = {0} if body else set()
    for i, x in enumerate(body):
        heads |= {t for t, e in after[i] if e or t in x.targets}
        if (x.targets or not x.falls or x.handlers) and i + 1 < len(body):
            heads.add(i + 1)
    cuts = [*sorted(heads), len(body)]
    return list(zip(cuts, cuts[1:], strict=False))


def block_edges(body: list[Insn]) -> list[tuple[int, int, str]]:
    """(block, block, kind) by their first instructions; kind: fall, jump or catch."""
    cut = blocks(body)
    home = {i: a for a, b in cut for i in range(a, b)}
    out = []
    for a, b in cut:
        for i in range(a, b):
            for t, exceptional in successors(body)[i]:
                if exceptional or i == b - 1:
                    out.append((a, home[t], "catch" if exceptional else "jump" if t in body[i].targets else "fall"))
    return list(dict.fromkeys(out))


def reverse_postorder(nodes: Iterable[int], after: Callable[[int], list[int]], start: int) -> list[int]:
    seen, order, stack = {start}, [], [(start, iter(after(start)))]
    while stack:
        node, rest = stack[-1]
        nxt = next((t for t in rest if t not in seen), None)
        if nxt is None:
            order.append(node)
            stack.pop()
        else:
            seen.add(nxt)
            stack.append((nxt, iter(after(nxt))))
    return order[::-1]


def dominators(body: list[Insn]) -> dict[int, int | None]:
    """The immediate dominator of each reachable instruction; the entry has none."""
    if not body:
        return {}
    after = successors(body)
    order = reverse_postorder(range(len(body)), lambda i: [t for t, _ in after[i]], 0)
    place = {n: k for k, n in enumerate(order)}
    before: dict[int, list[int]] = {n: [] for n in order}
    for n in order:
        for t, _ in after[n]:
            before[t].append(n)
    idom: dict[int, int] = {0: 0}
    changed = True
    while changed:
        changed = False
        for n in order[1:]:
            known = [p for p in before[n] if p in idom]
            new = known[0]
            for p in known[1:]:
                while p != new:
                    if place[p] > place[new]:
                        p = idom[p]
                    else:
                        new = idom[new]
            if idom.get(n) != new:
                idom[n], changed = new, True
    return {n: None if n == 0 else idom[n] for n in sorted(order)}


def forward(body: list[Insn], entry: Any, join: Callable[[Any, Any], Any], transfer: Callable[[int, Insn, Any], Any]) -> list[Any]:
    """The state before each instruction, None where none arrives; any lattice."""
    after = successors(body)
    order = {n: k for k, n in enumerate(reverse_postorder(range(len(body)), lambda i: [t for t, _ in after[i]], 0))} if body else {}
    state: list[Any] = [None] * len(body)
    todo = set()
    if body:
        state[0], todo = entry, {0}
    while todo:
        i = min(todo, key=order.__getitem__)
        todo.discard(i)
        out = transfer(i, body[i], state[i])
        for t, exceptional in after[i]:
            came = state[i] if exceptional else out
            new = came if state[t] is None else join(state[t], came)
            if new != state[t]:
                state[t] = new
                todo.add(t)
    return state


def reaching(body: list[Insn], params: int = 0) -> list[frozenset | None]:
    """(register, definition) pairs before each instruction; parameters are defined at -1."""
    entry = frozenset((r, -1) for r in range(params))
    return forward(body, entry, lambda a, b: a | b, lambda i, x, s: s if x.dst is None else frozenset(p for p in s if p[0] != x.dst) | {(x.dst, i)})


def liveness(body: list[Insn]) -> list[set[int]]:
    """Registers that are read later on some path, before each instruction."""
    after, live = successors(body), [set() for _ in body]
    before: list[list[int]] = [[] for _ in body]
    for i, s in enumerate(after):
        for t, _ in s:
            before[t].append(i)
    todo = list(range(len(body)))
    while todo:
        i = todo.pop()
        x = body[i]
        normal = set().union(*(live[t] for t, e in after[i] if not e)) - ({x.dst} if x.dst is not None else set())
        new = normal.union(x.args, *(live[t] for t, e in after[i] if e))
        if new != live[i]:
            live[i] = new
            todo += before[i]
    return live


def register_kinds(body: list[Insn], kind: Callable[[Insn, dict], str | None]) -> list[dict | None]:
    """The kind of every register before each instruction; kinds that meet leave what both may stand for, nothing in common leaves none."""

    def meet(a: dict, b: dict) -> dict:
        out = {}
        for r in a.keys() & b.keys():
            both = KINDS[a[r]] & KINDS[b[r]]
            found = next((k for k, v in KINDS.items() if v == both), None)
            if found or a[r] == b[r]:
                out[r] = found or a[r]
        return out

    return forward(body, {}, meet, lambda i, x, s: s if x.dst is None else {**{r: k for r, k in s.items() if r != x.dst}, **({x.dst: got} if (got := kind(x, s)) else {})})


def constants(body: list[Insn], at: int, register: int, params: int = 0, budget: int = BUDGET) -> set | None:
    """All literals that a register may hold before an instruction, through copies; None if another definition reaches it or the search takes more than ``budget`` steps."""
    states = reaching(body, params)
    found, seen, todo = set(), set(), [(at, register)]
    while todo:
        budget -= 1
        if budget < 0:
            return None
        i, r = todo.pop()
        if (i, r) in seen or states[i] is None:
            continue
        seen.add((i, r))
        defs = [d for q, d in states[i] if q == r]
        if not defs:
            return None
        for d in defs:
            if d < 0:
                return None
            if body[d].op == "const":
                found.add(body[d].lit)
            elif body[d].op == "move":
                todo.append((d, body[d].args[0]))
            else:
                return None
    return found
