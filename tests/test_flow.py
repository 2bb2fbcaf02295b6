"""Analyses of random small bodies against their paths."""

import random

from corroba.flow import graphs as G


def bodies():
    rng = random.Random(3)
    for _ in range(150):
        n, out = rng.randrange(1, 8), []
        for i in range(n):
            op = rng.choice(["const", "move", "add", "if", "goto", "throwing"])
            targets = (rng.randrange(n),) if op in ("if", "goto") else ()
            args = tuple(rng.randrange(3) for _ in range({"move": 1, "add": 2, "if": 1}.get(op, 0)))
            out.append(G.Insn(op, rng.randrange(3) if op in ("const", "move", "add", "throwing") else None, args, targets, op != "goto", (rng.randrange(n),) if op == "throwing" else (), rng.randrange(2) if op == "const" else None))
        yield out


def walks(body, most=14):
    """Every path from the entry of at most ``most`` instructions, with the definitions before each."""
    after, out, todo = G.successors(body), [], [[(0, False)]]
    while todo:
        path = todo.pop()
        out.append(path)
        if len(path) < most:
            todo += [[*path, step] for step in after[path[-1][0]]]
        if len(out) > 4000:
            return None
    return out


def test_dominators_and_reachability():
    for body in bodies():
        seen = G.reachable(body)
        idom = G.dominators(body)
        assert set(idom) == seen
        dom = {}
        for n in seen:
            chain, at = set(), n
            while at is not None:
                chain.add(at)
                at = idom[at]
            dom[n] = chain
        for a in seen:
            without = G.reachable(body, 0, frozenset([a])) if a else set()
            assert {n for n in seen if a in dom[n]} == seen - without


def test_blocks_cover_and_edges_follow():
    for body in bodies():
        cut = G.blocks(body)
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(body)))
        heads, after = {a for a, _ in cut}, G.successors(body)
        for i, s in enumerate(after):
            for t, e in s:
                assert t in heads or (t == i + 1 and not e)
        assert {(a, t) for a, b in cut for i in range(a, b) for t, e in after[i] if e or i == b - 1} == {(a, b) for a, b, _ in G.block_edges(body)}


def test_dataflow_against_paths():
    tried = 0
    for body in bodies():
        paths = walks(body)
        if paths is None:
            continue
        tried += 1
        states, live = G.reaching(body), G.liveness(body)
        want_defs, want_live = [set() for _ in body], [set() for _ in body]
        seen_kinds = [[] for _ in body]
        kind = lambda x, s: ("zero" if x.lit == 0 else "small") if x.op == "const" else s.get(x.args[0]) if x.op == "move" else "int" if x.op == "add" else None
        for path in paths:
            defs, kinds = {}, {}
            for k, (i, _) in enumerate(path):
                want_defs[i] |= set(defs.items())
                seen_kinds[i].append(dict(kinds))
                x = body[i]
                for r in x.args:
                    for back in range(k, -1, -1):
                        j, came = path[back]
                        want_live[j].add(r)
                        if back and body[path[back - 1][0]].dst == r and not came:
                            break
                if k + 1 < len(path) and not path[k + 1][1] and x.dst is not None:
                    got = kind(x, kinds)
                    defs[x.dst] = i
                    kinds.pop(x.dst, None)
                    if got:
                        kinds[x.dst] = got
        for i in G.reachable(body):
            assert set(states[i]) == want_defs[i]
            assert live[i] >= want_live[i] and (len(body) > 4 or live[i] == want_live[i])
        got = G.register_kinds(body, kind)
        for i in G.reachable(body):
            for r, k in got[i].items():
                assert all(r in s and G.KINDS[k] <= G.KINDS[s[r]] for s in seen_kinds[i])
    assert tried > 50


def test_constants():
    body = [G.Insn("if", None, (3,), (3,)), G.Insn("const", 0, lit=1), G.Insn("goto", None, (), (4,), False), G.Insn("const", 0, lit=2), G.Insn("move", 1, (0,)), G.Insn("add", 2, (1, 0))]
    assert G.constants(body, 5, 1) == {1, 2}
    assert G.constants(body, 5, 1, budget=1) is None
    assert G.constants(body, 0, 3) is None
    body[3] = G.Insn("add", 0, (1, 1))
    assert G.constants(body, 5, 1) is None
