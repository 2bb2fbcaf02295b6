"""The matcher against a plain loop and the truth; alignments and hashes against plain ones."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corroba.operators import matching
from corroba.plans import matching as plans

DIR = "/root/testdata/sf0.001"


def plain_align(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_alignment():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        assert matching.align(a, b) == plain_align(a, b)
    assert matching.align(["a"] * 600, ["a"] * 600) == []


def test_hashes(spark):
    got = spark.createDataFrame([("",), ("a",), ("foobar",)], "x string").select(matching.fnv(F.col("x"))).collect()
    assert [r[0] for r in got] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]  # fixed values: published test vectors of FNV-1a


def plain_match(app, db, app_classes, db_classes):
    """The rule as loops over dictionaries."""
    app, db = {r.id: r for r in app}, {r.id: r for r in db}
    done = {}
    for column, via in (("all_h", "exact:all"), ("strings_h", "exact:strings")):
        mine, theirs = defaultdict(list), defaultdict(list)
        for r in app.values():
            if r.informative and r.id not in done and r[column] is not None:
                mine[r[column]].append(r.id)
        for r in db.values():
            theirs[r[column]].append(r.id)
        taken = {k for k, _ in done.values()}
        for h, ids in mine.items():
            if len(ids) == 1 and len(theirs[h]) == 1 and theirs[h][0] not in taken and app[ids[0]].kind == db[theirs[h][0]].kind and not db[theirs[h][0]].bridge:
                done[ids[0]] = theirs[h][0], via
    seeds = {}
    for column in ("c2", "c3"):
        mine, theirs, used = defaultdict(list), defaultdict(list), set(seeds.values())
        for r in app_classes:
            if not r.trivial and r["class"] not in seeds:
                mine[r[column]].append(r["class"])
        for r in db_classes:
            theirs[r[column]].append(r["class"])
        for h, ids in mine.items():
            if len(ids) == 1 and len(theirs[h]) == 1 and theirs[h][0] not in used:
                seeds[ids[0]] = theirs[h][0]
    same = lambda a, k: sum(x == y for x, y in zip(app[a].sketch, db[k].sketch, strict=True))
    for _ in range(8):
        votes = defaultdict(Counter)
        for c, k in seeds.items():
            votes[c][k] += 3
        for a, (k, _) in done.items():
            votes[app[a]["class"]][db[k]["class"]] += 2
        classes = {}
        for c, v in votes.items():
            (top, n), *rest = sorted(v.items(), key=lambda x: (-x[1], x[0]))
            if (not rest or rest[0][1] < n) and n * 3 >= sum(v.values()) * 2:
                classes[c] = top, seeds.get(c) == top or n >= 4
        taken = {k for k, _ in done.values()}
        proposals = []
        for a, (k, _) in done.items():
            ca, cb = app[a].callees, db[k].callees
            for i, j in plain_align([x.token for x in ca], [x.token for x in cb]):
                proposals.append((ca[i].id, cb[j].id, "callgraph"))
        by_class, keys_of = defaultdict(list), defaultdict(list)
        for r in app.values():
            if r.id not in done and not r.is_init:
                by_class[r["class"]].append(r.id)
        for r in db.values():
            if r.id not in taken:
                keys_of[r["class"]].append(r.id)
        for c, (k, strong) in classes.items():
            apps, keys = by_class[c], keys_of[k]
            for a in apps:
                alike = [x for x in keys if db[x].proto_h == app[a].proto_h]
                if sum(app[x].proto_h == app[a].proto_h for x in apps) == 1 and len(alike) == 1 and same(a, alike[0]) >= 4.8:
                    proposals.append((a, alike[0], "class:proto"))
            if strong:
                score = {(a, x): 5 * same(a, x) + 16 * (app[a].proto_h == db[x].proto_h) for a in apps for x in keys}
                for a in apps:
                    ranked = sorted(keys, key=lambda x: (-score[a, x], x))
                    if ranked:
                        best, second = score[a, ranked[0]], score[a, ranked[1]] if len(ranked) > 1 else 0
                        rival = max((score[x, ranked[0]] for x in apps if x != a), default=0)
                        if best >= 28 and best - second >= 4 and best - rival >= 4:
                            proposals.append((a, ranked[0], "mutual-best"))
        proposals = [(a, k, v) for a, k, v in proposals if a in app and k in db and a not in done and k not in taken and app[a].kind == db[k].kind and not db[k].bridge]
        of_a, of_k, first = defaultdict(set), defaultdict(set), {}
        for a, k, v in proposals:
            of_a[a].add(k)
            of_k[k].add(a)
            first.setdefault((a, k), v)
        new = {a: (k, v) for (a, k), v in first.items() if len(of_a[a]) == 1 and len(of_k[k]) == 1}
        if not new:
            break
        done |= new
    return {(a, k, v) for a, (k, v) in done.items()}


def test_fixpoint_equals_the_plain_loop_and_finds_the_truth(spark):
    methods, classes = plans._methods(spark, DIR), plans._classes(spark, DIR)
    got = {tuple(r) for r in plans.matcher_fixpoint(spark, DIR).collect()}
    assert got == plain_match(*(x.collect() for x in (*methods, *classes)))
    right = sum(a == k + plans.APP for a, k, _ in got)
    assert right / len(got) > 0.95 and right / methods[0].count() > 0.6


def test_strict_records_and_claims(spark):
    r = spark.createDataFrame([(1, "x", True), (2, "y", True), (3, "y", True), (4, "z", True), (5, "w", False)], "id int, body string, informative boolean").selectExpr("*", "true is_unique", "false bridge", "false synthetic", "true declared")
    pairs = spark.createDataFrame([(4, 9)], "id1 int, id2 int")
    assert [x.id for x in matching.strict_records(r, "id", pairs, "body").collect()] == [1]
    pair = lambda rows, schema: spark.createDataFrame(rows, schema)
    matched = pair([("a", "A"), ("a", "A"), ("b", "B"), ("b", "C"), ("c", "A"), ("c", "A")], "class string, db_class string")
    proven = pair([("a",), ("a",), ("b",), ("b",)], "class string")
    votes = pair([("a", "A"), ("b", "B"), ("c", "A")], "class string, db_class string")
    assert [tuple(x) for x in matching.class_claims(matched, proven, votes, votes).collect()] == [("a", "A")]
    access = pair([("p1", "f", "I", "F", "I", 2), ("p2", "f", "I", "F", "I", 2), ("p1", "g", "I", "G", "J", 1), ("p3", "h", "I", "H", "I", 1), ("p4", "h", "I", "K", "I", 1)], "pair string, field string, ty string, target string, target_ty string, total int")
    assert [tuple(x) for x in matching.field_votes(access).collect()] == [("f", "F")]
    build = pair([("c1", "app", "p1")], "code string, app string, profile string")
    packs = pair([("k1", "c1", None, "p1"), ("k2", "c1", None, "p1"), ("k3", "c2", None, "p1"), ("k4", "c1", "other", "p1"), ("k0", "c1", None, "p9")], "pack string, code string, app string, profile string")
    assert {x.pack: x.reason for x in matching.selected_packs(packs, build).collect()} == {"k1": None, "k2": "not the first", "k3": "other code", "k4": "other app", "k0": "other profile"}
