"""Every stage of the pipeline on its own input, against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows, names = [docs.collect()], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name.replace(" ", "-"))
        assert docs.columns == names
        rows.append(docs.collect())
    source, good, unique, apart, mixed = rows
    ids = {r.doc_id for r in good}
    clean = [r.doc_id for r in source if labels.get(r.doc_id) == 1]
    assert ids <= {r.doc_id for r in source} and sum(i in ids for i in clean) >= 0.9 * len(clean)

    first = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in unique) == sorted(first.values())

    sets, top = {r.doc_id: shingles(r.text) for r in unique}, {r.doc_id: r.doc_id for r in unique}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    assert sorted(r.doc_id for r in apart) == sorted({root(x) for x in order})

    assert {r.doc_id for r in mixed} == {r.doc_id for r in apart}
    fill, pieces = defaultdict(int), Counter()
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect():
        fill[r.sequence_id] += r.length
        pieces[r.doc_id] += r.piece == 0
    assert max(fill.values()) <= 2048 and pieces == Counter(r.doc_id for r in mixed)


def test_stages_on_awkward_rows(spark):
    """Null in any column, empty and repeated rows, one id with two texts, ties, extra columns whose names the stages use inside."""
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(1, base), (2, base + " more"), (2, "another text of the same id"), (3, None), (4, ""), (None, base + " more of it"), (5, "x " * 4000), (5, "x " * 4000), (6, base)]
    docs = spark.createDataFrame([(i, t, None, "web", 1, "a", 1.0, "b") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own string, mix_rate double, predicted string")
    kept = {name: [tuple(r)[:2] for r in stage(spark, docs, DATA).collect()] for name, stage in corpus_pipeline.STAGES[1:4]}
    assert sorted(kept["exact dedup"], key=repr) == sorted([r for r in rows if r not in ((6, base), (4, ""))], key=repr)
    assert sorted(kept["minhash near-dedup"], key=repr) == sorted([r for r in rows if r not in ((2, base + " more"), (None, base + " more of it"), (6, base))], key=repr)
    assert set(kept["mixing to target weights"]) == set(rows)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, DATA).columns == docs.columns and stage(spark, docs.limit(0), DATA).count() == 0
    assert {r.doc_id for r in corpus_pipeline.STAGES[4][1](spark, docs, DATA).collect()} == {i for i, _ in rows}
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), DATA).count() == 0
