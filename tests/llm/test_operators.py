"""The training-data operators on awkward small tables, against plain Python."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroba.llm import chat, exact_dedup, features, lang_id, mixing, near_dup, packing, quality, shingles, token_files, tokens, vp_search, warc
from corroba.llm.common import new_path
from corroba.llm.components import connected_components

BASE = " ".join(f"word{i}" for i in range(200))
TEXTS = [None, "", " \t\n", "one two", "ONE  two", "one\ntwo", BASE, BASE, BASE + " tail", BASE.replace("word100", "other"), "x" * 30_000, "a b c d e f", "A b\tc d e F", "é ß 漢字 <|endoftext|>", "  lead and trail  "]
DOCS = [(i, t, "en" if i % 3 else None, f"k{i}") for i, t in enumerate(TEXTS)] + [(6, BASE, "de", "again"), (None, "null id", "de", None)]
SCHEMA = "doc_id long, text string, lang string, digest string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_shingles_count_like_plain_sets():
    for t in TEXTS:
        assert len(shingles.shingle_set(t)) == len(plain_set(t))


def test_near_duplicates_equal_brute_force(spark, docs, none):
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(DOCS)
    sets = [(d[0], plain_set(d[1])) for d in DOCS]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for g, (k, _) in zip(group, sets, strict=True):
        if k is not None:
            least[g].append(k)
    want = sorted(((k, len(s), min(least[g], default=None)) for g, (k, s) in zip(group, sets, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert near_dup.near_duplicates(none).collect() == []


@pytest.mark.parametrize("percent", [50, 70, 85])
def test_near_duplicates_at_thresholds(spark, percent):
    """Pairs on both sides of each threshold, a chain, and rows with a null id between others."""
    rng = np.random.RandomState(percent)
    rows, n = [], 0
    for size in (6, 30, 200):
        for changed in range(0, 12):
            words = [f"g{size}x{changed}w{i}" for i in range(size)]
            other = list(words)
            for at in rng.choice(size, min(changed, size), replace=False):
                other[at] = f"new{n}a{at}"
            rows += [(n, " ".join(words)), (n + 1 if changed % 5 else None, " ".join(other))]
            n += 2
    rows += [(1000, BASE), (None, BASE + " more"), (1002, BASE + " more and"), (None, "alone here"), (1001, BASE + " more and more")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, block=8).collect()
    sets, group = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 100 * len(a & b) >= percent * len(a | b):
                group = [group[i] if g == group[j] else g for g in group]
    least = defaultdict(list)
    for g, (k, _) in zip(group, rows, strict=True):
        least[g] += [k] if k is not None else []
    want = [(k, len(s), min(least[g], default=None)) for g, s, (k, _) in zip(group, sets, rows, strict=True)]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)


def test_near_duplicates_in_blocks(spark):
    """Chains whose ends are far apart: the block tasks have to find what no star finds."""
    rows = [(i, " ".join(f"c{i // 30}w{j}" for j in range(i % 30 * 3, i % 30 * 3 + 60))) for i in range(120)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 30 * 30 for i in range(120)}


def test_near_duplicates_at_another_threshold(spark):
    """Parts of long texts at 0.80: of these pairs the 1024 smallest values share less than the floor that 85 has. The last pair lies just below 0.80."""
    assert [near_dup.chance_floor(32, 85, near_dup.INDEX_MISS), near_dup.chance_floor(1024, 85, near_dup.DEEP_MISS)] == [12, 790]
    rows = []
    for s, size in ((32, 8004), (74, 8004), (220, 8004), (263, 8004), (264, 8003)):
        words = [f"s{s}w{i}" for i in range(10004)]
        whole, part = shingles.shingle_set(" ".join(words)), shingles.shingle_set(" ".join(words[:size]))
        assert (5 * shingles.common(whole, part) >= 4 * len(whole)) == (size == 8004)
        assert s == 264 or shingles.common(whole[:1024], part[:1024]) < 790
        rows += [(2 * s, " ".join(words)), (2 * s + 1, " ".join(words[:size]))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert {r.doc_id: r.component_id for r in got.collect()} == {k: k if k == 529 else k // 2 * 2 for k, _ in rows}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in connected_components(e).collect()} == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda c: F.encode(F.substring(F.sha2(c, 256), 1, 1), "utf-8")])
@pytest.mark.parametrize("hot_rows", [0, 1000])
def test_exact_duplicates_even_when_digests_collide(spark, docs, none, digest, hot_rows):
    import re

    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for d in DOCS:
        groups[norm(d[1])].append(d[0])
    got = exact_dedup.exact_duplicates(docs, digest=digest, hot_rows=hot_rows).collect()
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(none).collect() == []


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    more = [*TEXTS, "  a b\n\n c\t\td ", "a \n b", "x\n", "\nfoo bar", "hi\x1cthere\x85a\xa0b c's d", "a  b", " ", "y" * 300 + "\n" + "z w"]
    more += ["a, A. 1, é, É. x!, .. , . word's. b,", "LONG" * 30 + ".", "². x J\u030c. J\u030c,", "\u0130, ΑΣ. ß.", "a,\nb.\n\nc,", " ,x .y", "</w>. <|endoftext|>,", "a\u0301, b", "日本, 日本. _,a_,"]
    for name, drops in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        t = Tokenizer.from_file(tokens.vocabulary(name))
        t.encode_special_tokens = True
        for text, got in zip(more, tokens.Encoder(name, drops).encode(more), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
        t.encode_special_tokens = False  # the library's own default, on request
        for text, got in zip(more, tokens.Encoder(name, drops, special=True).encode(more), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, docs, none):
    path = new_path(spark, "t")
    token_files.write_token_files(docs, path, shard_rows=4, block_bytes=200, sample_docs=5)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = {id(d): b + b"\0\0\0\0" for d, b in zip(DOCS, tokens.Encoder("byte_bpe_50k.json", False).encode([d[1] for d in DOCS]), strict=True)}
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda k: -1 if k is None else k)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert sorted((repr(r.doc_id), bytes(r.ids)) for r in got) == sorted((repr(d[0]), ids[id(d)]) for d in DOCS)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in got)
    assert [r.doc_id for r in token_files.read_token_files(spark, path, [9]).collect()] == [9]
    empty = new_path(spark, "t")
    token_files.write_token_files(none, empty)
    assert token_files.read_token_files(spark, empty).collect() == []


def test_packing(spark, docs, none):
    got = packing.pack_best_fit(docs, capacity=64).collect()
    ids = tokens.Encoder("word_bpe_49k.json", True).encode([d[1] for d in DOCS])
    assert sorted((repr(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got) == sorted((repr(d[0]), k, len(p) // 4, zlib.crc32(p)) for d, b in zip(DOCS, ids, strict=True) for k, at in enumerate(range(0, len(b) + 4, 256)) for p in [(b + b"\0\0\0\0")[at : at + 256]])
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_best_fit(none).collect() == []


def plain_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(bins) if g >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize(("range_rows", "sweeps"), [(100_000, 1), (40, 2)])
def test_packed_table_against_plain_best_fit(spark, range_rows, sweeps):
    """Sequences without gaps, few of them, whether one task or many sweep; a third of the pieces have one length."""
    rng = np.random.RandomState(1)
    lengths = np.concatenate([rng.randint(1, 257, 400), np.full(200, 77), rng.randint(1, 30, 200), np.full(30, 256)]).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack_pieces(pieces, 256, sweeps=sweeps, range_rows=range_rows).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 256
    assert len(bins) <= 1.02 * plain_best_fit(lengths, 256)


def test_one_sweep_is_best_fit():
    rng = np.random.RandomState(1)
    for _ in range(20):
        gaps, lengths = rng.randint(1, 65, 40).tolist(), sorted(rng.randint(1, 65, 60).tolist(), reverse=True)
        sweep, room, got, want = packing.Sweep(), sorted(gaps), [], []
        for at, g in enumerate(gaps):
            sweep.gap(g, at)
        for n in lengths:
            taken = sweep.piece(n)
            got.append(taken and taken[0])
            fits = [g for g in room if g >= n]
            want.append(min(fits) if fits else None)
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
        assert got == want


def test_ranks_resolve_conflicts():
    # range 0 leaves 3 gaps of 9 or more; range 1 wants them for 4 pieces of at most 4, two a gap; range 2 takes the last gap and opens for one more
    assert packing.resolve([(0, 2, 9, 3, 9), (1, 4, 4, 0, None), (2, 5, 2, 0, None)]) == [(0, 0, 2, -1, 0, 0), (1, 0, 4, 0, 0, 2), (2, 0, 4, 0, 2, 4), (2, 4, 5, -1, 0, 0)]


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", chat.PROBE_TEXT), (1, 1, "assistant", "<\\/turn> \\ ### "), (1, 1, "assistant", None), (2, None, None, "a: b"), (2, 3, "x: y\\</turn>", "### ### \\\n</turn>\n"), (3, 0, "assistant", "é" * 9000), (3, 0, "assistant", "é" * 9000), (None, 1, "user", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.format_conversations(df.withColumn("chunk", F.lit(1)))).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        loss = "".join(x for *_, r, x in mine if r == "assistant")
        assert (out[conv].turns_sha256, out[conv].loss_sha256, out[conv].loss_chars) == (hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_warc_round_trip(spark):
    pages = [(1, "https://b.org/x", "same"), (2, "http://a.org/\r\nq", "same\r\n\r\nWARC/1.1"), (3, "https://www.a.org/", "same"), (4, None, None), (5, "https://b.org/x", "same"), (5, "https://b.org/x", "same"), (None, "http://[bad", "é")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1))
    path = new_path(spark, "w")
    got = warc.capture_histories(df, path, range_rows=2).orderBy("range", "place").collect()
    assert [warc.capture_key(r.asDict()) for r in got] == sorted(warc.capture_key(r.asDict()) for r in got)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == "same" and p != 5 else "response", 5 if h == "same" and p != 5 else None) for p, _, h in pages]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    assert warc.capture_histories(df.limit(0)).collect() == []


def test_loser_tree_merges():
    rng = np.random.RandomState(2)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 50, rng.randint(0, 20)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_neighbours_are_exact_at_factor_one(spark):
    rng = np.random.RandomState(3)
    v = rng.randn(600, 8)
    v[100:300] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (1150, [1.0, 2.0]), (1200, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vp_search.nearest_neighbours(df, shard_rows=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 50))
    norm = np.sqrt(vp_search.dots(v, v))
    for q, found in got.items():
        score = vp_search.dots(v, v[q : q + 1]) / (norm[q] * norm)
        want = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:5]
        assert found == [(int(i), float(score[i])) for i in want]
    assert vp_search.nearest_neighbours(df.limit(0)).collect() == []


@pytest.mark.parametrize("own", [0, 30])
def test_neighbours_of_vectors_that_tie(spark, own):
    """Signs: more different vectors tie at the k-th cosine than a query asks for. With ``own`` the nearest vectors of query 0 bear its own id."""
    rng = np.random.RandomState(5)
    v = np.where(rng.rand(2000, 64) < 0.5, -1.0, 1.0)
    ids = np.arange(2000)
    for i in range(own):
        v[1950 + i] = v[0]
        v[1950 + i, i] *= -1
        ids[1950 + i] = 0
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vp_search.nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    norm = np.sqrt(vp_search.dots(v, v))
    for q in sorted(set(ids[ids % 50 == 0])):
        pairs = {(float(s), int(c)) for a in np.flatnonzero(ids == q) for s, c in zip(vp_search.dots(v, v[a : a + 1]) / (norm[a] * norm), ids, strict=True) if c != q}
        assert got[q] == [(c, s) for s, c in sorted(pairs, key=lambda p: (-p[0], p[1]))[:5]]


def plain_neighbours(v, ids, every):
    norm = np.sqrt(vp_search.dots(v, v))
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = vp_search.dots(v, v[q : q + 1]) / (norm[q] * norm)
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:5]
    return out


@pytest.mark.parametrize("kind", ["multiples", "noise 1e-7", "noise 1e-8", "clusters"])
def test_neighbours_of_almost_parallel_vectors(spark, kind):
    rng = np.random.RandomState(6)
    v = rng.randn(1500, 64)
    if kind == "multiples":
        v[300:800] = v[0] * (1 + rng.permutation(500)[:, None])
    elif kind == "clusters":
        v = v[rng.randint(0, 12, 1500)] + 0.05 * v
    else:
        v[300:800] = v[0] + float(kind.split()[1]) * v[300:800]
    df = spark.createDataFrame([(i, x.tolist(), "extra") for i, x in enumerate(v)], "vec_id long, embedding array<double>, score string")
    got = defaultdict(list)
    for r in vp_search.nearest_neighbours(df, shard_rows=150).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got == plain_neighbours(v, np.arange(1500), 50)


def test_recall_of_relaxed_factors(spark):
    rng = np.random.RandomState(8)
    v = rng.randn(12, 16)[rng.randint(0, 12, 3000)] + 0.4 * rng.randn(3000, 16)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = plain_neighbours(v, np.arange(3000), 50)
    recall = {}
    for factor in (1.0, 1.5, 2.0):
        got = defaultdict(set)
        for r in vp_search.nearest_neighbours(df, shard_rows=400, factor=factor).collect():
            got[r.query_id].add(r.vec_id)
        recall[factor] = sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    print("recall", recall)
    assert recall[1.0] == 1 and recall[1.5] >= 0.9 and recall[2.0] >= 0.6


def test_classifiers_learn_and_stand_awkward_rows(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(real, labels).join(labels, "doc_id").where("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert got > 0.9
    langs = lang_id.predict_languages(real, per_language=40)
    joined = langs.join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert joined.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    assert quality.quality_scores(docs, labels.limit(0)).count() == len(DOCS)
    assert quality.quality_scores(none, labels).count() == 0
    odd = {r.doc_id: r for r in lang_id.predict_languages(docs, per_language=5).collect()}
    assert odd[0].lang_pred == odd[1].lang_pred == "und" and len(odd) == len({d[0] for d in DOCS})
    assert lang_id.predict_languages(none).collect() == []


@pytest.mark.filterwarnings("error")
def test_nonnegative_risk_stays_finite_on_saturated_scores():
    rng = np.random.RandomState(3)
    p = np.zeros((400, quality.WIDTH), np.float32)
    p[:, :50] = 8
    u = np.vstack([p[:350], -p[:50]]) + rng.rand(400, quality.WIDTH).astype(np.float32) / 100
    w, b = quality.fit_nonnegative(p, u, 0.87)
    assert np.isfinite(w).all() and (p[0] @ w + b) > 1 and (-p[0] @ w + b) < -1


def test_prior_from_positive_and_unlabelled_text():
    rng = np.random.RandomState(9)
    for share in (0.3, 0.6, 0.9):
        p, u = rng.randn(2000, quality.WIDTH).astype(np.float32) * 0.05, rng.randn(3000, quality.WIDTH).astype(np.float32) * 0.05
        good = rng.rand(3000) < share
        p[:, 0] += 3
        u[:, 0] += np.where(good, 3, -3)
        assert abs(quality.estimate_prior(p, u) - share) < 0.06


def plain_score(word, piece):
    """The probability of a word as the sum over all ways to cut it."""
    if not word:
        return 1.0
    return sum(piece.get(word[:n], lang_id.UNKNOWN if n == 1 else 0) * plain_score(word[n:], piece) for n in range(1, len(word) + 1))


def test_predictions_equal_a_plain_forward_sum(spark):
    """The fitted model's log-likelihoods of whole texts against the recursive sum over all segmentations, and a language without spaces."""
    rows = [(i, " ".join(["haus und baum", "le chat noir", "ooooo"][i % 3].split() * (1 + i % 4)) if i % 3 < 2 else "天地玄黄" * (10 + i % 5), ["de", "fr", "zh"][i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.fit(docs, "doc_id", "text", "lang", 50, lang_id.public_pieces())
    for k, lang in enumerate(model.languages):
        piece = dict(zip(model.pieces, model.probs[k], strict=True))
        for word in ("haus", "chat", "天地玄黄"):
            assert np.isclose(model.word(word)[k], np.log(plain_score("▁" + word, piece))), (lang, word)
    got = {r.doc_id: r.lang_pred for r in lang_id.predict_languages(docs).collect()}
    assert got == {i: lang for i, _, lang in rows}


def test_long_words_are_fitted_like_short_ones():
    index = {"a": 0, "aa": 1, "b": 2, "▁": 3}
    for word in ("▁aab", "▁aaaab"):
        parts, prob = {word: lang_id.segments(word, index, 2)}, [0.3, 0.2, 0.4, 0.1]
        one, two = np.zeros(4), np.zeros(4)
        lang_id._plain_counts(parts[word], len(word), 2, prob, one)
        lang_id._log_counts(parts[word], len(word), 2, prob, two)
        assert np.allclose(one, two)
    assert lang_id.fit_language({"▁" + "ab" * 400: 1}, index, 2)[2] > 0.3


def test_forward_sums_all_segmentations():
    model = lang_id.LanguageModel(["x"], ["a", "aa", "▁", "▁a"], np.array([[0.1, 0.2, 0.3, 0.4]]))
    # ▁|a|a + ▁|aa + ▁a|a
    assert np.isclose(np.exp(model.word("aa")[0]), 0.3 * 0.1 * 0.1 + 0.3 * 0.2 + 0.4 * 0.1)
    long = model.word("a" * 500)[0]
    assert np.isfinite(long) and long < -100
    for word in ("", "a", "aa", "é", "aéa", "a" * 23):
        assert np.allclose(model.word(word), model.short_words([word, word])[1])
    texts = [None, "a aa", "12 !", "aa " + "b" * 500, "a aa"]
    assert model.scores(texts) == [model.scores([t])[0] for t in texts] and all(len(w) <= lang_id.SHORT for w in model.known)


def test_mixing_meets_its_targets(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}
    rows = mixing.mixing_rates(real, weights=weights).collect()
    total = np.sum([r.n_tokens * r.rate * np.array(r.posterior) for r in rows], axis=0)
    assert np.abs(total / total.sum() - [0.3, 0.4, 0.1, 0.2]).max() < 0.01 and min(r.rate for r in rows) >= 0
    assert mixing.mixing_rates(docs).count() == len(DOCS)
    assert mixing.mixing_rates(none).collect() == []
    mixed = mixing.mix(docs, floor=1.0)
    assert mixed.columns == docs.columns and mixed.where("doc_id is not null").select("doc_id").distinct().count() == len({d[0] for d in DOCS}) - 1


def test_features_of_long_texts(monkeypatch):
    rng = np.random.RandomState(10)
    text = " ".join(np.array(list("abcdefgh"))[rng.randint(0, 8, 500)])
    one = features.text_features(text)
    monkeypatch.setattr(features, "LONG_WORDS", 100)
    assert (features.text_features(text) == one).all()


def test_samples_are_the_smallest_hashes(spark):
    """A large domain, a small one, and one whose rows repeat one id, so that the first cut leaves too few."""
    rows = [(i, "large") for i in range(3000)] + [(i, "small") for i in range(5)] + [(7, "hot")] * 2000 + [(i, "hot") for i in range(30)]
    named = spark.createDataFrame(rows, "__id long, __by string")
    got = defaultdict(set)
    for r in features.smallest_hashes(named, 20, 3).collect():
        got[r["__by"]].add(r["__id"])
    at = {r[0]: r[1] for r in named.select("__id", F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(1 << 40))).distinct().collect()}
    assert got == {by: set(sorted({i for i, b in rows if b == by}, key=at.__getitem__)[:20]) for by in ("large", "small", "hot")}


def test_rates_equal_plain_least_squares(spark):
    """The rates of a small table against a long plain projected gradient on the same problem."""
    rng = np.random.RandomState(7)
    p = rng.dirichlet([0.5, 0.5, 0.5], 60)
    n = rng.randint(1, 50, 60)
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    steps, available, target, reached = mixing.fit_rates(known, ["a", "b", "c"], {"a": 0.6, "b": 0.3, "c": 0.1}, 0.5, 0.0, 300, 1e-6)
    r = mixing.replay(p, steps, 0.0)
    inverse, plain = np.linalg.inv((p * n[:, None]).T @ p), np.ones(60)
    for _ in range(20_000):
        plain = np.maximum(0, plain - p @ (inverse @ ((n * plain) @ p - target)))
    assert np.allclose((n * r) @ p, target, rtol=1e-5) and np.allclose((n * plain) @ p, target, rtol=1e-5) and np.allclose(available, n @ p)
    assert (r >= 0).all() and np.corrcoef(r, plain)[0, 1] > 0.98


@pytest.mark.parametrize(("shares", "weights"), [([0.97, 0.0295, 0.0002, 0.0002, 0.0001], [0.9, 0.0985, 0.0005, 0.0005, 0.0005]), ([0.99989, 1e-4, 1e-5], None)])
def test_mixing_meets_small_targets(spark, shares, weights):
    rng = np.random.RandomState(4)
    k = len(shares)
    own = np.concatenate([np.arange(k), rng.choice(k, 30_000, p=shares)])
    z = rng.randn(len(own), k) + np.log(shares)
    z[np.arange(len(own)), own] += np.where(own > 0, 12, 6)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    n = rng.randint(1, 2000, len(own))
    domains = [f"d{i}" for i in range(k)]
    known = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    wanted = dict(zip(domains, weights, strict=True)) if weights else None
    steps, _, target, reached = mixing.fit_rates(known, domains, wanted, 0.5, 0.0, 100, 1e-3)
    got = (n * mixing.replay(p, steps, 0.0)) @ p
    assert (np.abs(got / target - 1) <= 1e-3 * (1 + 1e-6)).all() and np.allclose(got, reached)
    with pytest.warns(UserWarning, match="targets not met.*d0: "):
        mixing.fit_rates(known, domains, {"d1": 1.0}, 0.5, 0.9, 100, 1e-3)
