"""Operators on words and fingerprints against brute force, over awkward documents, empty tables and clashing columns."""

import hashlib
import itertools

import docs as D
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomseq.llm import components, lm, minhash, simhash, substring
from loomseq.llm import textvec as tv


def test_words_and_hashes():
    texts = [t for _, t, *_ in D.rows()]
    seen = {}
    for limit in (1, 64, 1 << 20):
        for d in tv.chunks(pa.array(texts), limit):
            starts, ends, first = d.words()
            h = tv.WORDS.bytes(d.buf, starts, ends)
            for i in range(len(d)):
                own = [bytes(d.buf[a:b]).decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
                assert own == D.words(texts[d.first + i])
                for w, x in zip(own, h[first[i] : first[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    (d,) = tv.chunks(pa.array(["a b c d", "a b", "", "b c d e", "a b"]))
    starts, ends, first = d.words()
    h, n = tv.shingles(tv.WORDS.bytes(d.buf, starts, ends), first, 3)
    assert n.tolist() == [2, 1, 0, 2, 1] and h[1] == h[3] and h[2] == h[5] and len(set(h.tolist())) == 4


def thue_morse(order):
    """Two strings of 2**order letters that every polynomial hash modulo 2**64 takes for one, if they are long enough."""
    bits = [i.bit_count() % 2 for i in range(1 << order)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_have_no_structure(spark):
    one, other = thue_morse(10)
    for strings in (tv.WORDS, tv.WORDS2):
        for a, b in ((one, other), (one * 2, other * 2), (one[:200], other[:200]), ("a", "a\0"), ("12345678", "12345678\0")):
            buf = np.frombuffer((a + " " + b).encode(), np.uint8)
            x, y = strings.bytes(buf, np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)]))
            assert x != y
    # runs of two words in the same order
    words = np.array([17, 99], np.uint64)
    x, y = (words[["ab".index(c) for c in s]] for s in (one, other))
    for runs in (tv.RUNS, tv.RUNS2):
        for n in (16, 20, 1024):
            assert runs.of(x, np.array([0]), n) != runs.of(y, np.array([0]), n)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}", "en", "s", 0), (2, f"{other} {rest}", "en", "s", 0), (3, f"{one} {rest}", "en", "s", 0)]
    got = {r.doc_id: r.n_removed for r in substring.dedup(D.frame(spark, rows), window=20).collect()}
    assert got == {1: 0, 2: 0, 3: 20}
    (d,) = tv.chunks(pa.array([r[1] for r in rows]))
    s = minhash.signatures(d, 5, 64)
    assert (s[0] == s[2]).all() and not (s[0] == s[1]).all()
    key, first = lm.tokens(d)
    assert key[first[0]] == key[first[2]] != key[first[1]]


def test_runs_of_any_length():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 13, 20):
        h = tv.RUNS.of(words, np.arange(400 - n + 1), n).tolist()
        runs = [tuple(words[i : i + n].tolist()) for i in range(400 - n + 1)]
        assert len(set(h)) == len(set(runs)) == len(set(zip(runs, h, strict=True)))


def windows(rows, size):
    """Brute force of the removal: id order (null last), rows of one id as one document."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for i, t, *_ in order:
        w = D.words(t)
        for p in range(len(w) - size + 1):
            first.setdefault(tuple(w[p : p + size]), (i, p))
    out = []
    for i, t, *_ in rows:
        w = D.words(t)
        cut = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] != (i, p):
                cut[p : p + size] = [True] * size
        out.append((i, len(w), sum(cut), " ".join(x for x, c in zip(w, cut, strict=True) if not c)))
    return out


@pytest.mark.parametrize("size", [20, 5, 50, 1])
def test_substring_dedup(spark, size):
    got = substring.dedup(D.clashing(D.frame(spark)), window=size)
    assert set(D.CLASHES) - {"Score"} <= set(got.columns)
    renamed = substring.dedup(D.clashing(D.frame(spark)), window=size, out=("a", "b", "c"))
    assert {c: renamed.select(c).distinct().collect()[0][0] for c in D.CLASHES if c != "Score"} == {c: "c" for c in D.CLASHES if c != "Score"}
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted(found, key=key) == sorted(windows(D.rows(), size), key=key)


def test_substring_dedup_of_random_words(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(list("ab"), rng.integers(0, 60))), "en", "s", 0) for i in range(80)]
    got = substring.dedup(D.frame(spark, rows), window=7)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(windows(rows, 7))
    assert substring.dedup(D.frame(spark, []), window=20).count() == 0


def test_covers():
    for v, d in substring.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))
    assert substring.cover(20) == (13, (0, 1, 3, 9)) and substring.cover(3)[0] == 1


def fingerprint(text, shingle):
    w = D.words((text or "").translate(D.LOWER))
    s = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_links(spark):
    given = [r for r in D.rows() if r[0] != 12]
    got = simhash.near_duplicates(D.frame(spark, given), shingle=4, words=1, radius=4, threshold=None).collect()
    prints = {i: fingerprint(t, 4) for i, t, *_ in given if i is not None}
    expected = groups(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len(got) == len(given)
    for r in got:
        assert r.component == (None if r.id is None else expected[r.id])
        assert r.id is None or int.from_bytes(bytes(r.fp)) == prints[r.id]
    assert simhash.near_duplicates(D.frame(spark, []), shingle=4, words=1, radius=4, threshold=None).count() == 0


@pytest.mark.parametrize(("radius", "words"), [(4, 1), (0, 1), (8, 1), (12, 1), (31, 2)])
def test_tiles_lose_no_link(spark, radius, words, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    monkeypatch.setattr(simhash, "SPLIT", 4)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (60, words), dtype=np.uint64)
    near = base[rng.integers(0, 60, 200)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (200, words, 5)).astype(np.uint64), axis=2)
    fp = np.unique(np.concatenate([base, near]), axis=0)
    rows = [(i, x.astype(">u8").tobytes()) for i, x in enumerate(fp)]
    edges = simhash.links(spark.createDataFrame(rows, "id long, fp binary"), radius, words).collect()
    apart = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2, dtype=int)
    ids = range(len(fp))
    assert groups(ids, [(r.a, r.b) for r in edges]) == groups(ids, [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(apart <= radius, 1)), strict=True)])


def sets(text, shingle=5):
    w = D.words((text or "").translate(D.LOWER))
    return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()


def test_verified_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 3)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(6):
        base = D.passage(150, 1000 * g).split()
        for k in range(9):
            w = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 6)):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append((100 * g + k, " ".join(w), "en", "s", 0))
    rows += [(900, "", "en", "s", 0), (901, None, "en", "s", 0), (902, rows[0][1], "en", "s", 0), (None, rows[0][1], "en", "s", 0)]
    got = simhash.near_duplicates(D.frame(spark, rows)).collect()
    s = {i: sets(t) for i, t, *_ in rows if i is not None}
    pairs = [(a, b) for a, b in itertools.combinations(s, 2) if (len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) if s[a] and s[b] else s[a] == s[b])]
    expected = groups(s, pairs)
    assert {r.id: r.component for r in got if r.id is not None} == expected and len(got) == len(rows)
    kept = simhash.one_of_each(D.clashing(D.frame(spark, [*rows, rows[0]])))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(expected.values())) and kept.where("doc_id is null").count() == 1
    assert simhash.one_of_each(D.frame(spark, [])).count() == 0
    tied = [(1, "b text", "en", "y", 0), (1, "a text", "en", "z", 0), (1, "a text", "en", "x", 0), (2, None, "en", "s", None)]
    assert sorted((r.doc_id, r.text, r.source) for r in simhash.one_of_each(D.frame(spark, tied)).collect()) == [(1, "a text", "x"), (2, None, "s")]


def test_near_duplicates_of_repeated_lines_and_short_texts(spark):
    line = " ".join(f"line{i}" for i in range(14))
    rows = []
    for g in range(6):
        body = D.passage(90, 1000 * g)
        rows += [(10 * g + k, "\n".join([body, *[line] * r]), "en", "s", 0) for k, r in enumerate((1, 10, 20))]
    for g in range(80):
        short = " ".join(f"s{g}x{i}" for i in range(8))
        rows += [(1000 + 2 * g, short, "en", "s", 0), (1001 + 2 * g, short + " more", "en", "s", 0)]
    s = {i: sets(t) for i, t, *_ in rows}
    expected = groups(s, [(a, b) for a, b in itertools.combinations(s, 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])])
    assert len(set(expected.values())) == 86
    assert {r.id: r.component for r in simhash.near_duplicates(D.frame(spark, rows)).collect()} == expected


@pytest.mark.parametrize(("a", "b", "common"), [(4, 5, 4), (5, 5, 5), (8, 10, 8), (9, 9, 8), (12, 15, 12), (13, 14, 12), (20, 25, 20), (45, 45, 40), (100, 125, 100), (400, 500, 400)])
def test_radius_holds_pairs_of_the_threshold(a, b, common):
    """How often fingerprints of sets of a similarity of 0.8, or as little above as their sizes allow, are candidates."""
    assert common >= 0.8 * (a + b - common)
    rng = np.random.default_rng([a, b])
    trials, found = 4000, 0
    for _ in range(trials // 500):
        h = rng.integers(0, 2**63, (500, a + b - common, 2), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (500, a + b - common, 2), dtype=np.uint64)
        bits = np.unpackbits(h.view(np.uint8), axis=2)
        one, other = (2 * bits[:, x].sum(axis=1) > n for x, n in ((slice(0, a), a), (slice(a - common, a - common + b), b)))
        differ = (one != other).sum(axis=1)
        sets_ = simhash.Sets(0.8)
        found += int(sets_.possible(np.full(500, a), np.full(500, b), differ, 34).sum())
    assert found / trials >= 0.995


def test_possible_sets():
    sets_ = simhash.Sets(0.8)
    for a in range(1, 60):
        for b in range(a, 60):
            reachable = [c for c in range(a + 1) if c >= 0.8 * (a + b - c)]
            differ = np.array([0, 1])
            got = sets_.possible(np.array([a, a]), np.array([b, b]), differ, 34).tolist()
            assert got == [bool(reachable), bool(reachable) and not (a == b and reachable == [a])]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_minhash_edits(spark):
    given = [r for r in D.rows() if r[0] != 12]
    got = minhash.edits(D.frame(spark, given).select(F.col("doc_id").alias("id"), "text")).collect()
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    expected = sorted((str(r[0]), len(t), minhash.edited(t, texts[(i + 1) % len(texts)])) for i, (r, t) in enumerate(zip(order, texts, strict=True)))
    assert sorted((str(r.id), r.n_chars, r.edited) for r in got) == expected
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        text = next(x[1] or "" for x in given if x[0] == r.id)
        assert by_text.setdefault(text, bytes(r.signature)) == bytes(r.signature)
    assert minhash.edits(spark.createDataFrame([], "id long, text string")).count() == 0
    (alone,) = minhash.edits(spark.createDataFrame([(1, "abcdef")], "id long, text string")).collect()
    assert alone.edited == "abcdab" and alone.near_next == 1.0 and alone.class_id is None


def test_minhash_likeness():
    a = D.passage(400).split()
    b = a[:200] + D.passage(200, 5000).split()
    (d,) = tv.chunks(pa.array([" ".join(a), " ".join(b)]))
    s = minhash.signatures(d, 5, 256)
    true = len(sets(" ".join(a)) & sets(" ".join(b))) / len(sets(" ".join(a)) | sets(" ".join(b)))
    assert abs(minhash.likeness(s[:1], s[1:])[0] - true) < 0.12


def test_minhash_near_duplicates(spark):
    rows = D.rows()
    rng = np.random.default_rng(3)
    for g in range(4):
        base = D.passage(120, 2000 * g + 7).split()
        for k in range(8):
            w = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 5)):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append((1000 + 100 * g + k, " ".join(w), "en", "s", 0))
    got = {r.id: r for r in minhash.near_duplicates(D.frame(spark, rows)).where("id is not null").collect()}
    plain = lambda t: {tuple(w[i : i + 5]) for w in [D.words(t)] for i in range(max(1, len(w) - 4))} if D.words(t) else set()
    s = {i: plain(t) for i, t, *_ in rows if i is not None}
    expected = groups(s, [(a, b) for a, b in itertools.combinations(s, 2) if (len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) if s[a] and s[b] else s[a] == s[b] and a != 7 and b != 7)])
    assert {i: r.component for i, r in got.items() if i != 7} == {i: c for i, c in expected.items() if i != 7}
    assert got[1].class_id == got[2].class_id == 1 and got[4].class_id == got[5].class_id == 4
    assert minhash.near_duplicates(D.frame(spark, [])).count() == 0


def test_lm_counts_and_base(spark, tmp_path):
    import collections
    import math
    import zlib

    given = D.rows()
    docs = D.clashing(D.frame(spark, given))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = lm.op4_lm(spark, str(tmp_path)).collect()
    tokens = lambda t: [*D.words((t or "").translate(D.LOWER)), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t, *_ in given if not out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), out(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t, *_ in given)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
    assert all(r.score < 0 for r in got)


def test_lm_of_no_documents(spark, tmp_path):
    assert lm.op4_lm(spark, D.table(spark, tmp_path, [])).count() == 0


def test_simhash_query(spark, tmp_path):
    given = [*[r for r in D.rows() if r[0] != 12], (50, "The quick brown fox", "en", "s", 0), (51, "the QUICK  brown\nfox", "en", "s", 0)]
    D.clashing(D.frame(spark, given)).write.parquet(str(tmp_path / "documents.parquet"))
    prints = {i: fingerprint(t, 4) for i, t, *_ in given if i is not None}
    component = groups(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.op6_simhash(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), f"{fingerprint(t, 4):016x}", "None" if i is None else str(component[i])) for i, t, *_ in given)
    assert component[51] == 50 and simhash.op6_simhash(spark, D.table(spark, tmp_path / "none", [])).count() == 0


def test_lm_learns_and_carries_state(spark):
    from loomseq.llm import rnn

    rng = np.random.default_rng(1)
    # two kinds of documents, each with words of its own
    docs = [" ".join(rng.choice([f"{k}{i}" for i in range(20)], 60)) for k in rng.choice(["a", "b"], 900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id long, text string")
    counts = lm.count(df.select("text"))
    corp, frequency = lm.corpus(counts)
    params = lm.train(df, corp, frequency)
    got = lm.score(df, counts, corp, params).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1]  # scores are negative: clearly better than word counts
    # one document alone scores as it does among others
    (d,) = tv.chunks(pa.array(docs[:40]))
    key, first = lm.tokens(d)
    symbols = corp.symbols(key)
    together = rnn.score(params, corp.shape, symbols, first)
    alone = [rnn.score(params, corp.shape, symbols[a:b], np.array([0, b - a]))[0] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert np.allclose(together, alone, rtol=1e-4)
    none = df.limit(0)
    corp, frequency = lm.corpus(lm.count(none.select("text")))
    assert lm.score(df, lm.count(none.select("text")), corp, lm.train(none, corp, frequency)).where("n_known = 0").count() == len(docs)


def test_lm_score_equals_a_plain_model(spark):
    """Scores by the definition, word by word, from the trained parameters."""
    from loomseq.llm import rnn

    rows = [(i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(D.rows()) if i != 11]
    df = D.frame(spark, rows).select(F.col("doc_id").alias("id"), "text")
    training = df.where("id < 15")
    counts = lm.count(training.select("text"))
    corp, frequency = lm.corpus(counts)
    p = lm.train(training, corp, frequency, size=8)
    shape = corp.shape
    c = {}
    (d,) = tv.chunks(pa.array([t for i, t, *_ in rows if i < 15]))
    for k in lm.tokens(d)[0].tolist():
        c[k] = c.get(k, 0) + 1
    mass = {}
    for k, n in c.items():
        if corp.symbols(np.array([k], np.uint64))[0] >= shape.words:
            mass[k % lm.OTHERS] = mass.get(k % lm.OTHERS, 0) + n + 1
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    expected = {}
    for i, t, *_ in rows:
        (d,) = tv.chunks(pa.array([t]))
        keys = lm.tokens(d)[0]
        h, before, total = np.zeros((1, 8)), shape.end, 0.0
        for k, s in zip(keys.tolist(), corp.symbols(keys).tolist(), strict=True):
            h = rnn.cell((p["e"] @ p["x"] + p["b"])[[before]], h, p["u"])[0]
            g = int(shape.class_of(np.array([s]))[0])
            total += np.log10(softmax(h[0] @ p["c"] + p["cb"])[g])
            if s < shape.words:
                a, b = shape.first[g], shape.first[g + 1]
                total += np.log10(softmax(p["w"][a:b] @ h[0] + p["wb"][a:b])[s - a])
            else:
                total += np.log10((c.get(k, 0) + 1) / (mass.get(k % lm.OTHERS, 0) + 1))
            before = s
        expected[i] = total
    got = {r.id: r.score for r in lm.score(df, counts, corp, p).collect()}
    assert got.keys() == expected.keys() and all(got[i] == pytest.approx(expected[i], rel=1e-3) for i in got)


def test_lm_is_the_same_however_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_A_COPY", 50_000)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    training, held = docs.where(~lm.held_out("id")), docs.where(lm.held_out("id"))
    found = []
    for parts in (4, 32, 200):
        dealt = training.repartition(parts)
        counts = lm.count(dealt.select("text"))
        corp, frequency = lm.corpus(counts)
        assert lm.copies_of(corp.total) > 4
        a, b, n = lm.score(held, counts, corp, lm.train(dealt, corp, frequency)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
        found.append(a / n)
        assert a > b  # even of copies of so few tokens
    assert max(found) - min(found) < 1e-3


def test_lm_gradients(monkeypatch):
    from loomseq.llm import rnn

    monkeypatch.setattr(rnn, "F32", np.float64)
    rng = np.random.default_rng(0)
    shape = rnn.Shape(6, 2, 1, np.array([0, 1, 3, 6]))
    start = {k: v.astype(np.float64) + rng.normal(0, 0.3, v.shape) for k, v in rnn.start(shape, np.arange(8) + 1.0, 4).items()}
    before, target = rng.integers(0, 8, (3, 7)), rng.integers(0, 8, (3, 7))
    before[1, 3] = 1

    def loss(p):
        h, states, gates = np.zeros((3, 4)), [], p["e"] @ p["x"] + p["b"]
        for t in range(7):
            h = rnn.cell(gates[before[:, t]], h * (before[:, t] != 1)[:, None], p["u"])[0]
            states.append(h)
        return -rnn.output(p, shape, np.concatenate(states), target.T.ravel())[0].mean()

    trainer = rnn.Trainer(start, shape, rate=1.0)
    trainer.square = {k: np.ones_like(v) for k, v in start.items()}
    trainer.window(before, target, np.zeros((3, 4)))
    for k, v in start.items():
        step = (v - trainer.p[k]) * np.sqrt(trainer.square[k])
        at = tuple(rng.integers(0, s) for s in v.shape)
        high, low = ({n: x.copy() for n, x in start.items()} for _ in range(2))
        high[k][at] += 1e-5
        low[k][at] -= 1e-5
        assert step[at] == pytest.approx((loss(high) - loss(low)) / 2e-5, rel=1e-3, abs=1e-8)


def plain_signature(text, size=256):
    """Word by word and permutation by permutation, in plain integers."""
    w = [x.encode() for x in D.words(text)]
    if not w:
        return [minhash.EMPTY] * size
    hashes = [tv.WORDS.bytes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])) for x in w]
    n = min(5, len(w))
    h = [int(tv.RUNS.of(np.concatenate(hashes[i : i + n]), np.array([0]), n)[0]) for i in range(len(w) - n + 1)]
    a, b = minhash.permutations(size)
    return [min((int(x) * k + int(y)) % 2**64 for k in h) >> 32 & 0xFFFF for x, y in zip(a, b, strict=True)]


def test_minhash_query_equals_brute_force(spark, tmp_path):
    """Fingerprints, likenesses and components by their definitions."""
    rng = np.random.default_rng(8)
    rows = [r for r in D.rows() if r[0] not in (11, 12)]
    for g in range(3):
        base = D.passage(60, 2000 * g + 7).split()
        for k in range(5):
            w = list(base)
            for at in rng.integers(0, 60, rng.integers(0, 3)):
                w[at] = f"new{rng.integers(10**6)}"
            rows.append((1000 + 100 * g + k, " ".join(w), "en", "s", 0))
    docs = D.clashing(D.frame(spark, rows))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = minhash.op2_minhash(spark, str(tmp_path)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    signature = {t: plain_signature(t) for t in texts}
    hexed = lambda s: "".join(f"{x:04x}" for x in s)
    alike = lambda x, y: sum(i == j for i, j in zip(x, y, strict=True)) / len(x)
    s = {t: {tuple(w[i : i + 5]) for w in [D.words(t)] for i in range(max(1, len(w) - 4))} if D.words(t) else set() for t in texts}
    named = {i: [x[1] or "" for x in rows if x[0] == i] for i in {r[0] for r in rows} - {None}}
    least = {t: min(i for i, x in named.items() if t in x) for x in named.values() for t in x}
    linked = [(least[a], least[b]) for a, b in itertools.combinations(least, 2) if (len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))]
    component = groups(set(least.values()), linked)
    expected = []
    for i, (r, t) in enumerate(zip(order, texts, strict=True)):
        following = texts[(i + 1) % len(texts)]
        edited = minhash.edited(t, following)
        new = plain_signature(edited)
        own = None if r[0] is None else least[t]
        expected.append((str(r[0]), len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(signature[t]), hexed(new), alike(signature[t], new), alike(signature[t], signature[following]), str(own), str(own and component[own])))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, str(r.class_id), str(r.component_id)) for r in got) == sorted(expected)
    assert minhash.op2_minhash(spark, D.table(spark, tmp_path / "none", [])).count() == 0


def test_representatives_lose_no_link(spark, monkeypatch):
    """A group of many tiles, whose clusters meet only through texts that no representative joins."""
    monkeypatch.setattr(simhash, "VERIFY_ROWS", 4)
    monkeypatch.setattr(simhash, "REPRESENTATIVES", 2)
    rng = np.random.default_rng(5)
    rows, base = [], D.passage(60).split()
    for chain in range(4):
        w = list(base)
        for k in range(14):  # each text is near the one before it, and far from the first
            at = int(rng.integers(0, 60))
            w[at] = f"c{chain}x{k}"
            rows.append((100 * chain + k, " ".join(w)))
    texts = spark.createDataFrame(rows, "id long, text string")
    members = spark.createDataFrame([(i, 1, len(D.words(t)) - 4) for i, t in rows], "id long, group long, n long")
    s = {i: sets(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(s, 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])]
    for merge in (True, False):
        edges = [(r.a, r.b) for r in simhash.verified(texts.union(texts), members, 5, 0.8, merge=merge).collect()]
        assert groups(s, edges) == groups(s, pairs) and len(set(groups(s, pairs).values())) > 3


def test_sha_of_edited(spark, tmp_path):
    got = {r.doc_id: r for r in minhash.op2_minhash(spark, D.table(spark, tmp_path, [(1, "abcdef", "en", "s", 6), (2, "xyz", "en", "s", 3)])).collect()}
    assert got[2].edited_sha256 == hashlib.sha256(b"xya").hexdigest() and got[1].edited_sha256 == hashlib.sha256(b"abcdxy").hexdigest()
