"""WARC, chat, tokens, language, quality, decontamination and the pipeline."""

import base64
import gzip
import hashlib
import itertools
import random

import docs as D
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomseq.llm import bpe, chat, decontam, langid, quality, queries, warc
from loomseq.llm import textvec as tv

from test_texts import windows

SF = "/root/testdata/sf0.001"


def b32(b: bytes) -> str:
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [(5, None, "x" * 10), (3, "http://a/\r\nb é", "x" * 10), (None, "u", None), (7, "u", ""), (8, "u", "é" * 5), (9, "u", "x" * 10), (9, "u", "y"), (9, "u", "y"), (10, "u", "WARC/1.1\r\n\r\nno record"), (11, "u", "long " * 50_000), (12, "u", "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nz</p>")]


@pytest.mark.parametrize("least", [0, 1, 11])
def test_warc_round_trip(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    files = warc.write(pages, f"file://{tmp_path}/w", least_bytes=least, file_bytes=400)
    first = {}
    for i, _, html in PAGES:
        b = (html or "").encode()
        if len(b) >= least and i is not None:
            first[b] = min(first.get(b, i), i)
    expected = []
    for i, _, html in PAGES:
        b = (html or "").encode()
        to = first.get(b)
        expected.append((i, len(b), b32(b), "response" if to is None or to == i else "revisit", None if to is None or to == i else to))
    for split in (1 << 20, 1000, 37):
        got = warc.read(files, split_bytes=split).collect()
        num = lambda x: None if x in (None, "urn:page:") else int(x.removeprefix("urn:page:"))
        assert sorted(((num(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in got), key=repr) == sorted(expected, key=repr)
        assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted((h or "").encode() for (_, _, h), e in zip(PAGES, expected, strict=True) if e[3] == "response")
    assert warc.read(warc.manifest(spark, f"file://{tmp_path}/w"), payloads=False).count() == len(PAGES)
    # every file is plain gzip
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").iterdir())
    assert raw.count(b"WARC-Record-ID") == len(PAGES)


def test_warc_heads_of_any_length(tmp_path):
    rng = random.Random(3)
    long = "http://a/" + "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400_000))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(gzip.compress(warc.record(i, url, b"x", 1, b32(b"x"), None, "2020-01-01T00:00:00Z")) for i, url in enumerate(("u", long, "v"))))
    with pa.OSFile(str(path)) as f:
        got = list(warc.records(f, f.size(), 0, f.size()))
    assert [x[1]["warc-record-id"] for x in got] == [f"<urn:page:{i}>" for i in range(3)]
    assert len(got[1][1]["warc-target-uri"]) > 3 << 20


def test_warc_splits_and_foreign_bytes(spark, tmp_path):
    one = lambda i, body: warc.record(i, "u", body, len(body), b32(body), None, "2020-01-01T00:00:00Z")
    rng = random.Random(1)
    bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(300))) + warc.MAGIC * 3 for _ in range(12)]
    members = [gzip.compress(one(i, b)) for i, b in enumerate(bodies)]
    data = b"".join([*members[:6], b"".join([gzip.compress(one(90, b"two") + one(91, b"in one"))]), *members[6:]])
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with pa.OSFile(str(path)) as f:
        whole = [fields["warc-record-id"] for _, fields, _ in warc.records(f, len(data), 0, len(data))]
        assert whole == [f"<urn:page:{i}>" for i in (*range(6), 90, 91, *range(6, 12))]
        for size in (1, 2, 3, 50, 333, 1000):
            parts = [[fields["warc-record-id"] for _, fields, _ in warc.records(f, len(data), a, min(len(data), a + size))] for a in range(0, len(data), size)]
            assert list(itertools.chain(*parts)) == whole, size
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(gzip.compress(one(1, b"abc").replace(b"abc", b"abd")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark.createDataFrame([(f"file://{bad}", bad.stat().st_size)], "path string, size long")).collect()
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")).count() == 0


def offsets(f, size, step):
    """What is read by ranges of so many bytes."""
    parts = [list(warc.records(f, size, a, min(size, a + step))) for a in range(0, size, step)]
    return [("damage", x.offset) if isinstance(x, warc.Damage) else x[1]["warc-record-id"] for x in itertools.chain(*parts)]


def test_warc_members_inside_payloads(tmp_path):
    """Archives as payloads, stored as they are: longer and shorter than a stored block, and than the ranges."""
    rng = random.Random(5)
    one = lambda i, body: warc.record(i, "u", body, len(body), b32(body), None, "2020-01-01T00:00:00Z")
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    inner = [b"".join(gzip.compress(one(1000 + i, noise(rng.randrange(40, 400))), mtime=0) for i in range(n)) for n in (1, 30, 700)]
    members = []
    for i, body in enumerate([noise(500), inner[0] + noise(90), noise(70_000) + inner[1], b"plain", inner[2], inner[1] + inner[1], b"last", noise(100_000)]):
        members.append(gzip.compress(one(i, body), compresslevel=0, mtime=0))
    data = b"".join(members)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    with pa.OSFile(str(path)) as f:
        for step in (997, 5000, 30_000, 65_536, 200_000, len(data)):
            assert offsets(f, len(data), step) == [f"<urn:page:{i}>" for i in range(8)], step


def test_warc_damage(spark, tmp_path):
    rng = random.Random(6)
    noise = lambda n: bytes(rng.randrange(256) for _ in range(n))
    members = [gzip.compress(warc.record(i, "u", b, len(b), b32(b), None, "2020-01-01T00:00:00Z")) for i, b in enumerate(noise(rng.randrange(200, 9000)) for _ in range(60))]
    at = [sum(map(len, members[:i])) for i in range(61)]
    bad = bytearray(members[20])
    bad[len(bad) // 2] ^= 255
    cases = {
        "cut": (b"".join(members)[: at[59] + 50], at[59], list(range(59))),
        "junk": (b"".join(members[:30]) + b"junk" * 5 + b"".join(members[30:]), at[30], list(range(60))),
        "flipped": (b"".join([*members[:20], bytes(bad), *members[21:]]), at[20], [i for i in range(60) if i != 20]),
        "start": (b"no archive" + b"".join(members), 0, list(range(60))),
        "none": (noise(3000), 0, []),
    }
    for name, (data, place, left) in cases.items():
        path = tmp_path / f"{name}.warc.gz"
        path.write_bytes(data)
        with pa.OSFile(str(path)) as f:
            for step in (701, 40_000, len(data)):
                got = offsets(f, len(data), step)
                assert [x for x in got if x[0] == "damage"] == [("damage", place)], (name, step)
                assert sorted(x for x in got if x[0] != "damage") == sorted(f"<urn:page:{i}>" for i in left), (name, step)
        files = spark.createDataFrame([(f"file://{path}", len(data))], "path string, size long")
        with pytest.raises(Exception, match=f"{name}.warc.gz is damaged at {place}"):
            warc.read(files, split_bytes=40_000).collect()
        rows = warc.read(files, split_bytes=40_000, damage="report").collect()
        assert [r.offset for r in rows if r.record_type == "damaged"] == [place] and len(rows) == len(left) + 1


def test_warc_query(spark, tmp_path):
    import duckdb

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").select("*", *[F.lit("c").alias(c) for c in ("payload", "size", "sha1", "least", "path", "refers_to")])
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op1_warc"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    expected = db.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op1_warc']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)) and len(expected) == len(PAGES)


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|> \\ <\\ < "), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "assistant", "first"), (2, 1, "assistant", "again"),
    (3, 0, "sys\ntem<|im_start|>", "odd role"), (3, None, None, "no role"), (3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "x" * 100_000), (4, 0, "system", "s"), (4, 1, "user", "<|im_start|>user\n"), (4, 2, "assistant", "done\\"),
]


def test_chat(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    extra = df.select("*", *[F.lit("c").alias(c) for c in ("seq", "state", "segments", "valid", "place")])
    got = {r.conv_id: r for r in chat.summarise(chat.format_turns(extra)).collect()}
    none_first = lambda x: (x is not None, x)
    convs = {}
    for c, t, r, x in TURNS:
        convs.setdefault(c, []).append((none_first(t), r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r, x) for _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, None: False, 4: True}
    whole = "".join(chat.render([(s.text, s.loss) for s in r.segments]) for r in chat.format_turns(df).where("conv_id = 4").orderBy("seq").collect())
    assert chat.parse(whole) == [("system", "s"), ("user", "<|im_start|>user\n"), ("assistant", "done\\")]
    for bad in ("x" + whole, whole + "<|im_start|>", whole[:-1]):
        with pytest.raises(ValueError):
            chat.parse(bad)
    assert chat.summarise(chat.format_turns(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template(before="[{role}]", after="<end>").lead


def test_machine_by_windows_equals_step_by_step(spark):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "tool", "other", ""]
    convs = {c: [rng.choice(roles[: rng.choice([4, 6])]) for _ in range(rng.randrange(1, 9))] for c in range(200)}
    convs |= {1000: ["system", "user", "assistant", "tool", "tool", "assistant", "user", "assistant"], 1001: ["user", "user", "assistant"]}
    rows = [(c, i, r, "") for c, x in convs.items() for i, r in enumerate(x)]
    got = {}
    for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "seq").collect():
        got.setdefault(r.conv_id, []).append(r.state)
        assert r.valid == (r.state != chat.FAILED)
    assert got == {c: chat.Machine().run(x) for c, x in convs.items()}
    assert got[1000][-1] == "answered" and got[1001] == ["asked", "failed", "failed"]
    with pytest.raises(ValueError):
        chat.Machine(arcs={"start": {"user": "a"}, "a": {"user": "b"}})


def test_chat_query_has_its_own_conversation(spark):
    got = {r.conv_id: r for r in queries.QUERIES["op9_chat"](spark, SF).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def strings(n=400):
    rng = random.Random(6)
    pick = ["a", "aa", " ", "  ", "\n", "the", "<|endoftext|>", "'s", "'ll", "1", "²", "é", "日本", "ing", " ", "\x85", "\x1c", "👍🏽", "ﬁ"]
    made = ["".join(rng.choice(pick) for _ in range(rng.randrange(40))) for _ in range(n)]
    made += ["".join(chr(c) for c in (rng.randrange(0x20000) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(n)]
    return [*made, "", "x" * 3000, "ab" * 5000, "\n" * 999, "Ünï" * 40]


def test_tokens_equal_the_library(spark, reference):
    texts = strings()
    t = bpe.tokenizer(bpe.default_path())
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    got = t.encode_all(texts)
    assert [x.tolist() for x in got] == expected
    assert [t.decode(x) for x in got] == [reference.decode(x, skip_special_tokens=False) for x in expected] == texts
    rng = random.Random(8)
    noise = [[rng.randrange(50257) for _ in range(rng.randrange(12))] for _ in range(200)]
    assert [t.decode(np.array(x, np.int32)) for x in noise] == [reference.decode(x, skip_special_tokens=False) for x in noise]


def test_token_columns(spark, reference):
    df = D.clashing(D.frame(spark))
    both = bpe.decode(bpe.encode(df, bpe.default_path()), bpe.default_path())
    for r in both.collect():
        assert r.ids == reference.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0), bpe.default_path()).count() == 0 and bpe.round_trip(df.limit(0), bpe.default_path()).count() == 0
    odd = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, bpe.default_path()).collect()] == [None, ""]
    for bad in ([[60000]], [[-1]], [[None]]):
        with pytest.raises(Exception):
            bpe.decode(spark.createDataFrame([bad], "ids array<int>"), bpe.default_path()).collect()


def test_token_query(spark, reference, tmp_path):
    given = [*D.rows(), *[(100 + i, t, "en", "s", 0) for i, t in enumerate(strings(20))]]
    D.clashing(D.frame(spark, given)).write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    expected = []
    for i, t, *_ in given:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        expected.append((str(i), len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False))))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op10_bpe(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(expected) and bpe.op10_bpe(spark, D.table(spark, tmp_path / "none", [])).count() == 0


def apply(merges, word):
    """Merges one after the other, each from left to right."""
    w = list(word)
    for a, b in merges:
        i, out = 0, []
        while i < len(w):
            if w[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(w[i])
                i += 1
        w = out
    return w


def test_automata_of_small_vocabularies():
    rng = random.Random(12)
    for _ in range(60):
        letters = ["a", "b", "c"][: rng.randrange(1, 4)]
        known, merges = list(letters), []
        for _ in range(rng.randrange(1, 9)):
            a, b = rng.choice(known), rng.choice(known)
            if a + b not in known:
                merges.append((a, b))
                known.append(a + b)
        ids = {s: i for i, s in enumerate(known)}
        m = bpe.Automaton({i: s.encode() for s, i in ids.items()}, [(ids[a], ids[b], ids[a + b]) for a, b in merges])
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 70))) for _ in range(40)]
        flat, ends = m.encode([w.encode() for w in words])
        begin = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            assert [known[i] for i in flat[begin:end]] == apply(merges, w), (merges, w)
            begin = end
    with pytest.raises(ValueError):
        bpe.Automaton({0: b"a", 1: b"aa"}, [(0, 0, 1), (0, 0, 1)])
    with pytest.raises(ValueError):
        bpe.Automaton({0: b"a"}, []).encode([b"b"])


def test_language(spark, tmp_path):
    got = {r.doc_id: r for r in langid.op8_langid(spark, "/root/testdata/sf0.01").collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in true if got[d].held_out]
    assert np.mean([got[d].lang_pred == true[d] for d in held]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in langid.op8_langid(spark, D.table(spark, tmp_path)).where("doc_id is not null").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (4, 5, 7)) and odd[8].lang_pred in ("en", "fr")
    none = langid.learn(D.frame(spark, []))
    assert none.languages == [] and {r.lang_pred for r in langid.predict(D.clashing(D.frame(spark)), none).collect()} == {"und"}
    assert all(r.held_out is False for r in langid.op8_langid(spark, str(tmp_path)).where("doc_id is null").collect())


def test_many_and_small_languages(spark):
    rng = random.Random(4)
    # 150 languages of a few words each, one text to learn from
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(150)}
    train = [(i, " ".join(w), lang, "s", 0) for i, (lang, w) in enumerate(words.items())]
    filters = langid.learn(D.frame(spark, train))
    assert len(filters.languages) == 150 and filters.table.shape[1] == 3
    ask = [(i, " ".join(rng.sample(w, 8)), None, "s", 0) for i, w in enumerate(words.values())]
    got = {r.doc_id: r.lang_pred for r in langid.predict(D.frame(spark, ask), filters).collect()}
    assert [got[i] for i in range(150)] == list(words)


def plain_mix(x):
    top = 2**64 - 1
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & top
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & top
    return x ^ x >> 31


def test_language_scores_equal_brute_force(spark):
    """Every n-gram looked up bit by bit, every share by the definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").limit(40).cache()
    filters = langid.learn(docs)
    rates = []
    for i in range(len(filters.languages)):
        rates.append((sum(int(x) >> i & 1 for x in filters.table[:, 0]) / len(filters.table)) ** filters.probes)
    got = {r.doc_id: r for r in langid.predict(docs, filters).collect()}
    for r in docs.collect():
        folded = []
        for b in r.text.encode():
            c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0
            if c or not folded or folded[-1]:
                folded.append(c)
        hits, n = [0] * len(rates), max(0, len(folded) - filters.size + 1)
        for k in range(n):
            h = plain_mix(int.from_bytes(bytes(folded[k : k + filters.size])))
            step, entry = h >> 32 | 1, -1
            for _ in range(filters.probes):
                entry &= int(filters.table[h & len(filters.table) - 1, 0])
                h = h + step & 2**64 - 1
            for i in range(len(rates)):
                hits[i] += entry >> i & 1
        right = [max(0.0, x - n * f) / (1 - f) for x, f in zip(hits, rates, strict=True)]
        best = right.index(max(right))
        assert got[r.doc_id].lang_pred == filters.languages[best]
        assert got[r.doc_id].score == pytest.approx(right[best] / sum(right) if sum(right) else 0.0)


def test_filters_hold_what_they_got():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 2**40, 5000, dtype=np.uint64))
    of = rng.integers(0, 3, len(code))
    f = langid.build(["a", "b", "c"], of, code, 4)
    assert all(f.bit(f.known(code[of == i]), i).all() for i in range(3))
    strange = rng.integers(2**41, 2**42, 200_000, dtype=np.uint64)
    seen = np.array([f.bit(f.known(strange), i).mean() for i in range(3)])
    assert np.abs(seen - f.false_rates()).max() < 0.003


def test_grams():
    (d,) = tv.chunks(pa.array(["Ab, cd", "", "é1", "abc"]))
    code, n = langid.grams(d, 3)
    assert n.tolist() == [3, 0, 1, 1] and code[0] == int.from_bytes(b"ab\0") and code[-1] == int.from_bytes(b"abc")


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    logit, t = rng.normal(size=7), rng.normal(size=(2, 2))
    first = np.array([0, 0, 4, 5, 7, 7])
    p, _ = quality.marginals(logit, first, t)
    for a, b in ((0, 4), (4, 5), (5, 7)):
        paths = np.array(list(itertools.product((0, 1), repeat=b - a)))
        weight = np.exp([(y * logit[a:b]).sum() + sum(t[u, v] for u, v in itertools.pairwise(y)) for y in paths])
        assert np.allclose(p[a:b], (weight[:, None] * paths).sum(axis=0) / weight.sum())


def test_document_quality_equals_enumeration(spark):
    """The score of a document by all labellings of its lines, weighted by their probability."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.learn(docs, labels)
    texts = ["one line of text", "A first line.\nBUY NOW!!! $$$\n\nthird, shorter", "", None, "a\nb\nc\nd\ne\nf", "|||\n|||\n|||"]
    got = {r.doc_id: r.score for r in quality.score(D.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x]
        (d,) = tv.chunks(pa.array([t or ""]))
        x, size, first = quality.line_features(d)
        assert size.tolist() == [len(s.encode()) for s in lines]
        if not lines:
            x, size, first = np.zeros((1, x.shape[1])), np.array([1]), np.array([0, 1])
        logit = model.logits(x, first)
        paths = np.array(list(itertools.product((0, 1), repeat=len(size))))
        weight = np.exp([(y * logit).sum() + sum(model.transition[u, v] for u, v in itertools.pairwise(y)) for y in paths])
        mean = ((weight[:, None] * paths).sum(axis=0) / weight.sum() * size).sum() / size.sum()
        mean = min(max(mean, 1e-9), 1 - 1e-9)
        odds = np.log(mean / (1 - mean)) - model.cut + np.log(0.7 / 0.3)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-6)


def test_quality_learns_from_bounded_lines(spark):
    long = "\n".join(f"line {i} of a very long text, with words" for i in range(40_000))
    rows = [(i, long if i == 3 else "Good words here.\nAnd more of them.", "en", "s", 0) for i in range(6)] + [(6, "!!! $$$ BUY", "en", "s", 0)] * 3
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(7)], "doc_id long, quality int")
    assert quality.stretches(5, 10) == [(0, 5)] and all(b - a == 32 for a, b in quality.stretches(40_000, 128)) and len(quality.stretches(40_000, 128)) == 4
    df = D.frame(spark, rows)
    assert quality._features(df.select("text", F.lit(1).alias("label")), "label", 128).agg(F.max("lines")).first()[0] == 128
    got = {r.doc_id: r.predicted for r in quality.score(df, quality.learn(df, labels)).collect()}
    assert got == {**dict.fromkeys(range(6), 1), 6: 0}


def test_quality(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    true = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in true if got[d].held_out]
    assert np.mean([got[d].predicted == true[d] for d in held]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    labels = spark.createDataFrame([(1, 1), (3, 1), (19, 0), (None, 0), (6, None), (1, 0)], "doc_id long, quality int")
    assert all(r.held_out is False for r in quality.op5_quality(spark, D.table(spark, tmp_path, labels=labels)).where("doc_id is null").collect())
    model = quality.learn(D.frame(spark), labels)
    rows = quality.score(D.clashing(D.frame(spark)), model).collect()
    assert len(rows) == len(D.rows()) and len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    one_kind = quality.learn(D.frame(spark), labels.where("quality = 1"))
    assert {r.score for r in quality.score(D.frame(spark), one_kind).collect()} == {1.0}
    assert quality.score(D.frame(spark, []), quality.learn(D.frame(spark, []), labels.limit(0))).count() == 0


def nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination(spark):
    rng = random.Random(7)
    items = [D.passage(n, 3000 * k) for k, n in enumerate((40, 25, 14, 9, 6, 4, 2))]
    given = []
    for i in range(60):
        text = D.passage(rng.randrange(80), 500_000 + i).split()
        if i % 2:
            w = items[rng.randrange(len(items))].split()
            for _ in range(rng.randrange(len(w) // 3 + 1)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = ["new"] * rng.randrange(2)
            at = rng.randrange(len(text) + 1)
            text[at:at] = w
        given.append((i, rng.choice([" ", "\n", ", "]).join(text).title(), "en", "s", 0))
    given += [(100, "", "en", "s", 0), (101, None, "en", "s", 0), (None, items[0], "en", "s", 0), (102, items[1] + " " + items[1], "en", "s", 0)]
    bench = spark.createDataFrame([*enumerate(items), (50, None), (51, "")], "item_id long, text string")
    df = D.clashing(D.frame(spark, given))
    got = {(r.doc_id, r.item_id): r for r in decontam.find(df, bench).collect()}
    norm = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    expected = {}
    for (i, t, *_), (k, item) in itertools.product(given, enumerate(items)):
        d = nearest(norm(item), norm(t))
        if d <= decontam.allowed(len(norm(item)), 0.2) and norm(t):
            expected[i, k] = d
    assert set(got) <= set(expected) and len(got) >= 0.97 * len(expected)
    for k, r in got.items():
        text = norm(next(t for i, t, *_ in given if i == k[0]))[r.start_word : r.end_word]
        assert r.distance == expected[k] == nearest(norm(items[k[1]]), text) and r.start_word <= r.end_word
    assert all(got[k].distance == 0 for k in expected if expected[k] == 0)
    clean = sorted(str(r.doc_id) for r in decontam.clean(df, bench).collect())
    assert clean == sorted(str(i) for i, *_ in given if i not in {k[0] for k in got})
    assert decontam.find(df, bench.limit(0)).count() == 0 and decontam.find(df.limit(0), bench).count() == 0
    assert decontam.clean(df, bench.limit(0)).count() == len(given)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    items = [(k, D.passage(20, 3000 * k)) for k in range(9)]
    given = [(k, "before " + t + " after", "en", "s", 0) for k, t in items]
    got = decontam.find(D.frame(spark, given), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(k, k, 0) for k in range(9)]
    assert decontam.clean(D.frame(spark, given), spark.createDataFrame(items[1:], "item_id long, text string")).count() == 1


@pytest.mark.parametrize("share", [0.1, 0.2, 0.3])
def test_recall_by_length_and_edits(share):
    """Items of all lengths with as many edits as they may have, each in a document of its own."""
    rng = np.random.default_rng(12)
    lengths = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 18, 22, 31, 32, 33, 50, 64, 65, 130, 500]
    words = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in lengths for _ in range(2)]
    index = decontam.Index(list(range(len(words))), words, share)
    assert index.expected >= 0.999 and {n for n, _ in index.recall} >= {n for n in lengths if n <= decontam.WINDOW}
    texts, of = [], []
    for i, w in enumerate(words):
        for t in range(30):
            kind = decontam.KINDS[t % 3]
            made = np.array(decontam.edited(rng, w, int(index.edits[i]), kind), np.uint64)
            texts.append(np.concatenate([rng.integers(0, 2**63, int(rng.integers(0, 30)), dtype=np.uint64), made, rng.integers(0, 2**63, int(rng.integers(0, 30)), dtype=np.uint64)]))
            of.append((i, kind))
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = {(d, i) for d, i, *_ in index.matches(np.concatenate(texts), first)}
    hits = {}
    for d, (i, kind) in enumerate(of):
        hits.setdefault((len(words[i]), kind), []).append((d, i) in found)
    assert min(np.mean(x) for x in hits.values()) >= 0.9 and np.mean([x for h in hits.values() for x in h]) >= 0.995
    assert all(of[d][0] == i for d, i in found)


def test_places_lose_no_passage():
    """Every passage within the allowed edits lies in the places that walks start from."""
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 40, n).astype(np.uint64) for n in (1, 3, 6, 11, 17, 29, 32)]
    index = decontam.Index(list(range(len(words))), words)
    text = rng.integers(0, 60, 6000).astype(np.uint64)
    inside = set(index.places(text, tv.RUNS.pair(text[:-1], text[1:])).tolist())
    for i, w in enumerate(words):
        for start in range(0, len(text)):
            for n in range(max(1, len(w) - int(index.edits[i])), len(w) + int(index.edits[i]) + 1):
                part = text[start : start + n]
                if len(set(part.tolist()) & set(w.tolist())) and whole(w.tolist(), part.tolist()) <= index.edits[i]:
                    assert inside.issuperset(range(start, min(start + n, len(text))))


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_unreached_recall_is_an_error(monkeypatch):
    monkeypatch.setattr(decontam, "MOST_REPETITIONS", 2)
    decontam.walks.cache_clear()
    try:
        with pytest.raises(ValueError, match="2 walks find"):
            decontam.Index([1], [np.arange(23, dtype=np.uint64)], recall=0.9999)
    finally:
        decontam.walks.cache_clear()


def test_words_by_unicode(spark):
    item = "“Hello” world—again; l’École d’été, naïve σίσυφοσ straße 日本語のテキスト"
    texts = ["hello WORLD again L École D ÉTÉ Naïve ΣΊΣΥΦΟΣ Straße 日本語 のテキスト", "Hello world again", "日 本 語 の テ キ ス ト"]
    bench = spark.createDataFrame([(1, item), (2, "日本語の")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.distance, r.item_words, r.start_word, r.end_word) for r in decontam.find(D.frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)]), bench).collect()}
    assert got == {(0, 1): (0, 18, 0, 18), (0, 2): (0, 4, 10, 14), (2, 2): (0, 4, 0, 4)}


def test_items_longer_than_documents(spark):
    long = D.passage(3000, 5)
    rows = [(1, " ".join(long.split()[:200]), "en", "s", 0), (2, long, "en", "s", 0), (3, " ".join(long.split()[100:2900]), "en", "s", 0)]
    got = {r.doc_id: r.distance for r in decontam.find(D.frame(spark, rows), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()}
    assert got == {2: 0, 3: 200}


def test_decontaminate_query(spark, tmp_path):
    bench = spark.createDataFrame([(7, D.passage(60, 77), "c"), (8, None, "c"), (None, "émigré ünï", "c")], "item_id long, text string, distance string")
    got = queries.QUERIES["op7_decontaminate"](spark, D.table(spark, tmp_path, benchmark=bench))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got.where("item_id is not null").collect()) == [(9, 7, 0), (10, 7, 0), (12, 7, 0)]
    assert [r.doc_id for r in got.where("item_id is null").collect()] == [8]


def test_pipeline(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first().text
    base = docs.where("lang = 'en' and n_chars between 1500 and 3000").orderBy("doc_id").first().text
    passage = " ".join(base.split()[:55])
    fresh = lambda k: D.passage(150, 70_000 * k).replace("w", "tion") + "."
    planted = [(9001, base + " Last.", "en", "s", 0), (9002, base + " Last words.", "en", "s", 0), (9003, fresh(1) + " " + item + " " + fresh(2), "en", "s", 0), (9004, passage + " " + fresh(3), "en", "s", 0), (9005, fresh(4), "en", "s", 0)]
    docs.unionByName(spark.createDataFrame(planted, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and set(out) < {r.doc_id for r in docs.select("doc_id").collect()} | {9005, 9004}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(bad & set(out)) <= 0.1 * len(bad)
    assert 9003 not in out and 9001 not in out and 9002 not in out
    assert all(item not in r.text for r in out.values())
    if 9004 in out:
        assert passage not in out[9004].text
    t = bpe.tokenizer(bpe.default_path())
    assert all(t.decode(np.array(r.ids, np.int32)) == r.text and r.n_tokens == len(r.ids) for r in out.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_pipeline_decodes_its_ids(spark, monkeypatch):
    rows = [(1, "some text", "en", "s", 9), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, "日本 émigré\n", "en", "s", 0)]
    df = D.clashing(D.frame(spark, rows))
    got = corpus_pipeline.token_ids(spark, df, SF)
    assert got.columns[-2:] == ["ids_", "n_tokens_"] and set(got.columns) == {*df.columns, "ids_", "n_tokens_"}
    assert sorted((r.doc_id, r.text, len(r.ids_) == r.n_tokens_, r.ids) for r in got.where("text is not null").collect()) == [(i, t, True, "c") for i, t, *_ in rows if t is not None]
    assert got.count() == 4
    monkeypatch.setattr(bpe, "round_trip", lambda docs, path, text_col, out, ids: bpe.encode(docs, path, out=ids).withColumn(out, F.lit("other")))
    with pytest.raises(Exception, match="decode to their text"):
        corpus_pipeline.token_ids(spark, df, SF).collect()


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_what_they_were_given(spark, tmp_path, stage):
    """Nulls, empty and long texts, repeated rows and ids, and columns of the operators' own names."""
    given = [*D.rows(), D.rows()[0], (1, "another text of the same id", "en", "z", 3), (None, None, None, None, None), (None, "a text without an id", "en", "src", 9)]
    df = D.clashing(D.frame(spark, given))
    spark.createDataFrame([(1, 1), (3, 1), (12, 1), (19, 0), (18, 0), (None, 0), (6, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, D.passage(60, 77)), (2, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, df, str(tmp_path))
    assert out.columns[: len(df.columns)] == df.columns and (stage == 4 or out.columns == df.columns)
    rows = out.collect()
    clashes = [c for c in D.CLASHES if c != "Score"]
    assert rows and all(r[c] == "c" for r in rows for c in clashes)
    left = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows]
    if stage != 2:
        assert all(left.count(x) <= given.count(x) for x in left)
    if stage == 1:
        ids = [r[0] for r in left if r[0] is not None]
        assert len(ids) == len(set(ids)) and 2 not in ids and 3 not in ids and len([r for r in left if r[0] is None]) == 3
        assert (16, D.passage(21, 50), "fr", "src", 125) not in left and len([r for r in left if r[1] in ("", None, " \t\n ") and r[0] is not None]) == 1
    if stage == 2:
        found = {}
        for i, words, removed, kept in windows(given, 20):
            if not removed or removed < words:
                found.setdefault(i, []).append(kept if removed else None)
        assert sorted((str(r[0]) for r in left)) == sorted(str(i) for i, x in found.items() for _ in x)
        assert all(r[1] in [t for i, t, *_ in given if i == r[0]] or r[1] in found[r[0]] and r[4] == len(r[1]) for r in left)
    if stage == 3:
        assert sorted(map(str, left)) == sorted(str(r) for r in given if r[0] not in (9, 10, 12))
    if stage == 4:
        assert sorted(map(str, left)) == sorted(map(str, given))
    assert run(spark, df.limit(0), str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = db.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(expected)
