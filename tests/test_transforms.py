"""Transforms against hand-written values, a plain model, and each other."""

import random

import pytest
from pyspark.sql import functions as F

from loomseq.functions import names
from loomseq.functions.columns import settled
from loomseq.operators import bwt, fm, mtf, rle
from loomseq.operators import symbols as sy
from loomseq.plans import pipelines


def model_bwt(data: bytes) -> list:
    if not data:
        return []
    order = sorted(range(len(data) + 1), key=lambda i: data[i:])
    return [None if i == 0 else data[i - 1 : i] for i in order]


def model_mtf(seq: list) -> tuple[list, list]:
    key = lambda x: (x is not None, x or b"")
    front = sorted(set(seq), key=key)
    out = []
    for x in seq:
        out.append(front.index(x))
        front.insert(0, front.pop(front.index(x)))
    return out, front


def model_runs(seq: list) -> list:
    out = []
    for x in seq:
        if out and x is not None and out[-1][1] == x:
            out[-1] = (out[-1][0] + 1, x)
        else:
            out.append((1, x))
    return out


def texts(n=60, seed=5):
    rng = random.Random(seed)
    made = ["", "a", "ba", "banana", "mississippi", "abracadabra", "aaaa", "héllo wörld é", "\x00\xff\x00", "ab" * 400]
    return made + ["".join(rng.choice("abé\n") for _ in range(rng.randrange(30))) for _ in range(n)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, t string")


def symbols(x):
    return None if x is None else [None if v is None else bytes(v) for v in x]


def seq_of(s):
    return "".join("$" if v is None else v.decode("latin-1") for v in s)


def test_transform_equals_the_model_and_comes_back(table):
    rows = table.select("t", bwt.bwt_text(F.col("t")).alias("b"), bwt.bwt(sy.of_text(F.col("t"))).alias("generic"), bwt.bwt(sy.of_text(F.col("t")), "hof").alias("hof"))
    for r in settled(rows).withColumn("back", bwt.inverse_text(F.col("b"))).collect():
        expected = model_bwt(r.t.encode())
        assert symbols(r.b) == symbols(r.generic) == symbols(r.hof) == expected, r.t
        assert r.back == r.t


@pytest.mark.parametrize(("text", "expected"), [("banana", "annb$aa"), ("mississippi", "ipssm$pissii"), ("abracadabra", "ard$rcaaaabb"), ("aaaabbbbcccc", "c$aaaabbbcccb")])
def test_known_transforms(spark, text, expected):
    (row,) = spark.createDataFrame([(text,)], "t string").select(bwt.bwt_text(F.col("t")).alias("b")).collect()
    assert seq_of(row.b) == expected


def test_suffix_arrays_agree(table):
    nested = table.select("id", bwt.suffix_array(sy.of_text(F.col("t"))).alias("a"), bwt.suffix_array(sy.of_text(F.col("t")), "hof").alias("b"), bwt.suffix_array_bytes(F.col("t").cast("binary"), "hof").alias("c")).collect()
    assert all(r.a == r.b == r.c for r in nested)
    long = bwt.suffix_array_long(sy.to_long(table.select("id", sy.of_text(F.col("t")).alias("s")), "s", "id"), "id").collect()
    found = {}
    for r in long:
        found.setdefault(r.id, {})[r.suffixindex] = r.suffixstartpos
    for r in nested:
        if len(r.a) > 1:
            assert [found[r.id][k] for k in sorted(found[r.id])] == r.a
    (row,) = table.where("t = 'abracadabra'").select(bwt.suffixes(sy.of_text(F.col("t"))).alias("s")).collect()
    assert [x.suffixstartpos for x in row.s] == [12, 11, 8, 1, 4, 6, 9, 2, 5, 7, 10, 3]
    assert [x.suffixindex for x in row.s] == list(range(1, 13)) and row.s[0].suffix is None and len(row.s[3].suffix) == 11


def test_other_element_types(spark):
    df = spark.createDataFrame([([3, 1, 2, 1],), ([],), (None,)], "s array<int>")
    assert [r.b for r in df.select(bwt.bwt(F.col("s")).alias("b")).collect()] == [[1, 2, 3, 1, None], [], None]
    words = spark.createDataFrame([(["b", "a", "é", "a"],)], "s array<string>")
    moved = settled(words.select("s", bwt.bwt(F.col("s")).alias("b"))).select("s", bwt.inverse(F.col("b")).alias("back")).first()
    assert moved.s == moved.back
    structs = df.where("size(s) > 0").select(F.transform("s", lambda x: F.struct(x.alias("x"))).alias("s"))
    assert settled(structs.select(bwt.ranks(F.col("s")).alias("r"))).first().r == [3, 1, 2, 1]


def test_inverse_of_what_is_no_transform(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", None, "b"],), ([],), ([None],)], "s array<string>")
    assert [r.x for r in df.select(bwt.inverse(F.col("s")).alias("x")).collect()] == [[], ["a"], [], []]
    with pytest.raises(Exception, match="not a transform"):
        df.select(bwt.inverse(F.col("s"), strict=True)).collect()
    with pytest.raises(Exception, match="second sentinel"):
        spark.createDataFrame([([None, "a", None],), (["a", None, None],)], "s array<string>").select(bwt.inverse(F.col("s"))).collect()


def test_matrix(spark):
    (row,) = spark.createDataFrame([("abracadabra",)], "t string").select(bwt.matrix(sy.of_text(F.col("t"))).alias("m")).collect()
    rows = [seq_of(x) for x in row.m]
    ends = sorted("abracadabra"[i:] for i in range(12))
    assert rows == [e + "$" + "abracadabra"[: 11 - len(e)] for e in ends]


def test_runs(table):
    rows = table.select("t", bwt.bwt_text(F.col("t")).alias("b"), rle.encode(bwt.bwt_text(F.col("t"))).alias("r"))
    for r in settled(rows).withColumn("back", rle.decode(F.col("r"))).collect():
        assert [(x.n, x.value and bytes(x.value)) for x in r.r] == model_runs(model_bwt(r.t.encode()))
        assert symbols(r.back) == symbols(r.b)
    (row,) = table.where("t = 'banana'").select(rle.encode(bwt.bwt_text(F.col("t"))).alias("r")).collect()
    assert [(x.n, x.value and bytes(x.value)) for x in row.r] == [(1, b"a"), (2, b"n"), (1, b"b"), (1, None), (2, b"a")]


#: A known text and its run-length code (fixed values).
KNOWN = {"aaaabbbbcccc": [(1, "c"), (1, None), (4, "a"), (3, "b"), (3, "c"), (1, "b")]}
#: A known text whose transform has 87 runs, with the sentinel at place 372 from 0 (fixed values).
LONG = (
    "editor-mount-z0Uz0Uz0Uz0Uz0Uz0Uz0Uz5Uz0Uz0Uz0Uz2Uz3Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz1Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz1Uz0Uz0Uz0Uz2Uz1Uz0Uz0Uz0Uz0Uz"
    "0Uz0Uz0Uz0Uz0Uz0Uz0Uz1cUz0Uz0Uz0Uz1Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uznz0e9Uz7dUz20Uz0ffUz11Uz40Uz0a3Uz9aUz0bfU3z0f5Uz12Uz0a8Uzhz4Uz0Uz0Uz0Uz2Uz4Uz0U"
    "z0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz2Uz0Uz0Uz0Uz2Uz3Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz1Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz1Uz0Uz0Uz0Uz2Uz3Uz0Uz0Uz0Uz0Uz0Uz0"
    "Uz0Uz0Uz0Uz0Uz0Uz1Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz1cUz0Uz0Uz0Uz1Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uz0Uznz0e9Uz7dUz20Uz0ffUz11Uz40Uz0a3Uz9aUz0bfU3z0f5Uz12Uz0a8Uzhz"
    "4Uz4U"
)


def test_known_run_length_codes(spark):
    df = spark.createDataFrame([(t,) for t in (*KNOWN, LONG)], "t string")
    for s in ("b", "t"):
        coded = settled(df.select("t", names.FUNCTIONS[f"text_to_bwt_to_rle_{s}"](F.col("t")).alias("r"), bwt.bwt_text(F.col("t")).alias("b")))
        rows = {r.t: r for r in coded.withColumn("back", names.FUNCTIONS[f"text_from_bwt_from_rle_{s}"](F.col("r"))).collect()}
        as_text = lambda v: v if v is None or isinstance(v, str) else v.decode()
        for t, expected in KNOWN.items():
            assert [(x.n, as_text(x.value)) for x in rows[t].r] == expected and rows[t].back == t
        long = rows[LONG]
        assert len(LONG) == 565 and long.back == LONG and len(long.r) == 87 and long.b.index(None) == 372
        assert [(x.n, as_text(x.value)) for x in long.r] == [(n, as_text(v)) for n, v in model_runs(model_bwt(LONG.encode()))]


def test_texts_beyond_ascii_and_characters(spark, table):
    df = spark.createDataFrame([(1, "día día"), (2, None), (3, "")], "id long, t string")
    for name in ("text_fm_index_count_s", "text_fm_index_locate_p"):
        with pytest.raises(Exception, match="beyond ASCII"):
            df.select(names.FUNCTIONS[name](["d"], F.col("t")).alias("x")).collect()
        assert [r.x for r in df.where("id > 1").select(names.FUNCTIONS[name](["d"], F.col("t")).alias("x")).collect()] == [[], []]
    counted = df.select(names.bytestring_fm_index_count_p(["día".encode()], F.col("t")).alias("x")).first().x
    assert [(bytes(r.pattern).decode(), r.n) for r in counted] == [("día", 2)]
    for steps in (["bwt"], ["bwt", "rle"], ["bwt", "mtf"], ["bwt", "fm"], ["mtf"]):
        coded = pipelines.encode(df.where("t <> ''"), "t", steps, symbols="chars")
        assert pipelines.decode(coded, "code", steps, symbols="chars").first().text == "día día"
    chars = settled(df.where("id = 1").select(bwt.bwt(sy.of_chars(F.col("t"))).alias("b"))).first().b
    assert len(chars) == 8 and chars.count("í") == 2


def test_index_from_a_matrix(spark):
    df = spark.createDataFrame([("abracadabra",), ("a",)], "t string").select("t", bwt.bwt_text(F.col("t")).alias("b"), bwt.matrix(sy.of_text(F.col("t"))).alias("m"))
    for s in ("b", "t"):
        for r in settled(df).select(names.FUNCTIONS[f"text_bwt_to_fm_index_{s}"](F.col("b"), F.col("m")).alias("given"), names.FUNCTIONS[f"text_bwt_to_fm_index_{s}"](F.col("b")).alias("own")).collect():
            assert r.given == r.own


@pytest.mark.parametrize(("given", "expected"), [
    ([None, "a"], [(1, "a")]), ([None, None], [(1, None)] * 3), (["a", "a", "a", None], [(3, "a"), (1, None), (3, None)]), ([None], [(1, None)]),
    (["a", None], [(1, "a"), (1, None), (1, None)]), (["a", "b", None], [(1, "a"), (1, "b"), (1, None), (1, None)]), (["a", None, "b"], [(1, "a"), (1, None), (1, "b")]), ([], []),
])
def test_runs_with_quirks(spark, given, expected):
    df = spark.createDataFrame([(given,)], "s array<string>")
    (row,) = df.select(rle.encode(F.col("s"), compat=True).alias("r")).collect()
    assert [(x.n, x.value) for x in row.r] == expected


def test_flat_runs(spark):
    df = spark.createDataFrame([(["2", "a", "1", None, "0", "b", "x"],), ([],), (["3", None],)], "f array<string>")
    out = df.select(rle.decode(rle.from_flat(F.col("f"))).alias("s")).collect()
    assert [r.s for r in out] == [["a", "a", None], [], [None]]
    for bad in (["x", "a"], [None, "a"]):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "f array<string>").select(rle.from_flat(F.col("f"))).collect()


def test_move_to_front(table):
    rows = table.select("t", bwt.bwt_text(F.col("t")).alias("b"), mtf.encode(bwt.bwt_text(F.col("t"))).alias("m"))
    for r in settled(rows).withColumn("back", mtf.decode(F.col("m"))).collect():
        indices, front = model_mtf(model_bwt(r.t.encode()))
        assert r.m.indices == indices and symbols(r.m.symbols) == front, r.t
        assert symbols(r.back) == symbols(r.b)
    (row,) = table.limit(1).select(mtf.encode(bwt.bwt_text(F.lit("aaabbbccc"))).alias("m")).collect()
    assert row.m.indices == [3, 1, 2, 0, 0, 3, 0, 3, 0, 1] and seq_of(symbols(row.m.symbols)) == "bca$"


def test_told_element_types_give_the_same(spark, table):
    from pyspark.sql import types as T

    binary = T.BinaryType()
    rows = settled(table.union(spark.createDataFrame([(-1, None)], table.schema)).select(bwt.bwt_text(F.col("t")).alias("b")))
    coded = rows.select("b", rle.encode(F.col("b")).alias("r"), rle.encode(F.col("b"), element=binary).alias("r2"), rle.encode(F.col("b"), compat=True).alias("q"), rle.encode(F.col("b"), compat=True, element=binary).alias("q2"), mtf.encode(F.col("b")).alias("m"), mtf.encode(F.col("b"), binary).alias("m2"))
    for r in settled(coded).select("*", rle.decode(F.col("r"), binary).alias("s"), mtf.decode(F.col("m"), binary).alias("u")).collect():
        assert r.r == r.r2 and r.q == r.q2 and r.m == r.m2 and r.s == r.b and r.u == r.b
    odd = spark.createDataFrame([([(0, "a"), (-1, "b"), (5, None), (2, "c")],), ([],), (None,)], "r array<struct<n:int,value:string>>")
    assert [tuple(x) for x in odd.select(rle.decode(F.col("r")), rle.decode(F.col("r"), T.StringType())).collect()] == [([None, "c", "c"],) * 2, ([],) * 2, (None,) * 2]
    pair = lambda i, s: spark.createDataFrame([((i, s),)], "p struct<indices:array<int>,symbols:array<string>>").select(mtf.decode(F.col("p"), T.StringType()).alias("s")).first().s
    assert pair([1, 1, 0], ["b", "a"]) == pair([1, 1, 0], ["a", "b", "a"]) == ["b", "a", "a"] and pair([], ["a"]) == [] and pair([0], []) == [] and pair(None, ["a"]) is None and pair([0], None) is None
    for bad in ([2], [-1], [None]):
        with pytest.raises(Exception):
            pair(bad, ["a", "b"])


def test_move_to_front_back_from_any_order_and_errors(spark):
    pair = lambda i, s: spark.createDataFrame([((i, s),)], "p struct<indices:array<int>,symbols:array<string>>").select(mtf.decode(F.col("p")).alias("s")).first().s
    assert pair([1, 1, 0], ["b", "a"]) == pair([1, 1, 0], ["a", "b"]) == ["b", "a", "a"]
    assert pair([], ["a"]) == [] and pair([0], []) == []
    for bad in ([2], [-1], [None]):
        with pytest.raises(Exception):
            pair(bad, ["a", "b"])


def test_tables_of_the_index(spark):
    df = spark.createDataFrame([("abracadabra",), ("",)], "t string").select(fm.build(sy.of_text(F.col("t"))).alias("i"))
    full, empty = df.collect()
    assert [(x.c, x.sym and bytes(x.sym)) for x in full.i.cc] == [(0, None), (1, b"a"), (6, b"b"), (8, b"c"), (9, b"d"), (10, b"r")]
    b = model_bwt(b"abracadabra")
    for row in full.i.occ:
        s = row.sym and bytes(row.sym)
        assert [x.occ for x in row.row] == [sum(x == s for x in b[: k + 1]) for k in range(12)]
        assert [x.k for x in row.row] == list(range(1, 13)) and symbols([x.bwt for x in row.row]) == b
    assert full.i.sa == [12, 11, 8, 1, 4, 6, 9, 2, 5, 7, 10, 3]
    assert (empty.i.cc, empty.i.occ, empty.i.sa) == ([], [], [])
    assert symbols(settled(df).select(fm.to_bwt(F.col("i")).alias("b")).first().b) == b


PATTERNS = ["abra", "a", "bra", "ac", "q", "xyz", "abraz", "", "zabra", "abra", "é"]


def test_counts_and_places(spark):
    df = spark.createDataFrame([(1, "abracadabra"), (2, ""), (3, None), (4, "aaaa é")], "id long, t string")
    index = fm.index_bytes(df, "id", "t")
    got = {(r.id, r.pattern_idx): r.n for r in fm.count(index, "id", PATTERNS).collect()}
    assert [got[1, i] for i in range(len(PATTERNS))] == [2, 5, 2, 1, None, None, None, None, None, 2, None]
    assert got[4, 1] == 4 and got[4, 10] == 1 and {k for k, _ in got} == {1, 4}
    quirk = {(r.id, r.pattern_idx): r.n for r in fm.count(index, "id", PATTERNS, compat=True).collect()}
    assert [quirk[1, i] for i in range(len(PATTERNS))] == [2, 5, 2, 1, None, None, None, None, 2, 2, None]
    places = {(r.id, r.pattern_idx): r.positions for r in fm.locate(index, "id", PATTERNS).collect()}
    assert places[1, 0] == [8, 1] and places[1, 1] == [11, 8, 1, 4, 6] and places[1, 4] == [] and places[4, 10] == [6]
    assert fm.locate(index, "id", []).count() == 0
    data = F.col("t").cast("binary")
    plain = df.where("id in (1, 4)").select("id", *[fm.text_count(data, p.encode()).alias(f"c{i}") for i, p in enumerate(PATTERNS)]).collect()
    assert all(r[f"c{i}"] == got[r.id, i] for r in plain for i in range(len(PATTERNS)))
    assert df.where("id = 1").select(fm.effective(data, b"zabra").alias("p")).first().p == bytearray(b"abra")


def test_stored_tables_equal_a_count():
    from loomseq.functions import sequences as sq

    rng = random.Random(2)
    for size in (1, 511, 512, 513, 2000):
        text = bytes(rng.choice(b"\x00ab\xff") for _ in range(size))
        b = model_bwt(text)
        raw = b"".join(x or b"\0" for x in b)
        end = b.index(None)
        c, occ = sq.occ_tables(sq.np.frombuffer(raw, sq.np.uint8), end)
        stored = sq.Stored(raw, end, c, occ)
        for s in set(text):
            assert stored.before(s) == 1 + sum(x < s for x in text)
            for at in {0, 1, end, end + 1, 511, 512, 513, 1024, len(b)}:
                if at <= len(b):
                    assert stored.rank(s, at) == sum(x is not None and x[0] == s for x in b[:at])
        assert stored.before(77) == -1


def test_sequences_in_parts(monkeypatch):
    from loomseq.functions import sequences as sq

    rng = sq.np.random.default_rng(1)
    size = rng.integers(0, 40, 50)
    first = sq.np.concatenate(([0], sq.np.cumsum(size)))
    codes = rng.integers(1, 4, int(first[-1]))
    whole = sq.sorted_together(codes, first)
    monkeypatch.setattr(sq, "SORTED", 60)
    assert all((x == y).all() for x, y in zip(sq.suffix_arrays(codes, first), whole, strict=True))


def test_batches_in_slices():
    import pyarrow as pa

    from loomseq.functions import sequences as sq

    asked = []
    run = sq.in_slices(lambda c: asked.append(len(c)) or c, most=5)
    for column in (pa.array(["ab", None, "abc", "", "a" * 9, "b"]), pa.array([[1, 2], None, [1, 2, 3], [], [1] * 9, [2]]), pa.array([{"i": [1] * n, "s": []} for n in (2, 0, 3, 0, 9, 1)])):
        asked.clear()
        assert pa.concat_arrays(list(run(iter([column, column[:0], column[2:]])))) == pa.concat_arrays([column, column[2:]])
        assert asked == [4, 1, 1, 2, 1, 1]


@pytest.mark.parametrize("name", ["bwt_round_trip_docs", "rle_round_trip_docs", "rle_flat_round_trip_docs"])
def test_round_trips_stay_in_python(spark, name):
    from loomseq.plans.catalogue import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Generate" not in plan


def test_whole_tables_come_in_slices():
    import pyarrow as pa

    column = pa.array([[b"a", None, b"b"] * 300] * 100, pa.list_(pa.binary()))
    made = list(fm._occ.func(iter([column])))
    assert sum(len(x) for x in made) == 100 and max(len(x) for x in made) * 900 * 257 <= fm.OCC_CELLS
    assert made[0][0].as_py()[2][:6] == [0, 0, 1, 1, 1, 2]


def test_flat_runs_of_told_type(spark):
    from pyspark.sql import types as T

    for kind, element in (("binary", T.BinaryType()), ("string", T.StringType())):
        rows = spark.createDataFrame([([(3, "a"), (1, None), (12, "b")],), ([],), (None,)], f"r array<struct<n: int, value: string>>").select(F.col("r").cast(f"array<struct<n: int, value: {kind}>>").alias("r"))
        flat = settled(rows.select("r", rle.to_flat(F.col("r"), kind == "binary").alias("f"), rle.to_flat(F.col("r"), element=element).alias("g")))
        got = flat.select("r", "f", "g", rle.from_flat(F.concat("g", F.slice("g", 1, 1)), element).alias("back")).collect()
        assert all(x.f == x.g and x.r == x.back for x in got) and len(got[0].g) == 6
        for bad in ([None, "a"], ["x", "a"]):
            with pytest.raises(Exception):
                spark.createDataFrame([(bad,)], "f array<string>").select(rle.from_flat(F.col("f").cast(f"array<{kind}>"), element)).collect()


def test_long_forms(table):
    rows = sy.to_long(table.select("id", sy.of_text(F.col("t")).alias("s")), "s", "id")
    made = bwt.bwt_long(rows, "id").collect()
    back = bwt.inverse_long(bwt.bwt_long(rows, "id"), "id").collect()
    for r in table.where("t <> ''").collect():
        b = model_bwt(r.t.encode())
        assert [x.sym and bytes(x.sym) for x in sorted((x for x in made if x.id == r.id), key=lambda x: x.k)] == b
        assert b"".join(bytes(x.sym) for x in sorted((x for x in back if x.id == r.id), key=lambda x: x.k)) == r.t.encode()
    loop = table.sparkSession.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "a"), (1, 4, "a")], "id long, k int, sym string")
    assert bwt.inverse_long(loop.where("k < 3"), "id").count() == 1


def test_long_forms_never_broadcast(spark, tmp_path, monkeypatch):
    # few bytes of files, so that Spark takes any side for small
    spark.range(2000).select("id", F.lit("banana").alias("t")).write.parquet(str(tmp_path / "t"))
    rows = sy.to_long(spark.read.parquet(str(tmp_path / "t")).select("id", bwt.bwt_text(F.col("t")).alias("s")), "s", "id")
    plans, keep = [], bwt.written
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(bwt, "written", lambda df, name: keep(plan(df), name))
    back = plan(bwt.inverse_long(rows, "id"))
    assert back.groupBy("k", "sym").count().orderBy("k").collect() == [(k, bytes([b]), 2000) for k, b in enumerate(b"banana", 1)]
    plan(bwt.bwt_long(back, "id"))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_tables_in_long_form_never_broadcast(spark, tmp_path):
    spark.range(2000).select("id", F.lit("banana").alias("t")).write.parquet(str(tmp_path / "t"))
    rows = sy.to_long(spark.read.parquet(str(tmp_path / "t")).select("id", bwt.bwt_text(F.col("t")).alias("s")), "s", "id")
    for made, n in ((fm.occ_long(rows, "id"), 2000 * 7 * 4), (mtf.encode_long(rows, "id"), 2000 * 7)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and made.count() == n


def test_inverse_of_long_rows_that_never_end(spark):
    loop = spark.createDataFrame([(1, 1, "b"), (1, 2, "a")], "id long, k int, sym string")
    with pytest.raises(ValueError, match="sentinel"):
        bwt.inverse_long(loop, "id")


def test_search_of_random_texts(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    patterns = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) for _ in range(12)]
    found = fm.locate(fm.index_bytes(spark.createDataFrame(rows, "id long, t string"), "id", "t"), "id", patterns).collect()
    text = dict(rows)
    for r in found:
        t, p = text[r.id], bytes(r.pattern).decode()
        at = sorted((i for i in range(len(t)) if t.startswith(p, i)), key=lambda i: t[i:])
        assert r.positions == [i + 1 for i in at]


def test_names(spark):
    assert len(names.FUNCTIONS) == 98
    df = spark.createDataFrame([("aaabbbccc abracadabra",)], "t string").withColumn("b", F.col("t").cast("binary"))
    for code in ("rle", "mtf", "fm_index"):
        for s in ("b", "t"):
            for kind, c in (("text", "t"), ("bytestring", "b")):
                coded = settled(df.select(c, names.FUNCTIONS[f"{kind}_to_bwt_to_{code}_{s}"](F.col(c)).alias("x")))
                back = coded.select(c, names.FUNCTIONS[f"{kind}_from_bwt_from_{code}_{s}"](F.col("x")).alias("y")).first()
                assert back[0] == back.y, (code, s, kind)
                sequence = names.FUNCTIONS[f"{kind}_bwt_from_{code}_{s}"]
                again = settled(coded.select(sequence(F.col("x")).alias("q"))).first().q
                assert len(again) == 22 and all(isinstance(v, str) == (kind == "text") for v in again if v is not None)
    counted = df.select(names.text_fm_index_count_s(["abra", "q"], F.col("t")).alias("r"), names.bytestring_fm_index_locate_p(["abra"], F.col("b")).alias("p")).first()
    assert [(x.pattern, x.n) for x in counted.r] == [("abra", 2), ("q", None)] and counted.p[0].positions == [18, 11]
    index = settled(df.select(names.text_to_bwt_to_fm_index_t(F.col("t")).alias("i")))
    pattern = F.array(*[F.lit(x) for x in "abra"])
    searched = index.select(names.count_fm_index(pattern, F.col("i")).alias("n"), names.locate_fm_index(pattern, F.col("i")).alias("rows"), F.col("i.sa").alias("sa")).first()
    assert searched.n == 2 and [searched.sa[k - 1] for k in searched.rows] == [18, 11]
    pairs = lambda *p: spark.createDataFrame([(list(p),)], "p array<struct<sym:string,idx:int>>").select(names.magic_inverse_bwt(F.col("p")).alias("x")).first().x
    assert pairs((None, 1), ("a", 0)) == ["a"] and pairs() == [] and pairs(("a", 0)) == [] and pairs(("a", 0), (None, 1)) == []
    # banana: its sorted pairs, then the same walk over pairs in another order
    assert pairs((None, 4), ("a", 0), ("a", 5), ("a", 6), ("b", 3), ("n", 1), ("n", 2)) == list("banana") and pairs(("n", 2), (None, 3), ("a", 1), ("b", 0)) == list("bna")
    for bad in (((None, 1), ("a", 1)), ((None, 1), (None, 0))):
        with pytest.raises(Exception, match="sentinel"):
            pairs(*bad)
    order = spark.createDataFrame([((None, 1), ("a", 0))], "a struct<s:string,i:int>, b struct<s:string,i:int>")
    assert order.select(names.sort_tb(F.col("a"), F.col("b")).alias("x"), names.sort_tb(F.col("b"), F.col("a")).alias("y"), names.sort_tb(F.col("a"), F.col("a")).alias("z")).first() == (-1, 1, 0)
    with pytest.raises(Exception, match="UTF"):
        spark.createDataFrame([("é",)], "t string").select(names.text_to_bwt_to_rle_t(F.col("t"))).collect()
    with pytest.raises(AttributeError):
        names.no_such_name


def test_pipelines(spark, table):
    for steps in (["bwt"], ["bwt", "rle"], ["bwt", "mtf"], ["bwt", "fm"], ["rle"], ["mtf"]):
        coded = pipelines.encode(table, "t", steps)
        assert all(r.t == r.text for r in pipelines.decode(coded, "code", steps).collect()), steps
    compact = pipelines.encode(table, "t", ["bwt", "fm"]).select("id", "t", "code.*")
    found = {(r.id, r.pattern_idx): r.n for r in fm.count(compact, "id", ["ana", "é"]).collect()}
    assert all(found[r.id, i] == (len([k for k in range(len(r.t)) if r.t.startswith(p, k)]) or None) for r in table.collect() for i, p in enumerate(["ana", "é"]))
    with_null = spark.createDataFrame([(None,), ("",)], "t string")
    assert [r.text for r in pipelines.decode(pipelines.encode(with_null, "t", ["bwt", "fm"]), "code", ["bwt", "fm"]).collect()] == [None, ""]
    ascii_only = spark.createDataFrame([("banana",)], "t string")
    coded = pipelines.encode(ascii_only, "t", ["bwt", "mtf"], symbols="text")
    assert pipelines.decode(coded, "code", ["bwt", "mtf"], symbols="text").first().text == "banana"
    for bad in ([], ["fm"], ["rle", "bwt"], ["bwt", "rle", "mtf"], ["zip"]):
        with pytest.raises(ValueError):
            pipelines.encode(table, "t", bad)


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, t string")
    assert none.select(mtf.encode(bwt.bwt_text(F.col("t")))).count() == 0
    assert fm.count(fm.index_bytes(none, "id", "t"), "id", ["a"]).count() == 0
    assert bwt.suffix_array_long(sy.to_long(none.select("id", sy.of_text(F.col("t")).alias("s")), "s", "id"), "id").count() == 0
