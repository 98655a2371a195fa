"""Catalogue against SQL, storage, SQL functions, streams."""

import duckdb
import pytest
from pyspark.sql import functions as F

from loomseq.functions.registry import register
from loomseq.operators import fm
from loomseq.functions.names import FUNCTIONS
from loomseq.plans import named  # noqa: F401 - adds its queries
from loomseq.plans.catalogue import FLAGSHIP, ORACLES, QUERIES
from loomseq.sources import tables
from loomseq.streaming import transforms

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    expected = sorted(repr(r) for r in db.execute(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    assert got == expected and got


def test_every_named_function_is_queried(spark):
    forms = set()
    for name in QUERIES:
        if name.startswith("named_"):
            forms |= {r.form for r in QUERIES[name](spark, SF).select("form").distinct().collect()}
    assert forms == set(FUNCTIONS)


def test_compression_equals_a_model(spark):
    from test_transforms import model_bwt, model_mtf, model_runs

    expected = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 800").select("lang", "text").collect():
        b = model_bwt(r.text.encode())
        sums = expected.setdefault(r.lang, [0, 0, 0, 0])
        for i, v in enumerate((1, len(r.text.encode()), len(model_runs(b)), sum(model_mtf(b)[0]))):
            sums[i] += v
    from loomseq.operators import bwt, mtf, rle

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 800").select("lang", F.octet_length("text").alias("n"), bwt.bwt_text(F.col("text")).alias("b"))
    got = docs.select("lang", "n", F.size(rle.encode(F.col("b"))).alias("r"), F.aggregate(mtf.encode(F.col("b"))["indices"], F.lit(0), lambda a, x: a + x).alias("i")).groupBy("lang").agg(F.count("*"), F.sum("n"), F.sum("r"), F.sum("i"))
    assert {r[0]: list(r)[1:] for r in got.collect()} == expected
    assert QUERIES["compression_docs"](spark, SF).count() == 4


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1 and FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_is_stored(spark, tmp_path):
    df = spark.createDataFrame([(1, "banana"), (2, None)], "id long, t string")
    tables.save_index(df, "id", "t", str(tmp_path / "i"))
    (row,) = fm.count(tables.load_index(spark, str(tmp_path / "i")), "id", ["ana"]).collect()
    assert row.n == 2


def test_sql_functions(spark):
    assert "bwt_text" in register(spark)
    (row,) = spark.sql("select bwt_text('banana') as b, suffix_array_bytes(binary('ba')) as sa").collect()
    assert "".join("$" if x is None else x.decode() for x in row.b) == "annb$aa" and row.sa == [3, 2, 1]
    spark.createDataFrame([("banana", "ana"), ("banana", "x"), ("", "a"), (None, "a")], "t string, p string").createOrReplaceTempView("asked")
    found = spark.sql("select t, p, fm_count(i, binary(p)) as n, fm_locate(i, binary(p)) as at, text_count(t, p) as plain from (select *, fm_index_bytes(binary(t)) as i from asked)").collect()
    assert [(r.n, r.at) for r in found] == [(2, [4, 2]), (None, []), (None, []), (None, [])] and [r.plain for r in found[:3]] == [2, None, None]
    spark.sql("select t, inline(array(fm_index_bytes(binary(t)))) from asked where t = 'banana' limit 1").createOrReplaceTempView("indexed")
    rows = spark.sql("select f.* from indexed, lateral fm_search(bwt, `end`, c, occ, sa, array(binary('an'), binary('x'), cast(null as binary))) f").collect()
    assert [(r.pattern_idx, r.n, r.positions) for r in sorted(rows)] == [(0, 2, [4, 2]), (1, None, []), (2, None, [])]
    (row,) = spark.sql("select rle_restore(array(named_struct('n', 3, 'value', binary('a')), named_struct('n', 2, 'value', cast(null as binary)))) as r, alphabet(array(binary('b'), binary('a'), binary('b'))) as a").collect()
    assert [x and bytes(x) for x in row.r] == [b"a"] * 3 + [None] and [bytes(x) for x in row.a] == [b"a", b"b"]


def test_plans_of_searches(spark):
    docs = tables.table(spark, SF, "documents")
    index = fm.index_bytes(docs, "doc_id", "text")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    generate = [x for x in plan(fm.locate(index, "doc_id", ["a", "b"])).splitlines() if "Generate" in x]
    assert generate and "sa#" not in generate[0]


def test_shared_folder(spark):
    from loomseq.sources import shared

    assert shared.shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))

    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "app"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Cluster)
    made = shared.written(spark.range(3), "three")
    assert made.count() == 3 and shared.clean_up(spark) and not shared.clean_up(spark)


def test_streams(spark, tmp_path):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name")
    part.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
    back = transforms.decode_stream(transforms.encode_stream(stream, "p_name", ["bwt", "mtf"]), "code", ["bwt", "mtf"])
    q = back.select("p_name", "text").writeStream.format("memory").queryName("back").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("back").collect()
    assert len(rows) == part.count() and all(r.p_name == r.text for r in rows)
    with pytest.raises(ValueError):
        transforms.encode_stream(part, "p_name", ["bwt"])
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    runs = transforms.runs_by_window(stream, "ts", "event_type", "30 days", "1 day", "user_id")
    q = runs.writeStream.format("memory").queryName("runs").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("runs")
    assert got.select(F.sum(F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"]))).first()[0] == events.count()
