"""Named queries over whole test tables, with the SQL that they are checked against.

Results have scalar columns: symbols as upper-case hexadecimal digits, the sentinel as ``--``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseq.functions.columns import settled
from loomseq.operators import bwt, fm, mtf, rle
from loomseq.operators import symbols as sy
from loomseq.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "fm_locate_docs"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def sym(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.hex(c), F.lit("--"))


def _rows(name: str, key: str, text: str) -> str:
    """SQL: key, h (hexadecimal digits), n (bytes)."""
    return f"select {key}, hex(encode({text})) as h, strlen({text}) as n from {name}"


def _suffixes(name: str, key: str, text: str) -> str:
    """SQL: the suffixes of every row with their ranks and starts."""
    return f"with t as ({_rows(name, key, text)}), p as (select {key}, h, n, unnest(range(1, n + 2)) as pos from t), s as (select {key}, h, n, pos, row_number() over (partition by {key} order by substr(h, 2 * pos - 1)) as k from p)"


def _bwt_sql(name: str, key: str, text: str) -> str:
    return f"{_suffixes(name, key, text)}, b as (select {key}, k, case when pos = 1 then '--' else substr(h, 2 * pos - 3, 2) end as sym from s where n > 0)"


def _bwt(spark: SparkSession, sf_dir: str, name: str, key: str, text: str) -> DataFrame:
    return table(spark, sf_dir, name).select(key, F.posexplode(bwt.bwt_text(F.col(text))).alias("p", "s")).select(key, (F.col("p") + 1).cast("long").alias("k"), sym("s").alias("sym"))


for _name, _key, _text in (("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("benchmark", "item_id", "text")):

    def _q(spark: SparkSession, sf_dir: str, a=_name, b=_key, c=_text) -> DataFrame:
        return _bwt(spark, sf_dir, a, b, c)

    QUERIES[f"bwt_{_name}"] = _q
    ORACLES[f"bwt_{_name}"] = f"{_bwt_sql(_name, _key, _text)} select {_key}, k, sym from b"


@query(_bwt_sql("conversations", "id", "text").replace("select id,", "select conv_id * 100000 + turn as id,", 1) + " select id, k, sym from b")
def bwt_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), F.posexplode(bwt.bwt_text(F.col("text"))).alias("p", "s"))
    return rows.select("id", (F.col("p") + 1).cast("long").alias("k"), sym("s").alias("sym"))


@query(f"{_suffixes('part', 'p_partkey', 'p_name')} select p_partkey, k, pos from s")
def suffix_array_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(bwt.suffix_array_bytes(F.col("p_name").cast("binary"))).alias("p", "pos"))
    return rows.select("p_partkey", (F.col("p") + 1).cast("long").alias("k"), F.col("pos").cast("long").alias("pos"))


@query(f"{_suffixes('part', 'p_partkey', 'p_name')} select p_partkey, k, pos from s")
def suffix_array_hof_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(bwt.suffix_array_bytes(F.col("p_name").cast("binary"), "hof")).alias("p", "pos"))
    return rows.select("p_partkey", (F.col("p") + 1).cast("long").alias("k"), F.col("pos").cast("long").alias("pos"))


@query(f"{_suffixes('nation', 'n_nationkey', 'n_name')} select n_nationkey, k, pos from s")
def suffix_array_long_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sy.to_long(table(spark, sf_dir, "nation").select("n_nationkey", sy.of_text(F.col("n_name")).alias("seq")), "seq", "n_nationkey")
    return bwt.suffix_array_long(rows, "n_nationkey").select("n_nationkey", F.col("suffixindex").cast("long").alias("k"), F.col("suffixstartpos").cast("long").alias("pos"))


def _round_trip(name: str, encode: Callable[[Column], Column], decode: Callable[[Column], Column]) -> None:
    """Arrow functions alone, which Spark runs one on the other in Python: codes, many times their text in Spark's rows, don't go there and back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = spread(table(spark, sf_dir, "documents")).select("doc_id", encode(bwt.bwt_text(F.col("text"))).alias("code"))
        return coded.select("doc_id", bwt.inverse_text(decode(F.col("code"))).alias("text"))

    QUERIES[name], ORACLES[name] = run, "select doc_id, text from documents"


_round_trip("bwt_round_trip_docs", lambda c: c, lambda c: c)
BYTE = T.BinaryType()
_round_trip("rle_round_trip_docs", lambda c: rle.encode(c, element=BYTE), lambda c: rle.decode(c, BYTE))
_round_trip("mtf_round_trip_docs", lambda c: mtf.encode(c, BYTE), lambda c: mtf.decode(c, BYTE))
_round_trip("rle_flat_round_trip_docs", lambda c: rle.to_flat(rle.encode(c, element=BYTE), element=BYTE), lambda c: rle.decode(rle.from_flat(c, BYTE), BYTE))


@query("select conv_id, turn, text from conversations")
def fm_round_trip_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restores every text from its whole index (C, Occ and suffix array)."""
    turns = spread(table(spark, sf_dir, "conversations"))
    built = settled(turns.select("conv_id", "turn", fm.build(sy.of_text(F.col("text"))).alias("i")))
    # rows wait beside an Arrow function for its results: so they have left the index, many times their text, by then
    read = settled(built.select("conv_id", "turn", fm.to_bwt(F.col("i")).alias("b")))
    return read.select("conv_id", "turn", bwt.inverse_text(F.col("b")).alias("text"))


EVENTS = "e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, event_type as sym from events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.sequence_of(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long form, straight from the table: (user_id, k, sym)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", F.row_number().over(order).alias("k"), F.col("event_type").alias("sym"))


RUNS = f"with {EVENTS}, c as (select *, case when sym is not distinct from lag(sym) over (partition by user_id order by k) then 0 else 1 end as new from e), r as (select *, sum(new) over (partition by user_id order by k) as run from c) select user_id, cast(run as bigint) as run, count(*) as n, any_value(sym) as sym from r group by user_id, run"


@query(RUNS)
def rle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.posexplode(rle.encode(F.col("seq"))).alias("p", "r"))
    return rows.select("user_id", (F.col("p") + 1).cast("long").alias("run"), F.col("r.n").cast("long").alias("n"), F.col("r.value").alias("sym"))


@query(RUNS)
def rle_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir)
    return rle.encode_long(rows, "user_id").select("user_id", F.col("run").cast("long").alias("run"), F.col("n").cast("long").alias("n"), F.col("value").alias("sym"))


@query(f"with {EVENTS} select user_id, k, sym from e")
def rle_inverse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _events(spark, sf_dir).select("user_id", rle.decode(rle.encode(F.col("seq"))).alias("seq"))
    return sy.to_long(back, "seq", "user_id").select("user_id", F.col("k").cast("long").alias("k"), "sym")


@query(f"with {EVENTS} select user_id, k, sym from e")
def rle_inverse_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = rle.encode_long(_event_rows(spark, sf_dir), "user_id")
    return rle.decode_long(runs, "user_id").select("user_id", F.col("k").cast("long").alias("k"), "sym")


MOVES = f"with {EVENTS}, a as (select user_id, sym, row_number() over (partition by user_id order by sym) - 1 as r from (select distinct user_id, sym from e)), g as (select e.user_id, e.k, e.sym as x, a.sym, coalesce(max(case when e.sym = a.sym then e.k end) over (partition by e.user_id, a.sym order by e.k rows between unbounded preceding and 1 preceding), -a.r) as last from e join a using (user_id)), m as (select *, max(case when x = sym then last end) over (partition by user_id, k) as mine from g) select user_id, k, cast(sum(case when last > mine then 1 else 0 end) as bigint) as idx from m group by user_id, k"


@query(MOVES)
def mtf_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.posexplode(mtf.encode(F.col("seq"))["indices"]).alias("p", "i"))
    return rows.select("user_id", (F.col("p") + 1).cast("long").alias("k"), F.col("i").cast("long").alias("idx"))


@query(MOVES)
def mtf_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir)
    return mtf.encode_long(rows, "user_id").select("user_id", F.col("k").cast("long").alias("k"), F.col("idx").cast("long").alias("idx"))


LISTS = f"with {EVENTS}, l as (select user_id, sym, max(k) as last from e group by all) select user_id, row_number() over (partition by user_id order by last desc) - 1 as i, sym from l"


@query(LISTS)
def mtf_list_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select("user_id", F.posexplode(mtf.encode(F.col("seq"))["symbols"]).alias("p", "sym"))
    return rows.select("user_id", F.col("p").cast("long").alias("i"), "sym")


@query(LISTS)
def mtf_list_long_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _event_rows(spark, sf_dir)
    return mtf.final_list_long(rows, "user_id").select("user_id", F.col("i").cast("long").alias("i"), "sym")


@query(f"with {EVENTS} select user_id, k, sym from e")
def mtf_inverse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = settled(_events(spark, sf_dir).select("user_id", mtf.encode(F.col("seq")).alias("m")))
    back = coded.select("user_id", mtf.decode(F.col("m")).alias("seq"))
    return sy.to_long(back, "seq", "user_id").select("user_id", F.col("k").cast("long").alias("k"), "sym")


@query("with t as (select distinct doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as sym from documents) select doc_id, row_number() over (partition by doc_id order by sym) as i, sym from t")
def alphabet_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(mtf.alphabet(sy.of_text(F.col("text")))).alias("p", "s"))
    return rows.select("doc_id", (F.col("p") + 1).cast("long").alias("i"), sym("s").alias("sym"))


C_TABLE = "with t as (select p_partkey, unnest(list_append(regexp_extract_all(hex(encode(p_name)), '..'), '--')) as sym from part), g as (select p_partkey, sym, count(*) as n from t group by all) select p_partkey, sym, cast(coalesce(sum(n) over (partition by p_partkey order by sym rows between unbounded preceding and 1 preceding), 0) as bigint) as c from g"


@query(C_TABLE)
def fm_c_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(fm.cc(bwt.bwt_text(F.col("p_name")))).alias("r"))
    return rows.select("p_partkey", sym("r.sym").alias("sym"), F.col("r.c").cast("long").alias("c"))


@query(C_TABLE)
def fm_c_long_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sy.to_long(table(spark, sf_dir, "part").select("p_partkey", bwt.bwt_text(F.col("p_name")).alias("b")), "b", "p_partkey")
    return fm.cc_long(rows, "p_partkey").select("p_partkey", sym("sym").alias("sym"), F.col("c").cast("long").alias("c"))


OCC = f"{_bwt_sql('nation', 'n_nationkey', 'n_name')}, a as (select distinct n_nationkey, sym from b) select a.n_nationkey, a.sym, b.k, cast(sum(case when a.sym = b.sym then 1 else 0 end) over (partition by a.n_nationkey, a.sym order by b.k) as bigint) as occ from a join b using (n_nationkey)"


@query(OCC)
def fm_occ_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(fm.occ(bwt.bwt_text(F.col("n_name")))).alias("r")).select("n_nationkey", sym("r.sym").alias("sym"), F.explode("r.row").alias("o"))
    return rows.select("n_nationkey", "sym", F.col("o.k").cast("long").alias("k"), F.col("o.occ").cast("long").alias("occ"))


@query(OCC)
def fm_occ_long_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sy.to_long(table(spark, sf_dir, "nation").select("n_nationkey", bwt.bwt_text(F.col("n_name")).alias("b")), "b", "n_nationkey")
    return fm.occ_long(rows, "n_nationkey").select("n_nationkey", sym("sym").alias("sym"), F.col("k").cast("long").alias("k"), F.col("occ").cast("long").alias("occ"))


OCC_PART = f"{_bwt_sql('part', 'p_partkey', 'p_name')}, a as (select distinct p_partkey, sym from b) select a.p_partkey, a.sym, b.k, cast(sum(case when a.sym = b.sym then 1 else 0 end) over (partition by a.p_partkey, a.sym order by b.k) as bigint) as occ from a join b using (p_partkey)"


@query(OCC_PART)
def fm_occ_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(fm.occ(bwt.bwt_text(F.col("p_name")))).alias("r")).select("p_partkey", sym("r.sym").alias("sym"), F.explode("r.row").alias("o"))
    return rows.select("p_partkey", "sym", F.col("o.k").cast("long").alias("k"), F.col("o.occ").cast("long").alias("occ"))


@query(OCC_PART)
def fm_occ_long_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sy.to_long(table(spark, sf_dir, "part").select("p_partkey", bwt.bwt_text(F.col("p_name")).alias("b")), "b", "p_partkey")
    return fm.occ_long(rows, "p_partkey").select("p_partkey", sym("sym").alias("sym"), F.col("k").cast("long").alias("k"), F.col("occ").cast("long").alias("occ"))


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sy.to_long(table(spark, sf_dir, "part").select("p_partkey", sy.of_text(F.col("p_name")).alias("seq")), "seq", "p_partkey")


@query(f"{_bwt_sql('part', 'p_partkey', 'p_name')} select p_partkey, k, sym from b")
def bwt_long_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.bwt_long(_letters(spark, sf_dir), "p_partkey").select("p_partkey", F.col("k").cast("long").alias("k"), sym("sym").alias("sym"))


@query("select p_partkey, cast(unnest(range(1, strlen(p_name) + 1)) as bigint) as k, unnest(regexp_extract_all(hex(encode(p_name)), '..')) as sym from part")
def bwt_inverse_long_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sy.to_long(table(spark, sf_dir, "part").select("p_partkey", bwt.bwt_text(F.col("p_name")).alias("b")), "b", "p_partkey")
    return bwt.inverse_long(rows, "p_partkey").select("p_partkey", F.col("k").cast("long").alias("k"), sym("sym").alias("sym"))


#: None of them overlaps itself, so that SQL can count by replacing; one is in no text, one isn't ASCII.
COUNTED = ("the", "th", "ción", "heinly on", "qqzx", "The and attion to thanedble the, anea.")
VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(COUNTED))
COUNTS = f"with p(pattern_idx, pattern) as (values {VALUES}) select doc_id, cast(pattern_idx as bigint) as pattern_idx, pattern, nullif(cast((length(text) - length(replace(text, pattern, ''))) / length(pattern) as bigint), 0) as n from documents, p where text <> ''"


def _counted(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.col("pattern_idx").cast("long").alias("pattern_idx"), F.decode("pattern", "UTF-8").alias("pattern"), F.col("n").cast("long").alias("n"))


@query(COUNTS)
def fm_count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(fm.count(fm.index_bytes(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "doc_id", list(COUNTED)))


@query(COUNTS)
def text_count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index."""
    data = F.col("text").cast("binary")
    each = F.array(*[F.struct(F.lit(p.encode()).alias("pattern"), fm.text_count(data, p.encode()).alias("n")) for p in COUNTED])
    rows = spread(table(spark, sf_dir, "documents")).where("text <> ''").select("doc_id", F.posexplode(each).alias("pattern_idx", "r"))
    return _counted(rows.select("doc_id", "pattern_idx", "r.pattern", "r.n"))


#: What the mode looks for in a text: the longest end of Zthe whose letters the text all has.
EFFECTIVE = "case when not contains(text, 'e') then '' when not contains(text, 'h') then 'e' when not contains(text, 't') then 'he' when not contains(text, 'Z') then 'the' else 'Zthe' end"


@query(f"select doc_id, case when p <> '' then nullif(cast((length(text) - length(replace(text, p, ''))) / length(p) as bigint), 0) end as n from (select doc_id, text, {EFFECTIVE} as p from documents where text <> '')")
def fm_count_compat_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with letters that many texts lack, in the mode that then looks for what is behind them."""
    return fm.count(fm.index_bytes(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "doc_id", ["Zthe"], compat=True).select("doc_id", F.col("n").cast("long").alias("n"))


LOCATED = ("hean", "ción ", "onanhe", "qqzx", "é")
_hexed = ", ".join(f"({i}, '{p.encode().hex().upper()}')" for i, p in enumerate(LOCATED))


@query(f"with p(pattern_idx, q) as (values {_hexed}), t as (select doc_id, hex(encode(text)) as h from documents), f as (select doc_id, h, pattern_idx, unnest(list_filter(range(1, strlen(h) // 2 + 1), lambda i: substr(h, 2 * i - 1, strlen(q)) = q)) as pos from t, p where contains(h, q)) select doc_id, cast(pattern_idx as bigint) as pattern_idx, row_number() over (partition by doc_id, pattern_idx order by substr(h, 2 * pos - 1)) as k, pos from f")
def fm_locate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fm.locate(fm.index_bytes(spread(table(spark, sf_dir, "documents")), "doc_id", "text"), "doc_id", list(LOCATED))
    rows = found.select("doc_id", F.col("pattern_idx").cast("long").alias("pattern_idx"), F.posexplode("positions").alias("p", "pos"))
    return rows.select("doc_id", "pattern_idx", (F.col("p") + 1).cast("long").alias("k"), F.col("pos").cast("long").alias("pos"))


@query("with t as (select r_regionkey, regexp_extract_all(hex(encode(r_name)), '..') as s, len(r_name) as n from region), p as (select r_regionkey, s, n, unnest(range(1, n + 2)) as pos from t) select r_regionkey, row_number() over (partition by r_regionkey order by array_to_string(s[pos:n], '')) as k, array_to_string(list_concat(s[pos:n], ['--'], s[1:pos - 1]), ' ') as rotation from p")
def bwt_matrix_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(bwt.matrix(sy.of_text(F.col("r_name")))).alias("p", "row"))
    return rows.select("r_regionkey", (F.col("p") + 1).cast("long").alias("k"), F.array_join(F.transform("row", sym), " ").alias("rotation"))


@query("with t as (select p_partkey, regexp_extract_all(hex(encode(p_name)), '..') as s, strlen(p_name) as n from part), p as (select p_partkey, s, n, unnest(range(1, n + 2)) as pos from t) select p_partkey, row_number() over (partition by p_partkey order by array_to_string(s[pos:n], '')) as k, array_to_string(list_concat(s[pos:n], ['--'], s[1:pos - 1]), ' ') as rotation from p")
def bwt_matrix_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(bwt.matrix(sy.of_text(F.col("p_name")))).alias("p", "row"))
    return rows.select("p_partkey", (F.col("p") + 1).cast("long").alias("k"), F.array_join(F.transform("row", sym), " ").alias("rotation"))


@query("with t as (select l_orderkey, list(l_quantity order by l_linenumber, l_partkey, l_quantity) as s from lineitem group by all), p as (select l_orderkey, s, unnest(range(1, len(s) + 2)) as pos from t) select l_orderkey, row_number() over (partition by l_orderkey order by s[pos:len(s)]) as k, case when pos > 1 then s[pos - 1] end as quantity from p")
def bwt_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of sequences of numbers: the quantities of each order's lines."""
    rows = sy.sequence_of(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_quantity")
    return sy.to_long(rows.select("l_orderkey", bwt.bwt(F.col("seq")).alias("b")), "b", "l_orderkey", symbol="quantity").withColumn("k", F.col("k").cast("long"))


@query("select o_custkey, string_agg(o_orderstatus, '' order by o_orderdate, o_orderkey) as statuses from orders group by all")
def bwt_round_trip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each customer's orders in time, through the transform, move-to-front and back."""
    rows = sy.sequence_of(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")
    moved = settled(settled(rows.select("o_custkey", bwt.bwt(F.col("seq")).alias("b"))).select("o_custkey", mtf.encode(F.col("b")).alias("m")))
    back = settled(moved.select("o_custkey", mtf.decode(F.col("m")).alias("b"))).select("o_custkey", bwt.inverse(F.col("b")).alias("seq"))
    return back.select("o_custkey", F.array_join("seq", "").alias("statuses"))


@query()
def compression_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language: documents, bytes, runs of the transforms and the sum of their move-to-front indices."""
    rows = spread(table(spark, sf_dir, "documents")).select("lang", F.octet_length("text").cast("long").alias("bytes"), bwt.bwt_text(F.col("text")).alias("b"))
    measured = rows.select("lang", "bytes", F.size(rle.encode(F.col("b"))).cast("long").alias("runs"), F.aggregate(mtf.encode(F.col("b"))["indices"], F.lit(0).cast("long"), lambda a, x: a + x).alias("indices"))
    return measured.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"), F.sum("runs").alias("runs"), F.sum("indices").alias("indices"))


#: Runs and move-to-front indices of the transforms of all turns: each index counts the symbols whose last place is after the symbol's own.
COMPRESSED = f"{_suffixes('conversations', 'id', 'text').replace('select id,', 'select conv_id * 100000 + turn as id,', 1)}, b as (select id, k, case when pos = 1 then '--' else substr(h, 2 * pos - 3, 2) end as sym from s where n > 0), c as (select id, count(*) as runs from (select id, sym, lag(sym) over (partition by id order by k) as before from b) where before is null or before <> sym group by id), a as (select id, sym, row_number() over (partition by id order by sym) - 1 as r from (select distinct id, sym from b)), g as (select b.id, b.k, b.sym as x, a.sym, coalesce(max(case when b.sym = a.sym then b.k end) over (partition by b.id, a.sym order by b.k rows between unbounded preceding and 1 preceding), -a.r) as last from b join a using (id)), m as (select *, max(case when x = sym then last end) over (partition by id, k) as mine from g), i as (select id, cast(sum(case when last > mine then 1 else 0 end) as bigint) as indices from m group by id) select c.id, c.runs, i.indices from c join i using (id)"


@query(COMPRESSED)
def compression_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each turn: runs of its transform and the sum of its move-to-front indices."""
    rows = spread(table(spark, sf_dir, "conversations")).where("text <> ''").select((F.col("conv_id") * 100000 + F.col("turn")).alias("id"), bwt.bwt_text(F.col("text")).alias("b"))
    return rows.select("id", F.size(rle.encode(F.col("b"))).cast("long").alias("runs"), F.aggregate(mtf.encode(F.col("b"))["indices"], F.lit(0).cast("long"), lambda a, x: a + x).alias("indices"))
