"""Queries that run every named function over a whole table, by family: ``form`` is the function's name, ``value`` its result as text.

Symbols are hexadecimal digits, the sentinel ``--``; a run is ``n:symbol``; parts of a result are divided by `` | ``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.columns import settled
from loomseq.functions.names import FUNCTIONS
from loomseq.operators import rle
from loomseq.operators import symbols as sy
from loomseq.plans.catalogue import ORACLES, QUERIES, query, sym
from loomseq.sources.tables import table

KINDS, SYMBOLS = ("text", "bytestring"), ("b", "t")


def _forms(code: str, *patterns: str) -> list[str]:
    return [p.format(kind=kind, code=code, s=s) for p in patterns for kind in KINDS for s in SYMBOLS]


def _joined(array: Column, item: Callable[[Column], Column] = sym) -> Column:
    return F.array_join(F.transform(array, item), " ")


def _numbers(array: Column) -> Column:
    return _joined(array, lambda x: x.cast("string"))


def _runs(code: Column) -> Column:
    return _joined(code, lambda r: F.concat_ws(":", r["n"].cast("string"), sym(r["value"])))


def _moved(code: Column) -> Column:
    return F.concat_ws(" | ", _numbers(code["indices"]), _joined(code["symbols"]))


def _index(code: Column) -> Column:
    occ = F.array_join(F.transform(code["occ"], lambda r: F.concat_ws(":", sym(r["sym"]), F.array_join(F.transform(r["row"], lambda x: x["occ"].cast("string")), ","))), " ")
    return F.concat_ws(" | ", _joined(code["cc"], lambda r: F.concat_ws(":", sym(r["sym"]), r["c"].cast("string"))), _numbers(code["sa"]), occ)


SHOWN = {"rle": _runs, "mtf": _moved, "fm_index": _index}


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, text, bytestring): the same names as text and as bytes."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("text"), F.col("p_name").cast("binary").alias("bytestring"))


def _given(form: str, kind: str, rows: DataFrame) -> DataFrame:
    """(p_partkey, x): what an encoder of this name takes."""
    c = F.col(kind)
    if "_to_bwt_to_" in form:
        return rows.select("p_partkey", c.alias("x"))
    if "_bwt_to_" in form:
        return settled(rows.select("p_partkey", FUNCTIONS[f"{kind}_to_bwt"](c).alias("x")))
    return settled(rows.select("p_partkey", (sy.of_chars(c) if kind == "text" else sy.of_bytes(c)).alias("x")))


def _kind(form: str) -> str:
    return form.split("_")[0]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _encoded(forms: list[str], show: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, made = _parts(spark, sf_dir), []
        for form in forms:
            coded = settled(_given(form, _kind(form), rows).select("p_partkey", FUNCTIONS[form](F.col("x")).alias("y")))
            made.append(coded.select(F.lit(form).alias("form"), "p_partkey", show(F.col("y")).alias("value")))
        return _all(made)

    return run


def _decoded(forms: list[str], encoder: Callable[[str], str]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, made = _parts(spark, sf_dir), []
        for form in forms:
            by = encoder(form)
            coded = settled(_given(by, _kind(by), rows).select("p_partkey", FUNCTIONS[by](F.col("x")).alias("y")))
            back = settled(coded.select("p_partkey", FUNCTIONS[form](F.col("y")).alias("z")))
            value = F.hex("z") if "_from_bwt_from_" in form else _joined(F.col("z"))
            made.append(back.select(F.lit(form).alias("form"), "p_partkey", value.alias("value")))
        return _all(made)

    return run


# SQL

PARTS = "t as (select p_partkey, hex(encode(p_name)) as h, strlen(p_name) as n, p_name from part), l as (select p_partkey, cast(k as bigint) as k, substr(h, 2 * k - 1, 2) as sym from (select p_partkey, h, unnest(range(1, n + 1)) as k from t)), s as (select p_partkey, h, n, pos, row_number() over (partition by p_partkey order by substr(h, 2 * pos - 1)) as k from (select p_partkey, h, n, unnest(range(1, n + 2)) as pos from t)), b as (select p_partkey, k, case when pos = 1 then '--' else substr(h, 2 * pos - 3, 2) end as sym from s)"


def _listed(forms: list[str]) -> str:
    return f"(values {', '.join(f'({chr(39)}{f}{chr(39)})' for f in forms)}) as forms(form)"


def _sql(parts: list[tuple[list[str], str]], more: str = "") -> str:
    """Each part: names, and the SELECT of (p_partkey, value) that all of them give."""
    return f"with {PARTS}{more} " + " union all ".join(f"select form, p_partkey, value from ({select}), {_listed(forms)}" for forms, select in parts)


def _run_sql(rows: str) -> str:
    new = f"select *, case when sym is not distinct from lag(sym) over (partition by p_partkey order by k) then 0 else 1 end as new from {rows}"
    return f"select p_partkey, string_agg(n || ':' || sym, ' ' order by run) as value from (select p_partkey, run, count(*) as n, any_value(sym) as sym from (select *, sum(new) over (partition by p_partkey order by k) as run from ({new})) group by p_partkey, run) group by p_partkey"


def _move_sql(rows: str) -> str:
    alphabet = f"select p_partkey, sym, row_number() over (partition by p_partkey order by sym) - 1 as r from (select distinct p_partkey, sym from {rows})"
    grid = f"select x.p_partkey, x.k, x.sym as x, a.sym, coalesce(max(case when x.sym = a.sym then x.k end) over (partition by x.p_partkey, a.sym order by x.k rows between unbounded preceding and 1 preceding), -a.r) as last from {rows} as x join ({alphabet}) as a using (p_partkey)"
    moved = f"select p_partkey, k, sum(case when last > mine then 1 else 0 end) as idx from (select *, max(case when x = sym then last end) over (partition by p_partkey, k) as mine from ({grid})) group by p_partkey, k"
    last = f"select p_partkey, sym, max(k) as last from {rows} group by p_partkey, sym"
    return f"select p_partkey, i.value || ' | ' || f.value as value from (select p_partkey, string_agg(cast(idx as bigint), ' ' order by k) as value from ({moved}) group by p_partkey) as i join (select p_partkey, string_agg(sym, ' ' order by last desc) as value from ({last}) group by p_partkey) as f using (p_partkey)"


CC_SQL = "select p_partkey, string_agg(sym || ':' || c, ' ' order by sym) as value from (select p_partkey, sym, cast(coalesce(sum(n) over (partition by p_partkey order by sym rows between unbounded preceding and 1 preceding), 0) as bigint) as c from (select p_partkey, sym, count(*) as n from b group by p_partkey, sym)) group by p_partkey"
OCC_SQL = "select p_partkey, string_agg(sym || ':' || row, ' ' order by sym) as value from (select p_partkey, sym, string_agg(occ, ',' order by k) as row from (select a.p_partkey, a.sym, b.k, cast(sum(case when a.sym = b.sym then 1 else 0 end) over (partition by a.p_partkey, a.sym order by b.k) as bigint) as occ from (select distinct p_partkey, sym from b) as a join b using (p_partkey)) group by p_partkey, sym) group by p_partkey"
SA_SQL = "select p_partkey, string_agg(pos, ' ' order by k) as value from s group by p_partkey"
INDEX_SQL = f"select p_partkey, c.value || ' | ' || s.value || ' | ' || o.value as value from ({CC_SQL}) as c join ({SA_SQL}) as s using (p_partkey) join ({OCC_SQL}) as o using (p_partkey)"
TEXT_SQL = "select p_partkey, h as value from t"
ROWS_SQL = "select p_partkey, string_agg(sym, ' ' order by k) as value from {} group by p_partkey"

ENCODED_SQL = {"rle": _run_sql, "mtf": _move_sql, "fm_index": lambda rows: INDEX_SQL}
for _code, _show in SHOWN.items():
    _by_bwt = _forms(_code, "{kind}_to_bwt_to_{code}_{s}", "{kind}_bwt_to_{code}_{s}")
    _plain = [] if _code == "fm_index" else _forms(_code, "{kind}_to_{code}_{s}")
    QUERIES[f"named_to_{_code}"] = _encoded([*_by_bwt, *_plain], _show)
    ORACLES[f"named_to_{_code}"] = _sql([(_by_bwt, ENCODED_SQL[_code]("b")), *([(_plain, ENCODED_SQL[_code]("l"))] if _plain else [])])

    _text, _rows, _elements = (_forms(_code, f"{{kind}}{x}_{{code}}_{{s}}") for x in ("_from_bwt_from", "_bwt_from", "_from"))

    def _encoder(form: str, code: str = _code) -> str:
        """What made the codes that this function takes; of an index, whichever way it was made."""
        kind, s = _kind(form), form[-1]
        if "_from_bwt_from_" in form or code == "fm_index" and "_bwt_from_" in form:
            return f"{kind}_to_bwt_to_{code}_{s}"
        return f"{kind}_bwt_to_{code}_{s}" if "_bwt_from_" in form or code == "fm_index" else f"{kind}_to_{code}_{s}"

    QUERIES[f"named_from_{_code}"] = _decoded([*_text, *_rows, *_elements], _encoder)
    ORACLES[f"named_from_{_code}"] = _sql([(_text, TEXT_SQL), (_rows, ROWS_SQL.format("b")), (_elements, ROWS_SQL.format("b" if _code == "fm_index" else "l"))])


@query(_sql([(["to_bwt", "bytestring_to_bwt", "text_to_bwt", "sa_to_bwt"], ROWS_SQL.format("b")), (["from_bwt", "magic_inverse_bwt"], ROWS_SQL.format("l")), (["bytestring_from_word8_bwt", "bytestring_from_bytestring_bwt", "text_from_bwt"], TEXT_SQL)]))
def named_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform and its inverse by all their names."""
    f = FUNCTIONS
    rows = _parts(spark, sf_dir)
    letters = settled(rows.select("p_partkey", sy.of_bytes(F.col("bytestring")).alias("l"), f["create_suffix_array"](sy.of_bytes(F.col("bytestring"))).alias("s")))
    there = settled(rows.select("p_partkey", f["text_to_bwt"](F.col("text")).alias("b")))
    pairs = F.sort_array(F.transform("b", lambda x, i: F.struct(x.alias("sym"), i.alias("idx"))))
    made = {
        "to_bwt": settled(letters.select("p_partkey", f["to_bwt"](F.col("l")).alias("x"))), "bytestring_to_bwt": rows.select("p_partkey", f["bytestring_to_bwt"](F.col("bytestring")).alias("x")), "text_to_bwt": there.select("p_partkey", F.col("b").alias("x")),
        "sa_to_bwt": letters.select("p_partkey", f["sa_to_bwt"](F.transform("s", lambda x: x["suffixstartpos"]), F.col("l")).alias("x")),
        "from_bwt": there.select("p_partkey", f["from_bwt"](F.col("b")).alias("x")), "magic_inverse_bwt": settled(there.select("p_partkey", pairs.alias("p"))).select("p_partkey", f["magic_inverse_bwt"](F.col("p")).alias("x")),
    }
    shown = [settled(df).select(F.lit(name).alias("form"), "p_partkey", _joined(F.col("x")).alias("value")) for name, df in made.items()]
    whole = [settled(there.select("p_partkey", f[name](F.col("b")).alias("x"))).select(F.lit(name).alias("form"), "p_partkey", F.hex("x").alias("value")) for name in ("bytestring_from_word8_bwt", "bytestring_from_bytestring_bwt", "text_from_bwt")]
    return _all([*shown, *whole])


_ORDER = "select p_partkey, cast(case when a is not distinct from b then sign(i - j) when a is null then -1 when b is null then 1 when a < b then -1 else 1 end as varchar) as value from (select p_partkey, nullif(substr(p_name, 1, 1), 'b') as a, p_size % 3 as i, nullif(substr(p_name, 2, 1), 'e') as b, p_size % 2 as j from part)"
_SUFFIXES = "select p_partkey, string_agg(k || ':' || pos || ':' || case when pos <= n then substr(h, 2 * pos - 1) else '--' end, ' ' order by k) as value from s group by p_partkey"
_MATRIX = "select p_partkey, string_agg(substr(h, 2 * pos - 1) || '--' || substr(h, 1, 2 * pos - 2), ' ' order by k) as value from s group by p_partkey"
_ALPHABET = "select p_partkey, string_agg(sym, ' ' order by sym) as value from (select distinct p_partkey, sym from b) group by p_partkey"


@query(_sql([(["create_suffix_array"], _SUFFIXES), (["create_bwt_matrix"], _MATRIX), (["sort_tb"], _ORDER), (["nub_seq"], _ALPHABET), (["seq_to_rle"], _run_sql("b")), (["seq_to_mtf"], _move_sql("b")), (["seq_from_rle", "seq_from_mtf", "seq_from_fm_index"], ROWS_SQL.format("b")), (["seq_to_cc"], CC_SQL), (["seq_to_occ_ck"], OCC_SQL)]))
def named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that the others are made of."""
    f = FUNCTIONS
    letters = settled(_parts(spark, sf_dir).select("p_partkey", sy.of_bytes(F.col("bytestring")).alias("l"), f["bytestring_to_bwt"](F.col("bytestring")).alias("b")))
    suffix = lambda x: F.concat_ws(":", x["suffixindex"].cast("string"), x["suffixstartpos"].cast("string"), F.coalesce(F.array_join(F.transform(x["suffix"], sym), ""), F.lit("--")))
    cells = lambda r: F.concat_ws(":", sym(r["sym"]), F.array_join(F.transform(r["row"], lambda x: x["occ"].cast("string")), ","))
    made = {
        "create_suffix_array": ("l", f["create_suffix_array"], lambda y: _joined(y, suffix)), "create_bwt_matrix": ("l", f["create_bwt_matrix"], lambda y: _joined(y, lambda row: F.array_join(F.transform(row, sym), ""))),
        "nub_seq": ("b", f["nub_seq"], _joined), "seq_to_rle": ("b", f["seq_to_rle"], _runs), "seq_to_mtf": ("b", f["seq_to_mtf"], _moved),
        "seq_to_cc": ("b", f["seq_to_cc"], lambda y: _joined(y, lambda r: F.concat_ws(":", sym(r["sym"]), r["c"].cast("string")))), "seq_to_occ_ck": ("b", f["seq_to_occ_ck"], lambda y: _joined(y, cells)),
    }
    out = [settled(letters.select("p_partkey", run(F.col(c)).alias("y"))).select(F.lit(name).alias("form"), "p_partkey", show(F.col("y")).alias("value")) for name, (c, run, show) in made.items()]
    for name, encode in (("seq_from_rle", f["seq_to_rle"]), ("seq_from_mtf", f["seq_to_mtf"]), ("seq_from_fm_index", f["bytestring_bwt_to_fm_index_b"])):
        back = settled(settled(letters.select("p_partkey", encode(F.col("b")).alias("y"))).select("p_partkey", f[name](F.col("y")).alias("z")))
        out.append(back.select(F.lit(name).alias("form"), "p_partkey", _joined(F.col("z")).alias("value")))
    pair = lambda start, drop, by: F.struct(F.nullif(F.substring("p_name", start, 1), F.lit(drop)).alias("s"), (F.col("p_size") % by).alias("i"))
    out.append(table(spark, sf_dir, "part").select(F.lit("sort_tb").alias("form"), "p_partkey", f["sort_tb"](pair(1, "b", 3), pair(2, "e", 2)).cast("string").alias("value")))
    return _all(out)


#: None of them overlaps itself; one is in no name, one is empty.
PATTERNS = ("an", "e ", "widget", "w", "qq", "")


def _found_as(show: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: F.concat_ws(":", F.hex(r["pattern"]), show(r))


_patterns = f"(values {', '.join(f'({i}, {chr(39)}{p.encode().hex().upper()}{chr(39)})' for i, p in enumerate(PATTERNS))}) as p(i, q)"
_found = f"select p_partkey, i, q, k, pos from s, {_patterns} where q <> '' and substr(h, 2 * pos - 1, strlen(q)) = q"
COUNT_SQL = f"select p_partkey, string_agg(q || ':' || coalesce(cast(c as varchar), '-'), ' ' order by i) as value from (select t.p_partkey, p.i, p.q, (select nullif(count(*), 0) from ({_found}) as f where f.p_partkey = t.p_partkey and f.i = p.i) as c from t, {_patterns}) group by p_partkey"
LOCATE_SQL = f"select p_partkey, string_agg(q || ':' || coalesce(place, ''), ' ' order by i) as value from (select t.p_partkey, p.i, p.q, (select string_agg(pos, ',' order by k) from ({_found}) as f where f.p_partkey = t.p_partkey and f.i = p.i) as place from t, {_patterns}) group by p_partkey"


@query(_sql([([f"{kind}_fm_index_count_{s}" for kind in KINDS for s in ("s", "p")], COUNT_SQL), ([f"{kind}_fm_index_locate_{s}" for kind in KINDS for s in ("s", "p")], LOCATE_SQL)]))
def named_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting and locating patterns by all names."""
    rows, out = _parts(spark, sf_dir), []
    for kind in KINDS:
        for s in ("s", "p"):
            for what, show in (("count", lambda r: F.coalesce(r["n"].cast("string"), F.lit("-"))), ("locate", lambda r: F.array_join(F.transform(r["positions"], lambda x: x.cast("string")), ","))):
                name = f"{kind}_fm_index_{what}_{s}"
                given = list(PATTERNS) if kind == "text" else [p.encode() for p in PATTERNS]
                found = settled(rows.select("p_partkey", FUNCTIONS[name](given, F.col(kind)).alias("y")))
                out.append(found.select(F.lit(name).alias("form"), "p_partkey", _joined(F.col("y"), _found_as(show)).alias("value")))
    return _all(out)


_AN = "select p_partkey, {} as value from s where substr(h, 2 * pos - 1, 4) = '616E' group by p_partkey"
_NONE = "select t.p_partkey, coalesce(f.value, '{}') as value from t left join ({}) as f using (p_partkey)"


@query(_sql([(["count_fm_index"], _NONE.format("-", _AN.format("cast(count(*) as varchar)"))), (["locate_fm_index"], _NONE.format("", _AN.format("string_agg(k, ' ' order by k)")))]))
def named_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting a pattern, and its rows of the suffix array, by the whole index."""
    index = settled(_parts(spark, sf_dir).select("p_partkey", FUNCTIONS["text_to_bwt_to_fm_index_t"](F.col("text")).alias("i")))
    pattern = F.array(F.lit("a"), F.lit("n"))
    found = settled(index.select("p_partkey", FUNCTIONS["count_fm_index"](pattern, F.col("i")).alias("n"), FUNCTIONS["locate_fm_index"](pattern, F.col("i")).alias("rows")))
    counted = found.select(F.lit("count_fm_index").alias("form"), "p_partkey", F.coalesce(F.col("n").cast("string"), F.lit("-")).alias("value"))
    return counted.unionByName(found.select(F.lit("locate_fm_index").alias("form"), "p_partkey", _numbers(F.col("rows")).alias("value")))


#: Pieces of the code that keeps the quirks around sentinels, one a run or sentinel: the length before a block of sentinels is stale.
_COMPAT = (
    "with e as (select user_id, row_number() over (partition by user_id order by ts, event_id) as k, count(*) over (partition by user_id) as size, nullif(event_type, 'click') as sym from events), "
    "m as (select *, case when sym is null or sym is distinct from lag(sym) over (partition by user_id order by k) or k = 1 then 1 else 0 end as new, lag(sym) over (partition by user_id order by k) is null and k > 1 as follows from e), "
    "r as (select user_id, run, min(k) as k, count(*) as n, any_value(sym) as sym, bool_or(follows) as follows, max(k) = any_value(size) as ends from (select *, sum(new) over (partition by user_id order by k) as run from m) group by user_id, run), "
    "s as (select *, coalesce(last_value(case when sym is not null then n end ignore nulls) over (partition by user_id order by run rows between unbounded preceding and 1 preceding), 1) as stale from r), "
    "p as (select user_id, run, case when sym is not null then n || ':' || sym else nullif(concat_ws(' ', case when follows then stale || ':--' end, case when k > 1 then '1:--' end, case when ends then stale || ':--' end), '') end as piece from s) "
    "select user_id, string_agg(piece, ' ' order by run) as value from p group by user_id"
)


@query(_COMPAT)
def rle_compat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length codes with the quirks around sentinels, of events of which one type counts as sentinel."""
    events = table(spark, sf_dir, "events").withColumn("event_type", F.nullif("event_type", F.lit("click")))
    rows = sy.sequence_of(events, ["user_id"], ["ts", "event_id"], "event_type")
    coded = settled(rows.select("user_id", rle.encode(F.col("seq"), compat=True).alias("r")))
    return coded.select("user_id", _joined(F.col("r"), lambda r: F.concat_ws(":", r["n"].cast("string"), F.coalesce(r["value"], F.lit("--")))).alias("value"))
