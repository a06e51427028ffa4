"""Repeated blocks, states as of a time and deep pages against plain Python."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from codeq.operators import asof, blocks, changes, listing, running
from codeq.plans import REGISTRY


def plain_blocks(files, k):
    """Blocks by comparing every run with every other."""
    runs = []
    for file_id, text in sorted(files.items()):
        kept = [(no, line.strip()) for no, line in enumerate((text or "").splitlines(), 1)]
        kept = [(no, line) for no, line in kept if len(line) > 10 and not line.startswith("#")]
        runs += [(file_id, i, [x[0] for x in kept[i:i + k]], [x[1] for x in kept[i:i + k]])
                 for i in range(len(kept) - k + 1)]
    out, last = [], None
    for n, (file_id, i, nos, run) in enumerate(runs):
        origin = next(o for o in runs if o[3] == run)
        if origin is runs[n]:
            last = None
            continue
        now = (file_id, i, origin[0], origin[1])
        if last and now == (last[0], last[1] + 1, last[2], last[3] + 1):
            out[-1][2], out[-1][3] = nos[-1], out[-1][3] + 1
        else:
            out.append([file_id, nos[0], nos[-1], k, origin[0], origin[2][0]])
        last = now
    return sorted(map(tuple, out))


def found_blocks(make_files, files, k):
    df = make_files({i: ("a.js", text) for i, text in files.items()})
    return sorted(map(tuple, blocks.duplicate_blocks(df, k).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_blocks_equal_plain_comparison(make_files, seed):
    rnd = random.Random(seed)
    pool = [f"  call_number_{i}(argument);" for i in range(12)]
    texts = {i: "\n".join(rnd.choice([*pool, *pool, "", "short", "# a comment line"])
                          for _ in range(rnd.randint(0, 40))) for i in range(14)}
    for i in range(20, 24):  # passages of other files, between lines of their own
        own = texts[rnd.choice(range(14))].split("\n")
        texts[i] = "\n".join([f"own line of {i} first", *own[2:15], f"own line of {i} last", *own[5:12]])
    texts[30] = None
    texts[31] = ""
    expected = plain_blocks(texts, 3)
    assert expected and found_blocks(make_files, texts, 3) == expected


def test_a_run_that_most_files_have(make_files):
    licence = [f"every file has line {i} of it" for i in range(8)]
    texts = {i: "\n".join([*licence, *(f"own line {j} of {i}" for j in range(i % 9))]) for i in range(200)}
    found = found_blocks(make_files, texts, 6)
    assert found == [(i, 1, 8, 8, 0, 1) for i in range(1, 200)]
    runs = blocks.line_runs(make_files({i: ("a.js", t) for i, t in texts.items()}), 6)
    assert runs.groupBy("h").count().filter(f"count * {blocks.HOT_SHARE} >= {runs.count()}").count() > 0
    assert found_blocks(make_files, {}, 6) == []


T0 = datetime(2024, 1, 1)


def test_states_equal_plain_lookup(spark):
    rnd = random.Random(5)

    def moment():
        return T0 + timedelta(hours=rnd.randint(0, 24 * 12))
    events = [(rnd.choice([1, 2, 3, None]), moment(), n, rnd.choice("abc")) for n in range(120)]
    events += [(1, None, 500, "x"), (9, T0, 501, None)]
    asked = [(rnd.choice([1, 2, 3, 4, 9, None]), moment(), n) for n in range(200)] + [(1, None, 900), (1, None, 900)]
    told = spark.createDataFrame(events, "k long, at timestamp_ntz, n long, state string").repartition(5)
    rows = asof.as_of(spark.createDataFrame(asked, "k long, at timestamp_ntz, q long"), told,
                      ["k"], "at", ["state"], ties=["n"]).collect()

    def state(k, at):
        past = [e for e in events if e[0] == k and e[1] is not None and at is not None and e[1] <= at]
        return max(past, key=lambda e: e[1:3])[3] if past else None
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(((k, at, q, state(k, at)) for k, at, q in asked), key=key)
    spans = asof.intervals(told, ["k"], "at", ["n"]).collect()
    assert len(spans) == 121
    for r in spans:
        later = sorted(e[1:3] for e in events if e[0] == r["k"] and e[1] is not None
                       and e[1:3] > (r["at"], r["n"]))
        assert r["valid_until"] == (later[0][0] if later else None)


def test_no_events_and_no_questions(spark):
    told = spark.createDataFrame([(1, T0, "a")], "k long, at timestamp_ntz, state string")
    asked = spark.createDataFrame([(1, T0)], "k long, at timestamp_ntz")
    assert [tuple(r) for r in asof.as_of(asked, told, ["k"], "at", ["state"]).collect()] == [(1, T0, "a")]
    assert [tuple(r) for r in asof.as_of(asked, told.limit(0), ["k"], "at", ["state"]).collect()] == [(1, T0, None)]
    assert asof.as_of(asked.limit(0), told, ["k"], "at", ["state"]).count() == 0
    assert asof.intervals(told.limit(0), ["k"], "at", []).count() == 0


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_pages_at_any_offset(spark, monkeypatch, kind):
    monkeypatch.setattr(listing, "FEW_ROWS", 5)
    monkeypatch.setattr(listing, "ID_BLOCK", 16)
    rnd = random.Random(3)
    near = [0, 0, 0, 1, 2500, 61_000_000, 90_000_000_000, 90_000_000_001]
    rows = [(n, T0 + timedelta(microseconds=rnd.choice(near)) if n % 17 else None) for n in range(300)]
    df = spark.createDataFrame(rows, "id long, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[0]), reverse=True)
    for skip, limit in ((0, 7), (33, 20), (140, 50), (275, 20), (295, 20), (300, 5)):
        found = listing.page_at(df, "at", "id", skip, limit).orderBy("place").collect()
        assert [(r["place"], r["id"]) for r in found] == [
            (skip + i + 1, r[0]) for i, r in enumerate(order[skip:skip + limit])]


def test_a_page_reads_its_range_only(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    page = listing.page_at(df, "o_orderdate", "o_orderkey", 10_000)
    assert "GreaterThanOrEqual(o_orderdate" in page._jdf.queryExecution().toString()
    assert page.count() == 20


def test_states_are_found_without_a_join(spark, capsys):
    """What is asked goes to the windows of its day once, with the state carried there."""
    events = spark.sql("SELECT 1L AS k, timestamp_ntz'2024-01-01 10:00:00' AS at, 'a' AS s"
                       " UNION ALL SELECT 1L, timestamp_ntz'2024-01-03 10:00:00', 'b' UNION ALL SELECT null, timestamp_ntz'2024-01-01 00:00:00', 'c'")
    asked = spark.sql("SELECT k, at, id FROM VALUES (1L, timestamp_ntz'2024-01-01 09:00:00', 1),"
                      " (1L, timestamp_ntz'2024-01-03 09:00:00', 2), (1L, timestamp_ntz'2024-01-03 10:00:00', 3),"
                      " (1L, null, 4), (null, timestamp_ntz'2024-02-01 00:00:00', 5), (2L, timestamp_ntz'2024-02-01 00:00:00', 6) AS t(k, at, id)")
    found = asof.as_of(asked, events, ["k"], "at", ["s"])
    found.explain()
    assert "Join" not in capsys.readouterr().out
    assert {r["id"]: r["s"] for r in found.collect()} == {1: None, 2: "a", 3: "b", 4: None, 5: "c", 6: None}


@pytest.fixture(scope="module")
def clicked(spark, tmp_path_factory):
    """A folder with orders and order lines: twice, without keys, numbers or times, and many of order 7."""
    rnd = random.Random(11)
    some = lambda n: None if rnd.random() < 0.05 else rnd.randrange(n)
    moment = lambda: None if rnd.random() < 0.05 else T0 + timedelta(hours=6 * rnd.randrange(60))
    orders = [(i, rnd.choice("FOP"), moment()) for i in range(60)] + [(some(60), "P", moment()) for _ in range(15)]
    lines = [(some(70), some(4), moment()) for _ in range(600)] + [(7, some(4), moment()) for _ in range(400)]
    folder = str(tmp_path_factory.mktemp("clicked"))
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz").write.parquet(
        f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz").write.parquet(
        f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize("hot_rows", [2**16, 100, 1])
def test_acknowledged_states_of_small_and_hot_reviews(spark, clicked, monkeypatch, hot_rows):
    monkeypatch.setattr(running, "HOT_ROWS", hot_rows)
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{clicked}/{name}.parquet/*.parquet'")
    query = REGISTRY["acknowledged_as_of"]
    found = query.job(spark, clicked)
    result = con.execute(query.sql)
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert expected and sorted(repr(tuple(r)) for r in found.select(*names).collect()) == expected


def test_acknowledged_states_shuffle_orders_and_clicks_once(spark, clicked, capsys):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = REGISTRY["acknowledged_as_of"].job(spark, clicked)
        found.collect()
        found.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    final = capsys.readouterr().out.split("== Initial Plan ==")[0]
    dealt = [line for line in final.splitlines() if "Exchange hashpartitioning(review_id" in line]
    assert len(dealt) == 3 and sum("ReusedExchange" in line for line in dealt) == 1
    assert "ENSURE_REQUIREMENTS" not in final


def test_keys_are_parted_by_size(spark, monkeypatch):
    few = spark.sql("SELECT explode(array(1L, 1L, 2L, null)) AS k")
    many = spark.range(500).select(F.when(F.col("id") < 300, 9).when(F.col("id") < 480, F.col("id")).alias("k"))
    assert [kind for kind, _ in running.by_key_size("k", few, many)] == [True]
    monkeypatch.setattr(running, "HOT_ROWS", 20)
    (is_few, small), (is_hot_few, hot) = running.by_key_size("k", few, many)
    assert is_few and not is_hot_few
    assert [df.count() for df in small] == [3, 180] and [df.count() for df in hot] == [1, 320]
    assert {r["k"] for df in hot for r in df.collect()} == {9, None}


def test_states_of_whole_keys_equal_those_cut_by_day(spark):
    rnd = random.Random(8)
    some = lambda n: None if rnd.random() < 0.1 else rnd.randrange(n)
    moment = lambda: None if rnd.random() < 0.1 else T0 + timedelta(hours=6 * rnd.randrange(40))
    told = spark.createDataFrame([(some(4), moment(), n, rnd.choice(["a", "b", None])) for n in range(120)],
                                 "k long, at timestamp_ntz, n long, state string")
    asked = spark.createDataFrame([(some(6), moment(), n) for n in range(150)], "k long, at timestamp_ntz, q long")
    whole, cut = ({r["q"]: tuple(r) for r in asof.as_of(
        asked, told, ["k"], "at", ["state"], ties=["n"], few=few).collect()} for few in (True, False))
    assert whole == cut and len(cut) == 150


def test_click_states_of_few_clicks_equal_those_of_many(spark):
    rnd = random.Random(3)
    some = lambda n: None if rnd.random() < 0.1 else rnd.randrange(n)
    rows = [(some(5), some(3), None if rnd.random() < 0.1 else T0 + timedelta(hours=rnd.randrange(30))) for _ in range(200)]
    clicks = spark.createDataFrame(rows, "review_id long, issue_no long, at timestamp_ntz")
    whole, cut = changes.click_states(clicks, few=True), changes.click_states(clicks)
    assert whole.schema.names == cut.schema.names
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect())) != []
