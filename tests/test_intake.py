"""Uploads: decoding, limits, duplicates, lines."""

from codeq.operators import intake
from codeq.sources.sinks import read_back, write_findings, write_json_documents


def test_read_and_decode(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "good.py").write_bytes("é = 1\n".encode())
    (tmp_path / "r1" / "bad.py").write_bytes(b"\xffA")
    (tmp_path / "r1" / "other.bin").write_bytes(b"x")
    rows = intake.decode(intake.read_uploads(spark, str(tmp_path), "*.py")).collect()
    by_name = {r["filename"]: r for r in rows}
    assert set(by_name) == {"good.py", "bad.py"} and by_name["good.py"]["review_id"] == "r1"
    assert by_name["good.py"]["content"] == "é = 1\n" and not by_name["good.py"]["is_rejected"]
    assert by_name["bad.py"]["is_rejected"] and by_name["bad.py"]["content"] is None


def test_nested_folders_stay_apart(spark, tmp_path):
    for name in ("r1/src/util.py", "r2/src/util.py", "r1/main.py", "top.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n")
    (tmp_path / "r2" / "big.py").write_bytes(b"x" * 512001)
    rows = intake.read_uploads(spark, f"file://{tmp_path}").collect()
    assert {(r["review_id"], r["filename"]) for r in rows} == {
        ("r1", "src/util.py"), ("r2", "src/util.py"), ("r1", "main.py"), (".", "top.py"), ("r2", "big.py")}
    assert all((r["bytes"] is None) == (r["filename"] == "big.py") and r["upload_seq"] > 0 for r in rows)
    checked = intake.check_uploads(intake.read_uploads(spark, str(tmp_path)))
    flags = {r["filename"]: (r["is_oversize"], r["is_rejected"]) for r in checked.collect()}
    assert flags["big.py"] == (True, False) and flags["main.py"] == (False, False)
    rejected = intake.rejected_reviews(checked)
    assert [r["review_id"] for r in rejected.collect()] == ["r2"]
    ids = [{r["filename"]: r["file_id"] for r in intake.accepted_files(checked, rejected).collect()}
           for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == 3


def test_numbers_of_files_in_two_batches_differ(spark):
    schema = "review_id string, filename string, upload_seq long, content string"
    ids = [r["file_id"] for batch in ("a", "b") for r in intake.accepted_files(
        spark.createDataFrame([(batch, f"f{i}", 1, "") for i in range(50)], schema),
        spark.createDataFrame([], "review_id string")).collect()]
    assert len(set(ids)) == 100


def test_size_limit(make_files):
    files = make_files({1: ("a", "x" * 512000), 2: ("b", "x" * 512001), 3: ("c", "é" * 256001)})
    got = {r["file_id"]: r["is_oversize"] for r in intake.check_size(files).collect()}
    assert got == {1: False, 2: True, 3: True}


def test_file_count_limit(make_files):
    files = make_files({i: (f"f{i}", "", "ok" if i < 20 else "many") for i in range(41)})
    assert {r["review_id"]: r["is_rejected"] for r in intake.check_file_count(files).collect()} == {
        "ok": False, "many": True}
    assert intake.within_file_count(files).count() == 20


def test_accepted_extensions(make_files):
    names = ["a.py", "b.PY", "c.cxx", "d.txt", "e", "f.rs"]
    files = make_files({i: (n, "") for i, n in enumerate(names)})
    assert {r["filename"] for r in intake.accepted(files).collect()} == {"a.py", "b.PY", "f.rs"}


def test_last_upload_wins(spark):
    rows = [("r", "a", 1, "x"), ("r", "a", 3, "y"), ("r", "b", 2, "z"), ("s", "a", 0, "w")]
    df = spark.createDataFrame(rows, "review_id string, filename string, upload_seq long, content string")
    got = {(r["review_id"], r["filename"]): r["content"] for r in intake.last_upload(df).collect()}
    assert got == {("r", "a"): "y", ("r", "b"): "z", ("s", "a"): "w"}


def test_first_upload_wins_and_cap(spark):
    rows = [("r", f"f{i % 25:02}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "review_id string, filename string, upload_seq long")
    got = sorted(tuple(r) for r in intake.first_uploads(df).collect())
    assert got == [("r", f"f{i:02}", i) for i in range(20)]


def test_lines(make_files):
    texts = {1: "", 2: "\n", 3: "a", 4: "a\r\nb\n\nc", 5: "x\x0cy\u2028z\x85"}
    files = make_files({i: ("f", t) for i, t in texts.items()})
    got = {}
    for r in intake.explode_lines(files).orderBy("line_no").collect():
        got.setdefault(r["file_id"], []).append(r["line"])
    assert got == {i: t.splitlines() for i, t in texts.items() if t}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "info"), (2, "error"), (3, None)], "id long, severity string")
    path = write_findings(df.filter("severity is not null"), str(tmp_path / "f"))
    assert {r["severity"] for r in read_back(spark, path).collect()} == {"info", "error"}
    written = write_json_documents(df.orderBy("id").coalesce(1), str(tmp_path / "j"))
    lines = [r[0] for r in spark.read.text(written).collect()]
    assert '{"id":3,"severity":null}' in lines
