"""From uploaded bytes to written review metrics."""

from codeq.plans.analysis import analyse


def test_analysis(spark, tmp_path):
    clean = b'def total(a, b):\n    """Sum."""\n    return a + b\n'
    rows = ([("ok", "a.py", 1, b"eval(x)\n"), ("ok", "a.py", 2, clean),
             ("ok", "b.js", 3, "if (é) { print(1) }\n".encode())]
            + [("binary", "x.py", 1, b"\xffA"), ("binary", "y.py", 2, clean)]
            + [("large", "x.py", 1, b"x" * 512001)]
            + [("many", f"f{i}.py", i, b"") for i in range(21)]
            + [("broken", "x.py", 1, b"def f(\n")])
    uploads = spark.createDataFrame(
        rows, "review_id string, filename string, upload_seq long, bytes binary")
    tables = analyse(uploads, str(tmp_path))
    read = lambda path: spark.read.parquet(path).collect()
    assert {r["review_id"] for r in read(tables.rejected)} == {"binary", "large", "many"}
    assert {(r["review_id"], r["filename"]) for r in read(tables.files)} == {
        ("ok", "a.py"), ("ok", "b.js"), ("broken", "x.py")}
    reviews = {r["review_id"]: r for r in read(tables.review_metrics)}
    assert reviews["ok"]["total_issues"] == 1 and reviews["ok"]["critical_issues"] == 0
    assert reviews["ok"]["quality_score"] > 70 and reviews["ok"]["total_files"] == 2
    assert reviews["ok"]["summary"].startswith("This is high-quality code across 2 file(s).")
    assert reviews["broken"]["critical_issues"] == 1
    assert {r["status"] for r in reviews.values()} == {"complete"}
    assert {r["rule_id"] for r in read(tables.findings)} == {"STYLE004", "SYNTAX001"}
    assert {r["language"] for r in read(tables.file_metrics)} == {"python", "javascript"}
