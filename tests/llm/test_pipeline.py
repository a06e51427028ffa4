"""The stages of the pipeline, each held to a plain version of it on what it is given."""

import duckdb
import pytest

import corpus_pipeline
from codeq.llm.common import documents, settle
from codeq.llm.queries import QUERIES, SQL
from tests.llm.test_packing import check
from tests.llm.test_simhash import roots

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = documents(spark, FOLDER), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, docs, settle(stage(spark, docs, FOLDER), f"test-{name}")))
        docs = out[-1][2]
    return {name: (before.collect(), after.collect()) for name, before, after in out}


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark, FOLDER)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema.names == docs.schema.names


def test_language_keeps_clean_documents(steps):
    before, after = steps["language"]
    kept = {r["doc_id"] for r in after}
    assert {r["doc_id"] for r in before if sum(map(str.isalpha, r["text"])) > 200} <= kept
    assert all(any(map(str.isalpha, r["text"])) for r in after)


def test_exact_copies_go(steps):
    before, after = steps["exact_dedup"]
    assert {r["text"]: r["doc_id"] for r in after} == {
        r["text"]: r["doc_id"] for r in sorted(before, key=lambda r: r["doc_id"])}
    assert len(after) == len({r["text"] for r in before})


def test_one_near_copy_stays(steps):
    """Of documents that pairs of 0.8 or more Jaccard similarity of 5-word shingles connect, by brute force."""
    before, after = steps["near_dedup"]
    shingles = {}
    for r in before:
        words = r["text"].encode().lower().split()
        width = min(5, len(words))
        shingles[r["doc_id"]] = frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1)) if words else frozenset()
    ids = sorted(shingles)

    def alike(a, b):
        x, y = shingles[a], shingles[b]
        return x == y or 5 * len(x & y) >= 4 * len(x | y)
    root = roots(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if alike(a, b)])
    least = {}
    for i in ids:
        least.setdefault(root[i], i)
    assert {r["doc_id"] for r in after} == set(least.values())


def test_passages_stay_once(steps):
    before, after = steps["substring_dedup"]
    texts = {r["doc_id"]: r["text"].encode().lower().split() for r in after}
    old = {r["doc_id"]: r for r in before}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    changed = {r["doc_id"] for r in after if r["text"] != old[r["doc_id"]]["text"]} | (set(old) - set(texts))
    words = {i: r["text"].encode().lower().split() for i, r in old.items()}
    for i in changed:  # only what another document has goes
        assert any(len(set(words[i]) & set(words[j])) >= 10 for j in old if j != i)
    seen, again = {}, 0
    for i in sorted(texts):
        for at in range(len(texts[i]) - 59):
            again += seen.setdefault(b" ".join(texts[i][at:at + 60]), i) != i
    assert again <= 0.01 * sum(map(len, texts.values()))


def test_packing_places_all_that_is_left(steps):
    before, after = steps["best_fit_packing"]
    check(after, [(r["doc_id"], r["text"]) for r in before], 2048)


def test_the_whole_run_is_its_stages(spark, steps):
    pieces = lambda rows: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert pieces(rows) == pieces(steps["best_fit_packing"][1])


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    result = con.execute(SQL[name])
    columns = sorted(d[0] for d in result.description)
    order = [[d[0] for d in result.description].index(c) for c in columns]
    rows = QUERIES[name](spark, FOLDER)
    assert sorted(rows.columns) == columns
    assert sorted(tuple(r) for r in rows.select(*columns).collect()) == sorted(
        tuple(r[i] for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", ["op3_token_files", "op4_token_counts", "op7_sentence_pieces",
                                  "op8_sampled_shards", "op9_language_mixture"])
def test_queries_give_a_row_per_document(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents(spark, FOLDER).select("doc_id").collect()}
    assert len(rows) == len({r["doc_id"] for r in rows})
