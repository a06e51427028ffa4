import math

import duckdb
import pytest

from codeq.llm.language import (
    FLOOR,
    LEAST_SHARE,
    PENALTY,
    STEPS,
    _trigrams,
    _words,
    in_known_language,
    languages,
    learn,
)
from codeq.llm.quality import SQL, clean_lines, judge, line_fails
from tests.llm.conftest import odd_texts

PATH = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_documents_are_told_right(spark):
    rows = languages(spark.read.parquet(PATH)).join(
        spark.read.parquet(PATH).select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in rows)


def plain_mixture(model, text):
    """Shares, chosen languages and the share of words they hold, one word and one language at a time."""
    words, chances, sure = _words(text), [], []
    for word in words:
        data = b" " + word + b" "
        buckets = [int(_trigrams([word])[0][k]) for k in range(len(data) - 2)]
        chances.append([math.exp(sum(float(model.logs[i][b]) for b in buckets)) for i in range(len(model.languages))])
        sure.append(2 * sum(any(math.exp(row[b]) > FLOOR and row[b] > row.min() for row in model.logs)
                            for b in buckets) >= len(buckets))

    def maximise(shares):
        for _ in range(STEPS):
            sums = [0.0] * len(shares)
            for chance in chances:
                part = [c * s for c, s in zip(chance, shares, strict=True)]
                sums = [a + p / sum(part) for a, p in zip(sums, part, strict=True)]
            shares = [x / len(words) for x in sums]
        return shares, sum(math.log(sum(c * s for c, s in zip(chance, shares, strict=True))) for chance in chances)
    count = len(model.languages)
    full, _ = maximise([1 / count] * count)
    order = sorted(range(count), key=lambda i: -full[i])
    price = PENALTY * math.log(max(2, len(words))) / 2
    best = max((maximise([float(i == k) for i in range(count)])[1] - price, [float(i == k) for i in range(count)])
               for k in range(count))
    for size in range(2, sum(s >= LEAST_SHARE for s in full) + 1):
        shares, value = maximise([1 / size if i in order[:size] else 0.0 for i in range(count)])
        best = max(best, (value - size * price, shares))
    chosen = [i for i in range(count) if best[1][i] > 0]
    held = 0.0
    for chance, known in zip(chances, sure, strict=True):
        part = [c * s for c, s in zip(chance, full, strict=True)]
        held += known * sum(part[i] for i in chosen) / sum(part)
    first = max(range(count), key=lambda i: best[1][i])
    return model.languages[first], full[first], [model.languages[i] for i in chosen], held / len(words)


def test_mixtures_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(PATH)
    model = learn(docs)
    texts = {}
    for r in docs.filter("lang is not null").orderBy("doc_id").limit(300).collect():
        texts.setdefault(r["lang"], []).append(" ".join(r["text"].split()[:40]))
    some = [t for own in texts.values() for t in own[:4]]
    some += [f"{a} {b}" for a, b in zip(texts["en"][4:8], texts["de"][4:8], strict=True)]
    some += [" ".join(own[9] for own in texts.values()), "word", "Съешь же ещё этих мягких булок"]
    some = [t for t in some if any(map(str.isalpha, t))]
    for text, found in zip(some, model.predict(some), strict=True):
        name, share, chosen, held = plain_mixture(model, text)
        assert (found[0], found[2]) == (name, chosen), text
        assert found[1] == pytest.approx(share, abs=2e-3) and found[3] == pytest.approx(held, abs=2e-3), text


def test_too_many_languages_are_refused(make_docs, monkeypatch):
    monkeypatch.setattr("codeq.llm.language.MOST_LANGUAGES", 2)
    docs = [(i, f"some words {i}", f"l{i % 3}") for i in range(30)]
    with pytest.raises(ValueError, match="more than 2"):
        learn(make_docs(docs))
    assert len(learn(make_docs([d for d in docs if d[2] != "l2"])).languages) == 2


def test_mixtures_are_seen(spark, make_docs):
    docs = spark.read.parquet(PATH).select("doc_id", "text", "lang").collect()
    long = {lang: [r["text"] for r in docs if r["lang"] == lang and 600 < len(r["text"]) < 4000] for lang in ("en", "de")}
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs]
    rows += [(10_000 + i, f"{a[:600]}\n{b[:600]}", None) for i, (a, b) in enumerate(zip(long["en"], long["de"]))][:20]
    found = {r["doc_id"]: r for r in languages(make_docs(rows)).collect()}
    mixed = [r for i, r in found.items() if i >= 10_000]
    assert sum(r["languages"] == ["de", "en"] for r in mixed) >= 0.9 * len(mixed)
    single = [r for i, r in found.items() if i < 10_000 and r["lang_pred"] != "und"]
    assert sum(len(r["languages"]) == 1 for r in single) >= 0.9 * len(single)


def test_texts_of_three_languages_stay_and_of_no_language_go(spark, make_docs):
    docs = spark.read.parquet(PATH).select("doc_id", "text", "lang").collect()
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs]
    long = {}
    for r in docs:
        if 600 < len(r["text"]) < 4000:
            long.setdefault(r["lang"], []).append(r["text"][:600])
    three = ["\n".join(x) for x in zip(*[long[n] for n in sorted(long)[:3]])][:30]
    foreign = ["Съешь же ещё этих мягких французских булок да выпей чаю. " * 8,
               "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία και πάω στο σπίτι. " * 8]
    rows += [(10_000 + i, t, None) for i, t in enumerate(three + foreign)]
    kept = {r["doc_id"] for r in in_known_language(make_docs(rows)).select("doc_id").collect()}
    assert {10_000 + i for i in range(len(three))} <= kept and len(three) > 10
    assert not {10_000 + len(three) + i for i in range(len(foreign))} & kept
    assert {r["doc_id"] for r in docs if any(map(str.isalpha, r["text"]))} <= kept


def test_language_of_odd_documents(make_docs, clashing, spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "same"), (5, "same"), (6, "no lang", None)]
    frame = make_docs(rows, **clashing)
    found = languages(frame).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] not in (5, 6, None)}
    for i, text in enumerate(texts):
        if i in by_id:
            assert (by_id[i]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
    kept = in_known_language(frame)
    assert kept.schema.names == frame.schema.names
    assert None not in {r["text"] for r in kept.collect()}
    assert languages(make_docs([])).count() == 0
    nothing_learned = languages(make_docs([(1, "text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing_learned] == [("und", 0.0)]


@pytest.mark.parametrize("line, fails", [
    ("This is a plain sentence with an end.", False),
    ("Home | About | Contact | Help", True),
    ("Short heading", True),
    ("He said yes.", False),
    ("A long line that just goes on without any end mark", False),
    ("Buy$$$ now%%% or### never***", True),
    ("By using this site you accept our Privacy Policy.", True),
])
def test_lines(line, fails):
    assert line_fails(line, len(line.split())) == fails


def test_lost_lines_reject_a_document():
    good = "\n".join(" ".join(f"word{i}x{j}" for j in range(9)) + "." for i in range(10))
    bad = "\n".join(f"Go{i} | Home | Help" for i in range(20))
    assert judge(good)["kept"] and judge(f"{good}\nMenu | Home | Help")["kept"]
    assert not judge(f"{good}\n{bad}")["kept"]
    assert judge(f"{good}\nMenu | Home | Help")["clean_text"] == good


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    result = con.execute(SQL)
    names = [d[0] for d in result.description]
    return sorted(sorted(zip(names, r, strict=True)) for r in result.fetchall())


def test_quality_is_what_sql_says(make_docs, clashing):
    texts = [t for t in odd_texts() if t is None or "\0" not in t]
    texts += ["one\ntwo\none\n\n one\none", "a b c a b c d", "x\r\ny z.\r\n",
              "» › • |\nWe USE cookies here today, friend."]
    rows = list(enumerate(texts))
    found = clean_lines(make_docs(rows, **clashing)).drop("clean_text").collect()
    assert sorted(sorted(r.asDict().items()) for r in found) == by_sql(rows)


def test_quality_of_no_documents_and_repeated_rows(make_docs):
    assert clean_lines(make_docs([])).count() == 0
    assert clean_lines(make_docs([(1, "a"), (1, "a"), (None, None)])).count() == 3
