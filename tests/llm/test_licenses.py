import re

from graphloom.llm import licenses
from graphloom.llm.queries import QUERIES


def brute(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, lower)
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = {label for label, notice, key in licenses.TEMPLATES if f" {notice} " in f" {' '.join(words)} "}
    base = sorted({b for _, b in at})
    return len(words), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0], ",".join(base), found


def agree(rows, texts):
    for r in rows:
        n, n_base, first, last, base, found = brute(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, base)
        own = {x for x in r.labels.split(",") if x}
        assert own >= {x for x in base.split(",") if x} | found and r.labels == ",".join(sorted(own))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(own)


def test_over_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_license_scan"](spark, sf).collect()
    agree(rows, texts)
    assert len(rows) == len(texts) and sum(r.n_base for r in rows) > 5 and any("apache-2.0" in r.labels for r in rows)


def test_odd_texts(spark):
    long = "the cc-by of " * 20000
    texts = {1: None, 2: "", 3: "CC BY cc by\ncc,BY", 4: long, 5: "ccby cc bye all rights, reserved", 6: "general  public license 0 a\x00b", 7: "é É ALL rights  reserved"}
    texts[8] = "x " + licenses.TEMPLATES[8][1] + " y"
    texts[9] = "Licensed under the Apache License, 2.0"
    texts[10] = "apache license only in passing, of version nothing"
    docs = spark.createDataFrame(list(texts.items()) + [(8, texts[8])], "doc_id long, text string").selectExpr("*", "1 as words", "'z' as label", "'q' as seen")
    docs.createOrReplaceTempView("odd_licences")
    rows = QUERIES["op5_license_scan"].__globals__["license_digest"](licenses.scan(docs)).collect()
    assert len(rows) == len(texts) + 1
    agree(rows, texts)
    by = {r.doc_id: r.labels for r in rows}
    assert by[8] == "mit" and by[9] == "apache-2.0" and by[10] == ""
    assert licenses.scan(docs.limit(0)).count() == 0


def test_files_with_several_notices(spark):
    """Every notice that stands word for word is found, whatever else the file holds, and each at its place."""
    notices = [n for _, n, _ in licenses.TEMPLATES]
    pairs = [(a, b) for a in notices for b in notices if a != b]
    texts = dict(enumerate([" ".join(p) for p in pairs] + [" x ".join(notices), " ".join(reversed(notices * 3))]))
    docs = spark.createDataFrame([*texts.items(), *((1000 + i, "the of and") for i in range(50))], "doc_id long, text string")
    found = licenses.scan(docs).where("id < 1000")
    agree(QUERIES["op5_license_scan"].__globals__["license_digest"](found).collect(), texts)
    for r in found.collect():
        want = {(label, len(texts[r.id][: m.start()].split())) for label, n, _ in licenses.TEMPLATES for m in re.finditer(f"(?<![^ ]){n}(?![^ ])", texts[r.id])}
        assert want <= {(x.label, x.at) for x in r.found}


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
