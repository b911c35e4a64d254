import re

from rankloom.llm import license_scan
from rankloom.llm.license_scan import NOTICES, PHRASES, Template

SCHEMA = "doc_id long, text string"


def scan(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return {r.doc_id: r for r in license_scan.scan(docs, **more).collect()}


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase in PHRASES:
        parts = phrase.text.split()
        here = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += here
        labels |= {phrase.label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_places(spark, prose):
    texts = [
        "CC-BY", "cc by cc by", "all rights reserved. All Rights  Reserved!", "all rights all rights reserved",
        "general public license cc by-nc", "the general public licenses", "CC\nBY all\trights reserved", "cc", "", None,
        "cc é by", "ccby", prose(3000, 1) + " cc by " + prose(3000, 2) + " all rights reserved", "İ cc by",
    ]
    rows = scan(spark, texts)
    for k, text in enumerate(texts):
        r = rows[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


def test_notices_by_coverage(spark):
    whole = next(t for t in NOTICES if t.label == "apache-2.0").text
    rows = scan(
        spark,
        [
            whole, whole.replace("the apache", "the well known apache"), "apache license", whole.replace("license", "x"),
            "This work is licensed under the GNU General Public License, version 3.", "version 2 0 apache the under licensed",
        ],
    )
    assert rows[0].labels == "apache-2.0" and rows[0].score == 1
    assert rows[1].labels == "apache-2.0" and 0.8 <= rows[1].score < 1
    assert rows[2].labels == "" and 0 < rows[2].score < 0.8
    assert "apache-2.0" not in rows[3].labels
    assert rows[4].labels == "gpl,gpl-2.0,gpl-3.0" and rows[4].base_labels == "gpl"
    assert "apache-2.0" not in rows[5].labels


def test_distant_halves_are_not_one_span(spark):
    notice = Template("n", "a b c d e f g h i j")
    far = "a b c d e " + "x " * 20 + "f g h i j"
    near = "a b c d e x f g h i j"
    rows = scan(spark, [far, near, "a b c d e f g h i j"], phrases=(), notices=(notice,))
    assert rows[0].labels == "" and rows[0].score == 4 / 9
    assert rows[1].labels == "n" and rows[1].score == 8 / 9
    assert rows[2].score == 1


def test_odd_rows(spark):
    rows = [(1, "cc by", 9, "z"), (1, "cc by", 9, "z"), (1, "all rights reserved", 9, "z"), (None, "cc by", 9, "z"), (None, None, 9, "z")]
    docs = spark.createDataFrame(rows, SCHEMA + ", N_WORDS int, labels string")
    found = sorted((str(r.doc_id), r.n_base, r.labels) for r in license_scan.scan(docs).collect())
    assert found == sorted(
        [("1", 1, "cc-by"), ("1", 1, "cc-by"), ("1", 1, "reserved"), ("None", 1, "cc-by"), ("None", 0, "")]
    )
    assert license_scan.scan(docs.limit(0)).collect() == []
    many = spark.range(500).selectExpr("id AS doc_id", "repeat('cc by ', 50) AS text")
    assert license_scan.scan(many).where("n_base = 50 AND last_word = 98").count() == 500
