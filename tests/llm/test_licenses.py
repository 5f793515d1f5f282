import re

from plumbline.llm import licenses
from plumbline.llm.queries import op1_license_scan

BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for label, p in BASE.items() for i in range(len(w)) if w[i:i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def check(spark, rows, folder):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{folder}/documents.parquet")
    got = op1_license_scan(spark, str(folder)).collect()
    by_id = {r.doc_id: r for r in got}
    for i, text in rows:
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text), text
    assert len(got) == len(rows)
    return by_id


def test_base_places_and_edited_templates(spark, tmp_path):
    mit = [t for t in licenses.TEMPLATES if t.label == "mit"][-1].words
    edited = " ".join(mit[:20] + ["und", "so"] + mit[20:50] + mit[53:])
    rows = [
        (1, "CC BY-NC 4.0, cc\nby; All rights   reserved. ALL RIGHTS reserved"), (2, None), (3, ""), (4, "cc"), (5, "x " * 30000 + "general public license"),
        (6, f"intro {edited} outro"), (7, "İstanbul cc by K general"), (8, "éCC BY cc BY"), (9, "GNU General Public License, version 3"),
        (10, " ".join(mit[:20])), (11, "licensed under the apache license version 2.0"), (None, "cc by"),
    ]
    got = check(spark, rows, tmp_path / "t")
    assert got[1].labels == "cc-by,cc-by-nc,reserved" and got[9].labels == "gpl,gpl-3.0" and got[11].labels == "apache-2.0"
    assert got[6].labels == "mit" and got[6].score > 0.8 and got[10].labels == "" and got[4].score == 0.0


def test_whole_table_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op1_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])


def test_repeated_rows_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "cc by", "a")] * 3, "doc_id long, text string, spans string")
    assert [len(r.spans) for r in licenses.spans(df).collect()] == [1, 1, 1]
    assert licenses.spans(df.limit(0)).count() == 0
