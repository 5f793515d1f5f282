from collections import defaultdict

import numpy as np

import corpus_pipeline
from plumbline.llm import decontaminate, packing, quality_rules
from plumbline.llm.queries import vocabulary
from plumbline.llm.storage import stored

from .test_dedup import closure, fingerprint

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        tables[name] = ({r.doc_id: r for r in before.collect()}, docs.collect())
        if name != "packing":
            assert docs.columns == names and docs.schema == before.schema

    before, after = tables["quality"]
    judged = quality_rules.quality(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "kept").collect()
    kept = {r.doc_id for r in judged if r.kept}
    assert {r.doc_id for r in after} == kept and all(r == before[r.doc_id] for r in after) and 0 < len(kept) < len(before)

    before, after = tables["line_dedup"]
    for r in after:
        lines = before[r.doc_id].text.split("\n")
        rest = iter(lines)
        assert all(any(x == y for y in rest) for x in r.text.split("\n"))  # lines in order, none new
        assert r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text))

    before, after = tables["near_dedup"]
    prints = {i: fingerprint(r.text) for i, r in before.items()}
    near = [(a, b) for a in prints for b in prints if b < a and (prints[a] ^ prints[b]).bit_count() <= 3]
    assert sorted(r.doc_id for r in after) == sorted(set(closure(near, prints).values())) and near

    before, after = tables["decontamination"]
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    dirty = set()
    for i, r in before.items():
        w = decontaminate.words_of(r.text)
        for x in items.values():
            # An alignment worth half of the item has a run of common words; without one there is nothing to align.
            if len(x) >= 5 and len(set(x) & set(w)) >= len(set(x)) // 2 and decontaminate.smith_waterman(x, w)[0] >= len(x):
                dirty.add(i)
                break
    assert {r.doc_id for r in after} == set(before) - dirty

    before, after = tables["packing"]
    pieces = defaultdict(list)
    for r in after:
        pieces[r.doc_id].append(r)
    ids = dict(zip(before, packing.encode([r.text for r in before.values()], vocabulary())))
    assert set(pieces) == set(before)
    for i, parts in pieces.items():
        parts.sort(key=lambda r: r.start)
        assert [p.start for p in parts] == list(np.cumsum([0] + [p.length for p in parts])[:-1]) and sum(p.length for p in parts) == len(ids[i])


def test_run_returns_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_odd_rows_pass_through_all_stages(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    prose = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)} of" for i in range(60))
    rows = [(1, prose, None, None, None), (1, prose, None, None, None), (None, prose + " and more", "en", "s", 3), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, schema)
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            table = stored(stage(spark, table, SF))
        assert {r.doc_id for r in table.collect()} <= {1, None}


def test_long_passages_of_two_texts_go_and_short_lines_stay(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    edited = passage.replace("wdb", "other")
    rows = [(i, f"own line number {w} here\n{p}\nthe same short line", "en", "s", 1) for i, w, p in [(1, "x", passage), (2, "y", passage), (3, "z", edited)]]
    rows += [(4, rows[0][1], "en", "s", 1)]
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert got[1] == got[4] == rows[0][1].split("\n")
    assert got[2] == ["own line number y here", "the same short line"] and got[3] == ["own line number z here", "the same short line"]
