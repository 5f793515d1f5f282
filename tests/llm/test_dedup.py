import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.functions.components import components
from plumbline.llm import line_templates, simhash
from plumbline.llm.storage import stored


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_cycles(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(500, x) for x in range(501, 560)] + [(7, 7), (9, 8), (8, 9)]
    pairs += [(rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), stored).collect()}
    want = closure(pairs, {x for p in pairs for x in p})
    assert got == {n: r for n, r in want.items() if n in got}
    assert {n for n in want if want[n] != n or Counter(want.values())[n] > 1} <= set(got)


def test_groups_equal_brute_force_with_chunks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set(int(v) for v in base)
    for v in base:
        for _ in range(6):
            flip = 0
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                flip |= 1 << int(b)
            values.add(int(v) ^ flip)
    values |= {1 << b for b in range(40)}
    values = sorted(values)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 3]
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    for chunk in (1024, 5):
        links = {(r.a, r.b) for r in simhash.near_links(df, chunk=chunk).collect()}
        assert links <= {(signed[a], signed[b]) for a, b in near} | {(signed[b], signed[a]) for a, b in near}
        got = closure(links, signed.values())
        assert got == closure([(signed[a], signed[b]) for a, b in near], signed.values())


def test_rows_without_id_or_text_repeats_and_clashing_columns(spark):
    rng = random.Random(1)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(30000))
    rows = [(5, "A b C d e"), (3, "a B c d E"), (3, "a B c d E"), (9, None), (4, ""), (None, " \n"), (None, "only here once"), (11, long_text), (12, "one"), (13, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x"))
    got = simhash.simhash_groups(df).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, f"{fingerprint(t):016x}") for i, t in rows)
    named = {(r.doc_id, r.component_id) for r in got}
    assert {(5, 3), (3, 3), (9, 4), (4, 4), (None, 4), (None, None), (11, 11)} <= named
    left = simhash.drop_near_duplicates(df)
    assert left.columns == ["doc_id", "text", "fingerprint"]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(3, "a B c d E"), (4, ""), (None, "only here once"), (11, long_text), (12, "one"), (13, "two words")])
    assert simhash.simhash_groups(df.limit(0)).count() == 0 and simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_recurring_templates_go_but_for_their_first_text(spark):
    note = "Call us today {} to order number {} from our store now please"
    rows = [(i, f"text {chr(97 + i)} own line here\n{note.format(i, i * 7)}\nshort\n{chr(97 + i)}x closing {chr(97 + i)}") for i in range(12)]
    rows += [(0, rows[0][1]), (50, rows[0][1]), (60, None), (61, ""), (None, note.format(1, 2) + "\n\n"), (70, "x " * 20000 + "\n" + note.format("someone", 9))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_dropped", F.lit("clash")).withColumn("id", F.lit(1))
    got = defaultdict(list)
    for r in line_templates.drop_recurring_lines(df, min_docs=10).collect():
        got[r.doc_id].append(r)
    assert len(got[0]) == 2 and all(r.n_dropped == 0 and r.text == rows[0][1] for r in got[0] + got[50])
    assert all(got[i][0].n_dropped == 1 and note[:4] not in got[i][0].text and "short" in got[i][0].text for i in range(1, 12))
    assert got[60][0].text is None and got[60][0].n_lines == 0 and got[61][0].n_lines == 1
    assert got[None][0].text == "\n" and got[70][0].n_dropped == 1
    assert line_templates.drop_recurring_lines(df.limit(0)).count() == 0
    kept = line_templates.drop_recurring_lines(df, min_docs=100).collect()
    assert all(r.n_dropped == 0 for r in kept) and len(kept) == len(rows)


def test_every_template_of_a_path_is_found(spark):
    word = lambda i: chr(97 + i // 5) * 3 + "qrstu"[i % 5]
    families = ["we thank you {} for all the good work today", "we thank you dear {} please come back very soon",
                "we thank you once more and {} in our small shop where {} bread is sold every day"]
    rows = [(i, f"own {word(i)} line\n" + "\n".join(f.format(word(i), word(i + 1)) for f in families)) for i in range(12)]
    rows += [(20 + i, f"we thank you {' '.join(word((i * 7 + k * 5) % 60) for k in range(6))}") for i in range(15)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()}
    assert all(got[i].text == rows[i][1].split("\n")[0] for i in range(1, 12))
    assert got[0].text == rows[0][1] and all(r.n_dropped == 0 for i, r in got.items() if i >= 20)
