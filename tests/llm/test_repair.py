import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import repair
from plumbline.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """The report of one conversation, by a forward search over (cost, audit, lines) for each state."""
    rows = sorted((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for t, r, x in rows)
    blank = dup = trunc = illegal = 0
    seen, best = set(), {0: (0, "", ())}
    step = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}

    def inserts(best):
        for _ in range(3):
            for s, (c, a, ls) in list(best.items()):
                new = (c + 3, a + "I", (*ls, name[step[s]] + ":"))
                best[step[s]] = min(best.get(step[s], new), new)
        return best

    for _, _, role, text, _ in rows:
        gone = not re.search(r"[^\x20\x09-\x0D]", text)
        extra = 0
        if gone:
            blank += 1
        elif (role, text) in seen:
            dup, gone = dup + 1, True
        elif re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?":
            trunc, extra = trunc + 1, 3
        seen.add((role, text))
        after = {}

        def offer(s, c, a, ls):
            after[s] = min(after.get(s, (c, a, ls)), (c, a, ls))

        for s, (c, a, ls) in inserts(best).items():
            offer(s, c + 4, a + "D", ls)
            if not gone:
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((role[:1], s))
                if to is not None:
                    offer(to, c + extra, a + "K", (*ls, f"{role}:{text}"))
                offer(step[s], c + 3 + extra, a + "R", (*ls, f"{name[step[s]]}:{text}"))
        best = after
    illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    c, a, ls = min(v for s, v in inserts(best).items() if s in (0, 3))
    turns = [r[4] for r in rows if r[4] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, dup, trunc, illegal, c, a, hashlib.sha256("\n".join(ls).encode()).hexdigest()


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def made(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 5, 9, 40])):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
            role = rng.choice(["system", "tool", None, "", "umpire", "User"]) if rng.random() < 0.1 else role
            text = rng.choice([f"done {t}.", f"well {t}! \n", "cut off", "", " \t", None, "again?", "é …", f"x{t}"]) if rng.random() < 0.5 else f"text {t}."
            rows += [(c - 3, rng.choice([t, t, t + 2, None]), role, text)] * rng.choice([1, 1, 1, 1, 1, 2, 4])
    return rows


def check(out, rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t, r, x))
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in out.collect()}
    assert set(got) == set(by)
    for c in by:
        assert got[c] == brute(by[c]), (c, by[c])


@pytest.mark.parametrize("chunk", [3, 4096])
def test_repairs_equal_brute_force(spark, chunk):
    rows = made(chunk, 60) + [(None, 0, "user", "nobody.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("n", "part", "code", "audit", "said", "first")})
    check(repair.repair(df, chunk_rows=chunk), rows)


def test_vectors_that_never_converge_and_one_hot_conversation(spark):
    """Rows of no legal role swap two states each, so the guess stays wrong through all chunks."""
    rows = [(1, t, "tool", f"{t}.") for t in range(61)] + [(2, t, ["user", "assistant"][t % 2], f"{t}.") for t in range(400)]
    rows += [(3, t, "user", "") for t in range(50)] + [(4, t, "assistant", f"{t}") for t in range(45)] + [(5, 1, "user", "same.")] * 500
    check(repair.repair(spark.createDataFrame(rows, SCHEMA), chunk_rows=4), rows)


def test_fix_up_equals_a_whole_run():
    rng, steps = random.Random(3), repair._Steps()
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randrange(1, 30)))
        times = [rng.randrange(1, 4) if c == 8 else 1 for c in codes]
        v = repair._norm(repair._closed([rng.randrange(9) for _ in range(4)]))[0]
        assert repair.fix_up(codes, times, v, repair.END, repair.answer(codes, times, repair.END, steps), steps) == repair.answer(codes, times, v, steps)


def test_query_and_sql_equal_brute_force(spark, tmp_path):
    import duckdb

    rows = made(8, 80)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    out = QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = db.execute(f"SELECT conv_id, {', '.join(FIELDS)} FROM ({SQL['op12_conversation_repair']})").fetchall()
    assert sorted(map(tuple, out.select("conv_id", *FIELDS).collect())) == sorted(want)


def test_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 200_000 + "end."), (1, 1, "assistant", "\n" * 100_000 + "x.")]
    check(repair.repair(spark.createDataFrame(rows, SCHEMA), chunk_chars=10), rows)
    assert repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
