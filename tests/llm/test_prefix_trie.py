import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from plumbline.llm import prefix_trie
from plumbline.llm.ordered import numbered

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """Node rows of {conv_id: [(role, text), ...]} from a dictionary of prefixes."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[x] for x in children[p])
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], ends(p)) for p, m in members.items())


def made(seed, n=60, longest=23):
    rng, convs = random.Random(seed), {}
    for i in range(n):
        old = convs[rng.choice(list(convs))] if convs and rng.random() < 0.8 else []
        kept = old[:rng.randrange(len(old) + 1)] if rng.random() < 0.8 else old
        more = rng.randrange(longest - len(kept)) if rng.random() < 0.6 else 0
        convs[i * 3 - 40] = kept + [(rng.choice(["user", "assistant", ""]), rng.choice(["", "é", "two words", "x" * 40])) for _ in range(more)]
    return convs


def tables(spark, convs):
    rows = [(c, i, r, t, "x") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    value = prefix_trie.turn_value(F.col("role"), F.col("text"))
    turns = spark.createDataFrame(rows, "conv_id long, pos long, role string, text string, prior string").select("conv_id", "pos", value.alias("t"))
    return spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, n long"), turns


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()))


def test_blocks_and_buckets_equal_brute_force(spark):
    convs = made(1) | {1000 + i: [("user", "hello")] * 9 for i in range(30)} | {2000: [("user", "z" * 50_000)] * 15}
    assert got(prefix_trie.prefix_trie(*tables(spark, convs), width=3, bucket=4)) == brute(convs)


def test_query_equals_brute_force_with_odd_rows(spark, tmp_path):
    rng, rows = random.Random(2), []
    for c in list(range(40)) + [105, 106, 230, -7]:
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "\n"])))
    rows += rows[:5] + [(None, 0, "user", "nobody")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("pos", "t", "prior", "__at", "node")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    from plumbline.llm.queries import QUERIES

    def key(r):
        said = f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}"
        return (r[1] is not None, r[1] or 0, hashlib.md5(said.encode()).hexdigest())

    own = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        own[r[0]].append((r[2] or "", r[3] or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        convs[c] = own.get(base, [])[:h] + turns[h:]
    assert got(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute(convs)


def test_sql_equals_brute_force(spark):
    import duckdb

    from plumbline.llm.queries import QUERIES, SQL

    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = db.execute(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({SQL['op11_prefix_trie']})").fetchall()
    assert got(QUERIES["op11_prefix_trie"](spark, "/root/testdata/sf0.001")) == sorted(want)


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    convs, turns = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(rows), F.lit(1), F.col("conv_id"))
    assert prefix_trie.prefix_trie(convs, turns).count() == 0


def test_numbers_of_a_hot_key(spark):
    rows = [(1, i % 50, str(i)) for i in range(4000)] + [(k, 0, "x") for k in range(2, 60)] + [(None, 1, "a"), (None, None, "b")]
    out = numbered(spark.createDataFrame(rows, "k long, o long, v string").repartition(7), "k", [F.col("o").asc_nulls_first(), F.col("v").asc()])
    keyed = defaultdict(list)
    for r in out.collect():
        keyed[r.k].append(((r.o is not None, r.o or 0, r.v), r.pos))
    assert sum(map(len, keyed.values())) == len(rows)
    assert all([p for _, p in sorted(v)] == list(range(len(v))) for v in keyed.values())
