"""Repair of conversation structure at least cost: Viterbi over chunks with rank convergence.

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials. Edits
are Keep, Rerole, Delete and Insert; an automaton of four states (begun, after
system, after user, after assistant) turns the cheapest repair into a shortest
path. A backward cost vector holds, for each state, the cost from there to the
end; a row maps the vector behind it to the one before it.

Rows are dealt to partitions in order and cut into chunks. Every chunk starts
from the vector of a conversation's end as a guess; fix-up passes rerun chunks
from vectors that their neighbours arrived at, and a rerun stops at the row where
its vector differs from the guessed run's only by a constant, as all earlier rows
then differ by that constant alone. Passes end when no conversation has a vector
its chunks have not answered. Chunk answers are stitched from the end; the costs
so found drive a trace from the front that takes the least edit letter among the
cheapest ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

BLANKS = " \t\n\x0b\f\r"
CHUNK_ROWS, CHUNK_CHARS = 4096, 4_000_000
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States: 0 begun, 1 after system, 2 after user, 3 after assistant. A missing user or assistant leads to NEXT.
NEXT = (2, 2, 3, 2)
FAR = 10**9
#: Codes of a row: initial 0 s, 1 u, 2 a, 3 other; plus 4 if truncated; 8: must go.
GONE = 8
KEEPS = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
Vector = tuple[int, int, int, int]


def _closed(v: list[int]) -> Vector:
    """Costs with inserts allowed first."""
    w = list(v)
    for s in (2, 3, 0, 1, 2):
        w[s] = min(w[s], INSERT + w[NEXT[s]])
    return tuple(w)


END: Vector = _closed([0, FAR, FAR, 0])


def _before(code: int, times: int, v: Vector) -> Vector:
    """The vector before a row, from the one behind it."""
    if code == GONE:
        return tuple(DELETE * times + x for x in v)
    more, keeps = TRUNCATED * (code >> 2), KEEPS[code & 3]
    w = [min(DELETE + v[s], REROLE + more + v[NEXT[s]]) for s in range(4)]
    for s, to in enumerate(keeps):
        if to is not None:
            w[s] = min(w[s], more + v[to])
    return _closed(w)


def _norm(v: Vector) -> tuple[Vector, int]:
    least = min(v)
    return tuple(x - least for x in v), least


class _Steps:
    """Steps over normalised vectors, remembered: there are few of them."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, Vector], tuple[Vector, int]] = {}

    def back(self, code: int, times: int, v: Vector) -> tuple[Vector, int]:
        if code == GONE:
            return v, DELETE * times
        found = self.known.get((code, v))
        if found is None:
            found = self.known[code, v] = _norm(_before(code, 1, v))
        return found


def answer(codes: bytes, times: list[int], v: Vector, steps: _Steps) -> tuple[Vector, int]:
    """The vector before a chunk, normalised, and its least cost, from the vector behind it."""
    total = 0
    for i in range(len(codes) - 1, -1, -1):
        v, c = steps.back(codes[i], times[i], v)
        total += c
    return v, total


def fix_up(codes: bytes, times: list[int], v: Vector, guess: Vector, guessed: tuple[Vector, int], steps: _Steps) -> tuple[Vector, int]:
    """``answer`` for ``v``, stopping where it runs parallel to the run that began with ``guess``."""
    ahead = 0
    for i in range(len(codes) - 1, -1, -1):
        if v == guess:
            return guessed[0], guessed[1] + ahead
        v, c = steps.back(codes[i], times[i], v)
        guess, g = steps.back(codes[i], times[i], guess)
        ahead += c - g
    return v, guessed[1] + ahead


def trace(codes: bytes, times: list[int], behind: Vector, state: int, last: bool, steps: _Steps) -> tuple[list[str], int]:
    """Edits of a chunk from ``state`` on: for each row the letters before and at it, then one entry of those behind the last row."""
    vectors, v = [behind], behind
    costs = []
    for i in range(len(codes) - 1, -1, -1):
        v, c = steps.back(codes[i], times[i], v)
        vectors.append(v)
        costs.append(c)
    vectors.reverse()
    costs.reverse()
    edits = []
    for i, code in enumerate(codes):
        now, then, c = vectors[i], vectors[i + 1], costs[i]
        letters = ""
        while True:
            want = now[state] + c
            more, keep = (0, None) if code == GONE else (TRUNCATED * (code >> 2), KEEPS[code & 3][state])
            if want == DELETE * (times[i] if code == GONE else 1) + then[state]:
                letters += "D" * (times[i] if code == GONE else 1)
                break
            if now[state] == INSERT + now[NEXT[state]]:
                letters += "I"
                state = NEXT[state]
                continue
            if keep is not None and want == more + then[keep]:
                letters, state = letters + "K", keep
                break
            letters, state = letters + "R", NEXT[state]
            break
        edits.append(letters)
    tail = ""
    while last and state not in (0, 3):
        tail, state = tail + "I", NEXT[state]
    return [*edits, tail], state


def repaired(edits: list[str], roles: list[str], texts: list[str], state: int) -> list[str]:
    """The lines of a chunk after its edits; reroled and inserted rows take the role that ``state`` lacks."""
    names, lines = {2: "user", 3: "assistant"}, []
    for i, letters in enumerate(edits):
        for x in letters:
            if x == "I" or x == "R":
                state = NEXT[state]
                lines.append(f"{names[state]}:{texts[i] if x == 'R' else ''}")
            elif x == "K":
                state = {"s": 1, "u": 2, "a": 3}[roles[i][0]]
                lines.append(f"{roles[i]}:{texts[i]}")
    return lines


_CHUNK = "conv_id long, part int, seq long, codes binary, times array<long>, roles array<string>, texts array<string>, first string, last string, illegal long"
LEGAL = {"su", "ua", "au"}


def _chunks(rows: int, chars: int):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows to chunks of one conversation each; runs of rows that must go are one entry."""
        conv, held, seq = None, None, 0

        def fresh():
            return {"codes": [], "times": [], "roles": [], "texts": [], "first": None, "last": None, "illegal": 0, "chars": 0, "rows": 0}

        def shown(part):
            return (conv, part, seq, bytes(held["codes"]), held["times"], held["roles"], held["texts"], held["first"], held["last"], held["illegal"])

        names = [x.split()[0] for x in _CHUNK.split(", ")]
        part = 0
        for frame in parts:
            done = []
            for c, part, role, text, n, code in zip(*(frame[x] for x in ("conv_id", "part", "role", "text", "n", "code"))):
                if held and (c != conv or held["rows"] >= rows or held["chars"] >= chars):
                    done.append(shown(part))
                    held, seq = None, seq + 1
                conv, held = c, held or fresh()
                initial = role[:1]
                held["illegal"] += (held["last"] is not None and held["last"] + initial not in LEGAL) + n - 1
                held["first"], held["last"] = (initial if held["first"] is None else held["first"]), initial
                entries = [(GONE, n)] if code == GONE else [(code, 1)] + [(GONE, n - 1)] * (n > 1)
                for x, times in entries:
                    if x == GONE and held["codes"] and held["codes"][-1] == GONE:
                        held["times"][-1] += times
                    else:
                        held["codes"].append(x)
                        held["times"].append(times)
                        held["roles"].append(None if x == GONE else role)
                        held["texts"].append(None if x == GONE else text)
                held["rows"] += 1
                held["chars"] += 0 if code == GONE else len(text)
            if done:
                yield pd.DataFrame(done, columns=names)
        if held:
            yield pd.DataFrame([shown(part)], columns=names)

    return cut


def _first_answers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = _Steps()
    for p in parts:
        found = [answer(c, t, END, steps) for c, t in zip(p["codes"], p["times"])]
        yield p[["conv_id", "part", "seq"]].assign(given=[list(END)] * len(p), got=[list(v) for v, _ in found], cost=[c for _, c in found])


def _fix_ups(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = _Steps()
    for p in parts:
        found = [
            fix_up(c, t, tuple(map(int, v)), END, (tuple(map(int, g)), int(k)), steps)
            for c, t, v, g, k in zip(p["codes"], p["times"], p["given"], p["got"], p["cost"])
        ]
        yield p[["conv_id", "part", "seq", "given"]].assign(got=[list(v) for v, _ in found], cost=[c for _, c in found])


_ANSWER = "conv_id long, part int, seq long, given array<long>, got array<long>, cost long"


def _stitch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From the last chunk of a conversation to the first: the answer to the vector that the chunk behind arrived at."""
    conv, at, want, reached = None, None, END, END
    for p in parts:
        out = []
        for c, part, seq, given, got, cost in zip(*(p[x] for x in ("conv_id", "part", "seq", "given", "got", "cost"))):
            if c != conv:
                conv, at, want = c, (part, seq), END
            elif (part, seq) != at:
                at, want = (part, seq), reached
            if tuple(map(int, given)) == want:
                reached = tuple(map(int, got))
                out.append((c, part, seq, list(want), cost))
        yield pd.DataFrame(out, columns=["conv_id", "part", "seq", "behind", "cost"])


def _ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which a chunk ends, for each state it may begin in."""
    steps = _Steps()
    for p in parts:
        ends = [[trace(c, t, tuple(map(int, b)), s, False, steps)[1] for s in range(4)] for c, t, b in zip(p["codes"], p["times"], p["behind"])]
        yield p[["conv_id", "part", "seq", "behind"]].assign(ends=ends)


def _walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which each chunk of a conversation begins."""
    conv, state = None, 0
    for p in parts:
        out = []
        for c, part, seq, behind, ends in zip(*(p[x] for x in ("conv_id", "part", "seq", "behind", "ends"))):
            conv, state = c, state if c == conv else 0
            out.append((c, part, seq, behind, state))
            state = int(ends[state])
        yield pd.DataFrame(out, columns=["conv_id", "part", "seq", "behind", "state"])


_PIECE = "conv_id long, part int, seq long, audit string, body string, first string, last string, illegal long"


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps = _Steps()
    for p in parts:
        out = []
        for r in p.itertuples(index=False):
            edits, _ = trace(r.codes, r.times, tuple(map(int, r.behind)), int(r.state), bool(r.final), steps)
            lines = repaired(edits, r.roles, r.texts, int(r.state))
            out.append((r.conv_id, r.part, r.seq, "".join(edits), "\n".join(lines) if lines else None, r.first, r.last, r.illegal))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in _PIECE.split(", ")])


_WHOLE = "conv_id long, audit string, repaired_sha256 string, illegal long"


def _joined(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces of conversations in order to their audit, digest and illegal pairs; texts pass by, they are not gathered."""
    conv, audit, digest, illegal, last, begun = None, [], None, 0, None, False
    whole = lambda: (conv, "".join(audit), digest.hexdigest(), illegal)
    names = [x.split()[0] for x in _WHOLE.split(", ")]
    for p in parts:
        out = []
        for r in p.itertuples(index=False):
            if digest is None or r.conv_id != conv:
                if digest is not None:
                    out.append(whole())
                conv, audit, digest, illegal, last, begun = r.conv_id, [], hashlib.sha256(), 0, None, False
            audit.append(r.audit)
            illegal += int(r.illegal) + (last is not None and last + r.first not in LEGAL)
            last = r.last
            if r.body is not None:
                digest.update((("\n" if begun else "") + r.body).encode("utf-8", "surrogatepass"))
                begun = True
        if out:
            yield pd.DataFrame(out, columns=names)
    if digest is not None:
        yield pd.DataFrame([whole()], columns=names)


def classified(rows: DataFrame) -> DataFrame:
    """Equal rows of a conversation as one row with their number ``n``: ``conv_id turn role text n``, ``fault`` of the first and ``code``.

    A row is ``blank`` without a character other than the six ASCII blanks,
    ``duplicate`` if its role and text were seen earlier, ``truncated`` if the
    last such character is none of ``.!?``.
    """
    rows = rows.filter(F.col("conv_id").isNotNull()).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = stored(rows.withColumn("said", said))
    order = F.struct(F.col("turn").isNotNull(), "turn")
    again = rows.groupBy("conv_id", "said").agg(F.count("*").alias("turns"), F.min(order).alias("first")).filter("turns > 1").drop("turns")
    again = stored(again.withColumnsRenamed({"conv_id": "c", "said": "s"}))
    seen = F.col("first").isNotNull() & (F.col("first") < order)
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", "blank").when(seen, "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated")
    marked = rows.join(again, (F.col("conv_id") == F.col("c")) & (F.col("said") == F.col("s")), "left").withColumn("fault", fault)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    code = F.when(F.col("fault").isin("blank", "duplicate"), GONE).otherwise(kind + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return marked.select("conv_id", "turn", "role", "text", "n", "fault", code.cast("int").alias("code"))


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk_rows: int = CHUNK_ROWS,
           chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """One row per conversation: ``conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256``.

    Rows are taken by turn, those without a turn first, rows of equal turn by
    role and text. Null roles and texts count as one space: such a text is blank,
    such a role illegal. Only the first fault of a row counts. ``audit`` are the
    initials of the cheapest edits in order, of several the least by ASCII;
    ``cost`` what they cost; the digest is that of the repaired rows
    ``role:text``, joined by newlines. Repeated rows are duplicates of the first.
    Rows without a conversation id are left out; texts and conversations may have
    any length; an empty table gives an empty result; other columns are not read.
    """
    c = lambda name: F.col(f"`{name}`")
    said = lambda name: F.coalesce(c(name), F.lit(" "))
    given = rows.select(c(conv_id).cast("long").alias("conv_id"), c(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"))
    marked = stored(classified(given))
    number = lambda cond, value: F.coalesce(F.sum(F.when(cond, value)), F.lit(0)).cast("long")
    keeps = F.col("code") != GONE
    counts = marked.groupBy("conv_id").agg(
        number(F.col("fault") == "blank", F.col("n")).alias("blank"),
        (number(F.col("fault") == "duplicate", F.col("n")) + number(keeps, F.col("n") - 1)).alias("duplicate"),
        number(F.col("fault") == "truncated", F.lit(1)).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    laid = marked.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    chunks = stored(laid.select("conv_id", "part", "role", "text", "n", "code").mapInPandas(_chunks(chunk_rows, chunk_chars), _CHUNK))
    key = ["conv_id", "part", "seq"]
    steps = chunks.select(*key, "codes", "times")
    answers = stored(steps.mapInPandas(_first_answers, _ANSWER))
    many = stored(answers.groupBy("conv_id").agg(F.count("*").alias("chunks")).filter("chunks > 1").select("conv_id"))
    single = answers.join(many, "conv_id", "left_anti")

    first = stored(answers.join(many, "conv_id", "left_semi"))
    known, parts = first, [first]
    asked = stored(first.select("conv_id", "given").distinct())
    while True:
        wanted = stored(known.select("conv_id", F.col("got").alias("given")).distinct().join(asked, ["conv_id", "given"], "left_anti"))
        if wanted.isEmpty():
            break
        rerun = steps.join(first.select(*key, "got", "cost"), key).join(wanted, "conv_id")
        known = stored(rerun.select(*key, "codes", "times", "given", "got", "cost").mapInPandas(_fix_ups, _ANSWER))
        asked = stored(asked.unionByName(wanted))
        parts.append(known)
    all_answers = parts[0]
    for x in parts[1:]:
        all_answers = all_answers.unionByName(x)
    backward = all_answers.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    behind = stored(backward.mapInPandas(_stitch, "conv_id long, part int, seq long, behind array<long>, cost long"))
    ends = steps.join(behind.drop("cost"), key).mapInPandas(_ends, "conv_id long, part int, seq long, behind array<long>, ends array<int>")
    walked = ends.repartition("conv_id").sortWithinPartitions(*key).mapInPandas(_walk, "conv_id long, part int, seq long, behind array<long>, state int")
    final = behind.groupBy("conv_id").agg(F.max(F.struct("part", "seq")).alias("end"))
    places = stored(walked.join(final, "conv_id").withColumn("final", F.struct("part", "seq") == F.col("end")).drop("end"))
    alone = chunks.join(many, "conv_id", "left_anti").withColumns({
        "behind": F.array(*[F.lit(x).cast("long") for x in END]), "state": F.lit(0), "final": F.lit(True),
    })
    digest = F.sha2(F.coalesce("body", F.lit("")).cast("binary"), 256).alias("repaired_sha256")
    whole = alone.mapInPandas(_pieces, _PIECE).select("conv_id", "audit", digest, "illegal")
    pieces = stored(chunks.join(places, key).mapInPandas(_pieces, _PIECE))
    whole = whole.unionByName(pieces.repartition("conv_id").sortWithinPartitions(*key).mapInPandas(_joined, _WHOLE))

    begins = F.min_by("got", F.struct("part", "seq"))[0]
    lone_cost = single.select("conv_id", (F.col("got")[0] + F.col("cost")).alias("cost"))
    starts = all_answers.join(behind.select(*key, F.col("behind").alias("given")), [*key, "given"])
    sums = starts.groupBy("conv_id").agg((F.sum("cost") + begins).alias("cost"))
    return counts.join(whole, "conv_id").join(lone_cost.unionByName(sums), "conv_id").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )
