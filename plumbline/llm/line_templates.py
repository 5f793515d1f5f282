"""Line dedup by a log-template tree.

A line is a sequence of tokens. Fields that vary by form (numbers, dates, mail
and web addresses) become ``<*>``. A path through the tree of fixed depth is the
number of tokens and the leading tokens; lines of one path are compared with the
path's most common line, position by position. A line that agrees on at least
``SIMILARITY`` of the positions belongs to its template, with the differing
positions as variable fields. The lines left over form further templates of the
path in the same way, as long as any of them may recur; a line that agrees with
none is a template of its own. Templates found in ``MIN_DOCS`` different texts or
more are dropped, but for the text in which they come first; for templates of
``LONG_TOKENS`` tokens or more the caller may ask for fewer texts.

Only hashes of lines are shuffled; paths that are too rare for any of their
templates to recur are gone before a line's tokens are fetched again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.storage import stored

DEPTH = 3
SIMILARITY = 0.8
MIN_DOCS = 10
MIN_TOKENS = 3
LONG_TOKENS = 50
# Runs of blanks that are not a single space already.
BLANKS = r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]"
FIELD = r"[0-9]+|://[^\x20]*|@[^\x20]*"
ENOUGH = rf"^[\x20\x09\x0B-\x0D]*[^\x20\x09\x0B-\x0D]+([\x20\x09\x0B-\x0D]+[^\x20\x09\x0B-\x0D]+){{{MIN_TOKENS - 1}}}"


def _tokens(line: Column) -> Column:
    """The line's tokens, joined by single blanks, with numbers and the ends of addresses masked."""
    return F.regexp_replace(F.trim(F.regexp_replace(line, BLANKS, " ")), FIELD, "<*>")


def _path(masked: Column) -> Column:
    return F.xxhash64(F.length(masked) - F.length(F.replace(masked, F.lit(" "), F.lit(""))), F.substring_index(masked, " ", DEPTH))


def _lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per line of MIN_TOKENS tokens or more: pos, line, raw (hash of the line)."""
    cut = docs.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).drop("text")
    return cut.filter(F.col("line").rlike(ENOUGH)).withColumn("raw", F.xxhash64("line"))


def _agree(a: Column, b: Column) -> Column:
    """Number of positions at which two token arrays of one length agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))


def _parts(tokens: Column, similarity: float) -> Column:
    """array<struct<i, part>>: lines of one path that agree on ``similarity`` of the positions have an element in common.

    With one position to differ, the parts are the line without each position;
    with more, the line is cut into one part more than positions may differ.
    Lines in which no position may differ have no part.
    """
    size = F.size(tokens)
    free, spare = F.greatest(size - DEPTH, F.lit(0)), (size - F.ceil(F.lit(similarity) * size)).cast("int")
    edge = lambda i: (F.floor(i * free / (spare + 1)) + F.least(size, F.lit(DEPTH))).cast("int")
    without = F.transform(F.sequence(F.lit(0), F.greatest(free - 1, F.lit(0))), lambda i: F.struct(
        i.alias("i"), F.xxhash64(F.filter(tokens, lambda x, j: j != i + DEPTH)).alias("part")))
    cut = F.transform(F.sequence(F.lit(0), spare), lambda i: F.struct(
        i.alias("i"), F.xxhash64(F.slice(tokens, edge(i) + 1, edge(i + 1) - edge(i))).alias("part")))
    return F.when((spare == 1) & (free > 0), without).when(spare > 0, cut)


def _further_templates(rest: DataFrame, similarity: float) -> DataFrame:
    """``rest(path, line, masked, rank, need)``, the lines that no template has yet, to path, line, other: the lines that join another.

    Lines meet under equal parts. A line leads a part if it ranks highest there
    among the lines that may still recur, by the texts of all lines it meets; a
    leader that agrees with no higher one makes a template and takes the lines
    that agree with it. What is left goes round again.
    """
    line = ["path", "line"]
    rest = stored(rest.select(*line, "masked", "rank", "need"))
    placed = rest.select(*line, F.col("line").alias("other")).limit(0)
    while True:
        parts = rest.select(*line, "rank", "need", F.explode(_parts(F.split("masked", " "), similarity)).alias("p"))
        parts = stored(parts.select(*line, "rank", "need", F.xxhash64("path", "p.i", "p.part").alias("part")))
        met = stored(parts.groupBy("part").agg(F.sum("rank.n").alias("texts"), F.count("*").alias("kinds")).filter("kinds > 1").drop("kinds"))
        able = parts.join(met, "part").groupBy(*line).agg(F.min("need").alias("need"), F.sum("texts").alias("texts"))
        able = stored(able.filter(F.col("texts") >= F.col("need")).select(*line))
        if able.isEmpty():
            return placed
        leaders = stored(parts.join(able, line).groupBy("part").agg(F.max("rank").alias("lead")))
        # Lines that cannot recur themselves may still join a leader that ranks below them.
        may = parts.join(leaders, "part").join(able.withColumn("able", F.lit(True)), line, "left")
        may = stored(may.select(*line, "lead", (~F.coalesce("able", F.lit(False)) | (F.col("lead") > F.col("rank"))).alias("below")).distinct())
        bodies = rest.select(*line, "masked")
        tried = may.filter("below").withColumn("other", F.col("lead.line")).join(bodies, line)
        tried = tried.join(bodies.select("path", F.col("line").alias("other"), F.col("masked").alias("other_masked")), ["path", "other"])
        a, b = F.split("masked", " "), F.split("other_masked", " ")
        near = tried.filter(_agree(a, b) >= F.lit(similarity) * F.size(a))
        near = stored(near.groupBy(*line).agg(F.max("lead").alias("lead")).select(*line, F.col("lead.line").alias("other")))
        made = stored(may.select("path", F.col("lead.line").alias("line")).distinct().join(near, line, "left_anti"))
        joined = near.join(made.withColumnRenamed("line", "other"), ["path", "other"], "left_semi").select(*line, "other")
        placed = stored(placed.unionByName(joined))
        rest = rest.join(may.select(*line).distinct(), line, "left_semi").join(made, line, "left_anti")
        rest = stored(rest.join(placed, line, "left_anti"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, long_docs: int | None = None) -> DataFrame:
    """``docs(id, text)`` to the lines that are dropped: id, th (text hash), pos, template.

    A template's documents are counted by different texts, so exact copies of a
    document count once; all rows with the text that has the template first
    (smallest id, then smallest text hash) keep its lines. Templates of
    LONG_TOKENS tokens or more recur from ``long_docs`` texts on, if that is given.
    """
    docs = docs.select("id", F.xxhash64("text").alias("th"), "text")
    masked = _lines(docs).withColumn("masked", _tokens(F.col("line")))
    # All lines of a path have one number of tokens, so one threshold.
    tokens = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    need = F.when(tokens >= LONG_TOKENS, min_docs if long_docs is None else long_docs).otherwise(min_docs)
    lines = stored(masked.select("id", "th", "pos", "raw", need.alias("need"), _path(F.col("masked")).alias("path"), F.xxhash64("masked").alias("line")))
    least = [F.min(c).alias(c) for c in ("id", "pos", "raw", "need")]
    per_text = lines.groupBy("path", "line", "th").agg(*least)
    per_line = stored(per_text.groupBy("path", "line").agg(F.count("*").alias("n"), *least))
    busy = per_line.groupBy("path").agg(F.sum("n").alias("texts"), F.count("*").alias("kinds"), F.min("need").alias("least"))
    busy = stored(busy.filter(F.col("texts") >= F.col("least")).drop("least"))
    # The most common line of a path, the earliest of several.
    leaders = per_line.join(busy, "path")
    rank = F.struct("n", (-F.coalesce("id", F.lit(2**62))).alias("id"), (-F.col("pos")).alias("pos"), "line")
    seeds = stored(leaders.groupBy("path").agg(F.max(rank).alias("r")).select("path", F.col("r.line").alias("seed")))
    kinds = stored(leaders.select("path", "line", "raw", "need", "kinds", rank.alias("rank")).join(seeds, "path"))
    # Tokens are fetched only for paths with more than one kind of line, one line of each kind;
    # by sorted merge at every size, as the wanted lines grow with the input.
    wanted = stored(kinds.filter("kinds > 1").select("path", "line", "raw"))
    texts = _lines(docs.select("text")).select("raw", F.col("line").alias("body")).join(wanted.hint("merge"), "raw")
    texts = stored(texts.groupBy("path", "line").agg(F.min(_tokens(F.col("body"))).alias("masked")))
    seed_text = stored(texts.join(seeds, (texts["path"] == seeds["path"]) & (texts["line"] == seeds["seed"]), "left_semi")
                       .select("path", F.col("masked").alias("seed_masked")))
    a, b = F.split("masked", " "), F.split("seed_masked", " ")
    judged = stored(texts.join(seed_text, "path").select("path", "line", "masked", (_agree(a, b) >= F.lit(similarity) * F.size(a)).alias("close")))
    rest = judged.filter("NOT close").join(kinds.select("path", "line", "rank", "need"), ["path", "line"])
    others = _further_templates(rest, similarity)
    named = kinds.join(judged.select("path", "line", "close"), ["path", "line"], "left").join(others, ["path", "line"], "left").select(
        "path", "line", F.when((F.col("line") == F.col("seed")) | F.col("close"), F.col("seed")).otherwise(F.coalesce("other", "line")).alias("kind")
    )
    found = stored(lines.join(stored(named), ["path", "line"]).select("id", "th", "pos", "need", F.xxhash64("path", "kind").alias("template")))
    texts_of = found.groupBy("template", "th").agg(F.min("id").alias("id"), F.min("need").alias("need"))
    recurring = texts_of.groupBy("template").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min("need").alias("need")).filter("n >= need")
    recurring = stored(recurring.select("template", "first_id"))
    first = found.join(recurring, "template").filter(F.col("id").eqNullSafe(F.col("first_id"))).groupBy("template").agg(F.min("th").alias("first_th"))
    drops = found.join(stored(first), "template").filter("th <> first_th")
    return drops.select("id", "th", "pos", "template")


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, similarity: float = SIMILARITY,
                         long_docs: int | None = None) -> DataFrame:
    """Every row of ``docs`` with its text without recurring lines, plus ``n_lines`` and ``n_dropped``.

    A null text stays null with zero lines. Lines of fewer than MIN_TOKENS
    tokens are never dropped. Repeated rows are treated alike; rows without an
    id are kept, and their lines count like any other. Columns of ``docs`` named
    n_lines or n_dropped are replaced.
    """
    new = ("n_lines", "n_dropped")
    keep = [c for c in docs.columns if c not in new]
    c = lambda name: F.col(f"`{name}`")
    drops = recurring_lines(docs.select(c(id_col).alias("id"), c(text).alias("text")), min_docs, similarity, long_docs)
    drops = stored(drops.groupBy(F.col("id").alias("_id"), F.col("th").alias("_of")).agg(F.collect_set("pos").alias("_drop")))
    lines = F.split(c(text), "\n")
    base = docs.select(*[c(k) for k in keep], F.xxhash64(c(text)).alias("_th"))
    # Sorted merge at every size: the same plan whether few or many documents lose lines.
    joined = base.join(drops.hint("merge"), c(id_col).eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_of")), "left")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return joined.select(
        *[F.when(F.col("_drop").isNull(), c(k)).otherwise(left).alias(k) if k == text else c(k) for k in keep],
        F.when(c(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
