"""The opN queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chat, decontaminate, html_text, language, licenses, line_templates
from plumbline.llm import quality_rules as rules
from plumbline.llm import minhash, packing, prefix_trie, repair, sharding, simhash
from plumbline.llm.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _rule_sql(rule: rules.Rule) -> str:
    sides = [f"{rule.measure} >= {rule.low}::DOUBLE"] * (rule.low is not None) + [f"{rule.measure} <= {rule.high}::DOUBLE"] * (rule.high is not None)
    return "(" + " AND ".join(sides) + ")"


_STOP = ", ".join("'" + w + "'" for w in dict.fromkeys(rules.STOP_WORDS))
QUALITY_MEASURES_SQL = rf"""
rowsx AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
parts AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln FROM rowsx),
grams AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) > 2)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1),
base AS (SELECT parts.rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines,
  length(regexp_replace(body, '[^A-Z]', '', 'g')) AS n_capitals, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
  coalesce(n_repeat_words, 0) AS n_repeat_words FROM parts LEFT JOIN cover ON parts.rid = cover.rid),
measured AS (SELECT *, CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_ratio,
  CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_chars,
  CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_ratio,
  CASE WHEN word_chars > 0 THEN n_capitals::DOUBLE / word_chars ELSE 0 END AS capital_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
  CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stop_ratio FROM base)"""


@_query("op3_quality_rules", f"""WITH {QUALITY_MEASURES_SQL}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(_rule_sql(r) for r in rules.RULES)} AS kept
FROM measured""")
def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return rules.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf, "documents").select("doc_id", "text"))


_ESCAPE_SQL = (
    r"regexp_replace(regexp_replace({0}, '<(\\*)(s|/s|r/|m/|\|[a-z_]+\|)>', '<\1\\\2>', 'g'), '\[(\\*)(/?INST)\]', '[\1\\\2]', 'g')"
)


@_query("op2_chat_format", rf"""WITH rowsx AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, {_ESCAPE_SQL.format("role")} AS erole, {_ESCAPE_SQL.format("text")} AS etext FROM rowsx),
seen AS (SELECT *, coalesce(lag(erole) OVER w = erole, false) AS merged, coalesce(lead(erole) OVER w = erole, false) AS goes_on
  FROM esc WINDOW w AS (PARTITION BY conv_id ORDER BY turn, erole, etext))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, erole, etext)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, erole, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(etext) + CASE WHEN merged THEN 4 ELSE 7 + length(erole) END + CASE WHEN goes_on THEN 0 ELSE 4 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id""")
def op2_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    done = chat.format_conversations(rows.unionByName(probe)).withColumn("turns", chat.parse_formatted(F.col("formatted")))
    done = done.withColumn("loss_text", chat.loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@_query("op5_sharding")
def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("text")
    sizes = table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.uniform_shards(sizes, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


LINE_DEDUP_SQL = r"""
l0 AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ln FROM {docs}),
l1 AS (SELECT doc_id, text, unnest(ln) AS line, unnest(range(len(ln))) AS pos FROM l0),
l2 AS (SELECT doc_id, text, pos, regexp_replace(trim(regexp_replace(line, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' '), '[0-9]+|://[^\x20]*|@[^\x20]*', '<*>', 'g') AS masked FROM l1),
lt AS (SELECT *, string_split(masked, ' ') AS tok, len(string_split(masked, ' ')) AS nt, array_to_string(string_split(masked, ' ')[1:3], ' ') AS lead
  FROM l2 WHERE len(string_split(masked, ' ')) >= 3),
per_line AS (SELECT nt, lead, masked, count(DISTINCT text) AS n, min(doc_id) AS id, min(pos) AS pos FROM lt GROUP BY 1, 2, 3),
seed AS (SELECT nt, lead, first(masked ORDER BY n DESC, id, pos) AS seed FROM per_line GROUP BY 1, 2),
kinds AS (SELECT lt.*, CASE WHEN len(list_filter(list_zip(tok, string_split(seed, ' ')), lambda z: z[1] = z[2])) >= 0.8 * nt THEN seed ELSE masked END AS kind
  FROM lt JOIN seed USING (nt, lead)),
recurring AS (SELECT nt, lead, kind, arg_min(text, doc_id) AS first_text FROM kinds GROUP BY 1, 2, 3 HAVING count(DISTINCT text) >= 10),
drops AS (SELECT DISTINCT doc_id, text, pos FROM kinds JOIN recurring USING (nt, lead, kind) WHERE text <> first_text),
dropped AS (SELECT doc_id, text, list(pos) AS gone FROM drops GROUP BY 1, 2),
left_lines AS (SELECT d.*, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(len(gone), 0) AS n_dropped,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS left_text
  FROM {docs} d LEFT JOIN dropped g ON d.doc_id = g.doc_id AND d.text = g.text)"""


@_query("op10_line_templates", f"""WITH {LINE_DEDUP_SQL.format(docs="documents")}
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, length(coalesce(left_text, ''))::BIGINT AS n_chars, md5(coalesce(left_text, '')) AS text_md5
FROM left_lines""")
def op10_line_templates(spark: SparkSession, sf: str) -> DataFrame:
    done = line_templates.drop_recurring_lines(table(spark, sf, "documents").select("doc_id", "text"))
    body = F.coalesce("text", F.lit(""))
    return done.select("doc_id", "n_lines", "n_dropped", F.length(body).cast("long").alias("n_chars"), F.md5(body.cast("binary")).alias("text_md5"))


@_query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.contamination(F.col("text"), table(spark, sf, "benchmark"))
    hits = docs.select("doc_id", F.explode(found).alias("h")).select("doc_id", "h.*")
    return hits.withColumn("first_word", F.col("first_word").cast("long")).withColumn("last_word", F.col("last_word").cast("long"))


@_query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    done = html_text.extract(table(spark, sf, "pages").select("page_id", "url", "html"))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def vocabulary() -> str:
    """The ranks of the vocabulary of byte_bpe_50k.json; tests compare the ids of both files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def added() -> tuple[tuple[str, int], ...]:
    """Strings that byte_bpe_50k.json gives ids of their own."""
    import public_tokenizers

    return packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


@_query("op8_packing")
def op8_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents").select("doc_id", "source", "text"), vocabulary(), added=added())


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    docs = docs.withColumn("held_out", F.coalesce(third == 1, F.lit(False)))
    done = language.identify(docs, third != 1)
    return done.select("doc_id", "held_out", "lang_pred", "score")


@_query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.spans(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


@_query("op13_minhash_near_dedup")
def op13_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.minhash_groups(table(spark, sf, "documents").select("doc_id", "text"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    step = "list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)), lambda a, b: {step}), 4294967295::BIGINT)"


PREFIX_TRIE_SQL = f"""
turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
  ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, c - c % 100 AS base, {_crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
taken AS (SELECT heads.*, (SELECT count(*) FROM turns t WHERE t.c = heads.base AND t.pos < heads.h) AS taken FROM heads),
rebuilt AS (SELECT heads.c, pos, role, text FROM heads JOIN turns ON turns.c = heads.base AND turns.pos < heads.h
  UNION ALL SELECT taken.c, pos - h + taken, role, text FROM taken JOIN turns ON turns.c = taken.c AND turns.pos >= taken.h),
listed AS (SELECT heads.c, coalesce(list(md5(length(role)::VARCHAR || ':' || role || text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids,
  coalesce(list(length(text) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS chars FROM heads LEFT JOIN rebuilt USING (c) GROUP BY heads.c),
prefixes AS (SELECT c, d, md5(array_to_string(ids[1:d], ',')) AS k, CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], ',')) END AS up,
  CASE WHEN d > 0 THEN chars[d] ELSE 0 END AS chars, len(ids) = d AS ends FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM listed)),
nodes AS (SELECT d, k, first(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * first(chars) AS saved, bool_and(ends) AS leaf,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY d, k),
below AS (SELECT p.d, p.k, sum(leaf::INT) AS n_leaves, sum(saved) AS saved, count(*) FILTER (nodes.d = p.d + 1) AS n_children
  FROM nodes JOIN prefixes p ON p.c = nodes.c AND p.d <= nodes.d GROUP BY 1, 2)"""


@_query("op11_prefix_trie", f"""WITH {PREFIX_TRIE_SQL}
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, b.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (d, k) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.up""")
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    id_ = F.col("conv_id")
    convs, turns = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(rows), F.crc32(id_.cast("string").cast("binary")) % 6, id_ - id_ % 100)
    return prefix_trie.prefix_trie(convs, turns)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations with a fifth of them damaged, by a hash of conversation and turn; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    place = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.filter("conv_id IS NOT NULL").withColumn("kind", kind).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def _least_sql(*candidates: str) -> str:
    return f"list_sort([{', '.join(candidates)}])[1]"


def _path_sql(of: str, cost: str, letters: str, line: str = "''") -> str:
    return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letters}', 't': {of}.t || {line}}}"


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEEP = "chr(10) || role || ':' || text"
REPAIR_SQL = rf"""
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32_sql("(conv_id::VARCHAR || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations WHERE conv_id IS NOT NULL),
bad AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM given WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM bad),
marked AS (SELECT *, left(role, 1) AS x, cut = '' AS blank, cut <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
  coalesce(lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
judged AS (SELECT *, NOT blank AND NOT dup AND right(cut, 1) NOT IN ('.', '!', '?') AS trunc, blank OR dup AS gone FROM marked),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
  count(*) FILTER (trunc) AS truncated, count(*) FILTER (illegal) AS illegal FROM judged GROUP BY 1),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS f0, {{'c': 1000000, 'a': '', 't': ''}} AS f1, {{'c': 1000000, 'a': '', 't': ''}} AS f2, {{'c': 1000000, 'a': '', 't': ''}} AS f3 FROM counts
  UNION ALL SELECT conv_id, i,
    CASE WHEN gone THEN {_path_sql("g0", "4", "D")} ELSE {_path_sql("g0", "4", "D")} END,
    CASE WHEN gone THEN {_path_sql("g1", "4", "D")} ELSE {_least_sql(_path_sql("g1", "4", "D"), _path_sql("g0", "CASE WHEN x = 's' THEN e ELSE 1000000 END", "K", _KEEP))} END,
    CASE WHEN gone THEN {_path_sql("g2", "4", "D")} ELSE {_least_sql(_path_sql("g2", "4", "D"), *[
        _path_sql(g, "CASE WHEN x = 'u' THEN e ELSE 1000000 END", "K", _KEEP) for g in ("g0", "g1", "g3")], *[_path_sql(g, "3 + e", "R", f"{_USER} || text") for g in ("g0", "g1", "g3")])} END,
    CASE WHEN gone THEN {_path_sql("g3", "4", "D")} ELSE {_least_sql(_path_sql("g3", "4", "D"),
        _path_sql("g2", "CASE WHEN x = 'a' THEN e ELSE 1000000 END", "K", _KEEP), _path_sql("g2", "3 + e", "R", f"{_ASSISTANT} || text"))} END
  FROM (SELECT d.conv_id, j.i, j.x, j.gone, CASE WHEN j.trunc THEN 3 ELSE 0 END AS e, j.role, j.text, f0 AS g0, f1 AS g1,
    {_least_sql("f2", _path_sql("f0", "3", "I", _USER), _path_sql("f1", "3", "I", _USER), _path_sql("f3", "3", "I", _USER))} AS g2,
    {_least_sql("f3", _path_sql("f2", "3", "I", _ASSISTANT), _path_sql("f0", "6", "II", f"{_USER} || {_ASSISTANT}"), _path_sql("f1", "6", "II", f"{_USER} || {_ASSISTANT}"))} AS g3
    FROM dp d JOIN judged j ON j.conv_id = d.conv_id AND j.i = d.i + 1)),
best AS (SELECT conv_id, {_least_sql("f0", "f3", _path_sql("f2", "3", "I", _ASSISTANT), _path_sql("f1", "6", "II", f"{_USER} || {_ASSISTANT}"))} AS b FROM dp JOIN counts USING (conv_id) WHERE i = n)"""


@_query("op12_conversation_repair", f"""WITH RECURSIVE {REPAIR_SQL}
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.t[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM given) o LEFT JOIN counts USING (conv_id) LEFT JOIN best USING (conv_id)""")
def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    done = repair.repair(damaged(rows))
    ids = rows.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(done, "conv_id", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
