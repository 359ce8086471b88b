"""One query per operator over its whole table, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import chat, jaccard, packing, periodic, quality, recurrent, secrets, tiling, toxicity, urls, variants, warc
from . import repetition as rep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_repetition", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
base AS (
  SELECT r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
line AS (
  SELECT r, count(*) AS c, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS chars
  FROM (SELECT r, unnest(ls) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l),
lines AS (
  SELECT r, sum(c - 1) AS n_dup_lines, coalesce(sum(c * chars) FILTER (c > 1), 0) AS dup_line_chars FROM line GROUP BY r),
grams AS (
  SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (VALUES (5), (6), (7), (8), (9), (10)) v(n))),
twice AS (SELECT r, n, i FROM (SELECT r, n, i, count(*) OVER (PARTITION BY r, n, g) AS c FROM grams) WHERE c > 1),
inside AS (SELECT DISTINCT r, n, i + k AS p FROM (SELECT r, n, i, unnest(range(n)) AS k FROM twice)),
spans AS (SELECT r, n, count(*) AS words, sum(length(ws[p])) AS chars FROM inside JOIN w USING (r) GROUP BY r, n),
wide AS (
  SELECT r, sum(words) FILTER (n = 8) AS rw, sum(chars) FILTER (n = 5) AS c5, sum(chars) FILTER (n = 6) AS c6,
    sum(chars) FILTER (n = 7) AS c7, sum(chars) FILTER (n = 9) AS c9, sum(chars) FILTER (n = 10) AS c10
  FROM spans GROUP BY r),
m AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rw, 0)::BIGINT AS n_repeat_words,
    coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, coalesce(c5, 0)::BIGINT AS dup_5gram_chars,
    coalesce(c6, 0)::BIGINT AS dup_6gram_chars, coalesce(c7, 0)::BIGINT AS dup_7gram_chars,
    coalesce(c9, 0)::BIGINT AS dup_9gram_chars, coalesce(c10, 0)::BIGINT AS dup_10gram_chars
  FROM base LEFT JOIN lines USING (r) LEFT JOIN wide USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * dup_line_chars <= 40 * word_chars
    AND 100 * dup_5gram_chars <= 45 * word_chars AND 100 * dup_6gram_chars <= 44 * word_chars
    AND 100 * dup_7gram_chars <= 43 * word_chars AND 100 * dup_9gram_chars <= 41 * word_chars
    AND 100 * dup_10gram_chars <= 40 * word_chars AS kept
FROM m""")
def op1_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    return rep.repetition(_table(spark, folder, "documents"), keep=["doc_id"])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(packing.token_pieces(_table(spark, folder, "documents"), tokenizer_path(), with_ids=False))


_SECRET_PATTERNS = {
    "assign": r'([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]'
              r'|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)',
    **{r.kind: r.pattern for r in [*secrets.BASE_RULES, *secrets.MORE_RULES] if r.kind != "assign"},
}
_SECRET_SPANS = " UNION ALL ".join(f"""
  SELECT r, '{rule.kind}' AS kind, {rank} AS rank, start, start + size AS stop FROM (
    SELECT r, list_sum(list_transform(gaps[:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start, length(found[i]) AS size,
      length(secret[i]) AS least
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT r, string_split_regex(t, '{_SECRET_PATTERNS[rule.kind]}') AS gaps,
        regexp_extract_all(t, '{_SECRET_PATTERNS[rule.kind]}') AS found,
        regexp_extract_all(t, '{_SECRET_PATTERNS[rule.kind]}', {rule.group}) AS secret FROM d)))
  WHERE least >= {rule.least}""" for rank, rule in enumerate(secrets.RULES))


@_query("op6_secrets", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({_SECRET_SPANS}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
    string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)""")
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, by a new ledger."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    ledger = shared_folder(spark, "ledger")
    secrets.scan(docs, ledger)
    return secrets.summary(secrets.spans_by_path(docs, ledger))


_URL_PATTERNS = {  # the pattern rules as regular expressions, written out
    "||cheap-pills.": r"^[^/]*://([^/?#]*[.])?cheap-pills[.]", "||casino.": r"^[^/]*://([^/?#]*[.])?casino[.]",
    "||poker-online.": r"^[^/]*://([^/?#]*[.])?poker-online[.]", "||free-money.": r"^[^/]*://([^/?#]*[.])?free-money[.]",
    "||click-bait.": r"^[^/]*://([^/?#]*[.])?click-bait[.]", "||spam.": r"^[^/]*://([^/?#]*[.])?spam[.]",
    "||malware.": r"^[^/]*://([^/?#]*[.])?malware[.]", "/adserver/": "/adserver/", "/banner-ads/": "/banner-ads/",
    "/affiliate-id=": "/affiliate-id=", "/wp-login.php|": "/wp-login[.]php$", "/.git/config|": "/[.]git/config$",
    "/phpmyadmin^": "/phpmyadmin([^a-z0-9._%-]|$)", "?sessionid=": "[?]sessionid=", "&sid=*&tracking=": "&sid=.*&tracking=",
    "/xxx^": "/xxx([^a-z0-9._%-]|$)", ".exe|": "[.]exe$", ".apk|": "[.]apk$",
    "/torrent^*magnet": "/torrent([^a-z0-9._%-]|$).*magnet",
}


@_query("op10_urls", r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, url, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, rule) AS (VALUES """ + ", ".join(f"('{a}', '{r}')" for a, r in urls.HOST_RULES) + r"""),
fit AS (
  SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM p, (SELECT *, split_part(rule, '/', 1) AS h, rule[length(split_part(rule, '/', 1)) + 1:] AS s FROM rules)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY r),
patterns(pattern, regex) AS (VALUES """ + ", ".join(f"('{p}', '{x}')" for p, x in _URL_PATTERNS.items()) + r"""),
hit AS (SELECT r, min(pattern) AS pattern FROM p, patterns WHERE regexp_matches(lower(url), regex) GROUP BY r)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM p LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)""")
def op10_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL."""
    return urls.judge(_table(spark, folder, "pages"), urls.pattern_table(spark, urls.PATTERNS))


@_query("op5_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(html) AS size, max(page_id) OVER (PARTITION BY html) AS response,
  list_transform(range(8), lambda i: ('0x' || h[5 * i + 1:5 * i + 5])::BIGINT) AS parts FROM p)
SELECT page_id, size::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda v: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> s) & 31) + 1]), 'string_agg', '')), '') AS payload_digest,
  CASE WHEN response IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM d""")
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, read back from the archives in order of the capture histories."""
    found = warc.archived_pages(_table(spark, folder, "pages"))
    return found.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest",
                        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


_CONTROL = r"([\\]|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE\]|\[/ROLE\])"


@_query("op2_chat", rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, role || chr(10) || text || chr(10) AS line, coalesce(lag(role) OVER w, 'start') AS before,
    lead(role) OVER w IS NULL AS final,
    length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) AS escaped,
    CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
      ELSE 16 + length(regexp_replace(role, '{_CONTROL}', '\\\1', 'g')) END AS marks
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(escaped + marks)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'system') AS n_system,
  bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
    AND (NOT final OR role = 'assistant')) AS well_formed
FROM t GROUP BY conv_id""")
def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one that quotes control strings, formatted and read back."""
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.read_back(chat.format_chat(rows.unionAll(more)))


@_query("op8_jaccard", """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS s
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT u, v FROM link UNION SELECT v, u FROM link),
reach AS (
  WITH RECURSIVE walk(node, root) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT b.v, w.root FROM walk w JOIN both_ways b ON b.u = w.node)
  SELECT node, min(root) AS component_id FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.node = d.doc_id""")
def op8_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents by 3-word shingles."""
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


@_query("op3_tiling")
def op3_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents cover by half or more."""
    return tiling.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op9_recurrent")
def op9_recurrent(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under the recurrent model and under word frequencies."""
    return recurrent.log_likelihood(_table(spark, folder, "documents"))


@_query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op12_quality")
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from the labels that are not held out."""
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def _crc32(keys: str) -> str:
    """Tables that end in ``crc (key, h)``: the CRC-32 of every ``key`` of the table ``keys``.

    The checksum is linear: what each byte adds depends on its place from the end alone, and zeros add by number.
    """
    return f"""
entries AS MATERIALIZED (
  SELECT b, list_reduce(list_concat([b::BIGINT], list_resize([0::BIGINT], 8, 0)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(b)),
longest AS (SELECT coalesce(max(strlen(key)), 0) AS most FROM {keys}),
places AS (
  WITH RECURSIVE p(k, b, v) AS (
    SELECT 0, b, v FROM entries UNION ALL
    SELECT k + 1, p.b, xor(p.v >> 8, e.v) FROM p JOIN entries e ON e.b = p.v & 255 WHERE k < (SELECT most FROM longest))
  SELECT * FROM p),
zeros AS (
  WITH RECURSIVE z(n, v) AS (
    SELECT 0, 4294967295 UNION ALL
    SELECT n + 1, xor(z.v >> 8, e.v) FROM z JOIN entries e ON e.b = z.v & 255 WHERE n < (SELECT most FROM longest))
  SELECT n, xor(v, 4294967295) AS v FROM z),
letters AS (
  SELECT key, size - i - 1 AS k, ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT AS b
  FROM (SELECT key, strlen(key) AS size, hex(encode(key)) AS x, unnest(range(strlen(key))) AS i FROM {keys})),
crc AS (
  SELECT key, xor(bit_xor(p.v), any_value(z.v)) AS h
  FROM letters JOIN places p USING (k, b) JOIN zeros z ON z.n = strlen(key) GROUP BY key)"""


@_query("op11_variants", f"""
WITH found AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS key, run, count(*) AS n FROM found
  WHERE length(run) >= 7 GROUP BY ALL),
{_crc32("runs")},
result AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
  FROM runs JOIN crc USING (key)),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM result WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS MATERIALIZED (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS gap
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.gap
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.gap),
near AS (
  SELECT p.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, hex(encode(o.word))) AS best, max(o.n) AS best_n
  FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form,
    CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
walk AS (
  WITH RECURSIVE w(word, last) AS (
    SELECT word, word FROM judged UNION ALL SELECT w.word, j.form FROM w JOIN judged j ON j.word = w.last WHERE j.form IS NOT NULL)
  SELECT w.word, w.last AS root FROM w JOIN judged j ON j.word = w.last WHERE j.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM judged JOIN walk USING (word)""")
def op11_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Forms and roots of all words of the documents, some of which lose a letter first."""
    rule = variants.Spelling()
    return variants.variants(variants.letter_runs(_table(spark, folder, "documents"), rule, damage=31), rule)


def _looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the texts go round in a circle from some word on."""
    d = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn("g", F.expr("h div 10"))
    d = d.withColumn("ws", F.when(F.expr("h % 10 = 0"), F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')")))
    d = d.withColumn("n", F.size("ws").cast("long")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    d = d.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    loop = F.expr("concat_ws(' ', slice(ws, 1, int(a)), transform(sequence(a, n - 1), i -> ws[int(a + (i - a) % p)]))")
    return d.select("doc_id", F.when(F.col("n") > 0, loop).otherwise(F.col("text")).alias("text"))


@_query("op13_periodic", rf"""
WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key FROM documents),
{_crc32("keys")},
d AS (
  SELECT row_number() OVER () AS r, doc_id, h, h // 10 AS g,
    regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS own
  FROM documents LEFT JOIN crc ON crc.key = doc_id::VARCHAR),
e AS (SELECT *, len(own) AS n, CASE WHEN h % 10 = 0 AND len(own) > 0 THEN g % len(own) END AS a FROM d),
w AS MATERIALIZED (
  SELECT r, n, i, CASE WHEN i >= a THEN own[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] ELSE own[i + 1] END AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM e)),
grams AS MATERIALIZED (
  SELECT r, n, i, hash(word, lead(word, 1) OVER s, lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s,
    lead(word, 5) OVER s) AS x
  FROM w WINDOW s AS (PARTITION BY r ORDER BY i) QUALIFY lead(word, 5) OVER s IS NOT NULL),
seeds AS (
  SELECT a.r, b.i - a.i AS q, a.i FROM grams a JOIN grams b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 2 * (b.i - a.i) <= a.n),
islands AS (
  SELECT r, q, min(i) AS start, count(*) + 5 + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM seeds) GROUP BY r, q, island),
runs AS MATERIALIZED (
  SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w WHERE NOT EXISTS (FROM gone WHERE gone.r = w.r AND gone.i = w.i)
  GROUP BY r),
told AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s := start, l := length, p := period) ORDER BY length DESC, start, period) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period,
  1000 * top.l // top.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)""")
def op13_periodic(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to go round in a circle first."""
    found = periodic.periodic_runs(_looped(_table(spark, folder, "documents")), keep=["doc_id"])
    top = F.expr("array_max(transform(runs, r -> named_struct('l', r.length, 's', -r.start, 'p', -r.period)))")
    lines = F.expr("transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || char(10))")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"),
        F.col("top.l").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("1000 * top.l div -top.p").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
