"""The registered queries of this subpackage and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.llm.convrepair import damaged, repair_conversations
from veilmark.llm.filteraudit import audit_filters
from veilmark.llm.mixing import mix_sources
from veilmark.llm.ngramjoin import jaccard_components
from veilmark.llm.packing import pack_documents
from veilmark.llm.pii import pii_digest
from veilmark.llm.quality import fit_quality, score_quality
from veilmark.llm.sharding import shard_rows
from veilmark.llm.stages import cut, shared_folder
from veilmark.llm.tokencounts import TokenRollup, signed, token_counts
from veilmark.llm.toxicity import fit_toxicity, held_out, score_toxicity
from veilmark.llm.urlfilter import TAG, TARGET, TIES, UrlRule, judge_urls
from veilmark.llm.vafile import top_k
from veilmark.llm.vecdedup import near_vectors

RULES = [UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, a deletion, its reversal, a revision of counts and a batch that is delivered twice, all taken into
    the kept totals by two compactions."""
    counts = cut(token_counts(table(spark, sf_dir, "documents")))
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    turn = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    rollup.commit("0001-load", signed(counts, 1, "words@1", "words").unionByName(signed(counts.where(turn != 0), 1, "word_bpe_49k@1", "subwords")))
    rollup.compact()
    rollup.commit("0002-late", signed(counts.where(turn == 0), 1, "word_bpe_49k@1", "words"))
    rollup.commit("0003-delete", signed(counts.where(turn == 1), -1, "word_bpe_49k@1", "subwords"))
    rollup.commit("0004-restore", signed(counts.where(turn == 1), 1, "word_bpe_49k@1", "subwords"))
    late = counts.where(turn == 0)
    revised = signed(late, -1, "word_bpe_49k@1", "words").unionByName(signed(late, 1, "word_bpe_49k@1", "subwords"))
    rollup.commit("0005-revise", revised)
    rollup.compact()
    rollup.commit("0005-revise", revised)
    return rollup.totals()


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_conversations(damaged(rows), every=rows)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_toxicity, op2_ngram_join, op3_mixing, op4_sharding, op5_token_counts, op6_embedding_dedup, op7_packing, op8_exact_top_k, op9_url_filters, op10_quality, op11_pii, op12_conversation_repair, op13_filter_audit, pipeline]
    return {f.__name__: f for f in own}


_JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (SELECT x FROM items GROUP BY x HAVING count(*) > 1
), shared AS (SELECT doc_id, n, x FROM items SEMI JOIN common USING (x)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= 90 * b.n AND b.n * 100 >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.reached = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id FROM sets s
JOIN (SELECT node, min(reached) AS component_id FROM reach GROUP BY node) r ON r.node = s.doc_id
"""

_TOP_K_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS "rank", vec_id, score FROM ranked WHERE r <= 5
"""

def _url_sql() -> str:
    """Hosts, rules, edges from tags, and the components they tie, once more."""
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = "CASE WHEN position('://' IN coalesce({0}, '')) > 0 THEN substr({0}, position('://' IN {0}) + 3) ELSE '' END"
    parts = f"{lower.format('regexp_extract(rest, $$^([^/?#]*)$$, 1)')} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '^[^#]*?(\\?[^#]*)', 1) AS query"
    rule = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS alias"""
    ruled = "CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled"
    scheme, site = "regexp_extract(url, '^([^:/?#]+)://', 1) || ':'", "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
    folder = "regexp_extract(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1)"
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {rest.format('url')} AS rest FROM pages),
v AS (SELECT *, {ruled} FROM (SELECT *, {rule} FROM (SELECT page_id, url, {parts} FROM p))),
tags AS (SELECT url, unnest(list_filter(regexp_extract_all(coalesce(html, ''), {q(TAG)}, 1), lambda t: regexp_matches(t, {q(TIES)}))) AS tag FROM pages),
raw AS (SELECT url, replace(regexp_extract(tag, {q(TARGET)}, 1), '&amp;', '&') AS x FROM tags),
whole AS (SELECT url AS page, CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN x
  WHEN x = '' OR starts_with(x, '#') OR regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') OR {site} = '' THEN NULL
  WHEN starts_with(x, '//') THEN {scheme} || x WHEN starts_with(x, '/') THEN {scheme} || '//' || {site} || x
  ELSE {scheme} || '//' || {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || x END AS url FROM raw),
t AS (SELECT *, {ruled} FROM (SELECT *, {rule} FROM (SELECT page, url, {parts} FROM (SELECT *, {rest.format('url')} AS rest FROM whole WHERE url IS NOT NULL)))),
e AS (SELECT DISTINCT v.alias AS a, t.alias AS b FROM t JOIN v ON v.url = t.page WHERE v.alias IS NOT NULL AND t.alias IS NOT NULL),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
said AS (SELECT alias, ruled FROM v WHERE alias IS NOT NULL AND ruled IS NOT NULL UNION SELECT alias, ruled FROM t WHERE alias IS NOT NULL AND ruled IS NOT NULL),
reach AS (SELECT DISTINCT alias AS node, alias AS reached FROM v WHERE alias IS NOT NULL UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.reached = w.a),
told AS (SELECT r.node, min(s.ruled) AS inherited FROM reach r JOIN said s ON s.alias = r.reached GROUP BY r.node)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, told.inherited, 'allow') AS verdict FROM v LEFT JOIN told ON v.alias = told.node
"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's bytes; `crcs` has the 256 remainders of one byte."""
    step = "xor(r >> 8, t[1 + (xor(r, b) & 255)])"
    data = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda r, b: {step}), 4294967295)"


def _repair_sql() -> str:
    """The lattice as a fold over a conversation's rows: of each state the least of cost (nine digits) and audit, as one string.

    Strings of one length of digits compare as (cost, audit).  A state that can't be reached has a string of tildes.
    """
    more = lambda s, cost, edit: f"CASE WHEN {s} = '~' THEN '~' ELSE lpad(CAST(CAST(left({s}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({s}, 10) || '{edit}' END"
    # states: 1 nothing yet, 2 after the system, 3 after the user, 4 after the assistant
    once = lambda a: f"[{a}[1], {a}[2], least({a}[3], {more(a + '[1]', 3, 'I')}, {more(a + '[2]', 3, 'I')}, {more(a + '[4]', 3, 'I')}), least({a}[4], {more(a + '[3]', 3, 'I')})]"
    closed = lambda a: f"list_reduce([{a}, ['i'], ['i']], lambda w, z: {once('w')})"
    extra = "CASE WHEN x[3] = '1' THEN 3 ELSE 0 END"
    kept = lambda s, whose: f"CASE WHEN x[2] = '0' AND x[1] = '{whose}' THEN {more(s, extra, 'K')} ELSE '~' END"
    given = lambda s, whose: f"CASE WHEN x[2] = '0' AND x[1] <> '{whose}' THEN {more(s, '3 + ' + extra, 'R')} ELSE '~' END"
    gone = lambda s: more(s, 4, "D")
    to_user = ", ".join(f"{f(s, 'u')}" for s in ("c[1]", "c[2]", "c[4]") for f in (kept, given))
    row = f"[{gone('c[1]')}, least({gone('c[2]')}, {kept('c[1]', 's')}), least({gone('c[3]')}, {to_user}), least({gone('c[4]')}, {kept('c[3]', 'a')}, {given('c[3]', 'a')})]"
    fold = f"list_reduce(list_prepend(['000000000', '~', '~', '~'], xs), lambda w, x: list_transform([{closed('w')}], lambda c: {row})[1])"
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE crcs AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hit AS (SELECT keyed.*, {_crc32_sql('key')} % 20 AS kind FROM keyed CROSS JOIN crcs),
copied AS (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE kind <> 0),
d AS (SELECT conv_id, turn, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM copied),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM d),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '{space.replace('[', '[^')}') AS blank,
  NOT regexp_matches(text, '[.!?]{space}*\\z') AS cut_off, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before, n AS place FROM placed),
faults AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE cut_off AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE place > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
  list([i, CASE WHEN blank OR again THEN '1' ELSE '0' END, CASE WHEN cut_off THEN '1' ELSE '0' END] ORDER BY n) AS xs, list(role ORDER BY n) AS roles, list(text ORDER BY n) AS texts FROM seen GROUP BY conv_id),
ways AS (SELECT *, {fold} AS w FROM faults),
ended AS (SELECT *, {closed('w')} AS e FROM ways),
best AS (SELECT *, least(e[1], e[4]) AS b FROM ended),
walk AS (SELECT conv_id, substr(b, 10) AS audit, roles, texts, 1 AS k, 1 AS n, 'n' AS state, '' AS line, false AS said FROM best
  UNION ALL SELECT conv_id, audit, roles, texts, k + 1, CASE WHEN edit = 'I' THEN n ELSE n + 1 END, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND state = 'n' AND left(roles[n], 1) = 's' THEN 's' WHEN state = 'u' THEN 'a' ELSE 'u' END,
    CASE edit WHEN 'D' THEN '' WHEN 'K' THEN roles[n] || ':' || texts[n] ELSE CASE WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN edit = 'R' THEN texts[n] ELSE '' END END, edit <> 'D'
  FROM (SELECT *, substr(audit, k, 1) AS edit FROM walk) WHERE edit <> ''),
lines AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM walk WHERE said GROUP BY conv_id)
SELECT o.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank, coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated, coalesce(b.illegal, 0) AS illegal,
  coalesce(CAST(left(b.b, 9) AS BIGINT), 0) AS cost, coalesce(substr(b.b, 10), '') AS audit, coalesce(l.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


_AUDIT_SQL = r"""
WITH words AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM words GROUP BY text),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
masked AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM words JOIN firsts USING (text) LEFT JOIN said USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM masked GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT o, step, bit, CAST((SELECT coalesce(sum(p.bit), 0) FROM f p WHERE position(p.f IN o) < step) AS INTEGER) AS before, f FROM orders CROSS JOIN (SELECT unnest(range(1, 6)) AS step) JOIN f ON f.f = substr(o, step, 1)),
told AS (SELECT part, o, step, f, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, o, step, f, bit, before)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM told
"""


def oracle_sql() -> dict[str, str]:
    """Mixing and sharding hash and round as SQL engines differ, so tests hold them against brute force instead."""
    return {"op2_ngram_join": _JACCARD_SQL, "op8_exact_top_k": _TOP_K_SQL, "op9_url_filters": _url_sql(), "op12_conversation_repair": _repair_sql(), "op13_filter_audit": _AUDIT_SQL}
