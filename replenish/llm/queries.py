"""The named queries of these operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replenish.llm import collocations, decontaminate, language, licences, mixing, prefix_trie, quality, shards, simhash, substrings, syncmers, token_files, urls
from replenish.llm.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(run):
        QUERIES[key] = run
        if sql is not None:
            ORACLE_SQL[key] = sql
        return run

    return register


@query("op1_template_decontamination")
def template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("text_hash")


@query("op2_simhash_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


QUALITY_COUNTS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
repeated AS (
  SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -9) AS step
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, sum(least(5, step))::BIGINT AS n FROM repeated GROUP BY rid),
lines AS (
  SELECT rid, (count(*) - count(DISTINCT l))::BIGINT AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM texts)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
counts AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
counted AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts),
known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
tagged AS (
  SELECT counted.*, q, substr(md5(doc_id::VARCHAR), 1, 1) < '4' AS proposes FROM counted JOIN known USING (doc_id) WHERE NOT base_failed),
langs AS (SELECT lang, count(*) FILTER (q = 1 AND NOT proposes) AS holds FROM tagged GROUP BY lang),
level AS (SELECT 0.05 / (count(*) + 1) AS risk FROM langs),
large AS (SELECT lang AS own FROM langs WHERE holds >= (SELECT ceil(ln(risk) / ln(0.95)) FROM level)),
stratified AS (
  SELECT t.*, s.is_large IS NULL AS pooled, CASE WHEN s.is_large THEN t.lang END AS stratum
  FROM tagged t LEFT JOIN (SELECT own, true AS is_large FROM large) s ON t.lang IS NOT DISTINCT FROM s.own),
left0 AS (SELECT *, true AS alive FROM stratified)"""


def _quality_sql() -> str:
    """Rule by rule what a quarter of the labels proposes, then the tests of the growing unions on the others."""
    steps, joins, kept, certified = [], [], ["NOT base_failed"], []
    last = len(quality.RULES)
    for k, r in enumerate(quality.RULES):
        sign = "<" if r.low else ">"
        out = f"{r.amount} {sign} n_words * cutoff"
        steps.append(f"""
tried{k} AS (
  SELECT pooled, stratum, cutoff, count(*) FILTER (q = 1 AND {out}) AS lost, count(*) FILTER (q = 0 AND {out}) AS caught
  FROM left{k}, (SELECT unnest({list(r.cutoffs)}::DOUBLE[]) AS cutoff) WHERE proposes AND alive GROUP BY ALL),
taken{k} AS (
  SELECT pooled AS pool{k}, stratum AS of{k}, cutoff AS cut{k} FROM (
    SELECT *, row_number() OVER (PARTITION BY pooled, stratum ORDER BY caught - 20 * lost DESC, {"" if r.low else "-"}cutoff) AS rank
    FROM tried{k} WHERE caught > 20 * lost) WHERE rank = 1),
left{k + 1} AS (
  SELECT x.* REPLACE (alive AND NOT coalesce({r.amount} {sign} n_words * cut{k}, false) AS alive), NOT alive OR coalesce({r.amount} {sign} n_words * cut{k}, false) AS out{k}, cut{k}
  FROM left{k} x LEFT JOIN taken{k} ON pooled = pool{k} AND stratum IS NOT DISTINCT FROM of{k})""")
        tail = f"""list_sum(list_transform(range(lost{k} + 1), lambda k:
      exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.05) + (n - k) * ln(0.95))))"""
        certified.append(f"lost{k} < n * 0.05 AND {tail} <= (SELECT risk FROM level)")
        kept.append(f"NOT coalesce({r.amount} {sign} n_words * CASE WHEN own.stratum_known THEN own.cut{k} ELSE pool.cut{k} END, false)")
    losses = ", ".join(f"count(*) FILTER (out{k}) AS lost{k}" for k in range(last))
    cuts = ", ".join(f"max(cut{k}) AS cut{k}" for k in range(last))
    steps.append(f"""
tested AS (
  SELECT pooled, stratum, count(*) AS n, {losses} FROM left{last} WHERE q = 1 AND NOT proposes GROUP BY ALL),
proposed AS (SELECT pooled, stratum, {cuts} FROM left{last} GROUP BY ALL),
cuts AS (
  SELECT p.pooled, p.stratum, {", ".join(f"CASE WHEN {' AND '.join(certified[: k + 1])} THEN cut{k} END AS cut{k}" for k in range(last))}
  FROM proposed p JOIN tested t ON p.pooled = t.pooled AND p.stratum IS NOT DISTINCT FROM t.stratum)""")
    names = ", ".join(f"max(cut{k}) AS cut{k}" for k in range(last))
    joins.append("LEFT JOIN (SELECT *, true AS stratum_known FROM cuts WHERE NOT pooled) own ON counted.lang IS NOT DISTINCT FROM own.stratum")
    joins.append(f"CROSS JOIN (SELECT {names} FROM cuts WHERE pooled) pool")
    return f"""{QUALITY_COUNTS},{",".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, {" AND ".join(kept)} AS kept
FROM counted {" ".join(joins)}"""


@query("op3_quality_rules", _quality_sql())
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query("op4_token_files")
def token_file_digests(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


REPEATS_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM texts)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT rid, i + k AS pos FROM repeated, (SELECT unnest(range(35)) AS k)),
placed AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM texts),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS line FROM placed ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (rid)
"""


@query("op5_substring_dedup", REPEATS_SQL)
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.cut(read(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op6_language_field")
def language_field(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(read(spark, folder, "documents"))


@query("op7_licence_scan")
def licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(read(spark, folder, "documents"))


URL_SQL = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
judged AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
marked AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM judged),
hinted AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|[.-])spam[-.]?farm[.-]') THEN '*spam-farm*'
    WHEN regexp_matches(host, '(^|[.-])phishing[.-]') THEN '*phishing*'
    WHEN regexp_matches(host, '(^|[.-])malware[.-]') THEN '*malware*'
    WHEN regexp_matches(host, '(^|[.-])link[-.]?farm[.-]') THEN '*link-farm*'
    WHEN regexp_matches(host, '(^|[.-])free[-.]?bets[.-]') THEN '*free-bets*'
    WHEN regexp_matches(host, '(^|[.-])cheap[-.]?pills[.-]') THEN '*cheap-pills*'
    WHEN regexp_matches(host, '(^|[.-])casino[.-]') THEN '*casino*'
    WHEN regexp_matches(host, '(^|[.-])adult[.-]') THEN '*adult*'
    WHEN regexp_matches(host, '(^|[.-])ads[-.]?track[.-]') THEN '*ads-track*' END AS pattern
  FROM marked)
SELECT page_id, host, path, rule, pattern,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM hinted
"""


@query("op8_url_filter", URL_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read(spark, folder, "pages"))


@query("op9_shard_placement")
def shard_placement(spark: SparkSession, folder: str) -> DataFrame:
    placed = shards.place(read(spark, folder, "documents"), shards.shard_names())
    return placed.select("doc_id", "slot", "shard", "shard_name")


MIX_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
level(round, lam, capped) AS (
  SELECT 0, (SELECT 1.5 * sum(source_size)::DOUBLE / sum(weight) FROM totals), 0::BIGINT
  UNION ALL
  SELECT round + 1, s.lam, s.capped FROM level, LATERAL (
    SELECT (1.5 * sum(source_size)::DOUBLE - sum(CASE WHEN weight * level.lam > 2 * source_size THEN 2 * source_size ELSE 0 END)::DOUBLE)
           / sum(CASE WHEN weight * level.lam > 2 * source_size THEN 0.0::DOUBLE ELSE weight END) AS lam,
           sum(CASE WHEN weight * level.lam > 2 * source_size THEN 1 ELSE 0 END)::BIGINT AS capped
    FROM totals) s
  WHERE s.capped > level.capped),
aims AS (
  SELECT *, least(2.0::DOUBLE * source_size, weight * (SELECT lam FROM level ORDER BY round DESC LIMIT 1)) AS target FROM totals),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM aims),
steps AS (
  SELECT s.source, h, sum(size) AS mass FROM sizes s GROUP BY ALL),
runs AS (
  SELECT *, sum(mass) OVER (PARTITION BY source ORDER BY h) AS upto FROM steps),
cuts AS (
  SELECT r.source, r.h, p.target - p.copies * p.source_size AS rest, r.upto, r.mass
  FROM runs r JOIN plans p ON r.source IS NOT DISTINCT FROM p.source),
taken AS (
  SELECT source, h, CASE WHEN upto <= rest THEN 1 WHEN upto - mass <= rest AND upto - rest < rest - (upto - mass) THEN 1 ELSE 0 END AS more
  FROM cuts)
SELECT s.doc_id, s.size, p.source_size, p.target, (s.size * (p.copies + t.more))::BIGINT AS taken
FROM sizes s JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.h = t.h
"""


@query("op10_mix_sources", MIX_SQL)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents"))


@query("op11_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprint_edits(read(spark, folder, "documents"))


TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 't': t} ORDER BY turn NULLS FIRST, encode(role), encode(t)) AS w FROM turns GROUP BY conv_id),
plans AS (
  SELECT conv_id, w, conv_id - conv_id % 5 AS base,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 9 AS h
  FROM own),
whole AS (
  SELECT p.conv_id, list_concat(coalesce(list_slice(b.w, 1, p.h), []), coalesce(list_slice(p.w, p.h + 1, len(p.w)), [])) AS w
  FROM plans p LEFT JOIN own b ON b.conv_id = p.base),
paths AS (
  SELECT conv_id, d, list_slice(w, 1, d) AS g, d = len(w) AS is_end FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, g, min(conv_id) AS owner, count(*) AS n,
         coalesce(sha256(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id)), sha256('')) AS ends_sha256
  FROM paths GROUP BY d, g),
named AS (
  SELECT n.*, p.owner AS parent, (n.n - 1) * CASE WHEN n.d = 0 THEN 0 ELSE octet_length(encode(n.g[n.d].t)) END AS saves,
         (SELECT count(*) FROM nodes c WHERE c.d = n.d + 1 AND list_slice(c.g, 1, n.d) = n.g) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.g = list_slice(n.g, 1, n.d - 1)),
below AS (
  SELECT k.d, k.g, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saves)::BIGINT AS saved_tokens
  FROM (SELECT unnest(range(0, d + 1)) AS d, g AS full_g, n_children, saves FROM named) x, LATERAL (SELECT x.d, list_slice(x.full_g, 1, x.d) AS g) k
  GROUP BY k.d, k.g)
SELECT owner AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM named JOIN below USING (d, g)
"""


@query("op12_conversation_trie", TRIE_SQL)
def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_trie(read(spark, folder, "conversations"))


PHRASE_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, list_slice(w, i, i + m - 1) AS g
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS m))),
f AS (SELECT lang, m, g, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, m, g, c AS a FROM f WHERE m > 1),
cuts AS (
  SELECT x.lang, x.m, x.g, x.a, x.k, l.c AS l, r.c AS r, ((2000000::HUGEINT * x.a) // (l.c + r.c))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) x
  JOIN f l ON l.lang = x.lang AND l.g = list_slice(x.g, 1, x.k)
  JOIN f r ON r.lang = x.lang AND r.g = list_slice(x.g, x.k + 1, x.m)),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, list_slice(g, p, p + size - 1) AS g, max(a) AS most
  FROM (SELECT lang, g, a, m, size, unnest(range(1, m - size + 2)) AS p FROM (SELECT *, unnest(range(2, m)) AS size FROM cand))
  GROUP BY ALL),
kept AS (
  SELECT w.* FROM weakest w LEFT JOIN inside i ON w.lang = i.lang AND w.g = i.g
  WHERE i.most IS NULL OR 100::HUGEINT * i.most < 80::HUGEINT * w.a),
ranked AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", PHRASE_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"))
