"""Registered queries of the numbered operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadscope.llm import decontam, lexical, line_dedup, merkle, mixing, perfect_hash, quality, sharding, simhash, topk, toxicity, url_reputation, warc
from dyadscope.llm.common import crc_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op3_decontamination", f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + least(13, len(w)) - 1), ' ') AS gram
        FROM i, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS u(k) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TOKENS} AS w FROM documents),
grams AS (SELECT row, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS gram
       FROM d, (SELECT DISTINCT n FROM win), unnest(generate_series(1, len(w) - n + 1)) AS u(k)),
hit AS (SELECT row, k, g.n, item FROM grams g JOIN win USING (gram, n)),
words AS (SELECT row, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(k, k + n - 1)) AS u(p) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hit) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", "n_clauses")


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_plan(table(spark, sf_dir, "documents"))


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    words = F.aggregate("removed_runs", F.lit(0).cast("bigint"), lambda n, r: n + r["words"])
    return found.select("doc_id", "text", "removed_lines", words.alias("removed_words"), "removed_runs")


URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def _strength_sql(level: str) -> str:
    """Prior strength of a level by the method of moments."""
    return f"""(SELECT (1 - rho) / rho FROM (SELECT least(greatest(coalesce(CASE WHEN sum(n) > count(*) THEN (sum((k - n * above) ** 2 / (n * above * (1 - above))) - count(*)) / (sum(n) - count(*)) END,
      {url_reputation.RHO_LOW}), {url_reputation.RHO_LOW}), {url_reputation.RHO_HIGH}) AS rho FROM {level} WHERE n > 0 AND above > 0 AND above < 1))"""


def _rule_sql(then: int) -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[then]}'" for v, h, p in rules]
    return f"CASE {' '.join(cases)} END"


#: A document is named by the last segment of the path, if that is a number of at most 18 digits, with or without a file type.
NAMED = "/([0-9]{1,18})(?:[.][A-Za-z0-9]*)?\\z"
_TWO = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABEL_SUFFIXES)
_OP10 = f"""
WITH r AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, TRY_CAST(regexp_extract(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '{NAMED}', 1) AS BIGINT) AS doc_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM r),
l AS (SELECT doc_id, avg(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k, regexp_replace(host, ':[0-9]*$', '') AS name FROM p LEFT JOIN l USING (doc_id) GROUP BY host),
h1 AS (SELECT *, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS address, regexp_extract(name, '([^.]+\\.[^.]+)$', 1) AS two,
              regexp_extract(name, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS three FROM h0),
h AS (SELECT host, n, k, CASE WHEN address THEN '' WHEN two IN ({_TWO}) THEN two ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix,
             CASE WHEN address THEN name WHEN two IN ({_TWO}) THEN coalesce(nullif(three, ''), name) ELSE coalesce(nullif(two, ''), name) END AS domain FROM h1),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix),
s AS (SELECT *, (SELECT coalesce(sum(k) / nullif(sum(n), 0), {url_reputation.UNKNOWN}) FROM s0) AS above FROM s0),
sm AS (SELECT suffix, (k + m * above) / (n + m) AS mean FROM s, (SELECT {_strength_sql('s')} AS m)),
d AS (SELECT domain, suffix, n, k, mean AS above FROM d0 JOIN sm USING (suffix)),
dm AS (SELECT domain, suffix, (k + m * above) / (n + m) AS mean FROM d, (SELECT {_strength_sql('d')} AS m)),
hh AS (SELECT host, n, k, mean AS above FROM h JOIN dm USING (domain, suffix)),
hm AS (SELECT host, n, (k + m * above) / (n + m) AS mean, m FROM hh, (SELECT {_strength_sql('hh')} AS m)),
known AS (SELECT host, mean - {url_reputation.Z} * sqrt(mean * (1 - mean) / (n + m + 1)) AS lower FROM hm)
SELECT page_id, host, path, {_rule_sql(0)} AS rule, coalesce({_rule_sql(1)}, CASE WHEN lower >= {url_reputation.LEAST} THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN known USING (host)
"""


def named_document(url: Column) -> Column:
    """Id of the document that a url names; null if its path does not end in one."""
    return F.regexp_extract(url_reputation.host_and_path(url)[1], NAMED, 1).try_cast("bigint")


@query("op10_url_reputation", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document that its url names."""
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", named_document(F.col("url")).alias("doc_id"))
    marks = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("good"))
    return url_reputation.judge(pages, named.join(marks, "doc_id").select("page_id", "good"), URL_RULES)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * c + 1}, 5))::BIGINT >> {15 - 5 * i}) & 31) + 1)::INT, 1)"
    for c in range(8) for i in range(4)
)


@query("op6_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT body AS b, min(page_id) AS first_id FROM p GROUP BY body)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f ON body = b
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.lookup(warc.write_archive(pages), warc.keys_of(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where("vec_id % 100 = 0"), vectors)


@query("op11_lexical_search", f"""
WITH i AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TOKENS}) AS terms FROM benchmark),
d AS (SELECT row_number() OVER () AS row, doc_id, {_TOKENS} AS terms FROM documents),
n AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
held AS (SELECT row, doc_id, len(terms)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM d, unnest(terms) AS u(term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, n GROUP BY term, docs),
hit AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * held.n * docs) // words))) AS s FROM held JOIN w USING (term), n),
s AS (SELECT item, item_id, row, doc_id, sum(s)::BIGINT AS score FROM (SELECT item, item_id, unnest(terms) AS term FROM i) JOIN hit USING (term) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query("op12_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are the history whose digests are indexed, the others are looked up."""
    found = perfect_hash.dedup(table(spark, sf_dir, "documents"), perfect_hash.earlier_delivery())
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return f"sha256({' || '.join(map(_field_sql, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


#: Parity of the CRC-32 of a decimal number: bytes, then eight shifts a byte.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS start FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lvl, pos, n, leaf AS node FROM p
      UNION ALL SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
sub AS MATERIALIZED (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
r AS (SELECT 0 AS lvl, pos, n, subroot AS node FROM sub
      UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM r WHERE n > 1 GROUP BY lvl, pos // 3, n),
own AS (SELECT row, lvl, t.pos, p.pos // (3 ** lvl)::BIGINT AS here, node FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source AND t.n > 1 AND t.pos // 3 = p.pos // (3 ** (lvl + 1))::BIGINT
        UNION ALL SELECT row, 100 + lvl, r.pos, s.pos // (3 ** lvl)::BIGINT AS here, node
        FROM p JOIN sub s ON p.source IS NOT DISTINCT FROM s.source JOIN r ON r.n > 1 AND r.pos // 3 = s.pos // (3 ** (lvl + 1))::BIGINT),
seg AS (SELECT row, lvl, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos < here), '') AS l, coalesce(string_agg(node, '' ORDER BY pos) FILTER (WHERE pos > here), '') AS r FROM own GROUP BY row, lvl),
path AS (SELECT row, list(l || '|' || r ORDER BY lvl) AS segs FROM seg GROUP BY row),
o AS (SELECT doc_id, leaf, subroot, (SELECT node FROM r WHERE n = 1) AS root, coalesce(segs, []) AS segs, start
      FROM p JOIN sub ON p.source IS NOT DISTINCT FROM sub.source LEFT JOIN path USING (row)),
f AS (SELECT *, list_reduce(list_prepend(start, segs), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root FROM o)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(segs, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered leaf is worked out where the text is read and folded with the siblings of the untampered manifest."""
    tampered = F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), 2) == 0)
    start = F.when(tampered, merkle.leaf_digest({"text": F.translate("text", "\n", "")})).otherwise(merkle.leaf_digest())
    found = merkle.manifest(table(spark, sf_dir, "documents"), {"start": start})
    folded = merkle.fold(F.col("start"), F.col("siblings"))
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings_text(F.col("siblings")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
