"""One query for each training-data operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, linkgraph, quality
from .common import only
from .decontaminate import contamination
from .importance import resample
from .langid import identify
from .linkgraph import Rule, judge
from .minhash import near_duplicates
from .packing import pack
from .pii import detect
from .pq import near_vectors
from .tokens import token_counts
from .warc import round_trip
from .yinyang import encoded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str, **kinds: str) -> DataFrame:
    return only(spark.read.parquet(f"{sf_dir}/{table}.parquet"), **kinds)


@_query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", doc_id="long", text="string")
    return contamination(docs, _read(spark, sf_dir, "benchmark", item_id="string", text="string")).drop("text")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"
#: Windows that two texts share, and runs of them along one alignment, whose length is the longest common stretch.
SQL["op2_decontaminate"] = f"""
WITH item AS (SELECT item_id::VARCHAR AS id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
size AS (SELECT id, w, least(10, len(w)) AS k FROM item WHERE len(w) > 0),
item_window AS (SELECT DISTINCT id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM size)),
doc_window AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM size) WHERE len(w) >= k)),
met AS (SELECT doc_id, id, k, p FROM doc_window JOIN item_window USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM met) GROUP BY doc_id),
least_ AS (SELECT min(k) AS m FROM size),
seed AS (SELECT d.doc_id, i.id, d.p, d.p - i.q AS d FROM
  (SELECT doc_id, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM doc, least_ WHERE doc_id IN (SELECT doc_id FROM hit))) d
  JOIN (SELECT id, q, array_to_string(w[q:q + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS q FROM item, least_ WHERE len(w) >= m)) i USING (g)),
run AS (SELECT doc_id, count(*) + (SELECT m FROM least_) - 1 AS n, min(p) AS p FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, id, d ORDER BY p) AS r FROM seed) GROUP BY doc_id, id, d, r),
best AS (SELECT doc_id, max(n) AS n FROM run GROUP BY doc_id),
far AS (SELECT doc_id, any_value(best.n) AS n, min(p) AS p FROM run JOIN best USING (doc_id) WHERE run.n = best.n GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated, coalesce(f.n, 0)::BIGINT AS longest, (f.p - 1)::BIGINT AS longest_at
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id) LEFT JOIN far f USING (doc_id)
"""

#: From a table ``link`` (a, b), both ways, and ``node`` (id): the smallest id that each reaches.
_REACH = "reach(id, to_) AS (SELECT id, id FROM node UNION SELECT link.b, to_ FROM reach JOIN link ON link.a = reach.id), comp AS (SELECT id, min(to_) AS c FROM reach GROUP BY id)"
SQL["op4_minhash"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_SPACED}'), []) AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT a, b FROM both_ m JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m.n >= 80 * (x.n + y.n - m.n)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), node AS (SELECT DISTINCT a AS id FROM link), {_REACH}
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM doc d LEFT JOIN size s USING (doc_id) LEFT JOIN comp c ON c.id = d.doc_id
"""

SQL["op1_near_vectors"] = f"""
WITH RECURSIVE good AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9), node AS (SELECT DISTINCT a AS id FROM link), {_REACH},
n AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(comp.c, vec_id) AS component_id, coalesce(comp.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN comp ON comp.id = vec_id
"""


@_query
def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents", doc_id="long", text="string"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", doc_id="long", text="string"), k=4, percent=80)


@_query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents", doc_id="long", text="string", lang="string"))


@_query
def op10_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_read(spark, sf_dir, "documents", doc_id="long", text="string"))


@_query
def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings", vec_id="long", embedding="array<double>"), 0.9)


@_query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages", page_id="long", url="string", html="string"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INTEGER >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0)
)
SQL["op8_warc"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS h,
             min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""


@_query
def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
    judged = judge(_read(spark, sf_dir, "pages", page_id="long", url="string", html="string"), rules)
    # the order in which ranks are summed leaves its mark in the last digits
    return judged.select("page_id", "host", "path", "rule", "verdict", *[F.round(c, 9).alias(c) for c in ("trust", "distrust", "neutral")])


def _ranks_sql() -> str:
    """PageRank of three kinds, an iteration a table."""
    out = []
    for i in range(linkgraph.ITERATIONS):
        before = f"r{i - 1}" if i else "(SELECT kind, host, s AS r FROM start)"
        out.append(f"r{i} AS (SELECT kind, host, sum(r) AS r FROM (SELECT e.kind, e.dst AS host, {linkgraph.DAMPING}::DOUBLE * e.w * p.r AS r FROM edge e JOIN {before} p ON p.kind = e.kind AND p.host = e.host UNION ALL SELECT kind, host, (1 - {linkgraph.DAMPING}::DOUBLE) * s FROM start) GROUP BY 1, 2)")
    return ",\n".join(out)


_FIT = "WHEN (host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}') THEN '{2}'"
_FITS = " ".join(_FIT.format(*x) for x in (("example.net", "/en/", "example.net/en/"), ("example.com", "/de/", "example.com/de/"), ("org", "/fr/", "org/fr/"), ("net", "/", "net/")))
_HREF = r"""(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)"""
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL["op6_hosts"] = f"""
WITH cut AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), {_AZ}) AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
placed AS MATERIALIZED (SELECT *, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' END AS said FROM (SELECT *, CASE {_FITS} END AS rule FROM cut)),
link AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{_HREF}', 1)), {_AZ}) AS dst FROM placed WHERE host <> '' AND html IS NOT NULL) WHERE src <> dst GROUP BY 1, 2),
node AS MATERIALIZED (SELECT host, sum(a)::DOUBLE AS allow, sum(b)::DOUBLE AS block, sum(o)::DOUBLE AS other FROM (SELECT host, (coalesce(said, '') = 'allow')::INT AS a, (coalesce(said, '') = 'block')::INT AS b, (said IS NULL)::INT AS o FROM placed WHERE host <> '' UNION ALL SELECT dst, 0, 0, 0 FROM link) GROUP BY host),
alike AS (SELECT host, regexp_replace(host, '^(www|m)\\.', '') AS bare FROM node),
every AS (SELECT * FROM link UNION ALL SELECT host, bare, 1.0 FROM alike WHERE host <> bare UNION ALL SELECT bare, host, 1.0 FROM alike WHERE host <> bare),
way AS (SELECT kind, src, dst, sum(n) AS n FROM (SELECT unnest(['trust', 'neutral']) AS kind, src, dst, n FROM every UNION ALL SELECT 'distrust', dst, src, n FROM every) GROUP BY 1, 2, 3),
loose AS (SELECT k.kind, host AS src, host AS dst, 1.0::DOUBLE AS n FROM node, (VALUES ('trust'), ('distrust'), ('neutral')) k(kind) WHERE NOT EXISTS (SELECT 1 FROM way w WHERE w.kind = k.kind AND w.src = host)),
edge AS MATERIALIZED (SELECT kind, src AS host, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM (SELECT * FROM way UNION ALL SELECT * FROM loose)),
start AS MATERIALIZED (SELECT 'trust' AS kind, host, allow / (SELECT sum(allow) FROM node) AS s FROM node WHERE allow > 0 UNION ALL SELECT 'distrust', host, block / (SELECT sum(block) FROM node) FROM node WHERE block > 0 UNION ALL SELECT 'neutral', host, other / (SELECT sum(other) FROM node) FROM node WHERE other > 0),
{_ranks_sql()},
found AS (SELECT host, coalesce(sum(r) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(r) FILTER (kind = 'distrust'), 0) AS distrust, coalesce(sum(r) FILTER (kind = 'neutral'), 0) AS neutral FROM r{linkgraph.ITERATIONS - 1} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust > {linkgraph.THRESHOLD} * (trust + distrust + neutral) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust, round(coalesce(neutral, 0), 9) AS neutral FROM placed LEFT JOIN found USING (host)
"""


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", doc_id="long", text="string", lang="string", source="string")
    labels = _read(spark, sf_dir, "labels", doc_id="long", quality="int", toxic="int")
    return quality.judge(docs, labels, host=docs["source"], path=docs["lang"])


@_query
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(_read(spark, sf_dir, "conversations", conv_id="long", turn="long", role="string", text="string"))


def _chat_sql() -> str:
    """The automaton's tables as lists, a forward pass of least costs turn by turn, and the way back from the end."""
    q = lambda text: "'" + text.replace("'", "''") + "'"
    marks = lambda roles: "".join(chat.written(r, "") + chat.CLOSE for r in roles)
    every = range(len(chat.STATES))
    costs = ", ".join(f"({r + 1}, {chat.SINGLE[r].tolist()}::BIGINT[][])" for r in every)
    between = [[() if s == t or chat.inserts(s, t) is None else chat.inserts(s, t) for t in chat.STATES] for s in chat.STATES]
    table = lambda f: "[" + ", ".join("[" + ", ".join(q(f(x)) for x in row) + "]" for row in between) + "]"
    ends = [() if s == "start" else chat.ending(s) for s in chat.STATES]
    row = lambda f: "[" + ", ".join(q(f(x)) for x in ends) + "]"
    after = [chat.NEVER if s == "start" else chat.INSERT * len(e) for s, e in zip(chat.STATES, ends, strict=True)]
    states = "[" + ", ".join(map(q, chat.STATES)) + "]"
    number = " ".join(f"WHEN '{r}' THEN {i + 1}" for i, r in enumerate(chat.ROLES))
    least = "list_transform(range(1, 6), lambda j: list_min(list_transform(range(1, 6), lambda s: {0}[s] + {1}[s][j])))"
    return f"""
WITH RECURSIVE m(r, c) AS (VALUES {costs}),
t AS MATERIALIZED (SELECT coalesce(conv_id, -1) AS k, conv_id, turn, role, coalesce(text, '') AS text, CASE role {number} ELSE 5 END AS r,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(turn, -1), role NULLS FIRST, coalesce(text, '')) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
f(k, i, best) AS (SELECT DISTINCT k, 0::BIGINT, [0, {", ".join([str(chat.NEVER)] * 4)}]::BIGINT[] FROM t
  UNION ALL SELECT f.k, t.i, {least.format("f.best", "m.c")} FROM f JOIN t ON t.k = f.k AND t.i = f.i + 1 JOIN m USING (r)),
ends AS (SELECT k, i, list_transform(range(1, 6), lambda j: best[j] + {after}[j]) AS total FROM f WHERE (k, i) IN (SELECT k, n FROM t)),
b(k, i, state) AS (SELECT k, i, list_position(total, list_min(total))::BIGINT FROM ends
  UNION ALL SELECT k, i, list_position(l, list_min(l))::BIGINT FROM (SELECT b.k, f.i, list_transform(range(1, 6), lambda s: f.best[s] + m.c[s][b.state]) AS l
    FROM b JOIN t ON t.k = b.k AND t.i = b.i JOIN m USING (r) JOIN f ON f.k = b.k AND f.i = b.i - 1)),
w AS (SELECT t.*, x.state AS x, y.state AS y, t.i = t.n AS last FROM t JOIN b x ON x.k = t.k AND x.i = t.i - 1 JOIN b y ON y.k = t.k AND y.i = t.i)
SELECT conv_id, turn, role, {states}[y] AS new_role, x = y AS merged, {table(",".join)}[x][y] AS inserted, CASE WHEN last THEN {row(",".join)}[y] ELSE '' END AS appended, (m.c[x][y] + CASE WHEN last THEN {after}[y] ELSE 0 END)::BIGINT AS cost,
CASE WHEN x = y THEN chr(10) || text ELSE CASE WHEN i > 1 THEN {q(chat.CLOSE)} ELSE '' END || {table(marks)}[x][y] || {q(chat.OPEN)} || {states}[y] || chr(10) || text END || CASE WHEN last THEN {q(chat.CLOSE)} || {row(marks)}[y] ELSE '' END AS piece
FROM w JOIN m USING (r)
"""


SQL["op5_chat"] = _chat_sql()


@_query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents", doc_id="long", text="string"), _read(spark, sf_dir, "benchmark", text="string"))


#: The CRC byte by byte through a table made by eight steps of its polynomial, over each different feature's text.
SQL["op12_resample"] = f"""
WITH RECURSIVE steps(v, x, i) AS (SELECT v, v, 0 FROM range(256) r(v) UNION ALL SELECT v, xor(x >> 1, (x & 1) * 3988292384), i + 1 FROM steps WHERE i < 8),
crc AS (SELECT list(x ORDER BY v) AS t FROM steps WHERE i = 8),
word AS (SELECT true AS target, row_number() OVER () AS r, NULL::BIGINT AS doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL
  UNION ALL SELECT false, row_number() OVER (), doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) FROM documents),
feature AS (SELECT target, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM word),
bytes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM feature)),
bucket AS (SELECT f, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM bytes, crc),
n AS (SELECT b, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM feature JOIN bucket USING (f) GROUP BY b),
total AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM n),
gain AS (SELECT b, floor(1000 * ln((n.t + 1)::DOUBLE * (total.s + 10000) / ((n.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM n, total),
mean AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS m FROM feature JOIN bucket USING (f) JOIN gain USING (b) WHERE NOT target GROUP BY r),
doc AS (SELECT doc_id, len(w) AS n, greatest(2 * len(w) - 1, 0)::BIGINT AS n_features, coalesce(m, 0) AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM word LEFT JOIN mean USING (r) WHERE NOT target),
scored AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC NULLS LAST, doc_id) AS k, count(*) FILTER (n >= 20) OVER () AS total FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND k <= 25 * total // 100 AND score IS NOT NULL THEN k END AS rank FROM ranked
"""


@_query
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _codes_sql() -> str:
    """Lloyd's method with all distances, an assignment and a codebook a table."""
    dot = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
    out = []
    for i in range(5):
        far = f"{dot.format('x.v', 'x.v')} - 2 * {dot.format('x.v', 'c.v')} + {dot.format('c.v', 'c.v')}"
        out.append(f"a{i} AS MATERIALIZED (SELECT x.vec_id, x.p, min({{'d': ({far})::BIGINT, 'e': c.e}}) AS m FROM part x JOIN b{i} c USING (p) GROUP BY 1, 2)")
        mean = f"SELECT p, e, list(t ORDER BY q) AS v FROM (SELECT p, a.m.e AS e, q, floor(sum(v[q])::DOUBLE / count(*))::BIGINT AS t FROM a{i} a JOIN part USING (vec_id, p), (SELECT unnest(range(1, len(v) + 1)) AS q FROM b0 LIMIT (SELECT len(any_value(v)) FROM b0)) GROUP BY 1, 2, 3) GROUP BY 1, 2"
        if i < 4:
            out.append(f"b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN ({mean}) n USING (p, e))")
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
part AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM whole, range(4) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part WHERE vec_id IN (SELECT vec_id FROM whole ORDER BY vec_id LIMIT 256)),
{", ".join(out)},
code AS (SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a4 GROUP BY vec_id),
total AS (SELECT label, sum(error)::BIGINT AS label_error FROM whole JOIN code USING (vec_id) GROUP BY label)
SELECT w.vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b4) AS codebooks_sha256
FROM whole w JOIN code USING (vec_id) JOIN total t ON t.label IS NOT DISTINCT FROM w.label
"""


SQL["op11_codes"] = _codes_sql()


@_query
def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_read(spark, sf_dir, "documents", doc_id="long", text="string"), public_tokenizers.path("byte_bpe_50k.json"))
