"""The operators' queries over whole tables, and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, importance, jaccard_join, lang_id, merkle, mixing, paragraph_dedup, sharding, substring_dedup, token_count, topk_search, toxicity


def queries() -> dict:
    return {
        "op1_lang_id": lang_id.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_token_count": token_count.query,
        "op4_jaccard_join": jaccard_join.query,
        "op5_paragraph_dedup": paragraph_dedup.query,
        "op6_embedding_dedup": embedding_dedup.query,
        "op7_decontaminate": decontaminate.query,
        "op8_mixing": mixing.query,
        "op9_toxicity": toxicity.query,
        "op10_sharding": sharding.query,
        "op11_merkle": merkle.query,
        "op12_topk_search": topk_search.query,
        "op13_importance": importance.query,
    }


#: Words, sets of 5-word shingles, links by counting shared shingles, smallest reachable id.
JACCARD = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n, list_sort(list(s)) AS l FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.v, r.comp FROM r JOIN e ON e.u = r.id WHERE r.comp < e.v),
m AS (SELECT id, min(comp) AS comp FROM r GROUP BY 1),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY l) AS class_id FROM n),
d AS (SELECT u, count(*) AS n_links FROM e GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.comp AS component_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(d.n_links, 0) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id LEFT JOIN k USING (doc_id) LEFT JOIN d ON d.u = w.doc_id"""


#: Windows of 100 bytes as hex, all but the first of each; their runs; what lies between.
SUBSTRINGS = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, hash(substr(x, 2 * s + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, s, sum(c) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS c FROM r)),
g AS (SELECT doc_id, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY 1, 2),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM g GROUP BY 1),
p AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM g UNION ALL SELECT doc_id, max(b), NULL FROM g GROUP BY 1),
k AS (SELECT p.doc_id, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS x FROM p JOIN d USING (doc_id) GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.x, d.x))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""


#: All pairs of one label, smallest reachable id.
EMBEDDINGS = """WITH RECURSIVE
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
f AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS w FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) >= 0.98 * sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))),
r(id, comp) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.w, r.comp FROM r JOIN e ON e.u = r.id WHERE r.comp < e.w),
m AS (SELECT id, min(comp) AS comp FROM r GROUP BY 1),
d AS (SELECT u, count(*) AS n FROM e GROUP BY 1)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, m.comp AS component_id, v.vec_id = m.comp AS kept FROM v LEFT JOIN m ON m.id = v.vec_id LEFT JOIN d ON d.u = v.vec_id"""


# The primes and the seed of XXH64 as the engine hashes rows, and CRC-32's polynomial.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED, POLYNOMIAL = 42, 0xEDB88320


def let(expr: str, body) -> str:
    """`body` of a name that stands for `expr`, so that nothing is worked out twice."""
    let.n += 1
    name = f"v{let.n}"
    return f"list_transform([{expr}], lambda {name}: {body(name)})[1]"


let.n = 0


def xxh64(value: str, seed: str) -> str:
    """XXH64 of an 8-byte integer, as an unsigned one."""
    wrap = lambda x: f"CAST(({x}) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    times = lambda x, p: wrap(f"CAST({x} AS UHUGEINT) * {p}::UHUGEINT")
    plus = lambda x, p: wrap(f"CAST({x} AS UHUGEINT) + {p}::UHUGEINT")
    turn = lambda x, k: let(x, lambda v: f"xor({times(v, 1 << k)}, {v} >> {64 - k})")
    fold = lambda x, k: let(x, lambda v: f"xor({v}, {v} >> {k})")
    word = f"CAST(CASE WHEN {value} < 0 THEN {value}::HUGEINT + 18446744073709551616 ELSE {value}::HUGEINT END AS UBIGINT)"
    h = f"xor({plus(seed, P5 + 8)}, {times(turn(times(word, P2), 31), P1)})"
    h = plus(times(turn(h, 27), P1), P4)
    return fold(times(fold(times(fold(h, 33), P2), 29), P3), 32)


def crc32_table() -> list[int]:
    table = list(range(256))
    for _ in range(8):
        table = [(x >> 1) ^ (POLYNOMIAL * (x & 1)) for x in table]
    return table


def crc32(hex_text: str) -> str:
    """CRC-32 of bytes given as hex."""
    b = f"list_transform(regexp_extract_all({hex_text}, '..'), lambda x: CAST('0x' || x AS UINTEGER))"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::UINTEGER, {b}), lambda c, x: xor(c >> 8, ({crc32_table()}::UINTEGER[])[xor(c, x) % 256 + 1])), 4294967295::UINTEGER) AS BIGINT)"


#: Inner products of whole numbers, each query's rows in order.
TOPK = f"""WITH
v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({topk_search.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])) AS BIGINT), 0) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {topk_search.K}"""


#: Single words, counted by bucket of their CRC-32; gains, weights and the hash's noise.
IMPORTANCE = rf"""WITH
a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(w) AS w FROM a) GROUP BY 1, 2),
tw AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM b) GROUP BY 1),
v AS (SELECT w, {crc32("hex(encode(w))")} % {importance.BUCKETS} AS bucket FROM (SELECT w FROM sw UNION SELECT w FROM tw)),
s AS (SELECT bucket, sum(c) AS s FROM sw JOIN v USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(c) AS t FROM tw JOIN v USING (w) GROUP BY 1),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) + {importance.BUCKETS} AS s, coalesce((SELECT sum(t) FROM t), 0) + {importance.BUCKETS} AS t),
g AS (SELECT v.w, CAST(floor(1000 * ln(CAST((coalesce(t.t, 0) + 1) * n.s AS DOUBLE) / CAST((coalesce(s.s, 0) + 1) * n.t AS DOUBLE))) AS BIGINT) AS gain FROM v LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
d AS (SELECT r, CAST(sum(c * gain) AS BIGINT) AS weight FROM sw JOIN g USING (w) GROUP BY 1),
h AS (SELECT a.doc_id, CAST(len(a.w) AS BIGINT) AS n_features, coalesce(d.weight, 0) AS weight, CAST(CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) AS DOUBLE) AS h FROM a LEFT JOIN d USING (r)),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM h),
q AS (SELECT *, row_number() OVER (ORDER BY n_features >= {importance.MIN_WORDS} DESC, score DESC, doc_id NULLS FIRST) AS k, count(*) FILTER (n_features >= {importance.MIN_WORDS}) OVER () AS n FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {importance.MIN_WORDS} AND k <= {importance.PERCENT} * n // 100 THEN k END AS rank FROM q"""


def told(*values: str) -> str:
    """Digest of values with their lengths, nulls as `-`."""
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Nodes level by level, per source and then of the subroots; each leaf's runs on its way up, folded in order.
MERKLE = f"""WITH RECURSIVE
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS g, {told(*merkle.FIELDS)} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32("hex(encode(CAST(doc_id AS VARCHAR)))")} % 5 = 0 THEN {told("doc_id", "source", "lang", "n_chars", LOW)} END AS low FROM documents),
p AS (SELECT doc_id, g, leaf, coalesce(low, leaf) AS seen, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, coalesce(low, leaf)) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM d),
n(g, l, i, h, c) AS (SELECT g, 0, i, leaf, c FROM p UNION ALL SELECT g, l + 1, i // {merkle.FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (c + {merkle.FANOUT - 1}) // {merkle.FANOUT} FROM n WHERE c > 1 GROUP BY g, l, i // {merkle.FANOUT}, c),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS c FROM n WHERE c = 1),
m(l, i, h, c) AS (SELECT 0, i, subroot, c FROM s UNION ALL SELECT l + 1, i // {merkle.FANOUT}, sha256(string_agg(h, '' ORDER BY i)), (c + {merkle.FANOUT - 1}) // {merkle.FANOUT} FROM m WHERE c > 1 GROUP BY l, i // {merkle.FANOUT}, c),
a AS (SELECT g, l, i // {merkle.FANOUT} AS k, list(h ORDER BY i) AS kids FROM n WHERE c > 1 GROUP BY ALL),
b AS (SELECT l, i // {merkle.FANOUT} AS k, list(h ORDER BY i) AS kids FROM m WHERE c > 1 GROUP BY ALL),
w AS (SELECT p.g, p.i, a.l, a.kids, CAST((p.i >> (4 * a.l)) % {merkle.FANOUT} AS BIGINT) AS j FROM p JOIN a ON a.g = p.g AND a.k = p.i >> (4 * (a.l + 1))
  UNION ALL SELECT p.g, p.i, b.l + 100, b.kids, (s.i >> (4 * b.l)) % {merkle.FANOUT} FROM p JOIN s ON s.g = p.g JOIN b ON b.k = s.i >> (4 * (b.l + 1))),
t AS (SELECT g, i, list({{'x': array_to_string(kids[1:j], ''), 'y': array_to_string(kids[j + 2:], '')}} ORDER BY l) AS t FROM w GROUP BY 1, 2),
f AS (SELECT p.*, t.t, list_reduce(list_prepend({{'x': seen, 'y': ''}}, coalesce(t.t, [])), lambda u, v: {{'x': sha256(v.x || u.x || v.y), 'y': ''}}).x AS folded_root FROM p LEFT JOIN t USING (g, i))
SELECT doc_id, leaf, subroot, m.h AS root, sha256(coalesce(array_to_string(list_transform(t, lambda v: v.x || v.y), ''), '')) AS proof_sha256, folded_root, folded_root = m.h AS verified FROM f JOIN s USING (g) JOIN m ON m.c = 1"""


def sharding_sql(shards: int = sharding.SHARDS) -> str:
    """The ring's nodes as rows, each document's place on it by its id's hash, the rows that a
    shard's bound lets its own arcs keep by running counts, and two laps of the ring, node
    by node, with those that overflow."""
    nodes = sharding.ring(shards)
    ring = ", ".join(f"({i}, {at}, {s})" for i, (at, s) in enumerate(nodes))
    seed = f"{SEED}::UBIGINT"
    point = f"CASE WHEN doc_id IS NULL THEN {xxh64('crc', xxh64('size', seed))} ELSE {xxh64('coalesce(doc_id, 0)', seed)} END >> 1"
    return f"""WITH RECURSIVE
d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {crc32("hex(encode(coalesce(text, '')))")} AS crc FROM documents),
nd(arc, pos, shard) AS (SELECT a::BIGINT, p::UBIGINT, s::INTEGER FROM (VALUES {ring}) v(a, p, s)),
h AS (SELECT *, {point} AS p FROM d),
a AS (SELECT h.*, coalesce(nd.arc, 0) AS arc FROM h ASOF LEFT JOIN nd ON h.p <= nd.pos),
k AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY p, doc_id NULLS FIRST, size, crc) - 1 AS rank FROM a),
c AS (SELECT nd.arc, nd.shard, coalesce(n, 0) AS n, (SELECT count(*) FROM d) // {shards} + CASE WHEN nd.shard < (SELECT count(*) FROM d) % {shards} THEN 1 ELSE 0 END AS bound FROM nd LEFT JOIN (SELECT arc, count(*) AS n FROM k GROUP BY 1) USING (arc)),
o AS (SELECT arc, shard, n, bound, least(bound, cum - n) AS first, least(bound, cum) - least(bound, cum - n) AS own FROM (SELECT *, sum(n) OVER (PARTITION BY shard ORDER BY arc) AS cum FROM c)),
f AS (SELECT *, n - own AS over, sum(n - own) OVER (ORDER BY arc) - (n - own) AS g0 FROM o),
s AS (SELECT list(room ORDER BY shard) AS rooms FROM (SELECT shard, CAST(any_value(bound) - sum(own) AS BIGINT) AS room FROM o GROUP BY 1)),
w(i, pushed, served, rooms, shard, first, take, slot) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, rooms, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM s UNION ALL
  SELECT i + 1, CAST(pushed + CASE WHEN i < {len(nodes)} THEN over ELSE 0 END AS BIGINT), served + t, list_transform(rooms, lambda x, j: CASE WHEN j = z + 1 THEN x - t ELSE x END), z, served, t, CAST(bound - rooms[z + 1] AS BIGINT)
  FROM (SELECT w.i, w.pushed, w.served, w.rooms, f.over, f.bound, f.shard AS z, least(w.pushed - w.served, w.rooms[f.shard + 1]) AS t FROM w JOIN f ON f.arc = w.i % {len(nodes)} WHERE w.i < {2 * len(nodes)})),
m AS (SELECT first, shard, slot FROM w WHERE take > 0),
x AS (SELECT k.*, f.shard AS own_shard, f.first, f.own, f.g0 + k.rank - f.own AS g FROM k JOIN f USING (arc))
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, own_shard AS shard, CAST(first + rank AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM x WHERE rank < own
UNION ALL SELECT doc_id, size, crc, 'rows', m.shard, CAST(m.slot + g - m.first AS BIGINT), NULL FROM (SELECT * FROM x WHERE rank >= own) x ASOF JOIN m ON x.g >= m.first"""


def oracle_sql() -> dict[str, str]:
    """Operators that are not here have no SQL form; tests hold those against brute force, a public
    library or held-out accuracy. The index of embeddings finds a link at the threshold with
    a chance of 0.998, so its rows may differ from SQL's on tables with many links."""
    return {"op2_substring_dedup": SUBSTRINGS, "op4_jaccard_join": JACCARD, "op6_embedding_dedup": EMBEDDINGS, "op10_sharding": sharding_sql(), "op11_merkle": MERKLE, "op12_topk_search": TOPK, "op13_importance": IMPORTANCE}
