"""DuckDB SQL for the queries that SQL can express on small tables."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS t FROM documents),
p AS (SELECT doc_id, i, array_to_string(t[i:i + 34], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 33)) AS i FROM w)),
c AS (SELECT s FROM p GROUP BY s HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM p SEMI JOIN c USING (s)),
n AS (SELECT doc_id, count(*) AS n_removed FROM r GROUP BY doc_id),
u AS (SELECT doc_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS k FROM w),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS s FROM u ANTI JOIN r USING (doc_id, k) GROUP BY doc_id)
SELECT w.doc_id, len(t) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""

OP3 = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, i, array_to_string(t[i:i + 7], ' ') AS s FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM w)),
d AS (SELECT doc_id, s FROM p GROUP BY doc_id, s HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM p SEMI JOIN d USING (doc_id, s)) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(t) AS n_words, length(array_to_string(t, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capitals FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words OR n_dup_lines > 2 AND 10 * n_dup_lines > 3 * len(string_split(text, chr(10)))
       OR 2 * capitals > letters OR 2 * letters < word_chars OR 10 * length(regexp_replace(text, '[^!?]+', '', 'g')) > 3 * n_words) AS kept FROM b"""

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c"""

HEX = "strpos('0123456789abcdef', substr(h, {}, 1)) - 1"
BASE32 = f"""array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((({HEX.format('(5 * i) // 4 + 1')}) * 16 + ({HEX.format('(5 * i) // 4 + 2')})) >> (3 - (5 * i) % 4)) & 31) + 1, 1)), '')"""

OP9 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact FROM m"""

OP11 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS t FROM p),
g AS (SELECT lang, k AS size, array_to_string(t[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM w, range(1, 4) r(k))),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS t FROM f WHERE size > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.size, a, t, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score FROM c, range(1, 3) z(k)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(t[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(t[k + 1:], ' ') WHERE k < c.size),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 50 * b.a))
SELECT lang, row_number() OVER o AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM d JOIN n USING (lang) WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000"""



def _levels(name: str, n: int = 4) -> str:
    """Common tables of the levels above {name}0 (tree, i, n, d), and what stands before and behind each node in its run."""
    out = []
    for k in range(n):
        out.append(f"{name}{k + 1} AS (SELECT tree, i // 16 AS i, (n + 15) // 16 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, i // 16, n)")
        out.append(f"{name}s{k} AS (SELECT tree, i, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS e FROM {name}{k} WHERE n > 1 WINDOW w AS (PARTITION BY tree, i // 16 ORDER BY i))")
    out.append(f"{name}r AS ({' UNION ALL '.join(f'SELECT tree, d FROM {name}{k} WHERE n = 1' for k in range(n + 1))})")
    return ",\n".join(out)


def _way(at: str, name: str, tree: str, i: str, n: int = 4) -> str:
    """Common tables {at}1 to {at}n from {at}0: the proof p and the folded f grow by a level each."""
    return ",\n".join(f"{at}{k + 1} AS (SELECT x.* REPLACE (p || coalesce(b || e, '') AS p, CASE WHEN b IS NULL THEN f ELSE sha256(b || f || e) END AS f) FROM {at}{k} x LEFT JOIN {name}s{k} s ON s.tree = x.{tree} AND s.i = x.{i} // {16**k})" for k in range(n))


def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


CRC32 = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length({0}) + 1), lambda j: ascii({0}[j])::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""
LEAF = " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
LOWERED = f"CASE WHEN {CRC32.format('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
OP12 = f"""
WITH d AS (SELECT doc_id, source, {_encoded('source')} AS tree, sha256({LEAF} || {_encoded('text')}) AS d, sha256({LEAF} || {_encoded('lowered')}) AS f FROM (SELECT *, {LOWERED} AS lowered FROM documents)),
n0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_levels('n')},
t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY nullif(tree, '-') IS NOT NULL, substring(tree, strpos(tree, ':') + 1)) - 1 AS i, count(*) OVER () AS n, d, tree AS own FROM nr),
{_levels('t')},
a0 AS (SELECT n0.doc_id, n0.tree, n0.i, n0.d AS leaf, t0.d AS subroot, t0.i AS j, '' AS top, '' AS p, f FROM n0 JOIN t0 ON t0.own = n0.tree),
{_way('a', 'n', 'tree', 'i')},
b0 AS (SELECT * FROM a4),
{_way('b', 't', 'top', 'j')}
SELECT doc_id, leaf, subroot, tr.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = tr.d AS verified FROM b4, tr"""

ORACLES = {"op12_merkle_manifest": OP12, "op11_collocations": OP11, "op1_substring_dedup": OP1, "op3_quality_rules": OP3, "op9_warc": OP9, "op10_embedding_near_dedup": OP10}
