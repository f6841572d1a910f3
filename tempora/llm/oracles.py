"""DuckDB SQL for the corpus queries that SQL can express over whole tables.

The other queries hash with XXH64, train a model or tokenise; tests hold them
against brute-force versions.
"""

from __future__ import annotations

from tempora.llm.sharding import Node, grown, uniform_tree

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _descend(node: Node) -> str:
    """The shard of ``key`` as an SQL expression."""
    if node.shard is not None:
        return str(node.shard)
    if len(node.children) == 1:
        return _descend(node.children[0])
    draws = ", ".join(f"-ln((('0x' || substr(md5(key || '|{c.name}'), 1, 12))::BIGINT + 1) / {float(2**48 + 1)!r}) / {float(c.weight)!r}" for c in node.children)
    branches = " ".join(f"WHEN {i} THEN {_descend(c)}" for i, c in enumerate(node.children))
    return f"CASE list_position([{draws}], least({draws})) - 1 {branches} END"


def shards(tree: Node, larger: Node) -> str:
    return f"""
WITH RECURSIVE bits(n, k, c) AS (SELECT range::BIGINT, 0, range::BIGINT FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, coalesce(text, '') AS text FROM documents),
b AS (SELECT doc_id, key, strlen(text)::BIGINT + 1 AS size, list_transform(string_split(trim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '), lambda h: CASE WHEN h = '' THEN NULL ELSE ('0x' || h)::BIGINT END) AS bytes FROM d),
s AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], list_filter(bytes, lambda x: x IS NOT NULL)), lambda c, x: xor(c >> 8, t[((xor(c, x)) & 255) + 1]))) AS text_crc32, {_descend(tree)} AS shard, {_descend(larger)} AS grown_shard FROM b, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INTEGER AS grown_shard FROM s"""


_SUBSTRINGS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, p FROM win JOIN (SELECT k FROM win GROUP BY k HAVING count(*) > 1) USING (k)),
gone AS (SELECT DISTINCT r, p + o AS i FROM twice, range(35) x(o)),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)"""


def line_quality(least_docs: int = 5, max_share: float = 0.01, keep_share: float = 0.5) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
word AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
tri AS (SELECT r, i, word AS a, lead(word) OVER v AS b, lead(word, 2) OVER v AS c FROM word WINDOW v AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, a, b, c FROM tri WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM tri JOIN twice USING (r, a, b, c), range(3) x(o) GROUP BY r),
line AS (SELECT r, doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
solid AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, regexp_replace(lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')), '[0-9]', '0', 'g') AS normal FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY r),
hosts AS (SELECT host, count(DISTINCT doc_id) AS docs FROM solid GROUP BY host),
common AS (SELECT s.host, normal FROM solid s JOIN hosts h ON s.host IS NOT DISTINCT FROM h.host GROUP BY s.host, normal, docs HAVING count(DISTINCT doc_id) > {least_docs} AND count(DISTINCT doc_id) > docs * {max_share}::DOUBLE),
cut AS (SELECT r, sum(words)::BIGINT AS n FROM solid s JOIN common c ON s.normal = c.normal AND s.host IS NOT DISTINCT FROM c.host GROUP BY r),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(cut.n, 0)::BIGINT AS n_removed_words FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN cut USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= n_words * {keep_share}::DOUBLE AS kept FROM f"""


_AUDIT = rf"""
WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE position(f IN o) = 0),
lab AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source::VARCHAR, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id),
c AS (SELECT part, good, toxic, failed, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT part, o, i AS step, o[i] AS filter, n, good, toxic, failed, position(o[i] IN failed) > 0 AS fails, length(translate(o[1:i - 1], failed, '')) < i - 1 AS gone FROM c, orders, range(1, 6) x(i) WHERE length(o) = 5),
m AS (SELECT part, o AS filter_order, step, filter, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = filter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN fails AND NOT gone AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT gone AND toxic THEN n ELSE 0 END) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM m"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round by comparing every part with every entry."""
    floor_mean = "((s - ((s % n) + n) % n) // n)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT p.r, p.part, b.entry, (SELECT sum((x.a - x.b) * (x.a - x.b)) FROM (SELECT unnest(p.v) AS a, unnest(b.v) AS b) x)::HUGEINT AS d FROM p JOIN b{k} b USING (part)),
a{k} AS MATERIALIZED (SELECT r, part, min(d) AS d, arg_min(entry, d * {entries} + entry) AS entry FROM d{k} GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT part, entry, list(m ORDER BY i) AS v FROM (SELECT part, entry, i, {floor_mean} AS m FROM (SELECT part, entry, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY ALL)) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    return f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::HUGEINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS v FROM e, range({parts}) x(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {entries}),{",".join(steps)},
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM b{rounds})),
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM c JOIN e USING (r), books"""


def oracle_sql(regions: int, racks: int, per_rack: int) -> dict[str, str]:
    tree = uniform_tree(regions, racks, per_rack)
    return {"op1_hash_tree": shards(tree, grown(tree, regions * racks * per_rack)), "op2_substring": _SUBSTRINGS, "op10_quality": line_quality(), "op11_filter_audit": _AUDIT, "op13_vector_codes": vector_codes()}
