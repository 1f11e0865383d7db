"""SQL of the queries that DuckDB can express: plain brute force over whole tables, beside the methods of the operators."""

from __future__ import annotations

from lexiline.llm import chosen_path, jump_shard, lattice, residue_mining, revisits, template_decontam

#: The table of the checksum, derived bit by bit from its polynomial.
CRC_TABLE = """bits AS (SELECT range AS n, range::BIGINT AS c, 0 AS k FROM range(256) UNION ALL
  SELECT n, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8)"""


def crc32(text: str) -> str:
    """Checksum of a text in UTF-8; needs `crc_table` in the FROM clause."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295::BIGINT)"


REVISITS = f"""WITH RECURSIVE {CRC_TABLE},
page AS (SELECT page_id, url, md5(coalesce(html, '')) AS digest, {crc32("coalesce(url, '')")} % 1000 * 100 + page_id % 100 AS t FROM pages, crc_table),
bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM page),
keyed AS (SELECT page_id, digest, t,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www\\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
    list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'),
      lambda p: p <> '' AND lower(regexp_extract(p, '^([^=]*)', 1)) NOT IN {revisits.TRACKING})) AS params FROM bare),
capture AS (SELECT page_id, digest, t, place || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url_key FROM keyed),
header AS (
  SELECT page_id * 4 AS record_id, unnest(['Content-Type', 'ETag', 'Date']) AS name, unnest(['text/html', '"' || left(digest, 8) || '"', t::VARCHAR]) AS value FROM capture
  UNION ALL SELECT page_id * 4 + 1, unnest(['ETag', 'Date', 'Content-Length']), unnest(['W/"' || left(digest, 8) || '"', (t + 100000)::VARCHAR, '0']) FROM capture
  UNION ALL SELECT page_id * 4 + 2, unnest(['etag', 'Cache-Control']), unnest([CASE WHEN page_id % 7 = 0 THEN '"other"' ELSE 'W/"' || left(digest, 8) || '"' END, 'max-age=60']) FROM capture),
tag AS (SELECT record_id, regexp_replace(trim(value), '^W/', '') AS tag FROM header WHERE lower(name) = 'etag'),
full_response AS (SELECT url_key, t, max(page_id * 4) AS response_id, arg_max(digest, page_id) AS digest FROM capture WHERE url_key IS NOT NULL GROUP BY ALL),
revisit AS (SELECT page_id * 4 + k AS record_id, url_key, t + k * 100000 AS t FROM capture, (VALUES (1), (2)) v(k)),
found AS (SELECT r.record_id, r.url_key, f.response_id, f.digest FROM revisit r ASOF LEFT JOIN full_response f ON r.url_key = f.url_key AND r.t > f.t),
judged AS (SELECT found.*, CASE WHEN response_id IS NULL THEN 'orphan' WHEN a.tag <> b.tag THEN 'changed' WHEN a.tag = b.tag THEN 'resolved' ELSE 'unverified' END AS outcome
  FROM found LEFT JOIN tag a ON a.record_id = found.record_id LEFT JOIN tag b ON b.record_id = response_id),
fresh AS (SELECT j.record_id, name, value FROM judged j JOIN header h ON h.record_id = j.record_id WHERE lower(name) NOT IN {revisits.KEPT}),
whole AS (SELECT * FROM fresh UNION ALL
  SELECT j.record_id, h.name, h.value FROM judged j JOIN header h ON h.record_id = j.response_id
  WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.record_id = j.record_id AND lower(f.name) = lower(h.name))),
texts AS (SELECT record_id, string_agg(lower(name) || ': ' || value, '; ' ORDER BY lower(name) || ': ' || value) AS headers FROM whole GROUP BY ALL)
SELECT record_id, url_key, outcome, response_id, CASE WHEN outcome IN ('resolved', 'unverified') THEN texts.headers END AS headers,
  CASE WHEN outcome IN ('resolved', 'unverified') THEN digest END AS payload_digest
FROM judged LEFT JOIN texts USING (record_id)"""


def jumps(shards: int) -> str:
    return f"""WITH RECURSIVE {CRC_TABLE},
body AS (SELECT doc_id, coalesce(doc_id, -1) AS k, octet_length(encode(coalesce(text, ''))) AS size, {crc32("coalesce(text, '')")} AS text_crc32 FROM documents, crc_table),
jump AS (SELECT k, (CASE WHEN k < 0 THEN k::HUGEINT + 18446744073709551616 ELSE k::HUGEINT END)::UHUGEINT AS state, 0::BIGINT AS j FROM (SELECT DISTINCT k FROM body) UNION ALL
  SELECT k, s, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((s // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT k, (state * {jump_shard.MULTIPLIER} + 1) % 18446744073709551616 AS s, j FROM jump WHERE j <= {shards})),
place AS (SELECT k, max(j) FILTER (j < {shards})::INT AS shard, max(j) FILTER (j <= {shards})::INT AS grown_shard FROM jump GROUP BY k),
placed AS (SELECT *, ((xor(k, text_crc32) & 4294967295)::HUGEINT * {jump_shard.MULTIPLIER % (1 << 32)} + 1) % 4294967296 // {(1 << 32) // jump_shard.BLOCKS} AS block FROM body JOIN place USING (k))
SELECT doc_id, (size + 8)::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY block, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM placed"""


def _java(pattern: str) -> str:
    return pattern.replace("'", "''")


def _tagged(text: str) -> str:
    d = template_decontam
    # without lookbehind, a name whose predecessor was consumed is found in a second pass
    name = f"regexp_replace({{}}, '([\\p{{{{L}}}}\\p{{{{N}}}},;:] )(\\p{{{{Lu}}}}\\p{{{{L}}}}+)', '\\1{d.NAME}\\2', 'g')"
    out = name.format(name.format(f"regexp_replace({text}, '[{d.NAME}-{d.UNIT}]', ' ', 'g')"))
    out = f"regexp_replace({out}, '{_java(d.NUMBER_AT)}', ' {d.NUMBER}\\1 ', 'g')"
    return f"regexp_replace({out}, '{_java(d.UNIT_AT.replace(' ?)(', ' *)('))}', '\\1 {d.UNIT}\\2\\3', 'g')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}{template_decontam.NAME}{template_decontam.NUMBER}{template_decontam.UNIT}]+'), lambda w: w <> '')"


def _values(text: str) -> str:
    once = "regexp_replace({}, '(\\p{{N}})[.,:](\\p{{N}})', '\\1\\2', 'g')"
    return _words(once.format(once.format(_tagged(text))))


def _canonical(text: str) -> str:
    d = template_decontam
    return _words(f"regexp_replace({_tagged(text)}, '([{d.NAME}{d.UNIT}])\\p{{L}}+|({d.NUMBER})\\p{{N}}[\\p{{N}}.,:]*', '\\1\\2', 'g')")


_SLOT = f"left(r[1], 1) IN ('{template_decontam.NAME}', '{template_decontam.NUMBER}', '{template_decontam.UNIT}')"
TEMPLATES = f"""WITH doc AS (SELECT doc_id, {_canonical('text')} AS dw, {_values('text')} AS dv FROM documents WHERE text IS NOT NULL),
item AS (SELECT item_id, {_canonical('text')} AS iw, {_values('text')} AS iv FROM benchmark WHERE text IS NOT NULL),
item_window AS (SELECT item_id, unnest(range(len(iw) - {template_decontam.WINDOW - 1})) AS place, iw FROM item),
item_hash AS (SELECT item_id, place, iw[place + 1 : place + {template_decontam.WINDOW}] AS w FROM item_window),
doc_window AS (SELECT doc_id, unnest(range(len(dw) - {template_decontam.WINDOW - 1})) AS place, dw FROM doc),
doc_hash AS (SELECT doc_id, place, dw[place + 1 : place + {template_decontam.WINDOW}] AS w FROM doc_window),
hit AS (SELECT DISTINCT doc_id, item_id, d.place - i.place AS shift FROM doc_hash d
  JOIN (SELECT * FROM item_hash WHERE len(list_filter(w, lambda x: left(x, 1) NOT IN ('{template_decontam.NAME}', '{template_decontam.NUMBER}', '{template_decontam.UNIT}'))) >= {template_decontam.LITERALS}) i ON d.w = i.w),
spot AS (SELECT *, greatest(0, -shift) AS i0, greatest(0, shift) AS d0, least(len(iw) - greatest(0, -shift), len(dw) - greatest(0, shift)) AS n FROM hit JOIN doc USING (doc_id) JOIN item USING (item_id)),
pairs AS (SELECT doc_id, item_id, d0 AS place, len(iw) AS n_words,
  list_filter(list_zip(iw[i0 + 1 : i0 + n], dw[d0 + 1 : d0 + n], iv[i0 + 1 : i0 + n], dv[d0 + 1 : d0 + n]), lambda r: r[1] = r[2]) AS rows FROM spot WHERE n > 0),
slots AS (SELECT doc_id, item_id, place, n_words, len(rows) AS n_equal,
  list_distinct(list_transform(list_filter(rows, lambda r: {_SLOT}), lambda r: {{'x': r[3], 'y': r[4]}})) AS s FROM pairs),
good AS (SELECT doc_id, item_id, place, n_words, n_equal, len(list_filter(s, lambda p: p.x <> p.y)) AS n_changed FROM slots
  WHERE n_equal >= least({template_decontam.RUN}, n_words) AND n_equal >= n_words * {template_decontam.SHARE}
    AND len(s) = len(list_distinct(list_transform(s, lambda p: p.x))) AND len(s) = len(list_distinct(list_transform(s, lambda p: p.y))))
SELECT doc_id, item_id, place::INT AS "at", n_words::INT AS n_words, n_equal::INT AS n_equal, n_changed::INT AS n_changed FROM good
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_changed, place) = 1"""

JACCARD = f"""WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(greatest(len(w) - {chosen_path.WORDS - 1}, least(len(w), 1)))) AS i FROM word),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + {chosen_path.WORDS}], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY ALL),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c >= {chosen_path.THRESHOLD} * (a.n + b.n - c) - 1e-9),
paired AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM paired UNION SELECT r.x, b.y FROM reach r JOIN paired b ON r.y = b.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY ALL),
degree AS (SELECT x, count(*) AS n FROM paired GROUP BY ALL)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, coalesce(degree.n, 0) AS n_links, least(d.doc_id, coalesce(low.y, d.doc_id)) AS class_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN degree ON degree.x = d.doc_id LEFT JOIN low ON low.x = d.doc_id"""

COSINE = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {lattice.THRESHOLD}),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY ALL),
degree AS (SELECT x, count(*) AS n FROM link GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, least(vec_id, coalesce(low.y, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN degree ON degree.x = vec_id LEFT JOIN low ON low.x = vec_id"""

NEGATIVES = f"""WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({residue_mining.SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % {residue_mining.EVERY} = 0),
positive AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE own = label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {residue_mining.POSITIVES}),
ranked AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  WHERE {residue_mining.LOW} * positive_score <= 100 * score AND 100 * score <= {residue_mining.HIGH} * positive_score)
SELECT * FROM ranked WHERE rank <= {residue_mining.NEGATIVES}"""

ORACLES = {
    "op1_revisit_resolution": REVISITS,
    "op2_jump_shards": jumps(24),
    "op7_template_decontamination": TEMPLATES,
    "op8_chosen_path_join": JACCARD,
    "op9_lattice_neighbours": COSINE,
    "op11_residue_negatives": NEGATIVES,
}
