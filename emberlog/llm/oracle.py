"""DuckDB texts for the queries that SQL can express."""

ORACLE_TEXTS: dict[str, str] = {}

#: Lower-case A-Z only, then words of digits, letters and all characters outside ASCII.
LETTER_WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_TEXTS["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTER_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {LETTER_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
 FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
 FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(l), 0) AS BIGINT) AS n_items,
 sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

SOLID_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_TEXTS["op8_quality_rules"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {SOLID_WORDS} AS w,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
wins AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM wins) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
 CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
 len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS n_echo_words FROM d LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
 CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_length, CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbols,
 CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END AS dup_lines, CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words ELSE 0 END AS repeats,
 CASE WHEN n_words > 0 THEN 1000 * n_echo_words // n_words ELSE 0 END AS echoes FROM m),
v AS (SELECT lang, source, ratio, value AS v FROM b UNPIVOT (value FOR ratio IN (word_length, symbols, dup_lines, repeats, echoes)) WHERE NOT base_failed),
s AS (SELECT lang, source, ratio, (v >> greatest(0, length(bin(v)) - 7)) << greatest(0, length(bin(v)) - 7) AS bucket FROM v),
a AS (SELECT lang, source, ratio, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
bl AS (SELECT lang, ratio, count(*) AS n, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
c AS (SELECT ratio, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM s GROUP BY ALL),
q AS (SELECT a.lang, a.source, a.ratio, CASE WHEN a.n >= 200 THEN a.q1 WHEN bl.n >= 200 THEN bl.q1 ELSE c.q1 END AS q1,
 CASE WHEN a.n >= 200 THEN a.q3 WHEN bl.n >= 200 THEN bl.q3 ELSE c.q3 END AS q3
 FROM a JOIN bl ON a.lang IS NOT DISTINCT FROM bl.lang AND a.ratio = bl.ratio JOIN c ON a.ratio = c.ratio),
f AS (SELECT lang, source, max(CASE WHEN ratio = 'word_length' THEN q1 - 3 * greatest(q3 - q1, 100) END) AS wl,
 max(CASE WHEN ratio = 'word_length' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS wh, max(CASE WHEN ratio = 'symbols' THEN q3 + 3 * greatest(q3 - q1, 200) END) AS sh,
 max(CASE WHEN ratio = 'dup_lines' THEN q3 + 3 * greatest(q3 - q1, 200) END) AS dh, max(CASE WHEN ratio = 'repeats' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS rh,
 max(CASE WHEN ratio = 'echoes' THEN q3 + 3 * greatest(q3 - q1, 100) END) AS eh
 FROM q GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(
 word_length >= wl AND word_length <= wh AND symbols <= sh AND dup_lines <= dh AND repeats <= rh AND echoes <= eh, true) AS kept
FROM b LEFT JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source"""


def _spans(kind: str, rank: int, pattern: str, good: str) -> str:
    """Rows (doc row, rank, kind, start, stop) of one kind: what lies between matches gives their places."""
    size = "list_sum(list_transform({0}, lambda x: length(x)))"
    return f"""SELECT r, {rank} AS rank, '{kind}' AS kind, start, start + length(x) AS stop FROM (
 SELECT r, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST({size.format('s[1:i]')} + coalesce({size.format('m[1:i - 1]')}, 0) AS BIGINT))) AS start
 FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS s FROM d WHERE regexp_matches(t, '{pattern}'))) WHERE {good}"""


def _any_case(words: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_QUOTE = """["'']?"""
_ASSIGN = f"(?:{_any_case('password|passwd|secret|token|api_?key')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}[A-Za-z0-9+/_.=-]+"
_ASSIGN_HEAD = f"^(?:{_any_case('password|passwd|secret|token|api_?key')}){_QUOTE}\\x20*[:=]\\x20*{_QUOTE}"
_SECRET_KINDS = [
    ("assign", _ASSIGN, f"length(regexp_replace(x, '{_ASSIGN_HEAD}', '')) >= 6"), ("access", "AKIA[A-Z0-9]+", "length(x) >= 20"), ("hex", "[0-9a-f]+", "length(x) >= 24"),
    ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "true"), ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "length(x) >= 30"),
    ("hosted_token", "gh[oprsu]_[A-Za-z0-9]+", "length(x) >= 40"), ("chat_token", "xox[abprs]-[A-Za-z0-9-]+", "length(x) >= 15"),
    ("url_login", "[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "length(x) >= 8")]
_ALL_SPANS = " UNION ALL ".join(_spans(k, i, p.replace("[0-9a-f]+", "[0-9a-f]{24,}") if k == "hex" else p, g) for i, (k, p, g) in enumerate(_SECRET_KINDS))

ORACLE_TEXTS["op1_secret_scan"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({_ALL_SPANS}),
l AS (SELECT r, kind, rank, start, kind || ':' || start || ':' || stop AS x FROM s),
g AS (SELECT r, CAST(count(*) FILTER (kind = 'assign') AS BIGINT) AS a, CAST(count(*) FILTER (kind = 'access') AS BIGINT) AS b, CAST(count(*) FILTER (kind = 'hex') AS BIGINT) AS c,
 string_agg(x, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(x, ',' ORDER BY start, rank) AS every FROM l GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN g USING (r)"""


def _license_oracle() -> str:
    from emberlog.llm.license_votes import GAP, GRAM, LEAST_SHARE, NOTICES, PHRASES, SLACK

    rows = [(i, text, label, str(i < len(PHRASES)).lower()) for i, (text, label) in enumerate([*PHRASES, *NOTICES])]
    values = ", ".join(f"({i}, '{text}', '{label}', {phrase})" for i, text, label, phrase in rows)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {LETTER_WORDS.format('text')} AS w FROM documents),
t AS (SELECT template, string_split(text, ' ') AS w, label, phrase FROM (VALUES {values}) v(template, text, label, phrase)),
tg AS (SELECT template, label, phrase, size, words, pos - 1 AS pos, array_to_string(w[pos:pos + size - 1], ' ') AS g FROM (
 SELECT *, unnest(generate_series(1, words - size + 1)) AS pos FROM (SELECT *, len(w) AS words, CASE WHEN phrase THEN len(w) ELSE least({GRAM}, len(w)) END AS size FROM t))),
dg AS (SELECT r, spot - 1 AS spot, size, array_to_string(w[spot:spot + size - 1], ' ') AS g FROM (
 SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS spot FROM d, (SELECT DISTINCT size FROM tg) WHERE len(w) >= size)),
h AS (SELECT * FROM dg JOIN tg USING (size, g)),
v AS (SELECT r, template, label, phrase, size, words, spot - pos AS diagonal, min(spot) AS start, max(spot + size) AS stop FROM h GROUP BY ALL),
o AS (SELECT *, CASE WHEN NOT phrase AND abs(diagonal - lag(diagonal) OVER a) <= {SLACK} AND start - lag(stop) OVER a <= {GAP} THEN 0 ELSE 1 END AS opens
 FROM v WINDOW a AS (PARTITION BY r, template ORDER BY start, diagonal)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY r, template ORDER BY start, diagonal) AS span FROM o),
p AS (SELECT DISTINCT s.r, s.template, s.span, unnest(generate_series(h.pos, h.pos + h.size - 1)) AS p
 FROM s JOIN h ON s.r = h.r AND s.template = h.template AND h.spot - h.pos = s.diagonal),
c AS (SELECT r, template, span, count(*) AS under FROM p GROUP BY ALL),
m AS (SELECT s.r, s.label, s.phrase, s.span, min(s.start) AS start, any_value(c.under) / any_value(s.words) AS share
 FROM s JOIN c USING (r, template, span) GROUP BY s.r, s.template, s.label, s.phrase, s.span),
f AS (SELECT r, count(*) FILTER (phrase) AS n, min(start) FILTER (phrase) AS a, max(start) FILTER (phrase) AS z,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS every, max(CASE WHEN phrase THEN 0.5::DOUBLE ELSE share END) AS score
 FROM m WHERE phrase OR share >= {LEAST_SHARE} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
 coalesce(base, '') AS base_labels, coalesce(every, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score FROM d LEFT JOIN f USING (r)"""


ORACLE_TEXTS["op3_license_scan"] = _license_oracle()

ORACLE_TEXTS["op11_exact_top_k"] = """
WITH d AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, o.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, o.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
 FROM d q JOIN d o ON q.r <> o.r AND len(q.v) = len(o.v) WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5"""

#: CRC-32 of a decimal number, bit by bit.
CRC32 = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
 lambda s, b: list_reduce(generate_series(1, 8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(s, b)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"""

ORACLE_TEXTS["op13_conversation_prefix_trie"] = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
 FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (SELECT c.conv_id, 0 AS own, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
 UNION ALL SELECT conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS total, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
 sha256(CAST(to_json(list([role, text]) OVER w) AS VARCHAR)) AS node FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
path AS (SELECT *, depth = total AS ends FROM p
 UNION ALL SELECT conv_id, 0, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM p) FROM c),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM path),
nodes AS (SELECT node, depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM linked GROUP BY node, depth),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
pairs AS (SELECT DISTINCT a.node AS node, b.node AS below FROM path a JOIN path b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT pairs.node, count(*) FILTER (WHERE children.n IS NULL) AS n_leaves, sum(x.own) AS saved FROM pairs JOIN nodes x ON x.node = below LEFT JOIN children ON children.node = below GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(children.n, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes up ON n.depth > 0 AND up.node = n.above LEFT JOIN children ON children.node = n.node JOIN sums ON sums.node = n.node"""
