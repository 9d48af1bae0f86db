"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from quire.llm import mixing, rules, shards

_SHARD = """
list_reduce(list_transform(range({n}), lambda i: {{'u': (('0x' || substr(md5(k || '|' || i), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0, 'i': i}}),
  lambda a, b: CASE WHEN -1.0 / ln(b.u) > -1.0 / ln(a.u) THEN b ELSE a END).i::INT
"""

SHARDS = f"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, encode(coalesce(text, '')) AS b FROM documents),
c AS (SELECT doc_id, k, octet_length(b)::BIGINT + 1 AS size,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, tab),
s AS (SELECT *, {_SHARD.format(n=8)} AS shard, {_SHARD.format(n=9)} AS grown_shard, substr(md5(k), 1, {shards.BUCKET_DIGITS}) AS bucket FROM c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM s
"""

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _verdict() -> str:
    by_name = {
        "n_words": "n_words",
        "mean_word_chars": "coalesce(word_chars / nullif(n_words, 0), 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0), 0)",
        "stop_word_ratio": "coalesce(n_stop_words / nullif(n_words, 0), 0)",
        "shout_ratio": "coalesce(n_shouted / nullif(n_words, 0), 0)",
        "bang_ratio": "coalesce(n_bangs / nullif(n_words, 0), 0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0), 0)",
        "repeat_word_ratio": "coalesce(n_repeat_words / nullif(n_words, 0), 0)",
    }
    tests = []
    for name, low, high, least in rules.RULES:
        few = f"n_words < {least} OR " if least else ""
        tests += [f"({few}{by_name[name]} >= {low})"] if low is not None else []
        tests += [f"({few}{by_name[name]} <= {high})"] if high is not None else []
    return " AND ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))

#: Figures of each row of a table with text; n is the row's number in it.
FIGURES = """
d{p} AS (SELECT row_number() OVER () AS n, * FROM {table}),
w{p} AS (SELECT n, coalesce(text, '') AS b, """ + _WORDS.format("coalesce(text, '')") + """ AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d{p}),
u{p} AS (SELECT n, unnest(list_transform(range(1, len(ws) - 3), lambda i: {{'i': i, 'g': concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4])}})) AS x FROM w{p} WHERE len(ws) >= 5),
v{p} AS (SELECT n, x.i AS i, count(*) OVER (PARTITION BY n, x.g) AS times FROM u{p}),
r{p} AS (SELECT n, count(DISTINCT place) AS covered FROM (SELECT n, unnest(range(i, i + 5)) AS place FROM v{p} WHERE times > 1) GROUP BY n),
f{p} AS (SELECT w{p}.n, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(b, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: x IN (""" + _STOP + """)))::BIGINT AS n_stop_words, len(regexp_extract_all(b, '\\p{{Lu}}{{2,}}'))::BIGINT AS n_shouted,
  len(regexp_extract_all(b, '!'))::BIGINT AS n_bangs FROM w{p} LEFT JOIN r{p} ON w{p}.n = r{p}.n),
g{p} AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f{p}),
q{p} AS (SELECT d{p}.*, g{p}.* EXCLUDE (n), NOT base_failed AND """ + _verdict() + """ AS kept FROM d{p} JOIN g{p} ON d{p}.n = g{p}.n)
"""

RULES = "WITH" + FIGURES.format(p="0", table="documents") + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_shouted, n_bangs, base_failed, kept FROM q0"

#: Remaining lines of each row of a table with doc_id and text.
REST = """
s{p} AS (SELECT *, string_split(coalesce(text, ''), chr(10)) AS sl FROM {table}),
t{p} AS (SELECT doc_id, md5(coalesce(text, '')) AS ver, sl, unnest(range(1, len(sl) - 1)) AS i FROM s{p} WHERE len(sl) >= 3),
o{p} AS (SELECT doc_id, ver, i, min({{'a': doc_id, 'b': ver, 'c': i}}) OVER (PARTITION BY sl[i], sl[i + 1], sl[i + 2]) AS first FROM t{p}),
m{p} AS (SELECT doc_id, ver, list_distinct(flatten(list(range(i, i + 3)))) AS gone FROM o{p} WHERE {{'a': doc_id, 'b': ver, 'c': i}} <> first GROUP BY doc_id, ver),
x{p} AS (SELECT s{p}.*, len(sl)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(sl) + 1), lambda j: NOT list_contains(gone, j)), lambda j: sl[j]), chr(10)), '') END AS rest
  FROM s{p} LEFT JOIN m{p} ON s{p}.doc_id IS NOT DISTINCT FROM m{p}.doc_id AND md5(coalesce(text, '')) = m{p}.ver)
"""

LINES = "WITH" + REST.format(p="0", table="documents") + "SELECT doc_id, n_lines, n_removed, rest AS text FROM x0"

MIXTURE = f"""
WITH d AS (SELECT doc_id, source, coalesce('=' || source, 'null') AS s, substr(md5('block|' || coalesce(doc_id::VARCHAR, 'null')), 1, {mixing.BLOCK_DIGITS}) AS block,
  len({_WORDS.format("coalesce(text, '')")})::BIGINT AS tokens, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
b AS (SELECT s, block, sum(tokens)::BIGINT AS bt FROM d GROUP BY ALL),
t AS (SELECT s, sum(bt)::BIGINT AS tt FROM b GROUP BY s),
e AS (SELECT max(tt)::DOUBLE AS top, min(tt) FILTER (tt > 0)::DOUBLE AS least FROM t),
a AS (SELECT coalesce(min(g.k), {mixing.GRID}) / {mixing.GRID}.0::DOUBLE AS alpha FROM range({mixing.GRID + 1}) g(k), e WHERE pow(top / least, 1 - g.k / {mixing.GRID}.0::DOUBLE) <= 2.0),
g AS (SELECT s, tt, CASE WHEN tt > 0 THEN greatest(tt, floor(top * pow(tt / top, alpha))::BIGINT) ELSE 0 END AS budget FROM t, e, a),
p AS (SELECT s, CASE WHEN tt > 0 THEN budget // tt ELSE 1 END AS passes, CASE WHEN tt > 0 THEN budget % tt ELSE 0 END AS rest FROM g),
o AS (SELECT b.s, block, passes, rest, bt, sum(bt) OVER (PARTITION BY b.s ORDER BY md5('turn|' || passes || '|' || b.s || '|' || block), block) AS fin FROM b JOIN p ON b.s = p.s),
c AS (SELECT s, block, passes, CASE WHEN rest <= 0 THEN 'none' WHEN fin <= rest THEN 'all' WHEN fin - bt < rest THEN 'cut' ELSE 'none' END AS take, rest - (fin - bt) AS room FROM o),
x AS (SELECT d.*, passes, take, room, sum(tokens) OVER (PARTITION BY d.s, d.block ORDER BY md5('row|' || passes || '|' || k), k, tokens RANGE UNBOUNDED PRECEDING) AS run FROM d JOIN c ON d.s = c.s AND d.block = c.block),
y AS (SELECT *, unnest(range(passes + CASE WHEN take = 'all' OR (take = 'cut' AND run <= room) THEN 1 ELSE 0 END)) AS pass FROM x)
SELECT doc_id, source, tokens, pass::BIGINT AS pass, block, md5('turn|' || pass || '|' || s || '|' || block) AS block_turn, md5('row|' || pass || '|' || k) AS order_key FROM y
"""

# How often hide() breaks up a mark, without looking around: each mark, or one broken up before, as a whole.
_SITES = r"\[\\*(?:INST\]|/INST\]|SYS\]|/SYS\]|TURN\]|SAYS\]|/TURN\])|<\\*(?:s>|/s>)"

CHATS = f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, v.turn, v.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
o AS (SELECT *, row_number() OVER w AS j, lag(role) OVER w AS before, lead(role) OVER w AS after FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
l AS (SELECT *, CASE
    WHEN role = 'system' AND before IS NULL THEN length('<s>[SYS]  [/SYS]')
    WHEN role = 'user' AND before = 'system' AND j = 2 THEN length('[INST]  [/INST]')
    WHEN role = 'user' AND (before IS NULL OR before NOT IN ('system', 'user')) THEN length('<s>[INST]  [/INST]')
    WHEN role = 'assistant' AND before = 'user' THEN length(' </s>') END AS room FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY j)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY j) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + len(regexp_extract_all(text, '{_SITES}')) + coalesce(room, length('[TURN][SAYS][/TURN]') + length(role) + len(regexp_extract_all(role, '{_SITES}'))))::BIGINT AS formatted_chars,
  bool_and(room IS NOT NULL) AND arg_max(role, j) = 'assistant' AS valid
FROM l GROUP BY conv_id
"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    """Every round as plain nearest centroids, which the search has to equal."""
    ctes = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || vec_id) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min(struct_pack(d := d, c := c)) AS b FROM (SELECT r, c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            ctes += [
                f"s{i} AS (SELECT b.c AS c, j, sum(y) AS s, count(*) AS n FROM (SELECT b, unnest(x) AS y, unnest(range(64)) AS j FROM a{i} JOIN v USING (r)) GROUP BY b.c, j)",
                f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY c)",
                f"c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c)",
            ]
    return f"""WITH {", ".join(ctes)}
    SELECT vec_id, b.c::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.c))::BIGINT AS cluster_inertia, (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(c.x, lambda y: y::VARCHAR), ',')) AS centroid_sha256
    FROM a{rounds} JOIN v USING (r) JOIN c{rounds} c ON c.c = b.c"""


def _repairs() -> str:
    """A layer is a list of four strings, cost (9 digits) and edits, so the least string is the cheapest, then ASCII-least, way."""
    far = "repeat('9', 9) || '~'"

    def add(way: str, cost: str, edit: str) -> str:
        return f"CASE WHEN {way} LIKE '%~' THEN {way} ELSE lpad((left({way}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{edit}' END"

    extra = "CASE WHEN x IN ('S', 'U', 'A', 'X') THEN 3 ELSE 0 END"

    def step(state: int) -> str:
        ways = [add(f"l[{state}]", "4", "D")]
        for before, initial, after in ((1, "s", 2), (1, "u", 3), (2, "u", 3), (4, "u", 3), (3, "a", 4)):
            if after == state:
                ways.append(f"CASE WHEN lower(x) = '{initial}' THEN {add(f'l[{before}]', extra, 'K')} ELSE {far} END")
        for before, after in ((1, 3), (2, 3), (4, 3), (3, 4)):
            if after == state:
                ways.append(f"CASE WHEN x <> 'd' THEN {add(f'l[{before}]', '3 + ' + extra, 'R')} ELSE {far} END")
        return f"least({', '.join(ways)})"

    inserted = f"list_transform([list_transform([l], lambda l: [l[1], l[2], least(l[3], {add('l[1]', '3', 'I')}, {add('l[2]', '3', 'I')}, {add('l[4]', '3', 'I')}), l[4]])[1]], lambda l: [l[1], l[2], l[3], least(l[4], {add('l[3]', '3', 'I')})])[1]"
    layer = f"list_transform([[{', '.join(step(s) for s in (1, 2, 3, 4))}]], lambda l: {inserted})[1]"
    start = f"list_transform([[repeat('0', 9), {far}, {far}, {far}]], lambda l: {inserted})[1]"
    return f"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
p AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM p WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS j, left(role, 1) AS ini FROM d),
f AS (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY j) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM o),
g AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 'd' ELSE CASE WHEN ini IN ('s', 'u', 'a') THEN CASE WHEN fault = 3 THEN upper(ini) ELSE ini END WHEN fault = 3 THEN 'X' ELSE 'x' END END AS x FROM f),
h AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, list(x ORDER BY j) AS signs FROM g GROUP BY conv_id),
q AS (SELECT DISTINCT signs FROM h),
l AS (SELECT signs, list_reduce(list_transform(signs, lambda s: [s]), lambda l, y: list_transform([y[1]], lambda x: {layer})[1], {start}) AS l FROM q),
b AS (SELECT signs, least(l[1], l[4]) AS b FROM l),
c AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal, left(b, 9)::BIGINT AS cost, substr(b, 10) AS audit FROM h JOIN b USING (signs)),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(length(audit))) AS k FROM c WHERE audit <> ''),
n AS (SELECT conv_id, edit, k, count(*) FILTER (edit <> 'I') OVER w AS j, count(*) FILTER (edit <> 'D') OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
r AS (SELECT n.*, CASE WHEN edit = 'K' THEN role END AS kept, CASE WHEN edit = 'I' THEN '' ELSE text END AS text FROM n LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM n.conv_id AND o.j = n.j AND edit <> 'I' WHERE edit <> 'D'),
u AS (SELECT *, coalesce(bool_or(place = 1 AND left(kept, 1) = 's') OVER (PARTITION BY conv_id), false)::INT AS led FROM r),
w AS (SELECT conv_id, string_agg(coalesce(kept, CASE WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY k) AS said FROM u GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""


SQL = {"op1_shards": SHARDS, "op3_mixture": MIXTURE, "op5_rules": RULES, "op6_lines": LINES, "op11_chats": CHATS, "op12_clusters": _clusters(), "op13_repair": _repairs()}
