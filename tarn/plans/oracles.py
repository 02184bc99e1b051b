"""DuckDB SQL for the registered queries. Helpers build the recurring expressions as text."""

from __future__ import annotations

from .samples import PROFILE

NL = "chr(10)"
WS = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def terms(x: str) -> str:
    apart = rf"regexp_replace(coalesce({x}, ''), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return rf"list_distinct(list_transform(regexp_extract_all({apart}, '([\p{{L}}\p{{N}}_]+)', 1), lambda w: {fold('w')}))"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda w: w <> '')"


def rnd(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def count_tokens(x: str) -> str:
    cjk = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
    return rf"CASE WHEN regexp_matches({x}, '{cjk}') THEN len(regexp_extract_all({strip(x)}, '{cjk}|[A-Za-z0-9_]+|[^\p{{L}}\p{{N}}_\s]')) ELSE len({tokens(x)}) END"


def shortened(x: str, limit: int, one_line: bool = False) -> str:
    c = strip(x)
    c = f"replace({c}, {NL}, ' ')" if one_line else c
    return f"CASE WHEN length({c}) > {limit} THEN left({c}, {limit - 1}) || '…' ELSE {c} END"


def source_or(x: str) -> str:
    return f"coalesce(nullif({strip(f"coalesce({x}, '')")}, ''), 'unknown')"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def normal(x: str) -> str:
    return NORMAL.replace("replace(text, chr(13)", f"replace({x}, chr(13)")


def page_clean(x: str) -> str:
    return strip(rf"regexp_replace(replace(replace({x}, chr(13) || {NL}, {NL}), '-' || {NL}, ''), '\n{{3,}}', {NL} || {NL}, 'g')")


def paragraphs(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({normal(x)}, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> '')"


def path_id(x: str) -> str:
    return f"'doc_' || substr(sha1(lower({x})), 1, 16)"


NORMAL = strip(rf"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || {NL}, {NL}), '-\n', '', 'g'), '[ \t]+\n', {NL}, 'g'), '\n{{3,}}', {NL} || {NL}, 'g')")

TURNS = """
para AS (SELECT 'conv:' || conv_id || ':paragraph:' || turn AS node_id, 'conv:' || conv_id || ':section' AS parent_id, 'conv:' || conv_id AS doc_id,
  'paragraph' AS node_type, CAST(NULL AS VARCHAR) AS title, text, turn AS "order", 2 AS level, conv_id FROM conversations),
ids AS (SELECT DISTINCT conv_id FROM conversations),
sect AS (SELECT 'conv:' || conv_id || ':section' AS node_id, 'conv:' || conv_id AS parent_id, 'conv:' || conv_id AS doc_id, 'section' AS node_type,
  'Conversation ' || conv_id AS title, '' AS text, 0 AS "order", 1 AS level, conv_id FROM ids),
root AS (SELECT 'conv:' || conv_id AS node_id, CAST(NULL AS VARCHAR) AS parent_id, 'conv:' || conv_id AS doc_id, 'document' AS node_type,
  CAST(NULL AS VARCHAR) AS title, '' AS text, 0 AS "order", 0 AS level, conv_id FROM ids),
nodes AS (SELECT * FROM root UNION ALL SELECT * FROM sect UNION ALL SELECT * FROM para),
hyd AS (SELECT conv_id, string_agg(STRIPPED, chr(10) || chr(10) ORDER BY turn) AS whole FROM (SELECT conv_id, turn, STRIPIT AS STRIPPED, text FROM conversations) WHERE STRIPPED <> '' GROUP BY conv_id)
""".replace("STRIPIT", strip("text")).replace("STRIPPED", "s")

BM25 = f"""
toks AS (SELECT doc_id AS seq, {tokens('text')} AS t FROM documents WHERE {strip("coalesce(text, '')")} <> ''),
lens AS (SELECT seq, len(t) AS len FROM toks),
stats AS (SELECT count(*) AS n, avg(len) AS avg_len FROM lens),
post AS (SELECT term, seq, count(*) AS tf FROM (SELECT seq, unnest(t) AS term FROM toks) GROUP BY term, seq),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, stats),
idfs AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raws)
"""


def bm25(queries: str, k: int, fill: bool = False, digits: int = 6) -> str:
    """CTEs up to ``hits(query_id, seq, score, rank)``; scores at six digits, if not told otherwise."""
    base = f"""{BM25},
queries AS ({queries}),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM queries) GROUP BY query_id, term),
scored AS (SELECT query_id, seq, sum(times * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len)))) AS score
  FROM qt JOIN idfs USING (term) JOIN post USING (term) JOIN lens USING (seq), stats GROUP BY query_id, seq)"""
    if fill:
        base += f""",
every AS (SELECT query_id, seq, {rnd(rnd('coalesce(score, 0)', 9), digits)} AS score FROM queries CROSS JOIN lens LEFT JOIN scored USING (query_id, seq))"""
    else:
        base += f""",
every AS (SELECT query_id, seq, {rnd(rnd('score', 9), digits)} AS score FROM scored)"""
    return base + f""",
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM every) WHERE rank <= {k})"""


ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


def l2(where: str, k: int) -> str:
    d = "list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"
    return f"""
pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS seq, {rnd(d, 6)} AS dist FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND {where}),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, seq) AS rank FROM pairs) WHERE rank <= {k})"""


def scaled(x: str, by: str) -> str:
    w = f"OVER (PARTITION BY {by})"
    return f"CASE WHEN max({x}) {w} - min({x}) {w} <= 1e-8 THEN 0.0 ELSE (({x}) - min({x}) {w}) / (max({x}) {w} - min({x}) {w}) END"


LISTED = f"""{bm25(ITEMS, 40, True)},
listed AS (SELECT h.*, rank AS pos, d.text, d.source FROM hits h JOIN documents d ON d.doc_id = h.seq)"""
KEY = fold(strip(rf"regexp_replace(text, '{WS}+', ' ', 'g')"))
DEDUPED = f"""{LISTED},
deduped AS (SELECT query_id, {KEY} AS key, arg_min(seq, pos) AS seq, max(score) AS score, min(pos) AS pos, count(*) AS merged, arg_min(text, pos) AS text, arg_min(source, pos) AS source FROM listed GROUP BY query_id, {KEY})"""


def share(names: tuple[str, ...], cap: float) -> str:
    words = PROFILE.terms(*names)
    return rnd(f"least({cap}, len(list_intersect(st, {strings(words)})) / CAST({max(1, len(words))} AS DOUBLE))", 4)


BOOSTED = f"""{DEDUPED},
termed AS (SELECT d.*, {terms('q.query')} AS qt, {terms('d.source')} AS tt, {terms("d.source || ' ' || d.source || ' ' || d.text")} AS st FROM deduped d JOIN queries q USING (query_id)),
b AS (SELECT query_id, seq, pos, score,
  CASE WHEN len(qt) > 0 AND len(tt) > 0 THEN {rnd('0.15 * (len(list_intersect(qt, tt)) / CAST(len(qt) AS DOUBLE))', 4)} ELSE 0.0 END AS title_boost,
  CAST(0.08 AS DOUBLE) AS type_boost,
  {share(('name', 'summary', 'coverage', 'usage_notes', 'domain_keywords', 'primary_entities'), 0.12)} AS corpus_boost,
  {share(('domain_keywords',), 0.08)} AS keyword_boost,
  {share(('primary_entities',), 0.1)} AS entity_boost,
  CASE WHEN len(list_intersect(qt, st)) = 0 THEN 0.0 - {share(('non_coverage', 'forbidden_questions'), 0.12)} ELSE 0.0 END AS penalty FROM termed),
boosted AS (SELECT *, {rnd('score + title_boost + type_boost + corpus_boost + keyword_boost + entity_boost + penalty', 4)} AS final_score FROM b)"""


def compact(x: str) -> str:
    return fold(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')")


def matched(phrases: list[str], least: int = 1, inside: bool = True) -> str:
    from tarn.operators.profile import compacted, term_list

    out = []
    for p in phrases:
        own = term_list(p)
        hit = f"len(list_intersect(qt, {strings(own)})) >= {max(1, min(least, len(own)))}"
        if inside:
            c = compacted(p).replace("'", "''")
            hit = f"({hit} OR (qc <> '' AND (contains(qc, '{c}') OR contains('{c}', qc))))"
        out.append(f"CASE WHEN {hit} AND len(qt) > 0 THEN '{p}' END")
    return f"list_filter([{', '.join(out)}]::VARCHAR[], lambda x: x IS NOT NULL)"


SCOPED = f"""
q0 AS (SELECT item_id AS query_id, text AS query, {terms(strip('text'))} AS qt, {compact(strip('text'))} AS qc FROM benchmark),
m AS (SELECT *, {matched(PROFILE.domain_keywords)} AS mk, {matched(PROFILE.primary_entities)} AS me, {matched([PROFILE.non_coverage], 2, False)} AS mn, {matched(PROFILE.forbidden_questions)} AS mf,
  len(list_intersect(qt, {strings(PROFILE.terms('name', 'summary', 'coverage', 'usage_notes', 'domain_keywords', 'primary_entities', 'recommended_questions'))})) AS overlap FROM q0),
scoped AS (SELECT *, len(mf) > 0 OR (len(mn) > 0 AND overlap = 0 AND len(mk) = 0 AND len(me) = 0) AS out_of_scope,
  concat_ws('; ', CASE WHEN len(mk) > 0 THEN 'matched domain keywords: ' || array_to_string(mk[1:3], ', ') END, CASE WHEN len(me) > 0 THEN 'matched primary entities: ' || array_to_string(me[1:3], ', ') END,
    CASE WHEN len(mf) > 0 THEN 'matched forbidden topics: ' || array_to_string(mf[1:3], ', ') WHEN len(mn) > 0 THEN 'matched non-coverage topics: ' || array_to_string(mn[1:3], ', ') END) AS reason FROM m)"""


def guided(query: str, terms_list: str) -> str:
    missing = f"list_filter({terms_list}, lambda g: NOT contains({fold(query)}, {fold('g')}))[1:2]"
    return f"CASE WHEN len({missing}) > 0 THEN {strip(query + f''' || ' ' || array_to_string({missing}, ' ')''')} ELSE {query} END"


PROOF = f"""{LISTED},
proof AS (SELECT query_id, pos AS slot, 'part ' || (pos % 2) AS subquery, CAST(seq AS VARCHAR) AS doc_id, 'n' || seq AS node_id, source, {shortened('text', 400)} AS quote, score FROM listed WHERE pos <= 8)"""

NOTHING = "I couldn''t find any relevant information in the available sources to answer your question."
FANIN = f"""{PROOF},
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, node_id, quote ORDER BY subquery, slot) AS n FROM proof) WHERE n = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY subquery, slot) AS at_pos FROM once),
fanned AS (SELECT query_id, (SELECT count(DISTINCT subquery) FROM proof p WHERE p.query_id = placed.query_id) AS n_groups, count(*) AS n_evidence,
  {strip("coalesce(string_agg(CASE WHEN at_pos <= 3 AND trim(quote) <> '' THEN trim(quote) END, ' ' ORDER BY at_pos), '')")} AS raw,
  string_agg(CASE WHEN at_pos <= 5 THEN node_id END, ',' ORDER BY at_pos) AS evidence,
  string_agg(CASE WHEN at_pos <= 5 THEN '- **' || source || '** (doc_id=' || doc_id || '; node_id=' || node_id || ')' || chr(10) || '  > ' || quote END, chr(10) ORDER BY at_pos) AS lines
  FROM placed GROUP BY query_id),
answered AS (SELECT *, CASE WHEN raw = '' THEN '{NOTHING}' ELSE raw END AS answer,
  'Synthesized from ' || n_groups || ' evidence group(s) and ' || n_evidence || ' unique evidence item(s).' AS reasoning_summary,
  least(0.95, 0.25 + 0.12 * n_evidence) AS conf FROM fanned)"""

SNIPS = f"""{LISTED},
snips AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY source, pos) AS at_pos, source, {shortened('text', 600, True)} AS snippet FROM listed WHERE pos <= 10)"""

BREAK = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"

TEXT_TREES = rf"""
files AS (SELECT {path_id("'/corpus/' || source || '/' || doc_id || '.txt'")} AS d, CAST(doc_id AS VARCHAR) AS stem, '1.1 Part ' || lang || chr(10) || chr(10) || text AS text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL AND source IS NOT NULL),
cut AS (SELECT d, string_split_regex(text, '{BREAK}') AS ls FROM files),
lines AS (SELECT d, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM cut),
near AS (SELECT *, {strip('line')} AS s, {strip("coalesce(lag(line) OVER (PARTITION BY d ORDER BY pos), '')")} = '' AS b0, {strip("coalesce(lead(line) OVER (PARTITION BY d ORDER BY pos), '')")} = '' AS b1 FROM lines),
judged AS (SELECT *, s <> '' AND length(s) <= 70 AND NOT regexp_matches(s, '[.!?。！？;；]$') AND (b0 OR b1) AND CASE
  WHEN regexp_matches(s, '^\d+(\.\d+)*\s+') THEN true
  WHEN regexp_matches(s, '[:：]$') THEN b1 AND regexp_matches(s, '^[A-Z][^.!?。！？]{{0,60}}[:：]$')
  WHEN s = upper(s) AND s <> lower(s) THEN length(regexp_replace(s, '\P{{L}}', '', 'g')) >= 3 AND len({tokens('s')}) <= 6
  ELSE regexp_matches(s, '^[A-Z][A-Za-z0-9 /_-]{{0,50}}$') END AS is_head FROM near),
placed AS (SELECT *, max(CASE WHEN is_head THEN pos END) OVER (PARTITION BY d ORDER BY pos) AS head FROM judged),
titles AS (SELECT d, pos AS head, regexp_replace(s, '[:：]+$', '') AS title FROM judged WHERE is_head),
body AS (SELECT d, head, string_agg(line, chr(10) ORDER BY pos) AS body FROM placed WHERE NOT is_head GROUP BY d, head),
cuts AS (SELECT d, head, {paragraphs('body')} AS ps FROM body),
paras AS (SELECT d, head, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS text FROM cuts),
entries AS (SELECT d, head * 2 + 1 AS a, -1 AS b, 'section' AS kind, title, '' AS text, 1 AS level FROM titles
  UNION ALL SELECT d, coalesce(head * 2 + 1, 0), i, 'paragraph', NULL, text, CASE WHEN head IS NULL THEN 1 ELSE 2 END FROM paras),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY a, b) AS o FROM entries)
SELECT n.d || ':' || n.kind || ':' || n.o AS node_id, CASE WHEN n.level = 2 THEN n.d || ':section:' || s.o ELSE n.d || ':document:0' END AS parent_id, n.kind AS node_type, n.title, n.text, CAST(n.o AS INTEGER) AS "order", n.level
FROM numbered n LEFT JOIN numbered s ON n.level = 2 AND s.d = n.d AND s.a = n.a AND s.kind = 'section'
UNION ALL SELECT d || ':document:0', NULL, 'document', stem, {normal('text')}, 0, 0 FROM files"""

MARKDOWN_TREES = rf"""
files AS (SELECT {path_id("'/chats/' || conv_id || '.md'")} AS d, CAST(conv_id AS VARCHAR) AS stem, '# Chat' || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
cut AS (SELECT d, string_split_regex(text, '{BREAK}') AS ls FROM files),
lines AS (SELECT d, generate_subscripts(ls, 1) - 1 AS pos, unnest(ls) AS line FROM cut),
judged AS (SELECT *, {strip('line')} AS s, regexp_matches({strip('line')}, '^#{{1,6}}\s+.*\S') AS is_head FROM lines),
placed AS (SELECT *, max(CASE WHEN is_head THEN pos END) OVER (PARTITION BY d ORDER BY pos) AS head FROM judged),
heads AS (SELECT d, pos, length(regexp_extract(s, '^(#{{1,6}})\s', 1)) AS level, {strip(r"regexp_extract(s, '^#{1,6}\s+(.*)$', 1)")} AS title FROM judged WHERE is_head),
above AS (SELECT h.d, h.pos, h.level, h.title, max(p.pos) AS up FROM heads h LEFT JOIN heads p ON p.d = h.d AND p.pos < h.pos AND p.level < h.level GROUP BY ALL),
chains AS (SELECT d, pos, level, title, up, title AS path FROM above WHERE up IS NULL
  UNION ALL SELECT a.d, a.pos, a.level, a.title, a.up, c.path || ' > ' || a.title FROM above a JOIN chains c ON c.d = a.d AND c.pos = a.up),
body AS (SELECT d, head, string_agg(line, chr(10) ORDER BY pos) AS body FROM placed WHERE NOT is_head GROUP BY d, head),
cuts AS (SELECT d, head, {paragraphs('body')} AS ps FROM body),
paras AS (SELECT d, head, generate_subscripts(ps, 1) - 1 AS i, unnest(ps) AS text FROM cuts),
entries AS (SELECT d, pos * 2 + 1 AS a, -1 AS b, 'section' AS kind, title, '' AS text, level, path, up * 2 + 1 AS pa FROM chains
  UNION ALL SELECT p.d, coalesce(p.head * 2 + 1, 0), i, 'paragraph', NULL, p.text, coalesce(c.level, 0) + 1, coalesce(c.path, ''), p.head * 2 + 1 FROM paras p LEFT JOIN chains c ON c.d = p.d AND c.pos = p.head),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY a, b) AS o FROM entries)
SELECT n.d || ':' || n.kind || ':' || n.o AS node_id, coalesce(n.d || ':section:' || s.o, n.d || ':document:0') AS parent_id, n.kind AS node_type, n.title, n.text, CAST(n.o AS INTEGER) AS "order", CAST(n.level AS INTEGER) AS level, n.path AS section_path
FROM numbered n LEFT JOIN numbered s ON s.d = n.d AND s.a = n.pa AND s.kind = 'section'
UNION ALL SELECT d || ':document:0', NULL, 'document', stem, {normal('text')}, 0, 0, '' FROM files"""

PAGE_TREES = rf"""
pages_of AS (SELECT {path_id("'/books/' || conv_id || '.pdf'")} AS d, CAST(conv_id AS VARCHAR) AS stem, CAST(turn + 1 AS INTEGER) AS page, {page_clean("coalesce(text, '')")} AS clean FROM conversations),
cuts AS (SELECT d, page, {paragraphs('clean')} AS ps FROM pages_of),
entries AS (SELECT d, page, -1 AS b, 'section' AS kind, 'Page ' || page AS title, '' AS text, 1 AS level FROM pages_of
  UNION ALL SELECT d, page, generate_subscripts(ps, 1) - 1, 'paragraph', NULL, unnest(ps), 2 FROM cuts),
numbered AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY page, b) AS o FROM entries)
SELECT n.d || ':' || n.kind || ':' || n.o AS node_id, CASE WHEN n.level = 2 THEN n.d || ':section:' || s.o ELSE n.d || ':document:0' END AS parent_id, n.kind AS node_type, n.title, n.text, CAST(n.o AS INTEGER) AS "order", n.level, n.page
FROM numbered n LEFT JOIN numbered s ON n.level = 2 AND s.d = n.d AND s.page = n.page AND s.kind = 'section'
UNION ALL SELECT d || ':document:0', NULL, 'document', any_value(stem), string_agg(clean, chr(10) || chr(10) ORDER BY page), 0, 0, NULL FROM pages_of GROUP BY d"""


def packing(rows: str, k: int = 10, budget: int = 1800) -> str:
    """CTEs from ``rows(query_id, pos, key, tok)`` to ``packs(query_id, taken, total, n)``; to be put behind WITH RECURSIVE."""
    take = f"(len(taken) = 0 OR total + tok <= {budget}) AND len(taken) < {k} AND NOT list_contains(keys, key)"
    return f"""
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS keys, CAST(0 AS BIGINT) AS total FROM {rows} GROUP BY query_id
  UNION ALL SELECT f.query_id, r.pos, CASE WHEN {take} THEN list_append(taken, r.pos) ELSE taken END, CASE WHEN {take} THEN list_append(keys, key) ELSE keys END, CASE WHEN {take} THEN total + tok ELSE total END
  FROM fold f JOIN {rows} r ON r.query_id = f.query_id AND r.pos = f.pos + 1),
packs AS (SELECT query_id, arg_max(taken, pos) AS taken, arg_max(total, pos) AS total, max(pos) AS n FROM fold GROUP BY query_id)"""


PACKED = f"{LISTED}, rows_in AS (SELECT query_id, pos, '|||' || text AS key, CAST({count_tokens('text')} AS BIGINT) AS tok FROM listed), {packing('rows_in')}"


def hashed(x: str) -> str:
    digests = " || ".join(rf"sha256(encode({x}) || '\x{i:02x}\x00\x00\x00'::BLOB)" for i in range(12))
    return f"({digests})"


HYBRID = f"""{bm25(ITEMS, 40, True, 9)},
dv AS (SELECT doc_id AS seq, list_transform(range(384), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2))::INT AS DOUBLE) / 255.0) AS v FROM (SELECT doc_id, {hashed('text')} AS h FROM documents)),
qv AS (SELECT query_id, list_transform(range(384), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2))::INT AS DOUBLE) / 255.0) AS v FROM (SELECT query_id, {hashed(strip('query'))} AS h FROM queries)),
vd AS (SELECT query_id, seq, {rnd('list_sum(list_transform(list_zip(qv.v, dv.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))', 9)} AS dist FROM qv, dv),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, seq) AS rank FROM vd) WHERE rank <= 40),
vs AS (SELECT query_id, seq, rank AS vr, {scaled('1.0 / (dist + 1e-8)', 'query_id')} AS vector FROM near),
ws AS (SELECT query_id, seq, rank AS br, {scaled('score', 'query_id')} AS bm25 FROM hits),
fused AS (SELECT query_id, seq, vr, br, 0.5 * coalesce(vector, 0.0) + 0.5 * coalesce(bm25, 0.0) AS score FROM vs FULL OUTER JOIN ws USING (query_id, seq)),
listed AS (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY vr NULLS LAST, br) AS pos, d.text, d.source FROM fused f JOIN documents d ON d.doc_id = f.seq),
deduped AS (SELECT query_id, {KEY} AS key, arg_min(seq, pos) AS seq, max(score) AS score, min(pos) AS pos, arg_min(text, pos) AS text, arg_min(source, pos) AS source FROM listed GROUP BY query_id, {KEY}),
termed AS (SELECT d.*, {terms('q.query')} AS qt, {terms("' ' || coalesce(d.source, '') || ' ' || d.text")} AS st FROM deduped d JOIN queries q USING (query_id)),
boosted AS (SELECT *, score + CAST(0.08 AS DOUBLE) + {share(('name', 'summary', 'coverage', 'usage_notes', 'domain_keywords', 'primary_entities'), 0.12)} + {share(('domain_keywords',), 0.08)} + {share(('primary_entities',), 0.1)}
  + CASE WHEN len(list_intersect(qt, st)) = 0 THEN 0.0 - {share(('non_coverage', 'forbidden_questions'), 0.12)} ELSE 0.0 END AS final_score FROM termed),
ordered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {rnd('final_score', 9)} DESC, pos) AS position FROM boosted),
rows_in AS (SELECT query_id, position AS pos, seq || '|' || source || '|' || text AS key, CAST({count_tokens('text')} AS BIGINT) AS tok, seq, final_score FROM ordered),
{packing('rows_in')},
slots AS (SELECT query_id, generate_subscripts(taken, 1) - 1 AS slot, unnest(taken) AS pos, total, n - len(taken) AS dropped FROM packs)
SELECT s.query_id, CAST(slot AS INTEGER) AS slot, seq, {rnd('final_score', 6)} AS final_score, CAST(tok AS INTEGER) AS packed_tokens, total AS total_tokens, CAST(dropped AS INTEGER) AS dropped FROM slots s JOIN rows_in USING (query_id, pos)"""

SENTENCES = rf"""
split AS (SELECT doc_id, source, list_filter(string_split(regexp_replace({strip('text')}, '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM documents WHERE text IS NOT NULL),
fold AS (SELECT doc_id, source, ss, 0 AS i, CAST([] AS VARCHAR[]) AS held, CAST(0 AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS piece FROM split
  UNION ALL SELECT doc_id, source, ss, i + 1,
    CASE WHEN full_now THEN list_append(held[len(held) - keep + 1:], s) ELSE list_append(held, s) END,
    CASE WHEN full_now THEN coalesce(list_sum(list_transform(held[len(held) - keep + 1:], lambda x: length(x))), 0) ELSE total END + len(string_split(s, ' ')),
    CASE WHEN full_now THEN array_to_string(held, '') END
  FROM (SELECT *, coalesce(list_max(list_filter(range(1, len(held) + 1), lambda k: list_sum(list_transform(held[len(held) - k + 1:], lambda x: length(x))) <= 50)), 0) AS keep FROM
    (SELECT *, ss[i + 1] AS s, total + len(string_split(ss[i + 1], ' ')) > 100 AND len(held) > 0 AS full_now FROM fold WHERE i < len(ss)))),
pieces AS (SELECT doc_id, source, i, piece FROM fold WHERE piece IS NOT NULL UNION ALL SELECT doc_id, source, i + 1, array_to_string(held, '') FROM fold WHERE i = len(ss) AND len(held) > 0)
SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk, piece AS text FROM pieces"""

ORACLES: dict[str, str] = {
    "clean_text": rf"SELECT doc_id, {strip(f'''replace(replace(text, '-' || {NL}, ''), {NL}, ' ')''')} AS cleaned FROM documents",
    "normalize_parser_text": f"SELECT doc_id, {NORMAL} AS normalized FROM documents",
    "normalize_pdf_page": rf"SELECT doc_id, {strip(rf'''regexp_replace(replace(replace(text, chr(13) || {NL}, {NL}), '-' || {NL}, ''), '\n{{3,}}', {NL} || {NL}, 'g')''')} AS normalized FROM documents",
    "normalize_dedupe_key": f"SELECT doc_id, {KEY} AS key FROM documents",
    "query_terms_distinct": f"SELECT doc_id, len({terms('text')}) AS n_terms FROM documents",
    "document_key": "SELECT doc_id, sha1('|' || coalesce(source, '') || '||' || coalesce(text, '')) AS key FROM documents",
    "path_doc_id": "SELECT page_id, 'doc_' || substr(sha1(lower(url)), 1, 16) AS id FROM pages",
    "source_basename": rf"SELECT page_id, string_split(replace({strip('url')}, '\', '/'), '/')[-1] AS name, lower(regexp_extract(url, '\.([^.]+)$', 1)) AS suffix FROM pages",
    "token_count_fallback": f"SELECT doc_id, {count_tokens('text')} AS tokens FROM documents",
    "split_paragraphs": rf"WITH c AS (SELECT conv_id, string_agg(text, {NL} || ' ' || {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, list_filter(list_transform(string_split_regex({NORMAL}, '\n\s*\n'), lambda x: {strip('x')}), lambda x: x <> '') AS ps FROM c) SELECT conv_id, generate_subscripts(ps, 1) - 1 AS place, unnest(ps) AS paragraph FROM p",
    "quote_truncation": f"SELECT doc_id, {shortened('text', 400)} AS quote, {shortened('text', 600, True)} AS snippet FROM documents",
    "compact_phrase": f"SELECT item_id, {compact('text')} AS letters FROM benchmark",
    "fake_embedding": f"WITH h AS (SELECT doc_id, {hashed('text')} AS h FROM documents) SELECT doc_id, "
    + ", ".join(f"CAST(('0x' || substr(h, {2 * i + 1}, 2))::INT AS DOUBLE) / 255.0 AS c{i}" for i in (0, 1, 31, 32, 383))
    + ", sha1(array_to_string(list_transform(range(384), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2))::INT AS VARCHAR)), ',')) AS components, CAST(384 AS BIGINT) AS n FROM h",
    "lexical_overlap": f"WITH q AS (SELECT item_id AS query_id, {terms('text')} AS t FROM benchmark), d AS (SELECT doc_id AS seq, unnest({terms('text')}) AS term FROM documents), e AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q), s AS (SELECT query_id, seq, {rnd('count(*) / CAST(any_value(n) AS DOUBLE)', 9)} AS score FROM e JOIN d USING (term) GROUP BY query_id, seq), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank, seq, score FROM s) SELECT * FROM r WHERE rank <= 10",
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, {rnd('idf', 6)} AS idf FROM idfs",
    "bm25_topk": f"WITH {bm25(ITEMS, 10)} SELECT query_id, rank, seq, score FROM hits",
    "bm25_topk_zero_fill": "WITH " + bm25("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'zzzz-nothing'), (2, 'blend'), (3, 'the zzzz-nothing'), (4, '')) AS t(query_id, query)", 5, True) + " SELECT query_id, rank, seq, score FROM hits",
    "structured_topk": f"WITH {TURNS}, n AS (SELECT node_id, unnest({terms('title || chr(32) || whole')}) AS term FROM sect JOIN hyd USING (conv_id)), q AS (SELECT item_id AS query_id, {terms('text')} AS t FROM benchmark), e AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM q), s AS (SELECT query_id, node_id, count(*) / CAST(any_value(e.n) AS DOUBLE) AS score FROM e JOIN n USING (term) GROUP BY query_id, node_id), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank, node_id, {rnd('score', 9)} AS score FROM s) SELECT * FROM r WHERE rank <= 10",
    "vector_topk_l2": f"WITH {l2('true', 10)} SELECT query_id, rank, seq, dist FROM near",
    "vector_topk_filtered": f"WITH {l2('v.label = 1', 10)} SELECT query_id, rank, seq, dist FROM near",
    "vector_minmax": f"WITH {l2('v.vec_id <> q.vec_id', 40)}, s AS (SELECT query_id, seq, 1.0 / (dist + 1e-8) AS sim FROM near) SELECT query_id, seq, {rnd(scaled('sim', 'query_id'), 6)} AS scaled FROM s",
    "vector_threshold": f"WITH {l2('true', 10)} SELECT query_id, seq, dist FROM near WHERE 1.0 / (dist + 1e-8) >= 0.75",
    "pool_mean_embedding": f"WITH e AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) SELECT CAST(label AS BIGINT) AS label, pos, {rnd('avg(CAST(x AS DOUBLE))', 6)} AS mean, count(*) AS children FROM e GROUP BY label, pos",
    "fusion_full_outer": f"WITH {bm25('SELECT item_id AS query_id, text AS query FROM benchmark JOIN embeddings ON vec_id = item_id', 40, True)}, {l2('true', 40).replace('q.vec_id % 50 = 0', 'q.vec_id IN (SELECT item_id FROM benchmark)')}, v AS (SELECT query_id, seq, {scaled('1.0 / (dist + 1e-8)', 'query_id')} AS vector FROM near), w AS (SELECT query_id, seq, {scaled('score', 'query_id')} AS bm25 FROM hits), f AS (SELECT query_id, seq, coalesce(vector, 0.0) AS vector, coalesce(bm25, 0.0) AS bm25 FROM v FULL OUTER JOIN w USING (query_id, seq)) SELECT query_id, seq, {rnd('vector', 6)} AS vector, {rnd('bm25', 6)} AS bm25, {rnd('0.5 * vector + 0.5 * bm25', 6)} AS score FROM f",
    "dedupe_candidates": f"WITH {DEDUPED} SELECT query_id, seq, score, pos AS at, merged FROM deduped".replace("pos AS at", 'pos AS "at"'),
    "profile_boosts": f"WITH {BOOSTED} SELECT query_id, seq, title_boost, type_boost, corpus_boost, keyword_boost, entity_boost, penalty, final_score FROM boosted",
    "rerank_topk": f"WITH {BOOSTED} SELECT query_id, position, seq, final_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS position FROM boosted) WHERE position <= 10",
    "tree_nodes": f'WITH {TURNS} SELECT node_id, parent_id, doc_id, node_type, title, text, CAST("order" AS BIGINT) AS "order", CAST(level AS BIGINT) AS level FROM nodes',
    "tree_children": f"WITH {TURNS} SELECT parent_id, string_agg(node_id, ',' ORDER BY \"order\", node_id) AS children FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id",
    "tree_parent_title": f"WITH {TURNS} SELECT n.node_id, p.title AS parent_title FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.node_id WHERE n.node_type = 'paragraph'",
    "tree_parents": f"WITH {TURNS} SELECT n.node_id, p.node_type AS parent_node_type, CAST(p.level AS BIGINT) AS parent_level FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.node_id",
    "section_paths": f"WITH {TURNS} SELECT node_id, CASE WHEN node_type = 'paragraph' THEN 'Conversation ' || conv_id ELSE '' END AS path FROM nodes",
    "hydrate_text": f"WITH {TURNS} SELECT node_id, coalesce(whole, '') AS text FROM (SELECT * FROM root UNION ALL SELECT * FROM sect) LEFT JOIN hyd USING (conv_id)",
    "tree_token_counts": f"WITH {TURNS}, t AS (SELECT *, {count_tokens('text')} AS c, {strip('text')} <> '' AS is_full FROM para), s AS (SELECT conv_id, sum(c) AS c, bool_or(is_full) AS any_full FROM t GROUP BY conv_id) SELECT node_id, CAST(c AS BIGINT) AS token_count, CAST(CASE WHEN is_full THEN 32 ELSE -1 END AS BIGINT) AS dims FROM t UNION ALL SELECT node_id, CAST(CASE WHEN any_full THEN c ELSE 0 END AS BIGINT), CAST(CASE WHEN any_full THEN 32 ELSE -1 END AS BIGINT) FROM (SELECT * FROM root UNION ALL SELECT * FROM sect) JOIN s USING (conv_id)",
    "sibling_window_merge": f"WITH {TURNS}, k AS (SELECT node_id, parent_id, \"order\" AS o, {strip('text')} AS t, {count_tokens('text')} AS c FROM para WHERE {strip('text')} <> ''), w AS (SELECT p.node_id, string_agg(k.t, chr(10) || chr(10) ORDER BY k.o) AS merged_text, string_agg(k.node_id, ',' ORDER BY k.o) AS merged_ids, CAST(sum(k.c) AS BIGINT) AS merged_tokens, count(*) AS n FROM para p JOIN k ON k.parent_id = p.parent_id AND abs(k.o - p.\"order\") <= 1 GROUP BY p.node_id) SELECT node_id, merged_text, merged_ids, merged_tokens FROM w WHERE n > 1",
    "section_promotion": f"WITH {TURNS}, k AS (SELECT node_id, parent_id, conv_id, \"order\" AS o, {strip('text')} AS t, {count_tokens('text')} AS c FROM para), w AS (SELECT p.node_id, arg_min(k.node_id, k.o) AS first_id, sum(k.c) AS tok, count(*) AS n FROM para p JOIN k ON k.parent_id = p.parent_id AND abs(k.o - p.\"order\") <= 1 AND k.t <> '' GROUP BY p.node_id), s AS (SELECT conv_id, {count_tokens('whole')} AS sc FROM hyd), j AS (SELECT k.*, w.first_id, w.tok, w.n, sc, sc IS NOT NULL AND sc <= greatest(300, 3 * k.c) AS up FROM k LEFT JOIN w USING (node_id) LEFT JOIN s USING (conv_id)) SELECT node_id, CASE WHEN up THEN 'section' WHEN n > 1 THEN 'window' ELSE 'none' END AS expansion, CASE WHEN up THEN parent_id WHEN n > 1 THEN first_id ELSE node_id END AS packed_id, CAST(CASE WHEN up THEN sc WHEN n > 1 THEN tok ELSE c END AS BIGINT) AS packed_tokens FROM j",
    "node_upsert_latest": f"WITH {TURNS} SELECT node_id, doc_id, CASE WHEN o THEN 'newer ' || text ELSE text END AS text, CAST(CASE WHEN o THEN 2 ELSE 0 END AS BIGINT) AS v FROM (SELECT *, conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') AS o FROM nodes)",
    "scope_routing": f"WITH {SCOPED} SELECT query_id, array_to_string(mk, '|') AS matched_keywords, array_to_string(me, '|') AS matched_entities, array_to_string(mn, '|') AS matched_non_coverage, array_to_string(mf, '|') AS matched_forbidden, overlap AS coverage_overlap, out_of_scope, reason, CASE WHEN out_of_scope THEN 'out_of_scope' ELSE 'retrieve' END AS route FROM scoped",
    "plan_prior": f"WITH {SCOPED}, g AS (SELECT *, {strip('query')} AS sq, list_concat(me[1:2], mk[1:2]) AS guide FROM scoped) SELECT query_id, {guided('sq', 'guide')} AS subqueries, CASE WHEN len(me) > 0 THEN 'section|paragraph' ELSE 'section' END AS node_types FROM g",
    "expand_queries": f"WITH {SCOPED}, g AS (SELECT *, {strip('query')} AS sq, {strip('upper(query)')} AS uq, list_concat(me, mk)[1:4] AS guide FROM scoped), b AS (SELECT *, CASE WHEN {fold('sq')} = {fold('uq')} THEN [sq] ELSE [sq, uq] END AS base FROM g), x AS (SELECT query_id, base, list_filter(list_transform(base, lambda s: {guided('s', 'guide')}), lambda s: NOT list_contains(base, s)) AS more FROM b), y AS (SELECT query_id, list_concat(base, more) AS al FROM x), z AS (SELECT query_id, list_filter(al, lambda s, i: list_position(list_transform(al, lambda t: {fold('t')}), {fold('s')}) = i)[1:3] AS out FROM y) SELECT query_id, array_to_string(out, '|') AS queries FROM z",
    "plan_defaults": f"SELECT item_id AS query_id, 'fact' AS intent, {strip('text')} AS subqueries, 'paragraph' AS node_types FROM benchmark",
    "fan_out_questions": "SELECT item_id AS query_id, i AS question_index, CASE i WHEN 0 THEN text WHEN 1 THEN 'second' ELSE 'third' END AS question FROM benchmark, range(3) AS t(i)",
    "history_window": "WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM m WHERE n >= 4 AND turn < last AND role IN ('user', 'assistant')) SELECT * FROM k WHERE recency <= 6",
    "history_transcript": "WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM m WHERE n >= 4 AND turn < last AND role IN ('user', 'assistant')) SELECT conv_id, 'Conversation history:' || chr(10) || string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || text, chr(10) ORDER BY turn) AS transcript FROM k WHERE recency <= 6 GROUP BY conv_id",
    "accumulate_or_reset": "WITH r AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'system') AS last FROM conversations GROUP BY conv_id) SELECT conv_id, turn, text FROM conversations JOIN r USING (conv_id) WHERE last IS NULL OR turn > last",
    "reduce_keys_and_counts": "SELECT conv_id, string_agg(DISTINCT role, ',' ORDER BY role) AS roles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
    "last_assistant_answer": f"SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant' AND {strip('text')} <> ''), 'No answers were generated.') AS answer FROM conversations GROUP BY conv_id",
    "evidence_items": f"WITH {PROOF} SELECT query_id, slot, subquery, doc_id, node_id, source, quote, score FROM proof",
    "fanout_fanin_evidence": f"WITH {FANIN} SELECT query_id, n_groups, n_evidence, answer, reasoning_summary, {rnd('conf', 6)} AS confidence, 'Available evidence is limited to the retrieved passages.' AS limitations, evidence FROM answered",
    "grounded_answer": f"WITH {FANIN} SELECT query_id, answer || chr(10) || chr(10) || '## Reasoning summary' || chr(10) || reasoning_summary || chr(10) || chr(10) || '**Confidence:** ' || CAST(round(conf * 100) AS INT) || '%' || chr(10) || chr(10) || '## Limitations' || chr(10) || 'Available evidence is limited to the retrieved passages.' || chr(10) || chr(10) || '## Evidence' || chr(10) || lines AS markdown FROM answered",
    "citations_grouped": f"WITH {PROOF}, g AS (SELECT query_id, source, string_agg('- Citation (doc_id=' || doc_id || '; node_id=' || node_id || ')' || chr(10) || '  > ' || quote, chr(10) ORDER BY slot) AS b FROM proof GROUP BY query_id, source) SELECT query_id, '## Citations' || chr(10) || string_agg(chr(10) || '### ' || source || chr(10) || '**Section:** Unscoped section' || chr(10) || b, chr(10) ORDER BY source) AS markdown FROM g GROUP BY query_id",
    "retrieval_answer_snippets": f'WITH {SNIPS} SELECT query_id, at_pos AS "at", source, source AS label, snippet FROM snips WHERE at_pos <= 6',
    "retrieval_only_answer": f"WITH {SNIPS}, top AS (SELECT query_id, string_agg('- **' || source || '.txt**: ' || snippet, chr(10) ORDER BY at_pos) AS l FROM snips WHERE at_pos <= 6 GROUP BY query_id), f AS (SELECT query_id, string_agg('- ' || s, chr(10) ORDER BY s) AS f FROM (SELECT DISTINCT query_id, source || '.txt' AS s FROM snips) GROUP BY query_id) SELECT query_id, 'Question: ' || query || chr(10) || chr(10) || 'Offline mode is enabled (or API credentials are missing), so this response is a retrieval-only view of the most relevant excerpts.' || chr(10) || chr(10) || '## Top excerpts' || chr(10) || l || chr(10) || chr(10) || '---' || chr(10) || '**Sources:**' || chr(10) || f AS answer FROM queries JOIN top USING (query_id) JOIN f USING (query_id)",
    "out_of_scope_answer": f"WITH {SCOPED} SELECT query_id, {strip(f'''concat_ws(chr(10), CASE WHEN reason <> '' THEN reason END, chr(10) || '## Current coverage' || chr(10) || '{PROFILE.coverage}')''')} AS markdown FROM scoped",
}

def told(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def asked(task: str) -> str:
    return f"{told(task + chr(10) * 2 + PROFILE.described() + chr(10) * 2 + 'Question: ')} || {strip('text')}"


CALLS = "SELECT conv_id, count(*) AS iterations, CAST(sum(length(text) // 400) AS BIGINT) AS tool_calls FROM conversations GROUP BY conv_id"
ORACLES["search_tool"] = f"WITH RECURSIVE {PACKED}, slots AS (SELECT query_id, unnest(taken) AS pos, total FROM packs) SELECT query_id, 'Passages: ' || count(*) || ', tokens: ' || any_value(total) || chr(10) || chr(10) || string_agg('Source: ' || coalesce(source, 'unknown') || chr(10) || 'Content: ' || text, chr(10) || chr(10) ORDER BY pos) AS content, count(*) AS n_passages, any_value(total) AS total_tokens FROM slots JOIN listed USING (query_id, pos) GROUP BY query_id"
ORACLES["guardrails"] = f"WITH c AS ({CALLS}), a AS ({ORACLES['last_assistant_answer']}) SELECT conv_id, CASE WHEN iterations >= 10 OR tool_calls > 8 THEN 'The search stopped at its limit before an answer was complete.' ELSE answer END AS answer, iterations, tool_calls, iterations >= 10 OR tool_calls > 8 AS stopped FROM a JOIN c USING (conv_id)"
ORACLES["history_summary"] = f"WITH t AS ({ORACLES['history_transcript'].replace('recency <= 6', 'recency <= 20')}), s AS (SELECT conv_id, CAST(sum({count_tokens('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id) SELECT conv_id, tokens, CASE WHEN tokens > 150 AND transcript IS NOT NULL THEN transcript ELSE '' END AS summary, tokens > 150 AND transcript IS NOT NULL AS reset FROM s LEFT JOIN t USING (conv_id)"
ORACLES["task_prompts"] = (
    f"SELECT item_id AS query_id, {asked('Say with one word whether this question needs a search, a direct answer, or lies outside the corpus.')} AS decide, "
    f"{asked('Name the intent, up to three subqueries and the kinds of passages that would answer this question, as JSON.')} AS plan, "
    f"{asked('Write this question anew so that a search finds its answer, in up to three versions.')} AS rewrite FROM benchmark"
)
ORACLES["research_answers"] = (
    f"WITH g AS ({ORACLES['grounded_answer']}), o AS ({ORACLES['out_of_scope_answer']}), r AS ({ORACLES['scope_routing']}) SELECT r.query_id, CASE WHEN out_of_scope THEN 'out_of_scope' WHEN r.query_id % 7 = 3 THEN 'direct_answer' ELSE 'retrieve' END AS route, "
    f"CASE WHEN out_of_scope THEN o.markdown WHEN r.query_id % 7 = 3 THEN 'This question doesn''t need the corpus, and no language model is set up to answer it.' ELSE coalesce(g.markdown, '{NOTHING}') END AS markdown FROM r LEFT JOIN g USING (query_id) LEFT JOIN o USING (query_id)"
)
ORACLES["candidate_counts"] = f"WITH f AS (SELECT query_id, count(*) AS n FROM ({ORACLES['fusion_full_outer']}) GROUP BY query_id), s AS (SELECT query_id, count(*) AS n FROM ({ORACLES['structured_topk']}) GROUP BY query_id) SELECT query_id, coalesce(f.n, 0) + coalesce(s.n, 0) AS raw_candidates, CAST(coalesce(s.n, 0) AS BIGINT) AS structured FROM f FULL OUTER JOIN s USING (query_id)"
ORACLES["debug_top_rows"] = f"WITH {BOOSTED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS position FROM boosted) SELECT query_id, position, seq, 'paragraph' AS node_type, {rnd('score', 4)} AS score, final_score, title_boost, type_boost, corpus_boost, keyword_boost, entity_boost, penalty FROM p WHERE position <= 20"
ORACLES["scorer_rerank"] = f"WITH {BOOSTED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, pos) AS position FROM boosted), h AS (SELECT p.query_id, p.seq, p.position, row_number() OVER (PARTITION BY p.query_id ORDER BY length(d.text) DESC, p.position) AS r FROM p JOIN documents d ON d.doc_id = p.seq WHERE p.position <= 10), a AS (SELECT query_id, seq, r AS position, {rnd('1.0 / r', 4)} AS scorer_boost FROM h UNION ALL SELECT query_id, seq, position, 0.0 FROM p WHERE position > 10) SELECT * FROM a WHERE position <= 20"
ORACLES["loader_kinds"] = r"WITH p AS (SELECT doc_id, '/in.box/' || source || ['.md', '.TXT', '.Pdf', '.png', ''][doc_id % 5 + 1] AS path FROM documents), s AS (SELECT doc_id, lower(regexp_extract(path, '\.([^.]+)$', 1)) AS suffix FROM p) SELECT doc_id, suffix, CASE suffix WHEN 'md' THEN 'text' WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pages' END AS kind FROM s"
ORACLES["profile_lists"] = f"SELECT item_id, array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '[.,]', chr(10), 'g'), chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), '|') AS entries FROM benchmark"
ORACLES["leaf_passages"] = f"WITH {TURNS} SELECT node_id, doc_id, 'Conversation ' || conv_id AS parent_title, text, {strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} = '' AS blank FROM para"
ORACLES["tree_payloads"] = f"WITH {TURNS} SELECT doc_id, doc_id AS root_id, count(*) AS n, string_agg(node_id, ',' ORDER BY \"order\", node_id) AS ids FROM nodes GROUP BY doc_id"
ORACLES["vector_store_search"] = ORACLES["vector_topk_l2"]
ORACLES["vector_join_topk"] = ORACLES["vector_topk_l2"].replace("q.vec_id % 50 = 0", "true")
ORACLES["postings_store_search"] = ORACLES["bm25_pruned_topk"] = ORACLES["bm25_topk"]
ORACLES["node_store_upsert"] = f"WITH {TURNS}, opened AS (SELECT DISTINCT 'conv:' || conv_id AS doc_id FROM conversations WHERE role = 'system') SELECT node_id, parent_id, doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM opened) THEN 'new ' || text ELSE text END AS text, CAST(\"order\" AS BIGINT) AS \"order\" FROM nodes"
ORACLES["incremental_postings"] = ORACLES["bm25_term_stats"]
ORACLES["pack_context"] = f"WITH RECURSIVE {PACKED}, slots AS (SELECT query_id, generate_subscripts(taken, 1) - 1 AS slot, unnest(taken) AS position, total AS total_tokens, n - len(taken) AS dropped FROM packs) SELECT * FROM slots"
ORACLES["text_trees"] = f"WITH {TEXT_TREES}"
ORACLES["markdown_trees"] = f"WITH RECURSIVE {MARKDOWN_TREES}"
ORACLES["page_trees"] = f"WITH {PAGE_TREES}"
ORACLES["hybrid_retrieve"] = f"WITH RECURSIVE {HYBRID}"
ORACLES["sentence_chunks"] = f"WITH RECURSIVE {SENTENCES}"

ROUNDS = f"""qs AS (
  SELECT item_id, 1 AS round, {tokens('text')} AS w FROM benchmark
  UNION ALL SELECT item_id, round + 1, w[1:greatest(1, len(w) // 2)] FROM qs WHERE round < 4),
{bm25("SELECT item_id * 10 + round AS query_id, array_to_string(w, ' ') AS query FROM qs", 5)},
each AS (SELECT query_id // 10 AS item_id, query_id % 10 AS round, seq, rank, min(query_id % 10) OVER (PARTITION BY query_id // 10, seq) = query_id % 10 AS fresh FROM hits),
counted AS (SELECT item_id, round, w, count(seq) AS found, count(seq) FILTER (WHERE fresh) AS fresh FROM qs LEFT JOIN each USING (item_id, round) WHERE len(w) > 0 GROUP BY item_id, round, w),
alive AS (SELECT *, fresh >= 1 AND len(w) >= 8 AS more, coalesce(bool_and(fresh >= 1 AND len(w) >= 8) OVER (PARTITION BY item_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS open FROM counted)"""
ORACLES["research_rounds"] = f"WITH RECURSIVE {ROUNDS} SELECT item_id AS query_id, CAST(round AS BIGINT) AS round, found, fresh AS new, CASE WHEN more THEN array_to_string(w[1:len(w) // 2], ' ') END AS ask, more AND round = 4 AS stopped FROM alive WHERE open"
ORACLES["research_evidence"] = f"WITH RECURSIVE {ROUNDS} SELECT item_id AS query_id, CAST(round AS BIGINT) AS round, rank AS slot, seq, source FROM each JOIN alive USING (item_id, round) JOIN documents ON doc_id = seq WHERE open AND each.fresh"

ORACLES["hydrate_without_ancestors"] = ORACLES["hydrate_text"]
ORACLES["derived_ancestors"] = f"WITH RECURSIVE {TURNS}, up AS (SELECT node_id, parent_id, '' AS ancestors FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.node_id, n.parent_id, CASE WHEN up.ancestors = '' THEN up.node_id ELSE up.ancestors || '>' || up.node_id END FROM nodes n JOIN up ON n.parent_id = up.node_id) SELECT node_id, ancestors, false AS cyclic FROM up"
ORACLES["pooled_sections"] = (
    f"WITH {TURNS}, h AS (SELECT conv_id, {hashed('text')} AS h FROM para WHERE {strip('text')} <> ''), m AS (SELECT conv_id, "
    + ", ".join(f"avg(CAST(('0x' || substr(h, {2 * i + 1}, 2))::INT AS DOUBLE) / 255.0) AS c{i}" for i in (0, 1, 31, 32, 383))
    + " FROM h GROUP BY conv_id) SELECT node_id, "
    + ", ".join(f"{rnd(f'c{i}', 6)} AS c{i}" for i in (0, 1, 31, 32, 383))
    + ", CAST(384 AS BIGINT) AS n FROM (SELECT node_id, conv_id FROM root UNION ALL SELECT node_id, conv_id FROM sect) JOIN m USING (conv_id)"
)

ORACLES["dedupe_two_keys"] = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, role AS k, left({KEY.replace('text', "coalesce(text, '')")}, 4) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
folded AS (SELECT conv_id, 0 AS i, CAST([] AS VARCHAR[]) AS ks, CAST([] AS VARCHAR[]) AS ts, CAST([] AS BIGINT[]) AS ats, CAST(NULL AS BIGINT) AS "at", CAST(NULL AS BIGINT) AS first FROM (SELECT DISTINCT conv_id FROM c)
  UNION ALL SELECT conv_id, i,
    CASE WHEN own THEN list_append(ks, k) ELSE ks END, CASE WHEN own THEN list_append(ts, t) ELSE ts END, CASE WHEN own THEN list_append(ats, turn) ELSE ats END, turn,
    CASE WHEN own THEN turn WHEN by_text THEN ats[list_position(ts, t)] ELSE ats[list_position(ks, k)] END
  FROM (SELECT *, NOT by_text AND NOT list_contains(ks, k) AS own FROM (SELECT f.conv_id, c.i, CAST(c.turn AS BIGINT) AS turn, k, t, ks, ts, ats, coalesce(list_contains(ts, t) AND ks[list_position(ts, t)] <> k, false) AS by_text FROM folded f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)))
SELECT conv_id AS query_id, "at", first FROM folded WHERE i > 0"""

LETTER, SIGNS = r"\p{L}", "[.,;:!?]+$"
BARE = r"""lower(regexp_replace(x, '^["''(\[]+|["'')\]]+$', '', 'g'))"""
LEARNT = f"""toks AS (SELECT list_transform({tokens('text')}, lambda x: {BARE}) AS t FROM documents),
each AS (SELECT unnest(t) AS token, unnest(list_append(t[2:], '')) AS following FROM toks),
named AS (SELECT *, ends_with(token, '.') AS period, CASE WHEN ends_with(token, '.') THEN left(token, length(token) - 1) ELSE token END AS word FROM each),
lettered AS (SELECT * FROM named WHERE regexp_matches(word, '{LETTER}')),
counts AS (SELECT word, count(*) FILTER (WHERE period) AS k1, count(*) FILTER (WHERE NOT period) AS k2 FROM lettered GROUP BY word),
total AS (SELECT CAST(sum(k1 + k2) AS DOUBLE) AS n, CAST(sum(k1) AS DOUBLE) AS p FROM counts),
scored AS (SELECT *, length(replace(word, '.', '')) AS l FROM counts, total),
words AS (SELECT word, k1, k2, n, CASE WHEN k1 > 0 AND p < n THEN -2 * (k1 * ln(p / n) + CASE WHEN k2 > 0 THEN k2 * ln(1 - p / n) ELSE 0 END - k1 * ln(0.99::DOUBLE) - k2 * ln(0.01::DOUBLE)) * exp(-l) * (length(word) - l + 1) * pow(CAST(l AS DOUBLE), -k2) ELSE 0 END AS score FROM scored),
judged AS (SELECT *, score >= 0.3 AS abbreviation FROM words),
over AS (SELECT word, f AS following, count(*) AS b FROM (SELECT word, regexp_replace(following, '{SIGNS}', '', 'g') AS f FROM lettered WHERE period AND following <> '') WHERE regexp_matches(f, '{LETTER}') GROUP BY ALL),
breaks AS (SELECT following, x.k1 + x.k2 AS second, x.n, CAST(sum(b) AS BIGINT) AS b FROM over JOIN judged w ON over.word = w.word JOIN judged x ON x.word = following WHERE NOT w.abbreviation GROUP BY ALL),
starts AS (SELECT *, (SELECT CAST(sum(k1) AS DOUBLE) FROM judged WHERE NOT abbreviation) AS first FROM breaks)"""


def _part(k: str, m: str, p: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END + CASE WHEN {m} > {k} THEN ({m} - {k}) * ln(1 - {p}) ELSE 0 END)"


_RATIO = f"-2 * ({_part('b', 'first', '(second / n)')} + {_part('(second - b)', '(n - first)', '(second / n)')} - {_part('b', 'first', '(b / first)')} - {_part('(second - b)', '(n - first)', '((second - b) / (n - first))')})"
ORACLES["sentence_statistics"] = f"WITH {LEARNT} SELECT word, k1 AS with_period, k2 AS without, {rnd('score', 4)} AS score, abbreviation FROM judged WHERE k1 > 0"
ORACLES["sentence_starters"] = f"WITH {LEARNT} SELECT following AS word, b AS both, {rnd('score', 3)} AS score FROM (SELECT *, {_RATIO} AS score FROM starts) WHERE score >= 30 AND b / first > second / n"
