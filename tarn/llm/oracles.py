"""DuckDB SQL for the queries that SQL can express. ``WS`` is the six ASCII white-space characters."""

from __future__ import annotations

WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, {LOW.format(f"trim(line, {WS})")} AS key FROM lines),
often AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.last_doc AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLES = {"op8_line_dedup": OP8, "op10_topk": OP10}


def _op6() -> str:
    """The quality query: counts by lists, then the concentration steps as common table expressions; a group's estimate stands still once its determinant falls no more."""
    from . import quality as q

    d = q.D
    word = r"[^\x20\x09-\x0D]"
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    share = lambda a, b: f"CAST(round({q.UNIT} * {a} / CAST({b} AS DOUBLE)) AS BIGINT)"
    on = lambda a, b, *more: f"{a}.lang IS NOT DISTINCT FROM {b}.lang AND {a}.source IS NOT DISTINCT FROM {b}.source" + "".join(f" AND {a}.{m} = {b}.{m}" for m in more)
    middle = lambda x: f"list_sort(list({x}))[CAST(ceil(count(*) / 2.0) AS INT)]"
    names = [f"m{i}" for i in range(d)] + [f"s{i}{j}" for i, j in pairs]
    sums = f"CAST(count(*) AS DOUBLE) AS h, {', '.join(f'CAST(sum(f{i}) AS DOUBLE) AS t{i}' for i in range(d))}, {', '.join(f'CAST(sum(f{i} * f{j}) AS DOUBLE) AS q{i}{j}' for i, j in pairs)}"
    moments = f"{', '.join(f't{i} / h AS m{i}' for i in range(d))}, {', '.join(f'{q.CONSISTENCY}::DOUBLE * (q{i}{j} / h - t{i} / h * (t{j} / h)) + {q.FLOOR[i] if i == j else 0.0}::DOUBLE AS s{i}{j}' for i, j in pairs)}"

    def split(name: str, source: str) -> list[str]:
        out, last = [], source
        for j in range(d):
            out.append(f"{name}_{j}d AS (SELECT *, s{j}{j} - ({' + '.join(['0.0::DOUBLE'] + [f'l{j}{k} * l{j}{k} * g{k}' for k in range(j)])}) AS g{j} FROM {last})")
            more = "".join(f", (s{i}{j} - ({' + '.join(['0.0::DOUBLE'] + [f'l{i}{k} * l{j}{k} * g{k}' for k in range(j)])})) / g{j} AS l{i}{j}" for i in range(j + 1, d))
            last = f"{name}_{j}" if j == d - 1 else f"{name}_{j}l"
            out.append(f"{last} AS (SELECT *{more} FROM {name}_{j}d)")
        return out

    def distances(name: str, estimate: str) -> str:
        rows = f"(SELECT x.*, start, {', '.join(f'm{i}' for i in range(d))}, {', '.join(f'g{i}' for i in range(d))}, {', '.join(f'l{i}{j}' for i, j in pairs if i != j)} FROM x JOIN {estimate} p ON {on('x', 'p')})"
        for i in range(d):
            rows = f"(SELECT *, f{i} - m{i} - ({' + '.join(['0.0::DOUBLE'] + [f'l{i}{k} * y{k}' for k in range(i)])}) AS y{i} FROM {rows})"
        return f"{name} AS MATERIALIZED (SELECT doc_id, lang, source, start, f0, f1, f2, f3, {' + '.join(['0.0::DOUBLE'] + [f'y{i} * y{i} / g{i}' for i in range(d)])} AS d2 FROM {rows})"

    parts = [
        rf"w AS MATERIALIZED (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM documents)",
        "g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))",
        "r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) > 1 AS again FROM g)",
        "c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE again) GROUP BY doc_id)",
        "base AS (SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id)",
        f"judged AS MATERIALIZED (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)",
        f"x AS MATERIALIZED (SELECT doc_id, lang, source, CAST(round(256 * ln(word_chars / CAST(n_words AS DOUBLE))) AS BIGINT) AS f0, CAST(round(256 * ln(1 + 100.0 * n_symbols / CAST(n_words AS DOUBLE))) AS BIGINT) AS f1, {share('n_dup_lines', 'n_lines')} AS f2, {share('n_repeat_words', 'n_words')} AS f3 FROM judged WHERE NOT base_failed)",
        f"med AS (SELECT lang, source, {', '.join(f'{middle(f"f{i}")} AS m{i}' for i in range(d))} FROM x GROUP BY lang, source)",
        f"mad AS (SELECT x.lang, x.source, {', '.join(f'any_value(m{i}) AS m{i}, {middle(f"abs(f{i} - m{i})")} AS a{i}' for i in range(d))} FROM x JOIN med ON {on('x', 'med')} GROUP BY x.lang, x.source)",
        "e0 AS MATERIALIZED (SELECT lang, source, 0 AS start, 'inf'::DOUBLE AS det, "
        + ", ".join(f"CAST(m{i} AS DOUBLE) AS m{i}" for i in range(d))
        + ", "
        + ", ".join(f"greatest((1.4826 * a{i}) * (1.4826 * a{i}), {q.FLOOR[i]!r}::DOUBLE) AS s{i}{j}" if i == j else f"CAST(0 AS DOUBLE) AS s{i}{j}" for i, j in pairs)
        + f" FROM mad UNION ALL SELECT lang, source, 1, 'inf'::DOUBLE, {moments} FROM (SELECT lang, source, {sums} FROM x GROUP BY lang, source))",
    ]
    for step in range(q.STEPS):
        parts += split(f"p{step}", f"e{step}")
        parts += [
            distances(f"z{step}", f"p{step}_{d - 1}"),
            f"b{step} AS MATERIALIZED (SELECT *, floor({q.BINS} * log2(1 + d2)) AS bin FROM z{step})",
            f"h{step} AS (SELECT lang, source, start, bin, count(*) AS n FROM b{step} GROUP BY ALL)",
            f"k{step} AS (SELECT lang, source, start, min(bin) AS cut FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, start ORDER BY bin) >= {q.SHARE} * sum(n) OVER (PARTITION BY lang, source, start) AS ok FROM h{step}) WHERE ok GROUP BY lang, source, start)",
            f"n{step} AS MATERIALIZED (SELECT lang, source, start, {moments} FROM (SELECT b.lang, b.source, b.start, {sums} FROM b{step} b JOIN k{step} k ON {on('b', 'k', 'start')} AND bin <= cut GROUP BY b.lang, b.source, b.start))",
            *split(f"o{step}", f"n{step}"),
            f"f{step} AS (SELECT *, {' * '.join(f'g{i}' for i in range(d))} AS det FROM o{step}_{d - 1})",
            f"e{step + 1} AS MATERIALIZED (SELECT e.lang, e.source, e.start, {', '.join(f'CASE WHEN f.det < e.det * (1 - 1 / {q.FALL!r}::DOUBLE) THEN f.{c} ELSE e.{c} END AS {c}' for c in ('det', *names))} FROM e{step} e JOIN f{step} f ON {on('e', 'f', 'start')})",
        ]
    parts.append(f"best AS (SELECT * FROM e{q.STEPS} QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY det, start) = 1)")
    parts += [*split("last", "best"), distances("z", f"last_{d - 1}")]
    return "WITH " + ",\n".join(parts) + f"\nSELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND d2 <= {q.CUT} AS kept FROM judged j LEFT JOIN z ON j.doc_id = z.doc_id"


ORACLES["op6_quality"] = _op6()

ORACLES["op5_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
l AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) < doc_id AS late FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM l WHERE late),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w WHERE len(w) > 0),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.p) FILTER (WHERE x.p IS NULL) AS text, count(x.p) AS n FROM each e LEFT JOIN gone x ON e.doc_id = x.doc_id AND e.p = x.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

ORACLES["op11_decontamination"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
g AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d JOIN (SELECT DISTINCT n FROM i) ON len(w) >= n)),
hit AS MATERIALIZED (SELECT r, item_id, n, p FROM g JOIN i USING (n, g)),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOW.format("coalesce(text, '')")} AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + 5 * v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON a.lang = x.lang AND a.source = x.source AND b.source = x.item GROUP BY a.lang, a.source, b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""
