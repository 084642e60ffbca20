"""SQL for DuckDB that gives the rows of :mod:`attesta.catalogue`.

Written on its own terms: spans are found by position in folded text, not by regular expressions, and chunks are packed
by a list reduction. What these tables have makes that exact: no leading white space and no runs of it within texts.
"""

from __future__ import annotations

from attesta.schemas import TYPES

WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def est(x: str) -> str:
    return f"(length({x}) * 10 // 36 + 1)"


def fold(x: str) -> str:
    signs = "''‘’‚“”„«»`´–—−"
    return f"lower(translate({squash(x)}, '{signs}', '{chr(34) * 11}---'))"


def fold_edges(x: str) -> str:
    return rf"""regexp_replace(regexp_replace({x}, '^[ ".,;:!?()\[\]-]+', ''), '[ ".,;:!?()\[\]-]+$', '')"""


def checker_edges(x: str) -> str:
    signs = r" \t\"''“”‘’.,;:!?()\[\]"
    return f"regexp_replace(regexp_replace({x}, '^[{signs}]+', ''), '[{signs}]+$', '')"


def sentences(x: str) -> str:
    once = r"regexp_replace({0}, '([.!?\n])([ \t\n\r])', '\1' || chr(1) || '\2', 'g')"
    marked = once.format(once.format(x))
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {trim('s')}), lambda s: s <> '')"


def shout(x: str) -> str:
    return f"translate({x}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def pick(names, k: str) -> str:
    return "list_extract([" + ", ".join(f"'{n}'" for n in names) + f"], {k})"


def cuts(source: str, most: int) -> str:
    """Recursive part names ``cut_rows(doc_id, a, b, k, piece, rest)`` over ``source(doc_id, a, b, s)``."""
    return f"""
cut_rows AS (
  SELECT doc_id, a, b, 0 AS k, CAST(NULL AS VARCHAR) AS piece, s AS rest, greatest(200, CAST(trunc({most}.0 * (length(s)::DOUBLE / {est('s')}::DOUBLE) * 0.9) AS BIGINT)) AS budget FROM {source}
  UNION ALL
  SELECT doc_id, a, b, k + 1, {trim('substr(rest, 1, cut)')}, substr(rest, cut + 1), budget
  FROM (SELECT *, CASE WHEN length(rest) <= budget THEN length(rest)
      WHEN strpos(reverse(translate(substr(rest, budget // 2 + 2, budget - budget // 2), chr(9) || chr(10) || chr(13), '   ')), ' ') > 0
      THEN budget // 2 + (budget - budget // 2) - strpos(reverse(translate(substr(rest, budget // 2 + 2, budget - budget // 2), chr(9) || chr(10) || chr(13), '   ')), ' ') + 1
      ELSE budget END AS cut FROM cut_rows WHERE rest <> '')
)"""


MOST = 1000
DOCS = f"docs AS (SELECT doc_id, text, {trim('text')} AS t FROM documents WHERE {trim('text')} <> '')"
#: docs to ordered units to chunks.
CHUNKS = f"""
{DOCS},
sized AS (SELECT doc_id, t, {est('t')} AS n FROM docs),
paras AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS a FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS p FROM sized)),
sents AS (SELECT doc_id, a, unnest(s) AS s, generate_subscripts(s, 1) AS b FROM (SELECT doc_id, a, {sentences('p')} AS s FROM paras WHERE {est('p')} > {MOST})),
long_sents AS (SELECT doc_id, a, b, s FROM sents WHERE {est('s')} > {MOST}),
{cuts('long_sents', MOST)},
all_units AS (
  SELECT doc_id, a, CAST(0 AS BIGINT) AS b, 0 AS k, p AS u FROM paras WHERE {est('p')} <= {MOST}
  UNION ALL SELECT doc_id, a, b, 0, s FROM sents WHERE {est('s')} <= {MOST}
  UNION ALL SELECT doc_id, a, b, k, piece FROM cut_rows WHERE k > 0),
packed AS (SELECT doc_id, list_reduce(list({{'done': CAST([] AS VARCHAR[]), 'cur': u, 'n': {est('u')}}} ORDER BY a, b, k), lambda x, y:
    CASE WHEN x.n + y.n > {MOST} THEN {{'done': list_append(x.done, x.cur), 'cur': y.cur, 'n': y.n}} ELSE {{'done': x.done, 'cur': x.cur || chr(10) || chr(10) || y.cur, 'n': x.n + y.n}} END) AS r FROM all_units GROUP BY doc_id),
chunks AS (
  SELECT doc_id, 0 AS chunk_no, t AS chunk_text FROM sized WHERE n <= {MOST}
  UNION ALL SELECT doc_id, generate_subscripts(c, 1) - 1, unnest(c) FROM (SELECT packed.doc_id, list_append(r.done, r.cur) AS c FROM packed JOIN sized USING (doc_id) WHERE n > {MOST}))"""
CLAIMS = f"""
{CHUNKS},
said AS (SELECT doc_id, chunk_no, chunk_text, unnest(s) AS fact, generate_subscripts(s, 1) - 1 AS ord FROM (SELECT *, {sentences('chunk_text')} AS s FROM chunks)),
claimed AS (SELECT *, (ord + doc_id + chunk_no) % 6 AS way, {pick(TYPES, '(ord + doc_id + chunk_no) % 7 + 1')} AS type FROM said),
spanned AS (SELECT doc_id, chunk_no, chunk_text, ord, fact, type, CASE way WHEN 5 THEN 'low' ELSE {pick(('high', 'medium'), '(ord + doc_id + chunk_no) % 2 + 1')} END AS confidence,
  CASE way WHEN 0 THEN fact WHEN 1 THEN {shout('fact')} WHEN 2 THEN fact || '.' WHEN 3 THEN 'Zq ' || fact END AS span FROM claimed),
folded AS (SELECT *, {fold('chunk_text')} AS hay, {fold('span')} AS q FROM spanned),
sought AS (SELECT *, CASE WHEN q <> '' AND strpos(hay, q) > 0 THEN q WHEN {fold_edges('q')} <> '' AND strpos(hay, {fold_edges('q')}) > 0 THEN {fold_edges('q')} END AS used FROM folded),
verified AS (SELECT doc_id, chunk_no, ord, fact, type, confidence, span, CASE WHEN used IS NOT NULL THEN substr(replace(chunk_text, chr(10) || chr(10), chr(10)), strpos(hay, used), length(used)) END AS verbatim FROM sought),
judged AS (SELECT *, CASE WHEN span IS NULL THEN 'none' WHEN verbatim IS NULL THEN 'dropped' WHEN verbatim = span THEN 'exact' ELSE 'repaired' END AS status FROM verified)"""
MERGED = rf"""
{CLAIMS},
keyed AS (SELECT *, regexp_replace(lower(fact), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS key FROM judged),
firsts AS (SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY chunk_no, ord) = 1),
merged AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_no, ord) AS id FROM firsts)"""
PLACED = f"""
{MERGED},
whole AS (SELECT merged.*, docs.text, {fold('docs.text')} AS hay, {fold('verbatim')} AS q FROM merged JOIN docs USING (doc_id)),
found AS (SELECT *, CASE WHEN verbatim IS NULL THEN NULL WHEN q <> '' AND strpos(hay, q) > 0 THEN strpos(hay, q) - 1 WHEN {fold_edges('q')} <> '' AND strpos(hay, {fold_edges('q')}) > 0 THEN strpos(hay, {fold_edges('q')}) - 1 END AS spot FROM whole),
placed AS (SELECT doc_id, id, fact, type, confidence, verbatim, text, spot, length(substr(text, 1, spot)) - length(replace(substr(text, 1, spot), chr(10), '')) + 1 AS line,
  CASE WHEN strpos(reverse(substr(text, 1, spot)), chr(10)) > 0 THEN strpos(reverse(substr(text, 1, spot)), chr(10)) ELSE spot + 1 END AS col FROM found)"""
_SUMMARY = "count(*) AS total, count(verbatim) AS verbatim, count(*) - count(verbatim) AS inferred, count(*) FILTER (verbatim IS NULL AND confidence <> 'low') AS failed_citations, count(*) FILTER (verbatim IS NOT NULL AND spot IS NULL) AS unlocated"
SUMMARY = f"{PLACED}, summed AS (SELECT doc_id, {_SUMMARY} FROM placed GROUP BY doc_id)"
GOLD = f"""
{MERGED},
gold_sents AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS gold_no FROM (SELECT doc_id, {sentences('t')} AS s FROM docs)),
gold AS (SELECT doc_id, gold_no, {shout('s')} AS verbatim, {pick(TYPES, 'gold_no % 7 + 1')} AS type FROM gold_sents
  UNION ALL SELECT doc_id, 1000000, benchmark.text, NULL FROM docs JOIN benchmark ON doc_id = item_id * 7),
gold_folded AS (SELECT gold.*, docs.text, {fold('docs.text')} AS hay, {fold('verbatim')} AS q FROM gold JOIN docs USING (doc_id)),
gold_sought AS (SELECT *, CASE WHEN q <> '' AND strpos(hay, q) > 0 THEN q WHEN {fold_edges('q')} <> '' AND strpos(hay, {fold_edges('q')}) > 0 THEN {fold_edges('q')} END AS used FROM gold_folded),
anchors AS (SELECT doc_id, gold_no, type, CASE WHEN used IS NOT NULL THEN substr(text, strpos(hay, used), length(used)) END AS anchor FROM gold_sought)"""
SCORES = f"""
{GOLD},
spans AS (SELECT doc_id, list({{'v': verbatim, 'type': type}} ORDER BY id) FILTER (verbatim IS NOT NULL) AS spans, count(*) AS extracted, count(*) FILTER (verbatim IS NULL AND confidence = 'low') AS inferred, count(*) FILTER (verbatim IS NULL AND confidence <> 'low') AS fabricated FROM merged GROUP BY doc_id),
wanted AS (SELECT doc_id, list({{'anchor': anchor, 'type': type}} ORDER BY gold_no) AS golds FROM anchors GROUP BY doc_id),
steps AS (
  SELECT doc_id, golds, coalesce(spans, []) AS spans, extracted, inferred, fabricated, 0 AS k, CAST([] AS BIGINT[]) AS picked FROM wanted LEFT JOIN spans USING (doc_id)
  UNION ALL
  SELECT doc_id, golds, spans, extracted, inferred, fabricated, k + 1, list_append(picked, CASE WHEN golds[k + 1].anchor IS NULL THEN -2 ELSE coalesce(list_filter(range(1, len(spans) + 1), lambda i: NOT list_contains(picked, i) AND (contains(spans[i].v, golds[k + 1].anchor) OR contains(golds[k + 1].anchor, spans[i].v)))[1], -1) END) FROM steps WHERE k < len(golds)),
scores AS (SELECT doc_id AS "case", CAST(len(golds) AS BIGINT) AS gold, CAST(len(list_filter(picked, lambda i: i > 0)) AS BIGINT) AS matched, CAST(len(list_filter(picked, lambda i: i = -1)) AS BIGINT) AS missed, CAST(len(list_filter(picked, lambda i: i = -2)) AS BIGINT) AS unanchored,
  coalesce(extracted, 0) AS extracted, CAST(len(list_filter(range(1, len(golds) + 1), lambda j: picked[j] > 0 AND coalesce(golds[j].type, '') <> '' AND spans[picked[j]].type <> golds[j].type)) AS BIGINT) AS type_mismatch, coalesce(inferred, 0) AS inferred, coalesce(fabricated, 0) AS fabricated FROM steps WHERE k = len(golds)),
passed AS (SELECT *, missed <= 3 AND unanchored = 0 AS pass FROM scores)"""
FLAWED = f"""
{PLACED},
marked AS (SELECT *, doc_id % 15 AS way, verbatim IS NOT NULL AS cited, min(id) FILTER (verbatim IS NOT NULL) OVER (PARTITION BY doc_id) AS c1, min(id) FILTER (verbatim IS NULL) OVER (PARTITION BY doc_id) AS i1, min(fact) FILTER (id = 1) OVER (PARTITION BY doc_id) AS f1 FROM placed),
flawed AS (SELECT doc_id, CASE WHEN way = 14 AND id = 2 THEN 1 ELSE id END AS id, id - 1 + CASE WHEN cited THEN 0 ELSE 1000000 END AS ord,
  CASE WHEN way = 1 AND id = c1 THEN ' ' WHEN way = 4 AND id = 2 THEN upper(f1) ELSE fact END AS fact, CASE WHEN way = 2 AND id = c1 THEN 'guess' ELSE type END AS type, CASE WHEN way = 3 AND id = c1 THEN 'sure' ELSE confidence END AS confidence, text,
  CASE WHEN way = 5 AND id = i1 THEN fact WHEN id <> c1 THEN verbatim WHEN way = 7 THEN NULL WHEN way = 8 THEN {shout('verbatim')} WHEN way = 9 THEN '"' || verbatim || '"!' WHEN way = 10 THEN 'Zq ' || verbatim ELSE verbatim END AS verbatim, cited,
  CASE WHEN way = 11 AND id = c1 THEN 0 WHEN way = 12 AND id = c1 THEN line + 1000 ELSE line END AS line, CASE WHEN spot IS NULL THEN NULL WHEN way = 13 AND id = c1 THEN col + 1 ELSE col END AS col, spot FROM marked),
classed AS (SELECT *, {squash('text')} AS hay, {squash('verbatim')} AS want, string_split(text, chr(10)) AS lines FROM flawed),
spanned2 AS (SELECT *, CASE WHEN NOT cited OR verbatim IS NULL THEN NULL WHEN contains(hay, want) THEN 'exact' WHEN contains(lower(hay), lower(want)) THEN 'recased' WHEN contains(lower(hay), lower({checker_edges('want')})) THEN 'edge' ELSE 'paraphrase' END AS span_class,
  CASE WHEN NOT cited OR verbatim IS NULL THEN NULL WHEN spot IS NULL THEN 'none' WHEN line < 1 OR col < 1 THEN 'low' WHEN line > len(lines) THEN 'past' ELSE 'read' END AS p1,
  CASE WHEN line <= len(lines) THEN coalesce(list_sum(list_transform(lines[1:line - 1], lambda x: length(x) + 1)), 0) + col - 1 END AS start FROM classed),
checked AS (SELECT *, CASE WHEN p1 IS NULL THEN NULL WHEN p1 <> 'read' THEN p1 WHEN start > length(text) THEN 'past' WHEN starts_with(lower({squash("substr(text, start::BIGINT + 1, length(want) * 3 + 64)")}), lower(want)) THEN 'right' ELSE 'wrong' END AS position_class FROM spanned2)"""

_quote = "'\"' || replace(replace({0}, '\\', '\\\\'), '\"', '\\\"') || '\"'"
_short = "CASE WHEN length(verbatim) <= 70 THEN verbatim ELSE substr(verbatim, 1, 69) || '…' END"
_q70 = _quote.format(f"({_short})")
_fact = "'fact ' || id || ': ' || "
_at = "'line ' || line || ' column ' || col"
_RULES = [
    (0, "problem", f"{trim('fact')} = ''", "'has no text'"),
    (1, "problem", f"type NOT IN ({', '.join(repr(t) for t in TYPES)})", f"'unknown type ' || {_quote.format('type')}"),
    (2, "problem", "confidence NOT IN ('high', 'medium', 'low')", f"'unknown confidence ' || {_quote.format('confidence')}"),
    (4, "problem", "NOT cited AND verbatim IS NOT NULL", "'is listed as inferred, yet quotes a span'"),
    (5, "warning", "NOT cited AND verbatim IS NULL AND confidence <> 'low'", f"'its citation was not verified: no span, at confidence ' || {_quote.format('confidence')}"),
    (6, "problem", "cited AND verbatim IS NULL", "'is listed as cited, yet quotes nothing'"),
    (7, "warning", "span_class = 'recased'", f"'quotes the source in other letter case: ' || {_q70}"),
    (8, "warning", "span_class = 'edge'", f"'quotes the source with other signs at the ends: ' || {_q70}"),
    (9, "problem", "span_class = 'paraphrase'", f"'quotes what the source does not say: ' || {_q70}"),
    (10, "problem", "position_class = 'low'", f"{_at} || ' is no position, as both count from 1'"),
    (11, "problem", "position_class = 'past'", f"{_at} || ' lies behind the end of the source'"),
    (12, "problem", "position_class = 'wrong'", f"{_at} || ' is not where the quoted span starts: ' || {_q70}"),
]
_dups = r"""dups AS (SELECT doc_id, ord, id, first_value(id) OVER (PARTITION BY doc_id, regexp_replace(lower(fact), '[^\p{L}\p{N}]', '', 'g') ORDER BY ord) AS f, row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(fact), '[^\p{L}\p{N}]', '', 'g') ORDER BY ord) AS k FROM flawed)"""
_findings = " UNION ALL ".join([f"SELECT doc_id, {k} AS step, '{kind}' AS kind, {_fact}{message} AS message FROM checked WHERE {test}" for k, kind, test, message in _RULES] + [f"SELECT doc_id, 3, 'problem', {_fact}'says the same as fact ' || f FROM dups WHERE k > 1"])
_names = ("total", "verbatim", "inferred", "failed_citations", "unlocated")
_turn_sents = f"turns AS (SELECT conv_id, turn, unnest(s) AS fact, generate_subscripts(s, 1) - 1 AS k FROM (SELECT conv_id, turn, {sentences(trim('text'))} AS s FROM conversations))"
_first_mark = "CASE " + " ".join(f"WHEN contains(content, '{m}') THEN '{m}'" for m in ("<|think|>", "<|channel>", "<channel|>")) + " END"
_marks = "['', '<|think|>', '<|channel>', '<channel|>']"

_reason = "CASE WHEN way = 7 THEN 'truncated' WHEN way = 8 THEN 'leaked' WHEN way BETWEEN 1 AND 6 THEN 'unparsable' END"

SQL = {
    "q_scan_nonblank": f"WITH {DOCS} SELECT doc_id, length(t) AS n_chars FROM docs",
    "q_token_estimate": f"SELECT doc_id, {est('text')} AS tokens FROM documents",
    "q_squash": f"SELECT doc_id, md5({squash('text')}) AS squashed FROM documents",
    "q_fold": f"SELECT doc_id, md5({fold('text')}) AS folded FROM documents",
    "q_paragraphs": f"SELECT page_id, generate_subscripts(p, 1) - 1 AS n, md5(unnest(p)) AS paragraph FROM (SELECT page_id, list_filter(list_transform(string_split(replace(replace(html, '</p>', chr(13) || chr(10) || chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {trim('x')}), lambda x: x <> '') AS p FROM pages)",
    "q_sentences": f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS n, unnest(s) AS sentence FROM (SELECT doc_id, {sentences(trim('text'))} AS s FROM documents)",
    "q_hard_cuts": rf"WITH RECURSIVE plain AS (SELECT doc_id, 0 AS a, 0 AS b, {trim(r'''regexp_replace(text, '[.!?\n]', '', 'g')''')} AS s FROM documents), full_plain AS (SELECT * FROM plain WHERE s <> ''), {cuts('full_plain', 100)} SELECT doc_id, CAST(k - 1 AS BIGINT) AS n, md5(piece) AS piece FROM cut_rows WHERE k > 0",
    "q_units": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, k) - 1 AS k, md5(u) AS unit, {est('u')} AS tokens FROM all_units",
    "q_chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, md5(chunk_text) AS chunk, {est('chunk_text')} AS tokens FROM chunks",
    "q_chunk_stats": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(*) AS chunks, max({est('chunk_text')}) AS largest FROM chunks GROUP BY doc_id",
    "q_budget_fit": f"WITH RECURSIVE {CHUNKS}, by_doc AS (SELECT doc_id, count(*) AS chunks, max({est('chunk_text')}) AS largest FROM chunks GROUP BY doc_id) SELECT *, 17 + largest + largest // 2 + 512 + largest + 10 AS needed, 17 + largest + largest // 2 + 512 + largest + 10 <= 2500 AS fits FROM by_doc",
    "q_writer_key": r"SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{Nd}]', '', 'g') AS key FROM conversations",
    "q_checker_key": r"SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS key FROM conversations",
    "q_shorten": "SELECT conv_id, turn, CASE WHEN length(text) <= 70 THEN text ELSE substr(text, 1, 69) || '…' END AS short, CASE WHEN turn * 700 < 1000 THEN (turn * 700) || ' ms' ELSE format('{:.1f} s', turn * 700 / 1000.0) END AS took FROM conversations",
    "q_thread": "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS thread FROM conversations GROUP BY conv_id",
    "q_merge": rf"WITH {_turn_sents}, keyed AS (SELECT *, regexp_replace(lower(fact), '[^\p{{L}}\p{{Nd}}]', '', 'g') AS key FROM turns), firsts AS (SELECT * FROM keyed WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY turn, k) = 1) SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS id, turn AS chunk_no, fact FROM firsts",
    "q_guards": f"SELECT conv_id, turn, turn % 3 = 0 AS truncated, {_first_mark} AS leak FROM (SELECT conv_id, turn, {_marks}[conv_id % 4 + 1] || text || {_marks}[turn % 4 + 1] AS content FROM conversations)",
    "q_parse_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "q_parse_replies": f"WITH RECURSIVE {CLAIMS} SELECT doc_id, chunk_no, {_reason} AS reason, CASE WHEN {_reason} IS NULL THEN facts END AS facts FROM (SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, (doc_id + chunk_no) % 11 AS way, count(*) AS facts FROM judged GROUP BY doc_id, chunk_no)",
    "q_dead_letter": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, count(reason) AS rejected, count(*) - count(reason) AS accepted, max(reason) AS reason FROM (SELECT doc_id, {_reason} AS reason FROM (SELECT doc_id, (doc_id + chunk_no) % 11 AS way FROM chunks)) GROUP BY doc_id",
    "q_extract": f"WITH RECURSIVE {SUMMARY} SELECT docs.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _names)}, coalesce(verbatim, 0) AS cited, coalesce(inferred, 0) AS listed FROM docs LEFT JOIN summed USING (doc_id)",
    "q_verify": f"WITH RECURSIVE {CLAIMS} SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, ord, status, verbatim FROM judged",
    "q_verify_counts": f"WITH RECURSIVE {CLAIMS} SELECT doc_id, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status = 'dropped') AS dropped FROM judged GROUP BY doc_id",
    "q_null_matrix": f"WITH RECURSIVE {CLAIMS} SELECT confidence, CASE WHEN verbatim IS NOT NULL THEN 'verified' WHEN confidence <> 'low' THEN 'failed' ELSE 'inference' END AS state, count(*) AS n FROM judged GROUP BY ALL",
    "q_position": f"WITH RECURSIVE {PLACED} SELECT doc_id, id, line, col FROM placed WHERE spot IS NOT NULL",
    "q_cited": f"WITH RECURSIVE {PLACED} SELECT doc_id, id, type, confidence, verbatim, line FROM placed WHERE verbatim IS NOT NULL",
    "q_inferred": f"WITH RECURSIVE {PLACED} SELECT doc_id, id, fact, type, confidence FROM placed WHERE verbatim IS NULL",
    "q_summary": f"WITH RECURSIVE {SUMMARY} SELECT documents.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _names)} FROM documents LEFT JOIN summed USING (doc_id)",
    "q_type_histogram": f"WITH RECURSIVE {MERGED} SELECT doc_id, type, count(*) AS n FROM merged GROUP BY ALL",
    "q_anchors": f"WITH RECURSIVE {GOLD} SELECT doc_id, CAST(gold_no AS BIGINT) AS gold_no, anchor FROM anchors",
    "q_score": f"WITH RECURSIVE {SCORES} SELECT * FROM passed",
    "q_run_totals": f"WITH RECURSIVE {SCORES} SELECT count(*) AS cases, count(*) FILTER (pass) AS passed, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(fabricated) AS BIGINT) AS fabricated, bool_and(pass) AS pass FROM passed",
    "q_scoreboard": "WITH r AS (SELECT l_orderkey AS \"case\", 'model ' || l_linenumber AS model, CAST(sum(l_quantity % 5) AS BIGINT) AS matched, CAST(max(l_suppkey % 10) AS BIGINT) AS tok_s FROM lineitem GROUP BY ALL) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY \"case\" ORDER BY matched DESC, tok_s DESC, model) = 1",
    "q_locate_items": f"WITH first_s AS (SELECT item_id, text AS item, {sentences(trim('text'))}[1] AS s FROM benchmark), own AS (SELECT doc_id, unnest({sentences(trim('text'))}) AS s FROM documents), pairs AS (SELECT DISTINCT doc_id, item_id, item FROM own JOIN first_s USING (s)), hit AS (SELECT doc_id, item_id, text, CASE WHEN strpos({fold('text')}, {fold('item')}) > 0 THEN strpos({fold('text')}, {fold('item')}) - 1 WHEN strpos({fold('text')}, {fold_edges(fold('item'))}) > 0 THEN strpos({fold('text')}, {fold_edges(fold('item'))}) - 1 END AS spot FROM pairs JOIN documents USING (doc_id)) SELECT doc_id, item_id, spot, spot - length(replace(substr(text, 1, spot), chr(10), '')) + 1 AS line FROM hit",
    "q_check_findings": f"WITH RECURSIVE {FLAWED}, {_dups}, findings AS ({_findings}) SELECT doc_id, kind, CAST(step AS BIGINT) AS step, count(*) AS n, min(message) AS message FROM findings GROUP BY ALL",
    "q_check_spans": f"WITH RECURSIVE {FLAWED} SELECT doc_id, span_class, position_class, count(*) AS n FROM checked WHERE span_class IS NOT NULL GROUP BY ALL",
    "q_check_ids": f"WITH RECURSIVE {FLAWED}, numbered AS (SELECT doc_id, id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n, count(*) OVER (PARTITION BY doc_id) AS total FROM flawed) SELECT doc_id, 'ids must run from 1 to ' || arg_min(total, n) || ' over both lists: found ' || arg_min(id, n) || ' in place of ' || min(n) AS message FROM numbered WHERE id <> n GROUP BY doc_id",
    "q_check_duplicates": rf"WITH {_turn_sents}, k AS (SELECT conv_id AS doc_id, turn * 10000 + k AS ord, regexp_replace(lower(fact), '[^\p{{L}}\p{{N}}]', '', 'g') AS key FROM turns) SELECT doc_id, ord, f AS duplicate_of FROM (SELECT doc_id, ord, min(ord) OVER (PARTITION BY doc_id, key) AS f FROM k) WHERE ord <> f",
    "q_check_summary": f"WITH RECURSIVE {SUMMARY} SELECT doc_id, CAST(0 AS BIGINT) AS step, 'summary.total says ' || (total + 1) || ', the facts count ' || total AS message FROM summed WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, CAST(4 AS BIGINT), 'summary.unlocated says ' || unlocated || ', the facts count ' || (unlocated + 1) FROM summed WHERE false",
    "q_result_json": f"WITH RECURSIVE {SUMMARY} SELECT documents.doc_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _names)} FROM documents LEFT JOIN summed USING (doc_id)",
    "q_verify_replies": f"WITH RECURSIVE {CLAIMS} SELECT doc_id, count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status = 'dropped') AS dropped FROM judged GROUP BY doc_id",
}


def _escaped(x: str) -> str:
    return f"replace({_quote.format(x)}, chr(10), '\\n')"


_UNFLAWED = FLAWED.replace("doc_id % 15", "-1")
_DUPLICATED = _dups + ", twice AS (SELECT doc_id, count(*) FILTER (k > 1) AS n FROM dups GROUP BY doc_id)"
_COUNTED = "counted AS (SELECT doc_id, count(*) AS facts, count(verbatim) AS checked, count(*) FILTER (span_class = 'exact') AS exact, count(*) FILTER (span_class = 'recased') AS recased, count(*) FILTER (span_class = 'edge') AS edge_dirty, count(*) FILTER (verbatim IS NULL AND confidence = 'low') AS null_inferred, count(*) FILTER (verbatim IS NULL AND confidence <> 'low') AS failed_citations, count(*) FILTER (position_class IN ('right', 'wrong')) AS positioned, count(*) FILTER (verbatim IS NOT NULL AND spot IS NULL) AS unlocated, bool_and(coalesce(span_class, 'exact') <> 'paraphrase' AND coalesce(position_class, 'none') IN ('none', 'right')) AS good FROM checked GROUP BY doc_id)"
_NUMBERS = ("facts", "checked", "exact", "recased", "edge_dirty", "null_inferred", "failed_citations", "positioned", "unlocated")
_content = (
    """'{"facts":[' || string_agg('{"id":' || (ord + 1) || ',"fact":' || """ + _escaped("fact") + """ || ',"type":"' || type || '","confidence":"' || confidence || '","verbatim":' || coalesce("""
    + _escaped("span") + """, 'null') || '}', ',' ORDER BY ord) || ']}'"""
)
SQL |= {
    "q_strict_decode": """SELECT event_id AS doc_id, [NULL, 'an older document, with all facts in one list named "facts": extract again for the present form', 'no valid result: result.summary.total has the wrong type', NULL, 'no valid result: result.inferred_facts is no array',
  'no valid result: result.inferred_facts.fact has the wrong type', 'no valid result: unknown field "positions"', NULL, 'no valid result: result is no object', 'no valid result: unknown field "k"'][(event_id + 9) % 10 + 1] AS error,
  CAST(CASE event_id % 10 WHEN 1 THEN 0 WHEN 4 THEN 1 WHEN 8 THEN 0 END AS BIGINT) AS cited FROM events""",
    "q_check_results": f"""WITH RECURSIVE {_UNFLAWED}, {_DUPLICATED}, {_COUNTED}
SELECT documents.doc_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NUMBERS)}, CAST(NULL AS VARCHAR) AS error, coalesce(good AND n = 0, true) AS ok FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN twice USING (doc_id)""",
    "q_check_lines": f"""WITH RECURSIVE {_UNFLAWED}, {_DUPLICATED}, {_COUNTED}, kinds AS (SELECT doc_id, string_agg(type || '=' || n || ' ', '' ORDER BY list_position({list(TYPES)}, type)) AS kinds FROM (SELECT doc_id, type, count(*) AS n FROM checked GROUP BY ALL) GROUP BY doc_id)
SELECT documents.doc_id, format(E'{{}} facts   {{}}\nverbatim: {{}} checked ({{}} exact), {{}} inferred, {{}} failed citation(s), {{}} re-cased, {{}} edge punctuation\nposition: {{}} checked, {{}} not located\n{{}}', coalesce(facts, 0), coalesce(kinds, ''),
  {', '.join(f'coalesce({c}, 0)' for c in ('checked', 'exact', 'null_inferred', 'failed_citations', 'recased', 'edge_dirty', 'positioned', 'unlocated'))}, CASE WHEN coalesce(good AND n = 0, true) THEN 'pass' ELSE 'fail' END) AS lines
FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN twice USING (doc_id) LEFT JOIN kinds USING (doc_id)""",
    "q_case_records": f"""WITH RECURSIVE {SCORES}, counts AS (SELECT doc_id AS "case", count(*) FILTER (status = 'exact') AS exact, count(*) FILTER (status = 'repaired') AS repaired, count(*) FILTER (status = 'dropped') AS dropped FROM judged GROUP BY doc_id),
sent AS (SELECT doc_id, chunk_no, {_content} AS content FROM judged GROUP BY doc_id, chunk_no), tokens AS (SELECT doc_id AS "case", count(*) AS chunks, CAST(sum(length(chunk_text) // 4) AS BIGINT) AS prompt_tokens, CAST(sum(length(content) // 4) AS BIGINT) AS eval_tokens FROM sent JOIN chunks USING (doc_id, chunk_no) GROUP BY doc_id)
SELECT passed.*, chunks, prompt_tokens, eval_tokens, CAST(0 AS BIGINT) AS extra_requests, exact, repaired, dropped, "case" || CASE WHEN pass THEN ': pass, ' ELSE ': fail, ' END || matched || ' of ' || gold || ' gold spans, ' || extracted || ' facts from ' || chunks || ' chunks' AS line FROM passed JOIN counts USING ("case") JOIN tokens USING ("case")""",
    "q_run_record": f"WITH RECURSIVE {SCORES} SELECT 'm' AS model, 'false' AS think, CAST(1 AS BIGINT) AS passes, CAST(4096 AS BIGINT) AS num_ctx, bool_and(pass) AS pass, count(*) AS listed, count(*) AS cases, count(*) FILTER (pass) AS passed, CAST(sum(gold) AS BIGINT) AS gold, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(extracted) AS BIGINT) AS extracted, CAST(sum(fabricated) AS BIGINT) AS fabricated FROM passed",
    "q_token_accounting": f"""WITH RECURSIVE {CLAIMS}, sent AS (SELECT doc_id, chunk_no, chunk_no % 2 = 0 AS base, {_content} AS content FROM judged GROUP BY doc_id, chunk_no), sized_sent AS (SELECT doc_id, base, length(chunk_text) // 4 AS p, length(content) // 4 AS e, strlen(substr(content, 1, 40)) AS t FROM sent JOIN chunks USING (doc_id, chunk_no))
SELECT doc_id, {', '.join(f"CAST(coalesce(sum({v}) FILTER ({'' if base else 'NOT '}base), 0) AS BIGINT) AS {n}" for v, n, base in (('p', 'prompt_tokens', True), ('e', 'eval_tokens', True), ('t', 'think_chars', True), ('p', 'extra_prompt_tokens', False), ('e', 'extra_eval_tokens', False), ('t', 'extra_think_chars', False)))}, count(*) FILTER (NOT base) AS extra_requests FROM sized_sent GROUP BY doc_id""",
}
