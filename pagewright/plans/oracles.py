"""SQL for what the engine does in Python: HTML trees, completion of words, anchors, segmentation. DuckDB's dialect."""

from __future__ import annotations

from pagewright.sources.html_tree import CONTAINERS, HIDDEN, VOID

SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
LETTERS = r"[\p{L}\p{N}_]+"
AFTER = f"(?:[{SPACE}.,;:!?)]|$)"

#: Comments, scripts and styles whole, other markup, tags, text.
TOKENS = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[!?][^>]*>|</?[a-z][^>]*>|[^<]+|<"


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in sorted(words))


#: tree(doc_id, i, kind, tag, text, path): the tokens of each page, with the open elements (number, tag) around each one.
TREE = rf"""RECURSIVE cut AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(html, '{TOKENS}')) AS x, generate_subscripts(regexp_extract_all(html, '{TOKENS}'), 1)::INTEGER AS i FROM pages),
token AS (SELECT doc_id, i, x, lower(regexp_extract(x, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag, CASE WHEN regexp_matches(x, '(?is)^(<!|<\?|<script|<style)') THEN 'other' WHEN starts_with(x, '</') THEN 'close' WHEN regexp_matches(x, '^<[a-zA-Z]') THEN 'open' ELSE 'text' END AS kind FROM cut),
step AS (SELECT * EXCLUDE (kind), CASE WHEN kind = 'open' AND (tag IN ({listed(VOID)}) OR ends_with(x, '/>')) THEN 'void' ELSE kind END AS kind FROM token),
walk(doc_id, i, before, path) AS (SELECT DISTINCT doc_id, 0, []::STRUCT(n INTEGER, tag VARCHAR)[], []::STRUCT(n INTEGER, tag VARCHAR)[] FROM step
UNION ALL SELECT s.doc_id, s.i, w.path, CASE s.kind WHEN 'open' THEN list_append(w.path, {{'n': s.i, 'tag': s.tag}})
  WHEN 'close' THEN CASE WHEN list_contains(list_transform(w.path, lambda p: p.tag), s.tag) THEN w.path[:len(w.path) - list_position(list_reverse(list_transform(w.path, lambda p: p.tag)), s.tag)] ELSE w.path END ELSE w.path END
  FROM walk w JOIN step s ON s.doc_id = w.doc_id AND s.i = w.i + 1),
tree AS (SELECT s.doc_id, s.i, s.kind, s.tag, w.before AS path, replace(replace(replace(replace(replace(replace(replace(s.x, '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text FROM step s JOIN walk w ON w.doc_id = s.doc_id AND w.i = s.i),
held AS (SELECT doc_id, i, tag, path FROM tree WHERE kind = 'open' AND tag IN ({listed(CONTAINERS)})),
outer_ AS (SELECT DISTINCT doc_id, unnest(list_transform(path, lambda p: p.n)) AS i FROM held),
leaf AS (SELECT doc_id, i, tag, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS container_idx FROM held ANTI JOIN outer_ USING (doc_id, i) WHERE NOT list_has_any(list_transform(path, lambda p: p.tag), [{listed(HIDDEN)}])),
piece AS (SELECT doc_id, i AS spot, unnest(path).n AS i, path[-1].tag AS parent, CASE WHEN trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' THEN text WHEN contains(text, chr(10)) THEN chr(10) ELSE ' ' END AS text FROM tree WHERE kind = 'text'),
part AS (SELECT l.doc_id, l.container_idx, p.spot, p.text, p.parent FROM leaf l JOIN piece p ON p.doc_id = l.doc_id AND p.i = l.i)"""

CONTAINER_TABLE = f"WITH {TREE} SELECT l.doc_id, l.container_idx, any_value(l.tag) AS tag, coalesce(string_agg(p.text, '' ORDER BY p.spot), '') AS text FROM leaf l LEFT JOIN part p ON p.doc_id = l.doc_id AND p.container_idx = l.container_idx GROUP BY l.doc_id, l.container_idx"
NODES = f"""{TREE}, node AS (SELECT doc_id, container_idx, (row_number() OVER w - 1)::INTEGER AS node_idx, (sum(length(text)) OVER w - length(text))::INTEGER AS start_off, sum(length(text)) OVER w::INTEGER AS end_off, text
  FROM part WHERE parent NOT IN ({listed(HIDDEN)}) WINDOW w AS (PARTITION BY doc_id, container_idx ORDER BY spot ROWS UNBOUNDED PRECEDING))"""
NODE_TABLE = f"WITH {NODES} SELECT doc_id, container_idx, node_idx, start_off, end_off, text FROM node"


def last_word(w: str, snippet: str, text: str) -> str:
    """The snippet (its words: w) with its last word completed from text."""
    last, stem = f"{w}[-1]", f"rtrim({w}[-1], '-')"
    beside = f"CASE WHEN len({w}) > 1 THEN regexp_extract({text}, regexp_escape({w}[-2]) || '[{SPACE}]+' || regexp_escape({stem}) || '({LETTERS})', 1) ELSE '' END"
    alone = f"regexp_extract({text}, '(?:^|[{SPACE}])' || regexp_escape({stem}) || '({LETTERS})', 1)"
    rest = f"CASE WHEN {beside} <> '' THEN {beside} WHEN {alone} <> '' THEN {alone} WHEN ends_with({last}, '-') THEN '<!-- FIXME -->' END"
    whole = f"NOT ends_with({last}, '-') AND regexp_matches({text}, '(?:^|[{SPACE}])' || regexp_escape({last}) || '{AFTER}')"
    return f"CASE WHEN len({w}) = 0 OR {whole} OR ({rest}) IS NULL THEN {snippet} ELSE array_to_string(list_append({w}[:-2], {stem} || ({rest})), ' ') END"


def first_word(w: str, snippet: str, text: str) -> str:
    first = f"regexp_escape({w}[1])"
    beside = f"CASE WHEN len({w}) > 1 THEN regexp_extract({text}, '({LETTERS})' || {first} || '[{SPACE}]+' || regexp_escape(array_to_string({w}[2:3], ' ')), 1) ELSE '' END"
    alone = f"regexp_extract({text}, '({LETTERS})' || {first} || '{AFTER}', 1)"
    start = f"CASE WHEN {beside} <> '' THEN {beside} ELSE {alone} END"
    return f"CASE WHEN len({w}) = 0 OR regexp_matches({text}, '(?:^|[{SPACE}])' || {first} || '{AFTER}') OR ({start}) = '' THEN {snippet} ELSE array_to_string(list_prepend(({start}) || {w}[1], {w}[2:]), ' ') END"


def anchored(rows: str, target: int = 10) -> str:
    """CTEs that end in corrected(doc_id, snippet, text, was_corrected, s) over rows(doc_id, snippet, w, text, ...): the words of text around the first anchor of four, else three words."""
    return f"""anchor AS (SELECT doc_id, first(a ORDER BY size DESC, i) AS a, first(size ORDER BY size DESC, i) AS size FROM
  (SELECT doc_id, text, size, i, array_to_string(w[i:i + size - 1], ' ') AS a FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, unnest([4, 3]) AS size FROM {rows} WHERE len(w) >= 3))) WHERE contains(text, a) GROUP BY doc_id),
around AS (SELECT r.doc_id, r.snippet, r.text, a, size, string_split(substring(text, 1, strpos(text, a) - 1), ' ') AS l, string_split(substring(text, strpos(text, a) + length(a)), ' ') AS r FROM {rows} r LEFT JOIN anchor USING (doc_id)),
counted AS (SELECT *, greatest(0, ({target} - size) // 2) AS want, least(len(l) - 1, greatest(0, ({target} - size) // 2)) AS before FROM around),
stretch AS (SELECT *, CASE WHEN len(l) - 1 < want THEN array_to_string(l, ' ') WHEN want = 0 THEN '' ELSE ' ' || array_to_string(l[-want:], ' ') END || a
  || CASE WHEN len(r) - 1 < {target} - size - before THEN array_to_string(r, ' ') ELSE array_to_string(list_append(r[:{target} - size - before], ''), ' ') END AS found FROM counted),
shaped AS (SELECT *, regexp_replace(found, '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS f, list_filter(regexp_split_to_array(found, '[{SPACE}]+'), lambda x: x <> '') AS fw FROM stretch),
corrected AS (SELECT doc_id, snippet, text, a IS NOT NULL AS was_corrected, CASE WHEN a IS NULL THEN snippet WHEN len(fw) > {target} THEN array_to_string(fw[-{target}:], ' ') ELSE f END AS s FROM shaped)"""


def segmented(rows: str, known: tuple[str, ...], most: int = 15) -> str:
    """CTEs that end in best(doc_id, seg) over rows(doc_id, t): the words of the best segmentation, a dictionary word at a tenth of its length, another piece at -1."""
    longest = max(map(len, known))
    every = listed({*known, *(k.lower() for k in known)})
    return f"""RECURSIVE dp(doc_id, t, i, score, seg) AS (SELECT doc_id, t, 0, [0.0::DOUBLE], [[]::VARCHAR[]] FROM {rows}
UNION ALL (WITH tried AS (SELECT doc_id, i + 1 AS i, j, score[j + 1] + CASE WHEN lower(substring(t, j + 1, i + 1 - j)) IN ({every}) THEN length(lower(substring(t, j + 1, i + 1 - j))) / 10.0::DOUBLE ELSE -1.0::DOUBLE END AS s, list_append(seg[j + 1], substring(t, j + 1, i + 1 - j)) AS x
    FROM (SELECT *, unnest(range(greatest(0, i + 1 - {longest}), i + 1)) AS j FROM dp WHERE i < length(t))),
  top AS (SELECT doc_id, arg_max({{'s': s, 'x': x}}, {{'s': s, 'j': -j}}) AS b FROM tried GROUP BY doc_id)
  SELECT d.doc_id, d.t, d.i + 1, list_append(d.score, b.s), list_append(d.seg, b.x) FROM dp d JOIN top USING (doc_id) WHERE d.i < length(d.t))),
best AS (SELECT doc_id, seg[-1] AS seg FROM dp WHERE i = length(t))"""


def placed(refs: str, jaccard) -> str:
    """The fold of page markers: CTEs that end in fold(...) over refs(doc_id, ord, page, snippet, context_before, context_after), rank by rank, and NODES.

    jaccard(a, b): SQL for the similarity of two texts' words. State of a document: the texts of the nodes of each of its
    containers, to which markers are added, and the last place.
    """
    text = "array_to_string(conts[k + 1], '')"
    return f"""{NODES}, ref_ AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(page, '^[0-9]+$') THEN page::BIGINT ELSE 0 END, page, ord) AS r, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord)::INTEGER AS occurrence,
  CASE WHEN contains(snippet, '|') THEN trim(trim(split_part(snippet, '|', 1)) || ' ' || trim(substring(snippet, strpos(snippet, '|') + 1))) ELSE snippet END AS search, CASE WHEN contains(snippet, '|') THEN length(trim(split_part(snippet, '|', 1))) ELSE length(snippet) END AS shift FROM ({refs})),
cont AS (SELECT l.doc_id, l.container_idx, coalesce(list(n.text ORDER BY n.node_idx) FILTER (n.text IS NOT NULL), []) AS nodes FROM leaf l LEFT JOIN node n ON n.doc_id = l.doc_id AND n.container_idx = l.container_idx GROUP BY l.doc_id, l.container_idx),
fold(doc_id, r, conts, last, pos, was, was_pos, k, m, score, n) AS (SELECT doc_id, 0::BIGINT, list(nodes ORDER BY container_idx), -1, 0, -1, 0, NULL::INTEGER, NULL::INTEGER, NULL::DOUBLE, 0::BIGINT FROM cont GROUP BY doc_id
UNION ALL (WITH now AS (SELECT f.doc_id, f.r + 1 AS r, f.conts, f.last, f.pos, x.search, x.shift, x.page, coalesce(x.context_before, '') AS cb, coalesce(x.context_after, '') AS ca FROM fold f JOIN ref_ x ON x.doc_id = f.doc_id AND x.r = f.r + 1),
  box AS (SELECT *, {text} AS t FROM (SELECT *, unnest(range(greatest(0, last), len(conts)))::INTEGER AS k FROM now)),
  seen AS (SELECT * FROM box WHERE search <> '' AND contains(t, search)),
  first_ AS (SELECT *, CASE WHEN k = last AND strpos(t, search) - 1 + shift <= pos THEN CASE WHEN strpos(substring(t, pos + 1), search) > 0 THEN strpos(substring(t, pos + 1), search) - 1 + pos ELSE -1 END ELSE strpos(t, search) - 1 END AS start FROM seen WHERE cb = '' AND ca = ''),
  every_ AS (SELECT *, unnest(list_filter(range(0, length(t)), lambda i: substring(t, i + 1, length(search)) = search)) AS start FROM seen WHERE cb <> '' OR ca <> ''),
  found AS (SELECT *, (start + shift)::INTEGER AS m FROM first_ WHERE start >= 0 AND start + shift > 0 UNION ALL SELECT *, (start + shift)::INTEGER AS m FROM every_ WHERE (k <> last OR start + shift > pos) AND start + shift > 0),
  fit AS (SELECT *, list_slice(list_filter(regexp_split_to_array(substring(t, 1, start), '[{SPACE}]+'), lambda x: x <> ''), -4, -1) AS b, list_slice(list_filter(regexp_split_to_array(substring(t, start + length(search) + 1), '[{SPACE}]+'), lambda x: x <> ''), 1, 4) AS a FROM found),
  rated AS (SELECT *, CASE WHEN cb <> '' AND ca <> '' THEN 0.4::DOUBLE * {jaccard('cb', "array_to_string(b, ' ')")} + 0.6::DOUBLE * {jaccard('ca', "array_to_string(a, ' ')")} WHEN ca <> '' THEN {jaccard('ca', "array_to_string(a, ' ')")} WHEN cb <> '' THEN {jaccard('cb', "array_to_string(b, ' ')")} END AS s FROM fit),
  chosen AS (SELECT doc_id, count(*) AS n, max(s) AS top, first({{'k': k, 'm': m}} ORDER BY k, m) AS f, first({{'k': k, 'm': m}} ORDER BY s DESC, k, m) AS b FROM rated GROUP BY doc_id),
  spot AS (SELECT w.*, CASE WHEN c.n > 1 AND (cb <> '' OR ca <> '') THEN top END AS score, coalesce(c.n, 0) AS n, CASE WHEN c.n > 1 AND (cb <> '' OR ca <> '') AND top >= 0.3 THEN c.b ELSE c.f END AS at_ FROM now w LEFT JOIN chosen c USING (doc_id)),
  inside AS (SELECT *, conts[at_.k + 1] AS ns, list_filter(range(1, len(conts[at_.k + 1]) + 1), lambda i: length(array_to_string(conts[at_.k + 1][1:i], '')) >= at_.m)[1] AS i FROM spot),
  split AS (SELECT *, substring(ns[i], 1, at_.m - length(array_to_string(ns[1:i - 1], ''))) AS lt, substring(ns[i], at_.m - length(array_to_string(ns[1:i - 1], '')) + 1) AS rt FROM inside)
  SELECT doc_id, r, CASE WHEN at_ IS NULL THEN conts ELSE list_concat(conts[1:at_.k], [list_concat(ns[1:i - 1], [lt || CASE WHEN ends_with(lt, ' ') THEN '' ELSE ' ' END, page], CASE WHEN rt = '' THEN [] WHEN starts_with(rt, ' ') THEN [rt] ELSE [' ' || rt] END, ns[i + 1:])], conts[at_.k + 2:]) END,
    coalesce(at_.k, last), coalesce(at_.m, pos), last, pos, at_.k, at_.m, score, n FROM split))"""


PLACES = """SELECT x.doc_id, x.ord, x.page, x.snippet, x.occurrence, f.k AS container_idx, f.m AS marker_pos, CASE WHEN f.k IS NULL THEN 'not_found' ELSE 'found' END AS status, f.score,
  CASE WHEN f.score >= 0.3 THEN 'context_used' WHEN f.score IS NOT NULL THEN 'context_fallback' END AS context_status, f.was AS last_container, f.was_pos AS last_position FROM ref_ x JOIN fold f ON f.doc_id = x.doc_id AND f.r = x.r"""
