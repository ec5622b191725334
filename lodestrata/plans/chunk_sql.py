"""The chunker's passes as SQL for DuckDB: sections over the cap cut at paragraphs, sentences, rows and code lines; small ones merged;
a second count; heading paths in front."""

from __future__ import annotations

TOKEN = r"\s*(?:[A-Za-z0-9]+|[^\sA-Za-z0-9])|\s+$"
_LINE = "chr(10)"


def _n(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{TOKEN}'))"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _groups(name: str, units: str, most: int) -> str:
    """units (key, k, t, n, frame) with their group g: a new one where n more tokens, or a unit over the cap by itself, don't fit."""
    new = f"(u.frame + r.n > {most} OR u.frame + u.n > {most} OR r.size + u.n > {most})"
    return f"""{name}_units AS ({units}), {name} AS (
      SELECT key, k, t, n, frame, frame + n AS size, 0 AS g FROM {name}_units WHERE k = 0
      UNION ALL SELECT u.key, u.k, u.t, u.n, u.frame, CASE WHEN {new} THEN u.frame + u.n ELSE r.size + u.n END, r.g + {new}::INT FROM {name} r JOIN {name}_units u ON u.key = r.key AND u.k = r.k + 1
    )"""


def _windows(rows: str, kept: str, text: str, most: int) -> str:
    """rows with kept, w and piece: windows of about equal length over text, if it is over the cap."""
    return f"""(SELECT {kept}, w, CASE WHEN len(p) <= {most} THEN {text} ELSE array_to_string(p[w * size + 1 : (w + 1) * size], '') END AS piece FROM (
      SELECT *, unnest(range(CASE WHEN len(p) <= {most} THEN 1 ELSE ceil(len(p) / size::DOUBLE)::BIGINT END)) AS w FROM (
        SELECT *, greatest(1, ceil(len(p) / ceil(len(p) / {most}.0)))::BIGINT AS size FROM (SELECT *, regexp_extract_all({text}, '{TOKEN}') AS p FROM {rows}))))"""


def chunked(parts: str, least: int, most: int) -> str:
    """CTEs (of a WITH RECURSIVE) that end in done(doc, chunk_index, heading_path, content, token_count).

    parts: doc, s (place), path (a list), kind (plain, fence: first and last line frame it; table: two lines of header), body.
    """
    blocks = rf"CASE WHEN kind = 'plain' THEN list_filter(list_transform(regexp_split_to_array(body, '\n(?:[ \t]*\n)+'), lambda x: {_strip('x')}), lambda x: x <> '') ELSE [body] END"
    block_units = f"SELECT doc || '/' || s AS key, k, bs[k + 1] AS t, {_n('bs[k + 1]')} AS n, 0 AS frame FROM (SELECT *, unnest(range(len(bs))) AS k FROM (SELECT *, {blocks} AS bs FROM parts WHERE {_n('body')} > {most}))"
    lines = f"string_split(t, {_LINE})"
    units = rf"CASE kind WHEN 'fence' THEN {lines}[2:-2] WHEN 'table' THEN {lines}[3:] ELSE string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END"
    head = f"CASE kind WHEN 'fence' THEN {lines}[1] WHEN 'table' THEN array_to_string({lines}[1:2], {_LINE}) ELSE '' END"
    tail = f"CASE kind WHEN 'fence' THEN {lines}[-1] ELSE '' END"
    inner_units = f"SELECT key, k, us[k + 1] AS t, {_n('us[k + 1]')} AS n, {_n('head')} + {_n('tail')} AS frame FROM (SELECT *, unnest(range(len(us))) AS k FROM inner_of)"
    glue = f"CASE WHEN max(frame) > 0 THEN string_agg(t, {_LINE} ORDER BY k) ELSE string_agg(t, ' ' ORDER BY k) END"
    common = "list_filter(range(1, list_min(list_transform(paths, lambda p: len(p))) + 1), lambda i: len(list_distinct(list_transform(paths, lambda p: array_to_string(p[1:i], ' > ')))) = 1)"
    crumb = "array_to_string(path, ' > ')"
    return f"""parts AS ({parts}),
    {_groups('b', block_units, most)},
    over AS (SELECT b.key || '/' || b.g AS key, b.key AS part, b.g, b.t, p.kind FROM b JOIN parts p ON p.doc || '/' || p.s = b.key WHERE b.n > {most}),
    inner_of AS (SELECT key, part, g, {units} AS us, {head} AS head, {tail} AS tail FROM over),
    {_groups('i', inner_units, most)},
    inner_groups AS (SELECT key, g AS ig, bool_or(frame + n > {most}) AS cut, {glue} AS t FROM i GROUP BY key, g),
    framed AS (SELECT o.part, o.g, x.ig, x.cut, CASE WHEN x.cut OR o.head = '' THEN x.t ELSE o.head || {_LINE} || x.t || CASE WHEN o.tail = '' THEN '' ELSE {_LINE} || o.tail END END AS t FROM inner_groups x JOIN inner_of o USING (key)),
    pieces AS (
      SELECT doc || '/' || s AS part, 0 AS g, 0 AS ig, 0 AS w, body AS piece FROM parts WHERE {_n('body')} <= {most}
      UNION ALL SELECT key, g, 0, 0, string_agg(t, {_LINE} || {_LINE} ORDER BY k) FROM b GROUP BY key, g HAVING max(n) <= {most}
      UNION ALL SELECT part, g, ig, 0, t FROM framed WHERE NOT cut
      UNION ALL SELECT part, g, ig, w, piece FROM {_windows('(SELECT * FROM framed WHERE cut)', 'part, g, ig', 't', most)}
    ),
    placed AS (SELECT p.doc, p.path, x.piece, {_n('x.piece')} AS n, row_number() OVER (PARTITION BY p.doc ORDER BY p.s, x.g, x.ig, x.w) - 1 AS k FROM pieces x JOIN parts p ON p.doc || '/' || p.s = x.part),
    ahead AS (
      SELECT doc, k, n, n AS size, 0 AS g FROM placed WHERE k = 0
      UNION ALL SELECT u.doc, u.k, u.n, CASE WHEN r.size < {least} AND r.size + u.n <= {most} THEN r.size + u.n ELSE u.n END, r.g + (NOT (r.size < {least} AND r.size + u.n <= {most}))::INT FROM ahead r JOIN placed u ON u.doc = r.doc AND u.k = r.k + 1
    ),
    sizes AS (SELECT doc, g, sum(n) AS n FROM ahead GROUP BY doc, g),
    back AS (
      SELECT doc, g, n::BIGINT AS size, 0 AS m FROM sizes WHERE g = 0
      UNION ALL SELECT u.doc, u.g, (CASE WHEN u.n < {least} AND r.size + u.n <= {most} THEN r.size + u.n ELSE u.n END)::BIGINT, r.m + (NOT (u.n < {least} AND r.size + u.n <= {most}))::INT FROM back r JOIN sizes u ON u.doc = r.doc AND u.g = r.g + 1
    ),
    merged AS (SELECT doc, m, list(path ORDER BY k) AS paths, string_agg(piece, {_LINE} || {_LINE} ORDER BY k) AS body FROM ahead JOIN back USING (doc, g) JOIN placed USING (doc, k) GROUP BY doc, m),
    rooted AS (SELECT doc, m, body, paths[1][1:len({common})] AS path FROM merged),
    counted AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY m, w) - 1 AS chunk_index, {crumb} AS heading_path, CASE WHEN len(path) > 0 THEN {crumb} || {_LINE} || {_LINE} ELSE '' END || piece AS content FROM {_windows('rooted', 'doc, m, path', 'body', most)}),
    done AS (SELECT *, {_n('content')}::BIGINT AS token_count FROM counted)"""


#: Conversations as Markdown: headings of level 1 to 3, a fence or a table in some turns.
TALKS = rf"""SELECT conv_id::VARCHAR AS doc, s, list_concat(['Talk ' || conv_id], path) AS path, kind, {_strip('body')} AS body FROM (
  SELECT t.conv_id, t.s, (SELECT list(a.role ORDER BY a.turn) FROM turns a WHERE a.conv_id = t.conv_id AND a.turn <= t.turn
      AND NOT EXISTS (SELECT 1 FROM turns v WHERE v.conv_id = a.conv_id AND v.turn > a.turn AND v.turn <= t.turn AND v.level <= a.level)) AS path,
    CASE turn % 4 WHEN 1 THEN 'fence' WHEN 2 THEN 'table' ELSE 'plain' END AS kind,
    CASE turn % 4 WHEN 1 THEN '```' || chr(10) || '# no heading' || chr(10) || text || chr(10) || '```'
      WHEN 2 THEN '| a |' || chr(10) || '|---|' || chr(10) || '| ' || regexp_replace(text, '[^A-Za-z ]', '', 'g') || ' |' ELSE text END AS body
  FROM turns t)"""
TURN_LEVELS = "turns AS (SELECT conv_id, turn, role, text, turn % 3 + 1 AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations)"
