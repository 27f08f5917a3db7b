"""The named queries in DuckDB's SQL, stated apart from the engine: the stores' derivation, then each result."""

from __future__ import annotations


def vint(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 10 WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END)"


def stamp(t: str, sep: str = " ", fraction: bool = True) -> str:
    end = f" || '.' || lpad(({t} % 10000000)::VARCHAR, 7, '0')" if fraction else ""
    return f"coalesce(strftime(make_timestamp({t} // 10 - 11644473600000000), '%Y-%m-%d{sep}%H:%M:%S'){end} || 'Z', '')"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '^[+-]?[0-9]+$') THEN try_cast(trim({x}) AS BIGINT) END"


NAMES = [(1, "ReadOnly"), (2, "Hidden"), (4, "System"), (16, "Directory"), (32, "Archive"), (8192, "NotContentIndexed")]


def attribute_names(m: str) -> str:
    known = "concat_ws('|', " + ", ".join(f"CASE WHEN {m} & {b} <> 0 THEN '{n}' END" for b, n in NAMES) + ")"
    return f"CASE WHEN {m} IS NULL OR {m} = 0 THEN '' WHEN {m} & 524288 <> 0 THEN {m}::VARCHAR ELSE {known} END"


ORDERS = r"""
folder_docs AS (
  SELECT 'r' || r_regionkey AS fldrid, NULL AS fldrpid, CASE WHEN r_regionkey = 4 THEN '\\server\share' ELSE chr(65 + r_regionkey) || ':' END AS fldrnm FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer
), paths AS (
  SELECT r.fldrid AS folder_id, r.fldrnm AS path FROM folder_docs r WHERE fldrpid IS NULL
  UNION ALL SELECT n.fldrid, r.fldrnm || '\' || n.fldrnm FROM folder_docs n JOIN folder_docs r ON n.fldrpid = r.fldrid WHERE r.fldrpid IS NULL
  UNION ALL SELECT c.fldrid, r.fldrnm || '\' || n.fldrnm || '\' || c.fldrnm FROM folder_docs c JOIN folder_docs n ON c.fldrpid = n.fldrid JOIN folder_docs r ON n.fldrpid = r.fldrid WHERE r.fldrpid IS NULL
), o AS (SELECT *, o_orderkey AS k, (epoch_us(o_orderdate) + 11644473600000000) * 10 AS t FROM orders),
items AS (
  SELECT k, 2 * k AS doc_id, k % 97 = 0 AS deleted, 'c' || o_custkey AS folder_id, 'c' || o_custkey || ':order-' || k AS id,
    'Order-' || k || '.' || CASE k % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'log' ELSE '' END AS name,
    CASE k % 3 WHEN 0 THEN 'txt' WHEN 1 THEN 'log' ELSE '' END AS ext,
    CASE k % 50 WHEN 7 THEN 'n/a' WHEN 8 THEN ' ' ELSE round(o_totalprice * 100)::BIGINT::VARCHAR END AS sizenr,
    CASE WHEN k % 50 = 9 THEN '0' ELSE t::VARCHAR END AS modft, t - 864000000000 * (k % 30) + k % 10 AS created,
    CASE WHEN k % 50 = 9 THEN NULL ELSE t END AS modified,
    CASE k % 5 WHEN 0 THEN 32 WHEN 1 THEN 33 WHEN 2 THEN 8224 WHEN 3 THEN 16 ELSE 524320 END AS mask,
    CASE k % 5 WHEN 0 THEN '20' WHEN 1 THEN '21' WHEN 2 THEN '2020' WHEN 3 THEN '10' ELSE '80020' END AS attrx,
    CASE WHEN k % 11 = 0 THEN 4 ELSE 1 END AS itemtype, k % 11 = 0 OR k % 5 = 3 AS is_folder,
    CASE WHEN k % 7 = 0 THEN [format('{:x}', k % 100), format('{:x}', k % 3)] ELSE [format('{:x}', k % 100)] END AS exinfo
  FROM o
), metas AS (
  SELECT k, 2 * k + 1 AS doc_id, t + 10000000 AS idxdt, k % 6 AS flags, 37 * k + 1 AS terms, t AS moddt FROM o WHERE k % 10 <> 0 AND k % 97 <> 0
)"""

FLAG_TEXT = "CASE flags WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'bit1' WHEN 3 THEN 'bit1' ELSE 'bit2' END"

EXPORT_COLUMNS = f"""
    p.path || '\\' || i.name AS "FullPath", p.path AS "Folder", i.name AS "Name", CASE WHEN i.is_folder THEN '' ELSE i.ext END AS "Extension",
    CASE WHEN i.is_folder THEN 'Y' ELSE 'N' END AS "IsFolder", CASE WHEN NOT i.is_folder THEN {number('i.sizenr')} END AS "SizeBytes",
    {stamp('i.modified')} AS "Modified", {stamp('i.created')} AS "Created", {stamp('m.idxdt')} AS "IndexedDate",
    coalesce(CASE WHEN m.flags % 2 = 1 THEN 'Y' WHEN m.flags % 2 = 0 THEN 'N' END, '') AS "ContentIndexed", coalesce(CASE WHEN m.k IS NOT NULL THEN {FLAG_TEXT.replace('flags', 'm.flags')} END, '') AS "OtherFlagBits",
    m.terms AS "TermCount", {attribute_names('i.mask')} AS "Attributes", i.itemtype::BIGINT AS "ItemType", i.folder_id AS "FolderId", i.id AS "ItemId", i.doc_id AS "DocId", m.doc_id AS "MetaDocId" """
EXPORT_FROM = "FROM items i LEFT JOIN metas m USING (k) JOIN paths p USING (folder_id) WHERE NOT i.deleted"

TEXTS = rf"""
d AS (SELECT doc_id AS k, text, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source FROM documents),
docs AS (
  SELECT (k % 3)::INT AS segment, 2 * k AS doc_id, k, k % 97 = 5 AS deleted, 'item' AS kind, 'T:\' || lang || '\' || source AS folder, 'f-' || lang || '-' || source AS fid,
    'Doc-' || k || CASE WHEN k % 4 = 0 THEN '.md' ELSE '.txt' END AS name, length(text) AS size, k % 40 = 3 AS is_folder,
    [strlen('f-' || lang || '-' || source || ':doc-' || k), strlen('Doc-' || k || CASE WHEN k % 4 = 0 THEN '.md' ELSE '.txt' END), 18, 2]
      || CASE WHEN text IS NULL THEN [] ELSE [strlen(length(text)::VARCHAR), strlen(text)] END AS lens FROM d
  UNION ALL SELECT (k % 3)::INT, 2 * k + 1, k, k % 97 = 5, 'meta', 'T:\' || lang || '\' || source, 'f-' || lang || '-' || source, 'Doc-' || k || '.txt', 0, false, [strlen('f-' || lang || '-' || source || ':doc-' || k), 1] FROM d WHERE k % 4 = 1
  UNION ALL SELECT 0, 1099511627776 + row_number() OVER (ORDER BY lang), NULL, false, 'folder', 'T:\' || lang, 'l-' || lang, '', 0, true, [strlen('l-' || lang), 1, strlen(lang), 18] FROM (SELECT DISTINCT lang FROM d)
  UNION ALL SELECT 0, 2199023255552 + row_number() OVER (ORDER BY lang, source), NULL, false, 'folder', 'T:\' || lang || '\' || source, 'f-' || lang || '-' || source, '', 0, true, [strlen('f-' || lang || '-' || source), strlen('l-' || lang), strlen(source)] FROM (SELECT DISTINCT lang, source FROM d)
  UNION ALL SELECT 0, 3298534883328, NULL, false, 'folder', 'T:', 't', '', 0, true, [1, 4, 6]
  UNION ALL SELECT 0, 4398046511104, NULL, false, 'index', '', '', '', 0, false, [1]
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY segment ORDER BY doc_id) - 1 AS doc,
    {vint('len(lens)')} + list_sum(list_transform(lens, lambda n: 2 + {vint('n')} + n))::BIGINT + 8 AS stored_bytes FROM docs
), words AS (
  SELECT segment, doc, unnest(range(len(t))) AS pos, unnest(t) AS term
  FROM (SELECT n.segment, n.doc, string_split_regex(d.text, '[ \n]+') AS t FROM d JOIN numbered n ON n.k = d.k AND n.kind = 'item' WHERE d.text IS NOT NULL)
), steps AS (SELECT *, pos - coalesce(lag(pos) OVER (PARTITION BY segment, doc, term ORDER BY pos), 0) AS step FROM words WHERE term <> ''),
posts AS (
  SELECT segment, 'content' AS field, 0 AS field_no, term, doc, count(*) AS freq, sum({vint('step')})::BIGINT AS prox FROM steps GROUP BY segment, term, doc
  UNION ALL SELECT n.segment, 'lang', 1, d.lang, n.doc, 1, 0 FROM d JOIN numbered n ON n.k = d.k AND n.kind = 'item'
  UNION ALL SELECT n.segment, 'source', 2, d.source, n.doc, 1, 0 FROM d JOIN numbered n ON n.k = d.k AND n.kind = 'item'
), deltas AS (
  SELECT *, doc - coalesce(lag(doc) OVER w, 0) AS delta, row_number() OVER w - 1 AS rk FROM posts WINDOW w AS (PARTITION BY segment, field, term ORDER BY doc)
), pb AS (
  SELECT *, CASE WHEN field = 'content' THEN {vint('(delta * 2 + (freq = 1)::INT)')} + CASE WHEN freq = 1 THEN 0 ELSE {vint('freq')} END ELSE {vint('delta')} END AS fb FROM deltas
), terms AS (SELECT segment, field, field_no, term, count(*) AS df, sum(fb)::BIGINT AS frq, sum(prox)::BIGINT AS prx FROM pb GROUP BY ALL),
lagged AS (
  SELECT *, coalesce(lag(term) OVER w, '') AS prev, coalesce(lag(frq) OVER w, 0) AS pf, coalesce(lag(prx) OVER w, 0) AS pp, strlen(term) AS size FROM terms WINDOW w AS (PARTITION BY segment, field ORDER BY term)
), prefixed AS (
  SELECT *, coalesce(list_min(list_filter(range(1, least(strlen(prev), size) + 1), lambda i: substr(hex(prev), 2 * i - 1, 2) <> substr(hex(term), 2 * i - 1, 2))) - 1, least(strlen(prev), size)) AS pre FROM lagged
), entries AS (
  SELECT *, ({vint('pre')} + {vint('(size - pre)')} + size - pre + {vint('field_no')} + {vint('df')} + {vint('pf')} + {vint('pp')} + (df > 16)::INT)::BIGINT AS entry_bytes,
    (CASE WHEN df > 16 THEN df // 16 + df // 256 + df // 4096 + df // 65536 + df // 1048576 ELSE 0 END)::BIGINT AS skip_entries FROM prefixed
), by_doc AS (
  SELECT p.segment, p.doc, sum(fb)::BIGINT AS posting_bytes, sum(prox)::BIGINT AS position_bytes, sum(CASE WHEN e.df = 1 THEN entry_bytes ELSE 0 END)::BIGINT AS sole_term_bytes,
    sum(CASE WHEN e.df > 1 THEN entry_bytes ELSE 0 END)::BIGINT AS shared_term_bytes, sum((e.df > 1)::INT)::BIGINT AS shared_term_count,
    sum(CASE WHEN e.df > 1 THEN entry_bytes // e.df + (rk < entry_bytes % e.df)::INT ELSE 0 END)::BIGINT AS shared_share
  FROM pb p JOIN entries e USING (segment, field, term) GROUP BY p.segment, p.doc
), owned AS (
  SELECT n.*, CASE WHEN deleted THEN '<deleted documents - reclaimed on optimise>' WHEN kind = 'index' THEN '<index metadata>' WHEN kind = 'folder' THEN folder ELSE folder || '\' || name END AS owner,
    coalesce(posting_bytes, 0) AS posting_bytes, coalesce(position_bytes, 0) AS position_bytes, coalesce(sole_term_bytes, 0) AS sole_term_bytes,
    coalesce(shared_term_bytes, 0) AS shared_term_bytes, coalesce(shared_term_count, 0) AS shared_term_count, coalesce(shared_share, 0) AS shared_share
  FROM numbered n LEFT JOIN by_doc USING (segment, doc)
), rows_ AS (
  SELECT lower(owner) AS owner_key, arg_min(owner, doc_id) AS owner, bool_or(is_folder AND NOT deleted) AS is_folder, count(*) AS doc_count, sum(stored_bytes)::BIGINT AS stored_bytes, count(*) AS norm_bytes,
    sum(posting_bytes)::BIGINT AS posting_bytes, sum(position_bytes)::BIGINT AS position_bytes, sum(sole_term_bytes)::BIGINT AS sole_term_bytes, sum(shared_term_bytes)::BIGINT AS shared_term_bytes,
    sum(shared_term_count)::BIGINT AS shared_term_count, sum(shared_share)::BIGINT AS shared_share, sum(CASE WHEN deleted THEN 0 ELSE coalesce(size, 0) END)::BIGINT AS file_size, min(doc_id) AS first_doc, any_value(kind) AS kind, any_value(fid) AS fid
  FROM owned GROUP BY lower(owner)
), cost_rows AS (SELECT *, stored_bytes + norm_bytes + posting_bytes + position_bytes + sole_term_bytes AS exclusive_bytes FROM rows_),
totals AS (
  SELECT (SELECT sum(CASE WHEN df = 1 THEN entry_bytes ELSE 0 END) FROM entries)::BIGINT AS sole, (SELECT sum(CASE WHEN df > 1 THEN entry_bytes ELSE 0 END) FROM entries)::BIGINT AS shared, (SELECT sum(skip_entries) FROM entries)::BIGINT AS skips,
    sum(stored_bytes)::BIGINT AS stored, sum(norm_bytes)::BIGINT AS norms, sum(posting_bytes)::BIGINT AS postings, sum(position_bytes)::BIGINT AS positions FROM rows_
), checks AS (
  SELECT unnest(['.prx  positions', '.frq  postings', '.fdt+.fdx stored', '.nrm  norms', '.tis  dictionary', '.tii  dict index', '.fnm  field infos']) AS "check",
    unnest([positions, postings + 3 * skips, stored + 12, norms + 12, sole + shared + 24, 777, 99])::BIGINT AS actual, unnest([positions, postings, stored, norms, sole + shared, 0, 0])::BIGINT AS computed FROM totals
), files AS (SELECT *, row_number() OVER (ORDER BY exclusive_bytes DESC, first_doc) AS rn, sum(exclusive_bytes) OVER (ORDER BY exclusive_bytes DESC, first_doc ROWS UNBOUNDED PRECEDING) AS cum FROM cost_rows WHERE NOT is_folder AND owner[1] <> '<'),
homes AS (
  SELECT *, exclusive_bytes + shared_share AS bytes, CASE WHEN owner[1] = '<' THEN 'omitted' WHEN kind = 'folder' THEN 'own' WHEN is_folder THEN 'empty' ELSE 'file' END AS place,
    CASE WHEN kind = 'folder' THEN owner ELSE regexp_replace(owner, '\\[^\\]*$', '') END AS home FROM cost_rows
), above AS (
  SELECT h.*, unnest(list_transform(range(1, len(parts) + 1), lambda n: array_to_string(parts[1:n], '\'))) AS folder, len(parts) AS deep, unnest(range(1, len(parts) + 1)) AS n FROM (SELECT *, string_split(home, '\') AS parts FROM homes WHERE place <> 'omitted') h
), rolled AS (
  SELECT folder, sum(bytes)::BIGINT AS subtree, sum(exclusive_bytes)::BIGINT AS exclusive, sum(CASE WHEN place = 'own' AND n = deep THEN bytes ELSE 0 END)::BIGINT AS own, count(*) FILTER (place = 'file') AS files, count(*) FILTER (place = 'empty' OR (place = 'own' AND n < deep)) AS dirs FROM above GROUP BY folder
)"""


#: the treemap of the texts store: what stands where, sums over prefixes, ranks among siblings, keys of places
TREEMAP = r"""
things AS (
  SELECT owner AS path, string_split(owner, '\') AS parts, place, file_size AS size, bytes AS physical,
    CASE WHEN place = 'own' THEN (SELECT max(132539328000000000 + 10000000 * ascii(lang)) FROM d WHERE owner = 'T:\' || lang) ELSE 132539328000000000 + 10000000 * regexp_extract(owner, 'Doc-([0-9]+)', 1)::BIGINT END AS ticks
  FROM homes WHERE place <> 'omitted'
), weights AS (
  SELECT *, unnest(range(1, len(parts) + CASE WHEN place = 'file' THEN 0 ELSE 1 END)) AS n FROM things
), tops AS (
  SELECT array_to_string(parts[1:n], '\') AS path, sum(size)::BIGINT AS size, sum(physical)::BIGINT AS physical, (count(*) FILTER (place <> 'empty')) AS files, (count(*) FILTER (place <> 'file')) - 1 AS folders FROM weights GROUP BY ALL
), laid AS (
  SELECT t.path, t.parts, t.parts[1:len(t.parts) - 1] AS parent, t.parts[len(t.parts)] AS name, CASE WHEN len(t.parts) = 1 THEN 0 WHEN t.place = 'empty' THEN 5 ELSE 6 END AS shape, s.size, s.physical,
    CASE WHEN t.place = 'empty' THEN 0 ELSE s.files END AS files, CASE WHEN t.place = 'empty' THEN 0 ELSE s.folders END AS folders, '' AS attributes, t.ticks, CASE WHEN len(t.parts) = 1 THEN '0x00000002' ELSE '0x00000004' END AS kind
  FROM things t JOIN tops s USING (path) WHERE t.place <> 'file'
  UNION ALL SELECT path || '\<folder entry>', parts || ['<folder entry>'], parts, '<folder entry>', 3, size, physical, 0, 0, '', ticks, '0x00000008' FROM things WHERE place = 'own'
  UNION ALL SELECT path, parts, parts[1:len(parts) - 1], parts[len(parts)], 4, size, physical, 0, 0, 'A', ticks, '0x00000008' FROM things WHERE place = 'file'
), classed AS (
  SELECT *, CASE WHEN shape = 0 THEN 0 WHEN len(parent) = 1 THEN CASE shape WHEN 6 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 4 END ELSE CASE shape WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 3 ELSE 4 END END AS class FROM laid
), places AS (
  SELECT *, format('{:012X}', class * 1099511627776 + row_number() OVER (PARTITION BY parent, class ORDER BY physical DESC, name, size DESC, ticks) - 1) AS own_key FROM classed
), walked AS (
  SELECT path, own_key AS order_key, parts, shape FROM places WHERE shape = 0
  UNION ALL SELECT p.path, w.order_key || '.' || p.own_key, p.parts, p.shape FROM places p JOIN walked w ON p.parent = w.parts AND w.shape IN (0, 6)
), newest AS (SELECT max(ticks) AS newest FROM things WHERE place = 'own'),
treemap AS (
  SELECT '' AS order_key, 'Texts' AS name, sum(files)::BIGINT AS files, (sum(folders) + count(*))::BIGINT AS folders, sum(size)::BIGINT AS size, sum(physical)::BIGINT AS physical, '' AS attributes, any_value(newest) AS ticks, '0x10000001' AS kind FROM places, newest WHERE shape = 0
  UNION ALL SELECT w.order_key, CASE WHEN p.shape = 0 THEN p.path || '\' ELSE p.path END, files, folders, size, physical, attributes, CASE WHEN p.shape = 0 THEN newest ELSE ticks END, kind FROM places p JOIN walked w USING (path), newest
)"""


def treemap() -> str:
    """The rows of the texts store's treemap under the file's column names."""
    return f"""WITH RECURSIVE {TEXTS}, {TREEMAP} SELECT order_key, name AS "Name", files AS "Files", folders AS "Folders", size AS "Logical Size", physical AS "Physical Size", attributes AS "Attributes", {stamp('ticks', 'T', False)} AS "Last Change", kind AS "WinDirStat Attributes", '0x0000000000000000' AS "Index" FROM treemap"""


def orders(select: str) -> str:
    return f"WITH RECURSIVE {ORDERS} {select}"


def texts(select: str) -> str:
    return f"WITH RECURSIVE {TEXTS} {select}"


def golden(columns: str, rows: list[tuple]) -> str:
    """Expected results worked out by hand."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})"


#: paths of the pages: host and path without scheme, query and fragment
PAGES = r"""
p AS (SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS parts, strlen(html) AS size FROM pages),
q AS (SELECT page_id, list_filter(parts, lambda x: x <> '') AS parts, size FROM p),
leaves AS (SELECT page_id, ['P:'] || parts || ['page-' || page_id] AS parts, size FROM q),
prefixes AS (SELECT unnest(list_transform(range(1, len(parts)), lambda n: array_to_string(parts[1:n], '\'))) AS path, unnest(range(1, len(parts))) AS depth, size FROM leaves),
sums AS (SELECT lower(path) AS key, depth, sum(size)::BIGINT AS size, count(*) AS files FROM prefixes GROUP BY ALL),
folders AS (SELECT s.*, (SELECT count(*) FROM sums c WHERE c.key LIKE replace(replace(s.key, '_', '\_'), '%', '\%') || '$%' ) AS dummy FROM sums s)"""

PAGE_SUMS = PAGES[: PAGES.rindex(",\nfolders AS")]
