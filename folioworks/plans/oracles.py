"""The same queries as plain SQL for DuckDB, over the same tables. Views are common table expressions."""

from __future__ import annotations

from folioworks import messages as M
from folioworks.plans.views import AS_OF_US, BLOCK_DOCS, EPOCH_US, HOUR_US

STALE_US = 6 * HOUR_US
SPACE = r"[\t-\r\x1c-\x20]"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TERMINAL = quoted(M.TERMINAL)


def base(x: str) -> str:
    return f"coalesce(list_filter(string_split({x}, '/'), lambda p: p NOT IN ('', '.'))[-1], '')"


def ext(x: str) -> str:
    return rf"lower(regexp_extract({base(x)}, '(?s)^.+\.([^.]+)$', 1))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def stem(x: str) -> str:
    return strip(rf"coalesce(nullif(regexp_extract({base(x)}, '(?s)^(.+)\.[^.]+$', 1), ''), {base(x)})")


def title_of(x: str) -> str:
    return f"CASE WHEN {stem(x)} <> '' THEN {stem(x)} ELSE {strip(x)} END"


def norm(x: str, punctuation: bool) -> str:
    folded = f"replace(lower({x}), 'ß', 'ss')"
    if punctuation:
        folded = rf"regexp_replace({folded}, '\p{{P}}', ' ', 'g')"
    return rf"trim(regexp_replace({folded}, '\s+', ' ', 'g'))"


def uuid5(x: str) -> str:
    digest = f"sha1(unhex('{M.DOCUMENT_NAMESPACE.replace('-', '')}') || encode({x}))"
    return (f"concat(substr({digest},1,8),'-',substr({digest},9,4),'-5',substr({digest},14,3),'-',"
            f"translate(substr({digest},17,1),'0123456789abcdef','89ab89ab89ab89ab'),substr({digest},18,3),'-',"
            f"substr({digest},21,12))")


ENTRY_FULL_ROW = ("l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
                  "l_linestatus, l_shipdate")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"""
        SELECT d.doc_id, lang, source, quality, toxic, n_chars, doc_id // {BLOCK_DOCS} AS block,
               CASE WHEN lang = 'de' THEN 'pdf' ELSE 'docx' END AS file_ext,
               concat('Guide_', list_max(string_split_regex(text, '\\s+')), ' (', source, ').',
                      CASE WHEN lang = 'de' THEN 'pdf' ELSE 'docx' END) AS file_name,
               octet_length(encode(text))::BIGINT AS size_bytes, sha256(text) AS content_hash
        FROM documents d LEFT JOIN labels USING (doc_id)"""),
    "cand": (("docs",), f"""
        SELECT doc_id::VARCHAR AS staged_id, lang AS organization_id, concat(lang, '-', block) AS batch_id, block, source,
               concat(lang, '-', source, '-', CASE WHEN quality IS NULL THEN block::VARCHAR ELSE 'd' || doc_id END)
                   AS source_file_id,
               CASE WHEN quality IS NULL THEN concat('d', doc_id, '_', file_name) END AS source_entry_name,
               CASE WHEN quality IS NULL THEN (doc_id - block * {BLOCK_DOCS})::INTEGER END AS entry_index,
               file_name, file_ext, size_bytes, content_hash,
               concat('staging/', lang, '/', lang, '-', block, '/', lang, '-', source, '-',
                      CASE WHEN quality IS NULL THEN block::VARCHAR ELSE 'd' || doc_id END, '/',
                      CASE WHEN quality IS NULL THEN lpad((doc_id - block * {BLOCK_DOCS})::VARCHAR, 4, '0') ELSE '0000' END,
                      '_', file_name) AS full_key,
               CASE WHEN coalesce(toxic, 0) = 1 OR source = 'src11' THEN NULL ELSE full_key END AS s3_key,
               CASE WHEN coalesce(toxic, 0) = 1 OR source = 'src11' THEN 'rejected' ELSE 'processed' END AS status,
               CASE WHEN source = 'src11' THEN '{M.ARCHIVE_REJECTED}' WHEN toxic = 1 THEN '{M.FILE_DAMAGED}' END
                   AS reject_reason,
               {title_of('file_name')} AS proposed_title, {norm(title_of('file_name'), True)} AS title_norm
        FROM docs WHERE quality IS NULL OR quality = 0"""),
    "files": (("cand",), f"""
        SELECT file_id, organization_id, batch_id, source, is_archive,
               CASE WHEN is_archive THEN concat(source, '-', block, '.zip') ELSE nm END AS file_name, size_bytes, status,
               CASE WHEN source = 'src7' AND organization_id = 'es' THEN '{M.CANCELLED}'
                    WHEN source = 'src7' AND organization_id = 'en' THEN '{M.ATTEMPTS_SPENT}'
                    WHEN source = 'src11' THEN '{M.DAMAGED}' END AS status_message,
               entries_total, CASE WHEN status = 'processing' THEN 1 ELSE entries_total END AS entries_done,
               {EPOCH_US} + block * {HOUR_US} AS created_us
        FROM (SELECT *, CASE WHEN source IN ('src3', 'src13') THEN 'processing' WHEN source = 'src17' THEN 'uploaded'
                             WHEN source = 'src7' THEN 'error' WHEN source = 'src11' THEN 'rejected'
                             WHEN rejected > 0 THEN 'partial' ELSE 'processed' END AS status
              FROM (SELECT source_file_id AS file_id, any_value(organization_id) AS organization_id,
                           any_value(batch_id) AS batch_id, any_value(block) AS block, any_value(source) AS source,
                           bool_or(entry_index IS NOT NULL) AS is_archive, min(file_name) AS nm,
                           sum(size_bytes)::BIGINT AS size_bytes, count(*)::INTEGER AS entries_total,
                           count(*) FILTER (WHERE status = 'rejected') AS rejected
                    FROM cand GROUP BY source_file_id))"""),
    "lib": (("docs",), f"""
        SELECT concat('lib-', doc_id) AS document_id, lang AS organization_id, title, title_norm, file_name,
               {norm('file_name', False)} AS file_name_norm, file_ext, size_bytes, content_hash,
               concat(lang, '-', source, '-', block) AS source_file_id,
               CASE WHEN toxic = 1 THEN 'archived' ELSE 'active' END AS status,
               CASE WHEN toxic = 1 THEN 'HIGH' WHEN n_chars > 8000 THEN 'MEDIUM' WHEN n_chars > 2000 THEN 'LOW'
                    WHEN n_chars > 300 THEN 'CONFIRMATORY' END AS highest_risk,
               n_chars // 1000 AS open_findings, {EPOCH_US - 720 * HOUR_US} + block * {HOUR_US} AS added_us
        FROM (SELECT *, {title_of('file_name')} AS title, {norm(title_of('file_name'), True)} AS title_norm
              FROM docs WHERE quality = 1)
        QUALIFY row_number() OVER (PARTITION BY lang, title_norm ORDER BY doc_id) = 1"""),
    "by_hash": (("lib",), "SELECT organization_id, content_hash, min(document_id) AS hash_doc FROM lib GROUP BY ALL"),
    "by_title": (("lib",), "SELECT organization_id, title_norm, min(document_id) AS title_doc FROM lib GROUP BY ALL"),
    "marked": (("cand", "by_hash", "by_title"), """
        SELECT c.*, CASE WHEN status = 'processed' THEN coalesce(hash_doc, title_doc) END AS duplicate_of_document_id,
               CASE WHEN status = 'processed' AND hash_doc IS NOT NULL THEN 'same_content'
                    WHEN status = 'processed' AND title_doc IS NOT NULL THEN 'same_title' END AS duplicate_kind
        FROM cand c LEFT JOIN by_hash USING (organization_id, content_hash)
                    LEFT JOIN by_title USING (organization_id, title_norm)"""),
    "counts": (("cand",), """
        SELECT source_file_id, count(*) AS total, count(*) FILTER (WHERE status = 'rejected') AS rejected,
               count(*) FILTER (WHERE status = 'processed') AS processed FROM cand GROUP BY 1"""),
    "bstat": (("files", "marked"), f"""
        SELECT f.batch_id, count(DISTINCT file_id) AS files,
               count(DISTINCT CASE WHEN f.status NOT IN ({TERMINAL}) THEN file_id END) AS in_progress,
               count(staged_id) FILTER (WHERE f.status IN ({TERMINAL})) AS pending_review,
               count(staged_id) FILTER (WHERE f.status IN ({TERMINAL}) AND m.status = 'processed'
                                        AND duplicate_of_document_id IS NULL) AS ready_to_add
        FROM files f LEFT JOIN marked m ON m.source_file_id = f.file_id GROUP BY 1"""),
    "fin": (("cand", "files"), f"""
        SELECT c.*, f.created_us AS file_created_us FROM cand c JOIN files f ON f.file_id = c.source_file_id
        WHERE f.status IN ({TERMINAL})"""),
    "queue": (("fin", "by_hash", "by_title"), """
        SELECT c.*, hash_doc, title_doc, row_number() OVER (PARTITION BY organization_id ORDER BY block, batch_id,
                   file_created_us, source_file_id, entry_index NULLS FIRST, source_entry_name, staged_id) AS n
        FROM fin c LEFT JOIN by_hash USING (organization_id, content_hash)
                   LEFT JOIN by_title USING (organization_id, title_norm)
        WHERE status = 'processed'"""),
    # One candidate at a time per organization, carrying what has been added so far.
    "greedy": (("queue",), """
        SELECT organization_id, 0::BIGINT AS n, NULL::VARCHAR AS staged_id, NULL::VARCHAR AS reason, false AS added,
               []::VARCHAR[] AS hashes, []::VARCHAR[] AS batches, []::VARCHAR[] AS titles
        FROM queue GROUP BY organization_id
        UNION ALL
        SELECT organization_id, n, staged_id, reason, reason IS NULL,
               CASE WHEN reason IS NULL THEN list_append(hashes, content_hash) ELSE hashes END,
               CASE WHEN reason IS NULL THEN list_append(batches, batch_id) ELSE batches END,
               CASE WHEN reason IS NULL THEN list_append(titles, title_norm) ELSE titles END
        FROM (SELECT q.*, g.hashes, g.batches, g.titles,
                     CASE WHEN hash_doc IS NOT NULL THEN '%s'
                          WHEN list_contains(g.hashes, q.content_hash) THEN
                              CASE WHEN g.batches[list_position(g.hashes, q.content_hash)] = q.batch_id THEN '%s'
                                   ELSE '%s' END
                          WHEN title_doc IS NOT NULL OR list_contains(g.titles, q.title_norm) THEN '%s' END AS reason
              FROM greedy g JOIN queue q ON q.organization_id = g.organization_id AND q.n = g.n + 1)""" % (
        M.ALREADY_IN_LIBRARY, M.SAME_FILE_IN_BATCH, M.ALREADY_IN_LIBRARY, M.TITLE_IN_LIBRARY)),
    "decided": (("greedy", "queue"), f"""
        SELECT q.*, g.reason, CASE WHEN g.added THEN 'added' ELSE 'skipped' END AS outcome,
               {uuid5('q.staged_id')} AS document_id,
               concat('processed/', q.organization_id, '/', document_id, '/v1_', file_name) AS document_key
        FROM queue q JOIN greedy g ON g.organization_id = q.organization_id AND g.n = q.n"""),
    "unfinished": (("files",), f"""
        SELECT batch_id, count(*) FILTER (WHERE status NOT IN ({TERMINAL})) AS still_in_progress
        FROM files GROUP BY 1"""),
    "ent": ((), f"""
        SELECT l_orderkey AS archive, l.*, CASE l_suppkey % 10 WHEN 0 THEN 'txt' WHEN 1 THEN '' WHEN 2 THEN 'pdf'
                   ELSE 'docx' END AS e,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {ENTRY_FULL_ROW}) - 1 AS pos,
               concat(CASE WHEN l_partkey % 97 = 0 THEN '../' WHEN l_linenumber = 1 THEN 'a/' WHEN l_linenumber = 2
                           THEN 'a/b/' WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN '__MACOSX/' ELSE '' END,
                      CASE WHEN l_partkey % 40 = 1 THEN '.' ELSE '' END, 'p', l_partkey % 50,
                      CASE WHEN e = '' THEN '' ELSE '.' END, e) AS name,
               floor(l_extendedprice)::BIGINT AS size,
               floor(l_extendedprice / CASE WHEN l_partkey % 89 = 0 THEN 250 ELSE 4 END)::BIGINT AS csize,
               CASE WHEN (l_partkey + l_suppkey) % 83 = 0 THEN 1 ELSE 0 END AS flags, l_partkey % 61 = 0 AS crc_error,
               CASE WHEN l_quantity = 7 THEN 'unknown' ELSE e END AS detected
        FROM lineitem l"""),
    "guarded": (("ent",), """
        SELECT archive, count(*) AS n_entries, sum(size)::BIGINT AS total_bytes,
               CASE WHEN count(*) > 10 THEN concat(count(*), ' files; limit is 10')
                    WHEN sum(size) > 400000 THEN '%s' ELSE arg_min(bad, pos) FILTER (WHERE bad IS NOT NULL) END AS reason
        FROM (SELECT *, CASE WHEN csize <> 0 AND size / csize > 200 THEN concat('''', name, ''' has an implausible compression ratio')
                    WHEN name LIKE '/%%' OR list_contains(string_split(replace(name, chr(92), '/'), '/'), '..')
                         OR regexp_matches(name, '^[A-Za-z]:') THEN concat('''', name, ''' has an unsafe path')
                    WHEN flags & 1 = 1 THEN concat('''', name, ''' is encrypted')
                    WHEN row_number() OVER (PARTITION BY archive, name ORDER BY pos) > 1
                         THEN concat('''', name, ''' appears more than once') END AS bad FROM ent)
        GROUP BY archive""" % M.TOO_LARGE_UNPACKED),
    "visible": (("ent", "guarded"), f"""
        SELECT e.*, row_number() OVER (PARTITION BY archive ORDER BY pos) - 1 AS entry_index, {base('name')} AS file_name,
               {ext('name')} AS x,
               CASE WHEN len(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.'))) - 1 > 1 THEN '{M.TOO_DEEP}'
                    WHEN {ext('name')} = '' THEN '{M.NO_EXTENSION}'
                    WHEN {ext('name')} NOT IN ('docx', 'pdf') THEN concat('.', {ext('name')}, ' is not supported') END
                   AS entry_reason
        FROM ent e JOIN guarded g USING (archive)
        WHERE g.reason IS NULL AND NOT list_contains(string_split(name, '/')[:-2], '__MACOSX')
              AND NOT starts_with({base('name')}, '.')"""),
    "broken": (("visible",), f"""
        SELECT archive, min(entry_index) AS cut, arg_min(concat('''', name, ''' does not match its index ({M.BAD_CRC} for file ''',
               name, ''')'), entry_index) AS told FROM visible WHERE entry_reason IS NULL AND crc_error GROUP BY 1"""),
    "kept": (("visible", "broken"), f"""
        SELECT v.*, CASE WHEN entry_reason IS NOT NULL THEN entry_reason
                         WHEN detected <> x THEN concat('File content does not match .', x, ' — it appears to be ', detected)
                         WHEN cut IS NOT NULL THEN concat('{M.ARCHIVE_REJECTED}: ', told) END AS reject_reason
        FROM visible v LEFT JOIN broken USING (archive) WHERE cut IS NULL OR entry_index < cut"""),
    "checked": (("ent",), f"""
        SELECT archive, name, CASE
            WHEN len(list_filter(string_split(name, '/'), lambda p: p <> '')) - 1 > 1 THEN '{M.TOO_DEEP}'
            WHEN e = '' THEN 'Files without an extension are not supported.'
            WHEN e NOT IN ('docx', 'pdf') THEN concat('.', e, ' is not supported inside a ZIP.')
            WHEN e = 'pdf' AND l_discount = 0 THEN 'File is empty.'
            WHEN e = 'pdf' AND NOT l_tax < 0.07 THEN 'The PDF file is corrupted or invalid.' END AS problem
        FROM ent WHERE NOT contains(name, '__MACOSX/') AND NOT starts_with(string_split(name, '/')[-1], '.')"""),
    "ev": ((), """
        SELECT *, epoch_us(ts) AS ts_us, event_id AS seq, (props->>'$.k')::INTEGER AS k,
               concat(user_id, '-', date_diff('day', DATE '2024-01-01', ts::DATE) // 3) AS file_id FROM events"""),
    "life": (("ev",), """
        SELECT file_id, ts, ts_us, seq, row_number() OVER (PARTITION BY file_id ORDER BY ts_us, seq) AS n,
               CASE event_type WHEN 'signup' THEN CASE WHEN k < 5 THEN 'cancel' WHEN k < 15 THEN 'uploading' ELSE 'confirm' END
                    WHEN 'view' THEN 'claim' WHEN 'click' THEN CASE WHEN k >= 50 THEN 'progress' ELSE 'heartbeat' END
                    WHEN 'purchase' THEN 'finish' ELSE 'release' END AS kind,
               CASE WHEN event_type <> 'signup' THEN concat('w', k % 2) END AS token,
               CASE WHEN event_type = 'purchase' THEN CASE WHEN k < 60 THEN 'processed' WHEN k < 70 THEN 'partial'
                    WHEN k < 85 THEN 'rejected' ELSE 'error' END END AS status,
               CASE WHEN event_type = 'purchase' AND k >= 70 THEN concat('reason ', k) END AS message,
               CASE WHEN event_type = 'click' AND k >= 50 THEN 500 END AS entries_total,
               CASE WHEN event_type = 'click' AND k >= 50 THEN floor(value)::INTEGER END AS entries_done,
               CASE WHEN event_type = 'click' AND k >= 75 THEN 'zip' END AS detected_type
        FROM ev"""),
    # One event at a time per file.
    "walk": (("life",), f"""
        SELECT file_id, 0::BIGINT AS n, 0::BIGINT AS seq, NULL::BIGINT AS ts_us, NULL::VARCHAR AS kind,
               NULL::VARCHAR AS tok, 'staged' AS status, NULL::VARCHAR AS status_message, 0 AS attempt_count,
               NULL::VARCHAR AS claim_token, NULL::BIGINT AS heartbeat_us, NULL::BIGINT AS uploaded_us,
               NULL::INTEGER AS entries_total, 0 AS entries_done, NULL::VARCHAR AS detected_type, false AS hit
        FROM life GROUP BY file_id
        UNION ALL
        SELECT file_id, n, seq, ts_us, kind, tok,
               CASE WHEN NOT hit THEN status WHEN kind = 'uploading' THEN 'uploading' WHEN kind IN ('confirm', 'release')
                    THEN 'uploaded' WHEN kind = 'cancel' THEN 'error' WHEN kind = 'claim' THEN 'processing'
                    WHEN kind = 'finish' THEN new_status ELSE status END,
               CASE WHEN hit AND kind = 'cancel' THEN '{M.CANCELLED}' WHEN hit AND kind = 'finish' THEN message
                    ELSE status_message END,
               attempt_count + CASE WHEN hit AND kind = 'claim' THEN 1 ELSE 0 END,
               CASE WHEN hit AND kind = 'claim' THEN tok WHEN hit AND kind IN ('finish', 'release') THEN NULL
                    ELSE claim_token END,
               CASE WHEN hit AND kind IN ('claim', 'heartbeat', 'progress') THEN ts_us ELSE heartbeat_us END,
               CASE WHEN hit AND kind IN ('confirm', 'release') THEN ts_us ELSE uploaded_us END,
               CASE WHEN hit AND kind = 'progress' THEN coalesce(new_total, entries_total) ELSE entries_total END,
               CASE WHEN hit AND kind = 'progress' THEN coalesce(new_done, entries_done) ELSE entries_done END,
               CASE WHEN hit AND kind = 'progress' THEN coalesce(new_type, detected_type) ELSE detected_type END, hit
        FROM (SELECT w.file_id, l.n, l.seq, l.ts_us, l.kind, l.token AS tok, w.status, w.status_message, w.attempt_count,
                     w.claim_token, w.heartbeat_us, w.uploaded_us, w.entries_total, w.entries_done, w.detected_type,
                     l.status AS new_status, l.message, l.entries_total AS new_total, l.entries_done AS new_done,
                     l.detected_type AS new_type,
                     coalesce(CASE WHEN l.kind = 'uploading' THEN w.status = 'staged'
                          WHEN l.kind IN ('confirm', 'cancel') THEN w.status IN ('staged', 'uploading')
                          WHEN l.kind = 'claim' THEN w.attempt_count < 3 AND (w.status = 'uploaded' OR
                               (w.status = 'processing' AND w.heartbeat_us < l.ts_us - {STALE_US}))
                          ELSE w.status = 'processing' AND w.claim_token = l.token END, false) AS hit
              FROM walk w JOIN life l ON l.file_id = w.file_id AND l.n = w.n + 1)"""),
    "state": (("walk", "life"), """
        SELECT w.*, s.events, s.created_us, s.last_us FROM walk w JOIN (
            SELECT file_id, count(*) AS events, min(ts_us) AS created_us, max(ts_us) AS last_us FROM life GROUP BY 1) s
        ON s.file_id = w.file_id AND s.events = w.n"""),
    "spans": (("walk",), """
        SELECT file_id, seq, ts_us AS from_us, (SELECT min(x.ts_us) FROM walk x WHERE x.file_id = w.file_id AND x.n > w.n
               AND x.hit AND x.kind IN ('claim', 'finish', 'release')) AS to_us
        FROM walk w WHERE hit AND kind = 'claim'"""),
    "log": (("ev",), """
        SELECT ts, ts_us, CASE WHEN event_type = 'error' THEN 'warning' ELSE 'info' END AS level,
               CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'view' THEN CASE WHEN k < 60 THEN 'claim_ok' ELSE 'claim_lost' END
                    WHEN 'click' THEN CASE WHEN k < 80 THEN 'entry_staged' ELSE 'entry_rejected' END
                    WHEN 'purchase' THEN 'finished' ELSE CASE WHEN k < 50 THEN 'retrying' WHEN k < 75 THEN 'stale_sweep'
                    ELSE 'reconcile_sweep' END END AS event,
               event_type = 'error' AND k >= 50 AS sweep, k % 2 AS pid,
               CASE WHEN event_type = 'error' AND k >= 50 THEN NULL ELSE file_id END AS file_id,
               CASE WHEN event_type = 'view' THEN concat('t', floor(value)::INTEGER) END AS task_id,
               CASE WHEN event_type <> 'signup' AND NOT (event_type = 'error' AND k >= 50) THEN k % 3 + 1 END AS attempt,
               CASE WHEN event_type = 'click' THEN floor(value)::INTEGER END AS entry_index,
               CASE WHEN event_type = 'error' AND k < 40 THEN (2 ^ (k % 3 + 1) * 5)::INTEGER
                    WHEN event_type = 'error' AND k < 50 THEN 7 END AS countdown,
               CASE WHEN event_type = 'error' AND k >= 50 THEN [file_id, concat(user_id + 1, '-', split_part(file_id, '-', 2))]
                    END AS file_ids,
               CASE WHEN event_type = 'error' AND k BETWEEN 50 AND 74 THEN k % 4 END AS reset,
               CASE WHEN event_type = 'error' AND k >= 75 THEN k % 5 END AS requeued,
               CASE WHEN event_type = 'error' AND k >= 50 THEN k % 3 END AS errored,
               CASE WHEN event_type = 'error' AND k >= 50 THEN k % 2 END AS enqueue_failed
        FROM ev WHERE NOT (k = 99 AND event_type = 'click')"""),
    "delay": (("log",), """
        SELECT file_id, c AS confirmed_us, min(ts_us) AS claimed_us, min(ts_us) - c AS delay_us,
               split_part(file_id, '-', 2) AS period
        FROM log JOIN (SELECT file_id, min(ts_us) AS c FROM log WHERE event = 'enqueued' GROUP BY 1) USING (file_id)
        WHERE event = 'claim_ok' AND ts_us >= c GROUP BY file_id, c"""),
    "writes": (("ev",), f"""
        SELECT file_id AS source_file_id,
               CASE WHEN event_type <> 'purchase' THEN concat('entry-', k % 6, '.docx') END AS source_entry_name,
               CASE WHEN event_type <> 'purchase' THEN k % 6 + CASE WHEN k > 90 THEN 1 ELSE 0 END END AS entry_index,
               CASE WHEN event_type = 'purchase' THEN 'scan.docx' ELSE concat('entry-', k % 6, '.docx') END AS file_name,
               'docx' AS file_ext, floor(value)::BIGINT AS size_bytes,
               CASE WHEN k <> 13 THEN sha256(seq::VARCHAR) END AS content_hash,
               CASE WHEN event_type <> 'error' OR k = 14 THEN concat('staging/', file_id, '/', k) END AS s3_key,
               CASE WHEN event_type <> 'error' THEN 'processed' ELSE 'rejected' END AS status,
               CASE WHEN event_type = 'error' AND k <> 15 THEN CASE WHEN k % 3 = 0 THEN '{M.FILE_DAMAGED}' || repeat(' x', 300)
                    ELSE '{M.FILE_DAMAGED}' END END AS reject_reason, seq, ts_us, concat('w', k % 2) AS token FROM ev"""),
    "judged": (("writes", "walk", "spans"), f"""
        SELECT w.*, coalesce(CASE
            WHEN status = 'processed' AND (s3_key IS NULL OR reject_reason IS NOT NULL) THEN 'processed needs a key and no reason'
            WHEN status = 'processed' AND content_hash IS NULL THEN 'processed needs a content hash'
            WHEN status = 'rejected' AND (s3_key IS NOT NULL OR reject_reason IS NULL) THEN 'rejected needs a reason and no key'
            WHEN (source_entry_name IS NULL) <> (entry_index IS NULL) THEN 'entry name and index go together' END,
            CASE WHEN NOT EXISTS (SELECT 1 FROM spans s JOIN walk c ON c.file_id = s.file_id AND c.seq = s.seq
                                  WHERE s.file_id = w.source_file_id AND c.tok = w.token AND s.from_us < w.ts_us
                                    AND (s.to_us IS NULL OR w.ts_us <= s.to_us)) THEN '{M.CLAIM_SUPERSEDED}' END) AS error
        FROM writes w"""),
    "good": (("judged",), """
        SELECT * REPLACE (CASE WHEN length(reject_reason) > 512 THEN left(reject_reason, 511) || '…' ELSE reject_reason END AS reject_reason)
        FROM judged WHERE error IS NULL"""),
    "fails": (("ev",), """
        SELECT seq, file_id, k % 4 + 1 AS attempt, concat('failure ', k) AS detail,
               CASE WHEN k < 10 THEN 'not_found' WHEN k < 20 THEN 'config' WHEN k < 45 THEN 'transient' WHEN k < 50
                    THEN 'config' WHEN k < 60 THEN 'superseded' WHEN k < 65 THEN 'config' WHEN k < 70 THEN 'transient'
                    WHEN k < 75 THEN 'contract' WHEN k < 85 THEN 'transient' WHEN k < 95 THEN 'rejected' ELSE 'bug' END
                   AS failure_class FROM ev"""),
    "up": ((), """
        SELECT o_orderkey::VARCHAR AS request_id, o_orderkey AS position, 'org' AS organization_id,
               concat('c', o_custkey) AS batch_id,
               concat('Order ', o_custkey // 10, CASE o_orderpriority WHEN '1-URGENT' THEN '.docx' WHEN '2-HIGH' THEN '.PDF'
                      WHEN '3-MEDIUM' THEN '.zip' WHEN '5-LOW' THEN '.txt' ELSE '' END) AS file_name,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'docx' WHEN '2-HIGH' THEN 'pdf'
                      WHEN '3-MEDIUM' THEN 'zip' WHEN '5-LOW' THEN 'txt' ELSE '' END AS file_ext,
               (floor(o_totalprice / 10000) * 120000000)::BIGINT AS size_bytes, o_orderstatus AS phase,
               epoch_us(o_orderdate::TIMESTAMP) AS modified_us FROM orders"""),
    "upbatch": ((), """
        SELECT concat('c', c_custkey) AS batch_id, 'org' AS organization_id, 0::BIGINT AS created_by,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'committed' WHEN 'MACHINERY' THEN 'abandoned' ELSE 'in_progress'
               END AS status FROM customer WHERE c_mktsegment <> 'FURNITURE'"""),
    "uplib": (("up",), """
        SELECT lower(file_name) AS nm, size_bytes, min(concat('doc-', request_id)) AS duplicate_of FROM up
        WHERE phase = 'F' GROUP BY ALL"""),
    "admit": (("up", "uplib", "upbatch"), f"""
        SELECT u.request_id, u.batch_id, u.file_name, u.size_bytes, u.file_ext,
               CASE WHEN u.size_bytes > 5368709120 THEN 413 WHEN file_ext NOT IN ('docx', 'pdf', 'zip') THEN 400
                    WHEN duplicate_of IS NOT NULL OR b.status IN ('committed', 'abandoned') THEN 409 END AS http_status,
               CASE WHEN u.size_bytes > 5368709120 THEN 'File exceeds the 5120 MB limit for cloud uploads.'
                    WHEN file_ext NOT IN ('docx', 'pdf', 'zip') THEN concat('Unsupported file type: ', file_name)
                    WHEN duplicate_of IS NOT NULL THEN concat('Duplicate file — ', file_name, ' has already been uploaded.')
                    WHEN b.status IN ('committed', 'abandoned') THEN concat('Batch ', u.batch_id, ' is already ', b.status, '.')
                    END AS detail
        FROM up u LEFT JOIN uplib l ON l.nm = lower(u.file_name) AND l.size_bytes = u.size_bytes
                  LEFT JOIN upbatch b ON b.batch_id = u.batch_id WHERE phase <> 'F'"""),
    "obj": (("up",), """
        SELECT concat(CASE phase WHEN 'F' THEN 'staging' WHEN 'O' THEN 'incoming' ELSE 'other' END, '/org/', batch_id, '/',
               request_id, '_', file_name) AS key, size_bytes AS length, modified_us, size_bytes > 0 AS complete FROM up"""),
    "nm": ((), """
        SELECT concat('page-', page_id) AS id, url AS name FROM pages
        UNION ALL
        SELECT concat('part-', p_partkey), concat(CASE WHEN p_type = 'STANDARD' THEN '.' ELSE '' END, p_name,
               CASE p_type WHEN 'ECONOMY' THEN '.DOCX' WHEN 'SMALL' THEN '.tar.gz' WHEN 'PROMO' THEN ' .pdf '
                    WHEN 'LARGE' THEN '.htm' WHEN 'MEDIUM' THEN '.' ELSE '' END) FROM part"""),
    "packs": ((), """
        SELECT doc_id, lang, text, CASE WHEN toxic = 1 THEN 'corrupt' WHEN lang = 'en' THEN 'docx' WHEN lang = 'fr' THEN 'pdf'
               WHEN lang = 'de' THEN 'zip' ELSE 'unknown' END AS kind
        FROM documents LEFT JOIN labels USING (doc_id)"""),
}


def over(views: str, select: str) -> str:
    """`select` with the named views (and those they need) in front."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order) + " " + select


MISMATCH = "concat('File content does not match .', {d}, ' — it appears to be ', {t})"

ORACLES: dict[str, str] = {
    # sources and sinks
    "content_hash": "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS length FROM documents",
    "zip_index": """
        SELECT concat('doc', doc_id) AS archive, p::INTEGER AS entry_pos,
               CASE p WHEN 0 THEN concat('docs/doc', doc_id, '.docx') WHEN 1 THEN concat('docs/doc', doc_id, '.pdf')
                    ELSE concat('doc', doc_id, '.txt') END AS name,
               CASE p WHEN 1 THEN octet_length(encode(text)) + 5 WHEN 2 THEN octet_length(encode(text)) END::BIGINT AS plain_size
        FROM documents, unnest([0, 1, 2]) AS t(p)""",
    "zip_extract": """
        SELECT concat('doc', doc_id) AS archive, p::INTEGER AS entry_pos,
               CASE p WHEN 1 THEN sha256('%PDF-' || text) WHEN 2 THEN sha256(text) END AS plain_sha256,
               CASE p WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'unknown' END AS detected, false AS crc_error
        FROM documents, unnest([0, 1, 2]) AS t(p)""",
    "ingest_files": over("packs", f"""
        SELECT concat('doc', doc_id) AS file_id, kind AS detected_type,
               CASE WHEN zip AND kind = 'zip' THEN 'partial' WHEN NOT zip AND kind = 'docx' THEN 'processed' ELSE 'rejected' END AS status,
               CASE WHEN kind = 'corrupt' THEN CASE WHEN zip THEN '{M.DAMAGED}' ELSE '{M.FILE_DAMAGED}' END
                    WHEN zip AND kind <> 'zip' THEN {MISMATCH.format(d="'zip'", t='kind')}
                    WHEN NOT zip AND kind <> 'docx' THEN {MISMATCH.format(d="'docx'", t='kind')} END AS status_message,
               CASE WHEN zip AND kind = 'zip' THEN 3 END AS entries_total, CASE WHEN zip AND kind = 'zip' THEN 3 ELSE 0 END AS entries_done
        FROM (SELECT *, lang IN ('de', 'es') AS zip FROM packs)"""),
    "ingest_candidates": over("packs", """
        SELECT concat('doc', doc_id) AS source_file_id, NULL AS source_entry_name, NULL::INTEGER AS entry_index,
               concat('doc', doc_id, '.docx') AS file_name, 'docx' AS file_ext, 'processed' AS status, NULL AS reject_reason,
               concat('staging/', lang, '/b1/doc', doc_id, '/0000_doc', doc_id, '.docx') AS s3_key, NULL AS pdf_hash, NULL::BIGINT AS pdf_bytes
        FROM packs WHERE lang NOT IN ('de', 'es') AND kind = 'docx'
        UNION ALL
        SELECT concat('doc', doc_id), concat(CASE WHEN p < 2 THEN 'docs/' ELSE '' END, f), p, f, e,
               CASE WHEN p < 2 THEN 'processed' ELSE 'rejected' END, CASE WHEN p = 2 THEN '.txt is not supported' END,
               CASE WHEN p < 2 THEN concat('staging/', lang, '/b1/doc', doc_id, '/000', p, '_', f) END,
               CASE WHEN p = 1 THEN sha256('%PDF-' || text) END, CASE WHEN p = 1 THEN octet_length(encode(text)) + 5 END
        FROM (SELECT *, ['docx', 'pdf', 'txt'][p + 1] AS e, concat('doc', doc_id, '.', e) AS f
              FROM packs, unnest([0, 1, 2]) AS t(p) WHERE lang IN ('de', 'es') AND kind = 'zip')"""),
    "log_parse": over("log", "SELECT ts_us, level, event, pid, file_id, task_id, attempt, entry_index, countdown, "
                             "list_aggregate(file_ids, 'string_agg', ',') AS file_ids FROM log"),
    "commit_documents": over("decided", f"""
        SELECT document_id, organization_id, proposed_title AS title, title_norm, file_name,
               {norm('file_name', False)} AS file_name_norm, document_key AS s3_key, file_ext, size_bytes, content_hash,
               source_file_id FROM decided WHERE outcome = 'added'"""),
    "commit_audit": over("decided unfinished", """
        SELECT any_value(organization_id) AS organization_id, batch_id AS entity_id, 'batch_committed' AS action,
               count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
               any_value(still_in_progress) AS still_in_progress
        FROM decided JOIN unfinished USING (batch_id) GROUP BY batch_id"""),
    "commit_audit_items": over("decided", """
        SELECT batch_id AS entity_id, row_number() OVER (PARTITION BY batch_id ORDER BY n) AS position, staged_id, outcome,
               CASE WHEN outcome = 'added' THEN document_id END AS document_id, reason FROM decided"""),
    "commit_object_plan": over("decided", """
        SELECT 'copy' AS op, s3_key AS src, document_key AS dst FROM decided WHERE outcome = 'added'
        UNION ALL SELECT 'delete', s3_key, NULL FROM decided
        UNION ALL SELECT 'delete', document_key, NULL FROM decided WHERE outcome = 'skipped'"""),
    "purge_rejected": over("cand files", """
        SELECT full_key AS key FROM cand c JOIN files f ON f.file_id = c.source_file_id
        WHERE c.source <> 'src5' AND f.status = 'rejected' AND f.is_archive"""),
    "retention_expired": over("obj", f"""
        SELECT key, CASE WHEN NOT complete THEN 'abort-incomplete-multipart' WHEN key LIKE 'incoming/%' THEN 'expire-incoming'
               ELSE 'expire-staging' END AS rule FROM obj
        WHERE CASE WHEN NOT complete THEN 946684800000000 - modified_us >= 86400000000
                   WHEN key LIKE 'incoming/%' THEN 946684800000000 - modified_us >= 86400000000
                   WHEN key LIKE 'staging/%' THEN 946684800000000 - modified_us >= 7 * 86400000000 ELSE false END"""),
    "seed_files": over("obj", f"""
        SELECT {base('key')} AS file_name, {ext('key')} AS file_ext, length AS size_bytes, key AS s3_key,
               {ext('key')} = 'zip' AS is_archive,
               CASE WHEN {ext('key')} NOT IN ('docx', 'pdf', 'zip') THEN
                        concat('''', {base('key')}, ''': extension not allowed (allowed: docx, pdf, zip)')
                    WHEN key NOT LIKE 'incoming/%' THEN concat('''', key, ''': s3_key must be under incoming/') END AS error
        FROM obj"""),
    # predicates and projections
    "admission": over("admit", "SELECT request_id, http_status, detail FROM admit"),
    "register_uploads": over("admit", """
        SELECT request_id AS file_id, batch_id, file_name, file_ext, file_ext = 'zip' AS is_archive,
               concat('incoming/org/', batch_id, '/', request_id, '_', file_name) AS s3_key
        FROM admit WHERE http_status IS NULL"""),
    "file_ext": over("nm", f"SELECT id, {ext('name')} AS ext FROM nm"),
    "client_ext": over("nm", f"""
        SELECT id, CASE WHEN x = 'htm' THEN 'html' ELSE x END AS ext FROM (
            SELECT id, lower(regexp_extract({strip('name')}, '(?i)\\.([a-z0-9]+)$', 1)) AS x FROM nm)"""),
    "object_keys": over("docs", f"""
        SELECT doc_id, concat('incoming/', lang, '/', source, '/', doc_id, '_', {base('file_name')}) AS incoming_key,
               concat('staging/', lang, '/', source, '/', doc_id, '/', lpad((doc_id * 7)::VARCHAR, greatest(4, length((doc_id * 7)::VARCHAR))::INTEGER, '0'),
                      '_', file_name) AS staging_key,
               concat('processed/', lang, '/', doc_id, '/v1_', file_name) AS processed_key,
               concat('s3://bucket/processed/', lang, '/', doc_id, '/v1_', file_name) AS location FROM docs"""),
    "part_plan": over("up", """
        SELECT request_id AS file_id, p AS part_number, (p - 1) * 536870912 AS start, least(p * 536870912, size_bytes) AS "end"
        FROM up, unnest(range(1, greatest(1, ceil(size_bytes / 536870912)::BIGINT) + 1)) AS t(p)"""),
    "upload_progress": """
        SELECT file_id, uploaded_bytes, total_bytes,
               CASE WHEN total_bytes > 0 THEN least(100, floor(uploaded_bytes / total_bytes * 100 + 0.5)::BIGINT) ELSE 100 END AS percent
        FROM (SELECT l_orderkey AS file_id, sum(floor(l_extendedprice)::BIGINT)::BIGINT AS total_bytes,
                     sum(CASE l_returnflag WHEN 'A' THEN floor(l_extendedprice)::BIGINT WHEN 'R' THEN floor(l_extendedprice)::BIGINT // 2
                         ELSE 0 END)::BIGINT AS uploaded_bytes FROM lineitem GROUP BY 1)""",
    "detect_magic": over("packs", """
        SELECT concat('doc', doc_id) AS path, CASE WHEN kind IN ('docx', 'corrupt') THEN 'zip' ELSE kind END AS magic FROM packs"""),
    "detect_full": over("packs", "SELECT concat('doc', doc_id) AS path, kind AS detected FROM packs"),
    "document_outcome": over("packs", f"""
        SELECT concat('doc', doc_id) AS path, CASE WHEN kind = 'docx' THEN 'processed' ELSE 'rejected' END AS status,
               CASE WHEN kind = 'corrupt' THEN '{M.FILE_DAMAGED}' WHEN kind <> 'docx' THEN {MISMATCH.format(d="'docx'", t='kind')} END
                   AS reason FROM packs"""),
    "mismatch_reason": over("ent", f"""
        SELECT e AS declared, detected, {MISMATCH.format(d='e', t='detected')} AS reason, count(*) AS entries
        FROM ent GROUP BY ALL"""),
    "folder_depth": over("ent", """
        SELECT archive, pos::INTEGER AS entry_pos, len(list_filter(string_split(name, '/'), lambda p: p NOT IN ('', '.'))) - 1 AS depth FROM ent"""),
    "archive_guard": over("guarded", "SELECT archive, n_entries, total_bytes, reason FROM guarded"),
    "archive_candidates": over("visible", """
        SELECT archive, entry_index::INTEGER AS entry_index, name, file_name,
               CASE WHEN entry_reason IS NULL THEN x ELSE left(x, 10) END AS file_ext, entry_reason FROM visible"""),
    "truncate_msg": """
        SELECT doc_id, CASE WHEN length(text) > 512 THEN concat(substr(text, 1, 511), '…') ELSE text END AS message FROM documents""",
    "candidate_validity": over("writes", """
        SELECT error, count(*) AS writes FROM (SELECT CASE
            WHEN status = 'processed' AND (s3_key IS NULL OR reject_reason IS NOT NULL) THEN 'processed needs a key and no reason'
            WHEN status = 'processed' AND content_hash IS NULL THEN 'processed needs a content hash'
            WHEN status = 'rejected' AND (s3_key IS NOT NULL OR reject_reason IS NULL) THEN 'rejected needs a reason and no key'
            WHEN (source_entry_name IS NULL) <> (entry_index IS NULL) THEN 'entry name and index go together' END AS error
            FROM writes) GROUP BY 1"""),
    "list_uploads": over("state", """
        SELECT concat('org-', split_part(file_id, '-', 1)::BIGINT // 50) AS organization_id, file_id,
               concat('scan ', split_part(file_id, '-', 1), '.docx') AS file_name, events * 1000 AS size_bytes, status, created_us
        FROM state WHERE status NOT IN ('staged', 'uploading')"""),
    "queue_validation": over("up", """
        SELECT *, error IS NULL AS startable FROM (SELECT u.position, u.file_name, CASE
            WHEN file_ext = '' THEN 'Unsupported file type. Supported formats: DOCX, PDF, ZIP.'
            WHEN file_ext NOT IN ('docx', 'pdf', 'zip') THEN concat('.', file_ext, ' is not a supported format')
            WHEN size_bytes = 0 THEN 'File is empty.'
            WHEN size_bytes > 5368709120 THEN 'File exceeds the maximum size of 5.0 GB.'
            WHEN EXISTS (SELECT 1 FROM up o WHERE lower(o.file_name) = lower(u.file_name) AND o.size_bytes = u.size_bytes
                         AND (o.phase = 'F' OR o.position < u.position))
                THEN concat('Duplicate file — ', file_name, ' is already in the upload queue.') END AS error
        FROM up u WHERE phase <> 'F')"""),
    "zip_precheck": over("ent checked", """
        SELECT archive, coalesce(usable, 0) AS usable, coalesce(warnings, 0) AS warnings,
               CASE WHEN coalesce(usable, 0) = 0 THEN 'The ZIP file does not contain any DOCX, PDF files that can be added.' END AS error,
               coalesce(usable, 0) > 0 AS archive_valid
        FROM (SELECT DISTINCT archive FROM ent) LEFT JOIN (
            SELECT archive, count(*) FILTER (WHERE problem IS NULL) AS usable, count(problem) AS warnings FROM checked GROUP BY 1)
        USING (archive)"""),
    "zip_precheck_entries": over("checked", """
        SELECT name, CASE WHEN problem IS NOT NULL THEN concat(name, ': ', problem) END AS warning, count(*) AS entries
        FROM checked GROUP BY ALL"""),
    "empty_docs": f"""
        SELECT concat('doc-', doc_id) AS id, {strip('text')} = '' AS empty,
               CASE WHEN {strip('text')} = '' THEN 'The document appears to be empty.' END AS error FROM documents
        UNION ALL SELECT concat('page-', page_id), {strip('html')} = '',
               CASE WHEN {strip('html')} = '' THEN 'The HTML file is empty.' END FROM pages
        UNION ALL SELECT concat('turn-', conv_id, '-', turn), {strip('text')} = '',
               CASE WHEN {strip('text')} = '' THEN 'The document appears to be empty.' END FROM conversations""",
    "status_label": over("files counts", f"""
        SELECT file_id, CASE WHEN status IN ('uploaded', 'processing') THEN
                   CASE WHEN coalesce(entries_total, 0) <> 0 THEN concat('Checking… — ', entries_done, ' of ', entries_total)
                        ELSE 'Checking…' END
               WHEN status = 'processed' THEN 'Ready'
               WHEN status = 'partial' THEN concat('Partly ready — ', processed, ' of ', total)
               WHEN status = 'rejected' THEN concat('Rejected — ', coalesce(status_message, 'not accepted'))
               WHEN status = 'error' AND status_message = '{M.CANCELLED}' THEN 'Cancelled'
               WHEN status = 'error' AND processed > 0 THEN concat('Failed part-way — ', processed, ' staged')
               ELSE concat('Failed — ', coalesce(status_message, 'could not be processed')) END AS label,
               CASE WHEN status IN ('uploaded', 'processing') THEN 'progress' WHEN status = 'processed' THEN 'success'
                    WHEN status = 'partial' THEN 'warning' WHEN status_message = '{M.CANCELLED}' THEN 'muted' ELSE 'danger' END AS tone
        FROM files JOIN counts ON source_file_id = file_id"""),
    "review_action": over("bstat", """
        SELECT batch_id, CASE WHEN ready_to_add > 0 THEN concat('Add ', ready_to_add, ' to library') WHEN pending_review > 0
               THEN 'Done' WHEN in_progress = 1 THEN 'Waiting for 1 file…' WHEN in_progress > 0 THEN
               concat('Waiting for ', in_progress, ' files…') ELSE '' END AS label,
               ready_to_add > 0 OR pending_review > 0 AS enabled, ready_to_add + pending_review + in_progress > 0 AS visible FROM bstat"""),
    "review_split": over("marked files", f"""
        SELECT m.batch_id, CASE WHEN m.status = 'rejected' THEN 'rejected' WHEN duplicate_of_document_id IS NOT NULL
               THEN 'duplicate' ELSE 'ready' END AS review_class, count(*) AS candidates
        FROM marked m JOIN files f ON f.file_id = m.source_file_id WHERE f.status IN ({TERMINAL}) GROUP BY ALL"""),
    "dup_errors": over("admit", "SELECT request_id, coalesce(contains(lower(detail), 'duplicate'), false) AS duplicate FROM admit"),
    # joins
    "dup_name_size": over("up uplib", """
        SELECT request_id, duplicate_of FROM up u LEFT JOIN uplib l ON l.nm = lower(file_name) AND l.size_bytes = u.size_bytes
        WHERE phase <> 'F'"""),
    "find_duplicate": over("marked", "SELECT staged_id, duplicate_of_document_id, duplicate_kind FROM marked"),
    "find_duplicate_union": over("marked", "SELECT staged_id, duplicate_of_document_id, duplicate_kind FROM marked"),
    "batch_staged": over("marked lib", """
        SELECT m.batch_id, m.staged_id, m.source_file_id, m.source_entry_name, m.entry_index, m.file_name, m.status,
               m.reject_reason, m.content_hash, m.duplicate_of_document_id, m.duplicate_kind, l.title AS duplicate_title
        FROM marked m LEFT JOIN lib l ON l.document_id = m.duplicate_of_document_id"""),
    "finished_candidates": over("fin", "SELECT staged_id, source_file_id, batch_id, status, file_created_us FROM fin"),
    "unknown_batches": over("up upbatch", "SELECT DISTINCT batch_id FROM up WHERE batch_id NOT IN (SELECT batch_id FROM upbatch)"),
    "fenced_writes": over("walk", """
        SELECT file_id, seq, kind, tok AS token, CASE WHEN hit THEN 'accepted' ELSE 'superseded' END AS result
        FROM walk WHERE kind IN ('heartbeat', 'progress', 'release', 'finish')"""),
    "upload_lookup": over("up", """
        SELECT request_id, CASE WHEN file_ext = 'txt' THEN NULL ELSE request_id END AS file_id,
               CASE WHEN file_ext = 'txt' THEN '404 Upload not found.' WHEN phase = 'O' THEN 'open' ELSE 'done' END AS result FROM up"""),
    "carry_counts": over("cand", """
        SELECT source_file_id, CASE WHEN p > 0 THEN p ELSE 0 END AS processed, CASE WHEN p > 0 THEN p ELSE t END AS total
        FROM (SELECT source_file_id, count(*) AS t, count(*) FILTER (WHERE status = 'processed') AS p FROM cand GROUP BY 1)"""),
    "confirm_to_claim": over("delay", "SELECT file_id, confirmed_us, claimed_us, delay_us FROM delay"),
    "orphan_objects": over("cand", """
        SELECT full_key AS key, 'missing' AS problem FROM cand WHERE source = 'src5' AND s3_key IS NOT NULL
        UNION ALL SELECT full_key, 'orphan' FROM cand WHERE source <> 'src5' AND s3_key IS NULL"""),
    "stopped_archives": over("files cand", f"""
        SELECT f.file_id AS source_file_id, count(*) AS staged FROM files f JOIN cand c ON c.source_file_id = f.file_id
        WHERE f.status = 'error' AND f.status_message IS DISTINCT FROM '{M.CANCELLED}' AND c.status = 'processed' GROUP BY 1"""),
    "purge_batch": over("files cand lib", """
        SELECT 'batches' AS "table", (SELECT count(DISTINCT batch_id) FROM files WHERE organization_id <> 'es') AS rows, 0::BIGINT AS unlinked
        UNION ALL SELECT 'files', count(*), 0 FROM files WHERE organization_id <> 'es'
        UNION ALL SELECT 'candidates', count(*), 0 FROM cand WHERE organization_id <> 'es'
        UNION ALL SELECT 'library', count(*), count(*) FILTER (WHERE source_file_id IN
            (SELECT file_id FROM files WHERE organization_id = 'es')) FROM lib"""),
    # aggregations
    "file_candidate_counts": over("counts", "SELECT * FROM counts"),
    "batch_status": over("bstat", "SELECT * FROM bstat"),
    "batch_files": over("files", """
        SELECT batch_id, file_id, file_name, status, entries_total, entries_done, status_message, created_us FROM files"""),
    "item_count": """
        SELECT p_brand AS result_id, sum(CASE p_type WHEN 'LARGE' THEN 0 WHEN 'PROMO' THEN 2 ELSE 1 END)::BIGINT AS items
        FROM part GROUP BY 1""",
    "dq_duplicate_candidates": over("writes", """
        SELECT source_file_id, source_entry_name, count(*) AS copies FROM writes GROUP BY ALL HAVING count(*) > 1"""),
    "dq_open_files": over("files", f"""
        SELECT batch_id, count(*) AS open_files FROM files WHERE status NOT IN ({TERMINAL}) GROUP BY 1"""),
    "latency_p95": over("delay", """
        SELECT period, n, delay_us AS percentile FROM (
            SELECT period, delay_us, count(*) OVER (PARTITION BY period) AS n,
                   row_number() OVER (PARTITION BY period ORDER BY delay_us, file_id) AS r FROM delay)
        WHERE r = greatest(1, round_even(95.0 / 100 * n + 0.5, 0)::BIGINT)"""),
    "latency_spread": over("delay", """
        SELECT period, median(delay_us)::DOUBLE AS median, min(delay_us) AS lowest, max(delay_us) AS highest FROM delay GROUP BY 1"""),
    "sweep_totals": over("log", """
        SELECT event, count(*) AS sweeps, coalesce(sum(reset), 0)::BIGINT AS reset, coalesce(sum(requeued), 0)::BIGINT AS requeued,
               coalesce(sum(errored), 0)::BIGINT AS errored, coalesce(sum(enqueue_failed), 0)::BIGINT AS enqueue_failed,
               len(list_distinct(flatten(list(file_ids)))) AS files FROM log WHERE sweep GROUP BY 1"""),
    "peak_concurrency": over("spans", """
        SELECT org AS organization_id, max(o)::BIGINT AS peak FROM (
            SELECT org, sum(d) OVER (PARTITION BY org ORDER BY t, d, id ROWS UNBOUNDED PRECEDING) AS o FROM (
                SELECT concat('org-', split_part(file_id, '-', 1)::BIGINT // 50) AS org, concat(file_id, '/', seq) AS id,
                       unnest([1, -1]) AS d, unnest([from_us, to_us]) AS t FROM spans) WHERE t IS NOT NULL) GROUP BY 1"""),
    "claim_counts": over("log", """
        SELECT file_id, count(*) FILTER (WHERE event = 'claim_ok') AS won, count(*) FILTER (WHERE event = 'claim_lost') AS lost,
               count(DISTINCT task_id) AS tasks FROM log WHERE event IN ('claim_ok', 'claim_lost') GROUP BY 1"""),
    "risk_distribution": over("lib", """
        SELECT highest_risk, count(*) AS documents, sum(open_findings)::BIGINT AS findings,
               round(count(*) * 100 / sum(count(*)) OVER (), 2) AS percent FROM lib WHERE highest_risk IS NOT NULL GROUP BY 1"""),
    "commit_summary": over("decided unfinished", f"""
        SELECT batch_id, still_in_progress, count(*) FILTER (WHERE outcome = 'added') AS added,
               count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
               count(*) FILTER (WHERE reason = '{M.ALREADY_IN_LIBRARY}') AS already_in_library,
               count(*) FILTER (WHERE reason = '{M.SAME_FILE_IN_BATCH}') AS same_file,
               count(*) FILTER (WHERE reason = '{M.TITLE_IN_LIBRARY}') AS title_in_library
        FROM unfinished LEFT JOIN decided USING (batch_id) GROUP BY ALL"""),
    "retry_check": over("log", """
        SELECT file_id, count(*) FILTER (WHERE event = 'claim_ok') AS claims, count(*) FILTER (WHERE event = 'retrying') AS retries,
               count(*) FILTER (WHERE event = 'retrying' AND countdown <> 2 ^ attempt * 5) AS wrong_backoffs,
               retries = claims - 1 AS as_expected FROM log WHERE event IN ('claim_ok', 'retrying') GROUP BY 1"""),
    # ordered work
    "archive_outcome": over("guarded visible broken kept", f"""
        SELECT g.archive, CASE WHEN reason IS NOT NULL OR cut IS NOT NULL THEN 'rejected' WHEN coalesce(r, 0) > 0 THEN 'partial'
                    ELSE 'processed' END AS status,
               CASE WHEN reason IS NOT NULL THEN concat('File is unsafe: ', reason) ELSE told END AS status_message,
               CASE WHEN reason IS NULL THEN coalesce(t, 0) END::INTEGER AS entries_total,
               coalesce(cut, t, 0)::INTEGER AS entries_done, coalesce(p, 0) AS processed, coalesce(r, 0) AS rejected
        FROM guarded g LEFT JOIN broken USING (archive)
        LEFT JOIN (SELECT archive, count(*) AS t FROM visible GROUP BY 1) USING (archive)
        LEFT JOIN (SELECT archive, count(*) FILTER (WHERE reject_reason IS NULL) AS p, count(reject_reason) AS r FROM kept GROUP BY 1)
        USING (archive)"""),
    "entry_outcomes": over("kept", """
        SELECT archive, entry_index::INTEGER AS entry_index, name, CASE WHEN reject_reason IS NULL THEN 'processed' ELSE 'rejected' END
               AS status, reject_reason FROM kept"""),
    "resume_entries": over("visible", """
        SELECT archive, entry_index::INTEGER AS entry_index, name FROM visible JOIN (
            SELECT l_orderkey AS archive, count(*) // 3 AS done FROM lineitem GROUP BY 1) USING (archive) WHERE entry_index >= done"""),
    "candidate_upsert": over("good", """
        SELECT source_file_id, source_entry_name, entry_index, file_name, size_bytes, status, reject_reason, content_hash, seq
        FROM (SELECT w.*, first(entry_index) OVER k AS i0, first(file_name) OVER k AS n0 FROM good w
              WINDOW k AS (PARTITION BY source_file_id, source_entry_name ORDER BY seq))
        WHERE entry_index IS NOT DISTINCT FROM i0 AND file_name = n0
        QUALIFY row_number() OVER (PARTITION BY source_file_id, source_entry_name ORDER BY seq DESC) = 1"""),
    "candidate_quarantine": over("judged", """
        SELECT seq, source_file_id, source_entry_name, status, error FROM judged WHERE error IS NOT NULL"""),
    "candidate_mismatch": over("good", """
        SELECT source_file_id, source_entry_name, entry_index, file_name, count(*) AS writes
        FROM (SELECT w.*, first(entry_index) OVER k AS i0, first(file_name) OVER k AS n0 FROM good w
              WINDOW k AS (PARTITION BY source_file_id, source_entry_name ORDER BY seq))
        WHERE NOT (entry_index IS NOT DISTINCT FROM i0 AND file_name = n0) GROUP BY ALL"""),
    "ingest_attempts": """
        WITH b AS (SELECT doc_id // 32 AS b, count(*) AS n FROM documents GROUP BY 1),
        k AS (SELECT *, (b % 8)::INTEGER AS kind, (1 + b // 8 % 3)::INTEGER AS attempt FROM b)
        SELECT 'box' || b AS file_id, attempt, CASE kind WHEN 2 THEN 'corrupt' WHEN 3 THEN 'pdf' WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'zip' END AS detected_type,
          CASE WHEN kind = 0 OR kind = 1 AND attempt = 3 THEN 'error' WHEN kind = 2 THEN 'rejected' WHEN kind > 2 THEN 'processed' END AS status,
          CASE WHEN kind = 0 THEN 'Uploaded object not found' WHEN kind = 2 THEN 'Archive is damaged'
               WHEN kind = 1 AND attempt = 3 THEN 'Could not be processed after 3 attempts: reading failed (OSError)' END AS status_message,
          CASE WHEN kind > 3 THEN n::INTEGER END AS entries_total,
          CASE WHEN kind > 3 THEN n::INTEGER WHEN kind = 1 AND attempt < 3 THEN NULL ELSE 0 END AS entries_done,
          CASE kind WHEN 0 THEN 'not_found' WHEN 1 THEN 'transient' END AS failure_class,
          CASE WHEN kind = 0 OR kind = 1 AND attempt = 3 THEN 'finish' WHEN kind = 1 THEN 'release_and_retry' END AS action,
          CASE WHEN kind = 1 AND attempt < 3 THEN (5 * 2 ** attempt)::BIGINT END AS countdown,
          CASE WHEN kind = 1 AND attempt < 3 THEN attempt + 1 END AS next_attempt,
          CASE WHEN kind = 1 AND attempt < 3 THEN 1704067200000000 + 31 * 24 * 3600000000 + (5 * 2 ** attempt)::BIGINT * 1000000 END AS due_us
        FROM k""",
    "stream_ingest": """
        SELECT 'box' || doc_id // 32 AS file_id, CASE doc_id // 32 % 8 WHEN 2 THEN 'corrupt' WHEN 3 THEN 'pdf' ELSE 'zip' END AS detected_type,
          CASE WHEN doc_id // 32 % 8 = 2 THEN 'rejected' ELSE 'processed' END AS status,
          CASE WHEN doc_id // 32 % 8 = 2 THEN 'Archive is damaged' END AS status_message,
          CASE WHEN doc_id // 32 % 8 > 3 THEN count(*)::INTEGER END AS entries_total,
          CASE WHEN doc_id // 32 % 8 > 3 THEN count(*)::INTEGER ELSE 0 END AS entries_done
        FROM documents WHERE doc_id // 32 % 8 > 1 GROUP BY doc_id // 32""",
    "ingest_resumed": """
        SELECT 'box' || doc_id // 32 AS source_file_id, 'docs/doc' || doc_id || '.pdf' AS source_entry_name,
          (row_number() OVER (PARTITION BY doc_id // 32 ORDER BY doc_id) - 1)::INTEGER AS entry_index, 'processed' AS status,
          sha256('%PDF-' || coalesce(text, '')) AS content_hash, 5 + octet_length(encode(coalesce(text, ''))) AS size_bytes, 1 AS times_read
        FROM documents WHERE doc_id // 32 % 8 > 3""",
    "object_plan_results": """
        WITH b AS (SELECT DISTINCT doc_id // 32 AS b FROM documents),
        k AS (SELECT b, b % 8 AS kind, 'box' || b || CASE WHEN b % 8 = 3 THEN '.pdf' ELSE '.zip' END AS file FROM b),
        p AS (SELECT 'copy' AS op, 'incoming/' || file AS src, 'processed/org' || b % 7 || '/v1_' || file AS dst, kind FROM k
              UNION ALL SELECT 'delete', 'incoming/' || file, NULL, kind FROM k)
        SELECT op, src, dst, CASE WHEN kind > 1 THEN 'done' WHEN op = 'copy' THEN 'failed' ELSE 'held back' END AS outcome,
          CASE WHEN op = 'copy' AND kind = 0 THEN 'NoSuchKey' WHEN op = 'copy' AND kind = 1 THEN 'OSError' END AS code,
          CASE WHEN kind > 1 THEN 'already done' WHEN op = 'copy' THEN 'failed' ELSE 'held back' END AS outcome_again,
          CASE WHEN op = 'copy' AND kind = 0 THEN 'NoSuchKey' WHEN op = 'copy' AND kind = 1 THEN 'OSError' END AS code_again
        FROM p""",
    # The scale the SQL is compared at; these two read the table files themselves.
    "src_manifest": "SELECT parse_filename(filename) AS name, size AS length FROM read_blob('/root/testdata/sf0.01/*.parquet')",
    "src_file_hash": "SELECT parse_filename(filename) AS name, sha256(content) AS sha256, size AS bytes_read "
                     "FROM read_blob('/root/testdata/sf0.01/*.parquet')",
    "resume_check": over("log", """
        SELECT file_id, resumed_at, killed_at_entry, resumed_at IN (killed_at_entry, killed_at_entry - 1) AS as_expected
        FROM (SELECT file_id, min(entry_index) AS resumed_at FROM log WHERE attempt = 2
              AND event IN ('entry_staged', 'entry_rejected') GROUP BY 1)
        JOIN (SELECT file_id, max((ts_us // 1000000) % 7)::INTEGER AS killed_at_entry FROM log WHERE event = 'retrying' GROUP BY 1)
        USING (file_id)"""),
    "upload_eligibility": over("up", """
        SELECT position, file_ext, NOT (k = 0 OR k IN (2, 3) OR file_ext = '') AND k <> 6 AS can_start
        FROM (SELECT *, position % 7 AS k FROM up)"""),
    "rejected_candidates": over("cand files", f"""
        SELECT staged_id, CASE WHEN hit THEN 'rejected' ELSE status END AS status, CASE WHEN NOT hit THEN s3_key END AS s3_key,
               CASE WHEN hit THEN CASE WHEN source = 'src9' THEN left('{M.ARCHIVE_REJECTED}: ' || repeat('why ', 200), 511) || '…'
                                       WHEN source = 'src2' THEN '{M.ARCHIVE_REJECTED}'
                                       ELSE '{M.ARCHIVE_REJECTED}: ' || said END ELSE reject_reason END AS reject_reason
        FROM (SELECT c.*, f.status_message AS said, f.is_archive AND c.source IN ('src2', 'src9', 'src11') AND c.status = 'processed' AS hit
              FROM cand c JOIN files f ON f.file_id = c.source_file_id)"""),
    "resume_point": over("log", """
        SELECT file_id, min(entry_index) AS resumed_at FROM log WHERE attempt = 2 AND event IN ('entry_staged', 'entry_rejected')
        GROUP BY 1"""),
    "recovery_timeline": over("log", """
        SELECT q.file_id, k AS killed_us, r AS reset_us, min(x.ts_us) AS claimed_us
        FROM (SELECT z.file_id, k, min(s.ts_us) AS r
              FROM (SELECT file_id, min(ts_us) AS k FROM log WHERE event = 'retrying' GROUP BY 1) z
              LEFT JOIN (SELECT ts_us, unnest(file_ids) AS f FROM log WHERE sweep) s ON s.f = z.file_id AND s.ts_us > k
              GROUP BY ALL) q
        LEFT JOIN log x ON x.file_id = q.file_id AND x.event = 'claim_ok' AND x.ts_us >= r GROUP BY ALL"""),
    # order and lookups
    "list_library": over("lib", "SELECT organization_id, document_id, title, title_norm, file_name, file_ext, size_bytes, added_us FROM lib"),
    "get_document": over("lib", "SELECT document_id, title, file_name, size_bytes FROM lib WHERE organization_id = 'en' AND document_id = 'lib-1'"),
    # sets
    "log_merge": over("log", "SELECT DISTINCT file_id, ts_us, event, pid FROM log WHERE NOT sweep"),
    "sweep_coverage": over("log", """
        SELECT DISTINCT file_id FROM log WHERE event = 'enqueued' AND file_id NOT IN (SELECT unnest(file_ids) FROM log WHERE sweep)"""),
    "active_batches": over("state", """
        SELECT DISTINCT concat('org-', split_part(file_id, '-', 1)::BIGINT // 50, '/', split_part(file_id, '-', 2)) AS batch_id
        FROM state WHERE status NOT IN ('staged', 'uploading')"""),
    # scalars
    "title_norm": over("docs", f"SELECT doc_id, {norm(title_of('file_name'), True)} AS title_norm FROM docs"),
    "file_name_norm": over("docs", f"SELECT doc_id, {norm('file_name', False)} AS file_name_norm FROM docs"),
    "title_of": over("nm", f"SELECT id, {title_of('name')} AS title FROM nm"),
    "document_id": f"SELECT doc_id, {uuid5('doc_id::VARCHAR')} AS document_id FROM documents",
    "video_sections": """
        SELECT p_partkey::VARCHAR AS section_doc, concat('video-', p_size, '-0') AS section_id, p_size::BIGINT AS index, p_name AS title
        FROM part WHERE p_type <> 'SMALL'
        UNION ALL SELECT p_partkey::VARCHAR, concat('video-', p_size + 1, '-1'), p_size + 1, 'part two' FROM part WHERE p_type = 'PROMO'""",
    "format_bytes": over("up", """
        SELECT request_id, CASE WHEN b <= 0 THEN '0 B' WHEN b < 1024 THEN concat(b, ' B')
            WHEN b < 1048576 THEN concat((b * 20 + 1024) // 2048 // 10, '.', (b * 20 + 1024) // 2048 % 10, ' KB')
            WHEN b < 1073741824 THEN concat((b * 20 + 1048576) // 2097152 // 10, '.', (b * 20 + 1048576) // 2097152 % 10, ' MB')
            ELSE concat((b * 20 + 1073741824) // 2147483648 // 10, '.', (b * 20 + 1073741824) // 2147483648 % 10, ' GB') END AS text
        FROM (SELECT request_id, size_bytes // (1 + position % 4 * position % 4 * 40000) AS b FROM up)"""),
    # lifecycle
    "ensure_batch": over("up upbatch", """
        SELECT batch_id, organization_id, created_by, status FROM upbatch
        UNION ALL SELECT DISTINCT batch_id, 'org', 0, 'in_progress' FROM up WHERE batch_id NOT IN (SELECT batch_id FROM upbatch)"""),
    "lifecycle_state": over("state", """
        SELECT file_id, events, created_us, last_us, status, status_message, attempt_count, claim_token, heartbeat_us, uploaded_us,
               entries_total, entries_done, detected_type FROM state"""),
    "confirm_result": over("walk", "SELECT file_id, seq, hit AS transitioned FROM walk WHERE kind = 'confirm'"),
    "claims": over("walk", """
        SELECT file_id, seq, tok AS token, hit AS won, CASE WHEN hit THEN attempt_count END AS attempt FROM walk WHERE kind = 'claim'"""),
    "finish_outcome": over("files counts", """
        SELECT file_id, req AS requested, CASE WHEN req = 'stopped' OR uneven THEN NULL
                    WHEN req = 'processed' AND rejected > 0 THEN 'partial' ELSE req END AS stored,
               CASE WHEN req = 'stopped' THEN 'not a terminal status'
                    WHEN uneven THEN concat('archive has ', total, ' candidates but entries_total is ', told) END AS refused,
               is_archive AND req = 'rejected' AS rejects_candidates
        FROM (SELECT *, entries_total + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS told,
                     req IN ('processed', 'partial') AND is_archive AND total <> told AS uneven
              FROM (SELECT f.*, c.total, c.rejected, CASE WHEN source = 'src9' THEN 'stopped' WHEN f.status = 'partial' THEN 'processed'
                           WHEN f.status IN ('uploaded', 'processing') THEN 'error' ELSE f.status END AS req
                    FROM files f JOIN counts c ON c.source_file_id = f.file_id))"""),
    "sweep_stale": over("state", f"""
        SELECT file_id, CASE WHEN attempt_count < 3 THEN 'reset' ELSE 'errored' END AS action,
               CASE WHEN attempt_count < 3 THEN 'uploaded' ELSE 'error' END AS new_status,
               CASE WHEN attempt_count < 3 THEN {AS_OF_US} ELSE uploaded_us END AS new_uploaded_us,
               CASE WHEN attempt_count < 3 THEN status_message ELSE '{M.ATTEMPTS_SPENT}' END AS new_message
        FROM state WHERE status = 'processing' AND heartbeat_us < {AS_OF_US - STALE_US}"""),
    "sweep_reconcile": over("state", f"""
        SELECT file_id, CASE WHEN attempt_count < 3 THEN 'requeued' ELSE 'errored' END AS action,
               CASE WHEN attempt_count < 3 THEN 'uploaded' ELSE 'error' END AS new_status,
               CASE WHEN attempt_count < 3 THEN {AS_OF_US} ELSE uploaded_us END AS new_uploaded_us,
               CASE WHEN attempt_count < 3 THEN status_message ELSE '{M.ATTEMPTS_SPENT}' END AS new_message
        FROM state WHERE status = 'uploaded' AND uploaded_us < {AS_OF_US - 24 * HOUR_US}"""),
    "sweep_abandoned": over("state", f"""
        SELECT file_id, created_us, 'error' AS new_status, '{M.ABANDONED}' AS new_message FROM state
        WHERE status IN ('staged', 'uploading') AND created_us < {AS_OF_US - 24 * HOUR_US}"""),
    "classify_failures": over("fails", "SELECT seq, failure_class FROM fails"),
    "attempt_outcome": over("fails", f"""
        SELECT seq, CASE WHEN failure_class IN ('rejected', 'not_found') OR (failure_class = 'transient' AND attempt >= 3) THEN 'finish'
                    WHEN failure_class = 'transient' THEN 'release_and_retry' WHEN failure_class = 'superseded' THEN 'stop'
                    ELSE 'leave' END AS action,
               CASE WHEN failure_class = 'rejected' THEN 'rejected' WHEN failure_class = 'not_found' OR
                    (failure_class = 'transient' AND attempt >= 3) THEN 'error' END AS final_status,
               CASE WHEN failure_class = 'rejected' THEN detail WHEN failure_class = 'not_found' THEN '{M.OBJECT_MISSING}'
                    WHEN failure_class = 'transient' AND attempt >= 3 THEN concat('Could not be processed after ', attempt,
                    ' attempts: ', detail) END AS status_message,
               CASE WHEN failure_class = 'transient' AND attempt < 3 THEN (2 ^ attempt * 5)::BIGINT END AS countdown FROM fails"""),
    "commit_skipped": over("decided", "SELECT batch_id, staged_id, file_name, reason FROM decided WHERE outcome = 'skipped'"),
    "commit_resolutions": over("fin decided", """
        SELECT f.staged_id, CASE d.outcome WHEN 'added' THEN 'create_new' WHEN 'skipped' THEN 'discard' END AS resolution,
               CASE WHEN f.status = 'processed' THEN f.proposed_title END AS confirmed_title
        FROM fin f LEFT JOIN decided d USING (staged_id)"""),
    "committed_batches": over("unfinished", "SELECT batch_id FROM unfinished WHERE still_in_progress = 0"),
    "remaining_candidates": over("cand files", f"""
        SELECT staged_id, batch_id FROM cand WHERE source_file_id NOT IN (SELECT file_id FROM files WHERE status IN ({TERMINAL}))"""),
    # sessions and ticks
    "heartbeat_sessions": over("life", """
        SELECT file_id, min(ts_us) AS start_us, max(ts_us) + 43200000000 AS end_us, count(*) AS beats FROM (
            SELECT file_id, ts_us, sum(b) OVER (PARTITION BY file_id ORDER BY ts_us, seq) AS s FROM (
                SELECT file_id, ts_us, seq, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY file_id ORDER BY ts_us, seq) < 43200000000
                       THEN 0 ELSE 1 END AS b FROM life WHERE kind IN ('claim', 'heartbeat', 'progress'))) GROUP BY file_id, s"""),
    "sweep_windows": over("log", """
        SELECT event, ts_us // 15000000 * 15000000 AS start_us, count(*) AS sweeps FROM log WHERE sweep GROUP BY ALL"""),
    "log_event_counts": over("log", "SELECT level, event, count(*) AS lines FROM log GROUP BY ALL"),
    # streams, against the batch answers
    "stream_intake": over("life", "SELECT DISTINCT file_id FROM life WHERE kind = 'confirm'"),
    "stream_lifecycle": over("state", """
        SELECT file_id, status, status_message, attempt_count, claim_token, heartbeat_us, uploaded_us, entries_total, entries_done,
               detected_type FROM state"""),
    "stream_stale": over("state", f"""
        SELECT file_id, heartbeat_us, attempt_count FROM state WHERE status = 'processing'
               AND heartbeat_us < (SELECT max(ts_us) FROM life) - {HOUR_US} - {STALE_US}"""),
    "stream_log_counts": over("log", "SELECT level, event, count(*) AS lines FROM log GROUP BY ALL"),
    "stream_sweep_windows": over("log", """
        SELECT event, ts_us // 15000000 * 15000000 AS start_us, count(*) AS sweeps FROM log WHERE sweep GROUP BY ALL"""),
    "stream_candidates": over("good", """
        SELECT source_file_id, source_entry_name, entry_index, file_name, size_bytes, status, content_hash, seq
        FROM (SELECT w.*, first(entry_index) OVER k AS i0, first(file_name) OVER k AS n0 FROM good w
              WINDOW k AS (PARTITION BY source_file_id, source_entry_name ORDER BY seq))
        WHERE entry_index IS NOT DISTINCT FROM i0 AND file_name = n0
        QUALIFY row_number() OVER (PARTITION BY source_file_id, source_entry_name ORDER BY seq DESC) = 1"""),
    # data quality
    "dq_unique_title": over("cand", """
        SELECT organization_id, title_norm, count(*) AS copies FROM cand GROUP BY ALL HAVING count(*) > 1"""),
    "dq_unique_upload": over("up", """
        SELECT 'batch_client_ref' AS rule, concat(batch_id, '|', file_name) AS value, count(*) AS copies FROM up
        GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'upload_id', concat(file_name, '|', size_bytes), count(*) FROM up WHERE file_ext <> 'txt'
        GROUP BY ALL HAVING count(*) > 1"""),
    "dq_enums": over("files upbatch lib cand", """
        SELECT 'file.status' AS rule, 'stopped' AS value, count(*) AS rows FROM files WHERE source = 'src9' HAVING count(*) > 0
        UNION ALL SELECT 'library.highest_risk', 'UNRATED', count(*) FROM lib WHERE highest_risk IS NULL HAVING count(*) > 0"""),
    "dq_replace_target": over("up", """
        SELECT request_id FROM up WHERE NOT ((phase <> 'P' AND file_ext <> 'pdf') OR
            (phase = 'P' AND file_ext IN ('pdf', 'zip') AND file_ext <> 'zip'))"""),
    "dq_orphans": over("lib files cand", """
        SELECT 'library.source_file_id' AS rule, source_file_id AS value, count(*) AS rows FROM lib
        WHERE source_file_id NOT IN (SELECT file_id FROM files) GROUP BY ALL
        UNION ALL SELECT 'upload.batch_id', concat('c', o_custkey), count(*) FROM orders
        WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')
              OR o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY ALL"""),
    "dq_fields": """
        SELECT doc_id, 'file_name longer than 512' AS rule FROM documents WHERE length(text) > 512
        UNION ALL SELECT doc_id, 'content_hash is no SHA-256' FROM documents WHERE lang = 'es'
                  AND regexp_matches(sha256(text), '[a-f]')""",
    "dq_invariants": over("files cand", f"""
        SELECT 'duplicate_candidates' AS rule, count(*) AS broken FROM (
            SELECT 1 FROM cand GROUP BY source_file_id, source_entry_name HAVING count(*) > 1)
        UNION ALL SELECT 'open_files', count(*) FROM files WHERE status NOT IN ({TERMINAL})"""),
    "dq_claims": over("walk", """
        SELECT file_id, count(*) AS wins, count(DISTINCT attempt_count) AS attempts, max(attempt_count) AS last,
               wins = attempts AND wins = last AND last <= 3 AS consistent FROM walk WHERE kind = 'claim' AND hit GROUP BY 1"""),
}
