"""SQL that DuckDB can run for the numbered queries that SQL can express, written from the contracts by other means.

Packing, the trained taggers and models, token files and page text have no SQL; tests hold them to brute force.
"""

from __future__ import annotations

from landledger.llm.licenses import PHRASES, TEMPLATES, _needed

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _licenses() -> str:
    step = max(len(body.split()) for _, body in TEMPLATES)
    words = ", ".join(f"('{label}', '{w}')" for label, body in TEMPLATES for w in sorted(set(body.split())))
    sizes = ", ".join(f"('{label}', {len(set(body.split()))}, {_needed(len(set(body.split())))})" for label, body in TEMPLATES)
    spots = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: "
        + " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(body.split())) + ")) AS pos FROM w"
        for label, body in PHRASES
    )
    return f"""
    WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM w),
    template(label, word) AS (VALUES {words}),
    size(label, n, need) AS (VALUES {sizes}),
    held AS (SELECT DISTINCT doc_id, label, word, unnest([floor(pos / {step})::BIGINT, floor(pos / {step})::BIGINT - 1]) AS block FROM u JOIN template USING (word)),
    met AS (SELECT doc_id, label, count(*) AS n_held FROM held GROUP BY doc_id, label, block),
    found AS (SELECT doc_id, label, n_held / n AS share FROM met JOIN size USING (label) WHERE n_held >= need),
    spot AS ({spots}),
    base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY doc_id),
    more AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM spot UNION SELECT doc_id, label FROM found) GROUP BY doc_id),
    best AS (SELECT doc_id, max(share) AS score FROM found GROUP BY doc_id)
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id) LEFT JOIN best USING (doc_id)"""


QUALITY = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS ws,
                 list_filter(string_split(body, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
    windows AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS pos, ws FROM w WHERE len(ws) > 2),
    triple AS (SELECT doc_id, pos, [ws[pos + 1], ws[pos + 2], ws[pos + 3]] AS three FROM windows),
    again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, three) AS n FROM triple),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS place FROM again WHERE n > 1) GROUP BY doc_id),
    m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                 length(regexp_replace(body, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                 coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(body, '[^!]', '', 'g')) AS shouts,
                 length(regexp_replace(body, '[^A-Z]', '', 'g')) AS upper_letters, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS all_letters
          FROM w LEFT JOIN hit USING (doc_id)),
    f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
                OR 10 * shouts > 2 * n_words OR 2 * upper_letters > all_letters) AS kept
    FROM f"""

JACCARD = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[pos:pos + 4], ' ') AS shingle
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS pos FROM w WHERE len(ws) > 0)),
    n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pair JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 5 * shared >= 4 * (x.size + y.size - shared)),
    reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
    least AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
    many AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
    SELECT w.doc_id, least(w.doc_id, coalesce(root, w.doc_id)) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(size, 0)::BIGINT AS n_shingles
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = w.doc_id LEFT JOIN many ON many.a = w.doc_id"""

DECONTAMINATION = f"""
    WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
    i AS (SELECT item_id, {WORDS} AS ws FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS size, array_to_string(ws[pos:pos + least(len(ws), 13) - 1], ' ') AS phrase
           FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS pos FROM i WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT size FROM iw),
    dw AS (SELECT doc_id, size, pos, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase
           FROM (SELECT doc_id, size, ws, unnest(range(1, len(ws) - size + 2)) AS pos FROM d, sizes WHERE len(ws) >= size)),
    hit AS (SELECT doc_id, item_id, pos, dw.size FROM dw JOIN iw ON dw.phrase = iw.phrase AND dw.size = iw.size),
    words AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

COPIES = r"""
    WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS sha FROM documents),
    g AS (SELECT sha, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY sha)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM t JOIN g USING (sha)"""


def _crc(value: str) -> str:
    """CRC-32 of an ASCII text, a bit at a time."""
    bits = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({value}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {bits}), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _tree(leaves: str, own: str, name: str) -> str:
    """Nodes by level, the runs they make, and the way of `own` up through them with the siblings met."""
    return f"""{name}_up AS (
        SELECT 0 AS level, tree, spot, digest, count(*) OVER (PARTITION BY tree) AS n FROM {leaves}
        UNION ALL
        SELECT level + 1, tree, spot // 3, sha256(string_agg(digest, '' ORDER BY spot)), (max(n) + 2) // 3 FROM {name}_up WHERE n > 1 GROUP BY level, tree, spot // 3),
    {name}_runs AS (SELECT level, tree, spot // 3 AS parent, list(digest ORDER BY spot) AS run FROM {name}_up WHERE n > 1 GROUP BY level, tree, spot // 3),
    {name}_top AS (SELECT tree, max(level) AS level, arg_max(digest, level) AS digest FROM {name}_up GROUP BY tree),
    {name}_way AS (
        SELECT doc_id, tree, spot, 0 AS level, folded, proof FROM {own}
        UNION ALL
        SELECT doc_id, w.tree, spot // 3, w.level + 1, sha256(array_to_string(list_concat(run[:spot % 3], [folded], run[spot % 3 + 2:]), '')),
               proof || array_to_string(list_concat(run[:spot % 3], run[spot % 3 + 2:]), '')
        FROM {name}_way AS w JOIN {name}_runs AS r ON r.tree = w.tree AND r.level = w.level AND r.parent = spot // 3),
    {name}_end AS (SELECT w.* FROM {name}_way AS w JOIN {name}_top AS t ON t.tree = w.tree AND t.level = w.level)"""


MANIFEST = f"""
    WITH RECURSIVE d AS (
        SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS digest,
               {_leaf("CASE WHEN " + _crc("doc_id::VARCHAR") + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS folded FROM documents),
    leaves AS (SELECT *, '' AS proof, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS spot FROM d),
    {_tree("leaves", "leaves", "low")},
    groups AS (SELECT '' AS tree, tree AS of, digest, row_number() OVER (ORDER BY tree) - 1 AS spot FROM low_top),
    entered AS (SELECT doc_id, g.tree, g.spot, folded, proof FROM low_end AS e JOIN groups AS g ON g.of = e.tree),
    {_tree("groups", "entered", "high")}
    SELECT doc_id, l.digest AS leaf, i.digest AS subroot, o.digest AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = o.digest AS verified
    FROM leaves AS l JOIN low_top AS i ON i.tree = l.tree JOIN high_end AS e USING (doc_id), high_top AS o"""


def _repair() -> str:
    """Cost (nine digits) and audit as one text per state, so that the least text is the answer; rows from the last to the first."""

    def more(rest: str, cost: str, initial: str) -> str:
        return f"lpad((substr({rest}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{initial}' || substr({rest}, 10)"

    after, role = (2, 2, 3, 2), "uuau"
    moves = []
    for state in range(4):
        options = [more(f"v{state}", "4", "D"), f"CASE WHEN NOT gone THEN {more(f'v{after[state]}', '3 + extra', 'R')} END",
                   f"CASE WHEN NOT gone AND initial = '{role[state]}' THEN {more(f'v{after[state]}', 'extra', 'K')} END"]
        if state == 0:
            options.append(f"CASE WHEN NOT gone AND initial = 's' THEN {more('v1', 'extra', 'K')} END")
        moves.append(f"least({', '.join(options)}) AS w{state}")
    legal = "initial || next IN ('su', 'ua', 'au')"
    return f"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) FROM raw WHERE kind <> 0),
    placed AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS spot FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
                    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut, lead(initial) OVER (PARTITION BY conv_id ORDER BY spot) AS next FROM placed),
    told AS (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN 3 ELSE 0 END AS extra FROM seen),
    counts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (next IS NOT NULL AND NOT ({legal})) AS illegal FROM told GROUP BY conv_id),
    ahead AS (
        SELECT conv_id, n AS spot, '000000000' AS v0, '000000006II' AS v1, '000000003I' AS v2, '000000000' AS v3 FROM counts
        UNION ALL
        SELECT conv_id, spot, least(w0, {more("i2", "3", "I")}), least(w1, {more("i2", "3", "I")}), i2, least(w3, {more("w2", "3", "I")})
        FROM (SELECT *, least(w2, {more("w3", "3", "I")}) AS i2 FROM (
            SELECT a.conv_id, a.spot - 1 AS spot, {", ".join(moves)} FROM ahead AS a JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM a.conv_id AND t.spot = a.spot))),
    best AS (SELECT conv_id, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM ahead WHERE spot = 0),
    walk AS (
        SELECT conv_id, audit, 0 AS k, 0 AS spot, 0 AS state, NULL::VARCHAR AS line FROM best
        UNION ALL
        SELECT w.conv_id, audit, k + 1, CASE edit WHEN 'I' THEN w.spot ELSE w.spot + 1 END,
               CASE WHEN edit = 'D' THEN state WHEN edit = 'K' AND initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
               CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE WHEN state = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE edit WHEN 'R' THEN text ELSE '' END END
        FROM (SELECT *, substr(audit, k + 1, 1) AS edit FROM walk) AS w LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.spot = w.spot + 1 WHERE k < length(audit)),
    texts AS (SELECT conv_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY k), '')) AS repaired_sha256 FROM walk GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
           coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN counts AS c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
    LEFT JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLES: dict[str, str] = {
    "op2_license_scan": _licenses(),
    "op4_quality_cascade": QUALITY,
    "op8_jaccard_forest": JACCARD,
    "op10_decontamination": DECONTAMINATION,
    "op11_exact_dedup": COPIES,
    "op12_merkle_manifest": MANIFEST,
    "op13_conversation_repair": _repair(),
}
