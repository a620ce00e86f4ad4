"""SQL twins of the queries that SQL can say."""

from __future__ import annotations

from tremor.llm.mixing import CAP, SEEDS, WEIGHTS
from tremor.llm.repetition import BASE_N, Rules

_WORD = r"[^\x20\x09-\x0D]+"


def repetition_sql(rules: Rules = Rules()) -> str:
    ctes, columns = [], []
    for n in [BASE_N, *rules.lengths]:
        gram = ", ".join(["w", *[f"lead(w, {k}) OVER (PARTITION BY doc_id ORDER BY i)" for k in range(1, n)]])
        whole = f"lead(i, {n - 1}) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL"
        ctes.append(f"""g{n} AS (SELECT doc_id, i, w, CASE WHEN {whole} THEN concat_ws(' ', {gram}) END AS g FROM words),
            c{n} AS (SELECT doc_id, i, w, g, count(g) OVER (PARTITION BY doc_id, g) AS n, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM g{n}),
            m{n} AS (SELECT doc_id, w, max(CASE WHEN g IS NOT NULL AND n > 1 {'' if n == BASE_N else 'AND k > 1'} THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hit FROM c{n}),
            s{n} AS (SELECT doc_id, CAST(sum(hit) AS BIGINT) AS hits, CAST(sum(hit * length(w)) AS BIGINT) AS chars FROM m{n} GROUP BY doc_id)""")
        columns.append(f"coalesce(s{n}.hits, 0) AS n_repeat_words" if n == BASE_N else f"coalesce(s{n}.chars, 0) AS dup_chars_{n}")
    joins = " ".join(f"LEFT JOIN s{n} USING (doc_id)" for n in [BASE_N, *rules.lengths])
    limits = " AND ".join(f"dup_chars_{n} <= {rules.coverage[n]!r}e0 * word_chars" for n in rules.lengths)
    failed = f"(n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)"
    return rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts),
        lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM texts),
        marked AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS later FROM lines WHERE regexp_matches(line, '{_WORD}')),
        again AS (SELECT doc_id, count(*) AS n_dup_lines, CAST(sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS BIGINT) AS dup_line_chars
            FROM marked WHERE later GROUP BY doc_id),
        {", ".join(ctes)},
        measured AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
            coalesce(dup_line_chars, 0) AS dup_line_chars, {", ".join(columns)} FROM texts LEFT JOIN again USING (doc_id) {joins})
        SELECT *, {failed} AS base_failed, NOT {failed} AND dup_line_chars <= {rules.line_coverage!r}e0 * word_chars
            AND n_symbols <= {rules.symbols_per_word!r}e0 * n_words AND {limits} AS kept FROM measured"""


def mixing_sql() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + str(len(WEIGHTS)) + " " + " ".join(
        f"WHEN {i} THEN {w}e0" for i, w in enumerate(WEIGHTS)) + " END"
    own = "':' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))"
    draws = ", ".join(f"CAST('0x' || substr(md5('{s}' || {own}), 1, 13) AS BIGINT) / 4503599627370496e0" for s in range(SEEDS))
    tried = ", ".join(f"{{'off': abs(sum(size * (floor(rate) + CASE WHEN draws[{s + 1}] < rate - floor(rate) THEN 1 ELSE 0 END)) - any_value(target)), 's': {s + 1}}}"
                      for s in range(SEEDS))
    return f"""WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size, [{draws}] AS draws FROM documents),
        by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
        weighed AS (SELECT *, {weight} AS w, CAST({CAP} * source_size AS DOUBLE) AS full_ FROM by_source),
        filled AS (SELECT *, ((SELECT sum(source_size) FROM by_source) - coalesce(sum(full_) OVER o, 0e0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0e0)) AS level
            FROM weighed WINDOW o AS (ORDER BY full_ / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        top AS (SELECT max(level) AS level FROM filled WHERE full_ >= level * w),
        targets AS (SELECT source, source_size, least(full_, w * top.level) AS target,
            CASE WHEN source_size > 0 THEN least(least(full_, w * top.level) / source_size, {CAP}e0) ELSE 1e0 END AS rate FROM filled, top),
        tried AS (SELECT targets.source AS source, list_min([{tried}])['s'] AS seed
            FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source GROUP BY targets.source)
        SELECT doc_id, size, source_size, target,
            CAST(size * (floor(rate) + CASE WHEN draws[seed] < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source JOIN tried ON sizes.source IS NOT DISTINCT FROM tried.source"""


TOP_K = """WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
    SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    WHERE rank <= 5"""


def _crc32_sql(words: str, name: str) -> str:
    """CTEs: ``name`` holds (w, crc) for the distinct texts w of the CTE ``words``.
    The table of CRC-32 (reflected polynomial 0xEDB88320) by eight shifts."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END AS c"
    shifts = "SELECT i, i::UBIGINT AS c FROM range(256) t(i)"
    for _ in range(8):
        shifts = f"SELECT i, {step} FROM ({shifts})"
    return f"""{name}_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({shifts})),
        {name}_bytes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM {words})),
        {name} AS MATERIALIZED (SELECT w, xor(4294967295::UBIGINT, list_reduce(list_concat([4294967295::UBIGINT],
            [CAST('0x' || substr(x, CAST(2 * k - 1 AS BIGINT), 2) AS UBIGINT) FOR k IN range(1, length(x) // 2 + 1)]),
            lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)]))) AS crc FROM {name}_bytes, {name}_table)"""


def resampling_sql(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """Single words only, as the query draws."""
    upper = "".join(map(chr, range(65, 91)))
    words = rf"unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        dw AS MATERIALIZED (SELECT r, {words} FROM docs), bw AS MATERIALIZED (SELECT {words} FROM benchmark),
        every AS (SELECT w FROM dw UNION ALL SELECT w FROM bw), {_crc32_sql("every", "hashed")},
        placed AS (SELECT w, crc % {buckets} AS b FROM hashed),
        s AS (SELECT b, count(*) AS n FROM dw JOIN placed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN placed USING (w) GROUP BY b),
        gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1e0) * ((SELECT coalesce(sum(n), 0) FROM s) + {buckets}e0)
            / ((s.n + 1e0) * ((SELECT coalesce(sum(n), 0) FROM t) + {buckets}e0)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b)),
        own AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN placed USING (w) JOIN gain USING (b) GROUP BY r),
        scored AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
                + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM docs LEFT JOIN own USING (r)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {min_words} ORDER BY score DESC, doc_id NULLS LAST) AS k,
            count(*) OVER (PARTITION BY n_features >= {min_words}) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {min_words} AND k <= {percent} * n // 100 THEN k END AS rank FROM ranked"""


def turn_repair_sql() -> str:
    """The search as a recursion over rows that carries whole audits and texts."""
    states = "('E', 'E', '', ''), ('E', 'U', 'I', 'u'), ('E', 'A', 'II', 'ua'), ('S', 'S', '', ''), ('S', 'U', 'I', 'u'), ('S', 'A', 'II', 'ua'), " \
             "('U', 'U', '', ''), ('U', 'A', 'I', 'a'), ('A', 'A', '', ''), ('A', 'U', 'I', 'u')"
    edits = "('E', 'K', 's', 'S', NULL), ('E', 'K', 'u', 'U', NULL), ('S', 'K', 'u', 'U', NULL), ('U', 'K', 'a', 'A', NULL), ('A', 'K', 'u', 'U', NULL), " \
            "('E', 'R', NULL, 'U', 'user'), ('S', 'R', NULL, 'U', 'user'), ('U', 'R', NULL, 'A', 'assistant'), ('A', 'R', NULL, 'U', 'user'), " \
            "('E', 'D', NULL, 'E', NULL), ('S', 'D', NULL, 'S', NULL), ('U', 'D', NULL, 'U', NULL), ('A', 'D', NULL, 'A', NULL)"
    inserted = "CASE ins WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' WHEN 'ua' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END"
    return rf"""WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS w FROM conversations),
        {_crc32_sql("src", "hashed")},
        convs AS MATERIALIZED (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM src)),
        marked AS (SELECT c, turn, role, text, crc % 20 AS k FROM src JOIN hashed USING (w) JOIN convs ON src.conv_id IS NOT DISTINCT FROM convs.conv_id),
        damaged AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
            CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
            FROM marked WHERE k <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
        seen AS (SELECT *, min(i) OVER (PARTITION BY c, role, text) < i AS again, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS tail,
            lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
        faulty AS MATERIALIZED (SELECT c, i, turn, role, text, before, CASE WHEN tail = '' THEN 'b' WHEN again THEN 'd' WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM seen),
        ways(state, at_, ins_edits, ins) AS (VALUES {states}), edits(at_, edit, initial, next_, new_role) AS (VALUES {edits}),
        dp AS (SELECT c, CAST(0 AS BIGINT) AS i, 'E' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS lines FROM convs
            UNION ALL
            SELECT c, i, state, cost, audit, lines FROM (
                SELECT dp.c AS c, f.i AS i, next_ AS state, dp.cost + 2 * length(ins_edits)
                        + CASE edit WHEN 'K' THEN 0 WHEN 'R' THEN 2 ELSE 3 END + CASE WHEN edit <> 'D' AND fault = 't' THEN 1 ELSE 0 END AS cost,
                    dp.audit || ins_edits || edit AS audit,
                    dp.lines || {inserted} || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || coalesce(new_role, role) || ':' || text END AS lines
                FROM dp JOIN faulty f ON f.c = dp.c AND f.i = dp.i + 1 JOIN ways ON ways.state = dp.state JOIN edits ON edits.at_ = ways.at_
                WHERE (initial IS NULL OR initial = left(role, 1)) AND (edit = 'D' OR fault NOT IN ('b', 'd')))
            QUALIFY row_number() OVER (PARTITION BY c, state ORDER BY cost, audit) = 1),
        last_ AS (SELECT c, coalesce(max(f.i), 0) AS i FROM convs LEFT JOIN faulty f USING (c) GROUP BY c),
        ends AS (SELECT dp.c, cost + 2 * length(ins_edits) AS cost, audit || ins_edits AS audit, lines || {inserted} AS lines
            FROM dp JOIN last_ ON dp.c = last_.c AND dp.i = last_.i JOIN ways ON ways.state = dp.state
            WHERE at_ = 'A' OR (at_ = 'E' AND dp.state = 'E') QUALIFY row_number() OVER (PARTITION BY dp.c ORDER BY cost + 2 * length(ins_edits), audit || ins_edits) = 1),
        counted AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
            count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
            count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(lines, 2)) AS repaired_sha256
        FROM convs JOIN ends USING (c) LEFT JOIN counted USING (c)"""
