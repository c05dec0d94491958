"""The results of the queries in SQL, where SQL can express them."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    # The marks of the template around each role's text, and one more character for each escape.
    "op3_chat_format": r"""
        WITH c AS (
          SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
          UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (
          SELECT *, CASE role WHEN 'system' THEN '<<SYS>><</SYS>>' WHEN 'user' THEN '<s>[INST][/INST]'
            WHEN 'assistant' THEN '<|reply|></s>' END AS marks FROM c)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), ''))
            AS loss_sha256,
          CAST(sum(length(marks) + 2 * length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')))
            AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id
    """,
    "op4_near_dedup": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
        s AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i
                FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
          FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (
          SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, b AS reached FROM e
              UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached),
        c AS (SELECT doc_id, min(reached) AS lowest FROM r GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles,
          least(doc_id, coalesce(lowest, doc_id)) AS component_id,
          doc_id <= coalesce(lowest, doc_id) AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, keep_id, group_size, d.doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g USING (t)
    """,
    "op8_substring_dedup": f"""
        WITH w AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
        x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
        k AS (
          SELECT doc_id, i, row_number() OVER (
            PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS turn FROM x),
        gone AS (
          SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE turn > 1),
        flat AS (
          SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
        kept AS (
          SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n
          FROM flat ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
          sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
}


def _clusters(clusters: int = 8, rounds: int = 10) -> str:
    """All rounds one after the other, every vector against every centroid."""
    nearest = """
        a{i} AS MATERIALIZED (
          SELECT r, c, d FROM (
            SELECT r, c, list_sum(list_transform(list_zip(k.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
            FROM k CROSS JOIN c{i} m)
          QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    moved = """
        c{j} AS MATERIALIZED (
          SELECT c, coalesce(n.v, m.v) AS v FROM c{i} m LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM (
              SELECT c, p, sum(x) AS s, count(*) AS n FROM (
                SELECT c, unnest(v) AS x, unnest(range(64)) AS p FROM a{i} JOIN k USING (r))
              GROUP BY c, p) GROUP BY c) n USING (c))"""
    steps = ",".join(nearest.format(i=i) + "," + moved.format(i=i, j=i + 1) for i in range(rounds))
    return f"""
        WITH k AS MATERIALIZED (
          SELECT row_number() OVER () AS r, vec_id,
            list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
          FROM embeddings WHERE len(embedding) = 64
            AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
            SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h, v LIMIT {clusters})),
        {steps},{nearest.format(i=rounds)}
        SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
          CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
          CAST(sum(d) OVER () AS BIGINT) AS inertia,
          sha256(array_to_string(m.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN k USING (r) JOIN c{rounds} m USING (c)
    """


def _edit(value: str, cost: int | str, edits: str) -> str:
    """A value is the cost in nine digits, then the edits, so the least text is the best repair."""
    return f"lpad(CAST(CAST({value}[1:9] AS INT) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{edits}'"


def _repairs() -> str:
    """Each conversation turn by turn, with the best repair so far for each state of the grammar."""
    insert = {"t2": f"""least(t2, {_edit("t0", 5, "I")}, {_edit("t1", 5, "I")}, {_edit("t3", 5, "I")})""",
              "t3": f"""least(t3, {_edit("t2", 5, "I")}, {_edit("t0", 10, "II")}, {_edit("t1", 10, "II")})"""}

    def after(state: int) -> str:
        ways = [_edit(f"s{state}", 2, "D")]
        for before, role in {1: [(0, "s")], 2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}.get(state, []):
            ways.append(f"CASE WHEN NOT gone AND role[1] = '{role}' THEN {_edit(f's{before}', 'extra', 'K')} END")
            if role != "s":
                ways.append(f"CASE WHEN NOT gone THEN {_edit(f's{before}', 'extra + 1', 'R')} END")
        return f"least({', '.join(ways)}) AS t{state}" if len(ways) > 1 else f"{ways[0]} AS t{state}"

    white = r"'[^\x20\x09-\x0D]'"
    return f"""
        WITH RECURSIVE n AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
          FROM conversations),
        f AS (
          SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(
            string_split(k, ''), lambda x: [ord(x), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b:
            CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 20 AS code
          FROM n),
        d AS (
          SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
            CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy
          FROM f WHERE code <> 0),
        o AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i
          FROM d),
        p AS (
          SELECT *, lag(role[1]) OVER w AS before,
            CASE WHEN NOT regexp_matches(text, {white}) THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN regexp_extract_all(text, {white})[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
          FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
        q AS (
          SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone,
            CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM p),
        r AS (
          SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1,
            '000000005I' AS s2, '000000010II' AS s3 FROM (SELECT DISTINCT conv_id FROM q)
          UNION ALL
          SELECT conv_id, i, t0 AS s0, t1 AS s1, {insert["t2"]} AS s2, {insert["t3"]} AS s3 FROM (
            SELECT q.conv_id, q.i, {", ".join(map(after, range(4)))}
            FROM r JOIN q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND q.i = r.i + 1)),
        best AS (
          SELECT conv_id, least(s0, s3) AS best FROM r
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        e AS (  -- each edit with its place, and how many turns of the conversation came before
          SELECT conv_id, unnest(string_split(best[10:], '')) AS edit, unnest(range(len(best) - 9)) AS pos
          FROM best WHERE len(best) > 9),
        g AS (
          SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY pos) AS i,
            row_number() OVER (PARTITION BY conv_id, edit <> 'D' ORDER BY pos) AS nth FROM e),
        l AS (
          SELECT g.conv_id, pos, g.edit, nth,
            CASE WHEN edit <> 'I' THEN q.role END AS old, CASE WHEN edit = 'I' THEN '' ELSE q.text END AS text
          FROM g LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM g.conv_id AND q.i = g.i WHERE edit <> 'D'),
        z AS (
          SELECT *, coalesce(max(CASE WHEN nth = 1 AND edit = 'K' AND old[1] = 's' THEN 1 END)
            OVER (PARTITION BY conv_id), 0) AS system FROM l),
        h AS (
          SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN old WHEN (nth - system) % 2 = 1 THEN 'user'
            ELSE 'assistant' END || ':' || text, chr(10) ORDER BY pos) AS t FROM z GROUP BY conv_id),
        c AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
            count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (i > 1 AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal
          FROM q GROUP BY conv_id)
        SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
          coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
          coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1:9] AS BIGINT), 0) AS cost,
          coalesce(best[10:], '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) x
        LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM x.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM x.conv_id
        LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM x.conv_id
    """


ORACLES["op11_centroids"] = _clusters()
ORACLES["op13_turn_repair"] = _repairs()
