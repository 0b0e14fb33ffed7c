"""DuckDB SQL for queries of this subpackage."""

from __future__ import annotations

def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text expression: bit by bit, with the reflected polynomial."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr({digits}, (2 * i + 1)::INT, 2))::BIGINT)"
    # Eight shifts after each byte; the 0 that starts the inner list makes room for the state.
    shifts = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {shifts}), 4294967295)"


TURN_DIGEST = "md5(concat(length(role), ':', role, text))"

# What the template of op11 escapes: a control string, or one with backslashes behind its first character.
_CONTROLS = [("<", r"s>|/s>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>|</TURN>>|\|im_start\|>|\|im_end\|>"), (r"\[", r"INST\]|/INST\]")]


def _escaped(text: str) -> str:
    for first, rest in _CONTROLS:
        text = rf"regexp_replace({text}, '({first})(\\*)({rest})', '\1\\\2\3', 'g')"
    return text


OP11 = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), o AS (SELECT *, {TURN_DIGEST} AS digest FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, digest)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, digest) FILTER (role = 'assistant'), '')) AS loss_sha256,
           (3 + sum(length({_escaped('text')}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6
                    ELSE 26 + length({_escaped('role')}) END))::BIGINT AS formatted_chars
    FROM o GROUP BY conv_id"""

OP12 = f"""
    WITH RECURSIVE r AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
        FROM documents
    ), d AS (
        SELECT run, count(*) AS n, concat(doc_id, ':', run) AS name FROM r WHERE length(run) >= 7 GROUP BY doc_id, run
    ), h AS (SELECT run, n, {crc32('name')} AS h FROM d
    ), c AS (
        SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM h
    ), w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ), x AS (SELECT word, n, unnest(range(length(word))) AS i FROM w
    ), v AS (SELECT word, n, i, word[:i::INT] || word[i::INT + 2:] AS cut FROM x
    ), p AS (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
        UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.cut = w.word
        UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.cut = w.word
    ), k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM p
    ), f AS (
        SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.other_n >= 10 * w.n THEN k.other END AS form,
               CASE WHEN k.other_n >= 10 * w.n THEN k.other_n END AS form_n
        FROM w LEFT JOIN k ON k.word = w.word AND k.place = 1
    ), chain AS (
        SELECT word, form AS root FROM f WHERE form IS NOT NULL
        UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL
    ), last AS (SELECT word, arg_max(root, n) AS root FROM (SELECT chain.*, w.n FROM chain JOIN w ON w.word = chain.root) GROUP BY word)
    SELECT f.word, f.form, coalesce(last.root, f.word) AS root, f.n, f.n_near, f.form_n FROM f LEFT JOIN last ON last.word = f.word"""

OP13 = f"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
    ), o AS (SELECT conv_id, turn, {TURN_DIGEST} AS digest, strlen(text) AS bytes FROM t
    ), s AS (SELECT conv_id, list({{'d': digest, 'b': bytes}} ORDER BY turn NULLS FIRST, digest) AS own FROM o GROUP BY conv_id
    ), h AS (SELECT conv_id, own, ({crc32('conv_id::VARCHAR')} % 9)::INT AS h FROM s
    ), c AS (
        SELECT h.conv_id, list_concat(coalesce(f.own, [])[:h.h], h.own[h.h + 1:]) AS path
        FROM h LEFT JOIN s f ON f.conv_id = h.conv_id - h.conv_id % 5
    ), p AS (
        SELECT conv_id, len(path) AS size, d, list_transform(path[:d::INT], lambda x: x.d) AS node,
               list_transform(path[:d::INT - 1], lambda x: x.d) AS parent, CASE WHEN d > 0 THEN path[d::INT].b ELSE 0 END AS bytes
        FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM c)
    ), n AS (
        SELECT node, d AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
        FROM p GROUP BY node, d
    ), k AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL
    ), m AS (
        SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node AND k.depth = n.depth
    ), u AS (
        SELECT node[:d::INT] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens
        FROM (SELECT *, unnest(range(depth + 1)) AS d FROM m) GROUP BY 1
    )
    SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256
    FROM m JOIN u ON u.node = m.node LEFT JOIN n q ON m.depth > 0 AND q.node = m.parent AND q.depth = m.depth - 1"""
