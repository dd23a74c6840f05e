"""What SQL can say about the operators' results."""

from __future__ import annotations

from contraluz.llm import chat, licence

_CHAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS story,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
      FILTER (WHERE role = 'assistant'), '') AS taught,
    sum(length(role) + length(text)
      + len(regexp_extract_all(role || chr(10) || text, '[<\\[]\\\\*(?:{chat._CONTROL})'))
      + {len(chat.TURN + chat.TEXT + chat.END)}) AS formatted_chars
  FROM said GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(story) AS turns_sha256, length(taught) AS loss_chars,
  sha256(taught) AS loss_sha256, cast(formatted_chars AS BIGINT) AS formatted_chars
FROM told
"""


def _licence() -> str:
    rows = ", ".join(
        f"({i}, '{name}', '{text.lower().replace(chr(39), chr(39) * 2)}')"
        for i, (name, text) in enumerate(licence.TEMPLATES)
    )
    return f"""
WITH tpl(place, licence, text) AS (VALUES {rows}),
tw AS (
  SELECT place, w, count(*) AS tf FROM (
    SELECT place, unnest(regexp_split_to_array(text, '[^a-z0-9]+')) AS w FROM tpl
  ) WHERE w <> '' GROUP BY place, w
),
files AS (
  SELECT DISTINCT ON (doc_id) doc_id, text,
    coalesce(source, 'unknown') AS s, coalesce(lang, 'unknown') AS l, doc_id // 100 AS b
  FROM documents WHERE doc_id IS NOT NULL
),
placed AS (
  SELECT doc_id, text, CASE WHEN doc_id % 1000 = 0 THEN s WHEN doc_id % 100 = 0 THEN s || '/' || l
      ELSE s || '/' || l || '/' || b END AS dir,
    CASE WHEN doc_id % 10 = 0 THEN 'LICENSE-' ELSE 'page-' END || doc_id AS name
  FROM files
),
n AS (SELECT count(text) AS n FROM placed),
df AS (
  SELECT w, count(*) AS df FROM (
    SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS w FROM placed
  ) WHERE w IN (SELECT w FROM tw) GROUP BY w
),
idf AS (
  SELECT w, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf
  FROM (SELECT DISTINCT w FROM tw) LEFT JOIN df USING (w), n
),
tv AS (
  SELECT place, w, tf * idf / sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY place)) AS v
  FROM tw JOIN idf USING (w)
),
units AS (
  SELECT DISTINCT doc_id, 0 AS whole, unnest(string_split(lower(text), chr(10))) AS unit FROM placed
  UNION SELECT doc_id, 1, lower(text) FROM placed WHERE name LIKE 'LICENSE%'
),
uw AS (
  SELECT unit, w, count(*) AS tf FROM (
    SELECT unit, unnest(regexp_split_to_array(unit, '[^a-z0-9]+')) AS w FROM (SELECT DISTINCT unit FROM units)
  ) WHERE w <> '' GROUP BY unit, w
),
norm AS (
  SELECT unit, sqrt(sum(pow(tf * coalesce(idf, ln(1.0 + n) + 1), 2))) AS norm
  FROM uw LEFT JOIN idf USING (w), n GROUP BY unit
),
dots AS (
  SELECT unit, place, sum(uw.tf * idf * v) AS dot FROM uw JOIN idf USING (w) JOIN tv USING (w)
  GROUP BY unit, place
),
hits AS (
  SELECT doc_id, whole, place, round(dot / norm, 6) AS score
  FROM units JOIN dots USING (unit) JOIN norm USING (unit)
  WHERE round(dot / norm, 6) >= {licence.THRESHOLD}
),
own AS (
  SELECT DISTINCT ON (doc_id) doc_id, whole, licence, score,
  FROM hits JOIN tpl USING (place) ORDER BY doc_id, score DESC, place, whole
),
given AS (
  SELECT DISTINCT ON (dir) dir, licence AS given
  FROM own JOIN placed USING (doc_id) JOIN (SELECT licence, min(place) AS place FROM tpl GROUP BY 1) USING (licence)
  WHERE name LIKE 'LICENSE%' ORDER BY dir, score DESC, place
),
near AS (
  SELECT DISTINCT ON (doc_id) doc_id, given.given, given.dir
  FROM placed JOIN given ON placed.dir = given.dir OR starts_with(placed.dir, given.dir || '/')
  ORDER BY doc_id, length(given.dir) DESC
)
SELECT doc_id, placed.dir || '/' || name AS path, own.licence AS own_licence,
  round(own.score, 3) AS own_score, coalesce(own.licence, near.given) AS licence,
  CASE WHEN own.whole = 1 THEN 'licence file' WHEN own.whole = 0 THEN 'statement'
    WHEN near.given IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN own.licence IS NULL THEN near.dir END AS inherited_from
FROM placed LEFT JOIN own USING (doc_id) LEFT JOIN near USING (doc_id)
"""


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, cast(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_LEAKS = f"""
WITH items AS (
  SELECT cast(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark
),
windows AS (
  SELECT DISTINCT item, len(p) AS size, array_to_string(p, ' ') AS p FROM (
    SELECT item, w[i:i + least(len(w), 10) - 1] AS p
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0
  )
),
docs AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM docs, sizes, unnest(range(1, len(w) - size + 2)) AS r(i)
),
found AS (SELECT doc_id, places.size, i, item FROM places JOIN windows USING (p, size)),
hit AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, size)) AS r(k) GROUP BY doc_id
),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT doc_id, lines[i] AS line, i,
    {_LOWERED.format("trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM cut, unnest(range(1, len(lines) + 1)) AS r(i)
),
shared AS (
  SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
kept AS (
  SELECT line.*, coalesce(first <> doc_id, false) AS gone FROM line LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


# the bytes of the decimal id, one after the other, through the table of the reflected polynomial
_CRC = """crc_step AS (
  SELECT list(list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY k) AS step
  FROM range(256) r(k)
),
crcs AS (
  SELECT doc_id, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents), crc_step
)"""


def _manifest(doc_levels: int = 9, lang_levels: int = 5) -> str:
    """Trees of up to 8^9 documents a language and 8^5 languages, one level of nodes after the other."""

    def leaf(text: str) -> str:
        fields = ["cast(doc_id AS VARCHAR)", "source", "lang", "cast(n_chars AS VARCHAR)", text]
        return f"sha256({' || '.join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields)})"

    def tree(name: str, levels: int) -> list[str]:
        """From ``{name}_0(t, i, d, n)``: nodes with what stands before and after them in their run."""
        out = []
        for k in range(levels):
            run = "PARTITION BY t, i // 8 ORDER BY i ROWS BETWEEN"
            out.append(f"""{name}_s{k} AS (SELECT *, n > 1 AS up,
  coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}_{k})""")
            out.append(f"""{name}_{k + 1} AS (SELECT t, i // 8 AS i,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d,
  cast(ceil(any_value(n) / 8.0) AS BIGINT) AS n FROM {name}_{k} GROUP BY t, i // 8)""")
        return out

    def climb(start: str, name: str, levels: int) -> list[str]:
        """Follow every row of ``start`` (with t, p, siblings, fold) up to the root of its tree."""
        out, last = [], start
        for k in range(levels):
            table = f"{start}_{k}"
            out.append(f"""{table} AS (SELECT c.* REPLACE (
    CASE WHEN up THEN siblings || before || after ELSE siblings END AS siblings,
    CASE WHEN up THEN sha256(before || fold || after) ELSE fold END AS fold, p // 8 AS p)
  FROM {last} c JOIN {name}_s{k} s ON s.t = c.t AND s.i = c.p)""")
            last = table
        return out

    parts = [
        f"""leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf("text")} AS d,
  CASE WHEN crc % 3 = 0 THEN {leaf(_LOWERED.format("text"))} END AS changed FROM documents JOIN crcs USING (doc_id))""",
        """a_rows AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, d) - 1 AS i,
  count(*) OVER (PARTITION BY t) AS n FROM leaves)""",
        "a_0 AS (SELECT t, i, d, n FROM a_rows)",
        *tree("a", doc_levels),
        f"""b_rows AS (SELECT t AS lang_tree, d AS subroot, row_number() OVER (ORDER BY encode(t)) - 1 AS i,
  count(*) OVER () AS n FROM a_{doc_levels})""",
        "b_0 AS (SELECT '' AS t, i, subroot AS d, n FROM b_rows)",
        *tree("b", lang_levels),
        """start_a AS (SELECT doc_id, d AS leaf, t, i AS p, '' AS siblings, coalesce(changed, d) AS fold FROM a_rows)""",
        *climb("start_a", "a", doc_levels),
        f"""start_b AS (SELECT doc_id, leaf, subroot, '' AS t, b.i AS p, siblings, fold
  FROM start_a_{doc_levels - 1} a JOIN b_rows b ON b.lang_tree = a.t)""",
        *climb("start_b", "b", lang_levels),
    ]
    return (
        f"WITH {_CRC}, "
        + ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, subroot, top.d AS root, sha256(siblings) AS proof_sha256, fold AS folded_root,
  fold = top.d AS verified
FROM start_b_{lang_levels - 1}, b_{lang_levels} top"""
    )


def oracle_sql() -> dict[str, str]:
    return {
        "op1_licence": _licence(),
        "op6_chat": _CHAT,
        "op7_decontamination": _LEAKS,
        "op9_topk": _TOP_K,
        "op11_lines": _LINES,
        "op12_manifest": _manifest(),
    }
