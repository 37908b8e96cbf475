"""The queries that SQL can express, as SQL for an independent engine."""

from __future__ import annotations

from bookloom.llm import licenses

# ASCII white space as a list of code points.
_WHITE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"

LINE_DEDUP = f"""
WITH docs AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
),
placed AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
),
keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM placed
),
repeated AS (
    SELECT key, min(doc_id) AS keeper FROM keyed
    WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
),
judged AS (
    SELECT k.doc_id, pos, line, coalesce(k.doc_id <> r.keeper, FALSE) AS dropped
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id,
       count(*) AS n_lines,
       count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


SUBSTRING_DEDUP = r"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs
),
windows AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER following AS window_text, count(*) OVER following AS n
    FROM placed
    WINDOW following AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
firsts AS (
    SELECT window_text, min(doc_id) AS first_doc FROM windows WHERE n = 13 GROUP BY window_text
),
gone AS (
    SELECT DISTINCT w.doc_id, w.pos + step.step AS pos
    FROM windows w JOIN firsts f USING (window_text), range(13) AS step(step)
    WHERE w.n = 13 AND f.first_doc < w.doc_id
),
judged AS (
    SELECT p.doc_id, p.word, p.pos, g.pos IS NOT NULL AS removed
    FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
),
summed AS (
    SELECT doc_id, count(*) FILTER (removed) AS n_removed,
           string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN summed s USING (doc_id)
"""

SEARCH = rf"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x20\x09-\x0D]+') AS words
    FROM documents WHERE doc_id IS NOT NULL
),
words AS (SELECT doc_id, len(words) AS n_words, unnest(words) AS word FROM docs),
tf AS MATERIALIZED (SELECT doc_id, n_words, word, count(*) AS n FROM words GROUP BY ALL),
df AS MATERIALIZED (SELECT word, count(*) AS df FROM tf GROUP BY word),
corpus AS (SELECT count(*) AS docs, sum(len(words)) / count(*)::DOUBLE AS mean FROM docs),
scored AS (
    SELECT q.doc_id AS query_id, t.doc_id,
           round(sum(ln(1 + (docs - df + 0.5e0) / (df + 0.5e0)) * t.n * 2.2e0
                     / (t.n + 1.2e0 * (0.25e0 + 0.75e0 * t.n_words / mean))), 6) AS score
    FROM tf q JOIN tf t ON t.word = q.word JOIN df ON df.word = q.word, corpus
    WHERE q.doc_id % 20 = 0 GROUP BY ALL
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _windows(table: str, key: str, size: int) -> str:
    """Runs of ``size`` consecutive words."""
    return f"""
    SELECT {key}, pos, {size} AS size, string_agg(word, ' ') OVER following AS window_text,
           count(*) OVER following AS n
    FROM {table}
    WINDOW following AS (PARTITION BY {key} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING)
    QUALIFY n = {size}"""


_SIZES = range(1, 14)

DECONTAMINATION = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '{_WORD}') AS words
    FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '{_WORD}') AS words
    FROM benchmark
),
doc_words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
item_words AS (SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM items),
item_windows AS (
    SELECT DISTINCT w.item_id, w.size, window_text
    FROM ({" UNION ALL ".join(_windows("item_words", "item_id", n) for n in _SIZES)}) w
    JOIN items i ON w.item_id = i.item_id AND w.size = least(13, len(i.words))
),
doc_windows AS ({" UNION ALL ".join(_windows("doc_words", "doc_id", n) for n in _SIZES)}),
hits AS (
    SELECT d.doc_id, d.pos, d.size, i.item_id
    FROM doc_windows d JOIN item_windows i ON d.size = i.size AND d.window_text = i.window_text
),
hit_words AS (
    SELECT doc_id, count(DISTINCT pos + step.step) AS n_hit
    FROM hits, range(13) AS step(step) WHERE step.step < size GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


# Levels of the tree of a group and of the tree over the groups: enough for 3**16 rows.
_LEVELS = 16

_CRC32 = """
    list_reduce(
        list_prepend(4294967295, [b::BIGINT FOR b IN
            list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))]),
        lambda crc, byte: list_reduce(
            list_prepend(xor(crc, byte), range(8)),
            lambda x, step: xor(x // 2, (x % 2) * 3988292384))
    )"""


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


def _merkle() -> str:
    """Levels unrolled: nodes of all trees, then each leaf's siblings and folded digest."""
    ctes = []

    def nodes(tree: str, source: str) -> None:
        ctes.append(f"{tree}0 AS MATERIALIZED ({source})")
        for k in range(_LEVELS):
            ctes.append(f"""{tree}{k + 1} AS MATERIALIZED (
    SELECT tree, i // 3 AS i, (n + 2) // 3 AS n,
           CASE WHEN n > 1 THEN sha256(string_agg(d, '' ORDER BY j)) ELSE min(d) END AS d
    FROM (SELECT tree, i // 3 * 3 AS i, i AS j, n, d FROM {tree}{k}) GROUP BY tree, i, n
)""")

    def climb(walk: str, tree: str, source: str) -> None:
        ctes.append(f"{walk}0 AS MATERIALIZED ({source})")
        for k in range(_LEVELS):
            ctes.append(f"""{walk}{k + 1} AS MATERIALIZED (
    SELECT w.row, w.tree, w.i // 3 AS i,
           w.siblings || coalesce(string_agg(s.d, '' ORDER BY s.i) FILTER (s.i <> w.i), '') AS siblings,
           CASE WHEN any_value(s.n) > 1
                THEN sha256(string_agg(CASE WHEN s.i = w.i THEN w.folded ELSE s.d END, '' ORDER BY s.i))
                ELSE w.folded END AS folded
    FROM {walk}{k} w JOIN {tree}{k} s ON s.tree = w.tree AND s.i // 3 = w.i // 3
    GROUP BY w.row, w.tree, w.i, w.siblings, w.folded
)""")

    fields = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    ctes.append(f"""leaves AS MATERIALIZED (
    SELECT doc_id, source, {" || ".join([*fields, _field("text")])} AS body,
           {" || ".join([*fields, _field("replace(text, chr(10), '')")])} AS spoiled_body,
           coalesce({_CRC32.strip()} % 2 = 1, FALSE) AS spoiled
    FROM documents
)""")
    # The register is inverted at the end, so an even checksum has an odd register.
    ctes.append("""digests AS MATERIALIZED (
    SELECT doc_id, source, sha256(body) AS d, CASE WHEN spoiled THEN sha256(spoiled_body) ELSE sha256(body) END AS claim
    FROM leaves
)""")
    ctes.append("""placed AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, d) AS row,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
           count(*) OVER (PARTITION BY source) AS n
    FROM digests
)""")
    nodes("g", "SELECT tree, i, n, d FROM placed")
    nodes("t", f"SELECT 0 AS tree, tree AS i, count(*) OVER () AS n, d FROM g{_LEVELS}")
    climb("a", "g", "SELECT row, tree, i, '' AS siblings, claim AS folded FROM placed")
    climb("b", "t", f"SELECT row, 0 AS tree, tree AS i, siblings, folded FROM a{_LEVELS}")
    return f"""
WITH {", ".join(ctes)}
SELECT p.doc_id, p.d AS leaf, g.d AS subroot, t.d AS root, sha256(b.siblings) AS proof_sha256,
       b.folded AS folded_root, b.folded = t.d AS verified
FROM placed p JOIN b{_LEVELS} b USING (row) JOIN g{_LEVELS} g ON g.tree = p.tree, t{_LEVELS} t
"""


PHRASES = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
           regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\\x0A-\\x0D]') AS pieces
    FROM documents
),
single AS (SELECT lang, doc, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM pieces),
split AS (SELECT lang, doc, pos, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM single),
words AS (SELECT lang, doc, pos, unnest(words) AS w1, generate_subscripts(words, 1) AS i FROM split),
runs AS MATERIALIZED (
    SELECT lang, w1, lead(w1, 1) OVER piece AS w2, lead(w1, 2) OVER piece AS w3, lead(w1, 3) OVER piece AS w4
    FROM words WINDOW piece AS (PARTITION BY doc, pos ORDER BY i)
),
counts AS MATERIALIZED (
    SELECT lang, size, phrase, count(*)::HUGEINT AS f
    FROM (
        SELECT lang, 1 AS size, w1 AS phrase FROM runs
        UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM runs WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM runs WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM runs WHERE w4 IS NOT NULL
    )
    GROUP BY ALL
),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS MATERIALIZED (
    SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f FROM counts WHERE size >= 2 AND f >= 30
),
cuts AS (
    SELECT lang, phrase, f, k, array_to_string(words[:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS tail
    FROM candidates, (VALUES (1), (2), (3)) AS cuts(k) WHERE k < size
),
scored AS (
    SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.head
    JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
),
weakest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
longer AS (
    SELECT lang, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, max(f) AS f
    FROM candidates, (VALUES (2), (3)) AS lengths(k), (VALUES (1), (2), (3)) AS places(pos)
    WHERE k < size AND pos + k - 1 <= size GROUP BY ALL
),
ranked AS (
    SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank,
           w.phrase, a, l, r, score
    FROM weakest w LEFT JOIN longer x ON x.lang = w.lang AND x.phrase = w.phrase
    WHERE x.f IS NULL OR 100 * x.f < 80 * a
)
SELECT r.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


def _licenses() -> str:
    """Phrases by place; templates by brute force: every block with every template."""
    templates = licenses.prepared(licenses.TEMPLATES, {}, licenses.SHARE)
    words = _values((t.number, w) for t in templates for w in t.words)
    sizes = _values((t.number, t.label, t.size_class, len(t.words), t.needed) for t in templates)
    spoken = [(k, *licenses.template_words(text)) for k, (_, text) in enumerate(licenses.PHRASES)]
    places = " UNION ALL ".join(
        f"SELECT w1.row, w1.pos, '{label}' AS label FROM {', '.join(f'words w{n}' for n in range(1, len(found)))} WHERE "
        + " AND ".join(
            [f"w{n}.word = '{word}'" for n, word in enumerate(found[1:], 1)]
            + [f"w{n}.row = w1.row AND w{n}.pos = w1.pos + {n - 1}" for n in range(2, len(found))]
        )
        for (label, _), found in zip(licenses.PHRASES, spoken)
    )
    return f"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '{_WORD}') AS held
    FROM documents
),
words AS MATERIALIZED (
    SELECT row, unnest(held) AS word, generate_subscripts(held, 1) - 1 AS pos FROM docs
),
places AS ({places}),
base AS (
    SELECT row, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS named
    FROM places GROUP BY row
),
sizes(template, label, size, n, needed) AS (VALUES {sizes}),
template_words(template, word) AS (VALUES {words}),
met AS (
    SELECT row, template, pos // size - back AS block, count(DISTINCT word) AS shared
    FROM words JOIN template_words USING (word) JOIN sizes USING (template), (VALUES (0), (1)) AS backs(back)
    WHERE pos // size - back >= 0
    GROUP BY ALL
),
found AS (
    SELECT row, list(DISTINCT label) AS labels, max(shared / n) AS share
    FROM met JOIN sizes USING (template) WHERE shared >= needed GROUP BY row
)
SELECT doc_id, len(held) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(named), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(named, []), coalesce(labels, [])))), ','), '')
           AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM docs LEFT JOIN base USING (row) LEFT JOIN found USING (row)
"""


def all_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": SUBSTRING_DEDUP,
        "op5_search": SEARCH,
        "op8_decontamination": DECONTAMINATION,
        "op10_line_dedup": LINE_DEDUP,
        "op11_merkle": _merkle(),
        "op12_phrases": PHRASES,
        "op13_licenses": _licenses(),
    }
