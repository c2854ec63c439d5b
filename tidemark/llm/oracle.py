"""SQL checks, for DuckDB over the same tables."""

from __future__ import annotations

from tidemark.llm import licenses, quality

WORDS = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _levelled(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), {_quoted(licenses.COPYRIGHT_LINE)}, '\\1', 'g')"
    out = f"regexp_replace({out}, {_quoted(licenses.RESERVED)}, '', 'g')"
    out = f"' ' || regexp_replace(regexp_replace({out}, {_quoted(licenses.NEITHER)}, ' ', 'g'), ' *\\n *', ' ' || chr(10) || ' ', 'g') || ' '"
    for have, want in licenses.SPELLINGS.items():
        out = f"replace({out}, {_quoted(' ' + have)}, {_quoted(' ' + want)})"
    return out


def license_scan() -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in licenses.KNOWN)
    entire = "trim(regexp_replace(lines, ' *\\n *', ' ', 'g'))"
    return f"""WITH known AS (SELECT sha256(regexp_replace({entire}, ' +', ' ', 'g')) AS known_digest, min(license_id) AS license_id
  FROM (SELECT license_id, {_levelled('text')} AS lines FROM (VALUES {known}) AS k(license_id, text)) GROUP BY 1),
level AS (SELECT doc_id, {_levelled('text')} AS lines FROM documents),
units AS (SELECT doc_id, 0 AS unit, {entire} AS words FROM level
  UNION ALL SELECT doc_id, CAST(generate_subscripts(parts, 1) AS INTEGER), trim(unnest(parts)) FROM (SELECT doc_id, string_split(lines, chr(10)) AS parts FROM level)),
hashed AS (SELECT doc_id, unit, sha256(words) AS digest, sha256(regexp_replace(words, ' +', ' ', 'g')) AS known_digest FROM units WHERE unit = 0 OR words <> '')
SELECT doc_id, unit, digest, license_id FROM hashed LEFT JOIN known USING (known_digest) WHERE unit = 0 OR license_id IS NOT NULL"""


def quality_rules() -> str:
    def vote(signal: str, good: float | None, bad: float) -> str:
        more = signal in quality.RISING
        fine = "FALSE" if good is None else f"{signal} >= {good}" if more else f"{signal} <= {good}"
        return f"CASE WHEN {signal} {'<' if more else '>'} {bad} THEN -1 WHEN {fine} THEN 1 ELSE 0 END"
    votes = [vote(signal, good, bad) for _, signal, good, bad in quality.RULES]
    k, prior, start = len(votes), quality.PRIOR_ROWS, quality.START
    names = ", ".join(f"v{j}" for j in range(k))
    right, wrong = start / 2, (1 - start) / 2
    rounds = ""
    for r in range(1, quality.ROUNDS + 1):
        rounds += f""",
g{r} AS MATERIALIZED (SELECT pid, n, 1 / (1 + exp(-(max(o) + sum(lr)))) AS g FROM vt JOIN r{r - 1} USING (j, v) CROSS JOIN o{r - 1} GROUP BY pid, n),
t{r} AS MATERIALIZED (SELECT sum(g * n) AS ng, sum(n) - sum(g * n) AS nb FROM g{r}),
o{r} AS MATERIALIZED (SELECT ln((ng + {prior}) / (nb + {prior})) AS o FROM t{r}),
s{r} AS MATERIALIZED (SELECT j, v, sum(g * vt.n) AS good, sum((1 - g) * vt.n) AS bad FROM vt JOIN g{r} USING (pid) GROUP BY j, v),
r{r} AS MATERIALIZED (SELECT j, v, ln(({prior} * ig + coalesce(good, 0)) / (ng + {prior})) - ln(({prior} * ib + coalesce(bad, 0)) / (nb + {prior})) AS lr
  FROM prior LEFT JOIN s{r} USING (j, v) CROSS JOIN t{r})"""
    stops = ", ".join(_quoted(w) for w in quality.STOPS)
    return f"""WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
words AS MATERIALIZED (SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM base),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM base),
line_counts AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines WHERE regexp_matches(x, '{WORDS}') GROUP BY rid),
word_counts AS (SELECT rid, count(DISTINCT x) AS n_distinct, count(*) FILTER (WHERE x IN ({stops})) AS n_stops FROM words GROUP BY rid),
windows AS (SELECT rid, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS x FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM windows WHERE x IS NOT NULL) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice CROSS JOIN (VALUES (0), (1), (2)) AS s(k) GROUP BY rid),
counted AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, length(regexp_replace(t, '[^!?;:=~^_+/\\\\{{}}\\[\\]@]+', '', 'g')) AS n_marks,
  length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  n_distinct, n_stops, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM base LEFT JOIN line_counts USING (rid) LEFT JOIN word_counts USING (rid) LEFT JOIN repeats USING (rid)),
signals AS (SELECT *, n_symbols / nullif(word_chars, 0) AS symbol_share, n_repeat_words / nullif(n_words, 0) AS repeat_share, n_dup_lines / nullif(n_lines, 0) AS dup_line_share,
  n_upper / nullif(word_chars, 0) AS upper_share, n_distinct / sqrt(nullif(n_words, 0)) / 10 AS variety, word_chars / nullif(n_words, 0) AS mean_length,
  n_marks / nullif(n_words, 0) AS mark_share, n_stops / nullif(n_words, 0) AS stop_share,
  n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed FROM counted),
voted AS MATERIALIZED (SELECT *, {', '.join(f'{v} AS v{j}' for j, v in enumerate(votes))} FROM signals),
pat AS MATERIALIZED (SELECT row_number() OVER () AS pid, * FROM (SELECT {names}, count(*) AS n FROM voted GROUP BY {names})),
vt AS MATERIALIZED ({' UNION ALL '.join(f'SELECT pid, n, {j} AS j, v{j} AS v FROM pat' for j in range(k))}),
prior AS MATERIALIZED (SELECT j, v, ig, ib FROM range({k}) AS a(j) CROSS JOIN (VALUES (1, {right}, {wrong}), (0, 0.5, 0.5), (-1, {wrong}, {right})) AS p(v, ig, ib)),
r0 AS MATERIALIZED (SELECT j, v, ln(CAST(ig AS DOUBLE) / ib) AS lr FROM prior), o0 AS (SELECT CAST(0 AS DOUBLE) AS o){rounds},
posterior AS (SELECT pid, 1 / (1 + exp(-(max(o) + sum(lr)))) AS q FROM vt JOIN r{quality.ROUNDS} USING (j, v) CROSS JOIN o{quality.ROUNDS} GROUP BY pid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(q, 4) AS quality, NOT base_failed AND q >= {quality.THRESHOLD} AS kept
FROM voted JOIN pat USING ({names}) JOIN posterior USING (pid)"""


#: State of a crc32 after each value of its lowest eight bits.
CRC_TABLE = """(SELECT list(c ORDER BY n) AS t FROM (WITH RECURSIVE r AS (SELECT n, 0 AS k, CAST(n AS BIGINT) AS c FROM range(256) AS a(n) UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE k < 8) SELECT n, c FROM r WHERE k = 8))"""


def _crc(h: str) -> str:
    """crc32 of bytes in hexadecimal digits, with the table as t."""
    steps = f"list_transform(regexp_extract_all({h}, '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def sharding(shards: int, seed: str = "0") -> str:
    """Places by the same fractions; crc32 byte by byte."""
    return f"""WITH rows_ AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS len FROM documents),
crc AS (SELECT rid, {_crc('h')} AS crc FROM rows_ CROSS JOIN {CRC_TABLE}),
keyed AS (SELECT *, md5('{seed}:' || doc_id) AS o, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s FROM rows_),
ranked AS (SELECT *, (2 * (row_number() OVER (PARTITION BY s ORDER BY o, doc_id) - 1) + 1) / (2 * count(*) OVER (PARTITION BY s)) AS f FROM keyed),
placed AS (SELECT *, row_number() OVER (ORDER BY f, s, o, doc_id) - 1 AS p, count(*) OVER () AS total FROM ranked)
SELECT doc_id, CAST(len + 16 AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(p * {shards} // total AS INTEGER) AS shard,
  CAST(p - ((p * {shards} // total) * total + {shards - 1}) // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed JOIN crc USING (rid)"""


def repeats(length: int) -> str:
    """Every string of every text by its digest; removed runs from the starts of those that occur twice."""
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT rid, s, md5(b[s:s + {length - 1}]) AS h FROM (SELECT rid, b, unnest(range(1, octet_length(b) - {length - 2})) AS s FROM d)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
marked AS (SELECT rid, s, CASE WHEN s > lag(s) OVER (PARTITION BY rid ORDER BY s) + {length} THEN 1 ELSE 0 END AS fresh FROM twice),
runs AS (SELECT rid, min(s) AS a, max(s) + {length - 1} AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY rid ORDER BY s) AS g FROM marked) GROUP BY rid, g),
gaps AS (SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS p, a - 1 AS q FROM runs UNION ALL SELECT rid, max(z) + 1, NULL FROM runs GROUP BY rid),
kept AS (SELECT rid, string_agg(CASE WHEN q IS NULL THEN hex(b[p:octet_length(b)]) WHEN q >= p THEN hex(b[p:q]) ELSE '' END, '' ORDER BY p) AS h FROM gaps JOIN d USING (rid) GROUP BY rid),
sums AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(z - a + 1) AS BIGINT) AS n_removed FROM runs GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN h IS NULL THEN sha256(b) ELSE sha256(unhex(h)) END AS kept_sha256 FROM d LEFT JOIN kept USING (rid) LEFT JOIN sums USING (rid)"""


def near_classes(words: int, threshold: float) -> str:
    """All pairs that share an n-gram, their exact similarity, and what the links connect."""
    window = ", ' ', ".join(f"w[i + {k}]" for k in range(words))
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT rid, g FROM (
  SELECT rid, concat({window}) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {words - 2})) AS i FROM d WHERE len(w) >= {words})
  UNION ALL SELECT rid, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {words - 1})),
sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM grams GROUP BY rid),
shared AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM grams x JOIN grams y USING (g) WHERE x.rid <> y.rid GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b, c = p.n AND c = q.n AS same FROM shared JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE c >= {threshold} * (p.n + q.n - c)),
reach AS (SELECT rid AS a, rid AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
classes AS (SELECT a AS rid, min(d.doc_id) AS class_id FROM reach JOIN d ON d.rid = reach.b GROUP BY a),
equal_sets AS (SELECT a AS rid, min(d.doc_id) AS other FROM links JOIN d ON d.rid = b WHERE same GROUP BY a),
counts AS (SELECT a AS rid, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(other, doc_id)) AS set_id, class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links
FROM d JOIN classes USING (rid) LEFT JOIN equal_sets USING (rid) LEFT JOIN counts USING (rid)"""


def spelling_variants(slip: int, min_length: int, min_count: int) -> str:
    """Near words share what is left after deleting the letter at one place, or one is what is left of the other."""
    letters = "[A-Za-zÀ-ÿ]+"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS n FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{letters}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY ALL),
keyed AS (SELECT row_number() OVER () AS rid, w, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM runs),
crcs AS (SELECT rid, w, n, {_crc('h')} AS crc FROM keyed CROSS JOIN {CRC_TABLE}),
slips AS (SELECT CASE WHEN crc % {slip} = 0 THEN substr(w, 1, CAST(crc % length(w) AS INTEGER)) || substr(w, CAST(crc % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM crcs),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slips WHERE length(word) >= {min_length} GROUP BY word HAVING sum(n) >= {min_count}),
less AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words) UNION ALL SELECT word, 0, word FROM words),
near AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b FROM less a JOIN less b USING (d) WHERE a.word <> b.word AND (a.i = b.i OR (a.i = 0) <> (b.i = 0))),
ways AS (SELECT a, b, y.n AS bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY y.n DESC, b) AS turn FROM near JOIN words y ON y.word = b),
led AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ways WHERE turn = 1) ON a = word),
walk AS (SELECT word, word AS at FROM led UNION ALL SELECT walk.word, led.form FROM walk JOIN led ON led.word = walk.at WHERE led.form IS NOT NULL)
SELECT led.word, led.n, led.n_near, led.form, led.form_n, walk.at AS root FROM led JOIN walk USING (word) JOIN led AS last ON last.word = walk.at WHERE last.form IS NULL"""


def collocations(longest: int, min_count: int, top: int, covered: int) -> str:
    """Every n-gram length exploded on its own."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces WHERE len(w) >= {k})" for k in range(1, longest + 1))
    return f"""WITH pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
f AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM ({grams}) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, p AS phrase, f AS a, string_split(p, ' ') AS w FROM f WHERE k >= 2 AND f >= {min_count}),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM cand),
scored AS (SELECT cuts.lang, phrase, a, c, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.p = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cuts.lang AND y.p = array_to_string(w[c + 1:cuts.k], ' ') JOIN total ON total.lang = cuts.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.lang = s.lang AND length(b.phrase) > length(s.phrase)
  AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= {covered} * s.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""


def nearest_vectors(k: int, every: int) -> str:
    """Every query against every row."""
    return f"""WITH rows_ AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM rows_ q JOIN rows_ c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= {k}"""
