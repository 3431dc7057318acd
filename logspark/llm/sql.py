"""SQL of the operators that DuckDB can state, over whole tables."""

from __future__ import annotations

from logspark.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES
from logspark.llm.mixing import MIX_SHARE, MOST, SLOPES, WEIGHTS

WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Windows of 50 words by their text; a word is removed if a window over it starts in an earlier document.
SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(list_slice(w, s, s + 49), ' ')) AS h
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS p FROM win JOIN first USING (h) WHERE f < doc_id)),
word AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d)),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS k, count(gone.p) AS n_removed
         FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""

#: All pairs that share a shingle, exact similarity, smallest reachable id.
NEARDUP = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(LOWER, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS x
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM d UNION SELECT link.a, reach.r FROM link JOIN reach ON link.b = reach.a),
comp AS (SELECT a AS doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
""".replace("LOWER", LOWER)

#: Water filling in closed form: sources in order of limit by weight, the level at which the sum is met.
MIXING = f"""
WITH z AS (SELECT doc_id, source, max(len({WORDS}))::BIGINT AS size FROM documents GROUP BY 1, 2),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM z GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][i % {len(WEIGHTS)} + 1]::DOUBLE AS weight, [{', '.join(map(str, SLOPES))}][i % {len(SLOPES)} + 1]::DOUBLE AS slope, {MOST}::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
             sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
level AS (SELECT (({MIX_SHARE}::DOUBLE * (SELECT sum(size) FROM z)) - before_cap) / rest AS v FROM o WHERE (({MIX_SHARE}::DOUBLE * (SELECT sum(size) FROM z)) - before_cap) / rest <= cap / weight ORDER BY cap / weight, i LIMIT 1),
t AS (SELECT w.*, least(cap, coalesce((SELECT v FROM level), 1e300) * weight) AS target FROM w),
r AS (SELECT z.doc_id, z.size, t.source_size, t.target, t.slope, floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size + 1e-12 ELSE 0 END) AS whole,
             sum(z.size) OVER (PARTITION BY z.source ORDER BY substr(sha256('mix:' || coalesce(z.doc_id::VARCHAR, '')), 1, 15), z.doc_id ROWS UNBOUNDED PRECEDING) - z.size AS before
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN before + size / 2.0::DOUBLE <= target - whole * source_size AND target - whole * source_size > 0 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS copies,
             least(1.0::DOUBLE, (before + size / 2.0::DOUBLE) / greatest(target, 1)) AS u FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies,
       round(CASE WHEN copies > 0 THEN CASE WHEN abs(slope) < 1e-9 THEN u ELSE (1 + slope - sqrt(greatest(0, (1 + slope) * (1 + slope) - 4 * slope * u))) / (2 * slope) END END, 6) AS position
FROM k
"""

_TERMS = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(text.split())))}], {len(text.split())})" for label, text in TEMPLATES.items())
_PHRASES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in text.split())}])" for label, text in PHRASES.items())
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases by position; templates by the share of their words that a line, or a window of a paragraph, holds.
LICENSES = f"""
WITH p(label, words) AS (VALUES {_PHRASES}), t(label, words, n) AS (VALUES {_TERMS}),
d AS (SELECT doc_id, {LOWER} AS low FROM documents),
dw AS (SELECT doc_id, low, regexp_extract_all(low, '{_WORD}') AS w FROM d),
starts AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, words, unnest(generate_series(1, len(w) - len(words) + 1)) AS i FROM dw, p WHERE contains(low, words[1]) AND len(w) >= len(words)) WHERE list_slice(w, i, i + len(words) - 1) = words),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM starts GROUP BY 1),
lines AS (SELECT doc_id, i, regexp_extract_all(line, '{_WORD}') AS w FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS i FROM d)),
pars AS (SELECT doc_id, flatten(list(w ORDER BY i)) AS w FROM (SELECT *, sum((len(w) = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM lines) GROUP BY doc_id, p),
blocks AS (SELECT doc_id, label, words, list_distinct(w) AS w FROM lines, t WHERE len(w) BETWEEN 1 AND 2 * n - 1
           UNION ALL SELECT doc_id, label, words, list_distinct(list_slice(w, s + 1, s + 2 * n - 1)) FROM (SELECT doc_id, label, words, n, w, unnest(generate_series(0, len(w) - 1, n)) AS s FROM pars, t WHERE len(w) > 0)),
hit AS (SELECT doc_id, label, max(len(list_intersect(w, words))::DOUBLE / len(words)) AS c FROM blocks WHERE len(list_intersect(w, words)) >= {CONTAINMENT}::DOUBLE * len(words) - 1e-9 GROUP BY 1, 2),
more AS (SELECT doc_id, list(label) AS labels, max(c) AS best FROM hit GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0) END AS score
FROM dw LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""



def _round(r: int) -> str:
    """Assignment to the centroids of round r, and the next centroids: floors of exact means, empty clusters as before."""
    return f"""
a{r} AS (SELECT rid, min({{'d': d, 'c': c}}) AS b FROM (SELECT rid, c, list_sum([(v[i] - m[i]) * (v[i] - m[i]) for i in range(1, 65)])::BIGINT AS d FROM k, c{r}) GROUP BY rid),
c{r + 1} AS (SELECT c{r}.c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(x ORDER BY i) AS m FROM (
        SELECT c, i, floor(sum(x) / count(*))::BIGINT AS x FROM (SELECT b.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k JOIN a{r} USING (rid)) GROUP BY 1, 2)
    GROUP BY c) n ON n.c = c{r}.c)"""


#: Three rounds over all vectors and all centroids, and the last assignment.
CENTROIDS = f"""
WITH k AS (SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
           WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM k ORDER BY h, v LIMIT 16)),
{",".join(_round(r) for r in range(4))},
o AS (SELECT vec_id, b.c AS cluster, b.d AS distance FROM k JOIN a3 USING (rid))
SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256
FROM o JOIN c3 ON c3.c = o.cluster
"""

#: Base32 of the SHA-1: each five hexadecimal digits are four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_reduce([list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31)::INT + 1, 1) for s in [15, 10, 5, 0]], lambda a, b: a || b)
                    for v in [('0x' || substr(h, 5 * i + 1, 5))::BIGINT for i in range(8)]], lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM q
"""

SQL = {"op5_licenses": LICENSES, "op6_substring": SUBSTRING, "op8_neardup": NEARDUP, "op10_mixing": MIXING, "op12_centroids": CENTROIDS, "op13_warc": WARC}
