"""DuckDB SQL that gives the rows of the registered queries of this subpackage."""

from codeloom.llm import mixing

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DUPLICATES = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e, len(embedding) AS d
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _fold(expr: str, target: dict) -> str:
    listed = ", ".join(f"'{v}'" for v in target if v != mixing.OTHER)
    return f"CASE WHEN {expr} IN ({listed}) THEN {expr} ELSE '{mixing.OTHER}' END"


def _shares(expr: str, target: dict) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {float(s)!r}::DOUBLE" for v, s in target.items())
    return f"CASE {expr} {cases} ELSE 0.0::DOUBLE END"


def mixture() -> str:
    targets = {"source": mixing.SOURCES, "lang": mixing.LANGS, "topic": mixing.TOPICS}
    dims = list(mixing.DIMENSIONS)
    key = ", ".join(dims)
    steps = [f"""
d0 AS (SELECT *, coalesce(text, '') AS body, len({WORDS})::BIGINT AS n_tokens FROM documents),
d1 AS (SELECT *, CASE
    WHEN (length(body) - length(translate(body, '|$%&#*!<>{{}}=', ''))) * 20 > length(body) THEN 'other'
    WHEN n_tokens < 100 THEN 'short' WHEN n_tokens < 800 THEN 'article' ELSE 'long' END AS kind FROM d0),
docs AS (SELECT doc_id, n_tokens, {_fold('source', targets['source'])} AS source,
    {_fold('lang', targets['lang'])} AS lang, {_fold('kind', targets['topic'])} AS topic FROM d1),
cells AS (SELECT {key}, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY {key} HAVING sum(n_tokens) > 0),
x0 AS (SELECT *, sum(tokens) OVER ()::DOUBLE AS total, tokens / sum(tokens) OVER () AS w,
    {', '.join(f"{_shares(d, targets[d])} AS s_{d}, row_number() OVER (PARTITION BY {d} ORDER BY {key}) = 1 AS f_{d}"
               for d in dims)} FROM cells),
w0 AS (SELECT {key}, tokens, total, w,
    {', '.join(f"s_{d} / nullif(sum(CASE WHEN f_{d} THEN s_{d} END) OVER (), 0) AS t_{d}" for d in dims)} FROM x0)"""]
    n = 0
    for _ in range(mixing.SWEEPS):
        for d in dims:
            steps.append(f"""w{n + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER p > 0
    THEN w * t_{d} / sum(w) OVER p ELSE 0 END AS w) FROM w{n} WINDOW p AS (PARTITION BY {d}))""")
            n += 1
    steps.append(f"""
need AS (SELECT *, CASE WHEN w > 0 THEN tokens / w END AS need FROM w{n}),
run AS (SELECT *, coalesce(sum(tokens) OVER (ORDER BY need NULLS LAST, {key}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(w) OVER (ORDER BY need NULLS LAST, {key} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM need),
scaled AS (SELECT *, CASE WHEN open > 0 THEN ({mixing.BUDGET} * total - given) / open END AS scale FROM run),
levels AS (SELECT *, scale >= need AS runs_out, (SELECT arg_min(scale, row(need, {key})) FROM scaled
    WHERE NOT (scale >= need)) AS level FROM scaled),
found AS (SELECT {key}, round(CASE WHEN w <= 0 THEN 0.0 WHEN runs_out OR level IS NULL THEN 1.0
    ELSE least(1.0, greatest(0.0, level * w / tokens)) END::DOUBLE, 9) AS probability FROM levels)
SELECT doc_id, source, lang, topic, n_tokens, coalesce(probability, 0.0)::DOUBLE AS probability,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE
      < coalesce(probability, 0.0) AS sampled
FROM docs LEFT JOIN found USING ({key})""")
    return "WITH " + ",\n".join(steps)

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents
), k AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y,
         array_to_string(u[b + 1:n], '') AS z FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y
                        WHEN 'spm' THEN '<S>' || z || '<P>' || x || '<M>' || y ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

WARC_RECORDS = r"""
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1, 1)))), '')
         AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""
