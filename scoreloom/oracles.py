"""The same results in plain SQL, for the registered queries. Runs on DuckDB over the same tables."""

from __future__ import annotations



def _spell_rounding(sql: str) -> str:
    """Write ``round(x, d)`` as ``floor(x * 10^d + 0.5) / 10^d``: halves upwards, in plain double arithmetic."""
    while (start := sql.find("round(")) >= 0:
        depth, comma, end = 0, -1, start + 5
        for end in range(start + 5, len(sql)):
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            if depth == 1 and sql[end] == ",":
                comma = end
        value, factor = sql[start + 6 : comma], f"1e{sql[comma + 1 : end].strip()}"
        sql = f"{sql[:start]}(floor(CAST({value} AS DOUBLE) * {factor} + 0.5) / {factor}){sql[end + 1 :]}"
    return sql


# ---- shared pieces --------------------------------------------------------------------------------------

# Elements of every embedding, with the class means as a linear model over them.
_VECTORS = """
x AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
w AS (SELECT label AS class_id, dim, avg(v) AS w FROM x GROUP BY 1, 2),
b AS (SELECT class_id, -0.5 * sum(w * w) AS b FROM w GROUP BY 1),
"""

# The same after rounding the model.
_ROUNDED = """
wr AS (SELECT class_id, dim, round(w, 2) AS w FROM w),
br AS (SELECT class_id, round(b, 2) AS b FROM b),
"""


def _half(x: str) -> str:
    """Nearest number of half precision: eleven significant bits, halves to the even one."""
    unit = f"pow(2, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / {unit}, 0) * {unit} END"


# The same in half precision.
_HALF = f"""
wh AS (SELECT class_id, dim, {_half('w')} AS w FROM w),
bh AS (SELECT class_id, {_half('b')} AS b FROM b),
"""


def _best(inputs: str = "x", weights: str = "w", bias: str = "b", out: str = "best") -> str:
    """Best class (the first on a tie) and softmax score of every row of ``inputs``."""
    return f"""
z_{out} AS MATERIALIZED (
  SELECT s.vec_id, s.class_id, s.z + {bias}.b AS z
  FROM (SELECT i.vec_id, m.class_id, sum(i.v * m.w) AS z FROM {inputs} i JOIN {weights} m ON i.dim = m.dim GROUP BY 1, 2) s
  JOIN {bias} ON s.class_id = {bias}.class_id),
t_{out} AS (SELECT vec_id, max(z) AS top FROM z_{out} GROUP BY 1),
{out} AS (
  SELECT z.vec_id, min(CASE WHEN z.z = t.top THEN z.class_id END) AS pred, 1 / sum(exp(z.z - t.top)) AS score
  FROM z_{out} z JOIN t_{out} t ON z.vec_id = t.vec_id GROUP BY 1)"""


# Pixels of the 8 x 8 pictures, and their bilinear halves (both passes round to bytes).
_PIXELS = """
px AS (
  SELECT vec_id, label, (d - 1) // 8 AS y, (d - 1) % 8 AS x,
         CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 1) * 127.5))) AS INT) AS p
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings)),
"""
_SMALL = _PIXELS + """
tri AS (
  SELECT o, i, greatest(0.0, 1 - abs(CAST(i AS DOUBLE) + 0.5 - (o + 0.5) * 2) / 2) AS g
  FROM range(4) AS ro(o), range(8) AS ri(i)),
axis AS (SELECT o, i, CAST(floor(g / sum(g) OVER (PARTITION BY o) * 4194304 + 0.5) AS BIGINT) AS g FROM tri),
across AS (
  SELECT px.vec_id, px.label, px.y, axis.o AS x, CAST((2097152 + sum(px.p * axis.g)) // 4194304 AS INT) AS p
  FROM px JOIN axis ON px.x = axis.i GROUP BY 1, 2, 3, 4),
small AS (
  SELECT a.vec_id, a.label, axis.o AS y, a.x, CAST((2097152 + sum(a.p * axis.g)) // 4194304 AS INT) AS p
  FROM across a JOIN axis ON a.y = axis.i GROUP BY 1, 2, 3, 4),
"""
_TENSORS = _SMALL + """
channel AS (
  SELECT * FROM (VALUES (0, CAST(0.485 AS DOUBLE), CAST(0.229 AS DOUBLE)), (1, 0.456, 0.224), (2, 0.406, 0.225)) AS c(c, mean, std)),
tensor AS (
  SELECT vec_id, label, c * 16 + y * 4 + x AS dim, (CAST(p AS DOUBLE) / CAST(255 AS DOUBLE) - mean) / std AS v
  FROM small, channel),
w AS (SELECT label AS class_id, dim, avg(v) AS w FROM tensor GROUP BY 1, 2),
b AS (SELECT class_id, -0.5 * sum(w * w) AS b FROM w GROUP BY 1),
"""
_PICTURES = "WITH " + _TENSORS + _best("tensor")
_FILE = "'class_' || e.label || '/' || lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'"


def _run(artifact: str) -> str:
    return _PICTURES + f"""
SELECT {_FILE} AS path, 'class_' || pred AS label, round(score, 6) AS score, {artifact} AS artifact
FROM best JOIN embeddings e ON best.vec_id = e.vec_id"""


_FOLDS = """
x AS (SELECT vec_id, label, vec_id % 10 + 1 AS version, CAST(unnest(embedding) AS DOUBLE) AS v,
             generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
w AS (SELECT version, label AS class_id, dim, avg(v) AS w FROM x GROUP BY 1, 2, 3),
"""

_PAGE = """lpad(CAST(page_id AS VARCHAR), 6, '0') || CASE WHEN starts_with(url, 'https') THEN '.html' ELSE '.htm' END"""
_PAGE = r"regexp_extract(url, '\.example\.([a-z]+)/', 1) || '/' || " + _PAGE
_DOCUMENT = "'/vol/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt'"


def _caption(label: str, score: str) -> str:
    """``label (12.3%)`` from whole numbers: the exact binary percentage, rounded half to even."""
    n = f"CAST({score} * 100 * 72057594037927936 AS HUGEINT) * 10"
    unit = "CAST(72057594037927936 AS HUGEINT)"
    whole, rest = f"(({n}) // {unit})", f"(({n}) % {unit})"
    tenths = f"({whole} + CASE WHEN {rest} * 2 > {unit} OR ({rest} * 2 = {unit} AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"{label} || ' (' || CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || '%)'"


_HALVES = """
SELECT event_type,
  count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS n1, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS n2,
  CAST(sum(CAST(value AS DECIMAL(28,9))) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS DOUBLE) AS s1,
  CAST(sum(CAST(value AS DECIMAL(28,9))) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS DOUBLE) AS s2
FROM events GROUP BY 1"""

_SECONDS = "CAST(value AS DECIMAL(28,9))"

# ---- one entry per query --------------------------------------------------------------------------------

_QUERIES: dict[str, str] = {
    # files
    "list_files": f"SELECT {_PAGE} AS path, strlen(html) AS length FROM pages",
    "first_files": f"SELECT {_PAGE} AS path, strlen(html) AS length FROM pages ORDER BY path LIMIT 100",
    "list_tree": f"SELECT {_PAGE} AS path, strlen(html) AS length FROM pages",
    "glob_filter": f"SELECT {_PAGE} AS path, strlen(html) AS length FROM pages WHERE starts_with(url, 'https')",
    "binary_scan": f"SELECT {_PAGE} AS path, strlen(html) AS length, md5(html) AS md5 FROM pages",
    "read_paths": f"SELECT {_PAGE} AS path, md5(html) AS md5 FROM pages",
    "normalise_path": f"SELECT doc_id, {_DOCUMENT} AS path FROM documents",
    "size_profile": """
SELECT lang, count(*) AS n_files, round(CAST(sum(n_chars) AS DOUBLE) / count(*) / 1024, 3) AS avg_kb,
       min(n_chars) AS min_bytes, max(n_chars) AS max_bytes FROM documents GROUP BY 1""",
    "base64_table": """
SELECT doc_id, length(to_base64(encode(text))) AS n_chars, md5(to_base64(encode(text))) AS md5 FROM documents""",
    "base64_roundtrip": """
SELECT page_id, md5(from_base64(to_base64(encode(html)))) AS md5,
       from_base64(to_base64(encode(html))) = encode(html) AS same FROM pages""",
    # pictures
    "decode_tensor": "WITH " + _PIXELS.rstrip().rstrip(",") + """
SELECT vec_id, 8 AS height, 8 AS width,
       md5(unhex(string_agg(repeat(lpad(hex(p), 2, '0'), 3), '' ORDER BY y, x))) AS md5 FROM px GROUP BY 1""",
    "resize_pool": "WITH " + _SMALL.rstrip().rstrip(",") + """
SELECT vec_id, 4 AS height, 4 AS width,
       md5(unhex(string_agg(repeat(lpad(hex(p), 2, '0'), 3), '' ORDER BY y, x))) AS md5 FROM small GROUP BY 1""",
    "picture_tensor": "WITH " + _TENSORS.rstrip().rstrip(",") + """
SELECT vec_id, CAST(dim AS INT) AS pos, round(v, 6) AS v FROM tensor""",
    "normalise_tensor": """
SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos,
       round((CAST(unnest(embedding) AS DOUBLE) - 0.5) / 0.5, 6) AS v FROM embeddings""",
    # models
    "model_by_alias": "WITH " + _FOLDS.rstrip().rstrip(",") + """
SELECT 'vector_checkpoints' AS name, 'prod' AS alias, CAST(version AS VARCHAR) AS version, class_id,
       CAST(dim AS INT) AS dim, round(w, 6) AS w FROM w WHERE version = 10""",
    "model_latest": "WITH " + _FOLDS.rstrip().rstrip(",") + """
SELECT 'vector_checkpoints' AS name, CAST(version AS INT) AS version, count(DISTINCT class_id) AS n_classes, count(*) AS n_values
FROM w WHERE version = (SELECT max(version) FROM w) GROUP BY 2""",
    "model_lineage": "WITH " + _TENSORS.rstrip().rstrip(",") + """
SELECT 'pictures_serving' AS name, '1' AS version, 'prod' AS alias, 'pictures@prod v1' AS source_model,
       count(DISTINCT class_id) AS n_classes, round(sum(w), 6) AS weight_sum FROM w""",
    "label_map": """
SELECT CAST(row_number() OVER (ORDER BY code) - 1 AS INT) AS class_id, code, label
FROM (SELECT DISTINCT 'n' || lpad(CAST(label AS VARCHAR), 4, '0') AS code, 'class_' || label AS label FROM embeddings)""",
    "weight_soup": "WITH " + _FOLDS.rstrip().rstrip(",") + """
SELECT class_id, CAST(dim AS INT) AS dim, round(avg(w), 6) AS w FROM w GROUP BY 1, 2""",
    # scoring
    "score_native": "WITH " + _VECTORS + _best() + "\nSELECT vec_id, pred, round(score, 6) AS score FROM best",
    "score_arrow": "WITH " + _VECTORS + _best() + "\nSELECT vec_id, pred, round(score, 6) AS score FROM best",
    "score_batches": "WITH " + _VECTORS + _best() + "\nSELECT vec_id, pred, round(score, 6) AS score FROM best",
    "score_blocks": "WITH " + _VECTORS + _best() + "\nSELECT vec_id, pred, round(score, 6) AS score FROM best",
    "softmax": """
WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
e AS (SELECT vec_id, pos, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM x)
SELECT vec_id, CAST(pos AS INT) AS pos, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS p FROM e""",
    "half_agreement": "WITH " + _VECTORS + _HALF + _best() + "," + _best("x", "wh", "bh", "low") + """
SELECT count(*) AS n, count(*) FILTER (WHERE best.pred = low.pred) AS n_agree, count(*) FILTER (WHERE best.pred <> low.pred) AS n_flips,
       round(count(*) FILTER (WHERE best.pred = low.pred) / CAST(count(*) AS DOUBLE), 6) AS agreement
FROM best JOIN low ON best.vec_id = low.vec_id""",
    "served_score": "WITH " + _VECTORS + _best() + "\nSELECT vec_id, 'class_' || pred AS label, round(score, 6) AS score FROM best",
    "classify_pictures": _PICTURES + "\nSELECT vec_id, pred, 'class_' || pred AS label, round(score, 6) AS score FROM best",
    "label_lookup": "WITH " + _VECTORS + _best() + """,
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1),
named AS (SELECT label, 'class_' || label AS text FROM sizes WHERE n >= (SELECT avg(n) FROM sizes))
SELECT vec_id, pred, coalesce(text, CAST(pred AS VARCHAR)) AS label FROM best LEFT JOIN named ON pred = named.label""",
    "logit_ensemble": "WITH " + _FOLDS + """
b AS (SELECT version, class_id, -0.5 * sum(w * w) AS b FROM w GROUP BY 1, 2),
soup AS (SELECT class_id, dim, avg(w) AS w FROM w GROUP BY 1, 2),
tilt AS (SELECT class_id, avg(b) AS b FROM b GROUP BY 1),
z AS (
  SELECT x.vec_id, w.version, w.class_id, sum(x.v * w.w) AS z FROM x JOIN w ON x.dim = w.dim GROUP BY 1, 2, 3)
SELECT z.vec_id, z.class_id, round(avg(z.z + b.b), 6) AS z
FROM z JOIN b ON z.version = b.version AND z.class_id = b.class_id GROUP BY 1, 2""",
    "predictions_table": "WITH " + _VECTORS + _best() + """
SELECT vec_id, 'class_' || pred AS label, round(score, 6) AS score, count(*) OVER () AS n_rows FROM best""",
    # artifacts
    "caption": f"SELECT doc_id, {_caption('lang', '(n_chars / CAST(n_chars + 2000 AS DOUBLE))')} AS caption FROM documents",
    "artifact_by_ordinal": f"""
SELECT 'file:' || path AS path, ordinal, '/out/annotated/' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(6, length(CAST(ordinal AS VARCHAR))) AS INT), '0') || '.jpg' AS output_path
FROM (SELECT path, row_number() OVER (ORDER BY path) - 1 AS ordinal FROM (SELECT {_DOCUMENT} AS path FROM documents))""",
    "artifact_by_basename": """
SELECT doc_id, '/out/annotated/' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.txt' AS output_path FROM documents""",
    "name_clashes": r"""
SELECT '/out/' || regexp_extract(regexp_replace(url, '/?([?#].*)?$', ''), '[^/]*$') AS output_path, count(*) AS n
FROM pages GROUP BY 1 HAVING count(*) > 1""",
    "written_artifacts": _PICTURES + f""",
named AS (SELECT {_FILE} AS path, {_caption("'class_' || pred", 'score')} AS caption
          FROM best JOIN embeddings e ON best.vec_id = e.vec_id)
SELECT path, caption, CAST(length(caption) + 206 AS BIGINT) AS length FROM named""",
    # runs
    "run_direct_ordinal": _PICTURES + f""",
named AS (SELECT {_FILE} AS path, 'class_' || pred AS label, round(score, 6) AS score
          FROM best JOIN embeddings e ON best.vec_id = e.vec_id)
SELECT path, label, score, lpad(CAST(row_number() OVER (ORDER BY path) - 1 AS VARCHAR), 6, '0') || '.ppm' AS artifact FROM named""",
    "run_direct": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'"),
    "run_ingest": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'"),
    "run_direct_first": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'") + " ORDER BY path LIMIT 100",
    "run_ingest_first": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'") + " ORDER BY path LIMIT 100",
    "score_class_gap": "WITH " + _VECTORS.replace("FROM x GROUP BY 1, 2)", "FROM x WHERE label <> 3 GROUP BY 1, 2)", 1) + _best()
    + "\nSELECT vec_id, pred AS arrow, pred AS native, pred AS batches, CAST(pred AS VARCHAR) AS label, round(score, 6) AS score FROM best",
    "run_staged": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'"),
    "run_served": _run("lpad(CAST(e.vec_id AS VARCHAR), 6, '0') || '.pgm'"),
    "join_payload": """
SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS label, length(d.text) AS n, md5(d.text) AS md5
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    # streams
    "ingest_stream": f"SELECT {_PAGE} AS path, strlen(html) AS length, md5(html) AS md5 FROM pages",
    "ingest_manifest": f"SELECT {_PAGE} AS path, strlen(html) AS length, md5(html) AS md5 FROM pages",
    "incremental_score": _PICTURES + f"""
SELECT {_FILE} AS path, 'class_' || pred AS label, round(score, 6) AS score
FROM best JOIN embeddings e ON best.vec_id = e.vec_id""",
    # run log and reports
    "run_log": """
SELECT run, key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,9))) AS DOUBLE) AS total FROM (
  SELECT user_id AS run, 'pattern' AS key, TRY_CAST(event_type AS DOUBLE) AS value FROM events
  UNION ALL SELECT user_id, 'seconds', value FROM events
  UNION ALL SELECT user_id, 'k', TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) FROM events)
WHERE value IS NOT NULL GROUP BY 1, 2""",
    "run_phases": """
SELECT pattern, phase, CAST(s AS DOUBLE) AS seconds, round(s / sum(s) OVER (PARTITION BY pattern), 6) AS share,
       (SELECT count(*) FROM embeddings) AS num_images, (SELECT count(*) FROM embeddings) AS num_written
FROM (VALUES ('p1', 'dataset_prep', 1), ('p1', 'inference_write', 1), ('p1', 'other', 3),
             ('p2', 'dataset_prep', 1), ('p2', 'inference_write', 1), ('p2', 'other', 3),
             ('p3', 'dataset_prep', 1), ('p3', 'inference_write', 1), ('p3', 'other', 3),
             ('p4', 'ingest', 1), ('p4', 'inference', 1), ('p4', 'other', 3), ('p5', 'stages', 1), ('p5', 'other', 2),
             ('p6', 'img_to_b64', 1), ('p6', 'model_call', 1), ('p6', 'annotate_write', 1), ('p6', 'other', 4)) v(pattern, phase, s)""",
    "run_name": "SELECT event_id, 'results_' || strftime(ts, '%Y-%m-%dT%H-%M-%S') AS name FROM events",
    "phase_breakdown": f"""
SELECT user_id, event_type, CAST(s AS DOUBLE) AS seconds,
       round(CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share
FROM (SELECT user_id, event_type, sum({_SECONDS}) AS s FROM events GROUP BY 1, 2)""",
    "phase_columns": "SELECT user_id, " + ", ".join(
        f"CAST(coalesce(sum({_SECONDS}) FILTER (WHERE event_type = '{p}'), 0) AS DOUBLE) AS {p}_s"
        for p in ("click", "error", "purchase")
    ) + f""", CAST(coalesce(sum({_SECONDS}) FILTER (WHERE event_type NOT IN ('click', 'error', 'purchase') OR event_type IS NULL), 0) AS DOUBLE) AS other_s,
       CAST(coalesce(sum({_SECONDS}), 0) AS DOUBLE) AS total_s FROM events GROUP BY 1""",
    "short_phases": """
SELECT user_id, event_type, CAST(s AS DOUBLE) AS seconds, round(CAST(s AS DOUBLE) / CAST(sum(s) OVER (PARTITION BY user_id) AS DOUBLE), 6) AS share
FROM (SELECT user_id, event_type, sum(CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) * 0.000001 AS DECIMAL(28,9))) AS s FROM events GROUP BY 1, 2)""",
    "throughput": f"""
SELECT user_id, count(*) AS n_rows, CAST(sum({_SECONDS}) AS DOUBLE) AS wall_s,
       round(count(*) / greatest(CAST(sum({_SECONDS}) AS DOUBLE), 1e-9), 2) AS rows_per_sec FROM events GROUP BY 1""",
    "run_ranking": f"""
SELECT user_id, CAST(wall AS DOUBLE) AS wall_s, rank() OVER (ORDER BY wall) AS rank,
       round(CAST(wall AS DOUBLE) / CAST(min(wall) OVER () AS DOUBLE), 6) AS ratio_to_best
FROM (SELECT user_id, sum({_SECONDS}) AS wall FROM events GROUP BY 1)""",
    "dataset_delta": f"""
SELECT event_type, round(s1 / n1, 6) AS mean_first_s, round(s2 / n2, 6) AS mean_second_s,
       round(((s2 / n2) / (s1 / n1) - 1) * 100, 3) AS change_pct FROM ({_HALVES})""",
    "scaling_report": f"""
SELECT event_type, n1 AS n_first, n2 AS n_second, round(n1 / s1, 6) AS rate_first, round(n2 / s2, 6) AS rate_second,
       round((n2 / s2) / (n1 / s1), 6) AS scaling FROM ({_HALVES})""",
    "cold_warm": f"""
SELECT user_id, n_runs, cold AS cold_s, round(warm, 6) AS warm_s, round(cold / nullif(warm, 0), 6) AS cold_to_warm,
       round(high / nullif(low, 0), 6) AS swing
FROM (
  SELECT user_id, count(*) AS n_runs, CAST(sum(s) FILTER (WHERE i = 1) AS DOUBLE) AS cold,
         CAST(sum(s) FILTER (WHERE i > 1) AS DOUBLE) / nullif(count(*) - 1, 0) AS warm,
         CAST(max(s) AS DOUBLE) AS high, CAST(min(s) AS DOUBLE) AS low
  FROM (SELECT user_id, {_SECONDS} AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
  GROUP BY 1)""",
    "best_by_scale": f"""
SELECT size, event_type AS best, round(m, 6) AS mean_s
FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY m, event_type) AS i
      FROM (SELECT strftime(ts, '%Y-%m-%d') AS size, event_type, CAST(sum({_SECONDS}) AS DOUBLE) / count(*) AS m
            FROM events GROUP BY 1, 2))
WHERE i = 1""",
    "billed_time": f"""
SELECT user_id, CAST(work AS DOUBLE) AS script_wall_s, CAST(start AS DOUBLE) AS startup_s, CAST(wait AS DOUBLE) AS queue_s,
       CAST(work + start + wait AS DOUBLE) AS elapsed_s, CAST(work + start AS DOUBLE) AS billed_s
FROM (
  SELECT user_id, coalesce(sum({_SECONDS}) FILTER (WHERE event_type NOT IN ('signup', 'error')), 0) AS work,
         coalesce(sum({_SECONDS}) FILTER (WHERE event_type = 'signup'), 0) AS start,
         coalesce(sum({_SECONDS}) FILTER (WHERE event_type = 'error'), 0) AS wait
  FROM events GROUP BY 1)""",
    "cost_report": """
SELECT l_returnflag, p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,6))) AS DOUBLE) AS units,
       round(CAST(sum(CAST(l_quantity AS DECIMAL(18,6)) * CAST(p_retailprice AS DECIMAL(14,6))) AS DOUBLE), 2) AS cost
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "scorer_agreement": "WITH " + _VECTORS + _ROUNDED + _best() + "," + _best("x", "wr", "br", "low") + """
SELECT count(*) AS n, count(*) FILTER (WHERE best.pred = low.pred) AS n_agree,
       count(*) FILTER (WHERE best.pred <> low.pred) AS n_flips,
       round(count(*) FILTER (WHERE best.pred = low.pred) / CAST(count(*) AS DOUBLE), 6) AS agreement,
       CAST(0 AS BIGINT) AS n_left_only, CAST(0 AS BIGINT) AS n_right_only
FROM best JOIN low ON best.vec_id = low.vec_id""",
    "partial_agreement": """
WITH a AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' END AS label FROM labels),
b AS (SELECT vec_id AS doc_id, CASE WHEN label < 5 THEN 'good' END AS label FROM embeddings),
f AS (SELECT a.doc_id AS l, b.doc_id AS r, a.label IS NOT DISTINCT FROM b.label AS same FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS n, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND same) AS n_agree,
       count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND NOT same) AS n_flips,
       round(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL AND same) / CAST(count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS DOUBLE), 6) AS agreement,
       count(*) FILTER (r IS NULL) AS n_left_only, count(*) FILTER (l IS NULL) AS n_right_only FROM f""",
    "failed_predictions": """
SELECT lang, count(*) AS n_inputs, count(l.doc_id) AS n_scored, count(*) - count(l.doc_id) AS n_missing
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id GROUP BY 1""",
    "completeness": """
SELECT lang, count(*) AS n_inputs, count(l.doc_id) AS n_scored, count(*) - count(l.doc_id) AS n_missing
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1""",
    "missing_inputs": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}

ORACLES: dict[str, str] = {name: _spell_rounding(sql) for name, sql in _QUERIES.items()}
