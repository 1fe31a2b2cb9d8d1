"""The same queries as SQL for DuckDB, written from the operators' definitions."""

from __future__ import annotations

SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NA = (
    "'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"
)


def _norm(name: str) -> str:
    return rf"regexp_replace(regexp_replace({name}, '(\.nii\.gz|\.nii)$', ''), '_[0-9]+$', '')"


def _strip(name: str) -> str:
    return rf"regexp_replace({name}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def _na(name: str, alias: str) -> str:
    return f"CASE WHEN {name} IN ({NA}) THEN NULL ELSE {name} END AS {alias}"


RECON = """recon AS (
  SELECT doc_id AS ord, concat('scan_', doc_id // 3, '_', doc_id % 3 + 1, '.nii.gz') AS VolumeName,
         text AS Findings, source AS Impressions, lang FROM documents)"""
TRUTH = f"""truth AS (
  SELECT VolumeName, quality, toxic FROM (
    SELECT {_norm("concat('doc_', doc_id, '_1.nii.gz')")} AS VolumeName, quality, toxic,
           row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) AS rn FROM labels) WHERE rn = 1)"""


def _run(name: str) -> str:
    quality, toxic = {
        "run1": ("n_chars >= 400", "doc_id % 7 = 0"),
        "run2": ("n_chars >= 600", "doc_id % 5 = 0"),
        "run3": ("n_chars % 3 <> 0", "n_chars % 11 = 0"),
    }[name]
    return f"""{name} AS (SELECT {_norm("concat('doc_', doc_id, '_2.nii')")} AS VolumeName,
  ({quality})::INT AS quality, ({toxic})::INT AS toxic FROM documents)"""


RUNS = ", ".join(_run(r) for r in ("run1", "run2", "run3"))


def _pair(run: str = "run1") -> str:
    return f"""{TRUTH}, {_run(run)}, pair AS (
  SELECT t.VolumeName, t.quality AS t_quality, t.toxic AS t_toxic, p.quality AS p_quality,
         p.toxic AS p_toxic FROM truth t JOIN {run} p USING (VolumeName))"""


def _long(source: str, labels: list[str]) -> str:
    parts = [
        f"SELECT VolumeName, {i} AS pos, '{x}' AS label, t_{x} AS t, p_{x} AS p FROM {source}"
        for i, x in enumerate(labels)
    ]
    return " UNION ALL ".join(parts)


CELLS = """count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp,
  count(*) FILTER (t = 1 AND p = 0) AS fn, count(*) FILTER (t = 0 AND p = 0) AS tn"""


def _scores(support: bool) -> str:
    def guard(value: str) -> str:
        if not support:
            return value
        return f"CASE WHEN tp + fn = 0 THEN CASE WHEN fp = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE {value} END"

    p = "CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0::DOUBLE END"
    r = "CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn)::DOUBLE ELSE 0.0::DOUBLE END"
    f = f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * (({p}) * ({r})) / (({p}) + ({r})) ELSE 0.0::DOUBLE END"
    a = "CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn)::DOUBLE / (tp + fp + fn + tn)::DOUBLE ELSE 0.0::DOUBLE END"
    return (
        f"round_even({guard(p)}, 4) AS precision, round_even({guard(r)}, 4) AS recall, "
        f"round_even({guard(f)}, 4) AS f1, round_even({a}, 4) AS accuracy"
    )


def _metrics(source: str, labels: list[str], micro: bool = True, prefix: str = "") -> str:
    """CTEs ending in ``<prefix>metrics``."""
    x = prefix
    micro_row = (
        f""" UNION ALL SELECT 'MICRO_AVERAGE', {_scores(False)}, tp, fp, fn, tn
    FROM (SELECT sum(tp)::BIGINT tp, sum(fp)::BIGINT fp, sum(fn)::BIGINT fn, sum(tn)::BIGINT tn FROM {x}cells)"""
        if micro
        else ""
    )
    return f"""{x}cells AS (SELECT pos, label, {CELLS} FROM ({_long(source, labels)}) GROUP BY pos, label),
  {x}scored AS (SELECT label, {_scores(True)}, tp, fp, fn, tn FROM {x}cells),
  {x}metrics AS (SELECT * FROM {x}scored UNION ALL
    SELECT 'MACRO_AVERAGE', round_even(avg(precision), 4), round_even(avg(recall), 4),
      round_even(avg(f1), 4), round_even(avg(accuracy), 4), sum(tp)::BIGINT, sum(fp)::BIGINT,
      sum(fn)::BIGINT, sum(tn)::BIGINT FROM {x}scored{micro_row})"""


L = ["quality", "toxic"]
METRIC_COLUMNS = ("precision", "recall", "f1", "accuracy", "tp", "fp", "fn", "tn")

DISCREPANCIES = f"""{_pair()}, wrong AS (
  SELECT VolumeName, label AS Label, p AS Predicted, t AS Actual
  FROM ({_long('pair', L)}) WHERE t <> p)"""
SUMMARY = f"""{DISCREPANCIES}, summary AS (
  SELECT Label, CASE WHEN Predicted = 1 AND Actual = 0 THEN 'false_positive'
                     WHEN Predicted = 0 AND Actual = 1 THEN 'false_negative' ELSE 'other' END AS error_type,
         count(*) AS count FROM wrong GROUP BY ALL)"""

ALIGNED = f"""{RUNS}, aligned AS (
  SELECT a.VolumeName, {", ".join(f"{t}.{x} AS {r}__{x}" for t, r in zip("abc", ("run1", "run2", "run3")) for x in L)}
  FROM run1 a JOIN run2 b USING (VolumeName) JOIN run3 c USING (VolumeName))"""


def _grouped(groups: str, cells: str, micro: bool = True) -> str:
    """Rows of metrics per group from a table of cells with ``groups`` and label."""
    sums = ", ".join(f"sum({c})::BIGINT AS {c}" for c in ("tp", "fp", "fn", "tn"))
    micro_row = f"UNION ALL SELECT {groups}, 'MICRO_AVERAGE', {_scores(False)}, tp, fp, fn, tn FROM (SELECT {groups}, {sums} FROM {cells} GROUP BY ALL)"
    return f"""scored AS (SELECT {groups}, label, {_scores(True)}, tp, fp, fn, tn FROM {cells})
  SELECT * FROM scored UNION ALL SELECT {groups}, 'MACRO_AVERAGE', round_even(avg(precision), 4), round_even(avg(recall), 4),
    round_even(avg(f1), 4), round_even(avg(accuracy), 4), sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT,
    sum(tn)::BIGINT FROM scored GROUP BY ALL {micro_row if micro else ''}"""


def _ballots(source: str, labels: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {i} AS pos, '{x}' AS label, run1__{x} AS v1, run2__{x} AS v2, run3__{x} AS v3 FROM {source}"
        for i, x in enumerate(labels)
    )


PAIRWISE_SCORES = """
  round_even(CASE WHEN n > 0 THEN (a + d) / n ELSE 0.0::DOUBLE END, 4) AS agreement,
  round_even(CASE WHEN n = 0 THEN 0.0::DOUBLE
    WHEN 1 - (((a + c) / n) * ((a + b) / n) + ((d + b) / n) * ((d + c) / n)) = 0
      THEN CASE WHEN (a + d) / n = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
    ELSE ((a + d) / n - (((a + c) / n) * ((a + b) / n) + ((d + b) / n) * ((d + c) / n)))
       / (1 - (((a + c) / n) * ((a + b) / n) + ((d + b) / n) * ((d + c) / n))) END, 4) AS cohen_kappa,
  round_even(CASE WHEN sqrt((a + b) * (a + c) * (d + b) * (d + c)) > 0
    THEN (a * d - b * c) / sqrt((a + b) * (a + c) * (d + b) * (d + c)) ELSE 0.0::DOUBLE END, 4) AS mcc,
  (tp + fp + fn + tn) AS n, tp, fp, fn, tn"""


def _pairwise(source: str, labels: list[str]) -> str:
    sides = " UNION ALL ".join(
        f"SELECT 'run{i} vs run{j}' AS pair, pos, label, v{i} AS t, v{j} AS p FROM ballots"
        for i, j in ((1, 2), (1, 3), (2, 3))
    )
    return f"""ballots AS ({_ballots(source, labels)}),
  paired AS (SELECT pair, pos, label, {CELLS} FROM ({sides}) GROUP BY ALL),
  doubled AS (SELECT *, tp::DOUBLE AS a, fp::DOUBLE AS b, fn::DOUBLE AS c, tn::DOUBLE AS d,
              (tp + fp + fn + tn)::DOUBLE AS n FROM paired),
  pairwise AS (SELECT pair, pos, label, {PAIRWISE_SCORES.replace('(tp + fp + fn + tn) AS n', 'tp + fp + fn + tn AS n')} FROM doubled)"""


ALL_SETS = f"""ballots AS ({_ballots('aligned', L)}),
  sets AS (SELECT label, round_even(count(*) FILTER (v1 = v2 AND v2 = v3)::DOUBLE / count(*)::DOUBLE, 4)
             AS all_sets_agreement,
           count(*) FILTER (v1 + v2 + v3 = 3) AS all_positive_consensus,
           count(*) FILTER (v1 + v2 + v3 = 0) AS all_negative_consensus, count(*) AS n
    FROM ballots GROUP BY label)"""


def _consensus(source: str, labels: list[str], needed: int) -> str:
    votes = ", ".join(
        f"(run1__{x} + run2__{x} + run3__{x} >= {needed})::INT AS {x}" for x in labels
    )
    return f"SELECT VolumeName, {votes} FROM {source}"


def _allocation(source: str, labels: list[str], n: int) -> str:
    names = ", ".join(labels)
    return f"""counted AS (SELECT {names}, count(*) AS count FROM {source} GROUP BY {names}),
  sized AS (SELECT *, sum(count) OVER () AS size, least({n}, sum(count) OVER ()) AS want FROM counted),
  shared AS (SELECT *, (want * count) // size AS fl, (want * count) % size AS re FROM sized),
  ranked AS (SELECT *, row_number() OVER (ORDER BY re DESC, count DESC, {names}) AS rk,
             want - sum(fl) OVER () AS rest FROM shared),
  allocated AS (SELECT {names}, count, (fl + (rk <= rest)::INT)::BIGINT AS quota FROM ranked)"""


def _sample(source: str, labels: list[str], n: int, key: str, seed: int, columns: str) -> str:
    names = ", ".join(labels)
    return f"""{_allocation(source, labels, n)},
  hashed AS (SELECT *, row_number() OVER (PARTITION BY {names}
             ORDER BY md5(concat({key}, ':{seed}')), {key}) AS draw FROM {source}),
  sampled AS (SELECT {columns} FROM hashed JOIN allocated USING ({names}) WHERE draw <= quota)"""


def _block(text: str) -> str:
    body = _strip(f"coalesce({text}, '')")
    broken = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
    return f"""concat(E'  - report: |\\n',
    CASE WHEN {body} = '' THEN '' ELSE concat('      ',
      regexp_replace({body}, '{broken}', E'\\n      ', 'g'), E'\\n') END,
    '    output: {{"quality": ', coalesce(quality, 0), ', "toxic": ', coalesce(toxic, 0), E'}}\\n')"""


def _row_text(columns: list[str]) -> str:
    return f"concat_ws(chr(31), {', '.join(f"coalesce({c}::VARCHAR, '<null>')" for c in columns)})"


def _draw(columns: list[str]) -> str:
    """Hash order of rows whose key may be missing or repeat."""
    return f"md5(concat(coalesce(key::VARCHAR, {_row_text(columns)}), ':42')), md5({_row_text(columns)})"


HALF_KEYED = """half AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id END AS key, doc_id, quality, toxic FROM labels)"""
HALF = ["key", "doc_id", "quality", "toxic"]
MANY = [f"l{i}" for i in range(2, 20)]


LABELLED = """labelled AS (SELECT d.doc_id, concat('doc_', d.doc_id) AS VolumeName, text, quality, toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

ASK = """E'\\n\"\"\"\\n\\nTarget findings:\\n{listing}\\nReturn a JSON object that only contains these findings as keys with 0/1 values.'"""


def _messages(listing: str, first: str, second: str) -> str:
    after = ASK.format(listing=listing)
    before = "E'Report:\\n\"\"\"\\n'"

    def asked(text: str) -> str:
        return f"concat({before}, {text}, {after})"

    rows = [
        ("system", "'Decide for each finding whether the report shows it.'"),
        ("user", asked("'A short note.'")),
        ("assistant", f"'{first}'"),
        ("user", asked("'All of the rest.'")),
        ("assistant", f"'{second}'"),
        ("user", asked("'Unclear.'")),
        ("assistant", "'no answer'"),
        ("user", asked("text")),
    ]
    return " UNION ALL ".join(
        f"SELECT concat('doc_', doc_id) AS VolumeName, {i} AS pos, '{role}' AS role, {content} AS content FROM documents"
        for i, (role, content) in enumerate(rows)
    )


# The stand-in model, as SQL over (VolumeName, report).
ASKED = "asked AS (SELECT concat('doc_', doc_id) AS VolumeName, text AS report, length(text) AS len FROM documents)"
ASKED_PARTLY = r"""asked AS (SELECT VolumeName, report, length(report) AS len FROM (
  SELECT concat('doc_', doc_id) AS VolumeName, CASE WHEN lang = 'fr' THEN NULL
    WHEN lang = 'de' THEN concat(chr(160), ' ', chr(9)) ELSE text END AS report FROM documents))"""
IS_BLANK = rf"(report IS NULL OR regexp_full_match(report, '{SPACE}*'))"
NANO = "{p}::DOUBLE / 1000000.0::DOUBLE * 0.05::DOUBLE + {c}::DOUBLE / 1000000.0::DOUBLE * 0.4::DOUBLE"


def _labelled(asked: str, single: bool = False, flaky: bool = False) -> str:
    """CTEs ending in ``rows`` with the stable columns of a label run."""
    k = 2 if single else 1
    down = "(len % 7 = 0)" if flaky else "false"
    again = "(len % 3 = 0)" if flaky else "false"
    request = "concat('req-', len, ' | req-', len)" if single else "concat('req-', len)"
    return f"""{asked},
  called AS (SELECT *, CASE WHEN {IS_BLANK} THEN 'skipped' WHEN {down} THEN 'down'
      WHEN len % 11 = 0 THEN 'broken' ELSE 'good' END AS kind FROM asked),
  rows AS (SELECT VolumeName,
    (kind = 'good' AND len >= 400)::INT AS "long text",
    (kind = 'good' AND contains(report, 'the '))::INT AS "mentions the",
    (CASE WHEN kind IN ('good', 'broken') THEN {k} * len ELSE 0 END)::BIGINT AS prompt_tokens,
    (CASE WHEN kind IN ('good', 'broken') THEN {k} * 10 ELSE 0 END)::BIGINT AS completion_tokens,
    (CASE WHEN kind IN ('good', 'broken') THEN {k} * (len + 10) ELSE 0 END)::BIGINT AS total_tokens,
    CASE WHEN kind IN ('good', 'broken')
      THEN round_even({NANO.format(p=f'({k} * len)', c=f'({k} * 10)')}, 8) ELSE 0.0::DOUBLE END AS estimated_cost_usd,
    CASE kind WHEN 'skipped' THEN '' WHEN 'down' THEN 'gpt-5-nano' ELSE 'keyword-1' END AS model_version,
    CASE WHEN kind IN ('good', 'broken') THEN {request} ELSE '' END AS request_id,
    (CASE WHEN kind = 'skipped' THEN 0 WHEN kind = 'down' THEN 3 WHEN {again} THEN 2 ELSE {k} END)::BIGINT AS retry_count,
    coalesce(sha256(report), '') AS report_hash,
    CASE kind WHEN 'skipped' THEN 'skipped' WHEN 'good' THEN 'success' ELSE 'error' END AS status,
    CASE kind WHEN 'broken' THEN 'Malformed JSON response' WHEN 'down' THEN 'service down' ELSE '' END AS error_message
    FROM called)"""


def _resume(strict: bool) -> str:
    usable = "status <> 'error'" if strict else "true"
    same = "AND n.hash = o.report_hash" if strict else ""
    return f"""incoming AS (SELECT doc_id AS ord, concat('doc_', doc_id) AS VolumeName, sha256(text) AS hash FROM documents),
  old AS (SELECT d.doc_id AS prior, concat(CASE WHEN quality = 1 THEN 'doc_' ELSE 'old_' END, d.doc_id) AS VolumeName,
    quality, toxic, n_chars AS prompt_tokens, sha256(text) AS report_hash,
    CASE WHEN toxic = 1 THEN 'error' ELSE 'success' END AS status
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  by_id AS (SELECT n.ord, o.prior, 'id' AS reuse FROM incoming n JOIN old o ON n.VolumeName = o.VolumeName
    WHERE {usable} {same}),
  new_left AS (SELECT * FROM incoming WHERE ord NOT IN (SELECT ord FROM by_id)),
  old_left AS (SELECT * FROM old WHERE prior NOT IN (SELECT prior FROM by_id) AND {usable}),
  asking AS (SELECT hash, min(ord) AS ord, count(*) AS asked FROM new_left GROUP BY hash),
  offered AS (SELECT report_hash AS hash, max(prior) AS prior, count(*) AS n FROM old_left GROUP BY 1),
  by_hash AS (SELECT ord, prior, 'hash' AS reuse FROM asking JOIN offered USING (hash) WHERE n = 1),
  matches AS (SELECT * FROM by_id UNION ALL SELECT * FROM by_hash)"""


RESUME_ROWS = """SELECT n.VolumeName, coalesce(m.reuse, 'none') AS reuse, o.quality, o.toxic,
  o.prompt_tokens, o.status FROM incoming n LEFT JOIN matches m ON n.ord = m.ord
  LEFT JOIN old o ON m.prior = o.prior"""

_LI = "cast(round(l_extendedprice * 100) AS BIGINT) * 100000000000 + l_partkey"


def _lines(name: str, returned: str, open_: str, dedupe: bool = True) -> str:
    rows = f"""SELECT concat('line_', l_orderkey, '_', l_linenumber) AS VolumeName,
      ({returned})::INT AS returned, ({open_})::INT AS open,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LI}) AS rn FROM lineitem"""
    return f"{name} AS (SELECT VolumeName, returned, open FROM ({rows}){' WHERE rn = 1' if dedupe else ''})"


LI = ["returned", "open"]
LI_TRUTH = ("l_returnflag = 'R'", "l_linestatus = 'O'")
LI_RUNS = {
    "run1": ("l_discount >= 0.05", "l_tax >= 0.04"),
    "run2": ("l_tax >= 0.04", "l_quantity >= 25"),
    "run3": ("l_quantity >= 25", "l_discount >= 0.05"),
}
LI_PAIR = f"""{_lines('truth', *LI_TRUTH)}, {_lines('run1', *LI_RUNS['run1'])}, pair AS (
  SELECT t.VolumeName, t.returned AS t_returned, t.open AS t_open, p.returned AS p_returned,
         p.open AS p_open FROM truth t JOIN run1 p USING (VolumeName))"""
LI_ALIGNED = f"""{", ".join(_lines(r, *rule) for r, rule in LI_RUNS.items())}, aligned AS (
  SELECT a.VolumeName, {", ".join(f"{t}.{x} AS {r}__{x}" for t, r in zip("abc", LI_RUNS) for x in LI)}
  FROM run1 a JOIN run2 b USING (VolumeName) JOIN run3 c USING (VolumeName))"""

MEAN_STD = f"""WITH {TRUTH}, {RUNS}, {", ".join(
    f'''pair{i} AS (SELECT t.VolumeName, t.quality AS t_quality, t.toxic AS t_toxic,
    p.quality AS p_quality, p.toxic AS p_toxic FROM truth t JOIN run{i} p USING (VolumeName)),
    {_metrics(f'pair{i}', L, prefix=f'm{i}_')}''' for i in (1, 2, 3))}
  SELECT label, {", ".join(f"round_even(avg({c}), 4) AS {c}_mean" for c in METRIC_COLUMNS)},
    {", ".join(f"round_even(stddev_pop({c}), 4) AS {c}_std" for c in METRIC_COLUMNS)}
  FROM (SELECT * FROM m1_metrics UNION ALL SELECT * FROM m2_metrics UNION ALL SELECT * FROM m3_metrics)
  GROUP BY label"""

JSON_TEXT = """concat('{"Long Text": ', CASE WHEN len >= 400 THEN 'true' ELSE 'false' END,
  ', "mentions the": ', CASE WHEN contains(report, 'the ') THEN '"present"' ELSE '"absent"' END, '}')"""

ORACLE = {
    "scan_reports": f"WITH {RECON} SELECT VolumeName, {_na('Findings', 'Findings')}, {_na('Impressions', 'Impressions')} FROM recon",
    "normalize_ids": rf"""WITH {RECON} SELECT VolumeName AS raw, {_norm('VolumeName')} AS VolumeName,
      regexp_replace(VolumeName, '(\.nii\.gz|\.nii)$', '') AS kept,
      regexp_replace(VolumeName, '^(.*)_[0-9]+\.nii\.gz$', '\1') AS scan FROM recon""",
    "dedupe_first": f"""WITH {RECON} SELECT VolumeName, lang, Impressions, _ord FROM (
      SELECT {_norm('VolumeName')} AS VolumeName, lang, Impressions, ord AS _ord,
        row_number() OVER (PARTITION BY {_norm('VolumeName')} ORDER BY ord) AS rn FROM recon) WHERE rn = 1""",
    "coerce_binary": r"""WITH noisy AS (SELECT event_id, value, props->>'k' AS stored, CASE event_id % 7
        WHEN 0 THEN concat(event_type, event_id) WHEN 1 THEN concat(' ', event_id, ' ') WHEN 2 THEN concat(event_id, '.9')
        WHEN 3 THEN 'True' WHEN 4 THEN concat(event_id, 'd') WHEN 5 THEN concat('-', event_id, 'e0') END AS noisy FROM events),
      parsed AS (SELECT *, CASE WHEN regexp_full_match(trim(stored), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
          THEN try_cast(trim(stored) AS DOUBLE) END AS s,
        CASE WHEN regexp_full_match(trim(noisy), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
          THEN try_cast(trim(noisy) AS DOUBLE) END AS n FROM noisy)
      SELECT event_id, coalesce(trunc(s), 0)::INT AS stored_int, coalesce(s, -1.0)::DOUBLE AS stored_number,
        coalesce(trunc(n), 0)::INT AS noisy_int, coalesce(n, -1.0)::DOUBLE AS noisy_number,
        coalesce(trunc(value), 0)::INT AS value_int FROM parsed""",
    "normalize_run_rows": """SELECT concat('event_', event_id) AS VolumeName, (props->>'k')::INT AS positive,
        (CASE WHEN event_type = 'view' THEN 0 ELSE event_id END)::BIGINT AS prompt_tokens,
        7::BIGINT AS completion_tokens,
        (CASE WHEN event_type = 'click' AND event_id <> 0 THEN event_id
          WHEN event_type = 'view' THEN 7 ELSE event_id + 7 END)::BIGINT AS total_tokens,
        CASE WHEN event_type = 'purchase' THEN 0.0::DOUBLE ELSE value END AS latency_seconds,
        round_even(event_id / 3e6, 8) AS estimated_cost_usd, '' AS model_version, '' AS request_id,
        0::BIGINT AS retry_count, '' AS started_at_utc, '' AS ended_at_utc, '' AS report_hash,
        CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error_message FROM events""",
    "compare_metrics": f"WITH {_pair()}, {_metrics('pair', L)} SELECT * FROM metrics",
    "confusion_counts": f"WITH {_pair()} SELECT label, {CELLS} FROM ({_long('pair', L)}) GROUP BY label",
    "compare_keeping_suffixes": f"""WITH {_lines('truth', *LI_TRUTH, dedupe=False)},
      {_lines('run1', *LI_RUNS['run1'], dedupe=False)}, pair AS (
      SELECT t.VolumeName, t.returned AS t_returned, t.open AS t_open, p.returned AS p_returned,
        p.open AS p_open FROM truth t JOIN run1 p USING (VolumeName)), {_metrics('pair', LI)}
      SELECT * FROM metrics""",
    "compare_run_summary": f"""WITH {_pair()}, counted AS (SELECT count(*) AS m,
        sum((t_quality = p_quality)::INT + (t_toxic = p_toxic)::INT)::BIGINT AS c,
        count(*) FILTER (t_quality = p_quality AND t_toxic = p_toxic) AS e FROM pair)
      SELECT m AS total_reports, m AS matched_reports,
        (SELECT count(*) FROM truth WHERE VolumeName NOT IN (SELECT VolumeName FROM run1)) AS left_only,
        (SELECT count(*) FROM run1 WHERE VolumeName NOT IN (SELECT VolumeName FROM truth)) AS right_only,
        'quality,toxic' AS labels_compared, m * 2 AS total_labels, c AS total_correct_labels,
        round_even(c::DOUBLE / (m * 2)::DOUBLE, 4) AS label_accuracy, e AS exact_match_count,
        round_even(e::DOUBLE / m::DOUBLE, 4) AS exact_match_rate FROM counted""",
    "unmatched_ids": f"""WITH {_pair()}
      SELECT VolumeName, 'left_only' AS side FROM truth WHERE VolumeName NOT IN (SELECT VolumeName FROM run1)
      UNION ALL SELECT VolumeName, 'right_only' FROM run1 WHERE VolumeName NOT IN (SELECT VolumeName FROM truth)""",
    "discrepancies": f"WITH {DISCREPANCIES} SELECT * FROM wrong",
    "discrepancies_with_report": f"""WITH {DISCREPANCIES} SELECT w.*, d.text AS "Report" FROM wrong w
      JOIN documents d ON w.VolumeName = concat('doc_', d.doc_id)""",
    "discrepancy_summary": f"WITH {SUMMARY} SELECT * FROM summary ORDER BY count DESC, Label, error_type",
    "discrepancy_totals": f"WITH {SUMMARY} SELECT Label, sum(count)::BIGINT AS total_errors FROM summary GROUP BY Label",
    "top_discrepancies": f"WITH {SUMMARY} SELECT * FROM summary ORDER BY count DESC, Label, error_type LIMIT 3",
    "metrics_mean_std": MEAN_STD,
    "metrics_files_mean_std": MEAN_STD,
    "compare_by_language_and_source": f"""WITH {_pair()}, told AS (SELECT pair.*, lang, source FROM pair
        JOIN documents ON VolumeName = concat('doc_', doc_id)),
      long AS ({" UNION ALL ".join(f"SELECT '{x}' AS label, t_{x} AS t, p_{x} AS p, lang, source FROM told" for x in L)}),
      cells AS (SELECT grouping(lang, source)::INT AS level, lang, source, label, {CELLS} FROM long GROUP BY label, CUBE (lang, source)),
      {_grouped('level, lang, source', 'cells')}""",
    "compare_many_runs": f"""WITH {RUNS}, truth AS (SELECT concat('doc_', doc_id) AS VolumeName, quality, toxic FROM labels),
      stacked AS (SELECT 'run1' AS run, * FROM run1 UNION ALL SELECT 'run2', * FROM run2
          WHERE regexp_extract(VolumeName, '[0-9]+')::BIGINT % 3 > 0 UNION ALL SELECT 'run3', * FROM run3),
      met AS (SELECT run, a.quality AS t_quality, a.toxic AS t_toxic, b.quality AS p_quality, b.toxic AS p_toxic
        FROM truth a JOIN stacked b USING (VolumeName)),
      long AS ({" UNION ALL ".join(f"SELECT run, '{x}' AS label, t_{x} AS t, p_{x} AS p FROM met" for x in L)}),
      cells AS (SELECT run, label, {CELLS} FROM long GROUP BY ALL),
      {_grouped('run', 'cells')}""",
    "align_runs": f"WITH {ALIGNED} SELECT * FROM aligned",
    "pairwise_agreement": f"WITH {ALIGNED}, {_pairwise('aligned', L)} SELECT * EXCLUDE (pos) FROM pairwise",
    "pairwise_agreement_summary": f"""WITH {ALIGNED}, {_pairwise('aligned', L)}
      SELECT pair, 'MACRO_AVERAGE' AS label, round_even(avg(agreement), 4) AS agreement,
        round_even(avg(cohen_kappa), 4) AS cohen_kappa, round_even(avg(mcc), 4) AS mcc,
        arg_min(n, pos) AS n, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn,
        sum(tn)::BIGINT AS tn FROM pairwise GROUP BY pair""",
    "all_sets_agreement": f"WITH {ALIGNED}, {ALL_SETS} SELECT * FROM sets",
    "agreement_run_summary": f"""WITH {ALIGNED}, {ALL_SETS} SELECT 3 AS num_sets, 'run1,run2,run3' AS set_names,
      max(n) AS total_reports_matched, 'quality,toxic' AS labels_compared, 3 AS num_pairs,
      round_even(avg(all_sets_agreement), 4) AS overall_all_sets_agreement FROM sets""",
    "consensus_any_positive": f"WITH {ALIGNED} {_consensus('aligned', L, 1)}",
    "consensus_majority": f"WITH {ALIGNED} {_consensus('aligned', L, 2)}",
    "consensus_unanimity": f"WITH {ALIGNED} {_consensus('aligned', L, 3)}",
    "consensus_run_summary": f"""WITH {ALIGNED}, {", ".join(
        f"c{k} AS ({_consensus('aligned', L, k)})" for k in (1, 2, 3))} {" UNION ALL ".join(
        f"SELECT '{name}' AS strategy, {k} AS threshold, count(*) AS num_rows, "
        f"sum(quality + toxic)::BIGINT AS num_positive_labels, 3 AS num_sets FROM c{k}"
        for k, name in ((1, 'any_positive'), (2, 'majority'), (3, 'unanimity')))}""",
    "unique_scans": rf"""WITH {RECON}, texts AS (SELECT
        regexp_replace(VolumeName, '^(.*)_[0-9]+\.nii\.gz$', '\1') AS VolumeName, ord, lang,
        concat_ws(E'\n\n', nullif({_strip("coalesce(Findings, '')")}, ''),
          nullif({_strip("coalesce(Impressions, '')")}, '')) AS report_text FROM recon),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY VolumeName ORDER BY length(report_text) DESC, ord) AS rn FROM texts)
      SELECT VolumeName, report_text, lang FROM ranked WHERE rn = 1""",
    "stratified_allocation": f"WITH {_allocation('labels', L, 100)} SELECT * FROM allocated",
    "stratified_sample": f"WITH {_sample('labels', L, 100, 'doc_id', 42, 'doc_id, quality, toxic')} SELECT * FROM sampled",
    "stratified_sample_lines": f"""WITH flagged AS (SELECT o_orderkey, (o_orderstatus = 'P')::INT AS pending,
        (o_totalprice >= 400000)::INT AS big FROM orders),
      {_sample('flagged', ['pending', 'big'], 500, 'o_orderkey', 7, 'o_orderkey, pending, big')} SELECT * FROM sampled""",
    "label_prevalence": f"""WITH {_sample('labels', L, 100, 'doc_id', 42, 'quality, toxic')} {" UNION ALL ".join(
        f"SELECT '{x}' AS label, (SELECT sum({x})::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE FROM labels) AS input_percent, "
        f"(SELECT sum({x})::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE FROM sampled) AS sample_percent" for x in L)}""",
    "sample_rows": "SELECT * FROM labels ORDER BY md5(concat(doc_id, ':42')), doc_id LIMIT 50",
    "format_examples": f"""WITH {LABELLED}, few AS (SELECT *,
        (row_number() OVER (ORDER BY md5(concat(VolumeName, ':42')), VolumeName) - 1)::INT AS rank FROM labelled)
      SELECT rank, VolumeName, {_block('text')} AS block FROM few WHERE rank < 3""",
    "format_examples_at": f"""WITH {LABELLED}, wanted AS (SELECT * FROM (VALUES (0, 42), (1, 7), (2, 1000000000000), (3, 7)) v(rank, doc_id))
      SELECT rank::INT AS rank, VolumeName, {_block('text')} AS block FROM wanted JOIN labelled USING (doc_id)""",
    "report_hash": f"WITH {ASKED} SELECT VolumeName, coalesce(sha256(report), '') AS report_hash FROM asked",
    "prompt_messages": _messages(
        "- long text\\n- mentions the",
        '{"long text": 0, "mentions the": 0}',
        '{"mentions the": 1, "long text": 0}',
    ),
    "prompt_messages_one_label": _messages(
        "- mentions the", '{"mentions the": 0}', '{"mentions the": 1}'
    ),
    "parse_responses": """SELECT event_id, CASE event_type WHEN 'error' THEN 'Malformed JSON response'
        WHEN 'purchase' THEN '''list'' object has no attribute ''items''' ELSE '' END AS error_message,
      CASE WHEN event_type IN ('error', 'purchase') THEN 'error' ELSE 'success' END AS status,
      (CASE WHEN event_type IN ('view', 'click') THEN (props->>'k')::INT <> 0
        WHEN event_type = 'signup' THEN value >= 20 ELSE false END)::INT AS k FROM events""",
    "normalize_binary": """SELECT event_id, ((props->>'k')::INT <> 0)::INT AS stored_k, (CASE event_id % 7 WHEN 0 THEN false
        WHEN 1 THEN false WHEN 2 THEN event_id % 3 = 1 WHEN 3 THEN event_type = 'view' WHEN 4 THEN true
        WHEN 5 THEN false ELSE event_id % 5 <> 2 END)::INT AS other_k FROM events""",
    "label_in_force": """WITH states AS (SELECT user_id, ts, max((value, event_id)) AS held FROM events
        WHERE event_type = 'purchase' GROUP BY ALL)
      SELECT c.event_id, c.user_id, c.event_type, s.held[1] AS in_force, s.held[2] AS state_id
      FROM (SELECT * FROM events WHERE event_type <> 'purchase') c ASOF LEFT JOIN states s
        ON c.user_id = s.user_id AND c.ts >= s.ts""",
    "align_runs_stored": f"WITH {ALIGNED} SELECT * FROM aligned",
    "sketched_overlap": """WITH a AS (SELECT DISTINCT doc_id FROM labels), b AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 > 0)
      SELECT (SELECT count(*) FROM a SEMI JOIN b USING (doc_id)) AS matched, (SELECT count(*) FROM a ANTI JOIN b USING (doc_id)) AS left_only,
        (SELECT count(*) FROM b ANTI JOIN a USING (doc_id)) AS right_only,
        (SELECT count(*) FROM (SELECT doc_id FROM a UNION SELECT doc_id FROM b)) AS ids, 0.0::DOUBLE AS error""",
    "sketched_quantiles": """SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS q50, quantile_disc(value, 0.9) AS q90,
        quantile_disc(value, 0.99) AS q99 FROM events GROUP BY event_type""",
    "written_results": f"""WITH {DISCREPANCIES}, {_metrics('pair', L)}, counted AS (SELECT Label AS name, count(*) AS wrong FROM wrong GROUP BY ALL)
      SELECT label, tp, fp, fn, tn, wrong, (SELECT sum(tp)::BIGINT FROM metrics) AS tp_sum
      FROM metrics LEFT JOIN counted ON label = name""",
    "metrics_listed_twice": MEAN_STD,
    "shared_columns": f"""WITH {_pair()}, {_metrics('pair', L)}
      SELECT * REPLACE (CASE label WHEN 'quality' THEN 'Quality' ELSE label END AS label) FROM metrics""",
    "price_table": """WITH lines AS (SELECT l_orderkey, l_linenumber, l_shipdate AS called, l_suppkey AS completion_tokens,
        concat('Vendor/MODEL-', l_partkey, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE '-turbo' END) AS model,
        l_quantity::BIGINT * 1000 AS prompt_tokens FROM lineitem),
      prices AS (SELECT concat('model-', p_partkey) AS key, (p_partkey % 100) / 8.0::DOUBLE AS i, (p_partkey % 100) / 8.0::DOUBLE * 4 AS o,
          TIMESTAMP '1900-01-01' AS f, TIMESTAMP '1995-06-17' AS u FROM part
        UNION ALL SELECT concat('model-', p_partkey), (p_partkey % 100) / 8.0::DOUBLE / 2, (p_partkey % 100) / 8.0::DOUBLE,
          TIMESTAMP '1995-06-17', TIMESTAMP '9999-01-01' FROM part WHERE p_partkey % 5 > 0),
      names AS (SELECT DISTINCT model FROM lines),
      matched AS (SELECT model, prices.* FROM names JOIN prices ON contains(lower(model), key)),
      best AS (SELECT l_orderkey, l_linenumber, l.model, prompt_tokens, completion_tokens, called,
          arg_max(i, length(key)) AS i, arg_max(o, length(key)) AS o, l.rn
        FROM (SELECT *, row_number() OVER () AS rn FROM lines) l LEFT JOIN matched m ON l.model = m.model AND called >= f AND called < u
        GROUP BY l_orderkey, l_linenumber, l.model, prompt_tokens, completion_tokens, called, l.rn)
      SELECT l_orderkey, l_linenumber, model, prompt_tokens, completion_tokens, coalesce(round_even(
        prompt_tokens::DOUBLE / 1000000.0::DOUBLE * i + completion_tokens::DOUBLE / 1000000.0::DOUBLE * o, 8), 0.0::DOUBLE)
        AS estimated_cost_usd FROM best""",
    "pairwise_agreement_many": f"""WITH runs AS (SELECT unnest(range(64)) AS i),
      ballots AS (SELECT i, 'quality' AS label, doc_id, ((doc_id * (i + 3) + n_chars) % 7 < 2 + i % 4)::INT AS v FROM documents, runs
        UNION ALL SELECT i, 'toxic', doc_id, ((n_chars + i) % (2 + i % 9) = 0)::INT FROM documents, runs),
      paired AS (SELECT concat('m', a.i, ' vs m', b.i) AS pair, a.label AS label, {CELLS.replace("t = ", "a.v = ").replace("p = ", "b.v = ")}
        FROM ballots a JOIN ballots b ON a.doc_id = b.doc_id AND a.label = b.label AND a.i < b.i GROUP BY ALL),
      doubled AS (SELECT *, tp::DOUBLE AS a, fp::DOUBLE AS b, fn::DOUBLE AS c, tn::DOUBLE AS d,
        (tp + fp + fn + tn)::DOUBLE AS n FROM paired)
      SELECT pair, label, {PAIRWISE_SCORES.replace('(tp + fp + fn + tn) AS n', 'tp + fp + fn + tn AS n')} FROM doubled""",
    "all_sets_agreement_many": """WITH runs AS (SELECT unnest(range(64)) AS i),
      sums AS (SELECT doc_id, 'quality' AS label, sum((n_chars % 5 = 0 OR doc_id % (50 + i) = 0)::INT) AS v FROM documents, runs GROUP BY ALL
        UNION ALL SELECT doc_id, 'toxic', sum((n_chars % 3 > 0 AND n_chars % (60 + i) > 0)::INT) FROM documents, runs GROUP BY ALL)
      SELECT label, round_even(count(*) FILTER (v IN (0, 64))::DOUBLE / count(*)::DOUBLE, 4) AS all_sets_agreement,
        count(*) FILTER (v = 64) AS all_positive_consensus, count(*) FILTER (v = 0) AS all_negative_consensus, count(*) AS n
      FROM sums GROUP BY label""",
    "estimate_cost": """WITH usage AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'gpt-5-nano-2025'
        WHEN 'fr' THEN 'GPT-5-mini' WHEN 'de' THEN 'gpt-4.1' ELSE 'unknown' END AS model,
        n_chars // 4 AS prompt_tokens, 12 + doc_id % 5 AS completion_tokens FROM documents),
      pricing(key, i, o) AS (VALUES ('gpt-5-pro', 15.0::DOUBLE, 120.0::DOUBLE), ('gpt-5', 1.25, 10.0), ('gpt-5-mini', 0.25, 2.0),
        ('gpt-5-nano', 0.05, 0.4), ('gpt-4.1', 3.0, 12.0), ('gpt-4.1-mini', 0.8, 3.2), ('gpt-4.1-nano', 0.2, 0.8)),
      best AS (SELECT model, arg_max(i, length(key)) AS i, arg_max(o, length(key)) AS o
        FROM (SELECT DISTINCT model FROM usage) JOIN pricing ON contains(lower(model), key) GROUP BY model)
      SELECT doc_id, model, prompt_tokens, completion_tokens, coalesce(round_even(
        prompt_tokens::DOUBLE / 1000000.0::DOUBLE * i + completion_tokens::DOUBLE / 1000000.0::DOUBLE * o, 8), 0.0::DOUBLE)
        AS estimated_cost_usd FROM usage LEFT JOIN best USING (model)""",
    "combine_meta": """WITH calls AS (SELECT l_orderkey AS report,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos,
        l_partkey AS p, l_suppkey AS c, l_quantity AS lat, l_linenumber AS tries,
        CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'skipped' ELSE 'success' END AS status,
        CASE WHEN l_returnflag = 'R' THEN concat('failed at ', l_suppkey) END AS err,
        CASE WHEN l_linestatus = 'O' THEN concat('req-', l_partkey) END AS req,
        concat('model-', l_linestatus) AS model,
        CASE WHEN l_returnflag <> 'A' THEN strftime(l_shipdate, '%Y-%m-%d') END AS day FROM lineitem),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY report, err ORDER BY pos) AS e_rn,
        row_number() OVER (PARTITION BY report, model ORDER BY pos) AS m_rn FROM calls)
      SELECT report, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens,
        sum(p + c)::BIGINT AS total_tokens, sum(lat) AS latency_seconds, sum(tries)::BIGINT AS retry_count,
        CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_and(status = 'skipped') THEN 'skipped'
          ELSE 'success' END AS status,
        coalesce(string_agg(err, ' | ' ORDER BY pos) FILTER (e_rn = 1), '') AS error_message,
        coalesce(string_agg(req, ' | ' ORDER BY pos), '') AS request_id,
        coalesce(string_agg(model, ' | ' ORDER BY pos) FILTER (m_rn = 1), '') AS model_version,
        coalesce(min(day), '') AS started_at_utc, coalesce(max(day), '') AS ended_at_utc
      FROM firsts GROUP BY report""",
    "label_reports_multi": f"WITH {_labelled(ASKED)} SELECT * FROM rows",
    "label_reports_single": f"WITH {_labelled(ASKED, single=True)} SELECT * FROM rows",
    "label_reports_retry": f"WITH {_labelled(ASKED, flaky=True)} SELECT * FROM rows",
    "skip_empty_reports": f"WITH {_labelled(ASKED_PARTLY)} SELECT * FROM rows",
    "skip_empty_reports_single": f"WITH {_labelled(ASKED_PARTLY, single=True)} SELECT * FROM rows",
    "blank_reports": f"WITH {ASKED_PARTLY} SELECT VolumeName, ({IS_BLANK})::INT AS blank FROM asked",
    "run_totals": f"""WITH {_labelled(ASKED)} SELECT count(*) AS total_reports, 0::BIGINT AS resumed_reports,
        sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
        round_even(sum(estimated_cost_usd), 8) AS total_cost_usd,
        avg(retry_count) FILTER (status <> 'skipped') AS average_attempts,
        count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error,
        count(*) FILTER (status = 'skipped') AS skipped, 0::BIGINT AS other FROM rows""",
    "eval_run_summary": f"""WITH {_pair()}, {_metrics('pair', L, micro=False)}, rows AS (
        SELECT CASE WHEN lang IN ('en', 'fr', 'de') THEN 'success' ELSE 'skipped' END AS status,
          (12 + doc_id % 5)::DOUBLE AS lat, (n_chars // 4) / 1024.0::DOUBLE AS cost FROM documents)
      SELECT round_even(sum(cost), 6) AS total_estimated_cost_usd, round_even(avg(lat), 4) AS average_latency_seconds,
        count(*) AS total_reports, count(*) FILTER (status = 'success') AS labeled_reports,
        count(*) FILTER (status = 'skipped') AS skipped_reports, 0::BIGINT AS error_reports,
        round_even(count(*) FILTER (status = 'success')::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE, 2) AS coverage_percent,
        'gpt-5-nano' AS model_version, any_value(f1) AS macro_f1, any_value(precision) AS macro_precision,
        any_value(recall) AS macro_recall
      FROM rows, (SELECT f1, precision, recall FROM metrics WHERE label = 'MACRO_AVERAGE')""",
    "evaluation_metrics": f"""WITH {_labelled(ASKED)}, pair AS (SELECT r.VolumeName, l.quality AS "t_long text",
        l.toxic AS "t_mentions the", r."long text" AS "p_long text", r."mentions the" AS "p_mentions the"
        FROM rows r JOIN labels l ON r.VolumeName = concat('doc_', l.doc_id)),
      renamed AS (SELECT VolumeName, "t_long text" AS t_a, "p_long text" AS p_a, "t_mentions the" AS t_b,
        "p_mentions the" AS p_b FROM pair), {_metrics('renamed', ['a', 'b'], micro=False)}
      SELECT * REPLACE (CASE label WHEN 'a' THEN 'long text' WHEN 'b' THEN 'mentions the' ELSE label END AS label)
      FROM metrics""",
    "call_log": f"""WITH {_labelled(ASKED)}, texts AS (SELECT r.*, {JSON_TEXT} AS body, len FROM rows r
        JOIN asked a USING (VolumeName) WHERE status <> 'skipped')
      SELECT VolumeName, 'request' AS event, 'gpt-5-nano' AS model, 'long text,mentions the' AS labels, report_hash,
        8 AS messages_count, NULL::VARCHAR AS request_id, NULL::VARCHAR AS model_version, NULL::INT AS content_length,
        NULL::VARCHAR AS finish_reason, NULL::INT AS tool_calls_present, NULL::VARCHAR AS status,
        NULL::VARCHAR AS error_message, NULL::BIGINT AS prompt_tokens, NULL::BIGINT AS completion_tokens,
        NULL::BIGINT AS total_tokens FROM texts
      UNION ALL SELECT VolumeName, 'response', NULL, NULL, NULL, NULL, request_id, model_version,
        (CASE WHEN status = 'success' THEN length(body) + CASE WHEN len % 5 = 0 THEN 12 ELSE 0 END ELSE 0 END)::INT,
        'stop', 0, status, error_message, prompt_tokens, completion_tokens, total_tokens FROM texts""",
    "resume_match": f"WITH {_resume(False)} {RESUME_ROWS}",
    "resume_match_strict": f"WITH {_resume(True)} {RESUME_ROWS}",
    "resume_stats": f"""WITH {_resume(False)} SELECT (SELECT count(*) FROM incoming) AS input_rows,
        (SELECT count(*) FROM by_id) AS matched_by_id, (SELECT count(*) FROM by_hash) AS matched_by_hash,
        (SELECT coalesce(sum(asked), 0)::BIGINT FROM asking JOIN offered USING (hash) WHERE n > 1) AS hash_collisions,
        (SELECT count(DISTINCT VolumeName) FROM old WHERE VolumeName NOT IN
          (SELECT VolumeName FROM old JOIN matches USING (prior))) AS unmatched_ids,
        (SELECT count(*) FROM old WHERE prior NOT IN (SELECT prior FROM matches)) AS unmatched_hash_rows,
        (SELECT count(*) FROM incoming WHERE ord NOT IN (SELECT ord FROM matches)) AS to_label""",
    "resume_batch": f"""WITH {_resume(False)}, {_labelled(ASKED)}
      SELECT n.VolumeName, coalesce(m.reuse, 'none') AS reuse,
        CASE WHEN m.reuse IS NULL THEN r."long text" ELSE o.quality END AS "long text",
        CASE WHEN m.reuse IS NULL THEN r."mentions the" ELSE o.toxic END AS "mentions the",
        n.hash AS report_hash, CASE WHEN m.reuse IS NULL THEN r.status ELSE o.status END AS status
      FROM incoming n JOIN rows r USING (VolumeName) LEFT JOIN matches m ON n.ord = m.ord
      LEFT JOIN old o ON m.prior = o.prior""",
    "incremental_label": f"""WITH {_labelled(ASKED)}
      SELECT VolumeName, "long text", "mentions the", report_hash, status FROM rows""",
    "incremental_label_state": f"""WITH {_labelled(ASKED)}, arrived AS (
        SELECT r.*, d.doc_id, (l.doc_id IS NULL)::BIGINT AS batch FROM rows r
        JOIN documents d ON r.VolumeName = concat('doc_', d.doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id)
      SELECT VolumeName, "long text", "mentions the", report_hash, status, batch AS batch_id,
        CASE WHEN row_number() OVER (PARTITION BY report_hash ORDER BY batch, doc_id) = 1 THEN 'none' ELSE 'hash' END AS reuse
      FROM arrived""",
    "bench_compare_li": f"WITH {LI_PAIR}, {_metrics('pair', LI)} SELECT * FROM metrics",
    "bench_agreement_li": f"WITH {LI_ALIGNED}, {_pairwise('aligned', LI)} SELECT * EXCLUDE (pos) FROM pairwise",
    "bench_consensus_li": f"WITH {LI_ALIGNED} {_consensus('aligned', LI, 2)}",
}
ORACLE |= {
    "stratified_sample_null_keys": f"""WITH {HALF_KEYED}, {_allocation('half', L, 100)},
      drawn AS (SELECT *, row_number() OVER (PARTITION BY quality, toxic ORDER BY {_draw(HALF)}) AS draw FROM half)
      SELECT key, doc_id, quality, toxic FROM drawn JOIN allocated USING (quality, toxic) WHERE draw <= quota""",
    "sample_rows_large": f"""WITH rows AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_partkey END AS key,
        l_orderkey, l_linenumber, l_suppkey FROM lineitem)
      SELECT * FROM rows ORDER BY {_draw(["key", "l_orderkey", "l_linenumber", "l_suppkey"])} LIMIT 20000""",
    "top_up": f"""WITH {HALF_KEYED}, held AS (SELECT * FROM half WHERE doc_id % 10 < 2),
      more AS (SELECT *, row_number() OVER (ORDER BY {_draw(HALF)}) AS draw FROM half WHERE doc_id % 10 >= 2)
      SELECT * FROM held UNION ALL SELECT * EXCLUDE (draw) FROM more WHERE draw <= 150 - (SELECT count(*) FROM held)""",
    "compare_many_labels": f"""WITH pair AS (SELECT doc_id AS VolumeName, {", ".join(
        f"(n_chars % {i} = 0)::INT AS t_l{i}, (doc_id % {i} = 0)::INT AS p_l{i}" for i in range(2, 20))} FROM documents),
      {_metrics('pair', MANY)} SELECT * FROM metrics""",
    "compare_workflow": ORACLE["compare_metrics"],
    "compare_workflow_discrepancies": ORACLE["discrepancies"],
    "agree_workflow": ORACLE["pairwise_agreement"],
    "ensemble_workflow": ORACLE["consensus_majority"],
    "evaluate_unordered": ORACLE["evaluation_metrics"],
    "generate_labels_unordered": "SELECT concat('doc_', doc_id) AS VolumeName, sha256(text) AS report_hash FROM documents",
    "generate_labels_sliced": ORACLE["label_reports_multi"],
    "generate_labels_restarted": ORACLE["label_reports_multi"],
    "write_labels": f"WITH {_run('run1')} SELECT concat(VolumeName, '_2.nii') AS VolumeName, quality, toxic FROM run1",
    "dedupe_over_files": """WITH rows AS (SELECT concat('scan_', doc_id % 97) AS VolumeName, doc_id, n_chars,
        CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS part FROM documents)
      SELECT VolumeName, doc_id, n_chars FROM (SELECT *, row_number() OVER (
        PARTITION BY VolumeName ORDER BY part, doc_id) AS rn FROM rows) WHERE rn = 1""",
}
