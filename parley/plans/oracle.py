"""DuckDB SQL that states, independently of the Spark code, what each
registered query must return. Built from small fragments so the shared parts
(languages, tokens, demo weights, sampling order) are written once.

DuckDB notes: lambdas are ``lambda x: ...``; decimal literals are cast to
DOUBLE so arithmetic matches Spark's doubles; RE2 has no look-around, so
whole-word matching uses ``\\b`` (same result on the ASCII glossary terms).
"""

from __future__ import annotations

import unicodedata

from parley.functions import fixed_values as fv
from parley.operators.features import MAX_FEATURES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BLANK = q(fv.BLANK_PATTERN)
WS_TOKEN = q(fv.WS_TOKEN_PATTERN)


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(fv.TOKEN_PATTERN)})"


def with_bigrams(u: str) -> str:
    return f"list_concat({u}, list_transform(range(1, len({u})), lambda i: {u}[i] || ' ' || {u}[i + 1]))"


def nonblank(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT regexp_matches({x}, {BLANK}))"


def py_strip(x: str) -> str:
    ws = fv.PY_WHITESPACE_CLASS
    return f"regexp_replace({x}, {q(f'^{ws}+|{ws}+$')}, '', 'g')"


def ws_count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {WS_TOKEN}))"


def langs_cte() -> str:
    rows = [f"({i}, {q(n)}, {q(c)}, {q(s)}, 'low')" for i, (n, c, s) in enumerate(fv.LOW_RESOURCE_LANGS)]
    n, c, s = fv.HIGH_RESOURCE
    rows.append(f"(NULL, {q(n)}, {q(c)}, {q(s)}, 'high')")
    return ("langs AS (SELECT * FROM (VALUES " + ", ".join(rows)
            + ") t(idx, lang_name, lang_code, script, resource))")


def weights_cte() -> str:
    rows = ", ".join(f"({q(t)}, {i!r}, {c!r})" for t, i, c in fv.DEMO_WEIGHTS)
    return ("w AS (SELECT term, CAST(idf AS DOUBLE) AS idf, CAST(coef AS DOUBLE) AS coef "
            f"FROM (VALUES {rows}) t(term, idf, coef))")


INTERCEPT = f"CAST({fv.DEMO_INTERCEPT!r} AS DOUBLE)"


def requests_cte(simplify_mode="'local'", translate_mode="'local'") -> str:
    """Turn requests (see route.turn_requests)."""
    return f"""
req AS (
  SELECT c.conv_id, c.turn,
         CASE WHEN c.role = 'assistant' THEN 'doctor' ELSE 'patient' END AS speaker,
         c.text, l.lang_name,
         CASE WHEN c.role = 'assistant' THEN 'en_XX' ELSE l.lang_code END AS src_lang,
         CASE WHEN c.role = 'assistant' THEN l.lang_code ELSE 'en_XX' END AS tgt_lang,
         {simplify_mode} AS simplify_mode, {translate_mode} AS translate_mode
  FROM conversations c JOIN langs l ON l.idx = c.conv_id % 6
  WHERE c.role IN ('assistant', 'user') AND {nonblank('c.text')}
)"""


def score_ctes(src: str, keys: str, text: str = "text") -> str:
    """margin for every row of ``src`` (demo weights); defines ``scored``."""
    return f"""
tok_u AS (SELECT {keys}, {tokens(text)} AS u FROM {src}),
toks AS (SELECT {keys}, unnest({with_bigrams('u')}) AS term FROM tok_u),
tc AS (SELECT {keys}, toks.term, count(*) AS tf, any_value(w.idf) AS idf, any_value(w.coef) AS coef
       FROM toks JOIN w ON toks.term = w.term GROUP BY ALL),
sums AS (SELECT {keys}, sum(tf * idf * coef) AS dot, sum((tf * idf) * (tf * idf)) AS sq
         FROM tc GROUP BY ALL),
scored AS (SELECT s.*, coalesce(sums.dot / sqrt(sums.sq), 0.0) + {INTERCEPT} AS margin
           FROM {src} s LEFT JOIN sums USING ({keys}))"""


def glossary_expr(x: str) -> str:
    """Leftmost-longest whole-word glossary rewrite of ``x``."""
    norm = {}
    for term, plain in fv.GLOSSARY:
        norm.setdefault(" ".join(term.lower().split()), plain)
    alts = "|".join(sorted(norm, key=lambda t: (-len(t), t)))
    pat = q("(?i)\\b(?:" + alts + ")\\b")
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(norm.items()))
    found = f"regexp_extract_all({x}, {pat})"
    parts = f"regexp_split_to_array({x}, {pat})"
    piece = (f"(CASE lower(f[i]) {cases} ELSE f[i] END) || p[i + 1]")
    return (f"(SELECT p[1] || coalesce(array_to_string(list_transform(range(1, len(f) + 1), "
            f"lambda i: {piece}), ''), '') FROM (SELECT {found} AS f, {parts} AS p))")


CODES = ", ".join(q(c) for c in ("en_XX", "ps_AF", "xh_ZA", "ne_NP", "si_LK", "my_MM", "mn_MN", "es_XX", "fr_XX", "de_DE"))


def mark_words(phrase: str) -> str:
    """Each word (letters, marks, digits, underscore) between U+E000 and U+E001."""
    out, inside = "", False
    for c in phrase:
        word = c == "_" or unicodedata.category(c)[0] in "LMN"
        out += ("\ue000" if word and not inside else "\ue001" if inside and not word else "") + c
        inside = word
    return out + ("\ue001" if inside else "")


def translate_exprs(text: str, src: str, tgt: str) -> tuple[str, str]:
    """(translation, error) of the phrase table. Words are put between two private
    characters, so that a phrase is found as whole words in any script."""
    pairs: dict = {}
    for s, t, phrase, plain in fv.phrase_rows():
        known = pairs.setdefault((s, t), {})
        known[phrase] = min(plain, known.get(phrase, plain))
    words = f"regexp_replace({text}, '([\\p{{L}}\\p{{M}}\\p{{N}}_]+)', '\ue000\\1\ue001', 'g')"

    branches = []
    for (s, t), terms in sorted(pairs.items()):
        keyed = {mark_words(k): v for k, v in terms.items()}
        alts = "|".join(sorted(keyed, key=lambda k: (-len(k), k)))
        pat = q(f"(?i)(?:{alts})")
        cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(keyed.items()))
        piece = f"(CASE lower(f[i]) {cases} ELSE f[i] END) || p[i + 1]"
        value = (f"(SELECT p[1] || coalesce(array_to_string(list_transform(range(1, len(f) + 1), lambda i: {piece}), ''), '') "
                 f"FROM (SELECT regexp_extract_all({words}, {pat}) AS f, regexp_split_to_array({words}, {pat}) AS p))")
        branches.append(f"WHEN {src} = {q(s)} AND {tgt} = {q(t)} THEN regexp_replace({value}, '[\ue000\ue001]', '', 'g')")
    er = (f"CASE WHEN {text} IS NULL THEN NULL "
          f"WHEN {src} IS NULL OR {src} NOT IN ({CODES}) THEN 'unsupported language ' || coalesce({src}, 'null') "
          f"WHEN {tgt} IS NULL OR {tgt} NOT IN ({CODES}) THEN 'unsupported language ' || coalesce({tgt}, 'null') END")
    tr = f"CASE WHEN {er} IS NULL THEN CASE {' '.join(branches)} ELSE {text} END END"
    return tr, er


def processed_ctes() -> str:
    """Full turn processing over conversations; defines ``proc``."""
    tr, er = translate_exprs("working", "src_lang", "tgt_lang")
    return f"""
{langs_cte()}, {weights_cte()}, {requests_cte()},
gated AS (SELECT * FROM req WHERE src_lang = 'en_XX'),
{score_ctes('gated', 'conv_id, turn')},
cls AS (
  SELECT conv_id, turn, speaker, src_lang, tgt_lang, text, margin > 0 AS medical,
         1.0 / (1.0 + exp(-abs(margin))) AS confidence, margin FROM scored
  UNION ALL
  SELECT conv_id, turn, speaker, src_lang, tgt_lang, text, NULL, NULL, NULL FROM req
  WHERE src_lang <> 'en_XX'),
simp AS (
  SELECT *, CASE WHEN medical THEN {py_strip(glossary_expr('text'))} END AS simplified FROM cls),
work AS (SELECT *, CASE WHEN medical THEN simplified ELSE text END AS working FROM simp),
proc AS (SELECT *, {tr} AS translation, {er} AS error FROM work)"""


def lattice_sql() -> str:
    """The best path of every turn's lattice: states of all turns move on one place a step."""
    table = ", ".join(f"({q(s)}, {q(t)}, {q(p)}, {q(o)})" for s, t, p, o in fv.phrase_rows())
    blank = "[ \\t\\n\\r\\f]"
    pattern = q(blank + "*(?:[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_ \\t\\n\\r\\f])")
    toks = lambda x: f"list_transform(regexp_extract_all({x}, {pattern}), lambda v: regexp_replace(v, {q('^' + blank + '+')}, ' '))"
    word = lambda x: f"lower(ltrim({x}, ' '))"
    key = lambda x: word(f"array_to_string({x}, '')")
    _, er = translate_exprs("text", "src_lang", "tgt_lang")
    return f"""WITH RECURSIVE {langs_cte()}, {requests_cte()},
doc AS (SELECT list_concat([''], list_transform({toks('text')}, lambda v: {word('v')}), ['']) AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL),
big AS (SELECT p, n, count(*) AS c FROM (SELECT unnest(w[:-2]) AS p, unnest(w[2:]) AS n FROM doc) GROUP BY ALL),
lm AS MATERIALIZED (SELECT p, n, round(ln(c / sum(c) OVER (PARTITION BY p)) * 1000)::BIGINT AS lm FROM big),
raw AS (SELECT DISTINCT * FROM (VALUES {table}) v(src, tgt, phrase, outs)),
ent AS (SELECT src, tgt, {key(toks('phrase'))} AS k, len({toks('phrase')}) AS size, outs, string_split(lower(outs), ' ') AS w,
        round(ln(1 / count(*) OVER (PARTITION BY src, tgt, phrase)) * 1000)::BIGINT AS score FROM raw),
inside AS (SELECT src, tgt, k, outs, sum(CASE WHEN e.tgt = 'en_XX' THEN coalesce(lm, -12000) ELSE -12000 END)::BIGINT AS lm
  FROM (SELECT src, tgt, k, outs, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM ent) e LEFT JOIN lm ON lm.p = a AND lm.n = b GROUP BY ALL),
entry AS MATERIALIZED (SELECT e.src, e.tgt, e.k, e.size, e.outs, w[1] AS first, w[-1] AS last, e.score + coalesce(i.lm, 0) AS score
  FROM ent e LEFT JOIN inside i ON i.src = e.src AND i.tgt = e.tgt AND i.k = e.k AND i.outs = e.outs),
row_t AS MATERIALIZED (SELECT row_number() OVER () AS r, conv_id, turn, src_lang, tgt_lang, text, {er} AS error, {toks('text')} AS t FROM req),
spot AS (SELECT r, src_lang, tgt_lang, t, unnest(range(1, len(t) + 1)) AS i FROM row_t WHERE error IS NULL),
edge AS MATERIALIZED (
  SELECT r, i - 1 AS i, 1 AS size, ltrim(t[i], ' ') AS outs, {word('t[i]')} AS first, {word('t[i]')} AS last, -8000 AS score, t[i][1] = ' ' AS blank FROM spot
  UNION ALL SELECT r, i - 1, e.size, e.outs, e.first, e.last, e.score, t[i][1] = ' '
  FROM spot, range(1, 5) m(m) JOIN entry e ON e.src = src_lang AND e.tgt = tgt_lang AND e.size = m AND e.k = {key('t[i:i + m - 1]')} AND i + m - 1 <= len(t)),
pair AS MATERIALIZED (
  SELECT DISTINCT r, tgt_lang, a.last AS p, b.first AS n FROM (SELECT r, i + size AS j, last FROM edge UNION SELECT r, 0, '' FROM row_t) a
  JOIN (SELECT r, i AS j, first FROM edge UNION SELECT r, len(t), '' FROM row_t) b USING (r, j) JOIN row_t USING (r)),
step_lm AS MATERIALIZED (SELECT r, p, n, CASE WHEN tgt_lang = 'en_XX' THEN coalesce(lm, -12000) ELSE -12000 END AS lm FROM pair LEFT JOIN lm USING (p, n)),
path AS (
  SELECT r, 0 AS k, 0::BIGINT AS pos, len(t) AS n, '' AS last, 0::BIGINT AS score, 0 AS edges, ''::VARCHAR AS before, 0::BIGINT AS size, ['']::VARCHAR[] AS outs, []::VARCHAR[] AS words, ''::VARCHAR AS line
  FROM row_t WHERE error IS NULL
  UNION ALL
  SELECT r, k + 1, pos, n, last, score, edges, before, size, outs, words, line FROM (
    SELECT r, k, pos, n, last, score, edges, before, size, outs, words, line FROM path WHERE k < n AND pos > k
    UNION ALL
    SELECT p.r, p.k, p.pos + e.size, p.n, e.last, p.score + e.score + s.lm, p.edges + 1, p.last, e.size, string_split(e.outs, ' '),
      list_concat(p.words, string_split(e.outs, ' ')),
      CASE WHEN len(p.words) >= {fv.TRANSLATE_MAX_LENGTH} THEN p.line ELSE p.line || CASE WHEN e.blank AND p.line <> '' THEN ' ' ELSE '' END
        || array_to_string(string_split(e.outs, ' ')[1:{fv.TRANSLATE_MAX_LENGTH} - len(p.words)], ' ') END
    FROM path p JOIN edge e ON e.r = p.r AND e.i = p.pos JOIN step_lm s ON s.r = p.r AND s.p = p.last AND s.n = e.first WHERE p.k < p.n AND p.pos = p.k)
  QUALIFY row_number() OVER (PARTITION BY r, pos, last ORDER BY score DESC, edges, before, size, outs) = 1),
ends AS (SELECT path.r, line, words, score + lm AS score FROM path JOIN step_lm s ON s.r = path.r AND s.p = last AND s.n = ''
  WHERE pos = path.n AND k = path.n
  QUALIFY row_number() OVER (PARTITION BY path.r ORDER BY score + lm DESC, edges, last) = 1)
SELECT conv_id, turn, src_lang, tgt_lang, line AS translation, score AS path_score, len(words) > {fv.TRANSLATE_MAX_LENGTH} AS truncated, error
FROM row_t LEFT JOIN ends USING (r)"""


def corpus_ctes() -> str:
    """Corpus, balanced sample and stratified split; defines corpus, bal, split."""
    return f"""
pos AS (SELECT 'pos' AS source, doc_id AS id, text, 1 AS label FROM documents
        WHERE lang = 'en' AND text IS NOT NULL AND length(text) > 0),
ut AS (SELECT conv_id, coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), '') AS text
       FROM conversations GROUP BY conv_id),
neg AS (SELECT 'neg' AS source, conv_id AS id, text, 0 AS label FROM ut WHERE {nonblank('text')}),
corpus AS (SELECT * FROM pos UNION ALL SELECT * FROM neg),
bal_k AS (SELECT *, md5('42:' || source || ':' || CAST(id AS VARCHAR)) AS k FROM corpus),
bal_q AS (SELECT min(c) AS quota FROM (SELECT label, count(*) AS c FROM corpus GROUP BY label)),
bal AS (SELECT source, id, text, label FROM
        (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS rn FROM bal_k) r, bal_q
        WHERE rn <= quota),
sp_k AS (SELECT *, md5('42:split:' || source || ':' || CAST(id AS VARCHAR)) AS k FROM bal),
sp_c AS (SELECT label, count(*) AS c FROM bal GROUP BY label),
sp_n AS (SELECT sum(c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * CAST(sum(c) AS DOUBLE)) AS BIGINT) AS n_test FROM sp_c),
sp_f AS (SELECT label, c, n, n_test, CAST(c AS DOUBLE) / n * (n - n_test) AS cont,
                floor(CAST(c AS DOUBLE) / n * (n - n_test)) AS fl FROM sp_c, sp_n),
sp_r AS (SELECT *, (n - n_test) - sum(fl) OVER () AS need,
                row_number() OVER (ORDER BY cont - fl DESC, label) AS pos FROM sp_f),
sp_q AS (SELECT label, c - (fl + CASE WHEN pos <= need THEN 1 ELSE 0 END) AS quota FROM sp_r),
split AS (SELECT r.source, r.id, r.text, r.label,
                 CASE WHEN r.rn <= sp_q.quota THEN 'test' ELSE 'train' END AS split
          FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, id) AS rn FROM sp_k) r
          JOIN sp_q USING (label)),
tr AS (SELECT * FROM split WHERE split = 'train'),
te AS (SELECT * FROM split WHERE split = 'test')"""


def stats_ctes() -> str:
    """Term statistics, vocabulary and IDF on the training split."""
    return f"""
tr_u AS (SELECT {tokens('text')} AS u FROM tr),
tr_t AS (SELECT {with_bigrams('u')} AS t FROM tr_u),
occ AS (SELECT term, count(*) AS tf FROM (SELECT unnest(t) AS term FROM tr_t) GROUP BY term),
dis AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM tr_t) GROUP BY term),
stats AS (SELECT term, tf, df FROM occ JOIN dis USING (term)),
vocab AS (SELECT * FROM stats ORDER BY tf DESC, term LIMIT {MAX_FEATURES}),
idf AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM vocab, (SELECT count(*) AS n FROM tr))"""


def demo_pred_ctes() -> str:
    return f"""{weights_cte()}, {score_ctes('te', 'source, id')},
pr AS (SELECT source, id, text, label, CAST(margin > 0 AS INTEGER) AS prediction FROM scored)"""


def tag_expr(medical: str, conf: str) -> str:
    pct = f"CAST(CAST(round_even({conf} * 100, 0) AS BIGINT) AS VARCHAR)"
    return (f"CASE WHEN {medical} IS NULL THEN NULL ELSE "
            f"(CASE WHEN {medical} THEN {q(fv.TAG_MEDICAL)} ELSE {q(fv.TAG_NOT_MEDICAL)} END) || "
            f"(CASE WHEN {conf} IS NULL THEN '' ELSE ' · ' || {pct} || '% conf.' END) END")


def numbering_ctes() -> str:
    return f"""
ev AS (SELECT conv_id, turn, role, text,
              sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER
                (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch
       FROM conversations),
num AS (SELECT conv_id, turn, CAST(epoch AS BIGINT) AS epoch,
               row_number() OVER (PARTITION BY conv_id, epoch ORDER BY turn) AS turn_no
        FROM ev WHERE role <> 'system' AND {nonblank('text')})"""


def transcript_ctes() -> str:
    return f"""{processed_ctes()}, {numbering_ctes()},
trn AS (
  SELECT p.conv_id, n.epoch, n.turn_no, p.speaker,
         CASE WHEN p.speaker = 'doctor' THEN 'assistant' ELSE 'user' END AS role,
         CASE WHEN p.speaker = 'doctor' THEN p.text
              WHEN p.error IS NOT NULL THEN {q(fv.PLACEHOLDER_PATIENT_FAILED)} ELSE p.translation END AS en,
         CASE WHEN p.speaker <> 'doctor' THEN p.text
              WHEN p.error IS NOT NULL THEN {q(fv.PLACEHOLDER_DOCTOR_FAILED)} ELSE p.translation END AS xx,
         CASE WHEN p.speaker = 'doctor' AND p.error IS NULL THEN {tag_expr('p.medical', 'p.confidence')} END AS tag,
         CASE WHEN p.speaker = 'doctor' AND p.error IS NULL AND length(p.simplified) > 0
              THEN p.simplified END AS simplified,
         p.error
  FROM proc p JOIN num n USING (conv_id, turn)
  JOIN (SELECT conv_id, max(epoch) AS epoch FROM ev GROUP BY conv_id) m ON m.conv_id = n.conv_id AND m.epoch = n.epoch)"""


def doc_requests_cte() -> str:
    rows = ", ".join(f"({q(a)}, {q(b)})" for a, b in fv.DOC_LANG_CODES)
    return f"""
dl AS (SELECT * FROM (VALUES {rows}) t(lang, lang_code)),
dreq AS (SELECT d.doc_id, d.text, d.lang, dl.lang_code AS src_lang,
                CASE WHEN dl.lang_code = 'en_XX' THEN l.lang_code ELSE 'en_XX' END AS tgt_lang
         FROM documents d LEFT JOIN dl ON d.lang = dl.lang JOIN langs l ON l.idx = d.doc_id % 6)"""


def neg_count(x: str, w: str) -> str:
    return f"len(list_filter({tokens(x)}, lambda t: t = {q(w)}))"


HTML_ESCAPE_SQL = (
    "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
    "'\"', '&quot;'), '''', '&#x27;')"
)


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    C = corpus_ctes()
    R6 = "round({0}, 6) AS {0}".format
    s["filter_nonempty"] = f"WITH {C} SELECT * FROM pos"
    s["extract_user_text"] = f"WITH {C} SELECT conv_id, text FROM ut"
    s["extract_user_text_nested"] = s["extract_user_text"]
    s["filter_nonblank"] = f"SELECT * FROM conversations WHERE {nonblank('text')}"
    s["corpus_build"] = f"WITH {C} SELECT * FROM corpus"
    s["class_counts"] = f"""WITH {C}
SELECT label, n_class, min(n_class) OVER () AS n_per_class,
       min(n_class) OVER () * count(*) OVER () AS n_total
FROM (SELECT label, count(*) AS n_class FROM corpus GROUP BY label)"""
    s["balanced_sample"] = f"WITH {C} SELECT source, id, label FROM bal"
    s["stratified_split"] = f"WITH {C} SELECT source, id, label, split FROM split"
    s["class_weights"] = f"""WITH {C}
SELECT label, n_class, round(sum(n_class) OVER () / (count(*) OVER () * n_class), 6) AS weight
FROM (SELECT label, count(*) AS n_class FROM tr GROUP BY label)"""
    s["tokens"] = f"""SELECT doc_id, len(u) AS n_tokens, len(list_distinct(u)) AS n_distinct
FROM (SELECT doc_id, {tokens('text')} AS u FROM documents)"""
    s["ngrams"] = f"""SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct_terms
FROM (SELECT doc_id, {with_bigrams('u')} AS t FROM (SELECT doc_id, {tokens('text')} AS u FROM documents))"""
    s["html_escape"] = f"SELECT conv_id, turn, {HTML_ESCAPE_SQL} AS escaped FROM conversations"
    s["prompt_build"] = f"""WITH {langs_cte()}, {requests_cte()}
SELECT conv_id, turn, CAST(0 AS BIGINT) AS msg_idx, 'system' AS role, {q(fv.SYSTEM_PROMPT)} AS content
FROM req WHERE src_lang = 'en_XX'
UNION ALL
SELECT conv_id, turn, CAST(1 AS BIGINT), 'user', text FROM req WHERE src_lang = 'en_XX'"""
    s["turn_tags"] = f"""WITH {processed_ctes()}
SELECT conv_id, turn, {tag_expr('medical', 'confidence')} AS tag FROM proc WHERE speaker = 'doctor'"""
    S = stats_ctes()
    s["term_stats"] = f"WITH {C}, {S} SELECT * FROM stats"
    s["vocab_topk"] = f"WITH {C}, {S} SELECT * FROM vocab"
    s["idf_table"] = f"WITH {C}, {S} SELECT term, df, {R6('idf')} FROM idf"
    s["tfidf"] = f"""WITH {C}, {S},
te_u AS (SELECT source, id, {tokens('text')} AS u FROM te),
te_t AS (SELECT source, id, unnest({with_bigrams('u')}) AS term FROM te_u),
te_c AS (SELECT source, id, te_t.term, count(*) * any_value(idf.idf) AS x
         FROM te_t JOIN idf ON te_t.term = idf.term GROUP BY ALL),
te_n AS (SELECT source, id, sqrt(sum(x * x)) AS norm FROM te_c GROUP BY ALL)
SELECT source, id, term, round(x / norm, 6) AS weight FROM te_c JOIN te_n USING (source, id)"""
    s["svm_gradient"] = f"""WITH {C}, {S},
tr_r AS (SELECT row_number() OVER () AS r, label, {tokens('text')} AS u FROM tr),
tr_x AS (SELECT r, label, o.term, count(*) * any_value(idf.idf) AS x
         FROM (SELECT r, label, unnest({with_bigrams('u')}) AS term FROM tr_r) o JOIN idf ON o.term = idf.term GROUP BY ALL),
tr_n AS (SELECT r, sqrt(sum(x * x)) AS norm FROM tr_x GROUP BY r),
cost AS (SELECT label, sum(n_class) OVER () / (count(*) OVER () * n_class) AS c
         FROM (SELECT label, count(*) AS n_class FROM tr GROUP BY label))
SELECT term, round(sum(-2 * c * (2 * label - 1) * x / norm), 6) AS gradient, round(1 + sum(2 * c * x * x / (norm * norm)), 6) AS curvature
FROM tr_x JOIN tr_n USING (r) JOIN cost USING (label) GROUP BY term"""
    s["svm_score"] = f"""WITH {weights_cte()}, {score_ctes('documents', 'doc_id')}
SELECT doc_id, {R6('margin')} FROM scored"""
    s["classify_turns"] = f"""WITH {langs_cte()}, {weights_cte()}, {requests_cte()},
gated AS (SELECT * FROM req WHERE src_lang = 'en_XX'), {score_ctes('gated', 'conv_id, turn')}
SELECT conv_id, turn, {R6('margin')}, margin > 0 AS medical,
       round(1.0 / (1.0 + exp(-abs(margin))), 6) AS confidence FROM scored"""
    P = demo_pred_ctes()
    s["eval_metrics"] = f"""WITH {C}, {P},
m AS (SELECT count(*) AS n,
        sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
        sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn,
        sum(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn FROM pr),
pr1 AS (SELECT n, CAST(tp + tn AS DOUBLE) / n AS accuracy,
          CASE WHEN tp + fp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p1,
          CASE WHEN tp + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS r1,
          CASE WHEN tn + fn = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tn AS DOUBLE) / (tn + fn) END AS p0,
          CASE WHEN tn + fp = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tn AS DOUBLE) / (tn + fp) END AS r0 FROM m)
SELECT n, round(accuracy, 6) AS accuracy, round((p0 + p1) / 2, 6) AS macro_precision,
       round((r0 + r1) / 2, 6) AS macro_recall,
       round(((CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END)
            + (CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END)) / 2, 6) AS macro_f1
FROM pr1"""
    s["confusion"] = f"""WITH {C}, {P}
SELECT a.actual, count(CASE WHEN pr.prediction = 0 THEN 1 END) AS pred_0,
       count(CASE WHEN pr.prediction = 1 THEN 1 END) AS pred_1
FROM (VALUES (0), (1)) a(actual) LEFT JOIN pr ON pr.label = a.actual GROUP BY a.actual"""
    s["misclassified"] = f"""WITH {C}, {P}
SELECT source, id, CASE WHEN label = 0 THEN 'false_positive' ELSE 'false_negative' END AS kind,
       substring(text, 1, {fv.PREVIEW_CHARS}) AS preview FROM pr WHERE label <> prediction"""
    s["direction_gate"] = f"""WITH {langs_cte()}, {requests_cte()}
SELECT conv_id, turn, speaker, src_lang, tgt_lang, src_lang = 'en_XX' AS gated FROM req"""
    s["lang_lookup"] = f"""WITH {langs_cte()}
SELECT c.conv_id, l.lang_name, l.lang_code FROM (SELECT DISTINCT conv_id FROM conversations) c
JOIN langs l ON l.idx = c.conv_id % 6"""
    s["lang_unknown"] = f"""WITH {langs_cte()}, {doc_requests_cte()}
SELECT doc_id, lang, src_lang FROM dreq r
WHERE NOT EXISTS (SELECT 1 FROM langs l WHERE l.lang_code = r.src_lang)"""
    modes = "['api', 'local', 'other']"
    s["backend_route"] = f"""WITH {langs_cte()},
{requests_cte(f"{modes}[conv_id % 3 + 1]", f"{modes}[(conv_id + 1) % 3 + 1]")}
SELECT conv_id, turn, simplify_mode, translate_mode,
       CASE WHEN simplify_mode = 'local' THEN 'local' ELSE 'api' END AS simplify_backend,
       CASE WHEN translate_mode = 'api' THEN 'api' ELSE 'local' END AS translate_backend FROM req"""
    PR = processed_ctes()
    s["working_text"] = f"WITH {PR} SELECT conv_id, turn, working FROM proc"
    s["turn_steps"] = f"""WITH {PR}
SELECT conv_id, turn, src_lang, tgt_lang, text AS original, medical,
       round(confidence, 6) AS confidence, simplified, translation FROM proc"""
    s["process_turns"] = f"""WITH {PR}
SELECT conv_id, turn, speaker, src_lang, tgt_lang, text AS original, medical,
       round(confidence, 6) AS confidence, simplified, translation, error FROM proc"""
    gl = glossary_expr("text")
    norm = sorted({" ".join(t.lower().split()) for t, _ in fv.GLOSSARY}, key=lambda t: (-len(t), t))
    pat = q("(?i)\\b(?:" + "|".join(norm) + ")\\b")
    s["glossary_simplify"] = f"""SELECT doc_id, len(regexp_extract_all(text, {pat})) AS n_replaced,
       {gl} AS simplified FROM documents WHERE lang = 'en'"""
    s["glossary_simplify_joined"] = f"SELECT doc_id, {gl} AS simplified FROM documents WHERE lang = 'en'"
    s["simplify_turns"] = f"WITH {PR} SELECT conv_id, turn, simplified FROM proc WHERE simplified IS NOT NULL"
    s["translate_turns"] = f"WITH {PR} SELECT conv_id, turn, src_lang, tgt_lang, translation, error FROM proc"
    tr_, er_ = translate_exprs("text", "src_lang", "tgt_lang")
    D = f"{langs_cte()}, {doc_requests_cte()}, dtr AS (SELECT *, {tr_} AS translation, {er_} AS error FROM dreq)"
    s["translate_documents"] = f"WITH {D} SELECT doc_id, src_lang, tgt_lang, translation, error FROM dtr"
    s["translate_documents_joined"] = s["translate_documents"]
    s["translate_lattice"] = lattice_sql()
    s["turn_errors"] = f"""WITH {langs_cte()}, {doc_requests_cte()},
sent AS (SELECT doc_id, text, src_lang, CASE WHEN lang = 'en' THEN tgt_lang ELSE lang END AS tgt_lang FROM dreq),
er AS (SELECT doc_id, src_lang, tgt_lang, {er_} AS error FROM sent)
SELECT * FROM er WHERE error IS NOT NULL"""
    RW = f"rw AS (SELECT doc_id, text, {gl} AS simplified FROM documents WHERE lang = 'en')"
    negs = ", ".join(f"{neg_count('text', w)} AS {w}_src, {neg_count('simplified', w)} AS {w}_out"
                     for w in fv.NEGATION_WORDS)
    kept = " AND ".join(f"{neg_count('simplified', w)} >= {neg_count('text', w)}" for w in fv.NEGATION_WORDS)
    s["audit_negation"] = f"WITH {RW} SELECT doc_id, {negs}, {kept} AS negations_kept FROM rw"

    def nums(x):
        num, blank = "([0-9]+(?:[.,][0-9]+)*)", "[ \\t\\x{A0}]"
        units = "|".join(fv.UNITS)
        raw = f"regexp_extract_all(lower({x}), '{num}{blank}*[\\p{{L}}%]*')"
        joined = f"list_transform({raw}, lambda t: regexp_replace(t, '^{num}{blank}+({units})$', '\\1\\2'))"
        return f"list_sort(list_transform({joined}, lambda t: regexp_replace(t, '{blank}.*$', '')))"
    s["audit_numbers"] = f"""WITH {RW}
SELECT doc_id, len({nums('text')}) AS numbers_src, len({nums('simplified')}) AS numbers_out,
       {nums('text')} = {nums('simplified')} AS numbers_kept FROM rw"""
    cases = " ".join(f"WHEN {q(k)} THEN len(list_filter(regexp_extract_all(translation, '\\p{{L}}'), lambda c: regexp_matches(c, {q(v)})))"
                     for k, v in fv.SCRIPT_RE2.items())
    s["audit_script"] = f"""WITH {PR},
sc AS (SELECT p.conv_id, p.turn, p.tgt_lang, l.script,
              len(regexp_extract_all(p.translation, '\\p{{L}}')) AS letters,
              CASE l.script {cases} END AS in_script
       FROM proc p LEFT JOIN langs l ON l.lang_code = p.tgt_lang)
SELECT conv_id, turn, tgt_lang, script, letters, in_script,
       round(CASE WHEN letters > 0 THEN in_script / letters END, 6) AS script_share FROM sc"""
    # an output that is a prefix: its tokens align, what follows in the source doesn't
    toks = "list_transform(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_ \\t\\n\\r\\f]'), lambda v: v)"
    negations = lambda x: f"len(list_filter({x}, lambda v: v IN ('no', 'not', 'without')))"
    s["audit_alignment_cut"] = f"""WITH parts AS (
  SELECT doc_id, text, string_split(text, '.') AS p FROM documents WHERE lang = 'en'),
halves AS (SELECT doc_id, {toks.format('text')} AS a, {toks.format("array_to_string(p[1:ceil(len(p) / 2)::INT], '.')")} AS b FROM parts)
SELECT doc_id, {negations('a')} AS negations, {negations('a')} - {negations('b')} AS negations_lost, 0 AS negations_moved, 0 AS added_words FROM halves"""
    s["audit_length"] = f"""WITH {PR},
ln AS (SELECT conv_id, turn, {ws_count('text')} AS words_src, {ws_count('translation')} AS words_out,
              translation FROM proc)
SELECT conv_id, turn, words_src, words_out,
       round(CASE WHEN words_src > 0 THEN words_out / words_src END, 6) AS length_ratio,
       NOT coalesce({nonblank('translation')}, false) AS empty_output,
       words_out >= {fv.TRANSLATE_MAX_LENGTH} AS at_cap FROM ln"""
    s["audit_length_rewrite"] = f"""WITH {RW},
ln AS (SELECT doc_id, {ws_count('text')} AS words_src, {ws_count('simplified')} AS words_out, simplified FROM rw)
SELECT doc_id, words_src, words_out,
       round(CASE WHEN words_src > 0 THEN words_out / words_src END, 6) AS length_ratio,
       NOT coalesce({nonblank('simplified')}, false) AS empty_output,
       words_out >= {fv.SIMPLIFY_MAX_NEW_TOKENS} AS at_cap FROM ln"""
    N = numbering_ctes()
    s["turn_numbers"] = f"WITH {N} SELECT conv_id, turn, turn_no FROM num"
    s["conversation_epochs"] = f"WITH {N} SELECT conv_id, turn, epoch, turn_no FROM num"
    T = transcript_ctes()
    s["bilingual_views"] = f"WITH {T} SELECT * FROM trn"
    s["panel_history"] = f"""WITH {T}
SELECT conv_id, epoch, 'doctor' AS panel, turn_no, role, en AS content FROM trn
UNION ALL SELECT conv_id, epoch, 'patient', turn_no, role, xx FROM trn"""
    s["bilingual_pairs"] = f"""WITH {T}
SELECT conv_id, epoch, turn_no, role, en AS doctor_panel, xx AS patient_panel FROM trn"""
    s["svm_train_eval"] = f"""WITH {C}, {S}
SELECT (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM vocab) AS n_terms,
       (SELECT count(*) FROM te) AS n_test, true AS beats_chance, true AS f1_in_range, true AS paths_agree"""
    s["stream_score_turns"] = """SELECT conv_id, turn, true AS as_batch, true AS label_is_sign, true AS confidence_in_range
FROM conversations WHERE role = 'assistant'"""
    s["stream_turn_numbers"] = s["conversation_epochs"]
    s["stream_turn_numbers_after_batch"] = s["conversation_epochs"]
    s["stream_panels"] = s["panel_history"]
    s["extract_user_text_jsonl"] = s["extract_user_text_nested"]
    s["vocab_topk_two_pass"] = s["vocab_topk"]
    s["stream_process_turns"] = s["process_turns"]
    s["turn_append"] = s["process_turns"]
    return s
