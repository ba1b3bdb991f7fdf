"""For each registered query, SQL that gives the same rows.

The texts are put together from common table expressions, each written on its
own terms (windows, joins and regular expressions without look-around), so that
they check the Spark expressions and do not repeat them.
"""

from __future__ import annotations

from factloom.catalog.fixtures import GAZETTEER_PATTERNS, TAXON_WORDS
from factloom.functions.chunks import INTERACTION_PATTERN
from factloom.functions.stopwords import ENGLISH
from factloom.functions.tags import DETERMINERS, PREPOSITIONS, VERB_ENDINGS
from factloom.functions.text import ABBREVIATIONS
from factloom.schema import JATS_PATHS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


STOP = in_list(ENGLISH)
BLANK = r"[ \t\n\f\r]"
CLOSER = "[\"'”’)\\]]"
OPENER = "[\"'“‘(\\[]"
KNOWN = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
# An abbreviation before a blank gets a mark, which keeps a break from being seen
# there. Twice, as neighbouring initials share a blank.
MARK = quoted(rf"(^|[^\p{{L}}\p{{N}}_])((?:{KNOWN}|\p{{Lu}})\.)({BLANK})")
BREAK = quoted(rf"([.!?]{CLOSER}{{0,2}}){BLANK}+({OPENER}{{0,2}}\p{{Lu}})")


def marked(text: str, mark: str = MARK) -> str:
    return rf"regexp_replace({text}, {mark}, '\1\2' || chr(2) || '\3', 'g')"


def sentence_list(text: str, mark: str = MARK) -> str:
    broken = rf"regexp_replace({marked(marked(text, mark), mark)}, {BREAK}, '\1' || chr(1) || '\2', 'g')"
    return (
        f"list_filter(string_split(replace({broken}, chr(2), ''), chr(1)), "
        f"lambda s: regexp_matches(s, '[^ \\t\\n\\f\\r]'))"
    )


BLANKS = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"
WORDS = f"regexp_split_to_array(lower(rtrim(sentence, {BLANKS})), '{BLANK}')"

SENTS = f"""
lists AS (SELECT doc_id, {sentence_list("text")} AS l FROM documents),
sents AS (SELECT doc_id, unnest(range(len(l))) AS sent_no, unnest(l) AS sentence FROM lists)"""

FEATS = f"""{SENTS},
filt AS (
  SELECT *, list_filter({WORDS}, lambda w: w NOT IN {STOP}) AS f FROM sents),
feats AS (
  SELECT doc_id, sent_no, sentence, f,
         list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1]) AS b
  FROM filt),
occ AS (SELECT doc_id, sent_no, unnest(list_concat(f, b)) AS term FROM feats),
cnt AS (SELECT doc_id, sent_no, term, count(*) AS n FROM occ GROUP BY ALL),
voc AS (
  SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS tf FROM cnt
  GROUP BY term HAVING count(*) >= 3)"""

TAXA = "taxa AS (SELECT unnest([" + ", ".join(quoted(w) for w in TAXON_WORDS) + "]) AS word),\n" + (
    "alias AS (SELECT word AS term, 'taxon ' || word AS entity FROM taxa "
    "UNION ALL SELECT 'taxon ' || word, 'taxon ' || word FROM taxa)"
)


def matched(min_tf: int) -> str:
    return f"""{FEATS},
{TAXA},
hit AS (
  SELECT c.doc_id, c.sent_no, c.term, c.n FROM cnt c
  WHERE c.n >= {min_tf} AND c.term IN (SELECT term FROM alias)
    AND c.term IN (SELECT term FROM voc))"""


VERB = " OR ".join(f"ends_with(lower(word), '{e}')" for e in VERB_ENDINGS)
WORDPUNCT = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'"


POS_CASE = f"""CASE WHEN lower(word) IN {in_list(DETERMINERS)} THEN 'DT'
                 WHEN lower(word) IN {in_list(PREPOSITIONS)} THEN 'IN'
                 WHEN NOT regexp_matches(word, '\\p{{L}}') THEN 'SYM'
                 WHEN {VERB} THEN 'VB' ELSE 'NN' END"""

TOKENS = f"""{SENTS},
wl AS (
  SELECT doc_id, sent_no, regexp_extract_all(sentence, {WORDPUNCT}) AS w FROM sents),
tok AS (
  SELECT doc_id, sent_no, unnest(range(len(w))) AS tok_no, unnest(w) AS word FROM wl),
tagd AS (SELECT *, {POS_CASE} AS pos FROM tok)"""


SENT_ORDER = "PARTITION BY doc_id, sent_no ORDER BY tok_no"

TAGGED = f"""{TOKENS},
tagi AS (
  SELECT *, CASE WHEN pos <> 'VB' THEN 'O'
                 WHEN lag(pos) OVER ({SENT_ORDER}) = 'VB' THEN 'I-VP' ELSE 'B-VP' END AS iob
  FROM tagd)"""


# Tags that depend on their neighbours.
GOLD = f"""{TOKENS},
near AS (
  SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after,
         row_number() OVER (ORDER BY doc_id, sent_no, tok_no) AS id
  FROM tagd WINDOW w AS ({SENT_ORDER})),
gold AS MATERIALIZED (
  SELECT id, doc_id, sent_no, tok_no, word, pos AS form,
         CASE WHEN pos = 'VB' AND before = 'DT' THEN 'NN'
              WHEN pos = 'NN' AND before = 'NN' AND after = 'DT' THEN 'VB' ELSE pos END AS pos
  FROM near),
worded AS (SELECT lower(word) AS lw, pos AS lpos, count(*) AS n FROM gold GROUP BY ALL),
lex AS (
  SELECT * FROM worded
  QUALIFY row_number() OVER (PARTITION BY lw ORDER BY n DESC, lpos DESC) = 1),
follow AS (SELECT coalesce(lag(pos) OVER ({SENT_ORDER}), '') AS prev, pos FROM gold)"""

# Best paths between words with one possible tag, each path grown word by word.
PATHS = f"""{GOLD},
kinds AS (SELECT pos, count(*) AS total, row_number() OVER (ORDER BY pos) AS rank FROM gold GROUP BY pos),
pairs AS (SELECT prev, pos, count(*) AS n FROM follow GROUP BY ALL),
outof AS (SELECT prev, sum(n) AS total FROM pairs GROUP BY ALL),
trans AS MATERIALIZED (
  SELECT o.prev, k.pos, coalesce(r.rank, 0) AS rank, CAST(round(ln(
    (coalesce(n, 0) + 0.5) / (o.total + 0.5 * (SELECT count(*) FROM kinds))) * 1000000) AS BIGINT) AS t
  FROM outof o CROSS JOIN kinds k LEFT JOIN pairs p ON p.prev = o.prev AND p.pos = k.pos
  LEFT JOIN kinds r ON r.pos = o.prev),
wn AS (SELECT lower(word) AS lw, pos, count(*) AS n FROM gold GROUP BY ALL),
known AS (SELECT lw FROM wn GROUP BY lw HAVING sum(n) >= 3),
fn AS (SELECT form, pos, count(*) AS n FROM gold GROUP BY ALL),
may AS (
  SELECT id, tok_no, wn.pos, n FROM gold JOIN wn ON lower(word) = lw WHERE lw IN (FROM known)
  UNION ALL
  SELECT id, tok_no, fn.pos, n FROM gold JOIN fn USING (form) WHERE lower(word) NOT IN (FROM known)),
cand AS MATERIALIZED (
  SELECT id, tok_no, pos, CAST(round(ln(n / total) * 1000000) AS BIGINT) AS s,
         count(*) OVER (PARTITION BY id) AS ways
  FROM may JOIN kinds USING (pos)),
unsure AS MATERIALIZED (SELECT * FROM cand WHERE ways > 1 AND tok_no > 0),
walk AS (
  SELECT id, c.pos, CASE WHEN ways = 1 THEN 0 ELSE s + t END AS score, c.pos AS path
  FROM cand c JOIN trans r ON r.prev = '' AND r.pos = c.pos WHERE ways = 1 OR tok_no = 0
  UNION ALL
  SELECT u.id, u.pos, max(score + t + s), arg_max(path, (score + t) * 64 - rank) || ' ' || u.pos
  FROM walk w JOIN unsure u ON u.id = w.id + 1 JOIN trans r ON r.prev = w.pos AND r.pos = u.pos
  GROUP BY u.id, u.pos),
ended AS (
  SELECT w.id, path, (score + coalesce(t, 0)) * 64 - k.rank AS score
  FROM walk w JOIN kinds k USING (pos)
  LEFT JOIN (SELECT DISTINCT id, tok_no, ways, CASE WHEN ways = 1 THEN pos END AS sure FROM cand) c
    ON c.id = w.id + 1 AND c.tok_no > 0
  LEFT JOIN trans r ON r.prev = w.pos AND r.pos = c.sure
  WHERE c.id IS NULL OR c.ways = 1),
run AS (SELECT id, string_split(arg_max(path, score), ' ') AS tags FROM ended GROUP BY id),
best AS (SELECT id - len(tags) + unnest(range(len(tags))) + 1 AS id, unnest(tags) AS tag FROM run)"""


def chunked(tokens_cte: str = TAGGED, source: str = "tagi") -> str:
    """Chunks of labelled tokens: number the starts, group the words by number."""
    return f"""{tokens_cte},
opened AS (
  SELECT *, CASE WHEN iob = 'O' THEN 0
                 WHEN starts_with(iob, 'B-') THEN 1
                 WHEN coalesce(lag(iob) OVER ({SENT_ORDER}), 'O') = 'O' THEN 1
                 WHEN substr(lag(iob) OVER ({SENT_ORDER}), 3) <> substr(iob, 3) THEN 1
                 ELSE 0 END AS opens
  FROM {source}),
numbered AS (
  SELECT *, CAST(sum(opens) OVER ({SENT_ORDER}) - 1 AS BIGINT) AS chunk_no FROM opened),
chunk AS (
  SELECT doc_id, sent_no, chunk_no,
         max(substr(iob, 3)) FILTER (iob <> 'O') AS label,
         string_agg(word || '/' || pos, ' ' ORDER BY tok_no) FILTER (iob <> 'O') AS text,
         coalesce(string_agg(word || '/' || pos, ' ' ORDER BY tok_no) FILTER (iob = 'O'), '')
           AS gap_after
  FROM numbered WHERE chunk_no >= 0 GROUP BY ALL),
led AS (
  SELECT *, lead(text, 1) OVER w AS obj, lead(text, 2) OVER w AS third FROM chunk
  WINDOW w AS (PARTITION BY doc_id, sent_no ORDER BY chunk_no)),
rel AS (
  SELECT doc_id, sent_no, chunk_no, text AS subj, gap_after AS filler, obj FROM led
  WHERE third IS NOT NULL)"""


PATTERN = quoted(INTERACTION_PATTERN)

FEATURES = f"""{TAGGED},
nb0 AS (
  SELECT *, coalesce(lag(pos) OVER o, '<START>') AS prevpos,
         coalesce(lead(pos) OVER o, '<END>') AS nextpos,
         coalesce(sum(CASE WHEN pos = 'DT' THEN 1 ELSE 0 END)
           OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stretch
  FROM tagi WINDOW o AS ({SENT_ORDER})),
cf AS (
  SELECT doc_id, sent_no, tok_no, word, pos, iob, prevpos, nextpos,
         prevpos || '+' || pos AS prevpos_pos, pos || '+' || nextpos AS pos_nextpos,
         coalesce(array_to_string(list_sort(list_distinct(list(pos) OVER (
           PARTITION BY doc_id, sent_no, stretch ORDER BY tok_no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))), '+'), '') AS tags_since_dt
  FROM nb0)"""

FEATURE_COLUMNS = {
    "pos": "pos",
    "word": "word",
    "prevpos": "prevpos",
    "nextpos": "nextpos",
    "prevpos+pos": "prevpos_pos",
    "pos+nextpos": "pos_nextpos",
    "tags-since-dt": "tags_since_dt",
}


def long_features(source: str, columns: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {columns}, '{name}' AS fname, {column} AS fval FROM {source}"
        for name, column in FEATURE_COLUMNS.items()
    )


MODEL = f"""{FEATURES},
lf AS ({long_features("cf", "iob AS label")}),
nbc AS (SELECT fname, fval, label, count(*) AS n FROM lf GROUP BY ALL),
nbl AS (SELECT iob AS label, count(*) AS total FROM cf GROUP BY ALL),
nbb AS (SELECT fname, count(DISTINCT fval) AS bins FROM lf GROUP BY fname),
prior AS (
  SELECT label, total, ln((total + 0.5) / (sum(total) OVER () + 0.5 * count(*) OVER ())) AS logp
  FROM nbl)"""

NB_TAGGED = f"""{MODEL},
lft AS ({long_features("cf", "doc_id, sent_no, tok_no")}),
scored AS (
  SELECT t.doc_id, t.sent_no, t.tok_no, l.label,
         round(any_value(p.logp)
           + sum(ln((coalesce(c.n, 0) + 0.5) / (l.total + 0.5 * b.bins))), 9) AS score
  FROM lft t CROSS JOIN nbl l
  JOIN nbb b USING (fname) JOIN prior p ON p.label = l.label
  LEFT JOIN nbc c ON c.fname = t.fname AND c.fval = t.fval AND c.label = l.label
  GROUP BY t.doc_id, t.sent_no, t.tok_no, l.label),
best AS (
  SELECT doc_id, sent_no, tok_no, max({{'score': score, 'label': label}}).label AS iob
  FROM scored GROUP BY ALL),
tagn AS (
  SELECT cf.doc_id, cf.sent_no, cf.tok_no, cf.word, cf.pos, best.iob
  FROM cf JOIN best USING (doc_id, sent_no, tok_no))"""


# The same with a model of the English documents, tagging all others.
NB_UNSEEN = (
    NB_TAGGED.replace(
        f"lf AS ({long_features('cf', 'iob AS label')})",
        "cfen AS (SELECT cf.* FROM cf JOIN documents USING (doc_id) WHERE lang = 'en'),\n"
        "cfot AS (SELECT cf.* FROM cf JOIN documents USING (doc_id) WHERE lang <> 'en'),\n"
        f"lf AS ({long_features('cfen', 'iob AS label')})",
    )
    .replace("count(*) AS total FROM cf ", "count(*) AS total FROM cfen ")
    .replace(
        f"lft AS ({long_features('cf', 'doc_id, sent_no, tok_no')})",
        f"lft AS ({long_features('cfot', 'doc_id, sent_no, tok_no')})",
    )
)


def spelled_triples(filter_sql: str = "TRUE") -> str:
    return (
        "string_agg(subj || ' > ' || filler || ' > ' || obj, '|' ORDER BY chunk_no) "
        f"FILTER ({filter_sql})"
    )


def with_all_sentences(ctes: str, condition: str, n: str) -> str:
    return f"""WITH {ctes},
agg AS (
  SELECT doc_id, sent_no, count(*) FILTER ({condition}) AS n,
         {spelled_triples(condition)} AS t FROM rel GROUP BY ALL)
SELECT s.doc_id, s.sent_no, coalesce(n, 0) AS {n}, coalesce(t, '') AS triples
FROM sents s LEFT JOIN agg USING (doc_id, sent_no)"""


def phrases() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, sent_no, sentence, {i} AS rank, "
        f"unnest(list_distinct(regexp_extract_all(sentence, {quoted(p)}))) AS phrase, "
        f"'{tag}' AS tag FROM sents"
        for i, (p, tag) in enumerate(GAZETTEER_PATTERNS)
    )
    return f"{SENTS},\nphr AS ({found})"


# Spans that start at each word, shortest first; from a kept span the next one is
# the first that starts at its end or later.
WALK = """cand AS (SELECT doc_id, sent_no, a, z, tag FROM span WHERE r = 1),
nxt AS (
  SELECT c.*, min(d.a) AS next_a FROM cand c
  LEFT JOIN cand d ON d.doc_id = c.doc_id AND d.sent_no = c.sent_no AND d.a >= c.z
  GROUP BY ALL),
kept AS (
  SELECT nxt.* FROM nxt
  JOIN (SELECT doc_id, sent_no, min(a) AS a FROM cand GROUP BY ALL) USING (doc_id, sent_no, a)
  UNION ALL
  SELECT nxt.* FROM kept
  JOIN nxt ON nxt.doc_id = kept.doc_id AND nxt.sent_no = kept.sent_no AND nxt.a = kept.next_a),
tagg AS (
  SELECT t.doc_id, t.sent_no, t.tok_no, t.word,
         CASE WHEN k.a IS NULL THEN 'O' WHEN k.a = t.tok_no THEN 'B-' || k.tag
              ELSE 'I-' || k.tag END AS iob
  FROM tok t LEFT JOIN kept k
    ON k.doc_id = t.doc_id AND k.sent_no = t.sent_no AND t.tok_no >= k.a AND t.tok_no < k.z)"""

GAZETTEER = f"""{phrases()},
first_phr AS (
  SELECT doc_id, sent_no, phrase, arg_min(tag, rank) AS tag FROM phr GROUP BY ALL),
wl AS (
  SELECT doc_id, sent_no, regexp_extract_all(sentence, {WORDPUNCT}) AS w FROM sents),
tok AS (
  SELECT doc_id, sent_no, unnest(range(len(w))) AS tok_no, unnest(w) AS word, w FROM wl),
span AS (
  SELECT t.doc_id, t.sent_no, t.tok_no AS a, t.tok_no + k.n AS z, p.tag,
         row_number() OVER (PARTITION BY t.doc_id, t.sent_no, t.tok_no ORDER BY k.n) AS r
  FROM tok t, (SELECT unnest([1, 2]) AS n) k, first_phr p
  WHERE p.doc_id = t.doc_id AND p.sent_no = t.sent_no AND t.tok_no + k.n <= len(t.w)
    AND p.phrase = array_to_string(list_slice(t.w, t.tok_no + 1, t.tok_no + k.n), ' ')),
{WALK}"""

NAMES = f"""{SENTS},
wl AS (
  SELECT doc_id, sent_no, regexp_extract_all(sentence, {WORDPUNCT}) AS w FROM sents),
tok AS (
  SELECT doc_id, sent_no, unnest(range(len(w))) AS tok_no, unnest(w) AS word, w FROM wl),
listed AS (
  SELECT array_to_string(w[1:2], ' ') AS phrase, least(len(w), 2) AS n, 'TWO' AS tag FROM wl WHERE len(w) > 0
  UNION ALL
  SELECT array_to_string(w[1:3], ' '), least(len(w), 3), 'WIDE' FROM wl WHERE len(w) > 0),
name AS (SELECT phrase, n, min(tag) AS tag FROM listed GROUP BY ALL),
gram AS (
  SELECT doc_id, sent_no, tok_no, k.n, array_to_string(w[tok_no + 1:tok_no + k.n], ' ') AS phrase
  FROM tok, (SELECT unnest([1, 2, 3]) AS n) k WHERE tok_no + k.n <= len(w)),
hit AS (
  SELECT doc_id, sent_no, tok_no, n, phrase, tag FROM gram JOIN name USING (phrase, n)),
span AS (
  SELECT doc_id, sent_no, tok_no AS a, tok_no + n AS z, tag,
         row_number() OVER (PARTITION BY doc_id, sent_no, tok_no ORDER BY n) AS r FROM hit)"""


NAMED = f"""{TOKENS},
tagi AS (
  SELECT *, CASE WHEN NOT regexp_matches(word, '^\\p{{Lu}}') THEN 'O'
                 WHEN regexp_matches(lag(word) OVER ({SENT_ORDER}), '^\\p{{Lu}}') THEN 'I-NE'
                 ELSE 'B-NE' END AS iob
  FROM tagd)"""

ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ARTICLE = f"""'<article><front><journal-meta><journal-id journal-id-type="nlm-ta">' || source
  || '</journal-id></journal-meta><article-meta><article-id pub-id-type="doi">' || doc_id
  || '</article-id><article-id pub-id-type="pmcid">PMC' || doc_id
  || '</article-id><title-group><article-title>On <italic>' || lang
  || '</italic> prose</article-title></title-group><kwd-group><kwd>' || lang
  || '</kwd><kwd>' || source || '</kwd></kwd-group><abstract><p>Abstract of ' || source
  || '</p></abstract></article-meta></front><body><p>'
  || replace({ESCAPED.format("text")}, chr(10), '</p><p>') || '</p></body></article>'"""

FULLTEXT = "replace(text, chr(10), ' ')"

PART_ENTRIES = """entries AS (
  SELECT p_name AS entity, p_name || ', ' || upper(p_brand) || ',' || p_type AS aliases FROM part
  UNION ALL SELECT p_type, p_name FROM part
  UNION ALL SELECT p_name || ' ' || p_type, p_name FROM part)"""

WORKFLOW = f"""WITH {chunked(NB_TAGGED, "tagn")},
uniq AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(text)),
usents AS (SELECT sents.* FROM sents JOIN uniq USING (doc_id)),
ufilt AS (
  SELECT *, list_filter({WORDS}, lambda w: w NOT IN {STOP}) AS f FROM usents),
uocc AS (
  SELECT doc_id, sent_no, unnest(list_concat(f,
    list_transform(range(1, len(f)), lambda i: f[i] || ' ' || f[i + 1]))) AS term FROM ufilt),
ucnt AS (SELECT doc_id, sent_no, term, count(*) AS n FROM uocc GROUP BY ALL),
{TAXA},
uhit AS (
  SELECT doc_id, sent_no, count(*) AS entity_counts,
         string_agg(term || '=' || n, '|' ORDER BY term) AS entity_matches
  FROM ucnt
  WHERE term IN (SELECT term FROM alias)
    AND term IN (SELECT term FROM ucnt GROUP BY term HAVING count(*) >= 3)
  GROUP BY ALL),
utri AS (
  SELECT doc_id, sent_no, count(*) AS triples_counts, {spelled_triples()} AS triples
  FROM rel WHERE regexp_matches(filler, {PATTERN}) GROUP BY ALL)
"""

# Words with a period, scored as abbreviations.
SCORED = r"""
dotted AS (SELECT lower(unnest(regexp_extract_all(text, '\p{L}+(?:\.\p{L}+)*\.?'))) AS t FROM documents),
periods AS (
  SELECT rtrim(t, '.') AS word, count(*) FILTER (ends_with(t, '.')) AS n_period,
         count(*) FILTER (NOT ends_with(t, '.')) AS n_plain
  FROM dotted GROUP BY ALL),
share AS (SELECT sum(n_period) / sum(n_period + n_plain) AS p FROM periods),
measured AS (
  SELECT *, length(replace(word, '.', '')) AS letters,
         -2 * ((n_period * ln(p) + n_plain * ln(1 - p)) - (n_period * ln(0.99) + n_plain * ln(0.01))) AS ratio
  FROM periods, share WHERE n_period > 0),
scored AS (
  SELECT word, n_period, n_plain,
         ratio / exp(letters) * (length(word) - letters + 1) / pow(letters, n_plain) AS score
  FROM measured)"""
LEARNED_MARK = (
    rf"(SELECT '(^|[^\p{{L}}\p{{N}}_])((?:{KNOWN}|(?i:' || "
    rf"coalesce(string_agg(replace(word, '.', '\.'), '|'), 'Dr') || ')|\p{{Lu}})\.)({BLANK})' "
    "FROM scored WHERE score >= 0.3)"
)

# A sentence's first word is a name only if it is capitalised elsewhere.
CASING = f"""{TOKENS},
begun AS (
  SELECT *, min(tok_no) FILTER (regexp_matches(word, '\\p{{L}}')) OVER (PARTITION BY doc_id, sent_no) AS first
  FROM tagd),
cased AS (
  SELECT lower(word) AS word, CAST(sum(CASE WHEN regexp_matches(word, '^\\p{{Lu}}') THEN 1 ELSE 0 END) AS BIGINT)
           AS n_capital,
         CAST(sum(CASE WHEN regexp_matches(word, '^\\p{{Ll}}') THEN 1 ELSE 0 END) AS BIGINT) AS n_small
  FROM begun WHERE tok_no > first AND regexp_matches(word, '^[\\p{{Lu}}\\p{{Ll}}]') GROUP BY ALL)"""
NAMED_CASED = f"""{CASING},
isname AS (
  SELECT *, regexp_matches(word, '^\\p{{Lu}}') AND (tok_no <> first OR lower(word) IN (
    SELECT word FROM cased WHERE n_capital > n_small)) AS name FROM begun),
tagi AS (
  SELECT *, CASE WHEN NOT name THEN 'O' WHEN lag(name) OVER ({SENT_ORDER}) THEN 'I-NE'
                 ELSE 'B-NE' END AS iob
  FROM isname)"""

BATCHES = f"""SELECT CAST(doc_id AS VARCHAR) AS doi, {FULLTEXT} AS fulltext,
  CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS BIGINT) AS batch FROM documents"""

ORACLES: dict[str, str] = {
    "split_sentences": f"""WITH {SENTS}
SELECT doc_id, len(l) AS n_sentences, array_to_string(l, '|') AS sentences FROM lists""",
    "abbreviations": f"WITH {SCORED} SELECT word, n_period, n_plain, round(score, 6) + 0.0 AS score FROM scored",
    "split_sentences_learned": f"""WITH {SCORED},
lists AS (SELECT doc_id, {sentence_list("text", LEARNED_MARK)} AS l FROM documents)
SELECT doc_id, len(l) AS n_sentences, array_to_string(l, '|') AS sentences FROM lists""",
    "explode_sentences": f"WITH {SENTS} SELECT * FROM sents",
    "concat_arrays": f"""WITH {SENTS}
SELECT doc_id, array_to_string(list_concat(
  CASE WHEN lang <> 'en' THEN [lang, source] ELSE [] END, [source], l), '|') AS all_items
FROM documents JOIN lists USING (doc_id)""",
    "tokenize_ws": f"""WITH {SENTS}
SELECT doc_id, sent_no, len({WORDS}) AS n_words, array_to_string({WORDS}, '|') AS words FROM sents""",
    "tokenize_wordpunct": f"""WITH {SENTS}
SELECT doc_id, sent_no, array_to_string(list_filter(
  regexp_extract_all(sentence, {WORDPUNCT}), lambda w: lower(w) NOT IN {STOP}), '|') AS words
FROM sents""",
    "remove_stopwords": f"""WITH {FEATS}
SELECT doc_id, sent_no, array_to_string(f, '|') AS filtered FROM feats""",
    "ngrams": f"""WITH {FEATS}
SELECT doc_id, sent_no, array_to_string(b, '|') AS bigrams,
  array_to_string(list_transform(range(1, len(f) - 1),
    lambda i: f[i] || ' ' || f[i + 1] || ' ' || f[i + 2]), '|') AS trigrams
FROM feats""",
    "raw_features": f"""WITH {FEATS}
SELECT doc_id, sent_no, array_to_string(list_concat(f, b), '|') AS raw_features FROM feats""",
    "vocabulary": f"""WITH {FEATS}
SELECT term, df, tf, row_number() OVER (ORDER BY tf DESC, term) - 1 AS idx FROM voc""",
    "vocabulary_capped": f"WITH {FEATS} SELECT term, df, tf FROM voc ORDER BY tf DESC, term LIMIT 1000",
    "term_counts": f"""WITH {FEATS}
SELECT doc_id, sent_no, term, n FROM cnt WHERE n >= 3 AND term IN (SELECT term FROM voc)""",
    "feature_stages": f"""WITH {FEATS}
SELECT doc_id, sent_no, len({WORDS}) AS n_words, len(f) AS n_filtered, len(b) AS n_bigrams,
  array_to_string(list_sort(list_distinct(list_concat(f, b))), '|') AS features FROM feats""",
    "scan_dictionary": f"WITH {PART_ENTRIES} SELECT entity, aliases FROM entries",
    "dictionary_build": f"""WITH {PART_ENTRIES},
two AS (SELECT entity, string_split(aliases, ',') AS a FROM entries
        WHERE len(string_split(entity, ' ')) = 2),
al AS (SELECT entity, unnest(a) AS alias FROM two
  UNION ALL SELECT entity, string_split(trim(a[1]), ' ')[2] FROM two
  WHERE len(string_split(trim(a[1]), ' ')) = 2)
SELECT DISTINCT entity, lower(trim(alias)) AS alias FROM al WHERE trim(alias) <> ''""",
    "dictionary_vocab": f"""WITH {FEATS}, {TAXA}
SELECT term, df, tf FROM voc WHERE term IN (SELECT term FROM alias)""",
    "entity_hits": f"WITH {matched(3)} SELECT DISTINCT doc_id, sent_no FROM hit",
    "entity_matches": f"""WITH {matched(3)}
SELECT doc_id, sent_no, any_value(sentence) AS sentence,
  string_agg(term || '=' || n, '|' ORDER BY term) AS entity_matches
FROM hit JOIN sents USING (doc_id, sent_no) GROUP BY ALL""",
    "entity_counts": f"""WITH {matched(1)}
SELECT doc_id, sent_no, count(*) AS entity_counts, CAST(sum(n) AS BIGINT) AS n_terms
FROM hit GROUP BY ALL""",
    "entity_taxa": f"""WITH {matched(3)}
SELECT doc_id, sent_no, term AS alias, n, entity FROM hit JOIN alias USING (term)""",
    "select_columns": "SELECT doc_id, lang, source FROM documents",
    "dedup_by_key": """
SELECT doc_id, md5(text) AS text_md5, lang FROM documents
WHERE length(text) <= 100 OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY md5(text))""",
    "sample_hash": """
SELECT doc_id, source FROM documents
WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < 0.1 * 4294967296""",
    "sample_hash_small": """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT)
      < 0.0005 * 4294967296""",
    "threshold_filter": f"""WITH {matched(1)}
SELECT doc_id, sent_no, count(*) AS entity_counts FROM hit GROUP BY ALL HAVING count(*) >= 2""",
    "stage_counts": f"""WITH {matched(3)}
SELECT 'papers' AS stage, count(*) AS n FROM documents
UNION ALL SELECT 'sentences', count(*) FROM sents
UNION ALL SELECT 'entity terms', count(DISTINCT term) FROM alias
UNION ALL SELECT 'vocabulary', count(*) FROM voc
UNION ALL SELECT 'entity matches', count(*) FROM voc WHERE term IN (SELECT term FROM alias)
UNION ALL SELECT 'sentences with matches', count(*)
  FROM (SELECT DISTINCT doc_id, sent_no FROM hit)""",
    "scan_json": """
SELECT CAST(doc_id AS VARCHAR) AS doi, source || '|' || lang AS keywords, text AS fulltext
FROM documents""",
    "sink_json": "SELECT CAST(doc_id AS VARCHAR) AS doi, text AS fulltext FROM documents",
    "scan_xml": f"SELECT CAST(doc_id AS VARCHAR) AS doi, md5({ARTICLE}) AS xml_md5 FROM documents",
    "scan_xml_single": """
SELECT CAST(page_id AS VARCHAR) AS doi, url || ' ' || html AS fulltext FROM pages""",
    "extract_metadata": """
SELECT doc_id, CAST(doc_id AS VARCHAR) AS doi, 'PMC' || doc_id AS pmcid, source AS nlm_ta,
  'On ' || lang || ' prose' AS article_title, lang || '|' || source AS keywords,
  '' AS keywordlist, '' AS volume
FROM documents""",
    "field_coverage": f"""WITH fields AS (SELECT unnest([{", ".join(quoted(f) for f in JATS_PATHS)}]) AS field),
counted AS (
  SELECT field, (SELECT count(*) FROM documents) AS n,
         CASE WHEN field IN ('nlm-ta', 'doi', 'pmcid', 'article-title') THEN 1
              WHEN field = 'keywords' THEN 2 ELSE 0 END AS k
  FROM fields)
SELECT field, CASE WHEN k > 0 THEN n ELSE 0 END AS filled, CASE WHEN k > 0 THEN 0 ELSE n END AS empty,
  n * k AS n_values
FROM counted""",
    "extract_metadata_leading": "SELECT doc_id, 'On ' AS title FROM documents",
    "extract_texts": f"""
SELECT doc_id, len(string_split(text, chr(10))) AS n_paragraphs, {FULLTEXT} AS fulltext,
  'Abstract of ' || source AS abstract FROM documents""",
    "assemble_record": f"""
SELECT CAST(doc_id AS VARCHAR) AS doi, 'PMC' || doc_id AS cproject_id, CAST(0 AS BIGINT) AS n_ack,
  length({FULLTEXT}) AS n_chars, 'Abstract of ' || source AS abstract FROM documents""",
    "xml_rejects": "SELECT 'page ' || page_id AS origin, TRUE AS has_reason FROM pages",
    "manifest_pending": """
SELECT 'PMC' || doc_id || '.xml.gz' AS name FROM documents
WHERE lang <> 'de' AND doc_id NOT IN (SELECT doc_id FROM labels)""",
    "ingest_articles": f"""
SELECT CAST(doc_id AS VARCHAR) AS doi, 'PMC' || doc_id AS cproject_id, {FULLTEXT} AS fulltext,
  'Abstract of ' || source AS abstract FROM documents""",
    "ingest_stream": f"SELECT CAST(doc_id AS VARCHAR) AS doi, {FULLTEXT} AS fulltext FROM documents",
    "ingest_pending": BATCHES,
    "ingest_batches": BATCHES,
    "pos_lexicon": f"WITH {GOLD} SELECT lw AS word, lpos AS pos, n FROM lex",
    "pos_tag": f"""WITH {GOLD}
SELECT doc_id, sent_no, string_agg(word || '/' || coalesce(lpos, form), '|' ORDER BY tok_no) AS tagged
FROM gold LEFT JOIN lex ON lower(word) = lw AND n >= 3 GROUP BY ALL""",
    "pos_tag_path": f"""WITH RECURSIVE {PATHS}
SELECT doc_id, sent_no, string_agg(word || '/' || tag, '|' ORDER BY tok_no) AS tagged
FROM gold JOIN best USING (id) GROUP BY ALL""",
    "pos_tag_counts": f"""WITH {GOLD}
SELECT 'next' AS feature, prev AS value, pos, count(*) AS n FROM follow GROUP BY ALL
UNION ALL SELECT 'word', lower(word), pos, count(*) FROM gold GROUP BY ALL
UNION ALL SELECT 'form', form, pos, count(*) FROM gold GROUP BY ALL""",
    "chunk_features": f"""WITH {FEATURES}
SELECT doc_id, sent_no, tok_no, pos, word, prevpos, nextpos, prevpos_pos, pos_nextpos,
  tags_since_dt FROM cf""",
    "nb_train": f"""WITH {MODEL}
SELECT fname, fval, label, n, round(ln((n + 0.5) / (total + 0.5 * bins)), 6) AS logp
FROM nbc JOIN nbl USING (label) JOIN nbb USING (fname)
UNION ALL SELECT '', '', label, total, round(logp, 6) FROM prior""",
    "scan_tagged": f"""WITH {TAGGED},
whole AS (
  SELECT string_agg(word, '|' ORDER BY tok_no) AS words, string_agg(pos, '|' ORDER BY tok_no) AS tags,
         string_agg(iob, '|' ORDER BY tok_no) AS iob
  FROM tagi GROUP BY doc_id, sent_no)
SELECT words, tags, iob, count(*) AS n FROM whole GROUP BY ALL""",
    "nb_tag": f"""WITH {NB_TAGGED}
SELECT doc_id, sent_no, string_agg(iob, '|' ORDER BY tok_no) AS iob FROM tagn GROUP BY ALL""",
    "nb_tag_unseen": f"""WITH {NB_UNSEEN}
SELECT doc_id, sent_no, string_agg(iob, '|' ORDER BY tok_no) AS iob FROM tagn GROUP BY ALL""",
    "chunk_iob": f"WITH {chunked()} SELECT doc_id, sent_no, chunk_no, label, text, gap_after FROM chunk",
    "relations": f"WITH {chunked()} SELECT doc_id, sent_no, chunk_no, subj, filler, obj FROM rel",
    "filler_pattern": f"""WITH {chunked()}
SELECT doc_id, sent_no, subj, filler, obj FROM rel WHERE regexp_matches(filler, {PATTERN})""",
    "triples": with_all_sentences(
        chunked(), f"regexp_matches(filler, {PATTERN})", "triples_counts"
    ),
    "triples_all": with_all_sentences(chunked(NAMED), "TRUE", "n"),
    "casing": f"WITH {CASING} SELECT word, n_capital, n_small FROM cased",
    "triples_cased": with_all_sentences(chunked(NAMED_CASED), "TRUE", "n"),
    "gazetteer_phrases": f"WITH {phrases()} SELECT doc_id, sent_no, phrase, tag FROM phr",
    "gazetteer_iob": f"""WITH RECURSIVE {GAZETTEER}
SELECT doc_id, sent_no, string_agg(iob, '|' ORDER BY tok_no) AS iob FROM tagg GROUP BY ALL""",
    "gazetteer_names": f"""WITH {NAMES}
SELECT doc_id, sent_no, tok_no AS at, CAST(n AS BIGINT) AS n, phrase, tag FROM hit""",
    "gazetteer_names_iob": f"""WITH RECURSIVE {NAMES}, {WALK}
SELECT doc_id, sent_no, string_agg(iob, '|' ORDER BY tok_no) AS iob FROM tagg GROUP BY ALL""",
    "triples_gazetteer": with_all_sentences(
        chunked(f"{GAZETTEER},\ntagp AS (SELECT *, {POS_CASE} AS pos FROM tagg)", "tagp"), "TRUE", "n"
    ).replace("WITH", "WITH RECURSIVE", 1),
    "interaction_workflow": f"""{WORKFLOW}SELECT doc_id, sent_no, CAST(doc_id AS VARCHAR) AS doi, sentence AS sentences, entity_matches,
  entity_counts, triples, triples_counts
FROM uhit JOIN utri USING (doc_id, sent_no) JOIN usents USING (doc_id, sent_no)""",
    "workflow_counts": f"""{WORKFLOW}
SELECT 'articles' AS stage, count(*) AS n FROM uniq
UNION ALL SELECT 'sentences', count(*) FROM usents
UNION ALL SELECT 'sentences with matches', count(*) FROM uhit
UNION ALL SELECT 'sentences with enough entities', count(*) FROM uhit WHERE entity_counts >= 1
UNION ALL SELECT 'interactions', count(*) FROM uhit JOIN utri USING (doc_id, sent_no)""",
}
ORACLES["nb_train_tagged"] = ORACLES["nb_train"]
