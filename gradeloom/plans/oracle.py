"""SQL, for DuckDB, of the catalogue's queries: written on its own, to check the DataFrame operators against."""

from __future__ import annotations

from gradeloom.functions.labels import NUMBER_WORDS, ROMAN
from gradeloom.functions.marks import CRITERIA, GRADES, INSTRUCTION_VERBS, TYPE_PATTERNS
from gradeloom.functions.text import STOPWORDS
from gradeloom.operators.assess import PASS_PERCENTAGE
from gradeloom.operators.choice import ALL_COMPULSORY, ANY_COUNT, ANY_RULE, OF_COUNT

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_CASE_STEM = """CASE
 WHEN length(w) > 4 AND ends_with(w, 'ies') THEN left(w, length(w) - 3) || 'y'
 WHEN length(w) > 4 AND ends_with(w, 'sses') THEN left(w, length(w) - 2)
 WHEN length(w) > 3 AND ends_with(w, 'es') AND NOT regexp_matches(w, '[aeiou]es$') THEN left(w, length(w) - 2)
 WHEN length(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1)
 WHEN length(w) > 5 AND ends_with(w, 'ing') THEN left(w, length(w) - 3)
 WHEN length(w) > 5 AND ends_with(w, 'ed') THEN left(w, length(w) - 2)
 ELSE w END"""


def norm(c: str) -> str:
    return f"trim(lower(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9]+', ' ', 'g')))"


def stems(c: str) -> str:
    return f"list_transform(list_filter(string_split({norm(c)}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})), lambda w: {_CASE_STEM})"


_SPACE = r"[\s\v\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


_ASKED = "asked AS (SELECT q_text AS query, min(exam_id * 1000 + CAST(substr(question_id, 2, 9) AS INT)) AS query_id FROM exam_questions WHERE q_text IS NOT NULL GROUP BY q_text)"
_PASSAGES = "passages AS (SELECT chunk_key AS chunk_id, text FROM reference_chunks WHERE text IS NOT NULL)"
_BM25 = f"""{_ASKED}, {_PASSAGES},
lengths AS (SELECT chunk_id, len({stems('text')}) AS n FROM passages),
tf AS (SELECT chunk_id, term, count(*) AS f FROM (SELECT chunk_id, unnest({stems('text')}) AS term FROM passages) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
stats AS (SELECT count(*) AS n_chunks, avg(n) AS mean FROM lengths),
ordered AS (SELECT query_id, {stems('query')} AS ts FROM asked),
qt AS (SELECT query_id, unnest(list_distinct(ts)) AS term, ts FROM ordered),
qo AS (SELECT query_id, term, list_position(ts, term) AS place FROM qt),
scores AS (SELECT query_id, chunk_id, min(place) AS place,
  sum(ln(1 + (n_chunks - d + 0.5::DOUBLE) / (d + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS score
  FROM qo JOIN tf USING (term) JOIN df USING (term) JOIN lengths USING (chunk_id), stats GROUP BY query_id, chunk_id),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place, chunk_id) AS rk FROM scores QUALIFY rk <= 3)"""
_TOP = "SELECT query_id, rk, chunk_id, round(score, 6) AS score FROM top"

_LINES = "lines AS (SELECT DISTINCT ON (line_uid) * FROM ocr_lines)"
_BLOCKS = "blocks AS (SELECT DISTINCT ON (block_id) * FROM parsed_questions)"
_WANTED = "wanted AS (SELECT DISTINCT block_id AS answer_id, paper_id, unnest(answer_line_ids) AS line_id FROM blocks)"
_QUESTIONS = "questions AS (SELECT exam_id, question_id, CAST(substr(question_id, 2, 9) AS INT) AS ord, q_number AS number, q_text AS text, max_marks FROM exam_questions)"
_ILLEGIBLE = r"\[(illegible|unclear|unreadable|\?+)\]|\?\?+|(^|[^A-Za-z0-9_])x{3,}([^A-Za-z0-9_]|$)|_{3,}"


def confidence(c: str) -> str:
    t = trimmed(c)
    return rf"""CASE WHEN length({t}) = 0 THEN 0.0 ELSE greatest(0.05, least(1.0, 0.95::DOUBLE
 - CASE WHEN regexp_matches({t}, '{_ILLEGIBLE}', 'i') THEN 0.45::DOUBLE ELSE 0 END
 - CASE WHEN length(regexp_replace({t}, '[^A-Za-z0-9]', '', 'g')) * 2 < length({t}) THEN 0.25::DOUBLE ELSE 0 END
 - CASE WHEN length({t}) < 4 THEN 0.15::DOUBLE ELSE 0 END
 - CASE WHEN regexp_matches({t}, '[bcdfghjklmnpqrstvwxz]{{6,}}', 'i') THEN 0.15::DOUBLE ELSE 0 END)) END"""


def kind(t: str, m: str) -> str:
    rules = " ".join(f"WHEN regexp_matches(coalesce({t}, ''), '{p}', 'i') THEN '{k}'" for k, p in TYPE_PATTERNS)
    return f"CASE {rules} WHEN coalesce({m}, 0) <= 2 THEN 'definition' WHEN {m} <= 5 THEN 'explain' WHEN {m} <= 10 THEN 'long_answer' ELSE 'essay' END"


_MARKS_RE = r"[\[(]\s*(\d{1,3})\s*(?:marks?|m)?\s*[\])]|\b(\d{1,3})\s*marks?\b"


def printed(c: str) -> str:
    v = f"TRY_CAST(coalesce(nullif(regexp_extract(coalesce({c}, ''), '{_MARKS_RE}', 1, 'i'), ''), regexp_extract(coalesce({c}, ''), '{_MARKS_RE}', 2, 'i')) AS INT)"
    return f"CASE WHEN {v} BETWEEN 1 AND 200 THEN {v} END"


def short(a: str, m: str) -> str:
    return f"(length({norm(a)}) < CASE WHEN {m} IS NULL OR {m} <= 1 THEN 1 WHEN {m} <= 2 THEN 4 ELSE 10 END)"


_ROWS = """raw AS (SELECT l_orderkey AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS ord, * FROM lineitem),
rows_ AS (SELECT paper_id, 'q' || ord AS question_id, ord, CAST(ord AS VARCHAR) AS number, 40.0::DOUBLE AS max_marks,
  CASE WHEN l_tax <> 0.08::DOUBLE THEN l_quantity END AS marks_awarded, l_discount = 0 AS skipped, l_discount <> 0 AND l_tax = 0 AS failed,
  round(l_tax * 1000 + 25, 0) AS confidence, l_linestatus AS group_id FROM raw)"""
_CLAMPED = _ROWS + """,
clamped AS (SELECT * REPLACE (greatest(0.0, least(max_marks, coalesce(marks_awarded, 0.0))) AS marks_awarded) FROM rows_)"""


def ranked(source: str, prefer: str = "best") -> str:
    best = "CASE WHEN NOT skipped THEN coalesce(marks_awarded, 0.0) END DESC NULLS LAST, CASE WHEN NOT skipped THEN failed::INT END DESC NULLS LAST, CASE WHEN NOT skipped THEN max_marks END DESC NULLS LAST," if prefer == "best" else ""
    return f"""ranked AS (SELECT *, CAST(rank AS BIGINT) <= 2 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, group_id ORDER BY skipped::INT, {best} ord) AS rank,
 count(*) OVER (PARTITION BY paper_id, group_id) AS n FROM {source}) WHERE n > 2)"""


def counted(source: str) -> str:
    return f"{ranked(source)}, counted AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM ranked r WHERE r.paper_id = s.paper_id AND r.question_id = s.question_id AND NOT r.kept) AS counted FROM {source} s)"


_GRADE = "CASE " + " ".join(f"WHEN percentage >= {p} THEN '{g}'" for p, g in GRADES) + " ELSE 'F' END"
_TOTALS = f"""{_CLAMPED}, {counted('clamped')},
sums AS (SELECT paper_id, sum(CASE WHEN counted THEN marks_awarded ELSE 0 END) AS total_marks, sum(CASE WHEN counted THEN max_marks ELSE 0 END) AS maximum_marks, sum(max_marks) AS printed_marks,
  CAST(coalesce(floor(avg(CASE WHEN counted AND NOT skipped AND NOT failed THEN confidence END) + 0.5), 0) AS BIGINT) AS overall_confidence FROM counted GROUP BY paper_id),
totals AS (SELECT *, CASE WHEN maximum_marks > 0 THEN total_marks / maximum_marks * 100 ELSE 0.0 END AS percentage FROM sums)"""
_FREE = f"{_LINES}, {_BLOCKS}, {_WANTED}, free AS (SELECT * FROM lines l WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.paper_id = l.paper_id AND w.line_id = l.line_id))"
_WRITING = f"""{_FREE}, lengths_ AS (SELECT paper_id, length({norm('text')}) AS n FROM free),
writing AS (SELECT paper_id, count(*) AS n_lines, CAST(greatest(sum(CASE WHEN n > 0 THEN n + 1 ELSE 0 END) - 1, 0) AS BIGINT) AS n_chars FROM lengths_ GROUP BY paper_id)"""
_STATUS = f"""{_WRITING}, b AS (SELECT k.*, coalesce(n_chars >= 40, false) AS found, (block_id * 37) % 101 AS confidence, block_id % 97 = 0 AS failed, {short('answer_text', 'max_marks')} AS skipped FROM blocks k LEFT JOIN writing USING (paper_id)),
status AS (SELECT paper_id, block_id, failed, skipped, confidence, block_id % 5 <> 0 AS counted,
  CASE WHEN failed THEN 'evaluation_failed' WHEN blank AND found THEN 'not_detected' WHEN blank THEN 'unanswered' WHEN confidence < 60 THEN 'uncertain' ELSE 'detected' END AS status
  FROM (SELECT *, skipped OR {trimmed("coalesce(answer_text, '')")} = '' AS blank FROM b))"""
_NOTES = """notes AS (SELECT paper_id AS question_key, ord AS ann_ord, (['correct', 'partial', 'wrong', 'missing'])[ord % 4 + 1] AS type, CASE WHEN skipped THEN marks_awarded END AS marks, 30.0::DOUBLE AS awarded,
  CASE WHEN NOT failed THEN confidence END AS confidence FROM rows_)"""
_CITED = f"{_BM25}, evidence AS MATERIALIZED ({_TOP}), cited AS (SELECT query_id AS question_key, rk AS ann_ord, CASE WHEN query_id % 3 = 0 THEN chunk_id || '?' ELSE chunk_id END AS evidence_id FROM evidence WHERE rk <= 2), checked AS (SELECT question_key, evidence_id, ann_ord, e.chunk_id AS cited_id FROM cited c LEFT JOIN evidence e ON e.query_id = question_key AND e.chunk_id = evidence_id)"
_HISTORY = "history AS (SELECT o_custkey AS student_id, o_orderkey AS paper_id, o_orderdate AS taken_at, round(o_totalprice % 100, 4) AS percentage FROM orders)"
_BANDS = """bands AS (SELECT paper_id AS doc_id, page, bbox.y AS top, bbox.y + bbox.height AS bottom, bbox.x AS left_, bbox.x + bbox.width AS right_ FROM lines WHERE bbox IS NOT NULL),
ln AS (SELECT paper_id AS doc_id, page, line_id, row_number() OVER (PARTITION BY paper_id, page ORDER BY line_index) - 1 AS i, count(*) OVER (PARTITION BY paper_id, page) AS n_lines FROM lines),
bn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY top, bottom, left_, right_) - 1 AS place, count(*) OVER (PARTITION BY doc_id, page) AS n_bands FROM bands),
bc AS (SELECT DISTINCT doc_id, page, n_bands FROM bn),
placed AS (SELECT ln.doc_id, ln.page, line_id, bn.top, bn.bottom, n_lines, bc.n_bands FROM ln LEFT JOIN bc USING (doc_id, page)
  LEFT JOIN bn ON bn.doc_id = ln.doc_id AND bn.page = ln.page AND bn.place = CASE WHEN bc.n_bands = n_lines THEN i ELSE least(bc.n_bands - 1, (i * bc.n_bands) // n_lines) END),
tiers AS (SELECT *, CASE WHEN n_bands IS NULL THEN 'none' WHEN n_bands = n_lines THEN 'high' WHEN abs(n_bands - n_lines) / greatest(n_bands, n_lines) <= 0.2::DOUBLE THEN 'medium' ELSE 'low' END AS tier FROM placed)"""
_BOX = "round(min(bbox.x), 6) AS x, round(min(bbox.y), 6) AS y, round(max(bbox.x + bbox.width) - min(bbox.x), 6) AS width, round(max(bbox.y + bbox.height) - min(bbox.y), 6) AS height"
_SPANS = f"{_LINES}, {_BLOCKS}, {_WANTED}, spans AS (SELECT answer_id, w.paper_id, min(start_char) AS a, max(end_char) AS b FROM wanted w JOIN lines l ON l.paper_id = w.paper_id AND l.line_id = w.line_id GROUP BY ALL)"
_RUNS = f"""{_LINES}, {_BLOCKS}, {_WANTED},
extent AS (SELECT answer_id, min(line_index) AS a, max(line_index) AS b FROM wanted w JOIN lines l ON l.paper_id = w.paper_id AND l.line_id = w.line_id GROUP BY answer_id),
q AS (SELECT paper_id, block_id AS ord, CAST(block_id AS VARCHAR) AS question_id, a, b, block_id % 3 <> 0 AS matched FROM blocks LEFT JOIN extent ON answer_id = block_id),
bounded AS (SELECT *, sum(matched::INT) OVER w AS run_id, last_value(CASE WHEN matched THEN b END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  first_value(CASE WHEN matched THEN a END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM q WINDOW w AS (PARTITION BY paper_id ORDER BY ord)),
runs AS (SELECT paper_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS n_questions, string_agg(question_id, ',' ORDER BY ord) AS question_ids, coalesce(max(lo), -1) AS after_index, max(hi) AS before_index FROM bounded WHERE NOT matched GROUP BY paper_id, run_id)"""
_COST = f"""{_BLOCKS}, cost AS (SELECT block_id, CAST(CASE WHEN block_id % 11 = 0 THEN 2000 ELSE ceil(length(question_text || chr(10) || answer_text) / 4) + CASE WHEN block_id % 2 = 0 THEN 600 ELSE 1000 END + 200 END AS BIGINT) AS cost
  FROM blocks WHERE question_text IS NOT NULL AND answer_text IS NOT NULL)"""
_V = "event_id % 500"

_COUNTS = " ".join(f"WHEN '{w}' THEN {n}" for w, n in NUMBER_WORDS.items())


def counted_word(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '^[0-9]{{1,2}}$') THEN nullif(CAST({w} AS INT), 0) ELSE CASE lower({w}) {_COUNTS} END END"


_RULED = f"""{_QUESTIONS}, ruled AS (SELECT DISTINCT exam_id AS doc_id, 0 AS line_index, (['Answer any THREE of the following five questions.', 'Attempt any 2 questions', 'All questions are compulsory.', 'Do any four, of the following 6'])[exam_id % 4 + 1] AS text FROM questions WHERE number IS NOT NULL
  UNION ALL SELECT exam_id, ord, number || '. ' || text FROM questions WHERE number IS NOT NULL)"""

_LEAD = "(?:q(?:ue?s(?:tion)?)?|ans(?:wer)?|sol(?:ution)?|part|sec(?:tion)?)"
_ROMAN_LIST = "[" + ", ".join(f"'{r}'" for r in ROMAN) + "]"


def levels(c: str) -> str:
    """The levels of a label as a list."""
    bare = rf"regexp_replace(lower({trimmed(f"coalesce({c}, '')")}), '^((?:{_LEAD}[\s.\-:)]+)*)(?:{_LEAD}([^a-z]|$))?', '\2')"
    runs = f"list_transform(regexp_extract_all({bare}, '[a-z0-9]+'), lambda w: coalesce(CASE w {_COUNTS_TEXT} END, w))"
    apart = f"flatten(list_transform({runs}, lambda w: CASE WHEN regexp_matches(w, '^[0-9]+[a-z]+$') THEN [regexp_extract(w, '^[0-9]+'), regexp_extract(w, '[a-z]+$')] ELSE [w] END))"
    return f"list_filter({apart}, lambda p: regexp_matches(p, '^[0-9]+$') OR list_contains({_ROMAN_LIST}, p) OR regexp_matches(p, '^[a-z]$'))"


_COUNTS_TEXT = " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in NUMBER_WORDS.items())


def key_of(l: str) -> str:  # noqa: E741
    return f"array_to_string(list_transform({l}, lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN regexp_replace(p, '^0+([0-9])', '\\1') WHEN list_contains({_ROMAN_LIST}, p) THEN 'r' || list_position({_ROMAN_LIST}, p) ELSE p END), '.')"


def shown_of(l: str) -> str:  # noqa: E741
    plain = f"list_transform({l}, lambda p: CASE WHEN regexp_matches(p, '^[0-9]+$') THEN regexp_replace(p, '^0+([0-9])', '\\1') ELSE p END)"
    return f"coalesce(({plain})[1], '') || array_to_string(list_transform(({plain})[2:], lambda x: '(' || x || ')'), '')"


_KEYED = f"""{_QUESTIONS}, keyed AS (SELECT exam_id, question_id, ord, number, text, max_marks, {key_of('l')} AS key, {shown_of('l')} AS shown FROM (SELECT *, {levels('number')} AS l FROM questions))"""
_OFFERED = f"""{_KEYED}, rules AS (SELECT exam_id, required, size FROM (SELECT DISTINCT exam_id, [3, 2, NULL, 4][exam_id % 4 + 1] AS required, [5, NULL, NULL, 6][exam_id % 4 + 1] AS size FROM questions WHERE number IS NOT NULL) WHERE required IS NOT NULL),
heads AS (SELECT exam_id, ord, shown, row_number() OVER (PARTITION BY exam_id ORDER BY ord) AS member_ord FROM keyed WHERE number IS NOT NULL AND text IS NOT NULL AND shown <> ''),
offered AS (SELECT * FROM (SELECT h.exam_id AS doc_id, 0 AS group_id, required, shown AS number, CAST(member_ord AS INT) AS member_ord, count(*) OVER (PARTITION BY h.exam_id) AS n FROM heads h JOIN rules r ON r.exam_id = h.exam_id WHERE size IS NULL OR member_ord <= size) WHERE n > required)"""
_DESCRIBED = f"""{_OFFERED}, described AS (SELECT doc_id, 'answer any ' || any_value(required) || ' of ' || count(*) || ' (' || string_agg('Q' || number, ', ' ORDER BY member_ord) || ')' AS description FROM offered GROUP BY doc_id)"""
_LABELLED = f"""{_TOTALS}, own AS (SELECT *, CASE WHEN failed THEN 'evaluation_failed' WHEN skipped AND ord % 2 = 0 THEN 'not_detected' WHEN skipped THEN 'unanswered' WHEN confidence < 60 THEN 'uncertain' ELSE 'detected' END AS status FROM counted),
labelled AS (SELECT *, CASE WHEN NOT counted THEN 'Not counted' WHEN status = 'evaluation_failed' THEN 'Eval. unavailable' WHEN status = 'not_detected' THEN 'Answer not detected' WHEN status = 'unanswered' THEN 'Unanswered' WHEN status = 'uncertain' THEN 'Verify'
  WHEN marks_awarded >= max_marks THEN 'Covered well' WHEN marks_awarded > 0 THEN 'Partial' ELSE 'Not covered' END AS report_label FROM own)"""


def plain(x: str) -> str:
    """A number without a point where it is whole."""
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def windows(rows: str, key: str, name: str, budget: int, most: int, tail: str) -> str:
    """Windows over rows (key, place, cost), each with its first place, first new place and last place."""
    return f"""sums AS (SELECT *, sum(cost) OVER (PARTITION BY {key} ORDER BY place) AS upto FROM {rows}),
 {name} AS (WITH RECURSIVE step AS (
   SELECT {key}, 0 AS k, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS f, max(b.place) AS e FROM sums b WHERE b.place = 0 OR (b.place < {most} AND b.upto <= {budget}) GROUP BY {key}
   UNION ALL
   SELECT w.{key}, w.k + 1, any_value({tail}), w.e + 1, max(b.place) FROM step w JOIN sums b ON b.{key} = w.{key} JOIN sums a ON a.{key} = w.{key} AND a.place = {tail}
   WHERE b.place = w.e + 1 OR (b.place > w.e + 1 AND b.place - w.e - 1 < {most} AND b.upto - a.upto + a.cost <= {budget}) GROUP BY w.{key}, w.k, w.s, w.e)
 SELECT * FROM step)"""


_VERDICT = "CASE WHEN maximum_marks > 0 AND total_marks / maximum_marks >= 0.4::DOUBLE THEN 'pass' WHEN maximum_marks > 0 AND pending > 0 AND (total_marks + pending) / maximum_marks >= 0.4::DOUBLE THEN 'pending' ELSE 'fail' END"
_BAND = "CASE WHEN percentage >= 75 THEN 'high' WHEN percentage >= 50 THEN 'good' WHEN percentage >= 35 THEN 'fair' ELSE 'low' END"

def sentences(table: str, key: str) -> str:
    """Sentences of the texts of a table, with their place and offsets. Full stops that end none stand aside as a private character."""
    stop, cut = "chr(57344)", "chr(57345)"
    digits = "'([0-9])\\.([0-9])', '\\1' || " + stop + " || '\\2', 'g'"
    guarded = f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), {digits}), {digits}), '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z])\\.(\\s?[a-z])', '\\1\\2' || {stop} || '\\3', 'g')"
    pieces = f"string_split(regexp_replace({guarded}, '([.!?\\n][ \\t\\r\\f\\v\\x{{A0}}\"'')\\]]*)', '\\1' || {cut}, 'g'), {cut})"
    return f"""cut AS (SELECT *, {pieces} AS l FROM {table}),
        each_ AS (SELECT * EXCLUDE (text, l), i, replace(l[i], {stop}, '.') AS piece, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM cut)),
        sentences AS (SELECT * EXCLUDE (piece, a, i), {trimmed('piece')} AS text, CAST(a AS INT) AS start, CAST(a + length(piece) AS INT) AS "end", row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS place FROM each_ WHERE regexp_matches(piece, '[A-Za-z0-9]'))"""


def passages(table: str, key: str, kept: str) -> str:
    """Passages of whole sentences, each opening with the last sentence of the one before, with ids made of source, place and hash."""
    words = f"len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> ''))"
    digits = "array_to_string(list_transform(range(6, -1, -1), lambda i: substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST((h // CAST(36 ** i AS BIGINT)) % 36 + 1 AS BIGINT), 1)), '')"
    return f"""RECURSIVE {sentences(table, key)}, sums AS (SELECT *, {words} AS n, sum({words}) OVER (PARTITION BY {key} ORDER BY place) AS upto FROM sentences),
        step AS (SELECT {key}, 1 AS k, CAST(0 AS BIGINT) AS s, coalesce(min(place) FILTER (upto >= 110), max(place)) AS e FROM sums GROUP BY {key}
          UNION ALL SELECT w.{key}, w.k + 1, w.e, coalesce(min(b.place) FILTER (b.upto - a.upto + a.n >= 110), max(b.place)) FROM step w JOIN sums a ON a.{key} = w.{key} AND a.place = w.e JOIN sums b ON b.{key} = w.{key} AND b.place > w.e GROUP BY w.{key}, w.k, w.e),
        joined AS (SELECT w.{key}, {kept}, w.k AS ord, string_agg(text, ' ' ORDER BY place) AS text FROM step w JOIN sums b ON b.{key} = w.{key} AND b.place BETWEEN w.s AND w.e GROUP BY ALL),
        hashed AS (SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda x, c: (x * 33 + c) % 4294967296) AS h FROM joined),
        cut_passages AS (SELECT *, coalesce(source, 'ref') || '#' || ord || '-' || ltrim({digits}, '0') AS chunk_id FROM hashed)"""


SQL: dict[str, str] = {
    "exam_label_keys": r"""WITH p AS (SELECT exam_id, question_id, regexp_extract_all(lower(coalesce(q_number, '')), '[0-9]+|[a-z]+') AS l FROM exam_questions),
        k AS (SELECT exam_id, question_id, list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') THEN CAST(CAST(x AS INT) AS VARCHAR) WHEN x IN ('i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x') THEN 'r' || list_position(['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x'], x) ELSE x END) AS k, l FROM p)
        SELECT exam_id, question_id, array_to_string(k, '.') AS key, coalesce(l[1], '') || array_to_string(list_transform(l[2:], lambda x: '(' || x || ')'), '') AS shown FROM k""",
    "attempt_rules": f"""WITH {_RULED}, h AS (SELECT *, regexp_extract(text, '{ANY_COUNT[4:]}', 0, 'i') AS hit, regexp_extract(text, '{ANY_COUNT[4:]}', 1, 'i') AS n FROM ruled WHERE regexp_matches(text, '{ANY_RULE[4:]}', 'i')),
        t AS (SELECT *, regexp_extract(substr(text, instr(text, hit) + length(hit)), '{OF_COUNT[4:]}', 1, 'i') AS m FROM h)
        SELECT doc_id, line_index, {counted_word('n')} AS required, {counted_word('m')} AS "of", trim(text) AS text FROM t WHERE {counted_word('n')} IS NOT NULL""",
    "all_compulsory": f"WITH {_RULED} SELECT doc_id, coalesce(bool_or(regexp_matches(text, '{ALL_COMPULSORY[4:]}', 'i')), false) AS all_compulsory FROM ruled GROUP BY doc_id",
    "stream_trace_windows": """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 4) AS sum_value FROM events GROUP BY ALL)
        SELECT * FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "bm25_topk": f"WITH {_BM25} {_TOP}",
    "retrieval_coverage": f"""WITH {_BM25}, held AS (SELECT DISTINCT query_id, unnest({stems('text')}) AS term FROM top JOIN passages USING (chunk_id))
        SELECT query_id, count(*) AS n_terms, count(h.term) AS n_hit, round(count(h.term) / count(*), 9) AS coverage, count(h.term) / count(*) < 0.45::DOUBLE AS weak
        FROM qo LEFT JOIN held h USING (query_id, term) GROUP BY query_id""",
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "tokenize_stem": f"SELECT doc_id, array_to_string({stems('text')}, ' ') AS stems FROM documents",
    "term_frequency": f"WITH {_PASSAGES} SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({stems('text')}) AS term FROM passages) GROUP BY ALL",
    "document_frequency": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({stems('text')}) AS term FROM documents) GROUP BY term",
    "token_overlap": f"""WITH {_BLOCKS}, s AS (SELECT block_id, list_distinct({stems('question_text')}) AS a, list_distinct({stems('answer_text')}) AS b FROM blocks)
        SELECT block_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 9) END AS overlap FROM s""",
    "djb2_hash": f"WITH {_ASKED} SELECT query_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(query, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: (h * 33 + c) % 4294967296) AS hash FROM asked",
    "word_count": rf"SELECT doc_id, CAST(CASE WHEN {trimmed("coalesce(text, '')")} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed("coalesce(text, '')")}, '{_SPACE}+')) END AS INT) AS n_words FROM documents",
    "prefix_candidates": f"""WITH {_ASKED}, n AS (SELECT query_id, {norm('query')} AS t, string_split({norm('query')}, ' ') AS w FROM asked),
        c AS (SELECT query_id, list_prepend(t, list_filter(list_transform(range(len(w) - 1, CAST(greatest(3, ceil(len(w) * 0.4::DOUBLE)) AS BIGINT) - 1, -1), lambda k: array_to_string(w[1:k], ' ')), lambda p: length(p) >= 10)) AS l FROM n)
        SELECT query_id, CAST(i - 1 AS INT) AS place, l[i] AS candidate FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM c)""",
    "span_exact": f"""WITH {_BLOCKS} SELECT block_id, CAST(instr(answer_text, question_text) - 1 AS INT) AS start, CAST(instr(answer_text, question_text) - 1 + length(question_text) AS INT) AS "end"
        FROM blocks WHERE question_text <> '' AND instr(answer_text, question_text) > 0""",
    "extract_marks": f"WITH {_BLOCKS} SELECT block_id, {printed('question_text')} AS marks FROM blocks",
    "strip_marks": rf"WITH {_BLOCKS} SELECT block_id, {trimmed(rf"regexp_replace(regexp_replace(coalesce(question_text, ''), '{_MARKS_RE}', '', 'i'), '\s{{2,}}', ' ', 'g')")} AS stripped FROM blocks",
    "question_type": f"WITH {_QUESTIONS} SELECT exam_id, question_id, {kind('text', 'max_marks')} AS type FROM questions",
    "marks_fallback_type": f"SELECT p_partkey, {kind('p_name', 'p_size')} AS type FROM part",
    "question_criteria": f"""WITH {_QUESTIONS}, t AS (SELECT {kind('text', 'max_marks')} AS type, count(*) AS n FROM questions GROUP BY 1),
        c(type, n_criteria, criteria) AS (VALUES {', '.join(f"('{k}', {len(v)}::INT, '{"; ".join(v)}')" for k, v in CRITERIA.items())}) SELECT type, n, n_criteria, criteria FROM t JOIN c USING (type)""",
    "question_shape": f"""WITH {_BLOCKS}, t AS (SELECT *, {trimmed("coalesce(question_text, '')")} AS q FROM blocks)
        SELECT block_id, length(q) >= 8 AND (ends_with(q, '?') OR regexp_matches(q, '^({'|'.join(INSTRUCTION_VERBS)})\\b', 'i')) AS asks, {short('answer_text', 'max_marks')} AS too_short FROM t""",
    "json_number_coerce": r"SELECT event_id, TRY_CAST(regexp_replace(props, '[^\d.+-]', '', 'g') AS DOUBLE) AS strict, CASE WHEN regexp_replace(event_type, '[^\d.+-]', '', 'g') = '' THEN 0.0 ELSE TRY_CAST(regexp_replace(event_type, '[^\d.+-]', '', 'g') AS DOUBLE) END AS loose FROM events",
    "structure_lines": rf"""WITH {_LINES}, pages AS (SELECT paper_id AS doc_id, page, {trimmed("replace(replace(string_agg(text, chr(10) ORDER BY line_index), chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS raw FROM lines GROUP BY ALL),
        based AS (SELECT *, coalesce(sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM pages),
        pieces AS (SELECT doc_id, page, base, l[i] AS piece, i, coalesce(list_sum(list_transform(l[1:i - 1], lambda p: length(p) + 1)), 0) AS off FROM (SELECT *, string_split(raw, chr(10)) AS l, unnest(range(1, len(string_split(raw, chr(10))) + 1)) AS i FROM based)),
        kept AS (SELECT *, {trimmed('piece')} AS t, base + off + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS ix FROM pieces WHERE {trimmed('piece')} <> '')
        SELECT doc_id, 'L' || (ix + 1) AS line_id, page, CAST(ix AS INT) AS line_index, t AS text, CAST(s AS INT) AS start_char, CAST(s + length(t) AS INT) AS end_char, round({confidence('piece')}, 6) AS confidence FROM kept""",
    "line_confidence": f"WITH {_LINES} SELECT line_uid, round({confidence('text')}, 6) AS confidence FROM lines",
    "paper_quality": f"""WITH {_LINES}, s AS (SELECT paper_id, count(*) AS n, avg(coalesce(confidence, 0.9::DOUBLE)) AS mean, avg(regexp_matches(text, '{_ILLEGIBLE}', 'i')::INT) AS ill, avg((length({norm('text')}) < 12)::INT) AS sh FROM lines GROUP BY paper_id),
        t AS (SELECT *, greatest(0.0, least(1.0, mean - CASE WHEN ill > 0.1::DOUBLE THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN sh > 0.6::DOUBLE THEN 0.1::DOUBLE ELSE 0 END)) AS score FROM s)
        SELECT paper_id, round(score, 10) AS score, round(coalesce(ill, 0), 10) AS illegible_ratio, round(sh, 10) AS short_line_ratio,
          concat_ws(',', CASE WHEN ill > 0.1::DOUBLE THEN 'illegible_regions' END, CASE WHEN sh > 0.6::DOUBLE THEN 'fragmented_lines' END, CASE WHEN score < 0.6::DOUBLE THEN 'low_ocr_quality' END, CASE WHEN n < 3 THEN 'very_short_document' END) AS flags FROM t""",
    "lines_to_text": f"WITH {_LINES}, {_BLOCKS}, {_WANTED} SELECT answer_id, string_agg(coalesce(text, ''), chr(10) ORDER BY line_index) AS text FROM wanted w JOIN lines l ON l.paper_id = w.paper_id AND l.line_id = w.line_id GROUP BY answer_id",
    "span_lines": f"WITH {_SPANS} SELECT answer_id, line_uid FROM spans s JOIN lines l ON l.paper_id = s.paper_id AND s.a < l.end_char AND s.b > l.start_char",
    "answer_line_offsets": f"""WITH {_LINES}, {_BLOCKS}, {_WANTED}, o AS (SELECT answer_id, w.line_id, text, coalesce(sum(length(text) + 1) OVER (PARTITION BY answer_id ORDER BY line_index, w.line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM wanted w JOIN lines l ON l.paper_id = w.paper_id AND l.line_id = w.line_id)
        SELECT answer_id, line_id, CAST(s AS BIGINT) AS line_start, CAST(s + length(text) AS BIGINT) AS line_end FROM o""",
    "unclaimed_lines": f"WITH {_FREE} SELECT line_uid, paper_id, line_id FROM free",
    "unassigned_writing": f"WITH {_WRITING} SELECT paper_id, n_lines, n_chars, n_chars >= 40 AS has_unassigned_writing FROM writing",
    "exam_derived_marks": rf"""WITH {_QUESTIONS}, parts AS (SELECT DISTINCT exam_id, regexp_extract(number, '^\d+') AS head, number FROM questions WHERE number IS NOT NULL AND regexp_extract(number, '^\d+') NOT IN ('', number)),
        need AS (SELECT exam_id, head, CAST(ceil(count(*) / 2) AS INT) AS required FROM parts GROUP BY ALL), firsts AS (SELECT DISTINCT ON (exam_id, number) * FROM questions ORDER BY exam_id, number, ord),
        r AS (SELECT f.*, required, row_number() OVER (PARTITION BY f.exam_id, head ORDER BY coalesce(max_marks, 0) DESC, ord) AS rk FROM parts JOIN need USING (exam_id, head) JOIN firsts f USING (exam_id, number)),
        out_ AS (SELECT DISTINCT exam_id, question_id FROM r WHERE rk > required),
        s AS (SELECT exam_id, count(*) FILTER (max_marks IS NULL) AS n_missing, sum(coalesce(max_marks, 0)) AS printed_marks, sum(CASE WHEN o.question_id IS NULL THEN coalesce(max_marks, 0) ELSE 0 END) AS total_marks FROM questions LEFT JOIN out_ o USING (exam_id, question_id) GROUP BY exam_id)
        SELECT exam_id, n_missing, printed_marks, total_marks, CASE WHEN declared_total > 0 THEN declared_total END AS declared_total, coalesce(n_missing = 0 AND declared_total > 0 AND total_marks <> declared_total, false) AS mismatch, n_missing > 0 AS blocking FROM s LEFT JOIN exams USING (exam_id)""",
    "exam_duplicate_numbers": f"WITH {_QUESTIONS} SELECT exam_id, number, count(*) AS n FROM questions WHERE number IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "exam_validated": f"""WITH {_QUESTIONS}, p AS (SELECT exam_id, number, max(ord)::DOUBLE AS printed FROM questions WHERE ord % 3 = 0 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY exam_id ORDER BY ord) AS place FROM questions WHERE {norm('text')} <> '' OR trim(coalesce(number, '')) <> ''),
        n AS (SELECT * REPLACE (trim(coalesce(number, CAST(place AS VARCHAR))) AS number), CASE WHEN max_marks > 0 THEN max_marks END AS read_ FROM k),
        j AS (SELECT n.*, p.printed, coalesce(p.printed, read_) AS m FROM n LEFT JOIN p ON p.exam_id = n.exam_id AND p.number = n.number)
        SELECT exam_id, ord, number, trim(coalesce(text, '')) AS text, m AS max_marks, {kind('text', 'm')} AS type, coalesce(read_ <> printed, false) AS mark_conflict FROM j""",
    "choice_best_n": f"WITH {_ROWS}, {ranked('rows_')} SELECT paper_id, question_id, group_id, CAST(rank AS INT) AS rank, kept FROM ranked",
    "choice_first_n": f"WITH {_ROWS}, {ranked('rows_', 'first')} SELECT paper_id, question_id, group_id, CAST(rank AS INT) AS rank, kept FROM ranked",
    "choice_dropped": f"WITH {_ROWS}, {ranked('rows_')} SELECT DISTINCT paper_id, question_id, number, CASE WHEN skipped THEN 'not attempted, and not required' ELSE 'an extra attempt beyond the choice' END AS reason FROM ranked WHERE NOT kept",
    "choice_totals": f"""WITH {_ROWS}, {counted('rows_')} SELECT paper_id, sum(CASE WHEN counted THEN max_marks ELSE 0 END) AS maximum_marks, sum(CASE WHEN counted THEN coalesce(marks_awarded, 0) ELSE 0 END) AS total_marks, sum(max_marks) AS printed_marks FROM counted GROUP BY paper_id""",
    "paper_totals": f"WITH {_TOTALS} SELECT paper_id, total_marks, maximum_marks, printed_marks, round(percentage, 6) AS percentage, {_GRADE} AS grade, maximum_marks > 0 AND percentage >= {PASS_PERCENTAGE} AS passed, overall_confidence FROM totals",
    "grade_distribution": f"WITH {_TOTALS} SELECT {_GRADE} AS grade, count(*) AS n_papers, round(avg(percentage), 4) AS mean_percentage FROM totals GROUP BY 1",
    "point_quality": f"WITH {_CLAMPED} SELECT paper_id, CASE WHEN max_marks > 0 AND marks_awarded >= max_marks THEN 'well' WHEN marks_awarded > 0 THEN 'partially' ELSE 'not' END AS quality, count(*) AS n FROM clamped GROUP BY ALL",
    "pending_marks": f"WITH {_CLAMPED}, {counted('clamped')} SELECT paper_id, sum(CASE WHEN counted AND failed AND ord % 4 <> 0 THEN max_marks ELSE 0.0 END) AS pending FROM counted GROUP BY paper_id",
    "answer_status": f"WITH {_STATUS} SELECT block_id, status FROM status",
    "coverage_summary": f"""WITH {_STATUS} SELECT paper_id, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status IN ('uncertain', 'not_detected')) AS verify, count(*) FILTER (status = 'unanswered') AS unanswered,
        count(*) FILTER (status = 'evaluation_failed') AS failed, count(*) AS n_questions FROM status GROUP BY paper_id""",
    "attention_list": f"WITH {_STATUS} SELECT paper_id, block_id, status FROM status WHERE counted AND status NOT IN ('detected', 'unanswered')",
    "review_issues": f"WITH {_STATUS} SELECT paper_id, count(*) FILTER (skipped OR failed OR confidence < 60) AS n_issues FROM status GROUP BY paper_id",
    "collect_points": f"""WITH {_BLOCKS}, p AS (SELECT paper_id, block_id AS ord, trim(question_text) AS point FROM blocks WHERE trim(question_text) <> ''),
        f AS (SELECT DISTINCT ON (paper_id, lower(point)) * FROM p ORDER BY paper_id, lower(point), ord), r AS (SELECT paper_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY ord, point) AS INT) AS rank, point FROM f) SELECT * FROM r WHERE rank <= 8""",
    "annotation_marks": f"""WITH {_ROWS}, {_NOTES}, s AS (SELECT *, sum(CASE WHEN marks > 0 THEN marks ELSE 0 END) OVER q AS claimed, count(marks) OVER q AS reported, count(*) FILTER (type IN ('correct', 'partial')) OVER q AS earners FROM notes WINDOW q AS (PARTITION BY question_key))
        SELECT question_key, ann_ord, CASE WHEN claimed > awarded + 1e-9 THEN NULL WHEN reported = 0 AND awarded > 0 AND earners = 1 AND type IN ('correct', 'partial') THEN awarded ELSE marks END AS fixed_marks FROM s""",
    "question_confidence": f"""WITH {_ROWS}, {_NOTES}, m AS (SELECT question_key, floor(avg(confidence) + 0.5) AS model FROM notes GROUP BY 1), q AS (SELECT o_orderkey AS question_key, CASE WHEN o_orderstatus <> 'P' THEN 70.0 ELSE 100.0 END AS d, o_orderstatus = 'F' AS weak, o_orderkey % 7 <> 0 AS relevant FROM orders)
        SELECT question_key, least(coalesce(model, d), d, CASE WHEN weak THEN 65 ELSE 1000 END, CASE WHEN NOT relevant THEN 55 ELSE 1000 END)::DOUBLE AS confidence FROM q LEFT JOIN m USING (question_key)""",
    "label_keys": f"WITH {_BLOCKS}, l AS (SELECT block_id, {levels('question_number')} AS l FROM blocks) SELECT block_id, {key_of('l')} AS key, {shown_of('l')} AS shown FROM l",
    "align_by_label": f"""WITH {_KEYED}, {_BLOCKS}, owners AS (SELECT DISTINCT ON (exam_id, key) * FROM keyed WHERE key <> '' ORDER BY exam_id, key, ord),
        named AS (SELECT paper_id, exam_id, block_id, {key_of('l')} AS key FROM (SELECT *, {levels('question_number')} AS l FROM blocks))
        SELECT paper_id, CAST(min(block_id) AS BIGINT) AS block_ord, question_id, 95 AS confidence, 'label' AS method FROM named JOIN owners USING (exam_id, key) GROUP BY paper_id, question_id""",
    "text_segments": f"""WITH {_BLOCKS}, a AS (SELECT block_id AS answer_id, answer_text AS text, CASE WHEN question_text <> '' AND instr(answer_text, question_text) > 0 THEN instr(answer_text, question_text) - 1 END AS s, length(question_text) AS n FROM blocks WHERE answer_text IS NOT NULL),
        c AS (SELECT answer_id, text, 0 AS x, coalesce(s, length(text)) AS y, NULL::INT AS ann_ord FROM a UNION ALL SELECT answer_id, text, s, s + n, 0 FROM a WHERE s IS NOT NULL UNION ALL SELECT answer_id, text, s + n, length(text), NULL FROM a WHERE s IS NOT NULL)
        SELECT answer_id, CAST(x AS INT) AS seg_start, CAST(y AS INT) AS seg_end, ann_ord, substr(text, CAST(x + 1 AS BIGINT), CAST(y - x AS BIGINT)) AS text FROM c WHERE y > x""",
    "chunk_lines": f"""WITH {_LINES}, p AS (SELECT paper_id, line_id, row_number() OVER (PARTITION BY paper_id ORDER BY line_index, line_id) - 1 AS place, length(coalesce(text, '')) + 12 AS cost FROM lines), {windows('p', 'paper_id', 'w', 6000, 10**9, 'w.e + 1 - greatest(1, CAST(floor((w.e - w.s + 1) * 0.1::DOUBLE + 0.5::DOUBLE) AS BIGINT))')}
        SELECT w.paper_id, k AS window_ord, CAST(e - s + 1 AS INT) AS n_lines, a.line_id AS first_line, b.line_id AS last_line, CAST(b.upto - a.upto + a.cost AS INT) AS n_chars FROM w JOIN sums a ON a.paper_id = w.paper_id AND a.place = s JOIN sums b ON b.paper_id = w.paper_id AND b.place = e""",
    "chunk_questions": f"""WITH {_QUESTIONS}, p AS (SELECT exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY ord) - 1 AS place, least(240, length(coalesce(number, 'None') || '. ' || coalesce(text, 'None'))) + 1 AS cost FROM questions), {windows('p', 'exam_id', 'w', 2000, 8, 'w.e + 1')}
        SELECT w.exam_id, k AS batch_ord, CAST(e - s + 1 AS INT) AS n_questions, CAST(b.upto - a.upto + a.cost AS INT) AS n_chars FROM w JOIN sums a ON a.exam_id = w.exam_id AND a.place = s JOIN sums b ON b.exam_id = w.exam_id AND b.place = e""",
    "detect_choice": f"WITH {_OFFERED} SELECT doc_id, group_id, required, number, member_ord FROM offered",
    "describe_choice": f"WITH {_DESCRIBED} SELECT doc_id, description FROM described",
    "split_sentences": f'''WITH {sentences("reference_chunks", "ref_id")} SELECT ref_id, text, start, "end" FROM sentences''',
    "chunk_documents": f"WITH {passages('documents', 'doc_id', 'source')} SELECT doc_id, source, ord, chunk_id, text FROM cut_passages",
    "reference_passages": f"WITH {passages('reference_chunks', 'ref_id', 'source, page')} SELECT ref_id AS doc_id, source, page, ord, chunk_id, text FROM cut_passages",
    "stream_budget": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS now_, greatest(1, CAST(trunc(coalesce(value, 0)) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT user_id, event_id, cost, i, now_ AS opened, cost <= 150 AS granted, CASE WHEN cost <= 150 THEN 150 - cost ELSE 150 END AS remaining FROM e WHERE i = 1
          UNION ALL SELECT n.user_id, n.event_id, n.cost, n.i, n.o, n.cost <= n.had, CASE WHEN n.cost <= n.had THEN n.had - n.cost ELSE n.had END
          FROM (SELECT e.*, CASE WHEN e.now_ >= r.opened + 60000 THEN e.now_ ELSE r.opened END AS o, CASE WHEN e.now_ >= r.opened + 60000 THEN 150 ELSE r.remaining END AS had FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) n)
        SELECT user_id, event_id, cost, granted, remaining FROM r""",
    "stream_key_states": """WITH RECURSIVE e AS (SELECT user_id % 8 AS key_id, event_id, epoch_ms(ts) AS now_, event_id % 3 AS kind, CASE WHEN event_id % 41 = 0 THEN 429 WHEN event_id % 997 = 0 THEN 401 ELSE 200 END AS status, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS i FROM events),
        r AS (SELECT key_id, CAST(0 AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS i, CAST(8000 AS BIGINT) AS remaining, CAST(0 AS BIGINT) AS reset_at, CAST(0 AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS in_flight, false AS dead FROM (SELECT DISTINCT key_id FROM e)
          UNION ALL SELECT key_id, event_id, i,
            CASE WHEN kind <> 1 THEN had WHEN status = 401 OR status = 429 THEN 0 ELSE greatest(0, had - 300) END,
            CASE WHEN kind = 1 AND status = 429 AND due = 0 THEN now_ + 20000 ELSE due END,
            CASE kind WHEN 0 THEN reserved + 300 WHEN 1 THEN greatest(0, reserved - 300) ELSE reserved END, CASE kind WHEN 0 THEN in_flight + 1 WHEN 1 THEN greatest(0, in_flight - 1) ELSE in_flight END, dead OR (kind = 1 AND status = 401)
          FROM (SELECT e.*, r.reserved, r.in_flight, r.dead, CASE WHEN r.reset_at > 0 AND e.now_ >= r.reset_at THEN 8000 ELSE r.remaining END AS had, CASE WHEN r.reset_at > 0 AND e.now_ >= r.reset_at THEN 0 ELSE r.reset_at END AS due FROM r JOIN e ON e.key_id = r.key_id AND e.i = r.i + 1))
        SELECT key_id, event_id, CASE WHEN dead THEN 0 ELSE greatest(0, remaining - reserved) END AS available, reserved, in_flight, dead FROM r WHERE i > 0""",
    "find_spans": f"""WITH {_BLOCKS}, n AS (SELECT block_id, question_text AS q, answer_text AS a, {norm('question_text')} AS t, string_split({norm('question_text')}, ' ') AS w FROM blocks WHERE trim(question_text) <> '' AND answer_text IS NOT NULL),
        c AS (SELECT block_id, a, list_prepend(t, list_filter(list_transform(range(len(w) - 1, CAST(greatest(3, ceil(len(w) * 0.4::DOUBLE)) AS BIGINT) - 1, -1), lambda k: array_to_string(w[1:k], ' ')), lambda x: length(x) >= 10)) AS l FROM n WHERE instr(a, q) = 0 AND length(t) >= 3),
        m AS (SELECT block_id, a, i, regexp_extract(a, '(?i)' || replace(l[i], ' ', '[^A-Za-z0-9]+')) AS hit FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)),
        b AS (SELECT block_id, any_value(a) AS a, arg_min(hit, i) AS hit FROM m WHERE hit <> '' GROUP BY block_id)
        SELECT block_id, CAST(instr(a, q) - 1 AS INT) AS start, CAST(instr(a, q) - 1 + length(q) AS INT) AS "end", true AS exact FROM n WHERE instr(a, q) > 0
        UNION ALL SELECT block_id, CAST(instr(a, hit) - 1 AS INT), CAST(instr(a, hit) - 1 + length(hit) AS INT), false FROM b""",
    "apply_proposals": f"""WITH RECURSIVE {_KEYED}, {_LINES}, {_BLOCKS}, {_WANTED},
        owners AS (SELECT DISTINCT ON (exam_id, key) * FROM keyed WHERE key <> '' ORDER BY exam_id, key, ord DESC),
        free AS (SELECT paper_id, line_id, line_index FROM lines l WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.answer_id % 2 = 0 AND w.paper_id = l.paper_id AND w.line_id = l.line_id)),
        named AS (SELECT paper_id, exam_id, block_id, {key_of('l')} AS key, answer_line_ids FROM (SELECT *, {levels('question_number')} AS l FROM blocks WHERE question_number IS NOT NULL)),
        usable AS (SELECT n.paper_id, block_id, question_id, list_distinct(list(f.line_id ORDER BY line_index)) AS raw, list(f.line_id ORDER BY line_index) AS ids FROM (SELECT DISTINCT paper_id, exam_id, block_id, key, unnest(answer_line_ids) AS line_id FROM named) n
          JOIN owners o ON o.exam_id = n.exam_id AND o.key = n.key JOIN free f ON f.paper_id = n.paper_id AND f.line_id = n.line_id
          WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.block_id % 5 = 0 AND b.paper_id = n.paper_id AND 'q' || (b.block_id % 7 + 1) = question_id) GROUP BY ALL),
        u AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY block_id) AS i FROM usable),
        r AS (SELECT paper_id, i, question_id, ids AS got, [question_id] AS qs, ids AS ls FROM u WHERE i = 1
          UNION ALL SELECT n.paper_id, n.i, n.question_id, CASE WHEN n.ok THEN n.left_ END, CASE WHEN n.ok THEN list_append(n.qs, n.question_id) ELSE n.qs END, CASE WHEN n.ok THEN list_concat(n.ls, n.left_) ELSE n.ls END
          FROM (SELECT m.*, NOT list_contains(m.qs, m.question_id) AND len(m.left_) > 0 AS ok FROM (SELECT u.paper_id, u.i, u.question_id, r.qs, r.ls, list_filter(u.ids, lambda x: NOT list_contains(r.ls, x)) AS left_ FROM r JOIN u ON u.paper_id = r.paper_id AND u.i = r.i + 1) m) n)
        SELECT paper_id, question_id, array_to_string(got, ',') AS line_ids, 70 AS confidence, 'model' AS method FROM r WHERE got IS NOT NULL""",
    "recover_replies": """SELECT event_id, '{"k": ' || least(50, greatest(0, CAST(json_extract_string(props, '$.k') AS INT))) || ', "note": ""}' AS value, NULL AS error FROM events""",
    "paper_json": f"""WITH {_LABELLED}, l AS (SELECT paper_id, string_agg('{{"ord":' || ord || ',"number":"' || number || '","marks_awarded":' || marks_awarded || ',"max_marks":' || max_marks || ',"label":"' || status || '"}}', ',' ORDER BY ord) AS q FROM labelled GROUP BY paper_id)
        SELECT paper_id, '{{"paper_id":' || paper_id || ',"total_marks":' || total_marks || ',"maximum_marks":' || maximum_marks || ',"percentage":' || percentage || ',"grade":"' || {_GRADE} || '","questions":[' || q || ']}}' AS json FROM totals JOIN l USING (paper_id)""",
    "model_replies": f"""WITH {_QUESTIONS} SELECT exam_id, question_id, CASE WHEN text IS NOT NULL THEN '{{"kind": "", "n": ' || least(12, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))) || '}}' END AS value, CASE WHEN text IS NULL THEN 'no reply' END AS error FROM questions""",
    "paper_verdicts": f"WITH {_TOTALS}, p AS (SELECT paper_id, sum(CASE WHEN counted AND failed AND ord % 4 <> 0 THEN max_marks ELSE 0.0 END) AS pending FROM counted GROUP BY paper_id) SELECT paper_id, {_VERDICT} AS verdict, {_BAND} AS band FROM totals JOIN p USING (paper_id)",
    "question_labels": f"""WITH {_LABELLED} SELECT paper_id, question_id, report_label, CASE status WHEN 'evaluation_failed' THEN 'Evaluation unavailable' WHEN 'not_detected' THEN 'Answer not detected' WHEN 'unanswered' THEN 'Confirmed unanswered' WHEN 'uncertain' THEN 'Uncertain — verify'
        ELSE CASE WHEN marks_awarded >= max_marks THEN 'Full marks' WHEN marks_awarded > 0 THEN 'Partial' ELSE 'Zero' END END AS examiner_label FROM labelled""",
    "annotation_badges": f"""WITH {_ROWS}, {_NOTES} SELECT question_key, ann_ord, CASE WHEN coalesce(marks, 0) <> 0 THEN CASE type WHEN 'correct' THEN '+' WHEN 'wrong' THEN '✗' WHEN 'missing' THEN '!' ELSE '~' END || {plain('abs(marks)')}
        ELSE CASE type WHEN 'correct' THEN '✓' WHEN 'wrong' THEN '✗' WHEN 'missing' THEN '!' ELSE '~' END END AS badge, coalesce(marks, 0) <> 0 AS has_marks, coalesce(confidence < 60, false) AS low FROM notes""",
    "unpinned_notes": f"""WITH {_SPANS}, {_BANDS}, page_tiers AS (SELECT DISTINCT doc_id, page, tier FROM tiers),
        shown AS (SELECT DISTINCT s.paper_id, answer_id FROM spans s JOIN lines l ON l.paper_id = s.paper_id AND s.a < l.end_char AND s.b > l.start_char AND l.bbox IS NOT NULL JOIN page_tiers t ON t.doc_id = s.paper_id AND t.page = l.page WHERE tier IN ('medium', 'high'))
        SELECT paper_id, block_id AS span_id, substr(coalesce(answer_text, ''), 1, 90) || CASE WHEN length(coalesce(answer_text, '')) > 90 THEN '…' ELSE '' END AS shown FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM shown s WHERE s.paper_id = b.paper_id AND s.answer_id = b.block_id)""",
    "transcript_edits": rf"""WITH {_BLOCKS}, e AS (SELECT block_id, answer_text, CASE block_id % 3 WHEN 0 THEN {trimmed('answer_text')} WHEN 1 THEN answer_text || '!' ELSE answer_text END AS t FROM blocks)
        SELECT block_id, t IS DISTINCT FROM answer_text AS dirty, CAST(CASE WHEN {trimmed("coalesce(t, '')")} = '' THEN 0 ELSE len(regexp_split_to_array({trimmed("coalesce(t, '')")}, '{_SPACE}+')) END AS INT) AS n_words FROM e""",
    "closing_remarks": f"""WITH {_TOTALS}, r AS (SELECT *, CASE WHEN paper_id % 8 = 0 THEN 'Well done, paper ' || paper_id END AS given FROM totals)
        SELECT paper_id, coalesce(given, 'Scored ' || {plain('total_marks')} || ' out of ' || {plain('maximum_marks')} || ' (' || CAST(floor(percentage + 0.5) AS BIGINT) || '%), grade ' || {_GRADE} || '. See the per-question feedback for detail.') AS remark, given IS NOT NULL AS from_model FROM r""",
    "printed_reports": f"""WITH {_LABELLED}, l AS (SELECT paper_id, string_agg('Q' || number || ' ' || {plain('marks_awarded')} || '/' || {plain('max_marks')} || ' ' || report_label, chr(10) ORDER BY ord) AS body, count(*) AS n FROM labelled GROUP BY paper_id)
        SELECT paper_id, {plain('total_marks')} || ' / ' || {plain('maximum_marks')} || ' ' || {_GRADE} AS header, body, CAST(n AS INT) AS n_lines FROM totals JOIN l USING (paper_id)""",
    "exam_warnings": f"""WITH {_DESCRIBED}, p AS (SELECT exam_id, number, max(ord)::DOUBLE AS printed FROM questions WHERE ord % 3 = 0 GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY exam_id ORDER BY ord) AS place FROM questions WHERE {norm('text')} <> '' OR trim(coalesce(number, '')) <> ''),
        n AS (SELECT * REPLACE (trim(coalesce(number, CAST(place AS VARCHAR))) AS number), CASE WHEN max_marks > 0 THEN max_marks END AS read_ FROM k),
        j AS (SELECT n.*, p.printed, coalesce(p.printed, read_) AS m FROM n LEFT JOIN p ON p.exam_id = n.exam_id AND p.number = n.number)
        SELECT exam_id, 'mark_conflict' AS kind, number, CAST(read_ AS VARCHAR) || ' read, ' || CAST(printed AS VARCHAR) || ' printed' AS detail, false AS blocking FROM j WHERE read_ <> printed
        UNION ALL SELECT exam_id, 'duplicate_number', number, NULL, false FROM j GROUP BY exam_id, number HAVING count(*) > 1
        UNION ALL SELECT exam_id, 'missing_marks', NULL, CAST(count(*) AS VARCHAR), true FROM j WHERE m IS NULL GROUP BY exam_id
        UNION ALL SELECT exam_id, 'no_questions', NULL, NULL, true FROM (SELECT DISTINCT exam_id FROM questions WHERE exam_id NOT IN (SELECT exam_id FROM j))
        UNION ALL SELECT doc_id, 'choice', NULL, description, false FROM described""",
    "extracted_exams": f"""WITH {_QUESTIONS}, k AS (SELECT exam_id, row_number() OVER (PARTITION BY exam_id ORDER BY ord) AS place, nullif(trim(coalesce(number, '')), '') AS number, text, max_marks FROM questions WHERE text IS NOT NULL)
        SELECT exam_id, 'Paper' AS title, false AS unread, CAST(place AS INT) AS ord, number, trim(text) AS text, CASE WHEN max_marks > 0 THEN max_marks END AS max_marks FROM k WHERE exam_id % 5 <> 0
        UNION ALL SELECT DISTINCT exam_id, NULL, true, NULL::INT, NULL, NULL, NULL FROM k WHERE exam_id % 5 = 0""",
    "assessed_questions": f"""WITH {_CITED}, n AS (SELECT question_key AS k, count(cited_id) AS cited FROM checked GROUP BY 1), q AS (SELECT query_id AS k, n.k IS NOT NULL AND query_id % 11 <> 0 AS read_, coalesce(cited, 0) AS cited, n.k IS NOT NULL AS held FROM asked LEFT JOIN n ON n.k = query_id),
        g AS (SELECT *, CASE WHEN NOT held THEN 'INSUFFICIENT' WHEN NOT read_ THEN 'INSUFFICIENT' WHEN cited = 0 THEN 'GENERAL' ELSE 'REFERENCE' END AS grounding FROM q)
        SELECT k AS question_key, CASE WHEN read_ THEN least(5.0, (k % 9)::DOUBLE) ELSE 0.0 END AS marks_awarded, grounding, CASE WHEN read_ THEN cited ELSE 0 END AS n_cited,
          CASE WHEN NOT read_ THEN 0.0 ELSE least((k % 60 + 30)::DOUBLE, CASE WHEN k % 2 = 0 THEN 70.0 ELSE 100.0 END, CASE WHEN grounding = 'INSUFFICIENT' THEN 65.0 ELSE 1000.0 END, CASE WHEN k % 7 = 0 THEN 55.0 ELSE 1000.0 END) END AS confidence, NOT read_ AS failed FROM g""",
    "coverage_buckets": f"WITH {_STATUS} SELECT paper_id, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("detected", "uncertain", "not_detected", "unanswered", "evaluation_failed")) + " FROM status GROUP BY paper_id",
    "review_issues_with_warnings": f"WITH {_STATUS} SELECT paper_id, count(*) FILTER (skipped OR failed OR confidence < 60) + count(*) FILTER (failed) AS n_issues FROM status GROUP BY paper_id",
    "paired_coverage": f"""WITH {_BM25}, held AS (SELECT DISTINCT query_id, unnest({stems('text')}) AS term FROM top JOIN passages USING (chunk_id)),
        c AS (SELECT query_id, count(*) AS n_terms, count(h.term) AS n_hit FROM qo LEFT JOIN held h USING (query_id, term) GROUP BY query_id)
        SELECT query_id, n_terms, n_hit, CASE WHEN query_id % 3 = 0 THEN 1.0::DOUBLE ELSE round(n_hit / n_terms, 9) END AS coverage, query_id % 3 <> 0 AND n_hit / n_terms < 0.45::DOUBLE AS weak FROM c""",
    "pool_stats": """WITH k AS (SELECT n_nationkey AS k, 8000 AS token_limit, CASE WHEN n_nationkey % 9 = 0 THEN 0 ELSE greatest(0, CASE WHEN n_nationkey % 2 = 0 AND 9000 >= 1000 * n_nationkey THEN 8000 ELSE n_nationkey * 331 END - n_nationkey * 7) END AS available FROM nation)
        SELECT count(*) AS n_keys, count(*) FILTER (k % 9 = 0) AS n_dead, max(token_limit) AS ceiling, sum(available) AS available, sum(k % 4) AS in_flight, count(*) FILTER (available > 0) AS n_ready FROM k""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 12) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rk FROM s) SELECT query_id, CAST(rk AS INT) AS rk, chunk_id, round(score, 6) AS score FROM r WHERE rk <= 5""",
    "uploads_decided": """WITH p AS (SELECT paper_id, min(student_id) AS student_id, min(source) AS source, min(uploaded_at) AS at_, min(page_count) AS n_pages FROM papers GROUP BY paper_id),
        u AS (SELECT coalesce(student_id, 0) % 40 AS owner, source || '_' || paper_id || (['.docx', '.pdf', '.doc', '.JPG', '.txt'])[paper_id % 5 + 1] AS path, paper_id % 5 AS t, at_, n_pages FROM p),
        d AS (SELECT *, CASE t WHEN 2 THEN 'legacy' WHEN 4 THEN 'unsupported' WHEN 0 THEN CASE WHEN row_number() OVER (PARTITION BY owner, t = 0 ORDER BY at_ DESC, path DESC) > 1 THEN 'replaced' ELSE 'read' END ELSE 'read' END AS decision, CASE WHEN t IN (1, 3) THEN n_pages ELSE 0 END AS paged FROM u),
        c AS (SELECT *, least(paged, greatest(0, 30 - coalesce(sum(paged) OVER (PARTITION BY owner ORDER BY at_, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS kept FROM d)
        SELECT owner, path, decision, CAST(kept AS INT) AS pages_kept, CAST(paged - kept AS INT) AS pages_cut FROM c""",
    "assessed_papers": f"""WITH {_TOTALS}, w AS (SELECT paper_id, count(*) FILTER (failed) + count(*) FILTER (NOT counted) + CASE WHEN paper_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM counted GROUP BY paper_id)
        SELECT paper_id, total_marks, maximum_marks, {_GRADE} AS grade, maximum_marks > 0 AND percentage >= {PASS_PERCENTAGE} AS passed, overall_confidence, n AS n_warnings FROM totals JOIN w USING (paper_id)""",
    "paper_evaluations": f"""WITH {_TOTALS}, e AS (SELECT *, ord % 3 <> 0 AS written FROM counted)
        SELECT paper_id, question_id, ord, marks_awarded, max_marks, counted, CASE WHEN failed THEN 'evaluation_failed' WHEN (skipped OR NOT written) AND written AND paper_id % 2 = 0 THEN 'not_detected' WHEN skipped OR NOT written THEN 'unanswered' WHEN confidence < 60 THEN 'uncertain' ELSE 'detected' END AS status,
          CASE WHEN max_marks > 0 AND marks_awarded >= max_marks THEN 'well' WHEN marks_awarded > 0 THEN 'partially' ELSE 'not' END AS quality FROM e""",
    "citation_check": f"WITH {_CITED} SELECT question_key, evidence_id, ann_ord, cited_id FROM checked",
    "grounding": f"""WITH {_CITED}, e AS (SELECT query_id, count(*) AS n FROM evidence GROUP BY 1), c AS (SELECT question_key, count(cited_id) AS n FROM checked GROUP BY 1)
        SELECT a.query_id AS question_key, coalesce(e.n, 0) AS n_evidence, coalesce(c.n, 0) AS n_cited, CASE WHEN coalesce(e.n, 0) = 0 THEN 'INSUFFICIENT' WHEN a.query_id % 2 = 0 AND coalesce(c.n, 0) = 0 THEN 'GENERAL' WHEN a.query_id % 2 = 0 THEN 'REFERENCE' ELSE 'GENERAL' END AS grounding
        FROM asked a LEFT JOIN e ON e.query_id = a.query_id LEFT JOIN c ON c.question_key = a.query_id""",
    "evidence_with_pair": f"""WITH {_BM25}, evidence AS ({_TOP}), u AS (SELECT query_id, 0 AS rk, chunk_id, 1.0 AS score FROM evidence WHERE rk = 2 UNION ALL SELECT query_id, rk, chunk_id, score FROM evidence),
        o AS (SELECT query_id, chunk_id, min(rk) AS rk, arg_min(score, rk) AS score FROM u GROUP BY ALL), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rk, chunk_id) AS INT) AS rk, chunk_id, round(score, 6) AS score FROM o) SELECT * FROM r WHERE rk <= 4""",
    "override_effective_score": f"""WITH {_CLAMPED}, o AS (SELECT * REPLACE (CASE WHEN ord % 3 = 0 AND ord % 2 <> 0 THEN 40.0 ELSE marks_awarded END AS marks_awarded), ord % 3 = 0 AND ord % 2 <> 0 AND marks_awarded <> 40.0 AS overridden FROM clamped), {counted('o')}
        SELECT paper_id, sum(CASE WHEN counted THEN max_marks ELSE 0 END) AS maximum_marks, sum(CASE WHEN counted THEN marks_awarded ELSE 0 END) AS total_marks, sum(max_marks) AS printed_marks, count(*) FILTER (overridden) AS n_overridden FROM counted GROUP BY paper_id""",
    "student_trend": f"""WITH {_HISTORY}, p AS (SELECT *, lag(percentage) OVER (PARTITION BY student_id ORDER BY taken_at, paper_id) AS previous FROM history)
        SELECT student_id, paper_id, previous, CASE WHEN previous IS NULL THEN 'none' WHEN percentage - previous > 1 THEN 'up' WHEN percentage - previous < -1 THEN 'down' ELSE 'level' END AS trend FROM p""",
    "recent_five": f"WITH {_HISTORY}, r AS (SELECT student_id, paper_id, CAST(row_number() OVER (PARTITION BY student_id ORDER BY taken_at DESC, paper_id DESC) AS INT) AS rank FROM history) SELECT * FROM r WHERE rank <= 5",
    "pages_cut": f"WITH {_LINES}, p AS (SELECT DISTINCT paper_id, page FROM lines), r AS (SELECT paper_id, page, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY page) AS INT) AS place FROM p) SELECT *, place <= 4 AS kept FROM r",
    "align_bands": f"WITH {_LINES}, {_BANDS} SELECT doc_id, page, line_id, tier, round(top, 6) AS y, CASE WHEN top IS NOT NULL THEN round(greatest(0.0, bottom - top), 6) END AS height FROM tiers",
    "worst_geometry": f"WITH {_LINES}, {_BANDS} SELECT doc_id, (['none', 'low', 'medium', 'high'])[min(list_position(['none', 'low', 'medium', 'high'], tier))] AS tier FROM tiers GROUP BY doc_id",
    "union_boxes_by_page": f"WITH {_LINES} SELECT paper_id, page, {_BOX} FROM lines WHERE bbox IS NOT NULL GROUP BY ALL",
    "span_boxes": f"WITH {_SPANS} SELECT s.paper_id, answer_id AS span_id, page, {_BOX} FROM spans s JOIN lines l ON l.paper_id = s.paper_id AND s.a < l.end_char AND s.b > l.start_char WHERE bbox IS NOT NULL GROUP BY ALL",
    "placed_counts": f"""WITH {_SPANS}, {_BANDS}, pt AS (SELECT doc_id, page, max(tier) AS tier FROM tiers GROUP BY ALL)
        SELECT s.paper_id, count(DISTINCT answer_id) AS n_placed FROM spans s JOIN lines l ON l.paper_id = s.paper_id AND s.a < l.end_char AND s.b > l.start_char JOIN pt ON pt.doc_id = s.paper_id AND pt.page = l.page WHERE bbox IS NOT NULL AND tier IN ('high', 'medium') GROUP BY s.paper_id""",
    "range_geometry": f"""WITH {_LINES}, {_BLOCKS}, {_BANDS}, pt AS (SELECT doc_id, page, max(tier) AS tier FROM tiers GROUP BY ALL),
        r AS (SELECT paper_id, block_id AS range_id, unnest(range(page_start, page_end + 1)) AS page FROM blocks WHERE page_start <= page_end)
        SELECT paper_id, range_id, (['none', 'low', 'medium', 'high'])[min(coalesce(list_position(['none', 'low', 'medium', 'high'], tier), 1))] AS tier FROM r LEFT JOIN pt ON pt.doc_id = paper_id AND pt.page = r.page GROUP BY ALL""",
    "clean_text": rf"""WITH c AS (SELECT doc_id, {trimmed(r"regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM documents) SELECT doc_id, CAST(length(t) AS INT) AS n_chars, length(t) > 40 AS has_text FROM c""",
    "accepted_uploads": r"SELECT ref_id, lower(regexp_extract(source, '\.([A-Za-z0-9]+)$', 1)) AS suffix, lower(regexp_extract(source, '\.([A-Za-z0-9]+)$', 1)) IN ('pdf', 'docx', 'jpeg', 'jpg', 'png', 'gif', 'webp') AS accepted FROM reference_chunks",
    "elapsed_clock": "SELECT event_id, CASE WHEN s // 60 < 10 THEN '0' ELSE '' END || (s // 60) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock FROM (SELECT event_id, CAST(floor(value * 37) AS BIGINT) AS s FROM events)",
    "model_groups": f"""WITH {_LINES}, {_BLOCKS}, g AS (SELECT DISTINCT paper_id, block_id, question_number, unnest(answer_line_ids) AS line_id FROM blocks)
        SELECT g.paper_id AS doc_id, block_id AS group_ord, coalesce(question_number, CAST(block_id AS VARCHAR)) AS question_number, string_agg(g.line_id, ',' ORDER BY line_index) AS answer_line_ids, string_agg(text, chr(10) ORDER BY line_index) AS answer_text, arg_min(page, line_index) AS page_start, arg_max(page, line_index) AS page_end
        FROM g JOIN lines l ON l.paper_id = g.paper_id AND l.line_id = g.line_id GROUP BY ALL""",
    "padded_boxes": f"WITH {_LINES} SELECT line_uid, round(greatest(0.0, bbox.x - 0.015::DOUBLE), 6) AS x, round(greatest(0.0, bbox.y - 0.01::DOUBLE), 6) AS y, round(least(1.0, bbox.width + 0.03::DOUBLE), 6) AS width, round(least(1.0, bbox.height + 0.02::DOUBLE), 6) AS height FROM lines WHERE bbox IS NOT NULL",
    "unmatched_runs": f"WITH {_RUNS} SELECT * FROM runs",
    "gap_candidates": f"""WITH {_RUNS}, free AS (SELECT * FROM lines l WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.answer_id % 3 <> 0 AND w.paper_id = l.paper_id AND w.line_id = l.line_id)),
        j AS (SELECT paper_id, run_id, line_id, line_index > after_index AND (before_index IS NULL OR line_index < before_index) AS within FROM runs JOIN free USING (paper_id))
        SELECT paper_id, run_id, line_id FROM (SELECT *, bool_or(within) OVER (PARTITION BY paper_id, run_id) AS some_ FROM j) WHERE within OR NOT some_""",
    "assembled_answers": f"WITH {_BLOCKS} SELECT block_id, {short('answer_text', 'max_marks')} AS skipped, CAST(CASE WHEN {short('answer_text', 'max_marks')} THEN 40 ELSE 95 END AS INT) AS confidence FROM blocks",
    "request_cost": f"WITH {_COST} SELECT * FROM cost",
    "parse_reset": f"""SELECT event_id, CAST(CASE {_V} % 4 WHEN 0 THEN {_V} WHEN 1 THEN ({_V} + 0.5) * 1000 WHEN 2 THEN 60000 + {_V} * 1000 ELSE {_V} * 1000 END AS BIGINT) AS ms FROM events""",
    "retry_delay": """SELECT event_id, CAST(least(60, CASE WHEN v % 3 = 0 AND v > 0 THEN v WHEN v % 3 = 1 THEN v + 2 ELSE 20 END) AS DOUBLE) AS seconds FROM (SELECT event_id, event_id % 90 AS v FROM events)""",
    "rate_limit_windows": "SELECT user_id % 4 AS client, time_bucket(INTERVAL '600 seconds', ts) AS window_start, count(*) AS n_requests, greatest(0, count(*) - 1) AS n_refused FROM events GROUP BY ALL",
    "key_list": """WITH k AS (SELECT n_nationkey AS r, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS key, unnest([0, 1]) AS p FROM nation), f AS (SELECT key, min(r * 10 + p) AS first_ FROM k GROUP BY key)
        SELECT CAST(row_number() OVER (ORDER BY first_) - 1 AS INT) AS key_ord, key FROM f""",
    "pick_key": f"""WITH {_COST}, k AS (SELECT n_nationkey AS k FROM nation), s AS (SELECT k, k % 9 = 0 AS dead, CASE WHEN k % 2 = 0 AND 9000 >= k * 1000 THEN 8000 ELSE k * 331 END AS rem, CASE WHEN k % 2 <> 0 OR 9000 >= k * 1000 THEN 0 ELSE k * 1000 - 9000 END AS wait FROM k),
        a AS (SELECT *, CASE WHEN dead THEN 0 ELSE greatest(0, rem - k * 7) END AS av FROM s),
        j AS (SELECT block_id, cost, k, dead, wait, av >= cost AS able, av - (k % 4) * 1000 AS score FROM cost, a)
        SELECT block_id AS request_id, cost, arg_max(k, score * 1000 - k) FILTER (able) AS key_id, CAST(min(CASE WHEN NOT dead AND 8000 >= cost THEN CASE WHEN able THEN 0 WHEN wait > 0 THEN wait ELSE 1000 END END) AS INT) AS wait_ms FROM j GROUP BY block_id, cost""",
    "otsu_threshold": """WITH g AS (SELECT label, CAST(greatest(0, least(255, floor(round(v::DOUBLE, 5) * 40 + 128))) AS INT) AS value, count(*) AS n FROM (SELECT label, unnest(embedding) AS v FROM embeddings) GROUP BY ALL),
        c AS (SELECT label, value, sum(n) OVER u AS wb, sum(n * value) OVER u AS sb, sum(n) OVER w AS w, sum(n * value) OVER w AS s FROM g WINDOW u AS (PARTITION BY label ORDER BY value), w AS (PARTITION BY label)),
        v AS (SELECT label, value, CASE WHEN w > wb THEN round(wb::DOUBLE * (w - wb)::DOUBLE * pow(sb / wb - (s - sb) / (w - wb), 2), 6) END AS spread FROM c)
        SELECT label, coalesce(first(value ORDER BY spread DESC, value) FILTER (spread IS NOT NULL), 0) AS threshold FROM v GROUP BY label""",
    "ext_rollup_marks": """WITH p AS (SELECT paper_id, min(source) AS source, min(exam_id) AS exam_id FROM papers GROUP BY 1)
        SELECT subject, source, count(*) AS n_papers, CAST(grouping_id(subject, source) AS INT) AS level FROM p JOIN exams USING (exam_id) GROUP BY ROLLUP (subject, source)""",
    "ext_cube_events": """SELECT event_type, CAST(dayofweek(ts) + 1 AS INT) AS weekday, count(*) AS n, round(sum(value), 2) AS total, CAST(grouping_id(event_type, dayofweek(ts)) AS INT) AS level FROM events GROUP BY CUBE (event_type, dayofweek(ts))""",
}


SQL["effective_grades"] = f"""WITH first_ AS ({SQL['paper_totals']}), final_ AS ({SQL['override_effective_score']}), j AS (SELECT f.*, t.grade AS was, CASE WHEN f.maximum_marks > 0 THEN f.total_marks / f.maximum_marks * 100 END AS percentage FROM final_ f JOIN first_ t USING (paper_id))
    SELECT paper_id, total_marks, maximum_marks, n_overridden, CASE WHEN n_overridden > 0 AND maximum_marks > 0 THEN {_GRADE} ELSE was END AS grade FROM j"""
