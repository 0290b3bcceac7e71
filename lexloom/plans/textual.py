"""Registered queries: cleaning, extraction, chunking, search and retrieval over whole tables, with DuckDB SQL where it
can express them. The given texts are Latin, so patterns and term lists are given for them; the defaults are tested apart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as E
from ..functions import text as T
from ..operators import analytics as A
from ..operators import chunk as C
from ..operators import dedup as D
from ..operators import extension as X
from ..operators import inverted as K
from ..operators import ivf as I
from ..operators import retrieval as R
from ..operators import vectors as N
from ..sources.scratch import materialise, new_path
from . import views as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LATIN = r"[^\x20-\x7EÀ-ÿ\n]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = V.sql(sql)
        return f

    return register


def _texts(s, d, **columns):
    return V.texts(s, d).select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _nested(pairs: list[tuple[str, str]], start: str = "text") -> str:
    for pattern, to in pairs:
        start = f"regexp_replace({start}, '{pattern}', '{to}', 'g')"
    return start


_T1 = "trim(" + _nested([("\\n{3,}", "\n\n")], _nested([(" ?\\n ?", "\n")], _nested([("[ \\t\\f\\v]+", " "), ], _nested([("\\r\\n?", "\n")], "trim(text, ' ' || chr(9) || chr(10) || chr(13))")))) + ", ' ' || chr(10))"
_PUNCT = lambda x: _nested([("([,.!?;:])\\s*", "\\1 "), ("\\s+([,.!?;:])", "\\1")], f"translate({x}, '。，；：！？（）【】《》', '.,;:!?()[]<>')")
_SPECIAL = lambda x: _nested([("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", ""), ("[^\\x20-\\x7EÀ-ÿ\\n]", "")], x)
_T2 = f"trim({_SPECIAL(_PUNCT(_nested([('\\s+', ' '), ('-{3,}', ''), ('={3,}', '')])))})"


@query(f"select doc_id, {_T1} as clean from documents")
def t1_preprocess(s, d):
    return _texts(s, d, clean=T.preprocess(F.col("text")))


@query(f"select doc_id, {_T2} as clean from documents")
def t2_clean(s, d):
    return _texts(s, d, clean=T.clean(F.col("text"), LATIN))


@query("select doc_id, translate(text, '　＃＄％＆（）［］｛｝＂＇“”‘’', ' #$%&()[]{}\"''\"\"''''') as clean from documents")
def t3_half_width(s, d):
    return _texts(s, d, clean=T.half_width(F.col("text")))


_NOISE_SQL = [("(?m)^[^\\n]*[0-9]{1,2}/[0-9]{1,2}[^\\n]*$", ""), ("©[^\\n]*", ""), ("版权[^\\n]*", ""), ("https?://\\S+", ""), ("\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b", "")]


@query(f"select doc_id, {_nested(_NOISE_SQL[::-1])} as clean from documents")
def t4_remove_noise(s, d):
    return _texts(s, d, clean=T.remove_noise(F.col("text")))


@query(f"select doc_id, {_PUNCT('text')} as clean from documents")
def t5_punctuation(s, d):
    return _texts(s, d, clean=T.normalise_punctuation(F.col("text")))


@query(f"select doc_id, {_SPECIAL('text')} as clean from documents")
def t6_drop_special(s, d):
    return _texts(s, d, clean=T.drop_special(F.col("text"), LATIN))


@query(f"select doc_id, {_T2} as clean from documents")
def t7_clean_legal(s, d):
    return _texts(s, d, clean=T.clean_legal(F.col("text"), LATIN))


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[^a-zA-Z0-9\\sÀ-ÿ]', '', 'g'), '\\s+', ' ', 'g')) as clean from pages")
def t8_clean_for_analysis(s, d):
    return V.table(s, d, "pages").select("page_id", T.clean_for_analysis(F.col("html"), r"[^a-zA-Z0-9\sÀ-ÿ]").alias("clean"))


@query(r"""with m as (select doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n([A-F])', chr(10) || '# \1', 'g'), '\n([G-M])', chr(10) || '- \1', 'g'), '\n([N-P])', chr(10) || '```' || chr(10) || '\1', 'g') as t from documents),
l as (select doc_id, trim(line, ' ' || chr(9) || chr(13)) as line, i from (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from m)),
f as (select *, starts_with(line, '```') as fence, sum(starts_with(line, '```')::int) over (partition by doc_id order by i) as n from l),
g as (select doc_id, string_agg(case when n % 2 = 1 then line when starts_with(line, '#') then '标题: ' || trim(regexp_replace(line, '^#+', '')) when starts_with(line, '> ') then '引用: ' || trim(regexp_replace(line, '^>+', '')) when starts_with(line, '- ') or starts_with(line, '* ') then '• ' || trim(regexp_replace(line, '^[-*]+', '')) else line end, chr(10) order by i) filter (where not fence) as flat from f group by 1)
select doc_id, list_bool_or(list_transform(['# ','## ','```','> ','- ','* '], lambda k: contains(t[1:1000], k))) as is_markdown, coalesce(flat, '') as flat from m join g using (doc_id)""")
def t9_flatten_markdown(s, d):
    marked = F.regexp_replace(F.regexp_replace("text", "\n(?=[A-F])", "\n# "), "\n(?=[G-M])", "\n- ")
    marked = F.regexp_replace(marked, "\n(?=[N-P])", "\n```\n")
    return V.texts(s, d).select("doc_id", T.is_markdown(marked).alias("is_markdown"), T.flatten_markdown(marked).alias("flat"))


@query("""select doc_id, list_bool_or(list_transform(['# ','## ','```','> ','- ','* '], lambda m: contains(text[1:1000], m))) as is_markdown, list_bool_or(list_transform(['def ','class ','import ','from ','function ','var ','let ','const ','public ','private ','#include ','int main'], lambda m: contains(text[1:2000], m))) as is_code,
list_bool_or(list_transform(['die ','tion'], lambda m: contains(text[1:500], m))) as is_legal from documents""")
def t10_t11_document_kinds(s, d):
    t = F.col("text")
    return _texts(s, d, is_markdown=T.is_markdown(t), is_code=T.mark_code(t) != t, is_legal=T.is_legal(t, ("die ", "tion")))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), h as (select doc_id, length(line) < 50 and (regexp_matches(line, '^([1-5A-E]\\.|I\\.|II\\.|III\\.|IV\\.|V\\.)') or (upper(line) = line and lower(line) <> line and length(line) > 3)) as h from l)
select doc_id, count(*) filter (where h) as headings from h group by 1""")
def t12_headings(s, d):
    lines = V.texts(s, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_heading(F.col("line"))).alias("headings"))


@query("select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(replace(l, ' | ', ''), ' ' || chr(9) || chr(13)) <> ''), chr(10)) as table_text from documents")
def t13_table_text(s, d):
    rows = F.transform(F.split("text", "\n"), lambda line: F.split(line, r" \| ", -1))
    return _texts(s, d, table_text=T.table_text(rows))


@query("""select page_id, regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g') as safe, regexp_extract(url, '^(.*)/', 1) as directory, case when n < 1024 then printf('%.2f B', n / 1.0::double) else printf('%.2f KB', n / 1024.0::double) end as label
from (select *, length(html) as n from pages)""")
def t14_file_names(s, d):
    p = V.table(s, d, "pages")
    return p.select("page_id", T.safe_filename(F.col("url")).alias("safe"), T.split_path(F.col("url"))["directory"].alias("directory"), T.file_size_label(F.length("html")).alias("label"))


LATIN_CITATIONS = (r"([A-Z]\w+) (\w+)\.", r"([A-Z]\w+) ([a-z]+)\.")


def _spans_sql(patterns) -> str:
    """Matches and the places between them, pattern by pattern; of equal places the first pattern's."""
    every = []
    for k, p in enumerate(patterns):
        p = p.replace("\\w", "[\\wÀ-ÿ]")
        every.append(f"select doc_id, {k} as k, m[i] as text, g1[i] as law_name, g2[i] as article_number, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::int as begin from (select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(text, '{p}') as m, regexp_extract_all(text, '{p}', 1) as g1, regexp_extract_all(text, '{p}', 2) as g2, string_split_regex(text, '{p}') as parts from documents))")
    return f"with s as ({' union all '.join(every)}) select doc_id, text, begin, (begin + length(text))::int as finish, law_name, article_number from (select *, row_number() over (partition by doc_id, begin, length(text) order by k) as n from s) where n = 1"


@query(_spans_sql(LATIN_CITATIONS))
def e1_citations(s, d):
    found = V.texts(s, d).select("doc_id", F.explode(E.spans(F.col("text"), LATIN_CITATIONS)).alias("c"))
    return found.select("doc_id", "c.text", "c.begin", "c.finish", F.col("c.group1").alias("law_name"), F.col("c.group2").alias("article_number"))


@query("select doc_id, term, ((length(text) - length(replace(text, term, ''))) // length(term))::int as n from documents, (values ('tion'), ('the'), ('heit'), ('que'), ('ción'), ('ti')) t(term) where contains(text, term)")
def e2_term_counts(s, d):
    terms = s.createDataFrame([(t, "") for t in ("tion", "the", "heit", "que", "ción", "ti")], "term string, definition string")
    return E.term_counts(V.texts(s, d), terms)


_TERMS = (("tion", "ending"), ("the", "article"), ("heit", "ending"), ("que", "word"), ("ción", "ending"), ("ti", "letters"))


@query(f"""with t(term, definition) as (values {", ".join(f"('{a}', '{b}')" for a, b in _TERMS)}), p as (select doc_id, term, definition, string_split(text, term) as parts from documents, t where contains(text, term))
select doc_id, term, definition, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(term))::int as begin, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + i * length(term))::int as finish from (select *, unnest(range(1, len(parts))) as i from p)""")
def e2_term_occurrences(s, d):
    return E.term_occurrences(V.texts(s, d), s.createDataFrame(_TERMS, "term string, definition string"))


_LINES = "l as (select doc_id, trim(line, ' ' || chr(9) || chr(13)) as line, i - 1 as line_no from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where trim(line, ' ' || chr(9) || chr(13)) <> '')"


@query(f"""with {_LINES}, m as (select *, regexp_matches(line, '^[F-H].') as c, regexp_matches(line, '^[A-E].') as a from l where regexp_matches(line, '^[A-H].')),
n as (select *, c or sum(c::int) over (partition by doc_id order by line_no) = 0 as opens from m), k as (select *, sum(opens::int) over (partition by doc_id order by line_no) - 1 as section from n)
select doc_id, section::bigint as section, max(case when opens then case when c then 'chapter' else 'article' end end) as type, max(case when opens then trim(substring(line, 2)) end) as title, min(line_no)::bigint as start_line, count(*) filter (where not opens) as articles from k group by 1, 2""")
def e3_structure(s, d):
    out = E.structure(V.texts(s, d), ("^[F-H](.+)$",), ("^[A-E](.+)$",))
    return out.withColumn("articles", F.size("articles").cast("long")).withColumn("start_line", F.col("start_line").cast("long"))


@query("select doc_id, array_to_string(list_concat(regexp_extract_all(text, 'the [^.]*'), regexp_extract_all(text, 'die [^.]*')), '|') as phrases from documents")
def e4_key_phrases(s, d):
    return _texts(s, d, phrases=F.array_join(E.key_phrases(F.col("text"), ("the [^.]*", "die [^.]*")), "|"))


_ENT = {"date": r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", "phone": r"1[3-9]\d{9}", "email": r"[A-Za-z0-9]+@[A-Za-z0-9]+\.[A-Za-z0-9]+", "id_card": r"\d{17}[\dXx]"}


@query(" union all ".join(f"select doc_id, '{k}' as entity_type, unnest(regexp_extract_all(text, '{p}')) as entity_value, 0.8::double as confidence from documents" for k, p in _ENT.items()))
def e5_entities(s, d):
    return V.texts(s, d).select("doc_id", F.inline(E.entities(F.col("text"), _ENT)))


_KEYS = {"en": ("tion", "the ", "ing"), "de": ("heit", "und ", "die "), "romance": ("que ", "la ", "tion")}


@query("""with k as (select doc_id, list_filter(['tion','the ','ing','heit','und ','die ','que ','la '], lambda k: contains(text, k)) as w, text from documents)
select doc_id, array_to_string(list_concat(w, list_filter([case when contains(text, 'tion') or contains(text, 'the ') or contains(text, 'ing') then 'en' end, case when contains(text, 'heit') or contains(text, 'und ') or contains(text, 'die ') then 'de' end, case when contains(text, 'que ') or contains(text, 'la ') or contains(text, 'tion') then 'romance' end], lambda x: x is not null)), ',') as elements from k""")
def e6_legal_elements(s, d):
    return _texts(s, d, elements=F.array_join(E.legal_elements(F.col("text"), _KEYS), ","))


@query("""with w as (select id, regexp_extract_all(content, '[0-9]+') as a, regexp_extract_all(content, '[A-Z][a-z]+') as b from m_msg)
select id, len(a) + len(list_distinct(list_filter(b, lambda x: not list_contains(a, x)))) as n from w""")
def e7_merge_entities(s, d):
    a, b = [F.regexp_extract_all("content", F.lit(p), F.lit(0)) for p in ("[0-9]+", "[A-Z][a-z]+")]
    return V.messages(s, d).select("id", F.size(E.merge_entities(a, b)).cast("long").alias("n"))


def _replies(s, d):
    """Model replies made of each message: every seventh broken, every fifth wrapped in prose."""
    i, m = F.col("id"), V.messages(s, d)
    json = F.concat(
        F.lit('{"is_legal_related": '), F.when(i % 3 == 0, "false").otherwise("true"), F.lit(', "legal_category": "'), V._pick(i % 4, "labor", "tort", "civil", "nonsense"),
        F.lit('", "confidence": '), F.format_string("%.2f", (i % 150) / 100.0), F.lit(', "reasoning": "because", "suggested_topics": ["a", "b", "c", "d", "e", "f"], "core_issue": "issue '), i.cast("string"), F.lit('"}'),
    )
    reply = F.when(i % 7 == 0, F.lit("{broken")).when(i % 5 == 0, F.concat(F.lit("Sure: "), json, F.lit(" Done."))).otherwise(json)
    return m.withColumn("reply", reply)


_INTENT = """select id, case when id % 7 = 0 then true else id % 3 <> 0 end as is_legal_related, case when id % 7 = 0 then 'other' else case id % 4 when 0 then '劳动' when 1 then '侵权' when 2 then '民事' end end as legal_category,
case when id % 7 = 0 then 0.5 else least(round((id % 150) / 100.0::double, 2), 1) end::double as confidence, case when id % 7 = 0 then '' else 'a,b,c,d,e' end as suggested_topics, case when id % 7 = 0 then '' else 'because' end as reasoning from m_msg"""


@query(_INTENT)
def e8_parse_intent(s, d):
    return _replies(s, d).select("id", E.parse_intent(F.col("reply")).alias("i")).select("id", "i.*").withColumn("suggested_topics", F.array_join("suggested_topics", ","))


@query("select id, case when id % 7 = 0 then content else 'issue ' || id end as core_issue, content as query_for_retrieval from m_msg")
def e9_parse_analysis(s, d):
    return _replies(s, d).select("id", E.parse_analysis(F.col("reply"), F.col("content")).alias("a")).select("id", "a.core_issue", "a.query_for_retrieval")


@query(f"select id from ({_INTENT}) where is_legal_related and confidence > 0.7")
def e10_legal_queries(s, d):
    return _replies(s, d).where(E.is_legal_query(E.parse_intent(F.col("reply")))).select("id")


@query("select id, case when regexp_matches(content, '(?i)(heit|tion of)') then 'first' when regexp_matches(content, '(?i)(que|the.*ing)') then 'second' else 'general' end as kind from m_msg")
def e11_question_type(s, d):
    return V.messages(s, d).select("id", E.question_type(F.col("content"), (("first", "heit|tion of"), ("second", "que|the.*ing"))).alias("kind"))


@query("""with n as (select doc_id, text, length(text) as len, greatest(1, ceil((length(text) - 100) / 900.0))::int as n from documents where length(text) > 0)
select doc_id as document_id, i::int as chunk_index, substring(text, i * 900 + 1, 1000) as content, (i * 900)::int as start, least(i * 900 + 1000, len)::int as finish from (select *, unnest(range(0, n))::int as i from n)""")
def c1_fixed_size(s, d):
    return C.fixed_size(V.texts(s, d))


_TRIM = "trim(p, ' ' || chr(9) || chr(10) || chr(13))"


def _packed(pieces: str, least: int = 0, keys: str = "doc_id", most: int = 1000) -> str:
    """Sentences ``s`` (keys, i, p) of the unnested ``pieces`` packed up to ``most`` characters: f (keys, i, now, chunk)."""
    on = " and ".join(f"s.{k} = f.{k}" for k in keys.split(", "))
    fits = f"f.now + length(s.p) + 1 <= {most} or f.now < {least}"
    own = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""with recursive u as ({pieces}), s as (select {keys}, {_TRIM} as p, row_number() over (partition by {keys} order by i) as i from u where {_TRIM} <> ''),
f as (select {keys}, i, length(p) as now, 0 as chunk from s where i = 1 union all select {own}, s.i, case when {fits} then f.now + 1 + length(s.p) else length(s.p) end, case when {fits} then f.chunk else f.chunk + 1 end from f join s on {on} and s.i = f.i + 1)"""


@query(_packed(r"select doc_id, unnest(string_split_regex(text, '[.!?\n]')) as p, generate_subscripts(string_split_regex(text, '[.!?\n]'), 1) as i from documents", 200) + """, e as (select doc_id, max(chunk) as chunk, max_by(now, i) as now from f group by 1)
select s.doc_id as document_id, f.chunk::int as chunk_index, string_agg(p, ' ' order by s.i) as content, null::varchar as section_title from s join f using (doc_id, i) left join e on e.doc_id = s.doc_id and e.chunk = f.chunk and e.now < 200 where e.chunk is null group by 1, 2""")
def c2_semantic(s, d):
    return C.semantic(V.texts(s, d), ends=".!?\n")


def _plain_sql(ends: str) -> str:
    """Sentences s with their marks and their chunks f."""
    found = f"regexp_extract_all(text, '[^{ends}]*[{ends}]|[^{ends}]+')"
    return _packed(f"select doc_id, unnest({found}) as p, generate_subscripts({found}, 1) as i from documents")


@query(_plain_sql(r".!?\n") + """
select s.doc_id as document_id, f.chunk::int as chunk_index, string_agg(p, ' ' order by s.i) as content, null::varchar as section_title from s join f using (doc_id, i) group by 1, 2""")
def c3_plain_semantic(s, d):
    return C.plain_semantic(V.texts(s, d), ends=".!?\n")


_CLAUSES = ("^[A-E]",)
_CHAPTERS = ("^[F-H]",)
def _islands_sql(clauses: str, chapters: str) -> str:
    """Lines k with the island, the clause, that they are in."""
    return f"""with recursive {_LINES}, m as (select *, regexp_matches(line, '{chapters}') as c from l), n as (select *, sum(c::int) over w as cn, coalesce(last_value(case when c then line end ignore nulls) over w, '') as chapter from m window w as (partition by doc_id order by line_no)),
b as (select *, regexp_matches(line, '{clauses}') or lag(cn, 1, -1) over (partition by doc_id order by line_no) <> cn as opens from n where not c), k as (select *, sum(opens::int) over (partition by doc_id order by line_no) as island from b)"""


_ISLANDS = _islands_sql("^[A-E]", "^[F-H]")


@query(f"{_ISLANDS} select doc_id as document_id, (row_number() over (partition by doc_id order by island) - 1)::int as chunk_index, string_agg(line, chr(10) order by line_no) as content, arg_min(line, line_no) as section_title, max(chapter) as chapter from k group by doc_id, island")
def c4_legal_clauses(s, d):
    islands = C.legal_islands(V.texts(s, d), clauses=_CLAUSES, chapters=_CHAPTERS)
    return C._indexed(islands, ["island"]).select("document_id", "chunk_index", "content", "section_title", "chapter")


# lines of clauses over 1200 characters: g numbers the groups of lines, o marks a line that is cut into sentences
_LONG = f"""g0 as (select doc_id, island, max(chapter) as chapter, arg_min(line, line_no) as title, sum(length(line)) + count(*) - 1 as size from k group by 1, 2),
q as (select k.doc_id, k.island, line, row_number() over (partition by k.doc_id, k.island order by line_no) as i from k join g0 using (doc_id, island) where size > 1200),
g as (select doc_id, island, i, line, case when length(line) + 2 <= 1200 then length(line) else 0 end as now, 1 as seg, length(line) + 2 > 1200 as o from q where i = 1
union all select q.doc_id, q.island, q.i, q.line, case when fits and g.now > 0 then g.now + 2 + length(q.line) when fits or g.now > 0 then length(q.line) else 0 end, case when fits and g.now > 0 then g.seg else g.seg + 1 end, not fits and g.now = 0
from (select g.*, q.line as next, q.i as at, g.now + length(q.line) + 2 <= 1200 as fits from g join q on q.doc_id = g.doc_id and q.island = g.island and q.i = g.i + 1) g join q on q.doc_id = g.doc_id and q.island = g.island and q.i = g.at),
t as ({_packed("select doc_id, island, seg, unnest(string_split_regex(line, '[。！？!?]')) as p, generate_subscripts(string_split_regex(line, '[。！？!?]'), 1) as i from g where o", keys="doc_id, island, seg", most=1200)}
select doc_id, island, seg, f.chunk, string_agg(p, ' ' order by s.i) as content, '句子组' as kind from s join f using (doc_id, island, seg, i) group by 1, 2, 3, 4),
z as (select * from t union all select doc_id, island, seg, 0, string_agg(line, chr(10) || chr(10) order by i), '分段' from g where not o group by 1, 2, 3),
y as (select doc_id, island, 0 as seg, 0 as chunk, string_agg(line, chr(10) order by line_no) as content, arg_min(line, line_no) as section_title, max(k.chapter) as chapter from k join g0 using (doc_id, island) where size <= 1200 group by 1, 2
union all select doc_id, island, seg, chunk, content, title || ' - ' || kind || row_number() over (partition by doc_id, island order by seg, chunk), chapter from z join g0 using (doc_id, island))"""


@query(f"{_ISLANDS}, {_LONG} select doc_id as document_id, (row_number() over (partition by doc_id order by island, seg, chunk) - 1)::int as chunk_index, content, section_title, chapter from y")
def c5_legal(s, d):
    return C.legal(V.texts(s, d), clauses=_CLAUSES, chapters=_CHAPTERS)


@query(f"""with {_LINES}, k as (select *, sum(regexp_matches(line, '^[A-E]')::int) over (partition by doc_id order by line_no) as island from l)
select doc_id as document_id, (row_number() over (partition by doc_id order by island) - 1)::int as chunk_index, string_agg(line, chr(10) order by line_no) as content, case when island = 0 then '前言' else arg_min(line, line_no) end as section_title from k group by doc_id, island""")
def c6_simple_legal(s, d):
    return C.simple_legal(V.texts(s, d), _CLAUSES)


@query("""with p as (select doc_id, unnest(string_split(t, chr(10) || '# ')) as sec, generate_subscripts(string_split(t, chr(10) || '# '), 1) as i from (select doc_id, replace(text, chr(10) || 'T', chr(10) || '# T') as t from documents)),
b as (select doc_id, i, case when i = 1 then sec when strpos(sec, chr(10)) = 0 then '' else substring(sec, strpos(sec, chr(10)) + 1) end as content, case when i = 1 then '前言' else trim(string_split(sec, chr(10))[1], ' ' || chr(9) || chr(13)) end as section_title from p)
select doc_id as document_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, content, section_title from b where trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def c7_markdown(s, d):
    return C.markdown(V.texts(s, d).withColumn("text", F.replace(F.col("text"), F.lit("\nT"), F.lit("\n# T"))))


_PAGES = "(select doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) as line, generate_subscripts(string_split(text, chr(10)), 1) as page from documents)"
_PIECES = "case when length(line) <= 1000 then [line] else regexp_extract_all(line, '[^。！？!?.]*[。！？!?.]|[^。！？!?.]+') end"


@query(_packed(f"select doc_id, page, unnest({_PIECES}) as p, generate_subscripts({_PIECES}, 1) as i from {_PAGES}", keys="doc_id, page") + """
select doc_id as document_id, (row_number() over (partition by doc_id order by page, chunk) - 1)::int as chunk_index, content, page::int as page_number from (select s.doc_id, s.page, f.chunk, string_agg(p, ' ' order by s.i) as content from s join f using (doc_id, page, i) group by 1, 2, 3)""")
def c8_pages(s, d):
    paged = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("--- 第"), (i + 1).cast("string"), F.lit("页 ---\n"), line)), "\n")
    return C.pages(V.texts(s, d).withColumn("text", paged))


_PARAGRAPHS = f"""with {_LINES}, h as (select *, length(line) < 50 and (regexp_matches(line, '^(第|章|节|条|款|项|一、|二、|三、|四、|五、|[1-5A-E]\\.|I\\.|II\\.|III\\.|IV\\.|V\\.)') or (upper(line) = line and lower(line) <> line and length(line) > 3)) as heading from l),
k as (select *, last_value(case when heading then line end ignore nulls) over w as title, sum((heading or starts_with(line, '[表格]'))::int) over w as island from h window w as (partition by doc_id order by line_no)),
g as (select doc_id, island, string_agg(line, chr(10) order by line_no) as t, max(title) as section_title from k group by 1, 2), n as (select *, greatest(1, ceil(length(t) / 1000.0))::int as n from g)
select doc_id as document_id, (row_number() over (partition by doc_id order by island, i) - 1)::int as chunk_index, substring(t, i * 1000 + 1, 1000) as content, section_title, n > 1 as is_truncated from (select *, unnest(range(0, n))::int as i from n)"""


@query(_PARAGRAPHS)
def c9_paragraphs(s, d):
    return C.paragraphs(V.texts(s, d))


def _recursive_sql(size: int = 1000, overlap: int = 200) -> str:
    """Chunks w (document_id, chunk_index, content) of the recursive splitter.

    n splits texts at the first separator that occurs, level by level; r holds the runs of small neighbours under one
    parent with the prefix sums of their lengths; m walks from one chunk of a run to the next.
    """
    seps = ["chr(10)", "'。'", "'！'", "'？'", "' '"]
    level = "case when lvl <= 1 and contains(text, chr(10) || chr(10)) then 1 " + " ".join(f"when lvl <= {k} and contains(text, {x}) then {k}" for k, x in enumerate(seps, 2)) + " else 7 end"
    # a mark before each separator; before a line end only if another one follows, where two make the separator
    double = r"regexp_replace(replace(text, chr(10), chr(1) || chr(10)), '\x01\n([^\x01]|$)', chr(10) || '\1', 'g')"
    marked = f"case j when 1 then {double} " + " ".join(f"when {k} then replace(text, {x}, chr(1) || {x})" for k, x in enumerate(seps, 2)) + " end"
    return f"""with recursive n as (select doc_id, []::int[] as path, text, 1 as lvl, false as leaf from documents where text <> ''
union all select doc_id, list_append(path, i::int), part, j + 1, length(part) <= {size} or j = 7 from (select doc_id, path, j, unnest(parts) as part, generate_subscripts(parts, 1) as i from
(select doc_id, path, j, list_filter(case when j = 7 then regexp_extract_all(text, '(?s).') else string_split({marked}, chr(1)) end, lambda x: x <> '') as parts from (select *, {level} as j from n where not leaf)))),
k as (select doc_id, path, text, leaf, path[:-2] as parent, sum((not leaf)::int) over (partition by doc_id, path[:-2] order by path) as run from n where len(path) > 0),
r as (select row_number() over () as rid, * from (select doc_id, min(path) as path, list(text order by path) as parts, list_prepend(0, list(c order by path)) as c from
(select *, sum(length(text)) over (partition by doc_id, parent, run order by path)::bigint as c from k where leaf) group by doc_id, parent, run)),
e as (select rid, 1 as chunk, 1 as s, len(list_filter(c, lambda x: x <= {size})) - 1 as e from r
), m as (select * from e union all select rid, chunk + 1, s, len(list_filter(c, lambda x: x <= c[s] + {size})) - 1 from
(select m.rid, chunk, c, len(list_filter(c, lambda x: x < greatest(c[m.e + 1] - {overlap}, c[m.e + 2] - {size}))) + 1 as s from m join r using (rid) where m.e < len(parts))),
w as (select doc_id as document_id, (row_number() over (partition by doc_id order by path, chunk) - 1)::int as chunk_index, content from
(select doc_id, path, chunk, trim(array_to_string(parts[s:e], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as content from m join r using (rid)) where content <> '')"""


@query(_recursive_sql() + " select document_id, chunk_index, content, null::varchar as section_title from w")
def c10_recursive(s, d):
    return C.recursive(V.texts(s, d))


def _dispatch_sql() -> str:
    """Chunks of each document by the strategy of its name or its text."""
    clauses, chapters = ("|".join(p).replace(r"(?U:\s)", r"\s").replace(r"(?U:\s+)", r"\s+") for p in (C.CLAUSE_STARTS, C.CHAPTERS))
    legal = " or ".join(f"contains(substring(text, 1, 500), '{m}')" for m in T.LEGAL_MARKERS)
    ends = "。！？!?."
    pages = f"""with recursive {_LINES}, q as (select doc_id, line, row_number() over (partition by doc_id order by line_no) as i from l join documents using (doc_id) where length({_TRIM.replace("p,", "text,")}) > 1000),
g as (select doc_id, i, line, case when length(line) <= 1000 then length(line) else 0 end as now, 1 as seg, length(line) > 1000 as o from q where i = 1
union all select q.doc_id, q.i, q.line, case when g.now > 0 and g.now + length(q.line) + 1 <= 1000 then g.now + 1 + length(q.line) when length(q.line) <= 1000 then length(q.line) else 0 end, case when g.now > 0 and g.now + length(q.line) + 1 <= 1000 then g.seg else g.seg + 1 end, length(q.line) > 1000 from g join q on q.doc_id = g.doc_id and q.i = g.i + 1),
t as ({_packed(f"select doc_id, seg, unnest(regexp_extract_all(line, '[^{ends}]*[{ends}]|[^{ends}]+')) as p, generate_subscripts(regexp_extract_all(line, '[^{ends}]*[{ends}]|[^{ends}]+'), 1) as i from g where o", keys="doc_id, seg")} select distinct doc_id, seg, chunk from f)
select doc_id, count(*) as chunks from (select doc_id, seg, chunk from t union all select distinct doc_id, seg, 0 from g where not o union all select doc_id, 0, 0 from documents where length({_TRIM.replace("p,", "text,")}) between 1 and 1000) group by 1"""
    sections = """with p as (select doc_id, unnest(string_split(text, chr(10) || '# ')) as sec, generate_subscripts(string_split(text, chr(10) || '# '), 1) as i from documents)
select doc_id, count(*) as chunks from p where trim(case when i = 1 then sec when strpos(sec, chr(10)) = 0 then '' else substring(sec, strpos(sec, chr(10)) + 1) end, ' ' || chr(9) || chr(10) || chr(13)) <> '' group by 1"""
    return f"""with st as (select id as doc_id, case when filename like '%.md' then 'markdown' when filename like '%.pdf' then 'pages' when filename like '%.docx' then 'paragraphs' when {legal} then 'legal' else 'semantic' end as strategy from m_docs),
c as (select 'markdown' as strategy, * from ({sections}) union all select 'pages', * from ({pages}) union all select 'paragraphs', document_id, count(*) from ({_PARAGRAPHS}) group by 2
union all select 'legal', doc_id, count(*) from ({_islands_sql(clauses, chapters)}, {_LONG} select * from y) group by 2 union all select 'semantic', doc_id, max(chunk) + 1 from ({_plain_sql("。!?" + chr(92) + "n")} select * from f) group by 2)
select strategy, doc_id as document_id, chunks::bigint as chunks from st join c using (doc_id, strategy)"""


@query(_dispatch_sql())
def c11_dispatch(s, d):
    return C.dispatch(C.choose_strategy(V.documents(s, d).select("document_id", "filename", "text"))).groupBy("strategy", "document_id").agg(F.count("*").alias("chunks"))


@query("""select document_id, chunk_index, source, case when document_id % 2 = 0 then 'doc' else 'chunk' end as owner, p.first as primary_image from m_items i left join (select doc_id, source from documents) d on d.doc_id = i.document_id
left join (select l_orderkey as k, arg_min('img' || l_linenumber, l_linenumber) as first from lineitem group by 1) p on p.k = i.document_id and i.chunk_index = 0""")
def c12_metadata(s, d):
    pair = lambda k, v: F.create_map(F.lit(k), v)
    chunks = V.items(s, d).select("document_id", "chunk_index", F.when(F.col("chunk_index") == 0, 1).otherwise(2).alias("page_number"), pair("owner", F.lit("chunk")).alias("metadata"))
    docs = V.documents(s, d).select("document_id", F.when(F.col("id") % 2 == 0, F.map_concat(pair("source", F.col("source")), pair("owner", F.lit("doc")))).otherwise(pair("source", F.col("source"))).alias("metadata"))
    li = V.table(s, d, "lineitem")
    images = li.select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("image_index"), F.concat(F.lit("img"), F.col("l_linenumber").cast("string")).alias("url"))
    out = C.with_metadata(chunks, docs, images)
    return out.select("document_id", "chunk_index", F.col("metadata")["source"].alias("source"), F.col("metadata")["owner"].alias("owner"), "primary_image")


@query("""with b as (select l_orderkey as document_id, l_linenumber as image_index, l_partkey % 60 - 10.0::double as x0, l_suppkey % 40 - 5.0::double as y0, l_quantity as x1, l_quantity * 2 as y1 from lineitem)
select document_id, image_index, greatest(x0, 0) as x0, greatest(y0, 0) as y0, least(x1, 40) as x1, least(y1, 30) as y1 from b where greatest(x0, 0) < least(x1, 40) and greatest(y0, 0) < least(y1, 30)""")
def c13_image_boxes(s, d):
    li = V.table(s, d, "lineitem")
    box = (F.col("l_partkey") % 60 - 10.0, F.col("l_suppkey") % 40 - 5.0, F.col("l_quantity"), F.col("l_quantity") * 2)
    by_list = F.col("l_linenumber") % 2 == 0
    images = li.select(
        F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.col("l_linenumber").alias("image_index"), F.when(by_list, F.array(*box)).otherwise(F.array().cast("array<double>")).alias("bbox"),
        *[F.when(~by_list, c).alias(n) for c, n in zip(box, ("x0", "y0", "x1", "y1"))], F.lit(40.0).alias("width"), F.lit(30.0).alias("height"),
    )
    return C.image_boxes(images).select("document_id", "image_index", "x0", "y0", "x1", "y1")


_NEXT = "with i as (select a.id, a.vector, b.vector as other from m_items a join m_items b on b.id = a.id + 1)"


def _pairs(s, d):
    """Each vector beside the next one by id."""
    i = V.items(s, d)
    return i.select("id", "vector").join(i.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id")


@query(f"{_NEXT} select id, round(list_cosine_similarity(vector, other), 6) as cosine from i where other is not null")
def v1_cosine(s, d):
    return _pairs(s, d).select("id", F.round(N.cosine(F.col("vector"), F.col("other")), 6).alias("cosine"))


_TOP = "h as (select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from (select query_id, i.id, round(list_dot_product(q.vector, i.vector), 9) as score from m_q q, m_items i))"


@query(f"with {_TOP} select query_id, id, round(score, 6) as score, rank::int as rank from h where rank <= 5")
def v2_top_k(s, d):
    return N.top_k(V.queries(s, d), V.item_vectors(s, d), 5).withColumn("score", F.round("score", 6))


@query("""with h as (select query_id, i.id, round(list_cosine_similarity(q.vector, i.vector), 9) as score, title, row_number() over (partition by query_id order by round(list_cosine_similarity(q.vector, i.vector), 9) desc, i.id) as rank from m_q q, m_items i join m_docs d on d.id = i.document_id where d.user_id = 3)
select query_id, id, round(score, 6) as score, title as document_title from h where rank <= 5 and score >= 0.1""")
def v3_filtered_top_k(s, d):
    out = N.filtered_top_k(V.queries(s, d), _stored_vectors(s, d), V.documents(s, d).select("id", "title", "user_id"), 5, user_id=3, min_similarity=0.1)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "document_title")


@query(f"with {_TOP} select query_id, id, round(score, 6) as score from h where rank <= 10 and score >= 0.35")
def v4_candidates(s, d):
    return N.candidates(V.queries(s, d), V.item_vectors(s, d), 5, 0.35).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""with {_TOP} select query_id, h.id, round(least(greatest(score, 0), 1), 6) as score, case when i.document_id % 3 = 0 then '未知文档' else source || '-' || doc_id end as document_title from h join m_items i on i.id = h.id left join documents on doc_id = i.document_id where rank <= 10 and score >= 0.35 and score <= 1.000001""")
def v5_typed_hits(s, d):
    titles = V.documents(s, d).where("id % 3 <> 0").select("document_id", "document_title")
    items = _stored_vectors(s, d)
    hits = N.candidates(V.queries(s, d), items, 5, 0.35).join(items.select("id", "document_id"), "id")
    return N.typed_hits(hits, titles).select("query_id", "id", F.round("score", 6).alias("score"), "document_title")


@query(f"with {_TOP} select q.query_id, count(h.id) as hits from m_q q left join (select * from h where rank <= 10 and score >= 0.9999) h on h.query_id = q.query_id group by 1")
def v6_batch_retrieve(s, d):
    q = V.queries(s, d)
    return N.per_query(q, N.candidates(q, V.item_vectors(s, d), 5, 0.9999)).groupBy("query_id").agg(F.count("id").alias("hits"))


def _index(s, d):
    """Queries, the chunk table, and the index of it."""
    q, i = V.queries(s, d), _stored_vectors(s, d)
    return q, i, I.build(i, new_path(s, "index"))


@query()
def v7_ivf_recall(s, d):
    """Recall of the index against exact search, all items indexed; probes as a sample of queries needs them; and how many
    of all files and pairs the search reads and scores."""
    q, i, index = _index(s, d)
    probes = I.probes_for(index, q, i, 10)
    told = I.cost(index, q, probes)
    return N.recall(I.search(index, q, 10, probes), N.top_k(q, i, 10, "cosine")).select("*", *[F.lit(v).alias(k) for k, v in told.items()])


@query()
def v7_codes_recall(s, d):
    """The same, scored by codes first, and the bytes of a code and a vector."""
    q, i, index = _index(s, d)
    found = N.recall(I.search_codes(index, q, 10, I.probes_for(index, q, i, 10)), N.top_k(q, i, 10, "cosine"))
    stored = index.items().agg(F.max(F.length("code")).alias("code_bytes"), F.max(4 * F.size("vector")).alias("vector_bytes"))
    return found.crossJoin(stored)  # a row each


@query("with h as (select query_id, i.id, row_number() over (partition by query_id order by round(list_cosine_similarity(q.vector, i.vector), 9) desc, i.id) as rank, round(list_cosine_similarity(q.vector, i.vector), 6) as score from m_q q, m_items i) select query_id, id, score, rank::int as rank from h where rank <= 10")
def v7_ivf_all_cells(s, d):
    """With all cells probed the index finds what exact search does."""
    q, _, index = _index(s, d)
    return I.search(index, q, 10, len(index.sizes)).withColumn("score", F.round("score", 6))


@query(f"{_NEXT} select id, round(1 / (1 + list_distance(vector, other)), 6) as euclidean, round(0.7 * list_cosine_similarity(vector, other) + 0.3 / (1 + list_distance(vector, other)), 6) as hybrid from i where other is not null")
def v8_similarities(s, d):
    v, o = F.col("vector"), F.col("other")
    return _pairs(s, d).select("id", F.round(N.euclidean_similarity(v, o), 6).alias("euclidean"), F.round(N.hybrid_similarity(v, o), 6).alias("hybrid"))


@query("""with t as (select doc_id, list_filter(['tion','the','heit','que','ing'], lambda k: contains(text, k)) as terms from documents), p as (select a.doc_id, a.terms, b.terms as other from t a join t b on b.doc_id = a.doc_id + 1)
select doc_id, round(0.5 * (1 + 0.3 * case when len(terms) = 0 or len(other) = 0 then 0 else len(list_intersect(terms, other)) / len(list_distinct(list_concat(terms, other))) end), 6) as similarity from p where other is not null""")
def v9_legal_similarity(s, d):
    terms = F.filter(F.array(*[F.lit(k) for k in ("tion", "the", "heit", "que", "ing")]), lambda k: F.contains("text", k))
    t = V.texts(s, d).select("doc_id", terms.alias("terms"))
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("terms").alias("other")), "doc_id")
    return p.select("doc_id", F.round(N.legal_similarity(F.lit(0.5), F.col("terms"), F.col("other")), 6).alias("similarity"))


_WORDS = "regexp_extract_all(lower({}), '[a-zà-ÿ0-9]+')"
_BM25 = f"""a as (select distinct query_id, unnest({_WORDS.format('query_text')}) as term from m_q), t as (select doc_id, {_WORDS.format('text')} as w from documents), z as (select count(*) as n, avg(len(w)) as average from t),
tf as (select doc_id, term, count(*) as tf, max(length) as length from (select doc_id, unnest(w) as term, len(w) as length from t) where term in (select term from a) group by 1, 2), df as (select term, count(*) as df from tf group by 1),
s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) as score from tf join df using (term) join a using (term) cross join z group by 1, 2),
k as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s)"""


def _bm25(s, d, top):
    return N.bm25(V.queries(s, d), V.texts(s, d), top, pattern="[a-zà-ÿ0-9]+")


@query(f"with {_BM25} select query_id, doc_id as document_id, score from k where rank <= 10")
def v10_bm25(s, d):
    return _bm25(s, d, 10).select("query_id", "document_id", "score")


def _word_index(s, d):
    """The documents' index, written in two batches."""
    index = K.Index(s, new_path(s, "words"), "[a-zà-ÿ0-9]+")
    for batch in (0, 1):
        index.add(V.texts(s, d).where(F.col("doc_id") % 2 == batch), str(batch))
    return index


@query(f"with {_BM25} select query_id, doc_id as document_id, score from k where rank <= 10")
def v10_indexed(s, d):
    return K.search(_word_index(s, d), V.queries(s, d), 10).select("query_id", "document_id", "score")


@query()
def v10_index_cost(s, d):
    """Blocks and postings that the search opens, of all that its terms have."""
    return K.cost(_word_index(s, d), V.queries(s, d), 10)


@query(f"""with {_TOP}, {_BM25}, kw as (select query_id, doc_id as id, 1 - (rank - 1) / count(*) over (partition by query_id) as keyword from k where rank <= 10), v as (select query_id, document_id as id, max(score) as score from h join m_items i on i.id = h.id where rank <= 10 group by 1, 2),
f as (select coalesce(v.query_id, kw.query_id) as query_id, coalesce(v.id, kw.id) as id, round(0.7 * coalesce(score, 0) + 0.3 * coalesce(keyword, 0), 6) as score from v full join kw on v.query_id = kw.query_id and v.id = kw.id)
select query_id, id, score from (select *, row_number() over (partition by query_id order by score desc, id) as r from f) where r <= 10""")
def v11_fuse(s, d):
    """Documents by their best chunk and by their words."""
    words = _bm25(s, d, 10).withColumnRenamed("document_id", "id")
    i = _stored_vectors(s, d)
    hits = N.top_k(V.queries(s, d), i, 10).join(i.select("id", "document_id"), "id")
    return N.fuse(N.best_of_document(hits), words, 10).select("query_id", "id", "score")


@query("select doc_id, round(0.5 * 0.9 + 0.2 * (doc_id % 10) / 10.0::double + 0.15 * (doc_id % 7) / 7.0::double + 0.05 * least(case when contains(lower(text), 'tion') then 0.3 else 0 end + case when contains(lower(text), 'heit') then 0.2 else 0 end, 1), 6) as score from documents")
def v12_ranking(s, d):
    i = F.col("doc_id")
    factors = {"similarity": F.lit(0.9), "freshness": (i % 10) / 10.0, "quality": (i % 7) / 7.0, "legal_importance": N.legal_importance(F.col("text"), (("tion", 0.3), ("heit", 0.2)))}
    return _texts(s, d, score=F.round(N.ranking_score(factors), 6))


@query(r"""with w as (select id, unnest(list_filter(string_split_regex(content, '[\s\x0B\x1C-\x1F]+'), lambda w: w <> '')) as w from m_items),
h as (select id, ('0x' || left(md5(w), 8))::bigint as h from w),
v as (select id, h % 64 as place, sum(case when h // 2147483648 = 1 then 1 else -1 end) as x from h group by 1, 2),
n as (select id, sqrt(sum(x * x)) as norm, sum(x * (place + 1)) as checksum from v group by 1)
select i.id, 64 as width, true as ok, round(coalesce(checksum / greatest(norm, 1e-12), 0), 6) as checksum, round(coalesce(case when norm > 0 then 1.0 else 0.0 end, 0), 6)::double as norm from m_items i left join n using (id)""")
def v13_embed(s, d):
    """The vectors' values, told by their length and by a sum weighted by place."""
    out = N.embed(V.items(s, d).select("id", "content"), N.hashing_embedder())
    v = F.col("embedding")
    place = F.transform(v, lambda x, i: x * (i + 1))
    return out.select("id", F.size(v).alias("width"), F.col("error").isNull().alias("ok"), F.round(F.aggregate(place, F.lit(0.0), lambda a, x: a + x), 6).alias("checksum"), F.round(N.norm(v), 6).alias("norm"))


@query("""with t as (select id, conversation_id, ceil(length(content) / 4.0)::bigint as tokens from m_msg), r as (select *, sum(tokens) over (partition by conversation_id order by id) as running from t)
select id, tokens, ((running - 1) // 300)::int as batch from r""")
def v14_token_batches(s, d):
    return N.token_batches(V.messages(s, d), "conversation_id", "id", 300).select("id", "tokens", "batch")


def _stored_vectors(s, d):
    """The chunk table without content, written once for a job that reads it more than once."""
    return materialise(V.item_vectors(s, d), "items")


def _hits(s, d, n=10, *more):
    """Hits with what the documents and queries tell of them; ``more``: further columns of items. Only documents that have a hit are cut."""
    i = _stored_vectors(s, d)
    hits = materialise(N.top_k(V.queries(s, d), i, n).join(i.select("id", "document_id", *more), "id"), "hits")
    contents = V.contents(s, d, hits)
    named = hits.join(contents, "id").join(V.queries(s, d).select("query_id", "query_text"), "query_id")
    return named.join(V.documents(s, d).select("document_id", "document_title"), "document_id", "left")


_HITS = f"{_TOP}, hits as (select h.*, i.document_id, i.content, q.query_text, coalesce(source || '-' || doc_id, '') as document_title from h join m_items i on i.id = h.id join m_q q on q.query_id = h.query_id left join documents on doc_id = i.document_id where rank <= 10)"


@query(f"with {_HITS} select query_id, id from (select *, row_number() over (partition by query_id, content order by rank) as n from hits) where n = 1")
def r1_dedup_exact(s, d):
    return R.dedup_exact(_hits(s, d)).select("query_id", "id")


@query()
def r2_dedup_text(s, d):
    return R.dedup_greedy(_hits(s, d)).select("query_id", "id", "rank")


@query(f"""with recursive {_HITS}, x as (select query_id, hits.id, rank, vector from hits join m_items using (id)),
f as (select query_id, id, rank, true as keep, [vector] as kept from x where rank = 1 union all select x.query_id, x.id, x.rank, not list_bool_or(list_transform(kept, lambda k: list_cosine_similarity(k, x.vector) >= 0.9)), case when list_bool_or(list_transform(kept, lambda k: list_cosine_similarity(k, x.vector) >= 0.9)) then kept else list_append(kept, x.vector) end from f join x on x.query_id = f.query_id and x.rank = f.rank + 1)
select query_id, id, rank::int as rank from f where keep""")
def r3_dedup_semantic(s, d):
    hits = _hits(s, d, 10, "vector")
    return R.dedup_greedy(hits, 0.9, text=False, semantic=True).select("query_id", "id", "rank")


@query()
def r4_dedup(s, d):
    hits = _hits(s, d, 10, "vector")
    return R.dedup(hits, semantic=True).select("query_id", "id", "rank")


@query(f"""with {_HITS}, w as (select *, list_distinct(list_filter(string_split_regex(lower(trim(query_text, ' ' || chr(10))), '\\s+'), lambda w: w <> '')) as words from hits),
s as (select query_id, id, rank, round(score + case when length(content) between 100 and 500 then 0.05 when length(content) < 100 then -0.02 else -0.01 end + least(len(list_filter(words, lambda w: contains(lower(content), w))) * 0.03, 0.15), 9) as x from w)
select query_id, id, round(x, 6) as rerank_score, row_number() over (partition by query_id order by x desc, rank)::int as rank from s""")
def r5_rerank(s, d):
    return R.rerank(_hits(s, d)).select("query_id", "id", F.round("rerank_score", 6).alias("rerank_score"), "rank")


_GRADES = """g as (select query_id, count(*) as n, avg(score) as a, max(score) as hi, min(score) as lo from c group by 1)
select q.query_id, coalesce(n, 0) as n, coalesce(round(a, 3), 0) as avg_score, coalesce(round(hi, 3), 0) as max_score, coalesce(round(lo, 3), 0) as min_score, case when a >= 0.8 and n >= 3 then 'excellent' when a >= 0.7 and n >= 2 then 'good' when a >= 0.5 then 'acceptable' else 'poor' end as quality from m_q q left join g on g.query_id = q.query_id"""


@query(f"with {_TOP}, c as (select * from h where rank <= 10 and score >= 0.4), {_GRADES}")
def r6_quality(s, d):
    q = V.queries(s, d)
    return R.quality(q, N.candidates(q, V.item_vectors(s, d), 5, 0.4))


@query(f"with {_HITS} select query_id, id from hits where rank <= 3 and trim(query_text) <> ''")
def r7_final_top(s, d):
    return R.final_top(_hits(s, d), 3).select("query_id", "id")


@query(f"with {_TOP}, t as (select unnest([0.0, 0.2, 0.3, 0.5, 0.7])::double as threshold) select threshold, (select count(*) from h where rank <= 10 and score >= threshold) as n from t")
def r8_threshold_sweep(s, d):
    return R.threshold_sweep(N.top_k(V.queries(s, d), V.item_vectors(s, d), 10), [0.0, 0.2, 0.3, 0.5, 0.7])


@query("select id as query_id, min(id) over (partition by lower(trim(content))) as first_id from m_msg")
def r9_distinct_queries(s, d):
    q = V.messages(s, d).select(F.col("id").alias("query_id"), F.col("content").alias("text"))
    return R.distinct_queries(q, 5, 0.7)[1]


@query(f"""with {_HITS} select query_id, string_agg('### 资料来源' || rank || chr(10) || '**文档标题**：' || document_title || chr(10) || '**相似度**：' || printf('%.2f%%', round(score, 4) * 100) || chr(10) || '**内容片段**：' || chr(10) || content, chr(10) || chr(10) order by rank) as context from hits group by 1""")
def r10_context(s, d):
    hits = _hits(s, d).withColumn("score", F.round("score", 4)).withColumn("document_title", F.coalesce("document_title", F.lit("")))
    return R.context(V.queries(s, d), hits)


@query("""select conversation_id, id, coalesce(string_agg(role, ',') over (partition by conversation_id order by created_s, id rows between 6 preceding and 1 preceding), '') as roles from m_msg""")
def r11_history(s, d):
    return R.history(V.messages(s, d)).select("conversation_id", "id", F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("roles"))


@query(f"with {_HITS} select query_id, rank::int as rank, document_id, round(score, 6) as score from hits where rank <= 5")
def r12_r18_cited_documents(s, d):
    return R.cited_documents(R.message_metadata(_hits(s, d)))


@query("""select id, '问题：' || content || chr(10) || '领域：其他' || chr(10) || '法律要素：' || 'a、b' as prompt from m_msg where id % 2 = 1 union all select id, '参考资料：' || chr(10) || 'source' || chr(10) || chr(10) || '问题：' || content || chr(10) || '领域：' || role || chr(10) || '法律要素：' || 'a、b' from m_msg where id % 2 = 0""")
def r13_prompts(s, d):
    even, none = F.col("id") % 2 == 0, F.array().cast("array<string>")
    q = V.messages(s, d).select("id", F.col("content").alias("question"), F.when(even, F.col("role")).alias("category"), F.array(F.lit("a"), F.lit("b")).alias("elements"), none.alias("entities"), none.alias("missing"), F.when(even, F.lit("source")).alias("context"))
    return R.prompts(q)


_NEXT_MSG = "n as (select id, content, lead(content) over (partition by conversation_id order by id) as answer from m_msg)"


def _answers(s, d):
    from pyspark.sql import Window as W

    m = V.messages(s, d)
    return m.withColumn("answer", F.lead("content").over(W.partitionBy("conversation_id").orderBy("id"))).where("answer is not null")


@query(f"""with {_NEXT_MSG}, w as (select id, list_distinct(regexp_extract_all(lower(answer), '[a-z0-9_ß-öø-ÿ]{{3,}}')) as a, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_ß-öø-ÿ]{{3,}}')) as c from n where answer is not null)
select id, round(case when len(a) = 0 then 0 else len(list_intersect(a, c)) / len(a) end, 6) as grounding from w""")
def r14_grounding(s, d):
    return _answers(s, d).select("id", F.round(R.grounding(F.col("answer"), F.col("content")), 6).alias("grounding"))


@query("select id, (contains(content, 'tion'))::bigint + (contains(content, 'heit'))::bigint + (contains(content, 'the '))::bigint + (not contains(content, 'que'))::bigint as warnings from m_msg")
def r15_safety(s, d):
    flags = R.safety_flags(F.col("content"), ("tion",), ("heit", "the "), ("que",))
    return V.messages(s, d).select("id", F.size(flags).cast("long").alias("warnings"))


def _edges(words: str, threshold: float) -> str:
    """Sets of words by their smallest id, and the pairs of them that are alike."""
    return rf"""w as (select id, list_sort(list_distinct({words})) as words from m_items),
g as (select words, min(id) as node, len(words) as n from w group by words),
x as (select node, n, unnest(words) as word from g),
e as (select a.node as a, b.node as b from x a join x b on a.word = b.word and a.node < b.node and least(a.n, b.n) >= {threshold} * greatest(a.n, b.n) - 1e-6 group by a.node, b.node, a.n, b.n having count(*) >= {threshold} * (a.n + b.n - count(*)) - 1e-6)"""


_PLAIN = r"list_filter(string_split_regex(content, '\s+'), lambda w: w <> '')"
_FIVES = r"list_transform(range(1, greatest(len({0}) - 4, least(len({0}), 1)) + 1), lambda i: array_to_string({0}[i:i + 4], ' '))".format(_PLAIN)
# one row for each passage that is like another, in order: the kept ones so far
_GREEDY = """, o as (select b as node, list(a) as earlier, row_number() over (order by b) as pos from e group by b),
k as (select 0::bigint as pos, []::bigint[] as gone union all select o.pos, case when len(list_filter(o.earlier, lambda x: not list_contains(gone, x))) > 0 then list_append(gone, o.node) else gone end from k join o on o.pos = k.pos + 1)
select w.id, w.id = g.node and not list_contains((select gone from k order by pos desc limit 1), g.node) as kept from w join g using (words)"""


@query(f"""with recursive {_edges(_PLAIN, 0.85)},
t as (select a, b from e union select b, a from e), r as (select node as a, node as b from g union select r.a, t.b from r join t on t.a = r.b), c as (select a as node, min(b) as component_id from r group by 1)
select w.id, component_id, w.id = component_id as kept from w join g using (words) join c using (node)""")
def r16_near_duplicate_chunks(s, d):
    return D.near_duplicates(V.passages(s, d))


@query()
def r16_greedy_chunks(s, d):
    return D.greedy(V.passages(s, d))


@query()
def r16_greedy_shingles(s, d):
    """By runs of five words."""
    return D.greedy(V.passages(s, d), threshold=0.8, shingle=5)


@query()
def r17_retrieve(s, d):
    q = V.queries(s, d)
    hits, _ = R.retrieve(q, _stored_vectors(s, d), V.documents(s, d).select("document_id", "document_title"), contents=lambda found: V.contents(s, d, found))
    return hits.select("query_id", "rank", "id", "document_id", "document_title", F.round("score", 6).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))


@query("select id, round(case when id % 2 = 0 then 1 else 0.7 end * case when id % 3 = 0 then 1 else 0.9 end * case when id % 5 = 0 then 1 else 0.8 end, 6)::double as confidence, (id % 2 <> 0)::int + (id % 3 <> 0)::int + (id % 5 <> 0)::int as issues, id % 30 = 0 as valid from m_msg")
def r19_validate_answer(s, d):
    i = F.col("id")
    v = R.validate_answer(i % 2 == 0, i % 3 == 0, i % 5 == 0)
    return V.messages(s, d).select("id", v["confidence"].alias("confidence"), F.size(v["issues"]).alias("issues"), v["valid"].alias("valid"))


@query("select c.id, coalesce(k, '无') as key_information from m_conv c left join (select conversation_id, string_agg(distinct v, chr(10) order by v) as k from (select conversation_id, unnest(regexp_extract_all(content, '[A-Z][a-z]+')) as v from m_msg where role = 'user') group by 1) m on m.conversation_id = c.id")
def r20_key_information(s, d):
    return R.key_information(V.conversations(s, d), V.messages(s, d), F.regexp_extract_all("content", F.lit("[A-Z][a-z]+"), F.lit(0)))


@query("""select doc_id as document_id, i::int as chunk_index, substring(text, i * 500 + 1, 500) as content from (select doc_id, text, unnest(range(0, ceil(length(text) / 500.0)::int)) as i from documents where length(text) > 0)""")
def x1_registered_chunker(s, d):
    X.register_chunker("short", lambda docs: C.fixed_size(docs, 500, 0).select("document_id", "chunk_index", "content"))
    try:
        return C.dispatch(V.texts(s, d).select("document_id", "text"), X.chunkers(), strategy="short").drop("strategy")
    finally:
        X.unregister("chunker", "short")


@query(_recursive_sql() + " select document_id, chunk_index, content from w")
def x2_chunk_table_function(s, d):
    X.register_table_functions(s)
    texts = V.texts(s, d)
    return s.sql("select document_id, chunk_index, content from {t}, lateral recursive_chunks(text, 1000, 200)", t=texts)


@query(_recursive_sql() + " select document_id, chunk_index, content from w")
def x2_chunk_whole_table(s, d):
    X.register_table_functions(s)
    return s.sql("select * from recursive_chunk_table(table(select document_id, text from {t}), 1000, 200)", t=V.texts(s, d))


@query("""select id, processor, md5(case when processor in ('application/x-brief', '.xyz') then 'Brief: ' || text else text end) as hash from
(select id, text, case when id % 7 = 0 then 'application/x-brief' when id % 5 = 4 then '.xyz' when id % 5 = 0 then '.txt' when id % 5 = 1 then '.md' end as processor from m_docs) where processor is not null""")
def x1_process_files(s, d):
    X.register_processor(".XYZ", lambda content: F.concat(F.lit("Brief: "), content.cast("string")), "application/x-brief")
    try:
        docs = V.documents(s, d).withColumn("content", F.col("text").cast("binary")).drop("text")
        docs = docs.withColumn("mime", F.when(F.col("id") % 7 == 0, "Application/X-Brief").when(F.col("id") % 3 == 0, "application/unknown"))
        return X.process(docs).where("processor is not null").select("id", "processor", F.md5("text").alias("hash"))
    finally:
        X.unregister_processor(".xyz", "application/x-brief")
