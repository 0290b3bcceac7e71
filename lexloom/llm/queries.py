"""The registered queries of the operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import held_out
    from .toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    chain = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), chain).alias("m"))
    return scored.select("doc_id", "held_out", "m.kind_1", "m.kind_2", F.col("m.toxic").alias("score"), (F.col("m.toxic") >= 0.4).cast("int").alias("predicted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import held_out
    from .language_id import fit, identify

    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), identify(F.col("text"), fit(docs), spark).alias("m"))
    return found.select("doc_id", "held_out", "m.lang_pred", "m.score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .base import held_out
    from .quality import fit, quality_score

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .curriculum import curriculum

    mixed = curriculum(table(spark, sf_dir, "documents"))
    ranged = mixed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    ordered = ranged.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    time = lambda n: F.round(F.try_element_at("positions", F.lit(n)), 6)
    return ordered.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"), time(1).alias("first_position"), time(2).alias("second_position"))


def op6_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ogg import media_features

    docs = table(spark, sf_dir, "documents").select("doc_id", media_features(F.col("text")).alias("m"))
    return docs.select("doc_id", "m.*")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


#: (host, path, verdict) of the rules that op11 judges by.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the rules, the list blocks every page that a feed links to, under whatever address it was fetched."""
    from .url_filter import exact_urls, judge_urls, prefix_rules

    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(pages, prefix_rules(rules).unionByName(exact_urls(pages.where(F.col("url").contains("utm_source=feed")))))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    return collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitening

    return whitening(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


OP5_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as h
  from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), r as (
  select *, row_number() over (order by source is null, source) - 1 as place from s
), w as (
  select *, case place % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as w,
         2.0::double * source_size as cap
  from r
), l as (
  select *, (1.5::double * (sum(source_size) over ())::double
             - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0.0))
            / sum(w) over (order by cap / w, place rows between current row and unbounded following) as level
  from w
), t as (
  select source, source_size, place, least(cap, max(level) over () * w) as target from l
), p as (
  select d.*, coalesce(sum(size) over (partition by source order by h, size rows between unbounded preceding and 1 preceding), 0) as before
  from d
), q as (
  select p.doc_id, p.size, t.source_size, t.target, t.place % 3 as kind, (p.before + p.size / 2.0::double) / t.target as y1,
         (p.before + p.size / 2.0::double + t.source_size) / t.target as y2
  from p join t on p.source is not distinct from t.source
), x as (
  -- the share y of a source's words is asked for at the time at which its schedule's integral is y
  select *, case when size > 0 and y1 < 1 then case kind when 0 then sqrt(0.25 + 2 * y1) - 0.5 when 1 then y1 else (1.4 - sqrt(1.96 - 1.6 * y1)) / 0.8 end end as t1,
         case when size > 0 and y2 < 1 then case kind when 0 then sqrt(0.25 + 2 * y2) - 0.5 when 1 then y2 else (1.4 - sqrt(1.96 - 1.6 * y2)) / 0.8 end end as t2
  from q
)
select doc_id, size, source_size, target, size * (case when t1 is null then 0 else 1 end + case when t2 is null then 0 else 1 end) as taken,
       round(t1, 6) as first_position, round(t2, 6) as second_position
from x
"""


def _op2_sql() -> str:
    """The licence scan with the same sentences and rules."""
    from .license_scan import ANCHORS, GAP, PLUS, TAG, UNMATCHED, cited, known_sentences, rules, sentence_pattern, slots

    def quoted(x):
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({quoted(s)}, {quoted(c)})" for s, c in known_sentences())
    pattern = quoted(sentence_pattern(sorted(s for s, _ in known_sentences())))
    words = f"trim(regexp_replace(lower(regexp_replace(regexp_replace(text, {quoted(TAG)}, ' ', 'g'), {quoted(PLUS)}, '\\1 or later', 'g')), '[^a-z0-9]+', ' ', 'g'))"
    for slot, usual in slots():
        words = f"regexp_replace({words}, {quoted(slot)}, {quoted(usual)}, 'g')"
    spelt = ", ".join(f"({quoted(k.lower())}, {quoted(k)})" for k in cited())
    # each rule in turn: what it takes away, and how often
    steps = ", ".join(f"({i}, {quoted(licence)}, {quoted(codes)})" for i, (licence, codes) in enumerate(rules()))
    return rf"""
with recursive known(sentence, code) as (values {known}), spelt(low, id) as (values {spelt}), rules(i, licence, codes) as (values {steps}),
plain as (
  select distinct doc_id, text, {words} as words, regexp_extract_all(text, {quoted(TAG)}, 1) as tags
  from documents where regexp_matches(lower(text), {quoted("|".join(ANCHORS))})
), parts as (
  select row_number() over () as tag, doc_id, string_split_regex(t, '[ \t]+') as p from (select doc_id, unnest(tags) as t from plain)
), words as (
  select tag, doc_id, unnest(p) as w, unnest(range(1, len(p) + 1)) as i from parts
), tagged as (
  select doc_id, string_agg(coalesce(id, w), ' ' order by i) as licence from words left join spelt on lower(w) = low group by tag, doc_id
), cut as (
  select doc_id, text, regexp_extract_all(words, {pattern}) as found, string_split_regex(words, {pattern}) as parts from plain where regexp_matches(words, {pattern})
), hits as (
  select doc_id, text, unnest(found) as sentence, unnest(range(1, len(found) + 1)) as i, parts from cut
), coded as (
  select doc_id, text, i, code, len(list_filter(string_split(parts[i], ' '), lambda w: w <> '')) as gap from hits join known using (sentence)
), s(i, doc_id, text, before, rest) as (
  select -1, doc_id, text, '', string_agg(case when i > 1 and gap > {GAP} then '_' else '' end || code, '' order by i) from coded group by doc_id, text
  union all select rules.i, doc_id, text, rest, replace(rest, codes, '#') from s join rules on rules.i = s.i + 1
), counted as (
  select doc_id, licence, ((length(before) - length(rest)) / (length(codes) - 1))::bigint as n from s join rules using (i)
  union all select doc_id, {quoted(UNMATCHED)}, length(rest) - length(replace(rest, '<', '')) from s where i = {len(rules()) - 1}
  union all select doc_id, licence, 1 from tagged
)
select doc_id, licence, sum(n)::bigint as matches from counted group by doc_id, licence having sum(n) > 0
"""


OP11_SQL = r"""
with u as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, url, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) as kept
  from u
), c as (
  select page_id, url, coalesce(host, '') as host, coalesce(path, '') as path,
         case when host <> '' then regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '')
              || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical
  from p
), listed as (
  select distinct canonical from c where contains(url, 'utm_source=feed')
), rules(h, p, v) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), judged as (
  select page_id, host, path, canonical,
         (select arg_max({'rule': h || p, 'v': v}, len(h || p)) from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p)) as best
  from c
)
select page_id, host, path, best.rule as rule,
       coalesce(best.v, case when listed.canonical is null then 'allow' else 'block' end) as verdict
from judged left join listed on judged.canonical = listed.canonical
"""


OP12_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), p as (
  select lang, unnest(list_transform(string_split_regex(text, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) as w from d
), total as (
  select lang, sum(len(w))::hugeint as n from p group by lang
), g as (
  select lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase
  from p, (select unnest(range(1, 6)) as m) where len(w) >= m
), f as (
  select lang, m, phrase, count(*)::hugeint as a from g group by all having count(*) >= 100
), cut as (
  select lang, phrase, m, a, unnest(range(1, m)) as k, string_split(phrase, ' ') as w from f where m > 1
), scored as (
  select cut.lang, cut.phrase, cut.a, k, l.a as l, r.a as r, n, (1000 * cut.a * n) // (l.a * r.a) as score
  from cut join f l on l.lang = cut.lang and l.phrase = array_to_string(w[1:k], ' ') join f r on r.lang = cut.lang and r.phrase = array_to_string(w[k + 1:], ' ')
  join total on total.lang = cut.lang
), low as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, a, unnest(list_transform(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: [i, s]))), lambda x: array_to_string(string_split(phrase, ' ')[x[1]:x[1] + x[2] - 1], ' '))) as phrase
  from f where m > 2
), longest as (
  select lang, phrase, max(a) as longer from inside group by all
), kept as (
  select low.* from low left join longest using (lang, phrase) where longer is null or longer < low.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": _op2_sql(), "op5_curriculum": OP5_SQL, "op11_url_filter": OP11_SQL, "op12_collocations": OP12_SQL}
