"""Queries over documents: filters, deduplication, statistics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.operators import cleaning, dedup, prose, quality
from quarry.plans.tables import table
from quarry.session import small_batches
from quarry.sources import extract

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


_W = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_L = r"list_filter(list_transform(regexp_split_to_array({0}, '\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_P = r"list_filter(list_transform(regexp_split_to_array({0}, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_BP = quality.BOILERPLATE.replace("'", "''")
_MEASURES = f"""
cut as (select doc_id, source, lang, text, {_W.format('text')} as w, {_L.format('text')} as l, {_P.format('text')} as p from docs),
m as (select doc_id, source, lang, text, length(text) as chars, len(w) as words,
  case when {_COUNT.format('text', r'\p{L}')} > 0 then {_COUNT.format('text', r'\p{Lu}')} / {_COUNT.format('text', r'\p{L}')} end as uppercase,
  case when length(text) > 0 then {_COUNT.format('text', r'[^\p{L}\p{N}\s]')} / length(text) else 0 end as special,
  case when len(w) > 0 then length(array_to_string(w, '')) / len(w) else 0 end as word_length,
  case when len(l) > 0 then (len(l) - len(list_distinct(l))) / len(l) else 0 end as line_repeats,
  case when len(p) >= 2 then (len(p) - len(list_distinct(p))) / len(p) else 0 end as paragraph_repeats,
  case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '{_BP}'))) / len(l) else 0 end as boilerplate,
  case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '{quality.BULLET}'))) / len(l) else 0 end as bullets,
  case when len(w) > 0 then {_COUNT.format('text', quality.ELLIPSIS)} / len(w) else 0 end as ellipses,
  {_COUNT.format('text', quality.LINK)} / greatest(len(w), 1) as links
  from cut),
q as (select *, case when chars < 100 then 'too_short' when chars > 500000 then 'too_long' when words < 20 then 'few_words' when words > 100000 then 'many_words'
  when uppercase > 0.4 then 'uppercase' when special > 0.3 then 'special_chars' when word_length < 2 then 'short_words' when word_length > 20 then 'long_words'
  when line_repeats > 0.5 then 'line_dup' when paragraph_repeats > 0.3 then 'para_dup' when boilerplate > 0.5 then 'boilerplate' when bullets > 0.7 then 'bullet_heavy'
  when ellipses > 0.3 then 'ellipsis' end as reason from m)
"""
_DOCS = "with docs as (select doc_id, source, lang, text from documents), "


@query(_DOCS + _MEASURES + "select coalesce(reason, 'kept') as reason, count(*) as n from q group by 1")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measured(table(spark, sf_dir, "documents"))
    return m.groupBy(F.coalesce(quality.quality_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(_DOCS + _MEASURES + "select doc_id, reason from q")
def quality_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents")).select("doc_id", quality.quality_reason().alias("reason"))


_ROUNDED = ("uppercase", "special", "word_length", "line_repeats", "paragraph_repeats", "boilerplate", "bullets", "ellipses", "links")


@query(_DOCS + _MEASURES + "select doc_id, chars, words, " + ", ".join(f"round({c}, 6) as {c}" for c in _ROUNDED) + " from m")
def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measured(table(spark, sf_dir, "documents"))
    return m.select("doc_id", F.col("m.chars").cast("long").alias("chars"), F.col("m.words").cast("long").alias("words"), *[F.round(f"m.{c}", 6).alias(c) for c in _ROUNDED])


_GRAMS = """case when len(w) < {n} then 0.0 else (len(g) - len(list_distinct(g))) / len(g) end"""
_REPEATS = (
    "select doc_id, round(" + _GRAMS.format(n=10) + ", 6) as repetition from (select doc_id, w, "
    "list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: array_to_string(list_slice(w, i, i + 9), ' ')) as g "
    "from (select doc_id, " + _W.format("lower(text)") + " as w from documents))"
)


@query(_REPEATS)
def repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(quality.repetition(F.col("text")), 6).alias("repetition"))


@query(
    "select doc_id, case when len(w) < 5 then 0.0 else round(1 - len(list_distinct(g)) / len(g), 6) end as repetition from (select doc_id, w, "
    "list_transform(generate_series(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) as g from (select doc_id, " + _W.format("text") + " as w from documents))"
)
def generation_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = tx.let(tx.words(F.col("text")), lambda own: F.when(F.size(own) < 5, 0.0).otherwise(F.round(tx.repeated_share(tx.ngrams(own, 4)), 6)))
    return table(spark, sf_dir, "documents").select("doc_id", ratio.alias("repetition"))


_KEYWORDS = " ".join(f"when contains(lower(text), '{k}') then 'spam_keyword:{k}'" for k in sorted(quality.SPAM))


@query(_DOCS + _MEASURES + f"select doc_id, case when links > 0.1 then 'url_density' {_KEYWORDS} end as reason from m")
def spam_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measured(table(spark, sf_dir, "documents"))
    return m.select("doc_id", quality.spam_reason(F.col("text"), F.col("m.links")).alias("reason"))


_LINKED = "with u as (select page_id, unnest(regexp_extract_all(url || ' ' || html, '(?i)https?://\\S+')) as u from pages), d as (select page_id, lower(split_part(split_part(u, '/', 3), ':', 1)) as domain from u) "


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws(" ", "url", "html").alias("text"))


@query(_LINKED + "select domain, count(*) as n from d group by domain")
def link_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _linked(spark, sf_dir).select(F.explode(quality.domains(F.col("text"))).alias("domain"))
    return links.groupBy("domain").agg(F.count("*").alias("n"))


@query(_LINKED + "select distinct page_id from d where domain in (select domain from d group by domain having min(page_id) % 3 = 0)")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a link to a host on a list, here the hosts whose first page has a number divisible by three."""
    pages = _linked(spark, sf_dir)
    hosts = pages.select("page_id", F.explode(quality.domains(F.col("text"))).alias("domain")).groupBy("domain").agg(F.min("page_id").alias("first")).where("first % 3 = 0")
    return quality.from_blocked(pages, "text", hosts).select("page_id")


def _redacted(t: str) -> str:
    """The redaction in SQL: what stands around a telephone number is captured, twice over, as neighbours share it."""
    for name, pattern, mark in quality.PERSONAL:
        if name == "phone":
            inner = pattern.removeprefix(r"(?<!\d)").removesuffix(r"(?!\d)")
            for _ in range(2):
                t = f"regexp_replace({t}, '(^|[^0-9])(?:{inner})([^0-9]|$)', '\\1{mark}\\2', 'g')"
        else:
            t = f"regexp_replace({t}, '{pattern}', '{mark}', 'g')"
    return t


@query(f"select doc_id, {_redacted('text')} as text from documents")
def pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", quality.redacted(F.col("text")).alias("text"))


@query(
    "select doc_id, len(regexp_extract_all(r, '<EMAIL>')) - len(regexp_extract_all(text, '<EMAIL>')) as n_email from "
    "(select doc_id, text, regexp_replace(text, '\\b[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Z|a-z]{2,}\\b', '<EMAIL>', 'g') as r from documents)"
)
def email_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = quality.redacted(F.col("text"), ("email",))
    return table(spark, sf_dir, "documents").select("doc_id", (tx.count(after, "<EMAIL>") - tx.count(F.col("text"), "<EMAIL>")).cast("long").alias("n_email"))


@query(f"with r as (select doc_id, text, {_redacted('text')} as r from documents) select doc_id, " + ", ".join(f"(len(regexp_extract_all(r, '{mark}')) - len(regexp_extract_all(text, '{mark}')))::int as n_{name}" for name, _, mark in quality.PERSONAL) + " from r")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *quality.personal_counts(F.col("text")))


_CHAIN = (
    f"with docs as (select doc_id, source, lang, {_redacted("coalesce(text, '')")} as text from documents), reps as ({_REPEATS.replace('round(', '(').replace(', 6) as repetition', ') as repetition')}), " + _MEASURES.strip()
    + f", v as (select doc_id, case when repetition > 0.2 then 'repetition' end as a, reason as b, case when links > 0.1 then 'url_density' {_KEYWORDS} end as c from q join reps using (doc_id)), "
    "chain as (select doc_id, case when a is not null then 'repetition' when b is not null then 'quality' when c is not null then 'spam' end as filter, coalesce(a, b, c) as reason from v) "
)


@query(_CHAIN + "select doc_id, filter, reason, filter is null as kept from chain")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).select("doc_id", "filter", "reason", "kept")


@query(_CHAIN + "select filter, reason, count(*) as n, round(count(*) / sum(count(*)) over (), 6) as share from chain group by filter, reason")
def filter_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents")).groupBy("filter", "reason").agg(F.count("*").alias("n"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query(_DOCS + _MEASURES + "select reason, count(*) as n from q where reason is not null group by reason order by n desc, reason limit 5")
def top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measured(table(spark, sf_dir, "documents")).select(quality.quality_reason().alias("reason")).where("reason is not null")
    return m.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(5)


@query(_DOCS + _MEASURES + "select toxic, quality, coalesce(reason, 'kept') as reason, count(*) as n from q join labels using (doc_id) group by all")
def verdicts_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.measured(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce(quality.quality_reason(), F.lit("kept")).alias("reason"))
    return m.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("toxic", "quality", "reason").agg(F.count("*").alias("n"))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact(table(spark, sf_dir, "documents"), ["text"], ["doc_id"])


_SHINGLES = (
    "with s as (select doc_id, list_sort(list_distinct(case when len(w) = 0 then [] else list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end)) as g "
    "from (select doc_id, " + _W.format("lower(text)") + " as w from documents)), r as (select doc_id, min(doc_id) over (partition by g) as first, g from s) "
)
_PAIRS = _SHINGLES + (
    ", e as (select doc_id, len(g) as n, unnest(g) as x from r where doc_id = first), "
    "p as (select a.doc_id as i, b.doc_id as j, any_value(a.n) as m, any_value(b.n) as n, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2) "
    "select i, j, round(c / (m + n - c), 6) as jaccard from p where c / (m + n - c) >= 0.8"
)


@query()
def near_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy_near(table(spark, sf_dir, "documents"))


@query(_PAIRS)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.jaccard_pairs(table(spark, sf_dir, "documents"))


@query(_SHINGLES + "select doc_id, first as representative from r")
def jaccard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.equal_sets(table(spark, sf_dir, "documents")).select("doc_id", "representative")


@query("select doc_id, kept from (select doc_id, row_number() over (partition by text order by doc_id) = 1 as kept from documents)")
def exact_dedup_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = dedup.exact(docs, ["text"], ["doc_id"]).select("doc_id", F.lit(True).alias("first"))
    return docs.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("first", F.lit(False)).alias("kept"))


_HEADS = r"Articol[oi]\s+\d|Capitolo\s+[IVXLCDM\d]|Sezione\s+\d|CAPO\s+[IVXLCDM]|Allegat[oi]\s+[IVXLCDMA-Z\d]|Tabella\s+[IVXLCDM\d]|TITOLO\s+[IVXLCDM]|PARTE\s+[IVXLCDM]"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_JOIN = r"regexp_replace({0}, '([^.!?;:\s])[ \t\r\f\v]*\n[ \t\r\f\v]*([^\s])', '\1 \2', 'g')"
_ANY = lambda pattern: pattern.replace("(?U)", "").replace("(?iU)", "(?i)").replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace("'", "''")


def _share(test: str) -> str:
    return f"len(list_filter(l, lambda x: {test})) / k"


_PROSE = (
    "with recursive t as (select doc_id, regexp_replace(coalesce(text, ''), '\\n(" + _HEADS + ")', chr(1) || '\\1', 'gi') as t from documents), "
    "s as (select doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n|\\x01'), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') as c from t), "
    "z as (select doc_id, c, i, len(" + _W.format("c[i]") + ") as n from (select doc_id, c, unnest(range(1, len(c) + 1)) as i from s)), "
    "f as (select doc_id, i, 0::bigint as ix, n as held from z where i = 1 union all "
    "select z.doc_id, z.i, f.ix + case when full_ then 1 else 0 end, case when full_ then z.n else f.held + z.n end from f join z on z.doc_id = f.doc_id and z.i = f.i + 1, "
    "lateral (select (f.held >= 15 and z.n >= 15) or (f.held >= 45 and z.n < 15) as full_)), "
    "h as (select doc_id, ix, string_agg(c[i], chr(10) || chr(10) order by i) as chunk from f join z using (doc_id, i) group by doc_id, ix), "
    "w as (select doc_id, ix, chunk, " + _W.format("chunk") + " as w, list_filter(list_transform(string_split(" + _JOIN.format(_JOIN.format("chunk")) + ", chr(10)), lambda x: " + _STRIP.format("x") + "), lambda x: x <> '') as l from h), "
    "m as (select *, len(w) as n, greatest(len(l), 1) as k from w), "
    "e as (select *, case when n < 15 or length(chunk) < 80 then 'too_short' when n >= 30 then case "
    "when len(list_distinct(list_filter(list_transform(w, lambda x: trim(lower(x), '.,;:()\"' || chr(39))), lambda x: length(x) > 1))) / n < 0.40 then 'word_salad_unique' "
    "when len(list_filter(list_zip(list_slice(w, 1, -2), list_slice(w, 2, -1)), lambda z: lower(z[1]) = lower(z[2]))) / n > 0.20 then 'word_salad_consec' "
    f"when len(regexp_extract_all(chunk, '{prose.TYPE_CODE}')) >= 3 then 'form_spec_dtypes' end end as early, "
    f"len(list_filter(w, lambda x: regexp_matches(x, '{prose.NUMBER_WORD}'))) / n as numbers, "
    "case when len(regexp_extract_all(chunk, '\\p{L}')) > 0 then len(regexp_extract_all(chunk, '\\p{Nd}')) / len(regexp_extract_all(chunk, '\\p{L}')) when len(regexp_extract_all(chunk, '\\p{Nd}')) > 0 then 1.0 else 0.0 end as digits, "
    f"{_share(f"regexp_matches(x, '{_ANY(prose.TABLE_LINE)}')")} + {_share(f"regexp_matches(x, '{_ANY(prose.NUMBER_LINE)}')")} as tabular, "
    f"coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) / k as mean, coalesce(list_sum(list_transform(l, lambda x: case when regexp_matches(x, '[.!?;:]$') then 1.0 when regexp_matches(x, '[,)]$') then 0.5 else 0.0 end)), 0) / k as sentences, "
    f"{_share('length(x) < 40')} as short, {_share(f'len({_W.format("x")}) <= 3')} as orphans, "
    f"{_share(f"length(array_to_string(regexp_extract_all(x, '{_ANY(prose.CITATION)}'), '')) / greatest(length(x), 1) > 0.30")} as refs, len(regexp_extract_all(chunk, '{prose.NOTE}')) / n as notes from m), "
    "v as (select doc_id, ix, chunk, case when early is not null then [early] else list_filter([case when numbers > 0.50 then 'num_words' end, case when tabular > 0.30 then 'tabular' end], lambda x: x is not null) end as hard, "
    "case when early is not null then [] else list_filter([case when digits > 0.15 then 'digit_ratio' end, case when numbers > 0.25 and numbers <= 0.50 then 'num_words' end, case when short > 0.50 then 'short_lines' end, "
    "case when mean < 40 then 'mean_line_len' end, case when sentences < 0.30 then 'no_sentences' end, case when orphans > 0.40 then 'orphans' end, case when refs > 0.40 then 'refs' end, case when notes > 0.25 then 'parens' end], lambda x: x is not null) end as soft from e) "
)


@query(_PROSE + "select doc_id, ix::int as chunk_ix, hard, soft, len(hard) = 0 and len(soft) < 2 as is_prose from v")
def prose_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.chunk_verdicts(table(spark, sf_dir, "documents"))


_FLAT = r"regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


@query(_PROSE + ", p as (select doc_id, string_agg(chunk, chr(10) || chr(10) order by ix) as text from v where len(hard) = 0 and len(soft) < 2 group by doc_id) select doc_id, " + _STRIP.format(_FLAT.format("text")) + " as text from p")
def prose_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.prose_text(table(spark, sf_dir, "documents"))


@query("select doc_id, " + _STRIP.format(_FLAT.format("text")) + " as text from documents")
def flatten_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", prose.flattened(F.col("text")).alias("text"))


@query(
    "select source, count(*) as docs, sum(length(text))::bigint as chars, sum(greatest(1, length(text) // 4))::bigint as tokens, "
    "round(count(*) / sum(count(*)) over (), 6) as doc_share, round(sum(greatest(1, length(text) // 4)) / sum(sum(greatest(1, length(text) // 4))) over (), 6) as token_share from documents group by source"
)
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4))
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(tokens).alias("tokens"))
    total = Window.partitionBy()  # over one row for each source
    return by.withColumn("doc_share", F.round(F.col("docs") / F.sum("docs").over(total), 6)).withColumn("token_share", F.round(F.col("tokens") / F.sum("tokens").over(total), 6))


@query(
    "with s as (select source, count(*) as docs from documents group by source), t as (select *, docs / sum(docs) over () as share from s) select source, round(share, 6) as share, "
    "case when share > 0.7 then 'dominant' when share < 0.1 then 'small' else 'balanced' end as finding from t"
)
def source_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    share = F.col("docs") / F.sum("docs").over(Window.partitionBy())
    finding = F.when(F.col("s") > 0.7, "dominant").when(F.col("s") < 0.1, "small").otherwise("balanced")
    return by.withColumn("s", share).select("source", F.round("s", 6).alias("share"), finding.alias("finding"))


_WORDS = "select doc_id, unnest(" + _W.format("lower(text)") + ") as w from documents"


@query(f"select w as term, count(*) as n, count(distinct doc_id) as docs from ({_WORDS}) group by w")
def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.words(F.lower("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("c"))
    return own.groupBy("term").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query(
    "select doc_id, list_filter(list_transform(generate_series(2, len(w)), lambda i: case when w[i] = w[i-1] then 1 else 0 end), lambda x: x = 1).len() as repeats from (select doc_id, "
    + _W.format("text") + " as w from documents)"
)
def consecutive_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda own: F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: a == b)
    count = tx.let(tx.words(F.col("text")), lambda own: F.size(F.filter(same(own), lambda x: F.coalesce(x, F.lit(False)))))
    return table(spark, sf_dir, "documents").select("doc_id", count.cast("long").alias("repeats"))


_HOT = (
    "with w as (select doc_id, " + _W.format("lower(text)") + " as w from documents), b as (select item_id, " + _W.format("lower(text)") + " as w from benchmark), "
    "g as (select distinct doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) as x from w where len(w) >= 13), "
    "h as (select distinct item_id, unnest(list_transform(generate_series(1, greatest(len(w) - 12, 1)), lambda i: array_to_string(list_slice(w, i, i + 12), ' '))) as x from b where len(w) >= 13) "
    "select doc_id, item_id, count(*) as shared from g join h using (x) group by 1, 2"
)


@query(_HOT)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.shared_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.normalized(F.col("text")).alias("text"))


@query()
def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ratio = cleaning.compression_ratio(F.col("text")).alias("ratio")
    reason = F.when(F.col("ratio") < 0.10, "low_entropy").when(F.col("ratio") > 0.90, "high_entropy")
    return table(spark, sf_dir, "documents").select("doc_id", ratio).withColumn("reason", reason)


@query()
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "pages").select("page_id", extract.html_text(F.col("html")).alias("text"))


@query("select doc_id, row_number() over (order by md5(doc_id::varchar || ':7'), doc_id) as rank from documents order by rank limit 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7")).cast("binary"))
    first = table(spark, sf_dir, "documents").select("doc_id", key.alias("key")).orderBy("key", "doc_id").limit(100)
    return first.select("doc_id", F.row_number().over(Window.orderBy("key", "doc_id")).cast("long").alias("rank"))
