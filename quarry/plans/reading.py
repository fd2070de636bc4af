"""Queries of sources and readers on contents made from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import chat, cleaning, metrics, tokens, training
from quarry.plans.sets import query
from quarry.plans.tables import table
from quarry.sources import extract, files, notices, sinks
from quarry.streaming import incremental

_ID = "doc_id::varchar"


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20-\x7e\n]", "e")


_PLAIN = "regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e\\n]', 'e', 'g')"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", _plain(F.col("text")).alias("text"))


@query(f"select doc_id, 'Doc ' || {_ID} || chr(10) || {_STRIP.format(_PLAIN)} || chr(10) || 'deep' as text from documents where not regexp_matches({_PLAIN}, '^\\s*$')")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a key at any depth; an object under the key is not entered, repeated texts count once."""
    entered = F.struct(F.lit("not entered").alias("text"))
    inner = F.struct(F.array(F.lit("deep"), F.lit(" deep ")).alias("text"), F.struct(entered.alias("text")).alias("x"))
    own = _docs(spark, sf_dir).where(F.rlike("text", F.lit(r"\S")))
    made = F.to_json(F.struct(F.concat(F.lit("Doc "), _id()).alias("text"), F.struct(F.col("text").alias("text"), F.array(inner).alias("y")).alias("z")))
    return own.select("doc_id", extract.json_text(made).alias("text"))


_FORMATS = "case doc_id % 4 when 0 then 'txt' when 1 then 'json' when 2 then 'jsonl' else 'xml' end"


def _normal(t: str) -> str:
    for pattern, to in ((r"([^ \n]) {2,}", r"\1 "), (r"[ \t]+(\n|$)", r"\1"), (r"\n{3,}", "' || chr(10) || chr(10) || '"), (r"^\s+|\s+$", "")):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


@query(
    f"with f as (select doc_id, {_FORMATS} as format, regexp_replace({_PLAIN}, '[<&>]', 'x', 'g') as t from documents), "
    f"g as (select doc_id, format, case when format = 'txt' then t when format = 'xml' then {_STRIP.format('t')} || chr(10) || 'tail' else {_STRIP.format('t')} end as t from f where regexp_matches(t, '[^\\s]')), "
    f"h as (select doc_id, format, t from g union all select doc_id, format, 'line two' from f where format = 'jsonl') select doc_id, format, {_normal('t')} as text from h"
)
def dispatched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four formats, read each by its own and brought to normal form."""
    own = _docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "[<&>]", "x").alias("text"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("txt", "json", "jsonl", "xml")]), (F.col("doc_id") % 4 + 1).cast("int"))
    as_json = F.to_json(F.struct(F.col("text")))
    content = (
        F.when(kind == "txt", F.col("text")).when(kind == "json", as_json).when(kind == "jsonl", F.concat(as_json, F.lit('\n{"text": \n\n{"text": "line two"}')))
        .otherwise(F.concat(F.lit("<a><b> "), F.col("text"), F.lit(" </b> tail </a>")))
    )
    made = own.select(_id().alias("path"), kind.alias("format"), content.cast("binary").alias("content")).where("format = 'jsonl' or length(content) > 0")
    return files.extracted(made).select(F.col("path").cast("long").alias("doc_id"), "format", "text")


_NOTICE = f"case when doc_id % 3 = 0 then 'N' || {_ID} else 'IT_2001' end"


@query(
    f"with d as (select doc_id, regexp_replace(regexp_replace({_PLAIN}, '[<>]|(?m)^[A-Z]{{2,3}}:', 'x', 'g'), '(?m)^\\d+\\.\\d+/\\d+\\s*$', 'y', 'g') as t from documents), l as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_STRIP.format('x')}), chr(10)) as t from d), "
    "c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(chr(10) || t, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as body from l) "
    f"select {_NOTICE} as doc_id, 'Title ' || {_ID} as title, 'kept' as abstract, body, 'd/' || {_ID} || '/IT_2001.org' as path from c"
)
def legacy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of one notice each: a head, a dividing line and fields, of which one comes twice."""
    body = F.regexp_replace(F.regexp_replace("text", "[<>]|(?m)^[A-Z]{2,3}:", "x"), r"(?m)^\d+\.\d+/\d+\s*$", "y")
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ND: N"), _id(), F.lit("\n"))).otherwise("")
    content = F.concat(F.lit("*** HEAD ***\n\n1.00/"), _id(), F.lit("\nTI: Title "), _id(), F.lit("\nAB: gone\n"), number, F.lit("AB:  kept\nTX: \n"), body)
    made = _docs(spark, sf_dir).select(F.concat(F.lit("d/"), _id(), F.lit("/IT_2001.org")).alias("path"), content.cast("binary").alias("content"))
    return notices.legacy_notices(made)


@query(
    f"with d as (select doc_id, {_STRIP.format(f"regexp_replace({_PLAIN}, '[<&>]', 'x', 'g')")} as t from documents) "
    "select 'X' || doc_id as doc_id, case doc_id % 3 when 0 then 'Titolo' when 1 then 'Titolo tradotto' else 'Una frase italiana' end as title, case when doc_id % 3 = 0 then 'breve' else '' end as abstract, "
    "case when doc_id % 3 = 0 then regexp_replace(regexp_replace(case when t = '' or t = 'altro' then 'altro' else t || chr(10) || 'altro' end, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') else '' end as body, 'd/' || doc_id || '.xml' as path from d"
)
def xml_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices whose Italian text is a form, a translated title, or any element marked so."""
    body = F.regexp_replace("text", "[<&>]", "x")
    form = F.concat(F.lit("<FORM_SECTION><F LG='EN'><P>no</P></F><F LG='it'><TITLE>Titolo</TITLE><SHORT_DESCR>breve</SHORT_DESCR><P>"), body, F.lit("</P><P>altro</P><P>altro</P></F></FORM_SECTION>"))
    inner = F.when(F.col("doc_id") % 3 == 0, form).when(F.col("doc_id") % 3 == 1, "<TRANSLATION_SECTION><ML_TI_DOC LG='FR'><TI_TEXT>non</TI_TEXT></ML_TI_DOC><ML_TI_DOC LG='IT'><TI_TEXT>Titolo tradotto</TI_TEXT></ML_TI_DOC></TRANSLATION_SECTION>")
    inner = inner.otherwise("<A languageID='IT'>Una frase italiana</A><A languageID='IT'>breve</A><A languageID='EN'>An English sentence here</A>")
    content = F.concat(F.lit("<?xml version='1.0'?><R xmlns='urn:x' DOC_ID='X"), _id(), F.lit("'>"), inner, F.lit("</R>"))
    made = _docs(spark, sf_dir).select(F.concat(F.lit("d/"), _id(), F.lit(".xml")).alias("path"), content.cast("binary").alias("content"))
    return notices.xml_notices(made)


_NAMES = ("a/IT_1.org", "a/EN_1.org", "it_2010_utf8_org", "b/x.XML", "b/.hidden.xml", "c/IT_a.pdf", "IT-2.txt")
_HEADS = ("<?xml version='1.0'?>", "1.00/0123", "TX: abc", "nothing")
_SQL_HEADS = "[" + ", ".join("'" + h.replace("'", "''") + "'" for h in _HEADS) + "]"


@query(
    f"with f as (select doc_id, {list(_NAMES)}[doc_id % 7 + 1] as path, {_SQL_HEADS}[doc_id // 7 % 4 + 1] as head from documents) "
    "select doc_id, path, case when path = 'b/x.XML' then 'xml' when head like '<?xml%' then 'xml' else 'txt' end as kind from f where path = 'b/x.XML' or (path in ('a/IT_1.org', 'it_2010_utf8_org', 'IT-2.txt') and head <> 'nothing')"
)
def notice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda xs, at: F.element_at(F.array(*[F.lit(x) for x in xs]), (at + 1).cast("int"))
    made = table(spark, sf_dir, "documents").select("doc_id", pick(_NAMES, F.col("doc_id") % 7).alias("path"), pick(_HEADS, F.floor(F.col("doc_id") / 7) % 4).cast("binary").alias("content"))
    return notices.notice_files(made).select("doc_id", "path", "kind")


@query("select doc_id, i::int as ix, t as text from (select doc_id, unnest([x, 'b']) as t, unnest([0, 1]) as i from (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[^\\x20-\\x7e\\n]', 'e', 'g'), '^\\s+|\\s+$', '', 'g') as x from documents)) where t <> ''")
def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("before <bos>"), F.col("text"), F.lit(" <eos> after<bos> b<eos><bos> <eos>")).alias("v"))
    found = own.select("doc_id", F.explode(files.marked(F.col("v"))).alias("text"))
    return found.select("doc_id", F.when(F.col("text") == "b", 1).otherwise(0).alias("ix"), "text")


@query(f"select doc_id, 'user' as role, 'Ask ' || {_ID} as content from documents union all select doc_id, 'assistant', {_STRIP.format(_PLAIN)} from documents where regexp_matches({_PLAIN}, '[^\\s]')")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ChatML of two turns, with one of an unknown role and an empty one."""
    value = F.concat(F.lit("<|im_start|>User \nAsk "), _id(), F.lit("<|im_end|>\n<|im_start|>assistant\n"), F.col("text"), F.lit("<|im_end|> x\n<|im_start|>nobody\nx<|im_end|><|im_start|>tool\n<|im_end|>"))
    own = _docs(spark, sf_dir).select("doc_id", F.explode(chat.parsed(value)).alias("m"))
    return own.select("doc_id", "m.role", "m.content")


@query("select year(d)::int as year, month(d)::int as month from (select unnest(generate_series(date '2019-11-01', date '2021-02-01', interval 1 month)) as d)")
def month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.months(spark, "2019-11", "2021-02")


@query("select distinct lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) as value from documents where source not like '%5'")
def listed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as lines of a list, some of them comments or blank."""
    line = F.when(F.col("source").endswith("5"), F.concat(F.lit("# "), F.col("source"))).otherwise(F.concat(F.lit("  "), F.upper("source"), F.lit(" ")))
    lines = table(spark, sf_dir, "documents").select(line.alias("value")).unionByName(spark.range(2).select(F.lit("   ").alias("value")))
    return files.listed(lines).distinct()


@query("select distinct o.source as concept, n::int as n, replace(['a {} b', '{}', 'the {} of {}'][('0x' || substring(md5('4:' || o.source || ':' || n), 1, 8))::bigint % 3 + 1], '{}', o.source) as text from (select distinct source from documents) o, (select unnest(range(7)) as n)")
def generated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = table(spark, sf_dir, "documents").select(F.col("source").alias("concept")).distinct()
    return files.generated(concepts, ["a {} b", "{}", "the {} of {}"], 7, 4)


@query("select doc_id, sum(length(text))::bigint as tokens, list_sum(list_transform(list_filter(string_split(text, ''), lambda c: c <> ''), lambda c: unicode(c)))::bigint as total from documents where length(text) > 0 group by doc_id, text")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code points of each document written to shards with checksums and read back, a document to a shard."""
    own = table(spark, sf_dir, "documents").where(F.length("text") > 0).select(tokens.code_points(F.concat(F.chr(F.lit(1)), F.col("text"))).alias("ids"), "doc_id")
    marked = own.select(F.concat(F.array(F.col("doc_id").cast("int") + 1), F.slice("ids", 2, F.size("ids"))).alias("ids"))
    shards = sinks.token_shards(marked.select(F.transform("ids", lambda x: x.cast("long")).alias("ids")), 1)
    read = sinks.shard_tokens(shards)
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, b: a + b)
    each = read.groupBy("shard").agg(F.sum(F.size("ids")).alias("n"), F.sum(total).alias("s"), F.min_by(F.element_at("ids", 1), "first").alias("d"))
    return each.select((F.col("d") - 1).alias("doc_id"), (F.col("n") - 1).alias("tokens"), (F.col("s") - F.col("d")).alias("total"))


@query("select doc_id from documents where doc_id % 3 <> 0 or doc_id % 2 = 0")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, of which every third was done before; those of even numbers have changed since."""
    made = table(spark, sf_dir, "documents").select(_id().alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    old = made.where("cast(path as long) % 3 = 0").withColumn("content", F.when(F.col("path").cast("long") % 2 == 0, F.lit("old").cast("binary")).otherwise(F.col("content")))
    journal = old.select("path", F.sha2("content", 256).alias("hash"), F.lit("s1").alias("settings"))
    return incremental.pending(made, journal, "s1").select(F.col("path").cast("long").alias("doc_id"))


@query(
    "with o as (select event_id // 4 as item, event_id % 4 as option, -value as logp, 1 + event_id % 9 as chars, case when event_id % 4 = 0 then (event_id // 4) % 4 end as gold from events), "
    "b as (select item, arg_max(option, {'s': logp, 'o': -option}) as w, arg_max(option, {'s': logp / chars, 'o': -option}) as p, max(gold) as gold from o group by item) select count(*) as n, round(avg((w = gold)::int), 6) as whole, round(avg((p = gold)::int), 6) as per_char from b"
)
def choice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    item = F.floor(i / 4)
    own = table(spark, sf_dir, "events").select(item.alias("item"), (i % 4).alias("option"), (-F.col("value")).alias("logp"), (1 + i % 9).alias("chars"), F.when(i % 4 == 0, item % 4).alias("gold"))
    return metrics.choices(own).select("n", F.round("whole", 6).alias("whole"), F.round("per_char", 6).alias("per_char"))


@query("with b as (select user_id as batch, avg((value > 5)::int) as a, avg(value - 5) as m from events group by 1) select round(avg(a), 6) as accuracy, round(avg(m), 6) as margin from b")
def preference_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("value").alias("chosen"), F.lit(5.0).alias("rejected"))
    return metrics.preferences(own).select(F.round("accuracy", 6).alias("accuracy"), F.round("margin", 6).alias("margin"))


@query("select round(sum(n_chars * 1.5) / ln(2) / sum(strlen(text)), 6) as bits_per_byte from documents where text is not null")
def bits_per_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").where("text is not null").select((F.col("n_chars") * 1.5).alias("nats"), "text")
    return metrics.bits_per_byte(own).select(F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query("with t as (select vec_id as id, unnest(range(64)) as term, unnest(list_transform(embedding, lambda x: greatest(x::double, 0))) as w from embeddings), m as (select term, sum(w) / (select count(*) from embeddings) as m from t group by term) select round(sum(m * m), 6) as penalty from m")
def sparse_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    terms = vectors.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("term", "w")).select("id", "term", F.greatest(F.col("w").cast("double"), F.lit(0.0)).alias("weight"))
    return metrics.flops_penalty(terms, vectors.count()).select(F.round("penalty", 6).alias("penalty"))


@query(f"select doc_id, regexp_replace('ELI: http://data.europa.eu/eli/x ' || {_PLAIN}, 'ELI:\\s*http://data\\.europa\\.eu/eli/', '', 'g') as text from documents")
def without_law_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.without_law_references(F.concat(F.lit("ELI: http://data.europa.eu/eli/x "), F.col("text"))).alias("text"))


@query(f"select doc_id, regexp_replace(regexp_replace(regexp_replace('<p>' || regexp_replace({_PLAIN}, '[<>]', 'x', 'g') || '</p>', '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g').regexp_replace('^\\s+|\\s+$', '', 'g') as text from documents")
def notice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<p>"), F.regexp_replace("text", "[<>]", "x"), F.lit("</p>"))
    return _docs(spark, sf_dir).select("doc_id", cleaning.notice_text(text).alias("text"))


@query(
    f"with p as (select doc_id, unnest(regexp_split_to_array({_PLAIN}, '\\n\\s*\\n')) as p, generate_subscripts(regexp_split_to_array({_PLAIN}, '\\n\\s*\\n'), 1) as i from documents), "
    "q as (select doc_id, i, regexp_replace(regexp_replace(p, '\\s*\\n\\s*', ' ', 'g'), '^\\s+|\\s+$', '', 'g') as p from p) select doc_id, coalesce(string_agg(p, chr(10) || chr(10) order by i) filter (p <> ''), '') as text from q group by doc_id"
)
def merged_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.merged_paragraphs(F.col("text")).alias("text"))


@query(f"select doc_id, {_normal('t')} as text from (select doc_id, {_PLAIN} as t from documents)")
def normalized_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", cleaning.normalized(F.col("text")).alias("text"))


@query("select doc_id, case when text <> replace(text, 'o', 'u') then position('o' in text) - 1 end as place from documents where text is not null")
def first_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a round trip that loses a letter first shows, in every text."""
    own = table(spark, sf_dir, "documents").where("text is not null")
    return own.select("doc_id", training.first_difference(F.col("text"), F.replace("text", F.lit("o"), F.lit("u"))).cast("long").alias("place"))
