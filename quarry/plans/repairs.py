"""Queries of text repair on documents into which marks of damage are put, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import repair
from quarry.plans.sets import query
from quarry.plans.tables import table

_PLAIN = "regexp_replace(text, '[^\\x00-\\x7f]', 'e', 'g')"


def _plain(text: Column) -> Column:
    """ASCII alone, so that character classes mean the same to both engines."""
    return F.regexp_replace(text, r"[^\x00-\x7f]", "e")


def _docs(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", text.alias("text"))


def _id() -> Column:
    return F.col("doc_id").cast("string")



def _every(n: int, mark: Column | str, r: int = 0) -> Column:
    """The mark in each n-th document, else nothing."""
    return F.when(F.col("doc_id") % n == r, mark if isinstance(mark, Column) else F.lit(mark)).otherwise("")


def _sql_every(n: int, mark: str, r: int = 0) -> str:
    return f"case when doc_id % {n} = {r} then {mark} else '' end"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _legacy() -> Column:
    return F.concat(_plain(F.col("text")), _every(3, "\n  pag. 12  \nChapter one ........... 14\n"), _every(4, "a broken-\n  word and more.....\n\n\n\nab\nno.\n• item\n"))
_LEGACY_SQL = f"select doc_id, {_PLAIN} || {_sql_every(3, _lit(chr(10) + '  pag. 12  ' + chr(10) + 'Chapter one ........... 14' + chr(10)))} || {_sql_every(4, _lit('a broken-' + chr(10) + '  word and more.....' + chr(10) * 4 + 'ab' + chr(10) + 'no.' + chr(10) + '• item' + chr(10)))} as t from documents"



def _replace(t: str, *rules: tuple[str, str, str]) -> str:
    for pattern, to, flags in rules:
        t = f"regexp_replace({t}, {_lit(pattern)}, {_lit(to)}, '{flags}')"
    return t


_STRIP = (r"^\s+|\s+$", "", "g")


@query(
    f"with a as ({_LEGACY_SQL}), b as (select doc_id, "
    + _replace("t", (r"\f", "\n", "g"), (r"\t{2,}", "\t", "g"), (r"[\x00-\x08\x0b\x0e-\x1f\x7f]", "", "g"), (r"(?m)^[\s]*(?:(?:pag(?:ina)?\.?\s*)?[0-9]{1,5}|[-]\s*[0-9]{1,5}\s*[-]|[ivxlcdm]+)[\s]*$", "", "gi"), (r"(?m)[.\s]{5,}\s*\d+\s*$", "", "g"), (r"(\w{2,})-\s*\n\s*(\w{2,})", r"\1\2", "g"), (r"\.{4,}", "…", "g"), (r"(?m)[ \t]+$", "", "g"), (r"\n{3,}", "\n\n", "g"))
    + " as t from a), c as (select doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: case when regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '' then '' when length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 3 or "
    "contains('.!?:;»”’\"', right(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), 1)) then x end), lambda x: x is not null), chr(10)) as t from b) select doc_id, "
    + _replace("t", (r"(?m)^[\s]*[•▪▸►◆◇→‣⁃■□●○]\s*", "- ", "g"), (r"\n{3,}", "\n\n", "g"), _STRIP)
    + " as text from c"
)
def legacy_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _legacy())
    return docs.select("doc_id", repair.legacy_normalized(F.col("text")).alias("text"))


@query(
    "with p as (select source, doc_id, 'Report ' || doc_id || chr(10) || text || chr(10) || 'Page ' || doc_id || ' of 99' as text from documents), "
    "l as (select source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '') as l from p), "
    "e as (select source, unnest(list_distinct(list_transform(list_concat(list_slice(l, 1, 2), case when len(l) > 2 then list_slice(l, -2, -1) else [] end), lambda x: regexp_replace(x, '\\p{Nd}+', '#', 'g')))) as line from l), "
    "n as (select source, count(*) as n from p group by 1), g as (select source, list(line) as gone from (select source, line, count(*) as c from e group by all) join n using (source) where n >= 3 and c >= greatest(2, n // 2) and length(line) < 200 group by source) "
    "select source, doc_id, case when gone is null then text else array_to_string(list_filter(string_split(text, chr(10)), lambda x: not list_contains(gone, regexp_replace(regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '\\p{Nd}+', '#', 'g'))), chr(10)) end as text from p left join g using (source)"
)
def without_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source, each with a running head and foot."""
    pages = _docs(spark, sf_dir, F.concat(F.lit("Report "), _id(), F.lit("\n"), F.col("text"), F.lit("\nPage "), _id(), F.lit(" of 99")))
    return repair.without_furniture(pages, "source", "doc_id", "text").select("source", "doc_id", "text")


def _gazette() -> Column:
    return F.concat(F.lit("GU L del 3.4."), F.lit("2005 IT x\n"), F.col("text"), _every(2, "\n L 12/34 IT Gazzetta ufficiale dell'Unione\nend"))



@query("select doc_id, regexp_replace('GU L del 3.4.2005 IT x' || chr(10) || text || case when doc_id % 2 = 0 then chr(10) || ' L 12/34 IT Gazzetta ufficiale dell''Unione' || chr(10) || 'end' else '' end, '(?m)^\\s*(?:(?:\\d{1,2}\\.\\d{1,2}\\.\\d{4}\\s+)?IT\\s+Gazzetta\\s+ufficiale|L\\s+\\d{1,4}/\\d{1,4}\\s+IT\\s+Gazzetta\\s+ufficiale|GU\\s+L\\s+del\\s+\\d{1,2}\\.\\d{1,2}\\.\\d{4}\\s+IT).*$', '', 'gi') as text from documents")
def without_gazette_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _gazette()).select("doc_id", repair.without_gazette_lines(F.col("text")).alias("text"))


_COLUMNS = "europea, in partico- simultaneamente la Il presidente del Consiglio decide Articolo 7 e PARTE PRIMA DELLE NORME (1) di (9) e (2) poi rica;particolare d'Ame-Visto controllo anti-nebbia"
def _damaged() -> Column:
    return F.concat(F.substring(_plain(F.col("text")), 1, 300), _every(3, "\n\n" + _COLUMNS), _every(4, F.concat(F.lit("\n\nL 12/"), _id(), F.lit(" IT Gazzetta ufficiale e dopo."))))
_DAMAGED_SQL = f"substring({_PLAIN}, 1, 300) || {_sql_every(3, _lit(chr(10) * 2 + _COLUMNS))} || {_sql_every(4, _lit(chr(10) * 2 + 'L 12/') + ' || doc_id || ' + _lit(' IT Gazzetta ufficiale e dopo.'))}"



def _count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {_lit(pattern)}))"


def _signals(t: str) -> dict[str, str]:
    heads, tails = (f"regexp_extract_all({t}, {_lit(repair.HYPHENED)}, {k})" for k in (1, 2))
    names = lambda xs: "(" + ", ".join(_lit(x) for x in xs) + ")"
    numbers = f"list_transform(regexp_extract_all({t}, '\\((\\d+)\\)', 1), lambda x: x::double)"
    return {
        "gazette": _count(t, repair.GAZETTE), "marker": _count(t, repair.BEFORE_MARKER + repair.MARKER),
        "hyphen": f"len(list_filter(list_zip({heads}, {tails}), lambda z: z[1] not in {names(repair.PREFIXES)} and z[1] || z[2] not in {names(repair.COMPOUNDS)} and not regexp_matches(z[1], '({'|'.join(repair.WORD_ENDS)})$')))",
        "capitals": _count(t, repair.BEFORE_CAPITALS + repair.CAPITALS),
        "jumps": f"case when len({numbers}) >= 3 then len(list_filter(list_zip(list_slice({numbers}, 1, -2), list_slice({numbers}, 2, -1)), lambda z: abs(z[2] - z[1]) > 2)) else 0 end",
        "clause": _count(t, "[a-zà-ú]" + repair.CLAUSE), "fused": f"{_count(t, repair.FUSED)} + len(list_filter(regexp_extract_all({t}, '.{{0,5}}[a-zà-ú]-[A-ZÀ-Ú][a-zà-ú]'), lambda x: contains(x[1:len(x) - 3], '''')))",
    }


_SIGNALS = ", ".join(f"({x})::int as {k}" for k, x in _signals("t").items())


@query(f"select doc_id, {_SIGNALS} from (select doc_id, {_DAMAGED_SQL} as t from documents)")
def merge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, _damaged())
    return docs.select("doc_id", *[x.alias(k) for k, x in repair.merge_signals(F.col("text")).items()])


_SCORE = "(" + " + ".join(f"{w} * ({x})" for w, x in ((repair.WEIGHTS[k], x) for k, x in _signals("p").items())) + ") / greatest(1, len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')))"


@query(
    f"with a as (select doc_id, regexp_replace({_DAMAGED_SQL}, '(?m)^\\s*(?:(?:\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}\\s+)?IT\\s+Gazzetta\\s+ufficiale|L\\s+\\d{{1,4}}/\\d{{1,4}}\\s+IT\\s+Gazzetta\\s+ufficiale|GU\\s+L\\s+del\\s+\\d{{1,2}}\\.\\d{{1,2}}\\.\\d{{4}}\\s+IT).*$', '', 'gi') as t from documents), "
    "b as (select doc_id, unnest(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')) as p, generate_subscripts(list_filter(list_transform(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), 1) as i from a), "
    f"c as (select doc_id, i, p, case when len(list_filter(regexp_split_to_array(p, '\\s+'), lambda w: w <> '')) >= 10 then {_SCORE} end as s from b), "
    "d as (select doc_id, count(*) as n, count(s) as judged, count(*) filter (s is null or s <= 0.08) as clean, string_agg(p, chr(10) || chr(10) order by i) filter (s is null or s <= 0.08) as text from c group by doc_id) "
    "select doc_id, case when judged > 0 and (n - clean) / judged > 0.40 and clean < 2 then '' else coalesce(text, '') end as text from d union all select doc_id, '' from a where regexp_matches(t, '^\\s*$')"
)
def column_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _damaged()).select("doc_id", repair.column_repaired(F.col("text")).alias("text"))


def _table() -> Column:
    return F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("an..35 n1 9x R O C D "), F.col("text"))).when(F.col("doc_id") % 5 == 1, F.concat(F.repeat(F.lit("BEL bel "), 40), F.substring("text", 1, 60))).otherwise(F.col("text"))



@query(
    "with a as (select doc_id, case when doc_id % 5 = 0 then 'an..35 n1 9x R O C D ' || " + _PLAIN + " when doc_id % 5 = 1 then repeat('BEL bel ', 40) || substring(" + _PLAIN + ", 1, 60) else " + _PLAIN + " end as t from documents), "
    "b as (select *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') as w from a), c as (select *, len(w) as n, len(list_filter(list_zip(list_slice(w, 1, -2), list_slice(w, 2, -1)), lambda z: lower(z[1]) = lower(z[2]))) as r, "
    "len(list_distinct(list_filter(list_transform(w, lambda x: trim(lower(x), '.,;:()\"''')), lambda x: length(x) > 1))) as u, len(list_filter(w, lambda x: regexp_matches(x, '^\"?[ROCD]\"?$'))) as m from b) "
    f"select doc_id, n >= 20 and (r / n > 0.15 or u / n < 0.30 or {_count('t', repair.DATA_TYPE)} >= 3 or {_count('t', repair.STOCK)} >= 5 or (m / n > 0.05 and n > 30)) as garbage from c"
)
def garbage_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", _plain(F.col("text"))).select("doc_id", _table().alias("text"))
    return docs.select("doc_id", repair.is_garbage(F.col("text")).alias("garbage"))


def _notes() -> Column:
    return F.concat(F.lit("(1) Regolamento x\n"), _plain(F.col("text")), _every(2, "\n ( 3 )  GU L 4\nABC/12-3 \n(4) altro"))



@query(f"select doc_id, regexp_replace(regexp_replace('(1) Regolamento x' || chr(10) || {_PLAIN} || {_sql_every(2, _lit(chr(10) + ' ( 3 )  GU L 4' + chr(10) + 'ABC/12-3 ' + chr(10) + '(4) altro'))}, '(?m)^\\s*\\(\\s*\\d+\\s*\\)\\s+((?:GU\\s|Regolamento\\b|Decisione\\b|Direttiva\\b|Cfr\\b|V\\.\\b|Ib\\b|Op\\b))', '\\1', 'gi'), '(?m)^\\s*[A-Z]{{2,10}}[/\\-]\\S+\\s*$', '', 'g') as text from documents")
def without_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _notes()).select("doc_id", repair.without_notes(F.col("text")).alias("text"))


def _law() -> Column:
    return F.concat(F.regexp_replace(_plain(F.col("text")), r"([a-z]) ([A-Z])", "$1$2"), _every(2, F.concat(F.lit("proceduraDirettive 234CE art5\t\tx\r\n\n\n\n  y"), _id())))



@query(
    "select doc_id, " + _replace(
        f"regexp_replace({_PLAIN}, '([a-z]) ([A-Z])', '\\1\\2', 'g') || case when doc_id % 2 = 0 then 'proceduraDirettive 234CE art5' || chr(9) || chr(9) || 'x' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || '  y' || doc_id else '' end",
        (r"\r\n?", "\n", "g"), (r"([a-z])([A-Z])", r"\1 \2", "g"), (r"(\d)([A-Za-z])", r"\1 \2", "g"), (r"([A-Za-z])(\d)", r"\1 \2", "g"), (r"[ \t\f\v]+", " ", "g"), (r"(?m)^[ \x1c-\x1f]+|[ \x1c-\x1f]+$", "", "g"), (r"\n{3,}", "\n\n", "g"), _STRIP,
    ) + " as text from documents"
)
def legal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _law()).select("doc_id", repair.legal_text(F.col("text")).alias("text"))


def _file() -> Column:
    return F.concat(F.lit("\n\nSentenza della Corte "), _id(), F.lit("\n"), _plain(F.col("text")), F.lit("\n\n\n"), F.substring(_plain(F.col("text")), 1, 700), _every(2, "\nGU L 318 del\nshort"))



@query(
    f"with f as (select doc_id, chr(10) || chr(10) || 'Sentenza della Corte ' || doc_id || chr(10) || {_PLAIN} || chr(10) || chr(10) || chr(10) || substring({_PLAIN}, 1, 700) || {_sql_every(2, _lit(chr(10) + 'GU L 318 del' + chr(10) + 'short'))} as t from documents), "
    "l as (select doc_id, unnest(regexp_split_to_array(t, '\\r\\n?|\\n')) as line, generate_subscripts(regexp_split_to_array(t, '\\r\\n?|\\n'), 1) - 1 as i from f), "
    "b as (select *, regexp_matches(line, '[^\\s]') as has, last_value(case when regexp_matches(line, '[^\\s]') then i end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from l), "
    f"n as (select *, sum(case when has and before is not null and (regexp_matches(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), {_lit(repair.LEGAL_HEADER)}) or i - before > 2) then 1 else 0 end) over (partition by doc_id order by i) as doc_ix from b), "
    "d as (select doc_id, doc_ix, regexp_replace(string_agg(line, chr(10) order by i), '^\\s+|\\s+$', '', 'g') as text from n group by all) "
    "select doc_id, doc_ix::bigint as doc_ix, text from (select *, max(doc_ix) over (partition by doc_id) as final from d) where length(text) >= 500 or (doc_ix = final and text <> '')"
)
def legal_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.legal_documents(_docs(spark, sf_dir, _file()), "doc_id", "text").select("doc_id", F.col("doc_ix").cast("long").alias("doc_ix"), "text")


def _program() -> Column:
    return F.concat(
    F.lit("ID\n LINKAGE SECTION.\n01 A\n"), F.substring("text", 1, 40), F.lit("\n Working-Storage Section.\n02 B"), _id(), _every(3, "\n procedure division.\n STOP"), F.lit("\n LINKAGE SECTION.\n03 C")
)
_PROGRAM_SQL = f"'ID' || chr(10) || ' LINKAGE SECTION.' || chr(10) || '01 A' || chr(10) || substring(text, 1, 40) || chr(10) || ' Working-Storage Section.' || chr(10) || '02 B' || doc_id || {_sql_every(3, _lit(chr(10) + ' procedure division.' + chr(10) + ' STOP'))} || chr(10) || ' LINKAGE SECTION.' || chr(10) || '03 C'"



@query(
    f"with p as (select doc_id, {_PROGRAM_SQL} as t from documents), l as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from p), "
    "k as (select *, upper(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) as u from l), m as (select *, case when starts_with(u, 'WORKING-STORAGE SECTION.') then 1 when starts_with(u, 'LINKAGE SECTION.') then 2 when starts_with(u, 'PROCEDURE DIVISION') then 3 end as k from k), "
    "s as (select *, coalesce(last_value(k ignore nulls) over (partition by doc_id order by i), 0) as part from m) select doc_id, string_agg(case when k = 3 then '       PROCEDURE DIVISION USING LINKED-ITEMS.' else line end, chr(10) order by part, i) as text from s group by doc_id"
)
def sections_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, _program()).select("doc_id", repair.sections_ordered(F.col("text")).alias("text"))


@query(
    "with p as (select doc_id, text || case when doc_id % 2 = 0 then chr(10) || '```cobol' || chr(10) || 'MOVE ' || doc_id || chr(10) || '``` and ```x```' else '' end as t from documents) select doc_id, case when regexp_matches(t, '(?is)```(?:cobol)?\\s*\\n(.*?)```') then regexp_extract(t, '(?is)```(?:cobol)?\\s*\\n(.*?)```', 1) else t end as text from p"
)
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.col("text"), _every(2, F.concat(F.lit("\n```cobol\nMOVE "), _id(), F.lit("\n``` and ```x```"))))
    return _docs(spark, sf_dir, text).select("doc_id", repair.code_block(F.col("text")).alias("text"))
