"""Queries over the project's tables for the operators of this folder, and the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.common import table
from factlake.llm import encoding, language, leakage, main_content, packing, repeated_lines, sentences


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose snippet holds characters that come from a wrong decoding."""
    return encoding.damaged_rows(table(spark, sf_dir, "extracted_facts"), "fact_id", "raw_snippet").select("fact_id").distinct()


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged facts with the original snippet as far as it can be recovered."""
    rows = encoding.damaged_rows(table(spark, sf_dir, "extracted_facts"), "fact_id", "raw_snippet")
    return rows.select("fact_id", F.col("text").alias("raw_snippet"), "restored", "spans", "lost").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of lines that a site repeats across its documents."""
    return repeated_lines.repeated_occurrences(table(spark, sf_dir, "chunks"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk without the lines that its site repeats."""
    return repeated_lines.without_repeated_lines(table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence unit of every chunk ends."""
    return sentences.sentence_ends(table(spark, sf_dir, "chunks"))


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every chunk with their text."""
    return sentences.sentences(table(spark, sf_dir, "chunks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are page furniture."""
    return main_content.furniture(table(spark, sf_dir, "chunks"))


def p4_main_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its main body only."""
    return main_content.main_body(table(spark, sf_dir, "chunks"))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container, for each kind of container."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "capacities"))


def p6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used and needed at least, by kind."""
    return packing.quality(p6_pack(spark, sf_dir), table(spark, sf_dir, "capacities"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least twelve words in a row with an evaluation item."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "golden_items").select("item_id", "query", "expected"))
    return found.select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leak, whole or edited, the part of the item, the longest shared run and the edit distance of the whole part."""
    items = table(spark, sf_dir, "golden_items").select("item_id", "query", "expected")
    return leakage.leaks(table(spark, sf_dir, "documents"), items, edits=leakage.EDITS)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents whose label is missing or wrong, or that mix languages."""
    return language.mislabelled(language.segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")))


def p8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's languages with share and confidence."""
    return language.languages(language.segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")))


def p8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit of every document with language and confidence."""
    return language.listed(language.segments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")))


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_cleaned, p3_found, p3_sentences, p4_found, p4_main_body, p6_pack, p6_quality, p7_found, p7_report, p8_found, p8_languages, p8_segments)}
_WINDOW = "concat_ws(' ', w, " + ", ".join(f"lead(w, {i}) over o" for i in range(1, 12)) + ")"
_REPEATED = r"""
with own as (select chunk_id, doc_id, text, nullif(regexp_replace(regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1), '^(?:www|m)\.', ''), '') as site from chunks),
 of_doc as (select doc_id, min(site) as doc_site from own where site is not null group by 1),
 c as (select chunk_id, own.doc_id, text, coalesce(site, doc_site) as site from own left join of_doc on of_doc.doc_id = own.doc_id),
 l as (select chunk_id, doc_id, site, text, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from c where site is not null),
 k as (select chunk_id, doc_id, site, text, line_no, replace(lower(regexp_replace(line, '[^\p{L}]+', '', 'g')), 'ß', 'ss') as key from l),
 n as (select site, count(distinct doc_id) as n from c group by 1),
 f as (select site, key, count(distinct doc_id) as f from k where key <> '' group by 1, 2)"""
# Only what plain SQL can state over the whole tables; the other queries are tested against brute force, round trips and held-out accuracy.
SQL: dict[str, str] = {
    "p2_found": _REPEATED + " select distinct chunk_id, cast(line_no as int) as line_no from k join f using (site, key) join n using (site) where f >= 5 and f >= 0.04 * n",
    "p2_cleaned": _REPEATED + r""",
 g as (select chunk_id, text, list(distinct line_no) as gone from k join f using (site, key) join n using (site) where f >= 5 and f >= 0.04 * n group by 1, 2),
 t as (select distinct chunk_id, text from chunks)
select t.chunk_id, case when gone is null then t.text else array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: not list_contains(gone, i)), chr(10)) end as text, coalesce(len(gone), 0) as removed
from t left join g on g.chunk_id = t.chunk_id and g.text = t.text""",
    "p7_found": r"""
with d as (select doc_id, regexp_extract_all(replace(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{206F}\x{FEFF}]+', '', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+') as w from documents),
 t as (select item_id, query as text from golden_items union all select item_id, expected from golden_items),
 i as (select item_id, regexp_extract_all(replace(lower(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{206F}\x{FEFF}]+', '', 'g')), 'ß', 'ss'), '[\p{L}\p{N}]+') as w from t),
 du as (select doc_id, unnest(w) as w, unnest(range(len(w))) as k from d),
 iu as (select item_id, row_number() over () as t, w from i), iv as (select item_id, t, unnest(w) as w, unnest(range(len(w))) as k from iu),
 dw as (select doc_id, """ + _WINDOW + r""" as h from du window o as (partition by doc_id order by k) qualify lead(w, 11) over o is not null),
 iw as (select distinct item_id, """ + _WINDOW + r""" as h from iv window o as (partition by t order by k) qualify lead(w, 11) over o is not null)
select distinct doc_id, item_id from dw join iw using (h)""",
}
