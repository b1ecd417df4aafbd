"""DuckDB SQL with the same results as the core's queries, written from the tables alone. Patterns and phrases come from the fixed-value lists."""

from __future__ import annotations

import calendar

from factlake.functions import dictionaries as D


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, phrases) -> str:
    return "(" + " or ".join(f"contains({column}, {_lit(p)})" for p in phrases) + ")"


def _case_pairs(column: str, groups, default: str) -> str:
    return "case " + " ".join(f"when {_any(column, ps)} then {_lit(n)}" for n, ps in groups) + f" else {default} end"


def _hits(column: str, patterns) -> str:
    return " + ".join(f"cast(regexp_matches({column}, {_lit(p)}) as int)" for p in patterns)


_DOC_TOKENS = r"""
 tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents where text is not null),
 len as (select doc_id, count(*) as length from tok group by 1),
 stat as (select count(*) as n, avg(length) as avgdl from len),
 post as (select doc_id, term, count(*) as tf from tok group by 1, 2),
 raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from post, stat group by term),
 idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


def _ranked(name: str, body: str, which: str = "item_id % 100 = 0") -> str:
    return rf"""
 {name}q as (select item_id as query_id, t as term, count(*) as times from (select item_id, unnest(regexp_extract_all(lower({body}), '[\p{{L}}\p{{N}}_]+')) as t from golden_items where {which}) group by 1, 2),
 {name}s as (select query_id, p.doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))) as score
   from {name}q q join post p on p.term = q.term join idf i on i.term = q.term join len l on l.doc_id = p.doc_id, stat group by 1, 2),
 {name} as (select query_id, doc_id, score, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as rank from {name}s qualify rank <= 10)"""


_FUSED = f"""with {_DOC_TOKENS}, {_ranked("dq", "expected")}, {_ranked("sq", "query")},
 d as (select query_id, doc_id as id, rank, score / max(score) over (partition by query_id) as score from dq),
 s as (select query_id, doc_id as id, rank, case when max(score) over (partition by query_id) > 0 then least(0.75 + 0.15 * score / max(score) over (partition by query_id), 0.9) else 0.75 end as score from sq),
 u as (select query_id, id, 1 / (60 + rank) as r, score as dense, null as sparse from d union all select query_id, id, 1 / (60 + rank), null, score from s),
 g as (select query_id, id, sum(r) as rrf, max(dense) as dense, max(sparse) as sparse from u group by 1, 2),
 f as (select query_id, id, rrf, round(coalesce(dense, sparse), 4) as similarity, case when dense is not null and sparse is not null then 'dense+bm25' when dense is not null then 'dense' else 'bm25' end as retriever,
   row_number() over (partition by query_id order by round(rrf, 9) desc, id) as rank from g),
 k as (select query_id, id, row_number() over (partition by query_id order by similarity desc, rank) as rank from f where similarity >= 0.75)"""


def _collapse(column: str) -> str:
    # all white space of Unicode, as \s in Java's Unicode mode
    return rf"trim(regexp_replace({column}, '[\t\n\x0B\f\r\x{{85}}\pZ]+', ' ', 'g'))"


def _numbers(column: str) -> str:
    out = column
    for pattern in (r"(\d),(\d{3})", r"(\d),(\d{3})", r"(\d),(\d{3})", r"(\d),(\d{2})", r"(\d),(\d{2})", r"(\d),(\d{2})", r"(\d),(\d{2})"):
        out = rf"regexp_replace({out}, '{pattern}', '\1\2', 'g')"
    return out


_MONTHS = {n.lower(): i for t in (calendar.month_abbr, calendar.month_name) for i, n in enumerate(t) if n}
_MONTH = "case lower(mon) " + " ".join(f"when '{n}' then '{i:02d}'" for n, i in sorted(_MONTHS.items())) + " end"


def _iso(column: str) -> str:
    p = r"(\d{1,2})\s+([A-Za-z]{3,})\s+(\d{4})"
    month = _MONTH.replace("mon)", f"regexp_extract({column}, '{p}', 2))")
    return f"case when regexp_matches({column}, '{p}') then case when {month} is not null then regexp_extract({column}, '{p}', 3) || '-' || {month} || '-' || lpad(regexp_extract({column}, '{p}', 1), 2, '0') end else nullif(regexp_extract({column}, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') end"


_MONEY = ", ".join(map(_lit, D.MONEY_FACTS))
_CURRENCY = r"[\$\x{A2}-\x{A5}\x{9F2}\x{9F3}\x{AF1}\x{BF9}\x{E3F}\x{17DB}\x{20A0}-\x{20CF}\x{A838}\x{FDFC}\x{FE69}\x{FF04}\x{FFE5}\x{FFE6}]"
_CLEANED = _numbers(f"regexp_replace({_collapse('value')}, '{_CURRENCY}', '₹', 'g')")
_TYPED = rf"""with c as (select distinct fact_id, fact_type, value, {_CLEANED} as v from (select distinct fact_id, fact_type, value from extracted_facts)),
 t as (select fact_id, fact_type, value, case when fact_type = 'inception_date' then {_iso("v")}
   when fact_type in ('expense_ratio', 'exit_load') then case when regexp_full_match(v, '[0-9]+(\.[0-9]+)?') then v || '%' else v end
   when fact_type in ({_MONEY}) then case when starts_with(v, '₹') then v else regexp_replace(v, '(^|\s)([0-9])', '\1₹\2', 'g') end else v end as nv from c),
 r as (select fact_id, fact_type, nv as normalized_value, case when nv is null and value is not null and fact_type = 'inception_date' then 'Date enforcement failed: not YYYY-MM-DD'
   when nv is null or trim(nv) = '' then 'Empty value after normalization'
   when fact_type = 'expense_ratio' and not contains(nv, '%') then 'Percentage enforcement failed: missing %'
   when fact_type = 'expense_ratio' and not regexp_matches(nv, '[0-9]') then 'No numeric value found'
   when fact_type in ({_MONEY}) and not contains(nv, '₹') then 'Currency enforcement failed: missing ₹'
   when fact_type = 'inception_date' and not regexp_full_match(nv, '\d{{4}}-\d{{2}}-\d{{2}}') then 'Date enforcement failed: not YYYY-MM-DD' end as rejection_reason from t)"""


def _terms(column: str) -> str:
    t = rf"trim(regexp_replace(regexp_replace(lower({column}), '[^\p{{L}}\p{{M}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    for name, stands_for in sorted(D.SYNONYMS, key=lambda kv: -len(kv[0])):
        t = f"replace({t}, {_lit(name)}, {_lit(stands_for)})" if " " in name else rf"regexp_replace({t}, '\b{name}\b', {_lit(stands_for)}, 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\bfund fund\b', 'fund', 'g'), '\bscheme scheme\b', 'scheme', 'g')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _first_name(column: str) -> str:
    return "case " + " ".join(f"when contains({column}, {_lit(n)}) then {_lit(k)}" for n, k in sorted(D.FACT_NAMES, key=lambda kv: -len(kv[0]))) + " end"


_SLUG = "lower(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'))"
_NAME = rf"trim(regexp_replace(regexp_replace(replace(replace(replace(replace({_SLUG}, '-direct-growth', ''), '-direct', ''), '-growth', ''), '-', ' '), '[()]', '', 'g'), '\s+', ' ', 'g'))"
_INTENT = f"""case when regexp_matches(low, {_lit(D.URL)}) then 'URL_ADDITION' when a + f = 0 then 'UNCLEAR' when a / (a + f) >= 0.5 then 'ADVISORY' else 'FACTUAL' end"""
_HITS = f"({_hits('low', D.ADVISORY)}) as a, ({_hits('low', D.FACTUAL)}) as f"
_HTML = """'<html><head><title>Page</title><style>p {}</style></head><body><!-- top --><nav>Menu</nav><article><p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p>' || chr(10) || '<p>') || '</p></article><footer>Terms</footer></body></html>'"""


def _visible(column: str) -> str:
    t = f"regexp_replace({column}, '<!--.*?-->', ' ', 'gs')"
    for tag in ("script", "style", "nav", "footer", "header", "aside"):
        t = rf"regexp_replace({t}, '(?is)<{tag}\b.*?</{tag}\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', chr(10), 'g')"
    for e, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, '{e}', '{c}')"
    return rf"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^[\t\n\x0B\f\r\x{{85}}\pZ]+|[\t\n\x0B\f\r\x{{85}}\pZ]+$', '', 'g')), lambda x: x <> ''), chr(10))"


def _words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array({column}, '[\t\n\x0B\f\r\x{{85}}\pZ]+'), lambda x: x <> '')"


_VALUES = ("expense_ratio", "nav", "min_sip", "min_lumpsum", "inception_date", "fund_manager")


def _value(kind: str, pattern: str) -> str:
    v = f"trim(replace(trim(regexp_extract(text, {_lit(pattern)}, 1), ' '), '?', ''), ' ')"
    if kind in ("nav", "min_sip", "min_lumpsum"):
        return f"'₹' || rtrim({v}, '.,; ')"
    return f"{v} || '%'" if kind == "expense_ratio" else v


_TOTALS = r"""with t as (select chunk_id, max(case when len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) > 0 then 1 else 0 end) as good from chunks group by 1)
 select count(*) as total_chunks, sum(good)::bigint as embedded, (count(*) - sum(good))::bigint as rejected, (select count(*) from structured_fact) as facts_stored, (select count(distinct doc_id) from chunks) as documents from t"""
_CHECKS = rf"""with m as ({_TOTALS}), log as (select count(distinct doc_id) as n from fetch_result where status = 'success'),
 listed as (select distinct doc_id from fetch_result),
 cov as (select count(*) as n, count(*) filter (doc_id not in (select doc_id from chunks) or doc_id not in (select doc_id from structured_fact)) as bad from listed),
 vec as (select count(*) as n, count(*) filter (len(embedding) <> 64 or abs(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) - 1) > 0.01) as bad from embeddings),
 f as (select concat_ws('; ', case when rejected <> 0 then 'rejected chunks' end, case when documents < log.n then 'documents missing' end) as said from m, log),
 k as (select 'manifest' as name, said = '' as passed, case when said = '' then 'valid' else said end as message from f
  union all select 'fact_store', facts_stored > 0, facts_stored || ' rows' from m
  union all select 'chunk_table', false, 'missing columns: embedding'
  union all select 'store_count', total_chunks = embedded, total_chunks || ' of ' || embedded from m
  union all select 'fact_count', true, facts_stored || ' of ' || facts_stored from m
  union all select 'coverage', bad = 0 and n > 0, bad || ' of ' || n || ' documents incomplete' from cov
  union all select 'integrity', bad = 0 and n > 0, bad || ' of ' || n || ' vectors invalid' from vec
  union all select 'fact_types', count(distinct fact_type) = 3, case when count(distinct fact_type) = 3 then 'all' else 'missing' end from structured_fact where fact_type in ('nav', 'aum', 'exit_load'))"""

_SPACE = r"[\t\n\x0B\f\r\x{85}\pZ]"


def _sentences(column: str) -> str:
    """Sentences of a text: periods of abbreviations are hidden one abbreviation after the other, then every end before a capital is marked."""
    t = column
    for a in sorted(D.ABBREVIATIONS, key=len, reverse=True):
        t = rf"regexp_replace({t}, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]){a}\.', '\1{a}' || chr(1), 'g')"
    t = rf"regexp_replace({t}, '([.!?]){_SPACE}+([A-Z])', '\1' || chr(2) || '\2', 'g')"
    return rf"list_filter(list_transform(string_split({t}, chr(2)), lambda x: regexp_replace(replace(x, chr(1), '.'), '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '')"


def _noise(column: str) -> str:
    return f"(not {_any(f'lower({column})', D.PROTECTED)} and {_any(f'lower({column})', D.NOISE)})"


_DEPENDENT = "|".join(D.DEPENDENT)

SQL: dict[str, str] = {
    "fact_sources": "select distinct source_url from structured_fact",
    "facts_per_document": "select doc_id, count(*) as facts, count(distinct fact_type) as types from structured_fact group by 1",
    "fact_types_of_document": "select distinct fact_type from structured_fact where doc_id = 'DOC-002'",
    "fact_count": "select count(*) as facts from structured_fact",
    "fact_sample": "select distinct id, doc_id, fact_type from structured_fact order by id limit 1",
    "fact_lookup": "select doc_id, fact_type, arg_min(value, id) as value from structured_fact where value is not null group by 1, 2",
    "facts_replaced_by_document": "with n as (select fact_id + 1000000000 as id, doc_id, fact_type, value from extracted_facts where confidence = 'HIGH') select id, doc_id, fact_type, value from structured_fact where doc_id not in (select doc_id from n) union all select * from n",
    "vectors_upserted": "select vec_id, cast(label as bigint) + case when vec_id % 3 = 0 then 100 else 0 end as label from embeddings union all select vec_id + 1000000, cast(label as bigint) from embeddings where vec_id % 3 = 0",
    "new_facts_only": "select distinct fact_id, doc_id, fact_type, value from extracted_facts f where value is not null and not exists (select 1 from structured_fact s where s.doc_id = f.doc_id and s.fact_type = f.fact_type and s.value = f.value)",
    "documents_without_facts": "select doc_id from chunks except select doc_id from structured_fact where fact_type = 'nav' and value is not null",
    "documents_in_both": "select doc_id from chunks intersect select doc_id from structured_fact",
    "latest_fetch": "select url, arg_max(status, (cast(fetched_at as timestamptz), status)) as status, arg_max(fetched_at, (cast(fetched_at as timestamptz), status)) as fetched_at from fetch_result group by 1",
    "fetch_manifest": "select count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status = 'not_modified') as not_modified, count(*) filter (status = 'failed') as failed from (select distinct * from fetch_result)",
    "fact_manifest": "select doc_id, count(*) as total, count(*) filter (confidence = 'HIGH') as \"HIGH\", count(*) filter (confidence = 'MEDIUM') as \"MEDIUM\", count(*) filter (confidence = 'LOW') as \"LOW\" from (select distinct * from extracted_facts) group by 1",
    "coverage_report": "with d as (select distinct doc_id from fetch_result), c as (select doc_id, count(*) as c from chunks group by 1), f as (select doc_id, count(*) as f from structured_fact group by 1), k as (select doc_id from d union select doc_id from c union select doc_id from f) select k.doc_id, case when d.doc_id is null then 0 else 1 end as listed, coalesce(c, 0) as chunks, coalesce(f, 0) as facts, d.doc_id is not null and coalesce(c, 0) > 0 and coalesce(f, 0) > 0 as complete from k left join d on d.doc_id = k.doc_id left join c on c.doc_id = k.doc_id left join f on f.doc_id = k.doc_id",
    "chunk_checks": "with c as (select count(*) filter (not coalesce(length(text) > 0, false)) as a, count(*) filter (source_url is null) as b, count(*) filter (not coalesce(token_count <= 250, false)) as c, count(*) filter (chunk_type is null) as d from chunks) select 'has_text' as name, a = 0 as passed, a as failures from c union all select 'has_url', b = 0, b from c union all select 'small', c = 0, c from c union all select 'typed', d = 0, d from c",
    "run_registry": "with r as (select distinct strftime(ts, '%Y-%m-%d') as run_id from events) select run_id, run_id as activated_at, lag(run_id) over (order by run_id) as previous_run_id, row_number() over (order by run_id desc) as age from r",
    "breaker_runs": "with f as (select distinct doc_id, fetched_at, status from fetch_result), g as (select *, sum(case when status = 'failed' then 0 else 1 end) over (partition by doc_id order by fetched_at, status rows unbounded preceding) as g from f) select doc_id, min(fetched_at) as started, max(fetched_at) as ended, count(*) as failures, count(*) >= 2 as opens from g where status = 'failed' group by doc_id, g",
    "backoff_schedule": "select i as attempt, least(60.0, 5.0 * pow(2.0, i - 1))::double as seconds from range(1, 9) t(i)",
    "whitelisted_chunks": "select chunk_id, source_url from chunks where source_url like 'https://%' and source_url in (select url from fetch_result where status = 'success')",
    "security_events": "select chunk_id, source_url from chunks where source_url is null or source_url not in (select url from fetch_result where status = 'success')",
    "address_parts": "select distinct url, regexp_extract(url, '^([a-z]+)://', 1) as protocol, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host, regexp_extract(url, '[^/]*$') as slug, replace(regexp_extract(url, '[^/]*$'), '-', ' ') as name from fetch_result",
    "document_ids": "with s as (select url, min(doc_id) as doc_id from fetch_result group by 1), a as (select distinct chunk_id, source_url as url from chunks) select chunk_id, a.url, coalesce(doc_id, 'DOC-UNKNOWN') as doc_id from a left join s on s.url = a.url",
    "fund_aliases": f"with n as (select doc_id, {_NAME} as a from fetch_result where url is not null), e as (select doc_id, a as alias from n union all select doc_id, regexp_replace(a, ' fund$', '') from n) select alias, max(doc_id) as doc_id from e where alias <> '' group by 1",
    "visible_text": f"select chunk_id, {_visible('h')} as text from (select distinct chunk_id, {_HTML} as h from chunks)",
    "external_links": "select distinct url, url like 'http%' and not contains(url, 'gavranefunds.example') as external from fetch_result",
    "white_space_collapsed": f"select doc_id, sha256({_collapse('text')}) as digest from documents",
    "rupee_signs": f"select doc_id, sha256(regexp_replace(text, '{_CURRENCY}', '₹', 'g')) as digest from documents",
    "plain_numbers": f"select distinct value, {_numbers('value')} as plain from extracted_facts where value is not null",
    "iso_dates": f"select doc_id, {_iso('text')} as date from documents",
    "percentages": r"select distinct value, case when regexp_full_match(value, '[0-9]+(\.[0-9]+)?') then value || '%' else value end as percent from extracted_facts where value is not null",
    "extracted_from_text": " union all ".join(f"select doc_id, '{n}' as fact_type, '{c}' as confidence, length(regexp_extract(text, {_lit(p)})) as length from documents where regexp_matches(text, {_lit(p)})" for n, p, c in D.FACT_PATTERNS),
    "typed_facts": _TYPED + " select * from r",
    "rejections": _TYPED + " select fact_type, coalesce(rejection_reason, 'none') as reason, count(*) as facts from r group by 1, 2",
    "word_counts": r"select doc_id, len(list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r\x{85}\pZ]+'), lambda x: x <> '')) as words, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as tokens from documents",
    "chunk_types": f"select doc_id, {_case_pairs('lower(text)', D.CHUNK_TYPES, _lit('overview'))} as chunk_type, not {_any('lower(text)', D.PROTECTED)} and {_any('lower(text)', D.NOISE)} as noise from documents",
    "long_texts_split": r"with w as (select doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r\x{85}\pZ]+'), lambda x: x <> '') as w from documents), p as (select doc_id, w, unnest(range(0, greatest(1, (len(w) + 249) // 250))) as piece from w) select doc_id, piece, sha256(array_to_string(w[piece * 250 + 1 : piece * 250 + 250], ' ')) as digest from p",
    "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as norm, 1.0 as unit from embeddings",
    "vector_integrity": "with v as (select len(embedding) as n, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as l, len(list_filter(embedding, lambda x: isnan(x))) as nan, len(list_filter(embedding, lambda x: isinf(x))) as inf from embeddings) select count(*) as total, count(*) filter (n <> 64) as dimension_bad, count(*) filter (nan > 0) as nan_bad, count(*) filter (inf > 0) as inf_bad, count(*) filter (l = 0) as zero_bad, count(*) filter (l > 0 and abs(l - 1) > 0.01) as norm_bad from v",
    "vectors_aligned": "select vec_id, 32::bigint as cut, 96::bigint as padded, round(sqrt(list_sum(list_transform(embedding[1:32], lambda x: x::double * x::double))), 4) as cut_norm from embeddings",
    "dense_topk": "with q as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_dot_product(a, embedding::double[]), 9) as s from q, embeddings) select query_id, vec_id, round(s, 4) as similarity, row_number() over (partition by query_id order by s desc, vec_id) as rank from s qualify rank <= 10",
    "bm25_idf": f"with {_DOC_TOKENS} select term, df, round(idf, 4) as idf from idf",
    "bm25_topk": f"with {_DOC_TOKENS}, {_ranked('q', 'query')} select query_id, doc_id, round(score, 4) as score, rank from q",
    "rank_fusion": _FUSED + " select query_id, id, round(rrf, 6) as rrf, round(similarity, 3) as similarity, retriever, rank from f",
    "relevance_filter": _FUSED + " select query_id, id, rank from k",
    "single_source": _FUSED + ", j as (select k.query_id, k.id, d.source, k.rank, first_value(d.source) over (partition by k.query_id order by k.rank) as head from k join documents d on d.doc_id = k.id) select query_id, id, source, rank from j where source is not distinct from head",
    "fact_lookup_answers": "with q as (select doc_id, min(id) as query_id from structured_fact group by 1) select query_id, q.doc_id, arg_min(value, id) as value from q join structured_fact f on f.doc_id = q.doc_id and f.fact_type = 'expense_ratio' and f.value is not null group by 1, 2",
    "personal_data_scan": "select doc_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(text, {_lit(p)}) then '{n}' end" for n, p in D.PERSONAL_DATA) + ") as kinds from documents",
    "questions_sanitized": "select item_id, substr(trim(query), 1, 200) as query from golden_items",
    "question_intents": f"with h as (select item_id, low, {_HITS} from (select item_id, lower(query) as low from golden_items)) select item_id, {_INTENT} as classification, case when a + f = 0 or regexp_matches(low, {_lit(D.URL)}) then 0.0 else round(a / (a + f), 3) end::double as advisory_score, a::bigint as advisory_hits, f::bigint as factual_hits from h",
    "document_intents": f"with h as (select low, {_HITS} from (select lower(text) as low from documents)) select {_INTENT} as classification, count(*) as documents, sum(a)::bigint as advisory_hits, sum(f)::bigint as factual_hits from h group by 1",
    "question_terms": f"select item_id, {_terms('query')} as terms from golden_items",
    "question_fact_types": f"select item_id, {_first_name('lower(query)')} as fact_type from golden_items",
    "banned_phrases": "select doc_id, concat_ws(',', " + ", ".join(f"case when contains(lower(text), {_lit(p)}) then {_lit(p)} end" for _, ps in D.BANNED for p in ps) + ") as phrases from documents",
    "number_traceability": r"select item_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(expected, '\b\d+(?:\.\d+)?\b')), lambda n: not contains(query, n))), ',') as numbers from golden_items",
    "prompt_hashes": "select item_id, sha256('Answer from the context only.' || chr(10) || query) as hash from golden_items",
    "golden_report": rf"""with {_DOC_TOKENS}, {_ranked("rq", "query", "true")},
 h as (select query_id, max(case when contains(regexp_replace(lower(d.text), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), trim(regexp_replace(lower(g.expected), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) then 1 else 0 end) as hit from rq join documents d on d.doc_id = rq.doc_id join golden_items g on g.item_id = query_id group by 1)
 select category, count(*) as total, count(*) filter (hit = 1) as passed from golden_items left join h on query_id = item_id group by 1""",
    "stream_event_windows": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 2) as value from events group by 1, 2",
    "stream_sliding_windows": "with e as (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as s from events) select strftime(s, '%Y-%m-%d') as day, event_type, count(*) as n from e group by 1, 2",
    "stream_sessions": "with o as (select user_id, ts, case when ts < lag(ts) over (partition by user_id order by ts) + interval 30 minute then 0 else 1 end as s from events) select user_id, sum(s)::bigint as sessions, count(*) as events from o group by 1",
    "fact_rollup": "select fact_type, confidence, count(*) as facts, count(distinct doc_id) as documents from (select distinct * from extracted_facts) group by rollup (fact_type, confidence)",
    "event_cube": "select event_type, day, count(*) as n from (select event_type, strftime(ts, '%Y-%m-%d') as day from events) group by cube (event_type, day)",
    "facts_as_of": "with n as (select distinct fact_id, doc_id, fact_type, extracted_at from extracted_facts), o as (select doc_id, fact_type, indexed_at, min(value) as v from structured_fact where value is not null group by 1, 2, 3) select n.fact_id, n.doc_id, n.fact_type, o.v as earlier from n asof left join o on n.doc_id = o.doc_id and n.fact_type = o.fact_type and n.extracted_at >= o.indexed_at",
    "extracted_values": " union all ".join(f"select doc_id, '{n}' as fact_type, {_value(n, p)} as value from documents where regexp_matches(text, {_lit(p)})" for n, p, _ in D.FACT_PATTERNS if n in _VALUES),
    "fact_sentences": f"""with q as (select doc_id, min(id) as query_id from structured_fact group by 1), w as (select query_id, doc_id, 0 as pos from q union all select query_id, 'DOC-001', 1 from q),
 o as (select doc_id, arg_min(value, id) as value, arg_min(source_url, id) as url from structured_fact where fact_type = 'aum' and value is not null and source_url is not null group by 1),
 h as (select query_id, o.doc_id, value, url, row_number() over (partition by query_id order by pos) as n from w join o on o.doc_id = w.doc_id)
 select query_id, doc_id, 'The aum for ' || array_to_string(list_transform(string_split(regexp_extract(url, '[^/]*$'), '-'), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' is ' || value || '.' as sentence from h where n = 1""",
    "hybrid_fusion": f"""with {_DOC_TOKENS}, {_ranked("sq", "query")},
 v as (select vec_id as query_id, embedding::double[] as a from embeddings where vec_id % 100 = 0),
 dq as (select query_id, vec_id as id, round(list_dot_product(a, embedding::double[]), 9) as score, row_number() over (partition by query_id order by round(list_dot_product(a, embedding::double[]), 9) desc, vec_id) as rank from v, embeddings qualify rank <= 10),
 s as (select query_id, doc_id as id, rank, case when max(score) over (partition by query_id) > 0 then least(0.75 + 0.15 * score / max(score) over (partition by query_id), 0.9) else 0.75 end as score from sq),
 u as (select query_id, id, 1 / (60 + rank) as r, score as dense, null as sparse, 0 as looked from dq union all select query_id, id, 1 / (60 + rank), null, score, 0 from s union all select item_id, item_id, 1 / 61, null, null, 1 from golden_items where item_id % 100 = 0),
 g as (select query_id, id, sum(r) as rrf, max(dense) as dense, max(sparse) as sparse, max(looked) as looked from u group by 1, 2)
 select query_id, id, round(rrf, 6) as rrf, round(round(case when looked = 1 then 1.0 else coalesce(dense, sparse) end, 4), 3) as similarity,
   case when looked = 1 then 'structured' when dense is not null and sparse is not null then 'dense+bm25' when dense is not null then 'dense' else 'bm25' end as retriever,
   row_number() over (partition by query_id order by round(rrf, 9) desc, id) as rank from g""",
    "embed_totals": f"select * from ({_TOTALS})",
    "chunks_with_facts": "with c as (select doc_id, count(distinct chunk_id) as chunks from chunks group by 1), f as (select doc_id, count(*) as facts, count(distinct fact_type) as types from structured_fact where confidence = 'HIGH' and value is not null group by 1) select c.doc_id, chunks, coalesce(facts, 0) as facts, coalesce(types, 0) as types from c left join f on f.doc_id = c.doc_id",
    "audit_checks": _CHECKS + " select * from k",
    "audit_summary": _CHECKS + " select 'run-1' as run_id, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (not passed) = 0 and count(*) > 0 as live, coalesce(string_agg(name, ', ' order by name) filter (not passed), '') as failures from k",
    "registry_after_audit": _CHECKS + f", r as (select distinct strftime(ts, '%Y-%m-%d') as run_id from events) select run_id, run_id as activated_at from r union all select 'run-bad', '2026-06-01' where (select count(*) filter (not passed) = 0 from k) union all select 'run-good', '2026-06-01' where exists (select 1 from structured_fact where fact_type = 'nav')",
    "trusted_sources": "select distinct source_url, coalesce(regexp_matches(source_url, '(?i)^https?://(www\\.)?gavranefunds\\.example(/|$)'), false) as trusted from chunks",
    "chunk_table_function": r"with w as (select doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0B\f\r\x{85}\pZ]+'), lambda x: x <> '') as w from documents), p as (select doc_id, w, unnest(range(0, greatest(1, (len(w) + 249) // 250))) as piece from w) select doc_id, piece, len(w[piece * 250 + 1 : piece * 250 + 250]) as words, sha256(array_to_string(w[piece * 250 + 1 : piece * 250 + 250], ' ')) as digest from p",
    "stream_deduplicated": "select event_type, count(distinct event_id) as events from events group by 1",
    "formatted_answers": rf"""with e as (select item_id, expected, replace(replace(replace(replace(replace(expected || ' See https://nav.example/list?a=1&b=2.', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') as t from golden_items)
 select item_id, regexp_replace(t, '(https?://\S*?[^\s])([.,]?)(\s|$)', '[\1](\1)\2\3', 'g') as html, expected || chr(10) || chr(10) || 'Source: N/A' || chr(10) || 'Last updated from sources: 2026-06-01' as cited from e""",
    "context_budget": rf"""with d as (select source, doc_id, text, {_words("text")} as w, row_number() over (partition by source order by doc_id) as rank from documents where source is not null and text is not null),
 u as (select *, 2 + len({_words("source || ':'")}) + coalesce(sum(len(w)) over (partition by source order by rank rows between unbounded preceding and 1 preceding), 0) as used from d),
 p as (select source, rank, case when used + len(w) <= 2000 then text else coalesce(nullif(regexp_extract(array_to_string(w[1 : (2000 - used)::bigint], ' '), '(?s)^(.*[.!?])', 1), ''), array_to_string(w[1 : (2000 - used)::bigint], ' ')) end as part from u where used < 2000),
 c as (select source as query_id, trim('Information for ' || source || ':' || chr(10) || string_agg(part, ' ' order by rank), ' ') as context from p group by 1)
 select query_id, context, len({_words("context")}) as words from c""",
    "answer_verdicts": rf"""with a as (select category, query, lower(expected) as low, list_distinct(regexp_extract_all(expected, '\b\d+(?:\.\d+)?\b')) as n from golden_items),
 v as (select category, case when {_any("low", [p for _, ps in D.BANNED for p in ps])} then 'REJECTED_PHRASE' when len(list_filter(n, lambda x: not contains(query, x))) > 0 then 'REJECTED_NUMBER' else 'APPROVED' end as status from a)
 select category, status, count(*) as answers from v group by 1, 2""",
    "sentence_tokens": f"""with t as (select doc_id, {_sentences("text")} as s from documents), u as (select doc_id, unnest(s) as sentence, unnest(range(len(s))) as n from t)
 select doc_id, n, sentence, {_noise("sentence")} as noise, not regexp_matches(lower(sentence), '^({_DEPENDENT})') as self_contained from u""",
    "chunking_manifest": f"""with t as (select doc_id, unnest({_sentences("coalesce(text, '')")}) as s from documents), n as (select doc_id, count(*) as sentences, count(*) filter {_noise("s").join(("(where ", ")"))} as discarded from t group by 1)
 select d.doc_id, coalesce(sentences, 0) as sentences, coalesce(discarded, 0) as discarded, case when coalesce(sentences, 0) = coalesce(discarded, 0) then 'CORPUS_EMPTY' end as error from documents d left join n on n.doc_id = d.doc_id""",
    "extraction_results": f"""with p as (select distinct chunk_id, doc_id, {_HTML} as h from chunks), v as (select doc_id, {_visible("h")} as t from p),
 n as (select doc_id, {" + ".join(f"cast(regexp_matches(t, {_lit(p)}) as int)" for _, p, c in D.FACT_PATTERNS if c == "HIGH")} as high, {" + ".join(f"cast(regexp_matches(t, {_lit(p)}) as int)" for _, p, _ in D.FACT_PATTERNS)} as facts from v)
 select doc_id, high >= 2 as extraction_success, count(*) as pages, sum(facts)::bigint as facts from n group by 1, 2""",
    "semantic_chunks": f"""with recursive t as (select doc_id, {_sentences("text")} as s from documents where text is not null), k as (select doc_id, list_filter(s, lambda x: not {_noise("x")}) as s from t), u as (select doc_id, unnest(s) as s, unnest(range(1, len(s) + 1)) as i from k),
 x as (select doc_id, s, i, {_case_pairs("lower(s)", D.CHUNK_TYPES, _lit("overview"))} as t, {_words("s")} as w from u), y as (select *, len(w)::int as n from x),
 fold(doc_id, i, cur, ns, typ, em) as (
  select distinct doc_id, 0::bigint, []::varchar[], []::int[], 'overview', []::struct(body varchar, kind varchar, n int)[] from y
  union all
  select f.doc_id, f.i + 1,
   case when y.n > 250 then [] when len(cur) > 0 and list_sum(ns) + y.n > 250 then case when ns[-1] + y.n <= 250 then [cur[-1], y.s] else [y.s] end else list_append(cur, y.s) end,
   case when y.n > 250 then [] when len(cur) > 0 and list_sum(ns) + y.n > 250 then case when ns[-1] + y.n <= 250 then [ns[-1], y.n] else [y.n] end else list_append(ns, y.n) end,
   case when y.n > 250 or len(cur) > 0 and list_sum(ns) + y.n > 250 or y.t <> 'overview' then y.t else typ end,
   case when y.n > 250 then list_concat(case when len(cur) > 0 then [{{'body': array_to_string(cur, ' '), 'kind': typ, 'n': list_sum(ns)::int}}] else [] end,
      list_transform(range(0, (y.n + 249) // 250), lambda k: {{'body': array_to_string(w[k * 250 + 1 : k * 250 + 250], ' '), 'kind': y.t, 'n': len(w[k * 250 + 1 : k * 250 + 250])::int}}))
    when len(cur) > 0 and list_sum(ns) + y.n > 250 then list_concat([{{'body': array_to_string(cur, ' '), 'kind': typ, 'n': list_sum(ns)::int}}], case when ns[-1] + y.n <= 250 then [] else [{{'body': cur[-1], 'kind': typ, 'n': ns[-1]}}] end)
    else [] end
  from fold f join y on y.doc_id = f.doc_id and y.i = f.i + 1),
 last as (select doc_id, max(i) as i from fold group by 1),
 every as (select doc_id, i, em from fold union all select f.doc_id, f.i + 1, [{{'body': array_to_string(cur, ' '), 'kind': typ, 'n': list_sum(ns)::int}}] from fold f join last l on l.doc_id = f.doc_id and l.i = f.i where len(cur) > 0),
 c as (select doc_id, i, unnest(em) as c, unnest(range(len(em))) as k from every), o as (select doc_id, row_number() over (partition by doc_id order by i, k) - 1 as idx, c from c)
 select doc_id, idx, sha256(doc_id || '|' || idx || '|' || c.body) as chunk_id, c.kind as chunk_type, c.n as token_count, idx > 0 as overlap, c.body as text from o""",
    "pricing_summary": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2",
    "revenue_by_nation": "select n_name, round(sum(o_totalprice), 2) as total, count(*) as orders from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1",
    "orders_without_items": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)",
}
