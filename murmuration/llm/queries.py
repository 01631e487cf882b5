"""One query per operator of this folder, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from murmuration.llm.collocations import collocations
from murmuration.llm.common import table
from murmuration.llm.decontaminate import find_passages, report
from murmuration.llm.lexical_search import search
from murmuration.llm.line_dedup import dedup_lines
from murmuration.llm.lm_scoring import score_texts
from murmuration.llm.mixing import mix
from murmuration.llm.multi_index import nearest
from murmuration.llm.pii import find_pii, fit_finder
from murmuration.llm.quality import fit_quality, score_quality
from murmuration.llm.simhash import as_hex, near_duplicates
from murmuration.llm.suffix_dedup import remove_repeats
from murmuration.llm.token_output import token_output
from murmuration.llm.toxicity import fit_toxicity, score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return token_output(table(spark, folder, "documents"))


def op2_simhash_gray(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", as_hex().alias("fingerprint"), "component_id")


def op3_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_lines(table(spark, folder, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return report(find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return find_pii(docs, fit_finder(docs))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = remove_repeats(table(spark, folder, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs).select(
        "doc_id",
        "source",
        "lang",
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"),
        F.col("_deviation").alias("deviation"),
        F.col("_sampled").alias("sampled"),
    )


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op13_ppm(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))


#: What a key keeps of a line: no ASCII white space at the ends, A-Z in lower case.
_LINE_KEY = (
    "translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
SQL_LINES = f"""
with parts as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i
    from documents
), keyed as (select *, {_LINE_KEY} as key from parts),
often as (
    select key, max(doc_id) as last from keyed where length(key) >= 20
    group by key having count(distinct doc_id) >= 3
), marked as (
    select k.doc_id, k.line, k.i, o.key is not null and k.doc_id < o.last as gone
    from keyed k left join often o on k.key = o.key
)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""


#: Letters A-Z as a-z, others as they are.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_SEARCH = f"""
with texts as (
    select row_number() over () as r, doc_id,
           regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents
), docs as (
    select r, doc_id, len(terms) as n from texts where len(terms) > 0
), total as (
    select count(*) as docs, sum(n)::bigint as terms from docs
), counts as (
    select r, term, count(*) as tf
    from (select r, {_LOWER.format("unnest(terms)")} as term from texts) group by r, term
), weights as (
    select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
    from counts, total group by term
), items as (
    select item_id, {_LOWER.format("unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))")} as term
    from benchmark
), asked as (
    select item_id, term, count(*) as times from items group by item_id, term
), scores as (
    select item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * t.docs) // t.terms))))::bigint as score
    from asked join weights using (term) join counts using (term) join docs using (r), total t
    group by item_id, r
), ranked as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
    from scores join docs using (r) where score > 0
)
select * from ranked where rank <= 10
"""

_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL_PASSAGES = f"""
with docs as (
    select row_number() over () as r, doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from documents
), items as (
    select item_id, w, least(10, len(w)) as size
    from (select item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} as w from benchmark) where len(w) > 0
), windows as (
    select item_id, size, array_to_string(w[k:k + size - 1], ' ') as words
    from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as k from items)
), places as (
    select r, size, k, array_to_string(w[k:k + size - 1], ' ') as words
    from (select r, w, size, unnest(range(1, len(w) - size + 2)) as k
          from docs, (select distinct size from items) where len(w) >= size)
), hits as (
    select distinct r, k, size, item_id from places join windows using (size, words)
), covered as (
    select r, count(distinct place) as n from (select r, unnest(range(k, k + size)) as place from hits) group by r
), found as (
    select r, count(*) as n, string_agg(id, ',' order by id) as ids
    from (select distinct r, cast(item_id as varchar) as id from hits) group by r
)
select doc_id, len(w) as n_words, coalesce(c.n, 0) as n_hit, coalesce(f.n, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from docs left join covered c using (r) left join found f using (r)
"""

SQL_COLLOCATIONS = f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), lists as (
    select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), grams as (
    select lang, 1 as words, unnest(w) as phrase from lists
    union all
    select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from lists
    union all
    select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from lists
), counts as (
    select lang, words, phrase, count(*) as f from grams group by lang, words, phrase
), totals as (
    select lang, sum(f)::bigint as n from counts where words = 1 group by lang
), candidates as (
    select lang, words, phrase, f as a, string_split(phrase, ' ') as w from counts where words > 1 and f >= 10
), cuts as (
    select lang, words, phrase, a, 1 as k, w[1] as lhs, array_to_string(w[2:], ' ') as rhs from candidates
    union all
    select lang, words, phrase, a, 2, array_to_string(w[:2], ' '), w[3] from candidates where words = 3
), scored as (
    select c.lang, c.phrase, c.a, x.f as l, y.f as r, k,
           ((1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f))::bigint as score
    from cuts c join counts x on x.lang = c.lang and x.phrase = c.lhs
                join counts y on y.lang = c.lang and y.phrase = c.rhs
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
    select lang, array_to_string(w[1:2], ' ') as phrase, a from candidates where words = 3
    union all
    select lang, array_to_string(w[2:3], ' '), a from candidates where words = 3
), longer as (
    select lang, phrase, max(a) as most from inside group by lang, phrase
), kept as (
    select w.* from weakest w left join longer o on o.lang = w.lang and o.phrase = w.phrase
    where o.most is null or 100 * o.most < 50 * w.a
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""


QUERIES: dict[str, Query] = {
    "op1_token_output": op1_token_output,
    "op2_simhash_gray": op2_simhash_gray,
    "op3_multi_index": op3_multi_index,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii": op8_pii,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_lexical_search": op11_lexical_search,
    "op12_collocations": op12_collocations,
    "op13_ppm": op13_ppm,
}

ORACLE: dict[str, str] = {
    "op4_line_dedup": SQL_LINES,
    "op7_decontaminate": SQL_PASSAGES,
    "op11_lexical_search": SQL_SEARCH,
    "op12_collocations": SQL_COLLOCATIONS,
}
