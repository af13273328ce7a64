"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.llm.common import table
from strataframe.llm.exact_dedup import exact_groups
from strataframe.llm.fill_in_middle import fill_in_middle, restored
from strataframe.llm.html_extract import main_texts
from strataframe.llm.katz import katz_scores
from strataframe.llm.ngram_join import ngram_components
from strataframe.llm.packing import pack
from strataframe.llm.quality_model import quality_scores
from strataframe.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from strataframe.llm.sentence_pieces import round_trips
from strataframe.llm.source_divergence import source_divergence
from strataframe.llm.substring_dedup import substring_dedup
from strataframe.llm.suffix_dedup import suffix_dedup
from strataframe.llm.token_counts import token_counts


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, from STRATAFRAME_TOKENIZERS or the installed package."""
    folder = os.environ.get("STRATAFRAME_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=5, percent=75)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), width=50).drop("kept_text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op5_katz_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), order=2, folds=5, held_out=1)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, held_out=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op9_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("failed_rules", "stop_ratio", "upper_ratio")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), top=200, min_docs=3)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13).drop("kept_text")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), seed="42", rate=50, spm_rate=80)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_katz_lm_scores": op5_katz_lm_scores,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sentencepiece_codec": op9_sentencepiece_codec,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def rules_sql() -> str:
    """The same counts, and the same table of thresholds, in DuckDB's SQL."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    limits = [f"{r.measure} >= {r.low}" for r in RULES if r.low is not None] + [f"{r.measure} <= {r.high}" for r in RULES if r.high is not None]
    return rf"""
        with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        l as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
        g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from d)),
        s as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from g) where n > 1),
        r as (select doc_id, count(distinct i + k) as n from s, range(0, 3) t(k) group by doc_id),
        m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
            len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words, len(ls) as n_lines, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper,
            length(regexp_replace(t, '[^!]', '', 'g')) as n_exclaim, len(list_filter(ws, lambda w: w in ({stop}))) as n_stop from l left join r using (doc_id)),
        q as (select *, word_chars / greatest(n_words, 1) as mean_word_chars, n_symbols / greatest(n_words, 1) as symbol_ratio, n_upper / greatest(word_chars, 1) as upper_ratio,
            n_exclaim / greatest(n_words, 1) as exclaim_ratio, n_stop / greatest(n_words, 1) as stop_ratio, n_dup_lines / greatest(n_lines, 1) as dup_line_ratio,
            n_repeat_words / greatest(n_words, 1) as repeat_ratio, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {" and ".join(limits)} as kept from q"""


ORACLE_SQL: dict[str, str] = {
    "op10_quality_rules": rules_sql(),
    "op8_exact_dedup": """
        with d as (select doc_id, coalesce(text, '') as text from documents),
        g as (select text, max(doc_id) as keep_id, count(*) as group_size from d group by text)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(d.text) as text_sha256
        from d join g on d.text = g.text""",
    "op11_source_divergence": r"""
        with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        w as (select i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        k as (select lang, term, count(*) as n from w group by all having count(distinct i) >= 3),
        g as (select distinct lang, source from d),
        c as (select lang, source, term, count(*) as n from w semi join k using (lang, term) group by all),
        v as (select lang, count(*) as v, sum(n) as total from k group by lang),
        s as (select g.lang, g.source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
        p as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + v.v) as p,
            1 + (1000000000::hugeint * (k.n + 1)) // (v.total + v.v) as whole from s join k using (lang) join v using (lang) left join c using (lang, source, term)),
        f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b using (lang, term) group by all),
        x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
            left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
            union all select lang, source, 'term', term, ((p - whole) * (p - whole) // whole)::bigint from p where n > 0 and p > whole)
        select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from x qualify part = 'pair' or rank <= 200""",
    "op12_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        w as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d)),
        f as (select *, min(doc_id) over (partition by g) as one from w),
        r as (select doc_id, list(distinct i + k) as gone from f, range(0, 13) t(k) where one < doc_id group by doc_id),
        k as (select doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed, gone, ws from d left join r using (doc_id)),
        p as (select doc_id, string_agg(w, ' ' order by i) as kept from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from d) x
            anti join (select doc_id, unnest(gone) as i from r) y using (doc_id, i) group by doc_id)
        select doc_id, n_words, n_removed, sha256(coalesce(kept, '')) as kept_sha256 from k left join p using (doc_id)""",
    "op13_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || doc_id) as h from documents),
        k as (select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as ts, [('0x' || h[8 * k + 1 : 8 * k + 8])::bigint for k in range(0, 4)] as r from d),
        c as (select *, len(ts) as n, least(r[1] % (n + 1), r[2] % (n + 1)) as a, greatest(r[1] % (n + 1), r[2] % (n + 1)) as b,
            case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 50 then 'plain' when r[4] % 100 < 80 then 'spm' else 'psm' end as form from k),
        x as (select *, array_to_string(ts[1 : a], '') as p, array_to_string(ts[a + 1 : b], '') as m, array_to_string(ts[b + 1 : n], '') as s from c)
        select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
            sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256 from x""",
}
