"""The registered queries of the corpus operators, one opN_ each, with the SQL that restates them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import compression, decontaminate, language_id, licenses, line_templates, mixing, quality, simhash, substrings, token_ledger
from tidewright.llm.common import Workspace, crc_bucket, documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir), {"doc_id": F.col("doc_id")})


def op2_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(documents(spark, sf_dir), {"doc_id": F.col("doc_id")})


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), {"doc_id": F.col("doc_id")})


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = quality.train(docs, labels.filter(~held_out))
    return quality.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(documents(spark, sf_dir), {"doc_id": F.col("doc_id")}).drop("kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, through two batches of inserts, a replay, a deletion, a revision and the deleted rows' return."""
    docs = documents(spark, sf_dir)
    ledger = token_ledger.TokenLedger(spark, Workspace(spark, "ledger").path, {"byte_bpe_50k": token_ledger.byte_bpe()})
    even, odd = (docs.filter(crc_bucket(F.col("doc_id"), 2) == k) for k in (0, 1))
    some, others = (docs.filter(crc_bucket(F.col("doc_id"), 64) == k) for k in (2, 3))
    ledger.apply("1-insert", token_ledger.as_changes(even, token_ledger.INSERT))
    ledger.apply("2-insert", token_ledger.as_changes(odd, token_ledger.INSERT))
    ledger.apply("1-insert", token_ledger.as_changes(even, token_ledger.INSERT))
    ledger.apply("3-delete", token_ledger.as_changes(some, token_ledger.DELETE))
    ledger.apply("4-revise", token_ledger.as_changes(others, token_ledger.REVISE))
    ledger.apply("5-insert", token_ledger.as_changes(some, token_ledger.INSERT))
    return ledger.totals()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items, {"doc_id": F.col("doc_id")})


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_templates.deduplicated(documents(spark, sf_dir), {"doc_id": F.col("doc_id")})
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_bucket(F.col("doc_id"), 4) == 2
    profiles = language_id.train(docs.filter(~held_out), "text", "lang")
    return language_id.identify(docs, "text", profiles, {"doc_id": F.col("doc_id"), "held_out": held_out})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_compression": op2_compression,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_substrings": op5_substrings,
    "op6_simhash": op6_simhash,
    "op7_token_ledger": op7_token_ledger,
    "op8_decontaminate": op8_decontaminate,
    "op9_line_templates": op9_line_templates,
    "op10_language_id": op10_language_id,
}

#: Terms of a text t, A-Z lower-cased, as DuckDB has it.
_TERMS = r"regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TEMPLATES = ", ".join(f"({i}, '{label}', {licenses.terms(text)}, {licenses.terms(required)})" for i, (label, text, required) in enumerate(licenses.TEMPLATES))

ORACLE_SQL: dict[str, str] = {
    "op3_licenses": f"""
        with t as (select i, label, list_distinct(words) as words, required, case when len(words) <= 8 then 16 else 64 end as length from (values {_TEMPLATES}) v(i, label, words, required)),
        d as (select doc_id, {_TERMS.replace("t,", "text,")} as w from documents),
        b as (select doc_id, length, w[nth * (length // 2) + 1 : nth * (length // 2) + length] as block
              from (select doc_id, w, length, unnest(range(0, greatest(1, (len(w) - length // 2 - 1) // (length // 2) + 1))) as nth from d, (values (16), (64)) l(length))),
        hits as (select distinct doc_id, block, i, label, words, len(list_intersect(words, block)) / len(words) as share from b join t using (length)
                 where len(list_intersect(words, block)) >= ceil(len(words) * cast(0.8 as double) - 1e-9) and list_has_all(block, required)),
        named as (select doc_id, label, share from hits h where not exists
                  (select 1 from hits o where o.doc_id = h.doc_id and o.block = h.block and len(o.words) > len(h.words) and list_has_all(o.words, h.words))),
        base as (select doc_id, p - 1 as p, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d) x,
                 (values (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) y(phrase, label)
                 where w[p : p + len(phrase) - 1] = phrase),
        places as (select doc_id, count(*) as n, min(p) as first_word, max(p) as last_word, string_agg(distinct label, ',' order by label) as labels from base group by doc_id),
        every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base union all select doc_id, label from named) group by doc_id),
        best as (select doc_id, max(share) as score from named group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_base, first_word, last_word, coalesce(places.labels, '') as base_labels,
               coalesce(every.labels, '') as labels, case when n > 0 then cast(1.0 as double) else coalesce(score, 0.0) end as score
        from d left join places using (doc_id) left join every using (doc_id) left join best using (doc_id)
    """,
    "op1_mixing": r"""
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
        s as (select source, sum(size) as source_size from d group by source),
        r as (select *, 2 * source_size as most, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight, row_number() over (order by source nulls last) as nth from s),
        l as (select *, (sum(source_size) over () * cast(1.5 as double) - coalesce(sum(most) over (order by most / weight, nth rows between unbounded preceding and 1 preceding), 0))
                / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, nth rows between unbounded preceding and 1 preceding), 0)) as level from r),
        f as (select *, (select arg_min(level, most / weight) from l where most / weight > level) as final from l),
        t as (select source, cast(source_size as bigint) as source_size, least(cast(most as double), coalesce(final * weight, cast(most as double))) as target from f),
        p as (select d.*, t.source_size, t.target, sum(size) over (partition by d.source order by md5('mix-1' || cast(doc_id as varchar)), doc_id, size rows between unbounded preceding and current row) - size as before
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else
               (cast(floor(target) as bigint) // source_size) * size + least(size, greatest(0, cast(floor(target) as bigint) % source_size - before)) end as bigint) as taken
        from p
    """,
    "op5_substrings": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        win as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
        since as (select s, min(doc_id) as first from win group by s having min(doc_id) < max(doc_id)),
        gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from win join since using (s) where doc_id > first),
        each as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
        kept as (select each.doc_id, count(gone.p) as n_removed, string_agg(case when gone.p is null then word end, ' ' order by each.p) as kept
                 from each left join gone on each.doc_id = gone.doc_id and each.p = gone.p group by each.doc_id)
        select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (doc_id)
    """,
    "op9_line_templates": r"""
        with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
        m as (select *, list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as w from l),
        e as (select distinct doc_id, w from m where len(w) > 0),
        c as (select w, len(w) as size, w[1:3] as lead, count(*) as n, min(doc_id) as first from e group by w),
        leaves as (select size, lead, sum(n) as weight from c where size >= 3 group by size, lead having sum(n) >= 5 and count(*) > 1),
        p as (select w, size, lead, weight, n, unnest(w) as token, generate_subscripts(w, 1) as pos from c join leaves using (size, lead)),
        f as (select size, lead, pos, token from p where token <> '<*>' group by size, lead, pos, token, weight having sum(n) >= 5 and sum(n) * 50 >= weight),
        s as (select w, size, list(struct_pack(pos := pos, token := token) order by pos) as fixed from p join f using (size, lead, pos, token) group by w, size),
        masks as (select w, size, fixed, unnest(list_concat([0], list_filter(list_transform(fixed, lambda x: x.pos), lambda x: x > 3))) as masked from s),
        shapes as (select w, size, list_filter(fixed, lambda x: x.pos <> masked) as shape from masks),
        g as (select size, shape, min(doc_id) as first from shapes join e using (w) where len(shape) >= ceil(size * cast(0.6 as double) - 1e-9) group by size, shape having count(distinct doc_id) >= 5),
        gone as (select w, min(first) as first from (select w, first from c where n >= 5 union all select w, g.first from shapes join g using (size, shape)) group by w),
        kept as (select m.doc_id, count(*) as n_lines, count(gone.w) as n_dropped, string_agg(case when gone.w is null then line end, chr(10) order by i) as kept
                 from m left join gone on m.w = gone.w and m.doc_id > gone.first group by m.doc_id)
        select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from documents left join kept using (doc_id)
    """,
    "op8_decontaminate": f"""
        with d as (select doc_id, {_TERMS.replace("t,", "text,")} as w from documents),
        b as (select item_id, {_TERMS.replace("t,", "text,")} as w from benchmark),
        bw as (select item_id, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i, w from b where len(w) > 0),
        win as (select distinct item_id, n, array_to_string(w[i : i + n - 1], ' ') as s from bw),
        lengths as (select distinct n from win),
        dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w from d, lengths where len(w) >= n),
        occ as (select doc_id, item_id, i, win.n from (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s from dw) x join win on x.n = win.n and x.s = win.s),
        hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from occ) group by doc_id),
        named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct doc_id, cast(item_id as varchar) as item from occ where item_id is not null) group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join named using (doc_id)
    """,
}
