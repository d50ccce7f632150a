"""The training-data queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeweave.llm import ann, bpe, chat, exact_dedup, lang_id, mixing, secrets, simhash, suffix_dedup, warc
from codeweave.llm.common import read_table

def vocabulary(path: str | None = None) -> str:
    """Content of a vocabulary file; the files are never part of this repository."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), vocabulary())


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.windows(chat.probe_conversation(read_table(spark, sf_dir, "conversations"))))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(read_table(spark, sf_dir, "pages")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_table(spark, sf_dir, "documents"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_ann": op2_ann,
    "op3_mixing": op3_mixing,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat": op5_chat,
    "op6_simhash": op6_simhash,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_secrets": op9_secrets,
    "op10_lang_id": op10_lang_id,
}

ORACLE_SQL: dict[str, str] = {
    "op4_suffix_dedup": """
        with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x, octet_length(encode(coalesce(text, ''))) as n from documents),
        w as (select r, i, md5_number(substr(x, 2 * i + 1, 400)) as h from (select r, x, unnest(generate_series(0::bigint, n::bigint - 200)) as i from d where n >= 200)),
        k as (select h from w group by h having count(*) > 1),
        s as (select r, i, coalesce(i > lag(i) over (partition by r order by i) + 200, true) as fresh from w join k using (h)),
        g as (select r, i, sum(fresh::integer) over (partition by r order by i) as run from s),
        runs as (select r, run, min(i) as a, max(i) + 200 as b from g group by r, run),
        pieces as (select runs.r, run, a, b, substr(x, 2 * coalesce(lag(b) over (partition by runs.r order by a), 0) + 1, 2 * (a - coalesce(lag(b) over (partition by runs.r order by a), 0))) as kept from runs join d on d.r = runs.r),
        t as (select r, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans, max(b) as last, string_agg(kept, '' order by a) as kept from pieces group by r)
        select doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) as kept_sha256
        from d left join t using (r)""",
    "op5_chat": f"""
        with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        t as (select *, ceil(chars / 4.0) as tokens, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from (select *,
              4 + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\]|]', '', 'g')) + 3 + length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g')) + 4 as chars from c)),
        s as (select *, min(case when role = 'system' then place end) over (partition by conv_id) as system_place from t),
        h as (select *, coalesce(place = system_place, false) as is_system, {chat.BUDGET} - coalesce(max(case when place = system_place then tokens end) over (partition by conv_id), 0) as room,
              coalesce(max(case when place = system_place then chars end) over (partition by conv_id), 0) as system_chars from s),
        k as (select *, greatest(floor(room / 2), 1) as half, case when is_system then 0 else tokens end as own from h),
        p as (select *, floor(coalesce(sum(own) over (partition by conv_id order by place rows between unbounded preceding and 1 preceding), 0) / half) as cell, own > half as large,
              sum((own > half)::integer) over (partition by conv_id order by place) as larges from k),
        f as (select *, place = 1 or cell is distinct from lag(cell) over w or large is distinct from lag(large) over w or larges is distinct from lag(larges) over w as starts
              from p window w as (partition by conv_id order by place)),
        w as (select *, sum(starts::integer) over (partition by conv_id order by place) as win from f),
        l as (select *, room - sum(own) over (partition by conv_id, win) as rest, lag(own, 1) over v as own1, lag(own, 2) over v as own2,
              case when lag(is_system, 1) over v then 0 else lag(chars, 1) over v end as chars1, case when lag(is_system, 2) over v then 0 else lag(chars, 2) over v end as chars2
              from w window v as (partition by conv_id order by place)),
        x as (select *, chars + case when starts then coalesce(case when place > system_place then system_chars end, 0) + coalesce(case when own1 <= rest then chars1 end, 0)
              + coalesce(case when own1 <= rest and own1 + own2 <= rest then chars2 end, 0) else 0 end as all_chars from l)
        select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
          sum(all_chars)::bigint as formatted_chars, max(win)::bigint as n_windows
        from x group by conv_id""",
    "op8_exact_dedup": """
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
                   from documents),
             g as (select x, max(doc_id) as keep_id, count(*)::bigint as group_size from t group by x)
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.x) as text_sha256,
               octet_length(encode(t.x))::bigint as n_bytes
        from t join g using (x)""",
    "op9_secrets": r"""
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
        k(kind, place, pattern, least_value, least) as (values
          ('assign', 0, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8, 0),
          ('access', 1, '(AKIA[A-Z0-9]+)', 0, 16), ('hex', 2, '([0-9a-f]+)', 0, 32),
          ('github', 3, 'gh[pousr]_([A-Za-z0-9]+)', 36, 0), ('pem', 4, '-----BEGIN\x20([A-Z\x20]*PRIVATE\x20KEY-----)', 0, 0)),
        l as (select r, kind, place, least_value, least, regexp_extract_all(x, pattern, 0) as wholes, regexp_extract_all(x, pattern, 1) as vals, regexp_split_to_array(x, pattern) as gaps from d, k),
        m as (select r, kind, place, least_value, least, unnest(range(len(wholes))) as i, unnest(wholes) as w, unnest(vals) as v, unnest(gaps[:len(wholes)]) as gap from l),
        p as (select *, sum(length(gap) + length(w)) over (partition by r, place order by i) as b from m),
        s as (select r, place, (b - length(w))::bigint as a, kind || ':' || (b - length(w))::bigint || ':' || b::bigint as said from p where length(v) >= least_value and length(w) >= least),
        g as (select r, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
              string_agg(said, ',' order by a, place) filter (place < 3) as base, string_agg(said, ',' order by a, place) as spans from s group by r)
        select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
        from d left join g using (r)""",
}
