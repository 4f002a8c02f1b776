"""The registered queries of this subpackage: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, embedding_dedup, exact_dedup, html_text, language_id, line_dedup, merkle, mixing, simhash, token_counts, token_files, url_filter
from .shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return token_files.token_digests(spark, path)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(_table(spark, sf_dir, "embeddings"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of this run's own: every count is made from this run's texts.
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), new_path(spark, "token-counts"))


#: The rules that the registered query applies: host, path, verdict.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(rule) for rule in URL_RULES)
    rules = spark.sql(f"select * from values {values} as rules(host, path, verdict)")
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = language_id.prototypes(docs.where(~held_out()))
    return language_id.predict(docs, known, [F.col("doc_id"), held_out().alias("held_out")])


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def manifest_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def line_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_orc": token_orc,
    "op2_byte_bpe": bpe_round_trip,
    "op3_embedding_dedup": embedding_links,
    "op4_source_mix": source_mix,
    "op5_html_text": page_text,
    "op6_token_counts": token_count,
    "op7_url_filter": url_rules,
    "op8_language_id": language,
    "op9_exact_dedup": exact_copies,
    "op10_simhash": simhash_groups,
    "op11_source_divergence": source_divergence,
    "op12_merkle_manifest": manifest_proofs,
    "op13_line_dedup": line_copies,
}

_SPACE = r"[\x20\x09-\x0D]"
_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"

_LEAF = "sha256({})".format(" || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in ("doc_id", "source", "lang", "n_chars", "{text}")))
_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op7_url_filter": f"""
        with rules(rh, rp, verdict) as (values {", ".join(str(r) for r in URL_RULES)}),
        parts as (select page_id, row_number() over () as row, {_HOST} as host, {_PATH} as path from pages),
        hits as (
            select row, rh || rp as rule, verdict, row_number() over (partition by row order by length(rh || rp) desc, verdict = 'block' desc, rh || rp) as k
            from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)
        )
        select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join hits on hits.row = parts.row and k = 1
    """,
    "op9_exact_dedup": f"""
        with rows as (select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g') as norm from documents),
        found as (
            select doc_id, norm, first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id, count(*) over (partition by norm) as group_size from rows
        )
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256 from found
    """,
    "op11_source_divergence": f"""
        with rows as (select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        words as (select row, lang, source, unnest(regexp_extract_all(translate(text, {_A_Z}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from rows),
        kept as (select lang, term from words group by lang, term having count(distinct row) >= 30),
        sizes as (select lang, count(*) as v from kept group by lang),
        groups as (select distinct lang, source from rows),
        counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all),
        every as (select lang, source, term, coalesce(n, 0)::hugeint as n from groups join kept using (lang) left join counts using (lang, source, term)),
        shares as (select *, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from every join sizes using (lang)),
        totals as (select lang, term, sum(n) as n from every group by all),
        whole as (select lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from totals join sizes using (lang)),
        distances as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
        pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join distances d on d.lang = a.lang and d.source = a.source and d.item = b.source),
        terms as (select lang, source, 'term' as part, term as item, p - q as value from shares join whole using (lang, term) where shares.n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (from pairs union all from terms))
        select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
    """,
    "op12_merkle_manifest": f"""
        with recursive
        crc(doc_id, rest, c) as (
            select distinct doc_id, doc_id::varchar, 4294967295::bigint from documents
            union all
            select doc_id, substr(rest, 2), list_reduce(list_concat([xor(c, ascii(rest)::bigint)], range(8)), lambda a, b: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) from crc where rest <> ''
        ),
        touched as (select doc_id, xor(c, 4294967295) % 2 = 0 as touched from crc where rest = ''),
        base as (
            select coalesce('=' || source, '') as tree, doc_id, row_number() over (partition by source order by doc_id) - 1 as i, count(*) over (partition by source) as n, {_LEAF.format(text="text")} as leaf,
                case when touched then {_LEAF.format(text="replace(text, chr(10), '')")} else {_LEAF.format(text="text")} end as seen
            from documents join touched using (doc_id)
        ),
        nodes(tree, level, i, n, h) as (
            select tree, 0, i, n, leaf from base
            union all
            select tree, level + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by tree, level, i // 3
        ),
        subroots as (select tree, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
        tops(level, i, n, h) as (
            select 0, i, n, subroot from subroots
            union all
            select level + 1, i // 3, (min(n) + 2) // 3, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 3
        ),
        runs as (select tree, level, i // 3 as run, list(h order by i) as hs from nodes where n > 1 group by all),
        top_runs as (select level, i // 3 as run, list(h order by i) as hs from tops where n > 1 group by all),
        climb(doc_id, tree, level, i, n, h, proof) as (
            select doc_id, tree, 0, i, n, seen, '' from base
            union all
            select c.doc_id, c.tree, c.level + 1, c.i // 3, (c.n + 2) // 3, sha256(array_to_string(list_concat(list_concat(hs[:c.i % 3], [c.h]), hs[c.i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:c.i % 3], hs[c.i % 3 + 2:]), '')
            from climb c join runs r on r.tree = c.tree and r.level = c.level and r.run = c.i // 3 where c.n > 1
        ),
        climb_top(doc_id, level, i, n, h, proof) as (
            select doc_id, 0, s.i, s.n, h, proof from climb c join subroots s using (tree) where c.n = 1
            union all
            select c.doc_id, c.level + 1, c.i // 3, (c.n + 2) // 3, sha256(array_to_string(list_concat(list_concat(hs[:c.i % 3], [c.h]), hs[c.i % 3 + 2:]), '')), proof || array_to_string(list_concat(hs[:c.i % 3], hs[c.i % 3 + 2:]), '')
            from climb_top c join top_runs r on r.level = c.level and r.run = c.i // 3 where c.n > 1
        )
        select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
        from climb_top c join base using (doc_id) join subroots s using (tree) cross join (select h as root from tops where n = 1) where c.n = 1
    """,
    "op13_line_dedup": f"""
        with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
        rows as (select doc_id, unnest(lines) as line, unnest(range(len(lines))) as place from cut),
        keyed as (select *, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), {_A_Z}) as key from rows),
        owners as (select key, min(doc_id) as owner from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
        found as (select keyed.*, owner is not null and owner <> doc_id as gone from keyed left join owners using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
        from found group by doc_id
    """,
}
