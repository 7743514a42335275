"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import collocations, decontam, licenses, line_dedup, lm_score, packing, pieces, quality, repair, sharding, simhash, substring_dedup, token_files
from lectern.session import scratch_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches of every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rules and the likelihood-ratio verdict on every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 400 bytes that stand twice, and the words of each in passages of over 50 words that another has too."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut inside a character leaves U+FFFD here; kept_sha256 is of the bytes
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"), "n_passage_words")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-id files of all documents, written and read back."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", token_files.ids_crc32("ids").alias("ids_crc32"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document."""
    return lm_score.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document, decoded again."""
    import public_tokenizers

    return pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the later copies of repeated runs of lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_sharding": op7_sharding,
    "op8_lm_score": op8_lm_score,
    "op9_pieces": op9_pieces,
    "op10_line_dedup": op10_line_dedup,
    "op11_repair": op11_repair,
    "op12_packing": op12_packing,
    "op13_collocations": op13_collocations,
}

_TEMPLATE_VALUES = ", ".join(f"({k}, '{label}', ['" + "', '".join(sorted(set(text.split()))) + "'])" for k, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASE_VALUES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE = {
    "op2_license_scan": f"""
with t(template, label, tw) as (values {_TEMPLATE_VALUES}),
p(phrase, n, label) as (values {_PHRASE_VALUES}),
d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
hits as (
  select doc_id, i - 1 as pos, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) x, p
  where array_to_string(w[i:i + p.n - 1], ' ') = p.phrase and i + p.n - 1 <= len(w)),
base as (select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, list_sort(list_distinct(list(label))) as base from hits group by doc_id),
blocks as (
  select doc_id, list_distinct(regexp_extract_all(line, '{_WORD}')) as bw
  from (select doc_id, unnest(list_distinct(list_concat(string_split({_LOWER}, chr(10)), regexp_split_to_array({_LOWER}, '\\n[ \\t\\r\\f\\x0B]*\\n')))) as line from documents) x),
met as (
  select doc_id, list(distinct label) as met, max(len(list_intersect(tw, bw)) / len(tw)) as best from blocks, t
  where len(list_intersect(tw, bw)) >= case when len(tw) < {licenses.SHORT} then len(tw) else ceil(0.8 * len(tw) - 1e-9) end
    and len(list_intersect(list_intersect(tw, {sorted(licenses.NAMES)}), bw)) = len(list_intersect(tw, {sorted(licenses.NAMES)})) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
  array_to_string(coalesce(base, []), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ',') as labels,
  (case when n_base > 0 then 1.0 else coalesce(best, 0.0) end)::double as score
from d left join base using (doc_id) left join met using (doc_id)""",
    "op5_decontamination": f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
i as (select item_id, w, least(10, len(w)) as l from (select item_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from benchmark) x where len(w) > 0),
wins as (select distinct item_id, l, array_to_string(w[k:k + l - 1], ' ') as phrase from (select *, unnest(range(1, len(w) - l + 2)) as k from i) x),
lengths as (select distinct l from wins),
firsts as (select distinct l, string_split(phrase, ' ')[1] as word from wins),
places as (
  select doc_id, k, l, array_to_string(w[k:k + l - 1], ' ') as phrase
  from (select doc_id, w, unnest(range(1, len(w) + 1)) as k from d) x join firsts on w[k] = word where k + l - 1 <= len(w)),
hit as (select doc_id, item_id, k, places.l from places join wins on places.phrase = wins.phrase and places.l = wins.l),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + l)) as p from hit) x group by doc_id),
items as (select doc_id, list_sort(list(distinct item_id::varchar)) as items from hit group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items,
  sha256(array_to_string(coalesce(items, []), ',')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
    "op10_line_dedup": """
with l as (
  select doc_id, number, line, row_number() over (partition by doc_id order by number) as i,
    sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) over (partition by doc_id order by number) as upto,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as n
  from (select doc_id, unnest(range(len(ls))) as number, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents) x) y
  where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ends as (
  select a.doc_id, a.i as s, min(b.i) as e from l a join l b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 50 group by a.doc_id, a.i
  union
  select b.doc_id, max(a.i) as s, b.i as e from l a join l b on a.doc_id = b.doc_id and b.i >= a.i and b.upto - a.upto + a.n >= 50 group by b.doc_id, b.i),
seq as (select doc_id, list(line order by i) as ls from l group by doc_id),
blocks as (select doc_id, s, e, array_to_string(ls[s:e], chr(10)) as body, e - s as n from ends join seq using (doc_id)),
later as (select doc_id, s, e from (select *, row_number() over (partition by n, body order by doc_id, s) as r from blocks) x where r > 1),
gone as (select distinct doc_id, number from later join l using (doc_id) where l.i between s and e),
rest as (
  select doc_id, string_agg(line, chr(10) order by number) as text
  from (select doc_id, unnest(range(len(ls))) as number, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents) x) y
  where not exists (select 1 from gone g where g.doc_id = y.doc_id and g.number = y.number) group by doc_id)
select d.doc_id, coalesce(rest.text, '') as text, len(string_split(d.text, chr(10)))::bigint as n_lines, coalesce(g.n, 0)::bigint as n_deleted
from documents d left join rest using (doc_id) left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)""",
    "op11_repair": """
with recursive tab as (
  select list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab),
named as (
  select coalesce('=' || conv_id, ' ') as conv, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) as key
  from conversations),
lots as (
  select named.*, xor(list_reduce(list_prepend(4294967295, key), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 as lot from named, tab),
harmed as (
  select conv, turn, case when lot = 4 then 'user' else role end as role, case lot when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from lots, unnest(range(case lot when 0 then 0 when 3 then 2 else 1 end)) copies where lot <> 0),
placed as (select *, row_number() over (partition by conv order by turn nulls first, role, text) as i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from harmed),
t as (
  select conv, i, turn, role, text, left(role, 1) as c, left(lag(role) over w, 1) || left(role, 1) as pair,
    case when body = '' then 'blank' when row_number() over (partition by conv, role, text order by i) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault
  from placed window w as (partition by conv order by i)),
facts as (
  select conv, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from t group by conv),
path as (
  select conv, 0::bigint as i, 'x' as state, 0::bigint as cost, '' as audit, []::varchar[] as said from facts
  union all
  select conv, i, state, best.c, best.a, best.s from (
    select p.conv, p.i + 1 as i,
      case letter when 'D' then p.state when 'K' then t.c else case p.state when 'u' then 'a' else 'u' end end as state,
      min(struct_pack(
        c := p.cost + (case letter when 'D' then 2 when 'R' then 1 else 0 end + case when letter <> 'D' and fault = 'truncated' then 5 else 0 end)::bigint, a := p.audit || letter,
        s := list_concat(p.said, case letter when 'D' then [] when 'K' then [t.role || ':' || t.text] else [case p.state when 'u' then 'assistant:' else 'user:' end || t.text] end))) as best
    from path p join t on t.conv = p.conv and t.i = p.i + 1, (values ('K'), ('R'), ('D')) v(letter)
    where letter = 'D' or fault not in ('blank', 'duplicate') and (letter = 'R' or p.state || t.c in ('xs', 'xu', 'su', 'ua', 'au'))
    group by 1, 2, 3) x),
best as (
  select conv, min(struct_pack(c := cost, a := audit, s := said)) as best from path join facts using (conv) where path.i = n and state in ('x', 'a') group by conv)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.s, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join facts on facts.conv = coalesce('=' || o.conv_id, ' ') left join best on best.conv = facts.conv""",
    "op13_collocations": f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) r(k)) x),
f as (select lang, k, phrase, count(*) as f from g group by lang, k, phrase having count(*) >= 100),
c as (
  select * from f x where k > 1 and not exists (
    select 1 from f y where y.lang = x.lang and y.k > x.k and 100 * y.f >= 100 * x.f and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cuts as (
  select lang, k, phrase, f, i, array_to_string(string_split(phrase, ' ')[1:i], ' ') as head, array_to_string(string_split(phrase, ' ')[i + 1:], ' ') as tail
  from (select *, unnest(range(1, k)) as i from c) x),
scored as (
  select cuts.lang, cuts.phrase, cuts.f as a, l.f as l, r.f as r, t.n, i, (1000::hugeint * cuts.f * t.n) // (l.f::hugeint * r.f) as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = head join f r on r.lang = cuts.lang and r.phrase = tail join t on t.lang = cuts.lang),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best)
select lang, rank, phrase, a, l, r, n, score::bigint as score from ranked where rank <= 2000""",
}
