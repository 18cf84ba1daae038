"""Registered queries of the llm operators: name -> builder (spark, sf_dir), and DuckDB text where SQL can state them."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessera.functions.hashing import sql_seeded_order
from tessera.llm import ann, chat, decontaminate, divergence, licenses, line_dedup, lm_score, merkle, mixing, quality, simhash, substring_dedup, warc
from tessera.llm.common import read, scratch

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


@query("op2_simhash_near_dedup")
def op2(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_line_dedup", """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where coalesce(text, '') <> ''),
w as (select doc_id, i, least(3, len(ls)) as n, array_to_string(ls[i + 1:i + 3], chr(10)) as content
      from (select doc_id, ls, unnest(range(0, greatest(len(ls) - 2, 1))) as i from l)),
later as (select doc_id, i, n from w qualify row_number() over (partition by content order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + n)) as i from later),
p as (select doc_id, unnest(range(0, len(ls))) as i, unnest(ls) as line from l),
k as (select p.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
             string_agg(p.line, chr(10) order by p.i) filter (where gone.i is null) as kept
      from p left join gone on p.doc_id = gone.doc_id and p.i = gone.i group by p.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k on d.doc_id = k.doc_id""")
def op1(spark, sf_dir):
    found = line_dedup.line_dedup(read(spark, sf_dir, "documents"), min_lines=3)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_decontaminate", r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, len(w[i:i + 12]) as n, array_to_string(w[i:i + 12], ' ') as content
            from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from windows),
grams as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as content
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hits as (select doc_id, item_id, i, n from grams join windows using (n, content)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words on d.doc_id = words.doc_id left join items on d.doc_id = items.doc_id""")
def op4(spark, sf_dir):
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.graded(read(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_top", "keep")


def _raking_sql() -> str:
    """The raking of op10, one step per common table expression."""
    steps, last = [], "start"
    for s in range(mixing.SWEEPS):
        for d in mixing.DIMENSIONS:
            name = f"r{s}_{d}"
            steps.append(f"{name} as (select * exclude (factor), factor * (target_{d} / sum(tokens * factor) over (partition by {d})) "
                         f"as factor from {last})")
            last = name
    powers = mixing.SMOOTHING
    return rf"""
with d as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang,
  case when contains(text, ' | ') then 'table' when regexp_matches(text, '[#$%&*]{{3}}') then 'signs'
       when contains(lower(text), 'licen') then 'legal' when contains(text, '@') then 'contact' else 'prose' end as topic,
  cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as n_tokens
  from (select doc_id, source, lang, coalesce(text, '') as text from documents)),
cells as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from d group by all),
start as (select *, {", ".join(f"pow(sum(tokens) over (partition by {x}), {powers[x]}) as target_{x}" for x in mixing.DIMENSIONS)},
          1.0::double as factor from cells),
{", ".join(steps)},
p as (select source, lang, topic, round(least(factor / (select max(factor) from {last} where tokens > 0), 1.0), 9) as probability from {last})
select d.doc_id, d.source, d.lang, d.topic, d.n_tokens, p.probability,
       ({sql_seeded_order("'17'", "d.doc_id")} + 0.5) / 4294967296.0 < p.probability as sampled
from d join p using (source, lang, topic)"""


@query("op10_mixing", _raking_sql())
def op10(spark, sf_dir):
    found = mixing.mix(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"),
                        F.col("__topic").alias("topic"), F.col("__tokens").alias("n_tokens"), "probability", "sampled")


@query("op9_substring_dedup", r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, array_to_string(w[i + 1:i + 20], ' ') as path
      from (select doc_id, w, unnest(range(0, len(w) - 19)) as i from d where len(w) >= 20)),
later as (select doc_id, i from s qualify row_number() over (partition by path order by doc_id, i) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from later),
p as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as word from d),
k as (select p.doc_id, count(*) as n_words, count(gone.i) as n_removed,
             string_agg(word, ' ' order by p.i) filter (where gone.i is null) as kept
      from p left join gone on p.doc_id = gone.doc_id and p.i = gone.i group by p.doc_id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k on d.doc_id = k.doc_id""")
def op9(spark, sf_dir):
    found = substring_dedup.substring_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_license_scan")
def op3(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents")).drop("detections")


TRAP = r"\### Assistant: </turn> ok"


@query("op6_chat_format", rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '{TRAP}' union all select -7, 1, 'assistant', '{TRAP}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(15 + length(regexp_replace(role, '([\\<#:\n])', '\\\1', 'g')) + length(regexp_replace(text, '([\\<#])', '\\\1', 'g'))) as bigint)
         as formatted_chars
from t group by conv_id""")
def op6(spark, sf_dir):
    messages = json.dumps({"messages": [{"role": r, "content": TRAP} for r in ("user", "assistant")]})
    table = chat.row_records(read(spark, sf_dir, "conversations"))
    records = table.unionByName(spark.range(1).select(F.lit(-7).cast(table.schema["conv_id"].dataType).alias("conv_id"), F.lit(messages).alias("record")))
    return chat.digests(chat.format_turns(chat.canonical_turns(records)))


@query("op7_warc_revisits", """
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
o as (select *, max(page_id) over (partition by payload_digest) as origin from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> origin then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> origin then origin end as refers_to
from o""")
def op7(spark, sf_dir):
    path = scratch(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_nearest_neighbours")
def op5(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


@query("op13_divergence_audit", r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select i, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as lang_n from t group by all having count(distinct i) >= 3),
langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
n as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
g as (select lang, source, coalesce(sum(n), 0) as total from (select distinct lang, source from d) left join n using (lang, source) group by all),
grid as (select g.lang, g.source, kept.term, coalesce(n.n, 0) as n,
           1 + 1000000000::hugeint * (coalesce(n.n, 0) + 1) // (g.total + v)::hugeint as p,
           1 + 1000000000::hugeint * (lang_n + 1) // (lang_total + v)::hugeint as whole
         from g join kept using (lang) join langs using (lang) left join n on n.lang = g.lang and n.source = g.source and n.term = kept.term),
cells as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
          from grid a join grid b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
          from g a join g b on a.lang = b.lang and a.source <> b.source
          left join cells c on c.lang = a.lang and c.source = a.source and c.item = b.source),
terms as (select lang, source, 'term' as part, term as item, cast((p - whole) * (p - whole) // whole as bigint) as value
          from grid where n > 0 and p > whole),
ranked as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
           from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200""")
def op13(spark, sf_dir):
    return divergence.divergence(read(spark, sf_dir, "documents"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::bigint)), "
            "lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)")


def _merkle_sql(levels: int = 14, top_levels: int = 9) -> str:
    """The manifest of op11, one level of the trees per common table expression."""
    steps = []

    def tree(nodes, walk, count, name):
        """Steps that turn ``nodes`` (grp, pos, n, digest) and ``walk`` (grp, pos, acc, sib, ...) into roots."""
        for k in range(count):
            runs, up, on = f"{name}_runs{k}", f"{name}_nodes{k}", f"{name}_walk{k}"
            steps.append(f"{runs} as materialized (select grp, pos // 3 as pos, n, list(digest order by pos) as ds from {nodes} group by grp, pos // 3, n)")
            steps.append(f"{up} as materialized (select grp, pos, (n + 2) // 3 as n, case when n = 1 then ds[1] else sha256(array_to_string(ds, '')) end as digest from {runs})")
            steps.append(f"""{on} as materialized (select w.* replace (w.pos // 3 as pos,
  case when n = 1 then acc else sha256(array_to_string(list_slice(ds, 1, w.pos % 3), '') || acc || array_to_string(list_slice(ds, w.pos % 3 + 2, 3), '')) end as acc,
  case when n = 1 then sib else sib || array_to_string(list_slice(ds, 1, w.pos % 3), '') || array_to_string(list_slice(ds, w.pos % 3 + 2, 3), '') end as sib)
  from {walk} w join {runs} r on w.grp = r.grp and w.pos // 3 = r.pos)""")
            nodes, walk = up, on
        return nodes, walk

    fields = lambda text: " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in (
        "doc_id::varchar", "source", "lang", "n_chars::varchar", text))
    steps.append(f"""leaves as materialized (select doc_id, coalesce('=' || source, '') as grp, sha256({fields("text")}) as leaf,
  case when {_crc32_sql("cast(doc_id as varchar)")} % 2 = 0 then sha256({fields("replace(text, chr(10), '')")}) else sha256({fields("text")}) end as changed from documents)""")
    steps.append("first as materialized (select *, row_number() over (partition by grp order by doc_id) - 1 as pos, count(*) over (partition by grp) as n, leaf as digest from leaves)")
    steps.append("start as materialized (select doc_id, leaf, grp, pos, changed as acc, '' as sib from first)")
    nodes, walk = tree("first", "start", levels, "s")
    steps.append(f"sub as materialized (select grp as source_grp, '' as grp, row_number() over (order by grp) - 1 as pos, count(*) over () as n, digest from {nodes})")
    steps.append(f"up as materialized (select w.doc_id, w.leaf, sub.digest as subroot, sub.grp, sub.pos, w.acc, w.sib from {walk} w join sub on w.grp = sub.source_grp)")
    nodes, walk = tree("sub", "up", top_levels, "r")
    return "with " + ",\n".join(steps) + f"""
select doc_id, leaf, subroot, digest as root, sha256(sib) as proof_sha256, acc as folded_root, acc = digest as verified
from {walk} w join {nodes} n using (grp)"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = [F.col(c) for c in merkle.FIELDS]
    leaves = docs.select("doc_id", "source", merkle.leaf_digest(fields).alias("leaf"), merkle.leaf_digest([*fields[:-1], tampered]).alias("changed"))
    found = merkle.folded(merkle.manifest(leaves), "changed")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op12_lm_score")
def op12(spark, sf_dir):
    return lm_score.lm_score(read(spark, sf_dir, "documents"))
