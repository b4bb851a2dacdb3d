"""The ``opN_<name>`` queries over the standard tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import bounded, fold, table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.maxent_lm import model, score

    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 5) == 1).alias("held_out"), "text")
    return score(docs, *model(docs.where(~F.col("held_out"))))


#: Most labelled rows of each value of a label that a classifier learns from, about.
MAX_LABELLED = 20_000


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Texts of the rows that a classifier may learn ``label`` from.

    At most about MAX_LABELLED of the labels of each value, so they are small enough to broadcast
    whatever the number of documents.
    """
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0).select("doc_id", label).where(F.col(label).isNotNull())
    labels = bounded(labels, label, MAX_LABELLED)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(labels), "doc_id").select("doc_id", "text", label)


def op2_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.zstd_quality import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(docs, train(_labelled(spark, sf_dir, "quality"), "quality"), threshold=0.3)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.toxicity import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return score(docs, train(_labelled(spark, sf_dir, "toxic"), "toxic"), threshold=0.5).withColumn("n_offending", F.size("offending")).drop("offending")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.language_id import identify, profiles

    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    learned = profiles(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), learned)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.license_scan import scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs).select("doc_id", "licenses")
    place = F.transform("licenses", lambda x: F.concat(x["name"], F.lit("@"), x["word"].cast("string"), F.lit(":"), F.round(x["percent"]).cast("int").cast("string")))
    names = F.array_distinct(F.transform("licenses", lambda x: F.substring_index(x["name"], "#", 1)))
    return found.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.array_join(place, ",").alias("places"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.decontaminate import contaminated, scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillstat.llm.byte_bpe import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest=True)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.common import cut
    from quillstat.llm.quality_rules import COUNTS, counts, fit, judge

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counted = cut(counts(docs).drop("text"))
    return judge(counted, fit(counted)).select("doc_id", *COUNTS, "base_failed", "kept", "distance2")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=5, percent=75)


#: Of the surrogates; a deployment sets its own secret.
PII_KEY = "quillstat"


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.pii import replace

    return replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.divergence_audit import divergence

    return divergence(table(spark, sf_dir, "documents"), min_docs=3, top=200)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.filter_audit import audit, failing, measure, rules

    rows = measure(table(spark, sf_dir, "documents"))
    return audit(failing(rows, table(spark, sf_dir, "labels"), rules()), "".join(rules()))


def op13_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillstat.llm.embedding_links import link

    return link(table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES = {f.__name__: f for f in (op1_maxent_lm, op2_zstd_quality, op3_jaccard_join, op7_toxicity, op4_language_id, op8_decontaminate, op5_pii_surrogates, op6_license_scan, op9_byte_bpe, op10_quality_rules, op11_divergence_audit, op12_filter_audit, op13_embedding_links)}

SQL: dict[str, str] = {
    "op3_jaccard_join": r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), s as (
  select distinct r, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') as t
  from (select r, w, unnest(range(1, greatest(len(w) - 3, 2)::bigint)) as i from d where len(w) > 0)
), n as (
  select r, count(*) as n from s group by r
), p as (
  select a.r as x, b.r as y, count(*) as o from s a join s b using (t) where a.r < b.r group by all
), l as (
  select x, y from p join n a on a.r = x join n b on b.r = y where 100 * o >= 75 * (a.n + b.n - o)
), e as (
  select x, y from l union all select y, x from l
), c as (
  select r, r as m from n union select c.r, e.y from c join e on e.x = c.m
), least_id as (
  select c.r, min(o.doc_id) as component_id from c join d o on o.r = c.m group by c.r
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id from d left join n using (r) left join least_id using (r)
""",
    "op8_decontaminate": r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), bw as (
  select distinct item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select item, w, size, unnest(range(1, (len(w) - size + 2)::bigint)) as i from (select item, w, least(13, len(w)) as size from b where len(w) > 0))
), dw as (
  select r, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win
  from (select r, w, size, unnest(range(1, (len(w) - size + 2)::bigint)) as i from d, (select distinct size from bw) where len(w) >= size)
), h as (
  select dw.r, dw.i, dw.size, bw.item from dw join bw using (size, win)
), hit as (
  select r, count(*) as n_hit from (select distinct r, unnest(range(i, i + size)) as p from h) group by r
), it as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from h) group by r
)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (r) left join it using (r)
""",
    "op11_divergence_audit": r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), g as (
  select distinct lang, source from d
), u as (
  select r, lang, source, unnest(w) as term from d
), k as (
  select lang, term, count(*)::hugeint as n from u group by all having count(distinct r) >= 3
), c as (
  select lang, source, term, count(*)::hugeint as n from u join k using (lang, term) group by all
), l as (
  select lang, count(*)::hugeint as v, sum(n)::hugeint as total from k group by lang
), s as (
  select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as total from g left join c using (lang, source) group by all
), p as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (s.total + l.v) as p, 1 + (1000000000 * (k.n + 1)) // (l.total + l.v) as q
  from s join l using (lang) join k using (lang) left join c using (lang, source, term)
), f as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q
)
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
""",
    "op12_filter_audit": r"""
with recursive d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id
), least as (
  select t, min(doc_id) as m from d group by t
), f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
    || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) then 'C' else '' end
    || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end || case when d.doc_id > m then 'E' else '' end as fails
  from d join least using (t) left join l using (doc_id)
), g as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all
), p as (
  select '' as o, 'ABCDE' as rest
  union all
  select o || substr(rest, i::bigint, 1), substr(rest, 1, (i - 1)::bigint) || substr(rest, (i + 1)::bigint) from p, range(1, 6) r(i) where i <= length(rest)
), s as (
  select o as filter_order, i::int as step, substr(o, i, 1) as x, substr(o, 1, i - 1) as before from p, range(1, 6) r(i) where rest = ''
), e as (
  select part, filter_order, step, x, translate(before, fails, '') = before as alive, contains(fails, x) as own, fails = x as alone, n, good, toxic from g, s
), a as (
  select part, filter_order, step, x, coalesce(sum(n) filter (alive and not own), 0)::bigint as kept, coalesce(sum(n) filter (alive and own), 0)::bigint as removed,
    coalesce(sum(n) filter (own and not alive), 0)::bigint as redundant, coalesce(sum(n) filter (alone), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (alive and own), 0)::bigint as good_lost, coalesce(sum(toxic) filter (alive and own), 0)::bigint as toxic_lost
  from e group by all
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley from a
""",
}
