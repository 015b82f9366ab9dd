"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casagrid.llm import centroids, collocations, exact_dedup, huffman, line_dedup, mixing, near_dedup, packing, prefix_forest, quality, suffix_levels, toxicity, warc
from casagrid.llm.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


MIN_SITES = 12


@query(
    f"""
    with l as (select doc_id, source, trim(line, ' ') as key, pos
               from (select doc_id, source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
                     from documents where text <> '') where trim(line, ' ') <> ''),
    c as (select key from l group by key having count(distinct coalesce('=' || source, '')) >= {MIN_SITES}),
    f as (select key, min(row(doc_id, pos)) as first from l join c using (key) group by key),
    r as (select doc_id, list(pos) as drop from l join f using (key) where row(doc_id, pos) <> first group by doc_id),
    d as (select d.doc_id, coalesce(text, '') as text, r.drop, string_split(text, chr(10)) as lines from documents d left join r using (doc_id))
    select doc_id, case when text = '' then 0 else len(lines) end::bigint as n_lines, coalesce(len(drop), 0)::bigint as n_removed,
           sha256(case when drop is null then text
                  else array_to_string(list_transform(list_filter(list_zip(lines, range(len(lines))), lambda x: not list_contains(drop, x[2])), lambda x: x[1]), chr(10)) end) as kept_sha256
    from d
    """
)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without lines that stand on twelve sources or more, but for each line's first occurrence."""
    cleaned = line_dedup.dedup_lines(table(spark, folder, "documents"), MIN_SITES)
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def held_out() -> Column:
    """Rows whose labels nothing learns from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


@query()
def op2_huffman_token_file(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of all documents, written as Huffman blocks in order of doc_id and read back."""
    file = huffman.write_token_file(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return file.read().select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query()
def op3_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, folder, "embeddings")
    forest = prefix_forest.build_forest(vectors)
    return forest.search(vectors.filter(F.col("vec_id") % 20 == 0), k=20)


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents by a classifier that has seen the labels of two thirds of the ids."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels").filter(~held_out()))
    scored = toxicity.score(docs.select("doc_id", "lang", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.col("toxic").alias("flagged_in_language"))


@query()
def op5_superminhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of five-word shingles overlap by 85 % or more."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"), percent=85, shingle=5)


@query()
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    packed = packing.pack(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query(
    r"""
    with d as (
        select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
               ('0x' || substr(md5('7:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as key
        from documents),
    s as (select source, sum(size)::bigint as size, count(*) as n from d group by source),
    r as (select *, row_number() over (order by source nulls last) - 1 as place from s),
    w as (select *, case place % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, size * 2.0::double as top from r),
    f as (select *, 1.5::double * sum(size) over () as budget,
                 coalesce(sum(top) over o, 0) as top_before, sum(weight) over () - coalesce(sum(weight) over o, 0) as weight_left
          from w window o as (order by top / weight, place rows between unbounded preceding and 1 preceding)),
    l as (select *, (budget - top_before) / weight_left as level from f),
    c as (select *, first_value(case when level <= top / weight then level end ignore nulls) over (order by top / weight, place rows between unbounded preceding and unbounded following) as common from l),
    t as (select source, size as source_size, coalesce(least(top, common * weight), top) as target from c),
    p as (select d.doc_id, d.size, t.source_size::bigint as source_size, t.target,
                 sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) - d.size as start
          from d join t on d.source is not distinct from t.source),
    e as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from p)
    select doc_id, size, source_size, target,
           (epochs * size + least(greatest(floor(target)::bigint - epochs * source_size - start, 0), size))::bigint as taken
    from e
    """
)
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of 150 % of all words takes of each document, sources weighing 3, 1, 2."""
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, mixing.word_count(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op8_suffix_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without bytes of 200-byte strings that start anywhere else, indexed in three ingests."""
    cut = suffix_levels.remove_repeats(table(spark, folder, "documents"), window=200, batches=3)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    r"""
    with n as (select doc_id, translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') as norm, length(coalesce(text, '')) as chars from documents),
    w as (select *, first_value(doc_id) over (partition by norm order by chars desc, doc_id nulls last) as keep_id, count(*) over (partition by norm) as group_size from n)
    select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256 from w
    """
)
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Two ingests of ``documents``: the rows of one half are history, those of the other are looked up in it."""
    docs = table(spark, folder, "documents")
    return exact_dedup.exact_dedup(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0)


@query()
def op10_hierarchical_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, sources as sites and their languages as paths; learns like op4 from two thirds."""
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels").filter(~held_out()))
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = quality.hierarchical_quality(docs, model, F.col("source"), path)
    return found.withColumn("held_out", held_out())


@query(
    """
    with p as (select page_id, coalesce(html, '') as html from pages),
    h as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex, max(page_id) over (partition by html) as of from p),
    d as (select *, array_to_string(list_transform(range(0, 8), lambda i: list_transform([('0x' || substr(hex, 1 + 5 * i, 5))::int], lambda n: array_to_string(
                 list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1)), ''))[1]), '') as payload_digest from h)
    select page_id, payload_bytes, payload_digest, case when of is null or page_id = of then 'response' else 'revisit' end as record_type,
           case when page_id is distinct from of then of end as refers_to
    from d
    """
)
def op11_warc_zstd(spark: SparkSession, folder: str) -> DataFrame:
    """Pages written to Zstandard archives with one response for each payload, and read back."""
    read = warc.archived(table(spark, folder, "pages"), least=0)
    number = lambda c: F.try_to_number(F.split(c, ":")[2], F.lit("S9999999999999999999")).cast("long")
    return read.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))


def _rounds_sql(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024) -> str:
    """One pair of sub-queries for each round: assignment, then means."""
    nearest = "min(row(list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2])::hugeint * (p[1] - p[2])))::hugeint, c))"
    steps = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v from embeddings
                 where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})""",
        f"c0 as (select (row_number() over (order by sha256('{seed}:' || vec_id), v))::int - 1 as c, v from v where vec_id is not null order by c limit {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select r, any_value(v.v) as v, {nearest} as best from v, c{i} as c group by r)")
        if i < rounds:
            steps.append(
                f"""m{i} as (select c, list(case when s >= 0 then s // n else -((n - 1 - s) // n) end order by d) as v
                    from (select best[2] as c, d, sum(v[d])::hugeint as s, count(*)::hugeint as n from a{i}, range(1, {dims + 1}) t(d) group by 1, 2) group by c)"""
            )
            steps.append(f"c{i + 1} as materialized (select c, coalesce(m.v, c{i}.v) as v from c{i} left join m{i} as m using (c))")
    return f"""
    with {", ".join(steps)}
    select vec_id, best[2]::int as cluster, best[1]::bigint as distance, (sum(best[1]) over (partition by best[2]))::bigint as cluster_inertia,
           (sum(best[1]) over ())::bigint as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
    from a{rounds} join v using (r) join c{rounds} as c on c.c = best[2]
    """


@query(_rounds_sql())
def op12_centroid_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of all vectors of 64 components after ten rounds, with distances, inertia and the centroids' digests."""
    rows, found = centroids.clusters(table(spark, folder, "embeddings"), k=8, rounds=10, seed=3, dims=64, scale=1024)
    rows = stored(rows, "clusters")
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # a row a centroid
    inner = [sums.get(c, 0) for c in range(len(found))] or [0]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found] or [""]
    of = lambda values: centroids.by_cluster(values, F.col("cluster"))
    return rows.select("*", of(inner).cast("long").alias("cluster_inertia"), F.lit(sum(inner)).cast("long").alias("inertia"), of(digests).alias("centroid_sha256"))


PHRASES_A_LANGUAGE = 2000


@query(
    rf"""
    with p as (select row_number() over () as d, coalesce(lang, 'und') as lang,
                      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
    w as materialized (select lang, regexp_extract_all(piece, '[^ 	]+') as w from p),
    n as (select lang, sum(len(w))::bigint as n from w group by lang),
    g as (select lang, o, unnest(list_transform(range(1, len(w) - o + 2), lambda i: w[i:i + o - 1])) as words from w, range(1, 4) t(o) where len(w) >= o),
    f as materialized (select lang, o, words, count(*)::hugeint as a from g group by all having a >= 10),
    c as (select f.lang, words, a, i, words[1:i] as front, words[i + 1:] as rest from f, range(1, 3) t(i) where i < o),
    k as (select c.lang, c.words, c.a, min(row((1000000 * c.a * c.a) // (l.a * r.a), i, l.a, r.a)) as best
          from c join f as l on l.lang = c.lang and l.words = c.front join f as r on r.lang = c.lang and r.words = c.rest group by all),
    i as (select lang, a, unnest([words[1:2], words[2:3]]) as words from f where o = 3),
    x as (select distinct i.lang, i.words from i join f using (lang, words) where 100 * i.a >= 50 * f.a),
    z as (select *, array_to_string(words, ' ') as phrase from k anti join x using (lang, words))
    select lang, rank, phrase, a::bigint as a, best[3]::bigint as l, best[4]::bigint as r, n, best[1]::bigint as score
    from (select *, row_number() over (partition by lang order by best[1] desc, a desc, encode(phrase)) as rank from z) join n using (lang) where rank <= {PHRASES_A_LANGUAGE}
    """
)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 firmest phrases of two or three words of each language."""
    found = collocations.collocations(table(spark, folder, "documents"), least=10, longest=3, swallow=50, top=PHRASES_A_LANGUAGE)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
