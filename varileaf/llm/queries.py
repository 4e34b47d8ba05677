"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varileaf.llm import crossentropy, eliasfano, html, jaccard, langid, lloyd, mixing, packing, passages, pieces, quality, repeats, transport, whitening
from varileaf.llm.common import documents, materialize, pages
from varileaf.llm.tokens import tokenizer_path
from varileaf.llm.vectors import embeddings


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written and read again; the arrays of the index are stored with them and aren't columns of the result."""
    stored = materialize(transport.encode_media(documents(spark, sf_dir)), "media")
    return transport.read_media(stored).drop("pts", "random_access")


def op3_word_backoff_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict(docs, langid.fit(docs))


def op4_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(documents(spark, sf_dir))


def op5_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.read_tokens(eliasfano.write_tokens(documents(spark, sf_dir), tokenizer_path()))


def op6_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(pages(spark, sf_dir))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what labels call good."""
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return crossentropy.score(documents(spark, sf_dir), target)


def op8_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes are removed in strings of 400; n_passages and n_passage_words tell passages of over 50 words that other documents hold, however few bytes they have."""
    docs = documents(spark, sf_dir)
    return repeats.remove(docs, beside=passages.counted(docs))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op11_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.cluster(embeddings(spark, sf_dir))


def op13_offset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """covered: the byte after the last that a piece stands for."""
    path = tokenizer_path("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(documents(spark, sf_dir), path), path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
        F.coalesce(F.get("stops", F.size("stops") - 1), F.lit(0)).cast("long").alias("covered"),
    )


_ALL = (op1_packing, op2_transport_streams, op3_word_backoff_language, op4_kneser_ney_rules, op5_elias_fano_tokens, op6_block_rules, op7_cross_entropy_difference, op8_sainte_lague_mix, op9_suffix_repeats, op10_jaccard_join, op11_jacobi_whitening, op12_delta_lloyd, op13_offset_pieces)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_UPPER, _LOWER = (str().join(map(chr, range(a, a + 26))) for a in (65, 97))
#: Shingle sets as lists, pairs through common shingles, and the smallest doc_id that is reachable by links.
_JACCARD = f"""with recursive t as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from t),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, md5_number(x) as x from (select doc_id, unnest(s) as x from s)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
r as (select a as doc_id, a as c from l union select r.doc_id, l.b from r join l on l.a = r.c),
m as (select doc_id, min(c) as c from r group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(m.c, n.doc_id) as component_id from n left join m using (doc_id)"""



def _lloyd(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """A pair of tables for each round: owners with distances, and the centroids that follow."""
    steps = [
        f"""v as (select vec_id, list_transform(embedding, lambda c: cast(floor(1024 * cast(c as double)) as bigint)) as x from embeddings
where len(embedding) = {dims} and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
c0 as (select row_number() over (order by h, x) - 1 as c, x from (select x, sha256('3:' || vec_id) as h from v order by h, x limit {k}))"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} as (select vec_id, x, min(o) as o from (select vec_id, v.x as x, struct_pack(d := list_sum(list_transform(list_zip(v.x, c{r}.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c) as o
from v, c{r}) group by vec_id, x)"""
        )
        if r < rounds:
            steps.append(
                f"""m{r} as (select c, list(s order by j) as x from (select o.c as c, j, cast(floor(sum(x[j]) / count(*)) as bigint) as s from a{r}, range(1, {dims + 1}) as i(j) group by o.c, j) group by c),
c{r + 1} as (select c, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} using (c))"""
            )
    return f"""with {", ".join(steps)}
select vec_id, cast(o.c as int) as cluster, cast(o.d as bigint) as distance, cast(sum(o.d) over (partition by o.c) as bigint) as cluster_inertia, cast(sum(o.d) over () as bigint) as inertia,
sha256(array_to_string(c{rounds}.x, ',')) as centroid_sha256 from a{rounds} join c{rounds} on c = o.c"""


ORACLES: dict[str, str] = {"op10_jaccard_join": _JACCARD, "op12_delta_lloyd": _lloyd()}
