"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words, weighing as often as they occur. For each of SAMPLES samples a term has
r and c from Gamma(2, 1) and b uniform in [0, 1), all from hashes of term and sample; with
t = floor(ln(weight) / r + b), the term with the least ln(c) - r * (t - b + 1) is drawn. Two documents draw
the same term at the same t with a probability of their generalised Jaccard similarity, the sum of least
weights over the sum of greatest. The least value itself tells term and t, so a fingerprint is the 32-bit
hashes of these values, and the likeness of two is the share of equal samples. A value depends on term and
weight alone, so those of frequent pairs are a table.

Texts without words have a fingerprint of zeros: like each other, unlike all else. Null texts are empty; very
long ones are terms like others. Documents come in descending order of id, then of their text's hash and text;
null ids are last; repeated rows stay. Columns but doc_id and text play no part; an empty table gives none.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.tables import table

SAMPLES, A_GROUP = 64, 16
#: Entries of the table of known values, whatever the input; rows that choose them (an eighth of all at most) and the code points read of each.
KNOWN, KNOWN_FROM, KNOWN_CHARS = 1 << 16, 1 << 14, 1 << 13
#: Documents of a bucket of neighbours, the most buckets there are, whatever the input, and sampled rows for each.
A_BUCKET, MOST_BUCKETS, A_BOUND = 512, 1 << 16, 16
_LN2 = math.log(2)
_BLANK = r"[\x20\x09-\x0D]+"


def value(term: Column, group: Column, j: int, log_weight: Column) -> Column:
    """The term's value in sample j of a group."""
    x, y = F.xxhash64(term, group, F.lit(2 * j)), F.xxhash64(term, group, F.lit(2 * j + 1))
    # uniform in (0, 1): (part + 0.5) / 2**bits, with the powers of two taken out of products and logarithms
    part = lambda h, at, bits: F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5
    r = 42 * _LN2 - F.ln(part(x, 0, 21) * part(x, 21, 21))
    b = part(x, 42, 21) * 2.0**-21
    log_c = F.ln(62 * _LN2 - F.ln(part(y, 0, 31) * part(y, 31, 31)))
    return log_c - r * (F.floor(log_weight / r + b).cast("double") - b + 1.0)


def word_terms(text: Column | str) -> Column:
    """The words of a text, and an empty one where it begins or ends in blanks."""
    return F.explode(F.split(text, _BLANK))


def pair(term: Column, weight: Column) -> Column:
    """A 64-bit key that tells a term's weights apart, the term itself for weight 1; null for weights that don't fit."""
    return F.when(weight <= 1 << 24, term.bitwiseXOR(F.shiftleft(weight - 1, 40)))


def known_values(docs: DataFrame) -> DataFrame:
    """(key, of_term, known): the values in all samples of the pairs of term and weight that a sample of docs (text) has most often.

    They are what `value` gives, worked out once; which pairs are there changes the time only.
    """
    n = max(docs.count(), 1)
    some = docs.sample(min(KNOWN_FROM / n, 0.125), 7).select(F.monotonically_increasing_id().alias("nr"), F.substr("text", F.lit(1), F.lit(KNOWN_CHARS)).alias("text"))
    words = some.select("nr", word_terms("text").alias("word")).where("word != ''")
    weights = words.groupBy("nr", F.xxhash64("word").alias("term")).agg(F.count("*").alias("weight"))
    pairs = weights.groupBy("term", "weight").agg(F.count("*").alias("times")).where("times > 1")
    pairs = pairs.orderBy(F.desc("times"), "term", "weight").limit(KNOWN)
    w = F.ln(F.col("weight").cast("double"))
    groups = pairs.select(pair(F.col("term"), F.col("weight")).alias("key"), "term", w.alias("w"), F.explode(F.array(*(F.lit(g) for g in range(SAMPLES // A_GROUP)))).alias("group"))
    values = F.array(*(value(F.col("term"), F.col("group"), j, F.col("w")) for j in range(A_GROUP)))
    parts = groups.groupBy("key").agg(F.min("term").alias("of_term"), F.sort_array(F.collect_list(F.struct("group", values.alias("values")))).alias("parts"))
    return parts.where(F.size("parts") == SAMPLES // A_GROUP).select("key", "of_term", F.flatten("parts.values").alias("known"))  # two pairs of one key: neither


def signatures(terms: DataFrame, *by: str, known: DataFrame) -> DataFrame:
    """(*by, sig, edited_sig) of rows (*by, term, own, edited): a term and its weights in a text and in its edited form.

    A term of equal weights counts for both texts at once. Values come from the table `known` where they are
    in it. Samples come in groups of A_GROUP, rows of their own, so that the generated code of one aggregation
    stays small enough to be compiled. Nothing is shuffled if the rows lie together by `by` or some of it.
    """
    both = F.col("own") == F.col("edited")
    weigh = lambda of, w: F.struct(F.lit(of).alias("of"), w.alias("w"))
    uses = F.array(
        F.when(both, weigh(3, F.col("own"))),
        F.when(~both & (F.col("own") > 0), weigh(1, F.col("own"))),
        F.when(~both & (F.col("edited") > 0), weigh(2, F.col("edited"))),
    )
    rows = terms.select(*by, "term", F.explode(uses).alias("use")).where("use IS NOT NULL").select(*by, "term", "use.of", F.col("use.w").alias("weight"))
    rows = rows.withColumn("key", pair(F.col("term"), F.col("weight"))).join(F.broadcast(known), "key", "left")  # at most KNOWN rows
    rows = rows.select(*by, "term", "of", F.ln(F.col("weight").cast("double")).alias("w"), F.when(F.col("of_term") == F.col("term"), F.col("known")).alias("known"), F.explode(F.array(*(F.lit(g) for g in range(SAMPLES // A_GROUP)))).alias("group"))
    told = lambda j: F.get("known", F.col("group") * A_GROUP + j)
    least = [F.min(F.when(F.col("known").isNotNull(), told(j)).otherwise(value(F.col("term"), F.col("group"), j, F.col("w")))).alias(f"a{j}") for j in range(A_GROUP)]
    drawn = rows.groupBy(*by, "group", "of").agg(*least)
    of = lambda without: [F.min(F.when(F.col("of") != without, F.col(f"a{j}"))).alias(f"{without}_{j}") for j in range(A_GROUP)]
    drawn = drawn.groupBy(*by, "group").agg(*of(2), *of(1))
    part = lambda without: F.array(*(F.when(F.col(f"{without}_{j}").isNull(), F.lit(0)).otherwise(F.hash(f"{without}_{j}")) for j in range(A_GROUP)))
    parts = drawn.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("group", part(2).alias("sig"), part(1).alias("edited_sig")))).alias("parts"))
    return parts.select(*by, *(F.flatten(F.col(f"parts.{c}")).alias(c) for c in ("sig", "edited_sig")))


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(SAMPLES))


def printed(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lower(F.right(F.concat(F.lit("0000000"), F.hex(x)), F.lit(8)))), "")


def bounds(docs: DataFrame) -> list[tuple[int | None, int]]:
    """Places (doc_id, hash), descending, that cut docs (doc_id, hash) into buckets of about A_BUCKET rows.

    They are quantiles of a sample of A_BOUND rows for each bucket, so ids may lie as unevenly as they like.
    """
    n = docs.count()
    buckets = min(-(-n // A_BUCKET), MOST_BUCKETS)
    if buckets < 2:
        return []
    order = Window.orderBy(F.col("doc_id").desc_nulls_last(), F.col("hash").desc())  # of the sample: A_BOUND rows for each bucket
    sample = docs.sample(min(1.0, buckets * A_BOUND / n), 11).withColumn("nr", F.row_number().over(order))
    places = sample.where(F.col("nr") % A_BOUND == 0).orderBy("nr").collect()
    return list(dict.fromkeys((r["doc_id"], r["hash"]) for r in places))


def bucketed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, hash, ...) with bucket: how many bounds come before the row. Structs with null ids come last."""
    cuts = bounds(docs.select("doc_id", "hash"))
    text = json.dumps([{"doc_id": d, "hash": h} for d, h in cuts])
    one = docs.sparkSession.range(1).select(F.from_json(F.lit(text), "array<struct<doc_id: bigint, hash: bigint>>").alias("bounds"))  # one row, at most MOST_BUCKETS places
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(len(cuts), 1).bit_length()))))
    ahead = lambda at, step: F.get("bounds", at + step - 1) > F.struct("doc_id", "hash")
    place = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(ahead(at, step), step).otherwise(0))
    return docs.crossJoin(F.broadcast(one)).withColumn("bucket", F.coalesce(place, F.lit(0))).drop("bounds")  # never null, so all uses of the rows are one plan


def neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, row, ghost, doc_id, text, next): every document with the text of the next one.

    Documents fall into buckets of neighbours, which the rows are shuffled by once. Each bucket's last row is
    a ghost, the first document behind it, so that what is next is always beside.
    """
    docs = bucketed(docs.withColumn("hash", F.xxhash64("text")))
    heads = docs.groupBy("bucket").agg(F.max(F.struct("doc_id", "hash")).alias("head")).select("bucket", F.col("head.doc_id").alias("head_id"), F.col("head.hash").alias("head_hash"))
    own = heads.withColumnRenamed("bucket", "b")  # at most MOST_BUCKETS rows
    same = (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash"))
    firsts = docs.join(F.broadcast(own), same).groupBy("b", "doc_id", "hash").agg(F.max("text").alias("text"))
    order = Window.orderBy("bucket")
    links = heads.select("bucket", F.lead("bucket").over(order).alias("b"), F.first("bucket").over(order).alias("top"))
    ghosts = links.select("bucket", F.coalesce("b", "top").alias("b")).join(firsts, "b")

    columns = ("doc_id", "hash", "text")
    rows = docs.select("bucket", F.lit(0).alias("ghost"), *columns).union(ghosts.select("bucket", F.lit(1), *columns))
    by = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc())
    return rows.withColumns({"row": F.row_number().over(by), "next": F.lead("text").over(by)}).drop("hash")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, sig, edited_sig, next_sig) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = neighbours(docs)
    n = F.length("text")
    cut = (n - F.floor(n / F.lit(3))).cast("int")
    rows = rows.withColumns({"n": n, "head": F.substr("text", F.lit(1), cut), "put": F.coalesce(F.substr("next", F.lit(1), (n - cut).cast("int")), F.lit(""))})

    # words that are whole in the head belong to both texts
    part_of_word = F.length(F.regexp_extract(F.reverse("head"), r"^[^\x20\x09-\x0D]*", 0))
    split = rows.withColumn("both", (F.length("head") - part_of_word).cast("int"))
    rest = lambda c: F.substr(c, F.col("both") + 1, F.length(c))
    parts = F.array(
        F.struct(F.substr("head", F.lit(1), F.col("both")).alias("text"), F.lit(3).alias("of")),
        F.struct(rest(F.col("text")).alias("text"), F.lit(1).alias("of")),
        F.struct(F.concat(rest(F.col("head")), F.col("put")).alias("text"), F.lit(2).alias("of")),
    )
    words = split.select("bucket", "row", F.explode(parts).alias("part")).select("bucket", "row", F.col("part.of").alias("of"), word_terms("part.text").alias("word"))
    terms = words.where("word != ''").select("bucket", "row", "of", F.xxhash64("word").alias("term"))
    terms = terms.groupBy("bucket", "row", "term").agg(F.sum(F.col("of").bitwiseAND(F.lit(1))).alias("own"), F.sum(F.shiftright("of", 1)).alias("edited"))
    drawn = signatures(terms, "bucket", "row", known=known_values(docs.select("text")))

    facts = rows.select("bucket", "row", "ghost", "doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.concat("head", "put"), 256).alias("edited_sha256"))
    nothing = F.array_repeat(F.lit(0), SAMPLES)
    out = facts.join(drawn, ["bucket", "row"], "left").withColumns({c: F.coalesce(c, nothing) for c in ("sig", "edited_sig")})
    return out.withColumn("next_sig", F.lead("sig").over(Window.partitionBy("bucket").orderBy("row"))).where("ghost = 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: fingerprints of every whole text of documents, of its edited text, and their likenesses."""
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def facts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op2 SQL can say: lengths and the digests of edited texts."""
    return query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


FACTS_ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, length(text) AS n_chars, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id DESC)
)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3)) AS edited_sha256 FROM n
"""
