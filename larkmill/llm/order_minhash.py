"""Document fingerprints: Order MinHash over words, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from larkmill.llm.base import documents, drop_written, words_column, written

#: Words of a k-mer; components of a fingerprint (a power of two, at most 256); k-mers of a component.
K, COMPONENTS, TUPLE = 2, 64, 2
#: Low bits of an item that hold its place in the text; the others are its hash.
PLACE_BITS = 28
#: What a fingerprint shows for a component without k-mers.
EMPTY = "----"

_MASK = (1 << PLACE_BITS) - 1


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~_MASK)).bitwiseOR(place.cast("long").bitwiseAND(F.lit(_MASK)))


def _top(item: Column) -> Column:
    return F.shiftright(item, PLACE_BITS)


def _component(item: Column) -> Column:
    """The component an item belongs to: the top bits of its hash."""
    return F.shiftrightunsigned(item, 64 - (COMPONENTS - 1).bit_length()).cast("int")


def kmers(text: Column, k: int = K) -> Column:
    """array<long>: hash and place of each run of k words; fewer words make one k-mer, none make none."""

    def of(words: Column) -> Column:
        n = F.size(words)
        width = F.least(n, F.lit(k))
        run = F.transform(words, lambda w, i: _packed(reduce(lambda h, j: F.xxhash64(h, F.get(words, i + F.lit(j))), range(1, k), F.xxhash64(F.lit(42), w)), i))
        return F.slice(run, 1, F.greatest(n - width + 1, F.lit(0)))

    return _let(words_column(text), of)


def numbered(items: Column) -> Column:
    """array<long>: hash of (k-mer, its number of earlier occurrences) and place, for each k-mer of kmers(); in ascending order.

    Items are sorted, so that equal k-mers stand together in text order; the start of each run is spread over it by doubling steps,
    as many as the longest possible run asks for. Sorting once per text replaces a count per k-mer.
    """

    def of(s: Column) -> Column:
        first = F.transform(s, lambda x, i: F.when((i > 0) & (_top(F.get(s, F.greatest(i - 1, F.lit(0)))) == _top(x)), F.lit(0)).otherwise(i))

        def spread(first: Column) -> Column:
            repeats = F.size(s) - F.size(F.array_distinct(first))
            rounds = F.when(repeats > 0, F.ceil(F.log2(repeats.cast("double") + 1)).cast("int")).otherwise(0)
            steps = F.when(rounds > 0, F.sequence(F.lit(0), F.greatest(rounds, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(steps, first, lambda acc, j: F.transform(acc, lambda f, i: F.greatest(f, F.coalesce(F.get(acc, F.greatest(i - _power(j), F.lit(0))), F.lit(0)))))

        def hashed(start: Column) -> Column:
            return F.sort_array(F.transform(s, lambda x, i: _packed(F.xxhash64(_top(x), i - F.get(start, i)), x)))

        return _let(_let(first, spread), hashed)

    return _let(F.sort_array(items), of)


def _power(j: Column) -> Column:
    return F.pow(F.lit(2.0), j).cast("int")


def codes(text: Column) -> Column:
    """array<int>: for each component with k-mers, its number and 16 bits that mark its tuple.

    A component's tuple: the k-mers with the TUPLE smallest hashes among those that fall to it (one permutation dealt out to all
    components), in text order. Equal texts have equal codes; a moved passage changes tuples that a mere set would keep.

    A variant: Order MinHash draws a permutation for each component. With one for all, a text of n k-mers has n / COMPONENTS of them in a
    component, so that short texts have many with one k-mer, which record no order.
    """

    def least(items: Column) -> Column:
        return F.filter(items, lambda x, i: (i < TUPLE) | (_component(F.get(items, F.greatest(i - TUPLE, F.lit(0)))) != _component(x)))

    def tuples(low: Column) -> Column:
        def code(x: Column, i: Column) -> Column:
            begins = (i == 0) | (_component(F.get(low, F.greatest(i - 1, F.lit(0)))) != _component(x))
            other = F.get(low, i + 1)
            paired = other.isNotNull() & (_component(other) == _component(x))
            in_order = x.bitwiseAND(F.lit(_MASK)) < other.bitwiseAND(F.lit(_MASK))
            mark = F.when(~paired, F.xxhash64(_top(x))).when(in_order, F.xxhash64(_top(x), _top(other))).otherwise(F.xxhash64(_top(other), _top(x)))
            return F.when(begins, F.shiftleft(_component(x), 16) + mark.bitwiseAND(F.lit(0xFFFF)).cast("int"))

        return F.filter(F.transform(low, code), lambda x: x.isNotNull())

    return _let(_let(numbered(kmers(text)), least), tuples)


def fingerprint(codes_: Column) -> Column:
    """4 hex digits for each component, or EMPTY."""
    by = F.map_from_arrays(F.transform(codes_, lambda c: F.shiftright(c, 16)), F.transform(codes_, lambda c: F.lower(F.lpad(F.hex(c.bitwiseAND(F.lit(0xFFFF))), 4, "0"))))
    return _let(by, lambda m: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(COMPONENTS - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(EMPTY))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of components with equal tuples among those that either text has k-mers in; two texts without words are alike (1)."""
    common = F.size(F.array_intersect(a, b))
    number = lambda x: F.transform(x, lambda c: F.shiftright(c, 16))
    either = F.size(F.array_union(number(a), number(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(common / F.greatest(either, F.lit(1)))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with codes and fingerprint of each whole text; null and texts without words have no codes and EMPTY throughout."""
    return docs.withColumn("codes", codes(F.col(text))).withColumn("fingerprint", fingerprint(F.col("codes")))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, copies, before, before_chars, after): for each distinct row its neighbours in ascending key order, the last before the first.

    rid: key and hash of the text, by which rows of one key are ordered too (null keys first); copies: rows that are equal in both.
    Order is by ranges: ranks come from within a range, and only each range's first and last row are put together.
    """
    light = docs.select(F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")).alias("rid"), F.length(F.coalesce(text, F.lit(""))).alias("chars"))
    distinct = written(light.groupBy("rid").agg(F.count("*").alias("copies"), F.first("chars").alias("chars")).orderBy("rid").withColumn("part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("part").orderBy("rid")
    row = F.struct("rid", "chars")
    near = distinct.select("*", F.lag(row).over(inside).alias("lo"), F.lead("rid").over(inside).alias("hi"))
    ends = distinct.groupBy("part").agg(F.min("rid").alias("least"), F.max(row).alias("most"))
    over = W.orderBy("part")  # a row for each range, whose number is that of the partitions
    all_ = over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    prior, following = F.coalesce(F.lag("most").over(over), F.last("most").over(all_)), F.coalesce(F.lead("least").over(over), F.first("least").over(all_))
    joined = near.join(F.broadcast(ends.select("part", prior.alias("prior"), following.alias("next"))), "part")
    before = F.coalesce("lo", "prior")
    return joined.select("rid", "copies", before["rid"].alias("before"), before["chars"].alias("before_chars"), F.coalesce("hi", "next").alias("after"))


def with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of each row of docs.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document. Null text
    counts as empty. Of equal rows, each but the last has an equal one as its next. A single document is its own next.
    """
    around = written(neighbours(docs, key, text), "around")
    whole = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    # With the type that rid has in written tables; else joins would cast it and deal the texts out once more.
    whole = whole.withColumn("rid", F.struct("key", F.xxhash64("text").alias("h")).cast(around.schema["rid"].dataType))
    prints = written(whole.select("rid", codes(F.col("text")).alias("codes")).groupBy("rid").agg(F.first("codes").alias("codes")), "codes")
    nexts = prints.select(F.col("rid").alias("after"), F.col("codes").alias("next_codes"))
    light = written(around.join(nexts, "after").join(prints, "rid").select("rid", "copies", "before", "before_chars", "codes", "next_codes"), "light")
    drop_written(prints)
    one = whole.groupBy("rid").agg(F.max("text").alias("text"))
    half = F.floor(F.col("before_chars") / 2).cast("int")
    given = one.join(light.select("rid", "before", "before_chars"), "rid").select(F.col("before").alias("rid"), F.substring("text", F.lit(1), half).alias("given"))
    base = one.join(light.drop("before", "before_chars"), "rid").join(given, "rid")
    n = F.length("text")
    # Rows that have an equal one after them, then the last of each.
    kinds = F.when(F.col("copies") > 1, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    made = base.select("*", F.explode(kinds).alias("self"))
    change = F.when(F.col("self"), F.substring("text", F.lit(1), F.floor(n / 2).cast("int"))).otherwise(F.col("given"))
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), change)
    times = F.when(F.col("self"), F.col("copies") - 1).otherwise(1)
    next_codes = F.when(F.col("self"), F.col("codes")).otherwise(F.col("next_codes"))
    out = made.select("rid", n.cast("long").alias("n_chars"), "codes", next_codes.alias("next_codes"), times.alias("times"), edited.alias("edited"))
    out = out.withColumn("edited_codes", codes(F.col("edited")))
    return out.select(
        F.col("rid.key").alias(key),
        "n_chars",
        "edited",
        fingerprint(F.col("codes")).alias("fingerprint"),
        fingerprint(F.col("edited_codes")).alias("edited_fingerprint"),
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.col("next_codes")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_time"),
    ).drop("_time")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are empty; texts
    without words are alike (1) to each other and to nothing else (0); rows of one doc_id are ordered by their texts' hashes."""
    made = with_edits(documents(spark, sf_dir))
    return made.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op1_order_minhash": op1_order_minhash}
ORACLES: dict[str, str] = {}
