"""Which stored files may hold a message or an attribute that a search asks for.

Each file has a Bloom filter over the trigrams of its lower-cased messages and one over its pairs of
attribute key and value. A filter is cut in slices, one bitmap each, so that its size follows the
number of distinct terms of the file.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.text import contains_pattern, literal_parts
from emberlog.plans.options import AggregateOptions, SearchOptions

#: Bits of one bitmap, as Spark's bitmap functions have it.
SLICE_BITS = 32_768
#: With three hashes at least 16 bits a term let a term that a file lacks pass about once in 200 times.
BITS_PER_TERM = 16
HASHES = 3
MESSAGE, ATTRIBUTE = "message", "attribute"


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _trigrams(text: Column) -> Column:
    """A hash per three neighbouring characters; none for shorter texts and null."""

    def made(chars: Column) -> Column:
        starts = F.slice(chars, F.lit(1), F.greatest(F.size(chars) - 2, F.lit(0)))
        return F.transform(starts, lambda c, i: F.xxhash64(c, F.get(chars, i + 1), F.get(chars, i + 2)))

    return F.coalesce(_named(F.split(text, ""), made), F.array().cast("array<bigint>"))


def _pairs(attributes: Column) -> Column:
    return F.coalesce(F.transform(F.map_entries(attributes), lambda e: F.xxhash64(e["key"], e["value"])), F.array().cast("array<bigint>"))


def _of_kind(kind: str, terms: Column) -> Column:
    return F.transform(F.array_distinct(terms), lambda term: F.struct(F.lit(kind).alias("kind"), term.alias("term")))


def _spread(term: Column) -> Column:
    return F.array(*[F.xxhash64(term, F.lit(n)) for n in range(HASHES)])


def file_column() -> Column:
    """The file a row comes from, below its table's folder: day, batch and name. Being made of
    file metadata alone, a filter on it leaves files out before they are opened."""
    return F.substring_index("_metadata.file_path", "/", -3)


def file_filters(logs: DataFrame) -> DataFrame:
    """(file, kind, slices, slice, bits, day, batch_id) for the files that hold these stored logs.

    Terms are made distinct per file within each task before they are shuffled. A file without
    any term has no row.
    """
    held = F.concat(_of_kind(MESSAGE, _trigrams(F.lower("message"))), _of_kind(ATTRIBUTE, _pairs(F.col("attr_text"))))
    terms = logs.select("day", "batch_id", file_column().alias("file"), F.inline(held)).distinct()
    of_file = ["day", "batch_id", "file", "kind"]
    sizes = terms.groupBy(*of_file).agg(F.count("*").alias("terms"))
    slices = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.col("terms") * BITS_PER_TERM / SLICE_BITS, F.lit(1.0))))).cast("bigint")
    placed = terms.join(sizes.select(*of_file, slices.alias("slices")), of_file).select(
        *of_file, "slices", F.explode(_spread(F.col("term"))).alias("hash")
    )
    at = F.pmod("hash", F.col("slices") * SLICE_BITS)
    made = placed.select(*of_file, "slices", F.floor(at / SLICE_BITS).alias("slice"), (at % SLICE_BITS).alias("bit"))
    return made.groupBy(*of_file, "slices", "slice").agg(F.bitmap_construct_agg("bit").alias("bits"))


def asked_terms(spark: SparkSession, options: SearchOptions | AggregateOptions) -> dict[str, list[int]]:
    """Per kind the places, as hashes, that every file with a match has set; none: nothing is known.

    Characters beside a wildcard of the pattern may be any, so trigrams come from the parts between.
    """
    asked: dict[str, list[Column]] = {}
    if options.q:
        # Lower-cased whole, as the comparison does it: a letter's form may depend on its neighbours.
        pattern = spark.range(1).select(F.lower(F.lit(contains_pattern(options.q, options.literal_q)))).first()[0]
        asked[MESSAGE] = [_trigrams(F.lit(part)) for part in literal_parts(pattern) if len(part) > 2]
    if options.attrs:
        asked[ATTRIBUTE] = [F.array(F.xxhash64(F.lit(a.key), F.lit(a.value))) for a in options.attrs]
    asked = {kind: columns for kind, columns in asked.items() if columns}
    if not asked:
        return {}
    places = [F.flatten(F.transform(F.array_distinct(F.flatten(F.array(*columns))), _spread)).alias(kind) for kind, columns in asked.items()]
    row = spark.range(1).select(*places).first()
    return {kind: list(dict.fromkeys(row[kind])) for kind in asked}


def files_without(filters: DataFrame, asked: dict[str, list[int]]) -> DataFrame:
    """(file) of the files that surely hold no match. Files without a filter are not among them."""

    def is_set(place: Column) -> Column:
        at = F.pmod(place, F.col("slices") * SLICE_BITS)
        bit = at % SLICE_BITS
        byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return (F.floor(at / SLICE_BITS) == F.col("slice")) & (F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1)

    found = F.lit(0)
    for kind, places in asked.items():
        known = F.size(F.filter(F.lit(places).cast("array<bigint>"), is_set))
        found = F.when(F.col("kind") == kind, known).otherwise(found)
    needed = sum(map(len, asked.values()))
    return filters.groupBy("file").agg(F.sum(found).alias("found")).where(F.col("found") < needed).select("file")
