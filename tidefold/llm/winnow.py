"""Document fingerprints by winnowing, with Spark expressions only."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import cut, parts_of

#: Units of text are what white space parts; in texts of scripts written without it, their characters go one by one.
BARE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_SPACE = " \t\n\x0b\f\r"
#: Units a hashed gram has, and grams a window has: texts that share WINDOW + GRAM - 1 units in a row share a hash.
GRAM, WINDOW = 5, 4
#: Rolling (Karp-Rabin) hash of a gram: the polynomial of its units' numbers at BASE, modulo the prime 2^31 - 1. The next
#: gram's is ((h - first * BASE^(GRAM - 1)) * BASE + new) mod PRIME.
BASE, PRIME = 1_000_003, (1 << 31) - 1
#: A gram is packed as 31 bits of hash, then 31 of its place counted down: the least of a window is its rightmost least.
_PLACES = (1 << 31) - 1
#: Rows, about, of a range of ids that neighbours are found in; ranges at most; ids of a range that its cuts come from.
ROWS_A_RANGE, RANGES, IDS_A_RANGE = 20_000, 100_000, 100
#: Parts of a range at most.
_SUBS = 1 << 20


def units(text: Column) -> Column:
    """array<string> of a text that isn't null."""
    plain = F.trim(F.lower(text), F.lit(_SPACE))
    each = F.when(F.octet_length(text) > F.length(text), F.rlike(text, F.lit(f"[{BARE}]"))).otherwise(F.lit(False))
    by_character = F.regexp_extract_all(plain, F.lit(rf"[^\s{BARE}]+|[{BARE}]"), F.lit(0))
    return F.when(plain == "", F.array().cast("array<string>")).when(each, by_character).otherwise(F.split(plain, r"\s+"))


def numbers(text: Column) -> Column:
    """A number from 1 to PRIME - 1 for each unit of a text: its hash."""
    return F.transform(units(text), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME - 1)) + 1)


def grams(text: Column) -> Column:
    """Packed hashes and places of all runs of GRAM units; of all units where there are fewer, none without units.

    The rolling hash is a polynomial, worked out at each place by its GRAM terms: that is what rolling gives, and array
    expressions carry no state from one place to the next.
    """

    def gram(units: Column) -> Column:
        n = F.size(units)

        def packed(x: Column, i: Column) -> Column:
            h = x
            for k in range(1, GRAM):
                h = (h * BASE + F.coalesce(F.get(units, i + k), F.lit(0))) % PRIME  # nothing lies behind the end of a short text
            return F.shiftleft(h, 31) + (F.lit(_PLACES) - i)

        return F.transform(F.slice(units, F.lit(1), F.greatest(n - (GRAM - 1), F.least(n, F.lit(1)))), packed)

    return _let(numbers(text), gram)


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once: it's bound as the element of an array of one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def winnow(text: Column) -> Column:
    """array<long> of the packed grams that are the rightmost least of some window, by place; unpack() tells them apart.

    A text of fewer grams than a window has one window of all. The place is the number of the gram's first unit.
    """

    def chosen(g: Column) -> Column:
        n = F.size(g)
        first = F.slice(g, F.lit(1), F.greatest(n - (WINDOW - 1), F.least(n, F.lit(1))))
        return F.array_distinct(F.transform(first, lambda x, i: F.least(x, *[F.get(g, i + k) for k in range(1, WINDOW)])))

    return _let(grams(text), chosen)


def unpack(packed: Column) -> Column:
    """array<struct<hash long, place int>> of what winnow() gives."""
    place = lambda v: (F.lit(_PLACES) - v.bitwiseAND(F.lit(_PLACES))).cast("int")
    return F.transform(packed, lambda v: F.struct(F.shiftright(v, 31).alias("hash"), place(v).alias("place")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two packed fingerprints that both have; 1 for two empty ones."""

    def shared(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["x"], pair["y"]))
        return F.coalesce(F.try_divide(both.cast("double"), F.size(pair["x"]) + F.size(pair["y"]) - both), F.lit(1.0))

    hashes = lambda packed: F.array_distinct(F.transform(packed, lambda v: F.shiftright(v, 31)))
    return _let(F.struct(hashes(a).alias("x"), hashes(b).alias("y")), shared)


def to_string(packed: Column) -> Column:
    """A packed fingerprint as hex numbers, by place."""
    return F.array_join(F.transform(packed, lambda v: F.lower(F.hex(v))), " ")


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint: array<struct<hash, place>>) of every whole text.

    Letters are lowered. Null and empty texts, and texts of white space, have empty fingerprints; equal texts have
    equal ones. Repeated rows stay; extra columns are not read.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), unpack(winnow(F.coalesce(F.col(text), F.lit("")))).alias("fingerprint"))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, packed, next_text, next_packed): each row, its fingerprint as winnow() gives it, and those of the
    next row by descending doc_id; after the last, of the first. A null text is empty.

    Ids must be numbers, else it's an error. Rows of one id follow each other by a hash of the text, then by text, both
    descending; a null id is the last. A single row is its own next; no row gives none. Ids are cut at about their
    quantiles into ranges of some ROWS_A_RANGE rows, and an id that fills several, or none, into parts of its texts'
    hashes. Where the cuts lie changes no result, so they are taken from a bounded sample of ids, as range partitioning
    does. Texts are shuffled once, a range a task; of the others a range sees one row, the head of the one below.
    """
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, NumericType):
        raise ValueError(f"ids must be numbers, not {kind.simpleString()}")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n = min(RANGES, parts_of(rows, size, ROWS_A_RANGE))
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, size // (IDS_A_RANGE * n)))) == 0)  # for the cuts alone
    cuts = some.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n)).first()[0]
    hashed = F.shiftrightunsigned(F.xxhash64("text"), 1)
    rows = rows.withColumn("u", hashed).withColumn("r", _range(cuts or [], kind.simpleString(), max(1, -(-nulls // ROWS_A_RANGE))))
    # the head of a range is also sent to the range above, that of the highest to the lowest
    everything = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = rows.groupBy("r").agg(F.max(F.struct("doc_id", "u")).alias("head")).withColumn("host", F.coalesce(F.lead("r").over(Window.orderBy("r")), F.first("r").over(everything)))
    own, other = F.struct("r", F.lit(False).alias("guest")), F.struct(F.col("host").alias("r"), F.lit(True).alias("guest"))
    is_head = F.struct("doc_id", "u").eqNullSafe(F.col("head"))
    placed = rows.join(F.broadcast(cut(heads, "heads")), "r").withColumn("at", F.when(is_head, F.array(own, other)).otherwise(F.array(own)))
    dealt = placed.select("doc_id", "u", "text", F.explode("at").alias("at")).select("doc_id", "u", "text", "at.r", "at.guest").repartitionByRange(n, "r")
    order = Window.partitionBy("r").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("u"), F.desc("text"))
    following = dealt.withColumn("packed", winnow(F.col("text"))).withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "packed")})
    return following.where("not guest").select("doc_id", "text", "packed", "next_text", "next_packed")


def _range(cuts: list, kind: str, parts_of_null: int) -> Column:
    """The number of a row's range, ascending by id (null first) and u.

    That is how many distinct cuts lie below its id, found in two steps so that a row looks at few of many cuts, and for
    an id that is several cuts, the part of its texts' hashes.
    """
    times = Counter(cuts)
    cuts = sorted(times)
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    array = lambda values, of: F.from_json(F.lit(json.dumps(values)), of)
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("doc_id")))
    coarse = below(array([p[-1] for p in parts], f"array<{kind}>"))
    fine = F.coalesce(below(F.get(array(parts, f"array<array<{kind}>>"), coarse)), F.lit(0))
    main = F.least(coarse * width, F.lit(len(cuts))) + F.greatest(fine, F.lit(0))
    part = lambda m: F.shiftright(F.shiftrightunsigned("u", 32) * m, 31)
    often = F.get(array([times[c] for c in cuts], "array<int>"), main)
    same = F.get(array(cuts, f"array<{kind}>"), main) == F.col("doc_id")
    whole = _let(main, lambda k: k.cast("long") * _SUBS)
    sub = F.when(same & (often > 1), 1 + part(often.cast("long"))).otherwise(F.lit(0))
    return F.when(F.col("doc_id").isNull(), F.lit(-_SUBS) + part(F.lit(parts_of_null).cast("long"))).otherwise(whole + sub)


def edited(text: Column, other: Column) -> Column:
    """A text whose last half of code points, rounded down, gives way to as many (or all) of another's first."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(other, F.lit(1), half))
