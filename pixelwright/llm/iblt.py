"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines; a line of more than SEGMENT characters is cut at the first
sentence mark after that many, or after as many again and as many again, so that an insertion
shifts the pieces up to the next such mark only. The sketch holds the set of their 64-bit digests.
Every digest falls into one cell of each third of the table; a cell keeps a count, the xor of its
digests and the xor of their check values. Subtracting two sketches cancels common paragraphs;
peeling takes cells that hold one digest, and removes it from its other cells, until nothing is
left: the recovered digests are those on which the versions differ.

The fingerprint is a table of CELLS cells for any text. If the difference of two fingerprints
doesn't peel, both texts are sketched again in a larger table:

1. the first has CELLS cells for each LOAD digests of the difference, whose number is estimated
   from the counts in the fingerprints' own cells; it is kept as blocks of CELLS cells (the
   block is chosen by bits of the digest), so that peeling is linear;
2. a block that fails gets twice, four times ... the cells with other positions until it peels.

The size of the tables follows the difference, not the texts. Likeness is the Jaccard index of the
paragraph sets, from the sizes (a fingerprint's counts add up to three times its text's number)
and the number of recovered digests, so ``near_*`` is a function of the fingerprints where they
peel, and of the larger sketches of the same sets where they don't.

DataFrame functions only. The next document's text is brought along by one shuffle over ranges
of ids; all later groupings keep that partitioning.

Cases: null text = empty, no paragraphs; two empty sets are alike (1.0); repeated paragraphs
count once; documents with the same id are ordered by their texts; the only document is its own
successor; an empty table gives no rows; very long texts spread over many blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, table

SEGMENT = 64
#: Cells of a fingerprint; a multiple of 3.
CELLS = 24
#: Digests of the difference that one block of a larger table should hold.
LOAD = 8
#: Doublings of a block beyond eight cells for each of its digests; each has positions of its own.
SPARE = 8
ROUNDS = 12
#: Bytes of text for each range of ids.
RANGE_BYTES = 1 << 26


def paragraphs(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    units = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{SEGMENT}}}[^\n.!?]{{0,{2 * SEGMENT}}}[.!?]*"), F.lit(0))
    return F.array_distinct(F.transform(units, lambda u: F.xxhash64(u)))


def _place(digest: Column, cells: Column, salt: Column) -> list[Column]:
    third = F.floor(cells / 3)
    h = F.xxhash64(digest, salt)
    return [(F.pmod(F.shiftright(h, 21 * k), third) + third * k).cast("int") for k in range(3)]


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: the planner copies an expression into each place that names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def sketch(digests: Column, cells: Column | int = CELLS, salt: Column | int = 0) -> Column:
    """Array of cells (n, key, chk) for an array of distinct digests."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("chk"))
    cells, salt = _column(cells), _column(salt)
    third = F.floor(cells / 3).cast("int")

    def fill(placed: Column, k: int) -> Column:
        return F.transform(
            F.sequence(third * k, third * (k + 1) - 1),
            lambda i: F.aggregate(
                F.filter(placed, lambda e: e["p"][k] == i),
                zero,
                lambda acc, e: F.struct((acc["n"] + 1).alias("n"), _xor(acc["key"], e["d"]).alias("key"), _xor(acc["chk"], e["c"]).alias("chk")),
            ),
        )

    placed = F.transform(digests, lambda d: F.struct(d.alias("d"), _check(d).alias("c"), F.array(*_place(d, cells, salt)).alias("p")))
    return _once(placed, lambda p: F.concat(*[fill(p, k) for k in range(3)]))


def _column(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.struct((a["n"] - b["n"]).alias("n"), _xor(a["key"], b["key"]).alias("key"), _xor(a["chk"], b["chk"]).alias("chk")))


def peel(difference: Column, cells: Column | int = CELLS, salt: Column | int = 0) -> Column:
    """Digests in a subtracted sketch as structs (d, side): side 1 is only on the left, -1 only on the right. Null if cells are left."""
    nothing = F.array().cast("array<struct<d:bigint,side:int>>")
    cells, salt = _column(cells), _column(salt)
    start = F.struct(difference.alias("cells"), nothing.alias("found"), F.lit(True).alias("open"))

    def round_(state: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["chk"] == _check(c["key"])))
        new = F.array_distinct(F.transform(pure, lambda c: F.struct(c["key"].alias("d"), c["n"].alias("side"))))
        return _once(
            new,
            lambda keys: F.struct(
                F.aggregate(
                    F.transform(keys, lambda x: F.struct(x["d"].alias("d"), x["side"].alias("side"), F.array(*_place(x["d"], cells, salt)).alias("p"))),
                    state["cells"],
                    lambda acc, x: F.transform(
                        acc,
                        lambda c, i: F.when(
                            F.array_contains(x["p"], i),
                            F.struct((c["n"] - x["side"]).alias("n"), _xor(c["key"], x["d"]).alias("key"), _xor(c["chk"], _check(x["d"])).alias("chk")),
                        ).otherwise(c),
                    ),
                ).alias("cells"),
                F.concat(state["found"], keys).alias("found"),
                (F.size(keys) > 0).alias("open"),
            ),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda s, _: F.when(s["open"], round_(s)).otherwise(s))
    return _once(end, lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0)), s["found"]))


def recover(left: Column, right: Column) -> Column:
    """Differing digests of two small sets: tables of CELLS, twice CELLS ... cells, until one peels.

    The tables grow up to eight cells for each digest of both sides and SPARE times beyond; that the
    last of so many with independent positions fails would take equal positions in all of them.
    """
    result = "array<struct<d:bigint,side:int>>"

    def rounds(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        most = F.ceil(F.log2(F.greatest(F.size(a) + F.size(b), F.lit(3)) * F.lit(8.0 / CELLS))).cast("int")

        def attempt(k: Column) -> Column:
            cells = F.call_function("shiftleft", F.lit(CELLS // 3), k) * 3
            return peel(subtract(sketch(a, cells, k + 1), sketch(b, cells, k + 1)), cells, k + 1)

        tried = F.sequence(F.lit(0), F.greatest(most, F.lit(0)) + SPARE)
        return F.aggregate(tried, F.lit(None).cast(result), lambda found, k: F.when(found.isNotNull(), found).otherwise(attempt(k)))

    found = _once(F.struct(left.alias("a"), right.alias("b")), rounds)
    return F.coalesce(found, F.raise_error(F.lit("a sketch did not peel at any size")).cast(result))


def differing(difference: Column, n_left: Column, n_right: Column) -> Column:
    """About how many digests differ, from the counts of a subtracted sketch that doesn't peel.

    In a third of c cells, the squares of d signed counts add up to about d + (balance ** 2 - d) / c.
    """
    c = CELLS // 3
    balance = (n_left - n_right) * (n_left - n_right)
    squares = F.aggregate(difference, F.lit(0), lambda total, x: total + x["n"] * x["n"]) / 3.0
    return F.greatest((squares - balance / c) * (c / (c - 1)), F.abs(n_left - n_right), F.lit(LOAD + 1))


def as_text(cells: Column) -> Column:
    """A sketch in hex: 4 digits of count, 16 of digest xor, 16 of check xor for each cell; empty cells as a dot."""
    return F.array_join(
        F.transform(cells, lambda c: F.when((c["n"] == 0) & (c["key"] == 0) & (c["chk"] == 0), F.lit(".")).otherwise(F.concat_ws(":", F.hex(c["n"].cast("long")), F.hex(c["key"]), F.hex(c["chk"])))),
        ";",
    )


def with_next(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each row with the next one's text, by key and then text; after the last comes the first.

    Rows are dealt out to ranges of keys of about equal size; the first rows of a range also go
    to the range before it. Columns: bucket, row (number in the bucket), key, text, next_text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    shares = [k / buckets for k in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("key", shares, 10 * buckets)).first()[0] or []
    cuts = sorted(set(cuts))  # as many numbers as there are ranges at most
    # in two levels, so that a row meets about twice the root of the number of ranges
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("key")))
    heads = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]).cast("array<bigint>")
    groups = F.array(*[F.array(*[F.lit(c) for c in cuts[k : k + step]]) for k in range(0, len(cuts), step)] or [F.array()]).cast("array<array<bigint>>")
    skipped = F.coalesce(below(heads), F.lit(0))
    within = F.coalesce(below(F.get(groups, skipped)), F.lit(0))
    rows = rows.withColumn("bucket", skipped * step + within)
    first = {r["bucket"]: r["k"] for r in rows.groupBy("bucket").agg(F.min("key").alias("k")).collect()}
    order = sorted(first)
    before = spark.createDataFrame([(first[b], order[k - 1]) for k, b in enumerate(order)] or [(None, None)], "first_key long, earlier int")
    copies = F.when(F.col("earlier").isNull(), F.array(F.struct("bucket", F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct("bucket", F.lit(False).alias("guest")), F.struct(F.col("earlier").alias("bucket"), F.lit(True).alias("guest")))
    )
    dealt = rows.join(F.broadcast(before), F.col("key") == F.col("first_key"), "left").select("key", "text", F.explode(copies).alias("to"))
    dealt = dealt.select("to.bucket", "to.guest", "key", "text")
    w = Window.partitionBy("bucket").orderBy("guest", "key", "text")
    return dealt.select("bucket", "guest", "key", "text", F.row_number().over(w).alias("row"), F.lead("text").over(w).alias("next_text")).where("not guest").drop("guest")


def compared(df: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of texts, their edited and their next texts.

    df: bucket, row (unique in the bucket), key, text, edited, next_text, partitioned by bucket.
    """
    d = df.select("*", paragraphs(F.col("text")).alias("a"), paragraphs(F.col("edited")).alias("e"), paragraphs(F.col("next_text")).alias("b"))
    d = d.select("*", sketch(F.col("a")).alias("sa"), sketch(F.col("e")).alias("se"), sketch(F.col("b")).alias("sb"))
    d = d.select("*", subtract(F.col("sa"), F.col("se")).alias("x0"), subtract(F.col("sa"), F.col("sb")).alias("x1"))
    d = d.select(
        "bucket", "row", "a", "e", "b",
        F.coalesce(F.size(peel(F.col("x0"))), F.lit(-1)).alias("d0"),
        F.coalesce(F.size(peel(F.col("x1"))), F.lit(-1)).alias("d1"),
        differing(F.col("x0"), F.size("a"), F.size("e")).alias("l0"),
        differing(F.col("x1"), F.size("a"), F.size("b")).alias("l1"),
        F.struct(
            F.col("key"), F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
            as_text(F.col("sa")).alias("fingerprint"), as_text(F.col("se")).alias("edited_fingerprint"),
            F.size("a").alias("na"), F.size("e").alias("ne"), F.size("b").alias("nb"),
        ).alias("meta"),
    )

    def side(pair: int, which: int, column: str) -> Column:
        doublings = F.ceil(F.log2(F.col(f"l{pair}") / F.lit(float(LOAD)))).cast("int")
        blocks = F.call_function("shiftleft", F.lit(1), doublings)
        entry = lambda x: F.struct(F.lit(pair).alias("pair"), F.pmod(F.shiftrightunsigned(x, 24), blocks).cast("int").alias("block"), F.lit(which).alias("which"), x.alias("digest"))
        return F.when(F.col(f"d{pair}") < 0, F.transform(column, entry)).otherwise(F.array())

    none = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(0).alias("block"), F.lit(0).alias("which"), F.lit(None).cast("long").alias("digest")))
    entries = F.concat(none, side(0, 0, "a"), side(0, 1, "e"), side(1, 0, "a"), side(1, 1, "b"))
    d = d.select("bucket", "row", "d0", "d1", "meta", F.explode(entries).alias("x"))
    meta = F.when(F.col("x.pair") < 0, F.struct("meta.*", "d0", "d1"))
    d = d.select("bucket", "row", meta.alias("meta"), "x.*")
    blocks = d.groupBy("bucket", "row", "pair", "block").agg(
        F.first("meta", ignorenulls=True).alias("meta"),
        F.collect_list(F.when(F.col("which") == 0, F.col("digest"))).alias("left"),
        F.collect_list(F.when(F.col("which") == 1, F.col("digest"))).alias("right"),
    )
    recovered = F.when(F.col("pair") >= 0, F.size(recover(F.col("left"), F.col("right"))))
    blocks = blocks.select("bucket", "row", "pair", "meta", recovered.alias("n"))
    whole = blocks.groupBy("bucket", "row").agg(
        F.first("meta", ignorenulls=True).alias("m"),
        F.sum(F.when(F.col("pair") == 0, F.col("n"))).alias("n0"),
        F.sum(F.when(F.col("pair") == 1, F.col("n"))).alias("n1"),
    )

    def likeness(tried: str, later: str, other: str) -> Column:
        differ = F.when(F.col(f"m.{tried}") >= 0, F.col(f"m.{tried}").cast("long")).otherwise(F.col(later))
        both = F.col("m.na") + F.col(f"m.{other}")
        return F.when(both + differ == 0, F.lit(1.0)).otherwise((both - differ) / (both + differ))

    return whole.select(
        F.col("m.key").alias("key"), "m.n_chars", "m.edited_sha256", "m.fingerprint", "m.edited_fingerprint",
        likeness("d0", "n0", "ne").alias("near_edited"), likeness("d1", "n1", "nb").alias("near_next"),
    )


def fingerprints(chain: DataFrame) -> DataFrame:
    """chain: rows of with_next(). The edited text swaps the last quarter for the next text's start."""
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    return compared(chain.select("*", edited.alias("edited"))).withColumnRenamed("key", "doc_id")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return fingerprints(with_next(docs, "doc_id", "text"))
