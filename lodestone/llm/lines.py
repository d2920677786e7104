"""Line dedup by an edit join over segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import broadcast_below, checkpoint, discard, read_table

#: Lines link at one edit for each PER_EDIT code points of the shorter one, a twentieth of it, and EDITS at most.
EDITS, PER_EDIT = 2, 20
#: Letters whose numbers, modulo 4, are compared before two lines are: an edit changes two of them by one at most.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def segment(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Start, from 1, and length of the i-th of the even parts of a line of this length; the last ones are the longer."""
    short, long = F.floor(length / parts), F.pmod(length, F.lit(parts))
    start = short * i + F.greatest(F.lit(0), long - (parts - i)) + 1
    return start.cast("int"), (short + F.when(long >= parts - i, 1).otherwise(0)).cast("int")


def allowed(length: Column, edits: int, per_edit: int) -> Column:
    """Edits at which a line of this length links with a longer one."""
    return F.least(F.floor(length / per_edit), F.lit(edits)).cast("int")


def probes(line: Column, length: Column, edits: int, per_edit: int) -> Column:
    """(key, own) of every substring that can equal a segment of a line that is no longer; none for lines of no edits.

    Of n + 1 segments of a line that links at n edits, one is untouched in the longer line. The i-th can lie only where
    the edits before it and after it leave it. own: the substring is the line's own segment.
    """

    def within(n: int, less: int) -> list[Column]:
        out = []
        for i in range(n + 1):
            start, size = segment(length - less, i, n + 1)
            for shift in range(max(-i, less - (n - i)), min(i, less + (n - i)) + 1):
                key = F.xxhash64(length - less, F.lit(i), F.substring(line, start + shift, size))
                out.append(F.struct(key.alias("key"), F.lit(less == 0 and shift == 0).alias("own")))
        return out

    every = F.array(*(p for less in range(edits + 1) for p in within(edits, less)))
    # Near the lengths where the allowance changes it depends on how much shorter the other line is.
    some = F.array(*(F.when(allowed(length - less, edits, per_edit) == n, p) for n in range(1, edits + 1) for less in range(n + 1) for p in within(n, less)))
    some = F.filter(some, lambda p: p.isNotNull())
    return F.when(length - edits >= edits * per_edit, every).when(length >= per_edit, some)


def letter_counts(line: Column) -> Column:
    total = F.lit(0).cast("bigint")
    for i, c in enumerate(LETTERS):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))
        total = total + F.shiftleft(F.pmod(n, F.lit(4)).cast("bigint"), 2 * i)
    return total


def counts_apart(a: Column, b: Column) -> Column:
    """A lower bound of the sum of differences of two lines' letter counts."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = F.pmod((F.shiftright(a, 2 * i).bitwiseAND(F.lit(3)) - F.shiftright(b, 2 * i).bitwiseAND(F.lit(3))).cast("int"), F.lit(4))
        total = total + F.least(d, 4 - d)
    return total


def pair_bits(line: Column) -> Column:
    """64 parities of hashed pairs of neighbouring characters: an edit changes four of them at most."""
    flip = lambda x, i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(F.get(x, i), F.get(x, i + 1)), F.lit(64)).cast("int"))
    walk = lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x) - 2), F.lit(0).cast("bigint"), lambda s, i: s.bitwiseXOR(flip(x, i)))
    return F.transform(F.array(F.split(line, "")), walk)[0]


def near_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two lines of code points, exact up to `edits`. Bit-parallel, in a band of the matrix.

    a is no shorter than b, and b is longer than edits. One step for each code point of b keeps the vertical differences
    of 2 * edits + 1 rows about the diagonal as bits. Arrays and steps' results are bound as variables of lambdas, so
    that no rewriting of the plan computes them more than once.
    """
    width = 2 * edits + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    big = lambda v: F.lit(v).cast("bigint")
    bind = lambda value, f: F.transform(F.array(value), f)[0]

    def step(e: Column, st: Column, j: Column) -> Column:
        match = big(0)
        for k in range(width):
            same = F.coalesce(F.get(e["x"], j - edits + k) == F.get(e["y"], j), F.lit(False))
            match = match.bitwiseOR(F.when(same, big(1 << k)).otherwise(big(0)))
        vp, vn = st["vp"], st["vn"]
        d0 = lambda eq: ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        return bind(match, lambda eq: bind(d0(eq), lambda d: finish(e, st, d, j)))

    def finish(e: Column, st: Column, d0: Column, j: Column) -> Column:
        vp, vn = st["vp"], st["vn"]
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(mask)))
        hn = d0.bitwiseAND(vp)
        diagonal = j < e["m"] - edits
        down = F.when(d0.bitwiseAND(F.lit(top)) != 0, 0).otherwise(1)
        bit = lambda h: F.call_function("shiftrightunsigned", h, width - 2 - st["s"]).bitwiseAND(F.lit(1))
        dist = st["d"] + F.when(diagonal, down).otherwise((bit(hp) - bit(hn)).cast("int"))
        moved = F.shiftrightunsigned(d0, 1)
        vp2 = hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(F.lit(mask)))
        return F.struct(vp2.alias("vp"), moved.bitwiseAND(hp).alias("vn"), dist.alias("d"), (st["s"] + F.when(diagonal, 0).otherwise(1)).alias("s"))

    first = F.struct(big(mask ^ ((1 << edits) - 1)).alias("vp"), big(0).alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("s"))
    both = F.struct(F.length(a).alias("m"), F.split(a, "").alias("x"), F.split(b, "").alias("y"))
    walk = lambda e: F.aggregate(F.sequence(F.lit(0), F.size(e["y"]) - 1), first, lambda st, j: step(e, st, j), lambda st: st["d"])
    return bind(both, walk)


def verified(pairs: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """Rows of (a, b, longer, shorter, ...) whose lines link; both have per_edit code points at least."""
    n = allowed(F.length("shorter"), edits, per_edit)
    near_length = F.length("longer") - F.length("shorter") <= n
    return pairs.where(F.when(near_length, near_distance(F.col("longer"), F.col("shorter"), edits) <= n).otherwise(False))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, line) of all lines with a word; n counts all lines from 0."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(doc_id, text_hash, gone, n_near): numbers of the lines of each document that go, and how many for an edit only."""
    lines = line_table(docs)
    hashes = [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]
    place = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"), F.col("n").alias("n"))
    long = F.col("len") >= per_edit
    lines = lines.withColumn("len", F.length("line"))  # used often: a column of its own is computed once
    where = lines.select(*hashes, place.alias("place"), probes(F.col("line"), F.col("len"), edits, per_edit).alias("probes"))
    kinds = checkpoint(where.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.first("probes").alias("probes")))

    # Substrings that belong to different lines, and to one of them as a segment; all else ends here.
    keyed = kinds.where("probes is not null").select("h1", F.explode("probes").alias("p")).select("h1", "p.key", "p.own")
    over = "over (partition by key)"
    shared = keyed.selectExpr("*", f"min(h1) {over} as lo", f"max(h1) {over} as hi", f"max(own) {over} as some")
    shared = checkpoint(shared.where("lo <> hi and some").select("key", "h1", "own"))
    ids = checkpoint(shared.select(F.col("h1").alias("h")).distinct())
    wanted = lines.where(long).select(F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("h2"), "line").join(broadcast_below(ids), "h", "left_semi")
    bodies = wanted.groupBy("h", "h2").agg(F.first("line").alias("line"))
    bodies = checkpoint(bodies.select("h", "h2", "line", letter_counts(F.col("line")).alias("letters"), pair_bits(F.col("line")).alias("bits")))

    known = shared.join(bodies.select(F.col("h").alias("h1"), "letters", "bits"), "h1")
    s = known.select("key", F.col("h1").alias("a"), F.col("letters").alias("la"), F.col("bits").alias("ba"))
    r = known.where("own").select("key", F.col("h1").alias("b"), F.col("letters").alias("lb"), F.col("bits").alias("bb"))
    alike = (F.bit_count(F.col("ba").bitwiseXOR(F.col("bb"))) <= 4 * edits) & (counts_apart(F.col("la"), F.col("lb")) <= 2 * edits)
    met = s.join(r, (s.key == r.key) & (F.col("a") != F.col("b")) & alike)
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    one = bodies.select(F.col("h").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x_line"))
    two = bodies.select(F.col("h").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y_line"))
    facing = pairs.join(one, "a").join(two, "b")
    swap = F.length("x_line") < F.length("y_line")
    facing = facing.select("a", "a2", "b", "b2", F.when(swap, F.col("y_line")).otherwise(F.col("x_line")).alias("longer"), F.when(swap, F.col("x_line")).otherwise(F.col("y_line")).alias("shorter"))
    # Few rows and much work for each: dealt out by number, which no size estimate undoes.
    facing = facing.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "b")
    near = checkpoint(verified(facing, edits, per_edit).select("a", "a2", "b", "b2"))
    firsts = kinds.select("h1", "h2", "first")
    fa, fb = firsts.toDF("a", "a2", "fa"), firsts.toDF("b", "b2", "fb")
    late = near.join(fa, ["a", "a2"]).join(fb, ["b", "b2"]).select(F.when(F.col("fa") < F.col("fb"), F.struct(F.col("b").alias("h1"), F.col("b2").alias("h2"))).otherwise(F.struct(F.col("a").alias("h1"), F.col("a2").alias("h2"))).alias("e"))
    late = checkpoint(late.select("e.h1", "e.h2").distinct())
    marked = firsts.join(late.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
    seen = lines.select(*hashes, place.alias("place"), "doc_id", "text_hash", "n").join(marked, ["h1", "h2"])
    copy, near_only = F.col("place") != F.col("first"), F.col("near") & (F.col("place") == F.col("first"))
    gone = seen.where(copy | F.col("near")).groupBy("doc_id", "text_hash").agg(F.collect_set("n").alias("gone"), F.count(F.when(near_only, 1)).alias("n_near"))
    out = checkpoint(gone)
    discard(kinds, shared, ids, bodies, near, late)
    return out


def dedup_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then kept_text, n_lines, n_removed, n_near for every row.

    A line goes if it holds a word and an equal one, or one that links, stands earlier by doc_id and line number, whether
    that one goes itself or not. Two lines link if the shorter has n * per_edit code points or more and they are within
    n edits, for an n from 1 to `edits`. Lines without a word stay. n_near counts lines that go though no equal line is
    before them. Null texts are empty. Rows without doc_id come first, by a hash of their text. Repeated rows are one
    document and give equal rows. No rows give no rows. Columns of `keep` may have any names but those four.
    """
    gone = repeated_lines(docs, edits, per_edit).toDF("_d", "_t", "_gone", "_near")
    base = docs.select(*keep, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), F.coalesce("text", F.lit("")).alias("_text"))
    out = base.join(broadcast_below(gone), F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_t")), "left")
    out = out.select(*keep, F.split("_text", "\n").alias("_lines"), "_text", "_gone", "_near")
    left = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i)), "\n")
    zero = F.lit(0).cast("bigint")
    return out.select(*keep, F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(left).alias("kept_text"), F.size("_lines").cast("bigint").alias("n_lines"), F.coalesce(F.size("_gone").cast("bigint"), zero).alias("n_removed"), F.coalesce("_near", zero).alias("n_near"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents, the text that is left as its digest."""
    out = dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
