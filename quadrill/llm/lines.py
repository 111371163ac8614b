"""Removal of multi-line chunks that repeat over a whole corpus.

Only DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrill.llm.store import bucketed, materialise, spare_name

#: Where a text is cut into lines: after line ends, and after the sentences of long lines.
LINE_END, SENTENCE_END = r"(?<=\n)(?![\r\n])", r"(?<=[.!?] )(?=\S)"
#: One pair of lines in DIVISOR, about, ends a chunk.
DIVISOR = 4


def _lines(text: str, sentences: bool) -> str:
    """SQL for the lines of a text, each with the white space that ends it."""
    # The first test alone sends the matcher on from most characters.
    cut = rf"(?<=[\n ])(?:{LINE_END}|{SENTENCE_END})" if sentences else LINE_END
    return f"split(coalesce({text}, ''), r'{cut}')"


def _bare(line: str) -> str:
    return rf"rtrim(' \n\r\t', {line})"


#: A rolling hash over line hashes ``a``: of every two lines that follow each other.
ROLLING = "zip_with(slice(a, 1, greatest(size(a) - 1, 0)), slice(a, 2, greatest(size(a) - 1, 0)), (x, y) -> xxhash64(x, y))"


def chunks(hashed: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, row, s, n, h): the chunks of n lines from line s (from 0), boundary to boundary.

    A boundary follows the second line of a pair whose rolling hash is a multiple
    of ``divisor``, unless the pair before it is one too. So it depends on three
    lines alone and an insertion elsewhere shifts nothing, and chunks have two
    lines at least (a last single line is no chunk).
    """
    rolled = hashed.withColumn("r", F.expr(ROLLING))
    first = f"pmod(x, {divisor}) = 0 AND (i = 0 OR pmod(get(r, i - 1), {divisor}) <> 0) AND i + 2 < size(a)"
    cut = rolled.withColumn("cuts", F.expr(f"filter(transform(r, (x, i) -> IF({first}, i + 2, -1)), c -> c > 0)"))
    found = cut.withColumn("found", F.expr("filter(zip_with(concat(array(0), cuts), concat(cuts, array(size(a))), (s, e) -> struct(s AS s, e - s AS n)), c -> c.n > 1)"))
    return found.select("id", "row", F.expr("inline(transform(found, c -> struct(c.s AS s, c.n AS n, xxhash64(slice(a, c.s + 1, c.n)) AS h)))"))


def pairs(hashed: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, row, s, n, h): the smallest chunks, two lines each, that do not lie within one that is ``gone``."""
    spans = gone.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))
    left = hashed.join(spans.hint("shuffle_hash"), "row", "left").withColumn("spans", F.expr("coalesce(spans, CAST(array() AS array<struct<s: int, e: int>>))"))
    from_to = "zip_with(concat(array(0), transform(spans, x -> x.e - 1)), concat(transform(spans, x -> x.s - 1), array(size(a) - 2)), (f, t) -> IF(f <= t, sequence(f, t), CAST(array() AS array<int>)))"
    return left.select("id", "row", F.expr(f"inline(transform(flatten({from_to}), i -> struct(i AS s, 2 AS n, xxhash64(get(a, i), get(a, i + 1)) AS h)))"))


def repeated(occurrences: DataFrame) -> DataFrame:
    """Those whose hash occurs more than once; counts are added up before they are shuffled.

    The counts are written: only joins of two plain shuffles can be split where
    a hash is frequent.
    """
    times = materialise(occurrences.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "repeated-hashes")
    return occurrences.join(times.hint("shuffle_hash"), "h")


AT = ("id", "row", "s")


def _span():
    return "row", "s", (F.col("s") + F.col("n")).alias("e")


def later(found: DataFrame) -> DataFrame:
    """(row, s, e): those of ``found`` whose hash occurs earlier, by (id, row, s)."""
    firsts = materialise(found.groupBy("h").agg(F.min(F.struct(*AT)).alias("first")), "first-places")
    return found.join(firsts.hint("shuffle_hash"), "h").where(F.struct(*AT) != F.col("first")).select(*_span())


def with_bytes(found: DataFrame, texts: DataFrame, text: str, sentences: bool) -> DataFrame:
    """``found`` with the bytes of each chunk."""
    lists = found.groupBy("row").agg(F.first("id").alias("id"), F.collect_list(F.struct("h", "s", "n")).alias("found"))
    joined = texts.select("row", text).join(lists.hint("shuffle_hash"), "row")
    # One-element array: the only way to name the lines inside an expression.
    each = f"inline(flatten(transform(array(transform({_lines(text, sentences)}, l -> {_bare('l')})), a -> transform(found, c -> struct(c.h AS h, c.s AS s, c.n AS n, array_join(slice(a, c.s + 1, c.n), '\\n') AS bytes)))))"
    return joined.select("id", "row", F.expr(each))


def unlike(compared: DataFrame) -> DataFrame:
    """(h): hashes whose chunks differ in their bytes, practically none."""
    return compared.select("h", "bytes").distinct().groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")


def later_by_bytes(found: DataFrame, texts: DataFrame, text: str, sentences: bool) -> DataFrame:
    """``later`` where two texts share a hash: chunks of such hashes are told apart by their bytes."""
    compared = with_bytes(found, texts, text, sentences)
    odd = compared.join(unlike(compared), "h", "left_semi")
    firsts = odd.groupBy("h", "bytes").agg(F.min(F.struct(*AT)).alias("first"))
    told = odd.join(firsts, ["h", "bytes"]).where(F.struct(*AT) != F.col("first")).select(*_span())
    return later(found.join(unlike(compared), "h", "left_anti")).unionByName(told)


def _spans(gone: DataFrame) -> DataFrame:
    """(row, spans): each row's intervals, merged and in order."""
    before = Window.partitionBy("row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    begins = gone.withColumn("new", F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1)))
    parts = begins.withColumn("part", F.sum("new").over(Window.partitionBy("row").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("row", "part").agg(F.min("s").alias("s"), F.max("e").alias("e")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: bool = True, divisor: int = DIVISOR) -> DataFrame:
    """``docs`` with a new text each, and a column n_removed: how many lines went.

    Lines end at line ends and, unless ``sentences`` is false, at sentence ends;
    they are compared without the white space that ends them. Chunks are of two
    sizes. The large ones run from one content-defined boundary to the next and
    take away most of what repeats. What they leave, the edges of repeated
    passages and passages too short to hold a boundary, is chunked again as
    finely as can be, two lines at every line. Of a chunk that repeats anywhere,
    within a text or across texts, the first occurrence stays, by document id,
    row and place; all others go, once their bytes have been compared. So every
    run of two or more lines that has occurred before goes, each line of it
    stays somewhere, and a single line that repeats by itself stays.

    A null text stays null. Each row is a document: one that repeats another
    loses what it repeats. An empty table gives no rows. Columns that ``docs``
    has stay, whatever their names and types.

    The rows are numbered and written once, dealt by their number, so that texts
    are shuffled once and joined by it without a further shuffle. A chunk that very
    many documents hold is added up before any shuffle, and the join that finds
    its occurrences is followed by one, so that the adaptive planner can split it.
    """
    names, n_removed = docs.columns, spare_name(docs, "n_removed")
    named = [f"c{k}" for k in range(len(names))]
    own = named[names.index(text)]
    texts = bucketed(docs.toDF(*named).withColumn("row", F.monotonically_increasing_id()), "row", "numbered")
    hashes = f"transform({_lines(own, sentences)}, l -> xxhash64({_bare('l')}))"
    hashed = materialise(texts.select(F.col(named[names.index(doc_id)]).alias("id"), "row", F.expr(hashes).alias("a")), "line-hashes")

    large = materialise(repeated(chunks(hashed, divisor)), "repeated-chunks")
    gone = materialise(later(large), "gone")
    small = materialise(repeated(pairs(hashed, gone)), "repeated-pairs")
    # The bytes of all are compared in one pass. Should two texts share a hash, both sizes are told apart anew.
    if unlike(with_bytes(large.unionByName(small), texts, own, sentences)).take(1):
        gone = materialise(later_by_bytes(large, texts, own, sentences), "gone")
        small = materialise(repeated(pairs(hashed, gone)), "repeated-pairs")
        all_gone = gone.unionByName(later_by_bytes(small, texts, own, sentences))
    else:
        all_gone = gone.unionByName(later(small))

    out = texts.join(_spans(all_gone).hint("shuffle_hash"), "row", "left")
    between = "zip_with(concat(array(0), transform(spans, x -> x.e)), concat(transform(spans, x -> x.s), array(size(l))), (f, t) -> slice(l, f + 1, t - f))"
    kept = F.expr(f"array_join(flatten(transform(array({_lines(own, sentences)}), l -> flatten({between}))), '')")
    removed = F.coalesce(F.expr("aggregate(spans, 0, (n, x) -> n + x.e - x.s)"), F.lit(0))
    new = {c: F.col(c) for c in named} | {own: F.when(F.col("spans").isNull(), F.col(own)).otherwise(kept)}
    return out.select(*(x.alias(n) for n, x in zip(names, new.values(), strict=True)), removed.alias(n_removed))
