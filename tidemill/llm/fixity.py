"""Merkle fixity audit of WARC replicas.

``laid_out`` gives each record its place: a volume holds the records of 2**VOLUME_BITS ids in their
order, and a record's range of byte offsets follows from the lengths before it. A replica is a table
of records with the places that its own index states. Each record is hashed where it is read; its
leaf covers volume, offset, length and content. The leaves whose records begin in one range of
2**RANGE_BITS offsets are hashed together in order, FANOUT ranges make a node of the next level, up to a
root for each volume, and FANOUT volumes make a node, up to one root for each replica. The audit compares the
roots and then descends: of each level only the children of differing nodes are compared, down
to the records that are changed, moved, missing or extra.

Defined cases: null url or html is empty; rows with one id and place (repeated rows) are one leaf,
whose digest does not depend on their order; a null id is a record like others, in a volume of its
own; ids may be negative; a replica without places (null volume or offset) has its records in one
range at the start; empty replicas agree; a very long page is hashed in one task and only its digest is moved;
other columns are ignored, whatever their names. Nothing but the highest places reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import stable, table

#: Bits of the fan-out of the tree, of the ids in a volume, and of the offsets in a leaf's range.
FANOUT_BITS, VOLUME_BITS, RANGE_BITS = 4, 12, 16
NO_ID = -(1 << 62)
PLACE = ("volume", "offset", "length")


def record(url: Column, html: Column) -> Column:
    """Bytes of a response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "))
    return F.concat(head, F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _id() -> Column:
    return F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID))


def places(pages: DataFrame) -> DataFrame:
    """id, volume, offset, length: the place of each id's record, from lengths alone.

    Repeated rows lie one behind the other and are stated at the first one's offset.
    """
    size = F.octet_length(record(F.col("url"), F.col("html"))).cast("long")
    one = pages.select(_id().alias("id"), size.alias("length")).groupBy("id").agg(F.sum("length").alias("length"))
    before = Window.partitionBy("volume").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("volume", F.shiftright("id", VOLUME_BITS)).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select("id", *PLACE)


def laid_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the place of the record: volume, offset, length."""
    return pages.select("page_id", "url", "html", _id().alias("id")).join(places(pages), "id").drop("id")


def hashed(pages: DataFrame) -> DataFrame:
    """page_id, sha and the place, if pages states one: records hashed where they are read, without their content."""
    return pages.select("page_id", F.sha2(record(F.col("url"), F.col("html")), 256).alias("sha"), *[c for c in PLACE if c in pages.columns])


def leaves(replica: DataFrame) -> DataFrame:
    """id, volume, offset, length, digest: a row for each record. Only digests and places are shuffled."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    read = replica if "sha" in replica.columns else hashed(replica)
    hashes = read.select(_id().alias("id"), number("volume").alias("volume"), F.greatest(number("offset"), F.lit(0)).alias("offset"), number("length").alias("length"), "sha")
    part = lambda k: F.sum(F.conv(F.substring("sha", k, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    content = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[part(k) for k in (1, 16, 31, 46)]), 256)
    one = hashes.groupBy("id", *PLACE).agg(content.alias("content"))
    return one.withColumn("digest", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in ("id", *PLACE)], "content"), 256))


def _hashed(nodes: DataFrame, order: tuple[str, ...], *by: Column) -> DataFrame:
    """Nodes of one parent hashed together in their order, each with its place."""
    line = F.struct(*order, "digest")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.concat_ws(":", *[x[c].cast("string") for c in order], x["digest"])), ",")
    return nodes.groupBy(*by).agg(F.sha2(joined, 256).alias("digest"))


def tree(leaf: DataFrame, base: int, range_levels: int, volume_levels: int) -> list[DataFrame]:
    """The levels above the leaves, from ranges of offsets to the root; ``base`` is the lowest volume."""
    out = [stable(_hashed(leaf.withColumn("v", F.col("volume") - base), ("offset", "id", "length"), F.col("v"), F.shiftright("offset", RANGE_BITS).alias("k")))]
    for _ in range(range_levels):
        out.append(stable(_hashed(out[-1].withColumn("at", F.col("k")), ("at",), F.col("v"), F.shiftright("k", FANOUT_BITS).alias("k"))))
    for _ in range(volume_levels):
        out.append(stable(_hashed(out[-1].withColumn("at", F.col("v")), ("at",), F.shiftright("v", FANOUT_BITS).alias("v"), F.col("k"))))
    return out


def differing(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys whose digests differ or that one side lacks."""
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in (*keys, "digest")])
    same = [F.col(c) == F.col(f"b_{c}") for c in keys]
    both = a.select(*keys, "digest").join(right, same, "full_outer")
    return both.filter(~F.col("digest").eqNullSafe(F.col("b_digest"))).select(*[F.coalesce(c, f"b_{c}").alias(c) for c in keys])


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """page_id, kind, volume, offset, length of the records that differ between two replicas.

    kind: changed (other content at its place), moved (its content elsewhere), missing and extra (in
    the first or the second alone). The place is that in the first replica, of an extra one in the second.
    """
    leaf = [stable(leaves(x)) for x in (first, second)]
    ends = leaf[0].select("volume", "offset").union(leaf[1].select("volume", "offset")).agg(F.min("volume"), F.max("volume"), F.max("offset")).first()
    base, volumes, ranges = ends[0] or 0, (ends[1] or 0) - (ends[0] or 0), (ends[2] or 0) >> RANGE_BITS
    levels = [-(-n.bit_length() // FANOUT_BITS) for n in (ranges, volumes)]
    trees = [tree(x, base, *levels) for x in leaf]
    bad = differing(trees[0][-1], trees[1][-1], ("v", "k"))
    for up, (a, b) in enumerate(list(zip(*trees, strict=True))[-2::-1]):
        of_volume = up < levels[1]
        parent = [F.shiftright("v", FANOUT_BITS), F.col("k")] if of_volume else [F.col("v"), F.shiftright("k", FANOUT_BITS)]
        above = bad.select(F.col("v").alias("up_v"), F.col("k").alias("up_k"))
        a, b = (x.join(above, (parent[0] == F.col("up_v")) & (parent[1] == F.col("up_k")), "left_semi") for x in (a, b))
        bad = stable(differing(a, b, ("v", "k")))
    above = bad.select((F.col("v") + base).alias("up_v"), F.col("k").alias("up_k"))
    held = [x.join(above, (F.col("volume") == F.col("up_v")) & (F.shiftright("offset", RANGE_BITS) == F.col("up_k")), "left_semi") for x in leaf]
    keys = ("id", *PLACE)
    wrong = stable(differing(*held, keys))
    one, two = (x.join(wrong, list(keys), "left_semi").select("id", F.struct(*PLACE).alias(n), F.col("content").alias(f"{n}_content")) for x, n in zip(held, ("one", "two"), strict=True))
    both = one.join(two, "id", "full_outer")
    kind = F.when(F.col("two").isNull(), "missing").when(F.col("one").isNull(), "extra").when(F.col("one_content") == F.col("two_content"), "moved").otherwise("changed")
    at = F.coalesce("one", "two")
    return both.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("page_id"), kind.alias("kind"), *[at[c].alias(c) for c in PLACE])


def _mark() -> Column:
    return F.crc32(F.col("page_id").cast("string")) % 1000


def overwritten(pages: DataFrame) -> DataFrame:
    """Known damage to contents: of 1,000 records about 5 are lost and 20 end in another character, by a hash of the id."""
    kept = pages.filter(F.coalesce(~_mark().between(500, 504), F.lit(True)))
    return kept.withColumn("html", F.when(_mark() < 20, F.concat(F.substring("html", F.lit(1), F.length("html") - 1), F.lit("~"))).otherwise(F.col("html")))


def displaced(records: DataFrame) -> DataFrame:
    """Known damage to an index: of 1,000 records about 3 are stated one byte behind their place."""
    return records.withColumn("offset", F.when(_mark().between(800, 802), F.col("offset") + 1).otherwise(F.col("offset")))


def op6_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pages table, laid out in volumes, against a replica with known damage and a copy of its index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    index = stable(places(pages))

    def replica(rows: DataFrame) -> DataFrame:
        return hashed(rows).withColumn("id", _id()).join(index, "id").drop("id")

    return audit(replica(pages), displaced(replica(overwritten(pages))))
