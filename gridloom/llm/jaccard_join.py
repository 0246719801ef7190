"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, text_or_empty
from gridloom.llm.components import connected_components
from gridloom.llm.occurrences import bit_at, occurrence_bitmaps
from gridloom.llm.words import digest, hash_words, shingle_set

#: A shingle in this many documents or more comes last in the order of prefixes.
HEAVY = 32
#: Rows of one shingle that a task pairs; longer lists are dealt to several tasks.
LIST_ROWS = 20_000


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    h, o = hash_words([(t or "").encode("utf-8", "replace").lower() for t in texts])
    return [shingle_set(h[o[i] : o[i + 1]], n) for i in range(len(texts))]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, class_key[, row_col]: documents linked when 100 * intersection >= percent * union.

    Sets are the distinct n-word shingles (64-bit hashes) of lower-cased whole texts; sets and groups
    are told apart by 128-bit digests. The order of
    prefixes is: shingles of one document, shared ones, heavy ones; it comes from counts over the
    whole corpus. Documents with the same prefix and set size form one group. Two linked sets share a
    prefix shingle, so:

    1. group pairs: in the list of every shared prefix shingle all groups are paired with the
       list's pivot, the group with the fewest shingles before it; size and position filters apply.
       Groups expand to members (classes of equal sets), which are verified on their whole texts;
    2. the links so far give components. Members of one component need no further comparison;
       within each list the members outside the pivot's component are paired with the members of
       other components whose size allows a link, filtered and verified in the same way. Lists are
       joined by size band, and long ones are dealt to several tasks.

    So every pair of the join is verified or already connected, and large groups of near copies
    cost a star, not all pairs. Equal sets are collapsed before any pair is made. Exchanges carry
    shared prefix shingles and the texts of candidates only.

    Null and wordless texts have an empty set and link to nothing. Repeated rows and null ids are
    kept (a null id never is a component's name unless alone); an empty table gives an empty
    result; other columns are not read. ``class_key`` is one value per component, null for empty
    sets; ``row_col`` names a row key (long) to pass on.
    """
    spark = docs.sparkSession
    row = F.col(row_col).cast("long") if row_col else F.lit(None).cast("long")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), row.alias("row"), text_or_empty(text_col).alias("text"))

    def tokens(rows: pa.RecordBatch, seen: set) -> tuple[np.ndarray]:
        out = []
        for s in _sets(rows["text"].to_pylist(), n):
            if len(s):
                d = digest(s)
                if d not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(d)
                    out.append(s)
        return (np.concatenate(out) if out else np.zeros(0, np.uint64),)

    shared, heavy = (spark.sparkContext.broadcast(m) for m in occurrence_bitmaps(base.select("text"), tokens, ((0, 2), (0, HEAVY)), F.octet_length("text") / 6))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        had: set[bytes] = set()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                size, cid, gid, toks, poss, kept = [], [], [], [], [], []
                texts = part["text"].to_pylist()
                for s, text in zip(_sets(texts, n), texts, strict=True):
                    k = len(s)
                    size.append(k)
                    if not k:
                        cid.append(b""), gid.append(b""), toks.append([]), poss.append([]), kept.append(None)
                        continue
                    cid.append(digest(s))
                    many = bit_at(shared.value, s)
                    rank = many.astype(np.int8) + (many & bit_at(heavy.value, s))
                    prefix = np.argsort(rank, kind="stable")[: k - -(-percent * k // 100) + 1]
                    gid.append(digest(np.concatenate([s[prefix], np.array([k], np.uint64)])))
                    at_ = np.flatnonzero(rank[prefix] > 0)
                    kept.append(text if len(at_) and cid[-1] not in had else None)
                    if len(had) > 2_000_000:
                        had.clear()
                    had.add(cid[-1])
                    if gid[-1] in seen:
                        toks.append([]), poss.append([])
                    else:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        seen.add(gid[-1])
                        toks.append(_signed(s[prefix][at_])), poss.append(at_ + 1)
                cols = [part["doc_id"], part["row"], pa.array(size, pa.int64()), pa.array(cid, pa.binary()), pa.array(gid, pa.binary()), pa.array(toks, pa.list_(pa.int64())), pa.array(poss, pa.list_(pa.int32())), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "row", "n", "cid", "gid", "toks", "poss", "text"])

    members = materialize(
        base.mapInArrow(prefixes, "doc_id long, row long, n long, cid binary, gid binary, toks array<long>, poss array<int>, text string"),
        "prefixes",
    )
    classes = members.where("n > 0").groupBy("cid", "gid", "n").agg(F.min("doc_id").alias("rep_id"))
    classes = materialize(classes, "classes")
    texts = members.where("text is not null").select("cid", "text")
    lists = (
        members.where(F.size("toks") > 0)
        .select("gid", "n", F.explode(F.arrays_zip("toks", "poss")).alias("x"))
        .select(F.col("x.toks").alias("token"), F.col("x.poss").cast("long").alias("pos"), "n", "gid")
        .repartition("token")
        .dropDuplicates(["token", "gid", "n", "pos"])
    )

    def may_link(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
        """Size filter, and the bound that prefix positions leave for the intersection."""
        size = (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
        return size & ((F.least(n1 - p1, n2 - p2) + 1) * (100 + percent) >= (n1 + n2) * percent)

    # 1: stars of group pairs
    pivots = lists.groupBy("token").agg(F.min(F.struct("pos", "n", "gid")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select("token", "p")
    starred = lists.join(pivots, "token").where(F.col("gid") != F.col("p.gid"))
    starred = starred.where(may_link(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos")))
    group_pairs = starred.select(F.col("p.gid").alias("ga"), F.col("gid").alias("gb")).distinct()
    pivot_member = classes.groupBy("gid").agg(F.min("cid").alias("first"), F.count(F.lit(1)).alias("c"))
    inside = classes.join(pivot_member.where("c > 1"), "gid").where("cid <> first").select(F.col("first").alias("a"), F.col("cid").alias("b"))
    across = (
        group_pairs.join(pivot_member.select(F.col("gid").alias("ga"), F.col("first").alias("a")), "ga")
        .join(classes.select(F.col("gid").alias("gb"), F.col("cid").alias("b")), "gb")
        .select("a", "b")
    )
    once = materialize(_ordered(inside.unionByName(across)), "pairs")
    links = materialize(_verify(texts, once, n, percent), "linked")
    found = connected_components(links)

    # 2: what the stars left open
    placed = lists.join(classes.select("gid", "cid"), "gid").join(found.select(F.col("id").alias("cid"), F.col("component").alias("k")), "cid", "left")
    placed = materialize(placed.select("token", "pos", "n", "cid", F.coalesce("k", "cid").alias("k")), "placed")
    mixed = placed.groupBy("token").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min(F.struct("pos", "n", "cid", "k")).alias("p"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    mixed = mixed.select("token", F.col("p.k").alias("main"), F.ceil(F.col("c") / LIST_ROWS).cast("int").alias("salts"))
    # sizes of linked sets differ by a factor of 100 / percent at most, so their bands by one
    open_ = placed.join(mixed, "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent + 1e-9)) if percent < 100 else F.col("n"))
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int"))
    rest = open_.where("k <> main").select("token", F.col("pos").alias("pos2"), F.col("n").alias("n2"), F.col("cid").alias("cid2"), F.col("k").alias("k2"), F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "salts")
    rest = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    cond = (F.col("k") != F.col("k2")) & ((F.col("k") == F.col("main")) | (F.col("cid") < F.col("cid2")))
    left = open_.join(rest, ["token", "band", "salt"]).where(cond & may_link(F.col("n"), F.col("pos"), F.col("n2"), F.col("pos2")))
    again = _ordered(left.select(F.col("cid").alias("a"), F.col("cid2").alias("b"))).join(once, ["a", "b"], "left_anti")
    again = materialize(again, "pairs")
    if not again.isEmpty():
        more = materialize(_verify(texts, again, n, percent), "linked")
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))

    nodes = classes.select("cid", "rep_id").join(found.select(F.col("id").alias("cid"), F.col("component").alias("k")), "cid", "left").select("cid", "rep_id", F.coalesce("k", "cid").alias("k"))
    names = nodes.groupBy("k").agg(F.min("rep_id").alias("component_id"))
    label = nodes.join(names, "k").select("cid", "component_id", "k")
    out = members.select("doc_id", "row", "n", "cid").join(label, "cid", "left")
    some = F.col("n") > 0
    cols = ["doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("k")).alias("class_key")]
    return out.select(*cols, *([F.col("row").alias(row_col)] if row_col else []))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of classes whose whole texts have the similarity; one text per class is fetched."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    texts = materialize(texts.join(wanted, "cid", "left_semi").groupBy("cid").agg(F.max("text").alias("text")), "texts")
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts = {}
                for key, col in (("a", "ta"), ("b", "tb")):
                    texts.update(zip(part[key].to_pylist(), part[col].to_pylist(), strict=True))
                sets = dict(zip(texts, _sets(list(texts.values()), n), strict=True))
                good = []
                for i, (x, y) in enumerate(zip(part["a"].to_pylist(), part["b"].to_pylist(), strict=True)):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        good.append(i)
                yield pa.RecordBatch.from_arrays([part["a"].take(pa.array(good, pa.int64())), part["b"].take(pa.array(good, pa.int64()))], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a binary, b binary")
