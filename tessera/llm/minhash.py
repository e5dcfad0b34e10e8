"""MinHash near-duplicates by a signature-coordinate inverted join.

Every text's set of word shingles gives a signature of ``COORDINATES`` minima.
Equal sets are one node.  A node is posted under its (coordinate, value) pairs;
values that occur once can't match.  With the rest sorted from rare to frequent,
two nodes that agree in ``MATCHES`` coordinates share one of the first
``m - MATCHES + 1`` of either (prefix), so frequent values are skipped in the
merge and only counted when a candidate's signatures are compared.  Candidates
that agree often enough are confirmed on the full sets.

Large groups aren't expanded into all pairs: in each round a posting list is tested
against two of its members; what is linked shares a component, and pairs inside a
component need no test.  What is left across components is tested in full: a text
against a component of some size meets the members in blocks of ``BLOCK``, compared as
matrices, and at most one link a (text, block) comes out.

The chance that a pair of similarity 0.8 agrees in fewer than 35 of 64 coordinates
is about 1e-6.

Joins on keys that may hold a third of all rows (component, coordinate value, set)
broadcast the narrow other side of the most frequent keys and exchange the rest.

Defined cases: null and empty texts have an empty set and are linked with nothing;
a text with fewer words than a shingle has its whole sequence as one; repeated rows
and equal sets are linked; rows with null ids link others but are never a smallest
id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import HEAVY, frequent, map_batches, record, saved, scratch, spread_join, table
from tessera.llm.text import U64, Texts, mix, ngrams, owners, pieces

COORDINATES, MATCHES = 64, 35
_rng = np.random.default_rng(97)
_MUL = _rng.integers(1, 2**31, 512, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, 512, dtype=np.uint32)
#: Members of a component in one block, and their shingles; components of up to FEW members are tested pair by pair.
BLOCK, FEW = 256, 4
BLOCK_ITEMS = 1 << 19
#: Bits of the fixed-size filter of candidate texts.
FILTER_BITS = 1 << 24


def shingles(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes document by document, and their offsets (docs + 1)."""
    starts, ends, woffs = t.words()
    h = t.hashes(starts, ends)
    own = owners(woffs)
    g = ngrams(h, n)
    at = np.flatnonzero(np.arange(len(g)) + n <= woffs[own[: len(g)] + 1])
    g, own = g[at], own[at]
    size = np.diff(woffs)
    for d in np.flatnonzero((size > 0) & (size < n)).tolist():
        g = np.append(g, mix(ngrams(h[woffs[d] : woffs[d + 1]], int(size[d])) ^ U64(size[d])))
        own = np.append(own, d)
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(t.n + 1))


def sketch(g: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature (docs x k, uint32) and set fingerprint of each document."""
    n = len(offs) - 1
    sig, node = np.zeros((n, k), np.uint32), np.zeros(n, np.uint64)
    has = np.flatnonzero(np.diff(offs))
    if len(has):
        x = (g >> U64(32)).astype(np.uint32)
        for i in range(k):
            y = x * _MUL[i] + _ADD[i]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x45D9F3B)
            y ^= y >> np.uint32(15)
            sig[has, i] = np.minimum.reduceat(y, offs[has])
        with np.errstate(over="ignore"):
            node[has] = mix(np.add.reduceat(mix(g ^ U64(0xA5A5A5A5)), offs[has]))
    return sig, node


def signatures(docs: DataFrame, n: int, k: int = COORDINATES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, node, sig, text_key`` of every row; node is the set's fingerprint, null for empty sets.

    ``text_key`` is a hash of the text, ``carry`` are columns of type long that go along.
    """

    def run(b: pa.RecordBatch):
        for lo, hi, t in pieces(b):
            g, offs = shingles(t, n)
            sig, node = sketch(g, offs, k)
            size = np.diff(offs).astype(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(t.n + 1, dtype=np.int32) * k), pa.array(sig.view(np.int32).ravel()))
            more = {c: b.column(c).slice(lo, hi - lo) for c in ("text_key", *carry)}
            yield record(doc_id=b.column("doc_id").slice(lo, hi - lo), n_shingles=size, node=pa.array(node.view(np.int64), mask=size == 0), sig=values, **more)

    schema = ", ".join(["doc_id long, n_shingles long, node long, sig array<int>, text_key long", *(f"{c} long" for c in carry)])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"), *carry), run, schema)


def postings(nodes: DataFrame, matches: int) -> DataFrame:
    """``tok, node``: each node under the rare (coordinate, value) pairs that it must share."""
    tok = nodes.select("node", F.posexplode("sig").alias("i", "v")).select("node", (F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF))).alias("tok"))
    shared = saved(tok.groupBy("tok").count().where("count > 1"))
    enough = (shared.agg(F.sum("count")).first()[0] or 0) / HEAVY
    most = [r.tok for r in shared.where(F.col("count") >= enough).orderBy(F.desc("count"), "tok").limit(HEAVY).collect()]
    lists = spread_join(tok, shared, "tok", most).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "tok"))).alias("t"))
    first = lists.where(F.size("t") >= matches).select("node", F.explode(F.slice("t", F.lit(1), F.size("t") - matches + 1)).alias("t"))
    first = saved(first.select("node", "t.tok"))
    return spread_join(first, first.groupBy("tok").count().where("count > 1").select("tok"), "tok", most, "left_semi")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, items`` for the wanted (text_key, node); only their texts are turned into sets.

    A bitmap of a fixed size goes to the executors, so that other texts stay where they are.
    """
    spark = docs.sparkSession
    at = F.pmod(F.col("text_key"), F.lit(FILTER_BITS))
    # the functions number values from 1
    bits = wanted.select((at + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    table_ = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits:
        table_[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    held = spark.sparkContext.broadcast(table_)

    def run(b: pa.RecordBatch):
        h = b.column("h").to_numpy(zero_copy_only=False)
        keep = (held.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1
        b = b.filter(pa.array(keep.astype(bool)))
        for lo, hi, t in pieces(b):
            g, offs = shingles(t, n)
            node = sketch(g, offs, 0)[1]
            items = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(g.view(np.int64)))
            yield record(own=node.view(np.int64), items=items)

    made = map_batches(docs.select("text", F.xxhash64("text").alias("text_key")).select("text", at.alias("h")), run, "own long, items array<long>")
    return made.join(wanted.select("node"), made.own == F.col("node")).select("node", "items").dropDuplicates(["node"])


def components(edges: DataFrame) -> DataFrame:
    """``node, c``: the smallest node reachable, for all nodes of (a, b) edges."""
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    hubs = frequent(both, "b")
    lab = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("c")))
    while True:
        # the label's own label, then the least among neighbours
        up = lab.select(F.col("node").alias("c"), F.col("c").alias("cc"))
        jumped = saved(spread_join(lab, up, "c", frequent(lab, "c")).select("node", "c", "cc"))
        near = spread_join(both, jumped.select(F.col("node").alias("b"), "cc"), "b", hubs).groupBy("a").agg(F.min("cc").alias("m"))
        new = jumped.join(near, jumped.node == near.a).select("node", F.least("cc", "m").alias("n"), "c")
        new = saved(new.select("node", F.col("n").alias("c"), (F.col("n") < F.col("c")).alias("moved")))
        lab = new.select("node", "c")
        if new.where("moved").isEmpty():
            return lab


class Sets:
    """The full sets of nodes, made when a candidate pair first needs them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, n: int):
        self.docs, self.nodes, self.n, self.have = docs, nodes, n, None

    def of(self, pairs: DataFrame) -> DataFrame:
        need = pairs.select(F.col("a").alias("node")).distinct().unionByName(pairs.select(F.col("b").alias("node")).distinct()).distinct()
        if self.have is not None:
            need = need.join(self.have.select("node"), "node", "left_anti")
        need = saved(self.nodes.join(need, "node", "left_semi").select("text_key", "node"))
        if not need.isEmpty():
            new = saved(full_sets(self.docs, need, self.n))
            self.have = new if self.have is None else self.have.unionByName(new)
        return self.have if self.have is not None else saved(full_sets(self.docs, need, self.n))


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: Sets, matches: int, share: int) -> DataFrame:
    """The (a, b) pairs that agree in enough coordinates and then in the full sets."""
    sa, sb = (sigs.select(F.col("node").alias(k), F.col("sig").alias(f"s{k}")) for k in "ab")
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    close = saved(pairs.join(sa, "a").join(sb, "b").where(agree >= matches).select("a", "b"))
    items = sets.of(close)
    ta, tb = (items.select(F.col("node").alias(k), F.col("items").alias(f"t{k}")) for k in "ab")
    both = F.size(F.array_intersect("ta", "tb"))
    return close.join(ta, "a").join(tb, "b").where(100 * both >= share * (F.size("ta") + F.size("tb") - both)).select("a", "b")


class Side:
    """Texts of a block as arrays: ``node``, ``c``, ``sig`` (texts x coordinates), sorted ``items`` and their offsets."""

    def __init__(self, node, c, sig, items, offs):
        self.node, self.c, self.sig, self.items, self.offs = node, c, sig, items, offs
        self.size = np.diff(offs)
        self.own = np.repeat(np.arange(len(node)), self.size)

    @staticmethod
    def of(texts: pa.StructArray) -> Side:
        """From structs (node, c, sig, items)."""
        node, c, sig, items = (texts.field(k) for k in ("node", "c", "sig", "items"))
        flat = lambda a: a.flatten().to_numpy(zero_copy_only=False)
        offs = items.offsets.to_numpy().astype(np.int64)
        return Side(node.to_numpy(zero_copy_only=False), c.to_numpy(zero_copy_only=False), flat(sig).reshape(len(node), -1), flat(items), offs - offs[0])


def block_links(left: Side, right: Side, matches: int, share: int, one: bool) -> list[tuple[int, int]]:
    """Links of left with right texts of other components; if ``one``, one a left text."""
    n, m = len(left.node), len(right.node)
    close = np.zeros((n, m), bool)
    for lo in range(0, n, 64):
        close[lo : lo + 64] = (left.sig[lo : lo + 64, None, :] == right.sig[None, :, :]).sum(2) >= matches
    close &= left.c[:, None] != right.c[None, :]
    if not close.any():
        return []
    common = np.intersect1d(left.items, right.items)
    both = np.zeros((n, m), np.float32)
    at = []
    for side in (left, right):
        k = np.minimum(np.searchsorted(common, side.items), max(len(common) - 1, 0))
        hit = common[k] == side.items if len(common) else np.zeros(len(k), bool)
        own, k = side.own[hit], k[hit]
        o = np.argsort(k, kind="stable")
        at.append((own[o], k[o]))
    for lo in range(0, len(common), 4096):
        width = min(4096, len(common) - lo)
        ab = []
        for (own, k), size in zip(at, (n, m), strict=True):
            a, z = np.searchsorted(k, (lo, lo + width))
            x = np.zeros((size, width), np.float32)
            x[own[a:z], k[a:z] - lo] = 1
            ab.append(x)
        both += ab[0] @ ab[1].T
    ok = close & (100 * both >= share * (left.size[:, None] + right.size[None, :] - both))
    at = [(k, int(ok[k].argmax())) for k in np.flatnonzero(ok.any(1)).tolist()] if one else np.argwhere(ok).tolist()
    return [(int(left.node[i]), int(right.node[j])) for i, j in at]


def blocked(tests: DataFrame, members: DataFrame, sigs: DataFrame, sets: Sets, matches: int, share: int, one: bool) -> DataFrame:
    """(a, b) links between ``tests`` and ``members``, both (node, c, g), of the same g."""
    nodes = tests.select("node").unionByName(members.select("node")).distinct()
    full = sets.of(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).join(sigs, "node")
    # blocks are bounded by texts and by shingles, whichever is reached first
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_ITEMS))
    size, packs = (x.join(sigs.select("node", "n"), "node").groupBy("g").agg(blocks.alias(k)) for x, k in ((members, "nb"), (tests, "np")))
    text = F.struct("node", "c", "sig", "items")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    right = spread_join(members, size, "g", frequent(members, "g")).join(full, "node").groupBy("g", part("nb").alias("k")).agg(F.collect_list(text).alias("r"))
    left = spread_join(tests, packs, "g", frequent(tests, "g")).join(full, "node").groupBy("g", part("np").alias("p")).agg(F.collect_list(text).alias("l"))
    left = left.join(size, "g").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                found = block_links(*(Side.of(b.column(c).slice(k, 1).flatten()) for c in "lr"), matches, share, one)
                if found:
                    yield record(a=[x for x, _ in found], b=[y for _, y in found])

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = tests.sparkSession
    before = spark.conf.get(key, None)
    spark.conf.set(key, 1)  # a row is a pair of blocks
    try:
        return saved(left.join(right, ["g", "k"]).select("l", "r").mapInArrow(run, "a long, b long"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def link(posts: DataFrame, sigs: DataFrame, sets: Sets, matches: int, share: int) -> DataFrame:
    """``node, c`` for the nodes in postings that have a link; c is the component."""
    posts = saved(posts)
    n = posts.count()
    crowded = frequent(posts, "tok")
    lab = tested = None
    before = None
    step = 0
    while n:
        cur = posts.withColumn("c", F.col("node")) if lab is None else posts.join(lab, "node", "left").withColumn("c", F.coalesce("c", "node"))
        cur = saved(cur)
        per = cur.groupBy("tok", "c").count().groupBy("tok").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("count")).alias("q"))
        across = per.agg(F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()[0] or 0
        if not across:
            break
        last = across <= n or (before is not None and across > 0.8 * before)
        before = across
        if last:
            # the largest component of a list needs no tests inside: the others meet all
            held = cur.groupBy("tok", "c").count()
            big = held.groupBy("tok").agg(F.max_by("c", F.struct("count", "c")).alias("big"), F.count("*").alias("k")).where("k > 1")
            small = cur.join(big, "tok").where("c <> big").select("tok", F.col("node").alias("x"), F.col("c").alias("cx"), "big")
            hot = frequent(cur, "c")
            wide = saved(cur.select("node", "c").distinct().groupBy("c").count().where(F.col("count") > FEW).select("c"))
            few = saved(spread_join(cur, wide, "c", hot, "left_anti"))
            long_lists = few.groupBy("tok").count().where(F.col("count") > BLOCK // 8).select("tok")
            # texts against large components; small texts of a long list meet all of them, as no other test does
            tests = small.join(held.select("tok", F.col("c").alias("g")), "tok").where("cx <> g AND (g = big OR cx < g)").select("x", "cx", "g")
            crowd = few.join(long_lists, "tok", "left_semi").select("tok", F.col("node").alias("x"), F.col("c").alias("cx"))
            tests = tests.unionByName(crowd.join(held.join(wide, "c", "left_semi").select("tok", F.col("c").alias("g")), "tok").select("x", "cx", "g"))
            far = saved(tests.join(wide.select(F.col("c").alias("g")), "g", "left_semi").select(F.col("x").alias("node"), F.col("cx").alias("c"), "g").distinct())
            linked = []
            if not far.isEmpty():
                of = spread_join(cur.select("node", "c").distinct(), far.select(F.col("g").alias("c")).distinct(), "c", hot, "left_semi")
                linked.append(blocked(far, saved(of.withColumn("g", F.col("c"))), sigs, sets, matches, share, True))
            # texts of small components: in blocks where a list has many, else pair by pair
            many = saved(few.join(long_lists, "tok", "left_semi").select("node", "c", F.col("tok").alias("g")))
            if not many.isEmpty():
                linked.append(blocked(many, many, sigs, sets, matches, share, False))
            rest = few.join(long_lists, "tok", "left_anti").select("tok", F.col("node").alias("y"), F.col("c").alias("cy"))
            pairs = small.join(rest, "tok").where("cx <> cy AND (cy = big OR cx < cy)")
        else:
            order = F.struct(F.xxhash64("node", F.lit(step)).alias("o"), "node", "c")
            hubs = cur.groupBy("tok").agg(F.min(order).alias("p"), F.max(order).alias("q"))
            hubs = hubs.select("tok", F.explode(F.array("p", "q")).alias("h")).select("tok", F.col("h.node").alias("y"), F.col("h.c").alias("cy"))
            pairs = spread_join(cur.select("tok", F.col("node").alias("x"), F.col("c").alias("cx")), hubs, "tok", crowded).where("cx <> cy")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs)
        edges = saved(confirmed(pairs, sigs, sets, matches, share))
        for more in linked if last else []:
            edges = edges.unionByName(more)
        tested = pairs if tested is None else tested.unionByName(pairs)
        if lab is not None:
            e = edges.join(lab.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a", "left").join(lab.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b", "left")
            edges = e.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
        if not edges.isEmpty():
            new = components(edges)
            if lab is None:
                lab = new
            else:
                moved = spread_join(lab, new.select(F.col("node").alias("c"), F.col("c").alias("d")), "c", frequent(lab, "c"), "left").select("node", F.coalesce("d", "c").alias("c"))
                lab = saved(moved.unionByName(new.join(lab.select("node"), "node", "left_anti")))
        if last:
            break
        step += 1
    spark = posts.sparkSession
    return lab if lab is not None else spark.createDataFrame([], "node long, c long")


def near_duplicates(docs: DataFrame, n: int = 5, share: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Links need 100 x intersection >= ``share`` x union of the sets of ``n``-word shingles.
    With ``carry`` these columns of docs (long) follow, and ``component``: unlike the
    smallest id it differs between components where ids repeat; null for empty sets.
    """
    all_ = saved(signatures(docs, n, coordinates, carry))
    with scratch():
        # one row a set: the smallest id that has it, and a text
        one = [F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("sig", "text_key", "n_shingles"))]
        nodes = saved(all_.where("node IS NOT NULL").groupBy("node").agg(*one))
        posts = saved(postings(nodes.select("node", "sig"), matches))
        busy = posts.select("node").distinct()
        sigs = saved(nodes.join(busy, "node", "left_semi").select("node", "sig", F.col("n_shingles").alias("n")))
        lab = link(posts, sigs, Sets(docs, nodes.select("node", "text_key"), n), matches, share)
        lab = saved(nodes.select("node", "doc_id").join(lab, "node", "left").select("node", "doc_id", F.coalesce("c", "node").alias("c")))
        least = lab.groupBy("c").agg(F.min("doc_id").alias("component_id"))
        lab = saved(spread_join(lab, least, "c", frequent(lab, "c")).select("node", "component_id", F.col("c").alias("component")), keep=True)
    rows = all_.select("doc_id", "n_shingles", "node", *carry)
    out = spread_join(rows, lab, "node", frequent(rows, "node"), "left")
    comp = F.coalesce("component_id", "doc_id")
    more = [*carry, "component"] if carry else []
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"), *more)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS g FROM w),
h AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM s),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
e AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM h x JOIN h y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.a WHERE r.m < e.b),
c AS (SELECT a, min(m) AS m FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
