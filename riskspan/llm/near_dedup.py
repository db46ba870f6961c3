"""MinHash near-dedup by bottom-k sketches of one hash function.

Documents with equal shingle sets form a class. A class keeps the 32 least of its set's hashes, its sketch. Sets with a
Jaccard similarity of 0.85 share most of the 32 least hashes of their union, so somewhere three of them follow each other in
both sketches: the inverted lists are keyed by three consecutive retained values. (For a pair at the threshold the chance
that no such run exists is about 5e-7, and none for sets of up to 32 shingles; list keys of a single value would put every
document with a common passage into one list.) At a similarity of 0.80 the keys are two consecutive values (about 8e-10).

1. Every class is compared with the hub of its lists, once, and verified links are joined to components.
2. Classes of lists that still hold several components are searched for all links between different components. How many
   shingles of a class no other such class has bounds what it can share. The classes left meet in the lists of their rarest
   shingles (see _rarest()), the union of both sketches estimates each pair, and those left are verified on the full sets where
   they are found: no candidate pair is written or shuffled.
Lists are never cut: long ones are searched in blocks of bounded size, by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .bitmap import build, test
from .common import materialise, mix, returning_memory, scan_words, slices, starts_of, table, text_bytes, window_hashes

SHINGLE = 5
#: Bytes of text whose shingles a task sorts at a time.
SLICE = 1 << 20
K = 32
PERCENT = 85
#: For each threshold in percent: the length of the runs of sketch values that key the lists, and the values that sketches must
#: share of the K least hashes of their union (a link at the threshold has K * percent / 100 on average; fewer come with a chance
#: of about 1e-8 at 85 and 3e-9 at 80). At 80, runs of three could fail sets of five and four shingles, and others with a chance
#: of about 1e-5; of runs of two, any two sets that are held whole have one in common.
LISTS = {85: (3, 14), 80: (2, 11)}
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct shingle hashes, sorted within the row, and the n + 1 positions where the rows start."""
    rows = len(column)
    data, offsets = text_bytes(column)
    _, _, row, hashes = scan_words(data.translate(_LOWER), offsets)
    first = starts_of(row, rows)
    lengths = np.diff(first)
    windows = window_hashes(hashes, k)
    inside = np.flatnonzero(row[: len(windows)] == row[k - 1 :]) if len(windows) else np.empty(0, np.int64)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    whole = np.array([window_hashes(hashes[first[r] : first[r + 1]], int(lengths[r]))[0] for r in short], dtype=np.uint64)
    values = np.concatenate([windows[inside], mix(whole + lengths[short].astype(np.uint64))])
    owner = np.concatenate([row[inside], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, starts_of(owner, rows)


SKETCH = StructType([StructField("doc_id", LongType()), StructField("n", LongType()), StructField("set1", LongType()), StructField("set2", LongType()), StructField("sketch", ArrayType(LongType()))])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = to_arrow_schema(SKETCH)
    for whole in batches:
        for batch in slices(whole, limit=SLICE):
            values, first = shingle_sets(batch.column("text"))
            sums = []
            for v in (values, mix(values ^ np.uint64(0x5851F42D4C957F2D))):
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v)))
                sums.append(mix(total[first[1:]] - total[first[:-1]]).view(np.int64))
            taken = np.minimum(np.diff(first), K)
            offsets = np.concatenate(([0], np.cumsum(taken)))
            at = np.repeat(first[:-1] - offsets[:-1], taken) + np.arange(offsets[-1])
            sketch = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(sums[0]), pa.array(sums[1]), sketch.cast(schema.field("sketch").type)], schema=schema)


SETS = StructType([StructField("class", LongType()), StructField("shingles", ArrayType(LongType()))])
#: Classes of a home block when open lists are searched, and pairs that one task verifies at a time.
BLOCK = 250
VERIFY = 500


def _sets_of(marked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(SETS)
        for whole in batches:
            ids = whole.column("doc_id")
            picked = np.flatnonzero(test(marked.value, np.asarray(whole.column("mark"), dtype=np.int64)))
            if not len(picked):
                continue
            some = pa.RecordBatch.from_arrays([ids.take(pa.array(picked)), whole.column("text").take(pa.array(picked))], names=["doc_id", "text"])
            for batch in slices(some, limit=SLICE):
                values, first = shingle_sets(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists.cast(schema.field("shingles").type)], schema=schema)

    return run


def _verify(pairs: pa.Table, sets: pa.Table, percent: int) -> pa.Table:
    """Pairs whose full sets are similar enough."""
    held = dict(zip(sets.column("class").to_pylist(), range(sets.num_rows), strict=True))
    column = sets.column("shingles").combine_chunks()
    cache: dict[int, np.ndarray] = {}

    def of(c: int) -> np.ndarray:
        if c not in cache:
            cache[c] = np.asarray(column[held[c]].values)
        return cache[c]

    xs, ys = [], []
    for x, y in zip(pairs.column("x").to_pylist(), pairs.column("y").to_pylist(), strict=True):
        a, b = of(x), of(y)
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            xs.append(x)
            ys.append(y)
    return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links among `pairs` (x, y, place). Pairs of one place are verified by one task, with each set sent once a place."""
    members = pairs.select(F.col("place").alias("spot"), F.explode(F.array("x", "y")).alias("class")).distinct()
    members = members.join(sets, "class").select("spot", "class", "shingles")
    return pairs.groupBy("place").cogroup(members.groupBy("spot")).applyInArrow(lambda key, p, s: _verify(p, s, percent), "x long, y long")


#: Links that one task contracts. Up to as many in all, its components are final.
CONTRACT = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by one from each class to the least class that they reach."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(x, x)
            root.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(class, comp): the least class reachable over `links` (x, y, a materialised table), for every class with a link.

    Tasks first contract up to CONTRACT links each, without a shuffle. If that took more than one task, alternating large-star
    and small-star steps join the rest; each is a minimum per class, summed on the map side, and a join.
    """
    tasks = max(1, -(-links.count() // CONTRACT))
    edges = materialise(links.coalesce(tasks).mapInArrow(_contract, "a long, b long"), "links")
    last = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("class"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("class"), F.col("b").alias("comp")).distinct())


def estimated(sketches: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shares, of K, that both sketches of each pair hold among the K least hashes of their union."""
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 20_000):
        both = np.sort(np.concatenate((sketches[x[at : at + 20_000]], sketches[y[at : at + 20_000]]), axis=1), axis=1)
        twice = both[:, 1:] == both[:, :-1]
        rank = np.arange(1, 2 * K) - np.cumsum(twice, axis=1)  # of the twin among the distinct values
        out[at : at + 20_000] = (twice & (rank < K)).sum(axis=1)
    return out


def _search(t: pa.Table, percent: int, least: int) -> pa.Table:
    """Links between the components of two home blocks (sides 0 and 1; one block: 0 only), at most one for each join.

    Candidates share a list. The shingles that other classes hold bound what a pair can share, the union sketch estimates it
    and full sets decide. Pairs that links found before have joined are not looked at.
    """
    t = t.sort_by([("side", "ascending"), ("class", "ascending")]).combine_chunks()
    c, n, m, comp, side = (np.asarray(t.column(x)) for x in ("class", "n", "m", "comp", "side"))
    size, two = len(c), bool((side == 1).any())
    lists = t.column("keys").combine_chunks()
    key_of, owner = np.asarray(lists.flatten()), np.repeat(np.arange(size), np.diff(np.asarray(lists.offsets)))
    order = np.argsort(key_of, kind="stable")
    meet = np.zeros((size, size), bool)
    for members in np.split(owner[order], np.flatnonzero(np.diff(key_of[order])) + 1):
        meet[np.ix_(members, members)] = True
    shared = np.minimum(m[:, None], m[None, :])
    meet &= 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
    meet &= (comp[:, None] != comp[None, :]) & ((side[:, None] < side[None, :]) if two else (c[:, None] < c[None, :]))
    i, j = np.nonzero(meet)
    sets = t.column("shingles").combine_chunks()
    value, start = np.asarray(sets.flatten()).view(np.uint64), np.asarray(sets.offsets).astype(np.int64)
    start = start - start[0]
    if len(i):
        full = np.diff(start) >= K
        sketches = value[np.minimum(start[:-1, None] + np.arange(K), len(value) - 1)]
        likely = ~(full[i] & full[j])
        likely[~likely] = estimated(sketches, i[~likely], j[~likely]) >= least
        i, j = i[likely], j[likely]
    root = {int(x): int(x) for x in comp}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    xs, ys = [], []
    ids = np.unique(value, return_inverse=True)[1] if len(i) else value
    mark = np.zeros(len(ids) + 1, bool)
    cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a == b:
            continue
        one = int(i[a])
        others = [int(k) for k in j[a:b] if find(int(comp[k])) != find(int(comp[one]))]
        mark[ids[start[one] : start[one + 1]]] = True
        for k in others:
            both = int(mark[ids[start[k] : start[k + 1]]].sum())
            if 100 * both >= percent * (int(n[one]) + int(n[k]) - both):
                u, v = find(int(comp[one])), find(int(comp[k]))
                if u != v:
                    root[max(u, v)] = min(u, v)
                    xs.append(int(max(c[one], c[k])))
                    ys.append(int(min(c[one], c[k])))
        mark[ids[start[one] : start[one + 1]]] = False
    return pa.table({"x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})


def _rarest(live: DataFrame, need: Column) -> DataFrame:
    """Inverted lists of the classes' rarest shingles: key (the shingle), class, n, m, comp.

    Shingles are ordered by how many classes hold them, those of one component first, then by value. Of two sets with `need`
    shingles in common, each has one of these among its n - need + 1 first ones, so these lists lose no pair, and a passage that
    many classes hold makes no list where the classes have rarer shingles. A shingle of one component lists nothing, but takes
    its place among the first ones. m counts the others: all that a class can share with one of another component.
    """
    spread = live.select("class", "n", "comp", F.explode("shingles").alias("key"))
    across = spread.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "c")
    of_class = Window.partitionBy("class")
    ranked = spread.join(across, "key").withColumns({"m": F.count(F.lit(1)).over(of_class), "place": F.row_number().over(of_class.orderBy("c", "key"))})
    return ranked.where(F.col("place") <= F.col("m") - need + 1).select("key", "class", "n", "m", "comp")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sketch rows of all documents, and one row per class of equal sets: class (its least id), n, sketch."""
    rows = materialise(docs.select("doc_id", "text").mapInArrow(returning_memory(_sketches), SKETCH), "sketches")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("class"), F.first("sketch").alias("sketch"))
    return rows, materialise(classes, "classes")


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: see near_duplicates()."""
    spark = docs.sparkSession
    length, least = LISTS[percent]
    rows, classes = classes_of(docs)
    run = F.transform(F.sequence(F.lit(1), F.size("sketch") - (length - 1)), lambda i: F.xxhash64(*[F.element_at("sketch", (i + j).cast("int")) for j in range(length)]))
    postings = classes.where(F.size("sketch") >= length).select("class", "n", F.explode(F.array_distinct(run)).alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    lists = materialise(postings.join(shared, "key"), "shared-lists")
    # A list's hub is its class with the most company over all lists: where copies differ from a common source more than the
    # source differs from each, that is the source.
    company = lists.groupBy("class").agg(F.sum("size").alias("company"))
    hubs = lists.join(company, "class").groupBy("key").agg(F.max_by(F.struct("class", "n"), F.struct("company", -F.col("class"))).alias("rep"))
    lists = materialise(lists.join(hubs, "key"), "lists")

    fits = 100 * F.least("n", "rep.n") >= percent * F.greatest("n", "rep.n")
    star = lists.where((F.col("class") != F.col("rep.class")) & fits).groupBy("class", F.col("rep.class").alias("rep")).agg(F.count(F.lit(1)).alias("c"))
    star = star.groupBy("class").agg(F.max_by("rep", F.struct("c", -F.col("rep"))).alias("y"))
    places = star.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / VERIFY).alias("parts"))
    star = star.join(places, "y").select(F.col("class").alias("x"), "y", F.pmod(F.xxhash64("class"), F.col("parts")).alias("part"))
    star = materialise(star, "star")
    spread = max(64, star.count() // VERIFY)
    star = star.select("x", "y", F.pmod(F.xxhash64("y", "part"), F.lit(spread)).alias("place"))

    listed = lists.select("class").distinct()
    marked = spark.sparkContext.broadcast(build(listed.select(F.xxhash64("class").alias("mark"))))
    source = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("mark"))
    sets = source.mapInArrow(returning_memory(_sets_of(marked)), SETS).join(listed, "class", "left_semi")
    sets = materialise(sets.dropDuplicates(["class"]), "sets")
    links = materialise(verified(star, sets, percent), "links")
    comp = components(links)

    # Lists that hold several components.
    held = lists.join(comp, "class", "left").select("key", "class", "n", F.coalesce("comp", "class").alias("comp"))
    open_ = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    left = held.join(open_, "key").select("class", "n", "comp").distinct()
    left = materialise(left.join(sets, "class"), "open-classes")
    alone = left.select("class", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("class")).where("c = 1")
    alone = alone.groupBy("class").agg(F.count(F.lit(1)).alias("u"))
    need = F.expr(f"({percent} * n + 99) div 100")  # shingles that a class shares with any class it links to
    live = materialise(left.join(alone, "class", "left").where(F.col("n") - F.coalesce("u", F.lit(0)) >= need).select(*left.columns), "live-classes")
    held = materialise(_rarest(live, need), "live-lists")
    sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "size")
    held = materialise(held.join(sizes, "key"), "live-lists")
    # A class's home is a block of its largest list. Blocks that meet in a list are searched by one task for each pair of them.
    home = held.groupBy("class", "n", "m", "comp").agg(F.max(F.struct("size", "key")).alias("h"), F.collect_set("key").alias("keys"))
    home = home.select("class", "n", "m", "comp", "keys", F.xxhash64("h.key", F.pmod(F.xxhash64("class"), F.ceil(F.col("h.size") / BLOCK))).alias("home"))
    home = materialise(home.join(live.select("class", "shingles"), "class"), "homes")
    meets = held.select("key", "class").join(home.select("class", "home"), "class").select("key", "home").distinct()
    cells = meets.select("key", F.col("home").alias("i")).join(meets.select("key", F.col("home").alias("j")), "key").where("i <= j").select("i", "j").distinct()
    sides = cells.select("i", "j", F.col("i").alias("home"), F.lit(0).alias("side")).unionByName(cells.where("i < j").select("i", "j", F.col("j").alias("home"), F.lit(1).alias("side")))
    more = sides.join(home, "home").groupBy("i", "j").applyInArrow(lambda key, t: _search(t, percent, least), "x long, y long")
    comp = components(materialise(links.unionByName(more), "links"))

    named = classes.select("n", "set1", "set2", "class").join(comp, "class", "left").select("n", "set1", "set2", F.coalesce("comp", "class").alias("component"))
    out = rows.select("doc_id", "n", "set1", "set2").join(named, ["n", "set1", "set2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Sets are the distinct five-word shingles of the A-Z lower-cased text (fewer words: the whole sequence). Documents are
    linked at a Jaccard similarity of percent / 100 (a key of LISTS) of the full sets; component_id is the least doc_id reachable. Null, empty
    and blank texts have no shingles and link with nothing, not even with each other. Rows repeated whole share their result.
    Null ids take their class's component and are never kept. An empty table gives an empty result.
    """
    return link(docs, percent).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(ws[p : p + least(len(ws), 5) - 1], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) AS p FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN e ON r.y = e.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op6_near_dedup": op6}
ORACLE_SQL = {"op6_near_dedup": _ORACLE}
