"""Near-duplicates: a chosen-path set similarity join over minwise tokens, with exact checks of every link."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .storage import Workspace, as_rows, broadcast_if_few, part, unpacked
from .words import exact_shingles, mix, sequence_hashes, text_slices, word_hashes

TOKENS = 128
TREES = 10
#: Branches that a document takes at the first levels of a tree: 4 paths of 5 tokens in all. The nodes of a corpus are large there, so they are not counted.
BRANCHES = (2, 2, 1, 1, 1)
#: Branches at the levels below, which only nodes of over SMALL classes reach.
DEEPER = (1, 1)
#: Nodes up to this size are compared exhaustively.
SMALL = 16
#: Pairs of one class that are checked together, and bytes of text that are.
MEMBERS, CHECK_BYTES = 512, 4 << 20
#: Shingles in a block in which what is left of large groups is compared: those outside the main component, and all others.
OUTSIDE, INSIDE = 1 << 19, 1 << 18
SKETCH = 64
_MULTIPLIERS = np.random.default_rng(20).integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of fewer words, one of the whole sequence; of none, none."""
    if 0 < len(words) < k:
        return mix(sequence_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(sequence_hashes(words, k))


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for i, j, data, offsets in text_slices(column):
        words, of = word_hashes(data, offsets)
        for d in range(j - i):
            yield shingle_set(words[of[d] : of[d + 1]], k)


def signature(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 8192):
        out = np.minimum(out, ((shingles[i : i + 8192, None] * _MULTIPLIERS[None]) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def _sketches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Adds to rows of (keys..., text) the size, signature, tokens and sketch of the text's set."""
    for batch in batches:
        keys = batch.num_columns - 1
        sets = [(len(s), signature(s), minwise(s)) for s in sets_of(batch.column(keys), k)]
        sizes, sigs, tokens = zip(*sets, strict=True) if sets else ((), (), ())
        # A sketch is the low byte of every other token.
        sketches = [t[:: TOKENS // SKETCH].astype(np.uint8).tobytes() for t in tokens]
        made = [pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array(sketches, pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:keys], *made], names=[*batch.schema.names[:keys], "n_shingles", "sig", "tokens", "sketch"])


def _descend(keys: np.ndarray, tokens: np.ndarray, branches: tuple[int, ...] = BRANCHES, level: int = 0) -> np.ndarray:
    """Child nodes of each row's node after some levels: (rows, paths). A node picks the minwise positions that its documents branch on."""
    keys = keys[:, None]
    rows = np.arange(len(keys))[:, None]
    for n, b in enumerate(branches, level):
        out = []
        for i in range(b):
            pick = mix(keys + np.uint64((n * 8 + i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            out.append(mix(pick ^ (tokens[rows, (pick >> np.uint64(40)) % np.uint64(TOKENS)].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))))
        keys = np.concatenate(out, 1)
    return keys


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, TOKENS)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, tokens = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
        keys = np.concatenate([_descend(mix(np.full(len(ids), t + 1, np.uint64)), tokens) for t in range(TREES)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, keys.shape[1]), pa.int64())], names=["node", "class_id"])


def _children(batches: Iterator[pa.RecordBatch], level: int, branches: int) -> Iterator[pa.RecordBatch]:
    """One more level for rows (node, class_id, tokens)."""
    for batch in batches:
        ids, tokens = batch.column(1).to_numpy(zero_copy_only=False), _matrix(batch.column(2))
        keys = _descend(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), tokens, (branches,), level)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, branches), pa.int64())], names=["node", "class_id"])


def _likely(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        ok = pa.array((x == y).sum(1) >= least * SKETCH)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["hub", "other"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    low, high = min(len(x), len(y)), max(len(x), len(y))
    if not low or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (low + high - both)


def _linked(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, slot, other, text) come in order, each hub's own text first in its slot (other is null there): links between hubs and others on real words."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    hub: tuple | None = None
    own: str = ""

    def checked(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (hub, other, hub's text, text): each distinct hub's text is taken once."""
        first: dict[tuple, int] = {}
        texts: list[str] = []
        for key, _, mine, text in rows:
            if key not in first:
                first[key] = len(texts)
                texts.append(mine)
            texts.append(text)
        sets, out, at = exact_shingles(pa.array(texts, pa.large_string()), k), [], 0
        for key, other, _, _ in rows:
            if first[key] == at:
                at += 1
            if _similar(sets[first[key]], sets[at], percent):
                out.append((key[0], other))
            at += 1
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], schema=schema)

    held, size = [], 0
    for batch in batches:
        for h, slot, other, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if other is None:
                hub, own = (h, slot), text
                size += len(own)
            elif hub == (h, slot):
                held.append((hub, other, own, text))
                size += len(text)
            if size >= CHECK_BYTES and held:
                yield checked(held)
                held, size = [], len(own)
    yield checked(held)


def _block_links(table: pa.Table, k: int, percent: int) -> pa.Table:
    """Links of one block: each class outside the main component with one class of each other component that it links to."""
    component = table.column("component").to_numpy()
    outside = table.column("outside").to_numpy(zero_copy_only=False)
    ids = table.column("class_id").to_numpy()
    sets = exact_shingles(table.column("text").combine_chunks(), k)
    sizes = np.array([len(x) for x in sets])
    inner, rows = np.flatnonzero(~outside & (sizes > 0)), []
    if len(inner):
        known, flat = np.unique(np.concatenate([sets[i] for i in inner]), return_inverse=True)
        start = np.cumsum(sizes[inner]) - sizes[inner]
        for x in np.flatnonzero(outside & (sizes > 0)):
            at = np.searchsorted(known, sets[x])
            at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == sets[x])]
            flag = np.zeros(len(known), np.int64)
            flag[at] = 1
            both = np.add.reduceat(flag[flat], start)
            ok = (100 * both >= percent * (sizes[x] + sizes[inner] - both)) & (component[inner] != component[x])
            _, one = np.unique(component[inner[ok]], return_index=True)
            rows += [(ids[x], ids[i]) for i in inner[ok][one]]
    return pa.table({"u": pa.array([r[0] for r in rows], pa.int64()), "v": pa.array([r[1] for r in rows], pa.int64())})


class _Join:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        """``docs``: doc_id, text, and mark if rows are to be told apart by more than their id."""
        self.docs, self.k, self.percent = docs, k, percent
        self.work = Workspace(docs.sparkSession, "near")

    def classes(self) -> DataFrame:
        keys = [f for f in self.docs.schema.fields if f.name != "text"]
        schema = T.StructType([*keys, T.StructField("n_shingles", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("sig", "tokens", "sketch"))])
        self.rows = self.work.table(self.docs.select(*(f.name for f in keys), "text").mapInArrow(lambda b, k=self.k: _sketches(b, k), schema))
        grouped = self.rows.where("doc_id is not null and n_shingles > 0").groupBy("sig").agg(F.min("doc_id").alias("rep_id"), F.max("n_shingles").alias("size"), F.max("tokens").alias("tokens"), F.max("sketch").alias("sketch"))
        # Numbered once and written, so numbers don't change if a task runs again.
        self.known = self.work.table(grouped.withColumn("class_id", F.monotonically_increasing_id()))
        return self.known

    def leaves(self) -> tuple[DataFrame, DataFrame]:
        """Rows (node, class_id) of small leaves, and those (with n) of nodes that are large at the deepest level still."""
        work, known = self.work, self.known.select("class_id", "tokens")
        nodes, small = known.mapInArrow(_nodes, "node long, class_id long"), []
        for level, branches in enumerate((*DEEPER, 0), len(BRANCHES)):
            sizes = work.table(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"))
            members = work.table(nodes.join(sizes, "node"))
            work.drop(sizes)
            small.append(members.where(F.col("n") <= SMALL).select("node", "class_id"))
            large = members.where(F.col("n") > SMALL)
            if not branches or large.isEmpty():
                break
            if level == len(BRANCHES):  # only these classes branch on, so only their tokens are sent again
                known = work.table(known.join(large.select("class_id").distinct(), "class_id", "left_semi"))
            deeper = large.select("node", "class_id").join(known, "class_id").select("node", "class_id", "tokens")
            nodes = work.table(deeper.mapInArrow(lambda b, level=level, n=branches: _children(b, level, n), "node long, class_id long"))
        out = small[0]
        for x in small[1:]:
            out = out.union(x)
        return out, large

    def texts_of(self, classes: DataFrame) -> DataFrame:
        """class_id and whole text of one document of each class."""
        wanted = self.work.table(self.known.join(classes.distinct(), "class_id", "left_semi").select("class_id", "sig", F.col("rep_id").alias("doc_id")))
        # A row that has this id and set; ids may come with several texts. The table grows with the corpus, so it is never broadcast.
        rows = self.docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("class_id", "sig", "text")

        def own(batches: Iterator[pa.RecordBatch], k=self.k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = pa.array([signature(s) == sig for s, sig in zip(sets_of(batch.column(2), k), batch.column(1).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(2).filter(ok)], names=["class_id", "text"])

        return self.work.table(rows.mapInArrow(own, "class_id long, text string").dropDuplicates(["class_id"]))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (hub, other) those that link (u, v): likely ones by size and sketch are compared on their real words.

        A hub's text is sent once for each MEMBERS of its pairs."""
        work, percent, k = self.work, self.percent, self.k
        known = self.known.select("class_id", "size", "sketch")
        both = pairs.join(known.toDF("hub", "size_a", "x"), "hub").join(known.toDF("other", "size_b", "y"), "other")
        both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")).select("hub", "other", "x", "y")
        least = max(0.0, percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5)
        likely = work.table(both.mapInArrow(lambda b: _likely(b, least), "hub long, other long"))
        busy = work.table(likely.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > MEMBERS))
        slot = F.coalesce(F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / MEMBERS)), F.lit(0)).cast("int")
        dealt = work.table(likely.join(broadcast_if_few(busy), "hub", "left").select("hub", slot.alias("slot"), "other"))
        asked = dealt.select("hub", "slot", "other", F.col("other").alias("class_id")).union(dealt.select("hub", "slot").distinct().select("hub", "slot", F.lit(None).cast("long"), "hub"))
        n = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = asked.join(self.texts, "class_id").select("hub", "slot", "other", "text").repartition(n, "hub", "slot").sortWithinPartitions("hub", "slot", "other")
        return work.table(rows.mapInArrow(lambda b: _linked(b, k, percent), "u long, v long").distinct())

    def compare_groups(self, mixed: DataFrame) -> DataFrame:
        """Large nodes that share a class are one group. What lies outside a group's main component is compared with all the
        rest of it on real words, block by block: the pairs are never written out. Returns the links."""
        work, percent, k = self.work, self.percent, self.k
        # Nodes are named by the smallest class in them, so that groups are components of classes.
        first = work.table(mixed.groupBy("node").agg(F.min("class_id").alias("u")))
        reached = work.table(components(work, mixed.join(first, "node").select("u", F.col("class_id").alias("v"))))
        rows = mixed.select("class_id", "component").distinct().join(reached.toDF("class_id", "grp"), "class_id").join(self.known.select("class_id", "size"), "class_id")
        rows = work.table(rows)
        main = rows.groupBy("grp", "component").agg(F.sum("size").alias("k")).groupBy("grp").agg(F.max(F.struct("k", "component")).alias("x"), F.sum("k").alias("n"))
        main = work.table(main.select("grp", F.col("x.component").alias("main"), F.ceil(F.col("n") / INSIDE).alias("inside"), F.ceil((F.col("n") - F.col("x.k")) / OUTSIDE).alias("outside")).where("outside > 0"))
        placed = rows.join(main, "grp").withColumn("r", F.xxhash64("class_id"))
        columns = ["grp", "class_id", "component"]
        inner = placed.select(*columns, F.pmod("r", "inside").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("o"), F.lit(False).alias("outside"))
        outer = placed.where("component != main").select(*columns, F.explode(F.sequence(F.lit(0), F.col("inside") - 1)).alias("i"), F.pmod("r", "outside").alias("o"), F.lit(True).alias("outside"))
        blocks = inner.unionByName(outer).join(self.texts, "class_id")
        return work.table(blocks.groupBy("grp", "i", "o").applyInArrow(lambda t: _block_links(t, k, percent), "u long, v long").distinct())

    def joined(self, found: DataFrame, edges: DataFrame) -> DataFrame:
        """Components (id, component) after more links: these join components, and mostly there are none such."""
        of = lambda end, c: found.select(F.col("id").alias(end), F.col("component").alias(c))
        between = edges.join(of("u", "cu"), "u", "left").join(of("v", "cv"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u != v")
        between = self.work.table(between.distinct())
        if between.isEmpty():
            return found
        merged = self.work.table(components(self.work, between)).toDF("component", "lower")
        all_ids = found.union(between.select("u", "u")).union(between.select("v", "v")).distinct()
        return self.work.table(all_ids.join(merged, "component", "left").select("id", F.coalesce("lower", "component").alias("component")))

    def run(self) -> DataFrame:
        work, known = self.work, self.classes()
        small, large = self.leaves()
        self.texts = self.texts_of(small.select("class_id").union(large.select("class_id")))
        # At most SMALL to a node, so its pairs are bounded by its rows.
        other = small.toDF("node", "other")
        pairs = small.toDF("node", "hub").join(other, "node").where("hub < other").select("hub", "other")
        any_large = not large.isEmpty()
        if any_large:
            # All of a large node are compared with its leader, the one with most company: the middle of a group of copies.
            central = work.table(large.groupBy("class_id").agg(F.sum("n").alias("c")))
            leaders = work.table(large.join(central, "class_id").groupBy("node").agg(F.max(F.struct("c", "class_id")).alias("x")).select("node", F.col("x.class_id").alias("leader")))
            pairs = pairs.union(large.join(leaders, "node").where("class_id != leader").select("leader", "class_id"))
        found = work.table(components(work, self.verify(work.table(pairs.distinct()))))
        if any_large:
            placed = work.table(large.join(found.withColumnRenamed("id", "class_id"), "class_id", "left").select("node", "class_id", F.coalesce("component", "class_id").alias("component")))
            counted = placed.groupBy("node", "component").agg(F.count("*").alias("k"))
            parts = work.table(counted.groupBy("node").agg(F.count("*").alias("parts")).where("parts > 1").select("node"))
            mixed = work.table(placed.join(parts, "node"))
            if not mixed.isEmpty():
                found = self.joined(found, self.compare_groups(mixed))
        reached = found.join(known.select(F.col("class_id").alias("id"), "rep_id"), "id")
        lowest = work.table(reached.groupBy("component").agg(F.min("rep_id").alias("component_id")))
        named = reached.join(lowest, "component").select(F.col("id").alias("class_id"), "component_id")
        heads = work.table(known.join(named, "class_id", "left").select("sig", F.coalesce("component_id", "rep_id").alias("component_id")))
        out = self.rows.drop("tokens", "sketch").join(heads, "sig", "left")
        component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        return out.select(*(c for c in self.rows.columns if c not in ("sig", "tokens", "sketch")), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_shingles, component_id (the smallest id reachable), kept.

    Words are what white space parts, A-Z lower-cased. Documents link if 100 * |A & B| >= percent * |A | B| for their
    sets of ``shingle_words``-word shingles; a text with fewer words is one shingle; without words it links with
    nothing. Ids are of any type that has an order. Rows with a null id link with nothing, have a null component and are
    kept. Repeated rows are kept alike; one id with several texts links by each. An empty table gives an empty result;
    other columns are not read.

    Equal sets are one class. Ten independent trees branch each class by minwise tokens that the node selects: five
    levels, and up to two more where a node has over 16 classes. Nodes of up to 16 are compared exhaustively; in those
    that are large at the end, which hold copies of one text, all are compared with the most central one, and where that
    leaves more than one component, those outside the main one with all others, block by block. So a group of n copies
    costs about n comparisons and those that its outliers need, and no link that would join two components of a node is
    left out. Sketches leave out pairs five standard errors below the threshold; all others are compared on the words
    themselves, whole texts, no hashes. A pair at 80 % shares a five-level path of a tree with a chance of 0.77 and of
    any of the ten with about 0.99999; see tests for measured recall.
    """
    return _join(docs, id_col, text_col, shingle_words, percent).run()


def _join(docs: DataFrame, id_col: str, text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> _Join:
    return _Join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), shingle_words, percent)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` but those whose component has a smaller id, with all their columns, whatever these are called.

    What becomes of a row with an id that comes with several texts depends on its own text. Nulls, repeated and empty
    rows are as in :func:`near_duplicates`.
    """
    rows = as_rows(docs)
    mark = F.md5(F.coalesce(part(text_col).cast("string"), F.lit("")))
    join = _Join(rows.select(part(id_col).alias("doc_id"), mark.alias("mark"), part(text_col).cast("string").alias("text")), shingle_words, percent)
    gone = Workspace(docs.sparkSession, "near-gone").table(join.run().where("not kept").select(F.col("doc_id").alias("gone"), F.col("mark").alias("gone_mark")).distinct())
    join.work.clear()
    return unpacked(rows.join(broadcast_if_few(gone), (part(id_col) == F.col("gone")) & (mark == F.col("gone_mark")), "left_anti"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked groups of all documents by two-word shingles; nulls, ties and repeats as in :func:`near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n_shingles + b.n_shingles - k)),
g AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM n UNION SELECT g.v, r.c FROM r JOIN g ON g.u = r.id)
SELECT n.doc_id, n.n_shingles, min(r.c) AS component_id, n.doc_id = min(r.c) AS kept FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
