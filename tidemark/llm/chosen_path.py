"""Near-duplicate classes by a chosen-path set similarity join.

A document is the set of its distinct four-word shingles. In each of TREES independent trees a document walks down by
selected tokens: at every level the token of least hash under the path so far, so two documents of similarity s take
the same step with probability s. Documents that meet at BASE levels form a node. Every member is compared with its
node's least document; links found give classes, and only pairs of different classes are left to compare. Nodes of at
most LEAF members list those pairs. Nodes whose sets fit a task are compared there exhaustively, by counting shared
shingles over the members outside of the largest class; only links that join two classes leave the task. Larger nodes
branch on, each document into two children a level, so that a similar pair still meets in some leaf; a leaf that is
still too large is compared block by block. Every link is confirmed on full sets. With 20 trees a pair at similarity
0.8 is missed with probability below 1e-6, and a class only if it hangs on missed pairs.

Equal sets are one vertex, so copies cost nothing after the first pass. Hot keys are spread over salted copies, links
and classes stay in tables of the shared folder, and classes are found by contraction of the link graph in rounds that
grow with the logarithm of its size.

A row is judged by its own text: rows that share an id, or have none, are linked if their sets are, and by nothing
else. A null doc_id counts as the largest id; a class of such rows only has the null component_id, and all of them are
`kept` in the digest. Null texts, and texts without words, have no shingles and no links. An empty table gives an empty
result. Only doc_id and text are read; keep_one_of_each() passes other columns, of any name, through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ._common import arrow_map, bounded_batches, release, salted_join, text_of, through_table, trim

SHINGLE_WORDS, TREES, BASE, BRANCHES, LEAF = 4, 20, 3, 2, 16
#: Shingles of the sets that are compared in one task at a time.
NODE_SHINGLES = 400_000
LINK_NUMERATOR, LINK_DENOMINATOR = 80, 100
_NO_ID = (1 << 63) - 1
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _Q
        h = (h ^ (h >> np.uint64(27))) * _P
        return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle codes (64-bit) of each text; words are told apart once for all texts."""
    words = [t.encode().lower().split() for t in texts]
    flat = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
    code = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    codes = code[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            own, at = codes[at : at + len(ws)], at + len(ws)
            if not len(own):
                out.append(own)
                continue
            width = min(size, len(own))
            h = np.full(len(own) - width + 1, width if width < size else 0, np.uint64)
            for k in range(width):
                h = _mix(h * _P + own[k : len(own) - width + 1 + k])
            out.append(np.unique(h))
    return out


def set_code(codes: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return xxhash.xxh3_128_digest(codes.tobytes())


def _step(low: np.ndarray, path: np.ndarray) -> np.ndarray:
    """For each path the code of the token with the least hash under it."""
    out = np.empty(len(path), np.uint64)
    rows = max(1, 2_000_000 // max(1, len(low)))
    with np.errstate(over="ignore"):
        for k in range(0, len(path), rows):
            part = path[k : k + rows]
            h = (low[None, :] ^ (part & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None]) * _A
            h ^= h >> np.uint32(15)
            h += (part >> np.uint64(32)).astype(np.uint32)[:, None]
            h *= _B
            h ^= h >> np.uint32(13)
            out[k : k + rows] = h.argmin(1)
    return out


def _walk(codes: np.ndarray, low: np.ndarray, path: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = _mix(path + np.uint64(salt) * _Q)
        return _mix(path * _P + codes[_step(low, seed).astype(np.int64)])


def base_keys(codes: np.ndarray) -> np.ndarray:
    """The node of a set in each tree, after BASE levels."""
    low = (codes ^ (codes >> np.uint64(32))).astype(np.uint32)
    path = _mix(np.arange(1, TREES + 1, dtype=np.uint64))
    for level in range(BASE):
        path = _walk(codes, low, path, level)
    return path


def leaf_keys(codes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The leaves below each base node, two levels down with BRANCHES children each: shape (nodes, leaves)."""
    low = (codes ^ (codes >> np.uint64(32))).astype(np.uint32)
    path = base[:, None]
    for level in range(2):
        path = np.concatenate([_walk(codes, low, path.ravel(), 1000 + 10 * level + b).reshape(path.shape) for b in range(BRANCHES)], 1)
    return path


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two full sets link."""
    if not len(a) or not len(b) or LINK_DENOMINATOR * min(len(a), len(b)) < LINK_NUMERATOR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LINK_DENOMINATOR * both >= LINK_NUMERATOR * (len(a) + len(b) - both)


def _identity() -> list:
    """doc_id (null as the largest) and twin, the text's hash: rows equal in both are copies in every respect."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64(text_of()).alias("twin")]


def shingled(docs: DataFrame) -> DataFrame:
    """doc_id, twin, n_shingles, code (of the set; null where it is empty) and the base keys of every row."""
    bounded_batches(docs.sparkSession)

    def run(batch):
        sets = shingle_sets(batch.column(2).to_pylist())
        code = [set_code(s) if len(s) else None for s in sets]
        keys = [base_keys(s).view(np.int64) if len(s) else [] for s in sets]
        columns = [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "twin", "n_shingles", "code", "keys"])

    return arrow_map(docs, run, "doc_id long, twin long, n_shingles long, code binary, keys array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), a table, those that link on full sets; texts (id, text) is a table. Many pairs may share an a."""
    bounded_batches(pairs.sparkSession)
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pivots = through_table(texts.withColumnRenamed("id", "a").join(counts, "a").withColumnRenamed("text", "left"), "pivot-texts")
    sides = salted_join(pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b"), pivots, "a", "n")

    def run(batch):
        a, b, left, right = (batch.column(k).to_pylist() for k in range(4))
        place: dict[str, int] = {}
        for t in (*left, *right):
            place.setdefault(t, len(place))
        sets = shingle_sets(list(place))
        good = pa.array([similar(sets[place[x]], sets[place[y]]) for x, y in zip(left, right, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(good)

    return arrow_map(sides.select("a", "b", "left", "right"), run, "a long, b long")


def _crossing(nodes: DataFrame, label: DataFrame) -> DataFrame:
    """Members (key, id, size) of nodes that hold several classes, a table with class and the node's n and weight."""
    own = nodes.join(label.withColumnRenamed("id", "_v"), F.col("id") == F.col("_v"), "left").select("key", "id", "size", F.coalesce("class", "id").alias("class"))
    own = through_table(own, "members")
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.min("class").alias("_least"), F.max("class").alias("_most"))
    sizes = through_table(sizes.where("_least != _most").drop("_least", "_most"), "node-sizes")
    return through_table(salted_join(own, sizes, "key", "n"), "crossing")


def _small_pairs(members: DataFrame) -> DataFrame:
    """All pairs of different classes in nodes of at most LEAF members."""
    small = members.where(F.col("n") <= LEAF)
    other = small.select("key", F.col("id").alias("b"), F.col("class").alias("class_b"))
    return small.select("key", F.col("id").alias("a"), "class").join(other, "key").where("a < b and class != class_b").select("a", "b").distinct()


def _blocks(members: DataFrame) -> DataFrame:
    """Members of heavy leaves dealt to groups (key) that hold two blocks of a leaf each; all pairs of blocks occur."""
    count = F.ceil(2 * F.col("weight") / NODE_SHINGLES).cast("int")
    own = members.withColumn("_all", count).withColumn("_own", F.pmod(F.xxhash64("id"), "_all").cast("int"))
    dealt = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_all") - 1)))
    return dealt.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), "id", "class")


def joining_links(ids: list[int], own_class: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between members of different classes, enough of them to join all classes that have any."""
    members = len(ids)
    size = np.array([len(s) for s in sets], np.int64)
    _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(members), size)
    order = np.argsort(shingle, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(df)])
    names, local = np.unique(np.array(own_class), return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    largest, at, out = int(np.bincount(local).argmax()), np.concatenate([[0], np.cumsum(size)]), []
    for i in np.flatnonzero(local != largest).tolist():
        own = shingle[at[i] : at[i + 1]]
        own = own[df[own] > 1]
        n = df[own]
        if not len(n):
            continue
        entry = np.repeat(begin[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(posting[entry], minlength=members)
        for j in np.flatnonzero((LINK_DENOMINATOR * both >= LINK_NUMERATOR * (size + size[i] - both)) & (local != local[i])).tolist():
            x, y = root(int(local[i])), root(int(local[j]))
            if x != y:
                parent[x] = y
                out.append((ids[i], ids[j]))
    return out


def _compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join classes within each group of members (key, id, class), each of bounded weight."""
    bounded_batches(members.sparkSession)
    rows = members.select("key", "id", "class").join(texts, "id").select("key", "id", "class", "text")
    sorted_rows = rows.repartition("key").sortWithinPartitions("key")

    def links(held: list[tuple]) -> pa.RecordBatch:
        place: dict[str, int] = {}
        for r in held:
            place.setdefault(r[3], len(place))
        sets = shingle_sets(list(place))
        out, first = [], 0
        for k in range(1, len(held) + 1):
            if k == len(held) or held[k][0] != held[first][0]:
                group = held[first:k]
                out += joining_links([r[1] for r in group], [r[2] for r in group], [sets[place[r[3]]] for r in group])
                first = k
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], names=["a", "b"])

    def run(batches):
        release()
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(held) >= 500 and row[0] != held[-1][0]:
                    yield links(held)
                    held = []
                held.append(row)
        if held:
            yield links(held)
        held = []
        trim()

    return sorted_rows.mapInArrow(run, "a long, b long")


def classified(docs: DataFrame) -> DataFrame:
    """doc_id (null as the largest), twin, n_shingles and class of every row: the class is a long that rows share if
    their sets are equal or linked over others; it is null where the set is empty. `first_id` and `first_twin` name the
    first row of the class."""
    own = docs.select(*_identity(), text_of().alias("text"))
    rows = through_table(shingled(own), "shingled")
    each = rows.where("code is not null").groupBy("code").agg(F.min(F.struct("doc_id", "twin")).alias("first"), F.count(F.lit(1)).alias("n"))
    # one vertex for each set, numbered as the table is written
    sets = through_table(each.select(F.monotonically_increasing_id().alias("id"), "code", "first", "n"), "sets")

    # nodes of one vertex are left out
    vertex = sets.select("id", "code", F.col("first.doc_id").alias("doc_id"), F.col("first.twin").alias("twin"))
    firsts = rows.join(vertex, ["code", "doc_id", "twin"])
    nodes = through_table(firsts.select("id", F.col("n_shingles").alias("size"), F.explode("keys").alias("key")).distinct(), "nodes")
    sizes = through_table(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1"), "node-sizes")
    nodes = through_table(salted_join(nodes, sizes, "key", "n"), "shared-nodes")
    wanted = vertex.join(nodes.select("id").distinct(), "id", "left_semi").select("id", "doc_id", "twin")
    once = Window.partitionBy("id").orderBy("doc_id")
    texts = own.join(wanted, ["doc_id", "twin"]).withColumn("_k", F.row_number().over(once)).where("_k = 1").select("id", "text")
    texts = through_table(texts, "texts")

    star = through_table(nodes.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    links = through_table(_confirmed(star, texts), "confirmed")
    label = components(links)

    members = _crossing(nodes.select("key", "id", "size"), label)
    heavy = (F.col("n") > LEAF) & (F.col("weight") > NODE_SHINGLES)
    groups = members.where((F.col("n") > LEAF) & ~heavy).select("key", "id", "class")
    pairs = _small_pairs(members)
    branching = members.where(heavy)
    if not branching.isEmpty():
        below = _crossing(_leaves(branching, texts), label)
        pairs = pairs.unionAll(_small_pairs(below))
        groups = groups.unionAll(below.where((F.col("n") > LEAF) & ~heavy).select("key", "id", "class")).unionAll(_blocks(below.where(heavy)))
    found = _confirmed(through_table(pairs.distinct(), "small-pairs"), texts).unionAll(_compared(groups, texts))
    links = through_table(links.unionAll(found), "confirmed")
    label = components(links)

    # the first row of each class of several sets; other sets are classes of their own
    joined = through_table(sets.join(label, "id").select("class", "first", "id"), "joined-sets")
    lead = through_table(joined.groupBy("class").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("n")), "leads")
    led = salted_join(joined.select("class", "id"), lead, "class", "n").select("id", "class", "lead")
    named = sets.join(led, "id", "left").select("code", "n", F.coalesce("class", "id").alias("class"), F.coalesce("lead", "first").alias("lead"))
    worded = salted_join(rows.where("code is not null").select("doc_id", "twin", "n_shingles", "code"), through_table(named, "named-sets"), "code", "n")
    out = worded.select("doc_id", "twin", "n_shingles", "class", F.col("lead.doc_id").alias("first_id"), F.col("lead.twin").alias("first_twin"))
    wordless = rows.where("code is null").select("doc_id", "twin", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("first_id"), F.col("twin").alias("first_twin"))
    return out.unionAll(wordless)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    back = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return classified(docs).select(back("doc_id").alias("doc_id"), "n_shingles", back("first_id").alias("component_id"), (F.col("doc_id") == F.col("first_id")).alias("kept"))


def _leaves(branching: DataFrame, texts: DataFrame) -> DataFrame:
    """key, id and size of the leaves below the given (key, id, size) nodes."""
    bounded_batches(branching.sparkSession)
    own = branching.groupBy("id").agg(F.first("size").alias("size"), F.collect_set("key").alias("keys")).join(texts, "id").select("id", "size", "keys", "text")

    def run(batch):
        ids, sizes, keys = [], [], []
        for i, size, base, codes in zip(*(batch.column(k).to_pylist() for k in range(3)), shingle_sets(batch.column(3).to_pylist()), strict=True):
            got = np.unique(leaf_keys(codes, np.array(base, np.int64).view(np.uint64))).view(np.int64)
            keys.append(got)
            ids.append(np.full(len(got), i))
            sizes.append(np.full(len(got), size))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, ids, sizes)], names=["key", "id", "size"])

    return arrow_map(own, run, "key long, id long, size long")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that are linked with or equal to an earlier one: one row of each
    class stays, that of lowest doc_id (null last, then by the text's hash), and every row without words."""
    first = classified(docs).where("class is not null and doc_id = first_id and twin = first_twin").select("doc_id", "twin").distinct()
    packed = docs.select(F.struct("*").alias("row"), *_identity(), F.trim(F.regexp_replace(text_of(), r"[\x09-\x0D]", " ")) == "")
    row, doc_id, twin, wordless = packed.columns
    packed = packed.withColumnRenamed(wordless, "wordless")
    once = Window.partitionBy("doc_id", "twin").orderBy("wordless")
    worded = packed.where("not wordless").join(first, ["doc_id", "twin"], "left_semi").withColumn("_k", F.row_number().over(once)).where("_k = 1")
    return worded.select("row").unionAll(packed.where("wordless").select("row")).select("row.*")


#: The same rows by a join of all shingles and a recursive walk over the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w
), sized AS (
  SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets
), each AS (
  SELECT doc_id, n, unnest(s) AS g FROM sized
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(id, v) AS (
  SELECT doc_id, doc_id FROM sized UNION SELECT r.id, l.y FROM reach r JOIN links l ON r.v = l.x
), least AS (
  SELECT id, min(v) AS c FROM reach GROUP BY 1
)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM sized JOIN least ON id = doc_id
"""
