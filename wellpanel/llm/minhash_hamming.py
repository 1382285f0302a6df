"""Near-duplicate texts by a multi-index Hamming join over b-bit MinHash signatures.

A text's set holds its distinct five-word shingles.  ``INDEXED`` MinHash values of 16 bits form the indexed
signature, cut into ``CHUNKS`` chunks of ``CHUNK`` values.  Two signatures that differ in at most
``2 * CHUNKS - 1`` values agree, by pigeonhole, on some chunk but for at most one value; so every chunk is
entered under each of its single-value wildcards, which enumerates the allowed errors (none, or any one).
All pairs within that distance therefore share a bucket.  Pairs that share one are compared by their longer
signature, and those near enough are confirmed on the full sets.

Cost.  Texts with equal sets are one class.  A bucket is cut into blocks by size and weight, and blocks meet
in cells, so no task holds a whole bucket; each pair is handled in one cell only (its first shared wildcard).
A cell returns marks of its members or the edges of a spanning forest, never pairs, and skips pairs that are
already connected.  What remains quadratic is the comparison of signatures within one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellpanel.llm.components import components
from wellpanel.llm.groups import pairs_within, whole_groups
from wellpanel.llm.storage import staged, table, whole_row
from wellpanel.llm.words import distinct_shingles, mix64, word_groups

WIDTH = 5
CHUNKS, CHUNK = 8, 5
INDEXED = CHUNKS * CHUNK
LENGTH = 64
#: Signature distance up to which the indexed join is guaranteed to find a pair.
GUARANTEED = 2 * CHUNKS - 1
#: A pair exactly at the asked similarity may be lost before it is confirmed with this probability.
LOST = 1e-6
#: Members and shingles of a block; a cell holds two blocks.
BLOCK, BLOCK_WEIGHT = 256, 1 << 20
#: Bits of the filter that spares other texts the shuffle before sets are built.
FILTER_BITS = 1 << 23
#: Pairs of signatures that a task compares at once.
PAIRS_AT_ONCE = 1 << 17

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 1 << 63, LENGTH, dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, signature binary, slots array<long>"


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """LENGTH 16-bit MinHash values for each row that has shingles (rows without any stay zero)."""
    out = np.zeros((len(bounds) - 1, LENGTH), np.uint16)
    rows = np.flatnonzero(np.diff(bounds) > 0)
    if len(rows):
        starts = bounds[:-1][rows]
        for k in range(LENGTH):
            least = np.minimum.reduceat((sets ^ _XOR[k]) * _MULTIPLY[k], starts)
            out[rows, k] = (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def slots(signature: np.ndarray) -> np.ndarray:
    """INDEXED keys per row: each chunk with each of its values left out."""
    out = np.zeros((len(signature), INDEXED), np.uint64)
    wide = signature.astype(np.uint64)
    for chunk in range(CHUNKS):
        for hole in range(CHUNK):
            slot = chunk * CHUNK + hole
            key = np.full(len(signature), slot + 1, np.uint64)
            for k in range(CHUNK):
                if k != hole:
                    key = mix64(key ^ (wide[:, chunk * CHUNK + k] + np.uint64(k << 20)))
            out[:, slot] = key
    return out.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, words, bounds in word_groups(batch.column("text")):
            sets, at = distinct_shingles(words, bounds, WIDTH)
            counts = np.diff(at)
            full = np.flatnonzero(counts > 0)
            signature = signatures(sets, at)
            sums = np.zeros((2, last - first), np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(mix64(sets), at[:-1][full])
                sums[1, full] = np.add.reduceat(mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
            keys = slots(signature)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, last - first),
                    pa.array(counts.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    pa.array([row.tobytes() for row in signature], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(last - first + 1, dtype=np.int32) * INDEXED), pa.array(keys.ravel())),
                ],
                names=["doc_id", "n_shingles", "s1", "s2", "signature", "slots"],
            )


def _likely_sets(wanted: DataFrame):
    """Shingle sets of all wanted ids and few others, so that other texts are neither shuffled nor kept.

    The filter's FILTER_BITS bits are summed up by Spark; the driver sees at most FILTER_BITS / 32 numbers, whatever the
    table.  Filter and sets are one Python step: two in a stage would hold two workers a core.
    """
    words = (
        wanted.select(_place("rep")).groupBy(F.expr("shiftright(place, 5)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, place & 31))").alias("bits")).toArrow()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    shared = wanted.sparkSession.sparkContext.broadcast(bits)

    def likely_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = bits[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            for first, last, words, bounds in word_groups(batch.column("text")):
                sets, at = distinct_shingles(words, bounds, WIDTH)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
                    ],
                    names=["rep", "shingle_set"],
                )

    return likely_sets


def _place(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)).cast("int").alias("place")


def farthest(percent: int) -> int:
    """Pairs beyond the guaranteed distance are not confirmed if more than so many of all LENGTH values differ: 25 at
    85 percent, 30 at 80."""
    p, tail, at = 1 - percent / 100, 0.0, LENGTH
    while at > 0 and (tail := tail + comb(LENGTH, at) * p**at * (1 - p) ** (LENGTH - at)) < LOST:
        at -= 1
    return at


def _near_pairs(members: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and distances of the pairs that each cell answers for: near signatures, sizes that allow a link,
    and no earlier slot in common.  Pairs are formed ``PAIRS_AT_ONCE`` at a time."""
    signature = np.frombuffer(b"".join(members["signature"]), np.uint16).reshape(len(members), LENGTH)
    size, block, slot = (members[c].to_numpy() for c in ("n_shingles", "block", "slot"))
    across = (members["i"] != members["j"]).to_numpy()
    ratio, limit = percent / 100, farthest(percent)
    for a, b in pairs_within(members, BY_CELL, PAIRS_AT_ONCE):
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        able = (low >= ratio * high) & (~across[a] | (block[a] != block[b]))
        a, b = a[able], b[able]
        same = signature[a] == signature[b]
        distance = LENGTH - same.sum(axis=1)
        near = (distance <= limit) | (INDEXED - same[:, :INDEXED].sum(axis=1) <= GUARANTEED)
        a, b, same, distance = a[near], b[near], same[near, :INDEXED].reshape(-1, CHUNKS, CHUNK), distance[near]
        shared = (same.sum(axis=2)[:, :, None] - same >= CHUNK - 1).reshape(-1, INDEXED)
        mine = shared.argmax(axis=1) == slot[a] if len(a) else np.zeros(0, bool)
        yield a[mine], b[mine], distance[mine]


def _mark(percent: int):
    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in whole_groups(batches, BY_CELL):
            hit = np.zeros(len(members), bool)
            for a, b, _ in _near_pairs(members, percent):
                hit[a] = hit[b] = True
            yield members[hit]

    return mark


def _confirm(percent: int):
    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for members in whole_groups(batches, BY_CELL):
            sets = [np.frombuffer(x, np.uint64) for x in members["shingle_set"]]
            rep = members["rep"].to_numpy()
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            edges = []
            for a, b, distance in _near_pairs(members, percent):
                for k in np.argsort(distance, kind="stable"):
                    x, y = int(a[k]), int(b[k])
                    p, q = root(int(rep[x])), root(int(rep[y]))
                    if p == q:
                        continue
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        parent[p] = q
                        edges.append((rep[x], rep[y]))
            yield pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return confirm


BY_CELL = ["bucket", "slot", "i", "j"]
CELL = "bucket long, slot int, i int, j int, block int, rep long, n_shingles long, signature binary"
CELL_COLUMNS = [c.split()[0] for c in CELL.split(", ")]


def _by_cell(rows: DataFrame) -> DataFrame:
    """The members of a cell follow each other within one partition."""
    return rows.repartition(*BY_CELL).sortWithinPartitions(*BY_CELL, "rep").select(*CELL_COLUMNS, *[c for c in rows.columns if c not in CELL_COLUMNS])


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Links join texts with ``100 * |A and B| >= percent * |A or B|`` over their distinct five-word shingles; a
    component is named by its smallest id.  The signature's guarantee is meant for ``percent`` of 80 or more.

    Defined cases: null, empty and wordless texts have 0 shingles and are linked with nothing; fewer than five
    words are one shingle; repeated rows (same id) get the same answer each, and rows of one id with different sets
    are linked by their own sets; a null id keeps its row, with a null
    component and ``kept`` true, and takes part in no link; an empty table gives an empty result.  Columns other
    than the two named are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = staged(narrow.mapInArrow(_sketch, SKETCH), "sketch")
    several = staged(_several_sets(sketch), "several")
    if not several.isEmpty():  # ids that stand for more than one set: name each set apart, then name back
        apart = _named_apart(narrow, several)
        found = _linked(apart.select(F.col("name").alias("doc_id"), "text"), percent)
        own = apart.select("name", F.col("doc_id").alias("own_id")).filter("name is not null").distinct()
        rows = staged(found.join(own, found["doc_id"] == own["name"], "left").drop("name"), "rows")
        least = rows.groupBy("component_id").agg(F.min("own_id").alias("least"))
        return rows.join(least, "component_id", "left").select(
            F.col("own_id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), F.col("least").eqNullSafe(F.col("own_id")).alias("kept")
        )
    return _linked(narrow, percent, sketch)


KEY = ["n_shingles", "s1", "s2"]


def _several_sets(sketch: DataFrame) -> DataFrame:
    """Ids whose rows do not all have one shingle set."""
    sets = F.struct(*KEY)
    return sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.min(sets).alias("first"), F.max(sets).alias("last")).filter("first <> last").select("doc_id")


def _named_apart(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows(doc_id, text, ...)`` with ``name``: the id, or a fresh one for each text of an id in ``several``."""
    narrow = rows.select("doc_id", "text")
    texts = narrow.join(several, "doc_id", "left_semi").select("doc_id", "text").distinct()
    ends = narrow.agg(F.max("doc_id").alias("top"), F.min("doc_id").alias("bottom")).first()
    step, base = (1, ends.top) if ends.top < (1 << 62) else (-1, ends.bottom)
    # a place per distinct text of the few repeated ids, kept so that a retried task sees the same one
    placed = staged(texts.select("*", F.monotonically_increasing_id().alias("place")), "places")
    fresh = placed.select(F.col("doc_id").alias("of"), F.col("text").alias("of_text"), (base + step * (F.col("place") + 1)).alias("fresh"))
    same = (F.col("doc_id") == F.col("of")) & F.col("text").eqNullSafe(F.col("of_text"))
    return rows.join(fresh, same, "left").select(*rows.columns, F.coalesce("fresh", "doc_id").alias("name"))


def _linked(narrow: DataFrame, percent: int, sketch: DataFrame | None = None) -> DataFrame:
    """:func:`near_duplicates` of ``narrow(doc_id, text)``, where rows of one id have one shingle set."""
    sketch = staged(narrow.mapInArrow(_sketch, SKETCH), "sketch") if sketch is None else sketch
    key = KEY
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = staged(
        known.groupBy(*key).agg(F.min_by(F.struct("signature", "slots"), "doc_id").alias("of"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        .select(*key, "rep", "copies", "of.signature", "of.slots"),
        "classes",
    )
    entries = classes.select("rep", "n_shingles", F.posexplode("slots").alias("slot", "bucket"))
    crowded = (
        entries.groupBy("bucket")
        .agg(F.count("*").alias("members"), F.sum("n_shingles").alias("weight"))
        .filter("members > 1")
        .select("bucket", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("weight") / BLOCK_WEIGHT)).cast("int").alias("blocks"))
    )
    members = staged(entries.join(crowded, "bucket"), "members")
    block = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("blocks")).cast("int")
    cells = (
        members.withColumn("block", block)
        .join(classes.select("rep", "signature"), "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "slot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n_shingles", "signature")
    )
    marked = staged(_by_cell(cells).mapInPandas(_mark(percent), CELL), "marked")
    wanted = staged(marked.select("rep").distinct(), "wanted")
    likely = narrow.filter("doc_id is not null").select("*", _place("doc_id")).mapInArrow(_likely_sets(wanted), "rep long, shingle_set binary")
    sets = staged(likely.join(wanted, "rep", "left_semi").dropDuplicates(["rep"]), "sets")
    links = _by_cell(marked.join(sets, "rep")).mapInPandas(_confirm(percent), "a long, b long")
    linked = components(links)
    named = (
        classes.join(linked, classes["rep"] == linked["node"], "left")
        .filter("copies > 1 or component is not null")
        .select(*key, F.coalesce("component", "rep").alias("component"))
    )
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return (
        sketch.select("doc_id", *key)
        .join(named, key, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates at ``percent``; rows without an id stay.

    Columns may have any names.  Rows that share an id but differ in their shingle sets are documents of their own:
    each stays unless it is a duplicate of another.  The ids that go are stored first, so that their size decides how
    they are joined.  Names that stand on several rows are handled apart, and only if there are any.
    """
    rows = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    narrow = rows.select("doc_id", "text")
    sketch = staged(narrow.mapInArrow(_sketch, SKETCH), "sketch")
    several = staged(_several_sets(sketch), "several")
    if several.isEmpty():
        found = _linked(narrow, percent, sketch)
        named = rows.select("row", F.col("doc_id").alias("name"))
    else:
        named = _named_apart(rows, several)
        found = _linked(named.select(F.col("name").alias("doc_id"), "text"), percent)
    ids = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("name")).agg(F.max("kept").alias("kept"), F.count("*").alias("times")).filter("not kept or times > 1")
    ids = staged(ids, "unkept")
    gone = staged(ids.filter("not kept").select("name"), "gone")
    stay = named.join(gone, "name", "left_anti")
    repeated = staged(ids.filter("kept").select("name"), "repeated")
    if repeated.isEmpty():
        return stay.select("row.*")
    once = stay.join(repeated, "name", "left_semi").groupBy("name").agg(F.min_by("row", F.struct("text", F.to_json("row"))).alias("row"))
    return stay.join(repeated, "name", "left_anti").select("row").unionAll(once.select("row")).select("row.*")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words),
sized AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  WITH RECURSIVE r(node, via) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, e.b FROM r JOIN both_ways e ON e.a = r.via)
  SELECT node, min(via) AS component FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN reach ON node = d.doc_id
"""
