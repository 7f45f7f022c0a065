"""MinHash near-dedup with sequential Bayesian verification.

A document's set is its distinct five-word shingles (64-bit hashes); equal sets form one class. Classes get 128
min-hashes: 32 bands of four name the buckets of candidates, one byte of each hash is kept as signature. A candidate
pair's signatures are compared in batches of 16; after each batch the pair is dropped when the posterior probability
(uniform prior) of a similarity of at least ``threshold`` is below ``miss``. Survivors are confirmed on the full sets
with integers, so every link is exact.

Pairs come from buckets without pairing a group with itself. Every bucket has one pivot, the member that shares buckets
with the most others, and each member is compared with the pivots of its buckets: posterior pruning, then the full sets.
The comparison also leaves the member's *difference* to the pivot: which of the pivot's shingles it lacks, and which it
has besides. Confirmed links merge components. Where the members of a pivot still lie in several components, the pairs
across components are judged from the differences alone, since both sets follow from them: |x ∩ y| is what of the pivot
neither lacks, plus the extras they share. Pairs that cannot reach the threshold even if all they can share were shared
go first (a member's own edits are nearly its alone), then those that the posterior rules out; the rest are exact. Near
copies differ in a few shingles, so no full set is shipped twice. Large groups are dealt as pairs of blocks. No bucket,
partner list or candidate list is capped. At the threshold itself a pair shares no band with probability
(1 - 0.75⁴)³² ≈ 5·10⁻⁶.

Defined results: null and wordless texts have an empty set and are linked with nothing; texts with fewer words than a
shingle have the whole sequence as their one shingle; rows with equal id and text get equal results; when one id has
several texts each row has its own text's component; null ids count as larger than all others; an empty table stays
empty; extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import free_name, table
from trialweave.runtime import pin

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
_RNG = np.random.default_rng(20240501)
MULTIPLY = (_RNG.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word → 64-bit hash, emptied when it grows beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. Words: maximal runs without ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * PLACE[k]
    return np.unique(_mix(total))


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """HASHES minima of 32-bit multiply-add hashes of the folded shingles."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 512):
        part = folded[i : i + 512, None] * MULTIPLY + ADD
        part ^= part >> np.uint32(16)
        part *= np.uint32(0x9E3779B1)
        low = np.minimum(low, part.min(axis=0))
    return low


def _sketches(rows: DataFrame, size: int) -> DataFrame:
    """(id, text) → id, n, cls (hash of the whole set, null for an empty one), bands, sig."""
    schema = f"id {rows.schema['id'].dataType.simpleString()}, th bigint, n bigint, cls binary, bands array<bigint>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, cls, bands, sig = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingle_set(text, size, known)
                    n.append(len(s))
                    if not len(s):
                        cls.append(None), bands.append(None), sig.append(None)
                        continue
                    low = min_hashes(s)
                    cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                    quads = low.reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.full(BANDS, 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
                    for r in range(ROWS):
                        key = _mix(key ^ quads[:, r] * PLACE[r])
                    bands.append(key.view(np.int64))
                    sig.append((low & np.uint32(0xFF)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=["id", "th", "n", "cls", "bands", "sig"])

    return rows.mapInArrow(run, schema)


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch of hashes, the fewest matches with which P(similarity ≥ threshold | matches) is at least ``miss``."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() >= miss * p.sum():
                out.append(m)
                break
    return out


def unpruned(left: np.ndarray, right: np.ndarray, need: list[int]) -> np.ndarray:
    """Rows of two signature arrays that the posterior does not rule out, batch by batch."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for i, m in enumerate(need):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= m]
    return alive


MEMBER = "p binary, cls binary, n bigint, shared bigint, size_p bigint, linked boolean, lacks binary, extra binary, sig binary"


def _compare(pairs: DataFrame, percent: int, need: list[int]) -> DataFrame:
    """(p, cls, set_p, set_cls, sig_p, sig_cls) → MEMBER: whether the pair is linked, and the difference of cls to its pivot p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets, sigs = ([part.column(c).to_pylist() for c in names] for names in (("set_p", "set_cls"), ("sig_p", "sig_cls")))
                near = np.zeros(part.num_rows, bool)
                near[unpruned(*(np.frombuffer(b"".join(x), np.uint8).reshape(-1, HASHES) for x in sigs), need)] = True
                n, shared, size, lacks, extra = [], [], [], [], []
                for x, y in zip(*sets):
                    p, own = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.minimum(np.searchsorted(p, own), len(p) - 1)
                    has = p[at] == own
                    gone = np.ones(len(p), bool)
                    gone[at[has]] = False
                    n.append(len(own)), shared.append(int(has.sum())), size.append(len(p))
                    lacks.append(np.flatnonzero(gone).astype(np.int32).tobytes()), extra.append(own[~has].tobytes())
                n, shared, size = (np.array(x, np.int64) for x in (n, shared, size))
                linked = near & ((100 + percent) * shared >= percent * (n + size))
                yield pa.RecordBatch.from_arrays([part.column("p"), part.column("cls"), *(pa.array(x) for x in (n, shared, size, linked)), *(pa.array(x, pa.binary()) for x in (lacks, extra)), part.column("sig_cls")], names=["p", "cls", "n", "shared", "size_p", "linked", "lacks", "extra", "sig"])

    return pairs.select("p", "cls", "set_p", "set_cls", "sig_p", "sig_cls").mapInArrow(run, MEMBER)


def across_components(members: pa.Table, percent: int, need: list[int]) -> list[tuple[int, int]]:
    """Links between members of one pivot that join components, from their differences to it; enough of them to join all that belong together."""
    n, shared = members.column("n").to_numpy(), members.column("shared").to_numpy()
    size = int(members.column("size_p")[0].as_py())
    names, comp = np.unique(np.array(members.column("comp").to_pylist(), object), return_inverse=True)
    sig = np.frombuffer(b"".join(members.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    lacks = [np.frombuffer(x, np.int32) for x in members.column("lacks").to_pylist()]
    extra = [np.frombuffer(x, np.uint64) for x in members.column("extra").to_pylist()]
    owner = np.repeat(np.arange(len(n)), [len(x) for x in extra])
    _, which, times = np.unique(np.concatenate(extra), return_inverse=True, return_counts=True)
    common = np.bincount(owner[times[which] > 1], minlength=len(n))  # extras that another member has too
    main = np.bincount(comp).argmax()
    other = np.flatnonzero(comp != main)
    parent = np.arange(len(names))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    links = []
    rest = np.ones(len(n), bool)
    for i in other:
        rest[i] = False  # each pair once: the main component with all others, and the others among themselves
        most = np.minimum(shared, shared[i]) + np.minimum(common, common[i])
        j = np.flatnonzero(rest & (comp != comp[i]) & ((100 + percent) * most >= percent * (n + n[i])))
        if len(j):
            j = j[unpruned(sig[j], np.broadcast_to(sig[i], (len(j), HASHES)), need)]
        for k in j:
            if root(comp[i]) == root(comp[k]):
                continue
            both = size - len(lacks[i]) - len(lacks[k]) + len(np.intersect1d(lacks[i], lacks[k], assume_unique=True)) + len(np.intersect1d(extra[i], extra[k], assume_unique=True))
            if (100 + percent) * both >= percent * (n[i] + n[k]):
                parent[root(comp[i])] = root(comp[k])
                links.append((int(i), int(k)))
    return links


def _attach(pairs: DataFrame, values: DataFrame, names: list[str], side: str, other: str, spread: int = 64) -> DataFrame:
    """Add the values of the class named in ``side``. A class named by many pairs has its row copied once per ``spread`` pairs."""
    copies = pin(pairs.groupBy(side).agg(F.ceil(F.count(F.lit(1)) / spread).cast("int").alias("_copies")))
    rows = values.join(copies, values["cls"] == copies[side]).select(copies[side], *[F.col(v).alias(f"{v}_{side}") for v in names], "_copies")
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    dealt = pairs.join(copies, side).withColumn("_part", F.pmod(F.xxhash64(other), F.col("_copies")).cast("int"))
    return dealt.drop("_copies").join(rows.drop("_copies"), [side, "_part"]).drop("_part")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node of each connected component, by alternating large-star and small-star steps.

    Edges shrink to stars; each step is a minimum per node and a join, and a node with very many neighbours is
    reduced before the shuffle.
    """
    now = pin(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = pin(both.where("v > u").join(pin(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = pin(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = pin(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _resolve(members: DataFrame, percent: int, need: list[int], block: int) -> DataFrame:
    """(a, b): links across components, per pivot; a pivot of more than ``block`` members is dealt as pairs of blocks."""
    many = pin(members.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks")))
    own = F.pmod(F.xxhash64("cls"), F.col("_blocks")).cast("int")
    dealt = members.join(many, "p").withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumns({"_low": F.least("_own", "_with"), "_high": F.greatest("_own", "_with")}).drop("_blocks", "_own", "_with")

    def run(group: pa.Table) -> pa.Table:
        links = across_components(group, percent, need)
        at = [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)]
        return pa.Table.from_arrays([group.column("cls").take(i) for i in at], names=["a", "b"])

    return dealt.groupBy("p", "_low", "_high").applyInArrow(run, "a binary, b binary")


def link_classes(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], threshold: float, miss: float, block: int = 4096) -> DataFrame:
    """(cls, comp) of every class that has a link. ``classes``: cls, n, bands, sig; ``sets_of``: (cls) → (cls, set)."""
    percent, need = round(100 * threshold), least_matches(threshold, miss)
    at = classes.select("cls", F.explode("bands").alias("bucket"))
    shared = pin(at.groupBy("bucket").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
    open_ = pin(at.join(shared, "bucket"))
    hubs = pin(open_.groupBy("cls").agg(F.sum("many").alias("met")))  # who shares buckets with the most others leads
    lead = pin(open_.join(hubs, "cls").groupBy("bucket").agg(F.max(F.struct("met", "cls")).alias("_l")).select("bucket", F.col("_l.cls").alias("p")))
    pairs = pin(open_.select("bucket", "cls").join(lead, "bucket").where("p <> cls").select("p", "cls").distinct())
    values = pin(sets_of(hubs.select("cls")).join(classes.select("cls", "sig"), "cls"))
    sided = _attach(_attach(pairs, values, ["set", "sig"], "p", "cls"), values, ["set", "sig"], "cls", "p")
    members = pin(_compare(sided, percent, need))
    links = members.where("linked").select(F.col("p").alias("a"), F.col("cls").alias("b"))
    comp = pin(components(links))
    # every member with its component, the pivots too; only pivots whose members lie in several components go on
    pivots = members.select("p", "size_p").distinct().join(classes.select(F.col("cls").alias("p"), "sig"), "p")
    pivots = pivots.select("p", F.col("p").alias("cls"), F.col("size_p").alias("n"), F.col("size_p").alias("shared"), "size_p", F.lit(True).alias("linked"), F.unhex(F.lit("")).alias("lacks"), F.unhex(F.lit("")).alias("extra"), "sig")
    every = pin(members.unionByName(pivots).join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    mixed = pin(every.groupBy("p").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("p"))
    more = pin(_resolve(every.join(mixed, "p"), percent, need, block))
    if not more.isEmpty():  # links between components: only these are merged anew
        of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
        ends = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = pin(components(pin(ends)))
        moved = comp.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("_to")), "comp", "left")
        comp = pin(moved.select("node", F.coalesce("_to", "comp").alias("comp")).unionByName(joined))
    return comp.select(F.col("node").alias("cls"), "comp").unionByName(comp.select(F.col("comp").alias("cls"), "comp").distinct())


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(cls, text) → (cls, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, size, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=["cls", "set"])

    return docs.mapInArrow(run, "cls binary, set binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.75, miss: float = 1e-6) -> DataFrame:
    """One row per document: id, th (hash of its text), n_shingles, component_id. ``miss`` is the chance that a link is pruned unseen."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    sketch = pin(_sketches(rows, shingle))
    some = sketch.where(F.col("cls").isNotNull())
    classes = pin(some.groupBy("cls").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """Full sets from one document per class; texts are read again, and only those of candidates are kept."""
        keys = pin(classes.join(wanted, "cls").select("cls", F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th")))
        # the candidates grow with the corpus: texts are dealt by document at every size
        texts = rows.join(keys.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
        return _full_sets(texts.select("cls", "text"), shingle).groupBy("cls").agg(F.first("set").alias("set"))

    linked = link_classes(classes, sets_of, threshold, miss)
    owned = pin(classes.select("cls", "rep").join(linked, "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "rep"))
    heads = pin(owned.groupBy("comp").agg(F.min("rep").alias("head")))
    named = pin(owned.join(heads, "comp").select("cls", F.col("head.id").alias("component_id"), F.lit(True).alias("_has")))
    out = sketch.join(named, "cls", "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.when(F.col("_has"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id; rows equal in id and text stay once."""
    found = near_duplicates(docs, id_col, text_col, **options).where(F.col("id").eqNullSafe(F.col("component_id")))
    times, kid, kth = (free_name(docs, n) for n in ("_times", "_kid", "_kth"))
    kept = pin(found.groupBy("id", "th").agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias(times)))
    kept = kept.select(F.col("id").alias(kid), F.col("th").alias(kth), F.when(F.col("n") == 0, 1).otherwise(F.col(times)).alias(times))
    rows = docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(F.col(kid)) & (F.xxhash64(docs[text_col]) == F.col(kth))).drop(kid, kth)
    if kept.where(F.col(times) > 1).isEmpty():
        return rows.drop(times)
    return rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([id_col, text_col])).drop(times)


@query("op5_near_dedup")
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
