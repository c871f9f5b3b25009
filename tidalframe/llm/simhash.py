"""Operator 3: SimHash near-duplicates with pigeonring candidates.

A fingerprint has 64 bits in a ring of five segments. For two fingerprints that differ in at most 4
bits, some chain of consecutive segments keeps to its share all along: no difference in its first
segment, 1 at most in two, 2 in three, 3 in four. Candidates are joined on the first segment and on
pieces of the following ones that must then be equal; the chain test prunes them before the full
Hamming check. How many pieces the key takes follows from the number of fingerprints, so chance
candidates stay few at any size, and every choice finds every link.

Equal fingerprints are one node. In each bucket of candidates all members are held against the least
one; only members that don't link with it are held against the rest. A dense bucket thus gives about
one link a member, not all pairs, and the components are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, dropped, written
from .components import components
from .hash_sql import xxh64_ctes

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (offset, bits) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: (segments of the chain in the key, pieces that the later ones are cut into), least keys first.
PLANS = ((1, 0), (2, 2), (3, 4), (4, 6))
#: Chance candidates of a fingerprint that a plan may lead to.
CHANCE = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; 0 for a text without words, or null."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        starts = [0, *[s + 1 for s in spaces]]
        ends = [*spaces, len(joined)][shingle - 1 :]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=False)])
    n = len(digests) // 8
    counts = np.zeros(64, np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        counts += np.unpackbits(raw[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = {c: batch.column(c) for c in batch.schema.names if c != text_col}
        values = [fingerprint(t.as_py()) for t in batch.column(text_col)]
        yield pa.RecordBatch.from_pydict(keep | {"__fp": pa.array(values, pa.int64())})


def fingerprints(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, __fp) of every row."""
    slim = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    schema = T.StructType([slim.schema["__id"], T.StructField("__fp", T.LongType())])
    return slim.mapInArrow(lambda batches: _fingerprints(batches, "__text"), schema)


def _bits(fp: Column, offset: int, n: int) -> Column:
    """``n`` bits of the ring from ``offset`` on."""
    offset %= 64
    if offset + n <= 64:
        return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << n) - 1))
    low = 64 - offset
    return F.shiftrightunsigned(fp, offset).bitwiseOR(F.shiftleft(fp.bitwiseAND(F.lit((1 << (n - low)) - 1)), low))


def _chain_keys(fp: Column, chain: int, pieces: int) -> list[Column]:
    """(start, key) structs of a fingerprint: equal for some start wherever a chain holds."""
    out = []
    errors = chain * DISTANCE // len(SEGMENTS)
    for start, (offset, n) in enumerate(SEGMENTS):
        first = _bits(fp, offset, n)
        later = sum(SEGMENTS[(start + k) % len(SEGMENTS)][1] for k in range(1, chain))
        cuts = [offset + n + later * k // max(1, pieces) for k in range(pieces + 1)]
        values = [_bits(fp, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        for chosen in combinations(range(pieces), pieces - errors) if pieces else [()]:
            tag = F.lit(start * 1000 + sum(1 << i for i in chosen))
            out.append(F.struct(F.lit(start).alias("start"), F.xxhash64(tag, first, *[values[i] for i in chosen]).alias("key")))
    return out


def plan_for(nodes: int) -> tuple[int, int]:
    """The first plan whose keys bring a fingerprint few candidates by chance."""
    for chain, pieces in PLANS:
        errors = chain * DISTANCE // len(SEGMENTS)
        later = 13 * (chain - 1)
        bits = 13 + (later * (pieces - errors) / pieces if pieces else 0)
        keys = len(SEGMENTS) * (len(list(combinations(range(pieces), pieces - errors))) if pieces else 1)
        if nodes * keys / 2**bits <= CHANCE:
            return chain, pieces
    return PLANS[-1]


def _mask(start: int, chain: int) -> int:
    m = 0
    for k in range(chain):
        offset, n = SEGMENTS[(start + k) % len(SEGMENTS)]
        m |= ((1 << n) - 1) << offset
    return m - (1 << 64) if m >= 1 << 63 else m


def _linked(x: Column, start: Column) -> Column:
    """Chain budgets from ``start`` on, then the whole distance, for the difference ``x``."""
    tests = []
    for s in range(len(SEGMENTS)):
        steps = [F.bit_count(x.bitwiseAND(F.lit(_mask(s, c)))) <= c * DISTANCE // len(SEGMENTS) for c in range(1, len(SEGMENTS))]
        tests.append((start == s) & reduce(lambda a, b: a & b, steps))
    return reduce(lambda a, b: a | b, tests) & (F.bit_count(x) <= DISTANCE)


def links(nodes: DataFrame, plan: tuple[int, int] | None = None) -> DataFrame:
    """Edges (a, b) between nodes (rep, fp) that give the components of all links.

    Every pair within the distance is linked or connected through links; no other pair is linked.
    """
    plan = plan or plan_for(nodes.count())
    keyed = nodes.select("rep", "fp", F.explode(F.array(*_chain_keys(F.col("fp"), *plan))).alias("k")).select("rep", "fp", "k.start", "k.key")
    buckets = keyed.groupBy("key").agg(F.min(F.struct("rep", "fp")).alias("least"), F.count("*").alias("n")).where("n > 1")
    members = keyed.join(buckets, "key").select("key", "start", "rep", "fp", F.col("least.rep").alias("least"), F.col("least.fp").alias("least_fp"))
    # Any distance within the limit is a link here, chain or not: the more links with the first, the fewer pairs remain.
    members = members.where("rep <> least").withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("least_fp"))) <= DISTANCE)
    members = written(members, "simhash-members")
    star = members.where("near").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    one = members.where("not near").select("key", "start", F.col("rep").alias("a"), F.col("fp").alias("x"))
    other = members.select("key", F.col("rep").alias("b"), F.col("fp").alias("y"), "near")
    rest = one.join(other, "key").where((F.col("a") > F.col("b")) | F.col("near"))
    rest = rest.where(_linked(F.col("x").bitwiseXOR(F.col("y")), F.col("start")) & (F.col("a") != F.col("b"))).select("a", "b")
    return star.union(rest)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row of ``df``.

    Texts without words, null ones too, have fingerprint zero and link with each other like any equal
    fingerprints. Shingles count as often as they occur; a text of fewer words than a shingle is one.
    A null id is no one's component_id; rows with equal ids are one component's members each. An empty
    table gives no rows. Other columns of ``df`` play no part.
    """
    prints = written(fingerprints(df, id_col, text_col), "fingerprints")
    classes = prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("rep"))
    classes = written(classes, "classes")
    found = components(links(classes.where("rep is not null")))
    ids = classes.join(found, classes.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    # A fingerprint may be a third of all rows: the planner can split the row side of this join.
    out = prints.join(ids, prints["__fp"] == ids.fp, "left")
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component: the one with the least id, null ids last (of rows equal in id and text, any).

    Components are those of the fingerprints, whatever the ids: a text under a null or repeated id goes
    only if another one of its component stays.
    """
    own = dropped(df, ["__key"])
    text = F.col(f"`{text_col}`")
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("none"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    own = own.withColumn("__key", key)
    prints = written(fingerprints(own, "__key", text_col), "fingerprints")
    nodes = written(prints.select(F.col("__fp").alias("rep"), F.col("__fp").alias("fp")).distinct(), "classes")
    found = components(links(nodes))
    groups = prints.join(found, F.col("__fp") == F.col("node"), "left").withColumn("c", F.coalesce("component", "__fp"))
    kept = groups.groupBy("c").agg(F.min("__id").alias("__key")).select("__key")
    return own.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*[F.col(f"`{c}`") for c in own.columns if c != "__key"])


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


_SET = " + ".join(f"CAST(count(*) FILTER (WHERE hash >> {b} & 1 = 1) * 2 > count(*) AS UBIGINT) * {1 << b}::UBIGINT" for b in range(64))
#: The same result by all pairs of distinct fingerprints: for tables of some thousand documents.
OP3_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i + 1:i + {SHINGLE}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {SHINGLE - 1}))) AS i FROM d WHERE len(w) > 0)),
q AS (SELECT DISTINCT k FROM s),
{xxh64_ctes("q", "k", SEED)},
f AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM documents LEFT JOIN (SELECT doc_id, {_SET} AS fp FROM s JOIN xxh64 USING (k) GROUP BY doc_id) USING (doc_id)),
p AS (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM p a JOIN p b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {DISTANCE}),
r(a, b) AS (SELECT fp, fp FROM p UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT r.a AS fp, min(least) AS component_id FROM r JOIN p ON p.fp = r.b GROUP BY r.a)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN c USING (fp)"""
