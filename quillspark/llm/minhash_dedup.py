"""Near-duplicate documents by MinHash with tensored banding.

Two collections of PARTS parts, each part WIDTH minhashes, make PARTS**2 table
keys: every part of the first with every part of the second. So 2*PARTS*WIDTH
minhashes serve as PARTS**2 * 2*WIDTH would without sharing. Two documents of
similarity s meet in a table with probability (1 - (1 - s**WIDTH)**PARTS)**2.

Candidates are verified on the documents' full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import keyed, let_go, materialize, may_match, slices, table
from ._words import U, Words, batch_words, mix, sequence_hash
from .components import connected_components

PARTS, WIDTH = 12, 3
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 80

_SEEDS = mix(np.arange(1, 4096, dtype=U))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(set of each document one after another, index of each one's first; one entry more than documents).

    A document with fewer words than size has its whole sequence as one shingle.
    """
    prefix, first = words.prefix(), words.first
    n, docs = len(words.hashes), len(first) - 1
    at = np.arange(max(0, n - size + 1))
    at = at[words.doc[at] == words.doc[at + size - 1]] if len(at) else at
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    hashes = np.concatenate([sequence_hash(prefix, at, at + size), sequence_hash(prefix, first[short], first[short + 1])])
    doc = np.concatenate([words.doc[at], short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(docs + 1))


def set_sketches(docs: DataFrame, size: int, parts: int = PARTS, width: int = WIDTH) -> DataFrame:
    """(doc_id, tag, n_shingles, set_a, set_b, parts): set_a and set_b name the set; parts holds 2*parts hashes, null for an empty set. docs has doc_id, text and tag."""

    def run(batches):
        let_go()
        for whole in batches:
            for b in slices(whole):
                hashes, first = shingle_sets(batch_words(b.column(1), lower=True), size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                begin = first[full]
                name_a, name_b = np.zeros(len(n), U), np.zeros(len(n), U)
                made = np.zeros((len(full), 2 * parts), U)
                if len(full):
                    name_a[full] = np.add.reduceat(mix(hashes ^ _SEEDS[-1]), begin)
                    name_b[full] = np.add.reduceat(mix(hashes ^ _SEEDS[-2]), begin)
                    for k in range(2 * parts):
                        made[:, k] = U(k + 1)
                        for j in range(k * width, (k + 1) * width):
                            made[:, k] = mix(made[:, k] + np.minimum.reduceat((hashes ^ _SEEDS[2 * j]) * (_SEEDS[2 * j + 1] | U(1)), begin))
                ends = np.concatenate([[0], np.cumsum(n > 0)]) * 2 * parts
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(made.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n.astype(np.int64)), pa.array(name_a.view(np.int64)), pa.array(name_b.view(np.int64)), lists], ["doc_id", "tag", "n_shingles", "set_a", "set_b", "parts"])

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id long, tag long, n_shingles long, set_a long, set_b long, parts array<long>")


def table_members(sets: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, rep) of the tables that at least two sets share.

    sets has rep and parts. A table needs a shared part on both sides, so parts
    that one set alone has are left out before the pairs are formed.
    """
    made = sets.select("rep", F.posexplode("parts").alias("place", "part")).select("rep", (F.col("place") < parts).alias("first"), "part")
    made = materialize(made, "parts")
    ends = made.groupBy("part").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    shared = materialize(ends.where("a < b").select("part"), "shared_parts")
    mine = made.join(shared, "part").groupBy("rep").agg(F.collect_list(F.when(F.col("first"), F.col("part"))).alias("us"), F.collect_list(F.when(~F.col("first"), F.col("part"))).alias("vs"))
    keys = mine.select("rep", "vs", F.explode("us").alias("u")).select("rep", "u", F.explode("vs").alias("v")).select(F.xxhash64("u", "v").alias("key"), "rep")
    keys = materialize(keys, "keys")
    ends = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    kept = materialize(ends.where("a < b").select("key"), "shared_keys")
    return materialize(keys.join(kept, "key"), "members")


def _with_texts(pairs: DataFrame, texts: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, left_text, right_text) of pairs of sets; of texts (doc_id, text) only those that pairs may ask for are shuffled.

    The plan is the same at any size, so what is measured on small tables holds for larger ones.
    """
    for column, text in ((a, "left_text"), (b, "right_text")):
        mine = texts.select(F.col("doc_id").alias(column), F.col("text").alias(text))
        pairs = pairs.join(may_match(mine, pairs.select(column), column).hint("merge"), column)
    return pairs.select(a, b, "left_text", "right_text")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """Those of pairs (a, b) whose full sets are linked."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "left_text", "right_text"):
                left, lo = shingle_sets(batch_words(b.column(2), lower=True), size)
                right, ro = shingle_sets(batch_words(b.column(3), lower=True), size)
                keep = []
                for i in range(b.num_rows):
                    x, y = left[lo[i] : lo[i + 1]], right[ro[i] : ro[i + 1]]
                    small, large = min(len(x), len(y)), max(len(x), len(y))
                    if 100 * small < percent * large:
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (small + large - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_texts(pairs, texts, "a", "b").mapInArrow(run, "a long, b long")


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components (rep, component) after the links between reps; contracts first, so a round sees only what changes."""
    old = lambda c: components.select(F.col("rep").alias(c), F.col("component").alias(f"{c}_component"))
    edges = links.join(old("a"), "a").join(old("b"), "b").select(F.col("a_component").alias("a"), F.col("b_component").alias("b"))
    moved = connected_components(materialize(edges.distinct(), "edges")).withColumnRenamed("component", "moved").withColumnRenamed("node", "component")
    return materialize(components.join(moved, "component", "left").select("rep", F.coalesce("moved", "component").alias("component")), "components")


def table_hubs(members: DataFrame) -> DataFrame:
    """(key, weight, pivot): each table's hub, its member that meets most others over all tables.

    Of a group of copies, that is the text which they are copies of.
    """
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "sizes")
    weights = materialize(members.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("weight")), "weights")
    weighed = materialize(members.join(weights, "rep").select("key", "weight", "rep"), "weighed")
    best = F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("best")
    return materialize(weighed.groupBy("key").agg(best).select("key", "best.weight", (-F.col("best.minus")).alias("pivot")), "hubs")


def differences(chosen: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """(rep, pivot, n, m, d, linked, diff): sizes of a set and of its pivot, and what only one of them has."""
    over, under = 100 - percent, 100 + percent

    def run(batches):
        for whole in batches:
            for b in slices(whole, "left_text", "right_text"):
                mine, mo = shingle_sets(batch_words(b.column(2), lower=True), size)
                pivot, po = shingle_sets(batch_words(b.column(3), lower=True), size)
                diff = [np.setxor1d(mine[mo[i] : mo[i + 1]], pivot[po[i] : po[i + 1]], assume_unique=True) for i in range(b.num_rows)]
                n, m, d = np.diff(mo).astype(np.int64), np.diff(po).astype(np.int64), np.array([len(x) for x in diff], np.int64)
                ends = np.append(0, np.cumsum(d)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(diff).view(np.int64)))
                columns = [b.column(0), b.column(1), pa.array(n), pa.array(m), pa.array(d), pa.array(under * d <= over * (n + m)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "pivot", "n", "m", "d", "linked", "diff"])

    return _with_texts(chosen, texts, "rep", "pivot").mapInArrow(run, "rep long, pivot long, n long, m long, d long, linked boolean, diff array<long>")


def candidate_pairs(groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rep, b): pairs of one pivot's sets in different components that may be linked; none that is linked is left out.

    groups is what differences() gives, with component. Let r = (100 - percent) /
    (100 + percent), D(x) the difference of x and pivot h, and o how many elements
    D(x) and D(y) share. x and y are linked exactly if
    |D(x)| + |D(y)| - 2 o <= r (|x| + |y|). Two sets linked to the pivot are in one
    component, so y, say, is not linked, |D(y)| > r (|y| + |h|), and a link needs
    from x o > (|D(x)| + r (|h| - |x|)) / 2, from y o >= (|D(y)| - r (|y| + |h|)) / 2,
    and from either o >= |D| - r (|x| + |y|), as |D(x)| and |D(y)| cannot differ by
    more than r (|x| + |y|). Where o >= t, the first |D| - t + 1 elements of both in
    one order share an element. The order is by how many of the pivot's sets have
    the element, rarest first: elements that one set alone has come first and meet
    nothing, so what is common to a group is seldom looked at. Of a shared element
    at places i and j of D(x) and D(y), counted from 1, no more than
    1 + min(|D(x)| - i, |D(y)| - j) elements follow or are it, which must
    reach the o that this very pair needs, or another element finds the pair.
    """
    over, under = 100 - percent, 100 + percent
    elements = groups.select("pivot", "rep", F.explode("diff").alias("element"))
    common = materialize(elements.groupBy("pivot", "element").agg(F.count(F.lit(1)).alias("among")).where("among > 1"), "common")
    ordered = elements.join(common, ["pivot", "element"]).groupBy("pivot", "rep").agg(F.sort_array(F.collect_list(F.struct("among", "element"))).alias("ordered"))
    rows = groups.drop("diff").join(ordered, ["pivot", "rep"]).withColumn("alone", F.col("d") - F.size("ordered"))
    any_ = f"d - ({over} * (n + 100 * n div {percent})) div {under}"
    strong = f"({under} * d + {over} * (m - n)) div {2 * under} + 1"
    weak = f"({under} * d - {over} * (n + m) + {2 * under - 1}) div {2 * under}"
    rows = rows.withColumn("strong", F.expr(f"d + 1 - greatest({any_}, {strong}, 1)")).withColumn("weak", F.expr(f"d + 1 - greatest({any_}, {weak}, 1)"))
    rows = rows.withColumn("most", F.when(F.col("linked"), F.col("strong")).otherwise(F.col("weak"))).where("most > alone")
    placed = rows.select("pivot", "rep", "n", "d", "linked", "component", "strong", "alone", F.posexplode(F.expr("slice(ordered, 1, int(most - alone))")).alias("at", "entry"))
    placed = materialize(placed.select("pivot", "entry.element", "rep", "n", "d", "linked", "component", (F.col("alone") + F.col("at") + 1).alias("place"), (F.col("alone") + F.col("at") < F.col("strong")).alias("early")), "placed")
    far, near = placed.where("NOT linked"), placed.where("linked")
    other = lambda rows: rows.select("pivot", "element", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("d").alias("bd"), F.col("component").alias("b_component"), F.col("place").alias("b_place"))
    may = f"component <> b_component AND 100 * least(n, bn) >= {percent} * greatest(n, bn) AND {2 * under} * (1 + least(d - place, bd - b_place)) >= {under} * (d + bd) - {over} * (n + bn)"
    pairs = far.join(other(near), ["pivot", "element"]).where(may).select("rep", "b")
    both = far.where("early").join(other(far.where("early")), ["pivot", "element"]).where("rep < b").where(may).select("rep", "b")
    return pairs.unionByName(both).distinct()


def link_sets(members: DataFrame, texts: DataFrame, size: int, percent: int = PERCENT) -> DataFrame:
    """(rep, component) of the sets in members (key, rep), which share tables.

    No table is paired with itself. Each set is compared with the best hub of its
    tables, and components are joined; tables whose sets are in one component are
    done. In the others each set is compared with the table's hub, and components
    are joined again. What then still differs is left to candidate_pairs(). So
    each two sets that share a table share its hub, and are in one component, or
    have been compared, or cannot be linked.
    """
    hubs = table_hubs(members)
    best = F.max(F.struct("weight", (-F.col("pivot")).alias("minus"))).alias("best")
    chosen = materialize(members.join(hubs.hint("merge"), "key").groupBy("rep").agg(best).select("rep", (-F.col("best.minus")).alias("pivot")), "chosen")
    compared = materialize(differences(chosen, texts, size, percent), "compared")
    found = lambda rows: rows.where("linked AND rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    components = materialize(compared.select("rep", F.col("rep").alias("component")), "components")
    components = _merged(components, found(compared))

    def undecided() -> DataFrame:
        """(rep, pivot) of the tables with several components."""
        ends = members.join(components, "rep").groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d"))
        mixed = materialize(ends.where("c < d").select("key"), "mixed")
        return materialize(members.join(mixed, "key").join(hubs.select("key", "pivot"), "key").select("rep", "pivot").distinct(), "undecided")

    more = materialize(undecided().join(chosen, ["rep", "pivot"], "left_anti"), "more")
    again = materialize(differences(more, texts, size, percent), "again")
    components = _merged(components, found(again))
    compared = compared.unionByName(again)
    groups = materialize(undecided().join(compared, ["rep", "pivot"]).join(components, "rep"), "groups")

    pairs = candidate_pairs(groups, percent).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))
    done = compared.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"))
    pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
    return _merged(components, materialize(verified(pairs, texts, size, percent), "verified"))


def _with_shared_ids(components: DataFrame, grouped: DataFrame) -> DataFrame:
    """Components (rep, component) after sets of one id are linked; grouped has doc_id and rep of every row."""
    ends = grouped.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("doc_id", "a")
    edges = grouped.select("doc_id", F.col("rep").alias("b")).join(materialize(ends, "several"), "doc_id").where("a <> b").select("a", "b")
    edges = materialize(edges.distinct(), "same_id")
    nodes = edges.select(F.col("a").alias("rep")).unionByName(edges.select(F.col("b").alias("rep"))).distinct()
    apart = nodes.join(components, "rep", "left_anti").select("rep", F.col("rep").alias("component"))
    return _merged(materialize(components.unionByName(apart), "components"), edges)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, parts: int = PARTS, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    A document's set is its distinct shingles of `size` words, A-Z lower-cased,
    split at space and 0x09-0x0D; with fewer words, the whole sequence. Documents
    with 100 * intersection >= percent * union are linked; component_id is the
    smallest id reachable. kept marks it. Equal sets are grouped first and enter
    once. Null or empty texts and texts of white space have no set, are linked
    with nothing and kept. A row without id has no component and is kept. The texts
    of rows that share an id are all linked, and those rows share a component. An
    empty table gives an empty table.
    """
    rows = keyed(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    sketches = materialize(set_sketches(rows, size, parts, width), "sketches")
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    name = ["n_shingles", "set_a", "set_b"]
    # an id may have several sets, so sets have numbers of their own
    reps = materialize(usable.groupBy(*name).agg(F.min("doc_id").alias("least")).withColumn("rep", F.monotonically_increasing_id()), "reps")
    stands = F.col("doc_id") == F.col("least")
    grouped = materialize(usable.join(reps, name).select("doc_id", "n_shingles", "rep", "least", F.when(stands, F.col("tag")).alias("tag"), F.when(stands, F.col("parts")).alias("parts")), "grouped")
    members = table_members(grouped.where("parts IS NOT NULL").select("rep", "parts"), parts)
    one = grouped.where("tag IS NOT NULL").groupBy("rep").agg(F.min(F.struct("doc_id", "tag")).alias("one")).select("rep", "one.*")
    wanted = materialize(members.select("rep").distinct().join(one, "rep"), "wanted")
    # rows that are there twice are dropped where the join has put them
    texts = may_match(rows, wanted, "doc_id", "tag").join(wanted.hint("merge"), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag", "rep"])
    texts = materialize(texts.select(F.col("rep").alias("doc_id"), "text"), "texts")
    components = _with_shared_ids(link_sets(members, texts, size, percent), grouped)
    least = components.join(reps.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(components.join(materialize(least, "least_ids"), "component").select("rep", "component_id"), "named")
    linked = grouped.select("doc_id", "n_shingles", "rep", "least").join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "least").alias("component_id"))
    alone = sketches.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
